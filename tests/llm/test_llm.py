"""The ten operators against plain versions, round trips and odd tables."""

import hashlib
import os
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import exact_dedup, graph, jaccard_join, packing, pii, quality_pu, rules, sentencepiece, suffix_dedup, url_filter, warc
from cadenza.llm import queries as q
from cadenza.llm.common import materialise, work_path

from . import brute

ODD = [None, "", " ", "\n\n", "a", "A b", "a b c d", "a b c d", "x" * 3000, "é ü ñ 漢字 🙂", "the cat " * 400, "  two  spaces\t\n \nend ", "<|endoftext|> x"]


def frame(spark, texts, **extra):
    rows = [(i, t, "z", *extra.values()) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n string" + "".join(f", {k} string" for k in extra))


@pytest.fixture(scope="module")
def prose():
    rnd = random.Random(3)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 6))) for _ in range(300)]
    docs = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(5, 120))) for _ in range(60)]
    passage = " ".join(rnd.choice(vocabulary) for _ in range(60))
    for k in range(40):  # near copies, chains of them, and shared passages
        w = docs[rnd.randrange(len(docs))].split()
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        docs.append(" ".join(w))
        docs.append(docs[rnd.randrange(60)][: rnd.randint(20, 200)] + " " + passage + " " + " ".join(rnd.choice(vocabulary) for _ in range(20)))
    docs += ["ab " * 120, "aaaa" * 80, "aaaa" * 90, docs[3].upper(), *ODD]
    return docs


def test_rules_by_hand(spark):
    words = re.compile(r"[^\x20\x09-\x0D]+")
    texts = [*ODD, "a b c a b c", "one two three four " * 20, "l1\nl2\nl1\n \n \n", "# $ x " * 30]
    got = {r.doc_id: r for r in rules.apply_policy(rules.ledger(frame(spark, texts))).collect()}
    for i, t in enumerate(texts):
        w = words.findall(t or "")
        grams = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        covered = {p for j, g in enumerate(grams) if grams.count(g) > 1 for p in (j, j + 1, j + 2)}
        lines = [x for x in (t or "").split("\n") if words.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines))), t
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t or "")
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.kept and r.base_failed)


def test_rules_ablation_counts(spark):
    led = rules.ledger(frame(spark, ["# $ x " * 30, "ok " * 5, "word%d " % 1 + " ".join(f"w{i}" for i in range(80))]))
    got = {r.rule: (r.rejects, r.rejects_alone) for r in rules.ablation(led).collect()}
    assert got["few_words"] == (1, 0) and got["symbols"][0] == 1 and got["upper_case"] == (0, 0)


def test_exact_groups(spark):
    texts = ["A b", "a B", "a b", "É", "é", None, "", "x"]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(frame(spark, texts)).collect()}
    assert got == {0: (2, 3, False), 1: (2, 3, False), 2: (2, 3, True), 3: (3, 1, True), 4: (4, 1, True), 5: (6, 2, False), 6: (6, 2, True), 7: (7, 1, True)}


@pytest.mark.parametrize(("k", "num", "den"), [(4, 85, 100), (5, 80, 100), (1, 60, 100)])
def test_linked_groups_equal_all_pairs(spark, prose, k, num, den):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.linked_groups(frame(spark, prose), k, num, den).collect()}
    assert got == brute.components(list(enumerate(prose)), k, num, den)


def every_repeated_token(found):
    return np.sort(np.array([r.node for r in found.where("n = -1").select("node").distinct().collect()], np.int64).view(np.uint64))


@pytest.mark.parametrize(("small", "direct", "levels"), [(1, 1, 0), (1, 1, 1), (1, 1, 6), (2, 3, 6)])
def test_linked_groups_with_frequent_tokens(spark, prose, monkeypatch, small, direct, levels):
    """Combinations grown to any length, and the direct rest: every repeated token counts as frequent, few groups are small."""
    monkeypatch.setattr(jaccard_join, "heavy_tokens", every_repeated_token)
    for name, value in (("SMALL", small), ("DIRECT", direct), ("LEVELS", levels)):
        monkeypatch.setattr(jaccard_join, name, value)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.linked_groups(frame(spark, prose), 4).collect()}
    assert got == brute.components(list(enumerate(prose)), 4, 85, 100)


@pytest.mark.parametrize(("k", "num", "den"), [(1, 85, 100), (4, 85, 100), (1, 60, 100)])
def test_linked_groups_of_one_boilerplate(spark, monkeypatch, k, num, den):
    """A large group that shares most words, some members of which link and many of which do not."""
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(90)]
    docs = []
    for _ in range(220):
        w = list(base[: rnd.choice([90, 90, 70])])
        for _ in range(rnd.randint(0, 24)):
            w[rnd.randrange(len(w))] = rnd.choice([f"v{rnd.randrange(6)}", f"u{rnd.randrange(4000)}", ""])
        docs.append(" ".join(x for x in w if x))
    monkeypatch.setattr(jaccard_join, "DIRECT", 12)
    monkeypatch.setattr(jaccard_join, "heavy_tokens", every_repeated_token)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.linked_groups(frame(spark, docs), k, num, den).collect()}
    want = brute.components(list(enumerate(docs)), k, num, den)
    assert got == want and 1 < len({c for _, c in want.values()}) < 220


def test_linked_groups_of_repeated_and_missing_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(5, a), (5, b), (3, a + " x"), (None, b), (None, b + " y"), (None, "alone in the world"), (5, a), (None, None), (7, "")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.linked_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == sorted([(5, 57, 3), (5, 57, 5), (3, 58, 3), (None, 57, 5), (None, 58, 5), (None, 1, None), (5, 57, 3), (None, 0, None), (7, 0, 7)], key=repr)


@pytest.mark.parametrize(("shares", "hot"), [((), 1000), ((0.5,), 0), ((0.2, 0.4, 0.6, 0.8), 1), (suffix_dedup.BATCHES, 1000)])
def test_repeats_equal_brute_force(spark, prose, shares, hot, monkeypatch):
    """With any batches, and with seeds of any number of surroundings counted as hot."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(frame(spark, prose), shares).collect()}
    assert got == brute.repeats(list(enumerate(prose)))


def test_levels_merge_geometrically(spark, prose):
    family = suffix_dedup.SuffixIndex()
    docs = frame(spark, prose)
    for k in range(5):
        family.add(docs.where(f"doc_id >= {k * 10} AND doc_id < {k * 10 + 10}"))
    assert [rank for rank, _ in family.levels] == [2, 0]
    keys = [r.kmer_run for _, level in family.levels for r in level.select(F.struct("kmer", "run").alias("kmer_run")).collect()]
    assert len(keys) == len(set(keys))
    grown = suffix_dedup.SuffixIndex()
    for k, rank in enumerate(suffix_dedup.RANKS):
        grown.add(docs.where(f"doc_id >= {k * 10} AND doc_id < {k * 10 + 10}"), rank=rank)
    assert [rank for rank, _ in grown.levels] == [3]


def test_repeats_of_repeated_and_missing_ids(spark):
    rnd = random.Random(4)
    a, b, c = ("".join(rnd.choice("abcdefgh ") for _ in range(300)) for _ in range(3))
    rows = [(1, a), (2, a), (2, b), (None, c), (7, c[:150]), (2, b), (None, None), (9, b[50:250])]
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == sorted([(1, 300, 0), (2, 300, 300), (2, 300, 0), (None, 300, 150), (7, 150, 0), (2, 300, 0), (None, 0, 0), (9, 200, 200)], key=repr)


def test_components_of_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 200), (200, 150), (7, 7)], "a long, b long")
    got = {r.id: r.label for r in graph.components(edges).collect()}
    assert all(got[i] == 0 for i in range(51)) and got[200] == got[150] == 100


def test_packing_is_whole_and_certified(spark, prose):
    docs = frame(spark, prose)
    pieces = packing.token_pieces(docs, q.tokenizer("byte_bpe_50k.json"), q.tokenizer("byte_bpe_50k.tiktoken"), 64)
    out = packing.pack(pieces, 64, 40).toPandas()
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(q.tokenizer("byte_bpe_50k.json"))
    for i, t in enumerate(prose):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        mine = out[out["doc_id"] == i].sort_values("piece")
        assert mine["length"].sum() == len(ids) and (mine["length"].iloc[1:] == 64).all()
        for _, p in mine.iterrows():
            part = np.array(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes()
            assert zlib.crc32(part) == p["ids_crc32"]
    x = out.sort_values(["sequence_id", "offset"])
    assert ((x.groupby("sequence_id")["length"].cumsum() - x["length"]) == x["offset"]).all()
    bins = out.groupby("sequence_id")["length"].sum()
    assert (out["certified_gap"] >= 0).all() and (out.groupby("sequence_id")["certified_gap"].nunique() == 1).all()
    assert bins.max() <= 64 and len(bins) <= packing.lower_bound(out["length"].to_numpy(), 64) * 1.05 + 2


def test_bounds_never_exceed_a_packing():
    rnd = np.random.default_rng(5)
    for _ in range(60):
        x = rnd.integers(1, 65, rnd.integers(1, 80))
        _, _, used = packing.best_fit(x, 64)
        assert -(-x.sum() // 64) <= packing.lower_bound(x, 64) <= used
    assert packing.lower_bound(np.array([40, 40, 40]), 64) == 3


@pytest.mark.parametrize("seed", range(3))
def test_byte_ids_equal_the_tokenizer(seed):
    from tokenizers import Tokenizer

    rnd = random.Random(seed)
    plain = Tokenizer.from_file(q.tokenizer("byte_bpe_50k.json"))
    mine = packing.ByteEncoder(q.tokenizer("byte_bpe_50k.json"), q.tokenizer("byte_bpe_50k.tiktoken"))
    for _ in range(300):
        t = "".join(rnd.choice(["a", " ", " ", "\n", "'s", "é", "1", "!", "\t", "\xa0", "don't", "\u3000", "🙂"]) for _ in range(rnd.randint(0, 14)))
        assert np.frombuffer(mine.encode(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


def test_piece_ids_equal_the_library_and_decode(prose):
    import sentencepiece as library

    path = q.tokenizer("piece_bpe_32k.model")
    sp, mine = library.SentencePieceProcessor(model_file=path), sentencepiece.Encoder(path)
    texts = [t or "" for t in prose] + ["z" * 500 + "the" * 300]
    for t, (ids,) in zip(texts, mine.encode(texts), strict=True):
        ids = np.frombuffer(ids, "<u4")
        assert ids.tolist() == sp.encode(t)
        assert mine.decode(ids) == t


def test_viterbi_has_the_best_score():
    path = q.tokenizer("piece_bpe_32k.model")
    enc = sentencepiece.Encoder(path, ("unigram",))
    m = enc.model
    score = dict(zip(m.ids.tolist(), m.scores.tolist(), strict=True))
    known = {m.pieces[i]: s for i, s in score.items()}
    for w in ["▁the", "▁thntaner", "▁ciónmente", "▁x", "▁漢é"]:
        best = [0.0] + [-np.inf] * len(w)
        for e in range(1, len(w) + 1):
            for s in range(e):
                c = known.get(w[s:e], m.unk_score if e - s == 1 else -np.inf)
                best[e] = max(best[e], best[s] + c)
        codes = np.array([[ord(c) for c in w]], np.uint64)
        ends, piece = sentencepiece.viterbi(m, codes, sentencepiece._tables(m, codes))
        got = sum(score[i] if i >= 0 else m.unk_score for i in piece[ends].tolist())
        assert abs(got - best[-1]) < 1e-6


def test_encode_and_decode_tables(spark, prose):
    path = q.tokenizer("piece_bpe_32k.model")
    docs = frame(spark, prose)
    back = {r.doc_id: r.text for r in sentencepiece.decode(sentencepiece.encode(docs, path), path).collect()}
    assert back == {i: t or "" for i, t in enumerate(prose)}


def test_archives_round_trip_and_lookup(spark):
    import glob
    import gzip

    big = "<p>" + "é" * 600 + "\r\n\r\nWARC/1.1\r\n" + "</p>"
    rows = [
        (1, "http://b.example.org/x", big), (2, "https://a.example.com/y?z%20#f", big), (3, None, None), (4, "no host\n", "tiny"), (5, "http://a.example.com/y", "tiny"),
        (6, "http://b.example.org/x", big + "!"), (None, "http://c.org/", big), (7, "http://c.org/", big + "?"), (7, "http://c.org/", big + "?"), (8, "u://v", "\0" * 3),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("file", F.lit("own"))
    path = work_path(spark, "warc")
    warc.write_archives(pages, path, file_bytes=400)
    caps = warc.scan_archives(spark, path)
    got = {(r.page_id, r.url): (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in caps.collect()}
    for i, url, html in rows:
        raw = (html or "").encode()
        assert got[i, (url or "").replace("\n", "%0A")][:2] == (len(raw), hashlib.sha1(raw).hexdigest())
    assert caps.count() == len(rows) and got[1, rows[0][1]][2:] == got[None, "http://c.org/"][2:] == ("revisit", 2)
    assert all(got[i, (u or "").replace("\n", "%0A")][2:] == ("response", None) for i, u, _ in rows if i in (2, 3, 4, 5, 6, 7, 8))
    # every file is a series of gzip members, and one record is read by file, offset and length alone
    files = glob.glob(f"{path}/volume=*/part-*")
    assert len(files) > 3
    assert sum(gzip.open(f).read().count(b"WARC-Date: 2") for f in files) == len(rows)
    one = next(r for r in caps.collect() if r.page_id == 6)
    with open(f"{path}/{one.file}", "rb") as f:
        f.seek(one.offset)
        raw = gzip.decompress(f.read(one.length))
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and raw.endswith((big + "!").encode() + b"\r\n\r\n")
    blocks = warc.build_index(caps, work_path(spark, "cdx"), per_block=2)
    entries = warc.directory(blocks)
    assert len(entries[0]) >= 5
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    found = warc.lookup(blocks, entries, keys("org,example,b)/x", "zz)/", None))
    assert sorted(r.page_id for r in found.collect()) == [1, 6]
    assert sorted(r.payload_bytes for r in warc.read_records(found, path).collect()) == sorted(len(x.encode()) for x in (big, big + "!"))
    assert warc.lookup(blocks, entries, keys("zz)/")).count() == 0
    # keys that differ only beyond what the directory keeps of them
    long = [(i, f"http://l.org/{'é' * 300}{i % 40:02}", "x") for i in range(120)]
    path = work_path(spark, "warc")
    warc.write_archives(spark.createDataFrame([*rows, *long], "page_id long, url string, html string"), path)
    blocks = warc.build_index(warc.scan_archives(spark, path), work_path(spark, "cdx"), per_block=5)
    entries = warc.directory(blocks)
    assert max(map(len, entries[0] + entries[1])) == warc.KEY_CHARS
    wanted = [f"org,l)/{'é' * 300}{n}" for n in ("07", "31", "77", "0")] + ["org,l)/" + "é" * 249]
    found = warc.lookup(blocks, entries, keys(*wanted, "org,example,b)/x"))
    assert sorted(r.page_id for r in found.collect()) == sorted([1, 6] + [i for i in range(120) if i % 40 in (7, 31)])
    back = warc.round_trip(pages).collect()
    assert sorted((r.page_id or 0, r.record_type) for r in back) == sorted((i or 0, v[2]) for (i, _), v in [*got.items(), ((7, ""), got[7, "http://c.org/"])])


def test_records_of_any_size_are_members(spark):
    """A record of 16 MB and more ends in a size whose last byte is not zero."""
    pages = spark.createDataFrame([(1, "http://a.org/", "ab" * 9_000_000), (2, "http://a.org/b", "x")], "page_id long, url string, html string").coalesce(1)
    assert {(r.page_id, r.payload_bytes) for r in warc.round_trip(pages).collect()} == {(1, 18_000_000), (2, 1)}


def test_base_spans_by_plain_expressions():
    rnd = random.Random(11)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= sum(c.isdigit() for c in m) <= 19 and pii._luhn(re.sub(r"\D", "", m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= sum(c.isdigit() for c in m) <= 15),
    }
    bits = ["a", "@", ".", "b.co", " ", "1", "25", "4111 1111 1111 1111", "192.168.0.1", "+1 (555) 010-9999", "_", "-", "x@y.z", "é", "999."]
    for _ in range(1500):
        t = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 12)))
        want = {k: [m.span() for m in re.finditer(p, t) if ok(m[0])] for k, (p, ok) in kinds.items()}
        assert pii.base_spans(t) == want, t


def test_secrets_are_added_and_prose_is_left_alone(spark):
    texts = ['set token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" now'] * 4 + ["commit 24be64439e3e49cf46b2d7c90f3602a3d0b907ff fixes it"] * 6 + ["plain words about a password policy", None, "mail me@x.org"]
    got = {r.doc_id: r.spans for r in pii.detect(frame(spark, texts)).collect()}
    assert all(got[i] == "secret:13:53" for i in range(4))
    assert all(got[i] == "" for i in range(4, 12)) and got[12] == "email:5:13"
    clean = {r.doc_id: r.text for r in pii.redacted(frame(spark, texts)).collect()}
    assert clean[0] == 'set token = "<secret>" now' and clean[11] is None and clean[12] == "mail <email>"


def test_long_secrets_and_quoted_ones_are_found_and_clean_prose_is_left_alone(spark):
    rnd = random.Random(5)
    long = ["".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n)) for n in (256, 257, 300, 5000)]
    key = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    clean = ["a well-known-and-much-loved-tradition of otorhinolaryngologists", "see src/main/resources/strings and the password policy", f"commit {key} fixes it", "x" * 300, "she said 'antidisestablishmentarianism' twice"]
    texts = [f'set token = "{v}" now' for v in long] + [f'set token = "{key}" now'] * 4 + clean * 3
    got = [r.spans for r in pii.detect(frame(spark, texts)).orderBy("doc_id").collect()]
    assert [s for s in got[:4]] == [f"secret:13:{13 + len(v)}" for v in long]
    assert got[4:8] == ["secret:13:53"] * 4 and got[8:] == [""] * 15
    # shape and quotes suffice without a naming word
    weights = pii.classifier(frame(spark, texts))
    assert pii.find_spans(f'it reads "{key}" here', weights)["secret"] == [(10, 50)]
    assert pii.find_spans(f"commit {key} fixes it", weights)["secret"] == []
    assert pii.redact(texts[2], got[2]) == 'set token = "<secret>" now'


def test_reliabilities_are_recovered_from_votes_alone():
    rnd = np.random.default_rng(8)
    truth = np.array([0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.9, 0.6])
    speaks = np.array([0.9, 0.8, 0.9, 0.5, 0.7, 0.3, 0.6, 0.9])
    y = np.where(rnd.random(40_000) < 0.3, 1, -1)
    votes = np.where(rnd.random((40_000, 8)) < truth, y[:, None], -y[:, None]) * (rnd.random((40_000, 8)) < speaks)
    values, counts = np.unique([pii.pattern(v) for v in votes.tolist()], return_counts=True)
    prior, right, post = pii.reliabilities(list(zip(values.tolist(), counts.astype(float).tolist(), strict=True)))
    assert abs(prior - 0.3) < 0.03 and np.abs(right - truth).max() < 0.03
    # two reliable votes outweigh three poor ones
    assert post[pii.pattern((1, 1, 0, 0, 0, -1, 0, -1))] > 0.5


def test_the_classifier_overrules_a_majority_of_votes(spark):
    """Access keys in prose get more votes against than for them from labelers other than the shape, hashes the reverse."""
    rnd = random.Random(2)
    pick = lambda chars, n: "".join(rnd.choice(chars) for _ in range(n))
    hexes, upper = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    texts = [f"password={pick(hexes, 18)} and" for _ in range(30)] + [f'token = "{pick(hexes, 40)}" x' for _ in range(30)] + [f"given AKIA{pick(upper, 16)} to us" for _ in range(30)]
    texts += ["a word of antidisestablishmentarianism again"] * 40 + [f"order {pick('0123456789', 16)}1 came" for _ in range(60)] + [f"commit {pick(hexes, 40)} fixes" for _ in range(30)]
    weights = pii.classifier(frame(spark, texts))
    got = [bool(pii.find_spans(t, weights)["secret"]) for t in texts]
    assert got == [True] * 90 + [False] * 130
    value = 'use "' + pick(hexes, 64) + '" in revision "' + pick(hexes, 18) + '"'
    against = [(sum(v), pii.scored(f, weights) >= 0.5) for t in [*texts, value, f"password={'a1' * 9}", f"password={'ab' * 10}"] for _, _, v, f in pii.proposals(t)]
    assert any((total < 0) == secret for total, secret in against if total)


def test_votes_change_no_base_span(spark):
    texts = ["card 4111 1111 1111 1111 and password=4111111111111111 or a@b.org", "token = 10.20.30.40 id 12345678901234567890"]
    for i, r in enumerate(pii.detect(frame(spark, texts)).orderBy("doc_id").collect()):
        base = pii.base_spans(texts[i])
        assert r.spans.split(",secret")[0] == ",".join(f"{k}:{a}:{b}" for k in pii.KINDS[:4] for a, b in base[k])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(base[k]) for k in pii.KINDS[:4])


def test_url_rules_and_list(spark):
    host, path = url_filter.parse(F.col("url"))
    urls = [None, "", "nourl", "HTTP://Example.COM/en/x?q#f", "http://www.example.com/en/", "http://a.net/es/", "http://a.net", "x://h?q", "http://notexample.com/en/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").select("page_id", host.alias("host"), path.alias("path"))
    df = df.withColumn("r", url_filter.longest_rule(F.col("host"), F.col("path"), q.URL_RULES))
    got = {r.page_id: (r.host, r.path, r.r and r.r.rule, r.r and r.r.verdict) for r in df.collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, None)
    assert got[3] == ("example.com", "/en/x", "example.com/en/", "block") and got[4][2] == "www.example.com/en/" and got[5][2:] == ("net/es/", "block")
    assert got[6] == ("a.net", "", None, None) and got[7] == ("h", "", None, None) and got[8][2] == "com/"


def test_canonical_urls(spark):
    urls = {
        "HTTP://A.net/x/?utm_source=f#top": "a.net/x", "https://a.net/x?page=2&utm_a=1&ref=y": "a.net/x?page=2&ref=y", "x://h?utm_q=1&b": "h?b",
        "http://a.net/x.html": "a.net/x.html", "http://a.net#q?z": "a.net", "no host": None, None: None, "http:///x": None,
    }
    df = spark.createDataFrame([(u,) for u in urls], "url string").select("url", url_filter.canonical(F.col("url")).alias("key"))
    assert {r.url: r.key for r in df.collect()} == urls


@pytest.mark.parametrize("largest", [url_filter.MAX_LISTED, 10])
def test_listed_is_exact_and_keeps_any_column(spark, largest):
    names = ("block", "bits", "maybe", "key", "row", "in_list", "url", "w0", "IS_LISTED")
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.when(F.col("id") % 10 > 0, F.concat(F.lit("h/"), "id")).alias("k"), *(F.lit(n).alias(n) for n in names))
    pages = pages.unionByName(pages.where("page_id < 20"))
    urls = spark.range(0, 6000, 7).select(F.concat(F.lit("h/"), "id").alias("url"), F.lit(1).alias("key"))
    out = url_filter.listed(pages, urls, "k", max_listed=largest)
    assert out.columns == ["page_id", "k", *names[:-1], "is_listed"] and out.count() == 3020
    got = {r.page_id: (r.is_listed, [r[n] for n in names[:-1]]) for r in out.collect()}
    assert got == {i: (i % 7 == 0 and i % 10 > 0, list(names[:-1])) for i in range(3000)}
    none = urls.limit(0)
    # every length goes through the filter
    assert url_filter.possible(pages, urls, "k", url_filter.n_blocks_for(urls.count()), largest > 10).where("maybe").count() < 450
    assert url_filter.listed(pages, none, "k").where("is_listed").count() == 0 and url_filter.listed(pages.limit(0), urls, "k").count() == 0


def test_the_filter_passes_every_hit_and_few_others(spark):
    pages = spark.range(20_000).select(F.col("id").alias("page_id"), F.concat(F.lit("h/"), "id").alias("k"))
    urls = spark.range(0, 40_000, 7).select(F.concat(F.lit("h/"), "id").alias("url"))
    passed = {r.page_id for r in url_filter.possible(pages, urls, "k", url_filter.n_blocks_for(urls.count())).where("maybe").select("row.page_id").collect()}
    hits = set(range(0, 20_000, 7))
    assert hits <= passed and 0 < len(passed - hits) < 400


def test_the_list_decides_pages_without_a_rule(spark):
    got = q.op10_url_filter(spark, "/root/testdata/sf0.01").where("rule IS NULL").groupBy("verdict").count().collect()
    assert {r.verdict for r in got} == {"allow", "block"}


def test_quality_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    rated = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    scores = q.op1_quality_pu(spark, sf).collect()
    held = [(r.predicted, rated[r.doc_id]) for r in scores if r.held_out and r.doc_id in rated]
    assert len(held) > 50 and np.mean([p == y for p, y in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in scores)


def plain_pu(x, positive, prior, steps, rate=0.3, l2=1e-4):
    """Non-negative PU risk in memory: (weights, steps that ascended)."""
    mean, dev = x.mean(0), np.sqrt(np.maximum((x**2).mean(0) - x.mean(0) ** 2, 1e-6))
    x = np.column_stack([np.ones(len(x)), np.clip((x - mean) / dev, -6, 6)])
    w, ascents = np.zeros(x.shape[1]), 0
    w[0] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = np.clip(x @ w, -30, 30)
        p = 1 / (1 + np.exp(-z))
        xp, pp = x[positive], p[positive]
        negative_part = np.logaddexp(0, z).mean() - prior * np.logaddexp(0, z[positive]).mean()
        of_negative = (p[:, None] * x).mean(0) - prior * (pp[:, None] * xp).mean(0)
        if negative_part < 0:
            ascents += 1
            g = -of_negative
        else:
            g = prior * ((pp - 1)[:, None] * xp).mean(0) + of_negative
        g = g + l2 * np.concatenate([[0], w[1:]])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g**2
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w, ascents


def pu_rows(spark, n, prior, seed=6):
    rnd = np.random.default_rng(seed)
    good = rnd.random(n) < prior
    x = rnd.normal(0, 1, (n, quality_pu.N_FEATURES)) + good[:, None] * np.linspace(0, 2, quality_pu.N_FEATURES)
    positive = good & (rnd.random(n) < 0.3)
    table = spark.createDataFrame([(r.tolist(), bool(p)) for r, p in zip(x, positive, strict=True)], "x array<double>, positive boolean")
    return x, positive, materialise(table, "pu")


@pytest.mark.parametrize(("prior", "ascends"), [(0.05, False), (0.97, True)])
def test_risk_equals_a_plain_one(spark, prior, ascends):
    """With a prior that is far too high the estimated risk on negatives turns negative, and steps ascend."""
    x, positive, table = pu_rows(spark, 600, 0.4)
    w, ascents = plain_pu(x, positive, prior, 25)
    assert (ascents > 0) == ascends
    assert np.allclose(quality_pu.fit(table, prior, 25)[0], w, atol=1e-5)


@pytest.mark.parametrize("seed", [6, 7, 8])
@pytest.mark.parametrize("prior", [0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9])
def test_prior_from_positives_and_unlabelled_texts(spark, prior, seed):
    _, _, table = pu_rows(spark, 8000, prior, seed)
    assert abs(quality_pu.class_prior(table) - prior) < 0.08


def test_ratings_that_are_not_good_are_never_read(spark):
    docs = frame(spark, [*ODD, "x " * 40_000, *("some words of prose here " * k for k in range(1, 30))], quality="9", x="c")
    rate = lambda bad: spark.createDataFrame([(i, 1) for i in range(15, 25)] + bad, "doc_id long, quality int")
    some, none = ({r.doc_id: r.score for r in quality_pu.classify(docs, rate(bad), "true").collect()} for bad in ([(3, 0), (4, 0), (30, None), (None, 1)], []))
    assert some == none and len(some) == docs.count() and all(0 <= v <= 1 for v in some.values()) and some[0] == some[1]


def test_ablation_and_policies_equal_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    for name, key in (("rules_ablation", "rule"), ("op3_quality_rules", "doc_id")):
        want = con.execute(q.ORACLE[name]).df().set_index(key)
        got = q.QUERIES[name](spark, sf).toPandas().set_index(key)
        assert (got.loc[want.index, want.columns] == want).all().all()
    assert (got["kept_v1"] | ~got["kept"]).all()


def test_empty_tables(spark):
    docs = frame(spark, ["x"]).limit(0)
    materialised = materialise(docs, "empty")
    assert rules.apply_policy(rules.ledger(materialised)).count() == 0
    assert exact_dedup.exact_groups(materialised).count() == 0
    assert jaccard_join.linked_groups(materialised).count() == 0
    assert suffix_dedup.remove_repeats(materialised).count() == 0
    assert pii.detect(materialised).count() == 0
    assert packing.pack(packing.token_pieces(materialised, q.tokenizer("byte_bpe_50k.json"), q.tokenizer("byte_bpe_50k.tiktoken"))).count() == 0
    assert sentencepiece.digests(materialised, q.tokenizer("piece_bpe_32k.model")).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_pu.classify(materialised, labels, "true").count() == 0
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_odd_texts_and_null_ids(spark):
    docs = frame(spark, ODD, sequence_id="s", key="k").unionByName(frame(spark, ["dup dup"], sequence_id="s", key="k").withColumn("doc_id", F.lit(None).cast("long")))
    n = docs.count()
    assert rules.ledger(docs).count() == exact_dedup.exact_groups(docs).count() == n
    assert pii.detect(docs).count() == n and sentencepiece.digests(docs, q.tokenizer("piece_bpe_32k.model")).count() == n
    assert suffix_dedup.remove_repeats(docs).count() == n
    assert jaccard_join.linked_groups(docs).count() == n
    assert packing.pack(packing.token_pieces(docs, q.tokenizer("byte_bpe_50k.json"), q.tokenizer("byte_bpe_50k.tiktoken"))).count() >= n


def test_pipeline_stages_keep_their_promises(spark):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf), name)
        assert docs.columns == list(cp.COLUMNS)
        a, b = {r.doc_id: r.text for r in before.collect()}, {r.doc_id: r.text for r in docs.collect()}
        if name == "exact_dedup":
            last = {}
            for i, t in a.items():
                last[brute.lower(t)] = max(i, last.get(brute.lower(t), -1))
            assert set(b) == set(last.values())
        elif name == "near_dedup":
            assert set(b) == {i for i, (_, c) in brute.components(list(a.items()), 5, 80, 100).items() if i == c}
        elif name == "pii":
            assert set(a) == set(b) and not any(s for t in b.values() for v in pii.base_spans(t).values() for s in v)
    assert {r.doc_id for r in cp.run(spark, sf).collect()} == set(b)


def test_pipeline_stages_keep_one_of_each_text_without_an_id(spark):
    import corpus_pipeline as cp

    long = [" ".join(f"{w}{i}" for i in range(60)) for w in "abcd"]
    near = long[2] + " more"
    rows = [(None, long[0]), (None, long[1]), (None, long[1].upper()), (4, long[2]), (None, long[2]), (None, near), (5, long[3]), (5, long[2]), (9, long[2]), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    exact = materialise(cp.exact_duplicates(spark, docs, ""), "exact")
    got = sorted(((r.doc_id, (r.text or "").lower()) for r in exact.collect()), key=repr)
    assert got == sorted([(None, long[0]), (None, long[1]), (None, near), (5, long[3]), (9, long[2]), (None, "")], key=repr)
    kept = cp.near_duplicates(spark, exact, "")
    assert kept.columns == list(cp.COLUMNS)
    got = sorted(((r.doc_id, (r.text or "").lower()) for r in kept.collect()), key=repr)
    assert got == sorted([(None, long[0]), (None, long[1]), (5, long[3]), (9, long[2]), (None, "")], key=repr)
    alone = materialise(docs.where("doc_id IS NULL"), "nameless-docs")
    assert cp.near_duplicates(spark, alone, "").count() == 4


def test_shuffles_of_a_materialised_table_are_dropped(spark):
    """The files of a step's shuffles stayed until the driver happened to collect its garbage; the setting is as before then."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    top, before = spark.conf.get("spark.local.dir"), spark.conf.get(key, None)
    files = lambda: {f for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}
    held = files()
    table = materialise(spark.range(10_000).repartition(7, "id").groupBy((F.col("id") % 100).alias("k")).count(), "dropped")
    for _ in range(50):
        if files() <= held:
            break
        time.sleep(0.1)
    assert files() <= held and len(table.collect()) == 100 and spark.conf.get(key, None) == before
