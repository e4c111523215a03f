"""Ranked search, source divergence and fingerprints against DuckDB, plain versions and odd tables."""

import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import divergence, fingerprints, lexical_search
from cadenza.llm import queries as q
from cadenza.llm.common import materialise

from . import brute
from .test_llm import ODD

TERM11 = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
TERM12 = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def duck(sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["op11_lexical_search", "op12_source_divergence"])
def test_query_equals_sql(spark, sf_dir, name):
    cur = duck(sf_dir).execute(q.ORACLE[name])
    columns = [d[0] for d in cur.description]
    got = q.QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(cur.fetchall())


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(11)
    words = ["w" + str(i) for i in range(60)]
    texts = [" ".join(rnd.choices(words, [1 / (i + 1) for i in range(60)], k=rnd.randint(1, 60))) for _ in range(300)]
    texts += [*ODD, texts[0], texts[0], "W1,w2;W3", "rare rare rare", "x1-x2_x3", "ab " * 70_000]
    return [(i if i % 37 else None, t) for i, t in enumerate(texts)] + [(5, "same id w1"), (5, "same id w1 w2")]


def plain_search(docs, queries, k):
    bags = [TERM11.findall(brute.lower(t)) for _, t in docs]
    n_docs, total = sum(bool(b) for b in bags), sum(map(len, bags))
    df = {}
    for b in bags:
        for t in set(b):
            df[t] = df.get(t, 0) + 1
    asked = {}
    for item, t in queries:
        asked.setdefault(item, set()).update(TERM11.findall(brute.lower(t)))
    out = []
    for item, words in asked.items():
        scored = []
        for (d, _), b in zip(docs, bags):
            s = 0
            for t in words & set(b):
                m = 100 - 50 + 50 * len(b) * n_docs // total
                s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b.count(t) // (1000 * b.count(t) + 20 * m))
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


QUERIES = [(1, "w1 w2 w50 w59"), (2, None), (3, ""), (4, "W3 w3! w30 rare"), (5, "nowhere"), (6, "ab"), (7, "w0"), (8, " ".join(f"w{i}" for i in range(60))), (None, "w7 w8"), (9, "x2 w5"), (1, "w58")]


@pytest.mark.parametrize(("k", "shard", "block"), [(5, 1 << 23, 1 << 19), (50, 900, 1 << 19), (7, 1500, 10), (500, 700, 40)])
def test_search_equals_plain(spark, corpus, k, shard, block):
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in corpus], "doc_id long, text string, term string, score int").repartition(3)
    queries = spark.createDataFrame([(i, t, 2) for i, t in QUERIES], "item_id long, text string, doc_id int")
    found = lexical_search.search(lexical_search.index(docs, shard), queries, k, block_terms=block)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=str) == plain_search(corpus, QUERIES, k)


def test_search_of_nothing(spark, corpus):
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    queries = spark.createDataFrame(QUERIES, "item_id long, text string")
    assert lexical_search.search(lexical_search.index(docs.limit(0)), queries).count() == 0
    assert lexical_search.search(lexical_search.index(docs.where("text IS NULL OR text = ''")), queries).count() == 0
    assert lexical_search.search(lexical_search.index(docs), queries.limit(0)).count() == 0


def test_pair_bounds_skip_more_than_single_ones(spark, sf_dir, monkeypatch):
    """The same result from fewer postings: at most half of all, and fewer than single maxima alone leave."""
    sf = sf_dir.replace("0.001", "0.01")
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    inverted = lexical_search.index(docs, 100_000)
    read = lambda: lexical_search.search(inverted, bench, keep_read=True).agg(F.sum("read")).first()[0]
    with_pairs = read()
    every = duck(sf).execute(q.ORACLE["op11_lexical_search"].rpartition("s AS (")[0].rstrip().rstrip(",") + " SELECT count(*) FROM q JOIN p USING (term)").fetchone()[0]
    code = lexical_search.Block.pairs
    monkeypatch.setattr(lexical_search.Block, "pairs", lambda self: set())
    alone = read_alone(lexical_search, inverted, bench)
    monkeypatch.setattr(lexical_search.Block, "pairs", code)
    assert with_pairs < alone < every and 2 * with_pairs < every


def read_alone(module, inverted, bench):
    """Postings read without pairs, computed here in one process: the workers have their own copy of the module."""
    rows = inverted.toPandas()
    import pyarrow as pa

    asked = bench.select("item_id", F.explode(module.terms(F.col("text"))).alias("term")).distinct().collect()
    number = {x: i for i, x in enumerate(dict.fromkeys(r.item_id for r in asked))}
    terms = {t: i for i, t in enumerate(dict.fromkeys(r.term for r in asked))}
    lengths = np.concatenate([np.array(x) for x in rows[rows.term.isna()].lengths])
    n, total = int((lengths > 0).sum()), int(lengths.sum())
    held = rows[rows.term.isin(list(terms))]
    df = held.assign(n=held.docs.map(len) // 2).groupby("term").n.sum()
    weights = np.array([module.weight(n, int(df.get(t, 0))) if t in df.index else 0 for t in terms])
    chains = [[] for _ in number]
    for r in asked:
        if weights[terms[r.term]] > 0:
            chains[number[r.item_id]].append(terms[r.term])
    for c in chains:
        c.sort(key=lambda t: (weights[t], t))
    block = module.Block(chains, weights, terms, n, total, [1] * len(chains))
    shards = []
    for shard, g in rows[rows.term.isna() | rows.term.isin(list(terms))].groupby("shard"):
        columns = {c: list(g[c]) for c in ("term", "docs", "tfs", "ids", "lengths")}
        columns = {c: [None if x is None or (isinstance(x, float) and math.isnan(x)) else x for x in v] for c, v in columns.items()}
        shards.append(pa.table({"shard": [shard] * len(g), **{c: pa.array(v, k) for (c, v), k in zip(columns.items(), (pa.string(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())))}}))
    seen = [[] for _ in chains]
    known = []
    for t in shards:
        s = module.Shard(block, t)
        most, both, scored = module.shard_bounds(s)
        assert not both
        known.append(most)
        for i, c in enumerate(chains):
            seen[i] += [module._floor(x) for x in module.seeds(s, c, scored, 50)]
    least = [max(1, sorted(x)[-50]) if len(x) >= 50 else 1 for x in seen]
    count = 0
    for t, most in zip(shards, known):
        s = module.Shard(block, t)
        for i, c in enumerate(chains):
            module.best_of(s, c, most, {}, 50, least[i])
        count += s.read
    return count


def test_chain_bounds_are_bounds():
    rnd = np.random.default_rng(5)
    for _ in range(200):
        x = rnd.integers(0, 50, (6, 9)) * (rnd.random((6, 9)) < 0.4)
        single, joint = x.max(1), np.array([(x[i] + x[i + 1]).max() for i in range(5)])
        bound = lexical_search.chain_bounds(single, joint)
        for i in range(7):
            assert x[:i].sum(0).max(initial=0) <= bound[i] <= single[:i].sum()


def plain_audit(rows, least, top):
    rows = [(lang or "", source or "", TERM12.findall(brute.lower(text))) for text, lang, source in rows]
    out = []
    for lang in {r[0] for r in rows}:
        here = [r for r in rows if r[0] == lang]
        df, total, count = {}, {}, {}
        for _, s, words in here:
            for t in set(words):
                df[t] = df.get(t, 0) + 1
            for t in words:
                total[t] = total.get(t, 0) + 1
                count[s, t] = count.get((s, t), 0) + 1
        kept = [t for t in df if df[t] >= least]
        sources = {s for _, s, _ in here}
        p = lambda c, n: 1 + 10**9 * (c + 2) // (n + 2 * len(kept))
        size = {s: sum(count.get((s, t), 0) for t in kept) for s in sources}
        ps = {s: {t: p(count.get((s, t), 0), size[s]) for t in kept} for s in sources}
        whole = {t: p(total[t], sum(total[t] for t in kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted((-sum(f(ps[s][t], ps[o][t]) for t in kept), o.encode(), o) for o in sources - {s})
            out += [(lang, s, "pair", o, -v, i) for i, (v, _, o) in enumerate(pairs, 1)]
            best = sorted((-f(ps[s][t], whole[t]), t.encode(), t) for t in kept if count.get((s, t), 0) and ps[s][t] > whole[t])[:top]
            out += [(lang, s, "term", t, -v, i) for i, (v, _, t) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize(("spill", "tile"), [(1 << 20, 256), (30, 2), (400, 3)])
def test_audit_equals_plain(spark, spill, tile):
    rnd = random.Random(7)
    words = [*"abcdefghijklmnopqrst", "été", "Ñu", "漢字", "x1y", "🙂"]
    rows = [(" ".join(rnd.choices(words, k=rnd.randint(0, 25))), rnd.choice(["en", "de", None, ""]), rnd.choice(["s1", "s2", "S3", None, "é", "", "s7", "hot", "hot", "hot"])) for _ in range(250)]
    rows += [(t, "en", "odd") for t in ODD] + [(None, "zz", "only"), ("lone", "yy", "a"), ("", "yy", "b"), ("q" * 5000, "en", "s1")]
    docs = spark.createDataFrame([(*r, 1, "t") for r in rows], "text string, lang string, source string, n int, term string").repartition(3)
    got = divergence.audit(docs, least=3, top=4, spill=spill, tile=tile)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain_audit(rows, 3, 4)


def test_audit_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_scaled_is_exact_for_large_counts(spark):
    cases = [(0, 0, 1), (10**13, 4 * 10**15, 10**9), (5, 7, 3), (9 * 10**14, 9 * 10**14, 1), (123456789012345, 987654321098765, 55555)]
    df = spark.createDataFrame(cases, "c long, n long, v long").select("c", "n", "v", divergence.scaled(F.col("c"), F.col("n"), F.col("v")).alias("p"))
    for r in df.collect():
        assert r.p == 1 + 10**9 * (r.c + 2) // (r.n + 2 * r.v)


def plain_level(symbols):
    """The next level of one text by loops: runs, three tosses, local maxima, hashes of tuples."""
    runs = []
    for s in symbols:
        if runs and runs[-1][0] == s:
            runs[-1][1] += 1
        else:
            runs.append([s, 1])
    keys = [s for s, _ in runs]
    return runs, keys


def labels_of(symbols, bits):
    def toss(xs):
        out = []
        for i, x in enumerate(xs):
            before = xs[i - 1] if i else x ^ 1
            d = before ^ x
            low = (d & -d).bit_length() - 1 if d else 0
            out.append(2 * low + (x >> low & 1))
        return out

    for _ in range(3):
        symbols = toss(symbols)
    return symbols


def test_parse_equals_plain_loops():
    """Phrase borders of the first level equal a plain coin toss, and labels stay below 6."""
    rnd = random.Random(2)
    for _ in range(200):
        text = bytes(rnd.choice(b"abcab  \xc3\xa9") for _ in range(rnd.randint(1, 60)))
        runs, keys = plain_level(text)
        label = labels_of(keys, 8)
        assert max(label) < 6 and all(a != b for a, b in zip(label, label[1:]))
        want = [0] + [i for i in range(1, len(label) - 1) if label[i - 1] < label[i] > label[i + 1]]
        names, offsets = fingerprints.parse(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 1)[0]
        assert len(names) == len(want) == offsets[-1]
        # equal phrases have equal names, different ones different names
        phrases = [tuple(map(tuple, runs[a:b])) for a, b in zip(want, [*want[1:], len(runs)])]
        assert len(set(phrases)) == len(set(names.tolist())) == len(set(zip(phrases, names.tolist())))


def test_equal_substrings_share_names_at_any_offset():
    rnd = random.Random(3)
    words = ["".join(rnd.choices("abcdefgh", k=rnd.randint(2, 7))) for _ in range(400)]
    passage = " ".join(rnd.choices(words, k=300)).encode()
    sets = []
    for pad in range(7):
        text = ("".join(rnd.choices("xyz ", k=50 + pad)) * (1 + pad)).encode() + passage + b"end" * pad
        levels = fingerprints.parse(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 4)
        sets.append([set(n.tolist()) for n, _ in levels])
    for level in range(4):
        alone = fingerprints.parse(np.frombuffer(passage, np.uint8), np.array([0, len(passage)]), 4)[level][0].tolist()
        inside = alone[4:-4]
        assert all(set(inside) <= s[level] for s in sets), level


def test_fingerprints_do_not_depend_on_the_batch():
    rnd = random.Random(4)
    texts = [bytes(rnd.choice(b"ab \n") for _ in range(rnd.randint(0, 300))) for _ in range(60)] + [b"", b"a", b"aa", b"a" * 70_000, "漢字🙂".encode() * 40]
    together = fingerprints.fingerprints(texts)
    assert together == [fingerprints.fingerprints([t])[0] for t in texts]
    assert [f == "" for f in together] == [not t for t in texts]


def test_compared_equals_plain(spark):
    rnd = random.Random(6)
    words = ["".join(rnd.choices("abcdefgh", k=rnd.randint(2, 7))) for _ in range(400)]
    texts = [" ".join(rnd.choices(words, k=rnd.randint(1, 200))) for _ in range(80)] + list(ODD)
    rnd.shuffle(texts)
    rows = [(1000 - 3 * i, t, "x", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, part int").repartition(5)
    got = {r.doc_id: r for r in fingerprints.compared(docs).collect()}
    order = sorted((d, t or "") for d, t, *_ in rows)
    assert len(got) == len(order)
    for i, (d, t) in enumerate(order):
        following = order[(i + 1) % len(order)][1]
        n = len(t) // 4
        new = t[: len(t) - n] + following[:n]
        r, marks = got[d], fingerprints.fingerprints([x.encode() for x in (t, new, following)])
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(new.encode()).hexdigest(), *marks[:2])
        assert (r.near_edited, r.near_next) == (fingerprints.likeness(*marks[:2]), fingerprints.likeness(marks[0], marks[2]))
        if len(t) > 400:
            names = [{(k, x) for k, (found, _) in enumerate(fingerprints.parse(np.frombuffer(y.encode(), np.uint8), np.array([0, len(y.encode())]), 3), 1) if k > 1 for x in found.tolist()} for y in (t, new)]
            assert abs(len(names[0] & names[1]) / len(names[0] | names[1]) - r.near_edited) < 0.25 and r.near_next < 0.25


def test_compared_odd_tables(spark):
    kind = "doc_id long, text string"
    assert fingerprints.compared(spark.createDataFrame([], kind)).count() == 0
    alone = fingerprints.compared(spark.createDataFrame([(3, "abcd" * 9)], kind)).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0
    rows = fingerprints.compared(spark.createDataFrame([(None, "no id"), (None, None), (4, "same"), (4, "same"), (4, "same")], kind)).collect()
    assert len(rows) == 5 and len({r.fingerprint for r in rows if r.doc_id == 4}) == 1
    empty = fingerprints.compared(materialise(spark.createDataFrame([(1, None), (2, "")], kind), "none")).collect()
    assert {(r.n_chars, r.fingerprint, r.near_edited, r.near_next) for r in empty} == {(0, "", 1.0, 1.0)}


def test_exact_groups_with_keys_that_collide(spark):
    """Keys of one byte: hundreds of different texts share one, and groups still are those of equal texts."""
    from cadenza.llm import exact_dedup

    texts = [f"Text {i % 700}" if i % 3 else f"tEXT {i % 700}" for i in range(2000)] + [None, "", "A", "a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = lambda digits: sorted(map(tuple, exact_dedup.exact_groups(docs, digits=digits).collect()))
    got = rows(2)
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(brute.lower(t), []).append(i)
    want = [(i, max(groups[brute.lower(t)]), len(groups[brute.lower(t)]), i == max(groups[brute.lower(t)]), hashlib.sha256(brute.lower(t).encode()).hexdigest()) for i, t in enumerate(texts)]
    assert got == want == rows(32)


def test_proposals_within_base_spans_in_linear_time():
    import time

    from cadenza.llm import pii

    def plain(text, spans):
        taken = sorted(s for v in spans.values() for s in v)
        return [f[:2] for f in pii.proposals(text) if not any(x < f[1] and f[0] < y for x, y in taken)]

    rnd = random.Random(1)
    for _ in range(300):
        text = " ".join(rnd.choice(["a1b2c3d4e5f6a7b8c9", "x@y1234567890abcdefghij.org", "4111111111111111", "+49 170 1234567", "word", "10.0.0.1", "QWERTY1234567890qwerty=="]) for _ in range(rnd.randint(0, 12)))
        spans = pii.base_spans(text)
        assert [f[:2] for f in pii._open_proposals(text, spans)] == plain(text, spans)
        # overlapping and nested spans of several kinds
        made = {k: [(a, a + rnd.randint(1, 40)) for a in sorted(rnd.sample(range(len(text) + 1), min(3, len(text))))] for k in ("email", "card")}
        assert [f[:2] for f in pii._open_proposals(text, made)] == plain(text, made)
    text = "a1b2c3d4e5f6a7b8c9 me@example.org " * 20_000
    began = time.time()
    assert len(list(pii._open_proposals(text, pii.base_spans(text)))) == 20_000
    assert time.time() - began < 20
