"""Operator 9: personal data by weak supervision.

Four base kinds (email, ip, card, phone) are found by fixed rules and always stay.
A fifth kind, ``secret`` (a credential), is only proposed, by a wide pattern that takes
in long words, numbers and paths as well. Labelers look at each proposal and say
secret, not a secret, or nothing; they use shapes (regex), gazetteers of naming words,
or the context. The votes of the whole corpus are counted by pattern (a table whose
size the number of labelers bounds) and expectation-maximisation estimates from the
counts alone how reliable each labeler is. The posteriors it gives label the proposals;
a logistic classifier over the span's own features is trained on ``TRAINED`` of them at
most (half likely secrets, half not, those with the least hash), and it alone decides
which proposals are spans.

A null or empty text has no spans. Rows are kept one to one; only the id and text
columns are read, repeated rows give equal results, and an empty table an empty one.
Proposals within a base span are left to it. Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

KINDS = ("email", "ip", "card", "phone", "secret")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a digit run that cannot begin an address cannot begin one further right either
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
#: Proposals: a run of 16 or more key characters; the look-behind lets no run begin in another, so work is linear.
_PROPOSAL = re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}(?![A-Za-z0-9_+/-])={0,2}")
_NAMES = re.compile(r"(?i)\b(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key|bearer|credential)s?\b")
_OTHER_NAMES = re.compile(r"(?i)\b(?:commit|revision|rev|sha|sha1|sha256|md5|hash|checksum|digest|etag|uuid|id|ref|order|invoice|isbn|doi|version)\b[^A-Za-z0-9]*$")
_ASSIGNED = re.compile(r"""(?:=|:|=>)\s*["']?$""")
_IN_URL = re.compile(r"(?:://|www\.|[/?&#])[^\s]*$")
_PREFIXED = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}\Z|(?:gh[pousr]_|github_pat_|glpat-|xox[abpr]-|sk-|AIza|eyJ)[A-Za-z0-9_/+-]{12,}")
_HEX = re.compile(r"[0-9a-f]+\Z|[0-9A-F]+\Z")
_UUID = re.compile(r"(?i)[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\Z")
LABELERS = ("shape", "classes", "entropy", "named", "assigned", "other_name", "digest", "address")
FEATURES = ("length", "digits", "upper", "lower", "marks", "entropy", "switches", "hex", "prefixed", "named", "assigned", "quoted", "other_name", "address", "uuid", "prose")
TRAINED = 20_000  # spans the classifier is fitted on, at most


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses; each holds one ``@``, so work goes from ``@`` to ``@``."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(done, at + 1))


def _luhn(digits: str) -> bool:
    total = 0
    for k, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of the four base kinds; matches that fail their test are dropped, not retried."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS[:4]}
    if "@" in text:
        out["email"] = list(emails(text))
    if _DIGIT.search(text) is None:
        return out
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-9:]) <= 255 for p in m[0].split(".")):
                out["ip"].append(m.span())
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out["phone"].append(m.span())
    return out


def _entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def proposals(text: str) -> Iterator[tuple[int, int, tuple[int, ...], tuple[float, ...]]]:
    """(start, end, votes, features): a vote is 1 (secret), -1 (not one) or 0 (no opinion), in order of ``LABELERS``."""
    for m in _PROPOSAL.finditer(text):
        value, n = m[0], m.end() - m.start()
        before = text[max(0, m.start() - 40) : m.start()]
        digits = sum("0" <= c <= "9" for c in value)
        upper, lower = sum("A" <= c <= "Z" for c in value), sum("a" <= c <= "z" for c in value)
        marks = n - digits - upper - lower
        entropy = _entropy(value)
        kind = "".join("d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "m" for c in value[:256])
        switches = sum(x != y for x, y in zip(kind, kind[1:], strict=False)) / max(1, len(kind) - 1)
        is_hex, uuid, prefixed = digits > 0 and _HEX.match(value) is not None, _UUID.match(value) is not None, _PREFIXED.match(value) is not None
        named, other = _NAMES.search(before) is not None, _OTHER_NAMES.search(before) is not None
        assigned = _ASSIGNED.search(before) is not None
        quoted = before[-1:] in ("'", '"') and text[m.end() : m.end() + 1] == before[-1:]
        address = _IN_URL.search(before) is not None or value.count("/") > 1
        prose = before[-1:] == " " and before[-2:-1].isalpha()
        votes = (
            1 if prefixed else -1 if uuid or digits == n or digits == 0 and not (upper and lower and switches > 0.3) else 0,
            1 if digits and (upper or lower) and 0.1 <= digits / n <= 0.9 and marks <= n / 8 else -1 if not digits or digits == n else 0,
            1 if entropy >= 3.2 and digits and (upper or lower) else -1 if entropy < 2.9 else 0,
            1 if named else -1 if is_hex and digits < n or digits == n else 0,
            1 if assigned or quoted else -1 if prose else 0,
            -1 if other else 0,
            -1 if uuid or is_hex and n in (32, 40, 56, 64, 96, 128) and not (assigned or quoted) else 0,
            -1 if address else 0,
        )
        facts = (min(n, 128) / 32, digits / n, upper / n, lower / n, marks / n, entropy / 4, switches, is_hex, prefixed, named, assigned, quoted, other, address, uuid, prose)
        yield m.start(), m.end(), votes, tuple(map(float, facts))


def pattern(votes: tuple[int, ...]) -> int:
    """Votes as one number: a digit of base 3 for each labeler."""
    return sum((v + 1) * 3**j for j, v in enumerate(votes))


def _votes_of(patterns: list[int]) -> np.ndarray:
    return np.array([[p // 3**j % 3 - 1 for j in range(len(LABELERS))] for p in patterns], float).reshape(-1, len(LABELERS))


def _open_proposals(text: str, spans: dict[str, list[tuple[int, int]]]) -> Iterator[tuple[int, int, tuple[int, ...], tuple[float, ...]]]:
    """Proposals that meet no base span: one walk along both, since proposals come in order and do not overlap."""
    taken = sorted(s for v in spans.values() for s in v)
    at, reach = 0, 0  # the spans before ``at`` begin before the proposal's end; ``reach`` is their greatest end
    for found in proposals(text):
        while at < len(taken) and taken[at][0] < found[1]:
            reach = max(reach, taken[at][1])
            at += 1
        if reach <= found[0]:
            yield found


def _vote_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        votes, order, x = [], [], []
        for text in batch.column(0).to_pylist():
            if text and _PROPOSAL.search(text):
                for a, b, v, f in proposals(text):
                    votes.append(pattern(v))
                    order.append(zlib.crc32(text[max(0, a - 40) : b].encode("utf-8", "surrogatepass")))
                    x.append(f)
        yield pa.RecordBatch.from_arrays([pa.array(votes, pa.int32()), pa.array(order, pa.int64()), pa.array(x, pa.list_(pa.float64()))], names=["votes", "place", "x"])


def proposal_table(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Votes (as one number), a hash and the features of every proposal of the corpus, materialised. Numbers and long words
    that are no secrets are among them, also those of base kinds: they show what labelers say of such."""
    found = docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(_vote_rows, "votes int, place long, x array<double>")
    return materialise(found, "pii-proposals")


def reliabilities(patterns: list[tuple[int, float]], rounds: int = 100) -> tuple[float, np.ndarray, dict[int, float]]:
    """Expectation-maximisation over counted vote patterns.

    Returns the share of secrets, per labeler the probability that a vote of it is right,
    and each pattern's posterior. No opinion says nothing. Pseudo-votes at a start where
    every labeler is better than chance keep an unused one there.
    """
    start, weight = 0.8, 4.0
    right, prior = np.full(len(LABELERS), start), 0.3
    votes, n = _votes_of([p for p, _ in patterns]), np.array([c for _, c in patterns], float)
    cast = np.abs(votes)
    post = np.zeros(len(n))
    for _ in range(rounds):
        odds = math.log(prior / (1 - prior)) + votes @ np.log(right / (1 - right))
        post = 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
        agree = np.where(votes > 0, post[:, None], 1 - post[:, None]) * cast
        right = np.clip((n @ agree + weight * start) / (n @ cast + weight), 0.02, 0.98)
        prior = min(0.95, max(0.001, float((post * n).sum() + 0.3) / (n.sum() + 1)))
    return prior, right, {p: float(x) for (p, _), x in zip(patterns, post, strict=True)}


def train(x: np.ndarray, y: np.ndarray, steps: int = 1500) -> np.ndarray:
    """Logistic span classifier over ``FEATURES``, fitted to posteriors; both classes weigh alike, whatever their number."""
    w = np.zeros(len(FEATURES) + 1)
    if y.sum() < 0.5:  # nothing to learn from: no proposal is a secret
        w[0] = -6.0
        return w
    x = np.column_stack([np.ones(len(x)), x])
    yes, no = y / y.sum(), (1 - y) / max((1 - y).sum(), 1e-9)
    weight, share = (yes + no) / 2, yes / (yes + no)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= 2.0 * (x.T @ (weight * (p - share)) + 1e-4 * np.concatenate([[0], w[1:]]))
    return w


def scored(features: tuple[float, ...], w: np.ndarray) -> float:
    z = float(w[0] + np.dot(w[1:], features))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def find_spans(text: str, weights: np.ndarray, threshold: float = 0.5) -> dict[str, list[tuple[int, int]]]:
    """All spans of a text by kind; the classifier alone decides which proposals are secrets."""
    spans = base_spans(text)
    spans["secret"] = [(a, b) for a, b, _, features in _open_proposals(text, spans) if scored(features, weights) >= threshold]
    return spans


def _joined(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in spans[k])


def classifier(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Weights of the span classifier: labelers' reliabilities from the votes of the whole corpus, then a fit to posteriors."""
    found = proposal_table(docs, text_col)
    counts = [(r.votes, float(r.n)) for r in found.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).orderBy("votes").collect()]
    _, _, post = reliabilities(counts)
    likely = F.col("votes").isin([p for p, x in post.items() if x >= 0.5])  # as many patterns as the labelers allow, at most
    half = lambda rows: rows.orderBy("place", "votes", "x").limit(TRAINED // 2).collect()
    rows = half(found.where(likely)) + half(found.where(~likely))
    return train(np.array([r.x for r in rows]).reshape(-1, len(FEATURES)), np.array([post[r.votes] for r in rows]))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per document: doc_id, text, counts by base kind, base_sha256 and spans."""
    weights = classifier(docs, text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find_spans(t or "", weights, threshold) for t in batch.column(1).to_pylist()]
            base = [_joined(s, KINDS[:4]) for s in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1)]
                + [pa.array([len(s[k]) for s in found], pa.int64()) for k in KINDS[:4]]
                + [pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base], pa.string()), pa.array([_joined(s, KINDS) for s in found], pa.string())],
                names=["doc_id", "text", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, text string, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(rows, schema)


def redact(text: str, spans: str) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans merge into the first."""
    out, at = [], 0
    parts = sorted((int(a), -int(b), k) for k, a, b in (s.split(":") for s in spans.split(",") if s))
    for a, neg_b, k in parts:
        b = -neg_b
        if a < at:
            if b > at:
                at = b
            continue
        out += [text[at:a], f"<{k}>"]
        at = b
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, ``text`` with every span replaced (a null text stays null), and the columns named in ``carry``."""
    weights = classifier(docs, text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            clean = [t if t is None else redact(t, _joined(find_spans(t, weights), KINDS)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(clean, pa.string()), *batch.columns[2:]], schema=batch.schema)

    part = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *carry)
    return part.mapInArrow(rows, part.schema)
