"""Operator 2: SentencePiece encoding and decoding.

Texts are cut into words (a run of space marks and what follows, which no piece
crosses). New words of a batch are grouped by length and advance together as one
array: hashes of their substrings probe the sorted keys of the pieces. For unigram
models a vectorised Viterbi keeps the best score and a backpointer per position;
for BPE models, whose ids Viterbi over the piece scores cannot give, the best pair
of every word merges at once, round by round. Both equal the public library's ids
for the model kind. Words seen before are remembered (a bounded number, in two
generations).

Characters without a piece become byte pieces where the model has them, else the
unknown id. A null or empty text has no ids; decoding gives back the text exactly
unless it holds the space mark itself (U+2581, which reads back as a space) or
unknown ids.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
CACHED = 400_000
LONGEST = 64  # words above this are handled one by one
BATCH = 4_000_000  # characters that are encoded together
RADIX = 18  # leading bits by which the sorted keys are found
_B = np.uint64(0x9E3779B97F4A7C15)


class Model:
    """Pieces, scores and kind of a SentencePiece model file (identity normalisation)."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        self.kind = {1: "unigram", 2: "bpe"}[proto.trainer_spec.model_type]
        self.dummy = proto.normalizer_spec.add_dummy_prefix
        kinds = pb.ModelProto.SentencePiece
        normal = [(p.piece, i, p.score) for i, p in enumerate(proto.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)]
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        self.unknown = next((i for i, p in enumerate(proto.pieces) if p.type == kinds.UNKNOWN), 0)
        self.pieces = [p.piece for p in proto.pieces]
        self.bytes_of = {i: b for b, i in self.byte_ids.items()}
        self.silent = {i for i, p in enumerate(proto.pieces) if p.type in (kinds.CONTROL, kinds.UNKNOWN)}
        self.spelling = [bytes([self.bytes_of[i]]) if i in self.bytes_of else b"" if i in self.silent else p.encode() for i, p in enumerate(self.pieces)]
        self.longest = max((len(p) for p, _, _ in normal), default=1)
        self.unk_score = min((s for _, _, s in normal), default=0.0) - 10
        keys = np.array([_hash_one(p) for p, _, _ in normal], np.uint64)
        order = np.argsort(keys)
        self.keys = keys[order]
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two pieces have the same 64-bit key")
        # the last entry is that of a miss
        self.ids = np.append(np.array([i for _, i, _ in normal], np.int64)[order], -1)
        self.scores = np.append(np.array([s for _, _, s in normal], np.float64)[order], -np.inf)
        self.first = np.searchsorted(self.keys, np.arange(1 << RADIX, dtype=np.uint64) << np.uint64(64 - RADIX)).astype(np.int32)
        self.crowd = np.diff(np.append(self.first, len(self.keys))).astype(np.int8)
        self.by_piece = {p: (i, s) for p, i, s in normal}
        cut = np.cumsum([0, *map(len, self.spelling)])
        self.spelt, self.spelt_at, self.spelt_size = np.frombuffer(b"".join(self.spelling), np.uint8), cut[:-1], np.diff(cut)

    def probe(self, h: np.ndarray) -> np.ndarray:
        """Place of each key among the sorted keys; their number where no piece has it."""
        top = (h >> np.uint64(64 - RADIX)).astype(np.int64)
        crowd = self.crowd[top]
        at = np.full(len(h), len(self.keys), np.int32)
        some = np.flatnonzero(crowd)
        step = 0
        while len(some):  # keys with the same leading bits lie side by side
            place = self.first[top[some]] + step
            hit = self.keys[place] == h[some]
            at[some[hit]] = place[hit]
            step += 1
            some = some[~hit & (crowd[some] > step)]
        return at

    def spell(self, char: str) -> list[int]:
        """Ids of a character that has no piece."""
        if self.byte_ids:
            return [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")]
        return [self.unknown]


def _hash_one(piece: str) -> np.uint64:
    h = np.full(1, _B)
    for c in piece:
        h = _step(h, np.array([ord(c)], np.uint64))
    return h[0]


def _step(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    h = (h ^ (code + np.uint64(1))) * _B
    return h ^ (h >> np.uint64(29))


def _tables(model: Model, codes: np.ndarray) -> dict[int, np.ndarray]:
    """Places (``Model.probe``) of every substring by length: (rows, positions) each. Hashes grow by one character a length."""
    out, rows, n = {}, *codes.shape
    h = np.full(codes.shape, _B)
    for k in range(1, min(n, model.longest) + 1):
        h = _step(h[:, : n - k + 1], codes[:, k - 1 :])
        out[k] = model.probe(h.ravel()).reshape(rows, -1)
    return out


def viterbi(model: Model, codes: np.ndarray, table: dict) -> tuple[np.ndarray, np.ndarray]:
    """Best-scoring segmentation of words of one length, (rows, length) code points.

    Returns (ends, ids), both (rows, length + 1): whether a piece ends at a position
    and its id there, -1 for a character without a piece. The longest piece wins ties.
    """
    rows, n = codes.shape
    best = np.full((rows, n + 1), -np.inf)
    best[:, 0] = 0
    back, piece = np.zeros((rows, n + 1), np.int64), np.full((rows, n + 1), -1, np.int64)
    for end in range(1, n + 1):
        longest = min(end, model.longest)
        lengths = np.arange(longest, 0, -1)
        places = np.stack([table[k][:, end - k] for k in lengths], axis=1)
        ids, total = model.ids, model.scores[places]
        total[:, -1] = np.where(places[:, -1] == len(model.keys), model.unk_score, total[:, -1])
        total = total + best[:, end - longest : end]
        top = total.argmax(1)
        every = np.arange(rows)
        best[:, end], piece[:, end], back[:, end] = total[every, top], ids[places[every, top]], end - lengths[top]
    ends, at = np.zeros((rows, n + 1), bool), np.full(rows, n)
    every = np.arange(rows)
    while len(every):
        ends[every, at] = True
        at = back[every, at]
        every, at = every[at > 0], at[at > 0]
    return ends, piece


def merges(model: Model, codes: np.ndarray, table: dict) -> tuple[np.ndarray, np.ndarray]:
    """BPE of words of one length, in the form of ``viterbi``: every round each row merges its best pair, leftmost first."""
    rows, n = codes.shape
    miss = len(model.keys)
    place = np.full((rows, n + 1, n + 1), miss, np.int32)  # of [a, b)
    for k, t in table.items():
        at = np.arange(n - k + 1)
        place[:, at, at + k] = t
    done = np.tile(np.arange(n + 1), (rows, 1))  # symbol bounds; the tail repeats n
    live, start = np.arange(rows), done.copy()
    pair = np.full((rows, n), -np.inf)  # score of merging a symbol with the next
    if n > 1:
        pair[:, : n - 1] = model.scores[table[2]]
    column = np.arange(n + 1)[None, :]
    while len(live):
        at = pair.argmax(1)
        go = pair[np.arange(len(live)), at] > -np.inf
        done[live[~go]] = start[~go]
        live, at, start, pair = live[go], at[go], start[go], pair[go]
        moved = np.minimum(column + (column > at[:, None]), n)
        start = np.take_along_axis(start, moved, 1)
        here = np.arange(len(live))
        pair = np.take_along_axis(pair, np.minimum(moved[:, :n], n - 1), 1)
        after = start[here, np.minimum(at + 1, n)]
        joined = model.scores[place[live, start[here, at], start[here, np.minimum(at + 2, n)]]]
        pair[here, at] = np.where(after < n, joined, -np.inf)
        left = np.flatnonzero(at > 0)
        pair[left, at[left] - 1] = model.scores[place[live[left], start[left, at[left] - 1], after[left]]]
    ends, piece = np.zeros((rows, n + 1), bool), np.full((rows, n + 1), -1, np.int64)
    r, c = np.nonzero(done[:, :-1] < n)
    a, b = done[r, c], done[r, c + 1]
    ends[r, b], piece[r, b] = True, model.ids[place[r, a, b]]
    return ends, piece


def _merge_long(model: Model, word: str) -> list[int]:
    """The same merges for one long word, by a heap: n log n."""
    import heapq

    known = model.by_piece
    sym, nxt, prv = list(word), list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
    heap: list = []

    def offer(a: int, b: int) -> None:
        if a >= 0 and b < len(sym):
            found = known.get(sym[a] + sym[b])
            if found is not None:
                heapq.heappush(heap, (-found[1], a, b, sym[a], sym[b]))

    for a in range(len(sym) - 1):
        offer(a, a + 1)
    while heap:
        _, a, b, x, y = heapq.heappop(heap)
        if sym[a] != x or sym[b] != y or nxt[a] != b or not x or not y:
            continue
        sym[a], sym[b], nxt[a] = x + y, "", nxt[b]
        if nxt[b] < len(sym):
            prv[nxt[b]] = a
        offer(prv[a], a)
        offer(a, nxt[a])
    return [known[s][0] if s in known else -1 - ord(s) for s in sym if s]


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of the spans [start, start + size) one after another."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(int(size.sum()))


class _Words:
    """Segmented words: number of each word, and per kind the ids of all words with where they begin."""

    def __init__(self, kinds: int) -> None:
        self.number: dict[str, int] = {}
        self.ids = [np.zeros(0, np.uint32) for _ in range(kinds)]
        self.cut = [np.zeros(1, np.int64) for _ in range(kinds)]

    def add(self, words: list[str], ids: list[np.ndarray], sizes: list[np.ndarray]) -> None:
        n = len(self.number)
        self.number.update(zip(words, range(n, n + len(words)), strict=True))
        for k, (x, size) in enumerate(zip(ids, sizes, strict=True)):
            self.cut[k] = np.concatenate([self.cut[k], self.cut[k][-1] + np.cumsum(size)])
            self.ids[k] = np.concatenate([self.ids[k], x.astype(np.uint32)])

    def take(self, k: int, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of words by number."""
        size = self.cut[k][numbers + 1] - self.cut[k][numbers]
        return self.ids[k][_spans(self.cut[k][numbers], size)], size


class Encoder:
    """Encodes batches of texts with one model, by its own and other kinds of segmentation.

    Words are remembered in two generations of about ``CACHED`` words; the older one goes
    when the younger is full, and what is met again moves into the younger.
    """

    def __init__(self, path: str, kinds: tuple[str, ...] = ("",)) -> None:
        self.model = Model(path)
        self.kinds = tuple(k or self.model.kind for k in kinds)
        self.young, self.old = _Words(len(kinds)), _Words(len(kinds))

    def _words(self, text: str) -> list[str]:
        if not text:
            return []
        parts = text.replace(MARK, " ").split(" ")
        if "" not in parts and self.model.dummy:
            return [MARK + p for p in parts]
        out, marks = [], 1 if self.model.dummy else 0
        for k, p in enumerate(parts):
            marks += k > 0
            if p:
                out.append(MARK * marks + p)
                marks = 0
        if marks:
            out.append(MARK * marks)
        return out

    def _spelled(self, path: list[int]) -> np.ndarray:
        ids: list[int] = []
        for i in path:
            ids += [i] if i >= 0 else self.model.spell(chr(-1 - i))
        return np.array(ids, np.int64)

    def _segment(self, kind: str, codes: np.ndarray, table: dict) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, how many each row has)."""
        ends, piece = (merges if kind == "bpe" else viterbi)(self.model, codes, table)
        row, end = np.nonzero(ends)
        ids, unknown = piece[row, end], np.flatnonzero(piece[row, end] < 0)
        if not len(unknown):
            return ids, ends.sum(1)
        chars = codes[row[unknown], end[unknown] - 1]  # a character without a piece: its own ids in its place
        found, of = np.unique(chars, return_inverse=True)
        own = [self.model.spell(chr(int(c))) for c in found]
        size = np.ones(len(ids), np.int64)
        size[unknown] = np.array([len(x) for x in own])[of]
        out = np.repeat(ids, size)
        at = np.cumsum(size) - size
        out[_spans(at[unknown], size[unknown])] = np.concatenate([own[j] for j in of])
        return out, np.bincount(row, size, minlength=len(codes)).astype(np.int64)

    def learn(self, words: set[str]) -> None:
        """Segment words that are not known yet, those of one length together."""
        if len(self.young.number) > CACHED:
            self.old, self.young = self.young, _Words(len(self.kinds))
        new = words - self.young.number.keys()
        again = [w for w in new if w in self.old.number]
        if again:
            numbers = np.array([self.old.number[w] for w in again])
            self.young.add(again, *zip(*[self.old.take(k, numbers) for k in range(len(self.kinds))], strict=True))
        by_length: dict[int, list[str]] = {}
        for w in new.difference(again):
            by_length.setdefault(len(w), []).append(w)
        for n, group in by_length.items():
            step = max(1, 3_000_000 // ((n + 1) * (n + 1 if n <= LONGEST else 2 * self.model.longest)))
            for a in range(0, len(group), step):
                part = group[a : a + step]
                codes = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, n).astype(np.uint64)
                table = _tables(self.model, codes) if n <= LONGEST or "unigram" in self.kinds else {}
                found = []
                for kind in self.kinds:
                    if kind == "bpe" and n > LONGEST:
                        long = [self._spelled(_merge_long(self.model, w)) for w in part]
                        found.append((np.concatenate(long), np.array([len(x) for x in long])))
                    else:
                        found.append(self._segment(kind, codes, table))
                self.young.add(part, *zip(*found, strict=True))

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, ...]]:
        """Little-endian 32-bit ids of each text, once for each kind."""
        a = 0
        while a < len(texts):
            b, size = a, 0
            while b < len(texts) and (b == a or size + len(texts[b]) <= BATCH):
                size += len(texts[b])
                b += 1
            split = [self._words(t) for t in texts[a:b]]
            self.learn(set().union(*split))
            number = self.young.number
            numbers = np.array([number[w] for ws in split for w in ws], np.int64)
            bounds = np.cumsum([0, *map(len, split)])
            found = []
            for k in range(len(self.kinds)):
                ids, sizes = self.young.take(k, numbers)
                cut = np.concatenate([[0], np.cumsum(sizes)])[bounds].tolist()
                data = ids.astype("<u4").tobytes()
                found.append([data[4 * x : 4 * y] for x, y in zip(cut[:-1], cut[1:], strict=True)])
            yield from zip(*found, strict=True)
            a = b

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: byte pieces join, the leading space mark goes."""
        m = self.model
        at = _spans(m.spelt_at[ids], m.spelt_size[ids])
        text = m.spelt[at].tobytes().decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if m.dummy and text.startswith(" ") else text


_encoders: dict[tuple, Encoder] = {}


def shared_encoder(path: str, kinds: tuple[str, ...] = ("",)) -> Encoder:
    """One encoder for each worker process, so that later tasks know the words of earlier ones."""
    if (path, kinds) not in _encoders:
        _encoders[path, kinds] = Encoder(path, kinds)
    return _encoders[path, kinds]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) by the model's own kind of segmentation."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(model_path)
        for batch in batches:
            found = [np.frombuffer(x, "<i4") for (x,) in encoder.encode([t or "" for t in batch.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tolist() for x in found], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(rows, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); null ids decode to an empty text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(model_path)
        for batch in batches:
            texts = [encoder.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(rows, f"doc_id {kind}, text string")


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """Per document: n_ids and ids_crc32 by the model's own segmentation, n_viterbi and viterbi_crc32 of the
    best-scoring segmentation, and decoded_sha256 of the text that the ids decode to."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(model_path, ("", "unigram"))
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            a, b = zip(*encoder.encode(texts), strict=True) if texts else ((), ())
            text = [hashlib.sha256(encoder.decode(np.frombuffer(x, "<u4")).encode()).hexdigest() for x in a]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "n_ids": pa.array([len(x) // 4 for x in a], pa.int64()), "ids_crc32": pa.array([zlib.crc32(x) for x in a], pa.int64()),
                "n_viterbi": pa.array([len(x) // 4 for x in b], pa.int64()), "viterbi_crc32": pa.array([zlib.crc32(x) for x in b], pa.int64()), "decoded_sha256": pa.array(text),
            })

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_ids long, ids_crc32 long, n_viterbi long, viterbi_crc32 long, decoded_sha256 string"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(rows, schema)
