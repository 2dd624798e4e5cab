"""Vectorised words, n-grams and packed key blocks, shared by the similarity operators.

Texts arrive as Arrow batches; a batch is worked on in slices of a few MB, so memory doesn't depend on the batch. Keys are
64-bit hashes. They are shuffled as sorted binary blocks, one row for each slice and key range, not as one row a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folianth.llm.store import partitions

SLICE_BYTES = 1 << 20
#: Key ranges for each shuffle partition, so that hashing ranges to partitions stays even.
RANGES_PER_PARTITION = 4

U64 = np.uint64
_ROOT = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (splitmix64)."""
    h = h.astype(U64, copy=True)
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


_BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(_ROOT)) | U64(1)
_BASE = 0xD1342543DE82EF95
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_NGRAM_BASE = U64(0xA0761D6478BD642F)
_powers: dict[int, np.ndarray] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, SLICE_BYTES + 1), base, dtype=U64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=U64)
    return have[:n]


#: Bytes that part words: the space and \x09-\x0D.
SPACES = np.zeros(256, dtype=bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Slice:
    """Some documents of a batch: ids, and their words' hashes with the document index of each word."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, offsets: np.ndarray, lower: bool):
        self.ids = ids
        base = offsets[0]
        data, offsets = data[base : offsets[-1]], offsets - base
        n = len(data)
        space = SPACES[data]
        before = np.empty(n + 1, dtype=bool)
        before[0], before[1:] = True, space
        before[offsets[:-1]] = True
        after = np.empty(n + 1, dtype=bool)
        after[:-1], after[-1] = space, True
        after[offsets[1:]] = True
        self.start = np.flatnonzero(~space & before[:-1])
        self.end = np.flatnonzero(~space & after[1:]) + 1
        self.doc = np.searchsorted(offsets[1:], self.start, side="right")
        self.first = np.searchsorted(self.doc, np.arange(len(ids) + 1))  # word index where each document begins
        values = _BYTE_VALUE[_LOWER[data] if lower else data] * _powers_of(_BASE, n)
        sums = np.zeros(n + 1, dtype=U64)
        np.cumsum(values, out=sums[1:])
        h = (sums[self.end] - sums[self.start]) * _powers_of(_BASE_INVERSE, n + 1)[self.start]
        self.hash = mix(h + (self.end - self.start).astype(U64) * U64(_ROOT))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of k consecutive words, and whether all k lie in one document."""
        m = len(self.hash) - k + 1
        if m <= 0:
            return np.zeros(0, U64), np.zeros(0, bool)
        g = self.hash[:m].copy()
        for j in range(1, k):
            g *= _NGRAM_BASE
            g += self.hash[j : m + j]
        return mix(g + U64(k)), self.doc[:m] == self.doc[k - 1 :]

    def shingle_sets(self, k: int) -> Iterator[np.ndarray]:
        """Each document's sorted distinct k-word shingles; the whole sequence as one where it is shorter."""
        g, _ = self.grams(k)
        for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True):
            if b - a >= k:
                yield np.unique(g[a : b - k + 1])
            elif b > a:
                whole = 0
                for x in self.hash[a:b].tolist():
                    whole = (whole * int(_NGRAM_BASE) + x) & _MASK
                yield mix(np.array([(whole + (b - a)) & _MASK], dtype=U64))
            else:
                yield np.zeros(0, U64)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets.astype(np.int64)


def bounded(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes each, or of one row."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(n, max(to, at + 1))
        yield at, to
        at = to


def slices(batch: pa.RecordBatch, lower: bool = False) -> Iterator[Slice]:
    """Slices of a batch of (doc_id, text); rows without an id are left out."""
    if batch.column(0).null_count:
        batch = batch.filter(pc.is_valid(batch.column(0)))
    ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
    data, offsets = text_buffers(batch.column(1))
    for a, b in bounded(offsets):
        yield Slice(ids[a:b], data, offsets[a : b + 1], lower)


def unpack(z: bytes | None) -> bytes:
    return b"" if z is None else zstandard.ZstdDecompressor().decompress(z)


def packed_slices(batch: pa.RecordBatch, lower: bool = False) -> Iterator[tuple[int, int, Slice]]:
    """As slices(), of a batch of (doc_id, compressed text), with the rows that each slice covers."""
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    packed, at = batch.column(1), 0
    decompress = zstandard.ZstdDecompressor().decompress
    while at < len(ids):
        parts, size, to = [], 0, at
        while to < len(ids) and (to == at or size < SLICE_BYTES):
            parts.append(decompress(packed[to].as_py()))
            size += len(parts[-1])
            to += 1
        offsets = np.zeros(len(parts) + 1, np.int64)
        np.cumsum([len(x) for x in parts], out=offsets[1:])
        yield at, to, Slice(ids[at:to], np.frombuffer(b"".join(parts), np.uint8), offsets, lower)
        at = to


def packed_text(docs: DataFrame) -> DataFrame:
    """(doc_id, z): texts compressed before a shuffle moves them; null counts as empty, rows without an id go."""

    def run(batches):
        compress = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            data, offsets = text_buffers(b.column(1))
            view = memoryview(data)
            z = [compress(view[i:j]) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(z, pa.binary())], ["doc_id", "z"])

    return ids_and_texts(docs).where("doc_id is not null").mapInArrow(run, "doc_id long, z binary")


#: Rows of an Arrow batch: the default of 10,000 long texts would weigh on both the executor and its Python workers.
ROWS_PER_BATCH = 1000


def small_batches(docs: DataFrame) -> DataFrame:
    """Lower the session's Arrow batch size to ROWS_PER_BATCH where it is larger or has no bound."""
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name, "10000")) <= ROWS_PER_BATCH:
        conf.set(name, str(ROWS_PER_BATCH))
    return docs


def ids_and_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    docs = small_batches(docs)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def key_ranges(docs: DataFrame) -> int:
    return RANGES_PER_PARTITION * partitions(docs.sparkSession)


def range_of(keys: np.ndarray, n: int) -> np.ndarray:
    """The key range, of n, that each key falls in: equal parts of the hash space, in the order of the keys."""
    return ((keys >> U64(32)) * U64(n) >> U64(32)).astype(np.int64)


def runs(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, from, to) of each run in a sorted array."""
    if len(values):
        cut = np.flatnonzero(values[1:] != values[:-1]) + 1
        bounds = [0, *cut.tolist(), len(values)]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield int(values[a]), a, b


#: Gives (doc ids, keys) of each slice of a batch.
Extract = Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]]


def grouped(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def repeated_keys(docs: DataFrame, extract: Extract) -> DataFrame:
    """(doc_id, key) for every key that two or more documents have.

    docs: (doc_id, text). extract gives (doc ids, keys) of a slice, each pair once. What several documents of a slice
    share is known to be repeated, so those pairs need no check; they go to parts of their own, by slice. A key that one
    document of the slice has goes to its key range with the document, a shared one without. So even a key of a third
    of all documents comes to its range once a slice, and a range holds a bounded share of the hash space.
    """
    n = key_ranges(docs)
    types, names = [pa.int32(), pa.binary(), pa.binary(), pa.binary()], ["part", "keys", "ids", "shared"]

    def deal(batches):
        for batch in batches:
            for ids, keys in extract(batch):
                if not len(keys):
                    continue
                order = np.argsort(keys, kind="stable")
                keys, ids = keys[order], ids[order]
                new = np.ones(len(keys), bool)
                new[1:] = keys[1:] != keys[:-1]
                one = new.copy()
                one[:-1] &= new[1:]
                known = ~one
                rows = []
                if known.any():
                    rows.append((-1 - int(mix(ids[:1].view(U64))[0] % U64(n)), keys[known].tobytes(), ids[known].tobytes(), b""))
                single, owner, shared = keys[one], ids[one], keys[new & known]
                at = np.searchsorted(shared, _starts(n))
                bounds = np.searchsorted(single, _starts(n))
                at, bounds = [*at.tolist(), len(shared)], [*bounds.tolist(), len(single)]
                for r in range(n):
                    if bounds[r + 1] > bounds[r] or at[r + 1] > at[r]:
                        rows.append((r, single[bounds[r] : bounds[r + 1]].tobytes(), owner[bounds[r] : bounds[r + 1]].tobytes(), shared[at[r] : at[r + 1]].tobytes()))
                yield grouped(rows, types, names)

    def judge(table: pa.Table) -> pa.Table:
        keys = np.frombuffer(b"".join(table["keys"].to_pylist()), U64)
        ids = np.frombuffer(b"".join(table["ids"].to_pylist()), np.int64)
        if table["part"][0].as_py() >= 0:
            shared = np.unique(np.frombuffer(b"".join(table["shared"].to_pylist()), U64))
            order = np.argsort(keys, kind="stable")
            keys, ids = keys[order], ids[order]
            hit = np.zeros(len(keys), bool)
            same = keys[1:] == keys[:-1]
            hit[1:] |= same
            hit[:-1] |= same
            if len(shared):
                at = np.searchsorted(shared, keys)
                at[at == len(shared)] = 0
                hit |= shared[at] == keys
            keys, ids = keys[hit], ids[hit]
        return pa.table({"doc_id": pa.array(ids), "key": pa.array(keys.view(np.int64))})

    return docs.mapInArrow(deal, "part int, keys binary, ids binary, shared binary").groupBy("part").applyInArrow(judge, "doc_id long, key long")


def _starts(n: int) -> np.ndarray:
    """The least key of each key range."""
    return np.array([-(-(r << 32) // n) << 32 for r in range(n)], U64)
