"""Substring deduplication by suffix automata of reference shards (operator 6)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folianth.llm.blocks import U64, Slice, ids_and_texts, grouped, key_ranges, packed_slices, packed_text, range_of, repeated_keys, slices, unpack

#: Shards of passages for each key range.
PASSAGE_RANGES = 3
#: Bytes that are kept of a word's hash; windows that differ are told apart by 13 words of them.
WORD_BYTES = 6
#: Passages that a task gathers before it sends them; those that it meets again meanwhile are sent once.
HELD_PASSAGES = 30_000


class SuffixAutomaton:
    """A generalised suffix automaton over integer words; each state keeps the document that its words came from first.

    Sequences must be added in the order of their documents, so the first document is also the smallest.
    """

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.doc = [0]

    def add(self, words: list[int], doc: int) -> None:
        nxt, link, length, first = self.next, self.link, self.length, self.doc
        last = 0
        for w in words:
            q = nxt[last].get(w)
            if q is not None:
                if length[q] == length[last] + 1:
                    last = q
                else:
                    last = self._clone(last, w, q)
                continue
            new = len(nxt)
            nxt.append({})
            link.append(0)
            length.append(length[last] + 1)
            first.append(doc)
            p = last
            while p != -1 and w not in nxt[p]:
                nxt[p][w] = new
                p = link[p]
            if p != -1:
                q = nxt[p][w]
                link[new] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
            last = new

    def _clone(self, p: int, w: int, q: int) -> int:
        nxt, link = self.next, self.link
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        self.length.append(self.length[p] + 1)
        self.doc.append(self.doc[q])
        link[q] = new
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = new
            p = link[p]
        return new

    def first_documents(self, words: list[int], window: int) -> list[int]:
        """Matching statistics of a sequence: for each of its windows the first document that has it, or -1."""
        nxt, link, length, first = self.next, self.link, self.length, self.doc
        out, state, matched = [], 0, 0
        for i, w in enumerate(words):
            while state and w not in nxt[state]:
                state = link[state]
                matched = length[state]
            if w in nxt[state]:
                state = nxt[state][w]
                matched += 1
            while link[state] != -1 and length[link[state]] >= window:
                state = link[state]
                matched = length[state]
            if i >= window - 1:
                out.append(first[state] if matched >= window else -1)
        return out


def _numbers(content: bytes) -> list[int]:
    wide = np.zeros((len(content) // WORD_BYTES, 8), np.uint8)
    wide[:, :WORD_BYTES] = np.frombuffer(content, np.uint8).reshape(-1, WORD_BYTES)
    return wide.view(U64).ravel().tolist()


def anchors(s: Slice, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window in one document: its first word, and the position and key of its least k-word shingle.

    Equal windows have equal keys, wherever they stand; neighbouring windows mostly share theirs.
    """
    grams, _ = s.grams(k)
    m = len(s.hash) - window + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
    least, at = grams[:m].copy(), np.arange(m)
    for j in range(1, window - k + 1):
        less = grams[j : m + j] < least
        least[less] = grams[j : m + j][less]
        at[less] = np.flatnonzero(less) + j
    inside = s.doc[:m] == s.doc[window - 1 :]
    return np.flatnonzero(inside), at[inside], least[inside]


def substring_dedup(docs: DataFrame, window: int = 13, k: int = 5) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (and kept, by kept_text=True in removed_words).

    Words are runs without ASCII white space. A word goes if it lies in a window of `window` consecutive words that
    also starts in a document with a smaller doc_id. Null and empty texts have no words; texts shorter than a window
    lose nothing; rows without a doc_id are left out; rows that repeat a doc_id are one document for the comparison,
    since none has a smaller id. Windows are judged on the input.

    Suffix automata of all documents can't be broadcast: each pass over the documents would serve one shard, which is
    quadratic in the corpus. So reference shards are cut by content. Each window belongs to the shard of its least
    k-word shingle; only passages whose shingle occurs in two documents are sent there. A task that meets a passage in
    several documents knows that it goes from all but the smallest, and sends it once, with that one; so a passage of a
    third of all documents doesn't crowd its shard. A shard builds its automaton from distinct passages in document
    order and streams them for matching statistics.
    """
    docs = ids_and_texts(docs)
    n = PASSAGE_RANGES * key_ranges(docs)

    def extract(batch):
        for s in slices(batch):
            start, at, key = anchors(s, window, k)
            new = np.ones(len(at), bool)
            new[1:] = at[1:] != at[:-1]
            ids, keys = s.ids[s.doc[start[new]]], key[new]
            by = np.lexsort((keys, ids))
            ids, keys = ids[by], keys[by]
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
            if len(keys):
                yield ids[new], keys[new]

    hot = repeated_keys(docs, extract).groupBy("doc_id").agg(F.collect_set("key").alias("keys"))

    names = ["part", "words", "lengths", "docs", "places", "offsets"]
    types = [pa.int32()] + [pa.binary()] * 5

    def sent(parts: dict[int, dict[bytes, list]], covered: list[tuple[int, int, int]]):
        """Rows of the passages, and those spans that are known to go."""
        rows = []
        for p, contents in parts.items():
            lengths = np.array([len(c) // WORD_BYTES for c in contents], np.int32)
            places = [len(c) - 1 for c in contents.values()]
            offsets = [o for c in contents.values() for o in c[1:]]
            rows.append((p, b"".join(contents), lengths.tobytes(), np.array([c[0] for c in contents.values()], np.int64).tobytes(), np.array(places, np.int32).tobytes(), np.array(offsets, np.int32).tobytes()))
        if covered:
            doc, start, end = (np.array(x, np.int64) for x in zip(*covered, strict=True))
            rows.append((-1 - int(doc[0] % n), b"", b"", doc.tobytes(), start.astype(np.int32).tobytes(), end.astype(np.int32).tobytes()))
        return grouped(rows, types, names)

    def passages(batches):
        parts: dict[int, dict[bytes, list]] = {}
        covered: list[tuple[int, int, int]] = []
        held = 0
        for batch in batches:
            lists = batch.column(2)
            for a, b, s in packed_slices(batch):
                wanted = np.unique(lists.slice(a, b - a).flatten().to_numpy(zero_copy_only=False).view(U64))
                start, at, key = anchors(s, window, k)
                if not len(start) or not len(wanted):
                    continue
                i = np.searchsorted(wanted, key)
                i[i == len(wanted)] = 0
                hit = wanted[i] == key
                start, at, key = start[hit], at[hit], key[hit]
                if not len(start):
                    continue
                edge = np.flatnonzero((at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)) + 1
                lo = np.concatenate([[0], edge])
                hi = np.concatenate([edge, [len(start)]]) - 1
                part = range_of(key[lo], n)
                begin, end = start[lo], start[hi] + window
                ids = s.ids[s.doc[begin]]
                offset = begin - s.first[s.doc[begin]]
                words = np.ascontiguousarray(s.hash.view(np.uint8).reshape(-1, 8)[:, -WORD_BYTES:])
                for p, x, y, d, o in zip(part.tolist(), begin.tolist(), end.tolist(), ids.tolist(), offset.tolist(), strict=True):
                    content = words[x:y].tobytes()
                    contents = parts.setdefault(p, {})
                    have = contents.get(content)
                    if have is None:
                        contents[content] = [d, o]
                        held += 1
                    elif have[0] == d:
                        have.append(o)
                    elif have[0] < d:
                        covered.append((d, o, o + y - x))
                    else:
                        covered.extend((have[0], z, z + y - x) for z in have[1:])
                        contents[content] = [d, o]
                if held + len(covered) >= HELD_PASSAGES:
                    yield sent(parts, covered)
                    parts, covered, held = {}, [], 0
        if parts or covered:
            yield sent(parts, covered)

    def judge(table: pa.Table) -> pa.Table:
        out_doc, out_start, out_end = [], [], []
        if table["part"][0].as_py() < 0:
            for name, out, kind in (("docs", out_doc, np.int64), ("places", out_start, np.int32), ("offsets", out_end, np.int32)):
                out.append(np.frombuffer(b"".join(table[name].to_pylist()), kind))
        else:
            first: dict[bytes, int] = {}
            found: list[tuple[bytes, int, list[int]]] = []
            for words, lengths, ids, places, offsets in zip(*(table[c].to_pylist() for c in names[1:]), strict=True):
                lengths = np.frombuffer(lengths, np.int32)
                at = to = 0
                offsets = np.frombuffer(offsets, np.int32).tolist()
                for m, d, places_of in zip(lengths.tolist(), np.frombuffer(ids, np.int64).tolist(), np.frombuffer(places, np.int32).tolist(), strict=True):
                    content = words[at : at + WORD_BYTES * m]
                    at += WORD_BYTES * m
                    first[content] = min(d, first.get(content, d))
                    found.append((content, d, offsets[to : to + places_of]))
                    to += places_of
            automaton = SuffixAutomaton()
            order = sorted(first.items(), key=lambda x: x[1])
            for content, d in order:
                automaton.add(_numbers(content), d)
            firsts = {c: automaton.first_documents(_numbers(c), window) for c in first}
            spans = []
            for content, d, offsets in found:
                gone = [f < d for f in firsts[content]]
                i = 0
                while i < len(gone):
                    if not gone[i]:
                        i += 1
                        continue
                    j = i
                    while j < len(gone) and gone[j]:
                        j += 1
                    spans += [(d, o + i, o + j - 1 + window) for o in offsets]
                    i = j
            for out, column in zip((out_doc, out_start, out_end), zip(*spans, strict=True), strict=False):
                out.append(np.array(column, np.int64))
        doc, start, end = (np.concatenate(x).astype(kind) if x else np.zeros(0, kind) for x, kind in ((out_doc, np.int64), (out_start, np.int32), (out_end, np.int32)))
        return pa.table({"doc_id": doc, "start": start, "end": end})

    cut = packed_text(docs).join(hot, "doc_id").select("doc_id", "z", "keys").mapInArrow(passages, "part int, words binary, lengths binary, docs binary, places binary, offsets binary")
    spans = cut.groupBy("part").applyInArrow(judge, "doc_id long, start int, end int")
    spans = spans.groupBy("doc_id").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    return removed_words(packed_text(docs).join(spans, "doc_id", "left"))


def removed_words(joined: DataFrame, kept_text: bool = False) -> DataFrame:
    """The digest columns of (doc_id, z, starts, ends), and the kept text itself on request."""

    def run(batches):
        for batch in batches:
            out = []
            for doc, z, starts, ends in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                words = unpack(z).split()
                n = len(words)
                if starts:
                    depth = np.zeros(n + 1, np.int32)
                    np.add.at(depth, np.minimum(starts, n), 1)
                    np.add.at(depth, np.minimum(ends, n), -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(depth[:n]) == 0).tolist()]
                kept = b" ".join(words)
                out.append((doc, n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode() if kept_text else None))
            cols = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays(cols[: 4 + kept_text], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"][: 4 + kept_text])

    return joined.select("doc_id", "z", "starts", "ends").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * kept_text)


def brute_force(rows: list[tuple[int, str | None]], window: int = 13) -> list[tuple[int, int, int, str]]:
    first: dict[tuple, int] = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(d, first.get(key, d))
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out
