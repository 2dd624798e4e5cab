"""Token counts by a linear longest-match automaton (operator 5)."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame

from folianth.llm.blocks import bounded, ids_and_texts, text_buffers

#: The counts of words of so many bytes in all are kept in a Python worker; then they are begun anew.
CACHE_BYTES = 1 << 24
_ROOT, _END = 0, 256


class Automaton:
    """A trie of pieces with failure links and, for each link, how many pieces it pops.

    Inner pieces may stand anywhere but at a word's end, final ones only there; the end is one more letter of theirs. A
    word is read once, byte by byte. Where the trie ends, the failure link goes on with the rest of what was read, as
    greedy longest match would, and its count says how many pieces are finished by that; the pieces aren't built. At the
    word's end other links hold, since there an inner piece of all that was read is no piece.
    """

    def __init__(self, inner: set[bytes], final: set[bytes]):
        self.go: dict[int, int] = {}
        whole = [False]
        parents: list[tuple[int, int]] = [(-1, -1)]
        depth = [0]
        for pieces, end in ((inner, []), (final, [_END])):
            for piece in pieces:
                u = _ROOT
                for b in [*piece, *end]:
                    v = self.go.get(u << 9 | b)
                    if v is None:
                        v = self.go[u << 9 | b] = len(whole)
                        whole.append(False)
                        parents.append((u, b))
                        depth.append(depth[u] + 1)
                    u = v
                if piece:
                    whole[u] = True
        self.link, self.pops = [-1] * len(whole), [0] * len(whole)
        self.last_link, self.last_pops = [-1] * len(whole), [0] * len(whole)
        for v in sorted(range(1, len(whole)), key=depth.__getitem__):
            u, b = parents[v]
            if b == _END:
                continue  # a word is over there
            z, count = self.link[u], self.pops[u]
            while z != -1 and (z << 9 | b) not in self.go:
                count += self.pops[z]
                z = self.link[z]
            if z != -1:
                self.last_link[v], self.last_pops[v] = self.go[z << 9 | b], count
            self.link[v], self.pops[v] = (_ROOT, 1) if whole[v] else (self.last_link[v], self.last_pops[v])

    def count(self, word: bytes) -> int:
        """Number of pieces; -1 if no pieces make up the word."""
        go, link, pops = self.go, self.link, self.pops
        u = n = 0
        for b in word:
            v = go.get(u << 9 | b)
            while v is None:
                if link[u] == -1:
                    return -1
                n += pops[u]
                u = link[u]
                v = go.get(u << 9 | b)
            u = v
        while (u << 9 | _END) not in go:
            if self.last_link[u] == -1:
                return -1
            n += self.last_pops[u]
            u = self.last_link[u]
        return n + 1


def read_vocabulary(path: str) -> tuple[set[bytes], set[bytes]]:
    """The byte strings of a byte-level vocabulary file: pieces inside words, and those that end one, whose names end
    in </w>."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}
    with open(path, encoding="utf-8") as f:
        names = json.load(f)["model"]["vocab"]
    out: tuple[set[bytes], set[bytes]] = set(), set()
    for name in names:
        piece = name.removesuffix("</w>")
        if piece and all(c in byte_of for c in piece):
            out[piece != name].add(bytes(byte_of[c] for c in piece))
    return out


_open: dict[str, tuple[Automaton, dict[bytes, int], list[int]]] = {}


def token_counts(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """One row per document: doc_id, n_words, n_tokens, n_unknown.

    Words are runs without ASCII white space, A-Z lower-cased. A word counts as many tokens as greedy longest match
    over the vocabulary's pieces gives, inner ones before the word's end and final ones at it; a word that pieces can't
    make up is one unknown token. Null and empty texts have none, an empty table no rows; a very long word is read once; rows without a doc_id and repeated rows are counted each; other columns are ignored.
    """

    def run(batches):
        if vocabulary_path not in _open:
            _open[vocabulary_path] = Automaton(*read_vocabulary(vocabulary_path)), {}, [0]
        automaton, known, size = _open[vocabulary_path]
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for a, b in bounded(offsets):
                words = [data[offsets[i] : offsets[i + 1]].tobytes().lower().split() for i in range(a, b)]
                new = set().union(*words).difference(known)
                if size[0] > CACHE_BYTES:
                    known.clear()
                    size[0], new = 0, set().union(*words)
                size[0] += sum(map(len, new))
                for w in new:
                    known[w] = automaton.count(w)
                counts = [list(map(known.__getitem__, w)) for w in words]
                unknown = [c.count(-1) for c in counts]
                total = [sum(c) + 2 * u for c, u in zip(counts, unknown, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(x, pa.int64()) for x in ([len(c) for c in counts], total, unknown))], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    return ids_and_texts(docs).mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")


def brute_force(text: str | None, inner: set[bytes], final: set[bytes]) -> tuple[int, int, int]:
    words = (text or "").encode().lower().split()
    total = unknown = 0
    longest = max(map(len, inner | final), default=0)
    for w in words:
        at = n = 0
        while at < len(w):
            size = next((m for m in range(min(longest, len(w) - at), 0, -1) if w[at : at + m] in (final if at + m == len(w) else inner)), 0)
            if not size:
                break
            at, n = at + size, n + 1
        total += n if at == len(w) else 1
        unknown += at < len(w)
    return len(words), total, unknown
