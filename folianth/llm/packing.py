"""Best-fit packing of token sequences with a bounded number of open bins (operator 8)."""

from __future__ import annotations

import json
import math
import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folianth.llm.blocks import bounded, ids_and_texts, text_buffers
from folianth.llm.store import materialize

#: Ids of so many different words, and of half as many words without marks around them, are kept in a Python worker, some
#: 350 bytes a word; a cache starts anew when it is full. Fewer take less memory and more time.
CACHE_WORDS = 1 << 20
#: Marks that are cut off a word's end. Between a letter and one of these the tokenizer always cuts.
MARKS = b".,;:!?*#%$&)]}\""
#: What the way by words rests on: white space parts units, a run of letters is one unit, and so is a run of marks.
UNITS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
#: A packer gets about so many pieces. Each packer leaves some bins unfilled at its end.
PIECES_PER_PACKER = 1 << 17


def word_wise(settings: dict) -> bool:
    """Whether a tokenizer's settings say that the ids of a text are those of its words in a row, and that WordIds' cuts
    between letters and marks are the tokenizer's own."""
    model, steps = settings["model"], (settings.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}]
    return (
        (settings.get("normalizer") or {}).get("normalizers") == NORMALIZERS
        and len(steps) == 2
        and steps[0] == {"type": "Split", "pattern": {"Regex": UNITS}, "behavior": "Removed", "invert": True}
        and (steps[1].get("type"), steps[1].get("add_prefix_space"), steps[1].get("use_regex")) == ("ByteLevel", False, False)
        and (model.get("type"), model.get("end_of_word_suffix"), model.get("dropout")) == ("BPE", "</w>", None)
        and not any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] or t["content"].isalpha() or t["content"].split() != [t["content"]] or t["content"][-1].encode() in MARKS for t in settings.get("added_tokens") or [])
    )


class WordIds:
    """Token ids of texts as little-endian bytes: by way of the words between ASCII white space where word_wise tells that
    the tokenizer allows it, and of the texts as they are otherwise.
    """

    _open: dict[tuple[str, int], WordIds] = {}

    def __init__(self, path: str, cache_words: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            self.word_wise = word_wise(json.load(f))
        self.cache_words = cache_words
        self.known: dict[bytes, bytes] = {}
        self.bare: dict[bytes, bytes] = {b"": b""}
        self.ends = {i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith("</w>")}

    @classmethod
    def of(cls, path: str, cache_words: int = CACHE_WORDS) -> WordIds:
        key = path, cache_words
        if key not in cls._open:
            cls._open[key] = cls(path, cache_words)
        return cls._open[key]

    def learn(self, words: set[bytes]) -> None:
        """Make sure that known has these words."""
        if len(self.known) + len(words) > self.cache_words:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        cores, tails = [], []
        for w in new:
            core = w.rstrip(MARKS)
            if core.isalpha():  # ASCII letters, which the tokenizer lower-cases itself
                cores.append(core.lower())
                tails.append(w[len(core) :])
            elif core is not w and _ends_as_letter(core):
                cores.append(core)
                tails.append(w[len(core) :])
            else:
                cores.append(w)
                tails.append(b"")
        self._learn_bare({*cores, *tails})
        bare = self.bare
        for w, core, tail in zip(new, cores, tails, strict=True):
            self.known[w] = bare[core] + bare[tail] if tail else bare[core]

    def _learn_bare(self, parts: set[bytes]) -> None:
        if len(self.bare) + len(parts) > self.cache_words // 2:
            self.bare = {b"": b""}
        parts = parts.difference(self.bare)
        letters = [t for t in parts if t.isalpha() or t.decode().isalpha()]
        marks = self.end_marks()
        for at in range(0, len(letters), 4096):
            some = letters[at : at + 4096]
            # letters alone are one unit each, whose last token is one that ends a word
            ids = np.array(self.tokenizer.encode(b" ".join(some).decode(), add_special_tokens=False).ids, np.uint32)
            ends = (4 * (np.flatnonzero(marks[ids]) + 1)).tolist()
            if len(ends) == len(some) and ends[-1] == 4 * len(ids):
                flat = ids.tobytes()
                self.bare.update((t, flat[a:b]) for t, a, b in zip(some, [0, *ends[:-1]], ends, strict=True))
        rest = [t for t in parts if t not in self.bare]
        for t, e in zip(rest, self.tokenizer.encode_batch([t.decode() for t in rest], add_special_tokens=False), strict=True):
            self.bare[t] = np.array(e.ids, np.uint32).tobytes()

    def end_marks(self) -> np.ndarray:
        """For each id whether its token ends a word."""
        if isinstance(self.ends, set):
            marks = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True) + 1, bool)
            marks[list(self.ends)] = True
            self.ends = marks
        return self.ends

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each text in turn."""
        if self.word_wise:
            split = [t.split() for t in texts]
            self.learn(set().union(*split))
            for words in split:
                yield b"".join(map(self.known.__getitem__, words))
        else:
            for t in texts:
                yield np.array(self.tokenizer.encode(t.decode(), add_special_tokens=False).ids, "<u4").tobytes()


def token_pieces(docs: DataFrame, tokenizer_path: str, limit: int = 4096, end_id: int = 1, with_ids: bool = False, cache_words: int = CACHE_WORDS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and the ids themselves on request.

    A document is its tokens and end_id; only one of more than limit ids is cut, into pieces of limit ids and a rest.
    Null and empty texts are end_id alone; rows without a doc_id are packed like others.
    """

    def run(batches):
        ids_of = WordIds.of(tokenizer_path, cache_words)
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            docs_at = batch.column(0).to_pylist()
            for a, b in bounded(offsets):
                texts = [data[offsets[i] : offsets[i + 1]].tobytes() for i in range(a, b)]
                rows = []
                for doc, ids in zip(docs_at[a:b], ids_of.encode(texts), strict=True):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * limit)):
                        part = ids[at : at + 4 * limit]
                        rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part), memoryview(part).cast("I").tolist() if with_ids else None))
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[i]) for i in range(5 + with_ids)], names[: 5 + with_ids])

    return ids_and_texts(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def _ends_as_letter(word: bytes) -> bool:
    """Whether the last character is a letter, and still one when the tokenizer has composed and lower-cased it."""
    last = word.decode()[-1:]
    return last.isalpha() and unicodedata.normalize("NFC", last).lower().isalpha()


class OpenBins:
    """Open sequences by free space; bit f of the set tells whether one with f free places is there."""

    def __init__(self, limit: int, most: int):
        self.limit, self.most = limit, most
        self.bits, self.open, self.by_free, self.next = 0, 0, [[] for _ in range(limit + 1)], 0

    def place(self, length: int) -> tuple[int, int]:
        """Sequence and offset: in the open one that it fits best, or in a new one; beyond the most, the fullest closes."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            bin_ = self._take(free)
        else:
            free, bin_ = self.limit, self.next
            self.next += 1
        left = free - length
        if left:
            if self.open == self.most:
                fullest = (self.bits & -self.bits).bit_length() - 1
                if left <= fullest:
                    return bin_, self.limit - free  # it is the fullest itself
                self._take(fullest)
            self.by_free[left].append(bin_)
            self.bits |= 1 << left
            self.open += 1
        return bin_, self.limit - free

    def _take(self, free: int) -> int:
        bin_ = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits &= ~(1 << free)
        self.open -= 1
        return bin_


def best_fit(pieces: DataFrame, limit: int = 4096, open_bins: int = 4096, per_packer: int = PIECES_PER_PACKER) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ...), which should be a stored table.

    Packers are independent: each takes a hashed share in a fixed order, so a packer that is run again gives the same
    sequences. Offsets in a sequence are gapless from 0.
    """
    packers = max(1, math.ceil(pieces.count() / per_packer))
    fields = pieces.schema
    salted = pieces.withColumn("_h", F.xxhash64("doc_id", "piece", "ids_crc32"))
    spread = salted.repartition(packers, "_h").sortWithinPartitions("_h", "doc_id", "piece").drop("_h")

    def run(batches):
        first = TaskContext.get().partitionId() << 40
        bins = OpenBins(limit, open_bins)
        for batch in batches:
            placed = [bins.place(n) for n in batch.column(batch.schema.get_field_index("length")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([first + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())], [*batch.schema.names, "sequence_id", "offset"])

    from pyspark.sql.types import LongType, StructField, StructType

    return spread.mapInArrow(run, StructType([*fields, StructField("sequence_id", LongType()), StructField("offset", LongType())]))


def pack(docs: DataFrame, tokenizer_path: str, limit: int = 4096, end_id: int = 1, open_bins: int = 4096, with_ids: bool = False, cache_words: int = CACHE_WORDS) -> DataFrame:
    """Pieces of all documents with their sequence and offset. An empty table gives no rows; repeated rows are packed
    each; one long document is cut into many pieces; other columns are ignored."""
    return best_fit(materialize(token_pieces(docs, tokenizer_path, limit, end_id, with_ids, cache_words), "pieces"), limit, open_bins)
