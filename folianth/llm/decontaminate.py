"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only (operator 1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folianth.llm.store import materialize

#: What parts the words of a lower-cased text. Splitting is many times faster here than extracting all matches.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Shingles and windows of a benchmark are broadcast up to this many; a larger benchmark joins by shuffle.
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    """The array of words, A-Z lower-cased and no other letter; null has none."""
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.coalesce(F.array_remove(F.split(low, GAP), ""), F.array().cast("array<string>"))


def _shingles(df: DataFrame, k: int, *columns: str) -> DataFrame:
    """The columns, position and hash h of each k words in a row of the column words."""
    zipped = F.arrays_zip(*[F.slice("words", j + 1, F.size("words")).alias(f"w{j}") for j in range(k)])
    rows = df.where(F.size("words") >= k).select(*columns, F.posexplode(zipped).alias("pos", "s")).where(f"s.w{k - 1} is not null")
    return rows.select(*columns, "pos", F.xxhash64(F.lit(k), *[F.col(f"s.w{j}") for j in range(k)]).alias("h"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 4) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items.

    An item's windows are its runs of `window` consecutive words, or all its words where it has fewer. A word of a
    document is hit if it lies in an occurrence of a window. Items or documents without words have no windows and no
    hits; repeated items count by their ids; documents without a doc_id are left out; rows that repeat a doc_id are
    each judged on their own text; other columns are ignored.

    A document that holds a window holds all its shingles, so one necessary shingle a window is enough to find it: the
    one that the documents have least often. Shingles that no document has rule their windows out. A candidate's place
    follows from the shingle's place; bounds and the exact words are then compared over the window.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text").cast("string")).alias("w")).where("size(w) > 0 and item is not null")
    windows = items.select("item", F.expr(f"explode(transform(sequence(0, greatest(size(w) - {window}, 0)), i -> slice(w, i + 1, {window})))").alias("words"))
    windows = materialize(windows.distinct(), "windows")
    texts = windows.select("words").distinct().withColumn("k", F.least(F.size("words"), F.lit(shingle)))
    lengths = sorted(r.k for r in texts.select("k").distinct().collect())  # at most `shingle` values
    parts = [_shingles(texts.where(F.col("k") == k), k, "words").withColumnRenamed("pos", "offset") for k in lengths]
    if not parts:
        empty = F.array().cast("array<string>")
        return docs.select("doc_id", F.size(words(F.col("text"))).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.sha2(F.lit(""), 256).alias("items_sha256"), F.lit(False).alias("contaminated"), empty.alias("items"))
    places = parts[0]
    for p in parts[1:]:
        places = places.union(p)
    places = materialize(places, "shingles")
    keys = places.select("h").distinct()
    n_keys = keys.count()

    tokens = docs.select("doc_id", words(F.col("text")).alias("words"))
    seen = [_shingles(tokens, k, "doc_id") for k in lengths]
    hits = seen[0]
    for s in seen[1:]:
        hits = hits.union(s)
    hits = materialize(hits.join(_small(keys, n_keys), "h"), "hits")

    counts = hits.groupBy("h").agg(F.count("*").alias("n"))
    ranked = places.join(counts, "h", "left").groupBy("words").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "offset")).alias("first"))
    probes = materialize(ranked.where("first.n > 0").select(F.col("first.h").alias("h"), F.col("first.offset").alias("offset"), "words"), "probes")
    found = hits.join(_small(probes, probes.count()), "h").where("pos >= offset").select("doc_id", F.struct((F.col("pos") - F.col("offset")).alias("start"), "words").alias("c"))
    found = materialize(found.groupBy("doc_id").agg(F.collect_set("c").alias("cands")), "found")
    ids = found.select("doc_id")

    # only documents with a candidate are compared; the others' texts stay where they are read
    if ids.count() <= BROADCAST_ROWS:
        near, far = docs.join(F.broadcast(ids), "doc_id", "left_semi"), docs.join(F.broadcast(ids), "doc_id", "left_anti")
    else:
        near, far = docs, docs.where("false")
    joined = near.join(found, "doc_id", "left").select("doc_id", words(F.col("text")).alias("words"), "cands")
    true = F.expr("filter(coalesce(cands, array()), c -> c.start + size(c.words) <= size(words) and slice(words, c.start + 1, size(c.words)) = c.words)")
    true = joined.select("doc_id", F.size("words").cast("long").alias("n_words"), F.when(F.col("cands").isNull(), None).otherwise(true).alias("hits"))
    covered = F.expr(
        "aggregate(array_sort(transform(hits, c -> named_struct('s', c.start, 'e', c.start + size(c.words)))), named_struct('n', 0L, 'to', 0),"
        " (a, c) -> named_struct('n', a.n + greatest(0, c.e - greatest(a.to, c.s)), 'to', greatest(a.to, c.e)), a -> a.n)"
    )
    texts_hit = F.expr("array_sort(array_distinct(transform(hits, c -> c.words)))")
    judged = materialize(true.select("doc_id", "n_words", F.coalesce(covered, F.lit(0)).cast("long").alias("n_hit"), F.when(F.size("hits") > 0, texts_hit).alias("found")), "judged")

    # the same windows give the same items, so each set of windows is looked up once
    sets = judged.where("found is not null").select("found", F.xxhash64("found").alias("key")).distinct()
    named = sets.select("key", "found", F.explode("found").alias("words")).join(_small(windows, windows.count()), "words").select("key", "found", "item").distinct()
    named = materialize(named.groupBy("key", "found").agg(F.array_sort(F.collect_list("item")).alias("items")), "named")
    out = judged.withColumn("key", F.when(F.col("found").isNotNull(), F.xxhash64("found"))).join(_small(named, named.count()), ["key", "found"], "left")
    none = F.array().cast("array<string>")
    rest = far.select("doc_id", F.size(words(F.col("text"))).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), none.alias("items"))
    out = out.select("doc_id", "n_words", "n_hit", F.coalesce("items", none).alias("items")).unionByName(rest)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "items")


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], window: int = 10) -> list[tuple]:
    import hashlib
    import re

    def split(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    wins: dict[tuple, set[str]] = {}
    for item, text in items:
        w = split(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[i : i + window]), set()).add(str(item))
    sizes = {len(x) for x in wins}
    out = []
    for doc, text in docs:
        w, hit, found = split(text), set(), set()
        for m in sizes:
            for i in range(len(w) - m + 1):
                if (t := tuple(w[i : i + m])) in wins:
                    hit.update(range(i, i + m))
                    found |= wins[t]
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out
