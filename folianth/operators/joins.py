"""Joins of line sets with decisions, editions and vocabularies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folianth.functions import text as T


def line_decisions(lines: DataFrame, decisions: DataFrame) -> DataFrame:
    """Each line's text and where it comes from: skipped lines go; a checked text, an agreed one, an unsure one, the
    reading. decisions: page, line_no, status, checked, agreed."""
    out = lines.join(decisions, ["page", "line_no"], "left").where("status is null or status <> 'skip'")
    source = F.when(F.col("status") == "done", "checked").when(F.col("agreed").isNotNull(), "agreed").when((F.col("status") == "unsure") & F.col("checked").isNotNull(), "unsure").otherwise("read")
    text = F.when(source == "checked", F.coalesce("checked", "text")).when(source == "agreed", F.col("agreed")).when(source == "unsure", F.col("checked")).otherwise(F.col("text"))
    return out.select("book", "page", "line_no", text.alias("text"), source.alias("line_source"))


def manifest_override(review: DataFrame, manifest: DataFrame) -> DataFrame:
    """(id, status, text): the manifest's status replaces the review's, texts stay; ids of either."""
    m = manifest.select("id", F.col("status").alias("new"))
    return review.join(m, "id", "full_outer").select("id", F.coalesce("new", "status").alias("status"), "text")


def without_patterns(lines: DataFrame, patterns: DataFrame, column: str = "line_id") -> DataFrame:
    """Lines whose id fits none of the glob patterns (*, ?, [..]): all of them as one expression, which is one row."""
    like = F.regexp_replace(F.regexp_replace(F.regexp_replace("pattern", r"([.+^$(){}|\\])", r"\\$1"), r"\*", ".*"), r"\?", ".")
    one = patterns.select(like.alias("re")).agg(F.array_join(F.array_sort(F.collect_set("re")), "|").alias("re"))
    one = one.select(F.when(F.col("re") != "", F.concat(F.lit("^(?:"), F.col("re"), F.lit(")$"))).alias("re"))
    return lines.crossJoin(F.broadcast(one)).where(F.col("re").isNull() | ~F.expr(f"{column} rlike re")).drop("re")


def chapter_starts(lines: DataFrame, chapters: DataFrame) -> DataFrame:
    """Lines with a heading flag; a chapter with a title of its own gets a heading row just above its line."""
    joined = lines.join(chapters.select("line_id", F.lit(True).alias("starts"), "title"), "line_id", "left")
    marked = joined.select("book", "page", "line_id", "y0", "y1", "text", (F.coalesce("starts", F.lit(False)) & F.col("title").isNull()).alias("heading"))
    titles = joined.where("title is not null").select("book", "page", F.concat("line_id", F.lit("-title")).alias("line_id"), (F.col("y0") - 2).alias("y0"), (F.col("y0") - 1).alias("y1"), F.col("title").alias("text"), F.lit(True).alias("heading"))
    return marked.unionByName(titles)


# One letter that may stand before a word without a space.
ONE_LETTER_HEADS = ("و", "ب")


def known_words(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, known): in the vocabulary, or two common words of it in a row, of which the first may be a single و or ب.

    words are distinct comparison forms; vocabulary: word and, where some words are not common, common."""
    every = vocabulary.select("word").distinct()
    v = vocabulary.where("common").select("word").distinct() if "common" in vocabulary.columns else every
    cuts = words.where("length(word) >= 3").select("word", F.explode(F.sequence(F.lit(1), F.length("word") - 2)).alias("i"))
    halves = cuts.select("word", F.expr("substring(word, 1, i)").alias("head"), F.expr("substring(word, i + 1)").alias("tail"))
    halves = halves.where((F.length("head") > 1) | F.col("head").isin(*ONE_LETTER_HEADS))
    halves = halves.join(v.withColumnRenamed("word", "tail"), "tail", "left_semi")
    two = halves.where("length(head) > 1").join(v.withColumnRenamed("word", "head"), "head", "left_semi")
    split = two.select("word").union(halves.where("length(head) = 1").select("word"))
    found = words.join(every, "word", "left_semi").select("word").union(split).distinct().withColumn("known", F.lit(True))
    return words.join(found, "word", "left").select("word", F.coalesce("known", F.lit(False)).alias("known"))


def like_words(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(word, suggestion, tier, common, n): words of the lexicon with the same skeleton (tier 0), or one shape away by
    the deletions that both skeletons share (tier 1). lexicon: word, n and, where some aren't, common."""
    common = F.col("common") if "common" in lexicon.columns else F.lit(True)
    asked = words.select("word", T.skeleton(F.col("word")).alias("s")).where("s <> ''")
    have = lexicon.select(F.col("word").alias("suggestion"), "n", common.alias("common"), T.skeleton(F.col("word")).alias("s"))
    same = asked.join(have, "s").select("word", "suggestion", "n", "common", F.lit(0).alias("tier"))

    def keys(df: DataFrame) -> DataFrame:
        return df.withColumn("key", F.explode(F.array_distinct(F.concat(F.array("s"), T.deletes(F.col("s")))))).drop("s")

    near = keys(asked).join(keys(have), "key").select("word", "suggestion", "n", "common", F.lit(1).alias("tier"))
    return same.union(near).where("word <> suggestion").groupBy("word", "suggestion").agg(F.min("tier").alias("tier"), F.bool_or("common").alias("common"), F.max("n").alias("n"))


def suggestions(words: DataFrame, lexicon: DataFrame, limit: int = 5) -> DataFrame:
    """(word, rank, suggestion, tier): the best of like_words: the same skeleton before one shape away, common words,
    more frequent ones, those with more letters alike, then by text. Letters are compared only where the rest is equal."""
    from folianth.operators.evaluate import similarity

    first = Window.partitionBy("word").orderBy("tier", F.desc("common"), F.desc("n"))
    best = like_words(words, lexicon).withColumn("r", F.rank().over(first)).where(F.col("r") <= limit)
    best = best.withColumn("ratio", similarity(F.col("word"), F.col("suggestion")))
    order = Window.partitionBy("word").orderBy("r", F.desc("ratio"), "suggestion")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("word", "rank", "suggestion", "tier")


def bag_recall(reference: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """(key, hits, total): words of the reference that the other text also has, by count. Both: key, word."""
    a = reference.groupBy(key, "word").agg(F.count("*").alias("n"))
    b = other.groupBy(key, "word").agg(F.count("*").alias("m"))
    both = a.join(b, [key, "word"], "left")
    return both.groupBy(key).agg(F.sum(F.least("n", F.coalesce("m", F.lit(0)))).alias("hits"), F.sum("n").alias("total"))


#: So many words at most are looked at together, but for a page that has more.
WORDS_AT_ONCE = 200_000


def words_of_pages(words: DataFrame) -> DataFrame:
    """(page, words): each page's words in one array of (line_no, x0, x1, h), h being their height."""
    return words.groupBy("page").agg(F.collect_list(F.struct("line_no", "x0", "x1", (F.col("y1") - F.col("y0")).alias("h"))).alias("words"))


def page_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, pa.StructArray, list[np.ndarray]]]:
    """Of rows of words_of_pages, some pages at a time: their keys, each word's page by its place among them, the words,
    and line_no, x0, x1 and h in numbers."""
    for batch in batches:
        keys, lists = batch.column(0), batch.column(1)
        ends, at = lists.offsets.to_numpy(), 0
        while at < len(keys):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + WORDS_AT_ONCE, "right")) - 1)
            flat = lists.values.slice(ends[at], ends[to] - ends[at])
            yield keys.slice(at, to - at), np.repeat(np.arange(to - at), np.diff(ends[at : to + 1])), flat, [x.to_numpy(zero_copy_only=False) for x in flat.flatten()]
            at = to


def starts_of(*keys: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it in a key."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(new)


def upper_medians(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The upper median of each stretch of values that begins at starts."""
    n = np.diff(np.append(starts, len(values)))
    order = np.lexsort((values, np.repeat(np.arange(len(starts)), n)))
    return values[order][starts + n // 2]


def lines_sharing(page: np.ndarray, line: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """For each gap [s, e) of a line of a page, how many lines of the page have a gap that overlaps it.

    page and line are numbers from 0, a line belongs to one page. A line's gaps are merged where they overlap; it shares a
    gap unless that lies behind one of its gaps and before the next. Counts of ends give how many gaps overlap and how many
    neighbours both do, but for the neighbours that stand around the gap: these are counted in blocks of 1, 2, 4.. of them
    in the order of the first one's end, each sorted by the second one's start."""
    low = min(s.min(), e.min())
    wide = int(max(s.max(), e.max()) - low) + 2
    s, e = (page.astype(np.int64) * wide + (x - low) for x in (s, e))
    order = np.lexsort((s, line))
    far = (int(page.max()) + 1) * wide + 1
    reach = np.maximum.accumulate(e[order] + line[order] * far) - line[order] * far
    new = np.ones(len(s), bool)
    new[1:] = (line[order][1:] != line[order][:-1]) | (s[order][1:] > reach[:-1])
    first = np.flatnonzero(new)
    a, b, own = s[order][first], reach[np.append(first[1:], len(s)) - 1], line[order][first]
    pair = own[1:] == own[:-1]
    left, right = b[:-1][pair], a[1:][pair]
    asked, back = np.unique(np.stack([s, e]), axis=1, return_inverse=True)
    gs, ge = asked
    base = gs // wide * wide
    below = lambda x, v, side: np.searchsorted(x, v, side) - np.searchsorted(x, base, "left")
    n = below(np.sort(a), ge, "left") - below(np.sort(b), gs, "right")
    by_end = np.argsort(left, kind="stable")
    left, right = left[by_end], right[by_end]
    n -= below(np.sort(right), ge, "left") - below(left, gs, "right")
    upto, k = np.searchsorted(left, gs, "right"), 0
    while 1 << k <= len(right):
        block = np.sort(right + (np.arange(len(right)) >> k) * far)
        q = np.flatnonzero(upto >> k & 1)
        j = (upto[q] >> k) - 1
        n[q] -= ((j + 1) << k) - np.searchsorted(block, ge[q] + j * far, "left")
        k += 1
    return n[back.ravel()]


def column_gaps(words: DataFrame, share: float = 0.2) -> DataFrame:
    """(page, line_no, gap_start, gap_end, shared): wide gaps between a line's words that enough lines of the page share.

    A gap is wide beyond 20 and 2.5 times the line's upper median gap, or beyond 2 word heights if it is the only one. A
    page's words meet in one row; how many lines share a gap is counted without comparing gaps with each other."""
    kind = {f.name: f.dataType.simpleString() for f in words.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, page, flat, (line, x0, x1, h) in page_slices(batches):
            order = np.lexsort((-x1, line, page))
            page, line, x0, x1, h = (x[order] for x in (page, line, x0, x1, h))
            n_lines = np.bincount(page[starts_of(page, line)], minlength=len(keys))
            gap = np.flatnonzero((page[1:] == page[:-1]) & (line[1:] == line[:-1]))
            page, line, h, s, e = page[gap], line[gap], h[gap], x1[gap + 1], x0[gap]
            starts = starts_of(page, line)
            n = np.diff(np.append(starts, len(gap)))
            one, typical = (np.repeat(x, n) for x in (n == 1, upper_medians(e - s, starts)))
            wide = np.flatnonzero(np.where(one, e - s > 2 * h, e - s > np.maximum(20.0, 2.5 * typical)))
            if not len(wide):
                continue
            ids = np.repeat(np.arange(len(starts)), n)[wide]
            shared = lines_sharing(page[wide], ids, s[wide], e[wide])
            kept = np.flatnonzero(shared >= np.maximum(3.0, share * n_lines[page[wide]]))
            at = gap[wide[kept]]
            columns = [keys.take(pa.array(page[wide[kept]])), flat.field("line_no").take(pa.array(order[at])), flat.field("x1").take(pa.array(order[at + 1])), flat.field("x0").take(pa.array(order[at])), pa.array(shared[kept])]
            yield pa.RecordBatch.from_arrays(columns, ["page", "line_no", "gap_start", "gap_end", "shared"])

    schema = f"page {kind['page']}, line_no {kind['line_no']}, gap_start {kind['x1']}, gap_end {kind['x0']}, shared long"
    return words_of_pages(words.where("page is not null")).mapInArrow(run, schema)


def box_pairs(a: DataFrame, b: DataFrame, least: float = 0.5) -> DataFrame:
    """Candidates for carrying decisions over: boxes of one page that overlap enough, the best old one for each new."""
    names = ("x0", "y0", "x1", "y1")
    left, right = a.select("page", F.col("line_no").alias("new_line"), *[F.col(c).alias(f"a_{c}") for c in names]), b.select("page", F.col("line_no").alias("old_line"), *[F.col(c).alias(f"b_{c}") for c in names])
    iou = T.box_overlap([F.col(f"a_{c}") for c in names], [F.col(f"b_{c}") for c in names])
    pairs = left.join(right, "page").where("a_y0 < b_y1 and b_y0 < a_y1").withColumn("iou", iou).where(F.col("iou") >= least)
    return pairs.groupBy("page", "new_line").agg(F.max_by("old_line", F.struct("iou", -F.col("old_line"))).alias("old_line"))


def carried_over(new: DataFrame, old: DataFrame, least: float = 0.5, moved: int = 4) -> DataFrame:
    """(page, new_line, old_line, outcome): checked lines carried to a page's new lines by their boxes.

    New lines choose in their order, each the old line that overlaps it most of those still there: kept where no side
    moved by more than `moved`, else recheck. Old lines that nobody chose are lost. Candidates come from a join within
    the page; only on pages where a line has several is the choice made in Python."""
    names = ("x0", "y0", "x1", "y1")
    left = new.select("page", F.col("line_no").alias("new_line"), *[F.col(c).alias(f"a_{c}") for c in names])
    right = old.select("page", F.col("line_no").alias("old_line"), *[F.col(c).alias(f"b_{c}") for c in names])
    iou = T.box_overlap([F.col(f"a_{c}") for c in names], [F.col(f"b_{c}") for c in names])
    still = F.greatest(*[F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) for c in names]) <= moved
    near = left.join(right, "page").where("a_y0 < b_y1 and b_y0 < a_y1").withColumn("iou", iou).where(F.col("iou") >= least)
    near = near.select(F.col("page").cast("long").alias("page"), "new_line", "old_line", "iou", still.alias("still"))

    def choose(pdf):
        taken, rows = set(), []
        for r in pdf.sort_values(["new_line", "iou", "old_line"], ascending=[True, False, True]).itertuples():
            if r.old_line not in taken and (not rows or rows[-1][1] != r.new_line):
                taken.add(r.old_line)
                rows.append((r.page, r.new_line, r.old_line, "kept" if r.still else "recheck"))
        import pandas as pd

        return pd.DataFrame(rows, columns=["page", "new_line", "old_line", "outcome"])

    rivals = F.greatest(F.count("*").over(Window.partitionBy("page", "new_line")), F.count("*").over(Window.partitionBy("page", "old_line")))
    near = near.withColumn("rivals", rivals).withColumn("most", F.max("rivals").over(Window.partitionBy("page")))
    plain = near.where("most = 1").select("page", F.col("new_line").cast("int").alias("new_line"), F.col("old_line").cast("int").alias("old_line"), F.when(F.col("still"), "kept").otherwise("recheck").alias("outcome"))
    contested = near.where("most > 1").drop("rivals", "most")
    chosen = plain.union(contested.groupBy("page").applyInPandas(choose, "page long, new_line int, old_line int, outcome string"))
    return old.select(F.col("page").cast("long").alias("page"), F.col("line_no").cast("int").alias("old_line")).join(chosen, ["page", "old_line"], "left").select("page", "new_line", "old_line", F.coalesce("outcome", F.lit("lost")).alias("outcome"))
