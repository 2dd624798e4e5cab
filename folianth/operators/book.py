"""Statistics of books and what they decide: headers, margins, pitch, sparse pages, kinds, vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folianth.functions import text as T


def in_margin(zone: float = 0.15) -> Column:
    """The line's centre is in the top or bottom zone of a page with a known height; in whole numbers of 1/100."""
    y, share = (F.col("y0") + F.col("y1")) * 50, round(zone * 100)
    return (F.col("height") > 0) & ((y < share * F.col("height")) | (y > (100 - share) * F.col("height")))


def running_headers(lines: DataFrame, min_share: float = 0.2) -> DataFrame:
    """(book, key, n_pages): margin lines on enough of a book's pages, or on a regular stretch of them."""
    heading = F.coalesce(F.col("heading"), F.lit(False)) if "heading" in lines.columns else F.lit(False)
    keyed = lines.select("book", "page", T.margin_key(F.col("text")).alias("key"), heading.alias("heading"), in_margin().alias("margin"))
    pages = lines.groupBy("book").agg(F.countDistinct("page").alias("pages"))
    titles = keyed.where("heading").select("book", "key", F.lit(2).alias("title_need")).distinct()
    seen = keyed.where("not heading and margin and length(key) >= 3").groupBy("book", "key").agg(F.countDistinct("page").alias("n_pages"), F.min("page").alias("lo"), F.max("page").alias("hi"))
    out = seen.join(pages, "book").join(titles, ["book", "key"], "left")
    regular = (F.col("n_pages") >= F.coalesce("title_need", F.lit(3))) & (2 * (F.col("hi") - F.col("lo")) <= 5 * (F.col("n_pages") - 1))
    return out.where((F.col("n_pages") >= F.greatest(F.lit(3.0), min_share * F.col("pages"))) | regular).select("book", "key", "n_pages")


def without_headers(lines: DataFrame, min_share: float = 0.2, variants: bool = False, least_conf: float | None = None) -> DataFrame:
    """Lines that aren't running headers in a margin, variants of headers included on request, nor margin lines of less
    confidence than least_conf. Lines with a true `heading` stay."""
    from folianth.operators.front import header_keys

    free = F.coalesce(F.col("heading"), F.lit(False)) if "heading" in lines.columns else F.lit(False)
    keyed = lines.withColumn("key", F.when(in_margin() & ~free, T.margin_key(F.col("text"))))
    if least_conf is not None:
        keyed = keyed.where(~F.coalesce(F.col("key").isNotNull() & (F.col("conf") < least_conf), F.lit(False)))
    headers = header_keys(lines, min_share) if variants else running_headers(lines, min_share)
    # a book has few headers; without them in memory, all lines would be dealt by book and key
    return keyed.join(F.broadcast(headers.select("book", "key")), ["book", "key"], "left_anti").drop("key")


def confidence(lines: DataFrame) -> DataFrame:
    """(book, pages, sum and count by line): the book's mean is the mean of its pages' means."""
    page = lines.groupBy("book", "page").agg(F.avg("conf").alias("mean_conf"), F.count("conf").alias("n"))
    return page.groupBy("book").agg(F.count("*").alias("pages"), F.sum("n").alias("n_lines"), F.round(F.avg("mean_conf"), 6).alias("mean_conf"), F.count_if(F.col("mean_conf") < 70).alias("low_pages"))


def ranked(rows: DataFrame, value: str) -> DataFrame:
    """(book, value, upto, before, total): the distinct values of each book with the ranks they take, counted before they
    are ordered, so that no task holds a book's rows."""
    whole = Window.partitionBy("book")
    counts = rows.groupBy("book", value).agg(F.count("*").alias("times"))
    upto = F.sum("times").over(whole.orderBy(value))
    return counts.select("book", value, upto.alias("upto"), (upto - F.col("times")).alias("before"), F.sum("times").over(whole).alias("total"))


def at_rank(value: str, rank: str) -> Column:
    """The value of this rank from 1, as an aggregate over ranked rows."""
    return F.max(F.when(F.expr(f"before < {rank} and {rank} <= upto"), F.col(value)))


def exclusive_twentieth(rows: DataFrame, value: str, i: int, least: int = 20) -> DataFrame:
    """(book, value): cut point i of 20 by the exclusive method, of books with at least so many rows."""
    at = f"greatest(1, least(total - 1, {i} * (total + 1) div 20))"
    part = f"({i} * (total + 1) - 20 * {at})"
    cut = ranked(rows, value).where(F.col("total") >= least).groupBy("book", "total").agg(at_rank(value, at).alias("lo"), at_rank(value, f"({at} + 1)").alias("hi"))
    return cut.select("book", F.expr(f"(lo * (20 - {part}) + hi * {part}) / 20.0").alias(value))


def margins(lines: DataFrame) -> DataFrame:
    """(book, left, right): 5th percentile of left and 95th of right edges, in page widths, of books of 20 lines or more."""
    edges = lines.where("width > 0").select("book", (F.col("x0") / F.col("width")).alias("left"), (F.col("x1") / F.col("width")).alias("right"))
    return exclusive_twentieth(edges, "left", 1).join(exclusive_twentieth(edges, "right", 19), "book")


def line_pitch(lines: DataFrame) -> DataFrame:
    """(book, gaps, pitch): median distance of consecutive tops; null with fewer than 20."""
    order = Window.partitionBy("book", "page").orderBy("line_no")
    gaps = lines.select("book", (F.lead("y0").over(order) - F.col("y0")).alias("gap")).where("gap > 0")
    return gaps.groupBy("book").agg(F.count("*").alias("gaps"), F.median("gap").alias("m")).select("book", "gaps", F.when(F.col("gaps") >= 20, F.col("m")).alias("pitch"))


def sparse_pages(lines: DataFrame, share: float = 0.25) -> DataFrame:
    """(book, page, words, sparse): pages with few words for their book."""
    words = F.when(F.trim("text") == "", 0).otherwise(F.greatest(F.lit(1), F.regexp_count("text", F.lit("\\S+"))))
    page = lines.groupBy("book", "page").agg(F.sum(words).alias("words"))
    middle = at_rank("words", "(total div 2 + 1)").alias("middle")
    typical = ranked(page.where("words > 0"), "words").groupBy("book", "total").agg(middle).where("total >= 3").select("book", F.col("middle").alias("typical"))
    return page.join(typical, "book", "left").select("book", "page", "words", F.coalesce(F.col("words") < share * F.col("typical"), F.lit(False)).alias("sparse"))


def page_kind(area: Column, chars: Column) -> Column:
    return F.when((area >= 0.6) | ((area >= 0.2) & (chars < 200)), "scan").otherwise("exported")


def document_type(pages: DataFrame) -> DataFrame:
    """(book, scans, exported, kind, dpi) of pages (book, page, area, chars, dpi)."""
    kinds = pages.withColumn("kind", page_kind(F.col("area"), F.col("chars")))
    out = kinds.groupBy("book").agg(F.count_if(F.col("kind") == "scan").alias("scans"), F.count_if(F.col("kind") != "scan").alias("exported"), F.floor(F.median(F.when(F.col("kind") == "scan", F.col("dpi")))).alias("dpi"))
    return out.select("book", "scans", "exported", F.when(F.col("scans") >= F.col("exported"), "scan").otherwise("exported").alias("kind"), "dpi")


def majority(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, answers, found): the value that more than half of the non-null answers give."""
    n = rows.where(F.col(value).isNotNull()).groupBy(key, value).count()
    best = n.groupBy(key).agg(F.sum("count").alias("answers"), F.max(F.struct("count", value)).alias("best"))
    return best.select(key, "answers", F.when(2 * F.col("best.count") > F.col("answers"), F.col(f"best.{value}")).alias("found"))


def word_counts(lines: DataFrame) -> DataFrame:
    """(word, n): comparison forms of all words, "" for those without a letter."""
    raw = lines.select(F.explode(F.split("text", "\\s+")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    # different words only are brought into their form: what is asked of a form can't be asked before words are counted
    forms = raw.select(F.when(F.col("n") > 0, T.comparison_form(F.col("w"))).otherwise("").alias("word"), "n")
    return forms.groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(lines: DataFrame, least: int = 3) -> DataFrame:
    """(word, n): comparison forms of the words that occur often enough."""
    return word_counts(lines).where((F.col("word") != "") & (F.col("n") >= least))


def comma_counts(lines: DataFrame) -> DataFrame:
    """(book, closing, hamza, commas): counts that tell whether commas are misread."""
    count = lambda p: F.sum(F.regexp_count("text", F.lit(p))).alias
    return lines.groupBy("book").agg(count("»")("closing"), count("ء")("hamza"), count("،")("commas"))


def latest_runs(runs: DataFrame) -> DataFrame:
    """The last run of each reader: (reader, ts, run_id, value, n_runs)."""
    best = runs.groupBy("reader").agg(F.max(F.struct("ts", "run_id", "value")).alias("r"), F.count("*").alias("n_runs"))
    return best.select("reader", F.col("r.ts").alias("ts"), F.col("r.run_id").alias("run_id"), F.col("r.value").alias("value"), "n_runs")


def page_report(lines: DataFrame) -> DataFrame:
    """(book, pages, lines, chars, low_lines, first_page, last_page) for a conversion report."""
    return lines.groupBy("book").agg(F.countDistinct("page").alias("pages"), F.count("*").alias("lines"), F.sum(F.length("text")).alias("chars"), F.count_if(F.col("conf") < 60).alias("low_lines"), F.min("page").alias("first_page"), F.max("page").alias("last_page"))
