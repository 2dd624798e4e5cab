"""Sets of checked lines: words and boxes, flags, starting texts, decisions, bookkeeping; readers and their routing."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folianth.functions import text as T
from folianth.operators.evaluate import similarity
from folianth.operators.joins import known_words, suggestions

# Fixed values, in pixels at 300 dpi, percent and numbers.
LEAST_HEIGHT, MOST_HEIGHT, PAD_X, PAD_Y, FLAG_CONF, LOW_MEAN, LOW_PAGE, LOW_DPI = 12, 400, 16, 8, 60, 70, 80, 200


def match_key(s: Column) -> Column:
    """Letters in comparison form and then the digits, in Persian."""
    # without Latin letters all digits become Persian, so that the rest of the text can go first
    asked = F.when(s.rlike("[A-Za-z]"), s).otherwise(F.regexp_replace(s, "[^\\p{Nd}]+", ""))
    return F.concat(T.comparison_form(s), F.regexp_replace(T.persian_digits(asked), "[^0-9۰-۹٠-٩]+", ""))


def clean_word(s: Column) -> Column:
    return T.normalize_text(T.persian_digits(s))


def crop_boxes(words: DataFrame) -> DataFrame:
    """(page, line_no, x0, y0, x1, y1): the box of each line's words with a margin, within the page. words: page,
    line_no, x0..y1, width, height."""
    box = words.groupBy("page", "line_no").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.max("width").alias("width"), F.max("height").alias("height"))
    pad = F.greatest(F.lit(PAD_Y), F.floor((F.col("y1") - F.col("y0")) / 6)).cast("int")
    return box.select("page", "line_no", F.greatest(F.lit(0), F.col("x0") - PAD_X).alias("x0"), F.greatest(F.lit(0), F.col("y0") - pad).alias("y0"), F.least(F.col("width"), F.col("x1") + PAD_X).alias("x1"), F.least(F.col("height"), F.col("y1") + pad).alias("y1"))


def line_height_fits(y0: Column, y1: Column, dpi: int = 300) -> Column:
    """Neither a speck nor a picture."""
    return (y1 - y0).between(LEAST_HEIGHT * dpi / 300, MOST_HEIGHT * dpi / 300)


def has_letters(s: Column) -> Column:
    return s.rlike("[\\x{0600}-\\x{06FF}0-9]")


def words_inside(words: DataFrame) -> DataFrame:
    """Word boxes within their line's box; a line of which none is left is one box itself.

    words: page, line_no, x0..y1 and the line's lx0..ly1."""
    inside = F.expr("lx0 <= x0 and ly0 <= y0 and x1 <= lx1 and y1 <= ly1")
    good = words.where(inside).select("page", "line_no", "x0", "y0", "x1", "y1")
    lines = words.where("lx1 > lx0").select("page", "line_no", F.col("lx0").alias("x0"), F.col("ly0").alias("y0"), F.col("lx1").alias("x1"), F.col("ly1").alias("y1")).distinct()
    return good.unionByName(lines.join(good, ["page", "line_no"], "left_anti"))


def lines_of_words(words: DataFrame) -> DataFrame:
    """(page, line_no, text, conf, x0..y1): words in their order as lines, with the mean confidence. words: page,
    line_no, word_no, text, conf, x0..y1."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_no", "text"))), lambda e: e["text"]), " ")
    return words.groupBy("page", "line_no").agg(text.alias("text"), F.bround(F.avg("conf"), 1).alias("conf"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def flagged_words(words: DataFrame, lexicon: DataFrame, limit: int = 5) -> DataFrame:
    """words (page, line_no, word_no, text, conf) with flag and sugg: a word is flagged that was read badly or that the
    lexicon (word, n, common) doesn't know; each different form is looked up once."""
    forms = words.withColumn("word", T.comparison_form(F.col("text")))
    asked = forms.where("word <> ''").select("word").distinct()
    known = known_words(asked, lexicon)
    sugg = suggestions(asked, lexicon, limit).groupBy("word").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "suggestion"))), lambda e: e["suggestion"]).alias("sugg"))
    x = forms.join(known, "word", "left").join(sugg, "word", "left")
    flag = (F.col("conf") < FLAG_CONF) | ((F.col("word") != "") & ~F.coalesce("known", F.lit(False)))
    none = F.array().cast("array<string>")
    return x.withColumn("flag", flag).withColumn("sugg", F.when(flag, F.coalesce("sugg", none)).otherwise(none)).drop("word", "known")


def prefilled(lines: DataFrame, checked: DataFrame, least: float = 0.6) -> DataFrame:
    """(page, line_no, text, start): the page's checked text most like each line, where one is like enough; of equal
    ones the greater text. lines: page, line_no, text; checked: page, text."""
    asked = lines.withColumn("key", match_key(F.col("text")))
    near = asked.where("key <> ''").select("page", "line_no", "key").join(checked.select("page", F.col("text").alias("start")), "page")
    near = near.withColumn("ratio", similarity(F.col("key"), match_key(F.col("start"))))
    best = near.groupBy("page", "line_no").agg(F.max(F.struct("ratio", "start")).alias("b")).where(F.col("b.ratio") >= least)
    return asked.drop("key").join(best, ["page", "line_no"], "left").select("page", "line_no", "text", F.col("b.start").alias("start"))


def set_index(kept: DataFrame, new: DataFrame) -> DataFrame:
    """Lines of a set after some pages were cut anew: those pages' old lines go, the rest stays; test lines first, then
    by page and id. Both: line_id, page, split and more."""
    old = kept.join(new.select("page").distinct(), "page", "left_anti").select(*new.columns)
    place = Window.orderBy(F.col("split") != "test", "page", "line_id")
    return old.unionByName(new).withColumn("place", F.row_number().over(place))


def set_counts(lines: DataFrame) -> DataFrame:
    """(page, found, flagged): lines of each page and flagged words in them. lines: page, flags (array<boolean>)."""
    return lines.groupBy("page").agg(F.count("*").alias("found"), F.sum(F.size(F.filter("flags", lambda x: x))).alias("flagged"))


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """One row: checked lines that are kept, to be checked again, and lost."""
    n = lambda v: F.count_if(F.col("outcome") == v).alias(v)
    return outcomes.agg(n("kept"), n("recheck"), n("lost"))


def replaced(text: Column, changes: list[tuple[str, str]]) -> Column:
    """struct<text, n>: regular expressions replaced one after another, and how often in all."""
    n = F.lit(0)
    for pattern, new in changes:
        n = n + F.regexp_count(text, F.lit(pattern))
        text = F.regexp_replace(text, pattern, new)
    return F.struct(text.alias("text"), n.alias("n"))


def reader_for(choice: Column, document: Column, scan_reader: str = "line", whole: str = "page") -> Column:
    """The reader of a document: the one chosen, or for auto a line reader for scans and whole pages otherwise."""
    return F.when(choice != "auto", choice).when(document == "scan", scan_reader).otherwise(whole)


def described(setting: Column, engine: Column, languages: Column) -> Column:
    """struct<lines_found_by, read_by>: what found and read the lines."""
    name = F.concat_ws(" ", engine, languages)
    read = F.when(setting == "page", F.concat(name, F.lit(", whole pages"))).when(setting == "engine", name).otherwise(setting)
    return F.struct(name.alias("lines_found_by"), read.alias("read_by"))


def confidence_message(mean: Column) -> Column:
    return F.when(mean < LOW_MEAN, F.format_string("Low reading confidence (%.0f, usually 80-87): expect many misread letters.", mean))


def document_message(kind: Column, pages: Column, scans: Column, dpi: Column) -> Column:
    low = F.when(dpi < LOW_DPI, F.format_string(" Below %d dpi, expect many misread letters.", F.lit(LOW_DPI))).otherwise("")
    at = F.when(dpi > 0, F.format_string(", about %d dpi", dpi)).otherwise("")
    return F.when(kind == "exported", F.format_string("Exported document (%d pages).", pages)).otherwise(F.concat(F.format_string("Scanned book (%d of %d pages are images", scans, pages), at, F.lit(")."), low))


def script_mismatch(expected: Column, found: Column) -> Column:
    """Both known and different; unknown is no mismatch."""
    return F.coalesce(expected != found, F.lit(False))


def low_pages(pages: DataFrame) -> DataFrame:
    """(book, pages): numbers of pages whose mean confidence is under 80, ascending. pages: book, page, mean_conf."""
    rows = pages.where(F.col("mean_conf") < LOW_PAGE)
    return rows.groupBy("book").agg(F.array_sort(F.collect_list("page")).alias("pages"))


def script_check(answers: DataFrame, enough: int = 3) -> DataFrame:
    """(book, asked, found): answers (book, nth, script) in their order until three are known or two agree; the script
    that more than half of the known answers name. A book has at most six answers."""
    order = Window.partitionBy("book").orderBy("nth")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    alike = F.count("script").over(Window.partitionBy("book", "script").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    x = answers.withColumn("known", F.count("script").over(upto)).withColumn("alike", F.when(F.col("script").isNotNull(), alike).otherwise(0))
    decided = ((F.col("known") >= enough) | (2 * F.max("alike").over(upto) > enough)).cast("int")
    x = x.withColumn("decided", decided)
    x = x.withColumn("before", F.coalesce(F.lag("decided").over(order), F.lit(0))).where("before = 0")
    n = x.groupBy("book", "script").agg(F.count("*").alias("n"))
    best = n.groupBy("book").agg(F.sum("n").alias("asked"), F.sum(F.when(F.col("script").isNotNull(), F.col("n"))).alias("known"), F.max(F.when(F.col("script").isNotNull(), F.struct("n", "script"))).alias("best"))
    return best.select("book", "asked", F.when(2 * F.col("best.n") > F.col("known"), F.col("best.script")).alias("found"))


def sample_pages(numbers: list[int], seed: str, tries: int = 6) -> list[int]:
    """Up to `tries` pages of the middle eight tenths, the same for the same seed."""
    import random

    tenth = len(numbers) // 10
    middle = numbers[tenth : len(numbers) - tenth] or list(numbers)
    return random.Random(seed).sample(middle, min(tries, len(middle)))


def otsu(levels: DataFrame) -> DataFrame:
    """(image, threshold) of grey levels (image, level, n): the first level that parts the pixels best, 128 for one
    level only. Between-class variance from running sums over at most 256 levels an image."""
    upto = Window.partitionBy("image").orderBy("level").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("image")
    x = levels.groupBy("image", "level").agg(F.sum("n").alias("n"))
    x = x.withColumns({"w": F.sum("n").over(upto).cast("double"), "s": F.sum(F.col("n") * F.col("level")).over(upto).cast("double"), "all": F.sum("n").over(whole).cast("double"), "sum": F.sum(F.col("n") * F.col("level")).over(whole).cast("double")})
    apart = F.col("s") / F.col("w") - F.try_divide(F.col("sum") - F.col("s"), F.col("all") - F.col("w"))
    x = x.withColumn("v", F.when(F.col("w") < F.col("all"), F.col("w") * (F.col("all") - F.col("w")) * apart * apart))
    best = x.groupBy("image").agg(F.min_by("level", F.when(F.col("v") > 0, F.struct(-F.col("v"), "level"))).alias("t"))
    return best.select("image", F.coalesce("t", F.lit(128)).cast("int").alias("threshold"))


def prepared(image: np.ndarray, crop: float = 0.0, threshold: int | None = None) -> np.ndarray:
    """A grey page without its edges (a share of the width, four fifths of it of the height), black and white."""
    h, w = image.shape
    dx, dy = (int(w * crop), int(h * crop * 0.8)) if crop > 0 else (0, 0)
    out = image[dy : h - dy, dx : w - dx]
    return out if threshold is None else np.where(out > threshold, 255, 0).astype(np.uint8)


class Reader(Protocol):
    """Reads one line's image: its text in reading order and a confidence from 0 to 100, or none."""

    name: str

    def read(self, image: bytes) -> tuple[str, float | None]: ...


_READERS: dict[str, Callable[[], Reader]] = {}


def register(name: str, make: Callable[[], Reader]) -> None:
    """Make a reader known; `make` runs once in each Python worker that reads with it."""
    _READERS[name] = make


def read_images(images: DataFrame, name: str) -> DataFrame:
    """(page, line_no, text, conf) of line images (page, line_no, image) by a registered reader; blank lines go."""
    if name not in _READERS:
        raise ValueError(f"unknown reader {name!r}: one of {', '.join(sorted(_READERS)) or 'none'}")
    make = _READERS[name]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = make()
        for b in batches:
            out = [reader.read(x) for x in b["image"]]
            yield pd.DataFrame({"page": b["page"], "line_no": b["line_no"], "text": [t for t, _ in out], "conf": [c for _, c in out]})

    read = images.select("page", "line_no", "image").mapInPandas(run, "page long, line_no int, text string, conf double")
    return read.where("trim(text) <> ''")
