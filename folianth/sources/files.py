"""Files of books: containers, saved pages, word lists, sets of checked lines, editions and scorecards, both ways."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folianth.functions import text as T

PAGE = "number int, route string, width int, height int, lines array<struct<text:string, bbox:array<int>, conf:double, heading:boolean>>, settings map<string,string>, seconds double"
DECISION = "struct<status:string, text:string, saved:string, by:string>"
LINE = "id string, page int, split string, rules int, box array<int>, ocr string, start string, prefilled boolean, hint string, words array<struct<t:string, conf:int, x0:int, x1:int, y0:int, y1:int, flag:boolean, sugg:array<string>>>"
EDITION = "chapters array<struct<line:string, title:string>>, drop array<string>, replace array<struct<pattern:string, `with`:string>>, quotes string, title string, author string"
RUN = "date string, engine string, reader string, lines struct<`set`:string, data:string, lines:int, letters_wrong:double, exact:int, spacing_wrong:double, seconds_a_line:double>, pages struct<pages:array<int>, lines:int, letters_wrong:double, spacing_wrong:double, lines_missing:int, lines_extra:int, joined_split:int, reader:string, seconds_a_page:double>, exported struct<pdf:string, pages:int, letters_wrong:double, spacing_wrong:double, joined_split:int, reader:string, seconds_a_page:double>, memory_mb int, image_mb int, commit string"


def book_digests(files: DataFrame, namespace: str = "book:") -> DataFrame:
    """(path, digest, book_id) of files (path, content), such as spark.read.format("binaryFile") gives: the content's
    SHA-256 and a stable id made of it."""

    @F.pandas_udf("string")
    def ident(x: pd.Series) -> pd.Series:
        return x.map(lambda d: None if d is None else str(uuid.uuid5(uuid.NAMESPACE_URL, namespace + d)))

    return files.select("path", F.sha2("content", 256).alias("digest")).withColumn("book_id", ident("digest"))


def page_info(images: DataFrame) -> DataFrame:
    """(book, page, area, chars, dpi) of embedded images (book, page, x0..y1, dpi, page_width, page_height, text): the
    images' share of the page, 1 at most, letters of the text layer, and the largest image's resolution."""
    size = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    page = F.max("page_width") * F.max("page_height")
    letters = F.max(F.regexp_count("text", F.lit("[\\x{0600}-\\x{06FF}\\x{FB50}-\\x{FDFF}\\x{FE70}-\\x{FEFF}]")))
    return images.groupBy("book", "page").agg(F.least(F.lit(1.0), F.sum(size) / page).alias("area"), F.coalesce(letters, F.lit(0)).alias("chars"), F.max_by("dpi", size).alias("dpi"))


def saved_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row a saved page: number, route, width, height, lines, settings, seconds."""
    return spark.read.schema(PAGE).option("multiLine", True).json(path)


def split_hits(wanted: DataFrame, saved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Saved pages (number, settings, ...) that were asked for (number, settings) with the same settings, and the rest
    of what was asked. Maps can't be join keys, so settings meet as sorted entries."""
    entries = lambda c: F.array_sort(F.map_entries(c))
    w, s = wanted.withColumn("_s", entries(F.col("settings"))), saved.withColumn("_s", entries(F.col("settings")))
    return s.join(w.select("number", "_s"), ["number", "_s"], "left_semi").drop("_s"), w.join(s.select("number", "_s"), ["number", "_s"], "left_anti").drop("_s")


def save_pages(pages: DataFrame, path: str) -> None:
    """Append pages as JSON, a folder a page number, so that a number can be read alone."""
    pages.withColumn("page", F.col("number")).write.mode("append").partitionBy("page").json(path)


def reader_words(tsv: DataFrame) -> DataFrame:
    """(page, line_no, word_no, text, x0..y1, conf) of a page reader's tables (page, level, block, par, line, word, left,
    top, width, height, conf, text): level 4 gives the order of lines, level 5 the words; blank words and lines go."""
    place = Window.partitionBy("page").orderBy("seq")
    line = tsv.where("level = 4").withColumn("line_no", F.row_number().over(place)).select("page", "block", "par", "line", "line_no")
    words = tsv.where("level = 5 and trim(text) <> ''").join(line, ["page", "block", "par", "line"])
    return words.select("page", "line_no", F.col("word").alias("word_no"), F.trim("text").alias("text"), F.col("left").alias("x0"), F.col("top").alias("y0"), (F.col("left") + F.col("width")).alias("x1"), (F.col("top") + F.col("height")).alias("y1"), "conf")


def parse_table(rows: DataFrame) -> DataFrame:
    """Rows (page, seq, row) of a page reader's tab-separated output, its head left out, as columns for reader_words."""
    names = ("level", "page_num", "block", "par", "line", "word", "left", "top", "width", "height", "conf", "text")
    cells = T.computed(rows, "c", F.split("row", "\t", 12)).where(F.col("c")[0] != "level")
    kind = lambda n: "double" if n == "conf" else "string" if n == "text" else "int"
    return cells.select("page", "seq", *[F.coalesce(F.col("c")[i].cast(kind(n)), F.lit("" if n == "text" else 0)).alias(n) for i, n in enumerate(names)])


def word_list(spark: SparkSession, path: str, optional: bool = False) -> DataFrame:
    """(word) of a text file of words; an optional list that isn't there is empty."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.text(path)
    except AnalysisException:
        if not optional:
            raise
        return spark.createDataFrame([], "word string")
    return rows.select(F.explode(F.split("value", "\\s+")).alias("word")).where("word <> ''").distinct()


def book_words(pages: DataFrame) -> DataFrame:
    """(word) of all lines of saved pages."""
    return pages.select(F.explode("lines").alias("l")).select(F.explode(F.split("l.text", "\\s+")).alias("word")).where("word <> ''")


def set_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a set's index."""
    index = spark.read.schema(f"lines array<struct<{', '.join(x.replace(' ', ':', 1) for x in _columns(LINE))}>>").option("multiLine", True).json(path)
    return index.select(F.explode("lines").alias("l")).select("l.*")


def _columns(ddl: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, c in enumerate(ddl):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(ddl[at:i].strip())
            at = i + 1
    return [*out, ddl[at:].strip()]


def decisions(texts: DataFrame) -> DataFrame:
    """(id, status, text, saved, by) of review files (value), each one object from ids to decisions."""
    return texts.select(F.explode(F.from_json("value", f"map<string,{DECISION}>")).alias("id", "d")).select("id", "d.*")


def edition(texts: DataFrame) -> DataFrame:
    """One row an edition file (value): chapters, drop, replace, quotes, title, author."""
    return texts.select(F.from_json("value", EDITION).alias("e")).select("e.*")


def runs(texts: DataFrame) -> DataFrame:
    """Scorecard rows (value), an object a line, blank lines left out, missing fields null."""
    return texts.where("trim(value) <> ''").select(F.from_json("value", RUN).alias("r")).select("r.*")


def append_runs(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def json_lines(rows: DataFrame) -> DataFrame:
    """(value): each row as an object, as reports and indexes are written."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def progress(pages: DataFrame) -> DataFrame:
    """(book, seq, event): a start, an event a page in order, and an end, as objects. pages: book, page, cached."""
    order = Window.partitionBy("book").orderBy("page")
    total = F.count("*").over(Window.partitionBy("book"))
    each = pages.withColumns({"done": F.row_number().over(order), "total": total})
    event = F.to_json(F.struct(F.lit("page").alias("event"), "page", "done", "total", "cached"))
    ends = pages.groupBy("book").agg(F.count("*").alias("n"))
    first = ends.select("book", F.lit(0).alias("seq"), F.to_json(F.struct(F.lit("start").alias("event"), F.col("n").alias("pages"))).alias("event"))
    last = ends.select("book", (F.col("n") + 1).cast("int").alias("seq"), F.to_json(F.struct(F.lit("done").alias("event"), F.lit(True).alias("ok"))).alias("event"))
    return each.select("book", F.col("done").alias("seq"), event.alias("event")).unionByName(first).unionByName(last)


def in_order(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """rows (number, ...) in the order in which they were asked for (pos, number)."""
    return rows.join(wanted.select("pos", "number"), "number").orderBy("pos")


