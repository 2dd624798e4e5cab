"""Books, pages and lines as DataFrames, and a stand-in for them made from a table of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE_JSON = "number int, route string, width int, height int, lines array<struct<text:string, bbox:array<int>, conf:double, heading:boolean, id:string>>, settings map<string,string>, seconds double"


def document_lines(docs: DataFrame) -> DataFrame:
    """A source is a book, a document a page, a text line a line with made-up geometry and confidence."""
    parts = docs.select(F.col("source").alias("book"), F.col("doc_id").alias("page"), F.split("text", "\n", -1).alias("parts"))
    rows = parts.select("book", "page", F.size("parts").alias("n"), F.posexplode("parts").alias("line_no", "text"))
    size = F.length("text")
    return rows.select(
        "book", "page", "line_no", "text",
        (F.lit(900) - F.least(F.lit(800), 12 * size)).alias("x0"), (40 + 60 * F.col("line_no")).alias("y0"), F.lit(900).alias("x1"), (80 + 60 * F.col("line_no")).alias("y1"),
        F.lit(1000).alias("width"), F.greatest(F.lit(1400), 140 + 60 * F.col("n")).alias("height"),
        (40 + F.pmod(size * 7 + F.col("line_no") * 13, F.lit(61))).cast("int").alias("conf"),
    )


#: The same for DuckDB, as the head of a query.
LINES_SQL = """WITH parts AS (SELECT source AS book, doc_id AS page, string_split(text, chr(10)) AS parts FROM documents),
numbered AS (SELECT book, page, parts, unnest(range(0, len(parts))) AS i FROM parts),
lines AS (SELECT book, page, CAST(i AS INTEGER) AS line_no, parts[i + 1] AS text, CAST(900 - least(800, 12 * length(parts[i + 1])) AS INTEGER) AS x0,
  CAST(40 + 60 * i AS INTEGER) AS y0, 900 AS x1, CAST(80 + 60 * i AS INTEGER) AS y1, 1000 AS width, CAST(greatest(1400, 140 + 60 * len(parts)) AS INTEGER) AS height,
  CAST(40 + (length(parts[i + 1]) * 7 + i * 13) % 61 AS INTEGER) AS conf FROM numbered)"""


def read_pages(spark, path: str) -> DataFrame:
    """Saved pages, one JSON object a file, as lines; fields that aren't known are ignored."""
    pages = spark.read.schema(PAGE_JSON).option("multiLine", True).json(path)
    rows = pages.select(F.col("number").alias("page"), "width", "height", F.posexplode("lines").alias("line_no", "l"))
    box = [F.col("l.bbox")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))]
    return rows.select(F.lit("").alias("book"), "page", "line_no", F.col("l.text").alias("text"), *box, "width", "height", F.col("l.conf").alias("conf"), F.coalesce("l.heading", F.lit(False)).alias("heading"), F.col("l.id").alias("line_id"))


def page_todo(wanted: DataFrame, cached: DataFrame) -> DataFrame:
    """Pages that aren't in the cache with the same settings."""
    return wanted.join(cached, (wanted.page == cached.page) & wanted.settings.eqNullSafe(cached.settings), "left_anti")


def page_set(spec, total):
    """Distinct page numbers of a selector such as 1-20,35, within 1..total, ascending."""
    parts = F.transform(F.split(spec, ","), lambda p: F.sequence(F.split(p, "-")[0].cast("int"), F.element_at(F.split(p, "-"), -1).cast("int")))
    return F.array_sort(F.array_distinct(F.filter(F.flatten(parts), lambda x: (x >= 1) & (x <= total))))


def marked_pages(rows: DataFrame) -> DataFrame:
    """Text rows (doc, pos, text) under markers `===== page N =====`: the page of each row, without the markers."""
    from pyspark.sql.window import Window

    number = F.when(F.col("text").rlike("^===== page [0-9]+"), F.regexp_extract("text", "^===== page ([0-9]+)", 1).cast("int"))
    order = Window.partitionBy("doc").orderBy("pos")
    out = rows.withColumn("mark", number).withColumn("page", F.last("mark", ignorenulls=True).over(order))
    return out.where("mark is null and page is not null").select("doc", "page", "pos", F.regexp_replace("text", "^## ", "").alias("text"))
