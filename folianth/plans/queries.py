"""Queries over the operators of books, pages and lines, each with the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folianth.functions import text as T
from folianth.operators import book as B
from folianth.operators import evaluate as E
from folianth.operators import headings as H
from folianth.operators import joins as J
from folianth.operators import sequence as S
from folianth.sources.bridge import LINES_SQL, document_lines, marked_pages, page_set

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def lines(spark: SparkSession, d: str) -> DataFrame:
    return document_lines(table(spark, d, "documents"))


def fa(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a Persian stand-in for their text."""
    return table(spark, d, "documents").select("doc_id", T.stand_in(F.col("text")).alias("s"))


FA = f"WITH fa AS (SELECT doc_id, translate(lower(text), '{T.LATIN}', '{T.STAND_IN}') AS s FROM documents)"
_SHAPES_FROM, _SHAPES_TO = "".join(T.SHAPES.values()), "".join(k * len(v) for k, v in T.SHAPES.items())
_FORM = "regexp_replace(regexp_replace(translate({0}, 'يىك', 'ییک'), '[\\x{{064B}}-\\x{{065F}}\\x{{0670}}\\x{{0640}}\\x{{200c}}\\x{{200d}}]', '', 'g'), '[^\\x{{0621}}-\\x{{063A}}\\x{{0641}}-\\x{{064A}}پچژکگیۀ]', '', 'g')"
_KEY = "lower(regexp_replace({0}, '\\p{{Nd}}|[^\\p{{L}}\\p{{N}}]', '', 'g'))"
_NORMAL = "trim(regexp_replace(translate({0}, 'يىكـ', 'ییک'), '[ \\t\\x{{00A0}}]+', ' ', 'g'), ' ')"
_COMMAS = "trim(regexp_replace(regexp_replace(regexp_replace({0}, '\\s*،[\\s\\x{{200c}}]*', '، ', 'g'), '،(?:\\s*،)+', '،', 'g'), ' {{2,}}', ' ', 'g'), ' ')"
_CLOSE = "regexp_replace(regexp_replace({0}, '[ \\t\\x{{200c}}]+([.؛:؟!»?;])', '\\1', 'g'), '«[ \\t\\x{{200c}}]+', '«', 'g')"
_MARGIN = "(height > 0 AND ((y0 + y1) * 50 < 15 * height OR (y0 + y1) * 50 > 85 * height))"


@query(f"{FA} SELECT doc_id, {_NORMAL.format('s')} AS s FROM fa")
def p01_normalize_text(spark, d):
    return fa(spark, d).select("doc_id", T.normalize_text(F.col("s")).alias("s"))


@query(f"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '(\\s+|\\S+)') AS t FROM documents)
SELECT doc_id, array_to_string(list_transform(t, lambda x: CASE WHEN regexp_matches(x, '[A-Za-z]') THEN x ELSE translate(x, '{T.LATIN_DIGITS + T.ARABIC_DIGITS}', '{T.PERSIAN_DIGITS * 2}') END), '') AS s FROM w""")
def p03_digits(spark, d):
    return table(spark, d, "documents").select("doc_id", T.persian_digits(F.col("text")).alias("s"))


@query(f"{FA} SELECT doc_id, {_COMMAS.format('replace(s, chr(44), chr(1548))')} AS s FROM fa")
def p05_space_commas(spark, d):
    return fa(spark, d).select("doc_id", T.space_commas(F.replace("s", F.lit(","), F.lit("،"))).alias("s"))


@query()
def p06_latin_commas(spark, d):
    return fa(spark, d).select("doc_id", T.latin_commas(F.col("s")).alias("s"))


@query(f"{FA} SELECT doc_id, {_CLOSE.format('s')} AS s FROM (SELECT doc_id, replace(s, '.', ' .') AS s FROM fa)")
def p07_close_marks(spark, d):
    return fa(spark, d).select("doc_id", T.close_marks(F.replace("s", F.lit("."), F.lit(" ."))).alias("s"))


@query(f"{LINES_SQL} SELECT page, line_no, {_KEY.format('text')} AS key FROM lines")
def p08_margin_key(spark, d):
    return lines(spark, d).select("page", "line_no", T.margin_key(F.col("text")).alias("key"))


@query(f"{FA} SELECT doc_id, regexp_replace(translate(s, 'يىكـ', 'ییک'), '[^\\x{{0621}}-\\x{{064A}}\\x{{067E}}-\\x{{06D3}}]', '', 'g') AS letters, {_FORM.format('s')} AS form FROM fa")
def p09_letter_forms(spark, d):
    return fa(spark, d).select("doc_id", T.persian_letters(F.col("s")).alias("letters"), T.comparison_form(F.col("s")).alias("form"))


@query(f"{FA} SELECT doc_id, translate({_FORM.format('s')}, '{_SHAPES_FROM}', '{_SHAPES_TO}') AS skel FROM fa")
def p11_skeleton(spark, d):
    return fa(spark, d).select("doc_id", T.skeleton(F.col("s")).alias("skel"))


_WORDS = "w AS (SELECT DISTINCT unnest(string_split_regex(text, '\\s+')) AS word FROM benchmark)"


@query(f"WITH {_WORDS} SELECT word, array_to_string(list_sort(list_distinct(list_transform(range(1, length(word) + 1), lambda i: substr(word, 1, i - 1) || substr(word, i + 1)))), '|') AS cuts FROM w WHERE word <> ''")
def p12_deletes(spark, d):
    words = table(spark, d, "benchmark").select(F.explode(F.split("text", "\\s+")).alias("word")).distinct().where("word <> ''")
    return words.select("word", F.array_join(F.array_sort(T.deletes(F.col("word"))), "|").alias("cuts"))


@query(f"WITH {_WORDS} SELECT a.word, CAST(CASE WHEN levenshtein(a.word, 'than') > 2 THEN 3 ELSE levenshtein(a.word, 'than') END AS INTEGER) AS distance FROM w a")
def p20_edit_distance(spark, d):
    words = table(spark, d, "benchmark").select(F.explode(F.split("text", "\\s+")).alias("word")).distinct()
    return words.select("word", T.edit_distance(F.col("word"), F.lit("than"), 2).cast("int").alias("distance"))


@query(f"""{LINES_SQL}, o AS (SELECT page, line_no, x0, y0 + 15 AS y0, x1, y1 + 15 AS y1 FROM lines),
p AS (SELECT a.page, a.line_no AS new_line, b.line_no AS old_line, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS i,
  (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS s FROM lines a JOIN o b ON a.page = b.page AND a.y0 < b.y1 AND b.y0 < a.y1)
SELECT page, new_line, arg_max(old_line, [i / (s - i), -old_line]) AS old_line FROM p WHERE s > i AND i / (s - i) >= 0.4 GROUP BY ALL""")
def p28_box_pairs(spark, d):
    new = lines(spark, d)
    return J.box_pairs(new, new.withColumn("y0", F.col("y0") + 15).withColumn("y1", F.col("y1") + 15), 0.4)


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(range(doc_id % 7 + 1, doc_id % 7 + 6), [3, 8]))), ',') AS pages FROM documents")
def s06_page_set(spark, d):
    spec = F.concat(F.col("doc_id") % 7 + 1, F.lit("-"), F.col("doc_id") % 7 + 5, F.lit(",3,8,99"))
    return table(spark, d, "documents").select("doc_id", F.array_join(page_set(spec, F.lit(20)), ",").alias("pages"))


@query("""WITH p AS (SELECT source AS doc, doc_id, string_split(text, chr(10)) AS parts FROM documents),
r AS (SELECT doc, doc_id, unnest(range(1, len(parts) + 1)) AS i, parts FROM p)
SELECT doc, CAST(doc_id AS INTEGER) AS page, doc_id * 100000 + i AS pos, regexp_replace(parts[i], '^## ', '') AS text FROM r WHERE NOT regexp_matches(parts[i], '^===== page [0-9]+')""")
def s09_page_markers(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("doc"), "doc_id", F.split("text", "\n", -1).alias("parts"))
    head = docs.select("doc", (F.col("doc_id") * 100000).alias("pos"), F.concat(F.lit("===== page "), F.col("doc_id"), F.lit(" =====")).alias("text"))
    body = docs.select("doc", "doc_id", F.posexplode("parts").alias("i", "text")).select("doc", (F.col("doc_id") * 100000 + F.col("i") + 1).alias("pos"), "text")
    return marked_pages(head.unionByName(body))


@query(f"""{LINES_SQL}, p AS (SELECT book, page, avg(conf) AS m, count(conf) AS n FROM lines GROUP BY ALL)
SELECT book, count(*) AS pages, CAST(sum(n) AS BIGINT) AS n_lines, round(avg(m), 6) AS mean_conf, count(*) FILTER (m < 70) AS low_pages FROM p GROUP BY book""")
def a01_confidence(spark, d):
    return B.confidence(lines(spark, d))


_AREA = "(length(html) % 100) / 100.0"


@query(f"""WITH k AS (SELECT page_id % 10 AS book, CASE WHEN {_AREA} >= 0.6 OR ({_AREA} >= 0.2 AND length(url) * 5 < 200) THEN 'scan' ELSE 'exported' END AS kind, length(url) * 4 AS dpi FROM pages),
s AS (SELECT book, count(*) FILTER (kind = 'scan') AS scans, count(*) FILTER (kind <> 'scan') AS exported, CAST(floor(median(dpi) FILTER (kind = 'scan')) AS BIGINT) AS dpi FROM k GROUP BY book)
SELECT book, scans, exported, CASE WHEN scans >= exported THEN 'scan' ELSE 'exported' END AS kind, dpi FROM s""")
def a03_document_type(spark, d):
    pages = table(spark, d, "pages").select((F.col("page_id") % 10).alias("book"), F.col("page_id").alias("page"), (F.length("html") % 100 / 100.0).alias("area"), (F.length("url") * 5).alias("chars"), (F.length("url") * 4).alias("dpi"))
    return B.document_type(pages)


@query("""WITH n AS (SELECT source, lang, count(*) AS c FROM documents WHERE lang IS NOT NULL GROUP BY ALL)
SELECT source, CAST(sum(c) AS BIGINT) AS answers, CASE WHEN 2 * max(c) > sum(c) THEN arg_max(lang, c) END AS found FROM n GROUP BY source""")
def a05_script_majority(spark, d):
    return B.majority(table(spark, d, "documents"), "source", "lang")


_HEADERS = f"""m AS (SELECT book, page, {_KEY.format('text')} AS key FROM lines WHERE {_MARGIN}),
g AS (SELECT book, key, count(DISTINCT page) AS n_pages, min(page) AS lo, max(page) AS hi FROM m WHERE length(key) >= 3 GROUP BY ALL),
b AS (SELECT book, count(DISTINCT page) AS pages FROM lines GROUP BY book),
h AS (SELECT g.book, key, n_pages FROM g JOIN b USING (book) WHERE n_pages >= greatest(3, 0.02 * pages) OR (n_pages >= 3 AND 2 * (hi - lo) <= 5 * (n_pages - 1)))"""


@query(f"{LINES_SQL}, {_HEADERS} SELECT * FROM h")
def a06_running_headers(spark, d):
    return B.running_headers(lines(spark, d), 0.02)


@query(f"""{LINES_SQL}, {_HEADERS}
SELECT book, count(*) AS kept FROM lines l WHERE NOT ({_MARGIN} AND EXISTS (FROM h WHERE h.book = l.book AND h.key = {_KEY.format('l.text')})) GROUP BY book""")
def f05_headers_removed(spark, d):
    return B.without_headers(lines(spark, d), 0.02).groupBy("book").agg(F.count("*").alias("kept"))


@query(f"""{LINES_SQL}, {_HEADERS}
SELECT book, count(*) AS kept FROM lines l WHERE NOT ({_MARGIN} AND (coalesce(conf < 50, false) OR EXISTS (FROM h WHERE h.book = l.book AND h.key = {_KEY.format('l.text')}))) GROUP BY book""")
def f05_low_margins_removed(spark, d):
    return B.without_headers(lines(spark, d), 0.02, least_conf=50).groupBy("book").agg(F.count("*").alias("kept"))


@query()
def f05_header_variants_removed(spark, d):
    return B.without_headers(lines(spark, d), 0.02, variants=True, least_conf=50).groupBy("book").agg(F.count("*").alias("kept"))


_CUT = "greatest(1, least(n - 1, {0} * (n + 1) // 20))"
_Q = "({0}[{1}] * (20 - ({2} * (n + 1) - 20 * {1})) + {0}[{1} + 1] * ({2} * (n + 1) - 20 * {1})) / 20.0"
_MARGINS = f"""e AS (SELECT book, list_sort(list(x0 / width)) AS a, list_sort(list(x1 / width)) AS b, count(*) AS n FROM lines GROUP BY book),
mg AS (SELECT book, {_Q.format('a', _CUT.format(1), 1)} AS "left", {_Q.format('b', _CUT.format(19), 19)} AS "right" FROM e WHERE n >= 20)"""
_PITCH = """gp AS (SELECT book, lead(y0) OVER (PARTITION BY book, page ORDER BY line_no) - y0 AS gap FROM lines),
pt AS (SELECT book, count(*) AS gaps, CASE WHEN count(*) >= 20 THEN CAST(median(gap) AS DOUBLE) END AS pitch FROM gp WHERE gap > 0 GROUP BY book)"""


@query(f'{LINES_SQL}, {_MARGINS} SELECT book, round("left", 9) AS "left", round("right", 9) AS "right" FROM mg')
def a07_margins(spark, d):
    return B.margins(lines(spark, d)).select("book", F.round("left", 9).alias("left"), F.round("right", 9).alias("right"))


@query(f"{LINES_SQL}, {_PITCH} SELECT * FROM pt")
def a08_line_pitch(spark, d):
    return B.line_pitch(lines(spark, d)).withColumn("pitch", F.col("pitch").cast("double"))


@query(f"{LINES_SQL} SELECT book, CAST(sum(length(text) - length(replace(text, ',', ''))) AS BIGINT) AS commas, CAST(sum(length(text) - length(replace(text, '»', ''))) AS BIGINT) AS closing, CAST(0 AS BIGINT) AS hamza FROM lines GROUP BY book")
def a09_comma_counts(spark, d):
    rows = lines(spark, d).withColumn("text", F.replace("text", F.lit(","), F.lit("،")))
    return B.comma_counts(rows).select("book", *[F.col(c).cast("long").alias(c) for c in ("commas", "closing", "hamza")])


_SPARSE = """wc AS (SELECT book, page, CAST(sum(CASE WHEN regexp_full_match(text, '\\s*') THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g'), ' '), ' ')) END) AS BIGINT) AS words FROM lines GROUP BY ALL),
ty AS (SELECT book, list_sort(list(words)) AS w FROM wc WHERE words > 0 GROUP BY book),
sp AS (SELECT wc.book, page, words, coalesce(CASE WHEN len(w) >= 3 THEN words < 0.25 * w[len(w) // 2 + 1] END, false) AS sparse FROM wc LEFT JOIN ty USING (book))"""


@query(f"{LINES_SQL}, {_SPARSE} SELECT * FROM sp")
def a10_sparse_pages(spark, d):
    return B.sparse_pages(lines(spark, d))


_VOCAB = f"""u AS (SELECT unnest(string_split_regex(s, '\\s+')) AS w FROM fa), f AS (SELECT {_FORM.format('w')} AS word FROM u),
v AS (SELECT word, count(*) AS n FROM f WHERE word <> '' GROUP BY word HAVING count(*) >= 3)"""


@query(f"{FA}, {_VOCAB} SELECT * FROM v")
def a11_vocabulary(spark, d):
    return B.vocabulary(fa(spark, d).withColumnRenamed("s", "text"))


@query("""WITH r AS (SELECT user_id AS reader, ts, event_id AS run_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k, count(*) OVER (PARTITION BY user_id) AS n_runs FROM events)
SELECT reader, ts, run_id, value, n_runs FROM r WHERE k = 1""")
def a22_latest_runs(spark, d):
    return B.latest_runs(table(spark, d, "events").select(F.col("user_id").alias("reader"), "ts", F.col("event_id").alias("run_id"), "value"))


def decisions(spark, d):
    """Labels as decisions on the first lines of documents."""
    status = F.when(F.col("toxic") == 1, "skip").when(F.col("quality") == 1, "done").otherwise("unsure")
    return table(spark, d, "labels").select(F.col("doc_id").alias("page"), F.lit(0).alias("line_no"), status.alias("status"), F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("checked "), F.col("doc_id"))).alias("checked"), F.when(F.col("doc_id") % 5 == 0, F.lit("agreed")).alias("agreed"))


_DECIDED = """dc AS (SELECT doc_id AS page, 0 AS line_no, CASE WHEN toxic = 1 THEN 'skip' WHEN quality = 1 THEN 'done' ELSE 'unsure' END AS status,
  CASE WHEN doc_id % 3 > 0 THEN 'checked ' || doc_id END AS checked, CASE WHEN doc_id % 5 = 0 THEN 'agreed' END AS agreed FROM labels),
ld AS (SELECT book, l.page, l.line_no, CASE WHEN status = 'done' THEN 'checked' WHEN agreed IS NOT NULL THEN 'agreed' WHEN status = 'unsure' AND checked IS NOT NULL THEN 'unsure' ELSE 'read' END AS line_source, text, checked, agreed
  FROM lines l LEFT JOIN dc ON l.page = dc.page AND l.line_no = dc.line_no WHERE status IS NULL OR status <> 'skip')"""


@query(f"{LINES_SQL}, {_DECIDED} SELECT book, page, line_no, CASE line_source WHEN 'checked' THEN coalesce(checked, text) WHEN 'agreed' THEN agreed WHEN 'unsure' THEN checked ELSE text END AS text, line_source FROM ld")
def j01_line_decisions(spark, d):
    return J.line_decisions(lines(spark, d), decisions(spark, d))


@query(f"{LINES_SQL}, {_DECIDED} SELECT line_source, count(*) AS n FROM ld GROUP BY line_source")
def a18_line_sources(spark, d):
    return J.line_decisions(lines(spark, d), decisions(spark, d)).groupBy("line_source").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'done' ELSE 'unsure' END AS status, 'text ' || doc_id AS text FROM labels),
m AS (SELECT doc_id AS id, 'skip' AS status FROM documents WHERE n_chars < 200) SELECT id, coalesce(m.status, r.status) AS status, r.text FROM r FULL JOIN m USING (id)""")
def j02_manifest_override(spark, d):
    review = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "done").otherwise("unsure").alias("status"), F.concat(F.lit("text "), F.col("doc_id")).alias("text"))
    return J.manifest_override(review, table(spark, d, "documents").where("n_chars < 200").select(F.col("doc_id").alias("id"), F.lit("skip").alias("status")))


def named_lines(spark, d):
    return lines(spark, d).withColumn("line_id", F.format_string("p%03d-%02d", "page", F.col("line_no") + 1))


_NAMED = "nl AS (SELECT *, printf('p%03d-%02d', page, line_no + 1) AS line_id FROM lines)"


@query(f"{LINES_SQL}, {_NAMED} SELECT line_id, book FROM nl WHERE NOT (line_id GLOB 'p00*' OR line_id GLOB '*-?3')")
def j03_drop_patterns(spark, d):
    patterns = spark.createDataFrame([("p00*",), ("*-?3",)], "pattern string")
    return J.without_patterns(named_lines(spark, d), patterns).select("line_id", "book")


@query(f"""{LINES_SQL}, {_NAMED}, ch AS (SELECT line_id, CASE WHEN page % 2 = 0 THEN 'Chapter ' || page END AS title FROM nl WHERE line_no = 1),
j AS (SELECT nl.*, ch.line_id IS NOT NULL AS starts, title FROM nl LEFT JOIN ch USING (line_id))
SELECT book, page, line_id, y0, y1, text, starts AND title IS NULL AS heading FROM j
UNION ALL SELECT book, page, line_id || '-title', y0 - 2, y0 - 1, title, true FROM j WHERE title IS NOT NULL""")
def j04_chapter_starts(spark, d):
    rows = named_lines(spark, d)
    chapters = rows.where("line_no = 1").select("line_id", F.when(F.col("page") % 2 == 0, F.concat(F.lit("Chapter "), F.col("page"))).alias("title"))
    return J.chapter_starts(rows, chapters)


_ASKED = f"fa2 AS (SELECT translate(lower(text), '{T.LATIN}', '{T.STAND_IN}') AS s FROM benchmark), q AS (SELECT DISTINCT {_FORM.format('w')} AS word FROM (SELECT unnest(string_split_regex(s, '\\s+')) AS w FROM fa2))"


def asked_words(spark, d):
    words = table(spark, d, "benchmark").select(F.explode(F.split(T.stand_in(F.col("text")), "\\s+")).alias("w"))
    return words.select(T.comparison_form(F.col("w")).alias("word")).where("word <> ''").distinct()


@query(f"""{FA}, {_VOCAB}, {_ASKED}, c AS (SELECT word, unnest(range(1, length(word) - 1)) AS i FROM q WHERE length(word) >= 3),
sp AS (SELECT DISTINCT word FROM c WHERE (substr(word, 1, i) IN ('و', 'ب') OR (i > 1 AND substr(word, 1, i) IN (SELECT word FROM v))) AND substr(word, i + 1) IN (SELECT word FROM v))
SELECT word, word IN (SELECT word FROM v) OR word IN (SELECT word FROM sp) AS known FROM q WHERE word <> ''""")
def j11_known_words(spark, d):
    return J.known_words(asked_words(spark, d), a11_vocabulary(spark, d))


_CUTS = "list_distinct(list_concat([s], list_transform(range(1, length(s) + 1), lambda i: substr(s, 1, i - 1) || substr(s, i + 1))))"


@query(f"""{FA}, {_VOCAB}, {_ASKED}, qa AS (SELECT word, translate({_FORM.format('word')}, '{_SHAPES_FROM}', '{_SHAPES_TO}') AS s FROM q WHERE word <> ''),
lx AS (SELECT word AS suggestion, n, translate({_FORM.format('word')}, '{_SHAPES_FROM}', '{_SHAPES_TO}') AS s FROM v),
qk AS (SELECT word, unnest({_CUTS}) AS key FROM qa), lk AS (SELECT suggestion, n, unnest({_CUTS}) AS key FROM lx),
al AS (SELECT word, suggestion, n, 0 AS tier FROM qa JOIN lx USING (s) UNION ALL SELECT word, suggestion, n, 1 FROM qk JOIN lk USING (key))
SELECT word, suggestion, min(tier) AS tier, true AS common, max(n) AS n FROM al WHERE word <> suggestion GROUP BY ALL""")
def j12_like_words(spark, d):
    return J.like_words(asked_words(spark, d), a11_vocabulary(spark, d))


@query()
def j12_suggestions(spark, d):
    return J.suggestions(asked_words(spark, d), a11_vocabulary(spark, d))


def word_boxes(spark, d, texts: bool = False):
    """Words of each line, right to left, with wider gaps after every fourth; a page is as wide as its longest line needs.
    texts: with word_no, text and the line's conf; else only the number of a line's words goes to its page."""
    words = F.split("text", " ")
    rows = lines(spark, d).select("page", "line_no", "y0", "y1", F.size(words).alias("n"), *(["conf", words.alias("w")] if texts else []))
    if not texts:  # so few bytes that they would be put into few tasks, of which each word is a row then
        rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), "page")
    most = F.max("n").over(Window.partitionBy("page"))
    rows = rows.withColumn("width", F.greatest(F.lit(2000), most * 70 + F.floor(most / 4) * 130 + 100))
    each = F.posexplode("w").alias("k", "text") if texts else F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k")
    rows = rows.where("n > 0").select("page", "line_no", "y0", "y1", "width", *(["conf"] if texts else []), each)
    right = F.col("width") - F.col("k") * 70 - F.floor(F.col("k") / 4) * 130
    boxes = ["page", "line_no", (right - 50).cast("int").alias("x0"), right.cast("int").alias("x1"), "y0", "y1"]
    return rows.select(*boxes, *([F.col("k").alias("word_no"), "text", "conf"] if texts else []))


_BOXES = """wt AS (SELECT page, line_no, y0, y1, string_split(text, ' ') AS w FROM lines),
ww AS (SELECT *, greatest(2000, max(len(w)) OVER (PARTITION BY page) * 70 + max(len(w)) OVER (PARTITION BY page) // 4 * 130 + 100) AS wide FROM wt),
wk AS (SELECT page, line_no, y0, y1, wide, unnest(range(0, len(w))) AS k FROM ww),
wb AS (SELECT page, line_no, CAST(wide - k * 70 - (k // 4) * 130 - 50 AS INTEGER) AS x0, CAST(wide - k * 70 - (k // 4) * 130 AS INTEGER) AS x1, y0, y1 FROM wk)"""


@query(f"""{LINES_SQL}, {_BOXES}, g AS (SELECT page, line_no, lead(x1) OVER o AS gap_start, x0 AS gap_end, y1 - y0 AS h FROM wb WINDOW o AS (PARTITION BY page, line_no ORDER BY x1 DESC)),
z AS (SELECT *, gap_end - gap_start AS size, list_sort(list(gap_end - gap_start) OVER (PARTITION BY page, line_no)) AS sizes FROM g WHERE gap_start IS NOT NULL),
wd AS (SELECT page, line_no, gap_start, gap_end FROM z WHERE CASE WHEN len(sizes) = 1 THEN size > 2 * h ELSE size > greatest(20, 2.5 * sizes[len(sizes) // 2 + 1]) END),
nl AS (SELECT page, count(DISTINCT line_no) AS n FROM wb GROUP BY page),
s AS (SELECT a.page, a.line_no, a.gap_start, a.gap_end, count(DISTINCT b.line_no) AS shared FROM wd a JOIN wd b ON a.page = b.page AND b.gap_start < a.gap_end AND a.gap_start < b.gap_end GROUP BY ALL)
SELECT s.* FROM s JOIN nl USING (page) WHERE shared >= greatest(3, 0.2 * n)""")
def j14_column_gaps(spark, d):
    return J.column_gaps(word_boxes(spark, d))


@query(f"""{LINES_SQL}, {_BOXES}, t AS (SELECT *, list_sort(list(y1 - y0) OVER (PARTITION BY page, line_no)) AS hs, lag(x0) OVER o - x1 AS gap FROM wb WINDOW o AS (PARTITION BY page, line_no ORDER BY x1 DESC))
SELECT page, line_no, x0, x1, CAST(sum(CASE WHEN gap > 2.5 * hs[len(hs) // 2 + 1] THEN 1 ELSE 0 END) OVER (PARTITION BY page, line_no ORDER BY x1 DESC) AS INTEGER) AS part FROM t""")
def w12_gap_split(spark, d):
    return S.split_at_gaps(word_boxes(spark, d))


@query("""WITH a AS (SELECT item_id, unnest(string_split_regex(text, '\\s+')) AS word FROM benchmark), b AS (SELECT item_id, unnest(string_split_regex(replace(text, 'the', 'teh'), '\\s+')) AS word FROM benchmark),
x AS (SELECT item_id, word, count(*) AS n FROM a GROUP BY ALL), y AS (SELECT item_id, word, count(*) AS m FROM b GROUP BY ALL)
SELECT item_id, CAST(sum(least(n, coalesce(m, 0))) AS BIGINT) AS hits, CAST(sum(n) AS BIGINT) AS total FROM x LEFT JOIN y USING (item_id, word) GROUP BY item_id""")
def j15_bag_recall(spark, d):
    rows = table(spark, d, "benchmark")
    split = lambda c: rows.select("item_id", F.explode(F.split(c, "\\s+")).alias("word"))
    return J.bag_recall(split(F.col("text")), split(F.replace("text", F.lit("the"), F.lit("teh"))), "item_id")


_ORDINALS = H.ordinals()
_ORDINALS_SQL = "[" + ", ".join(f"'{o}'" for o in _ORDINALS) + "]"


def planted(rows, text):
    """Rows whose text is this, but that every seventeenth line is a chapter's heading with its keyword misread."""
    name = F.array(*[F.lit(o) for o in _ORDINALS])[F.col("line_no") % len(_ORDINALS)]
    return T.computed(rows, "text", F.when(F.col("line_no") % 17 == 3, F.concat(F.lit("نصل "), name)).otherwise(text))


def planted_lines(spark, d):
    return planted(lines(spark, d), T.stand_in(F.col("text")))


def paragraph_lines(spark, d):
    plain = lines(spark, d)  # the same boxes and pages, and as many words in a line
    sparse = B.sparse_pages(planted(plain, F.col("text"))).select("book", "page", "sparse")
    kept = S.kept_lines(planted_lines(spark, d), 0.02).join(sparse, ["book", "page"])
    statistics = S.book_statistics(plain)
    return H.detect_headings(kept, statistics), statistics, plain


_TERMINAL = "right(prev_text, 1) IN ('.', '!', '?', '؟', ':', '…', '»', '\"', '''')"
_NUMBER = "^\\s*(?:([0-9۰-۹]{1,2})\\s*[-–—ـ:.)]?|ا\\s*[-–—ـ:.)])\\s*"
_PLANTED = f"CASE WHEN i % 17 = 3 THEN 'نصل ' || {_ORDINALS_SQL}[i % {len(_ORDINALS)} + 1] ELSE translate(lower(parts[i + 1]), '{T.LATIN}', '{T.STAND_IN}') END AS text"
_PARAGRAPHS = f"""{LINES_SQL.replace('parts[i + 1] AS text', _PLANTED)}, {_HEADERS}, {_SPARSE}, {_MARGINS}, {_PITCH},
cl AS (SELECT *, {_CLOSE.format(_COMMAS.format(_NORMAL.format('text')))} AS clean FROM lines),
kk AS (SELECT c.*, sp.sparse FROM cl c JOIN sp USING (book, page)
  WHERE (len(regexp_extract_all(clean, '\\p{{L}}')) > 1 OR (len(regexp_extract_all(clean, '\\p{{L}}')) = 1 AND coalesce(nullif(conf, 0), 100) >= 50))
  AND NOT ({_MARGIN} AND (coalesce(conf < 50, false) OR EXISTS (FROM h WHERE h.book = c.book AND h.key = {_KEY.format('c.text')})))),
kn AS (SELECT kk.*, mg."right" - mg."left" AS tw, y0 - lag(y1) OVER (PARTITION BY kk.book, page ORDER BY line_no) AS above, regexp_replace(clean, '{_NUMBER}', '') AS rest, regexp_matches(clean, '{_NUMBER}') AS numbered FROM kk LEFT JOIN mg USING (book)),
kl AS (SELECT kn.* EXCLUDE (tw), regexp_matches(clean, '^نصل ({'|'.join(_ORDINALS)})$') AS marked, NOT marked AND NOT sparse AND numbered AND conf >= 40 AND coalesce(above >= 80, true)
  AND coalesce(greatest(1, x1 - x0) / width < 0.6 * tw, true) AND regexp_matches(rest, '^[\\x{{0600}}-\\x{{06FF}}]') AND len(regexp_extract_all(rest, '[\\x{{0621}}-\\x{{064A}}\\x{{067E}}-\\x{{06D3}}]')) >= 3 AND len(string_split_regex(rest, '\\s+')) <= 6
  AND NOT regexp_matches(rest, '[0-9۰-۹٠-٩]') AND NOT regexp_matches(rest, '[.!،,:؛]$') AND NOT regexp_matches(regexp_extract(clean, '{_NUMBER}', 1), '^[0۰]+$') AS short_title,
  CASE WHEN marked THEN 'فصل ' || substr(clean, 5) WHEN short_title THEN translate(CASE WHEN regexp_extract(clean, '{_NUMBER}', 1) = '' THEN '۱' ELSE regexp_extract(clean, '{_NUMBER}', 1) END, '{T.LATIN_DIGITS}', '{T.PERSIAN_DIGITS}') || '- ' || rest END AS title FROM kn),
p1 AS (SELECT kl.*, mg."left" AS lft, mg."right" - mg."left" AS tw, pitch, 40 AS line_h, row_number() OVER bk AS ord, row_number() OVER pg = 1 AS first_on_page, lag(clean) OVER bk AS prev_text,
  coalesce(lag(kl.sparse) OVER bk, false) AS prev_sparse, coalesce(lag(coalesce((x0 / width - mg."left") < 0.06 * (mg."right" - mg."left"), false)) OVER bk, false) AS prev_full,
  y0 - lag(y1) OVER pg AS gap, y0 - lag(y0) OVER pg AS leap
  FROM kl LEFT JOIN mg USING (book) LEFT JOIN pt USING (book) WINDOW bk AS (PARTITION BY book ORDER BY page, line_no), pg AS (PARTITION BY book, page ORDER BY line_no)),
p2 AS (SELECT *, coalesce({_TERMINAL}, false) AS ended FROM p1),
p3 AS (SELECT *, marked OR (short_title AND (ord = 1 OR (first_on_page AND prev_sparse) OR ended)) AS sure FROM p2),
p4 AS (SELECT *, coalesce(max(CASE WHEN sure THEN ord END) OVER w, -1) > coalesce(max(CASE WHEN NOT sure AND NOT short_title THEN ord END) OVER w, -1) AS h FROM p3 WINDOW w AS (PARTITION BY book ORDER BY page, line_no)),
p5 AS (SELECT *, coalesce(lag(h) OVER (PARTITION BY book ORDER BY page, line_no), false) AS prev_h FROM p4),
p6 AS (SELECT *, NOT (h AND prev_h AND coalesce(gap < 1.5 * line_h, false)) AND (ord = 1 OR sparse OR (first_on_page AND prev_sparse) OR prev_h OR h
  OR (regexp_matches(clean, '{T.DIALOGUE}') AND ended) OR (NOT prev_full AND ended) OR coalesce(leap > 2.2 * pitch, false)) AS starts FROM p5),
p7 AS (SELECT *, CAST(sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY book ORDER BY page, line_no) AS BIGINT) AS para_no FROM p6),
p8 AS (SELECT *, CASE WHEN h AND title IS NOT NULL THEN title ELSE clean END AS t, lead(starts) OVER (PARTITION BY book ORDER BY page, line_no) AS next_starts FROM p7),
p9 AS (SELECT *, NOT coalesce(next_starts, true) AND regexp_matches(t, '(^|[^\\x{{0600}}-\\x{{06FF}}\\x{{200c}}])(ن?می)\\s*[-–—ـ]$') AS broken FROM p8),
p10 AS (SELECT *, CASE WHEN starts OR coalesce(lag(broken) OVER bk, false) OR left(t, 1) IN ('.', '؛', ':', '؟', '!', '»', '?', ';', '،') OR coalesce(right(lag(t) OVER bk, 1) = '«', false) THEN '' ELSE ' ' END AS sep,
  CASE WHEN broken THEN regexp_replace(t, '(^|[^\\x{{0600}}-\\x{{06FF}}\\x{{200c}}])(ن?می)\\s*[-–—ـ]$', '\\1\\2' || chr(8204)) ELSE t END AS own FROM p9 WINDOW bk AS (PARTITION BY book ORDER BY page, line_no)),
ap AS (SELECT DISTINCT book, page FROM lines), kp AS (SELECT DISTINCT book, page FROM p10),
tg AS (SELECT a.book, a.page, (SELECT min(k.page) FROM kp k WHERE k.book = a.book AND k.page >= a.page) AS target FROM ap a),
mk AS (SELECT book, target, string_agg('[' || page || ']', '' ORDER BY page) AS markers FROM tg GROUP BY ALL),
pm AS (SELECT p10.*, sep || CASE WHEN first_on_page THEN coalesce(markers, '') ELSE '' END || own AS piece FROM p10 LEFT JOIN mk ON mk.book = p10.book AND mk.target = p10.page),
pb AS (SELECT book, para_no, min_by(printf('p%03d-%02d', page, line_no + 1), ord) AS para_id, bool_or(h) AS heading, min(page) AS first_page, max(page) AS last_page, count(*) AS n_lines, string_agg(sep || own, '' ORDER BY ord) AS text, string_agg(piece, '' ORDER BY ord) AS piece FROM pm GROUP BY ALL),
pa AS (SELECT pb.* EXCLUDE (piece), piece || CASE WHEN para_no = max(para_no) OVER (PARTITION BY pb.book) THEN coalesce(markers, '') ELSE '' END AS marked FROM pb LEFT JOIN mk ON mk.book = pb.book AND mk.target IS NULL)"""


@query(f"{_PARAGRAPHS} SELECT book, para_no, para_id, heading, first_page, last_page, n_lines, md5(text) AS text, md5(marked) AS marked FROM pa")
def w01_paragraphs(spark, d):
    found = book_paragraphs(spark, d).drop("sparse", "conf")
    return found.withColumn("text", F.md5("text")).withColumn("marked", F.md5(F.translate("marked", S.PAGE_OPEN + S.PAGE_CLOSE, "[]")))


def book_paragraphs(spark, d):
    kept, statistics, rows = paragraph_lines(spark, d)
    return S.paragraphs(kept, statistics, rows)


def lines_fa(spark, d):
    return T.computed(lines(spark, d), "text", T.stand_in(F.col("text")))


@query(f"""{_PARAGRAPHS}, se AS (SELECT *, CAST(sum(CASE WHEN heading THEN 1 ELSE 0 END) OVER (PARTITION BY book ORDER BY para_no) AS BIGINT) AS section_no FROM pa)
SELECT book, section_no, coalesce(max(text) FILTER (heading), 'آغاز') AS title, count(*) AS n_paragraphs, min(para_no) AS first_para FROM se WHERE book IN (SELECT book FROM pa WHERE heading GROUP BY book HAVING count(*) >= 2) GROUP BY ALL""")
def w09_sections(spark, d):
    return S.sections_by_heading(book_paragraphs(spark, d))


@query("""WITH RECURSIVE p AS (SELECT DISTINCT source AS book, doc_id AS page FROM documents), o AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY page) AS i FROM p),
r AS (SELECT book, page, i, page AS section_start FROM o WHERE i = 1 UNION ALL SELECT o.book, o.page, o.i, CASE WHEN o.page - r.section_start >= 200 THEN o.page ELSE r.section_start END FROM r JOIN o ON o.book = r.book AND o.i = r.i + 1)
SELECT book, page, section_start FROM r""")
def w10_page_sections(spark, d):
    return S.sections_by_pages(table(spark, d, "documents").select(F.col("source").alias("book"), F.col("doc_id").alias("page")), 200)


@query()
def j13_reading_order(spark, d):
    return S.reading_order(lines(spark, d))


@query(f"{LINES_SQL} SELECT book, count(DISTINCT page) AS pages, count(*) AS lines, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) FILTER (conf < 60) AS low_lines, min(page) AS first_page, max(page) AS last_page FROM lines GROUP BY book")
def k05_report(spark, d):
    return B.page_report(lines(spark, d))


@query(f"{LINES_SQL} SELECT book, page, '===== page ' || page || ' =====' || chr(10) || string_agg(text, chr(10) ORDER BY line_no) AS content FROM lines GROUP BY book, page")
def k02_page_texts(spark, d):
    from folianth.sources.sinks import page_texts

    return page_texts(lines(spark, d))


@query()
def k04_book_members(spark, d):
    from folianth.sources.sinks import book_members

    return book_members(book_paragraphs(spark, d)).withColumn("content", F.md5("content"))


def pairs(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("reference"), F.replace(F.replace("text", F.lit("the"), F.lit("teh")), F.lit(" on "), F.lit(" ")).alias("other"))


@query()
def a13_compare(spark, d):
    return E.compare(pairs(spark, d)).drop("mismatches")


@query()
def a14_confusions(spark, d):
    return E.confusions(E.compare(pairs(spark, d)))


@query()
def p16_half_spaces(spark, d):
    return fa(spark, d).select("doc_id", E.half_spaces(F.col("s")).alias("r")).select("doc_id", "r.text", "r.n")


@query()
def p17_split_joined(spark, d):
    words = B.word_counts(fa(spark, d).withColumnRenamed("s", "text")).select("word").where("word <> ''")
    return E.split_joined(asked_words(spark, d).union(words), a11_vocabulary(spark, d))


@query()
def p17_split_texts(spark, d):
    texts = fa(spark, d).withColumnRenamed("s", "text")
    return E.split_texts(texts, "doc_id", a11_vocabulary(spark, d))


@query()
def w07_pair_quotes(spark, d):
    return fa(spark, d).select("doc_id", E.pair_quotes(F.translate("s", ".,", "«»")).alias("s"))
