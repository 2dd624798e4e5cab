"""Queries over the predicates, repairs and run statistics of folianth.operators.checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from folianth.functions import text as T
from folianth.operators import checks as C
from folianth.operators import evaluate as E
from folianth.operators import front as R
from folianth.operators import joins as J
from folianth.plans.queries import _AREA, _CLOSE, _COMMAS, _NORMAL, FA, fa, lines, lines_fa, query, table
from folianth.sources.bridge import LINES_SQL

_FA_LINES = LINES_SQL.replace("parts[i + 1] AS text", f"translate(lower(parts[i + 1]), '{T.LATIN}', '{T.STAND_IN}') AS text")
_EDGE = C.TITLE_EDGE.replace("'", "''")


@query(f"""{_FA_LINES}, cl AS (SELECT page, line_no, conf, {_CLOSE.format(_COMMAS.format(_NORMAL.format('text')))} AS clean FROM lines),
n AS (SELECT *, len(regexp_extract_all(clean, '\\p{{L}}')) AS letters FROM cl)
SELECT page, line_no, clean FROM n WHERE NOT (letters = 0 OR (letters = 1 AND conf < 50)) AND NOT regexp_matches(clean, '^[0-9]+$') AND conf >= 45""")
def f01_kept_lines(spark, d):
    return C.kept_by_rules(lines_fa(spark, d), "^[0-9]+$", 45).select("page", "line_no", "clean")


@query(f"""{_FA_LINES}, a AS (SELECT page, line_no, conf, text, regexp_replace({_NORMAL.format('text')}, '^{_EDGE}|{_EDGE}$', '', 'g') AS t FROM lines),
b AS (SELECT *, trim(regexp_replace(t, '\\s*[۰-۹0-9]{{4}}$', ''), ' ') AS u FROM a),
c AS (SELECT *, CASE WHEN len(regexp_extract_all(u, '\\(')) <> len(regexp_extract_all(u, '\\)')) THEN trim(regexp_replace(u, '[()]', '', 'g'), ' ') ELSE u END AS title FROM b)
SELECT page, line_no, title, len(regexp_extract_all(title, '[ء-يپ-ۓ]')) >= 2 AND len(string_split_regex(title, '\\s+')) <= 8 AND conf >= 40 AND NOT regexp_matches(text, '(?i){C.CREDITS}') AS usable FROM c""")
def f10_usable_titles(spark, d):
    rows = lines_fa(spark, d)
    return rows.select("page", "line_no", C.title_form(F.col("text")).alias("title"), C.usable_title(F.col("text"), F.col("conf"), 8).alias("usable"))


@query(f"{LINES_SQL} SELECT page, line_no, round_even(greatest(0.0, 100 - 10 * (100 - CAST(conf AS DOUBLE))), 1) AS scaled FROM lines")
def p24_reader_scale(spark, d):
    return lines(spark, d).select("page", "line_no", C.reader_scale(F.col("conf")).alias("scaled"))


_LANGUAGES = "CASE doc_id % 5 WHEN 0 THEN 'fas' WHEN 1 THEN 'fas+ara' WHEN 2 THEN 'fas+heb' WHEN 3 THEN 'yid' ELSE 'eng+fas' END"


@query(f"SELECT doc_id, {_LANGUAGES} AS languages, CASE doc_id % 5 WHEN 0 THEN 'Arabic' WHEN 1 THEN 'Arabic' WHEN 3 THEN 'Hebrew' END AS script FROM documents")
def p30_expected_script(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.expr(_LANGUAGES).alias("languages"))
    return rows.withColumn("script", C.expected_script(F.col("languages")))


@query("SELECT doc_id, CASE WHEN doc_id % 4 > 0 AND lang <> '' THEN lang END AS script FROM documents")
def s16_script_answers(spark, d):
    value = F.when(F.col("doc_id") % 4 > 0, F.coalesce("lang", F.lit(""))).otherwise(" ")
    out = F.concat(F.lit("Page number: 0\nScript: "), value, F.lit("\nScript confidence: 2.1\n"))
    return table(spark, d, "documents").select("doc_id", C.script_answer(out).alias("script"))


@query("""WITH t AS (SELECT doc_id, replace(replace(text, ',', '('), ';', ')') AS s FROM documents)
SELECT doc_id, CASE WHEN len(regexp_extract_all(s, '\\(')) > len(regexp_extract_all(s, '\\)')) THEN regexp_replace(s, '\\(([^()]*)\\(', '(\\1)', 'g') ELSE s END AS s FROM t""")
def w06_mirrored_parentheses(spark, d):
    return table(spark, d, "documents").select("doc_id", C.mirrored_parentheses(F.translate("text", ",;", "()")).alias("s"))


@query()
def w05_unopened_guillemets(spark, d):
    return fa(spark, d).select("doc_id", C.unopened_guillemets(F.translate("s", ".,", "«»")).alias("s"))


@query("SELECT doc_id, array_to_string(list_concat(range(doc_id % 7 + 1, doc_id % 7 + 6), [3, 8, 3]), ',') AS pages FROM documents")
def s06_page_list(spark, d):
    spec = F.concat(F.col("doc_id") % 7 + 1, F.lit("-"), F.col("doc_id") % 7 + 5, F.lit(",3,8,3"))
    return table(spark, d, "documents").select("doc_id", F.array_join(C.page_list(spec), ",").alias("pages"))


@query(f"""WITH k AS (SELECT page_id % 10 AS book, page_id AS page, CASE WHEN {_AREA} >= 0.6 THEN 'scan' ELSE 'exported' END AS kind, length(url) * 4 AS dpi FROM pages)
SELECT book, kind, count(*) AS pages, array_to_string(list_sort(list(page))[1:8], ',') AS first, list_sort(list(dpi))[count(*) // 2 + 1] AS dpi FROM k GROUP BY ALL""")
def a04_kinds_table(spark, d):
    kind = F.when(F.length("html") % 100 / 100.0 >= 0.6, "scan").otherwise("exported")
    rows = table(spark, d, "pages").select((F.col("page_id") % 10).alias("book"), F.col("page_id").alias("page"), kind.alias("kind"), (F.length("url").cast("long") * 4).alias("dpi"))
    return C.kinds_table(rows)


@query("""WITH s AS (SELECT user_id AS line, event_id AS step, CAST(floor(value) AS BIGINT) % 3 AS label, value AS conf FROM events),
n AS (SELECT *, CASE WHEN label = lag(label) OVER (PARTITION BY line ORDER BY step) THEN 0 ELSE 1 END AS new FROM s),
r AS (SELECT *, sum(new) OVER (PARTITION BY line ORDER BY step) AS run FROM n)
SELECT line, label, min(step) AS at, max(conf) AS conf FROM r WHERE label <> 0 GROUP BY line, run, label""")
def w13_decode_steps(spark, d):
    label = F.floor("value").cast("long") % 3
    return C.decode_steps(table(spark, d, "events").select(F.col("user_id").alias("line"), F.col("event_id").alias("step"), label.alias("label"), F.col("value").alias("conf")))


@query(f"""{LINES_SQL}, m AS (SELECT page AS doc, line_no AS i, CASE line_no % 4 WHEN 0 THEN line_no + 1 WHEN 1 THEN line_no - 1 ELSE line_no END AS j FROM lines),
p AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY j) AS place FROM m)
SELECT a.doc, count(*) AS pairs, round(avg(CASE WHEN b.place = a.place + 1 THEN 1.0 ELSE 0.0 END), 9) AS share FROM p a JOIN p b ON a.doc = b.doc AND b.i = a.i + 1 GROUP BY a.doc""")
def a15_line_order(spark, d):
    j = F.col("line_no") + F.when(F.col("line_no") % 4 == 0, 1).when(F.col("line_no") % 4 == 1, -1).otherwise(0)
    matched = lines(spark, d).select(F.col("page").alias("doc"), F.col("line_no").alias("i"), j.alias("j"))
    return C.line_order(matched).withColumn("share", F.round("share", 9))


@query("SELECT user_id AS reader, event_id AS run_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events")
def w16_previous_runs(spark, d):
    return C.previous_runs(table(spark, d, "events").select(F.col("user_id").alias("reader"), "ts", F.col("event_id").alias("run_id"), "value"))


_STATUS = "CASE WHEN conf > 50 THEN 'done' WHEN conf > 44 THEN 'skip' END"


@query(f"""{LINES_SQL}, s AS (SELECT page, line_no, text, {_STATUS} AS status FROM lines),
w AS (SELECT page, string_agg(text, chr(10) ORDER BY line_no) FILTER (status = 'done') AS own FROM s GROUP BY page HAVING bool_and(status IS NOT NULL) AND count(*) FILTER (status = 'done') > 0)
SELECT page, coalesce(own, f.text) AS text, CASE WHEN own IS NULL THEN 'file' ELSE 'set' END AS origin FROM (SELECT doc_id AS page, text FROM documents) f FULL JOIN w USING (page)""")
def s15_page_references(spark, d):
    files = table(spark, d, "documents").select(F.col("doc_id").alias("page"), "text")
    return C.page_references(files, lines(spark, d).withColumn("status", F.expr(_STATUS)))


@query("""WITH b AS (SELECT event_type, floor(value) AS v, user_id FROM events), m AS (SELECT *, min(v) OVER (PARTITION BY event_type) AS least FROM b)
SELECT event_type, CASE WHEN count(*) = 1 THEN max(user_id) END AS best FROM m WHERE v = least GROUP BY event_type""")
def a24_only_best(spark, d):
    return C.only_best(table(spark, d, "events").select("event_type", "user_id", F.floor("value").alias("v")), "event_type", "user_id", "v")


@query()
def p13_comparison_text(spark, d):
    return fa(spark, d).select("doc_id", E.comparison_text(F.col("s")).alias("s"))


@query()
def j07_matched_lines(spark, d):
    rows = table(spark, d, "benchmark").select(F.col("item_id").cast("long").alias("id"), F.posexplode(F.split("text", " the ")).alias("i", "text"))
    other = rows.select("id", F.col("i").bitwiseXOR(F.lit(1)).alias("j"), F.replace("text", F.lit("e"), F.lit("c")).alias("text"))
    return E.matched_lines(rows, other)


@query(f"""{LINES_SQL}, o AS (SELECT page, line_no, x0, y0 + s AS y0, x1, y1 + s AS y1, s FROM (SELECT *, CASE page % 3 WHEN 0 THEN 3 WHEN 1 THEN 9 ELSE 30 END AS s FROM lines))
SELECT page, CASE WHEN s < 30 AND x1 > x0 THEN line_no END AS new_line, line_no AS old_line, CASE WHEN s = 30 OR x1 = x0 THEN 'lost' WHEN s = 3 THEN 'kept' ELSE 'recheck' END AS outcome FROM o""")
def j05_carried_over(spark, d):
    new = lines(spark, d)
    shift = F.when(F.col("page") % 3 == 0, 3).when(F.col("page") % 3 == 1, 9).otherwise(30)
    old = new.withColumn("s", shift).withColumn("y0", F.col("y0") + F.col("s")).withColumn("y1", F.col("y1") + F.col("s"))
    return J.carried_over(new, old)


@query()
def w14_title_and_author(spark, d):
    return R.title_and_author(lines_fa(spark, d))


@query()
def j10_header_keys(spark, d):
    return R.header_keys(lines(spark, d), 0.02)
