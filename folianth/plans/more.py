"""Queries over headings, contents, line sets, files, scorecards and display order."""

from __future__ import annotations

from pyspark.sql import functions as F

from folianth.functions import bidi as D
from folianth.functions import text as T
from folianth.operators import headings as H
from folianth.operators import lineset as L
from folianth.operators import scorecard as R
from folianth.plans.queries import _BOXES, _FORM, _NUMBER, _ORDINALS, _ORDINALS_SQL, FA, a11_vocabulary, asked_words, book_paragraphs, fa, lines, lines_fa, pairs, query, table, word_boxes
from folianth.sources import files as S
from folianth.sources import sinks as K
from folianth.sources.bridge import LINES_SQL

_DIGITS = f"regexp_replace(translate(s, '{T.LATIN_DIGITS}', '{T.PERSIAN_DIGITS}'), '[^۰-۹]', '', 'g')"


@query(f"{FA} SELECT doc_id, {_FORM.format('s')} || {_DIGITS} AS key FROM fa")
def p15_match_key(spark, d):
    return fa(spark, d).select("doc_id", L.match_key(F.col("s")).alias("key"))


_KNOWN = ", ".join(f"({i}, '{o}', '{o.replace(' ', '').replace(H.ZWNJ, '')}')" for i, o in enumerate(_ORDINALS))
#: DuckDB's levenshtein counts bytes, so letters are compared as letters of one byte.
_CHARS = "".join(sorted({c for o in _ORDINALS for c in o} - {" ", H.ZWNJ} | {"ض"}))
_BYTES = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"[: len(_CHARS)]
_ASKED_SQL = f"""a AS (SELECT doc_id, {_ORDINALS_SQL}[doc_id % {len(_ORDINALS)} + 1] AS o, CAST(doc_id // {len(_ORDINALS)} AS BIGINT) AS q FROM documents),
b AS (SELECT doc_id, CASE WHEN q % 3 = 0 THEN o ELSE substr(o, 1, CAST(q % length(o) AS BIGINT)) || CASE WHEN q % 3 = 2 THEN 'ض' ELSE '' END || substr(o, CAST(q % length(o) AS BIGINT) + 2) END AS rest, CASE q % 4 WHEN 0 THEN 'فصل' WHEN 1 THEN 'نصل' WHEN 2 THEN 'بخش' ELSE 'نخش' END AS word FROM a)"""


@query(f"""WITH k(i, name, key) AS (VALUES {_KNOWN}), {_ASKED_SQL},
n AS (SELECT doc_id, word, rest, replace(replace(rest, ' ', ''), chr(8204), '') AS r FROM b),
m AS (SELECT doc_id, min(d * 100 + i) AS best FROM (SELECT doc_id, i, levenshtein(translate(r, '{_CHARS}', '{_BYTES}'), translate(key, '{_CHARS}', '{_BYTES}')) AS d FROM n, k) WHERE d <= 2 GROUP BY doc_id)
SELECT n.doc_id, word || ' ' || rest AS line, CASE WHEN word <> 'نخش' AND len(list_filter(string_split_regex(word || ' ' || rest, '\\s+'), lambda w: w <> '')) BETWEEN 2 AND 5 AND CAST(floor(best / 100) AS BIGINT) <= CASE WHEN length(r) <= 5 THEN 1 ELSE 2 END
  THEN CASE word WHEN 'بخش' THEN 'بخش ' ELSE 'فصل ' END || (SELECT name FROM k WHERE i = best % 100) END AS heading FROM n LEFT JOIN m USING (doc_id)""")
def p19_match_heading(spark, d):
    o = F.array(*[F.lit(x) for x in _ORDINALS])[(F.col("doc_id") % len(_ORDINALS)).cast("int")]
    rows = table(spark, d, "documents").select("doc_id", o.alias("o"), F.floor(F.col("doc_id") / len(_ORDINALS)).alias("q"))
    rows = rows.withColumn("at", (F.col("q") % F.length("o")).cast("int"))
    wrong = F.concat(F.expr("substring(o, 1, at)"), F.when(F.col("q") % 3 == 2, "ض").otherwise(""), F.expr("substring(o, at + 2)"))
    word = F.when(F.col("q") % 4 == 0, "فصل").when(F.col("q") % 4 == 1, "نصل").when(F.col("q") % 4 == 2, "بخش").otherwise("نخش")
    rows = rows.select("doc_id", F.concat(word, F.lit(" "), F.when(F.col("q") % 3 == 0, F.col("o")).otherwise(wrong)).alias("line"))
    return rows.withColumn("heading", H.match_heading(F.col("line")))


_TITLED = f"t AS (SELECT page, line_no, (line_no % 12) || CASE line_no % 3 WHEN 0 THEN '- ' WHEN 1 THEN ': ' ELSE ' ' END || translate(lower(text), '{T.LATIN}', '{T.STAND_IN}') AS s FROM lines), u AS (SELECT *, regexp_replace(s, '{_NUMBER}', '') AS r FROM t)"


@query(f"""{LINES_SQL}, {_TITLED}
SELECT page, line_no, CASE WHEN regexp_matches(r, '^[\\x{{0600}}-\\x{{06FF}}]') AND len(regexp_extract_all(r, '[\\x{{0621}}-\\x{{064A}}\\x{{067E}}-\\x{{06D3}}]')) >= 3 AND len(string_split_regex(trim(r, ' '), '\\s+')) <= 6 AND NOT regexp_matches(r, '[0-9۰-۹٠-٩]')
  AND NOT regexp_matches(trim(r, ' '), '[.!،,:؛]$') AND line_no % 12 > 0 THEN translate(CAST(line_no % 12 AS VARCHAR), '{T.LATIN_DIGITS}', '{T.PERSIAN_DIGITS}') || '- ' || trim(r, ' ') END AS title FROM u""")
def p21_numbered_titles(spark, d):
    mark = F.when(F.col("line_no") % 3 == 0, "- ").when(F.col("line_no") % 3 == 1, ": ").otherwise(" ")
    s = F.concat((F.col("line_no") % 12).cast("string"), mark, F.col("text"))
    return lines_fa(spark, d).select("page", "line_no", T.numbered_title(s).alias("title"))


@query()
def p23_canonical(spark, d):
    @F.pandas_udf("string")
    def run(x):
        return x.map(lambda t: None if t is None else D.canonical(t))

    return fa(spark, d).select("doc_id", run("s").alias("s"))


@query()
def p26_display(spark, d):
    """Lines in stand-in letters with every third word left Latin, as they are shown."""
    words = F.split("text", " ")
    mixed = F.array_join(F.transform(words, lambda w, i: F.when(i % 3 == 0, w).otherwise(T.stand_in(w))), " ")
    return lines(spark, d).select("page", "line_no", D.display(mixed, "R").alias("shown"))


@query(f"""{LINES_SQL}, {_BOXES}, c AS (SELECT page, line_no, min(x0) AS a, min(y0) AS b, max(x1) AS c, max(y1) AS e, CAST(2000 AS INTEGER) AS w, CAST(9000 AS INTEGER) AS h FROM wb GROUP BY ALL)
SELECT page, line_no, greatest(0, a - 16) AS x0, greatest(0, b - greatest(8, (e - b) // 6)) AS y0, least(w, c + 16) AS x1, least(h, e + greatest(8, (e - b) // 6)) AS y1 FROM c""")
def p27_crop_boxes(spark, d):
    return L.crop_boxes(word_boxes(spark, d).withColumns({"width": F.lit(2000), "height": F.lit(9000)}))


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN CASE WHEN n_chars > 500 THEN 'line' ELSE 'page' END WHEN 1 THEN 'page' ELSE 'engine' END AS reader,
'engine fas' AS found_by, CASE doc_id % 3 WHEN 0 THEN CASE WHEN n_chars > 500 THEN 'line' ELSE 'engine fas, whole pages' END WHEN 1 THEN 'engine fas, whole pages' ELSE 'engine fas' END AS read_by FROM documents""")
def p29_readers(spark, d):
    choice = F.when(F.col("doc_id") % 3 == 0, "auto").when(F.col("doc_id") % 3 == 1, "page").otherwise("engine")
    kind = F.when(F.col("n_chars") > 500, "scan").otherwise("exported")
    rows = table(spark, d, "documents").select("doc_id", L.reader_for(choice, kind).alias("reader"))
    return rows.withColumn("x", L.described(F.col("reader"), F.lit("engine"), F.lit("fas"))).select("doc_id", "reader", F.col("x.lines_found_by").alias("found_by"), F.col("x.read_by").alias("read_by"))


@query(f"""{LINES_SQL}, m AS (SELECT book, page, avg(conf) AS c FROM lines GROUP BY ALL)
SELECT book, page, CASE WHEN c < 70 THEN 'Low reading confidence (' || printf('%.0f', c) || ', usually 80-87): expect many misread letters.' END AS message FROM m WHERE c * 2 <> floor(c * 2)""")
def p31_messages(spark, d):
    m = lines(spark, d).groupBy("book", "page").agg(F.avg("conf").alias("c")).where("c * 2 <> floor(c * 2)")  # halves are rounded in two ways
    return m.select("book", "page", L.confidence_message(F.col("c")).alias("message"))


@query(f"{LINES_SQL}, h AS (SELECT page, line_no, y0, y0 + length(text) AS y1, text FROM lines) SELECT page, line_no FROM h WHERE y1 - y0 BETWEEN 12 AND 400 AND regexp_matches(text, '[0-9]')")
def f06_line_heights(spark, d):
    rows = lines(spark, d).withColumn("y1", F.col("y0") + F.length("text"))
    return rows.where(L.line_height_fits(F.col("y0"), F.col("y1")) & L.has_letters(F.col("text"))).select("page", "line_no")


@query(f"""{LINES_SQL}, {_BOXES}, w AS (SELECT page, line_no, x0, y0, x1, y1, 1200 AS lx0, y0 - page % 2 AS ly0, 2000 AS lx1, y1 - page % 3 AS ly1 FROM wb),
g AS (SELECT page, line_no, x0, y0, x1, y1 FROM w WHERE lx0 <= x0 AND ly0 <= y0 AND x1 <= lx1 AND y1 <= ly1)
SELECT * FROM g UNION ALL SELECT DISTINCT page, line_no, lx0, ly0, lx1, ly1 FROM w WHERE NOT EXISTS (FROM g WHERE g.page = w.page AND g.line_no = w.line_no)""")
def f13_words_inside(spark, d):
    rows = word_boxes(spark, d)
    return L.words_inside(rows.withColumns({"lx0": F.lit(1200), "ly0": (F.col("y0") - F.col("page") % 2).cast("int"), "lx1": F.lit(2000), "ly1": (F.col("y1") - F.col("page") % 3).cast("int")})).select("page", "line_no", *[F.col(c).cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")])


@query()
def f14_flagged_words(spark, d):
    rows = table(spark, d, "benchmark").select(F.col("item_id").cast("long").alias("page"), F.lit(0).alias("line_no"), F.posexplode(F.split(T.stand_in(F.col("text")), "\\s+")).alias("word_no", "text"))
    return L.flagged_words(rows.withColumn("conf", 50 + F.col("word_no") % 50), a11_vocabulary(spark, d)).withColumn("sugg", F.array_join("sugg", ","))


@query(f"{LINES_SQL}, m AS (SELECT book, page, avg(conf) AS mean_conf FROM lines GROUP BY ALL) SELECT book, array_to_string(list_sort(list(page)), ',') AS pages FROM m WHERE mean_conf < 80 GROUP BY book")
def f15_low_pages(spark, d):
    m = lines(spark, d).groupBy("book", "page").agg(F.avg("conf").alias("mean_conf"))
    return L.low_pages(m).select("book", F.array_join("pages", ",").alias("pages"))


@query("SELECT doc_id, coalesce(lang <> CASE WHEN doc_id % 4 > 0 THEN 'en' END, false) AS mismatch FROM documents")
def f16_script_mismatch(spark, d):
    return table(spark, d, "documents").select("doc_id", L.script_mismatch(F.col("lang"), F.when(F.col("doc_id") % 4 > 0, "en")).alias("mismatch"))


@query()
def j06_prefilled(spark, d):
    rows = table(spark, d, "benchmark").select(F.col("item_id").cast("long").alias("page"), F.posexplode(F.split(T.stand_in(F.col("text")), " ")).alias("line_no", "text"))
    return L.prefilled(rows.withColumn("text", F.replace("text", F.lit("ه"), F.lit("خ"))), rows.select("page", "text"))


def contents_rows(spark, d):
    """Lines as paragraphs, of which those of every fifth page stand on a sparse one."""
    rows = lines_fa(spark, d)
    return rows.select("book", (F.col("page") * 100000 + F.col("line_no")).alias("para_no"), F.concat((F.col("line_no") % 30).cast("string"), F.lit("- "), "text", F.lit(" ... "), (F.col("page") % 90).cast("string")).alias("text"), (F.col("line_no") % 11 == 5).alias("heading"), (F.col("page") % 5 == 0).alias("sparse"), "conf")


@query(f"""{LINES_SQL}, f AS (SELECT book, line_no, page, conf, (line_no % 30) || '- ' || translate(lower(text), '{T.LATIN}', '{T.STAND_IN}') || ' ... ' || (page % 90) AS s FROM lines WHERE page % 5 = 0 AND line_no % 11 <> 5),
e AS (SELECT book, trim(regexp_extract(s, '^\\s*(?:[۰-۹0-9]{{1,3}}|ا)?\\s*[-–—ـ:.)]?\\s*(.*?)[\\s.…_ـ]*[۰-۹0-9]*\\s*$', 1), ' :.') AS entry, CAST(conf AS DOUBLE) AS conf FROM f),
g AS (SELECT * FROM e WHERE len(regexp_extract_all(translate(entry, 'يىكـ', 'ییک'), '[\\x{{0621}}-\\x{{064A}}\\x{{067E}}-\\x{{06D3}}]')) >= 3 AND len(string_split_regex(entry, '\\s+')) <= 10)
SELECT book, entry, conf FROM g WHERE book IN (SELECT book FROM g GROUP BY book HAVING count(*) >= 4)""")
def j09_contents_entries(spark, d):
    return H.contents_entries(contents_rows(spark, d))


@query()
def j08_apply_contents(spark, d):
    rows = table(spark, d, "benchmark").select((F.col("item_id").cast("long") % 20).alias("book"), (F.col("item_id").cast("long") * 2).alias("para_no"), F.array_join(F.slice(F.split(T.stand_in(F.col("text")), "\\s+"), 1, 4), " ").alias("s"))
    contents = rows.select("book", "para_no", F.concat((F.col("para_no") % 90 + 1).cast("string"), F.lit("- "), "s").alias("text"), F.lit(False).alias("heading"), F.lit(True).alias("sparse"), F.lit(90.0).alias("conf"))
    read = rows.select("book", (F.col("para_no") + 1).alias("para_no"), F.replace("s", F.lit("ه"), F.lit("خ")).alias("text"), (F.col("para_no") % 4 == 0).alias("heading"), F.lit(False).alias("sparse"), F.lit(60.0).alias("conf"))
    return H.apply_contents(contents.unionByName(read))


@query()
def a13_compare_in_full(spark, d):
    return R.compare_in_full(pairs(spark, d)).drop("edits", "mismatches")


@query()
def j17_spacing(spark, d):
    return pairs(spark, d).select("id", R.spacing(F.col("reference"), F.col("other")).alias("s")).select("id", "s.*")


@query()
def a16_score_lines(spark, d):
    rows = pairs(spark, d).select(F.col("id").cast("string").alias("line_id"), "reference", F.col("other").alias("read"))
    return R.score_lines(rows.withColumn("reader", F.lit("worse")).unionByName(rows.withColumn("read", F.col("reference")).withColumn("reader", F.lit("exact"))))


@query()
def a17_score_pages(spark, d):
    return R.score_pages(pairs(spark, d).select(F.col("id").alias("page"), "reference", F.col("other").alias("read")))


@query("""WITH p AS (SELECT page_id % 50 AS image, CAST(length(html) % 256 AS INTEGER) AS level, 1 AS n FROM pages), g AS (SELECT image, level, CAST(sum(n) AS DOUBLE) AS n FROM p GROUP BY ALL),
r AS (SELECT image, level, sum(n) OVER o AS w, sum(n * level) OVER o AS s, sum(n) OVER a AS tw, sum(n * level) OVER a AS ts FROM g WINDOW o AS (PARTITION BY image ORDER BY level), a AS (PARTITION BY image)),
v AS (SELECT image, level, CASE WHEN w < tw THEN w * (tw - w) * (s / w - (ts - s) / (tw - w)) * (s / w - (ts - s) / (tw - w)) END AS v FROM r),
b AS (SELECT image, level, row_number() OVER (PARTITION BY image ORDER BY v DESC, level) AS k FROM v WHERE v > 0)
SELECT image, coalesce(level, 128) AS threshold FROM (SELECT DISTINCT image FROM g) LEFT JOIN (FROM b WHERE k = 1) USING (image)""")
def a21_otsu(spark, d):
    return L.otsu(table(spark, d, "pages").select((F.col("page_id") % 50).alias("image"), (F.length("html") % 256).cast("int").alias("level"), F.lit(1).alias("n")))


@query("""WITH r AS (SELECT event_id AS seq, 'r' || user_id % 9 AS reader, 'd' || event_id // 1000 AS data, round(value / 1000, 6) AS letters_wrong FROM events), n AS (SELECT arg_max(data, seq) AS data FROM r)
SELECT reader, max(seq) AS seq, data, arg_max(letters_wrong, seq) AS letters_wrong FROM r JOIN n USING (data) GROUP BY ALL""")
def a22_newest_scores(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("r"), F.col("user_id") % 9).alias("reader"), F.concat(F.lit("d"), F.floor(F.col("event_id") / 1000)).alias("data"), F.round(F.col("value") / 1000, 6).alias("letters_wrong"))
    return R.newest_scores(rows)


@query("""WITH l AS (SELECT doc_id % 97 AS page, 'l' || doc_id AS line_id, CASE WHEN doc_id % 97 % 5 = 0 THEN 'test' ELSE 'train' END AS split, doc_id % 2 AS new FROM documents), n AS (SELECT * FROM l WHERE new = 1 AND page % 3 = 0),
u AS (SELECT line_id, page, split FROM l WHERE new = 0 AND page NOT IN (SELECT page FROM n) UNION ALL SELECT line_id, page, split FROM n) SELECT *, CAST(row_number() OVER (ORDER BY split <> 'test', page, line_id) AS INTEGER) AS place FROM u""")
def k07_set_index(spark, d):
    page = F.col("doc_id") % 97
    rows = table(spark, d, "documents").select(F.concat(F.lit("l"), "doc_id").alias("line_id"), page.alias("page"), F.when(page % 5 == 0, "test").otherwise("train").alias("split"), (F.col("doc_id") % 2).alias("new"))
    return L.set_index(rows.where("new = 0").drop("new"), rows.where("new = 1 and page % 3 = 0").drop("new"))


@query(f"{LINES_SQL}, {_BOXES}, t AS (SELECT page, line_no, string_split(text, ' ') AS w, conf FROM lines) SELECT t.page, t.line_no, array_to_string(w, ' ') AS text, CAST(any_value(conf) AS DOUBLE) AS conf, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM t JOIN wb USING (page, line_no) GROUP BY ALL")
def i02_lines_of_words(spark, d):
    return L.lines_of_words(word_boxes(spark, d, texts=True))


@query("SELECT doc_id AS path, sha256(coalesce(text, '')) AS digest FROM documents")
def s02_digests(spark, d):
    files = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    return S.book_digests(files).select("path", "digest")


@query(f"{LINES_SQL} SELECT page, line_no, k AS word_no, w AS text, CAST(100 * k AS INTEGER) AS x0, y0, CAST(100 * k + 90 AS INTEGER) AS x1, y1, CAST(conf AS DOUBLE) AS conf FROM (SELECT *, unnest(string_split(text, ' ')) AS w, unnest(range(0, len(string_split(text, ' ')))) AS k FROM (SELECT page, line_no, text, y0, y1, conf FROM lines)) WHERE trim(w) <> '' ")
def s08_reader_words(spark, d):
    rows = lines(spark, d).withColumn("line", F.col("line_no") + 1)
    heads = rows.select("page", (F.col("line") * 100000).alias("seq"), F.format_string("4\t1\t1\t1\t%d\t0\t0\t%d\t900\t40\t-1\t", "line", "y0").alias("row"))
    words = rows.select("page", "line", "y0", "conf", F.posexplode(F.split("text", " ")).alias("k", "w"))
    words = words.select("page", (F.col("line") * 100000 + F.col("k") + 1).alias("seq"), F.concat_ws("\t", F.lit("5\t1\t1\t1"), "line", "k", 100 * F.col("k"), "y0", F.lit("90\t40"), "conf", "w").alias("row"))
    # lines are found in their order; they are numbered from one, those without words too
    return S.reader_words(S.parse_table(heads.unionByName(words))).withColumn("line_no", F.col("line_no") - 1)


@query()
def k03_paragraph_texts(spark, d):
    return K.paragraph_texts(K.persian_paragraphs(book_paragraphs(spark, d)))


@query("""WITH p AS (SELECT source AS book, doc_id AS page, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS done, count(*) OVER (PARTITION BY source) AS total FROM documents)
SELECT book, done AS seq, '{"event":"page","page":' || page || ',"done":' || done || ',"total":' || total || ',"cached":false}' AS event FROM p
UNION ALL SELECT book, 0, '{"event":"start","pages":' || count(*) || '}' FROM p GROUP BY book UNION ALL SELECT book, count(*) + 1, '{"event":"done","ok":true}' FROM p GROUP BY book""")
def k06_progress(spark, d):
    return S.progress(table(spark, d, "documents").select(F.col("source").alias("book"), F.col("doc_id").alias("page"), F.lit(False).alias("cached")))


@query()
def w15_script_check(spark, d):
    from pyspark.sql.window import Window

    nth = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    rows = table(spark, d, "documents").select(F.col("source").alias("book"), nth.alias("nth"), F.when(F.col("doc_id") % 3 > 0, F.col("lang")).alias("script"))
    return L.script_check(rows.where("nth <= 6"))
