"""Predicates and repairs of lines, front matter, scripts, and statistics over runs and matched lines."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folianth.functions import text as T

# Words of credit lines, and scripts by language code.
CREDITS = "الکترونیک|وب ?لاگ|وب ?گاه|اهتمام|تهیه|توسط|نشر|ناشر|چاپ|جایزه|کتابخانه|سایت|تایپ|تنظیم|تبدیل|کاری از|صفحه ?آرایی|ویراست|www|http|\\.com"
SCRIPTS = {"fas": "Arabic", "ara": "Arabic", "urd": "Arabic", "pus": "Arabic", "snd": "Arabic", "uig": "Arabic", "heb": "Hebrew", "yid": "Hebrew"}
#: Marks around a title.
TITLE_EDGE = "[ «»\"'()\\[\\]\\-–—ـ:،.]+"
_EDGE_MARKS = " «»\"'()[]-–—ـ:،."
_PERSIAN = "[ء-يپ-ۓ]"


def debris(text: Column, conf: Column) -> Column:
    """No letters, or one with a confidence under 50; none or 0 counts as 100."""
    sure = F.coalesce(F.nullif(conf.cast("double"), F.lit(0.0)), F.lit(100.0))
    # most lines have two letters, which their first characters tell
    return ~(text.rlike("\\p{L}[^\\p{L}]*+\\p{L}") | (text.rlike("\\p{L}") & (sure >= 50)))


def kept_by_rules(lines: DataFrame, drop: str | None = None, least: float | None = None) -> DataFrame:
    """Lines that are no debris, don't hold the pattern and whose confidence, where known, isn't too low."""
    out = lines
    if least is not None:
        out = out.where(F.col("conf").isNull() | (F.col("conf") >= least))
    # cleaning leaves the letters as they are, so debris goes before it
    out = out.where(~debris(F.replace("text", F.lit("ـ"), F.lit("")), F.col("conf")))
    out = T.computed(out, "clean", T.clean_line(F.col("text")))
    return out.where(~F.col("clean").rlike(drop)) if drop else out


def title_form(s: Column) -> Column:
    """A line as a title: no marks around it, no year at its end, no parenthesis without its partner."""
    s = F.btrim(T.normalize_text(s), F.lit(_EDGE_MARKS))
    year = F.substring(s, -1, 1).rlike("[۰-۹0-9\\r\\n\\x{85}\\x{2028}\\x{2029}]")
    s = F.trim(F.when(year, F.regexp_replace(s, "\\s*[۰-۹0-9]{4}$", "")).otherwise(s))
    uneven = (s.contains("(") | s.contains(")")) & (F.regexp_count(s, F.lit("\\(")) != F.regexp_count(s, F.lit("\\)")))
    return F.when(uneven, F.trim(F.regexp_replace(s, "[()]", ""))).otherwise(s)


def usable_title(text: Column, conf: Column, most_words: int) -> Column:
    title = title_form(text)
    persian = title.rlike(f"{_PERSIAN}[^{_PERSIAN[1:]}*+{_PERSIAN}")
    return persian & (F.size(F.split(title, "\\s+", most_words + 1)) <= most_words) & (F.coalesce(conf.cast("double"), F.lit(0.0)) >= 40) & ~text.rlike(f"(?i){CREDITS}")


def reader_scale(conf: Column) -> Column:
    """A line reader's confidence, which crowds near 100, on the scale of the page reader."""
    return F.bround(F.greatest(F.lit(0.0), 100 - 10 * (100 - conf.cast("double"))), 1)


def expected_script(languages: Column) -> Column:
    """The script of languages joined by +; null where they differ or one isn't known."""
    by_code = F.create_map(*[F.lit(x) for e in SCRIPTS.items() for x in e])
    kinds = F.array_distinct(F.transform(F.split(languages, "\\+"), lambda c: F.try_element_at(by_code, c)))
    return F.when(F.size(kinds) == 1, kinds[0])


def script_answer(output: Column) -> Column:
    """The value of the first `Script:` row; null where it is blank or missing."""
    value = F.trim(F.regexp_extract(output, "(?m)^[ \\t]*Script[ \\t]*:([^\\r\\n]*)", 1))
    return F.nullif(value, F.lit(""))


def mirrored_parentheses(s: Column) -> Column:
    """Where a text opens more than it closes, the second of two openings with no parenthesis between them closes."""
    more = F.regexp_count(s, F.lit("\\(")) > F.regexp_count(s, F.lit("\\)"))
    return F.when(more, F.regexp_replace(s, "\\(([^()]*)\\(", "($1)")).otherwise(s)


def unopened_as_commas(s: str) -> str:
    """A closing guillemet that brings the balance to a new low has no opening one: it is a comma."""
    marks = [(m.start(), m.group()) for m in re.finditer("[«»]", s)]
    if not marks:
        return s
    balance = np.cumsum([1 if c == "«" else -1 for _, c in marks])
    low = np.minimum.accumulate(np.concatenate([[0], balance]))[:-1]
    chars = list(s)
    for k in np.flatnonzero(balance < low).tolist():
        chars[marks[k][0]] = "،"
    return re.sub(r"،[ \t‌]*(?=[^\s.؛:؟!»?;])", "، ", re.sub(r"[ \t]+،", "،", "".join(chars)))


def unopened_guillemets(s: Column) -> Column:
    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda t: None if t is None else unopened_as_commas(t))

    return run(s)


def page_list(spec: Column) -> Column:
    """Page numbers of a selector in its own order, repeats kept."""
    parts = F.transform(F.split(spec, ","), lambda p: F.sequence(F.split(p, "-")[0].cast("int"), F.element_at(F.split(p, "-"), -1).cast("int")))
    return F.flatten(parts)


def kinds_table(pages: DataFrame, examples: int = 8) -> DataFrame:
    """(book, kind, pages, first, dpi): how many pages of each kind, the first of them, the upper median resolution.

    pages: book, page, kind, dpi. The first pages come by rank, so no group is gathered whole for them."""
    ranked = pages.withColumn("r", F.row_number().over(Window.partitionBy("book", "kind").orderBy("page")))
    by_dpi = pages.where("dpi is not null").groupBy("book", "kind", "dpi").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("book", "kind").orderBy("dpi")
    whole = Window.partitionBy("book", "kind")
    upper = by_dpi.withColumn("seen", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(whole))
    upper = upper.where("seen > floor(all / 2)").groupBy("book", "kind").agg(F.min("dpi").alias("dpi"))
    first = F.array_sort(F.collect_list(F.when(F.col("r") <= examples, F.col("page"))))
    counts = ranked.groupBy("book", "kind").agg(F.count("*").alias("pages"), F.array_join(first, ",").alias("first"))
    return counts.join(upper, ["book", "kind"], "left")


def decode_steps(steps: DataFrame) -> DataFrame:
    """(line, at, label, conf): runs of one label as one letter with its best confidence; label 0 is a blank.

    steps: line, step, label, conf."""
    order = Window.partitionBy("line").orderBy("step")
    new = steps.withColumn("new", F.coalesce((F.col("label") != F.lag("label").over(order)).cast("int"), F.lit(1)))
    run = new.withColumn("run", F.sum("new").over(order))
    return run.where("label <> 0").groupBy("line", "run", "label").agg(F.min("step").alias("at"), F.max("conf").alias("conf")).drop("run")


def line_order(matched: DataFrame) -> DataFrame:
    """(doc, pairs, share): of neighbouring reference lines (i, i + 1) that are both matched, the share whose matches
    follow each other among the matched lines. matched: doc, i, j."""
    placed = matched.withColumn("place", F.row_number().over(Window.partitionBy("doc").orderBy("j")))
    by_line = Window.partitionBy("doc").orderBy("i")
    near = placed.select("doc", "i", "place", F.lead("i").over(by_line).alias("next"), F.lead("place").over(by_line).alias("after")).where("next = i + 1")
    return near.groupBy("doc").agg(F.count("*").alias("pairs"), F.avg((F.col("after") == F.col("place") + 1).cast("int")).alias("share"))


def previous_runs(runs: DataFrame) -> DataFrame:
    """Each run with the value of its reader's run before it. runs: reader, ts, run_id, value."""
    order = Window.partitionBy("reader").orderBy("ts", "run_id")
    return runs.select("reader", "run_id", "value", F.lag("value").over(order).alias("before"))


def page_references(files: DataFrame, lines: DataFrame) -> DataFrame:
    """(page, text, origin): saved texts and pages of the set, of which the set's come first.

    A page of the set counts when all its lines are done or skipped and one is done; its text is that of the done lines.
    files: page, text; lines: page, line_no, status, text."""
    done = F.col("status") == "done"
    decided = F.every(F.coalesce(F.col("status").isin("done", "skip"), F.lit(False))) & F.some(F.coalesce(done, F.lit(False)))
    texts = F.array_sort(F.collect_list(F.when(done, F.struct("line_no", "text"))))
    pages = lines.groupBy("page").agg(decided.alias("decided"), F.array_join(F.transform(texts, lambda e: e["text"]), "\n").alias("own")).where("decided")
    return files.join(pages, "page", "full_outer").select("page", F.coalesce("own", "text").alias("text"), F.when(F.col("own").isNotNull(), "set").otherwise("file").alias("origin"))


def only_best(scores: DataFrame, group: str, holder: str, score: str) -> DataFrame:
    """(group, best): the holder of the least score, null where several have it."""
    least = scores.withColumn("_least", F.min(score).over(Window.partitionBy(group))).where(F.col(score) == F.col("_least"))
    return least.groupBy(group).agg(F.when(F.count("*") == 1, F.max(holder)).alias("best"))
