"""Language identification by Bayesian fusion of text, declared markup, address suffix and host (operator 2)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folianth.llm.blocks import bounded, small_batches, text_buffers
from folianth.llm.store import materialize

#: Hashed space of byte trigrams.
FEATURES = 1 << 14
#: Languages whose counts a task holds at once; then they are given out and begun anew.
LANGUAGES_AT_ONCE = 64
#: A text's evidence counts as that of at most so many trigrams, which aren't independent of each other.
TRIGRAMS = 150.0
#: Weights, in observations, of the next level of a smoothed distribution.
HOST_WEIGHT, DOMAIN_WEIGHT, GLOBAL_WEIGHT = 20.0, 50.0, 1.0
BROADCAST_ROWS = 500_000


def trigram_ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed trigrams of letters and spaces, the text each belongs to, and how many each text has."""
    x = data[offsets[0] : offsets[-1]].astype(np.uint32)
    offsets = offsets - offsets[0]
    upper = (x >= 65) & (x <= 90)
    letter = upper | ((x >= 97) & (x <= 122)) | (x >= 128)
    x = np.where(letter, x + 32 * upper, 32).astype(np.uint32)
    n = max(0, len(x) - 2)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    h = (x[:n] << np.uint32(16)) | (x[1 : n + 1] << np.uint32(8)) | x[2 : n + 2]
    keep = (doc[:n] == doc[2 : n + 2]) & (letter[:n] | letter[1 : n + 1] | letter[2 : n + 2])
    h, doc = h[keep], doc[:n][keep]
    h *= np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA77)
    return (h >> np.uint32(18)).astype(np.int64), doc, np.bincount(doc, minlength=len(offsets) - 1)


def fit_text_model(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and log probabilities of trigrams, from every row of (text, declared)."""
    languages = [r.declared for r in rows.where("declared is not null and declared <> ''").groupBy("declared").count().orderBy(F.desc("count"), "declared").collect()]
    if not languages:
        return [], np.zeros((0, FEATURES))
    shared = rows.sparkSession.sparkContext.broadcast({x: i for i, x in enumerate(languages)})

    def count(batches):
        number, have = shared.value, {}

        def given_out():
            for i, n in have.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, np.int32)), pa.array(at.astype(np.int32)), pa.array(n[at])], ["language", "feature", "n"])
            have.clear()

        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            names = np.array([number.get(x, -1) for x in batch.column(1).to_pylist()], np.int64)
            for a, b in bounded(offsets):
                ids, doc, _ = trigram_ids(data, offsets[a : b + 1])
                of = names[a:b][doc]
                order = np.argsort(of, kind="stable")
                of, ids = of[order], ids[order]
                found, starts = np.unique(of, return_index=True)
                for i, x, y in zip(found.tolist(), starts.tolist(), [*starts[1:].tolist(), len(of)], strict=True):
                    if i >= 0:
                        if i not in have and len(have) >= LANGUAGES_AT_ONCE:
                            yield from given_out()
                        have[i] = have.get(i, 0) + np.bincount(ids[x:y], minlength=FEATURES)
        yield from given_out()

    counts = np.zeros((len(languages), FEATURES))
    n = rows.select("text", "declared").mapInArrow(count, "language int, feature int, n long").groupBy("language", "feature").agg(F.sum("n").alias("n")).toArrow()
    counts[n["language"].to_numpy(), n["feature"].to_numpy()] = n["n"].to_numpy()
    return languages, np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * FEATURES))


def _shares(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Counts of the text's language by keys, as a map."""
    n = rows.groupBy(*keys, "guess").count()
    return n.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("guess", F.col("count").cast("double")))).alias(name), F.sum("count").cast("double").alias(f"{name}_n"))


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(F.broadcast(right) if right.count() <= BROADCAST_ROWS else right, keys, "left")


def identify(rows: DataFrame, model: tuple[list[str], np.ndarray], least: float = 0.5) -> DataFrame:
    """rows (id, text, declared, suffix, host, domain) with language, probability, evidence (trigrams) and accepted.

    The text's likelihood is tempered to TRIGRAMS. The prior is the host's distribution of languages smoothed towards its
    domain's, and that towards all rows', all counted from what the texts alone say. Declared language and address
    suffix enter by how often each is met with a language. Null or empty texts leave the other evidence and are not
    accepted; nulls in the other columns are no evidence. accepted: the best language's probability is at least `least`
    and the text isn't less likely under it than under equally likely trigrams. Repeated rows are judged each; without
    any declared language in the model nothing is accepted. What a row's own text says isn't counted where the row is
    judged. Of equally likely languages the one that more rows declare wins, then the first by name. An empty table
    gives no rows.
    """
    languages, logs = model
    spark = rows.sparkSession
    if not languages:
        return rows.select("id", F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("probability"), F.lit(0).cast("long").alias("evidence"), F.lit(False).alias("accepted"))
    shared = spark.sparkContext.broadcast((languages, np.ascontiguousarray(logs.T)))

    def likelihood(batches):
        languages, by_feature = shared.value
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for a, b in bounded(offsets):
                ids, doc, n = trigram_ids(data, offsets[a : b + 1])
                sums = np.stack([np.bincount(doc, weights=by_feature[ids, i], minlength=b - a) for i in range(len(languages))], axis=1)
                mean = sums / np.maximum(n, 1)[:, None]
                guess = mean.argmax(axis=1)
                rest = [batch.column(i).slice(a, b - a) for i in (0, 2, 3, 4, 5)]
                names = pa.array([languages[g] if m else None for g, m in zip(guess.tolist(), n.tolist(), strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([*rest, pa.array(list(mean), pa.list_(pa.float64())), names, pa.array(n.astype(np.int64))], ["id", "declared", "suffix", "host", "domain", "mean", "guess", "evidence"])

    base = rows.select(F.col("id").cast("long").alias("id"), "text", "declared", "suffix", "host", "domain")
    seen = materialize(base.mapInArrow(likelihood, "id long, declared string, suffix string, host string, domain string, mean array<double>, guess string, evidence long"), "likelihoods")
    known = seen.where("guess is not null")
    every = {r.guess: float(r["count"]) for r in known.groupBy("guess").count().collect()}  # a row for each language
    total = sum(every.values())
    prior = {x: (every.get(x, 0.0) + GLOBAL_WEIGHT) / (total + GLOBAL_WEIGHT * len(languages)) for x in languages}

    def given_language(column: str) -> DataFrame:
        """How often the column's value is met with each language, as a map by language."""
        n = known.where(F.col(column).isNotNull()).groupBy(column, "guess").agg(F.count("*").cast("double").alias("n"))
        return n.groupBy(column).agg(F.map_from_entries(F.collect_list(F.struct("guess", "n"))).alias(f"{column}_given"))

    out = _joined(seen, _shares(known.where("host is not null"), ["host"], "by_host"), ["host"])
    out = _joined(out, _shares(known.where("domain is not null"), ["domain"], "by_domain"), ["domain"])
    out = _joined(out, given_language("declared"), ["declared"])
    out = _joined(out, given_language("suffix"), ["suffix"])

    # one expression over the array of languages, so that the plan doesn't grow with them
    named, of_all = F.lit(languages), F.lit([prior[x] for x in languages])
    met_in_all = F.lit([every.get(x, 0.0) for x in languages])

    # a row's own guess is in all counts; it is taken off where the row itself is judged
    def own(x: Column) -> Column:
        return F.when(F.col("guess") == x, 1.0).otherwise(0.0)

    def level(name: str, x: Column, above: Column, weight: float) -> Column:
        count = F.greatest(F.coalesce(F.element_at(F.col(name), x), F.lit(0.0)) - own(x), F.lit(0.0))
        rows = F.greatest(F.coalesce(F.col(f"{name}_n"), F.lit(0.0)) - F.when(F.col("guess").isNotNull(), 1.0).otherwise(0.0), F.lit(0.0))
        return (count + weight * above) / (rows + weight)

    def met(column: str, x: Column, i: Column) -> Column:
        count = F.greatest(F.coalesce(F.element_at(F.col(f"{column}_given"), x), F.lit(0.0)) - own(x), F.lit(0.0))
        return F.when(F.col(column).isNull(), F.lit(0.0)).otherwise(F.log((count + 0.5) / (met_in_all[i] - own(x) + 1)))

    weight = F.least(F.col("evidence").cast("double"), F.lit(TRIGRAMS))

    def log_of(x: Column, i: Column) -> Column:
        host = level("by_host", x, level("by_domain", x, of_all[i], DOMAIN_WEIGHT), HOST_WEIGHT)
        return F.col("mean")[i] * weight + F.log(host) + met("declared", x, i) + met("suffix", x, i)

    out = out.withColumn("logs", F.transform(named, log_of)).withColumn("top", F.array_max("logs"))
    out = out.withColumn("at", F.array_position("logs", F.col("top")).cast("int"))
    share = F.lit(1.0) / F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    likely = F.element_at("mean", F.col("at")) > -float(np.log(FEATURES))
    return out.select("id", F.element_at(named, F.col("at")).alias("language"), share.alias("probability"), "evidence", ((F.col("evidence") > 0) & (share >= least) & likely).alias("accepted"))


def document_rows(docs: DataFrame) -> DataFrame:
    """Evidence of documents: lang is what is declared, source the host; they have no address."""
    none = F.lit(None).cast("string")
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.lower("lang").alias("declared"), none.alias("suffix"), F.col("source").cast("string").alias("host"), none.alias("domain"))


def page_rows(pages: DataFrame) -> DataFrame:
    """Evidence of web pages: the lang attribute, the host and its last two labels, the last label or a language that
    begins the path as suffix, and the text without scripts, styles and tags."""
    host = F.lower(F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)", 1))
    text = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " "), r"(?s)<[^>]*>|&[a-z]+;", " ")
    declared = F.lower(F.regexp_extract("html", r"(?i)<html[^>]*\blang=[\"']?([a-z]+)", 1))
    suffix = F.concat(F.regexp_extract(host, r"([^.]+)$", 1), F.lit("/"), F.regexp_extract("url", r"(?i)://[^/?#]*/([a-z]{2})(?:[/?#]|$)", 1))
    empty = lambda c: F.when(c != "", c)
    return pages.select(F.col("page_id").cast("long").alias("id"), text.alias("text"), empty(declared).alias("declared"), suffix.alias("suffix"), empty(host).alias("host"), empty(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)).alias("domain"))

