"""A corpus pipeline of five stages over `documents`; each stage's result is written and read again by the next.

Every stage gives no rows for an empty table, ignores columns other than those of documents and takes texts of any length
whole. Null and empty texts, repeated rows and ties: see each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folianth.llm.decontaminate import decontaminate
from folianth.llm.jaccard_join import jaccard_join
from folianth.llm.language import document_rows, fit_text_model, identify
from folianth.llm.packing import pack
from folianth.llm.pii import personal_data
from folianth.llm.queries import tokenizer_path
from folianth.llm.store import drop, materialize, written

#: The packing stage's Python workers keep so few words' ids, since they share an executor with all that ran before.
CACHE_WORDS = 1 << 17
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is accepted. Null and empty texts aren't; of rows that repeat a doc_id all stay if one does;
    rows without a doc_id go."""
    rows = document_rows(docs)
    accepted = identify(rows, fit_text_model(rows)).where("accepted").select(F.col("id").alias("doc_id")).distinct()
    return docs.join(accepted, "doc_id", "left_semi").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group linked by five-word shingles at 0.8. Null and empty texts
    link with nothing and stay; of rows that repeat a doc_id the first by text, then by the other columns, stays."""
    kept = jaccard_join(docs, k=5, percent=80).where("component_id = doc_id").groupBy("doc_id").count()
    kept = materialize(kept, "kept")
    rows = docs.select(*COLUMNS).join(kept.select("doc_id"), "doc_id", "left_semi")
    again = kept.where("count > 1").select("doc_id")
    if again.isEmpty():
        return rows
    first = rows.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("r"))
    return rows.join(again, "doc_id", "left_anti").unionByName(first.select("doc_id", "r.*"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Null and empty texts have none and stay; repeated rows of a doc_id go
    together; rows without a doc_id stay."""
    bad = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated").select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*COLUMNS)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text. Null and empty texts stay as they are,
    repeated rows are judged each."""
    rows = personal_data(docs, with_text=True, carry=["text", "lang", "source", "n_chars"])
    changed = F.col("redacted") != F.coalesce("text", F.lit(""))
    return rows.select("doc_id", F.when(changed, F.col("redacted")).otherwise(F.col("text")).alias("text"), "lang", "source", F.when(changed, F.char_length("redacted").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences; a null or empty text is the end's id alone, repeated rows are
    packed each, ties in the order of a hash of the pieces."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"), cache_words=CACHE_WORDS)


STAGES = [
    ("language ID", language_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("PII", personal_data_stage),
    ("best-fit packing", packing_stage),
]

#: Language ID, the field of the PII stage and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = written()
        last, docs = docs, materialize(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
        # what the stage wrote on its way isn't read any more, nor is its input
        drop(last, *[t for t in written() if t is not docs and not any(t is b for b in before)])
    return STAGES[-1][1](spark, docs, sf_dir)
