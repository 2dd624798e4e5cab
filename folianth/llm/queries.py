"""The registered queries over the operators of this subpackage, with their parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folianth.llm.decontaminate import decontaminate

    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("items")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folianth.llm.language import document_rows, fit_text_model, identify

    rows = document_rows(_table(spark, sf_dir, "documents"))
    return identify(rows, fit_text_model(rows)).withColumnRenamed("id", "doc_id")


def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folianth.llm.language import document_rows, fit_text_model, identify, page_rows

    model = fit_text_model(document_rows(_table(spark, sf_dir, "documents")))
    return identify(page_rows(_table(spark, sf_dir, "pages")), model).withColumnRenamed("id", "page_id")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folianth.llm.url_filter import url_filter

    return url_filter(_table(spark, sf_dir, "pages"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folianth.llm.jaccard_join import jaccard_join

    return jaccard_join(_table(spark, sf_dir, "documents"), k=4, percent=85)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folianth.llm.token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folianth.llm.substring_dedup import substring_dedup

    return substring_dedup(_table(spark, sf_dir, "documents"), window=13)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folianth.llm.quality import quality

    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folianth.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), limit=4096, end_id=1)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folianth.llm.pii import personal_data

    return personal_data(_table(spark, sf_dir, "documents"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folianth.llm.nearest import nearest_neighbours

    vectors = _table(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, vectors.where("vec_id % 50 = 0"), k=5)


_OPERATORS = (op1_decontaminate, op2_language, op3_url_filter, op4_jaccard_join, op5_token_counts, op6_substring_dedup, op7_quality, op8_packing, op9_pii, op10_nearest)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (*_OPERATORS, language_of_pages)}


def oracle_sql() -> dict[str, str]:
    from folianth.llm.url_filter import SQL

    return {"op3_url_filter": SQL}
