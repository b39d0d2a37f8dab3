"""The thin queries of the corpus operators, with their production parameters, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm.common import documents, table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidewell.llm.token_counts import token_counts

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    return token_counts(documents(spark, sf_dir), model)


@query
def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.mixing import mix

    mixed = mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", (mixed.size * mixed.copies).cast("long").alias("taken"), "copies")


def _op5() -> str:
    from tidewell.llm.mixing import ORACLE

    return ORACLE


ORACLES["op5_mix_sources"] = _op5()


@query
def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tidewell.llm.sharding import histogram_shards

    docs = documents(spark, sf_dir).select("doc_id", "text")
    put = histogram_shards(docs.withColumn("text_crc32", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))), 40)
    return put.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.warc import deduplicated_archives

    return deduplicated_archives(table(spark, sf_dir, "pages"))


def _op9() -> str:
    from tidewell.llm.warc import ORACLE

    return ORACLE


ORACLES["op9_warc_revisits"] = _op9()


@query
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.url_filter import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"))


@query
def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.fingerprints import compare_with_next

    return compare_with_next(documents(spark, sf_dir))


@query
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.jaccard import jaccard_join

    return jaccard_join(documents(spark, sf_dir))


def _op6() -> str:
    from tidewell.llm.jaccard import ORACLE

    return ORACLE


ORACLES["op6_jaccard_join"] = _op6()


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tidewell.llm import toxicity
    from tidewell.llm.common import crc_mod

    docs = documents(spark, sf_dir)
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tidewell.llm import quality
    from tidewell.llm.common import crc_mod

    docs = documents(spark, sf_dir)
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


@query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.decontamination import contaminated

    return contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
