"""Queries p2 over the atoms, p6 to p8 over the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import mixing, packing, quantiles, splitting
from gridloom.llm.sql import SQL as _SQL
from gridloom.session import materialize, table


def p2_summary(spark: SparkSession, d: str) -> DataFrame:
    """Order statistics of temperature by element and by structure for each load, mergeable over loads."""
    return quantiles.quantile_summary(
        table(spark, d, "model_atom"), ["element", "structure"], "temperature", "load_id"
    ).withColumnRenamed("period", "load_id")


def p2_daily(spark: SparkSession, d: str) -> DataFrame:
    """The same by day of arrival."""
    atom = table(spark, d, "model_atom").withColumn("day", F.to_date("loaded_at"))
    return quantiles.quantile_summary(
        atom, ["element", "structure"], "temperature", "day", percentiles=()
    ).withColumnRenamed("period", "day")


def p2_combined(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles over all loads from the summaries alone, with their rank error."""
    return quantiles.combine(materialize(p2_summary(spark, d)).withColumnRenamed("load_id", "period"))


def _settings(spark: SparkSession, d: str) -> dict[str, int]:
    # a fixed table of three rows
    return {r["setting_name"]: r["tokens"] for r in table(spark, d, "size_setting").collect()}


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every text of the documents with the containers of its pieces."""
    return packing.pack_documents(table(spark, d, "documents"), _settings(spark, d)["container_capacity"])


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers, tokens and the space left unused."""
    return packing.fill_report(p6_containers(spark, d), _settings(spark, d)["container_capacity"])


def p6_texts(spark: SparkSession, d: str) -> DataFrame:
    """Digest of each document's tokens put together again from its containers, with the fullest of these."""
    docs, capacity = table(spark, d, "documents"), _settings(spark, d)["container_capacity"]
    packed = materialize(packing.pack_documents(docs, capacity))
    held = packed.where("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("held"))
    fullest = packed.join(held, "container_id", "left").groupBy("doc_id").agg(
        F.coalesce(F.max("held") <= capacity, F.lit(True)).alias("fits")
    )
    return packing.texts_again(packed, docs).join(fullest, "doc_id").select("doc_id", F.md5("text").alias("digest"), "fits")


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The mixture by shard and slot, as token ranges of documents."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_target"))[0]


def p7_tokens(spark: SparkSession, d: str) -> DataFrame:
    """The mixture's tokens by shard, slot and offset."""
    docs = table(spark, d, "documents")
    return mixing.mixed_tokens(mixing.mix(docs, table(spark, d, "mix_target"))[0], docs)


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares really reached by each source."""
    mixture, plan = mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_target"))
    return mixing.share_report(mixture, plan)


def _corpus(spark: SparkSession, d: str) -> tuple[DataFrame, list[mixing.SourcePlan]]:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_target"), total=mixing.ALL_TOKENS)


def p7_corpus(spark: SparkSession, d: str) -> DataFrame:
    """A mixture as large as all sources together: small ones are repeated up to their caps and then fall short."""
    return _corpus(spark, d)[0]


def p7_corpus_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares, repetitions and shortfalls of the sources in the large mixture."""
    return mixing.share_report(*_corpus(spark, d))


def p8_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every text above the piece limit as overlapping pieces."""
    s = _settings(spark, d)
    return splitting.split_documents(table(spark, d, "documents"), s["piece_limit"], s["piece_overlap"])


def p8_texts(spark: SparkSession, d: str) -> DataFrame:
    """Digest of each document put together again from its pieces without their overlaps (itself where it isn't split), and
    whether all pieces are within the limit."""
    docs, limit = table(spark, d, "documents").select("doc_id", "text"), _settings(spark, d)["piece_limit"]
    whole = splitting.texts_again(p8_pieces(spark, d), limit)
    return docs.join(whole, "doc_id", "left").select(
        "doc_id", F.md5(F.coalesce(whole["whole"], docs["text"])).alias("digest"), F.coalesce("fits", F.lit(True)).alias("fits")
    )


def p8_boundaries(spark: SparkSession, d: str) -> DataFrame:
    """Pieces by the kind of boundary at their end."""
    return p8_pieces(spark, d).groupBy("boundary").agg(
        F.count(F.lit(1)).alias("n_pieces"), F.round(F.avg("n_tokens"), 3).alias("mean_tokens"), F.max("n_tokens").alias("most_tokens")
    )


QUERIES = {
    f.__name__: f for f in (
        p2_summary, p2_daily, p2_combined, p6_containers, p6_fill, p6_texts, p7_mixture, p7_shares, p7_tokens, p7_corpus, p7_corpus_shares,
        p8_pieces, p8_texts, p8_boundaries
    )
}
#: Tokens can't be counted in SQL: p6 to p8 are tested against brute force, and by SQL on the texts put together again.
SQL: dict[str, str] = dict(_SQL)
