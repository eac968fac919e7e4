"""Queries of the text-corpus problems 6 to 8, over whole tables and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keytide.llm import packing, subjects, tokenization
from keytide.plans.registry import Registry
from keytide.session import materialize, spread
from keytide.sources.tables import table

REGISTRY = Registry()


@REGISTRY.add("p6_ids")
def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by byte_bpe_50k."""
    return tokenization.encode_corpus(spread(table(spark, sf_dir, "documents")))


@REGISTRY.add("p6_round_trip", "SELECT doc_id, coalesce(text, '') AS text FROM documents")
def p6_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text, encoded and decoded again."""
    return tokenization.decode_corpus(tokenization.encode_corpus(spread(table(spark, sf_dir, "documents"))))


@REGISTRY.add("p6_offsets", "SELECT doc_id, coalesce(length(text), 0) AS characters, 0 AS gaps, 0 AS backwards FROM documents")
def p6_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the ids of every document cover of its text: the last character, and ids that leave a gap to the one before or start before it."""
    spans = tokenization.encode_with_offsets(spread(table(spark, sf_dir, "documents")))
    next_start = F.slice("starts", F.lit(2), F.greatest(F.size("starts") - 1, F.lit(0)))
    pairs = F.arrays_zip(F.slice("ends", F.lit(1), F.greatest(F.size("ends") - 1, F.lit(0))).alias("e"), next_start.alias("s"))
    return spans.select("doc_id", F.coalesce(F.array_max("ends"), F.lit(0)).cast("long").alias("characters"), F.size(F.filter(pairs, lambda p: p["s"] > p["e"])).alias("gaps"), F.size(F.filter(pairs, lambda p: p["s"] < p["e"] - 1)).alias("backwards"))


@REGISTRY.add("p7_pack")
def p7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which document or piece lies in which container, for every capacity."""
    documents, containers = spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "containers")
    return packing.pack_documents(packing.document_sizes(documents, containers), containers)


@REGISTRY.add("p7_fill")
def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are."""
    return packing.fill_report(p7_pack(spark, sf_dir))


@REGISTRY.add("p7_whole", "SELECT container_id, (SELECT count(*) FROM documents) AS documents, 0 AS overflows, 0 AS other_tokens, 0 AS split_needlessly, 0 AS out_of_order FROM containers")
def p7_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every document lies whole in the containers of each capacity, and none holds more than it can."""
    documents, containers = spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "containers")
    sizes = packing.document_sizes(documents, containers)
    return packing.pack_faults(materialize(packing.pack_documents(sizes, containers), "packed"), sizes)


@REGISTRY.add("p8_found")
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the subjects that their paragraphs or headnotes deal with."""
    found = subjects.document_subjects(spread(table(spark, sf_dir, "documents")))
    return found.select("doc_id", F.explode("subjects").alias("subject")).distinct()


@REGISTRY.add("p8_composition")
def p8_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus by subject: documents of each, and of none."""
    found = subjects.document_subjects(spread(table(spark, sf_dir, "documents")))
    return found.select(F.explode_outer("subjects").alias("subject")).groupBy(F.coalesce("subject", F.lit("none")).alias("subject")).agg(F.count("*").alias("documents"))
