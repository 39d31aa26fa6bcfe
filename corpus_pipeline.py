"""Training-data pipeline over ``documents``: five stages, each written and read again by the next.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept. All but the last return
the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nestplane.llm import decontam, langid, packing, quality, simhash
from nestplane.llm.text import small_batches
from nestplane.sources.shared import Workspace
from nestplane.sources.ship import ship

#: Keys of dropped documents that may be broadcast.
BROADCAST_ROWS = 4_000_000


def _begin(spark: SparkSession) -> None:
    ship(spark)
    small_batches(spark)


def _keyed(docs: DataFrame, space: Workspace) -> tuple[DataFrame, str]:
    """``docs`` and a column that tells its rows apart: ``doc_id`` if it does, else a row number in a written copy."""
    ids = docs.groupBy("doc_id").count().agg(F.max("count"), F.count_if(F.col("doc_id").isNull())).first()
    if (ids[0] or 0) <= 1 and not ids[1]:
        return docs, "doc_id"
    row = "_row"
    while row in {c.lower() for c in docs.columns}:
        row += "_"
    return space.write(docs.withColumn(row, F.monotonically_increasing_id()), "rows"), row


def _without(whole: DataFrame, dropped: DataFrame, key: str, space: Workspace) -> DataFrame:
    """``whole`` without the rows whose key is in ``dropped``."""
    dropped = space.write(dropped, "dropped")
    if dropped.count() <= BROADCAST_ROWS:  # 8 bytes each; else texts and keys are shuffled
        dropped = F.broadcast(dropped)
    return whole.join(dropped, key, "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that no learned language explains: none with a letter, none likelier than all others together, or
    too many bits a byte for the language (``langid.with_foreign``). Every row is judged by itself, repeated and null ids included."""
    _begin(spark)
    space = Workspace(spark, "langid")
    whole, key = _keyed(docs, space)
    judged = space.write(langid.predict(whole, langid.train(whole), columns=[key], with_rate=True), "judged")
    return _without(whole, langid.with_foreign(judged).where("foreign").select(key), key, space).select(*docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops low-quality and toxic documents. The labels table trains; the decision is by text alone."""
    _begin(spark)
    scorer = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.scored(docs, scorer).where(~quality.rejected()).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of every SimHash component: one row, if that id repeats. Rows with a null id all stay,
    and stand for no other document."""
    _begin(spark)
    space = Workspace(spark, "dedup")
    whole, key = _keyed(docs, space)
    if key == "doc_id":
        found = simhash.near_duplicates(whole.select(key, "text"), key)
        copies = found.where(F.col(key) != F.col("component_id")).select(key)
    else:
        named = whole.where("doc_id is not null").select(F.struct("doc_id", key).alias("both"), "text")
        found = simhash.near_duplicates(named, "both")
        copies = found.where(F.col("both") != F.col("component_id")).select(F.col("both").getField(key).alias(key))
    return _without(whole, copies, key, space).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth or more stands in benchmark items."""
    _begin(spark)
    found = decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(~decontam.contaminated()).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents with their sequence and place."""
    _begin(spark)
    return packing.packed_documents(docs)


STAGES = [
    ("language ID", language_id),
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", best_fit_packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    space = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = space.write(stage(spark, docs, sf_dir), f"stage{i}")
    return docs
