"""What the operators share: tables in the cluster's shared folder, column names, Arrow helpers."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamdex.sources.tables import discard, new_path, shared_folder, stored

BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows and BATCH_BYTES bytes for the session: by default long texts make batches of a GB, which JVM and Python both hold."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int(re.match(r"-?\d+", spark.conf.get(key))[0])
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def fresh(taken: Iterable[str], name: str) -> str:
    """A column name that is not taken (Spark's names ignore case)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = "_" + name
    return name


def tasks(spark: SparkSession) -> int:
    """The number of shards that data is dealt to: spark.sql.shuffle.partitions, set to suit the input and the cluster."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def input_bytes(df: DataFrame) -> int:
    """The bytes of the tables that df reads, by their files; tables of unknown size, such as rows made on the driver, count 0."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(s for s in sizes if s < 1 << 60)


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32(doc_id as text) mod divisor; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, text, ...) of docs; columns that are missing come as nulls."""
    small_batches(docs.sparkSession)
    kinds = {"doc_id": "bigint", "text": "string"}
    names = {c.lower() for c in docs.columns}
    return docs.select(*(docs[c].cast(kinds.get(c, "string")).alias(c) if c in names else F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in ("doc_id", "text", *more)))


__all__ = ["discard", "fresh", "input_bytes", "keyed", "new_path", "remainder", "shared_folder", "small_batches", "stored", "tasks"]
