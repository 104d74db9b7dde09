"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import Stage as Scratch

__all__ = ["BROADCAST_IDS", "Scratch", "documents", "hash_ranges", "parts", "with_ids"]

#: Ids (8 bytes each) up to which a set of ids is broadcast; above it the same filter is a shuffled join.
BROADCAST_IDS = 1_000_000
#: Bytes of input files to a hash range, and ranges at most.
RANGE_BYTES, MOST_RANGES = 16 << 20, 65536


def parts(spark: SparkSession) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def hash_ranges(df: DataFrame) -> int:
    """Ranges of hashes to merge a table in: as many as shuffle partitions, more for a large table.

    The optimiser's estimate of the table (the size of its files, or more) costs no job.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    # without files the estimate is a placeholder near the largest number
    return max(parts(df.sparkSession), min(MOST_RANGES, size // RANGE_BYTES) if size < 1 << 56 else 0)


def with_ids(df: DataFrame, ids: DataFrame, key: str = "doc_id", keep: bool = True) -> DataFrame:
    """Rows of df whose key is (or is not) in ids(key): by broadcast below ``BROADCAST_IDS``, else shuffled."""
    ids = ids.select(key).distinct()
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, key, "left_semi" if keep else "left_anti")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
