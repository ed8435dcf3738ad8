"""Tables that answer for one path without reading the rest: by folders of hashes and by Bloom filters of row groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
ROW_GROUP_BYTES = 16 << 20
PATHS_IN_GROUP = 100_000


def bucket(path: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


def _bloom(row_group_bytes: int, paths_in_group: int) -> dict[str, str]:
    # without a dictionary the filter is what tells a row group without the path
    return {
        "parquet.bloom.filter.enabled#path": "true",
        "parquet.bloom.filter.expected.ndv#path": str(paths_in_group),
        "parquet.enable.dictionary#path": "false",
        "parquet.block.size": str(row_group_bytes),
    }


def write_index(rows: DataFrame, table: str, *, buckets: int = BUCKETS, row_group_bytes: int = ROW_GROUP_BYTES, paths_in_group: int = PATHS_IN_GROUP) -> None:
    """Rows with a path in folders by the path's hash, in order of all columns within one; a row without a path has a folder too.

    Ranges of all columns are dealt, so a path that most rows have is written by many tasks.
    """
    order = ["bucket", "path", *(c for c in rows.columns if c != "path")]
    dealt = rows.withColumn("bucket", bucket(F.col("path"), buckets)).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.write.partitionBy("bucket").options(**_bloom(row_group_bytes, paths_in_group)).parquet(table)


def of_path(spark: SparkSession, table: str, path: str, *, buckets: int = BUCKETS) -> DataFrame:
    """An index's rows of one path: one folder's row groups that can hold it."""
    return spark.read.parquet(table).where((F.col("bucket") == bucket(F.lit(path), buckets)) & (F.col("path") == path)).drop("bucket")


def of_paths(asked: DataFrame, table: str, *, buckets: int = BUCKETS) -> DataFrame:
    """An index's rows of every path asked for (path); equal questions count once."""
    own = asked.select("path").distinct().withColumn("bucket", bucket(F.col("path"), buckets))
    return asked.sparkSession.read.parquet(table).join(own, ["bucket", "path"], "left_semi").drop("bucket")


def write_changes(changes: DataFrame, table: str, *, order: str = "seq", row_group_bytes: int = ROW_GROUP_BYTES, paths_in_group: int = PATHS_IN_GROUP) -> None:
    """Changes (path, seq) in order of the history, each row group with a Bloom filter of its paths."""
    by = [order, *(c for c in changes.columns if c != order)]
    changes.repartitionByRange(*by).sortWithinPartitions(*by).write.options(**_bloom(row_group_bytes, paths_in_group)).parquet(table)


def changes_of(spark: SparkSession, table: str, path: str, *, since: int | None = None, order: str = "seq") -> DataFrame:
    """Changes of one path, after since: row groups whose filter has the path and whose range meets the time are read."""
    rows = spark.read.parquet(table).where(F.col("path") == path)
    return rows if since is None else rows.where(F.col(order) > since)
