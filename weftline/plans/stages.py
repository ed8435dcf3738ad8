"""Cutting long plans at results that several later steps read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def _shared_folder(df: DataFrame) -> str:
    """The folder that spark.checkpoint.dir names. Only a local master may leave it unset."""
    spark = df.sparkSession
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="weftline-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def stage(df: DataFrame) -> DataFrame:
    """The same rows from a checkpoint in the shared folder."""
    _shared_folder(df)
    return df.checkpoint(eager=True)


#: Rows that one task sorts or counts at a time.
ROWS_A_TASK = 250_000


def spread(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """df dealt by hash of `by` to tasks that get ROWS_A_TASK of its `rows` rows each, if keys are many.

    Spark joins small shuffle partitions by their compressed bytes, which say little of what rows that compress well take
    in memory; partitions of a given number it leaves alone.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK)), *by)


def folder(df: DataFrame, name: str) -> str:
    """A new folder's path beside the checkpoints."""
    return f"{_shared_folder(df).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def streamed(stream: DataFrame) -> DataFrame:
    """What a stream gives of all that its source has by now, as a Parquet table in the shared folder."""
    own = folder(stream, "streamed")
    query = stream.writeStream.format("parquet").option("path", f"{own}/rows").option("checkpointLocation", f"{own}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{own}/rows")


def held(df: DataFrame) -> DataFrame:
    """The same rows from a Parquet table in the shared folder, for rounds of joins of a result with itself.

    A checkpoint carries on what is known of its columns, which grows with every round until planning takes longer than the
    work; a table begins anew.
    """
    path = folder(df, "held") + ".parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
