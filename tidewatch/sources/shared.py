"""What jobs share: the folder that driver and executors see, tables written there, and spreading of small inputs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, set here only where it is unset."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        set_dir = sc._jsc.sc().getCheckpointDir()
        if set_dir.isDefined():
            return set_dir.get()
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        found = tempfile.mkdtemp(prefix="tidewatch-")
        sc.setCheckpointDir(found)
    return found


def settled(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: its lineage is cut and it is computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


#: Inputs up to this size are dealt over all cores before work that is bound by the CPU; larger ones have tasks enough.
SMALL = 256 << 20


#: Bytes of files whose rows one task should gather.
PART = 8 << 20


def parts_of(df: DataFrame) -> int:
    """In how many parts of PART bytes the files that df reads are: as many more as they are larger."""
    return 1 + int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) // PART


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if it is small: a table of one file is one task otherwise, however much work its lines are."""
    if df.isStreaming:
        return df
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SMALL else df
