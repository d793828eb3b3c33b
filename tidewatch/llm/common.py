"""What the operators of this subpackage share on the Spark side."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import settled, shared_dir  # noqa: F401

LEAST = -(1 << 63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def buckets(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def doc_key(column: str = "doc_id") -> Column:
    """doc_id without null: a null sorts first."""
    return F.coalesce(F.col(column).cast("long"), F.lit(LEAST).cast("long"))


#: Keys with more rows than this, and more than this share of all rows, are joined by broadcast: there are 1 / SHARE of them at most.
HOT, SHARE = 20_000, 1e-5


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, how: str = "inner") -> DataFrame:
    """left.join(right, keys, how), where right has one row a key and in `weight` how many rows of left have it.

    Keys with very many rows don't meet in one task: their rows of right, whose number is bounded, are broadcast.  how: inner,
    left or left_semi; right should be cheap to read more than once.
    """
    total, most = right.agg(F.coalesce(F.sum(weight), F.lit(0)), F.coalesce(F.max(weight), F.lit(0))).first()
    hot = max(HOT, int(float(total) * SHARE))
    if most <= hot:
        return left.join(right, keys, how)
    few = F.broadcast(right.where(F.col(weight) > hot))
    common = left.join(few, keys, "left_semi" if how == "left_semi" else "inner")
    others = left.join(F.broadcast(right.where(F.col(weight) > hot).select(*keys)), keys, "left_anti")
    return common.unionByName(others.join(right.where(F.col(weight) <= hot), keys, how))


def set_aside(df: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """df, whose columns of these names have others for now, and the way back for withColumnsRenamed."""
    taken, new = {c.lower() for c in (*df.columns, *names)}, {}
    for c in df.columns:
        if c.lower() in {n.lower() for n in names}:
            own = f"_{c}"
            while own.lower() in taken:
                own = f"_{own}"
            taken.add(own.lower())
            new[c] = own
    return df.withColumnsRenamed(new), {v: k for k, v in new.items()}


def give_back() -> None:
    """Memory that was freed goes back to the system, as far as the libraries can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not in every C library
        pass


def tidy(run):
    """run, for mapInArrow; what was freed goes back to the system when the task ends, since workers are kept for others."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied
