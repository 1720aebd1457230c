"""Type-2 history of a dimension that is rebuilt from scratch each time (check strategy).

``advance`` compares the open versions with the present rows: a changed checked column closes the version and
opens another, a vanished key closes, a key that returns opens a new version, equal rows stay untouched.  Nulls
are compared as values.  Defined cases: without a history every row opens; rows with a null key are left out;
several different rows of one key are an error of the dimension and fail the run; repeated rows count once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def advance(history: DataFrame | None, rows: DataFrame, key: str, checked: Sequence[str], run_ts: Column) -> DataFrame:
    """The history after a run, with the columns of ``rows``, valid_from and valid_to."""
    columns = rows.columns
    rest = [c for c in columns if c != key]
    rows = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*rest)).alias("_r"), F.min(F.struct(*rest)).alias("_least")).withColumn("_r", F.when(F.col("_r").eqNullSafe(F.col("_least")), F.col("_r")).otherwise(F.raise_error(F.lit(f"several rows of one {key}")))).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])
    born = lambda d: d.select(*columns, run_ts.alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"))
    if history is None:
        return born(rows)
    closed = history.where("valid_to is not null")
    pack = lambda p: F.struct(*[F.col(c) for c in rest]).alias(p)
    old = history.where("valid_to is null").select(key, pack("_o"), "valid_from", F.lit(True).alias("_had"))
    both = old.join(rows.select(key, pack("_n"), F.lit(True).alias("_has")), key, "full_outer")
    same = F.lit(True)
    for c in checked:
        same = same & F.col(f"_o.{c}").eqNullSafe(F.col(f"_n.{c}"))
    had, has = F.col("_had").isNotNull(), F.col("_has").isNotNull()
    stays = had & has & same
    version = lambda p, a, z: F.struct(F.col(p).alias("r"), a.alias("valid_from"), z.cast("timestamp_ntz").alias("valid_to"))
    kept = F.when(had, version("_o", F.col("valid_from"), F.when(stays, F.lit(None)).otherwise(run_ts)))
    opened = F.when(has & ~stays, version("_n", run_ts, F.lit(None)))
    out = both.select(key, F.explode(F.filter(F.array(kept, opened), lambda x: x.isNotNull())).alias("v"))
    out = out.select(key, *[F.col(f"v.r.{c}").alias(c) for c in rest], "v.valid_from", "v.valid_to")
    return closed.select(*columns, "valid_from", "valid_to").unionByName(out.select(*columns, "valid_from", "valid_to"))
