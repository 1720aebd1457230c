"""Loading a scratch table into a target: merge by key, prune, and the three load modes.

A merge restamps only what it touched.  Rows of the target whose key the source holds with equal content (null
compared to null is equal) stay as they are, stamp included, so loading the same file twice changes nothing.

Defined cases: a null key matches nothing, so such source rows are inserted each time, and a prune removes such
target rows; several source rows for one key of the target whose content differs from it are an error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class AmbiguousMerge(ValueError):
    """Several changed source rows for one target row."""


def _pairs(target: DataFrame, source: DataFrame, key: str, columns: Sequence[str], stamp: str, carry: Sequence[str] = ()) -> DataFrame:
    """Both sides by key.  Rows without a key match nothing: they stay out of the join, where they would all meet in one task."""
    side = lambda d, n: d.select(F.col(key).alias("_k" + n), F.struct(*[F.col(c) for c in columns]).alias("_c" + n), F.col(stamp).alias("_s" + n), F.struct(*[F.col(c) for c in carry], F.lit(True).alias("_")).alias("_x" + n), F.lit(True).alias("_in" + n))
    t, s = side(target, "t"), side(source if stamp in source.columns else source.withColumn(stamp, F.lit(None)), "s")
    both = t.where("_kt is not null").join(s.where("_ks is not null"), F.col("_kt") == F.col("_ks"), "full_outer")
    return both.unionByName(t.where("_kt is null"), allowMissingColumns=True).unionByName(s.where("_ks is null"), allowMissingColumns=True)


def merge(target: DataFrame, source: DataFrame, key: str, columns: Sequence[str], stamp: str, load_ts: Column, *, carry: Sequence[str] = (), prune: bool = False, actions: bool = False, check: bool = True) -> DataFrame:
    """The target after the load; with ``actions`` also a column _action: insert, update, keep or delete (deleted rows included).

    Columns in ``carry`` come along with the row that stays, but are not compared.
    """
    if check:
        # only keys that the source says twice can be ambiguous; where there is none, their column is all that is read
        repeated = source.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key)
        if not repeated.isEmpty():
            several = _pairs(target.join(repeated, key, "left_semi"), source.join(repeated, key, "left_semi"), key, columns, stamp)
            changed = several.where("_int and _ins and not (_ct <=> _cs)").groupBy("_kt").agg(F.count("*").alias("_n")).where("_n > 1")
            if not changed.isEmpty():
                raise AmbiguousMerge(f"several changed source rows for one {key}")
    both = _pairs(target, source, key, columns, stamp, carry)
    has_t, has_s = F.col("_int").isNotNull(), F.col("_ins").isNotNull()
    action = F.when(has_t & has_s, F.when(F.col("_ct").eqNullSafe(F.col("_cs")), "keep").otherwise("update")).when(has_s, "insert").otherwise("delete" if prune else "keep")
    rows = both.withColumn("_action", action)
    if not actions:
        rows = rows.where("_action <> 'delete'")
    fresh = F.col("_action").isin("insert", "update")
    content = F.when(fresh, F.col("_cs")).otherwise(F.col("_ct"))
    out = rows.select(F.coalesce("_kt", "_ks").alias(key), content.alias("_c"), F.when(fresh, load_ts).otherwise(F.col("_st")).alias(stamp), F.when(fresh, F.col("_xs")).otherwise(F.col("_xt")).alias("_x"), "_action")
    return out.select(key, *[F.col(f"_c.{c}").alias(c) for c in columns], stamp, *[F.col(f"_x.{c}").alias(c) for c in carry], *(["_action"] if actions else []))


def since_watermark(source: DataFrame, target: DataFrame, column: str) -> DataFrame:
    """Source rows at or after the target's greatest value; all of them where the target has none."""
    mark = target.agg(F.max(column).alias("_mark"))
    return source.join(mark, F.col("_mark").isNull() | (F.col(column) >= F.col("_mark")), "left_semi")


def load(target: DataFrame | None, source: DataFrame, mode: str, key: str, columns: Sequence[str], stamp: str, load_ts: Column, watermark: str = "publishdate", carry: Sequence[str] = (), actions: bool = False) -> DataFrame:
    """``full`` replaces; ``delta`` merges and prunes; ``incremental`` merges what is at or after the watermark.

    With ``actions`` the rows come with their _action, those that go included; a full load inserts and deletes all.
    """
    if mode not in ("full", "delta", "incremental"):
        raise ValueError(f"no such mode: {mode}")
    if mode == "full" or target is None:
        rows = source.select(key, *columns, *carry).withColumn(stamp, load_ts)
        if not actions:
            return rows
        rows = rows.withColumn("_action", F.lit("insert"))
        return rows if target is None else rows.unionByName(target.select(key, *columns, *carry, stamp).withColumn("_action", F.lit("delete")))
    if mode == "incremental":
        source = since_watermark(source, target, watermark)
    return merge(target, source, key, columns, stamp, load_ts, carry=carry, prune=mode == "delta", actions=actions)
