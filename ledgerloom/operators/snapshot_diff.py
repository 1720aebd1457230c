"""What changed between consecutive full snapshots.

Each snapshot is set against the one before it by EXCEPT ALL both ways, which removes what is identical; the residues
of both directions are full-joined by key.  A key with residues on both sides changed.  A key with residues on one
side only was added or removed if the other snapshot does not hold it at all, else it gained or lost a content and
changed; only these few keys are looked up.

Contents are compared by a 128-bit hash of the normalised fields, so that only keys and hashes are shuffled.  A key
with very many rows is reduced to its distinct contents on the map side, and every shuffle of contents spreads it by
content; residues are counted by key on the map side before they are joined.

Defined cases: rows with a null key or day are left out; repeated rows count once; a snapshot without a
predecessor gives nothing; a single snapshot or an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.history import snapshot_days
from ledgerloom.session import materialize


def content_hash(fields: Sequence[Column]) -> tuple[Column, Column]:
    """Two independent 64-bit hashes; a null has a mark of its own, so it never equals a text."""
    marked = [x for c in fields for x in (c.isNull(), F.coalesce(c, F.lit("")))]
    return F.xxhash64(F.lit(1), *marked), F.xxhash64(F.lit("b"), *marked)


def snapshot_diff(rows: DataFrame, key: str, day: str, fields: Sequence[str], days: Sequence[str] | None = None) -> DataFrame:
    """(day, key, change) for every snapshot after the first; ``fields`` are columns already normalised."""
    days = list(days) if days is not None else snapshot_days(rows, day)
    if len(days) < 2:
        return rows.limit(0).select(day, key, F.lit("").alias("change"))
    h1, h2 = content_hash([F.col(f) for f in fields])
    contents = rows.where(F.col(key).isNotNull() & F.col(day).isNotNull()).select(F.col(day).alias("day"), F.col(key).alias("key"), h1.alias("h1"), h2.alias("h2")).distinct()
    contents = materialize(contents, "contents")
    follower = F.try_element_at(F.create_map(*[F.lit(x) for pair in zip(days, days[1:]) for x in pair]), F.col("day"))
    before_it = F.try_element_at(F.create_map(*[F.lit(x) for pair in zip(days, days[1:]) for x in reversed(pair)]), F.col("day"))
    now = contents.where(F.col("day") != days[0])
    before = contents.where(F.col("day") != days[-1]).select(follower.alias("day"), "key", "h1", "h2")
    count = lambda residue, n: residue.groupBy("day", "key").agg(F.count("*").alias(n))
    both = count(now.exceptAll(before), "n_now").join(count(before.exceptAll(now), "n_before"), ["day", "key"], "full_outer")
    one_sided = F.col("n_now").isNull() | F.col("n_before").isNull()
    residues = both.withColumn("other", F.when(F.col("n_before").isNull(), before_it).when(F.col("n_now").isNull(), F.col("day")))
    held = contents.select(F.col("day").alias("other"), "key").distinct().withColumn("held", F.lit(True))
    label = F.when(~one_sided | F.col("held").isNotNull(), "changed").when(F.col("n_before").isNull(), "added").otherwise("removed")
    return residues.join(held, ["other", "key"], "left").select(F.col("day").alias(day), F.col("key").alias(key), label.alias("change"))
