"""Change capture: a change log read as a stream and merged, batch by batch, into a typed mirror.

The log holds every change of the bronze table as rows with _action (INSERT or DELETE), _is_update and a _seq that
grows from load to load; an update is the old row deleted and the new one inserted, both marked.  Each batch is reduced to the net
change of every key and merged; the batch number is committed with the snapshot, so a replayed batch is skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.plans.staging import iso_day
from ledgerloom.sources.store import SnapshotStore

MIRROR = ("agency_name", "supplier_name", "contract_value", "publish_date", "loaded_at")


def change_log(before: DataFrame, merged: DataFrame, key: str, load: int) -> DataFrame:
    """The changes between a table and its merge (made with ``actions``), as log rows; unchanged rows leave none.

    ``load`` is the number of the load, in the order of loads; it leads the sequence numbers.
    """
    columns = [c for c in merged.columns if c != "_action"]
    touched = merged.where("_action <> 'keep'")
    new = touched.where("_action in ('insert', 'update')").select(*columns, F.lit("INSERT").alias("_action"), (F.col("_action") == "update").alias("_is_update"))
    old_keys = touched.where("_action in ('update', 'delete') and " + key + " is not null").select(key, (F.col("_action") == "update").alias("_is_update"))
    old = before.join(old_keys, key).select(*columns, F.lit("DELETE").alias("_action"), "_is_update")
    return new.unionByName(old).withColumn("_seq", F.lit(load).cast("decimal(38,0)") * F.lit(1 << 62).cast("decimal(38,0)") + F.monotonically_increasing_id())


def net_changes(changes: DataFrame) -> DataFrame:
    """The last change of every key: by load time, an insert after a delete, then by sequence."""
    last = Window.partitionBy("cnid").orderBy(F.desc_nulls_last("_loaded_at"), F.desc("_action"), F.desc("_seq"))
    return changes.where("cnid is not null").withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def mirror(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("cnid").alias("contract_id"), F.col("agencyname").alias("agency_name"), F.col("suppliername").alias("supplier_name"), F.col("value").try_cast("decimal(18,2)").alias("contract_value"),
        iso_day(F.col("publishdate")).alias("publish_date"), F.col("_loaded_at").alias("loaded_at"), *[c for c in ("_action", "_is_update") if c in raw.columns],
    )


def apply_changes(target: DataFrame, changes: DataFrame, merged_at: Column) -> DataFrame:
    """The mirror after a batch: a lone delete removes, any other change of a known key updates, an insert adds."""
    s = mirror(net_changes(changes)).select(F.col("contract_id").alias("_id"), F.struct(*MIRROR).alias("_new"), "_action", "_is_update")
    t = target.select("contract_id", F.struct(*MIRROR).alias("_old"), "_merged_at", F.lit(True).alias("_in"))
    both = t.join(s, F.col("contract_id") == F.col("_id"), "full_outer")
    known, changed = F.col("_in").isNotNull(), F.col("_id").isNotNull()
    gone = known & changed & (F.col("_action") == "DELETE") & ~F.col("_is_update")
    stray = ~known & (F.col("_action") != "INSERT")
    rows = both.where(~F.coalesce(gone | stray, F.lit(False)))
    use = F.when(changed, F.col("_new")).otherwise(F.col("_old"))
    return rows.select(F.coalesce("contract_id", "_id").alias("contract_id"), use.alias("_c"), F.when(changed, merged_at).otherwise(F.col("_merged_at")).alias("_merged_at")).select("contract_id", *[F.col(f"_c.{c}").alias(c) for c in MIRROR], "_merged_at")


def start_merge(spark: SparkSession, log_path: str, store: SnapshotStore, checkpoint: str, merged_at: Column, **trigger):
    """The running query; ``store``, keyed by contract_id, must hold the mirror already.  Trigger: availableNow=True, or processingTime='60 minutes'."""
    schema = spark.read.parquet(log_path).schema

    def batch(rows: DataFrame, number: int) -> None:
        if number <= store.meta.get("batch", -1):
            return
        keys = rows.where("cnid is not null").select(F.col("cnid").alias("contract_id")).distinct()
        # only the buckets of changed keys are read and written
        store.replace_chains(apply_changes(store.read_touched(keys), rows, merged_at), keys, batch=number)

    stream = spark.readStream.schema(schema).parquet(log_path)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def start_aggregate(spark: SparkSession, source: DataFrame, aggregate, store: SnapshotStore, checkpoint: str, **trigger):
    """An aggregate over a stream, kept fresh: every batch publishes the complete result."""

    def batch(rows: DataFrame, number: int) -> None:
        if number > store.meta.get("batch", -1):
            store.commit(rows, batch=number)

    return aggregate(source).writeStream.outputMode("complete").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
