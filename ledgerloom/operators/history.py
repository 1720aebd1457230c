"""History of changing attributes, kept by rebuilding the chains that late or corrected rows touch.

Every snapshot states attributes of entities.  ``build_versions`` turns the raw statements of any set of
entities into their versions.  ``EntityHistory`` keeps the statements and the versions in stores bucketed by entity.
For a batch of late or corrected rows it fetches the statements of the touched entities out of their buckets,
rebuilds all their intervals and replaces exactly those chains in one commit.  A new snapshot is such a batch too:
an entity that it holds in the state of its open version stays untouched, because that version goes on.

A version is a longest run of consecutive snapshots that hold the entity without contradiction.  Within one
snapshot each attribute takes the last loaded statement that is not null; a null says nothing, so it neither
ends a version nor begins one.  Equal load times with different statements: the greater text counts.

Defined cases: rows with a null key or a null snapshot day are left out; repeated rows count once; an empty
input gives an empty history; columns beside those named are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import full_abn, digits, file_day, present
from ledgerloom.session import materialize
from ledgerloom.sources.store import SnapshotStore

OPEN_END = "9999-12-31"


def snapshot_days(raw: DataFrame, day: str = "day") -> list[str]:
    """All snapshot days in order; as many as there were deliveries, which is what bounds this list."""
    return [r[0] for r in raw.where(F.col(day).isNotNull()).select(day).distinct().orderBy(day).collect()]


def build_versions(raw: DataFrame, days: Sequence[str], key: str, attributes: Sequence[str], day: str = "day", loaded: str = "loaded") -> DataFrame:
    """(key, attributes, valid_from, valid_to, n_versions) of every entity in ``raw``.

    One shuffle: the statements are combined per entity and snapshot on the map side first, so an entity with
    very many rows reaches its task as one row a snapshot.
    """
    raw = raw.where(F.col(key).isNotNull() & F.col(day).isNotNull())
    last = [F.max(F.when(F.col(a).isNotNull(), F.struct(F.col(loaded), F.col(a)))).getField(a).alias(a) for a in attributes]
    states = raw.groupBy(key, day).agg(*last)
    at = F.array_position(F.array(*map(F.lit, days)), F.col(day)).cast("int") if days else F.lit(0)
    chain = F.sort_array(F.collect_list(F.struct(at.alias("at"), *attributes)))
    kind = "struct<first:int,last:int," + ",".join(f"{a}:string" for a in attributes) + ">"

    def step(runs: Column, s: Column) -> Column:
        run = F.element_at(runs, -1)
        same = F.lit(True)
        for a in attributes:
            same = same & (run[a].isNull() | s[a].isNull() | (run[a] == s[a]))
        goes_on = (F.size(runs) > 0) & (F.try_element_at(runs, F.lit(-1))["last"] + 1 == s["at"]) & same
        joined = F.struct(run["first"].alias("first"), s["at"].alias("last"), *[F.coalesce(run[a], s[a]).alias(a) for a in attributes])
        fresh = F.struct(s["at"].alias("first"), s["at"].alias("last"), *[s[a].alias(a) for a in attributes])
        before = F.slice(runs, 1, F.greatest(F.size(runs) - 1, F.lit(0)))
        return F.when(F.coalesce(goes_on, F.lit(False)), F.concat(before, F.array(joined.cast(kind)))).otherwise(F.concat(runs, F.array(fresh.cast(kind))))

    runs = F.aggregate(F.col("chain"), F.array().cast(f"array<{kind}>"), step)
    ends = F.array(*map(F.lit, [*days[1:], OPEN_END])) if days else F.array(F.lit(OPEN_END))
    begins = F.array(*map(F.lit, days)) if days else F.array(F.lit(""))
    versions = states.groupBy(key).agg(chain.alias("chain")).select(key, runs.alias("runs"))
    v = versions.select(key, F.size("runs").alias("n_versions"), F.explode("runs").alias("v"))
    return v.select(key, *[F.col(f"v.{a}").alias(a) for a in attributes], F.element_at(begins, F.col("v.first")).alias("valid_from"), F.element_at(ends, F.col("v.last")).alias("valid_to"), "n_versions")


class EntityHistory:
    """The versions of all entities, in a store that is changed chain by chain.

    The statements of a batch are stored before the versions that follow from them; a batch that is applied again
    after a failure between the two changes nothing more, because repeated rows count once.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, attributes: Sequence[str], day: str = "day", loaded: str = "loaded", **sizes):
        self.key, self.attributes, self.day, self.loaded = key, list(attributes), day, loaded
        self.store = SnapshotStore(spark, f"{path}/versions", [key], **sizes)
        self.raw = SnapshotStore(spark, f"{path}/statements", [key], **sizes)

    def _build(self, raw: DataFrame, days: Sequence[str]) -> DataFrame:
        return build_versions(raw, days, self.key, self.attributes, self.day, self.loaded)

    def _statements(self, raw: DataFrame) -> DataFrame:
        return raw.select(self.key, self.day, self.loaded, *self.attributes).where(F.col(self.key).isNotNull() & F.col(self.day).isNotNull())

    def load(self, raw: DataFrame, days: Sequence[str], rows: int | None = None) -> None:
        self.raw.commit(self._statements(raw), rows)
        self.store.commit(self._build(raw, days), rows, days=list(days))

    def apply(self, batch: DataFrame, days: Sequence[str]) -> None:
        """Add the statements of ``batch``; ``days`` are all snapshot days by now, in order."""
        known = self.store.meta.get("days") or []
        batch = materialize(self._statements(batch), "batch")
        self.raw.append(batch)
        if list(days[: len(known)]) != known:  # a snapshot between others parts the chains of all entities that it lacks
            self.store.commit(self._build(self.raw.read(), days), days=list(days))
            return
        steps = [list(days[:n]) for n in range(len(known) + 1, len(days) + 1)] or [known]
        for upto in steps:
            new = upto[-1] if upto != known else None
            own = batch.where(F.col(self.day) <= F.lit(upto[-1])) if new else batch
            touched = self._touched(own, upto, new)
            statements = self.raw.read_touched(touched).where(F.col(self.day).isin(upto))
            self.store.replace_chains(self._build(statements, upto), touched, days=upto)
            known = upto

    def _touched(self, batch: DataFrame, days: Sequence[str], new: str | None) -> DataFrame:
        """The entities whose chains change: with a new last day, all but those whose open version simply goes on."""
        if new is None:
            return batch.select(self.key).distinct()
        today = build_versions(batch.where(F.col(self.day) == new), [new], self.key, self.attributes, self.day, self.loaded)
        pack = lambda name: F.struct(*[F.col(a) for a in self.attributes]).alias(name)
        open_ones = self.store.read().where(F.col("valid_to") == OPEN_END).select(self.key, pack("_before"))
        both = today.select(self.key, pack("_now")).join(open_ones, self.key, "full_outer")
        goes_on = F.lit(True)
        for a in self.attributes:
            goes_on = goes_on & (F.col(f"_now.{a}").isNull() | F.col(f"_now.{a}").eqNullSafe(F.col(f"_before.{a}")))
        moved = both.where(F.col("_now").isNull() | F.col("_before").isNull() | ~goes_on).select(self.key)
        return materialize(moved.unionByName(batch.where(F.col(self.day) < new).select(self.key)).distinct(), "touched")

    def read(self) -> DataFrame:
        return self.store.read()


def register_statements(register: DataFrame) -> DataFrame:
    """The register's rows as statements: abn, day, loaded, status, status_date, main_name; notation made uniform."""
    squeeze = lambda c: F.upper(F.regexp_replace(present(c), r"[^\p{L}\p{N}]+", ""))
    name = squeeze(F.col("entity_name"))
    return register.select(
        F.coalesce(full_abn(F.col("abn")), F.nullif(digits(F.col("abn")), F.lit(""))).alias("abn"),
        file_day(F.col("_source_file")).alias("day"),
        F.col("_loaded_at").alias("loaded"),
        squeeze(F.col("abn_status")).alias("status"),
        F.nullif(digits(present(F.col("abn_status_from_date"))), F.lit("")).alias("status_date"),
        F.when((F.upper(present(F.col("name_type"))) == "MAIN") & (name != ""), name).alias("main_name"),
    )
