"""References to records that do not exist, direct and inherited.

``cascade`` works on a graph of tables and references.  Direct orphans are rows whose reference finds no
parent.  Then, round by round, rows that refer to an orphaned row become inherited orphans, until a round adds
none; every round semi-joins only the rows found last.  Rounds are written to the shared folder, so the plan
does not grow with their number.

``reference_gaps`` names the kind of gap where the parent table is delivered as snapshots over time.

Defined cases: a null reference refers to nothing and is no orphan; an empty parent table makes every stated
reference an orphan; repeated rows are reported each; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import materialize


@dataclass(frozen=True)
class Reference:
    """``child.columns`` point at ``parent.keys``; rows of ``child`` without the first column refer to nothing."""

    child: str
    columns: tuple[str, ...]
    parent: str
    keys: tuple[str, ...]


def _missing(child: DataFrame, ref: Reference, parent: DataFrame) -> DataFrame:
    """Rows of the child whose reference finds nothing; distinct references are looked up, not rows."""
    names = [f"_k{i}" for i in range(len(ref.columns))]
    stated = child.where(F.col(ref.columns[0]).isNotNull())
    refs = stated.select(*[F.col(c).alias(n) for c, n in zip(ref.columns, names)]).distinct()
    known = parent.select(*[F.col(c).alias(n) for c, n in zip(ref.keys, names)]).distinct()
    gone = refs.join(known, names, "left_anti")
    return stated.join(gone.withColumnsRenamed(dict(zip(names, ref.columns))), list(ref.columns), "left_semi")


def cascade(tables: dict[str, DataFrame], references: Sequence[Reference], row_id: str = "row_id", max_rounds: int = 1000, carry: Sequence[str] = ()) -> DataFrame:
    """(table, row_id, via, vias, level): level 0 are direct orphans, level n inherit from a row of level n-1.

    Every table needs the column ``row_id`` and the columns its references name.  A row keeps its first level;
    ``vias`` are all references that orphan it there, ``via`` the first of them.  Columns in ``carry`` come along
    from the tables that have them.
    """
    kept = {t: [c for c in carry if c in d.columns] for t, d in tables.items()}
    label = lambda ref, level: (F.lit(f"{ref.child}.{ref.columns[0]}").alias("via"), F.lit(level).alias("level"))
    gather = lambda parts, ref, rows: parts.setdefault(ref.child, []).append(rows)

    def one(t: str, parts: list[DataFrame]) -> DataFrame:
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        vias = F.sort_array(F.collect_set("via"))
        return rows.groupBy(row_id, *kept[t]).agg(vias.alias("vias"), F.min("level").alias("level")).select(row_id, F.get("vias", F.lit(0)).alias("via"), "vias", "level", *kept[t])

    parts: dict[str, list[DataFrame]] = {}
    for ref in references:
        gather(parts, ref, _missing(tables[ref.child], ref, tables[ref.parent]).select(row_id, *label(ref, 0), *kept[ref.child]))
    fresh = {t: materialize(one(t, p), f"orphans-{t}-0") for t, p in parts.items()}
    found = dict(fresh)
    for level in range(1, max_rounds + 1):
        new: dict[str, list[DataFrame]] = {}
        for ref in references:
            if ref.parent not in fresh:
                continue
            names = [f"_k{i}" for i in range(len(ref.columns))]
            lost = tables[ref.parent].join(fresh[ref.parent].select(row_id).hint("merge"), row_id, "left_semi").select(*[F.col(c).alias(n) for c, n in zip(ref.keys, names)]).distinct()
            own = tables[ref.child].where(F.col(ref.columns[0]).isNotNull()).withColumns({n: F.col(c) for n, c in zip(names, ref.columns)})
            gather(new, ref, own.join(lost, names, "left_semi").select(row_id, *label(ref, level), *kept[ref.child]))
        nxt: dict[str, DataFrame] = {}
        for t, p in new.items():
            d = one(t, p)
            d = d.join(found[t].select(row_id).hint("merge"), row_id, "left_anti") if t in found else d
            d = materialize(d, f"orphans-{t}-{level}")
            if not d.isEmpty():
                nxt[t] = d
                found[t] = found[t].unionByName(d) if t in found else d
        if not nxt:
            break
        fresh = nxt
    else:
        raise RuntimeError(f"the cascade did not end within {max_rounds} rounds")
    out = None
    for t, d in found.items():
        part = d.select(F.lit(t).alias("table"), row_id, "via", "vias", "level", *kept[t])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def reference_gaps(references: DataFrame, holdings: DataFrame, key: str, day: str = "day") -> DataFrame:
    """The rows of ``references`` whose key the snapshot in force does not hold, with their ``kind``.

    ``references`` has key and day, ``holdings`` key and snapshot day.  In force is the latest snapshot of the
    whole parent table on or before the reference's day.  ``deleted``: an earlier snapshot holds the key; else
    ``later``: a later one does; else ``missing``.  The parent side is one aggregation to a row a key with its days,
    as many as there are snapshots.
    """
    refs = references.where(F.col(key).isNotNull() & F.col(day).isNotNull())
    held = holdings.where(F.col(key).isNotNull() & F.col("snapshot").isNotNull()).groupBy(key).agg(F.collect_set("snapshot").alias("_held"))
    days = [r[0] for r in holdings.where(F.col("snapshot").isNotNull()).select("snapshot").distinct().collect()]
    in_force = F.array_max(F.filter(F.array(*map(F.lit, days)) if days else F.array().cast("array<string>"), lambda s: s <= F.col(day)))
    hit: Column = F.coalesce(F.array_contains("_held", F.col("_in_force")), F.lit(False))
    before = F.coalesce(F.array_min("_held") < F.coalesce(F.col("_in_force"), F.lit("")), F.lit(False))
    kind = F.when(before, "deleted").when(F.col("_held").isNotNull(), "later").otherwise("missing")
    return refs.withColumn("_in_force", in_force).join(held.hint("merge"), key, "left").where(~hit).withColumn("kind", kind).drop("_held", "_in_force")
