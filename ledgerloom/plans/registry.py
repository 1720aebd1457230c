"""The models, their order and lineage."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.plans import gold, mart, silver, staging
from ledgerloom.session import materialize
from ledgerloom.sources.store import SnapshotStore


@dataclass(frozen=True)
class Model:
    name: str
    layer: str
    deps: tuple[str, ...]
    build: Callable[..., DataFrame]
    persisted: bool
    shared: bool = False  # read twice by its own plan or its consumers, so that a query writes it once


def _models(spark: SparkSession, as_of: Column) -> dict[str, Model]:
    m: dict[str, Model] = {}

    def add(name: str, layer: str, build: Callable[..., DataFrame], *deps: str, persisted: bool, shared: bool = False) -> None:
        m[name] = Model(name, layer, deps, build, persisted, shared)

    add("stg_contracts", "silver", staging.stage_contracts, "raw_contract_data", persisted=False)
    add("stg_abr_entity", "silver", staging.register_entity, "raw_abr_entity", persisted=True)
    add("stg_abr_names", "silver", staging.register_names, "raw_abr_entity", persisted=True)
    add("slv_contracts", "silver", silver.dedup_notices, "stg_contracts", persisted=True)
    add("int_abr_name_lookup", "silver", silver.name_lookup, "slv_contracts", "stg_abr_names", persisted=True)
    add("dim_agency", "gold", gold.dim_agency, "slv_contracts", persisted=True)
    add("dim_category", "gold", gold.dim_category, "slv_contracts", persisted=True)
    add("dim_date", "gold", lambda: gold.dim_date(spark), persisted=True)
    add("dim_supplier", "gold", gold.dim_supplier, "slv_contracts", "int_abr_name_lookup", "stg_abr_entity", persisted=True, shared=True)
    add("fct_contracts", "gold", gold.fct_contracts, "slv_contracts", persisted=True)
    add("rpt_contracts", "mart", lambda *d: mart.rpt_contracts(*d, as_of=as_of), "fct_contracts", "dim_supplier", "known_non_suppliers", "dim_agency", "dim_category", "dim_date", persisted=False)
    add("rpt_agency_spend", "mart", lambda c: mart.spend_by(c, "agency_name"), "rpt_contracts", persisted=False)
    add("rpt_category_spend", "mart", lambda c: mart.spend_by(c, "category_name"), "rpt_contracts", persisted=False)
    add("rpt_supplier_spend", "mart", mart.rpt_supplier_spend, "rpt_contracts", persisted=False)
    add("rpt_bi_dim_agency", "mart", lambda d: d, "dim_agency", persisted=False)
    add("rpt_bi_dim_category", "mart", lambda d: d, "dim_category", persisted=False)
    add("rpt_bi_dim_date", "mart", lambda d: d, "dim_date", persisted=False)
    add("rpt_bi_dim_supplier", "mart", mart.rpt_bi_dim_supplier, "dim_supplier", persisted=False)
    return m


@dataclass
class Models:
    """Builds models from the bronze tables in ``sources``.

    Without a ``path`` a model is a plan over work tables: what several models on the way read is written once, in the
    shared folder.  With one, ``run`` publishes the persisted models as snapshots in dependency order and later models
    read those.  The target ``ci`` prefixes the schemas and keeps the register models as views.  ``given`` are models
    that are there already.
    """

    spark: SparkSession
    sources: dict[str, DataFrame]
    as_of: Column = field(default_factory=F.current_date)
    path: str | None = None
    target: str = "prod"
    given: dict[str, DataFrame] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.models = _models(self.spark, self.as_of)
        self._built: dict[str, DataFrame] = self.sources | self.given
        self._cut = set(self.sources) | set(self.given)

    def layer(self, name: str) -> str:
        return self.models[name].layer if name in self.models else "bronze"

    def schema_of(self, name: str) -> str:
        return f"ci_{self.layer(name)}" if self.target == "ci" else self.layer(name)

    def persisted(self, name: str) -> bool:
        return self.models[name].persisted and not (self.target == "ci" and name.startswith("stg_abr"))

    def order(self) -> list[str]:
        ts = TopologicalSorter({n: [d for d in m.deps if d in self.models] for n, m in self.models.items()})
        return list(ts.static_order())

    def _needed(self, name: str) -> set[str]:
        """The models that ``name`` is made of and that are not there yet."""
        own = {d for d in self.models[name].deps if d in self.models and d not in self._built} if name in self.models else set()
        return own.union(*(self._needed(d) for d in own)) if own else own

    def cut(self, name: str) -> DataFrame:
        """The model as a work table."""
        if name not in self._cut:
            self._built[name] = materialize(self.build(name), name)
            self._cut.add(name)
        return self._built[name]

    def build(self, name: str) -> DataFrame:
        if name in self._built:
            return self._built[name]
        needed = self._needed(name) | {name}
        for d in self.order():
            if d in needed and d != name and d not in self._built:
                readers = sum(d in self.models[n].deps for n in needed)
                self._built[d] = self._plan(d)
                if self.path is None and (readers > 1 or self.models[d].shared):
                    self.cut(d)
        self._built[name] = self._plan(name)
        return self._built[name]

    def _plan(self, name: str) -> DataFrame:
        return self.models[name].build(*[self._built[d] for d in self.models[name].deps])

    @classmethod
    def declared(cls) -> Models:
        """The models without data, for their order and lineage."""
        models = cls.__new__(cls)
        models.models = _models(None, None)
        return models

    def published(self) -> Models:
        """These models as they were last published, those that are views over them included."""
        for name in self.order():
            if self.persisted(name) and (store := self.store(name)).exists():
                self._built[name] = store.read()
        return self

    def run(self, full_refresh: bool = False) -> list[str]:
        """Publish all persisted models; a model is live only when its snapshot is complete.

        The fact goes on from its last snapshot: only the chains touched since are collapsed anew, and none is removed.
        A full refresh rebuilds it.
        """
        if self.path is None:
            raise ValueError("a path is needed to publish models")
        done = []
        for name in self.order():
            df = self.build(name)
            if not self.persisted(name):
                continue
            if name == "fct_contracts":
                store = self._fact(df, full_refresh)
            else:
                store = self.store(name)
                store.commit(df)
            self._built[name] = store.read()
            done.append(name)
        return done

    def store(self, name: str) -> SnapshotStore:
        return SnapshotStore(self.spark, f"{self.path}/{self.schema_of(name)}/{name}", ["contract_id"] if name == "fct_contracts" else ())

    def _fact(self, rebuilt: DataFrame, full_refresh: bool) -> SnapshotStore:
        store, silver = self.store("fct_contracts"), self._built["slv_contracts"]
        if full_refresh or not store.exists() or set(store.read().columns) != set(rebuilt.columns):
            store.commit(rebuilt, silver.count())
            return store
        touched = materialize(gold.affected_chains(silver, store.read()), "touched")
        own = gold.with_chain(silver).join(touched, "base_id", "left_semi").drop("base_id", "amendment_no")
        store.replace_chains(gold.fct_contracts(own), touched.withColumnRenamed("base_id", "contract_id"))
        return store

    def edges(self) -> list[tuple[str, str]]:
        return sorted((d, n) for n, m in self.models.items() for d in m.deps)

    def mermaid(self) -> str:
        return "\n".join(["flowchart LR", *[f"    {a} --> {b}" for a, b in self.edges()]])

    def check_lineage(self, text: str) -> bool:
        """Whether a written lineage is still the present one."""
        return inspect.cleandoc(text) == inspect.cleandoc(self.mermaid())
