"""The declared checks of the layered model, and one report over all of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import quality

#: The columns of each model that hold no nulls.
NOT_NULL = {
    "stg_contracts": ("contract_id",),
    "stg_abr_entity": ("abn", "is_government_entity"),
    "stg_abr_names": ("abn", "entity_name"),
    "slv_contracts": ("contract_id", "contract_value", "procurement_method", "supplier_name", "agency_name", "category_name"),
    "int_abr_name_lookup": ("normalized_name", "matched_abn"),
    "dim_supplier": ("supplier_key", "supplier_name", "abn_source", "supplier_abn_is_placeholder", "supplier_entity_key", "supplier_entity_name"),
    "dim_agency": ("agency_key", "agency_name"),
    "dim_category": ("category_key",),
    "dim_date": ("date_key",),
    "fct_contracts": ("contract_id", "source_notice_id", "amendment_no", "contract_value", "supplier_key", "agency_key", "category_key", "loaded_at"),
    "rpt_contracts": ("contract_id", "is_attributable", "is_active", "contract_value"),
    "rpt_supplier_spend": ("supplier_entity_key", "total_spend"),
    "rpt_agency_spend": ("total_spend",),
    "rpt_category_spend": ("total_spend",),
    "rpt_bi_dim_agency": ("agency_key",),
    "rpt_bi_dim_category": ("category_key",),
    "rpt_bi_dim_supplier": ("supplier_entity_key",),
    "rpt_bi_dim_date": ("date_key", "full_date"),
    "rpt_supplier_history": ("is_current",),
}
#: The columns of each model whose values stand once.
UNIQUE = {
    "stg_abr_entity": ("abn",),
    "slv_contracts": ("contract_id",),
    "int_abr_name_lookup": ("normalized_name",),
    "dim_supplier": ("supplier_key",),
    "dim_agency": ("agency_key",),
    "dim_category": ("category_key",),
    "dim_date": ("date_key",),
    "fct_contracts": ("contract_id", "source_notice_id"),
    "rpt_contracts": ("contract_id",),
    "rpt_supplier_spend": ("supplier_entity_key",),
    "rpt_bi_dim_agency": ("agency_key",),
    "rpt_bi_dim_category": ("category_key",),
    "rpt_bi_dim_supplier": ("supplier_entity_key",),
    "rpt_bi_dim_date": ("date_key", "full_date"),
}
#: What a column may say.
ACCEPTED = {("dim_supplier", "abn_source"): ("stated", "abr_name_match", "none"), ("dim_supplier", "abr_abn_status"): ("ACT", "CAN")}
#: Child, its column, parent, the parent's key.
REFERENCES = (
    ("fct_contracts", "supplier_key", "dim_supplier", "supplier_key"),
    ("fct_contracts", "agency_key", "dim_agency", "agency_key"),
    ("fct_contracts", "publish_date_key", "dim_date", "date_key"),
)
#: Models that the report reads several times: a build has them as snapshots, a query writes them once.
READ_OFTEN = ("stg_contracts", "stg_abr_entity", "stg_abr_names", "slv_contracts", "int_abr_name_lookup", "dim_agency", "dim_category", "dim_supplier", "fct_contracts", "rpt_contracts", "rpt_supplier_spend")


def _line(rows: DataFrame, check: str, model: str, column: Column | str, n: Column, severity: str = "error") -> DataFrame:
    column = F.lit(column) if isinstance(column, str) else column
    return rows.select(F.lit(check).alias("check"), F.lit(model).alias("model"), column.alias("column"), n.alias("n"), F.lit(severity).alias("severity"))


def _counted(bad: DataFrame, check: str, model: str, column: str, severity: str = "error") -> DataFrame:
    return _line(bad.agg(F.count("*").alias("n")), check, model, column, F.col("n"), severity)


def report(model: Callable[[str], DataFrame]) -> DataFrame:
    """(check, model, column, n, severity, status) of every declared check; ``model`` gives a model by name.

    All columns of a model that must not be null are counted in one pass.
    """
    parts = []
    for name, columns in NOT_NULL.items():
        counts = model(name).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
        parts.append(_line(counts.unpivot([], list(columns), "column", "n"), "not_null", name, F.col("column"), F.col("n")))
    parts += [_counted(quality.unique(model(name), c), "unique", name, c) for name, columns in UNIQUE.items() for c in columns]
    parts += [_counted(quality.accepted_values(model(name), c, values), "accepted_values", name, c) for (name, c), values in ACCEPTED.items()]
    parts += [_counted(quality.relationships(model(child), c, model(parent), key), "relationships", child, c) for child, c, parent, key in REFERENCES]
    supplier, fact = model("dim_supplier"), model("fct_contracts")
    parts += [
        _counted(quality.unique(model("stg_abr_entity"), "abn"), "one_row_per_abn", "stg_abr_entity", "abn"),
        _counted(quality.gold_drift(model("slv_contracts"), fact), "gold_drift", "fct_contracts", "contract_id"),
        _counted(quality.mart_reconcile(fact, model("rpt_supplier_spend")).where("not agrees"), "mart_reconcile", "rpt_supplier_spend", "total_spend"),
        _counted(quality.name_match_check(supplier), "name_match", "dim_supplier", "supplier_entity_key"),
        _counted(quality.sentinel(model("stg_contracts"), "supplier_abn", "0"), "abn_sentinel", "stg_contracts", "supplier_abn"),
        _counted(quality.rollup_merge_check(supplier), "rollup_merge", "dim_supplier", "supplier_entity_key"),
        _counted(quality.placeholder_values(fact), "placeholder_values", "fct_contracts", "contract_value", "warn"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("status", F.when(F.col("n") == 0, "pass").otherwise(F.col("severity")))
