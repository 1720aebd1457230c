"""Checks that return the offending rows, and a runner that turns counts into a status."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import amendment_no, base_contract_id

CONTENT = ("contract_value", "duration_days", "procurement_method", "publish_date", "contract_start_date", "contract_end_date")


def not_null(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n) of the columns that hold nulls; one pass for all columns."""
    counts = rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], list(columns), "column", "n").where("n > 0")


def unique(rows: DataFrame, column: str) -> DataFrame:
    return rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).where("n > 1")


def accepted_values(rows: DataFrame, column: str, values: Sequence) -> DataFrame:
    return rows.where(F.col(column).isNotNull() & ~F.col(column).isin(*values)).groupBy(column).agg(F.count("*").alias("n"))


def relationships(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """(column, n) of the child's values that the parent lacks; looked up once a value."""
    stated = child.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return stated.join(parent.select(F.col(key).alias(column)), column, "left_anti")


def gold_drift(silver: DataFrame, fact: DataFrame) -> DataFrame:
    """Contracts that the fact lacks, has too many, or holds with stale content; the winners are derived anew here."""
    base, number = base_contract_id(F.col("contract_id")), amendment_no(F.col("contract_id"))
    first = Window.partitionBy("_base").orderBy(F.desc("_number"), F.desc_nulls_first("loaded_at"), F.desc("contract_id"))
    expected = silver.withColumns({"_base": base, "_number": number}).withColumn("_n", F.row_number().over(first)).where("_n = 1").select(F.col("_base").alias("contract_id"), F.struct(*CONTENT).alias("e"))
    both = expected.join(fact.select("contract_id", F.struct(*CONTENT).alias("a")), "contract_id", "full_outer")
    issue = F.when(F.col("a").isNull(), "missing_in_gold").when(F.col("e").isNull(), "not_in_silver").when(~F.col("a").eqNullSafe(F.col("e")), "stale_value_in_gold")
    return both.select("contract_id", issue.alias("issue")).where("issue is not null")


def mart_reconcile(fact: DataFrame, supplier_spend: DataFrame, money: str = "decimal(38,2)") -> DataFrame:
    """The totals of fact and mart side by side and whether they agree; a missing side does not agree."""
    a = fact.agg(F.sum("contract_value").cast(money).alias("fact_total"))
    b = supplier_spend.agg(F.sum("total_spend").cast(money).alias("mart_total"), F.sum("attributable_spend").cast(money).alias("mart_attributable"))
    return a.crossJoin(b).withColumn("agrees", F.col("fact_total").eqNullSafe(F.col("mart_total")) & (F.coalesce("mart_attributable", F.lit(0)) <= F.coalesce("mart_total", F.lit(0))))


def vouched(supplier: DataFrame) -> Column:
    return (F.col("abn_source") == "stated") & ~F.col("supplier_abn_is_placeholder") & F.col("abr_entity_name").isNotNull()


def name_match_check(supplier: DataFrame) -> DataFrame:
    """Suppliers whose number was only found by name but that share an entity with a vouched number."""
    own = supplier.where(vouched(supplier)).select("supplier_entity_key").distinct()
    return supplier.where("abn_source = 'abr_name_match'").join(own, "supplier_entity_key", "left_semi").select("supplier_key", "supplier_name", "supplier_entity_key")


def rollup_merge_check(supplier: DataFrame) -> DataFrame:
    rows = supplier.where("abr_entity_name is not null and not supplier_abn_is_placeholder")
    return rows.groupBy("supplier_entity_key", "supplier_entity_name").agg(F.count_distinct("supplier_abn").alias("trustworthy_abns")).where("trustworthy_abns > 1")


def sentinel(rows: DataFrame, column: str, value: str) -> DataFrame:
    return rows.where(F.col(column) == value).groupBy(column).agg(F.count("*").alias("rows_affected"))


def placeholder_values(fact: DataFrame) -> DataFrame:
    return fact.where("contract_value = 1").select("contract_id", "source_notice_id", "contract_value")


def freshness(rows: DataFrame, loaded: str, now: Column, warn_days: int = 30, error_days: int = 90) -> DataFrame:
    """(newest, age_days, status) of a source; an empty one is an error."""
    newest = rows.agg(F.max(loaded).alias("newest")).withColumn("age_days", F.datediff(F.to_date(now), F.to_date("newest")))
    return newest.withColumn("status", F.when(F.col("newest").isNull() | (F.col("age_days") > error_days), "error").when(F.col("age_days") > warn_days, "warn").otherwise("pass"))


@dataclass(frozen=True)
class Check:
    name: str
    rows: DataFrame
    severity: str = "error"

    def status(self) -> tuple[str, int]:
        n = self.rows.count()
        return ("pass" if not n else self.severity), n


def run_checks(checks: Sequence[Check]) -> list[tuple[str, str, int]]:
    return [(c.name, *c.status()) for c in checks]
