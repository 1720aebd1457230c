"""BI measures over the base reporting view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MONEY = "decimal(38,2)"
RATE = 6


def _ratio(a: Column, b: Column) -> Column:
    """A safe division: null where the divisor is 0 or null."""
    return F.round(F.try_divide(a.cast("double"), b.cast("double")), RATE)


def totals(contracts: DataFrame, *by: str) -> DataFrame:
    own = F.sum(F.when(F.col("is_attributable"), F.col("contract_value"))).cast(MONEY)
    total, n = F.sum("contract_value").cast(MONEY), F.count("*")
    # a missing supplier is a value of its own here
    suppliers = F.count_distinct("supplier_entity_key") + F.max(F.col("supplier_entity_key").isNull().cast("int"))
    return contracts.groupBy(*by).agg(
        n.alias("contract_count"), total.alias("total_spend"), own.alias("attributable_spend"), _ratio(own, total).alias("attributable_share"), F.count_if("is_active").alias("active_contracts"),
        F.coalesce(suppliers, F.lit(0)).cast("bigint").alias("distinct_suppliers"), _ratio(total, n).alias("avg_contract_value"),
    )


def by_year(contracts: DataFrame) -> DataFrame:
    return contracts.where("publish_year is not null").groupBy("publish_year").agg(F.sum("contract_value").cast(MONEY).alias("total_spend"))


def prior_year(contracts: DataFrame) -> DataFrame:
    """Each year beside the one before it; a year without a predecessor has null, not the last year there was."""
    year = by_year(contracts)
    before = year.select((F.col("publish_year") + 1).alias("publish_year"), F.col("total_spend").alias("total_spend_py"))
    return year.join(before, "publish_year", "left")


def yoy(contracts: DataFrame) -> DataFrame:
    return prior_year(contracts).select("publish_year", _ratio(F.col("total_spend") - F.col("total_spend_py"), F.col("total_spend_py")).alias("spend_yoy"))


def ytd(contracts: DataFrame) -> DataFrame:
    """Running totals within each year, by day; days are summed first, so a window holds days and not contracts."""
    days = contracts.where("publish_date is not null").groupBy("publish_year", "publish_date").agg(F.sum("contract_value").cast(MONEY).alias("spend"))
    running = Window.partitionBy("publish_year").orderBy("publish_date").rowsBetween(Window.unboundedPreceding, 0)
    return days.select("publish_year", "publish_date", F.sum("spend").over(running).cast(MONEY).alias("spend_ytd"))
