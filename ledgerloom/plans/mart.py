"""Mart: the reporting views.  Total and attributable spend are separate figures everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import normalize_name

MONEY = "decimal(38,2)"


def rpt_contracts(fact: DataFrame, supplier: DataFrame, non_suppliers: DataFrame, agency: DataFrame, category: DataFrame, dates: DataFrame, as_of: Column) -> DataFrame:
    """The star joined, one row a contract, with the one gate that says whether its value belongs to a named supplier."""
    s = supplier.select("supplier_key", "supplier_entity_key", "supplier_entity_name", "supplier_name", "supplier_abn", "abn_source", "supplier_abn_is_placeholder", normalize_name(F.col("supplier_name")).alias("_norm"))
    known = non_suppliers.select(F.col("normalized_name").alias("_norm"), F.col("category").alias("_channel")).dropDuplicates(["_norm"])
    rows = fact.join(s, "supplier_key", "left").join(known, "_norm", "left").join(agency, "agency_key", "left").join(category, "category_key", "left").join(dates.select(F.col("date_key").alias("publish_date_key"), F.col("year").alias("publish_year")), "publish_date_key", "left")
    begun = F.col("contract_start_date") <= as_of
    open_ = F.col("contract_end_date").isNull() | (F.col("contract_end_date") >= as_of)
    reason = F.when(F.col("supplier_abn_is_placeholder"), "agency ABN placeholder").when(F.col("_channel").isNotNull(), F.concat(F.lit("non-supplier: "), "_channel"))
    return rows.select(
        "contract_id", "source_notice_id", "amendment_no", "supplier_entity_key", "supplier_entity_name", "supplier_name", "supplier_abn", "abn_source", "agency_key", "agency_name", "agency_abn", "category_key", "category_name",
        "publish_date", "publish_year", "contract_start_date", "contract_end_date", "duration_days", F.coalesce(begun & open_, F.lit(False)).alias("is_active"), "contract_value",
        F.coalesce(~F.col("supplier_abn_is_placeholder") & F.col("_channel").isNull(), F.lit(False)).alias("is_attributable"), reason.alias("unattributable_reason"),
    )


def spend() -> tuple[Column, Column]:
    total = F.sum("contract_value").cast(MONEY).alias("total_spend")
    own = F.sum(F.when(F.col("is_attributable"), F.col("contract_value")).otherwise(F.lit(0).cast("decimal(18,2)"))).cast(MONEY).alias("attributable_spend")
    return total, own


def spend_by(contracts: DataFrame, name: str) -> DataFrame:
    """Spend by a name and year; parties that share a name fall together."""
    return contracts.where(F.col(name).isNotNull()).groupBy(name, "publish_year").agg(F.count("*").alias("contracts"), F.count_distinct("supplier_entity_key").alias("suppliers"), *spend())


def rpt_supplier_spend(contracts: DataFrame) -> DataFrame:
    return contracts.groupBy("supplier_entity_key").agg(F.max("supplier_entity_name").alias("supplier_entity_name"), F.bool_and("is_attributable").alias("is_attributable"), F.count("*").alias("contracts"), *spend())


def top_suppliers(supplier_spend: DataFrame, k: int) -> DataFrame:
    return supplier_spend.orderBy(F.desc("attributable_spend"), "supplier_entity_key").limit(k)


def rpt_bi_dim_supplier(supplier: DataFrame) -> DataFrame:
    return supplier.groupBy("supplier_entity_key").agg(F.min("supplier_entity_name").alias("supplier_entity_name"), F.count("*").alias("name_spellings"))


def rpt_supplier_history(history: DataFrame) -> DataFrame:
    return history.withColumn("is_current", F.col("valid_to").isNull())


def dynamic_agency_spend(raw: DataFrame) -> DataFrame:
    """A raw aggregate over all notices: it counts every amendment, on purpose."""
    return raw.groupBy(F.col("agencyname").alias("agency_name")).agg(F.count("*").alias("contract_count"), F.sum(F.col("value").try_cast("decimal(18,2)")).cast(MONEY).alias("total_value"))
