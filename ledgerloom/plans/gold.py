"""Gold: the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import amendment_no, base_contract_id, normalize_name, surrogate_key

#: The calendar's first day and the day after its last.
CALENDAR = ("1985-01-01", "2045-01-01")


def dimension(silver: DataFrame, key: str, name: str, code: str) -> DataFrame:
    """The distinct pairs of name and code under a surrogate key."""
    return silver.select(name, code).distinct().select(surrogate_key(F.col(name), F.col(code)).alias(key), name, code)


def dim_agency(silver: DataFrame) -> DataFrame:
    return dimension(silver, "agency_key", "agency_name", "agency_abn")


def dim_category(silver: DataFrame) -> DataFrame:
    return dimension(silver, "category_key", "category_name", "category_unspsc")


def dim_date(spark: SparkSession) -> DataFrame:
    day = F.col("full_date")
    days = spark.range(1).select(F.explode(F.sequence(F.lit(CALENDAR[0]).cast("date"), F.date_sub(F.lit(CALENDAR[1]).cast("date"), 1))).alias("full_date"))
    return days.select(
        F.date_format(day, "yyyyMMdd").cast("int").alias("date_key"), "full_date", F.year(day).alias("year"), F.quarter(day).alias("quarter"), F.month(day).alias("month"), F.monthname(day).alias("month_name"),
        F.dayofmonth(day).alias("day_of_month"), (F.dayofweek(day) - 1).alias("day_of_week"), F.dayname(day).alias("day_name"), F.dayname(day).isin("Sat", "Sun").alias("is_weekend"),
    )


def dim_supplier(silver: DataFrame, lookup: DataFrame, register: DataFrame) -> DataFrame:
    """Stated pairs of supplier name and number, with what the register knows and the real entity they belong to.

    A stated number groups only if the register has it and it is no government body's standing in for another
    name; everything else groups by normalised name.  A number found by name is a suggestion and never groups.
    """
    pairs = silver.select("supplier_name", "supplier_abn").distinct().withColumn("_norm", normalize_name(F.col("supplier_name")))
    # only pairs without a number look one up, and the condition stays in the join so that the others survive
    found = pairs.join(lookup, (F.col("_norm") == F.col("normalized_name")) & (F.col("supplier_abn") == "UNKNOWN"), "left")
    stated = F.col("supplier_abn") != "UNKNOWN"
    found = found.select("supplier_name", "supplier_abn", "_norm", F.when(stated, F.col("supplier_abn")).otherwise(F.col("matched_abn")).alias("resolved_abn"), F.when(stated, "stated").when(F.col("matched_abn").isNotNull(), "abr_name_match").otherwise("none").alias("abn_source"))
    known = register.select(F.col("abn").alias("_abn"), F.col("entity_name").alias("abr_entity_name"), F.col("entity_type_text").alias("abr_entity_type"), F.col("abn_status").alias("abr_abn_status"), "is_government_entity")
    rows = found.join(known, F.col("resolved_abn") == F.col("_abn"), "left")
    own = F.col("abn_source") == "stated"
    placeholder = F.coalesce(own & F.col("is_government_entity") & (F.col("_norm") != normalize_name(F.col("abr_entity_name"))), F.lit(False))
    rows = rows.withColumn("supplier_abn_is_placeholder", placeholder)
    vouched = own & F.col("abr_entity_name").isNotNull() & ~F.col("supplier_abn_is_placeholder")
    rows = rows.withColumns({"_entity": F.when(vouched, F.concat(F.lit("ABN:"), "supplier_abn")).otherwise(F.concat(F.lit("NAME:"), "_norm")), "_shown": F.when(vouched, F.col("abr_entity_name")).otherwise(F.col("supplier_name"))})
    shown = rows.groupBy("_entity").agg(F.min("_shown").alias("supplier_entity_name"))
    return rows.join(shown, "_entity").select(
        surrogate_key(F.col("supplier_name"), F.col("supplier_abn")).alias("supplier_key"), "supplier_name", "supplier_abn", "resolved_abn", "abn_source", "abr_entity_name", "abr_entity_type", "abr_abn_status",
        "supplier_abn_is_placeholder", surrogate_key(F.col("_entity")).alias("supplier_entity_key"), "supplier_entity_name",
    )


def with_chain(silver: DataFrame) -> DataFrame:
    return silver.withColumns({"base_id": base_contract_id(F.col("contract_id")), "amendment_no": amendment_no(F.col("contract_id"))})


def fct_contracts(silver: DataFrame) -> DataFrame:
    """One row a contract: its highest amendment, stamped with the latest load of the whole chain.

    One aggregation, combined on the map side, so a chain with very many notices reaches its task as a few rows.
    The chain's latest load covers all versions: a late amendment that loses still moves it.  An unknown load
    time counts as the latest.
    """
    payload = ("agency_name", "agency_abn", "supplier_name", "supplier_abn", "category_name", "category_unspsc", "contract_value", "duration_days", "procurement_method", "publish_date", "contract_start_date", "contract_end_date")
    version = F.struct("amendment_no", F.col("loaded_at").isNull().alias("_u"), "loaded_at", "contract_id", *payload)
    rows = with_chain(silver).groupBy("base_id").agg(F.max(version).alias("v"), F.max("loaded_at").alias("chain_loaded_at"))
    v = {c: F.col(f"v.{c}") for c in payload}
    return rows.select(
        F.col("base_id").alias("contract_id"), F.col("v.contract_id").alias("source_notice_id"), "v.amendment_no",
        surrogate_key(v["supplier_name"], v["supplier_abn"]).alias("supplier_key"), surrogate_key(v["agency_name"], v["agency_abn"]).alias("agency_key"), surrogate_key(v["category_name"], v["category_unspsc"]).alias("category_key"),
        F.date_format(v["publish_date"], "yyyyMMdd").cast("int").alias("publish_date_key"), *[v[c].alias(c) for c in ("contract_value", "duration_days", "procurement_method", "publish_date", "contract_start_date", "contract_end_date")],
        F.col("chain_loaded_at").alias("loaded_at"),
    )


def affected_chains(silver: DataFrame, fact: DataFrame) -> DataFrame:
    """Base ids with a notice loaded after everything the fact has seen; all of them where the fact is empty."""
    seen = fact.agg(F.max("loaded_at").alias("_seen"))
    late = with_chain(silver).select("base_id", "loaded_at").join(seen, F.col("_seen").isNull() | (F.col("loaded_at") > F.col("_seen")), "left_semi")
    return late.select("base_id").distinct()


def fact_incremental(silver: DataFrame, fact: DataFrame) -> DataFrame:
    """The fact after a run over the affected chains: these are collapsed anew, all other rows stay, none is deleted."""
    touched = affected_chains(silver, fact)
    own = with_chain(silver).join(touched, "base_id", "left_semi").drop("base_id", "amendment_no")
    kept = fact.join(touched.withColumnRenamed("base_id", "contract_id"), "contract_id", "left_anti")
    return kept.select(*fact.columns).unionByName(fct_contracts(own))
