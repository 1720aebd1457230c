"""Staging: names, types and cleaned strings; no business logic."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import clean_string, file_day

#: The ways a contract file writes nothing.
NULL_TOKENS = ("", "NULL", "null")
#: Raw column to staged column, both families of text columns.
CONTRACT_TEXT = {
    "cnid": "contract_id", "agencyname": "agency_name", "agencyabn": "agency_abn", "suppliername": "supplier_name", "supplierabn": "supplier_abn", "supplierid": "supplier_source_id",
    "category": "category_name", "categoryunspsc": "category_unspsc", "procurementmethod": "procurement_method", "description": "contract_description", "sourceurl": "source_url",
}
CONTRACT_DATES = {"publishdate": "publish_date", "contractstart": "contract_start_date", "contractend": "contract_end_date"}


def null_tokens(raw: DataFrame, columns) -> DataFrame:
    """What the loader does: the three null tokens become null."""
    return raw.withColumns({c: F.when(~F.col(c).isin(*NULL_TOKENS), F.col(c)) for c in columns})


def iso_day(c):
    """The date of a text written yyyy-MM-dd, else null."""
    return F.when(c.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(c, "yyyy-MM-dd"))


def stage_contracts(raw: DataFrame) -> DataFrame:
    text = [clean_string(F.col(c)).alias(n) for c, n in CONTRACT_TEXT.items() if n != "supplier_abn"]
    # a zero says that there is no number: one representation of nothing from here on
    abn = F.nullif(clean_string(F.col("supplierabn")), F.lit("0")).alias("supplier_abn")
    dates = [iso_day(F.col(c)).alias(n) for c, n in CONTRACT_DATES.items()]
    return raw.select(*text, abn, F.col("value").try_cast("decimal(18,2)").alias("contract_value"), *dates, F.col("_loaded_at").alias("loaded_at"), F.col("_source_file").alias("source_file"))


def latest_delivery(raw: DataFrame) -> DataFrame:
    """The rows of the newest file day: each register load replaces the one before.  One text reaches the driver."""
    day = file_day(F.col("_source_file"))
    newest = raw.agg(F.max(day)).first()[0]
    return raw.where(day == F.lit(newest))


def register_entity(raw: DataFrame) -> DataFrame:
    """One row a number: its MAIN name, the first by name where there are several."""
    first = Window.partitionBy("abn").orderBy(F.asc_nulls_last("entity_name"), F.asc_nulls_last("_loaded_at"), F.asc_nulls_last("state"), F.asc_nulls_last("postcode"), F.asc_nulls_last("abn_status"), F.asc_nulls_last("abn_status_from_date"), F.asc_nulls_last("_source_file"))
    rows = raw.where((F.col("name_type") == "MAIN") & F.col("abn").isNotNull()).withColumn("_n", F.row_number().over(first)).where("_n = 1")
    names = ("abn", "abn_status", "entity_type_ind", "entity_type_text", "entity_name", "state", "postcode")
    clean = {n: clean_string(F.col(n)).alias(n) for n in names}
    return rows.select(
        clean["abn"], clean["abn_status"], F.try_to_date("abn_status_from_date", "yyyyMMdd").alias("abn_status_from_date"), clean["entity_type_ind"], clean["entity_type_text"], clean["entity_name"], clean["state"], clean["postcode"],
        F.coalesce(F.col("entity_type_text").ilike("%government%"), F.lit(False)).alias("is_government_entity"), F.col("_loaded_at").alias("loaded_at"), F.col("_source_file").alias("source_file"),
    )


def register_names(raw: DataFrame) -> DataFrame:
    """Every name each number is known by."""
    return raw.where("abn is not null and entity_name is not null").select(*[clean_string(F.col(c)).alias(c) for c in ("abn", "entity_name", "name_type")])
