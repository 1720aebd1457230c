"""Silver: one row a notice, and the names that lead to exactly one number."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import normalize_name

#: Names get Unknown, codes UNKNOWN; the two are told apart downstream.
NAMES = ("agency_name", "supplier_name", "category_name", "procurement_method")
CODES = ("agency_abn", "supplier_abn", "category_unspsc")


def dedup_notices(staged: DataFrame) -> DataFrame:
    """The latest load of each notice; only then are rows without a positive value dropped.

    A notice whose latest load has no positive value disappears: an older version must not come back.
    """
    order = [F.desc_nulls_last("loaded_at"), F.desc_nulls_last("contract_value"), F.desc_nulls_last("contract_end_date"), F.coalesce("source_url", F.lit("")), *[F.asc_nulls_last(c) for c in ("supplier_name", "supplier_abn", "agency_name", "category_name", "category_unspsc", "procurement_method", "contract_description", "publish_date", "contract_start_date", "agency_abn")]]
    latest = staged.where("contract_id is not null").withColumn("_n", F.row_number().over(Window.partitionBy("contract_id").orderBy(*order))).where("_n = 1")
    filled = {c: F.coalesce(c, F.lit("Unknown")) for c in NAMES} | {c: F.coalesce(c, F.lit("UNKNOWN")) for c in CODES}
    good = latest.where("contract_value > 0").withColumns(filled).withColumn("duration_days", F.datediff("contract_end_date", "contract_start_date"))
    return good.select(
        "contract_id", "agency_name", "agency_abn", "supplier_name", "supplier_abn", "category_name", "category_unspsc", "procurement_method", "contract_description", "source_url",
        "contract_value", "publish_date", "contract_start_date", "contract_end_date", "duration_days", "loaded_at",
    )


def name_lookup(silver: DataFrame, names: DataFrame) -> DataFrame:
    """Normalised names of suppliers without a number that belong to exactly one register number."""
    wanted = silver.where("supplier_abn = 'UNKNOWN' and supplier_name <> 'Unknown'").select(normalize_name(F.col("supplier_name")).alias("normalized_name")).distinct()
    known = names.where("entity_name is not null").select(normalize_name(F.col("entity_name")).alias("normalized_name"), "abn").distinct()
    found = known.join(wanted, "normalized_name", "left_semi").groupBy("normalized_name").agg(F.count_distinct("abn").alias("n"), F.max("abn").alias("matched_abn"))
    return found.where("n = 1").select("normalized_name", "matched_abn")
