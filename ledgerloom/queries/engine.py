"""The layered model, loads, history, checks, measures and streams as queries, each with its SQL counterpart."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.access import Role, attributable_only, masked
from ledgerloom.operators import quality
from ledgerloom.operators.merge import load, merge
from ledgerloom.operators.scd2 import advance
from ledgerloom.functions.text import file_day
from ledgerloom.plans import checks, gold, mart, measures, staging
from ledgerloom.plans.registry import Models
from ledgerloom.plans.silver import dedup_notices
from ledgerloom.session import fresh_path, materialize, table
from ledgerloom.sources.files import CONTRACT_COLUMNS, read_contracts_csv, read_register_xml
from ledgerloom.sources.store import SnapshotStore
from ledgerloom.streaming import cdc

AS_OF = "2024-03-31"
#: The times of the loads, a month apart.
RUNS = tuple(f"{2024 + n // 12}-{n % 12 + 1:02d}-01 00:00:00" for n in range(120))
TEXT_COLUMNS = tuple(c for c in CONTRACT_COLUMNS if c != "cnid")
REGISTER_COLUMNS = ["abn", "abn_status", "abn_status_from_date", "entity_type_ind", "entity_type_text", "entity_name", "name_type", "state", "postcode"]
CHECKED = ("abr_entity_name", "abr_entity_type", "abr_abn_status", "supplier_abn_is_placeholder")


def _ts(text: str):
    return F.lit(text).cast("timestamp_ntz")


def bronze(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The bronze tables: null tokens applied; the register is its newest delivery, as each load replaces it."""
    register = staging.latest_delivery(table(spark, sf_dir, "raw_abr_entity"))
    return {
        "raw_contract_data": staging.null_tokens(table(spark, sf_dir, "raw_contract_data"), [*TEXT_COLUMNS, "cnid"]),
        "raw_abr_entity": staging.null_tokens(register, REGISTER_COLUMNS),
        "known_non_suppliers": table(spark, sf_dir, "known_non_suppliers"),
    }


def models(spark: SparkSession, sf_dir: str) -> Models:
    return Models(spark, bronze(spark, sf_dir), as_of=F.lit(AS_OF).cast("date"))


def _model(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return models(spark, sf_dir).build(name)

    query.__name__ = name
    return query


def amendment_parse(spark, sf_dir):
    rows = models(spark, sf_dir).build("stg_contracts").where("contract_id is not null").select("contract_id").distinct()
    return gold.with_chain(rows)


def top_suppliers(spark, sf_dir):
    return mart.top_suppliers(models(spark, sf_dir).build("rpt_supplier_spend"), 20)


# loads: every delivery in order, each as a scratch table with one row a key


def _run(n: int):
    return _ts(RUNS[n - 1])


def _deliveries(spark, sf_dir) -> tuple[DataFrame, list[str]]:
    """All deliveries with one row a day and notice key, the last loaded, then the greatest row number; and their days, few."""
    raw = bronze(spark, sf_dir)["raw_contract_data"].withColumn("_day", file_day(F.col("_source_file"))).where("_day is not null and cnid is not null")
    first = Window.partitionBy("_day", "cnid").orderBy(F.desc("_loaded_at"), F.desc("row_id"))
    rows = raw.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("_day", "cnid", *TEXT_COLUMNS)
    rows = materialize(rows, "deliveries")
    return rows, [r[0] for r in rows.select("_day").distinct().orderBy("_day").collect()]


def _steps(spark, sf_dir):
    """(load time, delivery) of every delivery, the oldest first; an empty one where there is none."""
    rows, days = _deliveries(spark, sf_dir)
    for n, day in enumerate(days or [""], 1):
        yield _run(n), rows.where(F.col("_day") == day).drop("_day")


def _loaded(spark, sf_dir, mode: str) -> DataFrame:
    state = None
    for at, rows in _steps(spark, sf_dir):
        state = load(state, rows, mode, "cnid", TEXT_COLUMNS, "_loaded_at", at)
        state = state if mode == "full" else materialize(state, "loaded")
    return state


def delta_merge(spark, sf_dir):
    return _loaded(spark, sf_dir, "delta")


def incremental_load(spark, sf_dir):
    return _loaded(spark, sf_dir, "incremental")


def full_load(spark, sf_dir):
    return _loaded(spark, sf_dir, "full")


def _merges(spark, sf_dir):
    """(load time, state before, merged rows with their actions) of every delta load after the first."""
    state = None
    for at, rows in _steps(spark, sf_dir):
        if state is None:
            state = load(None, rows, "full", "cnid", TEXT_COLUMNS, "_loaded_at", at)
            yield at, None, state
            continue
        merged = materialize(merge(state, rows, "cnid", TEXT_COLUMNS, "_loaded_at", at, prune=True, actions=True), "merged")
        yield at, state, merged
        state = merged.where("_action <> 'delete'").drop("_action")


def prune_missing(spark, sf_dir):
    """The keys that each delta load removes, and when; a key that returns can go again."""
    gone = None
    for at, before, merged in _merges(spark, sf_dir):
        own = (merged.where("false") if before is None else merged.where("_action = 'delete'")).select("cnid", at.alias("_removed_at"))
        gone = own if gone is None else gone.unionByName(own)
    return gone


# incremental fact: what was loaded by the middle of the deliveries, then all


def _halves(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    m = models(spark, sf_dir)
    silver = m.build("slv_contracts")
    early = m.build("stg_contracts").where(F.col("loaded_at") < _ts("2023-09-01 00:00:00"))
    return gold.fct_contracts(dedup_notices(early)), silver


def fact_incremental(spark, sf_dir):
    fact, silver = _halves(spark, sf_dir)
    return gold.fact_incremental(silver, materialize(fact, "fact"))


def affected_chains(spark, sf_dir):
    fact, silver = _halves(spark, sf_dir)
    return gold.affected_chains(silver, fact)


def gold_drift(spark, sf_dir):
    """A fact that was not brought up to date, against the present silver layer."""
    fact, silver = _halves(spark, sf_dir)
    return quality.gold_drift(silver, fact)


# history of the supplier dimension over all states of the register


def scd2_history(spark, sf_dir):
    """The supplier dimension as every extract of the register in order made it."""
    b = bronze(spark, sf_dir)
    columns = ("supplier_key", "supplier_name", "supplier_abn", *CHECKED)
    register = table(spark, sf_dir, "raw_abr_entity").withColumn("_day", file_day(F.col("_source_file"))).where("_day is not null")
    days = [r[0] for r in register.select("_day").distinct().orderBy("_day").collect()]
    silver = Models(spark, b).cut("slv_contracts")
    history = None
    for n, day in enumerate(days or [""], 1):
        extract = staging.null_tokens(register.where(F.col("_day") == day).drop("_day"), REGISTER_COLUMNS)
        now = Models(spark, b | {"raw_abr_entity": extract}, given={"slv_contracts": silver}).build("dim_supplier").select(*columns)
        history = materialize(advance(history, now, "supplier_key", CHECKED, _run(n)), "history")
    return mart.rpt_supplier_history(history)


# sources: the tables written as files and read back by the loaders


def csv_source(spark, sf_dir):
    """All notices as CSV files, through the reader of deliveries."""
    home = fresh_path(spark, "csv")
    raw = table(spark, sf_dir, "raw_contract_data").select(*CONTRACT_COLUMNS)
    raw.write.csv(home, header=True, quoteAll=True, quote='"', escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return read_contracts_csv(spark, home, _run(1)).drop("_source_file")


def _register_file(spark, sf_dir) -> str:
    """The newest extract as register XML, a record a number: its names sorted, main ones first."""
    safe = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    attribute = lambda name, c: F.coalesce(F.concat(F.lit(f' {name}="'), safe(c), F.lit('"')), F.lit(""))
    element = lambda name, c: F.coalesce(F.concat(F.lit(f"<{name}>"), safe(c), F.lit(f"</{name}>")), F.lit(""))
    rows = bronze(spark, sf_dir)["raw_abr_entity"].withColumn("abn", F.trim("abn")).where("abn <> ''")
    name = F.struct(~F.coalesce(F.col("name_type") == "MAIN", F.lit(False)), "entity_name", "name_type")
    plain = ("abn_status", "abn_status_from_date", "entity_type_ind", "entity_type_text", "state", "postcode")
    records = rows.groupBy("abn").agg(F.sort_array(F.collect_list(F.when(F.trim("entity_name") != "", name))).alias("names"), *[F.min(c).alias(c) for c in plain])
    kind = lambda n: F.when(n["name_type"] == "MAIN", "MN").otherwise(n["name_type"])
    names = F.transform("names", lambda n: F.concat(F.lit("<OtherEntity><NonIndividualName"), attribute("type", kind(n)), F.lit(">"), element("NonIndividualNameText", n["entity_name"]), F.lit("</NonIndividualName></OtherEntity>")))
    place = F.concat(F.lit("<MainEntity><BusinessAddress><AddressDetails>"), element("State", F.col("state")), element("Postcode", F.col("postcode")), F.lit("</AddressDetails></BusinessAddress></MainEntity>"))
    number = F.concat(F.lit("<ABN"), attribute("status", F.col("abn_status")), attribute("ABNStatusFromDate", F.col("abn_status_from_date")), F.lit(">"), safe(F.col("abn")), F.lit("</ABN>"))
    kinds = F.concat(F.lit("<EntityType>"), element("EntityTypeInd", F.col("entity_type_ind")), element("EntityTypeText", F.col("entity_type_text")), F.lit("</EntityType>"))
    home = fresh_path(spark, "xml")
    records.select(F.concat(F.lit("<ABR>"), number, kinds, place, F.array_join(names, ""), F.lit("</ABR>"))).write.text(home)
    return home


def register_xml(spark, sf_dir):
    """The newest extract as XML, through the register's reader: a row a name."""
    return read_register_xml(spark, _register_file(spark, sf_dir), _run(1)).drop("_source_file")


def record_names(spark, sf_dir):
    """How many names each number has, and its canonical one."""
    rows = register_xml(spark, sf_dir)
    return rows.groupBy("abn").agg(F.max(F.when(F.col("name_type") == "MAIN", F.col("entity_name"))).alias("main_name"), F.count("*").alias("names"))


# checks; those that are empty by construction get input that breaks them


def mart_reconcile(spark, sf_dir):
    m = models(spark, sf_dir)
    return quality.mart_reconcile(m.build("fct_contracts"), m.build("rpt_supplier_spend"))


def fk_orphans(spark, sf_dir):
    """Facts against a supplier dimension that lacks the suppliers without a stated number."""
    m = models(spark, sf_dir)
    return quality.relationships(m.build("fct_contracts"), "supplier_key", m.build("dim_supplier").where("supplier_abn <> 'UNKNOWN'"), "supplier_key")


def unique_violations(spark, sf_dir):
    return quality.unique(models(spark, sf_dir).build("stg_contracts"), "contract_id")


def not_null_violations(spark, sf_dir):
    return quality.not_null(models(spark, sf_dir).build("stg_contracts"), ["contract_id", "contract_value", "publish_date", "supplier_name", "supplier_abn", "agency_name", "loaded_at"])


def accepted_values(spark, sf_dir):
    return quality.accepted_values(table(spark, sf_dir, "raw_abr_entity"), "abn_status", ["ACT", "CAN"])


def abn_sentinel(spark, sf_dir):
    return quality.sentinel(bronze(spark, sf_dir)["raw_contract_data"], "supplierabn", "0")


def placeholder_values(spark, sf_dir):
    """Facts valued 1, among values cut down to their last digit so that there are some."""
    fact = models(spark, sf_dir).build("fct_contracts")
    return quality.placeholder_values(fact.withColumn("contract_value", (F.floor("contract_value") % 10).cast("decimal(18,2)")))


def rollup_merge_check(spark, sf_dir):
    """Against a dimension that groups by the register's type of entity instead of the number."""
    s = models(spark, sf_dir).build("dim_supplier")
    return quality.rollup_merge_check(s.withColumns({"supplier_entity_key": F.col("abr_entity_type"), "supplier_entity_name": F.col("abr_entity_type")}))


def name_match_check(spark, sf_dir):
    """Against a dimension that groups numbers found by name with those stated."""
    s = models(spark, sf_dir).build("dim_supplier")
    return quality.name_match_check(s.withColumn("supplier_entity_key", F.coalesce("resolved_abn", "supplier_entity_key")))


def one_row_per_abn(spark, sf_dir):
    """Over the register's names, where a number has several rows."""
    return quality.unique(models(spark, sf_dir).build("stg_abr_names"), "abn")


def freshness(spark, sf_dir):
    return quality.freshness(table(spark, sf_dir, "raw_contract_data"), "_loaded_at", F.lit(AS_OF))


def build_checks(spark, sf_dir):
    """All declared checks of a build, with their counts and status."""
    m = models(spark, sf_dir)
    for name in checks.READ_OFTEN:
        m.cut(name)
    history = mart.rpt_supplier_history(advance(None, m.build("dim_supplier").select("supplier_key", *CHECKED), "supplier_key", CHECKED, _run(1)))
    return checks.report(lambda name: history if name == "rpt_supplier_history" else m.build(name))


def measures_total(spark, sf_dir):
    return measures.totals(models(spark, sf_dir).build("rpt_contracts"), "agency_name")


def measure_prior_year(spark, sf_dir):
    return measures.prior_year(models(spark, sf_dir).build("rpt_contracts"))


def measure_yoy(spark, sf_dir):
    return measures.yoy(models(spark, sf_dir).build("rpt_contracts"))


def measure_ytd(spark, sf_dir):
    return measures.ytd(models(spark, sf_dir).build("rpt_contracts"))


def masked_contracts(spark, sf_dir):
    return masked(models(spark, sf_dir).build("rpt_contracts").select("contract_id", "supplier_name", "supplier_abn"), {Role.ANALYST})


def row_policy(spark, sf_dir):
    return attributable_only(models(spark, sf_dir).build("rpt_contracts").select("contract_id", "contract_value", "is_attributable"), {Role.ANALYST})


# streams


def cdc_merge(spark, sf_dir):
    """The changes of every delivery after the first, read as a stream and merged into the mirror of the first."""
    home = fresh_path(spark, "cdc")
    store = SnapshotStore(spark, f"{home}/mirror", ["contract_id"])
    for n, (at, before, merged) in enumerate(_merges(spark, sf_dir)):
        if before is None:
            store.commit(cdc.mirror(merged).withColumn("_merged_at", at))
            continue
        cdc.change_log(before, merged, "cnid", n).write.mode("append").parquet(f"{home}/log")
        cdc.start_merge(spark, f"{home}/log", store, f"{home}/checkpoint", at, availableNow=True).awaitTermination()
    return store.read()


def dynamic_agency_spend(spark, sf_dir):
    home = fresh_path(spark, "dynamic")
    path = f"{sf_dir}/raw_contract_data.parquet"
    schema = spark.read.parquet(path).schema
    folder, options = (path, {}) if os.path.isdir(path) else (sf_dir, {"pathGlobFilter": "raw_contract_data.parquet"})
    stream = spark.readStream.schema(schema).options(**options).parquet(folder)
    store = SnapshotStore(spark, f"{home}/spend")
    source = staging.null_tokens(stream, ["agencyname", "value"])
    cdc.start_aggregate(spark, source, mart.dynamic_agency_spend, store, f"{home}/checkpoint", availableNow=True).awaitTermination()
    return store.read()


_NAMES = {
    "stage_contracts": "stg_contracts", "dedup_notices": "slv_contracts", "collapse_chain": "fct_contracts", "register_entity": "stg_abr_entity", "register_names": "stg_abr_names", "name_lookup": "int_abr_name_lookup",
    **{n: n for n in ("dim_agency", "dim_category", "dim_date", "dim_supplier", "rpt_contracts", "rpt_agency_spend", "rpt_category_spend", "rpt_supplier_spend", "rpt_bi_dim_agency", "rpt_bi_dim_category", "rpt_bi_dim_supplier", "rpt_bi_dim_date")},
}
QUERIES = {name: _model(m) for name, m in _NAMES.items()} | {
    f.__name__: f
    for f in (
        amendment_parse, top_suppliers, delta_merge, incremental_load, full_load, prune_missing, fact_incremental, affected_chains, gold_drift, scd2_history, mart_reconcile, fk_orphans, unique_violations,
        not_null_violations, accepted_values, abn_sentinel, placeholder_values, rollup_merge_check, name_match_check, one_row_per_abn, freshness, measures_total, measure_prior_year, measure_yoy, measure_ytd,
        masked_contracts, row_policy, cdc_merge, dynamic_agency_spend, build_checks, csv_source, register_xml, record_names,
    )
}
