import datetime as dt
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerloom.access import Facade, Role, attributable_only, masked
from ledgerloom.functions.text import amendment_no, clean_string
from ledgerloom.operators import quality
from ledgerloom.operators.merge import AmbiguousMerge, load, merge
from ledgerloom.operators.scd2 import advance
from ledgerloom.plans import gold, measures, staging
from ledgerloom.plans.registry import Models
from ledgerloom.plans.silver import dedup_notices
from ledgerloom.sources.files import read_contracts_csv, read_register_xml, read_seed, verify_count
from ledgerloom.sources.store import LostUpdate, SnapshotStore
from ledgerloom.streaming import cdc

COLUMNS = ("agencyname", "value", "suppliername", "description", "publishdate", "contractstart", "contractend", "procurementmethod", "category", "agencyabn", "supplierabn", "categoryunspsc", "cnid", "supplierid", "sourceurl")
T1, T2 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)


def contracts(spark, rows):
    full = [tuple((r | {"_loaded_at": r.get("_loaded_at", T1), "_source_file": "notices_full_20240101_c1.csv"}).get(c) for c in (*COLUMNS, "_loaded_at", "_source_file")) for r in rows]
    return spark.createDataFrame(full, ", ".join(f"{c} string" for c in COLUMNS) + ", _loaded_at timestamp_ntz, _source_file string")


def notice(cnid, value="5", **more):
    return {"cnid": cnid, "value": value, "suppliername": "S", "agencyname": "A"} | more


def fact(spark, rows):
    return {r.contract_id: r for r in gold.fct_contracts(dedup_notices(staging.stage_contracts(contracts(spark, rows)))).collect()}


def test_chains_collapse_by_number(spark):
    f = fact(spark, [notice("7"), notice("7-A9"), notice("7-A10"), notice("8-A1"), notice("8-A2")])
    assert (f["7"].amendment_no, f["7"].source_notice_id, f["8"].amendment_no) == (10, "7-A10", 2)


def test_the_latest_load_decides_before_the_value_filter(spark):
    f = fact(spark, [notice("9", "50"), notice("9", "0", _loaded_at=T2), notice("10", "5"), notice("10-A1", "n/a")])
    assert "9" not in f and f["10"].amendment_no == 0


def test_a_late_loser_moves_the_chain(spark):
    f = fact(spark, [notice("11-A2"), notice("11-A1", _loaded_at=T2)])
    assert (f["11"].source_notice_id, f["11"].loaded_at) == ("11-A2", T2)


def test_ties_within_a_load(spark):
    s = dedup_notices(staging.stage_contracts(contracts(spark, [notice("1", "5"), notice("1", "7", contractend="2020-01-01"), notice("1", "7", contractend="2021-01-01", sourceurl="b"), notice("1", "7", contractend="2021-01-01", sourceurl="a")])))
    r = s.first()
    assert (str(r.contract_value), r.source_url) == ("7.00", "a")


def test_staging(spark):
    rows = [notice("1", v, supplierabn=a, publishdate=d) for v, a, d in (("1.005", "0", "2011-13-01"), ("$5", "", "2011-2-3"), ("1,000", " ", "2011-02-03"), ("12345678901234567890", None, ""))]
    s = staging.stage_contracts(contracts(spark, rows)).collect()
    assert [str(r.contract_value) for r in s] == ["1.01", "None", "None", "None"]
    assert {r.supplier_abn for r in s} == {None} and [r.publish_date for r in s] == [None, None, dt.date(2011, 2, 3), None]
    assert dedup_notices(staging.stage_contracts(contracts(spark, [notice("1", suppliername=None, procurementmethod=" ")]))).first().asDict()["supplier_abn"] == "UNKNOWN"


REGISTER = "abn string, abn_status string, abn_status_from_date string, entity_type_ind string, entity_type_text string, entity_name string, name_type string, state string, postcode string, _loaded_at timestamp_ntz, _source_file string"


def register(spark, rows):
    return spark.createDataFrame([(a, "ACT", "20200101", "X", t, n, k, "NSW", "0800", T1, "f") for a, t, n, k in rows], REGISTER)


def built(spark, rows, reg, seeds=()):
    return Models(spark, {"raw_contract_data": contracts(spark, rows), "raw_abr_entity": register(spark, reg), "known_non_suppliers": spark.createDataFrame(list(seeds), "normalized_name string, category string, reason string")}, as_of=F.lit("2024-01-15").cast("date"))


REG = [("1", "Private", "ACME PTY", "MAIN"), ("9", "State Government", "WATER BOARD", "MAIN"), ("9", "State Government", "WATERY", "TRD"), ("2", "Private", "TWIN", "MAIN"), ("3", "Private", "TWIN", "MAIN"), ("4", "Private", "SOLO CO", "MAIN")]


def test_every_branch_of_the_supplier_dimension(spark):
    rows = [notice(str(i), suppliername=n, supplierabn=a) for i, (n, a) in enumerate([("Acme (Pty)", "1"), ("Who", "77"), ("Bob", "9"), ("Water-Board", "9"), ("Solo Co.", None), ("Twin", None), ("Nobody", None), ("Watery", "0")])]
    got = {r.supplier_name: r for r in built(spark, rows, REG).build("dim_supplier").collect()}
    assert {n: (r.abn_source, r.resolved_abn, r.supplier_abn_is_placeholder) for n, r in got.items()} == {
        "Acme (Pty)": ("stated", "1", False), "Who": ("stated", "77", False), "Bob": ("stated", "9", True), "Water-Board": ("stated", "9", False),
        "Solo Co.": ("abr_name_match", "4", False), "Twin": ("none", None, False), "Nobody": ("none", None, False), "Watery": ("abr_name_match", "9", False),
    }
    assert (got["Acme (Pty)"].supplier_entity_name, got["Bob"].supplier_entity_name, got["Solo Co."].supplier_entity_name) == ("ACME PTY", "Bob", "Solo Co.")


def test_an_empty_register_keeps_the_build_green(spark):
    m = built(spark, [notice("1", suppliername="X", supplierabn="5"), notice("2", suppliername="Y")], [])
    got = {r.supplier_name: (r.abn_source, r.resolved_abn, r.abr_entity_name) for r in m.build("dim_supplier").collect()}
    assert got == {"X": ("stated", "5", None), "Y": ("none", None, None)}
    assert m.build("rpt_supplier_spend").count() == 2


def test_the_gate_and_active_contracts(spark):
    rows = [notice("1", suppliername="Card Holders"), notice("2", suppliername="Bob", supplierabn="9"), notice("3", contractstart="2024-01-15"), notice("4", contractstart="2023-01-01", contractend="2024-01-15"), notice("5", contractend="2030-01-01"), notice("6", contractstart="2024-01-16")]
    m = built(spark, rows, REG, [("CARD HOLDERS", "internal", "r"), ("CARD HOLDERS", "internal", "again")])
    got = {r.contract_id: r for r in m.build("rpt_contracts").collect()}
    assert (got["1"].unattributable_reason, got["1"].is_attributable) == ("non-supplier: internal", False)
    assert got["2"].unattributable_reason == "agency ABN placeholder"
    assert [got[i].is_active for i in "3456"] == [True, True, False, False] and len(got) == 6
    assert quality.mart_reconcile(m.build("fct_contracts"), m.build("rpt_supplier_spend")).first().agrees


def test_two_main_rows(spark):
    r = staging.register_entity(register(spark, [("1", "P", "B", "MAIN"), ("1", "P", "A", "MAIN"), ("1", "P", None, "MAIN"), (None, "P", "Z", "MAIN")])).collect()
    assert [(x.abn, x.entity_name) for x in r] == [("1", "A")]


# loads


def target(spark, rows):
    return spark.createDataFrame(rows, "cnid string, v string, publishdate string, _loaded_at timestamp_ntz")


def state(df):
    return sorted(((r.cnid, r.v, r._loaded_at) for r in df.collect()), key=str)


def go(spark, old, new, mode, at=T2):
    return load(target(spark, old), target(spark, [(*r, None) for r in new]).drop("_loaded_at"), mode, "cnid", ["v", "publishdate"], "_loaded_at", F.lit(at).cast("timestamp_ntz"))


def test_load_modes(spark):
    old = [("a", "1", "2020-01-01", T1), ("b", None, "2020-01-02", T1), ("c", "3", "2020-01-03", T1), (None, "n", "2020-01-01", T1)]
    new = [("a", "1", "2020-01-01"), ("b", "2", "2020-01-03"), ("d", "4", "2020-01-04"), ("e", "5", ""), (None, "n", "2020-01-05")]
    assert state(go(spark, old, new, "delta")) == sorted([("a", "1", T1), ("b", "2", T2), ("d", "4", T2), ("e", "5", T2), (None, "n", T2)], key=str)
    assert state(go(spark, old, new, "incremental")) == sorted([("a", "1", T1), ("b", "2", T2), ("c", "3", T1), ("d", "4", T2), (None, "n", T1), (None, "n", T2)], key=str)
    assert state(go(spark, old, new, "full")) == sorted([(k, v, T2) for k, v, _ in new], key=str)
    with pytest.raises(ValueError):
        go(spark, old, new, "other")


def test_loading_twice_changes_nothing(spark):
    new = [("a", "1", "2020-01-01"), ("b", None, None)]
    once = go(spark, [], new, "delta")
    again = load(once, target(spark, [(*r, None) for r in new]).drop("_loaded_at"), "delta", "cnid", ["v", "publishdate"], "_loaded_at", F.lit(dt.datetime(2025, 1, 1)).cast("timestamp_ntz"))
    assert state(again) == state(once)


def test_ambiguous_sources(spark):
    with pytest.raises(AmbiguousMerge):
        go(spark, [("a", "1", None, T1)], [("a", "2", None), ("a", "3", None)], "delta")
    assert len(state(go(spark, [], [("a", "2", None), ("a", "3", None)], "delta"))) == 2


def test_incremental_fact_equals_a_rebuild(spark):
    stg = lambda rows: dedup_notices(staging.stage_contracts(contracts(spark, rows)))
    first = [notice("1"), notice("2"), notice("2-A1"), notice("3")]
    more = first + [notice("2-A2", "9", _loaded_at=T2), notice("4", _loaded_at=T2), notice("1", "8", _loaded_at=T2)]
    f1 = gold.fct_contracts(stg(first))
    key = lambda d: sorted(map(str, d.collect()))
    assert key(gold.fact_incremental(stg(more), f1)) == key(gold.fct_contracts(stg(more)).select(*f1.columns))
    assert gold.affected_chains(stg(first), f1).count() == 0
    assert key(gold.fact_incremental(stg(first), f1.limit(0))) == key(f1)
    gone = gold.fact_incremental(stg(first[:3]), f1)
    assert {(r.contract_id, r.issue) for r in quality.gold_drift(stg(first[:3]), gone).collect()} == {("3", "not_in_silver")}
    assert {(r.contract_id, r.issue) for r in quality.gold_drift(stg(first[:2]), gone).collect()} == {("3", "not_in_silver")}
    assert {(r.contract_id, r.issue) for r in quality.gold_drift(stg(more), gone).collect()} == {("3", "x")} - {("3", "x")} | {("1", "stale_value_in_gold"), ("2", "stale_value_in_gold"), ("4", "missing_in_gold")}


def test_type_two_history(spark):
    rows = lambda xs: spark.createDataFrame(xs, "k string, v string, note string")
    ts = lambda n: F.lit(dt.datetime(2024, 1, n)).cast("timestamp_ntz")
    h = advance(None, rows([("same", "1", "a"), ("changed", "1", "a"), ("gone", "1", "a"), ("null", None, "a")]), "k", ["v"], ts(1))
    h = advance(h, rows([("same", "1", "b"), ("changed", "2", "a"), ("null", "1", "a"), ("new", "1", "a")]), "k", ["v"], ts(2))
    h = advance(h, rows([("same", "1", "b"), ("changed", "2", "a"), ("null", "1", "a"), ("gone", "1", "a")]), "k", ["v"], ts(3))
    got = sorted((r.k, r.v, r.valid_from.day, r.valid_to.day if r.valid_to else None) for r in h.where("k <> 'null'").collect())
    assert got == [("changed", "1", 1, 2), ("changed", "2", 2, None), ("gone", "1", 1, 2), ("gone", "1", 3, None), ("new", "1", 2, 3), ("same", "1", 1, None)]
    assert h.where("k = 'null' and valid_to is null").first().v == "1" and h.where("k = 'null'").count() == 2


# sinks, sources, streams, access


def test_store(spark, tmp_path):
    s = SnapshotStore(spark, f"file://{tmp_path}/t")
    assert not s.exists() and s.version == 0
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    s.commit(df, note="x")
    bad = df.withColumn("v", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception):
        s.commit(bad)
    assert (s.version, s.read().count(), s.meta) == (1, 2, {"note": "x"})
    s.commit(s.read().where("k = 1"))
    assert s.read().count() == 1 and s.version == 2
    s.commit(df.limit(0))
    assert s.read().count() == 0


def test_store_refuses_to_undo_another_writer(spark, tmp_path):
    s = SnapshotStore(spark, f"file://{tmp_path}/t", ["k"])
    df = spark.createDataFrame([(i, "a") for i in range(50)], "k int, v string")
    s.commit(df, 50)
    with pytest.raises(LostUpdate):
        s.commit(df.limit(1), after=0)
    assert s.read().count() == 50 and s.manifest()["buckets"] == 16
    s.append(df.limit(1))
    assert s.read().count() == 51 and s.read_touched(df.where("k < 3")).count() in (3, 4)
    s.replace_chains(df.where("k = 7").withColumn("v", F.lit("b")), df.where("k in (7, 8)"))
    assert [r.v for r in s.read().where("k in (7, 8)").collect()] == ["b"]
    assert SnapshotStore(spark, f"file://{tmp_path}/u", ["k"], bucket_rows=2).commit(df, 50) == 1
    assert SnapshotStore(spark, f"file://{tmp_path}/u").manifest()["buckets"] == 25


def test_csv(spark, tmp_path):
    line = ",".join(f'"{c} ""q"""' if i == 3 else ("NULL" if i == 4 else c) for i, c in enumerate(COLUMNS))
    good = tmp_path / "good.csv"
    good.write_text("h" + ",h" * 14 + "\n" + line + "\n" + line.replace("NULL", "") + "\n")
    rows = read_contracts_csv(spark, str(good), F.lit(T1).cast("timestamp_ntz"))
    r = rows.first()
    assert (verify_count(rows, 2), r.description, r.publishdate, r._source_file) == (2, 'description "q"', None, "good.csv")
    with pytest.raises(ValueError):
        verify_count(rows, 3)
    bad = tmp_path / "bad.csv"
    bad.write_text("h" + ",h" * 14 + "\n" + line + "\na,b\n")
    with pytest.raises(Exception):
        read_contracts_csv(spark, str(bad), F.lit(T1).cast("timestamp_ntz")).collect()
    seed = tmp_path / "seed.csv"
    seed.write_text('normalized_name,category,reason\nX,panel,"a, b"\n')
    assert read_seed(spark, str(seed)).first().reason == "a, b"


def test_register_xml(spark, tmp_path):
    f = tmp_path / "r.xml"
    f.write_text("""<T><ABR><ABN status="ACT" ABNStatusFromDate="20200101">01234567890</ABN><EntityType><EntityTypeInd>PRV</EntityTypeInd><EntityTypeText>Private</EntityTypeText></EntityType>
<MainEntity><NonIndividualName type="MN"><NonIndividualNameText>Main Co</NonIndividualNameText></NonIndividualName><BusinessAddress><AddressDetails><State>NT</State><Postcode>0800</Postcode></AddressDetails></BusinessAddress></MainEntity>
<OtherEntity><NonIndividualName type="TRD"><NonIndividualNameText>Trade</NonIndividualNameText></NonIndividualName></OtherEntity><OtherEntity><NonIndividualName><NonIndividualNameText>MAIN CO</NonIndividualNameText></NonIndividualName></OtherEntity></ABR>
<ABR><ABN status="CAN" ABNStatusFromDate="20200101">2</ABN><LegalEntity><IndividualName type="LGL"><GivenName>Ann</GivenName><GivenName>Bea</GivenName><FamilyName>Cee</FamilyName></IndividualName></LegalEntity><OtherEntity><NonIndividualName type="TRD"><NonIndividualNameText>Shop</NonIndividualNameText></NonIndividualName></OtherEntity></ABR>
<ABR><ABN></ABN><MainEntity><NonIndividualName type="MN"><NonIndividualNameText>None</NonIndividualNameText></NonIndividualName></MainEntity></ABR></T>""")
    got = [(r.abn, r.name_type, r.entity_name, r.state, r.postcode) for r in read_register_xml(spark, str(f), F.lit(T1).cast("timestamp_ntz")).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [("01234567890", "MAIN", "Main Co", "NT", "0800"), ("01234567890", "TRD", "Trade", "NT", "0800"), ("2", "MAIN", "Ann Cee", None, None), ("2", "TRD", "Shop", None, None)]))


def test_register_records_at_any_depth_and_in_archives(spark, tmp_path):
    record = """<ABR><ABN status="ACT">7</ABN><X><Deep><NonIndividualName type="OTN"><NonIndividualNameText>Deep &amp; Co</NonIndividualNameText></NonIndividualName></Deep></X>
<Y><AddressDetails><State>WA</State></AddressDetails><AddressDetails><State>SA</State><Postcode>5000</Postcode></AddressDetails></Y></ABR>"""
    with zipfile.ZipFile(tmp_path / "r.zip", "w") as z:
        z.writestr("a.xml", f"<T>{record}{record.replace('>7<', '>8<')}</T>")
        z.writestr("b.xml", "<T></T>")
        z.writestr("c.txt", record)
    rows = read_register_xml(spark, f"file://{tmp_path}/r.zip", F.lit(T1).cast("timestamp_ntz")).collect()
    assert sorted((r.abn, r.name_type, r.entity_name, r.state, r.postcode, r._source_file) for r in rows) == [(n, "MAIN", "Deep & Co", "WA", "5000", "a.xml") for n in ("7", "8")]
    bad = tmp_path / "bad.xml"
    bad.write_text("<T><ABR><ABN>1</X></ABR></T>")
    with pytest.raises(Exception, match="mismatched"):
        read_register_xml(spark, str(bad), F.lit(T1).cast("timestamp_ntz")).collect()


def test_changes_are_merged_and_replays_skipped(spark, tmp_path):
    log = contracts(spark, [notice("new"), notice("up", "1"), notice("up", "2"), notice("del"), notice("stray"), notice("both", "1"), notice("both", "3"), notice(None)])
    flags = [("INSERT", False), ("DELETE", True), ("INSERT", True), ("DELETE", False), ("DELETE", False), ("INSERT", False), ("INSERT", False), ("INSERT", False)]
    rows = [(*r, *f, i) for i, (r, f) in enumerate(zip(log.collect(), flags))]
    log = spark.createDataFrame(rows, log.schema.add("_action", "string").add("_is_update", "boolean").add("_seq", "long"))
    log.write.parquet(f"file://{tmp_path}/log")
    store = SnapshotStore(spark, f"file://{tmp_path}/mirror", ["contract_id"])
    at = lambda n: F.lit(dt.datetime(2024, 1, n)).cast("timestamp_ntz")
    store.commit(cdc.mirror(contracts(spark, [notice("up", "1"), notice("del"), notice("rest")])).withColumn("_merged_at", at(1)))
    for _ in range(2):
        cdc.start_merge(spark, f"file://{tmp_path}/log", store, f"file://{tmp_path}/check", at(9), availableNow=True).awaitTermination()
    got = {r.contract_id: (str(r.contract_value), r._merged_at.day) for r in store.read().collect()}
    assert got == {"new": ("5.00", 9), "up": ("2.00", 9), "rest": ("5.00", 1), "both": ("3.00", 9)}
    assert store.version == 2


def test_change_log_of_a_merge(spark):
    old = target(spark, [("a", "1", None, T1), ("b", "1", None, T1), ("c", "1", None, T1)])
    m = merge(old, target(spark, [("a", "1", None, None), ("b", "2", None, None), ("d", "1", None, None)]).drop("_loaded_at"), "cnid", ["v", "publishdate"], "_loaded_at", F.lit(T2).cast("timestamp_ntz"), prune=True, actions=True)
    got = sorted((r.cnid, r.v, r._action, r._is_update) for r in cdc.change_log(old, m, "cnid", 1).collect())
    assert got == [("b", "1", "DELETE", True), ("b", "2", "INSERT", True), ("c", "1", "DELETE", False), ("d", "1", "INSERT", False)]


def test_roles(spark):
    m = built(spark, [notice("1", supplierabn="12345678901"), notice("2")], REG)
    shown = {r.supplier_abn for r in Facade(m, {Role.ANALYST}).table("rpt_contracts").collect()}
    assert shown == {"XXXXXXXX901", "UNKNOWN"}
    assert "12345678901" in {r.supplier_abn for r in Facade(m, {Role.ANALYST, Role.ENGINEER}).table("rpt_contracts").collect()}
    for role, name in ((Role.ANALYST, "dim_supplier"), (Role.CI, "rpt_contracts"), (Role.ANALYST, "raw_contract_data")):
        with pytest.raises(PermissionError):
            Facade(m, {role}).table(name)
    assert masked(spark.createDataFrame([(None,)], "supplier_abn string"), {Role.CI}).first()[0] is None
    assert attributable_only(spark.createDataFrame([(True,), (False,)], "is_attributable boolean"), {Role.ANALYST}).count() == 1


def test_registry_publishes_in_order_and_knows_its_lineage(spark, tmp_path):
    m = built(spark, [notice("1")], REG)
    m.path = f"file://{tmp_path}/w"
    done = m.run()
    assert done.index("slv_contracts") < done.index("dim_supplier") and "rpt_contracts" not in done
    assert m.build("rpt_agency_spend").count() == 1
    assert ("slv_contracts", "fct_contracts") in m.edges() and m.check_lineage(m.mermaid()) and not m.check_lineage("flowchart LR")
    ci = built(spark, [notice("1")], REG)
    ci.target = "ci"
    assert ci.schema_of("dim_date") == "ci_gold" and not ci.persisted("stg_abr_names")


def test_measures_with_a_gap_and_a_zero(spark):
    rows = [(2020, dt.date(2020, 1, 1), 10), (2020, dt.date(2020, 1, 3), 5), (2022, dt.date(2022, 1, 1), 8), (2023, dt.date(2023, 1, 1), 0), (2024, dt.date(2024, 1, 1), 4), (None, None, 3)]
    df = spark.createDataFrame(rows, "publish_year int, publish_date date, contract_value int").withColumns({"contract_value": F.col("contract_value").cast("decimal(18,2)"), "is_attributable": F.lit(True), "is_active": F.lit(False), "supplier_entity_key": F.lit(None).cast("string")})
    py = {r.publish_year: r.total_spend_py for r in measures.prior_year(df).collect()}
    assert py[2022] is None and py[2023] == 8
    yoy = {r.publish_year: r.spend_yoy for r in measures.yoy(df).collect()}
    assert yoy[2023] == -1 and yoy[2024] is None
    assert [float(r.spend_ytd) for r in measures.ytd(df).orderBy("publish_date").collect()][:2] == [10, 15]
    assert measures.totals(df).first().distinct_suppliers == 1
    assert measures.totals(df.limit(0)).first().avg_contract_value is None


def test_checks_fire(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), (None, 2)], "k string, v int")
    assert {(r.column, r.n) for r in quality.not_null(df, ["k", "v"]).collect()} == {("k", 1), ("v", 1)}
    assert quality.unique(df, "k").first().n == 2 and quality.accepted_values(df, "v", [1]).first().v == 2
    assert quality.relationships(df, "k", df.where("k is null"), "k").first().n == 2
    assert quality.run_checks([quality.Check("x", df, "warn"), quality.Check("y", df.limit(0))]) == [("x", "warn", 3), ("y", "pass", 0)]
    one = lambda d: quality.freshness(spark.createDataFrame([(T1,)], "t timestamp_ntz").limit(d), "t", F.lit("2024-02-10")).first().status
    assert (one(1), one(0)) == ("warn", "error")


def test_text_helpers(spark):
    df = spark.createDataFrame([(" a ", "5-A12"), ("  ", "5")], "x string, c string")
    assert [(r[0], r[1]) for r in df.select(clean_string(F.col("x")), amendment_no(F.col("c"))).collect()] == [("a", 12), (None, 0)]


def test_command_line(spark, tmp_path, capsys):
    from ledgerloom.__main__ import main

    line = lambda i: ",".join({"cnid": str(i), "value": "5", "publishdate": "2024-01-02"}.get(c, c) for c in COLUMNS)
    csv = tmp_path / "notices_full_20240101_c1.csv"
    csv.write_text(",".join(COLUMNS) + "\n" + line(1) + "\n" + line(2) + "\n")
    out = f"file://{tmp_path}/out"
    assert main(["build", "--out", out, "--skip-models"]) == 0 and main(["build", "--out", out]) == 1
    assert main(["build", "--out", out, "--contracts", str(csv)]) == 0
    raw = lambda: sorted((r.cnid, r._source_file) for r in SnapshotStore(spark, f"{out}/bronze/raw_contract_data").read().collect())
    fact = lambda: sorted(r.contract_id for r in SnapshotStore(spark, f"{out}/gold/fct_contracts").read().collect())
    assert raw() == [("1", csv.name), ("2", csv.name)] and fact() == ["1", "2"]
    assert main(["sync", "--out", out]) == 0
    later = tmp_path / "notices_full_20240201_c1.csv"
    later.write_text(",".join(COLUMNS) + "\n" + line(2) + "\n" + line(3) + "\n")
    # the incremental fact removes nothing: the check says so, and a full refresh mends it
    capsys.readouterr()
    assert main(["build", "--out", out, "--contracts", str(later), "--mode", "delta"]) == 1
    assert "error: gold_drift fct_contracts.contract_id: 1" in capsys.readouterr().out
    assert raw() == [("2", csv.name), ("3", later.name)] and fact() == ["1", "2", "3"]
    assert main(["build", "--out", out, "--full-refresh"]) == 0 and fact() == ["2", "3"]
    history = [(r.supplier_name, r.valid_to) for r in SnapshotStore(spark, f"{out}/gold/supplier_history").read().collect()]
    assert history == [("suppliername", None)]
    assert main(["sync", "--out", out]) == 0
    assert sorted(r.contract_id for r in SnapshotStore(spark, f"{out}/silver/contract_mirror").read().collect()) == ["2", "3"]
    log = spark.read.parquet(f"{out}/bronze/changes").collect()
    assert sorted((r.load, r.cnid, r._action) for r in log) == [(1, "1", "INSERT"), (1, "2", "INSERT"), (2, "1", "DELETE"), (2, "3", "INSERT")]
    old = tmp_path / "notices_full_20230101_c1.csv"
    old.write_text(",".join(COLUMNS) + "\n" + line(9).replace("2024-01-02", "2020-01-01") + "\n")
    capsys.readouterr()
    assert main(["build", "--out", out, "--contracts", str(old), "--mode", "incremental"]) == 0
    assert "0 of 1 notices" in capsys.readouterr().out and len(raw()) == 2
    folder = tmp_path / "two"
    folder.mkdir()
    for f in (csv, later):
        (folder / f.name).write_text(f.read_text())
    assert main(["build", "--out", f"{out}2", "--contracts", str(folder), "--mode", "full", "--skip-models"]) == 0
    assert {r._source_file for r in SnapshotStore(spark, f"{out}2/bronze/raw_contract_data").read().collect()} == {csv.name, later.name}
    empty = tmp_path / "empty.xml"
    empty.write_text("<T></T>")
    assert main(["build", "--out", out, "--register", str(empty), "--skip-models"]) == 1
    assert main(["show", "--out", out, "--role", "analyst", "rpt_contracts"]) == 0
    assert "XXXXXXXXabn" in capsys.readouterr().out
    assert main(["show", "--out", out, "--role", "analyst", "dim_supplier"]) == 1
    capsys.readouterr()
    assert main(["lineage"]) == 0
    text = tmp_path / "lineage.mmd"
    text.write_text(capsys.readouterr().out)
    assert main(["lineage", "--check", str(text)]) == 0
    text.write_text("flowchart LR")
    assert main(["lineage", "--check", str(text)]) == 1
