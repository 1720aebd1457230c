"""Queries of the general data-preparation operators: histories, snapshot differences, orphans, parse failures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import file_day, full_abn, notice_key, plain_number, present
from ledgerloom.operators.history import EntityHistory, register_statements, snapshot_days
from ledgerloom.operators.orphans import Reference, cascade, reference_gaps
from ledgerloom.operators.parse_errors import field_failures, parse_records
from ledgerloom.operators.snapshot_diff import snapshot_diff
from ledgerloom.session import fresh_path, materialize, table
from ledgerloom.sources.files import CONTRACT_COLUMNS

CONTENT_COLUMNS = tuple(c for c in CONTRACT_COLUMNS if c != "cnid")
ATTRIBUTES = ("status", "status_date", "main_name")


def register_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that came on their extract's day are loaded first; late and corrected ones then rebuild their chains."""
    raw = materialize(register_statements(table(spark, sf_dir, "raw_abr_entity")), "register")
    days = snapshot_days(raw)
    late = F.to_date("loaded") > F.to_date("day")
    history = EntityHistory(spark, fresh_path(spark, "register-history"), "abn", ATTRIBUTES)
    history.load(raw.where(~F.coalesce(late, F.lit(False))), days, raw.count())
    history.apply(raw.where(late), days)
    return history.read()


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return register_history(spark, sf_dir).where("n_versions >= 2").select("abn", "valid_from", "valid_to")


def p1_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return register_history(spark, sf_dir).select("abn", *ATTRIBUTES, "valid_from", "valid_to")


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notice rows with their delivery and key beside the raw columns."""
    raw = table(spark, sf_dir, "raw_contract_data")
    return raw.withColumns({"delivery": file_day(F.col("_source_file")), "notice": notice_key(F.col("cnid"))})


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {c: present(F.col(c)) for c in CONTENT_COLUMNS}
    fields["value"] = plain_number(fields["value"])
    rows = notices(spark, sf_dir).select("delivery", F.col("notice").alias("cnid"), *[x.alias(c) for c, x in fields.items()])
    return snapshot_diff(rows, "cnid", "delivery", CONTENT_COLUMNS)


def _holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    register = table(spark, sf_dir, "raw_abr_entity")
    return register.select(full_abn(F.col("abn")).alias("abn"), file_day(F.col("_source_file")).alias("snapshot"))


def _references(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Contract rows with the extract in force at their delivery, and the register's holdings."""
    held = _holdings(spark, sf_dir)
    days = snapshot_days(held, "snapshot")
    rows = notices(spark, sf_dir)
    in_force = F.array_max(F.filter(F.array(*map(F.lit, days)) if days else F.array().cast("array<string>"), lambda s: s <= F.col("delivery")))
    amendment = F.col("notice").rlike(r"^[0-9]+-A[0-9]+$")
    contracts = rows.select(
        "row_id", "delivery", "notice", full_abn(F.col("supplierabn")).alias("abn"), F.coalesce(in_force, F.lit("")).alias("in_force"),
        F.when(amendment, F.split_part("notice", F.lit("-"), F.lit(1))).alias("base"),
    )
    return contracts.where(F.col("delivery").isNotNull()), held.where("abn is not null and snapshot is not null").distinct()


SUPPLIER = Reference("raw_contract_data", ("abn", "in_force"), "raw_abr_entity", ("abn", "snapshot"))
AMENDED = Reference("raw_contract_data", ("base", "delivery"), "raw_contract_data", ("notice", "delivery"))


def _orphans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(all orphans of the reference graph with their number and delivery, the register's holdings)."""
    contracts, held = _references(spark, sf_dir)
    contracts = materialize(contracts, "contracts")
    return cascade({"raw_contract_data": contracts, "raw_abr_entity": held}, [SUPPLIER, AMENDED], carry=("abn", "delivery")), held


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The direct orphans of the supplier reference, out of the fixpoint of the whole graph, with the kind of gap."""
    found, held = _orphans(spark, sf_dir)
    direct = found.where(F.array_contains("vias", "raw_contract_data.abn") & (F.col("level") == 0)).select("row_id", "abn", F.col("delivery").alias("day"))
    return reference_gaps(direct, held, "abn").select("row_id", "kind")


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct and inherited orphans per table and delivery: suppliers not in the register, amendments without base notice."""
    found, _ = _orphans(spark, sf_dir)
    label = F.when(F.col("level") == 0, "direct").otherwise("inherited")
    return found.where("table = 'raw_contract_data'").groupBy("table", "delivery", "via", label.alias("orphan")).agg(F.count("*").alias("n_rows"), F.max("level").cast("bigint").alias("deepest"))


def _parsed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_records(table(spark, sf_dir, "raw_contract_line"), "line_id", "line", CONTRACT_COLUMNS)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = materialize(_parsed_lines(spark, sf_dir).select("line_id", "reason", "value", "publishdate", "contractstart"), "parsed")
    typed = field_failures(lines.where("reason is null"), "line_id", ["value"], ["publishdate", "contractstart"])
    first = lines.where("reason is not null").select("line_id", "reason").unionByName(typed)
    second = field_failures(table(spark, sf_dir, "raw_contract_data"), "row_id", ["value"], ["publishdate", "contractstart"])
    return first.select(F.lit("raw_contract_line").alias("source_table"), F.col("line_id").alias("row_key"), "reason").unionByName(
        second.select(F.lit("raw_contract_data").alias("source_table"), F.col("row_id").alias("row_key"), "reason")
    )


def p6_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of the raw lines that load, as typed rows."""
    lines = _parsed_lines(spark, sf_dir)
    good = lines.where("reason is null").select("line_id", *[present(F.col(c)).alias(c) for c in CONTRACT_COLUMNS])
    bad = field_failures(good, "line_id", ["value"], ["publishdate", "contractstart"]).select("line_id").distinct()
    good = good.join(bad, "line_id", "left_anti")
    return good.select("line_id", "agencyname", F.col("value").cast("decimal(38,6)").try_cast("decimal(18,2)").alias("value"), F.to_date("publishdate").alias("publishdate"), F.to_date("contractstart").alias("contractstart"), notice_key(F.col("cnid")).alias("cnid"))


def p6_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest edits that would make each broken record readable."""
    return _parsed_lines(spark, sf_dir).where("reason is not null").select("line_id", "reason", "edits")


QUERIES = {f.__name__: f for f in (p1_found, p1_history, p2_found, p4_found, p4_report, p6_found, p6_loaded, p6_edits)}

_P = "CASE WHEN {s} IN ('', 'NULL', 'null') THEN NULL ELSE {s} END"


def _present(c: str) -> str:
    return _P.format(s=rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')")


_DAY = r"strptime(nullif(regexp_extract(_source_file, '_([0-9]{8})(?:_|\.|$)', 1), ''), '%Y%m%d')::date::varchar"
_KEY = rf"""CASE WHEN regexp_matches(k, '^(?i)(?:CN)?\s*[0-9]+\s*(?:-\s*A\s*[0-9]+)?$')
 THEN regexp_extract(k, '^(?i)(?:CN)?\s*0*([0-9]+)', 1) || CASE WHEN regexp_matches(k, '(?i)A') THEN '-A' || regexp_extract(k, '(?i)A\s*0*([0-9]+)$', 1) ELSE '' END
 ELSE k END"""
_D11 = "CASE WHEN length(regexp_replace({c}, '[^0-9]', '', 'g')) = 11 THEN regexp_replace({c}, '[^0-9]', '', 'g') END"

_STATES = rf"""
s AS (SELECT regexp_replace(abn, '[^0-9]', '', 'g') abn, {_DAY} AS day, _loaded_at loaded,
  upper(regexp_replace({_present("abn_status")}, '[^\p{{L}}\p{{N}}]+', '', 'g')) status,
  nullif(regexp_replace({_present("abn_status_from_date")}, '[^0-9]', '', 'g'), '') status_date,
  CASE WHEN upper({_present("name_type")}) = 'MAIN' THEN nullif(upper(regexp_replace({_present("entity_name")}, '[^\p{{L}}\p{{N}}]+', '', 'g')), '') END main_name
  FROM raw_abr_entity WHERE abn IS NOT NULL),
days AS (SELECT day, row_number() OVER (ORDER BY day) AS pos, lead(day, 1, '9999-12-31') OVER (ORDER BY day) AS nxt FROM (SELECT DISTINCT day FROM s WHERE day IS NOT NULL)),
e AS (SELECT abn, pos, arg_max(status, (loaded, status)) FILTER (WHERE status IS NOT NULL) a, arg_max(status_date, (loaded, status_date)) FILTER (WHERE status_date IS NOT NULL) b,
  arg_max(main_name, (loaded, main_name)) FILTER (WHERE main_name IS NOT NULL) c FROM s JOIN days USING (day) GROUP BY ALL),
w AS (SELECT abn, pos, pos AS first, a, b, c FROM e WHERE pos = 1
  UNION ALL
  SELECT coalesce(e.abn, w.abn), w.pos + 1, CASE WHEN g THEN w.first ELSE e.pos END, CASE WHEN g THEN coalesce(w.a, e.a) ELSE e.a END, CASE WHEN g THEN coalesce(w.b, e.b) ELSE e.b END, CASE WHEN g THEN coalesce(w.c, e.c) ELSE e.c END
  FROM w JOIN e ON e.abn = w.abn AND e.pos = w.pos + 1, LATERAL (SELECT coalesce(w.a = e.a, true) AND coalesce(w.b = e.b, true) AND coalesce(w.c = e.c, true) AS g)),
"""

ORACLE = {
    "p1_history": rf"""WITH RECURSIVE {_STATES.replace("WHERE pos = 1", "WHERE NOT EXISTS (SELECT 1 FROM e p WHERE p.abn = e.abn AND p.pos = e.pos - 1)")}
last AS (SELECT abn, first, arg_max(a, pos) a, arg_max(b, pos) b, arg_max(c, pos) c, max(pos) AS last FROM w GROUP BY ALL)
SELECT abn, a AS status, b AS status_date, c AS main_name, f.day AS valid_from, l.nxt AS valid_to FROM last JOIN days f ON f.pos = first JOIN days l ON l.pos = last""",
    "p1_found": rf"""WITH RECURSIVE {_STATES.replace("WHERE pos = 1", "WHERE NOT EXISTS (SELECT 1 FROM e p WHERE p.abn = e.abn AND p.pos = e.pos - 1)")}
last AS (SELECT abn, first, max(pos) AS last, count(*) OVER (PARTITION BY abn) n FROM w GROUP BY abn, first)
SELECT abn, f.day AS valid_from, l.nxt AS valid_to FROM last JOIN days f ON f.pos = first JOIN days l ON l.pos = last WHERE n > 1""",
    "p2_found": f"""WITH r AS (SELECT {_DAY} AS delivery, {_present("cnid")} AS k, {", ".join(f"{_present(c)} AS {c}" for c in CONTENT_COLUMNS)} FROM raw_contract_data),
c AS (SELECT DISTINCT delivery, {_KEY} AS cnid, {", ".join("CASE WHEN regexp_matches(value, '^-?[0-9]+[.][0-9]+$') THEN regexp_replace(value, '[.]?0*$', '') ELSE value END AS value" if c == "value" else c for c in CONTENT_COLUMNS)} FROM r WHERE k IS NOT NULL),
d AS (SELECT delivery, lead(delivery) OVER (ORDER BY delivery) AS nxt FROM (SELECT DISTINCT delivery FROM c)),
k AS (SELECT delivery, cnid, list_sort(list(md5(concat_ws('|', {", ".join(f"coalesce('t' || {c}, 'n')" for c in CONTENT_COLUMNS)})))) AS content FROM c GROUP BY ALL),
p AS (SELECT nxt AS delivery, cnid, content FROM k JOIN d USING (delivery) WHERE nxt IS NOT NULL),
n AS (SELECT * FROM k WHERE delivery > (SELECT min(delivery) FROM d))
SELECT coalesce(n.delivery, p.delivery) AS delivery, coalesce(n.cnid, p.cnid) AS cnid, CASE WHEN p.cnid IS NULL THEN 'added' WHEN n.cnid IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM n FULL JOIN p ON n.delivery = p.delivery AND n.cnid = p.cnid WHERE n.content IS DISTINCT FROM p.content""",
    "p4_found": f"""WITH h AS (SELECT DISTINCT {_D11.format(c="abn")} AS abn, {_DAY} AS day FROM raw_abr_entity),
r AS (SELECT row_id, {_D11.format(c="supplierabn")} AS abn, {_DAY} AS delivery FROM raw_contract_data),
f AS (SELECT delivery, (SELECT max(day) FROM h WHERE day <= delivery) AS day FROM (SELECT DISTINCT delivery FROM r))
SELECT row_id, CASE WHEN EXISTS (SELECT 1 FROM h WHERE h.abn = r.abn AND h.day < f.day) THEN 'deleted' WHEN EXISTS (SELECT 1 FROM h WHERE h.abn = r.abn AND (f.day IS NULL OR h.day > f.day)) THEN 'later' ELSE 'missing' END AS kind
FROM r JOIN f USING (delivery) WHERE abn IS NOT NULL AND NOT EXISTS (SELECT 1 FROM h WHERE h.abn = r.abn AND h.day = f.day)""",
    "p4_report": f"""WITH RECURSIVE h AS (SELECT DISTINCT {_D11.format(c="abn")} AS abn, {_DAY} AS day FROM raw_abr_entity),
k AS (SELECT row_id, {_D11.format(c="supplierabn")} AS abn, {_DAY} AS delivery, {_present("cnid")} AS k FROM raw_contract_data),
r AS (SELECT row_id, abn, delivery, {_KEY} AS notice FROM k WHERE delivery IS NOT NULL),
f AS (SELECT delivery, (SELECT max(day) FROM h WHERE day <= delivery) AS day FROM (SELECT DISTINCT delivery FROM r)),
b AS (SELECT r.*, f.day, CASE WHEN regexp_matches(notice, '^[0-9]+-A[0-9]+$') THEN split_part(notice, '-', 1) END AS base FROM r JOIN f USING (delivery)),
o AS (SELECT row_id, delivery, notice, 'raw_contract_data.abn' AS via, 0 AS level FROM b WHERE abn IS NOT NULL AND NOT EXISTS (SELECT 1 FROM h WHERE h.abn = b.abn AND h.day = b.day)
  UNION ALL SELECT row_id, delivery, notice, 'raw_contract_data.base', 0 FROM b WHERE base IS NOT NULL AND NOT EXISTS (SELECT 1 FROM b q WHERE q.notice = b.base AND q.delivery = b.delivery)),
i AS (SELECT b.row_id, b.delivery, 'raw_contract_data.base' AS via, 1 AS level FROM b SEMI JOIN o ON o.notice = b.base AND o.delivery = b.delivery ANTI JOIN o AS x ON x.row_id = b.row_id),
a AS (SELECT row_id, delivery, min(via) AS via, 0 AS level FROM o GROUP BY row_id, delivery UNION ALL SELECT row_id, delivery, via, level FROM i)
SELECT 'raw_contract_data' AS "table", delivery, via, CASE WHEN level = 0 THEN 'direct' ELSE 'inherited' END AS orphan, count(*) AS n_rows, max(level)::bigint AS deepest FROM a GROUP BY ALL""",
}
_NUM = "coalesce(regexp_full_match({v}, '-?[0-9]{{1,16}}([.][0-9]+)?'), true)"
_CAL = "({v} IS NULL OR regexp_full_match({v}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND try_strptime({v}, '%Y-%m-%d') IS NOT NULL AND NOT starts_with({v}, '0000'))"


def _bad(cells: dict[str, str]) -> str:
    v = {c: _present(x) for c, x in cells.items()}
    return f"CASE WHEN NOT {_NUM.format(v='(' + v['value'] + ')')} THEN 'value' END, " + ", ".join(f"CASE WHEN NOT {_CAL.format(v='(' + v[c] + ')')} THEN '{c}' END" for c in ("publishdate", "contractstart"))


_CELL = '("(?:[^"]|"")*"|[^",]*)'
_UNQ = "CASE WHEN starts_with({c}, '\"') THEN replace({c}[2:-2], '\"\"', '\"') ELSE {c} END"
ORACLE["p6_found"] = rf"""WITH l AS (SELECT line_id, regexp_replace(coalesce(line, ''), '\r?\n?$', '') AS line FROM raw_contract_line),
g AS (SELECT line_id, regexp_full_match(line, '{_CELL}(,{_CELL})*') AS ok, CASE WHEN regexp_full_match(line, '{_CELL}(,{_CELL})*') THEN regexp_extract_all(',' || line, ',{_CELL}', 1) END AS c FROM l),
v AS (SELECT line_id, {_UNQ.format(c="c[2]")} AS value, {_UNQ.format(c="c[5]")} AS publishdate, {_UNQ.format(c="c[6]")} AS contractstart FROM g WHERE ok AND len(c) = 15)
SELECT 'raw_contract_line' AS source_table, line_id AS row_key, CASE WHEN ok THEN 'columns' ELSE 'quoting' END AS reason FROM g WHERE NOT ok OR len(c) <> 15
UNION ALL SELECT 'raw_contract_line', line_id, reason FROM (SELECT line_id, unnest([{_bad({c: c for c in ("value", "publishdate", "contractstart")})}]) AS reason FROM v) WHERE reason IS NOT NULL
UNION ALL SELECT 'raw_contract_data', row_id, reason FROM (SELECT row_id, unnest([{_bad({c: c for c in ("value", "publishdate", "contractstart")})}]) AS reason FROM raw_contract_data) WHERE reason IS NOT NULL"""
_LINES = rf"""l AS (SELECT line_id, regexp_replace(coalesce(line, ''), '\r?\n?$', '') AS line FROM raw_contract_line),
g AS (SELECT line_id, regexp_extract_all(',' || line, ',{_CELL}', 1) AS c FROM l WHERE regexp_full_match(line, '{_CELL}(,{_CELL})*'))"""
_AT = {c: _UNQ.format(c=f"c[{i}]") for i, c in enumerate(CONTRACT_COLUMNS, 1)}
ORACLE["p6_loaded"] = rf"""WITH {_LINES},
u AS (SELECT line_id, {", ".join(f"{_AT[c]} AS {c}" for c in ("agencyname", "value", "publishdate", "contractstart", "cnid"))} FROM g WHERE len(c) = 15),
r AS (SELECT line_id, {_present("agencyname")} AS agencyname, {_present("value")} AS v, {_present("publishdate")} AS p, {_present("contractstart")} AS s, {_present("cnid")} AS k FROM u)
SELECT line_id, agencyname, try_cast(try_cast(v AS decimal(38,6)) AS decimal(18,2)) AS value, try_cast(p AS date) AS publishdate, try_cast(s AS date) AS contractstart, {_KEY} AS cnid
FROM r WHERE {_NUM.format(v="v")} AND {_CAL.format(v="p")} AND {_CAL.format(v="s")}"""
