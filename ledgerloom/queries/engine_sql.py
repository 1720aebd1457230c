"""SQL counterparts of the engine's queries, for DuckDB; written on their own as chains of common table expressions."""

from __future__ import annotations

from ledgerloom.plans import checks
from ledgerloom.queries.engine import AS_OF, RUNS, TEXT_COLUMNS

_NT = lambda c: f"CASE WHEN {c} IN ('', 'NULL', 'null') THEN NULL ELSE {c} END"
_CL = lambda c: f"nullif(trim({_NT(c)}), '')"
_DT = lambda c: f"CASE WHEN regexp_matches({c}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN try_strptime({c}, '%Y-%m-%d')::date END"
_NORM = lambda c: f"trim(regexp_replace(upper({c}), '[^A-Z0-9]+', ' ', 'g'))"
_KEY = lambda *c: "md5(" + " || '-' || ".join(f"coalesce({x}::varchar, '~null~')" for x in c) + ")"
_FILE = r"nullif(regexp_extract(_source_file, '_([0-9]{8})(?:_|\.|$)', 1), '')"
_BASE = "split_part(contract_id, '-', 1)"
_AMEND = "coalesce(try_cast(nullif(regexp_extract(contract_id, '-A([0-9]+)$', 1), '') AS integer), 0)"
_M = "decimal(38,2)"

_STG = f"""stg AS (SELECT {_CL("cnid")} AS contract_id, {_CL("agencyname")} AS agency_name, {_CL("agencyabn")} AS agency_abn, {_CL("suppliername")} AS supplier_name, {_CL("supplierid")} AS supplier_source_id,
 {_CL("category")} AS category_name, {_CL("categoryunspsc")} AS category_unspsc, {_CL("procurementmethod")} AS procurement_method, {_CL("description")} AS contract_description, {_CL("sourceurl")} AS source_url,
 nullif({_CL("supplierabn")}, '0') AS supplier_abn, try_cast({_NT("value")} AS decimal(18,2)) AS contract_value, {_DT("publishdate")} AS publish_date, {_DT("contractstart")} AS contract_start_date, {_DT("contractend")} AS contract_end_date,
 _loaded_at AS loaded_at, _source_file AS source_file FROM raw_contract_data)"""


def _slv(name: str, source: str) -> str:
    return f"""{name} AS (SELECT contract_id, coalesce(agency_name, 'Unknown') AS agency_name, coalesce(agency_abn, 'UNKNOWN') AS agency_abn, coalesce(supplier_name, 'Unknown') AS supplier_name, coalesce(supplier_abn, 'UNKNOWN') AS supplier_abn,
 coalesce(category_name, 'Unknown') AS category_name, coalesce(category_unspsc, 'UNKNOWN') AS category_unspsc, coalesce(procurement_method, 'Unknown') AS procurement_method, contract_description, source_url, contract_value,
 publish_date, contract_start_date, contract_end_date, date_diff('day', contract_start_date, contract_end_date)::integer AS duration_days, loaded_at
 FROM (SELECT *, row_number() OVER (PARTITION BY contract_id ORDER BY loaded_at DESC NULLS LAST, contract_value DESC NULLS LAST, contract_end_date DESC NULLS LAST, coalesce(source_url, ''),
 supplier_name NULLS LAST, supplier_abn NULLS LAST, agency_name NULLS LAST, category_name NULLS LAST, category_unspsc NULLS LAST, procurement_method NULLS LAST, contract_description NULLS LAST, publish_date NULLS LAST, contract_start_date NULLS LAST, agency_abn NULLS LAST) AS n
 FROM {source} WHERE contract_id IS NOT NULL) WHERE n = 1 AND contract_value > 0)"""


def _register(prefix: str, day: str) -> str:
    return f"""{prefix}r AS (SELECT {", ".join(f"{_NT(c)} AS {c}" for c in ("abn", "abn_status", "abn_status_from_date", "entity_type_ind", "entity_type_text", "entity_name", "name_type", "state", "postcode"))}, _loaded_at, _source_file
 FROM raw_abr_entity WHERE {_FILE} = ({day})),
{prefix}ent AS (SELECT nullif(trim(abn), '') AS abn, nullif(trim(abn_status), '') AS abn_status, CASE WHEN regexp_matches(abn_status_from_date, '^[0-9]{{8}}$') THEN try_strptime(abn_status_from_date, '%Y%m%d')::date END AS abn_status_from_date,
 nullif(trim(entity_type_ind), '') AS entity_type_ind, nullif(trim(entity_type_text), '') AS entity_type_text, nullif(trim(entity_name), '') AS entity_name, nullif(trim(state), '') AS state, nullif(trim(postcode), '') AS postcode,
 coalesce(entity_type_text ILIKE '%government%', false) AS is_government_entity, _loaded_at AS loaded_at, _source_file AS source_file
 FROM (SELECT *, row_number() OVER (PARTITION BY abn ORDER BY entity_name NULLS LAST, _loaded_at NULLS LAST, state NULLS LAST, postcode NULLS LAST, abn_status NULLS LAST, abn_status_from_date NULLS LAST, _source_file NULLS LAST) AS n FROM {prefix}r WHERE name_type = 'MAIN' AND abn IS NOT NULL) WHERE n = 1),
{prefix}nam AS (SELECT nullif(trim(abn), '') AS abn, nullif(trim(entity_name), '') AS entity_name, nullif(trim(name_type), '') AS name_type FROM {prefix}r WHERE abn IS NOT NULL AND entity_name IS NOT NULL)"""


def _supplier(prefix: str) -> str:
    norm = _NORM("supplier_name")
    return f"""{prefix}lk AS (SELECT n AS normalized_name, max(abn) AS matched_abn FROM (SELECT DISTINCT {_NORM("entity_name")} AS n, abn FROM {prefix}nam WHERE entity_name IS NOT NULL)
 WHERE n IN (SELECT {norm} FROM slv WHERE supplier_abn = 'UNKNOWN' AND supplier_name <> 'Unknown') GROUP BY n HAVING count(DISTINCT abn) = 1),
{prefix}sa AS (SELECT supplier_name, supplier_abn, {norm} AS norm, CASE WHEN supplier_abn <> 'UNKNOWN' THEN supplier_abn ELSE matched_abn END AS resolved_abn,
 CASE WHEN supplier_abn <> 'UNKNOWN' THEN 'stated' WHEN matched_abn IS NOT NULL THEN 'abr_name_match' ELSE 'none' END AS abn_source
 FROM (SELECT DISTINCT supplier_name, supplier_abn FROM slv) LEFT JOIN {prefix}lk ON normalized_name = {norm} AND supplier_abn = 'UNKNOWN'),
{prefix}sb AS (SELECT s.*, e.entity_name AS abr_entity_name, e.entity_type_text AS abr_entity_type, e.abn_status AS abr_abn_status, coalesce(abn_source = 'stated' AND is_government_entity AND norm <> {_NORM("e.entity_name")}, false) AS supplier_abn_is_placeholder
 FROM {prefix}sa s LEFT JOIN {prefix}ent e ON resolved_abn = abn),
{prefix}sc AS (SELECT *, CASE WHEN abn_source = 'stated' AND abr_entity_name IS NOT NULL AND NOT supplier_abn_is_placeholder THEN 'ABN:' || supplier_abn ELSE 'NAME:' || norm END AS k,
 CASE WHEN abn_source = 'stated' AND abr_entity_name IS NOT NULL AND NOT supplier_abn_is_placeholder THEN abr_entity_name ELSE supplier_name END AS shown FROM {prefix}sb),
{prefix}sup AS (SELECT {_KEY("supplier_name", "supplier_abn")} AS supplier_key, supplier_name, supplier_abn, resolved_abn, abn_source, abr_entity_name, abr_entity_type, abr_abn_status, supplier_abn_is_placeholder,
 {_KEY("k")} AS supplier_entity_key, min(shown) OVER (PARTITION BY k) AS supplier_entity_name FROM {prefix}sc)"""


def _fct(name: str, source: str) -> str:
    return f"""{name} AS (SELECT {_BASE} AS contract_id, contract_id AS source_notice_id, {_AMEND} AS amendment_no, {_KEY("supplier_name", "supplier_abn")} AS supplier_key, {_KEY("agency_name", "agency_abn")} AS agency_key, {_KEY("category_name", "category_unspsc")} AS category_key,
 strftime(publish_date, '%Y%m%d')::integer AS publish_date_key, contract_value, duration_days, procurement_method, publish_date, contract_start_date, contract_end_date, max(loaded_at) OVER (PARTITION BY {_BASE}) AS loaded_at
 FROM {source} QUALIFY row_number() OVER (PARTITION BY {_BASE} ORDER BY {_AMEND} DESC, {source}.loaded_at DESC NULLS FIRST, {source}.contract_id DESC) = 1)"""


_DAYS = """dts AS (SELECT strftime(d, '%Y%m%d')::integer AS date_key, d::date AS full_date, year(d)::integer AS year, quarter(d)::integer AS quarter, month(d)::integer AS month, strftime(d, '%b') AS month_name, day(d)::integer AS day_of_month,
 dayofweek(d)::integer AS day_of_week, strftime(d, '%a') AS day_name, strftime(d, '%a') IN ('Sat', 'Sun') AS is_weekend FROM generate_series(DATE '1985-01-01', DATE '2044-12-31', INTERVAL 1 DAY) t(d))"""
_DIMS = f"""agy AS (SELECT DISTINCT {_KEY("agency_name", "agency_abn")} AS agency_key, agency_name, agency_abn FROM slv), cat AS (SELECT DISTINCT {_KEY("category_name", "category_unspsc")} AS category_key, category_name, category_unspsc FROM slv)"""
_RPT = f"""rpt AS (SELECT f.contract_id, source_notice_id, amendment_no, supplier_entity_key, supplier_entity_name, supplier_name, supplier_abn, abn_source, a.agency_key, agency_name, agency_abn, c.category_key, category_name, publish_date, d.year AS publish_year,
 contract_start_date, contract_end_date, duration_days, coalesce(contract_start_date <= DATE '{AS_OF}' AND (contract_end_date IS NULL OR contract_end_date >= DATE '{AS_OF}'), false) AS is_active, contract_value,
 coalesce(NOT supplier_abn_is_placeholder AND ns.normalized_name IS NULL, false) AS is_attributable, CASE WHEN supplier_abn_is_placeholder THEN 'agency ABN placeholder' WHEN ns.normalized_name IS NOT NULL THEN 'non-supplier: ' || ns.category END AS unattributable_reason
 FROM fct f LEFT JOIN sup s USING (supplier_key) LEFT JOIN known_non_suppliers ns ON ns.normalized_name = {_NORM("supplier_name")} LEFT JOIN agy a USING (agency_key) LEFT JOIN cat c USING (category_key) LEFT JOIN dts d ON f.publish_date_key = d.date_key)"""
_SPEND = f"sum(contract_value)::{_M} AS total_spend, sum(CASE WHEN is_attributable THEN contract_value ELSE 0 END)::{_M} AS attributable_spend"
_SSP = f"ssp AS (SELECT supplier_entity_key, max(supplier_entity_name) AS supplier_entity_name, bool_and(is_attributable) AS is_attributable, count(*) AS contracts, {_SPEND} FROM rpt GROUP BY supplier_entity_key)"
_ALL = ", ".join([_STG, _slv("slv", "stg"), _register("", f"SELECT max({_FILE}) FROM raw_abr_entity"), _supplier(""), _fct("fct", "slv"), _DAYS, _DIMS, _RPT, _SSP])
_W = f"WITH {_ALL} "
_EARLY = f"{_ALL}, stg0 AS (SELECT * FROM stg WHERE loaded_at < TIMESTAMP '2023-09-01'), {_slv('slv0', 'stg0')}, {_fct('fct0', 'slv0')}"
_TOUCHED = f"touched AS (SELECT DISTINCT {_BASE} AS base_id FROM slv WHERE loaded_at > (SELECT max(loaded_at) FROM fct0))"


def _by(name: str) -> str:
    return f"{_W} SELECT {name}, publish_year, count(*) AS contracts, count(DISTINCT supplier_entity_key) AS suppliers, {_SPEND} FROM rpt WHERE {name} IS NOT NULL GROUP BY ALL"


_COLS = ", ".join(TEXT_COLUMNS)
# the test tables have four deliveries and five extracts: each gets its step
_DELIVERIES, _EXTRACTS = 4, 5
_T = lambda n: f"TIMESTAMP '{RUNS[n - 1]}'"


def _delivery(n: int) -> str:
    return f"d{n} AS (SELECT cnid, {_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY cnid ORDER BY la DESC, row_id DESC) AS x FROM b WHERE cnid IS NOT NULL AND day = (SELECT day FROM days WHERE n = {n})) WHERE x = 1)"


_DELIV = f"""b AS (SELECT {_NT("cnid")} AS cnid, {", ".join(f"{_NT(c)} AS {c}" for c in TEXT_COLUMNS)}, _loaded_at AS la, row_id, {_FILE} AS day FROM raw_contract_data),
days AS (SELECT day, row_number() OVER (ORDER BY day) AS n FROM (SELECT DISTINCT day FROM b WHERE day IS NOT NULL)),
""" + ",\n".join(_delivery(n) for n in range(1, _DELIVERIES + 1))


def _stamped(n: int, source: str) -> str:
    """The rows of a source, stamped by load n where the target lacks them or holds another content."""
    same = "(" + ", ".join(f"t.{c}" for c in TEXT_COLUMNS) + ") IS NOT DISTINCT FROM (" + ", ".join(f"s.{c}" for c in TEXT_COLUMNS) + ")"
    return f"SELECT s.cnid, {', '.join(f's.{c}' for c in TEXT_COLUMNS)}, CASE WHEN t.cnid IS NOT NULL AND {same} THEN t._loaded_at ELSE {_T(n)} END AS _loaded_at FROM {source} AS s LEFT JOIN t{n - 1} AS t USING (cnid)"


_FIRST = f"t1 AS (SELECT *, {_T(1)} AS _loaded_at FROM d1)"
_DELTA = ", ".join([_DELIV, _FIRST, *(f"t{n} AS ({_stamped(n, f'd{n}')})" for n in range(2, _DELIVERIES + 1))])
_INCREMENTAL = ", ".join(
    [_DELIV, _FIRST]
    + [f"s{n} AS (SELECT * FROM d{n} WHERE publishdate >= (SELECT max(publishdate) FROM t{n - 1})), t{n} AS ({_stamped(n, f's{n}')} UNION ALL SELECT * FROM t{n - 1} ANTI JOIN s{n} USING (cnid))" for n in range(2, _DELIVERIES + 1)]
)
_LAST = f"t{_DELIVERIES}"
_CHECKED = ("abr_entity_name", "abr_entity_type", "abr_abn_status", "supplier_abn_is_placeholder")
_HCOLS = "supplier_key, supplier_name, supplier_abn, " + ", ".join(_CHECKED)
_HSAME = "(" + ", ".join("o." + c for c in _CHECKED) + ") IS NOT DISTINCT FROM (" + ", ".join("n." + c for c in _CHECKED) + ")"


def _history() -> str:
    """h1 to h5: the history after each extract."""
    parts = [f"rdays AS (SELECT day, row_number() OVER (ORDER BY day) AS n FROM (SELECT DISTINCT {_FILE} AS day FROM raw_abr_entity) WHERE day IS NOT NULL)"]
    for n in range(1, _EXTRACTS + 1):
        x = f"x{n}_"
        parts += [_register(x, f"SELECT day FROM rdays WHERE n = {n}"), _supplier(x), f"n{n} AS (SELECT {_HCOLS} FROM {x}sup)"]
        if n == 1:
            parts.append(f"h1 AS (SELECT *, {_T(1)} AS valid_from, NULL::timestamp AS valid_to FROM n1)")
            continue
        parts.append(f"""h{n} AS (SELECT * FROM h{n - 1} WHERE valid_to IS NOT NULL
 UNION ALL SELECT o.* REPLACE (CASE WHEN n.supplier_key IS NULL OR NOT ({_HSAME}) THEN {_T(n)} END AS valid_to) FROM h{n - 1} o LEFT JOIN n{n} n USING (supplier_key) WHERE o.valid_to IS NULL
 UNION ALL SELECT n.*, {_T(n)}, NULL FROM n{n} n LEFT JOIN (SELECT * FROM h{n - 1} WHERE valid_to IS NULL) o USING (supplier_key) WHERE o.supplier_key IS NULL OR NOT ({_HSAME}))""")
    return ", ".join(parts)


#: The common table expression of each model.
_MODEL = {
    "stg_contracts": "stg", "stg_abr_entity": "ent", "stg_abr_names": "nam", "slv_contracts": "slv", "int_abr_name_lookup": "lk", "dim_supplier": "sup", "dim_agency": "agy", "dim_category": "cat", "dim_date": "dts", "fct_contracts": "fct",
    "rpt_contracts": "rpt", "rpt_supplier_spend": "ssp", "rpt_agency_spend": "asp", "rpt_category_spend": "csp", "rpt_bi_dim_agency": "agy", "rpt_bi_dim_category": "cat", "rpt_bi_dim_supplier": "bis", "rpt_bi_dim_date": "dts", "rpt_supplier_history": "his",
}


def _checks() -> str:
    def line(check: str, model: str, column: str, n: str, severity: str = "error") -> str:
        return f"SELECT '{check}' AS \"check\", '{model}' AS model, '{column}' AS \"column\", ({n}) AS n, '{severity}' AS severity"

    count = lambda what: f"SELECT count(*) FROM {what}"
    repeated = lambda model, c: count(f"(SELECT {c} FROM {_MODEL[model]} WHERE {c} IS NOT NULL GROUP BY 1 HAVING count(*) > 1)")
    own = "abn_source = 'stated' AND NOT supplier_abn_is_placeholder AND abr_entity_name IS NOT NULL"
    lines = [line("not_null", m, c, count(f"{_MODEL[m]} WHERE {c} IS NULL")) for m, columns in checks.NOT_NULL.items() for c in columns]
    lines += [line("unique", m, c, repeated(m, c)) for m, columns in checks.UNIQUE.items() for c in columns]
    lines += [line("accepted_values", m, c, count(f"(SELECT DISTINCT {c} FROM {_MODEL[m]} WHERE {c} NOT IN ({', '.join(repr(v) for v in values)}))")) for (m, c), values in checks.ACCEPTED.items()]
    lines += [line("relationships", m, c, count(f"(SELECT DISTINCT {c} FROM {_MODEL[m]} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {key} FROM {_MODEL[parent]}))")) for m, c, parent, key in checks.REFERENCES]
    lines += [
        line("one_row_per_abn", "stg_abr_entity", "abn", repeated("stg_abr_entity", "abn")),
        line("gold_drift", "fct_contracts", "contract_id", count(f"(SELECT contract_id, ({_DRIFT}) AS c FROM fct) a FULL JOIN (SELECT {_BASE} AS contract_id, ({_DRIFT}) AS c FROM slv QUALIFY row_number() OVER (PARTITION BY {_BASE} ORDER BY {_AMEND} DESC, loaded_at DESC NULLS FIRST, slv.contract_id DESC) = 1) e USING (contract_id) WHERE a.c IS DISTINCT FROM e.c")),
        line("mart_reconcile", "rpt_supplier_spend", "total_spend", "SELECT ((SELECT sum(contract_value) FROM fct) IS DISTINCT FROM (SELECT sum(total_spend) FROM ssp))::bigint"),
        line("name_match", "dim_supplier", "supplier_entity_key", count(f"sup WHERE abn_source = 'abr_name_match' AND supplier_entity_key IN (SELECT supplier_entity_key FROM sup WHERE {own})")),
        line("abn_sentinel", "stg_contracts", "supplier_abn", "SELECT coalesce(max(1), 0) FROM stg WHERE supplier_abn = '0'"),
        line("rollup_merge", "dim_supplier", "supplier_entity_key", count("(SELECT 1 FROM sup WHERE abr_entity_name IS NOT NULL AND NOT supplier_abn_is_placeholder GROUP BY supplier_entity_key, supplier_entity_name HAVING count(DISTINCT supplier_abn) > 1)")),
        line("placeholder_values", "fct_contracts", "contract_value", count("fct WHERE contract_value = 1"), "warn"),
    ]
    more = f"asp AS ({_by('agency_name').removeprefix(_W)}), csp AS ({_by('category_name').removeprefix(_W)}), bis AS (SELECT supplier_entity_key FROM sup GROUP BY 1), his AS (SELECT true AS is_current FROM sup)"
    return f"WITH {_ALL}, {more}, c AS ({' UNION ALL '.join(lines)}) SELECT *, CASE WHEN n = 0 THEN 'pass' ELSE severity END AS status FROM c"


_XML = f"""WITH {_register("", f"SELECT max({_FILE}) FROM raw_abr_entity")},
g AS (SELECT trim(abn) AS abn, {", ".join(f"min({c}) AS {c}" for c in ("abn_status", "abn_status_from_date", "entity_type_ind", "entity_type_text", "state", "postcode"))} FROM r WHERE trim(abn) <> '' GROUP BY 1),
n AS (SELECT trim(abn) AS abn, entity_name, name_type, row_number() OVER (PARTITION BY trim(abn) ORDER BY coalesce(name_type = 'MAIN', false) DESC, entity_name, name_type NULLS FIRST) AS k FROM r WHERE trim(entity_name) <> ''),
m AS (SELECT *, row_number() OVER (PARTITION BY abn ORDER BY CASE name_type WHEN 'MAIN' THEN 0 WHEN 'LGL' THEN 1 ELSE 2 END, k) AS c FROM n),
o AS (SELECT *, row_number() OVER (PARTITION BY abn, upper(trim(entity_name)) ORDER BY c <> 1, k) AS d FROM m),
x AS (SELECT g.abn, abn_status, abn_status_from_date, entity_type_ind, entity_type_text, trim(entity_name) AS entity_name, CASE WHEN c = 1 THEN 'MAIN' WHEN name_type = 'MAIN' THEN 'MN' ELSE coalesce(name_type, 'UNK') END AS name_type, state, postcode, {_T(1)} AS _loaded_at
 FROM g JOIN o USING (abn) WHERE d = 1)"""
_DRIFT = "contract_value, duration_days, procurement_method, publish_date, contract_start_date, contract_end_date"

ORACLE = {
    "stage_contracts": _W + "SELECT * FROM stg",
    "dedup_notices": _W + "SELECT * FROM slv",
    "amendment_parse": _W + f"SELECT DISTINCT contract_id, {_BASE} AS base_id, {_AMEND} AS amendment_no FROM stg WHERE contract_id IS NOT NULL",
    "collapse_chain": _W + "SELECT * FROM fct",
    "register_entity": _W + "SELECT * FROM ent",
    "register_names": _W + "SELECT * FROM nam",
    "name_lookup": _W + "SELECT * FROM lk",
    "dim_agency": _W + "SELECT * FROM agy",
    "rpt_bi_dim_agency": _W + "SELECT * FROM agy",
    "dim_category": _W + "SELECT * FROM cat",
    "rpt_bi_dim_category": _W + "SELECT * FROM cat",
    "dim_date": _W + "SELECT * FROM dts",
    "rpt_bi_dim_date": _W + "SELECT * FROM dts",
    "dim_supplier": _W + "SELECT * FROM sup",
    "rpt_bi_dim_supplier": _W + "SELECT supplier_entity_key, min(supplier_entity_name) AS supplier_entity_name, count(*) AS name_spellings FROM sup GROUP BY 1",
    "rpt_contracts": _W + "SELECT * FROM rpt",
    "rpt_agency_spend": _by("agency_name"),
    "rpt_category_spend": _by("category_name"),
    "rpt_supplier_spend": _W + "SELECT * FROM ssp",
    "top_suppliers": _W + "SELECT * FROM ssp ORDER BY attributable_spend DESC, supplier_entity_key LIMIT 20",
    "delta_merge": f"WITH {_DELTA} SELECT * FROM {_LAST}",
    "full_load": f"WITH {_DELIV} SELECT *, {_T(_DELIVERIES)} AS _loaded_at FROM d{_DELIVERIES}",
    "incremental_load": f"WITH {_INCREMENTAL} SELECT * FROM {_LAST}",
    "prune_missing": f"WITH {_DELIV} " + " UNION ALL ".join(f"SELECT cnid, {_T(n)} AS _removed_at FROM d{n - 1} ANTI JOIN d{n} USING (cnid)" for n in range(2, _DELIVERIES + 1)),
    "affected_chains": f"WITH {_EARLY}, {_TOUCHED} SELECT base_id FROM touched",
    "fact_incremental": f"WITH {_EARLY}, {_TOUCHED} SELECT f.* FROM fct f SEMI JOIN touched ON f.contract_id = base_id UNION ALL SELECT f.* FROM fct0 f ANTI JOIN touched ON f.contract_id = base_id",
    "gold_drift": f"""WITH {_EARLY}, e AS (SELECT contract_id, ({_DRIFT}) AS c FROM fct), a AS (SELECT contract_id, ({_DRIFT}) AS c FROM fct0)
SELECT coalesce(e.contract_id, a.contract_id) AS contract_id, CASE WHEN a.contract_id IS NULL THEN 'missing_in_gold' WHEN e.contract_id IS NULL THEN 'not_in_silver' ELSE 'stale_value_in_gold' END AS issue
FROM e FULL JOIN a ON e.contract_id = a.contract_id WHERE a.contract_id IS NULL OR e.contract_id IS NULL OR e.c IS DISTINCT FROM a.c""",
    "scd2_history": f"WITH {_ALL}, {_history()} SELECT *, valid_to IS NULL AS is_current FROM h{_EXTRACTS}",
    "mart_reconcile": _W + f"SELECT *, (fact_total IS NOT DISTINCT FROM mart_total) AND coalesce(mart_attributable, 0) <= coalesce(mart_total, 0) AS agrees FROM (SELECT sum(contract_value)::{_M} AS fact_total FROM fct), (SELECT sum(total_spend)::{_M} AS mart_total, sum(attributable_spend)::{_M} AS mart_attributable FROM ssp)",
    "fk_orphans": _W + "SELECT supplier_key, count(*) AS n FROM fct WHERE supplier_key NOT IN (SELECT supplier_key FROM sup WHERE supplier_abn <> 'UNKNOWN') GROUP BY 1",
    "unique_violations": _W + "SELECT contract_id, count(*) AS n FROM stg WHERE contract_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "not_null_violations": _W + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n FROM stg WHERE {c} IS NULL HAVING count(*) > 0" for c in ("contract_id", "contract_value", "publish_date", "supplier_name", "supplier_abn", "agency_name", "loaded_at")),
    "accepted_values": "SELECT abn_status, count(*) AS n FROM raw_abr_entity WHERE abn_status NOT IN ('ACT', 'CAN') GROUP BY 1",
    "abn_sentinel": "SELECT supplierabn, count(*) AS rows_affected FROM raw_contract_data WHERE supplierabn = '0' GROUP BY 1",
    "placeholder_values": _W + "SELECT contract_id, source_notice_id, (floor(contract_value) % 10)::decimal(18,2) AS contract_value FROM fct WHERE floor(contract_value) % 10 = 1",
    "rollup_merge_check": _W + "SELECT abr_entity_type AS supplier_entity_key, abr_entity_type AS supplier_entity_name, count(DISTINCT supplier_abn) AS trustworthy_abns FROM sup WHERE abr_entity_name IS NOT NULL AND NOT supplier_abn_is_placeholder GROUP BY 1 HAVING count(DISTINCT supplier_abn) > 1",
    "name_match_check": _W + """SELECT supplier_key, supplier_name, coalesce(resolved_abn, supplier_entity_key) AS supplier_entity_key FROM sup WHERE abn_source = 'abr_name_match' AND coalesce(resolved_abn, supplier_entity_key)
IN (SELECT coalesce(resolved_abn, supplier_entity_key) FROM sup WHERE abn_source = 'stated' AND NOT supplier_abn_is_placeholder AND abr_entity_name IS NOT NULL)""",
    "one_row_per_abn": _W + "SELECT abn, count(*) AS n FROM nam WHERE abn IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "freshness": f"SELECT max(_loaded_at) AS newest, date_diff('day', max(_loaded_at)::date, DATE '{AS_OF}')::integer AS age_days, CASE WHEN max(_loaded_at) IS NULL OR date_diff('day', max(_loaded_at)::date, DATE '{AS_OF}') > 90 THEN 'error' WHEN date_diff('day', max(_loaded_at)::date, DATE '{AS_OF}') > 30 THEN 'warn' ELSE 'pass' END AS status FROM raw_contract_data",
    "measures_total": _W + f"""SELECT agency_name, count(*) AS contract_count, sum(contract_value)::{_M} AS total_spend, sum(contract_value) FILTER (WHERE is_attributable)::{_M} AS attributable_spend,
round((sum(contract_value) FILTER (WHERE is_attributable))::double / sum(contract_value)::double, 6) AS attributable_share, count(*) FILTER (WHERE is_active) AS active_contracts,
count(DISTINCT supplier_entity_key) + max((supplier_entity_key IS NULL)::int)::bigint AS distinct_suppliers, round(sum(contract_value)::double / count(*), 6) AS avg_contract_value FROM rpt GROUP BY 1""",
    "measure_prior_year": _W + f", y AS (SELECT publish_year, sum(contract_value)::{_M} AS total_spend FROM rpt WHERE publish_year IS NOT NULL GROUP BY 1) SELECT y.publish_year, y.total_spend, p.total_spend AS total_spend_py FROM y LEFT JOIN y p ON p.publish_year = y.publish_year - 1",
    "measure_yoy": _W + ", y AS (SELECT publish_year, sum(contract_value) AS t FROM rpt WHERE publish_year IS NOT NULL GROUP BY 1) SELECT y.publish_year, round((y.t - p.t)::double / p.t::double, 6) AS spend_yoy FROM y LEFT JOIN y p ON p.publish_year = y.publish_year - 1",
    "measure_ytd": _W + f", d AS (SELECT publish_year, publish_date, sum(contract_value) AS t FROM rpt WHERE publish_date IS NOT NULL GROUP BY 1, 2) SELECT publish_year, publish_date, sum(t) OVER (PARTITION BY publish_year ORDER BY publish_date ROWS UNBOUNDED PRECEDING)::{_M} AS spend_ytd FROM d",
    "masked_contracts": _W + "SELECT contract_id, supplier_name, CASE WHEN supplier_abn IS NULL OR supplier_abn = 'UNKNOWN' THEN supplier_abn ELSE 'XXXXXXXX' || right(supplier_abn, 3) END AS supplier_abn FROM rpt",
    "row_policy": _W + "SELECT contract_id, contract_value, is_attributable FROM rpt WHERE is_attributable",
    "cdc_merge": f"WITH {_DELTA} SELECT cnid AS contract_id, agencyname AS agency_name, suppliername AS supplier_name, try_cast(value AS decimal(18,2)) AS contract_value, {_DT('publishdate')} AS publish_date, _loaded_at AS loaded_at, _loaded_at AS _merged_at FROM {_LAST}",
    "build_checks": _checks(),
    "csv_source": f"SELECT {_NT('cnid')} AS cnid, {', '.join(f'{_NT(c)} AS {c}' for c in TEXT_COLUMNS)}, {_T(1)} AS _loaded_at FROM raw_contract_data",
    "register_xml": f"{_XML} SELECT * FROM x",
    "record_names": f"{_XML} SELECT abn, max(CASE WHEN name_type = 'MAIN' THEN entity_name END) AS main_name, count(*) AS names FROM x GROUP BY 1",
    "dynamic_agency_spend": f"SELECT {_NT('agencyname')} AS agency_name, count(*) AS contract_count, sum(try_cast({_NT('value')} AS decimal(18,2)))::{_M} AS total_value FROM raw_contract_data GROUP BY 1",
}
ORACLE = {k: v.replace(f"{_W},", f"WITH {_ALL},") for k, v in ORACLE.items()}
