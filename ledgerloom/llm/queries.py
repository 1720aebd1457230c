"""Queries of the operators for training data, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import digits, file_day, full_abn, notice_key, plain_number, present
from ledgerloom.llm.encoding import encode_corpus
from ledgerloom.llm.fusion import best_rows, duplicates, fuse, surviving_rows
from ledgerloom.llm.languages import NOTATIONS, label_corpus
from ledgerloom.llm.leaks import find_leaks
from ledgerloom.llm.linkage import match
from ledgerloom.llm.variants import MAX_PAYEE_TEXTS, resolve_names, variant_pairs
from ledgerloom.operators.parse_errors import readable_number
from ledgerloom.session import materialize, table

FIELDS = (
    "agencyname", "value", "suppliername", "description", "publishdate", "contractstart", "contractend", "procurementmethod",
    "category", "agencyabn", "supplierabn", "categoryunspsc", "supplierid", "sourceurl",
)


def _fields() -> dict:
    fields = {c: present(F.col(c)) for c in FIELDS}
    fields["value"] = plain_number(fields["value"])
    return fields


def _notice_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows with delivery and notice key; the chunk they came in is their source."""
    raw = table(spark, sf_dir, "raw_contract_data")
    return raw.select("row_id", "_loaded_at", F.col("_source_file").alias("source"), file_day(F.col("_source_file")).alias("delivery"), notice_key(F.col("cnid")).alias("cnid"), *FIELDS)


def _positive():
    """A value that reads as a number above zero; what is readable is said in one place."""
    return F.coalesce(F.col("value").isNotNull() & readable_number(F.col("value")) & ~F.col("value").startswith("-") & F.col("value").rlike("[1-9]"), F.lit(False))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact order of the definition leaves no tie, so nothing is estimated here; see p5_proposed and p5_fused."""
    return surviving_rows(_notice_rows(spark, sf_dir), ["delivery", "cnid"], _fields(), "row_id", "_loaded_at", _positive())


def p5_proposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving row of each duplicate group beside the row that the fused record bears out most."""
    best = best_rows(_notice_rows(spark, sf_dir), ["delivery", "cnid"], _fields(), "source", "row_id", "_loaded_at", _positive())
    return best.withColumn("support", F.round("support", 4))


def p5_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fused value of every field of each duplicate group, with its posterior."""
    rows = duplicates(_notice_rows(spark, sf_dir), ["delivery", "cnid"])
    rows = materialize(rows.select("delivery", "cnid", "row_id", "source", *[c.alias(f) for f, c in _fields().items()]), "duplicates")
    _, winners, _ = fuse(rows, ["delivery", "cnid"], FIELDS, "source", "row_id")
    return winners.withColumn("confidence", F.round("confidence", 4))


def _spellings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """All spellings with their origin, the official ones, and the payee texts that name no business."""
    typed = table(spark, sf_dir, "raw_contract_data").select(present(F.col("suppliername")).alias("name"), F.lit(False).alias("official"))
    official = table(spark, sf_dir, "raw_abr_entity").select(present(F.col("entity_name")).alias("name"), F.lit(True).alias("official"))
    names = typed.unionByName(official).where("name is not null").groupBy("name").agg(F.bool_or("official").alias("official"), F.count("*").alias("n_rows"))
    payees = table(spark, sf_dir, "known_non_suppliers").select("normalized_name").where("normalized_name is not null")
    names = materialize(names, "spellings")
    return names, names.where("official"), [r[0] for r in payees.limit(MAX_PAYEE_TEXTS + 1).collect()]


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    names, official, payees = _spellings(spark, sf_dir)
    return variant_pairs(resolve_names(spark, names, official, payees))


def p7_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling with the name it belongs to."""
    names, official, payees = _spellings(spark, sf_dir)
    return resolve_names(spark, names, official, payees).select("name", "name_id")


#: What descriptions say of a supplier's place: a state with its postcode in either order, or a postcode, in any case.
_STATES = r"NSW|VIC|QLD|WA|SA|TAS|ACT|NT"
_PLACE = rf"(?i)(?:({_STATES}) ([0-9]{{4}})|(?:, |postcode |from )([0-9]{{4}})(?: ({_STATES}))?)(?![0-9])"
#: A place said in one contract only, amendments included, is often a slip: so many contracts are set against it.
_SLIP = 1.5


def _one_edit_away(number):
    """The numbers that one wrong digit or one swap of neighbours leads to."""
    n = F.length(number)
    at = lambda f: F.flatten(F.transform(F.sequence(F.lit(1), n), f))
    digit = F.array(*[F.lit(str(d)) for d in range(10)])
    wrong = at(lambda i: F.transform(digit, lambda d: F.concat(F.substring(number, F.lit(1), i - 1), d, F.substring(number, i + 1, n))))
    swap = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.concat(F.substring(number, F.lit(1), i - 1), F.substring(number, i + 1, F.lit(1)), F.substring(number, i, F.lit(1)), F.substring(number, i + 2, n)))
    return F.array_remove(F.array_distinct(F.concat(wrong, swap)), number)


def _by_identifier(rows: DataFrame, entities: DataFrame) -> DataFrame:
    """(record, entity, identifier) of accounts that state a register number cut at one end, or with one slip in it."""
    parts = rows.where(F.length("stated").between(6, 10)).select("record", "stated").distinct()
    # the few cut numbers meet the register by their six outer digits, not by all ends of all its numbers
    end = lambda c, side: F.struct(F.lit(side).alias("side"), (F.left(c, F.lit(6)) if side == "left" else F.right(c, F.lit(6))).alias("six"))
    ends = lambda c: F.explode(F.array(end(F.col(c), "left"), end(F.col(c), "right"))).alias("e")
    stated = parts.select("stated").distinct().select("stated", ends("stated"))
    cut = F.when(F.col("e.side") == "left", F.startswith("entity", "stated")).otherwise(F.endswith("entity", "stated"))
    meet = stated.join(entities.select("entity", ends("entity")).hint("merge"), "e").where(cut).select("stated", "entity").distinct()
    holders = meet.groupBy("stated").agg(F.count("*").alias("holders"))
    by_part = parts.join(meet, "stated").join(holders, "stated").select("record", "entity", (F.least(F.lit(1.0), F.length("stated") / F.lit(10.0)) / F.col("holders")).alias("identifier"))
    # a full number that the register lacks, one slip away from one that it has
    full = rows.where(F.length("stated") == 11).select("record", "stated").distinct()
    strange = full.select("stated").distinct().join(entities.select(F.col("entity").alias("stated")), "stated", "left_anti")
    meant = strange.select("stated", F.explode(_one_edit_away(F.col("stated"))).alias("entity")).join(entities.hint("merge"), "entity")
    several = meant.groupBy("stated").agg(F.count("*").alias("holders"))
    by_slip = full.join(meant, "stated").join(several, "stated").select("record", "entity", (F.lit(0.9) / F.col("holders")).alias("identifier"))
    return by_part.unionByName(by_slip).groupBy("record", "entity").agg(F.max("identifier").alias("identifier"))


def account_candidates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(candidate pairs of accounts and register entities with their evidence, the full numbers that accounts state)."""
    raw = table(spark, sf_dir, "raw_contract_data")
    # descriptions are long: they are searched once, and what was found is taken apart
    part = lambda what: F.upper(F.nullif(F.regexp_extract("place", what, 0), F.lit("")))
    rows = raw.select("supplierid", "suppliername", "supplierabn", "cnid", F.regexp_extract("description", _PLACE, 0).alias("place")).select(
        present(F.col("supplierid")).alias("record"), present(F.col("suppliername")).alias("name"), F.nullif(digits(F.col("supplierabn")), F.lit("")).alias("stated"),
        part(rf"(?i){_STATES}").alias("state"), part("[0-9]{4}").alias("postcode"), F.when(F.col("place") != "", F.coalesce(F.split_part(notice_key(F.col("cnid")), F.lit("-"), F.lit(1)), F.lit(""))).alias("contract"),
    ).where("record is not null")
    rows = materialize(rows.groupBy("record", "name", "stated", "state", "postcode").agg(F.count("*").alias("n"), F.count_distinct("contract").alias("contracts")), "accounts")
    register = table(spark, sf_dir, "raw_abr_entity").select(full_abn(F.col("abn")).alias("entity"), present(F.col("entity_name")).alias("name"), F.upper(present(F.col("state"))).alias("state"), present(F.col("postcode")).alias("postcode"), F.upper(present(F.col("name_type"))).alias("kind")).where("entity is not null")
    register = materialize(register.distinct(), "register")
    resolved = materialize(resolve_names(spark, *_spellings(spark, sf_dir)).select("name", "name_id", "alike"), "resolved")

    # names: the share of an account's rows whose name is one of the entity's, as far as it is alike
    named = rows.where("name is not null").groupBy("record", "name").agg(F.sum("n").alias("n")).join(resolved, "name").groupBy("record", "name_id").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("alike")).alias("weight"), F.max("alike").alias("alike"))
    named = materialize(named, "named")
    total = named.groupBy("record").agg(F.sum("n").alias("total"), F.max_by("name_id", F.struct("n", "name_id")).alias("cluster"))
    # a main name says more than a trading name, which may have passed on
    owners = register.where("name is not null").join(resolved.select("name", "name_id"), "name").groupBy("entity", "name_id").agg(F.max(F.when(F.col("kind") == "MAIN", 1.0).otherwise(0.9)).alias("kind"))
    hits = named.join(owners, "name_id").groupBy("record", "entity").agg(F.sum(F.col("weight") * F.col("kind")).alias("hit"), F.max("alike").alias("alike"))
    by_name = hits.join(total, "record").select("record", "entity", F.least(F.lit(1.0), F.col("hit") / F.col("total")).alias("name"), "alike")

    by_part = _by_identifier(rows, materialize(register.select("entity").distinct(), "entities"))
    pairs = materialize(by_name.join(by_part, ["record", "entity"], "full"), "pairs")
    places = rows.where("state is not null or postcode is not null").groupBy("record", "state", "postcode").agg(F.sum("contracts").alias("n"))
    homes = register.select("entity", F.col("state").alias("home_state"), F.col("postcode").alias("home_code")).where("home_state is not null or home_code is not null").distinct()
    fit = F.when(F.col("postcode").isNotNull() & F.col("home_code").isNotNull(), F.when(F.col("postcode") == F.col("home_code"), 1.0).otherwise(0.0)).when(F.col("state") == F.col("home_state"), 0.3).otherwise(0.0)
    seen = pairs.select("record", "entity").join(places, "record").join(homes, "entity").groupBy("record", "entity", "state", "postcode", "n").agg(F.max(fit).alias("fit"))
    # slips name this place or that; a place that does not fit and is said again and again is where the account sits
    fitting, elsewhere = F.sum(F.when(F.col("fit") > 0, F.col("n")).otherwise(0)), F.max(F.when(F.col("fit") == 0, F.col("n")).otherwise(0))
    by_place = seen.groupBy("record", "entity").agg((F.sum(F.col("n") * F.col("fit")) / F.sum("n")).alias("fits"), (elsewhere / (elsewhere + fitting + _SLIP)).alias("misfits"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    # a wrong place weighs the more the less the names are alike
    misfits = F.least(F.lit(1.0), F.coalesce(F.col("misfits"), F.lit(0.0)) / F.pow(F.greatest(F.coalesce("alike", F.lit(1.0)), F.lit(0.5)), F.lit(2.0))).alias("misfits")
    candidates = pairs.join(by_place, ["record", "entity"], "left").join(total.select("record", "cluster"), "record", "left").select("record", "entity", "cluster", zero("name"), zero("identifier"), zero("fits"), misfits)
    stated = rows.where(F.length("stated") == 11).select("record", F.col("stated").alias("entity")).distinct()
    return candidates, stated


def p3_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most likely entity of every account, with its confidence; also where the account states the number itself."""
    candidates, _ = account_candidates(spark, sf_dir)
    best = match(candidates).groupBy("record").agg(F.max(F.struct("confidence", "entity")).alias("b"))
    return best.where("b.confidence > 0.5").select(F.col("record").alias("supplierid"), F.col("b.entity").alias("abn"), F.round("b.confidence", 3).alias("confidence"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates, stated = account_candidates(spark, sf_dir)
    best = match(candidates).groupBy("record").agg(F.max(F.struct("confidence", "entity")).alias("b")).where("b.confidence > 0.5")
    found = best.select("record", F.col("b.entity").alias("entity")).join(stated, ["record", "entity"], "left_anti")
    return found.select(F.col("record").alias("supplierid"), F.col("entity").alias("abn"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text")


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_item"), "item_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select(F.col("key").alias("doc_id"), F.col("item").alias("item_id"))


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item: how many documents hold a part of it, and the longest part."""
    return _leaks(spark, sf_dir).groupBy(F.col("item").alias("item_id")).agg(F.count("*").alias("n_documents"), F.max("span").cast("bigint").alias("longest_span"))


def _code_of_label():
    """The two-letter code that a label names, or null."""
    codes = F.create_map(*[F.lit(x) for code, names in NOTATIONS.items() for n in [code, *names.split()] for x in (n, code)])
    s = F.lower(F.trim("label"))
    return F.coalesce(F.try_element_at(codes, s), F.try_element_at(codes, F.split(s, "[-_]").getItem(0)))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = label_corpus(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    of = rows.groupBy("key").agg(F.max(F.when(F.col("main"), F.col("lang"))).alias("main"), F.first(_code_of_label(), ignorenulls=True).alias("code"), F.collect_set("lang").alias("langs"))
    wanted = of.where(~F.col("code").eqNullSafe(F.col("main")) | (F.size("langs") > 1))
    return wanted.select(F.col("key").alias("doc_id"), F.explode("langs").alias("lang"))


def p10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage with its place, language and confidence."""
    rows = label_corpus(table(spark, sf_dir, "documents"), "doc_id", "text", "lang").where("not main")
    return rows.select(F.col("key").alias("doc_id"), "begin", "end", "n_sentences", "lang", F.round("confidence", 4).alias("confidence"))


QUERIES = {f.__name__: f for f in (p3_found, p3_matches, p5_found, p5_fused, p5_proposed, p7_found, p7_names, p8_ids, p9_found, p9_report, p10_found, p10_passages)}

_P = lambda c: rf"CASE WHEN regexp_replace({c}, '^\s+|\s+$', '', 'g') IN ('', 'NULL', 'null') THEN NULL ELSE regexp_replace({c}, '^\s+|\s+$', '', 'g') END"
_KEY = rf"""CASE WHEN regexp_matches(k, '^(?i)(?:CN)?\s*[0-9]+\s*(?:-\s*A\s*[0-9]+)?$')
 THEN regexp_extract(k, '^(?i)(?:CN)?\s*0*([0-9]+)', 1) || CASE WHEN regexp_matches(k, '(?i)A') THEN '-A' || regexp_extract(k, '(?i)A\s*0*([0-9]+)$', 1) ELSE '' END ELSE k END"""
_DAY = r"strptime(nullif(regexp_extract(_source_file, '_([0-9]{8})(?:_|\.|$)', 1), ''), '%Y%m%d')::date::varchar"

ORACLE = {
    "p5_found": f"""WITH r AS (SELECT row_id, _loaded_at, {_DAY} AS delivery, {_P("cnid")} AS k, {_P("value")} AS v, {" + ".join(f"(({_P(c)}) IS NOT NULL)::int" for c in FIELDS)} AS filled FROM raw_contract_data),
c AS (SELECT *, {_KEY} AS cnid, coalesce(regexp_full_match(v, '[0-9]{{1,16}}([.][0-9]+)?') AND regexp_matches(v, '[1-9]'), false)::int AS positive FROM r WHERE k IS NOT NULL AND delivery IS NOT NULL)
SELECT delivery, cnid, row_id FROM (SELECT *, count(*) OVER (PARTITION BY delivery, cnid) AS n, row_number() OVER (PARTITION BY delivery, cnid ORDER BY filled DESC, _loaded_at DESC NULLS LAST, positive DESC, row_id) AS pos FROM c) WHERE n > 1 AND pos = 1""",
}
