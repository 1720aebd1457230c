"""Readers for the files that deliveries come in."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.plans.staging import null_tokens

CONTRACT_COLUMNS = (
    "agencyname", "value", "suppliername", "description", "publishdate", "contractstart", "contractend", "procurementmethod",
    "category", "agencyabn", "supplierabn", "categoryunspsc", "cnid", "supplierid", "sourceurl",
)


def read_contracts_csv(spark: SparkSession, path: str, load_ts: Column) -> DataFrame:
    """Fifteen columns by position; one malformed row fails the whole load, so that the live table stays as it is."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in CONTRACT_COLUMNS])
    rows = spark.read.schema(schema).csv(path, header=True, quote='"', escape='"', multiLine=True, mode="FAILFAST", enforceSchema=True, encoding="UTF-8")
    rows = rows.select("*", load_ts.alias("_loaded_at"), F.col("_metadata.file_name").alias("_source_file"))
    return null_tokens(rows, CONTRACT_COLUMNS)


def verify_count(scratch: DataFrame, expected: int) -> int:
    """The rows loaded; raises where they are not the rows parsed."""
    n = scratch.count()
    if n != expected:
        raise ValueError(f"{expected} rows parsed, {n} loaded")
    return n


def read_seed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("normalized_name string, category string, reason string").csv(path, header=True, quote='"', escape='"', multiLine=True, mode="FAILFAST")


#: What is read of a record: its names and places at any depth, in document order.  All text, so that leading zeros stay.
RECORD = (
    "abn string, abn_status string, abn_status_from_date string, entity_type_ind string, entity_type_text string, state string, postcode string, "
    "firms array<struct<kind:string,name:string>>, people array<struct<kind:string,given:string,family:string>>"
)


def parse_record(xml: str) -> tuple:
    """The fields of RECORD of one register record; a malformed one fails the load, so that the live table stays."""
    record = ElementTree.fromstring(xml)
    number = record.find(".//ABN")
    text = lambda at, name: next((e.text for e in at.iter(name) if e.text), None)
    firms = [{"kind": e.get("type"), "name": text(e, "NonIndividualNameText")} for e in record.iter("NonIndividualName")]
    people = [{"kind": e.get("type"), "given": text(e, "GivenName"), "family": text(e, "FamilyName")} for e in record.iter("IndividualName")]
    places = list(record.iter("AddressDetails"))
    first = lambda name: next((x for p in places if (x := text(p, name))), None)
    status = (number.text, number.get("status"), number.get("ABNStatusFromDate")) if number is not None else (None, None, None)
    return (*status, text(record, "EntityTypeInd"), text(record, "EntityTypeText"), first("State"), first("Postcode"), firms, people)


def record_names() -> Column:
    """All names of a record as (name_type, entity_name), the canonical one first and tagged MAIN.

    Canonical is the first name of type MN, else the first of type LGL, else the first.  Names of organisations
    come before names of persons; a person's name is the first given and the first family name.  Blank names are
    skipped, a missing type is UNK, and a name said before in any case is dropped.
    """
    typed = lambda t, n: F.struct(F.coalesce(F.nullif(t, F.lit("")), F.lit("UNK")).alias("name_type"), F.trim(n).alias("entity_name"))
    firms = F.transform(F.col("firms"), lambda x: typed(x["kind"], x["name"]))
    people = F.transform(F.col("people"), lambda x: typed(x["kind"], F.array_join(F.filter(F.array(x["given"], x["family"]), lambda p: p.isNotNull() & (p != "")), " ")))
    names = F.filter(F.concat(firms, people), lambda x: F.coalesce(x["entity_name"] != "", F.lit(False)))
    return F.when(F.size(names) == 0, names).otherwise(_canonical_first(names))


def _canonical_first(names: Column) -> Column:
    types = F.transform(names, lambda x: x["name_type"])
    at = lambda t: F.nullif(F.array_position(types, F.lit(t)), F.lit(0))
    main = F.coalesce(at("MN"), at("LGL"), F.lit(1)).cast("int")
    head = F.struct(F.lit("MAIN").alias("name_type"), F.element_at(names, main)["entity_name"].alias("entity_name"))
    rest = F.filter(names, lambda x, i: i != main - 1)
    seen = lambda out, x: F.exists(out, lambda y: F.upper(y["entity_name"]) == F.upper(x["entity_name"]))
    return F.aggregate(rest, F.array(head), lambda out, x: F.when(seen(out, x), out).otherwise(F.concat(out, F.array(x))))


def _zip_members(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The records in the XML members of ZIP archives, some at a time; a member is never unpacked as a whole."""
    for b in files:
        for path, content in zip(b["path"], b["content"]):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for member in (m for m in z.namelist() if m.lower().endswith(".xml")):
                    with io.TextIOWrapper(z.open(member), encoding="utf-8-sig") as f:
                        rest = ""
                        while part := f.read(4 << 20):
                            *records, rest = (rest + part).split(_END)
                            yield pd.DataFrame({"value": pd.Series(records, dtype=object), "file": pd.Series([f"{path}!{member}"] * len(records), dtype=object)})


_END = "</ABR>"


def register_records(spark: SparkSession, path: str) -> DataFrame:
    """(value, file): the texts up to the end of each record, out of XML files, which are split at records, or ZIP archives of such."""
    if path.lower().endswith(".zip"):
        files = spark.read.format("binaryFile").load(path).select("path", "content")
        return files.mapInPandas(_zip_members, "value string, file string").repartition(spark.sparkContext.defaultParallelism)
    return spark.read.option("lineSep", _END).text(path).select("value", F.col("_metadata.file_path").alias("file"))


def read_register_xml(spark: SparkSession, path: str, load_ts: Column) -> DataFrame:
    """One row a name of every record with a number; records are streamed, whatever the size of a file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split(":")[0].split()[0] for f in re.split(r", (?=\w+ )", RECORD)]
        for b in batches:
            # what follows the last record holds none
            found = [(i, parse_record(t[at.start() :] + _END)) for i, t in enumerate(b["value"]) if (at := re.search(r"<ABR[\s>]", t))]
            rows = pd.DataFrame([r for _, r in found], columns=names)
            yield rows.assign(file=pd.Series([b["file"].iloc[i] for i, _ in found], dtype=object))

    records = register_records(spark, path).mapInPandas(run, RECORD + ", file string")
    attributes = ("abn_status", "abn_status_from_date", "entity_type_ind", "entity_type_text")
    rows = records.where(F.trim("abn") != "").select(F.trim("abn").alias("abn"), *attributes, F.explode(record_names()).alias("n"), "state", "postcode", "file")
    return rows.select("abn", *attributes, F.col("n.entity_name").alias("entity_name"), F.col("n.name_type").alias("name_type"), "state", "postcode", load_ts.alias("_loaded_at"), F.regexp_extract("file", r"([^/!]+)$", 1).alias("_source_file"))
