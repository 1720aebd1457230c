"""Cleaning and keys for procurement text columns.

Two families live here.  ``clean_string`` and its neighbours belong to the layered model: there a blank is
null and nothing else is.  ``present`` belongs to the data-preparation operators, where the words NULL and
null are absent too.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A notice number however it is written: optional CN, leading zeros, an optional amendment.
CNID = r"^(?i)(?:CN)?\s*0*([0-9]+)\s*(?:-\s*A\s*0*([0-9]+))?$"


def strip(c: Column) -> Column:
    """Without outer white space of any kind (Spark's trim removes spaces only)."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def present(c: Column) -> Column:
    """The stripped text, or null where it is absent: null, blank, or the word NULL or null."""
    s = strip(c)
    return F.when(~s.isin("", "NULL", "null"), s)


def notice_key(c: Column) -> Column:
    """Digits without leading zeros, then -A and its number; a key of another form stays as stripped; absent is null."""
    s = present(c)
    base, number = F.regexp_extract(s, CNID, 1), F.regexp_extract(s, CNID, 2)
    return F.when(base == "", s).otherwise(F.concat(base, F.when(number == "", "").otherwise(F.concat(F.lit("-A"), number))))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def full_abn(c: Column) -> Column:
    """The eleven digits of a business number, whatever stands between them; null if there are not exactly eleven."""
    d = digits(c)
    return F.when(F.length(d) == 11, d)


def file_day(c: Column) -> Column:
    """The day in a delivery's file name as YYYY-MM-DD; null if the name holds none."""
    d = F.regexp_extract(c, r"_([0-9]{8})(?:_|\.|$)", 1)
    return F.when(d != "", F.concat_ws("-", d.substr(1, 4), d.substr(5, 2), d.substr(7, 2)))


def plain_number(c: Column) -> Column:
    """A number in plain notation without final zeros after the point; any other text as it is."""
    return F.when(c.rlike(r"^-?[0-9]+\.[0-9]+$"), F.regexp_replace(c, r"\.?0*$", "")).otherwise(c)


def clean_string(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def base_contract_id(c: Column) -> Column:
    return F.split_part(c, F.lit("-"), F.lit(1))


def amendment_no(c: Column) -> Column:
    return F.coalesce(F.regexp_extract(c, r"-A([0-9]+)$", 1).try_cast("int"), F.lit(0))


def normalize_name(c: Column) -> Column:
    """Upper case with every run of other signs as one blank; legal suffixes stay."""
    return F.trim(F.regexp_replace(F.upper(c), r"[^A-Z0-9]+", " "))


def surrogate_key(*cols: Column) -> Column:
    """md5 over the values; null has a text of its own, so that it differs from the empty text."""
    return F.md5(F.concat_ws("-", *[F.coalesce(c.cast("string"), F.lit("~null~")) for c in cols]))


def mask_abn(c: Column) -> Column:
    """The last three digits stay; null and UNKNOWN are no identifiers and stay as they are."""
    return F.when(c.isNull() | (c == "UNKNOWN"), c).otherwise(F.concat(F.lit("XXXXXXXX"), F.right(c, F.lit(3))))
