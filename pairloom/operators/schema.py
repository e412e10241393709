"""Technical and canonical columns of records and pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.functions.dates import iso_date
from pairloom.functions.text import set_field

#: Technical name to canonical name; the order is that of serialized records.
RENAMES = {
    "FirstNM_clean": "first_name", "MiddleNM_clean": "middle_name", "LastNM_clean": "last_name", "SuffixNM_clean": "suffix", "BirthDT_clean": "dob",
    "SSN_clean": "ssn", "last_4_SSN": "ssn4", "SexAtBirthDSC_clean": "sex", "AddressLine1_clean": "address", "AddressLine2_clean": "address2",
    "CityNM_clean": "city", "StateCD_clean": "state", "ZipCD_clean_base": "zip", "Phones_set": "phone", "Email_clean": "email",
}
FEATURES = list(RENAMES.values())
SET_FIELDS, DATE_FIELDS = {"phone"}, {"dob"}
ID_COLUMNS = ("PATID", "SSN_clean", "last_4_SSN", "ZipCD_clean_base", "ZipCD_clean_ext", "PrimaryPhoneNBR_clean", "Phone01NBR_clean", "Phone02NBR_clean", "Phone03NBR_clean")


def id_columns(columns: list[str]) -> list[str]:
    """Columns that must be read as text: ids and their _l, _r, _A, _B forms."""
    forms = {f"{c}{s}" for c in ID_COLUMNS for s in ("", "_l", "_r", "_A", "_B")}
    return [c for c in columns if c in forms]


def text_schema(columns: list[str]) -> T.StructType:
    """All columns as text: no type is inferred, so no leading zero is lost."""
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def cast_ids(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in id_columns(df.columns)})


def _prepared(name: str, c):
    return set_field(c) if name in SET_FIELDS else iso_date(c) if name in DATE_FIELDS else c


def prepare_records(records: DataFrame) -> DataFrame:
    """Canonical names for the technical columns that are there; sets joined, dates as ISO text; the rest as it is."""
    return records.select(*[_prepared(RENAMES[c], F.col(c)).alias(RENAMES[c]) if c in RENAMES else F.col(c) for c in records.columns])


def prepare_pairs(pairs: DataFrame, sides: tuple[str, str] = ("l", "r")) -> DataFrame:
    """Canonical fields of both sides, null where the technical column is absent; other _l and _r columns are dropped."""
    ends = tuple(f"_{s}" for s in sides)
    through = [F.col(c) for c in pairs.columns if not c.endswith(ends)]
    made = [(_prepared(name, F.col(f"{src}_{s}")) if f"{src}_{s}" in pairs.columns else F.lit(None).cast("string")).alias(f"{name}_{s}") for s in sides for src, name in RENAMES.items()]
    return pairs.select(*through, *made)


def require(df: DataFrame, columns: list[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def drop_unnamed(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in df.columns if not c.startswith("Unnamed")])


def same_schema(a: DataFrame, b: DataFrame) -> bool:
    return set(a.columns) == set(b.columns)
