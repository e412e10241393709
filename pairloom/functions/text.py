"""String normalisation as Column expressions; the six notions of a missing value are six functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What each notion of missing takes for missing besides null.
SENTINELS = ("", "nan", "none", "na", "n/a", "<na>", "nat")
NORM_UPPER = ("", "NAN", "N/A", "NONE")
ATTRIBUTE_NULLS = ("nan", "NaN", "NAN", "null", "NULL", "Null", "None", "none", "NONE", "", "-", "--", "---")
TRUE_TEXTS = ("true", "1", "yes")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(_col(c).cast("string"), r"^\s+|\s+$", "")


def clean(c: Column | str) -> Column:
    """Stripped and upper-cased; '' where missing in the rule engine's sense."""
    s = strip(c)
    return F.when(_col(c).isNull() | F.lower(s).isin(*SENTINELS), F.lit("")).otherwise(F.upper(s))


def label_norm(c: Column | str) -> Column:
    """As ``clean``, with null where missing."""
    return F.nullif(clean(c), F.lit(""))


def prediction_norm(c: Column | str) -> Column:
    """Stripped and upper-cased, null where missing in the sense of the prediction reports."""
    s = F.upper(strip(c))
    return F.when(s.isin(*NORM_UPPER), F.lit(None)).otherwise(s)


def diagnostic_norm(c: Column | str) -> Column:
    """Stripped and upper-cased, '' for null; no other value is missing."""
    return F.coalesce(F.upper(strip(c)), F.lit(""))


def attribute_missing(c: Column | str) -> Column:
    return _col(c).isNull() | _col(c).cast("string").isin(*ATTRIBUTE_NULLS)


def cell_missing(c: Column | str) -> Column:
    """Null or blank; of an array, no item that is neither."""
    return _col(c).isNull() | (strip(c) == "")


def array_missing(c: Column | str) -> Column:
    return _col(c).isNull() | ~F.exists(_col(c), lambda x: x.isNotNull() & (F.regexp_replace(x, r"^\s+|\s+$", "") != ""))


def digits(c: Column | str) -> Column:
    return F.regexp_replace(clean(c), "[^0-9]", "")


def parse_bool(c: Column | str) -> Column:
    return F.coalesce(F.lower(strip(c)).isin(*TRUE_TEXTS), F.lit(False))


def name_tokens(*fields: Column | str) -> Column:
    """Tokens in order, with repeats: split at white space and hyphens."""
    whole = F.concat_ws(" ", *[F.regexp_replace(clean(f), "-", " ") for f in fields])
    return F.filter(F.split(whole, r"\s+"), lambda x: x != "")


def name_token_set(*fields: Column | str) -> Column:
    """Sorted distinct tokens."""
    return F.array_sort(F.array_distinct(name_tokens(*fields)))


def name_compact(*fields: Column | str) -> Column:
    """Letters of any script, in field order."""
    return F.regexp_replace(F.concat(*[clean(f) for f in fields]), r"[^\p{L}]", "")


def name_compact_ascii(*fields: Column | str) -> Column:
    """A-Z of the fields as they are, upper-cased; null if there is none."""
    return F.nullif(F.upper(F.regexp_replace(F.concat(*[F.coalesce(_col(f), F.lit("")) for f in fields]), "[^A-Za-z]", "")), F.lit(""))


def joined_set(items: Column) -> Column:
    """Sorted items with one space between; blank and nan items are dropped."""
    kept = F.filter(items, lambda x: x.isNotNull() & ~F.lower(F.trim(x)).isin("", "nan"))
    return F.array_join(F.array_sort(kept), " ")


def set_field(c: Column | str) -> Column:
    """One text for an array, a set written as a literal, or a text that is joined already; '' where missing."""
    c = _col(c)
    s = strip(c)
    literal = F.regexp_extract_all(s, F.lit(r"""['"]([^'"]*)['"]"""), 1)
    return F.when(c.isNull() | F.lower(s).isin("nan", "none", ""), F.lit("")).when(s.rlike(r"^[\[{(]"), joined_set(literal)).otherwise(s)


def phone_set(*phones: Column | str) -> Column:
    return F.nullif(F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*[_col(p) for p in phones])))), " "), F.lit(""))


def email_parts(c: Column) -> tuple[Column, Column]:
    """What is before and after the last @; both '' if there is none."""
    return F.regexp_extract(c, r"^(.*)@([^@]*)$", 1), F.regexp_extract(c, r"^(.*)@([^@]*)$", 2)


def is_po_box(c: Column | str) -> Column:
    return _col(c).rlike(r"(?i)^(PO|P O|POST OFFICE) ?BOX")


def is_ascii_upper(c: Column | str) -> Column:
    return (_col(c) == F.upper(_col(c))) & _col(c).rlike(r"^[\x00-\x7F]*$")


def expand_directions(c: Column | str) -> Column:
    """Street words spelled out, in this order."""
    out = F.concat(F.lit(" "), _col(c), F.lit(" "))
    for short, full in (("N", "NORTH"), ("S", "SOUTH"), ("E", "EAST"), ("W", "WEST"), ("ST", "STREET"), ("AVE", "AVENUE"), ("RD", "ROAD"), ("DR", "DRIVE"), ("BLVD", "BOULEVARD")):
        out = F.replace(out, F.lit(f" {short} "), F.lit(f" {full} "))
    return F.trim(out)


# validators

def valid_ssn(c: Column | str) -> Column:
    c = _col(c)
    return c.rlike(r"^[0-9]{9}$") & ~F.substring(c, 1, 3).isin("000", "666") & (F.substring(c, 1, 1) != "9") & (F.substring(c, 4, 2) != "00") & (F.substring(c, 6, 4) != "0000")


def valid_phone(c: Column | str) -> Column:
    """Ten digits; area and exchange begin with 2-9, and the exchange is neither N11 nor 555."""
    c = _col(c)
    return c.rlike(r"^[2-9][0-9]{2}[2-9][0-9]{6}$") & (F.substring(c, 5, 2) != "11") & (F.substring(c, 4, 3) != "555")


def valid_zip(c: Column | str) -> Column:
    return _col(c).rlike(r"^[0-9]{5}$")


def valid_last4(c: Column | str) -> Column:
    return _col(c).rlike(r"^[0-9]{4}$") & (_col(c) != "0000")


#: What cleaning takes for no name.
FILTERED_TOKENS = ("TEST", "BABY", "UNKNOWN", "NULL", "NAN", "NONE", "N/A", "NA", "NMI", "-", "ID", "")
FILTERED_PARTS = ("BABYBOY", "BABY BOY", "BABYGIRL", "BABY GIRL", "DUPLICATE", "DONOTUSE", "DO NOT USE", "DONT USE", "DON'T USE", "DO NOT", "MEDICARE", "DOUBLE ACCOUNT", "DUPLICATE ACCOUNT", "ACCOUNT", "<MRG>")


def filtered_token(c: Column | str) -> Column:
    c = F.upper(strip(c))
    out = c.isin(*FILTERED_TOKENS) | c.rlike(r"^[0-9]+$") | c.rlike(r"^ID[0-9]+$")
    for part in FILTERED_PARTS:
        out = out | c.contains(part)
    return out
