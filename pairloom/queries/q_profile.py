"""Population profile queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.operators import profile as P
from pairloom.operators.aggregates import mode_by
from pairloom.queries.patient import FIELDS, PATIENTS, patients

SHOWN = ["first_name", "middle_name", "suffix", "dob", "ssn", "ssn4", "address", "phone", "email"]


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def topn_kanon(spark, sf_dir):
    return P.top_values(_table(spark, sf_dir, "part"), F.col("p_type"), 5, 20)


def length_profile(spark, sf_dir):
    return P.length_profile(_table(spark, sf_dir, "documents"), F.col("text"), ["lang"])


def token_profile(spark, sf_dir):
    return P.token_profile(patients(spark, sf_dir), F.col("last_name"), ["state"])


def missingness(spark, sf_dir):
    return P.missingness(patients(spark, sf_dir), FIELDS)


def co_missingness(spark, sf_dir):
    return P.co_missing(patients(spark, sf_dir), {"ids": ["ssn", "ssn4"], "contact": ["phone", "email"], "name_and_dob": ["first_name", "dob"]})


def missing_patterns(spark, sf_dir):
    return P.missing_patterns(patients(spark, sf_dir), SHOWN, 5, 30)


def phones_per_record(spark, sf_dir):
    return P.items_per_record(patients(spark, sf_dir), F.col("phone"))


def dob_profile(spark, sf_dir):
    return P.date_profile(_table(spark, sf_dir, "orders"), F.col("o_orderdate").cast("date"))


def dob_range(spark, sf_dir):
    return P.date_range(patients(spark, sf_dir), F.col("dob").try_cast("date"))


def contact_profile(spark, sf_dir):
    return P.contact_profile(patients(spark, sf_dir), 5, 25)


def mode_agreement(spark, sf_dir):
    return P.mode_agreement(_table(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment")


def mode_per_key(spark, sf_dir):
    return mode_by(_table(spark, sf_dir, "customer"), ["c_nationkey"], "c_mktsegment")


def geo_joint(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").join(_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return P.joint_top(c, ["n_name", "r_name", "c_mktsegment"], 8, 40)


def within_cluster_agreement(spark, sf_dir):
    return P.within_cluster_agreement(patients(spark, sf_dir), ["nation", "segment"])


QUERIES = {f.__name__: f for f in (topn_kanon, length_profile, token_profile, missingness, co_missingness, missing_patterns, phones_per_record, dob_profile, dob_range, contact_profile, mode_agreement, mode_per_key, geo_joint, within_cluster_agreement)}


def _top(src: str, k: int, top: int, by: str = "") -> str:
    """``src`` has value, and kind if by is kind."""
    p = f"PARTITION BY {by}" if by else ""
    key = f"{by}, " if by else ""
    return f"""WITH c AS (SELECT {key}value, count(*) AS n FROM ({src}) WHERE value IS NOT NULL GROUP BY ALL), h AS (SELECT * FROM (SELECT *, row_number() OVER ({p} ORDER BY n DESC, value) AS r FROM c WHERE n >= {k}) WHERE r <= {top}),
      t AS (SELECT {key}'{P.TAIL}' AS value, CAST(sum(n) AS BIGINT) AS n FROM c ANTI JOIN h USING ({key}value) {'GROUP BY 1' if by else ''})
      SELECT {key}value, n FROM h UNION ALL SELECT {key}value, n FROM t WHERE n > 0"""


_rate = lambda c: f"round(avg(CAST({c} AS INTEGER)), 6)"
_kinds = {"area_code": "substr(phone, 1, 3)", "email_domain": "CASE WHEN contains(email, '@') THEN list_extract(string_split(email, '@'), -1) END", "street_suffix": "list_extract(string_split(address, ' '), -1)", "unit": "split_part(address2, ' ', 1)", "ssn_area": "substr(ssn, 1, 3)"}
_AGREE = ["first_name", "middle_name", "last_name", "dob", "zip", "phone", "email", "sex", "address"]
_P = f"SELECT {', '.join(f'a.{f} AS {f}_a, b.{f} AS {f}_b' for f in _AGREE)} FROM ({PATIENTS}) a JOIN ({PATIENTS}) b ON a.nation = b.nation AND a.segment = b.segment AND a.PATID < b.PATID"
_R = f"SELECT *, CASE WHEN x IS NULL OR y IS NULL THEN NULL WHEN x = y THEN 'exact' WHEN year(x) = year(y) AND month(x) = day(y) AND day(x) = month(y) THEN 'transpose' WHEN year(x) = year(y) AND month(x) = month(y) AND abs(day(x) - day(y)) = 1 THEN 'off_day' WHEN month(x) = month(y) AND day(x) = day(y) AND abs(year(x) - year(y)) = 1 THEN 'off_year' ELSE 'other' END AS rel FROM (SELECT *, try_cast(dob_a AS DATE) AS x, try_cast(dob_b AS DATE) AS y FROM ({_P}))"
_both = lambda f: f"{f}_a IS NOT NULL AND {f}_b IS NOT NULL"
_metrics = {f"{f}_equal": (_both(f), f"{f}_a = {f}_b") for f in _AGREE} | {f"{f}_within{n}": (_both(f), f"levenshtein({f}_a, {f}_b) <= {n}") for f in ("first_name", "last_name") for n in (1, 2)} | {f"dob_{r}": ("rel IS NOT NULL", f"rel = '{r}'") for r in ("exact", "transpose", "off_day", "off_year", "other")} | {"middle_one_missing": ("true", "(middle_name_a IS NULL) <> (middle_name_b IS NULL)")}

ORACLES = {
    "topn_kanon": _top("SELECT p_type AS value FROM part", 5, 20),
    "length_profile": "SELECT lang, count(*) AS n, round(avg(length(text)), 6) AS mean, round(stddev_pop(length(text)), 6) AS std, CAST(trunc(quantile_cont(length(text), 0.05)) AS INTEGER) AS p5, CAST(trunc(quantile_cont(length(text), 0.5)) AS INTEGER) AS p50, CAST(trunc(quantile_cont(length(text), 0.95)) AS INTEGER) AS p95 FROM documents GROUP BY 1",
    "token_profile": f"SELECT state, round(avg(t), 6) AS mean_tokens, {_rate('t = 1')} AS one, {_rate('t = 2')} AS two, {_rate('t >= 3')} AS three_up, {_rate(chr(99) + 'ontains(last_name, ' + repr('-') + ')')} AS hyphen, round(avg(CAST(contains(last_name, '''') AS INTEGER)), 6) AS apostrophe FROM (SELECT *, len(string_split(last_name, ' ')) AS t FROM ({PATIENTS})) GROUP BY 1",
    "missingness": f"WITH p AS ({PATIENTS}) " + " UNION ALL ".join(f"SELECT '{f}' AS field, count(*) AS n, count(*) FILTER ({f} IS NULL) AS missing, round(count(*) FILTER ({f} IS NULL) / count(*), 6) AS rate FROM p" for f in FIELDS),
    "co_missingness": f"WITH p AS ({PATIENTS}) SELECT 'ids' AS fields, {_rate('ssn IS NULL AND ssn4 IS NULL')} AS rate FROM p UNION ALL SELECT 'contact', {_rate('phone IS NULL AND email IS NULL')} FROM p UNION ALL SELECT 'name_and_dob', {_rate('first_name IS NULL AND dob IS NULL')} FROM p",
    "missing_patterns": _top(f"SELECT {' || '.join(f'CASE WHEN {f} IS NULL THEN chr(48) ELSE chr(49) END' for f in SHOWN)} AS value FROM ({PATIENTS})", 5, 30),
    "phones_per_record": f"SELECT CAST(CASE WHEN phone IS NULL THEN 0 ELSE len(string_split(phone, ' ')) END AS INTEGER) AS items, count(*) AS n FROM ({PATIENTS}) GROUP BY 1",
    "dob_profile": "SELECT 'decade' AS part, CAST(year(o_orderdate) // 10 * 10 AS INTEGER) AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'month', CAST(month(o_orderdate) AS INTEGER), count(*) FROM orders GROUP BY 2 UNION ALL SELECT 'day', CAST(day(o_orderdate) AS INTEGER), count(*) FROM orders GROUP BY 2",
    "dob_range": f"SELECT CAST(min(year(d)) AS INTEGER) AS min_year, CAST(max(year(d)) AS INTEGER) AS max_year, {_rate('year(d) >= 2000')} AS recent FROM (SELECT try_cast(dob AS DATE) AS d FROM ({PATIENTS})) WHERE d IS NOT NULL",
    "contact_profile": _top(" UNION ALL ".join(f"SELECT '{k}' AS kind, {v} AS value FROM ({PATIENTS})" for k, v in _kinds.items()), 5, 25, "kind"),
    "mode_agreement": "SELECT count(*) AS keys, CAST(sum(a) AS BIGINT) AS n, round(sum(t) / sum(a), 6) AS agreement FROM (SELECT c_nationkey, sum(n) AS a, max(n) AS t FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL) GROUP BY 1)",
    "mode_per_key": "SELECT c_nationkey, c_mktsegment AS mode FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) = 1",
    "geo_joint": _top("SELECT n_name || '|' || r_name || '|' || c_mktsegment AS value FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey", 8, 40),
    "within_cluster_agreement": f"WITH r AS ({_R}) " + " UNION ALL ".join(f"SELECT '{m}' AS metric, count(*) FILTER ({b} AND {h}) AS numerator, count(*) FILTER ({b}) AS denominator, round(count(*) FILTER ({b} AND {h}) / nullif(count(*) FILTER ({b}), 0), 6) AS rate FROM r" for m, (b, h) in _metrics.items()),
}
