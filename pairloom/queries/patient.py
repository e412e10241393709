"""Patient-shaped records and candidate pairs over the given tables.

The tables have no patients, so a view makes some of ``customer`` by integer
arithmetic alone, the same in Spark and in SQL: a record for each customer, and for
every third a corrupted copy. Candidate pairs are those of one nation and segment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FIRST = "ROBERT MARIA JAMES ELIZABETH JOSE WILLIAM ANNE-MARIE MICHAEL PATRICIA ANTHONY ROSA CHRISTOPHER LINDA DANIEL GUADALUPE THOMAS O'NEIL JESUS KATHERINE RICHARD TERESA DAVID MARK JO".split()
MIDDLE = "A LEE ANN J".split()
LAST = ["SMITH", "GARCIA", "DE LA CRUZ", "JOHNSON", "MARTINEZ-LOPEZ", "NGUYEN", "WILLIAMS", "BROWN", "GONZALEZ", "MILLER", "DAVIS", "LI", "RODRIGUEZ", "WILSON", "O'BRIEN", "TAYLOR", "HERNANDEZ", "MOORE", "KIM"]
NICK = "BOB MARI JIM LIZ PEPE BILL ANNE MIKE PAT TONY ROSIE CHRIS LYNN DAN LUPE TOM NEIL CHUY KATE DICK TERE DAVE MARC JOSEPH".split()
STREET = ["MAIN ST", "N OAK AVE", "ELM ST", "W LAKE DR", "PINE RD"]
CITY = ["CHICAGO", "AURORA", "ELGIN", "PEORIA"]
DOMAIN = ["GMAIL.COM", "YAHOO.COM", "AOL.COM"]

FIELDS = ["first_name", "middle_name", "last_name", "suffix", "dob", "ssn", "ssn4", "sex", "address", "address2", "city", "state", "zip", "phone", "email"]


def _sql(spark: bool) -> str:
    def pick(values: list[str], at: str) -> str:
        listed = ", ".join("'" + v.replace("'", "\\'" if spark else "''") + "'" for v in values)
        return f"element_at(array({listed}), cast(1 + ({at}) % {len(values)} as int))" if spark else f"list_extract([{listed}], 1 + ({at}) % {len(values)})"

    big = "bigint"
    day = "cast(date_add(date '1940-01-01', cast((k * 37) % 25000 as int)) as string)" if spark else "cast(date '1940-01-01' + cast((k * 37) % 25000 as integer) as varchar)"
    idiv = "div" if spark else "//"
    text = "string" if spark else "varchar"
    return f"""
WITH base AS (SELECT cast(c_custkey as {big}) AS k, c_nationkey AS nation, c_mktsegment AS segment FROM customer),
plain AS (
  SELECT k, nation, segment,
    CASE WHEN k % 97 = 0 THEN NULL ELSE {pick(FIRST, "k * 7")} END AS first_name,
    CASE WHEN k % 5 < 2 THEN {pick(MIDDLE, "k * 3")} WHEN k % 53 = 0 THEN 'N/A' END AS middle_name,
    {pick(LAST, f"k * 13 + k {idiv} 19")} AS last_name,
    CASE WHEN k % 41 = 0 THEN 'JR' WHEN k % 43 = 0 THEN 'SR' END AS suffix,
    CASE WHEN k % 17 <> 0 THEN {day} END AS dob,
    CASE WHEN k % 5 = 0 THEN lpad(cast((k * 7919 + 101020001) % 899999999 as {text}), 9, '0') END AS ssn,
    CASE WHEN k % 5 = 0 THEN substr(lpad(cast((k * 7919 + 101020001) % 899999999 as {text}), 9, '0'), 6, 4) WHEN k % 7 < 2 THEN lpad(cast((k * 31) % 89 + 1000 as {text}), 4, '0') END AS ssn4,
    CASE WHEN k % 4 = 0 THEN NULL WHEN k % 2 = 0 THEN 'FEMALE' ELSE 'MALE' END AS sex,
    CASE WHEN k % 23 <> 0 THEN cast(1 + k % 900 as {text}) || ' ' || {pick(STREET, "k * 11")} END AS address,
    CASE WHEN k % 3 = 0 THEN 'APT ' || cast(k % 30 as {text}) END AS address2,
    {pick(CITY, "k")} AS city,
    CASE WHEN k % 61 = 0 THEN 'WI' ELSE 'IL' END AS state,
    lpad(cast(60000 + (k * 17) % 900 as {text}), 5, '0') AS zip,
    CASE WHEN k % 13 = 0 THEN '5551234' WHEN k % 9 = 0 THEN NULL WHEN k % 4 = 0 THEN '312' || lpad(cast((k * 104729) % 7999999 + 2000000 as {text}), 7, '0') || ' ' || '773' || lpad(cast((k * 31337) % 7999999 + 2000000 as {text}), 7, '0') ELSE '312' || lpad(cast((k * 104729) % 7999999 + 2000000 as {text}), 7, '0') END AS phone,
    CASE WHEN k % 3 = 0 THEN 'USER' || cast(k % 700 as {text}) || '@' || {pick(DOMAIN, "k")} END AS email
  FROM base),
copied AS (
  SELECT k, nation, segment,
    CASE WHEN k % 11 = 2 THEN {pick(NICK, "k * 7")} WHEN k % 11 = 7 THEN substr(first_name, 1, 1) ELSE first_name END AS first_name,
    CASE WHEN k % 11 = 1 THEN NULL WHEN k % 11 = 4 AND k % 2 = 0 THEN 'Q' ELSE middle_name END AS middle_name,
    CASE WHEN k % 11 = 0 THEN substr(last_name, 2, 1) || substr(last_name, 1, 1) || substr(last_name, 3, 40) WHEN k % 11 = 8 THEN substr(last_name, 1, 5) WHEN k % 22 = 9 THEN last_name || 'Z' WHEN k % 22 = 3 THEN 'SANTOS' ELSE last_name END AS last_name,
    suffix,
    CASE WHEN k % 11 = 3 AND dob IS NOT NULL THEN substr(dob, 1, 4) || '-' || substr(dob, 9, 2) || '-' || substr(dob, 6, 2) WHEN k % 11 = 9 AND dob IS NOT NULL THEN cast(cast(substr(dob, 1, 4) as integer) + 1 as {text}) || substr(dob, 5, 6) ELSE dob END AS dob,
    CASE WHEN k % 2 = 0 THEN NULL ELSE ssn END AS ssn,
    CASE WHEN k % 29 = 0 THEN '9999' ELSE ssn4 END AS ssn4,
    sex,
    CASE WHEN k % 11 = 4 THEN '77 WEST END' ELSE address END AS address, address2, city, state,
    CASE WHEN k % 22 = 4 THEN '61000' ELSE zip END AS zip,
    CASE WHEN k % 11 = 5 THEN '8472223344' ELSE phone END AS phone,
    CASE WHEN k % 11 = 6 THEN replace(email, 'GMAIL.COM', 'GMIAL.COM') WHEN k % 11 = 10 THEN replace(email, '.COM', '.CO') ELSE email END AS email
  FROM plain WHERE k % 3 = 0)
SELECT 'P' || cast(k as {text}) AS PATID, k AS entity, nation, segment, k % 19 <> 1 AS valid_record, {", ".join(FIELDS)} FROM plain
UNION ALL
SELECT 'C' || cast(k as {text}) AS PATID, k AS entity, nation, segment, true AS valid_record, {", ".join(FIELDS)} FROM copied
"""


PATIENTS = _sql(False)
BLOCK = ["nation", "segment"]
#: Pairs of one nation and segment in the order of their ids, with label 1 for one entity.
PAIRS = f"""SELECT a.PATID AS PATID_A, b.PATID AS PATID_B, CAST(a.entity = b.entity AS INTEGER) AS label
FROM ({PATIENTS}) a JOIN ({PATIENTS}) b ON a.nation = b.nation AND a.segment = b.segment AND a.PATID < b.PATID"""


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/customer.parquet").createOrReplaceTempView("customer")
    return spark.sql(_sql(True))


def labelled(pairs: DataFrame) -> DataFrame:
    """``pairs`` with label in the place of both entities."""
    from pyspark.sql import functions as F

    rest = [c for c in pairs.columns if c not in ("PATID_A", "PATID_B", "entity_a", "entity_b")]
    return pairs.select("PATID_A", "PATID_B", (F.col("entity_a") == F.col("entity_b")).cast("int").alias("label"), *rest)


def pairs_of(records: DataFrame, fields: list[str] | None = None, sides: tuple[str, str] = ("a", "b")) -> DataFrame:
    """PATID_A, PATID_B, label and both records' fields of the pairs of one nation and segment."""
    from pairloom.operators.pairs import block_wide

    return labelled(block_wide(records, BLOCK, fields or [], sides, carry=["entity"]))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs_of(patients(spark, sf_dir))
