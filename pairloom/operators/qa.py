"""Quality checks of pair corpora: each a row (check_name, kind, value, threshold, ok), worked out in two passes.

Hard checks must hold; warnings and reports are to be read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.text import filtered_token, is_ascii_upper, name_token_set, valid_last4, valid_phone, valid_ssn, valid_zip
from pairloom.operators.aggregates import with_share
from pairloom.operators.generate import band_of, name_gender
from pairloom.operators.schema import FEATURES, same_schema

#: Shares of records with a field, and how far a corpus may be from them.
PRESENCE = {"middle_name": 0.194, "address": 0.963, "address2": 0.294, "email": 0.311, "sex": 0.791, "phone": 0.944, "dob": 0.997, "last_name": 0.997}
TOLERANCE = 0.035
#: Blocking keys that a hard negative shares; phones, a set, count where they overlap.
STRONG = ("last_name", "dob", "address", "ssn4")
PERSON = ("first_name", "last_name", "dob", "address")


def _all(c: Column) -> Column:
    """Share of rows where the condition holds or does not apply."""
    return F.avg(F.coalesce(c, F.lit(True)).cast("double"))


def _both(f: str, test) -> Column:
    return F.coalesce(test(F.col(f"{f}_l")), F.lit(True)) & F.coalesce(test(F.col(f"{f}_r")), F.lit(True))


def _shared() -> Column:
    phones = F.arrays_overlap(F.split("phone_l", " "), F.split("phone_r", " "))
    return reduce(lambda a, b: a + b, [F.coalesce(c.cast("int"), F.lit(0)) for c in (*[F.col(f"{f}_l") == F.col(f"{f}_r") for f in STRONG], phones)])


def run_checks(train: DataFrame, test: DataFrame) -> DataFrame:
    spark = train.sparkSession
    pos, neg = F.col("label") == 1, F.col("label") == 0
    same = lambda *fs: reduce(lambda a, b: a & b, [F.col(f"{f}_l").eqNullSafe(F.col(f"{f}_r")) for f in fs])
    tokens = lambda s: name_token_set(f"first_name_{s}", f"middle_name_{s}", f"last_name_{s}")
    names = ("first_name", "middle_name", "last_name")
    shuffled = F.col("case_type").isin("M-NAME-02", "M-NAME-03", "M-NAME-05")
    equal = lambda f: F.coalesce(F.col(f"{f}_l") == F.col(f"{f}_r"), F.lit(False))
    phones = lambda c: F.forall(F.split(c, " "), lambda p: valid_phone(p) & ~p.rlike("^(555|.11)"))
    per_table: list[tuple[str, str, Column, float, str]] = [
        ("names_upper_ascii", "hard", _all(reduce(lambda a, b: a & b, [_both(f, is_ascii_upper) for f in names])), 1.0, ">="), ("zip_five_digits", "hard", _all(_both("zip", valid_zip)), 1.0, ">="),
        ("case_label", "hard", _all((F.col("case_type").startswith("NM-") & neg) | ((F.col("case_type").startswith("M-") | F.col("case_type").startswith("POL-")) & pos)), 1.0, ">="),
        ("no_identical_matches", "hard", F.sum((pos & (F.col("case_type") != "POL-AMBIG-03") & same(*PERSON)).cast("double")), 0.0, "<="), ("negatives_share_two_keys", "warn", F.avg(F.when(neg, (_shared() >= 2).cast("double"))), 0.3, ">="),
        ("no_identity_collision", "hard", F.sum((neg & same(*PERSON)).cast("double")), 0.0, "<="),
        ("ssn_valid", "hard", _all(_both("ssn", valid_ssn)), 1.0, ">="), ("last4_valid", "hard", _all(_both("ssn4", valid_last4)), 1.0, ">="),
        ("last4_is_tail", "hard", _all((F.coalesce(F.right("ssn_l", F.lit(4)) == F.col("ssn4_l"), F.lit(True))) & F.coalesce(F.right("ssn_r", F.lit(4)) == F.col("ssn4_r"), F.lit(True))), 1.0, ">="), ("phones_valid", "hard", _all(_both("phone", phones)), 1.0, ">="),
        ("no_filtered_tokens", "hard", _all(reduce(lambda a, b: a & b, [_both(f, lambda c: ~filtered_token(c)) for f in (*names, "address")])), 1.0, ">="), ("token_sets_kept", "hard", F.coalesce(F.avg(F.when(shuffled, (tokens("l") == tokens("r")).cast("double"))), F.lit(1.0)), 0.99, ">="),
        ("full_ssn_share", "warn", F.avg(F.when(pos, equal("ssn").cast("double"))), 0.07, "<="), ("no_id_share", "warn", F.avg(F.when(pos, (~(equal("ssn") | equal("ssn4"))).cast("double"))), 0.72, ">="),
        ("address_equal_share", "warn", F.avg(F.when(pos, equal("address").cast("double"))), 0.34, "<="), ("differing_fields_mean", "report", F.avg(F.when(pos, F.size(F.from_json("corruptions_applied", "array<string>")))), 0.0, ">="),
        ("anchor_survives", "report", F.avg(F.when(pos, (same("ssn4") | same("address") | same("phone") | (same("first_name", "last_name") & same("dob"))).cast("double"))), 0.0, ">="), ("surname_changed_women", "report", F.avg(F.when(pos & (F.col("sex_l") == "FEMALE"), (~same("last_name")).cast("double"))), 0.0, ">="),
    ]
    nameless = tokens("l") == tokens("r")
    sexed = lambda s: F.when(F.col(f"sex_{s}").isNotNull(), (name_gender(F.col(f"first_name_{s}")) == F.col(f"sex_{s}")).cast("double"))
    per_table += [
        ("negatives_like_matches_without_ssn", "report", F.avg(F.when(neg, (nameless & equal("dob") & ~equal("ssn") & ~equal("ssn4")).cast("double"))), 0.0, ">="),
        ("name_sex_agreement", "report", (F.avg(sexed("l")) + F.avg(sexed("r"))) / 2, 0.0, ">="),
        ("surname_changed_men", "report", F.avg(F.when(pos & (F.col("sex_l") == "MALE"), (~same("last_name")).cast("double"))), 0.0, ">="),
    ]
    per_table += [(f"presence_{f}", "warn", F.abs((F.avg(F.col(f"{f}_l").isNotNull().cast("double")) + F.avg(F.col(f"{f}_r").isNotNull().cast("double"))) / 2 - t), TOLERANCE, "<=") for f, t in PRESENCE.items()]

    def checks(df: DataFrame, name: str) -> DataFrame:
        one = df.agg(*[c.alias(f"v{k}") for k, (_, _, c, _, _) in enumerate(per_table)])
        rows = [F.struct(F.lit(f"{name}:{n}").alias("check_name"), F.lit(kind).alias("kind"), F.round(F.col(f"v{k}").cast("double"), 6).alias("value"), F.lit(t).alias("threshold"), (F.col(f"v{k}") >= t if op == ">=" else F.col(f"v{k}") <= t).alias("ok")) for k, (n, kind, _, t, op) in enumerate(per_table)]
        return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")

    ids = lambda df: df.select(F.col("entity_id_a").alias("e")).union(df.select("entity_id_b")).distinct()
    shared = ids(train).join(ids(test), "e", "left_semi").agg(F.count("*").cast("double").alias("value"))
    disjoint = shared.select(F.lit("both:entities_disjoint").alias("check_name"), F.lit("hard").alias("kind"), "value", F.lit(0.0).alias("threshold"), (F.col("value") == 0).alias("ok"))
    hard = test.where(neg).agg(F.avg((_shared() >= 1).cast("double")).alias("value"))
    keyed = hard.select(F.lit("test:negatives_share_a_key").alias("check_name"), F.lit("hard").alias("kind"), F.round("value", 6).alias("value"), F.lit(0.95).alias("threshold"), (F.col("value") >= 0.95).alias("ok"))
    schema = spark.createDataFrame([("both:same_schema", "hard", float(same_schema(train, test)), 1.0, same_schema(train, test))], "check_name string, kind string, value double, threshold double, ok boolean")
    return reduce(DataFrame.unionByName, [schema, checks(train, "train"), checks(test, "test"), disjoint, keyed])


def distributions(pairs: DataFrame, real: DataFrame | None = None) -> DataFrame:
    """Shares of state, sex, decade of birth, email domain and identifier band over all records of a corpus.

    With ``real`` (part, value, share) the population's own shares stand beside, and the difference.
    """
    side = lambda s: [F.col(f"{f}_{s}").alias(f) for f in ("state", "sex", "dob", "email", "ssn", "ssn4")]
    records = pairs.select(*side("l")).unionAll(pairs.select(*side("r")))
    parts = {"state": F.col("state"), "sex": F.col("sex"), "decade": F.concat(F.substring("dob", 1, 3), F.lit("0")), "email_domain": F.when(F.col("email").contains("@"), F.element_at(F.split("email", "@"), -1)), "ssn_band": band_of(F.col("ssn"), F.col("ssn4"))}
    long = records.select(F.explode(F.array(*[F.struct(F.lit(n).alias("part"), c.alias("value")) for n, c in parts.items()])).alias("r")).select("r.*").where("value IS NOT NULL")
    counts = long.groupBy("part", "value").agg(F.count("*").alias("n"))
    out = with_share(counts, "n", "share", ["part"], 1.0)
    if real is None:
        return out
    both = out.join(real.withColumnRenamed("share", "real_share"), ["part", "value"], "full_outer").na.fill(0.0, ["share", "real_share"]).na.fill(0, ["n"])
    return both.withColumn("difference", F.round(F.col("share") - F.col("real_share"), 4))


def require_hard(checks: DataFrame) -> None:
    bad = [r["check_name"] for r in checks.where("kind = 'hard' AND NOT coalesce(ok, false)").collect()]
    if bad:
        raise AssertionError(f"hard checks failed: {bad}")


def shared_key_histogram(pairs: DataFrame) -> DataFrame:
    return pairs.where("label = 0").groupBy(_shared().alias("keys")).agg(F.count("*").alias("n"))


def repeated_pairs(pairs: DataFrame) -> DataFrame:
    """Serialized pairs that occur more than once."""
    whole = F.concat_ws("|", *[F.coalesce(F.col(f"{f}_{s}"), F.lit("")) for f in FEATURES for s in ("l", "r")])
    return pairs.groupBy(F.md5(whole).alias("pair")).agg(F.count("*").alias("n")).where("n > 1")
