"""Evaluation: confusion metrics, curves, sweeps, operating points, calibration and breakdowns.

Every report is grouped aggregation. Curves need running totals over descending
scores: scores are first reduced to one row a distinct value, and the running totals
go over that, by ranges of the score, so rows of all data never meet in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.similarity import jaro_winkler
from pairloom.operators.aggregates import percentiles, side_by_side
from pairloom.operators.pairs import block_pairs, pairs_of_first
from pairloom.plans.running import running_totals


def safe(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    return F.when(b == 0, F.lit(empty).cast("double")).otherwise(a / b)


def confusion(df: DataFrame, truth: Column, pred: Column, by: list[str] | None = None) -> DataFrame:
    t, p = truth.cast("boolean"), pred.cast("boolean")
    return df.groupBy(*(by or [])).agg(F.count_if(~t & ~p).alias("tn"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(t & p).alias("tp"))


def scores_of(counts: DataFrame, digits: int = 6) -> DataFrame:
    """tn, fp, fn, tp with accuracy, balanced accuracy, precision, recall, f1, macro f1 and mcc; ratios of nothing are 0, mcc of one class null."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    precision, recall = safe(tp, tp + fp), safe(tp, tp + fn)
    f1, f0 = safe(2 * tp, 2 * tp + fp + fn), safe(2 * tn, 2 * tn + fp + fn)
    spread = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    values = {"accuracy": safe(tp + tn, tn + fp + fn + tp), "balanced_accuracy": (recall + safe(tn, tn + fp)) / 2, "precision": precision, "recall": recall, "f1": f1, "f1_macro": (f1 + f0) / 2, "mcc": safe(tp * tn - fp * fn, spread, None)}
    return counts.select(*counts.columns, *[F.round(v, digits).alias(n) for n, v in values.items()])


def class_report(counts: DataFrame) -> DataFrame:
    """Precision, recall, f1 and support of both classes, from one row of counts."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    row = lambda k, hit, over, miss: F.struct(F.lit(k).alias("class"), F.round(safe(hit, hit + over), 6).alias("precision"), F.round(safe(hit, hit + miss), 6).alias("recall"), F.round(safe(2 * hit, 2 * hit + over + miss), 6).alias("f1"), (hit + miss).cast("long").alias("support"))
    return counts.select(F.explode(F.array(row(0, tn, fn, fp), row(1, tp, fp, fn))).alias("r")).select("r.*")


def text_prediction(c: Column) -> Column:
    """1 for a text that says yes or true somewhere, or the number 1."""
    s = F.lower(c.cast("string"))
    return (s.contains("yes") | s.contains("true") | (s == "1")).cast("int")


def curve(df: DataFrame, score: str = "score", truth: str = "label") -> DataFrame:
    """Per distinct score, descending: threshold, tp, fp with totals p and n; equal scores share a point."""
    points = df.groupBy(F.col(score).alias("threshold")).agg(F.sum(F.col(truth).cast("long")).alias("dtp"), F.sum((1 - F.col(truth)).cast("long")).alias("dfp"))
    out = running_totals(points, "threshold", {"dtp": "tp", "dfp": "fp"}, descending=True)
    total = points.agg(F.sum("dtp").alias("p"), F.sum("dfp").alias("n"))
    return out.join(F.broadcast(total)).select("threshold", "tp", "fp", "p", "n", "dtp", "dfp")


def pr_roc(points: DataFrame, digits: int = 6) -> DataFrame:
    tp, fp, p, n = (F.col(c).cast("double") for c in ("tp", "fp", "p", "n"))
    return points.select("threshold", "tp", "fp", F.round(safe(tp, tp + fp), digits).alias("precision"), F.round(safe(tp, p), digits).alias("recall"), F.round(safe(fp, n), digits).alias("fpr"))


def areas(points: DataFrame, digits: int = 6) -> DataFrame:
    """Average precision (sum of precision by gained recall) and ROC area (trapezoids), from the points alone."""
    tp, fp, p, n = (F.col(c).cast("double") for c in ("tp", "fp", "p", "n"))
    ap = F.sum(F.col("dtp") / p * tp / (tp + fp))
    auc = F.sum(F.col("dfp") / n * (tp - F.col("dtp") / 2.0) / p)
    return points.agg(F.round(ap, digits).alias("average_precision"), F.round(auc, digits).alias("roc_auc"))


def threshold_sweep(df: DataFrame, score: str = "score", truth: str = "label", steps: int = 19) -> DataFrame:
    """Counts and metrics at 0.05, 0.10, ... by one pass: each row falls in the last threshold it reaches."""
    t, y = F.col(score), F.col(truth).cast("boolean")
    cuts = [round(0.05 * k, 2) for k in range(1, steps + 1)]
    sums = []
    for k, c in enumerate(cuts):
        sums += [F.count_if((t >= c) & y).alias(f"tp{k}"), F.count_if((t >= c) & ~y).alias(f"fp{k}")]
    one = df.agg(*sums, F.count_if(y).alias("p"))
    rows = one.select("p", F.explode(F.array(*[F.struct(F.lit(c).alias("threshold"), F.col(f"tp{k}").alias("tp"), F.col(f"fp{k}").alias("fp")) for k, c in enumerate(cuts)])).alias("r")).select("p", "r.*")
    tp, fp, p = F.col("tp").cast("double"), F.col("fp").cast("double"), F.col("p").cast("double")
    return rows.select("threshold", "tp", "fp", (F.col("p") - F.col("tp")).alias("fn"), F.round(safe(tp, tp + fp), 6).alias("precision"), F.round(safe(tp, p), 6).alias("recall"), F.round(safe(2 * tp, tp + fp + p), 6).alias("f1"))


def operating_points(points: DataFrame) -> DataFrame:
    """Thresholds of best f1, most recall at a precision, most precision at a recall; the smallest score of ties; absent where out of reach."""
    tp, fp, p = (F.col(c).cast("double") for c in ("tp", "fp", "p"))
    x = points.select("threshold", safe(tp, tp + fp).alias("precision"), safe(tp, p).alias("recall"))
    x = x.withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + 1e-12))
    order = lambda c: F.struct(F.round(c, 12), -F.col("threshold"))
    goals = {"best_f1": (F.lit(True), "f1"), "precision>=0.95": (F.col("precision") >= 0.95, "recall"), "precision>=0.99": (F.col("precision") >= 0.99, "recall"), "recall>=0.95": (F.col("recall") >= 0.95, "precision"), "recall>=0.99": (F.col("recall") >= 0.99, "precision")}
    row = F.struct("threshold", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))
    best = x.agg(*[F.max_by(row, F.when(ok, order(F.col(of)))).alias(name) for name, (ok, of) in goals.items()])
    out = best.select(F.explode(F.array(*[F.struct(F.lit(n).alias("point"), F.col(f"`{n}`").alias("r")) for n in goals])).alias("x"))
    return out.select("x.point", "x.r.*").where("threshold IS NOT NULL")


def calibration(df: DataFrame, score: str = "score", truth: str = "label", bins: int = 10) -> DataFrame:
    at = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg(score), 6).alias("mean_pred_prob"), F.round(F.avg(F.col(truth).cast("double")), 6).alias("observed_match_rate"))


def brier(df: DataFrame, score: str = "score", truth: str = "label") -> DataFrame:
    return df.agg(F.round(F.avg(F.pow(F.col(score) - F.col(truth), 2)), 6).alias("brier"), F.count("*").alias("n"))


def subset_stats(df: DataFrame, subsets: dict[str, Column], truth: str = "label", pred: str = "pred", score: str = "score") -> DataFrame:
    """One row a subset: n, n_pos, n_neg, recall, fp_rate, mean_prob (null where there is nothing); one pass for all."""
    y, p = F.col(truth) == 1, F.col(pred) == 1
    sums = []
    for k, m in enumerate(subsets.values()):
        m = F.coalesce(m, F.lit(False))
        sums += [F.count_if(m).alias(f"n{k}"), F.count_if(m & y).alias(f"p{k}"), F.count_if(m & y & p).alias(f"tp{k}"), F.count_if(m & ~y & p).alias(f"fp{k}"), F.avg(F.when(m, F.col(score))).alias(f"m{k}")]
    one = df.agg(*sums)
    d = lambda c: F.col(c).cast("double")
    rows = [F.struct(F.lit(name).alias("subset"), F.col(f"n{k}").alias("n"), F.col(f"p{k}").alias("n_pos"), (F.col(f"n{k}") - F.col(f"p{k}")).alias("n_neg"), F.round(safe(d(f"tp{k}"), d(f"p{k}"), None), 6).alias("recall"), F.round(safe(d(f"fp{k}"), d(f"n{k}") - d(f"p{k}"), None), 6).alias("fp_rate"), F.round(f"m{k}", 6).alias("mean_prob")) for k, name in enumerate(subsets)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def nearest_to(df: DataFrame, score: str, t: float, k: int, ties: list[str]) -> DataFrame:
    return df.orderBy(F.abs(F.col(score) - t), *ties).limit(k)


def nearest_pairs(records: DataFrame, keys: list[str], carry: list[str], scored: Callable[[DataFrame], DataFrame], score: str, t: float, k: int, id_col: str = "PATID", first: int = 256) -> DataFrame:
    """``nearest_to`` of all pairs that ``block_pairs`` makes, by id among equals; ``scored`` adds the score to pairs.

    Pairs of the least ``first`` ids with all records are looked at before others are
    made, then those of 16 times as many: if k of them lie at ``t`` itself, a pair of a
    later first record, which comes after its equals, can't be among the nearest. Else
    all pairs are made.
    """
    known = records.dropna(subset=[id_col, *keys])
    ties = ["PATID_A", "PATID_B"]
    for n in (first, 16 * first):
        upto = known.select(id_col).orderBy(id_col).limit(n).agg(F.max(id_col)).first()[0]
        if upto is None:
            break
        near = nearest_to(scored(pairs_of_first(known, keys, upto, id_col, carry)), score, t, k, ties)
        rows = near.collect()
        if len(rows) == k and all(r[score] == t for r in rows):
            return records.sparkSession.createDataFrame(rows, near.schema)
    return nearest_to(scored(block_pairs(records, keys, id_col, carry)), score, t, k, ties)


def worst_errors(df: DataFrame, k: int, ties: list[str], truth: str = "label", pred: str = "pred", score: str = "score") -> DataFrame:
    """The k missed matches of the lowest score and the k wrong merges of the highest."""
    fn = df.where((F.col(truth) == 1) & (F.col(pred) == 0)).orderBy(score, *ties).limit(k).withColumn("kind", F.lit("false_negative"))
    fp = df.where((F.col(truth) == 0) & (F.col(pred) == 1)).orderBy(F.desc(score), *ties).limit(k).withColumn("kind", F.lit("false_positive"))
    return fn.unionByName(fp)


def cost_per_1k_tokens(hourly_price: float, tokens_per_second: float, instances: int) -> float:
    return hourly_price / (tokens_per_second * instances * 3600) * 1000


def mean_f1(scores: DataFrame) -> DataFrame:
    """Mean F1 over data sets, each counting alike: one row."""
    return scores.agg(F.count("*").alias("datasets"), F.round(F.avg("f1"), 6).alias("mean_f1"))


def review_queue(decided: DataFrame, pred: str = "rule_pred", label: str = "label") -> DataFrame:
    """What is in the review queue, and where the positives went: one row."""
    at = lambda d: F.col(pred) == d
    pos = F.col(label) == 1
    row = decided.agg(
        F.count("*").alias("pairs"), F.count_if(at("review")).alias("queue"), F.count_if(at("review") & pos).alias("queue_positives"),
        F.count_if(pos).alias("positives"), F.count_if(at("match") & pos).alias("matched_positives"), F.count_if(at("non_match") & pos).alias("lost_positives"),
    )
    share = lambda a, b: F.round(safe(F.col(a).cast("double"), F.col(b).cast("double")), 6)
    return row.select("*", share("queue", "pairs").alias("queue_share"), share("queue_positives", "queue").alias("queue_positive_rate"), share("matched_positives", "positives").alias("auto_recall"), share("lost_positives", "positives").alias("lost_share"))


def name_calibration(pairs: DataFrame, fields: tuple[str, ...] = ("first_name", "last_name"), label: str = "label", sides: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Jaro-Winkler of names that differ, all fields together, by class: n, mean and the deciles.

    Equal pairs of names are counted first, so each distinct pair is compared once.
    """
    one = [F.struct(F.col(f"{f}_{sides[0]}").alias("x"), F.col(f"{f}_{sides[1]}").alias("y")) for f in fields]
    long = pairs.select(F.col(label).alias("label"), F.explode(F.array(*one)).alias("n")).select("label", "n.*").where("x != y AND x != '' AND y != ''")
    counts = long.groupBy("label", "x", "y").agg(F.count("*").alias("times")).withColumn("jw", F.round(jaro_winkler(F.col("x"), F.col("y")), 9))
    out = counts.groupBy("label").agg(F.sum("times").alias("n"), F.round(F.sum(F.col("jw") * F.col("times")) / F.sum("times"), 6).alias("mean"))
    deciles = {f"p{k}": k / 100 for k in range(10, 100, 10)}
    q = percentiles(counts, ["label"], "jw", deciles, "times")
    return side_by_side(out, q, ["label"]).select("label", "n", "mean", *[F.round(c, 6).alias(c) for c in deciles])
