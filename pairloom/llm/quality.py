"""Quality classifier by hierarchical empirical Bayes.

Evidence of a document: log odds that it is bad (of low quality, or toxic) from its
form and from its words, by two models fitted on labelled rows. The form model is a
ridge logistic regression on ratios such as symbols, capitals and repeats a word. The
word model adds up the words and word beginnings that mark toxic texts, each with the
lower bound of its log ratio, so what few rows support counts little.

Site level: over all documents, each path of each host has a number of documents and
the sum of their probabilities. A host's rate is shrunk to the rate of all, a path's
to its host's, with a strength taken from the spread between hosts (method of
moments). The posterior rate of a document's path is the prior of the document, so a
sparse site judges nobody and a large bad one counts against its own.

Defined results: a null or wordless text is of low quality; null hosts and paths are
each a site of their own; repeated rows are scored alike; without labelled rows, or
labels of one kind only, the evidence is 0 and all is kept; texts of any length are
judged whole; marks and ratios that tie keep their texts' order; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.words import ALNUM_LOWER
from pairloom.plans.scratch import Scratch

_TABLE = ALNUM_LOWER.tobytes()
_UPPER = bytes(range(65, 91))
_SYMBOLS = b"#$%&*!|~^=+<>{}[]@\\_"
_DIGITS = b"0123456789"


def form(text: str | None) -> list[float]:
    """Ratios that tell prose from menus, shouting, symbols and repeats, by whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * 9 + [1.0]
    size = len(raw)
    symbols = size - len(raw.translate(None, _SYMBOLS))
    upper = size - len(raw.translate(None, _UPPER))
    digits = size - len(raw.translate(None, _DIGITS))
    bars = words.count(b"|")
    stutter = sum(map(bytes.__eq__, words, words[1:]))
    top = max(Counter(words).values())
    parts = [p for p in raw.replace(b"\n", b". ").split(b". ") if p.strip()]
    again = 1 - len(set(parts)) / len(parts) if parts else 0.0
    return [min(symbols / n, 3.0), min(upper / n, 6.0), min(digits / n, 5.0), min(10 * bars / n, 3.0), 3 * stutter / n, 3 * again, top / n * (n > 20), min(size / n, 20.0) / 10, math.log1p(n) / 5, 0.0]


def marks(text: str | None) -> set[bytes]:
    """Words, and beginnings of four and six bytes, each once."""
    words = set((text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split())
    return words | {b"^" + w[:4] for w in words if len(w) > 4} | {b"^" + w[:6] for w in words if len(w) > 6}


def _expand(x: np.ndarray) -> np.ndarray:
    return np.column_stack((np.ones(len(x)), x, np.sqrt(x), x * x))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Evidence:
    """Log odds of low quality from the form, and of toxicity from the words."""

    weights: np.ndarray
    words: dict[bytes, float]
    base: float  # log odds that a text without any mark is toxic

    @classmethod
    def fit(cls, rows: list[tuple[str | None, int | None, int | None]], least: int = 4, sure: float = 1.0) -> Evidence:
        """rows: text, quality (1 good), toxic (1 toxic)."""
        weights = _form_weights([(form(t), q) for t, q, _ in rows])
        with_toxic = [(t, x) for t, _, x in rows if x is not None]
        total = (sum(x != 1 for _, x in with_toxic), sum(x == 1 for _, x in with_toxic))
        seen = [Counter(), Counter()]
        for t, x in with_toxic:
            seen[x == 1].update(marks(t))
        words = {w: bound for w, n1 in seen[1].items() if n1 >= least and (bound := _bound(n1, seen[0][w], total)) > sure} if all(total) else {}
        return cls(weights, words, _base([(cls._sum(words, t), x == 1) for t, x in with_toxic]) if all(total) else -20.0)

    @staticmethod
    def _sum(words: dict[bytes, float], text: str | None) -> float:
        return sum(words[w] for w in words.keys() & marks(text))

    def low_quality(self, texts: list[str | None]) -> np.ndarray:
        if not np.any(self.weights):
            return np.full(len(texts), -20.0)
        return np.clip(_expand(np.array([form(t) for t in texts]).reshape(len(texts), -1)) @ self.weights, -20, 20)

    def toxic(self, texts: list[str | None]) -> np.ndarray:
        if not self.words:
            return np.full(len(texts), -20.0)
        return np.clip([2 * (self._sum(self.words, t) + self.base) for t in texts], -20, 20)


def _form_weights(rows: list[tuple[list[float], int | None]]) -> np.ndarray:
    """Weights of the form model from (form, quality)."""
    rows = [(x, q) for x, q in rows if q is not None]
    y = np.array([q == 0 for _, q in rows], float)
    if not len(y) or not 0 < y.mean() < 1:
        return np.zeros(3 * len(form("")) + 1)
    return _logistic(_expand(np.array([x for x, _ in rows])), y)


def _bound(n1: int, n0: int, total: tuple[int, int]) -> float:
    """Lower bound of a mark's log ratio, from the numbers of toxic and other texts that have it."""
    a, b = n1 + 0.5, n0 + 0.5
    return math.log(a / (total[1] + 1)) - math.log(b / (total[0] + 1)) - 2 * math.sqrt(1 / a + 1 / b)


def _base(scores: list[tuple[float, bool]]) -> float:
    """The offset at which marked texts are told apart best on the labelled rows: (sum of marks, toxic)."""
    scores = sorted(scores)
    wrong = best = sum(not x for _, x in scores)  # all called toxic
    cut = 0.0
    for k, (s, x) in enumerate(scores):
        wrong += 1 if x else -1
        if wrong < best and (k + 1 == len(scores) or scores[k + 1][0] > s):
            best, cut = wrong, (s + scores[k + 1][0]) / 2 if k + 1 < len(scores) else s + 1
    return -max(cut, 0.5)


def fit_evidence(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = 8000, least: int = 4, sure: float = 1.0) -> Evidence:
    """Evidence models from labelled rows: all of them up to ``max_labelled``, else those first by a hash of the id.

    Texts stay on the cluster: the driver gets ten ratios and one sum a labelled row, and
    the marks that count. A label goes to every row of its id; rows are bounded again then.
    """
    own = Scratch(docs.sparkSession, "labelled")
    chosen = labels.select(F.col("doc_id").alias("__id"), "quality", "toxic").where("__id IS NOT NULL").distinct()
    chosen = chosen.orderBy(F.xxhash64("__id"), "__id", "quality", "toxic").limit(max_labelled)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "__id")
    rows = own.write(rows.select("text", "quality", "toxic", F.struct(F.xxhash64("__id"), F.col("__id"), F.xxhash64("text"), "quality", "toxic").alias("rank")), "rows")
    if rows.count() > max_labelled:
        last = rows.select("rank").orderBy("rank").limit(max_labelled).agg(F.max("rank").alias("last"))
        rows = rows.join(F.broadcast(last)).where("rank <= last").drop("last")

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices_of_rows(batches):
            yield pa.RecordBatch.from_arrays([pa.array([form(t.as_py()) for t in part.column(0)], pa.list_(pa.float64())), part.column(1)], names=["form", "quality"])

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices_of_rows(batches, 20):
            each = [sorted(marks(t.as_py())) for t in part.column(0)]
            toxic = np.repeat(part.column(1).to_numpy(zero_copy_only=False), [len(m) for m in each])
            yield pa.RecordBatch.from_arrays([pa.array([m for e in each for m in e], pa.binary()), pa.array(toxic, pa.int32())], names=["mark", "toxic"])

    order = ["rank"]
    weights = _form_weights([(r["form"], r["quality"]) for r in rows.where("quality IS NOT NULL").orderBy(*order).select("text", "quality").mapInArrow(forms, "form array<double>, quality int").collect()])
    with_toxic = rows.where("toxic IS NOT NULL").select("text", (F.col("toxic") == 1).cast("int").alias("toxic"))
    n = with_toxic.agg(F.sum(1 - F.col("toxic")), F.sum("toxic")).first()
    total = (n[0] or 0, n[1] or 0)
    evidence = Evidence(weights, {}, -20.0)
    if all(total):
        counts = with_toxic.mapInArrow(marked, "mark binary, toxic int").groupBy("mark").agg(F.sum("toxic").alias("n1"), F.sum(1 - F.col("toxic")).alias("n0"))
        a, b = F.col("n1") + 0.5, F.col("n0") + 0.5
        bound = F.log(a / (total[1] + 1)) - F.log(b / (total[0] + 1)) - 2 * F.sqrt(1 / a + 1 / b)
        found = counts.where((F.col("n1") >= least) & (bound > sure - 0.01)).collect()
        evidence.words = {bytes(r["mark"]): v for r in found if (v := _bound(r["n1"], r["n0"], total)) > sure}
        shared = docs.sparkSession.sparkContext.broadcast(evidence.words)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices_of_rows(batches):
                yield pa.RecordBatch.from_arrays([pa.array([Evidence._sum(shared.value, t.as_py()) for t in part.column(0)], pa.float64()), part.column(1)], names=["s", "toxic"])

        evidence.base = _base([(r["s"], r["toxic"] == 1) for r in with_toxic.mapInArrow(sums, "s double, toxic int").collect()])
    own.drop()
    return evidence


def slices_of_rows(batches: Iterator[pa.RecordBatch], rows: int = 200) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def score_documents(docs: DataFrame, evidence: Evidence, host: Column | str = "source", path: Column | str = "lang", text_col: str = "text", strongest: float = 2.0, scratch: Scratch | None = None, keep_text: bool = True) -> DataFrame:
    """``docs`` with low_quality, toxic, host_rate, path_rate, bad (log odds), score (of being good) and keep.

    ``strongest``: most that a site may add to or take from a document's log odds. With
    the texts, or a ``scratch``, the result is not checkpointed and reads tables of the
    scratch, which the caller drops.
    """
    own = scratch or Scratch(docs.sparkSession, "quality")
    news = ["low_quality", "toxic", "host_rate", "path_rate", "bad", "score", "keep"]
    names = [c for c in docs.columns if c not in news and (keep_text or c != text_col)]
    host, path = (F.col(c) if isinstance(c, str) else c for c in (host, path))
    sites_of = [host.cast("string").alias("host"), path.cast("string").alias("path"), F.col(text_col).alias("text")]
    shared = docs.sparkSession.sparkContext.broadcast(evidence)
    wide = docs.select(*[F.col(c).alias(f"p{k}") for k, c in enumerate(names)], *sites_of)
    drop = len(wide.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = shared.value
        for part in slices_of_rows(batches):
            texts = part.column(drop).to_pylist()
            yield pa.RecordBatch.from_arrays([*part.columns[:drop], pa.array(e.low_quality(texts)), pa.array(e.toxic(texts))], names=[*part.schema.names[:drop], "low_quality", "toxic"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wide.schema.fields[:drop])
    # written once with what goes on, so that no text is judged twice
    marked = own.write(wide.mapInArrow(run, f"{fields}, low_quality double, toxic double"), "evidence")
    p = lambda c: 1 / (1 + F.exp(-F.col(c)))
    bad = 1 - (1 - p("low_quality")) * (1 - p("toxic"))
    paths = own.write(marked.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(bad).alias("s")), "paths")
    hosts = own.write(paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs")), "hosts")
    h = hosts.agg(F.count("*").alias("k"), F.sum("hn").alias("n"), F.sum("hs").alias("s"), F.sum(F.col("hs") * F.col("hs") / F.col("hn")).alias("q"), F.sum(F.col("hn") * F.col("hn")).alias("n2")).first()
    rate, strength = _prior(h["k"], h["n"] or 0, h["s"] or 0.0, h["q"] or 0.0, h["n2"] or 0)
    sites = paths.join(hosts, paths["host"].eqNullSafe(hosts["host"])).select(paths["host"], "path", "n", "s", "hn", "hs")
    host_rate = (F.col("hs") + strength * rate) / (F.col("hn") + strength)
    sites = sites.withColumn("host_rate", host_rate).withColumn("path_rate", (F.col("s") + strength * F.col("host_rate")) / (F.col("n") + strength))
    sites = own.write(sites.select("host", "path", "host_rate", "path_rate"), "sites")
    own.drop(paths)
    own.drop(hosts)
    out = marked.join(sites, marked["host"].eqNullSafe(sites["host"]) & marked["path"].eqNullSafe(sites["path"]))
    shift = F.log(F.col("path_rate") / (1 - F.col("path_rate"))) - math.log(rate / (1 - rate))
    shift = F.greatest(F.lit(-strongest), F.least(F.lit(strongest), shift))
    worst = F.greatest("low_quality", "toxic") + F.log1p(F.exp(-F.abs(F.col("low_quality") - F.col("toxic"))))
    out = out.withColumn("bad", worst + shift).withColumn("score", 1 / (1 + F.exp("bad"))).withColumn("keep", F.col("bad") < 0)
    out = out.select(*[F.col(f"p{k}") for k in range(len(names))], *news).toDF(*names, *news)
    return own.finish(out) if scratch is None and not keep_text else out


def _prior(k: int, n: float, s: float, q: float, n2: float) -> tuple[float, float]:
    """Rate of all, and how many documents a prior counts as: from the spread between hosts beyond chance."""
    if not n:
        return 0.5, 1.0
    rate = min(max(s / n, 1e-4), 1 - 1e-4)
    if k < 2:
        return rate, 100.0
    between = q - n * rate * rate  # weighted sum of squares of the hosts' rates
    chance = (k - 1) * rate * (1 - rate)
    spread = max((between - chance) / max(n - n2 / n, 1e-9), rate * (1 - rate) / 1000)
    return rate, max(rate * (1 - rate) / spread - 1, 1.0)


def drop_rejected(docs: DataFrame, labels: DataFrame, host: Column | str = "source", path: Column | str = "lang", id_col: str = "doc_id", text_col: str = "text", max_labelled: int = 8000, scratch: Scratch | None = None) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with the columns that they came with; reads tables of the scratch."""
    evidence = fit_evidence(docs, labels, id_col, text_col, max_labelled)
    names = docs.columns
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])
    host, path = (F.col(f"c{names.index(c)}") if isinstance(c, str) else c for c in (host, path))
    judged = score_documents(plain, evidence, host, path, f"c{names.index(text_col)}", scratch=scratch)
    return judged.where("keep").select(*plain.columns).toDF(*names)


def op4_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score_documents(docs.select("doc_id", "source", "lang", "text"), fit_evidence(docs, labels), keep_text=False)
    return out.select("doc_id", "keep", "score", "low_quality", "toxic", "host_rate", "path_rate")
