"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics (operator 8).

Boosted trees are grown on the statistics of a bounded sample of labelled documents. Every path of every tree becomes
a conjunctive rule (a box in the space of statistics); a logistic regression with an L1 penalty weighs the rules and
drops most of them; the rest is compiled into one Spark column expression. Scoring is a map over all documents: no
shuffle and nothing on the driver.

Labels are learnt only from rows with crc32(id as text) % 4 <> 2; those are held out. The label table, the
language, the source and the id are no inputs of the score. The sample is the MAX_LABELLED labelled rows with the
smallest hash of the id, so it is the same whatever the partitioning.

Edge cases: null and empty texts have zero statistics and are scored by the same rules. Labels that are null or
neither 0 nor 1 are ignored; an id with several labels counts once, with the lowest. With no label, or with one class
only, the score is the constant (ones + 1) / (labels + 2), the same for all. Repeated rows get equal scores. A null id
is scored and counts as not held out. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workboard.llm.textstats import STATS, stat_columns, with_stats
from workboard.llm.trees import boost, paths

#: Bound of the training sample, which is all that reaches the driver (16 numbers a row).
MAX_LABELLED = 20_000
ROUNDS = 40
DEPTH = 3
PENALTY = 2e-4
THRESHOLD = 0.7


@dataclass
class Rules:
    """Logistic model over conjunctions of (statistic, is_low, threshold)."""
    bias: float
    rules: list[tuple] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    fitted: bool = False

    def column(self, stats: Column | None = None) -> Column:
        """The score over the statistics ``stats`` (by default the column that :func:`with_stats` adds)."""
        x = stat_columns(stats)
        margin = F.lit(float(self.bias))
        for rule, weight in zip(self.rules, self.weights, strict=True):
            test = None
            for f, low, t in rule:
                part = x[f] <= F.lit(float(t)) if low else x[f] > F.lit(float(t))
                test = part if test is None else test & part
            margin = margin + F.when(test, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))

    def describe(self) -> list[str]:
        return [f"{w:+.3f}  " + " and ".join(f"{STATS[f]} {'<=' if low else '>'} {t:.4g}" for f, low, t in r)
                for r, w in sorted(zip(self.rules, self.weights, strict=True), key=lambda x: -abs(x[1]))]


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _holds(rule: tuple, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, low, t in rule:
        out &= x[:, f] <= t if low else x[:, f] > t
    return out


def _lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty on all weights but the bias, by accelerated proximal gradient."""
    n = len(y)
    mean = float(y.mean())
    bias, w = float(np.log((mean + 1e-6) / (1 - mean + 1e-6))), np.zeros(z.shape[1], np.float32)
    # the largest eigenvalue of z'z / n bounds the curvature; a few power steps find it
    v = np.ones(z.shape[1], np.float32)
    for _ in range(20):
        v = z.T @ (z @ v)
        v /= np.linalg.norm(v) + np.float32(1e-12)
    step = float(1 / (0.25 * (np.linalg.norm(z @ v) ** 2 / n + 1) + 1e-6))
    wa, ba, k = w, bias, 1.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-(z @ wa + np.float32(ba)))) - y  # float32 throughout: no wider copy of z is made
        new = wa - np.float32(step) * (z.T @ r) / np.float32(n)
        new = np.sign(new) * np.maximum(np.abs(new) - np.float32(step * penalty), np.float32(0))
        b = ba - step * float(r.mean())
        nk = (1 + np.sqrt(1 + 4 * k * k)) / 2
        ahead = (k - 1) / nk
        wa, ba = new + np.float32(ahead) * (new - w), b + ahead * (b - bias)
        w, bias, k = new, b, nk
    return bias, w


def fit_rules(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH,
              penalty: float = PENALTY) -> Rules:
    """Rules from a bounded table of statistics ``x`` and labels ``y`` (0 / 1)."""
    if len(y) == 0 or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return Rules(float(np.log(p / (1 - p))))
    _, trees = boost(x, y, rounds=rounds, depth=depth, rate=0.5, share=0.5)
    rules, z, seen = [], [], set()
    for rule in dict.fromkeys(p for t in trees for p in paths(t)):
        hit = _holds(rule, x)
        if (key := hash(hit.tobytes())) not in seen and 0 < hit.sum() < len(y):
            seen.add(key)
            rules.append(rule)
            z.append(hit)
    if not rules:
        return Rules(float(np.log((y.mean()) / (1 - y.mean()))), fitted=True)
    table = np.empty((len(y), len(z)), np.float32)
    for i, hit in enumerate(z):
        table[:, i] = hit
    bias, w = _lasso(table, y.astype(np.float32), penalty)
    keep = np.flatnonzero(np.abs(w) > 1e-4)
    return Rules(float(bias), [rules[i] for i in keep], [float(w[i]) for i in keep], True)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> Rules:
    """Learn rules from the labelled documents that are not held out."""
    known = (labels.select(F.col(id_col).cast("long").alias("__id"), F.col(label_col).cast("int").alias("__y"))
             .where(F.col("__id").isNotNull() & F.col("__y").isin(0, 1) & ~held_out(F.col("__id")))
             .groupBy("__id").agg(F.min("__y").alias("__y"))
             .orderBy(F.xxhash64("__id"), "__id").limit(max_labelled))
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    seen = with_stats(texts.join(F.broadcast(known), "__id"), "__text")
    rows = seen.groupBy("__id").agg(F.min("__y").alias("y"), F.min("__stats").alias("s")).orderBy("__id").toArrow()
    x = rows["s"].combine_chunks().flatten().to_numpy().reshape(-1, len(STATS))
    return fit_rules(x, rows["y"].to_numpy().astype(float))


def score(docs: DataFrame, rules: Rules, text_col: str = "text") -> DataFrame:
    """``docs`` with ``__score``, in one map."""
    return with_stats(docs, text_col).withColumn("__score", rules.column()).drop("__stats")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "quality", threshold: float = THRESHOLD,
             max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    rules = fit(docs, labels, id_col, text_col, label_col, max_labelled)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("__text"))
    return score(texts, rules, "__text").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__score").alias("score"),
        (F.col("__score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              label_col: str = "quality", threshold: float = THRESHOLD,
              max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The rows of ``docs`` that are not rejected, columns unchanged; without two classes of labels nothing is."""
    rules = fit(docs, labels, id_col, text_col, label_col, max_labelled)
    if not rules.fitted:
        return docs
    # inside a higher-order function the rules are interpreted once a row: as a plain predicate Spark would write them all into
    # one generated method, which is too long to compile and costs the driver the memory of the attempt
    scored = with_stats(docs, text_col)
    good = F.element_at(F.transform(F.array("__stats"), lambda s: rules.column(s)), 1) >= threshold
    return scored.where(good).drop("__stats")
