"""Mixing by soft membership: document rates that bring expected domain totals to target weights (operator 4).

A labelled table names domains for some documents. A classifier (softmax regression over text statistics and over
counts of each domain's typical words) is fitted on a bounded sample of them and gives every document a posterior over
the domains. Rates r >= 0 of the documents then minimise

    sum_k (M_k - T_k)^2 / (B^2 s_k)  +  ridge * sum_d (t_d / B) (r_d - 1)^2,     M_k = sum_d r_d t_d p_dk,

where t_d is the document's token count, B the total, s_k the domain's present share and T_k the target total: the
expected token totals match the targets while rates stay near 1. Projected gradient steps are distributed: the state of
a document is a fold of its own posterior over the gradients so far, one number per domain and step, so an iteration is
one aggregation over a small table and nothing per document is kept between iterations or reaches the driver.

Where documents can only be kept or dropped (``fit_shares``, used by ``resample``), rates lie in [0, 1] and the totals follow the
main domain, that of the largest target: T_k = T_main's present total * target_k / target_main. Domains with more than that are
thinned to it; those with less, and the main one, are held at their present totals, so their documents stay.

Edge cases: null and empty texts have no tokens and rate 1. Labels that are null are ignored; an id with several labels
counts once with the smallest. A domain without labelled documents gets posterior 0 and no target. With no labels at all
every rate is 1. Repeated rows get equal rates. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workboard.llm.packing import word_count
from workboard.llm.store import cut
from workboard.llm.textstats import PUNCTUATION, STATS, with_stats

#: Bound of the labelled sample. Its words are counted in Spark; a row of numbers for each document and the words of
#: the lexicons reach the driver.
MAX_LABELLED = 6_000
LEXICON_WORDS = 300
#: A word is typical of a domain if the G statistic of its document counts is above this.
LEAST_G = 25.0
STEPS = 25
RIDGE = 1e-3
TOLERANCE = 1e-4
#: Weight of keeping the held domains whole, against the targets of the others.
HOLD = 0.25


@dataclass
class Domains:
    """Softmax model of the domains: ``weights`` has a row per domain over the scaled inputs and a bias."""
    names: list[str]
    lexicons: list
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def posterior(self, stats: np.ndarray) -> np.ndarray:
        """Posteriors of the domains for rows of STATS and lexicon counts."""
        x = stats.copy()
        x[:, len(STATS):] = np.log1p(x[:, len(STATS):])
        margin = ((x - self.mean) / self.scale) @ self.weights[:, :-1].T + self.weights[:, -1]
        e = np.exp(margin - margin.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def _lexicons(sample: DataFrame, names: list[str]) -> list:
    """For each domain the words whose share of its documents exceeds that of the others the most surely (G test).

    ``sample`` (__y, __text). Words are cut and lower-cased as ``with_stats`` does.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    plain = F.translate("__text", upper + PUNCTUATION, lower + " " * len(PUNCTUATION))
    split = F.array_distinct(F.split(plain, "[\\x20\\x09-\\x0D]+"))
    words = sample.select("__y", F.explode(split).alias("word")).where("word <> ''")
    sizes = {r["__y"]: r["n"] for r in sample.groupBy("__y").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    counts = cut(words.groupBy("word").agg(
        F.count("*").alias("n"), *[F.count_if(F.col("__y") == n).alias(f"c{i}") for i, n in enumerate(names)])
        .where("n >= 4"), "words")
    out = []
    for i, n in enumerate(names):
        c, all_of = F.col(f"c{i}"), F.col("n")
        expected = all_of * (sizes.get(n, 0) / max(1, total))
        rest = all_of - c
        of_rest = F.when(rest > 0, rest * F.log(F.try_divide(rest, all_of - expected))).otherwise(0.0)
        g = 2 * (c * F.log(F.try_divide(c, expected)) + of_rest)
        best = (counts.where((c >= 4) & (c > 2 * expected)).withColumn("g", g).where(F.col("g") > LEAST_G)
                .orderBy(F.col("g").desc(), "word").limit(LEXICON_WORDS).select("word").collect())
        out.append(frozenset(r["word"].encode() for r in best))
    return out


def _softmax(x: np.ndarray, y: np.ndarray, k: int, steps: int = 300, decay: float = 1e-4) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    w, v, target = np.zeros((k, x.shape[1])), np.zeros((k, x.shape[1])), np.eye(k)[y]
    step = 1 / (0.5 * np.linalg.norm(x, 2) ** 2 / len(x) + decay)
    for i in range(steps):
        ahead = w + i / (i + 3) * (w - v)
        e = x @ ahead.T
        e = np.exp(e - e.max(axis=1, keepdims=True))
        v, w = w, ahead - step * ((e / e.sum(axis=1, keepdims=True) - target).T @ x / len(x) + decay * ahead)
    return w


def fit_domains(docs: DataFrame, labels: DataFrame, domain: Column, id_col: str = "doc_id", text_col: str = "text",
                max_labelled: int = MAX_LABELLED) -> Domains | None:
    """Fit the classifier on a bounded sample of the labelled documents; ``domain`` is a string over ``labels``."""
    known = (labels.select(F.col(id_col).cast("long").alias("__id"), domain.alias("__y"))
             .where("__id is not null and __y is not null").groupBy("__id").agg(F.min("__y").alias("__y"))
             .orderBy(F.xxhash64("__id"), "__id").limit(max_labelled))
    sample = cut(docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
                 .join(F.broadcast(known), "__id").dropDuplicates(["__id"]), "sample")
    names = [r[0] for r in sample.select("__y").distinct().orderBy("__y").collect()]
    if not names:
        return None
    # half of the sample picks the words, the other half fits the weights
    lexicons = _lexicons(sample.where(F.xxhash64("__id", F.lit(1)) % 2 == 0).select("__y", "__text"), names)
    rows = (with_stats(sample.where(F.xxhash64("__id", F.lit(1)) % 2 != 0), "__text", lexicons)
            .select("__id", "__y", "__stats").orderBy("__id").toArrow())
    width = len(STATS) + len(names)
    x = rows["__stats"].combine_chunks().flatten().to_numpy().reshape(-1, width).copy()
    x[:, len(STATS):] = np.log1p(x[:, len(STATS):])
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(width), np.ones(width))
    y = np.array([names.index(v) for v in rows["__y"].to_pylist()], dtype=int)
    weights = _softmax((x - mean) / scale, y, len(names)) if len(x) else np.zeros((len(names), width + 1))
    return Domains(names, lexicons, mean, scale, weights)


def members(docs: DataFrame, model: Domains, text_col: str = "text", tokens: Column | None = None) -> DataFrame:
    """``docs`` with ``__tokens`` (long) and ``__p`` (array of posteriors, in the order of ``model.names``)."""
    n = word_count(F.col(text_col)) if tokens is None else F.coalesce(tokens.cast("long"), F.lit(0).cast("long"))
    return with_stats(docs.withColumn("__tokens", n), text_col, model.lexicons, model.posterior).withColumnRenamed(
        "__stats", "__p")


def fit_rates(rows: DataFrame, targets: list[float], steps: int = STEPS, ridge: float = RIDGE,
              tolerance: float = TOLERANCE) -> tuple[Column, list[float], list[float]]:
    """Rates for ``rows`` (__tokens, __p): (rate column, totals now, target totals). ``targets`` are weights."""
    k = len(targets)
    p = [F.element_at("__p", i + 1) for i in range(k)]
    t = F.col("__tokens").cast("double")
    now = rows.agg(*[F.coalesce(F.sum(t * x), F.lit(0.0)) for x in p]).first()
    total = float(sum(now))
    one = F.lit(1.0)
    if total <= 0:
        return one, [0.0] * k, [0.0] * k
    share = np.array([x / total for x in now])
    wanted = np.where(share > 0, np.array(targets, dtype=float), 0.0)
    if wanted.sum() <= 0:
        return one, list(now), list(now)
    wanted = wanted / wanted.sum()
    rate, step = one, 0.5 / (1 + ridge)
    totals = share.copy()
    for _ in range(steps):
        gap = np.where(share > 0, (totals - wanted) / np.maximum(share, 1e-12), 0.0)
        if np.abs(totals - wanted).max() <= tolerance * max(wanted.max(), 1e-12):
            break
        pull = F.lit(0.0)
        for x, g in zip(p, gap, strict=True):
            pull = pull + x * F.lit(float(2 * g))
        # the former rate stands once in the new one, so the expression grows by a constant with each step
        rate = F.greatest(F.lit(0.0), rate * F.lit(1 - 2 * ridge * step) + F.lit(2 * ridge * step) - F.lit(step) * pull)
        got = rows.select((t * rate).alias("w"), *[x.alias(f"p{i}") for i, x in enumerate(p)]).agg(
            *[F.sum(F.col("w") * F.col(f"p{i}")) for i in range(k)]).first()
        before, totals = totals, np.array([x / total for x in got])
        if np.abs(totals - before).max() <= tolerance / 10:  # rates are at 0 where more change is wanted
            break
    return (F.when(t > 0, rate).otherwise(one)), [float(x * total) for x in totals], [float(x * total) for x in wanted]


def fit_shares(rows: DataFrame, targets: list[float], steps: int = STEPS, ridge: float = RIDGE, hold: float = HOLD,
               tolerance: float = TOLERANCE) -> tuple[Column, list[float], list[float]]:
    """Rates in [0, 1] for ``rows`` (__tokens, __p): (rate column, shares kept, wanted shares).

    A domain scarcer than its target keeps all; it cannot be raised without repeats or without dropping the main domain.
    """
    k = len(targets)
    p = [F.element_at("__p", i + 1) for i in range(k)]
    t = F.col("__tokens").cast("double")
    now = np.array(rows.agg(*[F.coalesce(F.sum(t * x), F.lit(0.0)) for x in p]).first(), dtype=float)
    total, one = now.sum(), F.lit(1.0)
    share = now / total if total > 0 else now
    wanted = np.where(share > 0, np.array(targets, dtype=float), 0.0)
    if wanted.sum() <= 0:
        return one, share.tolist(), share.tolist()
    wanted = wanted / wanted.sum()
    main = int(np.argmax(wanted))
    held = wanted * share[main] / wanted[main] >= share
    rate, step, kept = one, 0.5 / (1 + ridge), share
    for _ in range(0 if held.all() else steps):
        follow = wanted * kept[main] / wanted[main]
        # documents of the held domains are drawn back to 1 with a small weight, the others to their targets
        gap = np.where(held, hold * (kept - share), kept - follow) / np.maximum(share, 1e-12)
        pull = F.lit(0.0)
        for x, g in zip(p, gap, strict=True):
            pull = pull + x * F.lit(float(2 * g))
        rate = F.least(one, F.greatest(F.lit(0.0), rate * F.lit(1 - 2 * ridge * step) + F.lit(2 * ridge * step)
                                       - F.lit(step) * pull))
        got = rows.select((t * rate).alias("w"), *[x.alias(f"p{i}") for i, x in enumerate(p)]).agg(
            *[F.sum(F.col("w") * F.col(f"p{i}")) for i in range(k)]).first()
        before, kept = kept, np.array(got, dtype=float) / total
        if np.abs(kept - before).max() <= tolerance / 10:
            break
    rest = max(kept.sum(), 1e-300)
    return F.when(t > 0, rate).otherwise(one), (kept / rest).tolist(), wanted.tolist()


def mix(docs: DataFrame, labels: DataFrame, domain: Column, targets: dict[str, float], id_col: str = "doc_id",
        text_col: str = "text", **options) -> DataFrame:
    """(doc_id, n_tokens, domain, posterior, rate) for every row of ``docs``; ``domain`` is the likeliest.

    ``targets`` gives each domain's wanted share of tokens; a domain without an entry gets weight 0.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("__text"))
    model = fit_domains(docs, labels, domain, id_col, text_col, **options)
    if model is None:
        return texts.select("doc_id", word_count(F.col("__text")).alias("n_tokens"),
                            F.lit(None).cast("string").alias("domain"),
                            F.array().cast("array<double>").alias("posterior"), F.lit(1.0).alias("rate"))
    rows = cut(members(texts, model, "__text").select("doc_id", "__tokens", "__p"), "members")
    rate, _, _ = fit_rates(rows, [targets.get(n, 0.0) for n in model.names])
    names = F.array(*[F.lit(n) for n in model.names])
    best = F.array_position("__p", F.array_max("__p")).cast("int")
    return rows.select("doc_id", F.col("__tokens").alias("n_tokens"), F.element_at(names, best).alias("domain"),
                       F.col("__p").alias("posterior"), rate.alias("rate"))


def resample(docs: DataFrame, labels: DataFrame, domain: Column, targets: dict[str, float], id_col: str = "doc_id",
             text_col: str = "text", seed: int = 11, **options) -> DataFrame:
    """``docs`` thinned by rates in [0, 1], columns unchanged: a row stays if rate + u >= 1, u in [0, 1) a hash of its id.

    Rates of 1 always stay; nothing is repeated, so duplicates removed before do not come back. Rows with a null id are
    drawn by a hash of their text.
    """
    model = fit_domains(docs, labels, domain, id_col, text_col, **options)
    if model is None:
        return docs
    columns = docs.columns
    scored = members(docs, model, text_col)
    rows = cut(scored.select("__tokens", "__p"), "members")
    rate, _, _ = fit_shares(rows, [targets.get(n, 0.0) for n in model.names])
    key = F.when(F.col(id_col).isNull(), F.xxhash64(F.col(text_col), F.lit(seed))).otherwise(
        F.xxhash64(F.col(id_col), F.lit(seed)))
    u = F.pmod(key, F.lit(1 << 30)) / F.lit(float(1 << 30))
    return scored.where(rate + u >= 1).select(*columns)
