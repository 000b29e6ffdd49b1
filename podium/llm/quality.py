"""Quality classifier: a sparse ensemble of rules over text statistics.

Boosted shallow trees on the statistics of labelled texts give candidate rules, one for each path from
a root to a node; an L1-penalised logistic regression keeps few of them, and what it keeps is compiled
into one Spark column expression, so that scoring is a projection.

The trees and weights are fitted on at most ``sample`` labelled rows (those whose ids hash lowest);
everything else covers every row. Defined results: null texts count as empty; an id that is labelled
more than once counts with its lowest label; null labels and null ids are not learned from; without
labels of both kinds every score is the share of label 1 (1 if there are no labels).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .language_id import bucket_of


def statistics(text: Column) -> dict[str, Column]:
    """Numbers from 0 up that tell junk from prose, each in one pass over the whole text."""
    text = F.coalesce(text, F.lit(""))
    size = F.greatest(F.length(text), F.lit(1)).cast("double")
    words = F.split(text, " ")
    count = F.greatest(F.size(words), F.lit(1)).cast("double")
    lost = lambda pattern: (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))) / size
    single = lambda c: (F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))) / size
    return {
        "log_size": F.log1p(F.length(text).cast("double")),
        "word_length": size / count,
        "shout": lost("[A-Z]{2,}"),
        "digits": lost("[0-9]+"),
        "symbols": lost(r"[#$%&*@^~<>{}\\|=_+]+"),
        "bars": single("|"),
        "bangs": single("!"),
        "stops": single("."),
        "lines": single("\n"),
        "variety": F.size(F.array_distinct(words)) / count,
    }


class Rules:
    """Conjunctions of (statistic, is at most, bound), with weights."""

    def __init__(self, rules: list[tuple[tuple[str, bool, float], ...]], weights: list[float], base: float):
        self.rules, self.weights, self.base = rules, weights, base

    def column(self) -> Column:
        """Probability of label 1, from columns named as the statistics."""
        logit = F.lit(float(self.base))
        for rule, weight in zip(self.rules, self.weights, strict=True):
            holds = None
            for name, at_most, bound in rule:
                c = F.col(name) <= bound if at_most else F.col(name) > bound
                holds = c if holds is None else holds & c
            logit = logit + F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-logit))


def holds(rule, x: dict[str, np.ndarray]) -> np.ndarray:
    out = None
    for name, at_most, bound in rule:
        c = x[name] <= bound if at_most else x[name] > bound
        out = c if out is None else out & c
    return out


def grow(x: dict[str, np.ndarray], cuts: dict[str, np.ndarray], grad: np.ndarray, hess: np.ndarray, depth: int, rows: np.ndarray, path=()):
    """A regression tree on second-order gradients; yields (path, value, rows, whether it is a leaf) of each node under the root."""
    g, h = grad[rows].sum(), hess[rows].sum()
    value = -g / (h + 1.0)
    if len(path) == depth or len(rows) < 40:
        if path:
            yield path, value, rows, True
        return
    best = (1e-3, None, None)
    for name, at in cuts.items():
        slot = np.searchsorted(at, x[name][rows])
        gl = np.cumsum(np.bincount(slot, grad[rows], len(at) + 1))[:-1]
        hl = np.cumsum(np.bincount(slot, hess[rows], len(at) + 1))[:-1]
        gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
        if len(gain) and gain.max() > best[0]:
            best = (gain.max(), name, float(at[gain.argmax()]))
    if path:
        yield path, value, rows, not best[1]
    if best[1]:
        below = x[best[1]][rows] <= best[2]
        for at_most, part in ((True, rows[below]), (False, rows[~below])):
            yield from grow(x, cuts, grad, hess, depth, part, (*path, (best[1], at_most, best[2])))


def fit(x: dict[str, np.ndarray], y: np.ndarray, *, trees: int = 20, depth: int = 3, rate: float = 0.3, penalty: float = 1e-3, steps: int = 500) -> Rules:
    n = len(y)
    if not n or y.min() == y.max():
        return Rules([], [], 20.0 if not n or y.max() else -20.0)
    cuts = {k: np.unique(np.quantile(v, np.linspace(0.02, 0.98, 49))) for k, v in x.items()}
    logit, found = np.full(n, np.log(y.mean() / (1 - y.mean()))), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-logit))
        for path, value, rows, leaf in grow(x, cuts, p - y, p * (1 - p), depth, np.arange(n)):
            found[path] = True
            if leaf:
                logit[rows] += rate * value
    rules = sorted(found)
    m = np.stack([holds(r, x) for r in rules], axis=1).astype(np.float64)
    spread = m.std(axis=0)
    keep = spread > 0
    rules, m = [r for r, k in zip(rules, keep, strict=True) if k], m[:, keep]
    mean, spread = m.mean(axis=0), spread[keep]
    z = (m - mean) / spread
    # accelerated proximal gradient: logistic loss, L1 on the standardised weights
    step = 4 * n / max(1e-9, np.linalg.norm(z, 2) ** 2)
    w, b, v, vb, t = np.zeros(m.shape[1]), np.log(y.mean() / (1 - y.mean())), np.zeros(m.shape[1]), np.log(y.mean() / (1 - y.mean())), 1.0
    for _ in range(steps):
        err = (1 / (1 + np.exp(-(z @ v + vb))) - y) / n
        new = v - step * (z.T @ err)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        nb = vb - step * err.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t = new, nb, t2
    kept = np.flatnonzero(w)
    scaled = w / spread
    return Rules([rules[i] for i in kept], scaled[kept].tolist(), float(b - (scaled * mean)[kept].sum()))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str, label_col: str, folds: int, sample: int) -> Rules:
    """Rules from at most sample labelled ids whose crc32(id as text) mod folds is not 0.

    Of repeated labels of an id the smallest counts, of repeated documents one text: at most sample rows come to the driver.
    """
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("y is not null").where(bucket_of("id", folds) != 0)
    chosen = own.groupBy("id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample)
    # at most sample rows of an id and a number, whatever the input
    ids = docs.sparkSession.createDataFrame(chosen.collect(), chosen.schema)
    texts = docs.select(F.col(id_col).alias("id"), "text").join(F.broadcast(ids), "id")
    one = texts.groupBy("id").agg(F.min("y").alias("y"), F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    stats = statistics(F.col("text"))
    got = one.select("id", "y", *(c.alias(k) for k, c in stats.items())).toPandas().sort_values(["id", *stats], kind="stable")
    return fit({k: got[k].to_numpy(float) for k in stats}, got["y"].to_numpy(float))


def score(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality", threshold: float = 0.3, folds: int = 5, sample: int = 20_000) -> DataFrame:
    """id, held_out, score (0 to 1), predicted (1 from threshold on)."""
    rules = train(docs, labels, id_col=id_col, label_col=label_col, folds=folds, sample=sample)
    held = F.coalesce(bucket_of(id_col, folds) == 0, F.lit(False))
    used = {name for r in rules.rules for name, _, _ in r}
    stats = {k: c for k, c in statistics(F.col("text")).items() if k in used}
    out = docs.select(F.col(id_col), held.alias("held_out"), *(c.alias(k) for k, c in stats.items()))
    return out.select(id_col, "held_out", rules.column().alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
