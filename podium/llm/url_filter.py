"""URL filters: host and path rules first, and for what no rule fits a logistic regression on hashed n-grams.

The regression reads the characters of host and path in runs of ``N``, each hashed to one of ``DIM`` weights. It is
fitted by accelerated gradient descent, every step one aggregation over a small labelled table, and judges urls by a
column expression: no shuffle, no Python in the tasks.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

N, DIM = 3, 4096


class Rule(NamedTuple):
    """Fits a host and all its subdomains where the path starts with the rule's."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: the rules of the query
RULES = (Rule("com", "/", "allow"), Rule("example.com", "/en/", "block"), Rule("www.example.com", "/en/", "allow"), Rule("net", "/es/", "block"), Rule("net", "/fr/", "block"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A to Z lower-cased) and path of a url; both empty for a null and where there is no ``://``."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substr(url, start + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def ruled(rules: tuple[Rule, ...], host: Column, path: Column) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null; of equal length, the longer host, then block."""
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.name), -len(r.host), r.name, r.verdict != "block")):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        said = F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, said) if out is None else out.when(fits, said)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if out is None else out


def features(host: Column, path: Column) -> Column:
    """Distinct weights that the runs of N characters of ^host$ and ^path$ hash to; of a text too short, none."""

    def runs(kind: str, text: Column) -> Column:
        found = F.regexp_extract_all(F.concat(F.lit("^"), text, F.lit("$")), F.lit(rf"(?s)(?=(.{{{N}}}))"), 1)
        return F.transform(found, lambda g: F.pmod(F.xxhash64(F.lit(kind), g), F.lit(DIM)).cast("int"))

    return F.array_distinct(F.concat(runs("host", host), runs("path", path)))


def chance(weights: list[float], f: str) -> Column:
    """Chance to be blocked: logistic of the bias (the last weight) and the features' weights, as if each row had unit length."""
    table = f"cast(split('{','.join(map(repr, weights))}', ',') AS array<double>)"  # folded to one literal
    return F.expr(f"1 / (1 + exp(-(aggregate({f}, 0D, (a, i) -> a + get({table}, i)) / sqrt(greatest(size({f}), 1)) + get({table}, {DIM}))))")


def fit(rows: DataFrame, *, rounds: int = 30, ridge: float = 1e-4) -> list[float]:
    """DIM weights and a bias from labelled rows (y: 1 to block, f: features), each url to be given once.

    A row of unit length and a bias bound the curvature by 2 / 4, so that a step of 2 can't overshoot. A round brings
    DIM + 1 sums to the driver, whatever the number of rows. Without rows all weights are zero (a chance of 0.5).
    """
    n = rows.count()
    w = [0.0] * (DIM + 1)
    ahead, t = w, 1.0
    for _ in range(rounds if n else 0):
        each = rows.select((chance(ahead, "f") - F.col("y")).alias("off"), "f")
        terms = each.selectExpr("off", "sqrt(greatest(size(f), 1)) AS norm", f"explode(array_append(f, {DIM})) AS i").selectExpr("i", f"CASE WHEN i < {DIM} THEN off / norm ELSE off END AS d")
        slope = [0.0] * (DIM + 1)
        for i, d in terms.groupBy("i").agg({"d": "sum"}).collect():
            slope[i] = d / n
        new = [a - 2 * (s + ridge * a * (i < DIM)) for i, (a, s) in enumerate(zip(ahead, slope, strict=True))]
        later = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead = [b + (t - 1) / later * (b - a) for a, b in zip(w, new, strict=True)]
        w, t = new, later
    return w


def labelled(urls: DataFrame, rules: tuple[Rule, ...], *, url: str = "url", about: int = 2000) -> DataFrame:
    """A small labelled table: distinct urls that a rule decides, about ``about`` of each verdict, by their hash.

    The share of the hashes that is taken follows from an approximate count, so that neither the number of urls nor
    a url in a third of all rows matters.
    """
    host, path = host_and_path(F.col(url))
    known = urls.select(F.col(url).alias("u"), ruled(rules, host, path)["verdict"].alias("v")).where("v is not null")
    counts = {v: max(n, 1) for v, n in known.groupBy("v").agg(F.approx_count_distinct("u").alias("n")).collect()}
    share = lambda v: F.lit(min(1.0, about / counts.get(v, 1)))
    place = F.pmod(F.xxhash64(F.lit("sample"), "u"), F.lit(1 << 20)) / float(1 << 20)
    return known.where(place < F.when(F.col("v") == "block", share("block")).otherwise(share("allow"))).distinct()


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, training: DataFrame | None = None, *, key: str = "page_id", url: str = "url", least: float = 0.5) -> DataFrame:
    """(key, host, path, rule, verdict, score): the verdict of the longest rule that fits, else the regression's.

    training: (u: a url, v: allow or block); without it, urls that the rules decide train the regression. score is the
    chance to be blocked, given where no rule fits; from ``least`` on a url is blocked. Every row is judged, repeated rows each, also
    with a null key. A null url, an empty one and one without ``://`` have an empty host and path and are judged by the bias
    alone. Where nothing is labelled the score is 0.5. Urls are read whole, whatever their length. Other columns of pages are not read.
    """
    scratch = Scratch(pages.sparkSession)
    seen = labelled(pages, rules, url=url) if training is None else training.select("u", "v")
    host, path = host_and_path(F.col("u"))
    rows = seen.select((F.col("v") == "block").cast("double").alias("y"), features(host, path).alias("f"))
    rows = scratch.put(rows, "labelled")
    weights = fit(rows)
    scratch.drop(rows)
    host, path = host_and_path(F.col(url))
    out = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"))
    out = out.withColumn("r", ruled(rules, F.col("host"), F.col("path")))
    out = out.withColumn("f", F.when(F.col("r").isNull(), features(F.col("host"), F.col("path"))))
    out = out.withColumn("score", F.when(F.col("r").isNull(), chance(weights, "f")))
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("score") >= least, "block").otherwise("allow"))
    return out.select(F.col("key").alias(key), "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "score")
