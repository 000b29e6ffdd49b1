"""Column expressions on scores and metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"[-+]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][-+]?\d+)?"

#: Metrics by category, in order of preference; the first present and numeric one counts.
PRIMARY_METRICS = {
    "prot_domains": ("GDT_TS", "LDDT", "TMscore"),
    "prot_oligo": ("QSglob", "QSbest", "DockQ_Avg", "TMscore", "lDDT"),
    "rna_mono": ("GDT_TS", "lDDT", "LDDT", "TMscore", "RMSD"),
    "rna_oligo": ("QSglob", "QSbest", "lDDT", "DockQ_Avg", "TMscore"),
    "hybrid": ("QSglob", "QSbest", "DockQ_Avg", "lDDT", "TMscore"),
}


def lenient_float(text: Column) -> Column:
    """The first number anywhere in a text; null for blank and N/A."""
    bare = F.trim(text)
    found = F.regexp_extract(bare, NUMBER, 0)
    return F.when((bare == "") | (F.upper(bare) == "N/A") | (found == ""), None).otherwise(found.try_cast("double"))


def float_or(text: Column, default: float) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(default))


def int_or(text: Column, default: int) -> Column:
    """Through double, cut towards zero."""
    return F.coalesce(text.try_cast("double").cast("long"), F.lit(default))


def normalized(metric: Column, score: Column) -> Column:
    """RMSD to 1 / (1 + x); GDT and anything over 1 to a hundredth; all within 0 and 1."""
    name = F.lower(metric)
    unit = lambda x: F.greatest(F.lit(0.0), F.least(x, F.lit(1.0)))
    return F.when(name == "rmsd", 1 / (1 + F.greatest(score, F.lit(0.0)))).when(name.isin("gdt_ts", "gdt-ha", "gdt_ha") | (score > 1), unit(score / 100)).otherwise(unit(score))


def primary(category: Column, metrics: Column, choices: dict[str, tuple[str, ...]] = PRIMARY_METRICS) -> Column:
    """struct(metric, score) of the first metric of the category's list that has a number."""
    lists = F.create_map(*(x for k, v in choices.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    found = F.transform(F.coalesce(F.element_at(lists, category), F.array().cast("array<string>")), lambda m: F.struct(m.alias("metric"), lenient_float(F.element_at(metrics, m)).alias("score")))
    return F.get(F.filter(found, lambda x: x["score"].isNotNull()), 0)


def truthy(text: Column, default: bool) -> Column:
    """1, true, yes and y are true; blank is the default."""
    return F.when(text.isNull() | (F.trim(text) == ""), F.lit(default)).otherwise(F.lower(F.trim(text)).isin("1", "true", "yes", "y"))


def first_present(*columns: Column) -> Column:
    return F.coalesce(*columns)


# fixed values: the weights and penalties of the selector policies below
def confidence_v1(c: dict[str, Column]) -> Column:
    """A weighted blend of confidences; null when there are none."""
    p = F.when(c["plddt"] > 1, c["plddt"] / 100).otherwise(c["plddt"])
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    blend = 0.20 * zero(p) + 0.50 * zero(c["ptm"]) + 0.30 * zero(c["iptm"]) - 0.10 * zero(c["disorder"]) - F.when(c["has_clash"], 0.20).otherwise(0.0)
    return F.when(p.isNotNull() | (zero(c["ptm"]) != 0) | (zero(c["iptm"]) != 0), blend)


def ranking_v1(c: dict[str, Column]) -> Column:
    """The model's own ranking score with penalties, else the blend."""
    r = F.when(c["ranking_score"] > 1, c["ranking_score"] / 100).otherwise(c["ranking_score"])
    own = r - 0.05 * F.coalesce(c["disorder"], F.lit(0.0)) - F.when(c["has_clash"], 0.20).otherwise(0.0)
    return F.when(r.isNotNull(), own).otherwise(confidence_v1(c))


def with_consensus(base: Column, c: dict[str, Column], weights: tuple[float, float, float] = (0.70, 0.20, 0.10)) -> Column:
    b, k, s = weights
    return b * base + k * F.coalesce(c["consensus"], F.lit(0.0)) + s * F.coalesce(c["support"], F.lit(0.0))


#: Selector policies by name.
SELECTORS = {
    "confidence_v1": confidence_v1,
    "diversity_consensus_v1": lambda c: with_consensus(confidence_v1(c), c),
    "ranking_v1": ranking_v1,
    "ranking_consensus_v1": lambda c: with_consensus(ranking_v1(c), c),
}


def seed_count(seeds: Column) -> Column:
    return F.greatest(F.lit(1), F.size(F.filter(F.split(seeds, ","), lambda s: F.trim(s) != "")))


def candidate_count(seeds: Column, sample: Column) -> Column:
    return seed_count(seeds) * F.greatest(F.lit(1), F.coalesce(sample, F.lit(1)))


def budget_tier(candidates: Column, policy: Column, rank_eligible: Column, fixed_budget: Column, *, attack: str = "attack", dev: str = "dev", diagnostic: str = "diagnostic") -> Column:
    """Not eligible: diagnostic; several candidates or a selector: attack; a fixed budget: dev; else diagnostic."""
    chosen = F.coalesce(F.nullif(policy, F.lit("")), F.lit("first_output_only")) != "first_output_only"
    return F.when(~rank_eligible, diagnostic).when((candidates > 1) | chosen, attack).when(fixed_budget, dev).otherwise(diagnostic)


def ladder(*steps: tuple[Column, str | Column], otherwise: str | Column) -> Column:
    """The label of the first condition that holds."""
    return reduce(lambda w, s: w.when(*s), steps[1:], F.when(*steps[0])).otherwise(otherwise) if steps else F.lit(otherwise)
