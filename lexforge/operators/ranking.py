"""Ranking of symbols and filling of token budgets."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.profiles import type_importance
from ..functions.text import at_least, ceil_div, split_words, units
from ..sources import jvm

SOURCE = Path(__file__).parent / "symbols.java"

#: Weights of the factors, in the order that breaks ties.
FACTORS = (("visibility", 0.15), ("callFrequency", 0.10), ("centrality", 0.20), ("typeImportance", 0.20), ("complexity", 0.05), ("taskRelevance", 0.30))
WEIGHT = dict(FACTORS)


def relevance(name: Column, body: Column, prompt: str | None) -> Column:
    """For each prompt word 0.5 if the name holds it, else 0.1 if the body does."""
    total = F.lit(0.0)
    low_name, low_body = F.lower(name), F.lower(body)
    for w in split_words(prompt or ""):
        total = total + F.when(low_name.contains(w), F.lit(0.5)).when(low_body.contains(w), F.lit(0.1)).otherwise(F.lit(0.0))
    return total


def rank(symbols: DataFrame, threshold: Column | float, prompt: str | None = None, page_rank: Column | None = None) -> DataFrame:
    """symbols with factor columns f_*, rank, keep_body and reason. Order: rank descending, then ordinal."""
    c = F.col
    visible = F.when(c("is_exported"), 1.0).when(c("visibility") == "public", 0.7).otherwise(0.3)
    raw = {
        "visibility": visible,
        "callFrequency": c("call_count") / F.greatest(F.lit(1), F.coalesce(c("dependents"), F.lit(0)) + 1),
        "centrality": F.coalesce(page_rank, F.lit(0.0)) if page_rank is not None else F.lit(0.0),
        "typeImportance": type_importance(c("type")) / F.lit(10.0),
        "complexity": F.least(F.lit(1.0), c("complexity") / F.lit(20.0)),
        "taskRelevance": relevance(c("name"), c("full_source"), prompt),
    }
    df = symbols.withColumns({f"f_{k}": raw[k] * F.lit(w) * F.lit(100) for k, w in FACTORS})
    total = F.lit(0.0)
    for k, _ in FACTORS:
        total = total + c(f"f_{k}")
    df = df.withColumn("rank", total)
    top = F.array_max(F.array(*[F.struct(c(f"f_{k}").alias("v"), F.lit(-i).alias("i"), F.lit(k).alias("k")) for i, (k, _) in enumerate(FACTORS)]))
    limit = F.lit(threshold) if isinstance(threshold, float) else threshold
    df = df.withColumns({"keep_body": c("rank") / 100 >= limit, "top": top})
    whole = lambda x: F.floor(x + 0.5).cast("long")
    reason = F.format_string("rank %d/100 — %s dominant (%d)", whole(c("rank")), c("top.k"), whole(c("top.v")))
    return df.withColumn("reason", reason).drop("top")


def filled(ranked: DataFrame, budget: Column | int, by: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """(by..., left_over, position, ordinal, form) as fill() finds them. Costs are sorted by group and rank and gone through once; of a group, form and ordinal alone are held."""
    keys = list(by)
    budget = F.lit(budget).cast("long") if isinstance(budget, int) else budget.cast("long")
    costs = ranked.select(
        *keys, F.col("ordinal").cast("long").alias("ordinal"), "keep_body", at_least(F.col("full_source"), 5).alias("body"), at_least(F.col("signature"), 2).alias("sig"), budget.alias("budget"), (-F.col("rank")).alias("r")
    ).repartition(*keys).sortWithinPartitions(*keys, "r", "ordinal", "keep_body", "body", "sig").drop("r")
    named = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in costs.select(*keys).schema)
    return jvm.over_partitions(costs, jvm.made(ranked.sparkSession, SOURCE, "lexforge.symbols.Fill", len(keys)), f"{named}, left_over long, position int, ordinal long, form string")


def fill(ranked: DataFrame, budget: Column | int, by: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """Goes through each group's symbols in rank order: takes a body, or if it doesn't fit the signature, or else skips. Gives
    the symbols' columns with `position`, `form` (body, signature, excluded) and `left_over`. The symbols are joined again by their ordinal."""
    return ranked.join(filled(ranked, budget, by), [*by, "ordinal"])


def context_fill(scored: DataFrame, budget: int, by: tuple[str, ...] = ("file_id",), least: int = 50) -> DataFrame:
    """Symbols (score, ordinal, full_source) that fit in order of score: too large ones are skipped, and nothing is taken once less
    than `least` is left. Gives (by..., ordinal, position)."""
    keys = list(by)
    item = F.struct((-F.col("score")).alias("s"), "ordinal", ceil_div(units(F.col("full_source")), 3.5).cast("long").alias("cost"))
    seen = scored.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("items"))
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.lit(False).alias("stop"), F.array().cast("array<bigint>").alias("out"))

    def step(acc, e):
        take = ~acc["stop"] & (e["cost"] <= acc["left"])
        left = acc["left"] - F.when(take, e["cost"]).otherwise(F.lit(0).cast("long"))
        return F.struct(left.alias("left"), (acc["stop"] | (left < least)).alias("stop"), F.when(take, F.concat(acc["out"], F.array(e["ordinal"].cast("long")))).otherwise(acc["out"]).alias("out"))

    done = seen.select(*keys, F.aggregate("items", start, step).alias("acc"))
    return done.select(*keys, F.posexplode("acc.out").alias("position", "ordinal"))
