"""Mixing sources to target weights.

Weights come from temperature mixing: with natural token shares s and target shares t, w is proportional to t^(1-a) * s^a. Exponent 0 is the
target, 1 the corpus as it is. At a stated budget of tokens (CORPUS: as many as the sources with a target have) the least exponent is bisected at which no source must be
repeated more often than its cap. Without a budget the mix is the largest that meets all targets as they are; there the exponent is 0 by definition.
With an evenness instead of targets, plain s^a is bisected to that share of the greatest entropy.

Weights are realised as budgeted block permutations: a source's documents fall into hash blocks, whole passes take every block, and the last pass takes blocks
in permuted order until the budget is met, then documents within the one block on the border. The number of blocks follows from the largest source's documents, so
that a block has about BLOCK_DOCS of them at any size; prefix sums run over blocks and over the documents of one block per source.

Defined cases: sources without documents or tokens can't contribute: their share is reported as 0 and the others' targets are renormalised; documents of
sources without a target, with a null source or without tokens aren't taken; a null cap counts as 1, a null target as 0; repeated rows of a source in mix_targets add up
their shares and take the lowest cap; repeated documents are documents of their own; an empty table gives an empty mix and a report of zeros.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.common import BROADCAST_BYTES, stage
from tessera.llm.tokens import TOKENIZERS, token_counts

BLOCKS, BLOCK_DOCS = 512, 65_536
#: Sources that mix_targets may name; more are refused.
MOST_SOURCES = 100_000
CORPUS = "corpus"


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def tempered(natural: list[float], exponent: float, target: list[float] | None = None) -> list[float]:
    """Normalised s^a, or t^(1-a) * s^a with targets."""
    raw = [(t ** (1 - exponent) if t > 0 else 0.0) * s**exponent if s > 0 else 0.0 for s, t in zip(natural, target or [1.0] * len(natural))]
    return [x / sum(raw) for x in raw] if sum(raw) > 0 else raw


def bisect(ok, lo: float = 0.0, hi: float = 1.0, steps: int = 60) -> float:
    """Least exponent in [lo, hi] at which ok holds, for ok that stays true once true; hi where it never holds."""
    if ok(lo):
        return lo
    for _ in range(steps):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if ok(mid) else (mid, hi)
    return hi


def exponent_for_entropy(natural: list[float], goal: float) -> float:
    """Exponent of s^a whose weights have the entropy `goal` (entropy falls as the exponent grows from 0)."""
    return bisect(lambda a: entropy(tempered(natural, a)) <= goal, 0.0, 8.0)


def plan(tokens: dict[str, int], target: dict[str, float], caps: dict[str, int], budget: float | str | None = None, evenness: float | None = None) -> tuple[dict[str, float], float, float]:
    """(weights, exponent, budget) of the sources that have tokens and a target. A budget that no weights of the family can meet is lowered until the caps hold."""
    names = sorted(n for n in target if tokens.get(n, 0) > 0 and (target[n] > 0 or evenness is not None))
    if not names:
        return {}, 0.0, 0
    total, sum_t = sum(tokens[n] for n in names), sum(target[n] for n in names)
    s = [tokens[n] / total for n in names]
    most = [caps[n] * tokens[n] for n in names]
    if budget == CORPUS:
        budget = total
    if evenness is not None:
        a = exponent_for_entropy(s, evenness * math.log(len(names))) if len(names) > 1 else 0.0
        weights = tempered(s, a)
    else:
        t = [target[n] / sum_t for n in names]
        if budget is None:
            budget = min(m / w for m, w in zip(most, t))
        a = bisect(lambda x: all(w * budget <= m * (1 + 1e-12) for w, m in zip(tempered(s, x, t), most)))
        weights = tempered(s, a, t)
    budget = min([m / w for m, w in zip(most, weights)] + ([] if budget is None else [budget]))
    return dict(zip(names, weights)), a, budget


def mix(docs: DataFrame, targets: DataFrame, budget: float | str | None = None, seed: int = 1, folder: str = TOKENIZERS, evenness: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(taken, report): taken has (doc_id, source, n_tokens, repeats), report the shares (source, target_share, weight, actual_share, ...).

    The targets are a table of at most MOST_SOURCES rows; its planned weights are the only thing that passes through the driver.
    """
    spark = docs.sparkSession
    goals = targets.where("source is not null").groupBy("source").agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.min(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    goal_rows = goals.limit(MOST_SOURCES + 1).collect()
    if len(goal_rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    goals = spark.createDataFrame(goal_rows, goals.schema)
    named = docs.select("doc_id", "source", "text").join(F.broadcast(goals.select("source")), "source", "left_semi")  # at most MOST_SOURCES rows
    sized = stage(token_counts(named, ["doc_id", "source"], folder).where("n_tokens > 0"), "sized")
    largest = max([r["n"] for r in sized.groupBy("source").agg(F.count("*").alias("n")).collect()], default=0)  # one row per source
    n_blocks = max(BLOCKS, -(-largest // BLOCK_DOCS))
    sized = sized.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(n_blocks)).cast("long"))
    blocks = stage(sized.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens")), "blocks")
    per_source = {r["source"]: r["tokens"] for r in blocks.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}  # one row per source
    weights, exponent, total = plan(per_source, {r["source"]: r["target_share"] for r in goal_rows}, {r["source"]: r["max_repeats"] for r in goal_rows}, budget, evenness)
    planned = spark.createDataFrame([(n, float(w), int(w * total // per_source[n]), float(w * total % per_source[n])) for n, w in weights.items()], "source string, weight double, passes int, rest double")
    planned = F.broadcast(planned)  # at most MOST_SOURCES rows
    order = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 1), "block"), "block")
    ahead = blocks.join(planned, "source").withColumn("before", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    ahead = ahead.withColumn("before", F.coalesce("before", F.lit(0))).select("source", "block", "passes", "rest", "before", (F.col("before") + F.col("tokens")).alias("upto"))
    small = blocks.count() * 64 <= BROADCAST_BYTES
    placed = sized.join(F.broadcast(ahead) if small else ahead, ["source", "block"])
    whole = placed.where("upto <= rest or before >= rest").withColumn("extra", F.when(F.col("upto") <= F.col("rest"), 1).otherwise(0))
    inner = Window.partitionBy("source", "block").orderBy(F.xxhash64(F.lit(seed + 2), "doc_id"), "doc_id")
    edge = placed.where("upto > rest and before < rest").withColumn("upto", F.col("before") + F.sum("n_tokens").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    edge = edge.withColumn("extra", F.when(F.col("upto") <= F.col("rest"), 1).otherwise(0))
    taken = whole.unionByName(edge).select("doc_id", "source", "n_tokens", (F.col("passes") + F.col("extra")).cast("int").alias("repeats")).where("repeats > 0")
    sums = taken.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("documents"), F.max("repeats").alias("most_repeats"))
    all_tokens = F.sum("tokens").over(Window.partitionBy(F.lit(1)))  # over one row per source
    report = goals.join(sums, "source", "left").join(planned.select("source", "weight"), "source", "left").select(
        "source", "target_share", F.coalesce("weight", F.lit(0.0)).alias("weight"), "max_repeats", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), F.coalesce(F.try_divide(F.col("tokens").cast("double"), all_tokens), F.lit(0.0)).alias("actual_share"), F.lit(exponent).alias("exponent"),
    )
    return taken, report
