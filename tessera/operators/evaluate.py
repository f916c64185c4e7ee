"""Quality measures: retrieval metrics, ratios, coverage receipts, partition and identity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def retrieval_metrics(captures: DataFrame, relevant: DataFrame, k: int = 5, depth: int = 10) -> DataFrame:
    """Per case: recall@k, MRR@depth and nDCG@depth of captures (case_id, rank from 1, slug) against relevant (case_id, slug)."""
    rel = relevant.select("case_id", "slug").distinct()
    hits = captures.where(F.col("rank") <= depth).join(rel.withColumn("hit", F.lit(1)), ["case_id", "slug"], "left").groupBy("case_id", "slug").agg(F.min("rank").alias("rank"), F.max("hit").alias("hit"))
    got = hits.where("hit = 1").groupBy("case_id").agg(F.count_if(F.col("rank") <= k).alias("in_k"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(depth)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    n = rel.groupBy("case_id").agg(F.count("*").alias("n")).withColumn("ideal", ideal)
    j = n.join(got, "case_id", "left")
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return j.select("case_id", F.col("n").alias("n_relevant"), F.round(z(F.col("in_k") / F.col("n")), 6).alias("recall_at_k"), F.round(z(1 / F.col("first")), 6).alias("mrr"), F.round(z(F.col("dcg") / F.col("ideal")), 6).alias("ndcg"))


def group_means(metrics: DataFrame, groups: DataFrame, passed: Column) -> DataFrame:
    """Per group of groups (case_id, group): cases, means of the retrieval metrics, and how many cases passed."""
    means = [F.round(F.avg(c), 6).alias(f"mean_{c}") for c in ("recall_at_k", "mrr", "ndcg")]
    return metrics.join(groups.select("case_id", "group").distinct(), "case_id").groupBy("group").agg(F.count("*").alias("cases"), *means, F.count_if(passed).alias("passed"))


def ratios(qa: DataFrame) -> DataFrame:
    """(metric, value, valid): integer ratios; valid needs 0 <= numerator <= denominator and a denominator above zero."""
    ok = (F.col("denominator") > 0) & (F.col("numerator") >= 0) & (F.col("numerator") <= F.col("denominator"))
    return qa.select("metric", F.round(F.try_divide(F.col("numerator").cast("double"), "denominator"), 6).alias("value"), F.coalesce(ok, F.lit(False)).alias("valid"))


def partition_check(items: DataFrame, groups: DataFrame) -> DataFrame:
    """(item_id, problem): items (item_id) in no group or several of groups (group_id, item_id), and group entries that are no item."""
    per = groups.groupBy("item_id").agg(F.count("*").alias("n"))
    j = items.select("item_id").distinct().join(per, "item_id", "left")
    bad = j.select("item_id", F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated").alias("problem")).where("problem is not null")
    return bad.unionByName(groups.select("item_id").distinct().join(items.select("item_id"), "item_id", "left_anti").select("item_id", F.lit("unknown").alias("problem")))


#: Source strengths from weakest to strongest.
STRENGTHS = ["unknown", "quoted", "third_party", "self_report", "observed"]


def strength_rank(c: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, STRENGTHS)), c), F.lit(1))


def weakest(rows: DataFrame, key: str, strength: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min_by(strength, strength_rank(F.col(strength))).alias("weakest"))


def downgraded(current: Column, wanted: Column) -> Column:
    """A strength may only fall: the wanted one if it isn't stronger, else the current one."""
    return F.when(strength_rank(wanted) <= strength_rank(current), wanted).otherwise(current)


def stable_union(rows: DataFrame, key: str, order: str, items: str) -> DataFrame:
    """(key, item, place): distinct items of a key's lists in order of first occurrence, as rows."""
    x = rows.select(key, order, F.posexplode(items).alias("_i", "item")).where("item is not null").groupBy(key, "item").agg(F.min(F.struct(F.col(order), F.col("_i"))).alias("_first"))
    from pyspark.sql import Window

    return x.select(key, "item", F.row_number().over(Window.partitionBy(key).orderBy("_first", "item")).alias("place"))


def receipt(inputs: DataFrame, referenced: DataFrame, excluded: DataFrame) -> DataFrame:
    """One row: inputs, referenced, excluded, covered, evidence recall and coverage of all dispositions (ids in column id)."""
    ids = inputs.select("id").distinct()
    flags = ids.join(referenced.select("id", F.lit(1).alias("r")).distinct(), "id", "left").join(excluded.select("id", F.lit(1).alias("x")).distinct(), "id", "left")
    out = flags.agg(F.count("*").alias("inputs"), F.count("r").alias("referenced"), F.count("x").alias("excluded"), F.count(F.coalesce("r", "x")).alias("covered"), F.count(F.when(F.col("r").isNotNull() & F.col("x").isNotNull(), 1)).alias("both"))
    share = lambda a, b: F.round(F.coalesce(F.try_divide(a.cast("double"), b), F.lit(1.0)), 6)
    return out.withColumn("evidence_recall", share(F.col("referenced"), F.col("inputs") - F.col("excluded") + F.col("both"))).withColumn("disposition_coverage", share(F.col("covered"), F.col("inputs"))).drop("both")


def identities(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check, holds): aggregate identities of one table, all in one pass."""
    row = df.agg(*[c.alias(n) for n, c in checks.items()])
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(F.col(f"`{n}`"), F.lit(False)).alias("holds")) for n in checks])).alias("x")).select("x.*")


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that two splits share; they must have none."""
    return a.select(key).intersect(b.select(key))


def families(observations: DataFrame, record: str = "record_id") -> DataFrame:
    """Distinct independent source families per record, by relation, blanks aside; whether a family is missing and validating evidence is there."""
    name = F.nullif(F.btrim("source_family"), F.lit(""))
    of = lambda r: F.count_distinct(F.when(F.col("relation") == r, name))
    return observations.groupBy(record).agg(
        of("supports").alias("supporting"), of("contradicts").alias("contradicting"), F.bool_or(name.isNull()).alias("missing_family"),
        F.bool_or(F.coalesce((F.col("relation") == "supports") & F.col("evidence_kind").isin("repeated_test", "high_quality_evidence"), F.lit(False))).alias("validating"),
    )
