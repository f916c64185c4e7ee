"""Runtime retrieval: structured filters, token overlap plus caller scores, and the reason why nothing was found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import lexical_tokens
from tessera.operators.retrieve import stated, top_k


def filters(domains: list[str] | None = None, disposition: str | None = None, subject: str | None = None, year: str | None = None, domain: Column | None = None, active: Column | None = None, domain_scope: Column | None = None) -> Column:
    """Condition on events or evidence. A row without active counts as active; a year is a prefix of the asserted value."""
    cond = F.coalesce(active, F.lit(True)) if active is not None else F.lit(True)
    own = domain if domain is not None else F.col("domain")
    if domains is not None:
        hit = F.coalesce(own.isin(domains), F.lit(False))
        cond = cond & (hit | F.coalesce(F.arrays_overlap(domain_scope, F.array(*map(F.lit, domains))), F.lit(False)) if domain_scope is not None else hit)
    if disposition is not None:
        cond = cond & F.coalesce(F.col("disposition") == disposition, F.lit(False))
    if subject is not None:
        cond = cond & F.coalesce(F.col("subject") == subject, F.lit(False))
    if year is not None:
        cond = cond & F.coalesce(F.col("asserted").startswith(year), F.lit(False))
    return cond


def search(rows: DataFrame, key: str, text: Column, queries: DataFrame, semantic: DataFrame | None = None, limit: int = 10, folded: bool = False) -> DataFrame:
    """Per query the best rows: share of the query's tokens that the row has (1 for an empty query) plus a caller's score, six places; rows with neither are left out."""
    q = stated(queries.select("query_id", lexical_tokens(F.col("query"), folded).alias("_q")))
    scored = rows.select(F.col(key).alias("slug"), lexical_tokens(text, folded).alias("_d")).crossJoin(q)
    share = F.when(F.size("_q") == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect("_q", "_d")).cast("double") / F.greatest(F.size("_q"), F.lit(1)))
    scored = scored.select("query_id", "slug", share.alias("lexical"))
    if semantic is not None:
        scored = scored.join(semantic.select("query_id", "slug", F.col("score").alias("semantic")), ["query_id", "slug"], "left")
    else:
        scored = scored.withColumn("semantic", F.lit(0.0))
    hits = scored.where((F.col("lexical") > 0) | (F.coalesce("semantic", F.lit(0.0)) > 0)).select("query_id", "slug", F.round(F.col("lexical") + F.coalesce("semantic", F.lit(0.0)), 6).alias("score"))
    return top_k(hits, limit)


def answers(queries: DataFrame, hits: DataFrame, coverage: DataFrame, domains: list[str] | None = None) -> DataFrame:
    """(query_id, answer_status, reason): grounded with any hit; else unknown, because the scope is undetermined, a domain isn't extracted, or nothing matches."""
    n = queries.select("query_id").join(hits.groupBy("query_id").count(), "query_id", "left")
    if domains is None:
        reason = F.lit("domain_scope_undetermined")
        return n.select("query_id", F.when(F.col("count") > 0, "grounded").otherwise("unknown").alias("answer_status"), F.when(F.col("count").isNull(), reason).alias("reason"))
    want = queries.sparkSession.createDataFrame([(d,) for d in domains], "domain string")
    gap = want.join(coverage, "domain", "left").agg(F.bool_or(F.coalesce("status", F.lit("not_extracted")) == "not_extracted").alias("gap"))
    both = n.crossJoin(F.broadcast(gap))  # one row
    reason = F.when(F.col("gap"), "domain_not_extracted").otherwise("no_matching_evidence")
    return both.select("query_id", F.when(F.col("count") > 0, "grounded").otherwise("unknown").alias("answer_status"), F.when(F.col("count").isNull(), reason).alias("reason"))
