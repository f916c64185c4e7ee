"""Routing: whether a query has pages to read, to review, or no explainable match. Only metadata can make a candidate; scores break ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import basename, cjk_ngrams, distinctive, latin_terms, normalize_each, normalize_text
from tessera.operators.retrieve import stated

LATIN_ANCHOR, MODULE_BOOST, DECISION_BOOST = 5, 6.0, 2.0


def profile(text: Column, compatible: bool = True) -> Column:
    """STRUCT of the normalised text, its Latin terms, and its pairs and fours of Han characters."""
    n = normalize_text(text, compatible)
    return F.struct(n.alias("normal"), latin_terms(n).alias("latin"), cjk_ngrams(n, 2).alias("cjk2"), cjk_ngrams(n, 4).alias("cjk4"))


def page_profiles(pages: DataFrame, compatible: bool = True) -> DataFrame:
    """pages with title_text, names (distinctive aliases), title_ok and tokens of title, aliases, tags and slug name."""
    words = F.concat_ws(" ", F.col("title"), F.array_join("aliases", " "), F.array_join("tags", " "), F.replace(basename(F.col("slug")), F.lit("-"), F.lit(" ")))
    out = pages.withColumn("title_text", normalize_text(F.col("title"), compatible)).withColumn("title_ok", distinctive(F.col("title"), compatible)).withColumn("tokens", profile(words, compatible))
    return out.withColumn("names", F.array_distinct(F.filter(normalize_each(F.col("aliases"), compatible), lambda a: distinctive(a, False))))


def signal(text: Column) -> dict[str, Column]:
    """What a text's profile shows about the page of the row."""
    latin, cjk2, cjk4 = (F.array_intersect(text[k], F.col("tokens")[k]) for k in ("latin", "cjk2", "cjk4"))
    title = F.col("title_ok") & F.contains(text["normal"], F.col("title_text"))
    alias = F.exists("names", lambda n: F.contains(text["normal"], n))
    anchors = F.filter(latin, lambda t: F.length(t) >= LATIN_ANCHOR)
    anchor = (F.size(anchors) > 0) | (F.size(cjk4) > 0)
    multi = (F.size(cjk2) >= 2) | (F.size(latin) >= 2)
    weak = (F.size(latin) > 0) | (F.size(cjk2) > 0)
    return {"title": title, "alias": alias, "anchor": anchor, "multi": multi, "weak": weak, "strong": title | alias | anchor | multi, "terms": F.array_distinct(F.concat(anchors, cjk4, cjk2, latin))}


def score_candidates(queries: DataFrame, pages: DataFrame, compatible: bool = True) -> DataFrame:
    """Candidates (query_id, slug, route_score, base_score, strong, weak, match_reasons, match_terms). queries: query_id, query, context, module; pages: page columns and base_score, decision_status, and where known agent_priority, retrieval_evidence, retrieval_rank, metadata_verified.

    A page of one's own records is never strong for a text that rules these out; a page of high priority is strong if it was an exact keyword hit of rank 3 or better, or
    if the text asks for one's own records and the page's metadata are verified for it.
    """
    q = queries.select("query_id", "module", profile(F.col("query"), compatible).alias("q"), profile(F.coalesce("context", F.lit("")), compatible).alias("c"))
    both = page_profiles(pages, compatible).crossJoin(stated(q))
    a, b = signal(F.col("q")), signal(F.col("c"))
    flags = both.select("*", F.concat_ws(" ", "q.normal", "c.normal").alias("_asked"), *[(a[k] | b[k]).alias(f"_{k}") for k in ("title", "alias", "anchor", "multi", "weak", "strong")], b["strong"].alias("_c_strong"), (~a["weak"] & b["weak"]).alias("_c_only"), F.slice(F.array_distinct(F.concat(a["terms"], b["terms"])), 1, 12).alias("match_terms"))
    module = F.coalesce(F.col("module").isNotNull() & F.exists("modules", lambda m: normalize_text(m, False) == normalize_text(F.col("module"), False)), F.lit(False))
    given = lambda c, kind: F.col(c) if c in pages.columns else F.lit(None).cast(kind)
    met = F.col("_strong") | F.col("_weak")
    personal = F.exists(F.concat(F.coalesce("modules", F.array().cast("array<string>")), F.coalesce("tags", F.array().cast("array<string>"))), lambda m: normalize_text(m, False) == "personal context")
    excluding = excludes_personal_context(F.col("_asked"))
    excluded = excluding & personal
    high = F.coalesce(given("agent_priority", "string") == "high", F.lit(False))
    rank = given("retrieval_rank", "int")
    keyword = ~excluded & met & high & F.coalesce((given("retrieval_evidence", "string") == "keyword_exact") & (F.col("base_score") >= 0.9) & (rank <= 3), F.lit(False))
    own = ~excluding & met & high & F.coalesce((rank >= 1) & (rank <= 3) & given("metadata_verified", "boolean"), F.lit(False)) & asks_for_personal_context(F.col("_asked"))
    strong = ~excluded & (F.col("_strong") | keyword | own)
    weak = strong | met
    only_weak = ~strong & weak
    context = F.col("_c_strong") | F.col("_c_only")
    active = weak & (F.col("type") == "decision") & (F.coalesce("decision_status", F.lit("")) == "active")
    base = F.coalesce("base_score", F.lit(0.0))
    #: What each reason counts.
    points = [(excluded, 0.0, "personal_context_explicitly_excluded"), (F.col("_title"), 100.0, "exact_title_match"), (F.col("_alias"), 95.0, "exact_alias_match"), (F.col("_anchor"), 70.0, "unique_anchor_match"), (F.col("_multi"), 55.0, "multi_term_metadata_match"), (keyword, 45.0, "high_priority_keyword_match"), (own, 45.0, "high_priority_personal_metadata_match"), (only_weak, 20.0, "weak_metadata_match"),
              (context, F.when(F.col("_c_strong"), 4.0).otherwise(1.0), "context_metadata_match"), (weak & module, MODULE_BOOST, "module_boost"), (active, DECISION_BOOST, "active_decision_boost")]
    total = sum((F.when(cond, v).otherwise(0.0) for cond, v, _ in points), F.lit(0.0)) + F.greatest(F.lit(0.0), F.least(F.lit(1.0), base))
    reasons = F.array_compact(F.array(*[F.when(cond, F.lit(r)) for cond, _, r in points]))
    return flags.select("query_id", "slug", F.round(total, 4).alias("route_score"), F.round(base, 4).alias("base_score"), strong.alias("strong"), weak.alias("weak"), reasons.alias("match_reasons"), "match_terms").where("weak")


def route(queries: DataFrame, candidates: DataFrame, limit: int = 5, available: bool = True) -> DataFrame:
    """Per query: action read / review / none, reason codes and the chosen slugs in order of score; none for all while retrieval is unavailable."""
    if not available:
        return queries.select("query_id", F.lit("none").alias("action"), F.array(F.lit("retrieval_unavailable")).alias("reason_codes"), F.array().cast("array<string>").alias("slugs"))
    order = Window.partitionBy("query_id", "strong").orderBy(F.desc("route_score"), F.desc("base_score"), F.asc("slug"))
    best = candidates.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit)
    picked = best.groupBy("query_id").agg(
        F.bool_or("strong").alias("any_strong"),
        F.sort_array(F.collect_list(F.when(F.col("strong"), F.struct("n", "slug", "match_reasons")))).alias("s"),
        F.sort_array(F.collect_list(F.when(~F.col("strong"), F.struct("n", "slug", "match_reasons")))).alias("w"),
    )  # fmt: skip  # at most `limit` rows of each kind
    shown = F.when(F.col("any_strong"), F.col("s")).otherwise(F.col("w"))
    out = queries.select("query_id").join(picked, "query_id", "left")
    return out.select(
        "query_id", F.when(F.col("any_strong"), "read").when(F.size("w") > 0, "review").otherwise("none").alias("action"),
        F.coalesce(F.array_distinct(F.flatten(F.transform(shown, lambda x: x["match_reasons"]))), F.array(F.lit("no_explainable_match"))).alias("reason_codes"),
        F.coalesce(F.transform(shown, lambda x: x["slug"]), F.array().cast("array<string>")).alias("slugs"),
    )


def metadata_matches(queries: DataFrame, pages: DataFrame, compatible: bool = True) -> DataFrame:
    """Metadata-only score per query and page: title 8, aliases 7, tags 4, slug 3 per shared term, three times for terms of four characters or more; with rank, ties, and whether title or aliases match."""
    q = stated(queries.select("query_id", profile(F.col("query"), compatible).alias("q")))
    fields = [("title", F.col("title"), 8), ("aliases", F.array_join("aliases", " "), 7), ("tags", F.array_join("tags", " "), 4), ("slug", F.replace(basename(F.col("slug")), F.lit("-"), F.lit(" ")), 3)]
    p = pages.select("slug", *[profile(c, compatible).alias(f"p_{n}") for n, c, _ in fields])
    both = p.crossJoin(q)
    parts, named = [], F.lit(False)
    for n, _, w in fields:
        terms = F.array_distinct(F.concat(*[F.array_intersect(F.col("q")[k], F.col(f"p_{n}")[k]) for k in ("cjk4", "cjk2", "latin")]))
        named = named | (F.size(terms) > 0) if n in ("title", "aliases") else named
        parts.append(F.lit(w) * F.aggregate(terms, F.lit(0), lambda s, t: s + F.when(F.length(t) >= 4, 3).otherwise(1)))
    scored = both.select("query_id", "slug", sum(parts[1:], parts[0]).alias("score"), named.alias("named")).where("score > 0")
    return scored.withColumn("rank", F.rank().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).withColumn("ties", F.count("*").over(Window.partitionBy("query_id", "score")))


def verified_metadata(matches: DataFrame) -> DataFrame:
    """(query_id, slug) of pages that alone have the first rank among all pages and match by title or alias."""
    return matches.where((F.col("rank") == 1) & (F.col("ties") == 1) & F.col("named")).select("query_id", "slug")


#: Phrases that ask for one's own records, and phrases that rule them out, in Chinese and English.
ASKS = ["(?:根据|结合|参考|对照|回顾|梳理|利用|基于)\\s*(?:一下\\s*)?(?:我|我们)(?:的|已有|之前|过去|当前)", "\\b(?:based on|using|given|consider|review)\\s+(?:my|our)\\b"]
EXCLUDES = ["(?:不要|不需要|无需|不用|勿|别|不必|不想|不能)\\s*.{0,12}?(?:根据|基于|参考|结合|利用|对照|回顾|梳理|使用|用)\\s*.{0,8}?(?:我|我们)", "\\b(?:without|do not|don t|dont|never|no need to)\\b(?:\\s+[a-z]+){0,8}\\s+(?:my|our)\\b"]


def _any(text: Column, patterns: list[str]) -> Column:
    return text.rlike("|".join(f"(?:{p})" for p in patterns))


def asks_for_personal_context(text: Column) -> Column:
    """Whether a normalised text asks to use one's own records."""
    return _any(text, ASKS)


def excludes_personal_context(text: Column) -> Column:
    return _any(text, EXCLUDES)
