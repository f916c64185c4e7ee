"""Ranking of pages for many queries at once: lexical, keyword and vector arms, fused at page grain.

Queries are a stated, small set: they are broadcast behind a check of their size and meet the corpus block by block as it is scanned, so the corpus is
read once and only hits are shuffled. Scope is filtered before any ranking or limit.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import cjk_ngrams, latin_terms, normalize_each, normalize_text, query_terms
from tessera.functions.vectors import dot

MAX_QUERIES = 100_000
#: Terms and query vectors that one call takes.
TERM_BYTES = 64 << 20
QUERY_BYTES = 64 << 20


def stated(queries: DataFrame) -> DataFrame:
    """The query side of a scan, broadcast; a set beyond MAX_QUERIES has to come in several calls."""
    if queries.limit(MAX_QUERIES + 1).count() > MAX_QUERIES:
        raise ValueError(f"more than {MAX_QUERIES} queries in one call")
    return F.broadcast(queries)


def _joined(*cols: Column) -> Column:
    return F.concat_ws(" ", *cols)


def _scan(batches, asked: list[tuple[int, list[tuple[str, float]]]], shown: int = 20):
    """Scores of the queries (place, terms with weights) whose terms occur in a row; one pass of an automaton over each text, whatever the number of queries."""
    import math

    import ahocorasick

    of_term: dict[str, list[tuple[int, int, float]]] = {}
    for q, terms in asked:
        for i, (term, weight) in enumerate(terms):
            if term:
                of_term.setdefault(term, []).append((q, i, weight))
    automaton = ahocorasick.Automaton()
    for term in of_term:
        automaton.add_word(term, term)
    if of_term:
        automaton.make_automaton()

    def counts(text: str) -> dict[str, int]:
        """Occurrences of each term that don't overlap, from the left."""
        n: dict[str, int] = {}
        free: dict[str, int] = {}
        for end, term in automaton.iter(text) if of_term else ():
            if end + 1 - len(term) >= free.get(term, 0):
                n[term] = n.get(term, 0) + 1
                free[term] = end + 1
        return n

    for batch in batches:
        rows, who, scores, terms = [], [], [], []
        for i, (body, named, metadata) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("body", "named", "metadata")))):
            in_body, in_named, in_metadata = counts(body), counts(named), counts(metadata)
            per: dict[int, list[tuple[int, float, str]]] = {}
            for term in in_body.keys() | in_named.keys() | in_metadata.keys():
                v = (8.0 if term in in_named else 0.0) + (3.0 if term in in_metadata else 0.0) + (1 + math.log1p(in_body[term]) if term in in_body else 0.0)
                for q, place, weight in of_term[term]:
                    per.setdefault(q, []).append((place, weight * v, term))
            for q, found in per.items():
                found.sort()
                rows.append(i)
                who.append(q)
                scores.append(sum(x for _, x, _ in found))
                terms.append([t for _, _, t in found[:shown]])
        at = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(who, pa.int32()), batch.column("slug").take(at), batch.column("chunk_id").take(at), pa.array(scores, pa.float64()), pa.array(terms, pa.list_(pa.string()))], names=["_q", "slug", "chunk_id", "score", "matched_terms"])


def lexical_scores(queries: DataFrame, chunks: DataFrame, compatible: bool = True) -> DataFrame:
    """Hits (query_id, slug, chunk_id, score, matched_terms). queries: query_id, query. chunks: slug, chunk_id, text, title, aliases, tags, modules, domain.

    A term's weight counts 8 in title or aliases, 3 in other metadata, and 1 + ln(1 + occurrences) in the text. Scores have nine places, so that ties don't hang on the order of a sum.
    The stated queries (at most MAX_QUERIES and TERM_BYTES of terms) become one automaton; a text is scanned once and only hits leave its task.
    """
    fold = (lambda c: F.lower(normalize_form(c))) if compatible else (lambda c: F.lower(F.coalesce(c, F.lit(""))))
    terms = queries.select("query_id", F.map_entries(query_terms(F.col("query"), compatible)).alias("terms"))
    rows = terms.limit(MAX_QUERIES + 1).collect()  # the stated queries
    if len(rows) > MAX_QUERIES or sum(len(t["key"]) + 16 for r in rows for t in r["terms"]) > TERM_BYTES:
        raise ValueError(f"more than {MAX_QUERIES} queries or {TERM_BYTES} bytes of terms in one call")
    asked = [(i, [(t["key"], t["value"]) for t in r["terms"]]) for i, r in enumerate(rows)]
    body = chunks.select(
        "slug", "chunk_id", fold(F.col("text")).alias("body"), fold(_joined(F.col("title"), F.array_join("aliases", " "))).alias("named"),
        fold(_joined(F.col("slug"), F.array_join("tags", " "), F.array_join("modules", " "), F.col("domain"))).alias("metadata"),
    )
    hits = body.mapInArrow(partial(_scan, asked=asked), "_q int, slug string, chunk_id string, score double, matched_terms array<string>")
    ids = queries.sparkSession.createDataFrame([(i, r["query_id"]) for i, r in enumerate(rows)], T.StructType([T.StructField("_q", T.IntegerType()), queries.schema["query_id"]]))
    return hits.join(F.broadcast(ids), "_q").select("query_id", "slug", "chunk_id", F.round("score", 9).alias("score"), "matched_terms")  # at most MAX_QUERIES rows


def normalize_form(c: Column) -> Column:
    from tessera.functions.text import nfkc

    return F.coalesce(nfkc(c), F.lit(""))


def best_per_page(hits: DataFrame) -> DataFrame:
    """The best chunk of each page: highest score, then chunk_id."""
    first = F.row_number().over(Window.partitionBy("query_id", "slug").orderBy(F.desc("score"), F.asc("chunk_id")))
    return hits.withColumn("_n", first).where("_n = 1").drop("_n")


def vector_scores(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Inner products of every query vector with every chunk vector: (query_id, slug, chunk_id, score). All pages in scope are candidates."""
    q = stated(queries.select("query_id", F.col("vector").alias("_q")))
    return chunks.select("slug", "chunk_id", "vector").crossJoin(q).select("query_id", "slug", "chunk_id", dot(F.col("vector"), F.col("_q")).alias("score"))


def _nearest(batches, ids: list, block: np.ndarray, k: int):
    """The best k of each query among the rows of this task so far, ties with the last one included; rows that can't be among them any more aren't emitted."""
    least = np.full(len(ids), -np.inf)
    kept = [np.zeros(0) for _ in ids]
    for batch in batches:
        column = batch.column("vector")
        rows = np.flatnonzero(np.asarray(column.is_valid()))
        if not len(rows) or not len(ids):
            continue
        flat = column.flatten().to_numpy(zero_copy_only=False)
        scores = flat.reshape(len(rows), -1) @ block.T  # a block of rows against all queries
        at, who, what = [], [], []
        for q in range(len(ids)):
            s = scores[:, q]
            good = np.flatnonzero(s >= least[q])
            if not len(good):
                continue
            top = np.concatenate([kept[q], s[good]])
            if len(top) > k:
                top = np.partition(top, len(top) - k)[-k:]
                least[q] = top.min()
                good = good[s[good] >= least[q]]
            kept[q] = top
            at.append(rows[good])
            who.append(np.full(len(good), q))
            what.append(s[good])
        if at:
            place, who = pa.array(np.concatenate(at)), np.concatenate(who)
            yield pa.RecordBatch.from_arrays([pa.array([ids[q] for q in who], pa.int64()), batch.column("slug").take(place), batch.column("chunk_id").take(place), pa.array(np.concatenate(what))], names=["query_id", "slug", "chunk_id", "score"])


def nearest(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Candidates (query_id, slug, chunk_id, score) that hold the k best inner products of every query with ties; top_k makes the final cut.

    The stated queries (query_id long, vector) of at most QUERY_BYTES travel to the tasks; batches of rows meet them as matrix products, and a task hands on little more than k rows a query.
    Vectors of one length; a null vector has no score. Larger query sets come in several calls.
    """
    size = queries.agg(F.sum(F.size("vector") * 8 + 16)).first()[0] or 0
    if size > QUERY_BYTES:
        raise ValueError(f"query vectors of {size} bytes in one call; at most {QUERY_BYTES}")
    rows = queries.where("vector is not null").select("query_id", "vector").collect()  # the stated queries, their size checked
    block = np.array([r["vector"] for r in rows], dtype=np.float64) if rows else np.zeros((0, 0))
    return chunks.select("slug", "chunk_id", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(partial(_nearest, ids=[r["query_id"] for r in rows], block=block, k=k), "query_id long, slug string, chunk_id string, score double")


def top_k(hits: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows of each query. The limit runs before and after the shuffle (a window group limit), so a hot query costs k rows per task."""
    by = Window.partitionBy("query_id").orderBy(*(order or (F.desc("score"), F.asc("slug"))))
    return hits.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def fuse(lexical: DataFrame, vector: DataFrame | None, limit: int = 10, pool: int = 100) -> DataFrame:
    """Reciprocal rank fusion of page hits: 1 / (60 + rank) per arm.

    score = 0.65 * 30.5 * rrf + 0.35 * max(0, cosine), or 61 * rrf without a vector arm; rounded to six places. The lexical arm's chunk
    stands for the page where there is one.
    """
    depth = max(pool, 8 * limit)
    a = top_k(best_per_page(lexical), depth, F.desc("score"), F.asc("chunk_id")).select("query_id", "slug", F.col("chunk_id").alias("l_chunk"), F.col("score").alias("lexical_score"), F.col("rank").alias("l_rank"))
    if vector is None:
        fused = a.withColumns({"v_chunk": F.lit(None).cast("string"), "vector_score": F.lit(None).cast("double"), "v_rank": F.lit(None).cast("int")})
    else:
        b = top_k(best_per_page(vector), depth, F.desc("score"), F.asc("chunk_id")).select("query_id", "slug", F.col("chunk_id").alias("v_chunk"), F.col("score").alias("vector_score"), F.col("rank").alias("v_rank"))
        fused = a.join(b, ["query_id", "slug"], "full_outer")
    rrf = F.coalesce(1 / (F.lit(60.0) + F.col("l_rank")), F.lit(0.0)) + F.coalesce(1 / (F.lit(60.0) + F.col("v_rank")), F.lit(0.0))
    score = F.lit(0.65 * 30.5) * rrf + F.lit(0.35) * F.greatest(F.lit(0.0), F.coalesce("vector_score", F.lit(0.0))) if vector is not None else rrf * 61
    evidence = F.when(F.coalesce("lexical_score", F.lit(0.0)) > 0, F.when(F.col("vector_score").isNull(), "native_lexical").otherwise("native_lexical_vector")).otherwise("native_vector")
    hits = fused.select("query_id", "slug", F.coalesce("l_chunk", "v_chunk").alias("chunk_id"), F.round(score, 6).alias("score"), F.coalesce("lexical_score", F.lit(0.0)).alias("lexical_score"), "vector_score", evidence.alias("evidence"))
    return top_k(hits, limit, F.desc("score"), F.asc("chunk_id"))


def keyword_hits(queries: DataFrame, pages: DataFrame, compatible: bool = True) -> DataFrame:
    """Local keyword scores (query_id, slug, score, evidence, metadata_matches, body_matches) of pages (slug, title, aliases, tags, modules, domain, body).

    100 for an exact name, else 55 for a name that holds the query, 12 for a body that does; per term the best of title 8, aliases 7, tags 6, slug 5, modules 3, domain 2 times
    its weight, and its weight once more in the body; score = s / (s + 24), at most 0.99, 1 for an exact name; four places.
    """
    norm = lambda c: normalize_text(c, compatible)
    squeeze = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    q = queries.select("query_id", norm(F.col("query")).alias("q"))
    tagged = lambda arr, w: F.transform(arr, lambda t: F.struct(t.alias("t"), w(t).alias("w")))
    terms = F.concat(tagged(cjk_ngrams(F.col("q"), 4), lambda t: F.lit(4)), tagged(latin_terms(F.col("q")), lambda t: F.when(F.length(t) >= 5, 4).otherwise(2)), tagged(cjk_ngrams(F.col("q"), 2), lambda t: F.lit(1)))
    q = stated(q.select("query_id", "q", squeeze(F.col("q")).alias("cq"), terms.alias("terms")))
    name = F.replace(F.element_at(F.split("slug", "/"), -1), F.lit("-"), F.lit(" "))
    names = F.filter(F.concat(F.array("title", "base"), "names"), lambda x: x != "")
    p = pages.select(
        "slug", normalize_each(F.col("aliases"), compatible).alias("names"), norm(F.col("title")).alias("title"), norm(F.array_join("aliases", " ")).alias("aliases"), norm(F.array_join("tags", " ")).alias("tags"), norm(F.replace("slug", F.lit("-"), F.lit(" "))).alias("slug_text"),
        norm(F.array_join("modules", " ")).alias("modules"), norm(F.col("domain")).alias("domain"), norm(F.col("body")).alias("body"), norm(name).alias("base"),
    )
    exact = (F.col("q") != "") & F.exists(names, lambda x: x == F.col("q"))
    held = (F.length("cq") >= 4) & F.exists(names, lambda x: F.contains(squeeze(x), F.col("cq")))
    in_body = (F.length("cq") >= 4) & F.contains(squeeze(F.col("body")), F.col("cq"))

    def one(t):
        best = F.greatest(*[F.when(F.contains(c, t["t"]), w).otherwise(0) for c, w in (("title", 8), ("aliases", 7), ("tags", 6), ("slug_text", 5), ("modules", 3), ("domain", 2))])
        return F.struct(best.alias("m"), F.contains("body", t["t"]).cast("int").alias("b"), t["w"].alias("w"))

    both = p.crossJoin(q).withColumn("exact", exact).withColumn("held", held).withColumn("in_body", in_body).withColumn("parts", F.filter(F.transform("terms", one), lambda x: (x["m"] > 0) | (x["b"] > 0)))
    raw = F.when(F.col("exact"), 100).when(F.col("held"), 55).otherwise(0) + F.when(F.col("in_body"), 12).otherwise(0) + F.aggregate("parts", F.lit(0), lambda s, x: s + x["w"] * (x["m"] + x["b"]))
    both = both.withColumn("raw", raw).where("raw > 0")
    score = F.when(F.col("exact"), 1.0).otherwise(F.round(F.least(F.lit(0.99), F.col("raw") / (F.col("raw") + 24.0)), 4))
    counted = lambda f: F.size(F.filter("parts", f))
    evidence = F.when(F.col("exact"), "keyword_exact").when(counted(lambda x: x["m"] > 0) > 0, "local_metadata_keyword").otherwise("local_body_keyword")
    return both.select("query_id", "slug", score.alias("score"), evidence.alias("evidence"), counted(lambda x: x["m"] > 0).alias("metadata_matches"), counted(lambda x: x["b"] > 0).alias("body_matches"))


def boost_module(hits: DataFrame, module: str, modules: Column) -> DataFrame:
    """Hits of pages of a module count 1.15 times; order by boosted score, then by the rank they had."""
    same = F.exists(modules, lambda m: F.lower(F.btrim(m)) == module.strip().lower())
    boosted = hits.withColumn("score", F.when(same, F.round(F.col("score") * 1.15, 4)).otherwise(F.col("score"))).withColumn("module_match", same)
    return boosted.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("rank"))))


def first_of_each(hits: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row per query and key in ranked order."""
    n = F.row_number().over(Window.partitionBy("query_id", key).orderBy(*order))
    return hits.withColumn("_n", n).where("_n = 1").drop("_n")


def verified(hits: DataFrame, pages: DataFrame) -> DataFrame:
    """Hits whose page still has the slug, type and digest they were ranked with."""
    return hits.join(pages.select("slug", "type", "sha"), ["slug", "type", "sha"], "left_semi")


def unique_fuzzy(pages: DataFrame, text: str, limit: int = 5) -> DataFrame:
    """The page whose slug or title holds the text, if exactly one does; more than `limit` candidates are never listed."""
    hits = pages.where(F.contains(F.lower("slug"), F.lit(text.lower())) | F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lit(text.lower()))).select("slug", "title").limit(limit)
    return hits.withColumn("_n", F.count("*").over(Window.partitionBy(F.lit(1)))).where("_n = 1").drop("_n")


def list_pages(pages: DataFrame, types: list[str] | None = None, limit: int = 50, by_slug: bool = False) -> DataFrame:
    """The first pages (at most 100), latest first, then by slug, or by slug alone; a page without a date comes last."""
    chosen = pages.where(F.col("type").isin(types)) if types else pages
    order = [F.asc("slug")] if by_slug else [F.desc_nulls_last("updated_at"), F.asc("slug")]
    return chosen.select("slug", "type", "title", "updated_at").orderBy(*order).limit(max(1, min(100, limit)))
