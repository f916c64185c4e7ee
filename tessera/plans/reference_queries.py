"""Registered queries of the library's own operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.common import table
from tessera.functions import digests, text, vectors
from tessera.operators import assets, evaluate, graph, history, ingest, ledger, nested, packing, places, retrieve, route, runtime
from tessera.sources import files, markdown

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


#: The stated queries that rank the whole corpus.
ASKED = [(1, "frame the private recipe against"), (2, "花园 仓库 清单"), (3, "Copper Relay review"), (4, "发票逐步核对"), (5, "umbrella-tenant v2.1"), (6, "周")]
_ASKED = ", ".join(f"({i}, '{q}')" for i, q in ASKED)


#: Queries long enough that one page alone may have the first rank.
UNIQUE = [(i, q) for i, q in enumerate(("Copper Relay review of the quarry ledger", "Marble Signal overview and index", "花园仓库清单复盘", "发票核对方法与结论", "Willow Bridge notebook margin", "Harrow Console private recipe method", "周报样张", "Fennel Garden decision draft"), 1)]
_UNIQUE = ", ".join(f"({i}, '{q}')" for i, q in UNIQUE)


def asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ASKED, "query_id int, query string")


def pages(spark: SparkSession, d: str) -> DataFrame:
    return markdown.pages_of(table(spark, d, "documents")).withColumn("aliases", F.array().cast("array<string>"))


_LIST = "list_filter(list_transform(string_split(regexp_replace(coalesce({0}, ''), '^\\[|\\]$', '', 'g'), ','), lambda x: trim(x)), lambda x: x <> '')"
_FIELD = "nullif(trim(regexp_extract(h, '(?m)^{0}:[ \\t]*(.*)$', 1)), '')"
PAGES = rf"""n as (select *, replace(text, chr(13) || chr(10), chr(10)) as t from documents),
hd as (select *, regexp_extract(t, '(?s)\A---\n(.*?)\n---(?:\n|\z)', 1) as h from n),
pages as (select doc_id, slug, page_type as type, {_FIELD.format("title")} as title, {_LIST.format(_FIELD.format("tags"))} as tags, {_LIST.format(_FIELD.format("modules"))} as modules, {_FIELD.format("maturity")} as maturity, {_FIELD.format("updated")} as updated,
  domain, lang, source, updated_at, regexp_replace(coalesce(t, ''), '(?s)\A---\n.*?\n---(?:\n|\z)', '') as body from hd)"""
_NORM = "trim(regexp_replace(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_LATIN_STOP = "[" + ", ".join(f"'{w}'" for w in text.LATIN_STOP_TERMS) + "]"
_CJK_STOP = "[" + ", ".join(f"'{w}'" for w in text.CJK_STOP_TERMS) + "]"


def _latin(n: str) -> str:
    return rf"list_distinct(list_filter(regexp_extract_all({n}, '[\p{{Latin}}\p{{N}}]+'), lambda x: length(x) >= 2 and not list_contains({_LATIN_STOP}, x)))"


def _grams(n: str, k: int) -> str:
    return rf"list_distinct(list_filter(flatten(list_transform(regexp_extract_all({n}, '\p{{Han}}+'), lambda r: list_transform(range(1, length(r) - {k - 2}), lambda i: substr(r, i::bigint, {k})))), lambda g: not list_contains({_CJK_STOP}, g)))"


# ---- scans, projections, counts -------------------------------------------------------------------------------------


@query("select doc_id, slug, page_type as type from documents where page_type in ('project', 'decision', 'methodology', 'synthesis', 'concept') and lang is not null")
def scan_scope_filter(spark, d):
    docs = table(spark, d, "documents").where(markdown.in_scope(F.col("page_type"), "result") & F.col("lang").isNotNull())
    return docs.select("doc_id", "slug", F.col("page_type").alias("type"))


@query("select slug, case when slug like 'projects/_%' then 'project' when slug like 'decisions/_%' then 'decision' when slug like 'methods/_%' then 'methodology' when slug like 'syntheses/_%' then 'synthesis' when slug like 'concepts/_%' then 'concept' when slug like 'sources/_%' then 'source' end as type from (select distinct slug from documents)")
def path_types(spark, d):
    return table(spark, d, "documents").select("slug").distinct().select("slug", markdown.type_for_path(F.col("slug")).alias("type"))


@query("select t.type, count(doc_id) as n from (values ('project'), ('decision'), ('methodology'), ('synthesis'), ('concept'), ('source')) t(type) left join documents on page_type = t.type group by 1")
def doc_type_counts(spark, d):
    return graph.type_counts(table(spark, d, "documents").withColumnRenamed("page_type", "type"))


@query(f"with {PAGES} select doc_id, slug, type, title, array_to_string(tags, ',') as tags, array_to_string(modules, ',') as modules, maturity, updated, length(body) as body_chars from pages")
def page_fields(spark, d):
    return pages(spark, d).select("doc_id", "slug", "type", "title", F.array_join("tags", ",").alias("tags"), F.array_join("modules", ",").alias("modules"), "maturity", "updated", F.length("body").cast("long").alias("body_chars"))


@query()
def frontmatter_parse(spark, d):
    p = markdown.parse_pages(table(spark, d, "documents").select("doc_id", "text"))
    return p.select("doc_id", "page.title", "page.type", F.array_join("page.tags", ",").alias("tags"), "page.updated", "page.fields", F.length("page.compiled_truth").alias("truth_chars"), F.length("page.timeline").alias("timeline_chars"))


@query()
def claim_sections(spark, d):
    p = markdown.claim_records(table(spark, d, "documents").select("doc_id", F.col("text").alias("body")))
    return p.select("doc_id", F.explode("parsed.issues").alias("i")).groupBy("i.code").agg(F.count("*").alias("n"))


@query("select count(*) as rows, count(distinct slug) as slugs, count(*) - count(distinct doc_id) as repeated_ids, count(*) filter (n_chars is distinct from coalesce(length(text), 0)) as stale_lengths, count(*) filter (text is null or regexp_matches(text, '^ *$')) as blank from documents")
def corpus_integrity(spark, d):
    docs = table(spark, d, "documents")
    stale = ~F.col("n_chars").eqNullSafe(F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    return docs.agg(F.count("*").alias("rows"), F.count_distinct("slug").alias("slugs"), (F.count("*") - F.count_distinct("doc_id")).alias("repeated_ids"), F.count_if(stale).alias("stale_lengths"), F.count_if(F.col("text").isNull() | (F.trim("text") == "")).alias("blank"))


# ---- text functions -------------------------------------------------------------------------------------------------


@query(f"with w as (select unnest({_latin(_NORM.format('summary'))}) as term from evidence) select term, count(*) as n from w group by 1")
def latin_terms(spark, d):
    n = text.normalize_text(F.col("summary"), False)
    return table(spark, d, "evidence").select(F.explode(text.latin_terms(n)).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query(f"with w as (select unnest({_grams(_NORM.format('summary'), 2)}) as gram, 2 as size from evidence union all select unnest({_grams(_NORM.format('summary'), 4)}), 4 from evidence) select gram, size, count(*) as n from w group by 1, 2")
def char_ngrams(spark, d):
    n = text.normalize_text(F.col("summary"), False)
    x = table(spark, d, "evidence").select(F.explode(F.array(F.struct(F.lit(2).alias("size"), text.cjk_ngrams(n, 2).alias("g")), F.struct(F.lit(4).alias("size"), text.cjk_ngrams(n, 4).alias("g")))).alias("x"))
    return x.select("x.size", F.explode("x.g").alias("gram")).groupBy("gram", "size").agg(F.count("*").alias("n"))


_TERMS = r"""words as (select id, unnest(regexp_extract_all(lower(coalesce(q, '')), '[a-z0-9]+(?:[._:-][a-z0-9]+)*')) as term from src),
runs as (select id, unnest(regexp_extract_all(lower(coalesce(q, '')), '[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]+')) as r from src),
terms as (select distinct id, term, case when length(term) >= 5 then 3.0 else 2.0 end::double as weight from words
  union select id, r, 0.5::double from runs where length(r) = 1
  union select id, substr(r, i::bigint, 2), 1.0::double from (select id, r, unnest(range(1, length(r))) as i from runs)
  union select id, substr(r, i::bigint, 4), 3.0::double from (select id, r, unnest(range(1, length(r) - 2)) as i from runs))"""


@query(f"with src as (select evidence_id as id, summary as q from (select distinct evidence_id, summary from evidence)), {_TERMS} select id as evidence_id, term, weight from terms")
def native_terms(spark, d):
    e = table(spark, d, "evidence").select("evidence_id", "summary").distinct()
    return e.select("evidence_id", F.explode(text.query_terms(F.col("summary"), False)).alias("term", "weight")).distinct()


@query("select doc_id, term, ((length(body) - length(replace(body, term, ''))) / length(term))::bigint as n from (select doc_id, lower(coalesce(text, '')) as body from documents), (values ('the'), ('了'), ('our'), ('需要')) t(term) where contains(body, term)")
def substring_occurrences(spark, d):
    terms = spark.createDataFrame([("the",), ("了",), ("our",), ("需要",)], "term string")
    body = table(spark, d, "documents").select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("body")).crossJoin(retrieve.stated(terms))
    return body.select("doc_id", "term", text.count_occurrences(F.col("body"), F.col("term")).alias("n")).where("n > 0")


@query(r"with x as (select doc_id, trim(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') as t from documents), p as (select doc_id, t, coalesce(list_min(list_filter([instr(lower(t), 'umbrella'), instr(lower(t), '花园')], lambda i: i > 0)), 1) as i from x) select doc_id, substr(t, greatest(1, i - 160), 1200) as excerpt from p")
def excerpt_first_match(spark, d):
    return table(spark, d, "documents").select("doc_id", text.excerpt(F.col("text"), F.array(F.lit("umbrella"), F.lit("花园"))).alias("excerpt"))


@query("select doc_id, substr(trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' '), 1, 60) as subject from documents")
def subject_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", text.subject_line(F.col("text")).alias("subject"))


@query()
def page_summaries(spark, d):
    return pages(spark, d).select("doc_id", text.summary(F.col("body")).alias("summary"), text.truncate_bytes(F.col("title"), 24).alias("short_title"))


@query()
def route_text_nfkc(spark, d):
    return table(spark, d, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("normal"))


@query("select id, case when bad then null else regexp_replace(v, '/$', '') end as slug from (select id, v, v = '' or v = '.' or contains(v, '\\') or v like '/%' or regexp_matches(v, '(^|/)\\.\\.(/|$)') as bad from (select doc_id as id, regexp_replace(regexp_replace(regexp_replace(trim(s), '\\.md$', ''), '/{2,}', '/', 'g'), '(^|/)(\\./)+', '\\1', 'g') as v from (select doc_id, case doc_id % 5 when 0 then slug || '.md' when 1 then '/' || slug when 2 then '../' || slug when 3 then ' ' || replace(slug, '/', '//') else './' || slug end as s from documents)))")
def normalized_slugs(spark, d):
    k = F.col("doc_id") % 5
    s = F.when(k == 0, F.concat("slug", F.lit(".md"))).when(k == 1, F.concat(F.lit("/"), "slug")).when(k == 2, F.concat(F.lit("../"), "slug")).when(k == 3, F.concat(F.lit(" "), F.replace("slug", F.lit("/"), F.lit("//")))).otherwise(F.concat(F.lit("./"), "slug"))
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), text.normalize_slug(s).alias("slug"))


# ---- retrieval ------------------------------------------------------------------------------------------------------


def _chunks(spark, d):
    return pages(spark, d).select("slug", F.col("doc_id").cast("string").alias("chunk_id"), F.col("body").alias("text"), "title", "aliases", "tags", "modules", "domain")


_LEXICAL = rf"""{PAGES}, src as (select * from (values {_ASKED}) v(id, q)), {_TERMS},
docs as (select slug, doc_id::varchar as chunk_id, lower(coalesce(body, '')) as b, lower(coalesce(title, '')) || ' ' as nm, lower(concat_ws(' ', slug, array_to_string(tags, ' '), array_to_string(modules, ' '), domain)) as md from pages),
hits as (select id as query_id, slug, chunk_id, weight * (case when contains(nm, term) then 8 else 0 end + case when contains(md, term) then 3 else 0 end
  + case when contains(b, term) then 1 + ln(1 + floor((length(b) - length(replace(b, term, ''))) / length(term))) else 0 end) as v from docs, terms),
lexical as (select query_id, slug, chunk_id, round(sum(v), 9) as score from hits where v > 0 group by all),
page_hits as (select * from lexical qualify row_number() over (partition by query_id, slug order by score desc, chunk_id) = 1)"""


@query(f"with {_LEXICAL} select query_id, slug, chunk_id, round(score, 6) as score, row_number() over (partition by query_id order by score desc, chunk_id)::int as rank from page_hits qualify rank <= 20")
def lexical_topk(spark, d):
    hits = retrieve.top_k(retrieve.best_per_page(retrieve.lexical_scores(asked(spark), _chunks(spark, d), False)), 20, F.desc("score"), F.asc("chunk_id"))
    return hits.select("query_id", "slug", "chunk_id", F.round("score", 6).alias("score"), "rank")


def _vectors(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.concat(F.lit("v"), F.col("vec_id")).alias("slug"), F.col("vec_id").cast("string").alias("chunk_id"), F.col("embedding").alias("vector"), "vec_id", "label")


def _vector_queries(spark, d):
    return _vectors(spark, d).where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "vector", "label")


_VECTOR = """q as (select vec_id as query_id, embedding as qe, label as ql from embeddings where vec_id % 100 = 0),
vs as (select query_id, ql, vec_id, label, list_sum(list_transform(list_zip(embedding, qe), lambda p: p[1]::double * p[2]::double)) as score from embeddings, q)"""


@query(f"with {_VECTOR} select query_id, vec_id, round(score, 6) as score, row_number() over (partition by query_id order by score desc, vec_id::varchar)::int as rank from vs qualify rank <= 10")
def vector_topk(spark, d):
    hits = retrieve.top_k(retrieve.nearest(_vector_queries(spark, d), _vectors(spark, d), 10), 10, F.desc("score"), F.asc("chunk_id"))
    return hits.select("query_id", F.col("chunk_id").cast("long").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


@query("select count(*) as n, count(distinct vec_id) as ids, bool_and(len(embedding) = 64) as same_size, round(max(abs(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) - 1)), 5) as worst_norm from embeddings")
def vector_integrity(spark, d):
    e = table(spark, d, "embeddings")
    return e.agg(F.count("*").alias("n"), F.count_distinct("vec_id").alias("ids"), F.bool_and(F.size("embedding") == 64).alias("same_size"), F.round(F.max(F.abs(vectors.norm(F.col("embedding")) - 1)), 5).alias("worst_norm"))


@query(f"with {_LEXICAL} select query_id, slug, chunk_id, round(61.0 / (60 + row_number() over (partition by query_id order by score desc, chunk_id)), 6) as score, 'native_lexical' as evidence from page_hits qualify row_number() over (partition by query_id order by score desc, chunk_id) <= 10")
def lexical_only_fusion(spark, d):
    return retrieve.fuse(retrieve.lexical_scores(asked(spark), _chunks(spark, d), False), None).select("query_id", "slug", "chunk_id", "score", "evidence")


_FUSE = f"""with {_VECTOR}, lab as (select query_id, 'v' || vec_id as slug, vec_id::varchar as chunk_id, 1.0 / (1 + vec_id % 7) as score from vs where label = ql),
a as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as r from lab qualify r <= 100),
b as (select query_id, 'v' || vec_id as slug, vec_id::varchar as chunk_id, score, row_number() over (partition by query_id order by score desc, vec_id::varchar) as r from vs qualify r <= 100),
f as (select coalesce(a.query_id, b.query_id) as query_id, coalesce(a.slug, b.slug) as slug, coalesce(a.chunk_id, b.chunk_id) as chunk_id, coalesce(1.0 / (60 + a.r), 0) + coalesce(1.0 / (60 + b.r), 0) as rrf, b.score as v from a full join b on a.query_id = b.query_id and a.slug = b.slug),
s as (select query_id, slug, chunk_id, round(0.65 * 30.5 * rrf + 0.35 * greatest(0, coalesce(v, 0)), 6) as score from f)
select query_id, slug, score, row_number() over (partition by query_id order by score desc, chunk_id)::int as rank from s qualify rank <= 10"""


@query(_FUSE)
def rrf_fusion(spark, d):
    both = retrieve.nearest(_vector_queries(spark, d), _vectors(spark, d), 100)  # a page is one vector here
    labels = _vectors(spark, d).select("slug", "chunk_id", "vec_id", "label").join(retrieve.stated(_vector_queries(spark, d).select("query_id", "label")), "label")
    lexical = labels.select("query_id", "slug", "chunk_id", (1.0 / (1 + F.col("vec_id") % 7)).alias("score"))
    return retrieve.fuse(lexical, both).select("query_id", "slug", "score", "rank")


_HYBRID = f"""with {_LEXICAL}, qv as (select id as query_id, embedding as qe from (values (1), (2), (3), (4), (5), (6)) v(id) join embeddings on vec_id = id * 7),
ev as (select query_id, vec_id::varchar as chunk_id, list_sum(list_transform(list_zip(embedding, qe), lambda p: p[1]::double * p[2]::double)) as score from embeddings join documents on doc_id = vec_id, qv),
a as (select query_id, chunk_id, score, row_number() over (partition by query_id order by score desc, chunk_id) as r from lexical qualify r <= 100),
b as (select query_id, chunk_id, score, row_number() over (partition by query_id order by score desc, chunk_id) as r from ev qualify r <= 100),
f as (select coalesce(a.query_id, b.query_id) as query_id, coalesce(a.chunk_id, b.chunk_id) as chunk_id, coalesce(1.0 / (60 + a.r), 0) + coalesce(1.0 / (60 + b.r), 0) as rrf, b.score as v, case when a.score > 0 then case when b.score is null then 'native_lexical' else 'native_lexical_vector' end else 'native_vector' end as evidence from a full join b on a.query_id = b.query_id and a.chunk_id = b.chunk_id),
s as (select query_id, chunk_id, evidence, round(0.65 * 30.5 * rrf + 0.35 * greatest(0, coalesce(v, 0)), 6) as score from f)
select query_id, chunk_id, evidence, score, row_number() over (partition by query_id order by score desc, chunk_id)::int as rank from s qualify rank <= 10"""


@query(_HYBRID)
def hybrid_fusion(spark, d):
    """Both arms over the documents: their texts, and the vectors of the same ids."""
    lexical = retrieve.lexical_scores(asked(spark), _chunks(spark, d), False).withColumn("slug", F.col("chunk_id"))  # slugs repeat, so a document is a page
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("embedding").alias("vector"))
    both = e.join(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("chunk_id")), "chunk_id").withColumn("slug", F.col("chunk_id"))
    ids = asked(spark).select(F.col("query_id").cast("long").alias("query_id"), (F.col("query_id") * 7).cast("string").alias("chunk_id"))
    vector = retrieve.nearest(e.join(retrieve.stated(ids), "chunk_id").select("query_id", "vector"), both, 100).withColumn("query_id", F.col("query_id").cast("int"))
    return retrieve.fuse(lexical, vector).select("query_id", "chunk_id", "evidence", "score", "rank")


_KW = rf"""with {PAGES}, q0 as (select id as query_id, {_NORM.format("q")} as q from (values {_ASKED}) v(id, q)),
t as (select query_id, unnest({_grams("q", 4)}) as term, 4 as w from q0 union all select query_id, term, case when length(term) >= 5 then 4 else 2 end from (select query_id, unnest({_latin("q")}) as term from q0) union all select query_id, unnest({_grams("q", 2)}), 1 from q0),
p as (select doc_id, slug, {_NORM.format("title")} as title, {_NORM.format("array_to_string(tags, ' ')")} as tags, {_NORM.format("replace(slug, '-', ' ')")} as slug_text, {_NORM.format("array_to_string(modules, ' ')")} as modules, {_NORM.format("domain")} as domain, {_NORM.format("body")} as body,
  {_NORM.format("replace(string_split(slug, '/')[-1], '-', ' ')")} as base from pages),
m as (select doc_id, query_id, w, greatest(case when contains(title, term) then 8 else 0 end, case when contains(tags, term) then 6 else 0 end, case when contains(slug_text, term) then 5 else 0 end, case when contains(modules, term) then 3 else 0 end, case when contains(domain, term) then 2 else 0 end) as mw, contains(body, term)::int as b from p, t),
g as (select doc_id, query_id, sum(w * (mw + b)) as s, count(*) filter (mw > 0) as mm, count(*) filter (b > 0) as bm from m where mw > 0 or b > 0 group by all),
e as (select p.doc_id, p.slug, q0.query_id, (q <> '' and ((title = q and title <> '') or (base = q and base <> ''))) as ex, length(replace(q, ' ', '')) >= 4 and (contains(replace(title, ' ', ''), replace(q, ' ', '')) or contains(replace(base, ' ', ''), replace(q, ' ', ''))) as held, length(replace(q, ' ', '')) >= 4 and contains(replace(body, ' ', ''), replace(q, ' ', '')) as inb from p, q0),
r as (select e.*, case when ex then 100 when held then 55 else 0 end + case when inb then 12 else 0 end + coalesce(s, 0) as raw, coalesce(mm, 0) as mm, coalesce(bm, 0) as bm from e left join g using (doc_id, query_id))
select query_id, slug, case when ex then 1.0 else round(least(0.99, raw / (raw + 24.0)), 4) end::double as score, case when ex then 'keyword_exact' when mm > 0 then 'local_metadata_keyword' else 'local_body_keyword' end as evidence, mm::int as metadata_matches, bm::int as body_matches from r where raw > 0"""


@query(_KW)
def keyword_hits(spark, d):
    return retrieve.keyword_hits(asked(spark), pages(spark, d), False)


@query(f"with {_LEXICAL}, top as (select *, row_number() over (partition by query_id order by score desc, chunk_id)::int as rank0 from page_hits qualify rank0 <= 20), m as (select t.query_id, t.slug, t.rank0, list_contains(p.modules, 'quarry') as hit, case when list_contains(p.modules, 'quarry') then round(t.score * 1.15, 4) else t.score end as s from top t join pages p on p.doc_id::varchar = t.chunk_id) select query_id, slug, round(s, 6) as score, hit as module_match, row_number() over (partition by query_id order by s desc, rank0)::int as rank from m")
def module_boost_rerank(spark, d):
    hits = retrieve.top_k(retrieve.best_per_page(retrieve.lexical_scores(asked(spark), _chunks(spark, d), False)), 20, F.desc("score"), F.asc("chunk_id"))
    joined = hits.join(pages(spark, d).select(F.col("doc_id").cast("string").alias("chunk_id"), "modules"), "chunk_id")
    return retrieve.boost_module(joined, "quarry", F.col("modules")).select("query_id", "slug", F.round("score", 6).alias("score"), "module_match", "rank")


# ---- routing --------------------------------------------------------------------------------------------------------


def _matches_sql(field: str, weight: int) -> str:
    n = _NORM.format(field)
    return f"select doc_id, query_id, {weight} as w, unnest(list_distinct(list_concat(list_concat(list_intersect({_grams('qn', 4)}, {_grams(n, 4)}), list_intersect({_grams('qn', 2)}, {_grams(n, 2)})), list_intersect({_latin('qn')}, {_latin(n)})))) as term from pages, q"


@query(f"with {PAGES}, q as (select id as query_id, {_NORM.format('q')} as qn from (values {_ASKED}) v(id, q)), m as ({_matches_sql('title', 8)} union all {_matches_sql(chr(39) * 2, 7)} union all {_matches_sql(f'array_to_string(tags, {chr(39)} {chr(39)})', 4)} union all {_matches_sql(f'replace(string_split(slug, {chr(39)}/{chr(39)})[-1], {chr(39)}-{chr(39)}, {chr(39)} {chr(39)})', 3)}), s as (select query_id, doc_id, sum(w * case when length(term) >= 4 then 3 else 1 end)::int as score from m group by all) select query_id, doc_id, score, rank() over (partition by query_id order by score desc)::int as rank, count(*) over (partition by query_id, score) as ties from s")
def metadata_match_weights(spark, d):
    keyed = pages(spark, d).withColumn("slug", F.concat_ws("/", F.col("doc_id").cast("string"), text.basename(F.col("slug"))))
    m = route.metadata_matches(asked(spark), keyed)
    return m.select("query_id", F.substring_index("slug", "/", 1).cast("long").alias("doc_id"), F.col("score").cast("int").alias("score"), "rank", "ties")


@query(f"with {PAGES}, q as (select id as query_id, {_NORM.format('q')} as qn from (values {_UNIQUE}) v(id, q)), m as ({_matches_sql('title', 8)} union all {_matches_sql(f'array_to_string(tags, {chr(39)} {chr(39)})', 4)} union all {_matches_sql(f'replace(string_split(slug, {chr(39)}/{chr(39)})[-1], {chr(39)}-{chr(39)}, {chr(39)} {chr(39)})', 3)}), s as (select query_id, doc_id, sum(w * case when length(term) >= 4 then 3 else 1 end) as score, bool_or(w = 8) as named from m group by all), r as (select *, rank() over (partition by query_id order by score desc) as rank, count(*) over (partition by query_id, score) as ties from s) select query_id, doc_id from r where rank = 1 and ties = 1 and named")
def verified_metadata(spark, d):
    keyed = pages(spark, d).withColumn("slug", F.concat_ws("/", F.col("doc_id").cast("string"), text.basename(F.col("slug"))))
    q = spark.createDataFrame(UNIQUE, "query_id int, query string")
    return route.verified_metadata(route.metadata_matches(q, keyed)).select("query_id", F.substring_index("slug", "/", 1).cast("long").alias("doc_id"))


def _routed(spark, d):
    p = pages(spark, d).where(markdown.in_scope(F.col("type"), "result")).groupBy("slug").agg(F.min_by(F.struct("type", "title", "aliases", "tags", "modules"), "doc_id").alias("p")).select("slug", "p.*").withColumn("base_score", F.lit(0.5)).withColumn("decision_status", F.lit("active"))
    q = asked(spark).withColumn("context", F.lit("")).withColumn("module", F.lit("quarry"))
    return q, route.score_candidates(q, p)


_ROUTE = f"""with {PAGES}, u as (select slug, arg_min(struct_pack(type := type, title := title, tags := tags, modules := modules), doc_id) as p from pages where type in ('project', 'decision', 'methodology', 'synthesis', 'concept') group by 1),
x as (select slug, p.type as type, {_NORM.format("p.title")} as tn, p.modules as modules, {_NORM.format("concat_ws(' ', p.title, '', array_to_string(p.tags, ' '), replace(string_split(slug, '/')[-1], '-', ' '))")} as tk from u),
q as (select id as query_id, {_NORM.format("q")} as qn from (values {_ASKED}) v(id, q)),
s as (select query_id, slug, type, list_contains(modules, 'quarry') as modm, length(replace(tn, ' ', '')) >= 4 and not list_contains(list_concat({_LATIN_STOP}, {_CJK_STOP}), replace(tn, ' ', '')) and contains(qn, tn) as t,
  list_intersect({_latin("qn")}, {_latin("tk")}) as la, list_intersect({_grams("qn", 2)}, {_grams("tk", 2)}) as c2, list_intersect({_grams("qn", 4)}, {_grams("tk", 4)}) as c4 from x, q),
f as (select *, len(list_filter(la, lambda w: length(w) >= 5)) > 0 or len(c4) > 0 as anchor, len(c2) >= 2 or len(la) >= 2 as multi, len(la) > 0 or len(c2) > 0 as wk from s),
c as (select query_id, slug, t or anchor or multi as strong, t or anchor or multi or wk as weak, round(case when t then 100 else 0 end + case when anchor then 70 else 0 end + case when multi then 55 else 0 end + case when not (t or anchor or multi) and wk then 20 else 0 end
  + case when (t or anchor or multi or wk) and modm then 6 else 0 end + case when (t or anchor or multi or wk) and type = 'decision' then 2 else 0 end + 0.5, 4)::double as route_score from f)"""


@query(f"{_ROUTE} select query_id, slug, route_score, strong from c where weak")
def route_scores(spark, d):
    return _routed(spark, d)[1].select("query_id", "slug", "route_score", "strong")


@query(f"{_ROUTE}, nn as (select *, row_number() over (partition by query_id, strong order by route_score desc, slug) as k from c where weak qualify k <= 5), a as (select query_id, bool_or(strong) as s from nn group by 1) select q.query_id, case when a.s then 'read' when a.s is not null then 'review' else 'none' end as action, coalesce((select string_agg(slug, ',' order by k) from nn where nn.query_id = q.query_id and nn.strong = a.s), '') as slugs from q left join a using (query_id)")
def route_decision(spark, d):
    q, c = _routed(spark, d)
    return route.route(q, c).select("query_id", "action", F.array_join("slugs", ",").alias("slugs"))


@query("with q(text) as (values ('review my notes'), ('根据我的记录'), ('不要参考我的记录'), ('never use my notes'), ('hello')) select text, regexp_matches(text, '(?:根据|结合|参考|对照|回顾|梳理|利用|基于)\\s*(?:一下\\s*)?(?:我|我们)(?:的|已有|之前|过去|当前)') or regexp_matches(text, '\\b(?:based on|using|given|consider|review)\\s+(?:my|our)\\b') as asks, regexp_matches(text, '(?:不要|不需要|无需|不用|勿|别|不必|不想|不能)\\s*.{0,12}?(?:根据|基于|参考|结合|利用|对照|回顾|梳理|使用|用)\\s*.{0,8}?(?:我|我们)') or regexp_matches(text, '\\b(?:without|do not|don t|dont|never|no need to)\\b(?:\\s+[a-z]+){0,8}\\s+(?:my|our)\\b') as excludes from q")
def personal_context_intent(spark, d):
    q = spark.createDataFrame([("review my notes",), ("根据我的记录",), ("不要参考我的记录",), ("never use my notes",), ("hello",)], "text string")
    return q.select("text", route.asks_for_personal_context(F.col("text")).alias("asks"), route.excludes_personal_context(F.col("text")).alias("excludes"))


@query(f"with {_VECTOR}, cap as (select query_id, vec_id, label, ql, row_number() over (partition by query_id order by score desc, vec_id::varchar) as r from vs), rel as (select query_id, count(*) as n from vs where label = ql group by 1), g as (select query_id, count(*) filter (r <= 5) as k, min(r) as f, sum(1 / log2(r + 1)) as dcg from cap where r <= 10 and label = ql group by 1) select query_id as case_id, n as n_relevant, round(coalesce(k / n, 0), 6) as recall_at_k, round(coalesce(1 / f, 0), 6) as mrr, round(coalesce(dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))), 0), 6) as ndcg from rel left join g using (query_id)")
def eval_retrieval(spark, d):
    v, q = _vectors(spark, d), _vector_queries(spark, d)
    cap = retrieve.top_k(retrieve.nearest(q, v, 10), 10, F.desc("score"), F.asc("chunk_id")).select(F.col("query_id").alias("case_id"), "rank", "slug")
    rel = v.join(retrieve.stated(q.select("query_id", "label")), "label").select(F.col("query_id").alias("case_id"), "slug")
    return evaluate.retrieval_metrics(cap, rel)


@query(f"with m as ({SQL['eval_retrieval']}), g as (select vec_id as case_id, label from embeddings where vec_id % 100 = 0) select label, count(*) as cases, round(avg(recall_at_k), 6) as mean_recall_at_k, round(avg(mrr), 6) as mean_mrr, round(avg(ndcg), 6) as mean_ndcg, count(*) filter (mrr >= 0.333) as passed from m join g using (case_id) group by 1")
def eval_groups(spark, d):
    groups = _vector_queries(spark, d).select(F.col("query_id").alias("case_id"), F.col("label").alias("group"))
    return evaluate.group_means(eval_retrieval(spark, d), groups, F.col("mrr") >= 0.333).withColumnRenamed("group", "label")


# ---- links and integrity --------------------------------------------------------------------------------------------


def _vault(spark, d):
    """Pages with links: a page's related page and its evidence follow from the slugs of its neighbours in the table; a tenth leads nowhere."""
    p = pages(spark, d).select("doc_id", "slug", "type", "title", "aliases", "body")
    to = F.concat(F.lit("[["), F.when(F.col("doc_id") % 10 == 3, F.lit("methods/absent")).otherwise(F.col("other")), F.lit("]]"))
    other = p.select((F.col("doc_id") - 1).alias("doc_id"), F.col("slug").alias("other"))
    j = p.join(other, "doc_id", "left")
    one = F.when(F.col("other").isNotNull(), F.array(to)).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    return j.withColumn("related", F.when(F.col("doc_id") % 2 == 0, one).otherwise(none)).withColumn("evidence", F.when(F.col("doc_id") % 2 == 1, one).otherwise(none)).withColumn("derived_pages", one).drop("other")


_LINKS = rf"""v as (select a.doc_id, a.slug, a.page_type as type, case when b.slug is null then null when a.doc_id % 10 = 3 then 'methods/absent' else b.slug end as ref from documents a left join documents b on b.doc_id = a.doc_id + 1),
refs as (select slug, 'related' as field, 'related_to' as link_type, ref from v where doc_id % 2 = 0 and type in ('project', 'decision', 'methodology', 'synthesis', 'concept') and ref is not null
  union all select slug, 'evidence', 'derived_from', ref from v where doc_id % 2 = 1 and type in ('project', 'decision', 'methodology', 'synthesis', 'concept') and ref is not null
  union all select slug, 'derived_pages', 'supports', ref from v where type = 'source' and ref is not null),
slugs as (select distinct slug from documents), bases as (select string_split(slug, '/')[-1] as base, count(*) as n, min(slug) as only_slug from slugs group by 1),
res as (select refs.*, coalesce(s.slug, case when b.n = 1 then b.only_slug end) as target from refs left join slugs s on s.slug = refs.ref left join bases b on b.base = string_split(refs.ref, '/')[-1])"""


@query(f"with {_LINKS} select distinct slug as src, link_type, target as dst from res where target is not null")
def typed_edges(spark, d):
    return graph.typed_edges(_vault(spark, d))


@query(f"with {_LINKS}, e as (select distinct slug as src, link_type, target as dst from res where target is not null) select src as slug, 'outgoing' as direction, link_type, dst as other from e union all select dst, 'incoming', link_type, src from e")
def related_pages(spark, d):
    return graph.related(graph.typed_edges(_vault(spark, d)))


@query(f"with {_LINKS} select slug, field, ref as reference from res where target is null")
def dangling_references(spark, d):
    v = _vault(spark, d)
    return graph.resolve(graph.references(v), v).where("target is null").select("slug", "field", F.regexp_replace("reference", "[\\[\\]]", "").alias("reference"))


@query(f"with {_LINKS}, e as (select distinct slug as src, link_type, target as dst from res where target is not null) select src, link_type, dst from e where not exists (select 1 from e b where b.src = e.dst and b.dst = e.src and b.link_type = case e.link_type when 'derived_from' then 'supports' when 'supports' then 'derived_from' else 'related_to' end)")
def one_sided_links(spark, d):
    return graph.one_sided(graph.typed_edges(_vault(spark, d)))


@query("with n as (select distinct slug as owner, lower(trim(regexp_extract(regexp_extract(replace(text, chr(13) || chr(10), chr(10)), '(?s)\\A---\\n(.*?)\\n---(?:\\n|\\z)', 1), '(?m)^title:[ \\t]*(.*)$', 1), ' ')) as name from documents) select name, count(distinct owner) as owners, min(owner) as first_owner from n where name <> '' group by 1 having count(distinct owner) > 1")
def duplicate_names(spark, d):
    return graph.duplicate_names(pages(spark, d).select(F.col("slug").alias("owner"), F.col("title").alias("name")))


@query()
def vault_violations(spark, d):
    p = markdown.parse_pages(table(spark, d, "documents").select("doc_id", "slug", "text")).select(F.concat("slug", F.lit(".md")).alias("path"), "page.*").groupBy("path").agg(F.min_by(F.struct("fields", "body", "title", "type", "aliases", "related", "evidence", "derived_pages"), "body").alias("x")).select("path", "x.*")
    return graph.violations(p).groupBy("code").agg(F.count("*").alias("n"))


@query("with recursive e as (select distinct lower(string_split(page_type, '/')[1]) as src, lower(domain) as dst from documents where domain is not null), w as (select distinct domain as src, source as dst from documents where domain is not null and source is not null), edges as (select src, dst from e union select src, dst from w), r(node) as (select 'concept' union select dst from edges, r where edges.src = r.node) select node from r")
def import_closure(spark, d):
    docs = table(spark, d, "documents").where("domain is not null")
    edges = docs.select(F.lower("page_type").alias("src"), F.lower("domain").alias("dst")).union(docs.where("source is not null").select("domain", "source")).distinct()
    return graph.closure(edges, spark.createDataFrame([("concept",)], "node string")).select("node")


@query(f"with {PAGES}, p as (select doc_id, replace(replace(replace(coalesce(title, slug), chr(92), chr(92) || chr(92)), '[', chr(92) || '['), ']', chr(92) || ']') as label, maturity, array_to_string(modules, ',') as mods, domain, updated from pages) select doc_id, label, concat_ws(' · ', case when maturity <> '' then '`maturity:' || maturity || '`' end, case when mods <> '' then '`modules:' || mods || '`' end, case when domain <> '' then '`domain:' || domain || '`' end, case when updated <> '' then '`updated:' || updated || '`' end) as line from p")
def navigation_labels(spark, d):
    p = pages(spark, d)
    return p.select("doc_id", text.markdown_label(F.coalesce("title", "slug")).alias("label"), text.navigation_metadata(F.col("maturity"), F.col("modules"), F.col("domain"), F.lit(None).cast("string"), F.col("updated")).alias("line"))


@query("select slug, page_type as type, updated_at from documents where page_type in ('project', 'decision') order by updated_at desc nulls last, slug limit 100")
def listed_pages(spark, d):
    p = table(spark, d, "documents").select("slug", F.col("page_type").alias("type"), F.lit(None).cast("string").alias("title"), "updated_at")
    return retrieve.list_pages(p, ["project", "decision"], 100).drop("title")


@query(f"with {PAGES} select type, slug, '[[' || slug || ']] ' || coalesce(title, '') as line from pages")
def navigation_index(spark, d):
    return pages(spark, d).select("type", "slug", F.concat(F.lit("[["), F.col("slug"), F.lit("]] "), F.coalesce("title", F.lit(""))).alias("line")).orderBy("type", "slug")


@query()
def navigation_lines(spark, d):
    return graph.navigation(pages(spark, d))


# ---- ingestion ------------------------------------------------------------------------------------------------------

_DIR = "case when coalesce(sender_id, '') = '' or coalesce(self_id, '') = '' then 'ambiguous' when sender_id = self_id then 'self' else 'other' end"
_FP = "sha256(" + " || chr(31) || ".join(f"coalesce({c}, '')" for c in ("source", "shard", "row_id", "timestamp", "sender_id", "kind", "text", "quoted_text", "forwarded_context")) + ")"


@query(f"select 'rec_' || substr(sha256({_FP}), 1, 20) as record_id, {_FP} as source_fingerprint, concat_ws('/', source, shard, row_id) as source_locator, timestamp, conversation_id, {_DIR} as direction, case when {_DIR} = 'ambiguous' then 'unknown' else {_DIR} end as author_scope, coalesce(text, '') as authored_text, coalesce(quoted_text, '') as quoted_text, quoted_author, coalesce(forwarded_context, '') as forwarded_context, coalesce(kind, 'text') as message_kind, case when coalesce(text, '') <> '' then 'verbatim' else 'metadata_only' end as evidence_precision, 'raw_local' as redaction_status from synthetic_rows")
def normalize_messages(spark, d):
    return ingest.normalize_rows(table(spark, d, "synthetic_rows"))


@query(f"with a as (select {_FP} as k, count(*) as n from synthetic_rows group by 1), b as (select {_FP} as k, count(*) as n from (select distinct * exclude (loaded_at) from synthetic_rows where row_id <> '7') group by 1) select sum(greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0))::bigint as missing, sum(greatest(coalesce(b.n, 0) - coalesce(a.n, 0), 0))::bigint as unexpected from a full join b using (k)")
def coverage_bags(spark, d):
    rows = table(spark, d, "synthetic_rows")
    kept = rows.where("row_id <> '7'").drop("loaded_at").distinct()
    return ingest.coverage(rows.select(ingest.fingerprint().alias("source_fingerprint")), kept.select(ingest.fingerprint().alias("source_fingerprint")))


@query(r"with x as (select row_no, case when regexp_matches(message_content, '\A[^:\r\n]+:(?:\r?\n|\\n)') then regexp_extract(message_content, '\A([^:\r\n]+):(?:\r?\n|\\n)', 1) end as sender, case when regexp_matches(message_content, '\A[^:\r\n]+:(?:\r?\n|\\n)') then regexp_extract(message_content, '(?s)\A[^:\r\n]+:(?:\r?\n|\\n)(.*)\z', 1) else message_content end as text from message where conversation_id like '%@chatroom' and is_sender = 0) select row_no, sender, text from x")
def group_sender_split(spark, d):
    m = table(spark, d, "message").where("conversation_id like '%@chatroom' and is_sender = 0")
    sender, rest = ingest.split_group_sender(F.col("message_content"))
    return m.select("row_no", sender.alias("sender"), rest.alias("text"))


_XML = r"""b as (select row_no, local_type, case when conversation_id like '%@chatroom' and regexp_matches(coalesce(message_content, ''), '\A[^:\r\n<]+:\n') then regexp_extract(message_content, '(?s)\A[^:\r\n<]+:\n(.*)\z', 1) else coalesce(message_content, '') end as c from message),
x as (select *, regexp_matches(c, '(?s)\A\s*<msg[\s>].*</msg>\s*\z') as xml from b),
w as (select *, case local_type when 3 then 'image' when 34 then 'voice' when 49 then case when not xml then 'text' else case regexp_extract(c, '<type>(.*?)</type>', 1) when '57' then 'quote' when '6' then 'attachment' when '19' then 'forward' else 'app' end end else 'text' end as k from x)"""


def _plain_sql(x: str) -> str:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


def _parts(spark, d):
    m = table(spark, d, "message")
    own = F.when(F.col("conversation_id").endswith("@chatroom") & F.col("message_content").rlike("\\A[^:\\r\\n<]+:\\n"), F.regexp_extract("message_content", "(?s)\\A[^:\\r\\n<]+:\\n(.*)\\z", 1)).otherwise(F.col("message_content"))
    return ingest.message_parts(m.select("row_no", "local_type", own.alias("c")), "c", keep=["row_no"])


@query(rf"with {_XML} select row_no, k as message_kind, case when k in ('image', 'voice') then '' when k in ('quote', 'forward') then {_plain_sql('regexp_extract(c, ' + chr(39) + '(?s)<title>(.*?)</title>' + chr(39) + ', 1)')} when k = 'attachment' then {_plain_sql('regexp_extract(c, ' + chr(39) + '(?s)<des>(.*?)</des>' + chr(39) + ', 1)')} when k = 'app' then regexp_extract(c, '(?s)<title>(.*?)</title>', 1) else c end as text, case when k = 'quote' then {_plain_sql('regexp_extract(c, ' + chr(39) + '(?s)<content>(.*?)</content>' + chr(39) + ', 1)')} else '' end as quoted_text, k in ('image', 'voice', 'attachment') as media_expected from w")
def message_parts(spark, d):
    return _parts(spark, d).select("row_no", "message_kind", "text", "quoted_text", "media_expected")


@query(rf"""with {_XML}, f as (select k, case when k in ('image', 'voice') and xml then regexp_extract(c, 'filename="([^"]*)"', 1) when k = 'attachment' then regexp_extract(c, '<title>(.*?)</title>', 1) end as n from w where k in ('image', 'voice', 'attachment'))
select count(*) as expected, count(*) filter (regexp_matches(n, '[02468]\.[a-z]+$')) as available, count(*) filter (not coalesce(regexp_matches(n, '[02468]\.[a-z]+$'), false)) as missing from f""")
def media_coverage(spark, d):
    parts = _parts(spark, d)
    stored = parts.where(F.col("media_name").rlike("[02468]\\.[a-z]+$")).select(F.upper("media_name").alias("basename")).distinct().withColumn("media_ref", F.col("basename"))
    return ingest.media_coverage(ingest.with_media(parts, stored))


@query("with w as (select conversation_id, arg_max(struct_pack(s := sort_seq, l := local_id), sort_seq * 1000000 + local_id) as m from message where batch_id < 'batch-003' group by 1) select row_no from message left join w using (conversation_id) where sort_seq > coalesce(m.s, -1) or (sort_seq = coalesce(m.s, -1) and local_id > coalesce(m.l, -1))")
def watermark_increment(spark, d):
    m = table(spark, d, "message")
    marks = ingest.watermarks(m.where("batch_id < 'batch-003'"), ["conversation_id"], ["sort_seq", "local_id"])
    return ingest.after_watermark(m, marks, ["conversation_id"], ["sort_seq", "local_id"]).select("row_no")


@query("with c as (select distinct id, username from contact), m as (select distinct room_id, member_id from chatroom_member) select r.id as room_id, r.username as room, c.username as member_name from (select distinct id, username from chat_room) r left join (select distinct m.room_id, c.username from m join c on c.id = m.member_id) c on c.room_id = r.id")
def room_members(spark, d):
    return ingest.members(table(spark, d, "chat_room"), table(spark, d, "chatroom_member"), table(spark, d, "contact"))


@query("select conversation_id, 'Msg_' || md5(conversation_id) as shard, count(*) as n from message where conversation_id in (select username from contact) group by 1")
def shard_sessions(spark, d):
    from tessera.sources.tables import shard_name

    m = table(spark, d, "message").select(shard_name(F.col("conversation_id")).alias("shard"))
    s = table(spark, d, "contact").select(F.col("username").alias("conversation_id"), shard_name(F.col("username")).alias("shard")).distinct()
    return m.join(s, "shard").groupBy("conversation_id", "shard").agg(F.count("*").alias("n"))


@query("select row_no, real_sender_id, (select min(nickname) from contact c where c.username = real_sender_id and nickname <> '') as display from message")
def sender_display(spark, d):
    names = table(spark, d, "contact").where("nickname <> ''").groupBy(F.col("username").alias("real_sender_id")).agg(F.min("nickname").alias("display"))
    return table(spark, d, "message").select("row_no", "real_sender_id").join(names, "real_sender_id", "left")


@query("with a as (select username, unnest([username, nickname, remark, alias]) as alias from contact where coalesce(username, '') <> ''), b as (select trim(alias, ' ') as alias, min(username) as u from a where length(trim(alias, ' ')) >= 2 group by 1) select alias, '[IDENTITY_' || upper(substr(sha256(u), 1, 10)) || ']' as token from b")
def identity_aliases(spark, d):
    return ingest.identity_aliases(table(spark, d, "contact"))


@query()
def identities_replaced(spark, d):
    m = table(spark, d, "message").select("row_no", "message_content")
    return ingest.replace_identities(m, ["message_content"], ingest.identity_aliases(table(spark, d, "contact")))


@query(r"with a as (select row_no, coalesce(message_content, '') as t from message), u as (select row_no, t, len(regexp_extract_all(t, '(?i)https?://[^\s<>()]+')) as urls from a) select row_no, urls from u where urls > 0")
def redaction_urls(spark, d):
    m = table(spark, d, "message")
    return m.select("row_no", F.regexp_count(F.coalesce("message_content", F.lit("")), F.lit(dict(ingest.PATTERNS)["url"])).cast("long").alias("urls")).where("urls > 0")


@query()
def redaction_counts(spark, d):
    out, counts = ingest.redact(F.col("message_content"))
    return table(spark, d, "message").select("row_no", out.alias("text"), *[c.alias(k) for k, c in counts.items()])


@query("select source, shard, row_id, conversation_id, try_cast(row_id as bigint) as n from synthetic_rows")
def exchange_order(spark, d):
    rows = table(spark, d, "synthetic_rows")
    return rows.select("source", "shard", "row_id", "conversation_id", F.col("row_id").try_cast("bigint").alias("n")).orderBy("source", "shard", "conversation_id", "n")


@query("select capability, count(*) as n from (select 'messages' as capability from message union all select 'evidence' from evidence union all select 'places' from places) group by 1")
def union_sources(spark, d):
    from tessera.sources.tables import union_optional

    base = table(spark, d, "message").select(F.col("message_content").alias("text"))
    return union_optional(base, {"evidence": table(spark, d, "evidence").select(F.col("summary").alias("text")), "places": table(spark, d, "places").select(F.col("canonical").alias("text")), "moments": None}).groupBy("capability").agg(F.count("*").alias("n"))


@query("with t as (select timestamp as raw from synthetic_rows), k as (select raw, case when regexp_matches(raw, '^\\d{10}$') then strftime(to_timestamp(raw::bigint) at time zone 'UTC', '%Y-%m-%dT%H:%M:%SZ') when regexp_matches(raw, '^\\d{13}$') then strftime(to_timestamp(raw::bigint // 1000) at time zone 'UTC', '%Y-%m-%dT%H:%M:%SZ') when regexp_matches(raw, '([Zz]|[+-]\\d{2}:?\\d{2})$') and try_cast(raw as timestamptz) is not null then strftime(try_cast(raw as timestamptz) at time zone 'UTC', '%Y-%m-%dT%H:%M:%SZ') end as iso from t) select raw, iso, count(*) as n from k group by 1, 2")
def normal_times(spark, d):
    return table(spark, d, "synthetic_rows").select(F.col("timestamp").alias("raw"), ingest.normal_time(F.col("timestamp")).alias("iso")).groupBy("raw", "iso").agg(F.count("*").alias("n"))


@query(r"with k as (select package_id, list_sort(list_distinct(list_filter(regexp_extract_all(body, '\"([A-Za-z0-9_]+)\"\s*:', 1), lambda x: regexp_matches(x, '(password|secret|token|private_key|api_key|_private_path)$')))) as f from assets) select package_id, array_to_string(f, ',') as keys from k where len(f) > 0".replace('\\"', '"'))
def forbidden_keys(spark, d):
    a = table(spark, d, "assets").select("package_id", ingest.forbidden_keys(F.col("body")).alias("f")).where(F.size("f") > 0)
    return a.select("package_id", F.array_join("f", ",").alias("keys"))


# ---- event ledgers, places, runtime ---------------------------------------------------------------------------------

_ROUTES = """rr as (select route_id, arg_min(struct_pack(domain := domain, p := processing_disposition, events := events, at := routed_at), routed_at) as r from routed_episodes group by 1),
routes as (select route_id, r.domain as domain, r.p as processing_disposition, r.events as events, r.at as routed_at from rr),
ev0 as (select route_id, domain, unnest(events) as e, generate_subscripts(events, 1) - 1 as pos from routes),
ev as (select route_id || '/' || lpad(pos::varchar, 4, '0') as event_id, route_id, domain, pos::int as pos, e.subject as subject, e.disposition as disposition, e.title as title, e.summary as summary, e.importance as importance, e.asserted_event_time.value as asserted, e.evidence_ids as evidence_ids, e.place_ids as place_ids from ev0 where e is not null)"""


def _routes(spark, d):
    return ledger.routes(table(spark, d, "routed_episodes"))


def _events(spark, d):
    return ledger.events(_routes(spark, d))


@query(f"with {_ROUTES} select event_id, route_id, domain, pos, subject, disposition, title, importance, asserted from ev")
def event_rows(spark, d):
    return _events(spark, d).select("event_id", "route_id", "domain", "pos", "subject", "disposition", "title", "importance", "asserted")


@query(f"with {_ROUTES} select (select count(*) from routes) as route_count, (select count(*) from routes where processing_disposition = 'no_signal') as no_signal_count, (select count(*) from ev) as event_count, (select count(*) from ev where subject = 'self') as subject_event_count")
def ledger_totals(spark, d):
    return ledger.totals(_routes(spark, d), _events(spark, d))


_EXPECTED = """ex as (select distinct domain, case when domain = 'health' then null when domain = 'work' and right(route_id, 1) = '7' then route_id || '-x' else route_id end as route_id from routed_episodes where domain is not null)"""


def _expected(spark, d):
    r = F.when(F.col("domain") == "health", None).when((F.col("domain") == "work") & F.col("route_id").endswith("7"), F.concat("route_id", F.lit("-x"))).otherwise(F.col("route_id"))
    return table(spark, d, "routed_episodes").where("domain is not null").select("domain", r.alias("route_id")).distinct()


@query(f"with {_ROUTES}, {_EXPECTED}, j as (select ex.domain, ex.route_id, r.route_id as seen, coalesce(r.processing_disposition = 'insufficient_evidence', false) as thin from ex left join routes r on r.domain = ex.domain and r.route_id = ex.route_id), g as (select domain, count(route_id) as expected, count(seen) as processed, bool_or(thin) as thin from j group by 1) select domain, expected, processed, expected - processed as missing, case when expected = 0 then 'not_extracted' when expected > processed then 'partial' when thin then 'ambiguous' else 'complete' end as status from g")
def domain_coverage(spark, d):
    return ledger.domain_coverage(_routes(spark, d), _expected(spark, d))


@query(f"with {_ROUTES}, {_EXPECTED} select domain, route_id from ex where route_id is not null and route_id not in (select route_id from routes)")
def missing_routes(spark, d):
    return ledger.missing_routes(_routes(spark, d), _expected(spark, d))


@query(f"with {_ROUTES}, u as (select distinct event_id, route_id, unnest(evidence_ids) as id from ev) select event_id, id from u where id is not null and not exists (select 1 from evidence v where v.evidence_id = u.id and v.domain = split_part(u.route_id, '-', 2))")
def allowlist_violations(spark, d):
    e = _events(spark, d)
    by_domain = table(spark, d, "evidence").where("domain is not null").select("domain", F.col("evidence_id").alias("id")).distinct()
    used = e.select("event_id", F.split("route_id", "-")[1].alias("route_id"), "evidence_ids")
    return ledger.outside_allowlist(used, by_domain.withColumnRenamed("domain", "route_id"))


@query("select domain, count(*) as n from (select route_id, count(distinct domain) as n, min(domain) as domain from routed_episodes group by 1 having count(distinct domain) > 1) group by 1")
def routes_in_several_domains(spark, d):
    r = table(spark, d, "routed_episodes")
    return ledger.several_domains(r).join(r.groupBy("route_id").agg(F.min("domain").alias("domain")), "route_id").groupBy("domain").agg(F.count("*").alias("n"))


@query("with p as (select 'a' as part, route_id, domain from routed_episodes where domain in ('travel', 'work') union all select 'b', route_id, domain from routed_episodes where domain in ('work', 'health')) select 'domain' as kind, domain as key from p group by domain having count(distinct part) > 1 union all select 'route', route_id from p group by route_id having count(*) > 1")
def merged_ledger_conflicts(spark, d):
    r = table(spark, d, "routed_episodes").select("route_id", "domain")
    return ledger.merge_ledgers({"a": r.where("domain in ('travel', 'work')"), "b": r.where("domain in ('work', 'health')")})[1]


@query(f"with {_ROUTES} select event_id, importance from ev where subject = 'self' and importance >= 0.6")
def biography_view(spark, d):
    return _events(spark, d).where("subject = 'self' and importance >= 0.6").select("event_id", "importance").orderBy(F.desc("importance"), "event_id")


@query("with l as (select user_id, arg_max(struct_pack(t := event_type, v := value), event_id) as x, count(*) as n from events group by 1) select user_id, x.t as event_type, x.v as value, n as n_events from l")
def ledger_latest_state(spark, d):
    return ledger.latest(table(spark, d, "events"), "user_id", ["event_id"], "event_type", "value")


@query("with e as (select user_id, min(event_id) as m from events where event_type = 'purchase' and value > 60 group by 1) select events.event_id, events.user_id from events join e using (user_id) where event_id > m")
def events_after_terminal(spark, d):
    return ledger.after_terminal(table(spark, d, "events"), "user_id", "event_id", (F.col("event_type") == "purchase") & (F.col("value") > 60)).select("event_id", "user_id")


@query("with recursive o as (select event_id, user_id, sha256(event_id::varchar || chr(31) || coalesce(event_type, '')) as own, row_number() over (partition by user_id order by event_id) as r from events), c as (select event_id, user_id, r, null::varchar as previous_hash, sha256(chr(31) || own) as event_hash from o where r = 1 union all select o.event_id, o.user_id, o.r, c.event_hash, sha256(c.event_hash || chr(31) || o.own) from c join o on o.user_id is not distinct from c.user_id and o.r = c.r + 1) select event_id, previous_hash, event_hash from c")
def hash_chain(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", "event_type")
    return ledger.chain(events, "user_id", "event_id", "event_id", "event_type").select("event_id", "previous_hash", "event_hash")


@query("select event_id from events where event_id % 97 = 0 or event_id % 89 = 0")
def broken_chain_links(spark, d):
    """A sealed log in which some events were changed afterwards and some lead elsewhere."""
    events = table(spark, d, "events").select("event_id", "user_id", "event_type")
    sealed = ledger.chain(events, "user_id", "event_id", "event_id", "event_type")
    changed = sealed.withColumn("event_type", F.when(F.col("event_id") % 97 == 0, "changed").otherwise(F.col("event_type"))).withColumn("previous_hash", F.when(F.col("event_id") % 89 == 0, F.lit("elsewhere")).otherwise(F.col("previous_hash")))
    return ledger.broken_links(changed, "user_id", "event_id", "event_id", "event_type").select("event_id")


@query("with p as (select user_id, event_id, case when event_id % 50 = 0 then -1 else lag(event_id) over (partition by user_id order by event_id) end as parent, lag(event_id) over (partition by user_id order by event_id) as b, row_number() over (partition by user_id order by event_id) as r from events) select user_id, count(*) as n_links, count(*) filter (r > 1 and parent is distinct from b) as n_breaks, count(*) filter (r > 1 and parent is distinct from b) = 0 and count(*) <= 256 as valid from p group by 1")
def parent_chain_check(spark, d):
    e = table(spark, d, "events").withColumn("parent", F.when(F.col("event_id") % 50 == 0, F.lit(-1)).otherwise(F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))))
    return ledger.parents_in_line(e, "user_id", "event_id", "event_id", "parent")


@query("with u as (select o_orderkey as unit, list(l_partkey % 40) as deps from orders join lineitem on l_orderkey = o_orderkey group by 1), a as (select i from range(0, 38) t(i)) select unit from u where not exists (select 1 from (select unnest(u.deps) as x) where x not in (select i from a))")
def dependency_gate(spark, d):
    u = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_orderkey").alias("unit")).agg(F.collect_set(F.col("l_partkey") % 40).alias("dependencies"))
    return ledger.ready(u, spark.range(0, 38).select(F.col("id").alias("unit"))).select("unit")


@query("with s as (select user_id, arg_max(struct_pack(status := event_type, lease := ts + interval 900 second), event_id) as x from events group by 1), n as (select max(ts) as now from events) select x.status as status, count(*) as n, count(*) filter (x.status = 'click' and x.lease >= now) as live, count(*) filter (x.status = 'click' and not coalesce(x.lease >= now, false)) as expired from s, n group by 1")
def status_counts(spark, d):
    e = table(spark, d, "events")
    last = ledger.latest(e.withColumn("status", F.col("event_type")).withColumn("lease_until", F.col("ts") + F.expr("interval 900 seconds")), "user_id", ["event_id"], "status", "lease_until")
    now = e.agg(F.max("ts").alias("now"))
    return ledger.status_counts(last.crossJoin(F.broadcast(now)), F.col("now"), "click")  # one row


@query("select count(*) as failures, count(*) >= 3 as repeated, case when count(*) >= 3 then max(ts) + interval 60 second end as cooldown_until from events where event_type = 'error' and ts is not null")
def failure_cooldown(spark, d):
    return ledger.cooldown(table(spark, d, "events"), F.col("event_type") == "error", "ts")


@query("select distinct route_id, domain, coalesce(list_position(['travel', 'education', 'work', 'relationship', 'residence', 'family', 'health', 'finance', 'creation'], domain), 10)::int - 1 as domain_index from routed_episodes")
def domain_order(spark, d):
    return ledger.in_domain_order(table(spark, d, "routed_episodes").select("route_id", "domain").distinct())


@query("select count(*) filter (event_type <> 'view') as assessed, count(*) filter (event_type <> 'view' and event_type = 'error') as rejected, count(*) filter (event_type <> 'view') >= 3 and count(*) filter (event_type = 'error') / count(*) filter (event_type <> 'view') >= 0.67 as systemic from events")
def rejected_share(spark, d):
    return ledger.shares(table(spark, d, "events"), F.col("event_type") != "view", F.col("event_type") == "error")


@query("select user_id, arg_min(value, event_id) as first, arg_max(value, event_id) as last, count(*) as n, round(arg_max(value, event_id) - arg_min(value, event_id), 6) as delta from events group by 1")
def first_last_trend(spark, d):
    return ledger.trend(table(spark, d, "events"), "user_id", "event_id", "value")


def _mentions(spark, d):
    p = table(spark, d, "places")
    mentions = p.select("place_id", F.concat(F.lit(" "), F.upper("canonical")).alias("raw")).distinct()
    candidates = p.select("place_id", "canonical", "kind").distinct().select(F.concat(F.lit("cand-"), "place_id", F.lit("-"), "kind", F.lit("-"), "canonical").alias("candidate_id"), F.col("canonical").alias("raw"), "canonical", "kind", (F.col("kind") != "other").alias("safe"))
    return mentions.where("raw is not null"), candidates.where("canonical is not null")


@query("with m as (select distinct place_id, ' ' || upper(canonical) as raw from places where canonical is not null), c as (select distinct 'cand-' || place_id || '-' || kind || '-' || canonical as candidate_id, canonical, kind, kind <> 'other' as safe from places where canonical is not null), g as (select lower(trim(canonical, ' ')) as k, count(*) filter (safe) as n, arg_min(struct_pack(id := candidate_id, c := canonical, kind := kind), candidate_id) filter (safe) as one, list_sort(list(distinct candidate_id) filter (candidate_id is not null)) as ids from c group by 1) select place_id, raw, case when n = 1 then one.c end as canonical, case when n = 1 then one.kind else 'ambiguous' end as kind, case when n = 1 then 'applied' else 'ambiguous' end as status, array_to_string(case when n = 1 then [one.id] else coalesce(ids, []) end, ',') as candidate_ids from m left join g on k = lower(trim(raw, ' '))")
def place_normalize(spark, d):
    m, c = _mentions(spark, d)
    return places.normalize(m, c, False).withColumn("candidate_ids", F.array_join("candidate_ids", ","))


@query(f"with {_ROUTES}, o as (select route_id, unnest(place_ids) as place_id from ev where subject = 'self' and disposition in ('occurred', 'completed')), p as (select distinct place_id, canonical from places where kind = 'country') select canonical, count(distinct route_id) as n_routes from o join p using (place_id) group by 1")
def visited_countries(spark, d):
    return places.visited(_events(spark, d), table(spark, d, "places"))


@query(f"with {_ROUTES}, u as (select event_id, unnest(place_ids) as place_id, (generate_subscripts(place_ids, 1) - 1)::int as pos from ev), p as (select place_id, min(canonical) as canonical, min(kind) as kind from places group by 1) select event_id, pos, u.place_id, canonical, kind from u left join p using (place_id) where u.place_id is not null")
def event_places(spark, d):
    return places.with_places(_events(spark, d), table(spark, d, "places"))


def _tok(x: str) -> str:
    return rf"list_distinct(list_concat(regexp_extract_all({x}, '[a-z0-9]+'), flatten(list_transform(regexp_extract_all({x}, '[\x{{3400}}-\x{{4dbf}}\x{{4e00}}-\x{{9fff}}]+'), lambda r: list_concat(list_transform(range(1, length(r) + 1), lambda i: substr(r, i::bigint, 1)), list_transform(range(1, length(r)), lambda i: substr(r, i::bigint, 2)))))))"


@query(f"with {_ROUTES}, q as (select id as query_id, {_tok('lower(q)')} as t from (values {_ASKED}) v(id, q)), dd as (select event_id as slug, {_tok(chr(108) + 'ower(concat_ws(' + chr(39) + ' ' + chr(39) + ', title, summary, domain, disposition))')} as t from ev where subject = 'self'), s as (select query_id, slug, round(case when len(q.t) = 0 then 1.0 else len(list_intersect(q.t, dd.t)) / len(q.t) end, 6) as score from dd, q) select query_id, slug, score::double as score, row_number() over (partition by query_id order by score desc, slug)::int as rank from s where score > 0 qualify rank <= 10")
def runtime_topk(spark, d):
    e = _events(spark, d).where(runtime.filters(subject="self"))
    words = F.lower(F.concat_ws(" ", "title", "summary", "domain", "disposition"))
    q = asked(spark).withColumn("query", F.lower("query"))
    return runtime.search(e, "event_id", words, q, folded=True)


@query(f"with {_ROUTES} select event_id from ev where domain in ('travel', 'work') and asserted like '2024%' and disposition = 'occurred'")
def runtime_filters(spark, d):
    return _events(spark, d).where(runtime.filters(domains=["travel", "work"], disposition="occurred", year="2024")).select("event_id")


@query("select evidence_id from evidence where coalesce(active, true) and domain in ('travel', 'health')")
def evidence_filters(spark, d):
    return table(spark, d, "evidence").where(runtime.filters(domains=["travel", "health"], active=F.col("active"))).select("evidence_id")


@query(f"with {_ROUTES}, {_EXPECTED}, q as (select id as query_id, {_tok('lower(q)')} as t from (values {_ASKED}) v(id, q)), h as (select distinct query_id from q where exists (select 1 from (select {_tok('lower(summary)')} as t from evidence where domain = 'health') e where len(list_intersect(e.t, q.t)) > 0)) select q.query_id, case when h.query_id is not null then 'grounded' else 'unknown' end as answer_status, case when h.query_id is null then 'domain_not_extracted' end as reason from q left join h using (query_id)")
def runtime_answers(spark, d):
    q = asked(spark).withColumn("query", F.lower("query"))
    hits = runtime.search(table(spark, d, "evidence").where(runtime.filters(domains=["health"])), "evidence_id", F.lower("summary"), q, folded=True)
    return runtime.answers(q, hits, ledger.domain_coverage(_routes(spark, d), _expected(spark, d)), ["health"])


# ---- packing, chunks ------------------------------------------------------------------------------------------------


@query("with x as (select doc_id, text as t, length(text) as n from documents where length(text) > 0), c as (select doc_id, t, n, unnest(range(0, greatest(0, n - 161) + 1, 1040)) as s from x) select doc_id, (s // 1040)::int as chunk_index, s::int as start, least(s + 1200, n)::int as end, substr(t, (s + 1)::bigint, 1200) as chunk_text from c")
def chunk_windows_fixed(spark, d):
    return packing.fixed_chunks(table(spark, d, "documents"), "text", ["doc_id"])


@query()
def chunk_windows_boundary(spark, d):
    return packing.chunk_texts(table(spark, d, "documents"), "text", ["doc_id"])


@query()
def packet_packing(spark, d):
    docs = table(spark, d, "documents").withColumn("bytes", F.octet_length(F.coalesce("text", F.lit(""))).cast("long"))
    return packing.pack(docs, "source", ["doc_id"], "bytes", 16000, ["doc_id", "source", "bytes"])


@query()
def compacted_records(spark, d):
    return packing.compact(table(spark, d, "documents"), "doc_id", "text", 2000)


@query("with s as (select coalesce(page_type, '') as page_type, unnest(string_split(text, '')) as c from documents where text <> ''), n as (select page_type, c, count(*) as n from s group by all), t as (select page_type, sum(n)::bigint as n_symbols, sum(n * log2(n)) as x from n group by 1) select page_type, n_symbols, round(log2(n_symbols) - x / n_symbols, 6) as entropy from t")
def entropy_by_group(spark, d):
    docs = table(spark, d, "documents").where("text <> ''").select(F.coalesce("page_type", F.lit("")).alias("page_type"), "text")
    return files.entropy(docs, "page_type", F.split("text", ""))


@query("select count(*) as n, sum(case when regexp_matches(lower(file), '\\.(jpg|jpeg|png|gif|webp|dat)$') then 1 else 0 end)::bigint as image, sum(case when regexp_matches(lower(file), '\\.(silk|aud|wav|m4a|mp3)$') then 1 else 0 end)::bigint as voice from (select regexp_extract(message_content, 'filename=\"([^\"]*)\"', 1) as file from message where local_type in (3, 34))".replace('\\"', '"'))
def media_kinds(spark, d):
    m = table(spark, d, "message").where("local_type in (3, 34)").select(files.media_kind(F.regexp_extract("message_content", 'filename="([^"]*)"', 1)).alias("k"))
    return m.agg(F.count("*").alias("n"), F.count_if(F.col("k") == "image").alias("image"), F.count_if(F.col("k") == "voice").alias("voice"))


# ---- histories and change sets --------------------------------------------------------------------------------------


@query("with new as (select c_custkey * 2 as k, 'new' as v from customer) select k, v from (select c_custkey as k, c_mktsegment as v from customer union all select k, v from new where k not in (select c_custkey from customer))")
def insert_only_update(spark, d):
    base = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    return history.insert_only(base, base.select((F.col("k") * 2).alias("k"), F.lit("new").alias("v")), "k")[0]


@query("select c_custkey as k, case when c_custkey % 7 = 0 then 'CORRECTED' else c_mktsegment end as v from customer")
def corrected_rows(spark, d):
    base = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    return history.correct(base, base.where("k % 7 = 0").select("k", F.lit("CORRECTED").alias("v")), "k", ["v"])


@query("select evidence_id, domain, case when domain = 'travel' then false else active end as active from evidence")
def withdrawn_sources(spark, d):
    e = table(spark, d, "evidence").withColumn("source_ids", F.array("domain"))
    return history.withdraw(e, "travel").select("evidence_id", "domain", "active")


@query("select evidence_id, domain, summary from evidence where domain is distinct from 'work' union all select evidence_id, domain, upper(summary) from evidence where domain = 'work'")
def replaced_partition(spark, d):
    e = table(spark, d, "evidence").select("evidence_id", "domain", "summary")
    return history.replace_partition(e, e.withColumn("summary", F.upper("summary")), "domain", "work")


@query("with l as (select user_id, event_id as version, event_type, event_type = 'error' as deleted from events where event_id <= 6000), m as (select * from l qualify row_number() over (partition by user_id order by version desc) = 1) select user_id, version, event_type from m where not deleted")
def state_at_version(spark, d):
    log = table(spark, d, "events").select("user_id", F.col("event_id").alias("version"), "event_type", (F.col("event_type") == "error").alias("deleted"))
    return history.at_version(log, "user_id", 6000).select("user_id", "version", "event_type")


def _change_set(spark, d):
    files_ = table(spark, d, "orders").select(F.concat(F.lit("o/"), F.col("o_orderkey").cast("string")).alias("path"), F.col("o_orderpriority").alias("content"))
    k = F.col("o_orderkey") % 11
    action = F.when(k == 0, "delete").when(k == 1, "update").when(k == 2, "move").when(k == 3, "create")
    target = F.when(k == 3, F.concat(F.lit("n/"), F.col("o_orderkey").cast("string"))).otherwise(F.concat(F.lit("o/"), F.col("o_orderkey").cast("string")))
    c = table(spark, d, "orders").select(F.col("o_orderkey").alias("ord"), action.alias("action"), target.alias("target"), F.when(k == 2, F.concat(F.lit("m/"), F.col("o_orderkey").cast("string"))).alias("new_target"), F.when(k.isin(1, 3), "changed").alias("content")).where("action is not null")
    return files_, c


@query("with o as (select o_orderkey as k, o_orderpriority as p from orders) select 'o/' || k as path, case when k % 11 = 1 then 'changed' else p end as content from o where k % 11 not in (0, 2) union all select 'm/' || k, p from o where k % 11 = 2 union all select 'n/' || k, 'changed' from o where k % 11 = 3")
def applied_changes(spark, d):
    f, c = _change_set(spark, d)
    return history.apply_changes(f, c)


@query("with o as (select o_orderkey as k from orders) select 'o/' || k as target, 'absent' as code from o where k % 11 in (0, 1, 2) and k % 5 = 0 union all select 'm/' || k, 'destination_exists' from o where k % 11 = 2 and k % 3 = 0")
def change_violations(spark, d):
    f, c = _change_set(spark, d)
    key = F.regexp_extract("path", "(\\d+)$", 1).cast("long")
    there = f.where(key % 5 != 0).unionByName(f.where((key % 11 == 2) & (key % 3 == 0)).withColumn("path", F.regexp_replace("path", "^o", "m")))
    return history.change_violations(there, c)


@query("with e as (select o_orderkey as path, md5(o_orderstatus) as sha from orders where o_orderkey % 9 <> 0), c as (select o_orderkey as path, md5(case when o_orderkey % 8 = 0 then 'z' else o_orderstatus end) as sha from orders where o_orderkey % 10 <> 0) select coalesce(e.path, c.path) as path, case when e.path is null then 'appeared' when c.path is null then 'vanished' else 'changed' end as state from e full join c on e.path = c.path where e.path is null or c.path is null or e.sha <> c.sha")
def stale_preconditions(spark, d):
    o = table(spark, d, "orders")
    e = o.where("o_orderkey % 9 <> 0").select(F.col("o_orderkey").alias("path"), F.md5("o_orderstatus").alias("sha"))
    c = o.where("o_orderkey % 10 <> 0").select(F.col("o_orderkey").alias("path"), F.md5(F.when(F.col("o_orderkey") % 8 == 0, "z").otherwise(F.col("o_orderstatus"))).alias("sha"))
    return history.stale(e, c)


@query("with f as (select event_id, user_id, (row_number() over (partition by user_id, event_type order by event_id) = 1)::int as f from events) select event_id, sum(f) over (partition by user_id order by event_id)::bigint as n_states from f")
def states_so_far(spark, d):
    return history.states_so_far(table(spark, d, "events"), "user_id", "event_id", "event_type").select("event_id", "n_states")


@query("with a as (select distinct o_custkey as k from orders), b as (select c_custkey as k from customer) (select k, 'actual' as missing_from from a except select k, 'actual' from b) union all (select k, 'expected' from b except select k, 'expected' from a)")
def differing_sets(spark, d):
    return history.differing(table(spark, d, "orders").select(F.col("o_custkey").alias("k")), table(spark, d, "customer").select(F.col("c_custkey").alias("k")))


@query("select o_orderkey from orders where (o_orderstatus, o_orderpriority) in (select distinct o_orderstatus, o_orderpriority from orders where o_custkey % 50 = 0)")
def granted_actions(spark, d):
    o = table(spark, d, "orders")
    return history.granted(o, o.where("o_custkey % 50 = 0"), ["o_orderstatus", "o_orderpriority"]).select("o_orderkey")


@query("select doc_id from documents where sha256(coalesce(text, '')) in (select sha256(coalesce(text, '')) from documents where doc_id % 3 = 0)")
def reused_embeddings(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    return docs.join(docs.where("doc_id % 3 = 0").select("h").distinct(), "h", "left_semi").select("doc_id")


@query(f"with {PAGES}, m as (select slug, md5(coalesce(slug, '') || chr(31) || coalesce(title, '')) as h from pages) select count(*) as n_rows, count(distinct slug) as n, sha256(count(*) || '|' || sum(('0x' || substr(h, 1, 15))::bigint::hugeint)::varchar || '|' || bit_xor(('0x' || substr(h, 17, 15))::bigint)::varchar) as digest from m")
def metadata_universe(spark, d):
    p = pages(spark, d)
    return p.agg(F.count("*").alias("n_rows"), F.count_distinct("slug").alias("n"), digests.group_digest(F.col("slug"), F.col("title")).alias("digest"))


# ---- quality --------------------------------------------------------------------------------------------------------


@query("with q as (select domain as metric, count(*) filter (active) as numerator, count(*) - count(*) filter (domain = 'travel') as denominator from evidence where domain is not null group by 1) select metric, round(case when denominator = 0 then null else numerator / denominator end, 6) as value, denominator > 0 and numerator >= 0 and numerator <= denominator as valid from q")
def qa_ratios(spark, d):
    e = table(spark, d, "evidence").where("domain is not null").groupBy(F.col("domain").alias("metric")).agg(F.count_if("active").alias("numerator"), (F.count("*") - F.count_if(F.col("domain") == "travel")).alias("denominator"))
    return evaluate.ratios(e)


@query("with g as (select l_orderkey as item_id, count(distinct l_suppkey % 3) as n from lineitem where l_orderkey % 4 <> 0 group by 1), i as (select o_orderkey as item_id from orders where o_orderkey % 5 <> 0) select i.item_id, case when n is null then 'missing' else 'repeated' end as problem from i left join g using (item_id) where n is null or n > 1 union all select item_id, 'unknown' from g where item_id not in (select item_id from i)")
def partition_check(spark, d):
    groups = table(spark, d, "lineitem").where("l_orderkey % 4 <> 0").select((F.col("l_suppkey") % 3).alias("group_id"), F.col("l_orderkey").alias("item_id")).distinct()
    return evaluate.partition_check(table(spark, d, "orders").where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("item_id")), groups)


_STRENGTH = "['unknown', 'quoted', 'third_party', 'self_report', 'observed'][(o_orderkey % 5 + 1)::int]"


@query(f"with s as (select o_custkey, {_STRENGTH} as s, o_orderkey % 5 as r from orders) select o_custkey, arg_min(s, r) as weakest from s group by 1")
def weakest_strength(spark, d):
    s = F.element_at(F.array(*map(F.lit, evaluate.STRENGTHS)), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return evaluate.weakest(table(spark, d, "orders").withColumn("s", s), "o_custkey", "s")


@query(f"with {_ROUTES}, i as (select domain, event_id, unnest(evidence_ids) as item, generate_subscripts(evidence_ids, 1) as k from ev), f as (select domain, item, min(event_id || '#' || lpad(k::varchar, 6, '0')) as f from i where item is not null group by 1, 2) select domain, item, row_number() over (partition by domain order by f, item)::int as place from f")
def stable_union(spark, d):
    return evaluate.stable_union(_events(spark, d), "domain", "event_id", "evidence_ids")


@query(f"with {_ROUTES}, i as (select distinct evidence_id as id from evidence), r as (select distinct x as id from (select unnest(evidence_ids) as x from ev) where x is not null), x as (select distinct evidence_id as id from evidence where active = false), f as (select i.id, r.id is not null as rr, x.id is not null as xx from i left join r using (id) left join x using (id)) select count(*) as inputs, count(*) filter (rr) as referenced, count(*) filter (xx) as excluded, count(*) filter (rr or xx) as covered, round(count(*) filter (rr) / (count(*) - count(*) filter (xx and not rr)), 6) as evidence_recall, round(count(*) filter (rr or xx) / count(*), 6) as disposition_coverage from f")
def stage_receipt(spark, d):
    e = table(spark, d, "evidence")
    used = _events(spark, d).select(F.explode("evidence_ids").alias("id")).where("id is not null")
    return evaluate.receipt(e.select(F.col("evidence_id").alias("id")), used, e.where("active = false").select(F.col("evidence_id").alias("id")))


@query("select 'categories_sum' as \"check\", true as holds union all select 'ids_unique', count(distinct place_id) = count(*) from places union all select 'all_named', count(canonical) = count(*) from places")
def field_identities(spark, d):
    p = table(spark, d, "places")
    kinds = ("landmark", "other", "country", "subregion", "city")
    total = sum((F.count_if(F.col("kind") == k) for k in kinds[1:]), F.count_if(F.col("kind") == kinds[0]))
    return evaluate.identities(p, {"categories_sum": total == F.count("kind"), "ids_unique": F.count_distinct("place_id") == F.count("*"), "all_named": F.count("canonical") == F.count("*")})


@query("select distinct doc_id from documents where hash(1) is not null and doc_id % 6 = 0")
def split_overlap(spark, d):
    docs = table(spark, d, "documents")
    return evaluate.overlap(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 3 = 0"), "doc_id")


@query("select l_orderkey as record_id, count(distinct case when l_returnflag <> 'R' then s_nationkey end) as supporting, count(distinct case when l_returnflag = 'R' then s_nationkey end) as contradicting, false as missing_family, bool_or(l_returnflag <> 'R' and l_linestatus = 'F') as validating from lineitem join supplier on s_suppkey = l_suppkey group by 1")
def source_families(spark, d):
    o = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    o = o.select(F.col("l_orderkey").alias("record_id"), F.col("s_nationkey").cast("string").alias("source_family"), F.when(F.col("l_returnflag") == "R", "contradicts").otherwise("supports").alias("relation"), F.when(F.col("l_linestatus") == "F", "repeated_test").otherwise("note").alias("evidence_kind"))
    return evaluate.families(o)


# ---- windows over the event stream (an extension) -------------------------------------------------------------------


@query("select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def tumbling_windows(spark, d):
    from tessera.streaming.windows import tumbling

    return tumbling(table(spark, d, "events"), "1 hour").select("start", "event_type", "n", "total")


@query("with w as (select ts, event_type, value, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - interval 1 hour]) as start from events) select start, event_type, count(*) as n, round(sum(value), 4) as total from w group by 1, 2")
def sliding_windows(spark, d):
    from tessera.streaming.windows import sliding

    return sliding(table(spark, d, "events"), "2 hours", "1 hour").select("start", "event_type", "n", "total")


@query("with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 3 hour then 0 else 1 end as new from events), s as (select user_id, ts, sum(new) over (partition by user_id order by ts) as k from g) select user_id, min(ts) as start, count(*) as n from s group by user_id, k")
def session_windows(spark, d):
    from tessera.streaming.windows import sessions

    return sessions(table(spark, d, "events"), "3 hours").select("user_id", "start", "n")


# ---- gates ----------------------------------------------------------------------------------------------------------

from tessera.operators import gates  # noqa: E402


@query(r"select doc_id, 'credential' as rule, len(regexp_extract_all(text, '(?i)\b(?:api[_-]?key|access[_-]?token|password|secret)\b\s*[:=]\s*[\"'']?[A-Za-z0-9_\-/+]{8,}'))::int as hits from documents where regexp_matches(text, '(?i)\b(?:api[_-]?key|access[_-]?token|password|secret)\b\s*[:=]\s*[\"'']?[A-Za-z0-9_\-/+]{8,}') union all select doc_id, 'home_path', len(regexp_extract_all(text, '(?:/Users/|/home/|[A-Za-z]:\\Users\\)[A-Za-z0-9._-]+'))::int from documents where regexp_matches(text, '(?:/Users/|/home/|[A-Za-z]:\\Users\\)[A-Za-z0-9._-]+')")
def content_scan(spark, d):
    return gates.scan(table(spark, d, "documents"), "doc_id", "text")


@query("select distinct slug, regexp_matches(slug, '^(methods|sources)/.') and not regexp_matches(slug, '(^|/)\\.{1,2}(/|$)') as allowed from documents")
def safe_targets(spark, d):
    return table(spark, d, "documents").select("slug").distinct().select("slug", gates.safe_target(F.concat("slug", F.lit(".md")), ["methods/", "sources/"]).alias("allowed"))


@query("select o_custkey, count(*) as n, count(*) - count(distinct o_orderpriority) as repeated, count(*) filter (o_orderstatus = 'P') as empty, 0::bigint as nul, count(*) <= 100 and count(*) = count(distinct o_orderpriority) and count(*) filter (o_orderstatus = 'P') = 0 as acceptable from orders group by 1")
def change_set_shape(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.lit("update").alias("action"), F.col("o_orderpriority").alias("target"), F.when(F.col("o_orderstatus") == "P", "").otherwise("x").alias("content"))
    return gates.change_set_shape(o, "o_custkey")


@query()
def claim_audit(spark, d):
    return gates.audit(table(spark, d, "documents").select(F.col("text").alias("markdown")))


@query(f"with {_ROUTES}, c as (select event_id, evidence_ids, coalesce(len(evidence_ids), 0) as n, (select list(x) from (select distinct trim(u, ' ') as x from (select unnest(evidence_ids) as u)) where x is not null and x <> '') as ids from ev) select event_id, coalesce(len(ids), 0)::int as kept, (n - coalesce(len(ids), 0))::int as dropped, (select count(*) from (select unnest(ids) as i) where i not in (select evidence_id from evidence where evidence_id is not null)) as unknown from c where evidence_ids is not null")
def repaired_evidence(spark, d):
    known = table(spark, d, "evidence").where("evidence_id is not null").select(F.col("evidence_id").alias("id"))
    out = gates.repair_evidence(_events(spark, d).where("evidence_ids is not null"), "event_id", "evidence_ids", known)
    return out.select("event_id", F.size("ids").alias("kept"), "dropped", "unknown")


@query("with s as (select user_id, arg_max(event_type, event_id) as status from events group by 1), c as (select c_custkey as unit from customer) select count(*) as scope, count(status) as started, count(*) filter (status = 'purchase') as finished, count(*) - count(status) as missing, count(*) = count(*) filter (status = 'purchase') as drained from c left join s on unit = user_id")
def scope_progress(spark, d):
    s = ledger.latest(table(spark, d, "events"), "user_id", ["event_id"], "event_type").select(F.col("user_id").alias("unit"), F.col("event_type").alias("status"))
    return gates.progress(table(spark, d, "customer").select(F.col("c_custkey").alias("unit")), s, ["purchase"])


#: A schema pack with faults of most kinds.
_TYPES = [(name, prefix) for name, prefix, *_ in markdown.PAGE_TYPES] + [("project", "plans/"), ("archive", "projects/old/"), ("memo", "Memos")]
_PAIRS = [*graph.INVERSE.items(), ("uses", "applies_to"), ("superseded_by", "supersedes"), ("required_by", "depends_on"), ("cites", "cited_by"), ("uses", "applies_to")]
_RULES = [*graph.LINK_RULES, ("ghost", "sources", "cites"), ("project", "plans", "unknown_link")]


@query(f"""with t(type, prefix) as (values {", ".join(map(str, _TYPES))}), l(link, inverse) as (values {", ".join(map(str, _PAIRS))}), r(type, field, link_type) as (values {", ".join(map(str, _RULES))})
select 'repeated_type' as code, type as detail from t group by type having count(*) > 1 union select 'repeated_prefix', prefix from t group by prefix having count(*) > 1
union select 'prefix_inside_prefix', a.prefix from t a join t b on a.type <> b.type and starts_with(a.prefix, b.prefix) union select 'bad_prefix', prefix from t where not regexp_matches(prefix, '^[a-z0-9-]+(/[a-z0-9-]+)*/$')
union select 'inverse_without_answer', link from l a where not exists (select 1 from l b where b.link = a.inverse and b.inverse = a.link) union select 'repeated_link', link from l group by link having count(*) > 1
union select 'rule_of_unknown_type', type from r where type not in (select type from t) union select 'rule_of_unknown_link', link_type from r where link_type not in (select link from l)""")
def schema_pack_check(spark, d):
    types = spark.createDataFrame(_TYPES, "type string, prefix string")
    return gates.pack_violations(types, spark.createDataFrame(_PAIRS, "link string, inverse string"), spark.createDataFrame(_RULES, "type string, field string, link_type string"))


@query("select route_id, octet_length(encode(events_json)) as bytes, octet_length(encode(events_json)) <= 600 as fits from (select route_id, '{\"domain\":' || coalesce('\"' || domain || '\"', 'null') || ',\"route_id\":\"' || route_id || '\"}' as events_json from routed_episodes)")
def packet_sizes(spark, d):
    p = gates.packets(table(spark, d, "routed_episodes"), "route_id", ["domain", "route_id"], 600)
    return p.select("route_id", F.col("bytes").cast("long").alias("bytes"), "fits")


@query("select updated_at, '- ' || coalesce(slug, 'untitled') || ' (' || strftime(updated_at, '%Y-%m-%d') || ')' as line from documents where page_type = 'memo'")
def digest_lines(spark, d):
    return gates.digest_lines(table(spark, d, "documents").where("page_type = 'memo'"), "slug", "updated_at")


@query("with h as (select slug, arg_min(page_type, doc_id) as page_type, min(sha256(coalesce(text, ''))) as sha from documents group by 1), w as (select slug, page_type, sha256(coalesce(text, '')) as sha from documents) select w.slug, w.page_type as type from w join h on w.slug = h.slug and w.page_type = h.page_type and w.sha = h.sha")
def verified_hits(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "slug", F.col("page_type").alias("type"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    now = docs.groupBy("slug").agg(F.min_by("type", "doc_id").alias("type"), F.min("sha").alias("sha"))
    return retrieve.verified(docs, now).select("slug", "type")


# ---- asset claims ---------------------------------------------------------------------------------------------------


_CLAIMS = """a as (select distinct package_id, json(body) as b from (select * from assets where package_id is not null qualify row_number() over (partition by package_id order by built_at nulls first) = 1) where json_valid(body)),
l as (select package_id, json_extract(b, '$.self_model') as v from a),
i as (select package_id, pos, case when json_type(v) = 'ARRAY' then json_extract(v, '$[' || pos || ']') else v end as c from (select package_id, v, unnest(range(case when json_type(v) = 'ARRAY' then json_array_length(v)::bigint else 1 end))::int as pos from l where v is not null))"""


def _claims(spark, d):
    return nested.flat_tables(table(spark, d, "routed_episodes"), table(spark, d, "assets").where("package_id is not null"))["claims"]


@query(f"with {_CLAIMS} select package_id, pos, json_extract_string(c, '$.asset_id') as asset_id from i where json_extract_string(c, '$.calibration.behavior_change') = 'true' and json_extract_string(c, '$.calibration.status') = 'ready'")
def calibration_queue(spark, d):
    return assets.calibration_queue(_claims(spark, d)).select("package_id", "pos", "asset_id")


@query(f"with {_CLAIMS} select package_id, pos, json_extract_string(c, '$.asset_id') as asset_id, json_extract_string(c, '$.statement') as statement, 'card_' || substr(sha256(package_id || chr(31) || coalesce(json_extract_string(c, '$.asset_id'), '')), 1, 20) as card_id from i where json_extract_string(c, '$.confidence') = 'high'")
def knowledge_cards(spark, d):
    return assets.knowledge_cards(_claims(spark, d))[0].select("package_id", "pos", "asset_id", "statement", "card_id")
