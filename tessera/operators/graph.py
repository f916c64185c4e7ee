"""Typed links between pages, reference checks, closure over edges, and the vault's integrity as rows of violations."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.common import stage
from tessera.functions.text import basename, normalize_reference, summary, wikilinks
from tessera.sources.markdown import PAGE_TYPES, type_for_path

#: Which frontmatter field links with which type, by page type, and the inverse of each type.
LINK_RULES = [(t, "evidence", "derived_from") for t in ("project", "decision", "methodology", "synthesis", "concept")] + [("source", "derived_pages", "supports")] + [(t, "related", "related_to") for t in ("project", "decision", "methodology", "synthesis", "concept")]
INVERSE = {"derived_from": "supports", "supports": "derived_from", "applies_to": "uses", "contradicts": "contradicts", "supersedes": "superseded_by", "depends_on": "required_by", "related_to": "related_to"}


def references(pages: DataFrame) -> DataFrame:
    """(slug, field, link_type, reference) of every frontmatter link of pages (slug, type, related, evidence, derived_pages)."""
    rules = F.broadcast(pages.sparkSession.createDataFrame(LINK_RULES, "type string, field string, link_type string"))  # a fixed table
    stacked = pages.select("slug", "type", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("refs")) for f in ("related", "evidence", "derived_pages")])).alias("x"))
    return stacked.select("slug", "type", "x.field", F.explode("x.refs").alias("reference")).join(rules, ["type", "field"]).select("slug", "field", "link_type", "reference")


def resolve(refs: DataFrame, pages: DataFrame, column: str = "reference") -> DataFrame:
    """refs with `target`: the page of exactly that path, else the only page with that base name, else null."""
    clean = refs.withColumn("_path", normalize_reference(F.col(column))).withColumn("_base", basename(F.col("_path")))
    exact = pages.select(F.col("slug").alias("_path"), F.col("slug").alias("_exact")).distinct()
    unique = pages.select(basename(F.col("slug")).alias("_base"), "slug").distinct().groupBy("_base").agg(F.count("*").alias("_n"), F.min("slug").alias("_only")).where("_n = 1").drop("_n")
    out = clean.join(exact, "_path", "left").join(unique, "_base", "left")
    return out.withColumn("target", F.coalesce("_exact", "_only")).drop("_path", "_base", "_exact", "_only")


def typed_edges(pages: DataFrame) -> DataFrame:
    """(src, link_type, dst) of all references that resolve."""
    return resolve(references(pages), pages).where("target is not null").select(F.col("slug").alias("src"), "link_type", F.col("target").alias("dst")).distinct()


def related(edges: DataFrame, slugs: DataFrame | None = None) -> DataFrame:
    """(slug, direction, link_type, other): outgoing edges, and incoming ones as their source states them."""
    both = edges.select(F.col("src").alias("slug"), F.lit("outgoing").alias("direction"), "link_type", F.col("dst").alias("other")).unionByName(edges.select(F.col("dst").alias("slug"), F.lit("incoming").alias("direction"), "link_type", F.col("src").alias("other")))
    return both if slugs is None else both.join(slugs, "slug", "left_semi")


def one_sided(edges: DataFrame) -> DataFrame:
    """Edges whose inverse is missing on the other page."""
    pairs = F.create_map(*[F.lit(x) for kv in INVERSE.items() for x in kv])
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), pairs[F.col("link_type")].alias("link_type"))
    return edges.join(back, ["src", "dst", "link_type"], "left_anti")


def dangling(refs: DataFrame, keys: DataFrame, ref: str, key: str) -> DataFrame:
    return refs.where(F.col(ref).isNotNull()).join(keys.select(F.col(key).alias(ref)), ref, "left_anti")


def duplicate_names(names: DataFrame) -> DataFrame:
    """(name, owners, first_owner) of (owner, name) where several owners share a name, blanks and letter case aside."""
    clean = names.select("owner", F.lower(F.btrim("name")).alias("name")).where("name <> ''").distinct()
    return clean.groupBy("name").agg(F.count("*").alias("owners"), F.min("owner").alias("first_owner")).where("owners > 1")


def closure(edges: DataFrame, roots: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, depth): everything reachable from roots (node) over edges (src, dst), each node at its least depth.

    A semi-naive fixpoint: every round joins only the nodes that are new. Rounds are written to the shared folder to cut lineage.
    A stated bound that leaves nodes is an error.
    """
    done = fresh = stage(roots.select("node").distinct().withColumn("depth", F.lit(0)), "closure")
    for depth in count(1):
        ahead = edges.join(fresh.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        fresh = stage(ahead.join(done.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)), "closure")
        if fresh.isEmpty():
            break
        if rounds is not None and depth > rounds:
            raise ValueError(f"nodes are left after {rounds} rounds")
        done = done.unionByName(fresh)
        if depth % 16 == 0:
            done = stage(done, "closure")  # keeps the plan short
    return done


def closure_violations(edges: DataFrame, roots: DataFrame, modules: DataFrame) -> DataFrame:
    """Reachable nodes that no module (node) provides."""
    return closure(edges, roots).join(modules, "node", "left_anti")


def relation_formats(refs: DataFrame) -> DataFrame:
    """Counts of plain and [[linked]] references, and whether both occur."""
    linked = F.btrim("reference").startswith("[[")
    return refs.agg(F.count_if(~linked).alias("plain"), F.count_if(linked).alias("linked")).withColumn("mixed", (F.col("plain") > 0) & (F.col("linked") > 0))


COMMON_FIELDS = ["type", "title", "aliases", "tags", "created", "updated", "status", "retrieval_scope", "agent_priority", "domain", "evidence_status"]


def _own_violations() -> Column:
    """ARRAY of (code, detail) of what a page's own fields and body show."""
    value = lambda f: F.get_json_object("fields", f"$.{f}")
    blank = lambda f: F.coalesce(value(f), F.lit("")).isin("", "[]", "null")
    bad = lambda when, code, detail: F.when(when, F.struct(F.lit(code).alias("code"), F.coalesce(detail.cast("string"), F.lit("")).alias("detail")))
    out = [bad(blank(f), "missing_field", F.lit(f)) for f in COMMON_FIELDS]
    out.append(bad(~F.coalesce(F.col("type") == type_for_path(F.col("path")), F.lit(False)), "type_mismatch", F.col("type")))
    out.append(bad(~F.coalesce("body", F.lit("")).rlike("(?m)^#[ \\t]+\\S"), "missing_heading", F.lit("")))
    out += [bad(~blank(f) & ~value(f).rlike("^\\d{4}-\\d{2}-\\d{2}(T00:00:00\\.000Z)?$"), "bad_date", F.lit(f)) for f in ("created", "updated")]
    for name, _, scope, status, required in PAGE_TYPES:
        own = F.col("type") == name
        out.append(bad(own & (F.coalesce(value("status"), F.lit("")) != status), "bad_status", value("status")))
        out.append(bad(own & (F.coalesce(value("retrieval_scope"), F.lit("")) != scope), "bad_scope", value("retrieval_scope")))
        out += [bad(own & ~F.contains("fields", F.lit(f'"{f}"')), "missing_type_field", F.lit(f)) for f in required]
    return F.array_compact(F.array(*out))


def violations(pages: DataFrame) -> DataFrame:
    """(path, code, detail) of everything wrong in parsed pages: path, fields (JSON), body, title, type, aliases, related, evidence, derived_pages.

    Pages are parsed and scanned once: what a page shows by itself and its links become a narrow table, and all links, of fields and of bodies, are resolved together.
    """
    def emit(rows: DataFrame, code: str, detail) -> DataFrame:
        return rows.select("path", F.lit(code).alias("code"), F.coalesce(detail.cast("string"), F.lit("")).alias("detail"))

    none = F.lit(None).cast("string")
    seen = pages.withColumn("slug", F.regexp_replace("path", "\\.md$", ""))
    p = stage(seen.select("path", "slug", "type", "title", "aliases", "related", "evidence", "derived_pages", wikilinks(F.col("body")).alias("links"), _own_violations().alias("own")), "pages")
    where = p.select("slug", "path")
    links = p.select("slug", F.lit("body").alias("field"), none.alias("link_type"), F.explode("links").alias("reference")).distinct()
    refs = stage(resolve(references(p).unionByName(links), p).join(where, "slug"), "references")
    lost, kinds = refs.where("target is null"), p.select(F.col("slug").alias("target"), F.col("type").alias("target_type"))
    typed = refs.where("target is not null and field != 'body'").join(kinds, "target")
    edges = refs.where("target is not null and field in ('evidence', 'derived_pages')").select(F.col("slug").alias("src"), "link_type", F.col("target").alias("dst")).distinct()
    names = p.select(F.col("path").alias("owner"), F.explode(F.concat(F.array("title"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    shared = names.select("owner", F.lower(F.btrim("name")).alias("name")).join(duplicate_names(names).select("name", "first_owner"), "name").where("owner <> first_owner").withColumnRenamed("owner", "path")
    of_link = F.when(F.col("field") == "body", F.struct(F.lit("unresolved_wikilink").alias("code"), F.col("reference").alias("detail"))).otherwise(F.struct(F.lit("unresolved_reference").alias("code"), F.concat_ws(":", "field", "reference").alias("detail")))
    to_source = F.when((F.col("field") == "evidence") & (F.col("target_type") != "source"), "evidence_is_no_source").when(F.col("field").isin("related", "derived_pages") & (F.col("target_type") == "source"), "relation_to_source")
    out = [
        p.select("path", F.explode("own").alias("v")).select("path", "v.*"), lost.select("path", of_link.alias("v")).select("path", "v.*"),
        typed.select("path", to_source.alias("code"), F.col("reference").alias("detail")).where("code is not null"), emit(one_sided(edges).join(where, F.col("src") == F.col("slug")), "missing_reverse", F.col("dst")), emit(shared, "duplicate_name", F.col("name")),
    ]
    return reduce(DataFrame.unionByName, out).distinct()


def type_counts(pages: DataFrame) -> DataFrame:
    """Pages per type, types without pages included."""
    kinds = pages.sparkSession.createDataFrame([(n,) for n, *_ in PAGE_TYPES], "type string")
    return F.broadcast(kinds).join(pages.groupBy("type").count(), "type", "left").select("type", F.coalesce("count", F.lit(0)).alias("n"))


def navigation(pages: DataFrame) -> DataFrame:
    """(type, slug, line) in order of type and slug: a range-partitioned sort, so an index of any length is written in parallel."""
    line = F.concat(F.lit("[["), F.col("slug"), F.lit("]] "), F.coalesce("title", F.lit("")), F.lit(": "), summary(F.col("body")))
    return pages.select("type", "slug", line.alias("line")).orderBy("type", "slug", "line")
