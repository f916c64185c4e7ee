"""Data-quality gates as rows: scans of contents and paths, audits, repairs, progress over a frozen scope, checks of the schema dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.markdown import CLAIM_LABELS, claim_records, parse_pages

#: What must not be stored, by content and by path.
CONTENT_RULES = [
    ("home_path", "(?:/Users/|/home/|[A-Za-z]:\\\\Users\\\\)[A-Za-z0-9._-]+"),
    ("key_material", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("credential", "(?i)\\b(?:api[_-]?key|access[_-]?token|password|secret)\\b\\s*[:=]\\s*[\"']?[A-Za-z0-9_\\-/+]{8,}"),
]
PATH_RULES = [("database", "\\.(?:db|sqlite3?|wal|shm)$"), ("private_folder", "(?:^|/)(?:\\.private|private|secrets)(?:/|$)"), ("secret_file", "(?:^|/)(?:\\.env(?:\\..+)?|id_rsa|.+\\.pem|.+\\.key)$")]


def scan(rows: DataFrame, key: str, content: str, path: str | None = None) -> DataFrame:
    """(key, rule, hits) of every rule that a row breaks; one pass, whatever the number of rules."""
    found = [F.struct(F.lit(n).alias("rule"), F.regexp_count(F.coalesce(content, F.lit("")), F.lit(p)).alias("hits")) for n, p in CONTENT_RULES]
    if path is not None:
        found += [F.struct(F.lit(n).alias("rule"), F.regexp_count(F.coalesce(path, F.lit("")), F.lit(p)).alias("hits")) for n, p in PATH_RULES]
    return rows.select(key, F.explode(F.array(*found)).alias("x")).select(key, "x.rule", "x.hits").where("hits > 0")


def safe_target(target: Column, prefixes: list[str], suffix: str = ".md") -> Column:
    """Whether a change may touch a path: relative, not escaping, below one of the prefixes, of the right kind."""
    escaping = target.rlike("(^|/)\\.{1,2}(/|$)") | target.contains("//") | target.startswith("/") | target.contains("\\") | target.contains("\u0000")
    below = F.lit(False)
    for p in prefixes:
        below = below | (target.startswith(p) & (F.length(target) > len(p)))
    return F.coalesce(~escaping & below & target.endswith(suffix), F.lit(False))


def change_set_shape(changes: DataFrame, key: str, most: int = 100) -> DataFrame:
    """Per change set: number of changes, repeated targets, missing contents and NUL bytes, and whether it is acceptable."""
    out = changes.groupBy(key).agg(
        F.count("*").alias("n"), (F.count("*") - F.count_distinct("target")).alias("repeated"),
        F.count_if(F.col("action").isin("create", "update") & (F.coalesce("content", F.lit("")) == "")).alias("empty"), F.count_if(F.coalesce(F.col("content").contains("\u0000"), F.lit(False))).alias("nul"),
    )
    return out.withColumn("acceptable", (F.col("n") <= most) & (F.col("repeated") == 0) & (F.col("empty") == 0) & (F.col("nul") == 0))


def audit(pages: DataFrame, text: str = "markdown") -> DataFrame:
    """One row: pages scanned, valid and invalid as claim records (frontmatter and claims without an issue)."""
    p = claim_records(parse_pages(pages.select(F.col(text)), text, strict=True).select("page.error", F.col("page.body").alias("body")))
    ok = F.col("error").isNull() & (F.size("parsed.issues") == 0)
    return p.agg(F.count("*").alias("scanned"), F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"))


def claim_fields() -> list[str]:
    return list(CLAIM_LABELS)


def repair_evidence(items: DataFrame, key: str, ids: str, known: DataFrame) -> DataFrame:
    """(key, ids, dropped, unknown): id lists without nulls, blanks and repeats, in order; ids that `known` (id) lacks are counted, not repaired."""
    clean = items.select(key, F.array_distinct(F.filter(F.transform(ids, lambda x: F.btrim(x)), lambda x: x.isNotNull() & (x != ""))).alias("ids"), F.coalesce(F.size(ids), F.lit(0)).alias("n"))
    lost = clean.select(key, F.explode("ids").alias("id")).join(known.select("id").distinct(), "id", "left_anti").groupBy(key).agg(F.count("*").alias("unknown"))
    return clean.join(lost, key, "left").select(key, "ids", (F.greatest(F.col("n"), F.lit(0)) - F.size("ids")).alias("dropped"), F.coalesce("unknown", F.lit(0)).alias("unknown"))


def progress(scope: DataFrame, states: DataFrame, done: list[str]) -> DataFrame:
    """One row over a frozen scope (unit) and states (unit, status): size, started, finished, missing, drained. States outside the scope don't count."""
    j = scope.select("unit").distinct().join(states.select("unit", "status"), "unit", "left")
    out = j.agg(F.count("*").alias("scope"), F.count("status").alias("started"), F.count_if(F.coalesce(F.col("status").isin(done), F.lit(False))).alias("finished"))
    return out.withColumn("missing", F.col("scope") - F.col("started")).withColumn("drained", F.col("scope") == F.col("finished"))


def materialize(results: DataFrame, unit: str, candidates: str, status: str = "status", accepted: str = "accepted") -> tuple[DataFrame, DataFrame]:
    """(candidates of all units with ids from unit and place, units that aren't accepted yet)."""
    rows = results.where(F.col(status) == accepted).select(unit, F.posexplode(candidates).alias("place", "candidate"))
    out = rows.withColumn("candidate_id", F.concat(F.lit("cand_"), F.substring(F.sha2(F.concat_ws("\u001f", F.col(unit), F.col("place").cast("string"), F.to_json(F.struct("candidate"))), 256), 1, 20)))
    return out, results.where(~F.coalesce(F.col(status) == accepted, F.lit(False))).select(unit)


def pack_violations(types: DataFrame, links: DataFrame, rules: DataFrame) -> DataFrame:
    """(code, detail) of a schema dimension: types (type, prefix), links (link, inverse), rules (type, field, link_type).

    Names and prefixes are unique, no prefix begins another, inverses answer each other, rules name known types and links.
    """
    def rows(df: DataFrame, code: str, detail: Column) -> DataFrame:
        return df.select(F.lit(code).alias("code"), detail.cast("string").alias("detail"))

    a, b = types.select(F.col("type").alias("ta"), F.col("prefix").alias("pa")), types.select(F.col("type").alias("tb"), F.col("prefix").alias("pb"))
    heads = a.select("ta", "pa", F.explode(F.transform(F.sequence(F.lit(1), F.length("pa")), lambda i: F.substring(F.col("pa"), F.lit(1), i))).alias("pb"))
    back = links.select(F.col("inverse").alias("link"), F.col("link").alias("inverse"))
    parts = [
        rows(types.groupBy("type").count().where("count > 1"), "repeated_type", F.col("type")), rows(types.groupBy("prefix").count().where("count > 1"), "repeated_prefix", F.col("prefix")),
        rows(heads.join(b, "pb").where("ta <> tb"), "prefix_inside_prefix", F.col("pa")), rows(types.where(~F.col("prefix").rlike("^[a-z0-9-]+(/[a-z0-9-]+)*/$")), "bad_prefix", F.col("prefix")),
        rows(links.join(back, ["link", "inverse"], "left_anti").where("inverse is not null"), "inverse_without_answer", F.col("link")), rows(links.groupBy("link").count().where("count > 1"), "repeated_link", F.col("link")),
        rows(rules.join(types, "type", "left_anti"), "rule_of_unknown_type", F.col("type")), rows(rules.join(links.select(F.col("link").alias("link_type")), "link_type", "left_anti"), "rule_of_unknown_link", F.col("link_type")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def version_at_least(version: Column, least: str) -> Column:
    """Numeric comparison of dotted versions."""
    part = lambda c: F.transform(F.split(c, "\\."), lambda x: x.try_cast("int"))
    return part(version) >= part(F.lit(least))


def packets(rows: DataFrame, key: str, payload: list[str], budget: int) -> DataFrame:
    """(key, bytes, fits): size of each row's envelope as JSON against a byte budget."""
    size = F.octet_length(F.to_json(F.struct(*payload), {"ignoreNullFields": "false"}))
    return rows.select(key, size.alias("bytes"), (size <= budget).alias("fits"))


def digest_lines(rows: DataFrame, title: str, at: str) -> DataFrame:
    """Report lines of pending items, oldest first: a range-partitioned sort."""
    return rows.select(at, F.format_string("- %s (%s)", F.coalesce(title, F.lit("untitled")), F.date_format(at, "yyyy-MM-dd")).alias("line")).orderBy(at, "line")


def json_schemas(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(name, schema) of tables as JSON."""
    return spark.createDataFrame([(n, df.schema.json()) for n, df in sorted(tables.items())], "name string, schema string")
