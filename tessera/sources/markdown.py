"""Markdown vaults as DataFrames: scan, frontmatter, body parts, claims, chunks."""

from __future__ import annotations

import re
from datetime import date

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Page types with the directory, retrieval scope and required fields of each.
PAGE_TYPES = [
    ("project", "projects/", "result", "active", ["related", "evidence", "last_confirmed"]),
    ("decision", "decisions/", "result", "active", ["related", "evidence"]),
    ("methodology", "methods/", "result", "active", ["related", "evidence"]),
    ("synthesis", "syntheses/", "result", "active", ["related", "evidence"]),
    ("concept", "concepts/", "result", "active", ["related", "evidence"]),
    ("source", "sources/", "evidence", "evidence", ["derived_pages", "source_format"]),
]
#: The field labels and types of claims.
CLAIM_LABELS = {"statement": "陈述", "claim_type": "类型", "direct_evidence": "直接依据", "sample_size": "样本量", "interest_disclosure": "利益关系", "allowed_uses": "允许用途", "disallowed_uses": "禁止用途", "counterevidence": "反证", "evidence_gaps": "证据缺口", "scope": "适用范围", "failure_conditions": "失效条件", "next_verification": "下一步验证"}
CLAIM_TYPES = {"事实": "fact", "来源观点": "source_opinion", "Agent 推断": "agent_inference", "宣传主张": "promotional_claim", "话术策略": "rhetoric_strategy", "待验证假设": "unverified_hypothesis"}
_SCALAR_CLAIM_FIELDS = ("statement", "claim_type", "sample_size", "interest_disclosure")


def page_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PAGE_TYPES, "type string, prefix string, retrieval_scope string, required_status string, required_fields array<string>")


def scan_vault(spark: SparkSession, root: str) -> DataFrame:
    """(path, markdown, modified_at) of every .md file below the types' directories; raw, ops and root files are not pages."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    base = "file:" + root.removeprefix("file:").rstrip("/") + "/" if "://" not in root else root.rstrip("/") + "/"
    path = F.regexp_replace(F.regexp_replace("path", "^file:/+", "file:/"), "^" + re.escape(re.sub("^file:/+", "file:/", base)), "")
    rows = files.select(path.alias("path"), F.col("content").cast("string").alias("markdown"), F.col("modificationTime").alias("modified_at"))
    return rows.where(type_for_path(F.col("path")).isNotNull())


def type_for_path(path: Column) -> Column:
    """Page type of a safe relative path, by its directory."""
    safe = ~(path.rlike("(^|/)\\.\\.(/|$)") | path.contains("//") | path.startswith("/") | path.contains("\u0000") | path.contains("\\"))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, prefix, *_ in PAGE_TYPES:
        out = out.when(safe & path.startswith(prefix) & (F.length(path) > len(prefix)), F.lit(name))
    return out


def in_scope(page_type: Column, scope: str) -> Column:
    """Whether a page type belongs to the scope result, evidence or all."""
    names = [n for n, _, s, *_ in PAGE_TYPES if scope == "all" or s == scope]
    return page_type.isin(names)


class FrontmatterError(ValueError):
    pass


_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?")
_DATE = re.compile(r"\d{4}-\d{2}-\d{2}")


def _flow_items(text: str) -> list[str] | None:
    """Items of the inside of a [list]; None where quotes or brackets don't close."""
    items, depth, quote, start, i = [], 0, "", 0, 0
    while i < len(text):
        c = text[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = ""
        elif c in "\"'":
            quote = c
        elif c in "[]":
            depth += 1 if c == "[" else -1
        elif c == "," and depth == 0:
            items.append(text[start:i])
            start = i + 1
        i += 1
    if quote or depth:
        return None
    return [x.strip() for x in [*items, text[start:]] if x.strip()]


def scalar(text: str, strict: bool = False, plain_dates: bool = False):
    """A frontmatter value: list, boolean, null, number, date (as an ISO time unless plain), quoted or bare string."""
    import json

    text = text.strip()
    if text.startswith("[") or text.endswith("]"):
        items = _flow_items(text[1:-1]) if text.startswith("[") and text.endswith("]") else None
        if items is not None:
            return [scalar(x, strict, plain_dates) for x in items]
        if strict:
            raise FrontmatterError("malformed inline list")
    constant = {"true": True, "false": False, "null": None, "~": None}
    if text in constant:
        return constant[text]
    if _NUMBER.fullmatch(text):
        return float(text) if "." in text else int(text)
    if not plain_dates and _DATE.fullmatch(text):
        try:
            return date.fromisoformat(text).isoformat() + "T00:00:00.000Z"
        except ValueError:
            return text
    if len(text) > 1 and text[0] == text[-1] == "'":
        return text[1:-1].replace("''", "'")
    if len(text) > 1 and text[0] == text[-1] == '"':
        try:
            return json.loads(text)
        except ValueError:
            return text[1:-1]
    return text


def parse_page(markdown: str | None, strict: bool = False, plain_dates: bool = False) -> dict:
    """fields (name -> value), body, and error (strict mode: the first thing that is wrong)."""
    text = (markdown or "").replace("\r\n", "\n")
    lines = text.split("\n")
    end = next((i for i in range(1, len(lines)) if lines[i] == "---"), None) if lines[0] == "---" else None
    if end is None:
        why = "missing frontmatter" if lines[0] != "---" else "unclosed frontmatter"
        return {"fields": {}, "body": text.strip(), "error": why if strict else None}
    fields: dict = {}
    error, block = None, None
    for number, line in enumerate(lines[1:end], 2):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        try:
            if m := re.match(r"([A-Za-z][A-Za-z0-9_-]*):(?:\s*(.*))?$", line):
                if strict and m[1] in fields:
                    raise FrontmatterError(f"duplicate field {m[1]}")
                value = (m[2] or "").strip()
                fields[m[1]] = scalar(value, strict, plain_dates) if value else []
                block = None if value else m[1]
            elif block and (m := re.match(r"\s+-\s+(.+)$", line)):
                fields[block].append(scalar(m[1], strict, plain_dates))
            elif strict:
                raise FrontmatterError("unsupported line")
        except FrontmatterError as e:
            error = error or f"line {number}: {e}"
    return {"fields": fields, "body": "\n".join(lines[end + 1 :]).strip(), "error": error}


def split_body(body: str) -> tuple[str, str]:
    """Compiled truth and timeline: at a timeline mark, or at a rule after text that a Timeline or History heading follows."""
    lines = body.split("\n")
    for i, line in enumerate(lines):
        mark = line.strip()
        if mark in ("<!-- timeline -->", "<!--timeline-->") or re.fullmatch(r"---\s+timeline\s+---", mark, re.IGNORECASE):
            return "\n".join(lines[:i]), "\n".join(lines[i + 1 :])
        if mark == "---" and any(x.strip() for x in lines[:i]):
            following = next((x.strip() for x in lines[i + 1 :] if x.strip()), "")
            if re.match(r"##\s+(timeline|history)\b", following, re.IGNORECASE):
                return "\n".join(lines[:i]), "\n".join(lines[i + 1 :])
    return body, ""


def _as_list(value) -> list[str]:
    if value is None or value == "":
        return []
    return [str(x) for x in value if x is not None and str(x)] if isinstance(value, list) else [str(value)]


PAGE_SCHEMA = "title string, type string, aliases array<string>, tags array<string>, modules array<string>, domain string, maturity string, updated string, related array<string>, evidence array<string>, derived_pages array<string>, fields string, body string, compiled_truth string, timeline string, error string"


def parse_pages(df: DataFrame, text: str = "text", strict: bool = False) -> DataFrame:
    """df with a struct column `page` (PAGE_SCHEMA): the state machine runs in Arrow batches, once per text."""

    @F.pandas_udf(PAGE_SCHEMA)
    def parse(texts: pd.Series) -> pd.DataFrame:
        import json

        rows = []
        for x in texts:
            p = parse_page(x, strict)
            f = p["fields"]
            truth, timeline = split_body(p["body"])
            one = lambda k: None if f.get(k) in (None, []) else str(f[k])  # noqa: B023, E731
            rows.append([one("title"), one("type"), *(_as_list(f.get(k)) for k in ("aliases", "tags", "modules")), one("domain"), one("maturity"), one("updated"), *(_as_list(f.get(k)) for k in ("related", "evidence", "derived_pages")), json.dumps(f, ensure_ascii=False, sort_keys=True), p["body"], truth, timeline, p["error"]])
        return pd.DataFrame(rows, columns=[c.split()[0] for c in PAGE_SCHEMA.split(", ")])

    return df.withColumn("page", parse(F.col(text)))


def simple_fields(text: Column, names: list[str]) -> dict[str, Column]:
    """Single-line frontmatter fields without Python: text of the line `name: value`, null where absent."""
    normal = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    head = F.regexp_extract(normal, "(?ds)\\A---\\n(.*?)\\n---(?:\\n|\\z)", 1)
    return {n: F.nullif(F.btrim(F.regexp_extract(head, f"(?dm)^{n}:[ \\t]*(.*)$", 1)), F.lit("")) for n in names}


def parse_claims(body: str) -> tuple[list[dict], list[tuple[str, str]]]:
    """Claims of the `## Claims` section, and (code, path) of everything wrong with them."""
    issues: list[tuple[str, str]] = []
    section = re.search(r"^##[ \t]+Claims[ \t]*$(.*?)(?=^##[ \t]|\Z)", body or "", re.IGNORECASE | re.MULTILINE | re.DOTALL)
    if section is None:
        return [], [("MISSING_CLAIMS_SECTION", "$.claims")]
    parts = re.split(r"^###[ \t]+(.+?)[ \t]*$", section[1], flags=re.MULTILINE)[1:]
    if not parts:
        return [], [("MISSING_CLAIM", "$.claims")]
    claims, seen = [], set()
    for i, (heading, text) in enumerate(zip(parts[::2], parts[1::2])):
        name = m[0] if (m := re.match(r"C-[A-Za-z0-9._-]+", heading)) else heading
        if name in seen:
            issues.append(("DUPLICATE_CLAIM_ID", f"$.claims.{i}.claim_id"))
        seen.add(name)
        values: dict[str, str | list] = {}
        label = None
        for line in text.splitlines():
            if m := re.match(r"-\s+([^：:]+)[：:]\s*(.*)$", line):
                label, inline = m[1].strip(), m[2].strip().strip("`\"'")
                values[label] = inline if inline and inline != "[]" else []
            elif label and isinstance(values[label], list) and (m := re.match(r"\s{2,}-\s+(.+)$", line)):
                values[label].append(m[1].strip().strip("`\"'"))
        claim: dict = {"claim_id": name}
        for field, title in CLAIM_LABELS.items():
            got, path = values.get(title), f"$.claims.{i}.{title}"
            single = field in _SCALAR_CLAIM_FIELDS
            if got is None:
                issues.append(("MISSING_CLAIM_FIELD", path))
            elif single != isinstance(got, str):
                issues.append(("MALFORMED_CLAIM_FIELD" if single else "MALFORMED_CLAIM_LIST", path))
                got = None
            claim[field] = got if got is not None else (None if single else [])
        if claim["claim_type"] is not None and claim["claim_type"] not in CLAIM_TYPES:
            issues.append(("UNKNOWN_CLAIM_TYPE", f"$.claims.{i}.claim_type"))
        claim["claim_type"] = CLAIM_TYPES.get(claim["claim_type"])
        size = claim["sample_size"]
        if size is not None and not re.fullmatch(r"\d+", size):
            issues.append(("INVALID_SAMPLE_SIZE", f"$.claims.{i}.sample_size"))
        claim["sample_size"] = int(size) if size and re.fullmatch(r"\d+", size) else None
        claims.append(claim)
    return claims, issues


_LISTS = [f for f in CLAIM_LABELS if f not in _SCALAR_CLAIM_FIELDS]
CLAIM_SCHEMA = "claims array<struct<claim_id:string,statement:string,claim_type:string,sample_size:int,interest_disclosure:string," + ",".join(f"{f}:array<string>" for f in _LISTS) + ">>, issues array<struct<code:string,path:string>>"


def claim_records(df: DataFrame, body: str = "body") -> DataFrame:
    """df with a struct column `parsed`: claims and issues of each body."""

    @F.pandas_udf(CLAIM_SCHEMA)
    def parse(texts: pd.Series) -> pd.DataFrame:
        rows = [parse_claims(x or "") for x in texts]
        names = ["claim_id", "statement", "claim_type", "sample_size", "interest_disclosure", *_LISTS]
        return pd.DataFrame({"claims": [[{n: c[n] for n in names} for c in cs] for cs, _ in rows], "issues": [[{"code": a, "path": b} for a, b in es] for _, es in rows]})

    return df.withColumn("parsed", parse(F.col(body)))


def pages_of(documents: DataFrame) -> DataFrame:
    """The vault's document table as pages: single-line frontmatter fields and the body, all on the JVM."""
    f = simple_fields(F.col("text"), ["title", "tags", "modules", "maturity", "updated"])
    items = lambda c: F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(c, F.lit("")), "^\\[|\\]$", ""), ","), lambda x: F.btrim(x)), lambda x: x != "")
    body = F.regexp_replace(F.replace(F.coalesce("text", F.lit("")), F.lit("\r\n"), F.lit("\n")), "(?s)\\A---\\n.*?\\n---(?:\\n|\\z)", "")
    return documents.select(
        "doc_id", "slug", F.col("page_type").alias("type"), f["title"].alias("title"), items(f["tags"]).alias("tags"), items(f["modules"]).alias("modules"), f["maturity"].alias("maturity"), f["updated"].alias("updated"), "domain", "lang", "source", "updated_at", body.alias("body"),
    )
