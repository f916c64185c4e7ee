"""Queries of the language-model data problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.common import table
from tessera.llm import conversations, mixing, pii, spans, tokens


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.dropped(table(spark, d, "synthetic_rows"))


def p3_turns(spark: SparkSession, d: str) -> DataFrame:
    return conversations.rebuild(table(spark, d, "synthetic_rows"))[0]


def p3_conversations(spark: SparkSession, d: str) -> DataFrame:
    return conversations.conversations(table(spark, d, "synthetic_rows"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.found(table(spark, d, "message"), table(spark, d, "synthetic_rows"))


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redacted(table(spark, d, "message"), table(spark, d, "synthetic_rows"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_ids(table(spark, d, "documents"))


def _mixed(spark: SparkSession, d: str, **how) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), **how)


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1]


#: Share of the greatest entropy of the sources' weights in p8_even_shares.
EVENNESS = 0.9


def p8_tempered(spark: SparkSession, d: str) -> DataFrame:
    """A mix as large as the sources with a target: caps bind, so weights lie between the targets and the sources as they are."""
    return _mixed(spark, d, budget=mixing.CORPUS)[0]


def p8_tempered_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d, budget=mixing.CORPUS)[1]


def p8_even_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d, evenness=EVENNESS)[1]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_pairs(table(spark, d, "documents"))


def p9_portions(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_portions(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p3_found, p3_turns, p3_conversations, p5_found, p5_redacted, p7_ids, p8_mix, p8_shares, p8_tempered, p8_tempered_shares, p8_even_shares, p9_found, p9_portions)}

_BLANK = r"[\s\p{Z}\p{Cc}\p{Cf}\x{115F}\x{1160}\x{2800}\x{3164}\x{FFA0}\x{FE00}-\x{FE0F}]"

#: Every window of 160 characters of every document, by brute force.
_WINDOWS = """d as (select distinct doc_id, text from documents where doc_id is not null and length(text) >= 160),
w as (select doc_id, pos, md5(substr(text, pos::bigint, 160)) as h from (select doc_id, text, unnest(range(1, length(text) - 158)) as pos from d))"""

SQL: dict[str, str] = {
    "p3_found": rf"""
with s as (select conversation_id, try_cast(row_id as bigint) as n, lower(regexp_replace(sender_id, '^{_BLANK}+|{_BLANK}+$', '', 'g')) as a, lower(regexp_replace(self_id, '^{_BLANK}+|{_BLANK}+$', '', 'g')) as b,
    not regexp_matches(text, '^{_BLANK}*$') as t, case when regexp_matches(timestamp, '^(\d{{10}}|\d{{13}})$') then true
      when regexp_matches(timestamp, '^\d{{4}}([-/])\d{{2}}[-/]\d{{2}}[T ]\d{{2}}:\d{{2}}:\d{{2}}(Z|[+-]\d\d:\d\d)?$') then try_cast(substr(replace(replace(timestamp, '/', '-'), 'T', ' '), 1, 19) as timestamp) is not null else false end as ok
  from synthetic_rows where conversation_id is not null),
c as (select conversation_id, bool_or(n is null or coalesce(a, '') = '' or coalesce(b, '') = '' or not coalesce(ok, false)) or min(n) <> 1 or max(n) <> count(distinct n) as broken, not bool_or(coalesce(t, false)) as empty,
    bool_or(t and a <> '' and b <> '' and a = b) and bool_or(t and a <> '' and b <> '' and a <> b) as both_roles from s group by 1)
select conversation_id, 'broken' as reason from c where broken union all select conversation_id, 'empty' from c where empty union all select conversation_id, 'no_reply' from c where not empty and both_roles is not true""",
    "p9_found": f"with {_WINDOWS}, u as (select distinct doc_id, h from w) select distinct a.doc_id as doc_id_a, b.doc_id as doc_id_b from u a join u b on a.h = b.h and a.doc_id < b.doc_id",
    "p9_portions": f"""
with {_WINDOWS}, s as (select h from w group by h having count(distinct doc_id) > 1), m as (select distinct doc_id, pos from w semi join s using (h)),
c as (select doc_id, sum(case when before is null then 160 else least(160, pos - before) end)::bigint as shared from (select doc_id, pos, lag(pos) over (partition by doc_id order by pos) as before from m) group by 1),
k as (select text, count(*) as copies from d group by 1), a as (select distinct doc_id, text from documents where doc_id is not null)
select a.doc_id, coalesce(length(a.text), 0)::bigint as n_chars, coalesce(c.shared, 0)::bigint as shared_chars, coalesce(k.copies, 1)::bigint as n_copies, case when coalesce(length(a.text), 0) = 0 then 0.0 else coalesce(c.shared, 0)::double / length(a.text) end::double as share
from a left join c on c.doc_id = a.doc_id left join k on k.text = a.text""",
}
