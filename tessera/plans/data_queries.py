"""Queries of the general data problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.common import table
from tessera.operators import dedup, drift, nested, orphans


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return dedup.surplus(spark, f"{d}/message.parquet")


def p1_messages(spark: SparkSession, d: str) -> DataFrame:
    return dedup.exactly_once(spark, f"{d}/message.parquet")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.schema_changes(table(spark, d, "message_raw"))


def p2_messages(spark: SparkSession, d: str) -> DataFrame:
    return drift.unified_messages(table(spark, d, "message_raw"))


def p2_log(spark: SparkSession, d: str) -> DataFrame:
    return drift.change_log(table(spark, d, "message_raw"))


def p2_values(spark: SparkSession, d: str) -> DataFrame:
    """The unified messages in long form, so that one text of SQL holds for any fields."""
    return drift.field_values(drift.unified_messages(table(spark, d, "message_raw")))


def _vault(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {t: table(spark, d, t) for t in ("chat_room", "contact", "evidence", "places", "chatroom_member", "assets", "routed_episodes", "message")}


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.found(_vault(spark, d))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(_vault(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.found(table(spark, d, "routed_episodes"), table(spark, d, "assets"))


def _flat(spark: SparkSession, d: str, name: str) -> DataFrame:
    return nested.flat_tables(table(spark, d, "routed_episodes"), table(spark, d, "assets"))[name]


def p6_events(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d, "events")


def p6_evidence_links(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d, "evidence_links")


def p6_place_links(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d, "place_links")


def p6_claims(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d, "claims")


def p6_scenario_evidence(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d, "scenario_evidence")


def p6_case_evidence(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d, "case_evidence")


QUERIES = {f.__name__: f for f in (p1_found, p1_messages, p2_found, p2_log, p2_messages, p2_values, p4_found, p4_report, p6_found, p6_events, p6_evidence_links, p6_place_links, p6_claims, p6_scenario_evidence, p6_case_evidence)}

_IDENTITY = r"""case when server_id is not null and trim(server_id, chr(32) || chr(9)) not in ('', '0') then 's' || lower(trim(server_id, chr(32) || chr(9)))
  else 'f' || conversation_id || '|' || local_id || '|' || create_time end"""

_ROUTES = """routes as (select route_id, events from routed_episodes where route_id is null union all select route_id, events from (select * from routed_episodes where route_id is not null qualify row_number() over (partition by route_id order by routed_at nulls first) = 1)),
ev as (select distinct route_id, unnest(events) as e, (generate_subscripts(events, 1) - 1)::int as pos, events from routes)"""
_PACKAGES = """bodies as (select package_id, body from assets where package_id is null union all select package_id, body from (select * from assets where package_id is not null qualify row_number() over (partition by package_id order by built_at nulls first) = 1)),
a as (select distinct package_id, json(body) as b from bodies where json_valid(body))"""


def _links(rows: str, key: str, field: str, parent: str, name: str) -> str:
    return f"with {_ROUTES}, links as (select distinct {key}, pos as {parent}, unnest(e.{field}) as {name}, (generate_subscripts(e.{field}, 1) - 1)::int as pos, events from {rows}) select {key}, {parent}, pos, {name} from links where {name} is not null"


def _package_links(path: str, parent: str) -> str:
    return f"""
with {_PACKAGES}, l as (select package_id, b, json_extract(b, '{path}') as v from a),
i as (select package_id, b, {parent}, case when json_type(v) = 'ARRAY' then json_extract(v, '$[' || {parent} || ']') else v end as item
  from (select package_id, b, v, unnest(range(case when json_type(v) = 'ARRAY' then json_array_length(v)::bigint else 1 end))::int as {parent} from l where v is not null)),
x as (select package_id, b, {parent}, json_extract(item, '$.evidence_ids') as v from i where json_type(item) = 'OBJECT'),
e as (select package_id, b, {parent}, pos, case when json_type(v) = 'ARRAY' then json_extract_string(v, '$[' || pos || ']') else json_extract_string(v, '$') end as evidence_id
  from (select package_id, b, {parent}, v, unnest(range(case when json_type(v) = 'ARRAY' then json_array_length(v)::bigint else 1 end))::int as pos from x where v is not null))
select package_id, {parent}, pos, evidence_id from e where evidence_id is not null"""


_REFS = r"""ev as (select route_id, routed_at, unnest(events) as e from routed_episodes),
a as (select package_id, built_at, json(body) as b from assets where json_valid(body)),
lists as (
  select package_id, built_at, 'self_model.evidence_ids' as f, json_extract(b, '$.self_model') as v from a
  union all select package_id, built_at, 'voice.scenarios.evidence_ids', json_extract(b, '$.voice.scenarios') from a
  union all select package_id, built_at, 'evaluation_cases.evidence_ids', json_extract(b, '$.evaluation_cases') from a),
items as (select package_id, built_at, f, unnest(case when json_type(v) = 'ARRAY' then json_extract(v, '$[*]') else [v] end) as i from lists),
ids as (select package_id, built_at, f, json_extract(i, '$.evidence_ids') as x from items where json_type(i) = 'OBJECT'),
one as (select package_id, built_at, f, unnest(case when json_type(x) = 'ARRAY' then json_extract(x, '$[*]') else [x] end) as x from ids),
refs as (
  select 'chatroom_member' as ref_table, coalesce(room_id::varchar, '') || '|' || coalesce(member_id::varchar, '') as ref_key, 'room_id' as ref_field, 'chat_room' as tt, room_id::varchar as target_key, joined_at as t from chatroom_member
  union all select 'chatroom_member', coalesce(room_id::varchar, '') || '|' || coalesce(member_id::varchar, ''), 'member_id', 'contact', member_id::varchar, joined_at from chatroom_member
  union all select 'assets', package_id, f, 'evidence', json_extract_string(x, '$'), built_at from one
  union all select 'routed_episodes', route_id, 'events.place_ids', 'places', unnest(e.place_ids), routed_at from ev),
targets as (select 'chat_room' as tt, id::varchar as k, loaded_at, deleted_at from chat_room union all select 'contact', id::varchar, loaded_at, deleted_at from contact
  union all select 'evidence', evidence_id, loaded_at, deleted_at from evidence union all select 'places', place_id, loaded_at, deleted_at from places),
j as (select ref_table, ref_key, ref_field, r.tt, target_key, t, count(k) as n, bool_or(loaded_at <= t and (deleted_at is null or deleted_at > t)) as ok, bool_or(coalesce(loaded_at <= t, true)) as known
  from refs r left join targets on r.tt = targets.tt and target_key = k where target_key is not null and t is not null group by all)"""
_FOUND = """select distinct ref_table, ref_key, ref_field, target_key, case when n = 0 then 'missing' when known then 'deleted' else 'late' end as reason, strftime(t, '%Y-%m') as period from j where ok is not true"""

_CANONICAL = """case when p in ('localid','msglocalid') then 'local_id' when p in ('serverid','msgsvrid','svrid') then 'server_id' when p in ('createtime','createts') then 'create_time'
  when p in ('sortseq','seq') then 'sort_seq' when p in ('localtype','msgtype') then 'local_type' when p in ('realsenderid','senderid','fromuser') then 'real_sender_id' when p in ('messagecontent','content','strcontent') then 'message_content'
  when p in ('source','msgsource') then 'source' when p in ('issender','issend') then 'is_sender' else n end"""
_DRIFT = rf"""r as (select stream_id, file_seq, json(record) as b from message_raw where json_valid(record)),
k as (select stream_id, file_seq, unnest(json_keys(b)) as n, b from r where json_type(b) = 'OBJECT'),
t as (select stream_id, file_seq, n, max(case json_type(b, '$."' || n || '"') when 'NULL' then null when 'UBIGINT' then 'integer' when 'BIGINT' then 'integer' when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'OBJECT' then 'object' when 'ARRAY' then 'array' else 'number' end) as ty from k group by all),
c as (select *, lower(replace(n, '_', '')) as p from t),
f as (select stream_id, file_seq, n, ty, {_CANONICAL} as c from c),
files as (select stream_id, file_seq, lag(file_seq) over (partition by stream_id order by file_seq) as prev from (select distinct stream_id, file_seq from message_raw)),
new as (select f.*, prev from f join files using (stream_id, file_seq) where prev is not null),
old as (select f.stream_id, files.file_seq, f.n, f.ty, f.c from f join files on f.stream_id = files.stream_id and f.file_seq = files.prev),
j as (select coalesce(new.stream_id, old.stream_id) as stream_id, coalesce(new.file_seq, old.file_seq) as file_seq, new.n as nn, old.n as n0, new.ty as nt, old.ty as ot, new.c as cn, old.c as co from new full join old on new.stream_id = old.stream_id and new.file_seq = old.file_seq and new.c = old.c)"""
_CHANGES = """select stream_id, file_seq, 'added' as change_kind, nn as field_name from j where n0 is null
union all select stream_id, file_seq, 'removed', n0 from j where nn is null
union all select stream_id, file_seq, 'renamed', nn from j where nn <> n0
union all select stream_id, file_seq, 'type_changed', nn from j where nt <> ot"""

SQL = {
    "p1_found": f"with k as (select row_no, {_IDENTITY} as k from message) select row_no from (select row_no, k, min(row_no) over (partition by k) as m from k) where k is not null and row_no > m",
    "p1_messages": f"with k as (select *, {_IDENTITY} as k from message) select * exclude (k) from k qualify k is null or row_no = min(row_no) over (partition by k)",
    "p6_found": r"""
with ev as (select route_id, unnest(events) as e, generate_subscripts(events, 1) - 1 as pos from routed_episodes),
links as (select route_id, pos, unnest(e.evidence_ids) as x, generate_subscripts(e.evidence_ids, 1) - 1 as subpos from ev),
a as (select package_id, json(body) as b from assets where json_valid(body)),
sm as (select package_id, case when json_type(b, '$.self_model') = 'ARRAY' then json_extract(b, '$.self_model') else json_array(json_extract(b, '$.self_model')) end as l from a),
claims as (select package_id, unnest(range(json_array_length(l)::bigint)) as pos, l from sm)
select 'routed_episodes' as root_table, route_id as root_key, 'events.asserted_event_time.value' as path, pos::int as pos, -1 as subpos from ev where e.asserted_event_time.value <> ''
union select 'routed_episodes', route_id, 'events.evidence_ids', pos::int, subpos::int from links where x <> ''
union select 'assets', package_id, 'self_model.calibration.status', pos::int, -1 from claims where coalesce(json_extract_string(l, '$[' || pos || '].calibration.status'), '') <> ''""",
    "p6_events": f"""with {_ROUTES}, t as (select route_id, events, pos, e.subject as subject, e.disposition as disposition, e.title as title, e.summary as summary, e.importance as importance, e.asserted_event_time.value as asserted_event_time_value, e.asserted_event_time.precision as asserted_event_time_precision from ev)
select * exclude (events) from t where coalesce(subject, disposition, title, summary, importance::varchar, asserted_event_time_value, asserted_event_time_precision) is not null""",
    "p6_evidence_links": _links("ev", "route_id", "evidence_ids", "event_pos", "evidence_id"),
    "p6_place_links": _links("ev", "route_id", "place_ids", "event_pos", "place_id"),
    "p6_claims": f"""
with {_PACKAGES}, l as (select package_id, b, json_extract(b, '$.self_model') as v from a),
i as (select package_id, b, pos, case when json_type(v) = 'ARRAY' then json_extract(v, '$[' || pos || ']') else v end as c
  from (select package_id, b, v, unnest(range(case when json_type(v) = 'ARRAY' then json_array_length(v)::bigint else 1 end))::int as pos from l where v is not null)),
t as (select package_id, pos, json_extract_string(c, '$.asset_id') as asset_id, json_extract_string(c, '$.layer') as layer, json_extract_string(c, '$.statement') as statement, json_extract_string(c, '$.confidence') as confidence, json_extract_string(c, '$.calibration.status') as calibration_status, json_extract_string(c, '$.calibration.behavior_change') as calibration_behavior_change from i)
select * from t where coalesce(asset_id, layer, statement, confidence, calibration_status, calibration_behavior_change) is not null""",
    "p6_scenario_evidence": _package_links("$.voice.scenarios", "scenario_pos"),
    "p6_case_evidence": _package_links("$.evaluation_cases", "case_pos"),
    "p4_found": f"with {_REFS} {_FOUND}",
    "p4_report": f"""
with {_REFS}, direct as ({_FOUND}),
rooms as (select distinct username as conversation_id, id as room_id from chat_room where username is not null), people as (select distinct username as real_sender_id, id as member_id from contact where username is not null),
sent as (select distinct row_no::varchar as child, coalesce(room_id::varchar, '') || '|' || coalesce(member_id::varchar, '') as parent, strftime(to_timestamp(create_time)::timestamp, '%Y-%m') as period from message join rooms using (conversation_id) join people using (real_sender_id)),
ep as (select distinct episode_id as child, route_id as parent, strftime(routed_at, '%Y-%m') as period from routed_episodes where episode_id is not null and route_id is not null),
everything as (select ref_table, ref_key, ref_field, target_key, reason, period, 0 as depth from direct
  union all select 'message', child, 'membership', parent, 'inherited', period, 1 from sent where parent in (select ref_key from direct where ref_table = 'chatroom_member')
  union all select 'episode', child, 'route_id', parent, 'inherited', period, 1 from ep where parent in (select ref_key from direct where ref_table = 'routed_episodes'))
select ref_table, ref_field, reason, depth, period, count(*) as n_references, count(distinct ref_key) as n_records from everything group by all""",
    "p2_found": f"with {_DRIFT} {_CHANGES}",
    "p2_log": f"""with {_DRIFT}, log as (select stream_id, file_seq, coalesce(cn, co) as field, nn as new_name, n0 as old_name, nt as new_type, ot as old_type, unnest(list_filter([
  case when n0 is null then 'added' end, case when nn is null then 'removed' end, case when nn <> n0 then 'renamed' end, case when nt <> ot then 'type_changed' end], lambda x: x is not null)) as change_kind from j)
select stream_id, row_number() over (partition by stream_id order by file_seq, field, change_kind, new_name nulls first, old_name nulls first)::int as position, file_seq, change_kind, field, old_name, new_name, old_type, new_type from log""",
    "p2_values": f"""with r as (select distinct stream_id, file_seq, line_no, record, json(record) as b from message_raw where json_valid(record)),
k as (select *, unnest(json_keys(b)) as n from r where json_type(b) = 'OBJECT'),
v as (select *, json_type(b, '$."' || n || '"') as ty, json_extract_string(b, '$."' || n || '"') as v, lower(replace(n, '_', '')) as p from k),
c as (select *, {_CANONICAL} as field from v where ty <> 'NULL'),
x as (select stream_id, file_seq, line_no, field, case when field = 'create_time' then (case when regexp_matches(v, '^[0-9]+$') then (case when v::bigint > 100000000000 then v::bigint // 1000 else v::bigint end) else epoch(try_cast(v as timestamptz))::bigint end)::varchar
  when field = 'real_sender_id' and ty = 'OBJECT' then coalesce(json_extract_string(v, '$.wxid'), json_extract_string(v, '$.id'), json_extract_string(v, '$.username'), v)
  when field = 'is_sender' then case when lower(v) in ('1', 'true') then '1' when lower(v) in ('0', 'false') then '0' end else v end as value from c)
select * from x where value is not null""",
}
