"""Files whose schemas drift: one consistent table, and every change in order.

Each file's header schema is an aggregate of its records (field, bit mask of the JSON types seen), built in parallel with partial
aggregation. Masks join in a promotion lattice; two neighbouring files of a stream are compared field by field.

Defined cases: a record that is null, cut off or no JSON object is unreadable and adds nothing; a field with nulls only is present and has no
type, so no type change is reported for it; a file without readable records has no fields; a file delivered again adds nothing new; rows without
stream_id or file_seq belong to no file.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The names under which the exports carry each message field, in lower case without underscores.
FIELD_NAMES = {
    "local_id": ["localid", "msglocalid", "meslocalid"],
    "server_id": ["serverid", "msgsvrid", "svrid", "messvrid", "msgserverid"],
    "create_time": ["createtime", "createts", "msgcreatetime", "createdat", "timestamp"],
    "sort_seq": ["sortseq", "sequence", "msgsequence", "seq"],
    "local_type": ["localtype", "msgtype", "messagetype", "type"],
    "real_sender_id": ["realsenderid", "senderid", "fromuser", "sender", "fromusername", "talker"],
    "message_content": ["messagecontent", "content", "strcontent", "msgcontent"],
    "source": ["source", "msgsource", "messagesource"],
    "is_sender": ["issender", "issend", "isself"],
    "conversation_id": ["conversationid", "strtalker", "chatid"],
}
#: Columns every unified table has, whether or not a file has the field.
MESSAGE_FIELDS = ["local_id", "server_id", "create_time", "sort_seq", "local_type", "real_sender_id", "message_content", "source", "is_sender"]
#: JSON types as bits of the lattice.
TYPE_BITS = {"boolean": 1, "integer": 2, "number": 4, "string": 8, "object": 16, "array": 32}


def canonical_field(name: Column) -> Column:
    """The message field a name stands for, else the name itself."""
    plain = F.regexp_replace(F.lower(name), "[_\\-]", "")
    out = F.when(F.lit(False), name)
    for field, names in FIELD_NAMES.items():
        out = out.when(plain.isin(names), F.lit(field))
    return out.otherwise(name)


def type_bit(value: str) -> Column:
    """Lattice bit of a variant's JSON type; 0 for null."""
    kind = F.schema_of_variant(value)
    return (
        F.when(kind == "VOID", 0)
        .when(kind == "BOOLEAN", TYPE_BITS["boolean"])
        .when(kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT") | kind.rlike("^DECIMAL\\(\\d+,0\\)"), TYPE_BITS["integer"])
        .when(kind.startswith("OBJECT"), TYPE_BITS["object"])
        .when(kind.startswith("ARRAY"), TYPE_BITS["array"])
        .when(kind == "STRING", TYPE_BITS["string"])
        .otherwise(TYPE_BITS["number"])
    )


def promote(mask: Column) -> Column:
    """Least type that holds all of a mask's types: integer < number < string, anything else mixed is a string; null for none."""
    out = F.when(mask == 0, F.lit(None).cast("string"))
    for name, bit in TYPE_BITS.items():
        out = out.when(mask == bit, F.lit(name))
    return out.when(mask == TYPE_BITS["integer"] + TYPE_BITS["number"], F.lit("number")).otherwise(F.lit("string"))


def _parsed(raw: DataFrame, carry: list[str]) -> DataFrame:
    return raw.select(*carry, F.try_parse_json("record").alias("_v"))


def _masks(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., field_name, mask) of readable records."""
    fields = parsed.lateralJoin(parsed.sparkSession.tvf.variant_explode(F.col("_v").outer()))
    seen = fields.select(*keys, F.col("key").alias("field_name"), type_bit("value").alias("bit"))
    return seen.groupBy(*keys, "field_name").agg(F.bit_or("bit").alias("mask"))


def file_schemas(raw: DataFrame) -> DataFrame:
    """(stream_id, file_seq, field, field_name, field_type) of every file."""
    parsed = _parsed(raw, ["stream_id", "file_seq"]).where("stream_id is not null and file_seq is not null and schema_of_variant(_v) like 'OBJECT%'")
    names = _masks(parsed, ["stream_id", "file_seq"])
    return names.select("stream_id", "file_seq", canonical_field(F.col("field_name")).alias("field"), "field_name", promote(F.col("mask")).alias("field_type"))


def union_schema(raw: DataFrame) -> dict[str, tuple[list[str], str | None]]:
    """field -> (its names, promoted type) over all readable records, those of no file included; only names and types reach the driver."""
    names = _masks(_parsed(raw, []).where("schema_of_variant(_v) like 'OBJECT%'"), []).where("field_name is not null").withColumn("field", canonical_field(F.col("field_name")))
    rows = names.groupBy("field").agg(F.collect_list("field_name").alias("names"), promote(F.bit_or("mask")).alias("type")).collect()  # one row per field
    out = {}
    for r in sorted(rows, key=lambda r: r.field):
        known = FIELD_NAMES.get(r.field, [])
        plain = lambda n: re.sub("[_-]", "", n.lower())
        out[r.field] = (sorted(r["names"], key=lambda n: (n != r.field, known.index(plain(n)) if plain(n) in known else len(known), n)), r["type"])
    return out


def change_log(raw: DataFrame) -> DataFrame:
    """(stream_id, position, file_seq, change_kind, field, old_name, new_name, old_type, new_type): each file against the stream's present file before it, numbered in order within its stream."""
    schemas = file_schemas(raw)
    # a field under several names in one file: names that both files have stay themselves, so compare by name first
    files = raw.where("stream_id is not null and file_seq is not null").select("stream_id", "file_seq").distinct()
    order = Window.partitionBy("stream_id").orderBy("file_seq")
    files = files.select("stream_id", F.col("file_seq").alias("seq"), F.lag("file_seq").over(order).alias("prev"), F.lead("file_seq").over(order).alias("next"))
    placed = schemas.join(files, (schemas.stream_id == files.stream_id) & (schemas.file_seq == files.seq)).drop(files.stream_id)
    new = placed.where("prev is not null").select("stream_id", F.col("seq").alias("at"), "field", F.struct("field_name", "field_type").alias("side"), F.lit(1).alias("is_new"))
    old = placed.where("next is not null").select("stream_id", F.col("next").alias("at"), "field", F.struct("field_name", "field_type").alias("side"), F.lit(0).alias("is_new"))
    pairs = new.unionByName(old).groupBy("stream_id", "at", "field").agg(
        F.sort_array(F.collect_list(F.when(F.col("is_new") == 1, F.col("side")))).alias("n"),
        F.sort_array(F.collect_list(F.when(F.col("is_new") == 0, F.col("side")))).alias("o"),
    )  # bounded: the few names one field has in two files
    shared = F.array_intersect(F.transform("n", lambda x: x.field_name), F.transform("o", lambda x: x.field_name))
    pairs = pairs.withColumn("shared", shared)
    only_new = F.filter("n", lambda x: ~F.array_contains("shared", x.field_name))
    only_old = F.filter("o", lambda x: ~F.array_contains("shared", x.field_name))
    none = F.struct(F.lit(None).cast("string").alias("field_name"), F.lit(None).cast("string").alias("field_type"))

    def kind(k: str, x, y) -> Column:
        """A change from y in the older to x in the newer file."""
        return F.struct(F.lit(k).alias("change_kind"), y["field_name"].alias("old_name"), x["field_name"].alias("new_name"), y["field_type"].alias("old_type"), x["field_type"].alias("new_type"))

    differs = lambda a, b: a.isNotNull() & b.isNotNull() & (a != b)
    same_name = F.flatten(F.transform("n", lambda x: F.transform(F.filter("o", lambda y: (y.field_name == x.field_name) & differs(x.field_type, y.field_type)), lambda y: kind("type_changed", x, y))))
    zipped = F.arrays_zip(only_new.alias("a"), only_old.alias("b"))
    renamed = F.flatten(
        F.transform(
            zipped,
            lambda z: F.array_compact(
                F.array(
                    F.when(z["a"].isNotNull() & z["b"].isNotNull(), kind("renamed", z["a"], z["b"])),
                    F.when(z["a"].isNotNull() & z["b"].isNotNull() & differs(z["a"]["field_type"], z["b"]["field_type"]), kind("type_changed", z["a"], z["b"])),
                    F.when(z["b"].isNull(), kind("added", z["a"], none)),
                    F.when(z["a"].isNull(), kind("removed", none, z["b"])),
                )
            ),
        )
    )
    changes = pairs.select("stream_id", F.col("at").alias("file_seq"), "field", F.explode(F.concat(same_name, renamed)).alias("c")).select("stream_id", "file_seq", "field", "c.*")
    position = F.row_number().over(Window.partitionBy("stream_id").orderBy("file_seq", "field", "change_kind", "new_name", "old_name"))
    return changes.select("stream_id", position.alias("position"), "file_seq", "change_kind", "field", "old_name", "new_name", "old_type", "new_type")


def schema_changes(raw: DataFrame) -> DataFrame:
    """(stream_id, file_seq, change_kind, field_name): the log's changes by the name in the newer file, for removed in the older."""
    return change_log(raw).select("stream_id", "file_seq", "change_kind", F.coalesce("new_name", "old_name").alias("field_name"))


def field_values(messages: DataFrame) -> DataFrame:
    """(stream_id, file_seq, line_no, field, value) of every value of unified messages, as text."""
    keys = ["stream_id", "file_seq", "line_no"]
    fields = [c for c in messages.columns if c not in (*keys, "other_values")]
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").cast("string").alias("value")) for f in fields]))
    return messages.select(*keys, each.alias("x")).select(*keys, "x.*").where("value is not null")


def unified_messages(raw: DataFrame) -> DataFrame:
    """Every readable record once (rows with one place and text are one), cast to the union schema: the message fields in their types, every other field of any file in its promoted type.

    Objects and arrays are JSON text, fields with nulls only are text. other_values has, by name, what these columns don't hold as it is: another name of a
    field in the same record, a value its type can't hold, an object sender, a time that isn't whole seconds. A further field whose name is taken, letter case aside, gets a number.
    """
    schema = union_schema(raw)
    keys = ["stream_id", "file_seq", "line_no"]
    once = raw.select(*keys, "record").distinct()  # before they are parsed: the narrow text moves, not the wide row
    parsed = _parsed(once, keys).where("schema_of_variant(_v) like 'OBJECT%'")
    names = [(field, n) for field, (spelled, _) in schema.items() for n in spelled]
    held = parsed.select(*keys, F.col("_v").cast("map<string,variant>").alias("_m"))
    texts = held.select(*keys, *[F.try_variant_get(F.element_at("_m", F.lit(n)), "$", "string").alias(f"_t{i}") for i, (_, n) in enumerate(names)])
    fields = [*MESSAGE_FIELDS, *(f for f in schema if f not in MESSAGE_FIELDS)]
    spelled = {f: [F.col(f"_t{i}") for i, (g, _) in enumerate(names) if g == f] for f in fields}
    chosen = texts.select("*", *[F.coalesce(*spelled[f], F.lit(None).cast("string")).alias(f"_f{j}") for j, f in enumerate(fields)])
    at = {f: F.col(f"_f{j}") for j, f in enumerate(fields)}
    cast, whole = {}, {}  # the value as cast, and whether it holds the text
    for f in fields:
        t, kind = at[f], schema.get(f, ([], None))[1]
        if f in ("local_id", "sort_seq", "local_type"):
            cast[f] = t.try_cast("int" if f == "local_type" else "bigint")
        elif f == "create_time":
            when = F.try_to_number(t, F.lit("9999999999999999")).cast("bigint")
            cast[f] = F.coalesce(F.when(when > 100_000_000_000, F.floor(when / 1000)).otherwise(when), F.unix_timestamp(t.try_cast("timestamp"))).cast("bigint")
            whole[f] = F.coalesce((when == cast[f]) | (when == cast[f] * 1000), F.lit(False))
        elif f == "real_sender_id":
            inner = [F.get_json_object(t, f"$.{n}") for n in ("wxid", "id", "username")]
            cast[f] = F.when(t.startswith("{"), F.coalesce(*inner, t)).otherwise(t)
            whole[f] = cast[f] == t
        elif f == "is_sender":
            cast[f] = F.when(F.lower(t).isin("1", "true"), 1).when(F.lower(t).isin("0", "false"), 0)
        elif f not in MESSAGE_FIELDS and kind in ("boolean", "integer", "number"):
            cast[f] = t.try_cast({"boolean": "boolean", "integer": "bigint", "number": "double"}[kind])
        else:
            cast[f] = t
        if f in ("local_id", "sort_seq", "local_type"):  # a fraction or blanks don't survive the cast
            whole[f] = F.coalesce(cast[f].cast("string") == t, F.lit(False))
        whole.setdefault(f, cast[f].isNotNull())
    rest = [F.when(F.col(f"_t{i}").isNotNull() & ((F.col(f"_t{i}") != at[f]) | ~whole[f]), F.struct(F.lit(n).alias("field_name"), F.col(f"_t{i}").alias("value"))) for i, (f, n) in enumerate(names)]
    others = F.array_compact(F.array(*rest)) if rest else F.array().cast("array<struct<field_name:string,value:string>>")
    taken, labels = {*keys, "other_values"}, {}
    for f in fields:
        label, k = f or "_", 1
        while label.lower() in taken:
            k += 1
            label = f"{f}_{k}"
        taken.add(label.lower())
        labels[f] = label
    return chosen.select(*keys, *[cast[f].alias(labels[f]) for f in fields], others.alias("other_values"))
