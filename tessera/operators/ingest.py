"""From stored chat rows to normalised records: senders, contents, identities, fingerprints, coverage, increments."""

from __future__ import annotations

from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.digests import key_digest

#: Redaction patterns, in the order in which they run; Unicode classes where the word class is meant.
PATTERNS = [
    ("email", "(?U)(?<![\\w.+-])[\\w.+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}"),
    ("url", "(?i)https?://[^\\s<>()]+"),
    ("phone", "(?<!\\d)(?:\\+?\\d[\\d -]{8,}\\d)(?!\\d)"),
    ("secret", "(?i)\\b(api[_-]?key|access[_-]?token|password|secret)\\s*[:=]\\s*[^\\s,;]+"),
    ("mention", "(?U)(?<!\\w)@[A-Za-z0-9_\\u4e00-\\u9fff-]{1,64}"),
]
FATAL = "(?i)-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----"


def _present(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def direction(sender: str = "sender_id", self_id: str = "self_id") -> Column:
    return F.when(~_present(sender) | ~_present(self_id), "ambiguous").when(F.col(sender) == F.col(self_id), "self").otherwise("other")


def fingerprint() -> Column:
    """Digest of a row's place, time, sender and contents; equal rows of different places differ."""
    return key_digest(*[F.col(c) for c in ("source", "shard", "row_id", "timestamp", "sender_id", "kind", "text", "quoted_text", "forwarded_context")])


def normalize_rows(rows: DataFrame) -> DataFrame:
    """Records of chat rows in exchange form. Empty and null are both missing."""
    fp, d = fingerprint(), direction()
    return rows.select(
        F.concat(F.lit("rec_"), F.substring(F.sha2(fp, 256), 1, 20)).alias("record_id"), fp.alias("source_fingerprint"), F.concat_ws("/", "source", "shard", "row_id").alias("source_locator"), "timestamp", "conversation_id",
        d.alias("direction"), F.when(d == "ambiguous", "unknown").otherwise(d).alias("author_scope"), F.coalesce("text", F.lit("")).alias("authored_text"), F.coalesce("quoted_text", F.lit("")).alias("quoted_text"), "quoted_author",
        F.coalesce("forwarded_context", F.lit("")).alias("forwarded_context"), F.coalesce("kind", F.lit("text")).alias("message_kind"), F.when(_present("text"), "verbatim").otherwise("metadata_only").alias("evidence_precision"), F.lit("raw_local").alias("redaction_status"),
    )


def coverage(source: DataFrame, records: DataFrame, key: str = "source_fingerprint") -> DataFrame:
    """(missing, unexpected): how often keys are lacking from records or too many there, as bags."""
    a = source.groupBy(key).agg(F.count("*").alias("a"))
    b = records.groupBy(key).agg(F.count("*").alias("b"))
    both = a.join(b, a[key].eqNullSafe(b[key]), "full_outer").select((F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0))).alias("d"))
    return both.agg(F.coalesce(F.sum(F.greatest(F.col("d"), F.lit(0))), F.lit(0)).alias("missing"), F.coalesce(F.sum(F.greatest(-F.col("d"), F.lit(0))), F.lit(0)).alias("unexpected"))


def redact(text: Column) -> tuple[Column, dict[str, Column]]:
    """(redacted text, count per kind). The patterns run one after the other; texts with private key material come out null and belong in quarantine."""
    out, counts = F.coalesce(text, F.lit("")), {}
    for kind, pattern in PATTERNS:
        counts[kind] = F.regexp_count(out, F.lit(pattern))
        out = F.regexp_replace(out, pattern, f"[REDACTED_{kind.upper()}]")
    return F.when(~F.coalesce(text, F.lit("")).rlike(FATAL), out), counts


def split_group_sender(content: Column) -> tuple[Column, Column]:
    """(sender, text) of group messages that begin with their author; sender is null where they don't."""
    pattern = "(?s)\\A([^:\\r\\n]+):(?:\\r?\\n|\\\\n)(.*)\\z"
    found = content.rlike(pattern)
    return F.when(found, F.regexp_extract(content, pattern, 1)), F.when(found, F.regexp_extract(content, pattern, 2)).otherwise(content)


def message_parts(df: DataFrame, content: str = "message_content", kind: str = "local_type", keep: list[str] | None = None) -> DataFrame:
    """keep... with message_kind, text, quoted_text, quoted_author, forwarded_context, media_name, media_expected, evidence_precision.

    Images (3) and voice (34) have no text; XML app messages (49) are quotes (57), attachments (6), forwards (19) or others. XML that can't be parsed is plain text. Elements
    are taken by pattern from messages that look like XML, with entities resolved; no parser runs and none can fail.
    """
    df = df.withColumn("_raw", F.coalesce(F.col(content), F.lit("")))
    df = df.withColumn("_xml", F.ltrim("_raw").startswith("<") & F.rtrim("_raw").endswith(">") & F.col("_raw").rlike("(?s)\\A\\s*<(\\w+)[\\s>].*(</\\1>|/>)\\s*\\z"))
    raw, xml = F.col("_raw"), F.col("_xml")
    plain = lambda c: F.replace(F.replace(F.replace(F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')), F.lit("&apos;"), F.lit("'")), F.lit("&amp;"), F.lit("&"))
    tag = lambda t: plain(F.regexp_extract(raw, f"(?s)<{t}>(.*?)</{t}>", 1))
    attr = lambda t, a: F.regexp_extract(raw, f'<{t}\\b[^>]*\\b{a}="([^"]*)"', 1)
    df = df.withColumn("_app", F.when((F.col(kind) == 49) & xml, tag("type")))
    app = F.col("_app")
    what = F.when(F.col(kind) == 3, "image").when(F.col(kind) == 34, "voice").when(app == "57", "quote").when(app == "6", "attachment").when(app == "19", "forward").when(app.isNotNull(), "app").otherwise("text")
    d = df.withColumn("_what", what).withColumn("_title", tag("title")).withColumn("_des", tag("des"))
    w = F.col("_what")
    text = F.when(w.isin("image", "voice"), "").when(w.isin("quote", "forward"), F.col("_title")).when(w == "attachment", F.col("_des")).when(w == "app", F.when(F.col("_title") != "", F.col("_title")).otherwise(F.col("_des"))).otherwise(raw)
    image, voice = attr("img", "filename"), attr("voicemsg", "filename")
    media = F.when((w == "image") & xml, F.coalesce(F.nullif(image, F.lit("")), attr("img", "md5"))).when((w == "voice") & xml, F.nullif(voice, F.lit(""))).when(w == "attachment", F.nullif(F.col("_title"), F.lit("")))
    return d.select(
        *(keep or [c for c in df.columns if c[:1] != "_"]), w.alias("message_kind"), text.alias("text"), F.when(w == "quote", tag("content")).otherwise("").alias("quoted_text"), F.when((w == "quote") & raw.contains("<displayname>"), tag("displayname")).alias("quoted_author"),
        F.when(w == "forward", F.col("_des")).otherwise("").alias("forwarded_context"), media.alias("media_name"), w.isin("image", "voice", "attachment").alias("media_expected"),
        F.when(w.isin("image", "voice"), "metadata_only").when(w == "text", "verbatim").otherwise("parsed_structure").alias("evidence_precision"),
    )


def with_media(parts: DataFrame, media: DataFrame) -> DataFrame:
    """parts with media_ref where a file of that base name is in the inventory (media_ref, basename)."""
    index = media.select(F.lower("basename").alias("_name"), "media_ref").groupBy("_name").agg(F.min("media_ref").alias("media_ref"))
    return parts.withColumn("_name", F.lower(F.regexp_extract("media_name", "([^/\\\\]+)$", 1))).join(index, "_name", "left").drop("_name")


def media_coverage(parts: DataFrame) -> DataFrame:
    return parts.agg(F.count_if("media_expected").alias("expected"), F.count_if(F.col("media_expected") & F.col("media_ref").isNotNull()).alias("available"), F.count_if(F.col("media_expected") & F.col("media_ref").isNull()).alias("missing"))


def after_watermark(rows: DataFrame, marks: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows beyond their shard's watermark (keys, wm_<order>...), compared as tuples; shards without one are new. Equal and lower rows are late and dropped."""
    joined = rows.join(marks, keys, "left")
    beyond, equal = F.lit(False), F.lit(True)
    for c in order:
        mark = F.coalesce(F.col(f"wm_{c}"), F.lit(-1))
        beyond = beyond | (equal & (F.col(c) > mark))
        equal = equal & (F.col(c) == mark)
    return joined.where(beyond).select(rows.columns)


def watermarks(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    top = rows.groupBy(*keys).agg(F.max(F.struct(*order)).alias("m"))
    return top.select(*keys, *[F.col(f"m.{c}").alias(f"wm_{c}") for c in order])


def members(rooms: DataFrame, member: DataFrame, contact: DataFrame) -> DataFrame:
    """(room_id, room, member_name): rooms with their members' usernames, a row each, so that a room of any size is no single row; rooms without members stay."""
    pairs = member.join(contact.select(F.col("id").alias("member_id"), F.col("username").alias("member_name")).distinct(), "member_id").select("room_id", "member_name").distinct()
    return rooms.select(F.col("id").alias("room_id"), F.col("username").alias("room")).distinct().join(pairs, "room_id", "left")


def identity_aliases(contact: DataFrame) -> DataFrame:
    """(alias, token): usernames, nicknames, remarks and aliases of at least two characters; the least username owns a shared alias."""
    named = contact.where(_present("username")).select("username", F.explode(F.array("username", "nickname", "remark", "alias")).alias("alias"))
    clean = named.select("username", F.btrim("alias").alias("alias")).where("length(alias) >= 2")
    return clean.groupBy("alias").agg(F.min("username").alias("username")).select("alias", F.concat(F.lit("[IDENTITY_"), F.upper(F.substring(F.sha2("username", 256), 1, 10)), F.lit("]")).alias("token"))


def _replace(batches, pairs: list[tuple[str, str]], names: list[str]):
    import ahocorasick

    machine = ahocorasick.Automaton()
    for alias, token in pairs:
        machine.add_word(alias.lower(), (len(alias), token))
    if pairs:
        machine.make_automaton()
    for batch in batches:
        cols = {n: batch.column(n).to_pylist() for n in names}
        found = [0] * batch.num_rows
        for values in cols.values():
            for i, text in enumerate(values):
                if not text or not pairs:
                    continue
                low = text.lower()
                if len(low) != len(text):  # a letter that changes its length in lower case: match it one by one
                    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
                hits = sorted(((end - size + 1, size, token) for end, (size, token) in machine.iter(low)), key=lambda h: (-h[1], low[h[0] : h[0] + h[1]], h[0]))
                taken: list[tuple[int, int, str]] = []
                for start, size, token in hits:  # longest aliases first
                    if all(start + size <= s or start >= s + n for s, n, _ in taken):
                        taken.append((start, size, token))
                if taken:
                    found[i] += len(taken)
                    for start, size, token in sorted(taken, reverse=True):
                        text = text[:start] + token + text[start + size :]
                    values[i] = text
        out = [pa.array(cols[n], pa.string()) if n in cols else batch.column(n) for n in batch.schema.names[:-1]]
        yield pa.RecordBatch.from_arrays([*out, pa.array(found, pa.int32())], names=batch.schema.names)


def replace_identities(df: DataFrame, names: list[str], aliases: DataFrame, limit: int = 1_000_000) -> DataFrame:
    """df with every alias in the named columns replaced by its token, longest first, letter case aside; n_identities counts them.

    The dictionary goes to the tasks as one automaton if it has at most `limit` entries; a larger one is refused and has to come in parts.
    """
    rows = aliases.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError("the alias dictionary is too large for one pass")
    pairs = df.sparkSession.sparkContext.broadcast(sorted((r["alias"], r["token"]) for r in rows))
    shaped = df.withColumn("n_identities", F.lit(0))
    return shaped.mapInArrow(partial(_replace_from, pairs=pairs, names=names), shaped.schema)


def _replace_from(batches, pairs, names):
    return _replace(batches, pairs.value, names)


def normal_time(raw: Column) -> Column:
    """ISO time in UTC of seconds, milliseconds, ISO times with a zone and dates; dates stay dates, times without zone are refused (null)."""
    text = F.btrim(raw.cast("string"))
    number = text.try_cast("bigint")
    at = F.when(text.rlike("^\\d{9,10}$"), F.timestamp_seconds(number)).when(text.rlike("^\\d{12,13}$"), F.timestamp_millis(number)).when(text.rlike("([Zz]|[+-]\\d{2}:?\\d{2})$"), text.try_cast("timestamp"))
    return F.when(text.rlike("^\\d{4}-\\d{2}-\\d{2}$") & text.try_cast("date").isNotNull(), text).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"))



def forbidden_keys(text: Column) -> Column:
    """Keys of a JSON object, at any depth, that must not leave: secrets and private paths."""
    keys = F.regexp_extract_all(text, F.lit('"([A-Za-z0-9_]+)"\\s*:'), 1)
    return F.array_sort(F.array_distinct(F.filter(keys, lambda k: k.rlike("(password|secret|token|private_key|api_key|_private_path)$"))))
