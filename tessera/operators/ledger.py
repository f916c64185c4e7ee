"""Event ledgers: coverage per domain, ids, allowlists, states by replay, hash chains."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def routes(episodes: DataFrame) -> DataFrame:
    """One result per route: the first routed; rows delivered again are dropped."""
    return episodes.groupBy("route_id").agg(F.min_by(F.struct("domain", "processing_disposition", "events", "routed_at"), F.struct("routed_at", F.to_json("events"))).alias("r")).select("route_id", "r.*")


def events(results: DataFrame) -> DataFrame:
    """(event_id, route_id, domain, pos, ...): events with ids from route and place in the list; null events keep their place and have no row."""
    x = results.select("route_id", "domain", F.posexplode("events").alias("pos", "e")).where("e is not null")
    return x.select(F.concat_ws("/", "route_id", F.lpad(F.col("pos").cast("string"), 4, "0")).alias("event_id"), "route_id", "domain", "pos", "e.subject", "e.disposition", "e.title", "e.summary", "e.importance", F.col("e.asserted_event_time.value").alias("asserted"), "e.evidence_ids", "e.place_ids")


def domain_coverage(results: DataFrame, expected: DataFrame) -> DataFrame:
    """(domain, expected, processed, missing, status): expected has (domain, route_id), a null route_id for a domain that isn't extracted.

    not_extracted, else partial where routes are missing, else ambiguous where evidence was insufficient, else complete.
    """
    seen = results.select("domain", "route_id", (F.col("processing_disposition") == "insufficient_evidence").alias("thin")).where("domain is not null")
    wanted = expected.select("domain", "route_id").distinct()
    both = wanted.join(seen.withColumn("seen", F.lit(True)), ["domain", "route_id"], "left")
    out = both.groupBy("domain").agg(F.count("route_id").alias("expected"), F.count("seen").alias("processed"), F.bool_or(F.coalesce("thin", F.lit(False))).alias("thin"))
    missing = F.col("expected") - F.col("processed")
    status = F.when(F.col("expected") == 0, "not_extracted").when(missing > 0, "partial").when(F.col("thin"), "ambiguous").otherwise("complete")
    return out.select("domain", "expected", "processed", missing.alias("missing"), status.alias("status"))


def missing_routes(results: DataFrame, expected: DataFrame) -> DataFrame:
    return expected.where("route_id is not null").select("domain", "route_id").distinct().join(results.select("route_id").distinct(), "route_id", "left_anti")


def totals(results: DataFrame, found: DataFrame) -> DataFrame:
    r = results.agg(F.count("*").alias("route_count"), F.count_if(F.col("processing_disposition") == "no_signal").alias("no_signal_count"))
    e = found.agg(F.count("*").alias("event_count"), F.count_if(F.col("subject") == "self").alias("subject_event_count"))
    return r.crossJoin(e)  # one row each


def outside_allowlist(found: DataFrame, allow: DataFrame, field: str = "evidence_ids") -> DataFrame:
    """(event_id, id): ids of events that their own route doesn't allow (allow: route_id, id)."""
    used = found.select("event_id", "route_id", F.explode(field).alias("id")).where("id is not null").distinct()
    return used.join(allow.select("route_id", "id").distinct(), ["route_id", "id"], "left_anti").select("event_id", "id")


def several_domains(results: DataFrame) -> DataFrame:
    return results.groupBy("route_id").agg(F.count_distinct("domain").alias("domains")).where("domains > 1")


def merge_ledgers(parts: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(merged, conflicts): ledgers with one authority per domain; domains of several parts, and routes that occur twice, are conflicts."""
    merged = None
    for name, df in parts.items():
        one = df.withColumn("authority", F.lit(name))
        merged = one if merged is None else merged.unionByName(one)
    double = merged.groupBy("domain").agg(F.count_distinct("authority").alias("n")).where("n > 1").select(F.lit("domain").alias("kind"), F.col("domain").alias("key"))
    twice = merged.groupBy("route_id").count().where("count > 1").select(F.lit("route").alias("kind"), F.col("route_id").alias("key"))
    return merged, double.unionByName(twice)


def latest(log: DataFrame, unit: str, order: list[str], *values: str) -> DataFrame:
    """The last event of every unit: an aggregate, so a hot unit costs one row per task."""
    last = log.groupBy(unit).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("v"), F.count("*").alias("n_events"))
    return last.select(unit, "v.*", "n_events")


def after_terminal(log: DataFrame, unit: str, order: str, is_terminal: Column) -> DataFrame:
    """Events of a unit that come after its first terminal one: min per unit, then a join, with no window over a unit's events."""
    end = log.where(is_terminal).groupBy(unit).agg(F.min(order).alias("_end"))
    return log.join(end, unit).where(F.col(order) > F.col("_end")).drop("_end")


def _own_hash(values: tuple[str, ...]) -> Column:
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(v).cast("string"), F.lit("")) for v in values]), 256)


def _fold(batches):
    """Batches come sorted by key and order; the last two columns are the key and the content's hash."""
    key, last = object(), None
    for batch in batches:
        before, hashes = [], []
        for k, own in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
            if k != key:
                key, last = k, None
            before.append(last)
            last = hashlib.sha256(f"{last or ''}\u001f{own}".encode()).hexdigest()
            hashes.append(last)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(before, pa.string()), pa.array(hashes, pa.string())], names=[*batch.schema.names[:-2], "previous_hash", "event_hash"])


def chain(log: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """log with previous_hash, the event_hash of the key's event before, and event_hash over it and the event's content, so that each hash covers the whole history.

    A hash depends on the one before, so a key is one sorted stream; memory holds one batch and the last hash, never a key's events.
    """
    shaped = log.select(*[F.col(f"`{c}`") for c in log.columns], F.col(key).alias("_key"), _own_hash(values).alias("_own"))
    placed = shaped.repartition("_key").sortWithinPartitions("_key", order)
    return placed.mapInArrow(_fold, T.StructType([*log.schema.fields, T.StructField("previous_hash", T.StringType()), T.StructField("event_hash", T.StringType())]))


def broken_links(log: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """Events of a chained log whose hash isn't the one of their content and previous_hash, or whose previous_hash isn't the event_hash of the event before them.

    Where no event is broken, every hash covers the key's whole history. Each event is checked by itself, so nothing is folded.
    """
    sealed = F.sha2(F.concat_ws("\u001f", F.coalesce("previous_hash", F.lit("")), _own_hash(values)), 256)
    before = F.lag("event_hash").over(Window.partitionBy(key).orderBy(order))
    return log.withColumn("_before", before).where(~F.col("previous_hash").eqNullSafe(F.col("_before")) | ~F.col("event_hash").eqNullSafe(sealed)).drop("_before")


def parents_in_line(links: DataFrame, key: str, order: str, node: str, parent: str, most: int = 256) -> DataFrame:
    """Per key: length of a chain, breaks where a node's parent isn't the one before it, and whether it is valid and no longer than `most`."""
    before = F.lag(node).over(Window.partitionBy(key).orderBy(order))
    marked = links.withColumn("_bad", F.lag(F.lit(1)).over(Window.partitionBy(key).orderBy(order)).isNotNull() & ~F.col(parent).eqNullSafe(before))
    out = marked.groupBy(key).agg(F.count("*").alias("n_links"), F.count_if("_bad").alias("n_breaks"))
    return out.withColumn("valid", (F.col("n_breaks") == 0) & (F.col("n_links") <= most))


def ready(units: DataFrame, accepted: DataFrame) -> DataFrame:
    """Units (unit, dependencies) all of whose dependencies are accepted (unit); units without any are ready."""
    open_ = units.select("unit", F.explode("dependencies").alias("d")).join(accepted.select(F.col("unit").alias("d")).distinct(), "d", "left_anti").select("unit").distinct()
    return units.join(open_, "unit", "left_anti")


def status_counts(states: DataFrame, now: Column, reserved: str) -> DataFrame:
    """One row per status of states (status, lease_until) with its units, and for the reserved status how many of their leases are live and how many have expired."""
    live = (F.col("status") == reserved) & F.coalesce(F.col("lease_until") >= now, F.lit(False))
    return states.groupBy("status").agg(F.count("*").alias("n"), F.count_if(live).alias("live"), F.count_if((F.col("status") == reserved) & ~live).alias("expired"))


def cooldown(states: DataFrame, failed: Column, failed_at: str, least: int = 3, seconds: int = 60) -> DataFrame:
    """One row: failures, whether there are at least `least`, and until when to wait after the last of them."""
    s = states.where(failed & F.col(failed_at).isNotNull()).agg(F.count("*").alias("failures"), F.max(failed_at).alias("last_failed"))
    repeated = F.col("failures") >= least
    return s.select("failures", repeated.alias("repeated"), F.when(repeated, F.col("last_failed") + F.expr(f"make_interval(0, 0, 0, 0, 0, 0, {seconds})")).alias("cooldown_until"))


#: Domains in the order of a ledger.
DOMAINS = ["travel", "education", "work", "relationship", "residence", "family", "health", "finance", "creation"]


def in_domain_order(results: DataFrame) -> DataFrame:
    """results with domain_index, ordered by the domain's place in DOMAINS, then route_id; other domains come last."""
    place = F.array_position(F.array(*map(F.lit, DOMAINS)), F.col("domain"))
    return results.withColumn("domain_index", F.when(place > 0, place - 1).otherwise(len(DOMAINS)).cast("int")).orderBy("domain_index", "route_id")


def shares(log: DataFrame, assessed: Column, rejected: Column, least: int = 3, limit: float = 0.67) -> DataFrame:
    """One row: assessed, rejected, and whether the rejected share reaches the limit over at least `least` events."""
    s = log.agg(F.count_if(assessed).alias("assessed"), F.count_if(assessed & rejected).alias("rejected"))
    return s.withColumn("systemic", (F.col("assessed") >= least) & (F.coalesce(F.try_divide("rejected", "assessed"), F.lit(0.0)) >= limit))


def trend(samples: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """First and last value of each key and their difference."""
    x = samples.groupBy(key).agg(F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"), F.count("*").alias("n"))
    return x.withColumn("delta", F.round(F.col("last") - F.col("first"), 6))
