"""Place mentions: normalised only where exactly one safe candidate fits; countries visited."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import casefold


def _key(c, compatible: bool):
    return casefold(F.btrim(c)) if compatible else F.lower(F.btrim(c))


def normalize(mentions: DataFrame, candidates: DataFrame, compatible: bool = True) -> DataFrame:
    """(place_id, raw, canonical, kind, status, candidate_ids): applied iff exactly one safe candidate has the mention's key, else ambiguous with all candidates."""
    m = mentions.select("place_id", "raw", _key(F.col("raw"), compatible).alias("_k"))
    c = candidates.select(_key(F.col("raw"), compatible).alias("_k"), "candidate_id", "canonical", "kind", "safe")
    per = c.groupBy("_k").agg(F.count_if("safe").alias("n_safe"), F.min(F.when(F.col("safe"), F.struct("candidate_id", "canonical", "kind"))).alias("one"), F.array_sort(F.collect_set("candidate_id")).alias("ids"))
    j = m.join(per, "_k", "left")
    ok = F.coalesce(F.col("n_safe") == 1, F.lit(False))
    return j.select(
        "place_id", "raw", F.when(ok, F.col("one.canonical")).alias("canonical"), F.when(ok, F.col("one.kind")).otherwise("ambiguous").alias("kind"), F.when(ok, "applied").otherwise("ambiguous").alias("status"),
        F.when(ok, F.array("one.candidate_id")).otherwise(F.coalesce("ids", F.array().cast("array<string>"))).alias("candidate_ids"),
    )


def visited(events: DataFrame, places: DataFrame, kind: str = "country") -> DataFrame:
    """(canonical, n_routes): places of a kind that one's own events occurred or were completed in."""
    own = events.where("subject = 'self' and disposition in ('occurred', 'completed')").select("route_id", F.explode("place_ids").alias("place_id"))
    there = places.where(F.col("kind") == kind).select("place_id", "canonical").distinct()
    return own.join(there, "place_id").groupBy("canonical").agg(F.count_distinct("route_id").alias("n_routes"))


def with_places(events: DataFrame, places: DataFrame) -> DataFrame:
    """(event_id, pos, place_id, canonical, kind): an event's places in the order of its list; canonical is null for unknown ids."""
    listed = events.select("event_id", F.posexplode("place_ids").alias("pos", "place_id")).where("place_id is not null")
    return listed.join(places.select("place_id", "canonical", "kind").groupBy("place_id").agg(F.min("canonical").alias("canonical"), F.min("kind").alias("kind")), "place_id", "left").select("event_id", "pos", "place_id", "canonical", "kind")
