"""Versioned tables and change sets: insert-only updates, corrections, withdrawal, replaced partitions, rollback, ordered changes, staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.common import stage


def insert_only(base: DataFrame, new: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(base and the new rows, rows refused because their key is there already or twice in new)."""
    twice = new.groupBy(key).count().where("count > 1").select(key)
    bad = new.join(base.select(key), key, "left_semi").unionByName(new.join(twice, key, "left_semi")).distinct()
    return base.unionByName(new.join(bad.select(key), key, "left_anti")), bad


def correct(base: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """base with the named columns of changed keys replaced; keys never change."""
    named = changes.select(key, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_hit"))
    j = base.join(named, key, "left")
    return j.select(*[F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns])


def withdraw(base: DataFrame, source: str, sources: str = "source_ids", active: str = "active") -> DataFrame:
    """Rows that rest on a source become inactive."""
    return base.withColumn(active, F.when(F.array_contains(sources, source), F.lit(False)).otherwise(F.col(active)))


def replace_partition(base: DataFrame, new: DataFrame, column: str, value: str) -> DataFrame:
    """base with one partition's rows replaced; other rows of new are ignored."""
    return base.where(~F.col(column).eqNullSafe(F.lit(value))).unionByName(new.where(F.col(column) == value))


def at_version(log: DataFrame, key: str, version: int) -> DataFrame:
    """State of a log of (key, version, ..., deleted) at a version: each key's last row up to it, unless deleted. A rollback appends this state as a new version."""
    rest = [c for c in log.columns if c not in (key, "version")]
    last = log.where(F.col("version") <= version).groupBy(key).agg(F.max_by(F.struct("version", *rest), "version").alias("r")).select(key, "r.*")
    return last.where("not deleted").drop("deleted")


def apply_changes(files: DataFrame, changes: DataFrame) -> DataFrame:
    """(path, content) after ordered changes (ord, action, target, new_target, content): create and update set, delete removes, move carries the content along.

    The last change of a path decides. A move's content is what its target held before it: the last content set or moved there, else the file's. Chains of
    moves are followed by pointer doubling, so a chain of n moves takes log n rounds; without chains there is one.
    """
    none = F.lit(None).cast("string")
    sets = changes.where("action in ('create', 'update')").select(F.col("target").alias("path"), "ord", "content", none.alias("origin"))
    moves = changes.where("action = 'move'").select(F.col("new_target").alias("path"), "ord", none.alias("content"), F.col("target").alias("origin"))
    filled = sets.unionByName(moves)
    # each move asks what was put on its origin last before it
    held = F.struct("ord", "content", "origin")
    asked = filled.select("path", "ord", held.alias("held"), none.alias("to")).unionByName(moves.select(F.col("origin").alias("path"), "ord", F.lit(None).alias("held"), F.col("path").alias("to")))
    before = Window.partitionBy("path").orderBy("ord", F.col("to").isNull()).rowsBetween(Window.unboundedPreceding, -1)
    asked = asked.withColumn("last", F.last("held", ignorenulls=True).over(before)).where("to is not null")
    base = files.select("path", F.col("content").alias("_base"))
    moved = asked.join(base, "path", "left").select(
        F.col("to").alias("path"), "ord", F.when(F.col("last").isNull(), F.col("_base")).otherwise(F.col("last.content")).alias("content"),
        F.when(F.col("last.origin").isNotNull(), F.struct(F.col("path"), F.col("last.ord").alias("ord"))).alias("from"),
    )
    moved = stage(moved, "moves")
    while moved.where("from is not null").limit(1).count():
        ahead = moved.select(F.struct("path", "ord").alias("from"), F.col("content").alias("_content"), F.col("from").alias("_from"))
        step = moved.join(ahead, "from", "left")
        moved = stage(step.select("path", "ord", F.when(F.col("from").isNull(), F.col("content")).otherwise(F.col("_content")).alias("content"), F.col("_from").alias("from")), "moves")
    gone = changes.where("action in ('delete', 'move')").select(F.col("target").alias("path"), "ord", none.alias("content"), F.lit("drop").alias("op"))
    put = sets.drop("origin").unionByName(moved.select("path", "ord", "content")).withColumn("op", F.lit("set"))
    last = put.unionByName(gone).groupBy("path").agg(F.max_by(F.struct("op", "content"), F.struct("ord", "op")).alias("x"))
    joined = files.join(last, "path", "full_outer")
    return joined.where("x is null or x.op = 'set'").select("path", F.when(F.col("x").isNotNull(), F.col("x.content")).otherwise(F.col("content")).alias("content"))


def change_violations(files: DataFrame, changes: DataFrame) -> DataFrame:
    """(target, code): creating what exists, changing or moving what doesn't, moving onto a file, touching a target twice, writing without content."""
    there = files.select(F.col("path").alias("target"), F.lit(True).alias("there"))
    first = changes.join(there, "target", "left").withColumn("there", F.coalesce("there", F.lit(False)))
    dest = changes.where("action = 'move'").select(F.col("new_target").alias("target")).join(there, "target").select("target", F.lit("destination_exists").alias("code"))
    twice = changes.groupBy("target").count().where("count > 1").select("target", F.lit("touched_twice").alias("code"))
    code = F.when((F.col("action") == "create") & F.col("there"), "already_exists").when((F.col("action") != "create") & ~F.col("there"), "absent").when(F.col("action").isin("create", "update") & (F.coalesce("content", F.lit("")) == ""), "no_content")
    return first.select("target", code.alias("code")).where("code is not null").unionByName(dest).unionByName(twice).distinct()


def stale(expected: DataFrame, current: DataFrame, key: str = "path", value: str = "sha") -> DataFrame:
    """Keys whose presence or digest differs from what was captured: (key, state)."""
    e = expected.select(key, F.col(value).alias("_e"), F.lit(1).alias("_x"))
    c = current.select(key, F.col(value).alias("_c"), F.lit(1).alias("_y"))
    state = F.when(F.col("_x").isNull(), "appeared").when(F.col("_y").isNull(), "vanished").when(~F.col("_e").eqNullSafe(F.col("_c")), "changed")
    return e.join(c, key, "full_outer").select(key, state.alias("state")).where("state is not null")


def states_so_far(changes: DataFrame, target: str, order: str, state: str) -> DataFrame:
    """changes with the number of distinct states each target has had up to and including that change."""
    w = Window.partitionBy(target).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.row_number().over(Window.partitionBy(target, state).orderBy(order)) == 1
    return changes.withColumn("_f", first.cast("int")).withColumn("n_states", F.sum("_f").over(w)).drop("_f")


def differing(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Symmetric difference of two sets with the side each row is missing from."""
    return expected.distinct().subtract(actual).withColumn("missing_from", F.lit("actual")).unionByName(actual.distinct().subtract(expected).withColumn("missing_from", F.lit("expected")))


def granted(actions: DataFrame, grants: DataFrame, keys: list[str]) -> DataFrame:
    return actions.join(grants.select(keys).distinct(), keys, "left_semi")


def next_version(log: DataFrame, key: str, version: Column) -> DataFrame:
    return log.groupBy(key).agg((F.coalesce(F.max(version), F.lit(0)) + 1).alias("next_version"))
