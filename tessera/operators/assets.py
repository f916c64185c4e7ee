"""Claims of personal asset packages: which wait for calibration, and cards of those stated with high confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.digests import key_digest


def calibration_queue(claims: DataFrame) -> DataFrame:
    """Claims that change behaviour and are ready for it; claims as nested.flat_tables gives them."""
    return claims.where("calibration_behavior_change = 'true' and calibration_status = 'ready'")


def knowledge_cards(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cards, not promoted): claims of high confidence with an id from package and asset, and (package_id, pos, asset_id) of the others; no claim is lost."""
    high = F.coalesce(F.col("confidence") == "high", F.lit(False))
    cards = claims.where(high).withColumn("card_id", F.concat(F.lit("card_"), F.substring(key_digest(F.col("package_id"), F.col("asset_id")), 1, 20)))
    return cards, claims.where(~high).select("package_id", "pos", "asset_id")
