"""Join of a large table with one row per key, safe against hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SALT = "__salt"
_SALTS = "__salts"


def join_hot_keys(big: DataFrame, small: DataFrame, key: str, weight: str, hot: int, how: str = "inner") -> DataFrame:
    """``big`` joined with ``small`` (unique on ``key``), hot keys cut in pieces.

    ``weight`` in ``small`` is the number of ``big`` rows of the key. Keys of at
    least ``hot`` rows are cut into ``weight / hot`` salted pieces. There are at
    most rows(big) / hot of them, so the caller bounds the broadcast by choosing
    ``hot`` as a share of the total.
    """
    pieces = F.ceil(F.col(weight) / F.lit(hot)).cast("int")
    hot_keys = small.where(F.col(weight) >= hot).select(key, pieces.alias(_SALTS))
    salt = F.pmod(F.xxhash64(*big.columns), F.col(_SALTS)).cast("int")
    salted = (
        big.join(F.broadcast(hot_keys), key, "left")
        .withColumn(_SALT, F.coalesce(salt, F.lit(0)))
        .drop(_SALTS)
    )
    last = F.when(F.col(weight) >= hot, pieces - 1).otherwise(F.lit(0))
    copies = small.withColumn(_SALT, F.explode(F.sequence(F.lit(0), last)))
    return salted.join(copies, [key, _SALT], how).drop(_SALT)
