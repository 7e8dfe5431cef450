"""Neighbours on a page without all pairs: boxes meet in bands of rows.

Of two boxes the taller one (the first of equals) is entered in every band that it, grown by `reach` of its own heights,
touches; the other in the band of its centre. Two boxes whose vertical gap is at most `reach` heights of the taller one, or
that share half the height of the lower one, meet exactly once. The keys of the join are page and band, so that a page of
any number of lines is many small groups. Neither side is ever broadcast: the sizes that compressed files have tell little of
the rows that come out of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BAND = 80.0


def _renamed(df: DataFrame, suffix: str) -> DataFrame:
    return df.select("page_id", *[F.col(c).alias(c + suffix) for c in df.columns if c != "page_id"])


def _bands(t: str, b: str, reach: float, band: float) -> Column:
    h = F.col(b) - F.col(t)
    # Half a height more: the other's centre is that far beyond its edge at most.
    low, high = F.col(t) - (reach + 0.5) * h, F.col(b) + (reach + 0.5) * h
    return F.explode(F.sequence(F.floor(low / band).cast("long"), F.floor(high / band).cast("long")))


def near_pairs(one: DataFrame, other: DataFrame, reach: float = 1.5, band: float = BAND) -> DataFrame:
    """Pairs of one and other (both page_id, t, b, ...) of a page that may be within reach; other's columns end in _2."""
    centre = F.floor((F.col("t") + F.col("b")) / 2 / band).cast("long")
    a, b = one, _renamed(other, "_2")
    centre_2 = F.floor((F.col("t_2") + F.col("b_2")) / 2 / band).cast("long")
    taller = F.col("b") - F.col("t") >= F.col("b_2") - F.col("t_2")
    over = a.withColumn("_band", _bands("t", "b", reach, band)).join(b.withColumn("_band", centre_2).hint("merge"), ["page_id", "_band"]).where(taller)
    under = a.withColumn("_band", centre).join(b.withColumn("_band", _bands("t_2", "b_2", reach, band)).hint("merge"), ["page_id", "_band"]).where(~taller)
    return over.unionByName(under).drop("_band")


def below(one: DataFrame, other: DataFrame, low: Column, high: Column, band: float = BAND) -> DataFrame:
    """Pairs where other's top lies in [low, high], both given in columns of one; other's columns end in _2."""
    spread = F.explode(F.sequence(F.floor(low / band).cast("long"), F.floor(high / band).cast("long")))
    a = one.withColumn("_low", low).withColumn("_high", high).withColumn("_band", spread)
    b = _renamed(other, "_2").withColumn("_band", F.floor(F.col("t_2") / band).cast("long"))
    return a.join(b.hint("merge"), ["page_id", "_band"]).where(F.col("t_2").between(F.col("_low"), F.col("_high"))).drop("_band", "_low", "_high")


def row_share() -> Column:
    """Vertical overlap of a pair as a share of the lower box."""
    both = F.least("b", "b_2") - F.greatest("t", "t_2")
    return both / F.least(F.col("b") - F.col("t"), F.col("b_2") - F.col("t_2"))
