"""Depth of coverage by sweep: changes of depth, their prefix sums over stretches, and look-ups of any place.

Blocks become +1 where they begin and -1 after they end, added up by place. Prefix sums run within stretches of coordinates,
each of which gets the sums of those before it, so that no chromosome is summed in one task. The outcome is a run-length
table; what lies between two places is the difference of two look-ups, however many blocks and bases there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoframe.operators.ordered import STRETCH

TILE = "__tile"


def _tile(place: Column) -> Column:
    return F.floor(place / STRETCH)


def _up_to(df: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """``df`` (keys, tile and pos, no place twice) with the sums over all rows of its keys up to each row."""
    own = Window.partitionBy(*keys, TILE).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(TILE).rowsBetween(Window.unboundedPreceding, -1)
    tiles = df.groupBy(*keys, TILE).agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    tiles = tiles.select(*keys, TILE, *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in sums])
    out = df.withColumns({n: F.sum(c).over(own) for n, c in sums.items()}).join(tiles, [*keys, TILE])
    return out.withColumns({n: F.col(n) + F.col(f"__{n}") for n in sums}).drop(*[f"__{n}" for n in sums])


def coverage(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, depth, total, covered): from ``pos`` on the depth is ``depth``, up to the next row of the keys.

    total is the sum of depths of all places before ``pos``, covered the number of those with any. blocks: keys, r_start, r_end;
    those that end before they begin count for nothing.
    """
    ends = F.array(F.struct(F.col("r_start").cast("long").alias("pos"), F.lit(1).alias("d")), F.struct((F.col("r_end").cast("long") + 1).alias("pos"), F.lit(-1).alias("d")))
    each = blocks.where("r_end >= r_start").select(*keys, F.explode(ends).alias("x")).select(*keys, "x.pos", "x.d")
    changes = each.groupBy(*keys, "pos").agg(F.sum("d").alias("d")).where("d <> 0").withColumn(TILE, _tile(F.col("pos")))
    deep = _up_to(changes, keys, {"depth": F.col("d")})
    # where any coverage begins (1) and where it ends (-1)
    edge = (F.col("depth") > 0).cast("int") - (F.col("depth") > F.col("d")).cast("int")
    deep = deep.withColumn("edge", edge)
    pos = F.col("pos")
    out = _up_to(deep, keys, {"at": F.col("d") * pos, "open": F.col("edge"), "from": F.col("edge") * pos})
    return out.select(*keys, TILE, "pos", "depth", (pos * F.col("depth") - F.col("at")).alias("total"), (pos * F.col("open") - F.col("from")).alias("covered"))


def looked_up(points: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """points (keys, pos and others) with total and covered of the places before ``pos``; 0 where nothing is known."""
    rest = [c for c in points.columns if c not in (*keys, "pos")]
    run = F.struct("pos", "depth", "total", "covered")
    kind = table.select(run.alias("r")).schema["r"].dataType
    rows = table.select(*keys, TILE, "pos", F.lit(0).alias("asks"), run.alias("run"), F.lit(None).cast(points.select(F.struct(*rest).alias("x")).schema["x"].dataType).alias("x"))
    asks = points.select(*keys, _tile(F.col("pos")).alias(TILE), F.col("pos").cast("long").alias("pos"), F.lit(1).alias("asks"), F.lit(None).cast(kind).alias("run"), F.struct(*rest).alias("x"))
    within = Window.partitionBy(*keys, TILE).orderBy("pos", "asks").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(asks).withColumn("run", F.last("run", ignorenulls=True).over(within)).where("asks = 1")
    # the last run of each stretch, for those after it
    tiles = rows.groupBy(*keys, TILE).agg(F.max_by("run", "pos").alias("last")).unionByName(asks.select(*keys, TILE, F.col("run").alias("last")).distinct())
    tiles = tiles.groupBy(*keys, TILE).agg(F.first("last", ignorenulls=True).alias("last"))
    before = Window.partitionBy(*keys).orderBy(TILE).rowsBetween(Window.unboundedPreceding, -1)
    tiles = tiles.select(*keys, TILE, F.last("last", ignorenulls=True).over(before).alias("before"))
    r = F.coalesce("run", "before")
    found = both.join(tiles, [*keys, TILE]).select(*keys, "pos", "x.*", r.alias("r"))
    on = F.col("pos") - F.col("r.pos")
    amount = lambda c, each: F.coalesce(F.col(f"r.{c}") + on * each, F.lit(0)).alias(c)
    return found.select(*keys, "pos", *rest, amount("total", F.col("r.depth")), amount("covered", (F.col("r.depth") > 0).cast("int")))


def depth_sums(regions: DataFrame, blocks: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """(by, total, covered): the sum of depths over the regions (keys, by, start, end) of each ``by``, and the places covered.

    Regions of one ``by`` must not overlap each other.
    """
    ends = F.array(F.struct(F.col("start").cast("long").alias("pos"), F.lit(-1).alias("sign")), F.struct((F.col("end").cast("long") + 1).alias("pos"), F.lit(1).alias("sign")))
    named = regions.select(*keys, *[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], F.explode(ends).alias("e"))
    points = named.select(*keys, *[f"__by{i}" for i in range(len(by))], "e.pos", "e.sign")
    found = looked_up(points, coverage(blocks, keys), keys)
    sums = found.groupBy(*[F.col(f"__by{i}").alias(c) for i, c in enumerate(by)]).agg(*[F.sum(F.col("sign") * F.col(c)).alias(c) for c in ("total", "covered")])
    return sums
