"""The k nearest shapes by the distance of their boundaries, in widening grids.

A shape is the array of all its edges (x1, y1, x2, y2): outer rings, holes and
parts alike, since a point is inside if a ray from it crosses an odd number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from permrisk.sources.scratch import fresh

#: distances are compared at this many decimals, and equal ones by id
DECIMALS = 9


def within(edges: Column, x: Column, y: Column) -> Column:
    crossed = F.filter(edges, lambda e: ((e.y1 > y) != (e.y2 > y)) & (x < (e.x2 - e.x1) * (y - e.y1) / (e.y2 - e.y1) + e.x1))
    return F.size(crossed) % 2 == 1


def _to_edge(x: Column, y: Column, e: Column) -> Column:
    """Squared distance of a point and an edge; one without length is a point."""
    dx, dy = e.x2 - e.x1, e.y2 - e.y1
    long = dx * dx + dy * dy
    t = F.when(long > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((x - e.x1) * dx + (y - e.y1) * dy) / long))).otherwise(0.0)
    gx, gy = x - e.x1 - t * dx, y - e.y1 - t * dy
    return gx * gx + gy * gy


def _apart(p: Column, q: Column) -> Column:
    """Squared distance of two edges: nothing if they cross, else that of an end and the other edge."""
    side = lambda e, x, y: (e.x2 - e.x1) * (y - e.y1) - (e.y2 - e.y1) * (x - e.x1)
    cross = (side(p, q.x1, q.y1) * side(p, q.x2, q.y2) < 0) & (side(q, p.x1, p.y1) * side(q, p.x2, p.y2) < 0)
    return F.when(cross, 0.0).otherwise(F.least(_to_edge(p.x1, p.y1, q), _to_edge(p.x2, p.y2, q), _to_edge(q.x1, q.y1, p), _to_edge(q.x2, q.y2, p)))


def distance(a: Column, b: Column) -> Column:
    """Distance of two shapes, rounded: nothing if they meet or one lies in the other, even with a single part."""
    contained = lambda one, other: F.exists(one, lambda e: within(other, e.x1, e.y1))
    least = F.array_min(F.transform(a, lambda p: F.array_min(F.transform(b, lambda q: _apart(p, q)))))
    return F.when(contained(a, b) | contained(b, a), 0.0).otherwise(F.round(F.sqrt(least), DECIMALS))


def _cells(shapes: DataFrame, size: float) -> DataFrame:
    span = lambda a, b: F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size))
    return shapes.withColumn("gx", F.explode(span("low_x", "high_x"))).withColumn("gy", F.explode(span("low_y", "high_y")))


def k_nearest(shapes: DataFrame, k: int, size: float) -> DataFrame:
    """(id, other_id, distance, place) of the ``k`` nearest others of each (id, edges), equal distances by id; fewer where there are not so many.

    Shapes meet in grid cells of ``size`` and their neighbours, which finds all that
    are nearer than that; those with less than ``k`` such go on with cells of twice the
    size, so wide cells are only for shapes in sparse places. ``size`` is best about
    the usual width of a shape. Ids are unique; null ids and shapes that are null or without edges have no place.
    """
    spark = shapes.sparkSession
    low, high = (lambda n: F.array_min(F.transform("edges", lambda e: e[n]))), (lambda n: F.array_max(F.transform("edges", lambda e: e[n])))
    path = fresh(spark, "nearest")
    shapes.where("id IS NOT NULL AND size(edges) > 0").select("id", "edges", low("x1").alias("low_x"), high("x1").alias("high_x"), low("y1").alias("low_y"), high("y1").alias("high_y")).write.parquet(f"{path}/shapes")
    kept = spark.read.parquet(f"{path}/shapes")
    around = kept.agg(F.max("high_x") - F.min("low_x"), F.max("high_y") - F.min("low_y"), F.count(F.lit(1))).first()
    span = max(around[0] or 0.0, around[1] or 0.0)
    schema = f"id {kept.schema['id'].dataType.simpleString()}, other_id {kept.schema['id'].dataType.simpleString()}, distance double, place int"
    found = spark.createDataFrame([], schema)
    left, wanted, step = kept, min(k, around[2] - 1), 0
    while wanted > 0:
        last = size > span
        # the neighbours of a cell are named by the shape that asks; a pair that meets in several cells counts once
        asked = _cells(left, size).withColumn("gx", F.explode(F.expr("sequence(gx - 1, gx + 1)"))).withColumn("gy", F.explode(F.expr("sequence(gy - 1, gy + 1)"))).select("gx", "gy", "id").distinct()
        pairs = asked.join(_cells(kept, size).select("gx", "gy", F.col("id").alias("other_id")), ["gx", "gy"]).where("id <> other_id").select("id", "other_id").distinct()
        met = pairs.join(kept.select("id", "edges"), "id").join(kept.select(F.col("id").alias("other_id"), F.col("edges").alias("other")), "other_id")
        near = met.select("id", "other_id", distance(F.col("edges"), F.col("other")).alias("distance"))
        near = near if last else near.where(F.col("distance") < size)
        # rows beyond place k are dropped before the shuffle as well
        top = near.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("distance", "other_id"))).where(F.col("place") <= k)
        top.select("id", "other_id", "distance", "place").write.parquet(f"{path}/met-{step:02d}")
        seen = spark.read.schema(schema).parquet(f"{path}/met-{step:02d}")
        done = seen.join(seen.where(F.col("place") == wanted).select("id"), "id", "left_semi")
        found = found.unionByName(done)
        left = left.join(done.where("place = 1").select("id"), "id", "left_anti")
        if last or left.isEmpty():
            break
        size, step = size * 2, step + 1
    return found
