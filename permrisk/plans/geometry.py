"""Boundaries as polygons: read, repaired, measured, and met with points and with each other.

A ring is an array of points. Candidates come from grid cells of the bounding
boxes by an equi-join; the exact test is an expression over the edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from permrisk.operators.nearest import k_nearest
from permrisk.plans.dialect import Oracle
from permrisk.plans.graph import frame, statement

GEOJSON = "struct<type:string,coordinates:array<array<array<double>>>>"
CORNERS = ((1.0, 0.0), (0.5, 0.875), (-0.5, 0.875), (-1.0, 0.0), (-0.5, -0.875), (0.5, -0.875))
SITES = "SELECT c_custkey AS site_id, (c_custkey * 37 % 500) / 100.0 AS px, (c_custkey * 91 % 500) / 100.0 AS py FROM customer"


def _boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GeoJSON text of each county: a hexagon around its place; some rings are not closed, one is no polygon at all."""
    c = frame(spark, sf_dir, "county").withColumn("r", F.lit(0.375) + (F.col("county_id") % 4) * 0.125)
    point = lambda dx, dy: F.format_string("[%.6f,%.6f]", F.col("cx") + F.lit(0.5) + F.col("r") * dx, F.col("cy") + F.lit(0.5) + F.col("r") * dy)
    ring = F.concat_ws(",", *[point(dx, dy) for dx, dy in CORNERS], F.when(F.col("county_id") % 3 != 0, point(*CORNERS[0])))
    text = F.when(F.col("county_id") == 7, F.lit('{"type":"Point","coordinates":[]}')).otherwise(F.concat(F.lit('{"type":"Polygon","coordinates":[['), ring, F.lit("]]}")))
    return c.select("county_id", text.alias("geojson"))


def read_polygons(rows: DataFrame, col: str = "geojson") -> DataFrame:
    """``rows`` with ``ring``: the outer ring of a polygon, closed if it was not; null for what is no polygon of three corners."""
    shape = F.from_json(col, GEOJSON)
    ring = F.transform(F.get(shape["coordinates"], F.lit(0)), lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    first = F.get(ring, F.lit(0))
    closed = F.when(first == F.get(ring, F.size(ring) - 1), ring).otherwise(F.concat(ring, F.array(first)))
    return rows.withColumn("ring", F.when((shape["type"] == "Polygon") & (F.size(closed) >= 4), closed))


def edges(ring: Column) -> Column:
    return F.transform(F.slice(ring, F.lit(1), F.size(ring) - 1), lambda p, i: F.struct(p.x.alias("x1"), p.y.alias("y1"), F.get(ring, i + 1).x.alias("x2"), F.get(ring, i + 1).y.alias("y2")))


def read_shapes(rows: DataFrame, col: str = "geojson") -> DataFrame:
    """``rows`` with ``edges``: those of all rings of a polygon or of several, holes among them; open rings are closed, rings of less than three corners left out, and null is what has none."""
    point = "array<array<array<double>>>"
    kind = F.from_json(col, "struct<type:string>")["type"]
    one, many = F.from_json(col, f"struct<coordinates:{point}>")["coordinates"], F.from_json(col, f"struct<coordinates:array<{point}>>")["coordinates"]
    rings = F.filter(F.when(kind == "Polygon", one).when(kind == "MultiPolygon", F.flatten(many)), lambda r: F.size(F.array_distinct(r)) >= 3)
    step = lambda r, i: F.get(r, i % F.size(r))
    around = lambda r: F.transform(r, lambda p, i: F.struct(p[0].alias("x1"), p[1].alias("y1"), step(r, i + 1)[0].alias("x2"), step(r, i + 1)[1].alias("y2")))
    every = F.filter(F.flatten(F.transform(rings, around)), lambda e: (e.x1 != e.x2) | (e.y1 != e.y2))
    return rows.withColumn("edges", F.when(F.size(every) > 0, every))


def area(ring: Column) -> Column:
    return F.abs(F.aggregate(edges(ring), F.lit(0.0), lambda s, e: s + (e.x1 * e.y2 - e.x2 * e.y1))) / 2


def inside(ring: Column, x: Column, y: Column) -> Column:
    """Is the point inside: the edges a ray to the right crosses are odd in number."""
    crossed = F.filter(edges(ring), lambda e: ((e.y1 > y) != (e.y2 > y)) & (x < (e.x2 - e.x1) * (y - e.y1) / (e.y2 - e.y1) + e.x1))
    return F.size(crossed) % 2 == 1


def _turn(ax, ay, bx, by, cx, cy):
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def intersects(a: Column, b: Column) -> Column:
    """Do two rings share area: an edge crosses one of the other, or a corner lies inside the other."""
    cross = lambda p, q: (_turn(p.x1, p.y1, p.x2, p.y2, q.x1, q.y1) * _turn(p.x1, p.y1, p.x2, p.y2, q.x2, q.y2) < 0) & (_turn(q.x1, q.y1, q.x2, q.y2, p.x1, p.y1) * _turn(q.x1, q.y1, q.x2, q.y2, p.x2, p.y2) < 0)
    return F.exists(edges(a), lambda p: F.exists(edges(b), lambda q: cross(p, q))) | inside(b, a[0].x, a[0].y) | inside(a, b[0].x, b[0].y)


def cells(rows: DataFrame, size: float = 1.0) -> DataFrame:
    """``rows`` once for each grid cell (gx, gy) of the ring's bounding box."""
    span = lambda axis: F.sequence(F.floor(F.array_min(F.transform("ring", lambda p: p[axis])) / size), F.floor(F.array_max(F.transform("ring", lambda p: p[axis])) / size))
    return rows.withColumn("gx", F.explode(span("x"))).withColumn("gy", F.explode(span("y")))


def boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_polygons(_boundaries(spark, sf_dir))
    return rows.select("county_id", F.when(F.col("ring").isNotNull(), F.size("ring")).alias("points"), F.round(area(F.col("ring")), 6).alias("area"))


def _rings() -> str:
    corners = ", ".join(f"({i}, {dx}, {dy})" for i, (dx, dy) in enumerate((*CORNERS, CORNERS[0])))
    return f"""corner AS (SELECT * FROM (VALUES {corners}) v(i, dx, dy)),
    pt AS (SELECT county_id, i, CAST(printf('%.6f', cx + 0.5 + (0.375 + county_id % 4 * 0.125) * dx) AS DOUBLE) AS x, CAST(printf('%.6f', cy + 0.5 + (0.375 + county_id % 4 * 0.125) * dy) AS DOUBLE) AS y FROM county CROSS JOIN corner WHERE county_id <> 7),
    edge AS (SELECT a.county_id, a.i, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM pt a JOIN pt b ON b.county_id = a.county_id AND b.i = a.i + 1),
    shape AS (SELECT county_id, abs(sum(x1 * y2 - x2 * y1)) / 2 AS area, count(*) + 1 AS points FROM edge GROUP BY county_id)"""


BOUNDARIES_SQL = statement(f"WITH {_rings()} SELECT c.county_id, CAST(s.points AS INT) AS points, round(s.area, 6) AS area FROM county c LEFT JOIN shape s ON s.county_id = c.county_id", Oracle)


def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundaries over each site, the smallest first: it decides, the others give clearance."""
    rings = read_polygons(_boundaries(spark, sf_dir)).where("ring IS NOT NULL").withColumn("area", F.round(area(F.col("ring")), 9))
    from permrisk.plans.graph import query

    sites = query(lambda d: SITES)[0](spark, sf_dir).withColumn("gx", F.floor("px")).withColumn("gy", F.floor("py"))
    met = sites.join(cells(rings), ["gx", "gy"]).where(inside(F.col("ring"), F.col("px"), F.col("py")))
    over = met.groupBy("site_id").agg(F.array_sort(F.collect_list(F.struct("area", "county_id"))).alias("over"))
    return over.select("site_id", F.col("over")[0].county_id.alias("decider"), (F.size("over") - 1).alias("clearances"))


LOCATED_SQL = statement(f"""
    WITH {_rings()}, site AS ({SITES}),
    hit AS (SELECT s.site_id, e.county_id FROM site s JOIN edge e ON (e.y1 > s.py) <> (e.y2 > s.py) AND s.px < (e.x2 - e.x1) * (s.py - e.y1) / (e.y2 - e.y1) + e.x1 GROUP BY s.site_id, e.county_id HAVING count(*) % 2 = 1),
    r AS (SELECT h.*, row_number() OVER (PARTITION BY site_id ORDER BY round(s.area, 9), h.county_id) AS rn, count(*) OVER (PARTITION BY site_id) AS n FROM hit h JOIN shape s ON s.county_id = h.county_id)
    SELECT site_id, county_id AS decider, CAST(n - 1 AS INT) AS clearances FROM r WHERE rn = 1""", Oracle)


def overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of boundaries that share area, met in the cells of their boxes."""
    rings = read_polygons(_boundaries(spark, sf_dir)).where("ring IS NOT NULL").select("county_id", "ring")
    one, two = (cells(rings).select("gx", "gy", F.col("county_id").alias(n), F.col("ring").alias(f"ring_{n}")) for n in "ab")
    met = one.join(two, ["gx", "gy"]).where("a < b").dropDuplicates(["a", "b"])
    return met.where(intersects(F.col("ring_a"), F.col("ring_b"))).select(F.col("a").alias("county_id"), F.col("b").alias("other_id"))


CROSSING = """    crossing AS (SELECT DISTINCT p.county_id AS a, q.county_id AS b FROM edge p JOIN edge q ON p.county_id < q.county_id
        AND ((p.x2 - p.x1) * (q.y1 - p.y1) - (p.y2 - p.y1) * (q.x1 - p.x1)) * ((p.x2 - p.x1) * (q.y2 - p.y1) - (p.y2 - p.y1) * (q.x2 - p.x1)) < 0
        AND ((q.x2 - q.x1) * (p.y1 - q.y1) - (q.y2 - q.y1) * (p.x1 - q.x1)) * ((q.x2 - q.x1) * (p.y2 - q.y1) - (q.y2 - q.y1) * (p.x2 - q.x1)) < 0),
    within AS (SELECT p.county_id AS a, e.county_id AS b FROM pt p JOIN edge e ON p.i = 0 AND e.county_id <> p.county_id AND (e.y1 > p.y) <> (e.y2 > p.y) AND p.x < (e.x2 - e.x1) * (p.y - e.y1) / (e.y2 - e.y1) + e.x1 GROUP BY 1, 2 HAVING count(*) % 2 = 1)"""
OVERLAPPING = """SELECT a AS county_id, b AS other_id FROM crossing UNION SELECT least(a, b), greatest(a, b) FROM within"""
OVERLAPPING_SQL = statement(f"WITH {_rings()},\n{CROSSING}\n{OVERLAPPING}", Oracle)


def nearest_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve nearest other counties of each by the distance of their boundaries."""
    shapes = read_shapes(_boundaries(spark, sf_dir)).select(F.col("county_id").alias("id"), "edges")
    return k_nearest(shapes, 12, 1.0).select(F.col("id").alias("county_id"), "other_id", F.round("distance", 6).alias("distance"), "place")


def _gap(p: str, end: int, q: str) -> str:
    """Squared distance of an end of one edge and another edge, along the part of it that is nearest."""
    x, y, dx, dy = f"{p}.x{end}", f"{p}.y{end}", f"({q}.x2 - {q}.x1)", f"({q}.y2 - {q}.y1)"
    t = f"least(1.0, greatest(0.0, (({x} - {q}.x1) * {dx} + ({y} - {q}.y1) * {dy}) / ({dx} * {dx} + {dy} * {dy})))"
    return f"power({x} - {q}.x1 - {t} * {dx}, 2) + power({y} - {q}.y1 - {t} * {dy}, 2)"


NEAREST_SQL = statement(f"""
    WITH {_rings()},
{CROSSING},
    overlap AS ({OVERLAPPING}),
    gap AS (SELECT p.county_id AS a, q.county_id AS b, sqrt(min(least({_gap('p', 1, 'q')}, {_gap('p', 2, 'q')}, {_gap('q', 1, 'p')}, {_gap('q', 2, 'p')}))) AS d FROM edge p JOIN edge q ON p.county_id <> q.county_id GROUP BY 1, 2),
    r AS (SELECT g.a, g.b, CASE WHEN o.county_id IS NULL THEN round(g.d, 9) ELSE 0.0 END AS d FROM gap g LEFT JOIN overlap o ON o.county_id = least(g.a, g.b) AND o.other_id = greatest(g.a, g.b)),
    n AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS place FROM r)
    SELECT a AS county_id, b AS other_id, round(d, 6) AS distance, CAST(place AS INT) AS place FROM n WHERE place <= 12""", Oracle)

QUERIES = {"geo_nearest_boundaries": (nearest_boundaries, NEAREST_SQL), "geo_boundaries": (boundaries, BOUNDARIES_SQL), "geo_located": (located, LOCATED_SQL), "geo_overlapping": (overlapping, OVERLAPPING_SQL)}
