"""The nearest shapes against all pairs in plain Python."""

import json
import math
import random

import pytest

from permrisk.operators.nearest import k_nearest
from permrisk.plans.geometry import read_shapes


def edges(rings):
    return [(*r[i], *r[(i + 1) % len(r)]) for r in rings for i in range(len(r))]


def inside(es, x, y):
    return sum((y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 for x1, y1, x2, y2 in es) % 2 == 1


def end_gap(x, y, e):
    x1, y1, x2, y2 = e
    dx, dy = x2 - x1, y2 - y1
    t = min(1, max(0, ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy)))
    return math.hypot(x - x1 - t * dx, y - y1 - t * dy)


def side(e, x, y):
    return (e[2] - e[0]) * (y - e[1]) - (e[3] - e[1]) * (x - e[0])


def gap(a, b):
    if any(inside(b, *e[:2]) for e in a) or any(inside(a, *e[:2]) for e in b):
        return 0.0
    best = math.inf
    for p in a:
        for q in b:
            if side(p, *q[:2]) * side(p, *q[2:]) < 0 and side(q, *p[:2]) * side(q, *p[2:]) < 0:
                return 0.0
            best = min(best, end_gap(*p[:2], q), end_gap(*p[2:], q), end_gap(*q[:2], p), end_gap(*q[2:], p))
    return round(best, 9)


def square(x, y, w):
    return [[x, y], [x + w, y], [x + w, y + w], [x, y + w]]


def brute(shapes, k):
    es = {i: edges(r) for i, r in shapes.items()}
    return {i: sorted((gap(es[i], es[j]), j) for j in shapes if j != i)[:k] for i in shapes}


def answered(spark, rows, k, size):
    got: dict = {}
    shapes = read_shapes(spark.createDataFrame(rows, "id int, geojson string"))
    for r in k_nearest(shapes, k, size).orderBy("id", "place").collect():
        got.setdefault(r.id, []).append((r.distance, r.other_id))
    return got


def polygon(rings):
    return json.dumps({"type": "Polygon", "coordinates": [[*r, r[0]] for r in rings]})


@pytest.mark.parametrize("size", [0.7, 50.0])
def test_same_as_all_pairs(spark, size):
    dice = random.Random(5)
    shapes = {i: [square(dice.uniform(0, 8), dice.uniform(0, 8), dice.uniform(0.1, 1.5))] for i in range(24)}
    shapes |= {30: [square(60, 60, 1)], 31: [square(63, 60, 2)]}  # far from all others
    shapes |= {40: [square(20, 0, 6), square(22, 2, 2)], 41: [square(22.5, 2.5, 0.5)], 42: [square(20.5, 0.5, 0.5)]}  # a hole with a shape in it, and one beside it
    shapes |= {50: [square(3, 3, 1)], 51: [square(3, 3, 1)], 52: [square(4, 3, 1)]}  # equal, and one that shares an edge
    rows = [(i, polygon(r)) for i, r in shapes.items()]
    assert answered(spark, rows, 4, size) == {i: [pytest.approx(x) for x in n] for i, n in brute(shapes, 4).items()}


def test_parts_holes_and_what_is_no_shape(spark):
    two = json.dumps({"type": "MultiPolygon", "coordinates": [[square(0, 0, 1)], [square(10, 0, 4), square(11, 1, 2)]]})
    rows = [(1, two), (2, polygon([square(11.5, 1.5, 1)])), (3, polygon([square(0.2, 0.2, 0.1)])), (4, None), (5, "{"), (6, json.dumps({"type": "Point", "coordinates": []})), (None, polygon([square(0, 0, 1)])), (7, polygon([[[0, 0], [1, 1]]]))]
    got = answered(spark, rows, 9, 1.0)
    assert {i: [j for _, j in n] for i, n in got.items()} == {1: [3, 2], 2: [1, 3], 3: [1, 2]}
    assert [d for d, _ in got[1]] == [0.0, 0.5]
    assert answered(spark, rows[3:4], 3, 1.0) == {} and answered(spark, rows[:1], 3, 1.0) == {}
