"""Crossings of lines counted by bands, against the pairs themselves."""

from __future__ import annotations

import random

import numpy as np

from papertide.operators import graph


def crossed(lines):
    """How often each line (x, y, x, y) properly crosses others, from all pairs."""
    side = lambda ax, ay, bx, by, x, y: (bx - ax) * (y - ay) - (by - ay) * (x - ax)
    n = [0] * len(lines)
    for i, p in enumerate(lines):
        for j, q in enumerate(lines[:i]):
            if side(*q, *p[:2]) * side(*q, *p[2:]) < 0 and side(*p, *q[:2]) * side(*p, *q[2:]) < 0:
                n[i] += 1
                n[j] += 1
    return n


def test_counted_crossings_are_those_of_all_pairs(spark):
    draw = random.Random(4)
    # Few places, so that lines stand upright, touch, lie on one another and meet at ends of others.
    spots = [(k, float(draw.randrange(9)), float(draw.randrange(7))) for k in range(60)]
    edges = sorted({(draw.randrange(60), draw.randrange(60)) for _ in range(260)})
    edge, spot = spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame(spots, "node long, x double, y double")
    place = {k: (x, y) for k, x, y in spots}
    want = {e: n for e, n in zip(edges, crossed([place[a] + place[b] for a, b in edges]), strict=True) if n}
    for bands in (1, 4):
        assert {(r.a, r.b): r.crossings for r in graph.crossing_counts(edge, spot, bands).collect()} == want
    # Places that are no whole numbers take the pairs.
    moved = spot.selectExpr("node", "x / 3 as x", "y / 3 as y")
    pairs = {(r.a, r.b): r.crossings for r in graph.crossed(graph.crossings(edge, moved)).collect()}
    assert {(r.a, r.b): r.crossings for r in graph.crossing_counts(edge, moved).collect()} == pairs


def test_many_lines_through_one_square_make_no_pairs():
    # 4 * 10^10 pairs: left and right ends in opposite orders, so that each line crosses all others.
    n = 200_000
    y = np.random.default_rng(1).permutation(n).astype(float)
    got = graph._band_crossings(np.zeros(n), y, np.ones(n), n - y, 0.0, 1.0)
    assert (got == n - 1).all()
