"""Near things of a drawing counted by rows of tiles, against the pairs themselves."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest

from papertide.operators import graph


def rows(frame):
    return [tuple(r) for r in frame.collect()]


def drawing(spark, seed, nodes, wide, high, edges, low=0):
    draw = random.Random(seed)
    spots = [(k, float(draw.randrange(low, wide)), float(draw.randrange(low, high)), "m" * draw.randrange(1, 10)) for k in range(nodes)]
    lines = sorted({(draw.randrange(nodes), draw.randrange(nodes)) for _ in range(edges)})
    return spark.createDataFrame(lines, "a long, b long"), spark.createDataFrame(spots, "node long, x double, y double, label string")


# Few places, so that lines stand upright, lie level, are points and pass at the gap itself; and places on many tiles, also left of and below 0.
@pytest.mark.parametrize("gap, drawn", [(3.0, (1, 60, 11, 9, 300)), (5.0, (2, 80, 40, 30, 300)), (40.0, (3, 300, 3000, 2500, 400, -3000)), (40.0, (4, 200, 150, 90, 200))])
def test_counted_breaks_are_those_of_all_pairs(spark, monkeypatch, gap, drawn):
    edge, spot = drawing(spark, *drawn)
    want = rows(graph._rule_breaks_of_pairs(edge, spot, gap))
    assert all(want[0]) and rows(graph.rule_breaks(edge, spot, gap)) == want
    # A tile shared out to several tasks, and rows looked up a few at once.
    monkeypatch.setattr(graph, "ASKED", 40)
    monkeypatch.setattr(graph, "AT_ONCE", 5)
    assert rows(graph.rule_breaks(edge, spot, gap)) == want


def test_other_places_take_the_pairs(spark):
    edge, spot = drawing(spark, 5, 60, 100, 80, 200)
    other = (spot.selectExpr("node", "x / 3 as x", "y", "label"), spot.selectExpr("node", "x", "y", "nullif(label, 'm') as label"), spot.union(spot.where("node < 9")), spot.selectExpr("node", "nullif(x, 7) as x", "y", "label"), spot.where("node < 0"))
    for moved in other:
        assert rows(graph.rule_breaks(edge, moved)) == rows(graph._rule_breaks_of_pairs(edge, moved, 40.0))


def test_many_lines_past_many_nodes_make_no_pairs():
    # 4 * 10^10 pairs: each line passes all nodes, and nodes stand on one another.
    n = 200_000
    places = graph._Places(np.arange(100, 200), np.full(100, 5), np.full(100, n // 100))
    line = pd.DataFrame({"ax": np.zeros(n, int), "ay": np.arange(n) % 9, "bx": np.full(n, 1000), "by": np.arange(n) % 9})
    assert graph._passed(line, places, 40) == {"lines": n * n}
    assert graph._close(pd.DataFrame({"x": np.arange(100, 200), "y": 5, "reach": 300, "n": n // 100}), places, 40)["same"] == n * n // 100
