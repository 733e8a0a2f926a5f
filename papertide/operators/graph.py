"""Graphs of shared papers, and figures of a drawn graph."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papertide.functions.runtime import kept, spread
from papertide.operators import aggregates


def edges(member: DataFrame, node: str = "person") -> DataFrame:
    """a < b and weight: the papers two nodes share."""
    member = spread(member, "paper")
    left, right = member.select("paper", F.col(node).alias("a")), member.select("paper", F.col(node).alias("b"))
    pair = left.join(right, "paper").where("a < b").select("a", "b")
    return spread(pair, "a", "b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight"))


def degrees(edge: DataFrame, member: DataFrame, node: str = "person") -> DataFrame:
    """node, papers, degree and shared weight of each node."""
    ends = edge.select(F.col("a").alias("node"), "weight").union(edge.select("b", "weight"))
    deg = ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("linked"))
    papers = member.groupBy(F.col(node).alias("node")).agg(F.count(F.lit(1)).alias("papers"))
    return papers.join(deg, "node", "left").fillna({"degree": 0, "linked": 0})


def barycentre(edge: DataFrame) -> DataFrame:
    """For each right-hand node of a bipartite graph: the weighted mean place of its left-hand ones, which rank by their id. edge: left, right, weight."""
    place = edge.select("left").distinct().select("left", (F.col("left") * 1.0).alias("place"))
    return edge.join(place, "left").groupBy("right").agg(F.round(F.sum(F.col("place") * F.col("weight")) / F.sum("weight"), 6).alias("centre"), F.sum("weight").alias("weight"))


def stress(edge: DataFrame, spot: DataFrame, reach: float = 190.0) -> DataFrame:
    """One row: how far the drawn lengths are from the wished ones (shorter for heavier edges) under the best scale. spot: node, x, y."""
    a, b = (spot.select(F.col("node").alias(n), F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}")) for n in "ab")
    d = F.sqrt(F.pow(F.col("xa") - F.col("xb"), 2) + F.pow(F.col("ya") - F.col("yb"), 2))
    rows = edge.join(a, "a").join(b, "b").select(d.alias("d"), (reach * F.pow("weight", F.lit(-0.8 / 3))).alias("l"))
    sums = rows.agg(F.sum(F.col("d") * F.col("l")).alias("dl"), F.sum(F.col("d") * F.col("d")).alias("dd"), F.sum(F.col("l") * F.col("l")).alias("ll"))
    return sums.select(F.round(1 - F.col("dl") * F.col("dl") / F.col("dd") / F.col("ll"), 6).alias("stress"), F.round(F.col("dl") / F.col("dd"), 6).alias("scale"))


def component_sizes(component: DataFrame) -> DataFrame:
    """component, its first and number of nodes, and its place: the largest first, ties by the first node. component: node, component."""
    sized = component.groupBy("component").agg(F.count(F.lit(1)).alias("nodes"), F.min("node").alias("first"))
    return aggregates.numbered(sized, F.col("nodes").desc(), F.col("first").asc())


def institution_members(own: DataFrame, printed: DataFrame, roster: DataFrame, parents: dict[str, str]) -> DataFrame:
    """paper and node of the institutions that take part in a paper.

    Those on the roster take part through their people only (own: paper, short). Others join where the paper prints them (printed: paper, places): not generic matches, and neither a
    roster institution nor the university above one; they are named "x-" and their short name. Where a member school takes part, the university above it does not.
    """
    above = [F.lit(x) for pair in parents.items() for x in pair]
    named = printed.select("paper", F.explode("places").alias("p")).where("p.full <> p.short").select("paper", "p.short", "p.full").distinct()
    held = roster.select("short").union(roster.select(F.create_map(*above)[F.col("short")].alias("short"))).dropna().distinct()
    other = named.join(held, "short", "left_anti").join(roster.select(F.col("institution").alias("full")).distinct(), "full", "left_anti")
    members = own.select("paper", "short", F.col("short").alias("node")).union(other.select("paper", "short", F.concat(F.lit("x-"), "short").alias("node"))).distinct()
    covered = members.select("paper", F.create_map(*above)[F.col("short")].alias("short")).dropna().distinct()
    return members.join(covered, ["paper", "short"], "left_anti").select("paper", "node")


def hubs(edge: DataFrame, component: DataFrame) -> DataFrame:
    """component and hub: the node linked to every other one of a group of at least three that is no chain (some node has three links, or it has a cycle); the least of several."""
    ends = edge.select(F.col("a").alias("node")).union(edge.select(F.col("b").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    group = component.join(ends, "node", "left").fillna(0, ["degree"]).groupBy("component")
    size = group.agg(F.count(F.lit(1)).alias("n"), F.max("degree").alias("top"), F.sum("degree").alias("ends"), F.min_by("node", F.struct((-F.col("degree")).alias("d"), "node")).alias("hub"))
    return size.where((F.col("n") >= 3) & ((F.col("top") >= 3) | (F.col("ends") / 2 >= F.col("n"))) & (F.col("top") == F.col("n") - 1)).select("component", "hub")


#: The side of the squares in which near things meet.
CELL = 100.0


def _meet(left: DataFrame, right: DataFrame, cell: float = CELL) -> DataFrame:
    """Pairs of boxes that overlap, each once: they meet in the squares that both touch, and count in the one that holds the corner of their overlap.

    left, right: x0, x1, y0, y1 and other columns, in the right one under other names with `_r`."""
    at = lambda c: F.floor(F.col(c) / cell)

    def dealt(boxes: DataFrame, end: str) -> DataFrame:
        wide = boxes.withColumn("cx", F.explode(F.sequence(at("x0" + end), at("x1" + end))))
        return wide.withColumn("cy", F.explode(F.sequence(at("y0" + end), at("y1" + end))))

    both = dealt(left, "").join(dealt(right, "_r"), ["cx", "cy"])
    over = (F.col("x0") <= F.col("x1_r")) & (F.col("x0_r") <= F.col("x1")) & (F.col("y0") <= F.col("y1_r")) & (F.col("y0_r") <= F.col("y1"))
    home = (F.col("cx") == F.floor(F.greatest("x0", "x0_r") / cell)) & (F.col("cy") == F.floor(F.greatest("y0", "y0_r") / cell))
    return both.where(over & home).drop("cx", "cy")


def _lines(edge: DataFrame, spot: DataFrame, around: float = 0.0) -> DataFrame:
    """a, b, their places and the box around each line."""
    a, b = (spot.select(F.col("node").alias(n), F.col("x").alias(n + "x"), F.col("y").alias(n + "y")) for n in "ab")
    rows = edge.select("a", "b").join(a, "a").join(b, "b")
    box = {"x0": F.least("ax", "bx") - around, "x1": F.greatest("ax", "bx") + around, "y0": F.least("ay", "by") - around, "y1": F.greatest("ay", "by") + around}
    return rows.select("a", "b", "ax", "ay", "bx", "by", *(c.alias(k) for k, c in box.items()))


def _renamed(frame: DataFrame) -> DataFrame:
    return frame.select(*(F.col(c).alias(c + "_r") for c in frame.columns))


def crossings(edge: DataFrame, spot: DataFrame) -> DataFrame:
    """The pairs of lines (a, b, a_r, b_r) with four different ends that properly cross. edge: a, b; spot: node, x, y."""
    line = _lines(edge, spot)
    met = _meet(line, _renamed(line)).where((F.struct("a", "b") < F.struct("a_r", "b_r")) & (F.col("a") != F.col("a_r")) & (F.col("a") != F.col("b_r")) & (F.col("b") != F.col("a_r")) & (F.col("b") != F.col("b_r")))
    c = F.col
    side = lambda p, q, r: (c(q[0]) - c(p[0])) * (c(r[1]) - c(p[1])) - (c(q[1]) - c(p[1])) * (c(r[0]) - c(p[0]))
    p1, p2, p3, p4 = ("ax", "ay"), ("bx", "by"), ("ax_r", "ay_r"), ("bx_r", "by_r")
    cross = (side(p3, p4, p1) * side(p3, p4, p2) < 0) & (side(p1, p2, p3) * side(p1, p2, p4) < 0)
    return met.where(cross).select("a", "b", "a_r", "b_r")


def crossed(pairs: DataFrame) -> DataFrame:
    """a, b and crossings: how often each line crosses others, of those that do. Each pair counts for both its lines, and is counted where it is found."""
    both = pairs.select("a", "b").union(pairs.select("a_r", "b_r"))
    return both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("crossings"))


#: Upright bands of a drawing, each a task's own; places within this are told apart exactly by quotients in double precision.
BANDS, EXACT = 96, 2**16


def _greater_before(rank: np.ndarray) -> np.ndarray:
    """For each value of a permutation of 0..n-1: how many greater ones stand before it. One pass for each bit: values that agree in the bits above stand together, in their order."""
    n = len(rank)
    found, here, place = np.zeros(n, np.int64), rank.astype(np.int32), np.arange(n, dtype=np.int32)
    for bit in reversed(range(max(n - 1, 0).bit_length())):
        high = (here >> bit) & 1
        ones = np.zeros(n + 1, np.int32)
        np.cumsum(high, out=ones[1:])
        start = (here >> (bit + 1)) << (bit + 1)  # of the values with the same bits above: as many as there are lower values
        before = ones[:-1] - ones[start]
        low = high == 0
        found[here[low]] += before[low]
        at = np.where(low, place - before, start + (1 << bit) + before)
        there = np.empty_like(here)
        there[at] = here
        here = there
    return found


def _band_crossings(lx: np.ndarray, ly: np.ndarray, rx: np.ndarray, ry: np.ndarray, begin: float, end: float) -> np.ndarray:
    """How many proper crossings each line has with begin <= x < end. Lines go from left to right and overlap the band; none is a point.

    Between two neighbouring ends of lines, lines cross where their order changes: counted as inversions, without making pairs. At an end's x, those cross that meet there with different slopes, and go on."""
    total, dx, dy = np.zeros(len(lx), np.int64), rx - lx, ry - ly
    upright, slope = dx == 0, dy / np.where(dx == 0, 1, dx)
    at = lambda i, x: (ly[i] * dx[i] + (x - lx[i]) * dy[i]) / dx[i]
    ends = np.concatenate([lx, rx])
    stops = np.unique(np.concatenate([ends[(ends > begin) & (ends < end)], [begin, end]]))
    leaning, standing = np.flatnonzero(~upright), np.flatnonzero(upright)
    for x0, x1 in zip(stops[:-1], stops[1:], strict=True):
        i = leaning[(lx[leaning] <= x0) & (rx[leaning] >= x1)]
        left, right = at(i, x0), at(i, x1)
        order = np.lexsort((right, left))
        i, left, right = i[order], left[order], right[order]
        rank = np.empty(len(i), np.int64)
        rank[np.argsort(right, kind="stable")] = np.arange(len(i))
        total[i] += 2 * _greater_before(rank)[rank] + rank - np.arange(len(i))
        inner = lx[i] < x0  # those that pass x0
        i, left = i[inner], left[inner]
        same = np.concatenate([[False], left[1:] == left[:-1], [False]])
        tied = np.flatnonzero(same[1:] | same[:-1])
        if len(tied):
            group, n = np.unique(left[tied], return_inverse=True, return_counts=True)[1:]
            alike, m = np.unique(np.stack([left[tied], slope[i[tied]]]), axis=1, return_inverse=True, return_counts=True)[1:]
            total[i[tied]] += n[group.ravel()] - m[alike.ravel()]
        up = standing[lx[standing] == x0]
        if len(up):
            low, high = np.minimum(ly[up], ry[up]), np.maximum(ly[up], ry[up])
            total[up] += np.searchsorted(left, high, "left") - np.searchsorted(left, low, "right")
            total[i] += np.searchsorted(np.sort(low), left, "left") - np.searchsorted(np.sort(high), left, "right")
    return total


def crossing_counts(edge: DataFrame, spot: DataFrame, bands: int = BANDS) -> DataFrame:
    """a, b and crossings of each line that crosses others, as crossed(crossings(edge, spot)) gives them, without making the pairs: time grows with the lines times the different x that they pass.

    Places must be whole numbers up to EXACT for that; of others, the pairs are made."""
    line = _lines(edge, spot).drop("x0", "x1", "y0", "y1").dropna()
    whole = [(F.col(c) == F.floor(c)) & (F.abs(F.col(c)) <= EXACT) for c in ("x", "y")]
    seen = spot.dropna(subset=["x", "y"]).agg(F.min("x").alias("low"), F.max("x").alias("high"), aggregates.count_if(~(whole[0] & whole[1])).alias("other")).first()
    if seen.other or seen.low is None:
        return crossed(crossings(edge, spot))
    turned = F.col("ax") > F.col("bx")
    ends = {k: F.when(turned, F.col(q + c)).otherwise(F.col(p + c)).cast("int") for k, p, q, c in (("lx", "a", "b", "x"), ("ly", "a", "b", "y"), ("rx", "b", "a", "x"), ("ry", "b", "a", "y"))}
    line = line.where("ax <> bx or ay <> by").select("a", "b", *(c.alias(k) for k, c in ends.items()))
    parts = [k / bands for k in range(1, bands)]
    cuts = sorted(set(spot.dropna(subset=["x", "y"]).approxQuantile("x", parts, 0.1 / bands))) if parts else []
    stops = [seen.low - 1.0, *cuts, seen.high + 1.0]

    def laid(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            first = np.searchsorted(cuts, part.lx, "right")
            n = np.maximum(np.searchsorted(cuts, part.rx, "left") - first, 0) + 1
            each = part.loc[part.index.repeat(n)]
            yield each.assign(band=(np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())).astype("int32"))

    def counted(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        found = _band_crossings(*(part[c].to_numpy(np.float64) for c in ("lx", "ly", "rx", "ry")), stops[key[0]], stops[key[0] + 1])
        return part[["a", "b"]].assign(crossings=found)[found > 0]

    kinds = dict(line.dtypes)
    named = f"a {kinds['a']}, b {kinds['b']}"
    spread = line.mapInPandas(laid, f"{named}, lx int, ly int, rx int, ry int, band int").repartitionByRange(len(stops), "band")
    return spread.groupBy("band").applyInPandas(counted, f"{named}, crossings long").groupBy("a", "b").agg(F.sum("crossings").alias("crossings"))


#: The side of the tiles in which places are tabled, queries that a task takes in one of them, rows that it looks up at once, and the greatest gap that is counted so.
TILE, ASKED, AT_ONCE, WIDEST = 1024, 250_000, 1 << 16, 2**8
_SIDE = 2 * (EXACT // TILE + 2)  # tiles in a row of them, with those around


def _tile(tx: np.ndarray, ty: np.ndarray) -> np.ndarray:
    return ((ty + _SIDE // 2) * _SIDE + tx + _SIDE // 2).astype(np.int32)


def _strips(part: pd.DataFrame, gap: int) -> dict[str, np.ndarray]:
    """Lines turned so that they do not fall: their begin x, y, way dx, dy, its square s, and the greatest k with k * k < gap * gap * s. A place u, v away from the begin
    is beside the line where 0 < u * dx + v * dy < s, and nearer than the gap where |u * dy - v * dx| <= k."""
    ax, ay, bx, by = (part[c].to_numpy(np.float64) for c in ("ax", "ay", "bx", "by"))
    turned = by < ay
    x, y, dx, dy = np.where(turned, bx, ax), np.where(turned, by, ay), np.where(turned, ax - bx, bx - ax), np.abs(by - ay)
    s = dx * dx + dy * dy
    return {"x": x, "y": y, "dx": dx, "dy": dy, "s": s, "k": np.floor(np.sqrt(gap * gap * s - 1))}


def _strip_rows(strip: dict[str, np.ndarray], gap: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and last y (or some beyond) at which strips have places with left <= x <= right."""
    x, y, dx, dy, s, k = strip.values()
    side = np.ceil(gap * np.abs(dx) / np.sqrt(s))
    low, high = -side, dy + side
    with np.errstate(divide="ignore"):
        one, two = ((left - x) * dy - k - 0.5) / dx, ((right - x) * dy + k + 0.5) / dx
    leans = dx != 0
    low, high = np.where(leans, np.maximum(low, np.floor(np.minimum(one, two))), low), np.where(leans, np.minimum(high, np.ceil(np.maximum(one, two))), high)
    return y + low, y + high


def _strip_places(v: np.ndarray, dx: np.ndarray, dy: np.ndarray, s: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest whole u of each strip in a row v. Halves keep quotients off whole numbers, so that rounding does not matter, and an upright or level line's from 0 / 0."""
    with np.errstate(divide="ignore"):
        one, two = (0.5 - v * dy) / dx, (s - 0.5 - v * dy) / dx
        low, high = (v * dx - k - 0.5) / dy, (v * dx + k + 0.5) / dy
    return np.floor(np.maximum(np.minimum(one, two), low)) + 1, np.ceil(np.minimum(np.maximum(one, two), high)) - 1


class _Places:
    """A tile's places: for each row that has some, how many nodes stand left of each x."""

    def __init__(self, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> None:
        self.left, (self.rows, row) = float(x[0] // TILE * TILE), np.unique(y, return_inverse=True)
        table = np.zeros((len(self.rows), TILE + 1), np.int64)
        np.add.at(table, (row, x - int(self.left) + 1), n)
        np.cumsum(table, axis=1, out=table)
        self.before = (table.astype(np.int32) if n.sum() < 2**31 else table).ravel()

    def met(self, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers of queries and of their rows with low <= y <= high, some at once."""
        first = np.searchsorted(self.rows, low, "left")
        n = np.maximum(np.searchsorted(self.rows, high, "right") - first, 0)
        ends = np.cumsum(n)
        lo = 0
        while lo < len(n):
            done = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, done + AT_ONCE, "right")))
            which = np.repeat(np.arange(lo, hi), n[lo:hi])
            yield which, np.arange(len(which)) + np.repeat(first[lo:hi] - (ends[lo:hi] - n[lo:hi] - done), n[lo:hi])
            lo = hi

    def between(self, row: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """How many nodes stand at low <= x <= high in each row."""
        begin, a = row * (TILE + 1), np.clip(low - self.left, 0, TILE)
        b = np.maximum(np.clip(high + 1 - self.left, 0, TILE), a)
        return self.before[begin + b.astype(np.int64)] - self.before[begin + a.astype(np.int64)]


def _passed(part: pd.DataFrame, places: _Places, gap: int) -> dict[str, int]:
    """How many nodes lines pass within the gap."""
    strip, lines = _strips(part, gap), 0
    low, high = _strip_rows(strip, gap, places.left, places.left + TILE)
    for which, row in places.met(low, high):
        x, y, *way = (c[which] for c in strip.values())
        least, most = _strip_places(places.rows[row] - y, *way)
        lines += int(places.between(row, x + least, x + most).sum())
    return {"lines": lines}


def _close(part: pd.DataFrame, places: _Places, gap: int) -> dict[str, int]:
    """How many nodes stand within the gap of nodes (themselves too), and right of them under their labels, and at one x with them in reach of their labels (themselves too)."""
    x, y, reach, weight = (part[c].to_numpy(np.float64) for c in ("x", "y", "reach", "n"))
    weight, near, under, same, high = weight.astype(np.int64), 0, 0, 0, max(gap, LABEL) - 1
    for which, row in places.met(y - high, y + high):
        at, times, v = x[which], weight[which], np.abs(places.rows[row] - y[which])
        wide = np.floor(np.sqrt(np.maximum(gap * gap - 1 - v * v, 0)))
        near += int((times * (v < gap) * places.between(row, at - wide, at + wide)).sum())
        times = times * (v < LABEL)
        under += int((times * places.between(row, at + 1, reach[which])).sum())
        same += int((times * places.between(row, at, at)).sum())
    return {"near": near, "under": under, "same": same}


def _in_tiles(asked: DataFrame, places: DataFrame, lay: Callable[[pd.DataFrame], tuple[np.ndarray, np.ndarray]], count: Callable[[pd.DataFrame, _Places], dict[str, int]], into: list[str]) -> DataFrame:
    """One row: the sums of what queries count among the places (x, y, n) of each tile that they touch. lay: numbers of queries and their tiles.

    A tile of many queries is shared out to several tasks, each with the tile's places: at most as many as it has whole numbers."""

    def tiles(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            tile, n = np.unique(lay(part)[1], return_counts=True)
            yield pd.DataFrame({"tile": tile, "n": n})

    many = {r.tile: r.n for r in asked.mapInPandas(tiles, "tile int, n long").groupBy("tile").agg(F.sum("n").alias("n")).collect()}  # of a drawing of bounded size
    shares = {tile: n // ASKED + 1 for tile, n in many.items() if n > ASKED}
    cores = asked.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(len(many) + sum(shares.values()), max(4 * cores, 2 * sum(many.values()) // ASKED)))

    def share_of(tile: np.ndarray) -> np.ndarray:
        out, (found, at) = np.ones(len(tile), np.int64), np.unique(tile, return_inverse=True)
        return np.array([shares.get(t, 1) for t in found.tolist()], np.int64)[at] if len(found) else out

    def laid(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            which, tile = lay(part)
            yield part.iloc[which].assign(tile=tile, share=(which % share_of(tile)).astype(np.int32))

    def tabled(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            tile = _tile(part.x.to_numpy() // TILE, part.y.to_numpy() // TILE)
            n = share_of(tile)
            which = np.repeat(np.arange(len(part)), n)
            yield part.iloc[which].assign(tile=tile[which], share=(np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32))

    def counted(part: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(part) or not len(held):
            return pd.DataFrame({c: pd.Series(dtype=np.int64) for c in into})
        return pd.DataFrame([count(part, _Places(*(held[c].to_numpy(np.int64) for c in ("x", "y", "n"))))])

    def dealt(frame: DataFrame, work: Callable) -> DataFrame:
        schema = ", ".join(f"{c} {t}" for c, t in frame.dtypes) + ", tile int, share int"
        return frame.mapInPandas(work, schema).repartition(tasks, "tile", "share").groupBy("tile", "share")

    found = dealt(asked, laid).cogroup(dealt(places, tabled)).applyInPandas(counted, ", ".join(f"{c} long" for c in into))
    return found.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in into))


#: Labels this far apart in y do not overlap.
LABEL = 24


def rule_breaks(edge: DataFrame, spot: DataFrame, gap: float = 40.0) -> DataFrame:
    """Numbers of lines that pass a node at which they do not end within `gap`, of labels that overlap, and of nodes too close to read. spot: node, x, y, label.

    Where places and the gap are whole numbers (up to EXACT and WIDEST), each node has one place and all have labels, near things are counted by rows of tiles, exactly and without making
    pairs: time grows with lines and nodes times the different y that they pass. Else the pairs are made."""
    spot = kept(spot.select("node", "x", "y", "label").dropna(subset=["x", "y"]))
    whole = [(F.col(c) == F.floor(c)) & (F.abs(F.col(c)) <= EXACT) for c in ("x", "y")]
    wide = 18 + 8.4 * F.length("label")
    seen = spot.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("node").alias("nodes"), aggregates.count_if(~F.coalesce(whole[0] & whole[1] & (wide <= EXACT), F.lit(False))).alias("other")).first()
    if seen.other or seen.n != seen.nodes or not seen.n or not (float(gap).is_integer() and 1 <= gap <= WIDEST):
        return _rule_breaks_of_pairs(edge, spot, gap)
    gap, at = int(gap), [F.col(c).cast("int").alias(c) for c in ("x", "y")]
    # Under a label is what stands left of its end: the greatest whole number below it.
    reach = (F.ceil(F.col("x") + wide) - 1).cast("int").alias("reach")
    line = kept(_lines(edge, spot).where("ax <> bx or ay <> by").select(*(F.col(c).cast("int").alias(c) for c in ("ax", "ay", "bx", "by"))))
    places = spot.select(*at).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    boxes = spot.select(*at, reach).groupBy("x", "y", "reach").agg(F.count(F.lit(1)).alias("n"))

    def grid(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which query, and the number of each tile from low to high: of one direction."""
        first = np.maximum(low // TILE, -_SIDE // 2)
        n = np.maximum(np.minimum(high // TILE, _SIDE // 2 - 1) - first + 1, 0).astype(np.int64)
        which = np.repeat(np.arange(len(n)), n)
        return which, first[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)

    def by_strip(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        strip = _strips(part, gap)
        side = gap * strip["dy"] / np.sqrt(strip["s"])
        which, tx = grid(np.minimum(strip["x"], strip["x"] + strip["dx"]) - side, np.maximum(strip["x"], strip["x"] + strip["dx"]) + side)
        inner, ty = grid(*_strip_rows({c: v[which] for c, v in strip.items()}, gap, tx * TILE, (tx + 1) * TILE))
        return which[inner], _tile(tx[inner], ty)

    def by_box(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        x, y, reach = (part[c].to_numpy(np.float64) for c in ("x", "y", "reach"))
        which, tx = grid(x - gap, np.maximum(reach, x + gap))
        high = max(gap, LABEL)
        inner, ty = grid(y[which] - high, y[which] + high)
        return which[inner], _tile(tx[inner], ty)

    lines = _in_tiles(line, places, by_strip, lambda part, held: _passed(part, held, gap), ["lines"])
    close = _in_tiles(boxes, places, by_box, lambda part, held: _close(part, held, gap), ["near", "under", "same"])
    # Of nodes, each pair was met from both, and each met itself; of labels, only those at one x.
    pairs = lambda c: F.expr(f"({c} - {seen.n}) div 2")
    return lines.crossJoin(close).select("lines", (F.col("under") + pairs("same")).alias("labels"), pairs("near").alias("nodes"))  # one row each


def _rule_breaks_of_pairs(edge: DataFrame, spot: DataFrame, gap: float) -> DataFrame:
    """rule_breaks() of any places, from the pairs of things that share a square."""
    node = spot.select("node", "x", "y", "label", F.col("x").alias("x0"), F.col("x").alias("x1"), F.col("y").alias("y0"), F.col("y").alias("y1"))
    met = _meet(_lines(edge, spot, gap), _renamed(node)).where("node_r <> a and node_r <> b")
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    square = dx * dx + dy * dy
    t = ((F.col("x_r") - F.col("ax")) * dx + (F.col("y_r") - F.col("ay")) * dy) / F.when(square == 0, 1.0).otherwise(square)
    far = F.hypot(F.col("x_r") - F.col("ax") - t * dx, F.col("y_r") - F.col("ay") - t * dy)
    passed = met.where((t > 0) & (t < 1) & (far < gap)).agg(F.count(F.lit(1)).alias("lines"))
    # The label's box begins at the node; boxes of nodes and labels meet, with the space around nodes.
    width, tall = 18 + 8.4 * F.length("label"), max(gap, LABEL / 2)
    boxed = spot.select("node", "x", "y", width.alias("w"), (F.col("x") - gap).alias("x0"), (F.col("x") + F.greatest(width, F.lit(gap))).alias("x1"), (F.col("y") - tall).alias("y0"), (F.col("y") + tall).alias("y1"))
    pair = _meet(boxed, _renamed(boxed)).where("node < node_r")
    first = F.col("x") <= F.col("x_r")
    overlap = F.when(first, F.col("x") + F.col("w") > F.col("x_r")).otherwise(F.col("x_r") + F.col("w_r") > F.col("x")) & (F.abs(F.col("y") - F.col("y_r")) < LABEL)
    near = F.hypot(F.col("x") - F.col("x_r"), F.col("y") - F.col("y_r")) < gap
    close = pair.agg(aggregates.count_if(overlap).alias("labels"), aggregates.count_if(near).alias("nodes"))
    return passed.crossJoin(close)  # one row each
