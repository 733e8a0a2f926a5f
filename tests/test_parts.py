"""Records that are gathered and settled a part at a time: what is found does not change, and what a part keeps goes with it."""

from __future__ import annotations

import glob
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from papertide.functions.runtime import in_turn, kept, shared_folder
from papertide.operators import resolution
from papertide.plans import catalog, resolved

FOLDER = "/root/testdata/sf0.001"


def tables(spark):
    return set(glob.glob(f"{shared_folder(spark).removeprefix('file:')}/kept-*"))


def test_what_a_frame_keeps_goes_before_the_next_is_made(spark):
    before, seen = tables(spark), []

    def frame(k):
        seen.append(len(tables(spark) - before))
        return kept(spark.range(10).withColumn("part", F.lit(k))).groupBy("part").agg(F.count(F.lit(1)).alias("n"))

    got = in_turn(spark, (lambda k=k: frame(k) for k in range(3)), "part")
    assert sorted(map(tuple, got.select("part", "n").collect())) == [(0, 10), (1, 10), (2, 10)]
    assert seen == [0, 1, 1] and len(tables(spark) - before) == 1


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", ["resolve_person_records", "resolve_routed_records", "resolve_review_queue", "stream_resettled_records"])
def test_parts_find_what_the_whole_finds(spark, monkeypatch, name):
    query, before = catalog.queries()[name], tables(spark)
    whole = Counter(map(tuple, query(spark, FOLDER).collect()))
    left = {f for f in tables(spark) - before if glob.glob(f"{f}/**/*.parquet", recursive=True)}
    assert len(left) <= 1  # the result
    monkeypatch.setattr(resolved, "AT_ONCE", 2500)
    assert Counter(map(tuple, query(spark, FOLDER).collect())) == whole and whole


def test_a_title_s_rows_are_read_in_two_passes(spark):
    row = ("a", 1, 1, "acl", 2024, "main", "T", "accepted", *[False] * 4, None, *[False] * 4, None, None, "own", "b", "t")
    plan = resolution.settle_keys(spark.createDataFrame([row] * 2, f"{resolution.CANDIDATE}, key string"))._jdf.queryExecution().analyzed().toString()
    assert sum(line.lstrip(" :+-").startswith("Window ") for line in plan.splitlines()) == 2
