from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from papertide.functions import classify, text
from papertide.operators import aggregates, estimators, matching
from papertide.operators.components import components


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("value", "want"), [("Nguyễn Văn Đàm", "dam nguyen van"), ("A B", "a b"), ("J. Q. Public Smith", "public smith"), (None, None), ("", "")])
def test_name_key(spark, value, want):
    assert one(spark, text.name_key, value) == want


@pytest.mark.parametrize(("value", "want"), [("ES³: \\textbf A Study", "es3astudy"), ("Café &amp; Co", "cafeco"), (None, None)])
def test_norm_title(spark, value, want):
    assert one(spark, text.norm_title, value) == want


def test_visible_text(spark):
    page = "<p>a &amp;lt; b</p><script>x<y</script><!-- no --><b>c</b>"
    assert one(spark, text.visible_text, page).split() == ["a", "&lt;", "b", "c"]


def test_bib_fields():
    entry = '@inproceedings{k1,\n title = {On {Nested} braces,\n two lines},\n month = jul, url = "http://x/{y}", author={A and B}}'
    assert text.bib_fields(entry) == {"type": "inproceedings", "key": "k1", "title": "On {Nested} braces, two lines", "month": "jul", "url": "http://x/{y}", "author": "A and B"}
    assert text.bib_fields("nothing") == {}


@pytest.mark.parametrize(("value", "want"), [("Desk Rejected Submission", "desk_rejected"), ("Withdrawn; was accepted", "withdrawn"), ("Reject", "rejected"), ("Accept (poster)", "accepted"), ("Submitted to X", "rejected"), (None, "unknown")])
def test_status_order(spark, value, want):
    assert one(spark, classify.status, value) == want


def test_findings_count_twice(spark):
    got = spark.range(1).select(classify.route(F.lit("findings"), F.lit("accepted"), F.lit(2020), F.lit(None), F.lit(True)).alias("b")).first().b
    assert got == ["workshop", "rejected_main"]


def test_podium_shares_places(spark):
    rows = spark.createDataFrame([(5,), (5,), (4,), (0,), (3,), (2,), (None,)], "v int").transform(aggregates.podium, "v").collect()
    assert sorted((r.v if r.v is not None else -1, r.place) for r in rows if r.place) == [(3, 3), (4, 2), (5, 1), (5, 1)]


def test_projection_does_not_count_known_rejections_twice(spark):
    paper = spark.createDataFrame([(i, "full" if i < 5 else "other", 2020, s) for i, s in enumerate(["accepted", "rejected", "rejected", "rejected", "rejected", "accepted", "accepted", "rejected"])], "paper long, venue string, year int, status string").withColumn("full", F.col("venue") == "full")
    member, person = paper.select("paper", F.lit(1).alias("person")), spark.createDataFrame([(1, None)], "person int, since int")
    row = estimators.project(member, paper, person).first()
    # ratio (5 + 1) / (1 + 1) = 3; two accepted elsewhere: 2 * 2 - 1 known there
    assert (row.accepted, row.known, row.estimated) == (3, 5, 3.0)


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 1), (9, 8), (8, 7), (5, 5), (None, 4), (20, 19), (19, 3)] + [(100 + i, 101 + i) for i in range(30)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 19: 1, 20: 1, 9: 7, 8: 7, 7: 7, 5: 5} | dict.fromkeys(range(100, 131), 100)


def test_later_acceptance_ties(spark):
    paper = spark.createDataFrame([(1, "b", 2020, "rejected", 7), (2, "b", 2021, "accepted", 7), (3, "a", 2021, "accepted", 7), (4, "a", 2019, "accepted", 7)], "paper int, venue string, year int, status string, holder int")
    member = paper.select("paper", F.lit(1).alias("person"))
    assert [(r.paper, r.later) for r in matching.later_acceptance(member, paper).collect()] == [(1, 3)]


def test_numbered_numbers_every_row(spark):
    rows = spark.range(2000).select("id", F.when(F.col("id") % 3 != 0, F.col("id") * 7919 % 1000).alias("value")).repartition(5)
    got = {r.id: r.shown for r in aggregates.numbered(rows, F.col("value").desc_nulls_last(), F.col("id").asc()).collect()}
    want = sorted(range(2000), key=lambda i: (i % 3 == 0, -(i * 7919 % 1000) if i % 3 else 0, i))
    assert got == {i: k + 1 for k, i in enumerate(want)}
