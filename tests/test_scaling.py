"""Steps that must not do their work again for each row that they meet."""

from __future__ import annotations

import difflib
import random

import pandas as pd
from pyspark.sql import functions as F

from papertide.functions import places, text
from papertide.operators import figures, graph, matching
from papertide.sources import pages
from papertide.sources.testdata import domain
from papertide.plans.printed import printed

FOLDER = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_rules_of_places_are_applied_to_affiliations_and_not_to_authors(spark):
    told = printed(domain(spark, FOLDER)).where(F.size("places") > 0)
    assert "RLIKE" not in plan(told) and "pythonUDF" not in plan(told)


def test_authors_do_not_meet_all_institutions_of_their_paper(spark):
    rows = spark.createDataFrame([(1, k + 1, a) for k, a in enumerate(["HUST SoICT", "MIT", None, "VinUni", "SoICT"])] + [(2, 1, None)], "paper long, position int, aff string")
    owned = places.with_names(spark.createDataFrame([(p, *i) for p in (1, 2) for i in (("Hanoi University of Science and Technology", "HUST"), ("VinUniversity", "VinUni"), ("FPT University", "FPT"))], "paper long, institution string, short string"))
    got = {(r.paper, r.short): (r.known, r.majority, r.first_author) for r in figures.judged(places.with_institutions(rows), owned).collect()}
    assert got == {(1, "HUST"): (True, False, True), (1, "VinUni"): (True, False, False), (1, "FPT"): (True, False, False), **{(2, s): (False, False, False) for s in ("HUST", "VinUni", "FPT")}}
    again = figures.judged(places.with_institutions(rows.where("position <> 3")), owned).where("paper = 1 and short = 'HUST'").first()
    assert not again.majority  # two of four are no majority


def test_pairs_of_a_paper_are_dealt_to_all_partitions(spark):
    member = spark.range(40).select((F.col("id") % 8).alias("paper"), F.col("id").alias("person"))
    dealt = [x for x in plan(graph.edges(member)).splitlines() if "RepartitionByExpression" in x]
    assert len(dealt) == 3
    assert graph.edges(member).count() == 8 * 10


def test_alike_people_meet_the_directory_once(spark):
    people = spark.createDataFrame([(k, ["a", "b"], ["x"]) for k in range(50)], "person long, tokens array<string>, places array<string>")
    found = matching.subset_overlap(people, spark.createDataFrame([(7, ["a", "b"], ["x"]), (9, ["a"], ["x"])], "entry long, tokens array<string>, places array<string>"))
    assert sorted(map(tuple, found.collect())) == [(k, 7) for k in range(50)]
    assert plan(found).index("Aggregate [person") < plan(found).index("Aggregate [tokens")


def test_letters_bound_the_ratio():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    a, b = pd.Series(words[:150]), pd.Series(words[150:])
    most = matching.most_ratio(a, b)
    assert all(m >= difflib.SequenceMatcher(None, x, y).ratio() - 1e-9 for m, x, y in zip(most, a, b, strict=True))
    assert matching.most_ratio(pd.Series(["abab"]), pd.Series(["cdcd"]))[0] == 0


def test_steps_of_a_page_are_found_once(spark):
    page = spark.createDataFrame([("A Title Ada Love 1,2 Bo Ta 2 1 School of X, 2 Big Lab",)], "page string")
    steps = plan(page.select(pages.numbered_affiliations(F.col("page"), F.array(F.lit("Ada Love"), F.lit("Bo Ta")))))
    assert steps.count("regexp_replace(") <= 4
    bars = plan(page.select(pages.scholar_profile(F.col("page"))))
    assert bars.count("z-index") <= 4


def test_values_of_entries_end_where_they_did():
    assert text.bib_fields('@inproceedings{k, a = {x {y, "z"} w}, b = "q {r} s, t", c = 5, d = {cut') == {"type": "inproceedings", "key": "k", "a": 'x {y, "z"} w', "b": "q {r} s, t", "c": "5", "d": "{cut"}
