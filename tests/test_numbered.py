"""Spellings, affiliations and institutions that meet as numbers: the same figures as from their texts, and few bytes for each pair."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from papertide.functions import places, text
from papertide.operators import figures, spellings

KEY = lambda column: text.name_key(F.col(column), True)


def test_spellings_are_first_seen_on_an_owner_s_papers(spark):
    rng = random.Random(5)
    rows = [(p, rng.choice(["an le", "le an", "a le", None, "bo vu"]), p * 10 + k) for p in range(40) for k in range(rng.randint(1, 4))]
    member = [(p, f"s{rng.randint(0, 5)}") for p in range(38) for _ in range(3)]
    want: dict = {}
    for p, owner in set(member):
        for q, name, seq in rows:
            if p == q and name is not None:
                want[owner, name] = min(seq, want.get((owner, name), seq))
    got = spellings.first_seen(spark.createDataFrame(rows, "paper long, name string, seq long"), spark.createDataFrame(member, "paper long, slug string"), KEY).collect()
    assert {(r.slug, r.name): r.seq for r in got} == want and len(got) == len(want)
    assert {r.name: r.key for r in got} == {"an le": "an le", "le an": "an le", "a le": "a le", "bo vu": "bo vu"}


def test_owners_that_are_done_take_no_part_in_later_rounds(spark, monkeypatch):
    chain = [r for k in range(20) for r in ((f"{chr(97 + k)}{k} y{k}", f"key{k}"), (f"{chr(97 + k)} y{k}", f"key{k + 1}"))]
    rows = [("long", *r, k) for k, r in enumerate(chain)] + [(f"short{i}", *r, k) for i in range(4) for k, r in enumerate(chain[:2])]
    sizes, real = [], spellings.checkpoint
    monkeypatch.setattr(spellings, "checkpoint", lambda f: sizes.append(f.count()) or real(f))
    got = spellings.distinct_people(spark.createDataFrame(rows, "slug string, name string, key string, seq int")).collect()
    assert {r.who for r in got} == {"key0"} and len(got) == len(rows) == sizes[0]
    assert sizes[2] == len(rows) and sizes[-1] == len(chain)


def test_places_and_ranks_are_numbers(spark):
    each = spark.createDataFrame([("s", n, k, i) for i, (n, k) in enumerate([("an le", "an le"), ("a le", "a le"), ("le an", "an le"), ("bo vu", "bo vu")], 1)], "slug string, name string, key string, rank int")
    met = spellings.meeting_places(each, "slug")
    assert {t for c, t in met.dtypes if c != "slug"} == {"int"}
    places_of: dict = {}
    for r in met.collect():
        places_of.setdefault(r.place, set()).add((r["rank"], r.side))
    assert sorted(map(sorted, places_of.values()), key=str) == [[(1, 0), (2, 1)], [(1, None), (3, None)]]


def test_pairs_of_authors_hold_no_text(spark, monkeypatch):
    frames, real = [], figures.kept
    monkeypatch.setattr(figures, "kept", lambda f: frames.append(f) or real(f))
    rows = spark.createDataFrame([(1, 1, "an le", 101, "Hanoi University of Science and Technology"), (1, 2, "bo vu", 102, "MIT"), (1, 3, "b vu", 103, None), (2, 1, "an le", 201, None), (2, 2, "bo vu", 202, None)], "paper long, position int, name string, seq long, aff string")
    roster = places.with_names(spark.createDataFrame([(7, "Hanoi University of Science and Technology", "HUST"), (8, None, None)], "person long, institution string, short string").na.fill(""))
    own = spark.createDataFrame([(7, 1, 1), (7, 2, None), (8, 1, 2)], "person long, paper long, position int")
    paper = spark.createDataFrame([(1, "accepted"), (2, "rejected")], "paper long, status string")
    got = {r.person: r for r in figures.collaboration(own, roster, rows, places.known_institutions(rows), paper, KEY).collect()}
    assert (got[7].papers, got[7].mean_coauthors, got[7].min_coauthors, got[7].with_affiliations, got[7].distinct_coauthors, got[7].elsewhere, got[7].elsewhere_abroad) == (2, 1.5, 2, 1, 1, 1, 1)
    assert (got[7].mean_foreign, got[7].mean_same, got[8].mean_domestic, got[8].mean_foreign, got[8].distinct_coauthors) == (1.0, 0.0, 1.0, 0.0, 2)
    spelled = next(f for f in frames if "n_foreign" in f.columns)
    assert not {"string", "array"} & {t.split("<")[0] for _, t in spelled.dtypes}
