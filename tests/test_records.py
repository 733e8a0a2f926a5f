"""Operators without SQL against brute force, and increments that are resumed."""

from __future__ import annotations

import difflib
import os
import random
from datetime import datetime

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from papertide.functions import runtime, text
from papertide.operators import aggregates, matching, people, resolution, spellings
from papertide.plans import catalog as registry
from papertide.streaming import events


def test_similar_titles_are_those_of_brute_force(spark):
    rng, titles = random.Random(1), []
    for k in range(60):
        base = "".join(rng.choice("abcdefgh") for _ in range(rng.randint(20, 60)))
        titles += [base, base[:-2] + "zz", "q" + base[1:], base + "tail" * (k % 4)]
    titles = ["commonbeginningof" + t if k % 3 == 0 else t for k, t in enumerate(titles)]
    frame = spark.createDataFrame([("x", t) for t in titles], "block string, title string")
    want = set()
    distinct = sorted(set(titles))
    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a[:14] == b[:14] or a[-14:] == b[-14:]) and difflib.SequenceMatcher(None, a, b).ratio() >= 0.9:
                want.add((a, b))
    got = [(r.title, r.other) for r in matching.similar_titles(frame).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 60
    few = matching.title_candidates(frame, size=7)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, matching.title_candidates(frame).collect()))


def told_by(rows: list[tuple]) -> list[str]:
    """What the ordered pass says of candidates, a person at a time."""
    whole, want = pd.DataFrame(rows, columns=[f.split()[0] for f in resolution.CANDIDATE.split(", ")]), []
    for _, part in whole.groupby("slug"):
        want += [tuple(None if v != v else v for v in r) for r in resolution.settle(part).itertuples(index=False)]
    return sorted(map(str, want))


def random_candidates(titles: list[str], n: int, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    pick = rng.choice
    return [
        (pick("abc"), pick([1, 1, 2, 3, 4, 4]), seq, pick(["iclr", "acl"]), pick([2023, 2024]), pick(["main", "main", "main", "workshop", "findings", "journal"]), pick(titles), pick(["accepted", "rejected", "unknown"]),
         *(rng.random() < 0.5 for _ in range(4)), pick([None, "Here", "Far"]), *(rng.random() < 0.5 for _ in range(4)), pick([None, None, "yes", "no"]), pick([None, 2024]), pick(["own", "coauthor"]), "src")
        for seq in range(n)
    ]


def test_keys_settled_by_windows_are_those_of_the_ordered_pass(spark, monkeypatch):
    """Titles of which no two are similar: everything is settled by windows, and the ordered pass gives the same rows."""
    titles = ["Graphs", " GRAPHS!", "Trees \\emph{at} night", "Trees at night", "Attention and memory", "&Eacute;tudes of fields", "Études of fields", "Quick brown foxes jump"]
    titles += [a * n for a in ("xz", "jv", "kw", "0y", "17", "3q") for n in (3, 9, 27)]
    rows = [r for r in random_candidates(titles, 900, 7) if r[1] != 3 or r[5] != "workshop"]
    frame = spark.createDataFrame(rows, resolution.CANDIDATE).repartition(3)
    monkeypatch.setattr(resolution, "_settle_sorted", None)  # nothing is left for it
    keyed = frame.withColumn("key", text.norm_title(F.col("title")))
    assert resolution.near_groups(keyed.select("slug", "venue", "year", "title", "key")).count() == 0
    got = sorted(map(str, (tuple(r) for r in resolution.settle_keys(keyed).collect())))
    assert got == told_by(rows) and len(got) > 100
    assert {a for r in got for a in ("record", "warning", "queue", "skipped") if f"'{a}'" in r} == {"record", "warning", "queue", "skipped"}


def test_similar_titles_take_the_ordered_pass(spark):
    titles = [a + b + c for a in ("A study of ", "Study: on ", "UniCon: a ") for b in ("graphs", "graph", "trees", "something else") for c in ("", "!", " and more")]
    rows = random_candidates(titles, 500, 2)
    got = sorted(map(str, (tuple(r) for r in resolution.resolve(spark.createDataFrame(rows, resolution.CANDIDATE).repartition(3)).collect())))
    assert got == told_by(rows) and len(got) > 100
    assert resolution.resolve(spark.createDataFrame([], resolution.CANDIDATE)).count() == 0


def test_mixed_groups(spark):
    """Some groups have similar titles and some do not; those with the same beginning before a colon count as similar."""
    rows = random_candidates(["Alpha", "Beta gamma", "Delta epsilon zeta", "Graph networks at scale", "Graph network at scale", "UniCon: one way", "UniCon: another path"], 120, 5)
    got = sorted(map(str, (tuple(r) for r in resolution.resolve(spark.createDataFrame(rows, resolution.CANDIDATE)).collect())))
    assert got == told_by(rows)


def same_words(a: list[str], b: list[str]) -> bool:
    return len(a) == len(b) and all(x == y or len(x) == 1 and y.startswith(x) or len(y) == 1 and x.startswith(y) for x, y in zip(a, b, strict=True))


def sequential_groups(names: list[str], key) -> dict[str, str]:
    """The ordered pass: a name joins the first group with a spelling that it fits."""
    groups: list[list[str]] = []
    for name in dict.fromkeys(names):
        fit = next((g for g in groups if any(key(n) == key(name) or same_words(n.split(), name.split()) for n in g)), None)
        groups.append([name]) if fit is None else fit.append(name)
    return {n: key(g[0]) for g in groups for n in g}


def test_spellings_join_the_first_group_that_fits(spark):
    key = lambda n: " ".join(sorted(w for w in n.split() if len(w) > 1) if sum(len(w) > 1 for w in n.split()) >= 2 else sorted(n.split()))
    rng, rows, want = random.Random(3), [], {}
    told = ["bui t duc", "bui trong duc", "duc bui trong", "bui van duc", "khoa d doan", "doan khoa", "ada love", "a love"]
    for owner in range(9):
        names = told[:: 1 if owner % 2 else -1] + [" ".join(rng.choice(["an", "a", "bo", "b", "cy", "c"]) for _ in range(rng.choice([2, 3]))) for _ in range(120)]
        # Long names, whose words initials stand for in many ways.
        words = [f"w{i}" for i in range(11)]
        names += [" ".join(w[0] if rng.random() < 0.3 else w for w in words) for _ in range(12)]
        rng.shuffle(names)
        rows += [(f"s{owner}", n, key(n), k) for k, n in enumerate(names)]
        want |= {(f"s{owner}", n): who for n, who in sequential_groups(names, key).items()}
    frame = spark.createDataFrame([*rows, ("t", "ada love", key("ada love"), 1), ("t", None, None, 2), (None, "ada", "ada", 1)], "slug string, name string, key string, seq int")
    got = {(r.slug, r.name): r.who for r in spellings.distinct_people(frame).collect()}
    assert got == want | {("t", "ada love"): key("ada love")}
    assert spellings.distinct_people(frame.where("false")).count() == 0


def test_a_long_way_back_takes_few_rounds(spark, monkeypatch):
    """Each spelling fits the one before it, by key or by an initial, and no other."""
    rows = []
    for k in range(32):
        rows += [(f"{chr(97 + k % 26)}{k} {'y' * (k // 26 + 2)}{k}", f"key{k}"), (f"{chr(97 + k % 26)} {'y' * (k // 26 + 2)}{k}", f"key{k + 1}")]
    calls, real = [], spellings.checkpoint
    monkeypatch.setattr(spellings, "checkpoint", lambda f: calls.append(1) or real(f))
    got = {r.who for r in spellings.distinct_people(spark.createDataFrame([("s", *r, k) for k, r in enumerate(rows)], "slug string, name string, key string, seq int")).collect()}
    assert got == {"key0"} and len(calls) <= 2 + 2 * 8


def test_a_stream_is_resumed(spark, tmp_path):
    at, later, state = datetime(2024, 1, 1), datetime(2024, 1, 2), str(tmp_path / "state")
    (tmp_path / "in").mkdir()

    def landed(name, *rows):
        kinds = {"event_id": pa.int64(), "ts": pa.timestamp("us"), "user_id": pa.int64(), "event_type": pa.string(), "value": pa.float64(), "props": pa.string()}
        pq.write_table(pa.table({k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate(kinds.items())}), tmp_path / "in" / name)

    read = lambda: {(r.user_id, r.n, r.event_id) for r in events.latest_by_key(spark, str(tmp_path / "in"), folder=state).collect()}
    landed("events0.parquet")
    assert read() == set()
    landed("events1.parquet", (1, at, 7, "view", 0.0, "{}"), (2, at, 8, "view", 0.0, "{}"))
    assert read() == {(7, 1, 1), (8, 1, 2)}
    assert read() == {(7, 1, 1), (8, 1, 2)}
    landed("events2.parquet", (3, later, 7, "buy", 0.0, "{}"))
    assert read() == {(7, 2, 3), (8, 1, 2)}
    # A file of older events, one of which is known, comes after newer ones: each counts once, and none is dropped for being late.
    landed("events3.parquet", (2, at, 8, "view", 0.0, "{}"), (4, datetime(2023, 1, 1), 8, "view", 0.0, "{}"), (5, datetime(2023, 1, 1), 7, "view", 0.0, "{}"), (5, datetime(2023, 1, 1), 7, "view", 0.0, "{}"))
    assert read() == {(7, 3, 3), (8, 2, 2)}


def test_cells_sort_as_text_where_one_is_no_number(spark):
    frame = spark.createDataFrame([(1, "10"), (2, "9"), (3, ""), (4, None), (5, "11 +1"), (6, "12")], "id int, cell string")
    shown = lambda f: [r.id for r in aggregates.numbered(*aggregates.cell_order(f, "cell", "id")).orderBy("shown").collect()]
    assert shown(frame) == [5, 6, 1, 2, 3, 4]
    assert shown(frame.union(spark.createDataFrame([(7, "b")], frame.schema))) == [1, 5, 6, 2, 7, 3, 4]


def test_merging_keeps_the_best_rank_and_the_first_of_equals(spark):
    frame = spark.createDataFrame([("a", 3, 2), ("a", 3, 1), ("a", 1, 0), ("b", None, 5)], "k string, rank int, seq int")
    assert sorted(map(tuple, matching.merge_best(frame, ["k"], "rank", "seq").collect())) == [("a", 3, 1, 3), ("b", None, 5, 1)]
    assert matching.merge_best(frame.where("false"), ["k"], "rank", "seq").count() == 0


def test_histograms_put_the_commonest_first(spark):
    frame = spark.createDataFrame([("k", v, s) for s, v in enumerate("bacabd")], "key string, value string, seq int")
    (row,) = people.histogram(frame, "key", "value", "seq", "h").collect()
    assert [(x.value, x.n) for x in row.h] == [("b", 2), ("a", 2), ("c", 1), ("d", 1)]


def test_kept_tables_leave_no_shuffle_files(spark):
    folder = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    count = lambda: folder.getAllFiles().size()
    rows = spark.range(20000).withColumn("k", F.col("id") * 7 % 1009)
    before, found = count(), runtime.kept(rows.repartition(4, "k").groupBy("k").agg(F.collect_list("id").alias("l")))
    assert count() <= before and found.count() == 1009
    path = found.inputFiles()[0].removeprefix("file:").removeprefix("//")
    runtime.forget(found)
    assert not os.path.exists(os.path.dirname(path))
    assert spark.conf.get(runtime.CLEANUP) == "false"


def test_names_are_read_before_profiles_meet(spark):
    plan = registry.queries()["join_profiles_checked"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    join = next(k for k, x in enumerate(lines) if "Join" in x)
    assert not any("ArrowEvalPython" in x for x in lines[:join]) and any("ArrowEvalPython" in x for x in lines[join:])


def test_far_titles_need_no_ratio(monkeypatch):
    rng = random.Random(3)
    titles = ["".join(rng.choice("abcdef0123456789") for _ in range(32)) for _ in range(40)]
    titles += [t[:-1] + "x" for t in titles[:10]] + ["", "a"]
    want = {(a, b): a == b or difflib.SequenceMatcher(None, a, b).ratio() >= 0.9 for a in titles for b in titles}
    calls, whole = [], difflib.SequenceMatcher
    monkeypatch.setattr(resolution.difflib, "SequenceMatcher", lambda *a: calls.append(a) or whole(*a))
    assert {(a, b): resolution.similar(a, b) for a in titles for b in titles} == want
    assert len(calls) < len(want) / 10
