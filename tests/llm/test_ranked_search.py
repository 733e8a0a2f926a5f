"""Ranked search against a plain scan, on odd rows and on the query's own SQL."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from papertide.llm import ranked_search, registry

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id int, text string, term string, shard string, score string, item string"


def cut(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(documents, items, k):
    bags = [(i, Counter(cut(t))) for i, t in documents]
    bags = [(i, b, b.total()) for i, b in bags if b]
    n, total, df = len(bags), sum(s for *_, s in bags), Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in sorted(set(items), key=str):
        asked, scores = Counter(cut(text)), []
        for doc, bag, size in bags:
            m = 25 + 75 * size * n // total
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * bag[t] // (1000 * bag[t] + 8 * m)) for t, times in asked.items() if bag[t])
            if score > 0:
                scores.append((-score, doc is None, doc, score))
        out += [(item, r, doc, score) for r, (*_, doc, score) in enumerate(sorted(scores, key=lambda s: (s[0], s[1], s[2] or 0))[:k], 1)]
    return Counter(out)


def corpus(n=160):
    rng = random.Random(8)
    words = ["the", "of", "Étude", "ÉTUDE", "naïve", "don't", "x1", "中文", "😀", "Straße", "a_b", "The", *(f"w{i}" for i in range(60))]
    say = lambda m: rng.choice(" .,\n-").join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=m))
    rows = [(i, say(rng.randint(1, 60))) for i in rng.sample(range(1000), n)]
    rows += [(2001, None), (2002, ""), (2003, " \t..!"), (2004, "the " * 900 + "w59"), (2005, "z" * 5000), (rows[3][0], rows[3][1]), (rows[4][0], "w3 w4"), (None, rows[5][1]), (None, "w7 w8 the")]
    items = [(1, rows[5][1]), (2, say(30)), (3, "the the THE of w9"), (4, None), (5, "!!"), (6, "nowhere"), (None, "w7 w8"), (2, "w1 w50"), (3, "the the THE of w9"), (7, "É étude Étude 中文"), (8, "z" * 5000)]
    return rows, items


@pytest.mark.parametrize(("shard", "asked", "chunk", "block", "seeds"), [(1 << 15, 1 << 20, 1 << 20, 1024, 128), (7, 1 << 20, 64, 2, 0), (1 << 15, 2, 100, 3, 12)])
def test_ranks_equal_a_plain_scan(spark, monkeypatch, shard, asked, chunk, block, seeds):
    for name, value in (("SHARD", shard), ("ASKED", asked), ("CHUNK", chunk), ("BLOCK", block), ("SEEDS", seeds)):
        monkeypatch.setattr(ranked_search, name, value)
    rows, items = corpus()
    documents = spark.createDataFrame([(*r, "?", "?", "?", "?") for r in rows], SCHEMA).repartition(3)
    asks = spark.createDataFrame([(*r, "?") for r in items], "item_id int, text string, rank string")
    for k in (3, 10):
        got = Counter(tuple(r) for r in ranked_search.search(documents, asks, k=k).collect())
        assert got == brute(rows, items, k)
    assert ranked_search.search(documents.where("false"), asks).count() == 0
    assert ranked_search.search(documents, asks.where("false")).count() == 0


def test_packed_numbers():
    numbers = np.array([0, 1, 127, 128, 16383, 16384, 2**31, 2**40 + 5, 2**62])
    assert ranked_search.unpacked(ranked_search.packed(numbers)).tolist() == numbers.tolist()
    assert len(ranked_search.packed(np.arange(128))) == 128 and not len(ranked_search.unpacked(b""))


def test_best_of_lists_equals_all_sums():
    rng = random.Random(2)
    for _ in range(300):
        lists = []
        for _ in range(rng.randint(1, 9)):
            docs = sorted(rng.sample(range(400), rng.randint(1, 200)))
            gives = [rng.randint(0, rng.choice([3, 30, 300])) for _ in docs]
            lists.append((max(gives), docs, gives))
        sums = Counter()
        for _, docs, gives in lists:
            for d, g in zip(docs, gives, strict=True):
                sums[d] += g
        want = sorted(((s, d) for d, s in sums.items() if s > 0), key=lambda x: (-x[0], x[1]))[:10]
        assert ranked_search.best(lists, 10) == want


def test_common_terms_are_not_walked(monkeypatch):
    """A document that holds all terms lifts the bound, after which long lists of small scores are asked and not walked."""
    asked = Counter()
    real = ranked_search.bisect_left
    monkeypatch.setattr(ranked_search, "bisect_left", lambda docs, *a: asked.update([len(docs)]) or real(docs, *a))
    common, rare = list(range(100_000)), list(range(0, 100_000, 1000))
    assert [s for s, _ in ranked_search.best([(5, common, [5] * 100_000), (900, rare, [900] * 100)], 10)] == [905] * 10
    assert asked[100_000] < 1000


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    want = con.execute(f"SELECT item_id, rank, doc_id, score FROM ({registry.oracle_sql()['op13_ranked_search']})").fetchall()
    assert Counter(tuple(r) for r in registry.op13_ranked_search(spark, folder).collect()) == Counter(want)
