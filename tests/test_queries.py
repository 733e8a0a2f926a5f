"""Every registered query of the library's own operators against DuckDB on the smallest tables."""

from __future__ import annotations

import glob
import os
import subprocess
import sys

import duckdb
import pytest

from papertide.plans import catalog as registry

FOLDER = "/root/testdata/sf0.001"
#: Queries without SQL, and what compares their operators with brute force or fixtures: tests of similar titles, of manuscripts and of keys.
TESTED_ELSEWHERE = {"join_fuzzy_title_blocked", "str_canonicalize", "str_folded_keys"}
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def sorted_rows(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    frame = registry.queries()[name](spark, FOLDER)
    columns = sorted(frame.columns)
    got = sorted_rows(tuple(r[c] for c in columns) for r in frame.collect())
    if name not in registry.oracle_sql():
        assert name in TESTED_ELSEWHERE
        return
    answer = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    assert got == sorted_rows(tuple(dict(zip(names, r, strict=True))[c] for c in columns) for r in answer.fetchall())


def test_flagship_is_registered():
    assert registry.FLAGSHIP in registry.queries()


def test_components_follow_every_edge(spark, tmp_path):
    # Persons 1 to 4 are linked by one paper each, persons 5 and 6 by many, so a cut by weight would lose the first four.
    lines = [(1, 1), (1, 2), (2, 2), (2, 3), (3, 3), (3, 4), *((p, s) for p in range(10, 300) for s in (5, 6)), (4, 7)]
    table = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    columns = ("l_linenumber", "l_partkey", "l_shipdate", "l_quantity", "l_extendedprice")
    table([(p, s, *[1] * 5) for p, s in lines], "l_orderkey long, l_suppkey long, " + ", ".join(f"{c} long" for c in columns), "lineitem")
    for name in ("orders", "supplier", "nation"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r.node: r.component for r in registry.queries()["graph_components_all"](spark, str(tmp_path)).collect()}
    root = {s: s for _, s in lines}
    find = lambda x: x if root[x] == x else find(root[x])
    for p, s in lines:
        for q, t in lines:
            if p == q:
                low, high = sorted((find(s), find(t)))
                root[high] = low
    assert got == {x: find(x) for x in root if x != 7} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5}


@pytest.mark.parametrize("absent", ["papertide.llm", "corpus_pipeline", "public_tokenizers", "tokenizers"])
def test_the_library_loads_without_the_corpus_part(absent):
    code = f"import sys; sys.modules[{absent!r}] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(k.startswith('op') for k in q) and 'pipeline' not in e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), timeout=120).returncode == 0
