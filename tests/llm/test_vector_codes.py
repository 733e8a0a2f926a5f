"""Vector codes against a plain loop over whole numbers, on odd rows and on the query's own SQL."""

from __future__ import annotations

import hashlib
import math

import duckdb
import numpy as np
import pytest

from papertide.llm import registry, vector_codes

SCHEMA = "vec_id int, embedding array<double>, label string, code string, error string, n string"


def rows(dim: int = 11, n: int = 90, scale: float = 1.0) -> list[tuple]:
    rng = np.random.default_rng(3)
    found = [(int(i), (rng.normal(size=dim) * scale).round(4).tolist(), None if i % 5 == 0 else "ab"[i % 2]) for i in rng.permutation(n)]
    found += [(200, None, "a"), (201, [1.0] * (dim - 1) + [None], "a"), (202, [math.nan] * dim, "b"), (203, [math.inf] + [0.0] * (dim - 1), None)]
    found += [found[4], found[4], (None, found[7][1], "b"), (204, [0.0] * dim, "c"), (205, [0.5, -0.5], "c"), (206, [], "c")]
    return [(*r, "?", "?", "?") for r in found]


def brute(rows: list[tuple], parts: int, entries: int, rounds: int) -> tuple[list[tuple], str]:
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = -(-max((len(r[1]) for r in kept), default=0) // parts)
    cut = []
    for r in kept:
        x = [math.floor(4096 * y) if abs(y) < 1e300 else int(y) * 4096 for y in r[1]] + [0] * (width * parts - len(r[1]))
        cut.append([x[p * width : (p + 1) * width] for p in range(parts)])
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books = [[cut[k][p] for k in order] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda x, book: min(range(len(book)), key=lambda k: (far(x, book[k]), k))
    for _ in range(rounds):
        for p in range(parts):
            at = [near(x[p], books[p]) for x in cut]
            for k in range(len(books[p])):
                own = [x[p] for x, a in zip(cut, at, strict=True) if a == k]
                if own:
                    books[p][k] = [sum(column) // len(own) for column in zip(*own, strict=True)]
    out, of = [], {}
    for r, x in zip(kept, cut, strict=True):
        at = [near(x[p], books[p]) for p in range(parts)]
        error = min(sum(far(x[p], books[p][a]) for p, a in enumerate(at)), 2**63 - 1)
        of[r[2]] = min(of.get(r[2], 0) + error, 2**63 - 1)
        out.append((r[0], r[2], "".join(f"{a:02x}" for a in at), error))
    told = ",".join(str(y) for book in books for entry in book for y in entry)
    return sorted((*o, of[o[1]]) for o in out if o[0] is not None) + sorted((*o, of[o[1]]) for o in out if o[0] is None), hashlib.sha256(told.encode()).hexdigest()


@pytest.mark.parametrize(("dim", "scale", "parts", "entries"), [(11, 1.0, 4, 5), (16, 1.0, 8, 16), (8, 1e7, 2, 4), (6, 1e301, 3, 3)])
def test_codes_equal_a_plain_loop(spark, dim, scale, parts, entries):
    table = rows(dim, 60, scale)
    got = vector_codes.compress(spark.createDataFrame(table, SCHEMA).repartition(4), parts=parts, entries=entries, rounds=4).collect()
    want, told = brute(table, parts, entries, 4)
    assert {r.codebooks_sha256 for r in got} == {told}
    found = [(r.vec_id, r.label, r.code, r.error, r.label_error) for r in got]
    assert sorted(r for r in found if r[0] is not None) + sorted(r for r in found if r[0] is None) == want


def test_few_rows_no_rows_and_only_bad_rows(spark):
    frame = spark.createDataFrame(rows(16), SCHEMA)
    got = vector_codes.compress(frame.where("vec_id in (1, 2)")).collect()
    assert len(got) == 2 and all(r.error == 0 for r in got) and {r.code for r in got} == {"00" * 8, "01" * 8}
    assert vector_codes.compress(frame.where("false")).count() == 0
    assert vector_codes.compress(frame.where("vec_id in (200, 201, 202, 203)")).count() == 0
    assert [r.code for r in vector_codes.compress(frame.where("vec_id = 206")).collect()] == ["00" * 8]


def test_codes_do_not_depend_on_partitions_or_blocks(spark, monkeypatch):
    frame = spark.createDataFrame(rows(), SCHEMA)
    want = sorted(vector_codes.compress(frame.repartition(1)).select("code", "error").collect())
    monkeypatch.setattr(vector_codes, "BLOCK", 7)
    assert sorted(vector_codes.compress(frame.repartition(9)).select("code", "error").collect()) == want


def test_decoded_vectors_are_near(spark):
    frame = spark.createDataFrame(rows(16), SCHEMA).where("size(embedding) = 16")
    books = vector_codes.learn(frame)
    kept = vector_codes.decode(vector_codes.encode(frame, books), books).dropna(subset=["vec_id"]).collect()
    first = {r[0]: r[1] for r in rows(16)}
    for r in kept:
        far = sum((math.floor(4096 * a) - 4096 * b) ** 2 for a, b in zip(first[r.vec_id], r.decoded, strict=True))
        assert round(far) == r.error


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    columns = ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()['op11_vector_codes']}) ORDER BY vec_id").fetchall()
    got = registry.op11_vector_codes(spark, folder).orderBy("vec_id").select(*columns).collect()
    assert [tuple(r) for r in got] == want
