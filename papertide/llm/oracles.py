"""DuckDB SQL for the rows of those operators that SQL can express."""

from __future__ import annotations

ROUNDS, ENTRIES, PARTS = 6, 16, 8

_FAR = "list_sum(list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i] - b.v[i]) * (x.v[i] - b.v[i])))"


def _round(k: int) -> str:
    """The k-th assignment, and for all but the last the entries after it."""
    nearest = f"""near{k} AS MATERIALIZED (
    SELECT n, p, min(far * {ENTRIES} + k) % {ENTRIES} AS k, min(far) AS far
    FROM (SELECT x.n, x.p, b.k, coalesce({_FAR}, 0)::BIGINT AS far FROM part x JOIN book{k} b USING (p)) GROUP BY n, p)"""
    if k == ROUNDS:
        return nearest
    return nearest + f""",
sum{k} AS (SELECT p, k, i, sum(x.v[i])::HUGEINT AS s, count(*)::HUGEINT AS c FROM near{k} JOIN part x USING (n, p), unnest(range(1, len(x.v) + 1)) AS u(i) GROUP BY p, k, i),
moved{k} AS (SELECT p, k, list(((s - ((s % c) + c) % c) // c)::BIGINT ORDER BY i) AS v FROM sum{k} GROUP BY p, k),
book{k + 1} AS MATERIALIZED (SELECT p, k, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN moved{k} m USING (p, k))"""


VECTOR_CODES = f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY vec_id) AS n, vec_id, label, list_transform(embedding, lambda y: floor(4096 * y::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
part AS MATERIALIZED (SELECT n, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS v FROM kept, range({PARTS}) AS u(p)),
book0 AS MATERIALIZED (SELECT p, n - 1 AS k, v FROM part WHERE n <= {ENTRIES}),
{", ".join(_round(k) for k in range(ROUNDS + 1))},
coded AS (SELECT n, string_agg(printf('%02x', k), '' ORDER BY p) AS code, sum(far)::BIGINT AS error FROM near{ROUNDS} GROUP BY n),
told AS (SELECT sha256(string_agg(v[i]::VARCHAR, ',' ORDER BY p, k, i)) AS codebooks_sha256 FROM book{ROUNDS}, unnest(range(1, len(v) + 1)) AS u(i))
SELECT vec_id, label, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (n), told
"""

_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERM = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"

RANKED_SEARCH = f"""
WITH doc AS MATERIALIZED (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all({_LOW}, {_TERM}) AS terms FROM documents WHERE text IS NOT NULL),
size AS MATERIALIZED (SELECT d, doc_id, len(terms) AS n, sum(len(terms)) OVER () AS l, count(*) OVER () AS docs FROM doc WHERE len(terms) > 0),
held AS MATERIALIZED (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(terms) AS term FROM doc) GROUP BY d, term),
known AS MATERIALIZED (SELECT term, count(*) AS df FROM held GROUP BY term),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all({_LOW}, {_TERM})) AS term FROM benchmark) GROUP BY item_id, term),
weight AS (SELECT item_id, term, times, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM asked JOIN known USING (term), (SELECT any_value(docs) AS docs FROM size)),
scored AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // l)))) AS score
           FROM weight JOIN held USING (term) JOIN size USING (d) GROUP BY item_id, d, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score::BIGINT AS score FROM
    (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 10
"""
