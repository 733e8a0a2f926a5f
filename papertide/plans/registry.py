"""The queries of the library's own operators, and DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papertide.functions import classify, manuscript, text
from papertide.functions.runtime import table
from papertide.operators import aggregates, estimators, graph, matching, textscore
from papertide.operators.components import components
from papertide.sources.testdata import FULL_RECORD, Domain, domain
from papertide.streaming import events

FLAGSHIP = "agg_fractional_score"
_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}

DOMAIN = """
paper AS (SELECT o_orderkey AS paper, o_orderpriority AS venue, CAST(year(o_orderdate) AS INTEGER) AS year,
    CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'rejected' ELSE 'withdrawn' END AS status,
    CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 'AI' WHEN substr(o_orderpriority, 1, 1) = '3' THEN 'ML'
         WHEN substr(o_orderpriority, 1, 1) = '4' THEN 'CV' ELSE 'NLP' END AS field,
    o_custkey AS holder, o_totalprice AS worth, o_orderpriority = '1-URGENT' AS full_record FROM orders),
authorship AS (SELECT l_orderkey AS paper, l_suppkey AS person, row_number() OVER (PARTITION BY l_orderkey
    ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) AS position FROM lineitem),
member AS (SELECT DISTINCT l_orderkey AS paper, l_suppkey AS person FROM lineitem),
person AS (SELECT s_suppkey AS person, s_name AS name, n_name AS institution, n_nationkey AS nation, n_regionkey = 2 AS home,
    CASE WHEN s_suppkey % 7 <> 0 THEN 1995 + s_suppkey % 5 END AS since, s_suppkey % 4 <> 0 AS approved
    FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
COUNTS = """count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'rejected') AS rejected,
    count(*) FILTER (status = 'withdrawn') AS withdrawn, count(*) FILTER (status IN ('rejected', 'withdrawn')) AS not_accepted, count(*) AS submitted"""


def query(sql: str | None = None, on_domain: bool = True):
    """Register a query: one that takes the domain and whose SQL may use its tables, or one that takes (spark, sf_dir)."""

    def keep(f):
        if on_domain:
            _queries[f.__name__] = lambda spark, sf_dir: f(domain(spark, sf_dir))
        else:
            _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = f"WITH RECURSIVE {DOMAIN}{sql if sql.lstrip().startswith(',') else ' ' + sql}" if on_domain else sql
        return f

    return keep


def _full(d: Domain) -> DataFrame:
    return d.paper.withColumn("full", F.col("venue") == FULL_RECORD)


# --- counting and rolling up ----------------------------------------------------------------------------------------------------------


@query(f"SELECT person, venue, {COUNTS}, round((count(*) + 1) / (count(*) FILTER (status = 'accepted') + 1), 6) AS ratio FROM member JOIN paper USING (paper) GROUP BY person, venue")
def agg_tally_person_venue(d):
    return aggregates.tally(d.member, d.paper).withColumn("ratio", F.round("ratio", 6))


@query("""SELECT year, venue, CAST(grouping(year) * 2 + grouping(venue) AS INTEGER) AS level, count(*) FILTER (status = 'accepted') AS accepted, count(status) AS submitted
    FROM (SELECT DISTINCT year FROM paper) y CROSS JOIN (SELECT DISTINCT venue FROM paper) v LEFT JOIN (SELECT year, venue, status FROM paper) p USING (year, venue) GROUP BY CUBE (year, venue)""")
def agg_summary_dense_year_venue(d):
    return aggregates.dense_summary(d.paper)


_CREDIT = """, size AS (SELECT paper, count(*) AS authors FROM member GROUP BY paper),
credit AS (SELECT person, name, institution, round(sum(1.0 / authors), 6) AS score, count(*) AS accepted FROM member JOIN paper USING (paper) JOIN size USING (paper) JOIN person USING (person)
    WHERE status = 'accepted' AND (since IS NULL OR year >= since) GROUP BY person, name, institution)"""


@query(_CREDIT + """SELECT person, name, institution, score, accepted, CAST(CASE WHEN r <= 3 AND score > 0 THEN r END AS INTEGER) AS place
    FROM (SELECT *, dense_rank() OVER (ORDER BY score DESC) AS r FROM credit)""")
def agg_fractional_score(d):
    return aggregates.credit(d.member, d.paper, d.person).select("person", "name", "institution", "score", "accepted", "place")


@query(""", size AS (SELECT paper, count(*) AS authors FROM member GROUP BY paper),
    part AS (SELECT institution, field, sum(1.0 / authors) AS x FROM member JOIN paper USING (paper) JOIN size USING (paper) JOIN person USING (person) WHERE status = 'accepted' GROUP BY institution, field)
    SELECT institution, round(exp(sum(ln(x + 1)) / 4), 6) AS score FROM part GROUP BY institution""")
def agg_institution_geomean_score(d):
    return aggregates.geometric_score(d.member, d.paper, d.person)


@query(""", taken AS (SELECT m.paper, m.person, count(*) OVER (PARTITION BY m.paper) - 1 AS n FROM member m JOIN paper USING (paper) WHERE status = 'accepted'),
    pair AS (SELECT DISTINCT a.person, b.person AS other FROM taken a JOIN taken b ON a.paper = b.paper AND a.person <> b.person),
    sets AS (SELECT pair.person, count(*) AS c, count(*) FILTER (NOT q.home) AS abroad, count(*) FILTER (p.institution = q.institution) AS same FROM pair JOIN person p ON p.person = pair.person JOIN person q ON q.person = other GROUP BY pair.person)
    SELECT t.person, round(avg(n), 6) AS mean_coauthors, min(n) AS min_coauthors, max(n) AS max_coauthors, coalesce(any_value(c), 0) AS distinct_coauthors, coalesce(any_value(abroad), 0) AS abroad, coalesce(any_value(same), 0) AS same_institution
    FROM taken t LEFT JOIN sets s ON s.person = t.person GROUP BY t.person""")
def agg_collaboration(d):
    return aggregates.collaboration(d.member, d.paper, d.person)


@query(""", each AS (SELECT paper, count(*) AS n, count(*) FILTER (home) AS h, bool_or(position = 1 AND home) AS f FROM authorship JOIN person USING (person) GROUP BY paper)
    SELECT venue, year, count(*) AS judged, count(*) FILTER (2 * h > n) AS majority, count(*) FILTER (f) AS first_author FROM each JOIN paper USING (paper) WHERE status = 'accepted' GROUP BY venue, year""")
def agg_authorship_majority_first(d):
    return aggregates.authorship_shares(d.authorship, d.paper, d.person)


@query(f", own AS (SELECT DISTINCT institution, paper FROM member JOIN person USING (person)) SELECT institution, {COUNTS}, count(DISTINCT venue) AS venues FROM own JOIN paper USING (paper) GROUP BY institution")
def agg_institution_rollup_distinct(d):
    return aggregates.institution_rollup(d.member, d.paper, d.person)


@query(f"SELECT venue, {COUNTS} FROM paper GROUP BY venue")
def agg_venue_rollup(d):
    return d.paper.groupBy("venue").agg(*aggregates.counts())


@query("""SELECT venue, min(year) AS first_year, max(year) AS last_year, round(100.0 * count(*) FILTER (status = 'accepted') / count(*), 6) AS rate, round((count(*) FILTER (status <> 'withdrawn')) / nullif(count(*) FILTER (status = 'accepted'), 0), 6) AS for_each
    FROM paper GROUP BY venue""")
def agg_reported_rate(d):
    taken = aggregates.count_if(aggregates.accepted())
    return d.paper.groupBy("venue").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.round(100 * taken / F.count(F.lit(1)), 6).alias("rate"), F.round(aggregates.count_if(F.col("status") != "withdrawn") / F.nullif(taken, F.lit(0)), 6).alias("for_each"))


@query("SELECT p_type AS area, p_brand AS topic, CAST(grouping(p_type) * 2 + grouping(p_brand) AS INTEGER) AS level, count(*) AS n FROM part GROUP BY ROLLUP (p_type, p_brand)", on_domain=False)
def agg_topic_rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_type").alias("area"), F.col("p_brand").alias("topic"))
    return rows.rollup("area", "topic").agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("n"))


@query(""", taken AS (SELECT paper, person, home, approved FROM member JOIN paper USING (paper) JOIN person USING (person) WHERE status = 'accepted'),
    pair AS (SELECT a.person, a.paper, b.person AS partner FROM taken a JOIN taken b USING (paper) WHERE NOT a.home AND b.home AND b.approved),
    shared AS (SELECT person, partner, count(*) AS n FROM pair GROUP BY person, partner),
    best AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY n DESC, partner) AS r, count(*) OVER (PARTITION BY person) AS partners FROM shared)
    SELECT person, papers, partners, partner, n AS shared FROM best JOIN (SELECT person, count(DISTINCT paper) AS papers FROM pair GROUP BY person) USING (person) WHERE r = 1 AND papers > 4""")
def agg_foreign_coauthors(d):
    return aggregates.foreign_coauthors(d.member, d.paper, d.person)


@query(""", last AS (SELECT *, count(*) OVER (PARTITION BY paper) AS n FROM authorship),
    each AS (SELECT person, name, paper, year, bool_or(position = n AND n > 1) AS senior FROM last JOIN person USING (person) JOIN paper USING (paper) WHERE NOT approved AND status = 'accepted' GROUP BY person, name, paper, year)
    SELECT person, name, count(*) AS papers, count(*) FILTER (senior) AS senior, min(year) AS first_year, max(year) AS last_year, arg_min(paper, (year, paper)) AS first_paper, count(*) OVER () AS total FROM each GROUP BY person, name ORDER BY papers DESC, senior DESC, name, person LIMIT 250""")
def agg_candidates_evidence(d):
    return aggregates.candidates(d.authorship, d.paper, d.person)


@query(""", own AS (SELECT holder AS person, status, year, full_record FROM paper)
    SELECT person, count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status = 'withdrawn') AS withdrawn, count(*) AS submitted, array_to_string(list_sort(list(DISTINCT CAST(year AS VARCHAR))), ', ') AS years FROM own WHERE full_record GROUP BY person
    HAVING count(*) FILTER (status = 'accepted') = 0 AND person NOT IN (SELECT person FROM own WHERE NOT full_record AND status = 'accepted')""")
def agg_status_pivot_antijoin(d):
    return aggregates.only_negative(d.paper.select("paper", F.col("holder").alias("person")), _full(d))


@query("""SELECT venue, year, count(*) AS papers, count(worth) AS with_worth, round(100.0 * count(*) FILTER (worth >= 100000) / count(*), 6) AS share, 2 * count(*) FILTER (status <> 'withdrawn') < count(*) AS provisional FROM paper GROUP BY venue, year""")
def agg_coverage(d):
    n = F.count(F.lit(1))
    return d.paper.groupBy("venue", "year").agg(
        n.alias("papers"), F.count("worth").alias("with_worth"), F.round(100 * aggregates.count_if(F.col("worth") >= 100000) / n, 6).alias("share"), (2 * aggregates.count_if(F.col("status") != "withdrawn") < n).alias("provisional")
    )


@query("""WITH titled AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, n_chars, source FROM documents)
    SELECT title, doc_id, n_chars, n_merged FROM (SELECT *, count(*) OVER (PARTITION BY title) AS n_merged, row_number() OVER (PARTITION BY title ORDER BY n_chars DESC, doc_id) AS r FROM titled) WHERE r = 1""", on_domain=False)
def dedupe_merge_best(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("title"), "n_chars")
    return matching.merge_best(rows, ["title"], "n_chars", "doc_id").select("title", "doc_id", "n_chars", "n_merged")


# --- estimates ------------------------------------------------------------------------------------------------------------------------

_RATIO = ", ratio AS (SELECT person, (count(*) + 1) / (count(*) FILTER (status = 'accepted') + 1) AS ratio FROM member JOIN paper USING (paper) WHERE full_record GROUP BY person)"
_PROJECT = _RATIO + """, yearly AS (SELECT person, year, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status <> 'accepted') AS known, count(*) FILTER (status <> 'accepted' AND NOT full_record) AS other,
    count(*) FILTER (status = 'accepted' AND NOT full_record) AS elsewhere FROM member JOIN paper USING (paper) JOIN person USING (person) WHERE since IS NULL OR year >= since GROUP BY person, year),
projected AS (SELECT person, year, accepted, known, round(greatest(elsewhere * (coalesce(ratio, 1) - 1) - other, 0), 6) AS estimated, round(accepted + known + greatest(elsewhere * (coalesce(ratio, 1) - 1) - other, 0), 6) AS total FROM yearly LEFT JOIN ratio USING (person))"""


@query(_PROJECT + " SELECT * FROM projected")
def est_projection_person(d):
    return estimators.project(d.member, _full(d), d.person)


@query(_PROJECT + " SELECT year, CAST(sum(accepted) AS BIGINT) AS accepted, CAST(sum(known) AS BIGINT) AS known, CAST(sum(round_even(estimated, 0)) AS BIGINT) AS estimated FROM projected GROUP BY year")
def est_overview(d):
    return estimators.overview(estimators.project(d.member, _full(d), d.person))


@query(""", own AS (SELECT DISTINCT institution, paper FROM member JOIN person USING (person)),
    s AS (SELECT institution, count(*) FILTER (full_record) AS s, count(*) FILTER (full_record AND status = 'accepted') AS a, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status <> 'accepted') AS known,
        count(*) FILTER (status <> 'accepted' AND NOT full_record) AS other, count(*) FILTER (status = 'accepted' AND NOT full_record) AS elsewhere FROM own JOIN paper USING (paper) GROUP BY institution),
    e AS (SELECT *, greatest(elsewhere * ((s + 1) / (a + 1) - 1) - other, 0) AS x FROM s)
    SELECT institution, accepted, known, round(x, 6) AS estimated, round(CASE WHEN accepted + known + x > 0 THEN 100 * accepted / (accepted + known + x) END, 6) AS rate FROM e""")
def est_institution(d):
    return estimators.institution_estimate(d.member, _full(d), d.person)


@query(_RATIO + """, each AS (SELECT paper, avg(ratio) AS m FROM member JOIN ratio USING (person) GROUP BY paper),
    s AS (SELECT venue, coalesce(sum(m - 1) FILTER (status = 'accepted'), 0) AS hidden, count(m) FILTER (status = 'accepted') AS a, count(m) FILTER (status <> 'accepted') AS r, count(*) FILTER (status <> 'accepted') AS rejected FROM paper LEFT JOIN each USING (paper) WHERE NOT full_record GROUP BY venue)
    SELECT venue, rejected, round(greatest(hidden - r, 0), 6) AS extra, round(CASE WHEN a > 0 THEN 100 * a / (a + r + greatest(hidden - r, 0)) END, 6) AS rate FROM s""")
def est_venue(d):
    return estimators.venue_estimate(d.member, _full(d))


@query(""", f AS (SELECT * FROM paper WHERE full_record),
    pool AS (SELECT count(*) FILTER (year BETWEEN 1997 AND 1999 AND status = 'withdrawn') / count(*) FILTER (year BETWEEN 1997 AND 1999) AS f0, count(*) FILTER (year = 1999 AND status = 'accepted') / count(*) FILTER (year = 1999) AS a0 FROM f),
    own AS (SELECT person, count(*) FILTER (year BETWEEN 1997 AND 1999) AS ws, count(*) FILTER (year BETWEEN 1997 AND 1999 AND status = 'withdrawn') AS w, count(*) FILTER (year = 1999) AS s, count(*) FILTER (year = 1999 AND status = 'accepted') AS a FROM member JOIN f USING (paper) GROUP BY person),
    known AS (SELECT paper, avg((w + 2 * f0) / (ws + 2)) AS share, avg((a + 2 * a0) / (s + 2)) AS rate FROM member JOIN own USING (person) CROSS JOIN pool WHERE s > 0 GROUP BY paper)
    SELECT round(coalesce(sum(rate / share) FILTER (status = 'withdrawn' AND share IS NOT NULL), 0), 6) AS accepted, round(coalesce(sum(CASE WHEN status = 'withdrawn' AND share IS NOT NULL THEN (1 - rate) / share ELSE 1 END), 0), 6) AS rejected
    FROM f LEFT JOIN known USING (paper) WHERE year = 2000 AND status <> 'accepted'""")
def est_shrinkage_year(d):
    return estimators.shrunk_year(d.member, _full(d), 2000)


# --- joins ----------------------------------------------------------------------------------------------------------------------------


@query(""", r AS (SELECT person, holder, paper, year, venue, status FROM member JOIN paper USING (paper))
    SELECT b.person, b.paper, arg_min(g.paper, (g.year, g.venue, g.paper)) AS later, min(g.year) AS later_year FROM r b JOIN r g ON b.person = g.person AND b.holder = g.holder AND g.year >= b.year WHERE b.status <> 'accepted' AND g.status = 'accepted' GROUP BY b.person, b.paper""")
def join_later_acceptance(d):
    return matching.later_acceptance(d.member, d.paper)


@query("""SELECT r.paper AS record, coalesce(CASE WHEN i.venue = r.venue AND i.year = r.year THEN i.paper END, k.entry) AS entry FROM paper r LEFT JOIN paper i ON i.paper = r.holder * 3
    LEFT JOIN (SELECT holder, min(paper) AS entry FROM paper WHERE status = 'accepted' GROUP BY holder) k ON k.holder = r.holder""")
def join_lookup_coalesce(d):
    records = d.paper.select(F.col("paper").alias("record"), (F.col("holder") * 3).alias("id"), F.col("holder").alias("key"), "venue", "year")
    by_key = d.paper.where(aggregates.accepted()).groupBy(F.col("holder").alias("key")).agg(F.min("paper").alias("entry"))
    return matching.lookup(records, d.paper.select(F.col("paper").alias("id"), "venue", "year", F.col("paper").alias("entry")), by_key)


@query(""", src AS (SELECT paper, position, CASE WHEN paper % 5 = 0 THEN person + 1 ELSE person END AS name, person AS value FROM authorship),
    good AS (SELECT paper FROM src JOIN authorship USING (paper, position) GROUP BY paper HAVING bool_and(name = person) AND paper % 2 = 0)
    SELECT paper, position, person AS name, CASE WHEN paper % 2 = 1 THEN nation WHEN paper IN (SELECT paper FROM good) THEN person END AS value FROM authorship JOIN person USING (person)""")
def join_affiliation_fill(d):
    own = d.authorship.join(d.person.select("person", "nation"), "person")
    target = own.select("paper", "position", F.col("person").alias("name"), F.when(F.col("paper") % 2 == 1, F.col("nation")).cast("long").alias("value"))
    source = d.authorship.select("paper", "position", F.when(F.col("paper") % 5 == 0, F.col("person") + 1).otherwise(F.col("person")).alias("name"), F.col("person").alias("value"))
    return matching.fill_sequences(target, source)


@query("SELECT paper, venue, year FROM paper WHERE paper IN (SELECT paper FROM member JOIN person USING (person) WHERE approved)")
def join_semi_own_page(d):
    return d.paper.join(d.member.join(d.person.where("approved").select("person"), "person"), "paper", "left_semi").select("paper", "venue", "year")


@query("SELECT c_custkey AS candidate, c_name AS name FROM customer WHERE c_nationkey NOT IN (SELECT nation FROM person WHERE approved AND home) AND c_custkey NOT IN (SELECT person FROM person)")
def join_anti_roster(d):
    spark = d.paper.sparkSession
    nations = d.person.where("approved and home").select(F.col("nation").alias("c_nationkey")).distinct()
    people = table(spark, d.folder, "customer")
    return people.join(nations, "c_nationkey", "left_anti").join(d.person.select(F.col("person").alias("c_custkey")), "c_custkey", "left_anti").select(F.col("c_custkey").alias("candidate"), F.col("c_name").alias("name"))


def _titles(spark: SparkSession, sf_dir: str, ascii_only: bool) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("block"), text.norm_title(F.substring_index("text", "\n", 1), ascii_only).alias("title")).where("title <> ''")


@query(on_domain=False)
def join_fuzzy_title_blocked(spark, sf_dir):
    return matching.similar_titles(_titles(spark, sf_dir, False))


@query("""WITH t AS (SELECT DISTINCT lang AS block, regexp_replace(regexp_replace(lower(regexp_replace(split_part(text, chr(10), 1), '\\\\[A-Za-z]+', ' ', 'g')), '[^a-z0-9]+', '', 'g'), '', '') AS title FROM documents)
    SELECT a.block, a.title, b.title AS other FROM t a JOIN t b ON a.block = b.block AND a.title < b.title AND (left(a.title, 14) = left(b.title, 14) OR right(a.title, 14) = right(b.title, 14)) WHERE a.title <> '' AND 2 * least(length(a.title), length(b.title)) >= 0.9 * (length(a.title) + length(b.title)) - 1e-9""", on_domain=False)
def join_title_candidates(spark, sf_dir):
    return matching.title_candidates(_titles(spark, sf_dir, True))


@query("""WITH d AS (SELECT min(p_partkey) AS entry, p_name, p_brand FROM part GROUP BY p_name, p_brand), p AS (SELECT p_partkey AS person, list_value(split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), 'x') AS tokens, p_brand AS place FROM part)
    SELECT person, min(entry) AS entry FROM p JOIN d ON d.p_brand = p.place AND list_contains(tokens, split_part(d.p_name, ' ', 1)) AND list_contains(tokens, split_part(d.p_name, ' ', 2)) GROUP BY person""", on_domain=False)
def join_subset_overlap(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    people = part.select(F.col("p_partkey").alias("person"), F.concat(F.split("p_name", " "), F.array(F.lit("x"))).alias("tokens"), F.array("p_brand").alias("places"))
    directory = part.groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("entry")).select("entry", F.split("p_name", " ").alias("tokens"), F.array("p_brand").alias("places"))
    return matching.subset_overlap(people, directory)


# --- rules and text -------------------------------------------------------------------------------------------------------------------


@query(""", r AS (SELECT m.paper, m.person, CASE CAST(worth AS BIGINT) % 5 WHEN 0 THEN 'findings' WHEN 1 THEN 'workshop' WHEN 2 THEN 'journal' ELSE 'main' END AS track, CASE WHEN m.paper % 11 = 0 THEN 'unknown' ELSE status END AS status, year, since, home FROM member m JOIN paper USING (paper) JOIN person USING (person)),
    b AS (SELECT paper, person, unnest(CASE WHEN track = 'findings' THEN ['workshop', 'rejected_main'] WHEN track = 'workshop' THEN ['workshop'] WHEN track <> 'main' THEN ['other_track'] WHEN since IS NOT NULL AND year < since THEN ['before_move'] WHEN status = 'unknown' THEN ['unknown'] WHEN NOT home THEN ['elsewhere'] ELSE ['counted'] END) AS bucket FROM r)
    SELECT bucket, count(*) AS n, count(DISTINCT person) AS people FROM b GROUP BY bucket""".replace("CAST(worth AS BIGINT)", "CAST(floor(worth) AS BIGINT)"))
def rules_route_buckets(d):
    rows = d.member.join(d.paper, "paper").join(d.person, "person")
    code = F.floor("worth") % 5
    track = F.when(code == 0, "findings").when(code == 1, "workshop").when(code == 2, "journal").otherwise("main")
    status = F.when(F.col("paper") % 11 == 0, "unknown").otherwise(F.col("status"))
    bucket = classify.route(track, status, F.col("year"), F.col("since"), F.col("home"))
    return rows.select("person", F.explode(bucket).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("person").alias("people"))


def _rules_sql(column: str, rules: list[tuple[str, str]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({column}), '{p}') THEN '{n}'" for n, p in rules) + f" ELSE '{otherwise}' END"


_LABEL = "concat(event_type, ' ', CASE CAST(user_id % 9 AS INTEGER) WHEN 0 THEN 'Desk Rejected' WHEN 1 THEN 'Withdrawn Submission' WHEN 2 THEN 'Reject' WHEN 3 THEN 'Accept (Oral)' WHEN 4 THEN 'ICLR Spotlight' WHEN 5 THEN 'Submitted to a Conference' WHEN 6 THEN 'Datasets and Benchmarks Poster' WHEN 7 THEN 'Findings' ELSE 'Workshop talk' END)"


@query(f"SELECT event_id, {_rules_sql(_LABEL, classify.STATUS, 'unknown')} AS status, {_rules_sql(_LABEL, classify.PRESENTATION, '')} AS presentation, {_rules_sql(_LABEL, classify.TRACK, 'other')} AS track FROM events", on_domain=False)
def cls_status_presentation_track(spark, sf_dir):
    label = F.expr(_LABEL)
    return table(spark, sf_dir, "events").select("event_id", classify.status(label).alias("status"), classify.presentation(label).alias("presentation"), classify.track(label).alias("track"))


_PLACES = [("Ring works", "ring"), ("Red house", "red"), ("Red ring", "red ring"), ("Small house", "small")]


@query("""WITH h AS (SELECT p_partkey AS id, list_filter([CASE WHEN p_name LIKE '%ring%' THEN 'Ring works' END, CASE WHEN p_name LIKE '%red%' THEN 'Red house' END, CASE WHEN p_name LIKE '%red ring%' THEN 'Red ring' END, CASE WHEN p_name LIKE '%small%' THEN 'Small house' END], lambda x: x IS NOT NULL) AS h FROM part)
    SELECT id, array_to_string(CASE WHEN list_contains(h, 'Red ring') THEN list_filter(h, lambda x: x <> 'Ring works') ELSE h END, '; ') AS institutions FROM h""", on_domain=False)
def cls_institutions(spark, sf_dir):
    found = classify.institutions(F.col("p_name"), _PLACES, {"Red ring": "Ring works"})
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(found, "; ").alias("institutions"))


@query("""SELECT c_custkey AS id, array_to_string(list_sort(list_filter(string_split(trim(lower(regexp_replace(c_name || ' von Example', '[^A-Za-z0-9]+', ' ', 'g'))), ' '), lambda x: length(x) > 1)), ' ') AS name_key,
    regexp_replace(regexp_replace(lower(c_name || ': A \\LaTeX Study'), '\\\\[a-z]+', ' ', 'g'), '[^a-z0-9]+', '', 'g') AS title_key, trim(regexp_replace(lower('~' || c_name || '!'), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM customer""", on_domain=False)
def str_name_title_slug_keys(spark, sf_dir):
    name = F.col("c_name")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), text.name_key(F.concat(name, F.lit(" von Example")), True).alias("name_key"), text.norm_title(F.concat(name, F.lit(": A \\LaTeX Study")), True).alias("title_key"), text.slug(F.concat(F.lit("~"), name, F.lit("!")), True).alias("slug"))


@query(on_domain=False)
def str_folded_keys(spark, sf_dir):
    head = F.substring_index("text", "\n", 1)
    return table(spark, sf_dir, "documents").select("doc_id", text.name_key(head).alias("name_key"), text.norm_title(head).alias("title_key"), text.slug(head).alias("slug"))


@query(r"""WITH t AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?i)</?(p|div|li|br|tr|h[1-6]|ul|ol|table|section|article|nav)\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') AS t FROM pages)
    SELECT page_id, md5(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')) AS text_md5 FROM t""", on_domain=False)
def str_html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.visible_text(F.col("html"))).alias("text_md5"))


@query("""SELECT page_id, len(l) AS n_links, len(list_distinct(l)) AS distinct_links, regexp_replace(regexp_replace(lower(regexp_replace(url, '[?#].*$', '')), '^https?://(www\\.)?', ''), '/+$', '') AS url_key FROM (SELECT page_id, url, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages)""", on_domain=False)
def str_links_url_key(spark, sf_dir):
    found = text.links(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.size(found).cast("long").alias("n_links"), F.size(F.array_distinct(found)).cast("long").alias("distinct_links"), text.url_key(F.col("url")).alias("url_key"))


@query("""SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '')) AS words, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[.!?]+'), lambda x: regexp_matches(x, '[^ \\n]'))) AS sentences FROM documents""", on_domain=False)
def str_words_sentences(spark, sf_dir):
    sentence = F.filter(F.split(F.coalesce("text", F.lit("")), "[.!?]+"), lambda x: x.rlike("[^ \n]"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.words(F.col("text"))).cast("long").alias("words"), F.size(sentence).cast("long").alias("sentences"))


# --- graphs ---------------------------------------------------------------------------------------------------------------------------

_EDGES = ", edge AS (SELECT a.person AS a, b.person AS b, count(*) AS weight FROM member a JOIN member b ON a.paper = b.paper AND a.person < b.person GROUP BY a.person, b.person)"
_INST = ", im AS (SELECT DISTINCT nation, paper FROM member JOIN person USING (person)), edge AS (SELECT a.nation AS a, b.nation AS b, count(*) AS weight FROM im a JOIN im b ON a.paper = b.paper AND a.nation < b.nation GROUP BY a.nation, b.nation)"


def _institution_edges(d: Domain) -> tuple[DataFrame, DataFrame]:
    own = d.member.join(d.person.select("person", "nation"), "person").select("nation", "paper").distinct()
    return own, graph.edges(own, "nation")


@query(_EDGES + " SELECT * FROM edge")
def graph_edges(d):
    return graph.edges(d.member)


@query(_INST + """, ends AS (SELECT a AS node, weight FROM edge UNION ALL SELECT b, weight FROM edge) SELECT node, any_value(papers) AS papers, count(weight) AS degree, CAST(coalesce(sum(weight), 0) AS BIGINT) AS linked FROM (SELECT nation AS node, count(*) AS papers FROM im GROUP BY nation) LEFT JOIN ends USING (node) GROUP BY node""")
def graph_nodes_degree(d):
    own, edge = _institution_edges(d)
    return graph.degrees(edge, own, "nation")


_REACH = """, both_ways AS (SELECT a, b FROM edge UNION ALL SELECT b, a FROM edge), low(node, component) USING KEY (node) AS (SELECT a, least(a, min(b)) FROM both_ways GROUP BY a
    UNION SELECT e.a, min(l.component) FROM low l JOIN both_ways e ON e.b = l.node JOIN recurring.low o ON o.node = e.a WHERE l.component < o.component GROUP BY e.a) SELECT node, component FROM low"""


@query(_EDGES + _REACH)
def graph_components(d):
    return components(graph.edges(d.member), "a", "b")


@query(_EDGES + _REACH)
def graph_components_all(d):
    return components(graph.edges(d.member), "a", "b")


@query(_INST + """, home AS (SELECT person, paper FROM member JOIN person USING (person) WHERE home), e AS (SELECT h.person AS l, p.nation AS r, count(*) AS w FROM home h JOIN member m ON m.paper = h.paper JOIN person p ON p.person = m.person WHERE NOT p.home GROUP BY h.person, p.nation)
    SELECT r AS "right", round(sum(l * 1.0 * w) / sum(w), 6) AS centre, CAST(sum(w) AS BIGINT) AS weight FROM e GROUP BY r""".replace(_INST, ""))
def graph_bipartite_barycentre(d):
    people = d.person.select("person", "home", "nation")
    left = d.member.join(people, "person").where("home").select("paper", F.col("person").alias("left"))
    right = d.member.join(people, "person").where("not home").select("paper", F.col("nation").alias("right"))
    return graph.barycentre(left.join(right, "paper").groupBy("left", "right").agg(F.count(F.lit(1)).alias("weight")))


@query(_INST + """, spot AS (SELECT n_nationkey AS node, n_nationkey % 5 * 100.0 AS x, n_nationkey // 5 * 80.0 AS y FROM nation), d AS (SELECT sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) AS d, 190.0 * pow(weight, -0.8 / 3) AS l FROM edge JOIN spot p ON p.node = a JOIN spot q ON q.node = b)
    SELECT round(1 - sum(d * l) * sum(d * l) / sum(d * d) / sum(l * l), 6) AS stress, round(sum(d * l) / sum(d * d), 6) AS scale FROM d""")
def graph_layout_stress(d):
    _, edge = _institution_edges(d)
    spot = d.person.select(F.col("nation").alias("node")).distinct().select("node", (F.col("node") % 5 * 100.0).alias("x"), (F.floor(F.col("node") / 5) * 80.0).alias("y"))
    return graph.stress(edge, spot)


# --- scores, arrays, sorting ----------------------------------------------------------------------------------------------------------


@query("""SELECT vec_id, round(list_avg(list_slice(list_reverse_sort(e), 1, 7)), 6) AS top_mean, round(list_max(e) + ln(list_sum(list_transform(e, lambda x: exp(x - list_max(e))))), 6) AS lse, round(1 / (1 + exp(-list_sum(e))), 6) AS score
    FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)""", on_domain=False)
def text_score_topq(spark, sf_dir):
    values = F.col("embedding").cast("array<double>")
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(textscore.top_mean(values, 0.1), 6).alias("top_mean"), F.round(textscore.log_sum_exp(values), 6).alias("lse"), F.round(textscore.sigmoid(total), 6).alias("score"))


_PROTOTYPES = {"against": ["list_transform(range(64), lambda i: 0.1)", "list_transform(range(64), lambda i: -0.1)"], "toward": ["list_transform(range(64), lambda i: i / 640)", "list_transform(range(64), lambda i: -i / 640)"]}
_NEAR = "-0.5 * list_sum(list_transform(list_zip(e, {p}), lambda z: pow(z[1] - z[2], 2)))"


@query(f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), d AS (SELECT vec_id, {", ".join(f"{_NEAR.format(p=p)} AS {k}{n}" for k, ps in _PROTOTYPES.items() for n, p in enumerate(ps))} FROM v),
    r AS (SELECT vec_id, toward0, toward1, greatest(against0, against1) + ln(exp(against0 - greatest(against0, against1)) + exp(against1 - greatest(against0, against1))) AS ref FROM d),
    s AS (SELECT vec_id, greatest(least(toward0 - ref, 30), -30) AS a, greatest(least(toward1 - ref, 30), -30) AS b FROM r) SELECT vec_id, round(greatest(a, b) + ln(exp(a - greatest(a, b)) + exp(b - greatest(a, b))), 6) AS margin FROM s""", on_domain=False)
def text_margin(spark, sf_dir):
    flat = [F.array(*(F.lit(x) for _ in range(64))) for x in (0.1, -0.1)]
    sloped = [F.array(*(F.lit(sign * i / 640) for i in range(64))) for sign in (1, -1)]
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(textscore.margin(F.col("embedding").cast("array<double>"), flat, sloped, 0.5), 6).alias("margin"))


@query("""WITH s AS (SELECT doc_id, lang, unnest(regexp_split_to_array(text, '[.!?]+')) AS s FROM documents), c AS (SELECT doc_id, lang, len(list_filter(string_split(replace(s, chr(10), ' '), ' '), lambda x: x <> '')) AS n, length(s) AS l FROM s)
    SELECT lang, count(*) AS sentences, count(*) FILTER (l > 7 * n) AS flagged, round(100.0 * count(*) FILTER (l > 7 * n) / count(*), 6) AS share FROM c WHERE n >= 8 GROUP BY lang""", on_domain=False)
def text_flag_share(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("lang", F.explode(F.split("text", "[.!?]+", -1)).alias("s"))
    words = F.size(F.filter(F.split(F.replace("s", F.lit("\n"), F.lit(" ")), " "), lambda x: x != ""))
    long = F.char_length("s") > 7 * F.col("n")
    return rows.withColumn("n", words).where("n >= 8").groupBy("lang").agg(F.count(F.lit(1)).alias("sentences"), aggregates.count_if(long).alias("flagged"), F.round(100 * aggregates.count_if(long) / F.count(F.lit(1)), 6).alias("share"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, coalesce(CAST(json_extract(props, '$.value') AS BIGINT), CAST(json_extract(props, '$.k') AS BIGINT), -1) AS unwrapped FROM events", on_domain=False)
def json_polymorphic(spark, sf_dir):
    v = F.try_parse_json("props")
    k = F.try_variant_get(v, "$.k", "bigint")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), F.coalesce(F.try_variant_get(v, "$.value", "bigint"), k, F.lit(-1).cast("long")).alias("unwrapped"))


@query(", c AS (SELECT person, year, count(*) AS n FROM member JOIN paper USING (paper) GROUP BY person, year) SELECT p.person, CAST(y AS INTEGER) AS year, coalesce(n, 0) AS n FROM (SELECT DISTINCT person FROM member) p CROSS JOIN range(1995, 2002) t(y) LEFT JOIN c ON c.person = p.person AND c.year = y")
def arr_dense_year_map(d):
    yearly = d.member.join(d.paper, "paper").groupBy("person", "year").agg(F.count(F.lit(1)).alias("n"))
    known = yearly.groupBy("person").agg(F.map_from_entries(F.collect_list(F.struct("year", "n"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(1995), F.lit(2001)), lambda y: F.struct(y.alias("year"), F.coalesce(F.col("m")[y], F.lit(0)).cast("long").alias("n")))
    return known.select("person", F.inline(dense))


@query("""WITH c AS (SELECT c_custkey AS id, c_name, CASE WHEN c_acctbal < 1000 THEN '' WHEN c_custkey % 3 = 0 THEN CAST(floor(c_acctbal) AS BIGINT) || ' +' || c_custkey % 7 ELSE CAST(floor(c_acctbal) AS BIGINT) || '%' END AS cell FROM customer),
    k AS (SELECT id, c_name, cell, CASE WHEN cell = '' THEN NULL WHEN contains(cell, '+') THEN CAST(split_part(cell, ' +', 1) AS DOUBLE) + CAST(split_part(cell, ' +', 2) AS DOUBLE) + CAST(split_part(cell, ' +', 1) AS DOUBLE) / 1000 ELSE CAST(rtrim(cell, '%') AS DOUBLE) END AS n FROM c)
    SELECT id, row_number() OVER (ORDER BY n DESC NULLS LAST, c_name, id) AS shown FROM k""", on_domain=False)
def sort_table_semantics(spark, sf_dir):
    whole = F.floor("c_acctbal").cast("bigint").cast("string")
    cell = F.when(F.col("c_acctbal") < 1000, "").when(F.col("c_custkey") % 3 == 0, F.concat(whole, F.lit(" +"), (F.col("c_custkey") % 7).cast("string"))).otherwise(F.concat(whole, F.lit("%")))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_name", cell.alias("cell"))
    return aggregates.numbered(*aggregates.cell_order(rows, "cell", "c_name", "id")).select("id", "shown")


@query("""SELECT c_custkey AS id, row_number() OVER (ORDER BY CASE WHEN c_acctbal < 1000 THEN NULL ELSE c_acctbal END DESC NULLS LAST, c_name, c_custkey) AS shown FROM customer""", on_domain=False)
def sort_table_all_rows(spark, sf_dir):
    value = F.when(F.col("c_acctbal") >= 1000, F.col("c_acctbal"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_name", value.alias("value"))
    return aggregates.numbered(rows, F.col("value").desc_nulls_last(), F.col("c_name").asc(), F.col("id").asc()).select("id", "shown")


@query("""SELECT p_partkey AS id, p_size, CAST(CASE WHEN r <= 3 THEN r END AS INTEGER) AS place FROM (SELECT *, dense_rank() OVER (ORDER BY p_size DESC) AS r FROM part)""", on_domain=False)
def podium_ties(spark, sf_dir):
    return aggregates.podium(table(spark, sf_dir, "part"), "p_size").select(F.col("p_partkey").alias("id"), "p_size", "place")


@query("""WITH RECURSIVE r AS MATERIALIZED (SELECT c_custkey AS id, CAST(round(c_acctbal * 100) AS BIGINT) AS y, row_number() OVER (ORDER BY round(c_acctbal * 100) DESC, c_custkey) AS k FROM customer),
    p AS (SELECT id, y, k, y AS pushed FROM r WHERE k = 1 UNION ALL SELECT r.id, r.y, r.k, least(r.y, p.pushed - 1500) FROM p JOIN r ON r.k = p.k + 1) SELECT id, y, pushed FROM p""", on_domain=False)
def win_pushed_apart(spark, sf_dir):
    """Labels at their values, in cents, each pushed to at least 15 under the one before."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.round(F.col("c_acctbal") * 100).cast("long").alias("y"))
    return aggregates.pushed_apart(rows, "y", 1500, F.col("y").desc(), F.col("id").asc())


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT day, event_type, CAST(sum(n) OVER w - n AS BIGINT) AS low, CAST(sum(n) OVER w AS BIGINT) AS high FROM d WINDOW w AS (PARTITION BY day ORDER BY event_type ROWS UNBOUNDED PRECEDING)""", on_domain=False)
def win_stack_offsets(spark, sf_dir):
    return events.running(table(spark, sf_dir, "events"))


@query("""SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS shown, first_value(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS first_role FROM conversations""", on_domain=False)
def win_row_numbers(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.row_number().over(w).cast("long").alias("shown"), F.first("role").over(w).alias("first_role"))


# --- increments and streams -----------------------------------------------------------------------------------------------------------


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type <> 'error' UNION ALL SELECT event_id, user_id, event_type FROM events WHERE event_type = 'error' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type <> 'error')", on_domain=False)
def inc_append_new_only(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return events.append_new(rows.where("event_type <> 'error'"), rows.where("event_type = 'error'"), ["user_id"])


@query("SELECT d.doc_id, d.lang FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0)", on_domain=False)
def inc_resume(spark, sf_dir):
    done = table(spark, sf_dir, "labels").where("toxic = 0").select("doc_id")
    return table(spark, sf_dir, "documents").join(done, "doc_id", "left_anti").select("doc_id", "lang")


@query("SELECT l.doc_id, l.quality FROM labels l WHERE l.doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')", on_domain=False)
def inc_purge(spark, sf_dir):
    kept = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id")
    return table(spark, sf_dir, "labels").join(kept, "doc_id", "left_semi").select("doc_id", "quality")


@query("SELECT user_id, count(*) AS n, arg_max(event_id, (ts, event_id, event_type)) AS event_id, arg_max(event_type, (ts, event_id, event_type)) AS event_type FROM events GROUP BY user_id", on_domain=False)
def stream_dedupe_latest(spark, sf_dir):
    return events.latest_by_key(spark, sf_dir)


@query(on_domain=False)
def str_canonicalize(spark, sf_dir):
    plain = manuscript.canonical(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", plain.alias("plain")).select("doc_id", F.md5(F.col("plain").cast("binary")).alias("plain_md5"), F.size(manuscript.sentences(F.col("plain"))).alias("sentences"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
