"""Queries on authors as papers print them: places, own institutions, figures of people and institutions, and the orders of tables; with DuckDB SQL for the same rows.

The order tables have no affiliations, so each authorship prints one of AFFILIATIONS, or none, by its numbers; and each person has one of HOMES as institution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertide.functions import labels, places, text
from papertide.functions.runtime import kept, spread, table
from papertide.operators import aggregates, estimators, figures, people, tokenscores
from papertide.plans.registry import _PROJECT, _full, query
from papertide.sources.testdata import Domain

AFFILIATIONS = [
    "Hanoi University of Science and Technology", "SoICT, HUST, Hanoi", "VNU University of Science, Hanoi", "University of Science, VNU-HCM", "VinAI Research", "VinUniversity, Hanoi", "MIT", "Google",
    "Cornell University; VinUniversity", "University of Information Technology, VNU-HCM", "VNU", "Vietnam National University, Ho Chi Minh City", "Some Institute, Da Nang, Viet Nam", "Beijing University of Posts",
    "NVIDIA, Ho Chi Minh City", "Can Tho University of Medicine", "Can Tho University", "Hanoi University of Science", "Ho Chi Minh City University of Technology and Education",
    "Ho Chi Minh City University of Technology", "FPT Software", "FPT University", "VinAI & HUST", "University of Science", "Viettel AI", "Vinci4D", "Đại học Bách khoa Hà Nội", "UiT The Arctic University of Norway",
    "VNU University of Engineering and Technology", "Carnegie Mellon University",
]
HOMES = [(full, short) for _, full, short, _ in places.RULES if short in ("HUST", "VNU-HUS", "HCMUS", "VinUni", "UIT", "VNU-UET", "FPT University", "Viettel")]
#: What DuckDB's patterns cannot say: the strings in which a rule's lookahead forbids a match, which the SQL takes out beforehand.
_FORBIDDEN = {"(?! (and |& )?tech)": r"ha ?noi university of science\b (and |& )?tech", "(?! and education)": "ho chi minh (city )?university of technology and education", "(?! of)": "can tho university of"}


def literal(x: object) -> str:
    return str(x).lower() if isinstance(x, bool) else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)


def _rule_rows() -> list[tuple]:
    out = []
    for k, (pattern, full, short, university) in enumerate(places.RULES):
        ahead = next((a for a in _FORBIDDEN if a in pattern), "")
        out.append((k, pattern.replace(ahead, "") if ahead else pattern, _FORBIDDEN.get(ahead, ""), full, short, university))
    return out


_NORM = "trim(lower(regexp_replace(strip_accents(replace(replace({0}, 'đ', 'd'), 'Đ', 'D')), '[^A-Za-z0-9]+', ' ', 'g')))"
PRINTED = f""", printed AS (SELECT paper, position, person, name, CASE WHEN (paper * 3 + position) % 5 <> 0 AND paper % 7 <> 0 THEN [{", ".join(map(literal, AFFILIATIONS))}][CAST(1 + (person * 7 + paper % 3) % {len(AFFILIATIONS)} AS INTEGER)] END AS aff
    FROM authorship JOIN person USING (person)),
roster AS (SELECT person, name, since, approved, [{", ".join(literal(f) for f, _ in HOMES)}][CAST(1 + person % {len(HOMES)} AS INTEGER)] AS institution, [{", ".join(literal(s) for _, s in HOMES)}][CAST(1 + person % {len(HOMES)} AS INTEGER)] AS short FROM person),
rule(ord, pattern, gone, full_name, short, uni) AS (VALUES {values(_rule_rows())}), parent(short, above) AS (VALUES {values(list(places.PARENT.items()))}),
plain AS (SELECT aff, trim(strip_accents(replace(replace(aff, 'đ', 'd'), 'Đ', 'D'))) AS a FROM (SELECT DISTINCT aff FROM printed WHERE aff IS NOT NULL)),
hit AS (SELECT aff, ord, full_name, short, uni FROM plain JOIN rule ON regexp_matches(CASE WHEN gone = '' THEN a ELSE regexp_replace(a, gone, '', 'gi') END, pattern, 'i')),
south AS (SELECT DISTINCT aff FROM hit WHERE short IN ('HCMUS', 'HCMUT', 'UIT', 'HCMIU', 'VNU-HCM')),
named AS (SELECT * FROM hit WHERE short <> 'VNU' OR aff NOT IN (SELECT aff FROM south) UNION ALL SELECT aff, 99, a, a, true FROM plain WHERE aff NOT IN (SELECT aff FROM hit) AND regexp_matches(a, {literal(places.GENERIC)}, 'i')),
home AS (SELECT DISTINCT institution, short FROM roster),
same AS (SELECT aff, home.short FROM plain JOIN home ON contains({_NORM.format("aff")}, {_NORM.format("institution")}) UNION
    SELECT aff, home.short FROM named JOIN home ON named.short = home.short OR named.full_name = home.institution OR named.short = (SELECT above FROM parent WHERE parent.short = home.short))"""


def _one_of(choices: list[str], k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, choices)), (F.lit(1) + k).cast("int"))


def _told(d: Domain) -> DataFrame:
    """paper, position, person, name and aff of each authorship."""
    said = F.when(((F.col("paper") * 3 + F.col("position")) % 5 != 0) & (F.col("paper") % 7 != 0), _one_of(AFFILIATIONS, (F.col("person") * 7 + F.col("paper") % 3) % len(AFFILIATIONS)))
    return d.authorship.join(d.person.select("person", "name"), "person").select("paper", "position", "person", "name", said.alias("aff"))


def printed(d: Domain) -> DataFrame:
    """paper, position, person, name, aff and places of each authorship."""
    return places.with_institutions(_told(d))


def roster(d: Domain) -> DataFrame:
    at = F.col("person") % len(HOMES)
    return places.with_names(d.person.select("person", "name", "since", "approved", _one_of([f for f, _ in HOMES], at).alias("institution"), _one_of([s for _, s in HOMES], at).alias("short")))


def key(column: str) -> Column:
    return text.name_key(F.col(column), True)


# --- places ---------------------------------------------------------------------------------------------------------------------------


@query(PRINTED + " SELECT paper, position, coalesce(string_agg(n.short, '; ' ORDER BY ord), '') AS institutions, arg_min(n.full_name, ord) AS first, coalesce(bool_or(uni), false) AS university FROM printed LEFT JOIN named n ON n.aff = printed.aff GROUP BY paper, position")
def cls_places(d):
    first = F.try_element_at("places", F.lit(1))
    return printed(d).select("paper", "position", F.array_join(F.transform("places", lambda x: x["short"]), "; ").alias("institutions"), first["full"].alias("first"), F.exists("places", lambda x: x["university"]).alias("university"))


@query(PRINTED + r""" SELECT paper, position, same.aff IS NOT NULL AS same, coalesce(printed.aff, '') = '' OR same.aff IS NOT NULL OR (length(roster.short) >= 3 AND regexp_matches(printed.aff, '(^|[^\w-])' || regexp_escape(roster.short) || '($|[^\w-])'))
    OR (roster.short IN ('HCMUS', 'VNU-HUS') AND regexp_matches(printed.aff, '\buniversity of science\b', 'i')) AS own FROM printed JOIN roster USING (person) LEFT JOIN same ON same.aff = printed.aff AND same.short = roster.short""")
def cls_own_institution(d):
    both = printed(d).join(roster(d).select("person", "institution", "named", "short"), "person")
    found, aff, *rest = map(F.col, ("places", "aff", "said", "institution", "named", "short"))
    return both.select("paper", "position", F.coalesce(places.same_institution(found, *rest), F.lit(False)).alias("same"), places.at_institution(found, aff, *rest).alias("own"))


# --- figures --------------------------------------------------------------------------------------------------------------------------

_VENUES = ["iclr", "icml", "iccv", "eccv", "acl"]
_RECORD = """, venued AS (SELECT paper, ['iclr', 'icml', 'iccv', 'eccv', 'acl'][CAST(substr(venue, 1, 1) AS INTEGER)] AS venue, year, CASE WHEN status = 'rejected' AND paper % 13 = 0 THEN 'desk_rejected' ELSE status END AS status, paper % 5 = 0 AS unofficial, holder, worth FROM paper)"""


def venued(d: Domain) -> DataFrame:
    status = F.when((F.col("status") == "rejected") & (F.col("paper") % 13 == 0), "desk_rejected").otherwise(F.col("status"))
    return d.paper.select("paper", _one_of(_VENUES, F.substring("venue", 1, 1).cast("int") - 1).alias("venue"), "year", status.alias("status"), (F.col("paper") % 5 == 0).alias("unofficial"), "holder", "worth")


@query(_RECORD + """SELECT p.person, v.venue, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status = 'withdrawn') AS withdrawn, count(*) FILTER (status = 'desk_rejected') AS desk_rejected,
    count(*) FILTER (status <> 'accepted') AS not_accepted, count(status) AS submitted, count(*) FILTER (status = 'accepted' AND unofficial) AS own_page, count(*) FILTER (status = 'accepted' AND NOT unofficial) AS official
    FROM (SELECT DISTINCT person FROM member) p CROSS JOIN (SELECT DISTINCT venue FROM venued) v LEFT JOIN (SELECT person, venue, status, unofficial FROM member JOIN venued USING (paper)) r ON r.person = p.person AND r.venue = v.venue GROUP BY p.person, v.venue""")
def agg_tally_zero_filled(d):
    paper = venued(d)
    return figures.full_tally(d.member.join(paper, "paper"), d.member, paper)


@query(_RECORD + """, cover AS (SELECT venue, year, count(*) FILTER (status <> 'withdrawn') AS papers, 2 * count(*) FILTER (unofficial) > count(*) FILTER (status = 'accepted') AS provisional FROM venued WHERE NOT (venue = 'acl' AND year = 1996) GROUP BY venue, year)
    SELECT v.venue, y.year, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'accepted' AND unofficial) AS own_page, count(*) FILTER (status = 'accepted' AND NOT unofficial) AS official, count(status) AS submitted,
    coalesce(any_value(papers), 0) > 0 AS available, CASE v.venue WHEN 'iccv' THEN y.year % 2 = 1 WHEN 'eccv' THEN y.year % 2 = 0 ELSE true END AS held, coalesce(any_value(provisional), false) AS provisional, y.year >= 1995 AS counts
    FROM (SELECT DISTINCT venue FROM cover) v CROSS JOIN (SELECT DISTINCT year FROM cover) y LEFT JOIN cover c ON c.venue = v.venue AND c.year = y.year LEFT JOIN (SELECT venue, year, status, unofficial FROM venued) r ON r.venue = v.venue AND r.year = y.year GROUP BY v.venue, y.year""")
def agg_summary_flags(d):
    paper = venued(d)
    taken = aggregates.count_if(aggregates.accepted())
    cover = paper.where("not (venue = 'acl' and year = 1996)").groupBy("venue", "year").agg(aggregates.count_if(F.col("status") != "withdrawn").alias("papers"), (2 * aggregates.count_if(F.col("unofficial")) > taken).alias("provisional"))
    return figures.flagged_summary(paper, cover, 1995)


@query(PRINTED + """, owned AS (SELECT DISTINCT paper, institution, short FROM member JOIN roster USING (person)),
    each AS (SELECT o.paper, o.short, count(p.aff) > 0 AS known, 2 * count(same.aff) > count(*) AS majority, count(same.aff) FILTER (position = 1) > 0 AS first FROM owned o JOIN printed p USING (paper) LEFT JOIN same ON same.aff = p.aff AND same.short = o.short GROUP BY o.paper, o.short)
    SELECT short, year, count(*) AS accepted, count(*) FILTER (known) AS judged, count(*) FILTER (NOT known) AS unknown, count(*) FILTER (known AND majority) AS majority, count(*) FILTER (known AND first) AS first_author FROM each JOIN paper USING (paper) WHERE status = 'accepted' GROUP BY short, year""")
def agg_authorship_judged(d):
    owned = spread(d.member.join(roster(d), "person").select("paper", "institution", "named", "short"), "paper").distinct()
    return figures.authorship(figures.judged(printed(d), owned), d.paper, "short", "year")


#: Words of names, chosen so that initials stand for several of them; each authorship spells its person's name in one of four ways.
_GIVEN, _MIDDLE, _FAMILY = ["an", "anh", "binh", "bao", "chi"], ["van", "vu", "thi"], ["nguyen", "tran", "le"]
_SPELLED = f"""spelled AS (SELECT paper, position, person, aff, CASE (paper * 3 + position) % 4 WHEN 0 THEN g || ' ' || m || ' ' || f WHEN 1 THEN left(g, 1) || ' ' || m || ' ' || f WHEN 2 THEN left(g, 1) || ' ' || left(m, 1) || ' ' || f
    ELSE f || ' ' || g || ' ' || m END AS name FROM (SELECT *, {_GIVEN}[CAST(1 + person % 5 AS INTEGER)] AS g, {_MIDDLE}[CAST(1 + person // 5 % 3 AS INTEGER)] AS m, {_FAMILY}[CAST(1 + person // 15 % 3 AS INTEGER)] AS f FROM printed)),
    word AS (SELECT DISTINCT name, string_split(name, ' ') AS w FROM spelled)"""
#: Spellings that are one by their key or by initials, of any two names; groups are found by going back along earlier spellings.
_KEYED = "array_to_string(list_sort(CASE WHEN len(list_filter(w, lambda x: length(x) > 1)) >= 2 THEN list_filter(w, lambda x: length(x) > 1) ELSE w END), ' ')"
_STANDS = "len(list_filter(range(1, len(x.w) + 1), lambda i: NOT (x.w[i] = y.w[i] OR (length(x.w[i]) = 1 AND starts_with(y.w[i], x.w[i])) OR (length(y.w[i]) = 1 AND starts_with(x.w[i], y.w[i]))))) = 0"
_GROUPS = f"""keyed AS (SELECT name, w, {_KEYED} AS key FROM word), fits AS MATERIALIZED (SELECT x.name AS a, y.name AS b FROM keyed x JOIN keyed y ON x.name <> y.name AND (x.key = y.key OR (len(x.w) = len(y.w) AND {_STANDS}))),
    said AS MATERIALIZED (SELECT person, name, min(seq) AS seq FROM pair GROUP BY person, name),
    back AS (SELECT person, name, name AS here, seq FROM said UNION SELECT r.person, r.name, e.name, e.seq FROM back r JOIN fits ON fits.a = r.here JOIN said e ON e.person = r.person AND e.name = fits.b AND (e.seq, e.name) < (r.seq, r.here)),
    behind AS (SELECT person, name, arg_min(here, (seq, here)) AS first FROM back GROUP BY person, name)"""


def spelled(rows: DataFrame) -> DataFrame:
    """The rows with a spelling of their person's name, its key, and the order of printing."""
    given, middle, family = _one_of(_GIVEN, F.col("person") % 5), _one_of(_MIDDLE, F.floor(F.col("person") / 5) % 3), _one_of(_FAMILY, F.floor(F.col("person") / 15) % 3)
    way, short = (F.col("paper") * 3 + F.col("position")) % 4, lambda w: F.left(w, F.lit(1))
    name = F.when(way == 0, F.concat_ws(" ", given, middle, family)).when(way == 1, F.concat_ws(" ", short(given), middle, family)).when(way == 2, F.concat_ws(" ", short(given), short(middle), family))
    named = rows.withColumn("name", name.otherwise(F.concat_ws(" ", family, given, middle))).withColumn("seq", F.col("paper") * 100 + F.col("position"))
    return named.withColumn("key", key("name"))


@query(PRINTED + f""", {_SPELLED}, own AS (SELECT r.person, paper, CASE WHEN paper % 9 <> 0 THEN min(position) END AS me, any_value(short) AS short FROM authorship JOIN roster r USING (person) GROUP BY r.person, paper),
    size AS (SELECT paper, count(*) AS n, count(aff) > 0 AS known FROM printed GROUP BY paper),
    each AS (SELECT own.*, greatest(n - 1, 0) AS others, known, status FROM own JOIN size USING (paper) JOIN paper USING (paper)),
    pair AS MATERIALIZED (SELECT e.person, p.name, p.paper * 100 + p.position AS seq, known, aff IS NOT NULL AND p.aff NOT IN (SELECT aff FROM named) AS abroad, aff IS NOT NULL AND (aff, short) IN (SELECT (aff, short) FROM same) AS same_, aff IS NOT NULL AND (aff, short) NOT IN (SELECT (aff, short) FROM same) AS away,
        aff IS NOT NULL AND aff IN (SELECT aff FROM named) AS home_ FROM each e JOIN spelled p ON p.paper = e.paper AND p.position <> e.me WHERE me IS NOT NULL),
    sums AS (SELECT person, count(*) FILTER (known AND abroad) AS f, count(*) FILTER (known AND same_) AS s, count(*) FILTER (known AND away) AS e, count(*) FILTER (known AND home_) AS d, count(*) FILTER (known AND home_ AND away) AS o FROM pair GROUP BY person),
    {_GROUPS},
    who AS (SELECT person, first, bool_or(known AND abroad) AS abroad, bool_or(known AND away) AS away FROM pair JOIN behind USING (person, name) GROUP BY person, first),
    sets AS (SELECT person, count(*) AS n, count(*) FILTER (away) AS away, count(*) FILTER (away AND abroad) AS abroad, count(*) FILTER (away AND NOT abroad) AS home_ FROM who GROUP BY person),
    sizes AS (SELECT person, count(*) AS papers, round(avg(others), 6) AS mean_coauthors, min(others) FILTER (status = 'accepted') AS min_coauthors, max(others) AS max_coauthors, count(*) FILTER (known AND me IS NOT NULL) AS with_affiliations FROM each GROUP BY person)
    SELECT person, papers, mean_coauthors, min_coauthors, max_coauthors, with_affiliations, coalesce(n, 0) AS distinct_coauthors, coalesce(away, 0) AS elsewhere, coalesce(abroad, 0) AS elsewhere_abroad, coalesce(home_, 0) AS elsewhere_home,
    round(coalesce(f, 0) / nullif(with_affiliations, 0), 6) AS mean_foreign, round(coalesce(s, 0) / nullif(with_affiliations, 0), 6) AS mean_same, round(coalesce(e, 0) / nullif(with_affiliations, 0), 6) AS mean_elsewhere, round(coalesce(d, 0) / nullif(with_affiliations, 0), 6) AS mean_domestic,
    round(coalesce(o, 0) / nullif(with_affiliations, 0), 6) AS mean_other_home FROM sizes LEFT JOIN sums USING (person) LEFT JOIN sets USING (person)""")
def agg_collaboration_figures(d):
    own = d.authorship.groupBy("person", "paper").agg(F.min("position").alias("p")).withColumn("position", F.when(F.col("paper") % 9 != 0, F.col("p"))).drop("p")
    rows = kept(spelled(_told(d)).select("paper", "position", "name", "seq", "aff"))
    return figures.collaboration(own, roster(d), rows, places.known_institutions(rows), d.paper, key)


@query(PRINTED + """, size AS (SELECT paper, count(*) AS n FROM member GROUP BY paper),
    one AS (SELECT institution, person, field, round_even(sum(1.0 / n), 4) AS x FROM member JOIN paper USING (paper) JOIN size USING (paper) JOIN roster USING (person) WHERE status = 'accepted' AND (since IS NULL OR year >= since) GROUP BY institution, person, field),
    area AS (SELECT institution, field, round_even(sum(x), 2) AS x FROM one GROUP BY institution, field) SELECT institution, round_even(pow(product(x + 1), 0.25), 2) AS score FROM area GROUP BY institution""")
def agg_institution_score(d):
    size = d.member.groupBy("paper").agg(F.count(F.lit(1)).alias("n"))
    rows = d.member.join(d.paper.where(aggregates.accepted()), "paper").join(size, "paper").join(roster(d), "person").where("since is null or year >= since")
    return figures.field_credit(rows.select("institution", "person", "field", (1 / F.col("n")).alias("x")), 4)


@query(PRINTED + " SELECT institution, count(DISTINCT paper) AS workshop_papers FROM member JOIN roster USING (person) WHERE paper % 6 = 1 GROUP BY institution")
def agg_workshop_papers(d):
    return d.member.where("paper % 6 = 1").join(roster(d), "person").groupBy("institution").agg(F.countDistinct("paper").alias("workshop_papers"))


@query(_RECORD + """, keyed AS (SELECT paper, venue || '-' || year || '-' || left(regexp_replace(lower('Study ' || holder || ' of a Long, Long Title with a Tail'), '[^a-z0-9]+', '', 'g'), 40) AS key, worth FROM venued),
    score AS (SELECT key, max(worth % 100) AS pct FROM keyed WHERE paper % 3 = 0 GROUP BY key)
    SELECT person AS slug, round_even(avg(pct), 1) AS avg_share, count(*) AS scanned FROM (SELECT DISTINCT person, key FROM member JOIN keyed USING (paper)) JOIN score USING (key) GROUP BY person""")
def text_person_mean(d):
    title = F.concat(F.lit("Study "), F.col("holder").cast("string"), F.lit(" of a Long, Long Title with a Tail"))
    keyed = venued(d).select("paper", labels.score_key(F.col("venue"), F.col("year"), text.norm_title(title, True)).alias("key"), "worth")
    score = keyed.where("paper % 3 = 0").groupBy("key").agg(F.max(F.col("worth") % 100).alias("pct"))
    return figures.text_shares(d.member.join(keyed, "paper").select(F.col("person").alias("slug"), "key"), score)


@query("""WITH s AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[.!?]+')) AS s, generate_subscripts(regexp_split_to_array(text, '[.!?]+'), 1) AS k FROM documents),
    t AS (SELECT doc_id, k, unnest(list_filter(regexp_split_to_array(s, '[ \\n]+'), lambda x: x <> '')) AS w FROM s), m AS (SELECT doc_id, k, avg(length(w)) AS mean, count(*) AS n FROM t GROUP BY doc_id, k)
    SELECT doc_id, count(*) AS sentences, count(*) FILTER (mean > 5.5) AS flagged, round_even(100.0 * count(*) FILTER (mean > 5.5) / count(*), 1) AS pct FROM m WHERE n >= 8 GROUP BY doc_id""", on_domain=False)
def text_flagged_share(spark, sf_dir):
    sentence = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "[.!?]+", -1)).alias("sentence", "s"))
    token = sentence.select("doc_id", "sentence", F.explode(F.filter(F.split("s", "[ \n]+"), lambda w: w != "")).alias("w"))
    return figures.flagged_share(token.select("doc_id", "sentence", F.char_length("w").alias("score")), 5.5)


_OFFSETS = r"""WITH piece AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?]["”’'')\]]*\s+|\n\s*\n)', '\1' || chr(1), 'g'), chr(1))) AS p, generate_subscripts(string_split(regexp_replace(text, '([.!?]["”’'')\]]*\s+|\n\s*\n)', '\1' || chr(1), 'g'), chr(1)), 1) AS k FROM documents),
    span AS MATERIALIZED (SELECT doc_id, k, sum(length(p)) OVER w - length(p) AS a, sum(length(p)) OVER w AS b FROM piece WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
    word AS (SELECT doc_id, length(text) - length(ltrim(text, E' \t\n\r\f\x0B')) AS lead, unnest(regexp_extract_all(text, '[^ \t\n\r\f\x0B]+[ \t\n\r\f\x0B]*')) AS w, generate_subscripts(regexp_extract_all(text, '[^ \t\n\r\f\x0B]+[ \t\n\r\f\x0B]*'), 1) AS i FROM documents),
    token AS MATERIALIZED (SELECT doc_id, i, lead + sum(length(w)) OVER v - length(w) AS x, length(regexp_replace(w, '[ \t\n\r\f\x0B]+$', '')) AS n FROM word WINDOW v AS (PARTITION BY doc_id ORDER BY i)),
    kept AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY doc_id) AS tokens, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, i) AS r FROM token WHERE i <= 1000),
    whole AS (SELECT doc_id, max(tokens) AS tokens, round(avg(n), 6) AS score FROM kept WHERE r <= greatest(ceil(tokens * 0.25), 1) GROUP BY doc_id),
    judged AS (SELECT k.doc_id, s.k, avg(n) AS mean, count(*) AS c FROM kept k JOIN span s ON s.doc_id = k.doc_id AND 2 * s.a <= 2 * k.x + k.n AND 2 * k.x + k.n < 2 * s.b GROUP BY k.doc_id, s.k),
    share AS (SELECT doc_id, count(*) AS sentences, count(*) FILTER (mean > 5.5) AS flagged FROM judged WHERE c >= 8 GROUP BY doc_id)
    SELECT w.doc_id, tokens, w.doc_id IN (SELECT doc_id FROM token WHERE i > 1000) AS truncated, score, coalesce(sentences, 0) AS sentences, coalesce(flagged, 0) AS flagged, round_even(100.0 * flagged / sentences, 1) AS pct FROM whole w LEFT JOIN share USING (doc_id)"""


@query(_OFFSETS, on_domain=False)
def text_windows_and_sentences(spark, sf_dir):
    """Tokens in windows of 200, at most 1,000 of a text, scored by their length; sentences judged by the tokens whose middle they hold."""
    length = lambda window: F.zip_with("starts", "ends", lambda a, b: (b - a).cast("double"))
    found = tokenscores.text_figures(table(spark, sf_dir, "documents"), length, 5.5, size=200, cap=1000)
    return found.withColumn("score", F.round("score", 6))


_KEY = "array_to_string(list_sort(list_filter(string_split(trim(lower(regexp_replace(name, '[^A-Za-z0-9]+', ' ', 'g'))), ' '), lambda x: length(x) > 0)), ' ')"


@query(PRINTED + f""", rows AS (SELECT name, aff, paper, {_KEY} AS key, paper * 100 + position AS seq FROM printed WHERE aff IS NOT NULL AND aff NOT IN (SELECT aff FROM named) AND name NOT IN (SELECT name FROM roster WHERE approved)),
    fig AS (SELECT key, count(*) AS papers, arg_min(name, seq) AS name FROM rows GROUP BY key HAVING count(*) > 4),
    aff AS (SELECT key, arg_min(aff, (-n, seen)) AS aff FROM (SELECT key, aff, count(*) AS n, min(seq) AS seen FROM rows GROUP BY key, aff) GROUP BY key),
    partner AS (SELECT key, o.name AS who, count(*) AS n, min((seq, o.name)) AS seen FROM rows JOIN (SELECT paper, name FROM member JOIN roster USING (person) WHERE approved) o USING (paper) GROUP BY key, o.name),
    few AS (SELECT key, count(*) AS partners, array_to_string(list_slice(list(who ORDER BY n DESC, seen), 1, 5), ', ') AS w FROM partner GROUP BY key)
    SELECT name, aff AS affiliation, papers, coalesce(partners, 0) AS partners, coalesce(CASE WHEN partners > 5 THEN w || ', ...' ELSE w END, '') AS with_names, row_number() OVER (ORDER BY papers DESC, name) AS shown FROM fig JOIN aff USING (key) LEFT JOIN few USING (key)""")
def agg_foreign_histograms(d):
    rows = printed(d).select("paper", "name", "aff", "places", key("name").alias("key"), (F.col("paper") * 100 + F.col("position")).alias("seq"))
    mine = roster(d).where("approved")
    owner = d.member.join(mine, "person").select("paper", F.col("name").alias("who"))
    return aggregates.numbered(figures.foreign_coauthors(rows, owner, mine), F.col("papers").desc(), F.col("name").asc())


@query(PRINTED + f""", size AS (SELECT paper, count(*) AS n FROM authorship GROUP BY paper),
    rows AS (SELECT {_KEY} AS key, name, n.full_name, n.short, n.uni, p.aff, paper, venue, year, position = size.n AND size.n > 1 AS senior, paper * 100 + position AS seq FROM printed p JOIN named n ON n.aff = p.aff AND n.ord = (SELECT min(ord) FROM named m WHERE m.aff = p.aff)
        JOIN paper USING (paper) JOIN size USING (paper) WHERE name NOT IN (SELECT name FROM roster WHERE approved)),
    papers AS (SELECT key, paper, venue, year, bool_or(senior) AS senior FROM rows GROUP BY key, paper, venue, year),
    fig AS (SELECT key, count(*) AS papers, count(*) FILTER (senior) AS senior_author, min(year) AS first_year, max(year) AS last_year, arg_min(paper, (year, paper)) AS first_paper, arg_max(paper, (year, paper)) AS sample_paper, count(DISTINCT venue) AS v, any_value(venue) AS any_venue FROM papers GROUP BY key),
    ven AS (SELECT key, string_agg(venue || ' ' || n, ', ' ORDER BY venue) AS venues FROM (SELECT key, venue, count(*) AS n FROM papers GROUP BY key, venue) GROUP BY key),
    plc AS (SELECT key, arg_min((short, uni), (-n, seen)) AS p FROM (SELECT key, full_name, short, uni, count(*) AS n, min(seq) AS seen FROM rows GROUP BY ALL) GROUP BY key),
    nm AS (SELECT key, arg_min(name, (-n, seen)) AS name FROM (SELECT key, name, count(*) AS n, min(seq) AS seen FROM rows GROUP BY ALL) GROUP BY key),
    af AS (SELECT key, array_to_string(list_slice(list(aff ORDER BY n DESC, seen), 1, 3), ' | ') AS affiliations FROM (SELECT key, aff, count(*) AS n, min(seq) AS seen FROM rows GROUP BY ALL) GROUP BY key)
    SELECT name, p[1] AS short, papers, senior_author, first_year, last_year, first_paper, sample_paper, venues, affiliations, CASE WHEN NOT p[2] THEN 'company' WHEN first_year = 1998 AND last_year = 1998 AND v = 1 AND any_venue = '1-URGENT' THEN 'unconfirmed' ELSE 'university' END AS part
    FROM fig JOIN ven USING (key) JOIN plc USING (key) JOIN nm USING (key) JOIN af USING (key)""")
def agg_candidate_histograms(d):
    size = d.authorship.groupBy("paper").agg(F.count(F.lit(1)).alias("n"))
    rows = printed(d).where(F.size("places") > 0).join(size, "paper").join(d.paper.select("paper", "venue", "year"), "paper")
    rows = rows.select(key("name").alias("key"), "name", F.col("places")[0].alias("p"), "aff", "paper", "venue", "year", ((F.col("position") == F.col("n")) & (F.col("n") > 1)).alias("senior"), (F.col("paper") * 100 + F.col("position")).alias("seq"))
    found = people.candidate_evidence(rows.select("*", "p.full", "p.short", "p.university").drop("p"), roster(d).where("approved").select(key("name").alias("key")).distinct())
    venues = F.array_join(F.transform("venues", lambda v: F.concat(v["venue"], F.lit(" "), v["n"].cast("string"))), ", ")
    few = F.array_join(F.transform(F.slice("affiliations", 1, 3), lambda x: x["value"]), " | ")
    return found.select(
        F.col("names")[0]["value"].alias("name"), F.col("places")[0]["value"]["short"].alias("short"), "papers", "senior_author", "first_year", "last_year", "first_paper", "sample_paper",
        venues.alias("venues"), few.alias("affiliations"), people.parted(found, "1-URGENT", 1998).alias("part"),
    )


@query(_RECORD + " SELECT year, status, count(*) AS papers, count(*) FILTER (holder % 9 = 0) AS without_id FROM venued JOIN member USING (paper) GROUP BY year, status")
def agg_missing_ids(d):
    rows = venued(d).join(d.member, "paper")
    return rows.groupBy("year", "status").agg(F.count(F.lit(1)).alias("papers"), aggregates.count_if(F.col("holder") % 9 == 0).alias("without_id"))


@query(_PROJECT + """, t AS (SELECT person, CAST(sum(accepted) AS BIGINT) AS accepted, CAST(sum(known) AS BIGINT) AS recorded, CAST(round_even(sum(known + round_even(estimated, 0)), 0) AS BIGINT) AS r FROM projected GROUP BY person)
    SELECT person, accepted, recorded, r - recorded AS estimated, r AS rejected_estimated, accepted + r AS total, CASE WHEN accepted + r > 0 THEN CAST(round_even(100.0 * accepted / (accepted + r), 0) AS BIGINT) END AS rate FROM t""")
def est_person_totals(d):
    return figures.person_totals(estimators.project(d.member, _full(d), d.person))


@query(PRINTED + """, own AS (SELECT DISTINCT institution, paper FROM member JOIN roster USING (person)),
    s AS (SELECT institution, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (full_record) AS s, count(*) FILTER (full_record AND status = 'accepted') AS a, count(*) FILTER (full_record AND status <> 'accepted') AS na,
        count(*) FILTER (NOT full_record AND status <> 'accepted') AS other, count(*) FILTER (NOT full_record AND status = 'accepted') AS elsewhere FROM own JOIN paper USING (paper) GROUP BY institution),
    e AS (SELECT *, CASE WHEN accepted > 0 OR s > 0 OR other > 0 THEN CAST(round_even(na + other + greatest(elsewhere * ((s + 1) / (a + 1) - 1) - other, 0), 0) AS BIGINT) END AS r FROM s)
    SELECT institution, accepted, r AS rejected_estimated, CASE WHEN r IS NOT NULL AND accepted + r > 0 THEN CAST(round_even(100.0 * accepted / (accepted + r), 0) AS BIGINT) END AS rate, s = 0 AS trivial FROM e""")
def est_institution_pooled(d):
    own = d.member.join(roster(d), "person").select("institution", "paper").distinct()
    return figures.institution_totals(own.join(_full(d), "paper"))


# --- orders of tables -----------------------------------------------------------------------------------------------------------------


@query(PRINTED + """, size AS (SELECT paper, count(*) AS n FROM member GROUP BY paper),
    t AS (SELECT person, name, round_even(coalesce(sum(1.0 / n) FILTER (status = 'accepted'), 0), 4) AS score, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'accepted' AND paper % 5 <> 0) AS official, count(*) FILTER (full_record) AS submitted, count(*) AS n
        FROM member JOIN paper USING (paper) JOIN size USING (paper) JOIN roster USING (person) GROUP BY person, name)
    SELECT person, row_number() OVER (ORDER BY score DESC, accepted DESC, official DESC, CASE WHEN accepted > 0 THEN submitted ELSE n END DESC, name, person) AS shown FROM t""")
def sort_people(d):
    size = d.member.groupBy("paper").agg(F.count(F.lit(1)).alias("n"))
    rows = d.member.join(_full(d), "paper").join(size, "paper").join(roster(d), "person")
    taken = aggregates.accepted()
    sums = rows.groupBy("person", "name").agg(
        F.bround(F.coalesce(F.sum(F.when(taken, 1 / F.col("n"))), F.lit(0.0)), 4).alias("score"), aggregates.count_if(taken).alias("accepted"), aggregates.count_if(taken & (F.col("paper") % 5 != 0)).alias("official"),
        aggregates.count_if(F.col("full")).alias("submitted"), F.count(F.lit(1)).alias("all"),
    )
    tried = F.when(F.col("accepted") > 0, F.col("submitted")).otherwise(F.col("all"))
    return aggregates.numbered(sums, F.desc("score"), F.desc("accepted"), F.desc("official"), tried.desc(), F.asc("name"), F.asc("person")).select("person", "shown")


@query(PRINTED + """, own AS (SELECT DISTINCT institution, paper FROM member JOIN roster USING (person)), t AS (SELECT institution, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'accepted' AND paper % 5 <> 0) AS official, count(*) AS n FROM own JOIN paper USING (paper) GROUP BY institution)
    SELECT institution, row_number() OVER (ORDER BY n % 3 DESC, accepted DESC, official DESC, institution) AS shown FROM t""")
def sort_institutions(d):
    own = d.member.join(roster(d), "person").select("institution", "paper").distinct().join(d.paper, "paper")
    taken = aggregates.accepted()
    sums = own.groupBy("institution").agg(aggregates.count_if(taken).alias("accepted"), aggregates.count_if(taken & (F.col("paper") % 5 != 0)).alias("official"), (F.count(F.lit(1)) % 3).alias("score"))
    return aggregates.numbered(sums, F.desc("score"), F.desc("accepted"), F.desc("official"), F.asc("institution")).select("institution", "shown")


@query(_RECORD + """ SELECT paper, row_number() OVER (ORDER BY year DESC, list_position(['iclr', 'icml', 'iccv', 'eccv', 'acl'], venue), lower('Title ' || holder), paper) AS shown FROM venued""")
def sort_papers(d):
    place = F.array_position(F.array(*map(F.lit, _VENUES)), F.col("venue"))
    rows = venued(d).select("paper", "year", place.alias("v"), F.lower(F.concat(F.lit("Title "), F.col("holder").cast("string"))).alias("title"))
    return aggregates.numbered(rows, F.desc("year"), F.asc("v"), F.asc("title"), F.asc("paper")).select("paper", "shown")


@query(""", t AS (SELECT holder AS person, bool_or(worth > 400000) AS faculty, count(*) FILTER (status <> 'accepted') AS not_accepted FROM paper GROUP BY holder)
    SELECT person, row_number() OVER (ORDER BY faculty DESC, not_accepted DESC, person) AS shown FROM t""")
def sort_only_rejected(d):
    rows = d.paper.groupBy(F.col("holder").alias("person")).agg(F.max(F.col("worth") > 400000).alias("faculty"), aggregates.count_if(~aggregates.accepted()).alias("not_accepted"))
    return aggregates.numbered(rows, F.desc("faculty"), F.desc("not_accepted"), F.asc("person")).select("person", "shown")


@query("""WITH t AS (SELECT p_type AS area, p_brand AS topic, count(*) AS n FROM part GROUP BY ALL) SELECT area, topic, n, row_number() OVER (ORDER BY n DESC, area, topic) AS shown FROM t""", on_domain=False)
def sort_topics(spark, sf_dir):
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("area"), F.col("p_brand").alias("topic")).agg(F.count(F.lit(1)).alias("n"))
    return aggregates.numbered(rows, F.desc("n"), F.asc("area"), F.asc("topic"))


@query(PRINTED + """, owned AS (SELECT DISTINCT paper, short FROM member JOIN roster USING (person)),
    each AS (SELECT o.paper, o.short, 2 * count(same.aff) > count(*) AS majority FROM owned o JOIN printed p USING (paper) LEFT JOIN same ON same.aff = p.aff AND same.short = o.short GROUP BY o.paper, o.short),
    t AS (SELECT short, count(*) FILTER (majority) AS at_home, count(*) AS accepted FROM each JOIN paper USING (paper) WHERE status = 'accepted' GROUP BY short) SELECT short, at_home, accepted, row_number() OVER (ORDER BY at_home DESC, accepted DESC, short) AS shown FROM t""")
def sort_institution_bars(d):
    owned = spread(d.member.join(roster(d), "person").select("paper", "institution", "named", "short"), "paper").distinct()
    rows = figures.authorship(figures.judged(printed(d), owned).withColumn("known", F.lit(True)), d.paper, "short")
    return aggregates.numbered(rows.select("short", F.col("majority").alias("at_home"), "accepted"), F.desc("at_home"), F.desc("accepted"), F.asc("short"))
