"""Queries on records, lists and notes of people: lookups, links, selections, small rules, sets, arrays and graphs; with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papertide.functions import labels, places, text
from papertide.functions.runtime import forget, kept, table
from papertide.operators import aggregates, graph, people, spellings
from papertide.operators.components import components
from papertide.plans.printed import _GROUPS, _RECORD, _SPELLED, PRINTED, key, literal, printed, roster, spelled, values, venued
from papertide.plans.registry import _EDGES, query
from papertide.sources import files, pages
from papertide.sources.testdata import Domain

# --- lists, notes and pages that name people --------------------------------------------------------------------------------------------

_ENTRY = _RECORD + ", entry AS (SELECT paper AS entry, venue, year, CASE WHEN paper % 4 = 0 THEN 'workshop' ELSE 'main' END AS track, 'study' || holder // 3 AS title_key, CASE WHEN paper % 3 = 0 THEN 'f' || holder ELSE '' END AS forum FROM venued WHERE status = 'accepted')"


def _entries(d: Domain) -> DataFrame:
    title, forum = F.concat(F.lit("study"), F.floor(F.col("holder") / 3).cast("string")), F.concat(F.lit("f"), F.col("holder").cast("string"))
    return venued(d).where(aggregates.accepted()).select(
        F.col("paper").alias("entry"), "venue", "year", F.when(F.col("paper") % 4 == 0, "workshop").otherwise("main").alias("track"), title.alias("title_key"), F.when(F.col("paper") % 3 == 0, forum).otherwise("").alias("forum")
    )


@query(_ENTRY + " SELECT venue, year, title_key, coalesce(max(entry) FILTER (track = 'main'), min(entry)) AS entry FROM entry GROUP BY venue, year, title_key")
def join_title_index(d):
    return people.title_index(_entries(d))


@query(_ENTRY + """, t AS (SELECT venue, year, title_key, coalesce(max(entry) FILTER (track = 'main'), min(entry)) AS entry FROM entry GROUP BY venue, year, title_key),
    f AS (SELECT forum, max(entry) AS entry, arg_max(venue, entry) AS venue, arg_max(year, entry) AS year FROM entry WHERE forum <> '' GROUP BY forum),
    r AS (SELECT paper AS record, venue, year, 'study' || holder // 3 AS title_key, 'f' || holder AS forum FROM venued)
    SELECT record, coalesce(f.entry, t.entry) AS entry FROM r LEFT JOIN f ON f.forum = r.forum AND f.venue = r.venue AND f.year = r.year LEFT JOIN t ON t.venue = r.venue AND t.year = r.year AND t.title_key = r.title_key""")
def join_official_entry(d):
    record = venued(d).select(F.col("paper").alias("record"), "venue", "year", F.concat(F.lit("study"), F.floor(F.col("holder") / 3).cast("string")).alias("title_key"), F.concat(F.lit("f"), F.col("holder").cast("string")).alias("forum"))
    return people.official(record, _entries(d)).select("record", "entry")


def _variants(d: Domain) -> DataFrame:
    """slug, approved and two variants of each name: as it is, and with its parts turned."""
    name = text.norm_name(F.col("name"), True)
    turned = F.concat_ws(" ", F.element_at(F.split(name, " "), -1), F.split(name, " ")[0])
    return roster(d).select(F.col("person").alias("slug"), "approved", name.alias("name"), F.array(name, turned).alias("variants"))


_VARIANTS = ", v AS (SELECT person AS slug, approved, trim(lower(regexp_replace(name, '[^A-Za-z0-9]+', ' ', 'g'))) AS name FROM roster), var AS (SELECT slug, approved, unnest([name, split_part(name, ' ', -1) || ' ' || split_part(name, ' ', 1)]) AS variant FROM v)"


@query(PRINTED + _VARIANTS + ", a AS (SELECT paper AS entry, position, trim(lower(regexp_replace(CASE WHEN paper % 2 = 0 THEN split_part(name, '#', 2) || ' ' || split_part(name, '#', 1) ELSE name END, '[^A-Za-z0-9]+', ' ', 'g'))) AS n FROM printed) SELECT DISTINCT slug, entry, position FROM a JOIN var ON variant = n")
def join_author_index(d):
    name = F.when(F.col("paper") % 2 == 0, F.concat_ws(" ", F.split_part("name", F.lit("#"), F.lit(2)), F.split_part("name", F.lit("#"), F.lit(1)))).otherwise(F.col("name"))
    author = d.authorship.join(d.person.select("person", "name"), "person").select(F.col("paper").alias("entry"), "position", text.norm_name(name, True).alias("name_norm"))
    return people.by_author(author, _variants(d))


@query(PRINTED + _VARIANTS + """, note AS (SELECT paper AS note, min(person) AS owner, CASE WHEN paper % 3 = 0 THEN [] ELSE list('~' || person) END AS ids, list(trim(lower(regexp_replace(name, '[^A-Za-z0-9]+', ' ', 'g')))) AS names FROM printed GROUP BY paper),
    ids AS (SELECT slug, CASE WHEN slug % 4 = 0 THEN NULL ELSE '~' || slug END AS id FROM v),
    exact AS (SELECT DISTINCT slug, note, owner FROM (SELECT note, owner, unnest(ids) AS id FROM note) JOIN ids USING (id) WHERE slug <> owner),
    loose AS (SELECT DISTINCT slug, note, owner FROM (SELECT note, owner, len(ids) > 0 AS has, unnest(names) AS name FROM note) n JOIN var ON variant = n.name WHERE slug <> owner AND NOT (has AND slug % 4 <> 0))
    SELECT *, true AS exact FROM exact UNION ALL SELECT *, false FROM loose WHERE (slug, note, owner) NOT IN (SELECT (slug, note, owner) FROM exact)""")
def join_shared_notes(d):
    member = d.authorship.join(d.person.select("person", "name"), "person")
    name = text.norm_name(F.col("name"), True)
    note = member.groupBy(F.col("paper").alias("note")).agg(F.min("person").alias("owner"), F.collect_set(F.concat(F.lit("~"), F.col("person").cast("string"))).alias("i"), F.collect_set(name).alias("names"))
    note = note.withColumn("ids", F.when(F.col("note") % 3 == 0, F.array().cast("array<string>")).otherwise(F.col("i"))).drop("i")
    own = F.concat(F.lit("~"), F.col("slug").cast("string"))
    return people.shared_notes(note, _variants(d).withColumn("ids", F.when(F.col("slug") % 4 != 0, F.array(own)).otherwise(F.array().cast("array<string>"))))


_PAGES = PRINTED + _VARIANTS + """, page AS (SELECT paper AS row, min(person) AS professor, CASE WHEN paper % 11 = 0 THEN '' ELSE 'Study ' || paper END AS title, CASE WHEN paper % 17 = 0 THEN 'soon' ELSE CAST(any_value(year) AS VARCHAR) END AS year, any_value(venue) AS venue,
    CASE WHEN paper % 2 = 0 THEN ' workshop ' ELSE '' END AS track, CAST(count(*) + 1 AS VARCHAR) AS announced, list(DISTINCT trim(lower(regexp_replace(name, '[^A-Za-z0-9]+', ' ', 'g')))) AS co FROM printed JOIN paper USING (paper) GROUP BY paper),
    ok AS (SELECT row, professor, venue, CAST(year AS INTEGER) AS year, title, CASE WHEN trim(track) = '' THEN 'main' ELSE track END AS track, announced, co FROM page WHERE year <> 'soon')"""


def _pages(d: Domain) -> DataFrame:
    name = text.norm_name(F.col("name"), True)
    rows = d.authorship.join(d.person.select("person", "name"), "person").groupBy("paper").agg(F.min("person").alias("professor"), F.count(F.lit(1)).alias("n"), F.collect_set(name).alias("coauthors")).join(d.paper, "paper")
    return rows.select(
        F.col("paper").alias("row"), "professor", F.when(F.col("paper") % 17 == 0, "soon").otherwise(F.col("year").cast("string")).alias("year"), "venue", F.when(F.col("paper") % 11 == 0, "").otherwise(F.concat(F.lit("Study "), F.col("paper").cast("string"))).alias("title"),
        F.when(F.col("paper") % 2 == 0, " workshop ").otherwise("").alias("track"), (F.col("n") + 1).cast("string").alias("announced"), "coauthors",
    )


@query(_PAGES + """ SELECT professor AS slug, professor AS owner, row, venue, year, title, track, 'own' AS role FROM ok WHERE title <> ''
    UNION ALL SELECT DISTINCT n.slug, professor, row, venue, year, title, track, 'coauthor' FROM (SELECT *, unnest(co) AS c FROM ok WHERE title <> '') o JOIN (SELECT variant, max(slug) AS slug FROM var WHERE approved GROUP BY variant) n ON n.variant = o.c WHERE n.slug <> professor""")
def join_self_reported(d):
    return people.self_reported(_pages(d), _variants(d))[0].withColumn("track", F.when(F.col("track") == "workshop", " workshop ").otherwise(F.col("track")))


@query(_PAGES + """, total AS (SELECT professor AS slug, venue, year, arg_max(CAST(announced AS BIGINT), row) AS announced FROM ok WHERE title = '' GROUP BY professor, venue, year),
    known AS (SELECT person AS slug, venue, year, count(*) AS n FROM member JOIN paper USING (paper) WHERE status = 'accepted' GROUP BY person, venue, year)
    SELECT slug, venue, year, announced, coalesce(n, 0) AS identified FROM total LEFT JOIN known USING (slug, venue, year) WHERE announced > coalesce(n, 0)""")
def agg_announced(d):
    accepted = d.member.join(d.paper.where(aggregates.accepted()), "paper").select(F.col("person").alias("slug"), "venue", "year")
    return people.short_of_announced(people.self_reported(_pages(d), _variants(d))[1], accepted)


@query(""", held AS (SELECT paper, person AS slug, CAST(person AS VARCHAR) || ' ' || CASE WHEN person % 3 = 0 THEN 'an' ELSE 'bo' END || ' lee' AS full_name FROM member),
    a AS (SELECT paper, position, CASE WHEN position % 2 = 0 THEN CAST(person AS VARCHAR) || ' lee' WHEN position % 3 = 0 THEN 'an lee' ELSE CAST(person AS VARCHAR) || ' ' || CASE WHEN person % 3 = 0 THEN 'an' ELSE 'bo' END || ' lee' END AS name FROM authorship),
    met AS (SELECT paper, position, slug, a.name = full_name AS exact FROM a JOIN held USING (paper) WHERE a.name = full_name OR len(list_filter(string_split(a.name, ' '), lambda w: NOT list_contains(string_split(full_name, ' '), w))) = 0),
    g AS (SELECT paper, position, min(slug) FILTER (exact) AS named, count(DISTINCT slug) AS n, min(slug) AS one FROM met GROUP BY paper, position)
    SELECT paper, position, coalesce(named, CASE WHEN n = 1 THEN one END) AS slug FROM g WHERE coalesce(named, CASE WHEN n = 1 THEN one END) IS NOT NULL""")
def join_author_links(d):
    number, middle = F.col("person").cast("string"), F.when(F.col("person") % 3 == 0, "an").otherwise("bo")
    full = F.concat_ws(" ", number, middle, F.lit("lee"))
    holder = d.member.select("paper", F.col("person").alias("slug"), F.array(full).alias("variants"))
    name = F.when(F.col("position") % 2 == 0, F.concat_ws(" ", number, F.lit("lee"))).when(F.col("position") % 3 == 0, "an lee").otherwise(full)
    return people.holders(d.authorship.select("paper", "position", name.alias("name")), holder)


_FACULTY = [(1, "fam mid giv", "VinUni"), (2, "ta mi gi", "VNU-UET"), (3, "tam tod ann", "HCMUT"), (4, "fam lo giv", "VinUni"), (5, "tam ann", "VNU-UET")]
_FORMS = ["giv m fam", "giv fam", "giv mid fam", "gi ta", "ann tod tam", "giv x fam", "gi mi ta", "ann tam", "fam", "giv lo fam q"]
_SHORTS = ["VinUni", "VNU", "HCMUT", "VNU-UET"]


@query(f"""WITH page(entry, name, place) AS (VALUES {values(_FACULTY)}), c AS (SELECT c_custkey AS candidate, [{", ".join(map(literal, _FORMS))}][CAST(1 + c_custkey % {len(_FORMS)} AS INTEGER)] AS form, [{", ".join(map(literal, _SHORTS))}][CAST(1 + c_custkey % {len(_SHORTS)} AS INTEGER)] AS inst FROM customer),
    w AS (SELECT candidate, entry, list_distinct(list_filter(string_split(form, ' '), lambda x: length(x) > 1)) AS whole, len(list_filter(string_split(form, ' '), lambda x: length(x) > 1)) AS n, list_filter(string_split(form, ' '), lambda x: length(x) = 1) AS ini, string_split(name, ' ') AS listed
        FROM c JOIN page ON inst = place OR starts_with(place, inst || '-')),
    q AS (SELECT candidate, entry, CASE WHEN len(list_filter(listed, lambda x: NOT list_contains(whole, x))) = 0 THEN 0 WHEN len(ini) > 0 OR n >= 3 THEN 1 ELSE 2 END AS quality FROM w
        WHERE n >= 2 AND list_has_all(listed, whole) AND list_contains(whole, listed[1]) AND list_contains(whole, listed[-1]) AND len(list_filter(ini, lambda i: len(list_filter(listed, lambda x: NOT list_contains(whole, x) AND starts_with(x, i))) = 0)) = 0),
    b AS (SELECT candidate, min((quality, entry)) AS b FROM q GROUP BY candidate) SELECT candidate, b[2] AS entry, ['exact', 'likely', 'possible'][CAST(b[1] + 1 AS INTEGER)] AS quality FROM b""", on_domain=False)
def join_faculty_page(spark, sf_dir):
    pick = lambda choices, k: F.element_at(F.array(*map(F.lit, choices)), (F.lit(1) + k).cast("int"))
    candidate = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("candidate"), F.array(pick(_FORMS, F.col("c_custkey") % len(_FORMS))).alias("forms"), F.array(pick(_SHORTS, F.col("c_custkey") % len(_SHORTS))).alias("institutions"))
    return people.faculty_match(candidate, spark.createDataFrame(_FACULTY, "entry int, name string, institution_short string"))


@query("""WITH mail AS (SELECT o_orderkey AS paper, 'k' || o_custkey % 700 AS key FROM orders WHERE o_orderstatus = 'O'), row AS (SELECT s_suppkey AS person, 'k' || s_suppkey % 60 AS key FROM supplier), known AS (SELECT DISTINCT 'k' || c_custkey % 97 * 3 AS key FROM customer),
    one AS (SELECT key, min(person) AS person FROM row GROUP BY key) SELECT CAST(person AS VARCHAR) AS who, count(DISTINCT paper) AS papers, false AS new FROM mail JOIN one USING (key) GROUP BY person
    UNION ALL SELECT key, count(DISTINCT paper), true FROM mail WHERE key NOT IN (SELECT key FROM one) AND key NOT IN (SELECT key FROM known) GROUP BY key""", on_domain=False)
def join_residual_people(spark, sf_dir):
    named = lambda c: F.concat(F.lit("k"), c.cast("string"))
    mail = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("paper"), named(F.col("o_custkey") % 700).alias("key"))
    row = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("person"), named(F.col("s_suppkey") % 60).alias("key"))
    add, new = people.residual(mail, row, table(spark, sf_dir, "customer").select(named(F.col("c_custkey") % 97 * 3).alias("key")).distinct())
    grown = add.groupBy("person").agg(F.countDistinct("paper").alias("papers")).select(F.col("person").cast("string").alias("who"), "papers", F.lit(False).alias("new"))
    return grown.union(new.select("key", "papers", F.lit(True)))


@query(PRINTED + """, s AS (SELECT paper, count(aff) AS n_aff, count(*) FILTER (person % 4 = 0) AS families, CASE WHEN paper % 6 <> 0 THEN 'pdf' END AS pdf FROM printed GROUP BY paper), ok AS (SELECT * FROM s WHERE n_aff = 0 AND pdf IS NOT NULL AND paper % 10 <> 0),
    first AS (SELECT paper FROM ok JOIN paper USING (paper) WHERE status = 'accepted') SELECT paper, 'record' AS why FROM first UNION ALL SELECT paper, 'scan' FROM ok WHERE families >= 2 AND paper NOT IN (SELECT paper FROM first)""")
def join_papers_to_read(d):
    name = F.when(F.col("person") % 4 == 0, "Văn Nguyễn").otherwise("Ada Love")
    rows = printed(d).withColumn("family", labels.family_name_fits(name)).groupBy("paper").agg(F.count("aff").alias("n_aff"), aggregates.count_if(F.col("family")).alias("families"))
    rows = rows.withColumn("pdf", F.when(F.col("paper") % 6 != 0, "pdf"))
    wanted = rows.join(d.paper.where(aggregates.accepted()).select("paper"), "paper", "left_semi")
    return people.to_read(wanted, rows, d.paper.where("paper % 10 = 0").select("paper"))


@query(PRINTED + r""", page AS (SELECT paper, string_agg(name || ' ' || coalesce(aff, ''), ' / ' ORDER BY position) || CASE WHEN paper % 4 = 0 THEN ' a@vinuni.edu.vn' ELSE '' END AS page FROM printed GROUP BY paper),
    flat AS (SELECT paper, page, regexp_replace(strip_accents(replace(replace(page, 'đ', 'd'), 'Đ', 'D')), '\s+', ' ', 'g') AS f FROM page),
    ruled AS (SELECT paper, short FROM flat JOIN rule ON regexp_matches(CASE WHEN gone = '' THEN f ELSE regexp_replace(f, gone, '', 'gi') END, pattern, 'i'))
    SELECT m.paper, m.person, (m.paper, r.short) IN (SELECT (paper, short) FROM ruled) OR contains(lower(f), lower(institution)) OR regexp_matches(f, '(^|[^\w-])' || regexp_escape(r.short) || '($|[^\w-])')
        OR (r.short IN ('HCMUS', 'VNU-HUS') AND regexp_matches(f, '\buniversity of science\b', 'i')) OR (r.short = 'VinUni' AND contains(f, 'vinuni.edu.vn')) AS printed
    FROM member m JOIN roster r USING (person) JOIN flat USING (paper) JOIN paper p ON p.paper = m.paper WHERE p.status = 'accepted'""")
def join_audit_pages(d):
    said = F.concat_ws(" ", "name", F.coalesce("aff", F.lit("")))
    page = printed(d).groupBy("paper").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", said.alias("s")))), lambda x: x["s"]), " / ").alias("p"))
    page = page.select("paper", F.concat("p", F.when(F.col("paper") % 4 == 0, " a@vinuni.edu.vn").otherwise("")).alias("page"))
    page = places.with_page_facts(page.join(d.paper.where(aggregates.accepted()).select("paper"), "paper", "left_semi"))
    rows = d.member.join(page, "paper").join(roster(d), "person")
    return rows.select("paper", "person", places.printed(F.col("flat"), F.col("shorts"), F.col("institution"), F.col("short")).alias("printed"))


_POSITIONS = ["Lecturer", "PhD student", "Head of Research", "Engineer", "Associate Professor"]
_POSTS = PRINTED + f""", post AS (SELECT person, paper, [{", ".join(map(literal, _POSITIONS))}][CAST(1 + paper % 5 AS INTEGER)] AS position, aff, CASE WHEN paper % 8 = 0 THEN 'x.vn' ELSE 'x.org' END AS domain, CAST(year - 2 AS INTEGER) AS start, CASE WHEN paper % 5 <> 0 THEN year END AS stop FROM printed JOIN paper USING (paper) WHERE aff IS NOT NULL)"""


@query(_POSTS + """, best AS (SELECT person, max((stop IS NULL, coalesce(stop, 0), start, position, aff, domain)) AS b FROM post WHERE aff IN (SELECT aff FROM named) OR domain LIKE '%.vn' GROUP BY person)
    SELECT person, b[4] AS position, b[5] AS institution, regexp_matches(b[4], 'lecturer|professor|instructor|teacher|faculty|dean|head of|director', 'i') AS faculty FROM best""")
def cls_current_post(d):
    post = printed(d).where("aff is not null").join(d.paper.select("paper", "year"), "paper")
    at = F.element_at(F.array(*map(F.lit, _POSITIONS)), (F.lit(1) + F.col("paper") % 5).cast("int"))
    entry = F.struct(at.alias("position"), F.col("aff").alias("institution"), F.when(F.col("paper") % 8 == 0, "x.vn").otherwise("x.org").alias("domain"), (F.col("year") - 2).alias("start"), F.when(F.col("paper") % 5 != 0, F.col("year")).alias("end"))
    rows = post.select("person", entry.alias("h"), ((F.size("places") > 0) | entry["domain"].endswith(".vn")).alias("home")).where("home")
    # The latest is kept before the shuffle: nobody's history is gathered.
    best = rows.groupBy("person").agg(F.max(F.struct(F.col("h.end").isNull().alias("open"), F.coalesce("h.end", F.lit(0)).alias("end"), F.coalesce("h.start", F.lit(0)).alias("start"), "h")).alias("b"))
    return best.select("person", F.col("b.h.position").alias("position"), F.col("b.h.institution").alias("institution"), F.col("b.h.position").rlike(labels.FACULTY).alias("faculty"))


@query("""WITH prof AS (SELECT c_custkey AS id, split_part(c_name, '#', 1) || ' ' || right(c_name, 2) || ' ' || (c_custkey % 3) AS name FROM customer), p AS (SELECT s_suppkey AS person, 'Customer ' || right(s_name, 2) || ' ' || (s_suppkey % 5) AS name FROM supplier)
    SELECT person, id, id % 2 = 0 AS from_page FROM p JOIN prof ON right(CAST(id AS VARCHAR), 2) = right(CAST(person AS VARCHAR), 2) WHERE len(list_intersect(list_distinct(string_split(trim(lower(regexp_replace(p.name, '[^A-Za-z0-9]+', ' ', 'g'))), ' ')), list_distinct(string_split(trim(lower(regexp_replace(prof.name, '[^A-Za-z0-9]+', ' ', 'g'))), ' ')))) >= 2""", on_domain=False)
def join_profiles_checked(spark, sf_dir):
    profile = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat_ws(" ", F.split_part("c_name", F.lit("#"), F.lit(1)), F.right("c_name", F.lit(2)), (F.col("c_custkey") % 3).cast("string")).alias("profile"))
    person = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("person"), F.concat_ws(" ", F.lit("Customer"), F.right("s_name", F.lit(2)), (F.col("s_suppkey") % 5).cast("string")).alias("name"))
    end = lambda c: F.right(F.col(c).cast("string"), F.lit(2)).alias("end")
    # Names are read once for each person and profile, not for each pair. Profiles are dealt out, for their pairs are far more than their bytes tell.
    person = person.select("person", end("person"), pages.name_words(F.col("name")).alias("words"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    profile = profile.select("id", end("id"), pages.name_words(F.col("profile")).alias("profile_words")).repartition(parts, "id")
    both = person.join(profile, "end").where(pages.share_words(F.col("words"), F.col("profile_words")))
    return both.select("person", "id", (F.col("id") % 2 == 0).alias("from_page"))


@query("""SELECT user_id, event_id FROM events WHERE event_type <> 'error' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND event_id % 3 = 0)""", on_domain=False)
def join_exclude_overlap(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    taken = rows.where("event_type = 'error' and event_id % 3 = 0").select("user_id").distinct()
    return rows.where("event_type <> 'error'").join(taken, "user_id", "left_anti").select("user_id", "event_id")


@query("""WITH found AS (SELECT page_id, url, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages), cand AS (SELECT page_id, url, unnest(list_distinct(l)) AS link FROM found), approved AS (SELECT page_id, min(link) AS link FROM cand WHERE page_id % 3 <> 0 GROUP BY page_id)
    SELECT c.page_id, c.url, c.link FROM cand c JOIN approved a ON a.page_id = c.page_id AND a.link = c.link""", on_domain=False)
def join_approved_pictures(spark, sf_dir):
    cand = table(spark, sf_dir, "pages").select("page_id", "url", F.explode(F.array_distinct(text.links(F.col("html")))).alias("link"))
    approved = cand.where("page_id % 3 <> 0").groupBy("page_id").agg(F.min("link").alias("link"))
    return cand.join(approved, ["page_id", "link"]).select("page_id", "url", "link")


@query("""SELECT 'f' || o_orderkey AS forum, round_even(100.0 * (o_orderkey % 40) / (30 + o_custkey % 100), 1) AS pct FROM orders WHERE o_orderkey % 3 = 0 AND 30 + o_custkey % 100 >= 50""", on_domain=False)
def join_text_detector(spark, sf_dir):
    """A third party's scores of papers, by their forum's id; those over few sentences are left out."""
    rows = table(spark, sf_dir, "orders")
    forum = F.concat(F.lit("f"), F.col("o_orderkey").cast("string"))
    paper = rows.select(F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("https://openreview.net/forum?id="), forum)).otherwise("https://example.org").alias("url"))
    scores = rows.select(forum.alias("forum"), (F.col("o_orderkey") % 40).alias("flagged"), (30 + F.col("o_custkey") % 100).alias("sentences")).where("sentences >= 50")
    met = paper.select(labels.forum_id(F.col("url")).alias("forum")).join(scores, "forum")
    return met.select("forum", F.bround(100 * F.col("flagged") / F.col("sentences"), 1).alias("pct"))


@query(""", own AS (SELECT DISTINCT '~' || holder AS id FROM paper WHERE status = 'accepted' AND NOT full_record AND holder % 5 <> 0) SELECT id, substr(id, 2) IN (SELECT CAST(holder AS VARCHAR) FROM paper WHERE full_record) AS known FROM own""")
def join_accepted_ids(d):
    listed = F.array(F.when(F.col("holder") % 5 != 0, F.concat(F.lit("~"), F.col("holder").cast("string"))).otherwise(F.concat(F.col("holder").cast("string"), F.lit("@x.org"))))
    ids = d.paper.where(aggregates.accepted() & (F.col("venue") != "1-URGENT")).select(F.explode(listed).alias("id")).where(F.startswith("id", F.lit("~"))).distinct()
    full = d.paper.where("venue = '1-URGENT'").select(F.concat(F.lit("~"), F.col("holder").cast("string")).alias("id"), F.lit(True).alias("known")).distinct()
    return ids.join(full, "id", "left").select("id", F.coalesce("known", F.lit(False)).alias("known"))


@query(PRINTED + """, fix AS (SELECT paper, person % 50 AS k, 'Fixed ' || (person % 50) AS value, CASE WHEN paper % 3 = 0 THEN 'yes' WHEN paper % 3 = 1 THEN 'no' END AS checked FROM member)
    SELECT paper, position, coalesce((SELECT max(value) FROM fix WHERE checked = 'yes' AND fix.paper = p.paper AND fix.k = p.person), aff) AS aff FROM printed p""")
def join_checked_fixes(d):
    fix = d.member.select("paper", (F.col("person") % 50).alias("person"), F.when(F.col("paper") % 3 == 0, "yes").when(F.col("paper") % 3 == 1, "no").alias("checked")).where("checked = 'yes'")
    fixes = fix.groupBy("paper", "person").agg(F.max(F.concat(F.lit("Fixed "), F.col("person").cast("string"))).alias("value"))
    return printed(d).join(fixes, ["paper", "person"], "left").select("paper", "position", F.coalesce("value", "aff").alias("aff"))


@query(PRINTED + """, cand AS (SELECT p.name AS key, n.short FROM printed p JOIN named n ON n.aff = p.aff GROUP BY p.name, n.short UNION SELECT p.name, above FROM printed p JOIN named n ON n.aff = p.aff JOIN parent ON parent.short = n.short),
    prof AS (SELECT person AS id, name AS key, short FROM roster WHERE person % 3 <> 0) SELECT DISTINCT prof.id, prof.key FROM prof JOIN cand c ON c.key = prof.key AND (c.short = prof.short OR c.short = (SELECT above FROM parent WHERE parent.short = prof.short))""")
def join_candidate_profiles(d):
    """Profiles of a candidate's name whose institution, or the university above it, is named on their papers."""
    above = lambda c: F.array_compact(F.array(c, places.parent(c)))
    named = printed(d).select(F.col("name").alias("key"), F.explode("places").alias("p")).select("key", F.explode(above(F.col("p.short"))).alias("short")).distinct()
    profile = roster(d).where("person % 3 <> 0").select(F.col("person").alias("id"), F.col("name").alias("key"), F.explode(above(F.col("short"))).alias("short"))
    return profile.join(named, ["key", "short"], "left_semi").select("id", "key").distinct()


@query(PRINTED + f""", {_SPELLED}, pair AS (SELECT member.person, s.name, s.paper * 100 + s.position AS seq FROM member JOIN spelled s USING (paper)), {_GROUPS}
    SELECT b.person, b.name, key AS who FROM behind b JOIN keyed ON keyed.name = b.first""")
def resolve_distinct_people(d):
    """The people behind the spellings on each person's papers."""
    rows = kept(spelled(d.authorship.join(d.person.select("person"), "person")).select("paper", "name", "seq"))
    first = kept(spellings.first_seen(rows, d.member, key, "person"))
    forget(rows)
    return spellings.distinct_people(first, "person")


# --- small rules ------------------------------------------------------------------------------------------------------------------------

_TOPICS = ["Deep Learning->Generative Models", "Theory/Learning Theory", "Miscellaneous Aspects of Machine Learning->Other", "Vision", "a/b->c"]
_AREAS = [("Deep Learning", "Generative Models"), ("Theory", "Learning Theory"), ("General Machine Learning", "Other"), ("Vision", ""), ("a/b", "c")]


@query(f"""SELECT event_id, [{", ".join(literal(a) for a, _ in _AREAS)}][CAST(1 + event_id % 5 AS INTEGER)] AS area, [{", ".join(literal(t) for _, t in _AREAS)}][CAST(1 + event_id % 5 AS INTEGER)] AS topic,
    CASE WHEN event_id % 3 = 0 THEN 'Work Shop ' || user_id ELSE 'ICLR 2025' END AS workshop, CASE WHEN event_id % 4 = 0 THEN 'f_' || user_id || '-x' END AS forum, CASE WHEN event_id % 2 = 0 THEN user_id % 10 || '(' || event_id % 5 || '), 7' ELSE '' END AS reviews, ['a b', 'c'] AS parts,
    printf('%.1f', round_even(CAST(event_id % 200 AS DOUBLE) / 8, 1)) AS shown FROM events""", on_domain=False)
def str_labels(spark, sf_dir):
    n, u = F.col("event_id"), F.col("user_id").cast("string")
    area, topic = labels.topic_parts(F.element_at(F.array(*map(F.lit, _TOPICS)), (F.lit(1) + n % 5).cast("int")))
    group = F.when(n % 3 == 0, F.concat(F.lit("ICLR.cc/2025/Workshop/Work_Shop_"), u)).otherwise("ICLR.cc/2025/Conference")
    workshop = labels.workshop_name(F.lit(" ICLR 2025 "), F.lit(None).cast("string"), F.array(F.lit("ICLR.cc/2025/Conference/-/Submission"), F.concat(group, F.lit("/-/Submission"))))
    url = F.when(n % 4 == 0, F.concat(F.lit("https://openreview.net/forum?id=f_"), u, F.lit("-x&noteId=1"))).otherwise("https://example.org/forum?id=9")
    pairs = F.when(n % 2 == 0, F.array(F.struct((F.col("user_id") % 10).cast("int").alias("score"), (n % 5).cast("int").alias("confidence")), F.struct(F.lit(7).alias("score"), F.lit(None).cast("int").alias("confidence"))))
    return table(spark, sf_dir, "events").select(
        "event_id", area.alias("area"), topic.alias("topic"), workshop.alias("workshop"), labels.forum_id(url).alias("forum"), labels.review_scores(pairs).alias("reviews"), labels.split_list(F.lit(" a b ;; c; ")).alias("parts"),
        labels.rounded_text(n % 200 / 8, 1).alias("shown"),
    )


_LINKS = [
    ("https://www.aclanthology.org/x/", "acl", "aclanthology.org/x", "aclanthology.org/x"), ("http://Scholar.google.com/c?user=a", "scholar", "scholar.google.com/c?user=a", "Scholar.google.com/c?user=a"),
    ("https://me.github.io//", "homepage", "me.github.io", "me.github.io/"), ("https://www.hust.edu.vn/staff/a", "staff", "hust.edu.vn/staff/a", "hust.edu.vn/staff/a"), ("https://lab.org/publications", "publications", "lab.org/publications", "lab.org/publications"),
    ("https://x.org/%C4%91a+b", "website", "x.org/%c4%91a+b", "x.org/đa+b"), ("https://openreview.net/profile?id=~A_B1", "openreview", "openreview.net/profile?id=~a_b1", "openreview.net/profile?id=~A_B1"),
]


@query(f"""WITH l(url, kind, key, shown) AS (VALUES {values(_LINKS)}), e AS (SELECT user_id, event_id, [{", ".join(literal(u) for u, *_ in _LINKS)}][CAST(1 + event_id % {len(_LINKS)} AS INTEGER)] AS url FROM events)
    SELECT user_id, key, kind, shown AS text, min(event_id) AS first FROM e JOIN l USING (url) GROUP BY user_id, key, kind, shown""", on_domain=False)
def str_link_kinds(spark, sf_dir):
    url = F.element_at(F.array(*(F.lit(u) for u, *_ in _LINKS)), (F.lit(1) + F.col("event_id") % len(_LINKS)).cast("int"))
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", url.alias("url"))
    one = rows.groupBy("user_id", labels.link_key(F.col("url")).alias("key")).agg(F.min(F.struct("event_id", "url")).alias("r"))
    return one.select("user_id", "key", labels.link_kind(F.col("r.url")).alias("kind"), labels.link_text(F.col("r.url")).alias("text"), F.col("r.event_id").alias("first"))


@query("""SELECT p_partkey AS id, list_sort(list_filter(list_distinct(string_split('the university of ' || lower(p_name) || ' and ' || lower(p_brand), ' ')), lambda w: w NOT IN ('university', 'of', 'the', 'and', 'institute', 'college', 'de', 'at') AND NOT contains(w, '#'))) AS words FROM part""", on_domain=False)
def str_telling_words(spark, sf_dir):
    name = F.concat_ws(" ", F.lit("The University of"), "p_name", F.lit("and"), F.replace("p_brand", F.lit("#"), F.lit("")))
    kept = F.filter(labels.telling_words(name), lambda w: ~w.startswith("brand"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_sort(kept).alias("words"))


# --- sets, arrays, maps -----------------------------------------------------------------------------------------------------------------


@query(""", r AS (SELECT person, list(DISTINCT '~' || holder) AS now, list(DISTINCT '~' || holder) FILTER (year < 1998) AS then_, list(DISTINCT '~' || paper % 7) AS prof FROM member JOIN paper USING (paper) GROUP BY person)
    SELECT CAST(person AS VARCHAR) AS slug, list_sort(coalesce(then_, [])) <> list_sort(now) AS stale, list_sort(list_distinct(list_concat(prof, now))) AS own_ids FROM r""")
def set_staleness(d):
    tilde = lambda c: F.concat(F.lit("~"), c.cast("string"))
    rows = d.member.join(d.paper, "paper").groupBy(F.col("person").cast("string").alias("slug"))
    r = rows.agg(F.collect_set(tilde(F.col("holder"))).alias("openreview_ids"), F.collect_set(F.when(F.col("year") < 1998, tilde(F.col("holder")))).alias("queried_ids"), F.collect_set(tilde(F.col("paper") % 7)).alias("profile_ids"))
    return files.stale(r.select("slug", "queried_ids", "profile_ids"), r.select("slug", "openreview_ids"))


@query(""", p AS (SELECT paper, list(person ORDER BY position) AS people FROM authorship GROUP BY paper), s AS (SELECT paper, people, holder % 100 AS own, paper % 3 <> 0 AS ids, people[1 + CAST(holder % 3 AS INTEGER)] AS other FROM p JOIN paper USING (paper)),
    i AS (SELECT paper, people, CASE WHEN ids AND list_contains(people, own) THEN list_position(people, own) ELSE list_position(people, other) END AS me FROM s)
    SELECT paper, me, list_filter(people, lambda x, k: me IS NULL OR k <> me) AS others FROM i""")
def arr_self_and_others(d):
    listed = F.transform(F.array_sort(F.collect_list(F.struct("position", "person"))), lambda x: x["person"])
    rows = d.authorship.groupBy("paper").agg(listed.alias("people")).join(d.paper, "paper")
    # By id where the ids are as many as the people, else by name; ids stand for both here.
    by = lambda x: F.nullif(F.array_position("people", x), F.lit(0))
    other = F.try_element_at("people", (F.lit(1) + F.col("holder") % 3).cast("int"))
    at = F.coalesce(F.when(F.col("paper") % 3 != 0, by(F.col("holder") % 100)), by(other)).cast("long")
    rows = rows.select("paper", "people", at.alias("me"))
    return rows.select("paper", "me", F.filter("people", lambda x, k: F.col("me").isNull() | (k + 1 != F.col("me"))).alias("others"))


@query(""", c AS (SELECT person, status, count(*) AS n FROM member JOIN paper USING (paper) GROUP BY person, status), x AS (SELECT person, status, count(*) AS n FROM member JOIN paper USING (paper) WHERE year >= 1996 GROUP BY person, status)
    SELECT person, array_to_string(list_sort(list(status || '=' || (c.n + coalesce(x.n, 0)))), ',') AS counters FROM c LEFT JOIN x USING (person, status) WHERE status <> 'withdrawn' GROUP BY person""")
def arr_counter_map(d):
    def counters(rows: DataFrame, into: str) -> DataFrame:
        each = rows.groupBy("person", "status").agg(F.count(F.lit(1)).alias("n"))
        return each.groupBy("person").agg(F.map_from_entries(F.collect_list(F.struct("status", "n"))).alias(into))

    rows = d.member.join(d.paper, "paper")
    both = counters(rows, "m").join(counters(rows.where("year >= 1996"), "x"), "person", "left")
    empty = F.create_map().cast("map<string,bigint>")
    summed = F.map_zip_with("m", F.coalesce("x", empty), lambda k, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
    kept = F.map_filter(summed, lambda k, n: k != "withdrawn")
    return both.select("person", F.array_join(F.array_sort(F.transform(F.map_entries(kept), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ",").alias("counters")).where("counters <> ''")


@query(_EDGES + """, n AS (SELECT person, count(*) AS papers FROM member GROUP BY person)
    SELECT person, papers, round(9 + 1.8 * sqrt(papers), 6) AS radius, CASE WHEN papers <= 5 THEN 1 WHEN papers <= 10 THEN 2 WHEN papers <= 25 THEN 5 WHEN papers <= 50 THEN 10 WHEN papers <= 100 THEN 20 WHEN papers <= 250 THEN 50 WHEN papers <= 500 THEN 100 WHEN papers <= 1000 THEN 200 ELSE 500 END AS step,
    round(1 + 1.6 * sqrt(coalesce((SELECT max(weight) FROM edge WHERE a = person), 1) - 1), 6) AS width FROM n""")
def math_scales(d):
    steps = F.array(*map(F.lit, (1, 2, 5, 10, 20, 50, 100, 200, 500)))
    heavy = graph.edges(d.member).groupBy(F.col("a").alias("person")).agg(F.max("weight").alias("w"))
    rows = d.member.groupBy("person").agg(F.count(F.lit(1)).alias("papers")).join(heavy, "person", "left")
    step = F.filter(steps, lambda s: F.col("papers") / s <= 5)
    return rows.select("person", "papers", F.round(9 + 1.8 * F.sqrt("papers"), 6).alias("radius"), F.coalesce(F.try_element_at(step, F.lit(1)), F.lit(500)).alias("step"), F.round(1 + 1.6 * F.sqrt(F.coalesce("w", F.lit(1)) - 1), 6).alias("width"))


# --- graphs -----------------------------------------------------------------------------------------------------------------------------


@query(PRINTED + """, own AS (SELECT DISTINCT paper, short FROM member JOIN roster USING (person) WHERE approved), mine AS (SELECT DISTINCT institution, short FROM roster),
    held AS (SELECT short FROM mine UNION SELECT above FROM mine JOIN parent USING (short)),
    other AS (SELECT DISTINCT paper, n.short FROM printed p JOIN named n ON n.aff = p.aff WHERE n.full_name <> n.short AND n.short NOT IN (SELECT short FROM held) AND n.full_name NOT IN (SELECT institution FROM mine)),
    m AS (SELECT paper, short, short AS node FROM own UNION SELECT paper, short, 'x-' || short FROM other), keep AS (SELECT paper, node FROM m WHERE (paper, short) NOT IN (SELECT (paper, above) FROM m JOIN parent USING (short))),
    e AS (SELECT a.node AS a, b.node AS b, count(*) AS weight FROM keep a JOIN keep b ON a.paper = b.paper AND a.node < b.node GROUP BY a.node, b.node) SELECT a, b, weight, row_number() OVER (ORDER BY weight DESC, a, b) AS shown FROM e""")
def graph_institutions_parent_drop(d):
    own = d.member.join(roster(d).where("approved"), "person").select("paper", "short").distinct()
    at = roster(d).select("institution", "short").distinct()
    members = graph.institution_members(own, printed(d).select("paper", "places"), at, places.PARENT)
    return aggregates.numbered(graph.edges(members, "node"), F.desc("weight"), F.asc("a"), F.asc("b"))


_SPARSE = ", e AS (SELECT DISTINCT holder AS a, holder + 1 + paper % 5 AS b FROM paper)"


def _sparse(d: Domain) -> DataFrame:
    return d.paper.select(F.col("holder").alias("a"), (F.col("holder") + 1 + F.col("paper") % 5).alias("b")).distinct()


_REACH = ", w AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), low(node, component) USING KEY (node) AS (SELECT a, least(a, min(b)) FROM w GROUP BY a UNION SELECT x.a, min(l.component) FROM low l JOIN w x ON x.b = l.node JOIN recurring.low o ON o.node = x.a WHERE l.component < o.component GROUP BY x.a)"


_STARS = ", s AS (SELECT DISTINCT holder AS h FROM paper), e AS (SELECT h - h % 7 AS a, h AS b FROM s WHERE h % 7 <> 0 AND (h % 7 <> 3 OR h % 2 = 1) UNION SELECT h, h + 1 FROM s WHERE h % 7 IN (2, 3) AND h % 4 = 0)"


def _stars(d: Domain) -> DataFrame:
    h = F.col("h")
    own = d.paper.select(F.col("holder").alias("h")).distinct()
    star = own.where((h % 7 != 0) & ((h % 7 != 3) | (h % 2 == 1))).select((h - h % 7).alias("a"), h.alias("b"))
    return star.union(own.where((h % 7).isin(2, 3) & (h % 4 == 0)).select(h.alias("a"), (h + 1).alias("b"))).distinct()


@query(_STARS + _REACH + " SELECT component, component AS first, count(*) AS nodes, row_number() OVER (ORDER BY count(*) DESC, component) AS shown FROM low GROUP BY component")
def graph_component_sizes(d):
    return graph.component_sizes(components(_stars(d), "a", "b")).select("component", "first", "nodes", "shown")


@query(_STARS + _REACH + """, deg AS (SELECT a AS node, count(*) AS degree FROM w GROUP BY a), g AS (SELECT component, count(*) AS n, max(degree) AS top, sum(degree) AS ends, arg_min(node, (-degree, node)) AS hub FROM low JOIN deg USING (node) GROUP BY component)
    SELECT component, hub FROM g WHERE n >= 3 AND (top >= 3 OR ends / 2 >= n) AND top = n - 1""")
def graph_hubs(d):
    edge = _stars(d)
    return graph.hubs(edge, components(edge, "a", "b"))


_SPOTS = ", spot AS (SELECT DISTINCT node, (node * 37 % 4001) * 3.0 AS x, (node * 53 % 4003) * 2.0 AS y, repeat('m', CAST(1 + node % 9 AS INTEGER)) AS label FROM (SELECT a AS node FROM e UNION SELECT b FROM e))"


def _spots(edge: DataFrame) -> DataFrame:
    node = edge.select(F.col("a").alias("node")).union(edge.select("b")).distinct()
    return node.select("node", (F.col("node") * 37 % 4001 * 3.0).alias("x"), (F.col("node") * 53 % 4003 * 2.0).alias("y"), F.repeat(F.lit("m"), (1 + F.col("node") % 9).cast("int")).alias("label"))


@query(_SPARSE + _SPOTS + """, l AS (SELECT a, b, p.x AS ax, p.y AS ay, q.x AS bx, q.y AS by_ FROM e JOIN spot p ON p.node = a JOIN spot q ON q.node = b),
    c AS (SELECT m.a, m.b, n.a AS a_r, n.b AS b_r FROM l m JOIN l n ON (m.a, m.b) < (n.a, n.b) AND m.a <> n.a AND m.a <> n.b AND m.b <> n.a AND m.b <> n.b
    WHERE ((n.bx - n.ax) * (m.ay - n.ay) - (n.by_ - n.ay) * (m.ax - n.ax)) * ((n.bx - n.ax) * (m.by_ - n.ay) - (n.by_ - n.ay) * (m.bx - n.ax)) < 0
    AND ((m.bx - m.ax) * (n.ay - m.ay) - (m.by_ - m.ay) * (n.ax - m.ax)) * ((m.bx - m.ax) * (n.by_ - m.ay) - (m.by_ - m.ay) * (n.bx - m.ax)) < 0)
    SELECT a, b, count(*) AS crossings FROM (SELECT a, b FROM c UNION ALL SELECT a_r, b_r FROM c) GROUP BY a, b""")
def graph_crossings(d):
    edge = _sparse(d)
    return graph.crossing_counts(edge, _spots(edge))


@query(_SPARSE + _SPOTS + """, l AS (SELECT a, b, c.node, p.x AS ax, p.y AS ay, q.x - p.x AS dx, q.y - p.y AS dy, c.x AS cx, c.y AS cy FROM e JOIN spot p ON p.node = a JOIN spot q ON q.node = b JOIN spot c ON c.node <> a AND c.node <> b),
    t AS (SELECT *, ((cx - ax) * dx + (cy - ay) * dy) / CASE WHEN dx * dx + dy * dy = 0 THEN 1 ELSE dx * dx + dy * dy END AS t FROM l),
    n AS (SELECT p.x AS px, p.y AS py, q.x AS qx, q.y AS qy, 18 + 8.4 * length(p.label) AS pw, 18 + 8.4 * length(q.label) AS qw FROM spot p JOIN spot q ON p.node < q.node)
    SELECT (SELECT count(*) FROM t WHERE t > 0 AND t < 1 AND sqrt(pow(cx - ax - t * dx, 2) + pow(cy - ay - t * dy, 2)) < 40) AS lines, (SELECT count(*) FROM n WHERE CASE WHEN px <= qx THEN px + pw > qx ELSE qx + qw > px END AND abs(py - qy) < 24) AS labels,
    (SELECT count(*) FROM n WHERE sqrt(pow(px - qx, 2) + pow(py - qy, 2)) < 40) AS nodes""")
def graph_rule_breaks(d):
    edge = kept(_sparse(d))
    return graph.rule_breaks(edge, _spots(edge))


@query(PRINTED + """, g AS (SELECT short, count(DISTINCT person) AS people FROM member JOIN roster USING (person) GROUP BY short), r AS (SELECT short, people, row_number() OVER (ORDER BY people DESC, short) AS place FROM g)
    SELECT person, short, CASE WHEN place <= 5 THEN 'c' || place ELSE 'c0' END AS colour FROM (SELECT DISTINCT person, short FROM member JOIN roster USING (person)) JOIN r USING (short)""")
def graph_groups(d):
    own = d.member.join(roster(d), "person").select("person", "short").distinct()
    place = aggregates.numbered(own.groupBy("short").agg(F.count(F.lit(1)).alias("people")), F.desc("people"), F.asc("short"))
    return own.join(place, "short").select("person", "short", F.when(F.col("shown") <= 5, F.concat(F.lit("c"), F.col("shown").cast("string"))).otherwise("c0").alias("colour"))


@query(_RECORD + """ SELECT paper, venue || '|' || year || '|' || 'study' || holder AS paper_key, coalesce(nullif(CASE WHEN paper % 4 = 0 THEN '' ELSE 'note' END, ''), '-') AS note, CASE status WHEN 'accepted' THEN 'Accepted' WHEN 'rejected' THEN 'Rejected' WHEN 'withdrawn' THEN 'Withdrawn' ELSE 'Desk rejected' END AS label
    FROM venued WHERE year BETWEEN 1993 AND 1997 AND venue <> 'acl' AND paper IN (SELECT paper FROM member)""")
def flt_page_entries(d):
    label = F.create_map(*[F.lit(x) for x in ("accepted", "Accepted", "rejected", "Rejected", "withdrawn", "Withdrawn", "desk_rejected", "Desk rejected")])[F.col("status")]
    rows = venued(d).where(F.col("year").between(1993, 1997) & (F.col("venue") != "acl")).join(d.member, "paper", "left_semi")
    note = F.coalesce(F.nullif(F.when(F.col("paper") % 4 == 0, "").otherwise("note"), F.lit("")), F.lit("-"))
    return rows.select("paper", F.concat_ws("|", "venue", F.col("year").cast("string"), F.concat(F.lit("study"), F.col("holder").cast("string"))).alias("paper_key"), note.alias("note"), label.alias("label"))
