"""Queries on landed files: each builds files of a source's shape from the rows of a table, reads them as that source's reader does, and is compared with SQL on the table.

Round trips write to the shared folder and read back what they wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papertide.functions import classify, labels, manuscript
from papertide.functions.runtime import shared_folder, spread, table
from papertide.plans.printed import HOMES, literal
from papertide.plans.registry import query
from papertide.sources import files, landed_files, listings, pages


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and name of each customer, spread, as reading a page takes far longer than the bytes that it is made from tell."""
    return spread(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), "id")


def _file(rows: DataFrame, venue: str, form: str, year: int = 2024) -> DataFrame:
    """venue, year and body of a file for each row: `form` with {id} and {name} filled in."""
    body = F.replace(F.replace(F.lit(form), F.lit("{id}"), F.col("id").cast("string")), F.lit("{name}"), F.col("name"))
    return rows.select(F.lit(venue).alias("venue"), F.lit(year).alias("year"), body.alias("body"))


def _names(column: str = "authors") -> Column:
    return F.array_join(F.transform(column, lambda a: F.concat(a["name"], F.lit("@"), F.coalesce(a["aff"], F.lit("")))), "; ")


def _papers(rows: DataFrame) -> DataFrame:
    return rows.select("venue", "year", "track", "title", _names().alias("authors"), "url", "pdf", "forum", "pres", "source")


_PAPER_SQL = "SELECT {venue} AS venue, CAST(2024 AS INTEGER) AS year, {track} AS track, {title} AS title, {authors} AS authors, {url} AS url, {pdf} AS pdf, {forum} AS forum, {pres} AS pres, {source} AS source FROM {rows}"


def paper_sql(**values: str) -> str:
    absent = {"track": "'main'", "pdf": "CAST(NULL AS VARCHAR)", "forum": "CAST(NULL AS VARCHAR)", "pres": "CAST(NULL AS VARCHAR)", "rows": "customer"}
    return _PAPER_SQL.format(**(absent | values))


# --- accepted-paper lists ---------------------------------------------------------------------------------------------------------------

_LISTED = """{"results": [{"name": "On {name} &amp; B", "authors": [{"fullname": "X &lt;Y", "institution": ""}], "decision": "Accept (poster)", "sourceurl": "https://openreview.net/group?id=NeurIPS.cc/2024/Conference", "event_type": "Poster", "paper_url": "https://openreview.net/forum?id=f{id}"},
 {"name": "On {name} &amp; B", "authors": [{"fullname": "X &lt;Y", "institution": "Some School"}, {"fullname": " "}], "decision": "Accept (oral)", "sourceurl": "https://openreview.net/group?id=NeurIPS.cc/2024/Conference", "event_type": "Oral", "paper_url": ""},
 {"name": "Data {id}", "authors": [{"fullname": "Z", "institution": "Lab"}], "sourceurl": "https://openreview.net/group?id=NeurIPS.cc/2024/Datasets_and_Benchmarks_Track", "event_type": "Poster", "virtualsite_url": "/p/{id}"}, {"name": "", "authors": []}]}"""


@query(paper_sql(venue="'neurips'", title="'On ' || c_name || ' & B'", authors="'X <Y@Some School'", url="'https://openreview.net/forum?id=f' || c_custkey", forum="'f' || c_custkey", pres="'oral'", source="'neurips.cc'")
       + " UNION ALL " + paper_sql(venue="'neurips'", track="'datasets_benchmarks'", title="'Data ' || c_custkey", authors="'Z@Lab'", url="'https://neurips.cc/p/' || c_custkey", source="'neurips.cc'"), on_domain=False)
def src_virtual_listing(spark, sf_dir):
    return _papers(listings.virtual_listing(_file(_customers(spark, sf_dir), "neurips", _LISTED), "https://neurips.cc"))


@query(paper_sql(venue="'cvpr'", title="'On ' || c_name || ' & B'", authors="'Giv Fam@; É Two@'", url="'https://openaccess.thecvf.com/content/' || c_custkey || '.html'", source="'openaccess.thecvf.com'"), on_domain=False)
def src_cvf_pages(spark, sf_dir):
    form = 'x<dt class="ptitle"><br><a href="/content/{id}.html">On  {name}\n &amp; B</a></dt><dd><input name="query_author" value="Giv Fam"><input name="query_author" value=" "><input name="query_author" value="&Eacute; Two"></dd><dt class="ptitle">none</dt>'
    return _papers(listings.cvf_pages(_file(_customers(spark, sf_dir), "cvpr", form)))


@query(paper_sql(venue="'eccv'", title="c_name", authors="'A B@; C D@'", url="'https://www.ecva.net/p' || c_custkey || '.php'", source="'ecva.net'"), on_domain=False)
def src_ecva_pages(spark, sf_dir):
    form = "ECCV 2026 Papers <dt class=\"ptitle\"><a href='q.php'>Other</a></dt><dd> X Y</dd>ECCV 2024 Papers <dt class=\"ptitle\"><a href='p{id}.php'> {name}</a></dt><dd> A B*, C D</dd>ECCV 2022 Papers <dt class=\"ptitle\"><a href='r.php'>Old</a></dt><dd> X Y</dd>"
    return _papers(listings.ecva_pages(_file(_customers(spark, sf_dir), "eccv", form)))


_ARTICLE = '<div class="obj_article_summary"><h3 class="title"> <a id="q" href="u{id}">%s {name}</a></h3><div class="authors"> A B, C D </div><ul><a class="obj_galley_link pdf" href="h/article/view/{id}">x</a></ul></div>'


@query(paper_sql(venue="'aaai'", title="'T ' || c_name", authors="'A B@; C D@'", url="'u' || c_custkey", pdf="'h/article/download/' || c_custkey", source="'ojs.aaai.org'") + " UNION ALL "
       + paper_sql(venue="'aaai'", track="'Special Day'", title="'S ' || c_name", authors="'A B@; C D@'", url="'u' || c_custkey", pdf="'h/article/download/' || c_custkey", source="'ojs.aaai.org'"), on_domain=False)
def src_aaai_pages(spark, sf_dir):
    form = f'<div class="section"><h2>AAAI Technical Track on X</h2>{_ARTICLE % "T"}</div><div class="section"><h2>Special <b>Day</b></h2>{_ARTICLE % "S"}</div>'
    return _papers(listings.aaai_pages(_file(_customers(spark, sf_dir), "aaai", form)))


_IJCAI = '<div id="paper7" class="paper_wrapper"><div class="title">%s {name}</div><div class="authors">A B, C D</div><div class="details"><a href="{id}.pdf">PDF</a><a href="/proceedings/2024/{id}">Details</a></div></div>'
_IJCAI_SQL = {"venue": "'ijcai'", "authors": "'A B@; C D@'", "url": "'https://www.ijcai.org/proceedings/2024/' || c_custkey", "pdf": "'https://www.ijcai.org/proceedings/2024/' || c_custkey || '.pdf'", "source": "'ijcai.org'"}


@query(paper_sql(title="'T ' || c_name", **_IJCAI_SQL) + " UNION ALL " + paper_sql(title="'S ' || c_name", track="'Survey'", **_IJCAI_SQL), on_domain=False)
def src_ijcai_pages(spark, sf_dir):
    form = f'<div class="section_title"><h3>Main Track</h3></div><div class="subsection_title">Vision</div>{_IJCAI % "T"}<div class="section_title"><h3>Survey</h3></div>{_IJCAI % "S"}'
    return _papers(listings.ijcai_pages(_file(_customers(spark, sf_dir), "ijcai", form)))


@query(paper_sql(venue="'acl'", title="'A Title of ' || c_name", authors="'Loïc Fosse@; Hoang Đoàn@'", url="'https://example.org/' || c_custkey || '/'", source="'aclanthology.org'"), on_domain=False)
def src_bibtex(spark, sf_dir):
    form = '@proceedings{p,\n title = "No"\n}\n@inproceedings{a-{id},\n    title = "A {T}itle of {name}",\n    author = {Fosse, Lo{\\"i}c  and\n      {\\DJ}o{\\`a}n, Hoang},\n    month = jul,\n    url = "https://example.org/{id}/"\n}\n'
    return _papers(listings.bibliographies(_file(_customers(spark, sf_dir), "acl", form)))


#: Entries as volumes print them, one of which a paper gets by its number: in braces, in quotes, with bare values and nested braces, on one line with another entry, of another kind, without authors, with fields
#: in capitals, cut off in the middle, and with signs of typesetting. {i} is the paper's number.
ENTRIES = [
    "@inproceedings{p{i},\n  title = {A Title {N}umber {i}},\n  author = {Fosse, Lo{\\\"i}c and\n    {\\DJ}o{\\`a}n, Hoang},\n  url = {https://example.org/{i}/}\n}",
    '@inproceedings{p{i},\n  title = "A Title Number {i}",\n  author = "Ada Lovelace",\n  month = jul,\n  url = "https://example.org/{i}/"\n}',
    "@InProceedings{p{i}, title={Bare {and {nested}} {i}}, year=2024, author={Lovelace, Ada and Bao Q. Tran}}",
    "@inproceedings{p{i}, title={First of a line {i}}, author={A B}} @inproceedings{q{i}, title={Second of a line {i}}, author={C D}}",
    "@article{p{i},\n title = {Of another kind {i}},\n author = {A B}\n}",
    "@inproceedings{p{i},\n title = {Without authors {i}}\n}",
    "@inproceedings{p{i},\n  TITLE = {In capitals {i}},\n  AUTHOR = {Lovelace, Ada},\n}\nText between entries, with an address a@b.org and a {brace}.",
    "@inproceedings{p{i},\n  title = {Cut off {i},\n  author = {A B},",
    "@inproceedings{p{i},\n  title = {100\\% of {\\ss} \\& more {i}},\n  author = {M{\\\"u}ller, J{\\o}rn}\n}",
]
_PRINTED_ENTRIES = [  # shape, title, authors, whether it has an address
    (0, "'A Title Number ' || i", "'Loïc Fosse@; Hoang Đoàn@'", True), (1, "'A Title Number ' || i", "'Ada Lovelace@'", True), (2, "'Bare and nested ' || i", "'Ada Lovelace@; Bao Q. Tran@'", False),
    (3, "'First of a line ' || i", "'A B@'", False), (3, "'Second of a line ' || i", "'C D@'", False), (6, "'In capitals ' || i", "'Ada Lovelace@'", False), (8, "'100% of ß & more ' || i", "'Jørn Müller@'", False),
]


@query(f"WITH o AS (SELECT o_orderkey AS i, o_orderkey % {len(ENTRIES)} AS shape, lower(o_orderpriority[3:]) AS venue, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders) "
       + " UNION ALL ".join(f"SELECT venue, year, {title} AS title, {authors} AS authors, {chr(39) + 'https://example.org/' + chr(39) + ' || i || ' + chr(39) + '/' + chr(39) if url else 'NULL'} AS url FROM o WHERE shape = {shape}" for shape, title, authors, url in _PRINTED_ENTRIES), on_domain=False)
def src_landed_volumes(spark, sf_dir):
    """Volumes of entries of nine shapes, landed as packed files by venue and year, and read a line at a time."""
    i = F.col("o_orderkey")
    form = F.element_at(F.array(*map(F.lit, ENTRIES)), (i % len(ENTRIES) + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select(F.replace(form, F.lit("{i}"), i.cast("string")).alias("value"), F.lower(F.substring("o_orderpriority", 3, 99)).alias("venue"), F.year("o_orderdate").alias("year"))
    path = _folder(spark, "volumes")
    # A volume has so many entries at most: packed files are read whole, so their number must grow, not their length.
    rows.hint("rebalance", "venue", "year").write.partitionBy("venue", "year").option("compression", "gzip").option("maxRecordsPerFile", 20_000).text(path)
    return listings.volumes(landed_files.volume_lines(spark, path, "*.gz")).select("venue", "year", "title", _names().alias("authors"), "url")


@query("SELECT lower(o_orderpriority[3:]) AS venue, CAST(year(o_orderdate) AS INTEGER) AS year, false AS missing, count(*) AS lines, CAST(sum(length(CAST(o_orderkey AS VARCHAR)) + 2) AS BIGINT) AS letters FROM orders GROUP BY ALL", on_domain=False)
def src_landed_files(spark, sf_dir):
    """Whole files, one of each venue and year, whose place and packing their path and first bytes tell."""
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("é"), F.col("o_orderkey").cast("string")).alias("value"), F.lower(F.substring("o_orderpriority", 3, 99)).alias("venue"), F.year("o_orderdate").alias("year"))
    path = _folder(spark, "files")
    rows.repartition("venue", "year").write.partitionBy("venue", "year").option("compression", "gzip").text(path)
    found = landed_files.landed(spark, path, "part-*").withColumn("line", F.explode(F.split(F.rtrim("body", F.lit("\n")), "\n")))
    return found.groupBy("venue", "year", "missing").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.char_length("line") + 1).alias("letters"))


@query("""WITH one AS (SELECT s_suppkey % 7 AS y, count(*) AS n, count(*) FILTER (s_suppkey % 3 = 0) AS l FROM supplier GROUP BY 1)
    SELECT CAST(y AS INTEGER) AS year, CASE WHEN l >= 0.95 * n THEN l ELSE n END AS papers, CASE WHEN l > 0 THEN 1 ELSE 0 END AS workshop FROM one""", on_domain=False)
def src_combined_lists(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 7).cast("int").alias("year"))
    entry = lambda f, track, aff: f.select(
        F.lit("cvpr").alias("venue"), "year", F.lit(track).alias("track"), F.concat(F.lit("T"), F.col("id").cast("string")).alias("title"), F.array(F.struct(F.lit("A").alias("name"), aff.cast("string").alias("aff"))).alias("authors"),
        *(F.lit(None).cast("string").alias(c) for c in ("url", "pdf", "forum", "pres", "topic")), F.lit("s").alias("source"),
    )
    listed = rows.where("id % 3 = 0")
    extra = entry(listed.groupBy("year").agg(F.min("id").alias("id")), "workshop", F.lit(None))
    out = listings.combine_lists(entry(listed, "main", F.lit("here")).union(extra), entry(rows, "main", F.lit(None)))
    main = F.col("track") == "main"
    return out.groupBy("year").agg(F.count(F.when(main, 1)).alias("papers"), F.count(F.when(~main, 1)).cast("int").alias("workshop"))


# --- pages about people -----------------------------------------------------------------------------------------------------------------


@query("""SELECT c_custkey AS id, CAST(k AS INTEGER) AS seq, CASE k WHEN 1 THEN c_name || ' & co, ICLR 2024' ELSE 'A paper (NeurIPS ’25)' END AS line FROM customer CROSS JOIN (VALUES (1), (3)) t(k)""", on_domain=False)
def src_home_lines(spark, sf_dir):
    form = "<script>ICLR 2024</script><h1>Home</h1>\r\n<ul><li>{name}   &amp; co,\n ICLR 2024</li><li>Journal of X 2024</li><li>A <b>paper</b> (NeurIPS ’25)</li></ul>"
    rows = _customers(spark, sf_dir)
    body = F.replace(F.lit(form), F.lit("{name}"), F.col("name"))
    return pages.venue_lines(rows.select("id", body.alias("html")))


_SCHOLAR = (
    '<div id="gsc_prf_in">{name} &amp; Son</div><div class="gsc_prf_il">Some <a href="x">School</a></div><th class="gsc_rsb_sth">Since 2019</th><td class="gsc_rsb_std">{id}</td><td class="gsc_rsb_std">7</td><td class="gsc_rsb_std">5</td>'
    '<span class="gsc_g_t" style="a">2020</span><span class="gsc_g_t">2021</span><span class="gsc_g_t">2022</span><span class="gsc_g_t">2023</span>'
    '<a href="#" class="gsc_g_a" style="left:1;z-index:4"><span class="gsc_g_al">3</span></a><a href="#" class="gsc_g_a" style="left:1;z-index:1"><span class="gsc_g_al">{id}</span></a>'
)


@query("""SELECT c_custkey AS id, c_name || ' & Son' AS name, 'Some School' AS affiliation, CAST(c_custkey AS INTEGER) AS citations, 7 AS citations_since, 5 AS h_index, 0 AS i10_index_since, 2019 AS since, '2020=3,2021=0,2022=0,2023=' || c_custkey AS by_year, 'abc_DEF-1234' AS scholar_id FROM customer""", on_domain=False)
def src_scholar_profile(spark, sf_dir):
    body = F.replace(F.replace(F.lit(_SCHOLAR), F.lit("{id}"), F.col("id").cast("string")), F.lit("{name}"), F.col("name"))
    rows = _customers(spark, sf_dir).select("id", pages.scholar_profile(body).alias("p"))
    years = F.array_join(F.transform("p.by_year", lambda y: F.concat(y["year"].cast("string"), F.lit("="), y["n"].cast("string"))), ",")
    link = pages.scholar_id(F.lit('<a href="https://scholar.google.de/citations?hl=en&amp;user=abc_DEF-1234&x">'))
    return rows.select("id", "p.name", "p.affiliation", "p.citations", "p.citations_since", "p.h_index", "p.i10_index_since", "p.since", years.alias("by_year"), link.alias("scholar_id"))


@query("""SELECT c_custkey AS id, image, alt, how FROM customer, LATERAL (VALUES ('https://h.org/img/' || c_custkey || '.png', '', 'preview image'), ('https://h.org/d/me.jpg', 'Me', 'img'), ('https://cdn.org/a/photo.png', '', 'img')) t(image, alt, how)""", on_domain=False)
def src_page_images(spark, sf_dir):
    form = '<meta property="og:image" content="/img/{id}.png"><img src="logo.png" alt="x"><img class="a" src="me.jpg" alt=\'Me\'><img data-src="//cdn.org/a/photo.png"><img src="data:image/png;base64,x"><img src="other.jpg" alt="tree"><img src="./me.jpg" alt="Again">'
    rows = _customers(spark, sf_dir)
    page = rows.select("id", F.lit("ada love").alias("names"), F.lit("https://h.org/d/index.html?a/b").alias("url"), F.replace(F.lit(form), F.lit("{id}"), F.col("id").cast("string")).alias("html"))
    return pages.portraits(pages.images(page), "names").select("id", "image", "alt", "how")


@query("""WITH r AS (SELECT user_id % 500 AS forum, event_id AS seq, event_id % 10 AS score, event_id % 5 AS confidence, event_id % 4 AS kind FROM events WHERE event_id % 4 <> 3)
    SELECT 'f' || forum AS forum, string_agg(score || CASE WHEN kind = 2 THEN '' ELSE '(' || confidence || ')' END, ', ' ORDER BY seq) AS reviews FROM r GROUP BY forum""", on_domain=False)
def src_reviews(spark, sf_dir):
    n, score = F.col("event_id"), (F.col("event_id") % 10).cast("string")
    bare = F.concat(F.lit('{"rating": "'), score, F.lit(': good", "confidence": {"value": '), (n % 5).cast("string"), F.lit("}}"))
    wrapped = F.concat(F.lit('{"recommendation": {"value": '), score, F.lit('}, "confidence": "'), (n % 5).cast("string"), F.lit(' - sure"}'))
    alone = F.concat(F.lit('{"overall_recommendation": {"value": "'), score, F.lit('"}}'))
    content = F.when(n % 4 == 0, bare).when(n % 4 == 1, wrapped).when(n % 4 == 2, alone).otherwise('{"comment": "none"}')
    forum = F.concat(F.lit("f"), (F.col("user_id") % 500).cast("string"))
    replies = table(spark, sf_dir, "events").select(forum.alias("forum"), n.cast("string").alias("id"), F.array(F.concat(F.lit("ICLR.cc/2025/Conference/Submission1/-/"), F.when(n % 4 == 3, "Official_Comment").otherwise("Official_Review"))).alias("invitations"), content.alias("content"), n.alias("seq"))
    return pages.reviews(replies).select("forum", labels.review_scores(F.col("reviews")).alias("reviews"))


@query("""SELECT c_custkey AS id, ['a b', 'Q'] AS names, ['u' || c_custkey, '~A_B1'] AS usernames, 'Lecturer@' || c_name || '@x.vn' AS post FROM customer""", on_domain=False)
def src_profile_summary(spark, sf_dir):
    user = F.concat(F.lit("u"), F.col("id").cast("string"))
    none = F.lit(None).cast("string")
    name = lambda *v: F.struct(*(x.alias(k) for x, k in zip(v, ("fullname", "first", "middle", "last", "username"), strict=True)))
    names = F.array(name(F.lit(""), F.lit("a"), F.lit(""), F.lit("b"), user), name(F.lit("Q"), none, none, none, none))
    entry = F.struct(F.lit("Lecturer").alias("position"), F.struct(F.col("name").alias("name"), F.lit("x.vn").alias("domain")).alias("institution"), F.lit(2020).alias("start"), F.lit(None).cast("int").alias("end"))
    rows = _customers(spark, sf_dir).select(F.col("id").alias("n"), F.lit("~A_B1").alias("id"), names.alias("names"), F.array(entry).alias("history"))
    out = pages.profile_summary(rows.withColumn("id", F.lit("~A_B1"))).select("names", F.array_sort("usernames", lambda a, b: F.when(a.startswith("u"), -1).when(b.startswith("u"), 1).otherwise(0)).alias("usernames"), F.col("history")[0].alias("h"))
    first = F.col("usernames")[0]
    return out.select(F.substring(first, F.lit(2), F.length(first)).cast("bigint").alias("id"), "names", "usernames", F.concat_ws("@", "h.position", "h.institution", "h.domain").alias("post"))


@query("""SELECT c_custkey AS id, ['School of ' || c_name || '; Big Lab', 'Big Lab', ''] AS affiliations FROM customer""", on_domain=False)
def src_title_page(spark, sf_dir):
    form = "A Title\nAda Love 1,2   Bo Ta 2 Cy Do*\n\n1 School of {name},\n2 Big Lab\n{ada,bo}@x.org"
    page = F.replace(F.lit(form), F.lit("{name}"), F.col("name"))
    names = F.array(F.lit("Ada Love"), F.lit("Bo Ta"), F.lit("Cy Do"))
    return _customers(spark, sf_dir).select("id", pages.numbered_affiliations(page, names).alias("affiliations"))


_PDFS = [
    ("https://openaccess.thecvf.com/content/html/X_paper.html", "", "https://openaccess.thecvf.com/content/papers/X_paper.pdf"), ("https://aclanthology.org/2024.acl-1.1/", "", "https://aclanthology.org/2024.acl-1.1.pdf"),
    ("https://proceedings.mlr.press/v235/a-b24a.html", "", "https://proceedings.mlr.press/v235/a-b24a/a-b24a.pdf"), ("https://proceedings.neurips.cc/paper/2024/hash/1-Abstract-Conference.html", "", "https://proceedings.neurips.cc/paper/2024/file/1-Paper-Conference.pdf"),
    ("https://ojs.aaai.org/1", "https://ojs.aaai.org/1.pdf", "https://ojs.aaai.org/1.pdf"), ("https://x.org", "", None),
]


@query(f"""SELECT event_id, [{", ".join("NULL" if p is None else literal(p) for *_, p in _PDFS)}][CAST(1 + event_id % {len(_PDFS)} AS INTEGER)] AS pdf FROM events""", on_domain=False)
def src_pdf_address(spark, sf_dir):
    pick = lambda k: F.element_at(F.array(*(F.lit(p[k]) for p in _PDFS)), (F.lit(1) + F.col("event_id") % len(_PDFS)).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", labels.pdf_address(pick(0), pick(1)).alias("pdf"))


# --- submissions and manuscripts --------------------------------------------------------------------------------------------------------

_GROUPS = [
    ("ICLR.cc/2026/Workshop/X/-/Submission", "iclr", 2026, "workshop"), ("NeurIPS.cc/2023/Track/Datasets_and_Benchmarks/-/Submission", "neurips", 2023, "datasets_benchmarks"), ("ICLR.cc/2024/TinyPapers/-/Submission", "iclr", 2024, "tiny_papers"),
    ("thecvf.com/CVPR/2025/Conference/-/Submission", "cvpr", 2025, "main"), ("Journal/-/Submission", None, None, None),
]
_OUTCOMES = [("ICLR 2023 notable top 25%", "", "accepted"), ("ICLR 2022 Submitted", "", "rejected"), ("Submitted to ICLR 2025", "", "rejected"), ("ICLR 2026 Conference Withdrawn Submission", "", "withdrawn"), ("", "Reject", "rejected"), ("", "Accept (Spotlight)", "accepted"), ("", "", "unknown")]


@query(f"""SELECT event_id, [{", ".join("NULL" if g[1] is None else literal(g[1]) for g in _GROUPS)}][CAST(1 + event_id % 5 AS INTEGER)] AS venue, [{", ".join("NULL" if g[2] is None else str(g[2]) for g in _GROUPS)}][CAST(1 + event_id % 5 AS INTEGER)] AS year,
    [{", ".join("NULL" if g[3] is None else literal(g[3]) for g in _GROUPS)}][CAST(1 + event_id % 5 AS INTEGER)] AS track, [{", ".join(literal(o[2]) for o in _OUTCOMES)}][CAST(1 + event_id % 7 AS INTEGER)] AS status FROM events""", on_domain=False)
def cls_venue(spark, sf_dir):
    pick = lambda choices, n: F.element_at(F.array(*map(F.lit, choices)), (F.lit(1) + F.col("event_id") % n).cast("int"))
    group = classify.submission_venue(F.array(F.lit("Other/-/Submission"), pick([g[0] for g in _GROUPS], 5)), F.lit(None).cast("string"))
    status = classify.submission_outcome(pick([o[0] for o in _OUTCOMES], 7), F.lit(""), F.lit(None).cast("array<string>"), pick([o[1] for o in _OUTCOMES], 7))
    return table(spark, sf_dir, "events").select("event_id", group.alias("g"), status.alias("status")).select("event_id", "g.venue", "g.year", "g.track", "status")


_PARAGRAPH = "This paragraph of running text has well over fifteen words so that it is kept as part of the body of a paper"


@query(f"""SELECT c_custkey AS id, {literal(_PARAGRAPH)} || ' ' || c_name || chr(10) || chr(10) || {literal(_PARAGRAPH + ' and is longrunning too')} AS body FROM customer""", on_domain=False)
def str_paper_body(spark, sf_dir):
    form = f"Title of {{name}}\nAuthors\n\nA BSTRACT\n\n{_PARAGRAPH} {{name}}\n\n1 I NTRODUCTION\n\n{_PARAGRAPH} and is long-\nrunning too\n\n1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7\n\nR EFERENCES\n\n{_PARAGRAPH} later\f{_PARAGRAPH}"
    return _customers(spark, sf_dir).select("id", manuscript.paper_body(F.replace(F.lit(form), F.lit("{name}"), F.col("name"))).alias("body"))


# --- files of the library ---------------------------------------------------------------------------------------------------------------


@query(f"""SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'own-' || s_suppkey ELSE regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g') END AS slug, s_name AS name, list_sort(list_distinct([trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g')), 'a b', 'doan c'])) AS variants,
    [{", ".join(literal(f) for f, _ in HOMES)}][CAST(1 + s_suppkey % 8 AS INTEGER)] AS institution, CASE WHEN s_suppkey % 2 = 0 THEN [{", ".join(literal(s) for _, s in HOMES)}][CAST(1 + s_suppkey % 8 AS INTEGER)] ELSE [{", ".join(literal(f) for f, _ in HOMES)}][CAST(1 + s_suppkey % 8 AS INTEGER)] END AS institution_short,
    CASE WHEN s_suppkey % 4 <> 0 THEN CAST(2000 + s_suppkey % 20 AS INTEGER) END AS vn_since, ['~A_B' || s_suppkey, '~C'] AS openreview_ids, CASE WHEN s_suppkey % 5 = 0 THEN 'no' ELSE 'yes' END AS approved FROM supplier""", on_domain=False)
def src_roster(spark, sf_dir):
    n = F.col("s_suppkey")
    pick = lambda k: F.element_at(F.array(*(F.lit(h[k]) for h in HOMES)), (F.lit(1) + n % 8).cast("int"))
    rows = table(spark, sf_dir, "supplier").select(
        F.when(n % 5 == 0, " No").otherwise("YES ").alias("approved"), F.concat(F.lit(" "), "s_name").alias("display_name"), F.lit('A "B"; Đoàn C;').alias("name_variants"), pick(0).alias("institution"), F.when(n % 2 == 0, pick(1)).alias("institution_short"),
        F.when(n % 4 == 0, "unknown").otherwise((2000 + n % 20).cast("string")).alias("vn_since"), F.concat(F.lit("~A_B"), n.cast("string"), F.lit("; ~C ;")).alias("openreview_ids"), F.when(n % 3 == 0, F.concat(F.lit("own-"), n.cast("string"))).alias("slug"), F.lit("left out").alias("more"),
    )
    unnamed = rows.limit(1).withColumn("display_name", F.lit("  "))
    path = _folder(spark, "roster")
    files.write_csv(rows.union(unnamed), path, files.ROSTER)
    return files.read_roster(spark, path).select("slug", "name", "variants", "institution", "institution_short", "vn_since", "openreview_ids", "approved")


@query("SELECT o_orderkey AS paper, o_orderpriority AS venue, CASE WHEN o_custkey % 2 = 0 THEN o_clerk END AS note, [o_custkey, o_orderkey] AS ids FROM orders".replace("o_clerk", "'note ' || o_custkey"), on_domain=False)
def src_json_lines(spark, sf_dir):
    note = F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("note "), F.col("o_custkey").cast("string")))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("paper"), F.col("o_orderpriority").alias("venue"), note.alias("note"), F.array("o_custkey", "o_orderkey").alias("ids"))
    path = _folder(spark, "lines")
    files.write_json_lines(rows, path)
    return files.read_json_lines(spark, path, "paper bigint, venue string, note string, ids array<bigint>")


@query("SELECT n_nationkey AS nation, r_name AS region, count(s_suppkey) AS people FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL", on_domain=False)
def snk_documents(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).join(table(spark, sf_dir, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    rows = rows.groupBy(F.col("n_nationkey").alias("nation"), F.col("r_name").alias("region")).agg(F.count("s_suppkey").alias("people"))
    path = _folder(spark, "documents")
    files.write_document(rows, path, "region")
    read = spark.read.text(path).select("region", F.from_json("value", "nation bigint, people bigint").alias("d"))
    return read.select(F.col("d.nation").cast("int").alias("nation"), "region", "d.people") if nation.schema["n_nationkey"].dataType.simpleString() == "int" else read.select("d.nation", "region", "d.people")


@query("""SELECT CAST(user_id AS VARCHAR) AS professor, event_type AS venue, CASE WHEN bool_or(event_id % 2 = 0) THEN 'yes' END AS decision, CAST(min(event_id) FILTER (event_id % 2 = 0 OR user_id NOT IN (SELECT user_id FROM events e WHERE e.event_id % 2 = 0 AND e.event_type = events.event_type)) AS VARCHAR) AS title
    FROM events GROUP BY user_id, event_type""", on_domain=False)
def snk_append_queue(spark, sf_dir):
    columns = ["decision", "professor", "venue", "title"]
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("professor"), F.col("event_type").alias("venue"), F.col("event_id").alias("n"))
    first = rows.where("n % 2 = 0").groupBy("professor", "venue").agg(F.min("n").cast("string").alias("title")).withColumn("decision", F.lit("yes"))
    later = rows.groupBy("professor", "venue").agg(F.min("n").cast("string").alias("title")).withColumn("decision", F.lit(None).cast("string"))
    path = _folder(spark, "queue")
    for fresh in (first, later, later):  # the answers given to the first rows stay, and nothing is added twice
        files.append_unseen(fresh.select(*columns), path, columns, ["professor", "venue"])
    return files.read_csv(spark, path, columns).select("professor", "venue", "decision", "title")


@query("""SELECT o_orderpriority || ': ' || count(*) || ' papers, ' || count(*) FILTER (o_orderstatus = 'F') || ' accepted (' || CAST(round_even(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*), 0) AS BIGINT) || '%)' AS line FROM orders GROUP BY o_orderpriority""", on_domain=False)
def snk_report(spark, sf_dir):
    taken = F.count(F.when(F.col("o_orderstatus") == "F", 1))
    rows = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), taken.alias("a"))
    path = _folder(spark, "report")
    rows.select(F.format_string("%s: %d papers, %d accepted (%d%%)", "o_orderpriority", "n", "a", F.bround(100 * F.col("a") / F.col("n"), 0).cast("bigint")).alias("value")).write.text(path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("""SELECT regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g') AS slug, s_name AS name, CASE WHEN 2016 + s_suppkey % 9 > 2020 THEN CAST(2016 + s_suppkey % 9 AS INTEGER) END AS vn_since, CASE WHEN s_suppkey % 10 = 3 THEN 'yes' ELSE '' END AS approved FROM supplier WHERE s_suppkey % 10 IN (3, 4)""", on_domain=False)
def snk_roster_append(spark, sf_dir):
    n, path = F.col("s_suppkey"), _folder(spark, "grown")
    found = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("display_name"), F.regexp_replace(F.lower("s_name"), "[^a-z0-9]+", "-").alias("slug"), F.when(2016 + n % 9 > 2020, (2016 + n % 9).cast("string")).alias("vn_since"), n.alias("n"))
    files.append_unseen(found.where("n % 10 = 3").withColumn("approved", F.lit("yes")), path, files.ROSTER, ["slug"])
    wanted = found.where("n % 10 in (3, 4)")
    files.append_unseen(wanted, path, files.ROSTER, ["slug"])
    return files.read_roster(spark, path).select("slug", "name", "vn_since", "approved")


# --- collecting -------------------------------------------------------------------------------------------------------------------------


@query("""SELECT venue, CAST(2024 AS INTEGER) AS year, count(*) * main AS papers, coalesce(any_value(other), 0) * CASE WHEN venue = 'cvpr' THEN 0 ELSE count(*) END AS special, volume
    FROM customer CROSS JOIN (VALUES ('cvpr', 1, 0, '2024.acl-long'), ('aaai', 1, 1, '2024.acl-long'), ('ijcai', 1, 1, '2024.acl-long')) t(venue, main, other, volume) GROUP BY venue, main, volume""", on_domain=False)
def src_collect(spark, sf_dir):
    rows = _customers(spark, sf_dir)
    cvf = '<dt class="ptitle"><a href="/content/{id}.html">On {name}</a></dt><dd><input name="query_author" value="Giv Fam"></dd>'
    aaai = f'<div class="section"><h2>AAAI Technical Track on X</h2>{_ARTICLE % "T"}</div><div class="section"><h2>Special <b>Day</b></h2>{_ARTICLE % "S"}</div>'
    ijcai = f'<div class="section_title"><h3>Main Track</h3></div>{_IJCAI % "T"}<div class="section_title"><h3>Survey</h3></div>{_IJCAI % "S"}'
    lists = [listings.cvf_pages(_file(rows, "cvpr", cvf)), listings.aaai_pages(_file(rows, "aaai", aaai)), listings.ijcai_pages(_file(rows, "ijcai", ijcai))]
    _, cover = listings.collect(lists)
    special = F.aggregate(F.map_values(F.coalesce("other_tracks", F.create_map().cast("map<string,bigint>"))), F.lit(0).cast("bigint"), lambda s, n: s + n)
    return cover.select("venue", "year", "papers", special.alias("special"), listings.bib_volumes(F.col("year")).alias("volume"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN ['A B', 'u' || user_id] WHEN 1 THEN ['X', 'Y'] ELSE ['Solo'] END AS authors, CASE event_id % 3 WHEN 0 THEN ['~A_B1', 'u' || user_id] WHEN 1 THEN ['~X1', 'y@z'] ELSE [] END AS ids FROM events""", on_domain=False)
def src_note_people(spark, sf_dir):
    n, u = F.col("event_id"), F.col("user_id").cast("string")
    objects = F.concat(F.lit('{"authors": {"value": [{"username": "~A_B1", "fullname": "A B"}, {"username": "u'), u, F.lit('", "fullname": ""}]}, "authorids": {"value": []}}'))
    content = F.when(n % 3 == 0, objects).when(n % 3 == 1, '{"authors": ["X", "Y"], "authorids": {"value": ["~X1", "y@z"]}}').otherwise('{"authors": {"value": "Solo"}}')
    return pages.note_people(table(spark, sf_dir, "events").select(n.alias("id"), content.alias("content"))).withColumnRenamed("id", "event_id")


#: Notes of both versions of the interface by a paper's number: content wrapped and bare, a second note of one id, an object for each author, a journal, a workshop, and replies.
_NOTES = [  # shapes, id, forum, invitations, invitation, content, seq
    ((0, 1, 2), "n{i}", "n{i}", "ICLR.cc/2025/Conference/-/Submission", "", '{"title": {"value": "Title {i}"}, "venue": {"value": "Submitted to ICLR 2025"}, "venueid": {"value": "ICLR.cc/2025/Conference"}, "authors": {"value": ["A B", "C D"]}, "authorids": {"value": ["~A_B1", "~C_D1"]}}', 1),
    ((0,), "n{i}", "n{i}", "", "ICLR.cc/2025/Conference/-/Blind_Submission", '{"title": "A later note of the same id {i}", "authors": ["X"]}', 2),
    ((3, 4), "n{i}", "n{i}", "", "ICLR.cc/2021/Conference/-/Blind_Submission", '{"title": "Bare {i}", "authors": ["E F"], "authorids": ["~E_F1"]}', 1),
    ((3,), "r{i}", "n{i}", "", "ICLR.cc/2021/Conference/Paper{i}/-/Decision", '{"decision": "Accept (Spotlight)"}', 3),
    ((4,), "r{i}", "n{i}", "", "ICLR.cc/2021/Conference/Paper{i}/-/Decision", '{"recommendation": "Reject"}', 3),
    ((4,), "s{i}", "n{i}", "", "ICLR.cc/2021/Conference/Paper{i}/-/Decision", '{"decision": "Accept (Oral)"}', 4),
    ((1, 3), "w{i}", "n{i}", "ICLR.cc/2025/Conference/Submission{i}/-/Official_Review", "", '{"rating": {"value": 8}}', 2),
    ((5,), "n{i}", "n{i}", "TMLR/-/Submission", "", '{"title": {"value": "In a journal {i}"}}', 1),
    ((6,), "n{i}", "n{i}", "ICLR.cc/2025/Workshop/Some/-/Submission", "", '{"title": {"value": "At a workshop {i}"}, "venue": {"value": "ICLR 2025 Workshop Some Poster"}, "authors": {"value": [{"username": "~G_H1", "fullname": "G H"}, {"username": "~I_J1"}]}, "authorids": {"value": []}}', 1),
]
_NOTE_SQL = " UNION ALL ".join(
    f"SELECT replace({literal(i)}, '{{i}}', CAST(k AS VARCHAR)) AS id, replace({literal(f)}, '{{i}}', CAST(k AS VARCHAR)) AS forum, {literal(a or b)} AS asked, replace({literal(c)}, '{{i}}', CAST(k AS VARCHAR)) AS content, {n} AS seq FROM o WHERE shape IN ({', '.join(map(str, shapes))})"
    for shapes, i, f, a, b, c, n in _NOTES
)


@query(f"""WITH o AS (SELECT o_orderkey AS k, o_orderkey % 7 AS shape FROM orders), note AS ({_NOTE_SQL}),
    own AS (SELECT * FROM note WHERE id = forum QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq) = 1), reply AS (SELECT forum, arg_min(coalesce(json_extract_string(content, '$.decision'), json_extract_string(content, '$.recommendation')), seq) AS told FROM note WHERE id <> forum AND asked LIKE '%Decision' GROUP BY forum),
    read AS (SELECT own.id, regexp_extract(asked, '^ICLR.cc/([0-9]+)/', 1) AS y, CASE WHEN asked LIKE '%/Workshop/%' THEN 'workshop' ELSE 'main' END AS track, coalesce(json_extract_string(content, '$.venue.value'), json_extract_string(content, '$.venue'), '') AS label,
        coalesce(json_extract_string(content, '$.title.value'), json_extract_string(content, '$.title'), '') AS title, coalesce(json_extract(content, '$.authors.value'), json_extract(content, '$.authors')) AS people, coalesce(json_extract(content, '$.authorids.value'), json_extract(content, '$.authorids')) AS given, told
        FROM own LEFT JOIN reply ON reply.forum = own.id WHERE asked LIKE 'ICLR.cc/%')
    SELECT id, 'iclr' AS venue, CAST(y AS INTEGER) AS year, track, title, array_to_string(list_transform(CAST(people AS JSON[]), lambda p: coalesce(nullif(json_extract_string(p, '$.fullname'), ''), json_extract_string(p, '$.username'), json_extract_string(p, '$'))), '; ') AS authors,
    array_to_string(CASE WHEN json_array_length(given) > 0 THEN CAST(given AS VARCHAR[]) ELSE list_transform(CAST(people AS JSON[]), lambda p: json_extract_string(p, '$.username')) END, '; ') AS ids, CASE WHEN track = 'main' AND label = '' THEN coalesce(told, '') ELSE '' END AS decision,
    CASE WHEN label LIKE 'Submitted%' THEN 'rejected' WHEN label LIKE '%Poster' THEN 'accepted' WHEN told LIKE 'Accept%' THEN 'accepted' WHEN told = 'Reject' THEN 'rejected' ELSE 'unknown' END AS status FROM read""", on_domain=False)
def src_submissions(spark, sf_dir):
    """Notes of both versions of the interface as one table of submissions."""
    order = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 7).cast("int").alias("shape"))
    form = lambda shapes, i, f, a, b, c, n: F.struct(F.array(*map(F.lit, shapes)).alias("shapes"), *(F.lit(x).alias(name) for name, x in (("id", i), ("forum", f), ("invitations", a), ("invitation", b), ("content", c), ("seq", n))))
    rows = order.select("k", "shape", F.explode(F.array(*(form(*n) for n in _NOTES))).alias("n")).where(F.array_contains("n.shapes", F.col("shape")))
    told = lambda c: F.replace(F.col(c), F.lit("{i}"), F.col("k").cast("string"))
    notes = rows.select(told("n.id").alias("id"), told("n.forum").alias("forum"), F.when(F.col("n.invitations") != "", F.array(told("n.invitations"))).alias("invitations"), told("n.invitation").alias("invitation"), told("n.content").alias("content"), F.col("n.seq").alias("seq"))
    found = pages.submissions(notes)
    return found.select("id", "venue", "year", "track", "title", F.array_join("authors", "; ").alias("authors"), F.array_join("ids", "; ").alias("ids"), "decision", "status")
