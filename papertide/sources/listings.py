"""Accepted-paper lists of conferences as one table of papers, from JSON listings, proceedings pages and bibliographies.

Each reader takes a table of whole files (venue, year, body) and returns the columns of PAPER. Files are split into entries with built-in
functions; only entities and typesetting commands are resolved in Python, in batches. Text that a list does not print is null.
"""

from __future__ import annotations

import html
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papertide.functions import classify
from papertide.functions.manuscript import batches
from papertide.functions.text import latex_to_text, norm_title
from papertide.sources.landed_files import bib_entries

PAPER = ["venue", "year", "track", "title", "authors", "url", "pdf", "forum", "pres", "topic", "source"]

#: The shape of a JSON listing, the marks of the proceedings pages, and the sites that relative addresses belong to.
LISTING = (
    "results array<struct<name: string, authors: array<struct<fullname: string, institution: string>>, decision: string, sourceurl: string, event_type: string, "
    "eventtype: string, paper_url: string, virtualsite_url: string, topic: string, starttime: string>>"
)
CVF_ENTRY, CVF_LINK, CVF_NAME = '<dt class="ptitle">', r'(?s)<a href="([^"]+)">(.*?)</a>', r'name="query_author" value="([^"]*)"'
ECVA_LINK, ECVA_NAMES = r"(?s)<a href=['\"]?([^>'\"]+)['\"]?>\s*(.*?)</a>", r"(?s)</dt>\s*<dd>\s*(.*?)</dd>"
AAAI_SECTION, AAAI_ARTICLE = '<div class="section">', '<div class="obj_article_summary">'
AAAI_TITLE, AAAI_NAMES, AAAI_PDF = r'(?s)<h3 class="title">\s*<a[^>]*href="([^"]+)"[^>]*>(.*?)</a>', r'(?s)<div class="authors">(.*?)</div>', r'class="obj_galley_link pdf" href="([^"]+)"'
IJCAI_SECTION, IJCAI_PAPER = '<div class="section_title">', r'<div id="paper\d+" class="paper_wrapper">'
SITES = {"cvf": "https://openaccess.thecvf.com", "ecva": "https://www.ecva.net/", "ijcai": "https://www.ijcai.org"}
PRESENTATION_RANK = {"oral": 2, "spotlight": 1, "highlight": 1}

unescaped = batches(lambda x: unicodedata.normalize("NFC", html.unescape(x)))
from_latex = batches(latex_to_text)


def known(text: Column) -> Column:
    """The trimmed text; null where nothing is left."""
    return F.nullif(F.trim(text), F.lit(""))


def fragment_text(fragment: Column) -> Column:
    """A piece of a page without tags and with single spaces."""
    return known(F.regexp_replace(unescaped(F.regexp_replace(fragment, "<[^>]+>", " ")), r"[\s ]+", " "))


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def bare_authors(names: Column) -> Column:
    """Author structs without affiliations, from an array of names; empty names go."""
    kept = F.filter(F.transform(names, lambda n: F.trim(n)), lambda n: n != "")
    return F.transform(kept, lambda n: F.struct(n.alias("name"), F.lit(None).cast("string").alias("aff")))


def papers(entries: DataFrame, **values: Column) -> DataFrame:
    """The columns of PAPER; those not given are null, or the main track."""
    absent = {"track": F.lit("main")}
    columns = [F.col(c) if c in ("venue", "year") and c not in values else values.get(c, absent.get(c, F.lit(None).cast("string"))) for c in PAPER]
    return entries.select(*(v.alias(c) for v, c in zip(columns, PAPER, strict=True)))


def pieces(files: DataFrame, mark: str, body: str = "body") -> DataFrame:
    """The pieces of each file that a mark opens, with their place in `seq`."""
    parts = F.split(F.col(body), rf"\Q{mark}\E")
    return files.select("*", F.posexplode(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).alias("seq", "piece"))


def virtual_listing(files: DataFrame, site: str) -> DataFrame:
    """Papers of JSON listings. A paper listed several times in a track becomes one: the best presentation, the first address with a forum, the first
    topic, the authors with the most affiliations. One listed outside all tracks joins its main-track entry. A body that is no such JSON has no papers."""
    read = files.withColumn("rows", F.from_json("body", LISTING)["results"])
    sourced = 2 * F.size(F.filter("rows", lambda r: F.coalesce(r["sourceurl"], F.lit("")) != "")) > F.size("rows")
    rows = read.select("venue", "year", sourced.alias("sourced"), F.posexplode("rows").alias("seq", "r"))
    # Only names and titles can hold entities; they pass through Python together.
    rows = rows.withColumn("title", known(unescaped(F.col("r.name")))).withColumn("topic", known(unescaped(F.col("r.topic"))))
    people = F.filter(F.col("r.authors"), lambda a: F.trim(F.coalesce(a["fullname"], F.lit(""))) != "")
    flat = F.array_join(F.transform(people, lambda a: F.concat_ws("\x1f", F.trim(a["fullname"]), F.trim(F.coalesce(a["institution"], F.lit(""))))), "\x1e")
    authors = F.transform(F.split(unescaped(flat), "\x1e"), lambda s: F.struct(F.trim(F.split(s, "\x1f")[0]).alias("name"), known(F.split(s, "\x1f")[1]).alias("aff")))
    rows = rows.where("title is not null").where(F.size(people) > 0).withColumn("authors", authors)
    said = F.concat_ws(" ", "r.decision", "r.event_type", "r.eventtype")
    rows = rows.select(
        "venue",
        "year",
        "seq",
        "title",
        "topic",
        "authors",
        classify.listing_track(F.col("title"), F.col("r.sourceurl"), F.col("r.event_type"), F.col("sourced")).alias("track"),
        classify.presentation(said).alias("pres"),
        first_match(F.col("r.paper_url"), r"openreview\.net/forum\?id=([\w-]+)").alias("forum"),
        F.when(F.col("r.paper_url").startswith("http"), F.col("r.paper_url")).otherwise(F.concat(F.lit(site), F.nullif("r.virtualsite_url", F.lit("")))).alias("url"),
        norm_title(F.col("title")).alias("key"),
    )
    has_main = F.max(F.col("track") == "main").over(Window.partitionBy("venue", "year", "key"))
    rows = rows.withColumn("whole", ~((F.col("track") == "other") & has_main)).withColumn("track", F.when(F.col("whole"), F.col("track")).otherwise("main"))
    rank = F.coalesce(F.create_map(*(F.lit(x) for kv in PRESENTATION_RANK.items() for x in kv))[F.col("pres")], F.lit(0))
    with_place = F.size(F.filter("authors", lambda a: a["aff"].isNotNull()))
    earliest = -F.col("seq")
    of_whole = lambda value: F.when(F.col("whole"), value)
    merged = rows.groupBy("venue", "year", "track", "key").agg(
        F.min_by("title", of_whole(F.col("seq"))).alias("title"),
        F.max_by("authors", of_whole(F.struct(with_place, earliest))).alias("authors"),
        F.min_by(F.struct("forum", "url"), of_whole(F.struct(F.col("forum").isNull(), "seq"))).alias("at"),
        F.max_by("pres", F.struct(rank, "whole", earliest)).alias("pres"),
        F.min_by("topic", F.when(F.col("topic").isNotNull() & F.col("whole"), F.col("seq"))).alias("topic"),
    )
    host = F.lit(site.split("//")[-1])
    return papers(merged, track=F.col("track"), title=F.col("title"), authors=F.col("authors"), url=F.col("at.url"), forum=F.col("at.forum"), pres=F.nullif("pres", F.lit("")), topic=F.col("topic"), source=host)


def provisional(files: DataFrame) -> DataFrame:
    """venue, year and whether the listing has no schedule yet: fewer than half of its entries have a start time."""
    rows = F.coalesce(F.from_json("body", LISTING)["results"], F.array())
    timed = F.size(F.filter(rows, lambda r: F.coalesce(r["starttime"], F.lit("")) != ""))
    return files.select("venue", "year", ((F.size(rows) > 0) & (2 * timed < F.size(rows))).alias("provisional"))


def cvf_pages(files: DataFrame) -> DataFrame:
    """Papers of open-access proceedings pages; entries without a link go."""
    rows = pieces(files, CVF_ENTRY).where(F.col("piece").rlike(CVF_LINK))
    names = F.split(unescaped(F.array_join(F.regexp_extract_all("piece", F.lit(CVF_NAME), F.lit(1)), "\x1e")), "\x1e")
    return papers(rows, title=fragment_text(first_match(F.col("piece"), CVF_LINK, 2)), authors=bare_authors(names), url=F.concat(F.lit(SITES["cvf"]), first_match(F.col("piece"), CVF_LINK)), source=F.lit("openaccess.thecvf.com"))


def ecva_pages(files: DataFrame) -> DataFrame:
    """Papers of the file's year from a page that lists all years under headings."""
    heading = F.concat(F.lit("ECCV "), F.col("year").cast("string"), F.lit(" Papers"))
    section = F.regexp_replace(F.split_part("body", heading, F.lit(2)), r"(?s)ECCV \d{4} Papers.*", "")
    rows = pieces(files.withColumn("section", section), CVF_ENTRY, "section").where(F.col("piece").rlike(ECVA_LINK) & F.col("piece").rlike(ECVA_NAMES))
    names = F.transform(F.split(fragment_text(first_match(F.col("piece"), ECVA_NAMES)), ","), lambda n: F.rtrim(F.trim(n), F.lit("* ")))
    return papers(rows, title=fragment_text(first_match(F.col("piece"), ECVA_LINK, 2)), authors=bare_authors(names), url=F.concat(F.lit(SITES["ecva"]), first_match(F.col("piece"), ECVA_LINK)), source=F.lit("ecva.net"))


def aaai_pages(files: DataFrame) -> DataFrame:
    """Papers of an issue's pages: sections give the track, articles the rest."""
    sections = pieces(files, AAAI_SECTION).select("venue", "year", F.col("piece").alias("section"))
    rows = pieces(sections, AAAI_ARTICLE, "section").where(F.col("piece").rlike(AAAI_TITLE))
    section = fragment_text(first_match(F.col("section"), r"(?s)<h2>(.*?)</h2>"))
    names = F.split(F.coalesce(fragment_text(first_match(F.col("piece"), AAAI_NAMES)), F.lit("")), ",")
    pdf = F.replace(first_match(F.col("piece"), AAAI_PDF), F.lit("/article/view/"), F.lit("/article/download/"))
    return papers(rows, track=classify.section_track(section), title=fragment_text(first_match(F.col("piece"), AAAI_TITLE, 2)), authors=bare_authors(names), url=first_match(F.col("piece"), AAAI_TITLE), pdf=pdf, source=F.lit("ojs.aaai.org"))


def ijcai_pages(files: DataFrame) -> DataFrame:
    """Papers of proceedings pages; subject headings inside a section are not papers, so they open no piece."""
    sections = pieces(files, IJCAI_SECTION).select("venue", "year", F.col("piece").alias("section"))
    parts = F.split("section", IJCAI_PAPER)
    rows = sections.select("*", F.explode(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).alias("piece"))
    of = lambda mark: first_match(F.col("piece"), rf'(?s)<div class="{mark}">(.*?)</div>')
    details = rf'(?s)<div class="details">.*?href="([^"]+\.pdf)".*?href="(/proceedings/[^"]+)"'
    rows = rows.where(F.col("piece").rlike(details))
    section = F.coalesce(fragment_text(first_match(F.col("section"), r"(?s)^\s*<h3>(.*?)</h3>")), F.lit("other"))
    track = F.when(F.lower(section).startswith("main track"), "main").otherwise(section)
    pdf = F.concat(F.lit(SITES["ijcai"] + "/proceedings/"), F.col("year").cast("string"), F.lit("/"), first_match(F.col("piece"), details))
    return papers(rows, track=track, title=fragment_text(of("title")), authors=bare_authors(F.split(F.coalesce(fragment_text(of("authors")), F.lit("")), ",")), url=F.concat(F.lit(SITES["ijcai"]), first_match(F.col("piece"), details, 2)), pdf=pdf, source=F.lit("ijcai.org"))


def bibliographies(files: DataFrame) -> DataFrame:
    """Papers of bibliography files that are held whole: see volumes()."""
    one = files.select(F.concat_ws(" ", F.col("venue"), F.col("year"), F.md5(F.col("body").cast("binary")), F.monotonically_increasing_id()).alias("path"), "venue", "year", "body")
    return volumes(one.select("path", "venue", "year", F.posexplode(F.split("body", "\n")).alias("place", "line")))


def volumes(lines: DataFrame) -> DataFrame:
    """Papers of bibliography volumes, from their lines (see landed_files.volume_lines): the conference entries that have a title and authors; "Last, First" is turned round."""
    rows = bib_entries(lines).where("kind = 'inproceedings' and fields['title'] is not null and fields['author'] is not null").withColumnRenamed("fields", "f")
    names = F.split(from_latex(F.array_join(F.split(F.col("f")["author"], r"\s+and\s+"), "\x01")), "\x01")
    turned = F.transform(names, lambda n: F.concat_ws(" ", known(F.split_part(n, F.lit(","), F.lit(2))), known(F.split_part(n, F.lit(","), F.lit(1)))))
    return papers(rows, title=known(from_latex(F.col("f")["title"])), authors=bare_authors(turned), url=known(F.col("f")["url"]), source=F.lit("aclanthology.org"))


def combine_lists(listing: DataFrame, proceedings: DataFrame, enough: float = 0.95) -> DataFrame:
    """One list per venue and year from a listing and the proceedings. Where the listing's main track is nearly as long, it is taken; elsewhere the
    proceedings are, with the listing's authors and presentation where the titles and the numbers of authors agree. The listing's other tracks stay."""
    at = ["venue", "year"]
    main = listing.where("track = 'main'")
    sizes = proceedings.groupBy(*at).agg(F.count(F.lit(1)).alias("printed")).join(main.groupBy(*at).agg(F.count(F.lit(1)).alias("listed")), at, "left")
    # One row for each venue and year.
    short = sizes.where(F.coalesce("listed", F.lit(0)) < enough * F.col("printed")).select(*at)
    key = norm_title(F.col("title")).alias("key")
    richer = main.withColumn("key", key).groupBy(*at, "key").agg(F.max_by(F.struct("authors", "pres"), F.size(F.filter("authors", lambda a: a["aff"].isNotNull()))).alias("rich"))
    met = proceedings.join(short, at, "left_semi").withColumn("key", key).join(richer, [*at, "key"], "left")
    agrees = F.size("rich.authors") == F.size("authors")
    filled = met.withColumn("pres", F.when(agrees, F.col("rich.pres")).otherwise(F.col("pres"))).withColumn("authors", F.when(agrees, F.col("rich.authors")).otherwise(F.col("authors")))
    return listing.where("track <> 'main'").unionByName(main.join(short, at, "left_anti")).select(*PAPER).unionByName(filled.select(*PAPER))


def bib_volumes(year: Column) -> Column:
    """The bibliography volume that holds a year's main papers."""
    return F.concat(year.cast("string"), F.when(year == 2020, ".acl-main").otherwise(".acl-long"))


def collect(lists: list[DataFrame], state: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """All lists as one table, and their coverage()."""
    every = reduce(DataFrame.unionByName, lists)
    return every, coverage(every, state)


def coverage(papers_: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """venue, year, papers (main track), with_affiliation (per cent of their authors, half to even), other_tracks and provisional."""
    each = papers_.groupBy("venue", "year", "track").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.size("authors")).alias("people"), F.sum(F.size(F.filter("authors", lambda a: a["aff"].isNotNull()))).alias("placed")
    )
    on_main = lambda c: F.coalesce(F.sum(F.when(F.col("track") == "main", F.col(c))), F.lit(0))
    other = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("track") != "main", F.struct("track", "n")))))
    out = each.groupBy("venue", "year").agg(on_main("n").alias("papers"), on_main("people").alias("people"), on_main("placed").alias("placed"), other.alias("other_tracks"))
    out = out.select("venue", "year", "papers", F.when(F.col("people") > 0, F.bround(100 * F.col("placed") / F.col("people"), 0)).otherwise(0).cast("int").alias("with_affiliation"), "other_tracks")
    if state is None:
        return out.withColumn("provisional", F.lit(False))
    return out.join(state, ["venue", "year"], "left").withColumn("provisional", F.coalesce("provisional", F.lit(False)))
