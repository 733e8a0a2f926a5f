"""Small rules on labels: lists, topics, keys, addresses, names and venues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from papertide.functions import text

#: Words that do not tell universities apart.
STOP_WORDS = ("university", "of", "the", "and", "institute", "college", "de", "at")
#: An area that was renamed.
AREA_ALIAS = {"Miscellaneous Aspects of Machine Learning": "General Machine Learning"}
#: Kinds of public pages by what their address holds, in order.
LINK_KINDS = [
    ("aclanthology.org", "acl"), ("dblp.org", "dblp"), ("scholar.google", "scholar"), ("researchgate.net", "researchgate"), ("linkedin.com", "linkedin"), ("wikipedia.org", "wikipedia"),
    ("openreview.net", "openreview"), ("publication", "publications"),
]
#: What addresses of personal pages, and of pages at an employer, hold.
HOME_PAGE = r"github\.io|sites\.google|users\.soict|/~|wordpress\.com|\.me/?$|\.info/?$|\.xyz/?$"
STAFF_PAGE = r"\.edu\.vn|vinuni|rmit\.edu|/people/|/staff|/giang-vien|soict\.hust|math\.ac\.vn"
#: Positions of faculty.
FACULTY = r"(?i)lecturer|professor|instructor|teacher|faculty|dean|head of|director"


def split_list(value: Column, mark: str = ";") -> Column:
    """The parts of a list in a text, trimmed, without blank ones; null counts as empty."""
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), mark), lambda x: F.trim(x)), lambda x: x != "")


def telling_words(name: Column) -> Column:
    """The words of a name that are no stop-words."""
    return F.array_except(F.split(text.norm_name(name), " "), F.array(*map(F.lit, STOP_WORDS)))


def workshop_name(venue: Column, venue_id: Column, invitations: Column) -> Column:
    """The workshop in the first group id that has one, with spaces for underscores; else the venue."""
    named = F.filter(F.transform(F.concat(F.array(venue_id), invitations), lambda s: F.regexp_extract(F.coalesce(s, F.lit("")), "/Workshop/([^/]+)", 1)), lambda s: s != "")
    return F.coalesce(F.replace(F.try_element_at(named, F.lit(1)), F.lit("_"), F.lit(" ")), F.trim(venue), F.lit(""))


def topic_parts(label: Column) -> tuple[Column, Column]:
    """Area (renamed ones under their new name) and topic of 'area->topic' or 'area/topic'."""
    mark = F.when(F.contains(label, F.lit("->")), "->").otherwise("/")
    at = F.instr(label, mark)
    area = F.trim(F.when(at > 0, F.substring(label, F.lit(1), at - 1)).otherwise(label))
    topic = F.trim(F.when(at > 0, F.substring(label, at + F.length(mark), F.length(label))).otherwise(""))
    return F.coalesce(F.create_map(*[F.lit(x) for pair in AREA_ALIAS.items() for x in pair])[area], area), topic


def score_key(venue: Column, year: Column, title_key: Column) -> Column:
    """The key of a paper among text scores: venue, year and the first 40 characters of its title key."""
    return F.concat_ws("-", venue, year.cast("string"), F.left(title_key, F.lit(40)))


def forum_id(url: Column) -> Column:
    """The forum in an address, else null."""
    return F.nullif(F.regexp_extract(F.coalesce(url, F.lit("")), r"openreview\.net/forum\?id=([\w-]+)", 1), F.lit(""))


def review_scores(pairs: Column) -> Column:
    """'score(confidence), ...' of an array of (score, confidence); a missing confidence is left out."""
    one = lambda p: F.concat(p["score"].cast("string"), F.coalesce(F.concat(F.lit("("), p["confidence"].cast("string"), F.lit(")")), F.lit("")))
    return F.array_join(F.transform(F.coalesce(pairs, F.array().cast("array<struct<score:int,confidence:int>>")), one), ", ")


def rounded_text(value: Column, places: int) -> Column:
    """A number as text with so many decimals, halves to the even digit as the figures' display has it."""
    return F.format_string(f"%.{places}f", F.bround(value, places))


#: Family names, in lower case and without accents.
FAMILIES = (
    "nguyen tran le pham hoang huynh phan vu vo dang bui do ho ngo duong ly dinh trinh doan luong truong lam mai ta cao chu quach ha "
    "thai kieu luu vuong trieu giang lai tong khuat nghiem bach phung dao"
).split()


def family_name_fits(name: Column) -> Column:
    """Whether a name of at least two words (cut at spaces, hyphens and points) begins or ends with a known family name."""
    words = F.filter(F.split(F.lower(text.folded(name)), r"[\s\-.]+"), lambda w: w != "")
    return F.coalesce((F.size(words) >= 2) & (F.try_element_at(words, F.lit(1)).isin(*FAMILIES) | F.try_element_at(words, F.lit(-1)).isin(*FAMILIES)), F.lit(False))


def held(venue: Column, year: Column) -> Column:
    """Whether a venue was held in a year: two of them are held every other year."""
    return F.when(venue == "iccv", F.pmod(year, F.lit(2)) == 1).when(venue == "eccv", F.pmod(year, F.lit(2)) == 0).otherwise(True)


def link_kind(url: Column) -> Column:
    """What kind of page an address is."""
    low = F.lower(F.coalesce(url, F.lit("")))
    rest = F.when(low.rlike(HOME_PAGE), "homepage").when(low.rlike(STAFF_PAGE), "staff").otherwise("website")
    return reduce(lambda otherwise, kind: F.when(F.contains(low, F.lit(kind[0])), kind[1]).otherwise(otherwise), reversed(LINK_KINDS), rest)


def link_key(url: Column) -> Column:
    """The address without scheme, www and closing slashes, in lower case: equal for one page."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(url, F.lit("")))), r"^https?://(www\.)?|/+$", "")


def link_text(url: Column) -> Column:
    """The address as shown: without scheme and one closing slash, percent-encoding resolved where it is valid."""
    return F.regexp_replace(F.coalesce(F.try_url_decode(F.replace(F.trim(url), F.lit("+"), F.lit("%2B"))), F.trim(url)), r"^https?://(www\.)?|/$", "")


def current_post(history: Column, home: Column) -> Column:
    """Of the entries (position, institution, domain, start, end) for which `home` (an array of flags beside them) holds, the latest: without an end first, then by end and start."""
    kept = F.filter(F.arrays_zip(history.alias("h"), home.alias("f")), lambda x: x["f"])
    ranked = F.transform(kept, lambda x: F.struct(x["h"]["end"].isNull().alias("open"), F.coalesce(x["h"]["end"], F.lit(0)).alias("end"), F.coalesce(x["h"]["start"], F.lit(0)).alias("start"), x["h"].alias("entry")))
    return F.array_max(ranked)["entry"]


def pdf_address(url: Column, pdf: Column) -> Column:
    """Where the PDF of an entry is: the one that its list gives, else by the publisher's rule; null where there is none."""
    swap = lambda *pairs: reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, url)
    return (
        F.when(F.coalesce(pdf, F.lit("")) != "", pdf)
        .when(F.contains(url, F.lit("thecvf.com")), swap(("/html/", "/papers/"), (".html", ".pdf")))
        .when(F.contains(url, F.lit("aclanthology.org")), F.concat(F.regexp_replace(url, "/+$", ""), F.lit(".pdf")))
        .when(url.rlike(r"proceedings\.mlr\.press/v\d+/[\w-]+\.html"), F.regexp_replace(url, r"^.*proceedings\.mlr\.press/(v\d+)/([\w-]+)\.html.*$", "https://proceedings.mlr.press/$1/$2/$2.pdf"))
        .when(F.contains(url, F.lit("proceedings.neurips.cc")), swap(("/hash/", "/file/"), ("-Abstract-Conference.html", "-Paper-Conference.pdf"), ("-Abstract.html", "-Paper.pdf")))
    )
