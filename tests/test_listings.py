"""List readers, manuscripts and record resolution on small invented inputs."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from papertide.functions import classify, manuscript
from papertide.functions.text import latex_to_text
from papertide.operators import resolution
from papertide.sources import listings, pages

GROUP = "https://openreview.net/group?id=NeurIPS.cc/2025/"


def files(spark, *rows):
    return spark.createDataFrame(list(rows), "venue string, year int, body string")


def people(row):
    return [(a.name, a.aff) for a in row.authors]


def test_listing_merges_what_is_listed_twice(spark):
    entry = {"name": "Paper A", "authors": [{"fullname": "X &amp; Y", "institution": ""}], "decision": "Accept (poster)", "sourceurl": GROUP + "Conference", "event_type": "Poster", "paper_url": "https://openreview.net/forum?id=abc"}
    rows = [
        entry,
        entry | {"decision": "Accept (oral)", "event_type": "Oral", "paper_url": "", "authors": [{"fullname": "X &amp; Y", "institution": "Some School"}]},
        entry | {"name": "Paper B", "sourceurl": GROUP + "Datasets_and_Benchmarks_Track", "paper_url": "", "decision": None},
        entry | {"name": "Paper A", "sourceurl": None, "event_type": "Spotlight"},
        entry | {"name": ""},
        entry | {"name": "No authors", "authors": []},
    ]
    out = listings.virtual_listing(files(spark, ("neurips", 2025, json.dumps({"results": rows})), ("icml", 2025, "not json"), ("iclr", 2025, None)), "https://neurips.cc").collect()
    got = {r.title: r for r in out}
    assert set(got) == {"Paper A", "Paper B"} and len(out) == 2
    assert (got["Paper A"].track, got["Paper A"].pres, got["Paper A"].forum, got["Paper A"].source) == ("main", "oral", "abc", "neurips.cc")
    assert people(got["Paper A"]) == [("X & Y", "Some School")]
    assert (got["Paper B"].track, got["Paper B"].pres, got["Paper B"].forum) == ("datasets_benchmarks", None, None)


def test_provisional_needs_a_majority_without_times(spark):
    timed, bare = {"name": "a", "starttime": "2026-01-01"}, {"name": "b"}
    bodies = [json.dumps({"results": r}) for r in ([bare] * 2, [timed] * 2, [timed] + [bare] * 9, [timed, bare], [])]
    out = listings.provisional(files(spark, *(("v", k, b) for k, b in enumerate(bodies)))).orderBy("year").collect()
    assert [r.provisional for r in out] == [True, False, True, False, False]


def test_proceedings_pages(spark):
    cvf = 'x<dt class="ptitle"><br><a href="/content/a.html">On  A &amp; B</a></dt><dd><input name="query_author" value="Giv Fam"><input name="query_author" value=" "></dd><dt class="ptitle">none</dt>'
    (row,) = listings.cvf_pages(files(spark, ("cvpr", 2024, cvf))).collect()
    assert (row.title, row.url, people(row)) == ("On A & B", "https://openaccess.thecvf.com/content/a.html", [("Giv Fam", None)])
    ecva = "".join(f"ECCV {y} Papers <dt class=\"ptitle\"><a href='p{y}.php'> Paper {y}</a></dt><dd> A B*, C D</dd>" for y in (2024, 2022))
    out = listings.ecva_pages(files(spark, ("eccv", 2022, ecva), ("eccv", 2020, ecva))).collect()
    assert [(r.title, r.url, people(r)) for r in out] == [("Paper 2022", "https://www.ecva.net/p2022.php", [("A B", None), ("C D", None)])]
    article = '<div class="obj_article_summary"><h3 class="title"> <a id="q" href="u{0}">T {0}</a></h3><div class="authors"> A B, C D </div><ul><a class="obj_galley_link pdf" href="h/article/view/{0}">x</a></ul></div>'
    aaai = f'<div class="section"><h2>AAAI Technical Track on X</h2>{article.format(1)}{article.format(2)}</div><div class="section"><h2>Special <b>Day</b></h2>{article.format(3)}</div>'
    out = sorted((r.title, r.track, r.pdf, len(r.authors)) for r in listings.aaai_pages(files(spark, ("aaai", 2025, aaai))).collect())
    assert out == [("T 1", "main", "h/article/download/1", 2), ("T 2", "main", "h/article/download/2", 2), ("T 3", "Special Day", "h/article/download/3", 2)]
    paper = '<div id="paper7" class="paper_wrapper"><div class="title">T {0}</div><div class="authors">A B, C D</div><div class="details"><a href="{0}.pdf">PDF</a><a href="/proceedings/2024/{0}">Details</a></div></div>'
    ijcai = f'<div class="section_title"><h3>Main Track</h3></div><div class="subsection_title">Vision</div>{paper.format(1)}<div class="section_title"><h3>Survey</h3></div>{paper.format(2)}'
    out = sorted((r.title, r.track, r.url, r.pdf) for r in listings.ijcai_pages(files(spark, ("ijcai", 2024, ijcai))).collect())
    assert out == [("T 1", "main", "https://www.ijcai.org/proceedings/2024/1", "https://www.ijcai.org/proceedings/2024/1.pdf"), ("T 2", "Survey", "https://www.ijcai.org/proceedings/2024/2", "https://www.ijcai.org/proceedings/2024/2.pdf")]


def test_bibliography(spark):
    bib = '@proceedings{p,\n title = "No"\n}\n@inproceedings{a-2025,\n    title = "A {T}itle",\n    author = {Fosse, Lo{\\"i}c  and\n      Ta, Hoang},\n    month = jul,\n    url = "https://example.org/1/"\n}\n'
    (row,) = listings.bibliographies(files(spark, ("acl", 2025, bib))).collect()
    assert (row.title, row.url, people(row)) == ("A Title", "https://example.org/1/", [("Loïc Fosse", None), ("Hoang Ta", None)])


@pytest.mark.parametrize(("source", "text"), [(r"Luong, {\DJ}o{\`a}n Minh", "Luong, Đoàn Minh"), (r"Nguy{\~{\^e}}n", "Nguyễn"), (r"{E}com{S}cript: a \textit{x} \& y", "EcomScript: a x & y"), (r"\v{C}ech", "Čech"), ("", "")])
def test_latex(source, text):
    assert latex_to_text(source) == text


def test_lists_combine_by_coverage(spark):
    paper = lambda title, names, aff, track="main", pres=None: ("cvpr", 2025, track, title, [(n, aff) for n in names], None, None, None, pres, None, "s")
    schema = "venue string, year int, track string, title string, authors array<struct<name:string,aff:string>>, url string, pdf string, forum string, pres string, topic string, source string"
    printed = spark.createDataFrame([paper(f"T{k}", "AB", None) for k in range(20)], schema)
    for listed, from_listing in ((19, True), (18, False)):
        rows = [paper(f"T{k}", "AB" if k else "A", "here", pres="oral") for k in range(listed)] + [paper("W", "A", None, "workshop")]
        out = {r.title: r for r in listings.combine_lists(spark.createDataFrame(rows, schema), printed).collect()}
        assert len(out) == (20 if from_listing else 21) and out["W"].track == "workshop" and out["T1"].pres == "oral"
        assert people(out["T0"]) == ([("A", "here")] if from_listing else [("A", None), ("B", None)])


def test_submission_rules(spark):
    cases = [
        (["ICLR.cc/2026/Workshop/X/-/Submission"], "", ("iclr", 2026, "workshop")),
        (["NeurIPS.cc/2023/Track/Datasets_and_Benchmarks/-/Submission"], "", ("neurips", 2023, "datasets_benchmarks")),
        (["ICLR.cc/2024/TinyPapers/-/Submission"], "", ("iclr", 2024, "tiny_papers")),
        (["thecvf.com/CVPR/2025/Conference/-/Submission"], "", ("cvpr", 2025, "main")),
        (["Journal/-/Submission"], "", None),
        (None, "ICLR.cc/2022/Conference", ("iclr", 2022, "main")),
    ]
    frame = spark.createDataFrame([(k, i, v) for k, (i, v, _) in enumerate(cases)], "k int, i array<string>, v string")
    got = frame.select("k", classify.submission_venue(F.col("i"), F.col("v")).alias("s")).orderBy("k").collect()
    assert [tuple(r.s) if r.s else None for r in got] == [c[2] for c in cases]
    labels = [("ICLR 2023 notable top 25%", "", None, "", "accepted"), ("ICLR 2022 Submitted", "", None, "", "rejected"), ("Submitted to ICLR 2025", "", None, "", "rejected"), ("", "", ["a/Desk_Rejected_Submission"], "", "desk_rejected"), (None, None, None, "Reject", "rejected"), ("", "", None, "Accept (Spotlight)", "accepted"), (None, None, None, None, "unknown")]
    frame = spark.createDataFrame([(k, *x[:4]) for k, x in enumerate(labels)], "k int, v string, i string, n array<string>, d string")
    got = frame.select("k", classify.submission_outcome(*(F.col(c) for c in "vind")).alias("s")).orderBy("k").collect()
    assert [r.s for r in got] == [x[4] for x in labels]


def test_manuscript(spark):
    para = " ".join(["word"] * 20) + "."
    page = lambda end: f"TITLE\nAuthors\n\nA BSTRACT\n{para}\n\n1\n\nI NTRODUCTION\n\n{para} long-\nrunning text.\n\nTable 1: 0.5 0.6\n\n{para}\n\n{end}\n\n{para} later\f"
    body_of = lambda t: spark.createDataFrame([(t,)], "t string").select(manuscript.paper_body(F.col("t"))).first()[0]
    body = body_of(page("R EFERENCES"))
    assert body.count(para) == 3 and "longrunning" in body and "Table" not in body and "Authors" not in body and "later" not in body
    assert all("later" not in body_of(page(e)) for e in ("References", "7 ACKNOWLEDGEMENTS", "Appendix A", "Reproducibility Statement"))
    assert "later" in body_of(page("Appendix B shows more.") + f"\n\n{para}\nReferences\n")
    table = "# Head\n\n- **bold** and `code`\n\n| a | b \\| c |\n|---|---|\n| c | Topic |\n\nOverview: 2\n[text](http://x)\n 1) ***x __y__***\n```py\n> quote\n---\n\n\nend"
    cases = [("pаper “x”​ мир", 'paper "x" мир'), ("мох Рy а", "мох Py a"), (None, None), ("", "")]
    made = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "k int, t string").select("k", manuscript.surface(F.col("t")).alias("t"))
    assert [r.t for r in made.orderBy("k").collect()] == [want for _, want in cases]
    one = lambda t: spark.createDataFrame([(t,)], "t string").select(manuscript.canonical(F.col("t"))).first()[0]
    plain = one(table)
    assert plain == "Head\n\nbold and code\n\na b | c c\n\ntext 1) x y\n\nquote\n\nend"
    assert one(plain).startswith("Head\n\nbold and code\n\na b | c c\n\ntext 1) x y") and one(None) is None and one("") == ""
    out = spark.createDataFrame([("One. Two! (Three.) Four",), (None,)], "t string").select(manuscript.sentences(F.col("t")).alias("s"), manuscript.paper_body(F.col("t")).alias("b")).collect()
    assert [s.strip() for s in out[0].s] == ["One.", "Two!", "(Three.)", "Four"] and out[1].s is None and out[1].b is None


def test_bodies(spark):
    para = " ".join(["word"] * 16)
    cases = [
        (f"no heading\n\n{para}\n\n" + " ".join(["12"] * 20), para),  # numbers are no running text
        (f"References\n\n{para}\n\n{para}", f"{para}\n\n{para}"),  # a heading at the very start closes nothing
        (f"title\n\nI NTRODUCTION\n{para} é-\nté\n\nReferences\nrest {para}", f"{para} été"),
        (f"Abstract. {para}\n\nAbstract\n{para} again\n", f"{para}\n\nAbstract {para} again"),
        ("", ""), ("few words", ""), (None, None),
    ]
    frame = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "k int, t string").select("k", manuscript.paper_body(F.col("t")).alias("b"))
    assert {r.k: r.b for r in frame.collect()} == {k: want for k, (_, want) in enumerate(cases)}


def test_numbers_behind_names(spark):
    """The legend's first number stands behind the last author's, and is read as one of theirs."""
    cases = [
        ("A Title Ann Lee 1,2 Bo Cy 2 Di Ek 3 1 MIT, Boston 2 Hanoi University 3 Some Lab {a,b}@x.org", ["Ann Lee", "Bo Cy", "Di Ek", "Not There", ""], ["MIT, Boston; Hanoi University", "Hanoi University", "Some Lab; MIT, Boston", "", ""]),
        ("Ann Lee1 Bo Cy1\n1 First Place\n1 Second Place ann@x.org", ["Ann Lee", "Bo Cy"], ["First Place", "First Place; First Place"]),
        ("Ann (Q.) Lee 1 1 Place; with more words 2 Other", ["Ann (Q.) Lee"], [""]),
        ("Ann Lee 4 1 MIT", ["Ann Lee"], ["MIT"]), ("", ["Ann Lee"], [""]), (None, ["Ann"], [""]), ("x", None, []), ("x", [], []),
    ]
    frame = spark.createDataFrame([(k, p, n) for k, (p, n, _) in enumerate(cases)], "k int, p string, n array<string>").select("k", pages.numbered_affiliations(F.col("p"), F.col("n")).alias("a"))
    assert {r.k: r.a for r in frame.collect()} == {k: want for k, (*_, want) in enumerate(cases)}


def candidate(stage, seq, title, year=2025, **values):
    base = dict.fromkeys(("slug", "stage", "seq", "venue", "year", "track", "title", "status", "listed", "available", "final", "exact", "aff", "home", "domestic", "any_aff", "any_home", "answer", "since", "role", "source"))
    base |= {"slug": "a-b", "stage": stage, "seq": seq, "venue": "iclr", "year": year, "track": "main", "title": title, "status": "accepted", "since": 2024, "available": True, "final": True, "source": "c-d"}
    base |= {k: False for k in ("listed", "exact", "home", "domestic", "any_aff", "any_home")}
    return tuple((base | values).values())


def test_records_are_settled_in_order(spark):
    note, shared, listed, page = resolution.OWN_NOTE, resolution.SHARED_NOTE, resolution.LIST, resolution.PAGE
    rows = [
        candidate(note, 1, "Accepted on the list", listed=True, status="rejected"),
        candidate(note, 2, "Rejected for good", status="rejected"),
        candidate(note, 3, "No decision on record", status="unknown"),
        candidate(note, 4, "Accepted on the list", track="workshop"),
        candidate(shared, 5, "Shared by name only", status="rejected"),
        candidate(shared, 6, "Shared by id", status="withdrawn", exact=True),
        candidate(listed, 7, "Accepted on the list!", aff="Far", listed=True),
        candidate(listed, 8, "Own institution", aff="Here", home=True, domestic=True),
        candidate(listed, 9, "Namesake abroad", aff="Far"),
        candidate(listed, 10, "No affiliation in the source"),
        candidate(listed, 11, "Before the move", year=2022, aff="Here", home=True, domestic=True),
        candidate(listed, 12, "Confirmed by hand", answer="yes"),
        candidate(page, 13, "Not yet in a list", final=False, role="own"),
        candidate(page, 14, "Missing from a final list", role="own"),
        candidate(page, 15, "Own institution", role="own", listed=True),
    ]
    out = resolution.resolve(spark.createDataFrame(rows, resolution.CANDIDATE)).collect()
    got = {(r.action, r.title, r.track): r.status for r in out}
    assert {k[1:]: v for k, v in got.items() if k[0] == "record"} == {
        ("Accepted on the list", "main"): "accepted",
        ("Accepted on the list", "workshop"): "accepted",
        ("Rejected for good", "main"): "rejected",
        ("No decision on record", "main"): "rejected",
        ("Shared by id", "main"): "withdrawn",
        ("Own institution", "main"): "accepted",
        ("Before the move", "main"): "accepted",
        ("Confirmed by hand", "main"): "accepted",
        ("Not yet in a list", "main"): "accepted",
    }
    assert {k[1] for k in got if k[0] == "queue"} == {"Shared by name only", "No affiliation in the source"}
    assert {k[1] for k in got if k[0] == "skipped"} == {"Namesake abroad"}
    assert {k[1] for k in got if k[0] == "warning"} == {"Accepted on the list", "Before the move", "Missing from a final list"}
