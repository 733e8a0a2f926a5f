"""Folders of files: packed ones, marks of missing ones, codings, places; and volumes that are read a line at a time."""

from __future__ import annotations

import gzip

from papertide.sources import landed_files, listings


def test_files_are_read_as_their_first_bytes_say(spark, tmp_path):
    for venue, year in (("acl", 2023), ("iclr", 2024)):
        (tmp_path / venue / str(year)).mkdir(parents=True)
    at = lambda name: tmp_path / name
    at("acl/2023/a.html").write_bytes("Études\nplain".encode())
    at("acl/2023/b.html.gz").write_bytes(gzip.compress("packed é".encode()))
    at("acl/2023/c.html").write_bytes("\ufeffmarked é".encode("utf-16"))
    at("acl/2023/d.html").write_bytes(b"\xef\xbb\xbfwith a mark")
    at("iclr/2024/e.html").write_bytes(b"\xfe\xff" + "the other way".encode("utf-16-be"))
    at("iclr/2024/f.html").write_bytes(b"broken \xff byte")
    at("iclr/2024/g.html.gz").write_bytes(gzip.compress(b"cut off" * 99)[:-12])
    at("iclr/2024/h.html.gz.missing").write_bytes(b"")
    at("iclr/2024/i.html").write_bytes(b"")
    got = {r.name: (r.venue, r.year, r.missing, r.body) for r in landed_files.landed(spark, str(tmp_path)).collect()}
    assert got == {
        "a.html": ("acl", 2023, False, "Études\nplain"), "b.html": ("acl", 2023, False, "packed é"), "c.html": ("acl", 2023, False, "\ufeffmarked é"), "d.html": ("acl", 2023, False, "with a mark"),
        "e.html": ("iclr", 2024, False, "the other way"), "f.html": ("iclr", 2024, False, "broken \ufffd byte"), "g.html": ("iclr", 2024, False, None), "h.html": ("iclr", 2024, True, None),
    }
    assert landed_files.landed(spark, str(tmp_path), "*.gz").where("not missing").count() == 2


def test_readers_of_pages_take_folders(spark, tmp_path):
    (tmp_path / "ijcai/2024").mkdir(parents=True)
    page = '<div class="section_title"><h3>Main Track</h3></div><div id="paper7" class="paper_wrapper"><div class="title">T %s</div><div class="authors">A B, C D</div><div class="details"><a href="7.pdf">PDF</a><a href="/proceedings/2024/7">Details</a></div></div>'
    for k in range(3):
        (tmp_path / f"ijcai/2024/{k}.html.gz").write_bytes(gzip.compress((page % k).encode()))
    got = listings.ijcai_pages(landed_files.landed(spark, str(tmp_path)).select("venue", "year", "body")).collect()
    assert sorted((r.venue, r.year, r.title, len(r.authors)) for r in got) == [("ijcai", 2024, f"T {k}", 2) for k in range(3)]


def entries(lines):
    table, out = landed_files.Entries(), []
    for line in lines:
        out += table.eval(type("Row", (), {"line": line, "path": "p", "venue": "v", "year": 1}))
    return table, out


def test_entries_come_as_soon_as_they_are_closed():
    table, out = entries(["% note", "@inproceedings{a, title={A {B}},", " author={X Y}", "} @misc{b, note={n}} rest", "@inproceedings{c, title={never closed,", "more", '@inproceedings{d, title="D", author={E}}', "@broken"])
    assert [(r[3], r[4], r[5], r[6].get("title")) for r in out] == [(0, "inproceedings", "a", "A {B}"), (1, "misc", "b", None), (2, "inproceedings", "d", "D")]
    assert not table.text and table.depth == 0


def test_a_volume_is_held_an_entry_at_a_time():
    """Memory does not grow with the volume: after each line no more than the open entry is held."""
    table, most, found = landed_files.Entries(), 0, 0
    for k in range(20_000):
        for line in (f"@inproceedings{{p{k},", f" title = {{Title {k}}},", " author = {A B}", "}"):
            found += len(list(table.eval(type("Row", (), {"line": line, "path": "p", "venue": "v", "year": 1}))))
            most = max(most, sum(map(len, table.text)))
    assert found == 20_000 and most < 100


def test_volumes_in_blocks(spark, tmp_path):
    """A volume that is read in many blocks gives its entries in order."""
    (tmp_path / "acl/2024").mkdir(parents=True)
    (tmp_path / "acl/2024/v.bib").write_text("\n".join(f"@inproceedings{{p{k},\n title = {{Title {k}}},\n author = {{Last{k}, First}}\n}}" for k in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        lines = landed_files.volume_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 3
        got = landed_files.bib_entries(lines).orderBy("seq").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.fields["title"] for r in got] == [f"Title {k}" for k in range(3000)] and {(r.venue, r.year) for r in got} == {("acl", 2024)}
