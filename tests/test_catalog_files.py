import base64
import io
import zipfile
from xml.etree import ElementTree

from pyspark.sql import functions as F

from foliospark.operators import feeds, ids, ingest
from foliospark.operators.books import name_list
from foliospark.sources import archives, metadata
from foliospark.streaming import ingest as streams

FB2 = """<?xml version="1.0" encoding="{enc}"?>
<FictionBook xmlns="http://www.gribuser.ru/xml/fictionbook/2.0" xmlns:l="http://www.w3.org/1999/xlink"><description><title-info><genre>sf</genre><genre>prose</genre>
<author><first-name>Jane</first-name><last-name>Doe</last-name></author><author><nickname>ghost</nickname></author><book-title>Тест</book-title>
<annotation><p>a <emphasis>b</emphasis></p></annotation><coverpage><image l:href="#c.jpg"/></coverpage><lang>ru</lang><sequence name="S" number="3"/></title-info>
<publish-info><publisher>P</publisher></publish-info></description><body><p>x</p></body><binary id="c.jpg" content-type="image/png">{cover}</binary></FictionBook>"""


def zipped(files: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def epub(meta: str, item: str, path: str) -> bytes:
    container = '<?xml version="1.0"?><container><rootfiles><rootfile full-path="OPS/p.opf"/></rootfiles></container>'
    package = f'<package xmlns:dc="d"><metadata><dc:title>T</dc:title><dc:creator>A</dc:creator><dc:language>en</dc:language><dc:subject>s1</dc:subject><dc:subject>s2</dc:subject>{meta}</metadata><manifest><item id="x" href="t.html" media-type="text/html"/>{item}</manifest></package>'
    return zipped({"META-INF/container.xml": container.encode(), "OPS/p.opf": package.encode(), path: b"IMG"})


def test_index_to_catalog(spark, tmp_path):
    line = lambda *f: "\x04".join(f)
    good = line("Doe,Jane,Q:Roe,Sam:", "sf:prose:", "Title", "Ser", "3", "f1", "10", "", "0", "FB2", "", "", "Arc-1.zip", "en")
    rows = [good, line("", "sf:", "T2", "", "x", "f2", "", "", "x", "fb2", "", "", "arc-1.ZIP"), line("A", "", "T3", "", "", "f3", "", "", "1", "fb2", "", "", "Arc-1.zip"),
            line("A", "", "T4", "", "", "f4", "", "", "0", "fb2", "", "", "other.zip"), line("A", "", "", "", "", "f5"), line("B,C", "g:", "Title", "", "9", "f1", "99", "", "0", "fb2", "", "", "Arc-1.zip"), line("A", "", "T6", "", "", "f6")]
    (tmp_path / "lib.inpx").write_bytes(zipped({"lib/ARC-1.inp": "\r\n".join(rows).encode(), "collection.info": b"lib/ARC-1.inp\nx", "other.txt": b"no"}))
    (tmp_path / "Arc-1.zip").write_bytes(zipped({"f1.fb2": b"x"}))
    lines = archives.read_inpx(spark, str(tmp_path))
    assert lines.count() == 7 and archives.read_layout(spark, str(tmp_path)).first().layout == ingest.DEFAULT_LAYOUT
    assert archives.latest_source(spark, str(tmp_path)).first().source.endswith("lib.inpx")
    lines = lines.join(archives.read_layout(spark, str(tmp_path)).select("source", "collection"), "source")
    records = ingest.resolve_archive(ingest.valid_records(ingest.parse_records(lines)), archives.archive_manifest(spark, str(tmp_path)))
    got = {(r.title, r.file_name, r.zip, tuple(r.authors), r.series_no, r.file_size, r.language) for r in records.collect()}
    assert got == {("Title", "f1", "Arc-1.zip", ("Doe Jane Q", "Roe Sam"), 3, 10, "en"), ("T2", "f2", "Arc-1.zip", ("Неизвестный автор",), 0, 0, "unknown"), ("Title", "f1", "Arc-1.zip", ("B C",), 9, 99, "unknown"), ("T6", "f6", "Arc-1.zip", ("A",), 0, 0, "unknown")}
    none = spark.createDataFrame([], "book_id long, title string, series string, series_no long, file_name string, zip string, format string, file_size long, language string, del int, added_at timestamp")
    once = ingest.merge_records(records, none, "2024-01-01 00:00:00").cache()
    again = ingest.merge_records(records, once, "2025-01-01 00:00:00")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, again.collect())) and once.where("title = 'Title'").first().file_size == 10
    dim = ids.assign_ids(records.select(F.explode("authors").alias("name")), None, "name", "author_id")
    bridge = ingest.attach_links(records, once, dim, spark.createDataFrame([], "book_id long, author_id long"), "authors", "author_id", "name")
    names = {r.book_id: r.names for r in name_list(bridge, dim, "author_id", "name", "names").collect()}
    assert names[once.where("title = 'Title'").first().book_id] == ["B C", "Doe Jane Q", "Roe Sam"]
    log = spark.sql("select 'a' as source, timestamp'2024-01-01' as mtime")
    files = spark.sql("select * from values ('a', timestamp'2024-01-02'), ('b', timestamp'2020-01-01') as t(source, mtime)")
    assert {r.source for r in ingest.pending_sources(files, log).collect()} == {"a", "b"} and ingest.pending_sources(files, ingest.logged(log, files)).count() == 0
    ingest.write_catalog({"books": once, "book_authors": bridge}, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "book_authors")).count() == bridge.count()


def test_book_files(spark, tmp_path):
    cover = base64.b64encode(b"PNG").decode()
    held = {"f1.fb2": FB2.format(enc="utf-8", cover=cover).encode(), "dir/F2.FB2": FB2.format(enc="windows-1251", cover=cover).encode("cp1251"), "bad.fb2": b"<FictionBook><body/></FictionBook>",
            "e1.epub": epub('<meta name="cover" content="c"/>', '<item id="c" href="img/c.jpg" media-type="image/jpeg"/>', "OPS/img/c.jpg"), "e2.epub": epub("", '<item id="z" href="c.png" media-type="image/png" properties="cover-image"/>', "other/c.png")}
    (tmp_path / "a.zip").write_bytes(zipped(held))
    rows = archives.read_archive_members(spark, str(tmp_path))
    info = {r.member: r for r in metadata.fb2_metadata(rows).collect()}
    for name in ("f1.fb2", "dir/F2.FB2"):
        t = info[name].title_info
        assert (t.book_title, t.genre, t.author, t.sequence, t.lang) == ("Тест", ["sf", "prose"], ["Doe Jane", "ghost"], ["S #3"], "ru")
        assert t.annotation_html == "<p>a <i>b</i></p>" and info[name].publish_info.publisher == "P" and info[name].src_title_info is None
    assert {(r.member, r.mime, bytes(r.cover)) for r in metadata.fb2_covers(rows).collect()} == {("f1.fb2", "image/png", b"PNG"), ("dir/F2.FB2", "image/png", b"PNG")}
    assert {(r.member, r.mime, bytes(r.cover)) for r in metadata.epub_covers(rows).collect()} == {("e1.epub", "image/jpeg", b"IMG"), ("e2.epub", "image/png", b"IMG")}
    assert {(r.member, r.title_info.book_title, r.title_info.keywords) for r in metadata.epub_metadata(rows).collect()} == {("e1.epub", "T", "s1, s2"), ("e2.epub", "T", "s1, s2")}
    books = spark.createDataFrame([(1, "a.zip", "f1", "fb2"), (2, "a.zip", "f2", "fb2"), (3, "a.zip", "e1.epub", "epub"), (4, "a.zip", "zz", "pdf")], "book_id long, zip string, file_name string, full_format string")
    assert {(r.book_id, r.member) for r in archives.book_members(books, rows).collect()} == {(1, "f1.fb2"), (2, "dir/F2.FB2"), (3, "e1.epub")}


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = lambda t, f: "\x04".join(["A", "g:", t, "", "", f, "1", "", "0", "fb2", "", "", "a.zip", "en"])
    (tmp_path / "in" / "a.inp").write_text("\n".join([line("T1", "f1"), line("T2", "f2"), line("T1", "f1")]))
    (tmp_path / "in" / "b.inp").write_text("\n".join([line("T2", "f2"), line("T3", "f3")]))
    records = ingest.parse_records(streams.stream_lines(spark, str(tmp_path / "in"))).withColumn("zip", F.col("folder"))
    out = str(tmp_path / "out")
    streams.stream_ingest(streams.stream_dedup(records), lambda df, _: df.write.mode("append").parquet(out), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.title for r in spark.read.parquet(out).collect()) == ["T1", "T2", "T3"]


def test_feed_as_xml(spark, tmp_path):
    book = spark.sql("select 1L as book_id, 'A/b  c' as title, 'S' as series, 0L as series_no, 'f 1' as file_name, 'a.zip' as zip, 'fb2' as format, 'en' as language, timestamp'2024-01-02 03:04:05' as added_at, 'X Y' as author, 'g1, g2' as genre")
    e = feeds.feed_entries(book, "http://h", True)
    r = e.first()
    assert (r.title, r.updated, r.links[0].href) == ("— A/b  c", "2024-01-02T03:04:05Z", "http://h/download/1/Ab%20c%20-%20X%20Y.fb2")
    assert r.links[1].href == "http://h/api/cover?file=f+1&format=fb2&zip=a.zip" and [c.term for c in r.categories] == ["g1", "g2"]
    more = book.withColumns({"book_id": F.lit(2).cast("long"), "title": F.lit("<&> \"q\""), "language": F.lit(""), "genre": F.lit(""), "author": F.lit(""), "added_at": F.lit(None).cast("timestamp")})
    entries = feeds.feed_entries(book.unionByName(more), "http://h").withColumns({"feed": F.lit("k 1"), "place": F.col("book_id")})
    feeds.export_feed(feeds.atom_feeds(entries, "http://h", F.lit("My list"), F.lit("http://h/list"), F.lit("2024-05-06 07:08:09")), str(tmp_path / "feed"))
    (file,) = (p for p in (tmp_path / "feed").rglob("*.txt"))
    root = ElementTree.fromstring(file.read_text("utf-8"))
    a, dc = "{http://www.w3.org/2005/Atom}", "{http://purl.org/dc/terms/}"
    assert root.tag == f"{a}feed" and file.parent.name == "feed=k 1"
    assert [root.findtext(a + x) for x in ("id", "title", "updated")] == ["urn:uuid:acquisition-feed-My_list-1714979289", "My list", "2024-05-06T07:08:09Z"] and root.findtext(f"{a}author/{a}name") == "Web Books Server"
    assert [(x.get("rel"), x.get("href")) for x in root.findall(f"{a}link")] == [("start", "http://h/opds/"), ("self", "http://h/list"), ("search", "http://h/opds/opensearch"), ("search", "http://h/opds/search?term={searchTerms}")]
    one, two = root.findall(f"{a}entry")
    assert (one.findtext(f"{a}id"), one.findtext(f"{a}title"), one.findtext(f"{a}updated"), one.findtext(f"{dc}language"), one.findtext(f"{dc}identifier")) == ("urn:uuid:book-1", "A/b  c", "2024-01-02T03:04:05Z", "en", "BookID:1")
    assert one.find(f"{a}content").get("type") == "text" and one.find(f"{a}content").text.startswith("Автор: X Y")
    assert [(x.get("term"), x.get("label")) for x in one.findall(f"{a}category")] == [("g1", "g1"), ("g2", "g2")]
    assert [x.get("type") for x in one.findall(f"{a}link")] == ["application/fb2", "image/jpeg", "image/jpeg"] and one.find(f"{a}link").get("title") == "Скачать A/b  c (FB2)" and "title" not in one.findall(f"{a}link")[1].attrib
    assert two.findtext(f"{a}title") == '<&> "q"' and two.findtext(f"{a}updated") == "0001-01-01T00:00:00Z" and two.find(f"{dc}language") is None and two.findall(f"{a}category") == [] and two.find(f"{a}author/{a}name") is not None


def test_two_layouts_in_one_job(spark):
    lines = spark.createDataFrame([("a", "m", 0, "A,B:|g:|T|||f"), ("b", "m", 0, "T2|f2|X:|arc.zip|T3"), ("c", "m", 0, "T4|f4")], "source string, member string, line_no long, line string")
    layouts = spark.createDataFrame([("a", " ", "x/C1.inp"), ("b", "TITLE; file;author;Folder;title", None), ("c", "title;file", None)], "source string, layout string, collection string")
    got = {r.source: (r.title, r.file_name, r.authors, r.folder, r.genres) for r in ingest.parse_records(ingest.with_layouts(lines, layouts)).collect()}
    assert got == {"a": ("T", "f", ["A B"], "c1.zip", ["g"]), "b": ("T2", "f2", ["X"], "arc.zip", []), "c": ("T4", "f4", [], ".zip", [])}


def test_lists_of_names_are_built_after_the_exchange_alone(spark):
    """lists were begun before the exchange, too, though a book has few names in a task."""
    bridge = spark.createDataFrame([(1, 2), (1, 1), (2, 1), (3, 9)], "book_id long, author_id long")
    authors = spark.createDataFrame([(1, "a"), (2, "b")], "author_id long, name string")
    out = name_list(bridge, authors, "author_id", "name", "authors")
    assert sorted((r.book_id, r.authors) for r in out.collect()) == [(1, ["a", "b"]), (2, ["a"])]
    plan = out._jdf.queryExecution().executedPlan().toString()  # the last step stands first
    assert plan.index("partial_collect_list") < plan.index("Exchange hashpartitioning(book_id")


def test_feed_entries_keep_columns_of_the_books(spark):
    """F16: books were joined once more for their archive and time."""
    wide = spark.createDataFrame([(1, "T", None, 0, "f", "fb2", "a.zip", "ru", "Jane", "sf", None)], "book_id long, title string, series string, series_no long, file_name string, format string, zip string, language string, author string, genre string, added_at timestamp")
    row = feeds.feed_entries(wide, "http://x", keep=("zip", "added_at")).first()
    assert row.zip == "a.zip" and row.added_at is None and row.id == "urn:uuid:book-1"
