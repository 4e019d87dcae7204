"""Texts of book files are decoded by Spark as Python decodes them."""

import random
import re

from foliospark.sources import metadata


def decoded(data):
    found = re.search(rb"encoding=[\"']([A-Za-z0-9_-]+)", data[:200])
    name = found[1].decode().lower() if found else "utf-8"
    return data.decode(name if name in metadata.CHARSETS else "utf-8", errors="replace").lstrip("﻿")


def test_decoding_equals_python_and_needs_none(spark):
    rng = random.Random(7)
    heads = [b"", *(b"<?xml encoding='" + c + b"'?>" for c in (b"windows-1251", b"KOI8-R", b"iso-8859-5", b"utf-8", b"other"))]
    rows = [h + bytes(range(256)) for h in heads] + [b"\xef\xbb\xbf\xef\xbb\xbfa\xef\xbb\xbf", b"", b" " * 190 + b"encoding='koi8-r' \xc1", "ёлка 🎄".encode()]
    pieces = [b"a", b"\xd0", b"\xb6", b"\xe2\x82", b"\xac", b"\xf0\x9f", b"\x8e\x84", b"\xed\xa0\x80", b"\xc0\x80", b"\xf4\x90\x80\x80", b"\xff", b"\n", b"\xe0\x80", b"\xf0\x80\x80"]
    rows += [rng.choice(heads) + b"".join(rng.choices(pieces, k=rng.randint(0, 9))) for _ in range(500)]
    out = spark.createDataFrame([(bytearray(r),) for r in rows], "content binary").select("content", metadata.decode_text("content").alias("text"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    for r in out.collect():
        assert r.text == decoded(bytes(r.content)), bytes(r.content)


def test_archives_in_cells_are_unpacked_once_in_small_batches(spark):
    import io
    import zipfile

    package = '<package><metadata><dc:title xmlns:dc="d">T</dc:title><meta name="cover" content="i"/></metadata><manifest><item id="i" href="c.png" media-type="image/png"/></manifest></package>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in (("META-INF/container.xml", '<container><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>'), ("o/p.opf", package), ("o/c.png", "pic")):
            z.writestr(name, text)
    held = spark.createDataFrame([("a.zip", "b.epub", bytearray(out.getvalue()))], "zip string, member string, content binary")
    meta, covers = metadata.epub_metadata(held), metadata.epub_covers(held)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 500
    for df in (meta, covers):
        assert "MapInPandas" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert [r.title_info.book_title for r in meta.collect()] == ["T"] and [(r.mime, bytes(r.cover)) for r in covers.collect()] == [("image/png", b"pic")]
