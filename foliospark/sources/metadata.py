"""Metadata and covers from book files, as table jobs over archive members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions import text as X
from foliospark.sources.archives import members
from foliospark.storage import written

# Charsets of XML declarations that are decoded as such; any other is UTF-8.
CHARSETS = ("windows-1251", "koi8-r", "iso-8859-5", "utf-8")

_PERSON = "struct<`first-name`:string,`middle-name`:string,`last-name`:string,nickname:string>"
_SEQUENCE = "struct<_name:string,_number:string>"
_IMAGE = "struct<`_l:href`:string,`_xlink:href`:string,_href:string>"
FB2_SCHEMA = (
    f"struct<description:struct<`title-info`:struct<genre:array<string>,author:array<{_PERSON}>,`book-title`:string,annotation:string,keywords:string,date:string,"
    f"coverpage:struct<image:array<{_IMAGE}>>,lang:string,`src-lang`:string,translator:array<{_PERSON}>,sequence:array<{_SEQUENCE}>>,"
    f"`src-title-info`:struct<`book-title`:string,author:array<{_PERSON}>,date:string,lang:string,sequence:array<{_SEQUENCE}>>,"
    f"`publish-info`:struct<`book-name`:string,publisher:string,city:string,year:string,isbn:string,sequence:array<{_SEQUENCE}>>,"
    f"`document-info`:struct<author:array<{_PERSON}>,`program-used`:string,date:string,id:string,version:string,`src-ocr`:string,history:string>>,"
    "binary:array<struct<_id:string,`_content-type`:string,_VALUE:string>>>"
)
EPUB_SCHEMA = (
    "struct<metadata:struct<`dc:title`:array<string>,`dc:creator`:array<string>,`dc:description`:array<string>,`dc:language`:array<string>,`dc:publisher`:array<string>,`dc:date`:array<string>,"
    "`dc:identifier`:array<string>,`dc:subject`:array<string>,meta:array<struct<_name:string,_content:string>>>,manifest:struct<item:array<struct<_id:string,_href:string,`_media-type`:string,_properties:string>>>>"
)
CONTAINER_SCHEMA = "struct<rootfiles:struct<rootfile:array<struct<`_full-path`:string>>>>"


#: What the bytes 0x80 to 0xFF of the charsets of one byte stand for; Latin-1 has the same characters below.
_HIGH = bytes(range(0x80, 0x100)).decode("latin-1")


def _of_one_byte(content: Column, charset: str) -> Column:
    """Text of a charset of one byte: Latin-1 with the upper half exchanged."""
    meant = bytes(range(0x80, 0x100)).decode(charset, errors="replace")
    return F.translate(F.decode(content, "ISO-8859-1"), _HIGH, meant)


def decode_text(content) -> Column:
    """Text by the charset of the XML declaration; bytes that do not decode become the replacement character."""
    data = X.col(content)
    head = F.decode(F.substring(data, 1, 200), "ISO-8859-1")
    name = F.lower(F.regexp_extract(head, "encoding=[\"']([A-Za-z0-9_-]+)", 1))
    cases = [(name == charset, _of_one_byte(data, charset)) for charset in CHARSETS if charset != "utf-8"]
    text = X.chosen(cases, F.make_valid_utf8(data.cast("string")))
    return F.regexp_replace(text, "^\ufeff+", "")


def fb2_documents(held: DataFrame) -> DataFrame:
    """held with doc: the parsed document of members that end in .fb2."""
    text = F.regexp_replace(decode_text("content"), "^\\s*<\\?xml[^>]*\\?>", "")
    return held.where(F.endswith(F.lower("member"), F.lit(".fb2"))).withColumn("doc", F.from_xml(text, FB2_SCHEMA, {"rowTag": "FictionBook"}))


def _people(people: Column) -> Column:
    return F.coalesce(F.transform(people, X.person_name), F.array().cast("array<string>"))


def _sequences(sequences: Column) -> Column:
    return F.coalesce(F.transform(sequences, X.sequence_label), F.array().cast("array<string>"))


def fb2_metadata(held: DataFrame) -> DataFrame:
    """(zip, member, title_info, src_title_info, publish_info, document_info); src only with a title, publish only with a book name or a publisher."""
    rows = fb2_documents(held)
    d = F.col("doc.description")
    t, s, p, i = (d[x] for x in ("title-info", "src-title-info", "publish-info", "document-info"))
    title = F.struct(
        t["book-title"].alias("book_title"), t["genre"].alias("genre"), _people(t["author"]).alias("author"), X.clean_annotation(t["annotation"]).alias("annotation_html"), t["keywords"].alias("keywords"),
        t["date"].alias("date"), t["lang"].alias("lang"), t["src-lang"].alias("src_lang"), _people(t["translator"]).alias("translator"), _sequences(t["sequence"]).alias("sequence"),
    )
    src = F.struct(s["book-title"].alias("book_title"), _people(s["author"]).alias("author"), s["date"].alias("date"), s["lang"].alias("lang"), _sequences(s["sequence"]).alias("sequence"))
    publish = F.struct(*(p[x].alias(x.replace("-", "_")) for x in ("book-name", "publisher", "city", "year", "isbn")), _sequences(p["sequence"]).alias("sequence"))
    document = F.struct(_people(i["author"]).alias("author"), *(i[x].alias(x.replace("-", "_")) for x in ("program-used", "date", "id", "version", "src-ocr")), X.clean_annotation(i["history"]).alias("history_html"))
    filled = lambda x: F.coalesce(x, F.lit("")) != ""
    return rows.select("zip", "member", title.alias("title_info"), F.when(filled(s["book-title"]), src).alias("src_title_info"), F.when(filled(p["book-name"]) | filled(p["publisher"]), publish).alias("publish_info"), document.alias("document_info"))


def fb2_covers(held: DataFrame) -> DataFrame:
    """(zip, member, mime, cover): the binary that the cover page names."""
    rows = fb2_documents(held)
    image = F.get(F.col("doc.description.title-info.coverpage.image"), 0)
    name = F.regexp_replace(F.coalesce(image["_l:href"], image["_xlink:href"], image["_href"]), "^#", "")
    each = rows.select("zip", "member", name.alias("name"), F.explode("doc.binary").alias("b")).where(F.col("b._id") == F.col("name"))
    return each.select("zip", "member", F.coalesce("b._content-type", F.lit("image/jpeg")).alias("mime"), F.unbase64(F.regexp_replace("b._VALUE", "\\s", "")).alias("cover"))


def epub_parts(held: DataFrame) -> DataFrame:
    """(zip, member, part, data): the members of the epub members. Who reads them more than once writes them, as each read would unpack all archives again."""
    epubs = held.where(F.endswith(F.lower("member"), F.lit(".epub")))
    key = F.concat_ws("\x04", "zip", "member")
    parts = members(epubs.select(key.alias("path"), "content"))
    return parts.select(F.split_part("source", F.lit("\x04"), F.lit(1)).alias("zip"), F.split_part("source", F.lit("\x04"), F.lit(2)).alias("member"), F.col("member").alias("part"), F.col("content").alias("data"))


def epub_packages(parts: DataFrame) -> DataFrame:
    """(zip, member, part, package): the package document that the container names."""
    xml = F.regexp_replace(decode_text("data"), "^\\s*<\\?xml[^>]*\\?>", "")
    container = parts.where(F.col("part") == "META-INF/container.xml").withColumn("c", F.from_xml(xml, CONTAINER_SCHEMA, {"rowTag": "container"}))
    path = container.select("zip", "member", F.get(F.col("c.rootfiles.rootfile"), 0)["_full-path"].alias("part"))
    return parts.join(path, ["zip", "member", "part"]).select("zip", "member", "part", F.from_xml(xml, EPUB_SCHEMA, {"rowTag": "package"}).alias("package"))


def epub_metadata(held: DataFrame) -> DataFrame:
    m = F.col("package.metadata")
    one = lambda x: F.get(m[f"dc:{x}"], 0)
    title = F.struct(one("title").alias("book_title"), m["dc:creator"].alias("author"), one("description").alias("annotation_html"), one("language").alias("lang"), F.array_join(m["dc:subject"], ", ").alias("keywords"))
    publish = F.struct(one("publisher").alias("publisher"), one("date").alias("year"), one("identifier").alias("isbn"))
    return epub_packages(written(epub_parts(held))).select("zip", "member", title.alias("title_info"), publish.alias("publish_info"))


def epub_covers(held: DataFrame) -> DataFrame:
    """(zip, member, mime, cover): the item that `meta name=cover` names, else the first image item whose id holds cover or whose properties hold cover-image; by path, else by base name."""
    parts = written(epub_parts(held))
    packages = epub_packages(parts)
    cover_id = F.get(F.filter("package.metadata.meta", lambda x: x["_name"] == "cover"), 0)["_content"]
    items = packages.select("zip", "member", "part", cover_id.alias("cover_id"), F.posexplode("package.manifest.item").alias("at", "item"))
    image = F.startswith("item._media-type", F.lit("image/"))
    told = F.contains(F.lower("item._id"), F.lit("cover")) | F.contains(F.coalesce("item._properties", F.lit("")), F.lit("cover-image"))
    tier = F.when(F.col("item._id") == F.col("cover_id"), 0).when(image & told, 1)
    chosen = items.withColumn("tier", tier).where("tier is not null").groupBy("zip", "member").agg(F.min(F.struct("tier", "at", "part", F.col("item._href").alias("href"), F.col("item._media-type").alias("mime"))).alias("x"))
    path = F.concat(F.regexp_extract("x.part", "^(.*/)?", 0), F.col("x.href"))
    asked = chosen.select("zip", "member", "x.mime", path.alias("path"), F.regexp_extract("x.href", "[^/]*$", 0).alias("base"))
    with_base = parts.withColumn("base", F.regexp_extract("part", "[^/]*$", 0))
    hits = with_base.join(asked, ["zip", "member", "base"]).select("zip", "member", "part", "mime", F.when(F.col("part") == F.col("path"), 0).otherwise(1).alias("tier"))
    best = hits.groupBy("zip", "member").agg(F.min(F.struct("tier", "part", "mime")).alias("x")).select("zip", "member", "x.part", "x.mime")
    return parts.join(best, ["zip", "member", "part"]).select("zip", "member", F.coalesce("mime", F.lit("image/jpeg")).alias("mime"), F.col("data").alias("cover"))
