"""Text rules of the catalog as expressions from Column to Column; no Python runs on rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
UNKNOWN_AUTHOR = "Неизвестный автор"
ALL_LANGUAGES = "Все языки"
PREFERRED_LANGUAGES = ("ru", "rus", "ru-ru")
UNKNOWN_LANGUAGES = ("", "unknown")
MIME_TYPES = {
    "fb2": "application/fb2", "epub": "application/epub+zip", "mobi": "application/x-mobipocket-ebook", "pdf": "application/pdf", "djvu": "image/vnd.djvu",
    "txt": "text/plain", "doc": "application/msword", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "rtf": "application/rtf",
    "html": "text/html", "htm": "text/html",
}
ANNOTATION_TAGS = (
    ("<subtitle>", "<p><b>"), ("</subtitle>", "</b></p>"), ("<empty-line/>", "<br>"), ("<empty-line />", "<br>"), ("<strong>", "<b>"), ("</strong>", "</b>"), ("<emphasis>", "<i>"), ("</emphasis>", "</i>"),
    ("<stanza>", "<br>"), ("</stanza>", ""), ("<poem>", "<br>"), ("</poem>", ""), ("<cite>", "<i>"), ("</cite>", "</i>"), ("<table>", "<br>"), ("</table>", ""), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"),
)
OTHER_MIME = "application/octet-stream"
#: Formats that a file name tells by its ending, and those that it tells by any part of it.
SUFFIX_FORMATS = {s: "html" if s == "htm" else s for s in MIME_TYPES}
PART_FORMATS = ("fb2", "epub", "mobi", "pdf", "djvu")

SPACE = "(?U)\\s+"
#: Runs of white space but single spaces, which may stay.
ODD_SPACE = "(?U)\\s{2,}|[\\s&&[^ ]]"
#: What (?U)\\s matches, one by one.
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def chosen(cases: list[tuple[Column, Column]], other: Column) -> Column:
    """The value of the first case that holds."""
    return reduce(lambda rest, case: F.when(case[0], case[1]).otherwise(rest), reversed(cases), other)


def trimmed(s) -> Column:
    """Without white space of any script at the ends."""
    return F.btrim(col(s), F.lit(SPACES))


def squeezed(s) -> Column:
    return trimmed(F.regexp_replace(col(s), ODD_SPACE, " "))


def squeeze_lower(s) -> Column:
    return F.lower(squeezed(s))


def ascii_lower(s) -> Column:
    return F.translate(col(s), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(s) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(col(s)), F.lit("[\\p{L}\\p{Nd}]+"), F.lit(0))


def parse_authors(s) -> Column:
    """`Last,First:Last2,First2` as names; the fixed unknown author where none is left."""
    spaced = F.regexp_replace(F.replace(F.coalesce(col(s), F.lit("")), F.lit(","), F.lit(" ")), ODD_SPACE, " ")
    # told by a pattern, as a case would parse the names twice
    names = F.regexp_replace(F.btrim(spaced, F.lit(" :")), "^$", UNKNOWN_AUTHOR)
    return F.split(names, " ?:[ :]*")


def split_genres(s) -> Column:
    return F.filter(F.split(F.coalesce(col(s), F.lit("")), ":"), lambda g: g != "")


def normalize_author(s) -> Column:
    """`Last, First` as `First Last`, split at the first comma."""
    s = squeezed(s)
    parts = F.split(s, ",", 2)
    turned = F.concat_ws(" ", trimmed(F.get(parts, 1)), trimmed(F.get(parts, 0)))
    return F.when(F.contains(s, F.lit(",")), trimmed(turned)).otherwise(s)


def author_variants(s) -> Column:
    """The squeezed name, and the name with its first word moved to the end."""
    s = squeezed(s)
    parts = F.split(s, " ", 2)
    return F.when(F.size(parts) == 2, F.array(s, F.concat_ws(" ", F.get(parts, 1), F.get(parts, 0)))).otherwise(F.array(s))


def contains_all_terms(s, terms: Column) -> Column:
    return F.forall(terms, lambda t: F.contains(F.lower(col(s)), t))


def contains_all_words(title, query) -> Column:
    words = tokens(query)
    return (F.size(words) > 0) & (F.size(F.array_except(words, tokens(title))) == 0)


def contains_phrase(title, query) -> Column:
    """Whole words, next to each other and in order."""
    padded = lambda w: F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
    words = tokens(query)
    return (F.size(words) > 0) & F.contains(padded(tokens(title)), padded(words))


def title_priority(title, query) -> Column:
    """0 the same words, 1 the phrase, 2 all words, 3 a substring of the lower-cased title, 4 none."""
    q, words = squeeze_lower(query), tokens(query)
    same = (F.size(words) > 0) & (tokens(title) == words)
    found = F.contains(F.lower(col(title)), q)
    cases = [(q == "", F.lit(4)), (same, F.lit(0)), (contains_phrase(title, query), F.lit(1)), (contains_all_words(title, query), F.lit(2)), (found, F.lit(3))]
    return chosen(cases, F.lit(4))


def author_priority(authors, query) -> Column:
    """By the first author who matches a variant or holds all terms: 1 alone, 2 first of two, 3 first of more, 4 later; 5 none."""
    variants = F.transform(author_variants(query), lambda v: F.lower(v))
    terms = F.filter(F.split(squeeze_lower(query), " "), lambda t: t != "")
    fits = lambda a: F.array_contains(variants, F.lower(a)) | ((F.size(terms) > 0) & F.forall(terms, lambda t: F.contains(F.lower(a), t)))
    authors = col(authors)
    first = F.array_position(F.transform(authors, lambda a: F.coalesce(fits(a), F.lit(False))), True)
    n = F.size(authors)
    return chosen([(F.coalesce(first, F.lit(0)) == 0, F.lit(5)), (first > 1, F.lit(4)), (n == 1, F.lit(1)), (n == 2, F.lit(2))], F.lit(3))


def title_class(language, title) -> Column:
    lang = F.lower(trimmed(F.coalesce(col(language), F.lit(""))))
    other = F.when(lang.isin(*PREFERRED_LANGUAGES, *UNKNOWN_LANGUAGES), 0).otherwise(100)
    return other + F.when(F.rlike(col(title), F.lit("[\\p{P}\\p{S}]")), 1).otherwise(0)


def title_key(language, title) -> Column:
    """Sort key of titles: the class, the folded title, the title."""
    return F.struct(title_class(language, title).alias("class"), squeeze_lower(title).alias("folded"), col(title).alias("title"))


def ensure_format(fmt, file_name) -> Column:
    name = F.lower(F.coalesce(col(file_name), F.lit("")))
    cases = [(F.endswith(name, F.lit(f".{s}")), F.lit(f)) for s, f in SUFFIX_FORMATS.items()] + [(F.contains(name, F.lit(f)), F.lit(f)) for f in PART_FORMATS]
    told = chosen(cases, F.lit("unknown"))
    return F.when(F.coalesce(col(fmt), F.lit("")).isin("", "unknown"), told).otherwise(col(fmt))


def mime_type(fmt) -> Column:
    table = F.create_map(*(F.lit(x) for pair in MIME_TYPES.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.lower(col(fmt))), F.lit(OTHER_MIME))


def safe_filename(s) -> Column:
    return trimmed(F.regexp_replace(trimmed(s), '[/\\\\:*?"<>|\\p{Cc}]', ""))


def reader_filename(s) -> Column:
    s = F.coalesce(col(s), F.lit(""))
    kept = F.regexp_replace(trimmed(s), "(?U)[^a-zA-Z0-9а-яА-ЯёЁ\\s\\-.]", "")
    return F.when(s == "", F.lit("book")).otherwise(F.regexp_replace(kept, SPACE, "_"))


def normalize_genre_code(s) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col(s)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def size_mb(n) -> Column:
    return F.format_string("%.2f", col(n) / F.lit(1048576.0))


def query_escape(s) -> Column:
    """Of a url's query: a space is `+`."""
    return F.replace(F.replace(F.url_encode(col(s)), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def path_escape(s) -> Column:
    """Of one part of a url's path: a space is `%20`, and `$ & + : = @` stand for themselves."""
    kept = (("+", "%20"), ("%24", "$"), ("%26", "&"), ("%2B", "+"), ("%3A", ":"), ("%3D", "="), ("%40", "@"))
    return reduce(lambda out, pair: F.replace(out, F.lit(pair[0]), F.lit(pair[1])), kept, query_escape(s))


def display_title(title, series, series_no, in_series: bool) -> Column:
    if not in_series:
        return col(title)
    has = F.coalesce(col(series), F.lit("")) != ""
    numbered = F.concat(F.lit("#"), col(series_no).cast("string"), F.lit(" "), col(title))
    return chosen([(~has, col(title)), (col(series_no) > 0, numbered)], F.concat(F.lit("— "), col(title)))


def feed_text(author, genre, series, series_no, fmt) -> Column:
    series_part = F.when(F.coalesce(col(series), F.lit("")) != "", F.concat(F.lit(" Серия: "), col(series), F.lit(" (№"), col(series_no).cast("string"), F.lit(").")))
    return F.concat(F.lit("Автор: "), col(author), F.lit("."), F.coalesce(series_part, F.lit("")), F.lit(" Жанр: "), col(genre), F.lit(". Формат: "), col(fmt))


def person_name(person: Column) -> Column:
    """`last first middle` of a struct, else its nickname."""
    parts = [F.nullif(trimmed(person[f]), F.lit("")) for f in ("last-name", "first-name", "middle-name")]
    return F.coalesce(F.nullif(F.concat_ws(" ", *parts), F.lit("")), person["nickname"], F.lit(""))


def sequence_label(sequence: Column) -> Column:
    number = sequence["_number"].try_cast("int")
    return F.when(number > 0, F.concat(sequence["_name"], F.lit(" #"), number.cast("string"))).otherwise(F.coalesce(sequence["_name"], F.lit("")))


def clean_annotation(xml) -> Column:
    """Tags of the book format as HTML, namespaces dropped, three entities resolved, `&amp;` last."""
    out = F.regexp_replace(F.coalesce(col(xml), F.lit("")), '(?U)\\sxmlns="[^"]+"', "")
    return trimmed(reduce(lambda s, pair: F.replace(s, F.lit(pair[0]), F.lit(pair[1])), ANNOTATION_TAGS, out))
