"""Citation texts: links, identifiers, titles and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_URL = r"https?://[^\s)]+"
_DOI = r"10\.\d{4,}/[^\s)]+"
_FILE_PARTS = r"^(.+?)\s*-\s*(\d{4})\s*-\s*(.+)$"


def _blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def citation_text(text: Column, authors: Column, year: Column, title: Column, doi: Column) -> Column:
    """The stored text, or one put together from the structured fields."""
    parts = F.concat_ws(
        ", ",
        _blank_to_null(authors),
        F.concat(F.lit("("), year.cast("string"), F.lit(")")),
        F.concat(F.lit('"'), title, F.lit('"')),
        F.concat(F.lit("https://doi.org/"), _blank_to_null(doi)),
    )
    return F.coalesce(_blank_to_null(text), parts)


def first_url(text: Column) -> Column:
    return _blank_to_null(F.regexp_extract(text, _URL, 0))


def text_without_url(text: Column) -> Column:
    """The text with its first URL cut out, blanks folded and one closing dot dropped."""
    url = first_url(text)
    at = F.position(url, text)
    rest = F.concat(F.substr(text, F.lit(1), at - 1), F.substr(text, at + F.length(url)))
    folded = F.trim(F.regexp_replace(rest, r"\s{2,}", " "))
    return F.when(url.isNull(), text).otherwise(F.regexp_replace(folded, r"\.$", ""))


def doi_link(text: Column) -> Column:
    return F.concat(F.lit("https://doi.org/"), _blank_to_null(F.regexp_extract(text, _DOI, 0)))


def likely_title(text: Column) -> Column:
    """Text before the first year when long enough, else the first 100 characters."""
    before_year = F.regexp_extract(text, r"^(.+?)(?:\(?\d{4}\)?)", 1)
    head = F.when(F.length(before_year) > 10, before_year).otherwise(F.substring(text, 1, 100))
    return F.trim(F.regexp_replace(head, r"[,.\s]+$", ""))


def uri_component(c: Column) -> Column:
    """Percent encoding that leaves A-Z a-z 0-9 - _ . ! ~ * ' ( ) as they are."""
    out = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for code, plain in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return out


def scholar_link(query: Column) -> Column:
    return F.concat(F.lit("https://scholar.google.com/scholar?q="), uri_component(query))


def text_search_link(text: Column) -> Column:
    return scholar_link(F.substring(text, 1, 120))


def title_search_link(text: Column) -> Column:
    return scholar_link(F.concat(F.lit('"'), likely_title(text), F.lit('"')))


def entity_search_link(name: Column) -> Column:
    """Search for works that cite an entity by name."""
    return scholar_link(F.concat(name, F.lit(" lunar regolith simulant")))


def file_title(name: Column) -> Column:
    """File name without '.pdf.html', '.html' and '.pdf', each taken off once in that order."""
    out = name
    for suffix in (r"\.pdf\.html$", r"\.html$", r"\.pdf$"):
        out = F.regexp_replace(out, suffix, "")
    return out


def bare_file_name(name: Column) -> Column:
    return F.replace(F.replace(name, F.lit(".html"), F.lit("")), F.lit(".pdf"), F.lit(""))


def document_doi(text: Column) -> Column:
    """First DOI among the first 3000 characters, closing dots dropped."""
    found = F.regexp_extract(F.substring(text, 1, 3000), r"(10\.\d{4,}/[^\s,;)]+)", 1)
    return _blank_to_null(F.regexp_replace(found, r"\.+$", ""))


def document_title(text: Column) -> Column:
    """First line of more than 10 and fewer than 200 characters that is no link."""
    lines = F.transform(F.split(F.trim(text), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    good = F.filter(lines, lambda x: (F.length(x) > 10) & (F.length(x) < 200) & ~x.startswith("http"))
    return F.try_element_at(good, F.lit(1))


def file_authors(name: Column) -> Column:
    return _blank_to_null(F.trim(F.regexp_extract(bare_file_name(name), _FILE_PARTS, 1)))


def file_year(name: Column) -> Column:
    return F.regexp_extract(bare_file_name(name), _FILE_PARTS, 2).try_cast("int")


def file_work_title(name: Column) -> Column:
    return _blank_to_null(F.trim(F.regexp_extract(bare_file_name(name), _FILE_PARTS, 3)))
