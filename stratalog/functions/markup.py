"""Visible text of HTML as Column expressions: tags cut by one pattern, character references by one table."""

from __future__ import annotations

from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# The inside of a tag: a quoted value follows '='; elsewhere a quote is a character like others.
_ATTRIBUTES = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+"""
# A closing slash stands for itself or behind a name, not at the end of an unquoted value.
_NOT_CLOSED = r"""(?<![\s"'][^\s="'>]{0,40}/)"""
# What is no text, each up to its end or that of the page: scripts and styles with what they hold, comments,
# marked sections, end tags and declarations, start tags.
_MARKUP = "|".join((
    rf"<(script|style)(?=[\s/>])(?!/>){_ATTRIBUTES}{_NOT_CLOSED}>.*?(?:</\s*\1\s*>|\z)",
    r"<!--.*?(?:--\s*>|\z)",
    r"<!\[(?:temp|cdata|ignore|include|rcdata)\b.*?(?:\]\s*\]\s*>|\z)",
    r"<!\[(?:if|else|endif)\b.*?(?:\]\s*>|\z)",
    r"<[/!?][^>]*+(?:>|\z)",
    rf"<[a-z]{_ATTRIBUTES}(?:>|\z)",
))
_TOKENS = f"(?is){_MARKUP}|<|[^<]++"

# Names that may lack their semicolon, longest first, and the separators of the table's text.
_BARE = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
_ENTRY, _PAIR = "\x01", "\x02"
# Frequent names lead: the table is read from its start.
_FREQUENT = ("amp;", "nbsp;", "lt;", "gt;", "quot;", "copy;", "middot;")
_TABLE = _ENTRY.join(f"{n}{_PAIR}{html5[n]}" for n in (*_FREQUENT, *sorted(n for n in html5 if n not in _FREQUENT)))


def _windows(n: int) -> str:
    """The character a reference to 128…159 stands for: that of Windows-1252 where it has one."""
    return bytes([n]).decode("cp1252", errors="ignore") or chr(n)


_C1 = "".join(_windows(n) for n in range(128, 160))


def _character(n: Column) -> Column:
    """The character of a code point; '' for code points that are none, U+FFFD for what lies outside."""
    plain = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    nothing = n.between(1, 8) | (n == 11) | n.between(14, 31) | (n == 127) | n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(0xFFFE) == 0xFFFE)
    outside = n.isNull() | (n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
    return (F.when(outside, "�").when(n.between(128, 159), F.substr(F.lit(_C1), (n - 127).cast("int"), F.lit(1)))
            .when(nothing, "").otherwise(plain))


def _number(digits: Column, base: int) -> Column:
    """Value of a digit string; null when it is too long to be a code point."""
    short = F.regexp_replace(digits, "^0+(?=.)", "")
    return F.when(F.length(short) <= 8, F.conv(short, base, 10).cast("bigint"))


def _resolved(part: Column) -> Column:
    """What a text that followed '&' stands for."""
    table = F.str_to_map(F.lit(_TABLE), F.lit(_ENTRY), F.lit(_PAIR))
    number, hexadecimal, decimal = (F.regexp_extract(part, r"^#(?:[xX]([0-9a-fA-F]+)|([0-9]+));?", g) for g in (0, 1, 2))
    full, bare = F.regexp_extract(part, "^[A-Za-z][A-Za-z0-9]*;", 0), F.regexp_extract(part, f"^(?:{'|'.join(_BARE)})", 0)

    def rest(head: Column) -> Column:
        return F.substr(part, F.length(head) + 1)

    value = F.when(hexadecimal != "", _number(hexadecimal, 16)).otherwise(_number(decimal, 10))
    return F.coalesce(
        F.when(number != "", F.concat(_character(value), rest(number))),
        F.when(full != "", F.concat(F.try_element_at(table, full), rest(full))),
        F.when(bare != "", F.concat(F.try_element_at(table, bare), rest(bare))),
        F.concat(F.lit("&"), part))


def _bound(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is mentioned."""
    return F.element_at(F.transform(F.array(c), use), 1)


def unescaped(c: Column) -> Column:
    """Text with its character references, named and numbered, replaced."""
    def replaced(parts: Column) -> Column:
        behind = F.transform(F.slice(parts, F.lit(2), F.size(parts)), _resolved)
        return F.concat(F.element_at(parts, 1), F.array_join(behind, ""))

    return _bound(F.split(c, "&"), replaced)


def visible_text(html: Column) -> Column:
    """Text pieces of a page joined by a blank, without scripts and styles; '' for null.

    A last piece that ends in an unfinished reference ('&' and up to 33 characters) counts as cut off and is left out.
    """
    def shown(tokens: Column) -> Column:
        """All tokens but markup; a lone '<' is text unless it ends the page."""
        text = F.filter(tokens, lambda t: (t == "<") | ~t.startswith("<"))
        cut_off = F.element_at(tokens, -1).rlike(r"^<\z|&[^\s;]{0,33}\z") & ~F.element_at(tokens, -1).rlike("^<.")
        return F.slice(text, F.lit(1), F.size(text) - F.when(cut_off, 1).otherwise(0))

    tokens = F.regexp_extract_all(html, F.lit(_TOKENS), F.lit(0))
    pieces = F.when(F.coalesce(html, F.lit("")) != "", _bound(tokens, lambda t: F.array_join(shown(t), " "))).otherwise("")
    return unescaped(pieces)
