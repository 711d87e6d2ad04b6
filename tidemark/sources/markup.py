"""Rows out of HTML, by column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.columns import once

#: Named entities that filings use.
_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))
#: Runs of white space, and a mark that stands in no text of a filing.
_BLANKS, _MARK = "[\\s\\u00a0]+", "\x1f"
#: A trimmed text without any of these has nothing to collapse.
_UNEVEN = ("  ", "\t", "\n", "\x0b", "\f", "\r", "\u00a0")


def _body(tag: str) -> str:
    """All before the next end of a tag, as a lazy ``.*?`` finds it, by whole runs of letters and without a stack."""
    return rf"[^<]*+(?:<(?!/{tag}>)[^<]*+)*+"


def decoded(text: Column) -> Column:
    """Text with its named and numeric entities decoded, each once."""
    parts = F.regexp_extract_all(text, F.lit(r"(?s)(&#\d{1,7};|&#x[0-9a-fA-F]{1,6};|&[a-z]+;|&|[^&]+)"), F.lit(1))

    def letter(p: Column) -> Column:
        named = F.coalesce(*[F.when(p == name, value) for name, value in _ENTITIES])
        # A code point as a letter, by its four bytes.
        decimal = F.when(p.rlike(r"^&#\d+;$"), F.regexp_extract(p, r"^&#(\d+);$", 1).try_cast("int"))
        hexadecimal = F.when(p.rlike("^&#x[0-9a-fA-F]+;$"), F.conv(F.regexp_extract(p, "^&#x([0-9a-fA-F]+);$", 1), 16, 10).try_cast("int"))
        spell = lambda code: F.when((code >= 1) & (code <= 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        spelled = F.when(F.startswith(p, F.lit("&#")), once(F.coalesce(decimal, hexadecimal), spell))
        return F.when(F.startswith(p, F.lit("&")), F.coalesce(named, spelled, p)).otherwise(p)

    return F.when(text.contains("&"), F.array_join(F.transform(parts, letter), "")).otherwise(text)


def _has(text: Column, *parts: str) -> Column:
    return reduce(Column.__or__, [F.contains(text, F.lit(p)) for p in parts])


def _collapsed(text: Column) -> Column:
    """Runs of white space as one blank, and none at the ends. Most texts are so already; a search for fixed letters
    tells, at a fraction of a pattern's time."""
    return once(F.trim(text), lambda t: F.when(_has(t, *_UNEVEN), F.trim(F.regexp_replace(t, _BLANKS, " "))).otherwise(t))


def text_of(html: Column) -> Column:
    """Text without tags, with entities decoded and white space collapsed."""
    return text_of_plain(once(html, lambda h: F.when(F.contains(h, F.lit("<")), F.regexp_replace(h, "(?s)<[^>]*>", " ")).otherwise(h)))


def text_of_plain(text: Column) -> Column:
    """Text that has no tags any more, with entities decoded and white space collapsed."""
    return _collapsed(once(text, decoded))


def texts_of(cells: Column) -> Column:
    """``text_of`` of each text of an array without nulls, by one pass over all of them with a mark between them; only
    those with entities are looked at again. Texts that hold the mark are read one by one, and those that are plain
    already are only trimmed."""

    def each(parts: Column) -> Column:
        plain = F.transform(parts, lambda p: F.when(F.contains(p, F.lit("&")), text_of_plain(p)).otherwise(F.trim(p)))
        return F.when(F.size(parts) == F.size(cells), plain).otherwise(F.transform(cells, text_of))

    # Tags and white space in one pass, without a stack; a split at one letter compiles no pattern for each row.
    bare = lambda x: F.regexp_replace(x, rf"(?:{_BLANKS}+|<[^>{_MARK}]*+>)++", " ")
    uneven = lambda x: F.when(_has(x, "<", "&", *_UNEVEN), once(F.split(bare(x), _MARK), each)).otherwise(F.transform(cells, lambda c: F.trim(c)))
    return once(F.array_join(cells, _MARK), uneven)


def rows_of(html: Column) -> Column:
    """The cells (their HTML) of each table row that has any."""
    rows = F.regexp_extract_all(html, F.lit(rf"(?i)<tr[^>]*>({_body('tr')})</tr>"), F.lit(1))
    return F.filter(F.transform(rows, lambda r: F.regexp_extract_all(r, F.lit(rf"(?i)<td[^>]*>({_body('td')})</td>"), F.lit(1))), lambda c: F.size(c) > 0)


def table_with(html: Column, header: str) -> Column:
    """The first table whose HTML holds a text; null if none does."""
    tables = F.regexp_extract_all(html, F.lit(rf"(?i)(<table[^>]*>{_body('table')}</table>)"), F.lit(1))
    return F.get(F.filter(tables, lambda t: F.contains(t, F.lit(header))), F.lit(0))


def links(html: Column, attribute: str = "href") -> Column:
    """Distinct values of an attribute in the order of the page."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(rf'(?i)\s{attribute}="([^"]*)"'), F.lit(1)))
