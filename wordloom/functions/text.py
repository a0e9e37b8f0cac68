"""Words, patterns and small string functions as column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Separators that always end a word, separators that end it unless an exception word goes on, and the exceptions.
HARD = "!#()+,./:;<>^_`[]{|}~- \n\r\t "
SOFT = "'"
EXCEPTIONS = ("aujourd'hui",)


def _char_class(chars: str) -> str:
    return "".join(f"\\x{{{ord(c):X}}}" for c in chars)


def word_pattern(hard: str = HARD, soft: str = SOFT, exceptions: tuple[str, ...] = EXCEPTIONS, entities: bool = False) -> str:
    """A regular expression for one word: an entity, an exception word with
    soft separators inside, or a run without separators."""
    ends = f"(?=[{_char_class(hard + soft)}]|$)"
    special = [f"(?iu:{re.escape(w)}){ends}" for w in exceptions]
    if entities:
        body = f"(?:&[A-Za-z0-9]{{1,6}};|(?!&[A-Za-z0-9#]{{1,6}};)[^{_char_class(hard + soft)}])+"
        return "|".join([*special, body])
    return "|".join([*special, f"[^{_char_class(hard + soft)}]+"])


def words(text: Column, **rules) -> Column:
    """The words of a text in order, as an array."""
    return F.regexp_extract_all(text, F.lit(word_pattern(**rules)), F.lit(0))


def tokens(docs: DataFrame, text: str = "text", key: str = "doc_id", **rules) -> DataFrame:
    """(key, ``pos`` from 0, ``word``): a row for each word.  No shuffle.
    Null or empty texts have none."""
    return docs.select(key, F.posexplode(words(F.col(text), **rules)).alias("pos", "word"))


def next_string(prefix: str) -> str | None:
    """The smallest string above all that begin with ``prefix``: by code
    points, which is the order of UTF-8 bytes as well.  None if there is none."""
    while prefix:
        point = ord(prefix[-1]) + 1
        if point <= 0x10FFFF:
            return prefix[:-1] + chr(0xE000 if point == 0xD800 else point)  # surrogates aren't text
        prefix = prefix[:-1]
    return None


def reverse_points(text: Column) -> Column:
    return F.reverse(text)


def reverse_bytes(text: Column) -> Column:
    """The UTF-8 bytes backwards, as binary."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"), F.lit(1))
    return F.unhex(F.array_join(F.reverse(pairs), ""))


def decoded(data: Column, strict: bool = False) -> Column:
    """UTF-8 bytes as text.  Broken ones fail the query if ``strict``, else
    each becomes U+FFFD."""
    return F.validate_utf8(data.cast("string")) if strict else F.make_valid_utf8(data.cast("string"))


def points_of(text: Column) -> Column:
    """A text's code points in order, as numbers."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))


def from_points(points: Column) -> Column:
    """The text of some code points."""
    return F.decode(F.unhex(F.array_join(F.transform(points, lambda p: F.lpad(F.hex(p), 8, "0")), "")), "UTF-32")


def upper_ascii(text: Column) -> Column:
    return F.translate(text, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def strip_marks(text: Column) -> Column:
    """Without stress and length marks of phonetic spelling."""
    return F.translate(text, "ˈˉˊˋˌ", "")


def url_decoded(text: Column) -> Column:
    """``+`` and ``%hh`` resolved; null where an escape is broken."""
    return F.try_url_decode(text)


def html_body(html: Column) -> Column:
    """What stands between the body tags; empty where there are none."""
    return F.regexp_extract(html, r"(?is)<body[^>]*>(.*)</body>", 1)


def content_url(url: Column) -> Column:
    """(``fs``, ``path``, ``anchor``) of ``sk://fs/2.0/<fs>!/<path>#anchor``."""
    pattern = r"^sk://fs/2\.0/([^!]*)!/([^#]*)(?:#(.*))?$"
    parts = [F.nullif(F.regexp_extract(url, pattern, k), F.lit("")).alias(n) for k, n in ((1, "fs"), (2, "path"), (3, "anchor"))]
    return F.when(url.rlike(pattern), F.struct(*parts))


def bits(value: Column, shift: int, mask: int) -> Column:
    """``(value >> shift) & mask`` of an unsigned number."""
    return F.shiftrightunsigned(value.cast("long"), shift).bitwiseAND(F.lit(mask))


def cell_slice(cell: Column, pos: int, length: int) -> Column:
    """A bounded read of ``length`` from ``pos`` (from 0) in a cell."""
    return F.substring(cell, pos + 1, length)


@dataclass(frozen=True)
class WordPattern:
    """How to look a pattern up: a literal head or tail that a sorted column
    can be searched by, and a rest that has to be matched (None: nothing)."""

    mode: str  # exact, begin, end or scan
    literal: str
    rest: str | None


def wildcard(pattern: str, many: str = "*", one: str = "?") -> WordPattern:
    """Plans ``*`` (any number of code points) and ``?`` (exactly one)."""
    if not pattern:
        raise ValueError("an empty pattern")
    if not pattern.strip(many + one):
        raise ValueError("a pattern of wildcards alone")
    regex = "^" + "".join(".*" if c == many else "." if c == one else re.escape(c) for c in pattern) + "$"
    head = re.match(f"[^{re.escape(many + one)}]*", pattern)[0]
    tail = re.search(f"[^{re.escape(many + one)}]*$", pattern)[0]
    if head == pattern:
        return WordPattern("exact", pattern, None)
    if head:
        return WordPattern("begin", head, None if pattern == head + many else "(?s)" + regex)
    if tail:
        return WordPattern("end", tail, None if pattern == many + tail else "(?s)" + regex)
    return WordPattern("scan", "", "(?s)" + regex)


def regular(pattern: str) -> WordPattern:
    """Plans a regular expression that has to match the whole word, by the
    longer one of its literal head and tail."""
    plain = r"[^\\\[\](){}.*+?|^$]"
    full = f"^(?:{pattern})$"
    if re.fullmatch(f"{plain}+", pattern):
        return WordPattern("exact", pattern, None)
    if "|" in pattern or "\\" in pattern:
        return WordPattern("scan", "", full)
    head = re.match(f"(?:{plain}(?![*+?{{]))*", pattern)[0]
    tail = re.search(f"{plain}*$", pattern)[0]
    if head and len(head) >= len(tail):
        return WordPattern("begin", head, None if pattern == head + ".*" else full)
    if tail:
        return WordPattern("end", tail, None if pattern == ".*" + tail else full)
    return WordPattern("scan", "", full)
