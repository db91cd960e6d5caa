"""Column expressions over text: normal forms, sentences, tokens, HTML, episode numbers. Arrow UDFs only where Spark has no function."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What ends a sentence; the full stop is added for text in Latin letters.
TERMINATORS = "。！？!?"
TOKEN = r"[\p{L}\p{N}]+"
#: Rulers, star headings and bracket headings, which are no sentences.
STRUCTURAL = r"^[-=_ー―—–─ 　]+$|^★|^【[^】]*】$"
#: The bullets before, and the whole lines that are, a call to support a show; the account may be any.
BULLETS = r"^[◾■□▪\x{FE0F}\s\x{A0}\x{3000}]+"
BOILERPLATE = (
    r"^サポートお願いします[！!]*$", r"^Buy Me a Coffee[！!]*$", r"(?i)^https://buymeacoffee\.com/[\w-]+/?[！!]*$",
    r"(?i)^サポートお願いします[！!]?\s+Buy Me a Coffee\s+https://buymeacoffee\.com/[\w-]+/?[！!]*$", r"(?i)^Buy Me a Coffee\s*https://buymeacoffee\.com/[\w-]+/?[！!]*$",
)


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


class _Kept(dict):
    """A table for str.translate, filled as characters come up: letters and numbers stay, others go."""

    def __missing__(self, code: int) -> int | None:
        c = chr(code)
        self[code] = code if unicodedata.category(c)[0] in "LN" or c == "ー" else None
        return self[code]


_KEPT = _Kept()


def comparable_text(s: str) -> str:
    """NFKC, letters and numbers only, lower case."""
    return unicodedata.normalize("NFKC", s).translate(_KEPT).lower()


class _Each(dict):
    """A table for str.translate, filled as characters come up: comparable_text of each."""

    def __missing__(self, code: int) -> str:
        self[code] = comparable_text(chr(code))
        return self[code]


_EACH = _Each()


def comparable_each(s: str) -> str:
    """comparable_text of the characters one by one: what several of them compose stays apart."""
    return s.translate(_EACH)


@F.pandas_udf(StringType())
def comparable(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else comparable_text(s))


def normalized_query(query: str) -> str:
    return unicodedata.normalize("NFKC", query).strip().strip("﻿")


def structural(line: Column) -> Column:
    return line.rlike(STRUCTURAL)


def all_but(chars: str) -> str:
    """A pattern's class of all characters but these, as ranges: Java tests a negated list of wide ones six times slower."""
    codes = sorted({ord(c) for c in chars})
    ranges = [(a + 1, b - 1) for a, b in zip([-1, *codes], [*codes, 0x110000], strict=True) if a + 1 < b]
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ranges) + "]"


def sentences(text: Column, terminators: str = TERMINATORS) -> Column:
    """The text's sentences in order: runs up to and with terminators, within lines; structural lines drop out."""
    marks = re.escape(terminators)
    found = F.regexp_extract_all(text, F.lit(rf"{all_but(terminators + '\n')}+[{marks}]*"), F.lit(0))
    return F.filter(F.transform(found, lambda s: F.trim(s)), lambda s: (F.length(s) > 0) & ~structural(s))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def without_boilerplate(text: Column, patterns: tuple[str, ...] = BOILERPLATE, bullets: str = BULLETS) -> Column:
    """The text without the lines that match a pattern once their bullets are gone."""
    line_of = lambda x: F.regexp_replace(x, bullets, "")
    known = lambda x: F.coalesce(*[F.when(line_of(x).rlike(p), F.lit(True)) for p in patterns], F.lit(False))
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~known(x)), "\n")


def xml_decoded(text: Column) -> Column:
    """Ampersands first, so what was encoded twice is decoded twice; names in either case."""
    for name, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&apos;", "'")):
        text = F.regexp_replace(text, f"(?i){name}", char)
    return text


_DECIMAL, _HEX = re.compile(r"&#0*([0-9]{1,7});"), re.compile(r"&#[xX]0*([0-9a-fA-F]{1,6});")


def _character(m: re.Match, base: int) -> str:
    code = int(m[1], base)
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]


@F.pandas_udf(StringType())
def numeric_decoded(text: pd.Series) -> pd.Series:
    """Decimal references, then hexadecimal ones; what names no character stays."""
    return text.map(lambda s: None if s is None else _HEX.sub(lambda m: _character(m, 16), _DECIMAL.sub(lambda m: _character(m, 10), s)))


def html_decoded(text: Column, numeric: bool = True) -> Column:
    text = xml_decoded(text)
    for name, char in (("&nbsp;", " "), ("&quot;", '"'), ("&#39;|&#x27;", "'")):
        text = F.regexp_replace(text, f"(?i){name}", char)
    return numeric_decoded(text) if numeric else text


def single_spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[ \\t\\r\\f\\x0b ]+", " "))


def visible_text(html: Column, numeric: bool = True) -> Column:
    """Line breaks and closing block tags become newlines; scripts, styles and tags go; entities are decoded; lines are trimmed, blank ones dropped."""
    text = F.regexp_replace(html, r"(?i)<br\b[^>]*>|</(?:p|div|h[1-6]|li|section|article)>", "\n")
    text = F.regexp_replace(text, r"(?is)<(script|style)\b.*?</\1>", "")
    text = html_decoded(F.regexp_replace(text, r"<[^>]*>", ""), numeric)
    lines = F.transform(F.split(text, "\n"), single_spaced)
    return F.array_join(F.filter(lines, lambda x: F.length(x) > 0), "\n")


def post_text(html: Column, numeric: bool = True) -> Column:
    """A rendered post: after the tag with the description hook, up to the footer tag that holds the footer hook (else the recent posts' hook, else the end)."""
    # The page builder's hooks.
    hook, footer, recent = 'data-hook="post-description"', 'data-hook="post-footer"', 'data-hook="recent-posts"'
    opened = F.locate(hook, html)
    rest = F.substr(html, F.greatest(opened, F.lit(1)))
    close = F.locate(">", rest)
    body = F.substr(rest, close + 1)
    at_footer, at_recent = F.locate(footer, body), F.locate(recent, body)
    ahead = F.when(at_footer > 0, F.substr(body, F.lit(1), at_footer - 1))
    last = F.length(F.substring_index(ahead, "<footer", -1))  # what stands behind the last footer tag
    before = F.when(F.contains(ahead, F.lit("<footer")), F.substr(ahead, F.lit(1), F.length(ahead) - last - len("<footer"))).otherwise(F.lit(""))
    cut = F.when(at_footer > 0, before).when(at_recent > 0, F.substr(body, F.lit(1), at_recent - 1)).otherwise(body)
    return F.when(html.isNotNull(), F.when((opened > 0) & (close > 0), without_boilerplate(visible_text(cut, numeric))).otherwise(F.lit("")))


def between(text: Column, start: str, end: str) -> Column:
    """What stands after the first `start` and before the next `end` (or the text's end); null without a start."""
    at = F.locate(start, text)
    rest = F.substr(text, at + len(start))
    stop = F.locate(end, rest)
    return F.when(at > 0, F.when(stop > 0, F.substr(rest, F.lit(1), stop - 1)).otherwise(rest))


_GAP, _SEPARATORS = r"[\s\x{A0}\x{3000}]*", r"[\s\x{A0}\x{3000}._-]*"


def _positive(value: Column, pattern: str) -> Column:
    number = F.nullif(F.regexp_extract(value, pattern, 1), F.lit("")).cast("int")
    return F.when(number > 0, number)


def episode_from_title(title: Column) -> Column:
    """The number after ep / episode, else within 第N回; not part of a longer word or number, and not zero."""
    return F.coalesce(_positive(title, rf"(?iu)(?:^|[^\p{{L}}\p{{N}}])(?:episode|ep){_SEPARATORS}0*(\d{{1,4}})(?![\p{{L}}\p{{N}}])"), _positive(title, rf"(?:^|[^\p{{L}}\p{{N}}])第{_GAP}0*(\d{{1,4}}){_GAP}回(?![\p{{L}}\p{{N}}])"))


def episode_from_page(text: Column) -> Column:
    """As from titles, else the mistyped form p N, with any separators of blanks, dots, dashes and underscores."""
    return F.coalesce(episode_from_title(text), _positive(text, rf"(?iu)(?:^|[^\p{{L}}\p{{N}}])p{_SEPARATORS}0*(\d{{1,4}})(?![\p{{L}}\p{{N}}])"))


VIDEO_ID = r"^[A-Za-z0-9_-]{11}$"


def video_id(value: Column) -> Column:
    """A bare id, or the id in a watch, embed, shorts or short-host address."""
    bare = F.trim(value)
    url = F.coalesce(
        F.nullif(F.regexp_extract(bare, r"^https?://(?:[\w.-]+\.)?youtube\.com/[^#]*[?&]v=([A-Za-z0-9_-]{11})(?:[&#]|$)", 1), F.lit("")),
        F.nullif(F.regexp_extract(bare, r"^https?://(?:[\w.-]+\.)?youtube\.com/(?:shorts|embed|live)/([A-Za-z0-9_-]{11})(?:[/?#]|$)", 1), F.lit("")),
        F.nullif(F.regexp_extract(bare, r"^https?://youtu\.be/([A-Za-z0-9_-]{11})(?:[/?#]|$)", 1), F.lit("")),
    )
    return F.when(bare.rlike(VIDEO_ID), bare).otherwise(url)


def playlist_video_id(own: Column, url: Column, page: Column) -> Column:
    """Of the first of id, url and page address that is present; a bad one does not fall through."""
    present = lambda c: c.isNotNull() & (F.trim(c) != "")
    return F.when(present(own), F.when(F.trim(own).rlike(VIDEO_ID), F.trim(own))).when(present(url), video_id(url)).when(present(page), video_id(page))
