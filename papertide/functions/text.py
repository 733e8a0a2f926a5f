"""Keys and cleaning of names, titles, URLs and page text."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tags that end a line of visible text.
BLOCK_TAGS = "p|div|li|br|tr|h[1-6]|ul|ol|table|section|article|nav"


def fold_accents(text: str) -> str:
    """The text without accents; the barred d becomes d."""
    flat = unicodedata.normalize("NFKD", text.replace("đ", "d").replace("Đ", "D"))
    return "".join(c for c in flat if not unicodedata.combining(c))


def _fold_batches(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield part.map(lambda x: fold_accents(html.unescape(x)) if x is not None else None)


def _bare_batches(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield part.map(lambda x: fold_accents(x) if x is not None else None)


def folded(text: Column) -> Column:
    """fold_accents() of unescaped text; null stays null."""
    return F.pandas_udf(_fold_batches, "string")(text)


def _unescape_batches(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield part.map(lambda x: html.unescape(x) if x is not None else None)


def unescaped(text: Column) -> Column:
    """The text with its character references resolved; null stays null."""
    return F.pandas_udf(_unescape_batches, "string")(text)


def _plain(text: Column, ascii_only: bool) -> Column:
    return text if ascii_only else folded(text)


def norm_name(text: Column, ascii_only: bool = False) -> Column:
    return F.trim(F.lower(F.regexp_replace(_plain(text, ascii_only), "[^A-Za-z0-9]+", " ")))


def name_key(text: Column, ascii_only: bool = False) -> Column:
    """The name's words in order of the alphabet; single letters go where two longer words remain."""
    words = F.filter(F.split(norm_name(text, ascii_only), " "), lambda w: w != "")
    long = F.filter(words, lambda w: F.length(w) > 1)
    return F.array_join(F.array_sort(F.when(F.size(long) >= 2, long).otherwise(words)), " ")


#: A command of a typesetting language: a backslash with the letters after it, or with one other sign.
COMMAND = r"\\(?:[A-Za-z]+|.)"


def norm_title(text: Column, ascii_only: bool = False) -> Column:
    """Letters and digits of a title, without commands of a typesetting language."""
    return F.regexp_replace(F.lower(F.regexp_replace(_plain(text, ascii_only), COMMAND, " ")), "[^a-z0-9]+", "")


def slug(text: Column, ascii_only: bool = False) -> Column:
    """Words joined by dashes. Character references are not resolved: their letters are part of the name of a page."""
    plain = text if ascii_only else F.pandas_udf(_bare_batches, "string")(text)
    return F.btrim(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", "-"), F.lit("-"))


def visible_text(page: Column) -> Column:
    """The text of a page: no scripts, styles, comments or tags; blocks end lines; the five XML entities are resolved."""
    out = F.regexp_replace(page, r"(?is)<(script|style)\b.*?</(script|style)>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, rf"(?i)</?({BLOCK_TAGS})\b[^>]*>", "\n")
    out = F.regexp_replace(out, "<[^>]*>", "")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(sign))
    return out


def links(page: Column) -> Column:
    return F.regexp_extract_all(page, F.lit(r'href="([^"]*)"'), F.lit(1))


def url_key(url: Column) -> Column:
    """A URL without scheme, www, query, fragment and closing slash, lower-cased host and all."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(url, r"[?#].*$", "")), r"^https?://(www\.)?", ""), "/+$", "")


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\r\f\x0B]+"), lambda w: w != "")


_ENTRY = re.compile(r"@(\w+)\s*\{\s*([^,\s]*)\s*,")


_STOP = re.compile(r'[{}",]')


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with a value that is found once, however often the body names it, also inside functions of elements."""
    return F.transform(F.array(value), body)[0]


def bib_fields(entry: str) -> dict[str, str]:
    """The fields of one bibliography entry: values in balanced braces, in quotes, or bare."""
    head = _ENTRY.search(entry)
    if not head:
        return {}
    out, at = {"type": head[1].lower(), "key": head[2]}, head.end()
    name = re.compile(r"[\s,]*([\w-]+)\s*=\s*")
    while m := name.match(entry, at):
        at, depth, quoted = m.end(), 0, entry[m.end() : m.end() + 1] == '"'
        start = at + 1 if quoted else at
        at = start
        while stop := _STOP.search(entry, at):
            at, c = stop.start(), stop[0]
            if c == "{":
                depth += 1
            elif c == "}":
                if depth == 0:
                    break
                depth -= 1
            elif depth == 0 and (c == '"' if quoted else c == ","):
                break
            at += 1
        else:
            at = len(entry)
        value = entry[start:at].strip()
        value = value[1:-1] if not quoted and value[:1] == "{" and value[-1:] == "}" else value
        out[m[1].lower()] = " ".join(value.split())
        at += quoted
    return out


#: The combining mark of each accent command, and the letter of each letter command.
ACCENTS = {"`": "\u0300", "'": "\u0301", "^": "\u0302", "~": "\u0303", "=": "\u0304", "u": "\u0306", ".": "\u0307", '"': "\u0308", "h": "\u0309", "r": "\u030a", "H": "\u030b", "v": "\u030c", "d": "\u0323", "c": "\u0327", "k": "\u0328", "b": "\u0331"}
LETTERS = {"DJ": "Đ", "dj": "đ", "o": "ø", "O": "Ø", "l": "ł", "L": "Ł", "ss": "ß", "ae": "æ", "AE": "Æ", "aa": "å", "AA": "Å", "oe": "œ", "OE": "Œ", "i": "i", "j": "j"}
_LATEX = re.compile(r"\\([A-Za-z]+)\s*|\\(.)|([{}])|([^\\{}])", re.S)


def latex_to_text(source: str) -> str:
    """Typesetting source as plain text: accents join the letter or group that follows, letter commands become letters, other commands and all braces go."""
    stack: list[list[str]] = [[]]  # the groups that are open, each with the units read so far
    marks: list[list[str]] = [[]]  # of each open group: accents that wait for their letter

    def put(unit: str) -> None:
        if marks[-1] and unit.strip():
            unit = unit[0] + "".join(reversed(marks[-1])) + unit[1:] if len(unit) == 1 or not unicodedata.combining(unit[1]) else unit + "".join(reversed(marks[-1]))
            marks[-1] = []
        stack[-1].append(unit)

    for word, sign, brace, char in _LATEX.findall(source):
        if word in LETTERS:
            put(LETTERS[word])
        elif word in ACCENTS or sign in ACCENTS and sign:
            marks[-1].append(ACCENTS[word or sign])
        elif brace == "{":
            stack.append([])
            marks.append([])
        elif brace:
            if len(stack) > 1:
                inner = "".join(stack.pop())
                marks.pop()
                if inner:
                    put(inner)
        elif sign or char:
            put(sign or char)
    while len(stack) > 1:
        inner = "".join(stack.pop())
        stack[-1].append(inner)
    return " ".join(unicodedata.normalize("NFC", "".join(stack[0])).split())
