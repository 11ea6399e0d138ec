"""One consistent form of visually identical text (problem 5).

Compatibility folding into composed form, mapped whitespace and hyphens, removal of default-ignorable
characters, and look-alike letters brought to the script of their word; computed once per distinct value
of an Arrow batch. Case is kept in the form itself, because a reader sees it; ``folded_form`` adds full
case folding for comparisons that ignore case.

Defined results: null stays null; blank text becomes ''; trailing blanks of a line and blanks around the
text cannot be seen and are dropped; visible typography (dashes, curly quotes, superscripts, fractions)
is kept.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from inkstone.session import materialize

# Letters of other alphabets that look like a Latin letter.
CYRILLIC_AS_LATIN = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j",
    "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l", "ү": "v",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T",
    "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Ӏ": "I",
}
GREEK_AS_LATIN = {
    "ο": "o", "ν": "v", "ι": "i", "α": "a", "ρ": "p", "υ": "u", "κ": "k", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
}
OTHER_AS_LATIN = {
    "ɑ": "a", "ɡ": "g", "ı": "i", "ɩ": "i", "ɪ": "i", "ʏ": "y", "ᴏ": "o", "ᴄ": "c", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z",
    "օ": "o", "ս": "u", "հ": "h", "ց": "g", "յ": "j", "Օ": "O", "Ս": "U", "Տ": "S",
}
HYPHENS = "\u2010\u2011\ufe63\uff0d"
LINE_BREAKS = "\r\n|[\r\n\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"

LATIN_AS_CYRILLIC = {v: k for k, v in CYRILLIC_AS_LATIN.items()}
LATIN_AS_GREEK = {v: k for k, v in GREEK_AS_LATIN.items()}


def _ignorable(ch: str) -> bool:
    o = ord(ch)
    return (
        (unicodedata.category(ch) == "Cf" and not 0x600 <= o <= 0x605 and o not in (0x6DD, 0x70F))
        or o in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0)
        or 0x180B <= o <= 0x180F
        or 0xFE00 <= o <= 0xFE0F
        or 0xE0000 <= o <= 0xE0FFF
        or (unicodedata.category(ch) == "Cc" and ch not in "\t\n\r\x0b\x0c\x1c\x1d\x1e\x85")
    )


def _single_character_map() -> dict[int, str | None]:
    """Built by rule from the Unicode database: ignorables, blanks, hyphens, widths and ligatures."""
    out: dict[int, str | None] = {}
    for o in range(sys.maxunicode + 1):
        if 0xD800 <= o < 0xE000 or 0x20000 <= o < 0xE0000 or o > 0xE0FFF:
            continue
        ch = chr(o)
        if _ignorable(ch):
            out[o] = None
        elif ch in HYPHENS:
            out[o] = "-"
        elif unicodedata.category(ch) == "Zs" and ch != " " or ch == "\t":
            out[o] = " "
        elif ch in GREEK_AS_LATIN:
            continue  # lunate sigmas look like c, not like the sigma that they decompose to
        else:
            kind, _, rest = unicodedata.decomposition(ch).partition(" ")
            alike = kind in ("<wide>", "<narrow>", "<font>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")
            if alike or kind == "<compat>" and not rest.startswith("0020") and unicodedata.category(ch)[0] in "LN":
                out[o] = unicodedata.normalize("NFKC", ch)
    return out


_MAP = _single_character_map()
_MAPPED = frozenset(map(chr, _MAP))
_BREAKS = re.compile(LINE_BREAKS)
_BREAK_CHARACTERS = frozenset("\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029")


_FOREIGN = frozenset(map(chr, [*range(0x370, 0x400), *range(0x400, 0x530)])) | frozenset(OTHER_AS_LATIN)
_WORD = re.compile("[\\w\u0300-\u036f]+")
_LATIN_LETTER = re.compile("[A-Za-z\u00c0-\u024f]")
_TRAILING = re.compile(" +(?=\n)")


@lru_cache(1 << 16)
def _decisive_in(text: str) -> tuple[int, int, int]:
    """Letters of a word that belong to one alphabet only: Latin, Cyrillic, Greek."""
    latin = cyrillic = greek = 0
    for ch in text:
        o = ord(ch)
        if o < 0x250:
            latin += ch.isalpha() and ch not in LATIN_AS_CYRILLIC and ch not in LATIN_AS_GREEK and ch not in OTHER_AS_LATIN
        elif 0x400 <= o < 0x530:
            cyrillic += ch not in CYRILLIC_AS_LATIN
        elif 0x370 <= o < 0x400:
            greek += ch.isalpha() and ch not in GREEK_AS_LATIN
    return latin, cyrillic, greek


def _decisive(text: str) -> tuple[int, int, int]:
    """The same over all words of a text."""
    latin = cyrillic = greek = 0
    for a, b, c in map(_decisive_in, _WORD.findall(text)):
        latin, cyrillic, greek = latin + a, cyrillic + b, greek + c
    return latin, cyrillic, greek


_TO_LATIN = str.maketrans(CYRILLIC_AS_LATIN | GREEK_AS_LATIN | OTHER_AS_LATIN)
_TO_CYRILLIC = str.maketrans(
    LATIN_AS_CYRILLIC | {k: LATIN_AS_CYRILLIC[v] for k, v in (GREEK_AS_LATIN | OTHER_AS_LATIN).items() if v in LATIN_AS_CYRILLIC}
)
_TO_GREEK = str.maketrans(
    LATIN_AS_GREEK | {k: LATIN_AS_GREEK[v] for k, v in (CYRILLIC_AS_LATIN | OTHER_AS_LATIN).items() if v in LATIN_AS_GREEK}
)


_GROUNDS = {"latin": _TO_LATIN, "cyrillic": _TO_CYRILLIC, "greek": _TO_GREEK}


@lru_cache(1 << 16)
def _settled(w: str, ground: str) -> str:
    """A word in its own script, or in that of the ground if all its letters are imitated."""
    a, b, c = _decisive_in(w)
    if not (a or b or c):
        return w if ground == "latin" and _FOREIGN.isdisjoint(w) else w.translate(_GROUNDS[ground])
    if b == c == 0 and _FOREIGN.isdisjoint(w):
        return w
    return w.translate(_TO_LATIN if a and a >= max(b, c) else _TO_CYRILLIC if b >= c else _TO_GREEK)


_SEGMENT = re.compile("[^.!?\u3002\n]*[.!?\u3002\n]*")


def _ground(counts: tuple[int, int, int], otherwise):
    latin, cyrillic, greek = counts
    if not (latin or cyrillic or greek):
        return otherwise
    return _TO_CYRILLIC if cyrillic > max(latin, greek) else _TO_GREEK if greek > max(latin, cyrillic) else _TO_LATIN


def _one_script(text: str) -> str:
    """Bring look-alike letters to the script of their word, else of their sentence, else of the text.

    Only letters that no other alphabet imitates decide, so a disguised text decides like its original.
    """
    text = unicodedata.normalize("NFD", text)
    whole = _ground(_decisive(text), _TO_LATIN)

    def segment(m: re.Match) -> str:
        ground = _ground(_decisive(m.group()), whole)
        if ground is _TO_LATIN and _FOREIGN.isdisjoint(m.group()):
            return m.group()
        name = "latin" if ground is _TO_LATIN else "cyrillic" if ground is _TO_CYRILLIC else "greek"
        return _WORD.sub(lambda m: _settled(m.group(), name), m.group())

    return unicodedata.normalize("NFC", _SEGMENT.sub(segment, text))


def _mapped(text: str, held: set[str]) -> str:
    """``_MAP`` applied, of which the text has ``held``; nothing that it gives is mapped again."""
    if len(held) > 8:
        return text.translate(_MAP)
    for c in held:
        text = text.replace(c, _MAP[ord(c)] or "")
    return text


def consistent_form(text: str | None) -> str | None:
    """The one form of a text that a reader cannot tell apart from it."""
    if text is None:
        return None
    # Each step is taken only where the text has a character it changes; most texts have none.
    held = set(text)
    if not _BREAK_CHARACTERS.isdisjoint(held):
        text = _BREAKS.sub("\n", text)
    if not _MAPPED.isdisjoint(held):
        text = _mapped(text, held & _MAPPED)
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
        if not _FOREIGN.isdisjoint(text):
            text = _one_script(text)
    return (_TRAILING.sub("", text) if " \n" in text else text).strip(" \n")


def changed_by_form(characters: list[str]) -> np.ndarray:
    """Which characters the form may change, alone or beside others; blanks at the ends of lines are changed besides."""
    seconds = {int(d[1], 16) for c in characters if len(d := unicodedata.decomposition(c).split()) == 2 and d[0][0] != "<"}

    def of(c: str) -> bool:
        composes = unicodedata.combining(c) or ord(c) in seconds or 0x1160 <= ord(c) < 0x1200
        return bool(composes or c in _BREAK_CHARACTERS or c in _MAPPED or c in _FOREIGN or unicodedata.normalize("NFC", c) != c)

    return np.array([of(c) for c in characters])


def _per_distinct(values: pa.Array, fn) -> pa.Array:
    codes = values.dictionary_encode()
    forms = pa.array([fn(v) for v in codes.dictionary.to_pylist()], pa.string())
    return pc.take(forms, codes.indices)


@F.arrow_udf(StringType())
def _form_udf(values: pa.Array) -> pa.Array:
    return _per_distinct(values, consistent_form)


def form(column: Column | str) -> Column:
    """Column of consistent forms."""
    return _form_udf(F.col(column) if isinstance(column, str) else column)


_PLAIN_WORD = re.compile(r"[^\W_]+")


def word_list(text: str) -> list[str]:
    """Maximal runs of letters and digits, in the case they have."""
    return _PLAIN_WORD.findall(text)


def words(form_column: Column) -> Column:
    """Words of a text: maximal runs of letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(form_column), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def occupation_key(column: Column) -> Column:
    """Lower case, trimmed, single inner spaces; null, blank and (unknown) are all (unknown)."""
    flat = F.trim(F.regexp_replace(F.lower(column), r"(?U)\s+", " "))
    return F.when(flat.isNull() | (flat == ""), F.lit("(unknown)")).otherwise(flat)


def task_key(column: Column) -> Column:
    """Trimmed lower-case task id; null for null, blank and page_N ids, which identify nothing."""
    flat = F.lower(F.regexp_replace(column, r"(?U)^\s+|\s+$", ""))
    return F.when((flat == "") | flat.rlike(r"^page_\d+$"), F.lit(None)).otherwise(flat)


def consistent_forms(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, consistent_form, is_changed) for every row; null text gives null form and null flag."""
    return rows.select(F.col(id_col), F.col(text_col).alias("_raw")).select(
        F.col(id_col), form("_raw").alias("consistent_form"), F.col("_raw")
    ).select(id_col, "consistent_form", (F.col("_raw") != F.col("consistent_form")).alias("is_changed"))


def _looks(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, raw_key, look): digests of the text and of its form; rows of null and blank texts are left out."""
    keyed = (
        rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("raw"))
        .where(F.col("raw").isNotNull())
        .select("id", F.md5("raw").alias("raw_key"), F.md5(form("raw")).alias("look"))
    )
    # Written once: a filter on a form, or a second use of it, would compute every form again.
    return materialize(keyed, "looks").where(F.col("look") != F.md5(F.lit("")))


def look_alike_classes(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, class_id, writings, copies): one row per record whose look is written in several ways; no pairs are formed.

    ``class_id`` is the smallest id of the look, ``writings`` its different writings, ``copies`` its rows.
    """
    keyed = _looks(rows, id_col, text_col)
    # Counted per writing first, so a look of any number of rows is one row per writing.
    writings = keyed.groupBy("look", "raw_key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    looks = writings.groupBy("look").agg(F.min("first").alias("class_id"), F.count(F.lit(1)).alias("writings"), F.sum("n").alias("copies")).where("writings > 1")
    return keyed.join(looks, "look").select(F.col("id").alias(id_col), "class_id", "writings", "copies")


def folded_form(text: str | None) -> str | None:
    """The consistent form in full case folding, for comparisons that ignore case."""
    form = consistent_form(text)
    return None if form is None else unicodedata.normalize("NFC", form.casefold())


@F.arrow_udf(StringType())
def folded(values: pa.Array) -> pa.Array:
    """Column of folded forms."""
    return _per_distinct(values, folded_form)


def look_alike_pairs(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Pairs (id_a < id_b) of rows whose texts look the same but are not the same characters.

    Keys are 128-bit digests, so only ids and digests are shuffled, never texts. Groups in which all
    raw texts are equal are dropped by a pre-aggregated min/max test before any pair is formed. Null and
    blank texts are in no pair; repeated rows of equal characters pair only with differing characters.
    """
    keyed = _looks(rows, id_col, text_col)
    mixed = keyed.groupBy("look").agg(F.min("raw_key").alias("lo"), F.max("raw_key").alias("hi")).where("lo != hi").select("look")
    inside = keyed.join(mixed, "look", "left_semi")
    left = inside.select("look", F.col("id").alias("a"), F.col("raw_key").alias("ka"))
    right = inside.select("look", F.col("id").alias("b"), F.col("raw_key").alias("kb"))
    return left.join(right, "look").where("a < b and ka != kb").select(F.col("a").alias(f"{id_col}_a"), F.col("b").alias(f"{id_col}_b"))
