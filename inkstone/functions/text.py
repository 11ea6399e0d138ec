"""Text preparation as columns: words, sentences, language gate, masks, shingles, n-grams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkstone.functions import regex, tables


def words(text: Column) -> Column:
    """Tokens between white space."""
    return F.regexp_extract_all(text, F.lit(r"((?U)\S+)"), F.lit(1))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def word_tokens(text: Column) -> Column:
    """Letters, digits and underscores in runs, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{M}\p{N}_]+)"), F.lit(1))


def proxy_tokens(text: Column) -> Column:
    """Word runs and single symbols, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"((?U)\w+|[^\w\s])"), F.lit(1))


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)(?<=[.!?])\s+"), lambda s: s.rlike(r"(?U)\S"))


def long_sentences(text: Column) -> Column:
    """Sentences that a capital or a quote follows, trimmed, of more than ten characters."""
    parts = F.split(text, r"""(?U)(?<=[.!?])\s+(?=[A-Z"'])""")
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: F.length(s) > 10)


def function_words_in(tokens: Column) -> Column:
    return F.size(F.filter(tokens, lambda w: w.isin(tables.FUNCTION_WORDS)))


def words_in(text: Column, listed: list[str]) -> Column:
    """How many tokens of a text are in a list of lower-case words."""
    return F.size(F.filter(word_tokens(text), lambda w: w.isin(listed)))


def type_token_ratio(tokens: Column) -> Column:
    return F.when(F.size(tokens) > 0, F.size(F.array_distinct(tokens)) / F.size(tokens)).otherwise(0.0)


def length_bin(count: Column) -> Column:
    return F.when(count < 100, "short").when(count < 300, "medium").when(count < 800, "long").otherwise("very_long")


def language_gate(text: Column) -> Column:
    """support_level, function word coverage and share of letters outside Latin."""
    n = word_count(text)
    covered = function_words_in(words(F.lower(text))) / F.greatest(n, F.lit(1))
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    latin = F.regexp_count(text, F.lit(r"[A-Z\x5b-\x60a-zÀ-ɏ&&\p{L}]"))
    foreign = (letters - latin) / F.greatest(letters, F.lit(1))
    level = (
        F.when(n < 30, "REVIEW")
        .when(foreign > 0.30, "UNSUPPORTED")
        .when(covered < 0.08, "UNSUPPORTED")
        .when(covered < 0.12, "REVIEW")
        .when(foreign > 0.10, "REVIEW")
        .otherwise("SUPPORTED")
    )
    enough = n >= 30
    return F.struct(
        level.alias("support_level"),
        F.when(enough, F.round(covered, 4)).otherwise(0.0).alias("fw_coverage"),
        F.when(enough, F.round(foreign, 4)).otherwise(0.0).alias("non_latin_ratio"),
    )


def mask_topics(text: Column) -> tuple[Column, Column]:
    """(text with topical content replaced, number of replacements)."""
    n = F.lit(0)
    for stand_in, pattern in tables.TOPIC_MASKS:
        n = n + regex.count(text, pattern)
        text = F.regexp_replace(text, regex.java(pattern), stand_in)
    return text, n


def ngrams(tokens: Column, n: int) -> Column:
    """Space-joined runs of n tokens, in order, repeats kept; none if there are fewer tokens."""
    runs = F.transform(F.sequence(F.lit(1), F.size(tokens) - F.lit(n - 1)), lambda i: F.concat_ws(" ", *[F.get(tokens, i + k - 1) for k in range(n)]))
    return F.when(F.size(tokens) >= n, runs).otherwise(F.array().cast("array<string>"))


def bound(value: Column, fn) -> Column:
    """Apply ``fn`` to a value computed once, not once for each use inside nested lambdas."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def shingle_set(text: Column, k: int = 3) -> Column:
    """Distinct k-word shingles; a shorter text is one shingle, an empty one none."""

    def of(w: Column) -> Column:
        short = F.when(F.size(w) > 0, F.array(F.concat_ws(" ", w))).otherwise(F.array().cast("array<string>"))
        return F.when(F.size(w) >= k, F.array_distinct(ngrams(w, k))).otherwise(short)

    return bound(word_tokens(text), of)


def jaccard(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), shared / (F.size(a) + F.size(b) - shared)).otherwise(0.0)


def item_bits(hashes: Column, words: int = 8) -> Column:
    """A set of 64-bit hashes as a bitmap of so many 64-bit words."""
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    bit = lambda x, w: F.when(F.pmod(F.shiftright(x, 6), F.lit(words)) == w, F.call_function("shiftleft", one, x.bitwiseAND(F.lit(63)).cast("int"))).otherwise(zero)
    return F.transform(F.sequence(F.lit(0), F.lit(words - 1)), lambda w: F.aggregate(hashes, zero, lambda bits, x: bits.bitwiseOR(bit(x, w))))


def may_share(a: Column, b: Column, size_a: Column, size_b: Column, threshold: float) -> Column:
    """Whether the bitmaps of two sets leave room for a Jaccard similarity: a bit of one that the other lacks is an item not shared."""
    lacking = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: F.bit_count(u.bitwiseAND(F.bitwise_not(v)))), F.lit(0), lambda s, n: s + n)
    return F.least(size_a - lacking(a, b), size_b - lacking(b, a)) + F.lit(1e-9) >= F.lit(threshold / (1 + threshold)) * (size_a + size_b)


def mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x, lambda s: s / F.size(values))


def stdev(values: Column, population: bool = False) -> Column:
    """Standard deviation in two passes; null below two values (one for the population)."""
    spread = lambda m: F.aggregate(values, F.lit(0.0), lambda s, x: s + (x - m) * (x - m))
    n = F.size(values)
    squares = bound(mean(values), spread)
    return F.when(n >= (1 if population else 2), F.sqrt(squares / (n if population else n - 1)))


def attack_types(text: Column, normal_ws: Column | None = None) -> Column:
    """Kinds of evasion visible in a raw text that expressions can tell."""
    invisible = F.length(text) - F.length(F.translate(text, tables.INVISIBLE, ""))
    look_alike = F.length(text) - F.length(F.translate(text, "".join(tables.HOMOGLYPHS), ""))
    spaced = regex.count(text, r"(?<!\w)(\w) (\w) (\w) (\w)(?!\w)")
    return F.filter(
        F.array(
            F.when(invisible > 0, "invisible_char"),
            F.when(look_alike > 0, "homoglyph"),
            F.when(spaced > 0, "interspacing"),
            F.when(regex.has(text, r"[ \t]{2,}|\t|\n{3,}|^\s|\s$"), "whitespace"),
        ),
        lambda x: x.isNotNull(),
    )
