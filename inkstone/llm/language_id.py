"""Language of documents and of the segments of mixed ones (problem 7): error-correcting output codes.

Every language has a codeword; one binary classifier per bit predicts it from character n-grams and
words, hashed to a fixed number of weights. Decoding takes the codeword of least loss, each bit weighted
by how reliable its classifier proved, and flags a segment as ambiguous when the runner-up is close.

The classifiers are fitted on a bounded sample of labelled rows: at most ``SAMPLE_PER_LANGUAGE`` rows per
language, those of smallest row hash, whatever the size of the data. Labels of the sample may be wrong,
so segments are relabelled by each fit before the next. Everything
else covers all rows: each text is cut into sentences (long runs without stops into windows), every
segment is decoded, and a language belongs to a text if a segment of at least ``MIN_WORDS`` words is in it, or a
shorter sentence that ends in a mark and is decoded as surely as ``SHORT_SURE``.

Defined results: null and blank texts have no languages; a text too short for a whole segment is decoded
as one; without any labelled row nothing can be fitted and no text has a language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.llm.text_forms import consistent_form

LANGUAGES = ("en", "fr", "de", "es", "pt", "it", "nl", "ru", "zh")
SAMPLE_PER_LANGUAGE = 300
SEGMENTS_PER_LANGUAGE = 1500
DIMENSIONS = 1 << 14
BITS = 15
MIN_WORDS = 5
MIN_HAN = 7
#: A shorter sentence counts as well if it ends in a mark, has at least this many words (or Han characters) and is as sure.
SHORT_WORDS = 3
SHORT_HAN = 4
SHORT_SURE = 0.99
WINDOW_WORDS = 14
AMBIGUOUS = 0.9
SMOOTHING = 0.5
TEMPERATURE = 4.0

# Ways in which a label names a language (ISO 639 codes and English names).
LABELS = {
    "en": "en eng english", "fr": "fr fra fre french", "de": "de deu ger german", "es": "es spa spanish castilian",
    "pt": "pt por portuguese", "it": "it ita italian", "nl": "nl nld dut dutch flemish", "ru": "ru rus russian", "zh": "zh zho chi cmn chinese mandarin",
}
# Labels that name no language.
NO_LANGUAGE = ("", "und", "undetermined", "unknown", "mul", "mis", "zxx", "n/a", "na", "none", "null", "xx", "?", "-")


def label_language(label: Column) -> Column:
    """Language code a label names; '' if it names none; the label itself if it names another language."""
    flat = F.lower(F.regexp_replace(F.coalesce(label, F.lit("")), r"(?U)^\s+|\s+$", ""))
    head = F.get(F.split(flat, r"[-_ ]"), F.lit(0))
    out = F.when(flat.isin(*NO_LANGUAGE) | head.isin(*NO_LANGUAGE), F.lit(""))
    for code, names in LABELS.items():
        out = out.when(head.isin(*names.split()), F.lit(code))
    return out.otherwise(flat)


_STOP = re.compile("(?<=[.!?…])\\s+|(?<=[。！？!?])|\n+|(?<=;)\\s+")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_HAN = re.compile("[㐀-鿿]")


def segments(text: str) -> list[tuple[int, int, str]]:
    """(start, end, text) of sentences; runs of words without a stop are cut into windows."""
    out, at = [], 0
    bounds = [m.span() for m in _STOP.finditer(text)] + [(len(text), len(text))]
    for stop, after in bounds:
        if stop > at:
            part = text[at:stop]
            words = list(re.finditer(r"\S+", part)) if part.count(" ") >= 2 * WINDOW_WORDS else ()
            if len(words) > 2 * WINDOW_WORDS:
                count = len(words) // WINDOW_WORDS
                cuts = [words[k * len(words) // count].start() for k in range(count)] + [len(part)]
                out += [(at + a, at + b, part[a:b]) for a, b in zip(cuts, cuts[1:])]
            else:
                out.append((at, stop, part))
        at = after
    return out


def _clean(part: str) -> list[str]:
    """Words that can tell a language, case folded; digits tell none."""
    return _WORD.findall(part.casefold())


def _script(points: np.ndarray) -> np.ndarray:
    return np.select([points < 0x250, (points >= 0x400) & (points < 0x530), (points >= 0x3400) & (points < 0xA000)], [1, 2, 3], 4).astype(np.uint64)


def features(parts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """(slots, segment of each slot): hashed words, trigrams, and scripts of characters other than Latin."""
    flat = "".join(" " + " ".join(ws) + " " for ws in parts)
    sizes = np.array([len(" ".join(ws)) + 2 for ws in parts], dtype=np.int64)
    c = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(parts)), sizes)
    p, q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    mixed = c * p
    blank = c == 32
    three = ((mixed[:-2] * q + mixed[1:-1]) * q + mixed[2:]) if len(c) > 2 else mixed[:0]
    same3 = owner[:-2] == owner[2:]
    # A word's hash is the difference of prefix sums of position-free character hashes and its length.
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    m = mixed ^ (mixed >> np.uint64(31))
    place = np.arange(len(c), dtype=np.int64)
    first = np.zeros(len(c), dtype=np.int64)
    first[starts] = starts
    first = np.maximum.accumulate(first)
    powers = np.multiply.accumulate(np.full(64, 0x100000001B3, dtype=np.uint64))
    weighted = np.cumsum(m * powers[np.minimum(place - first, 63)])
    words = weighted[ends - 1] - weighted[starts - 1]
    hashed = np.concatenate([three[same3] + np.uint64(3), words + np.uint64(5)])
    hashed ^= hashed >> np.uint64(33)
    hashed *= np.uint64(0xFF51AFD7ED558CCD)
    slots = ((hashed >> np.uint64(40)) % np.uint64(DIMENSIONS - 8)).astype(np.int64) + 8
    letters = c >= 0x250
    return (
        np.concatenate([slots, _script(c[letters]).astype(np.int64)]),
        np.concatenate([owner[:-2][same3], owner[starts], owner[letters]]),
    )


def codewords(languages: int, bits: int = BITS) -> np.ndarray:
    """Rows of +1/-1, chosen at random under a fixed seed for the widest least distance of rows and columns."""
    rng, best, most = np.random.default_rng(11), None, -1
    for _ in range(200):
        book = rng.choice(np.array([-1, 1], dtype=np.int8), size=(languages, bits))
        if (np.abs(book.sum(0)) == languages).any():
            continue
        apart = min((book[a] != book[b]).sum() for a in range(languages) for b in range(a))
        columns = min(min((book[:, a] != book[:, b]).sum(), (book[:, a] == book[:, b]).sum()) for a in range(bits) for b in range(a))
        if columns and 10 * apart + columns > most:
            best, most = book, 10 * apart + columns
    return best


class OutputCodes:
    """Binary classifiers of the codeword bits and their loss-weighted decoding."""

    SCALE = 8.0

    def __init__(self, languages: tuple[str, ...]):
        self.languages = languages
        self.book = codewords(len(languages)).astype(np.float32)
        self.weights = np.zeros((DIMENSIONS, BITS), dtype=np.float32)
        self.bias = np.zeros(BITS, dtype=np.float32)
        self.reliability = np.ones(BITS, dtype=np.float32)

    def margins(self, parts: list[list[str]]) -> np.ndarray:
        slots, owner = features(parts)
        n = len(parts)
        order = np.argsort(owner, kind="stable")
        slots, owner = slots[order], owner[order]
        counts = np.bincount(owner, minlength=n)
        out = np.zeros((n, BITS), dtype=np.float32)
        if len(slots):
            present = np.flatnonzero(counts)
            starts = np.concatenate([[0], np.cumsum(counts[present])[:-1]])
            out[present] = np.add.reduceat(self.weights[slots], starts, axis=0) / counts[present, None]
        return out * self.SCALE + self.bias

    def losses(self, margins: np.ndarray) -> np.ndarray:
        signed = margins[:, None, :] * self.book[None, :, :]
        return (np.logaddexp(0, -signed) * self.reliability).sum(2)

    def decode(self, parts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest codeword, confidence) of each segment."""
        losses = self.losses(self.margins(parts))
        share = np.exp((losses.min(1, keepdims=True) - losses) / TEMPERATURE)
        best = losses.argmin(1)
        return best, 1.0 / share.sum(1)

    def fit(self, parts: list[list[str]], labels: np.ndarray) -> None:
        """Log odds of each n-gram between the two language sets of each bit, languages weighing alike."""
        slots, owner = features(parts)
        counts = np.bincount(labels[owner] * DIMENSIONS + slots, minlength=len(self.languages) * DIMENSIONS).reshape(-1, DIMENSIONS)
        rates = (counts + SMOOTHING) / (counts.sum(1, keepdims=True) + SMOOTHING * DIMENSIONS)
        rates[counts.sum(1) == 0] = 1.0 / DIMENSIONS
        for b in range(BITS):
            yes = self.book[:, b] > 0
            self.weights[:, b] = np.clip(np.log(rates[yes].mean(0)) - np.log(rates[~yes].mean(0)), -4, 4)
        share = np.bincount(labels, minlength=len(self.languages))
        weight = 1.0 / share[labels]
        right = ((np.sign(self.margins(parts)) == self.book[labels]) * weight[:, None]).sum(0) / weight.sum()
        right = np.clip(right, 0.51, 0.999)
        self.reliability = np.log(right / (1 - right)).astype(np.float32)
        self.reliability /= self.reliability.mean()


def train(labelled: list[tuple[str, str]], languages: tuple[str, ...] = LANGUAGES) -> OutputCodes:
    """Fit on (text, language) pairs whose labels may be wrong for some."""
    parts, labels, held = [], [], dict.fromkeys(languages, 0)
    for text, language in labelled:
        for _, _, part in segments(consistent_form(text)):
            words = _clean(part)
            if held[language] < SEGMENTS_PER_LANGUAGE and _whole(words):
                parts.append(words)
                labels.append(languages.index(language))
                held[language] += 1
    model = OutputCodes(languages)
    if parts:
        labels = np.array(labels)
        model.fit(parts, labels)
        for _ in range(3):
            labels, _ = model.decode(parts)
            model = OutputCodes(languages)
            model.fit(parts, labels)
    return model


def _whole(words: list[str]) -> bool:
    return len(words) >= MIN_WORDS or sum(len(w) for w in words if _HAN.match(w)) >= MIN_HAN


def _short(part: str, words: list[str]) -> bool:
    """Whether a part is a sentence by its mark, though too short to be trusted unless it is decoded surely."""
    return part.rstrip()[-1:] in tuple(".!?…。！？") and (len(words) >= SHORT_WORDS or sum(len(w) for w in words if _HAN.match(w)) >= SHORT_HAN)


def detect(model: OutputCodes, texts: list[str | None]) -> list[list[tuple[int, int, str, float, bool, bool]]]:
    """Segments (start, end, language, confidence, ambiguous, whole) of each text's consistent form."""
    owners, spans, parts, out = [], [], [], []
    for k, text in enumerate(texts):
        out.append([])
        form = consistent_form(text) if text else ""
        found = [(a, b, p, _clean(p)) for a, b, p in segments(form)] if form else []
        if any(_whole(words) for *_, words in found):
            kept = [(a, b, words, not _whole(words)) for a, b, p, words in found if _whole(words) or _short(p, words)]
        else:
            words = _clean(form)
            kept = [(0, len(form), words, False)] if words else []
        for a, b, words, short in kept:
            owners.append(k)
            spans.append((a, b, _whole(words), short))
            parts.append(words)
    if parts:
        best, confidence = model.decode(parts)
        for k, (a, b, whole, short), i, c in zip(owners, spans, best.tolist(), confidence.tolist()):
            if not short or c >= SHORT_SURE:
                out[k].append((a, b, model.languages[i], round(c, 4), c < AMBIGUOUS, whole or short))
    return out


def labelled_sample(texts: DataFrame, labels: DataFrame, key: str, text: str, label: str, per_language: int = SAMPLE_PER_LANGUAGE) -> list[tuple[str, str]]:
    """At most ``per_language`` (text, language) pairs of each language, by smallest hash of the key."""
    named = labels.select(key, label_language(F.col(label)).alias("lang")).where(F.col("lang").isin(*LANGUAGES))
    rank = Window.partitionBy("lang").orderBy(F.xxhash64(F.col(key)), F.col(key))
    chosen = named.withColumn("nth", F.row_number().over(rank)).where(F.col("nth") <= per_language).select(key, "lang")
    # At most per_language rows of each of the languages: bounded by parameters, so it may be broadcast.
    rows = texts.select(key, text).where(F.length(text) > 0).join(F.broadcast(chosen), key).select(key, text, "lang").collect()
    return [(r[1], r[2]) for r in sorted(rows, key=lambda r: (r[2], r[0], r[1]))]


SEGMENT_SCHEMA = "array<struct<start:int,end:int,lang:string,confidence:double,ambiguous:boolean,whole:boolean>>"


def detect_languages(texts: DataFrame, key: str, text: str, model: OutputCodes) -> DataFrame:
    """(key, segments) of every row; segments are empty for null and blank texts."""
    fitted = (model.weights, model.bias, model.reliability, model.languages)
    shared = texts.sparkSession.sparkContext.broadcast(fitted)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("ambiguous", pa.bool_()), ("whole", pa.bool_())]))
    names = ("start", "end", "lang", "confidence", "ambiguous", "whole")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, reliability, languages = shared.value
        mine = OutputCodes(languages)
        mine.weights, mine.bias, mine.reliability = weights, bias, reliability
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                found = detect(mine, piece.column(1).to_pylist())
                rows = pa.array([[dict(zip(names, s)) for s in one] for one in found], kind)
                yield pa.record_batch([piece.column(0), rows], names=[key, "segments"])

    return texts.select(F.col(key).cast("bigint").alias(key), F.col(text)).mapInArrow(run, f"{key} bigint, segments {SEGMENT_SCHEMA}")


def languages_of(found: DataFrame, key: str) -> DataFrame:
    """(key, langs, confidence): the languages of whole segments, or of the only segment there is."""
    sure = F.filter("segments", lambda s: s["whole"] & ~s["ambiguous"])
    kept = F.when(F.size(sure) > 0, sure).otherwise(F.slice(F.array_sort("segments", lambda a, b: F.sign(b["confidence"] - a["confidence"]).cast("int")), 1, 1))
    return found.select(key, kept.alias("kept")).select(
        key,
        F.array_sort(F.array_distinct(F.transform("kept", lambda s: s["lang"]))).alias("langs"),
        F.array_min(F.transform("kept", lambda s: s["confidence"])).alias("confidence"),
    )
