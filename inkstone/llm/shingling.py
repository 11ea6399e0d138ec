"""Hashed words and word shingles of whole Arrow batches (used by problems 3 and 6).

Words are hashed once per distinct word and batch; shingles, their sorting per row and their signatures are
array operations over the whole batch. A column of texts is brought to its consistent form and split into
words here, many texts at once; a column of word arrays is taken as it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.types as pt
import xxhash

from inkstone.llm.text_forms import changed_by_form, consistent_form

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], dtype=np.uint64)
#: Rows worked on together: bounds the arrays of a task whatever the length of a batch.
PIECE = 2048
#: Characters of texts split into words together, and those of a word that is hashed on its own.
CHARACTERS, LONG = 1 << 18, 256


class WordHashes(dict):
    KEPT = 500_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.KEPT:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(column: pa.Array, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, hashes): the words of each row in order, as hashes, one row after another."""
    if pt.is_list(column.type) or pt.is_large_list(column.type):
        sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = column.flatten().dictionary_encode()
        distinct = np.array([known[w] if w is not None else 0 for w in coded.dictionary.to_pylist()] or [0], dtype=np.uint64)
        return sizes, distinct[coded.indices.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)]
    texts = [t or "" for t in column.to_pylist()]
    ends = np.cumsum([len(t) + 1 for t in texts])
    found, at = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))], 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHARACTERS, "right")))
        found.append(_words_of(texts[at:end], known))
        at = end
    return tuple(np.concatenate(x) for x in zip(*found))


@lru_cache(1)
def _characters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each code point: whether a word holds it, whether the consistent form may change it, and a random number."""
    every = [chr(o) for o in range(0x110000)]
    # Beyond the first planes few texts have letters; their texts are brought to the form one by one.
    changed = np.ones(len(every), bool)
    changed[:0x20000] = changed_by_form(every[:0x20000])
    return np.array([c.isalnum() for c in every]), changed, mixed(np.arange(1, 0x110001, dtype=np.uint64))


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd number and of its inverse, modulo 2^64."""
    odd = int(_ODD[0])
    return tuple(np.multiply.accumulate(np.array([1, x], np.uint64)[np.minimum(np.arange(n), 1)]) for x in (odd, pow(odd, -1, 1 << 64)))


def _code_points(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """(joined, code points, starts): the texts, each closed by a line break."""
    joined = "\n".join([*texts, ""])
    return joined, np.frombuffer(joined.encode("utf-32-le"), np.uint32), starts(np.array([len(t) + 1 for t in texts], np.int64))


def _words_of(texts: list[str], known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, hashes) of the words of the texts' consistent forms in lower case: runs of letters and digits.

    Words are told apart by sums over their letters, so that only one of equal words is cut out and hashed.
    """
    of_word, changed, numbers = _characters()
    _, points, begin = _code_points(texts)
    # Texts without such characters differ from their forms in blanks only.
    for i in np.unique(np.searchsorted(begin, np.flatnonzero(changed[points]), "right") - 1).tolist():
        texts[i] = consistent_form(texts[i])
    joined, points, begin = _code_points([t.lower() for t in texts])
    inside = np.concatenate([[False], of_word[points]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    first, last = edges[::2], edges[1::2]
    power, inverse = _powers(1 << max(CHARACTERS.bit_length(), len(points).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(numbers[points] * power[: len(points)], dtype=np.uint64)])
    keys = (sums[last] - sums[first]) * inverse[first]
    for i in np.flatnonzero(last - first > LONG).tolist():
        keys[i] = known[joined[first[i] : last[i]]]
    coded = pa.array(keys).dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    one = np.zeros(len(coded.dictionary), np.int64)
    one[codes] = np.arange(len(codes))
    distinct_words = [known[joined[i:j]] for i, j in zip(first[one].tolist(), last[one].tolist())]
    return np.diff(np.searchsorted(first, begin)), np.array(distinct_words, np.uint64)[codes] if len(codes) else np.zeros(0, np.uint64)


def runs(sizes: np.ndarray, hashes: np.ndarray, width: int, seeds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash) of every run of ``width`` words within a row; rows of equal words differ by their seeds."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out = mixed(out + hashes[k : n + k] * _ODD[k % 4] + np.uint64(k))
    same = owner[:n] == owner[width - 1 :]
    out, owner = out[same], owner[:n][same]
    return owner, mixed(out + seeds[owner]) if seeds is not None else out


def _by_row(owner: np.ndarray, signed: np.ndarray, rows: int) -> np.ndarray:
    """Order by row and value: by one key of the row and the leading bits, unless those leave different values equal."""
    bits = max(1, rows).bit_length()
    leading = (signed.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(bits)
    key = (owner.astype(np.uint64) << np.uint64(64 - bits)) | leading
    order = np.argsort(key)
    key, value = key[order], signed[order]
    if ((key[1:] == key[:-1]) & (value[1:] != value[:-1])).any():
        return np.lexsort((signed, owner))
    return order


def distinct(owner: np.ndarray, hashes: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, hashes): the distinct hashes of each row, sorted as signed numbers."""
    signed = hashes.view(np.int64)
    order = _by_row(owner, signed, rows)
    owner, signed = owner[order], signed[order]
    first = np.ones(len(owner), dtype=bool)
    first[1:] = (owner[1:] != owner[:-1]) | (signed[1:] != signed[:-1])
    return np.bincount(owner[first], minlength=rows), signed[first]


def starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


def per_row(values: np.ndarray, sizes: np.ndarray, reduce: np.ufunc) -> np.ndarray:
    """``reduce`` over the values of each row that has any; others give 0."""
    out = np.zeros(len(sizes), dtype=values.dtype)
    full = sizes > 0
    if full.any():
        out[full] = reduce.reduceat(values, starts(sizes)[:-1][full])
    return out


def signatures(sizes: np.ndarray, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit signature of each set, in two columns."""
    h = sets.view(np.uint64)
    one, two = (per_row(mixed(h ^ s), sizes, np.add) for s in (_ODD[0], _ODD[1]))
    return mixed(one + sizes.astype(np.uint64)).view(np.int64), mixed(two ^ sizes.astype(np.uint64)).view(np.int64)


def minhashes(sizes: np.ndarray, sets: np.ndarray, count: int) -> np.ndarray:
    """Least value of each row's set under ``count`` hash functions, 32 bits each; 0 for empty sets."""
    h = sets.view(np.uint64)
    salts = np.arange(1, count + 1, dtype=np.uint64) * _ODD[2]
    columns = [per_row((mixed(h + salts[k]) >> np.uint64(32)).astype(np.uint32), sizes, np.minimum) for k in range(count)]
    return np.stack(columns, axis=1) if columns else np.zeros((len(sizes), 0), np.uint32)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = PIECE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def lists(sizes: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(starts(sizes), pa.int32()), pa.array(values, pa.int64()))


def shingled_batches(width: int):
    """For mapInArrow: (id, seed, words or text) to (id, s1, s2, n, sh) of the rows that have shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in pieces(batches):
            words, hashes = word_hashes(batch.column(2), known)
            seeds = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            sizes, sets = distinct(*runs(words, hashes, width, seeds if seeds.any() else None), batch.num_rows)
            s1, s2 = signatures(sizes, sets)
            kept = sizes > 0
            mask = pa.array(kept)
            yield pa.record_batch(
                [batch.column(0).filter(mask), pa.array(s1[kept]), pa.array(s2[kept]), pa.array(sizes[kept].astype(np.int32)), lists(sizes[kept], sets)],
                names=["id", "s1", "s2", "n", "sh"],
            )

    return run


SHINGLED = "id bigint, s1 bigint, s2 bigint, n int, sh array<bigint>"
