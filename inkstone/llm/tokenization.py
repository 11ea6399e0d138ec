"""Encoding of a corpus with a public tokenizer (problem 8): content-defined chunk reuse.

A rolling hash over the code points of a text places chunk borders where the content says so, hence texts
that share passages share chunks. Each distinct chunk is encoded once per task and kept in a bounded
cache. A join of two chunks is exact where the tokenizer's own splitting rule always splits: at a blank
between two letters. Any other join is repaired by encoding the two sides together, and on to the next
chunk, until a join that is exact; so the ids equal those of the undivided text.

Encoding is row-wise: no shuffle, and memory is bounded by the cache and one Arrow batch. Defined
results: empty and null texts give an empty list; special tokens' names within a text are ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEAN_CHUNK = 256
WINDOW = 8
CACHE_CHARS = 32_000_000


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_encoding(path: str):
    """The byte-level encoding of a rank file."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _powers() -> np.ndarray:
    return np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(WINDOW)], dtype=np.uint64)


_POWERS = _powers()


def borders(text: str, mean: int = MEAN_CHUNK) -> list[int]:
    """Positions at which the rolling hash of the last ``WINDOW`` code points ends a chunk.

    A border is moved on to the next blank between letters, if there is one before the next border.
    """
    n = len(text)
    if n <= mean:
        return []
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    rolled = np.zeros(n - WINDOW + 1, dtype=np.uint64)
    for k in range(WINDOW):
        rolled += points[k : n - WINDOW + 1 + k] * _POWERS[k]
    rolled ^= rolled >> np.uint64(29)
    rolled *= np.uint64(0xBF58476D1CE4E5B9)
    hits = np.flatnonzero((rolled >> np.uint64(32)) % np.uint64(mean) == 0) + WINDOW
    out: list[int] = []
    for i, at in enumerate(hits.tolist()):
        end = int(hits[i + 1]) if i + 1 < len(hits) else n
        blank = text.find(" ", at, end)
        while blank > 0 and not is_exact(text, blank):
            blank = text.find(" ", blank + 1, end)
        at = blank if blank > 0 else at
        if at < n and (not out or at > out[-1]):
            out.append(at)
    return out


def is_exact(text: str, at: int) -> bool:
    """Whether the splitting rule always splits before ``at``: a blank with a letter on either side."""
    return 0 < at < len(text) - 1 and text[at] == " " and text[at - 1].isalpha() and text[at + 1].isalpha()


class ChunkEncoder:
    """Encodes texts by chunks; a chunk met again is not encoded again."""

    def __init__(self, encoding, cache_chars: int = CACHE_CHARS):
        self.encode_ordinary = encoding.encode_ordinary
        self.cache: dict[str, list[int]] = {}
        self.held, self.limit = 0, cache_chars
        self.encoded = self.reused = 0

    def _chunk(self, chunk: str) -> list[int]:
        ids = self.cache.get(chunk)
        if ids is None:
            ids = self.encode_ordinary(chunk)
            self.encoded += 1
            if self.held + len(chunk) > self.limit:
                self.cache.clear()
                self.held = 0
            self.cache[chunk] = ids
            self.held += len(chunk)
        else:
            self.reused += 1
        return ids

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        start = 0
        for at in borders(text):
            # A join that may not be exact is repaired: both sides are encoded as one.
            if is_exact(text, at):
                ids += self._chunk(text[start:at])
                start = at
        return ids + self._chunk(text[start:]) if start < len(text) else ids


def encode_corpus(documents: DataFrame, id_col: str, text_col: str, path: str | None = None) -> DataFrame:
    """(id, ids) of every row; ``path`` is the tokenizer's rank file, present on every executor."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(load_encoding(path))
        for batch in batches:
            ends, flat = [0], []
            for text in batch.column(1).to_pylist():
                if text:
                    flat.extend(encoder.encode(text))
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.record_batch([batch.column(0), ids], names=[id_col, "ids"])

    return documents.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(run, f"{id_col} bigint, ids array<int>")
