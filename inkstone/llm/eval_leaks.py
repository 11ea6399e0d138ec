"""Evaluation texts leaking into training text (problem 9): Wu-Manber search over words.

Every run of ``run`` consecutive words of a test item is a pattern. A shift table over blocks of
``BLOCK`` words tells how far the search may jump without missing a pattern end; where the shift is
zero, a suffix-hash bucket names the test strings that may end here and a direct comparison of all words
confirms them. Documents are scanned in one pass without a shuffle.

The tables go to every task, so their size is checked: test items are searched in blocks of at most
``BLOCK_WORDS`` item words, one pass over the documents per block, so no test set is too large and none
is cut.

Case, punctuation, spacing, layout and markup are dropped from both sides. Defined results: null texts
and items of fewer than ``run`` words are in no pair; repeated rows give one pair per id; two texts under
one item id are both searched.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.text_forms import consistent_form, word_list

BLOCK = 2
BLOCK_WORDS = 2_000_000

# Names of HTML elements that are markup, not words, when they stand in angle brackets.
_TAG = re.compile(
    r"</?(?:a|abbr|article|b|blockquote|body|br|center|code|dd|div|dl|dt|em|figure|font|footer|h[1-6]|head|header|hr|html|i|img|li|link|main"
    r"|mark|meta|nav|ol|p|pre|s|section|small|span|strong|sub|sup|table|tbody|td|tfoot|th|thead|title|tr|tt|u|ul)(?:\s[^<>]*)?/?>",
    re.IGNORECASE,
)


def plain_words(text: str | None) -> list[str]:
    """Words without markup, in folded case."""
    if not text:
        return []
    text = consistent_form(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    return word_list(text.casefold())


class WuManber:
    """Shift table, suffix buckets and patterns of equal length over sequences of words."""

    def __init__(self, items: list[tuple[int, list[str]]], run: int):
        self.run = run
        self.items = items
        self.shift: dict[tuple[str, ...], int] = {}
        self.bucket: dict[tuple[str, ...], list[tuple[int, int]]] = {}
        for at, (_, words) in enumerate(items):
            for start in range(len(words) - run + 1):
                for end in range(BLOCK, run + 1):
                    block = tuple(words[start + end - BLOCK : start + end])
                    left = run - end
                    if left < self.shift.get(block, run):
                        self.shift[block] = left
                suffix = tuple(words[start + run - BLOCK : start + run])
                self.bucket.setdefault(suffix, []).append((at, start))
        self.jump = run - BLOCK + 1

    def search(self, words: list[str]) -> set[int]:
        """Items of which some pattern stands in ``words``."""
        found: set[int] = set()
        run, shift, jump, at, n = self.run, self.shift, self.jump, self.run, len(words)
        while at <= n:
            block = tuple(words[at - BLOCK : at])
            step = shift.get(block, jump)
            if step == 0:
                window = words[at - run : at]
                for k, start in self.bucket[block]:
                    item, text = self.items[k]
                    if item not in found and text[start : start + run] == window:
                        found.add(item)
                step = 1
            at += step
        return found


def _blocks(items: DataFrame, item_id: str, text: str, block_words: int) -> Iterator[list[tuple[int, list[str]]]]:
    block: list[tuple[int, list[str]]] = []
    held = 0
    for row in items.select(item_id, text).toLocalIterator():
        words = plain_words(row[1])
        if block and held + len(words) > block_words:
            yield block
            block, held = [], 0
        block.append((row[0], words))
        held += len(words)
    if block:
        yield block


def leaked_items(
    documents: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str, run: int = 12, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """(doc_id, item_id): each document with each item of which it holds ``run`` consecutive words."""
    schema = f"{doc_id} bigint, {item_id} bigint"
    found: DataFrame | None = None
    for block in _blocks(items, item_id, item_text, block_words):
        shared = documents.sparkSession.sparkContext.broadcast([x for x in block if len(x[1]) >= run])

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            tables = WuManber(shared.value, run)
            for batch in batches:
                docs, hits = [], []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for item in tables.search(plain_words(text)):
                        docs.append(doc)
                        hits.append(item)
                yield pa.record_batch({doc_id: pa.array(docs, pa.int64()), item_id: pa.array(hits, pa.int64())})

        part = documents.select(F.col(doc_id).cast("bigint"), F.col(doc_text)).where(F.col(doc_text).isNotNull()).mapInArrow(scan, schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return documents.sparkSession.createDataFrame([], schema)
    return found.distinct()
