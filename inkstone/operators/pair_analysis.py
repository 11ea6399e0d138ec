"""Similarity of all pairs of rows of a group: exact baselines, flags by the group's own thresholds.

Rows of a group fall into blocks of bounded size by hash; every two blocks meet in one task, which works
through them in pieces of array code, so each pair is seen once and no pairs are listed but flagged ones.
Items of many rows are bits and are counted by words of 64; the others go through postings. Distances come
from matrix products and are computed again, directly, wherever their last digits could matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.session import materialize

BLOCK_ROWS = 16_384
#: Most partitions of a step over meetings of blocks.
PARTITIONS = 2_000
#: Pairs of a piece; items counted as bits are those of more than this share of the rows, and at most so many.
CELLS = 256 * 1_024
MANY = 1 / 32
BITS = 4_096
BINS = 65_536
CROSS = 4_000_000
#: Pairs that share fewer items are counted in a table by number and sizes.
SHARED = 64
#: Vectors of greater squared length, and pairs at smaller squared distances, are compared directly; what similarities by products may be off.
PLAIN_NORM = 1e3
CLOSE = 1e-6
MARGIN = 1e-7
# Absolute thresholds, least spreads and margins of the flags.
TEXT, STRUCTURAL = 0.40, 0.90
LEAST_SPREAD = 0.02
TEXT_MARGIN, STRUCTURAL_MARGIN = 0.05, 0.03
MEASURES = ("text", "structural")
FEATURES = 16


def prepared(rows: DataFrame, key: str, group: str, author: str | None, items: str, vector: str | None = None, factor_out: Column | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(k, g, author, s, v, block, blocks): hashed item sets without those of ``factor_out``, structural vectors, blocks."""
    s = F.array_distinct(items)
    s = s if factor_out is None else F.array_except(s, factor_out)
    name = F.lower(F.trim(F.coalesce(F.col(author), F.lit("")))) if author else F.lit("")
    v = F.coalesce(F.col(vector).cast("array<double>"), F.array_repeat(F.lit(0.0), FEATURES)) if vector else F.lit(None).cast("array<double>")
    sets = rows.select(F.col(key).cast("bigint").alias("k"), F.col(group).alias("g"), name.alias("author"), F.transform(s, lambda x: F.xxhash64(x)).alias("s"), v.alias("v"))
    sets = materialize(sets, "sets")
    blocks = sets.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
    return sets.join(blocks, sets["g"].eqNullSafe(blocks["g"])).drop(blocks["g"]).withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int"))


def _meetings(sets: DataFrame) -> DataFrame:
    """Each row once for every block it meets, grouped by the two blocks."""
    met = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("other")
    # Work goes by pairs, not by bytes: a fixed number of partitions, which are not put together again for being small.
    blocks = sets.groupBy("g").agg(F.max("blocks").cast("bigint").alias("b")).agg(F.sum(F.expr("b * (b + 1) div 2"))).first()[0]
    return met.repartition(min(max(2 * (blocks or 1), 8), PARTITIONS), "g", "lo", "hi").groupBy("g", "lo", "hi")


class _Block:
    """Rows of one block: their places, set sizes, shared items as bits (those of many rows) and as postings (the others), vectors."""

    def __init__(self, at: np.ndarray, sizes: np.ndarray, starts: np.ndarray, codes: np.ndarray, word: np.ndarray, few: np.ndarray, words: int, vectors: np.ndarray | None):
        self.at = at
        # A row without items shares none, so a size of one gives it the same zeros.
        self.sizes = np.maximum(sizes[at], 1).astype(np.int32)
        self.vectors = None if vectors is None else vectors[at]
        self.norms = None if vectors is None else np.einsum("ij,ij->i", self.vectors, self.vectors)
        n = sizes[at]
        owner = np.repeat(np.arange(len(at)), n)
        code = codes[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - starts[at], n)]
        bit = word[code]
        held = bit >= 0
        bits = np.zeros((words, len(at)), np.uint64)
        # Items of a row are distinct, so adding sets each bit once.
        np.add.at(bits.reshape(-1), (bit[held] >> 6) * len(at) + owner[held], np.uint64(1) << (bit[held] & 63).astype(np.uint64))
        self.bits = bits
        rare = few[code]
        held = rare >= 0
        self.rare, self.rare_owner = rare[held], owner[held]
        self.rare_of = np.searchsorted(self.rare_owner, np.arange(len(at) + 1))
        order = np.argsort(self.rare, kind="stable")
        self.posted = self.rare_owner[order]
        self.posting = np.searchsorted(self.rare[order], np.arange((few.max(initial=-1)) + 2))


def _overlap(a: _Block, rows: slice, b: _Block, since: int) -> np.ndarray:
    """Number of items shared by some rows of ``a`` and each of ``b`` from place ``since`` on."""
    n, width = rows.stop - rows.start, len(b.at) - since
    out = np.zeros((n, width), np.int32)
    both, ones = np.empty((n, width), np.uint64), np.empty((n, width), np.uint8)
    for at in range(0, len(a.bits), 3):
        # Three words have at most 192 bits.
        some = np.zeros((n, width), np.uint8)
        for x, y in zip(a.bits[at : at + 3], b.bits[at : at + 3]):
            some += np.bitwise_count(np.bitwise_and(x[rows, None], y[None, since:], out=both), out=ones)
        out += some
    entries = slice(a.rare_of[rows.start], a.rare_of[rows.stop])
    item, left = a.rare[entries], a.rare_owner[entries] - rows.start
    first, count = b.posting[item], b.posting[item + 1] - b.posting[item]
    ends, at, flat = np.cumsum(count), 0, out.reshape(-1)
    while at < len(item):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CROSS, side="right")))
        c = count[at:to]
        right = b.posted[np.arange(c.sum()) + np.repeat(first[at:to] - np.cumsum(c) + c, c)] - since
        cell = np.repeat(left[at:to] * width, c) + right
        np.add.at(flat, cell[right >= 0] if since else cell, np.int32(1))
        at = to
    return out


class _Piece:
    """Some rows of one block with rows of another: shared items, sums of set sizes, squared distances."""

    def __init__(self, a: _Block, rows: slice, b: _Block, cols: slice, shared: np.ndarray | None, mask: np.ndarray | None):
        self.a, self.b, self.shared, self.mask = a, b, shared, mask
        self.rows, self.cols = rows, cols
        self.sizes = a.sizes[rows, None] + b.sizes[None, cols]

    def far(self) -> np.ndarray:
        """Squared distances by matrix product, true to ``CLOSE`` / 1e3; those below ``CLOSE`` are computed directly."""
        u, v = self.a.vectors[self.rows], self.b.vectors[self.cols]
        p, q = self.a.norms[self.rows], self.b.norms[self.cols]
        # Written so that NaN takes the direct way too.
        if not (p.max() <= PLAIN_NORM and q.max() <= PLAIN_NORM):
            return _all_far(u, v)
        out = np.hstack([u * -2, p[:, None], np.ones((len(u), 1))]) @ np.hstack([v, np.ones((len(v), 1)), q[:, None]]).T
        row, col = np.nonzero(out < CLOSE)
        out[row, col] = _far(u, v, row, col)
        return out


def _all_far(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    out = np.zeros((len(u), len(v)))
    for d in range(u.shape[1]):
        out += (u[:, d, None] - v[None, :, d]) ** 2
    return out


def _far(u: np.ndarray, v: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Squared distances of some pairs, summed in the order of the features."""
    if 8 * len(row) > len(u) * len(v):
        return _all_far(u, v)[row, col]
    out = np.zeros(len(row))
    for d in range(u.shape[1]):
        out += (u[row, d] - v[col, d]) ** 2
    return out


def _alike(far: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.sqrt(far))


def _within(alike: float) -> float:
    """Square of the distance at which vectors are so much alike."""
    return (1 / alike - 1) ** 2 if alike > 0 else np.inf


def _pieces(table: pa.Table, texts: bool = True) -> Iterator[_Piece]:
    """All pairs of rows of two blocks, in pieces that stay in the cache; ``texts``: with their shared items."""
    n = len(table)
    sizes, codes = np.zeros(n, np.int64), np.zeros(0, np.int64)
    word = few = np.full(1, -1)
    words = 0
    if texts:
        lists = table["s"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        _, codes, counts = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True, return_counts=True)
        many = np.flatnonzero(counts > max(1, n * MANY))
        many = many[np.argsort(-counts[many], kind="stable")[:BITS]]
        word, few = np.full(len(counts) + 1, -1), np.full(len(counts) + 1, -1)
        word[many], words = np.arange(len(many)), -(-len(many) // 64)
        rest = np.flatnonzero((counts > 1) & (word[:-1] < 0))
        few[rest] = np.arange(len(rest))
    starts = np.cumsum(sizes) - sizes
    vectors = None
    if table["v"].null_count < n:
        v = table["v"].combine_chunks()
        v = v.chunk(0) if isinstance(v, pa.ChunkedArray) else v
        if len(v.value_lengths().unique()) != 1:
            raise ValueError("structural vectors differ in length")
        vectors = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    block = table["block"].to_numpy()
    lo, hi = table["lo"][0].as_py(), table["hi"][0].as_py()
    side = lambda k: _Block(np.flatnonzero(block == k), sizes, starts, codes, word, few, words, vectors)
    a = side(lo)
    b = a if lo == hi else side(hi)
    if not len(a.at) or not len(b.at):
        return
    at, step = 0, max(1, CELLS // len(b.at))
    while at < len(a.at):
        rows = slice(at, min(len(a.at), at + step))
        since = at if a is b else 0
        shared = _overlap(a, rows, b, since) if texts else None
        if a is b:
            own = rows.stop - rows.start
            yield _Piece(a, rows, a, rows, np.ascontiguousarray(shared[:, :own]) if texts else None, np.triu(np.ones((own, own), dtype=bool), 1))
            if rows.stop < len(a.at):
                yield _Piece(a, rows, a, slice(rows.stop, len(a.at)), np.ascontiguousarray(shared[:, own:]) if texts else None, None)
        else:
            yield _Piece(a, rows, b, slice(0, len(b.at)), shared, None)
        at = rows.stop


def _chosen(values: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
    return values.ravel() if mask is None else values[mask]


class _Values(dict):
    """Numbers of pairs by exact value."""

    def add(self, values: np.ndarray, counts: np.ndarray) -> None:
        for x, c in zip(values.tolist(), counts.tolist()):
            self[x] = self.get(x, 0) + c


class _Jaccards:
    """Numbers of pairs by shared items and sum of sizes, which give the exact value."""

    def __init__(self):
        self.held, self.other, self.most = np.zeros(0, np.int64), _Values(), 0

    def add(self, shared: np.ndarray, sums: np.ndarray, most: int) -> None:
        self.most = most
        high = np.flatnonzero(shared >= SHARED) if most * SHARED <= CROSS else np.flatnonzero(shared)
        if len(high):
            k = shared[high]
            self.other.add(*np.unique(k / (sums[high] - k), return_counts=True))
        if most * SHARED > CROSS:
            # Pairs without shared items stand at the sum 1, so that no cell is left without a union.
            n = np.array([0, len(shared) - len(high)])
        else:
            n = np.bincount(np.minimum(shared, SHARED) * np.int64(most) + sums)[: SHARED * most]
        if len(n) > len(self.held):
            n[: len(self.held)] += self.held
            self.held = n
        else:
            self.held[: len(n)] += n

    def values(self) -> _Values:
        cell = np.flatnonzero(self.held)
        k, total = cell // max(self.most, 1), cell % max(self.most, 1)
        x, at = np.unique(k / (total - k), return_inverse=True)
        self.other.add(x, np.bincount(at, weights=self.held[cell]).astype(np.int64))
        return self.other


def baseline(sets: DataFrame) -> DataFrame:
    """(g, measure, pairs, median, spread) over all pairs of a group, for groups of at least three pairs.

    Jaccards are counted by value in one pass. Distances take two: a histogram finds the bins of the median, the second
    pass counts the values in them and how many lie above.
    """

    def histogram(table: pa.Table) -> pa.Table:
        texts, total, sums = _Jaccards(), np.zeros(BINS + 1, np.int64), np.zeros(2)
        most = 0
        for piece in _pieces(table):
            most = most or 2 * int(max(piece.a.sizes.max(), piece.b.sizes.max())) + 1
            texts.add(_chosen(piece.shared, piece.mask), _chosen(piece.sizes, piece.mask), most)
            if piece.a.vectors is not None:
                v = _chosen(_alike(piece.far()), piece.mask)
                total += np.bincount((v * BINS).astype(np.intp), minlength=BINS + 1)
                sums += v.sum(), np.dot(v, v)
        have = texts.values()
        x, n = np.array(list(have.keys()), np.float64), np.array(list(have.values()), np.int64)
        g, at = table["g"][0], np.flatnonzero(total)
        part = lambda m, x, n, s, q: pa.table({"g": pa.repeat(g, len(x)), "measure": pa.repeat(pa.scalar(m), len(x)), "x": pa.array(x, pa.float64()), "n": pa.array(n, pa.int64()), "s": pa.array(s, pa.float64()), "q": pa.array(q, pa.float64())})
        parts = [part(MEASURES[0], x, n, x * n, x * x * n)]
        if len(at):
            # The sums of the whole stand at its first bin.
            first = np.zeros((2, len(at)))
            first[:, 0] = sums
            parts.append(part(MEASURES[1], at / BINS, total[at], *first))
        return pa.concat_tables(parts)

    kind = sets.schema["g"].dataType.simpleString()
    seen = materialize(_meetings(sets).applyInArrow(histogram, f"g {kind}, measure string, x double, n bigint, s double, q double"), "histogram")
    seen = seen.groupBy("g", "measure", "x").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")])
    part = Window.partitionBy("g", "measure")
    run = seen.select("*", F.sum("n").over(part.orderBy("x")).alias("upto"), *[F.sum(c).over(part).alias(f"all_{c}") for c in ("n", "s", "q")]).where("all_n >= 3")
    low, high = F.floor((F.col("all_n") + 1) / 2), F.floor(F.col("all_n") / 2) + 1
    at = lambda p: F.min(F.when(F.col("upto") >= p, F.col("x")))
    found = materialize(run.groupBy("g", "measure", "all_n", "all_s", "all_q").agg(at(low).alias("a"), at(high).alias("b")), "bins")
    squares = F.greatest(F.col("all_q") - F.col("all_s") * F.col("all_s") / F.col("all_n"), F.lit(0.0))
    stats = lambda rows: rows.select("g", "measure", F.col("all_n").alias("pairs"), ((F.col("a") + F.col("b")) / 2).alias("median"), F.sqrt(squares / (F.col("all_n") - 1)).alias("spread"))
    text, bins = found.where(F.col("measure") == MEASURES[0]), found.where(F.col("measure") == MEASURES[1])
    if bins.isEmpty():
        return stats(text)

    def inside(table: pa.Table) -> pa.Table:
        """Values in the bins of the two middle pairs; as -1, the number of pairs less alike than those of both bins."""
        have = _Values()
        spans = [(c - MARGIN, c + 1 / BINS + MARGIN) for c in (table["a"][0].as_py(), table["b"][0].as_py())]
        spans = [(spans[0][0], spans[1][1])] if spans[1][0] <= spans[0][1] else spans
        for piece in _pieces(table, texts=False):
            far = piece.far()
            if piece.mask is not None:
                far[~piece.mask] = -1
            have[-1.0] = have.get(-1.0, 0) + int(np.count_nonzero(far > _within(spans[0][0])))
            for lo, hi in spans:
                row, col = np.nonzero((far <= _within(lo)) & (far >= (_within(hi) if hi < 1 else 0)))
                have.add(*np.unique(_alike(_far(piece.a.vectors[piece.rows], piece.b.vectors[piece.cols], row, col)), return_counts=True))
        return pa.table({"g": pa.repeat(table["g"][0], len(have)), "x": pa.array(have.keys(), pa.float64()), "n": pa.array(have.values(), pa.int64())})

    # Between two bins lies no pair: each is the first that holds its place.
    wide = bins.select(F.col("g").alias("h"), "a", "b")
    near = _meetings(sets.select("k", "g", "v", "block", "blocks").join(wide, sets["g"].eqNullSafe(wide["h"])).drop("h")).applyInArrow(inside, f"g {kind}, x double, n bigint")
    near = materialize(near, "inside").groupBy("g", "x").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(Window.partitionBy("g").orderBy("x")))
    f = bins.select(F.col("g").alias("h"), "measure", "all_n", "all_s", "all_q")
    both = near.join(f, near["g"].eqNullSafe(f["h"])).where("x >= 0").groupBy("g", "measure", "all_n", "all_s", "all_q").agg(at(low).alias("a"), at(high).alias("b"))
    return stats(text).unionByName(stats(both))


def _flagged(table: pa.Table, exact: bool) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]]:
    """(places of a, places of b, values, [text, text_adaptive, structural, structural_adaptive]) of pairs that any flag marks.

    Flags are exact; similarities of vectors may be off by their last digits where ``exact`` is not asked.
    """
    names = pc.dictionary_encode(table["author"].combine_chunks())
    names = names.chunk(0) if isinstance(names, pa.ChunkedArray) else names
    who, blank = names.indices.to_numpy(), np.array([x == "" for x in names.dictionary.to_pylist()])
    limits = []
    for m, absolute, margin in zip(MEASURES, (TEXT, STRUCTURAL), (TEXT_MARGIN, STRUCTURAL_MARGIN)):
        median, spread = table[f"{m}_median"][0].as_py(), table[f"{m}_spread"][0].as_py()
        limits.append((absolute, absolute if median is None else median + 2 * max(spread, LEAST_SPREAD), (median or 0.0) + margin))
    # No pair below these has a flag.
    least_text, least_structural = (min(absolute, adaptive) for absolute, adaptive, _ in limits)
    lifted = np.float32((1 + least_text - MARGIN) / (least_text - MARGIN) * (1 + 1e-6))
    for piece in _pieces(table):
        some = piece.shared * lifted >= piece.sizes
        if piece.a.vectors is not None:
            far = piece.far()
            some |= far <= _within(least_structural - MARGIN)
        if piece.mask is not None:
            some &= piece.mask
        cell = np.flatnonzero(some)
        row, col = np.divmod(cell, some.shape[1])
        a, b = piece.a.at[piece.rows][row], piece.b.at[piece.cols][col]
        other = (who[a] != who[b]) | blank[who[a]]
        k = piece.shared.ravel()[cell]
        values = [k / (piece.sizes.ravel()[cell] - k)]
        if piece.a.vectors is not None:
            v = _alike(far.ravel()[cell])
            near = np.arange(len(v)) if exact else np.flatnonzero(np.logical_or.reduce([np.abs(v - x) < MARGIN for x in limits[1]]))
            v[near] = _alike(_far(piece.a.vectors[piece.rows], piece.b.vectors[piece.cols], row[near], col[near]))
            values.append(v)
        flags = []
        for v, (absolute, adaptive, above) in zip(values, limits):
            plain = v >= absolute
            flags += [plain, (v >= adaptive) & (v > above) & ~plain]
        on = other & np.logical_or.reduce(flags)
        yield a[on], b[on], [v[on] for v in values], [f[on] for f in flags]


def _limited(sets: DataFrame, stats: DataFrame):
    columns = [F.max(F.when(F.col("measure") == m, F.col(c))).alias(f"{m}_{c}") for m in MEASURES for c in ("median", "spread")]
    wide = stats.groupBy("g").agg(*columns).withColumnRenamed("g", "h")
    return _meetings(sets.join(wide, sets["g"].eqNullSafe(wide["h"]), "left").drop("h"))


FLAGS = ("text", "text_adaptive", "structural", "structural_adaptive")


def flagged_pairs(sets: DataFrame, stats: DataFrame) -> DataFrame:
    """(k_a < k_b, jaccard, structural, flags) of the flagged pairs of different authors."""

    def run(table: pa.Table) -> pa.Table:
        key = table["k"].to_numpy()
        parts = []
        for a, b, values, flags in _flagged(table, True):
            names = [[f for f, on in zip(FLAGS, marks) if on] for marks in zip(*flags)]
            far = values[1] if len(values) > 1 else np.zeros(len(a))
            parts.append(pa.table({"k_a": np.minimum(key[a], key[b]), "k_b": np.maximum(key[a], key[b]), "jaccard": values[0], "structural": far, "flags": pa.array(names, pa.list_(pa.string()))}))
        return pa.concat_tables(parts)

    return _limited(sets, stats).applyInArrow(run, "k_a bigint, k_b bigint, jaccard double, structural double, flags array<string>")


def flag_counts(sets: DataFrame, stats: DataFrame) -> DataFrame:
    """(k, partners, adaptive) of each row in a flagged pair, without listing the pairs: each is met in one task only."""

    def run(table: pa.Table) -> pa.Table:
        partners, adaptive = np.zeros(len(table), np.int64), np.zeros(len(table), np.int64)
        for a, b, _, flags in _flagged(table, False):
            own = np.logical_or.reduce(flags[1::2])
            for side in (a, b):
                partners += np.bincount(side, minlength=len(table))
                adaptive += np.bincount(side[own], minlength=len(table))
        at = np.flatnonzero(partners)
        return pa.table({"k": table["k"].to_numpy()[at], "partners": partners[at], "adaptive": adaptive[at]})

    found = _limited(sets, stats).applyInArrow(run, "k bigint, partners bigint, adaptive bigint")
    return found.groupBy("k").agg(F.sum("partners").alias("partners"), F.lit(0).alias("semantic"), (F.sum("adaptive") > 0).cast("int").alias("adaptive"))
