"""Similarity of submissions within and across batches: set joins, MinHash, flags, feedback on verdicts.

Candidates come from shared rare shingles (exact for the threshold) or from shared signature positions
(exact for at least half the positions), never from comparing all rows of a group.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.functions import text
from inkstone.operators import signature_join
from inkstone.session import materialize

HASHES = 128
#: Rows hashed together.
PIECE = 1024


def jaccard_pairs(rows: DataFrame, key: str, group: str, items: str, threshold: float) -> DataFrame:
    """(key_a < key_b, group, jaccard) of rows of one group whose item sets reach the threshold."""
    t = F.lit(threshold)
    # Items are kept as 64-bit hashes seeded with their group, so neither strings nor groups are compared again.
    hashed = rows.where(F.col(group).isNotNull()).select(F.col(key).alias("k"), F.col(group).alias("g"), F.col(items).alias("x")).select("k", "g", F.array_distinct(F.transform("x", lambda x: F.xxhash64("g", x))).alias("s"))
    sets = materialize(hashed, "sets").where(F.size("s") > 0)
    tokens = sets.select("k", F.size("s").alias("n"), F.explode("s").alias("h"))
    shared = tokens.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ordered = tokens.join(shared, "h").groupBy("k", "n").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("o"))
    # Unshared items fill the front of the prefix, so only what is left of it must be indexed.
    reach = F.col("n") - F.ceil(t * F.col("n") - F.lit(1e-9)) + 1 - (F.col("n") - F.size("o"))
    front = ordered.withColumn("p", reach.cast("int")).where("p > 0").select("k", "n", (F.col("n") - F.size("o")).alias("skip"), F.posexplode(F.slice("o", 1, F.col("p"))).alias("at", "o"))
    posted = materialize(front.select("k", "n", (F.col("skip") + F.col("at")).alias("at"), "o.h"), "posted")
    a, b = (posted.select("h", *[F.col(c).alias(f"{c}{p}") for c in ("k", "n", "at")]) for p in "ab")
    # From the place of a shared item on, enough items must be left to reach the threshold.
    enough = F.least(F.col("na") - F.col("ata"), F.col("nb") - F.col("atb")) >= F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("na") + F.col("nb")) - F.lit(1e-9))
    met = a.join(b, "h").where("ka < kb").where(enough & (F.least("na", "nb") + F.lit(1e-9) >= t * F.greatest("na", "nb"))).select("ka", "kb").distinct()
    # Most candidates fall by bitmaps, so that whole sets are shuffled for the few that are left only.
    bits = materialize(sets.select("k", F.size("s").alias("n"), text.item_bits(F.col("s")).alias("bits")), "bits")
    for p in "ab":
        met = met.join(bits.select(*[F.col(c).alias(f"{c}{p}") for c in ("k", "n", "bits")]), f"k{p}")
    met = materialize(met.where(text.may_share(F.col("bitsa"), F.col("bitsb"), F.col("na"), F.col("nb"), threshold)).select("ka", "kb"), "met")
    left = sets.select(F.col("k").alias("ka"), "g", F.col("s").alias("sa"))
    right = sets.select(F.col("k").alias("kb"), F.col("s").alias("sb"))
    j = text.jaccard(F.col("sa"), F.col("sb"))
    out = met.join(left, "ka").join(right, "kb").select(F.col("ka").alias(f"{key}_a"), F.col("kb").alias(f"{key}_b"), F.col("g").alias(group), j.alias("jaccard"))
    return out.where(F.col("jaccard") + F.lit(1e-12) >= t)


def minhash(shingles: Column, hashes: int = HASHES) -> Column:
    """Least md5 prefix over the shingles for each of ``hashes`` salts; zeros for no shingles."""

    def of(s: Column) -> Column:
        salted = lambda i: F.transform(
            s, lambda x: F.conv(F.substring(F.md5(F.concat(F.unhex(F.lpad(F.hex(i.cast("bigint")), 8, "0")), F.encode(x, "UTF-8"))), 1, 8), 16, 10).cast("bigint")
        )
        return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.coalesce(F.array_min(salted(i)), F.lit(0).cast("bigint")))

    return text.bound(shingles, of)


#: Rotations, and constants of the 64 steps of md5; a message of one block has at most 55 bytes.
_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_SINES = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
_ONE_BLOCK = 55
#: Shingles hashed together: enough that few calls are made, few enough that their words stay in the processor's cache.
_LANES = 8192


def _first_words(blocks: np.ndarray) -> Iterator[np.ndarray]:
    """First four bytes of md5, as a big-endian number, of padded blocks (16 words, lane), for each salt as their first word."""
    fixed = lambda x: np.array(x & 0xFFFFFFFF, np.uint32)
    words = [(i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16) for i in range(61)]
    # What a step adds is the same for all salts but where it takes the first word; words beyond the text are zeros.
    empty = [not w.any() for w in blocks]
    added = [None if g == 0 else fixed(_SINES[i]) if empty[g] else blocks[g] + fixed(_SINES[i]) for i, g in enumerate(words)]
    turns = [(fixed(t), fixed(32 - t)) for t in _TURNS]
    start = [fixed(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d, f = (np.empty(blocks.shape[1], np.uint32) for _ in range(5))
    for k in range(HASHES):
        salt = int.from_bytes(struct.pack(">I", k), "little")
        for x, y in zip((a, b, c, d), start):
            x[:] = y
        # The last three steps do not touch the first word.
        for i in range(61):
            if i < 16:
                np.bitwise_xor(c, d, out=f)
                f &= b
                f ^= d
            elif i < 32:
                np.bitwise_xor(b, c, out=f)
                f &= d
                f ^= c
            elif i < 48:
                np.bitwise_xor(b, c, out=f)
                f ^= d
            else:
                np.invert(d, out=f)
                f |= b
                f ^= c
            f += a
            f += fixed(_SINES[i] + salt) if added[i] is None else added[i]
            left, right = turns[i]
            np.right_shift(f, right, out=a)
            f <<= left
            f |= a
            f += b
            a, b, c, d, f = d, f, b, c, a
        yield (b + start[0]).byteswap()


def _prefixes(shingles: list[bytes]) -> np.ndarray:
    """(shingle, salt): big-endian first four bytes of md5(salt + shingle), for salts 0 to ``HASHES`` - 1."""
    out = np.zeros((len(shingles), HASHES), np.uint32)
    sizes = np.fromiter(map(len, shingles), np.int64, len(shingles)) + 4
    for i in np.flatnonzero(sizes > _ONE_BLOCK).tolist():
        out[i] = [int.from_bytes(md5(struct.pack(">I", k) + shingles[i]).digest()[:4], "big") for k in range(HASHES)]
    short = np.flatnonzero(sizes <= _ONE_BLOCK)
    for at in range(0, len(short), _LANES):
        part = short[at : at + _LANES]
        padded = b"".join((b"\0\0\0\0" + shingles[i] + b"\x80").ljust(64, b"\0") for i in part.tolist())
        blocks = np.frombuffer(padded, "<u4").reshape(-1, 16).T.copy()
        blocks[14] = sizes[part] * 8
        for k, words in enumerate(_first_words(blocks)):
            out[part, k] = words
    return out


def _signed(lists: pa.Array) -> np.ndarray:
    """(row, salt): the signature of each row's items; zeros for no items."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    # One row of prefixes per distinct shingle.
    values = _prefixes([v.encode() for v in coded.dictionary.to_pylist()])
    out = np.zeros((len(lists), HASHES), dtype=np.uint32)
    full = sizes > 0
    if full.any():
        first = (np.cumsum(sizes) - sizes)[full]
        ends = np.append(first[1:], len(codes))
        for row, lo, hi in zip(np.flatnonzero(full).tolist(), first.tolist(), ends.tolist()):
            out[row] = values[codes[lo:hi]].min(0)
    return out


def minhashed(rows: DataFrame, key: str, items: str, keep: list[str] = ()) -> DataFrame:
    """(key, keep..., m): the same signature in array code; each distinct shingle of a batch is hashed once per salt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE):
                piece = batch.slice(at, PIECE)
                out = _signed(piece.column(piece.num_columns - 1)).astype(np.int64)
                offsets = pa.array(np.arange(piece.num_rows + 1) * HASHES, pa.int32())
                yield pa.record_batch([*piece.columns[:-1], pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))], names=[*piece.schema.names[:-1], "m"])

    given = rows.select(key, *keep, items)
    schema = ", ".join(f"`{c}` {t}" for c, t in given.dtypes[:-1])
    return given.mapInArrow(run, f"{schema}, m array<bigint>")


def agreement(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.size(a)


def cross_batch(current: DataFrame, history: DataFrame, key: str, author: str, signature: str, least: float = 0.5) -> DataFrame:
    """(current, historical, similarity): rows of other batches whose signatures agree in enough positions.

    Agreement of at least half of n positions implies a match among any n/2 + 1 of them, so a join on
    (position, value) over those misses nothing. Same keys, and same named authors, are left out.
    """
    positions = int(HASHES * (1 - least)) + 1

    def side(rows: DataFrame, p: str) -> tuple[DataFrame, DataFrame]:
        sig = rows.select(F.col(key).alias(f"{p}_key"), F.lower(F.trim(F.coalesce(author, F.lit("")))).alias(f"{p}_author"), F.col(signature).alias(f"{p}_sig"))
        sig = materialize(sig, f"signatures-{p}")
        return sig, sig.select(f"{p}_key", F.posexplode(F.slice(f"{p}_sig", 1, positions)).alias("i", "v"))

    (cur, ci), (old, oi) = side(current, "cur"), side(history, "old")
    met = ci.join(oi, ["i", "v"]).where("cur_key != old_key").select("cur_key", "old_key").distinct()
    both = met.join(cur, "cur_key").join(old, "old_key")
    other = (F.col("cur_author") == "") | (F.col("old_author") == "") | (F.col("cur_author") != F.col("old_author"))
    return both.where(other).withColumn("similarity", agreement(F.col("cur_sig"), F.col("old_sig"))).where(F.col("similarity") >= least).select("cur_key", "old_key", "similarity")


def _given(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).astype(np.uint32).reshape(len(lists), -1)


def _named(author: str) -> Column:
    return F.lower(F.trim(F.coalesce(author, F.lit("")))).alias("author")


def earlier_batches(rows: DataFrame, key: str, author: str, signature: str, batch: str, least: float = 0.5) -> DataFrame:
    """(cur_key, old_key, similarity): every row with every row of an earlier batch whose signature agrees in enough positions.

    Signatures are ``HASHES`` numbers of 32 bits; those of equal rows are one class. Same named authors are left out.
    """
    given = rows.where(F.col(batch).isNotNull() & F.col(signature).isNotNull())
    chunks = signature_join.chunked(given.select(F.col(key).alias("k"), _named(author), F.col(batch).alias("batch"), signature), _given, PIECE)
    return _earlier(chunks, signature_join.rows_of(chunks), least)


def earlier_batches_by_items(rows: DataFrame, key: str, author: str, items: str, batches: DataFrame, batch: str, least: float = 0.5) -> DataFrame:
    """The same of rows whose items are signed on the way; ``batches`` has the batch of each key."""
    chunks = signature_join.chunked(rows.select(F.col(key).alias("k"), _named(author), F.lit(None).cast("string").alias("batch"), items), _signed, PIECE)
    known = batches.where(F.col(batch).isNotNull()).select(F.col(key).alias("k"), F.col(batch).alias("batch"))
    return _earlier(chunks, signature_join.rows_of(chunks).drop("batch").join(known, "k"), least)


def _earlier(chunks: DataFrame, signed: DataFrame, least: float) -> DataFrame:
    """Of chunks and their rows (k, author, batch, digest): signatures are compared per class, rows come back only where their batches are in order."""
    signed = materialize(signed, "signed")
    classes = materialize(signed.groupBy("digest").agg(F.min("k").alias("cid"), F.min("batch").alias("first"), F.max("batch").alias("last")), "classes")
    members = materialize(signed.join(classes.select("digest", "cid"), "digest").select("cid", "k", "author", "batch"), "members")
    close = signature_join.agreeing(chunks, HASHES, least)
    # A class may be met in several chunks; its digest names it.
    for p in "ab":
        close = close.join(classes.select(F.col("digest").alias(f"digest_{p}"), *[F.col(c).alias(f"{c}_{p}") for c in ("cid", "first", "last")]), f"digest_{p}")
    close = close.where("cid_a != cid_b and (first_a < last_b or first_b < last_a)").select(F.least("cid_a", "cid_b").alias("cid_a"), F.greatest("cid_a", "cid_b").alias("cid_b"), "similarity")
    close = materialize(close.distinct(), "close")
    own = classes.where("first < last").select(F.col("cid").alias("c"), F.col("cid").alias("d"), F.lit(1.0).alias("similarity"))
    ways = [close.select(F.col(x).alias("c"), F.col(y).alias("d"), "similarity") for x, y in (("cid_a", "cid_b"), ("cid_b", "cid_a"))]
    side = lambda c, p: members.select(F.col("cid").alias(c), F.col("k").alias(f"{p}_key"), F.col("author").alias(f"{p}_author"), F.col("batch").alias(f"{p}_batch"))
    met = own.unionByName(ways[0]).unionByName(ways[1]).join(side("c", "cur"), "c").join(side("d", "old"), "d").where("old_batch < cur_batch")
    return met.where("cur_author = '' or old_author = '' or cur_author != old_author").select("cur_key", "old_key", "similarity")


def structural(a: Column, b: Column) -> Column:
    """1 / (1 + Euclidean distance) of two structural vectors."""
    return 1 / (1 + F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)))


def feedback(rows: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """Verdicts raised by similarity: pairs has key_a, key_b, kind ('semantic', 'text' or one that ends in 'adaptive')."""
    sides = pairs.select(F.explode(F.array(F.struct(F.col(f"{key}_a").alias("k"), F.col(f"{key}_b").alias("o"), "kind"), F.struct(F.col(f"{key}_b").alias("k"), F.col(f"{key}_a").alias("o"), "kind"))).alias("x")).select("x.*")
    seen = sides.groupBy("k").agg(
        F.countDistinct("o").alias("partners"), F.max((F.col("kind") == "semantic").cast("int")).alias("semantic"), F.max(F.col("kind").endswith("adaptive").cast("int")).alias("adaptive")
    )
    return raised(rows, seen, key)


def raised(rows: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Verdicts raised by (k, partners, semantic, adaptive) of each row that is in some pair."""
    d = F.col("determination")
    up = (
        F.when((F.col("semantic") == 1) & (F.col("partners") >= 2) & d.isin("GREEN", "REVIEW", "YELLOW"), "AMBER")
        .when((F.col("semantic") == 1) & d.isin("GREEN", "REVIEW"), "YELLOW")
        .when((F.col("semantic") == 1) & (d == "YELLOW"), "AMBER")
        .when((F.col("adaptive") == 1) & d.isin("GREEN", "REVIEW"), "YELLOW")
        .otherwise(d)
    )
    return rows.join(seen.withColumnRenamed("k", key), key, "left").select(key, "determination", up.alias("adjusted"), F.coalesce("partners", F.lit(0)).alias("partners"))
