"""Near-duplicate records by a grouped prefix join on word shingles (problem 3).

Records of one block with at least ``threshold`` Jaccard similarity of their distinct ``width``-word
shingles are found without comparing every record with every other:

1. records with equal shingle sets collapse into one class (exact copies never multiply work);
2. each class keeps, rarest shingle first, the prefix that any partner must share; shingles found in a
   single class cannot match and are only counted;
3. classes of equal size and prefix form one group, and groups are joined on prefix shingles under the
   size and position bounds;
4. surviving group pairs expand to class pairs, which are verified on their whole shingle sets.

Shingles are never rows of their own: hashed words are kept in chunks of rows, and what is shuffled is packed
(``packed_join``). Only classes that may reach the threshold by bitmaps of their sets have whole sets shuffled.

The result is exact. Rare-first order keeps boilerplate out of the prefixes, so a shingle found in a
third of all records is never a join key of more than the few classes whose prefix reaches it; the joins
leave the remaining skew to adaptive execution. Nothing is broadcast by hint, collected or capped.

Defined results: null texts and texts of fewer than ``width`` words are in no pair; a null block is a
block of its own; rows repeated under one id count once (the smaller shingle signature stands).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.functions.text import may_share
from inkstone.llm import packed_join
from inkstone.session import materialize


def shingles(words: Column, width: int, seed: Column | None = None) -> Column:
    """Sorted distinct 64-bit hashes of runs of ``width`` words; an empty array for fewer words."""
    head = [] if seed is None else [seed]

    def of(w: Column) -> Column:
        runs = F.transform(
            F.sequence(F.lit(1), F.size(w) - F.lit(width - 1)),
            lambda i: F.xxhash64(*head, *[F.get(w, i + k - 1) for k in range(width)]),
        )
        return F.when(F.size(w) >= width, F.array_sort(F.array_distinct(runs))).otherwise(F.array().cast("array<bigint>"))

    # Bound as a lambda variable, the words are extracted once, not once for every shingle.
    return F.get(F.transform(F.array(words), of), F.lit(0))


def at_least(shared: Column, size_a: Column, size_b: Column, threshold: float) -> Column:
    """Jaccard similarity from an overlap, compared without division."""
    return shared + F.lit(1e-9) >= F.lit(threshold) * (size_a + size_b - shared)


def shingle_classes(rows: DataFrame, id_col: str, words_col: str, block_col: str | None, width: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members: id, cid), (heads: chunk, id, s1, s2), chunks: classes are the distinct shingle sets within a block.

    ``words_col`` holds arrays of words, or texts, which are brought to their consistent form. Only hashed words
    are kept, in chunks of rows; a class's shingles are made again from those of its head.
    """
    seed = F.xxhash64(F.coalesce(F.col(block_col).cast("string"), F.lit("\0null"))) if block_col else F.lit(0).cast("bigint")
    given = rows.select(F.col(id_col).cast("bigint").alias("id"), seed.alias("seed"), F.col(words_col).alias("w"))
    chunks = materialize(given.where("id is not null and w is not null").mapInArrow(packed_join.chunked_batches(width), packed_join.CHUNKED), "chunks")
    signed = materialize(chunks.select("chunk", "ids", "s1", "s2").mapInArrow(packed_join.signed_rows, packed_join.SIGNED), "signed")
    members, heads = signed_members(signed.select("id", "s1", "s2"))
    return members, materialize(heads.join(signed, ["id", "s1", "s2"]).groupBy("id", "s1", "s2").agg(F.min("chunk").alias("chunk")), "heads"), chunks


def signature(shingle_set: Column) -> list[Column]:
    """A 128-bit signature of a sorted shingle set, in two columns."""
    return [F.xxhash64(shingle_set).alias("s1"), F.xxhash64(F.lit(7), shingle_set).alias("s2")]


def signed_members(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members: id, cid), (heads: id, s1, s2) of rows (id, s1, s2); a class is named by its smallest id."""
    one = signed.groupBy("id").agg(F.min(F.struct("s1", "s2")).alias("s")).select("id", "s.s1", "s.s2")
    cids = one.groupBy("s1", "s2").agg(F.min("id").alias("cid"))
    members = materialize(one.join(cids, ["s1", "s2"]).select("id", "cid"), "members")
    return members, cids.select(F.col("cid").alias("id"), "s1", "s2")


def class_pairs(heads: DataFrame, chunks: DataFrame, width: int, threshold: float) -> DataFrame:
    """(cid_a < cid_b, shared, n_a, n_b): all pairs of classes at or above the threshold."""
    ranges = max(12, -(-chunks.count() // 4))
    asks = chunks.select("chunk", "s1", "s2", "seeds", "sizes", "vocabulary", "codes").mapInArrow(packed_join.asking(width, ranges), packed_join.MESSAGE)
    replies = asks.groupBy("bucket").applyInArrow(packed_join.replying, packed_join.MESSAGE)
    to_heads = lambda h: h.groupBy("chunk").applyInArrow(packed_join.heads_of_chunk, packed_join.MESSAGE)
    told = replies.unionByName(to_heads(heads))
    posted = chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(packed_join.posting(width, threshold, ranges), packed_join.POSTED)
    met = materialize(posted.groupBy("bucket").applyInArrow(packed_join.meeting(threshold), packed_join.MET), "met")
    of = lambda p: met.where("kind = 0").select(F.col("x").alias(f"gid_{p}"), F.col("y").alias(p), F.col("n").alias(f"n_{p}"), F.col("bits").alias(f"bits_{p}"))
    across = met.where("kind = 1").select(F.col("x").alias("gid_a"), F.col("y").alias("gid_b")).distinct().join(of("a"), "gid_a").join(of("b"), "gid_b")
    # Groups of several classes meet themselves.
    within = of("a").join(of("b"), F.col("gid_a") == F.col("gid_b")).where("a < b")
    # Most candidates fall by bitmaps, so that whole sets are shuffled for the few that are left only.
    near = lambda pairs: pairs.where(may_share(F.col("bits_a"), F.col("bits_b"), F.col("n_a"), F.col("n_b"), threshold)).select("a", "b")
    candidates = near(across).unionByName(near(within)).select(F.least("a", "b").alias("cid_a"), F.greatest("a", "b").alias("cid_b"))
    candidates = materialize(candidates, "candidates")
    wanted = candidates.select(F.explode(F.array("cid_a", "cid_b")).alias("id")).distinct()
    sets = chunks.groupBy("chunk").cogroup(to_heads(heads.join(wanted, "id", "left_semi")).groupBy("chunk")).applyInArrow(packed_join.sets_of(width), "cid bigint, n int, sh array<bigint>")
    return verify(candidates, materialize(sets, "sets"), threshold)


def verify(candidates: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Candidate class pairs that reach the threshold on their whole shingle sets."""
    a = classes.select(F.col("cid").alias("cid_a"), F.col("n").alias("n_a"), F.col("sh").alias("sh_a"))
    b = classes.select(F.col("cid").alias("cid_b"), F.col("n").alias("n_b"), F.col("sh").alias("sh_b"))
    return (
        candidates.join(a, "cid_a")
        .join(b, "cid_b")
        .select("cid_a", "cid_b", "n_a", "n_b", F.size(F.array_intersect("sh_a", "sh_b")).alias("shared"))
        .where(at_least(F.col("shared"), F.col("n_a"), F.col("n_b"), threshold))
    )


def near_duplicate_pairs(
    rows: DataFrame, id_col: str, words_col: str, block_col: str | None = None, width: int = 3, threshold: float = 0.5
) -> DataFrame:
    """(id_a < id_b): all pairs of records at or above the threshold, copies included."""
    members, heads, chunks = shingle_classes(rows, id_col, words_col, block_col, width)
    pairs = class_pairs(heads, chunks, width, threshold)
    in_a = members.select(F.col("cid").alias("cid_a"), F.col("id").alias("a"))
    in_b = members.select(F.col("cid").alias("cid_b"), F.col("id").alias("b"))
    across = pairs.select("cid_a", "cid_b").join(in_a, "cid_a").join(in_b, "cid_b").select("a", "b")
    within = in_a.join(in_b, F.col("cid_a") == F.col("cid_b")).where("a < b").select("a", "b")
    return across.unionByName(within).select(F.least("a", "b").alias(f"{id_col}_a"), F.greatest("a", "b").alias(f"{id_col}_b"))


def near_duplicate_classes(
    rows: DataFrame, id_col: str, words_col: str, block_col: str | None = None, width: int = 5, threshold: float = 0.8
) -> DataFrame:
    """(id, class_id, copies, linked_classes): one row per record; copies are not expanded into pairs.

    Records without shingles have null class_id and zero counts.
    """
    members, heads, chunks = shingle_classes(rows, id_col, words_col, block_col, width)
    pairs = class_pairs(heads, chunks, width, threshold)
    ends = pairs.select(F.explode(F.array("cid_a", "cid_b")).alias("cid"))
    links = ends.groupBy("cid").agg(F.count(F.lit(1)).alias("linked_classes"))
    sizes = members.groupBy("cid").agg(F.count(F.lit(1)).alias("copies"))
    found = members.join(sizes.join(links, "cid", "left"), "cid").select(F.col("id").alias(id_col), F.col("cid").alias("class_id"), "copies", "linked_classes")
    return (
        rows.select(id_col)
        .distinct()
        .join(found, id_col, "left")
        .select(id_col, "class_id", F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce("linked_classes", F.lit(0)).alias("linked_classes"))
    )
