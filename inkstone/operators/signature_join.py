"""Pairs of rows whose MinHash signatures agree in enough positions, with little on disk (used by cross_batch).

Signatures are computed once and kept in chunks of rows, a file each; equal ones of a chunk are one node. Agreement of
``least`` of n positions implies a match among any n - least + 1 of them, so each node posts so many, rarest first in one
order for all: values that many rows have are counted over all chunks, the others come before them. Postings travel
packed, with a sketch of two bits a position, by which nearly all pairs that meet fall before they are written. Whole
signatures are read again, from the files, only for the nodes that are left.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyarrow import fs, parquet
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.session import materialize

#: Rows of a chunk, and the bits of a node's number within it.
ROWS, ROW_BITS = 8192, 13
#: Values that one row in so many has, or more, are told apart by how many have them.
RARE = 4096
#: Postings of a bucket, and pairs looked at together.
POSTINGS, PAIRS = 4_000_000, 1 << 17
_MESSAGE = "bucket int, nodes binary, sketches binary, keys binary, owners binary"
_LOW = np.uint64(0x5555555555555555)


def _chunk(number: int, ids: pa.Array, authors: pa.Array, labels: pa.Array, signatures: np.ndarray) -> pa.RecordBatch:
    packed = np.ascontiguousarray(signatures).view(np.dtype((np.void, signatures.shape[1] * 4))).ravel()
    _, heads, codes = np.unique(packed, return_index=True, return_inverse=True)
    digests = [blake2b(packed[i].tobytes(), digest_size=16).digest() for i in heads.tolist()]
    of_rows = pa.array(digests, pa.binary()).take(pa.array(codes.ravel()))
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    return pa.record_batch(
        [pa.array([number], pa.int64()), one(ids), one(authors), one(labels), one(of_rows), one(pa.array(digests, pa.binary())), pa.array([signatures[heads].tobytes()], pa.binary())],
        names=["chunk", "ids", "authors", "labels", "digests", "nodes", "signatures"],
    )


def chunked(rows: DataFrame, signing: Callable[[pa.Array], np.ndarray], piece: int) -> DataFrame:
    """Chunks of rows (key, author, batch, items); ``signing`` gives the signatures of up to ``piece`` rows' items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 20
        held: list[tuple[pa.Array, pa.Array, pa.Array, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            *columns, signatures = zip(*held)
            held.clear()
            return _chunk(number, *map(pa.concat_arrays, columns), np.concatenate(signatures))

        for batch in batches:
            for at in range(0, batch.num_rows, piece):
                part = batch.slice(at, piece)
                if sum(len(x[0]) for x in held) + part.num_rows > ROWS:
                    yield flush()
                    number += 1
                held.append((*part.columns[:3], signing(part.column(3))))
        if held:
            yield flush()

    kinds = [t for _, t in rows.dtypes]
    schema = f"chunk bigint, ids array<{kinds[0]}>, authors array<{kinds[1]}>, labels array<{kinds[2]}>, digests array<binary>, nodes array<binary>, signatures binary"
    return materialize(rows.mapInArrow(run, schema), "signature-chunks", rows_per_file=1)


def rows_of(chunks: DataFrame) -> DataFrame:
    """(k, author, batch, digest) of every row."""
    named = {"ids": "k", "authors": "author", "labels": "batch", "digests": "digest"}
    return chunks.select(F.explode(F.arrays_zip(*named)).alias("r")).select(*[F.col(f"r.{c}").alias(n) for c, n in named.items()])


def _signatures(packed: pa.Scalar, hashes: int) -> np.ndarray:
    return np.frombuffer(packed.as_buffer(), np.uint32).reshape(-1, hashes)


def _keys(signatures: np.ndarray) -> np.ndarray:
    return signatures.astype(np.uint64) | np.arange(signatures.shape[1], dtype=np.uint64) << np.uint64(32)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _counting(hashes: int):
    """For mapInArrow over (signatures): (key, n) of the values that several nodes of a chunk have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for packed in (x for b in batches for x in b.column(0)):
            keys, n = np.unique(_keys(_signatures(packed, hashes)), return_counts=True)
            yield pa.record_batch([pa.array(keys[n > 1].view(np.int64)), pa.array(n[n > 1].astype(np.int64))], names=["key", "n"])

    return run


def _posting(hashes: int, posted: int, buckets: int, common: np.ndarray, counts: np.ndarray):
    """For mapInArrow over (chunk, signatures): a message to each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                signatures = _signatures(packed, hashes)
                keys = _keys(signatures)
                place = np.minimum(np.searchsorted(common, keys), max(len(common) - 1, 0))
                n = np.where(common[place] == keys, counts[place], 0) if len(common) else np.zeros(keys.shape, np.int64)
                # No two positions of a node are alike in this order.
                first = np.argpartition(n * hashes + np.arange(hashes), posted - 1, axis=1)[:, :posted]
                sent = _mixed(np.take_along_axis(keys, first, 1)).ravel()
                owner = np.repeat(np.arange(len(keys)), posted)
                bits = (signatures & 3).astype(np.uint8).reshape(len(keys), -1, 4)
                sketches = bits[:, :, 0] | bits[:, :, 1] << 2 | bits[:, :, 2] << 4 | bits[:, :, 3] << 6
                bucket, low = ((sent >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), sent.astype(np.uint32)
                order = np.lexsort((low, bucket))
                ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
                out = []
                for b in range(buckets):
                    own = order[ends[b] : ends[b + 1]]
                    if len(own):
                        there, owners = np.unique(owner[own], return_inverse=True)
                        # Steps between sorted keys, byte by byte: the high bytes are zeros, which the shuffle presses.
                        steps = np.diff(low[own], prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T
                        out.append((b, (there | chunk << ROW_BITS).tobytes(), sketches[there].tobytes(), steps.tobytes(), owners.astype(np.uint16).tobytes()))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), [pa.int32()] + [pa.binary()] * 4)], names=["bucket", "nodes", "sketches", "keys", "owners"])

    return run


def _may_agree(sketches: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Whether no more than ``most`` of the positions differ by their two bits."""
    x = sketches.take(a, 0)
    x ^= sketches.take(b, 0)
    x |= x >> np.uint64(1)
    x &= _LOW
    return np.bitwise_count(x).sum(1, dtype=np.int64) <= most


def _meeting(hashes: int, most: int):
    """For applyInArrow over the messages of a bucket: (a, b) of the nodes that share a key and may agree."""

    def run(table: pa.Table) -> pa.Table:
        nodes, sketches, keys, owners, base = [], [], [], [], 0
        for i in range(len(table)):
            of = lambda c, kind: np.frombuffer(table[c][i].as_buffer(), kind)  # noqa: E731, B023
            nodes.append(of("nodes", np.int64))
            sketches.append(of("sketches", np.uint64).reshape(len(nodes[-1]), -1))
            keys.append(np.cumsum(np.ascontiguousarray(of("keys", np.uint8).reshape(4, -1).T).view(np.uint32).ravel(), dtype=np.uint32))
            owners.append(of("owners", np.uint16).astype(np.int32) + np.int32(base))
            base += len(nodes[-1])
        nodes, sketches, keys, owners = (np.concatenate(x) for x in (nodes, sketches, keys, owners))
        order = np.argsort(keys, kind="stable")
        keys, owners = keys[order], owners[order]
        ends = np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys))
        later = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(keys)) - 1
        del keys, order
        sums = np.concatenate([[0], np.cumsum(later)])
        found, fresh, at = np.zeros(0, np.int64), [], 0
        while at < len(later):
            end = max(at + 1, int(np.searchsorted(sums, sums[at] + PAIRS, "right")) - 1)
            a = np.repeat(np.arange(at, end), later[at:end])
            b = a + 1 + np.arange(len(a)) - np.repeat(sums[at:end] - sums[at], later[at:end])
            a, b = owners[a], owners[b]
            good = np.flatnonzero(_may_agree(sketches, a, b, most))
            a, b = a[good].astype(np.int64), b[good].astype(np.int64)
            a, b = a[a != b], b[a != b]
            fresh.append(np.minimum(a, b) << 32 | np.maximum(a, b))
            at = end
            if sum(map(len, fresh)) > 8 * PAIRS or at >= len(later):
                found, fresh = np.unique(np.concatenate([found, *fresh])), []
        a, b = nodes[found >> 32], nodes[found & 0xFFFFFFFF]
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    return run


def _nibbles(signatures: np.ndarray) -> np.ndarray:
    """Four bits of each position, others than those of the sketches."""
    bits = (signatures >> np.uint32(2) & np.uint32(15)).astype(np.uint8)
    return bits[:, ::2] | bits[:, 1::2] << 4


def _reading(paths: dict[int, str], hashes: int, whole: bool):
    """For mapInArrow over (node), those of a chunk together: (node, digest, signature or its nibbles) read from the chunk's file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = np.sort(np.concatenate([np.zeros(0, np.int64), *[b.column(0).to_numpy() for b in batches]]))
        chunks, begin = np.unique(asked >> ROW_BITS, return_index=True)
        for chunk, own in zip(chunks.tolist(), np.split(asked, begin[1:])):
            system, at = fs.FileSystem.from_uri(paths[chunk])
            with system.open_input_file(at) as file:
                row = parquet.ParquetFile(file).read(columns=["nodes", "signatures"])
            place = own & (ROWS - 1)
            values = _signatures(row["signatures"][0], hashes)[place]
            packed = pa.array([x.tobytes() for x in (values if whole else _nibbles(values))], pa.binary())
            yield pa.record_batch([pa.array(own), row["nodes"][0].values.take(pa.array(place)), packed], names=["node", "digest", "signature"])

    return run


def _equal(hashes: int, least: float, whole: bool):
    """For mapInArrow over (a, b, signature_a, signature_b): the pairs that agree, or may by their nibbles, and the share of equal positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch[f"signature_{p}"].to_pylist()), np.uint32 if whole else np.uint8).reshape(batch.num_rows, -1) for p in "ab")
            same = (x == y).sum(1) if whole else ((x ^ y) & 15 == 0).sum(1) + ((x ^ y) >> 4 == 0).sum(1)
            good = pa.array(np.flatnonzero(same / hashes >= least))
            yield pa.record_batch([*(batch[c].take(good) for c in ("a", "b", "digest_a", "digest_b")), pa.array(same / hashes).take(good)], names=["a", "b", "digest_a", "digest_b", "similarity"])

    return run


def agreeing(chunks: DataFrame, hashes: int, least: float) -> DataFrame:
    """(digest_a, digest_b, similarity): digests of the nodes of chunks whose signatures agree in ``least`` of the positions or more."""
    spark = chunks.sparkSession
    # One row per chunk.
    found = chunks.select("chunk", F.size("nodes").alias("n"), F.col("_metadata.file_path").alias("path")).collect()
    paths = {r["chunk"]: re.sub("^file:/+", "file:///", r["path"]) for r in found}
    nodes = sum(r["n"] for r in found)
    posted = int(hashes * (1 - least)) + 1
    # At most RARE values a position.
    often = chunks.select("signatures").mapInArrow(_counting(hashes), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= max(2, nodes // RARE)).toArrow()
    common, counts = often["key"].to_numpy().view(np.uint64), often["n"].to_numpy()
    order = np.argsort(common)
    buckets = max(2 * spark.sparkContext.defaultParallelism, -(-nodes * posted // POSTINGS))
    messages = chunks.select("chunk", "signatures").mapInArrow(_posting(hashes, posted, buckets, common[order], counts[order]), _MESSAGE)
    met = messages.repartitionById(buckets, "bucket").groupBy("bucket").applyInArrow(_meeting(hashes, hashes - int(np.ceil(hashes * least))), "a bigint, b bigint")
    met = materialize(met.distinct(), "met")
    # Most pairs left fall by nibbles, so that whole signatures are shuffled for few.
    for whole in (False, True):
        wanted = met.select(F.explode(F.array("a", "b")).alias("node")).distinct().repartition(F.shiftright("node", ROW_BITS))
        read = materialize(wanted.mapInArrow(_reading(paths, hashes, whole), "node bigint, digest binary, signature binary"), "read")
        side = lambda p: read.select(F.col("node").alias(p), F.col("digest").alias(f"digest_{p}"), F.col("signature").alias(f"signature_{p}"))  # noqa: E731, B023
        both = met.select("a", "b").join(side("a"), "a").join(side("b"), "b")
        met = materialize(both.mapInArrow(_equal(hashes, least, whole), "a bigint, b bigint, digest_a binary, digest_b binary, similarity double"), "met")
    return met.select("digest_a", "digest_b", "similarity")
