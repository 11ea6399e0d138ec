"""The array side of the prefix join of problem 3: chunks of rows whose words, shingles and postings travel packed.

A shingle as a 64-bit value of a row of its own does not compress, and a join moves it several times. Here only the
hashed words of a chunk of rows are kept, once, and shingles are made from them where they are needed. What is shuffled
are sorted 40-bit keys as differences, in planes of one byte, of which the upper ones are almost all zero. Keys order
shingles and find candidates only, so two shingles of one key cost work but change no result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from inkstone.llm import shingling

#: Rows of a chunk, and words at which it is closed before that.
ROWS, WORDS = 8_192, 2_000_000
KEY_BITS, KEY_BYTES = 40, 5
#: Pairs of postings looked at together.
CROSS = 2_000_000

CHUNKED = "chunk bigint, ids binary, s1 binary, s2 binary, seeds binary, sizes binary, vocabulary binary, codes binary"
SIGNED = "id bigint, s1 bigint, s2 bigint, chunk bigint"
MESSAGE = "bucket int, chunk bigint, a binary, b binary"
POSTED = "bucket int, keys binary, gids binary, sizes binary, places binary, bits binary"
MET = "kind int, x bigint, y bigint, n int, bits array<bigint>"
#: 64-bit words of a bitmap of a set.
BITMAP = 8


def planes(values: np.ndarray, width: int) -> bytes:
    """The lower ``width`` bytes of 64-bit values, first bytes first."""
    return np.ascontiguousarray(values).astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unplaned(data: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, :width] = raw.T
    return out.view("<u8").ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences."""
    return planes(np.diff(keys, prepend=np.uint64(0)), KEY_BYTES)


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unplaned(data, KEY_BYTES), dtype=np.uint64)


def key_of(shingles: np.ndarray) -> np.ndarray:
    return shingles.view(np.uint64) >> np.uint64(64 - KEY_BITS)


def bitmaps(owner: np.ndarray, shingles: np.ndarray, rows: int) -> np.ndarray:
    """Each row's set as a bitmap of ``BITMAP`` words, one row after another."""
    out = np.zeros((rows, BITMAP * 64), np.uint8)
    out[owner, shingles.view(np.uint64) & np.uint64(BITMAP * 64 - 1)] = 1
    return np.packbits(out, axis=1, bitorder="little").view("<u8").ravel()


def bucket_cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each of ``buckets`` equal ranges starts among sorted keys, and the end."""
    return np.searchsorted(keys * np.uint64(buckets) >> np.uint64(KEY_BITS), np.arange(buckets + 1, dtype=np.uint64))


def chunked_batches(width: int):
    """For mapInArrow: (id, seed, words or text) to chunks of the rows that have shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shingling.WordHashes()
        held: list[tuple[np.ndarray, ...]] = []
        for batch in shingling.pieces(batches):
            words, hashes = shingling.word_hashes(batch.column(2), known)
            seeds = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            sizes, sets = shingling.distinct(*shingling.runs(words, hashes, width, seeds if seeds.any() else None), batch.num_rows)
            s1, s2 = shingling.signatures(sizes, sets)
            kept = sizes > 0
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            held.append((ids[kept], s1[kept], s2[kept], seeds[kept], words[kept], hashes[np.repeat(kept, words)]))
            if sum(len(h[0]) for h in held) >= ROWS or sum(len(h[5]) for h in held) >= WORDS:
                yield _chunk(held)
                held = []
        if any(len(h[0]) for h in held):
            yield _chunk(held)

    return run


def _chunk(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    ids, s1, s2, seeds, words, hashes = (np.concatenate(x) for x in zip(*held))
    vocabulary, codes = np.unique(hashes, return_inverse=True)
    packed = [ids.tobytes(), s1.tobytes(), s2.tobytes(), seeds.tobytes(), planes(words, 4), vocabulary.tobytes(), planes(codes, 3)]
    return pa.record_batch([pa.array([uuid.uuid4().int >> 65], pa.int64()), *[pa.array([x], pa.binary()) for x in packed]], names=["chunk", "ids", "s1", "s2", "seeds", "sizes", "vocabulary", "codes"])


def signed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, ids, s1, s2) of chunks to one row each."""
    for batch in batches:
        for c in batch.to_pylist():
            ids, s1, s2 = (np.frombuffer(c[x], np.int64) for x in ("ids", "s1", "s2"))
            yield pa.record_batch([pa.array(ids), pa.array(s1), pa.array(s2), pa.array(np.full(len(ids), c["chunk"]))], names=["id", "s1", "s2", "chunk"])


def _shingles(c: dict, width: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, shingles): the sets of some rows of a chunk."""
    words = unplaned(c["sizes"], 4).astype(np.int64)
    seeds = np.frombuffer(c["seeds"], np.uint64)
    wanted = np.zeros(len(words), bool)
    wanted[rows] = True
    codes = unplaned(c["codes"], 3)[np.repeat(wanted, words)].astype(np.int64)
    out_sizes, out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    hashes, words, seeds = np.frombuffer(c["vocabulary"], np.uint64)[codes], words[wanted], seeds[wanted]
    ends = shingling.starts(words)
    for at in range(0, len(words), shingling.PIECE):
        part = slice(at, min(at + shingling.PIECE, len(words)))
        own = hashes[ends[part.start] : ends[part.stop]]
        sizes, sets = shingling.distinct(*shingling.runs(words[part], own, width, seeds[part] if seeds.any() else None), part.stop - part.start)
        out_sizes.append(sizes)
        out.append(sets)
    return np.concatenate(out_sizes), np.concatenate(out)


def _firsts(c: dict) -> np.ndarray:
    """One row of each signature, in order."""
    return np.sort(np.unique(np.frombuffer(c["s1"], np.int64).view(np.uint64) ^ shingling.mixed(np.frombuffer(c["s2"], np.int64).view(np.uint64)), return_index=True)[1])


def asking(width: int, buckets: int):
    """For mapInArrow: chunks to messages of their distinct keys (a) and in how many sets each is (b), by ranges of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in batch.to_pylist():
                keys, counts = np.unique(key_of(_shingles(c, width, _firsts(c))[1]), return_counts=True)
                counts = np.minimum(counts, 0xFFFFFF)
                cuts = bucket_cuts(keys, buckets)
                used = np.flatnonzero(np.diff(cuts))
                parts = [(keys[cuts[k] : cuts[k + 1]], counts[cuts[k] : cuts[k + 1]]) for k in used]
                yield pa.record_batch(
                    [pa.array(used.astype(np.int32)), pa.array(np.full(len(used), c["chunk"])), pa.array([packed_keys(k) for k, _ in parts], pa.binary()), pa.array([planes(n, 3) for _, n in parts], pa.binary())],
                    names=["bucket", "chunk", "a", "b"],
                )

    return run


def replying(table: pa.Table) -> pa.Table:
    """Messages of one range of keys to one byte a key (a): 0 where only one set has it, else eighths of the binary logarithm of the number."""
    keys = [unpacked_keys(x) for x in table["a"].to_pylist()]
    _, at = np.unique(np.concatenate(keys), return_inverse=True)
    df = np.bincount(at, weights=np.concatenate([unplaned(x, 3) for x in table["b"].to_pylist()]))
    level = np.where(df < 2, 0, np.minimum(255, np.round(8 * np.log2(df)))).astype(np.uint8)[at]
    cuts = np.cumsum([0, *map(len, keys)])
    return pa.table({"bucket": table["bucket"], "chunk": table["chunk"], "a": pa.array([level[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary()), "b": pa.array([b""] * len(keys), pa.binary())})


def heads_of_chunk(table: pa.Table) -> pa.Table:
    """(chunk, id, s1, s2) of the rows that name a class, as the message -1 to their chunk."""
    return pa.table({"bucket": pa.array([-1], pa.int32()), "chunk": table["chunk"].slice(0, 1), "a": pa.array([table["id"].to_numpy().tobytes()], pa.binary()), "b": pa.array([table["s1"].to_numpy().tobytes() + table["s2"].to_numpy().tobytes()], pa.binary())})


def _named(c: dict, heads: dict) -> np.ndarray:
    """Rows of a chunk that a message of heads names, each once."""
    ids, marks = np.frombuffer(heads["a"], np.int64), np.frombuffer(heads["b"], np.int64)
    want = dict(zip(ids.tolist(), zip(marks[: len(ids)].tolist(), marks[len(ids) :].tolist())))
    out = []
    for i, (key, *marks) in enumerate(zip(*[np.frombuffer(c[x], np.int64).tolist() for x in ("ids", "s1", "s2")])):
        if want.get(key) == tuple(marks):
            out.append(i)
            del want[key]
    return np.array(out, np.int64)


def posting(width: int, threshold: float, buckets: int):
    """For cogroups of a chunk and its messages: postings of the prefixes of its groups by ranges of keys, and (gid, cid, n, bitmap) rows without keys.

    Rarest shingles come first; the prefix is n - ceil(t n) + 1 of them, the unshared ones are counted only. Classes of
    equal size and prefix are one group, posted once a chunk.
    """

    def run(chunk: pa.Table, messages: pa.Table) -> pa.Table:
        empty = {"bucket": pa.array([], pa.int32())} | {x: pa.array([], pa.binary()) for x in ("keys", "gids", "sizes", "places", "bits")}
        told = {m["bucket"]: m for m in messages.to_pylist()}
        if not len(chunk) or -1 not in told:
            return pa.table(empty)
        c = chunk.to_pylist()[0]
        keys = np.unique(key_of(_shingles(c, width, _firsts(c))[1]))
        levels = np.concatenate([np.frombuffer(told[b]["a"], np.uint8) for b in sorted(told) if b >= 0])
        rows = _named(c, told[-1])
        n, sets = _shingles(c, width, rows)
        h, owner = sets.view(np.uint64), np.repeat(np.arange(len(n)), n)
        level = levels[np.searchsorted(keys, key_of(sets))]
        order = np.lexsort((h, level, owner))
        h, level = h[order], level[order]
        place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
        reach = n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1
        kept = (level > 0) & (place < reach[owner])
        h, owner, place = h[kept], owner[kept], place[kept]
        length = np.bincount(owner, minlength=len(n))
        gid = shingling.mixed(shingling.per_row(shingling.mixed(h ^ np.uint64(0x9E3779B97F4A7C15)), length, np.add) + (n * (1 << 20) + length).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        bits = bitmaps(np.repeat(np.arange(len(n)), n), sets, len(n)).reshape(-1, BITMAP)
        ids = np.frombuffer(c["ids"], np.int64)[rows]
        some = np.flatnonzero(length)
        first = np.zeros(len(n), bool)
        first[some[np.unique(gid[some], return_index=True)[1]]] = True
        posts = first[owner]
        key, owner, place = key_of(h[posts]), owner[posts], place[posts]
        order = np.argsort(key, kind="stable")
        key, owner, place = key[order], owner[order], place[order]
        cuts = bucket_cuts(key, buckets)
        out = [(int(c["chunk"] % buckets), None, planes(gid[some], 8), planes(n[some], 4), planes(ids[some], 8), bits[some].tobytes())]
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            part = slice(cuts[b], cuts[b + 1])
            out.append((b, packed_keys(key[part]), planes(gid[owner[part]], 8), planes(n[owner[part]], 4), planes(place[part], 4), None))
        return pa.table({k: pa.array(v, t.type) for (k, t), v in zip(empty.items(), zip(*out))})

    return run


def meeting(threshold: float):
    """For groups of postings of one range of keys: (1, gid_a < gid_b) of pairs in reach of the threshold, (0, gid, cid, n, bitmap) rows as they come."""

    def run(table: pa.Table) -> pa.Table:
        kinds, xs, ys = [np.zeros(0, np.int32)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        parts, sizes, bits = [], [np.zeros(0, np.uint64)], [b""]
        for row in table.to_pylist():
            if row["keys"] is None:
                xs.append(unplaned(row["gids"], 8))
                ys.append(unplaned(row["places"], 8))
                sizes.append(unplaned(row["sizes"], 4))
                bits.append(row["bits"])
                kinds.append(np.zeros(len(xs[-1]), np.int32))
            else:
                parts.append((unpacked_keys(row["keys"]), unplaned(row["gids"], 8), unplaned(row["sizes"], 4).astype(np.int64), unplaned(row["places"], 4).astype(np.int64)))
        if parts:
            key, gid, n, at = (np.concatenate(x) for x in zip(*parts))
            # A key that only one group posts meets nothing.
            order = np.lexsort((gid, n, key))
            key, gid, n, at = key[order], gid[order], n[order], at[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (gid[1:] != gid[:-1])
            key, gid, n, at = key[new], gid[new], n[new], at[new]
            rank = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]).astype(np.int64)]))
            both = rank * (1 << 32) + n
            last = np.searchsorted(both, rank * (1 << 32) + np.minimum(np.floor(n / threshold + 1e-6).astype(np.int64), (1 << 32) - 1), side="right")
            count = last - np.arange(len(n)) - 1
            ends = np.cumsum(count)
            i = 0
            while i < len(n):
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + CROSS, side="right")))
                left = np.repeat(np.arange(i, j), count[i:j])
                right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(count[i:j]) - count[i:j], count[i:j])
                needed = np.ceil(threshold / (1 + threshold) * (n[left] + n[right]) - 1e-9)
                good = (np.minimum(n[left] - at[left], n[right] - at[right]) >= needed) & (threshold * n[right] <= n[left] + 1e-9) & (gid[left] != gid[right])
                a, b = gid[left[good]].view(np.int64), gid[right[good]].view(np.int64)
                pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
                xs.append(pair[:, 0].view(np.uint64))
                ys.append(pair[:, 1].view(np.uint64))
                kinds.append(np.ones(len(pair), np.int32))
                i = j
        x, y = np.concatenate(xs).view(np.int64), np.concatenate(ys).view(np.int64)
        n = np.concatenate(sizes).astype(np.int32)
        own = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * BITMAP, pa.int32()), pa.array(np.frombuffer(b"".join(bits), np.int64)))
        # Rows of kind 0 come first.
        there = pa.array(np.where(np.arange(len(x)) < len(n), np.arange(len(x)), -1), pa.int64(), mask=np.arange(len(x)) >= len(n))
        return pa.table({"kind": np.concatenate(kinds), "x": x, "y": y, "n": pa.array(n).take(there), "bits": own.take(there)})

    return run


def sets_of(width: int):
    """For cogroups of a chunk and the heads asked of it: (cid, n, sh)."""

    def run(chunk: pa.Table, messages: pa.Table) -> pa.Table:
        if not len(chunk) or not len(messages):
            return pa.table({"cid": pa.array([], pa.int64()), "n": pa.array([], pa.int32()), "sh": pa.array([], pa.list_(pa.int64()))})
        c = chunk.to_pylist()[0]
        rows = _named(c, messages.to_pylist()[0])
        sizes, sets = _shingles(c, width, rows)
        return pa.table({"cid": np.frombuffer(c["ids"], np.int64)[rows], "n": sizes.astype(np.int32), "sh": shingling.lists(sizes, sets)})

    return run
