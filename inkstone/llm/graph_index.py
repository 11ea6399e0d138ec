"""Navigable small-world graphs over sketches, searched for many queries at once (used by problem 6).

One graph holds a bounded number of nodes and is built and searched inside one task with array
operations: every step of a search expands the best open nodes of all queries together. Searches enter the
graph at nodes that share two least hashes with the query, where there are hashes, and at pivots spread over
the graph; from there they follow the links, with hashes those of nodes not far below the threshold only.
"""

from __future__ import annotations

import io
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from inkstone.llm import shingling

FORWARD = 6
DEGREE = 14
BEAMS = (8, 12, 16, 24, 32, 64, 128, 256, 512, 1024)
BUILD_BEAM = 12
CALIBRATION = 512
RECALL = 0.99
#: What sample queries without hashes lie above the threshold.
NEAR = 0.12
QUERY_BLOCK = 512
#: Places of beams held at once: wider beams are searched for fewer queries at a time.
BEAM_CELLS = 512 * 1024
#: Queries compared with all nodes at once.
EXACT_BLOCK = 64
STEP = 4
#: Pairs of vectors, and of rows of hashes, gathered at once.
GATHERED, COMPARED = 1024, 32 * 1024
PIVOTS = 2
#: Hashes are paired within so many groups, so that nodes with one equal hash more than groups share a pair.
GROUPS = 3
#: Up to so many nodes of a pair are all looked at; where more have it, a few are.
WHOLE, SOME = 64, 4
#: Bits of a packed pair that name its node.
OWNER = np.uint64((1 << 24) - 1)
#: Nodes this much less alike than the threshold are not followed where hashes lead into the graph.
FAR = 0.23
#: Nodes this much less alike than the threshold are found as well where twice the hashes asked for are equal.
SLACK = 0.1


class Graph:
    """Unit vectors, their hashes and links, and a beam width tuned against exhaustive search."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, links: np.ndarray, pivots: np.ndarray, beam: int, hashes: np.ndarray):
        self.ids, self.vectors, self.links, self.pivots, self.beam, self.hashes = ids, vectors, links, pivots, beam, hashes
        # Pairs of hashes of the first nodes, sorted.
        self._pairs, self._paired = np.zeros(0, np.uint64), 0

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray, threshold: float, seed: int = 5, hashes: np.ndarray | None = None) -> Graph:
        """Insert the nodes in random order; each links to its nearest found nodes, and they back to it.

        A node's first links are never dropped: those of early nodes span the graph. Two more links, first
        child and next sibling, make a tree in which every node is the child of the nearest node before it,
        so that however many nodes lie close together, each can be reached from the others.
        """
        n = len(ids)
        rng = np.random.default_rng(seed)
        order = rng.permutation(n)
        hashes = np.zeros((n, 0), np.uint32) if hashes is None else hashes[order]
        ids, vectors = ids[order], np.ascontiguousarray(vectors[order], dtype=np.float32)
        links = np.full((n, DEGREE + 2), -1, dtype=np.int32)
        graph = cls(ids, vectors, links, np.arange(min(n, PIVOTS * int(n**0.5) + 16)), BEAMS[0], hashes)
        done = 0
        while done < n:
            size = min(n - done, max(256, min(done, 2048)))
            fresh = np.arange(done, done + size)
            inside = vectors[fresh] @ vectors[fresh].T
            # A node links only to earlier ones of its chunk, as if inserted one by one.
            inside[~np.tri(size, k=-1, dtype=bool)] = -2
            near = np.argpartition(-inside, min(FORWARD, size - 1), axis=1)[:, :FORWARD]
            sims, found = np.take_along_axis(inside, near, 1), fresh[near]
            if done:
                graph.pivots = np.arange(min(done, PIVOTS * int(done**0.5) + 16))
                old, old_sims = graph._beam_search(vectors[fresh], BUILD_BEAM, done, hashes[fresh], threshold - FAR)
                found, sims = np.hstack([old, found]), np.hstack([old_sims, sims])
            top = np.argsort(-sims, axis=1, kind="stable")[:, :FORWARD]
            found, sims = np.take_along_axis(found, top, 1), np.take_along_axis(sims, top, 1)
            found = np.where(sims > -2, found, -1)
            links[fresh, : found.shape[1]] = found
            for node, parent in zip(fresh.tolist(), found[:, 0].tolist()):
                if parent >= 0:
                    links[node, DEGREE + 1] = links[parent, DEGREE]
                    links[parent, DEGREE] = node
            graph._link_back(fresh, found, sims)
            done += size
        graph.pivots = np.arange(min(n, PIVOTS * int(n**0.5) + 16))
        graph._tune(threshold, rng)
        return graph

    def _link_back(self, fresh: np.ndarray, found: np.ndarray, sims: np.ndarray) -> None:
        """Offer every new link to its target; the most similar offers and old back links stay."""
        source = np.repeat(fresh, found.shape[1])
        target, sim = found.ravel(), sims.ravel()
        good = target >= 0
        source, target, sim = source[good], target[good], sim[good]
        touched = np.unique(target)
        back = self.links[touched, FORWARD:DEGREE]
        held_t = np.repeat(touched, back.shape[1])
        held_s = back.ravel()
        there = held_s >= 0
        held_t, held_s = held_t[there], held_s[there]
        held_sim = np.einsum("ij,ij->i", self.vectors[held_t], self.vectors[held_s]) if len(held_t) else np.zeros(0, np.float32)
        t, s, v = np.concatenate([target, held_t]), np.concatenate([source, held_s]), np.concatenate([sim, held_sim])
        order = np.lexsort((-v, t))
        t, s = t[order], s[order]
        heads = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        rank = np.arange(len(t)) - np.repeat(heads, np.diff(np.append(heads, len(t))))
        keep = rank < DEGREE - FORWARD
        self.links[touched, FORWARD:DEGREE] = -1
        self.links[t[keep], FORWARD + rank[keep]] = s[keep]

    def _entries(self, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node): for each pair of a query's hashes those of the first ``n`` nodes that have it too, or some of them."""
        if self._paired < n:
            fresh = _hash_pairs(self.hashes[self._paired : n], self._paired)
            self._pairs = np.insert(self._pairs, np.searchsorted(self._pairs, fresh), fresh) if self._paired else fresh
            self._paired = n
        asked = _hash_pairs(hashes)
        lo = np.searchsorted(self._pairs, asked & ~OWNER)
        size = np.searchsorted(self._pairs, asked | OWNER, "right") - lo
        there = np.flatnonzero(size)
        lo, size, row = lo[there], size[there], (asked[there] & OWNER).astype(np.int64)
        # Of a long run, nodes spread over it: the links lead to the others.
        taken = np.where(size > WHOLE, SOME, size)
        place = np.arange(taken.sum()) - np.repeat(np.cumsum(taken) - taken, taken)
        lo, size, row, taken = (np.repeat(x, taken) for x in (lo, size, row, taken))
        return row, (self._pairs[lo + place * size // taken] & OWNER).astype(np.int64)

    def _beam_search(self, queries: np.ndarray, beam: int, limit: int | None = None, hashes: np.ndarray | None = None, floor: float = -2.0) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, similarities) of the best ``beam`` nodes found for each query, -1 where there are fewer."""
        n = limit or len(self.ids)
        beam = min(beam, n)
        nodes, sims = np.full((len(queries), beam), -1, dtype=np.int64), np.full((len(queries), beam), -2, dtype=np.float32)
        for at in range(0, len(queries), QUERY_BLOCK):
            part = slice(at, at + QUERY_BLOCK)
            nodes[part], sims[part] = self._block(queries[part], beam, n, None if hashes is None else hashes[part], floor=floor)
        return nodes, sims

    def _alike(self, queries: np.ndarray, row: np.ndarray, node: np.ndarray) -> np.ndarray:
        out = np.empty(len(row), np.float32)
        # In parts that stay in the cache.
        for at in range(0, len(row), GATHERED):
            part = slice(at, at + GATHERED)
            out[part] = np.einsum("ij,ij->i", self.vectors.take(node[part], 0), queries.take(row[part], 0))
        return out

    def _equal_hashes(self, hashes: np.ndarray, row: np.ndarray, node: np.ndarray) -> np.ndarray:
        out = np.empty(len(row), np.int64)
        for at in range(0, len(row), COMPARED):
            part = slice(at, at + COMPARED)
            out[part] = (self.hashes.take(node[part], 0) == hashes.take(row[part], 0)).sum(1)
        return out

    def _block(self, queries: np.ndarray, beam: int, n: int, hashes: np.ndarray | None, meet: Callable | None = None, near: float = 0.0, floor: float = -2.0) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, similarities) of the beams; ``meet`` gets (queries, nodes, similarities) of all nodes looked at that reach ``near``.

        Where hashes lead in, links of nodes below ``floor`` are not followed.
        """
        q = len(queries)

        def note(row: np.ndarray, node: np.ndarray, sim: np.ndarray) -> None:
            if meet is not None:
                good = np.flatnonzero(sim >= near)
                meet(row[good], node[good], sim[good])

        entry = queries @ self.vectors[self.pivots].T
        take = min(beam, len(self.pivots))
        first = np.argpartition(-entry, take - 1, axis=1)[:, :take]
        nodes, sims = np.full((q, beam), -1, dtype=np.int64), np.full((q, beam), -2, dtype=np.float32)
        nodes[:, :take], sims[:, :take] = self.pivots[first], np.take_along_axis(entry, first, 1)
        if meet is not None:
            row, col = np.nonzero(entry >= near)
            note(row, self.pivots[col], entry[row, col])
        pivot = np.zeros(n, dtype=bool)
        pivot[self.pivots] = True
        row = cand = np.zeros(0, np.int64)
        if hashes is None or not hashes.shape[1]:
            floor = -2.0
        else:
            row, cand = self._entries(hashes, n)
            fresh = ~pivot[cand]
            key = np.sort(row[fresh] * np.int64(n) + cand[fresh])
            key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
            row, cand = key // n, key % n
            if len(row):
                sim = self._alike(queries, row, cand)
                note(row, cand, sim)
                nodes, sims, _ = self._merge(np.arange(q), nodes, sims, np.zeros((q, beam), bool), row, cand, sim, beam)
        opened = np.zeros((q, beam), dtype=bool)
        active = np.arange(q)
        seen = np.zeros((q, n), dtype=bool)
        # What was looked at is not taken in again; pivots are told apart by themselves.
        seen[row, cand] = True
        while len(active):
            rank = np.where(opened[active] | (nodes[active] < 0) | (sims[active] < floor), -3, sims[active])
            step = min(STEP, beam)
            best = np.argpartition(-rank, step - 1, axis=1)[:, :step]
            valid = np.take_along_axis(rank, best, 1) > -3
            alive = valid.any(1)
            active, best, valid = active[alive], best[alive], valid[alive]
            if not len(active):
                break
            opened[active[:, None], best] = True
            grown = self.links[np.where(valid, nodes[active[:, None], best], 0)]
            grown[~valid] = -1
            grown = grown.reshape(len(active), -1)
            row, col = np.nonzero(grown >= 0)
            cand = grown[row, col]
            fresh = ~seen[active[row], cand] & (cand < n) & ~pivot[cand]
            row, cand = row[fresh], cand[fresh]
            key = np.sort(row * np.int64(n) + cand)
            key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
            row, cand = key // n, key % n
            seen[active[row], cand] = True
            if not len(row):
                continue
            sim = self._alike(queries, active[row], cand)
            note(active[row], cand, sim)
            worst = sims[active].min(1)
            better = sim > worst[row]
            row, cand, sim = row[better], cand[better], sim[better]
            if not len(row):
                continue
            nodes[active], sims[active], opened[active] = self._merge(active, nodes, sims, opened, row, cand, sim, beam)
        return nodes, sims

    @staticmethod
    def _merge(active, nodes, sims, opened, row, cand, sim, beam) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Beams of the active queries with candidates (row among the active ones, node, similarity) taken in."""
        counts = np.bincount(row, minlength=len(active))
        place = np.arange(len(row)) - (np.cumsum(counts) - counts)[row]
        more, more_sims = np.full((len(active), counts.max()), -1, dtype=np.int64), np.full((len(active), counts.max()), -2, dtype=np.float32)
        more[row, place], more_sims[row, place] = cand, sim
        all_nodes, all_sims = np.hstack([nodes[active], more]), np.hstack([sims[active], more_sims])
        all_open = np.hstack([opened[active], np.zeros_like(more, dtype=bool)])
        keep = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        return np.take_along_axis(all_nodes, keep, 1), np.take_along_axis(all_sims, keep, 1), np.take_along_axis(all_open, keep, 1)

    def _tune(self, threshold: float, rng: np.random.Generator) -> None:
        """Narrowest beam whose hits reach the recall of exhaustive search.

        Sample queries are nodes of the graph. What must be found are the nodes above the threshold with which they share
        a quarter of their hashes; a graph without hashes takes nodes mixed with others until they lie just above the threshold.
        """
        n = len(self.ids)
        picked = rng.integers(0, n, min(CALIBRATION, n))
        if self.hashes.shape[1]:
            queries, hashes = self.vectors[picked], self.hashes[picked]
            row, col = self._above(queries, threshold)
            agree = -(-hashes.shape[1] // 4)
            alike = self._equal_hashes(hashes, row, col) >= agree
            wanted = (row[alike] * np.int64(n) + col[alike])[picked[row[alike]] != col[alike]]
            # The node itself is found at once, so it does not count.
        else:
            base = self.vectors[picked]
            noise = self.vectors[rng.integers(0, n, len(base))] + rng.standard_normal(base.shape).astype(np.float32) * 0.02
            noise -= (noise * base).sum(1, keepdims=True) * base
            noise /= np.linalg.norm(noise, axis=1, keepdims=True)
            near = min(1.0, threshold + NEAR)
            queries, hashes, agree = near * base + (1 - near**2) ** 0.5 * noise, None, 0
            row, col = self._above(queries, threshold)
            wanted = row * np.int64(n) + col
        for self.beam in BEAMS:
            row, col = self._hits(queries, threshold, hashes, agree)
            if np.isin(wanted, row * np.int64(n) + col).sum() >= RECALL * len(wanted) or self.beam >= n:
                return
        # No width reaches it: searches of this graph look at every node.
        self.beam = n

    def _hits(self, queries: np.ndarray, threshold: float, hashes: np.ndarray | None, agree: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(query number, node) of every node found at or above the threshold with ``agree`` equal hashes."""
        out_q, out_x = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        open_queries, beam, n = np.arange(len(queries)), self.beam, len(self.ids)
        while len(open_queries):
            wider, size = [], max(1, min(QUERY_BLOCK, BEAM_CELLS // beam))
            for at in range(0, len(open_queries), size):
                own = open_queries[at : at + size]
                asked = None if hashes is None else hashes[own]
                met: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]

                def meet(row: np.ndarray, node: np.ndarray, sim: np.ndarray) -> None:
                    # Nearly all nodes looked at fall by their hashes, so that only hits are held.
                    if agree:
                        alike = self._equal_hashes(asked, row, node)  # noqa: B023
                        good = np.flatnonzero((alike >= 2 * agree) | ((alike >= agree) & (sim >= threshold)))
                        row, node = row[good], node[good]
                    met.append((row, node))  # noqa: B023

                _, sims = self._block(queries[own], min(beam, n), n, asked, meet, threshold - SLACK if agree else threshold, threshold - FAR)
                full = (sims >= threshold).all(1) & (beam < n)
                row, x = (np.concatenate(c) for c in zip(*met))
                done = ~full[row]
                out_q.append(own[row[done]])
                out_x.append(x[done])
                wider.append(own[full])
            open_queries, beam = np.concatenate(wider), 2 * beam
        return np.concatenate(out_q), np.concatenate(out_x)

    def _above(self, queries: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """(query number, node) at or above the threshold, by exhaustive search."""
        found = [np.nonzero(queries[at : at + EXACT_BLOCK] @ self.vectors.T >= threshold) for at in range(0, len(queries), EXACT_BLOCK)]
        return np.concatenate([row + i * EXACT_BLOCK for i, (row, _) in enumerate(found)]), np.concatenate([col for _, col in found])

    def search(self, queries: np.ndarray, threshold: float, hashes: np.ndarray | None = None, agree: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(query number, id) of every node found at or above the threshold that shares at least ``agree`` hashes.

        A beam whose worst node still reaches the threshold may have left others out, so it is doubled
        until it does not: neighbours are never capped.
        """
        row, node = self._hits(queries, threshold, hashes, agree if hashes is not None else 0)
        return row, self.ids[node]

    def dumps(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, ids=self.ids, vectors=np.round(self.vectors * 127).astype(np.int8), links=self.links, pivots=self.pivots, beam=np.array(self.beam), hashes=self.hashes)
        return out.getvalue()

    @classmethod
    def loads(cls, data: bytes | pa.Buffer) -> Graph:
        # A reader of the buffer itself: stored graphs are not copied.
        x = np.load(pa.BufferReader(data))
        vectors = x["vectors"].astype(np.float32)
        vectors /= 127
        return cls(x["ids"], vectors, x["links"], x["pivots"], int(x["beam"]), x["hashes"])


def _hash_pairs(hashes: np.ndarray, first: int = 0) -> np.ndarray:
    """The pairs of hashes within each group of columns, scrambled, with the row's number from ``first`` on in the low bits; sorted."""
    groups = np.array_split(np.arange(hashes.shape[1]), GROUPS)
    pairs = np.array([(a, b) for g in groups for a in g for b in g if a < b], np.int64).reshape(-1, 2)
    wide, row = hashes.astype(np.uint64), np.arange(first, first + len(hashes), dtype=np.uint64)
    out = np.empty((len(pairs), len(hashes)), np.uint64)
    for k, (a, b) in enumerate(pairs.tolist()):
        salt = np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        out[k] = shingling.mixed((wide[:, a] << np.uint64(32) | wide[:, b]) + salt) & ~OWNER | row
    return np.sort(out, axis=None)


def sketch(hashes: np.ndarray, owner: np.ndarray, rows: int, width: int) -> np.ndarray:
    """Signed count sketch of each row's 64-bit hashes, to unit length."""
    h = hashes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    slot = ((h >> np.uint64(8)) % np.uint64(width)).astype(np.int64)
    sign = np.where((h >> np.uint64(7)) & np.uint64(1), 1.0, -1.0)
    out = np.bincount(owner * width + slot, weights=sign, minlength=rows * width).reshape(rows, width)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm > 0, norm, 1)).astype(np.float32)
