import itertools
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute

from inkstone.llm import packed_join, shingling


def _prompts(rows, rng):
    words = [f"w{i}" for i in range(60)]
    frame = " ".join(words[:30])
    out = []
    for i in range(rows):
        own = " ".join(f"{rng.choice(words)}{rng.randrange(40)}" for _ in range(rng.randrange(10, 40)))
        out.append(frame + " " + own if i % 3 else rng.choice(out or [own]) + " " + own[:20])
    return out


def test_chunks_meet_all_pairs_in_reach_and_hold_less_than_their_shingles(monkeypatch):
    monkeypatch.setattr(packed_join, "ROWS", 16)
    monkeypatch.setattr(packed_join, "CROSS", 50)
    monkeypatch.setattr(shingling, "PIECE", 8)
    monkeypatch.setattr(shingling.pieces, "__defaults__", (8,))
    rng = random.Random(5)
    texts = _prompts(150, rng)
    batch = pa.record_batch([pa.array(range(150), pa.int64()), pa.array([1] * 150, pa.int64()), pa.array(texts)], names=["id", "seed", "w"])
    chunks = pa.Table.from_batches(list(packed_join.chunked_batches(3)(iter([batch]))))
    assert len(chunks) > 5
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (t.split() for t in texts)]
    held = sum(len(v.as_py()) for c in ("vocabulary", "codes", "sizes") for v in chunks[c])
    assert held < 0.9 * 8 * sum(map(len, sets))
    asks = pa.Table.from_batches(list(packed_join.asking(3, 4)(iter(chunks.to_batches()))))
    told = pa.concat_tables([packed_join.replying(asks.filter(pa.compute.equal(asks["bucket"], b))) for b in set(asks["bucket"].to_pylist())])
    signed = pa.Table.from_batches(list(packed_join.signed_rows(iter(chunks.to_batches()))))
    heads, seen = [], set()
    for row in signed.to_pylist():
        if (row["s1"], row["s2"]) not in seen:
            seen.add((row["s1"], row["s2"]))
            heads.append(row)
    posted = []
    for i in range(len(chunks)):
        c = chunks.slice(i, 1)
        name = c["chunk"][0].as_py()
        own = packed_join.heads_of_chunk(pa.Table.from_pylist([h for h in heads if h["chunk"] == name], signed.schema))
        posted.append(packed_join.posting(3, 0.5, 4)(c, pa.concat_tables([told.filter(pa.compute.equal(told["chunk"], name)), own.select(told.schema.names)])))
    posted = pa.concat_tables(posted)
    met = [r for b in set(posted["bucket"].to_pylist()) for r in packed_join.meeting(0.5)(posted.filter(pa.compute.equal(posted["bucket"], b))).to_pylist()]
    classes, n_of = {}, {}
    for r in met:
        if r["kind"] == 0:
            classes.setdefault(r["x"], []).append(r["y"])
            n_of[r["y"]] = r["n"]
    got = {tuple(sorted(p)) for r in met if r["kind"] == 1 for p in itertools.product(classes[r["x"]], classes[r["y"]])}
    got |= {tuple(sorted(p)) for ids in classes.values() for p in itertools.combinations(ids, 2)}
    ids = [h["id"] for h in heads]
    want = {(a, b) for a, b in itertools.combinations(sorted(ids), 2) if len(sets[a] & sets[b]) * 2 >= len(sets[a] | sets[b])}
    assert len(want) > 10 and want <= got
    assert all(n == len(sets[k]) for k, n in n_of.items())


def test_packed_keys_come_back():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << packed_join.KEY_BITS, 500).astype(np.uint64))
    assert (packed_join.unpacked_keys(packed_join.packed_keys(keys)) == keys).all() and len(packed_join.unpacked_keys(b"")) == 0
    cuts = packed_join.bucket_cuts(keys, 7)
    assert cuts[0] == 0 and cuts[-1] == len(keys) and (np.diff(cuts) >= 0).all()
