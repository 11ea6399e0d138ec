import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from inkstone.operators import pair_analysis


def test_pieces_hold_every_pair_once_with_exact_overlaps(monkeypatch):
    monkeypatch.setattr(pair_analysis, "CELLS", 300)
    rng = random.Random(3)
    # 300 items of many rows fill several words of bits; the others go through postings; some rows are empty.
    sets = [[x for x in range(300) if rng.random() < 0.3] + rng.sample(range(1000, 1400), 9) if i % 9 else [] for i in range(90)]
    vectors = np.round(np.random.default_rng(1).random((90, 16)), 2)
    vectors[40:44] = vectors[3]
    vectors[50] = vectors[51] * (1 + 1e-9)
    for scale in (1.0, 1e9):
        for lo, hi in ((0, 0), (0, 1)):
            block = [(i % 2) * hi for i in range(90)]
            table = pa.table({"s": pa.array(sets, pa.list_(pa.int64())), "v": pa.array((vectors * scale).tolist()), "block": block, "lo": [lo] * 90, "hi": [hi] * 90})
            met = {}
            for p in pair_analysis._pieces(table):
                far, mask = p.far(), np.ones(p.shared.shape, bool) if p.mask is None else p.mask
                for r, c in zip(*np.nonzero(mask)):
                    pair = frozenset((int(p.a.at[p.rows][r]), int(p.b.at[p.cols][c])))
                    assert pair not in met
                    met[pair] = (int(p.shared[r, c]), far[r, c])
            assert met.keys() == {frozenset((i, j)) for i in range(90) for j in range(i) if not hi or block[i] != block[j]}
            for pair, (shared, far) in met.items():
                i, j = pair
                want = ((vectors[i] * scale - vectors[j] * scale) ** 2).sum()
                assert shared == len(set(sets[i]) & set(sets[j])) and abs(far - want) <= 1e-12 * (1 + want)


def test_meetings_of_blocks_are_spread_by_pairs_not_bytes(spark):
    rows = [(k, "g", "", [f"x{k % 5}"]) for k in range(60)]
    df = spark.createDataFrame(rows, "k int, g string, author string, s array<string>")
    sets = pair_analysis.prepared(df, "k", "g", "author", "s", block_rows=5)
    where = lambda t: t.select(["k"]).slice(0, 1)
    met = pair_analysis._meetings(sets).applyInArrow(where, "k bigint")
    assert met.select(F.spark_partition_id().alias("p")).distinct().count() > 8
