import numpy as np

from inkstone.llm.graph_index import Graph
from inkstone.llm.shingling import distinct


def test_search_finds_each_node_once():
    rng = np.random.default_rng(2)
    base = rng.standard_normal((300, 32)).astype(np.float32)
    v = np.repeat(base, 6, axis=0) + rng.standard_normal((1800, 32)).astype(np.float32) * 0.25
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    h = np.repeat(rng.integers(0, 2**32, (300, 16), dtype=np.uint32), 6, axis=0)
    graph = Graph.build(np.arange(1800), v, 0.68, hashes=h)
    q, x = graph.search(v, 0.68, h, 4)
    assert len(set(zip(q.tolist(), x.tolist()))) == len(q)
    row, col = np.nonzero((v @ v.T >= 0.68) & (np.arange(1800)[:, None] // 6 == np.arange(1800)[None] // 6))
    assert len(set(zip(row.tolist(), col.tolist())) - set(zip(q.tolist(), x.tolist()))) <= 0.01 * len(row)


def test_distinct_keeps_values_that_differ_in_low_bits():
    values = np.array([2**63 + 5, 3, 2**63 + 4, 3, 2**63 + 5, 7], dtype=np.uint64)
    sizes, out = distinct(np.array([0, 0, 0, 0, 0, 2]), values, 3)
    assert sizes.tolist() == [3, 0, 1] and out.tolist() == sorted(values[:3].view(np.int64).tolist()) + [7]
