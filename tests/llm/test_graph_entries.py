import numpy as np

from inkstone.llm.graph_index import Graph


def test_common_hashes_lead_to_the_near_nodes_by_pairs(monkeypatch):
    rng = np.random.default_rng(4)
    unit = lambda x: (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    n = 4000
    nodes, hashes = unit(rng.standard_normal((n, 64))), rng.integers(0, 40, (n, 16)).astype(np.uint32)
    graph = Graph.build(np.arange(n), nodes, 0.68, hashes=hashes)
    of = rng.integers(0, n, 512)
    queries = unit(nodes[of] + 0.08 * rng.standard_normal((512, 64)))
    # Each hash is that of a hundred nodes; half of a query's are those of the node it is near to.
    asked = np.where(rng.random((512, 16)) < 0.5, hashes[of], rng.integers(0, 40, (512, 16))).astype(np.uint32)
    looked, alike = [], Graph._alike
    monkeypatch.setattr(Graph, "_alike", lambda self, queries, row, node: looked.append(len(row)) or alike(self, queries, row, node))
    q, x = graph.search(queries, 0.68, asked, 4)
    want = {(i, j) for i, j in enumerate(of.tolist()) if queries[i] @ nodes[j] >= 0.68 and (asked[i] == hashes[j]).sum() >= 4}
    assert len(want) > 450 and len(want & set(zip(q.tolist(), x.tolist()))) >= 0.99 * len(want)
    assert sum(looked) <= 150 * len(queries)
