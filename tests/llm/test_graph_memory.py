import numpy as np

from inkstone.llm import graph_index
from inkstone.llm.graph_index import Graph


def test_widened_beams_hold_a_bounded_number_of_places(monkeypatch):
    monkeypatch.setattr(graph_index, "BEAM_CELLS", 2048, raising=False)
    rng = np.random.default_rng(2)
    nodes = rng.standard_normal(16).astype(np.float32) + 0.2 * rng.standard_normal((200, 16)).astype(np.float32)
    nodes /= np.linalg.norm(nodes, axis=1, keepdims=True)
    graph = Graph.build(np.arange(200), nodes, 0.9)
    held, block = [], Graph._block
    monkeypatch.setattr(Graph, "_block", lambda self, queries, beam, *rest: held.append(len(queries) * beam) or block(self, queries, beam, *rest))
    # All nodes are alike, so beams are widened to the whole graph.
    q, x = graph.search(nodes[:100], 0.3)
    assert len(q) == 100 * 200 and len({*zip(q.tolist(), x.tolist())}) == 100 * 200
    assert max(held) <= 2048
