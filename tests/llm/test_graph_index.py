import numpy as np

from inkstone.llm.graph_index import Graph

THRESHOLD = 0.62


def test_tuned_beam_finds_neighbours_near_the_boundary():
    rng = np.random.default_rng(3)
    unit = lambda x: (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    nodes = unit(rng.standard_normal((12_000, 128)))
    graph = Graph.build(np.arange(len(nodes)), nodes, THRESHOLD)
    picked = nodes[rng.integers(0, len(nodes), 512)]
    noise = rng.standard_normal(picked.shape)
    noise = unit(noise - (noise * picked).sum(1, keepdims=True) * picked)
    queries = (0.75 * picked + (1 - 0.75**2) ** 0.5 * noise).astype(np.float32)
    want = set(zip(*(x.tolist() for x in np.nonzero(queries @ nodes.T >= THRESHOLD))))
    got = set(zip(*(x.tolist() for x in graph.search(queries, THRESHOLD))))
    assert len(want & got) >= 0.96 * len(want)
