import numpy as np

from inkstone.llm import batch_dedup
from inkstone.llm.graph_index import Graph


def _nodes(n, seed):
    """(vectors as bytes, hashes as bytes) of families of three nodes much alike."""
    rng = np.random.default_rng(seed)
    v = np.repeat(rng.standard_normal((n // 3, 2 * batch_dedup.WIDTH)), 3, axis=0) + 0.2 * rng.standard_normal((n, 2 * batch_dedup.WIDTH))
    v = np.round(v / np.linalg.norm(v, axis=1, keepdims=True) * 127).astype(np.int8)
    h = np.repeat(rng.integers(0, 2**32, (n // 3, batch_dedup.HASHES), dtype=np.uint32), 3, axis=0)
    return [x.tobytes() for x in v], [x.tobytes() for x in h]


def test_queries_meet_graphs_where_they_are_stored(spark):
    vec, mh = _nodes(600, 1)
    rows = [(i, bytearray(vec[i]), bytearray(mh[i]), i % 3, i % 3) for i in range(600)]
    nodes = spark.createDataFrame(rows, "cid long, vec binary, mh binary, first int, last int")
    found = batch_dedup.neighbour_candidates(nodes, 3, graph_nodes=70)
    # Stored graphs travel neither to the JVM nor through shuffles.
    assert "payload" not in found._jdf.queryExecution().toString()
    got = [tuple(r) for r in found.collect()]
    assert sorted(got) == sorted((a, b) for i in range(0, 600, 3) for a, b in ((i, i + 1), (i, i + 2), (i + 1, i + 2)))


def test_graphs_of_one_file_in_a_folder_of_an_odd_name(spark, tmp_path):
    vec, mh = _nodes(60, 2)
    made = [Graph.build(np.arange(p, 60, 2), batch_dedup._unit(vec[p::2]), batch_dedup.SKETCH_THRESHOLD, hashes=batch_dedup._hashes(mh[p::2])).dumps() for p in (0, 1)]
    path = f"{tmp_path}/of 14:00 %3A"
    spark.createDataFrame([(f"g/{p}", bytearray(d)) for p, d in enumerate(made)], "graph string, payload binary").coalesce(1).write.parquet(path)
    asked = spark.createDataFrame([(7, 100 + i, bytearray(vec[i]), bytearray(mh[i])) for i in range(60)], "asker int, cid long, vec binary, mh binary")
    found = batch_dedup.search_graphs(asked, spark.read.parquet(path), {7: ["g/0", "g/1"], 8: ["g/0"]}, {7: 60})
    assert {tuple(r) for r in found.collect()} == {(i - i % 3 + k, 100 + i) for i in range(60) for k in range(3)}
