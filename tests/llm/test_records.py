import itertools
import random

from pyspark.sql import functions as F

from inkstone.llm import cutoffs, group_splits, near_duplicates, term_counts
from inkstone.llm.text_forms import words


def test_terms_over_tiny_leaves(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefghij") for _ in range(rng.randrange(0, 9))) for _ in range(60)] + ["hot " * 50]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    parts = term_counts.partial_counts(df, "f", words(F.col("text")))
    got = {r["term"]: (r["occurrences"], r["records"]) for r in term_counts.count_terms(parts, leaf_rows=2).collect()}
    every = [t.split() for t in texts]
    want = {w: (sum(t.count(w) for t in every), sum(w in t for t in every)) for t in every for w in t}
    want[None] = (sum(map(len, every)), len(texts))
    assert got == want


def test_terms_of_an_empty_table_and_null_texts(spark):
    df = spark.createDataFrame([(None,)], "text string")
    marked = term_counts.marked_terms(term_counts.partial_counts(df, "f", words(F.col("text"))), F.col("records") < 3, F.col("records") > 10)
    assert marked.count() == 0
    assert term_counts.count_terms(term_counts.partial_counts(df.limit(0), "f", words(F.col("text")))).count() == 0


def brute_pairs(rows, width, threshold):
    sets = {}
    for i, block, t in rows:
        w = (t or "").lower().split()
        if len(w) >= width:
            sets[i] = (block, {tuple(w[k : k + width]) for k in range(len(w) - width + 1)})
    return {
        (a, b) for a, b in itertools.combinations(sorted(sets), 2)
        if sets[a][0] == sets[b][0] and len(sets[a][1] & sets[b][1]) / len(sets[a][1] | sets[b][1]) >= threshold
    }


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for i in range(150):
        if i % 3 and rows:
            base = rng.choice(rows)[2].split()
            for _ in range(rng.randrange(4)):
                base[rng.randrange(len(base))] = rng.choice("abcdefgh")
        else:
            base = [rng.choice("abcdefgh") for _ in range(rng.randrange(3, 20))]
        rows.append((i, rng.choice("xy"), " ".join(base)))
    rows += [(900, "x", None), (901, "x", ""), (902, None, "a b c d"), (903, None, "a b c d"), (904, "x", "a b")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "row_idx int, block string, t string, cid string").withColumn("w", words(F.col("t")))
    for threshold in (0.5, 0.8):
        got = [tuple(r) for r in near_duplicates.near_duplicate_pairs(df, "row_idx", "w", "block", 3, threshold).collect()]
        assert len(got) == len(set(got)) and set(got) == brute_pairs(rows, 3, threshold)
    classes = near_duplicates.near_duplicate_classes(df, "row_idx", "w", "block").collect()
    assert len(classes) == len(rows) and {r["row_idx"] for r in classes if r["class_id"] is None} >= {900, 901, 904}
    assert near_duplicates.near_duplicate_pairs(df.limit(0), "row_idx", "w", "block").count() == 0


def test_near_duplicates_with_one_hot_group(spark):
    rows = [(i, "x", "one two three four five six") for i in range(40)] + [(99, "x", "one two three four five seven")]
    df = spark.createDataFrame(rows, "row_idx int, block string, t string").withColumn("w", words(F.col("t")))
    assert near_duplicates.near_duplicate_pairs(df, "row_idx", "w", "block").count() == 41 * 40 // 2


def test_groups_match_union_find(spark):
    rng = random.Random(2)
    tasks = [(f"t{rng.randrange(60)}", rng.choice([None, *[f"n{k}" for k in range(40)]])) for _ in range(90)]
    df = spark.createDataFrame(tasks, "t string, a string").select(group_splits.vertex("t", F.col("t")).alias("t"), group_splits.vertex("a", F.col("a")).alias("a"))
    confirmed = [(i, rng.choice([None, *[f"t{k}" for k in range(60)]]), None) for i in range(50)]
    cf = spark.createDataFrame(confirmed, "confirm_id int, t string, a string").select("confirm_id", group_splits.vertex("t", F.col("t")).alias("t"), group_splits.vertex("a", F.col("a")).alias("a"))
    got = {r["confirm_id"]: r["group_id"] for r in group_splits.related_groups(cf, "confirm_id", ["t", "a"], group_splits.links(df, ["t", "a"])).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for t, a in tasks:
        if a:
            parent[find(("n", a))] = find(("t", t))
    roots = {i: find(("t", t)) if t else ("own", i) for i, t, _ in confirmed}
    want = {i: min(j for j in roots if roots[j] == roots[i]) for i in roots}
    assert got == want


def test_long_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001 + i) for i in range(200)]
    label = group_splits.components(spark.createDataFrame(edges, "u long, v long")).collect()
    by = {}
    for r in label:
        by.setdefault(r["label"], set()).add(r["vertex"])
    assert sorted(len(m) for m in by.values()) == [200, 200]


def test_splits_keep_groups_and_shares(spark):
    rng = random.Random(3)
    groups = [(i, rng.choice([0, 0, 0, *range(1, 300)])) for i in range(2000)]
    df = spark.createDataFrame(groups, "confirm_id int, group_id int")
    got = group_splits.assign_splits(df, "confirm_id", {"train": 0.7, "validation": 0.15, "test": 0.15}).collect()
    assert len(got) == 2000 and len({(r["group_id"], r["split"]) for r in got}) == len({g for _, g in groups})
    assert abs(sum(r["split"] == "train" for r in got) / 2000 - 0.7) < 0.02
    assert group_splits.assign_splits(df.limit(0), "confirm_id", {"train": 0.7, "test": 0.3}).count() == 0


def test_name_keys():
    key = group_splits._name_key
    assert key("Zutä Lane") == key(" LANE,  zutä ") == "lane zutä" and key("  ") is None and key(None) is None
    assert key("Zuta Lane") != key("Zutä Lane")


def test_cutoffs_match_definition(spark):
    rng = random.Random(5)
    rows = [(g, s, round(rng.choice([rng.random(), 0.5, 0.25]), 4), pct) for g, pct, n in (("a", 40, 700), ("b", 95, 3), ("c", 25, 1), ("hot", 80, 3000)) for s in ("x", None) for _ in range(n)]
    df = spark.createDataFrame([(g, s or "null", v, p) for g, s, v, p in rows], "g string, s string, v double, pct int")
    got = {(r["g"], r["s"]): (r["cutoff"], r["kept"]) for r in cutoffs.fraction_cutoffs(df, ["g", "s"], "v", "pct").collect()}
    for g, s in {(r[0], r[1] or "null") for r in rows}:
        values = sorted((r[2] for r in rows if r[0] == g and (r[1] or "null") == s), reverse=True)
        pct = next(r[3] for r in rows if r[0] == g)
        cut = max(v for v in values if sum(x >= v for x in values) * 100 >= pct * len(values))
        assert got[g, s] == (cut, sum(x >= cut for x in values))
    assert cutoffs.fraction_cutoffs(df.limit(0), ["g", "s"], "v", "pct").count() == 0
