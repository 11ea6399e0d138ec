import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkstone.llm import batch_dedup, eval_leaks, graph_index, language_id, residue, tokenization
from inkstone.llm.text_forms import words


@pytest.fixture(scope="module")
def encoding():
    return tokenization.load_encoding(tokenization.tokenizer_path())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["plain words here ", "don't  ", "\n\n", "'", "s ", "x1y2", "   ", "日本語", "é́ ", "<|endoftext|>", "!!! ", "\t"]), max_size=120))
def test_chunked_ids_are_exact(encoding, parts):
    t = "".join(parts)
    assert tokenization.ChunkEncoder(encoding).encode(t) == encoding.encode_ordinary(t)


def test_chunks_are_reused_and_cache_is_bounded(encoding):
    t = " ".join(f"word{i % 97} and text" for i in range(3000))
    one = tokenization.ChunkEncoder(encoding)
    assert one.encode(t) == one.encode(t) == encoding.encode_ordinary(t) and one.reused >= one.encoded
    small = tokenization.ChunkEncoder(encoding, cache_chars=500)
    assert small.encode(t) == encoding.encode_ordinary(t) and small.held <= 5000


def test_encode_null_and_empty(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "hi")], "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in tokenization.encode_corpus(df, "doc_id", "text").collect()}
    assert got[1] == got[2] == [] and len(got[3]) == 1


def test_leaks_match_brute_force(spark):
    rng = random.Random(1)
    items = [(i, " ".join(rng.choice("abcd") + str(rng.randrange(4)) for _ in range(rng.randrange(5, 40)))) for i in range(12)]
    docs = []
    for i in range(80):
        own = [rng.choice("abcd") + str(rng.randrange(4)) for _ in range(30)]
        src = rng.choice(items)[1].split()
        n = rng.randrange(4, 16)
        docs.append((i, " ".join(own[:10] + src[:n] + own[10:]).replace(" ", ", ", 3).upper()))
    docs += [(100, None), (101, ""), (102, "<p>" + items[0][1].replace(" ", "</b> ") + "</p>" + items[1][1])]
    windows = {i: {tuple(eval_leaks.plain_words(t)[k : k + 8]) for k in range(len(t.split()) - 7)} for i, t in items}
    want = {(d, i) for d, t in docs for w in [eval_leaks.plain_words(t)] for k in range(len(w) - 7) for i in windows if tuple(w[k : k + 8]) in windows[i]}
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*items, (99, None)], "item_id long, text string")
    for block in (10**6, 30):
        got = [tuple(r) for r in eval_leaks.leaked_items(df, "doc_id", "text", it, "item_id", "text", 8, block).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert eval_leaks.leaked_items(df, "doc_id", "text", it.limit(0), "item_id", "text").count() == 0


def test_residue(spark):
    plain = "Please rank the items by yield and tell the night shift what changed since the last review."
    bad = {
        1: "The owner {{company}} wants it.", 2: "Return [insert amount here] rows to <DUE_DATE>.", 3: plain + "\n\nHTTP Error 503 - Service Unavailable. Please try again.",
        4: "Bitte aktivieren Sie JavaScript, um diese Seite anzuzeigen.", 5: "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod.", 6: "asdf qwer zxcv asdf jkl qwer sdfg asdf",
        7: "Traceback (most recent call last):\n  File \"/srv/a.py\", line 3, in run\nValueError: x", 8: "404 Not Found",
    }
    good = {
        20: plain, 21: "Document the config key ${timeout} so that a new hire knows it is read from the shell before step 4.", 22: None, 23: "", 24: "   ", 25: "!!!???...---",
        26: "Explain to Ann the difference between a 404 and a 410 answer, using the shop server as an example.", 27: "According to [12] and [sic] in the margin, he copied it.", 28: "In the set {x, y} order does not matter.",
    }
    many = [(100 + i, plain + f" Number {i}.") for i in range(200)]
    df = spark.createDataFrame([*bad.items(), *good.items(), *many, (1, bad[1])], "doc_id long, text string")
    assert {r["doc_id"] for r in residue.residue_documents(df, "doc_id", "text").collect()} == set(bad)
    assert residue.residue_documents(df.limit(0), "doc_id", "text").count() == 0


def test_codewords_stand_apart():
    book = language_id.codewords(9)
    assert min((book[a] != book[b]).sum() for a in range(9) for b in range(a)) >= 4


SENTENCES = {
    "en": "The report should be ready before the next meeting on Monday. We need the numbers for every single office in the town.",
    "de": "Der Bericht soll vor der nächsten Sitzung am Montag fertig sein. Wir brauchen die Zahlen für jedes einzelne Büro in der Stadt.",
    "fr": "Le rapport doit être prêt avant la prochaine réunion de lundi. Nous avons besoin des chiffres de chaque bureau de la ville.",
    "ru": "Отчёт должен быть готов до следующего совещания в понедельник. Нам нужны цифры по каждому отделению в городе.",
    "zh": "报告必须在星期一的下一次会议之前完成。我们需要城里每一个办公室的数字。",
}


def test_language_of_mixed_and_empty_texts():
    model = language_id.train([(s, lang) for lang, s in SENTENCES.items()] * 3)
    texts = [*SENTENCES.values(), SENTENCES["en"] + "\n" + SENTENCES["de"], None, "", "  "]
    found = language_id.detect(model, texts)
    assert [{s[2] for s in f} for f in found] == [{k} for k in SENTENCES] + [{"en", "de"}, set(), set(), set()]


def test_labels(spark):
    labels = [("en-US", "en"), ("German", "de"), (" FRA ", "fr"), ("und", ""), (None, ""), ("", ""), ("sv", "sv")]
    df = spark.createDataFrame([(a,) for a, _ in labels], "l string")
    assert [r[0] for r in df.select(language_id.label_language(F.col("l"))).collect()] == [b for _, b in labels]


def test_graph_recall_against_brute_force():
    rng = np.random.default_rng(0)
    base = rng.standard_normal((4000, 32)).astype(np.float32)
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    queries = base[:500] + 0.08 * rng.standard_normal((500, 32)).astype(np.float32)
    queries /= np.linalg.norm(queries, axis=1, keepdims=True)
    graph = graph_index.Graph.loads(graph_index.Graph.build(np.arange(4000), base, 0.7).dumps())
    q, i = graph.search(queries, 0.7)
    want = set(zip(*np.nonzero(queries @ base.T >= 0.7)))
    assert len(set(zip(q.tolist(), i.tolist())) & {(int(a), int(b)) for a, b in want}) >= 0.9 * len(want)


def test_graph_never_caps_neighbours():
    one = np.tile(np.eye(1, 16, dtype=np.float32), (700, 1))
    graph = graph_index.Graph.build(np.arange(700), one, 0.7)
    assert len(set(graph.search(one[:1], 0.7)[1].tolist())) == 700


def test_segments_cover_history_once():
    for b in range(70):
        got = [x for lv, k in batch_dedup.segments_before(b) for x in range(k * 4**lv, (k + 1) * 4**lv)]
        assert sorted(got) == list(range(b))


def test_batches_match_sequential_rule(spark):
    rng = random.Random(7)
    rows, texts = [], []
    for i in range(140):
        if texts and rng.random() < 0.5:
            w = rng.choice(texts).split()
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = rng.choice("uvwxyz") + str(rng.randrange(50))
        else:
            w = [rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(25)]
        texts.append(" ".join(w))
        rows.append((i, rng.choice([None, None, f"k{rng.randrange(60)}"]), texts[-1] if rng.random() < 0.95 else None))
    batch = [(i, f"batch_{rng.randrange(9)}") for i in range(135)] + [(3, "batch_8")]
    tasks = spark.createDataFrame([(*r, "clash") for r in rows], "row_idx long, k string, t string, batch string")
    got = batch_dedup.batch_duplicates(tasks, spark.createDataFrame(batch, "row_idx long, batch_id string"), "row_idx", F.col("k"), words(F.col("t")), "batch_id")
    first = {}
    for i, b in batch:
        first[i] = min(b, first.get(i, b))
    sh = {i: {tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)} if t else set() for i, _, t in rows}
    key = {i: k for i, k, _ in rows}
    near = lambda a, b: bool(sh[a] and sh[b]) and len(sh[a] & sh[b]) / len(sh[a] | sh[b]) >= 0.5
    accepted, want = [], set()
    for b in sorted(set(first.values())):
        new = []
        for i in (i for i in first if first[i] == b):
            hit = [j for j in accepted if (key[i] and key[i] == key[j]) or near(i, j)]
            want |= {(min(i, j), max(i, j)) for j in hit}
            if not hit:
                new.append(i)
        accepted += new
    assert {tuple(r) for r in got.collect()} == want


def test_a_short_second_sentence_counts_when_it_is_sure():
    # The model of this test knows few words, so the sentences are made of words it has seen.
    model = language_id.train([(s, lang) for lang, s in SENTENCES.items()] * 3)
    found = language_id.detect(model, [SENTENCES["en"] + " Wir brauchen die Zahlen."])[0]
    assert {s[2] for s in found if s[5]} == {"en", "de"}
