import itertools

from hypothesis import given, settings
from hypothesis import strategies as st

from inkstone.llm import text_forms
from inkstone.llm.text_forms import consistent_form


def test_disguises_come_back():
    assert consistent_form("Ｐａｙ ｔｈｅ bill") == "Pay the bill"
    assert consistent_form("Rаtе\xa0thе ﬁle‑2​") == "Rate the file-2"
    assert consistent_form("café\r\nnoir  \n") == "café\nnoir"
    assert consistent_form("Он сказал: cтоп") == "Он сказал: стоп"


def test_visible_differences_stay():
    for a, b in (("Case", "case"), ("a—b", "a-b"), ("resume", "résumé"), ("x²", "x2"), ("a\nb", "a b"), ("“q”", '"q"')):
        assert consistent_form(a) != consistent_form(b)


def test_null_and_blank():
    assert consistent_form(None) is None and consistent_form(" \t\n​") == ""


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_form_is_stable(t):
    assert consistent_form(consistent_form(t)) == consistent_form(t)


def test_pairs_match_brute_force(spark):
    rows = [(1, "same text"), (2, "sаme text"), (3, "same text"), (4, "Same text"), (5, None), (6, "  "), (7, "​"), (8, "same text")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "row_idx int, prompt string, look string, id string")
    want = {(a, b) for (a, x), (b, y) in itertools.combinations(rows, 2) if x and y and consistent_form(x) and consistent_form(x) == consistent_form(y) and x != y}
    assert {tuple(r) for r in text_forms.look_alike_pairs(df, "row_idx", "prompt").collect()} == want
    assert text_forms.look_alike_pairs(df.limit(0), "row_idx", "prompt").count() == 0
    assert text_forms.consistent_forms(df, "row_idx", "prompt").count() == 8


def test_classes_count_writings_and_copies(spark):
    rows = [(1, "a b"), (2, "a\u00a0b"), (3, "a b"), (4, "c"), (5, "c"), (6, None), (7, " ")]
    got = text_forms.look_alike_classes(spark.createDataFrame(rows, "row_idx long, t string"), "row_idx", "t").collect()
    assert {tuple(r) for r in got} == {(1, 1, 2, 3), (2, 1, 2, 3), (3, 1, 2, 3)}
    assert text_forms.folded_form("Stra\u00dfe") == "strasse" and text_forms.folded_form(None) is None


def test_lunate_sigma_looks_like_c():
    assert consistent_form("Cµ") == consistent_form(consistent_form("Cµ"))
    assert consistent_form("ϲat Ϲat") == "cat Cat"
    assert consistent_form("ıҼ") == consistent_form(consistent_form("ıҼ"))
