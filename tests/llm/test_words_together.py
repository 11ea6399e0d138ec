import pyarrow as pa

from inkstone.llm import shingling
from inkstone.llm.text_forms import consistent_form, word_list

TEXTS = ["Plain words, twice: plain words.", None, "", "café “naïve” — x_y", "été 가", "соat pаy ΑΣ", "a­b ﬁn　Ａb", "a\r\nb\x0bcİ", "नर \U0001f600 ²①", "ab" * 300 + " " + "ba" * 300]


def test_only_texts_that_the_form_changes_are_brought_to_it(monkeypatch):
    formed = []
    monkeypatch.setattr(shingling, "consistent_form", lambda t: formed.append(t) or consistent_form(t))
    known = shingling.WordHashes()
    sizes, hashes = shingling.word_hashes(pa.array(TEXTS), known)
    words = [word_list(consistent_form(t).lower()) if t else [] for t in TEXTS]
    assert sizes.tolist() == [len(w) for w in words]
    assert hashes.tolist() == [known[w] for ws in words for w in ws]
    assert sorted(formed) == sorted(TEXTS[4:8])


def test_texts_are_split_in_bounded_parts(monkeypatch):
    whole = shingling.word_hashes(pa.array(TEXTS), shingling.WordHashes())
    monkeypatch.setattr(shingling, "CHARACTERS", 32)
    parts = shingling.word_hashes(pa.array(TEXTS), shingling.WordHashes())
    assert all((a == b).all() for a, b in zip(whole, parts))
