import pytest

from inkstone.llm import residue


@pytest.fixture(scope="module")
def index():
    return residue.Index({t: 1 for _, toks in residue.exemplars() for t in toks}, 10_000)


@pytest.mark.parametrize("text", [
    "The run ends after {{session_timeout}} and nobody noticed.", "Wait for <%= timeout %> before the next load.", "Welcome {{first_name}}, your crate is here.",
    "Dear [Patient Name], your visit is due.", "Send it to {order_ref} before noon.", "The invoice from %VENDOR% arrived.", "Hand it to <SITE_LEAD> again.", "Ask #shiftLead# about it.",
])
def test_open_and_unlisted_slots_are_residue(index, text):
    assert index.classify(text) == "placeholder"


@pytest.mark.parametrize("text", [
    "Document the config key ${timeout} so that a new hire knows it is read from the shell before step 4.",
    "Set a[MAX_LEN] to 3, see [12] and [sic].", "| Patient Name | Crate |", "The feed holds <order_ref>5</order_ref> only.", "Run it with $order_ref and __init__ as they are.", "In the set {x, y} order does not matter.",
])
def test_code_citations_and_harmless_texts_are_not(index, text):
    assert index.classify(text) is None
