"""Recall and precision on texts written apart from the tables; even lines were looked at while writing, odd ones were not."""

import sys
from pathlib import Path

import pytest

from inkstone.llm import residue

sys.path.insert(0, str(Path(__file__).parent))
import residue_texts  # noqa: E402


@pytest.mark.parametrize("half", [0, 1])
def test_recall_and_precision_on_texts_of_our_own(half):
    index = residue.Index({}, 10_000)
    found = sum(index.classify(t) is not None for t in residue_texts.RESIDUE[half::2])
    wrong = sum(index.classify(t) is not None for t in residue_texts.HARMLESS[half::2])
    assert len(residue_texts.RESIDUE) >= 100 and len(residue_texts.HARMLESS) >= 100
    assert found >= 0.9 * len(residue_texts.RESIDUE[half::2]) and found >= 0.9 * (found + wrong)


def test_repeats_clashing_columns_and_long_texts(spark):
    filler = "Rain fell on the mill and the miller slept. " * 20_000
    rows = [(1, filler + "Dear [Hotel Name], thanks.", "x", 1), (1, "plain", "x", 1), (2, filler, None, 2), (None, "404 Not Found", "y", 3), (3, None, "y", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string, n long")
    assert [tuple(r) for r in residue.residue_documents(df, "doc_id", "text").collect()] == [(1, "placeholder")]
