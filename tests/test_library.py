"""A site's own files, and the drafting of fingerprints."""

from __future__ import annotations

import pytest
import yaml

from tallyforge.operators import draft, library, templates

GOOD = {"id": "mine", "bank": "B", "statement_type": "x", "format": "delimited", "fingerprint": {"header_contains_all": ["Date", "Amount"]}, "min_score": 2, "columns": {"date": {"source": "Date", "format": "%Y-%m-%d"}, "description": {"source": "Memo"}, "amount": {"source": "Amount"}}}


def test_templates_are_saved_hidden_and_deleted(tmp_path):
    folder = str(tmp_path)
    library.save(folder, {**GOOD, "origin": "user"})
    assert templates.load(folder, "user")["mine"]["bank"] == "B"
    library.hide(folder, "mine")
    assert templates.merge({}, templates.load(folder, "user")) == {}
    library.hide(folder, "mine", False)
    assert list(templates.merge({}, templates.load(folder, "user"))) == ["mine"]
    assert library.delete(folder, "mine") and not library.delete(folder, "mine")
    for bad in ({**GOOD, "id": "../x"}, {**GOOD, "columns": {}}):
        with pytest.raises(ValueError):
            library.save(folder, bad)


def test_phrases_are_added_and_comments_stay(tmp_path):
    path = tmp_path / "words.yaml"
    path.write_text("# ours\ndebit_markers:  # money out\n  - D\n  # a remark\n  - DR\nflow: [a, b]  # short\nlabels:\n  opening:\n    - opening balance\n  closing:\n    - closing balance\n")
    assert library.append_phrase(str(path), "debit_markers", "PAID") and not library.append_phrase(str(path), "debit_markers", "paid")
    assert library.append_phrase(str(path), "flow", "c") and library.append_phrase(str(path), "labels", "start balance", under="opening") and library.append_phrase(str(path), "fresh", "x")
    text = path.read_text()
    assert yaml.safe_load(text) == {"debit_markers": ["D", "DR", "PAID"], "flow": ["a", "b", "c"], "labels": {"opening": ["opening balance", "start balance"], "closing": ["closing balance"]}, "fresh": ["x"]}
    assert all(c in text for c in ("# ours", "# money out", "# a remark", "# short"))
    for key, phrase in (("bad key", "x"), ("flow", 'a"b'), ("flow", "a\nb")):
        with pytest.raises(ValueError):
            library.append_phrase(str(path), key, phrase)


def test_fingerprints_name_no_person():
    page = ["Sample Bank Everyday Account", "Jane Q Public", "12 Some Street", "Date Description Withdrawals Deposits Balance", "01/02/2024 Shop 5.00"]
    assert draft.header_phrases(page) == ["Sample Bank Everyday Account", "Date Description Withdrawals Deposits Balance", "Date"]
    assert draft.header_phrases([]) == []
