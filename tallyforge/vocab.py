"""Vocabularies: built-in defaults, merged with a site's own lists.

Operators compile their expressions from the vocabulary in effect: the built-in one, or within `using` a site's own. An
explicit argument of an operator goes before both.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

import yaml

# The built-in vocabularies.
DEFAULTS: dict[str, object] = {
    "debit_markers": ["D", "DR", "DEBIT", "W", "WD", "WITHDRAWAL", "OUT"],
    "credit_markers": ["C", "CR", "CREDIT", "DEP", "DEPOSIT", "IN"],
    "amount_style_debit_headers": ["debit", "withdrawal", "money out", "paid out"],
    "amount_style_credit_headers": ["credit", "deposit", "money in", "paid in"],
    "dr_cr_suffix_debit": ["DR"],
    "dr_cr_suffix_credit": ["CR"],
    "overdrawn_markers": ["OD"],
    "period_connectives": ["to", "through", "thru", "until"],
    "redaction_markers": [r"\[REDACTED\]", r"\bREDACTED\b", "X{6,}", "#{6,}"],
    "redaction_block_glyphs": ["█", "▓", "▒", "░", "■", "▬", "▮", "▀", "▄", "▇", "▆", "▅"],
    "header_keywords": [
        "date", "balance", "amount", "withdrawal", "withdrawals", "deposit", "deposits", "debit", "credit", "description", "details",
        "transaction", "transactions", "particulars", "reference", "code", "type", "payment", "payments", "memo", "narrative",
        "opening", "closing", "fee", "fees", "interest",
    ],
    "layout_stopwords": [
        "the", "and", "for", "you", "your", "from", "with", "this", "that", "are", "was", "been", "will", "have", "has", "not", "all",
        "any", "per", "our", "their", "them", "these", "those", "which", "into", "only",
    ],
    "summary_line_labels": [
        "(statement )?(opening|closing) balance",
        "balance (brought|carried) (forward|fwd|f/?wd?)",
        "balance [bc]/f",
        "(brought|carried) forward",
        "total (withdrawals|deposits|credits|debits|payments|fees|transactions)",
        "totals?",
        r"(sub|grand|page|period|statement|account|running)[-]?\s*totals?",
        "totals? (at|for|of|on|to)( the)?( end of)?( the)? (page|period|statement|month|year|day|section|account)",
        "totals? (this|the) (page|period|statement|month|year|day|section|account)",
    ],
    # an amount has decimals or a currency sign: a year, a page or a count alone is none
    "money_regex": (
        r"(?i)\(?[-−–]?[$]?[-−–]?[0-9][0-9,.]*(?:\.[0-9]{2}|,[0-9]{2})(?![0-9])\)?[-−–]?(?:\s?(?:DR|CR|OD)\b)?"
        r"|\(?[-−–]?[$][-−–]?[0-9][0-9,]*(?![0-9.,])\)?[-−–]?(?:\s?(?:DR|CR|OD)\b)?"
    ),
    "date_regex": r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b|[0-9]{1,2}[/ .-][A-Za-z0-9]{2,9}[/ .-][0-9]{2,4}",
    "fingerprint_brand_words": ["bank", "banking", "card", "credit", "visa", "mastercard", "account", "statement", "savings", "everyday", "platinum", "rewards"],
    "account_regex": r"\b[0-9]{2}-[0-9]{4}-[0-9]{6,7}-[0-9]{2,3}\b",
    "card_regex": r"\b[0-9]{4}[- ]?[0-9X*]{4}[- ]?[0-9X*]{4}[- ]?[0-9]{4}\b",
    "field_name_patterns": {
        "date": r"date|\bday\b", "debit": r"debit|withdraw|money out|paid out", "credit": r"credit|deposit|money in|paid in", "amount": r"amount|value|^money$|^sum$",
        "balance": r"balance|^running$", "description": r"payee|description|details|memo|narrative|narration", "particulars": r"particulars", "code": r"^code$|analysis",
        "reference": r"reference|unique", "other_party": r"other party|counterparty", "type": r"type",
    },
    # formats that are tried after the built-in ones
    "date_formats": [],
}

#: Synonyms of the facts that a statement prints, the kind of value, and where it stands.
LABELS: dict[str, dict] = {
    "opening_balance": {"any_of": ["opening balance", "balance brought forward", "previous balance"], "value": "money"},
    "closing_balance": {"any_of": ["closing balance", "balance carried forward", "ending balance"], "value": "money"},
    "account_number": {"any_of": ["account number", "account no", "card number"], "value": "text"},
    "account_name": {"any_of": ["account name", "account holder"], "value": "text"},
    "period": {"any_of": ["statement period", "period from", "period"], "value": "date_range"},
    "statement_date": {"any_of": ["statement date", "date of statement"], "value": "date"},
    "stated_count": {"any_of": ["number of transactions", "transaction count"], "value": "count"},
}


def kind(name: str) -> str:
    """How a category merges: list (union), regex (replaced), map (own keys win)."""
    value = DEFAULTS[name]
    return "list" if isinstance(value, list) else "map" if isinstance(value, dict) else "regex"


def merged(own: dict | None = None) -> dict:
    """The defaults under a site's own vocabulary. A regex that doesn't compile leaves the default."""
    out = dict(DEFAULTS)
    for name, value in (own or {}).items():
        if name not in DEFAULTS or value is None:
            continue
        if kind(name) == "list":
            extra = [value] if isinstance(value, str) else list(value)
            out[name] = list(dict.fromkeys([*DEFAULTS[name], *map(str, extra)]))
        elif kind(name) == "map" and isinstance(value, dict):
            out[name] = {**DEFAULTS[name], **value}
        elif isinstance(value, str):
            try:
                re.compile(value)
                out[name] = value
            except re.error:
                pass
    return out


def merged_labels(own: dict | None = None) -> dict[str, dict]:
    """The label dictionary under a site's own: its synonyms come after the built-in ones, what else it says goes before them,
    and labels of its own are added."""
    out = {k: dict(v) for k, v in LABELS.items()}
    for name, spec in (own or {}).items():
        spec = {"any_of": spec} if isinstance(spec, list) else dict(spec or {})
        base = out.get(name, {"any_of": [], "value": "text"})
        extra = [str(t).strip() for t in spec.pop("any_of", None) or []]
        out[name] = {**base, **spec, "any_of": list(dict.fromkeys([*base["any_of"], *(t for t in extra if t)]))}
    return {k: v for k, v in out.items() if v["any_of"]}


_NOW: ContextVar[tuple[dict, dict]] = ContextVar("vocabulary", default=(DEFAULTS, LABELS))


def lexicon() -> dict:
    """The vocabulary in effect."""
    return _NOW.get()[0]


def label_dictionary() -> dict[str, dict]:
    """The labels in effect."""
    return _NOW.get()[1]


@contextmanager
def using(own: dict | None = None, own_labels: dict | None = None) -> Iterator[None]:
    """A site's vocabulary and labels for all expressions that are built inside."""
    token = _NOW.set((merged(own), merged_labels(own_labels)))
    try:
        yield
    finally:
        _NOW.reset(token)


def load(path: str | None) -> dict:
    """A site's file of word lists or labels; none is empty. One that is no map of categories is an error."""
    found = (yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}) if path else {}
    if not isinstance(found, dict):
        raise ValueError(f"{path}: a map of categories is needed")
    return found


def problems(own: dict) -> list[str]:
    """What is wrong with a site's vocabulary."""
    found = []
    for name, value in own.items():
        if name not in DEFAULTS:
            found.append(f"{name}: unknown category")
        elif kind(name) == "list" and not isinstance(value, (list, str)):
            found.append(f"{name}: a list of phrases is needed")
        elif kind(name) == "map" and not isinstance(value, dict):
            found.append(f"{name}: a map is needed")
        elif kind(name) == "regex":
            try:
                re.compile(value)
            except (re.error, TypeError):
                found.append(f"{name}: not a regular expression")
    return found
