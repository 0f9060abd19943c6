"""Money: parsing of printed amounts and the five amount styles, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab
from .text import trim_ws

STYLES = ("signed", "debit_credit_cols", "dr_cr_suffix", "type_dc", "unsigned")


def _ends(words: list[str]) -> str:
    return "(" + "|".join(w.upper() for w in words) + r")\s*$"


def number(x: Column, decimal: str = "auto", lexicon: dict | None = None) -> Column:
    """A printed amount as a double; null where it can't be read with certainty.

    A trailing debit marker, brackets or any minus make it negative. With `auto` the last separator is the decimal mark;
    a lone comma is one only before one or two last digits.
    """
    lexicon = lexicon or vocab.lexicon()
    raw = trim_ws(x.cast("string"))
    debit = F.upper(raw).rlike(_ends([*lexicon["dr_cr_suffix_debit"], *lexicon["overdrawn_markers"]]))
    kept = F.regexp_replace(raw, "[^0-9.,()+-]", "")
    negative = debit | (kept.contains("(") & kept.contains(")")) | kept.contains("-")
    bare = F.regexp_replace(kept, "[()+-]", "")
    dot = F.regexp_replace(bare, ",", "")
    comma = F.regexp_replace(F.regexp_replace(bare, r"\.", ""), "^([^,]*),([^,]*)$", "$1.$2")
    if decimal == "dot":
        text = dot
    elif decimal == "comma":
        text = comma
    else:
        last = F.regexp_extract(bare, r"([.,])[^.,]*$", 1)
        short = bare.rlike(r"^[^,.]*,[0-9]{1,2}$")
        text = F.when(bare.contains(".") & bare.contains(","), F.when(last == ",", comma).otherwise(dot)).when(bare.contains(","), F.when(short, comma).otherwise(dot)).otherwise(bare)
    value = F.when(text.rlike(r"^([0-9]+\.?[0-9]*|\.[0-9]+)$"), text.try_cast("double"))
    return F.when(negative, -F.abs(value)).otherwise(value)


def direction(value: Column) -> Column:
    return F.when(value < 0, "debit").when(value > 0, "credit")


def signed(x: Column, decimal: str = "auto") -> Column:
    return number(x, decimal)


def debit_credit(debit: Column, credit: Column, decimal: str = "auto") -> Column:
    """Credit less the size of debit; null only if both are unreadable."""
    d, c = number(debit, decimal), number(credit, decimal)
    return F.when(d.isNotNull() | c.isNotNull(), F.coalesce(c, F.lit(0.0)) - F.abs(F.coalesce(d, F.lit(0.0))))


def debit_credit_raw(debit: Column, credit: Column, decimal: str = "auto") -> Column:
    d, c = number(debit, decimal), number(credit, decimal)
    both = F.concat(F.coalesce(debit, F.lit("")), F.lit("|"), F.coalesce(credit, F.lit("")))
    return F.when(F.coalesce(c != 0, F.lit(False)), credit).when(F.coalesce(d != 0, F.lit(False)), debit).otherwise(both)


def suffixed(x: Column, decimal: str = "auto", lexicon: dict | None = None) -> Column:
    """An amount whose sign is the marker behind it; without a known marker it is null."""
    lexicon = lexicon or vocab.lexicon()
    debit, credit = lexicon["dr_cr_suffix_debit"], lexicon["dr_cr_suffix_credit"]
    raw = trim_ws(x)
    mark = F.upper(F.regexp_extract(raw, r"([A-Za-z]{2})\s*$", 1))
    size = F.abs(number(F.regexp_replace(raw, r"(?i)\s*(" + "|".join([*debit, *credit]) + r")\s*$", ""), decimal))
    return F.when(mark.isin(*(w.upper() for w in debit)), -size).when(mark.isin(*(w.upper() for w in credit)), size)


def unsigned(x: Column, default: str = "debit", decimal: str = "auto", lexicon: dict | None = None) -> Column:
    """An amount without a sign: the template says which way it counts, a credit marker turns it round."""
    base = 1.0 if default == "credit" else -1.0
    turned = F.upper(trim_ws(x)).rlike(_ends((lexicon or vocab.lexicon())["dr_cr_suffix_credit"]))
    return F.abs(number(x, decimal)) * F.when(turned, -base).otherwise(base)


def typed(x: Column, kind: Column, debit: str = "D", credit: str | None = None, decimal: str = "auto") -> Column:
    """An amount whose sign is another column's token; with both tokens known an unknown one is null."""
    size, token = F.abs(number(x, decimal)), F.upper(trim_ws(kind))
    is_debit = F.coalesce((token != "") & (token == debit.strip().upper()), F.lit(False))
    if credit and credit.strip():
        return F.when(is_debit, -size).when(token == credit.strip().upper(), size)
    return F.when(is_debit, -size).otherwise(size)


def amount(style: str, x: Column | None = None, debit: Column | None = None, credit: Column | None = None, kind: Column | None = None, debit_value: str = "D", credit_value: str | None = None, default: str = "debit", decimal: str = "auto") -> Column:
    """The value of an amount in one of the styles."""
    none = F.lit(None).cast("string")
    if style == "signed":
        return signed(x if x is not None else none, decimal)
    if style == "debit_credit_cols":
        return debit_credit(debit if debit is not None else none, credit if credit is not None else none, decimal)
    if style == "dr_cr_suffix":
        return suffixed(x if x is not None else none, decimal)
    if style == "unsigned":
        return unsigned(x if x is not None else none, default, decimal)
    if style == "type_dc":
        return typed(x if x is not None else none, kind if kind is not None else none, debit_value, credit_value, decimal)
    raise ValueError(f"unknown amount style {style!r}")


def looks_money(x: Column) -> Column:
    up = F.upper(trim_ws(x))
    core = F.regexp_replace(F.regexp_replace(F.regexp_replace(up, r"(DR|CR|OD)\s*$", ""), "[^0-9.,()+ -]", ""), r"\s", "")
    return up.rlike("[0-9]") & core.rlike(r"^[(+-]?[0-9][0-9.,]*[0-9]?[)]?$")


def magnitude(x: Column) -> Column:
    """Bucket of an amount's size: below 1, below 10, and so on to a million and more."""
    size, out = F.abs(x), F.when(F.abs(x) >= 1e6, "1000000+")
    for low, high in ((0, 1), (1, 10), (10, 100), (100, 1000), (1000, 10000), (10000, 100000), (100000, 1000000)):
        out = out.when((size >= low) & (size < high) & (size > 0), f"{low}-{high}")
    return out


def total(x: Column) -> Column:
    """A sum that doesn't depend on the order of rows."""
    return F.sum(x.cast("decimal(38,6)")).cast("double")


def shown(x: Column, symbol: str = "$") -> Column:
    """An amount for reading: thousands, two decimals, the sign before the symbol."""
    return F.concat(F.when(x < 0, "-").otherwise(""), F.lit(symbol), F.format_number(F.abs(x), 2))
