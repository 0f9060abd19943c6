"""Drafting of templates from a sample: delimiter, columns, dates, amount style, and bands of positioned words."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions import money
from ..functions.text import is_blank
from ..sources import delimited
from . import bands, profile


def guess_mapping(headers: list[str]) -> dict[str, str]:
    """Fields by the names of columns; each column serves one field."""
    out: dict[str, str] = {}
    for field, pattern in vocab.lexicon()["field_name_patterns"].items():
        hit = next((h for h in headers if h not in out.values() and re.search(pattern, h, re.I)), None)
        if hit:
            out[field] = hit
    return out


def amount_style(mapping: dict[str, str], suffixed: bool, negative: bool, tokens: list[str]) -> str:
    """The amount style that the columns and their values point to."""
    if "debit" in mapping and "credit" in mapping:
        return "debit_credit_cols"
    if suffixed:
        return "dr_cr_suffix"
    known = {*vocab.lexicon()["debit_markers"], *vocab.lexicon()["credit_markers"]}
    if "type" in mapping and tokens and set(tokens) <= known and not negative:
        return "type_dc"
    return "signed"


def type_tokens(tokens: list[str]) -> tuple[str | None, str | None]:
    """Debit and credit token among a column's values."""
    pick = lambda names: next((t for t in tokens if t.upper() in names), None)
    return pick(vocab.lexicon()["debit_markers"]), pick(vocab.lexicon()["credit_markers"])


def currency(cells: DataFrame, value: str = "value") -> str:
    """The currency that a sample's amounts name, else NZD."""
    marks = {"$": "NZD", "€": "EUR", "£": "GBP", "¥": "JPY"}
    found = cells.select(F.explode(F.regexp_extract_all(value, F.lit(r"\b([A-Z]{3})\b|([€£¥])"), F.lit(0))).alias("m")).groupBy("m").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "m").first()
    return marks.get(found["m"], found["m"]) if found else "NZD"


def bank_name(lines: list[str]) -> str | None:
    """The bank that a page's head names."""
    for line in lines[: max(3, len(lines) // 4)]:
        hit = re.search(r"\b([A-Z][A-Za-z&]*(?:\s+[A-Z][A-Za-z&]*){0,3}\s+(?:Bank|Banking|Credit Union|Building Society))\b|\b([A-Z]{3,6})\s+(?:Bank|Limited|Ltd)\b", line)
        if hit:
            return (hit[1] or hit[2]).strip()
    return None


def draft_delimited(lines: DataFrame, name: str) -> dict:
    """A template for a sample of delimited lines. The sample is one file; only its aggregates come to the driver."""
    head = delimited.header_line(lines).select("header", delimited.sniff_delimiter(F.col("header")).alias("d")).first()
    delimiter = head["d"]
    headers = [h.strip().strip('"') for h in head["header"].split(delimiter)]
    mapping = guess_mapping(headers)
    records = delimited.read(lines, headers, [delimiter])
    cells = records.select(*(F.try_element_at("cells", F.lit(h)).alias(f"c{i}") for i, h in enumerate(headers)))
    at = {f: f"c{headers.index(h)}" for f, h in mapping.items()}
    facts = cells.agg(
        profile.detect_date_format(F.col(at["date"])).alias("fmt") if "date" in at else F.lit(None).alias("fmt"),
        F.bool_or(F.col(at["amount"]).rlike(r"(?i)(DR|CR)\s*$")).alias("suffix") if "amount" in at else F.lit(False).alias("suffix"),
        F.bool_or(money.number(F.col(at["amount"])) < 0).alias("negative") if "amount" in at else F.lit(False).alias("negative"),
        F.array_sort(F.collect_set(F.when(~is_blank(F.col(at["type"])), F.upper(F.trim(at["type"]))))).alias("tokens") if "type" in at else F.array().alias("tokens"),
    ).first()
    tokens = list(facts["tokens"] or []) if len(facts["tokens"] or []) <= 12 else []
    style = amount_style(mapping, bool(facts["suffix"]), bool(facts["negative"]), tokens)
    debit, credit = type_tokens(tokens)
    columns = {f: {"source": h} for f, h in mapping.items()}
    if "date" in columns:
        columns["date"]["format"] = facts["fmt"] or "%d/%m/%Y"
    out = {"id": name, "bank": "", "statement_type": "everyday", "format": "delimited", "version": 1, "draft": True, "min_score": max(1, len(headers) - 1), "fingerprint": {"header_contains_all": headers}, "delimiter": delimiter, "columns": columns, "amount_sign": style, "currency": "NZD"}
    if style == "type_dc":
        out |= {"type_debit_value": debit, "type_credit_value": credit}
    return out


def suggest_bands(words: DataFrame, statement_id: str | None = None) -> dict[str, dict]:
    """Bands of a sample statement (the first by id unless named) as a template holds them; those of every layout of many
    statements are `bands.suggested`."""
    if statement_id is None:
        statement_id = words.agg(F.min("statement_id").alias("s")).first()["s"]
    own = words.where(F.col("statement_id") == statement_id).withColumn("layout", F.lit("sample"))
    return bands.template_columns(bands.suggested(own), "sample")


def header_phrases(lines: list[str], n: int = 3) -> list[str]:
    """Up to n phrases of a sample page for a fingerprint: its branded heading, the table's header line, then single
    column names. Lines with figures, and those that may name a person, are not offered."""
    lines = [re.sub(r"\s+", " ", x).strip() for x in lines]
    lines = [x for x in lines if x]
    keys, brands = set(vocab.lexicon()["header_keywords"]), vocab.lexicon()["fingerprint_brand_words"]
    words = lambda x: re.findall("[A-Za-z]+", x)
    branded = lambda x: any(b in x.lower() for b in brands)

    def person(x: str) -> bool:
        """Two to four capitalised words or a title, and nothing that a bank would print."""
        return not branded(x) and bool(re.fullmatch(r"(?:(?:Mr|Mrs|Ms|Miss|Dr)\.? )?(?:[A-Z][a-z]+|[A-Z]+)(?: (?:[A-Z][a-z]+|[A-Z]+|[A-Z]\.?)){1,3}", x))

    heads = [x for x in lines[:15] if 10 <= len(x) <= 60 and len(words(x)) >= 2 and not re.search("[0-9]", x) and sum(w.lower() in keys for w in words(x)) < 0.5 * len(words(x)) and not person(x)]
    heads = [x for x in heads if branded(x)] + [x for x in heads if not branded(x)]
    counts = [len({w.lower() for w in words(x)} & keys) for x in lines]
    best = lines[counts.index(max(counts))] if counts and max(counts) else ""
    out = [*heads[:2], *([best] if best and max(counts) >= 2 and len(best) <= 60 else []), *(w for w in words(best) if w.lower() in keys)]
    return list(dict.fromkeys(out))[:n]
