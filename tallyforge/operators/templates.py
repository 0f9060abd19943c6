"""Templates: layouts declared as data, checked on the driver and compiled into expressions."""

from __future__ import annotations

import re
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession

from ..functions.money import STYLES

FORMATS = ("delimited", "excel", "pdf")
FIELDS = ("date", "description", "amount", "debit", "credit", "balance", "particulars", "code", "reference", "other_party", "type")
DATE_PARTS = re.compile(r"%[dmYybB]")


def source(template: dict, field: str, group: str = "columns") -> str | None:
    """The column that a field is read from."""
    spec = (template.get(group) or {}).get(field)
    return spec.get("source") if isinstance(spec, dict) else None if spec is None else str(spec)


def date_formats(template: dict) -> list[str]:
    spec = (template.get("columns") or {}).get("date")
    found = spec.get("format") if isinstance(spec, dict) else None
    return [found] if isinstance(found, str) else list(found or ["%Y-%m-%d"])


def delimiters(template: dict) -> list[str]:
    found = template.get("delimiter") or ","
    return [found] if isinstance(found, str) else list(found)


def resolve_column(columns: list[str], name: str | None) -> str | None:
    """The column of that name, failing that the only one that differs in case alone."""
    if name is None:
        return None
    if name in columns:
        return name
    near = [c for c in columns if c.lower() == name.lower()]
    return near[0] if len(near) == 1 else None


def problems(template: dict) -> list[str]:
    """What is wrong with a template; empty if it can be used."""
    found = [f"missing {k}" for k in ("id", "bank", "statement_type", "format") if not template.get(k)]
    kind = template.get("format", "delimited")
    if kind not in FORMATS:
        return [*found, f"unknown format {kind!r}"]
    body = template.get("table") or {} if kind == "pdf" else template
    style = body.get("amount_sign") or template.get("amount_sign") or "signed"
    columns = body.get("columns") or {}
    if style not in STYLES:
        found.append(f"unknown amount style {style!r}")
    need = ["date", "description", *(["debit", "credit"] if style == "debit_credit_cols" else ["amount"]), *(["type"] if style == "type_dc" else [])]
    found += [f"no column for {f}" for f in need if not columns.get(f)]
    if style == "type_dc" and not (template.get("type_debit_value") or body.get("type_debit_value")):
        found.append("type_dc needs type_debit_value")
    marks = (template.get("fingerprint") or {}).get("page_contains_all" if kind == "pdf" else "header_contains_all") or []
    if not marks:
        found.append("the fingerprint is empty")
    if template.get("min_score", 1) > len(marks):
        found.append("min_score is more than the fingerprint can give")
    if len({str(m).lower() for m in marks}) < len(marks):
        found.append("the fingerprint repeats itself")
    formats = [body.get("date_format", "%d/%m/%Y")] if kind == "pdf" else date_formats(template)
    found += [f"date format {f!r} has no day or month" for f in formats if not DATE_PARTS.search(f)]
    if kind == "pdf":
        found += [f"band of {f} is empty" for f, b in columns.items() if b and not float(b.get("x_min", 0)) < float(b.get("x_max", 0))]
    else:
        found += ["an empty delimiter"] * any(not d for d in delimiters(template))
        rx = (template.get("preamble") or {}).get("header_regex")
        try:
            re.compile(rx or "")
        except re.error:
            found.append("header_regex is not a regular expression")
    return found


def load(folder: str, origin: str = "default", strict: bool = True) -> dict[str, dict]:
    """The YAML templates of a folder. Strict: a bad one is an error; else it is kept with its problems."""
    out = {}
    for path in sorted(Path(folder).glob("*.y*ml")):
        template = yaml.safe_load(path.read_text(encoding="utf-8")) or {}
        wrong = problems(template)
        if template.get("draft") and strict:
            wrong.append("a draft")
        if wrong and strict:
            raise ValueError(f"{path.name}: {'; '.join(wrong)}")
        out[template.get("id", path.stem)] = {**template, "origin": origin, "errors": wrong}
    return out


def load_forms(folder: str) -> dict[str, dict]:
    """The form templates of a folder: YAML with `mode: fields`, phrases that must stand in the text, and fields."""
    out = {}
    for path in sorted(Path(folder).glob("*.y*ml")):
        form = yaml.safe_load(path.read_text(encoding="utf-8")) or {}
        if form.get("mode") == "fields" and form.get("fields") and (form.get("fingerprint") or {}).get("page_contains_all"):
            out[str(form.get("id", path.stem))] = form
    return out


def merge(curated: dict[str, dict], own: dict[str, dict], hidden: bool = False) -> dict[str, dict]:
    """Curated templates and a site's own; a curated id wins, samples and drafts are left out."""
    both = {**own, **curated}
    return {k: t for k, t in both.items() if not t.get("sample") and not t.get("errors") and not t.get("draft") and (hidden or not t.get("hidden"))}


def own_only(own: DataFrame, curated: DataFrame, key: str = "template_id") -> DataFrame:
    """A site's own templates without those whose id is curated: the curated one wins."""
    return own.join(curated.select(key), key, "left_anti")


def shape(template: dict) -> str:
    """What a template reads, without its name: two with the same shape are duplicates."""
    marks = (template.get("fingerprint") or {}).get("header_contains_all") or (template.get("fingerprint") or {}).get("page_contains_all") or []
    return "|".join([template.get("format", ""), ",".join(sorted(str(m).lower() for m in marks)), template.get("amount_sign", "signed")])


def frame(spark: SparkSession, templates: dict[str, dict]) -> DataFrame:
    """Templates as rows for detection: a bounded, driver-side set."""
    rows = []
    for k, t in templates.items():
        fp = t.get("fingerprint") or {}
        base = 1 if t.get("origin", "default") != "user" else 0
        refined = templates.get(t.get("refines") or "")
        rank = (1 if refined.get("origin", "default") != "user" else 0) + 1 if refined else base
        rows.append((k, t.get("bank", ""), t.get("statement_type", ""), t.get("format", "delimited"), [str(x) for x in fp.get("header_contains_all") or []], [str(x) for x in fp.get("page_contains_all") or []], fp.get("filename_regex"), (t.get("preamble") or {}).get("header_regex"), delimiters(t), float(t.get("min_score", 1)), rank, shape(t)))
    return spark.createDataFrame(rows, "template_id string, bank string, statement_type string, format string, header_marks array<string>, page_marks array<string>, filename_regex string, header_regex string, delimiters array<string>, min_score double, origin_rank int, shape string")
