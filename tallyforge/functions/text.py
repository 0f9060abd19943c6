"""Text functions over columns. All are built-in expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab


def trim_ws(x: Column) -> Column:
    """Outer spaces, tabs and line ends go; what is inside stays verbatim."""
    return F.regexp_replace(x, r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def is_blank(x: Column) -> Column:
    return F.coalesce(trim_ws(x) == "", F.lit(True))


def blank_to_null(x: Column) -> Column:
    """Null for a blank cell, else the cell as it is."""
    return F.when(~is_blank(x), x)


def clean_description(x: Column) -> Column:
    return trim_ws(x)


def fold_ws(x: Column) -> Column:
    """Runs of horizontal white space become one space; line ends stay, without spaces around them."""
    x = F.regexp_replace(x, " ", " ")
    x = F.regexp_replace(x, r"[ \t\r\f\x0B]+", " ")
    x = F.regexp_replace(x, r" *\n *", "\n")
    return F.regexp_replace(x, r"^[ \n]+|[ \n]+$", "")


def has_phrase(text: Column, phrase: Column | str) -> Column:
    return F.instr(text, phrase) > 0 if isinstance(phrase, str) else F.position(phrase, text) > 0


def block_run(glyphs: Sequence[str] | None = None) -> str:
    """The pattern of a run of glyphs that blot a text out."""
    return "[" + "".join(glyphs or vocab.lexicon()["redaction_block_glyphs"]) + "]+"


def is_redacted(x: Column) -> Column:
    """Whether a cell says that it was hidden, in words or by block glyphs."""
    return F.coalesce(F.upper(x).contains("REDACTED") | x.rlike(block_run()), F.lit(False))


def matches_marker(x: Column, markers: Sequence[str] | None = None, glyphs: Sequence[str] | None = None) -> Column:
    return F.coalesce(x.rlike("|".join([*(markers or vocab.lexicon()["redaction_markers"]), block_run(glyphs)])), F.lit(False))


def has_redaction_evidence(line: Column, lexicon: dict | None = None) -> Column:
    """Whether a line still shows a date or an amount: only such a line can be a transaction whose cells were blotted out."""
    lexicon = lexicon or vocab.lexicon()
    return F.coalesce(line.rlike(lexicon["date_regex"]) | line.rlike(lexicon["money_regex"]), F.lit(False))


def flags(*named: tuple[str, Column]) -> Column:
    """The names whose condition holds, in order."""
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in named)))


def join_flags(x: Column) -> Column:
    return F.coalesce(F.array_join(x, ","), F.lit(""))


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def safe_name(x: Column) -> Column:
    return F.regexp_replace(x, r"[^A-Za-z0-9._-]+", "_")


def line_span(lines: Column) -> Column:
    """csv:line=5, csv:line=5-6 or csv:line=5,8 for the lines of a record."""
    first, last, n = F.get(lines, F.lit(0)), F.element_at(lines, -1), F.size(lines)
    several = F.when(last - first + 1 == n, F.concat_ws("-", first.cast("string"), last.cast("string"))).otherwise(F.array_join(lines.cast("array<string>"), ","))
    return F.when(n > 0, F.concat(F.lit("csv:line="), F.when(n == 1, first.cast("string")).otherwise(several)))


def fingerprint_phrases(x: Column) -> Column:
    """The lines of a text as phrases: trimmed, without blanks and repeats, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(x, r"\r\n|\r|\n"), trim_ws), lambda p: p != ""))


def status_message(status: Column, why: Column, needs: Column | None = None) -> Column:
    rest = F.concat_ws("; ", why, needs) if needs is not None else why
    return F.concat_ws(": ", status, rest)


def mask_value(x: Column) -> Column:
    """The shape of a cell: digits as 9, letters and anything unusual as A."""
    x = F.regexp_replace(x, "[0-9]", "9")
    x = F.regexp_replace(x, "[A-Za-z]", "A")
    return F.regexp_replace(x, r"[^0-9A-Za-z ./,:()$+-]", "A")


def mask_text(x: Column, token: str = "[REDACTED]") -> Column:
    """Letters and digits by class; redaction marks become one token."""
    out = F.regexp_replace(x, r"\p{Ll}", "x")
    out = F.regexp_replace(out, r"[\p{Lu}\p{Lt}\p{Lo}\p{Lm}]", "X")
    out = F.regexp_replace(out, r"\p{N}", "9")
    return F.when(is_redacted(x), F.lit(token)).otherwise(out)


def garbage_ratio(x: Column) -> Column:
    """Share of a text's visible characters that a broken text layer gives."""
    seen = F.regexp_replace(x, r"\s", "")
    bad = F.length(seen) - F.length(F.regexp_replace(seen, "[�\\x00-\\x08\\x0E-\\x1F\\x7F-\\x9F-]", ""))
    return F.when(F.length(seen) > 0, bad / F.length(seen)).otherwise(F.lit(0.0))


def neutralise(x: Column) -> Column:
    """A cell that a spreadsheet would take for a formula gets an apostrophe."""
    return F.when(x.rlike(r"^[=+@\t\r]"), F.concat(F.lit("'"), x)).otherwise(x)


def line_label(x: Column) -> Column:
    """A line's label: lower case, without the dates before it and the amounts after it."""
    months = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
    lead = rf"^(?:\s*(?:[0-9][0-9,./:-]*|(?:{months}|mon|tue|wed|thu|fri|sat|sun)(?:day)?\b))+"
    token = r"(?:[$(]?[0-9][0-9,./:-]*[0-9)]?|dr|cr|od)\b\)?"
    trail = rf"(?:^|(?<=\s)){token}(?:\s+{token})*\s*$"
    out = F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), lead, " ")
    out = F.regexp_replace(out, trail, " ")
    return F.regexp_replace(out, r"^\s+|[\s:-]+$", "")


def is_summary_line(x: Column, labels: Sequence[str] | None = None) -> Column:
    """Whether the whole label is a total, an opening or closing balance, or carried forward."""
    return line_label(x).rlike("^(?:" + "|".join(p.replace(" ", r"\s+") for p in labels or vocab.lexicon()["summary_line_labels"]) + ")$")


def is_footer(x: Column) -> Column:
    return F.lower(trim_ws(F.coalesce(x, F.lit("")))).rlike(
        r"^page\s+\d+(\s+of\s+\d+)?$|^\d+\s+of\s+\d+$|continued\s+(on\s+)?(next|over)|^statement\s+(continued|continues)"
        r"|(carried|brought)\s+forward\s+(to|from)\s+(the\s+)?(next|previous|following|preceding|last)\b"
    )


def set_hash(x: Column, size: int = 16, glue: str = "|") -> Column:
    """A short digest of a set of strings."""
    return F.substring(F.sha2(F.array_join(F.array_sort(F.array_distinct(x)), glue), 256), 1, size)


def header_tokens(header: Column) -> Column:
    cells = F.transform(F.split(F.lower(header), r"[,\t;|]"), lambda c: F.regexp_replace(F.regexp_replace(c, '"', ""), r"^\s+|\s+$", ""))
    return F.array_sort(F.array_distinct(F.filter(cells, lambda c: c != "")))


def layout_signature(tokens: Column) -> Column:
    """signature (12 characters) and hint (the first ten tokens) of a layout."""
    filled = F.size(tokens) > 0
    return F.struct(
        F.when(filled, F.substring(F.sha2(F.array_join(tokens, "\u0001"), 256), 1, 12)).otherwise("empty").alias("signature"),
        F.when(filled, F.array_join(F.slice(tokens, 1, 10), " | ")).otherwise("").alias("hint"),
    )


def text_after(line: Column, term: Column, signed: bool = False) -> Column:
    """What follows a label on its line, without the separators between; a minus before a figure stays if `signed`."""
    at = F.position(F.lower(term), F.lower(line))
    rest = F.when(at > 0, line.substr(at + F.length(term), F.length(line)))
    return F.regexp_replace(rest, r"^(?:[\s:=]|-(?![0-9$.(]))+|\s+$" if signed else r"^[\s:=\-]+|\s+$", "")


def all_matches(x: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(x, F.lit(pattern), F.lit(0)))


def append_cell(now: Column, more: Column) -> Column:
    """A wrapped cell's text added to what is there."""
    filled = lambda c: F.nullif(trim_ws(c), F.lit(""))
    return F.concat_ws(" ", filled(now), filled(more))
