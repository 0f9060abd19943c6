"""Labelled facts: synonyms against lines, and the typed value that stands beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions.text import text_after, trim_ws
from ..storage import stored
from ..vocab import DEFAULTS  # noqa: F401

#: A date of digits and dots has the shape of an amount and is none.
DOTTED_DATE = r"(?<![0-9.,])[0-9]{1,2}\.[0-9]{1,2}\.(?:[0-9]{4}|[0-9]{2})(?![0-9]|[.,][0-9])"
FIRST_PAGE = r"(?i)\bpage\s+1\b(\s+of\s+\d+)?"


def value_in(line: Column, kind: str, lexicon: dict | None = None) -> Column:
    """A line's typed value: the last amount, the first date, the first two dates, a count, the text, or a pattern's match."""
    lexicon = lexicon or vocab.lexicon()
    none = lambda c: F.nullif(c, F.lit(""))
    if kind == "money":
        line = F.regexp_replace(line, DOTTED_DATE, " ")
        return none(F.try_element_at(F.regexp_extract_all(line, F.lit(lexicon["money_regex"]), F.lit(0)), F.lit(-1)))
    dates = F.regexp_extract_all(line, F.lit(lexicon["date_regex"]), F.lit(0))
    if kind == "date":
        return F.get(dates, F.lit(0))
    if kind == "date_range":
        return F.when(F.size(dates) >= 2, F.concat_ws("..", F.get(dates, F.lit(0)), F.get(dates, F.lit(1))))
    if kind == "count":
        return none(F.regexp_extract(line, r"([0-9]{1,6})\D*$", 1))
    if kind.startswith("regex:"):
        return none(F.regexp_extract(line, kind.removeprefix("regex:"), 0))
    return none(trim_ws(line))


def hits(lines: DataFrame, terms: list[str], kind: str = "text") -> DataFrame:
    """Lines (statement_id, page, line_no, text) that hold a term, with the value beside it and that of the next line.

    Terms are a vocabulary's literals: each line is matched against all of them in one projection. Lines as `labelled` gives
    them have their next line already.
    """
    rows = lines if "next_text" in lines.columns else _with_next(lines)
    found = F.filter(F.array(*map(F.lit, terms)), lambda t: F.position(F.lower(t), F.lower("text")) > 0)
    rows = rows.withColumn("__terms", found).where(F.size("__terms") > 0).select("*", F.posexplode("__terms").alias("term_no", "term")).drop("__terms")
    after = text_after(F.col("text"), F.col("term"), kind == "money")
    beside = F.nullif(after, F.lit("")) if kind == "text" else F.coalesce(value_in(after, kind), value_in(F.col("text"), kind))
    return rows.withColumns({"value": beside, "next_value": F.lit(None).cast("string") if kind == "text" else value_in(F.col("next_text"), kind)})


def _with_next(lines: DataFrame) -> DataFrame:
    return lines.withColumn("next_text", F.lead("text").over(Window.partitionBy("statement_id").orderBy("page", "line_no")))


def labelled(lines: DataFrame, dictionary: dict | None = None) -> DataFrame:
    """The lines that hold a term of any label, each with the text of the line after it (next_text).

    These few are all that `header_facts` asks of a document; stored, they spare each label a sort of all lines.
    """
    terms = list(dict.fromkeys(t for spec in (dictionary or vocab.label_dictionary()).values() for t in spec["any_of"]))
    held = F.exists(F.array(*map(F.lit, terms)), lambda t: F.position(F.lower(t), F.lower("text")) > 0)
    return _with_next(lines.select("statement_id", "page", "line_no", "text")).where(held)


def match(lines: DataFrame, spec: dict, occurrence: str = "first", scope: str = "any", on_conflict: str = "flag") -> DataFrame:
    """statement_id, value, matched, n, conflict and term for each statement that has the label.

    Values beside the label come first; only a statement with none of those takes values from the next line.
    """
    own = lines
    if scope == "page1":
        own = lines.where("page = 1")
    elif scope == "last":
        own = lines.withColumn("__last", F.max("page").over(Window.partitionBy("statement_id"))).where("page = __last").drop("__last")
    elif scope.isdigit():
        own = lines.where(F.col("page") == int(scope))
    rows = hits(own, list(spec["any_of"]), spec.get("value", "text"))
    any_beside = F.max(F.col("value").isNotNull()).over(Window.partitionBy("statement_id"))
    rows = rows.withColumn("__v", F.when(any_beside, F.col("value")).otherwise(F.col("next_value")))
    at = F.when(F.col("__v").isNotNull(), F.struct("page", "line_no", "term_no"))
    last = occurrence == "last"
    first, final = F.min_by("__v", at), F.max_by("__v", at)
    conflict = F.count_distinct("__v") > 1
    value = F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("__v").isNotNull(), F.struct("page", "line_no", "term_no", "__v")))), lambda s: s["__v"])), "; ") if occurrence == "all" else final if last else F.when(conflict, final).otherwise(first) if on_conflict == "last" else first
    return rows.groupBy("statement_id").agg(value.alias("value"), F.lit(True).alias("matched"), F.count("__v").alias("n"), conflict.alias("conflict"), (F.max_by("term", at) if last else F.min_by("term", at)).alias("term"))


def header_facts(lines: DataFrame, dictionary: dict | None = None) -> DataFrame:
    """The facts that statements print, one column per label of the dictionary."""
    out, own = lines.select("statement_id").distinct(), stored(labelled(lines, dictionary), "labelled")
    for name, spec in (dictionary or vocab.label_dictionary()).items():
        out = out.join(match(own, spec).select("statement_id", F.col("value").alias(name)), "statement_id", "left")
    return out


def form_fields(lines: DataFrame, fields: dict[str, dict]) -> DataFrame:
    """Key and value pairs of a form: statement_id, field, label, value, matched, required, flagged, conflict."""
    whole = None
    everyone = lines.select("statement_id").distinct()
    for name, spec in fields.items():
        own = everyone.join(match(lines, spec, spec.get("occurrence", "first"), str(spec.get("where", "any")), spec.get("on_conflict", "flag")), "statement_id", "left")
        need = bool(spec.get("required"))
        part = own.select("statement_id", F.lit(name).alias("field"), F.lit(spec.get("label", name)).alias("label"), "value", F.coalesce("matched", F.lit(False)).alias("matched"), F.lit(need).alias("required"), (F.lit(need) & F.col("value").isNull() | F.coalesce("conflict", F.lit(False))).alias("flagged"), F.coalesce("conflict", F.lit(False)).alias("conflict"))
        whole = part if whole is None else whole.unionByName(part)
    return whole


def field_specs(fields: dict, dictionary: dict | None = None) -> dict[str, dict]:
    """Fields of a form template as label specs: a text, or a map with `label`, is a synonym; a field named like a label of the
    dictionary has that label's synonyms after its own and its kind of value. A field without any is left out."""
    known, out = dictionary or vocab.label_dictionary(), {}
    for name, spec in (fields or {}).items():
        spec = {"any_of": [spec]} if isinstance(spec, str) else dict(spec or {})
        own = [spec["any_of"]] if isinstance(spec.get("any_of"), str) else list(spec.get("any_of") or [])
        if not own and spec.get("label"):
            own = [spec["label"]]
        base = known.get(name, {})
        terms = list(dict.fromkeys(str(t).strip() for t in [*own, *base.get("any_of", [])] if str(t).strip()))
        if terms:
            out[name] = {"value": base.get("value", "text"), **spec, "any_of": terms}
    return out


def detect_form(lines: DataFrame, forms: dict[str, list[str]]) -> DataFrame:
    """statement_id, form and matched: the form whose phrases all stand in the text, the one with the most phrases; with
    two as specific, none is chosen. `forms` is a bounded, driver-side set: its phrases are literals of one projection."""
    whole = lines.groupBy("statement_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "line_no", "text"))), lambda s: s["text"]), "\n").alias("t"))
    listed = [(k, list(dict.fromkeys(p))) for k, p in forms.items() if p]
    if not listed:
        return whole.select("statement_id", F.lit(None).cast("string").alias("form"), F.lit(False).alias("matched"))
    full = lambda phrases: F.forall(F.array(*map(F.lit, phrases)), lambda p: F.position(p, F.col("t")) > 0)
    found = F.array_sort(F.array_compact(F.array(*(F.when(full(p), F.struct(F.lit(-len(p)).alias("n"), F.lit(k).alias("form"))) for k, p in listed))))
    one, two = F.get("f", F.lit(0)), F.get("f", F.lit(1))
    return whole.select("statement_id", found.alias("f")).select("statement_id", one["form"].alias("form"), F.coalesce(one["n"] < two["n"], one.isNotNull()).alias("matched"))


def periods(rows: DataFrame, key: str = "statement_id") -> DataFrame:
    """Periods (key, start, end) in order with how each follows the last: first, contiguous, shared_day, gap or overlap."""
    order = Window.partitionBy(key).orderBy("start", "end")
    before = F.lag("end").over(order)
    verdict = F.when(before.isNull(), "first").when(F.col("start") == before, "shared_day").when(F.col("start") < before, "overlap").when(F.col("start") > F.date_add(before, 1), "gap").otherwise("contiguous")
    return rows.withColumn("follows", verdict)


def chained(rows: DataFrame, key: str = "statement_id", order_by: str = "seq") -> DataFrame:
    """Whether each closing balance is the next opening one."""
    order = Window.partitionBy(key).orderBy(order_by)
    ahead = F.lead("opening").over(order)
    ok = F.when(ahead.isNull(), None).otherwise(F.round(F.abs(F.col("closing") - ahead), 6) < 0.005)
    return rows.withColumn("__ok", ok).groupBy(key).agg(F.coalesce(F.bool_and("__ok"), F.lit(False)).alias("proven"), F.count("*").alias("k"))


def multiple_statements(lines: DataFrame, page_marker: str = FIRST_PAGE) -> DataFrame:
    """Whether a file holds several statements: several first pages, or several opening and closing labels."""
    low = F.lower("text")
    seen = lambda words: F.sum(F.exists(F.array(*map(F.lit, words)), lambda t: F.position(t, low) > 0).cast("int"))
    out = lines.groupBy("statement_id").agg(F.count_if(F.col("text").rlike(page_marker)).alias("first_pages"), seen(vocab.label_dictionary()["opening_balance"]["any_of"]).alias("openings"), seen(vocab.label_dictionary()["closing_balance"]["any_of"]).alias("closings"))
    return out.withColumn("multiple", (F.col("first_pages") > 1) | ((F.col("openings") > 1) & (F.col("closings") > 1)))
