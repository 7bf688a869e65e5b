"""Strings that are shown: places, sizes, notes, labels of graphs, answers from templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.functions.text import timecode

# The headings of fused text.
SECTIONS = ["Transcript", "Visual description", "On-screen text", "Document text"]
# The leads of answers by intent, and what is said without facts and without a question.
LEADS = {"contradiction": "Disagreements found", "co_occurrence": "Co-occurring evidence found", "identity": "Evidence linked to this person", "timeline": "Evidence in that time range", "entity": "Evidence mentioning this", "general": "Closest matching evidence"}
NO_FACTS, NO_QUESTION = "No evidence in this case matches that question.", "Ask a question about the case."


def place(start: Column, page: Column) -> Column:
    """Where in its source a node sits: a time code, a page, or null."""
    return F.when(start.isNotNull(), timecode(start)).when(page.isNotNull(), F.concat(F.lit("p"), page))


def size_label(size: Column) -> Column:
    mb = size / 1024 / 1024
    return F.when(size.isNull() | (size == 0), "—").when(mb < 1, F.format_string("%.0f KB", size / 1024.0)).otherwise(F.format_string("%.1f MB", mb.cast("double")))


def node_radius(weight: Column) -> Column:
    return F.least(6 + 2.5 * F.sqrt(F.coalesce(F.nullif(weight, F.lit(0)), F.lit(1))), F.lit(22.0))


def link_width(weight: Column) -> Column:
    return F.least(1 + F.sqrt(F.coalesce(F.nullif(weight, F.lit(0)), F.lit(1))), F.lit(5.0))


def seconds_label(at: Column) -> Column:
    return F.format_string("%.1fs", at.cast("double"))


def evidence_label(node_type: Column, page: Column, start: Column, file_name: Column) -> Column:
    """A node as a graph names it: type, place, file."""
    where = F.when(page.isNotNull(), F.concat(F.lit(" at p"), page)).when(start.isNotNull(), F.concat(F.lit(" at "), seconds_label(start))).otherwise("")
    return F.concat(node_type, where, F.lit(" in "), file_name)


def event_label(members: Column, start: Column, end: Column) -> Column:
    return F.concat(members, F.lit(" evidence node(s) between "), seconds_label(start), F.lit(" and "), seconds_label(end))


def method_label(counts: dict[str, Column]) -> Column:
    """Each method with its count, those without any left out."""
    return F.concat_ws(", ", *[F.when(n > 0, F.concat(F.lit(f"{k}("), n, F.lit(")"))) for k, n in counts.items()])


def consistency(offset: Column, middle: Column, spread: Column) -> Column:
    """1 at the middle of a bin, less with distance, never beyond 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.abs(offset - middle) / (spread + 1)))


def integrity_note(previous_hash: Column, mismatch: Column, declared: Column, file_name: Column, mime: Column) -> Column:
    """What doesn't fit about a file: other content than before, another type than claimed; null where all fits."""
    changed = F.when(previous_hash.isNotNull(), F.concat(F.lit("content changed since last ingest (was "), F.left(previous_hash, F.lit(12)), F.lit(")")))
    ending = F.nullif(F.regexp_extract(file_name, r"[.]([^.]+)$", 1), F.lit(""))
    claim = F.concat(F.when(declared.isNotNull(), "config").otherwise("extension"), F.lit(" claims '"), F.coalesce(declared, ending, F.lit("unknown")), F.lit("' but content is "), F.coalesce(mime, F.lit("unknown")))
    return F.nullif(F.concat_ws("; ", changed, F.when(mismatch, claim)), F.lit(""))


def artefact_key(sha256: Column) -> Column:
    return F.left(sha256, F.lit(16))


def split_sections(text: Column) -> Column:
    """(label, body) of each headed section of fused text; without any heading the whole is one section."""
    heads = "|".join(SECTIONS)
    marked = F.regexp_replace(text, rf"(?m)^({heads}):\s*", "\u0001$1\u0002")
    parts = F.filter(F.split(marked, "\u0001"), lambda p: F.contains(p, F.lit("\u0002")))
    cut = F.transform(parts, lambda p: F.struct(F.split_part(p, F.lit("\u0002"), F.lit(1)).alias("label"), F.regexp_replace(F.split_part(p, F.lit("\u0002"), F.lit(2)), r"^\s+|\s+$", "").alias("body")))
    whole = F.array(F.struct(F.lit("Extracted text").alias("label"), F.regexp_replace(text, r"^\s+|\s+$", "").alias("body")))
    none = F.array().cast("array<struct<label:string,body:string>>")
    return F.when(F.length(text) == 0, none).when(F.size(parts) == 0, whole).otherwise(F.filter(cut, lambda s: s["body"] != ""))


def unquoted(value: Column) -> Column:
    """A JSON string without the quotes at its ends, however many."""
    return F.regexp_replace(value, '^"+|"+$', "")


def fact_line(label: Column, detail: Column) -> Column:
    return F.concat(F.lit("- "), label, F.when(detail != "", F.concat(F.lit(": "), detail)).otherwise(""))


def template_answer(kind: Column, facts: Column) -> Column:
    """A lead, the number of facts and a line for each; the sentence for none where there are none."""
    leads = None
    for k, lead in LEADS.items():
        leads = F.when(kind == k, lead) if leads is None else leads.when(kind == k, lead)
    lines = F.array_join(F.transform(facts, lambda f: fact_line(f["label"], f["detail"])), "\n")
    return F.when(F.size(facts) > 0, F.concat(leads.otherwise("Evidence found"), F.lit(" ("), F.size(facts), F.lit(" item(s)):\n"), lines)).otherwise(NO_FACTS)
