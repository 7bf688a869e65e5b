"""Answers of models read as data: a bad answer gives null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of entities, what stands for no answer, and verdicts.
ENTITY_KINDS = ["person", "weapon", "location", "phone", "vehicle", "organization", "object", "other"]
NOTHING = ["none", "none.", "no claim", "n/a"]
VERDICTS = ["contradicts", "corroborates", "unrelated"]
MAX_NAME, MAX_WORDS = 60, 5


def json_object(answer: Column) -> Column:
    """The text from the first brace to the last; null without one."""
    return F.nullif(F.regexp_extract(answer, r"(?s)(\{.*\})", 1), F.lit(""))


def entities(answer: Column) -> Column:
    """(name, kind) of each named entity; an unknown kind is ``other``."""
    got = F.from_json(json_object(answer), "entities array<struct<name:string,type:string>>")["entities"]
    named = F.filter(got, lambda e: F.trim(e["name"]) != "")
    kind = lambda e: F.lower(F.trim(e["type"]))
    return F.transform(named, lambda e: F.struct(F.trim(e["name"]).alias("name"), F.when(kind(e).isin(ENTITY_KINDS), kind(e)).otherwise("other").alias("kind")))


def claim(answer: Column) -> Column:
    """An answer in one line; null where it is empty or says that there is no claim."""
    s = F.trim(F.regexp_replace(answer, r"\s+", " "))
    return F.when((s != "") & ~F.lower(s).isin(NOTHING), s)


def verdict(answer: Column) -> Column:
    """(relation, confidence); a confidence that is no number between 0 and 1 counts as one half."""
    got = F.from_json(json_object(answer), "relation string, confidence string")
    relation, sure = F.lower(F.trim(got["relation"])), got["confidence"].try_cast("double")
    return F.when(relation.isin(VERDICTS), F.struct(relation.alias("relation"), F.when(sure.between(0, 1), sure).otherwise(0.5).alias("confidence")))


def explanation(answer: Column) -> Column:
    """The sentence by which a judge explains itself; null without one."""
    return F.nullif(F.trim(F.from_json(json_object(answer), "explanation string")["explanation"]), F.lit(""))


def display_name(answer: Column) -> Column:
    """A short name without quotes round it; null for no answer and for whole sentences."""
    s = F.regexp_replace(F.trim(F.regexp_replace(answer, r"\s+", " ")), "^[\"']+|[\"']+$", "")
    return F.when((s != "") & ~F.lower(s).isin(NOTHING) & (F.length(s) <= MAX_NAME) & (F.size(F.split(s, r"\s+")) <= MAX_WORDS), s)
