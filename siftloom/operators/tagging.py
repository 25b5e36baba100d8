"""Tags of chunks by a schema: enumerations scored by patterns, strings and dates from a document's metadata."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftloom.functions.text import tag_enum
from siftloom.operators.chunking import SectionProfile

KINDS = ("enum", "string", "date")
FALLBACK = "other"


@dataclass(frozen=True)
class TagField:
    """A field: its kind, the values of an enumeration and the patterns that speak for each."""

    kind: str = "enum"
    values: tuple[str, ...] = ()
    rules: Mapping[str, Sequence[str]] = field(default_factory=dict)


class Tagger(Protocol):
    """Gives a chunk's tags as a map of text; a field that nothing speaks for has none."""

    def tags(self, heading: Column, text: Column, metadata: Column) -> Column: ...


@dataclass(frozen=True)
class RulesTagger:
    """Enumerations by how often their patterns match heading and text, other kinds as the metadata has them."""

    fields: Mapping[str, TagField]

    def tags(self, heading: Column, text: Column, metadata: Column) -> Column:
        """Raises ValueError for a field of no known kind."""
        told = []
        stack = F.concat(F.coalesce(heading, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")))
        for name, f in self.fields.items():
            if f.kind not in KINDS:
                raise ValueError(f"{name} is of no known kind: {f.kind!r}")
            if f.kind != "enum":
                found = F.try_element_at(metadata, F.lit(name))
            elif f.rules:
                found = tag_enum(stack, f.rules, FALLBACK if FALLBACK in f.values else None)
            else:
                continue
            told.append(F.when(F.length(found) > 0, F.struct(F.lit(name).alias("k"), found.alias("v"))))
        entries = F.array_compact(F.array(*told)) if told else F.array().cast("array<struct<k:string,v:string>>")
        return F.map_from_entries(entries)


def tag_strings(tags: Column) -> Column:
    """A map of tags as an array of ``field=value``, in the order of the map."""
    return F.transform(F.map_entries(tags), lambda e: F.concat(e["key"], F.lit("="), e["value"]))


def tagged(chunks: DataFrame, tagger: Tagger, heading_col: str = "heading", text_col: str = "content", metadata_col: str = "metadata") -> DataFrame:
    """The chunks with ``tags`` (a map) and ``tag_strings``."""
    rows = chunks.withColumn("tags", tagger.tags(F.col(heading_col), F.col(text_col), F.col(metadata_col)))
    return rows.withColumn("tag_strings", tag_strings(F.col("tags")))


@dataclass(frozen=True)
class Pack:
    """What a branch of trade brings: how its documents are cut and tagged."""

    name: str
    sections: SectionProfile | None
    tagger: RulesTagger


def read_pack(told: str) -> Pack:
    """A pack from JSON, or from YAML where a reader of it is installed. Raises ValueError for what is no pack.

    Keys: name; chunking with strategy ``numbered_sections``, heading_patterns
    (level, regex), split_at_level, keep_parent_heading and max_tokens;
    tag_schema with fields (type, values, rules).
    """
    try:
        data = json.loads(told)
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise ValueError("no JSON, and no reader of YAML") from e
        try:
            data = yaml.safe_load(told)
        except yaml.YAMLError as e:
            raise ValueError("neither JSON nor YAML") from e
    if not isinstance(data, dict) or not data.get("name"):
        raise ValueError("a pack has a name")
    cut = data.get("chunking") or {}
    sections = None
    if cut.get("strategy") == "numbered_sections":
        patterns = tuple((int(p["level"]), str(p["regex"])) for p in cut.get("heading_patterns", ()))
        sections = SectionProfile(patterns, int(cut.get("split_at_level", 2)), bool(cut.get("keep_parent_heading", True)), int(cut.get("max_tokens", 200)))
    fields = (data.get("tag_schema") or {}).get("fields") or {}
    made = {k: TagField(str(f.get("type", "enum")), tuple(f.get("values") or ()), {v: tuple(ps) for v, ps in (f.get("rules") or {}).items()}) for k, f in fields.items()}
    return Pack(str(data["name"]), sections, RulesTagger(made))
