"""Choosing sections of parsed documents and assembling prompt text.

Sections travel as one pre-order array per document, each with the titles of
its ancestors, so inheritance of relevance is a test inside the row rather
than a join of sections with sections.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.functions import sections as sec
from concordat.functions.text import is_blank, let

# Title keywords that make a section relevant.
KEYWORDS = ("data", "dataset", "survey", "site", "area", "species", "sampling", "collection", "study", "material",
            "method", "sample")


@dataclass(frozen=True)
class SectionSelection:
    section_types: tuple[str, ...] = ("ABSTRACT", "METHODS")
    keywords: tuple[str, ...] = KEYWORDS
    include_abstract: bool = True
    include_all: bool = False


def is_relevant(title: Column, config: SectionSelection = SectionSelection()) -> Column:
    """By section type, or by a keyword anywhere in the raw title."""
    if config.include_all:
        return F.lit(True)
    hit = sec.section_type(title).isin(*config.section_types) if config.section_types else F.lit(False)
    if config.keywords:
        pattern = "|".join(re.escape(k) for k in config.keywords)
        hit = hit | title.rlike(f"(?iu)(?:{pattern})")
    return F.coalesce(hit, F.lit(False))


def relevant_sections(sections: Column, config: SectionSelection = SectionSelection()) -> Column:
    """Relevant non-blank sections; relevance is inherited from any ancestor.

    Each section struct carries ``lineage``: titles from the top section down
    to its own.
    """
    return F.filter(sections, lambda s: ~is_blank(s["text"]) & F.exists(
        s["lineage"], lambda title: is_relevant(title, config)))


def with_lineage(sections: Column) -> Column:
    """Add ``lineage`` to pre-order sections that only know their level.

    The ancestors of a section are the latest earlier sections of each smaller
    level; the path so far is carried along the array.
    """
    def step(state: Column, s: Column) -> Column:
        path = F.concat(F.slice(state["path"], F.lit(1), F.least(s["level"] - 1, F.size(state["path"]))),
                        F.array(s["title"]))
        return F.struct(path.alias("path"), F.array_append(state["out"], path).alias("out"))

    start = F.struct(F.array().cast("array<string>").alias("path"), F.array().cast("array<array<string>>").alias("out"))
    lineages = F.aggregate(sections, start, step, lambda state: state["out"])
    return F.zip_with(sections, lineages, lambda s, lin: s.withField("lineage", lin).withField(
        "path", F.array_join(lin, " > ")))


def section_prompt(abstract: Column, sections: Column, *, include_abstract: bool = True) -> Column:
    """Markdown of the abstract and the sections, first occurrence per title.

    With the abstract included, sections typed as abstract are left out.
    """
    body = sections
    if include_abstract:
        body = F.filter(body, lambda s: sec.section_type(s["title"]) != "ABSTRACT")
    first = let(F.struct(body.alias("body"), F.transform(body, lambda s: s["title"]).alias("titles")), lambda c: F.filter(
        c["body"], lambda s, i: F.array_position(c["titles"], s["title"]) == i + 1))
    blocks = F.transform(first, lambda s: F.concat(F.lit("## "), s["title"], F.lit("\n"), s["text"], F.lit("\n\n")))
    head = F.when(F.length(abstract) > 0, F.concat(F.lit("## Abstract\n"), abstract, F.lit("\n\n"))).otherwise("")
    text = F.array_join(blocks, "")
    return F.concat(head, text) if include_abstract else text


def sections_mode(docs: DataFrame, config: SectionSelection = SectionSelection()) -> DataFrame:
    """Add ``relevant_sections`` and the assembled ``prompt_text`` to parsed documents.

    (The abstract block leads the prompt; injecting an abstract section as
    well would be dropped again by the assembly, so it is not done.)
    """
    chosen = docs.withColumn("relevant_sections", relevant_sections(F.col("sections"), config))
    return chosen.withColumn("prompt_text", section_prompt(
        F.coalesce("abstract", F.lit("")), F.col("relevant_sections"), include_abstract=config.include_abstract))


def prompt_blocks(*blocks: Column) -> Column:
    """Non-blank blocks joined by one blank line."""
    return F.array_join(F.filter(F.array(*blocks), lambda b: b.isNotNull() & ~is_blank(b)), "\n\n")
