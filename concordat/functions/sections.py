"""Section headings, sentences, tokens and content markers."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from concordat.functions.text import WS, as_col, strip

# ---- Fixed values: section type -> heading patterns, tried in this order ----

SECTION_PATTERNS = {
    "ABSTRACT": (
        r"abstract",
        r"summary",
        r"r[ée]sum[ée]",
    ),
    "INTRO": (
        r"introduction",
        r"background",
        r"overview",
        r"introductory\s+remarks?",
        r"preamble",
    ),
    "METHODS": (
        r"methods?",
        r"materials?\s*(and|&|\+)\s*methods?",
        r"methodology",
        r"methodologies",
        r"experimental\s*(design|procedures?|methods?)?",
        r"study\s*(design|area|site)",
        r"procedures?",
        r"techniques?",
        r"approach(es)?",
        r"sampling",
        r"data\s*collection",
        r"field\s*(work|methods?|sampling)",
        r"laboratory\s*methods?",
        r"statistical\s*analysis",
        r"model(s|ling)?",
    ),
    "RESULTS": (
        r"results?",
        r"findings?",
        r"outcomes?",
        r"observations?",
        r"data\s*analysis",
    ),
    "DISCUSSION": (
        r"discussion",
        r"interpretation",
        r"implications?",
        r"results?\s*(and|&|\+)\s*discussion",
        r"discussion\s*(and|&|\+)\s*conclusions?",
    ),
    "CONCLUSION": (
        r"conclusions?",
        r"concluding\s*remarks?",
        r"summary\s*(and|&|\+)\s*conclusions?",
        r"final\s*remarks?",
        r"perspectives?",
        r"outlook",
        r"future\s*(work|directions?|research)",
    ),
    "REFERENCES": (
        r"references?",
        r"bibliography",
        r"literature\s*cited",
        r"works?\s*cited",
        r"citations?",
    ),
    "ACK": (
        r"acknowledgem?ents?",
        r"thanks",
        r"funding",
        r"author\s*contributions?",
        r"conflict\s*of\s*interest",
        r"competing\s*interests?",
    ),
    "DATA_AVAILABILITY": (
        r"data\s*availability(\s*statement)?",
        r"data\s*access(ibility)?(\s*statement)?",
        r"code\s*availability(\s*statement)?",
        r"materials?\s*availability(\s*statement)?",
        r"resource\s*availability(\s*statement)?",
        r"data\s*(and\s*)?code\s*availability(\s*statement)?",
        r"supporting\s*information",
        r"supplementary\s*information",
    ),
    "SUPPLEMENT": (
        r"supplement(ary)?(\s*(material|data|information|methods?|results?))?",
        r"appendix(\s*[a-z0-9])?(\s+\w+)*",
        r"appendices",
        r"additional\s*(files?|information|materials?)",
        r"online\s*(resources?|supplement)",
        r"supporting\s*(files?|materials?|methods?)",
    ),
}
OTHER = "OTHER"

# Abbreviations whose full stop does not end a sentence.
ABBREVIATIONS = ("et al.", "e.g.", "i.e.", "Fig.", "fig.", "Tab.", "Dr.", "Mr.", "Mrs.", "Ms.")

# ---- Headings --------------------------------------------------------------


def normalize_heading(value: Column | str) -> Column:
    """Heading without numbering and special characters, lower-cased."""
    h = strip(value)
    h = F.regexp_replace(h, r"(?U)^(?:\d+\.)*\d+\.?\s+", "")
    h = F.regexp_replace(h, r"(?iU)^[ivxlcdm]+\.?\s+", "")
    h = F.regexp_replace(h, r"(?U)^[A-Z]\.?\s+", "")
    h = F.regexp_replace(h, r"(?iU)^\([a-z0-9]+\)\s+", "")
    h = F.regexp_replace(h, r"(?U)[^\w\s&+\-é]", "")
    return strip(F.lower(F.regexp_replace(h, r"(?U)\s+", " ")))


def section_type(heading: Column | str) -> Column:
    """Canonical section type of a raw heading; one alternation per type."""
    h = normalize_heading(heading)
    out = F.lit(OTHER)
    for name, patterns in reversed(SECTION_PATTERNS.items()):
        out = F.when(h.rlike(r"(?iU)^(?:" + "|".join(patterns) + r")\z"), name).otherwise(out)
    return out


def section_path(title: Column | str, parent_path: Column | str) -> Column:
    parent = F.nullif(as_col(parent_path), F.lit(""))
    return F.concat_ws(" > ", parent, as_col(title))


def is_likely_heading(value: Column | str, max_length: int = 150) -> Column:
    t = as_col(value)
    shaped = (t != "") & (F.length(t) <= max_length) & ~strip(t).rlike(r"[.!?]\z") & ~t.contains(". ")
    return F.coalesce(shaped, F.lit(False))


# ---- Content markers -------------------------------------------------------


def content_flags(value: Column | str) -> Column:
    t = as_col(value)
    low = F.lower(t)
    equation = (t.rlike(r"\$[^\n]*\$") | t.rlike(r"\\\[[^\n]*?\\\]")
                | low.contains("<math") | low.contains("\\begin{equation"))
    table = low.rlike(r"(?U)\b(?:table|tab\.?)\s+\d+") | low.rlike(r"(?U)\bsee\s+table")
    figure = low.rlike(r"(?U)\b(?:figure|fig\.?)\s+\d+") | low.rlike(r"(?U)\bsee\s+fig")
    reference = t.rlike(r"(?m)^\[\p{Nd}+\]")
    return F.struct(equation.alias("has_equation"), table.alias("has_table_mention"),
                    figure.alias("has_figure_mention"), reference.alias("has_references_pattern"))


# ---- Sentences and tokens --------------------------------------------------


#: Stands for a full stop of an abbreviation while a text is split.
PROTECTED = ""


def sentences(value: Column | str, *, literal_at_sign: bool = False) -> Column:
    """Sentences of a text, abbreviations kept together.

    ``literal_at_sign=True`` reproduces a quirk of the studied tool, which
    marks protected dots with ``@`` and so turns every ``@`` into a dot.
    """
    mark = "@" if literal_at_sign else PROTECTED
    t = as_col(value)
    for abbreviation in ABBREVIATIONS:
        t = F.replace(t, F.lit(abbreviation), F.lit(abbreviation.replace(".", mark)))
    pieces = F.split(t, rf"(?<=[.!?]){WS}+")
    kept = F.filter(F.transform(pieces, strip), lambda s: s != "")
    return F.transform(kept, lambda s: strip(F.replace(s, F.lit(mark), F.lit("."))))


def sentences_of(text: str, *, literal_at_sign: bool = False) -> list[str]:
    """What ``sentences`` gives, for one text in a Python worker."""
    mark = "@" if literal_at_sign else PROTECTED
    for abbreviation in ABBREVIATIONS:
        text = text.replace(abbreviation, abbreviation.replace(".", mark))
    # As splitting behind the mark does, but the mark is found faster; only the whole text's ends are left to strip.
    parts = _SENTENCE_END.split(text.strip())
    found = [s + end for s, end in zip(parts[::2], parts[1::2])] + parts[-1:]
    found = [s for s in found if s]
    return [s.replace(mark, ".") for s in found] if mark in text else found


_SENTENCE_END = re.compile(r"([.!?])\s+")


def plain_sentences(cleaned: Column | str) -> Column:
    """Sentence split without abbreviation handling (for already cleaned text)."""
    return F.filter(F.transform(F.split(as_col(cleaned), rf"(?<=[.!?]){WS}+"), strip), lambda s: s != "")


class WordTokens:
    """Default tokenizer: a token is a word with the blanks around it.

    Joining tokens gives the text back, which is what cutting an over-long
    sentence needs.
    """

    #: The tokens of texts with white space between them are those of each.
    additive = True
    _TOKEN = re.compile(r"\s*\S+\s*")

    def load(self) -> WordTokens:
        return self

    def count(self, text: str) -> int:
        return len(text.split())

    def pieces(self, text: str, size: int) -> list[str]:
        """The text cut after every ``size`` tokens."""
        tokens = self._TOKEN.findall(text)
        return ["".join(tokens[i:i + size]) for i in range(0, len(tokens), size)]


class CodecTokens:
    """Any encoder with ``encode(str) -> list[int]`` and ``decode(list[int]) -> str``.

    ``load`` runs once per batch stream of a Python worker, so a vocabulary is
    not shipped with every task. For byte-pair vocabularies, which need a local file.
    """

    additive = False

    def __init__(self, load: Callable[[], object]):
        self._load, self._codec = load, None

    def load(self) -> CodecTokens:
        loaded = CodecTokens(self._load)
        loaded._codec = self._load()
        return loaded

    def count(self, text: str) -> int:
        return len(self._codec.encode(text))

    def pieces(self, text: str, size: int) -> list[str]:
        ids = self._codec.encode(text)
        return [self._codec.decode(ids[i:i + size]) for i in range(0, len(ids), size)]
