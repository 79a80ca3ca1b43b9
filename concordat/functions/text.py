"""String normalisation as JVM-side column expressions."""

from __future__ import annotations

import html
import sys
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a Unicode-aware strip/split treats as blank.
WS_CHARS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace())


def _char_class(chars: str) -> str:
    """Regex class body for a set of characters, neighbours joined to ranges
    (the matcher tests one range instead of every member)."""
    codes = sorted(map(ord, chars))
    ranges: list[list[int]] = []
    for code in codes:
        if ranges and code == ranges[-1][1] + 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "".join(f"\\x{{{lo:x}}}-\\x{{{hi:x}}}" if lo != hi else f"\\x{{{lo:x}}}" for lo, hi in ranges)


WS = f"[{_char_class(WS_CHARS)}]"
NON_WS = "[^" + WS[1:]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``.

    Expressions are trees: a value named twice is computed twice, and nested
    uses multiply. Binding it keeps both the plan and the work small.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: Column | str) -> Column:
    """Trim every Unicode blank from both ends (``trim`` alone only drops U+0020)."""
    return F.btrim(as_col(value), F.lit(WS_CHARS))


def collapse_ws(value: Column | str) -> Column:
    """Runs of blanks become one space, ends are trimmed."""
    return F.btrim(F.regexp_replace(as_col(value), WS + "+", " "), F.lit(" "))


def words(value: Column | str) -> Column:
    """Blank-separated words, without empty entries."""
    return F.filter(F.split(as_col(value), WS + "+"), lambda w: w != "")


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, str, str]:
    """Characters that lower-casing leaves alone but case folding still changes.

    Derived from the Unicode tables Python ships, so nothing is typed in by
    hand: one-to-one folds as two strings, the longer ones as a map text.
    """
    changed = {c: c.casefold() for c in map(chr, range(0x80, sys.maxunicode + 1))
               if not 0xD800 <= ord(c) <= 0xDFFF and c.lower() == c and c.casefold() != c}
    single = {c: f for c, f in changed.items() if len(f) == 1}
    longer = {c: f for c, f in changed.items() if len(f) > 1 and c != SHARP_S}
    return ("".join(single), "".join(single.values()), f"[{_char_class(''.join(longer))}]",
            "\x02".join(f"{c}\x03{f}" for c, f in longer.items()))


SHARP_S = "\u00df"


def _expand(text: Column, rare: str, table: str) -> Column:
    """``text`` with each character of the class ``rare`` replaced by its entry in ``table``; no other character is looked up."""
    folds = F.str_to_map(F.lit(table), F.lit("\x02"), F.lit("\x03"))
    found = F.transform(F.regexp_extract_all(text, F.lit(f"({rare})"), 1), lambda ch: F.coalesce(F.try_element_at(folds, ch), ch))
    # Texts and rare characters alternate, starting and ending with a text.
    return F.array_join(F.flatten(F.zip_with(F.split(text, rare), found, lambda t, r: F.array(t, F.coalesce(r, F.lit(""))))), "")


def is_ascii(value: Column) -> Column:
    """Compares two stored lengths; no character is looked at."""
    return F.octet_length(value) == F.length(value)


def casefold(value: Column | str) -> Column:
    """Unicode case folding.

    Pure ASCII needs lower-casing only. Other texts get the one-to-one folds
    by translation; the few characters that fold to several run per character.
    """
    def fold(lowered: Column) -> Column:
        froms, tos, rare, table = _fold_tables()
        simple = F.translate(F.replace(lowered, F.lit(SHARP_S), F.lit("ss")), froms, tos)
        return F.when(is_ascii(lowered), lowered).when(lowered.rlike(rare), _expand(simple, rare, table)).otherwise(simple)

    return let(F.lower(as_col(value)), fold)


def normalize_string(value: Column | str, *, strip_ends: bool = True, collapse: bool = True,
                     fold: bool = True) -> Column:
    """The comparison form of a string; each step can be switched off."""
    out = as_col(value)
    if strip_ends:
        out = strip(out)
    if collapse:
        out = collapse_ws(out)
    return casefold(out) if fold else out


def is_blank(value: Column | str) -> Column:
    return F.coalesce(strip(value) == "", F.lit(True))


def blank_to_null(value: Column | str) -> Column:
    """Stripped text, or NULL when nothing is left."""
    return F.nullif(strip(value), F.lit(""))


def _pairs(table: dict[str, str]) -> str:
    """A constant map as text (``str_to_map`` reads it once for a query)."""
    return "\x02".join(f"{k}\x03{v}" for k, v in sorted(table.items()))


@lru_cache(maxsize=1)
def _references() -> tuple[str, str, str, str]:
    """Named references as the HTML standard lists them, those that need no semicolon as a pattern (longest first),
    and how numbers in the C1 range and others with a meaning of their own are read."""
    named = {k: v for k, v in html.entities.html5.items()}
    open_names = sorted((k for k in named if not k.endswith(";")), key=lambda k: (-len(k), k))
    numbers = {str(k): v for k, v in html._invalid_charrefs.items()} | {str(k): "" for k in html._invalid_codepoints
                                                                        if k not in html._invalid_charrefs}
    # A null, a break or a tab in a value would end an entry of the text form; such values have names of their own here.
    return _pairs(named), "^(?:" + "|".join(open_names) + ")", _pairs(numbers), "\ufffd"


REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


def unescape_html(value: Column | str) -> Column:
    """Decode character references once, left to right, by the rules of the HTML standard.

    Names may lack their semicolon where the standard allows it (the longest
    known name at the start counts); numbers in the C1 range stand for their
    Windows-1252 characters, invalid ones for U+FFFD or nothing. The text is
    split at the references, so a decoded ``&`` is never decoded a second time.
    """
    raw = as_col(value)
    names, prefix, numbers, bad = _references()
    as_map = lambda text: F.str_to_map(F.lit(text), F.lit("\x02"), F.lit("\x03"))

    def numeric(body: Column) -> Column:
        digits = F.regexp_extract(body, "^#[xX]?0*([0-9a-fA-F]*)", 1)
        # More digits than any code point has stand for a number out of range.
        long = F.length(digits) > 9
        code = F.when(body.rlike("^#[xX]"), F.conv(digits, 16, 10).cast("bigint")).otherwise(digits.try_cast("bigint"))
        code = F.when(long, F.lit(1 << 40)).otherwise(F.coalesce(code, F.lit(0)))

        def read(c: Column) -> Column:
            known = F.try_element_at(as_map(numbers), c.cast("string"))
            outside = c.between(0xD800, 0xDFFF) | (c > 0x10FFFF)
            return F.when(known.isNotNull(), known).when(outside, F.lit(bad)).otherwise(
                F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32"))

        return let(code, read)

    def by_name(body: Column) -> Column:
        whole = F.try_element_at(as_map(names), body)
        head = F.regexp_extract(body, prefix, 0)
        return F.coalesce(whole, F.when(head != "", F.concat(F.try_element_at(as_map(names), head), F.substring(
            body, F.length(head) + 1, F.length(body)))), F.concat(F.lit("&"), body))

    def decode(ref: Column) -> Column:
        return let(F.substring(ref, F.lit(2), F.length(ref)), lambda body: F.when(body.startswith("#"), numeric(body)).otherwise(by_name(body)))

    refs = F.transform(F.regexp_extract_all(raw, F.lit(f"({REFERENCE})"), 1), decode)
    # Texts and decoded references alternate, starting and ending with a text.
    woven = F.flatten(F.zip_with(F.split(raw, REFERENCE), refs, lambda t, r: F.array(t, F.coalesce(r, F.lit("")))))
    return F.when(raw.contains("&"), F.array_join(woven, "")).otherwise(raw)


def clean_markup(value: Column | str) -> Column:
    """Decode references, blank out tags, collapse blanks; NULL becomes empty text."""
    no_tags = F.regexp_replace(unescape_html(value), "<[^>]+>", " ")
    return F.coalesce(collapse_ws(no_tags), F.lit(""))


@lru_cache(maxsize=1)
def _ascii_fold_table() -> tuple[str, str, str, str]:
    """Compatibility decomposition reduced to ASCII, per character, by rule."""
    import unicodedata

    flat = {c: unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()
            for c in map(chr, range(0x80, sys.maxunicode + 1)) if not 0xD800 <= ord(c) <= 0xDFFF}
    single = {c: f for c, f in flat.items() if len(f) == 1}
    longer = {c: f for c, f in flat.items() if len(f) > 1}
    return ("".join(single), "".join(single.values()), f"[{_char_class(''.join(longer))}]",
            "\x02".join(f"{c}\x03{f}" for c, f in longer.items()))


def ascii_key(value: Column | str, *, cleaned: bool = False) -> Column:
    """Accent-free lower-case words joined by single spaces (a matching key).

    Characters with no ASCII decomposition vanish, as in NFKD plus
    ASCII-ignore, over all code points. ``cleaned`` says that markup was
    removed already.
    """
    froms, tos, rare, table = _ascii_fold_table()

    def flatten_accents(text: Column) -> Column:
        expanded = F.when(text.rlike(rare), _expand(text, rare, table)).otherwise(text)
        only = F.regexp_replace(F.translate(expanded, froms, tos), r"[^\x00-\x7F]+", "")
        return F.when(is_ascii(text), text).otherwise(only)

    def clean(text: Column) -> Column:
        # ASCII without references and tags needs no cleaning: all its blanks are among what becomes one space below.
        return F.when(is_ascii(text) & ~text.contains("&") & ~text.contains("<"), text).otherwise(clean_markup(text))

    flat = let(as_col(value) if cleaned else let(as_col(value), clean), flatten_accents)
    return F.btrim(F.regexp_replace(F.lower(flat), "[^a-z0-9]+", " "), F.lit(" "))


def is_populated(value: Column | str, data_type: str) -> Column:
    """Does a cell carry a value: non-NULL, and not blank or empty."""
    c = as_col(value)
    if data_type.startswith(("array", "map")):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    if data_type == "string":
        return ~is_blank(c)
    return c.isNotNull()


def length_class(value: Column | str) -> Column:
    """Rough document kind by length in characters."""
    n = F.length(as_col(value))
    return (F.when(n > 10000, "article").when(n > 2000, "extended_abstract")
            .when(n.isNotNull(), "abstract"))


def normalize_path(value: Column | str, base: str | None = None) -> Column:
    """Forward slashes, joined to ``base``; blank and ``nan`` become NULL."""
    raw = as_col(value)
    clean = strip(F.translate(raw, "\\", "/"))
    joined = F.when(clean.startswith("/") | F.lit(base is None), clean).otherwise(
        F.concat(F.lit((base or "").rstrip("/") + "/"), clean))
    return F.when(~strip(raw).isin("", "nan"), joined)
