"""Operator 5, secret scans by a recursive decoding worklist.

A text is scanned for assignments, access keys and hexadecimal strings. Then
its encoded parts are unwrapped - percent escapes, Unicode escapes and character
references, base64 (also url-safe, wrapped over lines, or begun inside a run of
its characters), and gzip, zlib, bzip2, xz or zstd inside base64, all members -
and every new layer, UTF-16 or UTF-8 with bytes that are neither, is scanned and
unwrapped in its turn, until no layer brings a new one. A layer already seen at the same place is not read
again, which ends cycles. Each character of a layer knows the code points of the
original text that it came from, so a find maps back to a span there.

Documents are independent rows: no shuffle, and memory is bounded by one
document and its layers. A compressed part of more than ``max_layer`` bytes
is not unwrapped (a guard against decompression bombs) but counted in
``n_oversize``.

Edge cases: null and empty texts have no span; repeated rows and null ids get a
row each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import bz2
import lzma
import re
import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.llm.common import blocks, documents, fresh, map_texts

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
#: A run of hexadecimal digits is one match however long, so this finds the runs of 16 or more.
HEX = re.compile(r"[0-9a-f]{16,}")
WORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})"
                    r"|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: A line end in wrapped base64, as it is or escaped.
BREAK = re.compile(r"(?:\r?\n|\\r\\n|\\n)[\x20\t]*")
#: Runs on lines of their own; the last may be short.
WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{16,}}+(?:(?:{BREAK.pattern})[A-Za-z0-9+/_-]{{16,}}+)*"
                     rf"(?:{BREAK.pattern})[A-Za-z0-9+/_-]++={{0,2}}")
#: ASCII characters in UTF-16.
WIDE = {"utf-16-le": re.compile(rb"(?:[\x20-\x7e]\x00){4,}"), "utf-16-be": re.compile(rb"(?:\x00[\x20-\x7e]){4,}")}
#: Where a compressed format may begin.
MAGIC = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]1AY|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
MAX_LAYER = 1 << 26

Span = tuple[str, int, int]


def scan(text: str, raw: bytes) -> list[Span]:
    """Finds of the three patterns in one layer; ``raw`` is its UTF-8."""
    found: list[Span] = []
    lower = raw.lower()
    if any(w in lower for w in WORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if b"AKIA" in raw:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    return found + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def listed(spans: set[Span] | list[Span]) -> str:
    ordered = sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in ordered)


def _replaced(text: str, parts: list[tuple[int, int, str, list[int], list[int]]]) -> tuple[str, np.ndarray, np.ndarray]:
    """The text with [start, end) replaced by each part's text; where each character begins and ends in ``text``."""
    out, starts, ends, at = [], [], [], 0
    for start, end, new, begin, stop in parts:
        plain = np.arange(at, start)
        out += [text[at:start], new]
        starts += [plain, np.array(begin, np.int64)]
        ends += [plain + 1, np.array(stop, np.int64)]
        at = end
    plain = np.arange(at, len(text))
    return ("".join([*out, text[at:]]), np.concatenate([*starts, plain]).astype(np.int64),
            np.concatenate([*ends, plain + 1]).astype(np.int64))


def _chars(raw: bytes) -> tuple[str, list[int]]:
    """Decoded text (bytes that are not UTF-8 stay as lone surrogates) and the byte at which each character begins."""
    text = raw.decode("utf-8", "surrogateescape")
    at, starts = 0, []
    for c in text:
        starts.append(at)
        at += len(c.encode("utf-8", "surrogateescape"))
    return text, starts


def unquote(text: str):
    parts = []
    for m in PERCENT.finditer(text):
        new, at = _chars(bytes.fromhex(m[0].replace("%", "")))
        begin = [m.start() + 3 * k for k in at]
        parts.append((m.start(), m.end(), new, begin, [*begin[1:], m.end()]))
    return [_replaced(text, parts)] if parts else []


def unescape(text: str):
    parts, high = [], None
    for m in ESCAPE.finditer(text):
        number = next(int(g, 10 if k == 5 else 16) for k, g in enumerate(m.groups()) if g)
        start = m.start()
        if high and high[1] == start and 0xDC00 <= number < 0xE000:  # the second half of a surrogate pair
            parts.pop()
            number, start = 0x10000 + (high[0] - 0xD800) * 0x400 + number - 0xDC00, high[2]
        high = (number, m.end(), start) if 0xD800 <= number < 0xDC00 else None
        if number <= 0x10FFFF:
            parts.append((start, m.end(), chr(number), [start], [m.end()]))
    return [_replaced(text, parts)] if parts else []


def _tool(raw: bytes, limit: int):
    """A decompressor for the format that ``raw`` begins with, or None."""
    if raw[:2] == b"\x1f\x8b" or len(raw) > 2 and raw[0] == 0x78 and (raw[0] * 256 + raw[1]) % 31 == 0:
        return zlib.decompressobj(47)
    if raw[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if raw[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor(memlimit=limit * 4)
    if raw[:4] == b"\x28\xb5\x2f\xfd":
        return zstandard.ZstdDecompressor().decompressobj()
    return None


def _zstd(raw: bytes, most: int) -> tuple[bytes, bytes]:
    """At most ``most`` bytes of a zstd frame and what follows the frame."""
    with zstandard.ZstdDecompressor().stream_reader(raw) as reader:
        out = reader.read(most)
    if len(out) == most:
        return out, b""
    tool = zstandard.ZstdDecompressor().decompressobj()
    tool.decompress(raw)
    return out, tool.unused_data


def inflate(raw: bytes, limit: int) -> bytes | None:
    """What a known compressed format holds, all its members; ``raw`` itself if it is none; None if it exceeds ``limit``."""
    out, rest = [], raw
    size = 0
    while rest:
        try:
            tool = _tool(rest, limit)
            if tool is None:
                break
            if rest[:4] == b"\x28\xb5\x2f\xfd":
                new, rest = _zstd(rest, limit + 1 - size)
            else:
                new = tool.decompress(rest, limit + 1 - size)
                rest = tool.unused_data
        except (zlib.error, OSError, EOFError, lzma.LZMAError, zstandard.ZstdError):
            break
        out.append(new)
        size += len(new)
        if size > limit:
            return None
    return b"".join(out) if out else raw


def _decoded(raw: bytes) -> list[tuple[str, str, int]]:
    """``raw`` as text, its encoding and the byte at which it begins: UTF-8, no byte dropped, and UTF-16 wherever a mark
    or ASCII characters between zero bytes show it."""
    out = [(raw.decode("utf-8", "surrogateescape"), "utf-8", 0)]
    shown = {(kind, 0) for mark, kind in ((b"\xfe\xff", "utf-16-be"), (b"\xff\xfe", "utf-16-le")) if raw[:2] == mark}
    if b"\0" in raw:
        shown |= {(kind, m.start() % 2) for kind, p in WIDE.items() for m in p.finditer(raw)}
    for kind, at in sorted(shown):
        out.append((raw[at:at + (len(raw) - at) // 2 * 2].decode(kind, "surrogatepass"), kind, at))
    return out


def _runs(text: str):
    """Runs of base64 characters and, for each character and the end, its place in the text."""
    for m in BASE64.finditer(text):
        yield m[0].rstrip("="), np.arange(m.start(), m.end() + 1)
    for m in WRAPPED.finditer(text):
        place, at = [], m.start()
        parts = []
        for gap in [*BREAK.finditer(text, m.start(), m.end()), None]:
            end = gap.start() if gap else m.end()
            parts.append(text[at:end])
            place.append(np.arange(at, end))
            at = gap.end() if gap else end
        yield "".join(parts).rstrip("="), np.concatenate([*place, [m.end()]])


def unbase64(text: str, limit: int):
    """Decoded runs at each of the four alignments, every one a layer of its own; None for one that is too large."""
    for run, place in _runs(text):
        run = run.translate({45: "+", 95: "/"})
        for skip in range(4):
            part = run[skip:]
            part = part[:-1] if len(part) % 4 == 1 else part
            if not part:
                continue
            raw = base64.b64decode(part + "=" * (-len(part) % 4))
            layers = [(raw, None)]  # and what is compressed in it, from which byte on
            for at in [0, *(m.start() for m in MAGIC.finditer(raw) if m.start())]:
                plain = inflate(raw[at:], limit)
                if plain is None:
                    yield None
                elif len(plain) != len(raw) - at or plain != raw[at:]:
                    layers.append((plain, at))
                else:
                    continue
                if not at:  # the whole is compressed
                    layers = layers[1:]
                    break
            for plain, at in layers:
                for new, kind, start in _decoded(plain):
                    # A layer with no find and nothing to unwrap changes nothing.
                    if not (scan(new, new.encode("utf-8", "surrogatepass")) or any(
                            p.search(new) for p in (PERCENT, ESCAPE, BASE64))):
                        continue
                    if at is not None:
                        yield new, np.full(len(new), place[skip + at * 8 // 6]), np.full(len(new), place[-1])
                        continue
                    how = "surrogateescape" if kind == "utf-8" else "surrogatepass"
                    units = np.fromiter((len(c.encode(kind, how)) for c in new), np.int64, len(new))
                    end = start + np.cumsum(units)
                    stop = np.minimum(skip + (end * 8 + 5) // 6, len(run))
                    if end[-1] == len(raw):  # padding belongs to the last character
                        stop[-1] = len(place) - 1
                    # A character ends where its last base64 character does, before a line end.
                    yield new, place[skip + (end - units) * 8 // 6], place[stop - 1] + 1


def find(raw: bytes, max_layer: int = MAX_LAYER) -> tuple[list[Span], set[Span], int]:
    """Spans of the text as it stands, all spans with those of decoded layers, and parts too large to unwrap."""
    text = raw.decode()
    base = scan(text, raw)
    spans, oversize = set(base), 0
    work: list[tuple[str, np.ndarray | None, np.ndarray | None]] = [(text, None, None)]
    seen = {(text, 0, len(text))}
    while work:
        layer, starts, ends = work.pop()
        layers = []
        if "%" in layer:
            layers += unquote(layer)
        if "\\" in layer or "&#" in layer:
            layers += unescape(layer)
        for made in [*layers, *unbase64(layer, max_layer)]:
            if made is None:
                oversize += 1
                continue
            new, begin, stop = made
            if not new:
                continue
            if starts is not None:
                begin, stop = starts[begin], ends[stop - 1]
            key = (new, int(begin[0]), int(stop[-1]))
            if key in seen:
                continue
            seen.add(key)
            spans |= {(kind, int(begin[a]), int(stop[b - 1])) for kind, a, b in
                      scan(new, new.encode("utf-8", "surrogatepass"))}
            work.append((new, begin, stop))
    return base, spans, oversize


def secrets(docs: DataFrame, max_layer: int = MAX_LAYER) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_oversize) of every document.

    The counts and the digest cover the text as it stands; ``spans`` has all
    finds, in code points of the text, ends exclusive.
    """
    def work(texts: list[bytes]) -> dict:
        found = [find(t, max_layer) for t in texts]
        count = lambda kind: pa.array([sum(s[0] == kind for s in base) for base, _, _ in found], pa.int64())
        return {**{f"n_{kind}": count(kind) for kind in KINDS},
                "base_sha256": pa.array([sha256(listed(base).encode()).hexdigest() for base, _, _ in found]),
                "spans": pa.array([listed(spans) for _, spans, _ in found]),
                "n_oversize": pa.array([n for _, _, n in found], pa.int64())}

    return map_texts(docs, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_oversize long", work)


def covered(text: str, spans: set[Span], mark: str) -> str:
    """``text`` with every span (overlapping ones together) replaced by ``mark``."""
    out, at = [], 0
    merged: list[list[int]] = []
    for _, start, end in sorted(spans, key=lambda s: s[1:]):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    for start, end in merged:
        out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, mark: str = "[secret]", max_layer: int = MAX_LAYER) -> DataFrame:
    """``docs`` with the secrets of ``text`` replaced, and ``n_chars`` (if there) counted anew where that changed a text."""
    def run(batches):
        for part, texts in blocks(batches):
            new = []
            for raw, old in zip(texts, part.column("text").is_valid().to_pylist()):
                spans = find(raw, max_layer)[1]
                new.append(covered(raw.decode(), spans, mark) if spans else raw.decode() if old else None)
            columns = {n: part.column(n) for n in part.schema.names}
            columns[name] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    name = fresh(docs, "new")
    made = docs.mapInArrow(run, docs.withColumn(name, F.lit(None).cast("string")).schema)
    out = {"text": F.col(name)}
    if "n_chars" in docs.columns:
        same = F.col(name).eqNullSafe(F.col("text"))
        out["n_chars"] = F.when(same, F.col("n_chars")).otherwise(F.length(name).cast(dict(docs.dtypes)["n_chars"]))
    return made.withColumns(out).select(*docs.columns)


def op5_secrets(spark, sf_dir):
    return secrets(documents(spark, sf_dir))


QUERIES = {"op5_secrets": op5_secrets}
