"""Operator 3, token counts by finite-state tokenizer compilation.

A byte-level BPE file is compiled into a cascade of two deterministic
transducers.

*Splitter*: a table over character classes (``DELTA``, ``EMIT``); a transition
is annotated with the piece boundaries that it emits. White space needs one
character of lookahead, so a boundary may be emitted for the character before.
A text is cut into chunks of equal length; each chunk is read from every entry
state at once until all of them meet, which gives its state map; the maps
compose associatively, so a parallel prefix scan yields each chunk's entry state
and its boundaries, whatever stands before it.

*Merger*: reads the bytes of a piece. BPE has one last token for every prefix of
a piece: the one suffix token that may follow the last token of what precedes it
(``_apart``), so ``count(prefix) = count(rest) + 1`` and a transition emits the
difference to the prefix before. Pieces of a block are read in lock step; the
whole path of a piece (start to start, its summed emission) is kept as one
transition, in a table of bounded size.

Character classes are those of the library that owns the file, asked for each
code point when it first occurs. Strings of added tokens inside a text count as
the library's default has it: one token each.

Edge cases: null and empty texts have 0 bytes and 0 tokens; repeated rows and
null ids get a row each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.llm.common import documents, map_texts

VOCABULARY = "byte_bpe_50k.json"
#: Characters in a chunk of the prefix scan, and pieces kept as one transition.
CHUNK, KEPT = 128, 400_000

# Classes: letter, number, other, space, other white space; then the letters of the
# contractions by role, the apostrophe, and the end of a text.
LETTER, NUMBER, OTHER, SPACE, WHITE, L_ST, L_R, L_V, L_L, L_E, QUOTE, END, UNKNOWN = range(13)
ROLES = {"s": L_ST, "t": L_ST, "m": L_ST, "d": L_ST, "r": L_R, "v": L_V, "l": L_L, "e": L_E, "'": QUOTE}
LETTERS = (LETTER, L_ST, L_R, L_V, L_L, L_E)

# States: start of text; inside letters, numbers, others; after one space that may lead a
# piece (fresh: the piece begins at it; more: white space stands before it); after white space
# that ends in no space; after an apostrophe that began a piece; after 'r/'v and 'l; closed piece.
(START, IN_L, IN_N, IN_O, SP_FRESH, SP_MORE, WS_FRESH, WS_MORE, Q, Q_RV, Q_L, CLOSED) = range(12)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """DELTA[state, class] and EMIT[state, class]: bit 0 a boundary before this character, bit 1 one before the
    previous character (late: the last white space of a run parts from the rest when more text follows)."""
    delta = np.full((12, 12), START, np.uint8)
    emit = np.zeros((12, 12), np.uint8)
    kind = {**{c: IN_L for c in LETTERS}, NUMBER: IN_N, OTHER: IN_O, QUOTE: IN_O}
    for s in range(12):
        for c in range(12):
            if c == END:
                continue
            if c in (SPACE, WHITE):
                inside = s in (SP_FRESH, SP_MORE, WS_FRESH, WS_MORE)
                delta[s, c] = (SP_MORE if inside else SP_FRESH) if c == SPACE else (WS_MORE if inside else WS_FRESH)
                emit[s, c] = 0 if inside else 1
                continue
            to = kind[c]
            if s == Q and c == L_ST:
                delta[s, c] = CLOSED
            elif s == Q and c in (L_R, L_V):
                delta[s, c] = Q_RV
            elif s == Q and c == L_L:
                delta[s, c] = Q_L
            elif (s == Q_RV and c == L_E) or (s == Q_L and c == L_L):
                delta[s, c] = CLOSED
            elif s == Q and to == IN_O:
                delta[s, c] = IN_O
            elif s in (IN_L, IN_N, IN_O) and to == s:
                delta[s, c] = s
            elif s == SP_FRESH:
                delta[s, c] = to
            elif s == SP_MORE:
                delta[s, c], emit[s, c] = to, 2
            elif s == WS_MORE:
                delta[s, c], emit[s, c] = (Q if c == QUOTE else to), 3
            elif s in (Q_RV, Q_L) and to == IN_L:
                # not a contraction after all: the apostrophe stands alone and the letter before begins a word
                delta[s, c], emit[s, c] = IN_L, 2
            else:
                delta[s, c], emit[s, c] = (Q if c == QUOTE else to), 1
    return delta, emit


DELTA, EMIT = _tables()
# A contraction that breaks off right after 'r, 'v or 'l also leaves that letter as a word of its own.
for _s in (Q_RV, Q_L):
    for _c in range(12):
        if _c == END or DELTA[_s, _c] != CLOSED and EMIT[_s, _c] & 1:
            EMIT[_s, _c] |= 2


class Classes:
    """Class of each code point, as the library's own splitter has it; asked when a code point first occurs."""

    def __init__(self, split):
        self.split = split
        self.table = np.full(0x110000, UNKNOWN, np.uint8)

    def of(self, points: np.ndarray) -> np.ndarray:
        found = self.table[points]
        if (found == UNKNOWN).any():
            for c in np.unique(points[found == UNKNOWN]).tolist():
                self.table[c] = self._ask(chr(c))
            found = self.table[points]
        return found

    def _ask(self, c: str) -> int:
        if c in ROLES:
            return ROLES[c]
        if c == " ":
            return SPACE
        joins = [len(self.split(lead + c)) == 1 for lead in ("a", "1", "!")]
        return LETTER if joins[0] else NUMBER if joins[1] else OTHER if joins[2] else WHITE


def boundaries(classes: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Where pieces begin in a class sequence whose texts each end with ``END`` (the ends are boundaries too)."""
    n = len(classes)
    lanes = -(-n // chunk)
    padded = np.full(lanes * chunk, END, np.uint8)
    padded[:n] = classes
    steps = padded.reshape(lanes, chunk).T
    # State maps: all entry states side by side, until they have met in every chunk.
    states = DELTA.shape[0]
    maps = np.tile(np.arange(states, dtype=np.uint8), (lanes, 1))
    live = np.arange(lanes)
    meet = np.full(lanes, chunk)
    for k in range(chunk):
        maps[live] = DELTA[maps[live], steps[k, live][:, None]]
        met = (maps[live] == maps[live][:, :1]).all(1)
        meet[live[met]] = k + 1
        live = live[~met]
        if not len(live):
            break
    # The common state of a chunk whose entries have met goes on alone.
    alone = maps[:, 0].copy()
    for k in range(int(meet.min()) if lanes else 0, chunk):
        on = meet <= k
        alone[on] = DELTA[alone[on], steps[k, on]]
    done = meet < chunk
    maps[done] = alone[done][:, None]
    # Parallel prefix scan: after step d, a map covers its own and the d chunks before it.
    d = 1
    while d < lanes:
        maps[d:] = np.take_along_axis(maps[d:], maps[:-d], 1)
        d *= 2
    state = np.concatenate([[START], maps[:-1, START]]).astype(np.uint8)
    out = np.empty((chunk, lanes), np.uint8)
    for k in range(chunk):
        out[k] = EMIT[state, steps[k]]
        state = DELTA[state, steps[k]]
    flat = out.T.reshape(-1)[:n]
    begins = (flat & 1).astype(bool) | (classes == END)
    begins[:-1] |= (flat[1:] & 2).astype(bool)
    return np.flatnonzero(begins)


class Merger:
    """The BPE transducer of a vocabulary: bytes to tokens, piece by piece."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]):
        char = _byte_chars()
        back = {c: b for b, c in enumerate(char)}
        as_bytes = {bytes(back[c] for c in t): i for t, i in vocabulary.items() if all(c in back for c in t)}
        size = max(vocabulary.values()) + 1
        # Rank of a token: single bytes before all merges, then the merges' order.
        self.left, self.right = (np.arange(size, dtype=np.int64) for _ in range(2))
        self.rank = np.full(size, -1, np.int64)
        keys, values = [], []
        for r, (a, b) in enumerate(merges):
            i, j, k = vocabulary[a], vocabulary[b], vocabulary[a + b]
            self.left[k], self.right[k], self.rank[k] = i, j, r
            keys.append(i * size + j)
            values.append(r)
        order = np.argsort(keys)
        self.keys, self.values, self.size = np.array(keys)[order], np.array(values)[order], size
        # Suffix automaton over tokens: read backwards, the longest suffix token and the next shorter one.
        self.tokens = as_bytes
        self.longest = max(map(len, as_bytes))
        self.length = np.zeros(size, np.int64)
        self.shorter = np.full(size, -1, np.int64)
        for t, i in as_bytes.items():
            self.length[i] = len(t)
            for k in range(1, len(t)):
                j = as_bytes.get(t[k:])
                if j is not None:
                    self.shorter[i] = j
                    break
        self.kept: dict[str, int] = {}
        self._trie()

    def _trie(self) -> None:
        """Automaton of all token bytes: edges by (node, byte), links to the longest proper suffix, suffix tokens."""
        nodes, parent, byte, depth = {b"": 0}, [0], [0], [0]
        for t in self.tokens:
            for k in range(1, len(t) + 1):
                if t[:k] not in nodes:
                    nodes[t[:k]] = len(parent)
                    parent.append(nodes[t[:k - 1]])
                    byte.append(t[k - 1])
                    depth.append(k)
        self.fail, self.token = np.zeros(len(parent), np.int64), np.full(len(parent), -1, np.int64)
        for t, i in nodes.items():
            for k in range(1, len(t)):
                j = nodes.get(t[k:])
                if j is not None:
                    self.fail[i] = j
                    break
        for t, i in sorted(nodes.items(), key=lambda x: len(x[0])):
            own = self.tokens.get(t)
            self.token[i] = self.token[self.fail[i]] if own is None else own
        key = np.array(parent[1:], np.int64) * 256 + np.array(byte[1:], np.int64)
        order = np.argsort(key)
        self.edge, self.target = key[order], np.arange(1, len(parent))[order]

    def _step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Next automaton node of each lane."""
        node, out = node.copy(), np.zeros(len(node), np.int64)
        live = np.arange(len(node))
        while len(live):
            key = node[live] * 256 + byte[live]
            at = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
            hit = self.edge[at] == key
            out[live[hit]] = self.target[at[hit]]
            miss = live[~hit]
            live = miss[node[miss] > 0]  # no edge at the root: stay there
            node[live] = self.fail[node[live]]
        return out

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Do the tokens stay apart when their bytes are encoded together?

        Undo both tokens' merges, latest first; the pair of pieces that face
        each other at each moment must not merge before the merges undone so
        far would have taken place.
        """
        a, b = a.copy(), b.copy()
        ok = np.ones(len(a), bool)
        limit = np.full(len(a), np.iinfo(np.int64).max)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            key = x * self.size + y
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where(self.keys[at] == key, self.values[at], np.iinfo(np.int64).max)
            bad = rank < limit[live]
            ok[live[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~bad & ((rx >= 0) | (ry >= 0))
            first = rx > ry  # the later merge is undone first; on the left its right half faces the border
            # Ties at the border: the left pair merges first when ranks are equal, so a right-hand
            # merge of the same rank has not taken place yet.
            limit[live] = np.where(first, rx, ry + 1)
            a[live] = np.where(first, self.right[x], x)
            b[live] = np.where(first, y, self.left[y])
            live = live[go]
        return ok

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """Number of tokens of each piece: the summed emissions of its path."""
        return self._run(pieces)[0]

    def _run(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(-lengths, kind="stable")
        sizes = lengths[order]
        width = int(sizes[0]) if len(sizes) else 0
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        start = (np.cumsum(lengths) - lengths)[order]
        node = np.zeros(len(pieces), np.int64)
        # Last tokens and counts of the prefixes within the longest token's reach.
        reach = min(width, self.longest) + 1
        last = np.full((reach, len(pieces)), -1, np.int64)
        count = np.zeros((reach, len(pieces)), np.int64)
        total = np.zeros(len(pieces), np.int64)
        for k in range(width):
            n = int(np.searchsorted(-sizes, -k))  # lanes with a byte at k (longest first)
            node[:n] = self._step(node[:n], raw[start[:n] + k].astype(np.int64))
            token = self.token[node[:n]].copy()
            lane = np.arange(n)
            while len(lane):
                t = token[lane]
                rest = k + 1 - self.length[t]
                before = last[rest % reach, lane]
                fits = rest == 0
                check = ~fits & (before >= 0)
                fits[check] = self._apart(before[check], t[check])
                lane = lane[~fits]
                token[lane] = self.shorter[token[lane]]
            lane = np.arange(n)
            rest = k + 1 - self.length[token]
            emitted = np.where(rest == 0, 0, count[rest % reach, lane]) + 1 - total[:n]
            total[:n] += emitted
            count[(k + 1) % reach, :n] = total[:n]
            last[(k + 1) % reach, :n] = token
        out = np.empty(len(pieces), np.int64)
        out[order] = total
        return out, order


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Tokenizer:
    """The compiled cascade for one vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer as Library

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True):
            raise ValueError("only byte-level BPE files with the standard split can be compiled")
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.merger = Merger(spec["model"]["vocab"], merges)
        split = Library.from_file(path).pre_tokenizer
        self.classes = Classes(lambda s: split.pre_tokenize_str(s))

    def pieces(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Pieces of all texts in a row, and how many each text has."""
        joined = "\0".join(texts) + "\0" if texts else ""
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        classes = self.classes.of(points)
        classes[ends] = END
        at = boundaries(classes)
        stop = np.append(at[1:], len(points)) if len(at) else at
        real = classes[at] != END
        cuts, stops = at[real], stop[real]
        per = np.diff(np.searchsorted(cuts, ends), prepend=0)
        return [joined[a:b] for a, b in zip(cuts.tolist(), stops.tolist())], per

    def split_added(self, texts: list[str]) -> tuple[list[str], list[int], list[int]]:
        """Texts cut at the strings of added tokens: parts, the text of each part, ids after each part (-1: none)."""
        parts, owner, after = list(texts), list(range(len(texts))), [-1] * len(texts)
        for content, token in self.added.items():
            if not any(content in p for p in parts):
                continue
            new: tuple[list, list, list] = ([], [], [])
            for p, o, a in zip(parts, owner, after):
                bits = p.split(content)
                new[0].extend(bits)
                new[1].extend([o] * len(bits))
                new[2].extend([token] * (len(bits) - 1) + [a])
            parts, owner, after = new
        return parts, owner, after

    def count(self, texts: list[str]) -> np.ndarray:
        """Number of tokens of each text."""
        parts, owner, after = self.split_added(texts)
        pieces, per = self.pieces(parts)
        kept = self.merger.kept
        if len(kept) > KEPT:
            kept.clear()
        new = list(set(pieces).difference(kept))
        if new:
            kept.update(zip(new, self.merger.counts([p.encode() for p in new]).tolist()))
        counts = np.fromiter((kept[p] for p in pieces), np.int64, len(pieces))
        sums = np.concatenate([[0], np.cumsum(counts)])
        ends = np.cumsum(per)
        by_part = sums[ends] - sums[ends - per] + (np.array(after) >= 0)
        return np.bincount(owner, weights=by_part, minlength=len(texts)).astype(np.int64)


@lru_cache(maxsize=2)
def compiled(name: str) -> Tokenizer:
    """The tokenizer of a vocabulary file, compiled once in each worker."""
    return Tokenizer(public_tokenizers.path(name))


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document; see the module's text."""
    def work(texts: list[bytes]) -> dict:
        return {"n_bytes": pa.array([len(t) for t in texts], pa.int64()),
                "n_tokens": pa.array(compiled(vocabulary).count([t.decode() for t in texts]), pa.int64())}

    return map_texts(docs, "n_bytes long, n_tokens long", work).withColumn("over_limit", F.col("n_tokens") > limit)


def op3_token_counts(spark, sf_dir):
    return token_counts(documents(spark, sf_dir))


QUERIES = {"op3_token_counts": op3_token_counts}
