"""Operator 12, spelling variant grouping by Bloom-guided neighbourhoods.

Words are runs of Latin letters; two words are near if they differ by one
inserted, deleted or replaced letter, and a word's form is its most frequent near
word if that is frequent enough.

Method. The vocabulary (distinct words with their counts) is put into blocked
Bloom filters, one for each length, built by the tasks and united with a bitwise
or. The filters are broadcast: ``filter_bytes`` bounds them whatever the
vocabulary's size - beyond it they only let more false positives through. Each
task generates its words' edits, as hashes derived from the word's own in
constant time, and probes the filter of the edit's length. Only positives become
rows; a join on the exact vocabulary removes the false ones. A replaced letter
always becomes a later one, insertions are the deletions of the other word, and of
equal neighbouring letters only the first is deleted, so every pair is generated
exactly once.

Words are counted inside the tasks before the shuffle, with array operations on
whole texts, and no pair of words outside the neighbourhoods is ever looked at. A
word has at most 180 near words a letter, so no group grows with the corpus.

Words are handled as their letters' code points, a byte each, whose order is the
code-point order of the words.

Edge cases: null and empty texts have no words; a null id plants as an empty one;
repeated rows count again; words without near words have none and are their own
root; ties of a form go to the smaller word; an empty table, or one without
frequent words, gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.llm.common import blocks, documents, pinned
from concordat.llm.grams import powers

#: Lower-cased letters of one byte, 0 for all other bytes; and bytes with A-Z lower-cased.
LETTER, LOWER = np.zeros(256, np.uint8), np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LETTER[97:123] = LETTER[65:91] = np.arange(97, 123)
#: The first UTF-8 byte of U+00C0 to U+00FF; the second is the code point less 64.
LEAD = 0xC3
#: Lengths with a filter of their own; longer words share the last one.
LONGEST = 64
BLOCK_BITS, PROBES = 512, 6
PIECE = 1 << 16


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (table & np.uint32(1)))
    return table


CRC = _crc_table()


def crc_on(state: np.ndarray, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of ``raw[begin:end]`` after the bytes whose CRC-32 ``state`` is, for many stretches at once."""
    order = np.argsort(begin - end, kind="stable")
    size, at, crc = (end - begin)[order], begin[order], ~state[order]
    number = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), side="left")
    for i, k in enumerate(number.tolist()):
        crc[:k] = CRC[(crc[:k] ^ raw[at[:k] + i]) & np.uint32(255)] ^ (crc[:k] >> np.uint32(8))
    out = np.empty_like(crc)
    out[order] = ~crc
    return out


def _latin(raw: bytes) -> bytes:
    return raw.decode().encode("latin-1")


def counted(texts: list[bytes], ids: list[str], drop_every: int | None, shortest: int) -> dict[bytes, int]:
    """Words (a byte a letter) of a block of texts, lower-cased, of at least ``shortest`` letters.

    Of every run whose CRC-32, after its id and a colon, ``drop_every`` divides, one letter is deleted.
    """
    raw = LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
    lead = raw == LEAD
    inside = (LETTER[raw] > 0) | lead
    inside[1:] |= lead[:-1]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    leads = np.concatenate([[0], np.cumsum(lead)])
    size = end - begin - (leads[end] - leads[begin])
    begin, end, size = (x[size >= shortest] for x in (begin, end, size))
    start = np.cumsum([0, *(len(t) + 1 for t in texts)])
    doc = np.searchsorted(start, begin, side="right") - 1
    out: dict[bytes, int] = {}
    stream = raw.tobytes()
    plain = np.ones(len(begin), bool)
    if drop_every:
        first = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
        state = first[doc]
        long = end - begin > 256  # few; a step of the arrays for each letter would not pay
        crc = np.empty(len(begin), np.uint32)
        crc[~long] = crc_on(state[~long], raw, begin[~long], end[~long])
        for i in np.flatnonzero(long).tolist():
            crc[i] = zlib.crc32(stream[begin[i]:end[i]], int(state[i]))
        plain = crc % np.uint32(drop_every) != 0
        for i in np.flatnonzero(~plain).tolist():
            word, place = _latin(stream[begin[i]:end[i]]), int(crc[i]) % int(size[i])
            if size[i] > shortest:
                word = word[:place] + word[place + 1:]
                out[word] = out.get(word, 0) + 1
    begin, end = begin[plain], end[plain]
    power, inverse = powers(len(raw) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:len(raw)])])
    _, at, number = np.unique((total[end] - total[begin]) * inverse[begin], return_index=True, return_counts=True)
    for a, b, n in zip(begin[at].tolist(), end[at].tolist(), number.tolist()):
        word = stream[a:b]
        word = word if word.isascii() else _latin(word)
        out[word] = out.get(word, 0) + n
    return out


def vocabulary(docs: DataFrame, shortest: int, least: int, drop_every: int | None, held: int = 200_000) -> DataFrame:
    """(key, n): words of at least ``shortest`` letters that occur ``least`` times or more, a byte a letter."""
    def run(batches):
        total: dict[bytes, int] = {}

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())],
                                              names=["key", "n"])

        for part, texts in blocks(batches):
            ids = ["" if x is None else str(x) for x in part.column("doc_id").to_pylist()]
            for word, n in counted(texts, ids, drop_every, shortest).items():
                total[word] = total.get(word, 0) + n
            if len(total) > held:
                yield rows()
                total.clear()
        yield rows()

    partial = docs.select("doc_id", "text").mapInArrow(run, "key binary, n long")
    return partial.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class Words:
    """Words of a batch as flat arrays of letters, with the hashes that edits are derived from."""

    def __init__(self, column: pa.Array):
        self.column = column
        words = column.to_pylist()
        self.length = np.fromiter(map(len, words), np.int64, len(words))
        self.letter = np.frombuffer(b"".join(words), np.uint8)
        self.start = np.cumsum(self.length) - self.length
        self.word = np.repeat(np.arange(len(words)), self.length)
        place = np.arange(len(self.letter)) - self.start[self.word]
        power, inverse = powers(int(self.length.max(initial=1)) + 1)
        self.place, self.power, self.back = place, power[place], inverse[1]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((self.letter.astype(np.uint64) + np.uint64(1)) * self.power)])
        self.hash = total[self.start + self.length] - total[self.start]
        self.before = total[:-1] - total[self.start[self.word]]  # hash of the letters before each one
        self.after = self.hash[self.word] - (total[1:] - total[self.start[self.word]])

    def deletions(self) -> tuple[np.ndarray, np.ndarray]:
        """Flat places whose letter may go (the first of equal neighbours), and the hashes without it."""
        same = np.concatenate([[False], (self.letter[1:] == self.letter[:-1]) & (self.place[1:] > 0)])[:len(self.letter)]
        at = np.flatnonzero(~same)
        return at, self.before[at] + self.after[at] * self.back

    def replaced(self, at: np.ndarray, letter: int) -> np.ndarray:
        """Hashes with the letters at the flat places ``at`` replaced by ``letter``."""
        return self.hash[self.word[at]] + (np.uint64(letter) - self.letter[at]) * self.power[at]

    def edited(self, at: np.ndarray, letter: np.ndarray) -> pa.Array:
        """The words of the flat places ``at`` with that letter replaced, or deleted where ``letter`` is 0."""
        word = self.word[at]
        size = self.length[word]
        begin = np.cumsum(size) - size
        flat = np.repeat(self.start[word] - begin, size) + np.arange(int(size.sum()))
        out = self.letter[flat]
        spot = begin + self.place[at]
        out[spot] = letter
        out = np.delete(out, spot[letter == 0])
        offsets = np.concatenate([[0], np.cumsum(size - (letter == 0))]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Filters:
    """Blocked Bloom filters: ``blocks[s]`` blocks of 512 bits for the words of length s, one after the other."""

    def __init__(self, blocks: np.ndarray, bits: np.ndarray | None = None):
        self.blocks = blocks.astype(np.uint64)
        self.first = (np.cumsum(blocks) - blocks).astype(np.uint64)
        self.bits = np.zeros(int(blocks.sum()) * BLOCK_BITS // 64, np.uint64) if bits is None else bits

    def _places(self, x: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        block = self.first[shard] + (x >> np.uint64(32)) % np.maximum(self.blocks[shard], np.uint64(1))
        return block * np.uint64(BLOCK_BITS), x * np.uint64(0x9E3779B97F4A7C15)

    def add(self, hashes: np.ndarray, shard: np.ndarray) -> None:
        base, more = self._places(_mixed(hashes), shard)
        for i in range(PROBES):
            bit = base + ((more >> np.uint64(1 + 9 * i)) & np.uint64(511))
            np.bitwise_or.at(self.bits, bit >> np.uint64(6), np.uint64(1) << (bit & np.uint64(63)))

    def hits(self, hashes: np.ndarray, shard: np.ndarray) -> np.ndarray:
        """Places in ``hashes`` of those that may be in."""
        left = np.flatnonzero(self.blocks[shard])
        base, more = self._places(_mixed(hashes[left]), shard[left])
        for i in range(PROBES):
            bit = base + ((more >> np.uint64(1 + 9 * i)) & np.uint64(511))
            on = np.flatnonzero((self.bits[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1))
            left, base, more = left[on], base[on], more[on]
        return left


def _shard(length: np.ndarray) -> np.ndarray:
    return np.minimum(length, LONGEST)


def filters(spark: SparkSession, words: DataFrame, bits: int, filter_bytes: int) -> tuple[Filters, list[int]]:
    """The filters of ``words`` (key) and the letters that occur. The driver holds at most ``filter_bytes`` and a block a length."""
    def shape(batches):
        number, letters = np.zeros(LONGEST + 1, np.int64), np.zeros(256, bool)
        for batch in batches:
            w = Words(batch.column("key"))
            number += np.bincount(_shard(w.length), minlength=LONGEST + 1)
            letters[w.letter] = True
        mask = np.packbits(letters, bitorder="little").view(np.int64).tolist()
        s = np.flatnonzero(number)
        yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(number[s]), *(pa.array([m] * len(s), pa.int64()) for m in mask)],
                                         names=["shard", "n", "l0", "l1", "l2", "l3"])

    rows = words.select("key").mapInArrow(shape, "shard int, n long, l0 long, l1 long, l2 long, l3 long").groupBy("shard").agg(
        F.sum("n"), *[F.bit_or(f"l{i}") for i in range(4)]).collect()
    number, mask = np.zeros(LONGEST + 1, np.int64), np.zeros(4, np.int64)
    for row in rows:
        number[row[0]] = row[1]
        mask |= np.array(row[2:], np.int64)
    letters = np.flatnonzero(np.unpackbits(mask.view(np.uint8), bitorder="little")).tolist()
    share = min(1.0, 8 * filter_bytes / max(bits * int(number.sum()), 1))
    layout = np.where(number > 0, np.maximum(np.ceil(number * bits * share / BLOCK_BITS), 1), 0).astype(np.int64)

    def build(batches):
        mine = Filters(layout)
        for batch in batches:
            w = Words(batch.column("key"))
            mine.add(w.hash, _shard(w.length))
        block = np.flatnonzero(mine.bits.reshape(-1, 8).any(1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(block), *(pa.array(c.view(np.int64)) for c in np.ascontiguousarray(mine.bits.reshape(-1, 8)[block].T))],
            names=["block", *(f"b{i}" for i in range(8))])

    made = words.select("key").mapInArrow(build, "block long, " + ", ".join(f"b{i} long" for i in range(8))).groupBy("block").agg(
        *[F.bit_or(f"b{i}").alias(f"b{i}") for i in range(8)]).toArrow()
    out = Filters(layout)
    out.bits.reshape(-1, 8)[made.column("block").to_numpy()] = np.column_stack(
        [made.column(f"b{i}").to_numpy().view(np.uint64) for i in range(8)])
    return out, letters


def positives(words: DataFrame, found: Filters, letters: list[int]) -> DataFrame:
    """(a, an, b): words of ``words`` (key, n) and those of their edits that pass the filters, each pair of words once."""
    shared = words.sparkSession.sparkContext.broadcast(found)

    def run(batches):
        test = shared.value
        for batch in batches:
            keys, number = batch.column("key"), batch.column("n").to_numpy()
            w = Words(keys)

            def rows(at, letter, w=w, keys=keys, number=number):
                return pa.RecordBatch.from_arrays([keys.take(pa.array(w.word[at])), pa.array(number[w.word[at]]), w.edited(at, letter)],
                                                  names=["a", "an", "b"])

            gone, value = w.deletions()
            for i in range(0, len(gone), PIECE):
                at = gone[i:i + PIECE]
                hit = at[test.hits(value[i:i + PIECE], _shard(w.length[w.word[at]] - 1))]
                yield rows(hit, np.zeros(len(hit), np.uint8))
            for i in range(0, len(w.letter), PIECE):
                here = np.arange(i, min(i + PIECE, len(w.letter)))
                shard = _shard(w.length[w.word[here]])
                for letter in letters:
                    lower = np.flatnonzero(w.letter[here] < letter)
                    hit = here[lower[test.hits(w.replaced(here[lower], letter), shard[lower])]]
                    if len(hit):
                        yield rows(hit, np.full(len(hit), letter, np.uint8))

    return words.select("key", "n").mapInArrow(run, "a binary, an long, b binary")


def variants(docs: DataFrame, shortest: int = 6, least: int = 5, times: int = 5, drop_every: int | None = None, bits: int = 14,
             filter_bytes: int = 32 << 20) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word with ``shortest`` letters that occurs ``least`` times or more.

    ``times``: how often a form must occur for each time the word does.
    ``drop_every`` deletes a letter of some occurrences first (see ``counted``).
    ``bits``: filter bits a word, as long as all filters fit ``filter_bytes``.
    """
    words = pinned(vocabulary(docs, shortest, least, drop_every))
    found, letters = filters(docs.sparkSession, words, bits, filter_bytes)
    exact = words.select(F.col("key").alias("b"), F.col("n").alias("bn"))
    pairs = pinned(positives(words, found, letters).join(exact, "b"))
    near = pairs.select(F.col("a").alias("key"), F.col("b").alias("other"), F.col("bn").alias("m")).unionAll(
        pairs.select(F.col("b").alias("key"), F.col("a").alias("other"), F.col("an").alias("m")))
    best = near.groupBy("key").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    frequent = -F.col("best.m") >= times * F.col("n")
    named = pinned(words.join(best, "key", "left").select(
        "key", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(frequent, F.col("best.other")).alias("form"), F.when(frequent, -F.col("best.m")).alias("form_n")))
    # A form occurs more often than its word, so chains end. Each round doubles the steps that ``top`` is ahead.
    top = pinned(named.where("form is not null").select("key", F.col("form").alias("top")))
    while True:
        ahead = top.select(F.col("key").alias("top"), F.col("top").alias("next"))
        step = pinned(top.join(ahead, "top", "left").select("key", F.coalesce("next", "top").alias("top"), F.col("next").isNotNull().alias("moved")))
        top = step.select("key", "top")
        if step.where("moved").isEmpty():
            break
    text = lambda c: F.decode(c, "ISO-8859-1")
    return named.join(top, "key", "left").select(
        text("key").alias("word"), "n", "n_near", text("form").alias("form"), "form_n", text(F.coalesce("top", "key")).alias("root"))


def op12_spelling_variants(spark, sf_dir):
    return variants(documents(spark, sf_dir), drop_every=199)


QUERIES = {"op12_spelling_variants": op12_spelling_variants}

# The CRC-32 is folded byte by byte over a table made in SQL; words with one letter masked in the same place differ by a
# replaced letter, a word with one letter taken out equals its shorter neighbour.
ORACLE = {"op12_spelling_variants": """
WITH RECURSIVE crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) r(i))),
runs AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 6 GROUP BY ALL),
coded AS (SELECT run, k, hex(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run) AS x FROM runs),
hashed AS (SELECT run, k, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(length(x) // 2),
    lambda i: CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h FROM coded, crc),
words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run))
    || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed) WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
masked AS (SELECT word, i, left(word, i - 1) || '*' || substr(word, i + 1) AS mask FROM places),
pairs AS (SELECT a.word AS a, b.word AS b FROM masked a JOIN masked b ON a.mask = b.mask AND a.i = b.i AND a.word <> b.word
    UNION SELECT p.word, w.word FROM places p JOIN words w ON w.word = left(p.word, i - 1) || substr(p.word, i + 1)
    UNION SELECT w.word, p.word FROM places p JOIN words w ON w.word = left(p.word, i - 1) || substr(p.word, i + 1)),
ranked AS (SELECT a, b, w.n AS m, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY w.n DESC, b) AS r
    FROM pairs JOIN words w ON w.word = b),
formed AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * n THEN b END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n
    FROM words LEFT JOIN ranked ON a = word AND r = 1),
chain AS (SELECT word, word AS here, 0 AS depth FROM formed
    UNION ALL SELECT c.word, f.form, depth + 1 FROM chain c JOIN formed f ON f.word = c.here WHERE f.form IS NOT NULL)
SELECT f.word, n, n_near, form, form_n, root FROM formed f JOIN (SELECT word, arg_max(here, depth) AS root FROM chain GROUP BY word) USING (word)"""}
