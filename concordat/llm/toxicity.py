"""Operator 13, toxicity by a bidirectional gated recurrent network with attention pooling.

A text is cut into overlapping windows of ``WINDOW`` words, ``STRIDE`` apart, the
last one at its end. A word enters as the vector of its hash (word input) beside
the mean vector of its letter trigrams, boundaries marked (character input). Two
gated recurrent units read a window forwards and backwards; attention weighs their
states; a linear layer gives the window's logit. A text's score is that of its
worst window, calibrated to a probability. All windows of whole texts are scored,
in Arrow batches, with each distinct word of a block projected once; there is no
shuffle.

The network is trained in numpy on the driver, on at most ``bound`` labelled
documents, half of each kind as far as there are so many (those with the
smallest hash of their id), each with at most ``windows`` windows (those with the
smallest CRC) of at most ``WINDOW_BYTES``. The label belongs to the whole document,
so windows take it over in the first epoch; then a toxic document teaches by the
window that the network itself finds worst, as far as it believes it, and clean
documents by theirs and some others. A fifth of the documents is left out to
calibrate on, and rows whose id's CRC is divisible by 5 take no part, to measure on.

Edge cases: null and empty texts are one window without words; with no labels,
or only one kind, every score is the share of toxic ones (0 without any); repeated
rows and null ids get a row each, and an id that several documents have teaches once; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.llm.common import blocks, bounded_sample, documents, map_texts
from concordat.llm.grams import BASE, SPACE, Block
from concordat.llm.labelled import fold, platt, sigmoid

WINDOW, STRIDE, WINDOW_BYTES = 32, 16, 8192
WORD_BITS, GRAM_BITS, WORD_SIZE, GRAM_SIZE, HIDDEN, LOOK = 12, 12, 12, 12, 8, 8
BATCH = 1024


@dataclass
class Inputs:
    """Distinct words: the bucket of each, and the buckets of the trigrams of all, one word after the other."""

    hash: np.ndarray
    word: np.ndarray
    gram: np.ndarray
    number: np.ndarray

    def take(self, at: np.ndarray) -> Inputs:
        begin, size = (np.cumsum(self.number) - self.number)[at], self.number[at]
        flat = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return Inputs(self.hash[at], self.word[at], self.gram[flat], size)


def inputs(block: Block) -> tuple[Inputs, np.ndarray]:
    """The distinct words of a block of lower-cased texts, and which of them each of its words is."""
    value, at, each = np.unique(block.hash, return_index=True, return_inverse=True)
    begin, size = block.begin[at], (block.end - block.begin)[at]
    marked = np.concatenate([[32], np.where(SPACE[block.raw], 32, block.raw)]).astype(np.uint64)
    flat = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    grams = (marked[flat] << np.uint64(16)) | (marked[flat + 1] << np.uint64(8)) | marked[flat + 2]
    return Inputs(value, ((value * BASE) >> np.uint64(64 - WORD_BITS)).astype(np.int64),
                  ((grams * BASE) >> np.uint64(64 - GRAM_BITS)).astype(np.int64), size), each


def windows(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word in it, number of words) of every window, for texts with so many words each."""
    number = np.where(words <= WINDOW, 1, -(-(words - WINDOW) // STRIDE) + 1)
    text = np.repeat(np.arange(len(words)), number)
    step = np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)
    first = np.minimum(step * STRIDE, np.maximum(words[text] - WINDOW, 0))
    return text, first, np.minimum(words[text], WINDOW)


@dataclass
class Network:
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    slope: float = 1.0
    offset: float = 0.0

    @staticmethod
    def fresh(seed: int) -> Network:
        r = np.random.default_rng(seed)
        size = WORD_SIZE + GRAM_SIZE
        shapes = {"word": (1 << WORD_BITS, WORD_SIZE), "gram": (1 << GRAM_BITS, GRAM_SIZE), "look": (2 * HIDDEN, LOOK), "query": (LOOK,),
                  "out": (2 * HIDDEN,), "bias": (1,)}
        for d in "fb":
            shapes |= {f"in_{d}": (size, 3 * HIDDEN), f"rec_{d}": (HIDDEN, 3 * HIDDEN), f"shift_{d}": (3 * HIDDEN,)}
        spread = {"word": 0.3, "gram": 0.3, "bias": 0.0, "shift_f": 0.0, "shift_b": 0.0}
        return Network({k: (r.standard_normal(s) * spread.get(k, s[0] ** -0.5)).astype(np.float32) for k, s in shapes.items()})

    def vectors(self, words: Inputs) -> np.ndarray:
        w = self.weights
        out = np.zeros((len(words.word), WORD_SIZE + GRAM_SIZE), np.float32)
        out[:, :WORD_SIZE] = w["word"][words.word]
        if len(words.gram):
            out[:, WORD_SIZE:] = np.add.reduceat(w["gram"][words.gram], np.cumsum(words.number) - words.number) / words.number[:, None]
        return out

    def project(self, vectors: np.ndarray) -> dict[str, np.ndarray]:
        """Each word's part of the gates' inputs in both directions; the last row is for places without a word."""
        return {d: np.concatenate([vectors @ self.weights[f"in_{d}"] + self.weights[f"shift_{d}"], np.zeros((1, 3 * HIDDEN), np.float32)])
                for d in "fb"}

    def read(self, projected: dict[str, np.ndarray], idx: np.ndarray, there: np.ndarray | None, keep: dict | None = None):
        """Logits of windows (word numbers, a row each); ``there`` (0 or 1) marks real words if some places are empty."""
        w, (rows, length) = self.weights, idx.shape
        states = np.empty((length, rows, 2 * HIDDEN), np.float32)
        for side, d in enumerate("fb"):
            h, part, rec = np.zeros((rows, HIDDEN), np.float32), projected[d], w[f"rec_{d}"]
            for t in (range(length) if d == "f" else range(length - 1, -1, -1)):
                x, back = part[idx[:, t]], h @ rec
                gates = x[:, :2 * HIDDEN] + back[:, :2 * HIDDEN]
                gates *= 0.5
                np.tanh(gates, out=gates)
                gates += 1
                gates *= 0.5  # the logistic function, by way of tanh
                z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
                n = np.tanh(x[:, 2 * HIDDEN:] + r * back[:, 2 * HIDDEN:])
                new = n + z * (h - n)
                if there is not None:
                    new = h + there[:, t:t + 1] * (new - h)
                if keep is not None:
                    keep[d, t] = h, z, r, n, back[:, 2 * HIDDEN:]
                h = new
                states[t, :, side * HIDDEN:(side + 1) * HIDDEN] = h
        seen = np.tanh(states @ w["look"])
        weight = seen @ w["query"]
        weight = np.exp(weight - weight.max(0))
        if there is not None:
            weight = weight * there.T
        weight /= np.maximum(weight.sum(0), 1e-20)
        pooled = (weight[:, :, None] * states).sum(0)
        if keep is not None:
            keep["top"] = states, seen, weight, pooled
        return pooled @ w["out"] + w["bias"][0]

    def gradient(self, words: Inputs, idx: np.ndarray, there: np.ndarray, pull) -> dict[str, np.ndarray]:
        """Gradients of a loss whose derivative by the logits is ``pull(logits)``."""
        w, keep = self.weights, {}
        length = idx.shape[1]
        vectors = self.vectors(words)
        dl = pull(self.read(self.project(vectors), idx, there, keep)).astype(np.float32)
        states, seen, weight, pooled = keep["top"]
        out = {"out": pooled.T @ dl, "bias": dl.sum(keepdims=True)}
        dpool = dl[:, None] * w["out"]
        dweight = (states * dpool).sum(2)
        ds = weight * (dweight - (weight * dweight).sum(0))
        out["query"] = np.einsum("tb,tbk->k", ds, seen)
        dseen = ds[:, :, None] * w["query"] * (1 - seen * seen)
        out["look"] = states.reshape(-1, 2 * HIDDEN).T @ dseen.reshape(-1, LOOK)
        dstates = weight[:, :, None] * dpool + dseen @ w["look"].T
        dvectors = np.zeros_like(vectors)
        order = np.argsort(idx.T.ravel(), kind="stable")
        used, first = np.unique(idx.T.ravel()[order], return_index=True)
        for side, d in enumerate("fb"):
            rec, dh = w[f"rec_{d}"], np.zeros((len(idx), HIDDEN), np.float32)
            dx, drec = np.zeros((length, len(idx), 3 * HIDDEN), np.float32), np.zeros_like(rec)
            for t in (range(length - 1, -1, -1) if d == "f" else range(length)):
                h, z, r, n, back = keep[d, t]
                dh = dh + dstates[t, :, side * HIDDEN:(side + 1) * HIDDEN]
                m = there[:, t:t + 1]
                new = dh * m
                dn = new * (1 - z) * (1 - n * n)
                dz, dr = new * (h - n) * z * (1 - z), dn * back * r * (1 - r)
                dx[t] = np.concatenate([dz, dr, dn], 1)
                dback = np.concatenate([dz, dr, dn * r], 1)
                drec += h.T @ dback
                dh = dh * (1 - m) + new * z + dback @ rec.T
            dp = np.add.reduceat(dx.reshape(-1, 3 * HIDDEN)[order], first)
            dp = dp[used < len(vectors)]
            real = used[used < len(vectors)]
            out[f"rec_{d}"], out[f"shift_{d}"], out[f"in_{d}"] = drec, dp.sum(0), vectors[real].T @ dp
            dvectors[real] += dp @ w[f"in_{d}"].T
        out["word"] = _scattered(words.word, dvectors[:, :WORD_SIZE], 1 << WORD_BITS)
        each = dvectors[:, WORD_SIZE:] / np.maximum(words.number, 1)[:, None]
        out["gram"] = _scattered(words.gram, np.repeat(each, words.number, axis=0), 1 << GRAM_BITS)
        return out

    def worst(self, texts: list[bytes]) -> np.ndarray:
        """The highest logit among the windows of each text."""
        block = Block([t.lower() for t in texts])
        words, each = inputs(block)
        projected, none = self.project(self.vectors(words)), len(words.word)
        text, first, size = windows(block.words)
        logit = np.empty(len(text))
        for whole in (True, False):
            rows = np.flatnonzero((size == WINDOW) == whole)
            for i in range(0, len(rows), BATCH):
                idx, there = _laid(each, block.first[text[rows[i:i + BATCH]]] + first[rows[i:i + BATCH]], size[rows[i:i + BATCH]], none)
                logit[rows[i:i + BATCH]] = self.read(projected, idx, None if whole else there)
        return np.maximum.reduceat(logit, np.searchsorted(text, np.arange(len(texts)))) if len(texts) else logit

    def score(self, texts: list[bytes]) -> np.ndarray:
        return sigmoid(self.slope * self.worst(texts) + self.offset)


def _laid(each: np.ndarray, first: np.ndarray, size: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of windows, ``none`` in places without a word, and 0 or 1 for those places."""
    place = np.arange(int(size.max(initial=0)) or 1)
    there = place < size[:, None]
    if not len(each):
        return np.full(there.shape, none), there.astype(np.float32)
    return np.where(there, each[np.minimum(first[:, None] + place, len(each) - 1)], none), there.astype(np.float32)


def _scattered(at: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    return np.stack([np.bincount(at, column, size) for column in rows.T], 1).astype(np.float32)


@dataclass
class Examples:
    """Windows of the labelled sample: word numbers, places in use, and the document (a number) of each; labels by document."""

    words: Inputs
    idx: np.ndarray
    there: np.ndarray
    doc: np.ndarray
    label: np.ndarray

    def part(self, rows: np.ndarray) -> tuple[Inputs, np.ndarray, np.ndarray]:
        used, local = np.unique(self.idx[rows], return_inverse=True)
        none = len(self.words.word)
        real = used[used < none]
        return self.words.take(real), local.reshape(len(rows), -1), self.there[rows]


def examples(texts: list[list[bytes]], label: np.ndarray) -> Examples:
    """``texts``: the windows of each document."""
    flat, doc = [w.lower() for t in texts for w in t], np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    parts, at, held = [], 0, 0
    for i, t in enumerate([*flat, None]):  # in pieces: a block takes many times its bytes
        if t is None or held > 1 << 19:
            block = Block(flat[at:i])
            words, each = inputs(block)
            parts.append((words, words.hash[each], block.words))
            at = i
            held = 0
        held += len(t or b"")
    every = np.concatenate([p[0].hash for p in parts])
    _, first = np.unique(every, return_index=True)
    words = Inputs(every, *(np.concatenate([getattr(p[0], n) for p in parts]) for n in ("word", "gram", "number"))).take(first)
    each = np.searchsorted(words.hash, np.concatenate([p[1] for p in parts]))
    size = np.concatenate([p[2] for p in parts])
    idx, there = _laid(each, np.cumsum(size) - size, size, len(words.word))
    return Examples(words, idx, there, doc, label)


def _logits(net: Network, data: Examples) -> np.ndarray:
    projected = net.project(net.vectors(data.words))
    return np.concatenate([net.read(projected, data.idx[i:i + BATCH], data.there[i:i + BATCH]) for i in range(0, len(data.idx), BATCH)])


def train(data: Examples, seed: int = 13, first: int = 1, later: int = 6, batch: int = 128, rate: float = 0.01,
          decay: float = 0.05) -> Network | None:
    """The network fitted to ``data``; None if there is nothing to learn."""
    teaches = np.arange(len(data.label)) % 5 != 4
    if any(len(set(data.label[p])) < 2 for p in (teaches, ~teaches)):
        return None
    net, r = Network.fresh(seed), np.random.default_rng(seed)
    m, v = ({k: np.zeros_like(x) for k, x in net.weights.items()} for _ in range(2))
    toxic, step = data.label[data.doc] == 1, 0
    fit = np.flatnonzero(teaches[data.doc])
    for epoch in range(first + later):
        if epoch < first:
            rows, goal = fit, toxic[fit].astype(float)
        else:
            logit = _logits(net, data)
            order = np.lexsort((-logit, data.doc))
            worst = order[np.searchsorted(data.doc[order], np.arange(len(data.label)))]
            worst = worst[teaches]
            some = r.permutation(fit[~toxic[fit]])[:2 * int((data.label[teaches] == 0).sum())]
            rows = np.concatenate([worst, some])
            goal = np.where(toxic[rows], sigmoid(logit[rows]), 0.0)
        share = np.where(toxic[rows], 0.5 / max(goal.sum(), 1.0), 0.5 / max(int((~toxic[rows]).sum()), 1)) * len(rows)
        # A toxic document counts as far as its worst window is believed; what it teaches is always 1.
        weight = np.where(toxic[rows], goal, 1.0) * share
        goal = toxic[rows].astype(float)
        mixed = r.permutation(len(rows))
        for i in range(0, len(rows), batch):
            at = mixed[i:i + batch]
            words, idx, there = data.part(rows[at])
            g = net.gradient(words, idx, there, lambda z, at=at: (sigmoid(z) - goal[at]) * weight[at] / len(at))
            step += 1
            for k, x in net.weights.items():
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.001 * (g[k] * g[k] - v[k])
                x -= rate * decay * x
                x -= rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
    logit = np.full(len(data.label), -np.inf)
    np.maximum.at(logit, data.doc, _logits(net, data))
    net.slope, net.offset = platt(logit[~teaches], data.label[~teaches])
    return net


def _sampled_windows(text: bytes, most: int) -> bytes:
    """At most ``most`` windows of a text, a line each."""
    words = text.split()
    _, first, _ = windows(np.array([len(words)]))
    cut = [b" ".join(words[a:a + WINDOW]) for a in first.tolist()]
    cut = sorted({c for c in cut if len(c) <= WINDOW_BYTES}, key=lambda c: (zlib.crc32(c), c))
    return b"\n".join(cut[:most])


def fitted(docs: DataFrame, labels: DataFrame, label: str, bound: int, most: int) -> Network | float:
    """The trained network, or the share of toxic labels where it can't be trained."""
    known = labels.select("doc_id", F.col(label).cast("double").alias("label")).where(
        "label in (0, 1) and doc_id is not null").where(fold("doc_id") != 0).groupBy("doc_id").agg(F.max("label").alias("label"))
    half = [bounded_sample(known.where(F.col("label") == kind), "doc_id", bound // 2) for kind in (0, 1)]
    # At most ``bound`` rows of an id and a number.
    texts = docs.select("doc_id", "text").join(F.broadcast(half[0].unionAll(half[1])), "doc_id")
    rows = map_texts(texts, "windows binary", lambda t: {"windows": pa.array([_sampled_windows(x, most) for x in t], pa.binary())},
                     keep=("doc_id", "label"))
    got = rows.groupBy("doc_id", "label").agg(F.min("windows").alias("windows")).toPandas()
    got = got.sort_values("doc_id", key=lambda ids: ids.map(lambda x: zlib.crc32(str(x).encode())), kind="stable")
    y = got["label"].to_numpy(float)
    net = train(examples([bytes(w).split(b"\n") for w in got["windows"]], y)) if len(set(y)) > 1 else None
    return float(y.mean()) if net is None and len(y) else net or 0.0


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = 1600, windows: int = 40,
             toxic_at: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; see the module's text."""
    model = fitted(docs, labels, label, bound, windows)
    rows = map_texts(docs, "score double", lambda texts: {
        "score": model.score(texts) if isinstance(model, Network) else np.full(len(texts), model)})
    return rows.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= toxic_at).cast("int").alias("predicted"))


def op13_toxicity(spark, sf_dir):
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op13_toxicity": op13_toxicity}
