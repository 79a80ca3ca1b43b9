"""Operator 9, quality rules: base rules and a calibrated n-gram logistic regression.

Base rules count words, symbols, repeated lines and repeated runs of three
words. The method's verdict is a logistic regression on hashed word and
character n-grams (1 and 2 words, 3 and 5 bytes), fitted on labelled quality
rows, calibrated to probabilities on rows it was not fitted on, and held against
a fixed threshold. Texts are scored whole, in Arrow batches, in the same pass
that counts; there is no shuffle.

Fitted on at most ``bound`` labelled rows; a fifth of them calibrates. Rows whose
id's CRC is divisible by 5 are left out of both, to measure on.

Edge cases: null and empty texts have no words and fail the base rules; with no
labels, or only one kind, the base rules alone decide; repeated rows and null ids
get a row each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.llm.common import blocks, documents, map_texts
from concordat.llm.grams import SPACE, Block, dot, profile
from concordat.llm.labelled import descend, platt, sample, scaling, sigmoid

FAMILIES = {"w1": 10, "w2": 10, "c3": 10, "c5": 10}
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
#: Bytes that begin a character and are not white space.
CHARACTERS = ((np.arange(256) & 0xC0) != 0x80) & ~SPACE
WINDOW = 3


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def repeated_words(text: bytes) -> int:
    """Words in windows of three that occur twice or more, first occurrences too."""
    words = text.split()
    windows = list(zip(*(words[i:] for i in range(WINDOW))))
    seen: dict[tuple, int] = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    marked = np.zeros(len(words) + 1, np.int64)
    for i, w in enumerate(windows):
        if seen[w] > 1:
            marked[i:i + WINDOW] = 1
    return int(marked.sum())


def counts(texts: list[bytes], block: Block) -> dict[str, np.ndarray]:
    """The base counts of each text."""
    # Equal hashes in a text are looked at word by word; without any there is no repeat.
    again = block.repeats(*block.windows(WINDOW))
    return {"n_words": block.words.astype(np.int64), "word_chars": block.count(CHARACTERS), "n_symbols": block.count(SYMBOLS),
            "n_dup_lines": np.array([repeated_lines(t) for t in texts], np.int64),
            "n_repeat_words": np.array([repeated_words(t) if n else 0 for t, n in zip(texts, again.tolist())], np.int64)}


def learn(x: np.ndarray, label: np.ndarray, steps: int = 150, decay: float = 1e-3) -> tuple[np.ndarray, float, float] | None:
    """(weights, slope, offset) of P(good) = logistic(slope * (x @ weights) + offset); None if there is nothing to learn."""
    train = np.arange(len(label)) % 5 != 4
    if any(len(set(label[part])) < 2 for part in (train, ~train)):
        return None
    scale = scaling(x[train])
    x *= scale  # in place: the rows are not needed as they were
    rows, goal = x[train], label[train]
    # Both kinds weigh the same, or the rarer one is not learnt.
    weight = np.where(goal == 1, 0.5 / goal.sum(), 0.5 / (len(goal) - goal.sum()))
    bias = np.ones(len(rows), np.float32)

    def gradient(w):
        pull = ((sigmoid(rows @ w[1:].astype(np.float32) + w[0]) - goal) * weight).astype(np.float32)
        return np.concatenate([[pull @ bias], rows.T @ pull + decay * w[1:]])

    w = descend(gradient, x.shape[1] + 1, steps)
    slope, offset = platt(x[~train] @ w[1:] + w[0], label[~train])
    return w[1:] * scale, slope, offset + slope * w[0]


def fitted(docs: DataFrame, labels: DataFrame, label: str, bound: int):
    x, y, _ = sample(docs, labels, label, lambda texts: profile(Block(texts), FAMILIES), bound)
    return learn(x, y)


def _judge(texts: list[bytes], model, keep_at: float, min_words: int, most_repeated: float) -> dict[str, np.ndarray]:
    block = Block(texts)
    out = counts(texts, block)
    failed = (out["n_words"] < min_words) | (100 * out["n_repeat_words"] > most_repeated * out["n_words"])
    p = np.ones(len(texts)) if model is None else sigmoid(model[1] * dot(block, FAMILIES, model[0]) + model[2])
    return {**out, "base_failed": failed, "p_good": p, "kept": ~failed & (p >= keep_at)}


def rules(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = 3000, keep_at: float = 0.5,
          min_words: int = 50, most_repeated: float = 50) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, p_good, kept) of every
    document; see the module's text."""
    model = fitted(docs, labels, label, bound)
    return map_texts(docs, "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
                     "base_failed boolean, p_good double, kept boolean",
                     lambda texts: _judge(texts, model, keep_at, min_words, most_repeated))


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = 3000, keep_at: float = 0.5,
              min_words: int = 50, most_repeated: float = 50) -> DataFrame:
    """Rows of ``docs`` that pass, in one pass and without a join."""
    model = fitted(docs, labels, label, bound)

    def run(batches):
        for part, texts in blocks(batches):
            yield part.filter(pa.array(_judge(texts, model, keep_at, min_words, most_repeated)["kept"]))

    return docs.mapInArrow(run, docs.schema)


def op9_quality_rules(spark, sf_dir):
    return rules(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op9_quality_rules": op9_quality_rules}
