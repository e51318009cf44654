"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of every text are computed once. The trees are grown level by level on binned statistics (at most ``BINS`` bins a
column) and flattened into arrays of split columns, thresholds and leaf values, which numpy traverses for all rows of a
batch at once: ``at = 2 * at + 1 + (x[column[at]] > threshold[at])``.

Fitting reads the statistics of at most ``SAMPLE`` labelled documents (least hashes of their ids); scoring covers every text.
Labels, lang, source and ids are no inputs of a score.

Defined results: null counts as empty; an empty text has all-zero statistics and is scored like any other; texts are read
whole; repeated rows get equal scores; labels given twice count with the larger value, null labels not at all; of the rows that
share a labelled id those with the least statistics are learnt from; without
labelled rows all scores are 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import kernel as K
from quern.llm.quality_rules import _DIGIT, _LOWER, _SHOUT, _UPPER, Batch, _table
from quern.llm.tables import arrow_map, parquet, stage
from quern.llm.toxicity import held_out

SAMPLE = 20_000
BINS, DEPTH, TREES, RATE, L2, MIN_HESSIAN = 64, 4, 80, 0.15, 1.0, 2.0
_PUNCT, _END = _table(".,;:"), _table(".?!:")
STATISTICS = ["log_chars", "log_words", "word_length", "symbols", "shouts", "upper", "digits", "repeats", "stutter", "dup_lines", "punctuation", "distinct", "top_word", "line_words", "ended_lines", "non_ascii", "pipes", "short_words"]


def statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(texts, STATISTICS) as float32."""
    b = Batch(data, offs)
    w = b.words
    n = np.diff(w.at)
    one, letters = np.maximum(n, 1), np.maximum(b.count(_UPPER) + b.count(_LOWER), 1)
    chars = K.code_points(data, offs)
    full, dup = b.lines
    doc = np.repeat(np.arange(len(b), dtype=np.uint64), n)
    with np.errstate(over="ignore"):
        key = np.sort(K.mix(w.hash ^ (doc + K.U(1)) * K._GRAM[11]))
        back = K.mix(w.hash ^ (doc + K.U(1)) * K._GRAM[11])
    distinct, top = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
    if len(key):
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        times = np.diff(head, append=len(key))
        owner = np.zeros(len(head), np.int64)
        owner[np.searchsorted(key[head], back)] = doc
        distinct = np.bincount(owner, minlength=len(b))
        np.maximum.at(top, owner, times)
    ends = np.zeros(len(b), np.int64)
    last = np.flatnonzero(data == 10)
    last = last[last > 0]
    np.add.at(ends, np.searchsorted(offs, last, "right") - 1, _END[data[last - 1]])
    tail = offs[1:][np.diff(offs) > 0] - 1
    ends[np.flatnonzero(np.diff(offs) > 0)] += _END[data[tail]]
    short = K.sums((w.end - w.start) <= 3, w.at)
    cols = [np.log1p(chars), np.log1p(n), b.word_chars / one, b.n_symbols / one, b.count(_SHOUT) / one, b.count(_UPPER) / letters, b.count(_DIGIT) / np.maximum(chars, 1), b.n_repeat_words / one, b.n_stutter / one, dup / np.maximum(full, 1), b.count(_PUNCT) / one, distinct / one, top / one, n / np.maximum(full, 1), ends / np.maximum(full, 1), K.sums(data >= 128, offs) / np.maximum(chars, 1), b.count(_table("|")) / one, short / one]
    return np.stack(cols, 1).astype(np.float32)


class Trees:
    """Flattened trees: ``column``, ``threshold`` (trees, 2^depth - 1) and ``leaf`` (trees, 2^depth), and the prior's logit."""

    def __init__(self, column: np.ndarray, threshold: np.ndarray, leaf: np.ndarray, prior: float):
        self.column, self.threshold, self.leaf, self.prior = column, threshold, leaf, prior

    def score(self, x: np.ndarray) -> np.ndarray:
        z, rows, inner = np.full(len(x), self.prior), np.arange(len(x)), self.column.shape[1] if len(self.column) else 0
        for column, threshold, leaf in zip(self.column, self.threshold, self.leaf):
            at = np.zeros(len(x), np.int64)
            while inner and at[:1].size and at[0] < inner:
                at = 2 * at + 1 + (x[rows, column[at]] > threshold[at])
            z += leaf[at - inner]
        return 1 / (1 + np.exp(-z))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS) -> Trees:
    """Boost ``trees`` trees of full ``depth`` on the log-loss of y."""
    inner, none = 2**depth - 1, np.zeros((0, 2**depth - 1))
    if not len(y):
        return Trees(none.astype(np.int64), none, np.zeros((0, inner + 1)), 0.0)
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    prior = float(np.log(rate / (1 - rate)))
    width = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    span = np.arange(width) * bins
    flat, z = binned + span, np.full(len(y), prior)
    columns, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        column, threshold, cut = np.zeros(inner, np.int64), np.full(inner, np.inf), np.full(inner, bins, np.int64)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            base, count = 2**level - 1, 2**level
            key = ((at - base)[:, None] * (width * bins) + flat).ravel()
            sums = [np.bincount(key, np.repeat(q, width), count * width * bins).reshape(count, width, bins).cumsum(2) for q in (g, h)]
            gl, hl = sums
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + L2) + (gt - gl) ** 2 / (ht - hl + L2) - gt**2 / (ht + L2)
            gain[(hl < MIN_HESSIAN) | (ht - hl < MIN_HESSIAN)] = -1
            best = gain.reshape(count, -1)
            spot = best.argmax(1)
            for k in np.flatnonzero(best[np.arange(count), spot] > 1e-6):
                j, c = divmod(int(spot[k]), bins)
                if c < len(edges[j]):
                    column[base + k], threshold[base + k], cut[base + k] = j, edges[j][c], c
            at = 2 * at + 1 + (binned[np.arange(len(y)), column[at]] > cut[at])
        spot = at - inner
        leaf = -RATE * np.bincount(spot, g, inner + 1) / (np.bincount(spot, h, inner + 1) + L2)
        z += leaf[spot]
        columns.append(column)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Trees(np.array(columns), np.array(thresholds), np.array(leaves), prior)


def statistics_table(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the statistics of every text."""

    def one(batch: pa.RecordBatch) -> dict:
        x = statistics(*K.utf8(batch.column(1)))
        return {"doc_id": batch.column(0)} | {c: x[:, i] for i, c in enumerate(STATISTICS)}

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return arrow_map(rows, one, "doc_id long, " + ", ".join(f"{c} float" for c in STATISTICS))


def train(table: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", sample: int = SAMPLE) -> Trees:
    """Fit on the statistics of at most ``sample`` labelled documents, which go to the driver (72 bytes each)."""
    few = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label).cast("int").alias("_y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = table.join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.min(F.struct(*STATISTICS)).alias("x"), F.max("_y").alias("_y"))
    got = rows.select("doc_id", "x.*", "_y").orderBy("doc_id").toPandas()
    return fit(got[STATISTICS].to_numpy(np.float32), got["_y"].to_numpy(np.float64))


def score_table(table: DataFrame, trees: Trees) -> DataFrame:
    """doc_id and score of every row of a table of statistics."""
    model = table.sparkSession.sparkContext.broadcast(trees)

    def one(batch: pa.RecordBatch) -> dict:
        x = np.stack([batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(STATISTICS))], 1)
        return {"doc_id": batch.column(0), "score": model.value.score(x)}

    return arrow_map(table.select("doc_id", *STATISTICS), one, "doc_id long, score double")


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = stage(statistics_table(parquet(spark, sf_dir, "documents")), "statistics")
    trees = train(table, parquet(spark, sf_dir, "labels").where(~held_out()), "quality")
    return score_table(table, trees).select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
