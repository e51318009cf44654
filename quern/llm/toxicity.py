"""Toxicity by multiple-instance learning.

A document is a bag of sentences and only the bag has a label. Each sentence gets p = sigmoid(b + sum of its tokens' weights),
the document 1 - prod(1 - p) (noisy-or). Tokens count by themselves and by their first bytes. The weights are fitted by the documents' log-likelihood, so the model learns which
sentences make a document toxic and can point at them.

Fitting reads at most ``SAMPLE`` labelled documents (those with the least hashes of their ids), whole texts, in one task;
scoring reads every text. Labels, lang, source and ids are no inputs of a score.

Defined results: null, empty and token-less texts have no sentences and score 0; without any labelled row all scores are 0;
a text without sentence marks is one sentence, however long; repeated rows get equal scores; labels given twice count with
the larger value and null labels not at all; of the texts that share a labelled id the least is learnt from; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import kernel as K
from quern.llm.tables import arrow_map, arrow_schema, parquet, small_batches

SAMPLE = 12_000
BITS = 18
PREFIX = 4
ROUNDS, STEP, L1, MIN_DOCS, MIN_Z = 120, 20.0, 0.05, 3, 6.0
_STOP = np.zeros(256, bool)
_STOP[[*b".!?\n"]] = True


def sentences(data: np.ndarray, offs: np.ndarray) -> tuple[K.Words, np.ndarray, np.ndarray]:
    """Tokens, each token's sentence (numbered through the batch), and each text's first sentence (one entry more).

    A sentence ends where . ! ? or a line break stands between two tokens, and with its text.
    """
    w = K.words(data, offs, separator=K.PUNCTUATION, byte=K.FOLDED)
    if not len(w.hash):
        return w, np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    marks = np.concatenate([[0], np.cumsum(_STOP[data], dtype=np.int64)])
    new = np.ones(len(w.hash), bool)
    new[1:] = marks[w.start[1:]] > marks[w.end[:-1]]
    new[w.at[:-1][np.diff(w.at) > 0]] = True
    number = np.cumsum(new)
    return w, number - 1, np.concatenate([[0], number])[w.at]


def _features(data: np.ndarray, w: K.Words, sent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sentence, bucket) of every token and of its first PREFIX bytes, each once a sentence."""
    head = np.zeros(len(w.start), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(PREFIX):
            at = np.minimum(w.start + k, w.end - 1)
            head += np.where(w.start + k < w.end, K.FOLDED[data[at]], K.U(3)) * K._GRAM[20 + k]
        head = K.mix(head)
    bucket = (np.concatenate([w.hash, head]) >> K.U(64 - BITS)).astype(np.int64)
    key = np.unique((np.concatenate([sent, sent]) << BITS) | bucket)
    return key >> BITS, key & ((1 << BITS) - 1)


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))


def screen(n1: np.ndarray, n0: np.ndarray, ones: int, zeros: int) -> np.ndarray:
    """Buckets that take part, from their numbers of positive and negative documents: MIN_DOCS positive ones and a z-score of
    MIN_Z between the classes."""
    ones, zeros = max(1, ones), max(1, zeros)
    share = (n1 + n0) / (ones + zeros)
    z = (n1 / ones - n0 / zeros) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / ones + 1 / zeros))
    return (n1 >= MIN_DOCS) & (z >= MIN_Z)


def fit(sentence: np.ndarray, bucket: np.ndarray, first: np.ndarray, y: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Weights by bucket and the bias, by accelerated proximal gradient steps on the noisy-or log-likelihood.

    sentence, bucket: the screened features; first: each document's first sentence, one entry more; y: labels. An L1 term
    keeps rare buckets at zero, so that single documents aren't learnt by heart. Newton steps move the bias.
    """
    n, size = int(first[-1]), 1 << BITS
    w, b, ones = np.zeros(size), -6.0, max(1, int(y.sum()))
    if not n or not y.any():
        return w, -60.0
    doc = np.repeat(np.arange(len(y)), np.diff(first))
    slot, place = np.unique(bucket, return_inverse=True)
    x = ahead = np.zeros(len(slot))
    pace = 1.0
    for _ in range(rounds):
        z = b + np.bincount(sentence, ahead[place], n)
        s = np.bincount(doc, _softplus(z), len(y))
        p = 1 / (1 + np.exp(-z))
        odds = np.clip(np.expm1(np.minimum(s, 500)), 1e-9, 1e100)
        dz = np.where(y > 0, -1 / odds, 1.0)[doc] * p
        curve = (np.abs(dz) * (1 - p)).sum() + (np.where(y > 0, (1 + 1 / odds) / odds, 0) * np.bincount(doc, p, len(y)) ** 2).sum()
        b -= float(np.clip(dz.sum() / max(curve, 1e-6), -0.5, 0.5))
        new = ahead - STEP / ones * np.bincount(place, dz[sentence], len(slot))
        new = np.clip(np.sign(new) * np.maximum(np.abs(new) - STEP * L1 / ones, 0), -2, 12)
        later = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        push = (pace - 1) / later
        if ((ahead - new) * (new - x)).sum() > 0:
            later, push = 1.0, 0.0
        ahead, x, pace = new + push * (new - x), new, later
    w[slot] = x
    return w, b


def train(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Fit on at most ``sample`` of the labelled documents. The fit runs in one task on an executor."""
    few = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("int").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).cast("string").alias("_text")).join(F.broadcast(few), "_id")
    # one text an id, so that the sample's bound holds for texts, too
    rows = rows.groupBy("_id").agg(F.min("_text").alias("_text"), F.max("_y").alias("_y")).select(F.col("_id").cast("long").alias("id"), "_text", "_y")
    want = arrow_schema("weights binary, bias double")

    def run(batches):
        ids, ys, toks, sents, counts = [], [], [], [], []
        seen = np.zeros((2, 1 << BITS), np.int64)
        for b in batches:
            label = b.column(2).to_pylist()
            # a few documents at a time, so that memory is bounded by what is kept: 8 bytes a feature
            for low in range(0, b.num_rows, 64):
                data, offs = K.utf8(b.column(1).slice(low, 64))
                w, sent, first = sentences(data, offs)
                sent, bucket = _features(data, w, sent)
                at = np.searchsorted(sent, first)
                for i in range(len(offs) - 1):
                    part = slice(at[i], at[i + 1])
                    toks.append(bucket[part].astype(np.int32))
                    sents.append((sent[part] - first[i]).astype(np.int32))
                    counts.append(int(first[i + 1] - first[i]))
                    seen[int(label[low + i] > 0), np.unique(toks[-1])] += 1
            ids += b.column(0).to_pylist()
            ys += label
        y = np.array(ys)
        use = screen(seen[1], seen[0], int((y > 0).sum()), int((y <= 0).sum()))
        for i in range(len(toks)):
            keep = use[toks[i]]
            toks[i], sents[i] = toks[i][keep], sents[i][keep]
        turn = sorted(range(len(ids)), key=lambda i: (ids[i], counts[i], ys[i], sents[i].tobytes(), toks[i].tobytes()))
        first = np.concatenate([[0], np.cumsum([counts[i] for i in turn])]).astype(np.int64)
        none = [np.zeros(0, np.int64)]
        token = np.concatenate([toks[i] for i in turn] or none)
        sentence = np.concatenate([sents[i] + first[k] for k, i in enumerate(turn)] or none)
        w, bias = fit(sentence.astype(np.int64), token.astype(np.int64), first, y[turn] if turn else y)
        yield pa.RecordBatch.from_pydict({"weights": [w.astype(np.float32).tobytes()], "bias": [bias]}, schema=want)

    small_batches(docs.sparkSession)
    got = rows.repartition(1).mapInArrow(run, "weights binary, bias double").collect()
    if not got:
        return np.zeros(1 << BITS, np.float32), -60.0
    return np.frombuffer(got[0].weights, np.float32), got[0].bias


def score_columns(column: pa.Array, weights: np.ndarray, bias: float) -> dict:
    """Score of every text, its number of sentences, and the sentences with p >= 0.5 as code-point spans."""
    data, offs = K.utf8(column)
    w, sent, first = sentences(data, offs)
    n = len(offs) - 1
    if not len(sent):
        return {"score": np.zeros(n), "n_sentences": np.zeros(n, np.int64), "offending": [[]] * n}
    key_s, key_t = _features(data, w, sent)
    z = bias + np.bincount(key_s, weights[key_t], int(first[-1]))
    doc = np.repeat(np.arange(n), np.diff(first))
    score = -np.expm1(-np.bincount(doc, _softplus(z), n))
    bad = np.flatnonzero(z >= 0)
    spans: list[list] = [[] for _ in range(n)]
    if len(bad):
        lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        heads = np.searchsorted(sent, bad, "left")
        tails = np.searchsorted(sent, bad, "right") - 1
        for s, a, e in zip(bad, w.start[heads], w.end[tails]):
            d = doc[s]
            spans[d].append({"start": int(lead[a] - lead[offs[d]]), "end": int(lead[e] - lead[offs[d]]), "p": float(1 / (1 + np.exp(-z[s])))})
    return {"score": np.clip(score, 0.0, 1.0), "n_sentences": np.diff(first), "offending": spans}


_SPANS = "array<struct<start: long, end: long, p: double>>"


def score_documents(docs: DataFrame, weights: np.ndarray, bias: float, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, n_sentences and the offending sentences of every row."""
    model = docs.sparkSession.sparkContext.broadcast((weights, bias))

    def one(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column(0)} | score_columns(batch.column(1), *model.value)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return arrow_map(rows, one, f"doc_id long, score double, n_sentences long, offending {_SPANS}")


def filter_documents(docs: DataFrame, weights: np.ndarray, bias: float, text: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``limit``, with all their columns."""
    at, model = docs.columns.index(text), docs.sparkSession.sparkContext.broadcast((weights, bias))

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(score_columns(b.column(at), *model.value)["score"] < limit))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id"):
    """Rows whose crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> tuple[np.ndarray, float]:
    return train(docs, parquet(spark, sf_dir, "labels").where(~held_out()), "toxic")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = parquet(spark, sf_dir, "documents")
    got = score_documents(docs, *model(spark, docs, sf_dir))
    return got.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "n_sentences", F.size("offending").cast("long").alias("n_offending"), F.get("offending", F.lit(0))["start"].alias("first_start"), F.get("offending", F.lit(0))["end"].alias("first_end"))
