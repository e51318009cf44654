"""Quality rules as a short-circuit cascade.

Every rule is a reject test with its own features. On a bounded random sample of texts (``SAMPLE`` rows, a parameter) each rule's
cost (seconds a text) and selectivity (share rejected) are measured; the cascade then runs the rules by rejection per cost,
and a rule only sees the texts that all before it have kept. The order changes the time, never the verdict: a text is kept
if no rule rejects it.

Defined results: null and empty texts have no words and fail ``few_words``; texts of any length are read whole; repeated
rows get equal verdicts; an empty table gives an empty result; further columns are passed through untouched by
``filter_documents`` and ignored by ``stats``.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import kernel as K
from quern.llm.tables import arrow_map, parquet, small_batches

WINDOW = 5
SAMPLE = 400


def _table(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars.encode())] = True
    return t


_SYMBOL, _DIGIT = _table("#*$%&|<>"), _table("0123456789")
_UPPER, _LOWER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("abcdefghijklmnopqrstuvwxyz")
_SHOUT = _table("!")


class Batch:
    """Texts of a batch with features that are computed when a rule asks for them."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.data, self.offs = data, offs

    def __len__(self) -> int:
        return len(self.offs) - 1

    def take(self, keep: np.ndarray) -> Batch:
        """The texts whose numbers are in ``keep``."""
        size = np.diff(self.offs)
        flags = np.zeros(len(self), bool)
        flags[keep] = True
        return Batch(self.data[np.repeat(flags, size)], np.concatenate([[0], np.cumsum(size[keep])]))

    def count(self, table: np.ndarray) -> np.ndarray:
        return K.sums(table[self.data], self.offs)

    @cached_property
    def words(self) -> K.Words:
        return K.words(self.data, self.offs)

    @cached_property
    def n_words(self) -> np.ndarray:
        first = ~K.SEPARATOR[self.data]
        first[1:] &= K.SEPARATOR[self.data[:-1]]
        edge = self.offs[:-1][np.diff(self.offs) > 0]
        first[edge] = ~K.SEPARATOR[self.data[edge]]
        return K.sums(first, self.offs)

    @cached_property
    def word_chars(self) -> np.ndarray:
        return K.sums(((self.data & 0xC0) != 0x80) & ~K.SEPARATOR[self.data], self.offs)

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return self.count(_SYMBOL)

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Lines with a word, and those of them that equal an earlier line."""
        full, dup = np.zeros(len(self), np.int64), np.zeros(len(self), np.int64)
        raw = self.data.tobytes()
        for i in range(len(self)):
            rows = [x for x in raw[self.offs[i] : self.offs[i + 1]].split(b"\n") if x and not x.isspace()]
            full[i] = len(rows)
            dup[i] = len(rows) - len(set(rows))
        return full, dup

    @cached_property
    def n_stutter(self) -> np.ndarray:
        """Words that equal the word before them."""
        w = self.words
        same = np.zeros(len(w.hash), bool)
        same[1:] = w.hash[1:] == w.hash[:-1]
        same[w.at[:-1][np.diff(w.at) > 0]] = False
        return K.sums(same, w.at)

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        """Words in runs of WINDOW words that the text holds twice or more."""
        w = self.words
        n = len(w.hash) - WINDOW + 1
        if n < 1:
            return np.zeros(len(self), np.int64)
        with np.errstate(over="ignore"):
            g = np.zeros(n, np.uint64)
            for k in range(WINDOW):
                g += w.hash[k : n + k] * K._GRAM[k]
            doc = np.repeat(np.arange(len(self), dtype=np.uint64), w.counts())
            whole = doc[:n] == doc[WINDOW - 1 :]
            g = K.mix(K.mix(g) ^ (doc[:n] + K.U(1)) * K._GRAM[9])
        s = np.sort(g[whole])
        twice = np.unique(s[1:][s[1:] == s[:-1]])
        covered = np.zeros(len(w.hash), bool)
        if len(twice):
            spot = np.searchsorted(twice, g)
            hit = whole & (twice[np.minimum(spot, len(twice) - 1)] == g)
            for k in range(WINDOW):
                covered[k : n + k] |= hit
        return K.sums(covered, w.at)


Rule = tuple[str, Callable[[Batch], np.ndarray]]
#: Names and reject tests. All are ratios of whole counts, so that SQL gives the same verdicts.
RULES: list[Rule] = [
    ("few_words", lambda b: b.n_words < 10),
    ("repeated_words", lambda b: 100 * b.n_repeat_words > 20 * np.diff(b.words.at)),
    ("word_length", lambda b: (b.word_chars < 2 * b.n_words) | (b.word_chars > 15 * b.n_words)),
    ("symbols", lambda b: 100 * b.n_symbols > 10 * b.n_words),
    ("stutter", lambda b: 100 * b.n_stutter > 20 * b.n_words),
    ("shouting", lambda b: (100 * b.count(_SHOUT) > 30 * b.n_words) | (100 * b.count(_UPPER) > 40 * (b.count(_UPPER) + b.count(_LOWER)))),
    ("digits", lambda b: 100 * b.count(_DIGIT) > 30 * b.word_chars),
    ("repeated_lines", lambda b: 100 * b.lines[1] > 50 * b.lines[0]),
]


def measure(data: np.ndarray, offs: np.ndarray, rules: list[Rule] = RULES) -> list[tuple[str, float, float]]:
    """(rule, seconds a text, share rejected) on these texts; features are computed afresh for each rule."""
    out, n = [], max(1, len(offs) - 1)
    for name, test in rules:
        began = time.perf_counter()
        bad = test(Batch(data, offs))
        out.append((name, (time.perf_counter() - began) / n, float(bad.sum()) / n))
    return out


def order(measured: list[tuple[str, float, float]]) -> list[str]:
    """Rules by rejection per cost, best first; ties by name."""
    return [x[0] for x in sorted(measured, key=lambda x: (-x[2] / max(x[1], 1e-9), x[0]))]


def plan(docs: DataFrame, text: str = "text", sample: int = SAMPLE, rules: list[Rule] = RULES) -> list[str]:
    """Measure the rules on at most ``sample`` random texts, on one executor, and order them."""
    names = [x[0] for x in rules]

    def run(batches):
        cols = [b.column(0) for b in batches]
        got = measure(*K.utf8(pa.chunked_array(cols).combine_chunks()), rules) if cols else []
        yield pa.RecordBatch.from_pydict({"rule": pa.array([x[0] for x in got], pa.string()), "cost": pa.array([x[1] for x in got], pa.float64()), "share": pa.array([x[2] for x in got], pa.float64())})

    small_batches(docs.sparkSession)
    # a few times the rows wanted, from all over the table: a count reads no text, and hardly more than the sample is moved
    share = min(1.0, 4 * sample / max(docs.count(), 1))
    few = docs.select(F.col(text).cast("string").alias("text")).sample(False, share, 7).limit(sample).coalesce(1)
    got = [(r.rule, r.cost, r.share) for r in few.mapInArrow(run, "rule string, cost double, share double").collect()]
    return order(got) if got else names


def verdicts(batch: Batch, names: list[str], rules: list[Rule] = RULES) -> np.ndarray:
    """Kept or not, rule by rule on what is left."""
    tests, left, part = dict(rules), np.arange(len(batch)), batch
    for name in names:
        if not len(left):
            break
        bad = tests[name](part)
        if bad.any():
            left = left[~bad]
            part = part.take(np.flatnonzero(~bad))
    kept = np.zeros(len(batch), bool)
    kept[left] = True
    return kept


def filter_documents(docs: DataFrame, text: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """The rows of ``docs`` that every rule keeps, with all their columns."""
    names, at = plan(docs, text, rules=rules), docs.columns.index(text)

    def run(batches):
        for b in batches:
            kept = verdicts(Batch(*K.utf8(b.column(at))), names, rules)
            yield b.filter(pa.array(kept))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def stats(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Base counts of every text, whether the base rules fail, and the cascade's verdict."""
    names = plan(docs, text)
    rest = [n for n in names if n not in ("few_words", "repeated_words")]

    def one(batch) -> dict:
        b = Batch(*K.utf8(batch.column(1)))
        n = np.diff(b.words.at)
        failed = (n < 10) | (100 * b.n_repeat_words > 20 * n)
        kept = np.zeros(len(b), bool)
        ok = np.flatnonzero(~failed)
        kept[ok] = verdicts(b.take(ok) if len(ok) < len(b) else b, rest)
        return {"doc_id": batch.column(0), "n_words": n, "word_chars": b.word_chars, "n_symbols": b.n_symbols, "n_dup_lines": b.lines[1], "n_repeat_words": b.n_repeat_words, "base_failed": failed, "kept": kept}

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return arrow_map(rows, one, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats(parquet(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, string_split(text, chr(10)) AS ls FROM d),
c AS (
  SELECT rid, doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    length(regexp_replace(text, '[^!]', '', 'g')) AS n_shout,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^a-z]', '', 'g')) AS n_lower,
    length(regexp_replace(text, '[^0-9]', '', 'g')) AS n_digits,
    list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS fl,
    len(list_filter(list_zip(ws[2:], ws[:-2]), lambda p: p[1] = p[2])) AS n_stutter, ws FROM w),
g AS (SELECT rid, unnest(range(1, n_words - 3)) AS i, ws FROM c WHERE n_words >= 5),
gw AS (SELECT rid, i, ws[i:i+4] AS g FROM g),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS k FROM gw) WHERE k > 1),
cov AS (SELECT rid, count(DISTINCT i + o) AS n FROM rep, (SELECT unnest(range(0, 5)) AS o) GROUP BY rid),
s AS (SELECT c.*, len(fl) AS n_lines, len(fl) - len(list_distinct(fl)) AS n_dup, coalesce(cov.n, 0) AS n_rep FROM c LEFT JOIN cov USING (rid)),
v AS (SELECT *, n_words < 10 OR 100 * n_rep > 20 * n_words AS failed FROM s)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup::BIGINT AS n_dup_lines, n_rep::BIGINT AS n_repeat_words, failed AS base_failed,
  NOT failed AND NOT (word_chars < 2 * n_words OR word_chars > 15 * n_words) AND NOT 100 * n_symbols > 10 * n_words AND NOT 100 * n_stutter > 20 * n_words
    AND NOT (100 * n_shout > 30 * n_words OR 100 * n_upper > 40 * (n_upper + n_lower)) AND NOT 100 * n_digits > 30 * word_chars
    AND NOT 100 * n_dup > 50 * n_lines AS kept
FROM v
"""
