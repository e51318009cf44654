"""Order MinHash fingerprints, with DataFrame functions only.

A text is cut into tokens (runs of up to TOKEN characters that are no white space), whose K-mers get an occurrence number, so
that a repeated K-mer counts each time. Every (K-mer, occurrence) hashes to one of BINS bins; in each bin the L = 2 with the
least hashes are selected, put back into the order of the text, and hashed as a tuple. Two fingerprints agree in a bin only
if the same K-mers were selected in the same order, which makes the likeness follow the edit distance and not just the
overlap of K-mers. (One permutation split into bins stands for BINS permutations.)

Arrays are bound to lambda variables (``let``), so that each is computed once; all work is per row, sorts are sorts of
primitive longs. Occurrence numbers come from the sorted K-mers: the start of each run by prefix maximum with doubling steps.

Defined results: null counts as empty; a text without tokens has an empty fingerprint, alike (1.0) to another empty one and
unlike (0.0) to all others; a text of fewer than K tokens has one K-mer, all of it; texts are read whole; rows that repeat
an id follow one another in the order of a hash of their texts; null ids come first; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.tables import parquet

K, BINS, TOKEN = 3, 64, 16
POSITION = 28
#: Rows of neighbouring ids in a bucket, about, and the most buckets; ids sampled for each to find the buckets' limits.
BUCKET, BUCKETS, SAMPLED = 2000, 20_000, 40
#: Stands for a null id.
FIRST = -(1 << 63)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


_MASK = (1 << POSITION) - 1


def _high(x: Column) -> Column:
    return F.shiftright(x, POSITION)


def _packed(h: Column, i: Column) -> Column:
    """The high bits of a hash and a position below them; never null, so that arrays of them sort as primitives."""
    return F.coalesce(h.bitwiseAND(F.lit(~_MASK)).bitwiseOR(i), F.lit(0).cast("long"))


def kmers(text: Column) -> Column:
    """Hashes of the K-mers of tokens, in text order."""
    tokens = F.regexp_extract_all(text, F.lit(rf"[^\x20\x09-\x0D]{{1,{TOKEN}}}"), F.lit(0))

    def grams(h: Column) -> Column:
        n = F.size(h)
        runs = F.transform(F.sequence(F.lit(0), n - K), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(K)]))
        few = F.when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))
        return F.when(n >= K, runs).otherwise(few)

    return let(F.transform(tokens, lambda t: F.xxhash64(t)), grams)


def _numbered(s: Column) -> Column:
    """The (K-mer, occurrence) hashes of the sorted packed array ``s``, packed with their places and sorted."""

    def pack(occurrence: Callable[[Column, Column], Column]) -> Column:
        return F.sort_array(F.transform(s, lambda x, i: _packed(F.xxhash64(_high(x), occurrence(x, i)), x.bitwiseAND(F.lit(_MASK)))))

    def many() -> Column:
        """Runs of any length: where each run starts, by prefix maximum."""
        starts = F.transform(s, lambda x, i: F.when((i > 0) & (_high(F.get(s, i - 1)) == _high(x)), F.lit(0)).otherwise(i))
        back = lambda acc, i, k: F.get(acc, i - F.call_function("shiftleft", F.lit(1), k))
        step = lambda acc, k: F.transform(acc, lambda v, i: F.when(i >= F.call_function("shiftleft", F.lit(1), k), F.greatest(v, back(acc, i, k))).otherwise(v))
        repeats = F.size(s) - F.size(F.array_distinct(F.transform(s, lambda x: _high(x))))
        return let(F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(repeats + 1)).cast("int")), starts, step), lambda start: pack(lambda x, i: i - F.get(start, i)))

    # no K-mer three times: then a repeat is the second one
    thrice = F.size(F.filter(s, lambda x, i: (i > 1) & (_high(F.get(s, i - 2)) == _high(x)))) > 0
    return F.when(thrice, many()).otherwise(pack(lambda x, i: F.when((i > 0) & (_high(F.get(s, i - 1)) == _high(x)), F.lit(1)).otherwise(F.lit(0))))


def fingerprint(text: Column) -> Column:
    """array<bigint>: for each bin with an element, the bin's number above a 32-bit tuple hash."""
    mask = F.lit(_MASK)
    bin_of = lambda x: F.shiftrightunsigned(x, 58)

    def select(t: Column) -> Column:
        return F.filter(t, lambda x, i: (i < 2) | (bin_of(F.get(t, i - 2)) != bin_of(x)))

    def tuples(s: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (bin_of(F.get(s, i - 1)) != bin_of(F.get(s, i))))

        def one(i: Column) -> Column:
            x, y = F.get(s, i), F.get(s, i + 1)
            pair = (i + 1 < F.size(s)) & (bin_of(x) == bin_of(y))
            ordered = F.when(x.bitwiseAND(mask) < y.bitwiseAND(mask), F.xxhash64(_high(x), _high(y))).otherwise(F.xxhash64(_high(y), _high(x)))
            h = F.when(pair, ordered).otherwise(F.xxhash64(_high(x)))
            return F.coalesce(F.shiftleft(bin_of(x), 32).bitwiseOR(F.shiftrightunsigned(h, 32)), F.lit(0).cast("long"))

        return F.when(F.size(s) > 0, F.transform(heads, one)).otherwise(F.array().cast("array<bigint>"))

    return let(let(let(F.sort_array(F.transform(kmers(text), lambda h, i: _packed(h, i.cast("long")))), _numbered), select), tuples)


def as_text(fp: Column) -> Column:
    """The fingerprint as hex digits, ten for each bin."""
    return F.array_join(F.transform(fp, lambda x: F.lpad(F.hex(x), 10, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bins among those that either fingerprint has."""
    bins = F.size(F.array_union(F.transform(a, lambda x: F.shiftright(x, 32)), F.transform(b, lambda x: F.shiftright(x, 32))))
    return F.when(bins == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / bins)


def _longs(values: list[int]) -> Column:
    """A constant array."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def limits(rows: DataFrame, doc: str) -> tuple[list[int], dict[int, int]]:
    """Least ids of the buckets but the first, and for an id that fills buckets alone their number.

    From a sample of at most about SAMPLED * BUCKETS ids, so that buckets hold about as many rows each, however the ids lie.
    """
    n = rows.count()
    count = max(1, min(BUCKETS, n // BUCKET))
    if count == 1:
        return [], {}
    ids = np.sort(np.array([r[0] for r in rows.select(doc).sample(False, min(1.0, SAMPLED * count / n), 11).collect()], np.int64))
    if not len(ids):
        return [], {}
    per = max(1, len(ids) // count)
    value, times = np.unique(ids, return_counts=True)
    hot = {int(v): int(-(-t // per)) for v, t in zip(value, times) if t > 2 * per}
    # a frequent id is a bucket of its own, which the hash of the text divides further
    heads = {int(x) for x in ids[per::per]} | {x for v in hot for x in (v, v + 1)}
    return sorted(heads - {FIRST, 1 << 63}), hot


def _bucket(doc: Column, h: Column, heads: list[int], hot: dict[int, int]) -> Column:
    """Number of the bucket (how many of the heads are not above the id, found in two steps) and of its part."""
    zero = F.lit(0)
    if not heads:
        at = zero
    else:
        step = int(len(heads) ** 0.5) + 1
        coarse = F.size(F.filter(_longs(heads[step - 1 :: step]), lambda x: x <= doc)) * step
        at = let(coarse, lambda c: c + F.size(F.filter(F.slice(_longs(heads), c + 1, F.lit(step)), lambda x: x <= doc)))
    part = zero
    for v, k in hot.items():
        part = F.when(doc == v, F.least(F.floor((h / F.lit(2.0**64) + 0.5) * k), F.lit(k - 1)).cast("int")).otherwise(part)
    return F.struct(at.cast("int").alias("at"), part.alias("part"))


def with_next(rows: DataFrame, id_col: str, text: str, more: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """``rows`` (id, text) after ``more``, plus next_<column> of the row with the next id; after the last comes the first.

    Rows are dealt to buckets of neighbouring ids, whose limits come from a bounded sample of ids; an id with very many rows is
    divided by the hash of the text. Each bucket also gets the first row of the next one, so one exchange and a window per
    bucket suffice; the only global order is over the bucket heads.
    """
    keyed = rows.select(id_col, text, F.coalesce(F.col(id_col), F.lit(FIRST)).alias("_doc"), F.xxhash64(text).alias("_h"))
    heads, hot = limits(keyed, "_doc")
    keyed = keyed.withColumn("bucket", _bucket(F.col("_doc"), F.col("_h"), heads, hot))
    firsts = keyed.groupBy("bucket").agg(F.min(F.struct("_doc", "_h")).alias("first"))
    order = Window.orderBy("bucket")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nexts = firsts.select(F.coalesce(F.lag("bucket").over(order), F.last("bucket").over(whole)).alias("to"), F.col("first._doc").alias("_doc"), F.col("first._h").alias("_h"))
    # one row a bucket; rows that are equal in id and text are alike
    tail = keyed.drop("bucket").join(F.broadcast(nexts), ["_doc", "_h"]).dropDuplicates(["to"]).withColumnRenamed("to", "bucket")
    both = more(keyed.withColumn("copy", F.lit(0)).unionByName(tail.withColumn("copy", F.lit(1))))
    w = Window.partitionBy("bucket").orderBy("copy", "_doc", "_h")
    inner = ("bucket", "copy", "_doc", "_h")
    names = [c for c in both.columns if c not in inner]
    return both.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in names]).where("copy = 0").drop(*inner)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    linked = with_next(rows, "doc_id", "text", lambda df: df.withColumn("fp", fingerprint(F.col("text"))))
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    rows = linked.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fp", F.coalesce("next_fp", "fp").alias("next_fp"))
    rows = rows.select("*", fingerprint(F.col("edited")).alias("edited_fp"))
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(parquet(spark, sf_dir, "documents"))
