"""Variable-capacity best-fit packing.

Texts are measured in words. A text over the largest permitted length is cut into pieces of that length and a rest, so that
nothing is lost. Pieces go, longest first, into the open bin with the least room that holds them (best fit); if none does,
the bin size that costs least per word it can expect to hold is opened. In the end each bin is shrunk to the smallest
permitted length that holds its contents. The cost of a bin is its length plus ``OVERHEAD``; several opening policies (each
permitted length as the largest to open, so the lengths are optimised jointly) are tried and the cheapest total wins.

Only the number of pieces of each length matters for this, so packing runs on a histogram of at most ``LENGTHS[-1]`` lengths,
whatever the number of rows; equal bins are handled as one group with a count. Pieces then find their bins by their rank
among pieces of their length. A length with many pieces is dealt into hash buckets of about ``BUCKET`` pieces; ranks come from
the counts of the buckets and a rank within the bucket, so no task sees a whole length. Only the histogram and the plan go
through the driver: the histogram has a row for each length, the plan a few for each length and opened size.

Defined results: null and empty texts, and texts without words, have one piece of length 0 and no bin (null); repeated rows
are packed like any other; ties are broken by id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.tables import parquet, small_side, stage

LENGTHS = [256, 512, 1024, 2048, 4096]
OVERHEAD = 16
#: Pieces in one bucket of a length, about.
BUCKET = 4_000


class Group:
    """``count`` equal bins that hold ``items`` = [(length, how many)]."""

    __slots__ = ("size", "room", "items", "count")

    def __init__(self, size: int, room: int, items: list[tuple[int, int]], count: int):
        self.size, self.room, self.items, self.count = size, room, items, count


def best_fit(histogram: dict[int, int], lengths: list[int], overhead: int = OVERHEAD) -> list[Group]:
    """Best-fit decreasing over {length: pieces}; all pieces of a length are placed together."""
    rooms: list[int] = []
    open_: dict[int, list[Group]] = defaultdict(list)
    done: list[Group] = []
    left = sum(k * n for k, n in histogram.items())

    def put(g: Group) -> None:
        if g.room <= 0:
            done.append(g)
            return
        if not open_[g.room]:
            insort(rooms, g.room)
        open_[g.room].append(g)

    def fill(g: Group, k: int, n: int) -> int:
        """Place up to n pieces of length k into the bins of g, each bin as full as it gets; returns what is left."""
        per = g.room // k
        bins = min(g.count, n // per)
        if bins:
            put(Group(g.size, g.room - per * k, [*g.items, (k, per)], bins))
            n -= bins * per
        if n and bins < g.count:
            put(Group(g.size, g.room - n * k, [*g.items, (k, n)], 1))
            bins, n = bins + 1, 0
        if bins < g.count:
            put(Group(g.size, g.room, g.items, g.count - bins))
        return n

    for k in sorted(histogram, reverse=True):
        n = histogram[k]
        while n:
            spot = bisect_left(rooms, k)
            if spot < len(rooms):
                room = rooms[spot]
                g = open_[room].pop()
                if not open_[room]:
                    del rooms[spot]
                n = fill(g, k, n)
            else:
                # least cost per word that the bin can expect to hold, given what is still to be packed
                size = min((s for s in lengths if s >= k), key=lambda s: ((s + overhead) / min(s, max(k, left)), s))
                n = fill(Group(size, size, [], -(-n // (size // k))), k, n)
        left -= k * histogram[k]
    return done + [g for r in rooms for g in open_[r]]


def shrink(groups: list[Group], lengths: list[int]) -> list[Group]:
    """Each bin at the smallest permitted length that holds its contents."""
    out = []
    for g in groups:
        used = g.size - g.room
        size = next(s for s in lengths if s >= used)
        out.append(Group(size, size - used, g.items, g.count))
    return out


def plan(histogram: dict[int, int], lengths: list[int] = LENGTHS, overhead: int = OVERHEAD) -> list[Group]:
    """The cheapest of the packings that open lengths up to each permitted one (longer only where a piece needs it)."""
    lengths = sorted(lengths)
    best = None
    for top in lengths:
        allowed = [s for s in lengths if s <= top or any(k > top and s >= k for k in histogram)]
        groups = shrink(best_fit(histogram, allowed, overhead), lengths)
        cost = sum(g.count * (g.size + overhead) for g in groups)
        if best is None or cost < best[0]:
            best = (cost, groups)
    return best[1]


def pieces(docs: DataFrame, largest: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, first_word, n_words of every piece; a text without words has one of 0 words."""
    n = F.size(F.expr(rf"regexp_extract_all(coalesce(cast(`{text}` as string), ''), '[^\\x20\\x09-\\x0D]+', 0)"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), n.alias("n"))
    cut = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / largest).cast("int") - 1, F.lit(0)))
    return rows.select("doc_id", "n", F.explode(cut).alias("piece")).select("doc_id", "piece", (F.col("piece") * largest).cast("long").alias("first_word"), F.least(F.lit(largest), F.col("n") - F.col("piece") * largest).cast("int").alias("n_words"))


def pack(docs: DataFrame, lengths: list[int] = LENGTHS, id_col: str = "doc_id", text: str = "text", overhead: int = OVERHEAD) -> DataFrame:
    """A row for each piece: doc_id, piece, first_word, n_words, bin_id, bin_length, bin_words, offset in the bin."""
    spark, largest = docs.sparkSession, max(lengths)
    rows = stage(pieces(docs, largest, id_col, text), "pieces")
    histogram = {r.n_words: r.n for r in rows.groupBy("n_words").agg(F.count("*").alias("n")).collect()}
    # at most a row for each length up to the largest
    sizes = spark.createDataFrame([(k, -(-n // BUCKET)) for k, n in histogram.items()], "n_words int, buckets int")
    rows = rows.join(F.broadcast(sizes), "n_words").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.col("buckets")).cast("int")).drop("buckets")
    counts = rows.groupBy("n_words", "bucket").agg(F.count("*").alias("n"))
    histogram.pop(0, None)
    # slots: pieces of a length with ranks [low, low + bins * per) go to bins [bin, bin + bins), `per` to a bin
    slots, next_bin, used = [], 0, defaultdict(int)
    for g in plan(histogram, lengths, overhead) if histogram else []:
        offset = 0
        for k, per in g.items:
            slots.append((k, used[k], used[k] + g.count * per, per, next_bin, g.size, g.size - g.room, offset))
            used[k] += g.count * per
            offset += k * per
        next_bin += g.count
    table = spark.createDataFrame(slots, "n_words int, low long, high long, per int, bin long, bin_length int, bin_words int, at int")
    by_length = table.groupBy("n_words").agg(F.array_sort(F.collect_list(F.struct("low", "high", "per", "bin", "bin_length", "bin_words", "at"))).alias("slots"))
    before = counts.withColumn("base", F.sum("n").over(Window.partitionBy("n_words").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = rows.withColumn("within", F.row_number().over(Window.partitionBy("n_words", "bucket").orderBy("doc_id", "piece")) - 1).join(before.select("n_words", "bucket", "base"), ["n_words", "bucket"]).withColumn("rank", F.coalesce("base", F.lit(0)) + F.col("within"))
    slot = F.expr("filter(slots, s -> s.low <= rank and rank < s.high)[0]") if slots else F.lit(None).cast("struct<low:long,high:long,per:int,bin:long,bin_length:int,bin_words:int,at:int>")
    found = ranked.join(small_side(by_length, len(slots)), "n_words", "left").withColumn("s", F.when(F.col("slots").isNotNull(), slot))
    k = F.col("rank") - F.col("s.low")
    return found.select("doc_id", "piece", "first_word", F.col("n_words").cast("long").alias("n_words"), (F.col("s.bin") + F.floor(k / F.col("s.per"))).alias("bin_id"), F.col("s.bin_length").alias("bin_length"), F.col("s.bin_words").alias("bin_words"), F.when(F.col("s").isNotNull(), F.col("s.at") + F.pmod(k, F.col("s.per").cast("long")) * F.col("n_words")).alias("offset"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(parquet(spark, sf_dir, "documents"))
