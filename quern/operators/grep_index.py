"""A substring index for grep: hashed trigrams of lower-cased texts, as postings of files.

A file that holds the needle holds all of its trigrams. The postings of the needle's rarest trigrams are intersected, and the exact test
is run on the files that are left: first on the first of them by path, since grep wants no more than its first hits, then, if
these don't suffice, on all. Hash collisions and trigrams from different places only add files to the test, so the rows are
those of ``retrieval.grep``. A needle of under three characters has no trigrams and is looked for in all files.

Texts are kept sorted by path, so that the reader skips row groups without a wanted path, in files of bounded bytes. Where they are read, up to
``ROW`` of them are packed as a block: one row of their paths, and for each bucket of trigrams one row of these with the places of their
files in the block, a byte each. No pair of a file and a trigram is a row, nothing is shuffled, and a task holds one file's postings.

Defined results: null texts hold nothing; of files with one path all are read; an empty index gives no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.retrieval import grep
from quern.session import stage

#: Bits of a trigram's hash, trigrams that are intersected, files of a block (places are bytes), paths that are tried first a wanted file.
BITS, RAREST, ROW, AHEAD = 22, 6, 256, 4
#: Buckets of trigrams (by their hashes' lowest bits), bytes of text of a block and of a file of texts (about).
BUCKETS, HELD, FILE = 64, 2 << 20, 64 << 20
#: Candidates are broadcast up to so many.
SMALL = 100_000
_ROWS = "bucket int, block long, paths array<string>, grams array<int>, ns array<int>, places binary"


def trigrams(text: str) -> np.ndarray:
    """Hashes of the different trigrams of code points, each within a line."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(codes) < 3:
        return np.zeros(0, np.int32)
    with np.errstate(over="ignore"):
        h = codes[:-2] * np.uint64(0x9E3779B97F4A7C15) + codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + codes[2:] * np.uint64(0x165667B19E3779F9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    inside = (codes[:-2] != 10) & (codes[1:-1] != 10) & (codes[2:] != 10)
    return np.unique(h[inside] >> np.uint64(64 - BITS)).astype(np.int32)


def _of(wanted: list[int]):
    """Of packed rows (block, grams, ns, places) the wanted trigrams, one a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i in range(b.num_rows):
                own, n = b.column(1)[i].values.to_numpy(), b.column(2)[i].values.to_numpy()
                ends = np.cumsum(n)
                for j in np.flatnonzero(np.isin(own, wanted)):
                    out.append((b.column(0)[i].as_py(), own[j], n[j], b.column(3)[i].as_py()[ends[j] - n[j] : ends[j]]))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate([pa.int64(), pa.int32(), pa.int32(), pa.binary()])], names=["block", "gram", "n", "places"])

    return run


def packed(paths: list[str], grams: list[np.ndarray], block: int) -> pa.RecordBatch:
    """The rows of a block: its paths (bucket -1), and its trigrams by bucket, with the places that each has."""
    place = np.repeat(np.arange(len(grams), dtype=np.uint8), [len(g) for g in grams])
    gram = np.concatenate([np.zeros(0, np.int32), *grams])
    order = np.lexsort((place, gram, gram % BUCKETS))
    gram, place = gram[order], place[order]
    first = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])[: len(gram)])
    own, n = gram[first], np.diff(np.append(first, len(gram))).astype(np.int32)
    cut = np.flatnonzero(np.append(True, np.diff(own % BUCKETS) != 0)[: len(own)])
    rows = [{"bucket": -1, "block": block, "paths": paths}]
    ends = np.append(first, len(gram))
    for low, high in zip(cut, np.append(cut[1:], len(own))):
        rows.append({"bucket": int(own[low] % BUCKETS), "block": block, "grams": own[low:high], "ns": n[low:high], "places": place[ends[low] : ends[high]].tobytes()})
    kinds = {"bucket": pa.int32(), "block": pa.int64(), "paths": pa.list_(pa.string()), "grams": pa.list_(pa.int32()), "ns": pa.list_(pa.int32()), "places": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in rows], t) for k, t in kinds.items()], names=list(kinds))


class GrepIndex:
    """The index below ``path``: texts (path, text) and grams (bucket, block, paths, grams, ns, places)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def build(self, files: DataFrame, path: str = "path", text: str = "text") -> GrepIndex:
        rows = files.select(F.col(path).alias("path"), F.col(text).alias("text")).where("path is not null")
        size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length("path")), F.lit(0))).first()[0]
        # files of bounded bytes, whatever the input: neither the sort nor a task's postings grow with it
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE))
        rows.repartitionByRange(parts, "path").sortWithinPartitions("path").write.option("parquet.block.size", 4 << 20).parquet(f"{self.path}/texts")
        texts = self.spark.read.parquet(f"{self.path}/texts")

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # a block's number: the task's, then a count
            number, paths, grams, held = TaskContext.get().partitionId() << 32, [], [], 0
            for b in batches:
                for i in range(b.num_rows):
                    t = b.column(1)[i].as_py() or ""
                    paths.append(b.column(0)[i].as_py())
                    grams.append(trigrams(t))
                    held += len(t)
                    if len(paths) == ROW or held >= HELD:
                        yield packed(paths, grams, number)
                        number, paths, grams, held = number + 1, [], [], 0
            if paths:
                yield packed(paths, grams, number)

        posts = texts.select("path", F.lower("text").alias("text")).mapInArrow(cut, _ROWS)
        posts.sortWithinPartitions("bucket", "block").write.option("parquet.block.size", 4 << 20).parquet(f"{self.path}/grams")
        return self

    def texts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/texts")

    def candidates(self, needle: str) -> DataFrame:
        """(path) of the files that hold the needle's rarest trigrams."""
        wanted = [int(g) for g in trigrams(needle.lower())]
        if not wanted:
            return self.texts().select("path").distinct()
        index = self.spark.read.parquet(f"{self.path}/grams")
        # nothing but the wanted trigrams leaves the tasks that read their buckets
        grams = index.where(F.col("bucket").isin(sorted({g % BUCKETS for g in wanted}))).select("block", "grams", "ns", "places").mapInArrow(_of(wanted), "block long, gram int, n int, places binary")
        grams = stage(grams, "grams")
        counts = dict(grams.groupBy("gram").agg(F.sum("n")).collect())
        if len(counts) < len(wanted):
            return self.texts().select("path").limit(0)
        rarest = sorted(wanted, key=lambda g: (counts[g], g))[:RAREST]
        lists = grams.where(F.col("gram").isin(rarest)).groupBy("block").agg(F.collect_list("places").alias("lists")).where(F.size("lists") == len(rarest))

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for paths, lists in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    n = np.bincount(np.concatenate([np.frombuffer(x, np.uint8) for x in lists]), minlength=len(paths))
                    out += [paths[i] for i in np.flatnonzero(n == len(lists))]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["path"])

        return index.where("bucket = -1").join(lists, "block").select("paths", "lists").mapInArrow(meet, "path string").distinct()

    def grep(self, needle: str, ignore_case: bool = True, extensions: list[str] | None = None, max_hits: int = 100, max_files: int = 30) -> DataFrame:
        return self.grep_counted(needle, ignore_case, extensions, max_hits, max_files)[0]

    def grep_counted(self, needle: str, ignore_case: bool = True, extensions: list[str] | None = None, max_hits: int = 100, max_files: int = 30) -> tuple[DataFrame, int]:
        """path, line_no, line as ``retrieval.grep`` gives them, and how many files were tested."""
        some = stage(self.candidates(needle), "candidates")
        if extensions:
            some = some.where(F.regexp_extract("path", r"(\.[^./]+)$", 1).isin(extensions))
        test = lambda files: grep(files, needle, ignore_case=ignore_case, max_hits=max_hits, max_files=max_files)
        first = [r[0] for r in some.orderBy("path").limit(AHEAD * max_files + 1).collect()]
        found = stage(test(self.texts().where(F.col("path").isin(first[: AHEAD * max_files]))), "hits")
        if len(first) <= AHEAD * max_files or found.count() >= max_hits or found.select("path").distinct().count() >= max_files:
            return found.orderBy("path", "line_no"), min(len(first), AHEAD * max_files)
        n = some.count()
        return test(self.texts().join(F.broadcast(some) if n <= SMALL else some, "path", "left_semi")), n
