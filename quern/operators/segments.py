"""An inverted index that is kept up to date: immutable segments of posting blocks, tombstones, merging, block maxima.

An upsert writes one segment of its documents and tombstones of their ids; a delete writes tombstones only. A tombstone hides what older
segments hold of an id. When a segment is small beside the newer ones they are merged, without what is hidden. Each change is one
manifest (``sources.manifest``), so a search sees all of it or nothing.

A segment's documents are dealt to blocks by a hash of their ids. A row holds the postings of one block for the terms of one bucket, as
arrays: places of documents in the block, frequencies, and the largest score that each term can give there. Postings are counted, packed,
hidden and scored a block at a time with numpy and never are rows of their own; tombstones meet documents, not postings.

The sum of a query's maxima bounds the scores in a block. A search reads these bounds, scores each query's most promising blocks, and
then only those blocks whose bound reaches the k-th score found: exact, with few blocks read.

Defined results: null texts have no terms; a null id is left out; of repeated ids within a batch the greatest text counts;
an empty index gives no hits.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions.text import tokens
from quern.operators import retrieval
from quern.operators.retrieval import Best, _saturated, bm25, counted, top_k
from quern.session import stage
from quern.sources.manifest import Tables

K1, B, AVERAGE = 1.2, 0.75, 256.0
#: Documents of a block, about; buckets of terms; rows of a broadcast.
BLOCK, BUCKETS, SMALL = 256, 64, 100_000
_ROWS = "bucket int, block int, terms array<string>, ns array<int>, mosts array<double>, places array<int>, tfs array<int>"


def impact(tf: np.ndarray, size: np.ndarray) -> np.ndarray:
    """What a term that occurs ``tf`` times in a document of ``size`` tokens adds to its score."""
    return _saturated(tf, size, K1, B, AVERAGE)


def bucket(term: str) -> int:
    return zlib.crc32(term.encode()) % BUCKETS


def lists(values: pa.Array, ends: np.ndarray) -> pa.ListArray:
    """Lists of ``values`` that end before the places ``ends``."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), values)


def runs(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[pa.Table]:
    """The runs of rows with equal first ``key`` columns (integers) in batches sorted by these."""
    held, last = [], None
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(key)], axis=1)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for low, high in zip([0, *cuts], [*cuts, b.num_rows]):
            if held and tuple(keys[low]) != last:
                yield pa.Table.from_batches(held)
                held = []
            last = tuple(keys[low])
            held.append(b.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held)


def whole(table: pa.Table, name: str) -> pa.Array:
    out = table.column(name).combine_chunks()
    return out if isinstance(out, pa.Array) else pa.concat_arrays(out.chunks)


def dealt(docs: DataFrame, count: int) -> DataFrame:
    """Documents (id, ...) with their block."""
    return docs.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(count)).cast("int"))


def packed(docs: DataFrame, count: int) -> DataFrame:
    """The rows (bucket, block, ...) of counted documents (id, doc_len, terms, tfs); a document's place is that of its id in its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, 1):
            terms = whole(table, "terms")
            each = terms.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            coded = terms.flatten().dictionary_encode()
            if not len(coded):
                continue
            place = np.repeat(np.arange(len(each), dtype=np.int32), each)
            tf = whole(table, "tfs").flatten().to_numpy().astype(np.int32)
            gives = impact(tf, whole(table, "doc_len").to_numpy()[place])
            buckets = np.array([bucket(t) for t in coded.dictionary.to_pylist()])
            # terms by bucket, each term's documents by place
            by = np.argsort(buckets, kind="stable")
            rank = np.empty(len(by), np.int64)
            rank[by] = np.arange(len(by))
            code = rank[coded.indices.to_numpy()]
            order = np.argsort(code, kind="stable")
            n = np.bincount(code, minlength=len(by))
            ends = np.cumsum(n)
            most = np.maximum.reduceat(gives[order], ends - n)
            last = np.flatnonzero(np.append(np.diff(buckets[by]) != 0, True))
            own = buckets[by][last].astype(np.int32)
            block = np.full(len(own), table.column(0)[0].as_py(), np.int32)
            to, posts = last + 1, ends[last]
            yield pa.RecordBatch.from_arrays(
                [pa.array(own), pa.array(block), lists(coded.dictionary.take(pa.array(by)).cast(pa.string()), to), lists(pa.array(n.astype(np.int32)), to), lists(pa.array(most), to), lists(pa.array(place[order]), posts), lists(pa.array(tf[order]), posts)],
                names=["bucket", "block", "terms", "ns", "mosts", "places", "tfs"],
            )

    rows = dealt(docs, count).select("block", "id", "doc_len", "terms", "tfs").repartition("block").sortWithinPartitions("block", "id")
    # sorted by bucket within each file, so that the reader skips row groups without a query's terms
    return rows.select("block", "doc_len", "terms", "tfs").mapInArrow(run, _ROWS).sortWithinPartitions("bucket", "block")


def wanted_only(rows: DataFrame, words: list[str], posts: bool) -> DataFrame:
    """(seg, block, t, ns, mosts, and with ``posts`` places, tfs) of stored rows, of the numbered ``words`` only."""
    names = ["seg", "block", "terms", "ns", "mosts", *(["places", "tfs"] if posts else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(words, pa.string())
        for b in batches:
            terms, n = b.column(2), b.column(3).flatten().to_numpy()
            t = pc.index_in(terms.flatten(), value_set=known)
            keep = t.is_valid().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(b.num_rows), terms.value_lengths().to_numpy(zero_copy_only=False))
            ends = np.cumsum(np.bincount(row[keep], minlength=b.num_rows))
            mask = pa.array(keep)
            out = [b.column(0), b.column(1), lists(t.filter(mask), ends), lists(pa.array(n[keep]), ends), lists(b.column(4).flatten().filter(mask), ends)]
            if posts:
                some = pa.array(np.repeat(keep, n))
                ends = np.cumsum(np.bincount(row[keep], n[keep], minlength=b.num_rows).astype(np.int64))
                out += [lists(b.column(5).flatten().filter(some), ends), lists(b.column(6).flatten().filter(some), ends)]
            out = pa.RecordBatch.from_arrays(out, names=["seg", "block", "t", *names[3:]])
            yield out.filter(pc.greater(pc.list_value_length(out.column(2)), 0))

    return rows.select(*names).mapInArrow(run, "seg int, block int, t array<int>, ns array<int>, mosts array<double>" + (", places array<int>, tfs array<int>" if posts else ""))


def by_block(rows: DataFrame) -> DataFrame:
    return rows.repartition("seg", "block").sortWithinPartitions("seg", "block")


def opened(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, sizes and whether they are live of a block's documents; term number, place and frequency of its live postings."""
    flat = lambda name: whole(table, name).flatten().to_numpy(zero_copy_only=False)
    ids, sizes, alive = flat("ids"), flat("sizes"), flat("alive")
    live = np.zeros(len(ids), bool)
    live[alive.astype(np.int64)] = True
    t, place, tf = np.repeat(flat("t"), flat("ns")), flat("places"), flat("tfs")
    there = live[place] if len(place) else np.zeros(0, bool)
    return ids, sizes, live, t[there], place[there], tf[there]


class Segments:
    """The index below ``path``. Segments and tombstones are tables named by the number of the change that wrote them."""

    def __init__(self, spark: SparkSession, path: str):
        self.tables = Tables(spark, path)
        self.spark = spark

    # --- changes

    def upsert(self, docs: DataFrame, id_col: str = "id", text: str = "text", new: bool = False) -> None:
        """Put documents in the place of those with their ids. ``new``: no id is in the index, so no tombstones are needed."""
        since = self.tables.version()
        rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where("id is not null")
        folder = self.tables.write(counted(rows.groupBy("id").agg(F.max("text").alias("text"))))
        rows, n = self._written(folder)
        if not n:
            return
        folders = self.tables.folders()
        parts = self._segments(folders)
        some = self._small(parts, n)
        put, drop = {}, []
        if len(some) < len(parts) and not new:
            put[f"dead-{since + 1}"] = self.tables.write(rows.select("id"))
        if some:
            # merged before the new documents are packed, so that they are packed once
            old = self._docs(folders, some).drop("seg")
            old = old if new else old.join(rows.select("id"), "id", "left_anti")
            folder, drop = self.tables.write(rows.unionByName(old)), self._replaced(folders, some, parts)
            rows, n = self._written(folder)
        self.tables.commit(put | self._segment(f"{since + 1}-{n}", folder, rows, n), drop, since=since)

    def _written(self, folder: str) -> tuple[DataFrame, int]:
        """The counted documents in a folder, and how many they are."""
        rows = self.spark.read.parquet(f"{self.tables.root}/{folder}")
        return rows, rows.count()

    def _segment(self, name: str, folder: str, docs: DataFrame, n: int) -> dict[str, str]:
        """Tables of a segment: its counted documents, the ids of each block by place, its postings."""
        count = max(1, -(-n // BLOCK))
        ids = dealt(docs.select("id", F.col("doc_len").alias("size")), count).groupBy("block").agg(F.array_sort(F.collect_list(F.struct("id", "size"))).alias("d"))
        ids = ids.select("block", F.col("d.id").alias("ids"), F.col("d.size").alias("sizes"))
        return {f"docs-{name}": folder, f"ids-{name}": self.tables.write(ids), f"segment-{name}": self.tables.write(packed(docs, count))}

    def delete(self, ids: DataFrame, id_col: str = "id") -> None:
        since = self.tables.version()
        self.tables.commit({f"dead-{since + 1}": self.tables.write(ids.select(F.col(id_col).cast("long").alias("id")).where("id is not null").distinct())}, since=since)

    def _segments(self, folders: dict[str, str]) -> list[tuple[int, int]]:
        """(number, documents), oldest first."""
        return sorted((int(a), int(n)) for kind, a, n in (k.split("-") for k in folders if k.startswith("segment-")) if kind)

    def _small(self, parts: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
        """The newest segments that are merged with ``n`` new documents, as long as the next older one is no larger than they are together:
        few segments stay, and a document is merged a logarithmic number of times."""
        total, take = n, 0
        for _, m in reversed(parts):
            if m > total:
                break
            total, take = total + m, take + 1
        return parts[len(parts) - take :]

    def _replaced(self, folders: dict[str, str], some: list[tuple[int, int]], parts: list[tuple[int, int]]) -> list[str]:
        """The tables that go when ``some`` of the segments are merged."""
        # tombstones go when nothing older is left for them to hide
        dead = [k for k in folders if k.startswith("dead-") and len(some) == len(parts)]
        return [*(f"{kind}-{a}-{n}" for a, n in some for kind in ("segment", "ids", "docs")), *dead]

    def merge(self, newest: int | None = None) -> None:
        """Make one segment of the ``newest`` segments (default: all), without hidden documents."""
        since, folders = self.tables.version(), self.tables.folders()
        parts = self._segments(folders)
        some = parts[-(newest or len(parts)) :]
        if not some:
            return
        folder = self.tables.write(self._docs(folders, some).drop("seg"))
        docs, n = self._written(folder)
        put = self._segment(f"{some[-1][0]}-{n}", folder, docs, n) if n else {}
        self.tables.commit(put, self._replaced(folders, some, parts), since=since)

    # --- reading

    def _dead(self, folders: dict[str, str]) -> DataFrame | None:
        """(id, last): the newest change that hides an id."""
        parts = [self.spark.read.parquet(f"{self.tables.root}/{f}").select("id", F.lit(int(k.split("-")[1])).alias("last")) for k, f in folders.items() if k.startswith("dead-")]
        if not parts:
            return None
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.groupBy("id").agg(F.max("last").alias("last"))

    def _hidden(self, rows: DataFrame, folders: dict[str, str]) -> DataFrame:
        """``rows`` (id, seg, ...) without those that a newer change hides."""
        dead = self._dead(folders)
        if dead is None:
            return rows
        dead = stage(dead, "dead")
        small = F.broadcast(dead) if dead.count() <= SMALL else dead
        return rows.join(small.withColumnRenamed("id", "_id"), (F.col("id") == F.col("_id")) & (F.col("seg") < F.col("last")), "left_anti")

    def _table(self, kind: str, folders: dict[str, str], parts: list[tuple[int, int]]) -> DataFrame:
        """One kind of table of all segments, with ``seg``."""
        frames = [self.spark.read.parquet(f"{self.tables.root}/{folders[f'{kind}-{a}-{n}']}").withColumn("seg", F.lit(a)) for a, n in parts]
        out = frames[0]
        for x in frames[1:]:
            out = out.unionByName(x)
        return out

    def _docs(self, folders: dict[str, str], parts: list[tuple[int, int]]) -> DataFrame:
        """The live documents, counted."""
        return self._hidden(self._table("docs", folders, parts), folders)

    def _places(self, folders: dict[str, str], parts: list[tuple[int, int]], keep: DataFrame | None) -> DataFrame:
        """(seg, block, ids, sizes, alive): the documents of each block, and the places of those that are live (and in ``keep``)."""
        ids = self._table("ids", folders, parts)
        if keep is None and not any(k.startswith("dead-") for k in folders):
            return ids.select("seg", "block", "ids", "sizes", F.sequence(F.lit(0), F.size("ids") - 1).alias("alive"))
        rows = self._hidden(ids.select("seg", "block", F.posexplode("ids").alias("place", "id")), folders)
        rows = rows if keep is None else rows.join(keep.select("id"), "id", "left_semi")
        alive = rows.groupBy("seg", "block").agg(F.collect_list("place").alias("alive"))
        return ids.join(alive, ["seg", "block"], "left").select("seg", "block", "ids", "sizes", F.coalesce("alive", F.array().cast("array<int>")).alias("alive"))

    def count(self) -> int:
        """Documents that are live."""
        folders = self.tables.folders()
        parts = self._segments(folders)
        return self._hidden(self._table("docs", folders, parts).select("id", "seg"), folders).count() if parts else 0

    def search(self, queries: DataFrame, k: int = 20, idf: bool = False, keep: DataFrame | None = None) -> DataFrame:
        """query_id, id, score, rn: the rows that ``retrieval.bm25`` gives for the live documents, of the ids in ``keep`` only."""
        return self.search_counted(queries, k, idf, keep)[0]

    def search_counted(self, queries: DataFrame, k: int = 20, idf: bool = False, keep: DataFrame | None = None) -> tuple[DataFrame, int, int]:
        """``search``, the (query, block) pairs whose postings were scored, and all that hold a term of the query.

        Queries of up to a block of ``retrieval.BLOCK`` go to the executors. More of them meet the live documents' terms in a join, and
        all documents are scored (no pairs are counted then: 0, 0).
        """
        folders = self.tables.folders()
        parts = self._segments(folders)
        if not parts:
            return self.spark.createDataFrame([], "query_id long, id long, score double, rn long"), 0, 0
        texts = queries.select(F.col("query_id").cast("long").alias("query_id"), F.array_distinct(tokens(F.col("text"))).alias("terms"), "text")
        block = texts.drop("text").orderBy("query_id").limit(retrieval.BLOCK + 1).collect()
        if len(block) > retrieval.BLOCK:
            return self._joined(texts, folders, parts, k, idf, keep), 0, 0
        queries_ = np.array([r[0] for r in block], np.int64)
        words = sorted({t for r in block for t in r[1] or ()})
        number = {t: j for j, t in enumerate(words)}
        asks = np.zeros((len(words), len(block)))
        for i, r in enumerate(block):
            asks[[number[t] for t in r[1] or ()], i] = 1.0
        rows = self._table("segment", folders, parts).where(F.col("bucket").isin(sorted({bucket(t) for t in words})))
        places = self._places(folders, parts, None)
        worth = self._worth(rows, places, words, any(x.startswith("dead-") for x in folders)) if idf else np.ones(len(words))
        if keep is not None:
            places = self._places(folders, parts, keep)
        places = stage(places, "places")

        def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in runs(batches, 2):
                t = whole(table, "t").flatten().to_numpy()
                most = whole(table, "mosts").flatten().to_numpy() * worth[t]
                # nothing but the block's own terms is multiplied
                bounds, n = most @ asks[t], whole(table, "ns").flatten().to_numpy() @ asks[t]
                at = np.flatnonzero(n)
                of = lambda i: pa.array(np.full(len(at), table.column(i)[0].as_py(), np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(queries_[at]), of(0), of(1), pa.array(bounds[at])], names=["query_id", "seg", "block", "bound"])

        bounds = stage(by_block(wanted_only(rows, words, False)).mapInArrow(bound, "query_id long, seg int, block int, bound double"), "bounds")
        # the most promising blocks
        w = Window.partitionBy("query_id").orderBy(F.desc("bound"), "seg", "block")
        first = bounds.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= 2 + k // 8)

        def scored(pairs: DataFrame, floors: np.ndarray) -> DataFrame:
            # each block is read and opened once, and scored for all queries: its rows are theirs, whatever block they asked for
            own = stage(pairs.select("seg", "block").distinct(), "own")
            some = F.broadcast(own) if own.count() <= SMALL else own
            posts = wanted_only(rows.join(some, ["seg", "block"], "left_semi"), words, True)
            units = by_block(places.join(some, ["seg", "block"], "left_semi").unionByName(posts.drop("mosts"), allowMissingColumns=True))

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                best = Best(queries_, k)
                best.floor = floors.copy()
                for table in runs(batches, 2):
                    ids, sizes, _, t, place, tf = opened(table)
                    if not len(t):
                        continue
                    mine, t = np.unique(t, return_inverse=True)
                    hit, place = np.unique(place, return_inverse=True)
                    gives = np.zeros((len(hit), len(mine)))
                    gives[place, t] = impact(tf, sizes[hit][place]) * worth[mine][t]
                    scores = (gives @ asks[mine]).T
                    # a document without any of a query's terms is no hit
                    scores[scores == 0] = np.nan
                    best.add(np.round(scores, 6) + 0.0, ids[hit])
                yield best.rows()

            return units.mapInArrow(run, "query_id long, id long, score double")

        none = np.full(len(queries_), -np.inf)
        floor = top_k(scored(first, none), k).where(F.col("rn") == k).select("query_id", F.col("score").alias("floor"))
        floor = stage(floor, "floor")
        wanted = stage(bounds.join(F.broadcast(floor), "query_id", "left").where(F.col("floor").isNull() | (F.col("bound") + 1e-6 >= F.col("floor"))), "wanted")
        found = dict(floor.collect())
        floors = np.array([found.get(q, -np.inf) for q in queries_.tolist()])
        return top_k(scored(wanted, floors), k), wanted.count(), bounds.count()

    def _worth(self, rows: DataFrame, places: DataFrame, words: list[str], hidden: bool) -> np.ndarray:
        """The weight of each word by the live documents that have it: a task sends on one count a word."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            df = np.zeros(len(words), np.int64)
            if hidden:
                for table in runs(batches, 2):
                    df += np.bincount(opened(table)[3], minlength=len(words))
            else:
                for b in batches:
                    df += np.bincount(b.column(2).flatten().to_numpy(), b.column(3).flatten().to_numpy(), minlength=len(words)).astype(np.int64)
            at = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], names=["t", "df"])

        some = wanted_only(rows, words, hidden).drop("mosts")
        some = by_block(places.unionByName(some, allowMissingColumns=True)) if hidden else some
        total, out = self.count(), np.zeros(len(words))
        for t, df in some.mapInArrow(run, "t int, df long").groupBy("t").agg(F.sum("df")).collect():
            out[t] = math.log(1 + (total - df + 0.5) / (df + 0.5))
        return out

    def _joined(self, queries: DataFrame, folders: dict[str, str], parts: list[tuple[int, int]], k: int, idf: bool, keep: DataFrame | None) -> DataFrame:
        """The search for more queries than a block."""
        live = self._docs(folders, parts)
        posts = live.select("id", "doc_len", F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf"))))
        df = posts.groupBy("term").agg(F.count("*").alias("df")) if idf else None
        posts = posts if keep is None else posts.join(keep.select("id"), "id", "left_semi")
        return bm25(queries, posts, k, n_docs=self.count() if idf else None, df=df)
