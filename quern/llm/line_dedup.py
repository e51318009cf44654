"""Fuzzy line deduplication.

Lines are sets of runs of ``K_CHARS`` characters. Signatures of lines with at least as many different shingles as the signature
has bins are one-permutation MinHashes (one hash a shingle, the least in each bin, empty bins filled from the next full one);
lines with fewer get MinHashes of as many functions as the bands need, and lines near the limit get both, so that every pair at
the threshold shares a kind. Bands and bins follow the threshold and aim at a recall of ``RECALL`` at it.
Candidates are verified by the exact Jaccard similarity of their shingle sets, and distributed union-find joins the verified
links. Of each component the first line (least id, then place) stays, all others go; so do exact repeats.

Lines are known by a 64-bit hash; among n different lines two share one with a chance of n^2 / 2^65.

Defined results: null counts as empty; lines are what stands between \n; lines of white space only are never removed, unless
they are all that is left of a text; a line of fewer than K_CHARS characters is one shingle, all of it; texts and lines of any length are read whole;
rows that are equal in id and text count as one document and keep the same lines, rows that repeat an id with another text
are other documents; a null id counts as the largest; an empty table gives an empty result; ``clean`` keeps further columns.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quern.llm import kernel as K
from quern.llm.components import components
from quern.llm.similar import Sets, band_edges, bucket_count, classes, packed_stars, verified
from quern.llm.tables import parquet, small_batches, spread_join, stage

K_CHARS, THRESHOLD, RECALL, ROWS = 9, 0.8, 0.99, 5
#: Keys of lines (16 bytes each) that are broadcast at most; rows of decided lines that are.
SPOTS, SMALL = 400_000, 10_000
#: Stands for a null id.
LAST = (1 << 63) - 1
_N = 1 << 17
_POW = K.powers(0x9E3779B97F4A7C15, _N + 64)
_BACK = K.powers(pow(0x9E3779B97F4A7C15, -1, 1 << 64), _N + 64)


def _scatter(x: np.ndarray) -> np.ndarray:
    x *= K.U(0xD6E8FEB86659FD93)
    x ^= x >> K.U(32)
    x *= K.U(0x9FB21C651E98DF25)
    return x


def shingles(chars: np.ndarray, at: np.ndarray, k: int = K_CHARS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k code points, line by line, and each line's first; a shorter line has one run, all of it."""
    size = np.diff(at)
    count = np.where(size >= k, size - k + 1, (size > 0).astype(size.dtype))
    out_at = np.concatenate([[0], np.cumsum(count)])
    n = len(chars) - k + 1
    with np.errstate(over="ignore"):
        value = (chars.astype(np.uint64) + K.U(0x1F123BB5)) * K.U(0xBF58476D1CE4E5B9)
        value ^= value >> K.U(29)
        h = np.zeros(max(n, 0), np.uint64)
        for low in range(0, max(n, 0), _N):
            high = min(low + _N, n)
            part = np.concatenate([[K.U(0)], np.cumsum(value[low : high + k - 1] * _POW[: high - low + k - 1])])
            h[low:high] = (part[k:] - part[: high - low]) * _BACK[: high - low]
        keep = np.arange(int(out_at[-1])) - np.repeat(out_at[:-1], count) + np.repeat(at[:-1], count)
        short = np.flatnonzero((size > 0) & (size < k))
        out = h[np.minimum(keep, max(n - 1, 0))] if n > 0 else np.zeros(len(keep), np.uint64)
        for d in short:
            part = value[at[d] : at[d + 1]]
            out[out_at[d]] = np.sum(part * _POW[: len(part)], dtype=np.uint64) + K.U(len(part))
        return _scatter(out), out_at


def code_units(texts: bytes) -> np.ndarray:
    """Code points of UTF-8 bytes."""
    return np.frombuffer(texts.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)


def layout(threshold: float) -> tuple[int, int]:
    """Bands for the threshold, and bins of a signature: the least power of two with room for them, which is also the number
    of shingles from which a line has few empty bins."""
    bands = K.choose_bands(threshold, RECALL, ROWS)
    return bands, 1 << (bands * ROWS - 1).bit_length()


def signatures(h: np.ndarray, at: np.ndarray, bins: int) -> np.ndarray:
    """(lines, bins) one-permutation MinHashes; empty bins take the next full bin's value, marked by the distance."""
    n = len(at) - 1
    bits = K.U(bins.bit_length() - 1)
    top = ~K.U(0)
    sig = np.full(n * bins, top)
    with np.errstate(over="ignore"):
        place = (h >> (K.U(64) - bits)).view(np.int64)
        place += np.repeat(np.arange(0, n * bins, bins), np.diff(at))
        np.minimum.at(sig, place, h << bits)
        sig = sig.reshape(n, bins)
        hollow = np.flatnonzero((sig == top).any(axis=1))
        if len(hollow):
            part = sig[hollow]
            full = part != top
            spot = np.where(np.concatenate([full, full], axis=1), np.arange(2 * bins), 3 * bins)
            after = np.minimum.accumulate(spot[:, ::-1], axis=1)[:, ::-1][:, :bins]
            far = np.minimum(after - np.arange(bins), bins)
            sig[hollow] = np.take_along_axis(part, after % bins, axis=1) + far.astype(np.uint64) * K.U(0xD6E8FEB86659FD93)
    return sig


def different(h: np.ndarray, at: np.ndarray, bins: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The shingles without repeats within a line, where a line has few different ones in many places; each line's first."""
    size = np.diff(at)
    long = np.flatnonzero(size >= bins)
    # one sort for all lines: the line's number above the hash's lower bits, which need only be enough to tell shingles apart
    bits = K.U(64 - max(len(long), 1).bit_length())
    spots = np.repeat(size >= bins, size)
    keys = np.repeat(np.arange(len(long), dtype=np.uint64) << bits, size[long]) | (h[spots] & ((K.U(1) << bits) - K.U(1)))
    keys.sort()
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[1:] != keys[:-1]
    kinds = np.bincount((keys[fresh] >> bits).view(np.int64), minlength=len(long))
    few = long[(kinds < bins / threshold) & (kinds < size[long])]
    if not len(few):
        return h, at
    parts, low = [], 0
    size = size.copy()
    for d in few:
        own = np.unique(h[at[d] : at[d + 1]])
        parts += [h[low : at[d]], own]
        size[d], low = len(own), at[d + 1]
    return np.concatenate([*parts, h[low:]]), np.concatenate([[0], np.cumsum(size)])


def line_keys(h: np.ndarray, at: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, line numbers) of both kinds of signature."""
    bands, bins = layout(threshold)
    h, at = different(h, at, bins, threshold)
    size = np.diff(at)
    keys, lines = [], []
    for kind, part in enumerate((np.flatnonzero((size > 0) & (size < bins / threshold)), np.flatnonzero(size >= bins))):
        if not len(part):
            continue
        take = np.zeros(len(size), bool)
        take[part] = True
        own, own_at = h[np.repeat(take, size)], np.concatenate([[0], np.cumsum(size[part])])
        sig = signatures(own, own_at, bins) if kind else K.minhash(own, own_at, bands * ROWS)
        keys.append((K.band_keys(sig, bands, ROWS) ^ K.U(kind * 0x632BE59BD9B4E019)).ravel())
        lines.append(np.repeat(part, bands))
    none = np.zeros(0, np.int64)
    return (np.concatenate(keys).view(np.int64), np.concatenate(lines)) if keys else (none, none)


def line_sets(texts: pa.Array) -> list[np.ndarray]:
    """The different shingle hashes of each line."""
    data, offs = K.utf8(texts)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    h, at = shingles(code_units(data.tobytes()), lead[offs])
    return [np.unique(h[at[i] : at[i + 1]]) for i in range(len(at) - 1)]


def candidate_bands(docs: DataFrame, buckets: int, threshold: float = THRESHOLD) -> DataFrame:
    """``packed_stars`` rows of all lines; each different line of a task's batch is hashed once."""

    def keyed(batches):
        for b in batches:
            seen: dict[int, bytes] = {}
            data, offs = K.utf8(b.column(0))
            raw = data.tobytes()
            for i in range(len(offs) - 1):
                for x in raw[offs[i] : offs[i + 1]].split(b"\n"):
                    if x and not x.isspace():
                        seen[xxhash.xxh64_intdigest(x, 42)] = x
            node, lines = np.fromiter(seen, np.uint64, len(seen)).view(np.int64), list(seen.values())
            low = 0
            while low < len(lines):
                high, size = low, 0
                while high < len(lines) and (size < _N or high == low):
                    size += len(lines[high])
                    high += 1
                part = lines[low:high]
                raw_part = b"".join(part)
                bytes_ = np.frombuffer(raw_part, np.uint8)
                lead = np.concatenate([[0], np.cumsum((bytes_ & 0xC0) != 0x80)])
                ends = lead[np.concatenate([[0], np.cumsum([len(x) for x in part])])]
                keys, line = line_keys(*shingles(code_units(raw_part), ends), threshold)
                yield keys, node[low:high][line]
                low = high

    small_batches(docs.sparkSession)
    return docs.mapInArrow(lambda it: packed_stars(keyed(it), buckets), "bucket int, edges boolean, a binary, b binary")


def _key(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))


def lines_of(docs: DataFrame) -> DataFrame:
    """doc, hash, place, line, node for every line with a character that is no white space."""
    rows = docs.select("doc", F.xxhash64("text").alias("hash"), F.posexplode(F.split("text", "\n", -1)).alias("place", "line"))
    return rows.where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).withColumn("node", F.xxhash64("line"))


def spot_side(keys: DataFrame, n: int) -> DataFrame:
    return F.broadcast(keys) if n <= SPOTS else keys


def removals(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, hash (of the text), place (from 0), node, comp of every line to remove."""
    base = docs.select(_key(id_col).alias("doc"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    small_batches(docs.sparkSession)
    lines = lines_of(base)
    spots = stage(lines.select("doc", "hash", "place", "node"), "spots")
    here = F.struct("doc", "place", "hash")
    nodes = stage(spots.groupBy("node").agg(F.min(here).alias("first"), F.count("*").alias("n")), "lines")
    buckets = bucket_count(docs.sparkSession, nodes.count() * layout(threshold)[0])
    comps = components(band_edges(candidate_bands(base.select("text"), buckets, threshold), buckets))
    chosen = stage(comps.join(nodes, "node").select("comp", F.col("node").alias("_node"), *[F.col(f"first.{c}").alias(f"_{c}") for c in ("doc", "place", "hash")]), "chosen")
    # a key of the place alone tells which lines are wanted; of these few the place itself then decides
    spot = lambda prefix="": F.xxhash64(*[F.col(f"{prefix}{c}") for c in ("node", "doc", "place", "hash")])
    keys = chosen.select(spot("_").alias("_spot")).distinct()
    few = lines.withColumn("_spot", spot()).join(spot_side(keys, chosen.count()), "_spot", "left_semi")
    first = [F.col(c) == F.col(f"_{c}") for c in ("node", "doc", "place", "hash")]
    text_of = few.join(chosen, first).select("comp", "node", F.lit(1).cast("long").alias("weight"), F.col("line").alias("text"))
    found = classes(verified(text_of, Sets(line_sets, as_text=True), threshold))
    linked = found.join(nodes, "node").select("node", "comp", "first")
    keepers = linked.groupBy("comp").agg(F.min("first").alias("keeper"))
    fuzzy = linked.join(keepers, "comp").select("node", "comp", "keeper")
    copies = nodes.where("n > 1").join(found.select("node"), "node", "left_anti").select("node", F.col("node").alias("comp"), F.col("first").alias("keeper"))
    decided = stage(fuzzy.union(copies), "decided")
    gone = spread_join(spots, decided, "node", small=SMALL, frequent=nodes).where(here != F.col("keeper"))
    return gone.select(F.when(F.col("doc") != LAST, F.col("doc")).alias("doc_id"), "hash", "place", "node", "comp")


def clean(docs: DataFrame, id_col: str = "doc_id", text: str = "text", gone: DataFrame | None = None, count_col: str = "n_lines_removed", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the lines to remove, all columns kept, plus ``count_col``: the lines removed.

    A text that loses all its lines but blank ones becomes null, as nothing of it is left.
    """
    gone = removals(docs, id_col, text, threshold) if gone is None else gone
    key, places = f"_{uuid.uuid4().hex}", f"_{uuid.uuid4().hex}"
    per_doc = gone.groupBy(_key("doc_id").alias(key), F.col("hash").alias(f"{key}_hash")).agg(F.collect_set("place").alias(places))
    same = (_key(id_col) == F.col(key)) & (F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))) == F.col(f"{key}_hash"))
    at, last, names = docs.columns.index(text), len(docs.columns), docs.columns
    joined = docs.join(per_doc, same, "left").drop(key, f"{key}_hash")

    def run(batches):
        for b in batches:
            old, drop, new, count = b.column(at).to_pylist(), b.column(last).to_pylist(), [], []
            for t, g in zip(old, drop):
                if g:
                    g = set(g)
                    rest = [x for i, x in enumerate(t.split("\n")) if i not in g]
                    t = "\n".join(rest) if any(x and not x.isspace() for x in rest) else None
                new.append(t)
                count.append(len(g) if g else 0)
            cols = [b.column(i) for i in range(last)]
            cols[at] = pa.array(new, b.column(at).type)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(count, pa.int64())], names=[*names, count_col])

    small_batches(docs.sparkSession)
    fields = [StructField(f.name, f.dataType, f.nullable or f.name == text) for f in docs.schema.fields]
    return joined.mapInArrow(run, StructType([*fields, StructField(count_col, LongType())]))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the text that is left of it."""
    out = clean(parquet(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines_removed", "text")


OP9_SQL = r"""
WITH RECURSIVE o AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents),
f AS (SELECT *, regexp_matches(line, '[^\x20\x09-\x0D]') AS full_line FROM o),
u AS (SELECT line, min({'d': doc_id, 'p': place}) AS first_at, row_number() OVER (ORDER BY min({'d': doc_id, 'p': place})) AS id FROM f WHERE full_line GROUP BY line),
s AS (SELECT DISTINCT id, unnest(CASE WHEN length(line) >= 9 THEN list_transform(range(1, length(line) - 7), lambda i: substr(line, i, 9)) ELSE [line] END) AS g FROM u),
n AS (SELECT id, count(*) AS c FROM s GROUP BY id),
h AS (SELECT s.*, n.c, row_number() OVER (PARTITION BY s.id ORDER BY m.k, s.g) AS r FROM s JOIN n USING (id) JOIN (SELECT g, count(*) AS k FROM s GROUP BY g) m USING (g)),
x AS (SELECT id, g, c FROM h WHERE r <= c - ceil(0.8 * c) + 1),
k AS (SELECT DISTINCT a.id AS a, b.id AS b FROM x a JOIN x b ON a.g = b.g AND a.id < b.id WHERE a.c >= 0.8 * b.c AND b.c >= 0.8 * a.c),
p AS (SELECT k.a, k.b, count(*) AS k FROM k JOIN s x ON x.id = k.a JOIN s y ON y.id = k.b AND y.g = x.g GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.id = p.a JOIN n y ON y.id = p.b WHERE 5 * k >= 4 * (x.c + y.c - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT id AS node, id AS low FROM u UNION SELECT e.b, r.low FROM r JOIN e ON e.a = r.node WHERE r.low < e.b),
keep AS (SELECT u.line, (SELECT v.first_at FROM u v WHERE v.id = (SELECT min(low) FROM r WHERE node = u.id)) AS at_ FROM u),
j AS (SELECT f.*, NOT f.full_line OR {'d': doc_id, 'p': place} = keep.at_ AS stays FROM f LEFT JOIN keep USING (line)),
t AS (SELECT doc_id, count(*) FILTER (NOT stays) AS gone, bool_or(stays AND full_line) AS any_left, string_agg(line, chr(10) ORDER BY place) FILTER (stays) AS rest FROM j GROUP BY doc_id)
SELECT d.doc_id, t.gone::BIGINT AS n_lines_removed, CASE WHEN gone = 0 THEN d.text WHEN any_left THEN rest END AS text FROM documents d JOIN t USING (doc_id)
"""
