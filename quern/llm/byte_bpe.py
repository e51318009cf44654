"""Byte-level BPE encoding and decoding by overlapping chunks.

Texts over ``CHUNK`` code points are cut into overlapping chunks that are pre-tokenised in parallel, as rows of their own.
Neighbouring chunks are stitched at a place that is a pre-token boundary in both; as the pre-token that starts at a place
depends only on what follows it, everything from there on is right. Where two chunks do not resynchronise within their
overlap, the text from the last sure boundary is pre-tokenised again, so the result is always exact. The pieces are then
encoded one by one by the ranks; decoding looks up the bytes of every id and concatenates them. A long text's chunks pass through
one after the other, its ids and bytes go into running digests, and no task holds more than two chunks of it (more only where
a pre-token is longer than a chunk).

Defined results: null counts as the empty text, which has no tokens and the digests of the empty string; texts of any
length are encoded whole; repeated rows give equal rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.tables import arrow_map, arrow_schema, parquet

CHUNK, OVERLAP = 32768, 1024
#: Longest look beyond a pre-token's start that its end can depend on, past the token itself.
MARGIN = 4
CACHE = 150_000


def vocabulary() -> tuple[str, str]:
    """Path of the ranks and the pre-token pattern of the public tokenizer."""
    import public_tokenizers as P

    return P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN


class Codec:
    """Encodes pre-tokens by ranks and decodes ids; pieces seen before are looked up."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.piece = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.seen: dict[str, list[int]] = {}

    def split(self, text: str) -> list[str]:
        """Pre-tokens; the pattern covers every character."""
        return self.pattern.findall(text)

    def encode(self, pieces: list[str]) -> list[int]:
        seen, out = self.seen, []
        if len(seen) > CACHE:
            seen.clear()
        for p in pieces:
            ids = seen.get(p)
            if ids is None:
                ids = self.piece(p)
                if len(p) <= 64:
                    seen[p] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def chunks(text: str, size: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, str]]:
    """(start, text) of overlapping chunks."""
    step = size - overlap
    return [(s, text[s : s + size]) for s in range(0, max(1, len(text) - overlap), step)]


class Stitch:
    """Pre-tokens of a text from its chunks, which are fed in order; what is sure is given out at once."""

    def __init__(self, c: Codec):
        self.codec, self.start, self.sure, self.text = c, 0, 0, None
        self.ends: Sequence[int] = []

    def _emit(self, upto: int) -> list[str]:
        low, out = bisect_right(self.ends, self.sure), []
        for k in range(low, bisect_right(self.ends, upto, low)):
            e = self.ends[k]
            out.append(self.text[self.sure - self.start : e - self.start])
            self.sure = e
        return out

    def feed(self, at: int, more: str, more_ends: Sequence[int]) -> list[str]:
        if self.text is None:
            self.start, self.text, self.ends = at, more, more_ends
            return []
        stop = self.start + len(self.text)
        trusted = bisect_right(self.ends, stop - MARGIN)
        if trusted and trusted == len(self.ends):
            trusted -= 1
        # the first place from which both chunks agree: walk the two sorted lists
        meet, i, j = None, bisect_left(self.ends, max(at, self.sure)), 0
        while i < trusted and j < len(more_ends):
            if self.ends[i] == more_ends[j]:
                meet = self.ends[i]
                break
            if self.ends[i] < more_ends[j]:
                i += 1
            else:
                j += 1
        if meet is not None:
            out = self._emit(meet)
            self.start, self.text, self.ends = at, more, more_ends
            return out
        out = self._emit(self.ends[trusted - 1]) if trusted else []
        self.text = self.text[self.sure - self.start :] + more[stop - at :]
        self.start = self.sure
        self.ends = [self.start + e for e in accumulate(map(len, self.codec.split(self.text)))]
        return out

    def finish(self) -> list[str]:
        return [] if self.text is None else self._emit(self.start + len(self.text))


class Digest:
    """Counts and digests of ids and decoded bytes, piece by piece."""

    def __init__(self, c: Codec):
        self.codec, self.n_tokens, self.n_pieces = c, 0, 0
        self.ids, self.bytes = hashlib.sha256(), hashlib.sha256()

    def add(self, pieces: list[str]) -> None:
        ids = self.codec.encode(pieces)
        if ids:
            self.ids.update(("," if self.n_tokens else "").encode() + ",".join(map(str, ids)).encode())
            self.bytes.update(self.codec.decode(ids))
        self.n_tokens += len(ids)
        self.n_pieces += len(pieces)

    def row(self, doc_id: int | None) -> tuple:
        return doc_id, self.n_tokens, self.ids.hexdigest(), self.bytes.hexdigest(), self.n_pieces


_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_pieces long"


def pretokenised(docs: DataFrame, id_col: str, text: str, path: str, pattern: str, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of texts over ``size`` as rows: row, doc_id, start, text, ends. Chunks are spread before they are split."""
    long = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.length("text") > size)

    def cut(batch: pa.RecordBatch) -> dict:
        rows = [(r, d, s, x) for r, d, t in zip(*(c.to_pylist() for c in batch.columns)) for s, x in chunks(t, size, overlap)]
        return dict(zip(("row", "doc_id", "start", "text"), map(list, zip(*rows))))

    def split(batch: pa.RecordBatch) -> dict:
        c, starts, texts = codec(path, pattern), batch.column(2).to_pylist(), batch.column(3).to_pylist()
        ends = [[s + e for e in accumulate(map(len, c.split(t)))] for s, t in zip(starts, texts)]
        return {"row": batch.column(0), "doc_id": batch.column(1), "start": batch.column(2), "text": batch.column(3), "ends": ends}

    parts = arrow_map(long, cut, "row long, doc_id long, start long, text string").repartition("row", "start")
    return arrow_map(parts, split, "row long, doc_id long, start long, text string, ends array<long>")


def encode_digests(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Token counts and digests of ids and decoded bytes of every text."""
    path, pattern = vocabulary()
    want = arrow_schema(_SCHEMA)

    def table(rows: list[tuple]) -> dict:
        return dict(zip(want.names, map(list, zip(*rows))))

    def short(batch: pa.RecordBatch) -> dict:
        c, out = codec(path, pattern), []
        for doc_id, t in zip(*(x.to_pylist() for x in batch.columns)):
            d = Digest(c)
            d.add(c.split(t or ""))
            out.append(d.row(doc_id))
        return table(out)

    def whole(batches):
        c, last = codec(path, pattern), None
        for b in batches:
            ends = b.column(4)
            flat, cut = ends.flatten().to_numpy(), np.concatenate([[0], np.cumsum(ends.value_lengths().to_numpy())])
            for k, (row, doc_id, start, t) in enumerate(zip(*(b.column(i).to_pylist() for i in range(4)))):
                if last != row:
                    if last is not None:
                        digest.add(stitch.finish())
                        yield pa.RecordBatch.from_pydict(table([digest.row(held)]), schema=want)
                    last, held, stitch, digest = row, doc_id, Stitch(c), Digest(c)
                digest.add(stitch.feed(start, t, flat[cut[k] : cut[k + 1]].tolist()))
        if last is not None:
            digest.add(stitch.finish())
            yield pa.RecordBatch.from_pydict(table([digest.row(held)]), schema=want)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    direct = arrow_map(rows.where(F.coalesce(F.length("text") <= size, F.lit(True))), short, _SCHEMA)
    pieces = pretokenised(rows, "doc_id", "text", path, pattern, size, overlap).repartition("row").sortWithinPartitions("row", "start")
    return direct.unionByName(pieces.mapInArrow(whole, _SCHEMA))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(parquet(spark, sf_dir, "documents")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
