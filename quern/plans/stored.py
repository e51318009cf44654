"""Indexes over the driver's tables, built once in an application and shared by its queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.grep_index import GrepIndex
from quern.operators.segments import Segments
from quern.operators.vector_index import VectorIndex
from quern.session import shared_dir

_BUILT: dict[tuple, str] = {}


def exists(spark, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def written_at(spark, path: str) -> tuple[int, int]:
    """When a table was last written, and its bytes: an index is built anew if its table has changed."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getFileStatus(at).getModificationTime(), fs.getContentSummary(at).getLength()


def once(t, name: str, table: str, build) -> str:
    """The folder that ``build(folder)`` has filled for this table, in this application."""
    source = f"{t.folder}/{table}.parquet"
    key = (t.spark.sparkContext.applicationId, name, source, *written_at(t.spark, source))
    if key not in _BUILT or not exists(t.spark, _BUILT[key]):
        folder = f"{shared_dir(t.spark)}/{t.spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
        build(folder)
        _BUILT[key] = folder
    return _BUILT[key]


def documents(t) -> Segments:
    """The inverted index of the documents: they are tokenised once."""
    return Segments(t.spark, once(t, "segments", "documents", lambda f: Segments(t.spark, f).upsert(t.documents, "doc_id", new=True)))


def vectors(t) -> VectorIndex:
    """The inverted lists of the embeddings."""
    rows = lambda: t.embeddings.selectExpr("vec_id as id", "embedding as vec")
    return VectorIndex(t.spark, once(t, "vectors", "embeddings", lambda f: VectorIndex(t.spark, f).build(rows())))


def document_files(t) -> DataFrame:
    """Documents as files named by their source."""
    return t.documents.select(F.concat("source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("path"), "text")


def lines(t) -> GrepIndex:
    """The substring index of the documents."""
    return GrepIndex(t.spark, once(t, "grams", "documents", lambda f: GrepIndex(t.spark, f).build(document_files(t))))
