"""Helpers shared by the training-data operators: scratch tables, column idioms, connected components."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); a temporary one where it is unset and there is no
    cluster, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spliceframe-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the session ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and reread it: computed once, lineage cut, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def unstash(df: DataFrame) -> None:
    """Delete a stashed table that no later plan reads."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(df._stash_path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files that no plan reads any more: it does so once the driver collects garbage."""
    gc.collect()
    spark._jvm.System.gc()


def give_back() -> None:
    """Return what this process has freed, in Arrow's pool and the C library's, to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def tidily(function: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """A function of batches that leaves no freed memory with its Python worker, which later stages reuse."""

    @functools.wraps(function)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from function(batches)
        finally:
            give_back()

    return run


def local_path(uri: str) -> str:
    """file: URIs as plain paths; other URIs unchanged."""
    for prefix in ("file://", "file:"):
        if uri.startswith(prefix):
            return "/" + uri[len(prefix):].lstrip("/")
    return uri


def open_shared(uri: str, mode: str):
    """Open a file of the shared folder for bytes: plain files directly, other stores through pyarrow."""
    path = local_path(uri)
    if "://" not in path:
        if "w" in mode:
            os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, mode)
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    if "w" in mode:
        store.create_dir(os.path.dirname(inner), recursive=True)
        return store.open_output_stream(inner, compression=None)
    return store.open_input_file(inner)


def rename_shared(old: str, new: str) -> None:
    """Move a finished file to its final name; the move replaces what an earlier attempt left."""
    a, b = local_path(old), local_path(new)
    if "://" not in a:
        os.replace(a, b)
        return
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(a)
    store.move(inner, fs.FileSystem.from_uri(b)[1])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, also where body's lambdas use it for each element."""
    return F.transform(F.array(value), body)[0]


def runs(sorted_array: Column) -> Column:
    """Of a sorted array without nulls, the start (from 0) of each run of equal elements."""
    return F.filter(
        F.sequence(F.lit(0), F.size(sorted_array) - 1),
        lambda i: (i == 0) | (F.get(sorted_array, i) != F.get(sorted_array, i - 1)),
    )


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; texts of one byte a character take the faster built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text column with null as the empty text."""
    return F.coalesce(df[column], F.lit(""))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges(u, v): rows (node, root), root the least node reachable.

    Alternates large-star and small-star steps: each is an aggregate with map-side combine and a join, so a node
    with very many neighbours is no group in one task. Each round's edges are written to the shared folder, and the
    one before is deleted. Nodes without edges have no row.
    """
    spark = edges.sparkSession
    if edges.schema["u"].dataType != edges.schema["v"].dataType:
        raise ValueError("u and v must have one type")

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        joined = both.join(least, "u")
        if large:
            return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v"))
        )

    # held as u > v
    now = stash(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    mark = None
    for _ in range(max_rounds):
        grown = star(star(now, True).where("u <> v").distinct(), False).where("u <> v")
        after = stash(grown.distinct(), "edges")
        unstash(now)
        now = after
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
