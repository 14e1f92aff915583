"""What the operators share: words, tables staged in the shared folder, Arrow maps."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, as Spark and DuckDB patterns read it.
BLANKS = "[\\x20\\x09-\\x0D]+"


#: Folders of sessions on one machine that name none.
OWN_FOLDERS: dict[str, str] = {}
#: Bytes of rows that are Python objects at once.
SLICE_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is read from ``spark.checkpoint.dir``. Only a session of one machine may leave
    that unset; it then gets a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a shared folder")
    app = spark.sparkContext.applicationId
    if app not in OWN_FOLDERS:
        OWN_FOLDERS[app] = "file://" + tempfile.mkdtemp(prefix="postmatch-llm-")
    return OWN_FOLDERS[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table: computed once, with no lineage behind it."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_path(path: str) -> str:
    """A path of a mounted shared folder as the file system names it."""
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        raise ValueError(f"{path} is not mounted as a file system")
    return os.path.abspath(path)


def slices(batches: Iterator[pa.RecordBatch], times: int = 1) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about ``times`` SLICE_BYTES; a larger row is one of its own."""
    for batch in batches:
        rows = max(1, batch.num_rows * SLICE_BYTES * times // max(batch.nbytes, 1))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None],
                schema: str) -> DataFrame:
    """``work`` on slices of the Arrow batches of ``df``; nothing is kept between them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out = work(part)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [x or "" for x in batch.column(name).to_pylist()]


def raw_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The texts as UTF-8; ``bytes.split`` and ``bytes.lower`` know ASCII only, so
    they cut at ``[\\x20\\x09-\\x0D]`` and lower-case A-Z just as the rules ask."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def words(text: Column) -> Column:
    """The words of a text as an array, empty for null; in SQL functions only."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANKS))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, longer by as many ``_`` as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def thin(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that further ones cannot clash with results."""
    return docs.select(*(F.col(f"`{n}`") for n in names))
