"""What the corpus operators share: the shared work folder, saved steps, text access."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; the contracts name it as [\x20\x09-\x0D].
ASCII_SPACE = " \t\n\x0b\f\r"


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file, installed alike on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def work_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and written steps: the session's spark.checkpoint.dir. Only
    where that is unset and all runs on this machine (tests, a laptop), a folder of its own is
    made and kept for the session; on a cluster that is an error."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not place:
        place = getattr(sc, "_waygrid_dir", None)
        if not place:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            place = sc._waygrid_dir = tempfile.mkdtemp(prefix="waygrid-")
    return place.rstrip("/")


def saved(df: DataFrame, name: str, codec: str = "zstd", by: list[str] | None = None, **options: str) -> DataFrame:
    """Writes df as Parquet to the shared folder, a folder a value of `by`, and reads it back.

    This cuts the lineage: a lost executor costs no recomputation of what came before,
    and what is read twice is computed once."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).options(**options).parquet(path, partitionBy=by)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def strings(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Texts of an Arrow column; null counts as the empty text."""
    return [x or "" for x in column.to_pylist()]


def utf8_size(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode())


def by_bytes(items: list, sizes: list[int], most: int):
    """Slices of items, in order, of about `most` bytes each (one item at least)."""
    first, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield items[first:i]
            first, total = i, 0
        total += n
    if first < len(items):
        yield items[first:]


def row_hash(*columns) -> F.Column:
    """128 bits of the columns as hex; a null column differs from an empty one."""
    return F.md5(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("+"), c.cast("string")), F.lit("-")) for c in columns]))


def dropped(df: DataFrame) -> None:
    """Deletes a saved step that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def shuffles_end_with_steps(spark: SparkSession):
    """What is saved in this context has its shuffle files deleted as soon as it is written."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)
