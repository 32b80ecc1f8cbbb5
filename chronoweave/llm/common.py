"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from contextvars import ContextVar

from py4j.protocol import Py4JError
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII letters and digits stay (A-Z in lower case), other ASCII becomes a space, bytes of multi-byte characters stay.
ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256))


def alnum_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text with A-Z lower-cased, as UTF-8."""
    return utf8(text).translate(ALNUM).split() if text else []


def utf8(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one is set only where the session names none."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = got.get() if got.isDefined() else None
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        at = "file://" + tempfile.mkdtemp(prefix="chronoweave-")
        spark.sparkContext.setCheckpointDir(at)
    return at


_scratches: ContextVar[tuple] = ContextVar("scratches", default=())
#: Tables that results still read: path and Hadoop settings. release() deletes them, at the program's end at the latest.
_results: dict[str, object] = {}
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to Parquet in the shared folder and read that. It survives the loss of any executor. The
    shuffle files of the write go with its end; the table goes with the innermost scratch() that doesn't keep it."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    inner = _scratches.get()
    (inner[-1].tables if inner else _results)[at] = spark._jsparkSession.sessionState().newHadoopConf()
    was = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(at)
    finally:
        spark.conf.set(CLEANUP, was)
    out = spark.read.schema(df.schema).parquet(at)
    out._chronoweave_path = at
    return out


def _delete(tables: dict[str, object], paths: list[str]) -> None:
    for at in paths:
        conf = tables.pop(at)
        path = SparkContext._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(conf).delete(path, True)


class scratch:
    """A block whose stored tables are deleted at its end, however it ends. ``keep`` hands a table on to the block
    around it or, if there is none, to release()."""

    def __enter__(self) -> scratch:
        self.tables, self.kept = {}, set()
        self.token = _scratches.set((*_scratches.get(), self))
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept.add(df._chronoweave_path)
        return df

    def __exit__(self, *error) -> None:
        _scratches.reset(self.token)
        outer = _scratches.get()
        if error[0] is None:
            (outer[-1].tables if outer else _results).update({at: self.tables.pop(at) for at in self.kept if at in self.tables})
        _delete(self.tables, list(self.tables))


def release() -> None:
    """Delete the tables that results of this program have read. Call it when those results are written."""
    if SparkContext._jvm is not None:
        _delete(_results, list(_results))


@atexit.register
def _at_exit() -> None:
    with contextlib.suppress(Py4JError, OSError):  # the JVM may be gone before us
        release()


def discard(df: DataFrame) -> None:
    """Delete a table of materialize() that nothing reads any more."""
    at = getattr(df, "_chronoweave_path", None)
    for tables in (_results, *(s.tables for s in _scratches.get())):
        if at in tables:
            _delete(tables, [at])


#: A table up to this size is broadcast.
BROADCAST_BYTES = 8 << 20


def fits(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the rows of a stored table take at most ``limit`` bytes, by the sum of what their values take."""
    each = F.lit(16)
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.simpleString()
        if kind in ("string", "binary"):
            each = each + F.coalesce(F.octet_length(c), F.lit(0))
        elif kind == "array<string>":
            each = each + F.coalesce(F.octet_length(F.array_join(c, "")) + 16 * F.size(c), F.lit(0))
        elif kind.startswith("array"):
            each = each + F.coalesce(8 * F.size(c), F.lit(0))
        else:
            each = each + 8
    return (df.agg(F.sum(each.cast("long"))).first()[0] or 0) <= limit


def small(df: DataFrame, otherwise: str | None = None) -> DataFrame:
    """Marked for a broadcast if its measured size allows it; if not, with the hint ``otherwise``."""
    return F.broadcast(df) if fits(df) else df.hint(otherwise) if otherwise else df


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z only. ASCII texts take the fast built-in; in others lower() would also change letters beyond ASCII."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(
        F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def held_out(doc_id: Column) -> Column:
    """True for the third of all documents from which no model learns."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1


def grouped_texts(it, size: int = 4 << 20):
    """Cut Arrow batches into lists of rows of about ``size`` characters, so that temporaries stay small.

    ``it`` yields pyarrow record batches with doc_id and text as the first two columns."""
    for batch in it:
        ids, texts = batch.column(0), batch.column(1)
        part_ids, part, n = [], [], 0
        for k in range(batch.num_rows):
            t = texts[k].as_py()
            part_ids.append(ids[k].as_py())
            part.append(t)
            n += len(t or "")
            if n >= size:
                yield part_ids, part
                part_ids, part, n = [], [], 0
        if part_ids:
            yield part_ids, part
    import pyarrow as pa

    pa.default_memory_pool().release_unused()  # the worker lives on
