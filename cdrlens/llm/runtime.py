"""Shared Spark plumbing of the text operators: scratch tables, worker imports, Arrow mapping."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes that one Python call works on; a longer text is worked on alone.
SLICE_BYTES = 1 << 20

_ROOT = str(Path(__file__).resolve().parents[2])
_scratch_roots: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine, as in tests, a temporary folder is made.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if spark not in _scratch_roots:
        _scratch_roots[spark] = tempfile.mkdtemp(prefix="cdrlens-")
    return _scratch_roots[spark]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Tables written to the shared folder in order to cut lineage; an executor's loss costs none."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(self.close)

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            _delete(self.spark, df._scratch_path)

    def close(self) -> None:
        """Delete everything, at the driver's exit (results may read these tables until then)."""
        try:
            _delete(self.spark, self.root)
        except Exception:  # the session may be gone already; the folder is scratch
            pass


#: Bytes of an Arrow batch between Spark and Python, where the session leaves Spark's default of 64 MB.
ARROW_BYTES = 8 << 20
_ARROW_SETTING, _ARROW_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def ship(spark: SparkSession) -> None:
    """Let Python workers started on this machine import this package, and keep batches of texts small:
    they are held several times over, on both sides."""
    if spark.conf.get(_ARROW_SETTING) == _ARROW_DEFAULT:
        spark.conf.set(_ARROW_SETTING, f"{ARROW_BYTES}b")
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if _ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, have) if x)


def unused(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _slices(column: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text each, or of one row."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(sizes):
        yield start, len(sizes)


def with_text_columns(
    df: DataFrame,
    make: Callable[[], Callable[[list], dict]],
    fields: str | T.StructType,
    text: str = "text",
    keep: str | None = None,
    drop_text: bool = False,
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """Add the columns ``fields`` computed from the whole texts in column ``text``.

    ``make()`` runs once a task and gives a function from a list of UTF-8 ``bytes`` (``None`` for a
    null text) to a dict of lists or Arrow arrays. Columns of ``df`` with the name of an added one
    are replaced; all others pass unchanged, whatever they hold. ``keep`` names an added boolean
    column: only its true rows stay and the added columns go again.
    """
    import pyarrow.compute  # noqa: F401

    ship(df.sparkSession)
    added = T._parse_datatype_string(fields) if isinstance(fields, str) else fields
    names = {f.name.lower() for f in added.fields}
    passed = [f for f in df.schema.fields if keep or f.name == text or f.name.lower() not in names]
    sent = df.select(*[F.col(f"`{f.name}`") for f in passed])
    out_passed = [f for f in passed if keep or not (f.name == text and drop_text) and f.name.lower() not in names]
    result = T.StructType(out_passed if keep else out_passed + added.fields)
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = {f.name: to_arrow_type(f.dataType) for f in added.fields}
    out_names = [f.name for f in out_passed]

    def work(batches):
        import pyarrow.compute as pc

        call = make()
        for batch in batches:
            whole = pa.Table.from_batches([batch])
            texts = whole[text].combine_chunks()
            texts = (texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts).cast(pa.binary())
            for a, b in _slices(texts, limit):
                got = call(texts.slice(a, b - a).to_pylist())
                cols = {k: got[k] if isinstance(got[k], pa.Array) else pa.array(got[k], t) for k, t in arrow.items()}
                part = whole.slice(a, b - a).select(out_names)
                if keep:
                    part = part.filter(pc.fill_null(cols[keep], False))
                else:
                    for k, t in arrow.items():
                        part = part.append_column(k, cols[k].cast(t))
                yield from part.combine_chunks().to_batches()

    return sent.mapInArrow(work, result)
