"""Session services shared by all operators: code shipping, scratch tables, exact running sums."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_shipped: set[str] = set()
_scratch: dict[str, str] = {}
#: Tables that are cheap to build again, which a worker keeps for a task's time only.
caches: list[dict] = []


def ship(spark: SparkSession) -> None:
    """Send this package to every executor once per application, so Python stages can import it anywhere.

    Rows go to Python in batches of at most 1000, unless the session says less: texts
    are long, and Spark's usual 10,000 would hold many megabytes in every task.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 1000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="lumendex-"), "lumendex.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("lumendex", os.path.relpath(path, root)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def scratch_dir(spark: SparkSession) -> str:
    """A folder of this application under spark.checkpoint.dir, or a local one where that is unset (tests)."""
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not top:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            top = "file://" + tempfile.mkdtemp(prefix="lumendex-scratch-")
        _scratch[app] = f"{top.rstrip('/')}/lumendex-{app}"
        atexit.register(_drop, spark, _scratch[app])
    return _scratch[app]


def _drop(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - the session may be gone already
        pass


def saved(df: DataFrame, name: str, by: tuple[str, ...] = (), compression: str | None = None) -> DataFrame:
    """Write `df` once as a Parquet table in the shared scratch folder and read it back.

    It cuts the lineage and survives lost executors, as the table lies outside them.
    With `by`, rows lie in a folder for each value of those columns (which come last).
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    if by:
        df = df.select(*[c for c in df.columns if c not in by], *by)
        df.write.partitionBy(*by).parquet(path, compression=compression)
    else:
        df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def widened(df: DataFrame, ddl: str) -> StructType:
    """The schema of `df` followed by the columns of `ddl`, for Python stages."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def unused(columns: list[str], *names: str) -> list[str]:
    """Each name, made longer until no column (whatever its case) is called so: for columns that an operator adds for itself."""
    taken, found = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def broadcast_if_small(df: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """`df` marked for broadcasting if it is counted to have few rows; otherwise as it is, for a shuffle join."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def spread(files: DataFrame, files_each: int = 500, bytes_each: int = 1 << 28) -> DataFrame:
    """A table of files dealt to as many tasks as the files need, by their number and, where it has one, its column `size`.

    Adaptive plans merge partitions by the bytes of rows, so work on the files behind
    short rows would end in a few tasks; a number given to repartition stays.
    """
    size = F.sum("size") if "size" in files.columns else F.lit(0)
    n, total = files.agg(F.count(F.lit(1)), F.coalesce(size, F.lit(0))).first()
    return files.repartition(max(1, total // bytes_each, n // files_each, min(n, files.sparkSession.sparkContext.defaultParallelism)))


def dense_ids(df: DataFrame, order: list[str], name: str, start: int = 1) -> DataFrame:
    """`df` with ids from `start` without gaps, in the order of `order`.

    Rows are dealt to ranges and written; the ranges' row counts, one number per
    range, give each its first id, so that no task sees more than its range.
    """
    ranges = saved(df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = sorted(tuple(r) for r in ranges.groupBy("_range").count().collect())
    first, offsets = start, {}
    for part, n in counts:
        offsets[part] = first
        first += n
    if not offsets:
        return ranges.drop("_range").withColumn(name, F.lit(None).cast("long"))
    base = F.map_from_arrays(F.array(*[F.lit(p) for p in offsets]), F.array(*[F.lit(n).cast("long") for n in offsets.values()]))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranges.withColumn(name, F.element_at(base, F.col("_range")) + place).drop("_range")


def release() -> None:
    """Give memory that a Python worker has freed back to the system: workers outlive their tasks, and share an executor."""
    with contextlib.suppress(Exception):
        import pyarrow

        pyarrow.default_memory_pool().release_unused()
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def forget() -> None:
    """Empty what modules keep for a task's time.  Tasks call it by name, as a worker has its own tables."""
    for kept in caches:
        kept.clear()


def lean(run):
    """`run`, a function from batches to batches, that releases memory every now and then.

    At its end nothing of the task is left, neither its last batch nor what is in
    `caches`: an executor keeps more workers than it has cores, and idle ones count too.
    """

    def work(batches):
        made, out = run(batches), None
        try:
            for n, out in enumerate(made):
                yield out
                if n % 16 == 15:
                    release()
        finally:
            out = batches = None
            if hasattr(made, "close"):
                made.close()
            made = None
            forget()
            release()

    return work
