"""Session defaults and the one way this library cuts lineage."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_DIR_CONF = "spark.checkpoint.dir"
_BROADCAST = "spark.sql.autoBroadcastJoinThreshold"
_BY_ROWS = "spark.sql.cbo.planStats.enabled"
_ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes in memory for a byte of a file whose rows aren't counted.
FILE_FACTOR = "8"
#: What a task reads of a shuffle, packed: cells take some twenty times as much in the tables that a task builds of them.
TASK_BYTES = "16m"
#: Most that a join may broadcast. A query makes dozens of broadcasts, the driver holds several times their size, and until it collects garbage it holds them all.
BROADCAST_BYTES = 2 * 1024**2


def local_session(cores: str = "8", app: str = "scanfleet") -> SparkSession:
    """A session for tests and the local bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cores if cores != "*" else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def prepare(spark: SparkSession) -> None:
    """Settings results depend on. A union that reports its children's partitioning can be zipped with a join side that
    AQE has re-split, which fails at run time, so unions stay plain."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def _bytes(size: str) -> int:
    """The number that a size such as 10m or 10485760b stands for."""
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([kmgtp]?)i?b?\s*", size.lower()).groups()
    return int(number) * 1024 ** " kmgtp".index(unit or " ")


def plan_by_rows(spark: SparkSession) -> None:
    """Joins choose their strategy by what a table takes in memory. Cells and ids take up to eighty times as much there as in a file, so a file under the
    broadcast limit could fill the driver. From now on intermediate tables are planned by their rows, and other files by a multiple of their size. Tasks read a quarter of what Spark deals them otherwise.
    Only what takes ``BROADCAST_BYTES`` or less is broadcast, so the driver's memory doesn't follow the tables; a lower limit of the session's own stays.
    What a query shuffled is deleted when it ends, not when the driver next collects garbage: every step that others read is written."""
    prepare(spark)
    if _bytes(spark.conf.get(_BROADCAST)) > BROADCAST_BYTES:
        spark.conf.set(_BROADCAST, str(BROADCAST_BYTES))
    spark.conf.set(_BY_ROWS, "true")
    spark.conf.set("spark.sql.sources.fileCompressionFactor", FILE_FACTOR)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", TASK_BYTES)
    spark.conf.set(_CLEAN, "true")
    spark.conf.set(_ALL_KEYS, "true")


def keep_scans_together(spark: SparkSession) -> None:
    """Rows that lie together by scan stay where they are when they are joined on a scan's planes, cells or cameras: the points of a scan are shuffled once, not once a join.
    For tables none of whose scans is too large for a task (``stats.GROUP_LIMIT``); otherwise each join deals rows by all of its keys. Holds until :func:`plan_by_rows`."""
    spark.conf.set(_ALL_KEYS, "false")


def by_scan(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` dealt out by scan where scans stay together, so that windows, counts and joins within a scan that follow shuffle nothing more; elsewhere as they are."""
    return rows.repartition(*keys) if rows.sparkSession.conf.get(_ALL_KEYS) == "false" else rows


def drop_stages(*tables: DataFrame) -> None:
    """Delete tables that :func:`cut_lineage` returned and that nothing reads any more."""
    _delete([_paths[t] for t in tables])


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables, which all executors must see. One machine may do with a temporary folder; a cluster may
    not, as each executor would write to its own disk."""
    path = spark.conf.get(_DIR_CONF, None)
    if not path:
        if not _one_machine(spark):
            raise ValueError(f"set {_DIR_CONF} to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-scanfleet-")
        spark.conf.set(_DIR_CONF, path)
    return path.rstrip("/")


def _one_machine(spark: SparkSession) -> bool:
    master = spark.conf.get("spark.master", "")
    return master == "local" or master.startswith("local[")


_stages: dict[str, SparkSession] = {}
_tables: dict[str, SparkSession] = {}
#: Where the tables are that :func:`cut_lineage` has returned.
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def clear_stages() -> None:
    """Delete the intermediate tables written so far. Results that still read them must have been written or collected. Runs at exit too."""
    _delete(list(_stages))


def _delete(paths: list[str]) -> None:
    for path in paths:
        name = path.rsplit("/", 1)[-1]
        if name in _tables:
            try:
                _tables.pop(name).sql(f"DROP TABLE IF EXISTS {name}")
            except Exception:  # noqa: BLE001 - the session may be gone, and its catalog with it
                _tables.clear()
    for path in paths:
        spark = _stages.pop(path, None)
        if spark is None:
            continue
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001 - the session may be gone; what is left then goes with its folder
            return


def settled(make: Callable[[], DataFrame], *done: DataFrame) -> DataFrame:
    """What ``make`` returns, written, after which every table that was written on the way to it is deleted, and so are the tables ``done``. Nothing else may read
    these; a step with several results, or one that reads a table later on, is no case for this."""
    before = set(_stages)
    out = cut_lineage(make())
    _delete([p for p in _stages if p not in before and p != _paths[out]] + [_paths[d] for d in done])
    return out


atexit.register(clear_stages)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    A written table survives the loss of executors, is computed once, and gives later joins real
    sizes to choose a strategy from. Iterative operators call this once per round. After :func:`plan_by_rows` the size of a
    table of plain columns is told from its rows; one with arrays has rows of any length, so there the files must do.
    """
    spark = df.sparkSession
    prepare(spark)
    name = f"stage_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    plain = spark.conf.get(_BY_ROWS) == "true" and not any(isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) for f in df.schema)
    if plain:
        df.write.format("parquet").mode("errorifexists").option("path", path).saveAsTable(name)
        _tables[name] = spark
    else:
        df.write.mode("errorifexists").parquet(path)
    _stages[path] = spark
    if plain:
        spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS")
    out = spark.table(name) if plain else spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out
