"""Durable intermediate tables and size-checked broadcasts.

Iterative operators cut their lineage by writing a Parquet table into the shared folder that
the cluster names in ``spark.checkpoint.dir``; every executor can read it again, so the loss of
an executor costs nothing. A local folder is used only where the setting is absent and the master is
local (tests); on a cluster without the setting nothing is written, and an error says so.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes up to which a side may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64_000_000

_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """Folder of this application's durable tables; removed when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="tidegrid-")
        root = f"{base.rstrip('/')}/tidegrid-{app}"
        _roots[app] = root
        atexit.register(_quiet_drop, spark, root)
    return _roots[app]


def _quiet_drop(spark: SparkSession, path: str) -> None:
    try:
        drop(spark, path)
    except Exception:  # the session may already be gone
        pass


def drop(spark: SparkSession, path: str) -> None:
    """Delete a durable table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def write_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: (table, path)."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def durable(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder; its lineage starts there."""
    return write_table(df, name)[0]


def _width(df: DataFrame):
    """Bytes of a row, as an expression; fixed columns count 8."""
    own = F.lit(0).cast("bigint")
    for f in df.schema.fields:
        plain = f.dataType.typeName()
        size = F.octet_length(f.name) if plain in ("string", "binary") else F.octet_length(F.to_json(F.struct(f.name))) if plain in ("array", "map", "struct") else F.lit(8)
        own = own + F.coalesce(size, F.lit(0))
    return own


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` only after counting that it has at most ``max_rows`` rows and ``max_bytes`` bytes.

    Beyond the bounds the plain frame is returned, and Spark shuffles both sides.
    """
    some = df.limit(max_rows + 1)
    rows, size = some.agg(F.count("*"), F.coalesce(F.sum(_width(some)), F.lit(0))).first()
    return F.broadcast(df) if rows <= max_rows and size <= max_bytes else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of an input directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def all_rows(df: DataFrame, most: int) -> list:
    """The rows of a small table; more than ``most`` are an error, never cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows where a small table is needed")
    return rows
