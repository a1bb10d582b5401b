"""Session settings and shared scratch space."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from itertools import zip_longest

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


_LOCAL_ROOTS: dict[str, str] = {}


def build_session(app: str = "tablecloak", master: str | None = None,
                  **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    UTC makes date text equal on every machine; AQE sizes shuffle partitions and splits
    skewed join partitions at run time.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, from `spark.checkpoint.dir`.

    A session without that setting is accepted only in local mode, where the driver and
    the executors are one process and a temporary folder is shared by definition.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="tablecloak-")
    return _LOCAL_ROOTS[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_root(spark)}/tablecloak/{name}-{uuid.uuid4().hex}"


def local_rows(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A few driver-side rows (names, declarations) as a local relation, which Catalyst can
    fold and broadcast; no Python task reads it."""
    types = T.StructType.fromDDL(schema)
    columns = list(zip(*rows)) if rows else [() for _ in types.fields]
    data = pa.table([pa.array(list(c), to_arrow_type(f.dataType)) for c, f in zip(columns, types.fields)],
                    names=types.names)
    return spark.createDataFrame(data, types)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of any executor."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    return df.checkpoint(eager=True)


def secret_column(spark: SparkSession, secret: str) -> Column:
    """A secret as the value of a subquery over one local row. Plans name the row's column and never
    its value, so `explain()` and the event log do not tell it."""
    return local_rows(spark, [(secret,)], "secret string").scalar()


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """All parts by column name, joined in pairs: the plan of many tables stays shallow."""
    while len(parts) > 1:
        parts = [a.unionByName(b) if b is not None else a
                 for a, b in zip_longest(parts[::2], parts[1::2])]
    return parts[0]
