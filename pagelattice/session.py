"""Session settings, durable tables between stages and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

#: Largest serialised size, in bytes, of a join side that is broadcast. Larger sides are shuffled.
BROADCAST_LIMIT = 48 << 20


def get_spark(app: str = "pagelattice", **conf: str) -> SparkSession:
    """A session with the settings that the operators assume; local unless a master is configured."""
    builder = SparkSession.builder.appName(app)
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **conf,
    }.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="pagelattice-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def durable(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Cuts the lineage: writes the rows to the shared folder and reads them back.

    A lost executor loses nothing of it, and the reader gets true sizes. `codec` packs tables that hold texts.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pl-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    back = spark.read.schema(df.schema).parquet(path)
    back.durable_path = path
    return back


def discard(*tables: DataFrame) -> None:
    """Deletes the files of durable tables that nothing reads any more, such as those of past rounds of an iteration."""
    for df in tables:
        path = getattr(df, "durable_path", None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def row_bytes(schema: StructType) -> Column:
    """The bytes of a row in memory: eight per plain field, and what strings and arrays hold besides."""

    def of(column: Column, kind: DataType) -> Column:
        if isinstance(kind, (StringType, BinaryType)):
            return F.coalesce(F.octet_length(column), F.lit(0)) + 16
        if isinstance(kind, ArrayType):
            each = 8 * (len(kind.elementType) if isinstance(kind.elementType, StructType) else 1)
            if isinstance(kind.elementType, (StringType, BinaryType)) or any(
                isinstance(f.dataType, (StringType, BinaryType)) for f in getattr(kind.elementType, "fields", ())
            ):
                return F.coalesce(F.octet_length(F.to_json(column)), F.lit(0)) + 16
            return F.coalesce(F.size(column), F.lit(0)) * each + 24
        if isinstance(kind, (StructType, MapType)):
            return F.coalesce(F.octet_length(F.to_json(column)), F.lit(0)) + 16
        return F.lit(8)

    total = F.lit(8)
    for field in schema.fields:
        total = total + of(F.col(f"`{field.name}`"), field.dataType)
    return total.cast("bigint")


def small_side(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Marks a join side for broadcast if its rows, measured here, fit the limit; else leaves the join to shuffle.

    `df` should be durable, since it is read for the measure. A hash table takes
    about twice its rows' bytes.
    """
    size = df.agg(F.coalesce(F.sum(row_bytes(df.schema)), F.lit(0))).first()[0]
    return F.broadcast(df) if 2 * size <= limit else df
