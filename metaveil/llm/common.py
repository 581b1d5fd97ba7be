"""Helpers shared by the text operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes an Arrow batch may hold: texts can be long, so a batch must stay small. One row may be larger.
BATCH_BYTES = 2 << 20
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"

#: What the contracts call white space, as a Java and Python character class.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of Arrow batches for this session, unless it has a bound of its own."""
    if spark.conf.get(BATCH_CONF) == "67108864b":  # as Spark has it
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares (spark.checkpoint.dir); a temporary one only where it is unset and all tasks run on this machine."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it back. Lost executors lose nothing of it.

    Once the table is written, the files of its shuffles go: nothing else can need them.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(CLEANUP_CONF)
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP_CONF, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete a table of materialise that nothing reads any more; at the latest, it goes when the driver ends."""
    for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
        hadoop = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file)
        hadoop.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(hadoop, True)


def with_columns(df: DataFrame, **casts: str) -> DataFrame:
    """The named columns, cast; a missing one is an error, others are left out, so that extra columns can't clash."""
    return df.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in casts.items()])


def unused(df: DataFrame, name: str) -> str:
    """A name like that which no column of df has, in small or capital letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: A table of keys up to this many rows and bytes is broadcast by lookup.
LOOKUP_ROWS, LOOKUP_BYTES = 50_000, 8 << 20
#: A key with more than this part of all rows is spread over several tasks.
HOT_PART = 10_000


def lookup(rows: DataFrame, keyed: DataFrame, key: str, spread: F.Column) -> DataFrame:
    """rows joined with keyed, which has a row for each key and in n how many rows have it (it should be a written table).

    Null keys meet each other. A keyed table within LOOKUP_ROWS and LOOKUP_BYTES is broadcast. Otherwise both are shuffled,
    and a key with more than a HOT_PARTth of the rows gets as many salts as it has such parts; fewer than HOT_PART keys can.
    spread: what the rows of one key are dealt to its salts by.
    """
    keyed = keyed.withColumnRenamed(key, "_k")
    size = keyed.agg(F.count("*"), F.sum(F.coalesce(F.octet_length(F.col("_k").cast("string")), F.lit(0)) + 64), F.sum("n")).first()
    if size[0] <= LOOKUP_ROWS and (size[1] or 0) <= LOOKUP_BYTES:
        return rows.join(F.broadcast(keyed.drop("n")), F.col(key).eqNullSafe(F.col("_k")), "left").drop("_k")
    part = max(1, size[2] // HOT_PART)
    salts = F.ceil(F.col("n") / part)
    hot = keyed.where(F.col("n") > part).select(F.col("_k").alias("_hot"), salts.alias("_salts"))
    dealt = rows.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("_hot")), "left")
    dealt = dealt.withColumn("_salt", F.pmod(F.xxhash64(spread), F.coalesce("_salts", F.lit(1)))).drop("_hot", "_salts")
    spread_keys = keyed.withColumn("_of", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1))).drop("n")
    return dealt.join(spread_keys, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_salt") == F.col("_of")), "left").drop("_k", "_salt", "_of")


TYPES = {
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "string": T.StringType(),
    "binary": T.BinaryType(),
}


def struct(**fields: str) -> T.StructType:
    """A schema from names and types ("bigint", "array<string>"); unlike a DDL string it needs no session on executors."""

    def kind(text: str) -> T.DataType:
        return T.ArrayType(kind(text[6:-1])) if text.startswith("array<") else TYPES[text]

    return T.StructType([T.StructField(name, kind(text)) for name, text in fields.items()])
