"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

ASCII_UPPER = string.ascii_uppercase
ASCII_LOWER = string.ascii_lowercase


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, through Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else.

    ``lower`` is the fast path when every character takes one byte, since it
    then changes the same letters as the translation does.
    """
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, ASCII_UPPER, ASCII_LOWER)
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; where it is unset, a folder of its own on a local master (tests), else an error."""
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or with underscores added until no column of ``df`` has it (case does not count)."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def row_key(id_col: str, text_col: str) -> tuple[Column, Column]:
    """(id, hash of the text): what tells rows apart where ids repeat; a null text counts as empty."""
    return F.col(id_col), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def without_rows(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of ``docs`` whose key is not in ``gone`` (k_id, k_text), with their columns; ids match null-safe.

    Only the narrow keys that go are joined; AQE broadcasts them when they are small.
    """
    k, x = fresh(docs, "k_id"), fresh(docs, "k_text")
    own_id, own_text = row_key(id_col, text_col)
    gone = gone.select(F.col("k_id").alias(f"{k}_gone"), F.col("k_text").alias(f"{x}_gone"))
    keyed = docs.withColumns({k: own_id, x: own_text})
    return keyed.join(gone, F.col(k).eqNullSafe(F.col(f"{k}_gone")) & (F.col(x) == F.col(f"{x}_gone")), "left_anti").drop(k, x)


def once(docs: DataFrame, repeated: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with a single row for each key of ``repeated`` (k_id, k_text, small or empty); other rows stay as they are."""
    if repeated.isEmpty():
        return docs
    k, x = fresh(docs, "k_id"), fresh(docs, "k_text")
    own_id, own_text = row_key(id_col, text_col)
    other = repeated.select(F.col("k_id").alias(f"{k}_twice"), F.col("k_text").alias(f"{x}_twice"))
    keyed = docs.withColumns({k: own_id, x: own_text})
    same = F.col(k).eqNullSafe(F.col(f"{k}_twice")) & (F.col(x) == F.col(f"{x}_twice"))
    single = keyed.join(other, same, "left_semi").dropDuplicates([k, x])
    return keyed.join(other, same, "left_anti").unionByName(single).drop(k, x)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row.

    A column expression that a lambda uses is computed for each element; as the
    variable of an outer lambda it is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below the cluster's shared ``spark.checkpoint.dir``."""
    ensure_checkpoint_dir(spark)
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{root}/{name}-{uuid.uuid4().hex}"
