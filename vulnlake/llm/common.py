"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnlake.session import shared_path

#: A word: a run of anything but the ASCII white space 0x20, 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"
#: The same white space for translate(), which is faster than a regex class.
ASCII_SPACES = "\t\n\x0b\x0c\r"


def staged(spark: SparkSession, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps reuse
    the rows instead of recomputing them, and a lost executor costs nothing."""
    path = shared_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, table: DataFrame) -> None:
    """Delete the files of a staged table that no later step reads: what came
    of it is itself staged."""
    files = table.inputFiles()
    if files:
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def free_names(df: DataFrame, *names: str) -> tuple[str, ...]:
    """The names, each lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return tuple(out)


def row_key() -> Column:
    """A per-row number that stays fixed once its frame is staged."""
    return F.monotonically_increasing_id()


def word_count(text: Column) -> Column:
    """Number of words of ``text``; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(seed: int, *cols: Column) -> Column:
    """A seeded pseudo-random number in [0, 1) that depends on the row's values only."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11) / F.lit(float(1 << 53))


#: Documents handed to a Python worker at once; texts can be long.
BATCH_ROWS = 500
BATCH_BYTES = 4 << 20
#: Entries of a worker's table of words seen: workers live through all steps,
#: and what they once took is not given back.
REMEMBERED = 60_000


def in_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches of text short.  A smaller setting of the session is left alone."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def tokenizer_file(name: str) -> str:
    """Place of a vocabulary file: in the folder $VULNLAKE_TOKENIZERS, or else
    in the installed package of public vocabularies.  Read on the driver only."""
    folder = os.environ.get("VULNLAKE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers
    return public_tokenizers.path(name)


def word_pattern() -> str:
    """The pattern that cuts a text before the merges of the rank files."""
    import public_tokenizers
    return public_tokenizers.PATTERN
