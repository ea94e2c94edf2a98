"""Intermediate tables in the folder that all executors see."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from basketlens.adapters import shared_folder


#: With it Spark deletes the shuffle files of a statement as soon as the statement has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """The frame written as Parquet to a new shared folder and read again.

    It cuts the lineage: a lost executor costs no more than the files it was reading. No later step needs what was
    shuffled for it, which is let go at once, not when the driver happens to collect the plan.
    """
    spark = df.sparkSession
    folder, before = shared_folder(spark), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(folder)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(folder)


def settled(df: DataFrame) -> DataFrame:
    """``stored``, between the steps of an operator of many steps."""
    return stored(df)


def dropped(*frames: DataFrame) -> None:
    """Deletes the files of ``stored`` frames, once every step that reads them has been stored itself."""
    for frame in frames:
        jvm, conf = frame.sparkSession.sparkContext._jvm, frame.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for folder in {file.rsplit("/", 1)[0] for file in frame.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
            path.getFileSystem(conf).delete(path, True)


def tasks(spark: SparkSession) -> int:
    """Partitions for work that adaptive execution must not shrink."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def given(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, lengthened until no column of the frames has it (Spark's names ignore case)."""
    taken = {c.lower() for frame in frames for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name
