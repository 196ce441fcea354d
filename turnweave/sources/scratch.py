"""Intermediate tables in the folder that all machines share: they cut a plan's lineage and survive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_folder(spark: SparkSession) -> str:
    """A fresh path below spark.checkpoint.dir; where that is unset and all runs in one process, a temporary folder."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.gettempdir()
    return f"{root.rstrip('/')}/turnweave-{uuid.uuid4().hex}"


class Scratch:
    """Tables written for one run, deleted together."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folders = spark, []

    def settle(self, df: DataFrame) -> DataFrame:
        """df, computed once and read back."""
        folder = scratch_folder(self.spark)
        self.folders.append(folder)
        df.write.parquet(folder)
        return self.spark.read.schema(df.schema).parquet(folder)

    def close(self) -> None:
        for folder in self.folders:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.folders = []
