"""Temporary datasets: a folder of its own that goes when it is closed, unless it is kept."""

from __future__ import annotations

import os
import tempfile
import uuid
import warnings
import weakref

from pyspark.sql import DataFrame, SparkSession

from readloom.errors import DestinationExists, InvalidOption


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _remove(spark: SparkSession, path: str) -> None:
    fs, place = _files(spark, path)
    fs.delete(place, True)


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        _remove(spark, path)
    except Exception as e:  # noqa: BLE001
        warnings.warn(f"{path} was not removed: {e}", ResourceWarning, stacklevel=2)


class TempDataset:
    """A scratch folder on any file system of Spark's.

    Without a parent it lies in the shared folder of spark.checkpoint.dir, or where that is unset, on one machine only, in its
    temporary folder. A missing folder is fine to clean up, cleaning up twice as well, and after ``persist`` it does nothing. What
    is not cleaned up goes with the JVM.
    """

    def __init__(self, spark: SparkSession, parent: str | None = None):
        parent = parent or spark.conf.get("spark.checkpoint.dir", None)
        if parent is None:
            if not spark.sparkContext.master.startswith("local"):
                raise InvalidOption("spark.checkpoint.dir names no folder that all executors share")
            parent = tempfile.gettempdir()
        self._spark, self.path, self._kept = spark, os.path.join(parent, f"readloom-{uuid.uuid4().hex}"), False
        fs, place = _files(spark, self.path)
        fs.deleteOnExit(place)
        self._final = weakref.finalize(self, _remove_quietly, spark, self.path)

    def write(self, frame: DataFrame) -> None:
        """Replace what is there."""
        frame.write.mode("overwrite").parquet(self.path)

    def read(self) -> DataFrame:
        return self._spark.read.parquet(self.path)

    def cleanup(self) -> None:
        if not self._kept:
            self._final.detach()
            _remove(self._spark, self.path)

    def persist(self, path: str) -> str:
        """Move the dataset to a path where nothing is yet, and keep it."""
        fs, target = _files(self._spark, path)
        if fs.exists(target):
            raise DestinationExists(path)
        if not fs.rename(_files(self._spark, self.path)[1], target):
            raise OSError(f"{self.path} could not be moved to {path}")
        self._kept = True
        self._final.detach()
        return path

    def __enter__(self) -> TempDataset:
        return self

    def __exit__(self, *_: object) -> None:
        if not self._kept:
            self._final.detach()
            _remove_quietly(self._spark, self.path)
