"""Keyed cells that are put, put again, got and scanned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What names a cell.
KEY = ["row_key", "family", "qualifier"]
SCHEMA = "row_key string, family string, qualifier string, value string, put long, at long"


class CellTable:
    """Cells (row_key, family, qualifier, value) in a folder, of which the one put last counts.

    A put adds files that hold ranges of keys, sorted by their bytes, and rewrites none: it costs what it puts. Rows of
    one put are of one time: where one names a cell more than once, the row later in its order of `at` counts. Scans
    of a range of keys read only the files, and the row groups of them, whose least and greatest keys allow it, and
    take of each cell the last value. `compact` writes the cells that count as one put and drops the others."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def exists(self) -> bool:
        files, path = self._files()
        return files.exists(path)

    def create(self, again: bool = False) -> CellTable:
        """Makes the table, if it isn't there; with `again`, an empty one in place of the one that is."""
        files, path = self._files()
        if again:
            files.delete(path, True)
        files.mkdirs(path)
        return self

    def _puts(self) -> list[int]:
        """The numbers of the puts that are complete."""
        files, path = self._files()
        if not files.exists(path):
            raise ValueError(f"no table at {self.path}")
        done = lambda p: files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
        return sorted(int(s.getPath().getName()[4:]) for s in files.listStatus(path) if s.getPath().getName().startswith("put=") and done(s.getPath()))

    def put(self, cells: DataFrame, at: str | None = None) -> int:
        """Adds cells; returns the number of the put. `at` is a column of whole numbers by which the later of two rows
        for one cell is told; without it, the one with the greater value counts, and a deletion before any. Of two puts at the same time one
        fails. Cells with a null key, family or
        qualifier are an error; a null value deletes the cell."""
        rows = cells.select(*[F.col(c).cast("string").alias(c) for c in (*KEY, "value")], (F.col(at) if at else F.lit(0)).cast("long").alias("at"))
        if rows.where(" OR ".join(f"{c} IS NULL" for c in KEY)).limit(1).count():
            raise ValueError("a cell needs a row key, a family and a qualifier")
        number = max(self._puts(), default=0) + 1
        last = F.max(F.struct("at", F.col("value").isNull().alias("gone"), "value")).alias("m")
        one = rows.groupBy(*KEY).agg(last).select(*KEY, "m.value", "m.at")
        one.repartitionByRange(*KEY).sortWithinPartitions(*KEY).write.mode("errorifexists").parquet(f"{self.path}/put={number}")
        return number

    def _read(self) -> DataFrame:
        puts = self._puts()
        if not puts:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.option("basePath", self.path).schema(SCHEMA).parquet(*[f"{self.path}/put={n}" for n in puts])

    def scan(self, start: str | None = None, stop: str | None = None, family: str | None = None, qualifier: str | None = None) -> DataFrame:
        """(row_key, family, qualifier, value) of the cells with start <= row_key < stop by their bytes, of one family
        or qualifier if asked for. All that is asked for reaches the scan of the files. Rows come in no order, as
        elsewhere; order by row_key, family and qualifier for that of their bytes."""
        rows = self._read()
        for c, test in (("row_key", start is not None and F.col("row_key") >= F.lit(start)), ("row_key", stop is not None and F.col("row_key") < F.lit(stop)), ("family", family is not None and F.col("family") == F.lit(family)), ("qualifier", qualifier is not None and F.col("qualifier") == F.lit(qualifier))):
            if test is not False:
                rows = rows.where(test)
        last = rows.groupBy(*KEY).agg(F.max(F.struct("put", "value")).alias("m"))
        return last.select(*KEY, "m.value").where("value IS NOT NULL")

    def get(self, row_key: str, family: str | None = None, qualifier: str | None = None) -> DataFrame:
        """The cells of one row."""
        return self.scan(row_key, row_key + "\x00", family, qualifier)

    def compact(self) -> None:
        """Writes the cells that count as one put, which then stands for all before it."""
        before = self._puts()
        if len(before) > 1:
            rows = self.scan()
            self.put(rows)
            files, _ = self._files()
            for n in before:
                files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/put={n}"), True)
