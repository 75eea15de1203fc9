"""Tables in Parquet folders, replaced by writing beside and switching over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class TableStore:
    """Named tables below one folder.

    A table is a folder of versions; the newest one with a success mark counts, so a write
    that is interrupted leaves the last version in force, and a table may be computed from
    its own last version. Older versions are backups until `prune`.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _p(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    def versions(self, name: str) -> list[int]:
        base = self._p(f"{self.path}/{name}")
        if not self._fs.exists(base):
            return []
        found = [s.getPath() for s in self._fs.listStatus(base)]
        return sorted(int(p.getName()[1:]) for p in found if p.getName()[:1] == "v" and self._fs.exists(self._p(f"{p}/_SUCCESS")))

    def read(self, name: str, empty: str | None = None, version: int | None = None) -> DataFrame:
        """The table, or an empty one of the schema `empty` where there is none yet."""
        have = self.versions(name)
        if not have:
            if empty is None:
                raise FileNotFoundError(f"no table {name} in {self.path}")
            return self.spark.createDataFrame([], empty)
        return self.spark.read.parquet(f"{self.path}/{name}/v{have[-1] if version is None else version}")

    def write(self, name: str, df: DataFrame) -> int:
        n = (self.versions(name) or [0])[-1] + 1
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/v{n}")
        return n

    def append_json(self, name: str, df: DataFrame) -> None:
        """Append rows to a trace."""
        df.write.mode("append").json(f"{self.path}/{name}")

    def write_text(self, name: str, text: str) -> str:
        """A report as a file beside the tables."""
        path = f"{self.path}/{name}"
        out = self._fs.create(self._p(path), True)
        out.write(bytearray(text.encode()))
        out.close()
        return path

    def prune(self, name: str, keep: int = 2) -> None:
        for v in self.versions(name)[:-keep]:
            self._fs.delete(self._p(f"{self.path}/{name}/v{v}"), True)
