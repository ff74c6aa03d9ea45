"""State tables whose cost per batch does not grow with the number of batches.

Rows lie in buckets by the hash of their key, apart for every writer: ``writer=w/bucket=b/v=n``. A batch appends to the buckets of its keys and reads these
buckets only. A bucket that has gathered more than ``MOST_FILES`` files of a writer is folded by that writer into the folder of the next version;
the folder counts from the moment its success marker is there, which is when the write has committed, so a fold that dies changes nothing. The version before is kept for
readers that have begun, older ones are removed.

A writer is one stream of batches, one after the other. Rows are facts: appending some twice must not change what the fold makes of them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_FILES = 32


@dataclass(frozen=True)
class KeyedTable:
    spark: SparkSession
    path: str
    schema: str
    key: tuple[str, ...]
    fold: Callable[[DataFrame], DataFrame]
    buckets: int = 64
    most_files: int = MOST_FILES

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _files(self):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> dict[tuple[str, int], list[int]]:
        """Whole versions by writer and bucket, in order; the first version has no marker. A few per bucket."""
        found: dict[tuple[str, int], list[int]] = {}
        for status in self._files().globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/writer=*/bucket=*/v=*")) or []:
            where = status.getPath()
            version = int(where.getName().removeprefix("v="))
            marker = self.spark._jvm.org.apache.hadoop.fs.Path(where, "_SUCCESS")
            if version and not self._files().exists(marker):
                continue
            bucket = where.getParent()
            key = bucket.getParent().getName().removeprefix("writer="), int(bucket.getName().removeprefix("bucket="))
            found.setdefault(key, []).append(version)
        return {k: sorted(v) for k, v in found.items()}

    def _current(self, versions: dict, buckets: list[int] | None, writer: str | None = None) -> DataFrame | None:
        """Rows of the newest versions, with where they lie."""
        wanted = [(w, b, v[-1]) for (w, b), v in sorted(versions.items()) if (buckets is None or b in buckets) and writer in (None, w)]
        if not wanted:
            return None
        paths = [f"{self.path}/writer={w}/bucket={b}/v={v}" for w, b, v in wanted]
        return self.spark.read.schema(f"{self.schema}, writer string, bucket int, v int").option("basePath", self.path).parquet(*paths)

    def read(self, touched: DataFrame | None = None) -> DataFrame:
        """All rows, or those of the buckets that the keys of ``touched`` lie in: every row of such a key, and some of other keys."""
        buckets = None if touched is None else [r.b for r in touched.select(self._bucket().alias("b")).distinct().collect()]  # ``self.buckets`` at most
        found = self._current(self.versions(), buckets)
        return self.spark.createDataFrame([], self.schema) if found is None else found.drop("writer", "bucket", "v")

    def append(self, rows: DataFrame, writer: str) -> None:
        """Add rows of one writer, then fold its buckets that have become many files."""
        versions = self.versions()
        newest = {b: v[-1] for (w, b), v in versions.items() if w == writer and v[-1]}
        version = F.lit(0)
        if newest:
            pairs = [F.lit(x) for pair in sorted(newest.items()) for x in pair]
            version = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("bucket")), F.lit(0))
        placed = rows.withColumn("writer", F.lit(writer)).withColumn("bucket", self._bucket()).withColumn("v", version)
        # A bucket is a file of one task; the number is given, or a small append would be coalesced to one task that writes all files in turn.
        tasks = min(self.buckets, self.spark.sparkContext.defaultParallelism)
        placed.repartition(tasks, "bucket").write.mode("append").partitionBy("writer", "bucket", "v").parquet(self.path)
        for bucket in self._crowded(writer):
            self._fold_bucket(writer, bucket)

    def _crowded(self, writer: str) -> list[int]:
        newest = {b: v[-1] for (w, b), v in self.versions().items() if w == writer}
        counts: dict[int, int] = {}
        listed = self._files().globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/writer={writer}/bucket=*/v=*/*.parquet"))
        for status in listed or []:  # most_files + 1 per bucket, about, and those of the version before
            version = status.getPath().getParent()
            bucket = int(version.getParent().getName().removeprefix("bucket="))
            if version.getName() == f"v={newest.get(bucket)}":
                counts[bucket] = counts.get(bucket, 0) + 1
        return sorted(b for b, n in counts.items() if n > self.most_files)

    def _fold_bucket(self, writer: str, bucket: int) -> None:
        versions = self.versions()[writer, bucket]
        rows = self._current({(writer, bucket): versions}, None).drop("writer", "bucket", "v")
        target = f"{self.path}/writer={writer}/bucket={bucket}/v={versions[-1] + 1}"
        self.fold(rows).write.mode("overwrite").parquet(target)
        for old in versions[:-1]:
            self._files().delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/writer={writer}/bucket={bucket}/v={old}"), True)

    def rewrite(self, change: Callable[[DataFrame], DataFrame], touched: DataFrame) -> None:
        """Replace the buckets that the keys of ``touched`` lie in by what ``change`` makes of their rows. No batch may run meanwhile."""
        buckets = [r.b for r in touched.select(self._bucket().alias("b")).distinct().collect()]  # ``self.buckets`` at most
        current = {k: v[-1] for k, v in self.versions().items() if k[1] in buckets}
        if not current:
            return
        rows = self._current({k: [v] for k, v in current.items()}, None)
        changed = change(rows).withColumn("v", F.col("v") + 1)
        changed.repartition("writer", "bucket").write.mode("append").partitionBy("writer", "bucket", "v").parquet(self.path)
        for (writer, bucket), version in current.items():  # the markers make the new versions count
            folder = f"{self.path}/writer={writer}/bucket={bucket}/v={version + 1}"
            self._files().create(self.spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")).close()
