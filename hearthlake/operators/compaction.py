"""Many small page files packed by size into few large ones; the small ones go after the commit."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hearthlake.operators.versions import SnapshotLog
from hearthlake.session import written
from hearthlake.sources.files import page_files

#: Bytes of small files that one packed file takes.
TARGET = 128 << 20
#: Files that are packed at once; the driver holds the list of these, or of one folder's if that has more.
ROUND = 20_000
#: Names of folders whose files are packed and about to be removed.
REMOVING = ".packed-"


@contextmanager
def many_a_task(spark: SparkSession) -> Iterator[None]:
    """Small files read hundreds a task: Spark counts 4 MB for opening one, so that a task would read 32 of them."""
    name = "spark.sql.files.openCostInBytes"
    given = spark.conf.get(name)
    spark.conf.set(name, "256k")
    try:
        yield
    finally:
        spark.conf.set(name, given)


def file_sizes(spark: SparkSession, folder: str | list[str]) -> DataFrame:
    """path, length of the files under a folder; their contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")


def binned(files: DataFrame, target: int = TARGET) -> DataFrame:
    """path, length, bin: files in order of their names, a new bin where the next file would pass the target; larger files have one of their own.

    The sort is by range, and bins are filled inside each part of it, so no task sees all files; a part
    ends with one bin that may stay small.
    """
    placed = written(files.orderBy("path").withColumn("part", F.spark_partition_id()), "file-sizes")
    before = F.coalesce(F.sum("length").over(W.partitionBy("part").orderBy("path").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    own = F.when(F.col("length") >= target, F.concat(F.lit("f"), F.xxhash64("path"))).otherwise(F.concat(F.lit("b"), F.floor(before / target)))
    return placed.select("path", "length", F.concat(F.col("part").cast("string"), F.lit("-"), own).alias("bin"))


class PageArchive:
    """Pages packed from a folder of small files, batch by batch; a batch is a table of a version log."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.log = spark, SnapshotLog(spark, path)

    def pages(self) -> DataFrame | None:
        """key, fetched_at, html of all batches; None before the first."""
        numbers = self.log.numbers()
        batches = [self.log.read(name) for name in self.log.entry()["tables"]] if numbers else []
        whole = batches[0] if batches else None
        for batch in batches[1:]:
            whole = whole.unionByName(batch)
        return whole

    def pack(self, folder: str, target: int = TARGET, most: int = ROUND) -> DataFrame | None:
        """Packs the files now under folder, commits them, then removes them, some folders at a time; a row of the report, None where there are none.

        files, bytes: what was there; packed: files written. What fails before a commit leaves the folders that it
        is of as they are; what fails after it leaves files that the next call packs again, so pages are read by
        their last fetch (pages_by_key).
        """
        root = self.at(folder.rstrip("/"))
        self.bring_back(root)
        found = [part for folders in self.rounds(root, most) if (part := self.pack_round(folders, root, target)) is not None]
        if not found:
            return None
        return self.spark.createDataFrame([tuple(map(sum, zip(*found, strict=True)))], "files long, bytes long, packed long")

    def at(self, path: str):
        return self.log.jvm.org.apache.hadoop.fs.Path(path)

    def folders(self, root) -> list:
        return [s.getPath() for s in root.getFileSystem(self.log.conf).listStatus(root) if s.isDirectory()]

    def rounds(self, root, most: int) -> Iterator[list]:
        """Folders with most files together or fewer, the largest alone, their contents with them; what lies in root itself comes last, when the others are gone."""
        files = root.getFileSystem(self.log.conf)
        held = files.getContentSummary(root)
        if held.getFileCount() > most and held.getDirectoryCount() > 1:
            waiting, n = [], 0
            for inner in self.folders(root):
                size = files.getContentSummary(inner).getFileCount()
                if waiting and n + size > most:
                    yield waiting
                    waiting, n = [], 0
                if size > most:
                    yield from self.rounds(inner, most)
                elif size:
                    waiting.append(inner)
                    n += size
            if waiting:
                yield waiting
        yield [root]

    def pack_round(self, folders: list, root, target: int) -> tuple[int, int, int] | None:
        paths = [str(f) for f in folders]
        with many_a_task(self.spark):
            sizes = written(file_sizes(self.spark, paths), "to-pack")
            if sizes.isEmpty():
                return None
            bins = written(binned(sizes, target), "bins")
            total = bins.agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.count_distinct("bin").alias("packed")).first()
            rows = page_files(self.spark, paths, with_path=True).join(bins.select("path", "bin"), "path")
            # One task a bin, whatever its bytes: a bin is as large as a packed file may be.
            packed = rows.repartition(max(1, total["packed"]), "bin").sortWithinPartitions("bin", "key").select("key", "fetched_at", "html")
            self.log.commit({f"batch-{len(self.log.numbers())}": packed}, "pack")
        self.remove(bins, [f for f in folders if not f.equals(root)], root)
        return total["files"], total["bytes"], total["packed"]

    def remove(self, bins: DataFrame, folders: list, root) -> None:
        """Removes packed files: a folder at a time where it holds nothing else, the others by name, of which the driver holds a part at a time."""
        own, held = {self.plain(f): f for f in folders}, {}
        if own:
            for r in bins.groupBy(F.regexp_extract("path", "^(.*)/", 1).alias("folder")).agg(F.count("*").alias("n"), F.sum("length").alias("bytes")).collect():
                name = r["folder"]
                while name and name not in own:
                    name = name.rpartition("/")[0]
                n, length = held.get(name, (0, 0))
                held[name] = (n + r["n"], length + r["bytes"])
            left = [name for name, f in own.items() if not self.removed_whole(f, root, *held.get(name, (0, 0)))]
            if not left:
                return
            bins = bins.where(F.exists(F.array(*map(F.lit, left)), lambda name: F.startswith("path", F.concat(name, F.lit("/")))))
        path, files = self.log.jvm.org.apache.hadoop.fs.Path, None
        for row in bins.select("path").toLocalIterator():
            name = path(row["path"])
            files = files or name.getFileSystem(self.log.conf)
            files.delete(name, False)

    def plain(self, folder) -> str:
        """The folder as the paths of its files begin."""
        return str(folder.getFileSystem(self.log.conf).makeQualified(folder))

    def removed_whole(self, folder, root, n: int, length: int) -> bool:
        """Whether the folder could be removed. It is taken aside first, so that no file can come into it, and comes back if it holds more than was packed."""
        files, aside = folder.getFileSystem(self.log.conf), self.at(f"{root}/{REMOVING}{uuid.uuid4().hex}-{folder.getName()}")
        if not files.rename(folder, aside):
            return False
        held = files.getContentSummary(aside)
        if (held.getFileCount(), held.getLength()) == (n, length):
            return files.delete(aside, True)
        self.back(files, aside, folder)
        return False

    def back(self, files, aside, folder) -> None:
        """A folder taken aside under its name again, or a name of its own if another one has come into its place."""
        if files.exists(folder) or not files.rename(aside, folder):
            files.rename(aside, self.at(f"{folder}-{uuid.uuid4().hex}"))

    def bring_back(self, root) -> None:
        """What a call that broke off had taken aside, so that this one packs it again."""
        files = root.getFileSystem(self.log.conf)
        for aside in [s.getPath() for s in files.globStatus(self.at(f"{root}/{REMOVING}*")) or []]:
            self.back(files, aside, self.at(f"{root}/{aside.getName().removeprefix(REMOVING).partition('-')[2]}"))

    def pages_by_key(self) -> DataFrame:
        """The page of every key that was fetched last."""
        return self.pages().groupBy("key").agg(F.max_by(F.struct("fetched_at", "html"), F.struct("fetched_at", "html")).alias("last")).select("key", "last.*")
