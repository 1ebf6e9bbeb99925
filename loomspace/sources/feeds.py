"""A feed of changed files: every version of a file's content once, over restarts, as an append-only table of batches.

A poll lists a path, compares times and lengths with what is stored, and reads only files that may have changed; of those whose
content hash differs from the stored one, and of files that are gone, it writes a change. Spark lists and reads, so the path can be
in any store that it knows. A consumer keeps the number of the last batch that it took in the feed itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from ..streaming import jobs
from .batches import BatchStore

CHANGE = "file_path string, content_hash string, content string, modified timestamp, length long"
TAKEN = "consumer string, upto long"


class FileFeed(BatchStore):
    def _known(self) -> DataFrame:
        """The latest change of each file that is still there."""
        own = self._rows("changes", CHANGE).select("file_path", "batch", F.struct("content_hash", "modified", "length").alias("x"))
        own = own.groupBy("file_path").agg(F.max_by("x", "batch").alias("x")).select("file_path", "x.*")
        return own.filter("content_hash is not null")

    def poll(self, path: str, pattern: str = "*") -> int:
        """Write the changes of the files under ``path`` as the next batch; the number of changes, 0 without a batch."""
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
        listed = written(files.load(path).select(F.col("path").alias("file_path"), F.col("modificationTime").alias("modified"), "length"))
        known = written(self._known())
        old = known.select("file_path", F.col("modified").alias("seen"), F.col("length").alias("size"), "content_hash")
        both = listed.join(old, "file_path", "left")
        maybe = written(both.filter("seen is null or seen <> modified or size <> length"))
        gone = known.join(listed, "file_path", "left_anti")
        first = maybe.agg(F.min("modified")).first()[0]
        rows = gone.select("file_path", F.lit(None).cast("string").alias("content_hash"), F.lit(None).cast("string").alias("content"), "modified", "length")
        if first is not None:
            # the least time is pushed into the reader, so older files stay unread
            read = files.load(path).filter(F.col("modificationTime") >= F.lit(first)).select(F.col("path").alias("file_path"), "content", F.sha2("content", 256).alias("hash"))
            new = read.join(maybe, "file_path").filter(~F.col("hash").eqNullSafe(F.col("content_hash")))
            rows = written(rows).unionByName(written(new.select("file_path", F.col("hash").alias("content_hash"), F.decode("content", "UTF-8").alias("content"), "modified", "length")))
        rows = written(rows)
        n = rows.count()
        if n:
            batch = max(self.committed(), default=-1) + 1
            self._write(rows, "changes", batch)
            self._commit(batch)
        return n

    def changes(self, after: int = -1) -> DataFrame:
        """(batch, file_path, content_hash, content, modified, length) of later batches; a null hash means that the file is gone."""
        return self._rows("changes", CHANGE).filter(F.col("batch") > after)

    def taken(self, consumer: str) -> int:
        """The last batch that a consumer took, -1 at first."""
        return self._read(f"taken-{consumer}", TAKEN).agg(F.coalesce(F.max("upto"), F.lit(-1))).first()[0]

    def take(self, consumer: str, work: Callable[[DataFrame, int], None]) -> list[int]:
        """Give each later batch to ``work`` once it is due, in order. A batch whose work fails, or whose end isn't noted, comes again with
        the same rows and number, so work that is idempotent by number sees each once."""
        done = []
        for batch in [b for b in self.committed() if b > self.taken(consumer)]:
            work(self.changes().filter(F.col("batch") == batch), batch)
            note = self.spark.createDataFrame([(consumer, batch)], TAKEN).coalesce(1)
            self._write(note, f"taken-{consumer}", batch)
            done.append(batch)
        return done


def feed_job(feed: FileFeed, path: str, pattern: str, checkpoint: str, every: str = "10 seconds"):
    """Poll ``path`` at every tick of a rate source; the feed's commits, not the ticks, say what has been read."""
    ticks = feed.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return jobs.each_batch(ticks, lambda _, __: feed.poll(path, pattern), checkpoint, every)
