"""A stored inverted index: postings clustered by term, with documents added, changed and deleted by batches.

Postings (term, memory_id, w) are partitioned by a hash of the term and sorted by it, so a search reads the partitions of its terms. A
batch never looks for a document's old postings: the table of documents holds each one's latest batch, and a posting counts if it
is of that batch. ``compact`` writes the rows that count as one batch of a new store.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import sparse
from ..session import written
from .batches import BatchStore, buckets

BUCKETS = 64
POSTINGS = "term string, memory_id long, w double, bucket int"
DOCUMENTS = "memory_id long, live boolean"
#: formulas that need no more than the postings of the query's terms
FORMULAS = ("bm25", "tfidf", "overlap")


def bucket(term) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


class PostingStore(BatchStore):
    def upsert(self, docs: DataFrame, batch: int) -> bool:
        """Take documents (memory_id, content; null content: delete); False if the batch is already in. Of repeated ids one counts, a
        deletion first, then the least text."""
        if batch in self.committed():
            return False
        own = docs.filter("memory_id is not null").select(F.col("memory_id").cast("long").alias("memory_id"), F.col("content").isNotNull().alias("live"), "content")
        # read twice, so that no copy of the texts is written; their words are counted where their shuffle has brought them
        least = own.groupBy("memory_id").agg(F.min(F.struct("live", "content")).alias("x")).filter("x.live").select("memory_id", "x.content")
        post = sparse.postings(least).withColumn("bucket", bucket("term"))
        self._write(post.select("term", "memory_id", "w", "bucket").repartition("bucket").sortWithinPartitions("bucket", "term"), "postings", batch, "bucket")
        self._write(own.groupBy("memory_id").agg(F.min("live").alias("live")), "documents", batch)
        self._commit(batch)
        return True

    def documents(self) -> DataFrame:
        """(memory_id, batch) of the documents that are there."""
        own = self._rows("documents", DOCUMENTS).groupBy("memory_id").agg(F.max("batch").alias("batch"), F.max_by("live", "batch").alias("live"))
        return own.filter("live").select("memory_id", "batch")

    def postings(self, terms: DataFrame | None = None) -> DataFrame:
        """(memory_id, term, w) of all terms, or of some (term): their partitions alone are read."""
        own = self._rows("postings", POSTINGS)
        if terms is not None:
            wanted = terms.select("term", bucket("term").alias("bucket")).distinct()
            own = own.filter(F.col("bucket").isin(buckets(wanted))).join(wanted, ["bucket", "term"])
        return own.join(self.documents(), ["memory_id", "batch"]).select("memory_id", "term", "w")

    def recall(self, queries: DataFrame, how: str = "bm25") -> DataFrame:
        """(query_id, memory_id, score) for queries (query_id, term, w), as ``sparse.recall``, over the stored documents."""
        if how not in FORMULAS:
            raise ValueError(f"{how} needs all postings of a document")
        return sparse.recall(queries, written(self.postings(queries.select("term"))), self.documents().count(), how)

    def best(self, queries: DataFrame, k: int, how: str = "bm25") -> DataFrame:
        """(query_id, memory_id, score): the candidates that hold the best k of each query by ``recall``, to 6 places. The postings of the queries'
        terms are brought together by document, and a task hands out its own best."""
        if how not in FORMULAS:
            raise ValueError(f"{how} needs all postings of a document")
        wanted = queries.select("term", bucket("term").alias("bucket")).distinct()
        own = self._rows("postings", POSTINGS).filter(F.col("bucket").isin(buckets(wanted))).join(F.broadcast(wanted), ["bucket", "term"])
        own = own.groupBy("memory_id").agg(F.collect_list(F.struct("batch", "term", "w")).alias("ws")).join(self.documents(), "memory_id")
        own = own.select("memory_id", F.filter("ws", lambda x: x["batch"] == F.col("batch")).alias("ws")).filter(F.size("ws") > 0)
        return sparse.best_stored(queries, written(own), self.documents().count(), how, k).drop("n_shared")

    def compact(self, path: str) -> PostingStore:
        out, batches = PostingStore(self.spark, path), self.committed()
        if batches:
            post = self.postings().withColumn("bucket", bucket("term"))
            out._write(post.select("term", "memory_id", "w", "bucket").repartition("bucket").sortWithinPartitions("bucket", "term"), "postings", batches[-1], "bucket")
            out._write(self.documents().select("memory_id", F.lit(True).alias("live")), "documents", batches[-1])
            for batch in batches:  # replays of any of them are still known
                out._commit(batch)
        return out
