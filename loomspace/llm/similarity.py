"""N-gram Jaccard join with signature trees.

A document's set is the distinct hashes of its word shingles. Equal sets are one node at once. The others are grouped so
that every pair that may link meets in a group: tokens are dealt by hash into more parts than two linked sets can
differ in, so linked sets agree in a whole part, and a group is the sets that agree in a part. Groups are exact, they
lose no link, and have no parameter that cuts them.

Within a group (in chunks of bounded text) a signature tree finds the links: leaves are sets, and each node holds the OR
and the AND of its token bitmaps and its range of set sizes. Dual traversal drops a pair of nodes when their largest
possible overlap cannot reach the threshold; pairs of sets that are left are compared exactly, unless they are connected
already. First each set is traversed with the leader it shares most groups with, which joins up nearly all of a group
of near copies by work in proportion to it; then only the groups are traversed that still hold sets of different
components. There only bitmaps travel, and the pairs that they allow are compared by their texts.

Defined results: null or empty text, and text without words, is an empty set that links with nothing; fewer words than a
shingle make one; repeated rows each get their row and the same component; rows without an id get the component
of the equal set, or none; texts of any length are read whole;
other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import components
from ._shared import id_text, materialise
from ._text import LOWER, SPACED, RangeHash, blocks, mix

_U = np.uint64
CHUNK = 400_000  #: shingles of the sets in one tree
LEAF = 16
BUCKET = 500_000  #: shingles of the sets whose parts a bucket gathers a share of


def sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    for block in blocks(texts):
        s, e, first = block.words(SPACED, True)
        h = RangeHash(LOWER[block.data])(s, e)
        n = len(h) - size + 1
        runs = np.full(max(0, n), _U(size))
        for k in range(size):
            runs = mix(runs * _U(0x9E3779B97F4A7C15) + h[k : k + max(0, n)])
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= size:
                yield np.unique(runs[a : b - size + 1])
            elif b > a:
                x = np.full(1, _U(b - a))
                for k in range(a, b):
                    x = mix(x * _U(0x9E3779B97F4A7C15) + h[k])
                yield x
            else:
                yield h[:0]


class Parts:
    """Classes of set sizes, and of each the number of parts its tokens are dealt into.

    Sets of a and b tokens that link (100 * overlap >= percent * union) differ in at most (a + b) (100 - percent) / (100 + percent)
    tokens, and each of these spoils one part. A set is grouped by its largest parts, one more than can be spoiled, and all
    as large: of those one at least is the same in any set that it links with. Of two sets, the one whose least part is larger
    so meets the other. There are a quarter more parts than that, so that parts of few tokens, which sets share by chance, are left out.

    Empty parts tell nothing and group nothing. Where they are among a set's largest, they can be all that it has in common with
    a set that it links with, and then they are so for both; such sets are grouped by their prefixes as well: of two sets that link,
    the first n - ceil(n percent / 100) + 1 tokens of each in the order of hashes have one in common.
    """

    def __init__(self, percent: int):
        self.percent, self.bounds = percent, [1]
        self.ratio = max(1.25, 100 / percent)

    def differ(self, a: int, b: int) -> int:
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    def of(self, n: int) -> list[tuple[int, int, int]]:
        """(class, parts, parts that can be spoiled) for a set of n tokens: its own class, and those above with sets it may link with."""
        most = n * 100 // self.percent
        while self.bounds[-1] <= most:
            self.bounds.append(max(self.bounds[-1] + 1, int(self.bounds[-1] * self.ratio)))
        out, k = [], bisect_right(self.bounds, n) - 1
        while self.bounds[k] <= most:
            largest = self.bounds[k + 1] - 1
            spoiled = self.differ(largest, largest)
            out.append((k, spoiled + 1 + spoiled // 4, self.differ(n, min(largest, most))))
            k += 1
        return out

    def signatures(self, tokens: np.ndarray) -> np.ndarray:
        """A hash of each part's tokens, with its class and number."""
        if not len(tokens):
            return np.zeros(0, np.int64)
        found, bare = [], False
        a = mix(tokens ^ _U(0xA5A5A5A55A5A5A5A))
        for k, parts, spoiled in self.of(len(tokens)):
            part = (a % _U(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            c = np.zeros(len(tokens) + 1, _U)
            np.cumsum(tokens[order], out=c[1:])
            size = np.bincount(part, minlength=parts)
            bounds = np.concatenate([[0], np.cumsum(size)])
            total = c[bounds[1:]] - c[bounds[:-1]]
            least = np.partition(size, parts - 1 - spoiled)[parts - 1 - spoiled]
            bare |= not least
            number = np.flatnonzero(size >= max(1, least))
            found.append(mix(total[number] + mix(number.astype(np.uint64) * _U(0xD1B54A32D192ED03) + _U(k + 1))))
        if bare:
            prefix = np.sort(a)[: len(tokens) + (-len(tokens) * self.percent) // 100 + 1]
            found.append(mix(prefix ^ _U(0x3C3C3C3CC3C3C3C3)))
        return np.concatenate(found).view(np.int64)


class Node:
    """A signature tree node over sets ``rows`` (indexes)."""

    __slots__ = ("all", "any", "kids", "high", "low", "rows")

    def __init__(self, rows: np.ndarray, size: np.ndarray, bits: np.ndarray):
        self.rows = rows
        self.low, self.high = int(size[rows].min()), int(size[rows].max())
        self.any, self.all = np.bitwise_or.reduce(bits[rows]), np.bitwise_and.reduce(bits[rows])
        half = len(rows) // 2
        self.kids = [] if len(rows) <= LEAF else [Node(r, size, bits) for r in (rows[:half], rows[half:])]


def bitmap(tokens: np.ndarray, width: int) -> np.ndarray:
    own = np.zeros(width, np.uint8)
    own[(mix(tokens) & _U(width - 1)).astype(np.int64)] = 1
    return np.packbits(own, bitorder="little").view(_U)


def width_for(n: int, bits: int) -> int:
    """The power of two from 512 to 65536 that has ``bits`` bits a token, if any has."""
    return min(1 << 16, max(512, 1 << max(0, int(n) * bits - 1).bit_length()))


class Tree:
    """A signature tree over one group of sets; ``tokens`` may be missing where only bitmaps are known."""

    def __init__(self, size: np.ndarray, bits: np.ndarray, percent: int, head: np.ndarray, tokens: list[np.ndarray] | None = None):
        self.size, self.bits, self.percent, self.tokens = size, bits, percent, tokens
        self.root = Node(np.lexsort((size, head)), size, bits)

    @classmethod
    def of(cls, tokens: list[np.ndarray], percent: int) -> Tree:
        size = np.array([len(t) for t in tokens], np.int64)
        width = width_for(size.max(initial=1), 2)
        head = np.array([t[0] if len(t) else 0 for t in tokens], _U)
        return cls(size, np.stack([bitmap(t, width) for t in tokens]), percent, head, tokens)

    @classmethod
    def of_bitmaps(cls, size: np.ndarray, packed: list[bytes], percent: int) -> Tree:
        """Bitmaps of several widths are folded to the least of them."""
        least = min(map(len, packed)) // 8
        bits = np.stack([np.bitwise_or.reduce(np.frombuffer(x, _U).reshape(-1, least)) for x in packed])
        return cls(size, bits, percent, np.bitwise_count(bits[:, : least // 4]).sum(1, dtype=np.uint64))

    def may(self, a: Node, b: Node) -> bool:
        """Whether any set of a and any of b can reach the threshold."""
        p = self.percent
        if 100 * a.high < p * b.low or 100 * b.high < p * a.low:
            return False
        only_a, only_b = (int(np.bitwise_count(x.all & ~y.any).sum()) for x, y in ((a, b), (b, a)))
        # an overlap is at most size - only, a union at least size
        return 100 * (a.high - only_a) >= p * a.high and 100 * (b.high - only_b) >= p * b.high

    def pairs(self, a: Node, b: Node, find) -> Iterator[tuple[int, int]]:
        """Pairs of sets, one of each leaf, whose own bitmaps allow a link and that aren't connected."""
        x, y = self.bits[a.rows][:, None], self.bits[b.rows][None]
        nx, ny = self.size[a.rows][:, None], self.size[b.rows][None]
        most = np.minimum(nx - np.bitwise_count(x & ~y).sum(2, dtype=np.int64), ny - np.bitwise_count(y & ~x).sum(2, dtype=np.int64))
        ra, rb = (np.array([find(int(r)) for r in n.rows]) for n in (a, b))
        ok = (100 * most >= self.percent * (nx + ny - most)) & (nx > 0) & (ny > 0) & (ra[:, None] != rb[None])
        for i, j in zip(*np.nonzero(np.triu(ok, 1) if a is b else ok)):
            yield int(a.rows[i]), int(b.rows[j])

    def linked(self, i: int, j: int) -> bool:
        both = len(np.intersect1d(self.tokens[i], self.tokens[j], assume_unique=True))
        return 100 * both >= self.percent * (len(self.tokens[i]) + len(self.tokens[j]) - both)

    def join(self, component: list[int], candidates: list[tuple[int, int]] | None = None) -> list[int]:
        """Components after all links are joined; ``component`` are those known before. With ``candidates``, pairs that
        may link are put there and not compared."""
        up = list(range(len(component)))

        def find(k: int) -> int:
            while up[k] != k:
                up[k] = up[up[k]]
                k = up[k]
            return k

        seen: dict[int, int] = {}
        for k, c in enumerate(component):
            up[find(k)] = find(seen.setdefault(c, k))
        todo = [(self.root, self.root)]
        while todo:
            a, b = todo.pop()
            if a is not b and not self.may(a, b):
                continue
            if not a.kids and not b.kids:
                for i, j in self.pairs(a, b, find):
                    if candidates is not None:
                        candidates.append((i, j))
                    elif find(i) != find(j) and self.linked(i, j):
                        up[find(i)] = find(j)
            elif a is b:
                todo += [(a.kids[0], a.kids[1]), (a.kids[1], a.kids[1]), (a.kids[0], a.kids[0])]
            else:
                big, other = (a, b) if a.kids and (not b.kids or len(a.rows) >= len(b.rows)) else (b, a)
                todo += [(k, other) for k in big.kids]
        return [find(k) for k in range(len(component))]


def links(groups: DataFrame, size: int, percent: int) -> DataFrame:
    """Edges (a, b) that join up each group (part, chunk; doc_id, comp, text) as its links do."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        docs = np.array(table.column("doc_id").to_numpy())
        comp = table.column("comp").to_pylist()
        text = table.column("text")
        tokens = [t for c in (text.chunks if isinstance(text, pa.ChunkedArray) else [text]) for t in sets(c, size)]
        roots = np.array(Tree.of(tokens, percent).join(comp), np.int64)
        first = {}
        a, b = [], []
        for doc, c, r in sorted(zip(docs.tolist(), comp, roots.tolist())):
            if first.setdefault(r, c) != c:
                a.append(first[r]), b.append(c)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return groups.select("part", "chunk", "doc_id", "comp", "text").groupBy("part", "chunk").applyInArrow(run, "a long, b long")


def sketched(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, bits): bitmaps of four bits a token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [bitmap(t, width_for(len(t), 4)).tobytes() for t in sets(batch.column(1), size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary())], names=["doc_id", "bits"])

    return docs.mapInArrow(run, "doc_id long, bits binary")


def candidates(groups: DataFrame, percent: int) -> DataFrame:
    """(a, b, ca, cb): documents and components of pairs in each group (part, chunk; doc_id, comp, n_shingles, bits) that
    their bitmaps allow to link, across components."""

    def run(table: pa.Table) -> pa.Table:
        doc, comp, size = (np.array(table.column(c).to_numpy(), np.int64) for c in ("doc_id", "comp", "n_shingles"))
        found: list[tuple[int, int]] = []
        Tree.of_bitmaps(size, table.column("bits").to_pylist(), percent).join(comp.tolist(), found)
        i, j = (np.array(x, np.int64) for x in (zip(*found) if found else ((), ())))
        i, j = np.where(doc[i] < doc[j], i, j), np.where(doc[i] < doc[j], j, i)
        return pa.table({"a": doc[i], "b": doc[j], "ca": comp[i], "cb": comp[j]})

    columns = ("part", "chunk", "doc_id", "comp", "n_shingles", "bits")
    return groups.select(*columns).groupBy("part", "chunk").applyInArrow(run, "a long, b long, ca long, cb long").distinct()


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Edges (a, b) between the components of pairs whose sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [100 * (n := len(np.intersect1d(x, y, assume_unique=True))) >= percent * (len(x) + len(y) - n) for x, y in zip(sets(batch.column(2), size), sets(batch.column(3), size))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(both, pa.bool_()))

    a, b = (texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"t{x}")) for x in "ab")
    return pairs.join(a, "a").join(b, "b").select("ca", "cb", "ta", "tb").mapInArrow(run, "a long, b long")


def describe(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, s1, s2): the size and a 128-bit hash of each document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, a, b = [], [], []
            for t in sets(batch.column(1), size):
                n.append(len(t)), a.append(t.sum(dtype=np.uint64)), b.append(mix(t).sum(dtype=np.uint64))
            both = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *both], names=["doc_id", "n_shingles", "s1", "s2"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, s1 long, s2 long")


PARTS = "bucket long, base long, offsets binary, parts binary, held binary"


def _packed(bucket: int, doc: np.ndarray, part: np.ndarray, held: np.ndarray) -> pa.RecordBatch:
    base = int(doc.min())
    wide = np.int64 if doc.max() - base >= 1 << 32 else np.uint32
    cells = [[bucket], [base], [(doc - base).astype(wide).tobytes()], [part.tobytes()], [held.astype(np.uint8).tobytes()]]
    types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types)], names=["bucket", "base", "offsets", "parts", "held"])


def signed(docs: DataFrame, size: int, percent: int, buckets: int) -> DataFrame:
    """The parts of all documents, packed as (bucket, base, offsets, parts, held): of each batch and bucket the signatures of parts,
    doc_id - base beside each, and whether the batch has the part more than once. Of equal sets in a batch only the first
    document is taken. Of the documents that have a part in common in a batch only the first goes to the part's bucket, so
    a part that any share of all documents has sends a row a batch there; the others go to buckets below 0, spread out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = Parts(percent)
        for batch in batches:
            ids = np.array(batch.column(0).to_numpy(), np.int64)
            first: dict[tuple[int, int, int], int] = {}
            found = []
            for k, t in enumerate(sets(batch.column(1), size)):
                key = len(t), int(t.sum(dtype=np.uint64)), int(mix(t).sum(dtype=np.uint64))
                if len(t) and ids[first.setdefault(key, k)] >= ids[k]:
                    first[key] = k
                    found.append((k, parts.signatures(t)))
            chosen = set(first.values())
            found = [(k, x) for k, x in found if k in chosen]
            if not found:
                continue
            part = np.concatenate([x for _, x in found])
            doc = np.repeat(ids[[k for k, _ in found]], [len(x) for _, x in found])
            order = np.lexsort((doc, part))
            part, doc = part[order], doc[order]
            fresh = np.ones(len(part), bool)
            fresh[1:] = part[1:] != part[:-1]
            held = np.append(~fresh[1:], False)[fresh]
            if not fresh.all():
                yield _packed(-1 - int(mix(part[:1].view(np.uint64))[0] % _U(buckets)), doc[~fresh], part[~fresh], np.ones(int((~fresh).sum()), bool))
            part, doc = part[fresh], doc[fresh]
            bucket = (mix(part.view(np.uint64)) % _U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bounds = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            for a, b in zip(bounds, np.append(bounds[1:], len(order))):
                at = order[a:b]
                yield _packed(int(bucket[at[0]]), doc[at], part[at], held[at])

    return docs.mapInArrow(run, PARTS)


def met(packed: DataFrame) -> DataFrame:
    """(part, doc_id) of parts that more than one document has."""

    def run(table: pa.Table) -> pa.Table:
        part, doc, known = [], [], []
        for base, offsets, parts, held in zip(*(table.column(c).to_pylist() for c in ("base", "offsets", "parts", "held"))):
            part.append(np.frombuffer(parts, np.int64))
            doc.append(np.frombuffer(offsets, np.uint32 if len(offsets) < len(parts) else np.int64).astype(np.int64) + base)
            known.append(np.frombuffer(held, np.uint8) > 0)
        p, d, k = np.concatenate(part), np.concatenate(doc), np.concatenate(known)
        if table.column("bucket")[0].as_py() >= 0:
            order = np.argsort(p, kind="stable")
            p, d, k = p[order], d[order], k[order]
            same = p[1:] == p[:-1]
            k = k | np.append(same, False) | np.insert(same, 0, False)
        return pa.table({"part": pa.array(p[k]), "doc_id": pa.array(d[k])})

    return packed.groupBy("bucket").applyInArrow(run, "part long, doc_id long")


def apart(rows: DataFrame, value: str) -> DataFrame:
    """(part, leader) of the parts whose rows differ in ``value``, leader the least; combined before the shuffle."""
    ends = rows.groupBy("part").agg(F.min(value).alias("leader"), F.max(value).alias("_last"))
    return ends.filter("leader <> _last").drop("_last")


def jaccard_components(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """Per document: n_shingles and component_id, the smallest doc_id reachable by links."""
    docs = id_text(docs)
    described = materialise(describe(docs, size))
    key = ["n_shingles", "s1", "s2"]
    nodes = materialise(described.filter("n_shingles > 0 and doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("node")))
    own = docs.filter("doc_id is not null")
    total = nodes.agg(F.sum("n_shingles")).first()[0] or 0
    rows = met(signed(own, size, percent, int(total // BUCKET) + 1))
    rows = rows.join(nodes.groupBy(F.col("node").alias("doc_id")).agg(F.max("n_shingles").alias("n_shingles")), "doc_id")
    # a join and no window: a part that any share of all documents has can be split
    rows = materialise(rows)
    shared = materialise(rows.join(apart(rows, "doc_id").hint("merge"), "part"))
    wanted = shared.select("doc_id").distinct()
    texts = materialise(own.join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"]))

    # each set with the leader it meets in most groups, in chunks that each have the leader
    votes = shared.filter("leader <> doc_id").groupBy("doc_id", "n_shingles", "leader").count()
    chosen = votes.groupBy("doc_id", "n_shingles").agg(F.max_by("leader", F.struct("count", -F.col("leader"))).alias("part"))
    chosen = materialise(chosen)
    many = chosen.groupBy("part").agg(F.ceil(F.sum("n_shingles") / CHUNK).alias("chunks"))
    member = chosen.join(many, "part").select("part", F.pmod(F.xxhash64("doc_id"), "chunks").alias("chunk"), "doc_id")
    member = member.union(member.select("part", "chunk", F.col("part").alias("doc_id")).distinct())
    edges = links(member.withColumn("comp", F.col("doc_id")).join(texts, "doc_id"), size, percent)
    first = materialise(components(edges))

    # then groups that still hold different components; groups of the same sets are one
    known = shared.join(first.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("comp", F.coalesce("root", "doc_id")).drop("root")
    known = materialise(known.select("part", "doc_id", "n_shingles", "comp"))
    mixed = materialise(known.join(apart(known, "comp").drop("leader").hint("merge"), "part"))
    same = mixed.groupBy("part").agg(F.count("*").alias("n"), F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("h"), F.sum(F.xxhash64("doc_id", F.lit(1)).cast("decimal(38,0)")).alias("g"), F.sum("n_shingles").alias("total"))
    same = same.groupBy("n", "h", "g", "total").agg(F.min("part").alias("part")).select("part", F.ceil(F.col("total") * 2 / CHUNK).alias("chunks"))
    held = mixed.join(same, "part").withColumn("own", F.pmod(F.xxhash64("doc_id"), "chunks"))
    # every two chunks of a large group meet
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    held = held.withColumn("other", other).withColumn("chunk", F.least("own", "other") * F.col("chunks") + F.greatest("own", "other"))
    pairs = materialise(candidates(held.join(sketched(texts, size), "doc_id"), percent))
    more = components(verified(pairs, texts, size, percent)).withColumnRenamed("root", "top").withColumnRenamed("node", "root")
    roots = first.join(more, "root", "full").select(F.coalesce("node", "root").alias("node"), F.coalesce("top", "root").alias("root"))
    roots = materialise(roots)
    found = described.join(nodes, key, "left").join(roots, "node", "left")
    return found.select("doc_id", "n_shingles", F.coalesce("root", "node", "doc_id").alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The query in SQL, by joining all documents that share a shingle; components by recursion.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])) END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 90 * (max(a.n) + max(b.n) - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(doc_id, seen) AS (SELECT DISTINCT a, a FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.seen),
c AS (SELECT doc_id, min(seen) AS root FROM r GROUP BY doc_id)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(root, s.doc_id) AS component_id FROM s LEFT JOIN c USING (doc_id)
"""
