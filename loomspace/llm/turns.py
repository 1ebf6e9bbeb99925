"""Conversation structure repair by a time-major tensor of state costs.

A repaired conversation's roles, by initials, are ``(s?(ua)+)?``. Each row is kept (0), given the role user or assistant (3) or deleted
(4; blank and repeated rows have to be); an empty user or assistant row can be put in anywhere (3); a row that is left with
a cut-off text costs 3 more. Of the cheapest edits those are taken whose initials (D, I, K, R) come first in ASCII.

Rows are dealt by conversation once, numbered by a window and doubled: a slim row with what the costs need and a full one with role and text.
A partition is sorted by sub-bucket, slim rows first, so a task reads the slim rows of some conversations, solves all of them, and then
streams their texts past the edits: no conversation's texts are ever held. Solving: conversations are put in classes by length
(doubling), ``cost[t, c, state]`` is filled from the last turn to the first for all conversations ``c`` of a class at once, and all are
traced forward together. States: 0 nothing yet, 1 after s, 2 after u, 3 after a.

A conversation is one key by nature, as its hash and its edits run over all its rows in order: one that holds a share of all rows costs its task some 40
bytes a row for the costs, and streams the rest.

Defined results: nulls in role and text, and in the ids that are hashed, are one space; rows with a null turn come first and
those of one turn go by role and text; rows without a conversation id are one conversation; repeated rows are rows that repeat a turn.
Conversations without rows after damage have zeros, an empty audit and the hash of the empty string. Texts of any length are read
whole; empty tables give no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RETYPE, DELETE, INSERT, CUT = 3, 4, 3, 3  #: costs
SPACES = " \t\n\x0b\f\r"
STOPS = ".!?"
SUB_BUCKETS = 64  #: parts of a partition whose slim rows are held at once
NEVER = 1 << 40  #: above any cost

#: by role initial (s, u, a, other) and state: the state after such a row; 4 is none
AFTER = np.array([[1, 4, 4, 4], [2, 2, 4, 2], [4, 4, 3, 4], [4, 4, 4, 4]])
#: by state: the state after the one user or assistant row that may follow
NEXT = np.array([2, 2, 3, 2])
D, I, K, R = b"DIKR"  # noqa: E741

SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
REPAIRED = "conv_id long, position long, edit string, role string, text string"


def rows_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with nulls of the last two as one space."""
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows damaged by crc32(``conv_id:turn``) % 20; those that are lost stay, marked ``lost``."""
    rows = rows_of(conversations)
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = rows.withColumn("act", F.crc32(F.encode(name, "UTF-8")) % 20)
    text = F.when(F.col("act") == 1, "").when(F.col("act") == 2, F.translate("text", STOPS, "")).otherwise(F.col("text"))
    role = F.when(F.col("act") == 4, "user").otherwise(F.col("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("act") == 0).alias("lost"), F.explode(F.sequence(F.lit(1), F.when(F.col("act") == 3, 2).otherwise(1))).alias("copy"))
    return rows.drop("copy")


def features(rows: DataFrame) -> DataFrame:
    """What the costs need of each row: role initial, blank, cut off, and 128 bits of the SHA-256 of role and text."""
    initial = F.substring("role", 1, 1)
    trimmed = F.rtrim(F.col("text"), F.lit(SPACES))
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    name = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    return rows.withColumns({
        "code": code.cast("byte"), "empty": trimmed == "", "open": ~F.right(trimmed, F.lit(1)).isin(*STOPS),
        "digest": F.unhex(F.substring(F.sha2(name, 256), 1, 32)),
    })


def dealt(rows: DataFrame) -> DataFrame:
    """Rows with ``lost``, by conversation: in each sub-bucket all slim rows, then all full ones, both in order."""
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = features(rows).withColumn("n", F.row_number().over(order))
    slim = F.struct(F.lit(0).alias("full"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    whole = F.struct(F.lit(1).alias("full"), F.col("role"), F.col("text"))
    part = F.pmod(F.xxhash64("conv_id"), F.lit(SUB_BUCKETS)).cast("int").alias("part")
    twice = rows.select("conv_id", "n", "turn", "lost", "code", "empty", "open", "digest", part, F.explode(F.when(F.col("lost"), F.array(slim)).otherwise(F.array(slim, whole))).alias("x"))
    return twice.select("part", "x.full", "conv_id", "n", "turn", "lost", "code", "empty", "open", "digest", "x.role", "x.text").sortWithinPartitions("part", "full", "conv_id", "n")


def costs(length: np.ndarray, code: np.ndarray, gone: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Backward costs [t, c, state] of conversations whose turns are the columns of ``code``, ``gone`` (must be deleted) and ``cut``."""
    turns, n = code.shape
    cost = np.empty((turns + 1, n, 5), np.int64)
    cost[..., 4] = NEVER
    cost[turns, :, :4] = 0, 2 * INSERT, INSERT, 0
    for t in range(turns - 1, -1, -1):
        after, own = cost[t + 1], cost[t]
        left = np.minimum(np.take_along_axis(after, AFTER[code[t]], 1), after[:, NEXT] + RETYPE) + CUT * cut[t][:, None]
        own[:, :4] = np.minimum(after[:, :4] + DELETE, np.where(gone[t][:, None], NEVER, left))
        u, a = own[:, 2].copy(), own[:, 3].copy()
        own[:, 2], own[:, 3] = np.minimum(u, a + INSERT), np.minimum(a, u + INSERT)
        own[:, :2] = np.minimum(own[:, :2], own[:, 2:3] + INSERT)
        past = t >= length
        own[past] = after[past]
    return cost


def traces(length: np.ndarray, code: np.ndarray, gone: np.ndarray, cut: np.ndarray, cost: np.ndarray) -> list[bytes]:
    """The edits of each conversation: at every step the first letter that keeps the least cost."""
    n = len(length)
    at, state, steps = np.zeros(n, np.int64), np.zeros(n, np.int64), []
    live = np.arange(n)
    while len(live := live[(at[live] < length[live]) | (state[live] == 1) | (state[live] == 2)]):
        t, s = at[live], state[live]
        row = np.minimum(t, len(code) - 1) if len(code) else t
        inside = t < length[live]
        now, after = cost[t, live, s], cost[np.minimum(t + 1, len(cost) - 1), live]
        here = np.arange(len(live))
        kind, free, more = (code[row, live], ~gone[row, live], CUT * cut[row, live]) if len(code) else (np.zeros(len(live), int), inside, 0)
        kept, fresh = AFTER[kind, s], NEXT[s]
        choice = np.select(
            [inside & (after[here, s] + DELETE == now), ~inside | (cost[t, live, fresh] + INSERT == now), free & (after[here, kept] + more == now)], [D, I, K], R)
        step = np.zeros(n, np.uint8)
        step[live] = choice
        steps.append(step)
        at[live] = t + (choice != I)
        state[live] = np.where(choice == D, s, np.where(choice == K, kept, fresh))
    if not steps:
        return [b""] * n
    return [c[c > 0].tobytes() for c in np.stack(steps, 1)]


class Part:
    """The conversations of one sub-bucket."""

    def __init__(self, number: int, turns: bool):
        self.number, self.turns, self.slim, self.audits, self.now, self.made = number, turns, [], None, None, []

    def add(self, rows: pa.RecordBatch) -> None:
        """Takes slim rows."""
        digest = np.frombuffer(b"".join(rows.column("digest").to_pylist()), np.uint64).reshape(-1, 2)
        conv, turn = rows.column("conv_id"), rows.column("turn")
        flag = lambda c: np.asarray(rows.column(c).to_numpy(zero_copy_only=False), bool)
        self.slim.append((
            np.asarray(conv.fill_null(0)), np.asarray(conv.is_null()), np.asarray(turn.fill_null(0)), np.asarray(turn.is_null()),
            flag("lost"), np.asarray(rows.column("code")).astype(np.int64), flag("empty"), flag("open"), digest[:, 0], digest[:, 1]))

    def solve(self) -> None:
        conv, none, turn, untimed, lost, code, empty, cut, high, low = (np.concatenate(c) for c in zip(*self.slim))
        self.slim = []
        change = np.append(True, (conv[1:] != conv[:-1]) | (none[1:] != none[:-1]))
        first, which = np.flatnonzero(change), np.cumsum(change) - 1
        self.ids = [None if b else int(a) for a, b in zip(conv[first], none[first])]
        self.index = {c: k for k, c in enumerate(self.ids)}
        n, live = len(first), ~lost
        which, turn, untimed, code, empty, cut, high, low = (c[live] for c in (which, turn, untimed, code, empty, cut, high, low))
        length = np.bincount(which, minlength=n)
        start = np.cumsum(length) - length
        count = lambda mask: np.bincount(which[mask], minlength=n)
        same = np.append(False, which[1:] == which[:-1])

        order = np.lexsort((np.arange(len(which)), low, high, which))
        again = np.zeros(len(which), bool)
        again[order[1:]] = (which[order[1:]] == which[order[:-1]]) & (high[order[1:]] == high[order[:-1]]) & (low[order[1:]] == low[order[:-1]])
        again &= ~empty
        cut = cut & ~empty & ~again
        pair = np.append(9, code[:-1] * 4 + code[1:]) if len(code) else code
        illegal = same & ~np.isin(pair, (0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1))

        timed = ~untimed
        t, w = turn[timed], which[timed]
        gaps = np.zeros(n, np.int64)
        if len(t):
            begin = np.flatnonzero(np.diff(w, prepend=-1))
            last = np.append(begin[1:], len(t)) - 1
            distinct = np.add.reduceat(np.append(True, (t[1:] != t[:-1]) | (w[1:] != w[:-1])).astype(np.int64), begin)
            gaps[w[begin]] = t[last] - t[begin] + 1 - distinct
        self.counts = [gaps, count(empty), count(again), count(cut), count(illegal)]

        self.audits, self.cost = [b""] * n, np.zeros(n, np.int64)
        size_class = np.ceil(np.log2(np.maximum(length, 1))).astype(int)
        for k in np.unique(size_class[length > 0]):
            own = np.flatnonzero((size_class == k) & (length > 0))
            size = length[own]
            at = np.minimum(np.arange(size.max())[:, None], size - 1) + start[own]
            table = code[at], (empty | again)[at], cut[at]
            cost = costs(size, *table)
            self.cost[own] = cost[0, :, 0]
            for c, audit in zip(own, traces(size, *table, cost)):
                self.audits[c] = audit
        self.hashes = [hashlib.sha256().hexdigest()] * n

    def read(self, rows: pa.RecordBatch) -> None:
        """Streams full rows past the edits."""
        if self.audits is None:
            self.solve()
        for conv, role, text in zip(*(rows.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
            k = self.index[conv]
            if k != self.now:
                self.close()
                self.now, self.at, self.out, self.spoken, self.hash = k, 0, 0, 0, hashlib.sha256()
            self.inserted()
            edit = self.audits[k][self.at]
            self.at += 1
            if edit == K:
                self.put(edit, role, text)
            elif edit == R:
                self.put(edit, ("user", "assistant")[self.spoken & 1], text)

    def inserted(self) -> None:
        audit = self.audits[self.now]
        while self.at < len(audit) and audit[self.at] == I:
            self.at += 1
            self.put(I, ("user", "assistant")[self.spoken & 1], "")

    def put(self, edit: int, role: str, text: str) -> None:
        if self.out:
            self.hash.update(b"\n")
        self.hash.update(f"{role}:{text}".encode())
        if self.turns:
            self.made.append((self.ids[self.now], self.out, chr(edit), role, text))
        self.spoken += not (self.out == 0 and role[:1] == "s")
        self.out += 1

    def close(self) -> None:
        if self.now is not None:
            self.inserted()
            self.hashes[self.now] = self.hash.hexdigest()

    def repaired(self) -> Iterator[pa.RecordBatch]:
        """The turns put out so far."""
        made, self.made = self.made, []
        if made:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], ["conv_id", "position", "edit", "role", "text"])

    def finish(self) -> Iterator[pa.RecordBatch]:
        if self.audits is None:
            self.solve()
        self.close()
        if self.turns:
            yield from self.repaired()
        else:
            columns = [pa.array(self.ids, pa.int64()), *map(pa.array, (*self.counts, self.cost)), pa.array([a.decode() for a in self.audits], pa.string()), pa.array(self.hashes, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"])


def _solved(rows: DataFrame, turns: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = None
        for batch in batches:
            key = np.asarray(batch.column("part")).astype(np.int64) * 2 + np.asarray(batch.column("full"))
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1), len(key)]
            for i, j in zip(cuts[:-1], cuts[1:]):
                if i == j:
                    continue
                if part is None or part.number != key[i] // 2:
                    if part is not None:
                        yield from part.finish()
                    part = Part(int(key[i] // 2), turns)
                if key[i] % 2:
                    part.read(batch.slice(i, j - i))
                    yield from part.repaired()
                else:
                    part.add(batch.slice(i, j - i))
        if part is not None:
            yield from part.finish()

    return dealt(rows).mapInArrow(run, REPAIRED if turns else SUMMARY)


def marked(rows: DataFrame) -> DataFrame:
    return rows_of(rows).withColumn("lost", F.lit(False))


def summaries(conversations: DataFrame) -> DataFrame:
    """A row per conversation: its faults, the least cost, the edits and the hash of the repaired turns."""
    return _solved(marked(conversations), False)


def repaired(conversations: DataFrame) -> DataFrame:
    """The repaired turns themselves: conv_id, position, edit (K kept, R retyped, I put in), role, text."""
    return _solved(marked(conversations), True)


def query(spark, sf_dir: str) -> DataFrame:
    return _solved(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")), False)


#: The query in SQL: CRC-32 by a table, costs by a recursion from the last turn, edits by one from the first.
SQL = r"""
WITH RECURSIVE crc AS MATERIALIZED (
  SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t FROM range(256) r(n)
), named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations
), acts AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(name, ''), lambda c: ord(c)::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS act FROM named, crc
), damaged AS (
  SELECT conv_id, turn, CASE act WHEN 4 THEN 'user' ELSE role END AS role, CASE act WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE act WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM acts WHERE act <> 0
), placed AS (
  SELECT conv_id, turn, role, text, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS g, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged
), counted AS (
  SELECT *, row_number() OVER (PARTITION BY g, role, text ORDER BY i) AS nth FROM placed
), faults AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
    WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, left(role, 1) AS initial FROM counted
), turns AS MATERIALIZED (
  SELECT *, fault IN ('blank', 'duplicate') AS gone, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END AS more,
    CASE WHEN i > 1 AND lag(initial) OVER (PARTITION BY g ORDER BY i) || initial NOT IN ('su', 'ua', 'au') THEN 1 ELSE 0 END AS illegal FROM faults
), sizes AS MATERIALIZED (
  SELECT g, any_value(conv_id) AS conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
    count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated, sum(illegal)::BIGINT AS illegal FROM turns GROUP BY g
), costs AS (
  SELECT g, n AS i, [0, 6, 3, 0] AS b FROM sizes
  UNION ALL
  SELECT g, i, [least(x[1], u + 3), least(x[2], u + 3), u, a] FROM (
    SELECT g, i, x, least(x[3], x[4] + 3) AS u, least(x[4], x[3] + 3) AS a FROM (
      SELECT c.g, c.i - 1 AS i, [
        least(b[1] + 4, CASE WHEN NOT gone THEN more + least(CASE initial WHEN 's' THEN b[2] WHEN 'u' THEN b[3] END, b[3] + 3) END),
        least(b[2] + 4, CASE WHEN NOT gone THEN more + least(CASE initial WHEN 'u' THEN b[3] END, b[3] + 3) END),
        least(b[3] + 4, CASE WHEN NOT gone THEN more + least(CASE initial WHEN 'a' THEN b[4] END, b[4] + 3) END),
        least(b[4] + 4, CASE WHEN NOT gone THEN more + least(CASE initial WHEN 'u' THEN b[3] END, b[3] + 3) END)] AS x
      FROM costs c JOIN turns t ON t.g = c.g AND t.i = c.i))
), held AS MATERIALIZED (SELECT * FROM costs
), trace AS (
  SELECT g, n, 0::BIGINT AS i, 1 AS q, '' AS audit, []::VARCHAR[] AS said, 0 AS spoken FROM sizes
  UNION ALL
  SELECT g, n, CASE op WHEN 'I' THEN i ELSE i + 1 END, CASE op WHEN 'D' THEN q WHEN 'K' THEN kept ELSE fresh END, audit || op,
    CASE op WHEN 'D' THEN said WHEN 'K' THEN list_append(said, role || ':' || text) WHEN 'I' THEN list_append(said, speaker || ':') ELSE list_append(said, speaker || ':' || text) END,
    spoken + CASE WHEN op = 'D' OR (op = 'K' AND kept = 2) THEN 0 ELSE 1 END
  FROM (
    SELECT *, CASE WHEN i < n AND nb[q] + 4 = b[q] THEN 'D' WHEN i = n OR b[fresh] + 3 = b[q] THEN 'I' WHEN NOT gone AND kept IS NOT NULL AND nb[kept] + more = b[q] THEN 'K' ELSE 'R' END AS op,
      CASE spoken % 2 WHEN 0 THEN 'user' ELSE 'assistant' END AS speaker
    FROM (
      SELECT k.*, h.b, h2.b AS nb, t.gone, t.more, t.role, t.text, CASE q WHEN 3 THEN 4 ELSE 3 END AS fresh,
        CASE WHEN q = 1 AND t.initial = 's' THEN 2 WHEN q <> 3 AND t.initial = 'u' THEN 3 WHEN q = 3 AND t.initial = 'a' THEN 4 END AS kept
      FROM trace k JOIN held h ON h.g = k.g AND h.i = k.i LEFT JOIN held h2 ON h2.g = k.g AND h2.i = k.i + 1 LEFT JOIN turns t ON t.g = k.g AND t.i = k.i + 1
      WHERE k.i < k.n OR k.q IN (2, 3)))
), found AS (
  SELECT conv_id, gaps, blank, duplicate, truncated, illegal, h.b[1]::BIGINT AS cost, audit, sha256(array_to_string(said, chr(10))) AS repaired_sha256
  FROM trace k JOIN sizes USING (g) JOIN held h ON h.g = k.g AND h.i = 0 WHERE k.i = k.n AND k.q IN (1, 4)
)
SELECT o.id AS conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id AS id FROM conversations) o LEFT JOIN found ON found.conv_id IS NOT DISTINCT FROM o.id
"""
