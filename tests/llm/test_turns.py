"""Conversation repair against a plain search over all edits."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pandas as pd
import pytest

from loomspace.llm import turns
from tests.test_entry import DATA, QUERIES

ROW = "conv_id long, turn long, role string, text string"
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def damage(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        act = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if act == 1 else re.sub("[.!?]", "", text) if act == 2 else text
        out += [(c, t, "user" if act == 4 else role, text)] * {0: 0, 3: 2}.get(act, 1)
    return out


def plain(rows):
    """gaps, blank, duplicate, truncated, illegal, cost, audit and the repaired turns of one conversation's rows."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    seen, fault = set(), []
    for _, _, role, text in rows:
        inked = re.findall("[^\x20\x09-\x0d]", text)
        fault.append("b" if not inked else "d" if (role, text) in seen else "t" if inked[-1] not in ".!?" else "")
        seen.add((role, text))
    timed = [r[1] for r in rows if r[1] is not None]
    gaps = max(timed) - min(timed) + 1 - len(set(timed)) if timed else 0
    pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:])]

    @lru_cache(None)
    def best(i, state, put):
        """(cost, edits, turns) from row i on; at most two rows put in before it."""
        options = [(0, "", ())] if i == len(rows) and state in (0, 3) else []
        if put < 2:
            for x in "ua":
                if (state, x) in STEP:
                    c, e, o = best(i, STEP[state, x], put + 1)
                    options.append((c + 3, "I" + e, (({"u": "user", "a": "assistant"}[x], ""), *o)))
        if i < len(rows):
            c, e, o = best(i + 1, state, 0)
            options.append((c + 4, "D" + e, o))
            if fault[i] not in ("b", "d"):
                more = 3 * (fault[i] == "t")
                own = rows[i][2][:1]
                if (state, own) in STEP:
                    c, e, o = best(i + 1, STEP[state, own], 0)
                    options.append((c + more, "K" + e, (rows[i][2:], *o)))
                for x in "ua":
                    if (state, x) in STEP:
                        c, e, o = best(i + 1, STEP[state, x], 0)
                        options.append((c + more + 3, "R" + e, (({"u": "user", "a": "assistant"}[x], rows[i][3]), *o)))
        return min(options) if options else (10**6, "~", ())

    cost, audit, out = best(0, 0, 0)
    return (gaps, *(fault.count(x) for x in "bdt"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit), out


def hashed(out):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


def expected(rows, act=damage):
    ids = dict.fromkeys(r[0] for r in rows)
    own = {c: [] for c in ids}
    for r in act(rows):
        own[r[0]].append(r)
    found = {c: plain(x) for c, x in own.items()}
    return {c: (*x, hashed(out)) for c, (x, out) in found.items()}, {c: out for c, (_, out) in found.items()}


def made(seed, conversations=60):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \t\n", None, "x. \n", "é!", "\xa0", "梦。"]
    roles = ["user", "assistant", "system", "tool", "", None, "User", "su"]
    rows = []
    for c in [*range(conversations), None]:
        for t in range(r.choice([0, 1, 1, 2, 3, 5, 8, 13])):
            rows.append((c, r.choice([t, t, t, None, t // 2, t * 3 - 5]), r.choice(roles[: r.choice([2, 3, 8])]), r.choice(texts[: r.choice([3, 4, 11])])))
    return rows + rows[: len(rows) // 7]


def got(frame):
    return {r.conv_id: tuple(r)[1:] for r in frame.collect()}


@pytest.mark.parametrize("seed", range(4))
def test_repairs_are_the_cheapest(spark, seed):
    rows = made(seed)
    want, out = expected(rows, lambda x: [(c, t, r or " " if r is None else r, " " if s is None else s) for c, t, r, s in x])
    frame = spark.createDataFrame(rows, ROW)
    assert got(turns.summaries(frame)) == want
    own = {}
    for x in sorted(turns.repaired(frame).collect(), key=lambda x: x.position):
        own.setdefault(x.conv_id, []).append((x.role, x.text))
        assert x.edit in "KRI" and x.position == len(own[x.conv_id]) - 1
    assert own == {c: list(o) for c, o in out.items() if o}


@pytest.mark.parametrize("seed", range(3))
def test_damage_and_repair(spark, seed):
    rows = made(100 + seed)
    want, _ = expected(rows)
    assert got(turns._solved(turns.damaged(spark.createDataFrame(rows, ROW)), False)) == want


def test_query_over_the_table(spark):
    table = pd.read_parquet(f"{DATA}/conversations.parquet")
    rows = [(int(r.conv_id), int(r.turn), r.role, r.text) for r in table.itertuples()]
    assert got(QUERIES["op13_conversation_repair"](spark, DATA)) == expected(rows)[0]


def test_one_long_conversation_and_long_texts(spark):
    r = random.Random(5)
    rows = [(1, t, r.choice(["user", "assistant"]), f"{r.randrange(900)}.") for t in range(900)]
    rows += [(2, 0, "user", "a" * 3_000_000 + "."), (2, 1, "assistant", " " * 100_000 + "b"), (3, 5, "x", "gone"), (4, 2**62, "user", "a."), (4, -3, "assistant", "b.")]
    import sys

    sys.setrecursionlimit(20_000)
    want, _ = expected(rows, lambda x: x)
    assert got(turns.summaries(spark.createDataFrame(rows, ROW))) == want


def test_empty_table_and_clashing_names(spark):
    assert turns.summaries(spark.createDataFrame([], ROW)).collect() == []
    assert turns.repaired(spark.createDataFrame([], ROW)).collect() == []
    wide = spark.createDataFrame([(1, 0, "user", "Hi.", "no", 5, 7, "z")], f"{ROW}, lost string, full long, n long, part string")
    assert [r.audit for r in turns.summaries(wide).collect()] == ["KI"]
