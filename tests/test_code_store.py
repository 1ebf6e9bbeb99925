"""Code entities by each of their keys, after updates and deletes too."""

import random

from pyspark.sql import functions as F

from loomspace.sources.code_store import BUCKETS, ENTITY, CodeStore

ROW = f"id long, {ENTITY}"


def entity(i, name, file, signature):
    return (i, "function", name, f"def {name}", "python", file, i, i + 1, signature)


def agrees(store, held):
    """Every look-up against a plain dictionary."""
    ids = lambda frame: sorted(r.id for r in frame.collect())
    assert {r.id: tuple(r) for r in store.entities().collect()} == held
    for index, at in (("by_name", 2), ("by_signature", 8), ("by_file", 5)):
        for key in ("a1", "zz", "f(x)", "g.py", "none"):
            assert ids(store.by_key(index, key)) == sorted(i for i, e in held.items() if e[at] == key)
    assert ids(store.by_name_prefix("a")) == sorted(i for i, e in held.items() if (e[2] or "").startswith("a"))
    assert [r.id for r in store.by_name_prefix("a", 2).collect()] == [i for _, i in sorted((e[2], i) for i, e in held.items() if (e[2] or "").startswith("a"))[:2]]
    files = {}
    for e in held.values():
        if e[5] is not None:
            files[e[5]] = files.get(e[5], 0) + 1
    assert {r.file_path: r.n for r in store.files().collect()} == files


def test_look_ups_after_updates_and_deletes(spark, tmp_path):
    r = random.Random(0)
    store, held = CodeStore(spark, str(tmp_path / "code")), {}
    assert store.entities().collect() == [] and store.by_key("by_name", "a1").collect() == []
    for batch in range(3):
        rows = [entity(i, r.choice(["a1", "a2", "ab", "zz", None]), r.choice(["g.py", "h.py", None]), r.choice(["f(x)", "f(y)", None])) for i in r.sample(range(20), 9)]
        gone = r.sample(range(20), 4) if batch else []
        assert store.upsert(spark.createDataFrame(rows + rows[:1], ROW), batch, spark.createDataFrame([(i,) for i in gone], "id long") if gone else None)
        held |= {e[0]: e for e in rows}
        held = {i: e for i, e in held.items() if i not in gone}
    agrees(store, held)
    assert not store.upsert(spark.createDataFrame([entity(1, "zz", "x", "y")], ROW), 1)
    store.delete_files(spark.createDataFrame([("g.py",), ("none",)], "file_path string"), 7)
    agrees(store, {i: e for i, e in held.items() if e[5] != "g.py"})
    plan = store._index("by_name", (F.col("bucket") == 3) & (F.col("key") == "a1"))._jdf.queryExecution().toString()
    scan = next(x for x in plan.split("\n") if "FileScan" in x and "live" in x)
    assert "PartitionFilters: [isnotnull(bucket" in scan and "EqualTo(key,a1)" in scan and BUCKETS > 1
