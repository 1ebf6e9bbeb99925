"""Changed files: each version once, none lost, over restarts and failures."""

import os

import pytest

from loomspace.sources.feeds import FileFeed


def put(folder, name, text, when):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    os.utime(path, (when, when))


def seen(feed, after=-1):
    return sorted((r.batch, r.file_path.rsplit("/", 1)[1], r.content) for r in feed.changes(after).collect())


def test_versions_come_once(spark, tmp_path):
    docs = tmp_path / "docs"
    put(docs, "a.md", "one", 1000)
    put(docs, "sub/b.md", "two é", 2000)
    put(docs, "c.txt", "no", 2000)
    feed = FileFeed(spark, str(tmp_path / "feed"))
    assert feed.poll(str(docs), "*.md") == 2 and feed.poll(str(docs), "*.md") == 0
    put(docs, "a.md", "one", 3000)  # touched, not changed
    assert FileFeed(spark, feed.path).poll(str(docs), "*.md") == 0
    put(docs, "a.md", "uno", 1500)  # changed under an older time
    put(docs, "d.md", "one", 500)  # new, older than all
    feed = FileFeed(spark, feed.path)  # a restart
    assert feed.poll(str(docs), "*.md") == 2
    (docs / "sub" / "b.md").unlink()
    assert feed.poll(str(docs), "*.md") == 1
    put(docs, "sub/b.md", "two é", 2000)  # it comes back as it was
    assert feed.poll(str(docs), "*.md") == 1
    assert seen(feed) == [(0, "a.md", "one"), (0, "b.md", "two é"), (1, "a.md", "uno"), (1, "d.md", "one"), (2, "b.md", None), (3, "b.md", "two é")]
    assert seen(feed, 1) == [(2, "b.md", None), (3, "b.md", "two é")]


def test_a_failed_poll_or_consumer_starts_again(spark, tmp_path):
    docs = tmp_path / "docs"
    put(docs, "a.md", "one", 1000)
    feed = FileFeed(spark, str(tmp_path / "feed"))

    def broken(batch):
        raise OSError("lost")

    feed._commit = broken
    with pytest.raises(OSError):
        feed.poll(str(docs))
    feed = FileFeed(spark, feed.path)
    assert feed.changes().collect() == [] and feed.poll(str(docs)) == 1
    put(docs, "b.md", "two", 2000)
    feed.poll(str(docs))
    got = []

    def work(rows, batch):
        if batch == 1 and len(got) < 2:
            got.append("failed")
            raise RuntimeError("later")
        got.append((batch, [r.content for r in rows.collect()]))

    with pytest.raises(RuntimeError):
        feed.take("index", work)
    assert FileFeed(spark, feed.path).take("index", work) == [1] and feed.take("index", work) == []
    assert got == [(0, ["one"]), "failed", (1, ["two"])]
    assert feed.take("other", lambda rows, batch: None) == [0, 1]
