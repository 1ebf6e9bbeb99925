"""URL filters against a plain version of the rules and the template tree."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from loomspace.llm import url_templates as ut
from tests.test_entry import DATA, QUERIES, SQL, duck, plain  # noqa: F401

PAGE, LABEL = "page_id long, url string", "doc_id long, quality int, toxic int"


def located(url):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def ruled(host, path, rules=ut.RULES):
    fits = []
    for action, text in rules:
        own, _, rest = text.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + rest):
            fits.append((-len(text), text, action))
    return min(fits)[1:] if fits else (None, None)


def expected(pages, labels):
    rows = [(p, *located(u)) for p, u in pages]
    good = defaultdict(list)
    for d, q, t in labels:
        if d is not None and q is not None and t is not None:
            good[d].append(int(q == 1 and t == 0))
    good = {d: min(g) for d, g in good.items()}
    split = [[s for s in path.split("/") if s] for _, _, path in rows]
    seen, total = Counter(), Counter()
    for (_, host, _), segs in zip(rows, split):
        for k, s in enumerate(segs):
            seen[host, k, s] += 1
            total[host, k] += 1
    templates = []
    for (_, host, _), segs in zip(rows, split):
        t = [s if s != "*" and seen[host, k, s] >= 5 and 100 * seen[host, k, s] >= 5 * total[host, k] else "*" for k, s in enumerate(segs)]
        last = max((k + 1 for k, s in enumerate(t) if s != "*"), default=0)
        templates.append(tuple(t[:last] + ["*"] * (len(t) > last)))
    node = defaultdict(lambda: [0, 0, 0, 0])
    for (p, host, _), t in zip(rows, templates):
        for k in range(len(t) + 1):
            x = node[host, t[:k]]
            x[0] += 1
            x[1] += p in good
            x[2] += good.get(p, 0)
            x[3] += k == len(t)
    merged, kids = {}, defaultdict(list)
    for (host, t), x in node.items():
        kids[host, t[:-1] if t else None].append((x[1] == 0, x[2] / x[1] if x[1] else -1, "/".join(t), t, x))
    for (host, _), own in kids.items():
        runs = []
        for none, p, _, t, x in sorted(own):
            if runs and not none:
                _, bp, bx = runs[-1][-1]
                near = lambda a, b, n, m: abs(a - b) <= ut.BOUND * (1 / math.sqrt(n) + 1 / math.sqrt(m))
                if bx[1] and near(p, bp, x[1], bx[1]) and near(x[3] / x[0], bx[3] / bx[0], x[0], bx[0]):
                    runs[-1].append((t, p, x))
                    continue
            runs.append([(t, p, x)])
        for run in runs:
            for t, _, _ in run:
                merged[host, t] = sum(x[1] for _, _, x in run), sum(x[2] for _, _, x in run)
    n, g = sum(p in good for p, _, _ in rows), sum(good.get(p, 0) for p, _, _ in rows)
    out = []
    for (p, host, path), t in zip(rows, templates):
        pure = g / n if n else 1.0
        path_counts = [merged[host, t[:k]] for k in range(len(t) + 1)] + [(0, 0)]
        for (a, b), (c, d) in zip(path_counts, path_counts[1:]):
            pure = (b - d + 10 * pure) / (a - c + 10)
        rule, action = ruled(host, path)
        out.append((p, host, path, rule, action or ("block" if round(pure, 9) < 0.5 else "allow"), "/".join(t), round(round(pure, 9), 6)))
    return sorted(out, key=repr)


def got(spark, pages, labels):
    rows = ut.url_verdicts(spark.createDataFrame(pages, PAGE), spark.createDataFrame(labels, LABEL)).collect()
    return sorted(((*tuple(r)[:6], round(r.purity, 6)) for r in rows), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_verdicts_are_the_plain_ones(spark, seed):
    r = random.Random(seed)
    hosts = ["a.example.com", "Example.NET", "x.example.net", "fr.org", "junk.io", "org", "badexample.net", ""]
    path = lambda: "".join(f"/{r.choice(['en', 'de', 'fr', 'news', 'tag', '*', '', str(r.randrange(99))])}" for _ in range(r.randrange(5)))
    url = lambda: f"{r.choice(['http', 'https', ''])}://{r.choice(hosts)}{path()}{r.choice(['', '?a=/b', '#/c', '/'])}"
    pages = [(r.choice([None, k, k]), url()) for k in range(600)] + [(700, None), (701, ""), (702, "no scheme/en/"), (703, "a://b://c/d"), (703, "a://b://c/d"), (704, "é://Ä.net/en")]
    labels = [(k, r.choice([0, 1, 1, 1, 1, None]), r.choice([0, 0, 0, 0, 1, None])) for k in range(600) if r.random() < 0.9] + [(5, 1, 0), (5, 0, 0), (None, 1, 0)]
    labels += [(p, 0, 0) for p, u in pages if u and "junk.io/tag" in u and p is not None]
    want = expected(pages, labels)
    assert got(spark, pages, labels) == want
    assert {(w[3], w[4]) for w in want} >= {("net/", "block"), ("example.net/en/", "allow"), ("org/fr/", "allow"), (None, "allow"), (None, "block")}


def test_a_bad_branch_goes_and_its_neighbours_stay(spark):
    pages = [(k, f"http://site.com/{'spam' if k % 3 == 0 else 'good'}/{k}") for k in range(300)]
    labels = [(k, int(k % 3 != 0), 0) for k in range(0, 300, 2)]
    out = {r.page_id: (r.verdict, r.template) for r in ut.url_verdicts(spark.createDataFrame(pages, PAGE), spark.createDataFrame(labels, LABEL)).collect()}
    assert out == {k: ("block", "spam/*") if k % 3 == 0 else ("allow", "good/*") for k in range(300)}


def test_branches_alike_share_their_labels(spark):
    """Six branches with three bad labels each are one proof together, and none alone."""
    pages = [(k, f"http://site.com/{'abcdef'[k % 6]}/{k}") for k in range(60)] + [(100 + k, f"http://site.com/ok/{k}") for k in range(60)]
    labels = [(k, 0, 0) for k in range(18)] + [(100 + k, 1, 0) for k in range(40)]
    frame = lambda b: ut.url_verdicts(spark.createDataFrame(pages, PAGE), spark.createDataFrame(labels, LABEL), bound=b).collect()
    verdict = lambda b: {(r.page_id < 100, r.verdict) for r in frame(b)}
    assert verdict(ut.BOUND) == {(True, "block"), (False, "allow")}
    assert (True, "block") not in {(r.page_id < 100, r.verdict) for r in frame(0.0) if r.purity > 0.5}


def test_edges(spark):
    pages, labels = spark.createDataFrame([], PAGE), spark.createDataFrame([], LABEL)
    assert ut.url_verdicts(pages, labels).collect() == []
    long = "http://h.com/" + "a/" * 100_000 + "?"
    wide = spark.createDataFrame([(1, long, "x", 1, 2), (2, None, "y", 3, 4)], f"{PAGE}, host string, good int, template int")
    rows = {r.page_id: r for r in ut.url_verdicts(wide, labels).collect()}
    assert rows[1].path == "/" + "a/" * 100_000 and rows[1].template == "*" and rows[1].verdict == rows[2].verdict == "allow"
    assert (rows[2].host, rows[2].path, rows[2].template, rows[2].purity) == ("", "", "", 1.0)
    empty = spark.createDataFrame([(None, None, None)], LABEL)
    assert ut.url_verdicts(wide, empty).count() == 2


def test_no_python_on_the_main_path(spark):
    plan = QUERIES["op11_url_filter"](spark, DATA)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_sql_agrees(spark, duck):  # noqa: F811
    want = duck.sql(SQL["op11_url_filter"]).df()
    assert plain(QUERIES["op11_url_filter"](spark, DATA).toPandas()) == plain(want)
