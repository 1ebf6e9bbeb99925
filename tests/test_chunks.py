"""Code chunks by a lexer: strings and comments with brackets change nothing."""

import random
import re

import pytest

from loomspace.plans import chunks

TRAPS = {
    "rust": ['"a { b \\" {"', 'r#"}} " }"#', "'{'", "/* { /* } */ { */", "// }}}", "'\\u{7B}'", "b'}'"],
    "c": ['"{ \\" }"', "'{'", "/* { */", "// }"],
    "java": ['"{"', '"""\n } {{\n"""', "/* ( */", "// }"],
    "javascript": ["'}'", "`{\n${'}'}{`", "// {", "/* [ */"],
    "python": ["'{'", '"""(\n[ {"""', "# ((", "'\\'('", "'''\ndef x(:\n'''"],
}


def function(r, language, k, trap):
    """An item, once with a trap and once with letters of the same length in its place."""
    tame = re.sub(r"[^\n]", "x", trap)
    if trap.startswith(("//", "#")):
        tame = trap[:2] + re.sub(r"[^\n]", "x", trap[2:])
    elif trap.startswith("/*"):
        tame = "/*" + re.sub(r"[^\n]", "x", trap[2:-2]) + "*/"
    n = r.randrange(1, 9)
    if language == "python":
        body = lambda x: f"def f{k}(a,\n    b):\n    y = {x}\n" + "".join(f"    if a:\n        y = a + {j}\n    else:\n        y = 0\n" for j in range(n)) + "    return y\n"
    else:
        body = lambda x: f"int f{k}(int a,\n  int b) {{\n  y = {x}\n  ;\n" + "".join(f"  if (a) {{\n    y = a + {j};\n  }}\n" for j in range(n)) + "}\n"
    return body(trap), body(tame)


@pytest.mark.parametrize("language", TRAPS)
def test_traps_change_no_chunk(language):
    for seed in range(60):
        r = random.Random(seed)
        both = [function(r, language, k, r.choice(TRAPS[language])) for k in range(r.randrange(1, 12))]
        wild, tame = ("\n".join(x) for x in zip(*both))
        assert chunks.bare(wild, language).count("\n") == wild.count("\n") and len(chunks.bare(wild, language)) == len(wild)
        assert not re.search(r"[{}()\[\]]", re.sub(r"[{}()\[\]]", "", chunks.bare(wild, language)))
        starts = [a for a, _ in chunks.code_items(wild, language)]
        where, line = [], 0
        for x, _ in both:
            where.append(line)
            line += x.count("\n") + 1
        assert starts == where
        for a, b in chunks.code_chunks(wild, 120, 20, 260, language):
            assert a in where or b - a > 0
    assert chunks.code_chunks("", language=language) == []


@pytest.mark.parametrize("language", ["rust", "c", "python", "go"])
def test_chunks_cover_all_lines_in_order(language):
    r = random.Random(3)
    for _ in range(40):
        source = "\n".join("".join(r.choice("ab{}()'\"#/* \t;@") for _ in range(r.randrange(30))) for _ in range(r.randrange(1, 60)))
        out = chunks.code_chunks(source, 50, 10, 90, language)
        lines = source.split("\n")
        if source.strip():
            assert out[0][0] == 0 and out[-1][1] == len(lines) and all(a[1] == b[0] for a, b in zip(out, out[1:]))


def test_items_keep_their_comments_and_long_ones_are_cut_inside():
    source = "use a;\n\n/// doc\n#[test]\nfn one() {\n  1\n}\n\nimpl T {\n" + "".join(f"  /// {k}\n  fn f{k}() {{\n    {'x + ' * 30}1\n  }}\n" for k in range(6)) + "}\n"
    assert [source.split("\n")[a] for a, _ in chunks.code_items(source, "rust")] == ["use a;", "/// doc", "impl T {"]
    cut = chunks.code_chunks(source, 80, 20, 200, "rust")
    assert len(cut) >= 6 and all(source.split("\n")[a].strip().startswith(("///", "impl", "use")) for a, _ in cut)
    python = "@d\ndef a():\n    '''x\ny'''\n    return [\n1]\n\nclass B:\n    def f(self):\n        pass\n"
    assert [python.split("\n")[a] for a, _ in chunks.code_items(python, "python")] == ["@d", "class B:"]


def test_chunked_code_table(spark):
    rows = [(1, "int a;\nint b;", "c"), (2, None, "python"), (3, "x", "unknown")]
    got = [tuple(r) for r in chunks.chunked_code(spark.createDataFrame(rows, "id long, code string, language string"), "id", "code", "language").collect()]
    assert sorted(got) == [(1, 0, 1, 2, 10), (3, 0, 1, 1, 1)]


def test_a_source_is_read_once(monkeypatch):
    """However many items are cut at whatever depth."""
    seen = []
    kept = chunks.bare
    monkeypatch.setattr(chunks, "bare", lambda *a: seen.append(1) or kept(*a))
    source = "\n".join("f() {\n" + "\n".join(f"g{k}() {{\n  'it' + \"}}\" // {{\n  x({k});\n}}" for k in range(40)) + "\n}" for _ in range(20))
    found = chunks.code_chunks(source, 50, 10, 100, "javascript")
    assert len(seen) == 1 and len(found) > 100
    assert found[0][0] == 0 and all(a[1] == b[0] for a, b in zip(found, found[1:])) and found[-1][1] == source.count("\n") + 1
