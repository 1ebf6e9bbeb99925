"""Text and code chunkers, as table functions and Arrow batches."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame

SENTENCE_END = (".", "!", "?")


def text_chunks(text: str, size: int = 200, overlap: int = 50) -> list[tuple[int, int]]:
    """Word ranges of chunks; a chunk ends at the last sentence end of its last fifth, if there is one."""
    words, out, at = text.split(), [], 0
    while at < len(words):
        end = min(at + size, len(words))
        if end < len(words):
            ends = [k + 1 for k in range(at + size * 4 // 5, end) if words[k].endswith(SENTENCE_END)]
            end = ends[-1] if ends else end
        out.append((at, end))
        if end == len(words):
            break
        at = max(at + 1, end - overlap)
    return out


#: by language: line comment, opening and closing of a block comment, whether those nest, quotes of strings that end with their line, and
#: quotes of those that may span lines, longer ones first
LANGUAGES = {
    "rust": ("//", "/*", "*/", True, (), ('"',)),
    "c": ("//", "/*", "*/", False, ('"', "'"), ()),
    "java": ("//", "/*", "*/", False, ('"', "'"), ('"""',)),
    "javascript": ("//", "/*", "*/", False, ('"', "'"), ("`",)),
    "go": ("//", "/*", "*/", False, ('"', "'"), ("`",)),
    "python": ("#", None, None, False, ('"', "'"), ('"""', "'''")),
}
LANGUAGES |= {"cpp": LANGUAGES["c"], "typescript": LANGUAGES["javascript"]}
_RAW = re.compile(r'b?r(#*)"')
_CHARACTER = re.compile(r"'(\\(?:x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]+\}|.)|[^\\'\n])'")


def bare(source: str, language: str = "c") -> str:
    """The source with strings, character literals and comments blanked, line breaks kept, so that what is left are names and brackets."""
    line, opening, closing, nests, short, long = LANGUAGES[language]
    out, at, n = [], 0, len(source)
    firsts = _any({line[0], *(opening or "")[:1], *(q[0] for q in (*short, *long)), *("br'" if language == "rust" else "")})

    def blank(end: int) -> None:
        nonlocal at
        out.append(re.sub(r"[^\n]", " ", source[at:end]))
        at = end

    while at < n:
        c = source[at]
        if source.startswith(line, at):
            end = source.find("\n", at)
            blank(n if end < 0 else end)
        elif opening and source.startswith(opening, at):
            depth, end = 1, at + len(opening)
            while depth and end < n:
                end = _next(_any({opening[0], closing[0]}), source, end)
                if nests and source.startswith(opening, end):
                    depth, end = depth + 1, end + len(opening)
                elif source.startswith(closing, end):
                    depth, end = depth - 1, end + len(closing)
                else:
                    end += 1
            blank(end)
        elif language == "rust" and c in "br" and (raw := _RAW.match(source, at)) and not (at and (source[at - 1].isalnum() or source[at - 1] == "_")):
            end = source.find('"' + raw[1], raw.end())
            blank(n if end < 0 else end + 1 + len(raw[1]))
        elif language == "rust" and c == "'":
            own = _CHARACTER.match(source, at)  # else a lifetime
            blank(own.end()) if own else (out.append(c), at := at + 1)
        elif quote := next((q for q in (*long, *short) if source.startswith(q, at)), None):
            end = at + len(quote)
            stops = _any({"\\", quote[0], *("\n" if quote in short else "")})
            while (end := _next(stops, source, end)) < n and not source.startswith(quote, end) and not (quote in short and source[end] == "\n"):
                end += 2 if source[end] == "\\" else 1
            blank(min(n, end + (len(quote) if source.startswith(quote, end) else 0)))
        else:
            end = _next(firsts, source, at + 1)
            out.append(source[at:end])
            at = end
    return "".join(out)


@cache
def _pattern(characters: frozenset[str]) -> re.Pattern:
    return re.compile("[" + re.escape("".join(sorted(characters))) + "]")


def _any(characters: set[str]) -> re.Pattern:
    return _pattern(frozenset(characters))


def _next(pattern: re.Pattern, source: str, at: int) -> int:
    """Where the next of the characters is, or the end."""
    found = pattern.search(source, at)
    return found.start() if found else len(source)


def code_items(source: str, language: str = "c", inside: int = 0, plain: str | None = None) -> list[tuple[int, int]]:
    """Line ranges of the items at ``inside`` brackets' depth, together all lines. An item begins at a line that opens at that depth,
    for Python at its indent too, and goes on to the line before the next one; blank lines and closing brackets belong to the
    item above, comments and decorators to the one below."""
    plain, lines = (bare(source, language) if plain is None else plain).split("\n"), source.split("\n")
    starts, depth, fresh, lead = [], 0, True, None
    for k, text in enumerate(plain):
        code = text.strip()
        opens = depth <= inside and code and code[0] not in ")]}"
        if language == "python":
            opens = depth == 0 and code and len(text) - len(text.lstrip()) <= 4 * inside and not re.match(r"(else|elif|except|finally)\b", code)
        noted = depth <= inside and not code and lines[k].strip() and lines[k].strip().startswith((LANGUAGES[language][0], LANGUAGES[language][1] or "\0"))
        mark = opens and ((code[0] == "@" and language in ("python", "java", "typescript")) or (language == "rust" and code.startswith("#[")))
        if noted or mark:
            lead = k if lead is None else lead
        elif opens and fresh:
            starts.append(k if lead is None else lead)
            lead = None
        elif code:
            lead = None
        depth += sum(code.count(c) for c in "([{") - sum(code.count(c) for c in ")]}")
        if code and not mark:  # an item of several lines goes on until it is closed
            fresh = True if language == "python" else depth <= inside and (code[-1] in "};")
    starts = sorted({0, *starts}) if lines else []
    return [(a, b) for a, b in zip(starts, [*starts[1:], len(lines)])]


def within(items: list[tuple[int, int]], start: int, end: int) -> list[tuple[int, int]]:
    """Those of consecutive line ranges that meet start to end."""
    return items[bisect_right(items, start, key=lambda x: x[1]) : bisect_left(items, end, key=lambda x: x[0])]


def code_chunks(source: str, target: int = 500, least: int = 100, most: int = 1000, language: str = "c") -> list[tuple[int, int]]:
    """Line ranges of code: whole items joined up to ``target`` characters that are no spaces. An item of more than ``most`` is cut at the
    items inside it, and where there are none at ``most``; a last chunk of fewer than ``least`` joins the one before."""
    lines = source.split("\n")
    size = [len("".join(x.split())) for x in lines]
    plain = cache(lambda: bare(source, language))
    items = cache(lambda inside: code_items(source, language, inside, plain()))  # once a depth, however many items are cut there

    def cut(start: int, end: int, inside: int) -> list[tuple[int, int]]:
        if sum(size[start:end]) <= most:
            return [(start, end)]
        own = [(max(a, start), min(b, end)) for a, b in within(items(inside), start, end)] if inside < 4 else []
        if len(own) > 1:
            return [x for a, b in own for x in cut(a, b, inside + 1)]
        if inside < 4:
            return cut(start, end, inside + 1)
        out, at, held = [], start, 0
        for k in range(start, end):
            if held and held + size[k] > most:
                out.append((at, k))
                at, held = k, 0
            held += size[k]
        return [*out, (at, end)]

    out, held = [], 0
    for a, b in cut(0, len(lines), 0):
        own = sum(size[a:b])
        if out and (held + own <= target or not own):
            out[-1] = (out[-1][0], b)
            held += own
        else:
            out.append((a, b))
            held = own
    if len(out) > 1 and held < least:
        out[-2:] = [(out[-2][0], out[-1][1])]
    return out if sum(size) else []


def chunked_code(files: DataFrame, key: str, text: str, language: str, target: int = 500, least: int = 100, most: int = 1000) -> DataFrame:
    """(key, chunk, line_start, line_end, characters) of source files; lines count from 1, both ends in it. ``language`` is a column of
    names; unknown ones are taken as C."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, x, kind in zip(b[key], b[text], b[language]):
                x = x or ""
                lines = x.split("\n")
                for n, (s, e) in enumerate(code_chunks(x, target, least, most, kind if kind in LANGUAGES else "c")):
                    rows.append((i, n, s + 1, e, sum(len("".join(y.split())) for y in lines[s:e])))
            yield pd.DataFrame(rows, columns=[key, "chunk", "line_start", "line_end", "characters"])

    return files.select(key, text, language).mapInPandas(run, f"{key} long, chunk long, line_start long, line_end long, characters long")


def chunked(docs: DataFrame, key: str, text: str, size: int = 200, overlap: int = 50) -> DataFrame:
    """(key, chunk, start_word, end_word, words)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, n, s, e, e - s) for i, x in zip(b[key], b[text]) for n, (s, e) in enumerate(text_chunks(x or "", size, overlap))]
            yield pd.DataFrame(rows, columns=[key, "chunk", "start_word", "end_word", "words"])

    return docs.select(key, text).mapInPandas(run, f"{key} long, chunk long, start_word long, end_word long, words long")


def register_udtf(spark) -> None:
    """SQL table function text_chunks(text) -> chunk, start_word, end_word."""
    from pyspark.sql.functions import udtf

    class Chunks:
        def eval(self, text: str):
            for n, (s, e) in enumerate(text_chunks(text or "")):
                yield n, s, e

    spark.udtf.register("text_chunks", udtf(Chunks, returnType="chunk int, start_word int, end_word int"))
