"""Token counts: count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates all vocabulary matches of a pre-token; dynamic programming over end positions
carries the best score and its number of pieces, without the segmentation. Ties go as in the unigram tokenizer: matches
reach an end in order of their start and only a better score replaces, so the longest last piece wins; a character that
is no piece itself costs the lowest score less 10; neighbouring unknown characters fuse, and count as their bytes.

Pre-tokens begin at each space (or U+2581), as with a prepended word mark; equal ones are counted once per batch worker.

Defined results: null or empty text has 0 tokens; texts of any length are counted whole, without spaces as well; repeated
rows each get their own result; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ._shared import id_text

MARK = "▁"
UNKNOWN_PENALTY = 10.0  # fixed value of the unigram tokenizer
CACHE = 300_000  #: pre-tokens remembered by a worker
RESULT = "doc_id long, n_chars long, n_pretokens long, n_tokens long"


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a SentencePiece model file, by id; the unknown piece is 0."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size())]


class Counter:
    """Counts tokens as a unigram tokenizer over ``pieces`` does; piece ``unknown`` is the unknown one."""

    def __init__(self, pieces: list[tuple[str, float]], unknown: int = 0, byte_fallback: bool = True):
        import ahocorasick

        self.matches = ahocorasick.Automaton()
        for i, (p, score) in enumerate(pieces):
            if p:
                self.matches.add_word(p, (len(p), score, i == unknown))
        self.matches.make_automaton()
        self.names = {p for p, _ in pieces}
        self.singles = {p for p in self.names if len(p) == 1}
        self.unknown = pieces[unknown][0]
        self.penalty = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.bytes = byte_fallback and all(f"<0x{b:02X}>" in self.names for b in range(256))
        self.known: dict[str, int] = {}
        self.cut = re.compile(f"{MARK}[^{MARK}]*")

    def run(self, text: str) -> int:
        """Tokens of a fused run of unknown text."""
        return 1 if text in self.names or not self.bytes else len(text.encode())

    def count(self, text: str) -> int:
        """Tokens of one pre-token."""
        n = len(text)
        if self.singles.issuperset(text) and self.unknown not in text:  # nothing unknown; an end's longest match comes first
            best, pieces = [0.0] + [-math.inf] * n, [0] * (n + 1)
            for end, (size, s, _) in self.matches.iter(text):
                at = end + 1 - size
                new = best[at] + s
                if new > best[end + 1]:
                    best[end + 1], pieces[end + 1] = new, pieces[at] + 1
            return pieces[n]
        score, closed, run = [0.0] * (n + 1), [0] * (n + 1), [-1] * (n + 1)  # best score; pieces; start of an open unknown run
        set_ = [True] + [False] * n
        by_end: list[list] = [[] for _ in range(n + 1)]
        for end, match in self.matches.iter(text):
            by_end[end + 1].append(match)
        for e in range(1, n + 1):
            single = False
            for size, s, unk in sorted(by_end[e], key=lambda m: -m[0]):
                single |= size == 1
                self._relax(text, e, e - size, score[e - size] + s, unk, score, closed, run, set_)
            if not single:
                self._relax(text, e, e - 1, score[e - 1] + self.penalty, True, score, closed, run, set_)
        return closed[n] + (self.run(text[run[n] :]) if run[n] >= 0 else 0)

    def _relax(self, text, e, at, new, unk, score, closed, run, set_) -> None:
        if set_[at] and (not set_[e] or new > score[e]):
            score[e], set_[e] = new, True
            if unk:
                closed[e], run[e] = closed[at], run[at] if run[at] >= 0 else at
            else:
                closed[e], run[e] = closed[at] + 1 + (self.run(text[run[at] : at]) if run[at] >= 0 else 0), -1

    def pretokens(self, text: str) -> list[str]:
        text = text.replace(" ", MARK)
        if text and text[0] != MARK:
            text = MARK + text
        return self.cut.findall(text)

    def __call__(self, text: str) -> tuple[int, int]:
        """Pre-tokens and tokens of a text."""
        known, parts, total = self.known, self.pretokens(text), 0
        for p in parts:
            n = known.get(p)
            if n is None:
                n = self.count(p)
                if len(p) < 64:
                    if len(known) >= CACHE:
                        known.clear()
                    known[p] = n
            total += n
        return len(parts), total


def count_tokens(docs: DataFrame, model: str, byte_fallback: bool = True) -> DataFrame:
    """Per document: code points, pre-tokens and tokens under the vocabulary of ``model``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary(model), 0, byte_fallback)
        for batch in batches:
            chars, parts, tokens = [], [], []
            for x in batch.column(1):
                text = x.as_py() or ""
                p, n = counter(text)
                chars.append(len(text)), parts.append(p), tokens.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in (chars, parts, tokens))], names=["doc_id", "n_chars", "n_pretokens", "n_tokens"])

    return id_text(docs).mapInArrow(run, RESULT)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
