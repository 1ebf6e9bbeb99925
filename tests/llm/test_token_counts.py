"""Token counts against the unigram tokenizer over the same vocabulary."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from loomspace.llm import token_counts as tc

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "  a", "a\nb", "ΩΩ 梦梦 𝔘𝔫", "<unk>x", "x<unk>", "<unk>Ω", "Ω<unk>Ω", "a" * 500, "<s>hello</s>", "▁▁ a", "\t\t", "😀😀a😀", "<0x41>", "été à la plage", "z" * 40 + "😀" * 30]


def tokenizer(pieces, byte_fallback):
    t = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=byte_fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return t


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_public_vocabulary(byte_fallback):
    pieces = tc.vocabulary(MODEL)
    t, c = tokenizer(pieces, byte_fallback), tc.Counter(pieces, 0, byte_fallback)
    r = random.Random(0)
    texts = TEXTS + ["".join(r.choice("abcdethn  éß\n😀▁梦<>unk") for _ in range(r.randrange(60))) for _ in range(300)]
    for x in texts:
        assert c(x)[1] == len(t.encode(x, add_special_tokens=False).ids), x


def test_ties_of_small_vocabularies():
    r = random.Random(1)
    for _ in range(60):
        names = {"".join(r.choice("ab▁") for _ in range(r.randrange(1, 5))) for _ in range(8)}
        pieces = [("<unk>", 0.0)] + [(p, float(-r.randrange(1, 4))) for p in sorted(names)]
        t, c = tokenizer(pieces, False), tc.Counter(pieces, 0, False)
        for _ in range(20):
            x = "".join(r.choice("aab b") for _ in range(r.randrange(1, 15)))
            assert c(x)[1] == len(t.encode(x, add_special_tokens=False).ids), (x, pieces)


def test_query_on_edge_rows(spark):
    docs = [(1, None, 9), (1, None, 9), (None, "", 9), (2, "the cat " * 20_000, 9)]
    rows = tc.count_tokens(spark.createDataFrame(docs, "doc_id long, text string, n_tokens int"), MODEL).collect()
    t = tokenizer(tc.vocabulary(MODEL), True)
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == [(0, 0), (1, 0), (1, 0), (2, len(t.encode(docs[3][1], add_special_tokens=False).ids))]
    assert tc.count_tokens(spark.createDataFrame([], "doc_id long, text string"), MODEL).collect() == []
