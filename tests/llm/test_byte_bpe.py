from pathlib import Path

import pytest

from tidegrid.llm import byte_bpe as B

pytestmark = pytest.mark.skipif(not Path(B.VOCABULARY).exists(), reason="no vocabulary")
TEXTS = ["Hello world", "", None, " ", "\n\n  x", "<|endoftext|>", "ab" * 3000, "\u0000\u200b\ufeff", "深秋时节泽维沙纳的漂流浮标在旧码头下方", "é́́́", "🐋🐋 don't 123456", "ЁЁ ภาษาไทย", "x" * 5000, "aaaa bbbb" * 200]


def test_against_reference_encoders(spark):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = B.read_ranks()
    own = tiktoken.Encoding("own", pat_str=B.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(TEXTS)], "doc_id long, text string, ids int")
    got = {r.doc_id: r.ids for r in B.encode_corpus(df).collect()}
    assert len(got) == len(TEXTS)
    back = {v: k for k, v in ranks.items()}
    for i, t in enumerate(TEXTS):
        assert got[i] == own.encode_ordinary(t or "")
        assert b"".join(back[x] for x in got[i]).decode() == (t or "")


def test_memo_stays_bounded(monkeypatch):
    monkeypatch.setattr(B, "MEMO", 3)
    e = B.Encoder(B.read_ranks())
    a = [e.encode(f"word{i} other thing") for i in range(10)]
    assert len(e.memo) <= 3 and a == [B.Encoder(e.ranks).encode(f"word{i} other thing") for i in range(10)]


def test_empty_table(spark):
    assert B.encode_corpus(spark.createDataFrame([], "doc_id long, text string")).count() == 0
