"""Token ids, spans and round trips."""

import pytest
from pyspark.sql import functions as F

from siltstone.llm import tokens as K

TEXTS = [None, "", " ", "plain words", "<|endoftext|> is text", "𠮷é漢字 👍🏽", "a\n\n\tb\x00\x1f", "x" * 5000, "ZZa2rN14KPF3" * 3000, "ﾅ､‍ 🇩🇪"]


def test_ids(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").withColumn("ids", F.lit(0)).withColumn("i", F.lit(1)).repartition(3)
    got = {r["doc_id"]: r["ids"] for r in K.encode(df).collect()}
    assert set(got) == set(range(len(TEXTS))) and got[0] == got[1] == []
    t = K.tokenizer(K.VOCABULARY)
    for i, text in enumerate(TEXTS):
        assert got[i] == t.encode(text or "", add_special_tokens=False).ids
        assert K.decode(got[i]) == (text or "")
    assert 50256 not in got[4]
    assert {r["doc_id"]: r["n_tokens"] for r in K.sizes(df).collect()} == {i: len(v) for i, v in got.items()}
    assert all(r["same"] for r in K.round_trip(df).collect())
    assert K.encode(df.limit(0)).count() == 0


def test_ids_agree_with_another_library():
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    import public_tokenizers as P

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    t = K.tokenizer(K.VOCABULARY)
    for text in TEXTS[1:]:
        assert t.encode(text, add_special_tokens=False).ids == other.encode_ordinary(text)


def test_spans():
    t = K.tokenizer(K.VOCABULARY)
    for text in TEXTS[1:]:
        ids = t.encode(text, add_special_tokens=False).ids
        first, after, split = K.spans(text, ids)
        table, at = K.token_bytes(K.VOCABULARY), 0
        raw = text.encode()
        where = [i for i, ch in enumerate(text) for _ in ch.encode()]
        for i, a, b, s in zip(ids, first, after, split):
            own = where[at : at + len(table[i])]
            assert (a, b) == (own[0], own[-1] + 1)
            assert s == (at > 0 and where[at - 1] == own[0])
            at += len(table[i])
        assert at == len(raw)
    assert K.spans("漢", t.encode("漢", add_special_tokens=False).ids)[2].any()


def test_alphabet():
    table = K.byte_alphabet()
    assert sorted(table.values()) == list(range(256)) and table["A"] == 65 and table["Ġ"] == 32
