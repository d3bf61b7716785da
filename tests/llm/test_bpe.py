"""Pre-tokens of many texts merged side by side give what they give one by one."""

import random

import pandas as pd
from pyspark.sql import functions as F

from foliospark.llm import bpe
from foliospark.llm.common import tokenizer_path


def _pieces(n):
    random.seed(11)
    parts = ["the", " in", "ß", "été", "日本", "=", "--", "aaaa", "\n", " ", "12", "Ω", "q", "zx", "\x00", "\U0001f600"]
    return list({"".join(random.choices(parts, k=random.randrange(1, 12))) for _ in range(n)})


def test_side_by_side_is_one_by_one():
    table = bpe.MergeTable(tokenizer_path())
    data = [p.encode() for p in _pieces(3000)] + [bytes([b]) for b in range(256)]
    assert [list(x) for x in table.encode_side_by_side(data)] == [table.encode_bytes(d) for d in data]


def test_new_pieces_are_not_encoded_one_by_one(monkeypatch):
    table = bpe.MergeTable(tokenizer_path())
    texts = [" ".join(_pieces(2000)), "", "x" * 3 * bpe.CHUNK, "a <|endoftext|> b", " ".join(_pieces(2000))[::-1]]
    want = [[i for part in bpe.encode_parts(t, table, bpe._Remembered(table)) for i in part] for t in texts]
    calls = []
    monkeypatch.setattr(table, "encode_bytes", lambda data, f=table.encode_bytes: calls.append(data) or f(data))
    known = bpe._Remembered(table)
    assert [[i for part in parts for i in part] for parts in bpe.together(texts[:2] + texts[4:], table, known)] == want[:2] + want[4:]
    assert all(len(d) > bpe.SHORT for d in calls)
    assert [[i for part in parts for i in part] for parts in bpe.together(texts, table, known)] == want


def test_forgets_when_full(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 60_000)
    table = bpe.MergeTable(tokenizer_path())
    known, texts = bpe._Remembered(table), [" ".join(_pieces(n)) for n in (300, 400, 3000)]
    got = [[i for part in parts for i in part] for t in texts for parts in bpe.together([t], table, known)]
    assert got == [bpe.encode_text(t) for t in texts]


def test_batches_of_long_and_short_texts(spark):
    docs = pd.DataFrame({"doc_id": range(6), "text": ["a b", None, "w" * 200_000, " ".join(_pieces(1500)), "", "é" * 70_000]})
    rows = {r.doc_id: r for r in bpe.round_trip_digest(spark.createDataFrame(docs).withColumn("text", F.nullif("text", F.lit("None")))).collect()}
    assert len(rows) == 6 and all(r.exact for r in rows.values()) and rows[1].n_tokens == rows[4].n_tokens == 0
