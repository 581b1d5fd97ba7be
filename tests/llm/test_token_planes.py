import zlib
from array import array

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from metaveil.llm import queries, token_planes
from tests.llm.cases import SF, documents, frame, odd_texts


def whole(text):
    t = Tokenizer.from_file(token_planes.default_tokenizer())
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


def test_words_encode_as_whole_texts(spark):
    encoder = token_planes.Encoder(token_planes.default_tokenizer())
    texts = [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    texts += [t for _, t in odd_texts() if t] + ["a\n b", "a \n\nb", " lead", "trail ", "don't \n'll x", "a.\nB c,\nD", " x  y", "é ño"]
    for text in texts:
        assert encoder.encode(text) == array("I", whole(text)).tobytes()


def test_words_of_a_batch_are_looked_up_once(monkeypatch):
    """Also if fewer are remembered than there are."""
    encoder = token_planes.Encoder(token_planes.default_tokenizer(), cache_words=2, special=True)
    texts = [t for _, t in odd_texts()] + ["", None, " lead", "a  b", "trail ", "AND!! OF!!.\nThe", "x!'s y", "a <|endoftext|> b", "a" * 300 + " b"] + ["one two three, four. five!! one"] * 500
    want = [encoder.encode(t or "") for t in texts]
    made, asked = token_planes.Words.made, []
    monkeypatch.setattr(token_planes.Words, "made", lambda self, word: asked.append(word) or made(self, word))
    assert list(encoder.encode_all(pa.array(texts, pa.string()).slice(3))) == want[3:]
    assert len(list(encoder.encode_all(pa.array(texts, pa.string())))) == len(texts) and list(encoder.encode_all(pa.array([], pa.string()))) == []
    assert len([w for w in asked if w == "five"]) <= 2


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_planes_round_trip(kind):
    for ids in ([], [0], [50256, 0, 1, 255, 256], list(range(3000))):
        ids = np.array(ids, np.uint32)
        assert token_planes.from_planes(token_planes.to_planes(ids, kind), len(ids), kind).tolist() == ids.tolist()


@pytest.mark.parametrize("kind, block", [("byte", 64), ("bit", 1000)])
def test_files_hold_every_id(spark, tmp_path, kind, block):
    docs = documents(spark)
    path = f"file://{tmp_path}/out"
    got = token_planes.encode_and_read(docs, path, kind=kind, block_ids=block).collect()
    order = sorted(odd_texts(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at, want = 0, []
    for doc_id, text in order:
        ids = [*whole(text), 0]
        want.append((doc_id, at, len(ids), zlib.crc32(array("I", ids).tobytes())))
        at += len(ids)
    rows = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=lambda r: r[1])
    assert rows == want
    ids = [i for _, text in order for i in [*whole(text), 0]]
    blocks = token_planes.read_range(spark, path, 100, 500).orderBy("start").collect()
    found = {b.start + k: i for b in blocks for k, i in enumerate(b.ids)}
    assert [found[k] for k in range(100, 600)] == ids[100:600]


def test_queries_give_special_tokens_their_ids(spark, tmp_path):
    library = Tokenizer.from_file(token_planes.default_tokenizer())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x\n <|endoftext|>y  z", "a<|endoftext|>.\n b", "a <|endoftext b"]
    encoder = token_planes.Encoder(token_planes.default_tokenizer(), special=True)
    want = [[*library.encode(text, add_special_tokens=False).ids, 0] for text in texts]
    assert want[0] == [64, 220, 50256, 275, 0]
    assert [array("I", encoder.encode(text)).tolist() + [0] for text in texts] == want
    docs = frame(spark, list(enumerate(texts)))
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    for got in queries.op1_token_planes(spark, f"file://{tmp_path}"), corpus_pipeline.token_output(spark, docs, ""):
        crcs = [r.ids_crc32 for r in got.orderBy("doc_id").collect()]
        assert crcs == [zlib.crc32(array("I", ids).tobytes()) for ids in want]


def test_empty_table(spark):
    assert token_planes.encode_and_read(frame(spark, [])).count() == 0


def test_crc_join():
    a, b = b"some bytes", b"and others" * 7
    assert token_planes.crc32_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
