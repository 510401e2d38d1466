import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from riskframe.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


ODD = [
    "", " ", "  a  b ", "a\nb\t c", "Ünï   x", "\x00", "\U0001f642 é", "ﬁ", "▁ab", "<s>", "a▁b",
    "�", "\x07", "é", "<0x0A>", "</s> x", "<unk>", "▁", "▁ ▁", "a" * 5000, " " * 700, "ab" * 900, "中文" * 300,
    "\U000103a0\U000103a1 x", "-" * 333, "aaab" * 77, "thethethe" * 99, "\n\n\n\n \n",
]


def test_odd_texts_as_the_library(library):
    for text in ODD:
        ids = pieces.encode(text, PATH)
        assert ids == library.encode(text), repr(text[:40])
        assert pieces.decode(ids, PATH) == library.decode(ids), repr(text[:40])


def test_random_texts_as_the_library(library):
    rng = random.Random(7)
    alphabets = ["ab", "the aner", " ▁a\n", "01.-_=/", "äöüß éè", "abcdefghijklmnopqrstuvwxyzABCDE    .,", "中文字 a\U0001f600͸"]
    texts = ["".join(rng.choice(a) for _ in range(rng.randrange(1, 120))) for a in alphabets for _ in range(300)]
    for text in texts:
        ids = pieces.encode(text, PATH)
        assert ids == library.encode(text), repr(text)
        assert pieces.decode(ids, PATH) == library.decode(ids), repr(text)


def test_every_document_as_the_library(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.encode_documents(docs, PATH, digests=True).collect()}
    for r in docs.select("doc_id", "text").collect():
        ids = library.encode(r.text or "")
        sha = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id] == (len(ids), sha, hashlib.sha256(library.decode(ids).encode()).hexdigest())


def test_rows_and_columns(spark):
    rows = [(1, None), (1, "a b"), (1, "a b"), (None, "x"), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(0) for c in ("ids", "decoded")})
    got = sorted(((r.doc_id or 0), tuple(r.ids), r.decoded) for r in pieces.encode_documents(df, PATH).collect())
    ab = tuple(pieces.encode("a b", PATH))
    assert got == [(0, tuple(pieces.encode("x", PATH)), "x"), (1, (), ""), (1, ab, "a b"), (1, ab, "a b"), (2, (), "")]
    assert pieces.encode_documents(df.limit(0), PATH).count() == 0


def test_a_full_memory_is_emptied(library, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 10)
    encoder = pieces.Encoder(PATH)
    for text in ("a b c d e f g", "a b h i j k l m", "a n o p", "x " * 40 + " ".join(map(str, range(40)))):
        ((ids, decoded),) = encoder.encode_batch([text])
        assert ids.decode() == ",".join(map(str, library.encode(text)))
        assert decoded.decode() == text
