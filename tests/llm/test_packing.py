import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskframe.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def ids_of(tokenizer, text):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")


ODD = [
    "", " ", "\n", "a \n<|endoftext|> b", "x<|endoftext|>", "it's  we'll\t\tgo \x1c\x1d   z  　y", "  lead", "trail  ",
    "a" * 3000, "é́ \U0001f642 ½²Ⅳ 12ab", "\r\n\r\n x", "᠎​﻿ mark", "\x85next\x0b\x0c",
]


def test_ids_as_the_library():
    tokenizer = Tokenizer.from_file(PATH)
    rng = random.Random(9)
    alphabets = ["ab ", "a \n\t", " .,'s tdm", "0123 9a", "é\u0301ß中\U0001f642 x", "\u2003\u200b\xa0 \x1c\x85a", "<|endoftext|> "]
    texts = ODD + ["".join(rng.choice(a) for _ in range(rng.randrange(1, 60))) for a in alphabets for _ in range(200)]
    for batch in (texts, texts[::-1]):
        for text, data in zip(batch, packing.load_tokenizer(PATH).encode_batch(batch)):
            assert np.frombuffer(data, "<u4").tolist() == ids_of(tokenizer, text).tolist(), repr(text[:50])


def test_a_full_memory_is_emptied(monkeypatch):
    monkeypatch.setattr(packing.Tokenizer, "LIMIT", 5)
    monkeypatch.setattr(packing.Tokenizer, "LONGEST", 4)
    own, tokenizer = packing.Tokenizer(PATH), Tokenizer.from_file(PATH)
    for batch in (["a b c d"], ["a b longer words", "c"], ["x y z u v w a b"], ["longer a\n\nb"]):
        for text, data in zip(batch, own.encode_batch(batch)):
            assert np.frombuffer(data, "<u4").tolist() == ids_of(tokenizer, text).tolist()


def check_packed(rows, docs):
    """Every id in exactly one piece, sequences gapless from 0 and not too long; returns the share of padding."""
    tokenizer = Tokenizer.from_file(PATH)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(docs)
    for i, text in docs.items():
        ids = ids_of(tokenizer, text)
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = total = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= pieces[0].window <= 2048
        size = at if at & (at - 1) == 0 else 2048
        padding, total = padding + size - at, total + size
    return padding / total


def test_query_on_all_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack(docs, PATH).collect()
    assert check_packed(rows, {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}) < 0.02
    steps = {}
    for s in {(r.sequence_id, r.step, r.window) for r in rows}:
        steps[s[1]] = steps.get(s[1], 0) + s[2]
    assert max(steps.values()) - min(steps.values()) <= 2 * sum(packing.TIERS)


def test_odd_rows(spark):
    docs = dict(enumerate(ODD)) | {100: None}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    df = df.withColumns({c: F.lit(1) for c in ("start", "length", "rank", "slot", "ids")})
    pieces = packing.pack(df, PATH, with_ids=True)
    check_packed(pieces.collect(), docs)
    got = {}
    for s in packing.sequences(pieces).collect():
        at = 0
        for i, n in zip(s.doc_ids, s.lengths):
            got.setdefault(i, []).append(s.ids[at : at + n])
            at += n
    tokenizer = Tokenizer.from_file(PATH)
    assert all(sorted(sum(got[i], [])) == sorted(ids_of(tokenizer, t).tolist()) for i, t in docs.items())
    copies = packing.pack(spark.createDataFrame([(None, "a b")] * 500 + [(7, "x")] * 3, "doc_id long, text string"), PATH).collect()
    places = {(r.sequence_id, r.offset + k) for r in copies for k in range(r.length)}
    assert len(copies) == 503 and len(places) == sum(r.length for r in copies)
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_plan_uses_every_piece():
    rng = np.random.default_rng(4)
    counts = {int(k): int(v) for k, v in zip(*np.unique(rng.integers(1, 2048, 30_000), return_counts=True))}
    counts[2048], counts[1], counts[700] = 500, 20_000, 9_000
    patterns = packing.plan(counts)
    used = {}
    for size, pieces, times in patterns:
        assert sum(pieces) <= size and times > 0
        assert size == 2048 or sum(pieces) == size
        for p in pieces:
            used[p] = used.get(p, 0) + times
    assert used == counts
    assert len(patterns) < 3 * 2048
