import random
import re

from pyspark.sql import functions as F

from riskframe.llm import lines


def plain(rows, min_words):
    """{(id, text): kept text} by comparing all places pairwise."""
    docs = sorted({(i is None, i or 0, t or "") for i, t in rows}, key=lambda d: d[:2])
    seqs = []
    for d, (_, _, text) in enumerate(docs):
        for pos, line in enumerate(text.split("\n")):
            words = len(re.findall(r"\S+", line))
            if words:
                seqs.append((d, pos, line, words))
    gone = set()
    for later in range(len(seqs)):
        for earlier in range(later):
            k, words = 0, 0
            while later + k < len(seqs) and seqs[later + k][0] == seqs[later][0] and seqs[earlier + k][0] == seqs[earlier][0]:
                if seqs[earlier + k][2] != seqs[later + k][2]:
                    break
                words += seqs[later + k][3]
                k += 1
            if words >= min_words:
                gone |= {(seqs[later + j][0], seqs[later + j][1]) for j in range(k)}
    # A blank line goes where the lines with words on both sides do.
    for a, b in zip(seqs, seqs[1:]):
        if a[0] == b[0] and {(a[0], a[1]), (b[0], b[1])} <= gone:
            gone |= {(a[0], p) for p in range(a[1], b[1])}
    out = {}
    for d, (none, i, text) in enumerate(docs):
        kept = [line for pos, line in enumerate(text.split("\n")) if (d, pos) not in gone]
        out[None if none else i, text] = "\n".join(kept)
    return out


def test_against_all_pairs_of_places(spark):
    rng = random.Random(11)
    pool = ["a b c", "d", "e f", "a b c d e f g h", "", " ", "g", "h i j k"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 14)))) for i in range(60)]
    rows += [(100 + i, "\n".join(["same line here"] * i)) for i in range(1, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for min_words in (4, 9):
        want = plain(rows, min_words)
        got = {(r.doc_id, r.old): r.text for r in lines.delete_repeated_lines(df.withColumn("old", F.col("text")), min_words=min_words).collect()}
        assert got == want


def test_passages_go_and_short_lines_stay(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    split = "\n".join(" ".join(f"q{i}" for i in range(a, a + 13)) for a in range(0, 65, 13))
    rows = [
        (1, f"one\n{passage}\nend"), (2, f"two\nshort line\n{passage}"), (3, f"three\n{split}\n\nlast"), (4, f"{split}\nshort line\nfour"),
        (None, f"zero\n{passage}"), (5, passage), (5, passage), (6, None), (7, ""), (8, "\n\n"), (9, ("w " * 49 + "\n") * 300),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("w1", "lines", "version", "deleted_runs")})
    out = lines.delete_repeated_lines(df)
    assert out.columns == df.columns
    texts = {}
    for r in out.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    assert texts[1] == [f"one\n{passage}\nend"] and texts[2] == ["two\nshort line"]
    assert texts[3] == [f"three\n{split}\n\nlast"] and texts[4] == ["short line\nfour"]
    assert texts[None] == ["zero"] and texts[5] == ["", ""]
    assert texts[6] == [None] and texts[7] == [""] and texts[8] == ["\n\n"]
    assert texts[9] == ["w " * 49 + "\n"]
    assert lines.delete_repeated_lines(df.limit(0)).count() == 0
