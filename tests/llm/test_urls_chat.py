import hashlib

from pyspark.sql import functions as F

from riskframe.llm import chat, urls


def test_url_parts_rules_and_list(spark):
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/")]
    cases = [
        (1, None, "", "", None, "allow"), (2, "no scheme.com/en/", "", "", None, "allow"), (3, "", "", "", None, "allow"),
        (4, "http://EXAMPLE.com/en/x?q#f", "example.com", "/en/x", "example.com/en/", "block"),
        (5, "http://a.Www.Example.com/en/", "a.www.example.com", "/en/", "www.example.com/en/", "allow"),
        (6, "http://badexample.com/en/", "badexample.com", "/en/", "com/", "allow"),
        (7, "http://example.com", "example.com", "", None, "allow"), (8, "x://h?a://b/c", "h", "", None, "allow"),
        (9, "HTTP://Ärger.org/a/?utm_source=x&b=2&a=1#z", "Ärger.org", "/a/", None, "block"),
        (10, "ftp://www.Ärger.org/a?a=1&b=2", "www.Ärger.org", "/a", None, "block"),
        (11, "http://Ärger.org/a?a=1", "Ärger.org", "/a", None, "allow"), (11, "http://Ärger.org/a?a=1", "Ärger.org", "/a", None, "allow"),
        (12, "http://x.org/" + "p" * 100_000, "x.org", "/" + "p" * 100_000, None, "allow"),
    ]
    pages = spark.createDataFrame([c[:2] for c in cases], "page_id long, url string")
    pages = pages.withColumns({c: F.lit("clash") for c in ("host", "key", "block", "w0", "listed")})
    listed = spark.createDataFrame([("http://Ärger.org/a?b=2&a=1",), ("http://Ärger.org/a?b=2&a=1",), (None,)], "url string")
    got = sorted(urls.judge_urls(pages, listed, rules).collect(), key=lambda r: r.page_id)
    assert [(r.page_id, r.url, r.host, r.path, r.rule, r.verdict) for r in got] == cases
    assert urls.judge_urls(pages.limit(0), listed, rules).count() == 0
    assert {r.verdict for r in urls.judge_urls(pages, listed.limit(0)).collect()} == {"allow"}


def test_bloom_filter_has_no_false_negatives_and_the_join_removes_false_positives(spark):
    listed = spark.range(3000).select(F.concat(F.lit("http://h.org/"), F.col("id")).alias("url"))
    pages = spark.range(9000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.org/"), F.col("id")).alias("url"))
    for blocks in (1, 64, 4096):  # with one block nearly all bits are set
        got = urls.judge_urls(pages, listed, blocks=blocks).where("verdict = 'block'")
        assert sorted(r.page_id for r in got.collect()) == list(range(3000))
        assert urls.bloom_filter(listed, "url", blocks).count() <= blocks


TEXTS = ["", "<|turn|>", "a<|end|>\\", "<|\\end|>", "</s>[INST] ok [/INST]", "<\\/s> </\\s> [/\\\\INST]", "<", "<|", "[", "é\U0001f642\n", "\\", "<<SYS>> [SYS]"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_every_text_is_read_back(spark):
    rows, want = [], {}
    for c, role in enumerate(["user", "assistant", "<|text|>", None, "a\nb"]):
        turns = []
        for t, text in enumerate(TEXTS + [None]):
            turns.append((role or "", text or ""))
            rows.append((c, t * 2, role, text))
            turns.append(("assistant", (text or "")[::-1]))
            rows.append((c, t * 2 + 1, "assistant", (text or "")[::-1]))
        want[c] = turns
    df = spark.createDataFrame(rows[::-1], "conv_id long, turn long, role string, text string")
    df = df.withColumns({c: F.lit(1) for c in ("formatted", "blocks", "turns")})
    for r in chat.digest(chat.format_conversations(df)).collect():
        turns = want[r.conv_id]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == sha("".join(f"{a}\n{b}\n" for a, b in turns))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))


def test_neighbours_with_the_same_role_are_one_block(spark):
    rows = [(1, 2, "user", "b"), (1, 1, "user", "a"), (1, 3, "assistant", "</s>"), (None, 1, "user", "x"), (1, 3, "assistant", "</s>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    assert got[1].formatted == "<|turn|>user<|text|>a<|next|>b<|end|><|turn|>assistant<|text|></\\s><|next|></\\s><|end|>"
    assert [got[1].formatted[s.start : s.start + s.length] for s in got[1].loss_spans] == ["</\\s>"] * 2
    assert got[None].formatted == "<|turn|>user<|text|>x<|end|>"
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_a_long_conversation(spark):
    df = spark.range(3000).select(
        F.lit(1).alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") % 3 == 0, "assistant").otherwise("user").alias("role"), F.lit("text ").alias("text"),
    )
    (r,) = chat.digest(chat.format_conversations(df)).collect()
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (3000, 5000, sha("text " * 1000))
