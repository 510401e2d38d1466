import hashlib
import random
import re
import time

import pytest

from riskframe.llm import personal
from riskframe.llm.queries import QUERIES


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in match.split(".") if len(p) < 4000)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def base(text):
    """The contract: leftmost matches of the four patterns, then their validation."""
    out = []
    for kind, pattern in personal.PATTERNS.items():
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text or "") if valid(kind, m.group())]
    return out


def spans(text):
    return [(personal.KINDS[k], s, e) for k, s, e in personal.find_spans(text)]


def base_spans(text):
    return [s for s in spans(text) if s[0] in personal.PATTERNS]


@pytest.mark.parametrize("alphabet", ["a.@-b", "12.0 ", "0123456789 -", "+1(2). -9", "a@1.+ -é_%:/", "49.-+@ a"])
def test_base_kinds_equal_their_patterns(alphabet):
    rng = random.Random(alphabet)
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.choice([1, 5, 12, 30, 80])))
        assert base_spans(text) == base(text), text


def test_pieces_of_numbers():
    rng = random.Random(1)
    parts = ["4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111", "10.0.0.256", "1.2.3.4", "255.255.255.255.", "+1 (743) 555-3824",
             "a.b@c.d.", "@", " ", "-", ".", "+", "x", "é", "1", "\n", "tel:+49", "(", ")", "0000", "x@y.z@w.v"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 8)))
        assert base_spans(text) == base(text), text


def test_added_spans():
    def found(text):
        return [(k, text[s:e]) for k, s, e in spans(text) if k not in personal.PATTERNS]

    assert found("write to jörg@müller.example now") == [("mailbox", "jörg@müller.example")]
    assert found("a@b.example and joe@example.com") == []
    assert found("see https://joe:pw@host.example:80/x, or https://host.example/@joe") == [("address", "https://joe:pw@host.example:80/x")]
    assert found("mailto:joe@example.com.") == [("address", "mailto:joe@example.com")]
    assert found("IBAN: DE89 3704 0044 0532 0130 00 thanks") == [("account", "DE89 3704 0044 0532 0130 00")]
    assert found("IBAN: DE88 3704 0044 0532 0130 00 thanks") == []
    assert found("Account number 1234-5678, account no. 000000") == [("account", "1234-5678")]
    assert found("Taliban 12345678, xftp://a@b.example, ssnx 1234567") == []
    assert found("jö@mü.de.x@y.com") == []


def test_mask():
    assert personal.masked_text("to a.b@c.example, 10.1.2.3") == "to [EMAIL], [IP]"
    assert personal.masked_text("ftp://joe@c.example/x") == "[ADDRESS]"
    assert personal.masked_text("nothing") == "nothing"
    assert personal.masked_text(None) is None


@pytest.mark.parametrize("part", ["1", "1 ", "1.", "a@", "a@b.", "@", "+1", "mailto:", "http://a@", "iban ", "ssn 1", "1.2.3.4.", "jö@ü.", "é.", "ssh://a:"])
def test_time_is_linear_in_long_texts(part):
    start = time.perf_counter()
    personal.find_spans(part * (600_000 // len(part)))
    assert time.perf_counter() - start < 8


def test_defined_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a@b.c", None), (3, "a@b.c", None), (None, "😀 1.2.3.4", "y"), (5, "x" * 300_000 + " a@b.c", "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, spans string")
    got = [(r.doc_id, [tuple(s) for s in r.spans]) for r in personal.find_personal_data(docs).collect()]
    want = [(1, []), (2, []), (3, [("email", 0, 5)]), (3, [("email", 0, 5)]), (None, [("ip", 2, 9)]), (5, [("email", 300_001, 300_006)])]
    assert sorted(got, key=str) == sorted(want, key=str)
    masked = personal.mask(docs)
    assert masked.columns == docs.columns
    assert sorted([r.text[-8:] for r in masked.collect() if r.text]) == sorted(["[EMAIL]", "[EMAIL]", "😀 [IP]", " [EMAIL]"])
    assert personal.find_personal_data(docs.where("doc_id > 9")).collect() == []


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = QUERIES["op11_personal_data"](spark, sf_dir)
    assert [t for _, t in got.dtypes] == ["bigint"] * 5 + ["string"] * 2
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == len(docs)
    for d in docs:
        want, r = base(d.text), rows[d.doc_id]
        listed = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in want) for k in personal.PATTERNS)
        assert r.spans.startswith(listed)
