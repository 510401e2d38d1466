"""Secrets in texts: candidates, and a random forest that removes false positives.

A candidate is a run of 16 or more key-like characters, or a value of six or more
that follows a secret-like name and '=' or ':', quoted or up to white space or a
double quote. It is described by its
length, its characters and their transitions (under counts from the corpus), how
much of it is covered by words that several documents use, the path of its
document and the words around it. The forest learns from labelled findings: given
ones, values planted into the documents' own texts (``planted``), or else findings
that plain rules are sure about.
DataFrame functions and the forest of ``pyspark.ml`` only.

Defined cases: null, empty and blank texts have no candidates; a null path is an
empty one; rows with equal id and text are one document; without labels of both
kinds every finding's score is its own label, or else its rule label, or else 0; an empty table
gives an empty result; other columns are ignored, or carried along by ``redact``.
"""

from __future__ import annotations

import json
import math

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.store import keep, sized

#: One or two '=' at the end are padding unless a value follows.
CANDIDATE = r"[A-Za-z0-9][A-Za-z0-9+/_.\-]{14,}[A-Za-z0-9_\-](?:={1,2}(?!=?[\"'`]?[A-Za-z0-9+/_.\-]))?"
#: Characters of context on each side, other candidates included.
CONTEXT = 40
#: Candidates with the gaps between them that CONTEXT characters can span, at most.
SPANNED = 6
#: Candidates of a text whose places are summed up together.
CHUNK = 128
#: Documents that must use a word for it to count as one.
WORD_DOCS = 3
#: Labelled findings used for fitting, at most, of each kind.
TRAIN_ROWS = 10_000
#: Share of a value without digits that is common words, from which it is text and no secret.
WORDS_COVER = 0.7
THRESHOLD = 0.5
TREES, DEPTH, SEED = 20, 6, 2

# Names that announce a secret, and marks of values that are none.
NAMES = "token|secret|passwd|password|pwd|key|apikey|auth|bearer|credential|credentials"
PLACEHOLDERS = "example|sample|dummy|placeholder|changeme|your|xxxx|0000000|1234567"
TEST_PATHS = "test|example|sample|mock|fixture|doc"
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789"

#: Documents that lend text to planted values, at most; values planted into each; characters of text around them.
PLANT_DOCS, PLANTS, PIECE = 1_500, 8, 120
# What stands before and after planted secrets, digests and plain values, and values that are none.
SECRET_CONTEXTS = [
    ('token = "', '"'), ("api_key: ", "\n"), ('"password": "', '"'), ("export SECRET_KEY=", "\n"), ("Authorization: Bearer ", "\n"),
    ("auth_token='", "'"), ("credentials: ", " "), ("client secret = `", "`"), ("PASSWD=", " "), ('TOKEN = "', '"'), ("access key => ", "\n"),
]
HASH_CONTEXTS = [
    ("commit ", " "), ("sha1: ", " "), ('checksum = "', '"'), ("request id: ", " "), ("parent ", " "), ("md5=", " "), ('etag: "', '"'),
    ("build: ", " "), ("merged in ", "."), ("cache key: ", " "), ("revision = ", "\n"),
]
PLAIN_CONTEXTS = [
    ("", " "), ("see ", " "), ("value: ", " "), ("order ", " "), ("from ", ", "), ("key = ", " "), ("the ", "."), ("name = '", "'"), ("", "\n"), ("mail ", " "),
]
PLACEHOLDER_VALUES = ["your-api-key-here", "xxxxxxxxxxxxxxxx", "changeme1234567890", "example-token-value", "required", "<insert-your-token>"]

# The value after a name and a sign, with up to 20 blanks on each side of the sign. The
# first two lookbehinds are cheap and rule out nearly every place.
_SIGN = r"(?::=|=>|={1,3}|:)[ \t]{0,20}"
_NAMED = rf"""(?i:{NAMES})["'`\]]{{0,2}}[ \t]{{0,20}}{_SIGN}"""
ASSIGNED = (
    r"""(?<=[=:> \t"'`])(?<=[=:>][ \t]{0,20}["'`]?)(?:"""
    + "|".join(rf"(?<={_NAMED}{q})[^{q}\s][^{q}\r\n]{{5,}}(?={q})" for q in "\"'`")
    + rf"""|(?<={_NAMED})[^\s"'`=:>][^\s"`]{{4,}}[^\s"'`])"""
)
#: What is looked for; an assigned value goes before what it holds.
FORM = rf"{ASSIGNED}|{CANDIDATE}"

REPLACEMENT = "[SECRET]"


def _with_starts(found: DataFrame) -> DataFrame:
    """Where each of ``values`` starts between its ``gaps``: running sums within chunks, then over chunks.

    An array that grows by one is copied each time, so a long text's are kept short.
    """
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("list"))

    def add(acc: Column, step: Column) -> Column:
        return F.struct((acc["at"] + step).alias("at"), F.concat(acc["list"], F.array(acc["at"])).alias("list"))

    before = F.transform(F.slice("gaps", F.lit(1), F.size("values")), F.length)
    steps = F.zip_with("gap", "values", lambda g, v: g + F.length(v))
    every = F.sequence(F.lit(0), F.floor((F.size("step") - 1) / CHUNK).cast("int"))
    chunks = F.transform(every, lambda c: F.aggregate(F.slice("step", c * CHUNK + 1, F.lit(CHUNK)), empty, add))
    bases = F.aggregate(F.transform("chunk", lambda c: c["at"]), empty, add, lambda a: a["list"])
    moved = F.flatten(F.zip_with("chunk", "base", lambda c, b: F.transform(c["list"], lambda x: x + b)))
    placed = found.withColumn("gap", before).withColumn("step", steps).withColumn("chunk", chunks).withColumn("base", bases)
    return placed.withColumn("starts", F.zip_with(moved, "gap", lambda a, g: a + g)).drop("gap", "step", "chunk", "base")


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = "source") -> DataFrame:
    """One row per candidate: doc_id, version (hash of id and text), path, start, number in the text, value, before, after."""
    place = F.col(path).cast("string") if path and path in docs.columns else F.lit(None).cast("string")
    source = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.coalesce(place, F.lit("")).alias("path")
    )
    found = source.where(F.col("text").rlike(FORM)).select(
        "doc_id",
        F.xxhash64("doc_id", "text").alias("version"),
        "path",
        F.regexp_extract_all("text", F.lit(FORM), F.lit(0)).alias("values"),
        F.split("text", FORM, -1).alias("gaps"),
    )

    pairs = F.arrays_zip(F.slice("gaps", F.lit(1), F.size("values")).alias("gaps"), F.col("values"))
    # The text before each candidate is its gap and the ends of the pairs before it; the text after it likewise.
    ends = F.transform(pairs, lambda p: F.right(F.concat(p["gaps"], p["values"]), F.lit(CONTEXT)))
    heads = F.transform(
        F.arrays_zip(F.col("values"), F.slice("gaps", F.lit(2), F.size("values")).alias("gaps")),
        lambda p: F.left(F.concat(p["values"], p["gaps"]), F.lit(CONTEXT)),
    )

    def described(value: Column, i: Column) -> Column:
        first = F.greatest(i - SPANNED, F.lit(0))
        before = F.concat(F.array_join(F.slice("ends", first + 1, i - first), ""), F.get("gaps", i))
        after = F.concat(F.get("gaps", i + 1), F.array_join(F.slice("heads", i + 2, F.lit(SPANNED)), ""))
        return F.struct(
            F.get("starts", i).alias("start"), i.alias("number"), value.alias("value"),
            F.right(before, F.lit(CONTEXT)).alias("before"), F.left(after, F.lit(CONTEXT)).alias("after"),
        )

    return _with_starts(found).withColumns({"ends": ends, "heads": heads}).select(
        "doc_id", "version", "path", F.inline(F.transform("values", described))
    )


def dictionary(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, docs): lower-case ASCII words of three letters or more that WORD_DOCS documents use."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text).cast("string")), F.lit("[a-z]{3,}"), F.lit(0)))
    return docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("docs")).where(F.col("docs") >= WORD_DOCS)


def transition_costs(words: DataFrame) -> list[float]:
    """Minus log probability of each character after each other one, from the dictionary; 37 x 37 numbers."""
    n = len(ALPHABET) + 1
    pairs = words.select("docs", "word", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("i"))
    code = F.instr(F.lit(ALPHABET), F.col("pair").substr(1, 1)) * n
    counted = (
        pairs.select("docs", F.col("word").substr(F.col("i"), F.lit(2)).alias("pair"))
        .groupBy("pair").agg(F.sum("docs").alias("docs"))
        .select(code.alias("first"), F.col("pair"), "docs").collect()
    )
    counts = [[1.0] * n for _ in range(n)]
    for r in counted:
        counts[r["first"] // n][ALPHABET.find(r["pair"][1]) + 1] += r["docs"]
    return [-math.log(c / sum(row)) for row in counts for c in row]


def _transition_cost(value: Column, costs: list[float]) -> Column:
    """The mean cost of the value's character pairs."""
    table = F.from_json(F.lit(json.dumps(costs)), "array<double>")
    letters = F.transform(F.split(F.lower(value), ""), lambda c: F.instr(F.lit(ALPHABET), c))
    # split() with an empty pattern gives single characters; instr is 0 for all others.
    pairs = F.zip_with(
        F.slice(letters, F.lit(1), F.length(value) - 1),
        F.slice(letters, F.lit(2), F.length(value) - 1),
        lambda a, b: F.get(table, a * (len(ALPHABET) + 1) + b),
    )
    return F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.length(value) - 1, F.lit(1))


FEATURES = [
    "length", "digits", "uppers", "distinct", "longest_letters", "class_changes", "transition_cost", "coverage",
    "path_depth", "path_is_test", "path_slot", "named", "assigned", "quoted", "address", "placeholder", "word_before", "word_after",
]


def features(found: DataFrame, words: DataFrame, costs: list[float]) -> DataFrame:
    """``found`` with one double per feature."""
    keys = ["doc_id", "version", "start"]
    value = F.col("value")
    parts = found.select(*keys, F.explode(F.regexp_extract_all(F.lower(value), F.lit("[a-z]{3,}"), F.lit(0))).alias("word"))
    # No null-safe join is needed: keys are hashed with the id inside.
    place = F.xxhash64(*keys)
    covered = (
        parts.select(place.alias("place"), "word").join(words.select("word"), "word")
        .groupBy("place").agg(F.sum(F.length("word")).alias("covered"))
    )
    before, after = F.col("before"), F.col("after")
    lowered = F.lower(before)
    count = lambda pattern: F.regexp_count(value, F.lit(pattern))
    share = lambda pattern: count(pattern) / F.length(value)
    letter_runs = F.transform(F.split(value, "[^A-Za-z]+"), F.length)
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(16)).cast("double")
    made = {
        "length": F.length(value).cast("double"),
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / F.length(value),
        "longest_letters": F.array_max(letter_runs) / F.length(value),
        "class_changes": share("(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"),
        "transition_cost": _transition_cost(value, costs),
        "coverage": F.coalesce("covered", F.lit(0)) / F.length(value),
        "path_depth": F.size(F.split("path", "/")).cast("double"),
        "path_is_test": flag(F.lower("path").rlike(TEST_PATHS)),
        "path_slot": slot(F.col("path")),
        "named": flag(lowered.rlike(rf"(^|[^a-z])[a-z_]*({NAMES})\W*$")),
        "assigned": flag(before.rlike(r"""[=:]\s*["']?$""")),
        "quoted": flag(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")),
        "address": flag(before.endswith("@") | value.rlike(r"^[A-Za-z0-9\-]+(\.[A-Za-z0-9\-]+)+$")),
        "placeholder": flag(F.lower(F.concat(F.right(before, F.lit(16)), value)).rlike(PLACEHOLDERS)),
        "word_before": slot(F.regexp_extract(lowered, r"([a-z]+)[^a-z]*$", 1)),
        "word_after": slot(F.regexp_extract(F.lower(after), r"^[^a-z]*([a-z]+)", 1)),
    }
    joined = found.withColumn("place", place).join(covered, "place", "left")
    return joined.withColumns({k: v.cast("double") for k, v in made.items()}).drop("place", "covered")


def rule_label() -> Column:
    """1 or 0 for findings that plain rules are sure about, else null."""
    value = F.col("value")
    plain = value.rlike("^[0-9]+$") | value.rlike("^[A-Za-z]+$")
    given = (F.col("named") == 1) & (F.col("assigned") == 1)
    # A short value of digits only can be a number or a PIN: the forest decides.
    sure = value.rlike("[0-9]") & ((F.length(value) >= 16) | value.rlike("[^0-9.,]"))
    words = ~value.rlike("[0-9]") & (F.col("coverage") >= WORDS_COVER)
    return (
        F.when(given & (F.col("placeholder") == 0) & sure, 1)
        .when(given & words, 0)
        .when((F.col("assigned") == 0) & (plain | (F.col("address") == 1)), 0)
    )


def _labelled(rows: DataFrame, train_rows: int) -> tuple[DataFrame, int]:
    """At most ``train_rows`` findings of each label, those with the smallest hashes, and how many labels there are."""
    order = [F.xxhash64("value", "doc_id", "version", "start"), "start"]
    chosen = [rows.where(F.col("__label") == y).orderBy(*order).limit(train_rows) for y in (0, 1)]
    train = keep(chosen[0].union(chosen[1]).select("__label", *FEATURES), "labelled")
    return train, train.select("__label").distinct().count()


def score_findings(
    described: DataFrame, label: Column | None = None, train_rows: int = TRAIN_ROWS, labelled: DataFrame | None = None
) -> DataFrame:
    """``described`` with ``score``, the forest's probability of a secret.

    The forest is fitted on at most ``train_rows`` labelled findings of each kind: those
    of ``described`` that ``label`` (or else the plain rules) is sure about, or the rows
    of ``labelled``, described findings with the column ``__label``.
    """
    described = keep(described.withColumn("__label", (rule_label() if label is None else label).cast("int")), "findings")
    columns = [c for c in described.columns if c != "__label"]
    train, kinds = _labelled(described if labelled is None else labelled, train_rows)
    if kinds < 2:
        # Nothing to tell apart: a finding is not decided by the kind of the others.
        return described.select(*columns, F.coalesce("__label", rule_label(), F.lit(0)).cast("double").alias("score"))
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="__features")
    forest = RandomForestClassifier(
        labelCol="__label", featuresCol="__features", probabilityCol="__probability", rawPredictionCol="__raw",
        predictionCol="__prediction", numTrees=TREES, maxDepth=DEPTH, seed=SEED,
    ).fit(assembler.transform(train))
    scored = forest.transform(assembler.transform(described))
    return scored.select(*columns, F.round(F.get(vector_to_array("__probability"), F.lit(1)), 6).alias("score"))


def plant(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = "source") -> DataFrame:
    """Texts with one planted value each: doc_id, text, source, at, planted, secret (1 or 0).

    At most PLANT_DOCS documents, those with the smallest hashes, lend a piece of their
    text; PLANTS values go into each. What a value is follows from where it came from: it was
    made as a secret, or as a commit, checksum, id, number, name, host, path or
    placeholder, some of these behind a name like a secret's. All of it follows from hashes.
    """
    old = F.col(text).cast("string")
    place = F.col(path).cast("string") if path and path in docs.columns else F.lit(None).cast("string")
    at = F.pmod(F.xxhash64(F.col(doc_id), F.lit("plant")), F.greatest(F.length(old) - PIECE, F.lit(1))).cast("int")
    lenders = (
        docs.where(old.rlike(r"\S"))
        .select(F.xxhash64(F.col(doc_id)).alias("h"), F.substr(old, at + 1, F.lit(PIECE)).alias("piece"), F.coalesce(place, F.lit("")).alias("source"))
        .orderBy("h", "piece", "source").limit(PLANT_DOCS)
    )
    drawn = lenders.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(PLANTS - 1))))
    drawn = drawn.withColumn("r", F.sha2(F.concat_ws(":", "h", "piece", "i"), 256))
    drawn = drawn.withColumn("b", F.regexp_replace(F.base64(F.unhex("r")), "=", ""))
    drawn = drawn.withColumns(
        {
            "alnum": F.regexp_replace("b", "[+/]", "x"),
            "digits": F.translate("r", "abcdef", "123456"),
            "letters": F.translate("r", "0123456789", "ghijklmnop"),
            # The text's own letters: long words as its language makes them.
            "prose": F.regexp_replace("piece", "[^A-Za-z]", ""),
            "any": 16 + F.pmod(F.conv(F.substr("r", F.lit(53), F.lit(4)), 16, 10).cast("int"), F.lit(24)),
        }
    )
    part = lambda c, first, n: F.substr(F.col(c), F.lit(first), F.lit(n))
    upto = lambda c: F.substr(F.col(c), F.lit(1), F.col("any"))
    pick = lambda options, first: F.get(
        F.array(*options), F.pmod(F.conv(part("r", first, 4), 16, 10).cast("int"), F.lit(len(options)))
    )
    made = [
        part("r", 1, 40), F.upper(part("r", 1, 40)), part("b", 1, 40), F.concat(F.lit("ghp_"), part("alnum", 1, 36)), upto("r"), upto("alnum"), upto("b"),
        F.concat(F.lit("AKIA"), F.upper(part("alnum", 1, 16))), F.concat_ws(".", part("alnum", 1, 18), part("alnum", 9, 24), part("alnum", 17, 27)),
        F.concat(part("alnum", 1, 7), F.lit("-"), part("digits", 1, 4), F.lit("!")), F.concat(part("b", 1, 9), F.lit("~$")),
    ]
    hashes = [
        part("r", 1, 40), part("r", 1, 32), upto("r"), part("r", 1, 64), F.upper(part("r", 1, 40)),
        F.concat_ws("-", part("r", 1, 8), part("r", 9, 4), part("r", 13, 4), part("r", 17, 4), part("r", 21, 12)),
    ]
    plain = [
        part("digits", 1, 16), part("digits", 1, 19), part("letters", 1, 18), upto("prose"), F.upper(upto("prose")), F.initcap(upto("prose")), F.concat(part("letters", 1, 6), F.lit("."), part("letters", 7, 8), F.lit(".example.com")),
        F.concat(F.lit("src/"), part("letters", 1, 6), F.lit("/"), part("letters", 7, 7), F.lit(".py")),
        F.concat_ws("_", part("letters", 1, 5), part("letters", 6, 6), part("letters", 12, 5)), F.concat(F.lit("v2."), part("digits", 1, 2), F.lit(".0-beta.2024"), part("digits", 3, 4)),
    ]
    empty = [F.lit(v) for v in PLACEHOLDER_VALUES]
    pair = lambda pairs: [F.struct(F.lit(a).alias("lead"), F.lit(b).alias("tail")) for a, b in pairs]
    kind = F.pmod(F.conv(part("r", 61, 4), 16, 10).cast("int"), F.lit(10))
    value = F.when(kind < 5, pick(made, 41)).when(kind < 7, pick(hashes, 41)).when(kind < 9, pick(plain, 41)).otherwise(pick(empty, 41))
    around = (
        F.when(kind < 5, pick(pair(SECRET_CONTEXTS), 45)).when(kind < 7, pick(pair(HASH_CONTEXTS), 45))
        .when(kind < 9, pick(pair(PLAIN_CONTEXTS), 45)).otherwise(pick(pair(SECRET_CONTEXTS), 45))
    )
    told = drawn.select("source", "piece", "i", "h", value.alias("planted"), around.alias("c"), F.when(kind < 5, 1).otherwise(0).alias("secret"))
    lead = F.concat(F.substr("piece", F.lit(1), F.lit(PIECE // 2)), F.lit(" "), F.col("c.lead"))
    whole = F.concat(lead, F.col("planted"), F.col("c.tail"), F.lit(" "), F.substr("piece", F.lit(PIECE // 2 + 1), F.lit(PIECE)))
    return told.select(F.xxhash64("h", "i", "planted").alias("doc_id"), whole.alias("text"), "source", F.length(lead).alias("at"), "planted", "secret")


def held_out(value: Column) -> Column:
    """Planted values that are never learned from, a fifth of all, chosen by the value alone."""
    return F.pmod(F.xxhash64(value), F.lit(5)) == 0


def planted_findings(
    docs: DataFrame, words: DataFrame, costs: list[float], doc_id: str = "doc_id", text: str = "text", path: str | None = "source"
) -> DataFrame:
    """Described candidates that lie over planted values, with ``__label`` and ``held_out``."""
    planted = keep(plant(docs, doc_id, text, path), "planted")
    found = features(keep(candidates(planted), "candidates"), words, costs)
    # As many rows as planted values.
    truth = F.broadcast(planted.select("doc_id", "at", "planted", "secret").distinct())
    over = (F.col("start") < F.col("at") + F.length("planted")) & (F.col("start") + F.length("value") > F.col("at"))
    labelled = found.join(truth, "doc_id").where(over)
    return labelled.withColumns({"__label": F.col("secret"), "held_out": held_out(F.col("planted"))}).drop("at", "planted", "secret")


def find_secrets(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    path: str | None = "source",
    threshold: float = THRESHOLD,
    planted: bool = False,
) -> DataFrame:
    """All candidates with their features, ``score`` and ``is_secret``.

    ``planted``: the forest learns from values planted into the documents' own texts,
    whose labels are known from their making, instead of from plain rules.
    """
    words = keep(dictionary(docs, text), "dictionary")
    costs = transition_costs(words)
    found = keep(candidates(docs, doc_id, text, path), "candidates")
    labelled = None
    if planted:
        labelled = keep(planted_findings(docs, words, costs, doc_id, text, path).where(~F.col("held_out")), "learned")
    scored = score_findings(features(found, words, costs), labelled=labelled)
    return scored.withColumn("is_secret", F.col("score") >= threshold)


def held_out_quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = "source") -> DataFrame:
    """(judge, tp, fp, fn, tn) on the planted values that are kept from training, for the forest and for the rules."""
    words = keep(dictionary(docs, text), "dictionary")
    described = keep(planted_findings(docs, words, transition_costs(words), doc_id, text, path), "described")
    learned, kept = described.where(~F.col("held_out")), described.where("held_out")
    truth = kept.select("doc_id", "version", "start", F.col("__label").alias("truth"))
    scored = score_findings(kept.drop("__label", "held_out"), labelled=learned).withColumn("rules", F.coalesce(rule_label(), F.lit(0)))
    judged = scored.join(truth, ["doc_id", "version", "start"]).select(
        "truth", F.inline(F.array(
            F.struct(F.lit("forest").alias("judge"), (F.col("score") >= THRESHOLD).alias("yes")),
            F.struct(F.lit("rules").alias("judge"), (F.col("rules") == 1).alias("yes")),
        ))
    )
    count = lambda truth, yes: F.count_if((F.col("truth") == truth) & (F.col("yes") == F.lit(yes)))
    return judged.groupBy("judge").agg(
        count(1, True).alias("tp"), count(0, True).alias("fp"), count(1, False).alias("fn"), count(0, False).alias("tn")
    )


def redact(docs: DataFrame, findings: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every secret of ``findings`` replaced in ``text``; all rows stay."""
    found = (
        findings.where("is_secret").groupBy("doc_id", "version").agg(F.sort_array(F.collect_set("number")).alias("__numbers"))
        .select(F.col("doc_id").alias("__id"), F.col("version").alias("__version"), "__numbers")
    )
    found = sized(found, "spans", F.size("__numbers"))
    old = F.col(text).cast("string")
    joined = docs.withColumn("__mark", F.xxhash64(F.col(doc_id), old)).join(
        found, (F.col("__mark") == F.col("__version")) & F.col(doc_id).eqNullSafe(F.col("__id")), "left"
    )
    # The text is cut as its candidates were: each piece is read once.
    held = F.col("__numbers").isNotNull()
    cut = joined.withColumns(
        {"__gaps": F.when(held, F.split(old, FORM, -1)), "__values": F.when(held, F.regexp_extract_all(old, F.lit(FORM), F.lit(0)))}
    )

    def piece(value: Column, i: Column) -> Column:
        return F.concat(F.get("__gaps", i), F.when(F.array_contains("__numbers", i), REPLACEMENT).otherwise(value))

    last = F.array(F.get("__gaps", F.size("__values")))
    rebuilt = F.array_join(F.concat(F.transform("__values", piece), last), "")
    cleaned = F.when(held, rebuilt).otherwise(old)
    return cut.withColumn(text, cleaned).drop("__mark", "__id", "__version", "__numbers", "__gaps", "__values")
