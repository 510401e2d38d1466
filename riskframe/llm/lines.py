"""Repeated line runs, found by winnowing over line hashes; Spark expressions only.

A text is the sequence of its lines that have words. A window starts (or ends)
at every line and is the shortest run of lines with at least ``min_words``
words, so every run of that many words contains windows that cover it whole,
from its first line on and up to its last one. Each window selects its smallest
line hash as its fingerprint: two places that share such a run share its
fingerprints. Fingerprints that occur at one place only are dropped by an
aggregate; the windows around the others are joined to the first place (in order
of id and line) with the same window. Overlapping and adjacent windows of a
document extend each other both ways to whole runs, and later runs are deleted.

So a line is deleted exactly if it lies in a run of equal lines with at least
``min_words`` words that also begins earlier, in this or another document.
No pairs of places are made: each one meets only the first of its kind.

Defined cases: null, empty and blank texts stay as they are; blank lines
go only where the lines with words before and after them both go; a run that overlaps its own repetition keeps one period;
rows with equal id and text are one document and lose the same lines; documents
without an id come last in order; an empty table gives an empty result; other
columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.store import keep, sized

#: Shortest repeated run, in words.
MIN_WORDS = 50

RUNS = "array<struct<first:int,last:int>>"


def _windows(lines: Column, min_words: int, backward: bool) -> Column:
    """For every line the shortest run from it on with enough words."""

    def grow(acc: Column, line: Column) -> Column:
        more = F.struct((acc["words"] + line["words"]).alias("words"), (acc["size"] + 1).alias("size"))
        return F.when(acc["words"] < min_words, more).otherwise(acc)

    def window(line: Column, i: Column) -> Column:
        start = F.struct(F.lit(0).alias("words"), F.lit(0).alias("size"))
        # Every line has a word, so min_words lines are enough.
        grown = F.aggregate(F.slice(lines, i + 1, F.lit(min_words)), start, grow)
        return F.struct(i.alias("at"), grown["words"].alias("words"), grown["size"].alias("size"))

    def described(w: Column) -> Column:
        part = F.slice(lines, w["at"] + 1, w["size"])
        part = F.reverse(part) if backward else part
        anchor = F.array_min(F.transform(part, lambda x: F.struct(x["hash"].alias("hash"), x["pos"].alias("pos"))))
        return F.struct(
            F.element_at(part, 1)["n"].alias("first_n"),
            F.element_at(part, -1)["n"].alias("last_n"),
            F.element_at(part, 1)["pos"].alias("first"),
            F.element_at(part, -1)["pos"].alias("last"),
            anchor["hash"].alias("anchor"),
            anchor["pos"].alias("anchor_pos"),
            F.xxhash64(F.transform(part, lambda x: x["hash"])).alias("w1"),
            F.xxhash64(F.lit(1), F.transform(part, lambda x: x["other"])).alias("w2"),
        )

    return F.transform(F.filter(F.transform(lines, window), lambda w: w["words"] >= min_words), described)


def _merged(ranges: Column) -> Column:
    """Sorted ranges, with overlapping ones and those with no line with words between them joined."""

    def add(acc: Column, r: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        wider = F.struct(
            last["first_n"].alias("first_n"),
            F.greatest(last["last_n"], r["last_n"]).alias("last_n"),
            last["first"].alias("first"),
            F.greatest(last["last"], r["last"]).alias("last"),
        )
        return F.when(
            (F.size(acc) > 0) & (r["first_n"] <= last["last_n"] + 1),
            F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(wider)),
        ).otherwise(F.concat(acc, F.array(r)))

    merged = F.aggregate(ranges, F.array().cast("array<struct<first_n:int,last_n:int,first:int,last:int>>"), add)
    return F.transform(merged, lambda r: F.struct(r["first"].alias("first"), r["last"].alias("last")))


def repeated_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, version, runs): the line ranges to delete, for documents that have any.

    ``version`` is the hash of id and text that tells rows with equal ids apart.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    hashed = F.transform(
        F.split("text", "\n"),
        lambda line, pos: F.struct(
            pos.alias("pos"),
            F.xxhash64(line).alias("hash"),
            F.xxhash64(F.lit(1), line).alias("other"),
            F.regexp_count(line, F.lit(r"\S+")).alias("words"),
        ),
    )
    lines = source.select(
        "doc_id",
        F.xxhash64("doc_id", "text").alias("version"),
        F.transform(
            F.filter(hashed, lambda x: x["words"] > 0), lambda x, n: x.withField("n", n)
        ).alias("lines"),
    )
    both = lines.select(
        "doc_id",
        "version",
        _windows(F.col("lines"), min_words, False).alias("onward"),
        F.reverse("lines").alias("lines"),
        # Reversed in a column of its own, so that it is made once per text.
    ).select("doc_id", "version", "onward", _windows(F.col("lines"), min_words, True).alias("back"))
    windows = both.select(
        "doc_id", "version", F.explode(F.array_distinct(F.concat("onward", "back"))).alias("w")
    ).select(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "version").alias("doc"), "w.*")
    # Stored once for the three uses below. What is joined back to the rows it
    # sums up is stored, too: a join over two plain shuffles can split a hot key.
    windows = keep(windows, "windows")

    place = F.struct("doc", "anchor_pos")
    repeated = (
        windows.groupBy("anchor")
        .agg(F.min(place).alias("low"), F.max(place).alias("high"))
        .where("low <> high")
        .select("anchor")
    )
    candidates = keep(windows.join(keep(repeated, "repeated"), "anchor").drop("anchor", "anchor_pos"), "candidates")
    start = F.struct("doc", "first")
    earliest = candidates.groupBy("w1", "w2").agg(F.min(start).alias("start"), F.max(start).alias("end")).where("start <> end")
    later = candidates.join(keep(earliest.drop("end"), "earliest"), ["w1", "w2"]).where(start > F.col("start"))
    ranges = later.groupBy("doc").agg(F.collect_set(F.struct("first_n", "last_n", "first", "last")).alias("ranges"))
    return ranges.select("doc.doc_id", "doc.version", _merged(F.sort_array("ranges")).alias("runs"))


def delete_repeated_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, runs: str = "deleted_runs"
) -> DataFrame:
    """``docs`` without the repeated runs in ``text``; ``runs`` lists them as line numbers of the old text."""
    found = repeated_runs(docs, doc_id, text, min_words).select(
        F.col("doc_id").alias("__id"), F.col("version").alias("__version"), F.col("runs").alias("__runs")
    )
    found = sized(found, "runs", F.size("__runs"))
    old = F.col(text).cast("string")
    mark = F.xxhash64(F.col(doc_id), old)
    joined = docs.withColumn("__mark", mark).join(
        found, (F.col("__mark") == F.col("__version")) & F.col(doc_id).eqNullSafe(F.col("__id")), "left"
    )
    numbered = F.transform(F.split(old, "\n"), lambda line, pos: F.struct(line.alias("line"), pos.alias("pos")))
    inside = lambda x: F.exists("__runs", lambda r: (r["first"] <= x["pos"]) & (x["pos"] <= r["last"]))
    kept = F.transform(F.filter(numbered, lambda x: ~inside(x)), lambda x: x["line"])
    return joined.withColumns({
        text: F.when(F.col("__runs").isNull(), old).otherwise(F.array_join(kept, "\n")),
        runs: F.coalesce("__runs", F.array().cast(RUNS)),
    }).drop("__mark", "__id", "__version", "__runs")
