"""Packing documents into token sequences of several lengths.

A document is its byte-level BPE ids and a closing id. Whole windows of the
longest length are cut from its front; the rest is one piece, so each document
is cut only where it must be. Pieces belong to the tier (256, 512, 1024, 2048)
they fit in. The plan is made from the number of pieces of each length alone, at
most 2048 numbers whatever the corpus: longest tier first, each window takes a
piece of its tier and fills the gap with the longest pieces of shorter tiers that
fit. Windows of shorter tiers are used only when they come out full; what is left
over fills windows of the longest length. Ranks among the pieces of equal length
then say which piece goes where, and steps get an equal share of every tier.

Defined cases: null and empty texts are the closing id alone; rows without an id
and repeated rows are packed like others; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.store import keep, released, small_batches

TIERS = (256, 512, 1024, 2048)
END_ID = 1
SPECIAL = "<|endoftext|>"
STEP_TOKENS = 1 << 18
#: Rows of one ranking task, about.
RANK_ROWS = 20_000

# Words with the space before them, and runs of white space, as byte-level BPE
# cuts them first; each is then encoded on its own.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACES = set("\t\n\v\f\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000") | {chr(c) for c in range(0x2000, 0x200B)}
_CHUNK = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


# Fixed value: how byte-level BPE of this family cuts a text before merging.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The visible letters that stand for bytes in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(hidden)}


class Tokenizer:
    """Byte-level BPE of a ``tokenizers`` vocabulary file; remembers the chunks that a worker has met."""

    LIMIT, LONGEST = 200_000, 100

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocabulary = spec["model"]["vocab"].items()
        # Ids follow the order of the merges, so they are the merges' ranks.
        ranks = {bytes(letters[c] for c in piece): i for piece, i in vocabulary if piece not in special}
        self.encoding = tiktoken.Encoding("documents", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = special[SPECIAL].to_bytes(4, "little")
        self.line = ranks[b"\n"]
        self.known: dict[str, bytes] = {}

    def _learn(self, wanted: set[str]) -> None:
        new = wanted - self.known.keys()
        if new and len(self.known) + len(new) > self.LIMIT:
            self.known.clear()
            new = wanted
        words = [c for c in new if c[-1] not in _SPACES]
        # Chunks cut the same with a line break in front, whose id no word contains.
        ids = np.array(self.encoding.encode_ordinary("\n" + "\n".join(words)), "<u4")
        data = ids.tobytes()
        ends = [*(4 * np.flatnonzero(ids == self.line)).tolist(), len(data)]
        for word, a, b in zip(words, ends, ends[1:]):
            self.known[word] = data[a + 4 : b]
        for space in new.difference(words):
            self.known[space] = np.array(self.encoding.encode_ordinary(space), "<u4").tobytes()

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of whole texts and the closing id, four bytes each."""
        cut = [[_CHUNK.findall(part) for part in (t or "").split(SPECIAL)] for t in texts]
        wanted = set().union(*[part for parts in cut for part in parts])
        self._learn(wanted)
        get = self.known.__getitem__
        end = END_ID.to_bytes(4, "little")
        out = [self.special.join([b"".join(map(get, part)) for part in parts]) + end for parts in cut]
        for long in [c for c in wanted if len(c) > self.LONGEST]:
            del self.known[long]
        return out


@functools.cache
def load_tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def _pieces(path: str, longest: int, with_ids: bool):
    width = 4 * longest

    def run(batches):
        tokenizer = load_tokenizer(path)
        for batch in batches:
            rows, start, length, crc, total, ids = [], [], [], [], [], []
            for r, data in enumerate(tokenizer.encode_batch(batch.column(1).to_pylist())):
                for at in range(0, len(data), width):
                    part = data[at : at + width]
                    rows.append(r)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(len(data) // 4)
                    if with_ids:
                        ids.append(np.frombuffer(part, "<i4"))
            columns = [batch.column(0).take(pa.array(rows, pa.int64()))]
            columns += [pa.array(c, pa.int64()) for c in (start, length, crc, total)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def plan(counts: dict[int, int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[int], int]]:
    """(window length, lengths of its pieces, number of such windows) for all pieces.

    Each step uses up one length, so there are at most a few thousand patterns.
    """
    top = max(tiers)
    left = np.zeros(top + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    patterns = []

    def fill(size: int, first: int, full: bool) -> bool:
        used = Counter([first])
        pieces, gap = [first], size - first
        while gap:
            fits = np.flatnonzero(left[1 : gap + 1] > np.array([used[m] for m in range(1, gap + 1)] if used else 0))
            if not len(fits):
                break
            best = int(fits[-1]) + 1
            more = min(gap // best, int(left[best]) - used[best])
            pieces += [best] * more
            used[best] += more
            gap -= more * best
        if gap and full:
            return False
        times = min(int(left[m]) // k for m, k in used.items())
        for m, k in used.items():
            left[m] -= times * k
        patterns.append((size, pieces, times))
        return True

    for size in sorted(tiers, reverse=True):
        smaller = max([t for t in tiers if t < size], default=0)
        for first in range(size, smaller, -1):
            while left[first] and fill(size, first, full=size < top):
                pass
    for first in range(top, 0, -1):
        while left[first]:
            fill(top, first, full=False)
    return patterns


def _layout(patterns) -> tuple[np.ndarray, dict[int, int]]:
    """Sorted columns: key (length and first rank), repeats in a window, first window, offset, window length, first window of the tier."""
    order = sorted(range(len(patterns)), key=lambda i: -patterns[i][0])
    rows, used, sequence, tier_start, tier_size = [], Counter(), 0, {}, Counter()
    for i in order:
        size, pieces, times = patterns[i]
        tier_start.setdefault(size, sequence)
        tier_size[size] += times
        offset = 0
        for length, k in Counter(pieces).items():  # in order of first appearance: equal lengths stand together
            rows.append((length << 40 | used[length], length << 40 | used[length], k, sequence, offset, size, tier_start[size]))
            used[length] += k * times
            offset += k * length
        sequence += times
    rows.sort()
    return np.array([r[1:] for r in rows], np.int64).reshape(-1, 6), dict(tier_size)


def _ranked(pieces: DataFrame, rows: int) -> DataFrame:
    """Numbers from 0 among the pieces of each length, without a large group: ranks inside a hash slot plus the slots before."""
    slots = max(16, rows // RANK_ROWS)
    keyed = pieces.withColumn("slot", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(slots)).cast("int"))
    before = (
        keyed.groupBy("length", "slot")
        .agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)))
        .select("length", "slot", F.coalesce("before", F.lit(0)).alias("before"))
    )
    # Repeated rows hash alike, so copies of one row are dealt by their place in the slot's order.
    inside = F.row_number().over(Window.partitionBy("length", "slot").orderBy("doc_id", "start", "ids_crc32", "doc_tokens"))
    return keyed.withColumn("inside", inside).join(before, ["length", "slot"]).withColumn("rank", F.col("before") + F.col("inside") - 1)


def pack(
    docs: DataFrame,
    tokenizer: str,
    doc_id: str = "doc_id",
    text: str = "text",
    tiers: tuple[int, ...] = TIERS,
    step_tokens: int = STEP_TOKENS,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece.

    doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, window
    (the sequence's length with padding), step (training step that the sequence
    belongs to), and the piece's ids with ``with_ids``.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids array<int>" * with_ids
    pieces = keep(rows.mapInArrow(released(_pieces(tokenizer, max(tiers), with_ids)), schema), "pieces")
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    layout, tier_size = _layout(plan(counts, tiers))
    windows = sum(size * n for size, n in tier_size.items())
    steps = max(1, -(-windows // step_tokens))
    shared = docs.sparkSession.sparkContext.broadcast((layout, tier_size, steps))

    @F.pandas_udf("sequence_id bigint, offset bigint, window bigint, step bigint")
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        layout, tier_size, steps = shared.value
        key = length.to_numpy() << 40 | rank.to_numpy()
        found = layout[np.searchsorted(layout[:, 0], key, side="right") - 1]
        instance = key - found[:, 0]
        sequence = found[:, 2] + instance // found[:, 1]
        sizes = pd.Series(found[:, 4]).map(tier_size).to_numpy(np.int64, na_value=1)
        return pd.DataFrame({
            "sequence_id": sequence,
            "offset": found[:, 3] + instance % found[:, 1] * length.to_numpy(),
            "window": found[:, 4],
            "step": (sequence - found[:, 5]) * steps // sizes,
        })

    ranked = _ranked(pieces, sum(counts.values()))
    out = ranked.withColumn("place", placed("length", "rank"))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    return out.select(*columns, "place.*")


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed sequences from pieces with ids: sequence_id, step, window, ids, and doc_ids and lengths of the pieces in order."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "length", "doc_id", "ids")))
    return (
        pieces.groupBy("sequence_id", "step", "window")
        .agg(parts.alias("parts"))
        .select(
            "sequence_id",
            "step",
            "window",
            F.flatten("parts.ids").alias("ids"),
            F.col("parts.doc_id").alias("doc_ids"),
            F.col("parts.length").alias("lengths"),
        )
    )
