"""Periodic runs of words by recompression.

The words of a batch of documents, with a mark of its own before, between and
behind them, are compressed into a run-length grammar: block compression makes
one symbol of equal neighbours, pair compression one symbol of each pair whose
first symbol lies in one half of the alphabet and whose second lies in the other.
The two alternate until one symbol is left. Where such cuts fall depends on the
neighbouring symbols alone, so equal stretches are compressed alike, and how far
two places agree is found by going up the levels while the symbols agree and down
again to the first word that differs: one step per level, for all places at once.

A run of period q with e periods or more holds a multiple of (e - 1) * q at which
the word equals the one q places on. These places of all q form a harmonic grid of
O(n log n) candidates; each one that agrees is extended exactly to both sides. Of
the periods of one stretch the smallest is its own, the others are multiples.

Work is O(n log n) and memory O(n) in the words of a document, whatever they
repeat. Documents are independent: nothing is shuffled.

Defined cases: null, empty and blank texts have no words, no runs and the empty
collapsed text; fewer words than ``min_length`` have no runs; rows are treated
one by one, so repeated ids and rows, and rows without an id, give a row each; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.store import small_batches

#: A run repeats its period at least so often, and has at least so many words.
MIN_EXPONENT, MIN_LENGTH = 4, 6
#: Words compressed together, unless one document has more; candidates looked at together.
BLOCK_WORDS, BLOCK_CANDIDATES = 1 << 16, 1 << 19

SCHEMA = "doc_id {id}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _names(keys: np.ndarray, first: int) -> tuple[np.ndarray, int]:
    """A number from ``first`` on for each distinct key, and the next free number."""
    codes, distinct = pd.factorize(keys)
    return codes.astype(np.int64) + first, first + len(distinct)


class Grammar:
    """A sequence of numbers from 0 on and the levels of its recompression.

    Every level keeps its symbols, where the symbols of the next level start in
    it, which of those holds each symbol, and whether they are blocks. The first
    and the last number must occur once only.
    """

    def __init__(self, sequence: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, bool]] = []
        symbols = sequence.astype(np.int64)
        free, seed = int(symbols.max(initial=-1)) + 1, 0
        while len(symbols) > 1:
            same = symbols[1:] == symbols[:-1]
            if same.any():
                starts = np.flatnonzero(np.r_[True, ~same])
                sizes = np.diff(np.r_[starts, len(symbols)])
                above = symbols[starts]
                long = sizes > 1
                above[long], free = _names(above[long] * (len(symbols) + 1) + sizes[long], free)
                symbols = self._add(symbols, starts, above, True)
                continue
            seed += 1
            first = self._first_halves(symbols, seed)
            if not len(first):
                continue
            names, following = _names(symbols[first] * free + symbols[first + 1], free)
            above = symbols.copy()
            above[first] = names
            alone = np.ones(len(symbols), bool)
            alone[first + 1] = False
            starts = np.flatnonzero(alone)
            symbols, free = self._add(symbols, starts, above[starts], False), following

    def _add(self, symbols: np.ndarray, starts: np.ndarray, above: np.ndarray, blocks: bool) -> np.ndarray:
        owner = np.zeros(len(symbols) + 1, np.int64)
        owner[starts] = 1
        owner[-1] = 1
        self.levels.append((symbols, np.r_[starts, len(symbols)], np.cumsum(owner) - 1, blocks))
        return above

    @staticmethod
    def _first_halves(symbols: np.ndarray, seed: int) -> np.ndarray:
        """The places of the pairs to compress: symbols are dealt into two halves, in the better order."""
        mixed = (symbols.astype(np.uint64) + np.uint64(seed << 32)) * _MULTIPLIER
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _MULTIPLIER
        half = (mixed >> np.uint64(40)) & np.uint64(1) == 1
        pairs = [np.flatnonzero(half[:-1] & ~half[1:]), np.flatnonzero(~half[:-1] & half[1:])]
        return max(pairs, key=len)

    def forward(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For each pair of different places, the first place from ``x`` on that differs from its partner."""

        def agree(symbols, x, y):
            return symbols[x] == symbols[y]

        def left(starts, owner, x):
            return starts[owner[x] + 1] - x

        return self._extend(x, y, 1, agree, left)

    def backward(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For each pair of different ends, the place from which on the symbols before ``x`` agree."""

        def agree(symbols, x, y):
            return symbols[x - 1] == symbols[y - 1]

        def left(starts, owner, x):
            return x - starts[owner[x - 1]]

        return self._extend(x, y, -1, agree, left)

    def _extend(self, x: np.ndarray, y: np.ndarray, sign: int, agree, left) -> np.ndarray:
        """One step per level, up while the symbols agree and then down to the first that differs."""
        query = np.arange(len(x))
        stopped = []
        for symbols, starts, owner, blocks in self.levels:
            equal = agree(symbols, x, y)
            border = (starts[owner[x]] == x) & (starts[owner[y]] == y)
            # Inside a symbol of the next level, go on to its end.
            inside = np.flatnonzero(equal & ~border)
            if len(inside):
                step = np.minimum(left(starts, owner, x[inside]), left(starts, owner, y[inside])) if blocks else 1
                x, y = x.copy(), y.copy()
                x[inside] += sign * step
                y[inside] += sign * step
                border[inside] = (starts[owner[x[inside]]] == x[inside]) & (starts[owner[y[inside]]] == y[inside])
            up = equal & border
            stopped.append((query[~up], x[~up], y[~up]))
            query, x, y = query[up], owner[x[up]], owner[y[up]]
            if not len(query):
                break
        query = x = y = np.empty(0, np.int64)
        for (symbols, starts, owner, blocks), (q, sx, sy) in zip(self.levels[len(stopped) - 1 :: -1], stopped[::-1]):
            if len(query):
                x, y = starts[x], starts[y]
                equal = agree(symbols, x, y)
                step = np.minimum(left(starts, owner, x), left(starts, owner, y)) if blocks else 1
                step = np.where(equal, step, 0)
                x, y = x + sign * step, y + sign * step
            query, x, y = np.concatenate([query, q]), np.concatenate([x, sx]), np.concatenate([y, sy])
        out = np.empty(len(query), np.int64)
        out[query] = x
        return out


def _candidates(sizes: np.ndarray, offsets: np.ndarray, exponent: int):
    """(places, periods) of the harmonic grids of documents with ``sizes`` words that begin at ``offsets``."""
    longest = sizes // exponent
    document = np.repeat(np.arange(len(sizes)), longest)
    period = np.arange(len(document)) - np.repeat(np.cumsum(longest) - longest, longest) + 1
    count = (sizes[document] - 1 - period) // ((exponent - 1) * period) + 1
    ends = np.cumsum(count)
    at = 0
    while at < len(count):
        before = ends[at] - count[at]
        to = max(int(np.searchsorted(ends, before + BLOCK_CANDIDATES, "right")), at + 1)
        c, q = count[at:to], period[at:to]
        q = np.repeat(q, c)
        step = np.arange(len(q)) - np.repeat(np.cumsum(c) - c, c)
        yield np.repeat(offsets[document[at:to]], c) + step * (exponent - 1) * q, q
        at = to


def runs_of(documents: list[list[bytes]], exponent: int = MIN_EXPONENT, min_length: int = MIN_LENGTH) -> list[np.ndarray]:
    """For each list of words its runs as rows of (start, length, period), by start, then period."""
    sizes = np.array([len(d) for d in documents], np.int64)
    numbers: dict[bytes, int] = {}
    flat = [numbers.setdefault(w, len(numbers)) for w in itertools.chain.from_iterable(documents)]
    offsets = np.cumsum(sizes + 1) - sizes
    sequence = np.empty(int(sizes.sum()) + len(sizes) + 1, np.int64)
    marks = np.r_[0, offsets + sizes]
    word = np.ones(len(sequence), bool)
    word[marks] = False
    sequence[word] = flat
    sequence[marks] = len(numbers) + np.arange(len(marks))

    grammar = None
    found = [np.empty((0, 3), np.int64)]
    for x, q in _candidates(sizes, offsets, exponent):
        same = sequence[x] == sequence[x + q]
        x, q = x[same], q[same]
        if not len(x):
            continue
        grammar = grammar or Grammar(sequence)
        end = grammar.forward(x, x + q) + q
        start = grammar.backward(x, x + q)
        enough = end - start >= np.maximum(min_length, exponent * q)
        found.append(np.unique(np.stack([start, end, q], axis=1)[enough], axis=0))
    start, end, q = np.unique(np.concatenate(found), axis=0).T
    # The smallest period of a stretch comes first.
    own = np.ones(len(start), bool)
    own[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, q = start[own], end[own], q[own]
    order = np.lexsort((q, start))
    start, end, q = start[order], end[order], q[order]
    cuts = np.searchsorted(start, offsets)
    spans = np.stack([start, end - start, q], axis=1)
    return [part - [first, 0, 0] for part, first in zip(np.split(spans, cuts[1:]), offsets)]


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run holds after its first period, joined by single spaces."""
    if len(runs):
        depth = np.zeros(len(words) + 1, np.int64)
        np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
        np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
        words = list(itertools.compress(words, np.cumsum(depth[:-1]) == 0))
    return b" ".join(words)


def _found(exponent: int, min_length: int):
    def rows(ids: pa.Array, documents: list[list[bytes]]) -> pa.RecordBatch:
        runs = runs_of(documents, exponent, min_length)
        flat = np.concatenate(runs)
        struct = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], ["start", "length", "period"])
        ends = np.cumsum([0, *map(len, runs)]).astype(np.int32)
        texts = pa.array([collapse(d, r) for d, r in zip(documents, runs)], pa.binary())
        return pa.RecordBatch.from_arrays(
            [ids, pa.array([len(d) for d in documents], pa.int64()), pa.ListArray.from_arrays(ends, struct), texts.cast(pa.string())],
            ["doc_id", "n_words", "runs", "collapsed"],
        )

    def run(batches):
        for batch in batches:
            documents, size, first = [], 0, 0
            for i, text in enumerate(batch.column(1)):
                # bytes.split() cuts at the six white-space characters of ASCII only.
                documents.append((text.as_py() or b"").split())
                size += len(documents[-1])
                if size >= BLOCK_WORDS:
                    yield rows(batch.column(0).slice(first, len(documents)), documents)
                    documents, size, first = [], 0, i + 1
            if documents:
                yield rows(batch.column(0).slice(first, len(documents)), documents)

    return run


def find_runs(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    min_exponent: int = MIN_EXPONENT,
    min_length: int = MIN_LENGTH,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, runs (start, length, period in words) and collapsed text.

    A run is a longest stretch with its smallest period q, of ``min_exponent`` * q words and ``min_length`` at least.
    """
    if min_exponent < 2:
        raise ValueError("a run has two periods at least")
    small_batches(docs.sparkSession)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    schema = SCHEMA.format(id=source.schema["doc_id"].dataType.simpleString())
    return source.mapInArrow(_found(min_exponent, min_length), schema)


def most_periodic(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; ties: smallest start, then period."""

    def better(best: Column, run: Column) -> Column:
        ahead, behind = run["length"] * best["period"], best["length"] * run["period"]
        return F.when(best.isNull() | (ahead > behind), run).otherwise(best)

    # Runs come by start, then period, so the first of equals stays.
    return F.aggregate(runs, F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"), better)
