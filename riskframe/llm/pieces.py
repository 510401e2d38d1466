"""SentencePiece BPE encoding by vectorised merge rounds, and decoding.

The model file gives pieces and scores; encoding is done here. A text is cut
into words (a run of word marks and what follows it up to the next mark; no
piece crosses such a cut). The symbols of all new words of a batch lie in flat
arrays. Each round ranks every adjacent pair, takes the smallest rank per word,
merges its leftmost place in all words at once and compacts the arrays, until no
word has a pair left. Equal pairs of a word are merged in one round where no
longer piece could come in between. Characters without a piece become bytes.

Worker processes remember the words they have encoded, up to a fixed number.

Defined cases: null and empty texts have no ids and decode to the empty text;
repeated rows are encoded each; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.store import small_batches

MARK = "▁"
NO_RANK = np.int64(2**62)
#: Words that a worker remembers; the memory is emptied when it is full.
REMEMBERED = 500_000
#: Longer words are not remembered.
LONGEST = 200
#: Symbols of one flat array.
BLOCK = 1 << 18

_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class PieceModel:
    """Vocabulary tables of a SentencePiece BPE model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        scores = np.array([model.get_score(i) for i in range(size)], np.float64)
        self.is_byte = np.array([model.is_byte(i) for i in range(size)])
        self.control = np.array([model.is_control(i) for i in range(size)])
        self.unknown = model.unk_id()
        plain = [i for i in range(size) if not (self.is_byte[i] or self.control[i] or model.is_unknown(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            raise ValueError("a piece crosses the start of a word; this model can't be cut into words")
        # The symbol of every code point: its piece, or a negative number that is never part of a pair.
        self.symbols = -1 - np.arange(0x110000, dtype=np.int64)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.symbols[ord(piece)] = i
        self.id_texts = [str(i).encode() for i in range(size)]
        self.bytes = [self.pieces.index(f"<0x{b:02X}>") for b in range(256)]
        # Equal scores have equal ranks: the leftmost place then wins.
        self.rank = np.searchsorted(np.unique(-scores), -scores).astype(np.int64)
        self._pair_table()

    def _pair_table(self) -> None:
        """All (left, right) -> merged piece, and which pieces can be merged at several places at once."""
        keys, merged = [], []
        soonest = np.full(len(self.pieces), NO_RANK)
        for piece, i in self.ids.items():
            for cut in range(1, len(piece)):
                left, right = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                for part in (left, right):
                    if part is not None:
                        soonest[part] = min(soonest[part], self.rank[i])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    merged.append(i)
            # A single character outside the vocabulary can't be part of a merge.
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.merged = np.array(keys, np.int64)[order], np.array(merged, np.int64)[order]
        self.safe = soonest > self.rank

    def pair_ids(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each adjacent pair merges to, or -1."""
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.keys[at] == wanted), self.merged[at], -1)

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The ids of every word, by merge rounds over flat arrays."""
        out: list[list[int]] = []
        start = 0
        while start < len(words):
            end, symbols = start, 0
            while end < len(words) and (end == start or symbols + len(words[end]) <= BLOCK):
                symbols += len(words[end])
                end += 1
            out += self._encode_block(words[start:end])
            start = end
        return out

    def _encode_block(self, words: list[str]) -> list[list[int]]:
        text = "".join(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.symbols[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
        word = np.repeat(np.arange(len(words)), lengths)
        done_sym, done_word = [], []
        pair = self._pairs(sym, word)
        while len(sym):
            rank = np.where(pair >= 0, self.rank[pair], NO_RANK)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, starts)
            alive = least < NO_RANK
            if not alive.all():
                # Compaction: finished words leave the arrays.
                keep = np.repeat(alive, np.diff(np.r_[starts, len(sym)]))
                done_sym.append(sym[~keep])
                done_word.append(word[~keep])
                sym, word, pair, rank = sym[keep], word[keep], pair[keep], rank[keep]
                least = least[alive]
                if not len(sym):
                    break
                starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[starts, len(sym)])
            at = np.flatnonzero(rank == np.repeat(least, sizes))
            at = self._chosen(at, word, pair)
            sym[at] = pair[at]
            left = np.ones(len(sym), bool)
            left[at + 1] = False
            changed = np.zeros(len(sym), bool)
            changed[at] = True
            sym, word, pair, changed = sym[left], word[left], pair[left], changed[left]
            # Only pairs at a merged symbol are new.
            again = changed.copy()
            again[:-1] |= changed[1:]
            again = np.flatnonzero(again)
            pair[again] = -1
            again = again[again < len(sym) - 1]
            again = again[word[again] == word[again + 1]]
            pair[again] = self.pair_ids(sym[again], sym[again + 1])
        if not done_sym:
            return [[] for _ in words]
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        sym, word = sym[order], word[order]
        ends = np.searchsorted(word, np.arange(len(words) + 1))
        flat, ends = sym.tolist(), ends.tolist()
        out = [flat[a:b] for a, b in zip(ends, ends[1:])]
        for w in np.unique(word[sym < 0]).tolist():
            out[w] = self._with_bytes(out[w])
        return out

    def _pairs(self, sym: np.ndarray, word: np.ndarray) -> np.ndarray:
        pair = np.full(len(sym), -1, np.int64)
        if len(sym) > 1:
            found = self.pair_ids(sym[:-1], sym[1:])
            pair[:-1] = np.where(word[:-1] == word[1:], found, -1)
        return pair

    def _chosen(self, at: np.ndarray, word: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """Of the places with their word's least rank: the leftmost, and later ones of a safe equal pair."""
        first = np.r_[True, word[at[1:]] != word[at[:-1]]]
        if first.all():
            return at
        group = np.cumsum(first) - 1
        lead = at[first][group]
        at = at[first | (self.safe[pair[lead]] & (pair[at] == pair[lead]))]
        # Places next to each other overlap: take every second one of such a run.
        run = np.r_[True, (at[1:] != at[:-1] + 1)]
        number = np.arange(len(at))
        return at[(number - number[run][np.cumsum(run) - 1]) % 2 == 0]

    def _with_bytes(self, symbols: list[int]) -> list[int]:
        out = []
        for s in symbols:
            out += [s] if s >= 0 else [self.bytes[b] for b in chr(-1 - s).encode("utf-8", "surrogatepass")]
        return out

    @functools.cached_property
    def _spoken(self) -> list[bytes]:
        raw = [p.replace(MARK, " ").encode() for p in self.pieces]
        for b, i in enumerate(self.bytes):
            raw[i] = bytes([b])
        for i in np.flatnonzero(self.control):
            raw[i] = b""
        raw[self.unknown] = " ⁇ ".encode()
        return raw

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        """Text of the ids with the leading mark still in front."""
        return b"".join(map(self._spoken.__getitem__, ids))


def cut_words(text: str) -> list[str]:
    """The words of a text, after the leading mark is put in front and spaces have become marks."""
    return _WORD.findall(MARK + text.replace(" ", MARK)) if text else []


@functools.cache
def load_model(path: str) -> PieceModel:
    return PieceModel(path)


class Encoder:
    """Encodes texts and remembers words: their ids as decimal text, and their bytes when decoded."""

    def __init__(self, path: str):
        self.model = load_model(path)
        self.known: dict[str, tuple[bytes, bytes]] = {}

    def encode_batch(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """For every text its ids as decimal text joined by commas, and the text that they decode to."""
        cut = [cut_words(t or "") for t in texts]
        wanted = set().union(*cut)
        new = wanted - self.known.keys()
        if new and len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = wanted
        words = list(new)
        id_text, spoken = self.model.id_texts.__getitem__, self.model._spoken.__getitem__
        for word, ids in zip(words, self.model.encode_words(words)):
            self.known[word] = b",".join(map(id_text, ids)), b"".join(map(spoken, ids))
        out = []
        for found in cut:
            ids, decoded = zip(*map(self.known.__getitem__, found)) if found else ((), ())
            out.append((b",".join(ids), finish_decoding(b"".join(decoded))))
        for word in [w for w in new if len(w) > LONGEST]:
            del self.known[word]
        return out


@functools.cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def finish_decoding(raw: bytes) -> bytes:
    """Drop the leading space and replace what is no UTF-8, as the library's decoder does."""
    raw = raw[1:] if raw[:1] == b" " else raw
    return raw.decode("utf-8", "replace").encode()


def encode(text: str | None, path: str) -> list[int]:
    ids = _encoder(path).encode_batch([text])[0][0]
    return [int(i) for i in ids.split(b",")] if ids else []


def decode(ids: Iterable[int], path: str) -> str:
    return finish_decoding(load_model(path).decode_bytes(ids)).decode()


def _encoded(path: str, with_ids: bool):
    def run(batches):
        encoder = _encoder(path)
        for batch in batches:
            pairs = encoder.encode_batch(batch.column(1).to_pylist())
            id_texts, decoded = [p[0] for p in pairs], [p[1] for p in pairs]
            if with_ids:
                lists = [np.array(t.split(b","), np.int32) if t else np.empty(0, np.int32) for t in id_texts]
                columns = [pa.array(lists, pa.list_(pa.int32())), pa.array([d.decode() for d in decoded], pa.string())]
                names = ["ids", "decoded"]
            else:
                columns = [
                    pa.array([t.count(b",") + 1 if t else 0 for t in id_texts], pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in id_texts], pa.string()),
                    pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string()),
                ]
                names = ["n_tokens", "ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *names])

    return run


def encode_documents(
    docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text", digests: bool = False
) -> DataFrame:
    """doc_id with ``ids`` and the text ``decoded`` from them; or, with ``digests``, their number and hashes.

    A map over whole texts without a shuffle; each task's memory is bounded by
    a batch of texts and the remembered words.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return rows.mapInArrow(_encoded(model_path, not digests), f"doc_id {kind}, {out}")
