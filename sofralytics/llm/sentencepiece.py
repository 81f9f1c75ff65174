"""N-best SentencePiece segmentation and decoding with a public vocabulary.

The scores of a forward Viterbi pass over the piece lattice are the exact remaining cost of a backward A-star search, so
the search takes whole paths out in the order of their scores.  No piece has a blank behind another character, hence a
lattice falls apart at the blanks and a text is a row of words; the N best paths of a text differ from the best one only
in the N-1 words whose second-best path loses least, and only those words are searched.  The forward pass gives that
loss as well: the smallest difference between best and second-best way into a node of the best path.

A text starts with one blank more, as the vocabulary's marker wants it; a character without a piece is spelt by byte
pieces, also the marker itself, so decoding gives every text back exactly.  Texts are whole; words seen lately are
remembered by each worker, up to twice ``REMEMBERED`` characters of them, but no word of over ``LONG`` characters.

Null and empty texts have no pieces, score 0 and no alternatives.  Equal scores are ordered by the search, alike on every
run; repeated rows give equal results; an empty table gives an empty table; other columns pass through, but those named
like an output are replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from bisect import insort
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

REMEMBERED, LONG = 4_000_000, 200  # characters of remembered words; a longer word is never remembered
_ENCODERS: dict[tuple[str, int], Encoder] = {}  # of this worker process; a worker serves many tasks
OUTPUTS = "n_pieces int, score double, ids array<int>, alternatives array<struct<score:double,changes:array<struct<start:int,size:int,ids:array<int>>>>>, round_trip boolean"
_ALTERNATIVES = pa.list_(pa.struct([("score", pa.float64()), ("changes", pa.list_(pa.struct([("start", pa.int32()), ("size", pa.int32()), ("ids", pa.list_(pa.int32()))])))]))
_WORD = re.compile(r" *[^ ]+| +")


class Vocabulary:
    """Pieces, their scores and bytes; markers are written as blanks."""

    def __init__(self, pieces: list[tuple[str, float]], byte_pieces: dict[int, int]):
        self.name = hashlib.sha256(repr((pieces, sorted(byte_pieces.items()))).encode()).hexdigest()
        self.scores = [s for _, s in pieces]
        self.byte_ids = [byte_pieces.get(b, 0) for b in range(256)]
        self.known: dict[str, tuple[int, float] | None] = {}
        self.bytes = [b""] * len(pieces)
        value_of = {i: b for b, i in byte_pieces.items()}
        for i, (piece, score) in enumerate(pieces):
            if i in value_of:
                self.bytes[i] = bytes([value_of[i]])
            elif piece:
                plain = piece.replace("▁", " ")
                self.bytes[i] = plain.encode()
                self.known[plain] = (i, score)
                for end in range(1, len(plain)):
                    self.known.setdefault(plain[:end])
        self.splits = not any(re.search("[^ ] ", p) for p, e in self.known.items() if e)

    @staticmethod
    def load(path: str) -> Vocabulary:
        """Read a model file; control and unknown pieces are never used."""
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        pieces, bytes_at = [], {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            hidden = model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
            if model.is_byte(i):
                bytes_at[int(piece[3:5], 16)] = i
            pieces.append(("" if hidden else piece, model.get_score(i)))
        return Vocabulary(pieces, bytes_at)


class Word:
    """The lattice of a word after its forward pass."""

    __slots__ = ("ids", "score", "loss", "_others")

    def __init__(self, ids: tuple[int, ...], score: float, loss: float):
        self.ids, self.score, self.loss, self._others = ids, score, loss, None


class Encoder:
    """Segments words and keeps the last of them: ``REMEMBERED`` characters to twice as many."""

    def __init__(self, vocabulary: Vocabulary, n_best: int):
        self.vocabulary, self.n_best = vocabulary, n_best
        self.words: dict[str, Word] = {}
        self.older: dict[str, Word] = {}
        self.held = 0  # characters of ``words``
        self.longest = max(map(len, vocabulary.known), default=1)
        # a tree of characters: children, and ids and score of the piece that ends here
        self.root: list = [{}, None]
        for piece, entry in vocabulary.known.items():
            if entry is not None:
                node = self.root
                for c in piece:
                    node = node[0].setdefault(c, [{}, None])
                node[1] = ((entry[0],), entry[1])

    @staticmethod
    def shared(vocabulary: Vocabulary, n_best: int) -> Encoder:
        """The encoder that this worker process has used before, if it has."""
        key = (vocabulary.name, n_best)
        if key not in _ENCODERS:
            _ENCODERS[key] = Encoder(vocabulary, n_best)
        return _ENCODERS[key]

    def arcs_into(self, word: str, at: int) -> Iterator[tuple[int, tuple[int, ...], float]]:
        """The pieces that end at a place: (start, ids, score)."""
        known, single = self.vocabulary.known, False
        for i in range(at - 1, max(at - self.longest, 0) - 1, -1):
            if (entry := known.get(word[i:at])) is not None:
                yield i, (entry[0],), entry[1]
                single |= i == at - 1
        if not single:
            spelt = self.spelt(word[at - 1])
            yield at - 1, spelt, sum(self.vocabulary.scores[b] for b in spelt)

    def forward(self, word: str) -> tuple[list[float], list[float], list]:
        """Best and second-best score of each place, and the best arc into it."""
        root, size, low = self.root, len(word), -np.inf
        best, second, back = [0.0] + [low] * size, [low] * (size + 1), [None] * (size + 1)
        for i in range(size):
            base, end, node, single = best[i], i, root, False
            for c in word[i : i + self.longest]:
                node = node[0].get(c)
                if node is None:
                    break
                end += 1
                entry = node[1]
                if entry is None:
                    continue
                if end == i + 1:
                    single = True
                value = base + entry[1]
                if value > best[end]:
                    second[end] = best[end]
                    best[end] = value
                    back[end] = (i, entry[0])
                elif value > second[end]:
                    second[end] = value
            if not single:
                spelt = self.spelt(word[i])
                value = base + sum(self.vocabulary.scores[b] for b in spelt)
                if value > best[i + 1]:
                    second[i + 1], best[i + 1], back[i + 1] = best[i + 1], value, (i, spelt)
                elif value > second[i + 1]:
                    second[i + 1] = value
        return best, second, back

    def spelt(self, character: str) -> tuple[int, ...]:
        return tuple(self.vocabulary.byte_ids[b] for b in character.encode("utf-8", "surrogatepass"))

    def word(self, text: str) -> Word:
        found = self.words.get(text)
        if found is None:
            if len(text) <= LONG and (found := self.older.get(text)) is not None:
                return self.remember(text, found)
            best, second, back = self.forward(text)
            parts, at, loss = [], len(text), np.inf
            while at:
                loss = min(loss, best[at] - second[at])
                at, ids = back[at][0], back[at][1]
                parts.append(ids)
            found = Word(tuple(x for p in reversed(parts) for x in p), best[-1], loss)
            if len(text) <= LONG:
                self.remember(text, found)
        return found

    def remember(self, text: str, found: Word) -> Word:
        if self.held >= REMEMBERED:
            self.older, self.words, self.held = self.words, {}, 0
        self.words[text] = found
        self.held += len(text)
        return found

    def others(self, text: str, word: Word) -> list[tuple[float, tuple[int, ...]]]:
        """(loss, ids) of the next n_best - 1 paths: A-star from the end, led by the forward scores.

        A node is a partial path and what it has lost against the best one; its best arc loses nothing, so it is followed
        to the start at once.  Each other arc on the way is one more path, and only those below the losses of ``n_best``
        paths known so far are kept: the work is linear in the text's length, ties included.
        """
        if word._others is None:
            best, second, back = self.forward(text)
            tick, out = count(), []
            known = [0.0]  # the least losses of paths known so far, sorted
            heap = [(0.0, next(tick), len(text), ())]
            while heap and len(out) < self.n_best:
                loss, _, at, tail = heapq.heappop(heap)
                while at:
                    bound = known[-1] if len(known) == self.n_best else np.inf
                    if loss + (best[at] - second[at]) < bound:
                        for i, ids, score in self.arcs_into(text, at):
                            more = loss + (best[at] - (best[i] + score))
                            if (i, ids) != back[at] and (len(known) < self.n_best or more < known[-1]):
                                insort(known, more)
                                del known[self.n_best :]
                                heapq.heappush(heap, (more, next(tick), i, (ids, tail)))
                    at, tail = back[at][0], (back[at][1], tail)
                ids = []
                while tail:
                    ids.extend(tail[0])
                    tail = tail[1]
                out.append((loss, tuple(ids)))
            word._others = [x for x in out if x[1] != word.ids][: self.n_best - 1]
        return word._others

    def split(self, text: str) -> list[str]:
        if not text:
            return []
        return _WORD.findall(" " + text) if self.vocabulary.splits else [" " + text]

    def encode(self, text: str) -> tuple[array, float, list]:
        """ids, score and the alternatives: their scores and what they change in ids."""
        parts = self.split(text)
        known, look_up = self.words.get, self.word
        words = [known(p) or look_up(p) for p in parts]
        pieces = [w.ids for w in words]
        ids = array("i", chain.from_iterable(pieces))
        score = sum([w.score for w in words])
        if self.n_best < 2 or not words:
            return ids, score, []
        near = np.argsort(np.array([w.loss for w in words]), kind="stable")[: self.n_best - 1]
        starts = {k: sum(map(len, pieces[:k])) for k in near.tolist()}
        paths: list[tuple[float, tuple]] = [(0.0, ())]
        for k in starts:
            more = [(loss + extra, (*made, (starts[k], len(pieces[k]), new))) for loss, made in paths for extra, new in self.others(parts[k], words[k])]
            paths = heapq.nsmallest(self.n_best, paths + more)
        alternatives = [
            {"score": score - loss, "changes": [{"start": a, "size": n, "ids": list(new)} for a, n, new in sorted(made)]} for loss, made in paths if made
        ]
        return ids, score, alternatives[: self.n_best - 1]


def decoded(pieces: list[bytes], ids) -> bytes:
    """The text of ids, without the blank that encoding put before it."""
    return b"".join([pieces[i] for i in ids])[1:]


def encode(docs: DataFrame, vocabulary: Vocabulary, n_best: int = 4) -> DataFrame:
    """The rows without ``text``, with ``n_pieces``, ``score``, ``ids``, ``alternatives`` and ``round_trip``.

    An alternative is the best segmentation with some stretches of pieces (start, size) replaced by other ids; see
    ``alternative_ids``.  ``round_trip`` says that decoding ids gave the text back.
    """
    new = StructType.fromDDL(OUTPUTS)
    kept = [c for c in docs.columns if c not in ("text", *new.names)]
    schema = StructType([docs.schema[c] for c in kept] + new.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.shared(vocabulary, n_best)
        for batch in batches:
            flat, ends, scores, others, same = array("i"), [0], [], [], []
            for text in batch.column(len(kept)).to_pylist():
                ids, score, alternatives = encoder.encode(text or "")
                flat.extend(ids)
                ends.append(len(flat))
                scores.append(score)
                others.append(alternatives)
                same.append(decoded(vocabulary.bytes, ids) == (text or "").encode())
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, dtype=np.int32) if flat else np.empty(0, np.int32)))
            sizes = pa.array(np.diff(ends).astype(np.int32))
            columns = [sizes, pa.array(scores, pa.float64()), lists, pa.array(others, _ALTERNATIVES), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *columns], names=[*kept, *new.names])

    return docs.select(*kept, "text").mapInArrow(run, schema)


def decode(rows: DataFrame, vocabulary: Vocabulary, ids: str = "ids") -> DataFrame:
    """Adds ``text``, decoded from the column of ids; null ids give null."""
    pieces = vocabulary.bytes

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lists in batches:
            yield lists.map(lambda x: None if x is None else decoded(pieces, x).decode("utf-8", "replace"))

    return rows.withColumn("text", text(F.col(ids)))


def alternative_ids(ids: Column, changes: Column) -> Column:
    """The ids of an alternative: the stretches between its changes, and what the changes put there."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(
        changes,
        start,
        lambda acc, c: F.struct((c["start"] + c["size"]).alias("at"), F.concat(acc["out"], F.slice(ids, acc["at"] + 1, c["start"] - acc["at"]), c["ids"]).alias("out")),
        lambda acc: F.concat(acc["out"], F.slice(ids, acc["at"] + 1, F.size(ids) - acc["at"])),
    )
