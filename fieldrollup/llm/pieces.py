"""SentencePiece encoding, decoding and counting by shared-prefix dynamic programming.

Distinct marked words are sorted, which is the depth-first order of their trie, and walked
with one forward table: a word reuses the entries of the prefix that it shares with the
word before, so that each node of the trie is computed once.

An entry holds, for a prefix, what is needed to extend it:

* unigram models: the best forward score and its last piece (Viterbi);
* BPE models: the last piece of the prefix's encoding. Scores of such a model are merge
  ranks, and the best sum of them is not the model's encoding. But adjacent pieces of a BPE
  encoding are exactly those whose own concatenation is encoded as the two, so that the last
  piece of a prefix is the one that is compatible with the last piece of what precedes it.
  An automaton over the pieces tells which of them end at a character, and its node is
  part of the entry. Only words that begin with several space marks are merged by definition.

Words begin at runs of spaces. No piece holds a space mark after another character, so that
no piece crosses the begin of a word; the reader checks that. Line ends and tabs are words
of their own where no longer piece holds them. Nothing is shuffled, and a worker's memory of
known words is bounded.
"""

from __future__ import annotations

import heapq
import re
import struct
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldrollup.llm.tokens import KEPT, lean

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Words that a worker remembers at most, and text bytes that are handled at once.
KNOWN_WORDS, SLICE_CHARS = 250_000, 4 << 20
UNKNOWN_PENALTY = 10.0


def _varint(data: bytes, at: int) -> tuple[int, int]:
    shift = value = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(kind, 0)
            if kind == 2:
                size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class PieceModel:
    """A model file's pieces, and encoding by the shared-prefix walk."""

    def __init__(self, data: bytes):
        pieces, trainer, normalizer = [], {}, {}
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                pieces.append((own[1].decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, 1)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        # fixed values of the file format: kinds of models and of pieces
        self._setup(pieces, {1: "unigram", 2: "bpe"}.get(trainer.get(3, 1), ""), bool(normalizer.get(3, 1)))
        if normalizer.get(2) or normalizer.get(4, 1):
            raise ValueError("only models with the identity normaliser that keep extra spaces are supported")

    @classmethod
    def of(cls, pieces: list[tuple[str, float, int]], kind: str, prefix: bool = True) -> PieceModel:
        self = cls.__new__(cls)
        self._setup(pieces, kind, prefix)
        return self

    def _setup(self, pieces, kind: str, prefix: bool) -> None:
        if kind not in ("unigram", "bpe"):
            raise ValueError("not a unigram or BPE model")
        normal, unknown, byte = 1, 2, 6
        self.kind, self.prefix = kind, prefix
        self.ids = {p: i for i, (p, _, t) in enumerate(pieces) if t == normal}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece crosses the begin of a word")
        self.scores = [s for _, s, _ in pieces]
        self.longest = max(map(len, self.ids))
        self.unknown = next((i for i, (_, _, t) in enumerate(pieces) if t == unknown), 0)
        self.byte_ids = {int(p[1:-1], 16): i for i, (p, _, t) in enumerate(pieces) if t == byte}
        self.of_byte = {i: b for b, i in self.byte_ids.items()}
        self.bytes = [bytes([self.of_byte[i]]) if t == byte else p.replace(MARK, " ").encode() if t == normal else b"" for i, (p, _, t) in enumerate(pieces)]
        self.floor = min((self.scores[i] for i in self.ids.values()), default=0.0) - UNKNOWN_PENALTY
        apart = "".join(c for c in "\t\n\x0b\x0c\r" if not any(c in p for p in self.ids if len(p) > 1))
        self._word = re.compile(f"{MARK}+[^{MARK}{apart}]*|[^{MARK}{apart}]+" + f"|[{apart}]" * bool(apart))
        self._fits: dict[int, bool] = {}
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._text = {i: p for p, i in self.ids.items()}
        self.sizes = [len(p) for p, _, _ in pieces]
        self._goto: dict[int, int] = {}
        self._child: dict[int, int] = {}
        self._automaton()

    def char_ids(self, char: str) -> list[int]:
        """Pieces of a character that is none itself: its bytes, or the unknown piece."""
        return [self.byte_ids[b] for b in char.encode()] if self.byte_ids else [self.unknown]

    def merge(self, word: str) -> list[str]:
        """BPE as it is defined: the best-scored adjacent pair first, the leftmost of equals."""
        return self._merge(word)[0]

    def _merge(self, word: str) -> tuple[list[str], tuple[str, str]]:
        """(the pieces, the two that the last merge joined)."""
        parts: list[str | None] = list(word)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, int, str]] = []
        joined = ("", "")

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else len(parts)
            if 0 <= i and j < len(parts):
                both = parts[i] + parts[j]
                if both in self.ids:
                    heapq.heappush(heap, (-self.scores[self.ids[both]], i, j, both))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if parts[i] is None or j >= len(parts) or parts[j] is None or after[i] != j or parts[i] + parts[j] != both:
                continue
            joined = (parts[i], parts[j])
            parts[i], parts[j] = both, None
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [p for p in parts if p is not None], joined

    def _made_of(self, piece: int) -> tuple[int, int] | None:
        """The pieces that a piece is merged from at last, itself twice for a character; None if merging doesn't give it."""
        if piece not in self._halves:
            text = self._text[piece]
            parts, (left, right) = self._merge(text)
            whole = (self.ids[left], self.ids[right]) if left else (piece, piece)
            self._halves[piece] = whole if len(parts) == 1 else None
        return self._halves[piece]

    def _alone(self, piece: int) -> bool:
        return self._made_of(piece) is not None

    def _compatible(self, key: int) -> bool:
        """Whether two pieces are what their concatenation is encoded as. key: both ids, 24 bits each."""
        x, y = key >> 24, key & 0xFFFFFF
        if len(self._fits) > 1 << 20:
            self._fits.clear()
        if MARK + MARK in self._text[x] + self._text[y]:  # equal scores
            ok = self.merge(self._text[x] + self._text[y]) == [self._text[x], self._text[y]]
        else:
            ok = self._alone(x) and self._alone(y) and self._stay_apart(x, y)
        self._fits[key] = ok
        return ok

    def _stay_apart(self, x: int, y: int) -> bool:
        """Whether no merge crosses the border of two pieces that are each merged to one.

        The merges at the border are undone from the last one on. Between two of them, the
        pieces at the border would have merged if theirs came first; of equal scores the left one does.
        """
        # the merge undone last: its place in the order, and whether it was on the left
        turn, on_left = float("inf"), False
        while True:
            both = self.ids.get(self._text[x] + self._text[y])
            if both is not None and (-self.scores[both] < turn or -self.scores[both] == turn and not on_left):
                return False
            made_x, made_y = (-self.scores[p] if self.sizes[p] > 1 else -float("inf") for p in (x, y))
            if made_x == made_y == -float("inf"):
                return True
            on_left = made_x > made_y
            turn = max(made_x, made_y)
            if on_left:
                x = self._made_of(x)[1]
            else:
                y = self._made_of(y)[0]

    def _automaton(self) -> None:
        """The trie of pieces with the longest proper suffix of each node: a node tells which pieces end here, longest first."""
        child, fail, ends = self._child, [0], [()]
        level = [(0, piece, i) for piece, i in self.ids.items()]
        for depth in range(self.longest):
            rest, own = [], []
            for node, piece, i in level:
                key = node << 21 | ord(piece[depth])
                below = child.get(key)
                if below is None:
                    below = child[key] = len(fail)
                    fail.append(self._suffix(fail, fail[node], key & 0x1FFFFF) if node else 0)
                    ends.append(ends[fail[below]])
                if len(piece) == depth + 1:
                    own.append((below, i))
                else:
                    rest.append((below, piece, i))
            for below, i in own:
                ends[below] = ((depth + 1, i), *ends[below])
            level = rest
        self._fail, self._ends = fail, ends

    def _suffix(self, fail: list, node: int, char: int) -> int:
        while node and (node << 21 | char) not in self._child:
            node = fail[node]
        return self._child.get(node << 21 | char, 0)

    def _step(self, key: int) -> int:
        """The automaton's node after one more character. key: node and character."""
        if len(self._goto) > 1 << 20:
            self._goto.clear()
        to = self._goto[key] = self._suffix(self._fail, key >> 21, key & 0x1FFFFF)
        return to

    def walk(self, words: list[str]) -> Iterator[tuple[str, list[int], list[int]]]:
        """The depth-first walk over sorted words: each word with its forward table.

        The table holds the last piece (-1: a character that is no piece) and the tokens of
        each prefix, by its length.
        """
        fill = self._fill_bpe if self.kind == "bpe" else self._fill_unigram
        last, count, state = [-2], [0], [0 if self.kind == "bpe" else 0.0]
        path = ""
        for word in words:
            shared, beyond = 0, min(len(path), len(word)) + 1
            while beyond - shared > 1:
                middle = (shared + beyond) // 2
                if word.startswith(path[shared:middle], shared):
                    shared = middle
                else:
                    beyond = middle
            del last[shared + 1 :], count[shared + 1 :], state[shared + 1 :]
            fill(word, shared, last, count, state)
            path = word
            yield word, last, count

    def _by_definition(self, word: str) -> bool:
        """Pairs don't tell how a run of space marks is encoded, as its merges have equal scores."""
        return self.kind == "bpe" and word.startswith(MARK + MARK)

    def _merged_ids(self, word: str) -> list[int]:
        return list(chain.from_iterable([self.ids[p]] if p in self.ids else self.char_ids(p) for p in self.merge(word)))

    def encode_sorted(self, words: list[str]) -> Iterator[list[int]]:
        """Ids of each of the sorted words."""
        sizes = self.sizes
        for word, last, _ in self.walk(words):
            if self._by_definition(word):
                yield self._merged_ids(word)
                continue
            out, i = [], len(word)
            while i:
                piece = last[i]
                if piece >= 0:
                    out.append(piece)
                    i -= sizes[piece]
                else:
                    i -= 1
                    out.extend(reversed(self.char_ids(word[i])))
            out.reverse()
            yield out

    def count_sorted(self, words: list[str]) -> Iterator[int]:
        """Tokens of each of the sorted words: what the table holds at a word's end."""
        for word, _, count in self.walk(words):
            yield len(self._merged_ids(word)) if self._by_definition(word) else count[-1]

    def _fill_bpe(self, word: str, begin: int, last: list, count: list, state: list) -> None:
        goto, known, ends = self._goto.get, self._fits.get, self._ends
        node, i = state[begin], begin
        for char in word[begin:]:
            i += 1
            key = node << 21 | ord(char)
            node = goto(key)
            if node is None:
                node = self._step(key)
            for size, piece in ends[node]:
                previous = last[i - size]
                if previous >= 0:
                    key = previous << 24 | piece
                    ok = known(key)
                    if ok is None:
                        ok = self._compatible(key)
                else:
                    ok = self._alone(piece)
                if ok:
                    last.append(piece)
                    count.append(count[i - size] + 1)
                    break
            else:  # no piece ends here: a character that is none
                if char in self.ids:
                    raise AssertionError(f"no encoding for {word[:i]!r}")
                last.append(-1)
                count.append(count[-1] + len(self.char_ids(char)))
            state.append(node)

    def _fill_unigram(self, word: str, begin: int, last: list, count: list, state: list) -> None:
        """Viterbi; the state is the best forward score."""
        for i in range(begin + 1, len(word) + 1):
            best, piece_of, at = -float("inf"), -1, i - 1
            for j in range(max(0, i - self.longest), i):
                piece = self.ids.get(word[j:i])
                if piece is not None and state[j] + self.scores[piece] > best:
                    best, piece_of, at = state[j] + self.scores[piece], piece, j
            if word[i - 1] not in self.ids and state[i - 1] + self.floor > best:
                best, piece_of, at = state[i - 1] + self.floor, -1, i - 1
            last.append(piece_of)
            count.append(count[at] + (1 if piece_of >= 0 else len(self.char_ids(word[i - 1]))))
            state.append(best)

    def split(self, text: str) -> list[str]:
        """A text's marked words; none for an empty text."""
        if not text:
            return []
        return self._word.findall((MARK if self.prefix else "") + text.replace(" ", MARK))

    def encode(self, text: str) -> list[int]:
        words = self.split(text)
        known = dict(zip(sorted(set(words)), self.encode_sorted(sorted(set(words))), strict=True))
        return list(chain.from_iterable(known[w] for w in words))

    def marked(self, word: str) -> bytes:
        """What the pieces of a word should decode to."""
        return word.replace(MARK, " ").encode()

    def decode(self, ids) -> str:
        """The text of a sequence of ids, without the prefix space; broken bytes become U+FFFD."""
        data = b"".join(map(self.bytes.__getitem__, ids))
        return (data[1:] if self.prefix and data[:1] == b" " else data).decode("utf-8", "replace")


class WordBook:
    """A worker's known words: their ids (or only how many) and whether these decode to the word.

    Flat arrays, bounded by KNOWN_WORDS; a worker keeps its book from task to task. A full
    book keeps the words that came again in a later slice, and is emptied if these fill it.
    """

    def __init__(self, model: PieceModel, counts_only: bool):
        self.model, self.counts_only = model, counts_only
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.lengths, self.flat, self.exact, self.again = array("i"), array("i"), array("b"), bytearray()

    def _make_room(self) -> None:
        """Forgets the words that haven't come again since the last time."""
        again = np.frombuffer(self.again, np.uint8) > 0
        if 2 * np.count_nonzero(again) > KNOWN_WORDS:
            self.clear()
            return
        lengths = np.array(self.lengths, dtype=np.int32)
        words = [w for w, old in self.place.items() if self.again[old]]  # in the order of their places
        self.place = dict(zip(words, range(len(words)), strict=True))
        if not self.counts_only:
            self.flat = array("i", np.array(self.flat, dtype=np.int32)[np.repeat(again, lengths)].tobytes())
            self.exact = array("b", np.array(self.exact, dtype=np.int8)[again].tobytes())
        self.lengths = array("i", lengths[again].tobytes())
        self.again = bytearray(len(words))

    def places(self, words: list[str]) -> np.ndarray:
        if len(self.place) > KNOWN_WORDS:
            self._make_room()
        number: defaultdict[str, int] = defaultdict()
        number.default_factory = number.__len__
        code = np.fromiter(map(number.__getitem__, words), np.int32, len(words))
        distinct = list(number)
        new = sorted(w for w in distinct if w not in self.place)
        n_old = len(self.lengths)
        # copies lie side by side, so that the memory of the words that aren't kept is free as a whole
        self.place.update(zip([(w + MARK)[:-1] for w in new], range(len(self.lengths), len(self.lengths) + len(new)), strict=True))
        if self.counts_only:
            self.lengths.extend(self.model.count_sorted(new))
        else:
            begin = len(self.flat)
            for ids in self.model.encode_sorted(new):
                self.lengths.append(len(ids))
                self.flat.extend(ids)
            self.exact.extend(self._decode_again(new, self.flat[begin:]))
        self.again.extend(bytes(len(new)))
        known = np.fromiter(map(self.place.__getitem__, distinct), np.int64, len(distinct))
        np.frombuffer(self.again, np.uint8)[known[known < n_old]] = 1
        return known[code]

    def _decode_again(self, new: list[str], ids: array) -> list[bool]:
        """Whether the ids of each new word decode to it: all at once, and one by one only if something differs."""
        of = self.model.bytes.__getitem__
        if b"".join(map(of, ids)) == self.model.marked("".join(new)):
            return [True] * len(new)
        ends = np.cumsum(self.lengths[len(self.lengths) - len(new) :]).tolist()
        return [b"".join(map(of, ids[a:b])) == self.model.marked(word) for word, a, b in zip(new, [0, *ends], ends, strict=False)]

    def gather(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words one after another, ids before each word and of all)."""
        lengths = np.array(self.lengths, dtype=np.int64)
        begin, own = np.cumsum(lengths) - lengths, lengths[place]
        edge = np.concatenate([[0], np.cumsum(own)])
        at = np.repeat(begin[place] - edge[:-1], own) + np.arange(edge[-1])
        return np.array(self.flat, dtype=np.int32)[at], edge


def _book(data: bytes, counts_only: bool) -> WordBook:
    """The worker's book for a model."""
    if KEPT.get("model") != data:
        KEPT.clear()
        KEPT["model"] = data
    book = KEPT.get(counts_only)
    if book is None:
        other = KEPT.get(not counts_only)
        book = KEPT[counts_only] = WordBook(other.model if other else PieceModel(data), counts_only)
    return book


def _batches(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[str]]]:
    """Row ranges with their texts, about SLICE_CHARS each."""
    column = batch.column(batch.schema.get_field_index("text"))
    at = 0
    while at < len(column):
        texts, size, end = [], 0, at
        while end < len(column) and (size < SLICE_CHARS or end == at):
            texts.append(column[end].as_py() or "")
            size += len(texts[-1])
            end += 1
        yield at, end, texts
        at = end


def _encoder(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = _book(model.value, False)
        for batch in batches:
            for a, b, texts in _batches(batch):
                words = [book.model.split(t) for t in texts]
                n_words = np.array([0, *map(len, words)], dtype=np.int64)
                place = book.places(list(chain.from_iterable(words)))
                del words, texts
                ids, before = book.gather(place)
                edge = np.cumsum(n_words)
                ends = before[edge]
                wrong = np.concatenate([[0], np.cumsum(np.array(book.exact)[place] == 0)])[edge]
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(ends).astype(np.int64)), lists, pa.array(np.diff(wrong) == 0)], ["doc_id", "n_pieces", "piece_ids", "exact"])

    return lean(run, keeps=True)


def _decoder(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _book(model.value, False).model
        for batch in batches:
            texts = [own.decode(x or ()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def _counter(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = _book(model.value, True)
        for batch in batches:
            for a, b, texts in _batches(batch):
                words = [book.model.split(t) for t in texts]
                n_words = np.array([len(w) for w in words], dtype=np.int64)
                place = book.places(list(chain.from_iterable(words)))
                del words, texts
                total = np.concatenate([[0], np.cumsum(np.array(book.lengths, dtype=np.int64)[place] if len(place) else place)])
                ends = np.cumsum(n_words)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n_words), pa.array(total[ends] - total[ends - n_words])], ["doc_id", "n_words", "n_tokens"])

    return lean(run, keeps=True)


def _shared_model(df: DataFrame, path: str):
    with open(path, "rb") as f:
        data = f.read()
    PieceModel(data)  # fails here, not on the executors
    return df.sparkSession.sparkContext.broadcast(data)  # a vocabulary file, of fixed size


def _mapped(df: DataFrame, id_col: str, col: str, run, schema: str) -> DataFrame:
    """(doc_id, what ``run`` makes of the column). Ids may be of any type."""
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{col}`").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {schema}")


def encode(df: DataFrame, model_path: str = MODEL_PATH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pieces, piece_ids, exact) for each input row, the ids as the model's library gives them.

    exact: decoding gives the text again. The space mark U+2581 in a text counts as a space,
    as in the library, and so decodes to one. Null and empty texts have no pieces; null ids stay null; repeated
    rows are encoded each; an empty table gives an empty result; further columns aren't looked at.
    """
    return _mapped(df, id_col, text_col, _encoder(_shared_model(df, model_path)), "n_pieces long, piece_ids array<int>, exact boolean")


def decode(df: DataFrame, model_path: str = MODEL_PATH, id_col: str = "doc_id", ids_col: str = "piece_ids") -> DataFrame:
    """(doc_id, text) from piece ids; null ids lists give empty texts."""
    return _mapped(df, id_col, ids_col, _decoder(_shared_model(df, model_path)), "text string")


def token_counts(df: DataFrame, model_path: str = MODEL_PATH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens) for each input row: pre-tokens and tokens of the whole text.

    Only counts are kept at the ends of words. Edge cases as in ``encode``.
    """
    return _mapped(df, id_col, text_col, _counter(_shared_model(df, model_path)), "n_words long, n_tokens long")
