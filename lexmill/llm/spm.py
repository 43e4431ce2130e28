"""SentencePiece encoding and decoding by a Viterbi pass over shared prefixes.

The vocabulary (a public BPE model with byte fallback) is read, never trained. A text is marked
(one mark in front, a mark for each blank) and falls into words: a run of marks and what follows
up to the next mark. No piece has a mark after another character, so words are independent.

The distinct words of a batch are sorted, which is a depth-first walk of their trie. The forward
state after each character is the last piece of the prefix's encoding and where it begins; a word
takes over the states of the prefix that it shares with the word before it and only computes the
rest. A plain sum of piece scores does not give the pieces of a merge-based model, so a step here
is scored by whether it may follow: a piece follows a prefix if the prefix's last piece and it stay
apart when their joined text is merged by itself. Merges are local and ordered, so exactly one
piece can end at each place, and the path is the model's own encoding, id for id.

Defined results: null and empty texts have no ids, and an empty table has no rows. Characters
outside the vocabulary become bytes. Decoding gives the text back, but for the mark character itself
(U+2581), which the format cannot tell from a blank: round_trip, the comparison of the decoded text
with the text, is false there. A text of any length is encoded whole, in time and memory that grow
with its length. Repeated rows are repeated; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
import struct
from array import array
from dataclasses import dataclass
from itertools import chain

from pyspark.sql import DataFrame, SparkSession

MARK = "▁"
WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
ONE = (1,)
BPE = 2  #: the model type in the file
NORMAL, BYTE = 1, 6  #: piece types in the file


@dataclass(frozen=True)
class SpmParams:
    model_path: str = "/opt/tokenizers/piece_bpe_32k.model"
    memo_words: int = 50_000  #: short words, the frequent ones, that a worker remembers between batches
    memo_letters: int = 7
    memo_pairs: int = 200_000
    path_letters: int = 64  #: up to here the forward state holds the ids so far, so that prefixes share them; beyond, they are read back
    batch_bytes: int = 8_000_000  #: texts encoded together, of which each distinct word is walked once


def _fields(data: bytes):
    """(number, value) of a serialised message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value = varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class Vocabulary:
    """Pieces and scores of a model file, with the encoder's memory."""

    def __init__(self, data: bytes, params: SpmParams = SpmParams()):
        self.pieces: list[str] = []
        self.rank: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.byte_ids: dict[int, int] = {}
        self.byte_of: dict[int, int] = {}
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                text, kind, at = piece[1].decode(), piece.get(3, NORMAL), len(self.pieces)
                self.pieces.append(text)
                if kind == BYTE:
                    self.byte_ids[int(text[3:5], 16)], self.byte_of[at] = at, int(text[3:5], 16)
                elif kind == NORMAL:
                    self.ids[text], self.rank[text] = at, struct.unpack("<f", piece[2])[0]
            elif number == 2 and dict(_fields(value)).get(3, 1) != BPE:
                raise ValueError("the model is not a merge-based one")
            elif number == 3 and dict(_fields(value)).get(1, b"identity") != b"identity":
                raise ValueError("the model normalises texts")
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            raise ValueError("a piece of the vocabulary spans words")
        if len(self.byte_ids) != 256:
            raise ValueError("the vocabulary lacks bytes")
        self.surface = {i: p.replace(MARK, " ") for p, i in self.ids.items()}
        self.params = params
        self.words: dict[str, tuple[int, ...]] = {}
        #: piece -> what is known of the pieces before it (last piece -> whether it may follow), and its own ids
        self.follow: dict[str, tuple[dict[str, bool], tuple[int, ...]]] = {p: ({}, (i,)) for p, i in self.ids.items()}
        self.pairs = 0
        self.lengths = self._lengths()

    def _lengths(self) -> dict[str, tuple[int, ...]]:
        """The lengths of the pieces with a given ending of one to three characters, longest first."""
        found: dict[str, set[int]] = {}
        for p in self.ids:
            for k in range(1, min(3, len(p)) + 1):
                if k == 3 or k == len(p):
                    found.setdefault(p[-k:], {1}).add(len(p))
        for ending, sizes in found.items():
            sizes.update(k for k in range(2, len(ending)) if ending[-k:] in self.ids)
        return {ending: tuple(sorted(sizes, reverse=True)) for ending, sizes in found.items()}

    def merged(self, text: str) -> list[str]:
        """The encoding of a short text by merging the best pair, leftmost first, until none is left."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.rank.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def may_follow(self, left: str, right: str) -> bool:
        apart = [left, right] if left else [right]
        known = (not left or left + right not in self.rank) and self.merged(left + right) == apart
        if self.pairs >= self.params.memo_pairs:
            self.pairs = 0
            for before, _ in self.follow.values():
                before.clear()
        self.pairs += 1
        self.follow[right][0][left] = known
        return known

    def walk(self, ordered: list[str]):
        """(word, ids) for words in sorted order."""
        starts, lasts, paths, before = [0], [""], [()], ""
        lengths, follow, most = self.lengths, self.follow, self.params.path_letters
        for word in ordered:
            shared = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                shared += 1
            del starts[shared + 1 :], lasts[shared + 1 :], paths[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                ending = word[end - 3 if end > 3 else 0 : end]
                for length in lengths.get(ending) or lengths.get(ending[-2:]) or ONE:
                    start = end - length
                    if start < 0:
                        continue
                    piece = word[start:end]
                    found = follow.get(piece)
                    if found is None:
                        if length > 1:
                            continue
                        own = self._bytes(piece)
                    else:
                        last = lasts[start]
                        known, own = found
                        apart = known.get(last)
                        if not apart and (apart is not None or not self.may_follow(last, piece)):
                            continue
                    starts.append(start)
                    lasts.append(piece)
                    if end <= most:
                        paths.append(paths[start] + own)
                    break
            end, tail = len(word), []
            while end > most:
                tail.append(lasts[end])
                end = starts[end]
            ids = paths[end]
            yield word, ids if not tail else ids + tuple(chain.from_iterable(map(self._ids_of, reversed(tail))))
            before = word

    def _ids_of(self, piece: str) -> tuple[int, ...]:
        return (self.ids[piece],) if piece in self.ids else self._bytes(piece)

    def _bytes(self, character: str) -> tuple[int, ...]:
        return tuple(self.byte_ids[b] for b in character.encode("utf-8", "surrogatepass"))

    def encode(self, texts: list[str | None]) -> tuple[list[array], list[bool]]:
        """Ids of each text, and whether they decode to it. Words are known by what follows their first mark."""
        split = [_words(t) for t in texts]
        known = self.words
        distinct = set(chain.from_iterable(split))
        new = sorted(distinct.difference(known))
        here = {w[1:]: ids for w, ids in self.walk([MARK + w for w in new])}
        keep = [w for w in new if len(w) < self.params.memo_letters][: max(0, self.params.memo_words - len(known))]
        here.update((w, known[w]) for w in distinct.intersection(known))
        known.update((w, here[w]) for w in keep)
        ids = [array("i", chain.from_iterable(map(here.__getitem__, words))) for words in split]
        return ids, [self.decode(i) == (t or "") for i, t in zip(ids, texts)]

    def decode(self, ids) -> str:
        """The text of ids, without the blank that stands for the first mark."""
        try:
            return "".join(map(self.surface.__getitem__, ids))[1:]
        except KeyError:  # bytes
            pass
        parts, waiting = [], bytearray()
        for i in ids:
            byte = self.byte_of.get(i)
            if byte is not None:
                waiting.append(byte)
                continue
            if waiting:
                parts.append(waiting.decode("utf-8", "replace"))
                waiting = bytearray()
            parts.append(self.pieces[i].replace(MARK, " "))
        if waiting:
            parts.append(waiting.decode("utf-8", "replace"))
        return "".join(parts)[1:]


def _words(text: str | None) -> list[str]:
    """The words of the marked text, each without its first mark. A split at blanks gives them if blanks only stand alone between words."""
    if not text:
        return []
    if "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
        return [w[1:] for w in WORDS.findall(MARK + text.replace(" ", MARK))]
    return text.split(" ")


def model_bytes(spark: SparkSession, path: str) -> bytes:
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).select("content").head()[0])
    with open(path, "rb") as f:
        return f.read()


_LOADED: dict[tuple, Vocabulary] = {}


def _vocabulary(data: bytes, params: SpmParams) -> Vocabulary:
    """One for each worker process, with what it remembers."""
    key = (len(data), hash(data), params)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Vocabulary(data, params)
    return _LOADED[key]


def parts_of(batch, most: int):
    """A batch in slices of about `most` bytes of text each, one row at least."""
    import pyarrow.compute as pc

    total, first = 0, 0
    for row, size in enumerate(pc.binary_length(batch.column("text")).to_pylist()):
        if total and total + (size or 0) > most:
            yield batch.slice(first, row - first)
            total, first = 0, row
        total += size or 0
    if batch.num_rows > first:
        yield batch.slice(first)


def encode(docs: DataFrame, params: SpmParams = SpmParams()) -> DataFrame:
    """doc_id, n_tokens, ids and round_trip (whether the decoded ids are the text), for each row of docs(doc_id, text)."""
    import pyarrow as pa

    data = docs.sparkSession.sparkContext.broadcast(model_bytes(docs.sparkSession, params.model_path))

    def run(batches):
        vocabulary = _vocabulary(data.value, params)
        for part in (p for b in batches for p in parts_of(b, params.batch_bytes)):
            ids, same = vocabulary.encode(part.column("text").to_pylist())
            offsets = [0]
            flat = array("i")
            for i in ids:
                flat.extend(i)
                offsets.append(len(flat))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.Array.from_buffers(pa.int32(), len(flat), [None, pa.py_buffer(flat)]))
            columns = [part.column("doc_id"), pa.array([len(i) for i in ids], pa.int64()), lists, pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, params: SpmParams = SpmParams()) -> DataFrame:
    """doc_id and text from doc_id and ids."""
    from lexmill.llm.common import map_lists

    data = encoded.sparkSession.sparkContext.broadcast(model_bytes(encoded.sparkSession, params.model_path))

    def run(batch: dict) -> dict:
        vocabulary = _vocabulary(data.value, params)
        return {"doc_id": batch["doc_id"], "text": [vocabulary.decode(ids or []) for ids in batch["ids"]]}

    return map_lists(encoded.select("doc_id", "ids"), run, "doc_id bigint, text string")
