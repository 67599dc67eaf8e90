"""SentencePiece encoding and decoding for merge-type vocabularies.

Every word is encoded by a score-ordered agenda: all adjacent symbol pairs whose concatenation is a
piece stand in an agenda by score (best first, leftmost on ties); the best pair merges and its new
neighbours enter the agenda. Words recur, so a worker remembers the words it has encoded (bounded by
``MEMO`` entries). Every text is encoded and decoded by the sentencepiece library as well, whole, and
marked if the two differ.

Nulls and empty texts give the end id alone. Texts of any length are encoded whole; columns other
than the id and the text are not read. Repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import string
from collections.abc import Iterator
from itertools import chain, pairwise

import pyarrow as pa
from pyspark.sql import DataFrame

from . import vectors
from .common import ready

SPACE = "▁"
#: Words a worker remembers; beyond that it starts afresh, which changes no result.
MEMO = 1_800_000
#: Words of up to so many symbols keep their agenda in a list, longer ones in a heap.
SHORT, NEVER = 48, float("inf")


class Memo(dict):
    """Encodes a key when it is first asked for."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, key: str) -> tuple[int, ...]:
        self[key] = out = self.encode(key)
        return out


class PieceModel:
    """A merge-type sentencepiece model with identity normalisation and a dummy prefix."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(lib.get_piece_size())
        names = [lib.id_to_piece(i) for i in ids]
        self.eos = lib.eos_id()
        self.byte = {int(n[3:5], 16): i for i, n in enumerate(names) if lib.is_byte(i)}
        special = [lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) for i in ids]
        self.id = {n: i for i, n in enumerate(names) if not special[i]}
        self.cost = {n: -lib.get_score(i) for n, i in self.id.items()}
        if any(SPACE in n.lstrip(SPACE) for n in self.id) or any("\n" in n for n in self.id):
            raise ValueError("pieces of this model cross words; texts can't be split before encoding")
        if any(lib.is_unused(i) for i in ids) or lib.encode(" a  bΩ") != lib.encode(" a  bΩ".replace(" ", SPACE)):
            raise ValueError("the model must have identity normalisation and no unused pieces")
        self.surface = [n.replace(SPACE, " ") for n in names]
        self.spaced = {i for n, i in self.id.items() if n[0] == SPACE}
        for i in ids:
            if lib.is_control(i):
                self.surface[i] = ""
            elif lib.is_unknown(i):
                self.surface[i] = " ⁇ "
        self.value = {i: b for b, i in self.byte.items()}
        self.high = {i for b, i in self.byte.items() if b >= 0x80}
        for b, i in self.byte.items():
            self.surface[i] = chr(b) if b < 0x80 else "�"
        self.text = [str(i) for i in ids]
        self.runs = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n[^{SPACE}\n]*")
        follow = {b for n in self.id for a, b in pairwise(n) if a.isalpha()}
        self.marks = "".join(c for c in string.punctuation if c not in follow)
        self.memo, self.tails = Memo(self.encode_key), Memo(self.encode_word)

    def encode_key(self, key: str) -> tuple[int, ...]:
        """A line feed is in no piece and stands alone; no piece crosses from a letter to one of the marks, so a word is encoded once for all marks after it."""
        bare = key.rstrip(self.marks)
        if len(bare) < len(key) and bare[-1:].isalpha():
            return self.memo[bare] + self.tails[key[len(bare) :]]
        if key[:1] == "\n":
            return (self.byte[10], *self.encode_word(key[1:]))
        return self.encode_word(SPACE + key)

    def encode_word(self, word: str) -> tuple[int, ...]:
        """Merges the symbols of one word by an agenda of adjacent pairs."""
        sym = self.merge_short(word) if len(word) <= SHORT else self.merge_long(word)
        try:
            return tuple(map(self.id.__getitem__, sym))
        except KeyError:  # no such piece: its bytes
            return tuple(chain.from_iterable((self.id[x],) if x in self.id else map(self.byte.__getitem__, x.encode()) for x in sym))

    def merge_short(self, word: str) -> list[str]:
        """The agenda is a list with a cost for each place between symbols: its least entry merges first."""
        sym, cost = list(word), self.cost.get
        agenda = [cost(a + b, NEVER) for a, b in pairwise(sym)]
        while agenda and (best := min(agenda)) < NEVER:
            i = agenda.index(best)
            sym[i : i + 2] = [joined := sym[i] + sym[i + 1]]
            del agenda[i]
            if i < len(agenda):
                agenda[i] = cost(joined + sym[i + 1], NEVER)
            if i:
                agenda[i - 1] = cost(sym[i - 1] + joined, NEVER)
        return sym

    def merge_long(self, word: str) -> list[str]:
        """The agenda is a heap, so that words of any length take n log n steps."""
        sym, cost = list(word), self.cost
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(cost[x], i, x) for i, x in enumerate(map("".join, pairwise(sym))) if x in cost]
        heapq.heapify(agenda)
        while agenda:
            _, i, joined = heapq.heappop(agenda)
            # An entry is stale once either side has merged: its parts no longer make up the piece.
            if not sym[i] or (j := after[i]) >= n or sym[i] + sym[j] != joined:
                continue
            sym[i], sym[j] = joined, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (wider := joined + sym[k]) in cost:
                    heapq.heappush(agenda, (cost[wider], i, wider))
            if (h := before[i]) >= 0 and (wider := sym[h] + joined) in cost:
                heapq.heappush(agenda, (cost[wider], h, wider))
        return [x for x in sym if x]

    def keys(self, text: str) -> list[str]:
        """Cuts a text where no piece crosses. A key is a word that a space or the dummy prefix precedes, or a line feed and the word straight after it."""
        if not text:
            return []
        if "  " in text or text[0] == " " or SPACE in text:  # runs of spaces go with the word after them
            return [x[1:] if x[0] == SPACE else x if x[0] == "\n" else "\n" + x for x in self.runs.findall((SPACE + text).replace(" ", SPACE))]
        return text.replace("\n", " \n").split(" ")

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text with the end id."""
        memo = self.memo
        if len(memo) + len(self.tails) > MEMO:
            memo.clear()
            self.tails.clear()
        return [[*chain.from_iterable(map(memo.__getitem__, self.keys(t))), self.eos] for t in texts]

    def agrees(self, text: str, ids: list[int], decoded: str) -> bool:
        """Whether the library encodes the text to these ids and decodes them to this text."""
        return self.library.encode(text, add_eos=True) == ids and self.library.decode(ids) == decoded

    def decode(self, ids: list[int]) -> str:
        """The text of ids: one leading space is the dummy prefix; runs of byte ids are UTF-8."""
        if self.high.isdisjoint(ids):
            text = "".join(map(self.surface.__getitem__, ids))
        else:
            parts: list[str] = []
            run = bytearray()
            for i in ids:
                if i in self.value:
                    run.append(self.value[i])
                    continue
                if run:
                    parts.append(_utf8(run))
                    run = bytearray()
                parts.append(self.surface[i])
            text = "".join([*parts, _utf8(run)])
        first = next((i for i in ids if self.surface[i]), -1)
        return text[1:] if text.startswith(" ") and first in self.spaced else text


def _utf8(run: bytearray) -> str:
    """Bytes that are no valid character give one replacement character each."""
    out, at = [], 0
    while at < len(run):
        for size in (1, 2, 3, 4):
            try:
                out.append(bytes(run[at : at + size]).decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def model(path: str) -> PieceModel:
    """One model a worker."""
    return vectors.only(f"pieces {path}", lambda: PieceModel(path))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encodes every text with an end id and decodes it again.

    Returns id, n_tokens, ids_sha256, decoded_sha256 and library_agrees (the library encodes the
    whole text alike, and decodes its ids alike); with_ids adds the ids and the decoded text themselves.
    """
    ready(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):  # few texts at a time bound the memory of long ones
                batch = whole.slice(at, 256)
                given = [t or "" for t in batch.column(1).to_pylist()]
                ids = m.encode_batch(given)
                texts = [m.decode(x) for x in ids]
                agrees = list(map(m.agrees, given, ids, texts))
                out = [
                    batch.column(0),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(" ".join(map(m.text.__getitem__, x)).encode()).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
                    pa.array(agrees, pa.bool_()),
                ]
                names = ["id", "n", "ids_sha256", "decoded_sha256", "agrees"]
                if with_ids:
                    out += [pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(out, names=names)

    schema = f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, library_agrees boolean"
    return docs.select(id_col, text_col).mapInArrow(run, schema + (", ids array<int>, decoded string" if with_ids else ""))
