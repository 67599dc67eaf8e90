"""Best-fit packing by a length histogram.

Documents become pieces of at most CAPACITY tokens. Only the histogram of piece lengths, at most CAPACITY
rows, reaches the driver, which plans by best-fit decreasing over counts: a length's pieces go to the open
sequences with the least room that still takes them, whole groups of equal sequences at a time. The plan is
a bounded table of slots; pieces take theirs by joining on their rank within their length. Ranks come from
counts of hashed cells, so that a length that most pieces share is ranked by many tasks.

A null or empty text is one piece with the end id alone. Repeated rows are pieces of their own.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vectors
from .common import keep, ready

CAPACITY, END = 2048, 0
#: Chunks a worker remembers, and bytes of text it encodes together; neither changes a result.
MEMO, SLICE = 800_000, 1 << 22
#: New chunks that the library encodes in one text: it keeps a hundred bytes and more for each token.
TOGETHER = 1 << 14
#: Pieces that one cell of a rank holds on average, and cells that are counted together.
CELL, RUN = 4000, 1000


class Encoder:
    """Encodes columns of texts by their chunks, which it remembers as little-endian 32-bit ids.

    The vocabulary's splitter never joins what spaces part, so a text is the ids of its chunks in a row. New chunks of
    letters alone go to the library together, in one text, and are cut where the bytes that ids stand for have reached a
    chunk's end; chunks for which that doesn't hold are encoded one by one.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.memo: dict[str, bytes] = {}
        self.most = MEMO
        vocabulary = self.library.get_vocab()
        self.size = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes; each byte is one character of the vocabulary
        self.ends = np.zeros(len(self.size), bool)
        for token, i in vocabulary.items():
            self.size[i], self.ends[i] = len(token.removesuffix("</w>")), token.endswith("</w>")
        whole, parts = self.ids(["It's  a\nb\tCafé 12,x\r\x0bq\x0cz\n"]), self.ids(["It's", "a", "b", "Café", "12,x", "q", "z"])
        if whole != [b"".join(parts)]:
            raise ValueError("this vocabulary doesn't part words at spaces")

    def ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, chunks: list[str]) -> None:
        """Remembers chunks; a mark after a letter stands alone, so a word with one is learnt as the word."""
        marked = [c for c in chunks if c[-1] in ",." and c[-2:-1].isalpha()]
        new = set(chunks).difference(marked).union(c[:-1] for c in marked).difference(self.memo)
        single = [c for c in new if c.isalpha() and (c.isascii() or c.lower().isalpha())]
        other = list(new.difference(single)) + [",", "."]
        for at in range(0, len(single), TOGETHER):
            other += self._learn_single(single[at : at + TOGETHER])
        self.memo.update(zip(other, self.ids(other), strict=True))
        self.memo.update((c, self.memo[c[:-1]] + self.memo[c[-1]]) for c in marked)

    def _learn_single(self, single: list[str]) -> list[str]:
        """Remembers chunks of letters; gives back those that must be encoded one by one."""
        ids = np.frombuffer(self.ids([" ".join(single)])[0], "<u4")
        size = [len(c) if c.isascii() else len(unicodedata.normalize("NFC", c).lower().encode()) for c in single]
        last = np.flatnonzero(self.ends[ids]) + 1
        if len(last) != len(single) or not np.array_equal(np.cumsum(self.size[ids])[last - 1], np.cumsum(size)) or last[-1] != len(ids):
            return single
        raw, bounds = ids.tobytes(), [0, *(4 * last).tolist()]
        self.memo.update(zip(single, map(raw.__getitem__, map(slice, bounds, bounds[1:])), strict=True))
        return []

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each text's followed by the end id, and the places where each begins and the last ends."""
        if len(self.memo) > self.most:
            self.memo.clear()
        flat, count = vectors.words(texts)
        coded = flat.dictionary_encode()
        del flat  # here and below, what is not needed any more makes room
        chunks = coded.dictionary.to_pylist()
        self.learn([c for c in chunks if c not in self.memo])
        known = [*map(self.memo.__getitem__, chunks), np.array([end], "<u4").tobytes()]
        size = np.fromiter(map(len, known), np.int32, len(known)) // 4
        after = np.cumsum(count)
        at = np.insert(coded.indices.to_numpy(), after, len(chunks))  # the end id after each text's chunks
        raw = np.frombuffer(b"".join(known), "<u4")
        del coded, chunks, known
        long = size[at]
        done = np.cumsum(long, dtype=np.int64)
        bounds = np.concatenate([[0], done[after + np.arange(len(after))]])
        total = int(bounds[-1])
        # Places as 32-bit numbers where they fit, as there are many of them.
        kind = np.int32 if max(total, int(size.sum(dtype=np.int64))) < 2**31 else np.int64
        begin = (np.cumsum(size, dtype=np.int64) - size).astype(kind)
        shift = begin[at] - done.astype(kind)
        shift += long
        del at, done
        place = np.repeat(shift, long)
        place += np.arange(total, dtype=kind)
        return raw[place], bounds


def encoder(path: str) -> Encoder:
    """One encoder a worker."""
    return vectors.only(f"encoder {path}", lambda: Encoder(path))


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END, with_ids: bool = False, room: tuple[int, int] = (MEMO, SLICE)) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every document, cut only where it exceeds capacity; with_ids adds the ids.

    room: chunks a worker remembers, and bytes of text it encodes together; less takes less memory and more time.
    """
    ready(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]

    @partial(vectors.tidied, holds=True)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        coder.most = room[0]
        for batch, first, texts in ((b, *part) for b in batches for part in vectors.slices(b.column(1), room[1])):
            ids, bounds = coder.encode(texts, end)
            number = -(-np.diff(bounds) // capacity)
            row = np.repeat(np.arange(len(number)), number)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
            begin = bounds[row] + piece * capacity
            stop = np.minimum(begin + capacity, bounds[row + 1])
            raw = memoryview(ids).cast("B")
            out = [
                batch.column(0).take(pa.array(row + first)),
                pa.array(piece.astype(np.int32)),
                pa.array(piece * capacity),
                pa.array(stop - begin),
                pa.array([zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(begin.tolist(), stop.tolist())], pa.int64()),
            ]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([begin, bounds[-1:]]).astype(np.int32)), pa.array(ids.view(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names=names)

    schema = f"{id_col} {kind}, piece int, start long, length long, ids_crc32 long"
    return docs.select(id_col, text_col).mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Slots (length, first rank, ranks, first sequence, pieces a sequence, offset) for counts of lengths.

    A group is a run of sequences filled alike, (room, first sequence, number). Taking a length from a group splits it in
    at most three, so the plan has a few rows for each distinct length, however many pieces there are.
    """
    rooms: list[tuple[int, int, int]] = []  # ascending
    slots, fresh = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            i = bisect_left(rooms, (length,))
            if i < len(rooms):
                room, first, number = rooms.pop(i)
            else:
                room, first = capacity, fresh
                number = -(-left // (capacity // length))
                fresh += number
            each = min(room // length, left)
            filled = min(number, left // each)
            took = filled * each
            slots.append((length, rank, took, first, each, capacity - room))
            if room > each * length:
                insort(rooms, (room - each * length, first, filled))
            if filled < number:
                insort(rooms, (room, first + filled, number - filled))
            left, rank = left - took, rank + took
    return slots


def assign(cut: DataFrame, key: list[str], capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces; key tells pieces apart and orders them within a length (ties are rows alike)."""
    spark = cut.sparkSession
    counts = cut.groupBy("length").count().collect()  # a row for each length up to capacity
    histogram = {r["length"]: r["count"] for r in counts}
    # A length has as many cells as its number of pieces asks for; ranks are those within a cell, a run of cells, and a length.
    parts = spark.createDataFrame([(n, -(-c // CELL)) for n, c in histogram.items()], "length long, _cells long")
    celled = cut.join(F.broadcast(parts), "length").withColumn("_cell", F.pmod(F.xxhash64(*key), F.col("_cells"))).drop("_cells")
    sizes = celled.groupBy("length", "_cell").count().withColumn("_run", F.floor(F.col("_cell") / RUN))
    earlier = lambda by, order, what: F.coalesce(F.sum(what).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = sizes.groupBy("length", "_run").agg(F.sum("count").alias("_size")).withColumn("_start", earlier(["length"], "_run", "_size")).drop("_size")
    sizes = sizes.withColumn("_in_run", earlier(["length", "_run"], "_cell", "count")).join(runs, ["length", "_run"])
    sizes = sizes.select("length", "_cell", (F.col("_start") + F.col("_in_run")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("length", "_cell").orderBy(*key)) - 1
    ranked = celled.withColumn("_within", within).join(sizes, ["length", "_cell"]).withColumn("_rank", F.col("_before") + F.col("_within"))
    slots = plan(histogram, capacity)
    table = spark.createDataFrame(slots or [(0, 0, 0, 0, 1, 0)], "length long, _first long, _ranks long, _sequence long, _each long, _offset long")
    by = table.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("_first", "_ranks", "_sequence", "_each", "_offset"))).alias("_slots"))
    # The slots of one length are few; all of them together are a few rows for each of at most capacity lengths.
    out = ranked.join(F.broadcast(by), "length")
    slot = F.get(F.filter("_slots", lambda s: (s["_first"] <= F.col("_rank")) & (F.col("_rank") < s["_first"] + s["_ranks"])), 0)
    out = out.withColumn("_slot", slot).withColumn("_in", F.col("_rank") - F.col("_slot._first"))
    return out.select(
        *cut.columns,
        F.expr("_slot._sequence + _in div _slot._each").alias("sequence_id"),
        F.expr("_slot._offset + (_in % _slot._each) * length").alias("offset"),
    )


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, room: tuple[int, int] = (MEMO, SLICE)) -> DataFrame:
    """Every piece of docs with its sequence and place there."""
    cut = keep(pieces(docs, path, id_col, text_col, capacity, room=room), "pieces")
    return assign(cut, [id_col, "piece", "ids_crc32"], capacity)
