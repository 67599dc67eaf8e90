"""Suffix-array dedup with sparse suffix arrays.

Of each text only the suffixes at content-selected positions are retained: the minimisers, by hash, of
``SEED``-word windows among every MIN_WORDS - SEED + 1 in a row, so that each run of MIN_WORDS words holds
one and equal runs hold the same. The suffixes are sorted by range over the whole cluster, and those whose
seed no other place has fall out. A position owns the runs of MIN_WORDS words whose minimiser it is, up to
35 in a row; every run has one owner, at the same offset wherever the run stands.

Two sorts then compare exactly, by equality and without pairs. Places that own the very same runs stand
together in the first; all but the first of them are later in each run. What is left is sorted run by run,
so any two places that share MIN_WORDS words meet, whatever else shares parts of these. Of the places of
a run the first by id, text and position is no later one, all others are.

Sorting by range deals a passage that very many texts share over many tasks. In the first sort each task
keeps a first place of its own; in the second, the first and last row of each task are compared on the driver.

Words are runs of anything but ASCII spaces, compared as they are, by 64-bit hashes of MIN_WORDS in a row.
Nulls, empty texts and texts of fewer words have no repeats; rows without an id are left out; of rows that
repeat an id and text one counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors
from .common import keep, partitions, ready

MIN_WORDS, SEED = 50, 16
#: How far right of a run's start its minimiser may be.
REACH = MIN_WORDS - SEED


def word_hashes(texts: pa.Array) -> Iterator[np.ndarray]:
    """The hashes of each text's words."""
    flat, count = vectors.words(texts)
    h = vectors.hashes(flat)
    end = np.cumsum(count)
    return (h[e - n : e] for e, n in zip(end.tolist(), count.tolist(), strict=True))


def seeds(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the retained suffixes of a text, the hashes of their seeds, and the first and the number of the runs each owns."""
    if len(words) < MIN_WORDS:
        return (np.zeros(0, np.int64),) * 4
    h = vectors.rolling(words, SEED)
    width = REACH + 1
    owner = np.lib.stride_tricks.sliding_window_view(h, width).argmin(1) + np.arange(len(h) - width + 1)
    at, first, count = np.unique(owner, return_index=True, return_counts=True)
    return at, h[at].view(np.int64), first, count


@vectors.tidied
def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, texts in vectors.slices(batch.column(2)):
            found = [seeds(words)[:2] for words in word_hashes(texts)]
            take = pa.array(np.repeat(np.arange(start, start + len(found)), [len(at) for at, _ in found]))
            at, keys = (np.concatenate([f[i] for f in found]) for i in (0, 1))
            cols = [pa.array(keys), batch.column(0).take(take), batch.column(1).take(take), pa.array(at.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=["seed", "id", "text_hash", "at"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by seed: those with a neighbour of the same seed, and all of the task's first and last seed, which may go on elsewhere."""
    first, held, given = None, None, False  # the last row, and whether it has been given out
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.concat_batches([held, batch]) if held is not None else batch
        seed = rows.column(0).to_numpy()
        first = seed[0] if first is None else first
        same = seed[1:] == seed[:-1]
        out = np.concatenate([[False], same]) | np.concatenate([same, [False]]) | (seed == first)
        out[0] &= not given
        given = bool(out[-1]) or (given and len(seed) == 1)
        yield rows.filter(pa.array(out))
        held = rows.slice(rows.num_rows - 1)
    if held is not None and not given:
        yield held


@vectors.tidied
def _owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the retained positions of a text: a hash of the runs they own together, where these start, and the hash of each in a row."""
    for batch in batches:
        for begin, texts in vectors.slices(batch.column(2)):
            row, key, starts, owns = [], [], [], []
            for i, words in enumerate(word_hashes(texts), begin):
                at, _, first, count = seeds(words)
                wanted = np.isin(at, batch.column(3)[i].values.to_numpy())
                runs = vectors.rolling(words, MIN_WORDS)
                for start, n in zip(first[wanted].tolist(), count[wanted].tolist()):
                    own = runs[start : start + n].tobytes()
                    row.append(i)
                    key.append(xxhash.xxh64_intdigest(own) - (1 << 63))
                    starts.append(start)
                    owns.append(own)
            take = pa.array(row, pa.int64())
            cols = [pa.array(key, pa.int64()), batch.column(0).take(take), batch.column(1).take(take), pa.array(starts, pa.int32()), pa.array(owns, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "id", "text_hash", "start", "own"])


def _adjacent(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, pa.Array, pa.Array]]:
    """Rows sorted by key, id, text_hash and start, once each: whether the row before and the row after have the same key, and the ids of these rows."""
    held, before = None, None  # the last row waits for the next one; the row before it
    for batch in chain(batches, [None]):
        if batch is not None and not batch.num_rows:
            continue
        rows = held if batch is None else batch if held is None else pa.concat_batches([held, batch])
        if rows is None:
            return
        if batch is not None and rows.num_rows > 1:  # rows that repeat an id and text
            same = np.logical_and.reduce([_equal(rows.column(i)) for i in range(4)])
            rows = rows.filter(pa.array(np.concatenate([[True], ~same])))
        n = rows.num_rows - (batch is not None)
        if n:
            around = pa.concat_batches([rows.slice(0, 1) if before is None else before, rows, *([rows.slice(n - 1)] if batch is None else [])])
            same = _equal(around.column(0))
            if before is None:
                same[0] = False
            if batch is None:
                same[-1] = False
            ids = around.column(1)
            yield rows.slice(0, n), same[:n], same[1 : n + 1], ids.slice(0, n), ids.slice(2, n)
            before = rows.slice(n - 1, 1)
        held = rows.slice(n)


def _equal(values: pa.Array) -> np.ndarray:
    """Whether each value but the first equals the one before it."""
    return pc.equal(values.slice(1), values.slice(0, len(values) - 1)).to_numpy(zero_copy_only=False).copy()


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of places that own the same runs: all but the first as later ones (n runs in a row, no key), and each run of the first by its key."""
    for rows, earlier, more, before, after in _adjacent(batches):
        first = pa.array(~earlier)
        later = rows.filter(pa.array(earlier))
        counts = pc.divide(pc.binary_length(later.column(4)), 8).cast(pa.int32())
        yield pa.RecordBatch.from_arrays([pa.nulls(later.num_rows, pa.int64()), *later.columns[1:4], counts, before.filter(pa.array(earlier))], names=RUN)
        kept = rows.filter(first)
        own = kept.column(4)
        counts = pc.divide(pc.binary_length(own), 8).to_numpy()
        if len(counts):
            keys = np.frombuffer(b"".join(own.to_pylist()), np.int64)
            start = np.repeat(kept.column(3).to_numpy() - np.cumsum(counts) + counts, counts) + np.arange(len(keys))
            take = pa.array(np.repeat(np.arange(len(counts)), counts))
            partner = pc.if_else(pa.array(more).filter(first), after.filter(first), pa.nulls(len(counts), after.type))
            cols = [pa.array(keys), kept.column(1).take(take), kept.column(2).take(take), pa.array(start.astype(np.int32)), pa.array(np.ones(len(keys), np.int32)), partner.take(take)]
            yield pa.RecordBatch.from_arrays(cols, names=RUN)


RUN = ["key", "id", "text_hash", "start", "n", "partner"]


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of runs sorted by key: those that stand elsewhere too, and whether an earlier place has them; the first and last row of a task with its number."""
    task, first, last = TaskContext.get().partitionId(), True, None
    for rows, earlier, more, before, after in _adjacent(batches):
        n = rows.num_rows
        partner = pc.if_else(pa.array(earlier), before, pc.if_else(pa.array(more), after, rows.column(5)))
        cols = [*rows.columns[:4], partner, pa.array(earlier)]
        out = pa.RecordBatch.from_arrays([*cols, pa.array(np.full(n, task, np.int32))], names=[*RUN[:4], "partner", "later", "task"])
        if last is not None:
            yield _inner(last)
        if first:
            yield out.slice(0, 1)
            first, out = False, out.slice(1)
        yield _inner(out.slice(0, max(0, out.num_rows - 1)))
        last = out.slice(max(0, out.num_rows - 1)) if out.num_rows else None
    if last is not None:
        yield last


def _inner(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Repeated runs among rows, without the task's number."""
    rows = rows.filter(pc.is_valid(rows.column(4)))
    return pa.RecordBatch.from_arrays([*rows.columns[:6], pa.nulls(rows.num_rows, pa.int32())], names=rows.schema.names)


def _met(edges: list) -> list[tuple]:
    """Rows (id, text_hash, start, n, partner, later) of the repeated runs at the edges of tasks, which are in order."""
    out = []
    for i, r in enumerate(edges):
        before = edges[i - 1] if i and edges[i - 1]["key"] == r["key"] else None
        after = edges[i + 1] if i + 1 < len(edges) and edges[i + 1]["key"] == r["key"] else None
        partner = r["partner"] if r["later"] or not (before or after) else (before or after)["id"]
        if partner is not None:
            out.append((r["id"], r["text_hash"], r["start"], 1, partner, r["later"] or before is not None))
    return out


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start_word, end_word, n_words, partners, later): every maximal run of words covered by repeats of MIN_WORDS or more.

    partners are ids its places were matched with; later tells that each of its matches has an earlier twin by id, text
    and position, so that removing the later runs leaves one copy.
    """
    spark = ready(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    n = partitions(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    seeded = rows.mapInArrow(_anchors, f"seed long, id {kind}, text_hash long, at int")
    # Range exchanges break ties by document and position: a seed that all documents share is dealt over many tasks.
    shared = seeded.repartitionByRange(n, "seed", "id", "at").sortWithinPartitions("seed", "id", "at").mapInArrow(_shared, seeded.schema)
    places = keep(shared, "anchors").groupBy("id", "text_hash").agg(F.array_sort(F.collect_set("at")).alias("places"))
    placed = rows.join(places.hint("merge"), ["id", "text_hash"]).select("id", "text_hash", "text", "places")
    owned = keep(placed.mapInArrow(_owned, f"key long, id {kind}, text_hash long, start int, own binary"), "owned")
    order = ["key", "id", "text_hash", "start"]
    array = owned.repartitionByRange(n, *order).sortWithinPartitions(*order)
    single = keep(array.mapInArrow(_together, f"key long, id {kind}, text_hash long, start int, n int, partner {kind}"), "runs")
    array = single.where("key is not null").repartitionByRange(n, *order).sortWithinPartitions(*order)
    ranked = keep(array.mapInArrow(_ranked, f"key long, id {kind}, text_hash long, start int, partner {kind}, later boolean, task int"), "ranked")
    found = single.where("key is null").select("id", "text_hash", "start", "n", "partner", F.lit(True).alias("later"))
    found = found.unionAll(ranked.where("task is null").select("id", "text_hash", "start", F.lit(1).alias("n"), "partner", "later"))
    # Two rows a task come to the driver: the places where the ranges meet.
    met = _met(ranked.where("task is not null").orderBy("task", *order).collect())
    if met:
        found = found.unionAll(spark.createDataFrame(met, f"id {kind}, text_hash long, start int, n int, partner {kind}, later boolean"))
    by = ["id", "text_hash", "later", "start"]
    runs = found.repartition(n, "id").sortWithinPartitions(*by).mapInArrow(_merged, f"id {kind}, start_word int, end_word int, n_words int, partners array<{kind}>, later boolean")
    return runs.withColumnRenamed("id", id_col)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of words that overlapping matches of a text cover."""
    key, start, end, partners, id_type = None, 0, 0, set(), None
    names = ["id", "start_word", "end_word", "n_words", "partners", "later"]

    def out(runs: list[tuple]) -> pa.RecordBatch:
        kinds = [id_type, pa.int32(), pa.int32(), pa.int32(), pa.list_(id_type), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in runs], k) for i, k in enumerate(kinds)], names=names)

    done = lambda: (key[0], start, end, end - start, sorted(partners), key[2])
    for batch in batches:
        id_type, runs = batch.column(0).type, []
        for id_, text_hash, at, n, partner, later in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (id_, text_hash, later) != key or at > end:
                if key:
                    runs.append(done())
                key, start, end, partners = (id_, text_hash, later), at, 0, set()
            end = max(end, at + n + MIN_WORDS - 1)
            partners.add(partner)
        yield out(runs)
    if key:
        yield out([done()])
