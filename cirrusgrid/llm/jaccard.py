"""N-gram Jaccard join: tiles of one size band, bitmap signatures, exact intersection.

A text's set is its distinct five-word shingles, as 64-bit hashes. Hashes are ordered: those of more than
``HOT`` sets last, the rest by value. Two sets of similarity 4/5 or more have a hash in common among their
n - ceil(4n/5) + 1 first ones, so a tile is formed for every such hash and a band of sizes: sets whose sizes
differ too much never meet, and texts that share a common passage alone meet in no tile of it unless they
have little else. In a tile, signatures of ``BITS`` hashed bits bound the overlap of two sets from above;
only pairs that pass are intersected exactly, on sorted arrays. A pair is passed over in a tile where the two are known to
share a larger one, as they meet there.

Only components are asked for. Each set is first intersected with the likeliest of a few sets beside it in
its first tiles, and then, in tiles that still hold several components, with the likeliest of another one.
At last all pairs of different components whose signatures allow it are intersected. A tile is cut into
blocks of ``BLOCK`` sets; the sets of its largest component stay in their block, and the others visit all
blocks. Links found earlier are kept as stars around the roots. Sets that are equal are one set from the
start. Nothing is dropped, so every link between different sets is accounted for.

A null, empty or blank text has an empty set and stands alone. Texts of any length count whole. Repeated
rows repeat in the result. A row without an id links with nothing, and its component is null. Only the id
and the text are read, so other columns may have any name. An empty table gives an empty result. Texts are read
several times, so they should come from a stored table, as a query's do.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectors
from .common import drop, keep, ready, release, swept
from .components import components

# Similarity NUM / DEN or more, shingles of SHINGLE words.
NUM, DEN, SHINGLE = 80, 100, 5
BITS, BLOCK = 1024, 4096
#: Hashes among the first ones of more sets than HOT come last in the order, the most frequent MOST_HOT of them. Any set
#: of hashes gives the same links; this one keeps tiles small.
HOT, MOST_HOT = 100, 200_000
#: In the first round a set's first FIRST tiles count, and in each the BESIDE sets before it.
FIRST, BESIDE = 3, 32
#: In tiles of up to so many sets all pairs are compared at once; of larger ones, first each set with the likeliest other.
SMALL = 128
#: A set's rows name its KNOWN largest tiles, by which a pair that meets in many tiles is given out in one or a few.
KNOWN = 6
#: Sets, links or tiles of a bounded number are broadcast, more are joined by shuffle.
BROADCAST_IDS = 200_000
#: Candidates of up to so many, which are counted, pass through the driver as pairs of numbers; more are joined by shuffle.
FEW = 200_000


def sets(docs: DataFrame, id_col: str, text_col: str, columns: str = "id k n") -> DataFrame:
    """Of id, k, n, h and bits of every text the columns asked for: hash and size of its set, its sorted hashes and its signature.

    With h or bits, only rows with an id and a set, and of equal sets in a task the first. They take more room than the texts,
    so they are not stored but made again by each step that needs them.
    """
    ready(docs.sparkSession)
    kinds = {"id": dict(docs.dtypes)[id_col], "k": "long", "n": "int", "h": "binary", "bits": "binary"}
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(partial(_sets, columns=columns.split()), ", ".join(f"{c} {kinds[c]}" for c in columns.split()))


def shingles(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles; of fewer words, the hash of the whole sequence."""
    flat, count = vectors.words(pc.ascii_lower(texts))
    word = vectors.hashes(flat)
    run = vectors.rolling(word, SHINGLE).view(np.int64)
    out, at = [], 0
    for n in count.tolist():
        if n >= SHINGLE:
            h = np.sort(run[at : at + n - SHINGLE + 1])
            out.append(h[np.concatenate([[True], h[1:] != h[:-1]])])
        else:
            out.append(np.array([xxhash.xxh64_intdigest(word[at : at + n].tobytes(), n) - 2**63] if n else [], np.int64))
        at += n
    return out


@vectors.tidied
def _sets(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    large = "h" in columns or "bits" in columns
    for batch in batches:
        for start, texts in vectors.slices(batch.column(1)):
            found, ids = shingles(texts), batch.column(0).slice(start, len(texts))
            k = [xxhash.xxh64_intdigest(h.tobytes()) - 2**63 for h in found]
            take = list(range(len(found)))
            if large:
                named, take = ids.is_valid().to_numpy(zero_copy_only=False), []
                for i, x in enumerate(k):
                    if len(found[i]) and named[i] and x not in seen:
                        take.append(i)
                        seen.add(x)
                if len(seen) > 200_000:
                    seen.clear()
            made = {
                "id": lambda: ids.take(pa.array(take, pa.int64())),
                "k": lambda: pa.array([k[i] for i in take], pa.int64()),
                "n": lambda: pa.array([len(found[i]) for i in take], pa.int32()),
                "h": lambda: pa.array([found[i].tobytes() for i in take], pa.binary()),
                "bits": lambda: pa.array([_signature(found[i]) for i in take], pa.binary()),
            }
            yield pa.RecordBatch.from_arrays([made[c]() for c in columns], names=columns)


def _of_sets(batches: Iterator[pa.RecordBatch], run, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """run over the sets of texts in the same worker, which then doesn't hand them through another."""
    return run(_sets(batches, columns))


def _signature(h: np.ndarray) -> bytes:
    size = max(BITS, 1 << (len(h) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[h & (size - 1)] = 1
    return np.packbits(bits).tobytes()


def reach(n):
    """How many first hashes similar sets share one of, for sets of size n."""
    return n - -(-n * NUM // DEN) + 1


def _within(count: np.ndarray) -> np.ndarray:
    """0, 1, .. for each count."""
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)


@vectors.tidied
def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, c): the least hashes of sets, and in how many sets of a batch each is among them."""
    for batch in batches:
        flat, off = vectors.unblob(batch.column(0))
        p = reach(np.diff(off))
        hash_, c = np.unique(flat[np.repeat(off[:-1], p) + _within(p)], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(hash_), pa.array(c.astype(np.int64))], names=["hash", "c"])


def _frequent(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by hash: hashes of more sets than least, with their number."""
    hold, many = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        hash_, c = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        start = np.flatnonzero(np.concatenate([[True], hash_[1:] != hash_[:-1]]))
        keys, total = hash_[start], np.add.reduceat(c, start)
        if hold is not None:
            if keys[0] == hold:
                total[0] += many
            elif many > least:
                yield pa.RecordBatch.from_arrays([pa.array([hold], pa.int64()), pa.array([many], pa.int64())], names=["hash", "c"])
        hold, many = int(keys[-1]), int(total[-1])
        big = np.flatnonzero(total[:-1] > least)
        yield pa.RecordBatch.from_arrays([pa.array(keys[big]), pa.array(total[big])], names=["hash", "c"])
    if hold is not None and many > least:
        yield pa.RecordBatch.from_arrays([pa.array([hold], pa.int64()), pa.array([many], pa.int64())], names=["hash", "c"])


def first_hashes(flat: np.ndarray, off: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sets, one after the other in flat: the number of each set, the place in flat and the rank of its first hashes, hot ones last."""
    n = np.diff(off)
    p = reach(n)
    look = np.minimum(n, p + 16)
    row, place = np.repeat(np.arange(len(n)), look), np.repeat(off[:-1], look) + _within(look)
    cool = ~_among(flat[place], hot)
    rank = np.cumsum(cool) - 1
    before = np.concatenate([[0], np.cumsum(np.bincount(row, cool, len(n)).astype(np.int64))])
    rank -= before[row]
    enough = (np.diff(before) >= p) | (n == 0)
    take = cool & (rank < p[row]) & enough[row]
    rows, places, ranks = [row[take]], [place[take]], [rank[take]]
    for i in np.flatnonzero(~enough):
        own = flat[off[i] : off[i + 1]]
        order = np.argsort(_among(own, hot), kind="stable")[: p[i]]
        rows.append(np.full(len(order), i))
        places.append(off[i] + order)
        ranks.append(np.arange(len(order)))
    return np.concatenate(rows), np.concatenate(places), np.concatenate(ranks)


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


@vectors.tidied
def _tile_rows(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """(hash, k, early, salts) for each of a set's first hashes: whether it is among the very first, and the number of blocks of a hot one, 0 for the others."""
    hot, blocks = sent.value
    for batch in batches:
        flat, off = vectors.unblob(batch.column(1))
        row, place, rank = first_hashes(flat, off, hot)
        hash_ = flat[place]
        salts = np.zeros(len(hash_), np.int32)
        if len(hot):
            at = np.minimum(np.searchsorted(hot, hash_), len(hot) - 1)
            salts = np.where(hot[at] == hash_, blocks[at], 0).astype(np.int32)
        take = pa.array(row)
        yield pa.RecordBatch.from_arrays([pa.array(hash_), batch.column(0).take(take), pa.array(rank < FIRST), pa.array(salts)], names=TILE)


def _lists(column: pa.Array) -> np.ndarray:
    """Lists of up to KNOWN numbers as rows of KNOWN; what a short list lacks is never looked at."""
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(size), KNOWN), np.int64)
    out[np.repeat(np.arange(len(size)), size), _within(size)] = column.flatten().to_numpy()
    return out


def _met_before(tile: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether pairs of sets whose first tiles are a and b are known to share one before this one: where they share none before, they meet in this one.

    All of a list come before a tile of the set that it doesn't name.
    """
    own = a == tile[:, None]
    before = np.where(own.any(1), own.argmax(1), KNOWN)
    return ((a[:, :, None] == b[:, None, :]).any(2) & (np.arange(KNOWN) < before[:, None])).any(1)


TILE = ["hash", "k", "early", "salts"]
TILED = ["hash", "band", "block", "askers", "n", "k", "comp", "home", "loose", "asks", "member"]


def _columns(batch: pa.RecordBatch, *at: int) -> np.ndarray:
    return np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in at])


@vectors.tidied
def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by hash and k: hot ones, and those that share their hash with another set; once each."""
    held, given = np.zeros((0, 4), np.int64), False  # the last row, and whether it has been given out
    for batch in batches:
        rows = np.concatenate([held, _columns(batch, 0, 1, 2, 3)])
        if not len(rows):
            continue
        fresh = np.ones(len(rows), bool)
        fresh[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
        rows = rows[fresh]
        same = rows[1:, 0] == rows[:-1, 0]
        out = np.concatenate([[False], same]) | np.concatenate([same, [False]]) | (rows[:, 3] > 0)
        out[0] &= not given
        given = bool(out[-1]) or (given and len(rows) == 1)
        pick = rows[out]
        yield pa.RecordBatch.from_arrays([pa.array(pick[:, i].astype(kind)) for i, kind in enumerate((np.int64, np.int64, bool, np.int32))], names=TILE)
        held = rows[-1:]


def _folded(signs: list[bytes], size: int) -> np.ndarray:
    """Signatures as rows of size bytes; a longer one folds to the shorter by or-ing its halves, as its bits are remainders of hashes."""
    out = np.empty((len(signs), size), np.uint8)
    lengths = np.fromiter(map(len, signs), np.int64, len(signs))
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        rows = np.frombuffer(b"".join([signs[i] for i in at]), np.uint8).reshape(len(at), -1, size)
        out[at] = np.bitwise_or.reduce(rows, 1)
    return out.view(np.uint64)


def _most(n, m, ones_n, ones_m, both):
    """The most that sets of sizes n and m whose signatures share so many bits can have in common: a bit that one lacks is a hash that it lacks."""
    return np.minimum(n - (ones_n - both), m - (ones_m - both))


def _pairs(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    p, q = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
    both = np.unique(np.column_stack([np.minimum(p, q), np.maximum(p, q)]), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


@vectors.tidied
def _beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (hash, salt, n, k, bits), sorted: pairs of each set and the likeliest of the BESIDE sets before it in its tile."""
    held, signs = np.zeros((0, 4), np.int64), np.zeros((0, BITS // 64), np.uint64)
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.concatenate([held, _columns(batch, 0, 1, 2, 3)])
        signs = np.concatenate([signs, _folded(batch.column(4).to_pylist(), BITS // 8)])
        ones = np.bitwise_count(signs).sum(1, dtype=np.int64)
        best, which = np.zeros(len(rows)), np.zeros(len(rows), np.int64)
        for d in range(1, min(BESIDE, len(rows) - 1) + 1):
            both = np.bitwise_count(signs[d:] & signs[:-d]).sum(1, dtype=np.int64)
            most = _most(rows[d:, 2], rows[:-d, 2], ones[d:], ones[:-d], both)
            total = rows[d:, 2] + rows[:-d, 2]
            like = np.where((rows[d:, :2] == rows[:-d, :2]).all(1) & ((NUM + DEN) * most >= NUM * total) & (rows[d:, 3] != rows[:-d, 3]), most / total, 0.0)
            better = like > best[d:]
            best[d:][better], which[d:][better] = like[better], d
        best[: len(held)] = 0
        at = np.flatnonzero(best)
        yield _pairs([rows[at, 3]], [rows[at - which[at], 3]])
        held, signs = rows[-BESIDE:], signs[-BESIDE:]


@vectors.tidied
def _compare(batches: Iterator[pa.RecordBatch], every: bool, few: int) -> Iterator[pa.RecordBatch]:
    """Of tiles or their blocks, (TILED.., bits, first), sorted: pairs of sets of different components whose signatures allow the similarity.

    In a small tile all are compared, in others those that ask with the members: two loose sets once. Two guests are not, as
    they meet where both are at home. Unless every pair is asked for, a set of a large tile is paired with the likeliest member alone.
    """
    held: tuple[np.ndarray, list[bytes], np.ndarray] = (np.zeros((0, len(TILED)), np.int64), [], np.zeros((0, KNOWN), np.int64))
    for batch in _last_too(batches):
        if batch is None:
            rows, signs, first = held
            bounds = np.append(np.flatnonzero(np.concatenate([[True], (rows[1:, :4] != rows[:-1, :4]).any(1)])) if len(rows) else [], len(rows)).astype(np.int64)
        else:
            rows, signs = np.concatenate([held[0], _columns(batch, *range(len(TILED)))]), held[1] + batch.column(len(TILED)).to_pylist()
            first = np.concatenate([held[2], _lists(batch.column(len(TILED) + 1))])
            if not len(rows):
                continue
            bounds = np.flatnonzero(np.concatenate([[True], (rows[1:, :4] != rows[:-1, :4]).any(1)]))
            held = (rows[bounds[-1] :], signs[bounds[-1] :], first[bounds[-1] :])  # the last tile may go on
        size = np.diff(bounds)
        if not len(size):
            continue
        small = size <= few
        at = np.flatnonzero(np.repeat(small, size))
        tile = np.repeat(np.arange(len(size)), size)
        if len(at):
            yield from _all_pairs(rows[at], tile[at], [signs[i] for i in at], first[at])
        for t in np.flatnonzero(~small):
            yield from _asked(rows[bounds[t] : bounds[t + 1]], signs[bounds[t] : bounds[t + 1]], first[bounds[t] : bounds[t + 1]], every)


def _last_too(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _all_pairs(rows: np.ndarray, tile: np.ndarray, signs: list[bytes], first: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Pairs within small tiles, all tiles at once: each row with the d-th before it, for every d."""
    length = np.fromiter(map(len, signs), np.int64, len(signs))
    begin = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
    least = np.repeat(np.minimum.reduceat(length, begin), np.diff(np.append(begin, len(tile))))
    for size in np.unique(least):
        own = np.flatnonzero(least == size)
        n, k, comp, home, t = rows[own, 4], rows[own, 5], rows[own, 6], rows[own, 7], tile[own]
        known, place = first[own], rows[own, 0]
        bits = _folded([signs[i] for i in own], int(size))
        ones = np.bitwise_count(bits).sum(1, dtype=np.int64)
        a, b = [], []
        for d in range(1, len(own)):
            i = np.flatnonzero(t[d:] == t[:-d]) + d
            if not len(i):
                break
            j = i - d
            apart = (comp[i] != comp[j]) & (home[i] | home[j] == 1) & ((NUM + DEN) * n[j] >= NUM * (n[i] + n[j]))
            i, j = i[apart], j[apart]
            fits = (NUM + DEN) * _most(n[i], n[j], ones[i], ones[j], np.bitwise_count(bits[i] & bits[j]).sum(1, dtype=np.int64)) >= NUM * (n[i] + n[j])
            i, j = i[fits], j[fits]
            new = ~_met_before(place[i], known[i], known[j])
            a.append(k[i[new]])
            b.append(k[j[new]])
        if a:
            yield _pairs(a, b)


def _asked(rows: np.ndarray, signs: list[bytes], first: np.ndarray, every: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of the sets that ask in a block and its members."""
    n, k, comp, home, loose, asks, member = rows[:, 4:].T
    place = rows[:, 0]
    ask, give = np.flatnonzero(asks), np.flatnonzero(member)
    if not len(ask) or not len(give):
        return
    bits = _folded(signs, min(map(len, signs)))
    ones = np.bitwise_count(bits).sum(1, dtype=np.int64)
    wide = max(64, (1 << 17) // bits.shape[1] // 64)
    a, b = [], []
    for i in range(0, len(ask), 64):
        x = ask[i : i + 64]
        low, top = np.searchsorted(n[give], -(-n[x[0]] * NUM // DEN)), np.searchsorted(n[give], n[x[-1]] * DEN // NUM, "right")
        likely, which = np.zeros(len(x)), np.zeros(len(x), np.int64)
        for j in range(low, top, wide):
            y = give[j : min(j + wide, top)]
            both = np.bitwise_count(bits[x, None] & bits[None, y]).sum(2, dtype=np.int64)
            most, total = _most(n[x, None], n[None, y], ones[x, None], ones[None, y], both), n[x, None] + n[None, y]
            fits = ((NUM + DEN) * most >= NUM * total) & (comp[x, None] != comp[None, y]) & ((home[x, None] | home[None, y]) == 1) & ((loose[None, y] == 0) | (k[x, None] < k[None, y]))
            if every:
                p, q = np.nonzero(fits)
                new = ~_met_before(place[x[p]], first[x[p]], first[y[q]])
                a.append(k[x[p[new]]])
                b.append(k[y[q[new]]])
                if sum(map(len, a)) > 100_000:
                    yield _pairs(a, b)
                    a, b = [], []
            else:
                like = np.where(fits, most / total, 0.0)
                at = like.argmax(1)
                better = like[np.arange(len(x)), at] > likely
                likely[better], which[better] = like[better, at[better]], y[at[better]]
        p, q = x[likely > 0], which[likely > 0]
        new = ~_met_before(place[p], first[p], first[q])
        a.append(k[p[new]])
        b.append(k[q[new]])
    if a:
        yield _pairs(a, b)


def _similar(p: np.ndarray, q: np.ndarray) -> bool:
    at = np.minimum(np.searchsorted(p, q), len(p) - 1)
    both = int((p[at] == q).sum())
    return DEN * both >= NUM * (len(p) + len(q) - both)


@vectors.tidied
def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sets, intersected as sorted arrays, are similar enough."""
    for batch in batches:
        good = []
        for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            if _similar(np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)):
                good.append(i)
        at = pa.array(good, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])


@vectors.tidied
def _verify_sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, k, h), sorted by a, b and k: pairs whose sets, one row of each, are similar enough; a set may be there more than once."""
    pair, sides = None, {}
    for batch in batches:
        good = []
        a, b, k = (batch.column(i).to_pylist() for i in range(3))
        for i, h in enumerate(batch.column(3)):
            if pair != (a[i], b[i]):
                pair, sides = (a[i], b[i]), {}
            if k[i] not in sides:
                sides[k[i]] = np.frombuffer(h.as_buffer(), np.int64).copy()
                if len(sides) == 2 and _similar(*sides.values()):
                    good.append(pair)
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in good], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _few_links(pairs: DataFrame, found: DataFrame, docs: DataFrame) -> DataFrame:
    """As _links, of so few pairs that their ids pass through the driver; only texts of sets that a pair names are shuffled, once a pair."""
    spark = docs.sparkSession
    got = pairs.toArrow()
    p, q = (got.column(i).to_numpy() for i in (0, 1))
    both = np.unique(np.column_stack([np.minimum(p, q), np.maximum(p, q)]).astype(np.int64), axis=0)
    ends = pa.table({"k": np.concatenate([both[:, 0], both[:, 1]]), "a": np.tile(both[:, 0], 2), "b": np.tile(both[:, 1], 2)})
    named = F.broadcast(spark.createDataFrame(pa.table({"k": np.unique(both)}), "k long"))
    ids = found.where("id is not null").join(named, "k", "left_semi").groupBy("k").agg(F.min("id").alias("id")).select("id").toArrow()
    one = F.broadcast(spark.createDataFrame(pa.table({"id": ids.column(0).unique()}), found.select("id").schema))
    side = keep(sets(docs.join(one, "id", "left_semi"), "id", "t", "k h").join(named, "k", "left_semi"), "named")
    sides = side.join(F.broadcast(spark.createDataFrame(ends, "k long, a long, b long")), "k").select("a", "b", "k", "h")
    links = keep(sides.repartition("a", "b").sortWithinPartitions("a", "b", "k").mapInArrow(_verify_sides, "a long, b long"), "links")
    drop(side)
    return links


def _links(pairs: DataFrame, found: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets that are similar, stored; found has (id, k, n) of all texts and docs their (id, t)."""
    given = keep(pairs, "candidates")
    release(docs.sparkSession)
    if given.count() <= FEW:
        links = _few_links(given, found, docs)
        drop(given)
        return links
    pairs = keep(given.distinct(), "candidates")
    drop(given)
    named = keep(pairs.select(F.col("a").alias("k")).union(pairs.select(F.col("b").alias("k"))).distinct(), "names")
    # Only texts of sets that a pair names are split again, one of each set; of each pair one set is sent to the other.
    ids = found.where("id is not null").join(_few(named), "k", "left_semi").groupBy("k").agg(F.min("id").alias("id")).select("id").distinct()
    again = sets(docs.join(_few(one := keep(ids, "ids")), "id", "left_semi"), "id", "t", "k h")
    side = keep(again.join(_few(named), "k", "left_semi").groupBy("k").agg(F.first("h").alias("h")), "named")
    both = pairs.join(side.toDF("b", "hb").hint("merge"), "b").join(side.toDF("a", "ha").hint("merge"), "a").select("a", "b", "ha", "hb")
    links = keep(both.mapInArrow(_verify, "a long, b long"), "links")
    for done in (pairs, named, one, side):
        drop(done)
    return links


def _few(rows: DataFrame, size: Column | None = None) -> DataFrame:
    """rows, to be broadcast if their number, or that of what they hold, which is counted, is small enough."""
    many = rows.count() if size is None else rows.agg(F.sum(size)).first()[0] or 0
    return F.broadcast(rows) if many <= BROADCAST_IDS else rows


def _joined(before: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, root) by the links found so far, of which earlier ones are the stars in before."""
    stars = links if before is None else links.unionAll(before.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    label = keep(components(stars), "components")
    release(links.sparkSession)
    return label


def similar_sets(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, k, n) of all texts, stored, and (node, root): components of sets k that have a similar set."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    found = keep(sets(docs, "id", "t"), "texts")
    counted = docs.mapInArrow(partial(_of_sets, run=_counted, columns=["h"]), "hash long, c long").repartition("hash").sortWithinPartitions("hash")
    hot = counted.mapInArrow(partial(_frequent, least=HOT), "hash long, c long").orderBy(F.desc("c"), "hash").limit(MOST_HOT).collect()
    hot = sorted((r["hash"], -(-r["c"] // BLOCK)) for r in hot)
    sent = spark.sparkContext.broadcast((np.array([h for h, _ in hot], np.int64), np.array([b for _, b in hot], np.int64)))
    release(spark)
    rows = docs.mapInArrow(partial(_of_sets, run=partial(_tile_rows, sent=sent), columns=["k", "h"]), "hash long, k long, early boolean, salts int")
    # Hot tiles are met anyway; only the others need their rows together.
    apart = rows.repartition("hash", F.when(F.col("salts") > 0, F.col("k"))).sortWithinPartitions("hash", "k")
    met = keep(apart.mapInArrow(_met, rows.schema), "tiles")
    signs = keep(sets(docs, "id", "t", "k n bits").groupBy("k").agg(F.first("n").alias("n"), F.first("bits").alias("bits")), "signatures")
    release(spark)

    early = met.where("early").withColumn("salt", F.when(F.col("salts") > 0, F.pmod("k", F.greatest("salts", F.lit(1)))).otherwise(0))
    early = early.join(signs.hint("merge"), "k").select("hash", "salt", "n", "k", "bits").repartition("hash", "salt").sortWithinPartitions("hash", "salt", "n", "k")
    label = _joined(None, _links(early.mapInArrow(_beside, "a long, b long"), found, docs))
    # Small tiles that this leaves mixed are compared whole; in larger ones each set is paired with one, and joined, before all others are.
    for every in (False, True):
        blocks, *stored = _blocks(met, signs, label, SMALL if every else 1)
        links = _links(blocks.mapInArrow(partial(_compare, every=every, few=SMALL), "a long, b long"), found, docs)
        label, before = _joined(label, links), label
        for done in (links, before, *stored):
            drop(done)
    for done in (met, signs):
        drop(done)
    return found, label


def _blocks(met: DataFrame, signs: DataFrame, label: DataFrame, over: int) -> tuple[DataFrame, ...]:
    """Blocks of the tiles that hold sets of several components and over so many sets, sorted for _compare, and the stored tables they come from."""
    known = signs.select("k", "n").join(label.withColumnRenamed("node", "k").hint("merge"), "k", "left").select("k", "n", F.coalesce("root", "k").alias("comp"))
    rows = keep(met.select("hash", "k").join(known.hint("merge"), "k"), "labelled")
    mixed = rows.groupBy("hash").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("c")).where(f"lo <> hi and c > {over}").select("hash", "c")
    mixed = keep(mixed, "shared")
    # The order of tiles, the largest first, is the same in every round: a pair that differs until the last one has met in its first tile.
    first = rows.select("hash", "k").join(mixed, "hash").groupBy("k").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("c")).alias("c"), "hash"))), 1, KNOWN)["hash"].alias("first"))
    first = keep(first, "first")
    # A set belongs to its band of sizes, and is a guest in the next one, whose sets may be up to DEN / NUM times as large.
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(DEN / NUM))).cast("int")
    at = F.array(F.struct(band.alias("band"), F.lit(1).alias("home")), F.struct((band + 1).alias("band"), F.lit(0).alias("home")))
    banded = rows.join(mixed, "hash", "left_semi").select("hash", "comp", F.explode(at).alias("x")).select("hash", "x.band", "comp", "x.home")
    parts = banded.groupBy("hash", "band", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("home").alias("homes"))
    tiles = parts.groupBy("hash", "band").agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("many"), F.count(F.lit(1)).alias("comps"), F.sum("homes").alias("homes"))
    tiles = tiles.where(f"comps > 1 and homes > 0 and many > {over}").select("hash", F.struct("band", F.col("top.comp").alias("top"), "many", (F.col("many") - F.col("top.c")).alias("others")).alias("x"))
    # A hash's tiles come as one list, so that rows are dealt by hash alone, once, and are doubled only after that.
    tiles = keep(tiles.groupBy("hash").agg(F.collect_list("x").alias("bands")), "mixed")
    release(met.sparkSession)
    own = F.filter("bands", lambda x: (x["band"] == band) | (x["band"] == band + 1))
    placed = rows.join(_few(tiles, F.size("bands")), "hash").select("hash", "k", "n", "comp", F.explode(own).alias("x")).select("hash", "k", "n", "comp", "x.*")
    placed = placed.withColumn("home", (F.col("band") == band).cast("int")).withColumn("loose", (F.col("comp") != F.col("top")).cast("int"))
    blocks, askers = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("many", "others"))
    own, seat = (F.pmod(F.xxhash64("k", F.lit(s)), n).cast("int") for s, n in ((1, blocks), (2, askers)))
    # Members stay in their block, and loose sets ask in all blocks; both come in parts of BLOCK.
    part = lambda block, asker, asks, member: F.struct(block.alias("block"), asker.alias("askers"), asks.cast("int").alias("asks"), F.lit(member).alias("member"))
    here = F.transform(F.sequence(F.lit(0), askers - 1), lambda j: part(own, j, (F.col("loose") == 1) & (j == seat), 1))
    there = F.filter(F.transform(F.sequence(F.lit(0), blocks - 1), lambda i: part(i, seat, F.lit(1), 0)), lambda x: x["block"] != own)
    visits = F.when(F.col("loose") == 1, F.concat(here, there)).otherwise(here)
    placed = placed.select("hash", "band", "n", "k", "comp", "home", "loose", F.explode(visits).alias("x")).select("hash", "band", "x.*", "n", "k", "comp", "home", "loose")
    # Stored before the signatures come along, as shuffle files up to here then make room for the largest ones.
    placed = keep(placed, "placed")
    for done in (rows, mixed, tiles):
        drop(done)
    release(met.sparkSession)
    signed = placed.join(signs.select("k", "bits").hint("merge"), "k").join(first.hint("merge"), "k")
    key = ["hash", "band", "block", "askers"]
    return signed.select(*TILED, "bits", "first").repartition(*key).sortWithinPartitions(*key, "n", "k"), first, placed


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles and component_id (the least id reachable by links) of every document."""
    ready(docs.sparkSession)
    with swept(docs.sparkSession):
        found, label = similar_sets(docs, id_col, text_col)
        label = label.select(F.col("node").alias("k"), "root")
        rooted = found.select("id", "k", "n").join(label.hint("merge"), "k", "left").withColumn("root", F.coalesce("root", "k"))
        rooted = keep(rooted.select("id", "n", "root"), "rooted")
    full = rooted.where("n > 0")
    least = full.where("id is not null").groupBy("root").agg(F.min("id").alias("component"))
    out = full.join(least.hint("merge"), "root", "left").select("id", "n", F.when(F.col("id").isNotNull(), F.col("component")).alias("component")).unionAll(rooted.where("n = 0").select("id", "n", F.col("id").alias("component")))
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id"))


#: The same by pairs of sets with a shingle in common and a recursion along links.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(s) AS s FROM (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON r.id = e.a AND r.c < e.b)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(c) AS component_id
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id JOIN r ON d.doc_id = r.id GROUP BY d.doc_id
"""
