"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's features are the word and its character n-grams, hashed into buckets; a text is the average of
the embeddings of all features of all its words, and a linear softmax on top gives the score. Both are
trained together, on the driver, from a bounded sample of labelled texts; an unseen misspelling still
shares n-gram vectors with the words it comes from. Buckets whose share of texts doesn't differ clearly
between the two labels would only tell which text it was: their embeddings stay zero.

Texts are turned into bags of buckets by the executors, and only the buckets that keep an embedding reach
the driver. The output layer is linear, so a trained model folds into one number a bucket, and a text's
logit is the mean of its features' numbers. Nulls, empty texts and texts without a word score the bias
alone. Texts are scored whole; repeated rows give repeated results; no other column is an input of a score,
and columns may have any name. An empty table gives an empty result; with one label or none the score is
that label's share.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectors
from .common import drop, keep as stored, ready

#: Labelled texts of each class (0, 1) a model is trained from at most, those with the least hash of their id.
SAMPLE = (4000, 2000)
BUCKETS, DIM, GRAMS = 1 << 18, 4, (3, 4, 5)
BATCH, RATE, DECAY = 64, 0.03, 0.1
#: Texts to be seen in all, and the least and greatest number of times each is.
SEEN, EPOCHS, MOST_EPOCHS = 24_000, 3, 20
#: A bucket keeps an embedding if it is in so many texts at least, and the two labels' shares of texts with it are so many standard errors apart.
MIN_TEXTS, APART = 5, 4.0
#: Features average over hundreds of words, of which a few matter; the average is scaled up before the output layer.
SCALE = 300.0
_edges = re.compile(r"^\W+|\W+$")
#: Signs that stand for letters inside words (fixed values).
_leet = str.maketrans("013457@$!", "oieastasi")


def normal(token: str) -> str:
    """A token bare of punctuation and in lower case, with letters for the signs that stand for them."""
    word = token.lower()
    if word.isalpha():
        return word
    word = _edges.sub("", word)
    return word.translate(_leet) if not word.isalpha() and any(map(str.isalpha, word)) else word


def grams(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all tokens' features, and the token each is of: the word, and its n-grams with word ends marked; whole tokens, of any length."""
    marked = [f"<{w}>" if (w := normal(t)) else "" for t in tokens]
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(tokens)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(code))  # characters from here to the token's end
    buckets, of = [], []
    run = code * np.uint64(0x9E3779B97F4A7C15)
    for n in range(2, max(GRAMS) + 1):
        run = vectors.mixed(run[: len(code) - n + 1] + code[n - 1 :]) if len(code) >= n else run[:0]
        if n in GRAMS:
            at = np.flatnonzero(left[: len(run)] >= n)
            buckets.append(run[at])
            of.append(owner[at])
    some = np.flatnonzero(size)
    buckets.append(vectors.hashes(pa.array([marked[i] for i in some], pa.string())))
    of.append(some)
    return (np.concatenate(buckets) & np.uint64(BUCKETS - 1)).astype(np.int64), np.concatenate(of)


#: Bytes of text that are scored together: each comes with some hundred times as many of features.
SLICE = 1 << 20


@dataclass
class Model:
    """One number a bucket, and the bias, for the logit of label 1."""

    weight: np.ndarray
    bias: float
    trained_on: int


def scores(model: Model, texts: pa.Array) -> np.ndarray:
    """The score of each text, from the sums over its distinct tokens' features."""
    out = [np.zeros(0)]
    for _, part in vectors.slices(texts, SLICE):
        tokens, at, text = _tokens(part)
        bucket, of = grams(tokens)
        total, number = np.bincount(of, model.weight[bucket], len(tokens)), np.bincount(of, minlength=len(tokens))
        mean = np.bincount(text, total[at], len(part)) / np.maximum(np.bincount(text, number[at], len(part)), 1)
        out.append(model.bias + mean)
    return 1 / (1 + np.exp(-np.clip(np.concatenate(out), -50, 50)))


def _tokens(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct tokens of texts, and for every token in order its place among these and its text."""
    flat, count = vectors.words(texts)
    coded = flat.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(texts)), count)


def chosen(with_1, with_0, n_1: int, n_0: int):
    """Whether buckets in so many of n_1 and n_0 texts of each label keep an embedding; numbers, arrays or columns."""
    p = (with_1 + with_0 + 1.0) / (n_1 + n_0 + 2.0)
    apart = with_1 / float(n_1) - with_0 / float(n_0)
    return (with_1 + with_0 >= MIN_TEXTS) & (apart * apart > p * (1.0 - p) * (APART * APART * (1.0 / n_1 + 1.0 / n_0)))


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[int], odds: float | None = None, seed: int = 7) -> Model:
    """Fits embeddings and softmax together with Adam on the cross-entropy. With one class or no text the model is the prior alone.

    odds are those of label 1 where the texts come from, if the sample has others.
    """
    y = np.asarray(labels, np.int64)
    if len(set(labels)) < 2:
        p = (y.sum() + 0.5) / (len(y) + 1)
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(p / (1 - p))), len(y))
    none = np.zeros(0, np.int64)
    within = [np.bincount(np.concatenate([none, *(b[0] for b, t in zip(bags, y, strict=True) if t == label)]), minlength=BUCKETS) for label in (0, 1)]
    kept = chosen(within[1], within[0], int(y.sum()), int(len(y) - y.sum()))
    bags = [(ids[kept[ids]], SCALE * share[kept[ids]]) for ids, share in bags]
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    out, bias = rng.normal(0, 0.3, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    params = [emb, out, bias]
    mean = [np.zeros_like(p) for p in params]
    var = [np.zeros_like(p) for p in params]
    step, epochs = 0, min(MOST_EPOCHS, max(EPOCHS, SEEN // len(bags)))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        for rows in np.array_split(rng.permutation(len(bags)), max(1, len(bags) // BATCH)):
            ids = np.concatenate([bags[r][0] for r in rows])
            share = np.concatenate([bags[r][1] for r in rows])
            ends = np.cumsum([len(bags[r][0]) for r in rows])
            seen, where = np.unique(ids, return_inverse=True)
            doc = np.repeat(np.arange(len(rows)), np.diff(ends, prepend=0))
            hidden = np.zeros((len(rows), DIM), np.float32)
            for d in range(DIM):
                hidden[:, d] = np.bincount(doc, emb[ids, d] * share, len(rows))
            logit = hidden @ out + bias
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p /= len(rows)
            back = p @ out.T
            grad = np.empty((len(seen), DIM), np.float32)
            for d in range(DIM):
                grad[:, d] = np.bincount(where, back[doc, d] * share, len(seen))
            step += 1
            fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, g, at in ((0, grad, seen), (1, hidden.T @ p, slice(None)), (2, p.sum(0), slice(None))):  # rows of emb without a gradient rest
                mean[k][at] = m = 0.9 * mean[k][at] + 0.1 * g
                var[k][at] = v = 0.999 * var[k][at] + 0.001 * g * g
                params[k][at] -= (rate * fix) * m / (np.sqrt(v) + 1e-8) + (rate * DECAY) * params[k][at]
    weight = np.where(kept, SCALE * (emb @ (out[:, 1] - out[:, 0])), 0).astype(np.float32)
    shift = np.log(odds) - np.log(y.sum() / (len(y) - y.sum())) if odds else 0.0
    return Model(weight, float(bias[1] - bias[0] + shift), len(bags))


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text, and the share of its features that each has."""
    tokens, at, _ = _tokens(pa.array([text or ""]))
    bucket, of = grams(tokens)
    ids, where = np.unique(bucket, return_inverse=True)
    times = np.bincount(where, np.bincount(at, minlength=len(tokens))[of], len(ids))
    return ids.astype(np.int32), (times / max(1, times.sum())).astype(np.float32)


@vectors.tidied
def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, texts in vectors.slices(batch.column(1)):
            found = list(map(bag, texts.to_pylist()))
            cols = [pa.array([x[i] for x in found], kind) for i, kind in ((0, pa.list_(pa.int32())), (1, pa.list_(pa.float32())))]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), *cols], names=["y", "ids", "share"])


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, use: Column, size: tuple[int, int] = SAMPLE) -> Model:
    """A model trained on labelled texts for which use holds, at most size of each class, with the odds of label 1 among all of them.

    An id with several labels counts by the greatest, one with several texts by the least; rows without an id, label or text are left out.
    """
    ready(docs.sparkSession)
    known = labels.where(use & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
    known = known.groupBy("id").agg((F.max("label") > 0).cast("int").alias("y"))
    count = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    picked = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(size[y]) for y in (0, 1)]
    # Bounded by size: the ids that are broadcast, and the texts that become bags.
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where("t is not null").join(F.broadcast(picked[0].unionAll(picked[1])), "id")
    rows = rows.groupBy("id", "y").agg(F.min("t").alias("t"))
    bags = stored(rows.select("y", "t").mapInArrow(_bags, "y int, ids array<int>, share array<float>"), "bags")
    n = {r["y"]: r["count"] for r in bags.groupBy("y").count().collect()}
    if len(n) < 2:
        model = train([(np.zeros(0, np.int64), np.zeros(0, np.float32))] * sum(n.values()), [y for y in n for _ in range(n[y])])
    else:
        spread = bags.select("y", F.explode("ids").alias("b")).groupBy("b").agg(F.sum("y").alias("w1"), F.sum(1 - F.col("y")).alias("w0"))
        kept = np.zeros(BUCKETS, bool)
        kept[[r["b"] for r in spread.where(chosen(F.col("w1"), F.col("w0"), n[1], n[0])).select("b").collect()]] = True
        sent = docs.sparkSession.sparkContext.broadcast(kept)

        def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [(i[sent.value[i]], s[sent.value[i]]) for i, s in ((r.values.to_numpy(), w.values.to_numpy()) for r, w in zip(batch.column(1), batch.column(2), strict=True))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[c].tobytes() for x in found], pa.binary()) for c in (0, 1))], names=["y", "ids", "share"])

        got = sorted((r["y"], bytes(r["ids"]), bytes(r["share"])) for r in bags.mapInArrow(narrow, "y int, ids binary, share binary").collect())
        model = train([(np.frombuffer(i, np.int32).astype(np.int64), np.frombuffer(s, np.float32)) for _, i, s in got], [y for y, _, _ in got], count[1] / count[0])
    drop(bags)
    return model


def held_out(id_col: str) -> Column:
    """Whether a row's label is kept from training: the CRC-32 of its id as text is divisible by 5."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """id, score of label 1 and predicted (1 from 0.5 on); with keep all columns of docs besides, those of the same names replaced."""
    ready(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a number a bucket, whatever the corpus
    source = docs.drop("score", "predicted") if keep else docs.select(id_col, text_col)
    at, names = source.columns.index(text_col), [*(source.columns if keep else [id_col]), "score", "predicted"]

    @vectors.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = scores(sent.value, batch.column(at))
            cols = batch.columns if keep else [batch.column(0)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=names)

    fields = ", ".join(f"`{n}` {t}" for n, t in source.dtypes) if keep else f"{id_col} {kind}"
    return source.mapInArrow(run, f"{fields}, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Trains on the labels that aren't held out and scores every text: id, held_out, score, predicted."""
    model = learn(docs, labels, id_col, text_col, label_col, ~held_out(id_col))
    return score(docs, model, id_col, text_col).select(id_col, held_out(id_col).alias("held_out"), "score", "predicted")
