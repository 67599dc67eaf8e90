"""Document fingerprints: bottom-k sketches of the hashes of five-word shingles.

A sketch is the sorted array of the K least distinct hashes of a text, so sketches merge by taking the K
least of their union, and estimate resemblance, containment and the number of distinct shingles; below K
shingles every estimate is exact. All of it is DataFrame functions.

Words are runs of anything but ASCII spaces, A-Z in lower case. A text of fewer words has the whole
sequence as its one shingle; a null text counts as empty, and an empty one has an empty sketch, which is
like another empty one (1) and unlike the rest (0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, keep, partitions, words

SHINGLE = 5
K = 128


def shingle_hashes(w: Column | str, size: int = SHINGLE) -> Column:
    """Distinct hashes of the shingles of an array of words; w is named more than once, so give a column of its own."""
    whole = F.array(F.xxhash64(w))
    run = F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.xxhash64(F.slice(w, i, size)))
    return F.when(F.size(w) == 0, F.expr("cast(array() as array<bigint>)")).when(F.size(w) < size, whole).otherwise(F.array_distinct(run))


def with_sketch(df: DataFrame, text_col: str, to: str, k: int = K) -> DataFrame:
    out = df.withColumn("_w", words(ascii_lower(F.col(text_col)))).withColumn("_h", shingle_hashes(F.col("_w")))
    return out.withColumn(to, F.slice(F.sort_array("_h"), 1, k)).drop("_w", "_h")


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of what two sketches stand for."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_groups(df: DataFrame, key: str, sketch: str, k: int = K, salts: int = 64) -> DataFrame:
    """One sketch a key, of any number of parts: hashes are cut to the K least within salts of a key first, so that a hot key is shared out."""
    rows = df.select(key, F.explode(sketch).alias("h"))
    part = rows.withColumn("_salt", F.pmod(F.xxhash64("h"), F.lit(salts))).distinct()
    cut = lambda d, *by: d.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("h"))).where(F.col("_r") <= k)
    least = cut(cut(part, key, "_salt").drop("_r"), key)
    return least.groupBy(key).agg(F.sort_array(F.collect_list("h")).alias(sketch))


def distinct_shingles(s: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    span = (F.element_at(s, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) / span)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of shingles in both of those in either."""
    union = merge(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / F.greatest(F.size(union), F.lit(1)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too; 1 for an empty a."""
    there = F.when(F.size(a) > 0, distinct_shingles(merge(a, b, k), k) * resemblance(a, b, k) / distinct_shingles(a, k))
    return F.least(F.lit(1.0), F.coalesce(there, F.lit(1.0)))


def as_text(s: Column) -> Column:
    """A sketch as a string: 16 hexadecimal digits a hash; empty for none."""
    return F.array_join(F.transform(s, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def from_text(s: Column) -> Column:
    """The sketch that as_text wrote."""
    at = F.sequence(F.lit(0), (F.char_length(s) / 16).cast("int") - 1)
    return F.when(F.char_length(s) == 0, F.expr("cast(array() as array<bigint>)")).otherwise(
        F.transform(at, lambda i: F.conv(F.substring(s, i * 16 + 1, F.lit(16)), 16, -10).cast("bigint"))
    )


def next_ids(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, next_id): each distinct id, the code points of its longest text, and the next id in descending order; the first comes after the last.

    Ids are sorted by range, compared with their neighbour within a range, and with the next range's first across: no task
    sees more than a range of ids, and only one row a range goes to a single task.
    """
    n = F.char_length(F.coalesce(F.col(text_col), F.lit("")))
    ids = docs.select(F.col(id_col).alias("id"), n.alias("n")).where(F.col("id").isNotNull()).groupBy("id").agg(F.max("n").alias("n"))
    ranged = keep(ids.repartitionByRange(partitions(docs.sparkSession), "id").withColumn("part", F.spark_partition_id()), "id-ranges")
    edge = ranged.groupBy("part").agg(F.max("id").alias("most"))
    whole = Window.partitionBy(F.lit(0))
    edge = edge.withColumn("below", F.coalesce(F.lag("most").over(whole.orderBy("part")), F.max("most").over(whole)))
    near = F.lead("id").over(Window.partitionBy("part").orderBy(F.desc("id")))
    joined = ranged.withColumn("near", near).join(F.broadcast(edge), "part")  # a row for each shuffle partition
    return joined.select("id", "n", F.coalesce("near", "below").alias("next_id"))


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last half is the start of the next document.

    Rows that share an id follow the same next document; the least text of an id stands for it as a next document. Rows
    without an id follow none: nothing takes the place of their last half, and near_next is null.

    The texts are shuffled once by id; only as much of each as the document before it needs is shuffled again.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = keep(next_ids(docs, id_col, text_col), "next-ids")
    before = order.select(F.col("next_id").alias("id"), F.col("id").alias("to"), F.floor(F.col("n") / 2).cast("int").alias("need"))
    # Both sides of the second join read the same exchange of the texts; sketches are made beyond it, as they would widen it.
    placed = rows.where("id is not null").join(before.hint("merge"), "id")
    first = F.row_number().over(Window.partitionBy("id").orderBy("text"))
    sent = with_sketch(placed.withColumn("_first", first).where("_first = 1"), "text", "next_sketch", k)
    sent = sent.select(F.col("to").alias("id"), F.substring("text", F.lit(1), F.col("need")).alias("start"), "next_sketch")
    both = placed.select("id", "text").join(sent.hint("merge"), "id")
    nameless = rows.where("id is null").withColumns({"start": F.lit(""), "next_sketch": F.lit(None).cast("array<bigint>")})
    both = with_sketch(both.unionByName(nameless), "text", "sketch", k)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    both = both.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("start", F.lit(1), half)))
    both = with_sketch(both, "edited", "edited_sketch", k)
    return both.select(
        F.col("id").alias(id_col),
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        F.when(F.col("next_sketch").isNotNull(), resemblance(F.col("sketch"), F.col("next_sketch"), k)).alias("near_next"),
    )
