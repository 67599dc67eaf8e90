"""Secret scans: fixed patterns, and character Markov models of random strings and ordinary identifiers.

Both models are order-1 Markov chains over ``ALPHABET`` trained from labelled samples (any DataFrame
of string and label). A run of candidate characters is reported when the log-likelihood ratio of the
two models reaches ``THRESHOLD``. All of it is DataFrame functions.

A null or empty text has no spans. Positions are code points, ends exclusive. Spans of one kind never
overlap; model spans that touch a pattern's span are left to the pattern. Repeated rows give repeated
results, and columns besides id and text are ignored.
"""

from __future__ import annotations

import math
import string

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The kinds and patterns of the contract.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

#: What the models know; a character outside it ends a candidate.
ALPHABET = string.ascii_lowercase + string.ascii_uppercase + string.digits + "+/=_-"
CANDIDATE = r"[A-Za-z0-9+/=_-]{20,}"
#: Nats by which a string must be likelier random than ordinary.
THRESHOLD = 12.0
#: Bounds of the samples the models are trained from.
SAMPLE_DOCS, SAMPLE_RANDOM = 1000, 4000

# Parts from which ordinary identifiers are put together.
PARTS = (
    "get set load store user name file path index count value item list map key data page text line word table column row "
    "start end next first last total size length width height config option parse format print read write open close update "
    "insert delete select join group order filter merge split build test error warning message request response server client "
    "session account address number string integer double boolean default public static method class function object array "
    "buffer stream thread process memory cache queue stack graph node edge tree hash time date year month day hour minute"
).split()


def samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Labelled samples (s, random): strings made from digests, identifiers made from PARTS, and words of a bounded set of documents."""
    spark = docs.sparkSession
    seed = spark.range(SAMPLE_RANDOM).withColumn("d", F.sha2(F.col("id").cast("string"), 512))
    b64 = F.regexp_replace(F.base64(F.unhex("d")), r"\s", "")
    upper = F.upper(F.conv(F.substring("d", 1, 15), 16, 36))
    made = seed.select(
        F.explode(
            F.array(
                F.substring("d", 1, 40),
                F.substring(b64, 1, 40),
                F.translate(F.substring(b64, 41, 40), "+/", "-_"),
                F.concat(upper, F.upper(F.conv(F.substring("d", 16, 15), 16, 36))),
                F.concat(F.lower(upper), F.lower(F.conv(F.substring("d", 31, 15), 16, 36))),
            )
        ).alias("s"),
        F.lit(True).alias("random"),
    )
    part = [F.element_at(F.array(*map(F.lit, PARTS)), (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(PARTS))) + 1).cast("int")) for k in range(4)]
    number = F.pmod(F.xxhash64("id"), F.lit(1000)).cast("string")
    named = seed.select(
        F.explode(
            F.array(
                F.concat_ws("_", *part), F.concat_ws("-", *part), F.concat_ws("/", *part), F.concat(part[0], *map(F.initcap, part[1:])),
                F.upper(F.concat_ws("_", *part)), F.concat_ws("_", *part[:3], number), F.concat(*part), F.concat_ws("", number, number, number),
            )
        ).alias("s"),
        F.lit(False).alias("random"),
    )
    chosen = docs.select(id_col).orderBy(F.xxhash64(id_col), id_col).limit(SAMPLE_DOCS).distinct()
    texts = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col, "left_semi")  # SAMPLE_DOCS ids at most
    # Words with a digit may be secrets themselves and teach nothing about ordinary ones.
    worded = texts.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit(r"(?<![0-9A-Za-z])[A-Za-z]{4,}(?![0-9A-Za-z])"), F.lit(0))).alias("s"), F.lit(False).alias("random"))
    return made.unionAll(named).unionAll(worded)


def train(labelled: DataFrame) -> list[float]:
    """The log-likelihood ratio of each transition, row by row of ALPHABET; add-one smoothing.

    Counts are summed on the executors; at most 2 * len(ALPHABET) ** 2 of them reach the driver. Samples without a
    transition, nulls and characters outside ALPHABET add nothing; with no samples at all every ratio is 0.
    """
    n = len(ALPHABET)
    step = F.expr("explode(transform(sequence(1, greatest(char_length(s) - 1, 1)), i -> substring(s, i, 2)))")
    rows = labelled.where(F.char_length("s") > 1).select(F.col("random"), step.alias("two")).groupBy("random", "two").count()
    counts = {kind: [[1.0] * n for _ in range(n)] for kind in (True, False)}
    at = {c: i for i, c in enumerate(ALPHABET)}
    known = rows.where(F.col("two").rlike(r"^[A-Za-z0-9+/=_-]{2}$") & F.col("random").isNotNull())
    for kind, two, count in known.collect():
        counts[kind][at[two[0]]][at[two[1]]] += count
    total = {kind: [sum(row) for row in rows] for kind, rows in counts.items()}
    return [
        math.log(counts[True][a][b] / total[True][a]) - math.log(counts[False][a][b] / total[False][a])
        for a in range(n)
        for b in range(n)
    ]


def _found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _placed(found: Column, gaps: Column, kind: str) -> Column:
    """Spans (start, rank, end, kind, s) of matches, whose places are the lengths of what lies between and before them."""
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int, rank:int, end:int, kind:string, s:string>>)").alias("spans"))

    def add(acc, pair):
        start = acc["at"] + F.char_length(pair["gaps"])
        end = start + F.char_length(pair["found"])
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), pair["found"].alias("s"))
        return F.struct(end.alias("at"), F.array_append(acc["spans"], span).alias("spans"))

    pairs = F.arrays_zip(found.alias("found"), F.slice(gaps, 1, F.size(found)).alias("gaps"))
    return F.aggregate(pairs, zero, add, lambda acc: acc["spans"])


def spans(docs: DataFrame, ratios: list[float], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with the columns base and extra: the patterns' spans and the models', each an array by start, then kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.expr("cast(array() as array<struct<start:int, rank:int, end:int, kind:string, s:string>>)")
    patterns = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, CANDIDATE)))
    out = docs.withColumns({f"_{k}": _found(text, p) for k, p in patterns.items()})

    def at(kind: str) -> Column:
        found = F.col(f"_{kind}")
        return F.when(F.size(found) > 0, _placed(found, F.split(text, patterns[kind], -1), kind)).otherwise(none)

    out = out.withColumns({f"_{k}_at": at(k) for k in KINDS})
    base = F.concat(
        F.filter("_assign_at", lambda x: F.char_length(F.regexp_extract(x["s"], ASSIGN, 2)) >= 6),
        F.filter("_access_at", lambda x: F.char_length(x["s"]) >= 20),
        F.col("_hex_at"),
    )
    out = out.withColumn("base", F.sort_array(base))
    n, table, letters = len(ALPHABET), F.lit(np.array(ratios)), F.lit(ALPHABET)
    code = lambda s, i: F.instr(letters, F.substring(s, i, F.lit(1))) - 1

    def score(s):
        return F.aggregate(F.sequence(F.lit(1), F.char_length(s) - 1), F.lit(0.0), lambda acc, i: acc + F.get(table, code(s, i) * n + code(s, i + 1)))

    def lone(x):  # what a pattern's span holds whole is found already
        return ~F.exists("base", lambda b: (b["start"] <= x["start"]) & (x["end"] <= b["end"]))

    extra = F.filter("_random_at", lambda x: lone(x) & (score(x["s"]) >= threshold))
    return out.withColumn("extra", extra).select(*docs.columns, "base", "extra")


def listed(found: Column) -> Column:
    """kind:start:end of spans in their order, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratios: list[float] | None = None) -> DataFrame:
    """Counts and places of the secrets in every text."""
    ratios = ratios or train(samples(docs, id_col, text_col))
    found = spans(docs.select(id_col, text_col), ratios, text_col)
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        id_col,
        *map(count, KINDS[:3]),
        F.size("extra").cast("long").alias("n_random"),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.sort_array(F.concat("base", "extra"))).alias("spans"),
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]", ratios: list[float] | None = None) -> DataFrame:
    """docs with every span in its text replaced by mark; overlapping spans give one mark. A null text stays null."""
    ratios = ratios or train(samples(docs, id_col, text_col))
    source = docs.select(*docs.columns)
    found = spans(source.select(F.struct(*docs.columns).alias("_row"), F.col(text_col).alias("_text")), ratios, "_text")
    text = F.col("_text")
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, x):
        between = F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark))
        return F.struct(
            F.greatest(acc["at"], x["end"]).alias("at"),
            F.when(x["start"] >= acc["at"], between).otherwise(acc["out"]).alias("out"),
        )

    rest = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text)))
    every = F.sort_array(F.concat("base", "extra"))
    clean = F.when(F.size(every) == 0, text).otherwise(F.aggregate(every, zero, step, rest))
    return found.withColumn("_clean", clean).select(*(F.col("_clean").alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns))
