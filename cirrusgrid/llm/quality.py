"""Quality rules: lines are judged first, failing ones removed, then texts that lose too much are rejected.

All of it is DataFrame functions. A null text counts as one without words: it fails the base rule and is
not kept, as is an empty one. Texts of any length are read whole; repeated rows give repeated results;
columns besides id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, words

# Fixed values of the contract.
SYMBOLS = "#*$%&|<>"
WORD = r"[^\x20\x09-\x0D]"
MIN_WORDS, MAX_REPEATED = 50, 50

#: A line ends in one of these or has sentences inside, or it isn't prose.
ENDS = r"[.!?:;,…。！？)\]}\"'”’»›]$|[.!?]\s+\S.*[.!?]\s"
#: What stands between the entries of a menu.
SEPARATORS = "|»›•·>"
#: Lines that pages repeat around their content, when they are short.
BOILERPLATE = (
    r"(?i)\b(all rights reserved|copyright|cookies?|privacy policy|terms (of|and) (use|service|conditions)|java ?script|lorem ipsum|click here|"
    r"read more|sign (in|up)|log ?in|subscribe|newsletter|share this|follow us|back to top|powered by|(licensed|released) under)\b"
)
BOILERPLATE_WORDS = 25
#: Shares of a line's words: menu separators, symbols, exclamations.
MAX_SEPARATORS, MAX_SYMBOLS, MAX_SHOUTS = 0.1, 0.25, 0.25
#: The share of its characters that a kept text has left.
MIN_LEFT = 0.5


def _count(text: Column, chars: str) -> Column:
    """How many of chars a text has."""
    return F.char_length(text) - F.char_length(F.translate(text, chars, ""))


def line_fails(line: Column) -> Column:
    """Whether a line with a word breaks the punctuation, navigation or boilerplate rule; null never does."""
    text = F.trim(line)
    n = F.size(F.split(text, SPACES))
    unpunctuated = ~text.rlike(ENDS) | (_count(text, SYMBOLS) > MAX_SYMBOLS * n) | (_count(text, "!") > MAX_SHOUTS * F.greatest(n, F.lit(8)))
    menu = _count(text, SEPARATORS) > F.greatest(F.lit(1.0), MAX_SEPARATORS * n)
    return unpunctuated | menu | ((n <= BOILERPLATE_WORDS) & text.rlike(BOILERPLATE))


def _repeat_words(w: str) -> list:
    """Column steps that count the words standing in a three-word window found twice or more."""
    windows = F.when(
        F.size(w) >= 3,
        F.sort_array(F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.struct(F.xxhash64(F.slice(w, i, 3)).alias("h"), i.alias("i")))),
    )

    def twice(x, k):
        same = lambda other: F.coalesce(F.get("_windows", other)["h"] == x["h"], F.lit(False))
        return same(k - 1) | same(k + 1)

    places = F.sort_array(F.transform(F.filter("_windows", twice), lambda x: x["i"]))
    # A window's words that the next one doesn't have: three at most.
    own = F.transform("_places", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_places", k + 1) - p, F.lit(3))))
    return [("_windows", windows), ("_places", places), ("n_repeat_words", F.coalesce(F.aggregate(own, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"))]


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts and the verdict on every text.

    Returns id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines (with a word),
    n_failed_lines and left (the share of the lines' characters that stays; 0 without lines).
    """
    out = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    out = out.withColumn("_words", words(F.col("_text")))
    out = out.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(WORD)))
    for name, step in _repeat_words("_words"):
        out = out.withColumn(name, step)
    out = out.withColumn("_failed", F.filter("_lines", line_fails))
    chars = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + F.char_length(x))
    out = out.select(
        id_col,
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.regexp_replace("_text", SPACES, "")).cast("long").alias("word_chars"),
        _count(F.col("_text"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.size("_lines").cast("long").alias("n_lines"),
        F.size("_failed").cast("long").alias("n_failed_lines"),
        F.when(F.size("_lines") > 0, 1 - chars("_failed") / chars("_lines")).otherwise(0.0).alias("left"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("left") >= MIN_LEFT))


def clean(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs whose texts have lost their failing lines; lines without a word stay, and a null text stays null."""
    lines = F.filter(F.split(text_col, "\n"), lambda x: ~(x.rlike(WORD) & line_fails(x)))
    return docs.withColumn(text_col, F.array_join(lines, "\n"))


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


#: The same in DuckDB's words.
SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(string_split_regex(text, {_quoted(SPACES)}), lambda x: x <> '') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {_quoted(WORD)})) AS l FROM t),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
k AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
x AS (SELECT doc_id, length(x) AS size, trim(x, ' ') AS x, len(string_split_regex(trim(x, ' '), {_quoted(SPACES)})) AS n FROM (SELECT doc_id, unnest(l) AS x FROM w)),
f AS (SELECT doc_id, sum(size) AS size, count(*) FILTER (bad) AS n, coalesce(sum(size) FILTER (bad), 0) AS bad FROM (SELECT *,
  NOT regexp_matches(x, {_quoted(ENDS)}) OR length(x) - length(translate(x, {_quoted(SYMBOLS)}, '')) > {MAX_SYMBOLS} * n OR length(x) - length(translate(x, '!', '')) > {MAX_SHOUTS} * greatest(n, 8)
  OR length(x) - length(translate(x, {_quoted(SEPARATORS)}, '')) > greatest(1.0, {MAX_SEPARATORS} * n) OR (n <= {BOILERPLATE_WORDS} AND regexp_matches(x, {_quoted(BOILERPLATE)})) AS bad FROM x) GROUP BY doc_id),
o AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(text) - length(translate(text, {_quoted(SYMBOLS)}, '')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(k.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines, CAST(coalesce(f.n, 0) AS BIGINT) AS n_failed_lines,
  CASE WHEN len(l) > 0 THEN 1 - f.bad::DOUBLE / f.size::DOUBLE ELSE 0.0 END AS "left" FROM w LEFT JOIN k ON w.doc_id = k.doc_id LEFT JOIN f ON w.doc_id = f.doc_id)
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed, NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words) AND "left" >= {MIN_LEFT} AS kept FROM o
"""
