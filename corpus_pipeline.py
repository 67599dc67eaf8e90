"""The corpus pipeline over documents: toxic ones go, boilerplate lines go, of similar ones one stays, secrets are masked, and the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs. All
but the last return the columns of documents; n_chars follows the text where a stage changes it.

Null and empty texts pass every stage and are packed as an end id alone; texts of any length are taken whole. Rows without an
id are never like another. Rows that repeat an id and text count once where similar ones do. Columns besides those of
documents are left out, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cirrusgrid.llm import catalogue, jaccard, lines, packing, secrets, toxicity
from cirrusgrid.llm.common import keep, table

#: Chunks a worker remembers while it packs, and bytes of text it encodes together: less than by itself, as earlier stages leave less memory. No result depends on it.
ROOM = (200_000, 1 << 20)
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels that aren't held out, doesn't find toxic; a text without words stays."""
    labels = table(spark, sf_dir, "labels")
    model = toxicity.learn(docs, labels, "doc_id", "text", "toxic", ~toxicity.held_out("doc_id"))
    scored = toxicity.score(docs.select(COLUMNS), model, keep=True)
    return scored.where((F.col("predicted") == 0) | (F.trim(F.coalesce("text", F.lit(""))) == "")).select(COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the boilerplate lines of their source, which is the host of a document."""
    return _counted(lines.dedup(docs.select(COLUMNS), "source", "text"))


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones, that of the least id, once; documents without an id or a word all stay."""
    found = jaccard.join(docs).select("doc_id", "n_shingles", "component_id")
    gone = found.where("n_shingles > 0 and doc_id <> component_id").select("doc_id").distinct()
    kept = docs.select(COLUMNS).join(gone.hint("merge"), "doc_id", "left_anti")
    # Rows that repeat an id are alike as far as their sets go; one stays of those that have one.
    twice = found.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    again = kept.join(twice.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(twice.hint("merge"), "doc_id", "left_anti").unionByName(again).select(COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret replaced by a mark."""
    return _counted(secrets.redact(docs.select(COLUMNS)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every text with its sequence and place."""
    return packing.pack(docs, catalogue.tokenizer("word_bpe_49k.json"), room=ROOM)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_similar),
    ("secret scans", mask_secrets),
    ("best-fit packing", pack),
]

#: Trained models and tokenizers have no SQL; each stage is tested against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
