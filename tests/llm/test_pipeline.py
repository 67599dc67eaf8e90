"""The pipeline's stages: what each decides, on the smallest tables, with planted cases."""

import corpus_pipeline
import numpy as np
import pytest

from cirrusgrid.llm import toxicity
from cirrusgrid.llm.common import keep, table

from . import brute


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = table(spark, sf, "documents")
    words = " ".join(f"plain{i}" for i in range(80))
    planted = [(900001, words + " one.", "en", "s", 0), (900002, words + " two.", "en", "s", 0), (900003, "token = abcdef0123456789 " + " ".join(f"other{i}" for i in range(80)), "en", "s", 0), (900004, None, None, None, None)]
    docs = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    found = [docs]
    for name, stage in corpus_pipeline.STAGES:
        found.append(keep(stage(spark, found[-1], sf), "test-" + name.replace(" ", "-")))
    return found


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "secret scans", "best-fit packing"]
    assert all(d.columns == corpus_pipeline.COLUMNS for d in stages[1:-1])


def test_toxic_documents_go(stages, spark, sf):
    """Against scores that are plain means over the features of every word."""
    model = toxicity.learn(stages[0], table(spark, sf, "labels"), "doc_id", "text", "toxic", ~toxicity.held_out("doc_id"))

    def score(text):
        words = brute.WORD.findall(text or "")
        found = np.concatenate([np.zeros(0, np.int64), *(toxicity.grams([w])[0] for w in words)])
        return model.bias + (float(model.weight[found].mean()) if len(found) else 0.0)

    want = {r["doc_id"] for r in stages[0].collect() if score(r["text"]) < 0 or not (r["text"] or "").strip()}
    assert {r["doc_id"] for r in stages[1].collect()} == want and {900001, 900004} <= want


def test_boilerplate_lines_go(stages):
    want = brute.without_boilerplate([(r["doc_id"], r["source"], r["text"]) for r in stages[1].collect()])
    assert {r["doc_id"]: r["text"] for r in stages[2].collect()} == want
    assert stages[2].where("n_chars <> char_length(text)").count() == 0


def test_one_of_each_group_stays(stages):
    before = {r["doc_id"]: brute.shingles(r["text"]) for r in stages[2].collect()}
    want = {i for i, c in brute.components(before).items() if i == c}
    assert {r["doc_id"] for r in stages[3].collect()} == want
    assert 900001 in want and 900002 not in want


def test_secrets_are_masked_and_documents_stay(stages):
    assert stages[4].count() == stages[3].count()
    text = stages[4].where("doc_id = 900003").first()["text"]
    assert text.startswith("[SECRET] other0")
    assert all(not brute.secrets(r["text"])[0] for r in stages[4].collect())
    assert stages[4].where("n_chars <> char_length(text)").count() == 0


def test_packing_takes_all(stages):
    assert {r["doc_id"] for r in stages[5].collect()} == {r["doc_id"] for r in stages[4].collect()} and 900004 in {r["doc_id"] for r in stages[5].collect()}
