"""Each operator against a plain version, on the smallest tables with odd rows added, and on empty tables."""

import base64
import collections
import hashlib
import itertools
import io
import os
import time
import zipfile
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cirrusgrid.llm import archives, catalogue, components, fingerprints, jaccard, lines, packing, pieces, quality, repeats, secrets, toxicity, vectors
from cirrusgrid.llm.common import table

from . import brute

PIECES, WORDS = catalogue.tokenizer("piece_bpe_32k.model"), catalogue.tokenizer("word_bpe_49k.json")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def test_pieces_are_the_library_s(docs, texts):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = pieces.encode(docs, PIECES).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = lib.encode(texts[r["doc_id"]] or "", add_eos=True)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["library_agrees"]) == (len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids)), True)


def test_every_text_is_held_against_the_library():
    broken = pieces.PieceModel(PIECES)
    texts = [f"some w{i}ord of many" for i in range(40)]
    broken.encode_batch(texts)
    for key in list(broken.memo):
        if "ord" in key:
            broken.memo[key] = (*broken.memo[key], broken.byte[65])
    for _ in range(2):  # also in batches that add no word
        ids = broken.encode_batch([*texts, "some of many"])
        assert [broken.agrees(t, x, broken.decode(x)) for t, x in zip([*texts, "some of many"], ids)] == [False] * 40 + [True]
    assert not broken.agrees("some of many", ids[-1], "some of any")


def test_a_word_is_encoded_once_for_all_marks_after_it(monkeypatch):
    model, asked = pieces.PieceModel(PIECES), []
    plain = model.encode_word
    monkeypatch.setattr(model, "encode_word", lambda word: asked.append(word) or plain(word))
    texts = ["zorblat zorblat, zorblat. (zorblat) zorblat%%%", "zorblat\nzorblat,\nzorblat", "e\u0301, x\u0301. 日本, \n., a.b, 3.5, ▁. -, '' )\",", ""]
    for _ in range(2):
        assert model.encode_batch(texts) == [model.library.encode(t, add_eos=True) for t in texts]
    assert sum("zorblat" in word for word in asked) == 3  # after a space, a bracket and a line feed


def test_decoding_any_ids(rng):
    model = pieces.PieceModel(PIECES)
    for _ in range(300):
        ids = [rng.randrange(3, 259) if rng.random() < 0.4 else rng.randrange(1, 32000) for _ in range(12)]
        assert model.decode(ids) == model.library.decode(ids)


@pytest.mark.parametrize("word", ["▁" + "ab" * 40, "a" * 200, "日" * 60, "𝒳é" * 30])
def test_short_and_long_agendas_agree(word):
    model = pieces.PieceModel(PIECES)
    assert model.merge_short(word) == model.merge_long(word)


def test_lines_match_duckdb(spark, sf):
    rows = catalogue.QUERIES["op2_line_dedup"](spark, sf).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    found = con.execute(catalogue.ORACLE["op2_line_dedup"])
    assert [d[0] for d in found.description] == ["page_id", "host", "n_lines", "n_dropped", "text_sha256"]
    assert sorted(map(tuple, rows)) == sorted(map(tuple, found.fetchall()))


@pytest.mark.parametrize("name", ["op7_quality_rules", "op9_jaccard_join"])
def test_documents_match_duckdb(spark, sf, name):
    df = catalogue.QUERIES[name](spark, sf)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    found = con.execute(catalogue.ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(names).collect())) == sorted(map(tuple, found.fetchall()))


def test_lines_keep_clashing_columns(spark):
    rows = [(i, "a", f"menu\nown {i}", "x", 7, "h", "z", 5) for i in range(4)]
    pages = spark.createDataFrame(rows, "id int, host string, text string, line_hashes string, _at int, _h string, pages string, n_lines int")
    out = lines.dedup(pages.unionAll(pages), "host", "text").orderBy("id").collect()
    assert len(out) == 8 and [(r["text"], r["line_hashes"], r["_at"], r["_h"], r["pages"], r["n_lines"]) for r in out[:2]] == [("own 0", "x", 7, "h", "z", 2)] * 2


def test_lines_of_odd_pages(spark):
    pages = spark.createDataFrame([(i, "a", f"menu\nown {i}\n\n menu ") for i in range(5)] + [(9, None, None), (10, "a", None), (11, "b", "menu\n"), (12, "b", "")], "id int, host string, text string")
    out = {r["id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in lines.dedup(pages, "host", "text").collect()}
    assert out[0] == ("own 0\n", 3, 2) and out[9] == (None, 0, 0) and out[10] == (None, 0, 0) and out[11] == ("menu\n", 1, 0) and out[12] == ("", 0, 0)
    assert lines.dedup(pages.where("false"), "host", "text").count() == 0


def test_archives_round_trip(spark, sf):
    odd = spark.createDataFrame([(9001, "u", None), (9002, None, ""), (9003, "u\n", "é😀"), (9004, "v", "é😀"), (9004, "v", "é😀")], "page_id long, url string, html string")
    pages = table(spark, sf, "pages").unionByName(odd)
    manifest = archives.write(pages)
    rows = archives.read(manifest, with_payload=True).collect()
    by = collections.defaultdict(list)
    for p in pages.collect():
        by[(p["html"] or "").encode()].append(p["page_id"])
    want = sorted((i, len(k), base64.b32encode(hashlib.sha1(k).digest()).decode(), "response" if i == max(v) else "revisit", str(None if i == max(v) else max(v))) for k, v in by.items() for i in v)
    assert sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"])) for r in rows) == want
    assert all(r["digest_ok"] and r["payload"] in by for r in rows if r["record_type"] == "response")
    assert archives.read(archives.write(pages.where("false"))).count() == 0


def test_shared_payloads_of_any_number(spark, sf, monkeypatch):
    pages = table(spark, sf, "pages")
    few = archives.archive(spark, pages).drop("digest_ok").collect()
    monkeypatch.setattr(archives, "BROADCAST_SHARED", 0)
    assert sorted(map(str, archives.archive(spark, pages).drop("digest_ok").collect())) == sorted(map(str, few))


def test_packages_are_zip_files_with_or_without_index(tmp_path):
    package = archives.Package()
    for i in range(20):
        package.add(i, "u", b"x" * i * 1000, 3 if i == 5 else None)
    (tmp_path / "a.zip").write_bytes(package.bytes())
    z = zipfile.ZipFile(io.BytesIO(package.bytes()))
    assert z.testzip() is None and z.namelist() == ["archive/data.warc.gz", "indexes/index.cdxj"]
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as other:  # a plain ZIP, and no index
        other.writestr("archive/data.warc.gz", package.warc.getvalue())
    found = {n: [b - a for a, b in archives.places(f"file://{tmp_path}/{n}.zip")] for n in "ab"}
    assert len(found["a"]) == len(found["b"]) == 20
    for n in "ab":
        data = (tmp_path / f"{n}.zip").read_bytes()
        got = [archives.read_record(data[at : at + size]) for at, size in archives.places(f"file://{tmp_path}/{n}.zip")]
        assert [h["warc-record-id"] for h, _ in got] == [f"<urn:x-page:{i}>" for i in range(20)]
    (tmp_path / "c.zip").write_bytes(b"nothing")
    with pytest.raises(ValueError, match="not a ZIP"):
        list(archives.places(f"file://{tmp_path}/c.zip"))


def test_secrets(docs, texts):
    rows = secrets.scan(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        found, digest = brute.secrets(texts[r["doc_id"]])
        kinds = collections.Counter(f[3] for f in found)
        assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) == (kinds["assign"], kinds["access"], kinds["hex"], digest)
        assert {f"{k}:{a}:{e}" for a, _, e, k in found} <= set(r["spans"].split(","))
    odd = next(r for r in rows if r["doc_id"] == 100007)
    at = texts[100007].index("Zq8")
    assert f"random:{at}:{at + 21}" in odd["spans"]


def test_markov_models_against_a_plain_version(spark):
    rows = [("abcabcabc", False), ("xYz9Qw", True), ("x", True), (None, False), ("aé9", None)]
    ratios = secrets.train(spark.createDataFrame(rows, "s string, random boolean"))
    n, at = len(secrets.ALPHABET), secrets.ALPHABET.index
    count = lambda text, a, b: sum(x == a and y == b for x, y in zip(text, text[1:]))
    for a, b in ("ab", "bc", "xY", "9Q", "zz"):
        p, q = (((count(t, a, b) + 1) / (sum(count(t, a, c) for c in secrets.ALPHABET) + n)) for t in ("xYz9Qw", "abcabcabc"))
        assert ratios[at(a) * n + at(b)] == pytest.approx(np.log(p / q))
    assert len(ratios) == n * n


def test_redaction(docs, empty):
    out = {r["doc_id"]: r for r in secrets.redact(docs).collect()}
    assert out[100001]["text"] is None and out[100002]["text"] == "" and out[100007]["text"] == 'token=token:abcdef [SECRET] [SECRET] 🎉 [SECRET]" key [SECRET] end'
    assert secrets.redact(empty).columns == docs.columns and secrets.scan(empty).count() == 0


def test_quality(docs, texts, empty):
    rows = quality.judge(docs).collect()
    assert len(rows) == len(texts) and quality.judge(empty).count() == 0
    for r in rows:
        assert tuple(r)[1:6] + (r["base_failed"],) == brute.quality(texts[r["doc_id"]])
        assert not (r["kept"] and r["base_failed"])


def test_quality_tells_prose_from_junk(spark):
    prose = "\n".join(" ".join(f"word{i}x{j}" for j in range(12)) + "." for i in range(8))
    menu = " | ".join(f"entry{i} page{i}" for i in range(60))
    junk = " ".join(f"wo{i}rd%%% ot{i}her###" for i in range(40))
    df = spark.createDataFrame([(1, prose), (2, menu), (3, junk), (4, prose + "\nAll rights reserved.")], "doc_id int, text string")
    assert {r["doc_id"]: r["kept"] for r in quality.judge(df).collect()} == {1: True, 2: False, 3: False, 4: True}
    assert quality.clean(df.where("doc_id = 4")).first()["text"] == prose


def test_fingerprints(docs, texts, empty):
    rows = fingerprints.edited(docs).collect()
    ids = sorted(texts, reverse=True)
    after = dict(zip(ids, ids[1:] + ids[:1]))
    seen: dict[str, str] = {}
    assert len(rows) == len(texts) and fingerprints.edited(empty).count() == 0
    for r in rows:
        text, other = texts[r["doc_id"]] or "", texts[after[r["doc_id"]]] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + other[:half]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), sha(changed))
        assert seen.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        for got, to in ((r["near_edited"], changed), (r["near_next"], other)):
            a, b = brute.shingles(text), brute.shingles(to)
            assert abs(got - brute.jaccard(a, b)) <= (0.2 if len(a | b) > fingerprints.K else 1e-9)


def test_sketches_merge_and_estimate(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), F.xxhash64("id").alias("h"))
    parts = df.groupBy("g", (F.col("h") % 5).alias("p")).agg(F.slice(F.sort_array(F.collect_set("h")), 1, fingerprints.K).alias("s"))
    whole = {r["g"]: r["s"] for r in df.groupBy("g").agg(F.slice(F.sort_array(F.collect_set("h")), 1, fingerprints.K).alias("s")).collect()}
    merged = fingerprints.merge_groups(parts, "g", "s")
    assert {r["g"]: r["s"] for r in merged.collect()} == whole
    size = merged.select(fingerprints.distinct_shingles(F.col("s")).alias("n"), fingerprints.from_text(fingerprints.as_text(F.col("s"))).alias("t"), "s").collect()
    assert all(700 < r["n"] < 1300 and r["t"] == r["s"] for r in size)
    sub = spark.createDataFrame([([1, 2, 3], [2, 3, 4, 5]), ([], [1])], "a array<long>, b array<long>")
    assert [r[0] for r in sub.select(fingerprints.containment(F.col("a"), F.col("b"))).collect()] == pytest.approx([2 / 3, 1.0])


def near_copies(rng):
    base, rows = [f"w{rng.randrange(500)}" for _ in range(120)], []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(120)] = f"x{rng.randrange(9999)}"
        rows.append((20000 + i, " ".join(w)))
    passage = " ".join(f"p{i}" for i in range(60))
    return rows + [(30000 + i, passage + " " + " ".join(f"q{i}_{j}" for j in range(rng.randrange(3, 40)))) for i in range(60)]


@pytest.mark.parametrize(("block", "hot", "small"), [(4096, 100, 128), (10, 4, 5)])
def test_jaccard_join_loses_no_link(spark, docs, rng, block, hot, small, monkeypatch):
    for name, value in (("BLOCK", block), ("HOT", hot), ("SMALL", small)):
        monkeypatch.setattr(jaccard, name, value)
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(near_copies(rng), "doc_id long, text string")).repartition(3).cache()
    sets = {r["doc_id"]: brute.shingles(r["text"]) for r in both.collect()}
    want = brute.components(sets)
    rows = jaccard.join(both.withColumns({"n": F.lit(0), "hash": F.lit(0)})).collect()
    assert len(rows) == len(sets)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == {i: (len(s), want[i]) for i, s in sets.items()}


def test_jaccard_join_of_odd_rows(spark, empty):
    rows = [(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "A b c"), (3, None)]
    out = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert out == [("1", 1, "1"), ("1", 1, "1"), ("2", 1, "1"), ("3", 0, "3"), ("None", 1, "None")]
    assert jaccard.join(empty).count() == 0


def test_jaccard_join_gives_out_each_pair_once(spark, rng, monkeypatch):
    base, rows = [f"w{i}" for i in range(400)], []
    for i in range(30):  # alike, but hardly any similar enough: pairs meet in many tiles
        own = list(base)
        for at in rng.sample(range(400), 5):
            own[at] = f"x{i}_{at}"
        rows.append((i, " ".join(own)))
    given, stored = [], []
    links, keep = jaccard._links, jaccard.keep
    monkeypatch.setattr(jaccard, "_links", lambda pairs, *more: given.append([tuple(r) for r in pairs.collect()]) or links(pairs, *more))
    monkeypatch.setattr(jaccard, "keep", lambda df, tag, *more: stored.append((tag, df.columns)) or keep(df, tag, *more))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 40)
    try:
        out = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r["doc_id"]: r["component_id"] for r in out} == brute.components({i: brute.shingles(t) for i, t in rows})
    assert len(given[1]) > 20 and all(len(set(pairs)) == len(pairs) for pairs in given[1:])
    assert {tag for tag, columns in stored if "h" in columns} == {"named"}  # only sets that a pair names are stored


@pytest.mark.parametrize("few", [0, 200_000])
def test_jaccard_join_by_shuffle_or_driver(spark, rng, few, monkeypatch):
    rows = near_copies(rng)
    rows += [(None, rows[0][1]), (rows[0][0], rows[0][1]), (rows[0][0], rows[70][1]), (7, "a b"), (8, ""), (9, None)]
    stored, keep = [], jaccard.keep
    for module in (jaccard, components):
        monkeypatch.setattr(module, "FEW", few)
        monkeypatch.setattr(module, "keep", lambda df, tag, *more, name=module.__name__: stored.append((name.rpartition(".")[2], tag, df.columns)) or keep(df, tag, *more))
    out = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    sets = {i: brute.shingles(t) for i, t in enumerate(t for _, t in rows)}
    root, ids = brute.components(sets), [i for i, _ in rows]
    least = {}
    for i, r in root.items():
        if sets[i] and ids[i] is not None:
            least[r] = min(least.get(r, ids[i]), ids[i])
    want = [(ids[i], len(s), None if ids[i] is None else least[root[i]] if s else ids[i]) for i, s in sets.items()]
    assert collections.Counter(map(tuple, out)) == collections.Counter(want)
    assert any(name == "components" for name, _, _ in stored) == (few == 0)  # few links need no table of each round
    assert {tag for _, tag, columns in stored if "bits" in columns} == {"signatures"} and ("placed" in {tag for _, tag, _ in stored})


def shuffle_files(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for top in folders for _, _, files in os.walk(top) for f in files if f.startswith("shuffle_") and f.endswith(".data")}


@pytest.mark.parametrize("ids", [0, 200_000])
def test_jaccard_join_leaves_no_shuffle_files_and_deals_rows_once(spark, rng, ids, monkeypatch):
    left, exchanges, keep = [], [], jaccard.keep

    def watched(df, tag, *more):
        if tag == "placed":
            exchanges.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        before = shuffle_files(spark)
        out = keep(df, tag, *more)
        until = time.time() + 3  # Spark removes them on another thread
        while shuffle_files(spark) - before and time.time() < until:
            time.sleep(0.02)
        left.append((tag, len(shuffle_files(spark) - before)))
        return out

    monkeypatch.setattr(jaccard, "keep", watched)
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", ids)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows = near_copies(rng)
        was = spark.conf.get(key, None)
        out = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
        assert spark.conf.get(key, None) == was
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {r["doc_id"]: r["component_id"] for r in out} == brute.components({i: brute.shingles(t) for i, t in rows})
    assert [x for x in left if x[1]] == []
    # Rows by hash and, unless they are broadcast, its tiles; rows doubled for two bands are not dealt again.
    assert exchanges[0] == (2 if ids == 0 else 0)


@pytest.mark.parametrize("size", [1, 3, 100])
def test_sides_of_a_pair_over_batch_borders(size):
    sets = {1: range(10), 2: range(1, 11), 3: range(5), 4: range(11)}
    rows = [(a, b, k, np.array(sets[k], np.int64).tobytes()) for a, b in ((1, 2), (1, 3), (1, 4), (2, 4)) for k in (a, a, b, b)]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[i : i + size]]) for c in range(4)], names=["a", "b", "k", "h"]) for i in range(0, len(rows), size)]
    assert [(r["a"], r["b"]) for x in jaccard._verify_sides(iter(batches)) for r in x.to_pylist()] == [(1, 2), (1, 4), (2, 4)]


@pytest.mark.parametrize("few", [0, 200_000])
def test_components_by_shuffle_or_driver(spark, rng, few, monkeypatch):
    monkeypatch.setattr(components, "FEW", few)
    links = [(rng.randrange(90), rng.randrange(90)) for _ in range(60)] + [(i, i + 1) for i in range(340, 300, -1)]
    df = spark.createDataFrame([*links, (5, 5), (None, 6)], "a long, b long")
    root = {x: x for link in links if link[0] != link[1] for x in link}
    for _ in range(90):
        for a, b in links:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert sorted(map(tuple, components.components(df).collect())) == sorted(root.items())


def test_tile_stream_over_batch_borders(rng):
    rows = sorted((rng.randrange(40), rng.randrange(9), False) for _ in range(200))
    rows = [(h, k, early, 5 * (h % 9 == 0)) for h, k, early in rows]
    alone = list(dict.fromkeys(rows))
    count = collections.Counter(r[0] for r in alone)
    want = [r for r in alone if count[r[0]] > 1 or r[3]]
    for size in (1, 2, 7, 200):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[i : i + size]]) for c in range(4)], names=jaccard.TILE) for i in range(0, 200, size)]
        assert [tuple(r.values()) for b in jaccard._met(iter(batches)) for r in b.to_pylist()] == want


def test_first_hashes_put_frequent_ones_last(rng):
    sets = [np.array(sorted(rng.sample(range(400), rng.choice([0, 1, 5, 30, 200]))), np.int64) for _ in range(60)]
    hot = np.array(sorted(rng.sample(range(400), 250)), np.int64)
    for ordered in (hot, hot[:0]):
        last = set(ordered.tolist())
        flat, off = np.concatenate(sets), np.cumsum([0, *map(len, sets)])
        got = collections.defaultdict(dict)
        for row, place, rank in zip(*jaccard.first_hashes(flat, off, ordered), strict=True):
            got[row][rank] = flat[place]
        for i, s in enumerate(sets):
            want = sorted(s.tolist(), key=lambda x: (x in last, x))[: jaccard.reach(len(s))] if len(s) else []
            assert [got[i][r] for r in sorted(got[i])] == want


def test_word_hashes_tell_words_apart(rng):
    texts = pa.array(["a b  c\n", "", "  ", None, "\x1c\x85 é\u00a0x", "w" * 700 + " " + "w" * 701, "x" * 8 + " " + "x" * 9 + " " + "x" * 16 + " x\x00 x"])
    seen = {}
    for _, part in vectors.slices(texts, 20):
        flat, count = vectors.words(part)
        assert [len(brute.WORD.findall(t)) for t in part.to_pylist()] == count.tolist()
        for w, h in zip(flat.to_pylist(), vectors.hashes(flat).tolist(), strict=True):
            assert seen.setdefault(h, w) == w
    assert sorted(seen.values()) == sorted({w for t in texts.to_pylist() for w in brute.WORD.findall(t or "")})


def test_components(spark, rng):
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 400)]
    root = {x: x for l in links for x in l}
    for _ in range(200):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got.get(x, x) == r for x, r in root.items())
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_repeats(spark, docs, rng, empty):
    fresh = lambda n: [f"r{rng.randrange(10**6)}" for _ in range(n)]
    passages, rows = [fresh(n) for n in (49, 50, 51, 70, 300)], []
    for i in range(40):
        w = fresh(rng.randrange(20, 200))
        for p in rng.sample(passages, rng.randrange(3)):
            k = rng.randrange(len(w))
            w[k:k] = p
        rows.append((20000 + i, " ".join(w)))
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string")).repartition(3).cache()
    got = collections.defaultdict(set)
    for r in repeats.repeats(both).collect():
        got[r["doc_id"]] |= set(range(r["start_word"], r["end_word"]))
        assert r["n_words"] >= 50 and r["partners"]
    assert got == brute.repeated({r["doc_id"]: r["text"] for r in both.collect()})
    assert repeats.repeats(empty).count() == 0


def test_repeats_among_places_that_share_parts(spark, rng):
    fresh = lambda n: [f"q{rng.randrange(10**6)}" for _ in range(n)]
    texts = []
    for k, size, side in ((0, 56, 49), (1, 56, 49), (2, 70, 49), (3, 60, 36), (4, 83, 49)):
        notice = fresh(size)
        for part, copies in ((notice, 2), (notice[:side], 40), (notice[-side:], 40)):
            texts += [" ".join(fresh(rng.randrange(5, 40)) + part + fresh(rng.randrange(5, 40))) for _ in range(copies)]
    texts += ["x y z " * 100, "x y z " * 60]
    rng.shuffle(texts)
    got = collections.defaultdict(set)
    for r in repeats.repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)).collect():
        got[r["doc_id"]] |= set(range(r["start_word"], r["end_word"]))
    assert got == brute.repeated(dict(enumerate(texts)))


def test_removing_later_repeats_leaves_one_copy(spark, rng):
    number = itertools.count()
    fresh = lambda n: [f"p{next(number)}" for _ in range(n)]
    passages, rows = [], []
    for copies in (2, 3, 1000):
        whole, passage = fresh(80), fresh(60)
        passages += [whole, passage]
        rows += [whole] * copies + [fresh(rng.randrange(3, 9)) + passage + fresh(rng.randrange(3, 9)) for _ in range(copies)]
    rows.append(fresh(20) + passages[0][:70] + passages[1] + passages[3][5:] + fresh(20))  # runs that touch, of groups of unlike order
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string").repartition(7)
    gone = collections.defaultdict(set)
    for r in repeats.repeats(docs).collect():
        if r["later"]:
            gone[r["doc_id"]] |= set(range(r["start_word"], r["end_word"]))
    left = collections.Counter(w for i, words in enumerate(rows) for k, w in enumerate(words) if k not in gone[i])
    assert {left[w] for p in passages for w in p} == {1}


def test_packing_learns_each_of_many_words_once(monkeypatch):
    coder = packing.Encoder(catalogue.tokenizer("word_bpe_49k.json"))
    texts = pa.array([" ".join("".join(chr(97 + n // 26**i % 26) for i in range(5)) for n in range(at, at + 50_000)) for at in range(0, 250_000, 50_000)])
    once, asked, learn = coder.encode(texts, packing.END), [], coder.learn
    monkeypatch.setattr(coder, "learn", lambda chunks: asked.extend(chunks) or learn(chunks))
    again = coder.encode(texts, packing.END)
    assert not asked and all(np.array_equal(a, b) for a, b in zip(once, again, strict=True))


def test_packing_hands_the_library_few_new_words_at_once(monkeypatch):
    coder, asked = packing.Encoder(WORDS), []
    plain = coder.ids
    texts = [" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x, é" for i in range(300)), "", "one 12 two."]
    want = [[*np.frombuffer(x, "<u4").tolist(), 0] for x in plain(texts)]
    monkeypatch.setattr(packing, "TOGETHER", 40)
    monkeypatch.setattr(coder, "ids", lambda x: asked.append(max((len(t.split(" ")) for t in x), default=0)) or plain(x))
    ids, bounds = coder.encode(pa.array(texts), 0)
    assert [ids[i:j].tolist() for i, j in itertools.pairwise(bounds)] == want and max(asked) == 40
    ids, bounds = coder.encode(pa.array([], pa.string()), 0)
    assert len(ids) == 0 and bounds.tolist() == [0]


def test_packing_in_little_room(docs):
    by = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert by(packing.pieces(docs, WORDS, room=(50, 5000))) == by(packing.pieces(docs, WORDS))


def test_steps_forget_what_a_worker_remembers_for_others(monkeypatch):
    monkeypatch.setattr(vectors, "_held", {"encoder": object()})
    assert list(vectors.tidied(iter, holds=True)([1])) == [1] and vectors._held
    assert list(vectors.tidied(iter)([1])) == [1] and not vectors._held


def test_packing(docs, texts, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    rows = packing.pack(docs, WORDS).collect()
    by, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in texts.items():
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        assert sorted(by[i]) == [(k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())) for k in range(0, len(ids), 2048)]
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= 1.02 * -(-sum(r["length"] for r in rows) // 2048) + 1
    assert packing.pack(empty, WORDS).count() == 0


def test_plans(rng):
    for _ in range(200):
        histogram = {rng.randint(1, 50): rng.randint(1, 40) for _ in range(rng.randint(1, 15))}
        use, taken = collections.defaultdict(list), collections.Counter()
        for length, first, ranks, sequence, each, offset in packing.plan(histogram, 50):
            assert first == taken[length]
            taken[length] += ranks
            for j in range(ranks):
                use[sequence + j // each].append((offset + j % each * length, length))
        assert dict(taken) == histogram
        for places in use.values():
            assert all(a + n == b for (a, n), (b, _) in zip(sorted(places), sorted(places)[1:])) and sum(n for _, n in places) <= 50
    assert packing.plan({}) == []


def test_toxicity_on_held_out_rows(spark, rng, docs, empty):
    bad, good = ["grumblewort", "snarkfang", "vilethorn"], [f"word{i}" for i in range(300)]
    rows = []
    for i in range(1200):
        w = rng.choices(good, k=40)
        if i % 4 == 0:
            word = rng.choice(bad)
            w[rng.randrange(40)] = word[:5] + rng.choice("aeiou") + word[5:]  # misspelt, seldom twice alike
        rows.append((i, " ".join(w), int(i % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    out = toxicity.classify(df.drop("toxic"), df.select("doc_id", "toxic")).join(df, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5) for r in out)
    held = [r for r in out if r["held_out"]]
    assert sum(r["predicted"] == r["toxic"] for r in held) >= 0.9 * len(held)
    labels = df.select("doc_id", "toxic")
    assert toxicity.classify(empty, labels).count() == 0
    assert toxicity.classify(docs, labels.where("false")).where("score is null").count() == 0


@pytest.mark.parametrize(("size", "least"), [("sf0.1", 0.9), ("sf0.01", 0.6)])
def test_toxicity_of_the_tables_on_held_out_rows(spark, size, least):
    """0.9 and more where some hundred toxic labels are there to learn from; sf0.01 has 45 of them, in four languages."""
    folder = f"/root/testdata/{size}"
    out = catalogue.op10_toxicity(spark, folder).join(table(spark, folder, "labels"), "doc_id").where("held_out")
    n = {(r["toxic"], r["predicted"]): r["count"] for r in out.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] >= least * (n[1, 1] + n.get((1, 0), 0))
    assert n.get((0, 1), 0) <= 0.01 * (n[0, 0] + n.get((0, 1), 0))


def test_scores_are_means_over_features():
    model = toxicity.train([toxicity.bag(t) for t in ["bad thing here", "good thing there"] * 30], [1, 0] * 30)
    text = "a Bad, th1ng a "
    feats = np.concatenate([toxicity.grams([t])[0] for t in text.split()])
    want = model.bias + float(np.mean(model.weight[feats]))
    assert toxicity.scores(model, pa.array([text, None, ""])) == pytest.approx([1 / (1 + np.exp(-x)) for x in (want, model.bias, model.bias)])
    assert toxicity.grams(["th1ng"])[0].tolist() == toxicity.grams(["Thing,"])[0].tolist()


@pytest.mark.parametrize("joint", ["_", "", "."])
def test_long_tokens_count_whole(joint, rng):
    good = ["lorem", "ipsum", "dolor", "amet"]
    texts = [" ".join(rng.choices(good, k=20) + ["vilethorn"] * (3 * (i % 2))) for i in range(80)]
    model = toxicity.train([toxicity.bag(t) for t in texts], [i % 2 for i in range(80)])
    clean = joint.join(good * 10)
    a, b = toxicity.scores(model, pa.array([clean, joint.join([clean, *["vilethorn"] * 20])]))
    assert b > a + 0.2
    token = "x" + "abcde" * 4000
    bucket, of = toxicity.grams(["--", "ab", token, "", "ab"])
    assert [int((of == k).sum()) for k in range(5)] == [0, *(sum(max(0, len(t) + 2 - n + 1) for n in toxicity.GRAMS) + 1 for t in ("ab", token)), 0, sum(max(0, 4 - n + 1) for n in toxicity.GRAMS) + 1]
    assert sorted(bucket[of == 1]) == sorted(bucket[of == 4]) == sorted(toxicity.grams(["ab"])[0])
    ids, share = toxicity.bag("ab ab x")
    assert share.sum() == pytest.approx(1) and len(ids) == len(set(ids.tolist()))
