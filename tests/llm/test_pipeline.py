import zlib

import pytest

import corpus_pipeline
from tallyproof.llm import packing, tokens
from tallyproof.llm.common import stored
from tests.llm import brute
from tests.llm.test_texts import STRANGE, sentences

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, gone_id int, found int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    clean = {d: " ".join(f"the{d} cat{i % 7} and{d} w{d}x{i}" for i in range(20)) for d in range(1, 9)}
    passage = " ".join(f"p{i} is" for i in range(40))
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(d, t, "en", "s", len(t), 0, 0) for d, t in clean.items()]
    rows += [(20, clean[1] + " more", "en", "s", None, 0, 0), (21, None, "en", None, None, 0, 0), (22, "12 34", None, "s", 5, 0, 0)]
    own = {d: " ".join(f"the{d} cat{i % 7} and{d} v{d}x{i}" for i in range(30)) for d in (30, 31)}  # the passage is less than 3/4 of either text
    rows += [(30, f"other words first {passage} tail one {own[30]}", "en", "s", 1, 0, 0), (31, f"start {passage} goes on {own[31]}", "en", "s", 2, 0, 0),
             (40, "here " + item + " too", "en", "s", 3, 0, 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, {r[0]: r[1] for r in rows}, f"start goes on {own[31]}"


def test_stages(spark, folder):
    path, texts, rest = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    after = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, path), name.replace(" ", "_"))
        assert docs.columns == spark.read.parquet(f"{path}/documents.parquet").columns
        after[name] = {r["doc_id"]: r for r in docs.collect()}
    assert set(texts) - set(after["language"]) == {21, 22}
    assert set(after["language"]) - set(after["near duplicates"]) == {20}
    cut = after["repeated passages"]
    assert set(cut) == set(after["near duplicates"])
    assert {d: r["text"] for d, r in cut.items() if r["text"] != texts[d]} == {31: rest} and cut[31]["n_chars"] == len(rest)
    assert cut[40]["n_chars"] == 3
    assert set(cut) - set(after["benchmark decontamination"]) == {40}


def test_junk_and_languages_never_learned_go(spark):
    clean = sentences()
    rows = clean + [(9000 + i, t, None) for i, t in enumerate(STRANGE)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in corpus_pipeline.languages(spark, docs, "").collect()} == {r[0] for r in clean}


def test_run_packs_what_is_left(spark, folder):
    path, _, rest = folder
    rows = corpus_pipeline.run(spark, path).collect()
    assert {r["doc_id"] for r in rows} == {*range(1, 9), 30, 31}
    assert all(r["offset"] + r["length"] <= packing.CAPACITY for r in rows)
    ids = tokens.encoder(tokens.default_path()).tokenizer.encode(rest, add_special_tokens=False).ids + [0]
    import numpy as np
    assert next(r["ids_crc32"] for r in rows if r["doc_id"] == 31) == zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_on_the_given_tables(spark, small):
    """Near copies, repeats and benchmark passages of the smallest tables, against plain versions."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = {r["doc_id"]: r["text"] for r in stages["near duplicates"](spark, docs, small).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    sets = {d: brute.shingles(t) for d, t in texts.items()}
    assert set(kept) == {d for d, c in brute.components(sets, brute.near_links(sets)).items() if d == c}
    free = {r["doc_id"] for r in stages["benchmark decontamination"](spark, docs, small).collect()}
    found = brute.windows([(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()])
    assert free == {d for d, t in texts.items() if not brute.hits(t, found)[1]}
