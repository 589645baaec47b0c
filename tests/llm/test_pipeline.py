import random

import pytest

import corpus_pipeline as cp
from quillspark.llm import decontaminate as dc
from quillspark.llm import piece_sampler as ps
from quillspark.llm.common import new_path

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, fp string, kept boolean"


@pytest.fixture(scope="module")
def folder(spark):
    rng = random.Random(8)
    vocab = [f"{a}{b}" for a in "bcdfgklmnprst" for b in ("al", "en", "ip", "or", "um", "ath", "ing")]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n)) + "."
    junk = lambda n: " ".join(rng.choice(vocab).upper() + "!!" for _ in range(n))
    items = [prose(30) for _ in range(4)]
    texts = {i: prose(rng.randrange(60, 200)) for i in range(40)}
    quality = {i: 1 for i in range(40)}
    for i in range(40, 70):
        texts[i], quality[i] = junk(80), 0
    texts[70], texts[71] = texts[3], texts[3]  # exact copies: the largest id stays
    words = texts[5].split()
    words[10] = "changed"
    texts[72] = " ".join(words)  # a near copy: the smallest id stays
    texts[73] = prose(40) + " " + items[0] + " " + prose(20)
    texts[74] = prose(40) + " " + items[1].upper().replace("AL", "ALL", 1) + " " + prose(20)
    path = new_path(spark, "pipeline-test")
    rows = [(i, t, "en", "s", len(t), 0.0, "x", False) for i, t in texts.items()] + [(80, None, None, None, None, None, None, None), (81, "", "en", "s", 0, None, None, None)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in quality.items()], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, texts, items


def test_stages_against_brute_force(spark, folder):
    path, texts, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = []
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == [c.split()[0] for c in DOCS.split(", ")]
        docs = spark.createDataFrame(docs.collect(), DOCS)
        kept.append({r.doc_id for r in docs.collect()})
    good = {i for i in texts if not 40 <= i < 70}
    assert kept[0] >= good and not any(40 <= i < 70 for i in kept[0])
    assert kept[1] == kept[0] - {3, 70} - ({80} if {80, 81} <= kept[0] else set())
    assert kept[2] == kept[1] - {72}
    held = {i for i in kept[2] if any(dc.myers(dc.normalised(b), dc.normalised(texts.get(i)))[0] <= dc.budget(dc.normalised(b)) for b in items)}
    assert {73, 74} <= held
    assert kept[3] == kept[2] - held


def test_run(spark, folder):
    path, texts, _ = folder
    rows = cp.run(spark, path).collect()
    v = ps.load_vocabulary(ps.default_model())
    assert rows and all(r.decoded and ps.decode(r.ids, v) == (texts.get(r.doc_id) or "") for r in rows)
    ids = {r.doc_id for r in rows}
    assert not ids & {3, 70, 72, 73, 74, *range(40, 70)} and {0, 5, 71} <= ids


def test_empty(spark, folder):
    path, _, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, path).count() == 0
