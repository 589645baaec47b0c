import random
import zlib

import numpy as np

from quillspark.llm import quality as q
from quillspark.llm.queries import op8_quality

DOCS = "doc_id bigint, text string, score double, quality int"
LABELS = "doc_id bigint, quality int, text string"


def test_forms():
    assert [q.form(w) for w in ("the", "The!!", "ABC", "a1.", "|", "***", "é", "漢")] == ["a", "Aa!+", "A", "a0.", "|", "*+", "a", "x"]


def brute_force(texts, labels):
    """Margins by definition: dense ratios of all n-grams of two rows or more, the hinge-loss dual by plain projected steps."""

    def features(text):
        words = text.split()
        forms = ["<"] + [q.form(w) if not i or w != words[i - 1] else "same" for i, w in enumerate(words)] + [">"]
        own = [w.lower() for w in words]
        grams = [("f", *forms[i : i + n]) for n in (1, 2, 3) for i in range(len(forms) - n + 1)]
        return set(grams + [("w", *own[i : i + n]) for n in (1, 2) for i in range(len(own) - n + 1)])

    rows = [features(t) for t in texts]
    names = sorted({g for r in rows for g in r if sum(g in x for x in rows) >= q._MIN_ROWS})
    count = {c: [1 + sum(g in r for r, label in zip(rows, labels) if label == c) for g in names] for c in (0, 1)}
    ratio = np.log(np.array(count[1]) / sum(count[1])) - np.log(np.array(count[0]) / sum(count[0]))
    x = np.array([[ratio[i] * (g in r) for i, g in enumerate(names)] for r in rows])
    x = np.hstack([x / np.linalg.norm(x, axis=1, keepdims=True), np.ones((len(rows), 1))])
    y = np.where(np.array(labels) == 1, 1.0, -1.0)
    top = np.array([1 / (2 * np.mean(y == s)) for s in y])
    gram, alpha = (x * y[:, None]) @ (x * y[:, None]).T, np.zeros(len(rows))
    step = 1 / np.linalg.eigvalsh(gram)[-1]
    for _ in range(200_000):
        alpha = np.clip(alpha - step * (gram @ alpha - 1), 0, top)
    w = (alpha * y) @ x
    return x @ w, 0.5 * w @ w + top @ np.maximum(0, 1 - y * (x @ w))


def test_model_against_brute_force(monkeypatch):
    monkeypatch.setattr(q, "_ROUNDS", 3000)
    rng = random.Random(11)
    texts, labels = [], []
    for i in range(50):
        some = ["the", "Line", "proof", "clear", "of."] if i % 3 else ["the", "WIN!!", "bonus", "x&&", "of."]
        texts.append(" ".join(rng.choice(some + ["word", "next"]) for _ in range(12)))
        labels.append(int(i % 3 > 0) if i % 10 else i % 2)
    want, loss = brute_force(texts, labels)
    model = q.fit_rows([q.ngrams(t) for t in texts], np.array(labels))
    got = []
    for t in texts:
        at = np.flatnonzero(np.isin(model.grams, q.ngrams(t)))
        got.append(model.weight[at].sum() / np.sqrt(model.square[at].sum()) + model.bias)
    assert np.abs(np.array(got) - want).max() < 0.02
    curve = [model.score(t) for t in texts]
    assert np.argsort(curve).tolist() == np.argsort([1 / (1 + np.exp(-(model.slope * g + model.shift))) for g in got]).tolist()


def test_too_many_grams_are_left_out_whole(spark, monkeypatch):
    docs, labels = corpus(spark)
    monkeypatch.setattr(q, "GRAMS", 1)
    assert {r.score for r in q.score_documents(docs, labels).collect()} == {0.5}


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in op8_quality(spark, folder).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all(rows[i].held_out for i in held)
    assert sum(rows[i].predicted == labels[i] for i in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())


def corpus(spark, n=120):
    rng = random.Random(3)
    good = lambda: " ".join(rng.choice(["the", "And", "word,", "of.", "line"]) for _ in range(40))
    bad = lambda: " ".join(rng.choice(["THE!!", "a%%%", "|", "x&&&"]) for _ in range(40))
    texts = [good() if i % 2 else bad() for i in range(n)]
    docs = spark.createDataFrame([(i, t, 9.0, 1 - i % 2) for i, t in enumerate(texts)] + [(None, None, 0.0, 0), (None, "", 0.0, 0)], DOCS)
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(n)] + [(None, 1, ""), (1, None, ""), (3, 7, "")], LABELS)
    return docs, labels


def test_classes(spark):
    docs, labels = corpus(spark)
    rows = q.score_documents(docs, labels).collect()
    assert len(rows) == 122
    assert all(r.predicted == r.doc_id % 2 for r in rows if r.doc_id is not None)
    assert [r.held_out for r in rows if r.doc_id is None] == [False, False]
    assert all(r.doc_id % 2 for r in q.keep_good(docs, labels).collect() if r.doc_id is not None)


def test_held_out_labels_teach_nothing(spark):
    docs, labels = corpus(spark)
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS string)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    a, b = ({(r.doc_id, r.score) for r in q.score_documents(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_few_labels(spark):
    docs, labels = corpus(spark, 20)
    none = labels.filter("doc_id < 0")
    assert {r.score for r in q.score_documents(docs, none).collect()} == {0.5}
    assert {r.score for r in q.score_documents(docs, labels.filter("quality = 1")).collect()} == {1.0}
    assert q.score_documents(docs.limit(0), labels).count() == 0


def test_repeated_rows_change_nothing(spark):
    docs, labels = corpus(spark)
    twice = docs.unionAll(docs)
    a = {(r.doc_id, r.score) for r in q.score_documents(docs, labels).collect()}
    assert {(r.doc_id, r.score) for r in q.score_documents(twice, labels.unionAll(labels)).collect()} == a


def test_all_runs_and_the_words_count(spark):
    assert q.form("a1" * 50) == "a0" * 50
    rng = random.Random(5)
    words = lambda some: " ".join(rng.choice(some) for _ in range(30))
    texts = [words(["clear", "proof", "theorem"] if i % 2 else ["casino", "bonus", "jackpot"]) for i in range(120)]
    docs = spark.createDataFrame([(i, t, 0.0, 0) for i, t in enumerate(texts)], DOCS)
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(120)], LABELS)
    rows = q.score_documents(docs, labels).collect()
    assert any(r.held_out for r in rows) and all(r.predicted == r.doc_id % 2 for r in rows)
