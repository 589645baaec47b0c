import hashlib
import random
from collections import Counter

from quillspark.llm import substring_dedup as sd

DOCS = "doc_id bigint, text string, key string, uid string"


def brute(texts, k):
    words = [[w for w in (t or "").replace("\t", " ").replace("\n", " ").split(" ") if w] for t in texts]
    seen = Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - k + 1) if seen[tuple(w[i : i + k])] > 1 for j in range(i, i + k)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def got(spark, texts, k, **kw):
    docs = spark.createDataFrame([(i if i % 3 else None, t, "a", "b") for i, t in enumerate(texts)], DOCS)
    rows = sd.remove_repeats(docs, window=k, **kw).collect()
    for r in rows:
        if r.kept_text is not None:
            assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256
    return sorted((r.n_words, r.n_removed, r.kept_sha256) for r in rows)


def corpus(seed):
    rng = random.Random(seed)
    shared = [[rng.choice("abcdefgh") + str(rng.randrange(30)) for _ in range(rng.randrange(5, 40))] for _ in range(4)]
    texts = [None, "", " \t ", "be " * 300, "x y " * 40]
    for _ in range(25):
        w = [rng.choice("abcdefgh") + str(rng.randrange(30)) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(w) + 1)
            w[at:at] = rng.choice(shared)
        texts.append("\n".join(w))
    return texts + texts[5:8]


def test_against_brute_force(spark):
    for seed in (1, 2):
        texts = corpus(seed)
        assert got(spark, texts, 10, size=4, bits=12) == brute(texts, 10)


def test_hot_buckets_and_a_full_filter(spark):
    texts = corpus(3)
    assert got(spark, texts, 10, size=4, bits=6, hot=2) == brute(texts, 10)


def test_window_of_production(spark):
    long = " ".join(f"w{i}" for i in range(200))
    texts = [long, "q " + long[:400] + " r", "Wörter " + long, "short one"]
    assert got(spark, texts, sd.WINDOW) == brute(texts, sd.WINDOW)


def test_empty(spark):
    assert sd.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_minimisers_are_least():
    rng = random.Random(4)
    words = [rng.choice("abc").encode() for _ in range(100)]
    rolled, least = sd.minimisers(words, 20, 5)
    assert len(least) == 81
    assert all(least[i] == rolled[i : i + 16].min() for i in range(81))
