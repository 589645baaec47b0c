import random

import numpy as np
import xxhash

from quillspark.llm import simhash

DOCS = "doc_id bigint, text string, text2 string"


def plain_fingerprint(text, k):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, distance=3):
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = list(fps)
    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= distance:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_fingerprint():
    for t in (None, "", " \t\n", "One", "one two", "É One  two\tthree FOUR", "a b c a b c a b c", "x " * 300):
        assert simhash.fingerprint(t, 3) == plain_fingerprint(t, 3)


def test_block_masks_cover():
    rng = random.Random(1)
    masks = simhash.block_masks(list(range(64)))
    assert len(masks) == 20
    for _ in range(500):
        diff = sum({1 << rng.randrange(64) for _ in range(3)})
        assert any(not diff & m for m in masks)


def check(spark, texts, **kw):
    rows = simhash.near_groups(spark.createDataFrame([(i, t, None) for i, t in texts.items()], DOCS), 3, **kw).collect()
    assert len(rows) == len(texts)
    fps = {i: plain_fingerprint(t, 3) for i, t in texts.items()}
    assert {r.doc_id: int(r.fingerprint, 16) for r in rows} == fps
    assert {r.doc_id: r.component_id for r in rows} == plain_components(fps)


def test_components(spark):
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(50)]
    texts = {}
    for g in range(12):
        base = [rng.choice(vocab) for _ in range(120)]
        for _ in range(5):
            changed = list(base)
            for _ in range(rng.randrange(3)):
                changed[rng.randrange(120)] = rng.choice(vocab)
            texts[len(texts) * 3 + 5] = " ".join(changed)
    texts |= {1: None, 2: "", 4: "  ", 0: "alone"}
    check(spark, texts)


def test_large_buckets_are_divided(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(400)]
    texts = {}
    for i in range(60):
        changed = list(base)
        changed[rng.randrange(400)] = f"x{i}"
        texts[i] = " ".join(changed)
    check(spark, texts, bucket=4)


def test_links_are_complete(spark):
    rng = random.Random(5)
    fps = set()
    for _ in range(15):
        c = rng.getrandbits(64)
        fps.add(c)
        for _ in range(6):
            c ^= sum({1 << rng.randrange(64) for _ in range(rng.randrange(1, 4))})
            fps.add(c)
    ids = {simhash._signed(f): f for f in fps}
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in ids], "fp bigint")).collect()
    root = {f: f for f in ids}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for r in links:
        assert (ids[r.a] ^ ids[r.b]).bit_count() <= 3
        x, y = sorted((find(r.a), find(r.b)))
        root[y] = x
    assert {f: find(f) for f in ids} == plain_components({f: ids[f] for f in ids})


def test_edges(spark):
    empty = simhash.near_groups(spark.createDataFrame([], DOCS))
    assert empty.count() == 0
    rows = simhash.near_groups(spark.createDataFrame([(None, "a b c d", None), (3, "a b c d", None), (3, "a b c d", None), (None, "z", None)], DOCS), 3).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in rows) == [(-1, -1), (-1, 3), (3, 3), (3, 3)]


def test_drop(spark):
    docs = spark.createDataFrame([(2, "a b c d", "x"), (1, "A B c d", "y"), (9, "quite another text", "z")], DOCS)
    assert sorted(simhash.drop_near_copies(docs).collect()) == [(1, "A B c d", "y"), (9, "quite another text", "z")]


def jaccard(a, b, k=5):
    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def test_groups_by_similarity(spark):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(4000)]
    texts = {}
    for g in range(60):
        base = [rng.choice(vocab) for _ in range(rng.randrange(120, 400))]
        for c in range(4):
            changed = list(base)
            for _ in range(c * len(base) // 120):
                changed[rng.randrange(len(base))] = rng.choice(vocab)
            texts[len(texts) + 1] = " ".join(changed)
    docs = spark.createDataFrame([(i, t, None) for i, t in texts.items()] + [(None, texts[1], None), (0, None, None), (1000, "", None)], DOCS)
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect() if r.doc_id is not None}
    assert len(got) == len(texts) + 2
    pairs = [(a, b) for a in texts for b in texts if a < b and (a - 1) // 4 == (b - 1) // 4]
    close = [(a, b) for a, b in pairs if jaccard(texts[a], texts[b]) >= 0.82]
    assert len(close) > 60
    assert sum(got[a] == got[b] for a, b in close) >= 0.98 * len(close)
    assert not any(got[a] == got[b] for a in texts for b in texts if (a - 1) // 4 != (b - 1) // 4)
    assert got[0] == got[1000] == 0
    alone = [r.component_id for r in simhash.similar_groups(docs).collect() if r.doc_id is None]
    assert alone == [1]


def test_one_large_group_of_near_copies(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    texts = []
    for i in range(9000):
        changed = list(base)
        changed[rng.randrange(300)] = f"x{i}"
        texts.append(" ".join(changed))
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], DOCS).repartition(8)
    links = simhash.similar_links(simhash.wide_fingerprints(docs).selectExpr("doc_id AS id", "n", "fp"))
    assert links.count() < 64 * 9000
    groups = simhash.similar_groups(docs).groupBy("component_id").count().collect()
    assert [(r.component_id, r["count"]) for r in groups] == [(0, 9000)]


def test_wide_bits():
    a = simhash.wide_fingerprint("one two three four five six")
    assert a[0] == 2 and len(a[1]) == 128
    assert simhash.wide_fingerprint(None) == simhash.wide_fingerprint(" ") == (0, bytes(128))
    assert simhash.wide_fingerprint("a b") == simhash.wide_fingerprint(" A  b ")


def bits_apart(a, b):
    return (int.from_bytes(a, "little") ^ int.from_bytes(b, "little")).bit_count()


def test_near_copies_in_a_templated_family(spark):
    """Many texts share a passage at a similarity of 0.5 to 0.7; some have a true copy among them."""
    rng = random.Random(12)
    template, texts = [f"t{i}" for i in range(400)], []
    for i in range(500):
        own = [f"o{i}x{j}" for j in range(rng.randrange(80, 140))]
        texts.append(template + own)
        if i % 5 == 0:
            copy = template + own
            copy[rng.randrange(len(copy))] = "changed"
            texts.append(copy)
    order = list(range(len(texts)))
    rng.shuffle(order)
    texts = [" ".join(texts[i]) for i in order]
    assert all(0.5 < jaccard(texts[0], t) < 0.75 for t in texts[1:50] if jaccard(texts[0], t) < 0.9)
    fps = [simhash.wide_fingerprint(t)[1] for t in texts]
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], DOCS)).collect()}
    limit = simhash.differing_bits(simhash.SIMILARITY)
    near = [(a, b) for a in range(len(fps)) for b in range(a) if bits_apart(fps[a], fps[b]) <= limit and bits_apart(fps[a][:16], fps[b][:16]) <= simhash._NEAR]
    shared = [(a, b) for a, b in near if any(fps[a][2 * i : 2 * i + 2] == fps[b][2 * i : 2 * i + 2] for i in range(64))]
    assert len(shared) >= 95
    assert [(a, b) for a, b in shared if got[a] != got[b]] == []
    assert len(set(got.values())) > 300


def flipped(fp, bits):
    return bytes(x ^ y for x, y in zip(fp, sum(1 << b for b in bits).to_bytes(128, "little")))


def test_late_rows_of_a_large_bucket_meet_all_earlier_ones(spark):
    """9000 unlike rows share one block; late ones are near to an early row only, one of those inside a tree."""
    rng = random.Random(6)
    fps = [bytes(2) + rng.randbytes(126) for _ in range(9000)]
    first, second = (list(range(16 + i, 128, 5)) + list(range(128 + i, 1024, 11)) for i in (0, 1))
    fps[20] = flipped(fps[10], first)
    fps[8800] = flipped(fps[20], second)
    fps[8900] = flipped(fps[5000], first)
    rows = spark.createDataFrame([(i, 100, f) for i, f in enumerate(fps)], "id bigint, n int, fp binary").repartition(8)
    assert {tuple(sorted(r)) for r in simhash.similar_links(rows).collect()} == {(10, 20), (20, 8800), (5000, 8900)}


def test_forest_against_brute_force(monkeypatch):
    rng = np.random.default_rng(8)
    values = rng.integers(0, 1 << 12, (700, 1)).astype(np.uint64)
    near = lambda x, y: np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64) <= 1
    root = list(range(700))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(700):
        for b in range(a):
            if int(values[a, 0] ^ values[b, 0]).bit_count() <= 1:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    want = [find(i) for i in range(700)]
    for held in (1 << 18, 100):
        forest = simhash._Forest(near)
        monkeypatch.setattr(simhash, "_HELD", held)
        links = [x for j in range(0, 700, 37) for x in forest.add(np.arange(j, min(j + 37, 700)), values[j : j + 37])]
        assert len(links) == 700 - len(set(want)) and all(int(values[a, 0] ^ values[b, 0]).bit_count() <= 1 for a, b in links)
        assert {want[a] for a, b in links} == {want[b] for a, b in links} and all(want[a] == want[b] for a, b in links)
        ids, trees = forest.groups()
        assert len({(want[i], t) for i, t in zip(ids.tolist(), trees.tolist())}) == len(set(trees.tolist())) == sum(want.count(r) > 1 for r in set(want))


def test_near_copies_without_an_id(spark):
    rng = random.Random(2)
    base = [[f"w{rng.randrange(5000)}" for _ in range(300)] for _ in range(3)]

    def copy(g, i):
        return " ".join([*base[g][:i], f"x{i}", *base[g][i + 1 :]])

    rows = [(5, copy(0, 10), "a"), (None, copy(0, 20), "b"), (None, copy(1, 10), "c"), (None, copy(1, 20), "d"), (None, copy(1, 20).upper(), "e"), (None, copy(2, 10), "f")]
    docs = spark.createDataFrame(rows, DOCS)
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.similar_groups(docs).collect()) == [(-1, -1)] * 4 + [(-1, 5), (5, 5)]
    kept = "".join(sorted(r.text2 for r in simhash.drop_near_copies(docs).collect()))
    assert len(kept) == 3 and kept[0] == "a" and kept[1] in "cde" and kept[2] == "f"


def test_drop_by_row_and_with_clashing_columns(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    near = base[:60] + ["changed"] + base[61:]
    other = [f"v{rng.randrange(10**6)}" for _ in range(120)]
    j = " ".join
    rows = [(1, j(base)), (2, j(near)), (2, j(other)), (3, j(other) + " end"), (4, j(base)), (None, j(near)), (None, "alone of all"), (7, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], "doc_id bigint, text string, __id string, mark string, fp string")
    for few in (0, 100):
        got = simhash.drop_near_copies(docs, few=few).collect()
        assert sorted((str(r.doc_id), r.text or "") for r in got) == sorted([("1", j(base)), ("2", j(other)), ("None", "alone of all"), ("7", "")])
        assert {(r["__id"], r.mark, r.fp) for r in got} == {("x", "y", "z")}
