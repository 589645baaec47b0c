import random

from quillspark.llm import decontaminate as dc

DOCS = "doc_id bigint, text string, item_id string, start string"
ITEMS = "item_id bigint, text string, doc_id string"


def plain_best(item, text):
    """Least edit distance of the item to any stretch of the text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        after = [i]
        for j, b in enumerate(text, 1):
            after.append(min(row[j - 1] + (a != b), row[j] + 1, after[-1] + 1))
        row = after
    return min(row)


def edited(rng, s, n):
    s = list(s)
    for _ in range(n):
        at = rng.randrange(len(s))
        match rng.randrange(3):
            case 0:
                s[at] = rng.choice("abcdef")
            case 1:
                s.insert(at, rng.choice("abcdef"))
            case _:
                del s[at]
    return "".join(s)


def test_myers():
    rng = random.Random(1)
    for _ in range(300):
        item = "".join(rng.choice("abc ") for _ in range(rng.randrange(1, 90)))
        text = "".join(rng.choice("abc ") for _ in range(rng.randrange(0, 120)))
        d, end = dc.myers(item, text)
        assert d == plain_best(item, text) == plain_best(item, text[:end])


def test_pieces_make_up_the_item():
    for n in (1, 5, 100):
        item = "x" * n
        for e in (0, 3, 200):
            assert "".join(p for _, p in dc.pieces(item, e)) == item


def test_against_brute_force(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randrange(2, 7)))
    items = [" ".join(word() for _ in range(rng.randrange(3, 25))) for _ in range(8)]
    docs = []
    for _ in range(60):
        parts = [" ".join(word() for _ in range(rng.randrange(30)))]
        for item in rng.sample(items, rng.randrange(3)):
            e = dc.budget(item)
            parts += [edited(rng, item, rng.randrange(e + 4)), " ".join(word() for _ in range(rng.randrange(10)))]
        docs.append(" ".join(parts))
    want = set()
    for d, t in enumerate(docs):
        for i, item in enumerate(items):
            clean, own = dc.normalised(t), dc.normalised(item)
            if (best := plain_best(own, clean)) <= dc.budget(own):
                want.add((d, i, best))
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in enumerate(docs)], DOCS)
    bench = spark.createDataFrame([(i, t, "z") for i, t in enumerate(items)], ITEMS)
    for block in (dc.BLOCK, 60):
        rows = dc.find_items(df, bench, block=block).collect()
        assert {(r.doc_id, r.item_id, r.edits) for r in rows} == want and len(rows) == len(want)
        for r in rows:
            part = dc.normalised(docs[r.doc_id])[r.start : r.end]
            assert plain_best(dc.normalised(items[r.item_id]), part) == r.edits
    assert len(want) > 30


def test_case_and_marks_dont_matter(spark):
    item = "La. Ai éonleeau pour an éonqueê aivi, and some more words of it"
    docs = spark.createDataFrame([(1, "x y " + item.upper().replace(" ", "!! ") + " z", "", ""), (2, "nothing of it", "", ""), (3, None, "", ""), (None, item, "", ""), (4, item + " - " + item, "", "")], DOCS)
    bench = spark.createDataFrame([(7, item, ""), (8, None, ""), (9, "...", ""), (None, "zzz zzz zzz", "")], ITEMS)
    rows = dc.find_items(docs, bench).collect()
    assert sorted((str(r.doc_id), r.item_id, r.edits) for r in rows) == [("1", 7, 0), ("4", 7, 0), ("None", 7, 0)]
    for block in (dc.BLOCK, 10):
        assert sorted(r.doc_id for r in dc.drop_contaminated(docs, bench, block=block).collect()) == [2, 3]


def test_empty(spark):
    docs, bench = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert dc.find_items(docs, bench).count() == 0
    one = spark.createDataFrame([(1, "a", "", "")], DOCS)
    assert dc.find_items(one, bench).count() == 0
    assert dc.drop_contaminated(one, bench).count() == 1


def test_short_items_are_whole_words(spark):
    texts = ["The end", "at the end", "see the", "the", "other end", "bathe", "theory", "other, but the end", "see, the-other", None]
    docs = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], DOCS)
    bench = spark.createDataFrame([(7, "The", ""), (8, "see the", "")], ITEMS)
    rows = {(r.doc_id, r.item_id, r.edits, r.start, r.end) for r in dc.find_items(docs, bench).collect()}
    assert rows == {(0, 7, 0, 0, 3), (1, 7, 0, 3, 6), (2, 7, 0, 4, 7), (2, 8, 0, 0, 7), (3, 7, 0, 0, 3), (7, 7, 0, 10, 13), (8, 7, 0, 4, 7), (8, 8, 0, 0, 7)}
    assert sorted(r.doc_id for r in dc.drop_contaminated(docs, bench).collect()) == [4, 5, 6, 9]
