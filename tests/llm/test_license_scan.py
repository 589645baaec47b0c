import random
import re

from quillspark.llm import license_scan as ls

DOCS = "doc_id bigint, text string, label string, uid string, words string"
WORD = re.compile(ls.WORD)


def plain(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places, labels = [], set()
    for label, phrase in ls.PHRASES:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def rows(spark, texts):
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in enumerate(texts)], DOCS)
    return {r.doc_id: r for r in ls.scan_licenses(docs).collect()}


def base(r):
    return r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels


def test_base_against_brute_force(spark):
    rng = random.Random(2)
    pieces = ["MIT License", "mit", "license", "the", "Apache License,", "CC BY-NC", "cc", "by", "GNU General Public License", "gnu general", "public license", "É", "漢字", "|", "\n", "x9", "General Public", "cc by cc by", "mit license mit license"]
    texts = [None, "", "...", "license"] + [" ".join(rng.choice(pieces) for _ in range(rng.randrange(30))) for _ in range(120)]
    got = rows(spark, texts)
    for i, t in enumerate(texts):
        assert base(got[i]) == plain(t), t


def test_notices(spark):
    got = rows(spark, [
        "x Released under the MIT License.",
        "Licensed under CC BY-NC 4.0.",
        "Permission is hereby granted, free of charge, to any other person obtaining a copy of this software",
        "permission is granted to nobody",
        "redistribution in source",
        "Licensed under CC BY 4.0",
    ])
    assert got[0].labels == "mit" and got[0].score == 1.0
    assert got[1].labels == "cc-by,cc-by-nc-4.0"
    assert got[2].labels == "mit" and got[2].n_base == 0
    assert got[3].labels == "" and 0 < got[3].score < ls.COVER
    assert got[4].labels == ""
    assert got[5].labels == "cc-by,cc-by-4.0"


def test_edges(spark):
    docs = spark.createDataFrame([(None, "mit license", "", "", ""), (None, None, "", "", ""), (4, "mit license", "", "", ""), (4, "mit license", "", "", "")], DOCS)
    got = ls.scan_licenses(docs)
    assert sorted(((r.doc_id or -1), r.n_base) for r in got.collect()) == [(-1, 0), (-1, 1), (4, 1), (4, 1)]
    assert ls.scan_licenses(docs.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "mit license")], "doc_id bigint, text string")
    plan = ls.scan_licenses(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_a_long_text_takes_time_in_proportion(spark):
    import time

    text = "of the mit license and " * 40_000 + "gnu general public license"
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string").cache()
    docs.count()
    start = time.monotonic()
    r = ls.scan_licenses(docs).collect()[0]
    assert time.monotonic() - start < 20
    assert (r.n_words, r.n_base, r.first_word, r.last_word) == (200_004, 40_001, 2, 200_000)
