import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import analysis, synonyms


def terms(spark, name, text):
    analyzer = analysis.analyze(name)
    return spark.createDataFrame([(text,)], "t string").select(analyzer(F.col("t")).alias("r")).first().r


def test_standard(spark):
    assert terms(spark, None, "Running and TESTING analyzers") == ["runn", "test", "analyzer"]
    assert terms(spark, "english-nostem", "Running and TESTING analyzers") == ["running", "testing", "analyzers"]
    assert terms(spark, "DEFAULT", "organization of Iechä's") == ["organize", "iechä'"]


def test_stop_words(spark):
    row = spark.createDataFrame([("Doc and API",)], "t string").select(analysis.standard(F.col("t"), stop_words=["doc"], stemming=False).alias("r")).first()
    assert row.r == ["and", "api"]


def test_code_path_keyword(spark):
    assert terms(spark, "code-friendly", "Call torch.nn.Module and get_queryset.") == ["call", "torch.nn.module", "get_queryset"]
    assert terms(spark, "path", "https://A.b/Guides/routing/") == ["https:", "a.b", "guides", "routing"]
    assert terms(spark, "path", "routing guides") == ["rout", "guid"]
    assert terms(spark, "keyword", "As Is") == ["As Is"]
    assert terms(spark, "keyword", "") == []


def test_unknown():
    with pytest.raises(ValueError):
        analysis.analyze("nope")


def test_stem_twin(spark):
    rng = random.Random(1)
    words = ["running", "s", "as", "ing", "xing", "organization", "relational", "ness", "goodness", "able", "table", "serializer"]
    words += ["".join(rng.choice("abet") for _ in range(rng.randrange(1, 5))) + rng.choice([s for s, _ in analysis.SUFFIX_RULES]) for _ in range(600)]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", analysis.stem(F.col("w")).alias("s")).collect()
    assert all(r.s == analysis.stem_word(r.w) for r in rows)


def test_standard_twin(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abc ing's-_.éß") for _ in range(40)) for _ in range(100)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", analysis.analyze()(F.col("t")).alias("r")).collect()
    assert all(r.r == analysis.standard_terms(r.t) for r in rows)


def test_synonyms(spark):
    table = synonyms.synonym_map()
    assert len(table) == 247
    assert table["auth"] == ["auth", "authentication", "authorization"]
    assert table["authorization"] == ["auth", "authorization"]
    row = spark.createDataFrame([(["auth", "x"],)], "t array<string>").select(synonyms.expand_terms(F.col("t")).alias("r")).first()
    assert row.r == ["auth", "x", "authentication", "authorization"]
