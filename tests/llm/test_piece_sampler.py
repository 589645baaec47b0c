import itertools
import math
from collections import Counter

import numpy as np
import pytest

from quillspark.llm import piece_sampler as ps

TEXT = "Thhaen é漢"


@pytest.fixture(scope="module")
def vocabulary():
    return ps.load_vocabulary(ps.default_model())


def segmentations(text, v):
    """All of a small text, by plain recursion over its pieces: ids -> probability."""
    pieces = {}
    for i, raw in enumerate(v.raw):
        if raw and i >= 259:
            pieces[raw.decode()] = i
    marked = " " + text
    weights = {}

    def go(at, ids, lp):
        if at == len(marked):
            weights[tuple(ids)] = lp
            return
        for n in range(1, len(marked) - at + 1):
            p = marked[at : at + n]
            if p in pieces:
                go(at + n, ids + [pieces[p]], lp - ps.ALPHA * math.log(max(pieces[p] - 257, 2)))
            elif n == 1:
                b = p.encode()
                go(at + 1, ids + [3 + x for x in b], lp - ps.ALPHA * math.log(len(v.raw) - 258) * len(b))

    go(0, [], 0.0)
    z = math.log(sum(math.exp(x) for x in weights.values()))
    return {k: math.exp(x - z) for k, x in weights.items()}


def test_probabilities_and_draws(vocabulary):
    exact = segmentations(TEXT, vocabulary)
    n = 6000
    rows = ps.sample_texts(list(range(n)), [TEXT] * n, vocabulary, 3)
    assert len(rows) == 3 * n
    by = {}
    for d, rank, ids, lp, g, q in rows:
        assert math.exp(lp) == pytest.approx(exact[tuple(ids.tolist())], rel=1e-9)
        by.setdefault(d, []).append((tuple(ids.tolist()), g, q))
    assert all(len({s for s, _, _ in g}) == 3 and g[0][1] >= g[1][1] >= g[2][1] for g in by.values())
    first = Counter(g[0][0] for g in by.values())
    second = Counter(g[1][0] for g in by.values())
    for s, p in sorted(exact.items(), key=lambda x: -x[1])[:5]:
        assert first[s] / n == pytest.approx(p, abs=4 * math.sqrt(p / n) + 1e-3)
        want = sum(q * p / (1 - q) for t, q in exact.items() if t != s)
        assert second[s] / n == pytest.approx(want, abs=4 * math.sqrt(want / n) + 1e-3)
    # Horvitz-Thompson: inclusion scores make sums over samples unbiased.
    assert np.mean([sum(exact[s] / q for s, _, q in g) for g in by.values()]) == pytest.approx(1, abs=0.02)


def test_all_of_a_small_text(vocabulary):
    exact = segmentations("ab", vocabulary)
    rows = ps.sample_texts([5], ["ab"], vocabulary, 50)
    assert {tuple(r[2].tolist()) for r in rows} == set(exact)
    assert all(r[5] == 1.0 for r in rows)


def test_third_draw_of_nested_forks(vocabulary):
    exact = segmentations("ab", vocabulary)
    n = 4000
    rows = ps.sample_texts(list(range(n)), ["ab"] * n, vocabulary, 3)
    third = Counter(tuple(r[2].tolist()) for r in rows if r[1] == 3)
    for s, p in exact.items():
        want = sum(a * b / (1 - a) * p / (1 - a - b) for (t, a), (u, b) in itertools.permutations(exact.items(), 2) if s not in (t, u))
        assert third[s] / n == pytest.approx(want, abs=4 * math.sqrt(want / n) + 2e-3)


def test_decoding_gives_the_text_back(vocabulary):
    texts = ["", None, " ", "  two  spaces ", "line\nline\r\n\ttab", "😀 漢字 é \u0000 ​", "x" * 3000, "▁ mark", "1234 <s> </s> <unk> <0x41>", " " * 70, "a\n" * 50]
    rows = ps.sample_texts(list(range(len(texts))), texts, vocabulary, 2)
    for d, _, ids, *_ in rows:
        assert ps.decode(ids.tolist(), vocabulary) == (texts[d] or "").replace("▁", " ")
    assert {d for d, *_ in rows} == set(range(len(texts)))


def test_decoding_is_the_librarys(vocabulary):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=ps.default_model())
    rows = ps.sample_texts([1, 2], ["Hello  world\nthe é 漢 😀 x", "plain text again"], vocabulary, 3)
    for _, _, ids, *_ in rows:
        assert model.decode(ids.tolist()) == ps.decode(ids.tolist(), vocabulary)


def test_samples_depend_on_the_row_alone(vocabulary):
    texts = ["one row", TEXT, "another row of words\nand lines"]
    together = ps.sample_texts([1, 2, 3], texts, vocabulary, 3)
    for i, t in enumerate(texts):
        alone = ps.sample_texts([i + 1], [t], vocabulary, 3)
        for a, b in zip(alone, [r for r in together if r[0] == i], strict=True):
            assert a[2].tolist() == b[2].tolist() and a[3:] == pytest.approx(b[3:])


def test_operator(spark):
    docs = spark.createDataFrame([(1, "some words", 5, "x"), (2, None, 5, "x"), (None, "some words", 5, "x"), (1, "some words", 5, "x")], "doc_id bigint, text string, ids int, sample string")
    rows = ps.encode_samples(docs, k=2).collect()
    assert all(r.decoded for r in rows)
    assert sorted((str(r.doc_id), r["sample"]) for r in rows) == [("1", 1), ("1", 1), ("1", 2), ("1", 2), ("2", 1), ("None", 1), ("None", 2)]
    empty = next(r for r in rows if r.doc_id == 2)
    assert empty.n_pieces == 0 and empty.inclusion == 1.0 and empty.log_prob == 0.0
    back = ps.decode_ids(ps.encode_samples(docs, k=2)).select("doc_id", "text").distinct().collect()
    assert {(r.doc_id, r.text) for r in back} == {(1, "some words"), (2, ""), (None, "some words")}
    assert ps.encode_samples(docs.limit(0)).count() == 0


def test_long_texts_are_drawn_in_parts(vocabulary, monkeypatch):
    text = " ".join(f"word{i * 7919 % 1000} {'né漢'[i % 3]}{i}" for i in range(3000))
    whole = ps.sample_texts([1, 2], [text, "short"], vocabulary, 3)
    monkeypatch.setattr(ps, "BATCH", 2000)
    parts = sorted(ps.sample_texts([1, 2], [text, "short"], vocabulary, 3), key=lambda r: r[:2])
    for a, b in zip(sorted(whole, key=lambda r: r[:2]), parts, strict=True):
        assert a[2].tolist() == b[2].tolist() and a[3:] == pytest.approx(b[3:])


def test_a_likely_head_grows(vocabulary, monkeypatch):
    text = "1 " * 2000 + "the end of it"
    whole = ps.sample_texts([1], [text], vocabulary, 3)
    monkeypatch.setattr(ps, "BATCH", 500)
    assert [r[2].tolist() for r in ps.sample_texts([1], [text], vocabulary, 3)] == [r[2].tolist() for r in whole]


def test_five_million_characters_without_a_space(vocabulary):
    letters = np.random.default_rng(3).integers(97, 123, 5_000_000).astype(np.uint8).tobytes().decode()
    rows = ps.sample_texts([1], [letters], vocabulary, 2)
    assert len(rows) == 2 and rows[0][2].tolist() != rows[1][2].tolist()
    assert all(ps.decode(r[2].tolist(), vocabulary) == letters for r in rows)


def test_long_blocks_are_cut_where_no_piece_is(vocabulary):
    block = "▁" + "x" * 9000
    assert [len(b) for b in ps._parts(block, vocabulary.pairs)] == [4096, 4096, 809]
    block = "▁" + "ab\u0001" * 3000
    parts = list(ps._parts(block, vocabulary.pairs))
    assert "".join(parts) == block and all(a[-1] + b[0] not in vocabulary.pairs for a, b in zip(parts, parts[1:]))
