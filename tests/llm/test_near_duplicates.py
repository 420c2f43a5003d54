import random
from itertools import combinations

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tesseral.llm import jaccard  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, size):
    words = (text or "").lower().split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute_links(texts, size, percent):
    sets = [shingles(t, size) for t in texts]
    return [(i, j) for i, j in combinations(range(len(texts)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]


def kept(texts, size, percent):
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in brute_links(texts, size, percent):
        x, y = sorted((find(i), find(j)))
        parent[y] = x
    return {i for i in range(len(texts)) if find(i) == i}


def near_texts():
    """Groups of copies with one to three words changed, so that links lie on both sides of the bounds."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = []
    for length in (40, 60, 100, 160, 220):
        base = [word() for _ in range(length)]
        for changes in (0, 0, 1, 2, 2, 4):
            copy = list(base)
            for at in rng.sample(range(length), changes):
                copy[at] = word()
            texts.append(" ".join(copy))
    return texts


def stage(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(3)
    return sorted([(r.doc_id, r.text) for r in corpus_pipeline.keep_one_of_each_group(spark, docs, "").collect()], key=str)


def test_stage_joins_at_five_words_and_four_fifths(spark):
    texts = near_texts()
    assert kept(texts, 5, 80) != kept(texts, 4, 85)
    assert {i for i, _ in stage(spark, enumerate(texts))} == kept(texts, 5, 80)


def test_links_inside_components_are_counted(spark):
    texts = near_texts() + ["x y", "x y", "X  y", "", None]
    texts += [f"{texts[0]} w{i}" for i in range(40)]  # a region that is solved in blocks
    want = [0] * len(texts)
    for i, j in brute_links(texts, 4, 85):
        want[i] += 1
        want[j] += 1
    docs = spark.createDataFrame([*enumerate(texts), (0, texts[0])], "doc_id long, text string").repartition(3)
    rows = jaccard.link_counts(docs).collect()
    assert sorted((r.doc_id, r.n_links) for r in rows) == sorted([*enumerate(want), (0, want[0])])


def test_stage_keeps_rows_by_id_and_text(spark):
    near, other = "a b c d e f g h", "one two three four five six"
    rows = [(1, near), (2, near), (2, other), (3, None), (None, "p q r s t u"), (None, "P  q r s t u"), (None, near), (4, "v w x y z"), (4, "V w x y z")]
    found = stage(spark, rows)
    assert [r for r in found if r[0] is not None and r[0] < 4] == [(1, near), (2, other), (3, None)]
    assert len([r for r in found if r[0] is None]) == 1  # one of two copies without ids
    assert len([r for r in found if r[0] == 4]) == 1


@pytest.mark.parametrize("block", [1024, 8])
def test_large_regions_of_unlinked_members(spark, monkeypatch, block):
    """Families around one long shared passage: neither linked across families nor all linked within."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = []
    for _ in range(4):
        base = [word() for _ in range(90)]
        for _ in range(14):
            copy = list(base)
            for at in rng.sample(range(90), rng.choice([2, 3, 4, 5])):
                copy[at] = word()
            texts.append(" ".join([*copy, *["same end of all"] * 1]))
    monkeypatch.setattr(jaccard, "LARGE", 4)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(3)
    found = {r.doc_id: r.component_id for r in jaccard.classes(docs).collect()}
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in brute_links(texts, 4, 85):
        x, y = sorted((find(i), find(j)))
        parent[y] = x
    assert found == {i: find(i) for i in range(len(texts))}
