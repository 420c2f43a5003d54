import random

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_text_operators import brute_components, brute_hits, brute_spans, library  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    vocabulary = {"en": ["the", "cat", "house", "with", "and"], "fr": ["chat", "maison", "avec", "été", "et"]}
    word = lambda lang: rng.choice(vocabulary[lang]) + rng.choice(["", "a", "is", "on", "er"]) + rng.choice("abcdefgh")
    text = lambda lang, n: " ".join(word(lang) for _ in range(n))
    items = [(1, text("en", 25)), (2, text("fr", 12))]
    docs = [(text(lang, 60), lang) for lang in ("en", "fr") * 15]
    docs += [(docs[0][0], "en"), (docs[1][0] + " zz", "fr"), (text("en", 20) + " " + items[0][1] + " end", "en"), (text("fr", 9) + ' token = "0123456789abcdef01234567" ' + text("fr", 30), "fr"), ("12 34", None), (None, "en"), ("", "en")]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, (t, lang) in enumerate(docs)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, [t for t, _ in docs], items


def test_pipeline_against_brute_force(spark, folder):
    path, texts, items = folder
    kept = {i: t for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)}
    order = sorted(kept)
    classes = brute_components([kept[i] for i in order])
    kept = {i: kept[i] for k, i in enumerate(order) if classes[k][1] == k}
    kept = {i: t for i, t in kept.items() if not brute_hits(t, items)[1]}
    for i, t in kept.items():
        out, at = "", 0
        for span in filter(None, brute_spans(t).split(",")):
            _, a, b = span.split(":")
            if int(a) >= at:
                out += t[at : int(a)] + "[secret]"
            at = max(at, int(b))
        kept[i] = out + t[at:]
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, path).collect()}
    assert rows.keys() == kept.keys()
    for i, r in rows.items():
        want = [*library().encode(kept[i], add_special_tokens=False).ids, 2]
        assert np.frombuffer(r.ids, "<u4").tolist() == want
        assert r.n_tokens == len(want)
    assert len(rows) < len(texts) - 4


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder[0]).columns == corpus_pipeline.COLUMNS


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __key string, text_key string, component_id long, spans string"


def odd_rows(spark, folder):
    """Null and repeated ids, null texts, repeated rows, and columns with the operators' names."""
    _, texts, _ = folder
    rows = [(1, texts[0]), (2, texts[0]), (2, texts[2]), (2, texts[2]), (None, texts[4]), (None, texts[4] + " zz"), (None, texts[1]), (3, None), (None, None), (4, ""), (5, "12"), (6, texts[32]), (6, texts[6])]
    return spark.createDataFrame([(i, t, None if i == 6 else "en", None, None, "k", "t", 7, "s") for i, t in rows], SCHEMA).repartition(3), rows


def test_stages_on_odd_rows(spark, folder):
    docs, rows = odd_rows(spark, folder)
    items = folder[2]
    found = {name: sorted([(r.doc_id, r.text) for r in stage(spark, docs, folder[0]).select("doc_id", "text").collect()], key=str) for name, stage in corpus_pipeline.STAGES[:-1]}
    ordered = lambda some: sorted(some, key=str)
    assert found["language"] == ordered(r for r in rows if r[1] and any(c.isalpha() for c in r[1]))
    assert found["benchmark"] == ordered(r for r in rows if not brute_hits(r[1], items)[1])
    assert len(found["benchmark"]) == len(rows) - 1
    assert found["secrets"] == ordered(rows)
    # A copy goes, not the other text under its id; repeated rows of the document that stays all stay.
    texts = folder[1]
    near = found["near_duplicates"]
    assert [r for r in near if r[0] in (1, 2)] == ordered([(1, texts[0]), (2, texts[2]), (2, texts[2])])
    assert len([r for r in near if r[0] is None and (r[1] or "").startswith(texts[4])]) == 1
    assert (3, None) in near and (None, None) in near and (4, "") in near and (5, "12") in near and (6, texts[6]) in near
    encoded = corpus_pipeline.encode_tokens(spark, docs, folder[0]).collect()
    assert sorted(map(str, (r.doc_id for r in encoded))) == sorted(str(i) for i, _ in rows)
    assert sum(r.n_tokens == 1 for r in encoded) == 3


def test_empty_tables(spark, folder, tmp_path):
    docs, _ = odd_rows(spark, folder)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder[0]).count() == 0, name
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.drop_benchmark_passages(spark, docs, str(tmp_path)).count() == docs.count()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
