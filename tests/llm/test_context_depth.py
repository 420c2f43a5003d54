import random

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from test_text_operators import brute_ctw, frame  # noqa: E402

from tesseral.llm import ctw  # noqa: E402


@pytest.mark.parametrize(("depth", "local"), [(3, 1), (7, 3)])
def test_depth_and_split_are_parameters(spark, monkeypatch, depth, local):
    monkeypatch.setattr(ctw, "DEPTH", depth)  # read by the brute force only
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["the", "cat", "mät", "on", "x"]) for _ in range(rng.randrange(1, 12))) for _ in range(12)] + [None, "Unseen ÿ words"]
    docs = frame(spark, texts).withColumn("held", F.col("doc_id") % 4 == 1)
    train = [(t or "").encode() for i, t in enumerate(texts) if i % 4 != 1]
    for r in ctw.score(docs, "held", chunk_bytes=300, depth=depth, local=local).collect():
        assert r.score == pytest.approx(brute_ctw(train, (texts[r.doc_id] or "").encode()) / np.log(10), rel=1e-6)


def test_contexts_reach_beyond_four_bytes(spark):
    """What follows "efgh" is told only by the byte five places before."""
    rng = random.Random(4)
    some = lambda: " ".join(rng.choice(["aefgh1", "befgh2"]) for _ in range(200))
    docs = frame(spark, [some() for _ in range(8)]).withColumn("held", F.col("doc_id") == 0)
    held = {r.doc_id: r for r in ctw.score(docs, "held").collect()}[0]
    assert -held.score / np.log10(2) / 200 < 1.2  # one bit a word is left to chance


def test_depths_that_do_not_fit_are_refused(spark):
    docs = frame(spark, ["a"]).withColumn("held", F.lit(False))
    for depth, local in ((8, 2), (2, 2), (3, 0)):
        with pytest.raises(ValueError):
            ctw.score(docs, "held", depth=depth, local=local)
