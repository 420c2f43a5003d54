import pytest

pytest.importorskip("public_tokenizers")

from tesseral.llm import knn  # noqa: E402


def test_rows_of_the_query_itself_give_no_bound(spark):
    rows = [(0, [4.0, 0.0])] * 10 + [(i, [0.0, 1.0 + i / 32]) for i in range(1, 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = sorted((r.rank, r.vec_id, r.score) for r in knn.top(df, lambda c: c == 0, k=5).collect())
    # The query's ten rows are equal and count once; all scores are 0, so the smallest id comes first.
    assert found == [(i, i, 0) for i in range(1, 6)]
