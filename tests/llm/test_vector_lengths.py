"""Vectors of another length than the commonest take no part."""

from pulseframe.llm import vector_search


def test_empty_and_short_vectors_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, []), (4, [9.0]), (5, [9.0, 9.0, 9.0])]
    v = vector_search.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 1)
    assert [tuple(r) for r in vector_search.top_k(v.where("id = 0"), v, 5).orderBy("rank").collect()] == [(0, 1, 1, 2), (0, 2, 2, 0)]
