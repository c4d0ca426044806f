"""Ids that head one class and lie in another."""

import random

import pytest
from sparrowgrid.llm import nearcopies, simhash


@pytest.mark.parametrize("keep_first", [simhash.keep_first, nearcopies.keep_first])
def test_a_repeated_id_keeps_only_the_class_it_heads(spark, keep_first):
    rng = random.Random(8)
    one, two = (" ".join(f"w{rng.randrange(9999)}" for _ in range(60)) for _ in range(2))
    docs = spark.createDataFrame([(7, one), (7, two), (3, two)], "doc_id long, text string")
    assert sorted(map(tuple, keep_first(docs).collect())) == [(3, two), (7, one)]
