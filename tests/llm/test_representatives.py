"""One row of each component, whatever the ids say."""

from collections import Counter

import pytest

from manifolder.llm import simhash

TEXTS = {name: " ".join(f"{name}{k}" for k in range(40)) for name in ("red", "green", "blue", "grey", "pink", "teal", "plum")}


@pytest.mark.parametrize("parts", [1, 5])
def test_ids_missing_and_repeated(spark, parts):
    rows = [
        (None, TEXTS["red"], "a"),
        (None, TEXTS["green"], "a"),
        (None, TEXTS["blue"], "a"),
        (3, TEXTS["blue"], "b"),
        (7, TEXTS["grey"], "a"),
        (7, TEXTS["pink"], "a"),
        (7, TEXTS["teal"], "b"),
        (5, TEXTS["teal"], "a"),
        (8, TEXTS["plum"], "a"),
        (8, TEXTS["plum"], "a"),
        (None, None, None),
        (None, "", "a"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)
    kept = Counter(tuple(r) for r in simhash.keep_representatives(spark, docs).collect())
    assert kept == Counter([(None, TEXTS["red"], "a"), (None, TEXTS["green"], "a"), (3, TEXTS["blue"], "b"), (7, TEXTS["grey"], "a"), (7, TEXTS["pink"], "a"), (5, TEXTS["teal"], "a"), (8, TEXTS["plum"], "a"), (None, None, None)])
