import random

import pytest
from pyspark.sql import functions as F

from wayline import session
from wayline.operators.bounded import text_bytes
from wayline.operators.prefix import prefix_scan


@pytest.fixture(scope="module")
def numbers(spark):
    rng = random.Random(3)
    # One weight holds most rows.
    data = [(i, 1 if rng.random() < 0.6 else rng.randrange(50), f"n{i:04d}") for i in range(2000)]
    rng.shuffle(data)
    return spark.createDataFrame(data, "id long, w long, name string").repartition(5).cache()


def test_prefix_scan(numbers):
    out = prefix_scan(numbers, [F.desc("w"), F.asc("name")], "pos", {"before": "w"})
    got = {r.id: (r.pos, r.before) for r in out.collect()}
    running = 0
    for pos, r in enumerate(sorted(numbers.collect(), key=lambda r: (-r.w, r.name))):
        assert got[r.id] == (pos, running)
        running += r.w
    assert out.columns == ["id", "w", "name", "pos", "before"]


def test_prefix_scan_of_nothing(numbers):
    assert prefix_scan(numbers.filter("id < 0"), [F.asc("id")], "pos").count() == 0


def test_sizes(spark, numbers):
    assert text_bytes(numbers.limit(0)) == 0
    assert text_bytes(numbers) > 2000 * 16


def test_scratch_folder_has_to_be_named(spark, monkeypatch):
    monkeypatch.setattr(session, "_named_scratch", lambda spark: None)
    with pytest.raises(ValueError):
        session.scratch_root(spark)
