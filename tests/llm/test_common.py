import random

import pytest

from tidelog.llm import common


@pytest.mark.parametrize("small", [0, 1 << 17])
def test_components(spark, monkeypatch, small):
    monkeypatch.setattr(common, "SMALL", small)
    r = random.Random(6)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(200)] + [(7, 7), (None, 3), (3, None)]
    f = common.Forest()
    for a, b in edges:
        if a is not None and b is not None and a != b:
            f.join(a, b)
    df = spark.createDataFrame(edges + edges[:20], "a long, b long").repartition(5)
    got = [tuple(x) for x in common.components(df).collect()]
    assert len(got) == len(set(got)) and dict(got) == {x: f.find(x) for x in f.up}
    assert common.components(df.limit(0)).count() == 0
