"""Near-duplicate vectors of any number type and magnitude."""

import math
import random

import pytest

from tidemark.llm import embeddings


@pytest.mark.parametrize(("kind", "scale"), [("double", 1.0), ("double", 1e250), ("double", 1e-250), ("float", 1.0), ("float", 1e30)])
def test_groups_of_doubles_and_floats_of_any_size(spark, kind, scale):
    rng = random.Random(5)
    base = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(40)]
    rows = [(i, [v * scale for v in base[i % 40]], i % 2) for i in range(60)]
    rows += [(100 + i, [(v + rng.gauss(0, 0.05)) * scale * 3 for v in base[i]], i % 2) for i in range(20)]
    df = spark.createDataFrame([(i, e, y, "clash") for i, e, y in rows], f"vec_id long, embedding array<{kind}>, label int, n_links string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.embedding_groups(df).collect()}

    def cos(a, b):
        a, b = [v / scale for v in a], [v / scale for v in b]
        return sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))

    near = {i: {j for j, f, z in rows if j != i and z == y and cos(e, f) >= 0.93} for i, e, y in rows}
    assert {i: n for i, (n, _) in got.items()} == {i: len(js) for i, js in near.items()}
    for i in near:
        reached, todo = {i}, [i]
        while todo:
            todo = [j for k in todo for j in near[k] - reached]
            reached |= set(todo)
        assert got[i][1] == min(reached)
