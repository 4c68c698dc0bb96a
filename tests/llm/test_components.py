import random

import numpy as np
import pytest

from chunkloom.llm.components import connected_components, local_forest


def plain(pairs):
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def shapes():
    r = random.Random(1)
    yield "none", []
    yield "loops", [(1, 1), (2, 2)]
    yield "star", [(0, i) for i in range(1, 400)]
    yield "reversed star", [(500, i) for i in range(400)]
    yield "chain", [(i, i + 1) for i in range(150)]
    ids = list(range(120))
    r.shuffle(ids)
    yield "shuffled chain", list(zip(ids, ids[1:]))
    yield "random", [(r.randrange(-300, 300), r.randrange(-300, 300)) for _ in range(260)] + [(5, 5), (7, 8), (7, 8), (8, 7)]


@pytest.mark.parametrize("name,pairs", list(shapes()))
def test_components(spark, name, pairs):
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "a long, b long").repartition(3)).collect()}
    assert got == {x: root for x, root in plain(pairs).items() if x != root}
    if pairs:
        nodes = sorted({x for p in pairs for x in p})
        at = {x: i for i, x in enumerate(nodes)}
        label = local_forest(np.array([at[a] for a, _ in pairs]), np.array([at[b] for _, b in pairs]), len(nodes))
        assert {x: nodes[label[at[x]]] for x in nodes} == plain(pairs)
