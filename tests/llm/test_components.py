"""Connected components: their classes, and how few written tables they take."""

import random

from riselens.llm import components


def _classes(spark, pairs):
    return {r.id: r.component for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}


def test_chains_stars_and_trees(spark):
    rng, pairs, want = random.Random(3), [], {}
    for base, size in ((0, 40), (1000, 25), (2000, 2)):
        ids = [base + i for i in range(size)]
        want |= dict.fromkeys(ids, base)
        order = rng.sample(ids, size)
        pairs += list(zip(order, order[1:]))
    hub = list(range(3000, 3030))
    pairs += [(3029, i) for i in hub[:-1]]
    tree = rng.sample(range(4000, 4060), 60)
    pairs += [(tree[i], tree[rng.randrange(i)]) for i in range(1, 60)]
    want |= dict.fromkeys(hub, 3000) | dict.fromkeys(range(4000, 4060), 4000)
    assert _classes(spark, pairs) == want


def test_a_forest_is_finished_by_pointers(spark, monkeypatch):
    """Star rounds end as soon as every node has one smaller neighbour; what is left takes one join a step."""
    jumps = []
    monkeypatch.setattr(components, "_jump", lambda e, run=components._jump: jumps.append(e.groupBy("u").count().where("count > 1").count()) or run(e))
    # a long chain in order: after the first rounds a forest deeper than one
    ids = list(range(64))
    random.Random(5).shuffle(ids)
    assert _classes(spark, list(zip(ids, ids[1:]))) == dict.fromkeys(range(64), 0)
    assert _classes(spark, [(i + 1, i) for i in range(64)]) == dict.fromkeys(range(65), 0)
    assert jumps and not any(jumps)


def test_pointers_reach_their_roots(spark):
    e = spark.createDataFrame([(i + 1, i) for i in range(20)] + [(101, 100), (103, 100)], "u long, v long")
    assert {r.u: r.v for r in components._jump(e).collect()} == {i: 0 for i in range(1, 21)} | {101: 100, 103: 100}
