"""Components of links against a plain union, by windows and by joins."""

import random

import pytest

from morphlake.llm import components


def plain(links):
    root = {}

    def up(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            low, high = sorted((up(a), up(b)))
            root[high] = low
    return {x: up(x) for x in root}


@pytest.mark.parametrize("few", [0, components.FEW])
def test_components_of_chains_hubs_and_random_links(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(100, 160)] + [(1_000, 1_000 + i) for i in range(1, 1_400)] + [(rng.randrange(5_000, 5_300), rng.randrange(5_000, 5_300)) for _ in range(200)]
    links += [(-5, 7), (7, -5), (9, 9), (None, 3), (1 << 60, -(1 << 60))]
    rng.shuffle(links)
    got = components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(got) == len({r.node for r in got}) and {r.node: r.root for r in got} == plain(links)
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_round_of_few_links_has_a_short_plan(spark, monkeypatch):
    """The driver keeps every round's plan for a while; those with broadcasts of hubs took too much of it."""
    plans, cut = [], components.cut
    monkeypatch.setattr(components, "cut", lambda f: (plans.append(f._jdf.queryExecution().sparkPlan().toString()), cut(f))[1])
    components.connected_components(spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "a long, b long"))
    assert len(plans) > 1 and not any("Join" in p for p in plans[1:])
