"""Components when links come in several rounds."""

import random

from quaero.llm import shared


def test_contraction_equals_components_of_all_links_and_moves_few(spark, monkeypatch):
    rng = random.Random(4)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(150)]
    more = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(40)] + [(links[0])] * 500
    first, second = (spark.createDataFrame(x, "a long, b long") for x in (links, more))
    scratch = shared.Scratch(spark)
    now = shared.connected_components(first, scratch)
    whole = shared.connected_components(first.unionByName(second))
    sizes, plain = [], shared.connected_components
    monkeypatch.setattr(shared, "connected_components", lambda edges, *a: sizes.append(edges.count()) or plain(edges, *a))
    got = shared.contracted(now, second, scratch)
    assert sizes and sizes[0] <= 40  # not the first links, nor repeated ones
    label = lambda df: {r["id"]: r["component"] for r in df.collect()}
    inside = {i for i, c in label(whole).items() if any(c == d and i != j for j, d in label(whole).items())}
    assert {k: v for k, v in label(got).items() if k in inside} == {k: v for k, v in label(whole).items() if k in inside}
    assert shared.contracted(got, second, scratch) is got
