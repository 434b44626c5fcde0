"""Components of links: plain union-find on chains, stars and random links, and how many tables they take."""

import random

from tidewell.llm import components as c


def found(spark, links):
    rows = [(r.node, r.root) for r in c.components(spark.createDataFrame(links, "u long, v long").repartition(3)).collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


def plain(links):
    parent = {}

    def top(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for u, v in links:
        if u != v:
            a, b = sorted((top(u), top(v)))
            parent[b] = a
    return {i: top(i) for i in parent}


def test_components_equal_union_find(spark):
    r = random.Random(4)
    chain = [(i, i + 1) for i in range(60)]
    r.shuffle(chain)
    hub = [(500, i) for i in range(400, 700)] + [(700, 699), (701, 700)]
    loose = [(r.randrange(1000, 1300), r.randrange(1000, 1300)) for _ in range(200)]
    links = [*chain, *hub, *loose, *hub[:20], (5, 5), (2000, 2000)]
    assert found(spark, links) == plain(links)
    assert found(spark, [(1, 1)]) == {}


def test_links_that_are_stars_take_no_round(spark, monkeypatch):
    tables, right = [], c.stored
    monkeypatch.setattr(c, "stored", lambda df, what: tables.append(what) or right(df, what))
    stars = [(10 * s, 10 * s + i) for s in range(5) for i in range(1, 8)]
    assert found(spark, stars) == plain(stars) and len(tables) == 1
    # Two components found before and a link of their roots: one round joins them.
    assert found(spark, [*stars, (0, 10)]) == plain([*stars, (0, 10)]) and len(tables) == 3
