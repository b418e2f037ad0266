"""Components of chains, stars and cycles."""

from tessera.llm import components
from tessera.llm.components import connected_components


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    kept = components.written
    monkeypatch.setattr(components, "written", lambda df, name: rounds.append(name) or kept(df, name))
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + k) for k in range(1, 20)] + [(2000, 2001), (2001, 2002), (2002, 2000), (5, 5)]
    found = dict(connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    assert {found[i] for i in range(301)} == {0} and found[1019] == 1000 and found[2002] == 2000
    assert rounds.count("least") < 14


def test_no_links(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
