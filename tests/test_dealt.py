"""Candidates dealt by card: moved once, as order lines; hot cards apart."""

import pytest

from dossier.plans import candidates, card_queries

DIR = "/root/testdata/sf0.001"


def test_candidates_are_moved_once(spark):
    """One exchange of rows by card, none by card, tag, name, value and unit."""
    plan = card_queries.card_conflicts(spark, DIR)._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert len(moved) == 1 and "hashpartitioning(card#" in moved[0]


@pytest.mark.parametrize("hot", [20, 0])
def test_hot_cards_apart(spark, monkeypatch, hot):
    want = sorted(map(tuple, card_queries.export_parameters(spark, DIR).collect()), key=str)
    monkeypatch.setattr(candidates, "HOT", hot)
    assert sorted(map(tuple, card_queries.export_parameters(spark, DIR).collect()), key=str) == want and len(want) > 500
    mine, apart = candidates.dealt(spark, DIR)
    every = mine.unionByName(apart)
    plain = candidates.cards.card_key(candidates.candidates(spark, DIR))
    assert every.exceptAll(plain.select(*every.columns)).isEmpty() and every.count() == plain.count()
