"""Driver contract: entry, queries and oracle keys."""

import __spark_entry__ as entry
from gamelog.plans import registry


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns[:4] == ["game_pk", "home_team", "away_team", "status"]
    assert df.count() > 0


def test_every_query_has_an_oracle():
    own = set(registry.QUERIES)
    assert own == set(registry.ORACLE) and len(own) >= 40
    assert own <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
