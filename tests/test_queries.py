"""Every registered query against its SQL twin."""

import pytest
from compare import canonical, connect, same

from __spark_entry__ import entry, oracle_sql, queries
from fixtures import oracle
from fixtures import queries as registered
from listwarden.operators.rules import FLAGS


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.fixture(scope="module")
def scored_once(spark, sf_dir):
    """The scored table, written once for all reports over it."""
    path = f"{registered.fx.scratch(spark)}/scored"
    registered._scored(spark, sf_dir).write.parquet(path)
    return path


def test_every_listing_query_has_a_twin():
    assert set(registered.QUERIES) == set(registered.ORACLES)
    assert set(registered.QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() == 4


def test_fixture_has_every_flag_and_tier_and_many_resellers():
    """Reports over it can tell right from wrong: nothing is empty, no list is cut to what it has."""
    larger = connect("/root/testdata/sf0.01")
    flags = larger.execute(oracle.scored("SELECT flag, count(*) FROM fired GROUP BY 1")).fetchall()
    assert {flag for flag, _ in flags} == set(FLAGS)
    tiers = larger.execute(oracle.scored("SELECT risk_tier, count(*) FROM scored GROUP BY 1")).fetchall()
    assert len(tiers) == 4 and min(n for _, n in tiers) > 1000
    means = larger.execute(oracle.scored("SELECT avg(spam_score) FROM scored GROUP BY reseller_id")).fetchall()
    assert len(set(means)) > 20


#: These score the table themselves; the other reports share one scored table.
SCORING = {"score_table", "sink_flagged", "sink_flagged_csv"}


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, sf_dir, duck, scored_once, monkeypatch, name):
    if name not in SCORING:
        monkeypatch.setattr(registered, "_scored", lambda spark, _: spark.read.parquet(scored_once))
    got = queries()[name](spark, sf_dir).toPandas()
    expected = duck.execute(oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert same(canonical(got), canonical(expected))
