"""Scores without the input columns that a report does not show, and flags of listings that refer to texts."""

import random

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from fixtures import queries as registered
from listwarden import Options, Texts, flag_table, score_listings

WORDS = ("reno", "Reno", "building", "mention", "mother", "x", "é", "tion,", "small;", "ring|")
HEADERS = ("business_name", "address", "city", "email", "owner_name", "industry", "keywords", "description")


def _tables(spark, size, column):
    """Listings with references in one column, the texts, and the listings with the texts themselves."""
    r = random.Random(size)
    texts = [(at, " ".join(r.choices(WORDS, k=at % 40))) for at in range(60)] + [(60, None), (61, "")]
    pick = {
        "business_name": ["Small Shop LLC", "small shop", "Big Ring", "", None], "address": ["1 Elm St", "PO Box 7", ""],
        "city": ["Reno", "", None], "email": ["a@b.com", "", None], "owner_name": ["Ann", "", None],
        "industry": ["building", "", None], "keywords": ["a,b,c,d", ""], "description": ["Reno " * 9, None]}
    rows = [(at, *[r.choice([*range(63), None]) if name == column else r.choice(pick[name]) for name in HEADERS])
            for at in range(size)]
    rows += [(size + row[0], *row[1:]) for row in rows[:size // 3]]
    schema = ", ".join(["row_id long", *[f"{name} {'long' if name == column else 'string'}" for name in HEADERS]])
    listings = spark.createDataFrame(rows, schema)
    table = spark.createDataFrame(texts, "key long, text string")
    value = F.when(F.col(column).isNull(), "").otherwise(F.col("text")).alias(column)
    inline = listings.join(table, F.col(column) == F.col("key"), "left").select(
        *[value if name == column else F.col(name) for name in listings.columns])
    return listings, Texts(table, column), inline


@pytest.mark.parametrize(("column", "compared", "shown"), [
    ("description", HEADERS, ("city",)),
    ("owner_name", ("address", "owner_name"), ("owner_name", "row_id")),
])
def test_scores_and_flags_are_those_of_the_texts(spark, column, compared, shown):
    """Whichever column refers to texts, and whether it is shown and compared or not."""
    listings, texts, inline = _tables(spark, 150, column)
    options = Options(compare_cols=compared, join_parts=3)
    full = score_listings(inline, registered.CFG, id_col="row_id", options=options)
    got = score_listings(listings, registered.CFG, id_col="row_id", options=options, texts=texts, shown=shown)
    names = [*shown, *full.columns[len(inline.columns):]]
    assert got.columns == names
    assert sorted(map(repr, got.collect())) == sorted(map(repr, full.select(*names).collect()))
    flags, expected = (
        flag_table(table, registered.CFG, id_col="row_id", options=options, texts=referred).collect()
        for table, referred in ((listings, texts), (inline, None)))
    assert sorted(flags) == sorted(expected)
    assert {"EXACT_DUPLICATE", "NEAR_DUPLICATE_NAME"} <= {row.flag for row in flags}


def test_several_texts_of_one_key_raise(spark):
    listings, texts, _ = _tables(spark, 150, "description")
    twice = Texts(texts.table.union(texts.table.filter("key = 7")), "description")
    for run in (lambda: flag_table(listings, registered.CFG, id_col="row_id", texts=twice, flags=["NO_PHOTOS"]),
                lambda: score_listings(listings, registered.CFG, id_col="row_id", texts=twice, shown=())):
        with pytest.raises(ValueError, match="several texts"):
            run()


def _exchanges(plan):
    if plan.nodeName() == "AdaptiveSparkPlan":
        plan = plan.initialPlan()
    if plan.nodeName() == "Exchange":
        yield plan.outputPartitioning().toString(), plan.output().size()
    children = plan.children()
    for at in range(children.size()):
        yield from _exchanges(children.apply(at))


@pytest.mark.parametrize(("name", "shown"), [("top_flags", 0), ("reseller_top", 1), ("residential_review", 4)])
def test_reports_carry_no_listings(spark, sf_dir, name, shown):
    """What meets the evidence by row id: the id, the rules that fired, what the report shows, and
    the industry, which a rule over owners asks for."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan()
        moved = [size for how, size in _exchanges(plan) if how.startswith("hashpartitioning(row_id")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    evidence = 10  # the id, eight groups and the name
    assert len(moved) == 2 and sum(moved) <= evidence + 3 + shown
