"""Listings that refer to texts in a table of their own."""

import random

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from fixtures import queries as registered
from listwarden import Texts, score_listings

CITIES = ("Reno", "", "Omaha")


def _listings(spark, size):
    r = random.Random(size)
    texts = [(at, " ".join(r.choices(["reno", "Reno", "building", "mention", "mother", "x", "é"], k=at)))
             for at in range(60)] + [(60, None), (61, ""), (None, "of no key")]
    rows = [(at, f"Shop {r.randrange(9)}", r.choice(CITIES), "a@b.com", r.choice([*range(62), None]))
            for at in range(size)]
    texts = spark.createDataFrame(texts, "key long, text string")
    schema = "row_id long, business_name string, city string, email string, description long"
    listings = spark.createDataFrame(rows, schema)
    inline = listings.join(texts, F.col("description") == F.col("key"), "left").select(
        "row_id", "business_name", "city", "email",
        F.when(F.col("description").isNull(), "").otherwise(F.col("text")).alias("description"))
    return listings, texts, inline


def test_references_score_like_the_texts_themselves(spark):
    listings, texts, inline = _listings(spark, 300)
    got, expected = (
        score_listings(table, registered.CFG, id_col="row_id", texts=referred)
        for table, referred in ((listings, Texts(texts, "description")), (inline, None)))
    assert got.dtypes == expected.dtypes
    rows = sorted(expected.collect(), key=repr)
    assert sorted(got.collect(), key=repr) == rows
    assert sum("DESCRIPTION_KEYWORD_STUFFED" in row.flags_triggered for row in rows) > 20
    assert sum("EXACT_DUPLICATE" in row.flags_triggered for row in rows) == 0  # row ids differ
    twice = texts.union(texts.filter("key = 7"))
    with pytest.raises(ValueError, match="several texts"):
        score_listings(listings, registered.CFG, id_col="row_id", texts=Texts(twice, "description"))


def _exchanges(plan):
    """Columns of each exchange of a plan."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        plan = plan.initialPlan()
    if plan.nodeName() == "Exchange":
        output = plan.output()
        yield {output.apply(at).name(): output.apply(at).dataType().simpleString()
               for at in range(output.size())}
    children = plan.children()
    for at in range(children.size()):
        yield from _exchanges(children.apply(at))


@pytest.mark.parametrize("name", ["score_table", "results_first"])
def test_texts_are_not_shuffled_with_their_listings(spark, sf_dir, name):
    """However large the documents are: here none of the tables is broadcast."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scored = queries()[name](spark, sf_dir)
        place = registered.fx.listings(spark, sf_dir).columns.index("description")
        moved = list(_exchanges(scored._jdf.queryExecution().executedPlan()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert dict(scored.dtypes)["description"] == "string"
    wide = [columns for columns in moved if len(columns) > 5]
    assert wide and all(columns[f"in_{place}"] == "bigint" for columns in wide if f"in_{place}" in columns)
    assert all("text_value" not in columns and "any_description" not in columns for columns in wide)
    assert any(f"in_{place}" in columns for columns in wide)
