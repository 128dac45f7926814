import data
import pytest

from listwarden import Options, default_config, flag_table, score_listings, template_config

OPTIONS = Options(compare_cols=tuple(data.HEADERS))
SCORES = [36, 36, 25, 28, 22, 9, 19, 10, 20, 11]
HIGH, LIKELY, REVIEW, CLEAN = "High Confidence Spam", "Likely Spam", "Review", "Clean"
DEFAULT_TIERS = [HIGH] * 5 + [LIKELY, HIGH, LIKELY, HIGH, LIKELY]
TEMPLATE_TIERS = [HIGH, HIGH, HIGH, HIGH, LIKELY, CLEAN, LIKELY, REVIEW, LIKELY, LIKELY]
FLAGS = [
    "HIGH_RISK_INDUSTRY, GENERIC_NAME_KEYWORD, TOLLFREE_PHONE, SHARED_PHONE, "
    "GENERIC_BUILDER_SITE, SHARED_DOMAIN, DOMAIN_NAME_MISMATCH, FREE_EMAIL_PROVIDER, "
    "SHARED_EMAIL, EXACT_DUPLICATE, NEAR_DUPLICATE_NAME, SAME_OWNER_MULTI_BIZ, BATCH_SUBMISSION",
    "HIGH_RISK_INDUSTRY, GENERIC_NAME_KEYWORD, TOLLFREE_PHONE, SHARED_PHONE, "
    "GENERIC_BUILDER_SITE, SHARED_DOMAIN, DOMAIN_NAME_MISMATCH, FREE_EMAIL_PROVIDER, "
    "SHARED_EMAIL, EXACT_DUPLICATE, NEAR_DUPLICATE_NAME, SAME_OWNER_MULTI_BIZ, BATCH_SUBMISSION",
    "HIGH_RISK_INDUSTRY, GENERIC_NAME_KEYWORD, SHARED_ADDRESS, SHARED_PHONE, SHARED_DOMAIN, "
    "FREE_EMAIL_PROVIDER, SHARED_EMAIL, SAME_OWNER_MULTI_BIZ, BATCH_SUBMISSION",
    "HIGH_RISK_INDUSTRY, GENERIC_NAME_KEYWORD, KEYWORD_STUFFED_NAME, SHARED_ADDRESS, "
    "SHARED_PHONE, NO_WEBSITE, FREE_EMAIL_PROVIDER, SHARED_EMAIL, SAME_OWNER_MULTI_BIZ, "
    "BATCH_SUBMISSION",
    "HIGH_RISK_INDUSTRY, GENERIC_NAME_KEYWORD, SHARED_ADDRESS, SHARED_PHONE, SHARED_DOMAIN, "
    "DOMAIN_NAME_MISMATCH, FREE_EMAIL_PROVIDER, AUTOGENERATED_EMAIL, BATCH_SUBMISSION",
    "HIGH_RISK_INDUSTRY, PO_BOX, BATCH_SUBMISSION",
    "HIGH_RISK_INDUSTRY, GENERIC_NAME_KEYWORD, VIRTUAL_MAILBOX, STATE_ZIP_MISMATCH, "
    "NO_WEBSITE, FREE_EMAIL_PROVIDER, BATCH_SUBMISSION",
    "SHARED_PHONE, SHARED_DOMAIN, SAME_OWNER_MULTI_BIZ",
    "HIGH_RISK_INDUSTRY, GENERIC_NAME_KEYWORD, SHARED_PHONE, SHARED_DOMAIN, "
    "DOMAIN_NAME_MISMATCH, SAME_OWNER_MULTI_BIZ, BATCH_SUBMISSION",
    "HIGH_RISK_INDUSTRY, GENERIC_NAME_KEYWORD, STATE_ZIP_MISMATCH, BATCH_SUBMISSION",
]


@pytest.mark.parametrize("cfg, tiers", [(default_config(), DEFAULT_TIERS),
                                        (template_config(), TEMPLATE_TIERS)])
def test_golden(spark, cfg, tiers):
    scored = score_listings(
        data.listings(spark), cfg, data.references(spark), "row_id", OPTIONS
    ).orderBy("row_id").collect()
    assert [row.spam_score for row in scored] == SCORES
    assert [row.risk_tier for row in scored] == tiers
    assert [row.flags_triggered for row in scored] == FLAGS
    assert [row.is_duplicate_of_row for row in scored] == ["", "0"] + [""] * 8


def test_shuffled_salted_input_gives_the_same_flags_and_scores_add_up(spark):
    cfg, references = default_config(), data.references(spark)
    plain = flag_table(data.listings(spark), cfg, references, "row_id", OPTIONS).collect()
    salted = Options(compare_cols=OPTIONS.compare_cols, salt_rows=1)
    mixed = data.listings(spark).repartition(5, "city")
    other = flag_table(mixed, cfg, references, "row_id", salted).collect()
    assert sorted(plain) == sorted(other)
    totals = {}
    for row in plain:
        totals[row.row_id] = totals.get(row.row_id, 0) + row.weight
    assert [totals.get(at, 0) for at in range(10)] == SCORES


def test_disabling_a_rule_removes_exactly_its_flags(spark):
    cfg, references = default_config(), data.references(spark)
    off = cfg.replace(disabled_rules=["shared_phone", "near_duplicate_name"])
    both = [
        set(flag_table(data.listings(spark), c, references, "row_id", OPTIONS).collect())
        for c in (cfg, off)
    ]
    assert {row.flag for row in both[0] - both[1]} == {"SHARED_PHONE", "NEAR_DUPLICATE_NAME"}
    assert not both[1] - both[0]


def test_generated_ids_and_headers(spark):
    """Without an id column; headers that only differ in case, or hold dots."""
    headers = ["Company Name", "Local Phone > Phone Number", "ph.oto", "CITY", "city "]
    rows = [["Acme", "5551234", "x", "wrong", "Rome"], ["Acme", "5551234", "x", "wrong", "Rome"],
            ["Beta", "", "y", "wrong", "Oslo"]]
    df = spark.createDataFrame(rows, ", ".join(f"`{h}` string" for h in headers)).coalesce(1)
    scored = score_listings(df, default_config()).orderBy("row_id").collect()
    assert scored[0].asDict().keys() >= set(headers)
    assert [row.row_id for row in scored] == [0, 1, 2]
    assert [row.is_duplicate_of_row for row in scored] == ["", "0", ""]
    assert "SHARED_PHONE" in scored[0].flags_triggered
    assert scored[2].flags_triggered == ""


def test_output_columns_in_the_input_are_refused(spark):
    df = data.listings(spark).selectExpr("*", "1 AS Spam_Score")
    with pytest.raises(ValueError, match="spam_score"):
        score_listings(df, default_config(), id_col="row_id")


def test_no_python_and_no_cartesian_product_in_the_plan(spark):
    rdi = spark.createDataFrame([("9 Mill Ln", "Residential")], "address string, rdi string")
    scored = score_listings(
        data.listings(spark), default_config(), data.references(spark, rdi=rdi), "row_id", OPTIONS
    )
    plan = scored._jdf.queryExecution().executedPlan().toString()
    for operator in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin", "Window"):
        assert operator not in plan
    flags = {row.row_id for row in scored.collect() if "RESIDENTIAL" in row.flags_triggered}
    assert flags == {8}


def test_listings_are_read_once(spark, tmp_path):
    """The returned plan reads the listings once; their keys come from the table written before."""
    data.listings(spark).write.parquet(f"{tmp_path}/listings")
    table = spark.read.parquet(f"{tmp_path}/listings")
    for id_col in ("row_id", None):
        source = table if id_col else table.drop("row_id")
        scored = score_listings(source, default_config(), data.references(spark), id_col, OPTIONS)
        flags = flag_table(source, default_config(), data.references(spark), id_col, OPTIONS)
        # rules that need groups and those that do not are two plans in one
        for plan, most in ((scored, 1), (flags, 2)):
            files = [name for name in _scans(plan) if "/listings" in name]
            assert 1 <= len(files) <= most, files
        assert scored.count() == len(data.ROWS)


def _scans(df):
    """The files that each scan of a plan reads."""
    nodes, found = [df._jdf.queryExecution().optimizedPlan()], []
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "LogicalRelation":
            found.append(node.relation().location().rootPaths().mkString())
        children = node.children()
        nodes += [children.apply(at) for at in range(children.size())]
    return found


def test_empty_table(spark):
    from listwarden.plans.reports import flag_frequency, reseller_breakdown, tier_summary

    empty = data.listings(spark).limit(0)
    scored = score_listings(empty, default_config(), data.references(spark), "row_id")
    assert [(row.records, row.percent) for row in tier_summary(scored).collect()] == [(0, 0.0)] * 4
    assert flag_frequency(scored).count() == 0
    assert reseller_breakdown(scored) is None
