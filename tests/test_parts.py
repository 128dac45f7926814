"""Configuration, fields, text, sources, sinks, residential upkeep, streams."""

import os
import subprocess
import sys
import unicodedata

import data
import pyarrow.parquet as pq
import pytest
from conftest import ROOT
from pyspark.sql import functions as F

from listwarden import (
    PublicSuffixes,
    RiskConfig,
    default_config,
    flag_table,
    read_listings,
    score_listings,
    template_config,
    write_results,
)
from listwarden.fields import FIELD_ALIASES, normalize_header, resolve_fields
from listwarden.functions import text
from listwarden.operators.frequency import _hot_keys, _restrict, value_frequency
from listwarden.operators.groups import residential_keys
from listwarden.operators.reference import with_zip_state
from listwarden.operators.row_ids import with_row_ids
from listwarden.plans import reports, residential
from listwarden.sources.files import read_results
from listwarden.streaming.local import ROW_LOCAL_FLAGS, stream_flags


def test_config():
    cfg = default_config()
    assert (len(cfg.high_risk_industries), len(template_config().high_risk_industries)) == (33, 24)
    assert RiskConfig.from_dict(cfg.to_dict()) == cfg
    changed = cfg.replace(high_risk_industries=["Baker", ""], shared_phone_threshold=9)
    assert changed.high_risk_industries == ("baker",)
    assert changed.disabled_rules == cfg.disabled_rules and changed.weights == cfg.weights
    settings = cfg.to_dict()
    del settings["lead_gen_domains"]
    with pytest.raises(KeyError):
        RiskConfig.from_dict(settings)


def test_fields():
    aliases = [alias for group in FIELD_ALIASES.values() for alias in group]
    assert (len(FIELD_ALIASES), len(aliases), len(set(aliases))) == (31, 136, 136)
    assert normalize_header(" Local Phone > Phone Number ") == "local_phone_phone_number"
    assert resolve_fields(["Name", "company", "NAME!", "x"]) == {"business_name": 2, "x_handle": 3}


def test_normalized_text(spark):
    values = ["Résumé  & Co.", "ÅNGSTRÖM", "café", "a_b c", None, "ﬁne ½ Größe", "Ελλάδα"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    native = [r[0] for r in df.select(text.normalize_text(F.col("v"))).collect()]
    full = [r[0] for r in df.select(text.normalize_text(F.col("v"), True)).collect()]

    def expected(value):
        spread = unicodedata.normalize("NFKD", (value or "").lower())
        return " ".join("".join(c if c.isalnum() or c == "_" else " " for c in spread).split())

    assert native == full == [expected(value) for value in values]


def test_quoted_lists(spark):
    values = ["a", "it's", 'say "x"', "it's \"x\"", "back\\slash"]
    df = spark.createDataFrame([(values,)], "v array<string>")
    assert df.select(text.list_text(F.col("v"))).first()[0] == repr(values)


def test_row_ids_are_contiguous(spark):
    ids = with_row_ids(spark.range(0, 1000, 1, 7).filter("id % 3 != 0").repartition(5))
    assert sorted(row.row_id for row in ids.collect()) == list(range(666))


def test_row_ids_of_files_are_places(spark, tmp_path):
    """Ids of Parquet rows follow files and places; only tables without places are copied."""
    spark.range(0, 1000, 1, 7).withColumn("x y.z", F.col("id") % 7).write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    ids = with_row_ids(table.toDF("a", "b"), "at")
    assert sorted((row.at, row.a) for row in ids.collect()) == [(i, i) for i in range(1000)]
    assert ids.columns == ["a", "b", "at"]
    plan = ids.select("a", "at")._jdf.queryExecution().executedPlan().toString()
    assert f"{tmp_path}/t" in plan and "x y.z" not in plan.split("ReadSchema")[1]
    few = spark.range(10).withColumnRenamed("id", "k")
    for other in (table.filter("id % 3 != 0"), table.filter("id < 150"), table.union(table),
                  table.join(few, F.col("id") % 10 == F.col("k")), table.limit(50),
                  table.select(F.explode(F.array("id", "id")).alias("id")), table.filter("id < 0")):
        found = sorted(row.row_id for row in with_row_ids(other).collect())
        assert found == list(range(other.count()))
    table.write.csv(f"{tmp_path}/c", header=True)
    lines = with_row_ids(spark.read.csv(f"{tmp_path}/c", header=True))
    assert sorted(row.row_id for row in lines.collect()) == list(range(1000))


def test_csv_keeps_empty_cells_and_refuses_other_files(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('name,phone,city\n"A, ""B""",,Rome\nshort\nNA,null,\n')
    rows = [tuple(row) for row in read_listings(spark, str(path)).collect()]
    assert rows == [('A, "B"', "", "Rome"), ("short", "", ""), ("NA", "null", "")]
    with pytest.raises(ValueError, match="Unsupported file type"):
        read_listings(spark, "in.docx")


@pytest.mark.parametrize("file_format", ["parquet", "csv"])
def test_written_results(spark, tmp_path, file_format):
    scored = score_listings(data.listings(spark), default_config(), id_col="row_id")
    folder = str(tmp_path / "out")
    write_results(scored, folder, file_format)
    flagged = read_results(spark, f"{folder}/flagged", scored.schema, file_format)
    assert sorted(flagged.collect()) == sorted(scored.collect())
    for name, report in (("summary", reports.tier_summary), ("top_flags", reports.flag_frequency)):
        expected = report(scored)
        written = read_results(spark, f"{folder}/{name}", expected.schema, file_format)
        assert written.collect() == expected.collect() and written.columns == expected.columns


def test_results_of_empty_tables_and_of_unknown_flags(spark, tmp_path):
    rows = [(1, "a", "Clean", ""), (2, None, "Review", "NO_WEBSITE, HOUSE_RULE, PO_BOX"),
            (3, "", "Review", "PO_BOX, PO_BOX")]
    schema = "spam_score int, note string, risk_tier string, flags_triggered string"
    for number, some in enumerate((rows, rows[:1], [])):
        scored = spark.createDataFrame(some, schema)
        for file_format in ("parquet", "csv"):
            folder = str(tmp_path / f"{file_format}-{number}")
            write_results(scored, folder, file_format)
            got = read_results(spark, f"{folder}/flagged", scored.schema, file_format)
            assert sorted(got.collect(), key=repr) == sorted(scored.collect(), key=repr)
            for name, report in (("summary", reports.tier_summary),
                                 ("top_flags", reports.flag_frequency)):
                expected = report(scored)
                written = read_results(spark, f"{folder}/{name}", expected.schema, file_format)
                assert sorted(written.collect()) == sorted(expected.collect())


def test_filters_read_only_what_they_ask_for(spark, tmp_path):
    """Tiers are folders of the written table, and files are sorted by score."""
    tiers = {"Clean": 0, "Review": 100, "Likely Spam": 200}
    scored = spark.range(3000).select(
        F.element_at(F.array(*[F.lit(tier) for tier in tiers]), (F.col("id") % 3 + 1).cast("int"))
        .alias("risk_tier"), (F.col("id") * 7919 % 1000).cast("int").alias("spam_score"),
        F.lit("").alias("flags_triggered"), F.col("id").alias("odd `name`")).repartition(3)
    write_results(scored, str(tmp_path))
    written = read_results(spark, f"{tmp_path}/flagged", scored.schema)
    assert written.columns == scored.columns
    chosen = reports.filter_scored(written, ["Review", "Clean"], 900)
    expected = reports.filter_scored(scored, ["Review", "Clean"], 900)
    assert sorted(chosen.collect()) == sorted(expected.collect()) and chosen.count() > 100
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "risk_tier" in plan.split("PartitionFilters: ")[1].split("]")[0]
    assert "GreaterThanOrEqual(spam_score,900)" in plan.split("PushedFilters: ")[1]
    for folder in (tmp_path / "flagged").glob("risk_tier=*"):
        for file in folder.glob("*.parquet"):
            scores = pq.read_table(file, partitioning=None)["spam_score"].to_pylist()
            assert scores == sorted(scores)


REPEATED_TASKS = """
import sys
from pyspark import TaskContext
from pyspark.sql import SparkSession, functions as F
from listwarden.sources.files import write_results
from listwarden.plans import reports

spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
rows = spark.range(0, 1000, 1, 4).selectExpr(
    "id", "'Review' AS risk_tier", "if(id % 2 = 0, 'PO_BOX', '') AS flags_triggered", "1 AS spam_score")

def once_more(batches):
    for batch in batches:
        yield batch
    if TaskContext.get().attemptNumber() == 0 and TaskContext.get().partitionId() % 2:
        raise OSError("the first attempt fails after its rows")

scored = rows.mapInArrow(once_more, rows.schema)
write_results(scored, sys.argv[1])
assert spark.read.parquet(sys.argv[1] + "/flagged").count() == 1000
summary = {r.risk_tier: r.records for r in spark.read.parquet(sys.argv[1] + "/summary").collect()}
assert summary == {"High Confidence Spam": 0, "Likely Spam": 0, "Review": 1000, "Clean": 0}, summary
assert [tuple(r) for r in spark.read.parquet(sys.argv[1] + "/top_flags").collect()] == [("PO_BOX", 500)]
"""


def test_repeated_tasks_count_once(tmp_path):
    """Tasks that fail after their rows and run again; needs a session that repeats tasks."""
    done = subprocess.run(
        [sys.executable, "-c", REPEATED_TASKS, str(tmp_path / "out")], cwd=tmp_path,
        env=os.environ | {"PYTHONPATH": str(ROOT)}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]


def test_reports_and_filters(spark):
    scored = spark.createDataFrame(
        [("a", 10, "Likely Spam", "SHARED_PHONE, NO_WEBSITE"), ("a", 3, "Clean", "NO_WEBSITE"),
         ("b", 2, "Clean", ""), ("b", 2, "Clean", ""), ("", 4, "Clean", ""), (None, 9, "Clean", "")],
        "Reseller string, spam_score int, risk_tier string, flags_triggered string")
    assert [tuple(r) for r in reports.flag_frequency(scored).collect()] == [
        ("NO_WEBSITE", 2), ("SHARED_PHONE", 1)]
    assert [tuple(r) for r in reports.reseller_breakdown(scored, top=2).collect()] == [
        ("a", 2, 6.5), ("", 1, 4.0)]
    assert [r.records for r in reports.cluster_sizes(scored).collect()] == [1, 0, 0, 0, 0]
    assert reports.cluster_sizes(scored, keep_empty=False).count() == 1
    assert reports.filter_scored(scored).count() == 6
    assert reports.filter_scored(scored, ["Clean"], 3, " no_web|SHARED ").count() == 1


def test_residential_upkeep(spark):
    df = data.listings(spark)
    known = spark.createDataFrame([("77 Cedar Ave", "")], "address string, rdi string")
    work = residential.lookup_worklist(df, default_config(), known, "row_id").collect()
    assert {(r.address, r.city) for r in work} == {
        ("12 Pier Rd", "Boston"), ("PO Box 88", "Mesa"), ("The UPS Store #12", "Omaha"),
        ("9 Mill Ln", "Reno"), ("1 Fake St", "Salem")}
    fetched = spark.createDataFrame(
        [("77 Cedar Ave", "Residential"), ("12 Pier Rd", None), ("elsewhere", "Commercial")],
        "address string, rdi string")
    merged = residential.merge_lookups(known, fetched)
    assert {tuple(r) for r in merged.collect()} == {
        ("77 Cedar Ave", ""), ("12 Pier Rd", ""), ("elsewhere", "Commercial")}
    batch = residential.lookups_for_batch(merged, df, default_config(), "row_id")
    assert {r.address for r in batch.collect()} == {"77 Cedar Ave", "12 Pier Rd"}
    assert residential.lookup_worklist(df.drop("address"), default_config(), None, "row_id") is None


def test_stored_lookups_are_read_in_place(spark, tmp_path):
    """No plan moves the growing table; only what a batch asks for is brought to its buckets."""
    df = data.listings(spark)
    answers = spark.createDataFrame(
        [("77 Cedar Ave", ""), ("12 Pier Rd", "Residential"), (" 9 Mill Ln ", "Residential"),
         (None, "Residential"), ("elsewhere", "Commercial")], "address string, rdi string")
    table = residential.store_lookups(answers, "stored_answers", 8, f"{tmp_path}/answers")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        batch = residential.lookups_for_batch(table, df, default_config(), "row_id")
        plain = residential.lookups_for_batch(answers.na.fill("").withColumn(
            "address", F.trim("address")), df, default_config(), "row_id")
        assert sorted(_answers(batch)) == sorted(_answers(plain)) and batch.count() == 3
        assert not _moved(batch, "stored_answers")
        groups = spark.createDataFrame(
            [(0, b"12 Pier Rd", 1), (0, b"77 Cedar Ave", 2), (1, b"x", 3)],
            "kind int, key binary, n int").groupBy("kind", "key").agg(F.sum("n").alias("n"))
        kept = _restrict(groups, 0, residential_keys(table))
        assert sorted((r.kind, bytes(r.key)) for r in kept.collect()) == [(0, b"12 Pier Rd"), (1, b"x")]
        assert not _moved(kept, "stored_answers")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    rules = {id_: flag_table(df, default_config(), data.references(spark, rdi=source), "row_id",
                             flags=["RESIDENTIAL_ADDRESS"]).collect()
             for id_, source in (("stored", table), ("plain", answers))}
    assert sorted(rules["stored"]) == sorted(rules["plain"]) and len(rules["plain"]) == 3


def _answers(rows):
    return [(r.address.strip(), r.rdi) for r in rows.collect()]


def _moved(df, table):
    """Whether an exchange stands between a table's scan and the rest of the plan."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    place = next(at for at, line in enumerate(lines) if table in line and "Scan" in line)
    depth = len(lines[place]) - len(lines[place].lstrip(" :+-*()0123456789"))
    for line in reversed(lines[:place]):
        indent = len(line) - len(line.lstrip(" :+-*()0123456789"))
        if indent < depth:
            depth = indent
            if "Exchange" in line:
                return True
    return False


def test_suffix_table_size_is_checked(spark, monkeypatch):
    from listwarden.operators import domains

    monkeypatch.setattr(domains, "MAX_SUFFIX_RULES", 3)
    with pytest.raises(ValueError, match="suffix"):
        PublicSuffixes.from_rules(spark)


def test_row_local_rules_on_a_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    data.listings(spark).write.parquet(source)
    stream = spark.readStream.schema(data.listings(spark).schema).parquet(source)
    query = stream_flags(stream, default_config(), "row_id", data.references(spark)).writeStream \
        .format("memory").queryName("stream_flags").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    found = {row.flag for row in spark.table("stream_flags").collect()}
    assert "PO_BOX" in found and found <= set(ROW_LOCAL_FLAGS)


def test_csv_keeps_blanks_and_short_rows_and_raises_on_surplus_fields(spark, tmp_path):
    good, bad = tmp_path / "good.csv", tmp_path / "bad.csv"
    good.write_text('name,phone,city\n  A  ,1,x\nB,2\n"C, D",,\n')
    bad.write_text("name,phone\nA,1,EXTRA\n")
    rows = [tuple(r) for r in read_listings(spark, str(good)).collect()]
    assert rows == [("  A  ", "1", "x"), ("B", "2", ""), ("C, D", "", "")]
    with pytest.raises(Exception, match="more fields than headers"):
        read_listings(spark, str(bad)).select("name").collect()


def test_every_hot_key_is_split(spark):
    groups = spark.range(20_000).select(
        F.lit(1).alias("kind"), F.col("id").cast("string").cast("binary").alias("key"),
        F.lit(7).cast("long").alias("n"), F.col("id").alias("first_id"))
    assert _hot_keys(groups, 2).count() == 20_000


def test_reference_keys_of_any_form_match(spark):
    listings = spark.createDataFrame([("12345-6789",), ("1",)], "zip string")
    table = spark.createDataFrame([("12345-6789", "ny")], "zip string, state_code string")
    out = with_zip_state(listings, F.col("zip"), table, "state").collect()
    assert {r.zip: r.state for r in out} == {"12345-6789": "NY", "1": None}


def test_every_character_decomposes(spark):
    """The built-in decomposition equals the tables of Python, for each code point on its own and in words."""
    codes = [c for c in range(1, 0x110000) if not 0xD800 <= c <= 0xDFFF and unicodedata.category(chr(c)) != "Cn"]
    blocks = ["-".join(f"x{chr(c)}y" for c in codes[i:i + 64]) for i in range(0, len(codes), 64)]
    rows = spark.createDataFrame([(b,) for b in [*blocks, "\U0001d400cme \ufb01re \u00bd price \u33d2 \ud55c\uae00", "", None]], "t string")
    got = rows.select("t", text.normalize_text(F.col("t")).alias("a"), text.normalize_text(F.col("t"), full_nfkd=True).alias("b"))
    wrong = got.filter("NOT a <=> b").collect()
    assert not wrong, (len(wrong), wrong[0])


@pytest.mark.parametrize("file_format, compression", [("csv", "gzip"), ("parquet", "zstd")])
def test_compressed_results_come_back(spark, tmp_path, file_format, compression):
    scored = score_listings(data.listings(spark), default_config(), id_col="row_id")
    write_results(scored, str(tmp_path), file_format, compression)
    ending = {"csv": "*.csv.gz", "parquet": "*.zstd.parquet"}[file_format]
    assert list((tmp_path / "flagged").rglob(ending))
    back = read_results(spark, f"{tmp_path}/flagged", scored.schema, file_format)
    assert back.exceptAll(scored).isEmpty() and scored.exceptAll(back).isEmpty()


def test_frequency_computes_each_key_once(spark):
    """The empty key goes by its count: a filter on the key would work it out at the scan again."""
    rows = [(1, "a.x"), (2, None), (3, ""), (4, "b.x"), (5, "c.y"), (6, ".z"), (7, ".z")]
    frame = spark.createDataFrame(rows, "row_id long, site string")
    key = F.regexp_extract("site", r"^([a-z]*)\.?([a-z]*)$", 2)
    counted = value_frequency(frame, key, F.col("row_id"))
    assert sorted(map(tuple, counted.collect())) == [("x", 2, 1), ("y", 1, 5), ("z", 2, 6)]
    assert sorted(map(tuple, value_frequency(frame, F.col("site")).collect())) == [
        (".z", 2), ("a.x", 1), ("b.x", 1), ("c.y", 1)]
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") == 1
