"""One query per operator, with its SQL twin where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixtures import listings as fx
from fixtures import oracle
from listwarden import (
    Options,
    PublicSuffixes,
    flag_table,
    read_listings,
    score_listings,
    write_results,
)
from listwarden.functions import contact, text
from listwarden.operators.domains import with_registrable_domains
from listwarden.operators.frequency import row_digest, value_frequency
from listwarden.operators.groups import GROUP_NEEDS, name_fingerprints
from listwarden.operators.ordered import sorted_table
from listwarden.operators.prepare import Listings, clean_fields, derive
from listwarden.operators.row_ids import with_row_ids
from listwarden.operators.rules import CATALOG, FLAGS
from listwarden.plans import reports, residential
from listwarden.sources.files import preview, read_results

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

OPTIONS = Options(compare_cols=fx.COMPARED)
#: Of written tables that hold texts.
COMPRESSION = {"csv": "gzip", "parquet": "zstd"}
CFG = fx.fixture_config()


def query(sql: str | None = None):
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function
    return register


def on_listings(select: str, *extras: str) -> str:
    return oracle.with_tables(select, *extras)


def _derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    listings = Listings.of(fx.listings(spark, sf_dir), "row_id")
    return derive(listings.table.select(*clean_fields(listings, ["row_id"])), CFG)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    listings, texts = fx.referring_listings(spark, sf_dir)
    options = replace(OPTIONS, join_parts=fx.text_parts(spark, sf_dir))
    return score_listings(listings, CFG, fx.references(spark, sf_dir), "row_id", options, texts)


def _reported(spark: SparkSession, sf_dir: str, *shown: str) -> DataFrame:
    """The scored listings with the input columns that a report shows."""
    listings, texts = fx.referring_listings(spark, sf_dir)
    return score_listings(
        listings, CFG, fx.references(spark, sf_dir), "row_id", OPTIONS, texts, shown)


# --- sources, fields, ids, sinks ----------------------------------------------------

@query(on_listings(f"SELECT CAST(row_id AS VARCHAR) AS row_id, {oracle.COMPARED} FROM listings"))
def csv_source(spark, sf_dir):
    """Listings written as CSV come back as strings, empty cells included."""
    path = f"{fx.scratch(spark)}/listings.csv"
    fx.listings(spark, sf_dir).write.csv(
        path, header=True, quote='"', escape='"', emptyValue="", nullValue="\u0000",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
        compression=COMPRESSION["csv"],
    )
    return read_listings(spark, path, multi_line=True)


@query(on_listings(
    "SELECT row_id, business_name, address, phone, website, zip, '' AS email FROM listings"))
def canonical_fields(spark, sf_dir):
    """Export-style headers resolve to canonical fields; absent ones are empty."""
    source = fx.listings(spark, sf_dir).select(
        "row_id",
        F.concat(F.lit("\t "), F.col("business_name"), F.lit(" ")).alias("Company Name"),
        F.nullif("address", F.lit("")).alias("Street Address"),
        F.col("phone").alias("Local Phone > Phone Number"),
        F.col("website").alias("Website URL > URL"),
        F.lit("old").alias("Zip"), F.col("zip").alias("ZIP "),
    )
    listings = Listings.of(source, "row_id")
    return listings.table.select(*clean_fields(listings, ["row_id"])).select(
        "row_id", "business_name", "address", "phone", "website", "zip", "email"
    )


@query(on_listings(
    f"SELECT row_number() OVER (ORDER BY row_id) - 1 AS line, {oracle.INPUT} FROM listings"))
def generated_row_ids(spark, sf_dir):
    """The listings, written in order, with ids that follow from their places in the files."""
    path = f"{fx.scratch(spark)}/ordered"
    ordered = sorted_table(fx.stored_listings(spark, sf_dir), "row_id")
    ordered.write.parquet(path, compression=COMPRESSION["parquet"])
    return with_row_ids(spark.read.parquet(path), "line")


_SCORED_SQL = (f"SELECT {oracle.INPUT}, spam_score, risk_tier, flags_triggered, flag_details, "
               "is_duplicate_of_row FROM scored")


@query(oracle.scored(_SCORED_SQL))
def score_table(spark, sf_dir):
    """Every rule, score, tier, flags, details and duplicate reference on the input."""
    return _scored(spark, sf_dir)


def _written(spark, sf_dir, table, file_format="parquet"):
    folder, scored = fx.scratch(spark), _scored(spark, sf_dir)
    write_results(scored, folder, file_format, COMPRESSION[file_format])
    if table == "flagged":
        return read_results(spark, f"{folder}/flagged", scored.schema, file_format)
    return spark.read.parquet(f"{folder}/{table}")


@query(oracle.scored(_SCORED_SQL))
def sink_flagged(spark, sf_dir):
    """The flagged table as written and read back, every column."""
    return _written(spark, sf_dir, "flagged")


@query(oracle.scored(_SCORED_SQL))
def sink_flagged_csv(spark, sf_dir):
    """The flagged table as written to CSV and read back, every column."""
    return _written(spark, sf_dir, "flagged", "csv")


_TIER_SQL = """
SELECT position, t.risk_tier, count(s.row_id) AS records,
       coalesce(count(s.row_id) * 100.0::DOUBLE / nullif((SELECT count(*) FROM scored), 0), 0.0)
         AS percent,
       (SELECT count(*) FROM scored) AS total
FROM (VALUES (1, 'High Confidence Spam'), (2, 'Likely Spam'), (3, 'Review'), (4, 'Clean'))
     t(position, risk_tier)
LEFT JOIN scored s ON s.risk_tier = t.risk_tier GROUP BY 1, 2"""
_FLAG_COUNT_SQL = "SELECT flag, count(*) AS n FROM fired GROUP BY 1"


@query(oracle.scored(_TIER_SQL))
def sink_summary(spark, sf_dir):
    """The tier summary as written and read back."""
    return _written(spark, sf_dir, "summary")


@query(oracle.scored(_FLAG_COUNT_SQL))
def sink_top_flags(spark, sf_dir):
    """The flag counts as written and read back."""
    return _written(spark, sf_dir, "top_flags")


@query(on_listings(f"SELECT {oracle.INPUT} FROM listings ORDER BY row_id LIMIT 5"))
def raw_preview(spark, sf_dir):
    """The first five rows by id."""
    return preview(fx.listings(spark, sf_dir).orderBy("row_id"))


# --- residential-indicator upkeep ---------------------------------------------------

_WORK_SQL = """
first_rows AS (
  SELECT address, arg_min(city, row_id) AS city, arg_min(state, row_id) AS state,
         arg_min(zip, row_id) AS zip
  FROM d WHERE high_risk AND address <> '' GROUP BY address),
known AS (SELECT address, rdi FROM rdi WHERE rdi = 'Residential'),
fetched AS (
  SELECT address, CASE WHEN length(address) % 3 = 0 THEN NULL ELSE 'Commercial' END AS rdi
  FROM listings WHERE address <> ''),
merged AS (
  SELECT * FROM known
  UNION ALL
  SELECT address, max(coalesce(rdi, '')) FROM fetched
  WHERE address NOT IN (SELECT address FROM known) GROUP BY address)
"""


def _with_work(select: str) -> str:
    return oracle.with_tables("", "dims").rstrip() + "," + _WORK_SQL + select


def _lookups(spark, sf_dir):
    known = fx.rdi(spark, sf_dir).filter(F.col("rdi") == "Residential")
    fetched = fx.stored_listings(spark, sf_dir).filter(F.col("address") != "").select(
        "address", F.when(F.length("address") % 3 != 0, F.lit("Commercial")).alias("rdi")
    )
    return known, fetched


@query(_with_work("SELECT * FROM first_rows WHERE address NOT IN (SELECT address FROM known)"))
def rdi_worklist(spark, sf_dir):
    """High-risk addresses without an answer, with the place of their first row."""
    known, _ = _lookups(spark, sf_dir)
    return residential.lookup_worklist(fx.stored_listings(spark, sf_dir), CFG, known, "row_id")


@query(_with_work("SELECT address, rdi FROM merged"))
def rdi_merge(spark, sf_dir):
    """Known answers plus fetched ones, failures as ''."""
    return residential.merge_lookups(*_lookups(spark, sf_dir))


@query(_with_work("SELECT address, rdi FROM merged WHERE address IN "
                  "(SELECT address FROM first_rows)"))
def rdi_for_batch(spark, sf_dir):
    """The answers a batch needs, from a table laid out by address."""
    merged = residential.store_lookups(
        residential.merge_lookups(*_lookups(spark, sf_dir)),
        f"merged_{uuid.uuid4().hex}", fx.RDI_BUCKETS, f"{fx.scratch(spark)}/merged")
    return residential.lookups_for_batch(merged, fx.stored_listings(spark, sf_dir), CFG, "row_id")


# --- building blocks ------------------------------------------------------------------

@query(rf"SELECT doc_id, {oracle._strip('text')} AS cell FROM documents")
def clean_cells(spark, sf_dir):
    """Whole document texts, coated with white space that cleaning removes."""
    coated = F.concat(F.lit(" \t "), F.col("text"), F.lit("\n　\x0b"))
    return fx.read(spark, sf_dir, "documents").select(
        "doc_id", text.clean_cell(coated).alias("cell")
    )


def _folded(column: str) -> str:
    folds = {"a": "àáâãäå", "c": "ç", "e": "èéêë", "i": "ìíîï", "n": "ñ", "o": "òóôõö",
             "u": "ùúûü", "y": "ýÿ"}
    sql = f"lower({column})"
    for base, accented in folds.items():
        sql = f"regexp_replace({sql}, '[{accented}]', '{base} ', 'g')"
    return sql


@query(rf"SELECT doc_id, trim(regexp_replace({_folded('text')}, '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"
       " AS normalized FROM documents")
def normalized_text(spark, sf_dir):
    """Whole document texts as plain words, accents split off."""
    return fx.read(spark, sf_dir, "documents").select(
        "doc_id", text.normalize_text(F.col("text")).alias("normalized")
    )


_LEGAL_NAME = "c_name || CASE c_custkey % 4 WHEN 0 THEN ' LLC' WHEN 1 THEN ' & Co. Services' " \
              "WHEN 2 THEN ' Incorporated' ELSE '' END"


def _legal_names(spark, sf_dir):
    ending = F.element_at(F.array(*[
        F.lit(e) for e in (" LLC", " & Co. Services", " Incorporated", "")
    ]), (F.col("c_custkey") % 4 + 1).cast("int"))
    return fx.read(spark, sf_dir, "customer").select(
        "c_custkey", F.concat(F.col("c_name"), ending).alias("name")
    )


@query(rf"SELECT c_custkey, trim(regexp_replace({oracle._norm(_LEGAL_NAME)}, "
       rf"'{oracle._LEGAL}', '', 'g')) AS name FROM customer")
def legal_suffixes(spark, sf_dir):
    """Customer names without legal-entity words."""
    return _legal_names(spark, sf_dir).select(
        "c_custkey", text.strip_legal_words(text.normalize_text(F.col("name"))).alias("name")
    )


@query("SELECT doc_id, regexp_replace(text, '[^0-9]', '', 'g') AS digits FROM documents")
def phone_digits(spark, sf_dir):
    """Digits of whole document texts."""
    return fx.read(spark, sf_dir, "documents").select(
        "doc_id", contact.digits_only(F.col("text")).alias("digits")
    )


@query(on_listings("SELECT row_id, dialable, area AS area_code FROM d WHERE dialable"))
def area_codes(spark, sf_dir):
    """Area codes of dialable numbers."""
    return _derived(spark, sf_dir).filter("dialable").select("row_id", "dialable", "area_code")


_ALL_KINDS_SQL = rf"""
SELECT page_id, CASE
  WHEN regexp_matches(host, '(^|\.)therin\.example\.net$') THEN 'therin.example.net'
  WHEN host = 'example.com' THEN ''
  WHEN host LIKE '%.example.com' THEN regexp_extract(host, '([^.]+\.example\.com)$', 1)
  WHEN host LIKE '%.example.net' THEN regexp_extract(host, '([^.]+\.[^.]+\.example\.net)$', 1)
  ELSE {oracle._domain('host')} END AS domain
FROM (SELECT page_id, {oracle._host('url')} AS host FROM pages)"""


@query(_ALL_KINDS_SQL)
def registrable_domains(spark, sf_dir):
    """Domains of page URLs under plain, wildcard and exception suffix rules."""
    pages = fx.read(spark, sf_dir, "pages").select(
        "page_id", contact.host_of(F.col("url")).alias("host")
    )
    suffixes = PublicSuffixes.from_rules(spark, fx.SUFFIXES_ALL_KINDS)
    return with_registrable_domains(pages, {"domain": F.col("host")}, suffixes).drop("host")


@query(f"SELECT page_id, {oracle._host('url')} AS host FROM pages")
def full_hosts(spark, sf_dir):
    """Hosts of page URLs."""
    return fx.read(spark, sf_dir, "pages").select(
        "page_id", contact.host_of(F.col("url")).alias("host")
    )


@query(on_listings("SELECT row_id, email_domain, email_local FROM d"))
def email_parts(spark, sf_dir):
    """Domain and local part of e-mail addresses."""
    return _derived(spark, sf_dir).select("row_id", "email_domain", "email_local")


_PROSE = "|".join(fx.PROSE_WORDS)


@query(f"SELECT doc_id, regexp_extract(lower(text), '{_PROSE}') AS first, "
       f"len(regexp_extract_all(lower(text), '{_PROSE}')) AS hits FROM documents "
       f"WHERE regexp_matches(lower(text), '{_PROSE}')")
def keyword_matches(spark, sf_dir):
    """First hit and number of hits of a word list in whole document texts."""
    pattern = text.any_of(fx.PROSE_WORDS)
    return (
        fx.read(spark, sf_dir, "documents")
        .select("doc_id", F.lower("text").alias("body"))
        .filter(F.col("body").rlike(pattern))
        .select("doc_id", F.regexp_extract("body", pattern, 0).alias("first"),
                F.regexp_count("body", F.lit(pattern)).cast("long").alias("hits"))
    )


@query("SELECT doc_id, (length(text) - length(replace(text, 'ti', ''))) // 2 AS hits "
       "FROM documents")
def substring_counts(spark, sf_dir):
    """Non-overlapping occurrences in whole document texts."""
    return fx.read(spark, sf_dir, "documents").select(
        "doc_id", text.count_substring(F.col("text"), F.lit("ti")).cast("long").alias("hits")
    )


@query(on_listings("SELECT row_id, high_risk FROM d"))
def high_risk_listings(spark, sf_dir):
    """Which listings are in a high-risk industry."""
    return _derived(spark, sf_dir).select("row_id", "high_risk")


@query(on_listings("SELECT row_id, name_key FROM d"))
def name_keys(spark, sf_dir):
    """Names as near-duplicates are judged by."""
    return _derived(spark, sf_dir).select("row_id", "name_key")


@query(on_listings("SELECT row_id, concat_ws('; ', nullif(address, ''), nullif(phone, ''), "
                   "nullif(owner_name, '')) AS joined FROM d"))
def joined_values(spark, sf_dir):
    """Non-empty values of a row in one text."""
    columns = [F.col(name) for name in ("address", "phone", "owner_name")]
    return _derived(spark, sf_dir).select(
        "row_id", text.join_nonempty("; ", *columns).alias("joined")
    )


# --- frequencies ------------------------------------------------------------------------

def _frequency(name: str, key: Callable[[], object], sql_key: str, needs_domain: bool = False):
    sql = on_listings(f"SELECT {sql_key} AS key, count(*) AS n, min(row_id) AS first_id FROM d "
                      f"WHERE {sql_key} <> '' GROUP BY 1")

    def run(spark, sf_dir):
        rows = _derived(spark, sf_dir)
        if needs_domain:
            rows = with_registrable_domains(
                rows, {"site": F.col("host")}, PublicSuffixes.from_rules(spark, fx.SUFFIXES)
            )
        return value_frequency(rows, key(), F.col("row_id"))

    run.__name__ = name
    run.__doc__ = f"How often each value of {name.removeprefix('frequency_')} occurs."
    query(sql)(run)


_frequency("frequency_city", lambda: F.col("city"), "city")
_frequency("frequency_address", lambda: F.lower("address"), "lower(address)")
_frequency("frequency_phone", lambda: F.col("digits"), "digits")
_frequency("frequency_domain", lambda: F.col("site"), "site", needs_domain=True)
_frequency("frequency_email", lambda: F.col("email_lower"), "email_lower")
_frequency("frequency_owner", lambda: F.col("owner_norm"), "owner_norm")


@query(on_listings("SELECT reseller, day, count(*) AS n FROM d GROUP BY 1, 2"))
def frequency_reseller_day(spark, sf_dir):
    """Listings per reseller and submission day."""
    reseller = F.when(F.col("reseller_id") == "", "UNKNOWN").otherwise(F.col("reseller_id"))
    return (
        _derived(spark, sf_dir)
        .groupBy(reseller.alias("reseller"), F.substring("date_added", 1, 10).alias("day"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(on_listings("SELECT n, first_id, count(*) AS members FROM copies GROUP BY 1, 2", "copies"))
def frequency_row(spark, sf_dir):
    """Sizes of groups of identical rows, by their first row."""
    digest = row_digest([F.col(name) for name in fx.COMPARED])
    groups = fx.listings(spark, sf_dir).select("row_id", digest.alias("key")).groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first_id")
    )
    return groups.select("n", "first_id", F.col("n").alias("members"))


_FINGERPRINT_SQL = "\nUNION ALL ".join(
    f"SELECT '{kind}' AS kind, {kind} AS key, count(*) AS n, min(row_id) AS first_id "
    f"FROM f GROUP BY 2" for kind in ("words", "trigrams", "prefix"))


@query(oracle.with_tables("", ).rstrip() + "," + oracle.FINGERPRINTS + _FINGERPRINT_SQL)
def frequency_name_fingerprints(spark, sf_dir):
    """Groups of names per fingerprint."""
    kinds = name_fingerprints(F.col("name_key"))
    return (
        _derived(spark, sf_dir)
        .filter(F.col("name_key") != "")
        .select("row_id", F.inline(F.array(*[
            F.struct(F.lit(kind).alias("kind"), key.alias("key")) for kind, key in kinds.items()
        ])))
        .groupBy("kind", "key")
        .agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first_id"))
    )


# --- rules --------------------------------------------------------------------------------

def _flag_query(flag: str) -> None:
    needs = {rule.flag: rule.needs for rule in CATALOG}[flag]
    tables = [name for name in ("zip_dim", "area_code_dim", "rdi") if name in needs]
    if {"site_domain", "landing_domain"} & set(needs):
        tables.append("suffixes")
    source = fx.stored_listings if set(needs) & set(GROUP_NEEDS) else fx.listings

    def run(spark, sf_dir):
        references = fx.references(spark, sf_dir, *tables) if tables else fx.References()
        return flag_table(
            source(spark, sf_dir), CFG, references, "row_id", OPTIONS, flags=[flag]
        )

    run.__name__ = f"flag_{flag.lower()}"
    run.__doc__ = f"Listings that get {flag}, with the evidence."
    query(oracle.flag_sql(flag))(run)


for _flag in FLAGS:
    _flag_query(_flag)


@query(on_listings("SELECT row_id, CAST(first_id AS VARCHAR) AS is_duplicate_of_row FROM copies "
                   "WHERE first_id <> row_id", "copies"))
def duplicate_of_row(spark, sf_dir):
    """Rows that repeat an earlier one, with all rules but this switched off."""
    cfg = CFG.replace(disabled_rules={rule.disable_key for rule in CATALOG} - {None})
    listings = fx.stored_listings(spark, sf_dir)
    scored = score_listings(listings, cfg, id_col="row_id", options=OPTIONS)
    return scored.filter("is_duplicate_of_row <> ''").select("row_id", "is_duplicate_of_row")


@query(oracle.scored("SELECT row_id, ord, flag, weight, detail FROM fired"))
def flags_long(spark, sf_dir):
    """Every fired flag as a row."""
    listings, texts = fx.referring_listings(spark, sf_dir)
    return flag_table(
        listings, CFG, fx.references(spark, sf_dir), "row_id", OPTIONS, texts=texts)


# --- reports and filters ------------------------------------------------------------------

@query(oracle.scored(_TIER_SQL))
def tier_summary(spark, sf_dir):
    """Records and percentage per tier."""
    return reports.tier_summary(_reported(spark, sf_dir))


@query(oracle.scored(_FLAG_COUNT_SQL))
def flag_frequency(spark, sf_dir):
    """How often each flag fired."""
    return reports.flag_frequency(_reported(spark, sf_dir))


@query(oracle.scored(_FLAG_COUNT_SQL + " ORDER BY n DESC, flag LIMIT 5"))
def top_flags(spark, sf_dir):
    """The five most frequent flags."""
    return reports.flag_frequency(_reported(spark, sf_dir), top=5)


def _signals(*names: str, keep_empty: bool) -> str:
    rows = ", ".join(f"({at}, '{name}', '{reports.CLUSTER_SIGNALS[name]}')"
                     for at, name in enumerate(names, start=1))
    sql = (f"SELECT position, signal, count(s.row_id) AS records FROM (VALUES {rows}) "
           "v(position, signal, flag) LEFT JOIN scored s ON contains(s.flags_triggered, flag) "
           "GROUP BY 1, 2")
    return oracle.scored(sql if keep_empty else sql + " HAVING count(s.row_id) > 0")


@query(_signals(*reports.CLUSTER_SIGNALS, keep_empty=True))
def cluster_sizes(spark, sf_dir):
    """Records per cluster signal, zeros included."""
    return reports.cluster_sizes(_reported(spark, sf_dir))


_SHORT_SIGNALS = ("Shared phone", "Shared address", "Shared email")


@query(_signals(*_SHORT_SIGNALS, keep_empty=False))
def cluster_sizes_short(spark, sf_dir):
    """Records of the three contact signals that occur."""
    return reports.cluster_sizes(_reported(spark, sf_dir), _SHORT_SIGNALS, keep_empty=False)


_RESELLER_SQL = ("SELECT reseller_id AS reseller, count(*) AS records, {mean} AS avg_score "
                 "FROM scored GROUP BY 1 ORDER BY avg(spam_score) DESC, reseller")


@query(oracle.scored(_RESELLER_SQL.format(mean="round_even(avg(spam_score), 1)")))
def reseller_breakdown(spark, sf_dir):
    """Mean score of every reseller, to one digit."""
    return reports.reseller_breakdown(
        _reported(spark, sf_dir, "reseller_id"), reports.RESELLER_HEADERS_WIDE, digits=1
    )


@query(oracle.scored(_RESELLER_SQL.format(mean="avg(spam_score)") + " LIMIT 10"))
def reseller_top(spark, sf_dir):
    """The ten resellers with the highest mean score."""
    return reports.reseller_breakdown(_reported(spark, sf_dir, "reseller_id"), top=10)


_SHOWN = "row_id, spam_score, risk_tier, flags_triggered"


def _shown(df: DataFrame) -> DataFrame:
    return df.select(*_SHOWN.split(", "))


@query(oracle.scored(f"SELECT {_SHOWN} FROM scored WHERE risk_tier IN ('Likely Spam', 'Review')"))
def filter_tier(spark, sf_dir):
    """Rows of chosen tiers, of the table as written."""
    written = _written(spark, sf_dir, "flagged")
    return _shown(reports.filter_scored(written, tiers=("Likely Spam", "Review")))


@query(oracle.scored(f"SELECT {_SHOWN} FROM scored WHERE spam_score >= 30"))
def filter_score(spark, sf_dir):
    """Rows from a score on, of the table as written."""
    return _shown(reports.filter_scored(_written(spark, sf_dir, "flagged"), min_score=30))


@query(oracle.scored(f"SELECT {_SHOWN} FROM scored "
                     "WHERE regexp_matches(flags_triggered, 'SHARED_(PHONE|ADDRESS)')"))
def filter_flag(spark, sf_dir):
    """Rows whose flags match a pattern."""
    return _shown(reports.filter_scored(
        _reported(spark, sf_dir, "row_id"), flag_search=" shared_(phone|address) "
    ))


@query(oracle.scored("SELECT spam_score, risk_tier, flags_triggered, flag_details, "
                     f"is_duplicate_of_row, {oracle.INPUT} FROM scored"))
def results_first(spark, sf_dir):
    """Output columns before input columns."""
    return reports.results_first(_scored(spark, sf_dir))


@query(oracle.scored("SELECT business_name, address, city, state, spam_score, risk_tier, "
                     "flags_triggered FROM scored "
                     "WHERE contains(flags_triggered, 'RESIDENTIAL_ADDRESS')"))
def residential_review(spark, sf_dir):
    """Rows at residential addresses."""
    return reports.residential_review(
        _reported(spark, sf_dir, "business_name", "address", "city", "state"))
