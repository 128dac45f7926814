"""Scoring of a whole table of listings.

One lazy plan: narrow keys are counted and joined back as per-row evidence. Rules that need
no other row are judged on the scan; which of them fired travels as the bits of one number.
Only what the output asks for meets the evidence in the one join on the row id.

Texts in a table of their own (``Texts``) are not carried across that join: if the output shows
them, references meet the evidence, then the texts come in and all rules are judged. If it does
not, rules are judged on the scan as above. So no text moves with its listing.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwarden.config import RiskConfig, TierThresholds
from listwarden.operators import rules
from listwarden.operators.domains import PublicSuffixes, with_registrable_domains
from listwarden.operators.frequency import SALT_ROWS, group_evidence
from listwarden.operators.groups import (
    GROUP_FIELDS,
    GROUP_NEEDS,
    batch_columns,
    copy_keys,
    group_kinds,
    residential_keys,
)
from listwarden.operators.prepare import ROW_ID, Listings, Texts, clean_fields, derive
from listwarden.operators.reference import with_area_region, with_zip_state

OUTPUT_COLUMNS = (
    "spam_score", "risk_tier", "flags_triggered", "flag_details", "is_duplicate_of_row",
)
TIERS = ("High Confidence Spam", "Likely Spam", "Review", "Clean")


@dataclass(frozen=True)
class References:
    """Reference tables. Rules whose table is missing do not run."""

    suffixes: PublicSuffixes | None = None
    #: ``zip, state_code``
    zip_dim: DataFrame | None = None
    #: ``area_code, region_desc``
    area_code_dim: DataFrame | None = None
    #: ``address, rdi``; grows with the listings, so it is joined by shuffle.
    rdi: DataFrame | None = None


@dataclass(frozen=True)
class Options:
    """How to run, as opposed to what to look for."""

    #: Input columns that must agree for two rows to be copies; None means all.
    compare_cols: tuple[str, ...] | None = None
    #: Expand accents with an Arrow UDF that also knows ligatures and syllables.
    full_nfkd: bool = False
    #: Rows of one key that a join task should get at most.
    salt_rows: int = SALT_ROWS
    #: Raise if ``id_col`` repeats a value (one aggregate over that column alone, before
    #: the plan is built); rules over several rows would mix up the listings.
    check_ids: bool = True
    #: Parts in which references to texts meet their evidence, as texts make the rows of a part
    #: wide; None leaves it to Spark, which knows the references only.
    join_parts: int | None = None


def score_listings(
    df: DataFrame,
    cfg: RiskConfig,
    references: References = References(),
    id_col: str | None = None,
    options: Options = Options(),
    texts: Texts | None = None,
    shown: Sequence[str] | None = None,
) -> DataFrame:
    """The input table with score, tier, flags, details and duplicate reference appended.

    ``id_col`` must be unique and orderable. Without it the table is materialized once
    and a contiguous ``row_id`` is appended as well. With ``texts``, one column of the input holds
    references to them; the result is that of a table with the texts themselves. ``shown`` names the
    input columns of the result, in its order; None means all.
    """
    appended = OUTPUT_COLUMNS if id_col else (ROW_ID, *OUTPUT_COLUMNS)
    clash = {name.lower() for name in df.columns} & set(appended)
    if clash:
        raise ValueError(f"Input already has output columns: {sorted(clash)}")
    listings = Listings.of(df, id_col, texts)
    _require_one_text(listings)
    headers = listings.headers if shown is None else tuple(shown)
    planned, evaluated = _evaluate(
        listings, cfg, references, options, extra=("copy",),
        texts_last=texts is not None and texts.column in headers)
    fired = [F.col(_mark(rule)) for rule in planned]
    score = sum(
        (F.when(mark, F.lit(rule.weight)).otherwise(0)
         for mark, rule in zip(fired, planned)), F.lit(0),
    )
    flags = [F.when(mark, F.lit(rule.flag)) for mark, rule in zip(fired, planned)]
    details = [
        F.when(mark, F.concat(F.lit(f"{rule.flag}: "), F.col(_detail(rule))))
        for mark, rule in zip(fired, planned)
    ]
    first = F.col("copy_first")
    original = F.when((F.col("copy_n") > 1) & (first != F.col(ROW_ID)), first.cast("string"))
    scored = evaluated.select(
        *listings.input_columns(headers),
        *([] if id_col else [F.col(ROW_ID)]),
        score.alias("spam_score"),
        F.concat_ws(", ", *flags).alias("flags_triggered"),
        F.concat_ws(" | ", *details).alias("flag_details"),
        F.coalesce(original, F.lit("")).alias("is_duplicate_of_row"),
    ).withColumn("risk_tier", risk_tier(F.col("spam_score"), cfg.score_thresholds))
    kept = scored.columns[:len(headers)]
    ordered = scored.select(*kept, *appended)
    return ordered.toDF(*headers, *appended)


def flag_table(
    df: DataFrame,
    cfg: RiskConfig,
    references: References = References(),
    id_col: str | None = None,
    options: Options = Options(),
    flags: Iterable[str] | None = None,
    texts: Texts | None = None,
) -> DataFrame:
    """One row per listing and fired flag: ``row_id, ord, flag, weight, detail``.

    With ``flags``, only those rules are planned, with just the joins they need. Flags that
    need no other row come straight from the scan; the others from the rows with evidence.
    """
    listings = Listings.of(df, id_col, texts)
    _require_one_text(listings)
    wanted = rules.FLAGS if flags is None else tuple(flags)
    over_groups = {rule.flag for rule in rules.CATALOG if _over_groups(rule)}
    parts = []
    for chosen in ([f for f in wanted if f not in over_groups],
                   [f for f in wanted if f in over_groups]):
        planned, evaluated = _evaluate(listings, cfg, references, options, flags=chosen)
        if planned:
            parts.append(_fired_flags(planned, evaluated))
    if not parts:
        schema = "array<struct<ord:int,flag:string,weight:int,detail:string>>"
        return listings.table.select(ROW_ID, F.inline(F.array().cast(schema)))
    return reduce(DataFrame.unionByName, parts)


def _fired_flags(planned: Sequence[rules.PlannedRule], evaluated: DataFrame) -> DataFrame:
    entries = {
        f"entry_{rule.order}": F.when(F.col(_mark(rule)), F.struct(
            F.lit(rule.order).alias("ord"),
            F.lit(rule.flag).alias("flag"),
            F.lit(rule.weight).alias("weight"),
            F.col(_detail(rule)).alias("detail"),
        ))
        for rule in planned
    }
    # Entries are computed in a projection of their own, where they are compiled. And the
    # generated flag is filtered, not the predicates: those would be pushed down to the
    # scan, and every costly expression evaluated a second time.
    computed = evaluated.select(ROW_ID, *[entry.alias(name) for name, entry in entries.items()])
    return computed.select(ROW_ID, F.inline(F.array(*entries))).filter(
        F.col("flag").isNotNull()
    )


def risk_tier(score: Column, thresholds: TierThresholds) -> Column:
    high, likely, review, clean = TIERS
    return (
        F.when(score >= thresholds.high_confidence_spam, high)
        .when(score >= thresholds.likely_spam, likely)
        .when(score >= thresholds.review, review)
        .otherwise(clean)
    )


def prepared_listings(
    listings: Listings, cfg: RiskConfig, references: References, needs: Iterable[str],
    full_nfkd: bool = False, joined: DataFrame | None = None,
) -> DataFrame:
    """Listings with canonical fields, derived values, and the domains that are needed.

    ``joined`` is the table of the listings with more columns, if it is not their table itself.
    """
    needs = set(needs)
    table = listings.with_texts(listings.table if joined is None else joined)
    prepared = derive(table.select(*clean_fields(listings, table.columns)), cfg, full_nfkd)
    if "batch" in needs:
        prepared = prepared.withColumns(batch_columns(listings))
    hosts = {}
    if "site_domain" in needs:
        hosts["site_domain"] = F.col("host")
    if "landing_domain" in needs:
        hosts["landing_domain"] = F.col("landing_host")
    if hosts:
        prepared = with_registrable_domains(prepared, hosts, references.suffixes)
    return prepared


def _mark(rule: rules.PlannedRule) -> str:
    return f"fires_{rule.order}"


def _detail(rule: rules.PlannedRule) -> str:
    return f"detail_{rule.order}"


def _over_groups(rule: rules.Rule | rules.PlannedRule) -> bool:
    return bool(set(rule.needs) & set(GROUP_NEEDS))


def _require_unique(table: DataFrame) -> None:
    if not table.groupBy(ROW_ID).count().filter("count > 1").isEmpty():
        raise ValueError("id_col repeats a value")


def _require_one_text(listings: Listings) -> None:
    if listings.texts is None:
        return
    refers, texts = listings.referring_texts()
    several = texts.groupBy("text_key").count().filter("count > 1")
    if not listings.table.join(several, refers, "left_semi").isEmpty():
        raise ValueError("a listing refers to several texts")


def _evaluate(
    listings: Listings,
    cfg: RiskConfig,
    references: References,
    options: Options,
    flags: Iterable[str] | None = None,
    extra: Sequence[str] = (),
    texts_last: bool = False,
) -> tuple[list[rules.PlannedRule], DataFrame]:
    """Planned rules, and the listings with the mark and the evidence text of each rule.

    Texts of rules that need no other row are made before the join and carried across it, if
    the output asks for them. With ``texts_last``, texts come in behind the join, and all is judged
    there.
    """
    available = set(GROUP_NEEDS) - {"rdi"}
    if references.suffixes is not None:
        available |= {"site_domain", "landing_domain"}
    for name in ("zip_dim", "area_code_dim", "rdi"):
        if getattr(references, name) is not None:
            available.add(name)
    planned = rules.plan_rules(cfg, listings, available, flags)
    needs = {need for rule in planned for need in rule.needs} | set(extra)

    if "domain" in needs:
        needs.add("site_domain")
    chosen = {rule.flag for rule in planned}
    local = [rule for rule in planned if not _over_groups(rule)]

    def with_local_marks(rows: DataFrame) -> DataFrame:
        if "zip_dim" in needs:
            rows = with_zip_state(rows, F.col("zip5"), references.zip_dim, "zip_state")
        if "area_code_dim" in needs:
            key = F.when(F.col("dialable"), F.col("area_code"))
            rows = with_area_region(rows, key, references.area_code_dim, "area_region")
        if "DESCRIPTION_KEYWORD_STUFFED" in chosen:
            rows = rows.withColumn("description_hits", rules.description_hits(cfg))
        if "KEYWORD_FIELD_STUFFED" in chosen:
            rows = rows.withColumn("keyword_terms", rules.keyword_terms(cfg, options.full_nfkd))
        return rows.withColumns({_mark(rule): rule.fires for rule in local})

    def with_details(rows: DataFrame, judged: Iterable[rules.PlannedRule]) -> DataFrame:
        return rows.withColumns(
            {_detail(rule): F.when(F.col(_mark(rule)), rule.detail) for rule in judged})

    def prepared_of(listings: Listings, joined: DataFrame | None = None) -> DataFrame:
        return prepared_listings(listings, cfg, references, needs, options.full_nfkd, joined)

    prepared = prepared_of(listings)
    group_needs = needs & set(GROUP_NEEDS)
    if not group_needs:
        return planned, with_details(with_local_marks(prepared), local)
    if listings.given_ids and options.check_ids and not listings.table.isStreaming:
        _require_unique(listings.table)
    apart, keyed = {}, prepared
    if listings.texts is not None:
        if "copy" in group_needs:
            apart["copy"] = copy_keys(listings, options.compare_cols)
        if not listings.text_fields() & GROUP_FIELDS:
            keyed = prepared_of(listings.without_texts())
    evidence = group_evidence(
        keyed,
        group_kinds(cfg, listings, group_needs, options.compare_cols),
        apart=apart,
        known={"rdi": residential_keys(references.rdi)} if "rdi" in needs else None,
        first_name=F.col("name_key"),
        row_id=ROW_ID,
        salt_rows=options.salt_rows,
    )
    shared = [rule for rule in planned if _over_groups(rule)]
    # Where only groups can fire, rows without evidence need not be read on.
    how = "left" if local or extra else "inner"
    if texts_last:
        dealt = listings.table
        if options.join_parts is not None:
            dealt = dealt.repartition(options.join_parts, ROW_ID)
        rows = with_local_marks(prepared_of(listings, dealt.join(evidence, ROW_ID, how)))
        rows = rows.withColumns({_mark(rule): rule.fires for rule in shared})
        return planned, with_details(rows, planned)
    rows = with_local_marks(prepared if local or extra else keyed)
    if local:
        bits = sum((F.when(F.col(_mark(rule)), F.lit(1 << at)).otherwise(0)
                    for at, rule in enumerate(local)), F.lit(0).cast("long"))
        rows = with_details(rows.withColumn("local_bits", bits), local)
    rows = rows.join(evidence, ROW_ID, how)
    marks = {_mark(rule): F.col("local_bits").bitwiseAND(F.lit(1 << at)) != 0
             for at, rule in enumerate(local)}
    rows = rows.withColumns(marks | {_mark(rule): rule.fires for rule in shared})
    return planned, with_details(rows, shared)
