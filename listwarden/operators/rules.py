"""The catalog of risk rules, in output order.

A rule is a predicate and an evidence text over prepared columns. Rules that are
disabled, or whose input columns are absent, never enter the plan.

Fixed values: flags, keys and evidence texts are output, and have to be as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from listwarden.config import RiskConfig
from listwarden.fields import HOURS_FIELDS, SOCIAL_FIELDS
from listwarden.functions import text
from listwarden.operators.prepare import Listings

Outcome = tuple[Column, Column]

MIN_SHARED = 2  # domains, e-mails, owners: two rows already share
MIN_DESCRIPTION = 20


@dataclass(frozen=True)
class Rule:
    flag: str
    weight_key: str
    #: Key that switches the rule off; None for rules that cannot be switched off.
    disable_key: str | None
    #: Predicate and evidence, or None if the settings leave nothing to look for.
    build: Callable[[RiskConfig], Outcome | None]
    #: At least one of these fields must be in the table.
    gate: tuple[str, ...] = ()
    #: Enrichment the rule reads: a domain, a reference table or a group kind.
    needs: tuple[str, ...] = ()

    def active(self, cfg: RiskConfig, listings: Listings) -> bool:
        enabled = self.disable_key is None or self.disable_key not in cfg.disabled_rules
        return enabled and (not self.gate or listings.has(*self.gate))


@dataclass(frozen=True)
class PlannedRule:
    order: int
    flag: str
    weight: int
    fires: Column
    detail: Column
    needs: tuple[str, ...]


def plan_rules(
    cfg: RiskConfig,
    listings: Listings,
    available: Iterable[str],
    flags: Iterable[str] | None = None,
) -> list[PlannedRule]:
    """The rules that apply to this table, with their catalog position and weight."""
    available = set(available)
    wanted = None if flags is None else set(flags)
    if wanted is not None and (unknown := wanted - set(FLAGS)):
        raise ValueError(f"Unknown flags: {sorted(unknown)}")
    planned = []
    for order, rule in enumerate(CATALOG, start=1):
        if wanted is not None and rule.flag not in wanted:
            continue
        if not rule.active(cfg, listings) or not available.issuperset(rule.needs):
            continue
        outcome = rule.build(cfg)
        if outcome is not None:
            fires, detail = outcome
            planned.append(PlannedRule(
                order, rule.flag, int(cfg.weights[rule.weight_key]),
                F.coalesce(fires, F.lit(False)), detail, rule.needs,
            ))
    return planned


def _say(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(part) if isinstance(part, str) else part for part in parts])


def _present(name: str) -> Column:
    return F.col(name) != ""


# --- names and industry -----------------------------------------------------------

def _high_risk_industry(cfg: RiskConfig) -> Outcome:
    pattern = text.any_of(cfg.high_risk_industries)
    first = F.regexp_extract("risk_text", pattern, 0)
    return F.col("high_risk"), _say("Matched industry keyword: '", first, "'")


def _generic_name(cfg: RiskConfig) -> Outcome | None:
    pattern = text.any_of(cfg.spam_name_keywords)
    if not pattern:
        return None
    found = F.regexp_extract_all("name_lower", F.lit(pattern), 0)
    return F.col("name_lower").rlike(pattern), _say("Spam keywords in name: ",
                                                    text.list_text(found))


def _keyword_stuffed_name(cfg: RiskConfig) -> Outcome | None:
    pattern = text.any_of(cfg.high_risk_industries)
    if not pattern:
        return None
    found = F.regexp_extract_all("name_lower", F.lit(pattern), 0)
    count = F.regexp_count("name_lower", F.lit(pattern))
    return count >= 2, _say("Multiple industry keywords in name: ", text.list_text(found))


def _near_duplicate_name(cfg: RiskConfig) -> Outcome:
    match = F.col("name_match")
    first = _say("Near-duplicate name; shares fingerprint with ",
                 (match.n - 1).cast("string"), " other row(s) in this batch")
    other = _say("Near-duplicate name with row ", match.first_id.cast("string"),
                 ": '", match.first_name, "'")
    is_first = match.first_id == F.col("row_id")
    return match.isNotNull(), F.when(is_first, first).otherwise(other)


def _same_owner(cfg: RiskConfig) -> Outcome:
    fires = (F.col("owner_n") >= MIN_SHARED) & _present("industry")
    return fires, _say("Owner '", F.col("owner_norm"), "' appears across ",
                       F.col("owner_n").cast("string"), " businesses")


# --- addresses --------------------------------------------------------------------

def _po_box(cfg: RiskConfig) -> Outcome:
    gap = r"[\s\p{Z}]*"
    pattern = text.whole_word(rf"P\.?{gap}O\.?{gap}BOX")
    return F.col("address_upper").rlike(pattern), F.lit("Address is a PO Box")


def _virtual_mailbox(cfg: RiskConfig) -> Outcome | None:
    pattern = text.any_of(word.upper() for word in cfg.virtual_mailbox_keywords)
    if not pattern:
        return None
    first = F.regexp_extract("address_upper", pattern, 0)
    return F.col("address_upper").rlike(pattern), _say(
        "Address matches virtual mailbox provider: '", first, "'")


def _shared_address(cfg: RiskConfig) -> Outcome:
    limit = cfg.shared_address_threshold
    return F.col("address_n") >= limit, _say(
        "Address shared by ", F.col("address_n").cast("string"),
        f" businesses (threshold: {limit})")


def _state_zip_mismatch(cfg: RiskConfig) -> Outcome:
    state, expected = F.upper("state"), F.col("zip_state")
    fires = (state != "") & _present("zip5") & (expected != "") & (expected != state)
    return fires, _say("ZIP ", F.col("zip5"), " belongs to ", expected, ", not ", state)


def _address_hidden(cfg: RiskConfig) -> Outcome:
    hidden = F.lower("address_hidden").isin("true", "yes", "1", "y")
    return hidden & F.col("high_risk"), F.lit(
        "Address is marked hidden for a high-risk industry business")


def _service_area_no_address(cfg: RiskConfig) -> Outcome:
    fires = _present("service_area") & (F.col("address") == "")
    return fires, _say("Service area '", F.substring("service_area", 1, 60),
                       "' set but no street address provided")


def _residential_address(cfg: RiskConfig) -> Outcome:
    # Only addresses of high-risk rows are keys of this group kind.
    return F.col("rdi_n").isNotNull(), F.lit(
        "Address classified as Residential by SmartyStreets (RDI check)")


# --- phones -----------------------------------------------------------------------

def _invalid_phone(cfg: RiskConfig) -> Outcome:
    return _present("phone") & ~F.col("dialable"), _say(
        "Phone '", F.col("phone"), "' has unexpected digit count (",
        F.length("digits").cast("string"), ")")


def _tollfree_phone(cfg: RiskConfig) -> Outcome:
    fires = F.col("dialable") & F.col("area_code").isin(*cfg.toll_free_prefixes)
    return fires, _say("Toll-free area code: ", F.col("area_code"))


def _shared_phone(cfg: RiskConfig) -> Outcome:
    limit = cfg.shared_phone_threshold
    return F.col("phone_n") >= limit, _say(
        "Phone shared by ", F.col("phone_n").cast("string"),
        f" businesses (threshold: {limit})")


def _area_code_mismatch(cfg: RiskConfig) -> Outcome:
    region, state, city = F.col("area_region"), F.upper("state"), F.upper("city")
    named = ((state != "") & F.contains(region, state)) | ((city != "") & F.contains(region, city))
    return F.col("dialable") & (region != "") & ~named, _say(
        "Area code ", F.col("area_code"), " region '", region,
        "' may not match state ", state)


# --- websites and e-mail ------------------------------------------------------------

def _no_website(cfg: RiskConfig) -> Outcome:
    return (F.col("website") == "") & F.col("high_risk"), F.lit(
        "No website provided for a high-risk industry business")


def _generic_builder_site(cfg: RiskConfig) -> Outcome | None:
    pattern = text.any_of(cfg.generic_website_builders)
    if not pattern:
        return None
    return F.col("host").rlike(pattern), _say("Website is on a generic builder: ", F.col("host"))


def _lead_gen_domain(cfg: RiskConfig) -> Outcome | None:
    pattern = text.any_of(cfg.lead_gen_domains)
    if not pattern:
        return None
    return F.col("host").rlike(pattern), _say("Website is a lead-gen directory: ", F.col("host"))


def _shared_domain(cfg: RiskConfig) -> Outcome:
    return F.col("domain_n") >= MIN_SHARED, _say(
        "Website domain '", F.col("site_domain"), "' shared by ",
        F.col("domain_n").cast("string"), " businesses")


def _domain_name_mismatch(cfg: RiskConfig) -> Outcome:
    domain = F.col("site_domain")
    words = F.filter(F.split("name_norm", " "), lambda word: F.length(word) > 3)
    unrelated = (F.size(words) > 0) & ~F.exists(words, lambda word: F.contains(domain, word))
    return _present("site_domain") & unrelated, _say(
        "Domain '", domain, "' shares no words with business name")


def _free_email(cfg: RiskConfig) -> Outcome:
    return F.col("email_domain").isin(*cfg.free_email_domains) & _present("email"), _say(
        "Email uses free provider: ", F.col("email_domain"))


def _autogenerated_email(cfg: RiskConfig) -> Outcome:
    local = F.col("email_local")
    mostly_digits = F.regexp_count(local, F.lit(r"\p{Nd}")) * 2 > F.length(local)
    long_run = (F.length(local) > 8) & local.rlike(r"\p{Nd}{4}")
    return mostly_digits | long_run, _say("Email local part appears auto-generated: ", local)


def _shared_email(cfg: RiskConfig) -> Outcome:
    return F.col("email_n") >= MIN_SHARED, _say(
        "Email shared by ", F.col("email_n").cast("string"), " businesses")


def _email_domain_mismatch(cfg: RiskConfig) -> Outcome:
    mail, site = F.col("email_domain"), F.col("site_domain")
    fires = (mail != "") & (site != "") & ~mail.isin(*cfg.free_email_domains) & (mail != site)
    return fires, _say("Email domain '", mail, "' differs from website '", site, "'")


def _landing_page_mismatch(cfg: RiskConfig) -> Outcome:
    landing, site = F.col("landing_domain"), F.col("site_domain")
    return (landing != "") & (site != "") & (landing != site), _say(
        "Landing page domain '", landing, "' differs from website domain '", site, "'")


# --- duplicates and bursts ----------------------------------------------------------

def _exact_duplicate(cfg: RiskConfig) -> Outcome:
    first = _say("This row has ", (F.col("copy_n") - 1).cast("string"), " exact duplicate(s)")
    other = _say("Exact duplicate of row ", F.col("copy_first").cast("string"))
    is_first = F.col("copy_first") == F.col("row_id")
    return F.col("copy_n") > 1, F.when(is_first, first).otherwise(other)


def _batch_submission(cfg: RiskConfig) -> Outcome:
    limit = cfg.batch_submission_threshold
    return F.col("batch_n") >= limit, _say(
        "Reseller '", F.col("batch_reseller"), "' submitted ", F.col("batch_n").cast("string"),
        " listings on ", F.col("batch_date"), f" (threshold: {limit})")


# --- profile completeness -----------------------------------------------------------

def _no_photos(cfg: RiskConfig) -> Outcome:
    return F.col("photo_gallery") == "", F.lit("Photo Gallery URL is blank")


def _no_social(cfg: RiskConfig) -> Outcome:
    return F.col("no_social"), F.lit("All social media fields (X, Facebook, Instagram) are blank")


def _year() -> Column:
    return F.regexp_extract("year_established", r"([0-9]{4})", 1).try_cast("int")


def _year_missing(cfg: RiskConfig) -> Outcome:
    return F.col("year_established") == "", F.lit("Year Established is blank")


def _year_invalid(cfg: RiskConfig) -> Outcome:
    return _present("year_established") & _year().isNull(), _say(
        "Year Established could not be parsed: '", F.col("year_established"), "'")


def _recently_established(cfg: RiskConfig) -> Outcome:
    today = cfg.reference_date
    months = (F.lit(today.year) - _year()) * 12 + today.month
    return months <= 12, _say(
        "Business established within last 12 months (year: ", _year().cast("string"), ")")


def _no_hours(cfg: RiskConfig) -> Outcome:
    return F.col("no_hours"), F.lit("All business hours fields are blank")


def _description_missing(cfg: RiskConfig) -> Outcome:
    return F.col("any_description") == "", F.lit("Description is blank")


def _description_size() -> Column:
    """Characters of a description, as far as ``MIN_DESCRIPTION``: long ones are not counted through."""
    return F.length(F.substring("any_description", 1, MIN_DESCRIPTION))


def _description_too_short(cfg: RiskConfig) -> Outcome:
    size = _description_size()
    return (size > 0) & (size < MIN_DESCRIPTION), _say(
        "Description is under 20 characters (", size.cast("string"), " chars)")


def description_hits(cfg: RiskConfig) -> Column:
    """Repeated city and service words of a description, in catalog order."""
    services = [word for word in cfg.high_risk_industries if len(word) > 3]
    none = F.array().cast("array<string>")
    city = F.lower("city")

    def hits(body: Column) -> Column:
        # Most cities are absent, and looking for one is cheaper than counting it.
        count = F.when((city != "") & F.contains(body, city), text.count_substring(body, city))
        city_hit = F.when(
            count >= 3, F.array(_say("city '", city, "' ×", count.cast("string")))
        ).otherwise(none)
        return F.concat(city_hit, text.repeated_words(body, services, 2))

    return F.when(
        _description_size() >= MIN_DESCRIPTION,
        text.let(F.lower("any_description"), hits),
    ).otherwise(none)


def _description_stuffed(cfg: RiskConfig) -> Outcome:
    hits = F.col("description_hits")
    return F.size(hits) >= 3, _say("Description contains repeated city/service keywords: ",
                                   text.list_text(F.slice(hits, 1, 5)))


def keyword_terms(cfg: RiskConfig, full_nfkd: bool = False) -> Column:
    """Of a keywords field with four or more entries: service entries, repeated words."""
    pattern = text.any_of(cfg.high_risk_industries)

    def summary(entries: Column) -> Column:
        service = F.filter(entries, lambda entry: entry.rlike(pattern)) if pattern else F.array()
        words = F.filter(
            F.split(F.array_join(entries, " "), " +"), lambda word: F.length(word) > 3
        )
        return F.struct(
            F.size(service).alias("services"),
            text.let(words, _most_repeated).alias("repeated"),
        )

    entries = F.transform("keyword_entries", lambda entry: text.normalize_text(entry, full_nfkd))
    return F.when(F.size("keyword_entries") >= 4, text.let(entries, summary))


def _most_repeated(words: Column) -> Column:
    """The three most frequent words of those that occur three times, ties by first seen.

    Words are sorted together with their positions. Equal words then form runs: a run starts
    with the first position of its word, and its length is the distance to the next start.
    """
    def runs(ordered: Column) -> Column:
        def ranked(starts: Column) -> Column:
            return F.transform(starts, lambda start, number: F.struct(
                (start["at"] - F.coalesce(F.get(starts, number + 1)["at"], F.size(ordered)))
                .alias("rank"),
                start["position"].alias("position"),
                start["word"].alias("word"),
            ))

        marked = F.transform(ordered, lambda entry, at: F.when(
            ~entry["word"].eqNullSafe(F.get(ordered, at - 1)["word"]),
            F.struct(at.alias("at"), entry["position"].alias("position"),
                     entry["word"].alias("word")),
        ))
        return text.let(F.filter(marked, lambda start: start.isNotNull()), ranked)

    placed = F.transform(
        words, lambda word, at: F.struct(word.alias("word"), at.alias("position")))
    counted = text.let(F.sort_array(placed), runs)
    return F.slice(F.sort_array(F.filter(counted, lambda run: run["rank"] <= -3)), 1, 3)


def _keyword_field_stuffed(cfg: RiskConfig) -> Outcome:
    terms = F.col("keyword_terms")
    many = terms.services >= 4
    repeats = F.size(terms.repeated) > 0
    counts = F.array_join(
        F.transform(terms.repeated, lambda term: _say(
            text.quoted(term.word), ": ", (-term["rank"]).cast("string"))), ", ")
    reasons = F.concat_ws(
        "; ",
        F.when(many, _say(terms.services.cast("string"), " service-type keywords")),
        F.when(repeats, _say("repeated terms: {", counts, "}")),
    )
    return many | repeats, _say(
        "Keywords field has ", F.size("keyword_entries").cast("string"), " entries — ", reasons)


CATALOG: tuple[Rule, ...] = (
    Rule("HIGH_RISK_INDUSTRY", "high_risk_industry", "high_risk_industry", _high_risk_industry),
    Rule("GENERIC_NAME_KEYWORD", "generic_name", "generic_name", _generic_name),
    Rule("KEYWORD_STUFFED_NAME", "keyword_stuffed_name", "keyword_stuffed_name",
         _keyword_stuffed_name),
    Rule("PO_BOX", "po_box", "po_box", _po_box),
    Rule("VIRTUAL_MAILBOX", "virtual_mailbox", "virtual_mailbox", _virtual_mailbox),
    Rule("SHARED_ADDRESS", "shared_address", "shared_address", _shared_address,
         needs=("address",)),
    Rule("STATE_ZIP_MISMATCH", "state_zip_mismatch", "state_zip_mismatch",
         _state_zip_mismatch, needs=("zip_dim",)),
    Rule("INVALID_PHONE", "invalid_phone", "invalid_phone", _invalid_phone),
    Rule("TOLLFREE_PHONE", "voip_tollfree_phone", "voip_tollfree_phone", _tollfree_phone),
    Rule("SHARED_PHONE", "shared_phone", "shared_phone", _shared_phone, needs=("phone",)),
    Rule("AREA_CODE_MISMATCH", "area_code_mismatch", "area_code_mismatch",
         _area_code_mismatch, needs=("area_code_dim",)),
    Rule("NO_WEBSITE", "no_website", "no_website", _no_website),
    Rule("GENERIC_BUILDER_SITE", "generic_builder_site", "generic_builder_site",
         _generic_builder_site),
    Rule("LEAD_GEN_DOMAIN", "shared_domain", None, _lead_gen_domain),
    Rule("SHARED_DOMAIN", "shared_domain", "shared_domain", _shared_domain,
         needs=("site_domain", "domain")),
    Rule("DOMAIN_NAME_MISMATCH", "new_domain", None, _domain_name_mismatch,
         needs=("site_domain",)),
    Rule("FREE_EMAIL_PROVIDER", "free_email", "free_email", _free_email),
    Rule("AUTOGENERATED_EMAIL", "autogenerated_email", "autogenerated_email",
         _autogenerated_email),
    Rule("SHARED_EMAIL", "shared_email", "shared_email", _shared_email, needs=("email",)),
    Rule("EMAIL_DOMAIN_MISMATCH", "email_domain_mismatch", "email_domain_mismatch",
         _email_domain_mismatch, needs=("site_domain",)),
    Rule("EXACT_DUPLICATE", "exact_duplicate_row", "exact_duplicate_row", _exact_duplicate,
         needs=("copy",)),
    Rule("NEAR_DUPLICATE_NAME", "near_duplicate_name", "near_duplicate_name",
         _near_duplicate_name, needs=("near_name",)),
    Rule("SAME_OWNER_MULTI_BIZ", "same_owner_multi_biz", "same_owner_multi_biz", _same_owner,
         gate=("owner_name",), needs=("owner",)),
    Rule("BATCH_SUBMISSION", "batch_submission", "batch_submission", _batch_submission,
         gate=("date_added",), needs=("batch",)),
    Rule("NO_PHOTOS", "no_photos", "no_photos", _no_photos, gate=("photo_gallery",)),
    Rule("NO_SOCIAL_PRESENCE", "no_social", "no_social", _no_social, gate=SOCIAL_FIELDS),
    Rule("YEAR_ESTABLISHED_MISSING", "year_established", "year_established", _year_missing,
         gate=("year_established",)),
    Rule("YEAR_ESTABLISHED_INVALID", "year_established", "year_established", _year_invalid,
         gate=("year_established",)),
    Rule("RECENTLY_ESTABLISHED", "year_established", "year_established",
         _recently_established, gate=("year_established",)),
    Rule("NO_HOURS_PROVIDED", "no_hours", "no_hours", _no_hours, gate=HOURS_FIELDS),
    Rule("DESCRIPTION_MISSING", "description_missing", "description_quality",
         _description_missing, gate=("description", "descrp")),
    Rule("DESCRIPTION_TOO_SHORT", "description_missing", "description_quality",
         _description_too_short, gate=("description", "descrp")),
    Rule("DESCRIPTION_KEYWORD_STUFFED", "description_stuffed", "description_quality",
         _description_stuffed, gate=("description", "descrp")),
    Rule("ADDRESS_HIDDEN_HIGH_RISK", "address_hidden", "address_hidden", _address_hidden,
         gate=("address_hidden",)),
    Rule("SERVICE_AREA_NO_ADDRESS", "service_area_no_address", "service_area_no_address",
         _service_area_no_address, gate=("service_area",)),
    Rule("KEYWORD_FIELD_STUFFED", "keyword_field_stuffed", "keyword_field_stuffed",
         _keyword_field_stuffed, gate=("keywords",)),
    Rule("LANDING_PAGE_DOMAIN_MISMATCH", "landing_page_domain_mismatch",
         "landing_page_domain_mismatch", _landing_page_mismatch,
         gate=("landing_page_url",), needs=("site_domain", "landing_domain")),
    Rule("RESIDENTIAL_ADDRESS", "residential_address", "residential_address",
         _residential_address, needs=("rdi",)),
)

FLAGS = tuple(rule.flag for rule in CATALOG)
