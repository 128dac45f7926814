"""Rule settings: keyword lists, thresholds, weights and disabled rules."""

from __future__ import annotations

import dataclasses
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from datetime import date

# The stock keyword lists, thresholds and weights. Scores and
# tiers only agree with existing reports when these stay as they are.
_HIGH_RISK_TEMPLATE = (
    "locksmith", "towing", "roadside assistance", "plumber", "plumbing", "hvac",
    "air conditioning", "heating", "garage door", "pest control", "exterminator",
    "electrician", "water damage", "water damage restoration", "fire damage",
    "fire damage restoration", "mold", "mold remediation", "restoration",
    "emergency ac", "emergency plumbing", "appliance repair", "roofing", "roofer",
)
_HIGH_RISK_DEFAULT = (
    "locksmith", "towing", "roadside assistance", "plumber", "plumbing", "hvac",
    "air conditioning", "heating", "garage door", "garage door supplier",
    "chimney sweep", "air duct cleaning", "repair service", "hvac contractor",
    "paving contractor", "general contractor", "air conditioner repair service",
    "carpet cleaning service", "pest control", "exterminator", "electrician",
    "water damage", "water damage restoration", "fire damage",
    "fire damage restoration", "mold", "mold remediation", "restoration",
    "emergency ac", "emergency plumbing", "appliance repair", "roofing", "roofer",
)
_NAME_KEYWORDS = (
    "best", "top rated", "top-rated", "affordable", "fast", "quick", "24/7", "24hr",
    "24 hour", "pro", "expert", "local", "reliable", "emergency", "same day",
    "same-day", "licensed", "certified", "trusted", "quality", "professional",
)
_MAILBOX_KEYWORDS = (
    "The UPS Store", "UPS Store", "FedEx Office", "FedEx", "Regus", "WeWork",
    "iPostal", "Anytime Mailbox", "Postal Connections", "PostNet",
    "The Mail Center", "Mailboxes Etc",
)
_FREE_EMAIL = (
    "gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "aol.com", "icloud.com",
    "mail.com", "protonmail.com", "ymail.com", "live.com",
)
_TOLL_FREE = ("800", "888", "877", "866", "855", "844", "833")
_BUILDERS = (
    "wix.com", "weebly.com", "squarespace.com", "wordpress.com", "godaddysites.com",
    "site123.me", "webnode.com", "jimdo.com", "yolasite.com",
)
_LEAD_GEN = (
    "angieslist.com", "homeadvisor.com", "thumbtack.com", "bark.com", "porch.com",
    "networx.com", "improvenet.com", "houzz.com",
)
_WEIGHTS = {
    "high_risk_industry": 2, "generic_name": 3, "keyword_stuffed_name": 3,
    "duplicate_name": 5, "near_duplicate_name": 3, "virtual_mailbox": 4, "po_box": 4,
    "shared_address": 2, "state_zip_mismatch": 3, "voip_tollfree_phone": 2,
    "shared_phone": 4, "area_code_mismatch": 3, "invalid_phone": 2, "no_website": 3,
    "new_domain": 2, "shared_domain": 3, "generic_builder_site": 1, "free_email": 1,
    "shared_email": 4, "email_domain_mismatch": 2, "autogenerated_email": 2,
    "exact_duplicate_row": 5, "cluster_detected": 3, "batch_submission": 3,
    "same_owner_multi_biz": 3, "no_photos": 3, "no_social": 2, "year_established": 3,
    "no_hours": 2, "description_missing": 2, "description_stuffed": 3,
    "address_hidden": 4, "service_area_no_address": 3, "keyword_field_stuffed": 3,
    "landing_page_domain_mismatch": 2, "residential_address": 4,
}


@dataclass(frozen=True)
class TierThresholds:
    """Lowest score of each tier; they are tried from the top and need no order."""

    review: int
    likely_spam: int
    high_confidence_spam: int


@dataclass(frozen=True)
class RiskConfig:
    """Everything a run can be tuned with. Immutable; use :meth:`replace` to vary it."""

    high_risk_industries: tuple[str, ...]
    spam_name_keywords: tuple[str, ...]
    virtual_mailbox_keywords: tuple[str, ...]
    free_email_domains: tuple[str, ...]
    toll_free_prefixes: tuple[str, ...]
    generic_website_builders: tuple[str, ...]
    lead_gen_domains: tuple[str, ...]
    shared_address_threshold: int
    shared_phone_threshold: int
    batch_submission_threshold: int
    score_thresholds: TierThresholds
    weights: Mapping[str, int] = field(hash=False)
    disabled_rules: frozenset[str] = frozenset()
    #: Date that "recently established" is measured from; None means today.
    as_of: date | None = None

    @classmethod
    def from_dict(cls, settings: Mapping) -> RiskConfig:
        """Build from a nested mapping; a missing required key raises ``KeyError``."""
        tiers = settings["score_thresholds"]
        return cls(
            high_risk_industries=_words(settings["high_risk_industries"], lower=True),
            spam_name_keywords=_words(settings["spam_name_keywords"], lower=True),
            virtual_mailbox_keywords=_words(settings["virtual_mailbox_keywords"]),
            free_email_domains=_words(settings["free_email_domains"]),
            toll_free_prefixes=_words(settings["toll_free_prefixes"]),
            generic_website_builders=_words(settings["generic_website_builders"]),
            lead_gen_domains=_words(settings["lead_gen_domains"]),
            shared_address_threshold=int(settings["shared_address_threshold"]),
            shared_phone_threshold=int(settings["shared_phone_threshold"]),
            batch_submission_threshold=int(settings["batch_submission_threshold"]),
            score_thresholds=TierThresholds(
                review=int(tiers["review"]),
                likely_spam=int(tiers["likely_spam"]),
                high_confidence_spam=int(tiers["high_confidence_spam"]),
            ),
            weights={key: int(value) for key, value in settings["weights"].items()},
            disabled_rules=frozenset(settings.get("disabled_rules") or ()),
            as_of=settings.get("as_of"),
        )

    def to_dict(self) -> dict:
        return dataclasses.asdict(self)

    def replace(self, **overrides) -> RiskConfig:
        """A copy with some settings replaced, each as a whole; the rest is kept."""
        settings = self.to_dict()
        unknown = set(overrides) - set(settings)
        if unknown:
            raise TypeError(f"Unknown settings: {sorted(unknown)}")
        settings.update(overrides)
        if isinstance(settings["score_thresholds"], TierThresholds):
            settings["score_thresholds"] = dataclasses.asdict(settings["score_thresholds"])
        return RiskConfig.from_dict(settings)

    @property
    def reference_date(self) -> date:
        return self.as_of or date.today()


def _words(values: Iterable, lower: bool = False) -> tuple[str, ...]:
    words = [str(value) for value in values or ()]
    return tuple(word.lower() if lower else word for word in words if word)


def _stock(high_risk: tuple[str, ...], tiers: TierThresholds) -> RiskConfig:
    return RiskConfig(
        high_risk_industries=high_risk,
        spam_name_keywords=_NAME_KEYWORDS,
        virtual_mailbox_keywords=_MAILBOX_KEYWORDS,
        free_email_domains=_FREE_EMAIL,
        toll_free_prefixes=_TOLL_FREE,
        generic_website_builders=_BUILDERS,
        lead_gen_domains=_LEAD_GEN,
        shared_address_threshold=3,
        shared_phone_threshold=2,
        batch_submission_threshold=5,
        score_thresholds=tiers,
        weights=dict(_WEIGHTS),
    )


def default_config() -> RiskConfig:
    """The tuned settings: 33 high-risk keywords, tiers from 7, 9 and 15 points."""
    return _stock(_HIGH_RISK_DEFAULT, TierThresholds(7, 9, 15))


def template_config() -> RiskConfig:
    """The starter settings: 24 high-risk keywords, tiers from 10, 11 and 25 points."""
    return _stock(_HIGH_RISK_TEMPLATE, TierThresholds(10, 11, 25))
