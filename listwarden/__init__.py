"""Risk scoring of business listings on Spark."""

from listwarden.config import RiskConfig, TierThresholds, default_config, template_config
from listwarden.operators.domains import PublicSuffixes
from listwarden.operators.prepare import Texts
from listwarden.plans.scoring import Options, References, flag_table, score_listings
from listwarden.sources.files import read_listings, write_results

__all__ = [
    "Options", "PublicSuffixes", "References", "RiskConfig", "Texts", "TierThresholds",
    "default_config", "flag_table", "read_listings", "score_listings",
    "template_config", "write_results",
]
