"""Rules that look at one row at a time also run on a stream, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame

from listwarden.config import RiskConfig
from listwarden.operators.groups import GROUP_NEEDS
from listwarden.operators.rules import CATALOG
from listwarden.plans.scoring import References, flag_table

ROW_LOCAL_FLAGS = tuple(
    rule.flag for rule in CATALOG if not set(rule.needs) & set(GROUP_NEEDS)
)


def stream_flags(
    stream: DataFrame, cfg: RiskConfig, id_col: str, references: References = References()
) -> DataFrame:
    """Flags of row-local rules for each arriving listing (append mode)."""
    return flag_table(stream, cfg, references, id_col, flags=ROW_LOCAL_FLAGS)
