"""Registrable domains by longest public suffix, without a join.

The suffix rules, a small bounded list, become one pattern over the labels of a host in
reverse. Rules share their beginnings in it, so a host is matched once from its end, however
many rules there are and however deep they go.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listwarden.functions.contact import label_count, last_labels
from listwarden.functions.trie import pattern_of

#: The whole public list has about 10,000 rules; more than this is not a suffix list.
MAX_SUFFIX_RULES = 100_000

# A starter list for tests and small jobs. Pass the full list in production.
STARTER_SUFFIXES = (
    "com", "net", "org", "edu", "gov", "mil", "int", "info", "biz", "io", "co", "me",
    "us", "ca", "uk", "co.uk", "org.uk", "ac.uk", "gov.uk", "au", "com.au", "net.au",
    "org.au", "nz", "co.nz", "de", "fr", "es", "it", "nl", "in", "co.in", "jp", "co.jp",
    "br", "com.br", "mx", "com.mx", "*.ck", "!www.ck",
)


class PublicSuffixes:
    """Suffix rules prepared for matching. Their number is checked once, on construction."""

    def __init__(self, rules: DataFrame):
        """``rules`` has ``suffix`` and ``kind`` (normal, wildcard or exception)."""
        rows = rules.select(F.lower("suffix").alias("suffix"), "kind").filter(
            "suffix <> ''").limit(MAX_SUFFIX_RULES + 1).collect()
        if len(rows) > MAX_SUFFIX_RULES:
            raise ValueError(f"More than {MAX_SUFFIX_RULES} public suffix rules")
        kinds: dict[str, set[str]] = {}
        for row in rows:
            kinds.setdefault(row.suffix[::-1], set()).add(row.kind)
        # A wildcard stands for one label more, so it goes before the rule as it is.
        self.longest = _pattern({
            suffix: [tail for kind, tail in _TAILS if kind in found]
            for suffix, found in kinds.items()})
        self.exceptions = _pattern(
            {suffix: [_END] for suffix, found in kinds.items() if "exception" in found},
            tails_first=True)

    @classmethod
    def from_rules(cls, spark: SparkSession, rules: Iterable[str] = STARTER_SUFFIXES):
        """From list notation: ``com``, ``*.ck`` (wildcard), ``!www.ck`` (exception)."""
        return cls(spark.createDataFrame([_parse(rule) for rule in rules],
                                         "suffix string, kind string"))


#: The end of a label, read from the end of a host.
_END = r"(?=\.|$)"
_TAILS = (("wildcard", r"\.[^.]+" + _END), ("normal", _END))


def _pattern(tails: Mapping[str, list[str]], tails_first: bool = False) -> str | None:
    some = {suffix: found for suffix, found in tails.items() if found}
    return "^" + pattern_of(some, tails_first) if some else None


def _parse(rule: str) -> tuple[str, str]:
    if rule.startswith("!"):
        return rule[1:], "exception"
    if rule.startswith("*."):
        return rule[2:], "wildcard"
    return rule, "normal"


def with_registrable_domains(
    df: DataFrame, hosts: Mapping[str, Column], suffixes: PublicSuffixes
) -> DataFrame:
    """Add one column per entry: domain plus suffix of that host, '' if either is missing."""
    # Each step is a projection of its own, so that every pattern is matched once.
    reversed_ = {f"__{name}": F.reverse(host) for name, host in hosts.items()}
    depths, domains = {}, {}
    for name, host in hosts.items():
        depths[f"__{name}"] = _suffix_depth(F.col(f"__{name}"), suffixes)
        labels, depth = label_count(host), F.col(f"__{name}")
        domains[name] = F.when(labels > depth, last_labels(host, depth + 1)).otherwise("")
    return df.withColumns(reversed_).withColumns(depths).withColumns(domains).drop(*reversed_)


def _suffix_depth(host: Column, suffixes: PublicSuffixes) -> Column:
    """Labels of the public suffix of a host given in reverse; null without a suffix."""
    none = F.lit(None).cast("int")

    def labels(pattern: str | None) -> Column:
        return none if pattern is None else F.nullif(
            label_count(F.regexp_extract(host, pattern, 0)), F.lit(0))

    return F.coalesce(labels(suffixes.exceptions) - 1, labels(suffixes.longest))
