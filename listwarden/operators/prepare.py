"""From an input table to the columns that rules read.

Input columns are renamed by position (``in_0`` ...) while rules run, so headers may
contain anything: dots, blanks, or two spellings that differ in case only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwarden.config import RiskConfig
from listwarden.fields import FIELD_ALIASES, HOURS_FIELDS, SOCIAL_FIELDS, resolve_fields
from listwarden.functions import contact, text
from listwarden.operators.row_ids import with_row_ids

ROW_ID = "row_id"


@dataclass(frozen=True)
class Texts:
    """Long texts in a table of their own (``key, text``), to which listings refer by key."""

    table: DataFrame
    #: The column of the listings with the key, null for an empty text. Results have the text there.
    column: str


@dataclass(frozen=True)
class Listings:
    """An input table with a row id and resolved fields."""

    table: DataFrame
    headers: tuple[str, ...]
    fields: dict[str, int]
    #: The whole input, also when ``table`` has been joined or narrowed.
    source: DataFrame
    #: The ids are those of an input column, not generated.
    given_ids: bool = False
    texts: Texts | None = None

    @classmethod
    def of(cls, df: DataFrame, id_col: str | None = None, texts: Texts | None = None) -> Listings:
        """Without ``id_col`` the table is materialized once to get stable 0-based ids."""
        headers = tuple(df.columns)
        table = df.toDF(*[f"in_{index}" for index in range(len(headers))])
        if id_col is None:
            table = with_row_ids(table, ROW_ID)
        else:
            table = table.withColumn(ROW_ID, F.col(f"in_{headers.index(id_col)}"))
        return cls(table, headers, resolve_fields(headers), table, id_col is not None, texts)

    def referring_texts(self) -> tuple[Column, DataFrame]:
        """Condition that a row refers to a text, and the texts as ``text_key, text_value``."""
        key = F.col(f"in_{self.headers.index(self.texts.column)}")
        table = self.texts.table.select(
            F.col("key").alias("text_key"), F.col("text").alias("text_value"))
        return key == F.col("text_key"), table

    def with_texts(self, table: DataFrame) -> DataFrame:
        """A table of these listings with texts in place of the references to them."""
        if self.texts is None:
            return table
        name = f"in_{self.headers.index(self.texts.column)}"
        refers, texts = self.referring_texts()
        value = F.when(F.col(name).isNull(), "").otherwise(F.col("text_value"))
        return table.join(texts, refers, "left").select(
            *[value.alias(name) if column == name else F.col(column) for column in table.columns])

    def without_texts(self) -> Listings:
        """The same listings, whose column of references is empty."""
        if self.texts is None:
            return self
        name = f"in_{self.headers.index(self.texts.column)}"
        return replace(self, table=self.table.withColumn(name, F.lit("")), texts=None)

    def text_fields(self) -> set[str]:
        """Canonical fields that are read from the texts."""
        if self.texts is None:
            return set()
        at = self.headers.index(self.texts.column)
        return {field for field, index in self.fields.items() if index == at}

    def has(self, *fields: str) -> bool:
        return any(field in self.fields for field in fields)

    def input_columns(self, headers: Sequence[str] | None = None) -> list[Column]:
        wanted = self.headers if headers is None else headers
        return [F.col(f"in_{self.headers.index(header)}") for header in wanted]


def clean_fields(listings: Listings, keep: Sequence[str]) -> list[Column]:
    """Canonical fields, cleaned; an absent field is a constant empty string."""
    cleaned = []
    for field in FIELD_ALIASES:
        if field in listings.fields:
            value = text.clean_cell(F.col(f"in_{listings.fields[field]}"))
        else:
            value = F.lit("")
        cleaned.append(value.alias(field))
    return [*[F.col(name) for name in keep], *cleaned]


def derive(df: DataFrame, cfg: RiskConfig, full_nfkd: bool = False) -> DataFrame:
    """Shared intermediate values, each computed once. Unused ones are pruned."""
    industries = text.any_of(cfg.high_risk_industries)
    stage = df.withColumns({
        "name_lower": F.lower("business_name"),
        "name_norm": text.normalize_text(F.col("business_name"), full_nfkd),
        "risk_text": F.concat_ws(" ", F.lower("industry"), F.lower("business_name")),
        "address_upper": F.upper("address"),
        "digits": contact.digits_only(F.col("phone")),
        "email_lower": F.lower("email"),
        "host": contact.host_of(F.col("website")),
        "landing_host": contact.host_of(F.col("landing_page_url")),
        "owner_norm": text.normalize_text(F.col("owner_name"), full_nfkd),
        "any_description": F.when(
            F.col("description") != "", F.col("description")
        ).otherwise(F.col("descrp")),
        "zip5": text.strip(F.substring_index("zip", "-", 1)),
        "no_social": _all_empty(SOCIAL_FIELDS),
        "no_hours": _all_empty(HOURS_FIELDS),
        "keyword_entries": F.filter(
            F.transform(F.split("keywords", r"[,;|]"), text.strip), lambda entry: entry != ""
        ),
    })
    return stage.withColumns({
        "high_risk": F.col("risk_text").rlike(industries) if industries else F.lit(False),
        "name_key": text.strip_legal_words(F.col("name_norm")),
        "dialable": contact.is_dialable(F.col("digits")),
        "area_code": contact.area_code(F.col("digits")),
        "email_domain": contact.email_domain(F.col("email_lower")),
        "email_local": contact.email_local(F.col("email_lower")),
    })


def _all_empty(fields: Sequence[str]) -> Column:
    return F.concat(*[F.col(field) for field in fields]) == ""
