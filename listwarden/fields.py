"""Canonical listing fields and how input headers resolve to them."""

from __future__ import annotations

import re
from collections.abc import Sequence

_DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")

HOURS_FIELDS = tuple(f"hours_{day}" for day in _DAYS)
SOCIAL_FIELDS = ("x_handle", "facebook_url", "instagram_handle")

# Accepted headers per field, after normalization, best first.
FIELD_ALIASES: dict[str, tuple[str, ...]] = {
    "business_name": ("business_name", "name", "company", "company_name", "biz_name",
                      "business", "location_name"),
    "address": ("address", "street", "street_address", "addr", "address1",
                "address_line_1", "address_line1"),
    "city": ("city", "town", "municipality"),
    "state": ("state", "st", "province", "region"),
    "zip": ("zip", "zip_code", "zipcode", "postal_code", "postal"),
    "phone": ("phone", "phone_number", "telephone", "tel", "mobile", "cell",
              "local_phone_phone_number", "main_phone_phone_number", "local_phone",
              "main_phone"),
    "website": ("website", "url", "web", "site", "domain", "webpage",
                "website_url_url", "website_url"),
    "industry": ("industry", "category", "type", "business_type", "vertical",
                 "service_type"),
    "email": ("email", "email_address", "e_mail", "contact_email", "emails"),
    "owner_name": ("owner_name", "owner", "contact_name", "contact", "rep_name"),
    "date_added": ("date_added", "created_at", "created_date", "added_date",
                   "submission_date", "date"),
    "reseller_id": ("reseller_id", "reseller", "partner_id", "partner"),
    "reseller_name": ("reseller_name", "partner_name", "agent"),
    "photo_gallery": ("photo_gallery_url", "photo_gallery", "photos", "gallery_url"),
    "x_handle": ("x_handle", "twitter_handle", "twitter", "x"),
    "facebook_url": ("facebook_page_url", "facebook_url", "facebook", "fb"),
    "instagram_handle": ("instagram_handle", "instagram", "ig"),
    "year_established": ("year_established", "established", "founded", "year_founded",
                         "founding_year"),
    **{f"hours_{day}": (f"hours_{day}", f"{day}_hours", f"{day[:3]}_hours") for day in _DAYS},
    "description": ("description", "desc", "business_description", "about", "overview"),
    "descrp": ("descrp",),
    "address_hidden": ("address_hidden", "hide_address", "hidden_address"),
    "service_area": ("service_area_places_name", "service_area_places", "service_area",
                     "service_areas", "coverage_area"),
    "keywords": ("keywords", "tags", "keyword", "seo_keywords"),
    "landing_page_url": ("landing_page_url", "landing_page", "landing_url", "lp_url"),
}


def normalize_header(header: str) -> str:
    """``Local Phone > Phone Number`` becomes ``local_phone_phone_number``."""
    return re.sub(r"[^a-z0-9]+", "_", header.lower()).strip("_")


def resolve_fields(headers: Sequence[str]) -> dict[str, int]:
    """Position of the column behind each canonical field; absent fields are left out.

    Metadata only, no Spark job. Of two headers that normalize alike the later wins.
    """
    position = {normalize_header(header): index for index, header in enumerate(headers)}
    resolved = {}
    for name, aliases in FIELD_ALIASES.items():
        match = next((alias for alias in aliases if alias in position), None)
        if match is not None:
            resolved[name] = position[match]
    return resolved
