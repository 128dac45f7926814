"""Boundary values of single rules."""

from datetime import date

import data
import pytest

from listwarden import PublicSuffixes, References, default_config, flag_table

FIELDS = data.HEADERS + [
    "reseller_id", "reseller_name", "photo_gallery", "x_handle", "year_established",
    "hours_monday", "description", "descrp", "address_hidden", "service_area", "keywords",
    "landing_page_url",
]
CFG = default_config().replace(as_of=date(2024, 6, 1))


def flags(spark, rows, *wanted, cfg=CFG, references=References()):
    """Row number to evidence, for each flag."""
    full = [[row.get(name, "") for name in FIELDS] for row in rows]
    table = flag_table(data.listings(spark, full, FIELDS), cfg, references, "row_id",
                       flags=wanted)
    found = {flag: {} for flag in wanted}
    for row in table.collect():
        found[row.flag][row.row_id] = row.detail
    return found if len(wanted) > 1 else found[wanted[0]]


def test_names(spark):
    rows = [{"business_name": name} for name in
            ("Property Hub", "Mold Mold", "Mold Gone", "The 24/7 Pro", "")]
    found = flags(spark, rows, "GENERIC_NAME_KEYWORD", "KEYWORD_STUFFED_NAME",
                  "HIGH_RISK_INDUSTRY")
    assert found["GENERIC_NAME_KEYWORD"] == {
        0: "Spam keywords in name: ['pro']", 3: "Spam keywords in name: ['24/7', 'pro']"}
    assert found["KEYWORD_STUFFED_NAME"] == {
        1: "Multiple industry keywords in name: ['mold', 'mold']"}
    assert set(found["HIGH_RISK_INDUSTRY"]) == {1, 2}


def test_industry_match_may_span_industry_and_name(spark):
    rows = [{"industry": "Pest", "business_name": "Control Room"}]
    assert flags(spark, rows, "HIGH_RISK_INDUSTRY") == {
        0: "Matched industry keyword: 'pest control'"}


def test_phones(spark):
    rows = [{"phone": phone} for phone in
            ("123456789", "2125550100", "1 (800) 555-0100", "123456789012", "no digits", "")]
    found = flags(spark, rows, "INVALID_PHONE", "TOLLFREE_PHONE")
    assert found["INVALID_PHONE"] == {
        0: "Phone '123456789' has unexpected digit count (9)",
        3: "Phone '123456789012' has unexpected digit count (12)",
        4: "Phone 'no digits' has unexpected digit count (0)"}
    assert found["TOLLFREE_PHONE"] == {2: "Toll-free area code: 800"}


def test_po_box_and_mailbox(spark):
    rows = [{"address": address} for address in
            ("P.O. Box 5", "po box 7", "Depo Boxes 1", "12 FedEx Office Way", "P O BOX 1")]
    found = flags(spark, rows, "PO_BOX", "VIRTUAL_MAILBOX")
    assert set(found["PO_BOX"]) == {0, 1, 4}
    assert found["VIRTUAL_MAILBOX"] == {
        3: "Address matches virtual mailbox provider: 'FEDEX OFFICE'"}


def test_autogenerated_email(spark):
    rows = [{"email": email} for email in
            ("ab12@x.com", "a123@x.com", "abcd1234@x.com", "abcde1234@x.com", "@x.com", "")]
    assert set(flags(spark, rows, "AUTOGENERATED_EMAIL")) == {1, 3}


def test_free_email(spark):
    rows = [{"email": email} for email in ("A@Gmail.com", "gmail.com", "a@mail.acme.com", "")]
    assert set(flags(spark, rows, "FREE_EMAIL_PROVIDER")) == {0, 1}


def test_years(spark):
    rows = [{"year_established": y} for y in ("2023", "2024", "since 2025", "20", "", "0999")]
    found = flags(spark, rows, "YEAR_ESTABLISHED_MISSING", "YEAR_ESTABLISHED_INVALID",
                  "RECENTLY_ESTABLISHED")
    assert set(found["YEAR_ESTABLISHED_MISSING"]) == {4}
    assert found["YEAR_ESTABLISHED_INVALID"] == {3: "Year Established could not be parsed: '20'"}
    assert found["RECENTLY_ESTABLISHED"] == {
        1: "Business established within last 12 months (year: 2024)",
        2: "Business established within last 12 months (year: 2025)"}


def test_descriptions(spark):
    city = "Lima lima LIMA plumber plumber towing towing roofing roofing roofer roofer mold mold"
    rows = [{"description": "x" * 19}, {"description": "x" * 20}, {"description": " \t"},
            {"descrp": "short"}, {"description": city, "city": "Lima"},
            {"description": "plumber plumber towing towing once roofing", "city": ""}]
    found = flags(spark, rows, "DESCRIPTION_MISSING", "DESCRIPTION_TOO_SHORT",
                  "DESCRIPTION_KEYWORD_STUFFED")
    assert set(found["DESCRIPTION_MISSING"]) == {2}
    assert found["DESCRIPTION_TOO_SHORT"] == {
        0: "Description is under 20 characters (19 chars)",
        3: "Description is under 20 characters (5 chars)"}
    assert found["DESCRIPTION_KEYWORD_STUFFED"] == {
        4: "Description contains repeated city/service keywords: "
           "[\"city 'lima' ×3\", 'towing', 'plumber', 'mold', 'roofing']"}


def test_keywords(spark):
    rows = [{"keywords": k} for k in (
        "a1bc;a1bc|a1bc", "a1bc;a1bc|a1bc, ", "a1bc;a1bc|a1bc,zzzz",
        "mold,Towing,HVAC,roofing", "mold,towing,hvac,cafe",
        "bbbb aaaa,aaaa bbbb,bbbb aaaa,cccc cccc,cccc dddd dddd dddd dddd eeee eeee eeee")]
    assert flags(spark, rows, "KEYWORD_FIELD_STUFFED") == {
        2: "Keywords field has 4 entries — repeated terms: {'a1bc': 3}",
        3: "Keywords field has 4 entries — 4 service-type keywords",
        5: "Keywords field has 5 entries — repeated terms: {'dddd': 4, 'bbbb': 3, 'aaaa': 3}"}


def test_profile_and_address_rules(spark):
    rows = [{"industry": "hvac", "address_hidden": "Yes", "service_area": "s" * 70},
            {"industry": "bakery", "address_hidden": "1", "service_area": "x", "address": "1 A St",
             "photo_gallery": "p", "x_handle": "x", "hours_monday": "9", "website": "a.com"}]
    found = flags(spark, rows, "ADDRESS_HIDDEN_HIGH_RISK", "SERVICE_AREA_NO_ADDRESS", "NO_PHOTOS",
                  "NO_SOCIAL_PRESENCE", "NO_HOURS_PROVIDED", "NO_WEBSITE")
    assert all(set(rows) == {0} for rows in found.values())
    assert found["SERVICE_AREA_NO_ADDRESS"][0] == (
        f"Service area '{'s' * 60}' set but no street address provided")


def test_websites(spark):
    references = References(suffixes=PublicSuffixes.from_rules(spark))
    rows = [
        {"website": "HTTPS://user:pw@Shop.Acme.co.uk:80/p", "business_name": "Zeta Tools",
         "email": "a@mail.acme.co.uk", "landing_page_url": "other.com"},
        {"website": "m.bark.com", "business_name": "Bark Pro"},
        {"website": "10.0.0.1", "business_name": "Address"},
        {"website": "a.b.c.ck", "business_name": "Wild Card"},
        {"website": "x.www.ck", "business_name": "An Exception"},
        {"website": "co.uk", "business_name": "Only Suffix"},
        {"website": "zeta.com", "business_name": "Zet A"},
    ]
    found = flags(spark, rows, "DOMAIN_NAME_MISMATCH", "LEAD_GEN_DOMAIN",
                  "EMAIL_DOMAIN_MISMATCH", "LANDING_PAGE_DOMAIN_MISMATCH", references=references)
    assert found["DOMAIN_NAME_MISMATCH"] == {
        0: "Domain 'acme.co.uk' shares no words with business name",
        3: "Domain 'b.c.ck' shares no words with business name",
        4: "Domain 'www.ck' shares no words with business name"}
    assert found["LEAD_GEN_DOMAIN"] == {1: "Website is a lead-gen directory: m.bark.com"}
    assert found["EMAIL_DOMAIN_MISMATCH"] == {
        0: "Email domain 'mail.acme.co.uk' differs from website 'acme.co.uk'"}
    assert found["LANDING_PAGE_DOMAIN_MISMATCH"] == {
        0: "Landing page domain 'other.com' differs from website domain 'acme.co.uk'"}


@pytest.mark.parametrize("copies, fires", [(2, False), (3, True)])
def test_thresholds(spark, copies, fires):
    rows = [{"address": f" 5 Elm St{' ' * at}", "phone": "555", "date_added": "2024-01-01 08:00"}
            for at in range(copies)]
    cfg = CFG.replace(batch_submission_threshold=3, shared_phone_threshold=3)
    found = flags(spark, rows, "SHARED_ADDRESS", "SHARED_PHONE", "BATCH_SUBMISSION", cfg=cfg)
    assert all(bool(rows) is fires for rows in found.values())


@pytest.mark.parametrize("with_id, reseller", [(False, "North"), (True, "UNKNOWN")])
def test_reseller_name_counts_only_if_no_row_has_an_id(spark, with_id, reseller):
    rows = [{"date_added": "2024-01-01", "reseller_name": "North"} for _ in range(2)]
    rows.append({"date_added": "", "reseller_id": "R1" if with_id else ""})
    cfg = CFG.replace(batch_submission_threshold=2)
    found = flags(spark, rows, "BATCH_SUBMISSION", cfg=cfg)
    text = f"Reseller '{reseller}' submitted 2 listings on 2024-01-01 (threshold: 2)"
    assert found == {0: text, 1: text}


def test_near_duplicates(spark):
    names = ["", "ab", "Ab LLC", "Quick Dallas Tow", "tow quick dallas", "Locksmith",
             "Locksmiths", "Smith Plumbing", "Résumé Shop", "Re sume shop", "lone"]
    found = flags(spark, [{"business_name": name} for name in names], "NEAR_DUPLICATE_NAME")
    shares = "Near-duplicate name; shares fingerprint with 1 other row(s) in this batch"
    assert found == {
        1: shares, 2: "Near-duplicate name with row 1: 'ab'",
        3: shares, 4: "Near-duplicate name with row 3: 'quick dallas tow'",
        5: shares, 6: "Near-duplicate name with row 5: 'locksmith'",
        8: shares, 9: "Near-duplicate name with row 8: 're sume shop'",
    }


def test_area_code_region(spark):
    dim = spark.createDataFrame(
        [("212", "New York, NY"), ("312", ""), ("312", "")], "area_code string, region_desc string")
    rows = [{"phone": "2125550100", "state": "ny"}, {"phone": "2125550100", "city": "new york"},
            {"phone": "2125550100"}, {"phone": "3125550100", "state": "TX"},
            {"phone": "5125550100", "state": "TX"}, {"phone": "212", "state": "TX"}]
    found = flags(spark, rows, "AREA_CODE_MISMATCH", references=References(area_code_dim=dim))
    assert found == {2: "Area code 212 region 'NEW YORK, NY' may not match state "}


def test_zip_state(spark):
    dim = spark.createDataFrame([("10001", "ny"), ("10001", "ny")], "zip string, state_code string")
    rows = [{"zip": "10001-22", "state": "tx"}, {"zip": "10001", "state": "NY"},
            {"zip": "99999", "state": "TX"}, {"zip": "10001"}]
    found = flags(spark, rows, "STATE_ZIP_MISMATCH", references=References(zip_dim=dim))
    assert found == {0: "ZIP 10001 belongs to NY, not TX"}


def test_long_keyword_cells_take_linear_time(spark):
    words = [f"word{at}" for at in range(100_000)] * 2 + ["rare"] * 3
    found = flags(spark, [{"keywords": "a,b,c," + " ".join(words)}], "KEYWORD_FIELD_STUFFED")
    assert found == {0: "Keywords field has 4 entries — repeated terms: {'rare': 3}"}


def test_repeated_ids_raise(spark):
    row = spark.createDataFrame([(1, "555"), (1, "555")], "row_id long, phone string")
    with pytest.raises(ValueError, match="repeats"):
        flag_table(row, CFG, id_col="row_id", flags=["SHARED_PHONE"])
