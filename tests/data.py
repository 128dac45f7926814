"""Ten listings shaped like the golden fixture: same features, our own values."""

from listwarden import PublicSuffixes, References

HEADERS = ["business_name", "address", "city", "state", "zip", "phone", "website",
           "industry", "email", "owner_name", "date_added"]

DAY, EARLIER = "2024-05-06", "2024-02-11"
ROWS = [
    # 0, 1: exact copies, toll-free, builder site, free e-mail
    ["Boston Best Locksmith 24/7", "12 Pier Rd", "Boston", "MA", "02101", "8885550101",
     "https://keyfixers.wix.com", "Locksmith", "desk@gmail.com", "Ann Lee", DAY],
    ["Boston Best Locksmith 24/7", "12 Pier Rd", "Boston", "MA", "02101", "8885550101",
     "https://keyfixers.wix.com", "Locksmith", "desk@gmail.com", "Ann Lee", DAY],
    # 2, 3, 4: one address and phone
    ["Tulsa Quick Towing Fast", "77 Cedar Ave", "Tulsa", "OK", "74101", "9185550102",
     "https://tulsatows.com", "Towing", "hello@yahoo.com", "Max Roe", DAY],
    ["Water Damage Restoration Pro", "77 Cedar Ave", "Tulsa", "OK", "74101", "9185550102",
     "", "Restoration", "hello@yahoo.com", "Max Roe", DAY],
    ["Reliable AC Repair Expert", "77 Cedar Ave", "Tulsa", "OK", "74101", "9185550102",
     "https://tulsatows.com", "HVAC", "cool98765432@gmail.com", "Ben Fox", DAY],
    # 5: PO box
    ["Miller's Plumbing LLC", "PO Box 88", "Mesa", "AZ", "85201", "4805550103",
     "https://millersplumbing.com", "Plumber", "mail@millersplumbing.com", "", DAY],
    # 6: mailbox store, ZIP of another state
    ["Top Rated Pest Control", "The UPS Store #12", "Omaha", "NE", "02101", "4025550104",
     "", "Pest Control", "bugs@hotmail.com", "", DAY],
    # 7, 8: benign and risky listing with one owner, phone and domain
    ["Silver Creek Gardens", "9 Mill Ln", "Reno", "NV", "89501", "7755550105",
     "https://silvercreek.com", "Gardening", "info@silvercreek.com", "Eve Park", EARLIER],
    ["Emergency Electrician Local Fast", "9 Mill Ln", "Reno", "NV", "89501", "7755550105",
     "https://silvercreek.com", "Electrician", "eve@silvercreek.com", "Eve Park", DAY],
    # 9: ZIP of another state
    ["Best Garage Door Repair 24 Hour", "1 Fake St", "Salem", "OR", "89501", "5035550106",
     "https://garageshop.com", "Garage Door", "fix@garageshop.com", "", DAY],
]

ZIP_STATES = [("02101", "MA"), ("74101", "OK"), ("85201", "AZ"), ("89501", "NV")]


def listings(spark, rows=ROWS, headers=HEADERS):
    return spark.createDataFrame(
        [(at, *row) for at, row in enumerate(rows)],
        ", ".join(["row_id long", *[f"`{name}` string" for name in headers]]),
    )


def references(spark, **extra):
    return References(
        suffixes=PublicSuffixes.from_rules(spark),
        zip_dim=spark.createDataFrame(ZIP_STATES, "zip string, state_code string"),
        **extra,
    )
