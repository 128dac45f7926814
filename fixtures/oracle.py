"""SQL twins of the queries, for an independent engine over the same tables."""

from __future__ import annotations

INPUT = ("row_id, business_name, address, city, state, zip, phone, website, industry, email, "
         "owner_name, date_added, reseller_id, description, keywords, photo_gallery, x_handle, "
         "hours_monday, year_established, address_hidden, service_area, landing_page_url")
COMPARED = INPUT.removeprefix("row_id, ")

RISK = "machinery|building|widget|ring|economy|tion|ment|elle|lich|ther|eaux"
SPAM = "small|red|economy"
FREE = ("'gmail.com','yahoo.com','hotmail.com','outlook.com','aol.com','icloud.com',"
        "'mail.com','protonmail.com','ymail.com','live.com'")
MAILBOX = ("THE UPS STORE|UPS STORE|FEDEX OFFICE|FEDEX|REGUS|WEWORK|IPOSTAL|ANYTIME MAILBOX|"
           "POSTAL CONNECTIONS|POSTNET|THE MAIL CENTER|MAILBOXES ETC")

BASE = """
refs AS (
  SELECT o.*, o_orderkey AS k,
         o_orderkey % (SELECT count(*) FROM part) AS part_ref,
         o_orderkey % (SELECT count(*) FROM pages) AS page_ref,
         (o_orderkey + 1) % (SELECT count(*) FROM pages) AS landing_ref,
         o_orderkey % (SELECT count(*) FROM documents) AS doc_ref
  FROM orders o),
once AS (
  SELECT k AS row_id,
    p_name || ' ' || lower(p_type) AS business_name,
    CASE WHEN k%11=0 THEN '' WHEN k%13=0 THEN 'PO Box ' || k
         WHEN k%17=0 THEN 'The UPS Store #' || (k%100)
         ELSE (c_custkey%400) || ' ' || n_name || ' St' END AS address,
    n_name AS city, 'S' || n_regionkey AS state,
    lpad(CAST(c_nationkey*100 + k%29 AS VARCHAR), 5, '0') AS zip,
    CASE WHEN k%19=0 THEN '' WHEN k%23=0 THEN '800' || lpad(CAST(c_custkey AS VARCHAR), 7, '0')
         WHEN k%29=0 THEN '555-01'
         ELSE (200+c_nationkey) || lpad(CAST(c_custkey*7919 % 10000000 AS VARCHAR), 7, '0')
    END AS phone,
    CASE WHEN k%7=0 THEN '' ELSE pg.url END AS website,
    lower(c_mktsegment) AS industry,
    CASE WHEN k%5=0 THEN 'info@gmail.com'
         WHEN k%3=0 THEN 'u' || (10000000+c_custkey) || '@mail.example.com'
         ELSE 'c' || c_custkey || '@example.com' END AS email,
    CASE WHEN k%9=0 THEN '' ELSE c_name END AS owner_name,
    strftime(o_orderdate, '%Y-%m-%d') AS date_added,
    CASE WHEN k%10=0 THEN '' WHEN k%7=1 THEN 'S' || (c_custkey%20) ELSE 'R' || (c_custkey%3)
    END AS reseller_id,
    CASE WHEN k%31=0 THEN '' ELSE d.text END AS description,
    CASE WHEN k%6=0 THEN '' ELSE replace(p_name,' ',',') || ',' || p_type
         || CASE WHEN k%4=0 THEN ',' || p_type || ',' || p_type ELSE '' END
         || ',' || lower(c_mktsegment) END AS keywords,
    CASE WHEN k%2=0 THEN '' ELSE 'gallery' END AS photo_gallery,
    CASE WHEN k%3=0 THEN '' ELSE 'handle' END AS x_handle,
    CASE WHEN k%4=0 THEN '' ELSE '9-5' END AS hours_monday,
    CASE WHEN k%8=0 THEN '' WHEN k%12=1 THEN 'n/a'
         ELSE CAST(year(o_orderdate) AS VARCHAR) END AS year_established,
    CASE WHEN k%15=0 THEN 'yes' ELSE '' END AS address_hidden,
    CASE WHEN k%10=1 THEN n_name ELSE '' END AS service_area,
    lp.url AS landing_page_url
  FROM refs
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN part ON p_partkey = part_ref
  JOIN pages pg ON pg.page_id = page_ref
  JOIN pages lp ON lp.page_id = landing_ref
  JOIN documents d ON d.doc_id = doc_ref),
listings AS (
  SELECT * FROM once
  UNION ALL
  SELECT row_id + 100000000, * EXCLUDE (row_id) FROM once WHERE row_id % 97 = 0)
"""


def _strip(column: str) -> str:
    return rf"regexp_replace({column}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def _host(column: str) -> str:
    return (rf"lower(regexp_extract({column}, '^(?:https?://)?(?:[^/?#]*@)?([^/?#:]*)', 1))")


def _domain(host: str) -> str:
    return rf"regexp_extract({host}, '([^.]+\.(?:com|net|org))$', 1)"


def _norm(column: str) -> str:
    return rf"trim(regexp_replace(lower({column}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"


_LEGAL = r"\b(llc|inc|co|corp|ltd|company|companies|group|services|solutions|associates)\b"

DERIVED = f"""
d0 AS (
  SELECT *, lower(business_name) AS name_lower,
    {_norm('business_name')} AS name_norm,
    lower(industry) || ' ' || lower(business_name) AS risk_text,
    regexp_replace(phone, '[^0-9]', '', 'g') AS digits,
    {_host('website')} AS host, {_host('landing_page_url')} AS landing_host,
    lower(email) AS email_lower,
    {_norm('owner_name')} AS owner_norm,
    {_strip('description')} AS descr
  FROM listings),
d AS (
  SELECT *, regexp_matches(risk_text, '{RISK}') AS high_risk,
    trim(regexp_replace(name_norm, '{_LEGAL}', '', 'g')) AS name_key,
    length(digits) IN (10, 11) AS dialable,
    substr(digits, greatest(length(digits) - 9, 1), 3) AS area,
    {_domain('host')} AS site, {_domain('landing_host')} AS landing_site,
    split_part(email_lower, '@', -1) AS email_domain,
    split_part(email_lower, '@', 1) AS email_local,
    CASE WHEN reseller_id = '' THEN 'UNKNOWN' ELSE reseller_id END AS reseller,
    substr(date_added, 1, 10) AS day
  FROM d0)
"""

DIMENSIONS = """
zip_dim AS (
  SELECT lpad(CAST(n_nationkey*100 + j AS VARCHAR), 5, '0') AS zip,
         'S' || CASE WHEN j%7=0 THEN (n_regionkey+1)%5 ELSE n_regionkey END AS state_code
  FROM nation, range(28) r(j)),
area_dim AS (
  SELECT CAST(200 + n_nationkey AS VARCHAR) AS area,
         CASE n_nationkey%3 WHEN 0 THEN upper(n_name) || ', ZZ' WHEN 1 THEN 'ELSEWHERE, Q9'
              ELSE '' END AS region
  FROM nation),
rdi AS (
  SELECT address, CASE WHEN number%4=0 THEN 'Residential' ELSE 'Commercial' END AS rdi
  FROM (SELECT DISTINCT address,
               TRY_CAST(regexp_extract(address, '^([0-9]+) ', 1) AS INTEGER) AS number
        FROM listings)
  WHERE number % 2 = 0)
"""

GROUPS = """
g_address AS (SELECT lower(address) AS key, count(*) AS n FROM d WHERE address <> '' GROUP BY 1),
g_phone AS (SELECT digits AS key, count(*) AS n FROM d WHERE digits <> '' GROUP BY 1),
g_domain AS (SELECT site AS key, count(*) AS n FROM d WHERE site <> '' GROUP BY 1),
g_email AS (SELECT email_lower AS key, count(*) AS n FROM d WHERE email_lower <> '' GROUP BY 1),
g_owner AS (SELECT owner_norm AS key, count(*) AS n FROM d WHERE owner_norm <> '' GROUP BY 1),
g_batch AS (SELECT reseller, day, count(*) AS n FROM d WHERE day NOT IN ('', 'nan') GROUP BY 1, 2),
"""
COPIES = f"""
copies AS (
  SELECT row_id, count(*) OVER w AS n, min(row_id) OVER w AS first_id
  FROM listings WINDOW w AS (PARTITION BY {COMPARED}))
"""
FINGERPRINTS = """
f AS (
  SELECT row_id, name_key,
    array_to_string(list_sort(list_distinct(string_split(name_key, ' '))), ' ') AS words,
    CASE WHEN length(name_key) < 3 THEN name_key ELSE array_to_string(list_sort(list_distinct(
      [substr(name_key, CAST(i AS BIGINT), 3) FOR i IN range(1, length(name_key) - 1)]))[1:8], '|')
    END AS trigrams,
    CAST(length(name_key) // 3 AS VARCHAR) || ':' || substr(name_key, 1, 5) AS prefix
  FROM d WHERE name_key <> '')
"""
NEAR = FINGERPRINTS + """,
near0 AS (
  SELECT row_id, name_key,
    count(*) OVER (PARTITION BY words) AS n1, min(row_id) OVER (PARTITION BY words) AS f1,
    count(*) OVER (PARTITION BY trigrams) AS n2, min(row_id) OVER (PARTITION BY trigrams) AS f2,
    count(*) OVER (PARTITION BY prefix) AS n3, min(row_id) OVER (PARTITION BY prefix) AS f3
  FROM f),
near1 AS (
  SELECT row_id, CASE WHEN n1>1 THEN n1 WHEN n2>1 THEN n2 ELSE n3 END AS n,
         CASE WHEN n1>1 THEN f1 WHEN n2>1 THEN f2 ELSE f3 END AS first_id
  FROM near0 WHERE n1>1 OR n2>1 OR n3>1),
near AS (
  SELECT near1.row_id, n, first_id, name_key AS first_name
  FROM near1 JOIN near0 ON near1.first_id = near0.row_id)
"""
KEYWORD_TERMS = f"""
kw0 AS (
  SELECT row_id,
    list_filter([{_strip('e')} FOR e IN regexp_split_to_array(keywords, '[,;|]')],
                lambda e: e <> '') AS entries
  FROM listings WHERE keywords <> ''),
kw1 AS (
  SELECT row_id, len(entries) AS n,
    [{_norm('e')} FOR e IN entries] AS normed
  FROM kw0 WHERE len(entries) >= 4),
kw2 AS (
  SELECT row_id, n,
    len(list_filter(normed, lambda e: regexp_matches(e, '{RISK}'))) AS services,
    list_filter(string_split(array_to_string(normed, ' '), ' '), lambda w: length(w) > 3) AS words
  FROM kw1),
kw3 AS (
  SELECT row_id, w, count(*) AS c, min(pos) AS pos
  FROM (SELECT row_id, unnest(words) AS w, generate_subscripts(words, 1) AS pos FROM kw2)
  GROUP BY row_id, w HAVING count(*) >= 3),
kw4 AS (
  SELECT row_id, string_agg('''' || w || ''': ' || c, ', ' ORDER BY c DESC, pos) AS terms
  FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY c DESC, pos) AS rn FROM kw3)
  WHERE rn <= 3 GROUP BY row_id),
kw AS (
  SELECT row_id, 'Keywords field has ' || n || ' entries — ' || concat_ws('; ',
    CASE WHEN services >= 4 THEN services || ' service-type keywords' END,
    CASE WHEN terms IS NOT NULL THEN 'repeated terms: {{' || terms || '}}' END) AS detail
  FROM kw2 LEFT JOIN kw4 USING (row_id)
  WHERE services >= 4 OR terms IS NOT NULL)
"""


def _listed(column: str, pattern: str) -> str:
    return (f"'[' || array_to_string(['''' || m || '''' FOR m IN "
            f"regexp_extract_all({column}, '{pattern}')], ', ') || ']'")


def _stuffed(words) -> tuple[str, str, str]:
    """From, condition and evidence of the stuffed-description rule for some words."""
    def count(word: str) -> str:
        return f"(length(b) - length(replace(b, {word}, ''))) // nullif(length({word}), 0)"
    hits = ", ".join(f"CASE WHEN {count(repr(w))} >= 2 THEN '''{w}''' END" for w in words)
    city = (f"CASE WHEN {count('c')} >= 3 THEN '\"city ''' || c || ''' ×' || ({count('c')})"
            " || '\"' END")
    source = (f"(SELECT row_id, list_filter([{city}, {hits}], lambda h: h IS NOT NULL) AS hits "
              "FROM (SELECT row_id, lower(descr) AS b, lower(city) AS c FROM d "
              "WHERE length(descr) >= 20))")
    return source, "len(hits) >= 3", (
        "'Description contains repeated city/service keywords: [' || "
        "array_to_string(hits[1:5], ', ') || ']'")


RISK_WORDS = [word for word in RISK.split("|") if len(word) > 3]
_STUFFED = _stuffed(RISK_WORDS)

#: flag -> (ord, weight, source, condition, evidence, extra tables it needs)
FLAGS: dict[str, tuple[int, int, str, str, str, tuple[str, ...]]] = {
    "HIGH_RISK_INDUSTRY": (
        1, 2, "d", "high_risk",
        f"'Matched industry keyword: ''' || regexp_extract(risk_text, '{RISK}') || ''''", ()),
    "GENERIC_NAME_KEYWORD": (
        2, 3, "d", f"regexp_matches(name_lower, '{SPAM}')",
        f"'Spam keywords in name: ' || {_listed('name_lower', SPAM)}", ()),
    "KEYWORD_STUFFED_NAME": (
        3, 3, "d", f"len(regexp_extract_all(name_lower, '{RISK}')) >= 2",
        f"'Multiple industry keywords in name: ' || {_listed('name_lower', RISK)}", ()),
    "PO_BOX": (
        4, 4, "d", r"regexp_matches(upper(address), '\bP\.?\s*O\.?\s*BOX\b')",
        "'Address is a PO Box'", ()),
    "VIRTUAL_MAILBOX": (
        5, 4, "d", f"regexp_matches(upper(address), '{MAILBOX}')",
        "'Address matches virtual mailbox provider: ''' || "
        f"regexp_extract(upper(address), '{MAILBOX}') || ''''", ()),
    "SHARED_ADDRESS": (
        6, 2, "d JOIN g_address ON key = lower(address)", "n >= 15",
        "'Address shared by ' || n || ' businesses (threshold: 15)'", ("groups",)),
    "STATE_ZIP_MISMATCH": (
        7, 3, "d JOIN zip_dim z USING (zip)", "state <> '' AND state_code <> upper(state)",
        "'ZIP ' || zip || ' belongs to ' || state_code || ', not ' || upper(state)", ("dims",)),
    "INVALID_PHONE": (
        8, 2, "d", "phone <> '' AND NOT dialable",
        "'Phone ''' || phone || ''' has unexpected digit count (' || length(digits) || ')'", ()),
    "TOLLFREE_PHONE": (
        9, 2, "d", "dialable AND area IN ('800','888','877','866','855','844','833')",
        "'Toll-free area code: ' || area", ()),
    "SHARED_PHONE": (
        10, 4, "d JOIN g_phone ON key = digits", "n >= 15",
        "'Phone shared by ' || n || ' businesses (threshold: 15)'", ("groups",)),
    "AREA_CODE_MISMATCH": (
        11, 3, "d JOIN area_dim USING (area)",
        "dialable AND region <> '' AND NOT contains(region, upper(state)) "
        "AND NOT contains(region, upper(city))",
        "'Area code ' || area || ' region ''' || region || ''' may not match state ' "
        "|| upper(state)", ("dims",)),
    "NO_WEBSITE": (
        12, 3, "d", "website = '' AND high_risk",
        "'No website provided for a high-risk industry business'", ()),
    "GENERIC_BUILDER_SITE": (
        13, 1, "d", "contains(host, 'example.net')",
        "'Website is on a generic builder: ' || host", ()),
    "LEAD_GEN_DOMAIN": (
        14, 3, "d", "contains(host, 'spam-farm.example.org')",
        "'Website is a lead-gen directory: ' || host", ()),
    "SHARED_DOMAIN": (
        15, 3, "d JOIN g_domain ON key = site", "n >= 2",
        "'Website domain ''' || site || ''' shared by ' || n || ' businesses'", ("groups",)),
    "DOMAIN_NAME_MISMATCH": (
        16, 2, "(SELECT *, list_filter(string_split(name_norm, ' '), lambda w: length(w) > 3) "
               "AS tokens FROM d)",
        "site <> '' AND len(tokens) > 0 AND "
        "len([t FOR t IN tokens IF contains(site, t)]) = 0",
        "'Domain ''' || site || ''' shares no words with business name'", ()),
    "FREE_EMAIL_PROVIDER": (
        17, 1, "d", f"email <> '' AND email_domain IN ({FREE})",
        "'Email uses free provider: ' || email_domain", ()),
    "AUTOGENERATED_EMAIL": (
        18, 2, "d",
        "length(regexp_replace(email_local, '[^0-9]', '', 'g')) "
        "/ greatest(length(email_local), 1) > 0.5 "
        "OR (length(email_local) > 8 AND regexp_matches(email_local, '[0-9]{4}'))",
        "'Email local part appears auto-generated: ' || email_local", ()),
    "SHARED_EMAIL": (
        19, 4, "d JOIN g_email ON key = email_lower", "n >= 2",
        "'Email shared by ' || n || ' businesses'", ("groups",)),
    "EMAIL_DOMAIN_MISMATCH": (
        20, 2, "d",
        f"site <> '' AND email_domain <> '' AND email_domain NOT IN ({FREE}) "
        "AND email_domain <> site",
        "'Email domain ''' || email_domain || ''' differs from website ''' || site || ''''", ()),
    "EXACT_DUPLICATE": (
        21, 5, "copies", "n > 1",
        "CASE WHEN row_id = first_id THEN 'This row has ' || (n-1) || ' exact duplicate(s)' "
        "ELSE 'Exact duplicate of row ' || first_id END", ("copies",)),
    "NEAR_DUPLICATE_NAME": (
        22, 3, "near", "true",
        "CASE WHEN row_id = first_id THEN 'Near-duplicate name; shares fingerprint with ' || (n-1) "
        "|| ' other row(s) in this batch' ELSE 'Near-duplicate name with row ' || first_id "
        "|| ': ''' || first_name || '''' END", ("near",)),
    "SAME_OWNER_MULTI_BIZ": (
        23, 3, "d JOIN g_owner ON key = owner_norm", "industry <> '' AND n >= 2",
        "'Owner ''' || owner_norm || ''' appears across ' || n || ' businesses'", ("groups",)),
    "BATCH_SUBMISSION": (
        24, 3, "d JOIN g_batch USING (reseller, day)", "n >= 5",
        "'Reseller ''' || reseller || ''' submitted ' || n || ' listings on ' || day "
        "|| ' (threshold: 5)'", ("groups",)),
    "NO_PHOTOS": (25, 3, "d", "photo_gallery = ''", "'Photo Gallery URL is blank'", ()),
    "NO_SOCIAL_PRESENCE": (
        26, 2, "d", "x_handle = ''",
        "'All social media fields (X, Facebook, Instagram) are blank'", ()),
    "YEAR_ESTABLISHED_MISSING": (
        27, 3, "d", "year_established = ''", "'Year Established is blank'", ()),
    "YEAR_ESTABLISHED_INVALID": (
        28, 3, "d", "year_established <> '' AND NOT regexp_matches(year_established, '[0-9]{4}')",
        "'Year Established could not be parsed: ''' || year_established || ''''", ()),
    "RECENTLY_ESTABLISHED": (
        29, 3, "(SELECT row_id, TRY_CAST(regexp_extract(year_established, '[0-9]{4}') AS INTEGER) "
               "AS y FROM d)",
        "(2000 - y) * 12 + 1 <= 12",
        "'Business established within last 12 months (year: ' || y || ')'", ()),
    "NO_HOURS_PROVIDED": (
        30, 2, "d", "hours_monday = ''", "'All business hours fields are blank'", ()),
    "DESCRIPTION_MISSING": (31, 2, "d", "descr = ''", "'Description is blank'", ()),
    "DESCRIPTION_TOO_SHORT": (
        32, 2, "d", "descr <> '' AND length(descr) < 20",
        "'Description is under 20 characters (' || length(descr) || ' chars)'", ()),
    "DESCRIPTION_KEYWORD_STUFFED": (33, 3, *_STUFFED, ()),
    "ADDRESS_HIDDEN_HIGH_RISK": (
        34, 4, "d", "lower(address_hidden) IN ('true','yes','1','y') AND high_risk",
        "'Address is marked hidden for a high-risk industry business'", ()),
    "SERVICE_AREA_NO_ADDRESS": (
        35, 3, "d", "service_area <> '' AND address = ''",
        "'Service area ''' || substr(service_area, 1, 60) || ''' set but no street address "
        "provided'", ()),
    "KEYWORD_FIELD_STUFFED": (36, 3, "kw", "true", "detail", ("keywords",)),
    "LANDING_PAGE_DOMAIN_MISMATCH": (
        37, 2, "d", "landing_site <> '' AND site <> '' AND landing_site <> site",
        "'Landing page domain ''' || landing_site || ''' differs from website domain ''' "
        "|| site || ''''", ()),
    "RESIDENTIAL_ADDRESS": (
        38, 4, "d JOIN rdi USING (address)", "rdi = 'Residential' AND high_risk",
        "'Address classified as Residential by SmartyStreets (RDI check)'", ("dims",)),
}

_EXTRAS = {"groups": GROUPS.rstrip().rstrip(","), "dims": DIMENSIONS, "copies": COPIES,
           "near": NEAR, "keywords": KEYWORD_TERMS}


def with_tables(query: str, *extras: str) -> str:
    parts = [BASE, DERIVED, *[_EXTRAS[name] for name in dict.fromkeys(extras)]]
    return "WITH " + ",".join(part.strip() for part in parts) + "\n" + query


def _flag_rows(flag: str) -> str:
    order, weight, source, condition, evidence, _ = FLAGS[flag]
    return (f"SELECT row_id, {order} AS ord, '{flag}' AS flag, {weight} AS weight, "
            f"{evidence} AS detail FROM {source} WHERE {condition}")


def flag_sql(flag: str) -> str:
    return with_tables(_flag_rows(flag), *FLAGS[flag][5])


ALL_EXTRAS = ("groups", "dims", "copies", "near", "keywords")


def scored(query: str, flags=tuple(FLAGS)) -> str:
    """A query over ``scored``: listings with the five output columns."""
    extras = [extra for flag in flags for extra in FLAGS[flag][5]] + ["copies"]
    fired = "\nUNION ALL ".join(_flag_rows(flag) for flag in flags)
    tail = f"""
, fired AS ({fired}),
per_row AS (
  SELECT row_id, CAST(sum(weight) AS INTEGER) AS spam_score,
         string_agg(flag, ', ' ORDER BY ord) AS flags_triggered,
         string_agg(flag || ': ' || detail, ' | ' ORDER BY ord) AS flag_details
  FROM fired GROUP BY row_id),
scored0 AS (
  SELECT l.*, coalesce(spam_score, 0) AS spam_score,
         coalesce(flags_triggered, '') AS flags_triggered,
         coalesce(flag_details, '') AS flag_details,
         CASE WHEN first_id <> row_id THEN CAST(first_id AS VARCHAR) ELSE '' END
           AS is_duplicate_of_row
  FROM listings l LEFT JOIN per_row USING (row_id) JOIN copies USING (row_id)),
scored AS (
  SELECT *, CASE WHEN spam_score >= 36 THEN 'High Confidence Spam'
                 WHEN spam_score >= 30 THEN 'Likely Spam'
                 WHEN spam_score >= 24 THEN 'Review' ELSE 'Clean' END AS risk_tier
  FROM scored0)
{query}"""
    return with_tables(tail, *extras)
