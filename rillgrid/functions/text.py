"""Complaint text expressions; everything runs inside the JVM."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _holds(text: Column, pattern: str) -> Column:
    """Whether the pattern occurs; plain words are searched as such, which is far cheaper than an alternation."""
    if re.search(r"[\\.\[\](){}*+?^$]", pattern):
        return text.rlike(pattern)
    return reduce(or_, [text.contains(w) for w in pattern.split("|")])


# Keyword patterns of the complaint classes, first match wins.
COMPLAINT_PATTERNS = (
    ("악취", "악취|냄새"),
    ("역류", "역류|넘침|범람"),
    ("파손", "파손|파열|침하"),
)
COMPLAINT_OTHER = "기타"

PHONE = r"(?:\+?\d{1,3}[-. ])?\(?\d{2,4}\)?[-. ]\d{3,4}[-. ]\d{4}"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
NAME = r"(성명|이름|민원인|name)\s*[:：]\s*[^\s,.;]+"


def classify_keyword(text, patterns=COMPLAINT_PATTERNS, other: str = COMPLAINT_OTHER) -> Column:
    """Label of the first pattern found in the text; missing text is ``other``."""
    body = F.coalesce(_c(text), F.lit(""))
    out = None
    for label, pattern in patterns:
        hit = _holds(body, pattern)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(other)


def mask_pii(text) -> Column:
    """Replace e-mail addresses, phone numbers and labelled names."""
    t = _c(text)
    # a plain substring test spares most texts the costly patterns
    masked = F.when(t.contains("@"), F.regexp_replace(t, EMAIL, "[EMAIL]")).otherwise(t)
    masked = F.regexp_replace(masked, PHONE, "[PHONE]")
    return F.when(t.rlike("[:：]"), F.regexp_replace(masked, NAME, "$1: [NAME]")).otherwise(masked)


def text_key(text) -> Column:
    return F.sha1(_c(text).cast("binary"))


def normalise_address(text) -> Column:
    """Trim, and reduce every run of blanks to one."""
    return F.trim(F.regexp_replace(_c(text), r"\s+", " "))


def district_of(address) -> Column:
    """First word that ends like a district name, else null."""
    # a match starts where its word does, so that the rest of a long word is not tried again from each character
    t = _c(address)
    return F.when(_is_district(t), F.regexp_extract(t, r"(?<!\S)(\S+?[동읍면리가])(?:\s|$|\d)", 1))


def _is_district(t: Column) -> Column:
    return _holds(t, "동|읍|면|리|가") & t.rlike(r"\S[동읍면리가](?:\s|$|\d)")


# Words that place or rank a complaint, by language of the text.
RAIN_WORDS = r"비|호우|폭우|장마|rain|storm"
URGENT_WORDS = r"긴급|위험|인명|즉시|urgent|danger"
SOON_WORDS = r"빨리|조속|신속|soon|quick"
# Both begin where their run of characters does, and are tried nowhere else: long runs cost their length, not its square.
LOT_NUMBER = r"(?<!\d)(?:\d++(?:-\d++)?번지|\d++-\d++)"
ROAD_NUMBER = r"(?<![가-힣A-Za-z0-9])[가-힣A-Za-z0-9]+[로길]\s?\d+"
BUILDING = r"아파트|빌라|상가|building|apartment"


def extract_fields(text) -> Column:
    """Rule form of complaint structuring: place text, class, rain flag, urgency, precision."""
    t = F.coalesce(_c(text), F.lit(""))
    # whether there is one shows in two or three characters; only texts that have one meet the whole pattern
    lot = _holds(t, "번지|-") & t.rlike(r"\d(?:번지|-\d)")
    road = _holds(t, "로|길") & t.rlike(r"[가-힣A-Za-z0-9][로길]\s?\d")
    return F.struct(
        F.when(lot | road, F.regexp_extract(t, rf"({ROAD_NUMBER}|{LOT_NUMBER})", 1)).alias("location_text"),
        classify_keyword(t).alias("type"),
        _holds(t, RAIN_WORDS).alias("rain_related"),
        F.when(_holds(t, URGENT_WORDS), 3).when(_holds(t, SOON_WORDS), 2).otherwise(1).alias("urgency"),
        F.when(lot, "lot")
        .when(road, "road")
        .when(_holds(t, BUILDING), "building")
        .when(_is_district(t), "district")
        .otherwise("unknown")
        .alias("precision"),
    )
