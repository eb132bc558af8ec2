"""What kind of subscription a charge is (rows F30, F31)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Types in order, the parts of merchant and description of which one must occur, and the categories that are asked for
#: too: a value of the primary one, or parts of the detailed one.
TYPES = [
    ("streaming", ("netflix", "hulu", "disney", "hbo", "paramount", "peacock", "spotify", "apple music", "youtube premium", "youtube tv", "youtube music", "youtubemusic", "amazon prime", "prime video", "showtime", "starz", "crunchyroll", "funimation"), "entertainment", ("streaming",)),
    ("streaming", ("youtube music", "youtubemusic"), None, ()),
    ("ai_service", ("openai", "chatgpt", "cursor", "anthropic", "meta ai", "claude"), None, ()),
    ("software", ("adobe", "microsoft 365", "office 365", "github", "canva", "grammarly", "notion", "evernote"), "tech", ("software", "saas")),
    ("news_media", ("barrons", "wsj", "wall street journal", "ny times", "new york times", "nytimes", "financial times", "ft.com", "moneycontrol", "marketwatch", "consumer reports", "health magazine", "the economist", "forbes", "time magazine", "the atlantic"), None, ()),
    ("membership", ("costco", "sam's club", "sams club", "bjs", "bj's", "walmart plus", "wmt plus", "target circle", "best buy totaltech", "best buy membership"), None, ()),
    ("other", ("insurance", "premium"), None, ()),
    ("membership", ("parking", "spothero", "parkmobile", "parkwhiz"), None, ()),
    ("membership", ("gym", "fitness", "health club", "sports club", "planet fitness", "equinox", "lifetime fitness", "peloton", "classpass", "orange theory", "crossfit", "yoga", "pilates", "barre"), None, ()),
    ("cloud_storage", ("dropbox", "icloud", "google drive", "google one", "onedrive", "box", "pcloud"), None, ("cloud",)),
    ("software", ("nordvpn", "expressvpn", "surfshark"), None, ()),
    ("membership", ("lyft pink", "uber one"), None, ()),
]
SUBSCRIPTION_CATEGORIES = ("subscriptions", "streaming", "software", "membership", "cloud_storage", "tech", "entertainment", "health", "insurance", "education")


def _text() -> Column:
    return F.lower(F.concat(F.coalesce("merchant_name", F.lit("")), F.lit(" "), F.coalesce("description", F.lit(""))))


def _any(text: Column, parts: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | text.contains(p)
    return found


def subscription_type() -> Column:
    """The first type that a row's merchant and description name (where a type asks for a category, with that); else other."""
    text, primary, detailed = _text(), F.lower(F.coalesce("category_primary", F.lit(""))), F.lower(F.coalesce("category_detailed", F.lit("")))
    out = F.when(F.lit(False), "other")
    for name, parts, category, details in TYPES:
        found = _any(text, parts)
        if category or details:
            found = found & ((primary == (category or "\0")) | _any(detailed, details))
        if name == "other":
            found = found | primary.contains("insurance")
        out = out.when(found, name)
    return out.otherwise("other")


def subscription_category() -> Column:
    """subscription, where category or type say so; else recurring (large loan-like payments, utilities, bills and whatever is left)."""
    primary = F.lower(F.coalesce("category_primary", F.lit("")))
    listed = primary.isin(*[c for c in SUBSCRIPTION_CATEGORIES if c not in ("insurance", "loans", "mortgage")])
    says_so = (F.lower(F.coalesce("category_detailed", F.lit(""))) == "subscriptions") | listed | (subscription_type() != "other")
    return F.when(says_so, "subscription").otherwise("recurring")
