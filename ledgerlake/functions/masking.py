"""Privacy masks, statement fingerprints and fields of statement texts (rows F28, F35, F36, F39, F40, F45)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mask_account(c: Column) -> Column:
    """X and the last four; numbers of four or fewer characters, and masked ones, stay."""
    return F.when((F.length(c) <= 4) | c.rlike(r"^[Xx*]+\d{0,4}$"), c).otherwise(F.concat(F.lit("X"), F.right(c, F.lit(4))))


def mask_email(c: Column) -> Column:
    """First character, a star, the domain; what is no address becomes a star."""
    return F.when(c.rlike(r"^[^@]+@[^@]+$"), F.concat(F.substring(c, 1, 1), F.lit("*@"), F.substring_index(c, "@", -1))).when(c.isNotNull(), "*")


def user_today(at: Column, zone: Column, default: str = "America/Los_Angeles") -> Column:
    """The date at a UTC time where the user is."""
    return F.from_utc_timestamp(at, F.coalesce(zone, F.lit(default))).cast("date")


def format_fingerprint(fields: dict[str, Column], rows: Column) -> Column:
    """Which fields a statement has, and the size class of its rows, as a short digest."""
    bits = F.concat(*[F.when(c.isNotNull(), "1").otherwise("0") for c in fields.values()])
    size = F.when(rows == 0, "none").when(rows < 10, "few").when(rows < 50, "some").otherwise("many")
    return F.substring(F.sha1(F.concat_ws("|", bits, size)), 1, 12)


def reward_points(line: Column) -> Column:
    """A points balance in a statement line."""
    text = F.regexp_extract(F.lower(line), r"(?:points? balance|total points|rewards? balance)\D{0,20}([\d,]+)", 1)
    return F.when(text != "", F.replace(text, F.lit(","), F.lit("")).try_cast("bigint"))


def statement_balance(line: Column) -> Column:
    text = F.regexp_extract(F.lower(line), r"(?:new|statement|closing) balance\D{0,10}(-?[\d,]+\.\d{2})", 1)
    return F.when(text != "", F.replace(text, F.lit(","), F.lit("")).try_cast("decimal(19,2)"))


#: Two-letter states that close a merchant line.
STATES = "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY DC"


def split_location(c: Column) -> Column:
    """'NAME CITY ST' as (merchant, city, state); without a state at the end all of it is the merchant."""
    pattern = rf"^(.*?)\s+([A-Za-z.]+)\s+({'|'.join(STATES.split())})$"
    x = F.trim(c)
    hit = x.rlike(pattern)
    part = lambda k: F.when(hit, F.regexp_extract(x, pattern, k))
    return F.struct(F.coalesce(part(1), x).alias("merchant"), part(2).alias("city"), part(3).alias("state"))
