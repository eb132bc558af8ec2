"""Row predicates that operators combine. Operators differ in which of them they apply; none is applied silently."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlake.functions.dates import day

INCOME_OR_SAVINGS = ("income", "salary", "investment", "savings", "interest")
#: Fixed values. The importer's own categories that are transfers, whole and in this case.
IMPORTER_TRANSFERS = ("TRANSFER_IN", "TRANSFER_OUT", "LOAN_PAYMENTS")
IMPORTER_TRANSFER_DETAILS = (
    "LOAN_PAYMENTS_CREDIT_CARD_PAYMENT",
    "LOAN_PAYMENTS_CAR_PAYMENT",
    "LOAN_PAYMENTS_MORTGAGE_PAYMENT",
    "LOAN_PAYMENTS_PERSONAL_LOAN_PAYMENT",
    "LOAN_PAYMENTS_STUDENT_LOAN_PAYMENT",
    "LOAN_PAYMENTS_OTHER_PAYMENT",
    "TRANSFER_IN_ACCOUNT_TRANSFER",
    "TRANSFER_IN_CASH_ADVANCES_AND_LOANS",
    "TRANSFER_IN_DEPOSIT",
    "TRANSFER_IN_SAVINGS",
    "TRANSFER_OUT_ACCOUNT_TRANSFER",
    "TRANSFER_OUT_SAVINGS",
    "TRANSFER_OUT_WITHDRAWAL",
)
#: Fixed values. Parts of our categories, and parts of merchants and descriptions, that mark a transfer.
TRANSFER_CATEGORIES = ("transfer", "transfers", "account transfer", "internal transfer", "bank transfer", "credit card payment", "cc payment", "card payment", "loan payment", "investment transfer", "brokerage transfer")
TRANSFER_PHRASES = (
    "transfer from",
    "transfer to",
    "xfer from",
    "xfer to",
    "zelle",
    "venmo cashout",
    "venmo to bank",
    "ach transfer",
    "ach pull",
    "ach push",
    "internal transfer",
    "payment to credit card",
    "credit card payment",
    "auto pay credit",
    "wire transfer",
)


def not_deleted() -> Column:
    return ~F.coalesce("deleted", F.lit(False))


def not_hidden() -> Column:
    return ~F.coalesce("is_hidden", F.lit(False))


def between(c: str, start: str | Column, end: str | Column) -> Column:
    """Both ends inclusive."""
    return F.col(c).between(day(start), day(end))


def posted_in(currency: Column) -> Column:
    """Not pending, and of the currency (case aside) unless either is blank."""
    mine, theirs = F.lower(F.trim(F.coalesce("currency_code", F.lit("")))), F.lower(F.trim(F.coalesce(currency, F.lit(""))))
    return ~F.coalesce("pending", F.lit(False)) & ((mine == "") | (theirs == "") | (mine == theirs))


def income_or_savings(category: Column) -> Column:
    return F.coalesce(F.lower(category).isin(*INCOME_OR_SAVINGS), F.lit(False))


def is_transfer() -> Column:
    """A self-transfer: by the importer's category, else by parts of our categories, of the merchant or of the description."""
    none = F.lit(False)
    own = F.coalesce(F.col("importer_category_primary").isin(*IMPORTER_TRANSFERS), none) | F.coalesce(F.col("importer_category_detailed").isin(*IMPORTER_TRANSFER_DETAILS), none)
    parts = [(c, TRANSFER_CATEGORIES) for c in ("category_primary", "category_detailed")] + [(c, TRANSFER_PHRASES) for c in ("merchant_name", "description")]
    for name, needles in parts:
        own = own | F.coalesce(F.lower(name).rlike("|".join(needles)), none)
    return own


def effective_category(default: str | None = None) -> Column:
    return F.coalesce(F.col("category_primary"), F.col("category_detailed"), F.lit(default))
