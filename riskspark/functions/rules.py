"""Rule tables and scalar column functions for flags, decisions and codes.

Rules are data (ordered ``(code, predicate)`` lists) turned into one
``array_compact(array(when(...)))`` expression, so every rule set stays
JVM-side inside whole-stage codegen and can be extended by callers.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's behaviour.
REVIEW_THRESHOLD = 0.30
BLOCK_THRESHOLD = 0.70
ALLOWED_CHANNELS = ("CARD", "UPI", "NET_BANKING", "WALLET")
MIN_AMOUNT = 0.01
MAX_AMOUNT = 100000000.0
CHANNEL_MAPPING = {"CARD": "Credit Card", "NET_BANKING": "Wire", "UPI": "ACH", "WALLET": "Cash"}
MODEL_FEATURES = (
    "amount", "payment_channel", "time_since_last_transaction", "velocity_score",
    "spending_deviation_score", "is_first_transaction", "hour", "day_of_week",
    "month", "is_weekend", "is_cross_bank_transfer", "is_cross_currency_transfer",
    "is_new_receiver", "is_new_bank", "is_new_payment_format",
)
NO_REASON = "NO_SIGNIFICANT_RISK_SIGNALS"

Rule = tuple[str, Callable[[], Column]]


def flag_array(rules: Sequence[tuple[str, Column]]) -> Column:
    """Ordered codes of the rules that hold (empty array when none)."""
    return F.array_compact(F.array(*[F.when(pred, F.lit(code)) for code, pred in rules]))


def decision(p: Column | str, review: float = REVIEW_THRESHOLD,
             block: float = BLOCK_THRESHOLD) -> Column:
    """O-53: BLOCK at >= block, REVIEW at >= review, else ALLOW."""
    p = F.col(p) if isinstance(p, str) else p
    return (F.when(p >= block, "BLOCK").when(p >= review, "REVIEW").otherwise("ALLOW"))


def reason_rules() -> list[tuple[str, Column]]:
    """O-55: the ten ordered reason-code rules over a feature row."""
    c = F.col
    return [
        ("HIGH_TRANSACTION_AMOUNT", c("amount") > 50000),
        ("HIGH_TRANSACTION_VELOCITY", c("velocity_score") > 0.8),
        ("UNUSUAL_SPENDING_PATTERN", c("spending_deviation_score") > 0.8),
        ("FIRST_TRANSACTION", c("is_first_transaction") == 1),
        ("NEW_RECEIVER", c("is_new_receiver") == 1),
        ("NEW_BANK", c("is_new_bank") == 1),
        ("CROSS_BANK_TRANSFER", c("is_cross_bank_transfer") == 1),
        ("CROSS_CURRENCY_TRANSFER", c("is_cross_currency_transfer") == 1),
        ("NEW_PAYMENT_FORMAT", c("is_new_payment_format") == 1),
        ("ODD_TRANSACTION_HOUR", (c("hour") >= 0) & (c("hour") <= 5)),
    ]


def reason_codes(rules: Sequence[tuple[str, Column]] | None = None) -> Column:
    codes = flag_array(rules or reason_rules())
    return F.when(F.size(codes) == 0, F.array(F.lit(NO_REASON))).otherwise(codes)


def risk_flag_rules() -> list[tuple[str, Column]]:
    """O-44: the eight ordered online risk-flag rules."""
    c = F.col
    return [
        ("AMOUNT_OUTLIER", F.abs(c("amount_z_score")) >= 3),
        ("HIGH_VELOCITY", c("velocity_1h") > 10),
        ("NEW_MERCHANT", c("new_merchant")),
        ("NEW_DEVICE", c("new_device")),
        ("NEW_LOCATION", c("new_location")),
        ("PAYMENT_METHOD_CHANGED", c("payment_method_changed")),
        ("OUTSIDE_USUAL_CITY", c("outside_usual_city")),
        ("OUTSIDE_ACTIVE_HOURS", c("outside_active_hours")),
    ]


def validation_rules(amount: str = "amount", channel: str = "payment_channel",
                     min_amount: float = MIN_AMOUNT, max_amount: float = MAX_AMOUNT,
                     channels: Sequence[str] = ALLOWED_CHANNELS) -> list[tuple[str, Column]]:
    """O-03: request-level checks; a row is rejected when any code fires."""
    a, ch = F.col(amount), F.col(channel)
    return [
        ("MISSING_AMOUNT", a.isNull()),
        ("AMOUNT_BELOW_MIN", a < min_amount),
        ("AMOUNT_ABOVE_MAX", a > max_amount),
        ("MISSING_CHANNEL", ch.isNull()),
        ("UNSUPPORTED_CHANNEL", ~ch.isin(*channels)),
    ]


def feature_range_rules() -> list[tuple[str, Column]]:
    """O-03/O-116: ranges of the 16-column feature row (z may be negative)."""
    c = F.col
    flags = ["is_first_transaction", "is_weekend", "is_cross_bank_transfer",
             "is_cross_currency_transfer", "is_new_receiver", "is_new_bank",
             "is_new_payment_format"]
    rules = [
        ("BAD_HOUR", ~c("hour").between(0, 23)),
        ("BAD_DAY_OF_WEEK", ~c("day_of_week").between(0, 6)),
        ("BAD_MONTH", ~c("month").between(1, 12)),
        ("NEGATIVE_TIME_SINCE_LAST", c("time_since_last_transaction") < 0),
        ("NEGATIVE_VELOCITY", c("velocity_score") < 0),
        ("BAD_AMOUNT", c("amount").isNull() | (c("amount") < 0) | F.isnan(c("amount"))
         | (F.abs(c("amount")) == float("inf"))),
    ]
    rules += [(f"BAD_{f.upper()}", ~c(f).isin(0, 1)) for f in flags]
    return rules


def channel_mapped(channel: Column | str) -> Column:
    """O-50 first step: request channel name -> training channel name."""
    ch = F.col(channel) if isinstance(channel, str) else channel
    m = F.create_map(*[F.lit(x) for kv in CHANNEL_MAPPING.items() for x in kv])
    return F.coalesce(m[ch], ch)
