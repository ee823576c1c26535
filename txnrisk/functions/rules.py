"""The weighted rule set over one transaction row.

``with_rule_inputs`` coerces the raw fields once; every other function here reads only the
coerced columns, so the same rules run on files, tables and streams.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType

from txnrisk.functions import cleaning

# Rule weights, in evaluation order.
WEIGHTS = {
    "very_high_amount": 0.45,
    "high_amount_no_kyc": 0.35,
    "odd_hour": 0.30,
    "new_account_high": 0.40,
    "very_new_account": 0.30,
    "weekend_high": 0.20,
    "multi_factor": 0.25,
}

# Reason texts. {amt}, {age}, {hour} and {n} stand for the row's values.
REASONS = {
    "very_high_amount": "Extremely high amount: ₹{amt}",
    "high_amount_no_kyc": "High-value transaction (₹{amt}) without KYC verification",
    "odd_hour": "Large transaction (₹{amt}) during suspicious hours ({hour}:00)",
    "new_account_high": "Very new account ({age} days old) with high transaction (₹{amt})",
    "very_new_account": "Extremely new account ({age} days old) with ₹{amt} transaction",
    "weekend_high": "Weekend transaction with high amount (₹{amt})",
    "multi_factor": "Multiple risk factors present ({n} indicators)",
}
RULES_FAILED = "Rule evaluation failed - relying on ML model"


def _inputs() -> tuple[Column, ...]:
    """amount, age, kyc, hour, weekend as coerced."""
    return tuple(F.col(f"rule_{name}") for name in ("amount", "age", "kyc", "hour", "weekend"))


def with_rule_inputs(df: DataFrame, kyc_mode: str = "any") -> DataFrame:
    """Add the coerced inputs; a missing or bad value counts as 0, a bad time as unknown.

    ``rule_inputs_ok`` is false where a value is present but unusable.
    """
    def field(name: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast("string")

    def usable(name: str, kind: str, *words: str) -> Column:
        """Missing, one of the words, or of the wanted kind; a column that is a number already needs no look.

        Known words are looked up first: casting a text that is no number is slow.
        """
        col = field(name)
        if name in df.columns and isinstance(df.schema[name].dataType, NumericType):
            return F.lit(True)
        known = [F.lower(F.trim(col.cast("string"))).isin(*words)] if words else []
        return reduce(lambda a, b: a | b, [col.isNull(), *known, col.try_cast(kind).isNotNull()])

    amount, age, channel = field("transaction_amount"), field("account_age_days"), field("channel")
    kyc, when = field("kyc_verified"), cleaning.to_timestamp(field("timestamp"))
    return df.withColumns({
        "rule_amount": cleaning.number_or_zero(amount),
        "rule_age": cleaning.int_or_zero(age),
        "rule_channel": cleaning.int_or_zero(channel),
        "rule_kyc": cleaning.kyc_flag(kyc, kyc_mode),
        "rule_hour": F.hour(when),
        "rule_weekend": F.coalesce(F.weekday(when) >= 5, F.lit(False)),
        "rule_inputs_ok": (
            usable("transaction_amount", "double", "") & usable("account_age_days", "long") & usable("channel", "long")
            & usable("kyc_verified", "int", "yes", "y", "true", "no", "n", "false")
        ),
    })


def risk_factor_count() -> Column:
    """How many of: amount over 100000, no KYC, account under 60 days, hour before 6 or after 22."""
    amount, age, kyc, hour, _ = _inputs()
    night = F.coalesce((hour < 6) | (hour > 22), F.lit(False))
    flags = [amount > 100000, kyc == 0, age < 60, night]
    return reduce(lambda a, b: a + b, [f.cast("int") for f in flags])


def rule_hits() -> dict[str, Column]:
    """A boolean column per rule, in evaluation order; the two ``else`` rules exclude their sibling."""
    amount, age, kyc, hour, weekend = _inputs()
    # The cut-offs of amounts, ages and hours.
    very_high = amount > 500000
    new_high = (age < 30) & (amount > 100000)
    return {
        "very_high_amount": very_high,
        "high_amount_no_kyc": ~very_high & (amount > 100000) & (kyc == 0),
        "odd_hour": F.coalesce(hour.between(2, 5), F.lit(False)) & (amount > 25000),
        "new_account_high": new_high,
        "very_new_account": ~new_high & (age < 7) & (amount > 50000),
        "weekend_high": weekend & (amount > 200000),
        "multi_factor": risk_factor_count() >= 3,
    }


def rule_score() -> Column:
    """Sum of the weights that hit, added in rule order in double arithmetic, at most 1."""
    parts = [F.when(hit, F.lit(WEIGHTS[name])).otherwise(F.lit(0.0)) for name, hit in rule_hits().items()]
    return F.least(F.lit(1.0), reduce(lambda a, b: a + b, parts))


def _fill(template: str) -> Column:
    amount, age, _, hour, _ = _inputs()
    values = {
        "amt": F.format_number(amount, 0),
        "age": age.cast("string"),
        "hour": hour.cast("string"),
        "n": risk_factor_count().cast("string"),
    }
    pieces = []
    for chunk in template.split("{"):
        key, closed, rest = chunk.partition("}")
        pieces += [values[key], F.lit(rest)] if closed else [F.lit(chunk)]
    return F.concat(*pieces)


def rule_reasons() -> Column:
    """The texts of the rules that hit, in rule order."""
    return F.array_compact(F.array(*[F.when(hit, _fill(REASONS[name])) for name, hit in rule_hits().items()]))


def rules_hit() -> Column:
    """The names of the rules that hit, in rule order."""
    return F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, hit in rule_hits().items()]))


def apply_rules(df: DataFrame, strict: bool = False, kyc_mode: str = "any") -> DataFrame:
    """Add ``rule_score`` and ``reasons``.

    With ``strict`` a record holding an unusable value gets score 0 and the failure reason
    instead of having that value read as 0.
    """
    ready = with_rule_inputs(df, kyc_mode)
    score, reasons = rule_score(), rule_reasons()
    if strict:
        ok = F.col("rule_inputs_ok")
        score = F.when(ok, score).otherwise(F.lit(0.0))
        reasons = F.when(ok, reasons).otherwise(F.array(F.lit(RULES_FAILED)))
    return ready.withColumns({"rule_score": score, "reasons": reasons})
