"""Read facts back out of reason texts, and fill the explanation prompt."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from txnrisk.functions import cleaning

# The patterns that recognise the reason texts.
AMOUNT_PATTERN = r"₹([\d,]+(?:\.\d+)?)"
AGE_PATTERN = r"\((\d+) days old\)"
HOUR_PATTERN = r"during suspicious hours \((\d+):00\)"

# Fixed value: the prompt text; {name} stands for a value of the row.
PROMPT = """
        You are a fraud detection expert analyzing a banking transaction. Provide a clear, professional explanation.

        Transaction Details:
        - Amount: ₹{amount}
        - Account Age: {account_age} days
        - Channel: {channel}
        - KYC Verified: {kyc}
        - Timestamp: {timestamp}

        Model Analysis:
        - Prediction: {prediction}
        - Risk Score: {risk_score}%
        - ML Confidence: {ml_prob}%
        - Rule Engine Score: {rule_score}%
        - Category: {category}
        - Risk Factors: {factors}

        Provide a brief (3-4 sentences) professional explanation of why this transaction was classified as {prediction}.
        Focus on the key risk indicators and what actions should be taken. Be specific and actionable.
        """


def _found(reasons: Column, pattern: str) -> Column:
    """The captured text of every reason that matches."""
    return F.filter(F.transform(reasons, lambda r: F.regexp_extract(r, pattern, 1)), lambda m: m != "")


def amount_from_reasons(reasons: Column, default: float = 0.0) -> Column:
    amounts = F.transform(_found(reasons, AMOUNT_PATTERN), lambda m: F.replace(m, F.lit(","), F.lit("")).try_cast("double"))
    return F.coalesce(F.get(F.array_compact(amounts), F.lit(0)), F.lit(default))


def age_from_reasons(reasons: Column, default: int = 0) -> Column:
    ages = F.transform(_found(reasons, AGE_PATTERN), lambda m: m.try_cast("int"))
    return F.coalesce(F.get(F.array_compact(ages), F.lit(0)), F.lit(default))


def kyc_from_reasons(reasons: Column, default: bool = True) -> Column:
    missing = F.exists(reasons, lambda r: F.lower(r).rlike("without kyc|no kyc"))
    return F.when(missing, "No").otherwise("Yes" if default else "No")


def when_from_reasons(reasons: Column) -> Column:
    hours = _found(reasons, HOUR_PATTERN)
    hour = F.when(F.size(hours) > 0, F.concat(F.lit("Around "), F.element_at(hours, -1), F.lit(":00")))
    weekend = F.exists(reasons, lambda r: F.lower(r).contains("weekend transaction"))
    return (F.when(weekend & hour.isNotNull(), F.concat(F.lit("During the weekend, "), F.lower(hour)))
            .when(hour.isNotNull(), hour)
            .when(weekend, "During the weekend").otherwise("N/A"))


def explanation_prompt(amount: Column, age: Column, channel: Column, kyc: Column, timestamp: Column,
                       label: Column, risk: Column, ml: Column, rule: Column, category: Column,
                       reasons: Column) -> Column:
    """The prompt filled from the raw record, falling back to what the reasons say."""
    known_amount, written = cleaning.to_double(amount), F.trim(amount.cast("string"))
    # A blank or zero amount is looked up in the reasons; an unreadable one is shown as 0.
    blank = written.isNull() | (written == "") | F.coalesce(amount.try_cast("double") == 0, F.lit(False))
    time_text = timestamp.cast("string")
    values = {
        "amount": F.format_number(F.when(blank, amount_from_reasons(reasons))
                                  .otherwise(F.coalesce(known_amount, F.lit(0.0))), 2),
        "account_age": F.when(age.isNull(), age_from_reasons(reasons)).otherwise(cleaning.int_or_zero(age)).cast("string"),
        "channel": cleaning.channel_name(channel),
        "kyc": F.when(cleaning.kyc_flag(kyc) == 1, "Yes").otherwise("No"),
        "timestamp": F.when(time_text.isNull() | (time_text == ""), when_from_reasons(reasons)).otherwise(
            F.coalesce(F.date_format(cleaning.to_timestamp(timestamp), "yyyy-MM-dd HH:mm:ss"), time_text)),
        "prediction": label,
        "risk_score": F.format_number(risk * 100, 1),
        "ml_prob": F.format_number(ml * 100, 1),
        "rule_score": F.format_number(rule * 100, 1),
        "category": category,
        "factors": F.when(F.size(reasons) > 0, F.array_join(reasons, ", ")).otherwise("None detected"),
    }
    pieces = []
    for chunk in PROMPT.split("{"):
        key, closed, rest = chunk.partition("}")
        pieces += [values[key], F.lit(rest)] if closed else [F.lit(chunk)]
    return F.concat(*pieces)
