"""The registered queries once more as independent SQL over the given tables, in DuckDB's dialect."""

from __future__ import annotations


def _txn(table: str, key: str, customer: str, amount: str, when: str) -> str:
    prob = f"(({key} * 7919) % 10007) / 10007.0e0"
    return f"""
    SELECT {key} AS transaction_id, {customer} AS customer_id, floor({amount} * 100 + 0.5e0) / 100 AS transaction_amount,
           ({key} * 11) % 397 AS account_age_days, {key} % 4 AS channel,
           CASE WHEN {key} % 5 < 3 THEN 'Yes' ELSE 'No' END AS kyc_verified, {when} AS "timestamp",
           {key} % 4 AS transaction_type, ({key} // 4) % 5 AS location, {key} % 3 AS currency,
           {prob} AS ml_prob,
           CASE WHEN (({key} * 104729) % 1000) / 1000.0e0 < 0.4e0 * ({prob}) * ({prob}) THEN 1 ELSE 0 END AS is_fraud
    FROM {table}"""


ORDERS = _txn("orders", "o_orderkey", "o_custkey", "o_totalprice * 1.5e0", "o_orderdate + to_hours(((o_orderkey * 7) % 24)::INTEGER)")
EVENTS = _txn("events", "event_id", "user_id", "value * 4000.0e0", "ts")

_HITS = """
    SELECT *, amt > 500000 AS h2, amt <= 500000 AND amt > 100000 AND kyc = 0 AS h3,
           coalesce(hr BETWEEN 2 AND 5, false) AND amt > 25000 AS h4, age < 30 AND amt > 100000 AS h5,
           NOT (age < 30 AND amt > 100000) AND age < 7 AND amt > 50000 AS h6, wend AND amt > 200000 AS h7,
           (amt > 100000)::INT + (kyc = 0)::INT + (age < 60)::INT + coalesce(hr < 6 OR hr > 22, false)::INT AS factors
    FROM rin"""
_RULED = """
    SELECT *, least(1.0e0, (CASE WHEN h2 THEN 0.45e0 ELSE 0e0 END) + (CASE WHEN h3 THEN 0.35e0 ELSE 0e0 END)
             + (CASE WHEN h4 THEN 0.30e0 ELSE 0e0 END) + (CASE WHEN h5 THEN 0.40e0 ELSE 0e0 END)
             + (CASE WHEN h6 THEN 0.30e0 ELSE 0e0 END) + (CASE WHEN h7 THEN 0.20e0 ELSE 0e0 END)
             + (CASE WHEN factors >= 3 THEN 0.25e0 ELSE 0e0 END)) AS rule_score,
           list_filter([
             CASE WHEN h2 THEN 'Extremely high amount: ₹' || format('{:,.0f}', amt) END,
             CASE WHEN h3 THEN 'High-value transaction (₹' || format('{:,.0f}', amt) || ') without KYC verification' END,
             CASE WHEN h4 THEN 'Large transaction (₹' || format('{:,.0f}', amt) || ') during suspicious hours (' || hr || ':00)' END,
             CASE WHEN h5 THEN 'Very new account (' || age || ' days old) with high transaction (₹' || format('{:,.0f}', amt) || ')' END,
             CASE WHEN h6 THEN 'Extremely new account (' || age || ' days old) with ₹' || format('{:,.0f}', amt) || ' transaction' END,
             CASE WHEN h7 THEN 'Weekend transaction with high amount (₹' || format('{:,.0f}', amt) || ')' END,
             CASE WHEN factors >= 3 THEN 'Multiple risk factors present (' || factors || ' indicators)' END],
             lambda x: x IS NOT NULL) AS reasons
    FROM hits"""
_FUSED = """
    SELECT *, round(CASE WHEN ml_prob > 0.8e0 OR ml_prob < 0.2e0 THEN 0.8e0 * ml_prob + 0.2e0 * rule_score
                         ELSE 0.6e0 * ml_prob + 0.4e0 * rule_score END, 4) AS risk_score,
           (ml_prob >= 0.5e0)::INT AS predicted FROM ruled"""
_SCORED = """
    SELECT *, CASE WHEN risk_score >= 0.45e0 OR (ml_prob >= 0.5e0 AND rule_score >= 0.6e0) THEN 'Fraud'
                   WHEN ml_prob >= 0.5e0 OR rule_score >= 0.6e0 THEN 'Suspicious' ELSE 'Legit' END AS final_label,
           round(ml_prob, 6) AS probability, customer_id % 7 AS user_id, "timestamp" AS created_at FROM fused"""
_ALERTS = """
    SELECT transaction_id AS alert_id, transaction_id, customer_id, risk_score,
           CASE WHEN len(reasons) > 0 THEN array_to_string(reasons, '; ') ELSE 'ML Model Detection' END AS reason,
           ml_prob, rule_score, created_at FROM scored WHERE final_label = 'Fraud'"""

CLEAN_INPUTS = """
    SELECT *, transaction_amount AS amt, account_age_days AS age, (kyc_verified = 'Yes')::INT AS kyc,
           hour("timestamp") AS hr, isodow("timestamp") >= 6 AS wend FROM txn"""


def chain(view: str, inputs: str = CLEAN_INPUTS, extra: str = "") -> str:
    """CTEs txn, rin, hits, ruled, fused, scored, alerts (plus ``extra`` ones)."""
    return (f"WITH txn AS ({view}), rin AS ({inputs}), hits AS ({_HITS}), ruled AS ({_RULED}), "
            f"fused AS ({_FUSED}), scored AS ({_SCORED}), alerts AS ({_ALERTS}){extra}\n")


def txn(view: str, extra: str = "") -> str:
    return f"WITH txn AS ({view}){extra}\n"


_DIRTY_COLUMNS = """
    SELECT transaction_id, customer_id, ml_prob, is_fraud,
           CASE transaction_id % 11 WHEN 0 THEN '1,000' WHEN 1 THEN 'abc' WHEN 2 THEN '' WHEN 3 THEN 'nan' WHEN 4 THEN NULL
                ELSE transaction_amount::VARCHAR END AS transaction_amount,
           CASE transaction_id % 13 WHEN 0 THEN '12.5' WHEN 1 THEN NULL WHEN 2 THEN 'old' WHEN 3 THEN '3000000000'
                ELSE account_age_days::VARCHAR END AS account_age_days,
           CASE transaction_id % 7 WHEN 0 THEN '9' WHEN 1 THEN NULL WHEN 2 THEN 'web' ELSE channel::VARCHAR END AS channel,
           CASE transaction_id % 11 WHEN 0 THEN ' yes ' WHEN 1 THEN '1' WHEN 2 THEN 'true' WHEN 3 THEN '1.7' WHEN 4 THEN 'N'
                WHEN 5 THEN NULL WHEN 6 THEN '1.0' WHEN 7 THEN '2' ELSE kyc_verified END AS kyc_verified,
           CASE transaction_id % 17 WHEN 0 THEN 'garbage' WHEN 1 THEN '2025-13-01' WHEN 2 THEN NULL WHEN 3 THEN '2025/01/02 03:04'
                WHEN 4 THEN '01/02/2025 03:04:00' WHEN 5 THEN 'Jan 2 2025 03:00' WHEN 6 THEN '2025-01-01T03:00:00+05:30'
                ELSE strftime("timestamp", '%Y-%m-%d %H:%M:%S') END AS "timestamp"
    FROM clean"""
DIRTY = f"SELECT * FROM (WITH clean AS ({ORDERS}) {_DIRTY_COLUMNS})"
_INT = "coalesce(CASE WHEN regexp_full_match(trim({c}), '[+-]?[0-9]+') THEN {c}::BIGINT END, 0)"
_AMT = "coalesce(CASE WHEN NOT isnan(TRY_CAST(transaction_amount AS DOUBLE)) THEN TRY_CAST(transaction_amount AS DOUBLE) END, 0e0)"
_KYC = """(coalesce(lower(trim(kyc_verified)), '') IN ('yes', 'y', 'true', '1')
            OR coalesce(abs(TRY_CAST(trim(kyc_verified) AS DOUBLE)) >= 1, false))::INT"""
_TIME = """coalesce(TRY_CAST(regexp_replace("timestamp", '(:[0-9][0-9])[+-][0-9][0-9]:[0-9][0-9]$', '\\1') AS TIMESTAMP),
            try_strptime("timestamp", '%Y/%m/%d %H:%M'), try_strptime("timestamp", '%m/%d/%Y %H:%M:%S'), try_strptime("timestamp", '%b %d %Y %H:%M'))"""
DIRTY_INPUTS = f"""
    SELECT *, {_AMT} AS amt, {_INT.format(c='account_age_days')} AS age, {_INT.format(c='channel')} AS chan, {_KYC} AS kyc,
           hour({_TIME}) AS hr, coalesce(isodow({_TIME}) >= 6, false) AS wend,
           (transaction_amount IS NULL OR trim(transaction_amount) = '' OR TRY_CAST(transaction_amount AS DOUBLE) IS NOT NULL)
           AND (account_age_days IS NULL OR regexp_full_match(trim(account_age_days), '[+-]?[0-9]+'))
           AND (channel IS NULL OR regexp_full_match(trim(channel), '[+-]?[0-9]+'))
           AND (kyc_verified IS NULL OR regexp_full_match(trim(kyc_verified), '[+-]?[0-9]+')
                OR lower(trim(kyc_verified)) IN ('yes', 'y', 'true', 'no', 'n', 'false')) AS ok
    FROM txn"""

_BOUNDS = """, q AS (SELECT quantile_cont(transaction_amount, 0.25) AS q1, quantile_cont(transaction_amount, 0.75) AS q3 FROM txn),
     b AS (SELECT q1 - 1.5e0 * (q3 - q1) AS lower, q3 + 1.5e0 * (q3 - q1) AS upper FROM q)"""
_SKEWED = f"""SELECT * REPLACE (CASE WHEN transaction_id % 40 = 0 THEN transaction_amount * 10 ELSE transaction_amount END AS transaction_amount)
    FROM ({ORDERS})"""
_CURVE = """, s AS (SELECT ml_prob AS threshold, sum(is_fraud) AS pos, sum(1 - is_fraud) AS neg FROM txn GROUP BY 1),
     c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n
           FROM s WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)),
     pr AS (SELECT threshold, tp / (tp + fp)::DOUBLE AS "precision", tp / p::DOUBLE AS recall, tp, fp, pos, neg, p, n FROM c)"""
_CONFUSION = """, m AS (SELECT count(*) FILTER (predicted = 0 AND is_fraud = 0) AS tn, count(*) FILTER (predicted = 1 AND is_fraud = 0) AS fp,
     count(*) FILTER (predicted = 0 AND is_fraud = 1) AS fn, count(*) FILTER (predicted = 1 AND is_fraud = 1) AS tp
     FROM (SELECT *, (ml_prob >= 0.5e0)::INT AS predicted FROM txn))"""
_SINCE = "created_at >= (SELECT max(created_at) FROM alerts) - INTERVAL {days} DAY"
_TOP = f"""(SELECT customer_id, count(*) AS fraud_count, avg(risk_score) AS avg_risk FROM alerts
    WHERE {_SINCE.format(days=7)} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)"""
_TREND = f"""(SELECT created_at::DATE AS date, count(*) AS count, avg(risk_score) AS avg_risk FROM alerts
    WHERE {_SINCE.format(days=30)} GROUP BY 1)"""
_BAND = """(SELECT CASE WHEN risk_score < 0.3e0 THEN 'Low' WHEN risk_score < 0.6e0 THEN 'Medium' WHEN risk_score < 0.8e0 THEN 'High'
    ELSE 'Critical' END AS risk_level, count(*) AS count FROM alerts GROUP BY 1)"""
_CHANNEL = """(SELECT CASE channel WHEN 0 THEN 'Mobile' WHEN 1 THEN 'POS' WHEN 2 THEN 'ATM' WHEN 3 THEN 'Web' ELSE 'Unknown' END AS channel,
    count(*) AS fraud_count, avg(f.risk_score) AS avg_risk FROM alerts f JOIN txn t USING (transaction_id) GROUP BY 1)"""
_CATEGORY = """CASE WHEN rule_score > 0.7e0 AND ml_prob < 0.3e0 THEN 'Rule-Based Fraud'
    WHEN ml_prob > 0.7e0 AND rule_score < 0.3e0 THEN 'ML-Detected Anomaly'
    WHEN ml_prob > 0.5e0 AND rule_score > 0.5e0 THEN 'High-Confidence Fraud'
    WHEN contains(lower(joined), 'amount') THEN 'Amount-Related Suspicion' WHEN contains(lower(joined), 'kyc') THEN 'Verification Issue'
    WHEN contains(lower(joined), 'hour') OR contains(lower(joined), 'weekend') THEN 'Timing Anomaly'
    WHEN contains(lower(joined), 'account') THEN 'New Account Risk' ELSE 'General Suspicion' END"""
_MESSAGE = """CASE final_label WHEN 'Fraud' THEN CASE WHEN joined <> '' THEN '🚨 High risk detected: ' || joined
      WHEN ml_prob >= 0.75e0 THEN '🤖 ML model detected high fraud probability' ELSE '⚠️ Suspicious activity detected' END
    WHEN 'Suspicious' THEN '⚠️ Suspicious - requires review: ' || CASE WHEN joined <> '' THEN joined ELSE 'Pattern anomaly detected' END
    ELSE CASE WHEN ml_prob < 0.1e0 AND rule_score < 0.1e0 THEN '✅ Transaction appears safe'
      WHEN ml_prob < 0.3e0 THEN '✓ Transaction appears legitimate' ELSE 'ℹ️ Low risk - monitor if unusual' END END"""
_PCT = "format('{:.0f}', risk_score * 100)"
_EXPLAIN = f"""CASE final_label WHEN 'Fraud' THEN 'This transaction shows ' ||
      CASE WHEN risk_score >= 0.8e0 THEN 'very high risk' WHEN risk_score >= 0.6e0 THEN 'high risk' ELSE 'moderate risk' END ||
      ' of fraud (Risk Score: ' || {_PCT} || '%).' ||
      CASE WHEN joined <> '' THEN ' Key concerns: ' || array_to_string(reasons[1:2], '; ') ELSE '' END || ' Action: ' ||
      CASE WHEN risk_score >= 0.8e0 THEN 'Immediate verification required. Block transaction and contact customer.'
           WHEN risk_score >= 0.6e0 THEN 'Manual review recommended. Verify with customer before processing.'
           ELSE 'Additional verification recommended before approval.' END
    WHEN 'Suspicious' THEN 'This transaction shows mixed signals (Risk Score: ' || {_PCT} || '%). Some risk indicators present but not conclusive. Recommend monitoring customer activity and consider additional verification for high-value transactions.'
    ELSE CASE WHEN risk_score < 0.2e0 THEN 'This transaction appears safe with very low risk indicators (Risk Score: ' || {_PCT} || '%). Customer profile and transaction pattern are normal. Proceed with standard processing.'
      ELSE 'This transaction is classified as legitimate but shows some minor risk indicators (Risk Score: ' || {_PCT} || '%). Continue monitoring but no immediate action required.' END END"""
_JOINED = ", j AS (SELECT *, array_to_string(reasons, '; ') AS joined FROM scored)"
_RAMT = r"nullif(regexp_extract(joined, '₹([\d,]+(?:\.\d+)?)', 1), '')"
_RAGE = r"nullif(regexp_extract(joined, '\((\d+) days old\)', 1), '')"
_RHOUR = r"nullif(regexp_extract(joined, 'during suspicious hours \((\d+):00\)', 1), '')"
_WHEN = f"""CASE WHEN contains(joined, 'Weekend transaction') AND {_RHOUR} IS NOT NULL THEN 'During the weekend, around ' || {_RHOUR} || ':00'
    WHEN {_RHOUR} IS NOT NULL THEN 'Around ' || {_RHOUR} || ':00' WHEN contains(joined, 'Weekend transaction') THEN 'During the weekend' ELSE 'N/A' END"""
_LABEL_EVENTS = """, tenth AS (SELECT transaction_id, user_id, is_fraud AS label, 1 AS seq FROM scored WHERE transaction_id % 10 = 0),
     ev AS (SELECT * FROM tenth
            UNION ALL SELECT transaction_id, user_id, 2, 2 FROM tenth WHERE transaction_id % 50 = 0
            UNION ALL SELECT -1 - transaction_id, user_id, label, 3 FROM tenth WHERE transaction_id % 50 = 0
            UNION ALL SELECT transaction_id, user_id + 1, label, 4 FROM tenth WHERE transaction_id % 50 = 0
            UNION ALL SELECT transaction_id, user_id, 1 - label, 5 FROM tenth WHERE transaction_id % 30 = 0),
     st AS (SELECT ev.*, CASE WHEN label NOT IN (0, 1) THEN 400 WHEN s.transaction_id IS NULL THEN 404
                              WHEN s.user_id <> ev.user_id THEN 403 ELSE 200 END AS status
            FROM ev LEFT JOIN scored s ON s.transaction_id = ev.transaction_id),
     last AS (SELECT transaction_id, arg_max(label, seq) AS actual_label FROM st WHERE status = 200 GROUP BY 1),
     lab AS (SELECT s.transaction_id, s.user_id, s.predicted, s.probability, l.actual_label FROM scored s LEFT JOIN last l USING (transaction_id))"""


def _user_metrics(user: int, truth: str, where: str, kind: str) -> str:
    labelled = "n" if kind == "real" else "0"
    said = " reviewed transactions" if kind == "real" else " total transactions (self-consistency check)"
    return f"""{_LABEL_EVENTS}, r AS (SELECT predicted, probability, {truth} AS y FROM lab WHERE user_id = {user} AND {where}),
     m AS (SELECT count(*) AS n, count(*) FILTER (predicted = 1 AND y = 1) AS tp, count(*) FILTER (predicted = 0 AND y = 0) AS tn,
                  count(*) FILTER (predicted = 1 AND y = 0) AS fp, count(*) FILTER (predicted = 0 AND y = 1) AS fn FROM r),
     k AS (SELECT y, rank() OVER (ORDER BY probability) + (count(*) OVER (PARTITION BY probability) - 1) / 2.0e0 AS rk FROM r),
     a AS (SELECT (sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0e0)
                  / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) AS auc FROM k)
     SELECT round((tp + tn) / n, 4) AS accuracy, round(tp / (tp + fp), 4) AS "precision", round(tp / (tp + fn), 4) AS recall,
            round(2 * tp / (2 * tp + fp + fn), 4) AS f1_score, tp AS true_positives, tn AS true_negatives, fp AS false_positives,
            fn AS false_negatives, round(auc, 4) AS auc, {labelled} AS labeled_count, '{kind}' AS metrics_type,
            'Based on ' || n || '{said}' AS message FROM m, a"""


def _describe(columns: list[str]) -> str:
    return " UNION ALL ".join(f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
        min({c})::DOUBLE AS min, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50,
        round(quantile_cont({c}, 0.75), 6) AS q75, max({c})::DOUBLE AS max FROM txn""" for c in columns)


def _counts(columns: list[str]) -> str:
    return " UNION ALL ".join(f"""SELECT '{c}' AS field, {c}::VARCHAR AS level, is_fraud, count(*) AS count,
        (sum(count(*)) OVER (PARTITION BY {c}))::BIGINT AS level_total FROM txn GROUP BY {c}, is_fraud""" for c in columns)


def _box(columns: list[str]) -> str:
    return " UNION ALL ".join(f"""SELECT '{c}' AS "column", is_fraud, any_value(q1) AS q1, any_value(q2) AS median, any_value(q3) AS q3,
        min(v) FILTER (v BETWEEN q1 - 1.5e0 * (q3 - q1) AND q3 + 1.5e0 * (q3 - q1)) AS whisker_low,
        max(v) FILTER (v BETWEEN q1 - 1.5e0 * (q3 - q1) AND q3 + 1.5e0 * (q3 - q1)) AS whisker_high,
        count(*) FILTER (v NOT BETWEEN q1 - 1.5e0 * (q3 - q1) AND q3 + 1.5e0 * (q3 - q1)) AS outliers
        FROM (SELECT is_fraud, {c}::DOUBLE AS v, quantile_cont({c}::DOUBLE, 0.25) OVER (PARTITION BY is_fraud) AS q1,
                     quantile_cont({c}::DOUBLE, 0.5) OVER (PARTITION BY is_fraud) AS q2,
                     quantile_cont({c}::DOUBLE, 0.75) OVER (PARTITION BY is_fraud) AS q3 FROM txn) GROUP BY is_fraud""" for c in columns)


def _corr(columns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}::DOUBLE, {b}::DOUBLE), 6) AS corr FROM txn"
                              for a in columns for b in columns)


_TYPES = [("transaction_id", "bigint"), ("customer_id", "bigint"), ("transaction_amount", "double"), ("account_age_days", "int"),
          ("channel", "int"), ("kyc_verified", "string"), ("timestamp", "timestamp"), ("transaction_type", "int"),
          ("location", "int"), ("currency", "int"), ("ml_prob", "double"), ("is_fraud", "int")]
_DUMMIES = [("kyc_verified_Yes", "kyc_verified = 'Yes'"), *[(f"channel_{i}", f"channel = {i}") for i in (1, 2, 3)]]
_SPLIT = "('0x' || substr(md5(transaction_id || '~42'), 1, 8))::BIGINT / 4294967296.0e0 < {f}"
_DRAW = "('0x' || substr(md5(transaction_id || '~42'), 1, 13))::BIGINT"
_HOUR0 = """coalesce(hour("timestamp"), 0)"""
_SCALE = ["transaction_amount", "account_age_days", "channel"]
_DUPS = ", dup AS (SELECT * FROM txn UNION ALL SELECT * FROM txn WHERE transaction_id % 10 = 0)"
_ROUTE = """CASE WHEN trim(text) = '' THEN 'empty' WHEN regexp_matches(lower(text), 'top|user|customer') THEN 'top_users'
    WHEN regexp_matches(lower(text), 'channel|pos|mobile|atm|web') THEN 'channel_analysis'
    WHEN regexp_matches(lower(text), 'trend|time|week|month') THEN 'fraud_trends'
    WHEN regexp_matches(lower(text), 'risk|score') THEN 'risk_distribution'
    WHEN regexp_matches(lower(text), 'overview|summary|stat') THEN 'system_overview' ELSE 'help' END"""

ORACLES: dict[str, str] = {
    # Profiles
    "shape_and_columns": txn(ORDERS) + 'SELECT v.*, (SELECT count(*) FROM txn) AS "rows", 12 AS columns FROM (VALUES '
        + ", ".join(f"({i}, '{n}', '{t}')" for i, (n, t) in enumerate(_TYPES)) + ') v("position", "column", "type")',
    "head_rows": txn(ORDERS) + "SELECT transaction_id, customer_id, transaction_amount, kyc_verified FROM txn ORDER BY transaction_id LIMIT 5",
    "describe": txn(ORDERS) + _describe(["transaction_amount", "account_age_days", "channel", "ml_prob"]),
    "null_counts": txn(DIRTY) + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) - count("{c}") AS nulls FROM txn""" for c in
        ["transaction_id", "transaction_amount", "account_age_days", "channel", "kyc_verified", "timestamp"]),
    "duplicate_count": txn(ORDERS, _DUPS) + "SELECT (SELECT count(*) FROM dup) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dup)) AS duplicates",
    "class_balance": txn(ORDERS) + "SELECT is_fraud, count(*) AS count, round(count(*) / (SELECT count(*) FROM txn), 6) AS ratio FROM txn GROUP BY 1",
    "count_by_category": txn(ORDERS) + _counts(["channel", "kyc_verified", "transaction_type", "location", "currency"]),
    "count_by_hour": txn(ORDERS) + 'SELECT hour("timestamp") AS hour, is_fraud, count(*) AS count FROM txn GROUP BY 1, 2',
    "box_stats": f"""{txn(ORDERS)} SELECT "column", is_fraud, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, whisker_low,
        whisker_high, outliers FROM ({_box(["transaction_amount", "account_age_days"])})""",
    "histogram": txn(ORDERS) + """, e AS (SELECT min(transaction_amount) AS lo, max(transaction_amount) AS hi FROM txn),
        w AS (SELECT lo, (hi - lo) / 30 AS w FROM e), c AS (SELECT least(floor((transaction_amount - lo) / w), 29)::BIGINT AS bin, count(*) AS n FROM txn, w GROUP BY 1)
        SELECT r.bin, round(lo + r.bin * w, 4) AS lower, round(lo + (r.bin + 1) * w, 4) AS upper, coalesce(n, 0) AS count
        FROM range(30) r(bin) LEFT JOIN c USING (bin), w""",
    "correlation": txn(ORDERS) + _corr(["transaction_amount", "account_age_days", "ml_prob", "is_fraud"]),
    # Cleaning
    "rename_amount": txn(DIRTY) + f"SELECT transaction_id, {_AMT} AS amount FROM txn",
    "drop_ids": txn(ORDERS) + "SELECT transaction_amount, account_age_days, channel, kyc_verified, is_fraud, count(*) AS n FROM txn GROUP BY ALL",
    "drop_duplicates": txn(ORDERS, _DUPS) + "SELECT DISTINCT transaction_id, customer_id, transaction_amount, kyc_verified, is_fraud FROM dup",
    "outlier_bounds": txn(_SKEWED, _BOUNDS) + "SELECT round(lower, 6) AS lower, round(upper, 6) AS upper, (SELECT count(*) FROM txn, b WHERE transaction_amount < lower OR transaction_amount > upper) AS outliers FROM b",
    "outliers": txn(_SKEWED, _BOUNDS) + "SELECT transaction_id, transaction_amount FROM txn, b WHERE transaction_amount < lower OR transaction_amount > upper",
    "winsorize": txn(_SKEWED, _BOUNDS) + "SELECT transaction_id, round(least(greatest(transaction_amount, lower), upper), 6) AS transaction_amount FROM txn, b",
    "parse_timestamp": txn(DIRTY) + f"""SELECT transaction_id, strftime({_TIME}, '%Y-%m-%d %H:%M:%S') AS "timestamp" FROM txn""",
    "kyc_flag": txn(DIRTY) + f"""SELECT transaction_id, {_KYC} AS any_case, (coalesce(kyc_verified, '') = 'Yes')::INT AS title,
        (coalesce(kyc_verified, '') IN ('yes', 'y', 'True', 'true'))::INT AS "lower", coalesce(trunc(TRY_CAST(kyc_verified AS DOUBLE))::INT, 0) AS "numeric" FROM txn""",
    "fill_missing": txn(DIRTY) + f"SELECT transaction_id, {_AMT} AS amount, {_INT.format(c='account_age_days')} AS account_age_days FROM txn",
    "align_features": txn(ORDERS) + "SELECT transaction_id, ml_prob, 0 AS velocity_check, channel, transaction_amount FROM txn",
    "channel_name": txn(DIRTY) + """SELECT transaction_id, coalesce(n, 'Mobile') AS scoring_name, coalesce(n, 'Unknown') AS analytics_name FROM
        (SELECT transaction_id, CASE channel WHEN '0' THEN 'Mobile' WHEN '1' THEN 'POS' WHEN '2' THEN 'ATM' WHEN '3' THEN 'Web' END AS n FROM txn)""",
    # Features
    "time_features": txn(DIRTY) + f"""SELECT transaction_id, coalesce(hour(t), 0) AS hour, day(t) AS day, isodow(t) - 1 AS day_of_week, month(t) AS month,
        coalesce(isodow(t) >= 6, false)::INT AS is_weekend, coalesce(hour(t) >= 22 OR hour(t) <= 6, false)::INT AS is_night
        FROM (SELECT transaction_id, {_TIME} AS t FROM txn)""",
    "log_amount": txn(DIRTY) + f"SELECT transaction_id, round(ln(1 + {_AMT}), 6) AS log_amount FROM txn",
    "high_amount": txn(ORDERS) + """SELECT transaction_id, (transaction_amount > (SELECT quantile_cont(transaction_amount, 0.95) FROM txn))::INT AS high_amount,
        (transaction_amount > (SELECT quantile_cont(transaction_amount, 0.95) FROM txn) AND (hour("timestamp") >= 22 OR hour("timestamp") <= 6))::INT AS high_amount_night FROM txn""",
    "customer_stats": txn(ORDERS) + """SELECT customer_id, count(*) AS cust_txn_count, round(avg(transaction_amount), 6) AS cust_avg_amount,
        max(transaction_amount) AS cust_max_amount, min(transaction_amount) AS cust_min_amount FROM txn GROUP BY 1""",
    "join_customer_stats": txn(ORDERS) + """SELECT transaction_id, customer_id, cust_txn_count, cust_max_amount, cust_min_amount
        FROM txn LEFT JOIN (SELECT customer_id, count(*) AS cust_txn_count, max(transaction_amount) AS cust_max_amount,
        min(transaction_amount) AS cust_min_amount FROM txn GROUP BY 1) USING (customer_id)""",
    "velocity_24h": txn(EVENTS) + """SELECT transaction_id, count(*) OVER (PARTITION BY customer_id ORDER BY epoch_us("timestamp")
        RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS txn_last_24h FROM txn""",
    "sparse_one_hot": txn(ORDERS) + """, n AS (SELECT count(DISTINCT customer_id) + count(DISTINCT channel) - 2 AS size FROM txn)
        SELECT transaction_id, dense_rank() OVER (ORDER BY customer_id::VARCHAR) - 2 AS customer_id_index, dense_rank() OVER (ORDER BY channel::VARCHAR) - 2 AS channel_index,
               CAST(size AS INTEGER) AS size FROM txn, n""",
    "one_hot": txn(ORDERS) + "SELECT transaction_id, " + ", ".join(f'({e})::INT AS "{n}"' for n, e in _DUMMIES) + " FROM txn",
    "chi2_scores": txn(ORDERS) + ", x AS (" + " UNION ALL ".join(
        f"""SELECT '{n}' AS feature, is_fraud, count(*) AS n, count(*) FILTER ({e}) AS obs FROM txn GROUP BY 2""" for n, e in _DUMMIES)
        + """), y AS (SELECT *, n / sum(n) OVER (PARTITION BY feature) * sum(obs) OVER (PARTITION BY feature) AS ex FROM x)
        SELECT feature, round(sum((obs - ex) * (obs - ex) / ex), 6) AS score FROM y GROUP BY 1""",
    "robust_scale": txn(ORDERS) + "SELECT transaction_id, " + ", ".join(
        f"""round(({c} - (SELECT quantile_cont({c}, 0.5) FROM txn)) / (SELECT coalesce(nullif(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 0), 1) FROM txn), 6) AS {c}"""
        for c in _SCALE) + " FROM txn",
    "standard_scale": txn(ORDERS) + "SELECT transaction_id, " + ", ".join(
        f"""round(({c} - (SELECT avg({c}) FROM txn)) / (SELECT coalesce(nullif(stddev_pop({c}), 0), 1) FROM txn), 6) AS {c}""" for c in _SCALE) + " FROM txn",
    # Split and metrics
    "stratified_split": txn(ORDERS) + f"""SELECT transaction_id, is_fraud,
        CASE WHEN row_number() OVER (PARTITION BY is_fraud ORDER BY {_DRAW}) <= floor(0.25e0 * count(*) OVER (PARTITION BY is_fraud) + 0.5e0) THEN 'test' ELSE 'train' END AS part FROM txn""",
    "split_shares": txn(ORDERS) + f"""SELECT is_fraud, count(*) AS n, count(*) FILTER ({_SPLIT.format(f='0.2e0')}) AS test_rows FROM txn GROUP BY 1""",
    "class_weights": txn(ORDERS) + """SELECT is_fraud, count(*) AS count, round((SELECT count(*) FROM txn) / ((SELECT count(DISTINCT is_fraud) FROM txn) * count(*)), 6) AS weight FROM txn GROUP BY 1""",
    "pr_curve": txn(ORDERS, _CURVE) + 'SELECT round(threshold, 9) AS threshold, round("precision", 6) AS "precision", round(recall, 6) AS recall, tp::BIGINT AS tp, fp::BIGINT AS fp FROM pr',
    "average_precision": txn(ORDERS, _CURVE) + 'SELECT round(sum(pos * "precision") / any_value(p), 6) AS average_precision FROM pr',
    "roc_auc": txn(ORDERS) + """, k AS (SELECT is_fraud AS y, rank() OVER (ORDER BY ml_prob) + (count(*) OVER (PARTITION BY ml_prob) - 1) / 2.0e0 AS rk FROM txn)
        SELECT round((sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0e0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS roc_auc FROM k""",
    "best_threshold": txn(ORDERS, _CURVE) + 'SELECT round(threshold, 9) AS threshold, round("precision", 6) AS "precision", round(recall, 6) AS recall FROM pr WHERE recall >= 0.8e0 ORDER BY pr."precision" DESC, pr.threshold LIMIT 1',
    "confusion": txn(ORDERS, _CONFUSION) + "SELECT * FROM m",
    "classification_report": txn(ORDERS, _CONFUSION) + """, r AS (SELECT tn / (tn + fn) AS p0, tn / (tn + fp) AS r0, 2 * tn / (2 * tn + fn + fp) AS f0, tn + fp AS s0,
        tp / (tp + fp) AS p1, tp / (tp + fn) AS r1, 2 * tp / (2 * tp + fn + fp) AS f1, tp + fn AS s1, (tp + tn) / (tp + tn + fp + fn) AS acc, tp + tn + fp + fn AS n FROM m),
        u AS (SELECT '0' AS class, p0 AS p, r0 AS r, f0 AS f, s0 AS s FROM r UNION ALL SELECT '1', p1, r1, f1, s1 FROM r UNION ALL SELECT 'accuracy', acc, acc, acc, n FROM r
        UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n FROM r
        UNION ALL SELECT 'weighted avg', (p0 * s0 + p1 * s1) / n, (r0 * s0 + r1 * s1) / n, (f0 * s0 + f1 * s1) / n, n FROM r)
        SELECT class, round(p, 6) AS "precision", round(r, 6) AS recall, round(f, 6) AS f1_score, s AS support FROM u""",
    "business_impact": txn(ORDERS, _CONFUSION) + "SELECT round(tp / (tp + fn + 1e-8) * 100, 6) AS fraud_caught_pct, round(fp / (fp + tn + 1e-8) * 100, 6) AS false_alarm_pct FROM m",
    "apply_threshold": txn(ORDERS) + "SELECT transaction_id, (ml_prob >= 0.5e0)::INT AS at_half, (ml_prob >= 0.35e0)::INT AS at_tuned FROM txn",
    "threshold_choice": txn(ORDERS) + """, a AS (SELECT * FROM (SELECT 0 AS ordinal, 'cut 0.3' AS model, avg(((ml_prob >= 0.3e0)::INT = is_fraud)::INT) AS acc FROM txn
        UNION ALL SELECT 1, 'cut 0.5', avg(((ml_prob >= 0.5e0)::INT = is_fraud)::INT) FROM txn UNION ALL SELECT 2, 'cut 0.7', avg(((ml_prob >= 0.7e0)::INT = is_fraud)::INT) FROM txn
        UNION ALL SELECT 3, 'cut 0.9', avg(((ml_prob >= 0.9e0)::INT = is_fraud)::INT) FROM txn))
        SELECT ordinal, model, round(acc, 6) AS accuracy FROM a ORDER BY CASE WHEN acc < 0.81e0 THEN acc ELSE -1 END DESC, ordinal LIMIT 1""",
    # Rules, fusion, explanation, alerts
    "rule_inputs": f"WITH txn AS ({DIRTY}), rin AS ({DIRTY_INPUTS}) SELECT transaction_id, amt AS rule_amount, age AS rule_age, chan AS rule_channel, kyc AS rule_kyc, hr AS rule_hour, wend AS rule_weekend, ok AS rule_inputs_ok FROM rin",
    "rule_hits": chain(ORDERS) + """SELECT transaction_id, h2::INT AS very_high_amount, h3::INT AS high_amount_no_kyc, h4::INT AS odd_hour, h5::INT AS new_account_high,
        h6::INT AS very_new_account, h7::INT AS weekend_high, (factors >= 3)::INT AS multi_factor, factors FROM hits""",
    "rule_score": chain(ORDERS) + "SELECT transaction_id, rule_score FROM ruled",
    "rule_reasons": chain(ORDERS) + "SELECT transaction_id, array_to_string(reasons, ' | ') AS reasons FROM ruled",
    "rule_summary": chain(ORDERS) + """SELECT rule, count(*) AS hits FROM (SELECT unnest(list_filter([CASE WHEN h2 THEN 'very_high_amount' END, CASE WHEN h3 THEN 'high_amount_no_kyc' END,
        CASE WHEN h4 THEN 'odd_hour' END, CASE WHEN h5 THEN 'new_account_high' END, CASE WHEN h6 THEN 'very_new_account' END, CASE WHEN h7 THEN 'weekend_high' END,
        CASE WHEN factors >= 3 THEN 'multi_factor' END], lambda x: x IS NOT NULL)) AS rule FROM hits) GROUP BY 1""",
    "tolerant_rules": chain(DIRTY, DIRTY_INPUTS) + "SELECT transaction_id, rule_score, array_to_string(reasons, ' | ') AS reasons FROM ruled",
    "strict_rules": chain(DIRTY, DIRTY_INPUTS) + """SELECT transaction_id, CASE WHEN ok THEN rule_score ELSE 0e0 END AS rule_score,
        CASE WHEN ok THEN array_to_string(reasons, ' | ') ELSE 'Rule evaluation failed - relying on ML model' END AS reasons FROM ruled""",
    "fuse_risk": chain(ORDERS) + "SELECT transaction_id, risk_score FROM fused",
    "final_label": chain(ORDERS) + "SELECT transaction_id, final_label, CASE final_label WHEN 'Fraud' THEN 'High' WHEN 'Suspicious' THEN 'Medium' ELSE 'Low' END AS confidence FROM scored",
    "confidence_level": chain(ORDERS) + "SELECT transaction_id, CASE WHEN risk_score >= 0.8e0 THEN 'Very High' WHEN risk_score >= 0.6e0 THEN 'High' WHEN risk_score >= 0.4e0 THEN 'Medium' ELSE 'Low' END AS confidence_level FROM scored",
    "risk_category": chain(ORDERS, extra=_JOINED) + f"SELECT transaction_id, {_CATEGORY} AS category FROM j",
    "risk_message": chain(ORDERS, extra=_JOINED) + f"SELECT transaction_id, {_MESSAGE} AS message FROM j",
    "risk_explanation": chain(ORDERS, extra=_JOINED) + f"SELECT transaction_id, {_EXPLAIN} AS explanation FROM j",
    "risk_breakdown": chain(ORDERS) + """SELECT transaction_id, round(0.6e0 * ml_prob, 4) AS ml_contribution, round(0.4e0 * rule_score, 4) AS rules_contribution,
        round(CASE WHEN ml_prob > 0.8e0 OR ml_prob < 0.2e0 THEN 0.8e0 ELSE 0.6e0 END * ml_prob, 4) AS ml_effective,
        round(CASE WHEN ml_prob > 0.8e0 OR ml_prob < 0.2e0 THEN 0.2e0 ELSE 0.4e0 END * rule_score, 4) AS rules_effective FROM scored""",
    "score_result": chain(ORDERS, extra=_JOINED) + f"""SELECT transaction_id::VARCHAR AS transaction_id, transaction_id AS db_transaction_id, final_label AS prediction, risk_score,
        round(ml_prob, 6) AS ml_probability, rule_score, CASE final_label WHEN 'Fraud' THEN 'High' WHEN 'Suspicious' THEN 'Medium' ELSE 'Low' END AS confidence,
        CASE WHEN risk_score >= 0.8e0 THEN 'Very High' WHEN risk_score >= 0.6e0 THEN 'High' WHEN risk_score >= 0.4e0 THEN 'Medium' ELSE 'Low' END AS confidence_level,
        {_CATEGORY} AS category, joined AS reasons, {_MESSAGE} AS message, {_EXPLAIN} AS explanation,
        round(0.6e0 * ml_prob, 4) AS ml_contribution, round(0.4e0 * rule_score, 4) AS rules_contribution FROM j""",
    "simple_result": txn(ORDERS) + "SELECT transaction_id, (ml_prob >= 0.5e0)::INT AS prediction, round(ml_prob, 4) AS probability FROM txn",
    "build_alerts": chain(ORDERS) + "SELECT alert_id, transaction_id, customer_id, risk_score, reason, round(ml_prob, 9) AS ml_prob, rule_score FROM alerts",
    "facts_from_reasons": chain(ORDERS, extra=_JOINED) + f"""SELECT transaction_id, coalesce(replace({_RAMT}, ',', '')::DOUBLE, 0e0) AS amount, coalesce({_RAGE}::INT, 0) AS age,
        CASE WHEN contains(lower(joined), 'without kyc') THEN 'No' ELSE 'Yes' END AS kyc, {_WHEN} AS happened FROM j""",
    "explanation_prompt": chain(ORDERS, extra=_JOINED) + f"""SELECT transaction_id, chr(10) || '        You are a fraud detection expert analyzing a banking transaction. Provide a clear, professional explanation.' || chr(10) || chr(10) ||
        '        Transaction Details:' || chr(10) || '        - Amount: ₹' || format('{{:,.2f}}', transaction_amount) || chr(10) || '        - Account Age: ' || account_age_days || ' days' || chr(10) ||
        '        - Channel: ' || CASE channel WHEN 0 THEN 'Mobile' WHEN 1 THEN 'POS' WHEN 2 THEN 'ATM' ELSE 'Web' END || chr(10) || '        - KYC Verified: ' || kyc_verified || chr(10) ||
        '        - Timestamp: ' || CASE WHEN transaction_id % 3 = 0 THEN {_WHEN} ELSE strftime("timestamp", '%Y-%m-%d %H:%M:%S') END || chr(10) || chr(10) || '        Model Analysis:' || chr(10) || '        - Prediction: ' || final_label || chr(10) ||
        '        - Risk Score: ' || format('{{:.1f}}', risk_score * 100) || '%' || chr(10) || '        - ML Confidence: ' || format('{{:.1f}}', ml_prob * 100) || '%' || chr(10) ||
        '        - Rule Engine Score: ' || format('{{:.1f}}', rule_score * 100) || '%' || chr(10) || '        - Category: ' || {_CATEGORY} || chr(10) ||
        '        - Risk Factors: ' || CASE WHEN joined <> '' THEN array_to_string(reasons, ', ') ELSE 'None detected' END || chr(10) || chr(10) ||
        '        Provide a brief (3-4 sentences) professional explanation of why this transaction was classified as ' || final_label || '.' || chr(10) ||
        '        Focus on the key risk indicators and what actions should be taken. Be specific and actionable.' || chr(10) || '        ' AS prompt FROM j""",
    # Analytics
    "top_users": chain(EVENTS) + f"SELECT customer_id, fraud_count, round(avg_risk, 6) AS avg_risk FROM {_TOP}",
    "top_users_month": chain(ORDERS) + f"""SELECT customer_id, count(*) AS fraud_count, round(avg(risk_score), 6) AS avg_risk FROM alerts
        WHERE {_SINCE.format(days=30)} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
    "fraud_trends": chain(EVENTS) + f"SELECT date::VARCHAR AS date, count, round(avg_risk, 6) AS avg_risk FROM {_TREND}",
    "trend_totals": chain(EVENTS) + f"SELECT sum(count)::BIGINT AS total, round(sum(count) / count(*), 6) AS daily_mean FROM {_TREND}",
    "risk_distribution": chain(ORDERS) + f"SELECT * FROM {_BAND}",
    "system_overview": chain(ORDERS) + """SELECT 'Total Transactions' AS metric, count(*)::DOUBLE AS value FROM scored UNION ALL SELECT 'Fraud Detected', sum(predicted)::DOUBLE FROM scored
        UNION ALL SELECT 'Fraud Alerts', count(*)::DOUBLE FROM alerts UNION ALL SELECT 'Fraud Rate', round(sum(predicted) / count(*) * 100, 6) FROM scored""",
    "fraud_by_channel": chain(ORDERS) + f"SELECT channel, fraud_count, round(avg_risk, 6) AS avg_risk FROM {_CHANNEL}",
    "fraud_by_channel_twice": chain(ORDERS) + """SELECT CASE channel WHEN 0 THEN 'Mobile' WHEN 1 THEN 'POS' WHEN 2 THEN 'ATM' ELSE 'Web' END AS channel,
        count(*) AS fraud_count, round(avg(risk_score), 6) AS avg_risk FROM
        (SELECT transaction_id, risk_score FROM alerts UNION ALL SELECT transaction_id, risk_score FROM alerts WHERE transaction_id % 10 = 0) f
        JOIN txn USING (transaction_id) GROUP BY 1""",
    "split_null_ids": txn(ORDERS) + "SELECT is_fraud, count(*) AS n, count(*) FILTER (transaction_id % 3 = 0) AS without_id FROM txn GROUP BY 1",
    "class_weights_unlabelled": txn(ORDERS) + """, l AS (SELECT is_fraud FROM txn WHERE transaction_id % 5 > 0)
        SELECT is_fraud, count(*) AS count, round((SELECT count(*) FROM l) / ((SELECT count(DISTINCT is_fraud) FROM l) * count(*)), 6) AS weight FROM l GROUP BY 1""",
    "normalize_columns": txn(ORDERS) + "SELECT transaction_id, transaction_amount AS amount_paid, kyc_verified FROM txn",
    "named_query_kyc": chain(ORDERS) + "SELECT kyc_verified AS kyc, count(*) AS fraud_count, round(avg(f.risk_score), 6) AS avg_risk FROM alerts f JOIN txn USING (transaction_id) GROUP BY 1",
    "sql_by_channel": txn(ORDERS) + "SELECT channel, count(*) AS n, max(transaction_amount) AS most FROM txn GROUP BY 1",
    "trend_windows": chain(EVENTS) + "SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS count, round(avg(risk_score), 6) AS avg_risk FROM alerts GROUP BY 1",
    "velocity_windows": txn(EVENTS) + """, w AS (SELECT customer_id, time_bucket(INTERVAL 6 HOUR, "timestamp"::TIMESTAMP, TIMESTAMP '1970-01-01') - k * INTERVAL 6 HOUR AS f
        FROM txn, range(4) r(k) WHERE "timestamp" IS NOT NULL)
        SELECT customer_id, strftime(f, '%Y-%m-%d %H:%M:%S') AS "from", count(*) AS txn_count FROM w GROUP BY ALL""",
    "feature_list": txn(ORDERS) + """, n AS (SELECT unnest(['amount', 'account_age_days', 'kyc_verified', 'hour', 'is_weekend', 'is_night', 'log_amount', 'high_amount', 'high_amount_night']) AS feature,
            generate_subscripts(range(9), 1) - 1 AS position),
        c AS (SELECT DISTINCT CASE channel WHEN 0 THEN 'Mobile' WHEN 1 THEN 'POS' WHEN 2 THEN 'ATM' ELSE 'Web' END AS name FROM txn),
        d AS (SELECT 'channel_' || name AS feature, 8 + row_number() OVER (ORDER BY name) - 1 AS position FROM c)
        SELECT position::INTEGER AS position, feature FROM n UNION ALL SELECT position::INTEGER, feature FROM d WHERE position > 8""",
    "fraud_by_account_age": chain(ORDERS) + """SELECT CASE WHEN age < 7 THEN 'under 7 days' WHEN age < 30 THEN '7-29 days' WHEN age < 60 THEN '30-59 days' WHEN age < 365 THEN '60-364 days' ELSE '365 days or more' END AS age_group,
        count(*) AS fraud_count, round(avg(f.risk_score), 6) AS avg_risk FROM alerts f JOIN rin USING (transaction_id) GROUP BY 1""",
    "fraud_by_kyc": chain(ORDERS) + "SELECT kyc_verified AS kyc, count(*) AS fraud_count, round(avg(f.risk_score), 6) AS avg_risk FROM alerts f JOIN txn USING (transaction_id) GROUP BY 1",
    "fraud_by_customer_segment": chain(ORDERS) + """SELECT c_mktsegment AS segment, count(*) AS fraud_count, round(avg(risk_score), 6) AS avg_risk
        FROM alerts JOIN customer ON c_custkey = customer_id GROUP BY 1""",
    "route_query": f"""SELECT conv_id, turn, {_ROUTE} AS route, CASE {_ROUTE} WHEN 'top_users' THEN CASE WHEN contains(lower(text), 'month') THEN 30 ELSE 7 END
        WHEN 'fraud_trends' THEN CASE WHEN contains(lower(text), 'week') THEN 7 ELSE 30 END END AS days FROM conversations""",
    "route_summary": f"SELECT {_ROUTE} AS route, count(*) AS texts FROM documents GROUP BY 1",
    "answer_top_users": chain(EVENTS) + f"""SELECT 'Top ' || count(*) || ' fraud-prone users (last 7 days):' || chr(10) || chr(10) || string_agg(i || '. ' || customer_id || ': ' || fraud_count
        || ' alerts, avg risk: ' || format('{{:.1f}}', avg_risk * 100) || '%' || chr(10), '' ORDER BY i) AS answer FROM (SELECT *, row_number() OVER (ORDER BY fraud_count DESC, customer_id) AS i FROM {_TOP})""",
    "answer_trends": chain(EVENTS) + f"""SELECT 'Fraud trends (last 30 days): ' || sum(count)::BIGINT || ' total alerts' || chr(10) || 'Average daily: ' || format('{{:.1f}}', sum(count) / count(*)) || ' alerts' AS answer FROM {_TREND}""",
    "answer_risk": chain(ORDERS) + f"""SELECT 'Risk score distribution:' || chr(10) || string_agg('• ' || risk_level || ': ' || count || ' alerts' || chr(10), '' ORDER BY count DESC, risk_level) AS answer FROM {_BAND}""",
    "answer_channels": chain(ORDERS) + f"""SELECT 'Fraud by transaction channel:' || chr(10) || string_agg('• ' || channel || ': ' || fraud_count || ' alerts, avg risk: ' || format('{{:.1f}}', avg_risk * 100) || '%' || chr(10), '' ORDER BY fraud_count DESC, channel) AS answer FROM {_CHANNEL}""",
    "answer_overview": chain(ORDERS) + """SELECT 'System Overview:' || chr(10) || '• Transactions: ' || count(*) || chr(10) || '• Fraud Rate: ' || format('{:.1f}', sum(predicted) / count(*) * 100)
        || '%' || chr(10) || '• Alerts: ' || (SELECT count(*) FROM alerts) AS answer FROM scored""",
    "list_alerts": chain(ORDERS) + """SELECT alert_id, transaction_id, customer_id, risk_score, reason, rule_score, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at
        FROM alerts ORDER BY alerts.created_at DESC, alert_id DESC LIMIT 100""",
    "history": chain(ORDERS) + """SELECT transaction_id, transaction_amount, kyc_verified, predicted, probability FROM scored WHERE user_id = 3""",
    "label_status": chain(ORDERS, extra=_LABEL_EVENTS) + "SELECT transaction_id, user_id, label, seq, status FROM st",
    "apply_labels": chain(ORDERS, extra=_LABEL_EVENTS) + "SELECT transaction_id, actual_label FROM lab",
    "labelled_metrics": chain(ORDERS) + _user_metrics(3, "actual_label", "actual_label IS NOT NULL", "real"),
    "self_consistency_metrics": chain(EVENTS) + _user_metrics(5, "predicted", "true", "self_consistency"),
    # Stored records and resampling
    "stored_transactions": chain(ORDERS) + """SELECT transaction_id AS id, user_id, to_json({'transaction_id': transaction_id::VARCHAR, 'customer_id': customer_id::VARCHAR,
        'account_age_days': account_age_days::VARCHAR, 'channel': channel::VARCHAR, 'kyc_verified': kyc_verified})::VARCHAR AS data, predicted, probability FROM scored""",
    "parsed_records": txn(ORDERS) + """SELECT transaction_id, CASE WHEN transaction_id % 3 < 2 THEN channel::VARCHAR END AS channel, CASE WHEN transaction_id % 3 < 2 THEN kyc_verified END AS kyc_verified,
        CASE WHEN transaction_id % 3 = 1 THEN 'it is None, True' END AS note, NULL::VARCHAR AS path, CASE WHEN transaction_id % 3 = 1 THEN 'true' END AS checked,
        CASE WHEN transaction_id % 3 = 2 THEN '<row ' || transaction_id || '>' END AS raw_data, CASE WHEN transaction_id % 3 = 2 THEN 'true' END AS parse_error FROM txn""",
    "smote_counts": txn(ORDERS) + """, c AS (SELECT is_fraud, count(*) AS n FROM txn GROUP BY 1)
        SELECT is_fraud, 0 AS synthetic, n FROM c UNION ALL SELECT arg_min(is_fraud, n), 1, max(n) - min(n) FROM c""",
}
ORACLES["velocity_carried"] = ORACLES["velocity_24h"]
ORACLES["refit_quantiles"] = txn(_SKEWED) + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS n, """ + ", ".join(f"round(quantile_cont({c}::DOUBLE, {p}), 6) AS {q}" for p, q in
    ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"), (0.95, "q95"))) + " FROM txn" for c in ("transaction_amount", "account_age_days", "ml_prob"))
