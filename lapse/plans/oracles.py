"""DuckDB SQL mirrors of the registered queries (the correctness oracle).

Each oracle is ``ORACLE_PREFIX`` (the test views) plus query CTEs plus a
final SELECT whose column names and types match the Spark query.  Doubles
are rounded to 6 places on both sides (different engines sum in different
orders).
"""

from __future__ import annotations

from lapse.config import FeatureConfig
from lapse.sources.testviews import ORACLE_PREFIX, REFERENCE_DATE

CFG = FeatureConfig()
# Fixed values of the rules, written out so that a wrong setting on the Spark side shows.
HIGH, MEDIUM = 0.2533, 0.1687                      # tier cutoffs
LIFESPAN, MONTHLY, COST, SUCCESS = 20, 149, 0.05, 0.3
LOW_CONFIDENCE_DAYS, DRIVERS, MIN_FREQ = 14, 3, 0.01
QUOTA_HIGH, QUOTA_MEDIUM, QUOTA_LOW_NEW, LOW_NEW_DAYS = 4, 3, 3, 180
REF = f"DATE '{REFERENCE_DATE}'"
# Days before the reference date of the two trend windows.
TREND_RECENT, TREND_PRIOR = "age <= 14", "age > 14 AND age <= 28"


def r6(expr: str) -> str:
    x = f"CAST({expr} AS DOUBLE)"
    return f"(CASE WHEN abs({x}) < 1e15 THEN floor({x} * 1e6 + 0.5) / 1e6 ELSE {x} END)"


def _round_to_r6(sql: str) -> str:
    """Rewrite every ``round(expr, 6)`` into :func:`r6` (balanced-paren scan)."""
    out, i, key = [], 0, "round("
    while True:
        j = sql.find(key, i)
        if j < 0 or (j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                return "".join(out)
            out.append(sql[i:j + len(key)])
            i = j + len(key)
            continue
        depth, k, comma = 1, j + len(key), -1
        while depth:
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
            elif ch == "," and depth == 1:
                comma = k
            k += 1
        inner = sql[j + len(key):comma]
        out.append(sql[i:j])
        out.append(r6(_round_to_r6(inner)))
        i = k


def logs_agg_cte() -> str:
    """One row per customer; the windows are spelled out, independent of the Spark side."""
    def mean(value: str, days: str) -> str:
        return f"(sum(coalesce({value}, 0)) FILTER (WHERE {days})) / nullif(count(*) FILTER (WHERE {days}), 0)"

    spans = {"7": "age <= 7", "14": "age <= 14", "30": "age <= 30"}
    columns = [f"count(*) FILTER (WHERE {days}) AS active_days_{n}" for n, days in spans.items()]
    columns += [f"{mean('num_100', days)} AS avg_songs_100_{n}" for n, days in spans.items()]
    columns += [f"{mean('total_secs', days)} AS avg_secs_{n}" for n, days in spans.items()]
    columns.append(f"{mean('num_unq', spans['7'])} AS avg_unq_7")
    for name, days in (("recent", TREND_RECENT), ("prior", TREND_PRIOR)):
        columns += [f"{mean('num_100', days)} AS {name}_avg_songs", f"{mean('total_secs', days)} AS {name}_avg_secs"]
    return f""",
logs_agg AS (
  SELECT msno, min(age) AS days_since_last_log,
    {", ".join(columns)}
  FROM (SELECT *, date_diff('day', log_date, {REF}) AS age FROM user_logs) WHERE age >= 0 GROUP BY msno
)"""


def engagement_names(cfg: FeatureConfig = CFG) -> list[str]:
    from lapse.operators.features import engagement_columns
    return engagement_columns(cfg)


def engagement_select(alias: str = "la", cfg: FeatureConfig = CFG) -> list[str]:
    out = []
    for c in engagement_names(cfg):
        if c == "days_since_last_log":
            out.append(f"CAST(coalesce({alias}.{c}, 999) AS INTEGER) AS {c}")
        elif c.startswith("active_days_"):
            out.append(f"CAST(coalesce({alias}.{c}, 0) AS BIGINT) AS {c}")
        else:
            out.append(f"CAST(coalesce({alias}.{c}, 0.0) AS DOUBLE) AS {c}")
    return out


TREND = ("coalesce(recent_avg_secs / (prior_avg_secs + 1e-5), 0.0) AS engagement_trend_secs_ratio, "
         "coalesce(recent_avg_songs / (prior_avg_songs + 1e-5), 0.0) AS engagement_trend_songs_ratio")


def features_cte(min_freq: float = MIN_FREQ) -> str:
    """CTEs ending in ``features`` (31 features + msno + is_churn) over base = train."""
    eng = ",\n    ".join(engagement_select("la"))
    return logs_agg_cte() + f""",
reg_kept AS (
  SELECT registered_via FROM (
    SELECT registered_via, count(*) / (SELECT count(registered_via) FROM members) AS freq
    FROM members WHERE registered_via IS NOT NULL GROUP BY registered_via)
  WHERE freq >= {min_freq}
),
member_attrs AS (
  SELECT m.msno,
    CASE WHEN m.city IS NULL OR m.city = -1 THEN 'Unknown' ELSE CAST(CAST(m.city AS BIGINT) AS VARCHAR) END AS city,
    coalesce(m.gender, 'Unknown') AS gender,
    CASE WHEN m.bd IS NOT NULL AND m.bd >= 0 AND m.bd <= 100 THEN CAST(CAST(m.bd AS BIGINT) AS VARCHAR)
         ELSE 'Unknown/Invalid' END AS age_clean,
    CASE WHEN m.registered_via IS NULL THEN 'Unknown'
         WHEN k.registered_via IS NOT NULL THEN CAST(CAST(m.registered_via AS BIGINT) AS VARCHAR)
         ELSE 'Other' END AS registered_via_clean,
    date_diff('day', m.registration_init_time, {REF}) AS days_since_registration
  FROM members m LEFT JOIN reg_kept k ON m.registered_via = k.registered_via
),
tx_flags AS (
  SELECT *, CASE WHEN row_number() OVER w = 1 THEN 0
                 WHEN plan_list_price = lag(plan_list_price) OVER w THEN 0 ELSE 1 END AS changed
  FROM transactions
  WINDOW w AS (PARTITION BY msno ORDER BY transaction_date ASC NULLS LAST)
),
tx_hist AS (
  SELECT msno, sum(changed) AS num_plan_changes, count(DISTINCT payment_method_id) AS num_payment_methods,
         coalesce(sum(is_cancel), 0) AS num_cancellations, max(membership_expire_date) AS max_expire_date
  FROM tx_flags GROUP BY msno
),
tx_last AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT msno, plan_list_price, payment_plan_days, is_auto_renew, payment_method_id, transaction_date,
           row_number() OVER (PARTITION BY msno ORDER BY transaction_date DESC NULLS FIRST) AS rn
    FROM transactions) WHERE rn = 1
),
base AS (SELECT DISTINCT msno FROM train),
features_raw AS (
  SELECT b.msno,
    coalesce(ma.city, 'Unknown') AS city,
    coalesce(ma.gender, 'Unknown') AS gender,
    coalesce(ma.age_clean, 'Unknown/Invalid') AS age_clean,
    coalesce(ma.registered_via_clean, 'Unknown') AS registered_via_clean,
    coalesce(CAST(tl.plan_list_price AS DOUBLE), 0.0) AS plan_list_price,
    coalesce(CAST(tl.payment_plan_days AS INTEGER), 0) AS payment_plan_days,
    coalesce(CAST(tl.is_auto_renew AS INTEGER), 0) AS is_auto_renew,
    CASE WHEN tl.payment_method_id IS NULL OR tl.payment_method_id = -1 THEN 'Unknown'
         ELSE CAST(CAST(tl.payment_method_id AS BIGINT) AS VARCHAR) END AS payment_method_id,
    CAST(coalesce(th.num_plan_changes, 0) AS BIGINT) AS num_plan_changes,
    CAST(coalesce(th.num_payment_methods, 0) AS BIGINT) AS num_payment_methods,
    CAST(coalesce(th.num_cancellations, 0) AS BIGINT) AS num_cancellations,
    CAST(coalesce(date_diff('day', tl.transaction_date, {REF}), -1) AS INTEGER) AS days_since_last_transaction,
    CAST(coalesce(ma.days_since_registration, -1) AS INTEGER) AS days_since_registration,
    CAST(coalesce(date_diff('day', {REF}, th.max_expire_date), -999) AS INTEGER) AS days_until_expire,
    {eng},
    CAST(t.is_churn AS INTEGER) AS is_churn
  FROM base b
  LEFT JOIN member_attrs ma ON b.msno = ma.msno
  LEFT JOIN tx_last tl ON b.msno = tl.msno
  LEFT JOIN tx_hist th ON b.msno = th.msno
  LEFT JOIN logs_agg la ON b.msno = la.msno
  LEFT JOIN train t ON b.msno = t.msno
),
features AS (SELECT *, {TREND} FROM features_raw)"""


# The stand-in score before squaring: a hash fraction of the id and the four fields of a scenario.
_D = "CAST('{}' AS DOUBLE)".format
STAND_IN = (f"({_D(0.55)} * (CAST('0x' || substr(md5(msno), 1, 8) AS BIGINT) / {_D(4294967296.0)})"
            f" + {_D(0.15)} * CAST(1 - is_auto_renew AS DOUBLE)"
            f" + {_D(0.1)} * (least(CAST(plan_list_price AS DOUBLE), {_D(150.0)}) / {_D(150.0)})"
            f" + {_D(0.1)} * (CAST(least(payment_plan_days, 410) AS DOUBLE) / {_D(410.0)})"
            f" + {_D(0.1)} * (CAST(greatest(days_since_registration, 0) AS DOUBLE)"
            f" / (CAST(greatest(days_since_registration, 0) AS DOUBLE) + {_D(365.0)})))")


def scored_cte() -> str:
    """CTE ``scored``: features + stand-in p + tier + CLV + EV + low-confidence."""
    return features_cte() + f""",
scored_x AS (
  SELECT *, {STAND_IN} AS _x FROM features
),
scored_p AS (
  SELECT * EXCLUDE (_x), _x * _x AS churn_probability FROM scored_x
),
scored AS (
  SELECT *,
    CASE WHEN churn_probability >= {HIGH} THEN 'High' WHEN churn_probability >= {MEDIUM} THEN 'Medium'
         ELSE 'Low' END AS risk_tier,
    CASE WHEN plan_list_price IS NULL OR payment_plan_days IS NULL OR payment_plan_days <= 0
         THEN CAST({MONTHLY} AS DOUBLE) * {LIFESPAN}
         ELSE plan_list_price * (30.0 / payment_plan_days) * {LIFESPAN} END AS estimated_clv,
    (days_since_registration IS NULL OR days_since_registration < {LOW_CONFIDENCE_DAYS}) AS low_confidence
  FROM scored_p
),
scored_ev AS (
  SELECT *, churn_probability * {SUCCESS} * estimated_clv
            - {COST} * estimated_clv AS expected_value
  FROM scored
)"""


def all_oracles() -> dict[str, str]:
    return {k: _round_to_r6(v) for k, v in ORACLES.items()}


def with_prefix(ctes: str, final: str) -> str:
    return ORACLE_PREFIX + ctes + "\n" + final


# ------------------------------------------------------------- registered SQL

ORACLES: dict[str, str] = {}


def _eng_final(cfg: FeatureConfig = CFG) -> str:
    cols = []
    for c in engagement_names(cfg):
        cols.append(c if (c == "days_since_last_log" or c.startswith("active_days_")) else f"{r6(c)} AS {c}")
    return ", ".join(cols)


def _round_doubles(names: list[str]) -> str:
    return ", ".join(f"{r6(n)} AS {n}" for n in names)


_LOG_DOUBLES = [c for c in engagement_names() if c.startswith(("avg_", "recent_", "prior_"))]

ORACLES["log_aggregate"] = with_prefix(logs_agg_cte(), f"""
SELECT msno, CAST(days_since_last_log AS INTEGER) AS days_since_last_log,
  {", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in engagement_names() if c.startswith("active_days_"))},
  {_round_doubles(_LOG_DOUBLES)}
FROM logs_agg""")

ORACLES["engagement_features"] = with_prefix(logs_agg_cte() + f""",
base AS (SELECT DISTINCT msno FROM train),
eng AS (SELECT b.msno, {", ".join(engagement_select("la"))}
        FROM base b LEFT JOIN logs_agg la ON b.msno = la.msno),
eng2 AS (SELECT *, {TREND} FROM eng)""", f"""
SELECT msno, {_eng_final()}, {r6("engagement_trend_secs_ratio")} AS engagement_trend_secs_ratio,
       {r6("engagement_trend_songs_ratio")} AS engagement_trend_songs_ratio
FROM eng2""")

ORACLES["lifetime_log_stats"] = with_prefix("", """
SELECT msno, count(*) AS total_log_days, CAST(sum(num_25) AS BIGINT) AS total_num_25,
       CAST(sum(num_100) AS BIGINT) AS total_num_100, round(avg(total_secs), 6) AS avg_daily_secs
FROM user_logs GROUP BY msno""")

_TX_COLS = ("msno, payment_method_id, payment_plan_days, plan_list_price, actual_amount_paid, is_auto_renew, "
            "strftime(transaction_date, '%Y-%m-%d') AS transaction_date, "
            "strftime(membership_expire_date, '%Y-%m-%d') AS membership_expire_date, is_cancel, seq")

ORACLES["same_day_dedup"] = with_prefix("", f"SELECT {_TX_COLS} FROM dedup_all")
ORACLES["cutoff_transactions"] = with_prefix("", f"SELECT {_TX_COLS} FROM transactions")

ORACLES["registered_via_frequency"] = with_prefix("", """
SELECT registered_via, count(*) AS n,
       round(count(*) / (SELECT count(registered_via) FROM members), 6) AS freq
FROM members WHERE registered_via IS NOT NULL GROUP BY registered_via""")

ORACLES["demographic_features"] = with_prefix(features_cte(), """
SELECT msno, city, gender, age_clean, registered_via_clean FROM features""")

ORACLES["transaction_features"] = with_prefix(features_cte(), """
SELECT msno, round(plan_list_price, 6) AS plan_list_price, payment_plan_days, is_auto_renew, payment_method_id,
       num_plan_changes, num_payment_methods, num_cancellations, days_since_last_transaction
FROM features""")

ORACLES["tenure_features"] = with_prefix(features_cte(), """
SELECT msno, days_since_registration, days_until_expire FROM features""")

_FEATURE_DOUBLES = ["plan_list_price", *_LOG_DOUBLES, "engagement_trend_secs_ratio", "engagement_trend_songs_ratio"]


def feature_select(extra_doubles: tuple[str, ...] = (), extra: tuple[str, ...] = ()) -> str:
    from lapse.operators.features import feature_columns
    cols = []
    for c in ["msno", *feature_columns(CFG), "is_churn", *extra]:
        cols.append(f"{r6(c)} AS {c}" if (c in _FEATURE_DOUBLES or c in extra_doubles) else c)
    return ", ".join(cols)


ORACLES["customer_feature_table"] = with_prefix(features_cte(), f"SELECT {feature_select()} FROM features")

ORACLES["churn_labels"] = with_prefix("", """
SELECT msno, strftime(last_expire_date, '%Y-%m-%d') AS last_expire_date,
       strftime(next_renewal_date, '%Y-%m-%d') AS next_renewal_date, renewal_gap_days, is_churn
FROM churn_labels""")

ORACLES["class_balance"] = with_prefix("", """
SELECT count(*) AS n, CAST(sum(is_churn) AS BIGINT) AS n_pos, CAST(count(*) - sum(is_churn) AS BIGINT) AS n_neg,
       round(sum(is_churn) / count(*), 6) AS positive_rate,
       round(coalesce((count(*) - sum(is_churn)) / NULLIF(sum(is_churn), 0), 1.0), 6) AS scale_pos_weight
FROM train""")


# ------------------------------------------------- phase 3: value and serving

_PRED = ("msno, round(churn_probability, 6) AS churn_probability, risk_tier, round(estimated_clv, 6) AS estimated_clv, "
         "round(expected_value, 6) AS expected_value, low_confidence")
_ACT = ("msno, round(expected_value, 6) AS expected_value, round(churn_probability, 6) AS churn_probability, "
        "round(estimated_clv, 6) AS estimated_clv")
_EVORD = "expected_value DESC NULLS LAST, msno"

ORACLES["scored_customers"] = with_prefix(scored_cte(), f"""
SELECT {_PRED}, round((1.0 - churn_probability) * 100.0, 6) AS retention_score FROM scored_ev""")

ORACLES["clv_flat"] = with_prefix("", f"""
SELECT msno, seq, round(actual_amount_paid * {LIFESPAN}, 6) AS estimated_clv FROM transactions""")

ORACLES["prioritized_actions"] = with_prefix(scored_cte(), f"""
SELECT row_number() OVER (ORDER BY {_EVORD}) AS rank, {_ACT} FROM scored_ev""")

ORACLES["top_actions"] = with_prefix(scored_cte(), f"SELECT {_ACT} FROM scored_ev ORDER BY {_EVORD} LIMIT 10")

ORACLES["top_actions_repriced"] = with_prefix(scored_cte() + """,
repriced AS (SELECT * REPLACE (churn_probability * 0.5 * estimated_clv - 0.1 * estimated_clv AS expected_value)
             FROM scored_ev)""", f"SELECT {_ACT} FROM repriced ORDER BY {_EVORD} LIMIT 10")

ORACLES["top_actions_segment"] = with_prefix(scored_cte(), f"""
SELECT {_ACT} FROM scored_ev WHERE payment_plan_days = 30 AND days_since_registration >= 30
ORDER BY {_EVORD} LIMIT 10""")


def diversified_sql(n: int, where: str = "TRUE") -> str:
    return with_prefix(scored_cte() + f""",
pool AS (SELECT * FROM scored_ev WHERE {where}),
strata AS (
  SELECT *, CASE WHEN churn_probability >= {HIGH} THEN 0 WHEN churn_probability >= {MEDIUM} THEN 1
                 WHEN days_since_registration < {LOW_NEW_DAYS} THEN 2 END AS stratum
  FROM pool),
picked AS (
  SELECT * EXCLUDE (rn, stratum) FROM (
    SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {_EVORD}) AS rn FROM strata WHERE stratum IS NOT NULL)
  WHERE rn <= CASE stratum WHEN 0 THEN {QUOTA_HIGH} WHEN 1 THEN {QUOTA_MEDIUM} ELSE {QUOTA_LOW_NEW} END),
fill AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (ORDER BY {_EVORD}) AS rn FROM pool WHERE msno NOT IN (SELECT msno FROM picked))
  WHERE rn <= {n} - (SELECT count(*) FROM picked))""",
        f"SELECT {_ACT} FROM picked UNION ALL SELECT {_ACT} FROM fill")


ORACLES["diversified_actions"] = diversified_sql(10)
ORACLES["diversified_actions_wide"] = diversified_sql(25, "payment_plan_days = 30")


def _tier_sql(where: str = "TRUE") -> str:
    return f"""
SELECT *, 'High=' || CAST(floor(high_share * 1e6 + 0.5) AS BIGINT) || ',Low=' || CAST(floor(low_share * 1e6 + 0.5) AS BIGINT)
          || ',Medium=' || CAST(floor(medium_share * 1e6 + 0.5) AS BIGINT) AS risk_tier_distribution
FROM (SELECT count(*) AS total_customers, round(coalesce(avg(churn_probability), 0.0), 6) AS churn_rate,
  round(coalesce(avg(CAST(churn_probability >= {HIGH} AS DOUBLE)), 0.0), 6) AS high_share,
  round(coalesce(avg(CAST(churn_probability >= {MEDIUM} AND churn_probability < {HIGH} AS DOUBLE)), 0.0), 6) AS medium_share,
  round(coalesce(avg(CAST(churn_probability < {MEDIUM} AS DOUBLE)), 0.0), 6) AS low_share
FROM scored_ev WHERE {where})"""


ORACLES["cohort_stats_all"] = with_prefix(scored_cte(), _tier_sql())
ORACLES["cohort_stats_segment"] = with_prefix(scored_cte(), _tier_sql("payment_plan_days = 30 AND days_since_registration >= 30"))
ORACLES["cohort_stats_empty"] = with_prefix(scored_cte(), _tier_sql("payment_plan_days = -12345"))

ORACLES["segment_cube"] = with_prefix(scored_cte() + """,
bucketed AS (SELECT *, CASE WHEN days_since_registration < 30 THEN 'new'
                            WHEN days_since_registration >= 30 THEN 'old' END AS tenure_bucket FROM scored_ev)""",
                                      f"""
SELECT payment_plan_days, tenure_bucket, grouping_id(payment_plan_days, tenure_bucket) AS grouping_id,
  count(*) AS total_customers, round(coalesce(avg(churn_probability), 0.0), 6) AS churn_rate,
  round(coalesce(avg(CAST(churn_probability >= {HIGH} AS DOUBLE)), 0.0), 6) AS high_share,
  round(coalesce(avg(CAST(churn_probability >= {MEDIUM} AND churn_probability < {HIGH} AS DOUBLE)), 0.0), 6) AS medium_share,
  round(coalesce(avg(CAST(churn_probability < {MEDIUM} AS DOUBLE)), 0.0), 6) AS low_share
FROM bucketed GROUP BY CUBE (payment_plan_days, tenure_bucket)""")

ORACLES["risk_distribution"] = with_prefix(scored_cte(), f"""
SELECT count(*) AS total_customers,
  round(avg(CAST(churn_probability >= {HIGH} AS DOUBLE)) * 100, 6) AS high_pct,
  round(avg(CAST(churn_probability >= {MEDIUM} AND churn_probability < {HIGH} AS DOUBLE)) * 100, 6) AS medium_pct
FROM scored_ev""")

ORACLES["customer_profile"] = with_prefix(scored_cte(), """
SELECT msno, city, gender, age_clean, registered_via_clean, round(plan_list_price, 6) AS plan_list_price,
       payment_plan_days, is_auto_renew, days_since_registration
FROM scored_ev WHERE msno = '10'""")

ORACLES["search_ids"] = with_prefix(scored_cte(), """
SELECT msno FROM scored_ev WHERE contains(lower(msno), '12') ORDER BY msno LIMIT 10""")

ORACLES["url_safe_ids"] = with_prefix(scored_cte(), """
SELECT msno FROM scored_ev WHERE NOT contains(msno, '/') ORDER BY msno LIMIT 50""")

ORACLES["seeded_sample"] = with_prefix(scored_cte(), """
SELECT msno FROM scored_ev ORDER BY md5(msno || ':42'), msno LIMIT 50""")

ORACLES["batch_lookup"] = with_prefix(scored_cte() + """,
requests AS (SELECT CAST(floor(c_custkey / 1000) AS BIGINT) AS request_id, CAST(c_custkey % 1000 AS INTEGER) AS pos,
                    CAST(c_custkey AS VARCHAR) AS msno FROM customer)""", f"""
SELECT r.request_id, r.pos, r.msno, s.msno IS NOT NULL AS success,
       CASE WHEN s.msno IS NULL THEN 'Customer not found' END AS error_message,
       round(s.churn_probability, 6) AS churn_probability, s.risk_tier, round(s.estimated_clv, 6) AS estimated_clv,
       round(s.expected_value, 6) AS expected_value, s.low_confidence
FROM requests r LEFT JOIN scored_ev s ON r.msno = s.msno""")

ORACLES["usage_history"] = with_prefix("", """
SELECT msno, CAST(row_number() OVER (PARTITION BY msno ORDER BY log_date, total_secs, num_unq) AS INTEGER) AS day_no,
       strftime(log_date, '%Y-%m-%d') AS date, round(total_secs, 6) AS total_secs, num_unq FROM user_logs""")

ORACLES["usage_share_of_max"] = with_prefix("", """
SELECT msno, strftime(log_date, '%Y-%m-%d') AS log_date, round(total_secs, 6) AS total_secs,
       round(total_secs / CASE WHEN max(total_secs) OVER (PARTITION BY msno) > 0
                               THEN max(total_secs) OVER (PARTITION BY msno) ELSE 1.0 END * 100.0, 6) AS pct_of_max
FROM user_logs""")

ORACLES["what_if"] = with_prefix(scored_cte() + f""",
scen AS (
  SELECT 'auto_renew_on' AS scenario_id, msno, CAST(NULL AS DOUBLE) AS o_price, CAST(NULL AS INTEGER) AS o_days,
         1 AS o_auto, CAST(NULL AS INTEGER) AS o_tenure FROM scored_ev
  UNION ALL
  SELECT 'annual_plan_99', msno, 99.0, 410, NULL, NULL FROM scored_ev
  UNION ALL
  SELECT 'new_member', msno, NULL, NULL, NULL, 7 FROM scored_ev),
sim AS (
  SELECT * EXCLUDE (_x), _x * _x AS churn_probability FROM (SELECT *, {STAND_IN} AS _x FROM (
  SELECT s.scenario_id, f.msno,
         coalesce(s.o_price, f.plan_list_price) AS plan_list_price,
         coalesce(s.o_days, f.payment_plan_days) AS payment_plan_days,
         coalesce(s.o_auto, f.is_auto_renew) AS is_auto_renew,
         coalesce(s.o_tenure, f.days_since_registration) AS days_since_registration
  FROM scen s JOIN scored_ev f ON s.msno = f.msno))),
sim2 AS (
  SELECT *,
    CASE WHEN churn_probability >= {HIGH} THEN 'High' WHEN churn_probability >= {MEDIUM} THEN 'Medium'
         ELSE 'Low' END AS risk_tier,
    CASE WHEN plan_list_price IS NULL OR payment_plan_days IS NULL OR payment_plan_days <= 0
         THEN CAST({MONTHLY} AS DOUBLE) * {LIFESPAN}
         ELSE plan_list_price * (30.0 / payment_plan_days) * {LIFESPAN} END AS estimated_clv,
    (days_since_registration IS NULL OR days_since_registration < {LOW_CONFIDENCE_DAYS}) AS low_confidence
  FROM sim)""", f"""
SELECT scenario_id, msno, round(plan_list_price, 6) AS plan_list_price, payment_plan_days, is_auto_renew,
       days_since_registration, round(churn_probability, 6) AS churn_probability, risk_tier,
       round(estimated_clv, 6) AS estimated_clv,
       round(churn_probability * {SUCCESS} * estimated_clv - {COST} * estimated_clv, 6) AS expected_value,
       low_confidence
FROM sim2""")


# ----------------------------------------------- phase 4: profiles and EDA

def _null_pct_sql(view: str, cols: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(avg(CAST({c} IS NULL AS DOUBLE)) * 100, 6) AS null_pct FROM {view}"
        for c in cols)


_MEMBER_COLS = ["msno", "city", "bd", "gender", "registered_via", "registration_init_time"]
_RAW_TX_COLS = ["msno", "payment_method_id", "payment_plan_days", "plan_list_price", "actual_amount_paid",
                "is_auto_renew", "transaction_date", "membership_expire_date", "is_cancel", "seq"]

ORACLES["null_percent_members"] = with_prefix("", _null_pct_sql("members", _MEMBER_COLS))
ORACLES["null_percent_transactions"] = with_prefix("", _null_pct_sql("raw_transactions", _RAW_TX_COLS))

ORACLES["duplicate_transactions"] = with_prefix("", """
SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows
FROM (SELECT count(*) AS n FROM raw_transactions GROUP BY msno, transaction_date)""")

ORACLES["transaction_date_range"] = with_prefix("", """
SELECT 'transaction_date' AS "column", strftime(min(transaction_date), '%Y-%m-%d') AS min_date,
       strftime(max(transaction_date), '%Y-%m-%d') AS max_date FROM raw_transactions
UNION ALL
SELECT 'membership_expire_date', strftime(min(membership_expire_date), '%Y-%m-%d'),
       strftime(max(membership_expire_date), '%Y-%m-%d') FROM raw_transactions""")

ORACLES["monthly_transactions"] = with_prefix(""",
counts AS (SELECT date_trunc('month', transaction_date) AS month, count(*) AS n
           FROM raw_transactions WHERE transaction_date IS NOT NULL GROUP BY 1),
cal AS (SELECT unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS month FROM counts)""", """
SELECT strftime(cal.month, '%Y-%m-%d') AS month, CAST(coalesce(counts.n, 0) AS BIGINT) AS n
FROM cal LEFT JOIN counts ON CAST(cal.month AS DATE) = CAST(counts.month AS DATE)""")

ORACLES["key_coverage"] = with_prefix(""",
ids AS (SELECT DISTINCT msno FROM train)""", """
SELECT 'members' AS "table", count(*) AS found,
       round(count(*) / (SELECT count(*) FROM ids) * 100, 6) AS coverage_pct
FROM ids WHERE msno IN (SELECT msno FROM members)
UNION ALL
SELECT 'transactions', count(*), round(count(*) / (SELECT count(*) FROM ids) * 100, 6)
FROM ids WHERE msno IN (SELECT msno FROM raw_transactions)
UNION ALL
SELECT 'user_logs', count(*), round(count(*) / (SELECT count(*) FROM ids) * 100, 6)
FROM ids WHERE msno IN (SELECT msno FROM user_logs)""")

ORACLES["distinct_log_ids"] = with_prefix("", "SELECT DISTINCT msno FROM user_logs")

ORACLES["listening_by_label"] = with_prefix("", """
SELECT t.is_churn, round(avg(l.total_secs), 6) AS avg_secs
FROM user_logs l JOIN train t ON l.msno = t.msno GROUP BY t.is_churn""")

ORACLES["churn_rate_by_city"] = with_prefix("", """
SELECT m.city, count(*) AS n, round(avg(CAST(t.is_churn AS DOUBLE)), 6) AS churn_rate
FROM train t LEFT JOIN members m ON t.msno = m.msno GROUP BY m.city""")


def _profile_sql(view: str, num_cols: list[str]) -> str:
    parts = [f"SELECT '*' AS \"column\", 'rows' AS stat, CAST(count(*) AS DOUBLE) AS value FROM {view}"]
    for c in num_cols:
        x = f"CAST({c} AS DOUBLE)"
        for stat, expr in (("count", f"CAST(count({x}) AS DOUBLE)"), ("mean", f"avg({x})"),
                           ("std", f"stddev_samp({x})"), ("min", f"min({x})"), ("max", f"max({x})"),
                           ("25%", f"quantile_cont({x}, 0.25)"), ("50%", f"quantile_cont({x}, 0.5)"),
                           ("75%", f"quantile_cont({x}, 0.75)")):
            parts.append(f"SELECT '{c}', '{stat}', {expr} FROM {view}")
    return f"SELECT \"column\", stat, round(value, 6) AS value FROM ({' UNION ALL '.join(parts)})"


ORACLES["member_profile"] = with_prefix("", _profile_sql("members", ["city", "bd", "registered_via"]))
ORACLES["transaction_profile"] = with_prefix("", _profile_sql("raw_transactions", [
    "payment_method_id", "payment_plan_days", "plan_list_price", "actual_amount_paid", "is_auto_renew", "is_cancel", "seq"]))
ORACLES["log_profile"] = with_prefix("", _profile_sql("user_logs", ["num_25", "num_100", "num_unq", "total_secs"]))
ORACLES["label_profile"] = with_prefix("", _profile_sql("train", ["is_churn"]))

# The columns and Spark types of the four views.
_TYPES = {
    "members": "msno string, city int, bd int, gender string, registered_via int, registration_init_time date",
    "transactions": "msno string, payment_method_id int, payment_plan_days int, plan_list_price double, "
                    "actual_amount_paid double, is_auto_renew int, transaction_date date, "
                    "membership_expire_date date, is_cancel int, seq bigint",
    "user_logs": "msno string, log_date date, num_25 int, num_100 int, num_unq int, total_secs double",
    "train": "msno string, is_churn int",
}
ORACLES["table_types"] = with_prefix("", " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", '{c.split()[0]}' AS \"column\", {i} AS position, '{c.split()[1]}' AS type, "
    f"CAST(count(*) FILTER (WHERE {c.split()[0]} IS NULL) AS BIGINT) AS n_null FROM {'raw_transactions' if t == 'transactions' else t}"
    for t, columns in _TYPES.items() for i, c in enumerate(columns.split(", "))))

ORACLES["score_histogram"] = with_prefix(scored_cte() + """,
mm AS (SELECT min(churn_probability) AS lo, max(churn_probability) AS hi,
              (max(churn_probability) - min(churn_probability)) / CAST(50 AS DOUBLE) AS step FROM scored_ev),
binned AS (
  SELECT least(len(list_filter(list_transform(range(1, 50), lambda j: mm.lo + CAST(j AS DOUBLE) * mm.step),
                               lambda e: e <= s.churn_probability)), 49) AS bin
  FROM scored_ev s, mm),
counts AS (SELECT bin, count(*) AS n FROM binned GROUP BY bin),
bins AS (SELECT unnest(range(0, 50)) AS bin)""", """
SELECT CAST(b.bin AS INTEGER) AS bin, round(mm.lo + CAST(b.bin AS DOUBLE) * mm.step, 6) AS bin_lo,
       round(CASE WHEN b.bin = 49 THEN mm.hi ELSE mm.lo + CAST(b.bin + 1 AS DOUBLE) * mm.step END, 6) AS bin_hi,
       CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM bins b CROSS JOIN mm LEFT JOIN counts c ON b.bin = c.bin""")


# ---------------------------------------------------- phase 5: evaluation

def _eval_cte() -> str:
    return scored_cte() + """,
g AS (SELECT CAST(churn_probability AS DOUBLE) AS score, CAST(sum(is_churn) AS BIGINT) AS pos,
             CAST(sum(1 - is_churn) AS BIGINT) AS neg
      FROM scored_ev WHERE churn_probability IS NOT NULL AND is_churn IS NOT NULL GROUP BY 1),
tot AS (SELECT CAST(sum(pos) AS DOUBLE) AS P, CAST(sum(neg) AS DOUBLE) AS N, count(*) AS G FROM g),
t AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, row_number() OVER w AS idx
      FROM g WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


ORACLES["roc_auc"] = with_prefix(_eval_cte(), """
SELECT round(sum(neg * ((tp - pos) + pos / 2.0)) / ((SELECT P FROM tot) * (SELECT N FROM tot)), 6) AS roc_auc FROM t""")

ORACLES["average_precision"] = with_prefix(_eval_cte(), """
SELECT round(sum(pos * (CAST(tp AS DOUBLE) / (tp + fp))) / (SELECT P FROM tot), 6) AS average_precision FROM t""")


def _confusion_cte(th: float) -> str:
    return f""",
c AS (SELECT count(CASE WHEN churn_probability < {th} AND is_churn = 0 THEN 1 END) AS tn,
             count(CASE WHEN churn_probability >= {th} AND is_churn = 0 THEN 1 END) AS fp,
             count(CASE WHEN churn_probability < {th} AND is_churn = 1 THEN 1 END) AS fn,
             count(CASE WHEN churn_probability >= {th} AND is_churn = 1 THEN 1 END) AS tp,
             avg(pow(churn_probability - is_churn, 2)) AS brier_score
      FROM scored_ev WHERE churn_probability IS NOT NULL AND is_churn IS NOT NULL)"""


_CONFUSION = """tn, fp, fn, tp,
       round(coalesce(CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0), 0.0), 6) AS precision,
       round(coalesce(CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0), 0.0), 6) AS recall,
       round(coalesce(CAST(2 * tp AS DOUBLE) / NULLIF(2 * tp + fp + fn, 0), 0.0), 6) AS f1_score,
       round(brier_score, 6) AS brier_score"""


def _confusion_sql(th: float) -> str:
    return with_prefix(scored_cte() + _confusion_cte(th), f"SELECT {_CONFUSION} FROM c")


ORACLES["score_summary"] = with_prefix(_eval_cte() + _confusion_cte(0.245), f"""
SELECT {_CONFUSION},
       (SELECT round(sum(neg * ((tp - pos) + pos / 2.0)) / ((SELECT P FROM tot) * (SELECT N FROM tot)), 6) FROM t) AS roc_auc,
       (SELECT round(sum(pos * (CAST(tp AS DOUBLE) / (tp + fp))) / (SELECT P FROM tot), 6) FROM t) AS pr_auc
FROM c""")
ORACLES["confusion_at_half"] = _confusion_sql(0.5)
ORACLES["confusion_report"] = _confusion_sql(0.245)


def _thin_sel(n: int = 100) -> str:
    # length - 1 = G (one point more than distinct scores)
    return f"""sel AS (SELECT CAST(r.range AS INTEGER) AS j,
       CAST(CASE WHEN r.range = {n - 1} THEN (SELECT G FROM tot)
            ELSE floor(CAST(r.range AS DOUBLE) * (CAST((SELECT G FROM tot) AS DOUBLE) / CAST({n - 1} AS DOUBLE))) END AS BIGINT) AS idx
  FROM range({n}) r)"""


ORACLES["roc_curve"] = with_prefix(_eval_cte() + f""",
pts AS (SELECT CAST(idx AS BIGINT) AS idx, fp / (SELECT N FROM tot) AS fpr, tp / (SELECT P FROM tot) AS tpr FROM t
        UNION ALL SELECT 0, 0.0, 0.0),
{_thin_sel()}""", """
SELECT sel.j, sel.idx, round(pts.fpr, 6) AS fpr, round(pts.tpr, 6) AS tpr FROM sel JOIN pts ON sel.idx = pts.idx""")

ORACLES["pr_curve"] = with_prefix(_eval_cte() + f""",
pts AS (SELECT CAST((SELECT G FROM tot) - idx AS BIGINT) AS idx, CAST(tp AS DOUBLE) / (tp + fp) AS precision,
               coalesce(tp / NULLIF((SELECT P FROM tot), 0), 1.0) AS recall FROM t
        UNION ALL SELECT (SELECT G FROM tot), 1.0, 0.0),
{_thin_sel()}""", """
SELECT sel.j, sel.idx, round(pts.precision, 6) AS precision, round(pts.recall, 6) AS recall
FROM sel JOIN pts ON sel.idx = pts.idx""")

_EDGES = ", ".join(f"CAST('{j * (1.0 / 10)!r}' AS DOUBLE)" for j in range(1, 10))

ORACLES["calibration_curve"] = with_prefix(scored_cte(), f"""
SELECT CAST(len(list_filter([{_EDGES}], lambda e: e < churn_probability)) AS INTEGER) AS bin, count(*) AS n,
       round(avg(churn_probability), 6) AS prob_pred, round(avg(CAST(is_churn AS DOUBLE)), 6) AS prob_true
FROM scored_ev WHERE churn_probability IS NOT NULL AND is_churn IS NOT NULL GROUP BY 1""")

ORACLES["score_percentiles"] = with_prefix(scored_cte(), """
SELECT round(quantile_cont(churn_probability, 0.95), 6) AS q_95, round(quantile_cont(churn_probability, 0.85), 6) AS q_85
FROM scored_ev""")

ORACLES["tier_thresholds"] = with_prefix(scored_cte() + """,
pc AS (SELECT quantile_cont(churn_probability, 0.95) AS hi, quantile_cont(churn_probability, 0.85) AS md FROM scored_ev)""", """
SELECT 'High' AS tier, round(hi, 6) AS min_prob, CAST(NULL AS DOUBLE) AS max_prob FROM pc
UNION ALL SELECT 'Medium', round(md, 6), round(hi, 6) FROM pc
UNION ALL SELECT 'Low', 0.0, round(md, 6) FROM pc""")


# ------------------------------------------------------- phase 6: modelling

_SPLIT_CTE = features_cte() + """,
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY is_churn ORDER BY substr(md5(msno || ':42'), 1, 15), msno) AS rk,
         ceil(count(*) OVER (PARTITION BY is_churn) * CAST(0.2 AS DOUBLE)) AS n_test
  FROM features),
split AS (
  SELECT *, CASE WHEN rk <= n_test THEN 'test' ELSE 'train' END AS split,
         CASE WHEN rk <= n_test THEN NULL ELSE CAST((rk - n_test - 1) % 3 AS INTEGER) END AS fold
  FROM ranked)"""

ORACLES["train_test_split"] = with_prefix(_SPLIT_CTE, "SELECT msno, is_churn, split, fold FROM split")

ORACLES["class_weights"] = with_prefix(_SPLIT_CTE + """,
tr AS (SELECT * FROM split WHERE split = 'train'),
cw AS (SELECT CAST(count(*) - sum(is_churn) AS DOUBLE) AS neg, CAST(sum(is_churn) AS DOUBLE) AS pos FROM tr)""", """
SELECT msno, is_churn,
       round(CASE WHEN is_churn = 1 THEN coalesce((SELECT neg FROM cw) / NULLIF((SELECT pos FROM cw), 0), 1.0)
                  ELSE 1.0 END, 6) AS weight
FROM tr""")


# ---------------------------------------------- phase 7: attribution, actions

def _standin_long_cte() -> str:
    from lapse.operators.attribute import standin_weights
    w = standin_weights()
    parts = []
    for pos, (f, wt) in enumerate(w.items()):
        parts.append(f"SELECT msno, risk_tier, '{f}' AS feature, {pos} AS pos, "
                     f"CAST('{wt!r}' AS DOUBLE) * CAST({f} AS DOUBLE) "
                     f"AS contribution FROM scored_ev")
    return scored_cte() + f""",
contrib AS ({' UNION ALL '.join(parts)}),
top3 AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY msno ORDER BY abs(contribution) DESC, pos) - 1 AS rk FROM contrib)
  WHERE rk < {DRIVERS})"""


ORACLES["feature_contributions"] = with_prefix(_standin_long_cte(), """
SELECT msno, feature, round(contribution, 6) AS contribution FROM contrib""")

ORACLES["top_drivers"] = with_prefix(_standin_long_cte(), """
SELECT msno, CAST(rk AS INTEGER) AS rank,
       feature || ' (' || CASE WHEN contribution > 0 THEN 'High' ELSE 'Low' END || ')' AS driver
FROM top3""")


# The action rule's driver families and texts.
_FAMILIES = """CASE WHEN feature IN ('payment_method_id', 'is_cancel', 'days_since_last_transaction') THEN 'Offer alternative payment method'
     WHEN feature IN ('days_until_expire', 'is_auto_renew') THEN 'Proactive renewal outreach'
     WHEN feature IN ('plan_list_price', 'actual_amount_paid', 'payment_plan_days') THEN 'Offer discount' END"""


def _actions_sql() -> str:
    return with_prefix(_standin_long_cte() + f""",
hits AS (SELECT msno, rk, {_FAMILIES} AS action FROM top3 WHERE contribution > 0),
first_hit AS (SELECT msno, arg_min(action, rk) AS action FROM hits WHERE action IS NOT NULL GROUP BY msno)""", """
SELECT s.msno, s.risk_tier,
       CASE WHEN s.risk_tier = 'Low' THEN 'No action needed' WHEN s.risk_tier = 'Medium' THEN 'Send engagement email'
            ELSE coalesce(h.action, 'Send targeted retention offer') END AS suggested_action
FROM scored_ev s LEFT JOIN first_hit h ON s.msno = h.msno""")


ORACLES["retention_actions"] = _actions_sql()

def _label_case(col: str) -> str:
    from lapse.config import FEATURE_LABELS
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FEATURE_LABELS.items())
    return f"CASE {col} {whens} ELSE {col} END"


ORACLES["global_drivers"] = with_prefix(_standin_long_cte() + """,
g AS (SELECT feature, avg(abs(contribution)) AS impact, avg(contribution) AS mean_c FROM contrib GROUP BY feature),
top AS (SELECT * FROM g ORDER BY impact DESC, feature LIMIT 15)""", f"""
SELECT feature, round(impact, 6) AS impact, CASE WHEN mean_c > 0 THEN 'High' ELSE 'Low' END AS direction,
       round(impact / max(impact) OVER (), 6) AS share_of_max, {_label_case('feature')} AS label
FROM top""")


def _model_input_sql() -> str:
    from lapse import config as C
    cols = ["msno"]
    for c in C.MODEL_FEATURES:
        if c in C.CATEGORICAL_FEATURES:
            cols.append(c)
        elif c in _FEATURE_DOUBLES:
            cols.append(f"round(coalesce({c}, 0), 6) AS {c}")
        else:
            cols.append(f"coalesce({c}, 0) AS {c}")
    return with_prefix(scored_cte(), f"SELECT {', '.join(cols)} FROM scored_ev")


ORACLES["model_input"] = _model_input_sql()


# ------------------------------------------ many dates, states, layouts
# Dates, gaps and limits are written out here, independent of the Spark side's settings.

_LABEL_FINAL = """
SELECT msno, strftime(cutoff_date, '%Y-%m-%d') AS cutoff_date, strftime(last_expire_date, '%Y-%m-%d') AS last_expire_date,
       strftime(next_renewal_date, '%Y-%m-%d') AS next_renewal_date,
       CAST(date_diff('day', last_expire_date, next_renewal_date) AS INTEGER) AS renewal_gap_days,
       CAST(next_renewal_date IS NULL OR last_expire_date IS NULL
            OR date_diff('day', last_expire_date, next_renewal_date) >= 270 AS INTEGER) AS is_churn
FROM matched"""
_ASOF_LABELS = """,
expiry AS (SELECT a.msno, a.cutoff_date, d.membership_expire_date AS last_expire_date
           FROM asked a ASOF JOIN dedup_all d ON a.msno = d.msno AND a.cutoff_date >= d.transaction_date),
paid AS (SELECT msno, transaction_date AS next_renewal_date FROM raw_transactions WHERE is_cancel = 0),
matched AS (SELECT e.*, p.next_renewal_date
            FROM expiry e ASOF LEFT JOIN paid p ON e.msno = p.msno AND e.cutoff_date < p.next_renewal_date)"""

ORACLES["churn_labels_monthly"] = with_prefix(""",
ends AS (SELECT CAST(last_day(d) AS DATE) AS cutoff_date FROM generate_series(DATE '2000-01-01', DATE '2000-12-01', INTERVAL 1 MONTH) t(d)),
asked AS (SELECT msno, cutoff_date FROM (SELECT DISTINCT msno FROM raw_transactions) CROSS JOIN ends)""" + _ASOF_LABELS, _LABEL_FINAL)

ORACLES["churn_labels_asof"] = with_prefix(""",
asked AS (SELECT DISTINCT msno, CAST(registration_init_time + CAST(365 * y AS INTEGER) AS DATE) AS cutoff_date
          FROM members, range(1, 6) t(y))""" + _ASOF_LABELS, _LABEL_FINAL)

ORACLES["price_as_of_log"] = with_prefix("", """
SELECT u.msno, strftime(u.log_date, '%Y-%m-%d') AS log_date, round(u.total_secs, 6) AS total_secs, d.plan_list_price,
       d.payment_plan_days, strftime(d.transaction_date, '%Y-%m-%d') AS transaction_date
FROM user_logs u ASOF LEFT JOIN dedup_all d ON u.msno = d.msno AND u.log_date >= d.transaction_date""")

_SNAPSHOT_CTE = """,
refs AS (SELECT CAST(unnest(['2001-07-01', '2001-07-05', '2001-07-10', '2001-07-15', '2001-07-20', '2001-07-25', '2001-07-28',
         '2001-07-31', '2001-08-10', '2001-08-31', '2001-09-15', '2001-12-31']) AS DATE) AS reference_date),
aged AS (SELECT msno, reference_date, date_diff('day', log_date, reference_date) AS age, num_100, num_unq, total_secs
         FROM user_logs, refs WHERE log_date <= reference_date),
logs_agg AS (
  SELECT msno, reference_date, min(age) AS days_since_last_log,
    count(*) FILTER (WHERE age <= 7) AS active_days_7, avg(num_100) FILTER (WHERE age <= 7) AS avg_songs_100_7,
    avg(total_secs) FILTER (WHERE age <= 7) AS avg_secs_7, avg(num_unq) FILTER (WHERE age <= 7) AS avg_unq_7,
    count(*) FILTER (WHERE age <= 14) AS active_days_14, avg(num_100) FILTER (WHERE age <= 14) AS avg_songs_100_14,
    avg(total_secs) FILTER (WHERE age <= 14) AS avg_secs_14,
    count(*) FILTER (WHERE age <= 30) AS active_days_30, avg(num_100) FILTER (WHERE age <= 30) AS avg_songs_100_30,
    avg(total_secs) FILTER (WHERE age <= 30) AS avg_secs_30,
    avg(total_secs) FILTER (WHERE age <= 14) AS recent_avg_secs, avg(num_100) FILTER (WHERE age <= 14) AS recent_avg_songs,
    avg(total_secs) FILTER (WHERE age BETWEEN 15 AND 28) AS prior_avg_secs, avg(num_100) FILTER (WHERE age BETWEEN 15 AND 28) AS prior_avg_songs
  FROM aged GROUP BY msno, reference_date)"""

ORACLES["log_snapshots"] = with_prefix(_SNAPSHOT_CTE, f"""
SELECT msno, strftime(reference_date, '%Y-%m-%d') AS reference_date, CAST(days_since_last_log AS INTEGER) AS days_since_last_log,
  {", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in engagement_names() if c.startswith("active_days_"))},
  {_round_doubles(_LOG_DOUBLES)}
FROM logs_agg""")

ORACLES["engagement_snapshots"] = with_prefix(_SNAPSHOT_CTE + f""",
asked AS (SELECT msno, reference_date FROM (SELECT DISTINCT msno FROM train) CROSS JOIN refs),
eng AS (SELECT a.msno, a.reference_date, {", ".join(engagement_select("la"))}
        FROM asked a LEFT JOIN logs_agg la ON a.msno = la.msno AND a.reference_date = la.reference_date),
eng2 AS (SELECT *, {TREND} FROM eng)""", f"""
SELECT msno, strftime(reference_date, '%Y-%m-%d') AS reference_date, {_eng_final()},
       {r6("engagement_trend_secs_ratio")} AS engagement_trend_secs_ratio, {r6("engagement_trend_songs_ratio")} AS engagement_trend_songs_ratio
FROM eng2""")

ORACLES["history_from_states"] = with_prefix(features_cte(), """
SELECT h.msno, l.plan_list_price AS last_plan_list_price, l.payment_plan_days AS last_payment_plan_days, l.is_auto_renew AS last_is_auto_renew,
       l.payment_method_id AS last_payment_method_id, strftime(l.transaction_date, '%Y-%m-%d') AS last_transaction_date,
       CAST(h.num_plan_changes AS BIGINT) AS num_plan_changes, h.num_payment_methods, CAST(h.num_cancellations AS BIGINT) AS num_cancellations,
       strftime(h.max_expire_date, '%Y-%m-%d') AS max_expire_date
FROM tx_hist h JOIN tx_last l USING (msno)""")

_SKETCHED = ("msno", "payment_method_id", "payment_plan_days", "plan_list_price", "seq")
ORACLES["sketch_distinct_counts"] = with_prefix("", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS n, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_distinct, "
    f"TRUE AS within_bound FROM raw_transactions" for c in _SKETCHED))
ORACLES["sketch_quantiles"] = with_prefix("", """
SELECT c AS "column", p AS prob, TRUE AS within_bound
FROM (SELECT unnest(['payment_method_id', 'payment_plan_days', 'plan_list_price', 'seq']) AS c),
     (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95]::DOUBLE[]) AS p)""")

ORACLES["id_set_overlaps"] = with_prefix(""",
ids AS (SELECT msno, 1 AS t, 'members' AS name FROM members UNION SELECT msno, 2, 'transactions' FROM raw_transactions
        UNION SELECT msno, 3, 'user_logs' FROM user_logs UNION SELECT msno, 4, 'train' FROM train)""", """
SELECT tables, count(*) AS n FROM (SELECT string_agg(name, '+' ORDER BY t) AS tables FROM ids WHERE msno IS NOT NULL GROUP BY msno)
GROUP BY tables""")

ORACLES["batch_lookup_bucketed"] = ORACLES["batch_lookup"]

ORACLES["search_ids_indexed"] = with_prefix(""",
asked AS (SELECT substr(msno, 2, 4) AS query FROM members UNION SELECT msno FROM members)""", """
SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY msno) AS INTEGER) AS rank, msno
FROM asked JOIN members ON contains(lower(msno), lower(query))
QUALIFY row_number() OVER (PARTITION BY query ORDER BY msno) <= 10""")

# The fit at a score is the greatest, over blocks that start at or before it, of the least mean of blocks that end at or after it.
ORACLES["isotonic_calibration"] = with_prefix(scored_cte() + """,
g AS (SELECT churn_probability AS score, count(*) AS n, CAST(sum(is_churn) AS BIGINT) AS pos FROM scored_ev GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY score) AS i, sum(n) OVER (ORDER BY score) AS cn, sum(pos) OVER (ORDER BY score) AS cp FROM g),
means AS (SELECT a.i AS a, b.i AS b, CAST(b.cp - a.cp + a.pos AS DOUBLE) / CAST(b.cn - a.cn + a.n AS DOUBLE) AS mean
          FROM o a JOIN o b ON b.i >= a.i),
least_ AS (SELECT a, b, min(mean) OVER (PARTITION BY a ORDER BY b DESC) AS m FROM means),
fit AS (SELECT b AS i, max(m) AS rate FROM least_ GROUP BY b)""", """
SELECT round(score, 6) AS score, n, pos, round(rate, 6) AS calibrated FROM o JOIN fit USING (i)""")


def _date_text(c: str, broken: str) -> str:
    return f"CASE WHEN {broken} THEN strftime({c}, '%Y%m') || '3x' ELSE strftime({c}, '%Y%m%d') END"


def _parsed(c: str, broken: str) -> str:
    return f"CAST(try_strptime({_date_text(c, broken)}, '%Y%m%d') AS DATE)"


ORACLES["members_parsed"] = with_prefix("", f"""
SELECT * REPLACE (strftime({_parsed("registration_init_time", "CAST(msno AS BIGINT) % 7 = 0")}, '%Y-%m-%d') AS registration_init_time) FROM members""")
ORACLES["transactions_parsed"] = with_prefix(f""",
parsed AS (SELECT * REPLACE ({_parsed("transaction_date", "seq % 11 = 0")} AS transaction_date,
                             {_parsed("membership_expire_date", "seq % 13 = 0")} AS membership_expire_date) FROM raw_transactions),
kept AS (SELECT * FROM parsed WHERE transaction_date <= DATE '2001-07-28'
         QUALIFY row_number() OVER (PARTITION BY msno, transaction_date
                 ORDER BY is_cancel DESC NULLS FIRST, plan_list_price DESC NULLS FIRST, seq DESC) = 1)""", f"SELECT {_TX_COLS} FROM kept")
ORACLES["user_logs_parsed"] = with_prefix("", f"""
SELECT msno, num_25, num_100, num_unq, round(total_secs, 6) AS total_secs,
       strftime({_parsed("log_date", "CAST(msno AS BIGINT) % 17 = 0")}, '%Y-%m-%d') AS log_date FROM user_logs""")

# What must hold for every row of a fitted model's output.
ORACLES["linear_score_checks"] = with_prefix(_SPLIT_CTE, """
SELECT msno, TRUE AS in_range, TRUE AS is_sigmoid FROM split WHERE split = 'test'""")
ORACLES["model_action_checks"] = with_prefix(_SPLIT_CTE, """
SELECT msno, TRUE AS in_range, TRUE AS adds_up, 3 AS n_drivers, TRUE AS follows_rule FROM split""")
ORACLES["calibration_checks"] = "SELECT CAST(unnest([0, 1, 2]) AS INTEGER) AS fold, TRUE AS never_falls, TRUE AS in_range"
ORACLES["tree_search_trials"] = "SELECT CAST(unnest([0, 1]) AS INTEGER) AS trial, TRUE AS in_range, TRUE AS best_is_top"
