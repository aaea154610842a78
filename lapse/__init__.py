"""lapse: subscription-retention analytics as Spark DataFrame operators.

Layout
------
``sources``    explicit schemas, readers (cutoff + same-day dedup), sinks, test views
``functions``  scalar Column helpers (dates, cleaning, labels)
``operators``  features, labels, value, ranking, cohorts, serving, profiles,
               evaluation, running totals, ML, attribution
``plans``      registered queries and their DuckDB oracles
``llm``        text operators of a training-data pipeline (optional)
"""
