"""Named queries over the test tables, each with equivalent SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finwake.operators import alerts as A
from finwake.operators import archive_metrics as M
from finwake.operators import model
from finwake.operators.events import two_sided, two_sided_union
from finwake.operators.features import FEATURES, HISTORY, TX_FEATURES, feature_table, feature_table_onepass, matrix, stateless
from finwake.operators.history import BASE, history, history_by_time, history_sliced, in_small_parts
from finwake.operators.rings import reconcile, ring_split
from finwake.sources.adapters import load_events_tx, load_lineitem_tx
from finwake.functions.quantiles import exact_quantile
from finwake.sources.batches import write_batches
from finwake.sources.demo import TAIL, make_transactions
from finwake.sources.shared import new_path, written
from finwake.sources.sinks import read_features, write_features
from finwake.sources.transactions import COLUMNS, quality_report

CUT = "2024-01-21"
KEY = ["txn_id", "side"]

# ------------------------------------------------------------------ SQL pieces
TX_EVENTS = """tx AS (
  SELECT event_id + 1 AS txn_id,
    CAST(date_trunc('minute', ts) AS TIMESTAMP) AS event_time,
    CAST(ts AS DATE) AS event_date,
    'A' || lpad(CAST(user_id AS VARCHAR), 4, '0') AS sender_id,
    'A' || lpad(CAST(user_id + event_id % 11 AS VARCHAR), 4, '0') AS receiver_id,
    CASE WHEN user_id % 10 = 0 THEN '010' ELSE '011' END AS sender_bank,
    CASE WHEN (user_id + event_id % 11) % 10 = 0 THEN '010' ELSE '012' END AS receiver_bank,
    CASE WHEN event_id % 10 = 0 THEN round(value, 0) * 100 ELSE value END AS amount_paid,
    CASE WHEN event_id % 5 = 0 THEN value * CAST(0.92 AS DOUBLE) ELSE value END AS amount_received,
    CASE WHEN event_id % 10 = 3 THEN 'EUR' ELSE 'USD' END AS payment_currency,
    CASE WHEN event_id % 7 = 3 THEN 'EUR' ELSE 'USD' END AS receiving_currency,
    upper(event_type) AS payment_format,
    CAST(value > 110 AND event_id % 11 <> 0 AS TINYINT) AS is_laundering
  FROM events)"""
SIDES = """tx_sides AS (
  SELECT txn_id, 's' AS side, sender_id AS account_id, receiver_id AS counterparty, event_time, amount_paid, 1 AS is_out FROM tx
  UNION ALL
  SELECT txn_id, 'r', receiver_id, sender_id, event_time, amount_paid, 0 FROM tx)"""
HIST = """pairs AS (
  SELECT *, CAST(round(amount_paid * 100) AS BIGINT) AS c,
    max(event_time) OVER (PARTITION BY account_id, counterparty ORDER BY event_time
      RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MINUTE PRECEDING) AS prev_cp
  FROM tx_sides),
framed AS (
  SELECT txn_id, side, event_time, prev_cp,
    count(*) OVER w1 AS n_1d, count(*) OVER w7 AS n_7d, count(*) OVER w30 AS n_30d,
    count(c) OVER w7 AS n_amt, CAST(sum(c) OVER w7 AS BIGINT) AS sum_c, sum(CAST(c AS HUGEINT) * c) OVER w7 AS sum_c2,
    max(amount_paid) OVER w30 AS max_amt_30d, CAST(coalesce(sum(is_out) OVER w7, 0) AS BIGINT) AS n_out_7d,
    max(event_time) OVER w30 AS prev_any
  FROM pairs
  WINDOW w1 AS (PARTITION BY account_id ORDER BY event_time RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND INTERVAL 1 MINUTE PRECEDING),
    w7 AS (PARTITION BY account_id ORDER BY event_time RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 MINUTE PRECEDING),
    w30 AS (PARTITION BY account_id ORDER BY event_time RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 MINUTE PRECEDING)),
hist AS (
  SELECT txn_id, side, n_1d, n_7d, n_30d,
    CAST(sum_c AS DOUBLE) / CAST(100 AS DOUBLE) / nullif(n_amt, 0) AS mean_amt_7d,
    sqrt(CAST(n_amt * sum_c2 - CAST(sum_c AS HUGEINT) * sum_c AS DOUBLE)) / CAST(100 AS DOUBLE) / nullif(n_amt, 0) AS std_amt_7d,
    max_amt_30d, n_out_7d,
    epoch(event_time - prev_any) AS secs_since_prev, epoch(event_time - prev_cp) AS secs_since_prev_cp
  FROM framed)"""
CODE = "CAST('0x' || substr(md5(coalesce({c}, '')), 1, 8) AS BIGINT) % 1000"
FLAT = f"""flat AS (
  SELECT txn_id, event_time, event_date, sender_id, receiver_id, is_laundering, amount_paid,
    round(ln(1 + amount_paid), 9) AS log_amount_paid, round(ln(1 + amount_received), 9) AS log_amount_received,
    amount_received / nullif(amount_paid, 0) AS fx_ratio,
    CAST(payment_currency <> receiving_currency AS TINYINT) AS currency_mismatch,
    CAST(CASE WHEN amount_paid = round(amount_paid, -3) THEN 3 WHEN amount_paid = round(amount_paid, -2) THEN 2
      WHEN amount_paid = round(amount_paid, 0) THEN 1 ELSE 0 END AS INTEGER) AS amount_roundness,
    CAST(hour(event_time) AS INTEGER) AS hour, CAST(dayofweek(event_time) AS INTEGER) AS dayofweek,
    CAST(dayofweek(event_time) IN (0, 6) AS TINYINT) AS is_weekend,
    CAST(sender_id = receiver_id AS TINYINT) AS is_self_transfer,
    CAST(sender_bank <> receiver_bank AS TINYINT) AS is_cross_bank,
    {CODE.format(c="payment_format")} AS payment_format_code, {CODE.format(c="payment_currency")} AS payment_currency_code
  FROM tx)"""
_SIDE_SQL = ", ".join(
    f"h{s}.{n} AS {s}_{n}" if n != "amt_vs_hist" else f"flat.amount_paid / nullif(h{s}.mean_amt_7d, 0) AS {s}_amt_vs_hist"
    for s in "sr"
    for n in HISTORY
)
_IDS = "txn_id, event_time, event_date, sender_id, receiver_id, is_laundering"
TABLE = f"""ft AS (
  SELECT {", ".join("flat." + c for c in _IDS.split(", "))}, {", ".join("flat." + c for c in TX_FEATURES)}, {_SIDE_SQL}
  FROM flat LEFT JOIN hist hs ON hs.txn_id = flat.txn_id AND hs.side = 's'
  LEFT JOIN hist hr ON hr.txn_id = flat.txn_id AND hr.side = 'r')"""
# a rule score of cents and ids: exact in both engines
RULE = """scored AS (
  SELECT txn_id, event_date, sender_id, receiver_id, is_laundering,
    CAST(CAST(round(amount_paid * 100) AS BIGINT) % 5000 AS DOUBLE) AS score
  FROM tx)"""
DAYS = """account_days AS (
  SELECT day, account, max(score) AS score, max(label) AS label FROM (
    SELECT event_date AS day, sender_id AS account, score, is_laundering AS label FROM scored
    UNION ALL SELECT event_date, receiver_id, score, is_laundering FROM scored) GROUP BY day, account),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY day ORDER BY score DESC NULLS LAST, account) AS INTEGER) AS rank FROM account_days)"""
COUNTS = """counts AS (
  SELECT day, count(*) AS n_d, CAST(sum(label) AS BIGINT) AS n_positive FROM account_days GROUP BY day),
per AS (SELECT counts.*, b.budget FROM counts, (VALUES (5), (20), (50), (100), (500)) b(budget))"""
SMALL = (5, 20, 50, 100, 500)


RINGS = """ring AS MATERIALIZED (
  SELECT txn_id, event_time, sender_id, receiver_id, CAST(substr(sender_id, 2) AS BIGINT) AS ring_id FROM tx
  WHERE is_laundering = 1 AND CAST(substr(sender_id, 2) AS BIGINT) % 10 = 0 AND txn_id % 3 = 0),
held AS MATERIALIZED (SELECT DISTINCT ring_id, unnest([sender_id, receiver_id]) AS account FROM ring),
touch AS MATERIALIZED (SELECT DISTINCT a.ring_id AS a, b.ring_id AS b FROM held a JOIN held b ON a.account = b.account),
reach AS (SELECT a AS ring_id, a AS other FROM touch UNION SELECT r.ring_id, t.b FROM reach r JOIN touch t ON t.a = r.other),
fate AS MATERIALIZED (SELECT r.ring_id, min(event_time) AS starts FROM reach r JOIN ring ON ring.ring_id = r.other GROUP BY r.ring_id)"""


def _with(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select


def rule_score(tx: DataFrame) -> DataFrame:
    cents = F.expr("cast(round(amount_paid * 100) as bigint)")
    return tx.select(
        "txn_id", "event_date", "sender_id", "receiver_id", "is_laundering", (cents % 5000).cast("double").alias("score")
    )


def _days(tx: DataFrame) -> DataFrame:
    return A.account_days(rule_score(tx))


def _rounded(df: DataFrame) -> DataFrame:
    """Logarithms to nine decimals: engines differ in the last bit."""
    return df.withColumns({c: F.round(c, 9) for c in ("log_amount_paid", "log_amount_received") if c in df.columns})


def _hist(tx: DataFrame, **how) -> DataFrame:
    return history(two_sided(in_small_parts(tx)), **how).select(*KEY, *BASE)


def _roundtrip(spark: SparkSession, tx: DataFrame) -> DataFrame:
    return _rounded(read_features(spark, write_features(feature_table_onepass(tx), new_path(spark, "features"))))


def _quantile(spark: SparkSession, tx: DataFrame) -> DataFrame:
    value = exact_quantile(tx, "amount_paid", TAIL)
    return spark.createDataFrame([(None if value is None else round(value, 6),)], "amount_cut double")


def _batches(spark: SparkSession, tx: DataFrame) -> DataFrame:
    """What the tasks report of the ordered export of the model matrix, in batches of 1,000 rows."""
    return write_batches(matrix(feature_table_onepass(tx)), new_path(spark, "matrix"), rows=1000)


def _invariants(tx: DataFrame) -> DataFrame:
    h = _hist(tx)
    c = F.col
    return h.agg(
        F.count("*").alias("rows"),
        F.count_if((c("n_1d") > c("n_7d")) | (c("n_7d") > c("n_30d"))).alias("bad_nesting"),
        F.count_if((c("n_out_7d") < 0) | (c("n_out_7d") > c("n_7d"))).alias("bad_out"),
        F.count_if(~c("secs_since_prev").between(60, 2_592_000)).alias("bad_recency"),
        F.count_if(c("secs_since_prev").isNull() != (c("n_30d") == 0)).alias("bad_null_recency"),
        F.count_if(c("mean_amt_7d").isNull() != (c("n_7d") == 0)).alias("bad_null_mean"),
        F.count_if(c("secs_since_prev_cp") < c("secs_since_prev")).alias("bad_pair_recency"),
    )


def _scores(tx: DataFrame, kind: str) -> DataFrame:
    """Features are built and written once; fitting and scoring read them many times."""
    train, test = model.split(written(feature_table_onepass(tx), "scores"), CUT)
    return model.score(model.fit(train, kind, trees=20, depth=5), test)


def planted_rings(tx: DataFrame) -> DataFrame:
    """Ring membership for the test tables: a third of the labelled transfers of every tenth sender, by sender."""
    number = F.substring("sender_id", 2, 9).cast("bigint")
    inside = (F.col("is_laundering") == 1) & (number % 10 == 0) & (F.col("txn_id") % 3 == 0)
    return tx.filter(inside).select("txn_id", number.alias("ring_id"))


def _ring_split(tx: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    return ring_split(tx, planted_rings(tx), CUT)


def _class_weights(tx: DataFrame) -> DataFrame:
    return model.class_weights(model.split(tx, CUT)[0])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    on = lambda f: lambda spark, sf_dir: f(load_events_tx(spark, sf_dir))
    out = {
        "scan_tx": on(lambda tx: tx.select(*COLUMNS)),
        "tx_count": on(lambda tx: tx.agg(F.count("*").alias("n"))),
        "tx_quality": on(quality_report),
        "events_union": on(two_sided_union),
        "events_inline": on(two_sided),
        "history_full": on(_hist),
        "history_linear": on(lambda tx: _hist(tx, linear=True)),
        "history_sliced": on(lambda tx: history_sliced(two_sided(in_small_parts(tx))).select(*KEY, *BASE)),
        "history_blocks": on(lambda tx: history_sliced(two_sided(in_small_parts(tx)), linear=True).select(*KEY, *BASE)),
        "feature_table": on(lambda tx: _rounded(feature_table(tx))),
        "feature_table_onepass": on(lambda tx: _rounded(feature_table_onepass(tx))),
        "feature_table_sliced": on(lambda tx: _rounded(feature_table_onepass(tx, linear=True, sliced=True))),
        "features_roundtrip": lambda spark, sf_dir: _roundtrip(spark, load_events_tx(spark, sf_dir)),
        "split_train": on(lambda tx: model.split(tx, CUT)[0].select("txn_id", "event_time", "is_laundering")),
        "split_test": on(lambda tx: model.split(tx, CUT)[1].select("txn_id", "event_time", "is_laundering")),
        "matrix_f32": on(lambda tx: matrix(_rounded(feature_table_onepass(tx)))),
        "matrix_batches": lambda spark, sf_dir: _batches(spark, load_events_tx(spark, sf_dir)),
        "amount_quantile": lambda spark, sf_dir: _quantile(spark, load_events_tx(spark, sf_dir)),
        "ring_split_test": on(lambda tx: _ring_split(tx)[1].select("txn_id", "event_time", "is_laundering")),
        "ring_split_report": on(lambda tx: _ring_split(tx)[2]),
        "ring_reconcile": on(lambda tx: reconcile(tx, planted_rings(tx))),
        "class_weights": on(_class_weights),
        "account_days": on(_days),
        "daily_rank": on(lambda tx: A.daily_rank(_days(tx))),
        "budget_metrics": on(lambda tx: A.budget_metrics(rule_score(tx), SMALL)),
        "recall_ceiling": on(lambda tx: M.recall_ceiling(M.day_counts(_days(tx)), SMALL)),
        "alert_slots": on(lambda tx: M.alert_slots(M.day_counts(_days(tx)), SMALL)),
        "nonbinding_days": on(lambda tx: M.nonbinding_days(M.day_counts(_days(tx)), SMALL)),
        "random_null_precision": on(lambda tx: M.random_null_precision(M.day_counts(_days(tx)), SMALL)),
        "segment_metrics": on(lambda tx: M.segment_metrics(A.daily_rank(_days(tx)), CUT, SMALL)),
        "volume_profile": on(M.volume_profile),
        "first_thin_day": on(lambda tx: M.first_thin_day(tx, 0.9)),
        "ranking_quality": on(lambda tx: M.ranking_quality(rule_score(tx))),
        "feature_null_counts": on(
            lambda tx: feature_table_onepass(tx).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in FEATURES])
        ),
        "feature_invariants": on(_invariants),
        "ties_daily": _ties,
        "boosted_scores": on(lambda tx: _scores(tx, "histogram")),
        "gbt_scores": on(lambda tx: _scores(tx, "gbt")),
        "logistic_scores": on(lambda tx: _scores(tx, "logistic")),
        "demo_transactions": lambda spark, sf_dir: make_transactions(spark),
    }
    for name in BASE:
        out[f"hist_{name}"] = on(lambda tx, n=name: _hist(tx).select(*KEY, n))
    for name, columns in TX_GROUPS.items():
        out[name] = on(lambda tx, cs=columns: _rounded(stateless(tx)).select("txn_id", *cs))
    for k in A.BUDGETS:
        out[f"alerts_top{k}"] = on(lambda tx, k=k: A.alerts(rule_score(tx), k))
    return out


TX_GROUPS = {
    "tx_log_amounts": ["log_amount_paid", "log_amount_received"],
    "tx_fx_ratio": ["fx_ratio"],
    "tx_roundness": ["amount_roundness"],
    "tx_calendar": ["hour", "dayofweek", "is_weekend"],
    "tx_flags": ["currency_mismatch", "is_self_transfer", "is_cross_bank"],
    "tx_codes": ["payment_format_code", "payment_currency_code"],
}


def _ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History of day-granular transfers by account and time; order lines share no unique id.

    One pass: the lines are counted from the file, and only account, time and amount leave the joins.
    """
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    return history_by_time(two_sided(load_lineitem_tx(spark, sf_dir)), 2 * lines)


def oracle_sql() -> dict[str, str]:
    h = lambda select: _with(TX_EVENTS, SIDES, HIST, select=select)
    t = lambda select: _with(TX_EVENTS, SIDES, HIST, FLAT, TABLE, select=select)
    a = lambda select: _with(TX_EVENTS, RULE, DAYS, select=select)
    n = lambda select: _with(TX_EVENTS, RULE, DAYS, COUNTS, select=select)
    s = lambda select: _with(TX_EVENTS, RULE, select=select)
    x = lambda select: _with(TX_EVENTS, select=select)
    g = lambda select: "WITH RECURSIVE " + ",\n".join([TX_EVENTS, RINGS]) + "\n" + select
    full = f"SELECT txn_id, side, {', '.join(BASE)} FROM hist"
    table = f"SELECT {_IDS}, {', '.join(FEATURES)} FROM ft"
    nulls = ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS null_{c}" for c in COLUMNS)
    metrics = ", ".join(
        f"CAST(coalesce(sum(label) FILTER (WHERE rank <= {k}), 0) AS DOUBLE) / nullif(count(*) FILTER (WHERE rank <= {k}), 0) AS \"precision@{k}\", "
        f"CAST(coalesce(sum(label) FILTER (WHERE rank <= {k}), 0) AS DOUBLE) / nullif(sum(label), 0) AS \"recall@{k}\""
        for k in SMALL
    )
    out = {
        "scan_tx": x(f"SELECT {', '.join(COLUMNS)} FROM tx"),
        "tx_count": x("SELECT count(*) AS n FROM tx"),
        "tx_quality": x(
            f"SELECT count(*) AS rows, {nulls}, count(*) FILTER (WHERE event_date <> CAST(event_time AS DATE)) AS date_mismatch FROM tx"
        ),
        "events_union": _with(TX_EVENTS, SIDES, select="SELECT * FROM tx_sides"),
        "events_inline": _with(TX_EVENTS, SIDES, select="SELECT * FROM tx_sides"),
        "history_full": h(full),
        "history_linear": h(full),
        "history_sliced": h(full),
        "history_blocks": h(full),
        "feature_table": t(table),
        "feature_table_onepass": t(table),
        "feature_table_sliced": t(table),
        "features_roundtrip": t(table),
        "split_train": x(f"SELECT txn_id, event_time, is_laundering FROM tx WHERE event_time < TIMESTAMP '{CUT}'"),
        "split_test": x(f"SELECT txn_id, event_time, is_laundering FROM tx WHERE event_time >= TIMESTAMP '{CUT}'"),
        "matrix_f32": t(f"SELECT txn_id, {', '.join(f'CAST({c} AS FLOAT) AS {c}' for c in FEATURES)}, is_laundering FROM ft"),
        "matrix_batches": x(
            "SELECT CAST(r // 1000 AS BIGINT) AS batch, count(*) AS rows, min(txn_id) AS first, max(txn_id) AS last"
            " FROM (SELECT txn_id, row_number() OVER (ORDER BY txn_id) - 1 AS r FROM tx) GROUP BY batch"
        ),
        "amount_quantile": x("SELECT round(quantile_cont(amount_paid, CAST(0.96 AS DOUBLE)), 6) AS amount_cut FROM tx"),
        "ring_split_test": g(
            f"SELECT txn_id, event_time, is_laundering FROM tx WHERE event_time >= TIMESTAMP '{CUT}'"
            f" AND txn_id NOT IN (SELECT txn_id FROM ring JOIN fate USING (ring_id) WHERE starts < TIMESTAMP '{CUT}')"
        ),
        "ring_split_report": g(
            "SELECT count(*) AS test_rings_before_drop, count(*) FILTER (WHERE old) AS dropped_rings, count(*) FILTER (WHERE NOT old) AS test_rings_kept,"
            " round(100 * count(*) FILTER (WHERE old) / CAST(nullif(count(*), 0) AS DOUBLE), 2) AS dropped_pct FROM ("
            f"SELECT DISTINCT ring_id, starts < TIMESTAMP '{CUT}' AS old FROM ring JOIN fate USING (ring_id) WHERE event_time >= TIMESTAMP '{CUT}')"
        ),
        "ring_reconcile": g(
            "SELECT count(*) FILTER (WHERE l) AS labelled, count(*) FILTER (WHERE i) AS in_rings, count(*) FILTER (WHERE l AND i) AS labelled_in_rings,"
            " count(*) FILTER (WHERE l AND NOT i) AS labelled_only, count(*) FILTER (WHERE NOT l AND i) AS rings_only,"
            " round(100 * count(*) FILTER (WHERE l AND i) / CAST(nullif(count(*) FILTER (WHERE l), 0) AS DOUBLE), 2) AS covered_pct"
            " FROM (SELECT coalesce(is_laundering, 0) = 1 AS l, txn_id IN (SELECT txn_id FROM ring) AS i FROM tx)"
        ),
        "class_weights": x(
            "SELECT is_laundering, count(*) AS n_c, sum(count(*)) OVER () / (CAST(2 AS DOUBLE) * count(*)) AS weight"
            f" FROM tx WHERE event_time < TIMESTAMP '{CUT}' GROUP BY is_laundering"
        ),
        "account_days": a("SELECT * FROM account_days"),
        "daily_rank": a("SELECT * FROM ranked"),
        "budget_metrics": a(
            f"SELECT count(*) AS account_days, CAST(sum(label) AS BIGINT) AS positive_account_days, {metrics} FROM ranked"
        ),
        "recall_ceiling": n(
            "SELECT budget, CAST(sum(least(budget, n_positive)) AS BIGINT) AS ceiling_count,"
            " CAST(coalesce(sum(least(budget, n_positive)) FILTER (WHERE n_positive > budget), 0) AS BIGINT) AS budget_limited,"
            " CAST(coalesce(sum(least(budget, n_positive)) FILTER (WHERE n_positive <= budget), 0) AS BIGINT) AS positive_limited,"
            " CAST(sum(least(budget, n_positive)) AS DOUBLE) / nullif(sum(n_positive), 0) AS recall_ceiling FROM per GROUP BY budget"
        ),
        "alert_slots": n("SELECT budget, CAST(sum(least(budget, n_d)) AS BIGINT) AS slots FROM per GROUP BY budget"),
        "nonbinding_days": n("SELECT budget, count(*) FILTER (WHERE n_d <= budget) AS days FROM per GROUP BY budget"),
        "random_null_precision": n(
            "SELECT budget, round(sum(least(budget, n_d) * n_positive / CAST(n_d AS DOUBLE)) / sum(least(budget, n_d)), 6) AS precision"
            " FROM per GROUP BY budget"
        ),
        "segment_metrics": a(
            f"SELECT CASE WHEN day < DATE '{CUT}' THEN 'head' ELSE 'tail' END AS segment, budget,"
            " CAST(sum(label) FILTER (WHERE rank <= budget) AS DOUBLE) / nullif(count(*) FILTER (WHERE rank <= budget), 0) AS precision,"
            " CAST(coalesce(sum(label) FILTER (WHERE rank <= budget), 0) AS DOUBLE) / nullif(sum(label), 0) AS recall"
            " FROM ranked, (VALUES (5), (20), (50), (100), (500)) b(budget) GROUP BY ALL"
        ),
        "volume_profile": x(
            "SELECT event_date AS day, count(*) AS transactions, CAST(sum(is_laundering) AS BIGINT) AS laundering,"
            " round(CAST(sum(is_laundering) AS DOUBLE) / count(*), 6) AS prevalence FROM tx GROUP BY event_date"
        ),
        "first_thin_day": x(
            "SELECT max(m) AS median_n, min(day) FILTER (WHERE n < CAST(0.9 AS DOUBLE) * m) AS day FROM ("
            "SELECT day, n, (SELECT CAST(quantile_cont(n, 0.5) AS DOUBLE) FROM (SELECT count(*) AS n FROM tx GROUP BY event_date)) AS m"
            " FROM (SELECT event_date AS day, count(*) AS n FROM tx GROUP BY event_date))"
        ),
        "ranking_quality": s(
            "SELECT round(CAST(sum(neg * (2 * tp - pos)) AS DOUBLE) / 2 / sum(pos) / sum(neg), 9) AS roc_auc,"
            " round(sum(CAST(tp AS DOUBLE) / (tp + fp) * pos) / sum(pos), 9) AS average_precision FROM ("
            "SELECT pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM ("
            "SELECT score, sum(is_laundering) AS pos, sum(1 - is_laundering) AS neg FROM scored GROUP BY score)"
            " WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"
        ),
        "feature_null_counts": t(
            "SELECT " + ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS {c}" for c in FEATURES) + " FROM ft"
        ),
        "feature_invariants": h(
            "SELECT count(*) AS rows, count(*) FILTER (WHERE n_1d > n_7d OR n_7d > n_30d) AS bad_nesting,"
            " count(*) FILTER (WHERE n_out_7d < 0 OR n_out_7d > n_7d) AS bad_out,"
            " count(*) FILTER (WHERE NOT secs_since_prev BETWEEN 60 AND 2592000) AS bad_recency,"
            " count(*) FILTER (WHERE (secs_since_prev IS NULL) <> (n_30d = 0)) AS bad_null_recency,"
            " count(*) FILTER (WHERE (mean_amt_7d IS NULL) <> (n_7d = 0)) AS bad_null_mean,"
            " count(*) FILTER (WHERE secs_since_prev_cp < secs_since_prev) AS bad_pair_recency FROM hist"
        ),
        "ties_daily": TIES_SQL,
    }
    for name in BASE:
        out[f"hist_{name}"] = h(f"SELECT txn_id, side, {name} FROM hist")
    for name, columns in TX_GROUPS.items():
        out[name] = _with(TX_EVENTS, FLAT, select=f"SELECT txn_id, {', '.join(columns)} FROM flat")
    for k in A.BUDGETS:
        out[f"alerts_top{k}"] = a(f"SELECT * FROM ranked WHERE rank <= {k}")
    return out


TIES_SQL = """WITH tx AS (
  SELECT row_number() OVER () AS txn_id, l_shipdate AS event_time, 'C' || CAST(o_custkey AS VARCHAR) AS sender_id,
    'S' || CAST(l_suppkey AS VARCHAR) AS receiver_id, l_extendedprice AS amount_paid
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey),
sides AS (
  SELECT sender_id AS account_id, event_time, amount_paid FROM tx UNION ALL SELECT receiver_id, event_time, amount_paid FROM tx),
framed AS (
  SELECT account_id, event_time, count(*) OVER w1 AS n_1d, count(*) OVER w7 AS n_7d, count(*) OVER w30 AS n_30d,
    max(amount_paid) OVER w30 AS max_amt_30d,
    CAST(sum(CAST(round(amount_paid * 100) AS BIGINT)) OVER w7 AS DOUBLE) / CAST(100 AS DOUBLE) / nullif(count(*) OVER w7, 0) AS mean_amt_7d,
    epoch(event_time - max(event_time) OVER w30) AS secs_since_prev
  FROM sides
  WINDOW w1 AS (PARTITION BY account_id ORDER BY event_time RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND INTERVAL 1 MINUTE PRECEDING),
    w7 AS (PARTITION BY account_id ORDER BY event_time RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 MINUTE PRECEDING),
    w30 AS (PARTITION BY account_id ORDER BY event_time RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 MINUTE PRECEDING))
SELECT account_id, event_time, count(*) AS rows, max(n_1d) AS n_1d, max(n_7d) AS n_7d, max(n_30d) AS n_30d,
  max(max_amt_30d) AS max_amt_30d, max(mean_amt_7d) AS mean_amt_7d, max(secs_since_prev) AS secs_since_prev
FROM framed GROUP BY account_id, event_time"""
