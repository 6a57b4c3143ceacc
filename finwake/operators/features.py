"""The 38-column feature table: 6 ids, 12 stateless and 2 x 10 history columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finwake.functions import scalars as S
from finwake.operators.events import two_sided
from finwake.operators.history import BASE, history, history_sliced, in_small_parts, tasks_for

PASSTHROUGH = ["txn_id", "event_time", "event_date", "sender_id", "receiver_id", "is_laundering"]
# The order below is the model's input contract.
TX_FEATURES = [
    "log_amount_paid",
    "log_amount_received",
    "fx_ratio",
    "currency_mismatch",
    "amount_roundness",
    "hour",
    "dayofweek",
    "is_weekend",
    "is_self_transfer",
    "is_cross_bank",
    "payment_format_code",
    "payment_currency_code",
]
HISTORY = [*BASE, "amt_vs_hist"]
FEATURES = TX_FEATURES + [f"{side}_{name}" for side in "sr" for name in HISTORY]


def stateless(tx: DataFrame, *extra: str) -> DataFrame:
    """The six id columns and the twelve features of the transfer itself, then ``extra``."""
    c = F.col
    features = {
        "log_amount_paid": S.log_amount(c("amount_paid")),
        "log_amount_received": S.log_amount(c("amount_received")),
        "fx_ratio": S.safe_ratio(c("amount_received"), c("amount_paid")),
        "currency_mismatch": S.differs(c("payment_currency"), c("receiving_currency")),
        "amount_roundness": S.roundness(c("amount_paid")),
        "hour": F.hour("event_time"),
        "dayofweek": S.weekday(c("event_time")),
        "is_weekend": S.weekday(c("event_time")).isin(0, 6).cast("tinyint"),
        "is_self_transfer": (c("sender_id") == c("receiver_id")).cast("tinyint"),
        "is_cross_bank": S.differs(c("sender_bank"), c("receiver_bank")),
        "payment_format_code": S.category_code(c("payment_format")),
        "payment_currency_code": S.category_code(c("payment_currency")),
    }
    return tx.select(*PASSTHROUGH, *[features[name].alias(name) for name in TX_FEATURES], *extra)


def _sides(amount: F.Column, s, r) -> list[F.Column]:
    out = []
    for side, h in (("s", s), ("r", r)):
        out += [h(name).alias(f"{side}_{name}") for name in BASE]
        out.append(S.safe_ratio(amount, h("mean_amt_7d")).alias(f"{side}_amt_vs_hist"))
    return out


def feature_table(tx: DataFrame, exact: bool = True, linear: bool = True, sliced: bool = True) -> DataFrame:
    """Two left joins of the transfer with its sender and receiver history.

    Right for any txn_id: repeated ids fan out as an outer join does.
    """
    hist = (history_sliced if sliced else history)(two_sided(in_small_parts(tx)), exact, linear).select("txn_id", "side", *BASE)
    hs = hist.filter("side = 's'").select("txn_id", F.struct(*BASE).alias("hs"))
    hr = hist.filter("side = 'r'").select("txn_id", F.struct(*BASE).alias("hr"))
    n = tasks_for(2 * tx.count())
    hs, hr, own = (side.repartition(n, "txn_id") for side in (hs, hr, stateless(tx, "amount_paid")))
    joined = own.join(hs, "txn_id", "left").join(hr, "txn_id", "left")
    sides = _sides(F.col("amount_paid"), lambda n: F.col(f"hs.{n}"), lambda n: F.col(f"hr.{n}"))
    return joined.select(*PASSTHROUGH, *TX_FEATURES, *sides)


def feature_table_onepass(tx: DataFrame, exact: bool = True, linear: bool = True, sliced: bool = True) -> DataFrame:
    """The same table for unique txn_id with the history computed once.

    Stateless columns ride through the window pass, then the two perspectives
    meet again in one grouping on txn_id: two exchanges in all, no self join. With ``sliced``
    an account's past is cut into 30-day slices, so that no account is one task.
    """
    wide = stateless(in_small_parts(tx), "amount_paid").withColumn("_tx", F.struct(*PASSTHROUGH, *TX_FEATURES))
    hist = (history_sliced if sliced else history)(two_sided(wide, "_tx"), exact, linear)
    pick = lambda s, cols: F.max(F.when(F.col("side") == s, F.struct(*cols)))
    paired = hist.repartition(tasks_for(2 * tx.count()), "txn_id").groupBy("txn_id").agg(pick("s", ["_tx", "amount_paid", *BASE]).alias("hs"), pick("r", BASE).alias("hr"))
    sides = _sides(F.col("hs.amount_paid"), lambda n: F.col(f"hs.{n}"), lambda n: F.col(f"hr.{n}"))
    return paired.select(*[F.col(f"hs._tx.{c}").alias(c) for c in [*PASSTHROUGH, *TX_FEATURES]], *sides)


def matrix(features: DataFrame, with_label: bool = True) -> DataFrame:
    """The 32 model inputs as 32-bit floats in contract order, with txn_id."""
    label = [F.col("is_laundering")] if with_label else []
    return features.select("txn_id", *[F.col(c).cast("float").alias(c) for c in FEATURES], *label)
