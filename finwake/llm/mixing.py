"""Mixing sources to target weights by Poisson replication.

Each source has a mean repetition rate: its target share of the byte budget over the
bytes it has. A document's count is the inverse of that Poisson distribution at a
number in [0, 1) hashed from (doc_id, seed); the document is exploded into so many
copies, and all copies are shuffled globally by a hash of (doc_id, copy, seed).

Everything is DataFrame code. Only per-source totals (partial sums, then one row per
source) meet in one place; the rates go back by a join that is broadcast when the
number of sources has been counted and is small.

Edge cases: null source is a source of its own; null or empty texts weigh one byte;
rows with equal ids get equal counts; rates beyond ``PIECE`` are drawn as sums of
independent parts; a source with target weight 0 goes; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finwake.llm.store import free_names

PIECE = 100.0  # largest mean of one draw: exp(-mean) stays far from underflow
MAX_BROADCAST_SOURCES = 100_000


def hashed_unit(*parts: Column) -> Column:
    """A double in [0, 1) from the first 52 bits of md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def hashed_key(*parts: Column) -> Column:
    """A bigint from the first 60 bits of md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("bigint")


def poisson_cdf(mean: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... up to far beyond any 52-bit number, by the recurrence of the terms."""
    top = F.ceil(mean + 12.0 * F.sqrt(mean) + 40.0).cast("int")
    first = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + p)).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), top), first, step, lambda acc: acc["c"])


def repetition_rates(documents: DataFrame, source: str, text: str, targets: dict[str, float] | None, epochs: float) -> DataFrame:
    """_source, _bytes, _rate. Without targets, shares follow the square root of each source's bytes."""
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1
    sums = documents.groupBy(F.col(source).alias("_source")).agg(F.sum(size.cast("bigint")).alias("_bytes"))
    if targets is None:
        weighted = sums.withColumn("_weight", F.sqrt(F.col("_bytes").cast("double")))
    else:
        table = F.create_map(*[x for k, v in targets.items() for x in (F.lit(k), F.lit(float(v)))])
        weighted = sums.withColumn("_weight", F.coalesce(F.try_element_at(table, F.coalesce("_source", F.lit(""))), F.lit(0.0)))
    # decimals add up to the same total in whatever order rows arrive; two numbers come to the driver
    total = weighted.agg(F.sum("_bytes"), F.sum(F.col("_weight").cast("decimal(38,6)"))).first()
    all_bytes, all_weight = float(total[0] or 0), float(total[1] or 0) or None
    rate = F.lit(float(epochs)) * F.lit(all_bytes) * F.col("_weight") / F.lit(all_weight).cast("double") / F.col("_bytes")
    return weighted.select("_source", "_bytes", rate.alias("_rate"))


def mix(
    documents: DataFrame,
    targets: dict[str, float] | None = None,
    epochs: float = 1.0,
    seed: int = 42,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """Every column of ``documents`` for each copy, plus copy_no (from 0), copies, repetition_rate and
    shuffle_key; a name already taken gets a leading underscore. Rows end in global random order."""
    copy_no, copies, rate, order = free_names(documents.columns, "copy_no", "copies", "repetition_rate", "shuffle_key")
    names = free_names([*documents.columns, copy_no, copies, rate, order], "_source", "_rate", "_parts", "_cdf")
    rates = repetition_rates(documents, source, text, targets, epochs)
    parts = F.greatest(F.lit(1), F.ceil(F.col("_rate") / PIECE)).cast("int")
    rates = rates.filter("_rate > 0").withColumn("_parts", parts).withColumn("_cdf", poisson_cdf(F.col("_rate") / F.col("_parts")))
    rates = rates.select(*[F.col(c).alias(n) for c, n in zip(("_source", "_rate", "_parts", "_cdf"), names)])
    own_source, own_rate, own_parts, cdf = names
    small = rates.limit(MAX_BROADCAST_SOURCES + 1).count() <= MAX_BROADCAST_SOURCES
    joined = documents.join(F.broadcast(rates) if small else rates, F.col(source).eqNullSafe(F.col(own_source)))

    def draw(j: Column) -> Column:
        u = hashed_unit(F.col(key).cast("string"), F.lit(str(seed)), j.cast("string"))
        return F.size(F.filter(F.col(cdf), lambda c: c <= u))

    count = F.aggregate(F.transform(F.sequence(F.lit(1), F.col(own_parts)), draw), F.lit(0), lambda a, n: a + n)
    copied = joined.withColumn(copies, count).filter(F.col(copies) > 0)
    copied = copied.withColumn(copy_no, F.explode(F.sequence(F.lit(0), F.col(copies) - 1)))
    copied = copied.withColumn(order, hashed_key(F.col(key).cast("string"), F.lit(str(seed)), F.lit("order"), F.col(copy_no).cast("string")))
    out = copied.select(*documents.columns, copy_no, copies, F.col(own_rate).alias(rate), order)
    return out.repartition(F.col(order)).sortWithinPartitions(order)


ORACLE_SQL = """WITH RECURSIVE sums AS (
  SELECT source, CAST(sum(coalesce(octet_length(encode(text)), 0) + 1) AS BIGINT) AS b FROM documents GROUP BY source),
rates AS (
  SELECT source, CAST((SELECT sum(b) FROM sums) AS DOUBLE) * sqrt(CAST(b AS DOUBLE))
    / (SELECT CAST(sum(CAST(sqrt(CAST(b AS DOUBLE)) AS DECIMAL(38, 6))) AS DOUBLE) FROM sums) / b AS rate FROM sums),
cdf AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM rates
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM cdf WHERE k < rate + CAST(12 AS DOUBLE) * sqrt(rate) + 40),
draws AS (
  SELECT doc_id, source, CAST(('0x' || substr(md5(doc_id || '|42|1'), 1, 13)) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) AS u FROM documents),
counted AS (
  SELECT d.doc_id, d.source, CAST(count(*) AS INTEGER) AS copies FROM draws d JOIN cdf c
    ON d.source IS NOT DISTINCT FROM c.source AND c.c <= d.u GROUP BY d.doc_id, d.source)
SELECT n.doc_id, n.source, t.text, CAST(i.i AS INTEGER) AS copy_no, n.copies,
  CAST(('0x' || substr(md5(n.doc_id || '|42|order|' || i.i), 1, 15)) AS BIGINT) AS shuffle_key
FROM counted n JOIN documents t ON t.doc_id = n.doc_id, LATERAL (SELECT unnest(range(n.copies)) AS i) i"""
