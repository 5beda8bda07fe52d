"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source of n documents whose share of the result shall be w repeats each of its documents Poisson(w * total / n) times: a uniform
number made from the seed and doc_id is inverted through the distribution, so a document's count never depends on the other rows of
its partition. A mean above `PART` is a sum of equal parts, each with a number of its own, so that the inversion needs few terms.
The copies then go to partitions by a hash of (seed, doc_id, copy) and are ordered by it there: a global shuffle.

Defined results: documents of a null source are a source of their own; a source without a target weight gets `other` (0: none of
it); rows that repeat a doc_id draw the same count, and rows that repeat each other are each copied so often; a null doc_id draws as the
text 'null'; texts, null, empty or very long, aren't looked at; the columns of docs come back as they are, and the added ones take names
that docs doesn't have; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalwright.llm._common import fresh

#: The largest mean that is inverted in one piece, and the terms of its distribution (what is left beyond them is below 1e-15).
PART, TERMS = 4.0, 32
#: Up to so many sources the rates are broadcast; more are joined by salted keys.
FEW_SOURCES = 10_000


def uniform(*parts: Column) -> Column:
    """A number from [0, 1) of 52 bits, from the md5 of the parts joined by ':'."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def distribution(mean: Column) -> Column:
    """The Poisson distribution function at 0, 1, ... TERMS - 1, as an array."""
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("total"), F.array(F.exp(-mean)).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k.cast("double")
        return F.struct(p.alias("p"), (acc["total"] + p).alias("total"), F.concat(acc["all"], F.array(acc["total"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS - 1)), start, step, lambda acc: acc["all"])


def rates(docs: DataFrame, weights: Mapping[str, float] | None = None, total: float | None = None, other: float = 1.0, source: str = "source") -> DataFrame:
    """_source, _parts, _cdf: one row for each source, its mean repetition rate as so many equal parts and their distribution."""
    counted = docs.groupBy(F.col(source).alias("_source")).agg(F.count("*").alias("_n"))
    weight = F.lit(float(other))
    for name, w in (weights or {}).items():
        weight = F.when(F.col("_source") == name, F.lit(float(w))).otherwise(weight)
    counted = counted.withColumn("_w", weight)
    sums = counted.agg(F.sum("_w").alias("_all"), F.sum("_n").alias("_rows"))  # one row
    wanted = F.col("_rows").cast("double") if total is None else F.lit(float(total))
    rate = F.when(F.col("_all") > 0, F.col("_w") / F.col("_all") * wanted / F.col("_n")).otherwise(0.0)
    rated = counted.join(F.broadcast(sums), F.lit(True)).select("_source", rate.alias("_rate"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("_rate") / PART)).cast("int")
    return rated.withColumn("_parts", parts).select("_source", "_parts", distribution(F.col("_rate") / F.col("_parts")).alias("_cdf"))


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, seed: int = 7, total: float | None = None, other: float = 1.0, source: str = "source") -> DataFrame:
    """docs with each row as often as its source's rate draws it, plus `copy` (from 1) and `shuffle_key`, in global random order.

    weights: target weights by source; None: the same for each. total: rows of the result on average; None: as many as docs has.
    """
    spark = docs.sparkSession
    copy, key, salt, of, parts, cdf, times, dealt_to = (fresh(docs, c) for c in ("copy", "shuffle_key", "_salt", "_source", "_parts", "_cdf", "_times", "_dealt"))
    by_source = rates(docs, weights, total, other, source).toDF(of, parts, cdf)
    salts = 64
    few = by_source.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES
    if few:
        rated = docs.join(F.broadcast(by_source), F.col(source).eqNullSafe(F.col(of)))
    else:
        dealt = by_source.withColumn(dealt_to, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        salted = docs.withColumn(salt, F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
        rated = salted.join(dealt, F.col(source).eqNullSafe(F.col(of)) & (F.col(salt) == F.col(dealt_to)))
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    draws = F.transform(F.sequence(F.lit(1), F.col(parts)), lambda j: uniform(F.lit(str(seed)), ident, j.cast("string")))
    count = F.aggregate(draws, F.lit(0), lambda n, u: n + F.size(F.filter(F.col(cdf), lambda c: u >= c)))
    repeated = rated.withColumn(times, count).where(F.col(times) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times))))
    order = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"order{seed}"), ident, F.col(copy).cast("string"))), 1, 13), 16, 10).cast("long")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return repeated.select(*docs.columns, copy, order.alias(key)).repartition(n, key).sortWithinPartitions(key)


SQL = """
WITH counted AS (SELECT source, count(*) AS n, 1.0::DOUBLE AS w FROM documents GROUP BY source),
rated AS (SELECT source, w / (sum(w) OVER ()) * (sum(n) OVER ())::DOUBLE / n AS rate FROM counted),
parted AS (SELECT source, rate, greatest(1, ceil(rate / 4.0))::INT AS parts FROM rated),
terms AS (SELECT source, k, exp(-rate / parts) * pow(rate / parts, k) / gamma(k + 1) AS p FROM parted, range(0, 32) t(k)),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
lists AS (SELECT source, list(c ORDER BY k) AS cdf FROM cdf GROUP BY source),
draws AS (SELECT d.doc_id, l.cdf, ('0x' || md5('7:' || d.doc_id || ':' || j)[1:13])::BIGINT / 4503599627370496.0::DOUBLE AS u
          FROM documents d JOIN parted p ON d.source IS NOT DISTINCT FROM p.source JOIN lists l ON p.source IS NOT DISTINCT FROM l.source, range(1, p.parts + 1) t(j)),
counts AS (SELECT doc_id, sum(len(list_filter(cdf, lambda c: u >= c)))::INT AS n FROM draws GROUP BY doc_id)
SELECT d.*, c.copy::INT AS copy, ('0x' || md5('order7:' || d.doc_id || ':' || c.copy)[1:13])::BIGINT AS shuffle_key
FROM documents d JOIN (SELECT doc_id, unnest(range(1, n + 1)) AS copy FROM counts WHERE n > 0) c ON d.doc_id = c.doc_id
"""
