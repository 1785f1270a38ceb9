"""Mixing sources to target weights [native].

Every source has a target share of the output, in characters. The target repetition rate of its documents is the mean of a Poisson
distribution, which a number hashed from (seed, doc_id) inverts: the smallest count whose cumulated probability reaches it. Each
document is exploded by its count, and all copies are put in one global order by a hash of (seed, doc_id, copy).

The statistics are one partial aggregation by source, written to the shared folder. The rates join back by source: Catalyst broadcasts
them while their file is small; otherwise it is a sort-merge join whose hot source AQE splits, as no aggregation shares its stage. The global order cuts
the range of a uniform hash into equal parts, so partitions are even whatever the sources are, and nothing is sampled for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, hash_unit, table

SEED = "mix-1"
#: A larger mean is the sum of several independent Poisson counts of at most this mean: exp(-mean) must stay well above underflow.
LARGEST_MEAN = 500.0
#: Characters of a partition of the result.
PART_CHARS = 1 << 26


def source_rates(docs: DataFrame, targets: DataFrame | None = None, source: str = "source", text: str = "text") -> DataFrame:
    """src, mass, rate: the target repetition rate of each source.

    ``targets`` (src, weight) may name any sources; those absent or of weight null or below 0 get 0. None: equal weights. A null
    source counts as ''. Sources without any character cost nothing, take no share and are kept once (rate 1).
    """
    mass = docs.select(F.coalesce(F.col(source).cast("string"), F.lit("")).alias("src"), F.coalesce(F.length(text), F.lit(0)).alias("size"))
    mass = mass.groupBy("src").agg(F.sum("size").alias("mass"))
    if targets is None:
        mass = mass.withColumn("weight", F.lit(1.0))
    else:
        wanted = targets.groupBy(F.coalesce(F.col("src"), F.lit("")).alias("src")).agg(F.max(F.col("weight").cast("double")).alias("weight"))
        mass = mass.join(wanted, "src", "left").withColumn("weight", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)))
    mass = mass.withColumn("weight", F.when(F.col("mass") > 0, F.col("weight")).otherwise(F.lit(0.0)))
    total = mass.agg(F.sum("mass").alias("all_mass"), F.sum("weight").alias("all_weight"))
    # one row against one row per source
    rated = mass.join(F.broadcast(total), F.lit(True))
    rate = F.when(F.col("mass") == 0, F.lit(1.0)).when(F.col("all_weight") == 0, F.lit(0.0))
    rate = rate.otherwise(F.col("weight") / F.col("all_weight") * F.col("all_mass") / F.col("mass"))
    return rated.select("src", "mass", rate.alias("rate"))


def with_table(rates: DataFrame) -> DataFrame:
    """Adds ``parts`` and ``cdf``: a count is the sum, over that many hashed numbers, of how many entries of cdf lie below each."""
    mean = F.col("rate") / F.col("parts")
    last = F.ceil(F.col("mean") + 12 * F.sqrt("mean") + 24).cast("int")
    first = F.struct(F.exp(-F.col("mean")).alias("p"), F.array(F.exp(-F.col("mean"))).alias("c"))

    def step(s, k):
        p = s["p"] * F.col("mean") / k
        return F.struct(p.alias("p"), F.concat(s["c"], F.array(F.element_at(s["c"], -1) + p)).alias("c"))

    return (
        rates.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / LARGEST_MEAN)).cast("int"))
        .withColumn("mean", mean)
        .withColumn("cdf", F.aggregate(F.sequence(F.lit(1), last), first, step)["c"])
        .drop("mean")
    )


def mix(docs: DataFrame, targets: DataFrame | None = None, seed: str = SEED, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """All columns of ``docs`` plus copy (from 1) and shuffle_key, in the global order of shuffle_key.

    A document's count depends on (seed, key) and its source's rate alone; rows that repeat a key are drawn alike, rows without a key
    by their text. Null or empty texts have no mass but are drawn like the others of their source. Columns named copy or shuffle_key
    are replaced. An empty table gives an empty result.
    """
    docs = docs.drop("copy", "shuffle_key")
    # written first, so that Catalyst knows its size when it chooses the join
    rates = Scratch(docs.sparkSession, "mixing").save(with_table(source_rates(docs, targets, source, text)))
    size = rates.agg(F.sum(F.col("mass") * F.col("rate"))).first()[0]
    rates = rates.select(F.col("src").alias("__src"), F.col("parts").alias("__parts"), F.col("cdf").alias("__cdf"))
    ident = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("text-"), F.md5(F.coalesce(F.col(text), F.lit("")))))

    def count(u):
        return F.size(F.filter("__cdf", lambda c: c < u))

    drawn = F.aggregate(F.sequence(F.lit(1), F.col("__parts")), F.lit(0), lambda s, j: s + count(hash_unit(F.lit(seed), ident, j.cast("string"))))
    copies = (
        docs.withColumn("__src", F.coalesce(F.col(source).cast("string"), F.lit("")))
        .join(rates, "__src")
        .withColumn("__n", F.when(F.size("__cdf") > 0, drawn))
        .where("__n > 0")
        .select(*[docs[c] for c in docs.columns], F.explode(F.expr("sequence(1, __n)")).alias("copy"))
        .withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(seed), ident, F.col("copy").cast("string"), F.lit("order"))))
    )
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, int((size or 0) // PART_CHARS) + 1)
    share = F.conv(F.substring("shuffle_key", 1, 12), 16, 10).cast("double") / float(16**12)
    return copies.repartitionById(parts, F.floor(share * parts).cast("int")).sortWithinPartitions("shuffle_key")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "source", F.col("copy").cast("long").alias("copy"), "shuffle_key", "text")


OP7_SQL = f"""
WITH m AS (SELECT coalesce(source, '') AS src, sum(coalesce(length(text), 0)) AS mass FROM documents GROUP BY 1),
t AS (SELECT sum(mass) AS all_mass, CAST(count(*) FILTER (WHERE mass > 0) AS DOUBLE) AS all_weight FROM m),
r AS (SELECT src, CASE WHEN mass = 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE / all_weight * CAST(all_mass AS DOUBLE) / CAST(mass AS DOUBLE) END AS rate FROM m, t),
p AS (SELECT src, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p FROM r, LATERAL (SELECT unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 24) AS BIGINT) + 1)) AS k)),
c AS (SELECT src, sum(p) OVER (PARTITION BY src ORDER BY k) AS cdf FROM p),
l AS (SELECT src, list(cdf) AS cdfs FROM c GROUP BY src),
d AS (SELECT doc_id, text, source, coalesce(source, '') AS src,
  (CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'text-' || md5(coalesce(text, ''))) || ':1'), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM documents),
n AS (SELECT d.*, len(list_filter(cdfs, lambda x: x < u)) AS n FROM d JOIN l USING (src)),
e AS (SELECT doc_id, source, text, unnest(range(1, n + 1)) AS copy FROM n WHERE n > 0)
SELECT doc_id, source, copy, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'text-' || md5(coalesce(text, ''))) || ':' || CAST(copy AS VARCHAR) || ':order') AS shuffle_key, text FROM e
"""
