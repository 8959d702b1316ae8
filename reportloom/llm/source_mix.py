"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents are aggregated by membership pattern, the set of sources that they
belong to. A flow sends word capacity from patterns to the quotas of their
sources. Every further copy of a pattern costs more than the one before it
(convex costs), so nothing is repeated while fresh words can still reach a
quota. The flow of a pattern then becomes whole copies of all its documents and
a seeded choice of documents for the remainder.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reportloom.llm.common import WORD, durable, table

Source = str | None


def targets(sizes: dict[Source, int], weights: dict[Source, float], share: float, cap: float) -> dict[Source, float]:
    """Splits ``share`` times all sizes by weight; no source gets more than ``cap`` times its size.

    What a capped source cannot take goes to the others by weight, until none is
    above its cap: all uncapped sources end at one level per unit of weight.
    """
    total, out, rest = share * sum(sizes.values()), {}, list(sizes)
    rest.sort(key=lambda s: (cap * sizes[s] / weights[s], s is None, s or ""))
    weight = sum(weights[s] for s in rest)
    for s in rest:
        if total * weights[s] > cap * sizes[s] * weight:
            out[s] = float(cap * sizes[s])
            total -= out[s]
            weight -= weights[s]
        else:
            break
    level = total / weight if weight else 0.0
    return {s: out[s] if s in out else level * weights[s] for s in sizes}


def cycled_weights(sources: list[Source], cycle: tuple[float, ...] = (5, 2, 1)) -> dict[Source, float]:
    """Weights in turn for the sources by code point, null last."""
    ordered = sorted(sources, key=lambda s: (s is None, s or ""))
    return {s: cycle[k % len(cycle)] for k, s in enumerate(ordered)}


def route(patterns: dict[tuple[Source, ...], int], quotas: dict[Source, int], copies: int) -> dict[tuple[Source, ...], int]:
    """Words to take from each pattern: a maximum flow of least repetition cost.

    Costs sit on the arcs into the patterns alone and rise with each copy, so
    augmenting one layer of copies after the other is successive shortest paths.
    """
    flow: dict[tuple, dict[Source, int]] = {p: dict.fromkeys(p, 0) for p in patterns}
    users: dict[Source, list[tuple]] = {}
    for p in patterns:
        for s in p:
            users.setdefault(s, []).append(p)
    open_quota = dict(quotas)
    taken = dict.fromkeys(patterns, 0)
    for layer in range(1, copies + 1):
        for start in patterns:
            while (spare := patterns[start] * layer - taken[start]) > 0:
                came: dict = {("p", start): None}
                queue, end = deque([("p", start)]), None
                while queue and end is None:
                    kind, at = queue.popleft()
                    if kind == "p":
                        for s in at:
                            if ("s", s) not in came:
                                came["s", s] = (kind, at)
                                queue.append(("s", s))
                                if open_quota.get(s, 0) > 0:
                                    end = ("s", s)
                                    break
                    else:
                        for p in users[at]:
                            if flow[p][at] > 0 and ("p", p) not in came:
                                came["p", p] = (kind, at)
                                queue.append(("p", p))
                if end is None:
                    break
                path = [end]
                while came[path[-1]] is not None:
                    path.append(came[path[-1]])
                path.reverse()
                steps = list(zip(path, path[1:], strict=False))
                width = min([spare, open_quota[end[1]], *(flow[b[1]][a[1]] for a, b in steps if a[0] == "s")])
                for a, b in steps:
                    if a[0] == "p":
                        flow[a[1]][b[1]] += width
                    else:
                        flow[b[1]][a[1]] -= width
                taken[start] += width
                open_quota[end[1]] -= width
    return taken


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_mix(
    docs: DataFrame,
    sources: Column | None = None,
    weigh: Callable[[list[Source]], dict[Source, float]] = cycled_weights,
    share: float = 1.5,
    copies: int = 2,
    seed: int = 0,
    fills: int = 2,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: doc_id, sources, size, copies, taken, source_sizes, source_targets.

    ``sources`` is an array column of the sources a document belongs to, by
    default its own ``source`` alone; a document of none (null or empty) is not taken. Sizes are words of the whole text (null: 0).
    Documents are taken whole, ``copies`` times at most. The remainder of a
    pattern is filled in the order of a seeded digest; then, ``fills`` times, the
    document that comes nearest to the gap left is added if it narrows the gap.
    Reruns agree. Repeated rows count one by one; a null doc_id is an id like
    any other; an empty table gives no rows; other columns are ignored unless
    named in ``keep``.

    The digest's leading digits deal a pattern's documents to 4096 buckets.
    Running sums come from the bucket totals and, inside a bucket, a window, so
    a source with a third of all documents is summed by many tasks. Only totals
    per membership pattern reach the driver.
    """
    spark = docs.sparkSession
    sources = F.array("source") if sources is None else sources
    sources = F.coalesce(sources, F.array().cast(docs.select(sources).schema[0].dataType))
    rows = durable(
        docs.select(
            "doc_id",
            F.array_sort(F.array_distinct(sources)).alias("sources"),
            word_count(F.col("text")).alias("size"),
            F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("key"),
            *keep,
        )
        .withColumn("pattern", F.to_json("sources"))
        .withColumn("bucket", F.substring("key", 1, 3))
    )
    sums = durable(rows.groupBy("pattern", "bucket").agg(F.sum("size").alias("sum"), F.first("sources").alias("sources")))
    found = sums.groupBy("pattern").agg(F.sum("sum").alias("size"), F.first("sources").alias("sources")).collect()
    patterns = {tuple(r.sources or ()): r.size for r in found}
    sizes: dict[Source, int] = {}
    for p, size in patterns.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + size
    wanted = targets(sizes, weigh(list(sizes)), share, copies)
    words = route(patterns, {s: round(t) for s, t in wanted.items()}, copies)
    plan = spark.createDataFrame(
        [
            (
                r.pattern, *divmod(words[p], r.size or 1),
                [sizes[s] for s in p], [wanted[s] for s in p],
            )
            for r in found for p in [tuple(r.sources or ())]
        ],
        "pattern string, whole long, rest long, source_sizes array<long>, source_targets array<double>",
    )
    ahead = Window.partitionBy("pattern").orderBy("bucket")
    starts = sums.select("pattern", "bucket", (F.sum("sum").over(ahead) - F.col("sum")).alias("before"))
    inside = Window.partitionBy("pattern", "bucket").orderBy("key", "doc_id", "size")
    chosen = (
        rows.withColumn("nth", F.row_number().over(inside))
        .withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .join(starts, ["pattern", "bucket"])
        .join(plan, "pattern")
        .withColumn("extra", F.col("before") + F.col("upto") <= F.col("rest"))
    )
    for _ in range(fills):
        chosen = durable(chosen)
        gaps = (
            chosen.groupBy("pattern", "rest").agg(F.sum(F.when(F.col("extra"), F.col("size")).otherwise(0)).alias("got"))
            .select("pattern", (F.col("rest") - F.col("got")).alias("gap"))
        )
        best = (
            chosen.where(~F.col("extra")).join(gaps, "pattern")
            .where(F.abs(F.col("size") - F.col("gap")) < F.col("gap"))
            .groupBy("pattern").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), "key", "nth")).alias("b"))
            .select("pattern", "b.key", "b.nth", F.lit(True).alias("best"))
        )
        chosen = (
            chosen.join(best, ["pattern", "key", "nth"], "left")
            .withColumn("extra", F.col("extra") | F.coalesce("best", F.lit(False))).drop("best")
        )
    taken_copies = F.when(F.col("size") == 0, 0).otherwise(F.col("whole") + F.col("extra").cast("long"))
    return chosen.select(
        "doc_id", "sources", "size", taken_copies.cast("long").alias("copies"),
        (taken_copies * F.col("size")).cast("long").alias("taken"), "source_sizes", "source_targets", *keep,
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document has one source here, so its first source is its only one."""
    return source_mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", F.get("source_sizes", F.lit(0)).alias("source_size"),
        F.get("source_targets", F.lit(0)).alias("target"), "taken",
    )


_FILL = """
  g{n} AS (SELECT source, any_value(rest) - sum(CASE WHEN extra THEN size ELSE 0 END) AS gap FROM c{m} GROUP BY source),
  b{n} AS (SELECT c.source, key, nth FROM c{m} c JOIN g{n} g ON c.source IS NOT DISTINCT FROM g.source
          WHERE NOT extra AND abs(size - gap) < gap
          QUALIFY row_number() OVER (PARTITION BY c.source ORDER BY abs(size - gap), key, nth) = 1),
  c{n} AS (SELECT c.* REPLACE (c.extra OR b.key IS NOT NULL AS extra) FROM c{m} c
          LEFT JOIN b{n} b ON c.source IS NOT DISTINCT FROM b.source AND c.key = b.key AND c.nth = b.nth)"""

SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
             md5('0:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
  s AS (SELECT source, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
  w AS (SELECT *, [5, 2, 1][k % 3 + 1] AS weight FROM s),
  o AS (SELECT *, row_number() OVER (ORDER BY 2.0 * n / weight, source NULLS LAST) AS place FROM w),
  r AS (SELECT *, 1.5 * (SELECT sum(n) FROM s)::DOUBLE - coalesce(sum(2.0::DOUBLE * n) OVER p, 0) AS total,
          sum(weight) OVER q AS left_weight FROM o
        WINDOW p AS (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
               q AS (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
  f AS (SELECT *, coalesce(bool_and(total * weight > 2 * n * left_weight) OVER (ORDER BY place), false) AS capped FROM r),
  v AS (SELECT arg_min(total / left_weight, place) AS level FROM f WHERE NOT capped),
  t AS (SELECT source, n, CASE WHEN capped THEN 2.0::DOUBLE * n ELSE (SELECT level FROM v) * weight END::DOUBLE AS target FROM f),
  q AS (SELECT source, n, target, CASE WHEN n = 0 THEN 0 ELSE round_even(target, 0)::BIGINT // n END AS whole,
          CASE WHEN n = 0 THEN 0 ELSE round_even(target, 0)::BIGINT % n END AS rest FROM t),
  c0 AS (SELECT d.*, n, target, whole, rest,
          row_number() OVER (PARTITION BY d.source, key[1:3] ORDER BY key, doc_id, size) AS nth,
          sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) <= rest AS extra
        FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
  {_FILL.format(n=1, m=0).strip()},
  {_FILL.format(n=2, m=1).strip()}
SELECT doc_id, size, n AS source_size, target, CASE WHEN size = 0 THEN 0 ELSE (whole + extra::INT) * size END::BIGINT AS taken
FROM c2
"""
