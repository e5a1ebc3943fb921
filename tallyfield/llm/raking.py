"""Mixing sources to target weights by iterative proportional fitting.

Tokens are added up per cell (source, language, topic). The cells' weights are scaled to
the goal of every source, then of every language, then of every topic, and again, until
all three hold. The goals share out a budget, a stated part of all tokens; no cell gives more
than it has. A document is sampled with the probability its cell's weight gives. DataFrame
functions alone: a sweep is three window sums over the cells.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.functions import broadcast_if_small
from tallyfield.functions.text import column_named

from .common import WORD, written

_log = logging.getLogger(__name__)

# Shares of the goals go with the tokens to this power: 1 leaves a marginal as it is, 0
# makes its values equal.
TEMPER = {"source": 0.8, "lang": 0.9, "topic": 0.95}
# Sweeps go on until the tolerance holds. Goals that contradict each other never hold: then
# the error stops falling, by a tenth in STALL sweeps at least.
MAX_SWEEPS, TOLERANCE = 1000, 1e-12
STALL = 24
# Sweeps in one plan, before the cells are written.
AT_ONCE = 8
# Up to so many cells are swept in one task, without an exchange for each window.
IN_ONE_TASK = 50_000
# The pipeline's sample is held to its goals as nearly as this.
STAGE_TOLERANCE = 1e-6
# The part of all tokens that is sampled.
SHARE = 0.7
MAX_BROADCAST_BYTES = 16 * 1024 * 1024


def topic_of(text: Column) -> Column:
    """A coarse topic by plain signs in the text; NULL counts as prose."""
    return (
        F.when(F.contains(F.lower(text), F.lit("licens")), "legal")
        .when(F.contains(text, F.lit(" | ")), "table")
        .when(F.contains(text, F.lit("@")), "contact")
        .otherwise("prose")
    )


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def draw(key: Column) -> Column:
    """A number in [0, 1) that depends on the key alone."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(float(16**13))


def tempered_targets(cells: DataFrame, temper: dict[str, float]) -> dict[str, DataFrame]:
    """For each dimension `value`, `share`: its tokens to a power."""
    targets = {}
    for name, power in temper.items():
        sums = cells.groupBy(F.col(name).alias("value")).agg(F.sum("tokens").alias("tokens"))
        targets[name] = sums.where(F.col("tokens") > 0).select(
            "value", F.pow(F.col("tokens").cast("double"), F.lit(power)).alias("share")
        )
    return targets


def fit(
    cells: DataFrame,
    targets: dict[str, DataFrame],
    share: float = SHARE,
    max_sweeps: int = MAX_SWEEPS,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """The `cells` with tokens (the dimensions, `tokens`), the `rate` at which each is sampled,
    and `off`.

    The rates sample `share` of all tokens so that the values of each dimension have the shares
    of `targets` (`value`, `share`, in any scale). A value that would need more than it has
    is kept whole, rate 1, and the others share what it leaves: so a rare value takes what it
    has and does not set the size of the sample. Within a sweep a cell gives at most what it
    has, and the free cells of its value make up for it. A value without a target gets
    rate 0; targets of values without tokens count for nothing. `off` is the same in all rows:
    by how much of its goal a value was off in the last sweep. Above `tolerance` it says
    that the goals are not met, as where they contradict each other, and a warning is logged.
    Labels are not NULL. Only the cells are worked on, as many as there are combinations.
    """
    if not 0 < share <= 1:
        raise ValueError(f"a share of the tokens is above 0 and at most 1, not {share}")
    cells = written(cells.where(F.col("tokens") > 0).withColumn("tokens", F.col("tokens").cast("double")))
    budget = share * (cells.agg(F.sum("tokens")).first()[0] or 0.0)
    aimed = cells.withColumns({"weight": F.col("tokens") * share, "whole": F.lit(False)})
    for name, target in targets.items():
        goals = _goals(cells, name, target, budget)
        aimed = aimed.join(broadcast_if_small(goals, MAX_BROADCAST_BYTES), name)
        aimed = aimed.withColumn("whole", F.col("whole") | F.col(f"all_{name}")).drop(f"all_{name}")
    current = written(aimed)
    small = current.count() <= IN_ONE_TASK
    errors: list[float] = []
    while True:
        current = current.coalesce(1) if small else current
        for _ in range(AT_ONCE):
            current = _swept(current, list(targets))
        current = written(current)
        worst = current.agg(F.max(F.greatest(F.lit(0.0), *[F.col(f"off_{n}") for n in targets]))).first()[0]
        errors.append(worst or 0.0)
        sweeps = AT_ONCE * len(errors)
        stalled = sweeps > STALL and errors[-1] > 0.9 * errors[-1 - STALL // AT_ONCE]
        if errors[-1] <= tolerance or stalled or sweeps >= max_sweeps:
            break
    off = errors[-1]
    if off > tolerance:
        _log.warning("mixing misses its goals by up to %.3g of a goal after %d sweeps", off, sweeps)
    rate = F.when(_full(), 1.0).otherwise(F.col("weight") / F.col("tokens"))
    return current.select(*targets, F.col("tokens").cast("bigint").alias("tokens"), rate.alias("rate"), F.lit(off).alias("off"))


def _goals(cells: DataFrame, name: str, target: DataFrame, budget: float) -> DataFrame:
    """`name`, `goal_`: the tokens each value is to give, and `all_`, whether that is all it has.

    The budget is shared out by the targets; what values cannot give for lack of tokens goes to
    the others, again by their targets, until no goal is more than its value has.
    """
    shares = target.select(F.col("value").alias(name), F.col("share").cast("double").alias("share"))
    held = cells.groupBy(name).agg(F.sum("tokens").alias("has")).join(shares, name, "left")
    held = written(held.withColumn("share", F.coalesce("share", F.lit(0.0))))
    scale, lacking = 0.0, -1
    while True:
        lacks = F.col("has") <= F.lit(scale) * F.col("share")
        n, has, rest = held.agg(
            F.count(F.when(lacks, 1)),
            F.coalesce(F.sum(F.when(lacks, F.col("has"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~lacks, F.col("share"))), F.lit(0.0)),
        ).first()
        if n == lacking or not rest:
            break
        scale, lacking = (budget - has) / rest, n
    wanted = F.lit(scale) * F.col("share")
    return held.select(
        name, F.least("has", wanted).alias(f"goal_{name}"), (F.col("has") <= wanted).alias(f"all_{name}")
    )


def _full() -> Column:
    return F.col("whole") | (F.col("weight") >= F.col("tokens"))


def _swept(cells: DataFrame, names: list[str]) -> DataFrame:
    """The cells with weights scaled to the goals of every dimension in turn, and how far off
    each was before."""
    for name in names:
        value, goal = Window.partitionBy(name), F.col(f"goal_{name}")
        cells = cells.withColumns(
            {
                "_full": F.sum(F.when(_full(), F.col("tokens")).otherwise(0.0)).over(value),
                "_free": F.sum(F.when(_full(), 0.0).otherwise(F.col("weight"))).over(value),
            }
        )
        total = F.col("_full") + F.col("_free")
        scale = (
            F.when((total < goal) & (F.col("_free") > 0), (goal - F.col("_full")) / F.col("_free"))
            .when(total > goal, goal / total)
            .otherwise(1.0)
        )
        cells = cells.withColumns(
            {
                "weight": F.col("weight") * scale,
                f"off_{name}": F.when(goal > 0, F.abs(total / goal - 1)).otherwise(0.0),
            }
        ).drop("_full", "_free")
    return cells


def mix_sources(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    dimensions: dict[str, Column] | None = None,
    targets: dict[str, DataFrame] | None = None,
    temper: dict[str, float] = TEMPER,
    share: float = SHARE,
    max_sweeps: int = MAX_SWEEPS,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """All columns of `docs` and `_topic`, `_tokens`, `_probability`, `_sampled` and `_off`.

    The dimensions are expressions over `docs`, by default the columns `source` and `lang`
    and a topic read from the text; NULL is a value of its own. Targets are shares of the
    tokens by dimension (`value`, `share`; '=' before a value, '' for NULL), by default the
    present ones tempered. `share` of all tokens is sampled, see `fit`, where `_off` is told
    too. The draw depends on the key alone: rows with one key, or none, are drawn alike. A row
    without tokens is sampled where its cell has tokens in other rows; a cell without any has
    probability 0. The five new columns replace columns of the same name.
    """
    dimensions = dimensions or {
        "source": F.col("source"),
        "lang": F.col("lang"),
        "topic": topic_of(column_named(text)),
    }
    labels = {n: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("")) for n, c in dimensions.items()}
    counted = word_count(column_named(text))
    cells = written(
        docs.select(*[c.alias(n) for n, c in labels.items()], counted.alias("tokens"))
        .groupBy(*labels)
        .agg(F.sum("tokens").alias("tokens"))
    )
    fitted = fit(cells, targets or tempered_targets(cells, temper), share, max_sweeps, tolerance)
    off = fitted.agg(F.max("off")).first()[0] or 0.0
    rates = written(fitted.select(*labels, "rate"))
    # The input row is one column, so that its columns may have any names.
    ready = docs.select(
        F.struct(*[column_named(c) for c in docs.columns]).alias("row"),
        *[c.alias(n) for n, c in labels.items()],
        counted.alias("_tokens"),
        draw(column_named(key)).alias("_draw"),
    )
    rated = ready.join(broadcast_if_small(rates, MAX_BROADCAST_BYTES), list(labels), "left")
    probability = F.coalesce("rate", F.lit(0.0))
    new = {
        "_topic": F.substring(list(labels)[-1], 2, 1000),
        "_tokens": F.col("_tokens"),
        "_probability": probability,
        "_sampled": F.col("_draw") < probability,
        "_off": F.lit(off),
    }
    return rated.select(
        *[F.col("row").getField(c).alias(c) for c in docs.columns if c not in new],
        *[c.alias(n) for n, c in new.items()],
    )


def sampled_stage(
    docs: DataFrame, key: str = "doc_id", text: str = "text", share: float = SHARE
) -> DataFrame:
    """The sampled documents, `share` of all tokens, with the columns they had."""
    marked = docs.select(
        F.struct(*[column_named(c) for c in docs.columns]).alias("row"),
        column_named(key).alias("key"),
        column_named(text).alias("text"),
        *[F.col(c) for c in ("source", "lang")],
    )
    mixed = mix_sources(marked, "key", "text", share=share, tolerance=STAGE_TOLERANCE)
    return mixed.where("_sampled").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


# Sweeps in SQL, several times as many as the tolerance takes on tables like the given ones.
SQL_SWEEPS = 40


def mix_sql(share: float = SHARE, sweeps: int = SQL_SWEEPS) -> str:
    """The same in SQL, for the default dimensions, with a number of sweeps after which
    weights no longer change in the places that are compared."""
    goals = []
    for name, power in TEMPER.items():
        goals.append(
            f"""has_{name} AS MATERIALIZED (
  SELECT {name}, sum(tokens) AS has, pow(sum(tokens), {power}) AS share FROM cells GROUP BY {name}
), filled_{name} AS MATERIALIZED (
  SELECT *, ({share} * (SELECT sum(tokens) FROM cells)
             - coalesce(sum(has) OVER (ORDER BY has / share, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(share) OVER (ORDER BY has / share, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
            >= has / share AS all_{name}
  FROM has_{name}
), goal_{name} AS MATERIALIZED (
  SELECT {name}, all_{name}, CASE WHEN all_{name} THEN has ELSE share
    * ({share} * (SELECT sum(tokens) FROM cells) - coalesce(sum(has) FILTER (all_{name}) OVER (), 0))
    / sum(share) FILTER (NOT all_{name}) OVER () END AS goal_{name}
  FROM filled_{name}
)"""
        )
    steps, last = [], "start"
    full = "(whole OR weight >= tokens)"
    for sweep in range(sweeps):
        for name in TEMPER:
            step = f"step_{sweep}_{name}"
            steps.append(
                f"""{step} AS MATERIALIZED (
  SELECT * EXCLUDE (weight, held, free), weight * CASE
      WHEN held + free < goal_{name} AND free > 0 THEN (goal_{name} - held) / free
      WHEN held + free > goal_{name} THEN goal_{name} / (held + free) ELSE 1 END AS weight
  FROM (SELECT *, sum(CASE WHEN {full} THEN tokens ELSE 0 END) OVER (PARTITION BY {name}) AS held,
               sum(CASE WHEN {full} THEN 0 ELSE weight END) OVER (PARTITION BY {name}) AS free FROM {last})
)"""
            )
            last = step
    joins = " ".join(f"JOIN goal_{name} USING ({name})" for name in TEMPER)
    whole = " OR ".join(f"all_{name}" for name in TEMPER)
    ctes = ",\n".join(
        [
            *goals,
            f"start AS MATERIALIZED (SELECT * EXCLUDE (tokens), CAST(tokens AS double) AS tokens, "
            f"tokens * {share} AS weight, {whole} AS whole FROM cells {joins})",
            *steps,
        ]
    )
    return f"""
WITH docs AS MATERIALIZED (
  SELECT doc_id, coalesce('=' || source, '') AS source, coalesce('=' || lang, '') AS lang,
         CASE WHEN contains(lower(text), 'licens') THEN '=legal'
              WHEN contains(text, ' | ') THEN '=table'
              WHEN contains(text, '@') THEN '=contact' ELSE '=prose' END AS topic,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS tokens
  FROM documents
),
cells AS MATERIALIZED (
  SELECT source, lang, topic, CAST(sum(tokens) AS bigint) AS tokens
  FROM docs GROUP BY ALL HAVING sum(tokens) > 0
),
{ctes},
rates AS MATERIALIZED (
  SELECT source, lang, topic, CASE WHEN {full} THEN 1 ELSE weight / tokens END AS rate FROM {last}
)
SELECT doc_id, substr(topic, 2) AS topic, CAST(tokens AS bigint) AS tokens,
       round(coalesce(rate, 0), 6) AS probability,
       CAST('0x' || substr(md5(coalesce(CAST(doc_id AS varchar), '')), 1, 13) AS bigint)
         / 4503599627370496.0 < coalesce(rate, 0) AS sampled
FROM docs LEFT JOIN rates USING (source, lang, topic)
"""
