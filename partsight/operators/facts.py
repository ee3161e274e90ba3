"""Of all that is said about a topic, the fact that rules at each time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partsight.operators.ordered import dealt, running

#: 1 stock and orders, 2 business rules, 3 verified fitments, 4 approved entries. Anything else (5: style) never rules.
RULING_LEVELS = (1, 2, 3, 4)
#: Topics of these kinds take facts of level 1 only.
FIRST_HAND_KINDS = ("price", "stock", "hold", "order")
#: How long a fact of level 1 is believed.
FRESH_SECONDS = 1800


def ruling_facts(facts: DataFrame, fresh_seconds: int = FRESH_SECONDS) -> DataFrame:
    """Topic, since, level, fact_id: each time at which another fact begins to rule a topic.

    ``facts``: fact_id, topic, kind, level, valid_from, valid_to (null: open). Of the facts valid at a time
    the one with the lowest level rules. Within a level the latest says what holds: when a fact begins
    (ties: the largest fact_id), the one before it is over, also if its own validity is longer. Facts of
    level 1 end ``fresh_seconds`` after they begin. Kinds in ``FIRST_HAND_KINDS`` hear level 1 only and are
    never filled from below. A time without a ruling fact is a row too, with null level and fact_id:
    unknown. Every topic starts with its first fact, whether that one may rule or not. Facts without
    topic, level or beginning, and those that end before they begin, take no part.

    The starts and ends of a topic become one row a time, summed up where they are read; the last start of
    each level is a running maximum over them, carried over partitions, so one topic may have most facts.
    """
    fresh = F.col("valid_from") + F.expr(f"INTERVAL {int(fresh_seconds)} SECOND")
    end = F.when(F.col("level") == 1, F.least("valid_to", fresh)).otherwise(F.col("valid_to"))
    hears = F.col("level").isin(*RULING_LEVELS) & ((F.col("level") == 1) | ~F.coalesce(F.col("kind").isin(*FIRST_HAND_KINDS), F.lit(False)))
    said = facts.select("topic", "level", "fact_id", F.col("valid_from").alias("start"), end.alias("end"), hears.alias("hears")).where(
        "topic IS NOT NULL AND level IS NOT NULL AND start IS NOT NULL AND (end IS NULL OR end > start)"
    )
    begun = F.struct("start", "fact_id", "end")
    starts = said.select("topic", F.col("start").alias("at"), *(F.when(F.col("hears") & (F.col("level") == n), begun).alias(f"level{n}") for n in RULING_LEVELS))
    ends = said.where("hears AND end IS NOT NULL").select("topic", F.col("end").alias("at"))
    times = starts.unionByName(ends, allowMissingColumns=True).groupBy("topic", "at").agg(*(F.max(f"level{n}").alias(f"level{n}") for n in RULING_LEVELS))

    line = dealt(times, ["topic"], ["at"], "facts")
    carried = running(line, ["topic"], ["at"], maxima={f"before{n}": F.col(f"level{n}") for n in RULING_LEVELS})
    rules = None
    for n in RULING_LEVELS:
        last = F.greatest(f"before{n}", f"level{n}")
        valid = last.isNotNull() & (last["end"].isNull() | (last["end"] > F.col("at")))
        fact = F.struct(F.lit(n).alias("level"), last["fact_id"].alias("fact_id"))
        rules = F.when(valid, fact) if rules is None else rules.when(valid, fact)
    ruled = carried.select("topic", "at", "bucket", rules.alias("rules"))
    told = running(ruled, ["topic"], ["at"], maxima={"before": F.struct("at", "rules")})
    changed = F.col("before").isNull() | ~F.col("before.rules").eqNullSafe(F.col("rules"))
    return told.where(changed).select("topic", F.col("at").alias("since"), F.col("rules.level").alias("level"), F.col("rules.fact_id").alias("fact_id"))
