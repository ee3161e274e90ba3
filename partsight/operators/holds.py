"""Requests that take several items or none, in the order they came."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partsight.operators.ordered import dealt, running, stored
from partsight.session import run_dir

#: Holds that a conversation may have open.
CHAT_LIMIT = 1
#: Requests that are settled first, and how many times as many each time after that.
FRONT, GROWTH = 20_000, 16
_KEYS, _ORDER = ["resource", "key"], ["at", "request_id"]
_OPEN, _HELD, _REFUSED = 0, 1, 2


def hold_requests(requests: DataFrame, lines: DataFrame, stock: DataFrame, chat_holds: DataFrame, limit: int = CHAT_LIMIT) -> DataFrame:
    """request_id, status, hold_id, n_short: the fate of each request when they are served one after another.

    ``requests``: request_id (unique), confirmation_id, chat_id, requested_at. ``lines``: request_id,
    item_id, qty; lines of one item add up. ``stock``: item_id, available, held. ``chat_holds``: chat_id,
    n: holds open before. Requests are served by requested_at, then request_id. A request is ``held`` when
    every item has its quantity left; then all are taken, else none. A confirmation opens one hold at
    most: later requests with it are ``existing`` and name it in hold_id. A conversation has at most
    ``limit`` holds: beyond, ``limit``. Otherwise it is short of n_short items: ``stock``. Requests with a
    null id, confirmation, chat or time, without lines, or with a line without item or with a quantity
    that is not positive, are ``invalid`` and take nothing. Items that stock does not know have none.

    Confirmation and conversation are resources like the items, with one and ``limit`` places, so one rule
    decides all. Rounds bracket what earlier requests took: at least what the held ones took, at most that
    and what the open ones ask for. A request that fits beneath the upper bound is held, one that misses
    the lower bound somewhere is refused; the first open one is always settled. A round is two running
    sums and one aggregate, each over rows of resources that still have open requests. Bounds close from
    the front and, once a resource is used up, for all behind at once; rounds follow the longest chain of
    requests that hang on each other, not the length of a hot item's queue. The earliest requests are
    settled first, in rounds over their rows alone; what they took refuses in one pass all later ones that
    ask for more than is left, and the rest, if there is one, goes on with a longer front.
    """
    spark = requests.sparkSession
    per_item = lines.groupBy("request_id", "item_id").agg(F.sum("qty").alias("qty"), F.bool_and(F.coalesce(F.col("qty") > 0, F.lit(False))).alias("good"))
    sound = per_item.groupBy("request_id").agg(F.bool_and(F.col("good") & F.col("item_id").isNotNull()).alias("good"))
    asked = requests.select("request_id", "confirmation_id", "chat_id", F.col("requested_at").alias("at"))
    whole = F.col("good")
    for column in asked.columns:
        whole = whole & F.col(column).isNotNull()
    checked = asked.join(sound, "request_id", "left").withColumn("good", F.coalesce(whole, F.lit(False)))
    valid = checked.where("good").drop("good")

    def demand(rows: DataFrame, resource: str, key: str, qty: Column, free: Column) -> DataFrame:
        return rows.select(
            F.lit(resource).alias("resource"), F.col(key).cast("string").alias("key"), "at", "request_id", qty.cast("long").alias("qty"), free.cast("long").alias("free")
        )

    left = stock.select("item_id", (F.col("available") - F.col("held")).alias("left"))
    items = valid.join(per_item.select("request_id", "item_id", "qty"), "request_id").join(left, "item_id", "left")
    chats = valid.join(chat_holds.select("chat_id", "n"), "chat_id", "left")
    demands = dealt(
        stored(
            demand(items, "item", "item_id", F.col("qty"), F.coalesce("left", F.lit(0)))
            .unionByName(demand(chats, "chat", "chat_id", F.lit(1), limit - F.coalesce("n", F.lit(0))))
            .unionByName(demand(valid, "confirmation", "confirmation_id", F.lit(1), F.lit(1))), "demands",
        ),
        _KEYS, _ORDER, "demands",
    )

    rest, size, holding = _able(demands), FRONT, None
    while True:
        # Every valid request has one place in a confirmation's line.
        places = rest.where(F.col("resource") == "confirmation")
        n = places.count()
        if n > size:
            last = places.agg(F.percentile_approx("at", size / n)).first()[0]
            front, rest = rest.where(F.col("at") <= F.lit(last)), rest.where(F.col("at") > F.lit(last))
        else:
            front, rest = rest, None
        held = _settled(front)
        holding = held if holding is None else holding.unionByName(held)
        if rest is None:
            break
        took = held.groupBy(*_KEYS).agg(F.sum("qty").alias("took"))
        rest = _able(rest.join(took, _KEYS, "left").withColumn("free", F.col("free") - F.coalesce("took", F.lit(0))).drop("took"))
        size *= GROWTH

    holders = holding.where(F.col("resource") == "confirmation").select("request_id", F.col("key").alias("confirmation"))
    told_held = demands.join(holders.select("request_id", F.lit(True).alias("held")), "request_id", "left").fillna(False, ["held"])
    taken = running(told_held, _KEYS, _ORDER, sums={"used": F.when(F.col("held"), F.col("qty")).otherwise(0)})
    short = F.col("free") - F.col("used") < F.col("qty")

    def lacks(resource: str) -> Column:
        return F.bool_or(short & (F.col("resource") == resource))

    reasons = taken.groupBy("request_id").agg(
        F.first("held").alias("held"), lacks("confirmation").alias("again"), lacks("chat").alias("full"), F.count_if(short & (F.col("resource") == "item")).alias("n_short")
    )
    holds = holders.withColumnRenamed("request_id", "hold_id")
    told = checked.join(reasons, "request_id", "left").join(holds, F.col("confirmation_id").cast("string") == F.col("confirmation"), "left")
    status = F.when(~F.col("good"), "invalid").when(F.col("held"), "held").when(F.col("again"), "existing").when(F.col("full"), "limit").otherwise("stock")
    return told.select(
        "request_id", status.alias("status"), F.when(status.isin("held", "existing"), F.col("hold_id")).alias("hold_id"), F.coalesce("n_short", F.lit(0)).alias("n_short")
    )


def _able(rows: DataFrame) -> DataFrame:
    """The rows, stored, of requests that ask for no more than is free anywhere."""
    beyond = rows.where(F.col("free") < F.col("qty")).select("request_id").distinct()
    return stored(rows.join(beyond, "request_id", "left_anti"), "able")


def _settled(rows: DataFrame) -> DataFrame:
    """resource, key, request_id, qty of the requests held, when nothing was taken before these rows."""
    spark, folder, rounds = rows.sparkSession, run_dir(rows.sparkSession, "holds"), []
    rows = rows.withColumn("state", F.lit(_OPEN))
    while True:
        path = f"{folder}/round={len(rounds)}"
        tightened = _round(rows)
        tightened.write.parquet(path)
        rounds.append(spark.read.schema(tightened.schema).parquet(path))
        rows = rounds[-1].where(F.col("state") != _REFUSED).drop("settled")
        busy = rows.where(F.col("state") == _OPEN).select(*_KEYS).distinct()
        if busy.isEmpty():
            break
        rows = rows.join(busy, _KEYS, "left_semi")
    held = None
    for done in rounds:
        part = done.where(F.col("settled") & (F.col("state") == _HELD)).select(*_KEYS, "request_id", "qty")
        held = part if held is None else held.unionByName(part)
    return stored(held, "held")


def _round(rows: DataFrame) -> DataFrame:
    """One tightening of the bounds: new states, and whether this round settled the row."""
    held = F.col("state") == _HELD
    bounded = running(rows, _KEYS, _ORDER, sums={"least": F.when(held, F.col("qty")).otherwise(0), "most": F.col("qty")})
    fits, fails = F.col("free") - F.col("most") >= F.col("qty"), F.col("free") - F.col("least") < F.col("qty")
    votes = bounded.where(~held).groupBy("request_id").agg(F.bool_and(fits).alias("fits"), F.bool_or(fails).alias("fails"))
    verdict = F.when(F.col("fits"), _HELD).when(F.col("fails"), _REFUSED).otherwise(_OPEN)
    open_rows = rows.where(~held).join(votes, "request_id").withColumn("state", verdict).drop("fits", "fails")
    return open_rows.withColumn("settled", F.col("state") != _OPEN).unionByName(rows.where(held).withColumn("settled", F.lit(False)))
