"""Sends of unknown fate, settled by what the conversation shows afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partsight.operators.ordered import dealt, running

#: A message may be this much older than its send says, for clocks that differ.
TOLERANCE_SECONDS = 5


def sent_hash(kind: Column, text: Column) -> Column:
    """What a sent text is recognised by: its digest in lower case, blanks run together; images have none."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[ \\t\\r\\n]+", " "))
    return F.when(kind == "image", "").otherwise(F.sha2(plain, 256))


def reconcile_sends(
    sends: DataFrame, messages: DataFrame, assigned: DataFrame, own_id: int, tolerance_seconds: int = TOLERANCE_SECONDS
) -> DataFrame:
    """Each unknown send with the message that shows it: outbox_id, chat_id, status, message_id, sent_at.

    ``sends``: outbox_id, chat_id, kind, text, intent_at, created_at. ``messages``: message_id, chat_id,
    author_id, kind, text, created_at. ``assigned``: the message_ids that other sends hold already.

    A message can stand for a send of the same chat and kind, with the same text but for case and blanks
    (images match by order and number alone), that was meant at or before it, tolerance included. Without
    an intent the send's creation is its bound. Every message stands for one send at most. Sends wait in
    the order of their bounds (ties by outbox_id) and messages, in the order of their times (ties by
    message_id), each take the one that waits longest. As the messages a send may take are all those from
    its bound on, no other assignment settles more sends.

    The waiting line is not replayed. A message finds nobody waiting exactly when the surplus of messages
    over sends reaches a new maximum; what is left of the messages meets the sends by number. That takes
    running sums and a running maximum, which are carried over partitions, so one chat and text may hold
    most rows. Sends without chat, kind or bound, and those without a message, are ``needs_owner``;
    messages without chat, kind or time take no part. Message ids are unique; outbox ids too.
    """
    bound = F.coalesce("intent_at", "created_at") - F.expr(f"INTERVAL {int(tolerance_seconds)} SECOND")
    keys, order = ["chat_id", "kind", "hash"], ["at", "side", "id"]
    asked = sends.select("chat_id", "kind", sent_hash(F.col("kind"), F.col("text")).alias("hash"), bound.alias("at"), F.lit(0).alias("side"), F.col("outbox_id").alias("id"))
    own = messages.where(F.col("author_id") == own_id).join(assigned.select("message_id"), "message_id", "left_anti")
    shown = own.select("chat_id", "kind", sent_hash(F.col("kind"), F.col("text")).alias("hash"), F.col("created_at").alias("at"), F.lit(1).alias("side"), F.col("message_id").alias("id"))
    whole = F.col("chat_id").isNotNull() & F.col("kind").isNotNull() & F.col("at").isNotNull()

    side = F.col("side")
    events = dealt(asked.unionByName(shown).where(whole), keys, order, "reconcile")
    counted = running(events, keys, order, sums={"sends": 1 - side, "shown": side})
    counted = counted.withColumns({"sends": F.col("sends") + 1 - side, "shown": F.col("shown") + side})
    surplus = F.col("shown") - F.col("sends")
    waited = running(counted, keys, order, maxima={"idle": surplus}).withColumn("idle", F.greatest(F.col("idle"), F.lit(0)))
    taken = waited.where((side == 1) & (surplus <= F.col("idle"))).select(
        *keys, (F.col("shown") - F.col("idle")).alias("no"), F.col("id").alias("message_id"), F.col("at").alias("sent_at")
    )
    found = waited.where(side == 0).select(*keys, F.col("sends").alias("no"), F.col("id").alias("outbox_id")).join(taken, [*keys, "no"], "left")
    unbound = asked.where(~whole).select(
        F.col("id").alias("outbox_id"), "chat_id", F.lit(None).cast(messages.schema["message_id"].dataType).alias("message_id"), F.lit(None).cast("timestamp").alias("sent_at")
    )
    settled = found.select("outbox_id", "chat_id", "message_id", "sent_at").unionByName(unbound)
    return settled.withColumn("status", F.when(F.col("message_id").isNotNull(), "sent").otherwise("needs_owner"))
