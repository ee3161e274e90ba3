"""Search, freshness, read status and claims.

Time is always the ``as_of`` argument. "Unknown" is a state of its own and never the result of a
NULL comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partsight.functions.keys import oem_key, sku_key, title_key
from partsight.operators.joins import shuffled
from partsight.operators.ordered import stored

STOCK_MAX_AGE = "INTERVAL '15' MINUTE"
PRICE_MAX_AGE = "INTERVAL '15' MINUTE"


def is_fresh(fetched_at: Column, as_of: Column, max_age: str) -> Column:
    """Not from the future and not older than ``max_age`` (interval text)."""
    return (fetched_at <= as_of) & (fetched_at >= as_of - F.expr(max_age))


def read_status(
    requests: DataFrame, facts: DataFrame, as_of: Column, max_age: str, absent: str
) -> DataFrame:
    """Every request gets ``fresh``, ``stale``, ``unavailable`` or ``not_found``.

    ``requests`` holds ``sku`` and ``health``; ``facts`` is one row per SKU with ``fetched_at``
    (NULL when the SKU is known but the fact is not) and a ``known`` flag.
    """
    joined = requests.withColumn("sku_key", sku_key(F.col("sku"))).join(
        facts.withColumn("sku_key", sku_key(F.col("sku"))).drop("sku"), "sku_key", "left"
    )
    down = F.col("health") == "down"
    found = F.coalesce("known", F.lit(False))
    fresh = is_fresh(F.col("fetched_at"), as_of, max_age)
    return joined.withColumns(
        {
            "read_status": F.when(down, "unavailable")
            .when(~found | F.col("fetched_at").isNull(), "not_found")
            .when(fresh, "fresh")
            .otherwise("stale"),
            "reason": F.when(down, "connection_down")
            .when(~found, "unknown_sku")
            .when(F.col("fetched_at").isNull(), absent),
        }
    )


def _gate() -> Column:
    """D05, over ``health``, ``read_status`` and ``reason``: why no claim may be made."""
    why = F.coalesce("reason", F.lit("unknown"))
    return F.when(F.col("health") == "down", F.concat(F.lit("inventory_down:"), why)).when(
        F.col("read_status") != "fresh", F.concat(F.lit("read_"), F.col("read_status"), F.lit(":"), why)
    )


def stock_totals(stock: DataFrame) -> DataFrame:
    """Summed availability and the oldest fetch per SKU, with partial aggregation."""
    return stock.groupBy("sku").agg(
        F.sum("available_qty").alias("available_qty"), F.min("fetched_at").alias("stock_fetched_at")
    )


def availability_claims(
    requests: DataFrame, products: DataFrame, stock: DataFrame, as_of: Column,
    max_age: str = STOCK_MAX_AGE,
) -> DataFrame:
    """D05 + D06: the only way to an availability statement. A known SKU without a stock line is
    "not available" as of the read itself."""
    facts = (
        products.select("sku")
        .join(stock_totals(stock), "sku", "left")
        .withColumns(
            {"known": F.lit(True), "fetched_at": F.coalesce(F.col("stock_fetched_at"), as_of)}
        )
    )
    reads = read_status(requests, facts, as_of, max_age, "no_stock")
    blocked = _gate()
    qty = F.coalesce("available_qty", F.lit(0))
    return reads.withColumn("blocked", blocked).select(
        "request_id", "sku_key", "read_status",
        F.when(F.col("blocked").isNotNull(), "unknown")
        .when(qty > 0, "available").otherwise("not_available").alias("status"),
        F.when(F.col("blocked").isNull(), F.greatest(qty, F.lit(0))).alias("sellable_qty"),
        F.when(F.col("blocked").isNotNull(), F.col("blocked"))
        .when(qty <= 0, "no_sellable_stock").alias("reason"),
        F.when(F.col("blocked").isNull(), F.col("fetched_at")).alias("as_of"),
    )


def price_claims(
    requests: DataFrame, products: DataFrame, prices: DataFrame, as_of: Column,
    max_age: str = PRICE_MAX_AGE,
) -> DataFrame:
    """An exact price only when the gate passes and a price exists."""
    facts = products.select("sku", F.lit(True).alias("known")).join(prices, "sku", "left")
    reads = read_status(requests, facts, as_of, max_age, "no_price").withColumn("blocked", _gate())
    ok = F.col("blocked").isNull()
    return reads.select(
        "request_id", "sku_key",
        F.when(ok, "exact").otherwise("unknown").alias("status"),
        F.when(ok, F.col("amount_minor")).alias("amount_minor"),
        F.when(ok, F.col("currency")).alias("currency"),
        F.col("blocked").alias("reason"),
        F.when(ok, F.col("fetched_at")).alias("as_of"),
    )


def item_snapshots(
    requests: DataFrame, products: DataFrame, stock: DataFrame, prices: DataFrame, as_of: Column,
    max_age: str = STOCK_MAX_AGE,
) -> DataFrame:
    """Product, stock summary and price of each requested item with one read status.

    The stock lines themselves stay rows (``stock_lines_of``); here are their counts and sums.
    """
    totals = stock.groupBy("sku").agg(
        F.count(F.lit(1)).alias("stock_lines"),
        F.sum("physical_qty").alias("physical_qty"),
        F.sum("available_qty").alias("available_qty"),
        F.min("stock_ref").alias("first_stock_ref"),
        F.min("fetched_at").alias("stock_at"),
    )
    price = prices.select("sku", "amount_minor", "currency", F.col("fetched_at").alias("price_at"))
    facts = (
        products.select("sku", "title")
        .join(totals, "sku", "left")
        .join(price, "sku", "left")
        .withColumns(
            {
                "known": F.lit(True),
                "fetched_at": F.coalesce(F.least("stock_at", "price_at"), as_of),
            }
        )
    )
    return read_status(requests, facts, as_of, max_age, "no_item")


def stock_photos(stock: DataFrame, photos: DataFrame) -> DataFrame:
    """Photos that belong to a stock line, with their place in (stock_ref, sort_order)."""
    lines = stock.select("stock_ref", "sku")
    return photos.join(lines, "stock_ref")


def source_health(log: DataFrame, as_of: Column, stale_after: str, slow_over_s: float) -> DataFrame:
    """Up / degraded / down per source from its fetch log, with the last success."""
    ok = F.col("error").isNull()
    last = F.struct("ts", "fetch_id")
    seen = log.where(F.col("ts") <= as_of)
    rolled = seen.groupBy("source").agg(
        F.max_by(F.coalesce("error", F.lit("")), last).alias("last_error"),
        F.max_by("duration_s", last).alias("last_duration"),
        F.max(F.when(ok, F.col("ts"))).alias("last_success_at"),
    )
    failed = F.col("last_error") != ""
    stale = F.col("last_success_at").isNull() | (
        F.col("last_success_at") < as_of - F.expr(stale_after)
    )
    slow = F.col("last_duration") > slow_over_s
    return rolled.select(
        "source",
        F.when(failed, "down").when(stale | slow, "degraded").otherwise("up").alias("status"),
        F.when(failed, F.col("last_error")).when(stale, "stale_data").when(slow, "slow").alias(
            "reason"
        ),
        "last_success_at",
    )


def offer_totals(lines: DataFrame, claims: DataFrame) -> DataFrame:
    """Integer total per offer and currency; NULL as soon as one line has no exact price."""
    c = claims.select(F.col("sku_key"), F.col("status").alias("price_status"), "amount_minor",
                      "currency")
    joined = lines.withColumn("sku_key", sku_key(F.col("sku"))).join(c, "sku_key", "left")
    exact = F.coalesce(F.col("price_status") == "exact", F.lit(False))
    rolled = joined.groupBy("offer_id").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if(~exact).alias("n_unknown"),
        F.sum(F.col("qty") * F.col("amount_minor")).alias("known_minor"),
        F.min("currency").alias("c1"),
        F.max("currency").alias("c2"),
    )
    one = (F.col("n_unknown") == 0) & (F.col("c1") == F.col("c2"))
    return rolled.select(
        "offer_id", "n_lines", "n_unknown",
        F.when(one, F.col("known_minor")).alias("total_minor"),
        F.when(one, F.col("c1")).alias("currency"),
    )


# ----------------------------------------------------------------------------------------------
# Search
# ----------------------------------------------------------------------------------------------

_VEHICLE = ("make", "model", "chassis_code")
#: Parts into which the products are dealt for requests that no key joins with them.
_DEALT = 64


def _applicable_specs(requests: DataFrame, fitments: DataFrame) -> DataFrame:
    """(spec request, sku) pairs of catalogue applicability. Joined per set of given attributes, so
    each join is an equi-join on exactly the attributes the request names."""
    specs = fitments.select("sku", *[title_key(F.col(a)).alias(a) for a in _VEHICLE]).distinct()
    wanted = requests.select(*[f"q_{a}" for a in _VEHICLE]).distinct()
    found = None
    for mask in range(1, 8):
        given = [a for i, a in enumerate(_VEHICLE) if mask >> i & 1]
        rest = [a for a in _VEHICLE if a not in given]
        some = wanted
        for a in given:
            some = some.where(F.col(f"q_{a}").isNotNull())
        for a in rest:
            some = some.where(F.col(f"q_{a}").isNull())
        keys = specs.select("sku", *given).distinct()
        hit = some.join(shuffled(keys), [F.col(f"q_{a}") == F.col(a) for a in given]).select(
            *[f"q_{a}" for a in _VEHICLE], "sku"
        )
        found = hit if found is None else found.unionByName(hit)
    return found


def vehicle_basis(pairs: DataFrame, fitments: DataFrame) -> DataFrame:
    """For (query, product) pairs, do the given vehicle attributes agree with a catalogue
    record of the product, and does its title name the chassis code?

    ``pairs`` carries ``sku_product``, ``title`` and the keyed attributes ``q_make`` ...; records and
    what is asked of a product are reduced to distinct rows first, so neither the key of a request nor a
    null in it or in a record's other attributes decides.
    """
    attrs = [f"q_{a}" for a in _VEHICLE]
    keys = [*attrs, "sku_product"]
    specs = fitments.select(
        F.col("sku").alias("sku_product"), *[title_key(F.col(a)).alias(f"s_{a}") for a in _VEHICLE]
    ).distinct()
    agrees = None
    for a in _VEHICLE:
        one = F.col(f"q_{a}").isNull() | (F.col(f"q_{a}") == F.col(f"s_{a}"))
        agrees = one if agrees is None else agrees & one
    given = F.coalesce(*attrs).isNotNull()
    met = (
        pairs.where(given).select(*keys).distinct()
        .join(shuffled(specs), "sku_product").where(agrees)
        .select(*[F.col(k).alias(f"met_{k}") for k in keys]).distinct().withColumn("in_catalog", F.lit(True))
    )
    same = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"met_{k}"))
        same = one if same is None else same & one
    return pairs.join(shuffled(met), same, "left").drop(*[f"met_{k}" for k in keys]).withColumns(
        {
            "vehicle_given": given,
            "catalog_applicability": F.coalesce("in_catalog", F.lit(False)),
            "title_mention": F.coalesce(
                F.contains(title_key(F.col("title")), F.col("q_chassis_code")), F.lit(False)
            ),
        }
    )


def search_products(
    requests: DataFrame, products: DataFrame, oems: DataFrame, fitments: DataFrame
) -> DataFrame:
    """AND of the given criteria; every hit says why (``match_basis``).

    Requests with an SKU or a part number start from an equi-join on that key; the remaining
    criteria filter the few pairs it leaves. Requests that name a vehicle only start from the
    catalogue applicability join and the title substrings (``title_mentions``). Requests with nothing
    but a part type start from it; those without any criterion, or with a chassis code of no letter or
    digit, which every title contains, meet every product.
    """
    # Stored, as every branch below starts from the requests: the plan would hold them dozens of times.
    q = stored(requests.select(
        "query_id",
        sku_key(F.col("sku")).alias("q_sku"),
        oem_key(F.col("oem_number")).alias("q_oem"),
        *[title_key(F.col(a)).alias(f"q_{a}") for a in _VEHICLE],
        F.col("part_type").alias("q_part_type"),
    ), "requests")
    p = products.select(
        F.col("sku").alias("sku_product"), sku_key(F.col("sku")).alias("p_sku"), "title", "part_type"
    )
    keys = oems.select(
        F.col("sku").alias("sku_product"), oem_key(F.col("oem_number")).alias("p_oem")
    ).distinct()

    by_sku = q.where(F.col("q_sku").isNotNull()).join(shuffled(p), F.col("q_sku") == F.col("p_sku"))
    also = by_sku.where(F.col("q_oem").isNotNull()).join(
        shuffled(keys.withColumnRenamed("p_oem", "q_oem")), ["sku_product", "q_oem"], "left_semi"
    )
    first = by_sku.where(F.col("q_oem").isNull()).unionByName(also.select(*by_sku.columns))
    by_oem = (
        q.where(F.col("q_sku").isNull() & F.col("q_oem").isNotNull())
        .join(shuffled(keys), F.col("q_oem") == F.col("p_oem"))
        .join(shuffled(p), "sku_product")
        .select(*by_sku.columns)
    )
    attrs = [f"q_{a}" for a in _VEHICLE]
    keyless = q.where(F.col("q_sku").isNull() & F.col("q_oem").isNull())
    anywhere = F.coalesce(*attrs).isNull() | F.coalesce(F.col("q_chassis_code") == "", F.lit(False))
    only, unnamed = keyless.where(~anywhere), keyless.where(anywhere)
    applicable = _applicable_specs(only, fitments).withColumnRenamed("sku", "sku_product")
    named = title_mentions(only, p)
    start = applicable.where(F.col("sku_product").isNotNull()).unionByName(named.select(*attrs, "sku_product")).distinct()
    same = None
    for a in attrs:
        one = F.col(f"o.{a}").eqNullSafe(F.col(f"s.{a}"))
        same = one if same is None else same & one
    by_vehicle = (
        only.alias("o").join(shuffled(start).alias("s"), same).select("o.*", F.col("s.sku_product").alias("start_sku"))
        .join(shuffled(p), F.col("start_sku").eqNullSafe(F.col("sku_product"))).select(*by_sku.columns)
    )
    by_type = unnamed.join(shuffled(p), F.col("q_part_type") == F.col("part_type")).select(*by_sku.columns)
    # Every request meets every product: an equi-join on the part that a product is dealt to.
    everywhere = unnamed.where(F.col("q_part_type").isNull()).withColumn("dealt", F.explode(F.sequence(F.lit(0), F.lit(_DEALT - 1))))
    dealt = p.withColumn("dealt", F.pmod(F.hash("sku_product", "title"), F.lit(_DEALT)))
    by_all = everywhere.join(shuffled(dealt), "dealt").select(*by_sku.columns)
    pairs = first.unionByName(by_oem).unionByName(by_vehicle).unionByName(by_type).unionByName(by_all)
    pairs = stored(pairs.where(F.col("q_part_type").isNull() | (F.col("q_part_type") == F.col("part_type"))), "pairs")
    judged = vehicle_basis(pairs, fitments)
    hits = judged.where(
        ~F.col("vehicle_given") | F.col("catalog_applicability") | F.col("title_mention")
    )
    basis = F.array_compact(
        F.array(
            F.when(F.col("q_sku").isNotNull(), "sku"),
            F.when(F.col("q_oem").isNotNull(), "oem_number"),
            F.when(F.col("catalog_applicability"), "catalog_applicability"),
            F.when(F.col("title_mention"), "title_mention"),
        )
    )
    return hits.select("query_id", F.col("sku_product").alias("sku"), basis.alias("match_basis"))


def title_mentions(requests: DataFrame, products: DataFrame) -> DataFrame:
    """Products whose title contains a requested chassis code: titles are cut into substrings of
    the lengths the codes have and equi-joined, never compared pair by pair."""
    attrs = [f"q_{a}" for a in _VEHICLE]
    codes = requests.where(F.length("q_chassis_code") > 0).select(*attrs).distinct()
    # The few lengths the codes have; longer than any title means no match, so no bound is needed.
    lengths = codes.agg(F.collect_set(F.length("q_chassis_code")).alias("ns")).scalar()
    title = products.select("sku_product", title_key(F.col("title")).alias("t")).where(
        F.length("t") > 0
    )
    pieces = title.withColumn("ns", lengths).select(
        "sku_product",
        F.explode(
            F.array_distinct(
                F.flatten(
                    F.transform(
                        "ns",
                        lambda n: F.when(
                            F.length("t") >= n,
                            F.transform(
                                F.sequence(F.lit(1), F.length("t") - n + 1),
                                lambda i: F.substring(F.col("t"), i, n),
                            ),
                        ).otherwise(F.array().cast("array<string>")),
                    )
                )
            )
        ).alias("piece"),
    )
    return codes.join(shuffled(pieces), F.col("q_chassis_code") == F.col("piece")).select(
        *attrs, "sku_product"
    )
