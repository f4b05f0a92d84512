"""Filling containers of fixed capacity by refined harmonic classes, at most one text in several, little space left.

Plain harmonic packing (``harmonic``) puts a length into the class of its reciprocal share of the capacity and fills a class's
containers with a fixed number of texts: every worker places its texts by their rank alone. It may leave much of a container
empty, a third where most lengths are just over half the capacity. ``containers`` refines the classes: a length is rounded up to
one of ``GRID`` sizes of the capacity, a container is headed by as many texts of one size as its reciprocal allows, and what
is left of it takes a fixed number of texts of smaller sizes. How many containers of which mixture there are follows from the
number of texts of each size, at most ``GRID`` rows a capacity however many texts there are; it is planned on the driver, and
workers again place each text by its size and rank alone.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from codeloom.session import cut

MOST_CAPACITIES = 1_000
#: Sizes that a capacity is divided into; a text takes up less than one size more than it has, none where the capacity is smaller.
GRID = 4_096


def mixtures(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(containers, [(length, texts of it in each)]): what to fill, for the given number of texts of each length.

    The longest remaining length heads a container with as many of it as fit; the rest goes to the longest length that fits,
    as many of it as fit, and so on. The mixture is repeated as often as all its lengths last.
    """
    left = {s: n for s, n in counts.items() if n > 0 and 0 < s <= capacity}
    sizes, plan = sorted(left), []
    while sizes:
        room, parts, at = capacity, [], len(sizes)
        while at and room >= sizes[0]:
            at = min(at, bisect_right(sizes, room))
            if not at:
                break
            size = sizes[at - 1]
            each = min(room // size, left[size])
            parts.append((size, each))
            room -= size * each
            at -= 1
        times = min(left[s] // e for s, e in parts)
        plan.append((times, parts))
        for s, e in parts:
            left[s] -= e * times
        gone = {s for s, e in parts if left[s] == 0}
        if gone:
            sizes = [s for s in sizes if s not in gone]
    return plan


def _ranked(items: DataFrame, keys: list[str], salts: int) -> DataFrame:
    """``rank`` from 0 within the keys, in two steps, so that a frequent length is spread over ``salts`` tasks."""
    salted = items.withColumn("salt", F.pmod(F.xxhash64("doc_id", "part"), F.lit(salts)))
    local = salted.withColumn("n", F.row_number().over(Window.partitionBy(*keys, "salt").orderBy("doc_id", "part")) - 1)
    before = Window.partitionBy(*keys).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy(*keys, "salt").agg(F.count("*").alias("c")).select(*keys, "salt", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"))
    return local.join(offsets, [*keys, "salt"]).withColumn("rank", F.col("n") + F.col("offset")).drop("salt", "n", "offset")


def items_of(sizes: DataFrame, capacities: DataFrame) -> DataFrame:
    """(capacity_id, max_tokens, doc_id, part, first_token, tokens): what has to be placed.

    A text over the capacity becomes full parts and one with the rest; others are one part. Texts without tokens need no
    place and are left out, as are rows without doc_id; capacities must be 1 or more, others are ignored.
    """
    rows = capacities.where("max_tokens >= 1 and capacity_id is not null").select("capacity_id", F.col("max_tokens").cast("long")).distinct().limit(MOST_CAPACITIES + 1).collect()
    if len(rows) > MOST_CAPACITIES:
        raise ValueError(f"at most {MOST_CAPACITIES} capacities")
    options = F.array(*[F.struct(F.lit(r[0]).alias("capacity_id"), F.lit(r[1]).alias("max_tokens")) for r in rows]) if rows else F.expr("cast(array() as array<struct<capacity_id: string, max_tokens: bigint>>)")
    each = sizes.where("tokens > 0 and doc_id is not null").select("doc_id", "tokens", F.explode(options).alias("o")).select("doc_id", F.col("tokens").alias("total"), "o.*")
    parts = F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / F.col("max_tokens")).cast("long"))
    placed = each.select("*", F.explode(parts).alias("part"))
    return placed.select(
        "capacity_id", "max_tokens", "doc_id", "part", (F.col("part") * F.col("max_tokens")).alias("first_token"),
        F.least(F.col("max_tokens"), F.col("total") - F.col("part") * F.col("max_tokens")).alias("tokens"),
    )


def harmonic(sizes: DataFrame, capacities: DataFrame, salts: int = 64) -> DataFrame:
    """Plain harmonic packing: (capacity_id, container, doc_id, part, first_token, tokens).

    A container is named by its class and number; its class k, the floor of capacity over length, is also its text count.
    """
    items = items_of(sizes, capacities).withColumn("class", F.floor(F.col("max_tokens") / F.col("tokens")))
    ranked = _ranked(cut(items), ["capacity_id", "class"], salts)
    name = F.concat_ws("-", F.col("class"), F.floor(F.col("rank") / F.col("class")))
    return ranked.select("capacity_id", name.alias("container"), "doc_id", "part", "first_token", "tokens")


def containers(sizes: DataFrame, capacities: DataFrame, salts: int = 64) -> DataFrame:
    """(capacity_id, container, doc_id, part, first_token, tokens): every text in a numbered container of every capacity."""
    spark: SparkSession = sizes.sparkSession
    unit = F.ceil(F.col("max_tokens") / GRID)
    room = F.floor(F.col("max_tokens") / unit)
    items = cut(items_of(sizes, capacities).withColumn("room", room).withColumn("size", F.least(F.ceil(F.col("tokens") / unit), room)))
    histogram = items.groupBy("capacity_id", "room", "size").agg(F.count("*").alias("n")).collect()  # at most GRID rows a capacity
    by_capacity: dict[tuple[str, int], dict[int, int]] = defaultdict(dict)
    for row in histogram:
        by_capacity[row["capacity_id"], row["room"]][row["size"]] = row["n"]
    rules: dict[tuple[str, int, int], list[tuple[int, int, int, int]]] = defaultdict(list)
    for (name, capacity), counts in by_capacity.items():
        used: dict[int, int] = defaultdict(int)
        base = 0
        for times, parts in mixtures(counts, capacity):
            for size, each in parts:
                rules[name, capacity, size].append((used[size], used[size] + each * times, each, base))
                used[size] += each * times
            base += times
    schema = "capacity_id string, room bigint, size bigint, rules array<struct<low: bigint, high: bigint, each: bigint, base: bigint>>"
    table = spark.createDataFrame([(*key, r) for key, r in rules.items()], schema)
    key = ["capacity_id", "room", "size"]
    ranked = _ranked(items, key, salts).join(table, key)
    mine = F.filter("rules", lambda r: (F.col("rank") >= r["low"]) & (F.col("rank") < r["high"]))[0]
    return ranked.select("*", mine.alias("rule")).select(
        "capacity_id", (F.col("rule.base") + F.floor((F.col("rank") - F.col("rule.low")) / F.col("rule.each"))).alias("container"), "doc_id", "part", "first_token", "tokens"
    )
