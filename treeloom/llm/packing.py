"""Mixture-controlled packing of items into containers of fixed capacity.

Every source is a queue in a fixed pseudo-random order.  Deficit round-robin over the queues fills
windows: in each window a source may send its quantum - the window's size times its target share -
plus the deficit left from the windows before.  As the allowance after w windows is w quanta in all,
the item that ends at token c of its queue leaves in window ceil(c / quantum), whatever came
between: the rounds have a closed form, so that running sums over the queues place all items at once
and deficits carry over windows and partitions exactly.  The items of each window are then packed by
best fit, largest first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeloom.session import BROADCAST_ROWS, write_table

#: Containers' worth of tokens in a window: bounds what one task packs, and the share of half-filled last containers.
WINDOW_CONTAINERS = 512
#: Items of a queue whose running sum one task computes.
BUCKET_ROWS = 50_000
_CONTAINER_BITS = 21


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item: largest first, into the fullest container that has room.

    Containers with the same room wait in one list; a bit mask of the rooms in use gives the
    smallest sufficient one.
    """
    order = np.argsort(-sizes, kind="stable")
    number = np.empty(len(sizes), np.int64)
    waiting: dict[int, list[int]] = {}
    mask, used = 0, 0
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        fitting = mask >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            held = waiting[room]
            k = held.pop()
            if not held:
                mask &= ~(1 << room)
                del waiting[room]
        else:
            room, k = capacity, used
            used += 1
        number[i] = k
        left = room - size
        if left:
            waiting.setdefault(left, []).append(k)
            mask |= 1 << left
    return number


def target_shares(items: DataFrame, source: str, size: str, shares: dict[str, float] | None = None) -> DataFrame:
    """(source, tokens, share): the target proportion of each source's tokens in every window.

    ``shares`` names proportions, normalised over the sources that are there; sources not named share what their tokens are of all
    tokens, and the named ones the rest.  By default all sources have their natural share.  Null is a source of its own.
    """
    sized = items.filter(F.col(size) > 0).groupBy(F.col(source).cast("string").alias("source")).agg(F.sum(F.col(size).cast("bigint")).alias("tokens"))
    named = [(str(s), float(x)) for s, x in (shares or {}).items() if x > 0]
    asked = items.sparkSession.createDataFrame(named, "source string, asked double")  # a parameter's entries
    told = sized.join(F.broadcast(asked), "source", "left")
    whole = told.agg(F.sum("tokens").alias("every"), F.sum(F.when(F.col("asked").isNull(), F.col("tokens"))).alias("free"), F.sum("asked").alias("scale")).first()
    every, free, scale = (float(whole[c] or 0) for c in ("every", "free", "scale"))
    rest = F.col("asked") / F.lit(scale or 1.0) * F.lit(1 - free / max(every, 1))
    return told.select("source", "tokens", F.when(F.col("asked").isNull(), F.col("tokens") / F.lit(max(every, 1.0))).otherwise(rest).alias("share"))


def pack(items: DataFrame, key: str, source: str, size: str, capacities: DataFrame, shares: dict[str, float] | None = None, window_containers: int = WINDOW_CONTAINERS) -> DataFrame:
    """Assign items to containers of each capacity.

    ``items``: one row per item with its source (null is a source of its own) and size; ``capacities``: (name,
    capacity), a small table; ``shares``: see :func:`target_shares`.  Output, one row
    per piece: name, key, source, piece_no (from 0), piece_begin, piece_size, window, container_id.

    * An item above the capacity - no other - is split into pieces of the capacity and a rest.
    * Items of size 0 or null, and null keys, take no space: one row with piece_size 0 and null window and container.
    * Capacities that are null or not positive are left out.  Repeated keys are separate items.
    * A source whose tokens are used up sends nothing more: later windows hold the quanta of the others, and
      :func:`mixture` tells where each queue ends.
    """
    base, _ = write_table(items.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("bigint").alias("size")), "items")
    caps = F.broadcast(capacities.select("name", F.col("capacity").cast("bigint").alias("capacity")).filter("capacity > 0 and name is not null"))  # a table of settings: a few rows
    each = base.crossJoin(caps)  # items times a handful of capacities
    idle = each.filter("size = 0 or key is null").select("name", "key", "source", F.lit(0).cast("bigint").alias("piece_no"), F.lit(0).cast("bigint").alias("piece_begin"), F.lit(0).cast("bigint").alias("piece_size"), F.lit(None).cast("bigint").alias("window"), F.lit(None).cast("bigint").alias("container_id"))
    full = base.filter("size > 0 and key is not null")
    busy = each.filter("size > 0 and key is not null").withColumn("piece_no", F.explode(F.expr("sequence(0L, (size - 1) div capacity)")))
    busy = busy.withColumn("piece_begin", F.col("piece_no") * F.col("capacity")).withColumn("piece_size", F.expr("least(capacity, size - piece_begin)"))
    quota, _ = write_table(target_shares(full, "source", "size", shares).select(F.col("source").alias("_q"), "share"), "quota")
    quota = F.broadcast(quota) if quota.count() <= BROADCAST_ROWS else quota
    n_rows = full.count()
    buckets = max(16, -(-n_rows // BUCKET_ROWS))
    busy = busy.withColumn("turn", F.xxhash64("key", F.lit(7))).withColumn("bucket", F.expr(f"pmod(shiftrightunsigned(turn, 20), {buckets})"))
    busy = busy.join(quota, busy.source.eqNullSafe(F.col("_q"))).drop("_q")
    sums = busy.groupBy("name", "source", "bucket").agg(F.sum("piece_size").alias("tokens"))
    before = Window.partitionBy("name", "source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offset = sums.withColumn("offset", F.coalesce(F.sum("tokens").over(before), F.lit(0))).select(F.col("name").alias("_n"), F.col("source").alias("_s"), F.col("bucket").alias("_b"), "offset")
    inside = Window.partitionBy("name", "source", "bucket").orderBy("turn", "key", "piece_no").rowsBetween(Window.unboundedPreceding, 0)
    placed = busy.withColumn("upto", F.sum("piece_size").over(inside))
    placed = placed.join(offset, (placed.name == offset._n) & placed.source.eqNullSafe(offset._s) & (placed.bucket == offset._b)).withColumn("upto", F.col("upto") + F.col("offset"))
    quantum = F.col("share") * F.col("capacity") * window_containers
    placed = placed.withColumn("window", (F.greatest(F.ceil(F.col("upto") / quantum), F.lit(1)) - 1).cast("bigint")).select("name", "key", "source", "capacity", "piece_no", "piece_begin", "piece_size", "window")

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["piece_size", "key", "piece_no"], ascending=[False, True, True], kind="stable")
        number = best_fit(pdf["piece_size"].to_numpy(), int(pdf["capacity"].iloc[0]))
        return pdf.assign(container_id=pdf["window"].to_numpy() * (1 << _CONTAINER_BITS) + number).drop(columns=["capacity"])

    kind = items.schema[key].dataType.simpleString()
    packed = placed.groupBy("name", "window").applyInPandas(fill, f"name string, key {kind}, source string, piece_no bigint, piece_begin bigint, piece_size bigint, window bigint, container_id bigint")
    return packed.unionByName(idle).withColumnRenamed("key", key)


def containers(assigned: DataFrame, capacities: DataFrame) -> DataFrame:
    """Per name: containers, pieces, tokens and the share of unused space."""
    caps = F.broadcast(capacities.select("name", "capacity"))
    told = assigned.filter("container_id is not null").groupBy("name").agg(F.countDistinct("container_id").alias("n_containers"), F.count("*").alias("n_pieces"), F.sum("piece_size").alias("n_tokens"))
    return told.join(caps, "name").select("name", "n_containers", "n_pieces", "n_tokens", (1 - F.col("n_tokens") / (F.col("n_containers") * F.col("capacity"))).alias("unused_share"))


def mixture(assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """Per name and source: target share, the last window its queue reaches, whether it ends before the others, and its least and greatest share of the tokens of a window.

    ``targets``: :func:`target_shares` of the same items and shares.  Shares of windows are told over those that all
    queues still fill; where the first window already empties a queue there are none, and they are null.
    """
    busy = assigned.filter("container_id is not null")
    cell = busy.groupBy("name", "window", "source").agg(F.sum("piece_size").alias("tokens"))
    ends = cell.groupBy("name", "source").agg(F.max("window").alias("last_window"))
    span = ends.groupBy("name").agg(F.min("last_window").alias("first_end"), F.max("last_window").alias("end"))
    whole = cell.groupBy("name", "window").agg(F.sum("tokens").alias("all_tokens"))
    rated = cell.join(whole, ["name", "window"]).join(F.broadcast(span), "name").filter("window < first_end")  # one row per capacity
    told = rated.groupBy("name", "source").agg(F.min(F.col("tokens") / F.col("all_tokens")).alias("least"), F.max(F.col("tokens") / F.col("all_tokens")).alias("most"))
    told = told.select(F.col("name").alias("_n"), F.col("source").alias("_s"), "least", "most")
    out = ends.join(F.broadcast(span), "name").join(told, (F.col("name") == F.col("_n")) & F.col("source").eqNullSafe(F.col("_s")), "left")
    out = out.join(targets.select(F.col("source").alias("_t"), "share"), F.col("source").eqNullSafe(F.col("_t")), "left")
    return out.select("name", F.coalesce("source", F.lit("")).alias("source"), "share", "last_window", (F.col("last_window") < F.col("end")).alias("ends_early"), "least", "most")


def faults(assigned: DataFrame, items: DataFrame, key: str, size: str, capacities: DataFrame) -> DataFrame:
    """Per name, what must be: number of items and tokens placed, and what must not: each of the other numbers is 0.

    ``n_overfull`` containers above the capacity, ``n_not_whole`` items whose pieces don't follow one another from 0 to the item's size,
    ``n_needless`` items that are split though they fit, ``n_lost`` items without a row.  Keys must be unique.
    """
    caps = F.broadcast(capacities.select("name", "capacity"))
    loads = assigned.filter("container_id is not null").groupBy("name", "container_id").agg(F.sum("piece_size").alias("load")).join(caps, "name").groupBy("name").agg(F.count_if(F.col("load") > F.col("capacity")).alias("n_overfull"))
    pieces = assigned.groupBy("name", key).agg(F.count("*").alias("n"), F.max("piece_no").alias("last"), F.sum("piece_size").alias("placed"), F.max(F.col("piece_begin") + F.col("piece_size")).alias("end"))
    sized = items.select(F.col(key).alias("_k"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("size"))
    both = sized.crossJoin(caps).join(pieces.withColumnRenamed("name", "_n"), (F.col("_k") == F.col(key)) & (F.col("name") == F.col("_n")), "left")  # items times a handful of capacities
    whole = (F.col("n") == F.col("last") + 1) & (F.col("placed") == F.col("size")) & (F.col("end") == F.col("size"))
    told = both.groupBy("name").agg(F.count("n").alias("n_items"), F.sum("placed").alias("n_tokens"), F.count_if(F.col("n").isNotNull() & ~whole).alias("n_not_whole"), F.count_if((F.col("n") > 1) & (F.col("size") <= F.col("capacity"))).alias("n_needless"), F.count_if(F.col("n").isNull()).alias("n_lost"))
    return told.join(loads, "name").select("name", "n_items", "n_tokens", "n_overfull", "n_not_whole", "n_needless", "n_lost")
