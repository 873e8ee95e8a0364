"""The order of records that each carry the state they found and the state they left, by parallel list ranking."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.session import cut_lineage, drop_stored

#: Records whose numbers agree but for so many last bits are linked inside one task.
BLOCK_BITS = 16
#: How a chain ends; records with an end of NULL go on to the record before them.
STATUSES = {1: "ORDERED", 2: "BRANCHED", 3: "BROKEN", 4: "CYCLIC"}
ORDERED, BRANCHED, BROKEN, CYCLIC = STATUSES


def causal_order(records: DataFrame, keys: Sequence[str], record_id: str, before: Sequence[Column], after: Sequence[Column], start: Sequence[Column]) -> DataFrame:
    """``records`` with ``ordinal`` (from 1, NULL where there is no order) and ``chain_status``.

    A record follows the one that left the state it found (``before`` = ``after``, per ``keys``); the first one found ``start``. Statuses:
    ORDERED; BRANCHED where a state was left or found by several records, or behind such a place; BROKEN where the chain does not
    lead back to the start; CYCLIC where it leads back to itself. ``record_id`` is unique per key.

    Records are stored with a number, and one aggregation over the states gives each its predecessor's number. Inside blocks of 2^16
    consecutive numbers chains are followed at once; only the first record of each stretch takes part in pointer doubling between
    blocks, where after r rounds it knows the stretch 2^r back. Input that lies roughly in the order of its chains leaves few stretches;
    any other gives the same result with more of them.
    """

    def in_block(block: pd.DataFrame) -> pd.DataFrame:
        """The first record of each record's chain inside the block, and how many steps it lies back. Of that first one also where it goes
        on (``next``) or how it ends (``end``, 0 if it does not)."""
        block = block.sort_values("no", ignore_index=True)
        no, to, end = (block[c].to_numpy(np.int64) for c in ("no", "to", "end"))
        at = np.minimum(np.searchsorted(no, to), len(no) - 1)
        here = (end == 0) & (no[at] == to)
        own = np.arange(len(no))
        head, back = np.where(here, at, own), here.astype(np.int64)
        for _ in range(len(no).bit_length()):
            back = back + back[head]
            head = head[head]
        ring = here[head]
        head, back, end = np.where(ring, own, head), np.where(ring, 0, back), np.where(ring, CYCLIC, end)
        return pd.DataFrame({"no": no, "head": no[head], "back": back, "next": np.where(end == 0, to, -1), "end": end.astype(np.int8)})

    numbered = cut_lineage(records.withColumn("_no", F.monotonically_increasing_id()))
    found = F.struct(*[c.alias(f"s{i}") for i, c in enumerate(before)])
    left = F.struct(*[c.alias(f"s{i}") for i, c in enumerate(after)])
    opening = F.struct(*[c.alias(f"s{i}") for i, c in enumerate(start)])
    none = F.lit(None).cast("long")
    seen = numbered.select(*keys, found.alias("_state"), F.col("_no").alias("_finder"), none.alias("_leaver"))
    seen = seen.unionAll(numbered.select(*keys, left.alias("_state"), none.alias("_finder"), F.col("_no").alias("_leaver")))
    states = seen.groupBy(*keys, "_state").agg(
        F.count("_finder").alias("_finders"), F.min("_finder").alias("no"), F.count("_leaver").alias("_leavers"), F.min("_leaver").alias("to")
    )
    # The start may be found by one record only, and nobody may have left it for another chain to follow.
    end = F.when(F.col("_state") == opening, ORDERED).when(F.col("_leavers") == 0, BROKEN).when(F.col("_leavers") > 1, BRANCHED).otherwise(0)
    # Records that share the state they found are BRANCHED and have no row here.
    links = states.filter("_finders = 1").select("no", F.coalesce("to", F.lit(-1)).alias("to"), end.cast("byte").alias("end"))
    local = links.groupBy(F.shiftright("no", BLOCK_BITS)).applyInPandas(in_block, "no long, head long, back long, next long, end byte")
    local = cut_lineage(local)
    place = local.select(F.col("no").alias("next"), F.col("head").alias("_to"), (F.col("back") + 1).alias("_steps"))
    first = local.filter("no = head")
    ended = first.filter("end > 0").select("head", F.col("end").alias("_end"), none.alias("_to"), F.lit(1).cast("long").alias("_steps"))
    moving = first.filter("end = 0").select("head", "next").join(place, "next", "left")
    going = moving.select("head", F.when(F.col("_to").isNull(), BRANCHED).cast("byte").alias("_end"), "_to", F.coalesce("_steps", F.lit(1)).alias("_steps"))
    chains = cut_lineage(ended.unionByName(going))
    open_before = None
    # Every round settles some stretch as long as one leads to an end; what is left then are rings.
    while (open_now := chains.filter(F.col("_to").isNotNull()).count()) and open_now != open_before:
        open_before = open_now
        back = chains.select(F.col("head").alias("_to"), F.col("_end").alias("_b_end"), F.col("_to").alias("_b_to"), F.col("_steps").alias("_b_steps"))
        ahead = chains.filter(F.col("_to").isNotNull()).drop("_end").join(back, "_to")
        moved = ahead.select("head", F.col("_b_end").alias("_end"), F.col("_b_to").alias("_to"), (F.col("_steps") + F.col("_b_steps")).alias("_steps"))
        done, chains = chains, cut_lineage(chains.filter(F.col("_to").isNull()).unionByName(moved))
        drop_stored(done)
    final = F.when(F.col("_to").isNotNull(), CYCLIC).otherwise(F.col("_end"))
    ranked = local.select("no", "head", "back").join(chains, "head").select(F.col("no").alias("_no"), final.alias("_end"), F.when(final == ORDERED, F.col("back") + F.col("_steps")).alias("ordinal"))
    status = F.lit(STATUSES[BRANCHED])
    for code, text in STATUSES.items():
        status = F.when(F.col("_end") == code, text).otherwise(status)
    return numbered.join(ranked, "_no", "left").withColumn("chain_status", status).select(*records.columns, "ordinal", "chain_status")
