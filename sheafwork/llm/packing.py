"""Filling containers of fixed capacity: minimum bin slack over the multiset of remaining lengths.

A container is opened by the longest remaining length; a subset-sum dynamic programme over bit sets (one
big integer per step, bounded counts in binary parts) finds the multiset of remaining lengths that comes
closest to the capacity, and the counts are read back from the steps. A filling is repeated while its
lengths last. Documents are dealt by hash into shards of about SHARD, packed independently: every
shard leaves at most a few containers short, so the loss does not grow with the corpus.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, functions as F

SHARD = 20_000  #: documents packed together
MAX_PACKS = 1000  #: bound of the table of capacities read to the driver


def best_fill(room: int, counts: dict[int, int]) -> dict[int, int]:
    """Counts of lengths whose sum is as near to `room` as possible without exceeding it; longer lengths are preferred among equals."""
    full, mask, reach, steps = 1 << room, (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, part = min(counts[length], room // length), 1
        while left:
            take = min(part, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left, part = left - take, part * 2
        if reach & full:
            break
    at, used = reach.bit_length() - 1, Counter()
    for length, take, before in reversed(steps):
        if not (before >> at) & 1:
            used[length] += take
            at -= length * take
    return dict(used)


def fill_containers(lengths: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(counts of lengths, times) of all containers for a multiset of lengths between 1 and `capacity`."""
    left, out = dict(lengths), []
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        if not rest[longest]:
            del rest[longest]
        fill = Counter(best_fill(capacity - longest, rest) if capacity > longest else {})
        fill[longest] += 1
        times = min(left[x] // n for x, n in fill.items())
        out.append((dict(fill), times))
        for x, n in fill.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
    return out


def _pack_shard(rows: pd.DataFrame) -> pd.DataFrame:
    name, shard, capacity = rows["pack_name"].iloc[0], int(rows["shard"].iloc[0]), int(rows["capacity"].iloc[0])
    out, queue, number = [], {}, 0
    for doc, tokens in sorted(zip(rows["doc_id"], rows["tokens"])):
        piece = 0
        while tokens > capacity:  # only a text longer than a container is split
            out.append((name, shard, number, doc, piece, capacity))
            number, piece, tokens = number + 1, piece + 1, tokens - capacity
        queue.setdefault(int(tokens), []).append((doc, piece))
    for fill, times in fill_containers({x: len(q) for x, q in queue.items()}, capacity):
        for _ in range(times):
            for x, n in sorted(fill.items()):
                for _ in range(n):
                    doc, piece = queue[x].pop()
                    out.append((name, shard, number, doc, piece, x))
            number += 1
    return pd.DataFrame(out, columns=["pack_name", "shard", "container", "doc_id", "piece", "tokens"])


def pack(sizes: DataFrame, packs: DataFrame, shard: int = SHARD) -> DataFrame:
    """pack_name, shard, container (number within the shard), doc_id, piece, tokens: every document in containers of every pack.

    `sizes` has doc_id (unique) and tokens, `packs` pack_name and capacity_tokens. Documents of 0 tokens go
    nowhere; one that exceeds the capacity fills containers of its own and its rest is packed as an item.
    Capacities below 1 give nothing. An empty frame gives an empty result. Raises if there are more than MAX_PACKS packs.
    """
    full = sizes.where("tokens > 0")
    shards = max(1, -(-full.count() // shard))
    rooms = packs.where("capacity_tokens > 0").select("pack_name", "capacity_tokens").limit(MAX_PACKS + 1).collect()
    if len(rooms) > MAX_PACKS:
        raise ValueError(f"more than {MAX_PACKS} packs")
    each = F.array(*[F.struct(F.lit(r.pack_name).alias("pack_name"), F.lit(r.capacity_tokens).cast("int").alias("capacity")) for r in rooms]) if rooms else F.array().cast("array<struct<pack_name:string,capacity:int>>")
    dealt = full.select("doc_id", "tokens", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard"), F.inline(each))
    return dealt.groupBy("pack_name", "shard").applyInPandas(_pack_shard, "pack_name string, shard bigint, container bigint, doc_id bigint, piece int, tokens bigint")


def fill_report(packed: DataFrame, packs: DataFrame) -> DataFrame:
    """pack_name, containers, tokens, fill (share of the room used), fewest (containers that no packing can undercut)."""
    total = packed.groupBy("pack_name").agg(F.countDistinct("shard", "container").alias("containers"), F.sum("tokens").alias("tokens"))
    room = F.col("capacity_tokens")
    return total.join(packs, "pack_name").select("pack_name", "containers", "tokens", F.round(F.col("tokens") / (F.col("containers") * room), 6).alias("fill"), F.ceil(F.col("tokens") / room).alias("fewest"))
