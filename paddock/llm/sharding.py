"""Sharding by balanced label propagation.

Documents that share a hub (here: equal texts) are linked. Documents start in shards that are
even to one document. In each round every linked document wishes for the shard that most of
its neighbours (itself included) are in; wishes are counted per pair of shards, and a quota
for each pair is granted: as many as want to come back the other way, plus a part of the room
that unlinked documents hold in the target shard. Who moves within a quota goes by hub, so
members of a hub move together. At the end unlinked documents, which no move can cut, fill
every shard to its exact count. So the law is `rows`: counts differ by one at most at any time.

Only counts per pair of shards come to the driver. Neighbourhoods are never collected: hubs
vote with one counter per shard. Ranks come from range-partitioned running counts, so a hub
or shard of any size spreads over many tasks. A hub larger than a shard fills shards in turn:
its members wish for shards with room only. Everything is DataFrame functions.

Defined results: null texts are linked with nothing, equal empty texts with each other. Null
ids and repeated rows are rows like others. An empty table gives an empty result. Other
columns are never read. Ties between shards fall by a hash of the hub that changes with each
round, so that wishes which found no partner to exchange with get another chance.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.llm.tables import identified, join_small, stored
from paddock.operators.prefix import positions


@dataclass(frozen=True)
class Params:
    shards: int = 8
    rounds: int = 8  # at most; it ends when no wish can be granted
    seed: int = 23


def _pick(pairs: dict[tuple[int, int], int], a: Column, b: Column) -> Column:
    """The number of the pair (a, b), 0 where there is none."""
    out = F.lit(0).cast("long")
    for (i, j), n in pairs.items():
        out = F.when((a == i) & (b == j), F.lit(n)).otherwise(out)
    return out


def quotas(wishes: dict[tuple[int, int], int], room: dict[int, int]) -> dict[tuple[int, int], int]:
    """Moves granted from i to j: exchanges, plus a share of the room in j."""
    out = {(i, j): min(n, wishes.get((j, i), 0)) for (i, j), n in wishes.items()}
    for j in {j for _, j in wishes}:
        left = {i: n - out[i, j] for (i, k), n in wishes.items() if k == j}
        given, total = min(room.get(j, 0), sum(left.values())), sum(left.values())
        parts = {i: given * n // total if total else 0 for i, n in left.items()}
        for i in sorted(left, key=lambda i: (parts[i] - left[i], i))[: given - sum(parts.values())]:
            parts[i] += 1
        for i, n in parts.items():
            out[i, j] += n
    return out


def _start(nodes: DataFrame, params: Params) -> DataFrame:
    """Nodes with a shard each, even to one row, in an order drawn by hash."""
    drawn = [F.xxhash64("doc_id", F.lit(params.seed)), F.col("doc_id"), F.col("row")]
    return positions(nodes, [], drawn, "place").withColumn("shard", F.pmod(F.col("place") - 1, F.lit(params.shards)).cast("int"))


def _linked_counts(state: DataFrame) -> dict[int, int]:
    return {r["shard"]: r["n"] for r in state.where("linked").groupBy("shard").agg(F.count("*").alias("n")).collect()}


def propagate(nodes: DataFrame, members: DataFrame, params: Params = Params()) -> DataFrame:
    """`nodes` (row, doc_id, ...) with `shard`; `members` (row, hub) are their links.

    Hubs of one member and repeated memberships should be left out.
    """
    ids = range(params.shards)
    linked = members.select("row").distinct().withColumn("linked", F.lit(True))
    state = stored(
        _start(nodes, params).join(linked, "row", "left").withColumn("linked", F.coalesce("linked", F.lit(False))), "shards"
    )
    room_of = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    for turn in range(params.rounds):
        held = _linked_counts(state)
        room = {s: n - held.get(s, 0) for s, n in room_of.items()}
        votes = members.join(state.select("row", "shard"), "row").groupBy("hub").agg(
            *[F.sum((F.col("shard") == s).cast("long")).alias(f"v{s}") for s in ids]
        )
        near = members.join(votes, "hub").groupBy("row").agg(F.min("hub").alias("hub"), *[F.sum(f"v{s}").alias(f"v{s}") for s in ids])
        least = min(room_of.values(), default=0)
        every = reduce(lambda x, y: x + y, [F.col(f"v{s}") for s in ids])
        drawn = F.xxhash64("hub", F.lit(params.seed + turn))
        best = F.greatest(*[
            F.struct(
                F.when((every <= least) | F.lit(room.get(s, 0) > 0) | (F.col("shard") == s), F.col(f"v{s}")).otherwise(F.lit(-1).cast("long")).alias("votes"),
                F.pmod(drawn + F.lit(s), F.lit(params.shards)).alias("turn"), F.lit(s).alias("shard"),
            )
            for s in ids
        ])
        wish = state.join(near, "row").select("row", "hub", "shard", best["shard"].alias("wish"))
        movers = stored(wish.where("wish != shard"), "movers")
        wishes = {(r["shard"], r["wish"]): r["n"] for r in movers.groupBy("shard", "wish").agg(F.count("*").alias("n")).collect()}
        granted = {k: n for k, n in quotas(wishes, room).items() if n}
        if not granted:
            break
        ranked = positions(movers, ["shard", "wish"], [F.xxhash64("hub"), F.col("hub"), F.col("row")], "rank")
        moved = ranked.where(F.col("rank") <= _pick(granted, F.col("shard"), F.col("wish"))).select("row", "wish")
        state = stored(state.join(moved, "row", "left").withColumn("shard", F.coalesce("wish", "shard")).drop("wish"), "shards")

    # Unlinked rows fill the shards: each keeps its first ones, the rest go where rows lack.
    held = _linked_counts(state)
    free = {r["shard"]: r["n"] for r in state.where("NOT linked").groupBy("shard").agg(F.count("*").alias("n")).collect()}
    wanted = {s: n - held.get(s, 0) for s, n in room_of.items()}
    ranked = positions(state.where("NOT linked"), ["shard"], [F.col("place")], "rank")
    offset, lack, passed = {}, [], 0
    for s in sorted(room_of):
        offset[s] = passed - wanted[s]
        passed += max(0, free.get(s, 0) - wanted[s])
    reach = 0
    for s in sorted(room_of):
        reach += max(0, wanted[s] - free.get(s, 0))
        lack.append((reach, s))
    spill = F.col("rank") + reduce(lambda acc, s: F.when(F.col("shard") == s, F.lit(offset[s])).otherwise(acc), offset, F.lit(0))
    goal = reduce(lambda acc, x: F.when(spill <= x[0], F.lit(x[1])).otherwise(acc), reversed(lack), F.col("shard"))
    stays = F.col("rank") <= reduce(lambda acc, s: F.when(F.col("shard") == s, F.lit(wanted[s])).otherwise(acc), wanted, F.lit(0))
    filled = ranked.withColumn("shard", F.when(stays, F.col("shard")).otherwise(goal).cast("int")).drop("rank")
    return state.where("linked").unionByName(filled)


def _sharded(rows: DataFrame, text: str, doc_id: str, params: Params) -> DataFrame:
    """Shard and slot of each row, told by its column `row`."""
    value = F.col(text)
    nodes = stored(
        rows.select(
            "row", F.col(doc_id).alias("doc_id"), (F.coalesce(F.octet_length(value), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(value).alias("text_crc32"), F.sha2(value, 256).alias("hub"),
        ),
        "nodes",
    )
    shared = nodes.where("hub IS NOT NULL").groupBy("hub").agg(F.count("*").alias("n")).where("n > 1")
    members = stored(nodes.select("row", "hub").join(shared.select("hub"), "hub", "left_semi"), "members")
    sharded = stored(propagate(nodes.drop("hub"), members, params), "sharded")
    return positions(sharded, ["shard"], [F.col("place")], "slot").withColumn("slot", F.col("slot") - 1)


def shard_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", params: Params = Params()) -> DataFrame:
    """Every row of `docs`: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    rows = docs.select(F.col(doc_id), F.col(text)).withColumn("row", F.monotonically_increasing_id())
    return _sharded(rows, text, doc_id, params).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def with_shards(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", params: Params = Params()) -> DataFrame:
    """Every row of `docs`, all columns, with `shard` and `slot` (replacing columns so named).

    Rows may be alike in all columns, so they are told apart by their place in their files.
    """
    rows = identified(docs)
    narrow = rows.select(F.col("__doc")[doc_id].alias("doc_id"), F.col("__doc")[text].alias("text"), F.col("__row").alias("row"))
    found = stored(_sharded(narrow, "text", "doc_id", params).select(F.col("row").alias("__row"), F.col("shard").alias("__shard"), F.col("slot").alias("__slot")), "slots")
    kept = [F.col("__doc")[c].alias(c) for c in docs.columns if c not in ("shard", "slot")]
    return join_small(rows, found, "__row", "inner").select(*kept, F.col("__shard").alias("shard"), F.col("__slot").alias("slot"))
