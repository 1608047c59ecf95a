"""Self-join of documents on the Jaccard similarity of their word n-gram sets, and the classes
that the links make.

Size-aware, heavy and light sets apart:

* **Light** sets (few shingles) enumerate their subsets of fixed size. Sets of sizes r and s
  with Jaccard >= t share at least c = ceil(t (r + s) / (1 + t)) shingles, hence a c-subset;
  a set of size r needs c between ceil(t r) and r only.
* **Heavy** sets scan inverted lists. Under one global order of shingles, rare ones first, two
  similar sets share a shingle among the first r - ceil(t r) + 1 of each, so only those are
  listed. Scanning counts how many lists a pair has in common; with c needed overlap a pair
  survives only if that count k reaches min(p_r - r + c, p_s - s + c), where p is the number
  listed: of the set whose listed part ends first in the order, every shared shingle is listed
  on both sides, and only r - c of its p may be missing.
* The **boundary** between them is the size with the least cost: subsets enumerated below it
  plus list entries scanned above it.

Sets that are equal are one node, so copies meet in one aggregate and never in pairs. In a
list of up to `short_list` members all are compared; in a longer one `pivots` members are
compared with all others. A list whose members still lie in several components gets further
pivots (from the smaller components, more each round) until none is left to compare,
so long lists of near copies cost their length times few pivots, and no link between
components is missed. A pair leaves the scan only if 256 parity bits of the two sets allow the
overlap it needs (bits that differ are shingles that differ). What remains is verified on
whole sets.
Shingle frequencies, which only choose the order, are counted over all documents; at most
`ordered_hot` of the most frequent shingles are told apart, which bounds what is sent to
tasks and changes speed, never results.

Defined results: a null or blank text has an empty set and links with nothing. A text with
fewer than n words is one shingle. Rows without an id link with nothing and have a null
component. Repeated rows are kept row by row. An empty table gives an empty result. Other
columns are never read. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paddock.llm.components import components
from paddock.llm.hashing import distinct, mix64, set_hashes, shingle_hashes, stream, word_hashes
from paddock.llm.tables import discard, identified, join_small, noted, stored, text_bytes, times_of_rows
from paddock.operators.prefix import first_rows
from paddock.session import parallelism

_SUBSET = stream(21, 64)
_FLUSH = 1 << 21
_SKETCH = ["k0", "k1", "k2", "k3"]
_SIDE = ["node", "n", "p", "unseen", "comp"]


@dataclass(frozen=True)
class Params:
    width: int = 4
    percent: int = 85  # links need 100 * intersection >= percent * union
    light_limit: int = 19  # largest size for which subsets are considered
    hot_count: int = 3  # shingles in so many places are ordered last, by their count
    ordered_hot: int = 1 << 19
    short_list: int = 64
    pivots: int = 16
    pivot_growth: int = 8  # times as many each round
    broadcast_ids: int = 2_000_000  # candidate ids are broadcast up to here, shuffled beyond
    broadcast_packs: int = 16_384  # maps of dropped rows (4 KB for 32,768 rows) are broadcast up to here


def _least_kept(size: int, percent: int) -> int:
    return -(-percent * size // 100)


def _overlap(r: Column, s: Column, percent: int) -> Column:
    """The smallest intersection that links sets of sizes r and s."""
    return F.ceil((r + s) * percent / (100 + percent))


def frequent_shingles(docs: DataFrame, params: Params) -> tuple[np.ndarray, np.ndarray]:
    """(top 32 bits of the hash, count) of the shingles in at least `hot_count` places, sorted.

    Tasks send packed, sorted runs of hashes (16 bits a shingle), one per range of the hash,
    so the shuffle is a few large rows; each range is counted by itself.
    """
    bits = 8
    while (1 << bits) < 4 * parallelism(docs.sparkSession) and bits < 16:
        bits += 1

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            keys = np.sort(np.concatenate(pending))
            cuts = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(32 - bits))
            ranges, blobs = [], []
            for r, part in enumerate(np.split(keys, cuts[1:])):
                if len(part):
                    high = (part >> np.uint32(16)).astype(np.int64) & ((1 << (16 - bits)) - 1)
                    counts = np.bincount(high, minlength=1 << (16 - bits)).astype("<u4")
                    ranges.append(r)
                    blobs.append(counts.tobytes() + (part & np.uint32(0xFFFF)).astype("<u2").tobytes())
            return pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), pa.array(blobs, pa.binary())], ["range", "packed"])

        for batch in batches:
            for text in text_bytes(batch, "__text"):
                found = distinct(shingle_hashes(word_hashes(text), params.width))
                if len(found):
                    pending.append((found >> np.uint64(32)).astype(np.uint32))
                    size += len(found)
                if size >= _FLUSH:
                    yield flush()
                    pending, size = [], 0
        if pending:
            yield flush()

    def count(group: pa.Table) -> pa.Table:
        top = group["range"][0].as_py() << (32 - bits)
        highs = 1 << (16 - bits)
        keys = []
        for blob in group["packed"].to_pylist():
            counts = np.frombuffer(blob, "<u4", highs)
            low = np.frombuffer(blob, "<u2", offset=4 * highs)
            keys.append((np.repeat(np.arange(highs, dtype=np.uint32), counts) << np.uint32(16)) | low)
        found, counts = np.unique(np.concatenate(keys), return_counts=True)
        keep = counts >= params.hot_count
        return pa.table({"key": found[keep].astype(np.int64) + top, "count": counts[keep]})

    counted = docs.select("__text").mapInArrow(pack, "range int, packed binary").groupBy("range").applyInArrow(count, "key long, count long")
    hot = counted.orderBy(F.desc("count"), "key").limit(params.ordered_hot).toArrow().sort_by("key")
    return hot["key"].to_numpy().astype(np.uint32), hot["count"].to_numpy()


def subset_keys(members: np.ndarray, percent: int) -> np.ndarray:
    """A key for each subset of each size from ceil(t r) to r."""
    r = len(members)
    keys = []
    total = members.sum(dtype=np.uint64)
    for gone in range(r - _least_kept(r, percent) + 1):
        left_out = np.array(list(itertools.combinations(range(r), gone)), dtype=np.int64).reshape(comb(r, gone), gone)
        keys.append(mix64((total - members[left_out].sum(axis=1, dtype=np.uint64)) ^ _SUBSET[r - gone]))
    return np.concatenate(keys)


def parity_sketch(members: np.ndarray) -> np.ndarray:
    """256 parity bits of a set as 4 signed numbers. Two sketches differ in no more bits than
    the sets differ in members."""
    odd = np.bincount((mix64(members ^ _SUBSET[63]) >> np.uint64(56)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def signatures(docs: DataFrame, hot: tuple[np.ndarray, np.ndarray], params: Params) -> DataFrame:
    """Per row: id, size of the set, two hashes and the sketch of it, listed shingles, subset keys."""
    hot_keys, hot_counts = hot

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("n_shingles", "node", "check", *_SKETCH, "listed", "subsets")}
            for text in text_bytes(batch, "__text"):
                members = distinct(shingle_hashes(word_hashes(text), params.width))
                r = len(members)
                one, two = set_hashes(members)
                listed = subsets = np.empty(0, dtype=np.uint64)
                if r:
                    top = (members >> np.uint64(32)).astype(np.uint32)
                    rank = np.zeros(r, dtype=np.int64)
                    if len(hot_keys):
                        at = np.minimum(np.searchsorted(hot_keys, top), len(hot_keys) - 1)
                        rank = np.where(hot_keys[at] == top, hot_counts[at], 0)
                    order = np.lexsort((members, rank))
                    listed = members[order[: r - _least_kept(r, params.percent) + 1]]
                    if r <= params.light_limit:
                        subsets = subset_keys(members, params.percent)
                for name, value in zip(out, (r, one, two, *parity_sketch(members).tolist(), listed.astype(np.int64), subsets.astype(np.int64))):
                    out[name].append(value)
            types = (*[pa.int64()] * 7, pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(v, t) for v, t in zip(out.values(), types)]], ["doc_id", *out]
            )

    schema = "doc_id long, n_shingles long, node long, check long, k0 long, k1 long, k2 long, k3 long, listed array<long>, subsets array<long>"
    return docs.select("doc_id", "__text").mapInArrow(sign, schema)


def _boundary(nodes: DataFrame, lists: DataFrame, params: Params) -> int:
    """The size up to which enumerating subsets costs less than scanning lists."""
    small = F.col("n") <= params.light_limit
    subsets = {r["n"]: r["cost"] for r in nodes.where(small).groupBy("n").agg(F.sum(F.size("subsets")).alias("cost")).collect()}
    scans = {r["n"]: r["cost"] for r in lists.where(small).groupBy("n").agg(F.sum("members").alias("cost")).collect()}
    sizes = range(params.light_limit + 1)
    return min(sizes, key=lambda x: sum(subsets.get(n, 0) for n in sizes if n <= x) + sum(scans.get(n, 0) for n in sizes if n > x))


def shared(entries: DataFrame) -> DataFrame:
    """The entries whose key another entry has, with the number of its `members`: entries travel once."""
    return entries.withColumn("members", F.count("*").over(W.partitionBy("key"))).where("members > 1")


def candidate_lists(nodes: DataFrame, params: Params) -> DataFrame:
    """(key, node, n, p, members): nodes that share a listed shingle or an enumerated subset.

    `p` is the number of shingles that a heavy entry's node lists, 0 for a subset's entry.
    """
    # Most shingles are listed once, so entries carry no more than they need until those are gone.
    heavy = stored(shared(nodes.select("node", "n", F.explode("listed").alias("key"))), "lists")
    limit = _boundary(nodes, heavy, params)
    reach = _least_kept(limit + 1, params.percent)  # smaller sets cannot link with a heavy one
    light = shared(nodes.where(F.col("n") <= limit).select("node", "n", F.explode("subsets").alias("key")))
    listed = F.expr(f"n - (n * {params.percent} + 99) div 100 + 1")
    both = heavy.where((F.col("n") > limit) | (F.col("n") >= reach))
    return both.select("key", "node", "n", listed.alias("p"), "members").unionAll(light.select("key", "node", "n", F.lit(0).alias("p"), "members"))


def _whole_sets(docs: DataFrame, wanted: DataFrame, params: Params) -> DataFrame:
    """(node, members) of the wanted nodes, from the text of one document of each."""
    texts = join_small(docs, wanted.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi", params.broadcast_ids)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sets = [], []
            for text in text_bytes(batch, "__text"):
                members = distinct(shingle_hashes(word_hashes(text), params.width))
                nodes.append(set_hashes(members)[0])
                sets.append(members.astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    found = texts.select("__text").mapInArrow(read, "node long, shingles array<long>")
    return found.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _met(lists: DataFrame, pivots: DataFrame, short: DataFrame | None, params: Params) -> DataFrame:
    """Sides of the pairs of a pivot and another member that sizes and sketches allow, of other
    components. In `short` lists every member is a pivot, so none is marked or picked."""
    percent = params.percent
    marks = pivots.select("key", "node", F.lit(True).alias("pivot"))
    members = lists.join(marks, ["key", "node"], "left")
    if short is not None:
        members = short.withColumn("pivot", F.lit(True)).unionByName(members)
        pivots = short.unionByName(pivots)
    chosen = pivots.select("key", *[F.col(c).alias(f"{c}_b") for c in [*_SIDE, *_SKETCH]])
    needed = _overlap(F.col("n"), F.col("n_b"), percent)
    differ = reduce(lambda x, y: x + y, [F.bit_count(F.col(k).bitwiseXOR(F.col(f"{k}_b"))) for k in _SKETCH])
    met = (
        members.join(chosen, "key")
        .where(
            (F.col("comp") != F.col("comp_b")) & (F.col("pivot").isNull() | (F.col("node") < F.col("node_b")))
            & (100 * F.least("n", "n_b") >= percent * F.greatest("n", "n_b"))
            & (differ <= F.col("n") + F.col("n_b") - 2 * needed)
        )
    )
    first = F.col("node") < F.col("node_b")
    side = lambda c, a: (F.when(first, F.col(c)).otherwise(F.col(f"{c}_b")) if a else F.when(first, F.col(f"{c}_b")).otherwise(F.col(c)))
    return met.select(*[side(c, True).alias(f"{c}_a") for c in _SIDE], *[side(c, False).alias(f"{c}_b") for c in _SIDE])


def _pairs(sides: DataFrame, params: Params) -> DataFrame:
    """Pairs (a, b) that also the number of common lists allows.

    `unseen` is the number of long lists of a node, in which a common place may go unseen.
    """
    common = sides.groupBy(F.col("node_a").alias("a"), F.col("node_b").alias("b")).agg(
        *[F.max(c).alias(c) for c in ("n_a", "n_b", "p_a", "p_b", "unseen_a", "unseen_b", "comp_a", "comp_b")],
        F.sum((F.col("p_a") > 0).cast("long")).alias("seen"), F.max((F.col("p_a") == 0) | (F.col("p_b") == 0)).alias("subset"),
    )
    at_most = F.col("seen") + F.least("unseen_a", "unseen_b")
    needed = _overlap(F.col("n_a"), F.col("n_b"), params.percent)
    enough = at_most >= F.least(F.col("p_a") - F.col("n_a") + needed, F.col("p_b") - F.col("n_b") + needed)
    return common.where(F.col("subset") | enough).select("a", "b", "n_a", "n_b", "comp_a", "comp_b")


def _linked(pairs: DataFrame, sets: DataFrame, params: Params) -> DataFrame:
    """(comp_a, comp_b) of the pairs that link. `sets` comes dealt by node, once for both sides."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("s_a")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("shingles").alias("s_b")), "b"
    )
    common = F.size(F.array_intersect("s_a", "s_b"))
    return both.where(100 * common >= params.percent * (F.col("n_a") + F.col("n_b") - common)).select("comp_a", "comp_b")


def _merged(roots: DataFrame | None, linked: DataFrame) -> DataFrame:
    """(node, root) after new links, of which only those between different roots count."""
    joined = components(linked.select("comp_a", "comp_b"), "comp_a", "comp_b")
    if roots is None:
        return joined
    joined = stored(joined, "joined-roots")
    moved = roots.join(joined.select(F.col("node").alias("root"), F.col("root").alias("now")), "root", "left")
    return moved.select("node", F.coalesce("now", "root").alias("root")).unionByName(joined.join(roots.select("node"), "node", "left_anti"))


def class_roots(docs: DataFrame, nodes: DataFrame, params: Params) -> DataFrame | None:
    """(node, root) of the nodes that link with another; None if no two share a list."""
    long = F.col("members") > params.short_list
    unseen = F.sum(long.cast("long")).over(W.partitionBy("node"))
    known = candidate_lists(nodes, params).withColumn("unseen", unseen).join(nodes.select("node", *_SKETCH), "node")
    lists = stored(known.withColumn("comp", F.col("node")), "open-lists")
    if lists.isEmpty():
        return None
    now = lists.where(long)
    tested = roots = None
    count = params.pivots
    while roots is None or not now.isEmpty():
        order = [F.xxhash64("node"), F.col("node")]
        if roots is None:
            pivots = first_rows(now, ["key"], order, count)
        else:
            sizes = now.groupBy("key", "comp").agg(F.count("*").alias("in_list"))
            main = sizes.groupBy("key").agg(F.max_by("comp", F.struct("in_list", "comp")).alias("main"))
            pivots = first_rows(now.join(main, "key").where("comp != main").drop("main"), ["key"], order, count)
        pivots = stored(pivots, "pivots")
        pairs = _pairs(_met(now, pivots, lists.where(~long) if roots is None else None, params), params)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs")
        ends = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()
        wanted = stored(nodes.select("node", "rep").join(ends, "node"), "candidates")
        linked = stored(_linked(pairs, _whole_sets(docs, wanted, params), params), "links")
        tested = pairs.select("a", "b") if tested is None else tested.unionAll(pairs.select("a", "b"))
        roots = stored(_merged(roots, linked), "roots")
        count *= params.pivot_growth
        left = now.drop("comp").join(pivots.select("key", "node"), ["key", "node"], "left_anti")
        placed = left.join(roots.withColumnRenamed("root", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        spread = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high")
        now = stored(placed.join(spread.select("key"), "key"), "open-lists")
    return roots


def join(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", params: Params = Params()) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of `docs`."""
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("__text"))
    folders: list[str] = []
    with noted(folders):
        signed = stored(signatures(narrow, frequent_shingles(narrow, params), params), "signatures")
    nodes = stored(
        signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("node", "check").agg(
            F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), *[F.first(k).alias(k) for k in _SKETCH], F.first("listed").alias("listed"), F.first("subsets").alias("subsets")
        ),
        "nodes",
    )
    # From here on one row of each set carries its shingles; the rows need only say which set is theirs.
    signed = stored(signed.select("doc_id", "n_shingles", "node", "check"), "rows")
    for folder in folders:
        discard(docs.sparkSession, folder)
    roots = class_roots(narrow, nodes, params)
    named = nodes.select("node", "check", "rep")
    if roots is not None:
        joined = named.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        least = joined.groupBy("root").agg(F.min("rep").alias("component_id"))
        named = joined.join(least, "root").select("node", "check", "component_id")
    else:
        named = named.withColumnRenamed("rep", "component_id")
    out = signed.select("doc_id", "n_shingles", "node", "check").join(named, ["node", "check"], "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))


def first_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", params: Params = Params()) -> DataFrame:
    """One document of each class, that of smallest id, all columns as they were.

    Rows without an id stay. Rows that share an id stay if one of them is the first of its
    class, and of those with equal texts one stays.
    """
    classes = stored(join(docs, text, doc_id, params), "classes").where("doc_id IS NOT NULL")
    by_id = stored(
        classes.groupBy(F.col("doc_id").alias("__id")).agg(F.count("*").alias("rows"), F.max(F.col("component_id") == F.col("doc_id")).alias("first")), "ids"
    )
    same = F.col(doc_id).cast("long") == F.col("__id")
    kept = join_small(docs, by_id.where("NOT first").select("__id"), same, "left_anti", params.broadcast_ids)
    again = by_id.where("first AND rows > 1").select("__id")
    if again.isEmpty():
        return kept
    alone = join_small(kept, again, same, "left_anti", params.broadcast_ids)
    return alone.unionByName(join_small(kept, again, same, "left_semi", params.broadcast_ids).dropDuplicates([doc_id, text]))


def one_row_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", params: Params = Params()) -> DataFrame:
    """One row of each class of texts, all columns as they were: that of smallest id, a row
    without an id only where no other has one.

    Each row is judged by itself, whatever its id. Null and blank texts are copies of nothing
    and stay.
    """
    rows = identified(docs)
    narrow = rows.select("__row", F.col("__doc")[text].alias("__text"), F.col("__doc")[doc_id].cast("long").alias("__id"))
    classes = join(narrow.select("__row", "__text"), "__text", "__row", params).select(F.col("doc_id").alias("__row"), F.col("component_id").alias("__class"))
    place = F.struct(F.col("__id").isNull().alias("last"), "__id", "__row").alias("__place")
    placed = stored(classes.join(narrow.select("__row", "__id"), "__row").select("__class", place), "placed")
    first = placed.groupBy("__class").agg(F.min("__place").alias("__first")).select(F.col("__first.__row").alias("__row"))
    # Row against row: no class, however large, meets in one task.
    gone = placed.select(F.col("__place.__row").alias("__row")).join(first, "__row", "left_anti")
    marks = stored(gone.withColumn("times", F.lit(1)), "gone")
    return times_of_rows(rows, marks, packs=params.broadcast_packs).where("__times = 0").select("__doc.*")
