"""The rows of a training run in two parts that meet without a shuffle.

What never changes (bins, labels, weights, groups) is written once, one column per feature, as
a table bucketed by a row number. What changes is narrow: scores, or leaf numbers,
rewritten every round in the same buckets. Within a round a narrow table
of quantised gradients and node numbers is kept; a level of growth moves the stored nodes on
from where they are instead of walking each tree from its root. Bins that a step
does not name are not read. Dense rows are packed into blocks once a round (`blocks`), which is
what levels then read. Dense rows whose gradients need no other row are kept in such blocks from the
start (`BlockRows`): a round reads and writes blocks alone, and no row is joined to another.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.operators import blocks
from paddock.operators.blocks import STORED, Step, Values, pack
from paddock.session import cut_lineage, discard, parallelism, shared_folder

ROW = "__row"
# Rows of a round from which those under a few nodes are kept apart.
PART_ROWS = 1 << 20


class TwoPartRows:
    """A table of rows with `bins` (in order of the features) and a narrow changing part."""

    def __init__(self, binned: DataFrame, features: int, changing: list[str], buckets: int | None = None, wide: bool = False):
        """`binned` has `bins`, an array or, if sparse, a map; its columns in `changing` make the narrow part. `wide` bins need an int."""
        self.spark = binned.sparkSession
        self.buckets = buckets or parallelism(self.spark)
        self.changing, self.held = changing, {}
        fixed = [c for c in binned.columns if c not in ("bins", *changing)]
        # Numbers are frozen before rows are dealt by them, so a task run again deals the same.
        numbered = cut_lineage(binned.withColumn(ROW, F.monotonically_increasing_id()))
        kind = "INT" if wide else "SMALLINT"
        sparse = binned.schema["bins"].dataType.typeName() == "map"
        cells = ["bins"] if sparse else [f"CAST(bins[{i}] AS {kind}) AS b{i}" for i in range(features)]
        self.features, self.wide, self.sparse = features, wide, sparse
        self._fixed = self._write(numbered.selectExpr(ROW, *[f"`{c}`" for c in fixed], *cells))
        self._narrow = self._write(numbered.select(ROW, *changing))
        self.columns = [ROW, *fixed, "bins", *changing]
        packed = "bins" if sparse else f"array({', '.join(f'CAST(b{i} AS INT)' for i in range(features))}) AS bins"
        self._shown = [ROW, *[f"`{c}`" for c in fixed], packed]
        self.fixed = self.spark.table(self._fixed).selectExpr(*self._shown)

    def _write(self, rows: DataFrame) -> str:
        name = f"rows_{uuid.uuid4().hex}"
        self.held[name] = f"{shared_folder(self.spark)}/{name}"
        dealt = rows.repartition(self.buckets, ROW).write.format("parquet").bucketBy(self.buckets, ROW)
        dealt.option("path", self.held[name]).saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        discard(self.spark, self.held.pop(name))

    @property
    def narrow(self) -> DataFrame:
        return self.spark.table(self._narrow)

    def meet(self, narrow: DataFrame) -> DataFrame:
        """The fixed part with a narrow one, bucket by bucket; the narrow side is hashed.

        Bins become an array after the join, so that only those asked for are read.
        """
        both = self.spark.table(self._fixed).join(narrow.hint("shuffle_hash"), ROW)
        return both.selectExpr(*self._shown, *[f"`{c}`" for c in narrow.columns if c != ROW])

    def cells(self, narrow: DataFrame) -> DataFrame:
        """The bins of each row, one column per feature, beside a narrow part."""
        return self.spark.table(self._fixed).join(narrow.hint("shuffle_hash"), ROW)

    @property
    def rows(self) -> DataFrame:
        return self.meet(self.narrow)

    def rewrite(self, rows: DataFrame) -> None:
        """Replace the narrow part by these rows' changing columns."""
        before, self._narrow = self._narrow, self._write(rows.select(ROW, *self.changing))
        self._drop(before)

    def close(self) -> None:
        for name in list(self.held):
            self._drop(name)


class RoundRows:
    """The narrow rows of one round: gradients, and per slot the node a row has reached.

    Given the gradient columns of its slots, it also keeps dense rows packed in blocks; their
    nodes are found by walking, so none are stored.
    """

    def __init__(
        self, home: TwoPartRows, graded: DataFrame, keep: list[str], slots: int, store_levels: int = 3, packed: list[tuple[str, str]] = (),
        part_rows: int = PART_ROWS,
    ):
        self.home, self.keep, self.slots, self.store_levels = home, keep, slots, store_levels
        start = graded.selectExpr(ROW, *keep, *[f"0 AS {self.node(i)}" for i in range(slots)])
        self.narrow = self._kept(start)
        self.since = 0
        self.packed = None
        if packed and not home.sparse:
            self.packed = PackedRows(pack(home.cells(self.narrow), packed, home.features, home.wide), home, slots, part_rows)

    @staticmethod
    def node(slot: int) -> str:
        return f"node{slot}"

    def _kept(self, narrow: DataFrame) -> DataFrame:
        """Kept rows keep their buckets, which is known once they are filled."""
        kept = narrow.persist(StorageLevel.MEMORY_AND_DISK)
        kept.count()
        return kept

    @property
    def rows(self) -> DataFrame:
        return self.home.meet(self.narrow)

    def level_done(self, trees: list) -> None:
        """Every few levels, move the stored nodes to the deepest known ones."""
        self.since += 1
        if self.packed is not None or self.since < self.store_levels:
            return
        moved = self.rows.selectExpr(ROW, *self.keep, *[f"{t.settle(self.node(t.slot))} AS {self.node(t.slot)}" for t in trees])
        before, self.narrow, self.since = self.narrow, self._kept(moved), 0
        before.unpersist()

    def leafed(self, trees: list) -> DataFrame:
        """All rows with their leaf of each finished tree, as leaf0, leaf1, ..."""
        return self.rows.selectExpr("*", *[f"{t.final_leaf(self.node(t.slot))} AS leaf{t.slot}" for t in trees])

    def close(self) -> None:
        self.narrow.unpersist()
        if self.packed is not None:
            self.packed.close()

    @property
    def blocks(self) -> DataFrame | None:
        return None if self.packed is None else self.packed.all.blocks


@dataclass
class Part:
    """Packed rows: the nodes they are kept at by slot, and how many they are at most."""

    blocks: DataFrame
    held: dict[int, set[int]]
    rows: int


class PackedRows:
    """Packed blocks of a round, all rows and a few parts of them.

    Best-first growth soon asks for nodes with a small share of the rows. From `part_rows` rows on, the rows under
    the nodes of such a level are kept apart, and levels below read them alone. A part is filled by the
    job of the level it is made for; when a level asks for other nodes, it reads a part that has them, or all rows.
    """

    SHARE, MOST = 4, 3  # a part has at most 1 / SHARE of the rows it comes from; this many are kept at a time

    def __init__(self, packed: DataFrame, home: TwoPartRows | BlockRows, slots: int, part_rows: int):
        self.home, self.slots, self.part_rows = home, slots, part_rows
        blocks = packed.persist(StorageLevel.MEMORY_AND_DISK)
        self.all = Part(blocks, {i: {0} for i in range(slots)}, blocks.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first()["n"])
        self.parts: list[Part] = []

    def part(self, trees: list, asked: dict[int, set[int]]) -> Part:
        """The rows to read for the nodes asked for by slot."""
        fits = [p for p in self.parts if all(t.covers(p.held[t.slot], asked[t.slot]) for t in trees if t.slot in asked)]
        best = min([self.all, *fits], key=lambda p: p.rows)
        need = sum(n.n for t in trees if t.slot in asked for n in t.all if n.id in asked[t.slot])
        if best.rows < self.part_rows or need * self.SHARE > best.rows:
            return best
        ways = {t.slot: t.ways({n: n for n in asked.get(t.slot, ())}, best.held[t.slot]) for t in trees}
        made = blocks.apart(best.blocks, self.slots, self.home.features, self.home.wide, [ways.get(i, {}) for i in range(self.slots)])
        self.parts.append(Part(made.persist(StorageLevel.MEMORY_AND_DISK), {i: set(asked.get(i, ())) for i in range(self.slots)}, need))
        if len(self.parts) > self.MOST:
            oldest = next(p for p in self.parts if p is not best)
            self.parts.remove(oldest)
            oldest.blocks.unpersist()
        return self.parts[-1]

    def close(self) -> None:
        for p in (self.all, *self.parts):
            p.blocks.unpersist()


# Bytes of a row group of stored blocks, of which a reader holds one at a time.
GROUP_BYTES = 16 << 20


class BlockRows:
    """The rows of a training run in blocks, written anew every round.

    A block has the bins and all other columns of its rows, so a round needs no join: gradients are
    Spark's expressions on the rows of the blocks, in their order, and meet the bins again in `held` rows.
    """

    sparse = False

    def __init__(self, binned: DataFrame, features: int, changing: list[str], wide: bool = False):
        self.spark, self.features, self.wide, self.changing = binned.sparkSession, features, wide, changing
        self.buckets, self.path = parallelism(self.spark), None
        self.carried = [c for c in binned.columns if c != "bins"]
        self.schema = binned.select(*[f"`{c}`" for c in self.carried]).schema
        kind = "INT" if wide else "SMALLINT"
        rows = binned.selectExpr(*[f"`{c}`" for c in self.carried], *[f"CAST(bins[{i}] AS {kind}) AS b{i}" for i in range(features)])
        self._write(blocks.store(rows, self.carried, features, wide).repartition(self.buckets))

    def _write(self, stored: DataFrame) -> None:
        before, self.path = self.path, f"{shared_folder(self.spark)}/blocks_{uuid.uuid4().hex}"
        # No two blocks are equal, so a dictionary would only hash them.
        stored.write.option("parquet.block.size", GROUP_BYTES).option("parquet.enable.dictionary", "false").parquet(self.path)
        self.blocks = self.spark.read.schema(STORED).parquet(self.path)
        if before is not None:
            discard(self.spark, before)

    def rows(self, ways: list[Step | int] = (), values: Values | None = None, held: bool = False) -> DataFrame:
        return blocks.stored_rows(self.blocks, self.schema, self.features, self.wide, ways, values, held)

    @property
    def fixed(self) -> DataFrame:
        return self.rows()

    def advance(self, ways: list[Step | int], values: Values | None) -> None:
        """Add new trees' values to the scores or, without values, their leaves to the leaves."""
        self._write(blocks.advance(self.blocks, self.features, self.wide, ways, values))

    def rewrite(self, rows: DataFrame) -> None:
        """Replace the carried columns by those of these rows, which are held."""
        self._write(blocks.store_held(rows, self.carried))

    def close(self) -> None:
        discard(self.spark, self.path)


class RoundBlocks:
    """The rows of one round of `BlockRows`, packed; `graded` gives the gradient columns of its slots to rows.

    `packed` blocks have those gradients already, worked out from the stored blocks.
    """

    def __init__(
        self, home: BlockRows, graded: Callable[[list[Step | int], bool], DataFrame], slots: list[tuple[str, str]], packed: DataFrame | None = None,
        part_rows: int = PART_ROWS,
    ):
        self.home, self.graded, self.slots = home, graded, slots
        packed = blocks.pack_held(graded([], True), slots, home.features, home.wide) if packed is None else packed
        self.packed = PackedRows(packed, home, len(slots), part_rows)

    @property
    def blocks(self) -> DataFrame:
        return self.packed.all.blocks

    @property
    def narrow(self) -> DataFrame:
        return blocks.unpacked(self.blocks, self.slots, self.home.features, self.home.wide, with_bins=False)

    @property
    def rows(self) -> DataFrame:
        packed = f"array({', '.join(f'b{i}' for i in range(self.home.features))}) AS bins"
        return blocks.unpacked(self.blocks, self.slots, self.home.features, self.home.wide).selectExpr(packed, *[c for slot in self.slots for c in slot])

    def level_done(self, trees: list) -> None:
        """Rows in blocks are walked anew, so none are moved."""

    def leafed(self, trees: list, held: bool = False) -> DataFrame:
        """All rows with their leaf of each finished tree, as leaf0, leaf1, ..."""
        return self.graded([t.leaf_way() for t in trees], held)

    def close(self) -> None:
        self.packed.close()
