"""Grouping of spelling variants with permuterm rotations.

A word, marked with a terminator, has a rotation for each place where it can be cut: what
follows the cut, the terminator, what precedes it. Two words differ by one replaced code point
when two of their rotations are the same but for the last code point, the edited one; and a word
is another with one code point deleted when a whole rotation of it is the other's
without its last. So every word puts in its whole rotations, and its rotations
without the last code point; sorted, those with the same prefix lie together and one scan of each
group gives all neighbours. A group holds at most one whole rotation and one member per letter of
the alphabet. Of equal neighbouring code points only the first counts as deleted, which names each pair once.

Rotations travel as fingerprints: polynomials in two variables (what precedes and what follows
the cut) modulo four primes of 31 bits, 124 bits in all, from running sums, so a word of a
million letters costs a million steps and not their square. Words are numbered by falling count,
then by code points, so a group needs numbers only, and the smallest number among the neighbours is
the preferred one.

Defined results: a null or empty text has no words. Where the id is null, nothing is deleted
from a run. Words and their counts come from all rows, repeated rows counted each time. A word
without neighbours has n_near 0 and itself as root. An empty table gives an empty result. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.llm.line_dedup import lowered
from paddock.llm.tables import discard, new_folder, stored
from paddock.operators.prefix import positions

_PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)  # the four largest below 2^31
_BEFORE = (1182603773, 1530474113, 917356931, 2014527889)  # a base for what precedes the cut
_AFTER = (1873051957, 1249830367, 1691440501, 1037928683)  # and one for what follows it


@dataclass(frozen=True)
class Params:
    letters: str = r"A-Za-zÀ-ÿ"
    least_chars: int = 7
    least_count: int = 2
    every: int = 31  # a run whose checksum this divides loses a code point
    times: int = 10  # a form is so many times as frequent


def words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", params: Params = Params()) -> DataFrame:
    """(word, n) of all words that are long and frequent enough."""
    runs = F.regexp_extract_all(F.col(text), F.lit(f"[{params.letters}]{{{params.least_chars},}}"), F.lit(0))
    found = docs.select(F.col(doc_id).cast("string").alias("id"), F.explode(runs).alias("run")).select("id", lowered(F.col("run")).alias("run"))
    mark = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (mark % F.char_length("run")).cast("int")
    less = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    word = F.when(mark % params.every == 0, less).otherwise(F.col("run"))
    counted = found.select(word.alias("word")).where(F.char_length("word") >= params.least_chars).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= params.least_count)


def _powers(base: int, prime: int, count: int) -> np.ndarray:
    """base^0 .. base^(count - 1) modulo the prime, by doubling."""
    out = np.ones(1, dtype=np.int64)
    while len(out) < count:
        step = pow(base, len(out), prime)
        out = np.concatenate([out, out * step % prime])
    return out[:count]


class _Fingerprints:
    """Fingerprints of rotations from running sums of one word."""

    def __init__(self) -> None:
        self.tables: list[tuple[np.ndarray, ...]] = [(np.ones(1, dtype=np.int64),) * 3] * len(_PRIMES)

    def _tables(self, length: int) -> list[tuple[np.ndarray, ...]]:
        if len(self.tables[0][0]) <= length:
            size = 2 * (length + 1)
            self.tables = [(_powers(b, p, size), _powers(a, p, size), _powers(pow(a, -1, p), p, size)) for p, b, a in zip(_PRIMES, _BEFORE, _AFTER)]
        return self.tables

    def of(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Two longs for each whole rotation (cuts 0 to n), then for each rotation without its last code point."""
        n = len(code)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for prime, base, (before, after, back) in zip(_PRIMES, _AFTER, self._tables(n + 1)):
            # Sums of n terms below 2^31 fit in a long for any text.
            ahead = np.concatenate([[0], np.cumsum(code * before[:n] % prime)]) % prime  # of code[:cut]
            whole = np.concatenate([[0], np.cumsum(code * after[:n] % prime)]) % prime
            # Of code[cut:], as if it began at 0; one more factor keeps its first term apart from the other sum's.
            rest = (whole[-1] - whole) % prime * back[: n + 1] % prime * base % prime
            parts.append(((ahead + rest) % prime, (ahead[:-1] + rest[1:]) % prime))
        (a, a_), (b, b_), (c, c_), (d, d_) = parts
        return a << 31 | b, c << 31 | d, a_ << 31 | b_, c_ << 31 | d_


_ENTRY = "k1 long, k2 long, number long, role int"
_WHOLE, _REPLACED, _DELETED = 0, 1, 2  # a whole rotation; one without its last code point; one that may also stand for a deletion
_ENTRIES_OUT = 1 << 18


def rotations(numbered: DataFrame) -> DataFrame:
    """(k1, k2, number, role) of all rotations of the words of (word, number)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = _Fingerprints()
        held: list[list[np.ndarray]] = [[], [], [], []]
        count = 0

        def out() -> pa.RecordBatch:
            columns = [np.concatenate(h) if h else np.empty(0, dtype=np.int64) for h in held]
            for h in held:
                h.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32()))], ["k1", "k2", "number", "role"])

        for batch in batches:
            for word, number in zip(batch.column(0), batch.column(1)):
                code = np.frombuffer(word.as_py().encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
                w1, w2, s1, s2 = prints.of(code)
                first = np.concatenate([[True], code[1:] != code[:-1]])
                role = np.concatenate([np.full(len(w1), _WHOLE), np.where(first, _DELETED, _REPLACED)])
                for h, values in zip(held, (np.concatenate([w1, s1]), np.concatenate([w2, s2]), np.full(len(role), number.as_py()), role)):
                    h.append(values)
                count += len(role)
                if count >= _ENTRIES_OUT:
                    yield out()
                    count = 0
        yield out()

    return numbered.select("word", "number").mapInArrow(cut, _ENTRY)


_FAR = np.iinfo(np.int64).max


def _neighbours(k1: np.ndarray, k2: np.ndarray, number: np.ndarray, role: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number, count, smallest neighbour) of the members of sorted, whole groups."""
    new = np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])
    start = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    edited, deleted, whole = role != _WHOLE, role == _DELETED, role == _WHOLE

    def least(mask: np.ndarray) -> np.ndarray:
        return np.minimum.reduceat(np.where(mask, number, _FAR), start)

    def many(mask: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mask.astype(np.int64), start)

    best = least(edited)
    other = least(edited & (number != best[group]))  # the best but one, for the best itself
    beside = np.where(number == best[group], other[group], best[group])
    short = least(whole)
    count = np.where(whole, many(deleted)[group], many(edited)[group] - 1 + np.where(deleted, many(whole)[group], 0))
    near = np.where(whole, least(deleted)[group], np.minimum(beside, np.where(deleted, short[group], _FAR)))
    keep = count > 0
    return number[keep], count[keep], near[keep]


def neighbours(entries: DataFrame) -> DataFrame:
    """(number, count, near): the number of neighbours of a word and the preferred one."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = [np.empty(0, dtype=np.int64)] * 4
        types = (pa.int64(), pa.int64(), pa.int64())

        def out(found: tuple) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, types)], ["number", "count", "near"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [np.concatenate([t, c.to_numpy(zero_copy_only=False)]) for t, c in zip(tail, batch.columns)]
            # The last group may go on in the next batch.
            last = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
            split = last[-1] + 1 if len(last) else 0
            tail = [r[split:] for r in rows]
            if split:
                yield out(_neighbours(*[r[:split] for r in rows]))
        if len(tail[0]):
            yield out(_neighbours(*tail))

    grouped = entries.repartition("k1", "k2").sortWithinPartitions("k1", "k2")
    found = grouped.mapInArrow(scan, "number long, count long, near long")
    return found.groupBy("number").agg(F.sum("count").alias("n_near"), F.min("near").alias("near"))


def _roots(links: DataFrame, folders: list[str]) -> DataFrame:
    """(number, form, root) of words with a form: pointers jump until none moves, five times at most for counts below 10^32."""
    spark = links.sparkSession
    now = links.select("number", "form", F.col("form").alias("root"))
    while True:
        folders.append(new_folder(spark, "roots"))
        now.write.parquet(folders[-1])
        now = spark.read.schema(now.schema).parquet(folders[-1])
        further = now.select(F.col("number").alias("at"), F.col("root").alias("further"))
        joined = now.join(further, F.col("root") == F.col("at"), "left")
        if joined.where("further IS NOT NULL").isEmpty():
            return now
        now = joined.select("number", "form", F.coalesce("further", "root").alias("root"))


def group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", params: Params = Params()) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word."""
    order: list[Column] = [F.desc("n"), F.asc("word")]
    numbered = stored(positions(words(docs, doc_id, text, params), [], order, "number"), "words")
    found = stored(neighbours(rotations(numbered)), "neighbours")
    named = numbered.select(F.col("number").alias("near"), F.col("n").alias("near_n"))
    with_near = numbered.select("number", "n").join(found, "number").join(named, "near")
    links = with_near.where(F.col("near_n") >= params.times * F.col("n")).select("number", F.col("near").alias("form"))
    folders: list[str] = []
    roots = stored(_roots(links, folders), "linked")
    for folder in folders:
        discard(docs.sparkSession, folder)
    forms = numbered.select(F.col("number").alias("form"), F.col("word").alias("form_word"), F.col("n").alias("form_n"))
    ends = numbered.select(F.col("number").alias("root"), F.col("word").alias("root_word"))
    linked = roots.join(forms, "form").join(ends, "root").select("number", "form_word", "form_n", "root_word")
    return numbered.join(found.select("number", "n_near"), "number", "left").join(linked, "number", "left").select(
        "word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n",
    )
