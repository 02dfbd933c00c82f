"""Running sums and chains over sorted rows, in ranges instead of one task.

Rows are sorted into ranges of about equal numbers, whatever the keys. A range needs one thing from
those before it: the sum, or the last kept time, that its first key brings along. What ranges hand
on is small, one row each, and is worked out range after range or, for chains, by composing what
each range does to what comes in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inundata.sources.folders import cut

_PART = "_part"


def sorted_ranges(df: DataFrame, by: list[Column | str], ranges: int | None = None) -> DataFrame:
    """``df`` with ``_part``, the number of its range; ranges follow each other in the order of ``by``.

    Written, as ranges are drawn from a sample and must not be drawn again.
    """
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn(_PART, F.spark_partition_id()))


def running_sums(df: DataFrame, order: list[str], sums: dict[str, Column], keys: tuple[str, ...] = (), ranges: int | None = None) -> DataFrame:
    """``df`` with running sums (of whole numbers) over ``keys`` in ``order``, each row's own included.

    Equal places have each the sum of some of them, as with a window of rows. Only one row a range
    reaches the driver: its first and last keys, and the sums over the last one.
    """
    spark = df.sparkSession
    marks = [F.col(k).isNull().alias(f"_null{i}") for i, k in enumerate(keys)]
    # nulls sort first within a key column; the ranges only need equal keys side by side
    ranged = sorted_ranges(df.withColumns({f"_{name}": c for name, c in sums.items()}), [*keys, *order], ranges)
    key = F.to_json(F.struct(*keys, *marks)) if keys else F.lit("")
    at = F.struct(*keys) if keys else F.lit(0)
    whole = ranged.groupBy(_PART, *keys).agg(*[F.sum(f"_{name}").alias(name) for name in sums]).withColumns({"_key": key, "_at": at})
    rows = whole.groupBy(_PART).agg(
        F.min_by("_key", "_at").alias("_first"), F.max_by("_key", "_at").alias("_last"), F.count("*").alias("_rows"), *[F.max_by(name, "_at").alias(name) for name in sums]
    ).collect()
    carried, carry, before = [], dict.fromkeys(sums, 0), None
    for r in sorted(rows, key=lambda r: r[_PART]):
        if r["_first"] != before:
            carry = dict.fromkeys(sums, 0)
        carried.append((r[_PART], r["_first"], *carry.values()))
        carry = {name: (carry[name] if r["_rows"] == 1 else 0) + (r[name] or 0) for name in sums}
        before = r["_last"]
    table = spark.createDataFrame(carried, f"{_PART} int, _first string, " + ", ".join(f"`_c_{name}` long" for name in sums))
    up = Window.partitionBy(_PART, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = ranged.withColumns({name: F.sum(f"_{name}").over(up) for name in sums}).withColumn("_key", key).join(F.broadcast(table), _PART)  # one row a range
    more = {name: (F.col(name) + F.when(F.col("_key") == F.col("_first"), F.col(f"_c_{name}")).otherwise(0)).cast("long") for name in sums}
    return own.withColumns(more).select(*df.columns, *sums)


# -- chains ------------------------------------------------------------------------------------


class Passage:
    """What a range does to the last time kept before it: ``key`` and ``at``/``out`` of its first key.

    A time kept before at c leads to the first time of the range at or after c + gap (``at``), and from
    there on to the last one kept (``out``); when there is none, c itself stays the last. ``fixed``
    says that the range ends with another chain, whose last time doesn't depend on c.
    """

    def __init__(self, first: int, last: int, at: np.ndarray, out: np.ndarray, fixed: int | None):
        self.first, self.last, self.at, self.out, self.fixed = first, last, at, out, fixed

    def after(self, key: int | None, c: np.ndarray, gap: int) -> np.ndarray:
        """Last times kept after the range, for times ``c`` kept before under ``key``."""
        if self.fixed is not None:
            return np.full(len(c), self.fixed)
        i = np.zeros(len(c), dtype=np.int64) if key != self.first else np.searchsorted(self.at, c + gap)
        return np.where(i < len(self.at), self.out[np.minimum(i, len(self.at) - 1)], c)

    def then(self, other: Passage, gap: int) -> Passage:
        """This range and then the other as one."""
        if self.fixed is not None:
            return Passage(self.first, other.last, self.at[:0], self.out[:0], int(other.after(self.last, np.array([self.fixed]), gap)[0]))
        if other.fixed is not None:
            return Passage(self.first, other.last, self.at[:0], self.out[:0], other.fixed)
        if other.first != self.last:
            return Passage(self.first, other.last, self.at[:0], self.out[:0], int(other.out[0]))
        late = other.at > self.at[-1]
        return Passage(self.first, other.last, np.concatenate([self.at, other.at[late]]), np.concatenate([other.after(self.last, self.out, gap), other.out[late]]), None)

    def row(self) -> dict:
        return {"first": self.first, "last": self.last, "at": self.at.tolist(), "out": self.out.tolist(), "fixed": self.fixed}

    @staticmethod
    def of(r) -> Passage:
        return Passage(int(r["first"]), int(r["last"]), np.asarray(r["at"], dtype=np.int64), np.asarray(r["out"], dtype=np.int64), None if pd.isna(r["fixed"]) else int(r["fixed"]))


_PASSAGE = "first long, last long, at array<long>, out array<long>, fixed long"


def passage(key: np.ndarray, u: np.ndarray, gap: int) -> Passage:
    """Of sorted times ``u`` under keys that stand side by side."""
    breaks = np.flatnonzero((key[1:] != key[:-1]) | (u[1:] - u[:-1] >= gap)) + 1
    last = int(key[-1])
    if len(breaks):  # a new chain begins inside: only its own end is handed on
        tail = u[breaks[-1] :]
        return Passage(int(key[0]), last, u[:0], u[:0], int(tail[kept(tail, 0, gap)][-1]))
    after = np.searchsorted(u, u + gap)
    # from the last time back: the end of the chain that each time begins
    end = np.arange(len(u))
    for i in range(len(u) - 1, -1, -1):
        if after[i] < len(u):
            end[i] = end[after[i]]
    entries = int(np.searchsorted(u, u[0] + gap)) + 1
    return Passage(int(key[0]), last, u[:entries], u[end[:entries]], None)


def kept(u: np.ndarray, start: int, gap: int) -> np.ndarray:
    """Places of a chain in sorted times: ``start``, then the first time at least ``gap`` later, and so on."""
    after, out, i = np.searchsorted(u, u + gap).tolist(), [], start
    while i < len(u):
        out.append(i)
        i = after[i]
    return np.array(out, dtype=np.int64)


def _whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    found = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(found) if found else None


def chain(times: DataFrame, keys: tuple[str, ...], at: str, gap: int, ranges: int | None = None, fan: int = 16) -> DataFrame:
    """keys, ``at`` of the times kept: the first of each key, then the first at least ``gap`` after the last kept.

    ``times``: keys, ``at`` (long), distinct. A task holds one range. Ranges are composed ``fan`` at
    a time, level by level, and what comes into each is then handed down the same way.
    """
    ranged = sorted_ranges(times.select(*keys, at).withColumn("_k", F.xxhash64(*keys) if keys else F.lit(0).cast("long")), [*keys, at], ranges)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _whole(batches)
        if table is not None:
            p = passage(table["_k"].to_numpy(), table[at].to_numpy(), gap)
            row = {"node": table[_PART][0].as_py(), **p.row()}
            kinds = pa.schema([("node", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("at", pa.list_(pa.int64())), ("out", pa.list_(pa.int64())), ("fixed", pa.int64())])
            yield pa.RecordBatch.from_pylist([row], schema=kinds)

    def composed(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("node")
        made = None
        for _, r in rows.iterrows():
            made = Passage.of(r) if made is None else made.then(Passage.of(r), gap)
        return pd.DataFrame([{"node": int(rows["node"].iloc[0]) // fan, **made.row()}]).assign(fixed=pd.array([made.fixed], dtype="Int64"))

    def handed(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, out = pdf.sort_values("node"), []
        key, c = (None if pd.isna(rows["key"].iloc[0]) else int(rows["key"].iloc[0])), rows["c"].iloc[0]
        c = 0 if key is None else int(c)
        for _, r in rows.iterrows():
            p = Passage.of(r)
            out.append((int(r["node"]), key, c if key is not None else None))
            # with nothing before, the first time of the range is kept
            c = int(p.after(key, np.array([c]), gap)[0])
            key = p.last
        node, key_, c_ = zip(*out, strict=True)
        return pd.DataFrame({"node": node, "key": pd.array(key_, dtype="Int64"), "c": pd.array(c_, dtype="Int64")})  # not by way of doubles

    levels = [cut(ranged.mapInArrow(summed, f"node long, {_PASSAGE}"))]
    while levels[-1].count() > fan:
        levels.append(cut(levels[-1].groupBy(F.floor(F.col("node") / fan)).applyInPandas(composed, f"node long, {_PASSAGE}")))
    coming = None
    for level in reversed(levels):
        up = F.floor(F.col("node") / fan).alias("up")
        if coming is None:
            grouped = level.withColumns({"up": F.lit(0).cast("long"), "key": F.lit(None).cast("long"), "c": F.lit(None).cast("long")})
        else:
            grouped = level.withColumn("up", up).join(coming.withColumnRenamed("node", "up"), "up")
        coming = cut(grouped.groupBy("up").applyInPandas(handed, "node long, key long, c long"))
    entering = ranged.join(coming.select(F.col("node").cast("int").alias(_PART), "key", "c"), _PART).repartition(F.col(_PART)).sortWithinPartitions(_PART, *keys, at)

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _whole(batches)
        if table is None:
            return
        parts = table[_PART].to_numpy()
        starts = np.concatenate([[0], np.flatnonzero(parts[1:] != parts[:-1]) + 1, [len(parts)]])
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            part = table.slice(a, b - a)
            key, u = part["_k"].to_numpy(), part[at].to_numpy()
            known, c = part["key"][0].as_py(), part["c"][0].as_py()
            breaks = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]) | (u[1:] - u[:-1] >= gap)) + 1, [len(u)]]).tolist()
            places = []
            for i, (x, y) in enumerate(zip(breaks[:-1], breaks[1:], strict=True)):
                own = u[x:y]
                start = int(np.searchsorted(own, c + gap)) if i == 0 and known == key[0] else 0
                places.append(x + kept(own, start, gap))
            yield from part.select([*keys, at]).take(pa.array(np.concatenate(places))).to_batches()

    schema = times.select(*keys, at).schema
    return entering.mapInArrow(thin, schema)
