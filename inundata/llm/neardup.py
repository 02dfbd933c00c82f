"""Near-duplicate vectors by collision-counting projections.

Vectors that are equal are one class first. One-dimensional windows alone hold a third of all
vectors at the width that near duplicates need, so counting their collisions over the whole table
would list a share of all pairs, whatever the number of lines. Windows are therefore taken inside
blocks: the signs of some projections, in several tables, so that blocks stay small as the table
grows. In a block the classes are sorted along a line, each takes the window of projections around
its own, and collisions in such windows are counted per pair over the counting lines. Pairs whose
count reaches a number calibrated for the wanted recall are verified in double precision. A pair is
looked at only in the first table that has it in one block, so links are counted per class without
listing the pairs of a large group. All blocks of a batch go through numpy together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inundata.llm.components import connected_components
from inundata.llm.text import cut, shuffle_width


@dataclass(frozen=True)
class NearParams:
    cosine: float = 0.95
    #: Chance, at the threshold, that a pair meets in no block, falls out of its window or collides too seldom.
    miss: float = 0.002
    #: Lines that count collisions, and the width of their windows in deviations at the threshold.
    counting: int = 24
    width: float = 2.0
    #: Signs that make a block: log2 of the number of classes plus this, within these bounds (the
    #: upper one is what a 64-bit key holds, for 2^64 classes).
    extra_signs: int = -4
    least_signs: int = 4
    most_signs: int = 60
    #: Classes of one block; larger ones are split into pairs of parts.
    block: int = 2048
    #: Pairs that one step looks at, about.
    pairs: int = 200_000
    seed: int = 11


@lru_cache(maxsize=8)
def _lines(dim: int, count: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim, count]).standard_normal((dim, count))


def tables_needed(p: NearParams, signs: int) -> int:
    """Tables so that a pair at the threshold shares a block in one, but for a third of ``miss``."""
    meet = (1 - math.acos(p.cosine) / math.pi) ** signs
    return max(1, math.ceil(math.log(p.miss / 3) / math.log(1 - meet)))


def calibrated_count(p: NearParams) -> int:
    """Largest count that a pair at the threshold reaches but for a third of ``miss``.

    At the threshold a projected difference is normal, so one window holds the other vector with
    a known probability, and the count is binomial.
    """
    one = math.erf(p.width / math.sqrt(2))
    tail = 0.0
    for k in range(p.counting + 1):
        tail += math.comb(p.counting, k) * one**k * (1 - one) ** (p.counting - k)
        if tail > p.miss / 3:
            return k
    return p.counting


def usable(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """id, vec (array<double>) of vectors that are neither null, zero, nor hold odd components."""
    v = F.col("vec")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    flat = vectors.select(vectors[id_col].alias("id"), vectors[vector].cast("array<double>").alias("vec"))
    return flat.where(v.isNotNull() & (F.size(v) > 0) & ~odd & F.exists(v, lambda x: x != 0))


def _units(packed: list[bytes], dim: int) -> np.ndarray:
    """Vectors of length one; scaled by their largest component first, so that no square overflows."""
    x = np.frombuffer(b"".join(packed), dtype="<f8" if len(packed[0]) == 8 * dim else "<f4").reshape(len(packed), dim).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _linked(rows: dict[str, np.ndarray], unit: np.ndarray, keys: np.ndarray, p: NearParams) -> tuple[np.ndarray, np.ndarray]:
    """links, label: for each row of some blocks the vectors that link with it, and a row that its links lead to.

    ``rows``: block (ascending), t, split, sub, copies. Pairs that share a key of an earlier table
    than theirs are left to that table.
    """
    dim, need = unit.shape[1], calibrated_count(p)
    near = math.sqrt(2 - 2 * p.cosine)
    reach, first_reach = p.width * near, NormalDist().inv_cdf(1 - p.miss / 6) * near
    places = unit @ _lines(dim, p.counting + 1, p.seed + 1)
    order = np.lexsort((places[:, 0], rows["block"]))
    places, keys, unit = places[order], keys[order], unit[order]
    t, split, sub, copies, block = (rows[c][order] for c in ("t", "split", "sub", "copies", "block"))
    # the window of each row along the sorted line, inside its block
    spread = 2 * np.abs(places[:, 0]).max() + first_reach + 1
    line = block * spread + places[:, 0]
    stop = np.searchsorted(line, line + first_reach, side="right")
    count = stop - np.arange(len(line)) - 1
    total = np.concatenate([[0], np.cumsum(count)])
    links, label = np.zeros(len(line)), np.arange(len(line))
    at = 0
    while at < len(line):
        end = max(at + 1, int(np.searchsorted(total, total[at] + p.pairs, side="right")) - 1)
        q = np.repeat(np.arange(at, end), count[at:end])
        c = q + 1 + np.arange(len(q)) - (total[q] - total[at])
        at = end
        keep = ~split[q] | (sub[q] != sub[c])
        q, c = q[keep], c[keep]
        for k in range(int(t.max(initial=0))):
            keep = (t[q] <= k) | (keys[q, k] != keys[c, k])
            q, c = q[keep], c[keep]
        seen = np.zeros(len(q), dtype=np.int16)
        for k in range(p.counting):
            seen += np.abs(places[q, k + 1] - places[c, k + 1]) <= reach
            if k % 6 == 5:  # those that can't reach the count any more go
                keep = seen + (p.counting - 1 - k) >= need
                q, c, seen = q[keep], c[keep], seen[keep]
        close = [np.einsum("ij,ij->i", unit[q[x : x + 20_000]], unit[c[x : x + 20_000]]) >= p.cosine for x in range(0, len(q), 20_000)]
        keep = np.concatenate(close) if close else np.zeros(0, dtype=bool)
        q, c = q[keep], c[keep]
        links += np.bincount(q, weights=copies[c], minlength=len(line)) + np.bincount(c, weights=copies[q], minlength=len(line))
        while len(q):
            least = np.minimum(label[q], label[c])
            np.minimum.at(label, label[q], least)
            np.minimum.at(label, label[c], least)
            label = label[label]
            apart = label[q] != label[c]
            q, c = q[apart], c[apart]
    while (label != label[label]).any():
        label = label[label]
    back_links, back_label = np.empty(len(line), dtype=np.int64), np.empty(len(line), dtype=np.int64)
    back_links[order], back_label[order] = links.astype(np.int64), order[label]
    return back_links, back_label


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", p: NearParams = NearParams()) -> DataFrame:
    """id, n_links, component_id, kept: one row per input row, whatever its vector.

    Null, zero and non-finite vectors link with nothing. Vectors of another dimension link only
    among themselves. Equal vectors are linked with each other; repeated rows count each for
    itself. A null id links by its vector but names no component. A cosine at the threshold, as
    doubles give it, is a link. Very large components don't overflow. Columns beside the two named
    ones are not read, whatever their names. An empty table gives an empty table.
    """
    spark = vectors.sparkSession
    narrow = vectors.schema[vector].dataType.simpleString() == "array<float>"

    def cls_of(v):
        return F.concat_ws(":", F.xxhash64(v), F.xxhash64(F.lit(3), v))

    good = usable(vectors, id_col, vector).withColumn("cls", cls_of(F.col("vec")))
    classes = cut(
        good.groupBy("cls").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("vec").alias("vec")).withColumn("node", F.monotonically_increasing_id())
    )
    total = classes.count()
    signs = int(min(p.most_signs, max(p.least_signs, math.ceil(math.log2(max(2, total))) + p.extra_signs)))
    tables = tables_needed(p, signs)
    kind = "<f4" if narrow else "<f8"

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The sign blocks of each class, one number per table."""
        powers = np.left_shift(np.int64(1), np.arange(signs, dtype=np.int64))
        for pdf in batches:
            for dim, same in pdf.groupby(pdf["vec"].map(len), sort=False):
                x = np.stack(same["vec"].tolist()).astype(np.float64)
                signed = (x / np.abs(x).max(axis=1, keepdims=True)) @ _lines(int(dim), signs * tables, p.seed) > 0
                out = signed.reshape(len(x), tables, signs) @ powers
                yield pd.DataFrame({"node": same["node"], "copies": same["copies"], "keys": list(out), "packed": [row.tobytes() for row in x.astype(kind)]})

    packed = cut(classes.select("node", "copies", "vec").mapInPandas(keyed, "node long, copies long, keys array<long>, packed binary"))
    spots = packed.select("node", F.posexplode("keys").alias("t", "key"))
    sizes = spots.groupBy("t", "key").agg(F.count("*").alias("c")).where("c > 1")
    parts = F.ceil(F.col("c") / p.block).cast("int")
    spread = (
        spots.join(sizes, ["t", "key"])
        .withColumn("sub", F.pmod(F.xxhash64("node"), parts).cast("int"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), parts - 1)))
        .select("node", "t", "key", "sub", F.least("sub", "with").alias("i"), F.greatest("sub", "with").alias("j"))
    )

    def linked(pdf: pd.DataFrame, block: np.ndarray) -> Iterator[pd.DataFrame]:
        """What the blocks of some whole rows give; vectors of each dimension apart."""
        lengths = pdf["packed"].map(len).to_numpy() // np.dtype(kind).itemsize
        for dim in np.unique(lengths).tolist():
            of = np.flatnonzero(lengths == dim)
            same = pdf.iloc[of]
            rows = {"block": block[of], "t": same["t"].to_numpy(), "split": (same["i"] != same["j"]).to_numpy(), "sub": same["sub"].to_numpy(), "copies": same["copies"].to_numpy()}
            links, label = _linked(rows, _units(same["packed"].tolist(), dim), np.stack(same["keys"].tolist()), p)
            node = same["node"].to_numpy()
            counted, joined = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(label)))
            yield pd.DataFrame({"a": node[counted], "b": pd.array([None] * len(counted), dtype="Int64"), "n": links[counted]})
            yield pd.DataFrame({"a": node[joined], "b": pd.array(node[label[joined]], dtype="Int64"), "n": np.zeros(len(joined), dtype=np.int64)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, by = None, ["t", "key", "i", "j"]
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            values = pdf[by].to_numpy()
            block = np.concatenate([[0], np.cumsum((values[1:] != values[:-1]).any(axis=1))])
            whole = int(np.searchsorted(block, block[-1]))
            held = pdf.iloc[whole:]
            if whole:
                yield from linked(pdf.iloc[:whole], block[:whole])
        if held is not None and len(held):
            yield from linked(held, np.zeros(len(held), dtype=np.int64))

    found = cut(
        spread.join(packed, "node")
        .repartition(shuffle_width(spark), "t", "key", "i", "j")
        .sortWithinPartitions("t", "key", "i", "j", "node")
        .mapInPandas(run, "a long, b long, n long")
    )
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    slim = classes.select("node", "cls", "rep", "copies")
    comps = connected_components(found.where("b is not null"))
    least = (
        slim.join(comps, "node").groupBy("component").agg(F.min("rep").alias("first")).join(comps, "component").select("node", "first")
    )
    known = (
        slim.join(counts, "node", "left")
        .join(least, "node", "left")
        .select("cls", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("first", "rep").alias("comp"))
    )
    return (
        vectors.select(vectors[id_col].alias("id"), cls_of(F.col(vector).cast("array<double>")).alias("cls"))
        .join(known, "cls", "left")
        .select(
            F.col("id").alias(id_col),
            F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("comp", "id").alias("component_id"),
            F.coalesce(F.coalesce("comp", "id") == F.col("id"), F.lit(True)).alias("kept"),
        )
    )
