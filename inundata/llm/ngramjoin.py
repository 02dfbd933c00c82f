"""Exact-threshold Jaccard self-join of word shingles with count-vector R-trees.

Shingle hashes fall into groups. Documents that could link share whole groups: with groups of
about five shingles, a pair at the threshold agrees on any one group with probability 0.26 to 0.4,
independently of the data, and every document shows 48 of them, so a link at exactly the threshold
stays unseen with a probability below 1e-6, and a closer one with far less. Documents that share a group form a bucket. Identical sets are one
class first, so copies cost nothing; in each bucket the classes are first compared with its most
typical member only, and buckets whose members are then all of one component are done. The others
go through R-trees on count vectors: each class is the point of its shingle counts per group, a
node keeps coordinate maxima, and the summed coordinate minima of a query and a node bound every
overlap below it. Pairs that survive are verified on their shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inundata.llm.components import connected_components, tasks_for
from inundata.llm.text import cut, shuffle_width

#: Groups of a count vector: the second number for sets of ``LONG`` shingles or more. Vectors of
#: both lengths in one block are folded to the shorter.
GROUPS, LONG_GROUPS, LONG = 256, 1024, 1000
_U = np.uint64


@dataclass(frozen=True)
class JoinParams:
    words: int = 5
    #: Links: ``percent`` of the union's size, at least.
    percent: int = 80
    #: Group agreements that a document shows, at least.
    shown: int = 48
    #: Shingles of a group, about.
    per_group: float = 5.0
    #: Classes of one R-tree; larger buckets are split into pairs of blocks.
    block: int = 4096
    #: Agreements that a class and a centre share before they are compared in a star round. Pairs
    #: left out there stay for the R-trees, which compare whatever the rounds leave.
    least_shared: int = 2
    #: Another star round follows while this many pairs per row are left in buckets and the round
    #: before linked this share of what it compared.
    left_per_row: float = 200.0
    least_yield: float = 0.005
    #: Members of a hub that one task verifies.
    per_hub: int = 256


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 (fixed constants)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_STEP = _U(0x9E3779B97F4A7C15)
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * _STEP)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64, n of each at least."""
    if len(_POWERS[0]) < n:
        base = 0xD1342543DE82EF95
        for k, b in enumerate((base, pow(base, -1, 1 << 64))):
            row = np.full(max(n, 1 << 20), b, dtype=np.uint64)
            row[0] = 1
            _POWERS[k] = np.cumprod(row, dtype=np.uint64)
    return _POWERS


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of ``text`` (A-Z in lower case)."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), dtype=np.uint8)
    if not len(raw):
        return np.zeros(0, dtype=np.uint64)
    edge = np.diff(np.concatenate(([True], _SPACE[raw], [True])).view(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    power, inverse = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * power[: len(raw)], out=sums[1:])
    word = mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    width = min(words, len(word))
    total = np.full(len(word) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        total = mixed(total * _STEP + word[k : len(word) - width + 1 + k])
    return np.unique(total)


#: Lower ends of size classes: each 1.5 times the one before.
_CLASSES = np.array([int(np.ceil(1.5**j)) for j in range(70)], dtype=np.float64)


def agreements(shingles: np.ndarray, p: JoinParams) -> np.ndarray:
    """Keys of the groups of one set, for its size class and for the next if a partner may be there.

    Sets of three shingles or fewer link only with identical sets and show none.
    """
    n = len(shingles)
    if n < 4:
        return np.zeros(0, dtype=np.uint64)
    at = int(np.searchsorted(_CLASSES, n, side="right")) - 1
    out = []
    for j in (at, at + 1):
        if j > at and n * 100 < _CLASSES[j] * p.percent:
            break
        k = max(2, round(1.5 ** (j + 0.5) / p.per_group))
        rounds = max(1, -(-p.shown // k))
        seeds = mixed(np.arange(1, rounds + 1, dtype=np.uint64) * _STEP + _U(j))
        spread = mixed(shingles[None, :] ^ seeds[:, None])
        group = ((spread >> _U(32)) * _U(k)) >> _U(32)
        place = (group + np.arange(rounds, dtype=np.uint64)[:, None] * _U(k)).astype(np.int64).ravel()
        values = spread.ravel()
        if k > p.shown:
            keep = place < p.shown
            place, values = place[keep], values[keep]
        own = mixed(values)
        shown = p.shown if k > p.shown else rounds * k
        count = np.bincount(place, minlength=shown)
        # sums of 32-bit halves are exact in doubles
        low = np.bincount(place, weights=(own & _U(0xFFFFFFFF)).astype(np.float64), minlength=shown).astype(np.uint64)
        high = np.bincount(place, weights=(own >> _U(32)).astype(np.float64), minlength=shown).astype(np.uint64)
        key = mixed(low + mixed(high) + mixed(np.arange(shown, dtype=np.uint64) + _U(j << 32)))
        out.append(key[count > 0])
    return np.concatenate(out)


def count_vector(shingles: np.ndarray) -> np.ndarray:
    groups, kind = (LONG_GROUPS, "<u4") if len(shingles) >= LONG else (GROUPS, "<u2")
    return np.bincount((mixed(shingles ^ _STEP) & _U(groups - 1)).astype(np.int64), minlength=groups).astype(kind)


def stacked(vectors: list[bytes]) -> np.ndarray:
    """Count vectors as rows of one matrix, folded to one length."""
    short = GROUPS * 2
    if any(len(v) == short for v in vectors):
        rows = [np.frombuffer(v, "<u2") if len(v) == short else np.frombuffer(v, "<u4").reshape(-1, GROUPS).sum(axis=0) for v in vectors]
        return np.stack(rows).astype(np.int32)
    return np.frombuffer(b"".join(vectors), "<u4").reshape(len(vectors), -1).astype(np.int32)


class CountTree:
    """An R-tree over count vectors, packed from points ordered by size and leading counts."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, fan: int = 8):
        self.order = np.lexsort((*[points[:, k] for k in range(3)], sizes))
        self.fan = fan
        tops, least = [points[self.order]], [sizes[self.order]]
        while len(tops[-1]) > fan:
            cuts = np.arange(0, len(tops[-1]), fan)
            tops.append(np.maximum.reduceat(tops[-1], cuts, axis=0))
            least.append(np.minimum.reduceat(least[-1], cuts))
        self.tops, self.least = tops, least

    def search(self, points: np.ndarray, sizes: np.ndarray, percent: int, chunk: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, point) index pairs whose bound reaches the threshold."""
        per = max(1, chunk // max(1, len(self.tops[-1])))
        for at in range(0, len(points), per):
            q = np.arange(at, min(at + per, len(points)))
            query, node = np.repeat(q, len(self.tops[-1])), np.tile(np.arange(len(self.tops[-1])), len(q))
            for level in range(len(self.tops) - 1, -1, -1):
                keep = []
                for c in range(0, len(query), chunk):
                    qs, ns = query[c : c + chunk], node[c : c + chunk]
                    bound = np.minimum(points[qs], self.tops[level][ns]).sum(axis=1, dtype=np.int64)
                    keep.append((100 + percent) * bound >= percent * (sizes[qs] + self.least[level][ns]))
                kept = np.concatenate(keep) if keep else np.zeros(0, bool)
                query, node = query[kept], node[kept]
                if level:
                    below = len(self.tops[level - 1])
                    node = (node[:, None] * self.fan + np.arange(self.fan)).ravel()
                    query = np.repeat(query, self.fan)
                    query, node = query[node < below], node[node < below]
            yield query, self.order[node]


def identity(id_col: Column, text: Column) -> Column:
    """What a row is known by: a struct of its id and a hash of its text, never null itself.

    Structs of equal fields are equal, nulls included. Those with an id come before those without.
    """
    return F.struct(id_col.isNull().alias("unnamed"), id_col.cast("long").alias("id"), F.xxhash64(text).alias("text_hash"))


def _class_hash(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _sets(docs: DataFrame, id_col: str, text: str, p: JoinParams) -> DataFrame:
    """doc (identity), n, cls (128-bit hash of the set), keys (agreements)."""
    slim = docs.select(docs[id_col].cast("long").alias("id"), F.xxhash64(docs[text]).alias("text_hash"), docs[text].alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n, cls, keys = [], [], []
            for value in pdf["text"]:
                s = shingle_set(value, p.words)
                n.append(len(s))
                cls.append(_class_hash(s))
                keys.append(np.unique(agreements(s, p)).view(np.int64))
            yield pd.DataFrame({"id": pdf["id"].astype("Int64"), "text_hash": pdf["text_hash"], "n": n, "cls": cls, "keys": keys})

    made = slim.mapInPandas(run, "id long, text_hash long, n int, cls binary, keys array<long>")
    return made.select(_known().alias("doc"), "n", "cls", "keys")


def _known() -> Column:
    """The identity from columns ``id`` and ``text_hash``."""
    return F.struct(F.col("id").isNull().alias("unnamed"), F.col("id"), F.col("text_hash"))


def _stored(docs: DataFrame, wanted: DataFrame, id_col: str, text: str, p: JoinParams) -> DataFrame:
    """node, n, vec, packed: what bounds and verification need of each wanted class (node, rep)."""
    slim = docs.select(docs[id_col].cast("long").alias("id"), F.xxhash64(docs[text]).alias("text_hash"), docs[text].alias("text"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = zstandard.ZstdCompressor(level=1)
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"].astype("Int64"), "text_hash": pdf["text_hash"], "packed": [packer.compress((t or "").encode("utf-8", "replace")) for t in pdf["text"]]})

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [shingle_set(zstandard.decompress(packed).decode(), p.words) for packed in pdf["packed"]]
            same = [_class_hash(s) == bytes(cls) for s, cls in zip(sets, pdf["cls"], strict=True)]
            out = pdf.assign(n=[len(s) for s in sets], vec=[count_vector(s).tobytes() for s in sets])
            yield out.loc[np.array(same, dtype=bool), ["node", "n", "vec", "packed"]]

    packed = slim.mapInPandas(pack, "id long, text_hash long, packed binary").join(wanted, _known() == F.col("rep")).select("node", "cls", "packed")
    return packed.mapInPandas(measure, "node long, n int, vec binary, packed binary").dropDuplicates(["node"])


def _verified(pairs: DataFrame, stored: DataFrame, p: JoinParams) -> DataFrame:
    """The pairs (a, b: node) that link, checked on their shingle sets.

    Of each pair the node with more pairs is the hub. A member's text goes to its hub, and a hub's
    text once to each task that has some of its members, which are dealt ``per_hub`` to a part; so
    no node is one key, and no text is sent with every pair.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hub, n, own, text = None, 0, None, b""
        for pdf in batches:
            ok = np.zeros(len(pdf), dtype=bool)
            for k, (h, role, m, packed) in enumerate(zip(pdf["hub"], pdf["role"], pdf["n"], pdf["packed"], strict=True)):
                if role == 0:
                    hub, n, own, text = h, m, None, packed
                elif h == hub and m * 100 >= n * p.percent and n * 100 >= m * p.percent:
                    if own is None:
                        own = shingle_set(zstandard.decompress(text).decode(), p.words)
                    other = shingle_set(zstandard.decompress(packed).decode(), p.words)
                    both = len(np.intersect1d(own, other, assume_unique=True))
                    ok[k] = (100 + p.percent) * both >= p.percent * (len(own) + len(other))
            linked = pdf.loc[ok, ["hub", "node"]]
            yield pd.DataFrame({"a": np.minimum(linked["hub"], linked["node"]), "b": np.maximum(linked["hub"], linked["node"])})

    degree = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("d"))
    known = pairs.join(degree.select(F.col("node").alias("a"), F.col("d").alias("da")), "a").join(degree.select(F.col("node").alias("b"), F.col("d").alias("db")), "b")
    first = F.col("da") > F.col("db")
    turned = known.select(
        F.when(first, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("node"), F.greatest("da", "db").alias("d")
    )
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("d") / p.per_hub)).cast("int")
    dealt = turned.select("hub", "node", part.alias("part"))
    texts = stored.select("node", "n", "packed")
    members = dealt.join(texts, "node").select("hub", "part", F.lit(1).alias("role"), "node", "n", "packed")
    hubs = dealt.select("hub", "part").distinct().join(texts.withColumnRenamed("node", "hub"), "hub").select("hub", "part", F.lit(0).alias("role"), F.col("hub").alias("node"), "n", "packed")
    rows = members.unionByName(hubs).repartition(shuffle_width(pairs.sparkSession), "hub", "part").sortWithinPartitions("hub", "part", "role")
    return rows.mapInPandas(run, "a long, b long")


def _tree_pairs(rows: DataFrame, p: JoinParams) -> DataFrame:
    """Pairs of classes of different components whose count vectors allow a link.

    ``rows``: key, i, j, sub, node, n, comp, vec; all rows of (key, i, j) are one block.
    """

    columns = ("key", "i", "j", "sub", "node", "n", "comp")

    def block(c: dict[str, np.ndarray], vectors: list[bytes], found: list[np.ndarray]) -> None:
        node, comp, n, sub = c["node"], c["comp"], c["n"], c["sub"]
        if len(node) < 2 or (comp == comp[0]).all():
            return
        cross = c["i"][0] != c["j"][0]

        def wanted(q: np.ndarray, t: np.ndarray) -> np.ndarray:
            keep = (node[q] < node[t]) & (comp[q] != comp[t])
            return keep & (sub[q] != sub[t]) if cross else keep

        vec = stacked(vectors)
        if len(node) <= 48:  # a tree of one leaf
            q, t = (x.ravel() for x in np.indices((len(node), len(node))))
            keep = wanted(q, t)
            q, t = q[keep], t[keep]
            bound = np.minimum(vec[q], vec[t]).sum(axis=1)
            keep = (100 + p.percent) * bound >= p.percent * (n[q] + n[t])
            found.append(np.stack([node[q[keep]], node[t[keep]]], axis=1))
            return
        for q, t in CountTree(vec, n).search(vec, n, p.percent, 20_000):
            keep = wanted(q, t)
            found.append(np.stack([node[q[keep]], node[t[keep]]], axis=1))

    def pairs(found: list[np.ndarray]) -> pd.DataFrame:
        out = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), dtype=np.int64)
        return pd.DataFrame(out, columns=["a", "b"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] | None = None
        held_vectors: list[bytes] = []
        found: list[np.ndarray] = []
        for pdf in batches:
            c, vectors = {k: pdf[k].to_numpy() for k in columns}, held_vectors + pdf["vec"].tolist()
            if held is not None:
                c = {k: np.concatenate([held[k], c[k]]) for k in columns}
            new = (np.diff(c["key"]) != 0) | (np.diff(c["i"]) != 0) | (np.diff(c["j"]) != 0)
            cuts = np.concatenate([[0], np.flatnonzero(new) + 1])
            for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
                block({k: v[start:stop] for k, v in c.items()}, vectors[start:stop], found)
                if len(found) > 500:
                    yield pairs(found)
                    found = []
            held, held_vectors = {k: v[cuts[-1] :] for k, v in c.items()}, vectors[cuts[-1] :]
        if held is not None:
            block(held, held_vectors, found)
        yield pairs(found)

    width = shuffle_width(rows.sparkSession)
    parted = rows.repartition(width, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return parted.mapInPandas(run, "a long, b long").distinct()


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", p: JoinParams = JoinParams()) -> DataFrame:
    """id, n_shingles, component_id: components of documents that link.

    Null and blank texts have no shingles and link with nothing: they are their own component.
    Repeated rows give repeated rows. A null id never names a component that has another, and a
    component of documents without ids has a null one. An empty table gives an empty table. A very
    long text is one set of all its shingles. Ids are whole numbers; a text id fails the job. Columns
    beside the two named ones are not read, whatever their names.
    """
    return jaccard_groups(docs, id_col, text, p).select(
        F.col("doc.id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.col("component.id").alias("component_id")
    )


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", p: JoinParams = JoinParams()) -> DataFrame:
    """doc, n, component: for each row its :func:`identity`, shingles, and the least identity of its component.

    Rows without ids, and different texts under one id, link and are told apart like any others.
    """
    base = cut(_sets(docs, id_col, text, p))
    # copies are one class from here on; classes get numbers, which are shorter than their hashes
    classes = cut(
        base.where("n > 0").groupBy("cls").agg(F.min("doc").alias("rep"), F.first("keys").alias("keys")).withColumn("node", F.monotonically_increasing_id())
    )
    buckets = _buckets(classes)
    stored = cut(_stored(docs, buckets.select("node").distinct().join(classes.select("node", "cls", "rep"), "node"), id_col, text, p))
    comps = _linked(buckets, stored, p)
    named = comps.join(classes.select("node", "rep"), "node").select("node", "component", "rep")
    least = named.groupBy("component").agg(F.min("rep").alias("first"))
    firsts = named.join(least, "component").select("node", "first")
    known = classes.select("node", "cls", "rep").join(firsts, "node", "left").select("cls", F.coalesce("first", "rep").alias("component"))
    return base.join(known, "cls", "left").select("doc", "n", F.coalesce("component", "doc").alias("component"))


def _buckets(classes: DataFrame) -> DataFrame:
    """key, node, c (members), weight (keys with the same members) of keys that several classes show.

    Counts are partial sums and the join back is a plain equi-join, so a key that a third of the
    corpus shows may be split. Almost all keys have one class and go with the count.
    """
    shown = classes.select(F.explode("keys").alias("key"), "node")
    several = shown.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    shared = cut(shown.join(several, "key").select("key", "node"))
    shared = shared.coalesce(tasks_for(shared.count()))
    # buckets of the same members are one bucket
    members = shared.groupBy("key").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("node")).alias("members")).coalesce(shared.rdd.getNumPartitions())
    kept = members.groupBy("members", "c").agg(F.min("key").alias("key"), F.count("*").alias("weight"))
    return cut(shared.join(kept.select("key", "c", "weight"), "key").select("key", "node", "c", "weight").coalesce(shared.rdd.getNumPartitions()))


def _with_components(buckets: DataFrame, comps: DataFrame) -> DataFrame:
    """``buckets`` whose members are of several components, with ``comp``."""
    few = buckets.rdd.getNumPartitions()
    now = buckets.join(comps, "node", "left").select(*buckets.columns, F.coalesce("component", "node").alias("comp")).coalesce(few)
    open_ = now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    return cut(now.join(open_, "key", "left_semi").coalesce(few))


def _left(rows: DataFrame) -> float:
    """Pairs of different components in ``rows`` (key, comp), per row."""
    own = rows.groupBy("key", "comp").agg(F.count("*").alias("c"))
    keys = own.groupBy("key").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("same"))
    got = keys.agg(F.sum("n"), F.sum((F.col("n") * F.col("n") - F.col("same")) / 2)).first()
    return float(got[1] or 0) / float(got[0] or 1)


def _star_pairs(buckets: DataFrame, tried: DataFrame | None, p: JoinParams) -> DataFrame:
    """a, b: each class with the centre of its buckets.

    A bucket's centre is the member that shares most with others in all its buckets: in a group of
    near copies, one with few edits, to which most others link. Centres of earlier rounds come last.
    """
    few = buckets.rdd.getNumPartitions()
    score = buckets.groupBy("node").agg(F.sum(F.col("c") * F.col("weight")).alias("score"))
    if tried is not None:
        used = tried.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("used"))
        score = score.join(used, "node", "left").select("node", (F.col("score") / (1 + F.coalesce("used", F.lit(0)))).cast("long").alias("score"))
    ranked = buckets.join(score, "node").select("key", "node", "score").coalesce(few)
    centre = ranked.groupBy("key").agg(F.max_by("node", F.struct("score", "node")).alias("centre"))
    near = buckets.join(centre, "key").where("node <> centre").groupBy("node", "centre").agg(F.sum("weight").alias("w")).where(F.col("w") >= p.least_shared)
    return near.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct().coalesce(few)


def _linked(buckets: DataFrame, stored: DataFrame, p: JoinParams) -> DataFrame:
    """node, component of all classes with a link.

    Star rounds join most of a large group with few comparisons; only buckets that still have
    members of different components go on, and the R-trees settle all their pairs.
    """
    left, links, tried = buckets, None, None
    while True:
        pairs = cut(_star_pairs(left, tried, p))
        found = cut(_verified(pairs, stored, p))
        compared, linked = pairs.count(), found.count()
        found = found.coalesce(tasks_for(linked))  # not before it is written: verification needs all tasks
        links = found if links is None else links.unionByName(found)
        comps = connected_components(links)
        left = _with_components(buckets, comps)
        if linked <= p.least_yield * compared or _left(left) <= p.left_per_row:
            break
        tried = pairs if tried is None else tried.unionByName(pairs)
    blocks = F.ceil(F.col("c") / p.block).cast("int")
    sub = left.withColumn("sub", F.pmod(F.xxhash64("node", F.lit(99)), blocks).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
    placed = sub.join(stored.select("node", "n", "vec"), "node").select(
        "key", F.least("sub", "with").alias("i"), F.greatest("sub", "with").alias("j"), "sub", "node", "n", "comp", "vec"
    )
    pairs = cut(_tree_pairs(placed, p))
    found = _verified(pairs.coalesce(tasks_for(pairs.count())), stored, p)
    # components so far stand for the links that made them
    return connected_components(comps.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(found))
