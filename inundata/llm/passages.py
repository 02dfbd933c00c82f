"""Removal of byte passages that documents with smaller ids hold, by phrases around rolling-hash triggers.

No suffix array is built: on text that seldom repeats the dictionary of a prefix-free parse is as
large as the text. A rolling hash picks triggers: the least hash among the trigger windows of any 50 bytes, so that
equal 50-byte strings have the same trigger at the same place, and texts fall into phrases at
triggers in the same way wherever they repeat. A record holds each trigger with a hash of the bytes
around it, as far as a 50-byte string with that trigger may reach. Sorting these records by trigger,
phrase hash and document settles whole phrases at once: a phrase known from a smaller document is
covered. Only where phrases of one trigger differ are their 50-byte strings sorted, to find those
that they still share. Triggers travel packed, by hash range. A phrase counts as known on equal hashes
(24 bits of its trigger, 56 of its own).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inundata.llm.ngramjoin import _powers, mixed
from inundata.llm.text import cut, shuffle_width

_U = np.uint64
_VALUE = mixed(np.arange(1, 257, dtype=np.uint64) * _U(0x2545F4914F6CDD1D))


@dataclass(frozen=True)
class PassageParams:
    length: int = 50
    #: Bytes of a trigger window.
    trigger: int = 20
    #: Bytes of text that one packing step takes, about.
    chunk: int = 1_000_000
    #: Strings of open phrases that one sort takes, about.
    portion: int = 250_000

    @property
    def side(self) -> int:
        """How far a string with a trigger reaches beyond it."""
        return self.length - self.trigger


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` over every ``width`` neighbours."""
    size = 1
    while size * 2 <= width:
        x = op(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return op(x[: len(x) - rest], x[rest:]) if rest else x


def triggers(raw: np.ndarray, starts: np.ndarray, p: PassageParams) -> tuple[np.ndarray, ...]:
    """doc, position, trigger hash, phrase hash, left and right reach of texts put end to end.

    ``starts`` has the place of each text in ``raw`` and the end. Texts shorter than the string
    length have none.
    """
    n, q = len(raw), p.trigger
    if n < p.length:
        return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    power, inverse = _powers(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_VALUE[raw] * power[:n], out=sums[1:])
    h = mixed((sums[q:] - sums[:-q]) * inverse[: n - q + 1])
    lengths = np.diff(starts)
    for end in starts[1:-1]:  # windows over the border of two texts are no triggers
        h[max(0, end - q + 1) : end] = _U(2**64 - 1)
    width = p.length - q + 1
    least = _slide(h, width, np.minimum)
    edge = np.zeros(width - 1, dtype=np.uint64)
    at = np.flatnonzero(h == _slide(np.concatenate([edge, least, edge]), width, np.maximum))
    doc = np.searchsorted(starts, at, side="right") - 1
    keep = (at + q <= starts[doc + 1]) & (lengths[doc] >= p.length)
    at, doc = at[keep], doc[keep]
    left, right = np.minimum(p.side, at - starts[doc]), np.minimum(p.side, starts[doc + 1] - at - q)
    phrase = mixed((sums[at + q + right] - sums[at - left]) * inverse[at - left] + (left * 256 + right).astype(np.uint64))
    # triggers are least hashes, so they crowd at the low end: mixed again they spread over ranges
    return doc, at - starts[doc], mixed(~h[at]), phrase, left, right


def _ranges(h: np.ndarray, count: int) -> np.ndarray:
    return (((h >> _U(32)) * _U(count)) >> _U(32)).astype(np.int64)


#: What a trigger carries; columns are packed one after another, as places and documents ascend.
#: Beside its range a trigger keeps 24 bits, where an equal value only opens phrases that need not
#: be, and a phrase 56, which decide: among 10^8 phrases of one trigger 0.07 false matches are expected.
_COLUMNS = (("h", "<u2"), ("h_top", "u1"), ("phrase", "<u4"), ("phrase_mid", "<u2"), ("phrase_top", "u1"), ("doc", "<u2"), ("at", "<u4"))
_HASHES = ("h", "h_top", "phrase", "phrase_mid", "phrase_top")


def _ascending(x: np.ndarray, kind: str) -> np.ndarray:
    """Differences of neighbours, which pack better; sums bring the values back (modulo the width)."""
    x = x.astype(kind)
    return np.concatenate([x[:1], x[1:] - x[:-1]])


def _packed(columns: dict[str, np.ndarray]) -> bytes:
    raw = [_ascending(columns[n], k) if n in ("doc", "at") else columns[n].astype(k) for n, k in _COLUMNS if n in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(x.tobytes() for x in raw))


def _unpacked(packed: bytes, names: tuple[str, ...] = tuple(n for n, _ in _COLUMNS)) -> dict[str, np.ndarray]:
    raw = zstandard.decompress(packed)
    columns = [(n, k) for n, k in _COLUMNS if n in names]
    n, out, place = len(raw) // sum(np.dtype(k).itemsize for _, k in columns), {}, 0
    for name, kind in columns:
        x = np.frombuffer(raw, kind, count=n, offset=place)
        out[name] = np.cumsum(x, dtype=kind) if name in ("doc", "at") else x
        place += x.nbytes
    return out


def _packed_triggers(slim: DataFrame, ranges: int, p: PassageParams) -> DataFrame:
    """range, ids, marks, records, known: the triggers of a few texts that fall in one hash range.

    A phrase that a smaller document among these few texts has is covered at once: it travels
    without its hashes (``known``). So what meets at a trigger is one record per few texts and
    phrase, however many documents hold it.
    """

    def pack(ids: list, marks: list, texts: list[bytes]) -> pd.DataFrame:
        starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        doc, at, h, phrase, _, _ = triggers(np.frombuffer(b"".join(texts), dtype=np.uint8), starts, p)
        named = np.array(ids, dtype=np.int64)[doc]
        order = np.lexsort((named, phrase))
        first = np.concatenate([[True], np.diff(phrase[order]) != 0])
        least = np.empty(len(order), dtype=np.int64)
        least[order] = named[order][np.flatnonzero(first)][np.cumsum(first) - 1] if len(order) else 0
        known, part = named > least, _ranges(h, ranges)
        columns = {"doc": doc, "at": at}
        for name, value, shift, mask in (("h", h, 0, 0xFFFF), ("h_top", h, 16, 0xFF), ("phrase", phrase, 0, 0xFFFFFFFF), ("phrase_mid", phrase, 32, 0xFFFF), ("phrase_top", phrase, 48, 0xFF)):
            columns[name] = (value >> _U(shift)) & _U(mask)
        documents = zstandard.ZstdCompressor(level=1).compress(_ascending(np.array(ids), "<i8").tobytes())
        said = np.array(marks, dtype="<i4").tobytes()

        def by_range(some: np.ndarray, names: tuple[str, ...]) -> dict[int, bytes]:
            at_ = np.flatnonzero(some)
            at_ = at_[np.argsort(part[at_], kind="stable")]
            cuts = np.flatnonzero(np.diff(part[at_])) + 1
            return {int(part[x[0]]): _packed({n: columns[n][x] for n in names}) for x in np.split(at_, cuts) if len(x)}

        open_, settled = by_range(~known, tuple(columns)), by_range(known, ("doc", "at"))
        spans = sorted(open_.keys() | settled.keys())
        return pd.DataFrame(
            {"range": spans, "ids": [documents] * len(spans), "marks": [said] * len(spans), "records": [open_.get(r) for r in spans], "known": [settled.get(r) for r in spans]}
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, marks, texts, size = [], [], [], 0
        for pdf in batches:
            for i, mark, text in zip(pdf["id"], pdf["mark"], pdf["text"], strict=True):
                raw = (text or "").encode("utf-8", "replace")
                if len(raw) < p.length:
                    continue
                ids.append(int(i)), marks.append(int(mark)), texts.append(raw)
                size += len(raw)
                if size >= p.chunk or len(ids) >= 60_000:
                    yield pack(ids, marks, texts)
                    ids, marks, texts, size = [], [], [], 0
        if texts:
            yield pack(ids, marks, texts)

    return slim.where("id is not null").mapInPandas(run, "range long, ids binary, marks binary, records binary, known binary")


def _per_document(ids: np.ndarray, marks: np.ndarray, **places: tuple[np.ndarray, np.ndarray]) -> pd.DataFrame:
    """One row per (id, mark): for each name, the places whose flag is set, as packed int32."""
    order = np.lexsort((marks, ids))
    ids, marks = ids[order], marks[order]
    cuts = np.flatnonzero((np.diff(ids) != 0) | (np.diff(marks) != 0)) + 1
    out = {"id": ids[np.concatenate([[0], cuts])], "mark": marks[np.concatenate([[0], cuts])]}
    for name, (flag, at) in places.items():
        flag, at = flag[order], at[order].astype("<i4")
        out[name] = [a[f].tobytes() for a, f in zip(np.split(at, cuts), np.split(flag, cuts), strict=True)]
    return pd.DataFrame(out)


def _settled(packed: DataFrame) -> DataFrame:
    """id, mark, covered, open: trigger places whose phrase a smaller document has, and places
    whose trigger, but not phrase, is shared."""

    nothing = _packed({n: np.zeros(0, k) for n, k in _COLUMNS})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        documents = [np.cumsum(np.frombuffer(zstandard.decompress(i), "<i8")) for i in pdf["ids"]]
        said = [np.frombuffer(m, "<i4") for m in pdf["marks"]]

        def gathered(column: str, names: tuple[str, ...]) -> tuple[np.ndarray, ...]:
            records = [_unpacked(nothing if r is None else r, names) for r in pdf[column]]
            ids = np.concatenate([d[r["doc"]] for d, r in zip(documents, records, strict=True)])
            marks = np.concatenate([m[r["doc"]] for m, r in zip(said, records, strict=True)])
            return ids, marks, *[np.concatenate([r[c] for r in records]) for c in names if c != "doc"]

        ids, marks, low, top, *planes, at = gathered("records", (*_HASHES, "doc", "at"))
        h = low.astype(np.uint32) | (top.astype(np.uint32) << np.uint32(16))
        phrase = sum(x.astype(np.uint64) << _U(shift) for x, shift in zip(planes, (0, 32, 48), strict=True))
        order = np.lexsort((ids, phrase, h))
        h, phrase, ids, marks, at = h[order], phrase[order], ids[order], marks[order], at[order]
        known_ids, known_marks, known_at = gathered("known", ("doc", "at"))
        if len(ids):
            new_h = np.concatenate([[True], np.diff(h) != 0])
            new_phrase = new_h | np.concatenate([[True], np.diff(phrase) != 0])
            by_h, by_phrase = np.cumsum(new_h) - 1, np.cumsum(new_phrase) - 1
            at_h = np.flatnonzero(new_h)
            several = np.minimum.reduceat(ids, at_h) != np.maximum.reduceat(ids, at_h)
            phrases = np.add.reduceat(new_phrase.astype(np.int64), at_h) > 1
            covered = ids > ids[np.flatnonzero(new_phrase)][by_phrase]
            still = ~covered & (several & phrases)[by_h]
        else:
            covered = still = np.zeros(0, dtype=bool)
        some, more = covered | still, len(known_ids)
        if not some.any() and not more:
            return pd.DataFrame({"id": [], "mark": [], "covered": [], "open": []})
        covered = np.concatenate([covered[some], np.ones(more, bool)])
        still = np.concatenate([still[some], np.zeros(more, bool)])
        at = np.concatenate([at[some], known_at])
        return _per_document(np.concatenate([ids[some], known_ids]), np.concatenate([marks[some], known_marks]), covered=(covered, at), open=(still, at))

    return packed.groupBy("range").applyInPandas(run, "id long, mark int, covered binary, open binary")


def _open_phrases(texts: DataFrame, ranges: int, p: PassageParams) -> DataFrame:
    """range, ids, marks, places, phrases: the open phrases of texts, padded to full reach."""
    full = p.length + p.side

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = zstandard.ZstdCompressor(level=1)
        for pdf in batches:
            held: dict[int, list] = {}
            for i, mark, packed, places in zip(pdf["id"], pdf["mark"], pdf["packed"], pdf["open"], strict=True):
                if places is None or not (places := b"".join(places)):
                    continue
                raw = np.frombuffer(zstandard.decompress(packed), dtype=np.uint8)
                at = np.frombuffer(places, dtype="<i4").astype(np.int64)
                padded = np.concatenate([np.zeros(p.side, np.uint8), raw, np.zeros(p.side, np.uint8)])
                phrases = padded[at[:, None] + np.arange(full)[None, :]]
                window = raw[at[:, None] + np.arange(p.trigger)[None, :]]
                power, _ = _powers(p.trigger)
                h = mixed((_VALUE[window] * power[: p.trigger][None, :]).sum(axis=1, dtype=np.uint64))
                part = _ranges(mixed(~h), ranges)
                reach = np.stack([np.minimum(p.side, at), np.minimum(p.side, len(raw) - at - p.trigger)], axis=1).astype(np.uint8)
                for r in np.unique(part).tolist():
                    k = part == r
                    held.setdefault(r, []).append((np.full(k.sum(), i), np.full(k.sum(), mark), at[k], np.concatenate([reach[k], phrases[k]], axis=1)))
            yield pd.DataFrame(
                {"range": list(held)} | {name: [(packer.compress if name == "phrases" else bytes)(np.concatenate([x[c] for x in v]).astype(kind).tobytes()) for v in held.values()] for c, (name, kind) in enumerate((("ids", "<i8"), ("marks", "<i4"), ("places", "<i4"), ("phrases", np.uint8)))}
            )

    return texts.mapInPandas(run, "range long, ids binary, marks binary, places binary, phrases binary")


def _shared_strings(phrases: DataFrame, p: PassageParams) -> DataFrame:
    """id, mark, starts: places of strings in open phrases that a smaller document has too.

    The suffixes of the phrases of a range that are long enough are sorted by their bytes; equal
    ones stand together, the smallest document first.
    """
    full = p.length + p.side
    shift = np.arange(p.side + 1)

    def hits(ids: np.ndarray, reach: np.ndarray, body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and offset of the strings of some phrases that a smaller document has too."""
        ok = (shift[None, :] >= p.side - reach[:, :1]) & (shift[None, :] <= reach[:, 1:])
        row, off = np.nonzero(ok)
        if not len(row):
            return row, off
        strings = np.lib.stride_tricks.sliding_window_view(body, p.length, axis=1)[row, off]
        wide = np.zeros((len(row), -(-p.length // 8) * 8), np.uint8)
        wide[:, : p.length] = strings
        words = wide.view(">u8")
        order = np.lexsort([ids[row], *[words[:, k] for k in range(words.shape[1] - 1, -1, -1)]])
        words, row, off = words[order], row[order], off[order]
        new = np.concatenate([[True], (words[1:] != words[:-1]).any(axis=1)])
        known = ids[row] > ids[row][np.flatnonzero(new)][np.cumsum(new) - 1]
        return row[known], off[known]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, marks = (np.frombuffer(b"".join(pdf[c]), dtype=k) for c, k in (("ids", "<i8"), ("marks", "<i4")))
        at = np.frombuffer(b"".join(pdf["places"]), dtype="<i4")
        rows = np.frombuffer(b"".join(map(zstandard.decompress, pdf["phrases"])), dtype=np.uint8).reshape(len(at), full + 2)
        # phrases of one trigger stay together; a portion at a time bounds the memory
        portions = max(1, len(at) * (p.side + 1) // p.portion)
        key = mixed(np.ascontiguousarray(rows[:, 2 + p.side : 10 + p.side]).view("<u8").ravel()) % _U(portions)
        found = []
        for k in range(portions):
            of = np.flatnonzero(key == _U(k))
            row, off = hits(ids[of], rows[of, :2].astype(np.int64), rows[of, 2:])
            found.append((of[row], off))
        row, off = (np.concatenate([x[c] for x in found]) for c in (0, 1))
        if not len(row):
            return pd.DataFrame({"id": [], "mark": [], "starts": []})
        return _per_document(ids[row], marks[row], starts=(np.ones(len(row), bool), at[row].astype(np.int64) - p.side + off))

    return phrases.groupBy("range").applyInPandas(run, "id long, mark int, starts binary")


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text: str = "text", p: PassageParams = PassageParams()) -> DataFrame:
    """id, n_bytes, spans (start, stop of removed bytes), kept_sha256; one row per input row.

    A string counts as known if a document with a smaller id has it; rows that share an id don't
    remove from each other, and a row without id is left alone and counts for no other. Null and
    empty texts have no bytes. Matches never cross documents. A very long text is cut into phrases
    whole. Ids are whole numbers; a text id fails the job. Columns beside the two named ones are not
    read, whatever their names. An empty table gives an empty table.
    """
    ranges = 2 * shuffle_width(docs.sparkSession)
    slim = docs.select(docs[id_col].cast("long").alias("id"), F.pmod(F.xxhash64(docs[text]), F.lit(2**31 - 1)).cast("int").alias("mark"), docs[text].alias("text"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = zstandard.ZstdCompressor(level=3)
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"].astype("Int64"), "mark": pdf["mark"], "packed": [packer.compress((t or "").encode("utf-8", "replace")) for t in pdf["text"]]})

    packed_texts = slim.mapInPandas(pack, "id long, mark int, packed binary")
    settled = _settled(_packed_triggers(slim, ranges, p)).groupBy("id", "mark").agg(F.collect_list("covered").alias("covered"), F.collect_list("open").alias("open"))
    settled = cut(settled)
    # both joins keep all texts, so that Spark shuffles these once and uses the exchange again
    opened = settled.select(F.col("id").alias("i"), F.col("mark").alias("m"), "open")
    same = (F.col("id") == F.col("i")) & (F.col("mark") == F.col("m"))
    texts = packed_texts.join(opened, same, "left").select("id", "mark", "packed", "open")
    shared = _shared_strings(_open_phrases(texts, ranges, p), p).groupBy("id", "mark").agg(F.collect_list("starts").alias("starts"))
    marked = settled.select("id", "mark", "covered").join(shared, ["id", "mark"], "full").select(F.col("id").alias("i"), F.col("mark").alias("m"), "covered", "starts")

    def cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for packed, covered, starts in zip(pdf["packed"], pdf["covered"], pdf["starts"], strict=True):
                raw = np.frombuffer(zstandard.decompress(packed), dtype=np.uint8)
                n = len(raw)
                at = np.frombuffer(b"".join(covered) if covered is not None else b"", dtype="<i4").astype(np.int64)
                begin = np.frombuffer(b"".join(starts) if starts is not None else b"", dtype="<i4").astype(np.int64)
                change = np.zeros(n + 1, dtype=np.int64)
                np.add.at(change, np.concatenate([np.maximum(0, at - p.side), begin]), 1)
                np.add.at(change, np.concatenate([np.minimum(n, at + p.length), begin + p.length]), -1)
                gone = np.cumsum(change)[:n] > 0
                edges = np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))
                spans = [{"start": int(a), "stop": int(b)} for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1), strict=True)]
                rows.append((n, spans, hashlib.sha256(raw[~gone].tobytes()).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_bytes", "spans", "kept_sha256"])
            out.insert(0, "id", pdf["id"].astype("Int64").to_numpy())
            yield out

    joined = packed_texts.join(marked, same, "left").select("id", "packed", "covered", "starts")
    out = joined.mapInPandas(cut_out, "id long, n_bytes long, spans array<struct<start:int,stop:int>>, kept_sha256 string")
    return out.withColumnRenamed("id", id_col)
