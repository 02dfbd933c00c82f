"""SentencePiece encoding and decoding of merge-type vocabularies, in Arrow batches.

Encoding keeps an agenda of adjacent symbol pairs ordered by the score of the piece they would
form (then by place), merges the best pair and puts its new neighbours on the agenda. No piece has
a space mark after another character, so a text falls apart at those places and each part is
encoded alone; parts are remembered, in a table of bounded bytes. Parts of one length share their
steps: a row of scores is the agenda of each, and all of them merge their best pair at once. The
vocabulary is read through the
sentencepiece library, which also encodes every new part and one whole text of each batch, as a
check that stops the job on any difference.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
_PART = re.compile(f"{MARK}+[^{MARK}]*")


class PieceCodec:
    """Encoder and decoder of one vocabulary; ``known`` parts are kept up to ``capacity`` bytes.

    Twice that is held at most, and the parts of one portion of texts beside it.
    """

    #: Bytes of an entry of ``known`` beside its characters, about.
    ENTRY = 350
    #: Parts longer than this have an agenda of their own, a heap.
    LONG = 48

    def __init__(self, model: str, capacity: int = 100_000_000):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        size = self.library.get_piece_size()
        self.pieces = [self.library.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) or self.library.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.scores = {self.pieces[i]: self.library.get_score(i) for i in plain}
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(size) if self.library.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.id_texts = [str(i) for i in range(size)]
        self.crossing = any(MARK in p.lstrip(MARK) for p in self.ids)
        if self.library.encode("a") != self.library.encode("a", add_bos=False) or self.library.decode(self.library.encode(" a")) != " a":
            raise ValueError("only vocabularies that keep white space and prefix a space mark are supported")
        self.capacity, self.held = capacity, 0
        self._tabulate()
        self.known: dict[str, tuple[str, int, str]] = {}
        self.old: dict[str, tuple[str, int, str]] = {}

    def _tabulate(self) -> None:
        """Arrays of the pairs of pieces that form a piece, and of single characters."""
        ids, pairs = self.ids, {}
        for piece, i in ids.items():
            for k in range(1, len(piece)):
                left, right = ids.get(piece[:k]), ids.get(piece[k:])
                if left is not None and right is not None:
                    pairs[left * len(self.pieces) + right] = i
        self.pair_codes = np.array(sorted(pairs), dtype=np.int64)
        self.pair_ids = np.array([pairs[c] for c in self.pair_codes.tolist()], dtype=np.int32)
        self.pair_scores = np.array([self.scores[self.pieces[i]] for i in self.pair_ids.tolist()], dtype=np.float32)
        self.char_ids = np.full(0x110000, -1, dtype=np.int32)
        for piece, i in ids.items():
            if len(piece) == 1:
                self.char_ids[ord(piece)] = i
        # a symbol that is no piece can still be half of one only if it is a single character
        self.tabular = all(
            any(piece[:k] in ids and piece[k:] in ids for k in range(1, len(piece))) and all(c in ids for c in piece) for piece in ids if len(piece) > 1
        )

    def _merged(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of symbol pairs: the piece they form, and its score (minus infinity where there is none)."""
        code = left.astype(np.int64) * len(self.pieces) + right
        at = np.minimum(np.searchsorted(self.pair_codes, code), len(self.pair_codes) - 1)
        hit = (self.pair_codes[at] == code) & (left >= 0) & (right >= 0)
        return self.pair_ids[at], np.where(hit, self.pair_scores[at], np.float32(-np.inf))

    def agendas(self, parts: list[str]) -> list[list[int]]:
        """Symbols of parts of one length as ids, -1 for characters that are no piece.

        Each row of ``score`` is the agenda of a part; the first of the largest scores is the
        leftmost. A row without a pair left leaves.
        """
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(parts), -1)
        symbols, row = self.char_ids[codes], np.arange(len(parts))
        piece, score = self._merged(symbols[:, :-1], symbols[:, 1:])
        out: list[list[int]] = [[]] * len(parts)
        while True:
            width = symbols.shape[1]
            best = score.argmax(axis=1) if width > 1 else np.zeros(len(row), dtype=np.int64)
            top = score[np.arange(len(row)), best] if width > 1 else np.full(len(row), -np.inf)
            done = top == -np.inf
            for r, ids in zip(row[done].tolist(), symbols[done].tolist(), strict=True):
                out[r] = ids
            if done.all():
                return out
            symbols, piece, score, row, best = symbols[~done], piece[~done], score[~done], row[~done], best[~done]
            at, each = best[:, None], np.arange(len(row))
            merged = piece[each, best]
            columns = np.arange(width - 1)[None, :]
            symbols = np.take_along_axis(symbols, columns + (columns > at), axis=1)
            symbols[each, best] = merged
            if width == 2:
                score = score[:, :0]
                continue
            columns = columns[:, :-1]
            piece, score = (np.take_along_axis(x, columns + (columns >= at), axis=1) for x in (piece, score))
            for shift in (-1, 0):  # the merged symbol's new neighbours
                near = best + shift
                some = np.flatnonzero((near >= 0) & (near < width - 2))
                piece[some, near[some]], score[some, near[some]] = self._merged(symbols[some, near[some]], symbols[some, near[some] + 1])

    def agenda(self, part: str) -> list[str]:
        """Symbols of one long part: best-scored adjacent pair first, leftmost among equals."""
        symbols: list[str | None] = list(part)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, str, int]] = []

        def offer(left: int) -> None:
            right = after[left]
            if right < n:
                pair = symbols[left] + symbols[right]
                if pair in self.scores:
                    heapq.heappush(heap, (-self.scores[pair], left, pair, right))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, left, pair, right = heapq.heappop(heap)
            if symbols[left] is None or symbols[right] is None or after[left] != right or symbols[left] + symbols[right] != pair:
                continue
            symbols[left], symbols[right] = pair, None
            after[left] = after[right]
            if after[left] < n:
                before[after[left]] = left
            offer(left)
            if before[left] >= 0:
                offer(before[left])
        return [s for s in symbols if s is not None]

    def _with_bytes(self, symbols: list[int], part: str) -> list[int]:
        """Characters that are no piece become the pieces of their bytes."""
        out, at = [], 0
        for i in symbols:
            if i >= 0:
                out.append(i)
                at += len(self.pieces[i])
            else:
                out += [self.byte_ids[b] for b in part[at].encode("utf-8", "replace")]
                at += 1
        return out

    def encode_parts(self, parts: list[str]) -> list[list[int]]:
        """Ids of each part."""
        out: list[list[int]] = [[]] * len(parts)
        by_length: dict[int, list[int]] = {}
        for k, part in enumerate(parts):
            if self.tabular and 1 < len(part) <= self.LONG:
                by_length.setdefault(len(part), []).append(k)
            else:
                ids = self.ids
                out[k] = self._with_bytes([ids.get(s, -1) for s in self.agenda(part)], part)
        for places in by_length.values():
            for k, symbols in zip(places, self.agendas([parts[k] for k in places]), strict=True):
                out[k] = symbols if -1 not in symbols else self._with_bytes(symbols, parts[k])
        return out

    def decode(self, ids: list[int]) -> str:
        """Pieces joined; space marks become spaces, bytes become text, the prefixed space goes."""
        if self.byte_of.keys().isdisjoint(ids):
            text = "".join([self.pieces[i] for i in ids]).replace(MARK, " ")
            return text[1:] if text.startswith(" ") else text
        raw = b"".join(bytes([self.byte_of[i]]) if i in self.byte_of else self.pieces[i].encode() for i in ids)
        text = raw.decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text

    def parts(self, text: str) -> list[str]:
        marked = MARK + text.replace(" ", MARK)
        return [marked] if self.crossing else _PART.findall(marked)

    def learn(self, parts: set[str]) -> None:
        """Encode the parts that are not known, all of them checked against the library.

        A full table becomes the old one, from which parts that come again are taken back.
        """
        if self.held > self.capacity:
            self.old, self.known, self.held = self.known, {}, 0
        known, old, new = self.known, self.old, []
        for part in parts:
            if part not in known:
                if part in old:
                    known[part] = old[part]
                    self.held += self.ENTRY + 6 * len(part)
                else:
                    new.append(part)
        if not new:
            return
        texts = self.id_texts
        wanted = self.library.encode([p[1:].replace(MARK, " ") for p in new], num_threads=1)
        for part, want, ids in zip(new, wanted, self.encode_parts(new), strict=True):
            if ids != want and part != MARK * len(part):
                raise ValueError(f"the library encodes {part!r} as {want}, the agenda as {ids}")
            known[part] = (",".join([texts[i] for i in ids]), len(ids), " " + self.decode(ids))
            self.held += self.ENTRY + 6 * len(part)

    def encode_texts(self, texts: list[str]) -> list[tuple[str, int, str]]:
        """Of each text: ids joined by commas, their number, and the decoded text."""
        found = [self.parts(t) if t else [] for t in texts]
        self.learn(set().union(*found))
        known, out = self.known, []
        for parts in found:
            coded = [known[p] for p in parts]
            out.append((",".join([c[0] for c in coded]), sum([c[1] for c in coded]), "".join([c[2] for c in coded])[1:]))
        return out

    def encode_text(self, text: str) -> tuple[str, int, str]:
        return self.encode_texts([text])[0]


def _portions(texts: list[str], size: int = 1_000_000) -> Iterator[list[str]]:
    """Runs of texts of about ``size`` characters together; a longer text is alone."""
    held, total = [], 0
    for t in texts:
        if held and total + len(t) > size:
            yield held
            held, total = [], 0
        held.append(t)
        total += len(t)
    if held:
        yield held


_CODECS: dict[str, PieceCodec] = {}


def encode_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and with ``with_ids`` ids and decoded.

    Null texts count as empty: no ids, an empty decoding. Rows keep their partitions; a text is
    never split between batches. Ids keep whatever value the input has, null too. Repeated rows are
    encoded each for itself; among pairs of one score the leftmost merges first. A very long text
    is encoded whole, part by part. Columns beside the two named ones are not read; an id column that
    has the name of a result fails at once. An empty table gives an empty table.
    """
    if id_col in ("n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"):
        raise ValueError(f"the id column has the name of a result: {id_col}")
    fields = [pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    slim = docs.select(docs[id_col], docs[text])
    kind = slim.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _CODECS.get(model) or _CODECS.setdefault(model, PieceCodec(model))
        for batch in batches:
            rows = []
            for n_portion, texts in enumerate(_portions([t or "" for t in batch.column(1).to_pylist()])):
                coded = codec.encode_texts(texts)
                if not n_portion and texts[0]:
                    ids = codec.library.encode(texts[0])
                    if (",".join(map(str, ids)), codec.library.decode(ids)) != (coded[0][0], coded[0][2]):
                        raise ValueError("the library encodes a whole text in another way")
                for joined, n, decoded in coded:
                    row = (n, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                    rows.append(row + ((list(map(int, joined.split(","))) if joined else [], decoded) if with_ids else ()))
            columns = [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(fields)]
            if with_ids:
                columns += [pa.array([r[3] for r in rows], pa.list_(pa.int32())), pa.array([r[4] for r in rows], pa.string())]
            names = [f.name for f in fields] + ["ids", "decoded"] * with_ids
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["_id", *names])

    return slim.mapInArrow(run, f"_id {kind}, {schema}").withColumnRenamed("_id", id_col)
