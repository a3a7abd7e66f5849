"""SentencePiece encoding and decoding: Viterbi over a double-array trie of pieces.

The pieces and scores come from a model file. A text's spaces become the marker U+2581, one
more is put in front, and the segmentation of the greatest total score is found by the Viterbi
algorithm; a byte that no piece covers becomes its byte's piece, at more than any piece costs.
A U+2581 of the text itself is spelled in bytes, so decoding gives every text back exactly.

No piece has a marker behind another character, so a text is cut before each run of markers,
and each chunk is segmented on its own. The trie is built once, on the driver, and broadcast: three
arrays whose size is that of the model. A Python worker keeps the ids of the chunks it met first
and segments new ones together in numpy, a bounded number of bytes at a time: for each place in
the chunks, all chunks walk the trie from there. A longer chunk is segmented alone.

Cases: a null text gives null ids, an empty one no ids; null ids decode to null, ids that are
null or no piece's are left out. Ties go to the longer last piece. A very long text or word needs
memory in proportion to its own length. Repeated rows give repeated results. An empty table gives
no rows. Other columns of the input stay; columns already called as the outputs are replaced.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKER = "▁"
MARKER_BYTES = MARKER.encode()
#: Stands for a marker of the text itself: three bytes that UTF-8 never has.
LITERAL = b"\xf8\xf9\xfa"
#: A byte piece costs more than any piece of the model.
BYTE_PENALTY = 10.0
#: Beyond the end of a chunk; no piece has this byte.
STOP = 255


@dataclass(frozen=True)
class Vocabulary:
    pieces: list[bytes]
    scores: np.ndarray
    byte_ids: np.ndarray  # id of the piece of each byte


def load(path: str) -> Vocabulary:
    """Pieces and scores of a model file; control pieces have no text of their own."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    byte_ids = np.full(256, -1, np.int32)
    pieces, scores = [], np.zeros(n)
    for i in range(n):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
        plain = not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        if plain and MARKER in piece.lstrip(MARKER):
            raise ValueError(f"piece {i} has a marker behind another character")
        pieces.append(piece.encode() if plain else b"")
        scores[i] = model.get_score(i)
    if (byte_ids < 0).any():
        raise ValueError("the model has no byte fallback")
    return Vocabulary(pieces, scores, byte_ids)


@dataclass(frozen=True)
class DoubleArray:
    """A trie of byte strings in two arrays: the child of state ``s`` by byte ``b`` is
    ``base[s] + b + 1`` if ``check`` of that is ``s``. ``value[s]`` is the piece's id or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray


def double_array(pieces: list[bytes]) -> DoubleArray:
    root: dict = {}
    for i, piece in enumerate(pieces):
        if piece:
            node = root
            for b in piece:
                node = node.setdefault(b + 1, {})
            node.setdefault(0, i)
    parents, values, used = {0: -1}, {}, bytearray(1 << 16)
    bases: dict[int, int] = {}
    used[0] = 1
    queue, tried = [(0, root)], {}
    while queue:
        state, node = queue.pop()
        if 0 in node:
            values[state] = node[0]
        labels = sorted(x for x in node if x)
        if not labels:
            continue
        # the search for a place goes on where it ended for nodes with as many children
        base = tried.get(min(len(labels), 16), 1)
        while True:
            if base + 600 > len(used):
                used.extend(bytes(len(used)))
            if not any(used[base + x] for x in labels):
                break
            base += 1
        bases[state] = tried[min(len(labels), 16)] = base
        for x in labels:
            used[base + x] = 1
            parents[base + x] = state
            queue.append((base + x, node[x]))
    # a state without children points behind all states, where none is anyone's child
    end = max(max(parents), max(bases.values(), default=0) + 257) + 1
    base, check, value = np.full(end + 257, end, np.int32), np.full(end + 257, -1, np.int32), np.full(end + 257, -1, np.int32)
    for array_, found in ((base, bases), (check, parents), (value, values)):
        array_[list(found)] = list(found.values())
    return DoubleArray(base, check, value)


@dataclass(frozen=True)
class Model:
    """What workers need of a vocabulary; ``byte_ids`` also of the bytes of ``LITERAL``."""

    trie: DoubleArray
    scores: np.ndarray
    fallback: float
    byte_ids: np.ndarray
    surface: list[bytes]


def model_of(v: Vocabulary) -> Model:
    byte_ids = v.byte_ids.copy()
    for stand_in, b in zip(LITERAL, MARKER_BYTES, strict=True):
        byte_ids[stand_in] = v.byte_ids[b]
    surface = [p.replace(MARKER_BYTES, b" ") for p in v.pieces]
    for b, i in enumerate(v.byte_ids.tolist()):
        surface[i] = bytes([b])
    return Model(double_array(v.pieces), v.scores, float(v.scores.min()) - BYTE_PENALTY, byte_ids, surface)


class Codec:
    """``cached``: chunks whose ids are kept; ``batch``: bytes segmented together; ``alone``: bytes
    from which on a chunk is segmented alone."""

    def __init__(self, model: Model, cached: int = 200_000, batch: int = 1 << 17, alone: int = 192):
        self.m, self.most, self.batch, self.alone = model, cached, batch, alone
        self.cache: dict[bytes, bytes] = {}
        self.plain: tuple | None = None
        first = model.trie.base[0] + np.arange(256) + 1
        self.first = np.where(model.trie.check[first] == 0, first, -1).astype(np.int32)

    def segment(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of each chunk, as bytes of little-endian 32-bit numbers; chunks longest first."""
        m, (base, check, value) = self.m, (self.m.trie.base, self.m.trie.check, self.m.trie.value)
        lengths = np.array([len(c) for c in chunks], np.int64)
        longest, n = int(lengths[0]), len(chunks)
        # a row for each place in the chunks, and rows to walk into behind the last
        text = np.full((longest + 1, n), STOP, np.uint8)
        flat = np.frombuffer(b"".join(chunks), np.uint8)
        owner = np.repeat(np.arange(n), lengths)
        text[np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths), owner] = flat
        best = np.full((longest + 1, n), -np.inf)
        best[0] = 0.0
        back, piece = np.zeros((longest + 1, n), np.int16), np.zeros((longest + 1, n), np.int32)
        some = np.searchsorted(-lengths, -np.arange(longest))  # how many are longer than each place
        for i in range(longest):
            k = some[i]
            here, byte = best[i, :k], text[i, :k]
            total = here + m.fallback
            won = np.flatnonzero(total > best[i + 1, :k])
            best[i + 1, won], back[i + 1, won], piece[i + 1, won] = total[won], i, m.byte_ids[byte[won]]
            state = self.first[byte]
            at = np.flatnonzero(state >= 0)
            state, to = state[at], i + 1
            while len(at):
                ids = value[state]
                hit = np.flatnonzero(ids >= 0)
                if len(hit):
                    who, ids = at[hit], ids[hit]
                    total = here[who] + m.scores[ids]
                    won = np.flatnonzero(total > best[to, who])
                    who = who[won]
                    best[to, who], back[to, who], piece[to, who] = total[won], i, ids[won]
                if to == longest:
                    break
                child = base[state] + text[to, at] + np.int32(1)
                alive = np.flatnonzero(check[child] == state)
                at, state, to = at[alive], child[alive], to + 1
        # from all ends back to the starts, together
        owners, found = [], []
        at, place = np.arange(n), lengths.copy()
        while len(at):
            owners.append(at.astype(np.uint16))
            found.append(piece[place, at])
            place = back[place, at].astype(np.int64)
            more = np.flatnonzero(place > 0)
            at, place = at[more], place[more]
        whose = np.concatenate(owners[::-1])
        ids = np.concatenate(found[::-1])[np.argsort(whose, kind="stable")].astype("<i4").tobytes()
        ends = (4 * np.cumsum(np.bincount(whose, minlength=n))).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def segment_alone(self, chunk: bytes) -> bytes:
        """The same for one chunk of any length."""
        if self.plain is None:
            t = self.m.trie
            self.plain = t.base.tolist(), t.check.tolist(), t.value.tolist(), self.m.scores.tolist(), self.m.byte_ids.tolist()
        base, check, value, scores, byte_ids = self.plain
        n, fallback = len(chunk), self.m.fallback
        best, back, piece = array("d", [-np.inf]) * (n + 1), array("q", [0]) * (n + 1), array("i", [0]) * (n + 1)
        best[0] = 0.0
        for i, b in enumerate(chunk):
            here = best[i]
            if here + fallback > best[i + 1]:
                best[i + 1], back[i + 1], piece[i + 1] = here + fallback, i, byte_ids[b]
            state, j = 0, i
            while j < n:
                child = base[state] + chunk[j] + 1
                if check[child] != state:
                    break
                state, j = child, j + 1
                k = value[state]
                if k >= 0 and here + scores[k] > best[j]:
                    best[j], back[j], piece[j] = here + scores[k], i, k
        out, at = array("i"), n
        while at:
            out.append(piece[at])
            at = back[at]
        return np.array(out, "<i4")[::-1].tobytes()

    @staticmethod
    def chunks(text: str) -> list[bytes]:
        """The marked text, cut before each run of markers; the first marker of each is left out."""
        raw = text.encode("utf-8", "replace")
        words = (raw.replace(MARKER_BYTES, LITERAL) if MARKER_BYTES in raw else raw).split(b" ")
        if b"" not in words:
            return words
        out, held = [], []  # an empty word is one more marker of the next
        for w in words:
            if w:
                out.append(b"".join(held) + w)
                held = []
            else:
                held.append(MARKER_BYTES)
        return [*out, b"".join(held[1:])] if held else out

    def _add(self, new: list[bytes], out: dict[bytes, bytes]) -> None:
        """Segments chunks that are not known yet."""
        new.sort(key=len, reverse=True)
        lo = 0
        while lo < len(new):
            longest = len(new[lo])
            if longest >= self.alone:
                out[new[lo]] = self.segment_alone(MARKER_BYTES + new[lo])
                lo += 1
                continue
            hi = lo + max(1, min(60_000, self.batch // (longest + 3)))
            some = new[lo:hi]
            out.update(zip(some, self.segment([MARKER_BYTES + c for c in some]), strict=True))
            lo = hi

    def encode(self, texts: list[str | None]) -> list[bytes | None]:
        cut = [self.chunks(t) if t else [] for t in texts]
        cache = self.cache
        new = list(set().union(*cut).difference(cache))
        if len(cache) + len(new) <= self.most:
            self._add(new, cache)
            get = cache.__getitem__
        else:  # those met first, among them the frequent ones, stay; of the others none
            rest: dict[bytes, bytes] = {}
            self._add(new, rest)
            get = lambda c: cache.get(c) or rest[c]
        return [None if t is None else b"".join(map(get, x)) for t, x in zip(texts, cut, strict=True)]

    def decode(self, ids: list[int | None]) -> str:
        """The text; the marker that encoding put in front goes. Control pieces are dropped."""
        surface, n = self.m.surface, len(self.m.surface)
        try:
            text = b"".join([surface[i] for i in ids])
        except (IndexError, TypeError):
            text = b"".join([surface[i] for i in ids if i is not None and 0 <= i < n])
        return text[text[:1] == b" " :].decode("utf-8", "replace")


_codec: Codec | None = None


def _of(shared: Broadcast) -> Codec:
    """The codec of a Python worker, kept from task to task."""
    global _codec
    if _codec is None or _codec.m is not shared.value:
        _codec = Codec(shared.value)
    return _codec


#: Documents that are encoded at a time, and characters of them.
SLICE, SLICE_CHARS = 256, 1 << 20


def _slices(column: pa.Array) -> Iterator[list]:
    """The values of ``column``, some at a time."""
    held, size = [], 0
    for x in column:
        held.append(x.as_py())
        size += len(held[-1]) if held[-1] else 0
        if len(held) == SLICE or size >= SLICE_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _shared(docs: DataFrame, path: str) -> Broadcast:
    return docs.sparkSession.sparkContext.broadcast(model_of(load(path)))


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_out: str = "ids") -> DataFrame:
    """``docs`` with the ids of each text, an array of int."""
    shared = _shared(docs, path)

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        found: list = []
        for some in _slices(texts):
            found += _of(shared).encode(some)
        ends = np.cumsum([0, *[len(x) // 4 if x else 0 for x in found]]).astype(np.int32)
        missing = np.array([x is None for x in found] + [False])
        values = pa.array(np.frombuffer(b"".join([x for x in found if x]), "<i4"))
        return pa.ListArray.from_arrays(pa.array(ends, mask=missing), values)

    return docs.withColumn(ids_out, ids(F.col(text_col)))


def decode(docs: DataFrame, path: str, ids_col: str = "ids", text_out: str = "text") -> DataFrame:
    """``docs`` with the text of each array of ids."""
    shared = _shared(docs, path)

    @F.arrow_udf("string")
    def texts(ids: pa.Array) -> pa.Array:
        found: list = []
        for some in _slices(ids):
            found += [None if x is None else _of(shared).decode(x) for x in some]
        return pa.array(found, pa.string())

    return docs.withColumn(text_out, texts(F.col(ids_col)))
