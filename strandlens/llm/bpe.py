"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Token borders are found without a regular expression. Code points become classes by table; each class
(with what follows it) is a transition function on eight states; the functions a text can make by
composition form a finite set, so composing two is one table lookup and, being associative, the states
before all characters come from a blocked prefix scan. State and class then tell where tokens begin.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE_PIECES = 100_000
CHUNK_CHARS = 1 << 18
_BLOCK = 256

# Classes of code points.
_LETTER, _NUMBER, _OTHER, _SPACE, _BLANK, _MARK = range(6)
"""Letter, number, anything else, white space but the blank, the blank, the apostrophe."""

# Code points of white space, and the endings that an apostrophe begins.
_WHITE = (*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")

# Symbols of the automaton: class with what follows.
_L, _N, _O, _SHORT, _LONG, _JOIN, _WS, _LAST = range(8)
"""Letter, number, other, apostrophe of an ending of one letter, of two, blank before a token, white
space inside a run or at the end, last white space of a run that does not join."""

# States: what the character before was part of.
_START, _IN_L, _IN_N, _IN_O, _JOINING, _IN_WS, _TWO, _ONE = range(8)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a token begins at the symbol."""
    if symbol == _L:
        if state in (_TWO, _ONE):
            return (_ONE if state == _TWO else _START), False
        return _IN_L, state not in (_IN_L, _JOINING)
    if symbol == _N:
        return _IN_N, state not in (_IN_N, _JOINING)
    if symbol in (_O, _SHORT, _LONG):
        if state in (_IN_O, _JOINING):
            return _IN_O, False
        return (_IN_O if symbol == _O else _ONE if symbol == _SHORT else _TWO), True
    if symbol == _JOIN:
        return _JOINING, True
    if symbol == _WS:
        return _IN_WS, state != _IN_WS
    return _START, True


@lru_cache(1)
def _automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Function of each symbol, composition of functions, value from the start, token begins.

    Symbols 8 to 15 are the same at the begin of a text: constant functions, which ends what came
    before, so that many texts are scanned as one.
    """
    makes = [tuple(_step(s, c)[0] for s in range(8)) for c in range(8)]
    makes += [(_step(_START, c)[0],) * 8 for c in range(8)]
    known = {tuple(range(8)): 0}
    order = [tuple(range(8))]
    for f in order:
        for g in makes:
            h = tuple(g[x] for x in f)
            if h not in known:
                known[h] = len(order)
                order.append(h)
    maps = np.array(order, np.uint8)
    number = {f: i for i, f in enumerate(order)}
    then = np.array([[number[tuple(int(b[x]) for x in a)] for b in maps] for a in maps], np.uint16)
    begins = np.array([[_step(s, c)[1] for c in range(8)] + [True] * 8 for s in range(8)])
    return np.array([number[f] for f in makes], np.uint16), then, maps[:, _START].copy(), begins


@lru_cache(1)
def _classes() -> np.ndarray:
    kinds = {"L": _LETTER, "N": _NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], _OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    table[list(_WHITE)] = _SPACE
    table[0x20] = _BLANK
    table[0x27] = _MARK
    return table


def _scan(functions: np.ndarray, then: np.ndarray) -> np.ndarray:
    """Composition of all functions before each place (the identity before the first)."""
    n = len(functions)
    rows = -(-n // _BLOCK)
    size = len(then)
    flat = then.ravel()
    padded = np.zeros(rows * _BLOCK, np.uint16)
    padded[:n] = functions
    # one column per block, so that a step works on neighbouring memory
    steps = np.ascontiguousarray(padded.reshape(rows, _BLOCK).T)
    inside = np.empty_like(steps)
    sofar = np.zeros(rows, np.uint16)
    for i in range(_BLOCK):
        inside[i] = sofar
        sofar = flat[sofar.astype(np.int32) * size + steps[i]]
    if rows > 1:
        ahead = _scan(sofar, then)
        inside = flat[ahead.astype(np.int32)[None, :] * size + inside]
    return np.ascontiguousarray(inside.T).ravel()[:n]


def token_begins(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a token begins at each code point of several texts laid end to end; ``first``: their begins."""
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    kind = _classes()[points]
    at_first = np.zeros(n + 1, bool)
    at_first[first] = True
    at_first[n] = True
    white = (kind == _SPACE) | (kind == _BLANK)
    # the next character of the same text is there and not white
    goes_on = np.zeros(n, bool)
    goes_on[:-1] = ~white[1:] & ~at_first[1:-1]
    symbol = kind.copy()
    symbol[white] = _WS
    symbol[white & goes_on] = _LAST
    symbol[(kind == _BLANK) & goes_on] = _JOIN
    marks = np.flatnonzero(kind == _MARK)
    symbol[marks] = _O
    if len(marks):
        after = [np.full(len(marks), -1, np.int64), np.full(len(marks), -1, np.int64)]
        inside = np.ones(len(marks), bool)
        for k in (1, 2):
            place = np.minimum(marks + k, n)
            inside = inside & ~at_first[place]
            after[k - 1][inside] = points[place[inside]]
        for ending in _ENDINGS:
            hit = after[0] == ord(ending[0])
            if len(ending) == 2:
                hit &= after[1] == ord(ending[1])
            symbol[marks[hit]] = _SHORT if len(ending) == 1 else _LONG
    symbol[at_first[:-1]] += 8
    of_symbol, then, from_start, begins = _automaton()
    state = from_start[_scan(of_symbol[symbol], then)]
    return begins.ravel()[state.astype(np.int32) * 16 + symbol]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


class Codec:
    """Encodes and decodes with given ranks; keeps the ids of pieces it has seen, up to a bound.

    Once ``cache_pieces`` are kept they become the older half, from which pieces seen again move over.
    """

    def __init__(self, ranks: dict[bytes, int], cache_pieces: int = CACHE_PIECES):
        self.ranks = ranks
        self.cache_pieces = cache_pieces
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        size = max(ranks.values(), default=-1) + 1
        self.pieces: list[bytes] = [b""] * size
        for piece, rank in ranks.items():
            self.pieces[rank] = piece
        self.sizes = np.fromiter(map(len, self.pieces), np.int64, size)

    def merged(self, piece: bytes) -> bytes:
        """Ids of one piece as little-endian 32-bit numbers: joins the pair of lowest rank, leftmost first."""
        rank = self.ranks.get(piece)
        if rank is not None:
            return rank.to_bytes(4, "little")
        if len(piece) > 64:
            return self._merged_long(piece)
        ranks = self.ranks
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs:
            low = min(pairs)
            if low == 1 << 60:
                break
            i = pairs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], 1 << 60)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 60)
        return pack(f"<{len(parts)}I", *[ranks[p] for p in parts])

    def _merged_long(self, piece: bytes) -> bytes:
        """The same with a heap and linked parts, for pieces without end."""
        import heapq

        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or not alive[end[i]] or end[end[i]] != stop or end[i] == stop:
                continue
            alive[end[i]] = False
            end[i] = stop
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        return np.array([ranks[piece[i : end[i]]] for i in range(n) if alive[i]], "<u4").tobytes()

    def encode_pieces(self, pieces: list[bytes]) -> bytes:
        cache = self.cache
        try:
            return b"".join([cache[p] for p in pieces])
        except KeyError:
            pass
        out = []
        for p in pieces:
            ids = cache.get(p)
            if ids is None:
                ids = self.older.get(p) or self.merged(p)
                if len(p) <= 64:
                    if len(cache) >= self.cache_pieces:
                        self.older, self.cache = cache, {}
                        cache = self.cache
                    cache[p] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def offsets(self, ids: bytes) -> np.ndarray:
        """The place of each id's first byte in the decoded bytes."""
        sizes = self.sizes[np.frombuffer(ids, "<u4")]
        return np.cumsum(sizes) - sizes

    def encode_texts(self, texts: list[str]) -> Iterator[tuple[bytes, np.ndarray]]:
        """For each text its ids and the place of each piece's first byte in its UTF-8 bytes.

        Texts are scanned together, ``CHUNK_CHARS`` characters at a time or one longer text.
        """
        group: list[str] = []
        held = 0
        for text in texts:
            if group and held + len(text) > CHUNK_CHARS:
                yield from self._encode_group(group)
                group, held = [], 0
            group.append(text)
            held += len(text)
        if group:
            yield from self._encode_group(group)

    def _encode_group(self, texts: list[str]) -> Iterator[tuple[bytes, np.ndarray]]:
        whole = "".join(texts)
        data = whole.encode()
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        chars = np.cumsum([0] + [len(t) for t in texts])
        starts = np.flatnonzero(token_begins(points, chars[:-1][np.diff(chars) > 0]))
        if len(data) == len(points):
            places = starts
        else:
            width = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
            places = (np.cumsum(width, dtype=np.int64) - width)[starts]
        cuts = np.searchsorted(starts, chars)
        stops = np.append(places, len(data))
        for k in range(len(texts)):
            low, high = cuts[k], cuts[k + 1]
            at = stops[low : high + 1].tolist()
            pieces = [data[a:b] for a, b in zip(at, at[1:], strict=False)] if high > low else []
            yield self.encode_pieces(pieces), places[low:high] - (places[low] if high > low else 0)


@lru_cache(2)
def codec(path: str) -> Codec:
    """The codec of a rank file, once per Python worker."""
    return Codec(load_ranks(path))


def encode_documents(docs: DataFrame, ranks_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes every whole text with the ranks of a file and decodes it again.

    Returns ``doc_id``, ``ids`` (binary: ids as little-endian unsigned 32-bit numbers), ``n_tokens``,
    ``offsets`` (place of each id's first byte in the UTF-8 bytes) and ``decoded`` (binary, what the ids
    decode to). Null and empty texts have no ids and decode to no bytes. No special tokens: their
    strings are text. Repeated rows stay; an empty table gives no rows; other columns are not read.
    ``ranks_path`` is a file that all executors have, as a part of their installation.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_ranks = codec(ranks_path)
        for batch in batches:
            for part in _slices(batch):
                texts = [t or "" for t in part.column("text").to_pylist()]
                ids, counts, starts, decoded = [], [], [], []
                for got, _ in with_ranks.encode_texts(texts):
                    ids.append(got)
                    counts.append(len(got) // 4)
                    starts.append(with_ranks.offsets(got))
                    decoded.append(with_ranks.decode(got))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(ids, pa.binary()),
                        pa.array(counts, pa.int64()),
                        pa.array(starts, pa.list_(pa.int64())),
                        pa.array(decoded, pa.binary()),
                    ],
                    ["doc_id", "ids", "n_tokens", "offsets", "decoded"],
                )

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, ids binary, n_tokens bigint, offsets array<bigint>, decoded binary"
    )


def _slices(batch: pa.RecordBatch, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``max_bytes``, one row at least."""
    rows = max(1, int(batch.num_rows * max_bytes / max(batch.nbytes, 1)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def digest_documents(
    docs: DataFrame, ranks_path: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False
) -> DataFrame:
    """``encode_documents`` reduced to counts and SHA-256 digests of ids and decoded bytes, per document.

    ``with_ids`` keeps the binary ``ids``.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_ranks = codec(ranks_path)
        for batch in batches:
            counts, of_ids, of_bytes, kept = [], [], [], []
            for part in _slices(batch):
                for got, _ in with_ranks.encode_texts([t or "" for t in part.column("text").to_pylist()]):
                    counts.append(len(got) // 4)
                    of_ids.append(hashlib.sha256(got).hexdigest())
                    of_bytes.append(hashlib.sha256(with_ranks.decode(got)).hexdigest())
                    if with_ids:
                        kept.append(got)
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(kept, pa.binary())] if with_ids else []), names)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    )
