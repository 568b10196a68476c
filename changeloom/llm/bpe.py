"""Byte-level BPE encoding and decoding by dynamic programming over byte prefixes.

For each prefix of a piece exactly one token can end its encoding: the longest-to-shortest search takes the
token that forms a valid pair with the last token of what stands before it. Keeping that token for each
prefix makes appends exact and lets an edit be re-encoded from the first byte that changed.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from changeloom.llm import kernel

CACHED_PIECES, CACHED_PAIRS = 500_000, 500_000
CACHED_SEGMENTS, PART = 1_000_000, 1 << 20
_ONE, _NONE, _SHORT = (1,), frozenset(), frozenset({1, 2})
_SPACE, _MAYBE_SPACE = np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MAYBE_SPACE[range(0x1C, 0x20)] = True
_WIDE = [c.encode() for c in map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))]  # white space beyond ASCII
_WIDE_TWO, _WIDE_THREE = ([int.from_bytes(c) for c in _WIDE if len(c) == k] for k in (2, 3))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Prefixes:
    """The encoding of a byte string with the last token of each prefix. `append` and `replace` keep it exact."""

    def __init__(self, bpe: PrefixBpe, data: bytes = b""):
        self.bpe, self.data, self.last = bpe, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        n = len(self.data)
        self.data += more
        self.bpe.extend(self.data, n, self.last)

    def replace(self, start: int, end: int, new: bytes) -> None:
        """Replace bytes start..end. Prefixes before start stay; behind the edit the old tokens are taken over again once the new ones have agreed with them for as long as a token can reach."""
        old, shift = self.last, len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        self.last, same = old[:start], 0
        for i in range(start, len(self.data)):
            self.bpe.extend(self.data, i, self.last, i + 1)
            was = i - shift
            same = same + 1 if was >= end and self.last[i] == old[was] else 0
            if same > 2 * self.bpe.longest:
                self.last += old[was + 1 :]
                break

    def ids(self) -> list[int]:
        return self.bpe.walk(self.last)


class PrefixBpe:
    def __init__(self, ranks: dict[bytes, int]):
        self.rank, self.token = ranks, {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        lengths: dict[bytes, set[int]] = {}
        for t in ranks:
            for k in (1, 2, 3):
                if len(t) >= k:
                    lengths.setdefault(t[-k:], set()).add(len(t))
        # lengths of the tokens that may end a prefix, longest first, by the prefix's last three bytes (all of a shorter one's)
        self.reach = {x: tuple(sorted(n | lengths.get(x[-1:], _NONE) & _SHORT | lengths.get(x[-2:], _NONE) & _SHORT, reverse=True)) for x, n in lengths.items()}
        for a in lengths:
            if len(a) == 2:
                for b in range(256):
                    self.reach.setdefault(bytes([b]) + a, tuple(n for n in self.reach[a] if n < 3))
        self.pairs: dict[int, bool] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.pieces: dict[str, bytes] = {}
        size = max(self.token) + 1
        length = np.zeros(size + 1, np.int64)
        for i, t in self.token.items():
            length[i + 1] = len(t)
        self.at, self.size = np.cumsum(length), length[1:].tolist()
        self.flat = np.frombuffer(b"".join(self.token.get(i, b"") for i in range(size)), np.uint8)

    def merge(self, piece: bytes, below: int = 1 << 60) -> list[int]:
        """The encoding by its definition: the pair of lowest rank is merged first, as long as it is under `below`. Used on single tokens only."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = min((self.rank.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.rank[p] for p in parts]

    def halves(self, t: int) -> tuple[int, int]:
        """The two tokens whose merge makes t last; t twice if it is one byte or is never made by merges."""
        got = self.parts.get(t)
        if got is None:
            raw, got = self.token[t], (t, t)
            if len(raw) > 1:
                ids = self.merge(raw, t)
                got = (ids[0], ids[1]) if len(ids) == 2 else (t, t)
            self.parts[t] = got
        return got

    def valid(self, a: int, b: int) -> bool:
        """Does b stay apart from a when a is followed by b?

        Merges are undone, the latest first, as long as the tokens at the seam had been there: none of the pairs that met there may have
        merged before the next merge of its own side took one of them away.
        """
        key = a << 32 | b
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            got = self.pairs[key] = self.whole(a) and self.whole(b) and self._apart(a, b)
        return got

    def _apart(self, a: int, b: int) -> bool:
        token, rank, until = self.token, self.rank, 1 << 60
        while True:
            joined = rank.get(token[a] + token[b])
            if joined is not None and joined < until:
                return False
            left, right = self.halves(a)[1], self.halves(b)[0]
            if left == a and right == b:
                return True
            if right == b or (left != a and a > b):  # the left side's merge came later; at equal ranks the merge further left comes first
                until, a = a, left
            else:
                until, b = b + 1, right

    def extend(self, data: bytes, begin: int, last: list[int], end: int | None = None) -> None:
        """Add to `last` the last token of each prefix that ends behind begin."""
        get, reach, pairs, valid = self.rank.get, self.reach.get, self.pairs, self.valid
        for e in range(begin + 1, (len(data) if end is None else end) + 1):
            for n in reach(data[max(0, e - 3) : e], _ONE):
                s = e - n
                if s < 0:
                    continue
                t = get(data[s:e])
                if t is None:
                    continue
                if s:
                    a = last[s - 1]
                    ok = pairs.get(a << 32 | t)
                    if ok is None:
                        ok = valid(a, t)
                else:
                    ok = self.whole(t)
                if ok:
                    last.append(t)
                    break

    def whole(self, t: int) -> bool:
        """Is a token's own bytes encoded as that token?"""
        key = t | 1 << 63
        got = self.pairs.get(key)
        if got is None:
            got = self.pairs[key] = self.merge(self.token[t]) == [t]
        return got

    def encode_piece(self, piece: bytes) -> list[int]:
        """A piece that is a token is that token, as the public library has it; any other is encoded by prefixes."""
        t = self.rank.get(piece)
        return [t] if t is not None else Prefixes(self, piece).ids()

    def learn(self, pieces: set[str]) -> None:
        """Encodes pieces in the order of their bytes: each takes over the last tokens of the prefix that it shares with the one before it."""
        if len(self.pieces) + len(pieces) > CACHED_PIECES:
            self.pieces.clear()
        before, last, get = b"", [], self.rank.get
        for raw, piece in sorted((x.encode(), x) for x in pieces if x not in self.pieces):
            t = get(raw)
            if t is not None:
                self.pieces[piece] = t.to_bytes(4, "little")
                continue
            n = 0
            for x, y in zip(raw, before):  # noqa: B905
                if x != y:
                    break
                n += 1
            del last[n:]
            self.extend(raw, n, last)
            before = raw
            ids = self.walk(last)
            self.pieces[piece] = struct.pack(f"<{len(ids)}I", *ids)

    def walk(self, last: list[int]) -> list[int]:
        """The tokens of a whole string from the last tokens of its prefixes."""
        out, at, size = [], len(last), self.size
        while at:
            t = last[at - 1]
            out.append(t)
            at -= size[t]
        return out[::-1]

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of ids, copied from the flat table of all tokens at once."""
        if not len(ids):
            return b""
        start, size = self.at[ids], self.at[ids.astype(np.int64) + 1] - self.at[ids]
        ends = np.cumsum(size)
        return self.flat[np.repeat(start - (ends - size), size) + np.arange(ends[-1])].tobytes()


_made: dict[str, PrefixBpe] = {}


def encoder(path: str) -> PrefixBpe:
    """One encoder for each rank file and Python worker."""
    if path not in _made:
        _made[path] = PrefixBpe(read_ranks(path))
    return _made[path]


class Segments:
    """Ids of whole segments (a run of white space and the word behind it), each encoded once and kept by a 64-bit hash of its bytes."""

    def __init__(self, bpe: PrefixBpe, pattern: str):
        import regex

        self.bpe, self.find = bpe, regex.compile(pattern).findall
        self.clear()

    def clear(self) -> None:
        self.keys, self.start, self.size, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def encode(self, data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the segments that start at `begin` and how many each has."""
        up, down = kernel.powers(len(data) + 1)
        hashes = kernel.mix(np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], begin) * down[begin])
        uniq, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(uniq) > CACHED_SEGMENTS or len(self.flat) > 8 * CACHED_SEGMENTS:
            self.clear()
        at = np.searchsorted(self.keys, uniq)
        known = self.keys[np.minimum(at, len(self.keys) - 1)] == uniq if len(self.keys) else np.zeros(len(uniq), bool)
        if not known.all():
            raw, new, ends = data.tobytes(), first[~known], np.append(begin[1:], len(data))
            found = [self.find(raw[s:e].decode()) for s, e in zip(begin[new].tolist(), ends[new].tolist(), strict=True)]
            self.bpe.learn({x for f in found for x in f})
            packed = self.bpe.pieces
            ids = [b"".join([packed[x] for x in f]) for f in found]
            size = np.array([len(x) // 4 for x in ids], np.int64)
            start = len(self.flat) + np.cumsum(size) - size
            self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(ids), "<u4")])
            where = at[~known]
            self.keys, self.start, self.size = np.insert(self.keys, where, uniq[~known]), np.insert(self.start, where, start), np.insert(self.size, where, size)
            at = np.searchsorted(self.keys, uniq)
        slot = at[inverse]
        size = self.size[slot]
        upto = np.cumsum(size)
        return self.flat[np.repeat(self.start[slot] - (upto - size), size) + np.arange(upto[-1])], size


def segment_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where segments begin: at each text, and at ASCII white space behind a character that is no white space of any kind."""
    space = _SPACE[data]
    begin = np.zeros(len(data), bool)
    begin[1:] = space[1:] & ~space[:-1] & ~_MAYBE_SPACE[data[:-1]]
    ends = np.flatnonzero(begin & np.concatenate([[False], data[:-1] >= 0x80]))  # behind a character of several bytes: is it white space?
    if len(ends):
        two, three = data[np.maximum(ends - 2, 0)].astype(np.int64) << 8 | data[ends - 1], data[np.maximum(ends - 3, 0)].astype(np.int64)
        begin[ends[np.isin(two, _WIDE_TWO) | np.isin(three << 16 | two, _WIDE_THREE)]] = False
    begin[offsets[:-1][offsets[:-1] < len(data)]] = True
    return np.flatnonzero(begin)


def text_parts(texts: pa.Array, most: int = PART) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
    """(first row, bytes, offsets, whole) of runs of rows; a row of more than `most` bytes comes in parts that end where a segment does, `whole` being true of its last."""
    for i, _, data, off in kernel.slices(texts, most):
        a, n = 0, len(data)
        while n - a > 2 * most:
            end, width = a, most
            while end == a and a + width < n:
                width = min(2 * width, n - a)
                s = segment_starts(data[a : a + width], np.array([0, width]))
                end = a + int(s[-1])
            if end == a:
                break
            yield i, data[a:end], np.array([0, end - a]), False
            a = end
        yield i, data[a:], off - a if not a else np.array([0, n - a]), True


_encoders: dict[tuple[str, str], Segments] = {}


def encode_documents(docs: DataFrame, rank_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids where asked for) of each whole text; each match of pattern is encoded by itself.

    No match of pattern may reach from a character that is no white space into white space, nor look behind; then texts fall
    into segments that are encoded apart, and equal ones once. A null text is empty: no tokens, the digests of nothing.
    Repeated rows give repeated rows, an empty table an empty result; columns other than doc_id and text are ignored.
    rank_path must be readable on every executor. Segments are known by 64-bit hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(rank_path)
        own = _encoders.get((rank_path, pattern))
        if own is None:
            own = _encoders[rank_path, pattern] = Segments(bpe, pattern)
        for b in batches:
            n, hashes, back, all_ids = [], [], [], []
            held: list = []  # of a text that comes in parts: digests, count and ids so far
            for _, data, off, whole in text_parts(b.column(1)):
                ids, size = np.zeros(0, np.uint32), np.zeros(0, np.int64)
                begin = segment_starts(data, off) if len(data) else size
                if len(begin):
                    ids, size = own.encode(data, begin)
                upto = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(begin, off)]
                plain, length = bpe.decode(ids), np.concatenate([[0], np.cumsum(bpe.at[ids.astype(np.int64) + 1] - bpe.at[ids])])[upto]
                raw = ids.astype("<u4").tobytes()
                for d in range(len(off) - 1):
                    if not held:
                        held = [hashlib.sha256(), hashlib.sha256(), 0, []]
                    mine = raw[4 * upto[d] : 4 * upto[d + 1]]
                    held[0].update(mine)
                    held[1].update(plain[length[d] : length[d + 1]])
                    held[2] += len(mine) // 4
                    held[3] += [mine] if with_ids else []
                    if whole:
                        hashes.append(held[0].hexdigest())
                        back.append(held[1].hexdigest())
                        n.append(held[2])
                        all_ids += [np.frombuffer(b"".join(held[3]), "<u4").astype(np.int32)] if with_ids else []
                        held = []
            out = [b.column(0), pa.array(n, pa.int64()), pa.array(hashes, pa.string()), pa.array(back, pa.string())]
            yield pa.record_batch(out + ([pa.array(all_ids, pa.list_(pa.int32()))] if with_ids else []), names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)

    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, ddl)
