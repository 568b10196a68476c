"""Lexical retrieval packing: windows of related documents.

Documents are dealt by content: in the order of their least word hashes those that share words lie together, however
many they are. Each task tokenises its documents and cuts them into shards of bounded size. A shard has a BM25 inverted
index; a seed document asks it for its unused neighbours by all terms that it shares, and they fill the seed's window
greedily. What does not fit is cut and stays in the pool. The last tokens of a shard, too few for a window, go to
sequences of power-of-two lengths, so nothing is padded.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.llm import kernel
from changeloom.llm.shared import partitions

LENGTH, SHARD_TOKENS, SHARD_DOCS = 2048, 1 << 19, 1500
K1, B, BOUND_ROWS = 1.2, 0.75, 40_000
CACHED_WORDS = 500_000


class WordTokenizer:
    """A tokenizers file whose pieces never span white space, run once for each distinct word. Words are known by a 64-bit hash.

    Special tokens are found in a text as the library finds them; with plain_special their strings are ordinary text.
    """

    def __init__(self, path: str, plain_special: bool = False):
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = plain_special
        self.special = [] if plain_special else [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        vocab = self.tok.get_vocab(True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        for t, i in vocab.items():
            self.ends[i] = t.endswith("</w>")
        self.piece = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.clear()

    def clear(self) -> None:
        self.keys, self.start, self.size, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint16)

    def _pieces(self, word: str) -> int:
        if word.isalpha():
            return 1
        return len(self.piece.findall(unicodedata.normalize("NFC", word).lower()))

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words and how many each has. They are encoded as one text where its piece ends tell the words apart."""
        e = np.array(self.tok.encode(" ".join(words), add_special_tokens=False).ids, np.uint16)
        stop = np.concatenate([[0], np.flatnonzero(self.ends[e]) + 1])
        upto = np.cumsum([self._pieces(w) for w in words])
        if len(e) and stop[-1] == len(e) and upto[-1] == len(stop) - 1:
            return e, np.diff(np.concatenate([[0], stop[upto]]))
        own = [x.ids for x in self.tok.encode_batch(words, add_special_tokens=False)]  # a word whose pieces are not plain: one by one
        return np.array([i for x in own for i in x], np.uint16), np.array([len(x) for x in own])

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        """Adds words with their (sorted, new) keys."""
        got = [self._encode(words[i : i + 2000]) for i in range(0, len(words), 2000)]
        size = np.concatenate([x[1] for x in got])
        start = len(self.flat) + np.cumsum(size) - size
        self.flat = np.concatenate([self.flat, *(x[0] for x in got)])
        at = np.searchsorted(self.keys, keys)
        self.keys, self.start, self.size = np.insert(self.keys, at, keys), np.insert(self.start, at, start), np.insert(self.size, at, size)

    def encode(self, data: np.ndarray, offsets: np.ndarray, final: int) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all documents, each closed by `final`, and their lengths. Texts that hold a special token's string go to the library as a whole."""
        raw = data.tobytes()
        whole = [d for d in range(len(offsets) - 1) if any(raw.find(x, offsets[d], offsets[d + 1]) >= 0 for x in self.special)] if any(x in raw for x in self.special) else []
        flat, length = self._by_word(data, offsets, raw, final)
        if not whole:
            return flat, length
        upto = np.cumsum(length)
        own = {d: np.array([*self.tok.encode(raw[offsets[d] : offsets[d + 1]].decode(), add_special_tokens=False).ids, final], np.uint16) for d in whole}
        parts = [own[d] if d in own else flat[upto[d] - length[d] : upto[d]] for d in range(len(length))]
        return np.concatenate(parts), np.array([len(x) for x in parts])

    def _by_word(self, data: np.ndarray, offsets: np.ndarray, raw: bytes, final: int) -> tuple[np.ndarray, np.ndarray]:
        w = kernel.Words(data, offsets, marks=True)
        uniq, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
        if len(self.keys) + len(uniq) > CACHED_WORDS:
            self.clear()
        at = np.searchsorted(self.keys, uniq)
        known = self.keys[np.minimum(at, len(self.keys) - 1)] == uniq if len(self.keys) else np.zeros(len(uniq), bool)
        if not known.all():
            new = first[~known]
            self._learn(uniq[~known], [raw[s:e].decode() for s, e in zip(w.start[new].tolist(), w.end[new].tolist(), strict=True)])
            at = np.searchsorted(self.keys, uniq)
        slot = at[inverse]
        size = self.size[slot]
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(self.start[slot] - upto[:-1], size) + np.arange(upto[-1])]
        return np.insert(ids, upto[w.first[1:]], final), np.diff(upto[w.first]) + 1


class Index:
    """BM25 over the token ids of a shard's documents."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray):
        self.n = len(lengths)
        doc = np.repeat(np.arange(self.n, dtype=np.uint64), lengths)
        pair, tf = np.unique(doc | (flat.astype(np.uint64) << np.uint64(32)), return_counts=True)
        term, self.doc = (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
        self.at = np.searchsorted(term, np.arange(int(term[-1]) + 2))
        df = np.diff(self.at)[term]
        norm = K1 * (1 - B + B * lengths / max(1.0, lengths.mean()))
        self.weight = np.log1p((self.n - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + norm[self.doc])
        shared = np.flatnonzero(df > 1)
        by = shared[np.argsort(self.doc[shared], kind="stable")]
        self.terms, self.first = term[by], np.searchsorted(self.doc[by], np.arange(self.n + 1))

    def neighbours(self, seed: int) -> np.ndarray:
        """Documents by falling score for all of the seed's terms that others share."""
        t = self.terms[self.first[seed] : self.first[seed + 1]]
        size = self.at[t + 1] - self.at[t]
        upto = np.cumsum(size)
        if not len(t):
            return upto
        posting = np.repeat(self.at[t] - (upto - size), size) + np.arange(upto[-1])
        score = np.bincount(self.doc[posting], self.weight[posting], self.n)
        hit = np.flatnonzero(score)
        return hit[np.argsort(-score[hit], kind="stable")]


def pack_shard(flat: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of the pieces of one shard; sequences count from 0."""
    index = Index(flat, lengths)
    used, left = np.zeros(len(lengths), np.int64), lengths.astype(np.int64).copy()
    pieces, seq, total, later = [], 0, int(left.sum()), 0

    def take(d: int, n: int, offset: int) -> None:
        pieces.append((d, int(used[d]), n, seq, offset))
        used[d] += n
        left[d] -= n

    seed = 0
    while total >= LENGTH:
        while not left[seed]:
            seed += 1
        n = min(int(left[seed]), LENGTH)
        take(seed, n, 0)
        fill = n
        if fill < LENGTH:
            for d in index.neighbours(seed).tolist():
                n = min(int(left[d]), LENGTH - fill)
                if n:
                    take(d, n, fill)
                    fill += n
                    if fill == LENGTH:
                        break
        later = max(later, seed)
        while fill < LENGTH:  # no neighbour is left: the next unused document
            if left[later]:
                n = min(int(left[later]), LENGTH - fill)
                take(later, n, fill)
                fill += n
            else:
                later += 1
        seq += 1
        total -= LENGTH
    for size in (1 << k for k in range(LENGTH.bit_length() - 1, -1, -1)):
        if not total & size:
            continue
        fill = 0
        while fill < size:
            while not left[seed]:
                seed += 1
            n = min(int(left[seed]), size - fill)
            take(seed, n, fill)
            fill += n
        seq += 1
    return pieces


def content_keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text 16 bits of each of its three least distinct word hashes, the least first, above 16 zero bits: texts that share words have keys of one range."""
    w = kernel.Words(data, offsets, lower=True)
    hashes, some = w.hash.copy(), np.flatnonzero(w.counts())
    out, none = np.zeros(len(offsets) - 1, np.int64), np.iinfo(np.uint64).max
    for shift in (48, 32, 16):
        if len(some):
            least = np.minimum.reduceat(hashes, w.first[some])
            hashes[hashes == np.repeat(least, w.counts()[some])] = none
            out[some] |= ((least & np.uint64(0x7FFF if shift == 48 else 0xFFFF)) << np.uint64(shift)).view(np.int64)
    return out


def deal_by_content(docs: DataFrame) -> DataFrame:
    """doc_id, text in ranges of their content keys, sorted by them.

    The ranges are cut by the keys of about BOUND_ROWS rows, taken at random. The last bits of a key are of doc_id's hash, so
    that texts with equal words, however many they are, fall into several ranges too.
    """
    spark = docs.sparkSession

    def keyed(rows: DataFrame, bounds: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i, j, data, off in kernel.slices(b.column(1)):
                    key = content_keys(data, off) | b.column(2).slice(i, j - i).to_numpy()
                    part = pa.array(np.searchsorted(bounds, key).astype(np.int32))
                    yield pa.record_batch([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(key), part], names=["doc_id", "text", "key", "part"])

        return rows.select("doc_id", "text", F.xxhash64("doc_id").bitwiseAND(0xFFFF).alias("low")).mapInArrow(run, "doc_id long, text string, key long, part int")

    n, rows = partitions(spark), docs.count()
    some = docs.sample(min(1.0, BOUND_ROWS / max(rows, 1)), 7)
    cuts = keyed(some, np.zeros(0, np.int64)).approxQuantile("key", [i / n for i in range(1, n)], 0.1 / n) if n > 1 and rows else []
    return keyed(docs, np.unique(np.array(cuts, np.int64))).repartitionById(n, F.col("part")).sortWithinPartitions("key", "doc_id", "text").select("doc_id", "text")


_made: dict[tuple[str, bool], WordTokenizer] = {}


def tokenizer(path: str, plain_special: bool = False) -> WordTokenizer:
    """The tokenizer of a file, made once in each Python worker."""
    if (path, plain_special) not in _made:
        _made[path, plain_special] = WordTokenizer(path, plain_special)
    return _made[path, plain_special]


def pack_documents(docs: DataFrame, tokenizer_path: str, final: int = 1, with_ids: bool = False, plain_special: bool = False) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids where asked for) of all documents.

    A document is the ids of its whole text and `final`; a null text is empty, so one token. Strings of special tokens in a
    text are those tokens, as the library has it, or ordinary text with plain_special. Each id lies in one piece; sequences
    hold LENGTH tokens or a power of two. Texts are dealt once, by content; sequences never leave their task, and
    sequence_id is made of the partition and a count in it, the same again if a task is repeated. Rows that repeat a doc_id
    are packed each. An empty table gives no pieces; other columns are ignored. tokenizer_path must be readable on every
    executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        tok, seq = tokenizer(tokenizer_path, plain_special), 0
        ids, lens, names, tokens = [], [], [], 0

        def shard() -> pa.RecordBatch:
            nonlocal seq
            flat, length = np.concatenate(ids), np.concatenate(lens)
            doc = np.concatenate(names)
            at = np.cumsum(length) - length
            p = np.array(pack_shard(flat, length), np.int64)
            wide = flat.astype("<u4")
            cut = [wide[at[d] + s : at[d] + s + n] for d, s, n in p[:, :3].tolist()]
            cols = [pa.array(doc[p[:, 0]], from_pandas=True).cast(pa.int64()), pa.array(p[:, 1]), pa.array(p[:, 2]), pa.array([zlib.crc32(c) for c in cut], pa.int64()), pa.array(length[p[:, 0]].astype(np.int64)), pa.array((part << 32) + seq + p[:, 3]), pa.array(p[:, 4])]
            seq += int(p[:, 3].max()) + 1
            for x in (ids, lens, names):
                x.clear()
            return pa.record_batch(cols + ([pa.array([c.astype(np.int32) for c in cut], pa.list_(pa.int32()))] if with_ids else []), names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids)

        for b in batches:
            key = np.array(b.column(0).to_pylist(), object)
            for i, j, data, off in kernel.slices(b.column(1)):
                flat, length = tok.encode(data, off, final)
                ends = np.concatenate([[0], np.cumsum(length)])
                k = 0
                while k < len(length):  # whole documents until the shard is full
                    m = int(np.searchsorted(ends, ends[k] + SHARD_TOKENS - tokens, "right")) - 1
                    m = min(max(m, k + (not tokens)), k + SHARD_DOCS - sum(map(len, lens)), len(length))
                    if m > k:
                        ids.append(flat[ends[k] : ends[m]])
                        lens.append(length[k:m])
                        names.append(key[i + k : i + m])
                        tokens += int(ends[m] - ends[k])
                    if m < len(length):
                        yield shard()
                        tokens = 0
                    k = max(k, m)
        if ids:
            yield shard()

    ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return deal_by_content(docs.selectExpr("cast(doc_id as long) doc_id", "text")).mapInArrow(run, ddl)
