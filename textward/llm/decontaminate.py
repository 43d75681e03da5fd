"""Benchmark decontamination with suffix arrays of the training text.

Each Arrow batch of whole documents is a shard of the training text. A shard keeps the word runs in which every
word triple occurs somewhere in the benchmark (no other place can hold a match that counts), builds their suffix
array by prefix doubling, and binary-searches every benchmark suffix of a full window in it: the range of training
suffixes that begin with that window. Each of the range is followed to the end of its verbatim match, and the report
has the longest match of a document and its place. Suffixes shorter than the item's window can't count and aren't
searched. Shards are independent, so nothing is shuffled and no group of copies meets in one task.

The benchmark goes to the executors in blocks of about ``BLOCK_BYTES`` of text (or one item, if that is longer), one
broadcast each, and a shard searches block after block; the driver and a worker hold one block at a time. A block is
flat arrays of its words, so its size follows its text, however long an item is.

Defined cases: a null or empty text has no words, no hits and is kept; an item without words never occurs; an item
of fewer than ``window`` words is one window of its own length; benchmark rows of one item_id are one item, found
where any of them is; rows with one doc_id are reported row by row; an empty benchmark contaminates nothing; further
columns are dropped from the reports.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textward.llm.common import bound_batches, texts, trimmed

WINDOW = 10
#: UTF-8 bytes of benchmark text that one broadcast may hold.
BLOCK_BYTES = 8 << 20
#: Words of one sub-shard; a document is never split.
SHARD_WORDS = 2_000_000

#: A-Z to a-z; ASCII other than digits and letters to a space; other bytes stay.
FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))

REPORT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_words long, longest_item string, longest_at long, longest_item_at long"
#: Matches that are followed at once, and words by which they are.
FOLLOWED, STEP = 4096, 64
#: Windows that are searched at once.
SEARCHED = 1 << 18
MATCHES = "doc_id long, item_id string, word_at long, item_word_at int, n_words int"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


class Block:
    """A block of items: their words as numbers from 2, one item behind the other, and where windows begin."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.vocab: dict[bytes, int] = {}
        seqs = [(i, np.array([self.vocab.setdefault(w, len(self.vocab) + 2) for w in ws], np.int32)) for i, t in items if (ws := words(t))]
        self.ids = [i for i, _ in seqs]
        size = np.array([len(s) for _, s in seqs], np.int64)
        ends = np.cumsum(size)
        self.longest = int(size.max()) if len(size) else 0
        self.flat = np.concatenate([s for _, s in seqs]) if seqs else np.zeros(0, np.int32)
        need = np.minimum(window, size)  # words of a window of each item
        #: The suffixes that open a window: their items, their places among all words, in the item and to its end, their windows.
        self.item = np.repeat(np.arange(len(seqs)), size - need + 1)
        self.at = np.arange(len(self.item)) - np.repeat(np.cumsum(size - need + 1) - (size - need + 1), size - need + 1)
        self.place = (ends - size)[self.item] + self.at
        self.left = size[self.item] - self.at
        self.need = need[self.item]
        #: Runs of this many words select the training positions that can matter: 3, or fewer if an item is shorter.
        self.seed = min(3, int(need.min())) if len(need) else 0
        self.size = np.int64(len(self.vocab) + 2)
        grams = [self._code(s.astype(np.int64)) for _, s in seqs]
        self.grams = np.unique(np.concatenate(grams)) if grams else np.zeros(0, np.int64)

    def _code(self, w: np.ndarray) -> np.ndarray:
        """Numbers of the runs of ``seed`` words; 0 where a run holds a word that the block lacks."""
        n = len(w) - self.seed + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        out, known = w[:n].copy(), w[:n] > 0
        for k in range(1, self.seed):
            out = out * self.size + w[k : k + n]
            known &= w[k : k + n] > 0
        return np.where(known, out, 0)


def suffix_array(seq: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``seq`` in the order of their suffixes' first ``depth`` numbers, by prefix doubling."""
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64)
    k, order = 1, np.argsort(rank, kind="stable")
    while k < depth and len(seq):
        after = np.zeros(len(seq), np.int64)
        after[:-k] = rank[k:] + 1
        key = rank * (len(seq) + 1) + after
        order = np.argsort(key, kind="stable")
        step = np.concatenate(([0], (np.diff(key[order]) > 0).cumsum()))
        rank[order] = step
        if step[-1] == len(seq) - 1:
            break
        k *= 2
    return order


def _compare(seq: np.ndarray, at: np.ndarray, want: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row: the words that the training suffix at ``at`` shares with the ``length`` words of ``want`` from ``begin`` on; and whether it sorts below."""
    width = np.arange(int(length.max()) if len(length) else 0)
    look, ask = at[:, None] + width, begin[:, None] + width
    have = np.where(look < len(seq), seq[np.minimum(look, len(seq) - 1)], -2)
    need = want[np.minimum(ask, len(want) - 1)]
    differs = (have != need) & (width < length[:, None])
    shared = np.where(differs.any(1), differs.argmax(1), length)
    row, col = np.arange(len(at)), np.minimum(shared, len(width) - 1)
    return shared, (shared < length) & (have[row, col] < need[row, col])


def _followed(seq: np.ndarray, at: np.ndarray, want: np.ndarray, begin: int, length: int) -> np.ndarray:
    """How many of the ``length`` words of ``want`` from ``begin`` on each training suffix shares, ``STEP`` by ``STEP``."""
    shared, open_ = np.zeros(len(at), np.int64), np.arange(len(at))
    for k in range(0, length, STEP):
        if not len(open_):
            break
        step = min(STEP, length - k)
        more, _ = _compare(seq, at[open_] + k, want, np.full(len(open_), begin + k), np.full(len(open_), step))
        shared[open_] += more
        open_ = open_[more == step]
    return shared


def search(seq: np.ndarray, order: np.ndarray, want: np.ndarray, begin: np.ndarray, length: np.ndarray, upper: bool) -> np.ndarray:
    """The first place in ``order`` whose suffix isn't below the ``length`` words of ``want`` from ``begin`` on (upper: that is above them)."""
    lo, hi = np.zeros(len(begin), np.int64), np.full(len(begin), len(order), np.int64)
    while len(open_ := np.flatnonzero(lo < hi)):
        mid = (lo[open_] + hi[open_]) // 2
        shared, below = _compare(seq, order[mid], want, begin[open_], length[open_])
        if upper:
            below = below | (shared >= length[open_])
        lo[open_[below]] = mid[below] + 1
        hi[open_[~below]] = mid[~below]
    return lo


def search_shard(docs: list[list[bytes]], block: Block, longest: bool = False, best: bool = False) -> tuple[list[np.ndarray], list[set[str]], list[tuple[int, str, int, int, int]]]:
    """For each document its hit words (as word numbers) and items; with ``longest``, the longest matches too:
    (document, item, word of the document, word of the item, words), for each document position that a match begins;
    with ``best``, of each benchmark suffix only the first longest one in a document."""
    none = [np.zeros(0, np.int64) for _ in docs], [set() for _ in docs], []
    if not len(block.item):
        return none
    ends = np.cumsum([len(d) for d in docs])
    starts = ends - [len(d) for d in docs]
    get, zero = block.vocab.get, [0]
    parts = []
    for d in docs:  # a zero ends each document, so no run crosses
        parts.append(np.fromiter((get(w, 0) for w in d), np.int64, len(d)))
        parts.append(np.array(zero, np.int64))
    flat = np.concatenate(parts)
    offsets = starts + np.arange(len(docs))
    code = block._code(flat)
    live = np.flatnonzero(code)
    if len(live):
        live = live[block.grams[np.minimum(np.searchsorted(block.grams, code[live]), len(block.grams) - 1)] == code[live]]
    if not len(live):
        return none
    cover = np.zeros(len(flat), bool)
    for k in range(block.seed):
        cover[live + k] = True
    kept = np.flatnonzero(cover)
    gap = np.flatnonzero(np.diff(kept) > 1) + 1
    place = np.insert(kept, gap, -1)  # where each word of the shortened text stands; -1 between runs
    seq = np.where(place >= 0, flat[place], 1).astype(np.int64)
    order = suffix_array(seq, block.longest)
    need, seek = block.need, []
    for upper in (False, True):  # so many windows at once that their words are bounded
        parts = [slice(k, k + SEARCHED) for k in range(0, len(need), SEARCHED)]
        seek.append(np.concatenate([search(seq, order, block.flat, block.place[p], need[p], upper) for p in parts]))
    lo, hi = seek
    found = np.flatnonzero(hi > lo)
    marks, items = np.zeros(len(flat), bool), [set() for _ in docs]
    matches: list[tuple[int, str, int, int, int]] = []
    for f in found:  # one window of one item; the range may hold many documents
        at = place[order[lo[f] : hi[f]]]
        for k in range(need[f]):
            marks[at + k] = True
        item = block.ids[block.item[f]]
        for d in np.unique(np.searchsorted(offsets, at, side="right") - 1):
            items[d].add(item)
    for f in found if longest else ():
        item, item_at = block.ids[block.item[f]], int(block.at[f])
        for k in range(lo[f], hi[f], FOLLOWED):
            at = order[k : min(k + FOLLOWED, hi[f])]
            shared = _followed(seq, at, block.flat, block.place[f], block.left[f])
            where = place[at]
            own = np.searchsorted(offsets, where, side="right") - 1
            if best:
                first = np.lexsort((where, -shared, own))
                first = first[np.insert(np.diff(own[first]) > 0, 0, True)]
                where, shared, own = where[first], shared[first], own[first]
            matches += zip(own.tolist(), [item] * len(own), (where - offsets[own]).tolist(), [item_at] * len(own), shared.tolist(), strict=True)
    hits = [np.flatnonzero(marks[o : o + len(d)]) for o, d in zip(offsets, docs, strict=True)]
    return hits, items, matches


def _shards(docs: list[list[bytes]]) -> Iterator[tuple[int, int]]:
    begin, held = 0, 0
    for i, d in enumerate(docs):
        if held and held + len(d) > SHARD_WORDS:
            yield begin, i
            begin, held = i, 0
        held += len(d)
    yield begin, len(docs)


def blocks(benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> list:
    """Broadcasts of the benchmark's blocks. Each is collected by itself, after a count of bytes has set the number of blocks."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = total * 2 // block_bytes + 1
    sc = benchmark.sparkSession.sparkContext
    out = []
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        out.append(sc.broadcast(Block([(r["item_id"] if r["item_id"] is not None else "null", r["text"]) for r in part], window)))
    return out


def _each(shared: list) -> Iterator[Block]:
    """The blocks one after another; of several a worker holds one at a time."""
    for b in shared:
        yield b.value
        if len(shared) > 1 and hasattr(b, "_value"):
            del b._value


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: its words, those inside a benchmark window, the items, whether it is contaminated, and its
    longest verbatim match: words, item, the word where it begins in the document and in the item (the first by these
    of equally long ones; 0, null, -1 and -1 without a hit)."""
    spark = docs.sparkSession
    bound_batches(spark)
    shared = blocks(benchmark, window, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            ids, all_docs = batch.column("doc_id"), [words(t) for t in batch.column("text").to_pylist()]
            n_hit, names, longest = [], [], []
            for lo, hi in _shards(all_docs):
                docs_ = all_docs[lo:hi]
                hits, items = [np.zeros(0, np.int64)] * len(docs_), [set() for _ in docs_]
                top: list[tuple] = [(0, None, -1, -1)] * len(docs_)
                for block in _each(shared):
                    found, own, matches = search_shard(docs_, block, longest=True, best=True)
                    for d, i, p, q, n in matches:
                        top[d] = min(top[d], (-n, i, p, q))
                    hits = [np.union1d(x, y) if len(x) else y for x, y in zip(hits, found, strict=True)]
                    items = [x | y for x, y in zip(items, own, strict=True)]
                n_hit += [len(h) for h in hits]
                names += [sorted(x) for x in items]
                longest += top
            yield pa.RecordBatch.from_arrays(
                [
                    ids.cast(pa.int64()), pa.array([len(d) for d in all_docs], pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in names], pa.int64()),
                    pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names], pa.string()), pa.array([n > 0 for n in n_hit], pa.bool_()),
                    pa.array([-x[0] for x in longest], pa.int64()), pa.array([x[1] for x in longest], pa.string()), pa.array([x[2] for x in longest], pa.int64()), pa.array([x[3] for x in longest], pa.int64()),
                ],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_words", "longest_item", "longest_at", "longest_item_at"],
            )

    return texts(docs).mapInArrow(run, REPORT)


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Where benchmark suffixes of a window's length or more occur, and how far each verbatim match goes."""
    spark = docs.sparkSession
    bound_batches(spark)
    shared = blocks(benchmark, window, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            ids, all_docs = batch.column("doc_id").to_pylist(), [words(t) for t in batch.column("text").to_pylist()]
            for lo, hi in _shards(all_docs):
                for block in _each(shared):
                    rows = [(ids[lo + d], i, p, q, n) for d, i, p, q, n in search_shard(all_docs[lo:hi], block, longest=True)[2]]
                    for k in range(0, len(rows), 50_000):
                        cols = list(zip(*rows[k : k + 50_000], strict=True))
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "item_id", "word_at", "item_word_at", "n_words"])

    return texts(docs).mapInArrow(run, MATCHES)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the contaminated documents; all columns stay. Each row is judged by its own text: no join."""
    spark = docs.sparkSession
    bound_batches(spark)
    shared = blocks(benchmark, window, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            all_docs = [words(t) for t in batch.column("text").to_pylist()]
            keep = []
            for lo, hi in _shards(all_docs):
                hit = np.zeros(hi - lo, bool)
                for block in _each(shared):
                    hit |= [len(h) > 0 for h in search_shard(all_docs[lo:hi], block)[0]]
                keep += (~hit).tolist()
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
