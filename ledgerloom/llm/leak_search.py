"""Problem 8: evaluation texts leaking into training text.

Containment search with size-partitioned MinHash. A leak is one stretch of at least half an item, so every item is cut
into pieces of a quarter of its words such that any such stretch holds a whole piece. Pieces are partitioned by size;
for every size class the documents are read as overlapping windows half as long again as the class's largest piece, so
a piece that a document holds becomes a window of high Jaccard similarity. Signatures of 64 bands of two minima form an
inverted index of the items; windows and index meet in one join, and exact shingle containment and an exact alignment
of the words decide.

The documents are scanned once, however many items there are. A bitmap of the items' shingles (bounded by `MOST_BITS`;
a fuller one only lets more windows pass) tells which windows can share anything with an item of their class; only
documents with such windows are written down for the join and the verification. No item, link or fingerprint is
collected: the driver sees the classes and the bitmap.

Items are matched by three-word shingles, because a leak may be half an item with changed words (five would lose
those); letter case, punctuation and white space don't count. Misses: a window of similarity 0.4 to a piece (every tenth
word changed) is overlooked with a probability of (1 - 0.16)^64, about 1 in 70,000, and a leak has one piece or more.

Defined cases: null and empty texts hold nothing; items of fewer than three words are never found, items of three to
five words only where three words in a row are left; equal items, null and repeated ids are each reported; repeated
documents are each reported; very long texts are scanned whole; empty tables give an empty result; other columns are
never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import keep, spread

SHINGLE, BANDS, ROWS, SEED = 3, 64, 2, 11
#: Half of an item's words, in order and in one stretch, make a leak.
SHARE = 0.5
#: Exact share of an item's shingles below which an alignment can't reach SHARE unless every third word is changed.
SHINGLE_SHARE = 0.1
#: Sizes of pieces within a class differ by at most this factor.
CLASS_RATIO = 1.2
#: Bits of the bitmap for each word of an item, and at most (64 MB); bits that a shingle sets.
BITS_EACH, MOST_BITS, PROBES = 64, 1 << 29, 3

_BIG = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the lower-case words of a text."""
    return F.transform(F.array_remove(F.split(F.lower(text), r"(?U)\W+"), ""), lambda w: F.xxhash64(w))


def shingles(words: np.ndarray) -> np.ndarray:
    w = words.view(np.uint64)
    if len(w) < SHINGLE:
        return np.zeros(0, np.uint64)
    s = np.zeros(len(w) - SHINGLE + 1, np.uint64)
    for i in range(SHINGLE):
        s = (s ^ w[i : len(w) - SHINGLE + 1 + i]) * _MIX
        s ^= s >> np.uint64(29)
    return s


def hash_functions() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(SEED)
    n = BANDS * ROWS
    return r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, n, dtype=np.uint64)


def class_sizes(most: int) -> list[int]:
    """The largest piece, in shingles, of every size class up to one that holds `most`."""
    sizes = [1]
    while sizes[-1] < most:
        sizes.append(max(sizes[-1] + 1, int(sizes[-1] * CLASS_RATIO)))
    return sizes


def pieces(n: int, share: float = SHARE) -> list[tuple[int, int]]:
    """(start, end) of the pieces of an item of n words: every stretch of share * n words holds one of them, if it has SHINGLE words."""
    stretch = math.ceil(n * share)
    size = min(n, max(SHINGLE, stretch // 2))
    starts = list(range(0, n - size + 1, max(1, stretch - size + 1)))
    if starts[-1] != n - size:
        starts.append(n - size)
    return [(a, a + size) for a in starts]


def band_keys(low: np.ndarray, of_class: int) -> np.ndarray:
    """Join keys of signatures (one row each): a hash of class, band and the band's minima."""
    key = np.arange(BANDS, dtype=np.uint64)[None, :] * _MIX + np.uint64(of_class)
    for r in range(ROWS):
        key = (key ^ low[:, r::ROWS]) * _MIX
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def signatures(windows: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Minima of the valid shingles of every row under every hash function."""
    a, b = hash_functions()
    most = np.uint64(0xFFFFFFFFFFFFFFFF)
    return np.stack([np.where(valid, windows * x + y, most).min(axis=1) for x, y in zip(a, b, strict=True)], axis=1)


def bits_of(s: np.ndarray, of_class: int, bits: int, probe: int) -> np.ndarray:
    """Places of shingles of a class in the bitmap."""
    h = (s ^ np.uint64(of_class * int(_MIX) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return ((h * np.uint64(2 * probe + 1) + (h >> np.uint64(29)) * np.uint64(probe)) >> np.uint64(8) & np.uint64(bits - 1)).astype(np.int64)


def aligned_words(item: np.ndarray, words: np.ndarray) -> int:
    """Words of the item in the best local alignment (match +1, changed, extra or missing word -1)."""
    j = np.arange(1, len(words) + 1, dtype=np.int64) * _BIG
    row, best = np.zeros(len(words) + 1, np.int64), 0
    for x in item:
        diagonal = row[:-1] + np.where(words == x, _BIG + 1, -_BIG)
        t = np.maximum(np.maximum(diagonal, row[1:] - _BIG), 0)
        new = np.maximum.accumulate(t + j) - j
        row = np.concatenate(([0], np.where(new < _BIG, 0, new)))
        # Score in the upper part, matched words in the lower part.
        best = max(best, int(row.max()))
    return best % _BIG


def _cut(words: np.ndarray, share: float) -> Iterator[tuple[int, np.ndarray]]:
    """Class and shingles of the pieces of one item."""
    for a, b in pieces(len(words), share):
        s = shingles(words[a:b])
        yield class_sizes(len(s))[-1], s


def _index(share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, classes, keys = [], [], []
            for i, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for size, s in _cut(np.array(w, np.int64), share):
                    ids.append(i)
                    classes.append(size)
                    keys.append(band_keys(signatures(s[None, :], np.ones((1, len(s)), bool)), size)[0].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(classes, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], names=["item", "class", "keys"])

    return run


_CHUNK = 1 << 16


def _bits(share: float, bits: int):
    """Parts of the bitmap that one partition's items set: (chunk, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            for w in batch.column(1).to_pylist():
                for size, s in _cut(np.array(w, np.int64), share):
                    for at in (bits_of(s, size, bits, k) for k in range(PROBES)):
                        for c in np.unique(at // _CHUNK):
                            part = own.setdefault(int(c), np.zeros(_CHUNK, bool))
                            part[at[at // _CHUNK == c] % _CHUNK] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int32()), pa.array([np.packbits(p).tobytes() for p in own.values()], pa.binary())], names=["chunk", "part"])

    return run


def _either(pdf: pd.DataFrame) -> pd.DataFrame:
    parts = np.bitwise_or.reduce(np.stack([np.frombuffer(p, np.uint8) for p in pdf["part"]]))
    return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "part": [parts.tobytes()]})


def bitmap(items: DataFrame, share: float, bits: int) -> np.ndarray:
    """The bitmap of the shingles of all items: at most MOST_BITS bits, whatever their number."""
    parts = items.select("item", "words").mapInArrow(_bits(share, bits), "chunk int, part binary").groupBy("chunk").applyInPandas(_either, "chunk int, part binary")
    out = np.zeros(bits // 8, np.uint8)
    for chunk, part in parts.collect():
        own = np.frombuffer(bytes(part), np.uint8)
        out[chunk * (_CHUNK // 8) : chunk * (_CHUNK // 8) + len(own)] = own
    return out


def _known(table: np.ndarray, bits: int, s: np.ndarray, size: int) -> np.ndarray:
    """Which shingles an item of the class may have."""
    left = np.arange(len(s))
    for k in range(PROBES):
        at = bits_of(s[left], size, bits, k)
        left = left[(table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1]
    has = np.zeros(len(s), bool)
    has[left] = True
    return has


def _least(size: int) -> int:
    """Shingles of an item that a window must hold."""
    return max(1, math.ceil(SHINGLE_SHARE * size / CLASS_RATIO))


def _windows(s: np.ndarray, size: int, has: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """First shingle, shingles and validity of the windows of one document that share enough with the class's items, and the windows' length."""
    step = max(1, -(-size // 2))
    # Three blocks make a window: half as long again as the largest piece.
    counts = np.add.reduceat(has.astype(np.int64), np.arange(0, len(s), step))
    counts = counts + np.append(counts[1:], 0) + np.append(counts[2:], [0, 0])[: len(counts)]
    near = np.flatnonzero(counts >= _least(size))
    at = near[:, None] * step + np.arange(3 * step)[None, :]
    valid = at < len(s)
    return near * step, s[np.minimum(at, len(s) - 1)], valid, 3 * step


def _scan(shared, bits: int, classes: list[int]):
    """Rows of documents (words) and of their windows (class, start, keys) that can hold an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, n = shared.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            words = batch.column(1)
            values = words.values.to_numpy(zero_copy_only=False)
            ends = words.offsets.to_numpy()
            all_, first, last = shingles(values), ends[:-1].astype(np.int64), ends[1:].astype(np.int64)
            whole = np.ones(len(all_), bool)
            for back in range(1, SHINGLE):  # shingles across the end of a document
                whole[last[(last >= back) & (last - back < len(all_))] - back] = False
            cols: list[list] = [[], [], [], [], [], [], []]
            found: dict[int, int] = {}
            for size in classes:
                has = _known(table, bits, all_, size) & whole
                sums, at = np.concatenate(([0], np.cumsum(has))), np.flatnonzero(has)
                dense = at[sums[np.minimum(at + 3 * max(1, -(-size // 2)), len(has))] - sums[at] >= _least(size)]
                for d in np.unique(np.searchsorted(last, dense, "right")).tolist():
                    span = slice(int(first[d]), int(last[d]) - SHINGLE + 1)
                    starts, rows, valid, length = _windows(all_[span], size, has[span])
                    if len(starts):
                        uid = found.setdefault(d, n + len(found))
                        keys = band_keys(signatures(rows, valid), size)
                        for at_, k in zip(starts.tolist(), keys.tolist(), strict=True):
                            for col, v in zip(cols, (uid, None, None, None, at_, at_ + length, k), strict=True):
                                col.append(v)
            for d, uid in found.items():
                for col, v in zip(cols, (uid, batch.column(0)[d].as_py(), values[first[d] : last[d]].tolist(), True, None, None, None), strict=True):
                    col.append(v)
            n += len(found)
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.bool_(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc", "doc_id", "words", "text", "start", "end", "keys"])

    return run


def best_alignment(own: np.ndarray, words: np.ndarray, spans: list[tuple[int, int]]) -> int:
    """Most words of an item aligned around the given windows of a document."""
    n, mine = len(own), np.unique(shingles(own))
    merged: list[list[int]] = []
    for a, b in sorted((max(0, a - n), min(len(words), b + SHINGLE + n)) for a, b in spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    best = 0
    for a, b in merged:
        part = words[a:b]
        if np.isin(mine, shingles(part)).mean() >= SHINGLE_SHARE:
            best = max(best, aligned_words(own, part))
    return best


def _verify(share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, items, shares, counts = [], [], [], []
            for doc, item, own, words, spans in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                n = best_alignment(np.array(own, np.int64), np.array(words, np.int64), [(x["start"], x["end"]) for x in spans])
                if n >= share * len(own):
                    docs.append(doc)
                    items.append(item)
                    shares.append(n / len(own))
                    counts.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(items, pa.int64()), pa.array(shares, pa.float64()), pa.array(counts, pa.int32())], names=["doc_id", "passage_id", "share", "n_words"])

    return run


def leaks(docs: DataFrame, items: DataFrame, share: float = SHARE, most_bits: int = MOST_BITS) -> DataFrame:
    """doc_id, passage_id, share, n_words: documents that hold at least `share` of an item's words as one stretch."""
    spark = docs.sparkSession
    words = word_hashes(F.col("text")).alias("words")
    wanted = items.where("text IS NOT NULL").select(F.monotonically_increasing_id().alias("item"), F.col("passage_id").cast("long").alias("passage_id"), words)
    wanted = keep(wanted.where(F.size("words") >= SHINGLE), "items")
    index = keep(wanted.select("item", "words").mapInArrow(_index(share), "item long, class int, keys array<long>"), "index")
    total = wanted.agg(F.sum(F.size("words"))).first()[0] or 0
    bits = max(_CHUNK, min(most_bits, 1 << math.ceil(math.log2(max(2, BITS_EACH * total)))))
    classes = sorted(r[0] for r in index.select("class").distinct().collect())
    table = spark.sparkContext.broadcast(bitmap(wanted, share, bits))
    hashed = spread(docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", words)
    seen = keep(hashed.mapInArrow(_scan(table, bits, classes), "doc long, doc_id long, words array<long>, text boolean, start int, end int, keys array<long>"), "windows")
    windows = seen.where("keys IS NOT NULL").select("doc", "start", "end", F.explode("keys").alias("key"))
    hits = windows.join(index.select("item", F.explode("keys").alias("key")).distinct(), "key")
    spans = hits.groupBy("doc", "item").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    texts = seen.where("text").select("doc", "doc_id", "words")
    # An alignment costs more than its bytes tell, so the adaptive planner must not merge these partitions: the places are
    # spread by document before the texts meet them, which moves no text once more.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = spans.repartition(tasks, "doc").join(texts, "doc").join(wanted.select("item", "passage_id", F.col("words").alias("own")), "item")
    return pairs.select("doc_id", "passage_id", "own", "words", "spans").mapInArrow(_verify(share), "doc_id long, passage_id long, share double, n_words int")
