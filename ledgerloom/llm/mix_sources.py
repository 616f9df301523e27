"""Problem 9: mixing sources to target weights.

Documents are measured in tokens of a public tokenizer and hashed into blocks of their source, of a size that doesn't
depend on the corpus. The exact quota of every source is a number of whole passes, whole blocks of one more pass in
permuted order, and the part of one last block. The block quotas are split among the output shards by a tree of
multivariate hypergeometric draws, each shard then takes disjoint runs of the permuted blocks and is shuffled locally.

Quotas, blocks and their shards are tables. A node of the tree draws from its own random stream, so the driver draws
the upper nodes only, down to `SUBTREE` shards, and tasks draw the rest. The driver sees the totals of the sources, at
most `CHUNKS` sums of each source's blocks, and one row for `SUBTREE` shards. Permutations are arithmetic, so they need
no order of all blocks. A shard holds about `SHARD_TOKENS`, whatever the corpus, so one task may shuffle it.

Defined cases: a document without a source, or of a source without a target, isn't mixed; null texts have no tokens and
aren't mixed; a source with a target but no text is reported with share 0 and its target is left out of the total;
repeated rows are documents of their own (equal ids with one source are copies of one document); ties in hash order go
to the smaller id; empty tables give empty results; other columns are never read.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.session import keep, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of such rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK_TOKENS, SHARD_TOKENS, SEED = 1 << 15, 1 << 22, 5
#: Shards whose quotas one task draws; sums of blocks that the driver sees for each source.
SUBTREE, CHUNKS = 1024, 1024
#: Blocks of one draw that the generator allows, and bytes of a vocabulary that is sent to the executors.
MOST_BLOCKS, MOST_VOCABULARY = 10**9, 64 << 20
#: Block copies that are sent to the documents; more of them meet by a shuffle.
BROADCAST_BLOCKS = 200_000


def _encoding(vocabulary: bytes, pattern: str):
    """The tokenizer of a rank file, kept by the Python worker between its tasks."""
    import tiktoken

    kept = tiktoken.__dict__.setdefault("_by_content", {})
    key = hash((vocabulary, pattern))
    if key not in kept:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        kept[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return kept[key]


def _count(vocabulary, pattern: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = _encoding(vocabulary.value, pattern)
        for pdf in batches:
            n = [len(e.encode_ordinary(t)) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "n_tokens": n})

    return run


def measured(docs: DataFrame, tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """doc_id, source, n_tokens of the documents with a source and a text, tokenized once. The vocabulary is read by the driver only."""
    if os.path.getsize(tokenizer) > MOST_VOCABULARY:
        raise ValueError(f"vocabulary of more than {MOST_VOCABULARY} bytes")
    with open(tokenizer, "rb") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.where("text IS NOT NULL AND source IS NOT NULL").select(F.col("doc_id").cast("long"), "source", "text")
    return keep(spread(rows).mapInPandas(_count(vocabulary, pattern), "doc_id long, source string, n_tokens long"), "tokens")


def permutation(n: int, rng: np.random.Generator) -> tuple[int, int, int]:
    """a, c and the inverse of a: i -> (a * i + c) mod n is a permutation of 0..n-1."""
    if n < 2:
        return 1, 0, 1
    while True:
        a = int(rng.integers(1, n))
        if math.gcd(a, n) == 1:
            return a, int(rng.integers(0, n)), pow(a, -1, n)


def draw(quotas: list[int], first: int, shards: int, seed: int) -> tuple[list[int], list[int]]:
    """The node of the tree over shards first..first+shards-1: its halves' block quotas, the left one drawn without replacement."""
    left, total = shards // 2, sum(quotas)
    rng = np.random.default_rng([seed, first, shards])
    drawn = rng.multivariate_hypergeometric(quotas, total * left // shards, method="marginals") if total else np.zeros(len(quotas), int)
    return [int(d) for d in drawn], [q - int(d) for q, d in zip(quotas, drawn, strict=True)]


def split_tree(quotas: list[int], shards: int, seed: int, first: int = 0, down_to: int = 1) -> Iterator[tuple[int, int, list[int]]]:
    """(first shard, number of shards, block quotas) of the nodes with at most down_to shards, in order."""
    if shards <= down_to:
        yield first, shards, list(quotas)
        return
    left, right = draw(quotas, first, shards, seed)
    yield from split_tree(left, shards // 2, seed, first, down_to)
    yield from split_tree(right, shards - shards // 2, seed, first + shards // 2, down_to)


@dataclass
class Quota:
    """What a source gives: all its blocks `passes` times, `whole` more, and `limit` tokens of the next one if there is a limit."""

    source: str
    blocks: int
    passes: int
    whole: int = 0
    limit: int | None = None
    #: Multiplier, shift and inverse of the orders of the blocks and of the copies.
    order: tuple[int, int, int] = (1, 0, 1)
    turn: tuple[int, int, int] = (1, 0, 1)

    @property
    def copies(self) -> int:
        return self.passes * self.blocks + self.whole + (self.limit is not None)


def sizes(totals: dict[str, tuple[int, int]], block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS) -> dict[str, int]:
    """Number of blocks of every source (tokens, documents): of at most a quarter of a shard, and no more than its documents."""
    each = min(max(block_tokens, -(-64 * sum(n for n, _ in totals.values()) // MOST_BLOCKS)), max(1, shard_tokens // 4))
    return {s: max(1, min(math.ceil(n / each), d)) for s, (n, d) in totals.items()}


def targets_of(totals: dict[str, tuple[int, int]], targets: dict[str, tuple[float, int]], total: float | None = None) -> tuple[float, dict[str, tuple[int, int]]]:
    """The mix's size and for every source its whole passes and the tokens of one more. Without a total it is the largest one that meets every target within its repeats."""
    live = {s: t for s, t in targets.items() if totals.get(s, (0, 0))[0] > 0 and t[0] > 0 and t[1] > 0}
    if not live:
        return 0.0, {}
    weight = sum(t[0] for t in live.values())
    if total is None:
        total = min(live[s][1] * totals[s][0] * weight / live[s][0] for s in live)
    out = {}
    for s, (share, most) in sorted(live.items()):
        size = totals[s][0]
        quota = min(share / weight * total, most * size)
        passes = min(int(quota // size), most)
        out[s] = (passes, int(round(quota - passes * size)) if passes < most else 0)
    return total, out


def _copies(quotas: list[Quota], seed: int):
    """Copies of blocks with their shards, for the shards of every node."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for first, shards, nums, starts in zip(pdf["first"], pdf["shards"], pdf["quotas"], pdf["starts"], strict=True):
                leaves = list(split_tree([int(n) for n in nums], int(shards), seed, int(first)))
                for k, q in enumerate(quotas):
                    counts = [leaf[2][k] for leaf in leaves]
                    if not sum(counts):
                        continue
                    at = np.arange(int(starts[k]), int(starts[k]) + sum(counts), dtype=np.int64)
                    nth = (at - q.turn[1]) % q.copies * q.turn[2] % q.copies
                    block = (nth % q.blocks - q.order[1]) % q.blocks * q.order[2] % q.blocks
                    last = nth == q.copies - 1 if q.limit is not None else np.zeros(len(nth), bool)
                    yield pd.DataFrame({"source": q.source, "block": block, "copy": (nth // q.blocks).astype("int32"), "shard": np.repeat([leaf[0] for leaf in leaves], counts), "limit": pd.array(np.where(last, q.limit or 0, -1), dtype="int64")})

    return run


def block_copies(spark: SparkSession, quotas: list[Quota], total: float, shard_tokens: int = SHARD_TOKENS, seed: int = SEED) -> DataFrame:
    """source, block, copy, shard, limit (-1 for whole blocks): every copy of a block in the mix and where it goes."""
    shards = max(1, math.ceil(total / shard_tokens))
    at, nodes = [0] * len(quotas), []
    for first, n, nums in split_tree([q.copies for q in quotas], shards, seed, down_to=SUBTREE):
        nodes.append((first, n, nums, list(at)))
        at = [a + b for a, b in zip(at, nums, strict=True)]
    table = spark.createDataFrame(nodes, "first long, shards long, quotas array<long>, starts array<long>").repartition(min(len(nodes), 10_000), "first")
    return table.mapInPandas(_copies(quotas, seed), "source string, block long, copy int, shard long, limit long")


def _last_pass(sums: DataFrame, wanted: dict[str, int], quotas: dict[str, Quota]) -> None:
    """Sets whole and limit of the quotas: how many blocks in permuted order, and how many tokens of the next one, make the wanted tokens.

    sums: source, block, n. Block sums are added up in at most CHUNKS runs of a source; only the run that the quota ends in is ordered.
    """
    spark = sums.sparkSession
    todo = {s: n for s, n in wanted.items() if n > 0}
    if not todo:
        return
    of = spark.createDataFrame([(s, *quotas[s].order[:2], quotas[s].blocks, -(-quotas[s].blocks // CHUNKS)) for s in todo], "source string, a long, c long, n_blocks long, run long")
    placed = sums.join(F.broadcast(of), "source").withColumn("place", F.expr("pmod(pmod(a * block, n_blocks) + c, n_blocks)"))
    placed = placed.select("source", "place", "n", F.floor(F.col("place") / F.col("run")).alias("chunk"))
    edges: dict[str, tuple[int, int]] = {}
    left = dict(todo)
    for s, chunk, n in sorted(placed.groupBy("source", "chunk").agg(F.sum("n")).collect()):
        if s in left and s not in edges:
            if n > left[s]:
                edges[s] = (chunk, left[s])
            else:
                left[s] -= n
    for s in todo:
        quotas[s].whole = quotas[s].blocks
    if not edges:
        return
    end = spark.createDataFrame([(s, *e) for s, e in edges.items()], "source string, chunk long, rest long")
    order = Window.partitionBy("source").orderBy("place")
    near = placed.join(F.broadcast(end), ["source", "chunk"]).withColumn("before", F.sum("n").over(order) - F.col("n"))
    # The first block that doesn't fit whole; blocks without documents have no sum and take no tokens.
    cut = near.where("before + n > rest").groupBy("source").agg(F.min_by(F.struct("place", (F.col("rest") - F.col("before")).alias("limit")), "place").alias("x")).select("source", "x.place", "x.limit")
    for s, place, limit in cut.collect():
        quotas[s].whole, quotas[s].limit = place, limit


def mix(docs: DataFrame, targets: DataFrame, total: float | None = None, tokenizer: str = TOKENIZER, block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS, seed: int = SEED) -> DataFrame:
    """shard, position, doc_id, source, copy, n_tokens: the mixed corpus, every row one copy of one document.

    A document's copies number at most its source's max_repeats. The last block of a source is cut at the document that
    would exceed the quota, so a source's tokens miss its quota by less than one document.
    """
    spark = docs.sparkSession
    target = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in targets.where("source IS NOT NULL AND target_share IS NOT NULL AND max_repeats IS NOT NULL").toLocalIterator()}
    sized = measured(docs, tokenizer).where(F.col("source").isin(list(target)))
    totals = {r[0]: (int(r[1] or 0), int(r[2])) for r in sized.groupBy("source").agg(F.sum("n_tokens"), F.count("*")).collect()}
    schema = "shard long, position long, doc_id long, source string, copy int, n_tokens long"
    total, wanted = targets_of(totals, target, total)
    if not wanted:
        return spark.createDataFrame([], schema)
    counts, rng = sizes(totals, block_tokens, shard_tokens), np.random.default_rng(seed)
    quotas = {s: Quota(s, counts[s], passes, order=permutation(counts[s], rng)) for s, (passes, _) in wanted.items()}
    numbers = spark.createDataFrame(list(counts.items()), "source string, n_blocks long")
    blocked = sized.join(F.broadcast(numbers), "source").withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("n_blocks"))).drop("n_blocks")
    sums = keep(blocked.groupBy("source", "block").agg(F.sum("n_tokens").alias("n")), "blocks")
    _last_pass(sums, {s: rest for s, (_, rest) in wanted.items()}, quotas)
    live = [q for q in quotas.values() if q.copies]
    for q in live:
        q.turn = permutation(q.copies, rng)
    taken = keep(block_copies(spark, live, total, shard_tokens, seed), "copies")
    few = sum(q.copies for q in live) <= BROADCAST_BLOCKS
    rows = blocked.join(F.broadcast(taken) if few else taken.hint("merge"), ["source", "block"])
    whole = rows.where("limit < 0")
    # One cut block for each source: its documents, in hash order, up to the limit.
    order = Window.partitionBy("source", "block", "copy").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id")
    cut = rows.where("limit >= 0").withColumn("sum", F.sum("n_tokens").over(order)).where("sum <= limit").drop("sum")
    local = Window.partitionBy("shard").orderBy(F.xxhash64("doc_id", "copy", F.lit(seed + 2)), "doc_id", "copy")
    return whole.unionByName(cut).select("shard", (F.row_number().over(local) - 1).cast("long").alias("position"), "doc_id", "source", "copy", "n_tokens")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, max_repeats, n_rows, n_docs, repeats, tokens, share: what every source reached."""
    by = mixed.groupBy("source", "doc_id").agg(F.count("*").alias("c"), F.sum("n_tokens").alias("t")).groupBy("source").agg(F.sum("c").alias("n_rows"), F.count("*").alias("n_docs"), F.max("c").alias("repeats"), F.sum("t").alias("tokens"))
    all_ = by.agg(F.sum("tokens").alias("all"))
    out = targets.where("source IS NOT NULL").join(by, "source", "left").crossJoin(F.broadcast(all_))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("source", "target_share", "max_repeats", zero("n_rows"), zero("n_docs"), zero("repeats"), zero("tokens"), F.coalesce(F.round(F.col("tokens") / F.col("all"), 6), F.lit(0.0)).alias("share"))


def reached(mixed: DataFrame, docs: DataFrame, targets: DataFrame) -> DataFrame:
    """source, max_repeats, meets, within: whether every source with text reached its target up to two documents, within its repeats."""
    live = docs.where("length(text) > 0").select("source").distinct()
    out = shares(mixed, targets).where("target_share > 0 AND max_repeats > 0").join(live, "source", "left_semi")
    sums = mixed.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("all"), F.coalesce(F.max("n_tokens"), F.lit(0)).alias("longest"))
    weight = out.agg(F.sum("target_share").alias("weight"))
    j = out.crossJoin(F.broadcast(sums)).crossJoin(F.broadcast(weight))
    return j.select("source", "max_repeats", (F.abs(F.col("tokens") - F.col("all") * F.col("target_share") / F.col("weight")) <= 2 * F.col("longest")).alias("meets"), (F.col("repeats") <= F.col("max_repeats")).alias("within"))
