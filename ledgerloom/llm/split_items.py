"""Problem 7: splitting oversized items at natural boundaries.

A dynamic programme over boundary positions minimises the sum of cut penalties (paragraph, line, sentence, clause,
word, anywhere) and squared size imbalance, under the maximum length and with an exact overlap.

Defined cases: a null text has no pieces; an empty or short text is one piece; a text without any boundary is cut
anywhere; positions and lengths are in code points; repeated (id, text) rows are split once, and one id with several
texts gives pieces of each; a null id stays null; ties go to the earlier cut; an empty table gives an empty result;
other columns are never read. Whole texts are processed; texts never travel between executors twice.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1500, 100
#: Cut penalties; one unit weighs as much as an imbalance of half a limit.
PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD, ANYWHERE = 0.0, 0.5, 1.0, 3.0, 6.0, 20.0
IMBALANCE = 4.0
# Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = ("Ltd.", "Inc.", "Co.", "Corp.", "No.", "Mr.", "Ms.", "Dr.", "St.", "vs.", "e.g.", "i.e.")
NATURAL = re.compile(r"(?P<p>\s*\n\s*\n\s*)|(?P<l>\s*\n\s*)|(?<=[.!?。！？])(?P<s>[\"'”’)\]]*\s+)|(?<=[。！？])(?P<z>)")
FINER = re.compile(r"(?<=[,;:])(?P<c>\s+)|(?P<w>\s+)")


def boundaries(text: str, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions a piece may end at, with their penalties; finer ones only where the next natural one is out of reach."""
    at: dict[int, float] = {}

    def add(pos: int, penalty: float) -> None:
        if 0 < pos < len(text):
            at[pos] = min(penalty, at.get(pos, np.inf))

    for m in NATURAL.finditer(text):
        if m.lastgroup == "p":
            add(m.end(), PARAGRAPH)
        elif m.lastgroup == "l":
            add(m.end(), LINE)
        elif not text.endswith(ABBREVIATIONS, max(0, m.start() - 5), m.start()):
            add(m.end(), SENTENCE)

    def gaps() -> list[tuple[int, int]]:
        p = [0, *sorted(at), len(text)]
        return [(a, b) for a, b in zip(p, p[1:], strict=False) if b - a > reach]

    for a, b in gaps():
        for m in FINER.finditer(text, a, b):
            add(m.end(), CLAUSE if m.lastgroup == "c" else WORD)
    for a, b in gaps():
        for pos in range(a + 1, b):
            if (pos - a) % min(25, reach) == 0:
                add(pos, ANYWHERE)
    pos = np.array(sorted(at), dtype=np.int64)
    return pos, np.array([at[p] for p in pos.tolist()])


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the pieces: each at most limit long, each beginning overlap characters before its predecessor's end."""
    if not 0 <= overlap < limit:
        raise ValueError("0 <= overlap < limit")
    n, step = len(text), limit - overlap
    if n <= limit:
        return [(0, n)]
    pos, penalty = boundaries(text, step)
    pos, penalty = np.append(pos, n), np.append(penalty, 0.0)
    pieces = -(-(n - overlap) // step)
    ideal = (n + (pieces - 1) * overlap) / pieces
    # cost[j]: best cost of a split whose last piece ends at pos[j]; the first piece has no overlap before it.
    first = (pos <= limit) & (pos > overlap)
    cost = np.where(first, penalty + IMBALANCE * ((pos - ideal) / limit) ** 2, np.inf)
    back = np.full(len(pos), -1)
    low = np.searchsorted(pos, pos - step, side="left")
    for j in range(1, len(pos)):
        i = slice(low[j], j)
        if low[j] < j:
            length = pos[j] - pos[i] + overlap
            c = cost[i] + IMBALANCE * ((length - ideal) / limit) ** 2
            k = int(np.argmin(c))
            if c[k] + penalty[j] < cost[j]:
                cost[j], back[j] = c[k] + penalty[j], low[j] + k
    ends, j = [], len(pos) - 1
    while j >= 0:
        ends.append(int(pos[j]))
        j = back[j]
    ends.reverse()
    return [(0 if i == 0 else ends[i - 1] - overlap, e) for i, e in enumerate(ends)]


def _split(limit: int, overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, no, start, end, text = [], [], [], [], []
            for i, t in zip(pdf["id"], pdf["text"], strict=True):
                for k, (a, b) in enumerate(cuts(t, limit, overlap)):
                    ids.append(i)
                    no.append(k)
                    start.append(a)
                    end.append(b)
                    text.append(t[a:b])
            if not ids:
                continue
            yield pd.DataFrame({"id": pd.Series(ids, dtype=object), "piece": no, "start": start, "end": end, "text": text})

    return run


def pieces(df: DataFrame, id_: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, short: bool = True) -> DataFrame:
    """id, piece, start, end, text: the pieces of every distinct (id, text); with short=False only of those over the limit."""
    rows = df.select(F.col(id_).cast("string").alias("id"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL")
    long_ = rows.where(F.length("text") > limit).groupBy("id", "text").agg(F.lit(1).alias("n")).select("id", "text")
    out = long_.mapInPandas(_split(limit, overlap), "id string, piece int, start int, end int, text string")
    if short:
        whole = rows.where(F.length("text") <= limit).distinct()
        out = out.unionByName(whole.select("id", F.lit(0).alias("piece"), F.lit(0).alias("start"), F.length("text").alias("end"), "text"))
    return out.withColumnRenamed("id", id_)
