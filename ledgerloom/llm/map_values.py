"""Problem 5: mapping free-entered values to a canonical list.

Distinct values are normalised and looked up in an inverted index of the reference names' features: character n-grams
of every word, of its consonant skeleton (for dropped vowels) and its prefixes (for abbreviations), weighted by inverse
frequency over the whole reference. The best entry within the value's scope is accepted if its weighted cosine and its
margin over the next code are large enough; everything else is reported as unmatched. A value whose every word
abbreviates or misspells a word of the best entry of its own is accepted from a lower cosine on.

The index is a table. Up to `POSTINGS_IN_MEMORY` postings (counted before they are sent) tasks score with a copy of it;
a larger index meets the values' features in a join. Both ways give the same scores, up to the last digits.

Defined cases: a null or empty value is unmatched; values that normalise to nothing are unmatched; equal scores leave no
margin, hence no match; repeated rows get the same entry; an empty table gives an empty result and an empty reference
leaves all unmatched; other columns are never read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import plain
from ledgerloom.session import keep

THRESHOLD, MARGIN = 0.6, 0.03
#: For values whose words are all explained by the entry.
EXPLAINED, EXPLAINED_MARGIN = 0.2, 0.015
#: Postings that are sent to the executors (about 200 MB there); more of them meet the values by a join.
POSTINGS_IN_MEMORY = 1_000_000
NONE = "NONE"

# Words that carry no meaning in an item name.
NOISE = frozenset("the our of for to and per in a an item agreed".split())
PREFIXES, SUFFIXES = ("당사", "정정"), ("합계", "내역", "소계")
_LEAD = re.compile(r"^(?:\s|[※*•·\-]|\(?\d{1,2}[.)]|[가-하]\.|\(정정\))+")
_BRACKET = re.compile(r"[(\[][^()\[\]]*[)\]]")
_WORD = re.compile(r"[a-zß-ɏ]+(?:['/][a-z]+)*|[가-힣]+")
#: A closing TOTAL, but not that of "Liabilities, total".
_TOTAL = re.compile(r"(?<![-,\s])(?<!\bof)\s+(?:sub)?total[\s:*]*$")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def words_of(value: str) -> list[str]:
    """Meaningful words of a value: Latin words in order, then all Hangul as one word."""
    s = _LEAD.sub("", _CAMEL.sub(" ", value)).lower()
    s = _TOTAL.sub("", _BRACKET.sub(" ", s))
    found = _WORD.findall(s)
    latin = [re.sub("['/]", "", w) for w in found if not "가" <= w[0] <= "힣"]
    latin = [w for w in latin if w not in NOISE]
    hangul = "".join(w for w in found if "가" <= w[0] <= "힣")
    for p in PREFIXES:
        hangul = hangul[len(p) :] if hangul.startswith(p) and len(hangul) > len(p) + 1 else hangul
    for p in SUFFIXES:
        hangul = hangul[: -len(p)] if hangul.endswith(p) and len(hangul) > len(p) + 1 else hangul
    return latin + ([hangul] if hangul else [])


def _parts(syllable: str) -> list[str]:
    c = ord(syllable) - 0xAC00
    return [f"i{c // 588}", f"v{c % 588 // 28}", *([f"f{c % 28}"] if c % 28 else [])]


def edits(a: list[str] | str, b: list[str] | str, most: int) -> int:
    """Edit distance with transpositions, or most + 1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, before, row = before, row, [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], last[j - 2] + 1)
        if min(row) > most:
            return most + 1
    return row[-1]


def abbreviates(short: str, word: str) -> bool:
    """Whether short has the word's first letter and its letters in the word's order."""
    at = 1
    if not short or short[0] != word[0]:
        return False
    for ch in short[1:]:
        at = word.find(ch, at) + 1
        if not at:
            return False
    return True


def explains(value: list[str], entry: list[str]) -> bool:
    """Whether the words of a value and of an entry pair off as abbreviations or misspellings."""
    if len(value) != len(entry) or not value:
        return False

    def fits(v: str, e: str) -> bool:
        if "가" <= v[0] <= "힣" or "가" <= e[0] <= "힣":
            return edits([p for ch in v for p in _parts(ch)] if "가" <= v[0] <= "힣" else v, [p for ch in e for p in _parts(ch)] if "가" <= e[0] <= "힣" else e, 3 if len(e) > 3 else 2) <= (3 if len(e) > 3 else 2)
        most = 2 if len(e) > 7 else 1
        return abbreviates(v, e) or (len(v) > 3 and edits(v, e, most) <= most)

    # Words are paired off by augmenting paths, in a time that is a power of their number.
    of: dict[int, int] = {}
    near = [[i for i, e in enumerate(entry) if fits(v, e)] for v in value]

    def paired(k: int, seen: set[int]) -> bool:
        for i in near[k]:
            if i not in seen:
                seen.add(i)
                if i not in of or paired(of[i], seen):
                    of[i] = k
                    return True
        return False

    return all(paired(k, set()) for k in range(len(value)))


def features(value: str) -> Counter:
    """Weighted features of a value."""
    f: Counter = Counter()
    for w in words_of(value):
        p = f"^{w}$"
        if "가" <= w[0] <= "힣":
            for n in (1, 2):
                for i in range(len(w) - n + 1):
                    f["h" + w[i : i + n]] += 1.0
            jamo = [x for ch in w for x in _parts(ch)[:2]]
            for i in range(len(jamo) - 2):
                f["j" + ".".join(jamo[i : i + 3])] += 0.5
            continue
        for n in (2, 3):
            for i in range(len(p) - n + 1):
                f[p[i : i + n]] += 1.0
        bones = "^" + w[0] + re.sub("[aeiou]", "", w[1:])
        for i in range(len(bones) - 1):
            f["s" + bones[i : i + 2]] += 1.0
        for i in range(len(bones) - 2):
            f["t" + bones[i : i + 3]] += 1.0
        for n in (1, 3, 4):
            f["p" + w[:n]] += 1.0
    return f


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Features of texts: id, feature, weight (the root of its count)."""
    for pdf in batches:
        out = [(i, g, math.sqrt(x)) for i, t in zip(pdf["id"], pdf["text"], strict=True) for g, x in features(t).items()]
        yield pd.DataFrame(out, columns=["id", "feature", "weight"])


@dataclass
class Index:
    """The reference as tables: entries (entry, code, name, scopes) and postings (feature, idf, entry, y)."""

    entries: DataFrame
    postings: DataFrame
    #: Weight of a feature that no entry has.
    rare: float


def index_of(reference: DataFrame) -> Index:
    """The inverted index of reference names (code, name, scopes); frequencies are those of the whole reference."""
    rows = reference.where("code IS NOT NULL AND name IS NOT NULL").select("code", "name", "scopes").distinct()
    # A number that doesn't depend on the order of the rows, so nothing has to be written to keep it.
    entries = rows.withColumn("entry", F.xxhash64("code", "name", F.col("scopes").cast("string")))
    n = entries.count()
    found = entries.select(F.col("entry").alias("id"), F.col("name").alias("text")).mapInPandas(_features, "id long, feature string, weight double")
    weighted = found.join(found.groupBy("feature").agg(F.log(1 + F.lit(float(n)) / F.count("*")).alias("idf")), "feature")
    # An entry's features are bounded by its name.
    norm = F.sqrt(F.sum(F.pow(F.col("weight") * F.col("idf"), F.lit(2.0))).over(Window.partitionBy("id")))
    postings = keep(weighted.select("feature", "idf", F.col("id").alias("entry"), (F.col("weight") * F.col("idf") / norm).alias("y")), "postings")
    return Index(entries, postings, math.log(1 + n))


def _score(shared, rare: float):
    """The two best codes of every value, from a copy of the index."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        idf, postings, rows = shared.value
        for pdf in batches:
            out = []
            for v, text, scope in zip(pdf["id"], pdf["text"], pdf["ll_scope"], strict=True):
                weights = {g: math.sqrt(x) * idf.get(g, rare) for g, x in features(text).items()}
                norm = math.sqrt(sum(x * x for x in weights.values()))
                score: dict[int, float] = {}
                for g, x in weights.items():
                    for i, y in postings.get(g, ()):
                        score[i] = score.get(i, 0.0) + x * y
                codes: dict[str, tuple[float, int]] = {}
                for i, x in score.items():
                    code, scopes = rows[i]
                    if scope is None or scopes is None or scope in scopes:
                        codes[code] = max(codes.get(code, (0.0, 0)), (x / norm, i))
                out += [(v, c, x, i) for c, (x, i) in sorted(codes.items(), key=lambda p: (-p[1][0], p[0]))[:2]]
            yield pd.DataFrame(out, columns=["id", "code", "score", "entry"])

    return run


def _scored(values: DataFrame, index: Index, in_memory: int) -> DataFrame:
    """id, code, score, entry of at least the two best codes of every value (id, text, ll_scope)."""
    schema = "id long, code string, score double, entry long"
    few = index.postings.limit(in_memory + 1).collect()
    if len(few) <= in_memory:
        postings: dict[str, list[tuple[int, float]]] = {}
        for g, _, i, y in few:
            postings.setdefault(g, []).append((i, y))
        rows = {r["entry"]: (r["code"], r["scopes"]) for r in index.entries.select("entry", "code", "scopes").collect()}
        shared = values.sparkSession.sparkContext.broadcast(({g: x for g, x, _, _ in few}, postings, rows))
        return values.mapInPandas(_score(shared, index.rare), schema)
    found = keep(values.mapInPandas(_features, "id long, feature string, weight double"), "value_features")
    weighted = found.join(index.postings.select("feature", "idf").distinct(), "feature", "left").select("id", "feature", (F.col("weight") * F.coalesce("idf", F.lit(index.rare))).alias("x"))
    norm = weighted.groupBy("id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    sums = weighted.join(index.postings, "feature").groupBy("id", "entry").agg(F.sum(F.col("x") * F.col("y")).alias("s"))
    j = sums.join(norm, "id").join(values.select("id", "ll_scope"), "id").join(index.entries.select("entry", "code", "scopes"), "entry")
    j = j.where("ll_scope IS NULL OR scopes IS NULL OR array_contains(scopes, ll_scope)")
    codes = j.groupBy("id", "code").agg(F.max(F.struct((F.col("s") / F.col("norm")).alias("score"), "entry")).alias("m")).select("id", "code", "m.score", "m.entry")
    best = Window.partitionBy("id").orderBy(F.desc("score"), "code")
    return codes.withColumn("rank", F.row_number().over(best)).where("rank <= 2").select("id", "code", "score", "entry")


def _explained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf[[explains(words_of(t), words_of(n)) for t, n in zip(pdf["text"], pdf["name"], strict=True)]][["id", "code", "score", "margin"]]


def matched_values(values: DataFrame, reference: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN, in_memory: int = POSTINGS_IN_MEMORY) -> DataFrame:
    """ll_raw, ll_scope, code, score, margin, by_words: accepted matches of distinct values (columns ll_raw, ll_scope)."""
    index = index_of(reference)
    # Scoring costs more than its bytes tell, so the adaptive planner must not merge these partitions.
    tasks = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = keep(values.repartition(tasks).select(F.monotonically_increasing_id().alias("id"), "ll_raw", "ll_scope", plain(F.col("ll_raw")).alias("text")), "values")
    # At most two codes of every value meet here.
    two = _scored(named, index, in_memory).groupBy("id").agg(F.sort_array(F.collect_list(F.struct(F.round(-F.col("score"), 9).alias("s"), "code", "entry"))).alias("b"))
    second = F.coalesce(-F.get("b", F.lit(1))["s"], F.lit(0.0))
    best = keep(two.select("id", F.col("b")[0]["code"].alias("code"), (-F.col("b")[0]["s"]).alias("score"), (-F.col("b")[0]["s"] - second).alias("margin"), F.col("b")[0]["entry"].alias("entry")), "best")
    sure = (F.col("score") >= threshold) & (F.col("margin") >= margin)
    open_ = best.where(~sure & (F.col("score") >= EXPLAINED) & (F.col("margin") >= EXPLAINED_MARGIN))
    asked = open_.join(named.select("id", "text"), "id").join(index.entries.select("entry", "name"), "entry").select("id", "code", "score", "margin", "text", "name")
    by_words = asked.mapInPandas(_explained, "id long, code string, score double, margin double").withColumn("by_words", F.lit(True))
    both = best.where(sure).select("id", "code", "score", "margin", F.lit(False).alias("by_words")).unionByName(by_words)
    return named.select("id", "ll_raw", "ll_scope").join(both, "id").drop("id")


def mapped(df: DataFrame, key: str, value: Column, scope: Column, reference: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN) -> DataFrame:
    """key, code, score for every row: the canonical entry its value stands for, or NONE.

    reference: columns code, name, scopes (array or null).
    """
    rows = df.select(F.col(key), value.cast("string").alias("ll_raw"), scope.cast("string").alias("ll_scope"))
    values = rows.where("ll_raw IS NOT NULL").select("ll_raw", "ll_scope").distinct()
    found = matched_values(values, reference, threshold, margin)
    same = (rows["ll_raw"] == found["ll_raw"]) & rows["ll_scope"].eqNullSafe(found["ll_scope"])
    return rows.join(found, same, "left").select(F.col(key), F.coalesce("code", F.lit(NONE)).alias("code"), F.coalesce("score", F.lit(0.0)).alias("score"))
