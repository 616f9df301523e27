"""Problem 4: variant spellings of names typed by people.

Names are normalised (case, accents, punctuation, legal forms and titles; known short words written out) and their words
sorted into one key. One edit (a transposition counts as one) anywhere in the whole key is tolerated, found by a
pigeonhole segment join: every key is cut into three segments, of which an edit leaves two intact, and pairs of
position-shifted substrings of the other names, in every turn of their words, are looked up in the inverted index of
the segment pairs; the built-in banded edit distance verifies. Two segments together keep an index entry selective even
where a third of all names ends in the same word. Keys too short for an edit are looked up whole.

Names that say less are looked up the same way among the distinctive stems of fuller names: a name without a line of
business or given name, or with an initial only, is linked where just one entity fits. Linked names form groups by
distributed union-find.

The tables of legal forms, lines of business and short forms below are optional knowledge (`Words`): without them names
are still linked by their keys, but an abbreviated word is then a different word.

Defined cases: null and empty names, and names that consist of a legal form only, link to nothing; equal strings are
one name; ties go to the smaller key by code points; names of more than `MOST_TURNS` words are looked up in their own
and in sorted order only; an empty table gives an empty result; other columns are never read. No cap is set on
candidates or group sizes; the result lists all pairs of strings of a group.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import strip_accents
from ledgerloom.llm.group_split import merged
from ledgerloom.session import keep

#: Shortest key for which one edit is tolerated, in letters and in Hangul syllables (of two or three letters each).
FUZZY_LENGTH, FUZZY_SYLLABLES = 6, 4
#: Names of up to so many words are looked up in every turn of their words.
MOST_TURNS = 6

# Legal forms and titles, lines of business, given names with their short forms.
LEGAL = frozenset("co company ltd limited inc incorporated corp corporation plc group grp the llc llp lp sa ag gmbh ooo oao ао ооо оао пао dr mr mrs ms prof sir jr sr".split())
LEGAL_KO = ("주식회사", "유한회사", "(주)", "㈜", "(본사)", "(유)")
KINDS = (
    "robotics chemicals engineering pharmaceuticals shipbuilding machinery holdings logistics telecom construction securities electronics energy "
    "insurance entertainment semiconductor materials biologics industries trading foods motors bank steel групп пром трейд холдинг"
).split()
KINDS_KO = "엔터테인먼트 엔지니어링 바이오로직 조선해양 로보틱스 손해보험 생명보험 중공업 반도체 에너지 홀딩스 통신 건설 전자 소재 제약 물류 화학 증권 보험 은행 식품".split()
GROUP_KO = "그룹"
NICKNAMES = {
    "alexander": "alex sandy sasha lex xander", "charlotte": "lottie charlie lotte", "victoria": "vicky vicki tori vic", "elizabeth": "liz lizzie beth betty eliza", "frederick": "fred freddie freddy",
    "gabriella": "gabi gabby ella", "oliver": "ollie olly", "vincent": "vince vinny vin", "samuel": "sam sammy", "zachary": "zach zack zac", "henry": "harry hank hal", "theodore": "ted teddy theo",
    "leonard": "len lenny leo", "isabelle": "izzy bella belle isa", "michael": "mike mick mickey", "nicholas": "nick nicky", "jonathan": "jon jonny nathan", "margaret": "peggy maggie meg greta",
    "patricia": "pat patty trish tricia", "dorothy": "dot dottie dolly", "robert": "bob rob bobby robbie bert", "william": "bill will billy liam", "ursula": "ulla ursa", "katherine": "kate kathy katie kit kitty",
    "james": "jim jimmy jamie", "john": "jack johnny", "richard": "dick rick richie", "thomas": "tom tommy", "edward": "ed eddie ned", "joseph": "joe joey", "daniel": "dan danny", "anthony": "tony",
    "andrew": "andy drew", "benjamin": "ben benny", "christopher": "chris kit", "matthew": "matt", "susan": "sue susie", "jennifer": "jen jenny", "rebecca": "becky becca", "deborah": "deb debbie", "catherine": "cathy cath",
}
GIVEN = {n: full for full, short in NICKNAMES.items() for n in (full, *short.split())}

_CAMEL = re.compile(r"(?<=[a-zа-яё])(?=[A-ZА-ЯЁ])")
_WORD = re.compile(r"[^\W\d_]+|\d+")
_INITIALS = re.compile(r"^[a-z]$")


@dataclass(frozen=True)
class Words:
    """Words with a meaning of their own: legal forms and titles (left out), lines of business, given names with their full forms."""

    legal: frozenset[str] = LEGAL
    legal_hangul: tuple[str, ...] = LEGAL_KO
    kinds: tuple[str, ...] = tuple(KINDS)
    kinds_hangul: tuple[str, ...] = tuple(KINDS_KO)
    group_hangul: str = GROUP_KO
    given: Mapping[str, str] = field(default_factory=lambda: GIVEN)


NO_WORDS = Words(frozenset(), (), (), (), "", {})


def kind_of(word: str, kinds: tuple[str, ...]) -> str | None:
    """The line of business a word states or abbreviates."""
    if word in kinds:
        return word
    if len(word) >= 3:
        rules = (
            lambda k: k.startswith(word),
            lambda k: _bones(k).startswith(word),
            # A beginning with the last consonants of its word: logis, shipbldg, hldgs, engg.
            lambda k: word[0] == k[0] and len(word) <= 8 and _bones(word) == word and _within(word, _bones(k)),
            lambda k: word[:3] == k[:3] and len(word) < len(k) - 1 and len(word) <= 8 and _within(word, k),
        )
        for rule in rules:
            fit = [k for k in kinds if rule(k)]
            if fit:
                return min(fit, key=lambda k: (len(k), k))
    return None


def _bones(word: str) -> str:
    return word[0] + re.sub("[aeiou]", "", word[1:])


def _within(short: str, word: str) -> bool:
    at = 0
    for ch in short:
        at = word.find(ch, at) + 1
        if not at:
            return False
    return True


def _turns(words: list[str]) -> list[str]:
    """The key of words in sorted order, then the other orders that a name is looked up in: every turn of the words as written."""
    joined = ["".join(sorted(words))]
    for i in range(len(words) if len(words) <= MOST_TURNS else 1):
        joined.append("".join(words[i:] + words[:i]))
    return list(dict.fromkeys(joined))


def parts_of(folded: str, known: Words = Words()) -> tuple[list[str], str, str] | None:  # noqa: B008
    """(turns, stem, qualifier) of a name without accents; the first turn is its key. Qualifiers: k:business, g:given name, i:initial or ''."""
    if re.search("[가-힣]", folded):
        s = folded
        for x in known.legal_hangul:
            s = s.replace(x, " ")
        s = "".join(re.findall(r"[가-힣a-zA-Z0-9]+", s)).lower()
        for x in known.legal_hangul:
            if len(x) > 3:  # a legal form with a space inside
                s = s.removeprefix(x).removesuffix(x)
        for k in known.kinds_hangul:
            if s.endswith(k) and len(s) > len(k):
                return [s], s[: -len(k)], "k:" + k
        if known.group_hangul and s.endswith(known.group_hangul) and len(s) > len(known.group_hangul):
            s = s[: -len(known.group_hangul)]
        return ([s], s, "") if s else None
    comma = re.fullmatch(r"\s*([^,]+),\s*([^,]+)\s*", folded)
    words = [w.lower() for w in _WORD.findall(_CAMEL.sub(" ", folded))]
    words = [w for w in words if w not in known.legal]
    if not words:
        return None
    kinds = [(i, k) for i, w in enumerate(words) for k in [kind_of(w, known.kinds)] if k]
    if kinds and len(words) > 1:
        exact = [x for x in kinds if words[x[0]] in known.kinds] or [x for x in kinds if x[0] in (0, len(words) - 1)]
        if exact:
            # The business is the last word, or the first in reversed names.
            i, k = exact[-1] if exact[-1][0] == len(words) - 1 else exact[0]
            stem = "".join(words[:i] + words[i + 1 :])
            if len(stem) > 2:
                return _turns([*words[:i], k, *words[i + 1 :]]), stem, "k:" + k
    letters = [w for w in words if _INITIALS.match(w)]
    full = [w for w in words if len(w) > 1]
    if len(full) >= 2:
        given = [i for i, w in enumerate(full) if w in known.given]
        if given:
            # In "Surname, Given" the given name follows.
            i = given[-1] if comma else given[0]
            name = known.given[full[i]]
            return _turns([*full[:i], name, *full[i + 1 :]]), "".join(full[:i] + full[i + 1 :]), "g:" + name
        return _turns(full), "".join(full), ""
    if len(full) == 1:
        return full, full[0], ("i:" + letters[0] if letters else "")
    return ["".join(words)], "".join(words), ""


def _parse(known: Words):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(n, p[0][0], p[0], p[1], p[2]) for n, f in zip(pdf["name"], pdf["folded"], strict=True) for p in [parts_of(f, known)] if p and p[1]]
            if out:
                yield pd.DataFrame(out, columns=["name", "key", "turns", "stem", "qual"])

    return run


def _cut(text: Column, length: Column, part: int, shift: Column) -> Column:
    """One third of a text of the given length, moved by shift."""
    at = lambda i: F.floor(length * i / 3).cast("int")
    return F.substring(text, at(part) + 1 + shift, at(part + 1) - at(part))


def near_pairs(index: DataFrame, probes: DataFrame) -> DataFrame:
    """role, a, b, exact: entries of the index (role, a, s) and probes (role, b, t) of one role whose strings are within one edit or transposition."""
    least = lambda c: F.when(c.rlike("^[가-힣]"), FUZZY_SYLLABLES).otherwise(FUZZY_LENGTH)
    whole = lambda c: F.struct(F.length(c).alias("len"), F.lit(-1).alias("part"), c.alias("seg"))
    zero, combos = F.lit(0), ((1, 2), (0, 2), (0, 1))

    def pairs_of(c: Column, length: Column, moved: Column) -> list[Column]:
        # Combination i leaves out segment i, where the edit is: segments after it are moved.
        return [F.struct(length.alias("len"), F.lit(i).alias("part"), F.concat(_cut(c, length, p, moved if p > i else zero), F.lit("|"), _cut(c, length, q, moved if q > i else zero)).alias("seg")) for i, (p, q) in enumerate(combos)]

    s, t = F.col("s"), F.col("t")
    n = F.length(s)
    entries = index.select("role", "a", "s", F.explode(F.when(n >= least(s), F.array(*pairs_of(s, n, zero), whole(s))).otherwise(F.array(whole(s)))).alias("p"))
    n = F.length(t)
    looked = [x for d in (-1, 0, 1) for x in pairs_of(t, n + d, F.lit(-d))]
    # A transposition across a cut damages two segments: look the text up with the letters at the cut swapped back.
    for i in (1, 2):
        cut = F.floor(n * i / 3).cast("int")
        back = F.concat(F.substring(t, F.lit(1), cut - 1), F.substring(t, cut + 1, F.lit(1)), F.substring(t, cut, F.lit(1)), F.substring(t, cut + 2, n))
        looked += pairs_of(back, n, zero)
    found = probes.select("role", "b", "t", F.explode(F.when(n >= least(t) - 1, F.array_distinct(F.array(*looked, whole(t)))).otherwise(F.array(whole(t)))).alias("p"))
    flat = lambda df, *c: df.select("role", *c, "p.len", "p.part", "p.seg").hint("merge")
    met = flat(entries, "a", "s").join(flat(found, "b", "t"), ["role", "len", "part", "seg"]).where("a <> b").select("role", "a", "b", "s", "t").distinct()
    distance = F.levenshtein("s", "t", 2)
    crossed = F.exists(F.sequence(F.lit(1), F.length("s") - 1), lambda i: F.concat(F.substring("s", F.lit(1), i - 1), F.substring("s", i + 1, F.lit(1)), F.substring("s", i, F.lit(1)), F.substring("s", i + 2, F.length("s"))) == F.col("t"))
    close = met.where((distance == 0) | (distance == 1) | ((distance == 2) & (F.length("s") == F.length("t")) & crossed))
    return close.groupBy("role", "a", "b").agg(F.bool_or(F.col("s") == F.col("t")).alias("exact"))


def linked(names: DataFrame, known: Words = Words()) -> DataFrame:  # noqa: B008
    """name, group: group numbers of the names (column name) of one entity; names of one group are variants of each other."""
    raw = names.where("name IS NOT NULL").select("name").distinct()
    folded = raw.select("name", strip_accents(F.col("name")).alias("folded"))
    parsed = keep(folded.mapInPandas(_parse(known), "name string, key string, turns array<string>, stem string, qual string"), "names")
    keys = keep(parsed.select("key", "stem", "qual").distinct().withColumn("id", F.monotonically_increasing_id()), "keys")
    turns = parsed.select("key", "stem", "qual", F.explode("turns").alias("t")).distinct().hint("merge").join(keys, ["key", "stem", "qual"])
    full, bare = "qual LIKE 'k:%' OR qual LIKE 'g:%'", "qual = '' OR qual LIKE 'i:%'"
    index = keys.select(F.lit("key").alias("role"), F.col("id").alias("a"), F.col("key").alias("s")).union(keys.where(full).select(F.lit("stem"), "id", "stem"))
    probes = turns.select(F.lit("key").alias("role"), F.col("id").alias("b"), "t").union(keys.where(bare).select(F.lit("stem"), "id", "stem"))
    a, b = keys.select(F.col("id").alias("a"), F.col("qual").alias("qa")), keys.select(F.col("id").alias("b"), F.col("qual").alias("qb"))
    near = keep(near_pairs(index, probes).hint("merge").join(a.hint("merge"), "a").join(b.hint("merge"), "b"), "near")
    # Whole keys: one business or given name, or one of them misspelt and so unknown; initials must agree.
    known_a, known_b = F.col("qa").rlike("^[kg]:"), F.col("qb").rlike("^[kg]:")
    same = near.where((F.col("role") == "key") & ((F.col("qa") == F.col("qb")) | (known_a & (F.col("qb") == "")) | (known_b & (F.col("qa") == ""))))
    # Names that say less and are no misspelt fuller name: those of the same stem, else of a near one, if only one entity fits.
    done = same.where(known_a & ~known_b).select("b").union(same.where(known_b & ~known_a).select("a")).distinct()
    fits = near.where("role = 'stem' AND (qb = '' OR (qa LIKE 'g:%' AND substring(qa, 3, 1) = substring(qb, 3, 1)))").hint("merge").join(done.hint("merge"), "b", "left_anti")
    own = lambda c: F.when(F.col("exact"), F.col(c))
    of = fits.groupBy("b").agg(F.min(own("a")).alias("own"), F.min("a").alias("any"), F.count_distinct(own("qa")).alias("n_own"), F.count_distinct("qa").alias("n_any"))
    few = of.where("n_own = 1 OR (n_own = 0 AND n_any = 1)").select(F.col("b").alias("a"), F.coalesce("own", "any").alias("b"))
    edges = same.select("a", "b").union(few).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    up = merged(edges)
    group = keys.hint("merge").join(up.withColumnRenamed("a", "id").hint("merge"), "id", "left").select("key", "stem", "qual", F.coalesce("b", "id").alias("group"))
    return parsed.select("name", "key", "stem", "qual").hint("merge").join(group.hint("merge"), ["key", "stem", "qual"]).select("name", "group")


def variant_pairs(names: DataFrame) -> DataFrame:
    """name_a, name_b (name_a < name_b by code points): different strings that name the same entity."""
    g = keep(linked(names), "linked")
    a, b = g.withColumnRenamed("name", "name_a"), g.withColumnRenamed("name", "name_b")
    return a.hint("merge").join(b.hint("merge"), "group").where("name_a < name_b").select("name_a", "name_b")


def variants(names: DataFrame) -> DataFrame:
    """name, entity, n_variants: every name with its group's most complete spelling (longest, then smallest)."""
    g = keep(linked(names), "linked")
    best = g.groupBy("group").agg(F.min_by("name", F.struct(-F.length("name"), "name")).alias("entity"), F.count("*").alias("n_variants"))
    return g.hint("merge").join(best.hint("merge"), "group").select("name", "entity", "n_variants")
