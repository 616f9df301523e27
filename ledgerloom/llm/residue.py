"""Problem 10: template residue and error-page text.

The texts are read once, in Arrow batches; what is kept of a document are flags and the hashes of its lines' shapes. Three
kinds of evidence are combined; the first two know no words.

* Host evidence: every document is cut into lines, a line's shape is its text without case, figures and spacing. A
  document is a low-information response if it holds few different terms and none of them occurs in its address slug
  (report_id) or title (company). A shape that such responses of several titles share, and that hardly ever occurs
  elsewhere, is residue wherever it stands, so also as a line of a real text.
* Repetition: a line of many words that are mostly the same few ones is filler.
* Detectors: an Aho-Corasick pass over the whole text finds anchors of placeholders, filler, error pages and viewer
  notices, a pattern on the anchor's line decides, so sentences that merely report on such things don't count.

Defined cases: null and empty texts aren't residue; repeated documents are each flagged; a null slug or title shares no
terms, and all null titles are one; very long texts are searched whole; an empty table gives an empty result; other
columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import keep, spread

#: A low-information response holds at most so many different terms.
TERMS = 40
#: A shape is residue if so many responses of so many titles consist of it, and so large a part of its documents are responses.
COPIES, TITLES, ALONE = 3, 3, 0.7
#: A line of at least so many words is filler if so small a part of them are different ones.
RUN, DIFFERENT = 8, 0.3
#: Longest title line.
TITLE = 80
#: Shapes that are sent to the documents; more of them meet the documents' lines by a shuffle.
BROADCAST_SHAPES = 200_000

# What the detectors look for. An anchor is a lower-case literal; its pattern must hold on the anchor's line.
DETECTORS: dict[str, list[tuple[str, str]]] = {
    "placeholder": [
        ("goes here", r"\byour (?:text|content|title) goes here\b"),
        ("내용을 입력하세요", r"내용을 입력하세요"),
        ("[company", r"\[company(?: name)?\]"), ("[date]", r"\[date\]"), ("[amount]", r"\[amount\]"), ("[action]", r"\[action\]"),
        ("[회사명]", r"\[회사명\]"), ("[일자]", r"\[일자\]"), ("[금액]", r"\[금액\]"), ("[계약명]", r"\[계약명\]"),
        ("<insert", r"<insert [^<>]*>"), ("[insert", r"\[insert [^\]]*\]"), ("dd/mm/yyyy", r"<dd/mm/yyyy>"),
        ("[[", r"\[\[[^\[\]]+\]\]"), ("{{", r"\{\{[^{}]*\}\}"), ("${", r"\$\{\w[^{}]*\}"), ("<%", r"<%=?[^%]*%>"), ("{%", r"\{%[^{}]*%\}"), ("#{", r"#\{\w[^{}]*\}"), ("@@", r"@@\w+@@"), ("##", r"##\w+##"), ("%%", r"%%\w+%%"), ("__", r"(?:^|\W)__[a-z]\w*?__(?:\W|$)"), ("%(", r"%\(\w+\)s"),
        ("<<", r"<<\s*[^<>]*(?:입력|확인 필요|insert|fill)[^<>]*>>|<<\s*\w+\s*>>"),
        ("to supply wording", r"\btbd\b.*to supply wording"), ("todo:", r"\btodo:"), ("fixme", r"\bfixme\b"), ("tbd -", r"^\W*tbd - "),
        ("xxx ", r"\bxxx\b.*\bxxx\b"),
        ("○○", r"○○○"), ("0,000,000", r"\b0,000,000"), ("20xx", r"20xx년|20xx-xx"), ("xx월", r"xx월"),
        ("(예시)", r"^\W*\(예시\)\W*$"), ("(sample form)", r"\(sample form\)"), ("작성 예시", r"작성 예시이므로"), ("작성 예정", r"\[\[?작성 예정\]?\]"),
        ("....", r"^\s*[\w ]{2,20}:\s*\.{4}|\.{4,}\s*to\s*\.{4,}"), ("___", r"[:：]\s*_{3,}|^[\s_]*_{5,}[\s_]*$"),
        ("(seal)", r"seal:\s*\(seal\)"), ("(인)", r"_{2,}\s*\(인\)"), (": ( ", r"[:：]\s*\(\s+\)"), ("명 기재)", r"\(회사명 기재\)"), ("간 기재)", r"\(기간 기재\)"),
        ("undefined", r"\b(?:null|undefined|nan|none)\b[\s,]+(?:null|undefined|nan|none|\[object object\])\b.*"),
        ("null", r"\bnull[\s,]+(?:null|undefined|nan|none)\b"), ("none nan", r"\bnone nan\b"), ("none none", r"\bnone none\b.*\b(?:nan|none)\b"), ("[object object]", r"\[object object\]"),
    ],
    "filler": [
        ("consectetur adipiscing", r"consectetur adipiscing"), ("lorem ipsum", r"lorem ipsum (?:dolor|lorem)"), ("tempor incididunt", r"tempor incididunt"),
        ("asdf asdf", r"\basdf asdf\b"), ("asdf qwer", r"\basdf qwer\b"), ("sample text sample text", r"sample text sample text"),
        ("blah blah", r"\bblah blah\b"), ("xxxx xxxx", r"\bxxxx xxxx xxxx\b"), ("테스트 테스트", r"테스트 테스트 테스트"), ("test test test", r"\btest test test test\b"),
        ("가나다라 가나다라", r"가나다라 가나다라"),
    ],
    "error": [
        ("traceback (most recent", r"traceback \(most recent call last\)"), ("keyerror:", r"\bkeyerror: '"), ("nullpointerexception", r"\bjava\.lang\.\w+exception"),
        ("페이지를 찾을 수 없", r"(?:요청하신|해당) 페이지를 찾을 수 없습니다"), ("오류번호", r"\(오류번호\s*\d+\)"), ("시스템 점검 중입니다", r"시스템 점검 중입니다"), ("이용에 불편을 드려", r"이용에 불편을 드려 죄송합니다"),
        ("오류가 발생하였습니다", r"일시적인 오류가 발생하였습니다"), ("오류가 발생했습니다", r"불러오는 중 오류가 발생했습니다|(?:일시적인|알 수 없는) 오류가 발생했습니다"), ("세션이 만료", r"세션이 만료되었습니다"), ("다시 로그인", r"다시 로그인해 주세요"),
        ("불러올 수 없습니다", r"(?:해당|요청하신) (?:문서|페이지|자료)를 불러올 수 없습니다"), ("관리자에게 문의", r"관리자에게 문의하십시오"), ("주소를 다시 확인", r"주소를 다시 확인하여 주십시오"), ("잠시 후 다시 시도", r"잠시 후 다시 시도해 주세요"),
        ("too many requests", r"^\W*(?:\d{3}\W*)?too many requests\b|too many requests\. slow down"), ("slow down and retry", r"slow down and retry"),
        ("could not be retrieved", r"the requested (?:filing|page|document) could not be retrieved"), ("session has expired", r"\byour session has expired"),
        ("contact the administrator", r"please contact the administrator"), ("scheduled maintenance", r"site under scheduled maintenance"), ("back shortly", r"we will be back shortly"),
        ("connection timed out", r"connection timed out while reading"), ("while loading viewer", r"error \d{3}: .* while loading viewer"), ("http status", r"http status \d{3}\s*-\s*\w"),
        ("server at viewer", r"server at viewer"), ("<h1>", r"<h1>(?:\d{3} )?[a-z -]+</h1>.*server"),
        ("access denied", r"^\W*(?:[^.]{0,80}\|\s*)?access denied\."),
        *[(w, r"^\W*\d{3} " + w + r"\W*$|^\W*" + w + r"\W*\d{3}\W*$|^[^|]{3,80}\|\s*(?:error )?\d{3}\W+" + w + r"\b") for w in ("not found", "forbidden", "bad gateway", "internal server error", "service unavailable", "gateway time-out", "gateway timeout")],
        ("moved or no longer exists", r"this (?:document|page) has moved or no longer exists"),
        ("home | search | help", r"^\W*home \| search \| help\W*$|home \| search \| help"),
    ],
    "notice": [
        ("viewer requires scripts", r"this (?:viewer|page|site) requires scripts"), ("turn on javascript", r"turn on javascript in your browser"), ("enable javascript", r"please enable javascript"),
        ("inline frames", r"your browser does not support inline frames"), ("자바스크립트를 켜", r"자바스크립트를 켜 주"), ("자바스크립트를 사용할 수 없는", r"자바스크립트를 사용할 수 없는 브라우저입니다"),
        ("cookies and javascript", r"you need to allow cookies and javascript"), ("checking your browser", r"checking your browser before"), ("loading viewer", r"loading viewer, please wait"),
        ("redirecting you to", r"redirecting you to the (?:filing|page|document)"), ("불러오는 중입니다", r"문서를 불러오는 중입니다"), ("preview not available", r"preview not available for this"),
        ("new window", r"this document opens in a new window"), ("프레임을 지원하지", r"프레임을 지원하지 않는 브라우저"),
    ],
}
# Names between single signs: %corp_name%, @sign_off@.
_NAMES = re.compile(r"(?<![\w%])%[a-z][a-z_]{2,}%(?!\w)|(?<!\w)@[a-z][a-z_]{2,}@(?!\w)")
_SPACE = re.compile(r"[^\S\n]+")
_LINE, _TERM, _SENTENCE = re.compile(r"\n| \| "), re.compile(r"[^\W\d_]+"), re.compile(r"[.!?。]\s*$")
#: What differs between copies of one response: words with figures, spacing, brackets.
_VARIES = re.compile(r"(?:(?<!\w)[^\W\d]*+\d\w*|[\s._|()\[\]])+")


def _compiled():
    import ahocorasick

    auto = ahocorasick.Automaton()
    by_anchor: dict[str, list[tuple[str, re.Pattern]]] = {}
    for kind, pairs in DETECTORS.items():
        for anchor, pattern in pairs:
            by_anchor.setdefault(anchor, []).append((kind, re.compile(pattern)))
    for anchor, rules in by_anchor.items():
        auto.add_word(anchor, (len(anchor), rules))
    auto.make_automaton()
    return auto


def kinds_of(text: str, auto=None) -> list[str]:
    """Kinds of residue that a text is or contains, in the order of DETECTORS."""
    auto = auto or _compiled()
    t = _SPACE.sub(" ", text.lower())
    hit: set[str] = {"placeholder"} if _NAMES.search(t) else set()
    for end, (length, rules) in auto.iter(t):
        open_ = [r for r in rules if r[0] not in hit]
        if open_:
            a = t.rfind("\n", 0, end - length + 1) + 1
            b = t.find("\n", end)
            line = t[a : b if b >= 0 else len(t)].strip()
            hit.update(kind for kind, rule in open_ if rule.search(line))
    return [k for k in DETECTORS if k in hit]


def shape_of(line: str) -> str:
    """A line (in lower case) without words with figures, spacing and brackets."""
    return _VARIES.sub(" ", line).strip()


def repeats(line: str) -> bool:
    """Whether a line has many words that are mostly the same few ones."""
    words = _TERM.findall(line)
    return len(words) >= RUN and len(set(words)) <= DIFFERENT * len(words)


def read(text: str, title: str | None, slug: str | None) -> tuple[bool, bool, list[str]]:
    """Whether the text repeats itself, whether it is a low-information response that shares no term with slug and title, and the shapes of its body.

    The body leaves out a title line: a short first line that shares a term with slug or title and is no sentence.
    """
    lines = [x for x in _LINE.split(text.lower()) if x and not x.isspace()]
    own = set(_TERM.findall(f"{title or ''} {slug or ''}".lower()))
    if len(lines) > 1 and len(lines[0]) <= TITLE:
        first = set(_TERM.findall(lines[0]))
        if first & own and (first <= own or not _SENTENCE.search(lines[0])):
            del lines[0]
    terms: set[str] = set()
    for line in lines:
        if len(terms) > TERMS:
            break
        terms.update(_TERM.findall(line))
    shapes = {shape_of(x) for x in lines}
    shapes.discard("")
    return any(map(repeats, lines)), 0 < len(terms) <= TERMS and not terms & own, sorted(shapes)


def _look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import xxhash

    auto = _compiled()
    for pdf in batches:
        out = []
        for doc, text, title, slug in zip(pdf["doc_id"], pdf["text"], pdf["company"], pdf["report_id"], strict=True):
            same, low, shapes = read(text, title, slug)
            kinds = kinds_of(text, auto) + ["repetition"] * same
            out.append((doc, title or "", low, [xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in shapes], kinds))
        yield pd.DataFrame(out, columns=["doc_id", "title", "low", "shapes", "kinds"])


def looked_at(docs: DataFrame) -> DataFrame:
    """doc_id, title, low, shapes (hashes), kinds: what one pass over the texts tells about every document."""
    rows = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "company", "report_id")
    return keep(spread(rows).mapInPandas(_look, "doc_id long, title string, low boolean, shapes array<long>, kinds array<string>"), "looked")


def residue_shapes(seen: DataFrame) -> DataFrame:
    """doc_id, shape: the lines of the documents whose shape is residue by host evidence. seen: looked_at()."""
    # Responses are few, so only their shapes are gathered; then the lines of all documents are looked up among these.
    alone = seen.where("low").select("title", F.explode("shapes").alias("shape")).groupBy("shape").agg(F.count("*").alias("alone"), F.approx_count_distinct("title").alias("titles"))
    seeds = keep(alone.where(f"alone >= {COPIES} AND titles >= {TITLES}").select("shape", "alone"), "shapes")
    small = seeds.count() <= BROADCAST_SHAPES
    hits = keep(seen.select("doc_id", F.explode("shapes").alias("shape")).join(F.broadcast(seeds) if small else seeds.hint("merge"), "shape"), "lines")
    often = hits.groupBy("shape").agg(F.count("*").alias("docs"), F.max("alone").alias("alone")).where(F.col("alone") >= ALONE * F.col("docs")).select("shape")
    return hits.join(F.broadcast(often) if small else often.hint("merge"), "shape", "left_semi").select("doc_id", "shape")


def flagged(docs: DataFrame) -> DataFrame:
    """doc_id, kinds: documents that are or contain residue, with the kinds found ('host' and 'repetition' by evidence without words)."""
    seen = looked_at(docs)
    direct = seen.select("doc_id", F.explode("kinds").alias("kind"))
    both = direct.union(residue_shapes(seen).select("doc_id", F.lit("host")))
    return both.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds"))


def cleaned(docs: DataFrame) -> DataFrame:
    """docs without the flagged documents."""
    return docs.join(flagged(docs).select("doc_id"), "doc_id", "left_anti")
