"""From nodes to chunks: rendering, semantic blocks, recursive splitting, packing, parents and leaves."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Token budgets of a chunk: what to aim at and never to exceed.
TARGET, MAXIMUM = 600, 1000
#: Document groups chunked with parents; the others are one chunk if they fit.
WITH_PARENTS = ("periodic", "holding")
GROUPS = ("periodic", "holding", "major", "exchange")
SEPARATORS = ("\n\n", "\n", ". ", "다. ", " ")
#: A structured kind names a chunk from this share of its characters on.
STRUCTURED_SHARE = 0.2

_NUMBERED = re.compile(r"^\s*(?:[0-9]{1,2}[.)]|[가-하][.)]|[IVX]+\.|\(\d+\))")


def tokens(text: str) -> int:
    return max(1, int(len(text) / 2.0))


def tokens_column(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 2)).cast("int")


def split_long(text: str, budget: int = MAXIMUM) -> list[str]:
    """Pieces under the budget, cut at the coarsest separator that helps, at last anywhere; only separators between pieces are lost."""

    def cut(s: str, level: int) -> list[str]:
        if tokens(s) <= budget:
            return [s] if s.strip() else []
        if level == len(SEPARATORS):
            step = budget * 2
            return [s[i : i + step] for i in range(0, len(s), step)]
        sep = SEPARATORS[level]
        parts = s.split(sep)
        if len(parts) == 1:
            return cut(s, level + 1)
        keep = sep.rstrip() if sep.strip() else ""
        parts = [p + keep for p in parts[:-1]] + parts[-1:]
        out, now = [], ""
        for p in parts:
            joined = now + (sep if not keep else " ") + p if now else p
            if tokens(joined) <= budget:
                now = joined
                continue
            if now.strip():
                out.append(now)
            now = ""
            if tokens(p) <= budget:
                now = p
            else:
                more = cut(p, level + 1)
                out += more[:-1]
                now = more[-1] if more else ""
        if now.strip():
            out.append(now)
        return out

    return cut(text, 0)


def is_contents(grid: list[list[str]]) -> bool:
    """A table of contents: three rows or more, most with dots or dashes and a number at the end."""
    rows = [r for r in grid if any(r)]
    if len(rows) < 3:
        return False
    dashed = sum(any(re.search(r"[-.·…]{10,}", c) for c in r) for r in rows)
    numbered = sum(bool(re.fullmatch(r"\s*\d+\s*", [c for c in r if c][-1])) for r in rows)
    return dashed >= 0.6 * len(rows) and numbered >= 0.6 * len(rows)


def semantic_blocks(grid: list[list[str]], origins: list[list[int]], indents: list[int] | None = None) -> list[list[int]]:
    """Row numbers by block: a row without values at the least indent starts one, else numbering, indent or a new row-spanning label; else each row is a block."""
    n = len(grid)
    values = [sum(bool(c.strip()) for c in dict(zip(o, r, strict=True)).values()) for r, o in zip(grid, origins, strict=True)]
    indents = indents or [0] * n
    least = min(indents, default=0)
    heads = [values[i] == 1 and indents[i] == least for i in range(n)]
    numbered = [bool(_NUMBERED.match(r[0])) if r else False for r in grid]
    spans = [i == 0 or origins[i][0] != origins[i - 1][0] for i in range(n)]
    if any(heads) and not all(heads):
        starts = heads
    elif any(numbered) and not all(numbered):
        starts = numbered
    elif len(set(indents)) > 1:
        starts = [x == least for x in indents]
    elif not all(spans):
        starts = spans
    else:
        starts = [True] * n
    out: list[list[int]] = []
    for i in range(n):
        if starts[i] or not out:
            out.append([])
        out[-1].append(i)
    return out


def render_table(grid: list[list[str]], origins: list[list[int]], budget: int = MAXIMUM, unit: str | None = None, style: str = "grid") -> list[str]:
    """A table as one or more texts under the budget: header and unit are repeated, blocks stay whole, an oversized block is cut and its pieces numbered."""
    if not grid:
        return []
    line = lambda i: " | ".join(dict(zip(origins[i], grid[i], strict=True)).values())
    head = [line(0)] + ([f"({unit})"] if unit else [])
    body = semantic_blocks(grid[1:], origins[1:])
    if style == "kv":
        names = grid[0]
        row = lambda i: "; ".join(f"{names[j]}: {c}" for j, c in enumerate(grid[i]) if c and j < len(names))
    else:
        row = line
    texts, now = [], list(head)
    for block in body:
        lines = [row(i + 1) for i in block]
        if tokens("\n".join(now + lines)) <= budget:
            now += lines
            continue
        if len(now) > len(head):
            texts.append("\n".join(now))
        now = list(head)
        if tokens("\n".join(now + lines)) <= budget:
            now += lines
        else:
            room = max(1, budget - tokens("\n".join(head)) - 20)
            parts = split_long("\n".join(lines), room)
            texts += ["\n".join([*head, f"[{lines[0][:30]} [{k}/{len(parts)}]]", p]) for k, p in enumerate(parts, 1)]
    if len(now) > len(head) or not texts:
        texts.append("\n".join(now))
    return texts


def render_pairs(label: str | None, pairs: list[dict], unit: str | None = None) -> str:
    """One line per pair; a unit value is added where the value doesn't contain it."""
    out = [label] if label else []
    for p in pairs:
        extra = p.get("unit_value")
        out.append(f"{p['key']}: {p['value']}" + (f" ({extra})" if extra and extra not in (p["value"] or "") else ""))
    return "\n".join([*out, *([f"({unit})"] if unit else [])])


def pack(units: list[tuple[str, str]], target: int = TARGET, maximum: int = MAXIMUM) -> list[tuple[str, str]]:
    """(kind, text) units packed in order: closed before the maximum would be exceeded and once the target is reached.

    The kind of a chunk is that of its structured units from a fifth of its characters on, else text.
    """
    out: list[tuple[str, str]] = []
    now: list[tuple[str, str]] = []

    def close() -> None:
        if now:
            total = sum(len(t) for _, t in now) or 1
            share: dict[str, int] = {}
            for k, t in now:
                share[k] = share.get(k, 0) + len(t)
            best = max((k for k in share if k != "text"), key=lambda k: (share[k], k), default="text")
            kind = best if share.get(best, 0) >= STRUCTURED_SHARE * total else "text"
            out.append((kind, "\n".join(t for _, t in now)))
            now.clear()

    for kind, text in units:
        for piece in split_long(text, maximum):
            if now and tokens("\n".join([*(t for _, t in now), piece])) > maximum:
                close()
            now.append((kind, piece))
            if tokens("\n".join(t for _, t in now)) >= target:
                close()
    close()
    return out


def node_units(node: dict, maximum: int = MAXIMUM) -> list[tuple[str, str]]:
    if node["kind"] == "table":
        grid = [list(r) for r in node["grid"]]
        if is_contents(grid):
            return []
        return [("table", t) for t in render_table(grid, [list(o) for o in node["origins"]], maximum, node["unit_hint"])]
    if node["kind"] == "pairs":
        return [("pairs", render_pairs(node["label"], list(node["pairs"]), node["unit_hint"]))]
    return [("text", node["text"])] if node["text"] else []


def chunk_document(nodes: list[dict], doc_id: str, group: str, target: int = TARGET, maximum: int = MAXIMUM) -> list[dict]:
    """Chunks of one document. With parents: a section with content is a parent and its packed units are children; else the whole document if it fits, or packed units."""
    if group not in GROUPS:
        raise ValueError(f"unknown document group {group!r}")
    row = lambda cid, parent, section, kind, text: {"chunk_id": cid, "report_id": doc_id, "parent_chunk_id": parent, "section_path": section, "content_type": kind, "text": text}
    out = []
    if group in WITH_PARENTS:
        sections: list[tuple[list[str], list[dict]]] = []
        for n in nodes:
            path = list(n["section_path"])
            if not sections or sections[-1][0] != path:
                sections.append((path, []))
            sections[-1][1].append(n)
        for i, (path, own) in enumerate(sections):
            units = [u for n in own for u in node_units(n, maximum)]
            if not units:
                continue
            pid = f"{doc_id}::P{i}"
            out.append(row(pid, None, path, "parent", "\n".join([" > ".join(path), *(t for _, t in units)])))
            out += [row(f"{pid}::C{k}", pid, path, kind, text) for k, (kind, text) in enumerate(pack(units, target, maximum))]
        return out
    units = [u for n in nodes for u in node_units(n, maximum)]
    whole = "\n".join(t for _, t in units)
    if whole and tokens(whole) <= maximum:
        return [row(f"{doc_id}::C0", None, list(nodes[0]["section_path"]), "document", whole)]
    return [row(f"{doc_id}::C{k}", None, [], kind, text) for k, (kind, text) in enumerate(pack(units, target, maximum))]


CHUNK_SCHEMA = "chunk_id string, report_id string, parent_chunk_id string, section_path array<string>, content_type string, text string"


def chunks(nodes: DataFrame, groups: DataFrame, target: int = TARGET, maximum: int = MAXIMUM) -> DataFrame:
    """Chunk rows of parsed documents; groups: doc_id, doc_group. One document's nodes are handled together, so memory is bounded by a document."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        out = chunk_document(pdf.to_dict("records"), pdf["doc_id"].iloc[0], pdf["doc_group"].iloc[0], target, maximum)
        return pd.DataFrame(out, columns=[c.split()[0] for c in CHUNK_SCHEMA.split(", ")])

    return nodes.join(groups, "doc_id").groupBy("doc_id").applyInPandas(run, CHUNK_SCHEMA)


def chunk_markup(documents: DataFrame, target: int = TARGET, maximum: int = MAXIMUM) -> DataFrame:
    """Chunk rows straight from documents (doc_id, doc_group, text): a document is one row, so nothing is shuffled."""
    from ledgerloom.sources.markup import node_rows, parse

    columns = [c.split()[0] for c in CHUNK_SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, group, text in zip(pdf["doc_id"], pdf["doc_group"], pdf["text"], strict=True):
                nodes = node_rows(doc, parse(text))
                out += chunk_document(nodes, doc, group, target, maximum) if nodes else []
            if out:
                yield pd.DataFrame(out, columns=columns)

    return documents.where("text IS NOT NULL").select("doc_id", "doc_group", "text").mapInPandas(run, CHUNK_SCHEMA)


def leaves(chunk_rows: DataFrame) -> DataFrame:
    """Chunks that are no parent."""
    parents = chunk_rows.where("parent_chunk_id IS NOT NULL").select(F.col("parent_chunk_id").alias("chunk_id")).distinct()
    return chunk_rows.join(parents, "chunk_id", "left_anti")


def fixed_windows(df: DataFrame, id_: str, text: str, width: int = 1000) -> DataFrame:
    """id, window, text: consecutive windows of so many characters without overlap."""
    n = F.ceil(F.length(text) / width).cast("int")
    w = F.explode(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).alias("window")
    return df.where(F.length(text) > 0).select(id_, text, w).select(id_, "window", F.substring(text, F.col("window") * width + 1, F.lit(width)).alias("text"))


def split_texts(df: DataFrame, id_: str, text: str, budget: int = MAXIMUM) -> DataFrame:
    """id, piece, text by split_long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(i, k, p) for i, t in zip(pdf["id"], pdf["text"], strict=True) for k, p in enumerate(split_long(t, budget))]
            if out:
                yield pd.DataFrame(out, columns=["id", "piece", "text"])

    return df.where(F.col(text).isNotNull()).select(F.col(id_).cast("string").alias("id"), F.col(text).alias("text")).mapInPandas(run, "id string, piece int, text string")


def field_refs(nodes: DataFrame) -> DataFrame:
    """doc_id, seq, ref: coded values of pairs, for the search by field code."""
    return nodes.select("doc_id", "seq", F.explode("pairs").alias("ref")).where("ref.field_code IS NOT NULL")


def refs_in_piece(refs: Column, piece: Column) -> Column:
    """References whose text is unknown or occurs in the piece."""
    return F.filter(refs, lambda r: r["text"].isNull() | F.contains(piece, r["text"]))
