"""Queries of ranked retrieval and its evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import evaluate, retrieval
from ledgerloom.session import keep, table


def _docs(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def _questions(spark, d):
    """The stated query set: every question whose number is divisible by 20."""
    n = F.regexp_extract("query_id", "([0-9]+)$", 1).cast("long")
    return table(spark, d, "query_plans").where(n % 20 == 0).select("query_id", F.col("query").alias("text"))


def bm25_topk(spark, d):
    return retrieval.bm25(_docs(spark, d), _questions(spark, d), 10)


def bm25_ngrams(spark, d):
    """BM25 over character pairs, for languages without word breaks. Corpus: report names of the catalogue."""
    m = table(spark, d, "manifest").select(F.col("doc_id").alias("id"), F.concat_ws(" ", "corp_name", "report_nm").alias("text")).groupBy("id").agg(F.min("text").alias("text"))
    return retrieval.bm25(keep(m, "names"), _questions(spark, d), 10, retrieval.char_ngrams)


def char_ngram_counts(spark, d):
    m = table(spark, d, "manifest").select(F.explode(retrieval.char_ngrams(F.col("corp_name"), 2)).alias("token"))
    return m.groupBy("token").agg(F.count("*").alias("n"))


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def _vector_queries(spark, d):
    return _vectors(spark, d).where("id % 20 = 0").select(F.col("id").alias("query_id"), "v")


def dense_topk(spark, d):
    return retrieval.dense(_vectors(spark, d), _vector_queries(spark, d), 10)


def dense_filtered(spark, d):
    """Search among the vectors of one label only: the filter comes before the ranking."""
    return retrieval.dense(_vectors(spark, d).where("label = 1"), _vector_queries(spark, d), 5)


def _sparse_weights(df, id_):
    w = retrieval.words(F.col("text"))
    return df.select(id_, F.map_from_arrays(F.array_distinct(w), F.array_repeat(1 / F.sqrt(F.size(w).cast("double")), F.size(F.array_distinct(w)))).alias("w"))


def sparse_topk(spark, d):
    q = table(spark, d, "eval_passages").select(F.col("passage_id").alias("query_id"), "text")
    return retrieval.sparse(_sparse_weights(_docs(spark, d).where("text IS NOT NULL"), "id"), _sparse_weights(q, "query_id"), 10)


def _channels(spark, d):
    q = table(spark, d, "eval_passages").select(F.col("passage_id").alias("query_id"), "text")
    return keep(retrieval.bm25(_docs(spark, d), q, 20), "bm25"), keep(sparse_topk(spark, d), "sparse")


def fuse_rrf(spark, d):
    a, b = _channels(spark, d)
    return retrieval.hybrid([("bm25", a), ("sparse", b)], 10)


def fuse_weighted(spark, d):
    a, b = _channels(spark, d)
    return retrieval.hybrid([("bm25", a), ("sparse", b)], 10, mode="weighted")


def hybrid_search(spark, d):
    """The flagship: questions against reranker chunks, by the words of the text and by character runs of the filer's name, fused by reciprocal rank."""
    chunks = table(spark, d, "examples").where("chunk_id IS NOT NULL").groupBy(F.col("chunk_id").alias("id")).agg(F.min("text").alias("text"), F.coalesce(F.min("company"), F.lit("")).alias("company"))
    chunks = keep(chunks, "chunks")
    q = _questions(spark, d)
    names = retrieval.bm25(chunks.select("id", F.col("company").alias("text")), q, 50, lambda c: retrieval.char_ngrams(c, 4))
    return retrieval.hybrid([("words", retrieval.bm25(chunks.select("id", "text"), q, 50)), ("names", names)], 10)


def _three(spark, d):
    """Documents with a vector each (that of their number, counted round) and word weights, their source as scope; every twentieth one's first sentence asks."""
    v = _vectors(spark, d).select(F.col("id").alias("vid"), "v")
    n = v.count()
    docs = table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("scope"), (F.col("doc_id") % n).alias("vid")).join(v, "vid", "left").drop("vid")
    corpus = docs.join(_sparse_weights(docs, "id"), "id")
    q = docs.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.substring_index("text", ".", 1).alias("text"), "v", "scope")
    return corpus, q.join(_sparse_weights(q, "query_id"), "query_id")


def hybrid_three(spark, d):
    """Words, vectors and weights within the source of every asking document, fused by reciprocal rank."""
    return retrieval.prefiltered(*_three(spark, d), 10)


def _lists(spark, d):
    """Per question the rows of every label in order of their id, as two lists."""
    from pyspark.sql import Window

    e = table(spark, d, "examples").where("query_id IS NOT NULL AND label IS NOT NULL").groupBy("query_id", F.col("chunk_id").alias("id"), F.col("label").alias("list")).agg(F.min("example_id").alias("e"))
    w = Window.partitionBy("query_id", "list").orderBy("e", "id")
    return e.select("query_id", "id", "list", F.row_number().over(w).alias("rank"))


def round_robin_merge(spark, d):
    return retrieval.round_robin(_lists(spark, d), 8)


def keep_order_merge(spark, d):
    return retrieval.keep_order(_lists(spark, d), 8)


def candidate_documents(spark, d):
    of = table(spark, d, "examples").where("report_id IS NOT NULL").groupBy(F.col("chunk_id").alias("id")).agg(F.min("report_id").alias("doc"))
    return retrieval.candidate_documents(retrieval.keep_order(_lists(spark, d), 8).join(of, "id"), "doc")


def two_stage_search(spark, d):
    pool = keep(dense_topk(spark, d), "pool")
    of = _vectors(spark, d).select("id", F.col("label").alias("doc"))
    return retrieval.two_stage(pool, of, retrieval.dense_within(_vectors(spark, d), of, _vector_queries(spark, d)), 6)


def budget_prefix(spark, d):
    sizes = table(spark, d, "examples").groupBy(F.col("chunk_id").alias("id")).agg(F.max(F.length("text")).alias("len"))
    return retrieval.budget_prefix(round_robin_merge(spark, d).join(sizes, "id"), F.col("len"), 4000).select("query_id", "id", "rank", "n_left")


def parent_expand(spark, d):
    """Chunks with their report's longest chunk as parent text."""
    e = table(spark, d, "examples").where("chunk_id IS NOT NULL").groupBy(F.col("chunk_id").alias("id")).agg(F.min("text").alias("text"), F.min("report_id").alias("report_id"))
    parent = e.where("report_id IS NOT NULL").groupBy("report_id").agg(F.max_by("id", F.struct(F.length("text"), "id")).alias("parent_id"))
    chunks = e.join(parent, "report_id", "left").select("id", F.when(F.col("id") != F.col("parent_id"), F.col("parent_id")).alias("parent_id"), "text")
    out = retrieval.expand_to_parent(round_robin_merge(spark, d), chunks)
    return out.select("query_id", "id", "rank", F.length("text").cast("long").alias("len"), F.md5("text").alias("digest"))


def maxsim_rerank(spark, d):
    """Documents of several vectors: a label's vectors against those of the first query vectors."""
    v = _vectors(spark, d)
    docs = v.select((F.col("id") % 50).alias("id"), "v")
    q = v.where("id % 20 = 0").select(F.floor(F.col("id") / 100).alias("query_id"), F.col("id").alias("pos"), "v")
    pairs = q.select("query_id").distinct().crossJoin(F.broadcast(spark.range(0, 50)))
    return retrieval.maxsim(q, docs, pairs)


def semantic_route(spark, d):
    v = _vectors(spark, d)
    routes = v.where("id < 8").select(F.concat(F.lit("r"), F.col("label").cast("string")).alias("route"), "v")
    return retrieval.route(v.select(F.col("id").alias("query_id"), "v"), routes, 0.3)


def rank_metrics(spark, d):
    ranked = keep(dense_topk(spark, d), "ranked").join(_vectors(spark, d).select("id", F.col("label").alias("doc")), "id").select("query_id", "doc", "rank")
    gold = _vectors(spark, d).where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("label").alias("doc"))
    return evaluate.rank_metrics(ranked, gold, 10)


QUERIES = {f.__name__: f for f in (hybrid_search, hybrid_three, bm25_topk, bm25_ngrams, char_ngram_counts, dense_topk, dense_filtered, sparse_topk, fuse_rrf, fuse_weighted, round_robin_merge, keep_order_merge, candidate_documents, two_stage_search, budget_prefix, parent_expand, maxsim_rerank, semantic_route, rank_metrics)}

_Q = "q AS (SELECT query_id, query AS text FROM query_plans WHERE regexp_extract(query_id, '([0-9]+)$', 1)::BIGINT % 20 = 0)"
_P = "q AS (SELECT passage_id AS query_id, text FROM eval_passages)"
_D = "c AS (SELECT doc_id AS id, text FROM documents)"
_WORDS = "list_filter(string_split_regex(lower({0}), '\\s+'), lambda x: x <> '')"
_GRAMS = "list_transform(range(1, greatest(length(regexp_replace(lower({0}), '\\s+', '', 'g')), 2)), lambda i: substr(regexp_replace(lower({0}), '\\s+', '', 'g'), i, 2))"

_BARE = "regexp_replace(lower({0}), '\\s+', '', 'g')"
_RUNS = f"CASE WHEN {_BARE} = '' THEN [] ELSE list_transform(range(1, greatest(length({_BARE}) - 3, 1) + 1), lambda i: substr({_BARE}, i, 4)) END"


def _bm25(k: int, tokens: str, name: str = "r") -> str:
    """CTEs that rank c for q into {name}(query_id, id, score, rank)."""
    n = name
    return f"""{n}t AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({tokens.format("text")}) AS term FROM q) GROUP BY ALL),
{n}d AS (SELECT id, len({tokens.format("text")}) AS dl, {tokens.format("text")} AS t FROM c WHERE text IS NOT NULL),
{n}p AS (SELECT term, id, dl, count(*) AS tf FROM (SELECT id, dl, unnest(t) AS term FROM {n}d) WHERE term IN (SELECT term FROM {n}t) GROUP BY ALL),
{n}f AS (SELECT term, count(*) AS df FROM {n}p GROUP BY 1), {n}n AS (SELECT count(*) AS n, avg(dl) AS a FROM {n}d),
{n}s AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / a)) * qtf), 6) AS score FROM {n}p JOIN {n}f USING (term) JOIN {n}t USING (term), {n}n GROUP BY ALL),
{n} AS (SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM {n}s WHERE score > 0) WHERE rank <= {k})"""


def ranked_documents(k: int) -> str:
    """CTEs that rank the documents for q into r(query_id, id, score, rank), for other modules."""
    return f"{_D}, {_bm25(k, _WORDS)}"


_VEC = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings), vq AS (SELECT id AS query_id, v FROM v WHERE id % 20 = 0)"


def _dense(k: int, where: str = "true", name: str = "dense") -> str:
    return f"""{_VEC}, {name} AS (SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM
  (SELECT query_id, v.id, round(list_dot_product(vq.v, v.v), 6) AS score FROM v, vq WHERE {where})) WHERE rank <= {k})"""


_SPARSE = f"""sd AS (SELECT id, unnest(list_distinct({_WORDS.format("text")})) AS token, 1 / sqrt(len({_WORDS.format("text")})::DOUBLE) AS w FROM c WHERE text IS NOT NULL),
sq AS (SELECT query_id, unnest(list_distinct({_WORDS.format("text")})) AS token, 1 / sqrt(len({_WORDS.format("text")})::DOUBLE) AS w FROM q),
sparse AS (SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM (SELECT query_id, id, round(sum(sd.w * sq.w), 6) AS score FROM sd JOIN sq USING (token) GROUP BY ALL)) WHERE rank <= 10)"""


def _rrf(parts: list[str], k: int) -> str:
    both = " UNION ALL ".join(f"SELECT query_id, id, rank, {i} AS channel FROM {p}" for i, p in enumerate(parts))
    return f"""SELECT query_id, id, score, rank FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, f, id)::INTEGER AS rank FROM
  (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS score, min({{'c': channel, 'r': rank}}) AS f FROM ({both}) GROUP BY ALL)) WHERE rank <= {k}"""


_LISTS = """l AS (SELECT query_id, id, list, row_number() OVER (PARTITION BY query_id, list ORDER BY e, id)::INTEGER AS rank FROM
  (SELECT query_id, chunk_id AS id, label AS list, min(example_id) AS e FROM examples WHERE query_id IS NOT NULL AND label IS NOT NULL GROUP BY ALL))"""
_ROBIN = "rr AS (SELECT query_id, id, rank FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY f, id)::INTEGER AS rank FROM (SELECT query_id, id, min({'r': rank, 'l': list}) AS f FROM l GROUP BY ALL)) WHERE rank <= 8)"
_KEEP = "ko AS (SELECT query_id, id, rank FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY f, id)::INTEGER AS rank FROM (SELECT query_id, id, min({'l': list, 'r': rank}) AS f FROM l GROUP BY ALL)) WHERE rank <= 8)"
ORACLES = {
    "hybrid_search": f"""WITH {_Q}, c AS (SELECT chunk_id AS id, min(text) AS text, coalesce(min(company), '') AS company FROM examples WHERE chunk_id IS NOT NULL GROUP BY 1), {_bm25(50, _WORDS, "ra")},
{_bm25(50, _RUNS, "rb").replace("FROM c WHERE text IS NOT NULL", "FROM (SELECT id, company AS text FROM c)")} {_rrf(["ra", "rb"], 10)}""",
    "hybrid_three": f"""WITH n AS (SELECT count(*) AS n FROM embeddings), c AS (SELECT doc_id AS id, text, source AS scope, embedding::DOUBLE[] AS v FROM documents, n LEFT JOIN embeddings ON vec_id = doc_id % n.n WHERE text IS NOT NULL),
q AS (SELECT id AS query_id, split_part(text, '.', 1) AS text, scope, v FROM c WHERE id % 20 = 0),
bt AS (SELECT query_id, scope, term, count(*) AS qtf FROM (SELECT query_id, scope, unnest({_WORDS.format("text")}) AS term FROM q) GROUP BY ALL), bd AS (SELECT id, scope, len({_WORDS.format("text")}) AS dl, {_WORDS.format("text")} AS t FROM c),
bp AS (SELECT term, id, scope, dl, count(*) AS tf FROM (SELECT id, scope, dl, unnest(t) AS term FROM bd) WHERE term IN (SELECT term FROM bt) GROUP BY ALL), bf AS (SELECT term, count(*) AS df FROM bp GROUP BY 1), bn AS (SELECT count(*) AS n, avg(dl) AS a FROM bd),
bs AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / a)) * qtf), 6) AS score FROM bp JOIN bf USING (term) JOIN bt ON bt.term = bp.term AND (bt.scope IS NULL OR bt.scope = bp.scope), bn GROUP BY ALL),
ds AS (SELECT query_id, id, round(list_dot_product(q.v, c.v), 6) AS score FROM c JOIN q ON (q.scope IS NULL OR q.scope = c.scope) WHERE c.v IS NOT NULL AND q.v IS NOT NULL),
sd AS (SELECT id, scope, unnest(list_distinct({_WORDS.format("text")})) AS token, 1 / sqrt(len({_WORDS.format("text")})::DOUBLE) AS w FROM c), sq AS (SELECT query_id, scope, unnest(list_distinct({_WORDS.format("text")})) AS token, 1 / sqrt(len({_WORDS.format("text")})::DOUBLE) AS w FROM q),
ss AS (SELECT query_id, id, round(sum(sd.w * sq.w), 6) AS score FROM sd JOIN sq ON sd.token = sq.token AND (sq.scope IS NULL OR sq.scope = sd.scope) GROUP BY ALL),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM bs WHERE score > 0) WHERE rank <= 50),
e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM ds) WHERE rank <= 50),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM ss) WHERE rank <= 50) {_rrf(["b", "e", "s"], 10)}""",
    "bm25_topk": f"WITH {_Q}, {_D}, {_bm25(10, _WORDS)} SELECT * FROM r",
    "bm25_ngrams": f"WITH {_Q}, c AS (SELECT doc_id AS id, min(concat_ws(' ', corp_name, report_nm)) AS text FROM manifest GROUP BY 1), {_bm25(10, _GRAMS)} SELECT * FROM r",
    "char_ngram_counts": f"SELECT token, count(*) AS n FROM (SELECT unnest({_GRAMS.format('corp_name')}) AS token FROM manifest) GROUP BY 1",
    "dense_topk": f"WITH {_dense(10)} SELECT * FROM dense",
    "dense_filtered": f"WITH {_dense(5, 'label = 1')} SELECT * FROM dense",
    "sparse_topk": f"WITH {_P}, {_D}, {_SPARSE} SELECT * FROM sparse",
    "fuse_rrf": f"WITH {_P}, {_D}, {_bm25(20, _WORDS)}, {_SPARSE} {_rrf(['r', 'sparse'], 10)}",
    "fuse_weighted": f"""WITH {_P}, {_D}, {_bm25(20, _WORDS)}, {_SPARSE}, u AS (SELECT query_id, id, score, 0.25::DOUBLE AS w, 'bm25' AS channel FROM r UNION ALL SELECT query_id, id, score, 0.15::DOUBLE, 'sparse' FROM sparse),
m AS (SELECT query_id, channel, w, min(score) AS lo, max(score) AS hi FROM u GROUP BY ALL), t AS (SELECT query_id, sum(w) AS total FROM m GROUP BY 1)
SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM
  (SELECT u.query_id, u.id, round(sum(CASE WHEN hi - lo < 1e-12 THEN 0.5::DOUBLE ELSE (score - lo) / (hi - lo) END * u.w / total), 8) AS score FROM u JOIN m USING (query_id, channel) JOIN t USING (query_id) GROUP BY ALL)) WHERE rank <= 10""",
    "round_robin_merge": f"WITH {_LISTS}, {_ROBIN} SELECT * FROM rr",
    "keep_order_merge": f"WITH {_LISTS}, {_KEEP} SELECT * FROM ko",
    "candidate_documents": f"""WITH {_LISTS}, {_KEEP}, o AS (SELECT chunk_id AS id, min(report_id) AS doc FROM examples WHERE report_id IS NOT NULL GROUP BY 1)
SELECT query_id, doc, rank FROM (SELECT query_id, doc, row_number() OVER (PARTITION BY query_id ORDER BY first, doc)::INTEGER AS rank FROM (SELECT query_id, doc, min(rank) AS first FROM ko JOIN o USING (id) GROUP BY ALL)) WHERE rank <= 3""",
    "two_stage_search": f"""WITH {_dense(10)}, p AS (SELECT d.*, label AS doc FROM dense d JOIN v USING (id)),
c AS (SELECT query_id, doc, list FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first, doc)::INTEGER AS list FROM (SELECT query_id, doc, min(rank) AS first FROM p GROUP BY ALL)) WHERE list <= 3),
s AS (SELECT c.query_id, list, v.id, round(list_dot_product(vq.v, v.v), 6) AS score FROM c JOIN v ON v.label = c.doc JOIN vq ON vq.query_id = c.query_id),
l AS (SELECT query_id, list, id, row_number() OVER (PARTITION BY query_id, list ORDER BY score DESC, id)::INTEGER AS rank FROM s),
m AS (SELECT query_id, id, 0 AS list, row_number() OVER (PARTITION BY query_id ORDER BY f, id)::INTEGER AS rank FROM (SELECT query_id, id, min({{'r': rank, 'l': list}}) AS f FROM l WHERE rank <= 6 GROUP BY ALL)),
u AS (SELECT query_id, id, min({{'l': list, 'r': rank}}) AS f FROM (SELECT * FROM m UNION ALL SELECT query_id, id, 1, rank FROM dense) GROUP BY ALL)
SELECT query_id, id, rank FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY f, id)::INTEGER AS rank FROM u) WHERE rank <= 6""",
    "budget_prefix": f"""WITH {_LISTS}, {_ROBIN}, s AS (SELECT chunk_id AS id, max(length(text)) AS len FROM examples GROUP BY 1),
u AS (SELECT rr.*, sum(len) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM rr JOIN s USING (id)),
o AS (SELECT *, max(CASE WHEN used > 4000 AND rank > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) AS over FROM u)
SELECT query_id, id, rank, n_left FROM (SELECT *, sum(over) OVER (PARTITION BY query_id)::BIGINT AS n_left FROM o) WHERE over = 0""",
    "parent_expand": f"""WITH {_LISTS}, {_ROBIN}, e AS (SELECT chunk_id AS id, min(text) AS text, min(report_id) AS report_id FROM examples WHERE chunk_id IS NOT NULL GROUP BY 1),
p AS (SELECT report_id, arg_max(id, (length(text), id)) AS parent_id FROM e WHERE report_id IS NOT NULL GROUP BY 1),
c AS (SELECT e.id, e.text, CASE WHEN e.id <> p.parent_id THEN p.parent_id END AS parent_id FROM e LEFT JOIN p USING (report_id)),
j AS (SELECT rr.*, c.text AS leaf, c.parent_id, x.text AS parent, instr(x.text, substr(c.text, 1, 120)) AS pos FROM rr JOIN c USING (id) LEFT JOIN c x ON c.parent_id = x.id),
w AS (SELECT *, row_number() OVER (PARTITION BY query_id, coalesce(parent_id, id) ORDER BY rank) AS rn FROM j),
t AS (SELECT query_id, id, rank, CASE WHEN parent IS NULL THEN leaf WHEN length(parent) <= 4000 THEN parent ELSE substr(parent, greatest(1, least(pos - 2000, length(parent) - 4000 + 1)), 4000) END AS text FROM w WHERE rn = 1)
SELECT query_id, id, rank, length(text) AS len, md5(text) AS digest FROM t""",
    "maxsim_rerank": f"""WITH {_VEC}, d AS (SELECT id % 50 AS id, v FROM v), q AS (SELECT floor(id / 100)::BIGINT AS query_id, id AS pos, v FROM v WHERE id % 20 = 0)
SELECT query_id, id, round(avg(m), 6) AS score FROM (SELECT query_id, d.id, pos, max(list_dot_product(q.v, d.v)) AS m FROM q, d GROUP BY ALL) GROUP BY ALL""",
    "semantic_route": f"""WITH {_VEC}, r AS (SELECT 'r' || label AS route, v FROM v WHERE id < 8), s AS (SELECT v.id AS query_id, route, list_dot_product(v.v, r.v) AS s FROM v, r)
SELECT query_id, CASE WHEN score >= 0.3 THEN route ELSE 'none' END AS route, score FROM (SELECT query_id, arg_max(route, (s, route)) AS route, round(max(s), 6) AS score FROM s GROUP BY 1)""",
    "rank_metrics": f"""WITH {_dense(10)}, r AS (SELECT d.query_id, d.rank, v.label AS doc, v.label = g.label AS rel FROM dense d JOIN v USING (id) JOIN v g ON g.id = d.query_id),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc ORDER BY rank) = 1 AND rel AS new FROM r)
SELECT query_id, round(max(new::INTEGER)::DOUBLE, 6) AS recall, round(coalesce(1.0::DOUBLE / min(rank) FILTER (WHERE rel), 0), 6) AS mrr, round(sum(CASE WHEN new THEN 1 / log2(rank + 1.0::DOUBLE) ELSE 0 END), 6) AS ndcg, max(new::INTEGER) AS hit,
  round(avg(rel::INTEGER), 6) AS precision, round(sum(CASE WHEN new THEN 1.0::DOUBLE / rank ELSE 0 END), 6) AS ap, min(rank) FILTER (WHERE rel) AS first_rank FROM f GROUP BY 1""",
}
