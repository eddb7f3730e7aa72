"""Lexical and vector retrieval: postings, BM25, exact cosine, fusion, diversity, evaluation."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom import shared
from textloom.functions import models, scores, text
from textloom.operators.segments import Segments
from textloom.registry import query, table

QUERY_TERMS = ("the", "thble", "hest", "anat", "le", "der")
K = 10


def postings(docs: DataFrame, doc_id: str = "doc_id", body: str = "text") -> DataFrame:
    """(doc_id, term, tf, dl): a row for each document and word of it."""
    words = docs.select(F.col(doc_id).alias("doc_id"), text.tokens(F.col(body)).alias("words"))
    return words.select("doc_id", F.size("words").alias("dl"), F.explode("words").alias("term")).groupBy("doc_id", "term", "dl").agg(F.count("*").alias("tf"))


def corpus_stats(docs: DataFrame, doc_id: str = "doc_id", body: str = "text") -> DataFrame:
    """One row: documents n and their mean length avgdl."""
    return docs.select(F.size(text.tokens(F.col(body))).alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def term_stats(posted: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, df, idf): a negative idf becomes a quarter of the mean one."""
    raw = posted.groupBy("term").agg(F.count("*").alias("df")).crossJoin(stats.select("n")).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(mean).select("term", "df", F.when(F.col("raw") < 0, 0.25 * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


@dataclass(frozen=True)
class Index:
    """A stored BM25 index: postings and terms, both sorted by term, so that a search reads only its terms' row groups."""

    postings: DataFrame
    terms: DataFrame
    documents: int
    average: float
    folder: str

    def search(self, terms: tuple[str, ...], k: int = K) -> DataFrame:
        """(doc_id, score) of the k best; a repeated query term counts twice, only positive scores stay, ties go by doc_id."""
        asked = sorted(set(terms))
        times = reduce(lambda c, t: c.when(F.col("term") == t, terms.count(t)), asked, F.when(F.lit(False), 0)).otherwise(0)
        idf = self.terms.where(F.col("term").isin(*asked)).select("term", "idf")  # a row for each word asked for at most
        part = times * scores.bm25(F.col("tf"), F.col("dl"), F.lit(self.average), F.col("idf"))
        hits = self.postings.where(F.col("term").isin(*asked)).join(F.broadcast(idf), "term").groupBy("doc_id").agg(F.sum(part).alias("score"))
        return hits.where("score > 0").orderBy(F.desc("score"), "doc_id").limit(k)

    def clear(self) -> None:
        """Deletes the stored tables."""
        shared.delete(self.postings.sparkSession, self.folder)


def opened(segments: Segments) -> Index:
    """The index as its last manifest has it."""
    m = segments.manifest()
    return Index(segments.postings(m), segments.terms(m), m.documents, m.words / m.documents if m.documents else 0.0, segments.folder)


def build_index(docs: DataFrame, folder: str | None = None, doc_id: str = "doc_id", body: str = "text") -> Index:
    """Counts all documents' words once and stores them as the first segment of an index that can change."""
    segments = Segments(docs.sparkSession, folder or shared.new_folder(docs.sparkSession, "bm25"))
    segments.add(docs, doc_id, body)
    return opened(segments)


_BUILT: dict[tuple[str, str], tuple[str, Index]] = {}


def index_of(spark, sf_dir: str) -> Index:
    """The index of a folder's documents, built when it is first asked for in a session, and anew when the files have changed."""
    key, now = (spark.sparkContext.applicationId, sf_dir), shared.signature(spark, f"{sf_dir}/documents.parquet")
    if key in _BUILT and _BUILT[key][0] != now:
        _BUILT.pop(key)[1].clear()
    if key not in _BUILT:
        _BUILT[key] = (now, build_index(table(spark, sf_dir, "documents")))
    return _BUILT[key][1]


def clear_indexes() -> int:
    """Drops all built indexes; how many there were."""
    n = len(_BUILT)
    while _BUILT:
        _BUILT.popitem()[1][1].clear()
    return n


_BM25 = """
w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS words FROM documents),
p AS (SELECT doc_id, len(words) AS dl, unnest(words) AS term FROM w), post AS (SELECT doc_id, dl, term, count(*) AS tf FROM p GROUP BY ALL),
stats AS (SELECT count(*) AS n, avg(len(words)) AS avgdl FROM w), raw AS (SELECT term, count(*) AS df, ln((SELECT n FROM stats) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post GROUP BY term),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
lex AS (SELECT doc_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avgdl FROM stats)))) AS score FROM post JOIN idf USING (term) WHERE term IN {terms} GROUP BY doc_id HAVING sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avgdl FROM stats)))) > 0)
"""
_TERMS = str(QUERY_TERMS)


@query("bm25_topk", f"WITH {_BM25.format(terms=_TERMS)} SELECT doc_id, round(score, 6) AS score FROM lex ORDER BY round(score, 9) DESC, doc_id LIMIT {K}")
def bm25_topk(spark, sf_dir):
    """BM25 search over all documents."""
    found = index_of(spark, sf_dir).search(QUERY_TERMS, 4 * K)
    return found.orderBy(F.desc(F.round("score", 9)), "doc_id").limit(K).select("doc_id", F.round("score", 6).alias("score"))


@query("term_stats", """WITH w AS MATERIALIZED (SELECT list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS words FROM documents), n AS MATERIALIZED (SELECT count(*) AS n FROM documents),
raw AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM (SELECT unnest(words) AS term FROM w) GROUP BY term), n), m AS MATERIALIZED (SELECT avg(raw) AS mean FROM raw)
SELECT term, df, round(CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END, 6) AS idf FROM raw, m""")
def term_stats_query(spark, sf_dir):
    """Document frequency and idf of every word, as the index holds them."""
    return index_of(spark, sf_dir).terms.select("term", "df", F.round("idf", 6).alias("idf"))


_LIVE = "live AS (SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND doc_id NOT IN (SELECT item_id * 7 FROM benchmark) UNION ALL SELECT item_id * 7, text FROM benchmark UNION ALL SELECT -1 - page_id, html FROM pages)"


def changed_index(spark, sf_dir: str) -> Segments:
    """All documents; then the benchmark's items in place of those of seven times their numbers; then without those labelled toxic; then with all pages."""
    out = Segments(spark, shared.new_folder(spark, "changing"))
    out.add(table(spark, sf_dir, "documents"))
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    out.delete(toxic)
    out.add(table(spark, sf_dir, "benchmark").select((F.col("item_id") * 7).alias("doc_id"), "text"))
    out.add(table(spark, sf_dir, "pages").select((-1 - F.col("page_id")).alias("doc_id"), F.col("html").alias("text")))
    return out


@query("changed_index_terms", f"""WITH {_LIVE}, w AS MATERIALIZED (SELECT list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS words FROM live), n AS MATERIALIZED (SELECT count(*) AS n FROM live),
raw AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM (SELECT unnest(words) AS term FROM w) GROUP BY term), n), m AS MATERIALIZED (SELECT avg(raw) AS mean FROM raw)
SELECT term, df, round(CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END, 6) AS idf FROM raw, m""")
def changed_index_terms(spark, sf_dir):
    """Terms of an index after documents have been added, replaced and deleted: the live ones count."""
    return changed_index(spark, sf_dir).terms().select("term", "df", F.round("idf", 6).alias("idf"))


@query("changed_index_search", f"WITH {_LIVE}, {_BM25.format(terms=_TERMS).replace('FROM documents', 'FROM live')} SELECT doc_id, round(score, 6) AS score FROM lex ORDER BY round(score, 9) DESC, doc_id LIMIT {K}")
def changed_index_search(spark, sf_dir):
    """A search of the same index."""
    found = opened(changed_index(spark, sf_dir)).search(QUERY_TERMS, 4 * K)
    return found.orderBy(F.desc(F.round("score", 9)), "doc_id").limit(K).select("doc_id", F.round("score", 6).alias("score"))


@query("corpus_stats", "SELECT count(*) AS n, round(avg(len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'))), 6) AS avgdl FROM documents")
def corpus_stats_query(spark, sf_dir):
    return corpus_stats(table(spark, sf_dir, "documents")).select("n", F.round("avgdl", 6).alias("avgdl"))


def dense_search(vectors: DataFrame, probe: list[float], k: int = K) -> DataFrame:
    """(vec_id, score) of the k vectors with the largest cosine to ``probe``, clamped to 0 and 1; exact, one pass, no shuffle but the top k's."""
    score = scores.cosine(F.col("embedding"), F.array(*map(F.lit, probe)))
    return vectors.select("vec_id", F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)).alias("score")).orderBy(F.desc("score"), "vec_id").limit(k)


def probe_of(spark, sf_dir, vec_id: int = 0) -> list[float]:
    return [float(x) for x in table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).head()["embedding"]]


_DENSE = "dense AS (SELECT e.vec_id, greatest(0.0, least(1.0, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]))) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"


@query("dense_topk", f"WITH {_DENSE} SELECT vec_id, round(score, 6) AS score FROM dense ORDER BY round(score, 9) DESC, vec_id LIMIT {K}")
def dense_topk(spark, sf_dir):
    """Exact vector search for one vector."""
    found = dense_search(table(spark, sf_dir, "embeddings"), probe_of(spark, sf_dir), 4 * K)
    return found.orderBy(F.desc(F.round("score", 9)), "vec_id").limit(K).select("vec_id", F.round("score", 6).alias("score"))


def min_max(hits: DataFrame, by: str = "query_id") -> DataFrame:
    """Scores between 0 and 1 within each query; equal ones become 1."""
    w = Window.partitionBy(by)
    low, high = F.min("score").over(w), F.max("score").over(w)
    return hits.withColumn("score", F.when(high == low, 1.0).otherwise((F.col("score") - low) / (high - low)))


def fuse(lexical: DataFrame, dense: DataFrame, k: int, weight: float = 0.4) -> DataFrame:
    """(query_id, doc_id, bm25_score, dense_score, score): both normalised, a missing side counts 0, the k best of each query."""
    a, b = min_max(lexical).withColumnRenamed("score", "bm25_score"), min_max(dense).withColumnRenamed("score", "dense_score")
    both = a.join(b, ["query_id", "doc_id"], "full_outer").na.fill(0.0, ["bm25_score", "dense_score"])
    both = both.withColumn("score", weight * F.col("bm25_score") + (1 - weight) * F.col("dense_score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id"))
    return both.withColumn("rank", rank).where(F.col("rank") <= k)


def _legs(spark, sf_dir):
    """The two legs' candidates for one query; vectors stand for the documents of the same number."""
    lexical = index_of(spark, sf_dir).search(QUERY_TERMS, 40).orderBy(F.desc(F.round("score", 9)), "doc_id").limit(30).select(F.lit(1).alias("query_id"), "doc_id", "score")
    dense = dense_search(table(spark, sf_dir, "embeddings"), probe_of(spark, sf_dir), 40).orderBy(F.desc(F.round("score", 9)), "vec_id").limit(30).select(F.lit(1).alias("query_id"), F.col("vec_id").alias("doc_id"), "score")
    return lexical, dense


@query("hybrid_fusion", f"""WITH {_BM25.format(terms=_TERMS)}, {_DENSE},
l AS (SELECT doc_id, score FROM lex ORDER BY round(score, 9) DESC, doc_id LIMIT 30), d AS (SELECT vec_id AS doc_id, score FROM dense ORDER BY round(score, 9) DESC, vec_id LIMIT 30),
ln AS (SELECT doc_id, CASE WHEN max(score) OVER () = min(score) OVER () THEN 1.0 ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END AS s FROM l),
dn AS (SELECT doc_id, CASE WHEN max(score) OVER () = min(score) OVER () THEN 1.0 ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END AS s FROM d)
SELECT doc_id, round(coalesce(ln.s, 0), 6) AS bm25_score, round(coalesce(dn.s, 0), 6) AS dense_score, round(0.4 * coalesce(ln.s, 0) + 0.6 * coalesce(dn.s, 0), 6) AS score
FROM ln FULL JOIN dn USING (doc_id) ORDER BY round(0.4 * coalesce(ln.s, 0) + 0.6 * coalesce(dn.s, 0), 9) DESC, doc_id LIMIT 20""")
def hybrid_fusion(spark, sf_dir):
    """Normalised BM25 and vector scores, joined and weighted."""
    r = lambda c: F.round(c, 6).alias(c)
    return fuse(*_legs(spark, sf_dir), 20).select("doc_id", r("bm25_score"), r("dense_score"), r("score"))


def mmr(candidates: DataFrame, k: int, weight: float = 0.7) -> DataFrame:
    """(query_id, doc_id, rank): greedy choice of relevance against word overlap with what is chosen; candidates (query_id, doc_id, score, words).

    A query's candidates are few (twice k), so each query is one group of a pandas function.
    """

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "doc_id"], ascending=[False, True]).reset_index(drop=True)
        if len(pdf) <= k:
            return pd.DataFrame({"query_id": pdf.query_id, "doc_id": pdf.doc_id, "rank": range(1, len(pdf) + 1)})
        words = [set(w) for w in pdf.words]
        near, chosen, rest = np.zeros(len(pdf)), [0], list(range(1, len(pdf)))
        while len(chosen) < k:
            for r in rest:
                union = len(words[r] | words[chosen[-1]])
                near[r] = max(near[r], len(words[r] & words[chosen[-1]]) / union if union else 0.0)
            best = max(rest, key=lambda r: weight * pdf.score[r] - (1 - weight) * near[r])
            chosen.append(best)
            rest.remove(best)
        return pd.DataFrame({"query_id": pdf.query_id[0], "doc_id": pdf.doc_id[chosen].to_numpy(), "rank": range(1, k + 1)})

    return candidates.groupBy("query_id").applyInPandas(pick, "query_id int, doc_id long, rank int")


@query("hybrid_search")
def hybrid_search(spark, sf_dir):
    """Both legs, fusion, and diversity: the whole search."""
    fused = fuse(*_legs(spark, sf_dir), 20)
    words = table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("words"))
    return mmr(fused.select("query_id", "doc_id", "score").join(words, "doc_id").select("query_id", "doc_id", "score", "words"), K).select("doc_id", "rank")


def endpoint(hits: DataFrame, docs: DataFrame, question: str, k: int, rerank: models.Reranker = models.overlap_score) -> DataFrame:
    """(doc_id, score, relevance): candidates (doc_id), four times k of them, scored again against the question, the k best, and their score between 0 and 1."""
    scored = hits.select("doc_id").join(docs.select("doc_id", "text"), "doc_id").select("doc_id", F.round(rerank(F.lit(question), F.col("text")), 9).alias("score"))
    return scored.orderBy(F.desc("score"), "doc_id").limit(k).withColumn("relevance", models.sigmoid(F.col("score")))


_QUESTION = " ".join(QUERY_TERMS)


@query("search_endpoint", f"""WITH {_BM25.format(terms=_TERMS)}, {_DENSE},
l AS (SELECT doc_id, score FROM lex ORDER BY round(score, 9) DESC, doc_id LIMIT 30), d AS (SELECT vec_id AS doc_id, score FROM dense ORDER BY round(score, 9) DESC, vec_id LIMIT 30),
ln AS (SELECT doc_id, CASE WHEN max(score) OVER () = min(score) OVER () THEN 1.0 ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END AS s FROM l),
dn AS (SELECT doc_id, CASE WHEN max(score) OVER () = min(score) OVER () THEN 1.0 ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END AS s FROM d),
h AS (SELECT doc_id FROM ln FULL JOIN dn USING (doc_id) ORDER BY round(0.4 * coalesce(ln.s, 0) + 0.6 * coalesce(dn.s, 0), 9) DESC, doc_id LIMIT {4 * K}),
r AS (SELECT doc_id, round(len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')), {list(QUERY_TERMS)})) / {len(QUERY_TERMS)}.0, 9) AS score FROM h JOIN documents USING (doc_id))
SELECT doc_id, round(score, 6)::DOUBLE AS score, round(1 / (1 + exp(-score)), 6)::DOUBLE AS relevance FROM r ORDER BY score DESC, doc_id LIMIT {K}""")
def search_endpoint(spark, sf_dir):
    """The whole search: both legs, fusion, the reranker, and scores between 0 and 1."""
    out = endpoint(fuse(*_legs(spark, sf_dir), 4 * K), table(spark, sf_dir, "documents"), _QUESTION, K)
    return out.select("doc_id", F.round("score", 6).alias("score"), F.round("relevance", 6).alias("relevance"))


@query("context_assembly", f"""WITH {_BM25.format(terms=_TERMS)}, top AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM lex QUALIFY rank <= 5)
SELECT string_agg('[Chunk ' || rank || '] Source: ' || source || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM top JOIN documents USING (doc_id)""")
def context_assembly(spark, sf_dir):
    """The prompt context of the best hits."""
    docs = table(spark, sf_dir, "documents")
    top = index_of(spark, sf_dir).search(QUERY_TERMS, 40).withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), "doc_id"))).where("rank <= 5")
    part = F.concat(F.lit("[Chunk "), F.col("rank").cast("string"), F.lit("] Source: "), "source", F.lit("\n"), "text")
    rows = top.join(docs, "doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", part.alias("part")))).alias("parts"))
    return rows.select(F.array_join(F.transform("parts", lambda x: x["part"]), "\n\n---\n\n").alias("context"))


def evaluate(retrieved: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """Per query precision and recall at each k and the reciprocal rank of the first hit; retrieved (query_id, doc_id, rank), gold (query_id, doc_id)."""
    hit = retrieved.join(gold.withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left").na.fill(0, ["hit"])
    return measured(hit, gold.groupBy("query_id").agg(F.count("*").alias("expected")), ks)


def measured(hit: DataFrame, total: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """The metrics of ranked hits (query_id, rank, hit) given what each query expects (query_id, expected)."""
    out = hit.groupBy("query_id").agg(
        *(F.sum(F.when(F.col("rank") <= k, F.col("hit")).otherwise(0)).alias(f"hits_{k}") for k in ks), F.count("*").alias("found"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"),
    ).join(total, "query_id", "right")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        "query_id", *(F.round(F.coalesce(zero(F.col(f"hits_{k}")) / F.nullif(F.least(F.lit(k), zero(F.col("found"))), F.lit(0)), F.lit(0.0)), 6).alias(f"p_{k}") for k in ks),
        *(F.round(zero(F.col(f"hits_{k}")) / F.col("expected"), 6).alias(f"r_{k}") for k in ks), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("rr"),
    )


_EVAL = """WITH q AS (SELECT vec_id AS query_id, embedding, label FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, e.vec_id AS doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) DESC, e.vec_id) AS rank FROM q JOIN embeddings e ON e.vec_id <> q.query_id QUALIFY rank <= 10),
g AS (SELECT query_id, e.vec_id AS doc_id FROM q JOIN embeddings e ON e.label = q.label AND e.vec_id <> q.query_id), t AS (SELECT query_id, count(*) AS expected FROM g GROUP BY query_id),
h AS (SELECT s.query_id, s.rank, g.doc_id IS NOT NULL AS hit FROM s LEFT JOIN g ON s.query_id = g.query_id AND s.doc_id = g.doc_id),
m AS (SELECT query_id, sum((hit AND rank <= 5)::INT) / 5.0 AS p5, sum(hit::INT) / 10.0 AS p10, sum((hit AND rank <= 5)::INT) AS h5, sum(hit::INT) AS h10, min(CASE WHEN hit THEN rank END) AS first FROM h GROUP BY query_id)
"""
#: Queries of a block, and rows that a task holds against them at once: together they bound its memory, whatever the batches.
QUERY_BLOCK, ROW_BLOCK = 4096, 256


def _usable(v: list | None, size: int | None) -> bool:
    """Whether a vector has a direction, and as many numbers as it must."""
    return v is not None and None not in v and len(v) > 0 and size in (None, len(v)) and bool(np.isfinite(v).all()) and any(v)


def search_all(vectors: DataFrame, queries: DataFrame, k: int = K, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, vec_id, score, rank) of the k nearest rows other than itself to each of ``queries`` (query_id, embedding).

    Queries go out in blocks of bounded size, each against all rows; a task keeps its k best of each query, so that what is
    ranked in the end is k rows for each query and task. Each block's hits are written before the next goes out, so that the
    driver holds one block of each length of vectors. Null and zero vectors and those with null or non-finite numbers neither
    ask nor are found; vectors of different lengths never meet.
    """
    spark, out = vectors.sparkSession, None

    def nearest(sent):
        def run(batches):
            ids, probes = sent.value
            best_id, best = np.full((len(ids), 0), 0, np.int64), np.full((len(ids), 0), 0.0)
            for b in (x.slice(at, ROW_BLOCK) for x in batches for at in range(0, x.num_rows, ROW_BLOCK)):
                keep = [k for k, v in enumerate(b.column(1).to_pylist()) if _usable(v, probes.shape[1])]
                m = np.array([b.column(1)[k].as_py() for k in keep], float).reshape(-1, probes.shape[1])
                row = np.broadcast_to(b.column(0).take(pa.array(keep, pa.int64())).to_numpy(), (len(ids), len(keep)))
                score = np.round(probes @ (m / np.linalg.norm(m, axis=1, keepdims=True)).T, 9)
                score[row == ids[:, None]] = -np.inf
                better = np.flatnonzero((score >= best[:, -1:]).any(1)) if best.shape[1] == k else np.arange(len(ids))
                some_id, some = np.concatenate([best_id[better], row[better]], 1), np.concatenate([best[better], score[better]], 1)
                order = np.lexsort((some_id, -some), axis=1)[:, :k]
                if best.shape[1] < order.shape[1]:
                    best_id, best = np.zeros(order.shape, np.int64), np.zeros(order.shape)
                best_id[better], best[better] = np.take_along_axis(some_id, order, 1), np.take_along_axis(some, order, 1)
            keep = np.isfinite(best)
            yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(ids[:, None], best.shape)[keep]), pa.array(best_id[keep]), pa.array(best[keep])], ["query_id", "vec_id", "score"])

        return run

    def ask(rows):
        probes = np.array([r["embedding"] for r in rows], float)
        sent = spark.sparkContext.broadcast((np.array([r["query_id"] for r in rows], np.int64), probes / np.linalg.norm(probes, axis=1, keepdims=True)))
        hits = shared.written(vectors.select("vec_id", "embedding").mapInArrow(nearest(sent), "query_id long, vec_id long, score double"), "nearest")
        sent.destroy()
        return hits

    held: dict[int, list] = {}
    for r in queries.select("query_id", "embedding").toLocalIterator():
        if not _usable(r["embedding"], None):
            continue
        same = held.setdefault(len(r["embedding"]), [])
        same.append(r)
        if len(same) == block:
            part = ask(held.pop(len(r["embedding"])))
            out = part if out is None else out.unionByName(part)
    for same in held.values():
        part = ask(same)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "query_id long, vec_id long, score double, rank int")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)


def _evaluation(spark, sf_dir):
    """Every twentieth vector is a query; equal labels are what it should find, so that counts by label stand for the pairs."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 20 = 0")
    labels = vectors.select("vec_id", "label")
    found = search_all(vectors, asked.select(F.col("vec_id").alias("query_id"), "embedding"))
    mine = asked.select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted"))
    hit = found.join(labels, "vec_id").join(mine, "query_id").withColumn("hit", (F.col("label") == F.col("wanted")).cast("int"))
    total = mine.join(labels.groupBy(F.col("label").alias("wanted")).agg((F.count("*") - 1).alias("expected")), "wanted").where("expected > 0").select("query_id", "expected")
    return measured(hit, total)


@query("evaluation_queries", _EVAL + "SELECT query_id, round(p5, 6) AS p_5, round(p10, 6) AS p_10, round(h5 / expected, 6) AS r_5, round(h10 / expected, 6) AS r_10, round(coalesce(1.0 / first, 0), 6) AS rr FROM t JOIN m USING (query_id)")
def evaluation_queries(spark, sf_dir):
    """Vector search scored against equal labels, for every twentieth vector as a query."""
    return _evaluation(spark, sf_dir)


@query("evaluation_run", _EVAL + "SELECT count(*) AS queries, round(avg(round(p5, 6)), 6) AS p_5, round(avg(round(p10, 6)), 6) AS p_10, round(avg(round(coalesce(1.0 / first, 0), 6)), 6) AS mrr, round(avg((h10 > 0)::INT), 6) AS any_hit FROM t JOIN m USING (query_id)")
def evaluation_run(spark, sf_dir):
    """The means over the queries."""
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return _evaluation(spark, sf_dir).agg(F.count("*").alias("queries"), mean("p_5", "p_5"), mean("p_10", "p_10"), mean("rr", "mrr"), mean((F.col("p_10") > 0).cast("int"), "any_hit"))


_PHRASINGS = (("the", "der", "la"), ("the", "hest", "der"), ("anat", "le"))


def _bm25_of(k: int, terms: tuple[str, ...]) -> str:
    listed = "(" + ", ".join(f"'{t}'" for t in terms) + ")"
    part = "idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avgdl FROM stats)))"
    return f"SELECT {k} AS variant, doc_id, sum({part}) AS score FROM post JOIN idf USING (term) WHERE term IN {listed} GROUP BY doc_id HAVING sum({part}) > 0 ORDER BY round(sum({part}), 9) DESC, doc_id LIMIT 30"


@query("multi_query_merge", f"""WITH {_BM25.format(terms=_TERMS)}, v AS ({" UNION ALL ".join(f"(SELECT * FROM ({_bm25_of(k, t)}))" for k, t in enumerate(_PHRASINGS, 1))}), f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY variant) AS n FROM v)
SELECT doc_id, variant, round(score, 6) AS score FROM f WHERE n = 1 ORDER BY round(score, 9) DESC, doc_id LIMIT 10""")
def multi_query_merge(spark, sf_dir):
    """Results of several phrasings of a query: each document as the first of them found it, the best ten."""
    index, rows = index_of(spark, sf_dir), None
    for k, terms in enumerate(_PHRASINGS, 1):
        leg = index.search(terms, 40).orderBy(F.desc(F.round("score", 9)), "doc_id").limit(30).select(F.lit(k).alias("variant"), "doc_id", "score")
        rows = leg if rows is None else rows.unionByName(leg)
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("variant"))
    return rows.withColumn("n", first).where("n = 1").orderBy(F.desc(F.round("score", 9)), "doc_id").limit(10).select("doc_id", "variant", F.round("score", 6).alias("score"))


@query("chat_answer", f"WITH {_BM25.format(terms=_TERMS)}, top AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM lex QUALIFY rank <= 5) SELECT '{' '.join(QUERY_TERMS)}' AS answer, list(doc_id ORDER BY rank) AS sources FROM top")
def chat_answer(spark, sf_dir):
    """The answer of the offline generator to a question, from the five best hits."""
    from textloom.operators.fields import answered

    top = index_of(spark, sf_dir).search(QUERY_TERMS, 40).withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), "doc_id"))).where("rank <= 5")
    return answered(top.join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"), " ".join(QUERY_TERMS))


@query("answer_confidence", f"""WITH {_BM25.format(terms=_TERMS)}, top AS (SELECT doc_id, score / 10 AS score, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM lex QUALIFY rank <= 5), h AS (SELECT rank, score, text AS body FROM top JOIN documents USING (doc_id)),
o AS (SELECT least(avg(score) FILTER (rank <= 3 AND score > 0), 1.0) AS r, least(avg(CASE WHEN length(body) BETWEEN 100 AND 2000 THEN 0.4 ELSE 0.2 END + CASE WHEN contains(body, chr(10)) THEN 0.3 ELSE 0.0 END + 0.3), 1.0) AS q, ({" + ".join(f"max(contains(lower(body), '{t}')::INT)" for t in QUERY_TERMS if len(t) > 3)}) / {sum(len(t) > 3 for t in QUERY_TERMS)}.0 AS c FROM h)
SELECT 1 AS query_id, round(r, 6) AS relevance, round(c, 6) AS coverage, round(q, 6) AS quality, round(0.5 * r + 0.3 * c + 0.2 * q, 6) AS confidence, CASE WHEN round(0.5 * r + 0.3 * c + 0.2 * q, 9) < 0.3 THEN 'refuse' WHEN round(0.5 * r + 0.3 * c + 0.2 * q, 9) < 0.4 THEN 'clarify' WHEN round(0.5 * r + 0.3 * c + 0.2 * q, 9) < 0.6 THEN 'partial' ELSE 'answer' END AS decision FROM o""")
def answer_confidence(spark, sf_dir):
    """How far the five best hits answer a question: their scores, the question's longer words that they hold, and their form."""
    from textloom.operators.documents import confidence

    top = index_of(spark, sf_dir).search(QUERY_TERMS, 40).withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), "doc_id"))).where("rank <= 5")
    hits = top.join(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body")), "doc_id").select(F.lit(1).alias("query_id"), "doc_id", "body", (F.col("score") / 10).alias("score"))
    return confidence(hits, [t for t in QUERY_TERMS if len(t) > 3])
