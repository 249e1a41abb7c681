"""Retrieval of a stated query set against a whole corpus: dense, filtered, BM25, fused, reranked, multi-query.

The query set goes to the tasks in blocks of bounded size; slices of the corpus are scored against a block with one matrix
product, and a task keeps only the ``k`` best rows of each query. What is shuffled is therefore k rows a query and task,
not queries times rows. Scores are rounded to six places and ties go to the smaller id.

A corpus is embedded and tokenised once, by :func:`index_texts`, whose table every block of queries and every variant
reads; :func:`retrieve` picks a variant by its name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skarn.functions.text import CAMEL_PIECE, TOKEN, subqueries
from skarn.plans.plugins import EMBEDDERS, RERANKERS, plugin
from skarn.plans.shared import materialize
from skarn.plans.spread import spread

QUERY_BLOCK = 1_000
#: Documents scored against a block of queries at once, so a task holds blocks times slices of numbers at most.
SLICE = 256
RRF = 60
POOL = 30
K1, B, EPSILON = 1.5, 0.75, 0.25
_TOKEN, _PIECE = re.compile(TOKEN), re.compile(CAMEL_PIECE)


def tokenise(text: str | None) -> list[str]:
    out = []
    for part in _TOKEN.findall(text or ""):
        out.append(part.lower())
        out += [p.lower() for p in _PIECE.findall(part) if len(p) > 1]
    return out


def _blocks(queries: DataFrame, columns: list[str], size: int = QUERY_BLOCK) -> Iterator[pd.DataFrame]:
    """The query set in blocks of at most ``size`` rows, ordered by query_id, read one after another."""
    rows: list[tuple] = []
    for row in queries.select(*columns).orderBy("query_id").toLocalIterator():
        rows.append(tuple(row))
        if len(rows) == size:
            yield pd.DataFrame(rows, columns=columns)
            rows = []
    if rows:
        yield pd.DataFrame(rows, columns=columns)


class Best:
    """The k best documents of each query among all that a task has seen; scores rounded, ties to the smaller id."""

    def __init__(self, query_ids: np.ndarray, k: int):
        self.query_ids, self.k = query_ids, k
        self.scores, self.docs = np.empty((len(query_ids), 0)), np.empty((len(query_ids), 0), dtype=np.int64)

    def add(self, doc_ids: np.ndarray, scores: np.ndarray, allowed: np.ndarray | None = None) -> None:
        """``scores`` is queries by documents; documents that are not ``allowed`` for a query are left out."""
        scores = np.round(scores, 6)
        if allowed is not None:
            scores = np.where(allowed, scores, -np.inf)
        scores = np.concatenate([self.scores, scores], axis=1)
        docs = np.concatenate([self.docs, np.broadcast_to(doc_ids, (len(self.query_ids), len(doc_ids)))], axis=1)
        order = np.lexsort((docs, -scores), axis=1)[:, : self.k]
        self.scores, self.docs = np.take_along_axis(scores, order, 1), np.take_along_axis(docs, order, 1)

    def frame(self) -> pd.DataFrame:
        rows = np.repeat(np.arange(len(self.query_ids)), self.scores.shape[1])
        out = pd.DataFrame({"query_id": self.query_ids[rows], "doc_id": self.docs.ravel(), "score": self.scores.ravel()})
        return out[np.isfinite(out["score"])]


def _slices(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for at in range(0, len(pdf), size):
            yield pdf.iloc[at : at + size]


def _ranked(partial: DataFrame | None, k: int, corpus: DataFrame) -> DataFrame:
    if partial is None:
        partial = corpus.sparkSession.createDataFrame([], "query_id long, doc_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search(queries: DataFrame, columns: list[str], corpus: DataFrame, scan: Callable[[pd.DataFrame], Callable], k: int) -> DataFrame:
    partial, corpus = None, spread(corpus)
    for block in _blocks(queries, columns):
        found = corpus.mapInPandas(scan(block), "query_id long, doc_id long, score double")
        partial = found if partial is None else partial.unionByName(found)
    return _ranked(partial, k, corpus)


def dense_topk(queries: DataFrame, corpus: DataFrame, k: int = 5, with_filter: bool = False, exclude_self: bool = True) -> DataFrame:
    """(query_id, vector[, module]) against (doc_id, vector[, module]): (query_id, doc_id, score, rank), score = cosine."""
    columns = ["query_id", "vector"] + ["module"] * with_filter

    def scan(block: pd.DataFrame):
        q = np.array(block["vector"].tolist(), dtype=np.float64)
        q /= np.maximum(np.sqrt((q**2).sum(axis=1, keepdims=True)), 1e-300)
        ids, modules = block["query_id"].to_numpy(), block["module"].to_numpy() if with_filter else None

        def run(batches):
            found = Best(ids, k)
            for pdf in _slices(batches, SLICE):
                v = np.array(pdf["vector"].tolist(), dtype=np.float64)
                v /= np.maximum(np.sqrt((v**2).sum(axis=1, keepdims=True)), 1e-300)
                docs = pdf["doc_id"].to_numpy()
                allowed = ids[:, None] != docs[None, :] if exclude_self else np.ones((len(ids), len(docs)), dtype=bool)
                if with_filter:
                    allowed = allowed & (modules[:, None] == pdf["module"].to_numpy()[None, :])
                found.add(docs, q @ v.T, allowed)
            yield found.frame()

        return run

    return _search(queries, columns, corpus.select("doc_id", "vector", *["module"] * with_filter), scan, k)


INDEX = "doc_id long, text string, vector array<double>, terms array<string>, counts array<int>, n_terms int"


def index_texts(corpus: DataFrame, embedder: str = "hash") -> DataFrame:
    """(doc_id, text) -> the index: vector by the embedder, distinct terms with their counts, number of terms.

    One pass over the texts, written once; everything else reads this table.
    """

    def run(batches):
        model = plugin(EMBEDDERS, embedder)
        for pdf in batches:
            counted = [Counter(tokenise(t)) for t in pdf["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": pdf["doc_id"],
                    "text": pdf["text"],
                    "vector": list(model.embed(pdf["text"].tolist())),
                    "terms": [list(c) for c in counted],
                    "counts": [list(c.values()) for c in counted],
                    "n_terms": [sum(c.values()) for c in counted],
                }
            )

    return materialize(spread(corpus.select("doc_id", "text")).mapInPandas(run, INDEX), "index")


def _indexed(corpus: DataFrame, embedder: str = "hash") -> DataFrame:
    return corpus if "vector" in corpus.columns else index_texts(corpus, embedder)


def text_topk(queries: DataFrame, corpus: DataFrame, k: int = 5, embedder: str = "hash") -> DataFrame:
    """Dense top-k of texts: both sides go through an embedder plug-in, the corpus once."""

    def scan(block: pd.DataFrame):
        q = plugin(EMBEDDERS, embedder).embed(block["question"].tolist())

        def run(batches):
            found = Best(block["query_id"].to_numpy(), k)
            for pdf in _slices(batches, SLICE):
                found.add(pdf["doc_id"].to_numpy(), q @ np.array(pdf["vector"].tolist()).T)
            yield found.frame()

        return run

    return _search(queries, ["query_id", "question"], _indexed(corpus, embedder).select("doc_id", "vector"), scan, k)


def bm25_topk(queries: DataFrame, corpus: DataFrame, k: int = 5) -> DataFrame:
    """BM25 with k1 1.5, b 0.75; negative idf becomes 0.25 of the mean idf over all terms. Documents that share no term
    with the query score 0 and follow by id. Corpus statistics cover every document; a block of queries fetches the
    weights of its own terms only."""
    index = _indexed(corpus)
    size = index.agg(F.count("*").alias("rows"), F.avg("n_terms").alias("mean")).first()
    rows, mean = float(size.rows), float(size.mean or 1.0) or 1.0
    df = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = materialize(df.select("term", (F.log(F.lit(rows) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf")), "bm25-idf")
    floor = EPSILON * (idf.agg(F.avg("idf")).first()[0] or 0.0)

    def scan(block: pd.DataFrame):
        own = [Counter(tokenise(q)) for q in block["question"]]
        asked = index.sparkSession.createDataFrame([(t,) for t in sorted(set().union(*own))], "term string")
        weights = {r.term: r.idf if r.idf >= 0 else floor for r in idf.join(F.broadcast(asked), "term").collect()}  # terms of one block
        terms = {t: i for i, t in enumerate(sorted(weights))}
        q = np.zeros((len(block), max(1, len(terms))))
        for n, counts in enumerate(own):
            for t, c in counts.items():
                if t in terms:
                    q[n, terms[t]] = c * weights[t]
        ids = block["query_id"].to_numpy()

        def run(batches):
            found = Best(ids, k)
            for pdf in _slices(batches, SLICE):
                d = np.zeros((len(pdf), q.shape[1]))
                for n, (held, counts, size) in enumerate(zip(pdf["terms"], pdf["counts"], pdf["n_terms"], strict=True)):
                    share = K1 * (1 - B + B * size / mean)
                    for t, c in zip(held, counts, strict=True):
                        if (at := terms.get(t)) is not None:
                            d[n, at] = c * (K1 + 1) / (c + share)
                found.add(pdf["doc_id"].to_numpy(), q @ d.T)
            yield found.frame()

        return run

    return _search(queries, ["query_id", "question"], index.select("doc_id", "terms", "counts", "n_terms"), scan, k)


def with_text(hits: DataFrame, corpus: DataFrame) -> DataFrame:
    return hits.join(corpus.select("doc_id", "text"), "doc_id")


def hybrid_rrf(pools: list[DataFrame], corpus: DataFrame, k: int = 5) -> DataFrame:
    """Reciprocal rank fusion of ranked pools, keyed by text: equal texts merge, also within one pool."""
    union = pools[0].select("query_id", "doc_id", "rank")
    for pool in pools[1:]:
        union = union.unionByName(pool.select("query_id", "doc_id", "rank"))
    fused = (
        with_text(union, corpus)
        .groupBy("query_id", F.md5("text").alias("text_key"))
        .agg(F.sum(F.lit(1.0) / (F.lit(RRF) + F.col("rank"))).alias("s"), F.min("doc_id").alias("doc_id"))
        .select("query_id", "doc_id", F.round("s", 6).alias("score"))
    )
    return _ranked(fused, k, corpus)


def rerank(queries: DataFrame, pool: DataFrame, corpus: DataFrame, k: int = 5, reranker: str = "overlap") -> DataFrame:
    """The k best of a ranked pool by a reranker plug-in; equal scores keep the pool's order."""

    def run(batches):
        model = plugin(RERANKERS, reranker)
        for pdf in batches:
            scores = np.zeros(len(pdf))
            for question, rows in pdf.groupby("question", sort=False).indices.items():  # one call a question
                scores[rows] = model.score(question, pdf["text"].iloc[rows].tolist())
            yield pd.DataFrame({"query_id": pdf["query_id"], "doc_id": pdf["doc_id"], "pool_rank": pdf["rank"], "score": np.round(scores, 6)})

    rows = with_text(pool.select("query_id", "doc_id", "rank"), corpus).join(queries.select("query_id", "question"), "query_id")
    scored = rows.mapInPandas(run, "query_id long, doc_id long, pool_rank int, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "pool_rank")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def multiquery_topk(
    queries: DataFrame, corpus: DataFrame, k: int = 5, distinct: bool = False, embedder: str = "hash", base: Callable[[DataFrame, DataFrame, int], DataFrame] | None = None
) -> DataFrame:
    """The question and its parts, each with its share of k; union in order, first occurrence of a text wins, cut to k.

    ``base`` is the variant that answers each part, dense by default.
    """
    parts = queries.select("query_id", subqueries(F.col("question"), distinct=distinct).alias("subs"))
    share = F.greatest(F.lit(2), F.floor(F.lit(k) / F.greatest(F.lit(1), F.size("subs"))).cast("int"))
    each = parts.select("query_id", F.posexplode("subs").alias("sub", "question"), share.alias("share"))
    numbered = each.select((F.col("query_id") * 8 + F.col("sub")).alias("sub_id"), "query_id", "sub", "share", "question")
    search = base or (lambda q, c, n: text_topk(q, c, n, embedder))
    hits = search(numbered.select(F.col("sub_id").alias("query_id"), "question"), corpus, k)
    owned = hits.withColumnRenamed("query_id", "sub_id").join(numbered.select("sub_id", "query_id", "sub", "share"), "sub_id").where("rank <= share")
    first = with_text(owned, corpus).groupBy("query_id", F.md5("text").alias("text_key")).agg(
        F.min(F.struct("sub", "rank", "doc_id", "score")).alias("f")
    )
    order = Window.partitionBy("query_id").orderBy("f.sub", "f.rank")
    ranked = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "f.doc_id", "f.score", "rank")


def hybrid_topk(queries: DataFrame, corpus: DataFrame, k: int = 5) -> DataFrame:
    """Dense and BM25 pools, fused."""
    index = _indexed(corpus)
    pools = [materialize(search(queries, index, POOL), "pool") for search in (text_topk, bm25_topk)]
    return hybrid_rrf(pools, index, k)


def rerank_topk(queries: DataFrame, corpus: DataFrame, k: int = 5, base: Callable[[DataFrame, DataFrame, int], DataFrame] = text_topk) -> DataFrame:
    """The pool of a base variant, reranked."""
    index = _indexed(corpus)
    return rerank(queries, materialize(base(queries, index, POOL), "pool"), index, k)


#: Retrieval variants by name.
VARIANTS: dict[str, Callable[[DataFrame, DataFrame, int], DataFrame]] = {
    "dense": text_topk,
    "bm25": bm25_topk,
    "hybrid": hybrid_topk,
    "rerank": rerank_topk,
    "hybrid_rerank": lambda q, c, k: rerank_topk(q, c, k, hybrid_topk),
    "multiquery": multiquery_topk,
    "hybrid_multiquery": lambda q, c, k: multiquery_topk(q, c, k, base=hybrid_topk),
}


def retrieve(variant: str, queries: DataFrame, corpus: DataFrame, k: int = 5) -> DataFrame:
    """Top-k by the named variant; an unknown name is an error."""
    if variant not in VARIANTS:
        raise KeyError(f"unknown retrieval variant {variant!r}; known: {', '.join(VARIANTS)}")
    return VARIANTS[variant](queries, corpus, k)


def retrieval_metrics(variants: dict[str, DataFrame], gold: DataFrame, corpus: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """Per variant and k: micro path recall, share of complete tasks, mean word coverage, recall of orchestration tasks.

    ``gold``: (query_id, category, gold_paths, gold_words). Each variant is ranked once at the largest k.
    """
    from skarn.functions import paths, text

    union = None
    for name, hits in variants.items():
        rows = hits.select(F.lit(name).alias("variant"), "query_id", "doc_id", "rank")
        union = rows if union is None else union.unionByName(rows)
    each_k = F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")
    context = (
        with_text(union, corpus)
        .select("variant", "query_id", "rank", "text", each_k)
        .where("rank <= k")
        .groupBy("variant", "k", "query_id")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda s: s["text"]), "\n").alias("context"))
    )
    found = F.size(F.array_intersect("gold_paths", paths.versioned(F.col("context"))))
    scored = gold.join(context, "query_id").select(
        "variant", "k", "category", found.alias("found"), F.size("gold_paths").alias("gold"), text.coverage(F.col("gold_words"), F.col("context")).alias("cover")
    )
    recall: Column = F.try_divide(F.sum("found").cast("double"), F.sum("gold"))
    orchestration = F.col("category") == "api_orchestration"
    return scored.groupBy("variant", "k").agg(
        F.round(100 * recall, 6).alias("path_recall"),
        F.round(100 * F.avg(F.when(F.col("gold") > 0, (F.col("found") == F.col("gold")).cast("double"))), 6).alias("complete_pct"),
        F.round(100 * F.avg("cover"), 6).alias("content_cov"),
        F.round(
            100 * F.try_divide(F.sum(F.when(orchestration, F.col("found"))).cast("double"), F.sum(F.when(orchestration, F.col("gold")))), 6
        ).alias("orch_recall"),
        F.count_if(F.col("gold") > 0).alias("n_with_paths"),
    )
