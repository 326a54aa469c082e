"""Retrieval and answering for tables of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions.text import is_blank
from citeloom.operators import answers, bm25, context, fusion, metrics
from citeloom.operators.chunking import chunk_documents
from citeloom.operators.joins import with_content
from citeloom.plans.models import Embedder, Reranker
from citeloom.plans.prompts import ANSWER_SCHEMA, ANSWER_SYSTEM
from citeloom.providers import TextModel, complete
from citeloom.settings import POOL, RETRIEVAL_MODES, RRF_CONSTANT, TOP_K
from citeloom.sources.documents import load_documents
from citeloom.sources.keyword_index import KeywordIndex
from citeloom.sources.scratch import staged
from citeloom.sources.store import CellStore, TableStore

STORES = ("table", "cells")


class AnswerError(RuntimeError):
    """A model response is not a usable answer."""


class Retriever:
    """Both retrieval paths over one chunk table, and their fusion.

    store: anything with ``search(questions, k)`` and ``chunks()``. keywords: a ``Bm25Index`` or a
    stored ``KeywordIndex``. embedder: anything with ``questions(questions)``.
    """

    def __init__(
        self,
        store,
        keywords,
        embedder,
        top_k: int = TOP_K,
        pool: int = POOL,
        constant: int = RRF_CONSTANT,
        reranker: Reranker | None = None,
    ):
        self.store, self.keywords, self.embedder = store, keywords, embedder
        self.top_k, self.pool, self.constant, self.reranker = top_k, pool, constant, reranker

    def chunks(self) -> DataFrame:
        return self.store.chunks()

    def retrieve(self, questions: DataFrame, k: int | None = None, mode: str = "hybrid") -> DataFrame:
        """questions(query_id, question) to the k best chunks of each, with evidence and content."""
        if mode not in RETRIEVAL_MODES:
            raise ValueError(f"unknown retrieval mode {mode!r}; expected one of {RETRIEVAL_MODES}")
        k = self.top_k if k is None else k
        vector = self._vector(questions) if mode != "keyword" else None
        keyword = self._keyword(questions) if mode != "vector" else None
        if self.reranker is None or k <= 0:
            return self._with_content(fusion.fuse(vector, keyword, max(k, 0), self.constant))
        shortlist = self._with_content(fusion.fuse(vector, keyword, self.pool, self.constant))
        return self.reranker.rerank(staged(shortlist, "shortlist"), questions, k)

    def retrieve_modes(self, questions: DataFrame, k: int | None = None) -> DataFrame:
        """The lists of all three modes at once; each path runs once."""
        fused = fusion.fuse_modes(
            self._vector(questions), self._keyword(questions), self.top_k if k is None else k, self.constant
        )
        return self._with_content(fused)

    def _vector(self, questions: DataFrame) -> DataFrame:
        return self.store.search(self.embedder.questions(questions), self.pool)

    def _keyword(self, questions: DataFrame) -> DataFrame:
        if isinstance(self.keywords, bm25.Bm25Index):
            return bm25.search(self.keywords, questions, self.pool)
        return self.keywords.search(questions, self.pool)

    def _with_content(self, hits: DataFrame) -> DataFrame:
        """Texts are joined last, so they never travel through the ranking."""
        return with_content(self.chunks(), hits)


class Answerer:
    """Retrieve, prompt, generate, validate."""

    def __init__(self, retriever: Retriever, model: str, answer: TextModel):
        self.retriever, self.model, self._answer = retriever, model, answer

    def answer(self, questions: DataFrame, k: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(validated answers, retrieved chunks). Unusable responses raise AnswerError."""
        if not questions.where(is_blank(F.col("question"))).isEmpty():
            raise ValueError("a question is empty")
        hits = staged(self.retriever.retrieve(questions, k), "hits")
        responses = staged(complete(context.answer_prompts(questions, hits), self._answer, ANSWER_SYSTEM, ANSWER_SCHEMA), "responses")
        given = hits.groupBy("query_id").agg(F.count("*").cast("int").alias("passages"))
        checked = answers.validate(
            responses.join(given, "query_id", "left").fillna(0, ["passages"])
        )
        failed = checked.where(F.col("error").isNotNull()).first()
        if failed is not None:
            raise AnswerError(f"{self.model} gave an unusable response to {failed['query_id']}: {failed['error']}")
        return checked, hits


def build_retriever(
    spark: SparkSession,
    documents: str,
    embedder: Embedder,
    store: str = "table",
    store_path: str | None = None,
    top_k: int = TOP_K,
    reranker: Reranker | None = None,
) -> Retriever:
    """Load, chunk, embed and index a folder of documents."""
    if store not in STORES:
        raise ValueError(f"unknown store {store!r}; expected one of {STORES}")
    if store == "cells" and store_path is None:
        raise ValueError("a cell store needs a path")
    chunks = staged(chunk_documents(load_documents(spark, documents)), "chunks")
    vectors = embedder.documents(chunks)
    target = TableStore() if store == "table" else CellStore(spark, store_path)
    target.add(chunks, vectors)
    return Retriever(target, bm25.build(chunks, keep_tokens=True), embedder, top_k=top_k, reranker=reranker)


def open_retriever(
    spark: SparkSession, index: str, embedder: Embedder, store: str = "table", top_k: int = TOP_K, reranker: Reranker | None = None
) -> Retriever:
    """A retriever over what is stored under ``index`` (folders ``<store>`` and ``keywords``); nothing is read but by searches.

    FileNotFoundError where a part of it is not stored.
    """
    if store not in STORES:
        raise ValueError(f"unknown store {store!r}; expected one of {STORES}")
    path = f"{index}/{store}"
    target = TableStore.load(spark, path) if store == "table" else CellStore.load(spark, path)
    return Retriever(target, KeywordIndex.load(spark, f"{index}/keywords"), embedder, top_k=top_k, reranker=reranker)


def evaluate_retrieval(retriever: Retriever, questions: DataFrame, k: int, mode: str = "hybrid") -> DataFrame:
    asked = questions.where(metrics.is_answerable(F.col("type")))
    return metrics.retrieval_results(retriever.retrieve(asked, k, mode), questions)


def evaluate_modes(retriever: Retriever, questions: DataFrame, k: int) -> DataFrame:
    """Results of all three modes, with a ``mode`` column."""
    asked = questions.where(metrics.is_answerable(F.col("type")))
    return metrics.retrieval_results(retriever.retrieve_modes(asked, k), questions, RETRIEVAL_MODES)


def evaluate_answers(answerer: Answerer, questions: DataFrame, k: int) -> DataFrame:
    checked, _ = answerer.answer(questions, k)
    return metrics.answer_results(checked, questions)
