"""Embedding and reranking with their caches: what is stored is used, what is missing is computed
where a model is plugged in, and is an error where none is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from citeloom.operators import context, embedding, rerank
from citeloom.plans.prompts import DEFAULT_RERANK_PROMPT, RERANK_PROMPTS, RERANK_SCHEMA
from citeloom.providers import TextModel, complete
from citeloom.settings import DOCUMENT_TASK, EMBED_BATCH, EMBEDDING_DIM, QUERY_TASK, TOP_K
from citeloom.sources import caches
from citeloom.sources.scratch import staged


class EmbeddingCacheMiss(RuntimeError):
    """A text has no stored vector and no model is plugged in."""


class RerankCacheMiss(RuntimeError):
    """A question has no stored ordering and no model is plugged in."""


class Embedder:
    """Vectors for tables of texts, by way of a cache table at ``cache``."""

    def __init__(
        self,
        spark: SparkSession,
        model: str,
        cache: str,
        embed: embedding.EmbedBatch | None = None,
        dim: int = EMBEDDING_DIM,
    ):
        self.spark, self.model, self.cache, self.embed, self.dim = spark, model, cache, embed, dim
        self.cache_hits = 0
        self.api_calls = 0

    def documents(self, texts: DataFrame, key: str = "chunk_id", text: str = "index_text") -> DataFrame:
        return self._vectors(texts, key, text, DOCUMENT_TASK)

    def questions(self, texts: DataFrame, key: str = "query_id", text: str = "question") -> DataFrame:
        return self._vectors(texts, key, text, QUERY_TASK)

    def _vectors(self, texts: DataFrame, key: str, text: str, task: str) -> DataFrame:
        wanted = embedding.keyed(texts.select(F.col(key), F.col(text).alias("text")), self.model, task)
        stored = caches.read_vectors(self.spark, self.cache)
        counts = embedding.cache_report(wanted, stored, self.dim).first()
        self.cache_hits += counts["cache_hits"]
        if counts["cache_misses"]:
            if self.embed is None:
                raise EmbeddingCacheMiss(
                    f"{counts['cache_misses']} of {counts['texts']} texts are not in {self.cache} "
                    f"(task {task}) and no model is plugged in; index them with one first"
                )
            missing = embedding.misses(wanted, stored, self.dim)
            calls = Observation("embedding calls")
            fresh = staged(embedding.embed_missing(missing, self.embed, task, EMBED_BATCH, calls), "vectors")
            self.api_calls += calls.get["calls"] or 0
            caches.append_vectors(fresh, self.cache)
            stored = caches.read_vectors(self.spark, self.cache)
        return embedding.require_cached(embedding.with_cached(wanted, stored, self.dim)).select(key, "vector")


class Reranker:
    """Orderings for candidate lists, by way of a cache table at ``cache`` and of given JSON files."""

    def __init__(
        self,
        spark: SparkSession,
        model: str,
        cache: str,
        answer: TextModel | None = None,
        prompt: str = DEFAULT_RERANK_PROMPT,
        prompts: dict[str, str] = RERANK_PROMPTS,
        files: str | None = None,
    ):
        if prompt not in prompts:
            raise ValueError(f"unknown reranker prompt {prompt!r}; expected one of {list(prompts)}")
        self.spark, self.model, self.cache, self.answer = spark, model, cache, answer
        self.prompt_name, self.prompt = prompt, prompts[prompt]
        self.files = files
        self.cache_hits = 0
        self.api_calls = 0

    def _stored(self) -> DataFrame:
        """The cache table, and orderings in ``files`` (a folder of JSON files) that it lacks."""
        table = caches.read_ordering_table(self.spark, self.cache)
        if self.files is None:
            return table
        more = caches.read_orderings(self.spark, self.files).join(table.select("key"), "key", "left_anti")
        return table.unionByName(more)

    def rerank(self, candidates: DataFrame, questions: DataFrame, k: int = TOP_K) -> DataFrame:
        """candidates(query_id, rank, chunk_id, doc_title, section, text, ...) reordered, k kept."""
        if k <= 0:
            return candidates.limit(0)
        wanted = rerank.requests(candidates, questions, self.model, self.prompt)
        stored = self._stored()
        missing = staged(rerank.missing_orderings(wanted, stored), "requests")
        total, absent = wanted.where(F.size("candidates") > 1).count(), missing.count()
        self.cache_hits += total - absent
        if absent:
            if self.answer is None:
                raise RerankCacheMiss(
                    f"{absent} questions have no stored ordering in {self.cache} and no model is plugged in"
                )
            asked = candidates.join(missing.select("query_id"), "query_id", "left_semi")
            prompts = context.rerank_prompts(missing.select("query_id", "question"), asked)
            responses = missing.join(complete(prompts, self.answer, self.prompt, RERANK_SCHEMA), "query_id")
            orders = rerank.orderings_of_responses(responses)
            rows = missing.join(orders, "key").select(
                "key", F.lit(self.model).alias("model"), F.lit(self.prompt_name).alias("prompt"),
                "question", "candidates", "order",
            )
            caches.append_orderings(staged(rows, "orderings"), self.cache)
            self.api_calls += absent
            stored = self._stored()
        return rerank.rerank(candidates, questions, stored, self.model, self.prompt, k)
