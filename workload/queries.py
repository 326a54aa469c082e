"""One registered query per operator. Each takes (spark, folder) and returns a DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.deploy import ship
from citeloom.functions import payload, text, vectors
from citeloom.operators import answers, blockmax, bm25, chunking, context, embedding, fusion, knn, metrics, rerank
from citeloom.operators.topk import rounded
from citeloom.settings import DOCUMENT_TASK, MAX_RETRY_WAIT, RETRIEVAL_MODES, TOP_K
from citeloom.sources import golden as golden_source
from citeloom.sources import coded_store, keyword_index, store
from citeloom.sources import payload as payload_table
from citeloom.sources.documents import structured
from citeloom.sources.scratch import shared_folder, staged
from citeloom.sources.tables import read_table
from workload import inputs

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(function: Query) -> Query:
    @wraps(function)
    def shipped(spark: SparkSession, folder: str) -> DataFrame:
        ship(spark)
        return function(spark, folder)

    REGISTRY[function.__name__] = shipped
    return shipped


# --- text functions ----------------------------------------------------------------------------


@query
def tokenize_terms(spark, folder):
    tokens = inputs.documents(spark, folder, "text").select(F.explode(text.tokenize(F.col("text"))).alias("term"))
    return tokens.groupBy("term").agg(F.count("*").alias("n"))


@query
def compound_tokens(spark, folder):
    tokens = inputs.documents(spark, folder, "doc_id", "text").select(
        "doc_id", F.explode(text.tokenize(F.col("text"))).alias("token")
    )
    return tokens.where(F.rlike("token", F.lit("[-./]"))).groupBy("doc_id", "token").agg(F.count("*").alias("n"))


@query
def sentence_stats(spark, folder):
    split = inputs.documents(spark, folder, "doc_id", "text").select(
        "doc_id", text.sentences(F.col("text")).alias("s")
    )
    return split.select(
        "doc_id",
        F.size("s").alias("sentences"),
        F.array_max(F.transform("s", F.length)).alias("longest"),
        F.md5(F.array_join("s", "|")).alias("digest"),
    )


@query
def normalise_text(spark, folder):
    files = structured(inputs.notes_raw(spark, folder))
    return files.select("doc_id", "title", "source_path", "fmt", F.md5("text").alias("digest"))


@query
def document_titles(spark, folder):
    files = structured(inputs.orders_raw(spark, folder))
    return files.select("doc_id", "title", "fmt", F.length("text").alias("chars"))


@query
def flatten_preview(spark, folder):
    return inputs.documents(spark, folder, "doc_id", "text").select(
        "doc_id",
        text.preview(F.col("text")).alias("preview"),
        F.md5(text.flatten_space(F.col("text"))).alias("digest"),
    )


@query
def code_phrasing(spark, folder):
    files = inputs.orders_raw(spark, folder)
    return files.select("source_path", text.is_code_phrased(F.col("raw")).alias("code"))


@query
def short_ids(spark, folder):
    names = read_table(spark, folder, "supplier").select(
        F.concat(
            F.when(F.col("s_nationkey") % 3 == 0, "onboarding_supplier_")
            .when(F.col("s_nationkey") % 3 == 1, "internal_faq_procurement_")
            .otherwise("supplier_framework_agreement_"),
            F.col("s_suppkey"),
        ).alias("doc_id")
    )
    return names.select("doc_id", text.short_id(F.col("doc_id")).alias("short"))


@query
def retry_policy(spark, folder):
    return inputs.error_messages(spark, folder).select(
        "event_id",
        text.is_retryable(F.col("message")).alias("retryable"),
        text.retry_delay(F.col("message"), MAX_RETRY_WAIT).alias("delay"),
    )


# --- chunking ----------------------------------------------------------------------------------


@query
def section_split(spark, folder):
    both = structured(inputs.notes_raw(spark, folder)).unionByName(structured(inputs.orders_raw(spark, folder)))
    parts = both.select("doc_id", F.posexplode(chunking.sections(F.col("text"), F.col("fmt"))).alias("n", "s"))
    return parts.select("doc_id", "n", F.col("s.heading").alias("heading"), F.md5("s.body").alias("digest"))


@query
def table_lines(spark, folder):
    lines = structured(inputs.orders_raw(spark, folder)).select(
        "doc_id", F.explode(F.split("text", "\n")).alias("line")
    )
    return lines.groupBy("doc_id").agg(
        F.count("*").alias("lines"), F.count_if(chunking.is_table_line(F.col("line"))).alias("table_lines")
    )


@query
def block_split(spark, folder):
    files = structured(inputs.orders_raw(spark, folder))
    found = files.select("doc_id", F.posexplode(chunking.blocks(F.col("text"))).alias("n", "b"))
    return found.select("doc_id", "n", F.col("b.atomic").alias("atomic"), F.md5("b.text").alias("digest"))


@query
def sentence_fit(spark, folder):
    found = inputs.documents(spark, folder, "doc_id", "text").select(
        "doc_id", F.posexplode(chunking.fit(F.col("text"))).alias("n", "piece")
    )
    return found.select("doc_id", "n", F.length("piece").alias("chars"), F.md5("piece").alias("digest"))


def _chunk_rows(chunks: DataFrame) -> DataFrame:
    return chunks.select(
        "chunk_id",
        "doc_id",
        "section",
        "ordinal",
        F.length("text").alias("chars"),
        F.md5("text").alias("text_digest"),
        F.md5("index_text").alias("index_digest"),
        chunking.citation_label(F.col("doc_title"), F.col("section")).alias("label"),
    )


@query
def chunk_notes(spark, folder):
    return _chunk_rows(inputs.note_chunks(spark, folder))


@query
def chunk_orders(spark, folder):
    return _chunk_rows(inputs.order_chunks(spark, folder))


@query
def chunk_plain(spark, folder):
    return _chunk_rows(inputs.plain_chunks(spark, folder))


@query
def chunk_size_report(spark, folder):
    return chunking.chunk_size_report(inputs.note_chunks(spark, folder))


# --- keyword search ----------------------------------------------------------------------------


@query
def bm25_terms(spark, folder):
    index = bm25.build(inputs.documents(spark, folder, "doc_id", "text"), "doc_id", "text")
    return bm25.term_table(index).select("term", "df", F.round("idf", 8).alias("idf"))


@query
def bm25_topk(spark, folder):
    return inputs.keyword_hits(spark, folder)


@query
def bm25_postings(spark, folder):
    """The same lists from each chunk's postings."""
    index = bm25.build(inputs.documents(spark, folder, "doc_id", "text"), "doc_id", "text")
    counted = bm25.Bm25Index(bm25.postings(index.chunks), index.terms, index.stats)
    return bm25.search(counted, inputs.questions(spark, folder), 20)


@query
def bm25_stored(spark, folder):
    """The same lists from an index that was written and read again."""
    path = f"{shared_folder(spark)}/keyword-index-{uuid.uuid4().hex}"
    keyword_index.write(bm25.build(inputs.documents(spark, folder, "doc_id", "text"), "doc_id", "text"), path)
    return keyword_index.KeywordIndex.load(spark, path).search(inputs.questions(spark, folder), 20)


@query
def bm25_pruned(spark, folder):
    """The same lists from stored blocks, of which only those that can reach a list are scored."""
    path = f"{shared_folder(spark)}/block-index-{uuid.uuid4().hex}"
    blockmax.write(bm25.build(inputs.documents(spark, folder, "doc_id", "text"), "doc_id", "text"), path)
    return blockmax.search(blockmax.load(spark, path), inputs.questions(spark, folder), 20)[0]


@query
def bm25_grid(spark, folder):
    """The same lists with questions in blocks, as where they are too many to be sent at once."""
    index = bm25.build(inputs.documents(spark, folder, "doc_id", "text"), "doc_id", "text")
    return bm25.search(index, inputs.questions(spark, folder), 20, max_weights=1_000)


@query
def bm25_chunks(spark, folder):
    """Chunk, index and search in one go."""
    index = bm25.build(inputs.plain_chunks(spark, folder).select("chunk_id", "index_text"), keep_tokens=True)
    return bm25.search(index, inputs.questions(spark, folder), 20)


# --- vector search -----------------------------------------------------------------------------


@query
def vector_norms(spark, folder):
    return inputs.vectors(spark, folder).select(
        "chunk_id",
        F.round(vectors.norm(F.col("vector")), 6).alias("norm"),
        vectors.is_unit(F.col("vector")).alias("unit"),
        vectors.is_unit(F.transform("vector", lambda x: x * 2)).alias("doubled_unit"),
        F.round(vectors.unit(F.transform("vector", lambda x: x * 4))[0].cast("double"), 7).alias("first"),
        F.round(vectors.similarity_of_distance(1 - vectors.dot(F.col("vector"), F.reverse("vector"))), 6).alias(
            "mirrored"
        ),
    )


@query
def vector_topk(spark, folder):
    return inputs.vector_hits(spark, folder)


@query
def vector_neighbours(spark, folder):
    """Every stored vector as a question."""
    stored = inputs.vectors(spark, folder)
    return knn.exact_topk(stored, stored.withColumnRenamed("chunk_id", "query_id"), 10)


@query
def vector_neighbours_grid(spark, folder):
    """The same lists with questions in blocks, as where they are too many to be sent at once."""
    stored = inputs.vectors(spark, folder)
    asked = stored.withColumnRenamed("chunk_id", "query_id")
    return knn.exact_topk(stored, asked, 10, max_cells=10_000)


def _coded(spark, stored: DataFrame) -> str:
    """The folder of a coded store whose searches are measured to find every true neighbour."""
    path = f"{shared_folder(spark)}/coded-store-{uuid.uuid4().hex}"
    coded_store.CodedStore(spark, path, recall=1.0).add(stored.select("chunk_id"), stored)
    return path


@query
def ann_topk(spark, folder):
    """Through stored cells and codes: written by ``add``, opened again, candidates by code, exact ranks."""
    path = _coded(spark, inputs.vectors(spark, folder))
    return coded_store.CodedStore.load(spark, path).search(inputs.question_vectors(spark, folder), 20)


@query
def ann_deltas(spark, folder):
    """A store that grew: a base of two thirds, two deltas that replace and add, ids removed; opened again."""
    stored, path = inputs.vectors(spark, folder), f"{shared_folder(spark)}/coded-store-{uuid.uuid4().hex}"
    grown = coded_store.CodedStore(spark, path, recall=1.0)
    turned = stored.withColumn("vector", F.transform("vector", lambda x: -x))
    for part in (
        turned.where(F.col("chunk_id") % 3 == 0).unionByName(stored.where(F.col("chunk_id") % 3 == 1)),
        stored.where(F.col("chunk_id") % 6 == 0),
        stored.where(F.col("chunk_id") % 3 == 2),
    ):
        grown.add(part.select("chunk_id"), part)
    grown.delete(stored.where(F.col("chunk_id") % 7 == 5).select("chunk_id"))
    rows = coded_store.CodedStore.load(spark, path).rows()
    return rows.select("chunk_id", F.round(F.element_at("vector", 1).cast("double"), 6).alias("first"))


@query
def stored_topk(spark, folder):
    """Exact lists from a table store that was written and opened again."""
    path = f"{shared_folder(spark)}/table-store-{uuid.uuid4().hex}"
    stored, target = inputs.vectors(spark, folder), store.TableStore()
    target.add(stored.select("chunk_id"), stored)
    target.persist(path)
    return store.TableStore.load(spark, path).search(inputs.question_vectors(spark, folder), 20)


@query
def ann_topk_grid(spark, folder):
    """The same lists with questions sent in blocks, as where they are too many to be sent at once."""
    path = _coded(spark, inputs.vectors(spark, folder))
    return coded_store.CodedStore.load(spark, path).search(inputs.question_vectors(spark, folder), 20, max_cells=1_000)


@query
def ann_cells(spark, folder):
    stored = inputs.vectors(spark, folder)
    return knn.assign_cells(stored, knn.pick_centroids(stored)).groupBy("cell").agg(F.count("*").alias("n"))


# --- fusion ------------------------------------------------------------------------------------


def _fused(spark, folder, mode="hybrid", k=TOP_K):
    vector = inputs.vector_hits(spark, folder) if mode != "keyword" else None
    keyword = inputs.keyword_hits(spark, folder) if mode != "vector" else None
    return fusion.fuse(vector, keyword, k)


def _shown(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "chunk_id", *fusion.EVIDENCE, F.round("score", 12).alias("score"), "rank")


@query
def hybrid_rrf(spark, folder):
    return _shown(_fused(spark, folder))


@query
def mode_vector(spark, folder):
    return _shown(_fused(spark, folder, "vector"))


@query
def mode_keyword(spark, folder):
    return _shown(_fused(spark, folder, "keyword"))


@query
def rrf_sweep(spark, folder):
    swept = fusion.sweep(
        inputs.vector_hits(spark, folder), inputs.keyword_hits(spark, folder), (1, 3, 5, 10, 20, 60)
    )
    return swept.select("constant", "query_id", "chunk_id", F.round("score", 12).alias("score"), "rank")


@query
def evidence_table(spark, folder):
    return fusion.evidence_rows(inputs.with_documents(spark, folder, _fused(spark, folder)))


@query
def found_paths(spark, folder):
    return _fused(spark, folder, k=20).select("query_id", "chunk_id", fusion.paths().alias("paths"))


# --- reranking ---------------------------------------------------------------------------------


def _orderings(spark, folder, ranked: DataFrame) -> DataFrame:
    """A stored ordering per question: candidates by the digest of question and candidate."""
    wanted = rerank.requests(ranked, inputs.questions(spark, folder), inputs.MODEL, inputs.PROMPT)
    places = F.transform(
        "candidates",
        lambda c, i: F.struct(F.md5(F.concat(F.col("query_id").cast("string"), F.lit("/"), c)).alias("h"), i.alias("i")),
    )
    return wanted.select("key", F.transform(F.array_sort(places), lambda p: p["i"]).alias("order"))


@query
def rerank_apply(spark, folder):
    # The list is small but costs a scan of the corpus, and is used for the requests and the result.
    ranked = staged(_fused(spark, folder, k=20), "pool")
    reranked = rerank.rerank(
        ranked, inputs.questions(spark, folder), _orderings(spark, folder, ranked), inputs.MODEL, inputs.PROMPT
    )
    return _shown(reranked)


@query
def rerank_keys(spark, folder):
    wanted = rerank.requests(
        inputs.keyword_hits(spark, folder), inputs.questions(spark, folder), inputs.MODEL, inputs.PROMPT
    )
    return wanted.select("query_id", "key", F.size("candidates").alias("candidates"))


@query
def ranking_repair(spark, folder):
    repaired = rerank.orderings_of_responses(inputs.ranking_responses(spark, folder))
    return repaired.select(
        "key",
        F.array_join(F.col("order").cast("array<string>"), ",").alias("order"),
        payload.is_permutation(F.col("order"), F.lit(6)).alias("whole"),
    )


@query
def rerank_prompts(spark, folder):
    hits = inputs.with_documents(spark, folder, inputs.keyword_hits(spark, folder))
    prompts = context.rerank_prompts(inputs.questions(spark, folder), hits)
    return prompts.select("query_id", F.length("prompt").alias("chars"), F.md5("prompt").alias("digest"))


# --- answers -----------------------------------------------------------------------------------


@query
def context_blocks(spark, folder):
    hits = inputs.with_documents(spark, folder, inputs.keyword_hits(spark, folder, TOP_K))
    return context.context_blocks(hits).select("query_id", F.md5("context").alias("digest"))


@query
def context_stored(spark, folder):
    """The same context from a stored table of texts, of which only the buckets of the hits are read."""
    table = f"payload_{uuid.uuid4().hex}"
    payload_table.write(inputs.payload(spark, folder), table)
    hits = payload_table.fetched(spark, table, inputs.keyword_hits(spark, folder, TOP_K))
    return context.context_blocks(hits).select("query_id", F.md5("context").alias("digest"))


@query
def answer_prompts(spark, folder):
    hits = inputs.with_documents(spark, folder, inputs.vector_hits(spark, folder, TOP_K))
    prompts = context.answer_prompts(inputs.questions(spark, folder), hits)
    return prompts.select("query_id", F.length("prompt").alias("chars"), F.md5("prompt").alias("digest"))


def _joined(column: str):
    return F.array_join(F.col(column).cast("array<string>"), ",").alias(column)


@query
def citation_validate(spark, folder):
    checked = answers.validate(inputs.responses(spark, folder))
    return checked.select(
        "query_id",
        F.md5("text").alias("digest"),
        _joined("citations"),
        _joined("invalid_citations"),
        "refused",
        "conflict",
        "grounded",
        F.coalesce("error", F.lit("")).alias("error"),
    )


@query
def citation_highlight(spark, folder):
    checked = answers.validate(inputs.responses(spark, folder))
    return checked.select("query_id", F.md5(text.highlight_citations(F.col("text"))).alias("digest"))


def _conversation_passages(spark, folder) -> DataFrame:
    """Five passages per conversation turn: the documents that follow its conversation's number."""
    turns = inputs.responses(spark, folder).select("query_id", F.split("query_id", "-")[0].cast("long").alias("conv"))
    ranked = turns.select("query_id", F.explode(F.sequence(F.lit(1), F.lit(inputs.PASSAGES))).alias("rank"), "conv")
    return inputs.with_documents(spark, folder, ranked.withColumn("chunk_id", F.col("conv") + F.col("rank") * 2 % 3))


@query
def cited_sources(spark, folder):
    checked = answers.validate(inputs.responses(spark, folder)).where(F.col("error").isNull())
    return answers.resolve(checked, _conversation_passages(spark, folder))


@query
def cited_documents(spark, folder):
    cited = answers.cited_documents(cited_sources(spark, folder))
    return cited.select("query_id", F.array_join("cited_documents", ",").alias("cited_documents"))


# --- evaluation --------------------------------------------------------------------------------


@query
def golden_questions(spark, folder):
    return inputs.golden(spark, folder)[0].select(
        "query_id",
        "type",
        "phrasing",
        "cohort",
        "expected",
        F.md5(F.array_join("anchors", "|")).alias("anchors"),
        F.md5(F.array_join("expected_facts", "|")).alias("expected_facts"),
    )


@query
def golden_documents(spark, folder):
    """Every (question, expected document)."""
    return inputs.golden(spark, folder)[1]


@query
def golden_problems(spark, folder):
    """The rules applied to a damaged golden set: anchors dropped, types swapped, ids repeated."""
    good = staged(inputs.golden(spark, folder)[0], "golden")
    damaged = (
        good.withColumn("type", F.when(F.col("cohort") == "extended", "unanswerable").otherwise(F.col("type")))
        .withColumn(
            "anchors",
            F.when(F.col("phrasing") == "code", F.array().cast("array<string>")).otherwise(F.col("anchors")),
        )
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.length("question") % 3)))
    )
    return golden_source.problems(damaged, F.col("expected") > 0)


def _results(spark, folder) -> DataFrame:
    hits = inputs.with_documents(spark, folder, _fused(spark, folder))
    asked, expected = inputs.golden(spark, folder)
    return metrics.retrieval_results(hits, asked, expected=expected)


def _rounded_metrics(frame: DataFrame) -> list:
    return [F.round(m, 9).alias(m) for m in metrics.RETRIEVAL_METRICS]


@query
def retrieval_results(spark, folder):
    results = _results(spark, folder)
    return results.select(
        "query_id", "type", "phrasing", "cohort", *_rounded_metrics(results),
        F.array_join("retrieved_documents", ",").alias("retrieved_documents"),
    )


@query
def retrieval_summary(spark, folder):
    summary = metrics.retrieval_summary(_results(spark, folder))
    return summary.select("questions", *_rounded_metrics(summary))


@query
def retrieval_breakdown(spark, folder):
    fused = fusion.fuse_modes(inputs.vector_hits(spark, folder), inputs.keyword_hits(spark, folder))
    hits = inputs.with_documents(spark, folder, fused)
    asked, expected = inputs.golden(spark, folder)
    table = metrics.retrieval_breakdown(metrics.retrieval_results(hits, asked, RETRIEVAL_MODES, expected))
    return table.select("mode", "axis", "value", "questions", *_rounded_metrics(table))


def _before_after(spark, folder) -> tuple[DataFrame, DataFrame]:
    pool = staged(_fused(spark, folder, k=20), "pool")
    reranked = rerank.rerank(
        pool, inputs.questions(spark, folder), _orderings(spark, folder, pool), inputs.MODEL, inputs.PROMPT
    )
    asked, expected = inputs.golden(spark, folder)
    asked = staged(asked, "golden")
    before = metrics.retrieval_results(inputs.with_documents(spark, folder, pool.where(F.col("rank") <= TOP_K)), asked, expected=expected)
    return before, metrics.retrieval_results(inputs.with_documents(spark, folder, reranked), asked, expected=expected)


@query
def rerank_comparison(spark, folder):
    table = metrics.rerank_comparison(*_before_after(spark, folder))
    return table.select("metric", *[F.round(c, 9).alias(c) for c in ("before", "after", "change")])


@query
def moved_questions(spark, folder):
    table = metrics.moved_questions(*_before_after(spark, folder))
    return table.select("query_id", F.round("before", 9).alias("before"), F.round("after", 9).alias("after"), "direction")


def _answer_results(spark, folder) -> DataFrame:
    checked = answers.validate(inputs.responses(spark, folder)).where(F.col("error").isNull())
    return metrics.answer_results(checked, inputs.response_questions(spark, folder))


@query
def answer_results(spark, folder):
    return _answer_results(spark, folder).drop("invalid_citations")


@query
def answer_summary(spark, folder):
    summary = metrics.answer_summary(_answer_results(spark, folder))
    return summary.select(
        *[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in summary.dtypes]
    )


@query
def question_counts(spark, folder):
    return metrics.question_counts(inputs.golden(spark, folder)[0])


# --- stored state ------------------------------------------------------------------------------


def _cache(spark, folder) -> DataFrame:
    """Vectors under the keys of the documents with their number; those of label 0 are cut short."""
    texts = embedding.keyed(inputs.documents(spark, folder, "doc_id", "text"), inputs.MODEL, DOCUMENT_TASK)
    stored = read_table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("doc_id"),
        F.when(F.col("label") == 0, F.slice("embedding", 1, 10)).otherwise(F.col("embedding")).alias("vector"),
    )
    rows = texts.join(stored, "doc_id").select("key", "vector", (-F.col("doc_id")).alias("age"))
    return store.latest(rows, "key", "age")


@query
def cache_keys(spark, folder):
    texts = embedding.keyed(inputs.documents(spark, folder, "doc_id", "text"), inputs.MODEL, DOCUMENT_TASK)
    return texts.select("doc_id", "key")


@query
def cache_report(spark, folder):
    texts = embedding.keyed(inputs.documents(spark, folder, "doc_id", "text"), inputs.MODEL, DOCUMENT_TASK)
    return embedding.cache_report(texts, _cache(spark, folder), dim=64)


@query
def cache_vectors(spark, folder):
    """Every document with its stored vector, where there is a usable one."""
    texts = embedding.keyed(inputs.documents(spark, folder, "doc_id", "text"), inputs.MODEL, DOCUMENT_TASK)
    found = embedding.with_cached(texts, _cache(spark, folder), dim=64)
    return found.select("doc_id", F.round(F.col("vector")[0].cast("double"), 7).alias("first"))


@query
def cache_misses(spark, folder):
    texts = embedding.keyed(inputs.documents(spark, folder, "doc_id", "text"), inputs.MODEL, DOCUMENT_TASK)
    missing = embedding.misses(texts, _cache(spark, folder), dim=64)
    return missing.select("key", F.length("text").alias("chars"))


@query
def upsert_latest(spark, folder):
    turns = read_table(spark, folder, "conversations")
    return store.latest(turns, "conv_id", "turn").select("conv_id", "turn", "role", F.md5("text").alias("digest"))


@query
def upsert_repeated(spark, folder):
    """Added rows whose key repeats: the conversations of every document number, one of each stays."""
    stored = inputs.documents(spark, folder, "doc_id", "source").withColumnRenamed("source", "role")
    turns = read_table(spark, folder, "conversations").select(F.col("conv_id").alias("doc_id"), F.concat("role", F.lit("-"), "turn").alias("role"))
    return store.upserted(stored, turns, "doc_id")


@query
def citation_numbers_any_size(spark, folder):
    """Every turn as an answer that cites a number beyond 64 bits, its turn and, declared, a large one."""
    turn = F.col("turn")
    answer = F.concat("text", F.lit(" see [99999999999999999999] and ["), turn + 1, F.lit("]"))
    body = F.to_json(F.struct(answer.alias("answer"), F.lit(False).alias("refused"), F.lit(False).alias("conflict")))
    declared = F.concat(F.lit(', "citations": [18446744073709551616, '), F.col("conv_id") % 7, F.lit("]}"))
    rows = read_table(spark, folder, "conversations").select(
        F.concat("conv_id", F.lit("-"), "turn").alias("query_id"),
        F.lit(inputs.PASSAGES).alias("passages"),
        F.concat(F.substring(body, F.lit(1), F.length(body) - 1), declared).alias("response"),
    )
    return answers.validate(rows).select(
        "query_id", F.md5("text").alias("digest"), _joined("citations"), _joined("invalid_citations"), "grounded"
    )


@query
def upsert_merge(spark, folder):
    stored = inputs.documents(spark, folder, "doc_id", "text", "source")
    labels = read_table(spark, folder, "labels").select("doc_id", F.lit("relabelled").alias("text"), F.lit("labels").alias("source"))
    merged = store.upserted(stored, labels, "doc_id")
    return merged.select("doc_id", F.md5("text").alias("digest"), "source")


@query
def paired_vectors(spark, folder):
    """Chunks with their vectors, after the checks that a store makes."""
    documents = read_table(spark, folder, "documents").select(F.col("doc_id").alias("chunk_id"), "lang")
    chunks = documents.join(inputs.vectors(spark, folder), "chunk_id", "left_semi")
    stored = inputs.vectors(spark, folder).join(documents, "chunk_id", "left_semi")
    return store.paired(chunks, stored).select(
        "chunk_id", "lang", F.size("vector").alias("dim"), rounded(vectors.norm(F.col("vector"))).alias("norm")
    ).withColumn("norm", F.round("norm", 6))
