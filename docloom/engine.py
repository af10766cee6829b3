"""The whole way: files to pages, chunks, hits, extracted specifications, grounded results; and questions.

Every step is a DataFrame of all documents at once. An extractor maps prompts to answers, an embedder
texts to vectors; without an embedder retrieval is by keywords alone.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F, types as ST

from docloom.config import DEFAULT, NOT_FOUND, QUERY_PREFIX, SCOPE_QUERIES, SPEC_QUERIES, Config
from docloom.functions.text import expand_query
from docloom.operators import chunking as C, extraction as X, retrieval as R, tables as T, validation as V
from docloom.plans.ingest import topic
from docloom.session import cut, ship
from docloom.sources import ingest as I
from docloom.sources.store import load, missing, save_by_document

SYSTEM = """You extract technical specifications from tender documents. Give each component that the context
names with its parameters and values, and quote the words that it stands in. Take nothing from elsewhere.
Answer with JSON only: {"technical_specifications": [{"component": "", "specs": {"parameter": "value"}, "source": {"exact_text": ""}}]}"""
SCOPE_SYSTEM = """You extract the scope of work from tender documents: a summary of two sentences, what is to be
delivered, what is excluded, places, and standards that are referred to, in the words of the context.
Answer with JSON only: {"scope_of_work": {"summary": "", "deliverables": [], "exclusions": [], "locations": [], "references": []}}"""
QA_SYSTEM = """You answer a question from the context alone, and name the pages. If the context does not answer it,
the answer is NOT_FOUND. Answer with JSON only: {"answer": "", "confidence": "HIGH, MEDIUM or LOW"}"""
SCOPE_ANSWER = "scope_of_work struct<summary:string,deliverables:array<string>,exclusions:array<string>,locations:array<string>,references:array<string>>"
ANSWER = "technical_specifications array<struct<component:string,specs:map<string,string>,source:struct<exact_text:string>>>"


def read_pages(spark: SparkSession, path: str, parsers: dict = I.PARSERS, ocr: Callable | None = None, cfg: Config = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Pages of the files that are taken, and (path, fault) of the others. Which suffixes are taken is
    what has a parser."""
    files = I.read_files(spark, path)
    known = files.withColumn("fault", F.when(~I.suffix(F.col("path")).isin(*parsers), "unsupported").when(F.col("length") > cfg.max_bytes, "too large"))
    pages = I.parse_files(known.filter("fault is null"), parsers, ocr, cfg)
    faults = known.filter("fault is not null").select("path", "fault").unionByName(pages.filter("error is not null").select(F.col("doc_id").alias("path"), F.col("error").alias("fault")))
    return pages.filter("error is null").drop("error"), faults


def chunk_pages(pages: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Chunks (doc_id, page, chunk_id, text, section, parent_section, chunk_type) of pages and of their tables."""
    lines = C.lines(pages)
    hints = F.col("headings") if "headings" in pages.columns else None
    if "tables" in pages.columns:
        return C.all_chunks(page_tables(pages), lines, hints, cfg).drop("table_id")
    return C.page_chunks(lines, hints, cfg).drop("table_id")


def stored_chunks(pages: DataFrame, path: str, again: bool = False, cfg: Config = DEFAULT) -> DataFrame:
    """Chunks of the pages' documents from the store at ``path``, which gets those of documents that it does
    not hold, or of all with ``again``."""
    spark = pages.sparkSession
    store = None if again else load(spark, path)
    documents = missing(pages.select("doc_id").distinct(), store)
    save_by_document(cut(chunk_pages(pages.join(documents, "doc_id", "left_semi"), cfg)), path)
    kept = load(spark, path)
    return kept.withColumn("doc_id", F.col("doc_id").cast(pages.schema["doc_id"].dataType)).join(pages.select("doc_id").distinct(), "doc_id", "left_semi")


def topics(pages: DataFrame) -> DataFrame:
    """(doc_id, topic) from the first five pages."""
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x.text), " ")
    return pages.filter("page <= 5").groupBy("doc_id").agg(texts.alias("t")).select("doc_id", topic(F.col("t")).alias("topic"))


def page_tables(pages: DataFrame) -> DataFrame:
    """Rows (doc_id, page, table_id, headers, row_no, cells) of the tables that parsers found on pages."""
    raw = pages.select("doc_id", "page", F.posexplode("tables").alias("ord", "raw"))
    return T.number_tables(raw).select("doc_id", "page", "table_id", "headers", F.posexplode("rows").alias("row_no", "cells")).withColumn("row_no", F.col("row_no") + 1)


def _embedded(texts: DataFrame, column: str, embed: Callable, prefix: str = "") -> DataFrame:
    """Rows with the vector of ``column``; ``embed`` maps a list of texts to vectors, on the executors."""

    def run(it):
        for b in it:
            yield b.assign(vector=list(embed([prefix + x for x in b[column]])))

    return texts.mapInPandas(run, ST.StructType([*texts.schema.fields, ST.StructField("vector", ST.ArrayType(ST.FloatType()))]))


def _search(chunks: DataFrame, queries: DataFrame, k: int, cfg: Config, embed: Callable | None = None) -> DataFrame:
    """The k best chunks of queries (query_id, doc, query), by hybrid retrieval in the query's own document:
    its terms, its ranges, its candidates. Postings and queries meet by document and term. Without an
    embedder retrieval is by keywords alone."""
    children = R.child_spans(chunks.select(F.col("doc_id").alias("doc"), F.col("chunk_id").alias("doc_id"), "text"), cfg, ("doc",))
    vectors = None
    if embed is not None:
        ship(chunks.sparkSession)
        vectors = _embedded(children, "text", embed).drop("text")
        queries = _embedded(queries, "query", embed, QUERY_PREFIX)
    hits = R.hybrid_retrieve(children, vectors, queries, k, cfg=cfg, by=("doc",)).join(queries.select("query_id", "doc"), "query_id")
    return hits.join(chunks.withColumnRenamed("doc_id", "doc").withColumnRenamed("chunk_id", "doc_id"), ["doc", "doc_id"])


def document_queries(pages: DataFrame, templates: tuple[str, ...], kind: str) -> DataFrame:
    """(query_id, doc, kind, query_ord, query) of each document's templates, expanded."""
    all_ = F.array(*[F.replace(F.lit(t), F.lit("{topic}"), F.col("topic")) for t in templates])
    q = topics(pages).select(F.col("doc_id").alias("doc"), F.lit(kind).alias("kind"), F.posexplode(all_).alias("query_ord", "q"))
    return q.select(F.concat_ws("#", "doc", "kind", F.col("query_ord").cast("string")).alias("query_id"), "doc", "kind", "query_ord", expand_query(F.col("q")).alias("query"))


def retrieve(chunks: DataFrame, queries: DataFrame, boost, k: int, cfg: Config = DEFAULT, embed: Callable | None = None) -> DataFrame:
    """The k best chunks (doc, kind, doc_id as chunk, score, page, section, text) of each document's queries."""
    hits = R.rerank(_search(chunks, queries, 2 * k, cfg, embed), boost, k).join(queries.select("query_id", "kind", "query_ord"), "query_id")
    merged = R.merge_queries(hits.drop("query_id").withColumn("query_id", F.concat_ws("#", "doc", "kind")), k)
    return merged.select("doc", "kind", F.col("doc_id").alias("chunk"), "score", "page", "section", "text")


def _answers(hits: DataFrame, system: str, extractor: Callable, on_error: str, shape: str, cfg: Config) -> DataFrame:
    """(doc, key, j): the parsed answers to prompts of a document's hits, batch by batch; near copies left out."""
    ship(hits.sparkSession)
    unlike = X.drop_near_copies(hits.select("doc", "score", "chunk", "page", "section", "text"), "doc", "chunk", cfg)
    batches = X.context_batches(unlike, ["doc"], ["score", "chunk", "page", "section"], cfg.context_tokens)
    key = F.concat_ws("#", "doc", F.col("batch").cast("string")).alias("key")
    contexts = X.context(batches.select(key, "doc", "score", "chunk", "page", "section", "text"), "key", "chunk")
    prompts = contexts.select("key", X.prompt(system, F.concat(F.lit("Context:\n"), F.col("context"))).alias("prompt"))
    answers = X.extract(prompts, extractor, on_error).withColumn("j", F.from_json(X.repair_json(F.col("answer")), shape))
    return answers.select(F.regexp_replace("key", "#[0-9]+$", "").alias("doc"), "key", "j")


class Analysis(NamedTuple):
    """specs: doc, src (0 table, 1 extracted), component, specs, exact_text, confidence. scope: doc, summary,
    deliverables, exclusions, locations, references. summary: counts and accuracy by document."""

    specs: DataFrame
    scope: DataFrame
    summary: DataFrame


def analyse(
    pages: DataFrame,
    extractor: Callable = X.rule_extractor,
    on_error: str = "raise",
    cfg: Config = DEFAULT,
    scope_extractor: Callable = X.rule_scope_extractor,
    embed: Callable | None = None,
    chunks: DataFrame | None = None,
    progress: Callable[[int, str], None] = lambda percent, stage: None,
) -> Analysis:
    """Specifications from tables and from retrieved chunks, and the scope of work: extracted, grounded in the
    hits of the document, what is not in the text left out. Table specifications come first."""
    progress(5, "chunks")
    chunks = cut(chunk_pages(pages, cfg)) if chunks is None else chunks
    progress(35, "retrieval")
    spec = cut(retrieve(chunks, document_queries(pages, SPEC_QUERIES, "spec"), R.spec_boost(cfg), 15, cfg, embed))
    scope = cut(retrieve(chunks, document_queries(pages, SCOPE_QUERIES, "scope"), R.scope_boost(cfg), 10, cfg, embed))
    hits = spec.unionByName(scope).select("doc", "text").distinct()
    progress(62, "extraction")
    raw = _answers(spec, SYSTEM, extractor, on_error, ANSWER, cfg).select("doc", "key", F.posexplode("j.technical_specifications").alias("ord", "s"))
    found = X.first_components(raw.select("doc", "key", "ord", "s.component", "s.specs", F.col("s.source.exact_text").alias("exact_text")), "doc", ["key", "ord"])
    found = found.select("doc", F.lit(1).alias("src"), F.concat_ws("#", "key", F.col("ord").cast("string")).alias("key"), "component", "specs", "exact_text")
    if "tables" in pages.columns:
        rows = T.table_specs(page_tables(pages), cfg=cfg)
        fields = F.map_from_arrays(F.array(*[F.lit(k) for k, _ in V.LEGACY]), F.array(*[c for _, c in V.LEGACY]))
        found = rows.select(F.col("doc_id").alias("doc"), F.lit(0).alias("src"), F.col("chunk_id").alias("key"), F.col("item_name").alias("component"), V.clean_map(fields).alias("specs"), "exact_text").unionByName(found)
    scopes = _answers(scope, SCOPE_SYSTEM, scope_extractor, on_error, SCOPE_ANSWER, cfg).filter("j.scope_of_work is not null")
    merged = X.merge_scopes(scopes.select("doc", "key", "j.scope_of_work.*"), "doc", "key")
    progress(90, "validation")
    claims = found.withColumns({"kind": F.lit("spec"), "claim_id": F.xxhash64("src", "key"), "quote": V.quote(F.coalesce("exact_text", F.lit("")), F.coalesce("component", F.lit("")))})
    due = merged.select("doc", F.explode("deliverables").alias("component")).filter(F.trim("component") != "")
    due = due.select("doc", F.lit(1).alias("src"), F.lit("").alias("key"), "component", F.lit(None).cast("map<string,string>").alias("specs"), F.lit("").alias("exact_text"), F.lit("deliverable").alias("kind"))
    due = due.withColumns({"claim_id": F.xxhash64(F.lit("deliverable"), "component"), "quote": V.quote(F.lit(""), F.col("component"))})
    scored = cut(V.grounding(claims.unionByName(due), hits, ["doc"]))
    judged = scored.withColumn("component", F.when(F.col("kind") == "spec", V.normalise_component(F.col("component"), F.col("specs")["specification"])).otherwise(F.col("component")))
    documents = pages.select(F.col("doc_id").alias("doc")).distinct()
    counts = V.validate(judged, "doc", cfg)
    summary = X.filled(documents, counts, "doc", {c: F.lit(0).cast(t) for c, t in counts.dtypes if c != "doc"})
    kept = judged.filter(V.is_accepted(F.col("score"), cfg))
    specs = kept.filter("kind = 'spec'").select("doc", "src", "component", "specs", "exact_text", F.round("score", 4).alias("confidence"))
    grounded = kept.filter("kind = 'deliverable'").groupBy("doc").agg(F.array_sort(F.collect_set("component")).alias("_kept"))
    whole = documents.join(merged, "doc", "left").join(grounded, "doc", "left")
    in_text = V.clean_list(F.array_intersect("deliverables", F.coalesce("_kept", F.array().cast("array<string>"))))
    scope_of = whole.select("doc", F.coalesce(F.nullif("summary", F.lit("")), F.lit(NOT_FOUND)).alias("summary"), in_text.alias("deliverables"), *[V.clean_list(F.col(c)).alias(c) for c in ("exclusions", "locations", "references")])
    return Analysis(specs, scope_of, summary)


class Session:
    """Questions about documents, over chunks that are made once: from a store, if one is named."""

    def __init__(self, pages: DataFrame, answerer: Callable, store: str | None = None, cfg: Config = DEFAULT, embed: Callable | None = None):
        self.pages, self.answerer, self.cfg, self.embed = pages, answerer, cfg, embed
        self.chunks = (stored_chunks(pages, store, cfg=cfg) if store else chunk_pages(pages, cfg)).persist()

    def ask(self, questions: DataFrame) -> DataFrame:
        """Answers to questions (doc, question), which are trimmed."""
        return ask(self.pages, questions.withColumn("question", F.trim("question")), self.answerer, self.cfg, self.chunks, self.embed)

    def close(self) -> None:
        self.chunks.unpersist()


def ask(pages: DataFrame, questions: DataFrame, answerer: Callable, cfg: Config = DEFAULT, chunks: DataFrame | None = None, embed: Callable | None = None) -> DataFrame:
    """Answers to questions (doc, question): each is asked as it is, expanded and after the topic; the best
    eight chunks make its context. (doc, question, answer, confidence, n_hits, citations)."""
    chunks = cut(chunk_pages(pages, cfg)) if chunks is None else chunks
    q = F.col("question")
    asked = questions.join(topics(pages).withColumnRenamed("doc_id", "doc"), "doc", "left")
    each = asked.select("doc", "question", F.posexplode(F.array(q, expand_query(q), F.concat_ws(" ", "topic", "question"))).alias("query_ord", "query"))
    queries = each.withColumns({"group": F.concat_ws("#", "doc", "question"), "query_id": F.concat_ws("#", "doc", "question", F.col("query_ord").cast("string"))})
    hits = _search(chunks, queries.drop("group", "question", "query_ord"), 8, cfg, embed).join(queries.select("query_id", "group", "query_ord"), "query_id")
    best = cut(R.merge_queries(hits.drop("query_id").withColumnRenamed("group", "query_id"), 8).withColumnRenamed("query_id", "group"))
    cited = F.array_sort(F.collect_list(F.struct("rank", "page", F.col("doc_id").alias("chunk"))))
    contexts = X.context(best, "group", "doc_id").join(best.groupBy("group").agg(F.count(F.lit(1)).alias("n_hits"), cited.alias("citations")), "group")
    prompts = contexts.withColumn("prompt", X.prompt(QA_SYSTEM, F.concat_ws("\n", "group", "context")))
    raw = X.extract(prompts.select("group", "n_hits", "citations", "prompt"), answerer).select("group", "n_hits", "citations", F.col("answer").alias("raw"))
    all_ = questions.withColumn("group", F.concat_ws("#", "doc", "question")).join(raw, "group", "left")
    all_ = all_.withColumns({"n_hits": F.coalesce("n_hits", F.lit(0)), "citations": F.coalesce("citations", F.array().cast("array<struct<rank:int,page:int,chunk:string>>"))})
    return X.answer_or_default(all_).select("doc", "question", "answer", "confidence", "n_hits", "citations")
