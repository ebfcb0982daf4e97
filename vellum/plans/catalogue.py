"""Queries of the document engine over the synthetic tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import prompts
from ..functions import text as X
from ..operators import audit, changes, chunking, models, relational, retrieval, temporal
from ..sources import fixtures as S
from ..sources import store
from .oracles import ORACLES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def now() -> F.Column:
    """The present, fixed so that results can be compared."""
    return F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")


__all__ = ["ORACLES", "QUERIES"]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _documents(name: str, build: Callable[[DataFrame], DataFrame]) -> None:
    """Register a query over the documents view."""
    QUERIES[name] = lambda spark, sf_dir: build(S.documents_v(spark, sf_dir))


def _halves(docs: DataFrame) -> DataFrame:
    """Documents with a cursor in the middle of their text."""
    half = F.floor(F.length("content") / 2).cast("int")
    return docs.withColumn("half", half).withColumn("prefix", F.left("content", F.col("half"))).withColumn("suffix", F.substring("content", F.col("half") + 1, F.length("content")))


SHOWN = ["id", "title", "content", "folder_id"]
#: The vectors that searches take as queries.
ASKED = "vec_id % 50 = 0"
_documents("doc_list", relational.document_list)
_documents("doc_get", lambda d: relational.document_by_id(d, 7).select(*SHOWN))
_documents("doc_missing", lambda d: relational.document_by_id(d, 10).select(*SHOWN))
_documents("doc_home", lambda d: relational.first_document(d).select("id", "title", "content"))
_documents("doc_newest", lambda d: relational.newest_first(d).select("id", "title"))
_documents("preview_ellipsis", lambda d: d.select("id", X.ellipsis_preview(F.col("content")).alias("preview")))
_documents(
    "title_display",
    lambda d: d.select(
        "id", X.display_title(F.col("title")).alias("shown"), X.normal_title(F.col("title")).alias("normal"), X.display_content(F.col("content")).alias("body")
    ),
)
_documents(
    "context_truncate",
    lambda d: _halves(d).select(
        "id",
        X.tail(F.col("prefix"), 1000).alias("prefix_kept"),
        X.head(F.col("suffix"), 200).alias("suffix_kept"),
        X.tail(X.tail(F.col("prefix"), 1000), 500).alias("prompt_prefix"),
        X.head(F.col("suffix"), 500).alias("suffix_wide"),
        X.tail(F.col("prefix"), 2000).alias("prefix_wide"),
        X.at_end(F.col("content"), F.col("half")).alias("at_end"),
    ),
)
_documents("first_phrase", lambda d: d.select("id", X.first_phrase(F.col("content")).alias("phrase")))
_documents(
    "text_stats",
    lambda d: _halves(d).select(
        "id",
        F.length("content").alias("n_chars"),
        X.word_count(F.col("content")).alias("n_words"),
        X.cursor_line(F.col("prefix")).alias("line"),
        X.cursor_column(F.col("prefix")).alias("col"),
    ),
)
_documents(
    "date_display",
    lambda d: d.select(
        "id",
        D.iso(F.col("updated_at")).alias("updated_iso"),
        D.local_text(F.col("updated_at"), "Asia/Shanghai").alias("updated_local"),
        D.list_text(F.col("updated_at"), now()).alias("listed"),
        D.iso(D.last_touched(F.col("updated_at"), F.col("created_at"))).alias("touched"),
    ),
)
_documents("chunks_fixed", chunking.fixed_chunks)
_documents("chunk_counts", lambda d: chunking.chunk_counts(chunking.fixed_chunks(d)))
_documents("chunks_markdown", lambda d: chunking.chunk_documents(d).withColumn("headers", F.to_json("headers")))
_documents(
    "doc_soft_delete",
    lambda d: changes.soft_delete(d, d.filter(F.col("id") % 5 == 0), now()).select("id", "is_active", D.iso(F.col("updated_at")).alias("updated_at")),
)
_documents("doc_json", lambda d: relational.as_json(relational.active(d).withColumn("content", X.preview(F.col("content")))))
_documents(
    "doc_json_read",
    lambda d: relational.from_json(
        relational.as_json(d), "id long, title string, content string, folder_id int, created_at string, updated_at string"
    ),
)
_documents("doc_insert", lambda d: changes.insertions(d, F.col("created_at")).withColumn("ts", D.iso(F.col("ts"))))
_documents("active_chunks", lambda d: store.of_active_documents(chunking.fixed_chunks(d), d))
_documents("index_delete", lambda d: store.without_documents(chunking.fixed_chunks(d), d.filter(F.col("id") % 4 == 0).select(F.col("id").alias("doc_id"))))
_documents("polish_text", lambda d: models.polished(d.select("id", F.col("content").alias("text")), models.StubModel()).select("id", "reply", "status"))
_documents("extend_text", lambda d: models.extended(d.select("id", F.col("content").alias("text")), models.StubModel()).select("id", "reply", "status"))
_documents("complete_text", lambda d: models.completions(_halves(d).select("id", "prefix", "suffix"), models.StubModel()).select("id", "completion"))


@query
def folder_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.active(S.folders_v(spark, sf_dir)).select("id", "title", "parent_id")


@query
def folder_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.folder_by_id(S.folders_v(spark, sf_dir), 16).select("id", "title", "parent_id")


@query
def folder_contents_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.folder_contents(S.folders_v(spark, sf_dir), S.documents_v(spark, sf_dir), 0)


@query
def folder_contents_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.folder_contents(S.folders_v(spark, sf_dir), S.documents_v(spark, sf_dir), 2)


@query
def doc_with_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.with_folder(S.documents_v(spark, sf_dir), S.folders_v(spark, sf_dir)).select("id", "title", "folder_id", "folder_title")


@query
def folder_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.folder_paths(spark, S.folders_v(spark, sf_dir))


@query
def folder_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    folders = S.folders_v(spark, sf_dir)
    copies = folders.filter("is_active").select((F.col("id") + 100).alias("id"), F.concat(F.col("title"), F.lit(" 2")).alias("title"), F.coalesce("parent_id", F.lit(0)).alias("parent_id"))
    return relational.insert_folders(folders, copies)


@query
def chat_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even conversations ask with notes, odd ones without; blank messages ask nothing."""
    asked = relational.answerable(_last_messages(spark, sf_dir), "question")
    with_notes = prompts.answer(F.lit("none"), F.col("question"))
    return asked.select("conv_id", F.when(F.col("conv_id") % 2 == 0, with_notes).otherwise(prompts.plain(F.col("question"))).alias("prompt"))


@query
def save_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saves begin when a burst's gap has passed, take ten seconds an edit, and every fourth size of burst fails."""
    edits = S.edits_v(spark, sf_dir)
    bursts = temporal.debounced_wide(edits, 1800)
    begun = F.col("last_ts") + F.make_dt_interval(secs=F.lit(1800).cast("decimal(18,6)"))
    ended = F.col("start_ts") + F.make_dt_interval(secs=(F.col("n_edits") * 10).cast("decimal(18,6)"))
    saves = bursts.select("doc_id", begun.alias("start_ts"), "n_edits").select("doc_id", "start_ts", ended.alias("end_ts"), (F.col("n_edits") % 4 != 0).alias("ok"))
    last = edits.agg(F.max("ts")).first()[0]
    return temporal.save_status(edits, saves, F.lit(last).cast("timestamp_ntz")).select("doc_id", "status")


@query
def overlap_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's last two thirds behind its first two thirds."""
    text, third = F.col("text"), F.floor(F.length("text") / 3).cast("int")
    made, prefix = F.substring(text, third + 1, F.length("text")), F.left(text, third * 2)
    return S.read(spark, sf_dir, "conversations").select("conv_id", "turn", X.without_overlap(made, prefix).alias("kept"))


@query
def markdown_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = S.documents_v(spark, sf_dir).join(S.read(spark, sf_dir, "pages"), F.col("id") == F.col("page_id"), "left")
    return joined.select("id", X.markdown_like(F.col("content")).alias("is_markdown"), X.paste_as_markdown(F.col("content"), F.col("html")).alias("as_markdown"))


def _last_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max_by("text", "turn").alias("question"))


@query
def cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _last_messages(spark, sf_dir).select("conv_id", X.cache_key(F.col("question")).alias("key"))


@query
def ask_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.answers(_last_messages(spark, sf_dir), models.StubModel()).select("conv_id", "reply", "status")


@query
def knn_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = S.read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return retrieval.nearest(vectors.filter(ASKED), vectors).select("query_id", "vec_id", F.round("dist", 6).alias("dist"), "rank")


def _contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search reads vectors alone; texts are read of its hits."""
    docs = S.documents_v(spark, sf_dir)
    chunks = lambda only=None: store.of_active_documents(S.chunk_vectors_v(spark, sf_dir, only).drop("is_active"), docs)
    asked = S.read(spark, sf_dir, "embeddings").filter(ASKED).select("vec_id", "embedding")
    keys = retrieval.nearest_keys(asked, chunks())
    found = retrieval.contexts(retrieval.ranked(asked, chunks(keys), keys))
    number = F.col("vec_id").alias("query_id")
    questions = asked.select(number).distinct().withColumn("question", F.concat(F.lit("What is known about vector "), F.col("query_id").cast("string"), F.lit("?")))
    return retrieval.answer_prompts(found, questions)


@query
def rag_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.array_join(F.transform("sources", lambda s: F.concat(s["title"], F.lit(": "), s["content"])), "\n")
    return _contexts(spark, sf_dir).select("query_id", "context", shown.alias("sources"), F.size("sources").alias("n_sources"), "prompt")


def _answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Answers and new cache rows; every fourth question is in the cache, and every eighth has expired there."""
    asked = _contexts(spark, sf_dir).select("query_id", X.cache_key(F.col("question")).alias("cache_key"), "prompt")
    number = F.col("query_id")
    cache = asked.filter(number % 200 == 0).select(
        F.col("cache_key").alias("key"),
        F.lit("put").alias("op"),
        (now() - F.make_dt_interval(secs=F.when(number % 400 == 0, 7200).otherwise(600).cast("decimal(18,6)"))).alias("ts"),
        F.concat(F.lit("cached "), number.cast("string")).alias("value"),
        F.lit(models.ANSWER_TTL_S).alias("ttl_s"),
    )
    return models.cached_answers(asked, cache, models.StubModel(), now())


@query
def rag_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir)[0].select("query_id", "cache_key", "reply", "status")


@query
def rag_cache_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir)[1].withColumn("ts", D.iso(F.col("ts")))


@query
def doc_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    patches = S.changes_v(spark, sf_dir).filter("op = 'patch'")
    return changes.apply_patches(S.documents_v(spark, sf_dir), patches).select("id", "title", "content", "folder_id", D.iso(F.col("updated_at")).alias("updated_at"))


@query
def doc_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.latest(S.changes_v(spark, sf_dir)).withColumns({c: D.iso(F.col(c)) for c in ("created_at", "updated_at")})


@query
def index_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.index_rows(S.changes_v(spark, sf_dir))


@query
def index_pile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.index_rows(S.changes_v(spark, sf_dir), replace=False)


@query
def index_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index as it is kept in production: header sections cut recursively."""
    return changes.index_rows(S.changes_v(spark, sf_dir), chunker=chunking.chunk_documents).withColumn("headers", F.to_json("headers"))


@query
def list_cache_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What requests for the cached document list see; every document change deletes it."""
    events = S.read(spark, sf_dir, "events")
    lists = events.select(
        F.col("event_id").alias("op_id"),
        F.lit("documents_list").alias("key"),
        F.when(F.col("event_id") % 4 == 0, "put").otherwise("get").alias("op"),
        "ts",
        "value",
        F.lit(300).alias("ttl_s"),
    )
    return temporal.ttl_reads(lists.unionByName(temporal.invalidations(S.changes_v(spark, sf_dir)))).drop("ts")


@query
def completion_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completions that 250 ms of quiet after a keystroke start."""
    keys = S.read(spark, sf_dir, "events").select(
        F.col("user_id").alias("doc_id"), (F.col("ts") + F.make_dt_interval(secs=(F.col("event_id") % 4 / 8).cast("decimal(18,6)"))).alias("ts"), F.col("event_id").alias("edit_id"),
        F.col("event_type").alias("content"), F.lit(False).alias("is_composing"),
    )
    bursts = temporal.debounced_wide(keys, 0.25, bucket="hour")
    return bursts.select("doc_id", F.date_format("last_ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("last_ts"), "content", "n_edits")


@query
def body_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request bodies that hold a content or don't."""
    body = F.when(F.col("turn") % 2 == 0, F.to_json(F.struct(F.col("text").alias("content")))).otherwise(F.to_json(F.struct("role")))
    return S.read(spark, sf_dir, "conversations").select("conv_id", "turn", X.body_text(body, "content").alias("content"))


@query
def completion_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.when(F.col("page_id") % 3 == 0, F.lit(None)).when(F.col("page_id") % 3 == 1, F.concat("url", F.lit("//"))).otherwise(F.col("url"))
    return S.read(spark, sf_dir, "pages").select("page_id", X.completion_url(base, "http://local/v1/completions").alias("address"))


@query
def date_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as text, naive or with an offset, shown in a zone."""
    i, shown = F.col("event_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(i % 4 == 0, shown).when(i % 4 == 1, F.concat(shown, F.lit("Z"))).when(i % 4 == 2, F.concat(shown, F.lit("+02:00")))
    return S.read(spark, sf_dir, "events").select("event_id", D.local_text(D.parsed_utc(text), "Asia/Shanghai").alias("shown"))


@query
def chunk_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with the embeddings of the offline model."""
    chunks = chunking.fixed_chunks(S.documents_v(spark, sf_dir)).drop("source")
    return models.with_embeddings(chunks, models.StubModel()).select("doc_id", "chunk_no", F.size("embedding").alias("dim"), F.round(F.get("embedding", F.lit(0)).cast("double"), 4).alias("first"))


@query
def audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = S.changes_v(spark, sf_dir)
    return audit.audit_rows(log, details=F.concat(F.lit("version "), F.col("version").cast("string"))).withColumn("timestamp", D.iso(F.col("timestamp")))


@query
def system_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.system_logs_v(spark, sf_dir).drop("timestamp")


@query
def request_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.logged_requests(S.requests_v(spark, sf_dir)).select("id", "url", "duration_ms")


@query
def debounced_saves(spark: SparkSession, sf_dir: str) -> DataFrame:
    saves = temporal.debounced_wide(S.edits_v(spark, sf_dir), 1800)
    return saves.withColumns({c: D.iso(F.col(c)) for c in ("first_ts", "last_ts")})


@query
def latest_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.latest_per_key(S.read(spark, sf_dir, "events"), "user_id", "event_id", "event_type")


@query
def ttl_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.ttl_reads(S.cache_ops_v(spark, sf_dir)).drop("ts")


@query
def completion_postprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("turn") % 3
    choices = F.to_json(F.struct(F.array(F.struct("text")).alias("choices")))
    content = F.to_json(F.struct(F.col("text").alias("content")))
    raw = F.when(kind == 0, choices).when(kind == 1, content).otherwise('{"choices":[]}')
    return S.read(spark, sf_dir, "conversations").select("conv_id", "turn", X.first_phrase(X.reply_text(raw)).alias("completion"))


@query
def completion_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    fence = F.when(F.col("turn") % 3 == 0, "\n```python\nx = 1").when(F.col("turn") % 3 == 1, "\n```sql\nSELECT 1").otherwise("")
    return S.read(spark, sf_dir, "conversations").select("conv_id", "turn", X.completion_budget(F.concat("text", fence)).alias("max_tokens"))
