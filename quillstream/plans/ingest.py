"""From files to vector rows, and from questions to prompts and answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions import answer, chunk, filetype, text, understanding
from quillstream.functions.embedding import Embedder, hashed
from quillstream.operators import metadata, parsing, prompting, ranking, vector
from quillstream.sources import stores

Parser = Callable[[DataFrame], DataFrame]
#: Parser by the name that routing gives; each takes doc_id and text.
PARSERS: dict[str, Parser] = {"plain_text": parsing.plain_elements, "markdown": lambda df: parsing.markdown_elements(df).drop("heading_id")}


def register_parser(name: str, parser: Parser) -> None:
    """A parser of one's own: doc_id and text to elements."""
    PARSERS[name] = parser


def routed(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files (doc_id, name, content) to elements of all parsers, and to rejects with their reason."""
    kind = F.when(F.octet_length("content") > filetype.UPLOAD_LIMIT, "too_large").otherwise(filetype.parser_of(F.col("name")))
    told = files.withColumns({"parser": kind, "text": F.try_to_binary(F.hex("content"), F.lit("hex"))}).withColumn("text", F.col("text").cast("string"))
    out = None
    for name, parser in PARSERS.items():
        part = parser(told.where(F.col("parser") == name).select("doc_id", "text"))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)  # a parser of one's own may give no row_id
    return out, told.where(~F.col("parser").isin(*PARSERS)).select("doc_id", "name", F.col("parser").alias("reason"))


def chunks(docs: DataFrame, how: text.Cleaning = text.DEFAULT, elements: DataFrame | None = None) -> DataFrame:
    """Documents (doc_id, text), or their elements, cleaned, merged and chunked, with overlaps."""
    e = (parsing.plain_elements(docs) if elements is None else elements).withColumn("raw_content", text.clean(F.col("raw_content"), how))
    e = parsing.merge_headings(e)
    own = parsing.whose(e)
    # An element's chunks are in its row, and so is what overlaps.
    parts = e.select(*own, "element_index", "element_type", "structure_path", "parser_confidence", chunk.by_element(F.col("raw_content"), F.col("element_type")).alias("parts"))
    near = F.transform("parts", lambda t, i: text.named(
        t=t, prefix=F.coalesce(F.right(F.get(F.col("parts"), i - 1), F.lit(chunk.OVERLAP)), F.lit("")),
        suffix=F.when(i == 0, "").otherwise(F.coalesce(F.left(F.get(F.col("parts"), i + 1), F.lit(chunk.OVERLAP)), F.lit(""))),
    ))
    cut = parts.select(*own, "element_index", "element_type", "structure_path", "parser_confidence", F.posexplode(near).alias("local", "c"))
    cut = cut.select("*", F.col("c.t").alias("t"), F.col("c.prefix").alias("overlap_prefix"), F.col("c.suffix").alias("overlap_suffix"))
    number = F.row_number().over(Window.partitionBy(*own).orderBy("element_index", "local")) - 1
    return cut.select(
        "doc_id", number.alias("chunk_index"), F.concat("overlap_prefix", "t").alias("text"), "element_type", chunk.chunk_type(F.col("element_type")).alias("chunk_type"), "structure_path",
        "overlap_prefix", "overlap_suffix", (F.col("overlap_prefix") != "").alias("has_overlap"), F.length("t").alias("original_size"), F.col("parser_confidence").alias("confidence"),
    )


def vectors(chunked: DataFrame, kb: Column, uploader: Column, source_type: Column, ts: Column, embed: Embedder | None = None, custom: Column | None = None) -> DataFrame:
    """Chunks as vector rows, ready for :class:`VectorStore`; ``custom`` is a map or a JSON text of one's own for each."""
    rows = chunked.select(F.col("doc_id").cast("string").alias("document_id"), "chunk_index", "text", (embed or hashed())(F.col("text")).alias("embedding"), "structure_path", (F.col("bbox") if "bbox" in chunked.columns else F.lit(None)).cast("array<int>").alias("bbox"), (custom if custom is not None else F.lit(None).cast("string")).alias("custom_metadata"), source_type.alias("source_type"), uploader.alias("uploader_id"), kb.alias("knowledge_base_id"))
    return stores.vector_rows(rows, ts)


def ask(questions: DataFrame, stored: DataFrame, k: int = 8, threshold: float | None = None, embed: Embedder | None = None, members: DataFrame | None = None) -> DataFrame:
    """questions (query_id, question, kb) against vector rows: both prompts, the
    offline answer and its quality, for any number of questions at once. With
    ``members`` (group_id, user_id) and user_id of the questions only members of a
    knowledge base are answered: the others have no hits and allowed is false."""
    questions = questions.withColumn("allowed", F.lit(True)) if members is None else metadata.allowed(questions, members)
    q = questions.select("query_id", "question", "kb", "allowed", understanding.expand(F.col("question"))["expanded"].alias("expanded"), (embed or hashed())(F.col("question")).alias("embedding"))
    q = q.withColumns({"intent": understanding.intent(F.col("expanded"))["intent"], "rewritten": understanding.rewrite(F.col("expanded"), F.col("kb"))["rewritten"]})
    rows = stored.where("id <> '' AND trim(document) <> ''").withColumn("n", F.xxhash64("knowledge_base_id", "id"))
    hits = vector.nearest(q.where("allowed"), rows.select(F.col("n").alias("id"), "embedding", F.col("knowledge_base_id").alias("kb")), k)
    if threshold is not None:
        hits = hits.where(F.col("score") >= threshold)
    full = hits.join(rows.select(F.col("n").alias("id"), F.col("document").alias("text"), "document_id", "chunk_index", "source_info", vector.hit_fields(F.col("bbox"))["y_top"].alias("y_top")), "id")
    full = full.join(q.select("query_id", "rewritten"), "query_id")
    best = ranking.rerank(full, "rewritten", k).drop("rank").withColumnRenamed("new_rank", "rank").withColumn("retriever", F.lit("vector"))
    prompt = prompting.prompts(q.select("query_id", "question", "intent"), prompting.contexts(prompting.budgeted(best)))
    out = prompt.join(prompting.offline_answer(best, asked=q), "query_id", "left")
    out = out.join(q.select("query_id", "allowed"), "query_id")
    return out.withColumn("quality", answer.quality(F.col("answer"), F.col("n_citations")))


def counted(documents: DataFrame, size: int = 500) -> DataFrame:
    """What upload_result() tells of documents (doc_id, text) as they are parsed and cut by default, in one
    pass over them: lines that are not blank, and slices of ``size`` characters."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    n_elements = F.size(F.filter(lines, lambda x: text.strip(x) != "")).cast("long")
    n_chunks = F.ceil(F.length(F.coalesce("text", F.lit(""))) / size).cast("long")
    return documents.select("doc_id", F.when(n_chunks > 0, "success").otherwise("empty").alias("status"), n_elements.alias("n_elements"), n_chunks.alias("n_chunks"))


def upload_result(documents: DataFrame, elements: DataFrame, chunked: DataFrame) -> DataFrame:
    """doc_id, status, n_elements and n_chunks of each document; one without a chunk is empty."""
    count = lambda df, name: df.groupBy("doc_id").agg(F.count("*").alias(name))
    out = documents.select("doc_id").distinct().join(count(elements, "n_elements"), "doc_id", "left").join(count(chunked, "n_chunks"), "doc_id", "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", F.when(F.col("n_chunks") > 0, "success").otherwise("empty").alias("status"), F.coalesce("n_elements", zero).alias("n_elements"), F.coalesce("n_chunks", zero).alias("n_chunks"))
