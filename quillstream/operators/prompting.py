"""Context assembly: budgeted blocks, source notices, prompts, offline answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions.answer import offline
from quillstream.operators.templates import TEMPLATES

CHUNKS, CHARS = 8, 5000

# Rules that every prompt carries. Fixed values.
NO_CONTEXT = "【注意】当前没有任何可用参考资料。如果无法从资料中得到答案，请明确回复“资料不足，无法回答该问题”。"
CITE = "【重要引用规则】\n1. 回答时请在相关句子后标注引用编号，例如：[1]、[2]。\n2. 【关键规则】如果多个引用编号来自同一个文档（即具有相同的文档ID），且回答的内容都来自该文档，**必须只标注一个最小的引用编号**（例如：[1]），不要重复标注该文档的其他编号。\n3. 只能使用提供的引用编号，不要编造参考资料，不要伪造编号。"
STYLE = "请优先给出简洁结论，再给出依据。如果只能部分回答，请明确指出哪些内容来自资料，哪些内容资料中未提及。不要把推测写成确定事实。"
NOTICE = "【参考资料说明】\n以下参考资料中，相同文档ID的多个条目来自同一个文档的不同部分。\n请根据内容相关性选择合适的引用编号。\n"
EMPTY_CONTEXT = "（无可用参考资料）"


def block(n: Column, document: Column, chunk: Column, retriever: Column, text: Column) -> Column:
    unknown = F.lit("unknown")
    doc = F.when(F.coalesce(document.cast("string"), F.lit("")) == "", unknown).otherwise(document.cast("string"))
    return F.concat(F.lit("["), n.cast("string"), F.lit("]\n来源文档: "), doc, F.lit("\n分块序号: "), F.coalesce(chunk.cast("string"), unknown), F.lit("\n检索方式: "), F.coalesce(retriever, unknown), F.lit("\n内容:\n"), F.trim(F.coalesce(text, F.lit(""))))


def key(document: Column, chunk: Column, id_: Column) -> Column:
    """What makes two hits one."""
    return F.when(document.isNotNull() & chunk.isNotNull(), F.concat(document.cast("string"), F.lit("::chunk::"), chunk.cast("string"))).otherwise(F.concat(F.lit("id::"), id_.cast("string")))


def budgeted(hits: DataFrame, chunks: int = CHUNKS, chars: int = CHARS) -> DataFrame:
    """hits (query_id, rank, id, document_id, chunk_index, retriever, text) that fit:
    first of each key, at most ``chunks``, blocks together at most ``chars``."""
    same = Window.partitionBy("query_id", "k").orderBy("rank")
    order = Window.partitionBy("query_id").orderBy("rank")
    out = hits.withColumn("k", key(F.col("document_id"), F.col("chunk_index"), F.col("id"))).withColumn("n", F.row_number().over(same)).where("n = 1")
    out = out.withColumn("n", F.row_number().over(order)).where(F.col("n") <= chunks)
    out = out.withColumn("block", block(F.col("n"), F.col("document_id"), F.col("chunk_index"), F.col("retriever"), F.col("text")))
    return out.withColumn("used", F.sum(F.length("block")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where(F.col("used") <= chars).drop("k")


def contexts(kept: DataFrame) -> DataFrame:
    """query_id, context, n_citations, notice of the budgeted blocks."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "block"))), lambda x: x["block"]), "\n\n")
    blocks = kept.groupBy("query_id").agg(joined.alias("context"), F.count("*").alias("n_citations"))
    source = F.coalesce(F.min_by("source_info", "n"), F.lit("未知来源"))
    per = kept.where(F.col("document_id").isNotNull()).groupBy("query_id", "document_id").agg(F.array_sort(F.collect_list("n")).alias("ns"), source.alias("source"), F.min("n").alias("first"))
    line = F.when(F.size("ns") > 1, F.concat(F.lit("\n- 文档（来源: "), F.col("source"), F.lit("）包含分块: ["), F.array_join(F.col("ns").cast("array<string>"), ", "), F.lit("]")))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", line.alias("l")))), lambda x: x["l"]), "")
    notices = per.groupBy("query_id").agg(F.concat(F.lit(NOTICE), lines).alias("notice"))
    return blocks.join(notices, "query_id", "left").withColumn("notice", F.coalesce("notice", F.lit("")))


def _by_intent(intent: Column, make) -> Column:
    """A column for each intent's template; those without one take the default."""
    out = make(*TEMPLATES["default"])
    for k, v in TEMPLATES.items():
        if k != "default":
            out = F.when(intent == k, make(*v)).otherwise(out)
    return out


def prompts(queries: DataFrame, context: DataFrame) -> DataFrame:
    """query_id, system_prompt, user_prompt of queries (query_id, question, intent)."""
    j = queries.join(context, "query_id", "left")
    text = F.coalesce("context", F.lit(""))
    empty = F.trim(text) == ""
    intent, shown = F.coalesce("intent", F.lit("default")), F.when(empty, EMPTY_CONTEXT).otherwise(text)

    def user(_, template: str) -> Column:
        before, after = template.split("{question}")
        between, last = after.split("{context}")
        return F.concat(F.lit(before), F.col("question"), F.lit(between), shown, F.lit(last))

    system = F.concat_ws("\n", _by_intent(intent, lambda s, _: F.lit(s)), F.when(empty, NO_CONTEXT), F.lit(CITE), F.lit(STYLE))
    notice = F.coalesce("notice", F.lit(""))
    return j.select("query_id", F.when(notice != "", F.concat(system, F.lit("\n\n"), notice)).otherwise(system).alias("system_prompt"), _by_intent(intent, user).alias("user_prompt"), F.coalesce("n_citations", F.lit(0)).alias("n_citations"))


def offline_answer(hits: DataFrame, most: int = 3, limit: int = 200, asked: DataFrame | None = None) -> DataFrame:
    """query_id, answer without a language model: the first texts joined and cut. With
    ``asked`` (query_id) queries without a hit are told so, otherwise they are left out."""
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), " ")
    out = hits.where((F.col("rank") <= most) & (F.coalesce("text", F.lit("")) != "")).groupBy("query_id").agg(texts.alias("t"))
    if asked is not None:
        out = asked.select("query_id").distinct().join(out, "query_id", "left")
    cut = F.when(F.length("t") > limit, F.concat(F.left("t", F.lit(limit)), F.lit("..."))).otherwise(F.col("t"))
    return out.select("query_id", offline(cut).alias("answer"))
