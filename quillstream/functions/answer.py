"""Citations, answer quality and offline answers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstream.functions.text import strip


def used_citations(answer: Column) -> Column:
    """Sorted distinct numbers in square brackets."""
    found = F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"\[(\d+)\]"), 1)
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, lambda x: x.try_cast("int")), lambda x: x.isNotNull())))


def citation_check(answer: Column, known: Column) -> Column:
    """struct(used, unused, issues, valid) against the known numbers."""
    used = used_citations(answer)
    wrong = F.array_except(used, known)
    issues = F.array_compact(
        F.array(
            F.when(F.size(used) == 0, "回答中未发现任何引用标记"),
            F.when(F.size(wrong) > 0, F.concat(F.lit("回答中使用了不存在的引用编号: ["), F.array_join(wrong, ", "), F.lit("]"))),
        )
    )
    return F.struct(used.alias("used"), F.array_sort(F.array_except(known, used)).alias("unused"), issues.alias("issues"), (F.size(issues) == 0).alias("valid"))


def quality(answer: Column, n_citations: Column) -> Column:
    """struct(grounded, coverage, completeness, comments)."""
    n_used = F.size(used_citations(answer))
    empty = F.coalesce(answer, F.lit("")) == ""
    coverage = F.when(n_citations > 0, n_used / n_citations).otherwise(0.0)
    completeness = F.least(F.least(F.length(answer) / 300, F.lit(1.0)) + F.least(coverage * 0.5, F.lit(0.5)), F.lit(1.0))
    notes = F.array_compact(F.array(F.when(coverage < 0.3, "引用使用较少"), F.when(completeness < 0.4, "回答可能不够完整")))
    return F.struct(
        F.when(empty, 0.0).when(n_used > 0, 1.0).otherwise(0.3).alias("grounded"),
        F.when(~empty, F.round(coverage, 6)).alias("coverage"),
        F.when(~empty, F.round(completeness, 6)).alias("completeness"),
        F.when(empty, "回答为空").when(F.size(notes) > 0, F.array_join(notes, "；")).otherwise("评估正常").alias("comments"),
    )


# What is said without a language model, and where one fails. Fixed values.
FOUND = ("找到了相关资料，但语言模型服务暂不可用。\n\n相关摘要: ", "\n\n请稍后重试或联系管理员配置语言模型服务。")
NOT_FOUND = "未找到相关资料，且语言模型服务暂不可用。\n\n请确认知识库中有相关内容，或联系管理员配置语言模型服务。"
FAILED = ("LLM 调用失败，已降级返回检索资料片段。\n错误信息：", "\n\n")


def offline(preview: Column) -> Column:
    """The answer without a language model: what was found, or that nothing was."""
    return F.when(F.coalesce(preview, F.lit("")) == "", NOT_FOUND).otherwise(F.concat(F.lit(FOUND[0]), preview, F.lit(FOUND[1])))


def fallback(error: Column, context: Column, limit: int = 1200) -> Column:
    """What is answered where a language model fails: the error and the context, cut."""
    return F.left(strip(F.concat(F.lit(FAILED[0]), F.coalesce(error, F.lit("")), F.lit(FAILED[1]), F.coalesce(context, F.lit("")))), F.lit(limit))


def stream_delta(line: Column) -> Column:
    """Text of a line of a server-sent event stream; null for others and its end."""
    body = F.regexp_extract(line, r"^data:\s*(.*)$", 1)
    return F.when((body != "") & (F.trim(body) != "[DONE]"), F.get_json_object(body, "$.choices[0].delta.content"))
