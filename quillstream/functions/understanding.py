"""Query understanding: language, intent, expansion, rewriting, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstream.functions.text import collapse, let, named, strip

# Intents in the order that decides ties. Fixed values.
INTENTS = ("fact_qa", "summarize", "compare", "howto", "troubleshoot", "explain", "definition", "list", "smalltalk", "unknown")
#: intent, weight, keywords. Fixed values.
LEXICON = (
    ("summarize", 2.0, ("总结", "概括", "梳理", "提炼", "总结一下", "summary", "summarize", "overview", "tl;dr")),
    ("compare", 2.0, ("对比", "比较", "差异", "区别", "哪个好", "优缺点", "compare", "difference", "vs", "versus")),
    ("howto", 1.8, ("怎么做", "如何", "步骤", "流程", "实现", "部署", "配置", "how to", "steps", "guide", "setup")),
    ("troubleshoot", 2.2, ("报错", "错误", "异常", "失败", "无法", "怎么解决", "error", "exception", "failed", "doesn't work")),
    ("definition", 1.6, ("是什么", "定义", "含义", "what is", "define", "definition")),
    ("explain", 1.5, ("为什么", "原理", "机制", "怎么回事", "why", "how it works", "principle")),
    ("list", 1.3, ("列出", "有哪些", "列表", "清单", "list", "items", "what are")),
    ("fact_qa", 1.0, ("多少", "谁", "哪里", "何时", "哪个", "what", "when", "where", "who", "which")),
    ("smalltalk", 1.0, ("你好", "在吗", "哈哈", "谢谢", "hello", "hi", "thanks")),
)
QUESTION_WORDS = ("什么", "怎么", "如何", "哪个", "what", "how", "where", "when", "why")
#: intent and the characters that raise it in very short queries. Fixed values.
SHORT = (("fact_qa", "什么哪谁哪里怎么如何为何"), ("definition", "定义解释意思含义"), ("list", "列表列举都有哪些"), ("howto", "怎么做如何操作步骤流程"))

# Expansion: abbreviation and its long form; keyword and its first phrase. Fixed values.
ABBREVIATIONS = (("API", "应用程序编程接口"), ("JWT", "JSON Web Token"), ("ORM", "对象关系映射"), ("RAG", "检索增强生成"), ("LLM", "大型语言模型"), ("QA", "问答系统"))
EXPANSIONS = (
    ("前端", "前端技术"), ("后端", "后端技术"), ("API", "API接口"), ("数据库", "数据库系统"), ("架构", "系统架构"), ("模型", "AI模型"),
    ("上传", "如何上传"), ("下载", "如何下载"), ("配置", "如何配置"), ("部署", "如何部署"), ("解决", "如何解决"), ("修复", "如何修复"), ("处理", "如何处理"),
    ("定义", "XX的定义"), ("意思", "XX的意思"), ("含义", "XX的含义"), ("解释", "XX的解释"),
)
DEFINITION_CHARS, HOW_CHARS = "什么是什么意思含义解释", "如何怎样怎么操作步骤"

# Rewriting. Fixed values.
FILLERS = ("请问", "麻烦", "帮我", "一下", "可以", "请", "谢谢")
SYNONYMS = (("RAG", ("检索增强生成", "Retrieval Augmented Generation")), ("向量库", ("vector database", "vectordb")), ("ChromaDB", ("chroma", "chromadb")), ("embedding", ("向量", "嵌入")))

TOKEN = r"[a-z0-9]+(?:[._-][a-z0-9]+)*"


def _any_of(c: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def _has_char(c: Column, chars: str) -> Column:
    return c.rlike(f"[{''.join(dict.fromkeys(chars))}]")


def language(c: Column) -> Column:
    zh, en = c.rlike(r"[\x{4e00}-\x{9fff}]"), c.rlike("[a-zA-Z]")
    return F.when(zh & en, "mixed").when(zh, "zh").when(en, "en").otherwise("unknown")


def _lexicon_scores(c: Column) -> Column:
    """Sums of keyword weights in the order of the intents."""
    low = F.lower(c)
    sums = dict.fromkeys(INTENTS, F.lit(0.0))
    for name, weight, keywords in LEXICON:
        for k in keywords:
            sums[name] = sums[name] + F.when(low.contains(k), weight).otherwise(0.0)
    n = F.when(F.length(c) <= 10, 0.4).otherwise(0.0) + F.when(c.rlike("[?？]"), 0.3).otherwise(0.0)
    sums["fact_qa"] = sums["fact_qa"] + n
    return F.array(*sums.values())


def _final_scores(c: Column, base: Column) -> Column:
    """The sums with what is added to queries without keywords and to very short ones."""
    hit = lambda test, w: F.when(test, w).otherwise(0.0)
    s = {name: base[i] for i, name in enumerate(INTENTS)}
    none, short = F.aggregate(base, F.lit(0.0), lambda a, x: a + x) == 0, F.length(c) <= 5
    s["fact_qa"] = F.when(none & _any_of(F.lower(c), QUESTION_WORDS), 0.5).when(none & (F.length(c) > 5), 0.3).otherwise(s["fact_qa"]) + hit(short & c.rlike("[0-9]"), 0.2)
    for name, chars in SHORT:
        s[name] = s[name] + hit(short & _has_char(c, chars), 0.3)
    return F.array_sort(F.array(*[named(neg=-F.round(x, 6), ord=F.lit(i), name=F.lit(name)) for i, (name, x) in enumerate(s.items())]))


def intent(query: Column) -> Column:
    """struct(intent, score, confidence, signals, language): the best intent, ties
    by declaration; signals map the three best with a score to it."""

    def told(c: Column, ranked: Column) -> Column:
        empty, best = c == "", ranked[0]
        return named(
            intent=F.when(empty, "unknown").otherwise(best["name"]),
            score=F.when(empty, 0.0).otherwise(-best["neg"]),
            confidence=F.when(empty, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.2), -best["neg"] / 2))),
            signals=F.map_from_entries(F.transform(F.filter(F.slice(ranked, 1, 3), lambda x: (x["neg"] < 0) & ~empty), lambda x: named(key=x["name"], value=-x["neg"]))),
            language=F.when(empty, "unknown").otherwise(language(c)),
        )

    return let(strip(F.coalesce(query, F.lit(""))), lambda c: let(_lexicon_scores(c), lambda base: let(_final_scores(c, base), lambda ranked: told(c, ranked))))


def _long_form(c: Column) -> Column:
    """struct(text, note): the first abbreviation written out."""
    text, note = c, F.lit(None).cast("string")
    for short, long_ in reversed(ABBREVIATIONS):
        text = F.when(c.contains(short), F.replace(c, F.lit(short), F.lit(long_))).otherwise(text)
        note = F.when(c.contains(short), f"{short} -> {long_}").otherwise(note)
    return named(text=text, note=note)


def expand(query: Column) -> Column:
    """struct(expanded, terms, confidence)."""
    nothing = F.array().cast("array<string>")

    def phrase(text: Column, keyword: str, first: str) -> Column:
        full = F.replace(F.lit(first), F.lit("XX"), F.replace(text, F.lit(keyword), F.lit("XX")))
        return let(full, lambda f: F.when(F.lower(text).contains(keyword.lower()) & (f != text), named(phrase=f, note=F.concat(F.lit(f"'{keyword}' -> '"), f, F.lit("'")))))

    def variants(c: Column) -> Column:
        """struct(phrases, note) for short queries that no keyword fits."""
        add = lambda note, *phrases: named(phrases=F.array(*phrases), note=F.lit(note))
        what = add("添加定义查询", F.concat(c, F.lit("的相关定义")), F.concat(c, F.lit("的具体含义")))
        how = add("添加操作查询", F.concat(F.lit("关于"), c, F.lit("的操作方法")), F.concat(c, F.lit("的实现步骤")))
        other = add("添加常见查询变体", *[F.concat(c, F.lit(x)) for x in ("是什么", "有什么", "如何", "的作用")])
        return F.when(_has_char(c, DEFINITION_CHARS), what).when(_has_char(c, HOW_CHARS), how).when(~c.rlike("[?？]"), other)

    def told(c: Column, long_: Column, found: Column, more: Column) -> Column:
        phrases = F.concat(F.transform(found, lambda x: x["phrase"]), F.coalesce(more["phrases"], nothing))
        terms = F.array_compact(F.concat(F.array(long_["note"]), F.transform(found, lambda x: x["note"]), F.array(more["note"])))
        return named(
            expanded=F.when(c == "", c).otherwise(strip(F.when(F.size(phrases) > 0, F.concat(long_["text"], F.lit(" "), F.array_join(phrases, " "))).otherwise(long_["text"]))),
            terms=F.when(c == "", nothing).otherwise(terms),
            confidence=F.when(c == "", 0.0).otherwise(F.round(F.least(F.lit(0.9), 0.3 + F.size(terms) * 0.2), 6)),
        )

    def second(c: Column, long_: Column) -> Column:
        found = F.array_compact(F.array(*[phrase(long_["text"], k, p) for k, p in EXPANSIONS]))
        return let(found, lambda f: let(F.when((F.length(c) <= 10) & (F.size(f) == 0), variants(c)), lambda more: told(c, long_, f, more)))

    return let(strip(query), lambda c: let(_long_form(c), lambda long_: second(c, long_)))


def synonyms(query: Column) -> Column:
    """At most five variants, in order, each once."""
    low, out = F.lower(query), []
    for key, others in SYNONYMS:
        has = low.contains(key.lower())
        out += [F.when(has, F.replace(query, F.lit(key), F.lit(s))) for s in others]
        out += [F.when(~has & low.contains(s.lower()), F.replace(query, F.lit(s), F.lit(key))) for s in others]
    return F.slice(F.array_distinct(F.array_compact(F.array(*out))), 1, 5)


def rewrite(query: Column, kb: Column | None = None, kind: Column | None = None) -> Column:
    """struct(rewritten, rules, expansions, warnings)."""
    none, nothing = F.lit(None).cast("string"), F.array().cast("array<string>")
    hint = lambda name, v: none if v is None else F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(name), v))
    parts = F.array_compact(F.array(hint("kb:", kb), hint("type:", kind)))

    def bare(c: Column) -> Column:
        for f in FILLERS:
            c = F.replace(c, F.lit(f), F.lit(""))
        return collapse(c)

    def told(first: Column, spaced: Column, marked: Column, clear: Column, hints: Column, more: Column) -> Column:
        full = F.when(F.size(hints) > 0, F.concat(clear, F.lit(" ("), F.array_join(hints, " "), F.lit(")"))).otherwise(clear)
        rules = F.array_compact(F.array(F.when(spaced != first, "normalize_whitespace"), F.when(marked != spaced, "normalize_punctuation"), F.when(clear != marked, "remove_fillers"), F.when(F.size(hints) > 0, "append_hints"), F.when(F.size(more) > 0, "synonym_expansion")))
        empty = first == ""
        return named(
            rewritten=F.when(empty, "").otherwise(full),
            rules=F.when(empty, nothing).otherwise(rules),
            expansions=F.when(empty, nothing).otherwise(more),
            warnings=F.when(empty, F.array(F.lit("空查询"))).when(F.length(full) < 2, F.array(F.lit("重写后查询过短"))).otherwise(nothing),
        )

    return let(
        strip(F.coalesce(query, F.lit(""))),
        lambda a: let(collapse(a), lambda b: let(F.translate(b, "，。？", ",.?"), lambda c: let(bare(c), lambda d: let(parts, lambda h: let(synonyms(a), lambda m: told(a, b, c, d, h, m)))))),
    )


def bigrams(c: Column) -> Column:
    """Runs of Chinese characters as overlapping pairs; a lone character is itself.
    The segmenter that needs no dictionary; tokens() takes any other."""
    runs = F.regexp_extract_all(c, F.lit(r"([\x{4e00}-\x{9fff}]+)"), 1)
    pairs = lambda r: F.when(F.length(r) < 2, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2))))
    return F.flatten(F.transform(runs, pairs))


def tokens(c: Column, segment=bigrams) -> Column:
    """Distinct lower-case tokens in order, Chinese ones first; single characters only
    if digits or Chinese. ``segment`` makes words of a lower-case text's Chinese."""

    def split(low: Column) -> Column:
        found = F.regexp_extract_all(low, F.lit(f"({TOKEN})"), 1)
        latin = F.filter(found, lambda t: (F.length(t) > 1) | t.rlike("^[0-9]$"))
        return F.array_distinct(F.when(low.rlike(r"[\x{4e00}-\x{9fff}]"), F.concat(segment(low), latin)).otherwise(latin))

    return let(F.lower(F.coalesce(c, F.lit(""))), split)


def segmented_tokens(c: Column, segment) -> Column:
    """tokens() by a segmenter that is a Python function, which may not stand inside a lambda."""
    low = F.lower(F.coalesce(c, F.lit("")))
    latin = F.filter(F.regexp_extract_all(low, F.lit(f"({TOKEN})"), 1), lambda t: (F.length(t) > 1) | t.rlike("^[0-9]$"))
    return F.array_distinct(F.concat(segment(low), latin))


__all__ = ["expand", "intent", "language", "rewrite", "synonyms", "tokens"]
