"""Question planning: intent, sub-questions, resolution against the conversation, scope."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text as tx

#: Words that tell an intent, in the order in which they are tried.
INTENTS = [
    ("related_work", ["相关工作", "参考文献", "related work", "citation"]),
    ("comparison", ["比较", "区别", "异同", "compare", "versus", " vs "]),
    ("innovation", ["创新", "贡献", "novel", "contribution"]),
    ("method", ["方法", "模型", "算法", "method", "architecture", "algorithm"]),
    ("summary", ["总结", "概括", "摘要", "summary", "summarize"]),
]
#: The content types that an intent prefers.
PREFERENCES = {
    "method": ["text", "formula", "table", "caption"], "innovation": ["text", "heading"], "comparison": ["text", "table"],
    "related_work": ["reference", "text"], "summary": ["heading", "text"], "factual": ["text", "table", "formula"],
}
#: How a question that follows up begins, pronouns for a paper, and separators of sub-questions.
FOLLOW_UPS = ["为什么", "怎么", "如何", "那", "那么", "还有", "why", "how", "what about"]
PRONOUN = r"(?i)(?:这|那|该)(?:篇|个)?(?:论文|文章|文献)|它(?:的|们)?|this paper"
SEPARATORS = "(?i)[；;？?]|(?:并且|以及|同时|and also|and then)"
EDGE = " ，,。；;？?"
#: What is said when a question can't be planned.
AMBIGUOUS = "The referenced paper is ambiguous within the current scope"
UNSCOPED = "No paper is selected for selected-paper scope"
MOST = 4


def intent(question: Column) -> Column:
    low = tx.casefold(question)
    rules = [(name, reduce(Column.__or__, [F.contains(low, F.lit(w)) for w in words])) for name, words in INTENTS]
    return F.coalesce(*[F.when(test, F.lit(name)) for name, test in rules], F.lit("factual"))


def preferences(kind: Column) -> Column:
    lists = F.create_map(*[x for k, v in PREFERENCES.items() for x in (F.lit(k), F.array(*[F.lit(n) for n in v]))])
    return F.element_at(lists, kind)


def subquestions(question: Column) -> Column:
    """The question and its parts, distinct, four at most."""
    parts = F.transform(F.split(question, SEPARATORS), lambda p: F.btrim(p, F.lit(EDGE)))
    return F.slice(F.array_distinct(F.concat(F.array(question), F.filter(parts, lambda p: p != ""))), 1, MOST)


def follows_up(question: Column) -> Column:
    low = tx.casefold(tx.stripped(question))
    return reduce(Column.__or__, [F.startswith(low, F.lit(x)) for x in FOLLOW_UPS])


def plan(questions: DataFrame) -> DataFrame:
    """``questions`` (question, paper_ids, previous; scope_mode): adds error, intent, resolved, subqueries, preferences, include_references, clarification.

    ``paper_ids`` are the selected papers (scope_mode selected, also where it isn't given) or the
    library's. A blank question or another mode is an ``error``. A pronoun for a paper needs exactly
    one; then the question names it. A follow-up is put after the previous question. The intent is
    that of the resolved question. An ambiguous pronoun, then an empty selection, need clarification:
    such a plan has no sub-questions, preferences or references.
    """
    if "scope_mode" not in questions.columns:
        questions = questions.withColumn("scope_mode", F.lit("selected"))
    q = tx.stripped(F.coalesce("question", F.lit("")))
    papers = F.array_distinct(F.coalesce("paper_ids", F.array().cast("array<string>")))
    mode = F.coalesce("scope_mode", F.lit("selected"))
    error = F.when(q == "", "empty_question").when(~mode.isin("selected", "library"), "unknown_scope_mode")
    pronoun, one = q.rlike(PRONOUN), F.size(papers) == 1
    clarify = F.when(error.isNull(), F.when(pronoun & ~one, AMBIGUOUS).when((mode == "selected") & (F.size(papers) == 0), UNSCOPED))
    resolved = (
        F.when(clarify.isNotNull(), q)
        .when(pronoun & one, F.concat(q, F.lit(" [paper_id="), F.get(papers, F.lit(0)), F.lit("]")))
        .when(follows_up(q) & F.col("previous").isNotNull(), F.concat("previous", F.lit("；追问："), q))
        .otherwise(q)
    )
    none = F.array().cast("array<string>")
    ready = error.isNull() & clarify.isNull()
    first = questions.withColumn("paper_ids", papers).withColumn("error", error).withColumn("clarification", clarify).withColumn("resolved", resolved)
    kind = first.withColumn("intent", intent(F.col("resolved"))).withColumn("_ready", ready)
    return kind.select(
        *[c for c in kind.columns if c not in ("_ready", "clarification")],
        F.when(F.col("_ready"), subquestions(F.col("resolved"))).otherwise(none).alias("subqueries"),
        F.when(F.col("_ready"), preferences(F.col("intent"))).otherwise(none).alias("preferences"),
        (F.col("_ready") & (F.col("intent") == "related_work")).alias("include_references"), "clarification",
    )
