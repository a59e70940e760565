"""Evidence, citations, sufficiency, claim checks, context budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as tx
from folioscope.operators import seams

#: The fields of a method, and the sections of each level of summary.
METHOD_FIELDS = ["objective", "inputs_outputs", "assumptions", "modules", "workflow", "training_objective", "data", "parameters", "evaluation"]
SECTIONS = {
    "quick": ["overview"], "standard": ["abstract", "method", "results", "limitations"],
    "detailed": ["abstract", "introduction", "method", "experiments", "conclusion", "limitations"],
}


def evidence_id(version, chunk, first, last) -> F.Column:
    return tx.stable_id(version, chunk, first, last, length=20, prefix="ev_")


def citation_label(title, version, first, last, section) -> F.Column:
    pages = F.when(first == last, F.concat(F.lit("p. "), first)).otherwise(F.concat(F.lit("pp. "), first, F.lit("-"), last))
    path = F.coalesce(F.nullif(F.array_join(section, " > "), F.lit("")), F.lit("Unsectioned"))
    return F.concat(title, F.lit(" ("), version, F.lit("), "), pages, F.lit(", "), path)


def evidence_budget(window: int, ratio: float = 0.5) -> int:
    """Tokens that evidence may take of a model's window; the ratio lies between 0.4 and 0.6."""
    if not 0.4 <= ratio <= 0.6:
        raise ValueError("the evidence ratio must lie between 0.4 and 0.6")
    if int(window * ratio) <= 0:
        raise ValueError("the model window must be positive")
    return int(window * ratio)


def good_enough(quality, least: float = 0.5) -> F.Column:
    """The quality gate: unknown qualities pass."""
    return quality.isNull() | (quality >= least)


def budgeted(proposals: DataFrame, budget: int) -> DataFrame:
    """(question_id, used, kept, omitted, items): proposals (question_id, ord, item_id, tokens, quality, content; paper_id, known) within a budget.

    In order; the first of an item counts. What isn't ``known``, is of low quality or doesn't fit is
    omitted; later smaller items may still fit; the same content of one paper is skipped without
    being listed. ``kept`` and ``omitted`` are lists of ids as text. A fold over each question's
    proposals, whose number the rerank limit bounds.
    """
    kind = dict(proposals.dtypes)["item_id"]
    for name, value in (("paper_id", F.lit("")), ("known", F.lit(True))):
        if name not in proposals.columns:
            proposals = proposals.withColumn(name, value)
    key = F.to_json(F.struct(F.coalesce(F.col("paper_id").cast("string"), F.lit("")).alias("p"), F.coalesce(tx.content_key(F.col("content")), F.lit("")).alias("c")))
    fine = F.coalesce("known", F.lit(False)) & good_enough(F.col("quality"))
    own = F.struct("ord", "item_id", F.col("tokens").cast("long").alias("tokens"), fine.alias("fine"), key.alias("key"))
    listed = proposals.groupBy("question_id").agg(F.array_sort(F.collect_list(own)).alias("items"))
    state = f"named_struct('used', 0L, 'kept', cast(array() as array<{kind}>), 'omitted', cast(array() as array<{kind}>), 'keys', cast(array() as array<string>), 'seen', cast(array() as array<{kind}>))"
    fold = f"""aggregate(items, {state}, (a, x) ->
      case when array_contains(a.seen, x.item_id) then a
        when not x.fine then named_struct('used', a.used, 'kept', a.kept, 'omitted', array_append(a.omitted, x.item_id), 'keys', a.keys, 'seen', array_append(a.seen, x.item_id))
        when array_contains(a.keys, x.key) then named_struct('used', a.used, 'kept', a.kept, 'omitted', a.omitted, 'keys', a.keys, 'seen', array_append(a.seen, x.item_id))
        when a.used + x.tokens > {int(budget)} then named_struct('used', a.used, 'kept', a.kept, 'omitted', array_append(a.omitted, x.item_id), 'keys', a.keys, 'seen', array_append(a.seen, x.item_id))
        else named_struct('used', a.used + x.tokens, 'kept', array_append(a.kept, x.item_id), 'omitted', a.omitted, 'keys', array_append(a.keys, x.key), 'seen', array_append(a.seen, x.item_id)) end)"""
    done = listed.select("question_id", F.expr(fold).alias("r"))
    return done.select("question_id", "r.used", F.array_join("r.kept", ",").alias("kept"), F.array_join("r.omitted", ",").alias("omitted"), F.col("r.kept").alias("items"))


def sufficiency(judged: DataFrame, least: float = 0.5) -> DataFrame:
    """Judgements (question_id, part, level; quality, ord) to each question's status: one unanswered part outweighs a conflict.

    Judgements on evidence of low quality don't count. ``unanswered_items`` has the parts left
    without support, in their order.
    """
    level = F.col("level")
    if "quality" in judged.columns:
        level = F.when(good_enough(F.col("quality"), least), level)
    rows = judged.withColumn("level", level)
    if "ord" not in rows.columns:
        rows = rows.withColumn("ord", F.lit(0))
    has = lambda x: F.bool_or(F.coalesce(F.col("level") == x, F.lit(False)))
    part = rows.groupBy("question_id", "part").agg(
        F.when(has("conflict"), "conflict").when(has("direct"), "direct").when(has("inference"), "inference").otherwise("insufficient").alias("level"), F.min("ord").alias("ord")
    )
    count = lambda x: F.count_if(F.col("level") == x)
    status = (
        F.when(count("insufficient") == F.count("*"), "insufficient_evidence").when(count("insufficient") > 0, "partially_answered")
        .when(count("conflict") > 0, "conflicted").otherwise("answered")
    )
    left = F.transform(F.array_sort(F.collect_list(F.when(F.col("level") == "insufficient", F.struct("ord", "part")))), lambda x: x["part"])
    return part.groupBy("question_id").agg(status.alias("status"), F.count("*").alias("parts"), count("insufficient").alias("unanswered"), left.alias("unanswered_items"))


def registry(context: DataFrame, titles: DataFrame, source_types: DataFrame | None = None) -> DataFrame:
    """Context items (question_id, ord, chunk_id, paper_id, version_id, page_start, page_end, section_path, text, quality) as evidence.

    Adds evidence_id, paper_title (by ``titles`` of paper_id, title; else the paper's id), label and
    source_type (by ``source_types`` of chunk_id, source_type; else native_pdf). Of equal evidence
    ids of a question, the last stays, in the place of the first.
    """
    named = context.join(titles.select("paper_id", "title").dropDuplicates(["paper_id"]), "paper_id", "left")
    named = named.withColumn("paper_title", F.coalesce("title", F.col("paper_id").cast("string"))).drop("title")
    if source_types is not None:
        named = named.join(source_types.select("chunk_id", "source_type").dropDuplicates(["chunk_id"]), "chunk_id", "left")
    else:
        named = named.withColumn("source_type", F.lit(None).cast("string"))
    own = evidence_id(F.col("version_id"), F.col("chunk_id"), F.col("page_start"), F.col("page_end"))
    label = citation_label(F.col("paper_title"), F.col("version_id"), F.col("page_start"), F.col("page_end"), F.col("section_path"))
    rows = named.withColumn("source_type", F.coalesce("source_type", F.lit("native_pdf"))).withColumn("evidence_id", own).withColumn("label", label)
    same = Window.partitionBy("question_id", "evidence_id")
    return rows.withColumn("_n", F.row_number().over(same.orderBy(F.desc("ord")))).withColumn("ord", F.min("ord").over(same)).where("_n = 1").drop("_n")


def resolved(cited: DataFrame, evidence: DataFrame, allowed: DataFrame) -> DataFrame:
    """Citations (question_id, evidence_ids) against the question's evidence and allowed papers (question_id, paper_ids).

    (question_id, ord, evidence_id, label, text, source_type, error): distinct ids in order; an id
    that isn't there, or whose paper isn't allowed, has an ``error`` and no label.
    """
    ids = cited.select("question_id", F.posexplode(F.array_distinct("evidence_ids")).alias("ord", "evidence_id"))
    found = ids.join(evidence.select("question_id", "evidence_id", "paper_id", "label", "text", "source_type"), ["question_id", "evidence_id"], "left")
    scoped = found.join(allowed.select("question_id", "paper_ids"), "question_id", "left")
    inside = F.coalesce(F.array_contains("paper_ids", F.col("paper_id")), F.lit(False))
    error = (
        F.when(F.col("paper_id").isNull(), F.concat(F.lit("Unknown Evidence ID: "), "evidence_id"))
        .when(~inside, F.concat(F.lit("Evidence is outside the active paper scope: "), "evidence_id"))
    )
    shown = lambda c: F.when(F.col("error").isNull(), F.col(c)).alias(c)
    return scoped.withColumn("error", error).select("question_id", "ord", "evidence_id", shown("label"), shown("text"), shown("source_type"), "error")


REFUSAL, UNKNOWN = "现有原文证据不足，无法可靠回答。", "根据当前论文原文，我不知道。"  # fixed values: what is said without evidence
UNVERIFIED, UNSUPPORTED = "All generated factual claims failed evidence verification", "The supplied papers do not contain sufficient evidence"


def judged_claims(claims: DataFrame, evidence: DataFrame, judge: seams.Judge | None = None) -> DataFrame:
    """Claims (answer_id, claim, text, evidence_ids, support; level) with ``kept``, ``level`` and ``warning``.

    ``evidence`` has evidence_id and, where answers have their own, answer_id, and allowed (false:
    outside the papers in scope). The first id in order that is unknown or outside removes a claim;
    so do no evidence and the level insufficient. Levels come from ``level`` or from the judge, who
    sees claim, text and evidence_ids of claims that are bound.
    """
    if "text" not in claims.columns:
        claims = claims.withColumn("text", F.col("claim").cast("string"))
    if "support" not in claims.columns:
        claims = claims.withColumn("support", F.lit(None).cast("string"))
    key = ["answer_id", "evidence_id"] if "answer_id" in evidence.columns else ["evidence_id"]
    known = evidence.withColumn("known", F.lit(True)).withColumn("inside", F.col("allowed") if "allowed" in evidence.columns else F.lit(True))
    cited = claims.select("answer_id", "claim", F.posexplode_outer("evidence_ids").alias("at", "evidence_id"))
    found = cited.join(known.select(*key, "known", "inside").dropDuplicates(key), key, "left")
    problem = (
        F.when(F.col("evidence_id").isNull(), F.lit(None).cast("string"))
        .when(F.col("known").isNull(), F.concat(F.lit("Unknown Evidence ID: "), F.col("evidence_id").cast("string")))
        .when(~F.col("inside"), F.concat(F.lit("Evidence is outside the active paper scope: "), F.col("evidence_id").cast("string")))
    )
    first = found.withColumn("problem", problem).groupBy("answer_id", "claim").agg(
        F.min_by("problem", F.when(F.col("problem").isNotNull(), F.col("at"))).alias("problem"), F.count("evidence_id").alias("bound")
    )
    rows = claims.join(first, ["answer_id", "claim"])
    if judge is not None:
        rows = judge(rows)
    said = lambda before: F.concat(F.lit(before), "text")
    level = F.coalesce("level", F.lit("insufficient"))
    removed = F.col("problem").isNotNull() | (F.col("bound") == 0) | (level == "insufficient")
    warning = (
        F.when(F.col("problem").isNotNull(), F.col("problem")).when(F.col("bound") == 0, "Claim has no evidence")
        .when(level == "insufficient", said("Unsupported claim removed: "))
        .when((level == "inference") & (F.coalesce("support", F.lit("")) != "inference"), said("Claim downgraded to inference: "))
    )
    return rows.withColumn("level", level).withColumn("kept", ~removed).withColumn("warning", warning).drop("problem", "bound")


def verify_answers(answers: DataFrame, claims: DataFrame, evidence: DataFrame, judge: seams.Judge | None = None) -> DataFrame:
    """Answers (answer_id, answer_status, concise_answer, conflicts, unanswered_items, refusal_reason; plan_unanswered) after their claims are checked.

    (answer_id, answer_status, concise_answer, claims, removed, conflicts, unanswered_items, warnings,
    refusal_reason, severe). An answer whose claims all go is refused. Else its own status stays
    unless claims were removed (partially answered) or there are conflicts, its own or claims that
    turn out to conflict (conflicted). Answers without claims keep their status.
    """
    judged = judged_claims(claims, evidence, judge)
    own = answers.select("answer_id", F.coalesce("conflicts", F.array().cast("array<string>")).alias("known_conflicts"))
    judged = judged.join(own, "answer_id").withColumn("hidden", F.col("kept") & (F.col("level") == "conflict") & ~F.array_contains("known_conflicts", F.col("text")))
    exposed = F.when(F.col("hidden"), F.concat(F.lit("Hidden conflict exposed: "), "text"))
    listed = lambda test, x: F.transform(F.array_sort(F.collect_list(F.when(test, F.struct(F.col("claim"), x.alias("x"))))), lambda r: r["x"])
    kept = F.struct("text", "evidence_ids", F.col("level").alias("support"))
    checked = judged.groupBy("answer_id").agg(
        F.count("*").alias("n"), listed(F.col("kept"), kept).alias("claims"), listed(~F.col("kept"), F.col("text")).alias("removed"),
        listed(F.col("hidden"), F.col("text")).alias("hidden"), F.flatten(listed(F.lit(True), F.array_compact(F.array("warning", exposed)))).alias("warnings"),
    )
    none = F.array().cast("array<string>")
    rows = answers.join(checked, "answer_id", "left")
    for name in ("removed", "hidden", "warnings", "conflicts", "unanswered_items", "plan_unanswered"):
        rows = rows.withColumn(name, F.coalesce(name, none) if name in rows.columns else none)
    severe = (F.coalesce("n", F.lit(0)) > 0) & (F.size("claims") == 0)
    conflicts = F.array_distinct(F.concat("conflicts", "hidden"))
    status = (
        F.when(F.col("severe"), "insufficient_evidence").when(F.size("all_conflicts") > 0, "conflicted")
        .when(F.size("removed") > 0, "partially_answered").otherwise(F.col("answer_status"))
    )
    return rows.withColumn("severe", severe).withColumn("all_conflicts", conflicts).select(
        "answer_id", status.alias("answer_status"), F.when(F.col("severe"), REFUSAL).otherwise(F.col("concise_answer")).alias("concise_answer"), "claims", "removed",
        F.col("all_conflicts").alias("conflicts"), F.array_distinct(F.concat("unanswered_items", "plan_unanswered")).alias("unanswered_items"), "warnings",
        F.when(F.col("severe"), UNVERIFIED).otherwise(F.col("refusal_reason")).alias("refusal_reason"), "severe",
    )


def verify_claims(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Claims (answer_id, claim, evidence_ids, level) against evidence: (answer_id, status, claims, removed, inferred) of answers taken as answered."""
    none = F.array().cast("array<string>")
    text, nothing = F.lit("").alias("concise_answer"), F.lit(None).cast("string").alias("refusal_reason")
    answers = claims.select("answer_id").distinct().select("answer_id", F.lit("answered").alias("answer_status"), text, none.alias("conflicts"), none.alias("unanswered_items"), nothing)
    done = verify_answers(answers, claims, evidence)
    inferred = F.size(F.filter("claims", lambda c: c["support"] == "inference")).cast("long")
    gone = F.size("removed").cast("long")
    return done.select("answer_id", F.col("answer_status").alias("status"), (F.size("claims") + gone).cast("long").alias("claims"), gone.alias("removed"), inferred.alias("inferred"))


#: The fields of an answer, its states, the supports of a claim.
ANSWER_FIELDS = ["answer_status", "claims", "concise_answer", "conflicts", "refusal_reason", "unanswered_items", "uncertainty"]
STATES = ["answered", "partially_answered", "conflicted", "insufficient_evidence", "document_quality_failure", "out_of_scope"]
SUPPORTS = ["direct", "inference", "conflict", "unsupported"]
_ANSWER = "struct<answer_status:string,concise_answer:string,claims:array<struct<text:string,evidence_ids:array<string>,support:string>>,uncertainty:array<string>,conflicts:array<string>,unanswered_items:array<string>,refusal_reason:string>"


def parsed_answers(rows: DataFrame, column: str = "response") -> DataFrame:
    """``rows`` with ``answer`` and ``error``: a JSON answer, checked strictly.

    All fields must be there (missing ones are named, sorted), lists be lists, the status and the
    supports known, and each claim an object with text, evidence_ids and support. A row with an
    error has no answer; a null response is an error.
    """
    raw = F.col(column)
    whole = F.from_json(raw, "map<string,string>")
    held = F.map_keys("_map")
    missing = F.array_except(F.array(*[F.lit(f) for f in ANSWER_FIELDS]), held)
    part = lambda name: F.element_at("_map", name)
    is_list = lambda name: F.coalesce(F.trim(part(name)).startswith("["), F.lit(False))
    claims = F.from_json(part("claims"), "array<map<string,string>>")
    complete = lambda c: F.size(F.array_except(F.array(*[F.lit(x) for x in ("text", "evidence_ids", "support")]), F.map_keys(c))) == 0
    bad_list = F.coalesce(*[F.when(~is_list(n), F.concat(F.lit(n), F.lit(" must be a list"))) for n in ("uncertainty", "conflicts", "unanswered_items")])
    error = (
        F.when(raw.isNull() | (F.trim(raw) == ""), "empty response")
        .when(~F.trim(raw).startswith("{") | F.col("_map").isNull(), "Structured response must be an object")
        .when(F.size(missing) > 0, F.concat(F.lit("Missing structured fields: "), F.array_join(missing, ", ")))
        .when(~F.coalesce(part("answer_status").isin(STATES), F.lit(False)), "Invalid answer_status")
        .when(~is_list("claims") | F.col("_claims").isNull() | F.exists("_claims", lambda c: c.isNull() | ~complete(c)), "Invalid claim structure")
        .when(F.exists("_claims", lambda c: ~F.coalesce(F.element_at(c, "support").isin(SUPPORTS), F.lit(False))), "Invalid claim support")
        .when(bad_list.isNotNull(), bad_list)
    )
    checked = rows.withColumn("_map", whole).withColumn("_claims", claims).withColumn("error", error)
    return checked.withColumn("answer", F.when(F.col("error").isNull(), F.from_json(raw, _ANSWER))).drop("_map", "_claims")


def filled(given: DataFrame, required: DataFrame, key: str) -> DataFrame:
    """Every required name of every key, with null where it isn't given: the missing ones are not stated."""
    keys = given.select(key).distinct()
    return keys.join(F.broadcast(required), F.lit(True)).join(given, [key, "name"], "left")


def first_of_each(rows: DataFrame, group: list[str], order: list) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where("__n = 1").drop("__n")

#: Claims about a whole field.
FIELD_CLAIM = "(?i)领域|世界|首次|首创|state[- ]of[- ]the[- ]art|first ever"


def expanded(seeds: DataFrame, chunks: DataFrame) -> DataFrame:
    """Proposals (question_id, ord, step, chunk_id, reason, seed), the first of each chunk, in the order to be budgeted.

    Seeds (question_id, ord, chunk_id) bring their parent, both neighbours and related chunks, as
    ``chunks`` (chunk_id, parent_id, previous_id, next_id, related) tells; an unknown seed stands alone.
    """
    offer = lambda c, why: F.struct(c.alias("id"), F.lit(why).alias("reason"))
    four = F.array(offer(F.col("chunk_id"), "reranked"), offer(F.col("parent_id"), "parent"), offer(F.col("previous_id"), "adjacent"), offer(F.col("next_id"), "adjacent"))
    more = F.transform(F.coalesce("related", F.array()), lambda x: F.struct(x.alias("id"), F.lit("special_relation").alias("reason")))
    rows = seeds.join(chunks, "chunk_id", "left").select("question_id", "ord", F.col("chunk_id").alias("seed"), F.posexplode(F.concat(four, more)).alias("step", "o"))
    known = rows.where("o.id is not null").select("question_id", "ord", "step", F.col("o.id").alias("chunk_id"), "o.reason", "seed")
    return first_of_each(known, ["question_id", "chunk_id"], ["ord", "step"])


def missing_sections(given: DataFrame) -> DataFrame:
    """Summaries' sections (id, level, name): the required ones of the level that aren't there, in their order."""
    required = F.create_map(*[x for k, v in SECTIONS.items() for x in (F.lit(k), F.array(*[F.lit(n) for n in v]))])
    held = given.groupBy("id", "level").agg(F.collect_set("name").alias("names"))
    return held.select("id", "level", F.array_except(F.element_at(required, F.col("level")), "names").alias("missing"))


def novelty_verdict(text, citations, compared, scope) -> F.Column:
    """Why a claim of novelty can't stand, else ``accepted``: field-wide, uncited, or compared beyond the scope."""
    beyond = F.size(F.array_except(F.coalesce(compared, F.array()), scope)) > 0
    return F.when(text.rlike(FIELD_CLAIM), "field_claim").when(F.coalesce(F.size(citations), F.lit(0)) <= 0, "uncited").when(beyond, "beyond_scope").otherwise("accepted")


#: Roles of a method, and how a field is known.
ROLES = ["core", "foundation", "baseline", "ablation", "auxiliary"]
SOURCES = ["explicit", "synthesized", "not_stated"]
TOO_FEW = "Insufficient comparable papers in the local library"


def extracted_methods(methods: DataFrame, fields: DataFrame) -> DataFrame:
    """Methods (method_id, name, role) and their given fields (method_id, name, value, source_status, evidence_ids): all nine fields of each.

    (method_id, method, role, name, value, source_status, evidence_ids, error). A field that isn't
    given is not stated, and one not stated has neither value nor evidence. An unknown role or
    status, and a stated field without evidence, is an error. Of a field given twice the last by value counts.
    """
    required = F.explode(F.array(*[F.lit(x) for x in METHOD_FIELDS]))
    every = methods.select("method_id", F.col("name").alias("method"), "role", required.alias("name"))
    given = first_of_each(fields, ["method_id", "name"], [F.desc("value")])
    rows = every.join(given.select("method_id", "name", "value", "source_status", "evidence_ids"), ["method_id", "name"], "left")
    rows = rows.withColumn("source_status", F.coalesce("source_status", F.lit("not_stated")))
    silent = F.col("source_status") == "not_stated"
    ids = F.coalesce("evidence_ids", F.array().cast("array<string>"))
    error = (
        F.when(~F.coalesce(F.col("role").isin(ROLES), F.lit(False)), "unknown role").when(~F.col("source_status").isin(SOURCES), "unknown source status")
        .when(~silent & (F.size(ids) == 0), "Stated method fields require Evidence")
    )
    return rows.select(
        "method_id", "method", "role", "name", F.when(~silent, F.col("value")).alias("value"), "source_status",
        F.when(silent, F.array().cast("array<string>")).otherwise(ids).alias("evidence_ids"), error.alias("error"),
    )


def innovations(items: DataFrame, scope: DataFrame) -> DataFrame:
    """Items (analysis_id, kind, text, paper_id, evidence_ids, comparison_paper_ids) against the analysis' scope (analysis_id, paper_ids).

    Adds ``verdict`` (see ``novelty_verdict``; also outside_scope where the item's own paper isn't
    compared) and ``note``. With fewer than two papers, hypotheses (kind agent_hypotheses) are
    ``dropped`` and the note says why.
    """
    rows = items.join(scope.select("analysis_id", F.array_distinct("paper_ids").alias("_scope")), "analysis_id")
    few = (F.size("_scope") < 2) & (F.col("kind") == "agent_hypotheses")
    inside = F.coalesce(F.array_contains("_scope", F.col("paper_id")), F.lit(False))
    verdict = F.when(few, "dropped").when(~inside, "outside_scope").otherwise(novelty_verdict(F.col("text"), F.col("evidence_ids"), F.col("comparison_paper_ids"), F.col("_scope")))
    return rows.withColumn("verdict", verdict).withColumn("note", F.when(few, TOO_FEW)).drop("_scope")


def summaries(sections: DataFrame, levels: DataFrame, scope: DataFrame, warnings: DataFrame) -> DataFrame:
    """Summaries (summary_id, level) from their sections (summary_id, ord, name, text, paper_id): (summary_id, level, content, warnings, outside).

    Sections of papers out of ``scope`` (summary_id, paper_id) are left out and counted as
    ``outside``. Required sections that are missing give warnings, in their order, then the papers'
    quality warnings (paper_id, warnings) follow.
    """
    required = F.create_map(*[x for k, v in SECTIONS.items() for x in (F.lit(k), F.array(*[F.lit(n) for n in v]))])
    known = scope.select("summary_id", "paper_id", F.lit(True).alias("inside")).distinct()
    held = sections.join(known, ["summary_id", "paper_id"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    listed = lambda x: F.transform(F.array_sort(F.collect_list(F.when(F.col("inside"), F.struct(F.col("ord"), x.alias("x"))))), lambda r: r["x"])
    own = held.groupBy("summary_id").agg(F.array_join(listed(F.col("text")), "\n").alias("content"), listed(F.col("name")).alias("names"), F.count_if(~F.col("inside")).alias("outside"))
    noted = scope.join(warnings, "paper_id").select("summary_id", "paper_id", F.posexplode("warnings").alias("at", "w"))
    said = F.transform(F.array_sort(F.collect_list(F.struct("paper_id", "at", "w"))), lambda r: F.concat(r["paper_id"].cast("string"), F.lit(": "), r["w"]))
    notes = noted.groupBy("summary_id").agg(said.alias("notes"))
    none = F.array().cast("array<string>")
    rows = levels.join(own, "summary_id", "left").join(notes, "summary_id", "left")
    missing = F.array_except(F.element_at(required, F.col("level")), F.coalesce("names", none))
    every = F.concat(F.transform(missing, lambda n: F.concat(F.lit("Missing summary section: "), n)), F.coalesce("notes", none))
    return rows.select("summary_id", "level", F.coalesce("content", F.lit("")).alias("content"), every.alias("warnings"), F.coalesce("outside", F.lit(0)).alias("outside"))


def merged_lists(parts: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Lists of several responses (key, ord, columns) as one list each: in order, without repeats."""
    joined = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.coalesce(c, F.array().cast("array<string>")).alias("x")))), lambda r: r["x"])))
    return parts.groupBy(key).agg(*[joined(c).alias(c) for c in columns])


#: The instructions of each task, by version: a model is told them before its evidence.
PROMPTS = {
    ("answer", "v1"): "Answer from the evidence only. Give one JSON object with answer_status, concise_answer, claims, uncertainty, conflicts, unanswered_items and refusal_reason; each claim has text, evidence_ids and support.",
    ("summary", "v1"): "Write the asked section from the evidence only. Give one JSON object with sections, comparison, conflicts and incomparable.",
    ("method", "v1"): "Name the methods that the evidence describes. Give one JSON object with methods; each has name, role and the nine fields with value, source_status and evidence_ids.",
    ("innovation", "v1"): "Tell the authors' claims from your own hypotheses. Give one JSON object with author_claims, agent_hypotheses and cannot_determine.",
    ("refusing", "v1"): "Answer from the context only, and say that you don't know where it doesn't tell.",
    ("plain", "v1"): "Answer the question with the help of the context.",
}


def instruction(task: str, version: str = "v1") -> str:
    """The instructions of a task; an unknown task or version is a KeyError."""
    return PROMPTS[task, version]


def messages(task: str, question, evidence_json, version: str = "v1") -> F.Column:
    """A prompt as roles and contents: the instructions, then question and evidence."""
    system = F.struct(F.lit("system").alias("role"), F.lit(instruction(task, version)).alias("content"))
    user = F.struct(F.lit("user").alias("role"), F.concat(question, F.lit("\n\nEvidence: "), evidence_json).alias("content"))
    return F.array(system, user)


def prompts(context: DataFrame, mark: str = "\n---\n") -> DataFrame:
    """Context (query_id, question, rank, text) to one prompt per question: its texts by rank, then the question."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"])
    return context.groupBy("query_id", "question").agg(F.array_join(texts, mark).alias("context")).select("query_id", F.concat(F.lit("Context:\n"), "context", F.lit("\n\nQuestion: "), "question").alias("prompt"))
