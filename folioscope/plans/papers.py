"""Registered queries of answers, evidence, tables as logs, queues and views.

The synthetic tables stand in: customers are papers, orders their versions, lineitems the
versions' tasks, events judgements and claims, documents texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import agents, chunking, grounding, lifecycle, normalize, planner, retrieval, seams
from folioscope.plans import answering
from folioscope.plans import queries as base
from folioscope.plans.queries import query
from folioscope.sources import sinks
from folioscope.sources.readers import page_label, parsed_items, table
from folioscope.streaming import ingest

_NOW = "2030-01-01 00:00:00"


def _c() -> F.Column:
    return F.col("c_custkey")


def _o() -> F.Column:
    return F.col("o_orderkey")


def _l() -> F.Column:
    return F.col("l_orderkey")


def _now() -> F.Column:
    return F.lit(_NOW).cast("timestamp")


def _pick(names: list[str], n) -> F.Column:
    return F.element_at(F.array(*[F.lit(x) for x in names]), n.cast("int"))


_PAPERS = """papers as (select c_custkey as paper_id, c_name as title, ['pending', 'parsing', 'ready', 'partially_ready', 'failed'][1 + c_custkey % 5] as status, case when c_custkey % 3 > 0 then ['ready', 'partially_ready'][1 + c_custkey % 2] end as quality_level,
  (select min(o_orderkey) from orders where o_custkey = c_custkey) as active_version_id, case when c_custkey % 11 = 0 then '/data/other/' else '/data/pdf/' end || c_custkey || '.pdf' as file_path from customer)"""
_TASKS = """tasks as (select l_orderkey * 10 + l_linenumber as task_id, l_orderkey as version_id, case when l_linenumber = 1 and l_orderkey % 5 = 0 then 'queued' when l_linenumber = 2 and l_orderkey % 7 = 0 then 'running' when (l_orderkey + l_linenumber) % 3 = 0 then 'failed' else 'succeeded' end as status,
  l_linenumber as attempt, l_shipdate as updated_at, case when (l_orderkey + l_linenumber) % 3 = 0 then 'E' || l_linenumber end as error_message from (select l_orderkey, l_linenumber, max(l_shipdate) as l_shipdate from lineitem group by all))"""


def _papers(spark, d) -> DataFrame:
    first = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").alias("active_version_id"))
    place = F.when(_c() % 11 == 0, "/data/other/").otherwise("/data/pdf/")
    return table(spark, d, "customer").join(first, "c_custkey", "left").select(
        _c().alias("paper_id"), F.col("c_name").alias("title"), _pick(["pending", "parsing", "ready", "partially_ready", "failed"], 1 + _c() % 5).alias("status"),
        F.when(_c() % 3 > 0, _pick(["ready", "partially_ready"], 1 + _c() % 2)).alias("quality_level"), "active_version_id", F.concat(place, _c().cast("string"), F.lit(".pdf")).alias("file_path"), _c().alias("created_at"),
    )


def _versions(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(_o().alias("version_id"), F.col("o_custkey").alias("paper_id"))


def _tasks(spark, d) -> DataFrame:
    n = F.col("l_linenumber")
    failed = (_l() + n) % 3 == 0
    status = F.when((n == 1) & (_l() % 5 == 0), "queued").when((n == 2) & (_l() % 7 == 0), "running").when(failed, "failed").otherwise("succeeded")
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_shipdate").alias("l_shipdate")).select(
        (_l() * 10 + n).alias("task_id"), _l().alias("version_id"), status.alias("status"), n.alias("attempt"), F.col("l_shipdate").alias("created_at"), F.col("l_shipdate").alias("updated_at"),
        F.when(failed, F.concat(F.lit("E"), n)).alias("error_message"),
    )


def _cases(spark, rows, schema) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# evidence


_CONTEXT = """x as (select d.doc_id // 25 as question_id, d.doc_id + 10000000000 * again as ord, d.doc_id as chunk_id, d.doc_id % 13 as paper_id, d.lang as version_id, 1 + d.doc_id % 3 as a, 1 + d.doc_id % 3 + d.doc_id % 2 as b, d.text
  from documents d, (select unnest([0, 1]) as again) where again = 0 or doc_id % 3 = 0),
k as (select *, 'ev_' || substr(sha256(version_id || chr(31) || chunk_id || chr(31) || a || chr(31) || b), 1, 20) as evidence_id, coalesce((select c_name from customer where c_custkey = paper_id and c_custkey % 2 = 0), paper_id::varchar) as paper_title from x),
v as (select *, min(ord) over (partition by question_id, evidence_id) as place, row_number() over (partition by question_id, evidence_id order by ord desc) as n from k)
"""


def _registry(spark, d) -> DataFrame:
    """Every document is evidence of the question of its 25, each third twice."""
    i = F.col("doc_id")
    rows = table(spark, d, "documents").withColumn("again", F.explode(F.when(i % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    context = rows.withColumn("question_id", F.floor(i / 25)).withColumn("ord", i + F.lit(10_000_000_000) * F.col("again")).select(
        "question_id", "ord", i.alias("chunk_id"), (i % 13).alias("paper_id"), F.col("lang").alias("version_id"), (1 + i % 3).alias("page_start"), (1 + i % 3 + i % 2).alias("page_end"),
        F.when(i % 4 > 0, F.array(F.lit("Method"))).otherwise(F.array().cast("array<string>")).alias("section_path"), "text", F.lit(None).cast("double").alias("quality"),
    )
    titles = table(spark, d, "customer").where("c_custkey % 2 = 0").select(_c().alias("paper_id"), F.col("c_name").alias("title"))
    return grounding.registry(context, titles)


@query(f"with {_CONTEXT} select question_id, place as ord, evidence_id, paper_title, text, 'native_pdf' as source_type, paper_title || ' (' || version_id || '), ' || case when a = b then 'p. ' || a else 'pp. ' || a || '-' || b end || ', ' || case when chunk_id % 4 = 0 then 'Unsectioned' else 'Method' end as label from v where n = 1")
def evidence_registry(spark: SparkSession, d: str) -> DataFrame:
    return _registry(spark, d).select("question_id", "ord", "evidence_id", "paper_title", "text", "source_type", "label")


@query(f"""with {_CONTEXT}, ids as (select question_id, place, evidence_id, paper_id from v where n = 1), l as (select question_id, list(evidence_id order by place) as ids from ids group by question_id),
c as (select question_id, unnest(ids || ['ev_none', ids[1]]) as evidence_id, unnest(range(len(ids) + 2)) as place from l), q as (select question_id, evidence_id, min(place) as spot from c group by all)
select q.question_id, q.evidence_id, (row_number() over (partition by q.question_id order by spot) - 1)::int as ord, case when paper_id is null then 'Unknown Evidence ID: ' || q.evidence_id when paper_id % 2 = 1 then 'Evidence is outside the active paper scope: ' || q.evidence_id end as error
from q left join ids on ids.question_id = q.question_id and ids.evidence_id = q.evidence_id""")
def citation_errors(spark: SparkSession, d: str) -> DataFrame:
    """Every question cites its evidence, an unknown one and the first again; papers of even number are allowed."""
    evidence = _registry(spark, d)
    own = evidence.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "evidence_id"))), lambda x: x["evidence_id"]).alias("ids"))
    cited = own.select("question_id", F.concat("ids", F.array(F.lit("ev_none"), F.get("ids", F.lit(0)))).alias("evidence_ids"))
    allowed = own.select("question_id", F.array(*[F.lit(x).cast("long") for x in range(0, 13, 2)]).alias("paper_ids"))
    return grounding.resolved(cited, evidence, allowed).select("question_id", "evidence_id", "ord", "error")


@query(f"""with a as (select distinct user_id as answer_id from events), c as (select user_id as answer_id, event_id, {base._LEVELS} as level, [1 + event_id % 211, 1 + event_id % 197] as ids from events), e as (select p_partkey as i from part where p_size > 5),
j as (select *, case when ids[1] not in (from e) then 'Unknown Evidence ID: ' || ids[1] when ids[2] not in (from e) then 'Unknown Evidence ID: ' || ids[2] end as problem from c),
k as (select *, problem is null and level != 'insufficient' as kept from j)
select answer_id, case when count_if(kept) = 0 then 'insufficient_evidence' when count_if(kept and level = 'conflict') > 0 then 'conflicted' when count_if(not kept) > 0 then 'partially_answered' else 'answered' end as answer_status,
  count_if(kept) as claims, string_agg(event_id::varchar, ',' order by event_id) filter (kept and level = 'conflict') as conflicts, count_if(not kept or level = 'conflict' or level = 'inference') as warnings,
  any_value(problem order by event_id) filter (problem is not null) as first_problem from k group by answer_id""".replace("any_value(problem order by event_id) filter (problem is not null)", "first(problem order by event_id) filter (problem is not null)"))
def answer_checks(spark: SparkSession, d: str) -> DataFrame:
    """Events as claims of their user's answer, with a judge that tells by the event's type."""
    i = F.col("event_id")
    rows = table(spark, d, "events").select(F.col("user_id").alias("answer_id"), i.alias("claim"), i.cast("string").alias("text"), F.array(1 + i % 211, 1 + i % 197).alias("evidence_ids"), F.lit("direct").alias("support"), "event_type")
    answers = rows.select("answer_id").distinct().select("answer_id", F.lit("answered").alias("answer_status"), F.lit("").alias("concise_answer"), F.lit(None).cast("string").alias("refusal_reason"))
    none = F.array().cast("array<string>")
    judge = lambda claims: claims.withColumn("level", F.expr(base._LEVELS))
    got = grounding.verify_answers(answers.withColumn("conflicts", none).withColumn("unanswered_items", none), rows, base._evidence(spark, d), judge)
    problems = F.filter("warnings", lambda w: w.startswith("Unknown"))
    return got.select("answer_id", "answer_status", F.size("claims").cast("long").alias("claims"), F.nullif(F.array_join("conflicts", ","), F.lit("")).alias("conflicts"), F.size("warnings").cast("long").alias("warnings"), F.get(problems, F.lit(0)).alias("first_problem"))


@query("""with c as (select o_orderkey as id, o_orderkey % 7 as k, o_custkey % 3 as j from orders)
select id, case when k in (0, 1) then case when j = 0 then 'partially_answered' else 'answered' end end as status, case k when 2 then 'Invalid answer_status' when 3 then 'Invalid claim support' when 4 then 'conflicts must be a list'
  when 5 then 'Missing structured fields: claims, conflicts, refusal_reason, unanswered_items, uncertainty' when 6 then case when j = 0 then 'empty response' else 'Structured response must be an object' end end as error from c""")
def answer_json(spark: SparkSession, d: str) -> DataFrame:
    """Responses of a model for each order, whole ones and broken ones of every kind."""
    k, j = _o() % 7, F.col("o_custkey") % 3
    status = F.when(k == 2, "maybe").when(j == 0, "partially_answered").otherwise("answered")
    whole = F.concat(
        F.lit('{"answer_status": "'), status, F.lit('", "concise_answer": "c", "claims": [{"text": "t", "evidence_ids": ["e"], "support": "'), F.when(k == 3, "strong").otherwise("direct"),
        F.lit('"}], "uncertainty": [], "conflicts": '), F.when(k == 4, '"none"').otherwise("[]"), F.lit(', "unanswered_items": [], "refusal_reason": null}'),
    )
    response = F.when(k == 5, '{"answer_status": "answered", "concise_answer": "c"}').when((k == 6) & (j == 1), "[1]").when((k == 6) & (j == 2), "no json").when(k < 5, whole)
    got = grounding.parsed_answers(table(spark, d, "orders").select(_o().alias("id"), response.alias("response")))
    return got.select("id", F.col("answer.answer_status").alias("status"), "error")


@query("""select o_orderkey as id, case when o_orderkey % 5 = 0 then null when o_custkey % 4 = 0 then null else ((o_orderkey + 2.0 * o_custkey) / (o_custkey % 4) - (o_orderkey % 9) * (o_orderkey % 9))::double end as value from orders""")
def calculations(spark: SparkSession, d: str) -> DataFrame:
    """An expression of each order's numbers; some divide by zero, some aren't arithmetic."""
    o, c = _o(), F.col("o_custkey")
    good = F.concat(F.lit("("), o, F.lit(" + 2 * "), c, F.lit(") / "), c % 4, F.lit(" - "), o % 9, F.lit(" ** 2"))
    text = F.when(o % 5 == 0, F.concat(F.lit("open('"), o, F.lit("')"))).otherwise(good)
    return agents.calculations(table(spark, d, "orders").select(o.alias("id"), text.alias("text")), "text").select("id", "value")


@query("""with s as (select s_suppkey as paper_id, s_suppkey % 4 as k from supplier)
select paper_id, k = 0 as deleted, case k when 0 then 'vector,keyword,file,history,database' when 1 then 'keyword' when 2 then '' else 'vector,keyword' end as completed,
  case k when 0 then '' when 1 then 'vector: no' when 2 then 'vector: a,keyword: b' else 'file: locked' end as errors from s""")
def deletion_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """The steps of deleting each supplier's paper, with failures in some of them."""
    k = F.col("s_suppkey") % 4
    step = F.explode(F.array(*[F.lit(x) for x in ("vector", "keyword", "file", "history", "database")]))
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("paper_id"), k.alias("k"), step.alias("step"))
    is_ = lambda n, name: (F.col("k") == n) & (F.col("step") == name)
    error = F.when(is_(1, "vector"), "no").when(is_(2, "vector"), "a").when(is_(2, "keyword"), "b").when(is_(3, "file"), "locked")
    got = lifecycle.deletion_steps(rows.select("paper_id", "step", error.alias("error")))
    return got.select("paper_id", "deleted", F.array_join("completed", ",").alias("completed"), F.array_join("errors", ",").alias("errors"))


# analyses


@query(f"""with m as (select o_orderkey as method_id, case when o_orderkey % 6 > 0 then {grounding.ROLES}[1 + (o_orderkey % 5)::int] else 'other' end as role from orders),
f as (select l_orderkey as method_id, {grounding.METHOD_FIELDS}[1 + (l_linenumber % 9)::int] as name, l_shipmode as value, {grounding.SOURCES}[1 + (l_suppkey % 3)::int] as source_status, l_suppkey % 4 > 0 as cited from (select l_orderkey, l_linenumber, max(l_returnflag) as l_returnflag, max(l_suppkey) as l_suppkey from lineitem group by all)),
n as (select unnest({grounding.METHOD_FIELDS}) as name), r as (select m.*, n.name, coalesce(f.source_status, 'not_stated') as source_status, f.value, coalesce(cited, false) as cited from m cross join n left join f on f.method_id = m.method_id and f.name = n.name)
select method_id, role, name, source_status, case when source_status != 'not_stated' then value end as value, (source_status != 'not_stated' and cited)::int as citations,
  case when role = 'other' then 'unknown role' when source_status != 'not_stated' and not cited then 'Stated method fields require Evidence' end as error from r""".replace("l_shipmode as value", "l_returnflag as value"))
def method_extraction(spark: SparkSession, d: str) -> DataFrame:
    role = F.when(_o() % 6 > 0, _pick(grounding.ROLES, 1 + _o() % 5)).otherwise("other")
    methods = table(spark, d, "orders").select(_o().alias("method_id"), F.lit("m").alias("name"), role.alias("role"))
    s = F.col("l_suppkey")
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("l_returnflag"), F.max("l_suppkey").alias("l_suppkey"))
    fields = lines.select(
        _l().alias("method_id"), _pick(grounding.METHOD_FIELDS, 1 + F.col("l_linenumber") % 9).alias("name"), F.col("l_returnflag").alias("value"), _pick(grounding.SOURCES, 1 + s % 3).alias("source_status"),
        F.when(s % 4 > 0, F.array(s.cast("string"))).otherwise(F.array().cast("array<string>")).alias("evidence_ids"),
    )
    got = grounding.extracted_methods(methods, fields)
    return got.select("method_id", "role", "name", "source_status", "value", F.size("evidence_ids").alias("citations"), "error")


_TEXTS = ["A first ever result", "A sparser index", "Fewer labels are needed"]


@query(f"""with i as (select event_id, user_id as analysis_id, ['author_claims', 'agent_hypotheses'][1 + event_id % 2] as kind, {_TEXTS}[1 + event_id % 3] as text, event_id % 5 as paper_id, event_id % 4 > 0 as cited, event_id % 6 as other from events),
s as (select *, range(1 + analysis_id % 5) as papers from i)
select event_id, kind, case when kind = 'agent_hypotheses' and len(papers) < 2 then 'dropped' when not list_contains(papers, paper_id) then 'outside_scope' when regexp_matches(text, '{grounding.FIELD_CLAIM}') then 'field_claim' when not cited then 'uncited'
  when not list_contains(papers, other) then 'beyond_scope' else 'accepted' end as verdict, case when kind = 'agent_hypotheses' and len(papers) < 2 then '{grounding.TOO_FEW}' end as note from s""")
def innovation_items(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    items = table(spark, d, "events").select(
        i, F.col("user_id").alias("analysis_id"), _pick(["author_claims", "agent_hypotheses"], 1 + i % 2).alias("kind"), _pick(_TEXTS, 1 + i % 3).alias("text"), (i % 5).alias("paper_id"),
        F.when(i % 4 > 0, F.array(i)).alias("evidence_ids"), F.array(i % 6).alias("comparison_paper_ids"),
    )
    scope = items.select("analysis_id").distinct().withColumn("paper_ids", F.sequence(F.lit(0).cast("long"), F.col("analysis_id") % 5))
    return grounding.innovations(items, scope).select("event_id", "kind", "verdict", "note")


@query(f"""with s as (select o_custkey as summary_id, o_orderkey as ord, {grounding.SECTIONS['detailed']}[1 + (o_orderkey % 6)::int] as name, o_orderpriority as text, o_orderkey % 4 as paper_id from orders),
l as (select distinct summary_id, ['quick', 'standard', 'detailed'][1 + (summary_id % 3)::int] as level from s), k as (select * from s where paper_id < 3),
h as (select summary_id, string_agg(text, chr(10) order by ord) as content, list(distinct name) as names from k group by summary_id), o as (select summary_id, count_if(paper_id = 3) as outside from s group by summary_id)
select l.summary_id, level, coalesce(content, '') as content, outside, array_to_string(list_concat([('Missing summary section: ' || x) for x in list_filter(case level when 'quick' then {grounding.SECTIONS['quick']} when 'standard' then {grounding.SECTIONS['standard']} else {grounding.SECTIONS['detailed']} end, lambda x: not list_contains(coalesce(names, []), x))], ['1: low', '1: old']), ';') as warnings
from l left join h using (summary_id) join o using (summary_id)""")
def summary_assembly(spark: SparkSession, d: str) -> DataFrame:
    sections = table(spark, d, "orders").select(F.col("o_custkey").alias("summary_id"), _o().alias("ord"), _pick(grounding.SECTIONS["detailed"], 1 + _o() % 6).alias("name"), F.col("o_orderpriority").alias("text"), (_o() % 4).alias("paper_id"))
    levels = sections.select("summary_id").distinct().withColumn("level", _pick(["quick", "standard", "detailed"], 1 + F.col("summary_id") % 3))
    scope = levels.select("summary_id", F.explode(F.array(*[F.lit(x).cast("long") for x in range(3)])).alias("paper_id"))
    warnings = _cases(spark, [(1, ["low", "old"])], "paper_id long, warnings array<string>")
    return grounding.summaries(sections, levels, scope, warnings).withColumn("warnings", F.array_join("warnings", ";"))


@query("""with p as (select user_id as id, event_id as ord, [event_type, 'x' || event_id % 7] as conflicts from events), u as (select id, ord, unnest(conflicts) as c, unnest(range(2)) as k from p), f as (select id, c, min(ord * 2 + k) as first from u group by all)
select id, string_agg(c, ',' order by first) as conflicts from f group by id""")
def analysis_lists(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("ord"), F.array(F.col("event_type"), F.concat(F.lit("x"), F.col("event_id") % 7)).alias("conflicts"))
    return grounding.merged_lists(rows, "id", ["conflicts"]).withColumn("conflicts", F.array_join("conflicts", ","))


_SECTION_NAMES = ["Abstract", "1 INTRODUCTION", "2.1 Methodology", "Experiment Setup", "Results", "Other"]


@query(f"""with c as (select doc_id as chunk_id, doc_id % 10 as paper_id, {_SECTION_NAMES}[1 + (doc_id % 6)::int] as section, text, 1 + doc_id % 4 as page_start, 1 + doc_id % 4 + doc_id % 2 as page_end, case when doc_id % 5 > 0 then (doc_id % 9) / 10.0 end as q from documents where text is not null),
h(place, hints) as (values {', '.join(f"({i}, {h})" for i, h in enumerate(retrieval.HINTS['method']))}),
m as (select c.*, place, hints, row_number() over (partition by paper_id, place order by length(text) desc, page_start, page_end, chunk_id) as n from c join h on len(list_filter(hints, lambda x: contains(lower(section), x))) > 0 where q is null or q >= 0.5)
select paper_id, chunk_id, round(2.0 - place * 0.01, 6)::double as score, 'section:' || hints[1] as facet from m where n = 1""")
def section_hints(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    chunks = table(spark, d, "documents").where("text is not null").select(
        i.alias("chunk_id"), (i % 10).alias("paper_id"), F.array(_pick(_SECTION_NAMES, 1 + i % 6)).alias("section_path"), "text", (1 + i % 4).alias("page_start"), (1 + i % 4 + i % 2).alias("page_end"), F.when(i % 5 > 0, (i % 9) / 10.0).alias("quality_score"),
    )
    return retrieval.section_candidates(chunks, "method").select("paper_id", "chunk_id", F.round("score", 6).alias("score"), "facet")


# documents


@query(f"""with {base._BLOCKS}, p as (select doc_id as version_id, unnest(range(1, 5)) as page_no from documents), h as (select distinct version_id, page_no from b)
select version_id, page_no from p where not exists (select 1 from h where h.version_id = p.version_id and h.page_no = p.page_no)""")
def missing_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "documents").select(F.col("doc_id").alias("version_id"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(4).cast("long"))).alias("page_no"))
    return normalize.missing_pages(pages, normalize.blocks(base._blocks(spark, d)))


@query("""select doc_id as version_id, page_no, substr(sha256('page' || chr(31) || doc_id || chr(31) || page_no), 1, 32) as page_id, coalesce(status in ('success', 'empty', 'failed'), false) as ocr_used, case when page_no < 4 then page_no / 10.0 end::double as ocr_confidence from
  (select doc_id, page_no, case when page_no < 4 then ['success', 'skipped', 'empty', 'failed'][1 + (doc_id + page_no) % 4] end as status from (select doc_id, unnest(range(1, 6)) as page_no from documents))""")
def page_rows(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "documents").select(F.col("doc_id").alias("version_id"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(5).cast("long"))).alias("page_no"))
    status = _pick(["success", "skipped", "empty", "failed"], 1 + (F.col("version_id") + F.col("page_no")) % 4)
    read = pages.where("page_no < 4").select("version_id", "page_no", status.alias("status"), (F.col("page_no") / 10.0).cast("double").alias("confidence"))
    return normalize.page_rows(pages, read)


@query("""select doc_id as version_id, pos::int as pos, label, text, page_no, x1 from (
  select doc_id, 0 as pos, 'title' as label, 'T' || doc_id as text, 2 as page_no, 3.0::double as x1 from documents union all select doc_id, 1, 'text', lang, 1, null from documents union all
  select doc_id, 2, 'table', 'a' || chr(10) || lang, 1, 9.0::double from documents union all select doc_id, 2, 'table', 'a' || chr(10) || lang, 3, null from documents union all select doc_id, 3, 'picture', null, 5, 4.0::double from documents)""")
def parser_items(spark: SparkSession, d: str) -> DataFrame:
    """Parser JSON of each document: a title with a box, a text without a place, a table on two pages, a picture."""
    i = F.col("doc_id")
    json = F.format_string(
        '{"texts": [{"label": "title", "text": "T%s", "prov": [{"page_no": 2, "bbox": {"l": 1, "t": 2, "r": 3, "b": 4}}]}, {"label": "", "text": "%s"}], '
        '"tables": [{"data": {"table_cells": [{"text": "a"}, {"text": ""}, {"text": "%s"}]}, "prov": [{"page_no": 1, "bbox": [7, 8, 9, 10]}, {"page_no": 3}]}], "pictures": [{"prov": [{"page_no": 5, "bbox": {"x0": 0, "y0": 1, "x1": 4, "y1": 5}}]}]}',
        i.cast("string"), "lang", "lang",
    )
    got = parsed_items(table(spark, d, "documents").select(i.alias("version_id"), json.alias("json")))
    return got.withColumn("text", F.when(F.col("label") != "picture", F.col("text"))).select("version_id", "pos", "label", "text", "page_no", F.col("bbox.x1").alias("x1"))


def _ingested(spark, d) -> answering.Ingested:
    docs = table(spark, d, "documents")
    own = F.col("doc_id").alias("version_id")
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n"))
    pages = docs.select(own, F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(lines / 20))).alias("page_no")).withColumn("garbled", (F.col("version_id") % 8) / 50.0)
    versions = docs.select(own, (F.col("doc_id") % 10).alias("paper_id"), F.lit("parsing").alias("parse_status"))
    papers = spark.range(10).select(F.col("id").alias("paper_id"), F.lit(None).cast("long").alias("active_version_id"), F.lit("parsing").alias("status"), F.lit(None).cast("string").alias("quality_level"))
    return answering.ingest(base._blocks(spark, d), pages, versions, papers)


_PAGED = "w as (select doc_id as version_id, ceil(len(string_split(coalesce(text, ''), chr(10))) / 20)::bigint as pages, (select count(distinct page_no) from b where b.version_id = doc_id) as held from documents)"
_LEVELLED = "l as (select *, round(held / pages, 9) as coverage, case when held / pages < 0.5 then 'failed' when held / pages < 0.9 or (version_id % 8) / 50.0 > 0.1 then 'partially_ready' else 'ready' end as level from w)"


@query(base._CHILDREN.replace("case when pos % 3 > 0 then (pos % 7) / 10.0 end", "null::double") + f""", {_PAGED}, {_LEVELLED}
select l.version_id, level, coverage, (select count(*) from b where b.version_id = l.version_id) as blocks, case when level = 'failed' then 0 else (select count(*) from c where c.version_id = l.version_id) end as children,
  case when level = 'failed' then 0 else (select count(*) from p where p.version_id = l.version_id) end as parents from l""")
def ingested_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents, a page for twenty lines, through the whole chain: blocks, quality, and chunks of those that are usable."""
    got = _ingested(spark, d)
    blocks = got.blocks.groupBy("version_id").agg(F.count("*").alias("blocks"))
    chunks = got.chunks.groupBy(F.col("version_id").cast("long").alias("version_id")).agg(F.count_if(F.col("level") == "child").alias("children"), F.count_if(F.col("level") == "parent").alias("parents"))
    rows = got.reports.select("version_id", "level", "coverage").join(blocks, "version_id", "left").join(chunks, "version_id", "left")
    return rows.select("version_id", "level", "coverage", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("blocks", "children", "parents")])


@query(f"""with {base._BLOCKS}, {_PAGED}, {_LEVELLED}, n as (select doc_id % 10 as paper_id, max(doc_id) as active_version_id from documents group by 1)
select paper_id, active_version_id, level as status, level as quality_level from n join l on l.version_id = active_version_id""")
def paper_states(spark: SparkSession, d: str) -> DataFrame:
    """What ingesting all versions makes of their papers."""
    return _ingested(spark, d).papers.select("paper_id", "active_version_id", "status", "quality_level")


@query("""with s as (select doc_id as id, text, length(text) as n from documents), w as (select id, text, n, unnest(range(0, n, 420)) as i from s where n > 0)
select id, (row_number() over (partition by id order by i) - 1)::int as part, substr(text, i + 1, 500) as piece from w where i = 0 or n - i > 80""")
def token_window_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 500 tokens with 80 of overlap; a token is a character here."""
    return chunking.token_windows(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), seams.CodePoints(), 500, 80)


@query()
def recursive_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Recursive splits of whole documents; tested against their definition."""
    return chunking.recursive_split(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))


@query()
def semantic_text_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents cut between sentences that are far apart by the hashed embedder; tested against their definition."""
    return chunking.semantic_split(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), seams.hashed_embedding(32))


@query()
def sentence_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents in chunks of whole sentences, 500 characters with 80 of overlap; tested against their definition."""
    return chunking.sentence_windows(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), seams.CodePoints())


# tables as logs


@query("""with w as (select o_orderkey, o_orderstatus as status, o_totalprice as price, 'old' as stamp from orders where o_orderkey % 4 > 0)
select o_orderkey, case when o_orderkey % 6 = 1 and status = 'O' then 'P' else status end as status, case when o_orderkey % 6 = 1 and status = 'O' then 0 else price end as price, false as missed from w
union all select o_orderkey, null, null, true from orders where o_orderkey % 6 = 1 and (o_orderkey % 4 = 0 or o_orderstatus != 'O')""")
def guarded_updates(spark: SparkSession, d: str) -> DataFrame:
    """Open orders become pending; changes of others, and of rows that aren't there, are missed."""
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.lit(None).cast("timestamp").alias("updated_at"))
    changes = orders.where("o_orderkey % 6 = 1").select("o_orderkey", F.lit("P").alias("status"), F.lit(0.0).alias("price"))
    changed, missed = lifecycle.updated(orders.where("o_orderkey % 4 > 0"), changes, "o_orderkey", _now(), guard=F.col("status") == "O")
    return changed.select("o_orderkey", "status", "price", F.lit(False).alias("missed")).unionByName(missed.withColumn("missed", F.lit(True)), allowMissingColumns=True)


@query("""select s_suppkey, created_at, false as refused from (select s_suppkey, case when s_suppkey % 3 = 0 then 'old' else 'now' end as created_at from supplier where s_suppkey % 3 = 0 or s_suppkey % 5 > 0) union all select s_suppkey, null, true from supplier where s_suppkey % 3 = 0 and s_suppkey % 2 = 0""".replace(
    "s_suppkey % 3 = 0 or s_suppkey % 5 > 0", "s_suppkey % 3 = 0 or s_suppkey % 2 = 0"))
def inserted_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every third supplier is there; the even ones are inserted, and those that are there already are refused."""
    rows = table(spark, d, "supplier").select("s_suppkey")
    old = rows.where("s_suppkey % 3 = 0").withColumn("created_at", F.lit("old"))
    table_, bad = lifecycle.inserted(old, rows.where("s_suppkey % 2 = 0"), "s_suppkey", F.lit("now"))
    return table_.withColumn("refused", F.lit(False)).unionByName(bad.withColumn("refused", F.lit(True)), allowMissingColumns=True)


@query("""select l_orderkey, l_linenumber, l_partkey from lineitem where l_orderkey % 3 > 0 union all select l_orderkey, l_linenumber, l_suppkey from lineitem where l_orderkey % 3 = 0 and l_linenumber > 2""")
def child_replacement(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    fresh = rows.where("l_linenumber > 2").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("l_partkey"))
    return lifecycle.replaced_children(rows.drop("l_suppkey"), fresh, rows.where("l_orderkey % 3 = 0"), "l_orderkey")


@query("""with q as (select conv_id || '-' || turn as pair_id, text from conversations where role = 'user'), a as (select conv_id || '-' || (turn - 1) as pair_id, text from conversations where role = 'assistant'),
w as (select pair_id from q group by pair_id having count(*) = 1 intersect select pair_id from a group by pair_id having count(*) = 1)
select pair_id, text, 'user' as role from q where pair_id in (select pair_id from w) union all select pair_id, text, 'assistant' from a where pair_id in (select pair_id from w)""")
def message_pairs(spark: SparkSession, d: str) -> DataFrame:
    talk = table(spark, d, "conversations")
    name = lambda turn: F.concat(F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string")).alias("pair_id")
    return lifecycle.paired(talk.where("role = 'user'").select(name(F.col("turn")), "text"), talk.where("role = 'assistant'").select(name(F.col("turn") - 1), "text")).select("pair_id", "text", "role")


@query("""with gone as (select c_custkey from customer where c_custkey % 9 = 0), v as (select o_orderkey from orders where o_custkey in (from gone)), b as (select l_orderkey * 10 + l_linenumber as id from lineitem where l_orderkey in (from v))
select 'papers' as name, count(*) as n, null::bigint as links from customer where c_custkey not in (from gone) union all select 'paper_versions', count(*), null from orders where o_orderkey not in (from v)
union all select 'chunks', count(*), count(case when (l_orderkey + 1) * 10 + 1 not in (from b) then 1 end) from lineitem where l_orderkey not in (from v)""")
def cascaded_deletion(spark: SparkSession, d: str) -> DataFrame:
    """Papers go with their versions and those's chunks; chunks of others that named one as their parent forget it."""
    tables = {
        "papers": _papers(spark, d).select("paper_id"), "paper_versions": _versions(spark, d),
        "chunks": table(spark, d, "lineitem").select((_l() * 10 + F.col("l_linenumber")).alias("chunk_id"), _l().alias("version_id"), ((_l() + 1) * 10 + 1).alias("parent_chunk_id")),
    }
    left = lifecycle.cascaded(tables, "papers", tables["papers"].where("paper_id % 9 = 0"), "paper_id")
    count = lambda name, link=F.lit(None).cast("long"): left[name].agg(F.lit(name).alias("name"), F.count("*").alias("n"), link.alias("links"))
    return count("papers", F.max(F.lit(None).cast("long"))).unionAll(count("paper_versions", F.max(F.lit(None).cast("long")))).unionAll(count("chunks", F.count("parent_chunk_id")))


@query(f"""with {_PAPERS}, {_TASKS}, busy as (select distinct o_custkey as id from tasks join orders on o_orderkey = version_id where status in ('queued', 'running')), w as (select c_custkey as id from customer where c_custkey % 4 = 0 union all select 1000000000 + c_custkey from customer where c_custkey % 50 = 0)
select id as paper_id, case when p.paper_id is null then 'unknown' when id % 11 = 0 then 'outside' when id in (from busy) then 'active' end as problem from w left join papers p on p.paper_id = id""")
def paper_deletions(spark: SparkSession, d: str) -> DataFrame:
    papers = _papers(spark, d)
    wanted = papers.where("paper_id % 4 = 0").select("paper_id").unionAll(papers.where("paper_id % 50 = 0").select(1000000000 + F.col("paper_id")))
    return lifecycle.deletions(papers, wanted, _versions(spark, d), _tasks(spark, d), "/data/pdf/")


@query("""with m as (select o_orderkey as message_id, [o_custkey, o_custkey + 1] as ids, case when o_orderkey % 2 = 0 then [o_custkey] end as held from orders),
f as (select message_id, list(i) as found from (select message_id, unnest(ids) as i from m) where i in (select c_custkey from customer where c_custkey % 7 = 0) group by message_id)
select message_id, array_to_string(list_sort(list_distinct(list_concat(coalesce(held, []), coalesce(found, [])))), ',') as deleted from m left join f using (message_id) where held is not null or found is not null""")
def history_deletions(spark: SparkSession, d: str) -> DataFrame:
    """Messages name the deleted papers of their scope, beside those they named before."""
    c = F.col("o_custkey")
    rows = table(spark, d, "orders").select(_o().alias("message_id"), F.array(c, c + 1).alias("paper_ids"), F.when(_o() % 2 == 0, F.array(c)).alias("deleted_paper_ids"))
    gone = table(spark, d, "customer").where("c_custkey % 7 = 0").select(_c().alias("paper_id"))
    got = lifecycle.marked_history(rows, gone).where("deleted_paper_ids is not null")
    return got.select("message_id", F.array_join(F.sort_array("deleted_paper_ids"), ",").alias("deleted"))


@query("""with t as (select p_partkey as id, p_size as size from part) select id, size * 2 as size, 0 as cancel_requested, 'new' as state from t""")
def migrated_table(spark: SparkSession, d: str) -> DataFrame:
    """Of four migrations two are applied; the others follow in the order of their numbers."""
    steps = [
        (4, lambda t: t.withColumn("state", F.when(F.col("cancel_requested") == 0, "new"))), (1, lambda t: t.withColumn("size", F.lit(-1))),
        (3, lambda t: t.withColumn("size", F.col("size") * 2).withColumn("cancel_requested", F.lit(0))), (2, lambda t: t.drop("size")),
    ]
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size"))
    return lifecycle.migrated(rows, _cases(spark, [(1,), (2,)], "version int"), steps)[0]


# queues


@query(f"""with {_TASKS}, busy as (select distinct version_id from tasks where status in ('queued', 'running')), w as (select o_orderkey as v from orders where o_orderkey % 2 = 0), a as (select version_id, max(attempt) as n from tasks group by version_id)
select v as version_id, coalesce(n, 0) + 1 as attempt, false as conflict from w left join a on version_id = v where v not in (from busy) union all select v, null, true from w where v in (from busy)""")
def queued_tasks(spark: SparkSession, d: str) -> DataFrame:
    """New tasks for every even version; those with an active one conflict."""
    wanted = _versions(spark, d).where("version_id % 2 = 0").select((-1 - F.col("version_id")).alias("task_id"), "version_id")
    made, conflicts = lifecycle.created_tasks(_tasks(spark, d), wanted, _now())
    return made.where("task_id < 0").select("version_id", "attempt", F.lit(False).alias("conflict")).unionByName(conflicts.withColumn("conflict", F.lit(True)), allowMissingColumns=True)


@query(f"""with {_TASKS}, a as (select *, ['start', 'succeed', 'fail'][1 + version_id % 3] as action from tasks where attempt < 3), s as (select *, case when action = 'start' and status = 'queued' then 'running' when action = 'succeed' and status in ('queued', 'running') then 'succeeded' when action = 'fail' and status in ('queued', 'running') then 'failed' end as after from a)
select t.task_id, coalesce(after, t.status) as status, s.task_id is not null and after is null as refused from tasks t left join s on s.task_id = t.task_id""")
def task_steps(spark: SparkSession, d: str) -> DataFrame:
    """Actions on the first two tasks of each version; what a task's state forbids is refused."""
    tasks = _tasks(spark, d)
    actions = tasks.where("attempt < 3").select("task_id", _pick(["start", "succeed", "fail"], 1 + F.col("version_id") % 3).alias("action"))
    changed, refused = lifecycle.stepped_tasks(tasks, actions, _now())
    no = refused.select("task_id", F.lit(True).alias("refused"))
    return changed.select("task_id", "status").join(no, "task_id", "left").withColumn("refused", F.coalesce("refused", F.lit(False)))


@query(f"""with {_TASKS}, l as (select version_id, status from (select *, row_number() over (partition by version_id order by attempt desc) as n from tasks) where n = 1), busy as (select distinct version_id from tasks where status in ('queued', 'running')),
a as (select version_id, max(attempt) as n from tasks group by version_id)
select version_id, case when status = 'failed' and version_id not in (from busy) then n + 1 end as attempt, status != 'failed' as refused from l join a using (version_id)""")
def retried_tasks(spark: SparkSession, d: str) -> DataFrame:
    tasks = _tasks(spark, d)
    versions = tasks.select("version_id").distinct().withColumn("task_id", -1 - F.col("version_id"))
    made, refused = lifecycle.retried_tasks(tasks, versions, _now())
    rows = versions.select("version_id").join(made.where("task_id < 0").select("version_id", "attempt"), "version_id", "left")
    return rows.join(refused.withColumn("refused", F.lit(True)), "version_id", "left").withColumn("refused", F.coalesce("refused", F.lit(False)))


@query(f"with {_TASKS} select task_id, case when status = 'running' and updated_at < timestamp '1996-01-02 00:00:00' - interval 24 hours then 'failed' else status end as status from tasks")
def recovered_tasks(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.recovered_tasks(_tasks(spark, d), F.lit("1996-01-02 00:00:00").cast("timestamp")).select("task_id", "status")


_ANALYSES = """t as (select o_orderkey as task_id, ['summary', 'methods'][1 + o_orderkey % 2] as operation, [o_custkey, o_custkey + 1] as paper_ids, [o_custkey * 3, o_custkey * 3 + 3] as version_ids, 'standard' as level,
  ['queued', 'running', 'succeeded', 'failed', 'cancelled'][1 + o_orderkey % 5] as status, o_orderkey % 4 = 1 as cancel_requested, o_orderdate as created_at, case when o_orderkey % 5 = 2 then '{}' end as result_json from orders)"""


def _analyses(spark, d) -> DataFrame:
    c = F.col("o_custkey")
    return table(spark, d, "orders").select(
        _o().alias("task_id"), _pick(["summary", "methods"], 1 + _o() % 2).alias("operation"), F.array(c, c + 1).alias("paper_ids"), F.array(c * 3, c * 3 + 3).alias("version_ids"), F.lit("standard").alias("level"),
        _pick(["queued", "running", "succeeded", "failed", "cancelled"], 1 + _o() % 5).alias("status"), (_o() % 4 == 1).alias("cancel_requested"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"),
        F.when(_o() % 5 == 2, "{}").alias("result_json"), F.lit(None).cast("string").alias("message"),
    )


@query(f"""with {_ANALYSES}, a as (select operation, paper_ids, level, arg_max(task_id, (created_at, -task_id)) as held from t where status in ('queued', 'running') group by all), w as (select -c_custkey as id, ['summary', 'methods'][1 + c_custkey % 2] as operation, [c_custkey, c_custkey + 1] as paper_ids from customer)
select id as task_id, held as duplicate_of from w left join a on a.operation = w.operation and a.paper_ids = w.paper_ids""")
def submitted_analyses(spark: SparkSession, d: str) -> DataFrame:
    """An analysis for each customer; those that equal an active one are its duplicates."""
    wanted = table(spark, d, "customer").select((-_c()).alias("task_id"), _pick(["summary", "methods"], 1 + _c() % 2).alias("operation"), F.array(_c(), _c() + 1).alias("paper_ids"), F.array(_c() * 3, _c() * 3 + 3).alias("version_ids"), F.lit("standard").alias("level"))
    made, duplicates = lifecycle.submitted_analyses(_analyses(spark, d), wanted, _now())
    return made.where(F.col("created_at") == _now()).select("task_id", F.lit(None).cast("long").alias("duplicate_of")).unionByName(duplicates)  # keys may be 0, as orders' are


@query(f"""with {_ANALYSES}, x as (select task_id, status, cancel_requested, task_id % 3 = 0 and status in ('queued', 'running') as hit from t), y as (select task_id, case when hit and status = 'queued' then 'cancelled' else status end as status, cancel_requested or hit as asked from x),
z as (select *, task_id % 2 = 0 and status = 'running' as done from y), f as (select task_id, case when done and asked then 'cancelled' when done and task_id % 7 = 0 then 'failed' when done then 'succeeded' else status end as status, asked from z)
select task_id, case when status in ('queued', 'running') then 'failed' else status end as status, asked as cancel_requested from f""")
def analysis_steps(spark: SparkSession, d: str) -> DataFrame:
    """Every third analysis is cancelled, every other one comes to its end, and a restart interrupts what is left."""
    tasks = _analyses(spark, d)
    asked, _ = lifecycle.cancelled_analyses(tasks, tasks.where("task_id % 3 = 0").select("task_id"), _now())
    results = tasks.where("task_id % 2 = 0").select("task_id", F.lit("{}").alias("result_json"), F.when(F.col("task_id") % 7 == 0, "broken").alias("error"))
    done = lifecycle.interrupted_analyses(lifecycle.finished_analyses(asked, results, _now()), _now())
    return done.select("task_id", "status", "cancel_requested")


@query(f"with {_ANALYSES} select task_id from t where status = 'succeeded' and paper_ids[1] % 4 < 3 and paper_ids[2] % 4 < 3 and paper_ids[2] in (select c_custkey from customer)")
def restored_analyses(spark: SparkSession, d: str) -> DataFrame:
    """Results whose papers all have the versions they were made of: those of every fourth paper are new."""
    papers = table(spark, d, "customer").select(_c().alias("paper_id"), F.when(_c() % 4 < 3, _c() * 3).otherwise(-1).alias("active_version_id"))
    return lifecycle.restored_analyses(_analyses(spark, d), papers).select("task_id")


@query(f"""with {_PAPERS}, b as (select c_custkey as paper_id, c_custkey * 7 as version_id, c_custkey % 5 > 0 as model, c_custkey % 6 > 0 as chunks, c_custkey % 8 = 0 as broken from customer where c_custkey % 2 = 0),
o as (select *, case when broken then 'broken' when not model then 'Embedding model version mismatch' when not chunks then 'Chunk version mismatch' end as error from b)
select p.paper_id, case when o.paper_id is not null and error is null then version_id else active_version_id end as active_version_id, case when o.paper_id is not null and error is null then 'ready' else status end as status, error from papers p left join o using (paper_id)""")
def reprocessed_papers(spark: SparkSession, d: str) -> DataFrame:
    papers = _papers(spark, d)
    i = F.col("paper_id")
    builds = papers.where("paper_id % 2 = 0").select("paper_id", (i * 7).alias("version_id"), F.when(i % 5 > 0, "m").otherwise("other").alias("embedding_model_id"), F.when(i % 6 > 0, "v1").otherwise("v0").alias("chunk_version"), F.when(i % 8 == 0, "broken").alias("error"))
    changed, outcome = lifecycle.reprocessed(papers, builds, "m", "v1")
    return changed.select("paper_id", "active_version_id", "status").join(outcome.select("paper_id", "error"), "paper_id", "left")


# views


_LABEL_SQL = "case status " + " ".join(f"when '{k}' then '{v}'" for k, v in lifecycle.PAPER_LABELS.items()) + " end"


@query(f"""with {_PAPERS}, {_TASKS}, l as (select version_id, status as task, error_message from (select *, row_number() over (partition by version_id order by attempt desc) as n from tasks) where n = 1)
select paper_id, title, {_LABEL_SQL} as status_label, coalesce(active_version_id::varchar, '—') as version, case when task in ('queued', 'running') then task else '' end as progress, case when status = 'failed' then 'failed' else coalesce(quality_level, '') end as quality,
  case when task = 'failed' then coalesce(error_message, '') else '' end as error, status in ('ready', 'partially_ready') as readable, coalesce(task = 'failed', false) as can_retry from papers left join l on version_id = active_version_id""")
def library_view(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.library_view(_papers(spark, d).withColumn("active_version_id", F.col("active_version_id").cast("string")), _tasks(spark, d).withColumn("version_id", F.col("version_id").cast("string"))).drop("created_at")


@query("""select conv_id as conversation_id, string_agg(turn || ':' || role || ':' || case turn % 4 when 0 then '充分' when 1 then '证据不足' else '' end, ',' order by turn) as messages, case when conv_id % 3 > 0 then conv_id % 10 || ',' || (conv_id % 10 + 1) end as papers, (conv_id % 2)::int as events from conversations group by conv_id""")
def conversation_view(spark: SparkSession, d: str) -> DataFrame:
    talk = table(spark, d, "conversations").withColumnRenamed("conv_id", "conversation_id")
    own, i = talk.select("conversation_id").distinct(), F.col("conversation_id")
    papers = own.where("conversation_id % 3 > 0").select("conversation_id", F.explode(F.array(i % 10 + 1, i % 10)).alias("paper_id"))
    state = F.when(F.col("turn") % 4 == 0, "answered").when(F.col("turn") % 4 == 1, "insufficient_evidence")
    messages = talk.select("conversation_id", F.col("turn").alias("created_at"), F.col("turn").alias("message_id"), "role", F.col("text").alias("content"), state.alias("answer_status"))
    events = own.where("conversation_id % 2 = 1").select("conversation_id", F.lit(1).alias("created_at"), F.lit(1).alias("event_id"), F.lit("library").alias("scope_mode"))
    got = lifecycle.conversation_view(own, papers, messages, events)
    told = F.transform("messages", lambda m: F.concat_ws(":", m["created_at"].cast("string"), m["role"], m["answer_label"]))
    told = F.transform(told, lambda t: t)
    return got.select("conversation_id", F.array_join(told, ",").alias("messages"), F.array_join(F.transform("papers", lambda p: p["paper_id"].cast("string")), ",").alias("papers"), F.coalesce(F.size("scope_events"), F.lit(0)).alias("events"))


@query("""select page_id, page_id % 4 as page, page_id % 4 + 1 as page_label from pages where page_id % 5 > 0 union all select page_id, null, null from pages where page_id % 5 = 0""")
def page_labels(spark: SparkSession, d: str) -> DataFrame:
    page = F.when(F.col("page_id") % 5 > 0, F.col("page_id") % 4)
    return table(spark, d, "pages").select("page_id", page.alias("page"), page_label(page).alias("page_label"))


@query("select strftime(time_bucket(interval 1 hour, ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n from events group by all")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return ingest.event_counts(table(spark, d, "events")).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("""select vec_id, label from embeddings where vec_id % 2 = 0 or vec_id % 3 = 0""")
def idempotent_adds(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", "label")
    once = sinks.add_new(rows.where("vec_id % 2 = 0"), rows.where("vec_id % 3 = 0"), "vec_id")
    return sinks.add_new(once, rows.where("vec_id % 3 = 0"), "vec_id")


# answers


def _answering(spark, d) -> tuple[answering.Answering, DataFrame]:
    """Documents as chunks of ten papers; a generator that claims the first evidence, and one that isn't there for every third question."""
    i = F.col("doc_id")
    chunks = table(spark, d, "documents").select(
        i.cast("string").alias("chunk_id"), (i % 10).cast("string").alias("paper_id"), F.lit("v1").alias("version_id"), "text", F.lit(None).cast("string").alias("parent_chunk_id"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"),
        F.array().cast("array<string>").alias("section_path"), F.lit(None).cast("double").alias("quality_score"),
    )
    papers = spark.range(10).select(F.col("id").cast("string").alias("paper_id"), F.concat(F.lit("Paper "), F.col("id").cast("string")).alias("title"))

    def by_keyword(queries: DataFrame) -> DataFrame:
        asked = queries.withColumn("paper_ids", F.transform("paper_ids", lambda p: p.cast("long"))).withColumn("include_references", F.lit(True))
        return base._index(spark, d).search(asked, 20).withColumn("chunk_id", F.col("chunk_id").cast("string"))

    def generate(rows: DataFrame) -> DataFrame:
        first = F.get_json_object("evidence", "$[0].evidence_id")
        claims = F.concat(F.lit('[{"text": "first", "evidence_ids": ["'), first, F.lit('"], "support": "direct"}'), F.when(F.col("query_id") % 3 == 0, ', {"text": "second", "evidence_ids": ["ev_none"], "support": "direct"}').otherwise(""), F.lit("]"))
        return rows.withColumn("response", F.concat(F.lit('{"answer_status": "answered", "concise_answer": "yes", "claims": '), claims, F.lit(', "uncertainty": [], "conflicts": [], "unanswered_items": [], "refusal_reason": null}')))

    questions = base._questions(spark, d).select(
        "query_id", F.when(F.col("query_id") % 7 == 0, "").when(F.col("query_id") % 5 == 0, "What of this paper").otherwise(F.col("text")).alias("question"),
        F.when(F.col("query_id") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array((F.col("query_id") % 10).cast("string"), ((F.col("query_id") + 1) % 10).cast("string"))).alias("paper_ids"),
        F.lit("selected").alias("scope_mode"), F.lit(None).cast("string").alias("previous"),
    )
    return answering.Answering(chunks, papers, {"keyword": by_keyword}, generator=generate, window=1 << 20), questions


@query(base._BM25 + f""", l as (select query_id, chunk_id, rank from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from s join documents on doc_id = chunk_id where chunk_id % 10 in (query_id % 10, (query_id + 1) % 10)) where rank <= 20), {base._SCORES.replace("select c.*,", "select c.*, round(1.0::double / (60 + rank), 12) as rrf,").replace("from c join tq", "from (select l.* from l) c join tq")},
w as (select p.*, row_number() over (partition by query_id, chunk_id % 10, replace(lower(trim(regexp_replace(text, '[\\x09-\\x0D\\x1C-\\x20\\x85\\p{{Z}}]+', ' ', 'g'))), 'ß', 'ss') order by rrf desc, chunk_id) as copy from pairs p join documents on doc_id = chunk_id),
best as (select query_id, first(chunk_id order by score desc, rrf desc, chunk_id) as chunk_id from w where copy = 1 and score >= 0.1 group by query_id),
a as (select item_id as query_id, case when item_id % 7 = 0 then 'empty_question' when item_id % 5 = 0 then '{planner.AMBIGUOUS}' when item_id % 4 = 0 then '{planner.UNSCOPED}' end as why from benchmark)
select query_id, case when why is not null then 'out_of_scope' when chunk_id is null then 'insufficient_evidence' when query_id % 3 = 0 then 'partially_answered' else 'answered' end as answer_status,
  case when why is null and chunk_id is not null then 'Paper ' || chunk_id % 10 || ' (v1), p. 1, Unsectioned' else '' end as citations, coalesce(why, case when chunk_id is null then '{grounding.UNSUPPORTED}' end) as refusal_reason,
  case when why is null and chunk_id is not null and query_id % 3 = 0 then 'Unknown Evidence ID: ev_none' else '' end as warnings from a left join best using (query_id)""")
def answered_questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions through the whole chain: plans, recall, reranking, evidence, a generator's answer, verification, citations."""
    chain, questions = _answering(spark, d)
    got = chain.answers(questions)
    return got.select("query_id", "answer_status", F.array_join("citations", ";").alias("citations"), "refusal_reason", F.array_join("warnings", ";").alias("warnings"))


@query("""with f as (select doc_id as chunk_id, doc_id % 10 as paper_id, ['a', 'b', 'c', 'd'][1 + doc_id % 4] as facet, (doc_id % 17) / 20.0 as score from documents),
n as (select *, row_number() over (partition by paper_id, facet order by score desc, chunk_id) as n from f), k as (select *, row_number() over (partition by paper_id order by score desc, chunk_id) as rank from n where n <= 6),
l as (select *, row_number() over (partition by paper_id, facet order by rank) = 1 as led from k), o as (select *, row_number() over (partition by paper_id order by led desc, rank) as place from l)
select paper_id, place - 1 as ord, chunk_id, 'Paper ' || paper_id as paper_title from o where place <= 12""".replace("place - 1 as ord", "place::int as ord"))
def facet_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of each paper for an analysis: of four facets six hits each, the best of each facet first."""
    i = F.col("doc_id")
    hits = table(spark, d, "documents").select((i % 10).alias("paper_id"), _pick(["a", "b", "c", "d"], 1 + i % 4).alias("facet"), i.alias("chunk_id"), ((i % 17) / 20.0).alias("score"), F.lit(0.0).alias("rrf"))
    chunks = table(spark, d, "documents").select(
        i.alias("chunk_id"), (i % 10).alias("paper_id"), F.lit("v1").alias("version_id"), "text", F.lit(1).alias("page_start"), F.lit(1).alias("page_end"), F.array().cast("array<string>").alias("section_path"), F.lit(None).cast("double").alias("quality_score"),
    )
    papers = spark.range(10).select(F.col("id").alias("paper_id"), F.concat(F.lit("Paper "), F.col("id").cast("string")).alias("title"))
    return answering.facet_registries(hits, chunks, papers, "innovation").select("paper_id", "ord", "chunk_id", "paper_title")



