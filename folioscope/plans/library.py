"""Registered queries of the library's upkeep: recall stages, pages, chunk parents, prompts, tasks, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text as tx
from folioscope.operators import chunking, grounding, lifecycle, normalize, retrieval
from folioscope.plans import queries as base
from folioscope.plans.queries import query
from folioscope.sources.readers import table

_KEY = "replace(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 'ß', 'ss')"


@query(base._BM25 + f""", c as (select query_id, chunk_id from r where rank <= 5), {base._SCORES}
select * from (select query_id, chunk_id, score, row_number() over (partition by query_id order by score desc, chunk_id) as rank from pairs) where rank <= 3""")
def two_stage_recall(spark: SparkSession, d: str) -> DataFrame:
    asked, docs = base._questions(spark, d), base._docs(spark, d)
    return retrieval.two_stage(base._index(spark, d).search(asked, limit=5), asked, base._index(spark, d).docs.select("chunk_id", F.col("tokens").alias("text")))


@query(base._BM25 + """, h as (select query_id, chunk_id, rank, row_number() over (partition by query_id, lang order by rank) = 1 as led from r join documents on doc_id = chunk_id where rank <= 50)
select * from (select query_id, chunk_id, row_number() over (partition by query_id order by led desc, rank) as place from h) where place <= 12""")
def facet_search(spark: SparkSession, d: str) -> DataFrame:
    hits = base._index(spark, d).search(base._questions(spark, d), limit=50)
    facets = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("facet"))
    return retrieval.spread_over_facets(hits.join(facets, "chunk_id"))


@query(base._VEC.replace("from q, embeddings v", "from q, embeddings v where label < 4").format(score="round(list_dot_product(e, v.embedding::double[]) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(v.embedding::double[], v.embedding::double[]))), 9)"))
def vector_search_filtered(spark: SparkSession, d: str) -> DataFrame:
    """The vectors are filtered before the nearest are taken."""
    return retrieval.vector_search(base._asked(spark, d), base._vectors(spark, d).where("label < 4")).withColumn("score", F.round("score", 6))


@query("""with a as (select user_id as query_id, case when event_type in ('click', 'view') then 'vector' else 'keyword' end as route, event_type = 'error' as failed from events)
select query_id, count_if(failed) as failures, count_if(failed) > 0 or count(distinct case when not failed then route end) < 2 as degraded from a group by query_id""")
def route_health(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    return retrieval.route_health(table(spark, d, "events").select(F.col("user_id").alias("query_id"), F.when(kind.isin("click", "view"), "vector").otherwise("keyword").alias("route"), (kind == "error").alias("failed")))


@query(base._BM25 + """, c as (select query_id, rank, text from r join documents on doc_id = chunk_id where rank <= 3)
select query_id, 'Context:' || chr(10) || string_agg(c.text, chr(10) || '---' || chr(10) order by rank) || chr(10) || chr(10) || 'Question: ' || any_value(b.text) as prompt from c join benchmark b on item_id = query_id group by query_id""")
def question_prompts(spark: SparkSession, d: str) -> DataFrame:
    asked, docs = base._questions(spark, d), base._docs(spark, d)
    hits = base._index(spark, d).search(asked, limit=3).select("query_id", "chunk_id", "rank")
    return grounding.prompts(hits.join(docs, "chunk_id").join(asked.select("query_id", F.col("text").alias("question")), "query_id"))


def _lines(spark, d) -> DataFrame:
    """Lines of documents: every twentieth is a page's header, the one before it a footer."""
    pos = F.col("pos")
    label = F.when(pos % 20 == 0, "page_header").when(pos % 20 == 19, "page_footer").otherwise("text")
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("version_id"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return rows.select("version_id", (F.floor(pos / 20) + 1).cast("long").alias("page_no"), "pos", label.alias("label"), "text")


_LINES = "l as (select doc_id as version_id, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents)"


@query(f"""with {_LINES}, m as (select *, pos % 20 in (0, 19) as margin from l), n as (select *, count(*) over (partition by version_id, margin, {_KEY}) as n from m)
select version_id, count(*) as lines, count_if(margin) as margins from n where not margin or n = 1 group by version_id""")
def margin_repeats(spark: SparkSession, d: str) -> DataFrame:
    left = normalize.without_margins(_lines(spark, d))
    return left.groupBy("version_id").agg(F.count("*").alias("lines"), F.count_if(F.col("label") != "text").alias("margins"))


@query(f"""with {_LINES}, n as (select *, pos // 20 as page, replace(lower(regexp_replace(text, '\\s+', '', 'g')), 'ß', 'ss') as k from l)
select version_id, count(*) as fresh from n o where pos % 2 = 1 and not exists (select 1 from n where n.version_id = o.version_id and n.page = o.page and n.k = o.k and n.k != '' and n.pos % 2 = 0) group by version_id""")
def ocr_merge(spark: SparkSession, d: str) -> DataFrame:
    """Even lines as native text, odd ones as OCR lines."""
    rows = _lines(spark, d)
    merged = normalize.with_ocr(rows.where("pos % 2 = 0"), rows.where("pos % 2 = 1"))
    return merged.where("source = 'rapidocr'").groupBy("version_id").agg(F.count("*").alias("fresh"))


@query(f"""with {_LINES}, b as (select version_id, pos // 20 + 1 as page_no, (pos % 3) * 300.0 - 50 as x0, (pos % 20) * 45.0 as y0, text, length(regexp_replace(text, '\\s', '', 'g')) as chars, length(regexp_replace(text, '[^\\x{{FFFD}}\\p{{Cc}}]|\\s', '', 'g')) as bad from l),
p as (select version_id, page_no, sum(chars)::bigint as chars, sum(bad) as bad, sum(greatest(0.0, least(x0 + 280, 612) - greatest(x0, 0.0)) * greatest(0.0, least(y0 + 30, 792) - greatest(y0, 0.0)))::double as area from b group by all),
m as (select version_id, page_no, chars, round(least(1.0::double, area / (612.0 * 792)), 9) as coverage, round(case when chars = 0 then 0 else bad::double / chars end, 9) as garbled from p)
select *, chars < 40 or coverage < 0.002 or garbled > 0.1 as needs_ocr from m""")
def page_metrics(spark: SparkSession, d: str) -> DataFrame:
    x, y = (F.col("pos") % 3) * 300.0 - 50, (F.col("pos") % 20) * 45.0
    boxes = _lines(spark, d).select("version_id", "page_no", "text", x.alias("x0"), y.alias("y0"), (x + 280).alias("x1"), (y + 30).alias("y1"), F.lit(612.0).alias("width"), F.lit(792.0).alias("height"))
    return normalize.page_metrics(boxes)


@query("""select event_id, case when event_type = 'signup' then 'failed' when value > 100 or event_type = 'error' or (value / 100 < 0.6 and event_type = 'view') then 'partially_ready' else 'ready' end as level from events""")
def page_levels(spark: SparkSession, d: str) -> DataFrame:
    """Events as pages: their type tells text and OCR status, their value garbling and confidence."""
    kind, value = F.col("event_type"), F.col("value")
    status = F.when(kind == "error", "failed").otherwise("success")
    level = normalize.page_level(kind != "signup", value / 1000, status, F.when(kind == "view", value / 100))
    return table(spark, d, "events").select("event_id", level.alias("level"))


@query("""with w as (select doc_id, source, text, unnest(range(0, length(text), 320)) as i from documents where length(text) > 0)
select doc_id, i // 320 as part, coalesce(source, '') || '::' || (i // 320) || '::' || substr(md5(substr(text, i + 1, 400)), 1, 12) as chunk_id from w""")
def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", F.posexplode(tx.windows(F.col("text"), 400, 80)).alias("part", "piece"))
    return docs.select("doc_id", "part", chunking.source_ids(F.col("source"), F.col("part"), F.col("piece")).alias("chunk_id"))


_NEAR = base._VEC.format(score="round(list_dot_product(e, v.embedding::double[]) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(v.embedding::double[], v.embedding::double[]))), 9)")


@query(base._CHILDREN + f""", hits as (select query_id as question_id, (rank - 1)::int as ord, chunk_id as id from ({_NEAR}) where rank <= 5),
y as (select c.version_id, c.seq, c.chunk_id, p.chunk_id as parent_id, lag(c.chunk_id) over w as previous_id, lead(c.chunk_id) over w as next_id, case when c.kind = 'table' then lead(c.chunk_id) over w end as related
  from c join h using (version_id, seq) join p on p.version_id = c.version_id and p.parent = h.grp window w as (partition by c.version_id order by seq)),
s as (select question_id, ord, y.* from hits join y on y.version_id = hits.id and y.seq = ord),
o as (select question_id, ord, chunk_id as seed, unnest([chunk_id, parent_id, previous_id, next_id, related]) as id, unnest(range(5)) as step from s),
k as (select *, row_number() over (partition by question_id, id order by ord, step) as n from o where id is not null)
select question_id, ord::int as ord, step::int as step, id as chunk_id, ['reranked', 'parent', 'adjacent', 'adjacent', 'special_relation'][step + 1] as reason, seed from k where n = 1""")
def context_expansion(spark: SparkSession, d: str) -> DataFrame:
    """Of the five documents nearest to each question's vector, a chunk each, with its parent and neighbours; a table is related to what follows it."""
    chunks = base._chunked(spark, d)
    kids = chunking.children(chunks).withColumn("related", F.when(F.col("content_type") == "table", F.array_compact(F.array("next_id"))))
    seeds = retrieval.vector_search(base._asked(spark, d), base._vectors(spark, d), limit=5).withColumn("ord", F.col("rank") - 1)
    place = seeds.select(F.col("query_id").alias("question_id"), "ord", F.col("chunk_id").cast("string").alias("version_id"), F.col("ord").alias("seq"))
    chosen = place.join(kids.select("version_id", "seq", "chunk_id"), ["version_id", "seq"]).select("question_id", "ord", "chunk_id")
    return grounding.expanded(chosen, kids.select("chunk_id", F.col("parent_chunk_id").alias("parent_id"), "previous_id", "next_id", "related"))


_SECTIONS_SQL = "case level " + " ".join(f"when '{k}' then {v}" for k, v in grounding.SECTIONS.items()) + " end"


@query(f"""with g as (select o_custkey as id, ['quick', 'standard', 'detailed'][1 + o_custkey % 3] as level, {grounding.SECTIONS['detailed']}[1 + o_orderkey % 6] as name from orders),
h as (select id, level, list(distinct name) as names from g group by all)
select id, level, array_to_string(list_filter({_SECTIONS_SQL}, lambda x: not list_contains(names, x)), ',') as missing from h""")
def summary_gaps(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), n.cast("int"))
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), pick(["quick", "standard", "detailed"], 1 + F.col("o_custkey") % 3).alias("level"), pick(grounding.SECTIONS["detailed"], 1 + F.col("o_orderkey") % 6).alias("name"))
    return grounding.missing_sections(rows).withColumn("missing", F.array_join("missing", ","))


_CLAIMS = ["A first ever result", "State-of-the-art accuracy", "A sparser index", "首次提出", "Fewer labels are needed"]


@query(f"""with c as (select event_id, {_CLAIMS}[1 + event_id % 5] as claim, event_type, user_id % 4 as other from events)
select event_id, case when regexp_matches(claim, '{grounding.FIELD_CLAIM}') then 'field_claim' when event_type = 'error' then 'uncited' when other = 3 then 'beyond_scope' else 'accepted' end as verdict from c""")
def novelty_checks(spark: SparkSession, d: str) -> DataFrame:
    claim = F.element_at(F.array(*[F.lit(x) for x in _CLAIMS]), (1 + F.col("event_id") % 5).cast("int"))
    cited = F.when(F.col("event_type") != "error", F.array("event_id"))
    scope = F.array(*[F.lit(x).cast("long") for x in range(3)])
    return table(spark, d, "events").select("event_id", grounding.novelty_verdict(claim, cited, F.array(F.col("user_id") % 4), scope).alias("verdict"))


@query(f"""with s as (select event_id, ['OCR page', 'vector upsert', 'rerank', 'file move'][1 + event_id % 4] as stage, 1 + user_id % 4 as attempt from events), k as (select *, {base._KIND_SQL} as kind from s)
select event_id, kind, case when kind in ('glm', 'vector_index', 'keyword_index', 'database', 'filesystem') and attempt < 3 then 'retry' else 'give_up' end as step from k""")
def retry_steps(spark: SparkSession, d: str) -> DataFrame:
    stage = F.element_at(F.array(*[F.lit(x) for x in ("OCR page", "vector upsert", "rerank", "file move")]), (1 + F.col("event_id") % 4).cast("int"))
    rows = table(spark, d, "events").select("event_id", lifecycle.failure_kind(stage).alias("kind"), (1 + F.col("user_id") % 4).alias("attempt"))
    return rows.select("event_id", "kind", lifecycle.next_step(F.col("kind"), F.col("attempt")).alias("step"))


@query(f"""with e as (select user_id % 40 as version_id, user_id as task_id, ts, event_id, {base._STATES} as status from events),
l as (select *, row_number() over (partition by task_id order by ts desc, event_id desc) as k from e)
select version_id, count(*) as active from l where k = 1 and status in ('queued', 'running') group by version_id having count(*) > 1""")
def active_conflicts(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select((F.col("user_id") % 40).alias("version_id"), F.col("user_id").alias("task_id"), "ts", "event_id", F.expr(base._STATES).alias("status"))
    return lifecycle.active_conflicts(lifecycle.latest(events, ["task_id"], [F.desc("ts"), F.desc("event_id")]))


@query("""select l_orderkey as id, bool_and(p_partkey is not null) as valid from lineitem left join part on p_partkey = l_partkey and p_size % 2 = l_suppkey % 2 group by id""")
def analysis_validity(spark: SparkSession, d: str) -> DataFrame:
    results = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("paper_id"), (F.col("l_suppkey") % 2).alias("version_id"))
    active = table(spark, d, "part").select(F.col("p_partkey").alias("paper_id"), (F.col("p_size") % 2).alias("version_id"))
    return lifecycle.still_valid(results, active)


@query("select distinct l_orderkey as id from lineitem where l_partkey in (select p_partkey from part where p_size < 5) or l_suppkey in (select p_partkey from part where p_size < 5)")
def history_marks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.array("l_partkey", "l_suppkey").alias("paper_ids"))
    return lifecycle.touched(rows, table(spark, d, "part").where("p_size < 5").select(F.col("p_partkey").alias("paper_id")), "id")


@query("""with e as (select user_id as id, event_id, event_type as scope, lag(event_type) over (partition by user_id order by ts, event_id) as previous from events)
select * from e where scope is distinct from previous""")
def scope_history(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.scope_changes(table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("ts").alias("at"), "event_id", F.col("event_type").alias("scope")))


@query("""with s as (select s_nationkey, case when s_acctbal < 0 then 'unavailable' when s_acctbal < 2000 then 'warning' else 'available' end as status from supplier)
select s_nationkey, case when bool_or(status = 'unavailable') then 'unavailable' when bool_or(status = 'warning') then 'warning' else 'available' end as status from s group by s_nationkey""")
def health_rollup(spark: SparkSession, d: str) -> DataFrame:
    balance = F.col("s_acctbal")
    status = F.when(balance < 0, "unavailable").when(balance < 2000, "warning").otherwise("available")
    return lifecycle.worst(table(spark, d, "supplier").select("s_nationkey", status.alias("status")), "s_nationkey")


@query("select conv_id, turn, case when trim(coalesce(text, '')) = '' then 'empty' when length(trim(text)) > 200 then 'too_long' end as problem from conversations")
def question_limits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", lifecycle.question_problem(F.col("text"), 200).alias("problem"))


@query("""with n as (select *, row_number() over (partition by conv_id order by turn) as seq, row_number() over (partition by conv_id order by turn desc) as back, count(*) over (partition by conv_id) as total from conversations),
k as (select *, total <= 4 or seq = 1 or back <= 3 as stays from n)
select conv_id, turn, role, text from k where stays union all select conv_id, min(turn), 'system', left(string_agg(text, chr(10) order by turn), 150) from k where not stays group by conv_id""")
def compressed_history(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.compressed(table(spark, d, "conversations"), most=4)
