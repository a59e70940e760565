"""The registered queries of the engine's operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions import text as tx
from folioscope.operators import chunking, grounding, lifecycle, normalize, planner, retrieval, vectors
from folioscope.sources.readers import page_texts, table
from folioscope.sources.sinks import KeywordStore
from folioscope.sources.work import work_folder

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        if f.__name__ in QUERIES:
            raise ValueError(f"there is a query {f.__name__} already")
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _docs(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


def _questions(spark, d) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def _asked(spark, d) -> DataFrame:
    """Question vectors: the vector of the item's own number."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    return items.join(_vectors(spark, d).select(F.col("chunk_id").alias("query_id"), "embedding"), "query_id")


_INDEXES: dict[tuple[str, str], retrieval.KeywordIndex] = {}


def _index(spark, d) -> retrieval.KeywordIndex:
    """The stored keyword index of a folder's documents, built once a session: ten papers, versions by language, French as references."""
    key = spark.sparkContext.applicationId, d
    if key not in _INDEXES:
        kind = F.when(F.col("lang") == "fr", "reference").otherwise("text")
        chunks = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text", (F.col("doc_id") % 10).alias("paper_id"), F.col("lang").alias("version_id"), kind.alias("content_type"))
        _INDEXES[key] = retrieval.build_index(chunks, work_folder(spark, "keyword-index"))
    return _INDEXES[key]


def _scoped(questions: DataFrame) -> DataFrame:
    """Questions with scopes: three papers for two of three, English and German versions for every other one, references for every fifth."""
    i = F.col("query_id")
    papers = F.when(i % 3 > 0, F.array(i % 10, (i + 3) % 10, (i + 6) % 10))
    versions = F.when(i % 2 == 0, F.array(F.lit("en"), F.lit("de")))
    return questions.withColumn("paper_ids", papers).withColumn("version_ids", versions).withColumn("include_references", i % 5 == 0)


def _blocks(spark, d) -> DataFrame:
    """Documents as versions, lines as blocks: the first is a heading, every tenth a table, the next its caption."""
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("version_id"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    label = F.when(F.col("pos") == 0, "title").when(F.col("pos") % 10 == 5, "table").when(F.col("pos") % 10 == 6, "caption").otherwise("text")
    return lines.select("version_id", (F.floor(F.col("pos") / 20) + 1).cast("long").alias("page_no"), "pos", label.alias("label"), "text")


_MARK = f"translate(replace(lower(%s), 'ß', 'ss'), '{tx.MARKED}', '{tx.PLAIN}')"
_TOKENS = """list_concat(list_concat(regexp_extract_all({f}, '[\\p{{L}}\\p{{N}}]+'),
  list_concat(regexp_extract_all(array_to_string(regexp_extract_all({f}, '[a-z0-9]+(?:[-_.][a-z0-9]+)+|[a-z]+[0-9]+[a-z0-9-]*'), ' '), '[\\p{{L}}\\p{{N}}]+'),
  regexp_extract_all(array_to_string(regexp_extract_all({f}, '[a-z0-9]+(?:[-_.][a-z0-9]+)+|[a-z]+[0-9]+[a-z0-9-]*'), ' '), '[\\p{{L}}\\p{{N}}]+'))), [])"""
_T = _TOKENS.format(f=_MARK % "text")
_BM25 = f"""with t as (select doc_id as chunk_id, {_T} as terms from documents),
n as (select count(*) as n_docs, avg(len(terms)) as avgdl from t),
p as (select chunk_id, len(terms) as dl, unnest(terms) as term from t),
g as (select term, chunk_id, count(*) as tf, any_value(dl) as dl from p group by all),
f as (select term, count(*) as df from g group by term),
q as (select query_id, translate(word, '{tx.MARKED}', '{tx.PLAIN}') as term from (
  select distinct item_id as query_id, unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}_]+')) as word from benchmark)),
s as (select query_id, chunk_id, round(sum(case when ln((n_docs - df + 0.5) / (df + 0.5)) > 0 then ln((n_docs - df + 0.5) / (df + 0.5)) else 1e-6 end
    * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 9) as score
  from q join g using (term) join f using (term) cross join n group by all),
r as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from s)
"""


@query(_BM25 + "select query_id, chunk_id, round(score, 6) as score, rank from r where rank <= 10")
def keyword_search(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).search(_questions(spark, d)).withColumn("score", F.round("score", 6))


_IN_SCOPE = """(query_id % 3 = 0 or {i} % 10 in (query_id % 10, (query_id + 3) % 10, (query_id + 6) % 10)) and (query_id % 2 = 1 or lang in ('en', 'de')) and (query_id % 5 = 0 or lang is distinct from 'fr')"""


@query(_BM25.replace("from s)", f"from s join documents on doc_id = chunk_id where {_IN_SCOPE.format(i='doc_id')})") + "select query_id, chunk_id, round(score, 6) as score, rank from r where rank <= 10")
def keyword_search_scoped(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).search(_scoped(_questions(spark, d))).withColumn("score", F.round("score", 6))


#: Two words side by side, as a question for an identifier of both.
_PAIR = "(?:^|[^\\p{L}])([a-z]{3,}) ([a-z]{3,})(?:[^\\p{L}]|$)"


@query(f"""with t as (select doc_id as chunk_id, {_T} as terms from documents), n as (select count(*) as n_docs, avg(len(terms)) as avgdl from t),
w as (select item_id as query_id, regexp_extract(replace(lower(text), 'ß', 'ss'), '{_PAIR}', 1) as a, regexp_extract(replace(lower(text), 'ß', 'ss'), '{_PAIR}', 2) as b from benchmark),
q as (select distinct query_id, unnest([[a], [b], [a, b]]) as phrase from w where a != ''),
h as (select phrase, chunk_id, len(terms) as dl, len(list_filter(range(1, len(terms) - len(phrase) + 2), lambda i: terms[i] = phrase[1] and (len(phrase) = 1 or terms[i + 1] = phrase[2]))) as tf
  from (select distinct phrase from q) join t on list_has_all(terms, phrase)),
f as (select phrase, count(*) as df from h where tf > 0 group by phrase),
s as (select query_id, chunk_id, round(sum(case when ln((n_docs - df + 0.5) / (df + 0.5)) > 0 then ln((n_docs - df + 0.5) / (df + 0.5)) else 1e-6 end
    * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 9) as score from q join h using (phrase) join f using (phrase) cross join n where tf > 0 group by all),
r as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from s)
select query_id, chunk_id, round(score, 6) as score, rank from r where rank <= 10""")
def keyword_phrases(spark: SparkSession, d: str) -> DataFrame:
    low = F.replace(F.lower("text"), F.lit("ß"), F.lit("ss"))
    a, b = (F.regexp_extract(low, _PAIR, i) for i in (1, 2))
    asked = _questions(spark, d).select("query_id", F.when(a != "", F.concat(a, F.lit("-"), b)).alias("text"))
    return _index(spark, d).search(asked).withColumn("score", F.round("score", 6))


#: Three words side by side, as a question for an identifier of them all.
_TRIPLE = "(?:^|[^\\p{L}])([a-z]{2,}) ([a-z]{2,}) ([a-z]{2,})(?:[^\\p{L}]|$)"


@query(f"""with t as (select doc_id as chunk_id, {_T} as terms from documents), n as (select count(*) as n_docs, avg(len(terms)) as avgdl from t),
w as (select item_id as query_id, [regexp_extract(replace(lower(text), 'ß', 'ss'), '{_TRIPLE}', 1), regexp_extract(replace(lower(text), 'ß', 'ss'), '{_TRIPLE}', 2), regexp_extract(replace(lower(text), 'ß', 'ss'), '{_TRIPLE}', 3)] as w from benchmark),
q as (select distinct query_id, unnest([w[1:1], w[2:2], w[3:3], w]) as phrase from w where w[1] != ''),
h as (select phrase, chunk_id, len(terms) as dl, len(list_filter(range(1, len(terms) - len(phrase) + 2), lambda i: terms[i:i + len(phrase) - 1] = phrase)) as tf
  from (select distinct phrase from q) join t on list_has_all(terms, phrase)),
f as (select phrase, count(*) as df from h where tf > 0 group by phrase),
s as (select query_id, chunk_id, round(sum(case when ln((n_docs - df + 0.5) / (df + 0.5)) > 0 then ln((n_docs - df + 0.5) / (df + 0.5)) else 1e-6 end
    * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 9) as score from q join h using (phrase) join f using (phrase) cross join n where tf > 0 group by all),
r as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from s)
select query_id, chunk_id, round(score, 6) as score, rank from r where rank <= 10""")
def keyword_long_phrases(spark: SparkSession, d: str) -> DataFrame:
    low = F.replace(F.lower("text"), F.lit("ß"), F.lit("ss"))
    words = [F.regexp_extract(low, _TRIPLE, i) for i in (1, 2, 3)]
    asked = _questions(spark, d).select("query_id", F.when(words[0] != "", F.concat_ws("-", *words)).alias("text"))
    return _index(spark, d).search(asked).withColumn("score", F.round("score", 6))


@query(_BM25.replace("from documents)", "from documents where doc_id % 10 != 3)", 1) + "select query_id, chunk_id, round(score, 6) as score, rank from r where rank <= 10")
def keyword_upserts(spark: SparkSession, d: str) -> DataFrame:
    """A store that took drafts of a fifth of the documents, the whole texts of them in two upserts, and lost a tenth of all; its segments were merged meanwhile."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text", (F.col("doc_id") % 10).alias("paper_id"), F.col("lang").alias("version_id"))
    store = KeywordStore(spark, work_folder(spark, "keyword-store"), {}, tier=2)
    store.upsert(docs.where("chunk_id % 5 > 0"))
    store.upsert(docs.where("chunk_id % 5 = 0").withColumn("text", F.concat(F.lit("draft of the "), F.left("text", F.lit(200)))))
    for part in (0, 1):
        store.upsert(docs.where(f"chunk_id % 5 = 0 and chunk_id % 2 = {part}"))
    store.delete(papers=[3])
    return store.search(_questions(spark, d)).withColumn("score", F.round("score", 6))


@query(f"with t as (select {_T} as terms from documents), p as (select unnest(terms) as term from t) select term, count(*) as n, any_value(df) as df from p join (select term, count(*) as df from (select distinct term, i from (select unnest(terms) as term, i from (select terms, row_number() over () as i from t))) group by term) using (term) group by term")
def keyword_terms(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).term_counts()


_VEC = """with q as (select b.item_id as query_id, e.embedding::double[] as e from benchmark b join embeddings e on e.vec_id = b.item_id),
s as (select query_id, vec_id as chunk_id, {score} as score from q, embeddings v),
r as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from s)
select query_id, chunk_id, round(score, 6) as score, rank from r where rank <= 10"""


@query(_VEC.format(score="round(list_dot_product(e, v.embedding::double[]) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(v.embedding::double[], v.embedding::double[]))), 9)"))
def vector_search_cosine(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.vector_search(_asked(spark, d), _vectors(spark, d)).withColumn("score", F.round("score", 6))


@query(_VEC.format(score="0.0::double - round(pow(list_distance(e, v.embedding::double[]), 2), 9)"))
def vector_search_squared(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.vector_search(_asked(spark, d), _vectors(spark, d), metric="squared").withColumn("score", F.round("score", 6))


def _papers_of(vectors: DataFrame) -> DataFrame:
    """Vectors of ten papers, versions by their number and references."""
    i = F.col("chunk_id")
    return vectors.withColumn("paper_id", i % 10).withColumn("version_id", F.element_at(F.array(*[F.lit(x) for x in ("en", "de", "es")]), (1 + i % 3).cast("int"))).withColumn("content_type", F.when(i % 4 == 0, "reference").otherwise("text"))


@query(_VEC.format(score="round(list_dot_product(e, v.embedding::double[]) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(v.embedding::double[], v.embedding::double[]))), 9)").replace(
    "from q, embeddings v)", "from q, (select *, ['en', 'de', 'es'][1 + vec_id % 3] as lang from embeddings) v where (query_id % 3 = 0 or vec_id % 10 in (query_id % 10, (query_id + 3) % 10, (query_id + 6) % 10)) and (query_id % 2 = 1 or lang in ('en', 'de')) and (query_id % 5 = 0 or vec_id % 4 > 0))"))
def vector_search_scoped(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.vector_search(_scoped(_asked(spark, d)), _papers_of(_vectors(spark, d))).withColumn("score", F.round("score", 6))


@query()
def vector_index_search(spark: SparkSession, d: str) -> DataFrame:
    """The scoped questions by the partitioned index, which tests hold against the exact search."""
    index = vectors.build_vector_index(_papers_of(_vectors(spark, d).drop("label")), work_folder(spark, "vector-index"))
    return index.search(_scoped(_asked(spark, d))).withColumn("score", F.round("score", 6))


def _routes(spark, d) -> DataFrame:
    near = retrieval.vector_search(_asked(spark, d), _vectors(spark, d), limit=50).select("query_id", "chunk_id", "rank", F.lit("vector").alias("route"))
    words = _index(spark, d).search(_questions(spark, d), limit=50).select("query_id", "chunk_id", "rank", F.lit("keyword").alias("route"))
    known = _index(spark, d).docs.select("chunk_id", "content_key", "paper_id")
    return retrieval.of_chunks(near.unionAll(words), known)


_FUSE = _BM25 + """, ve as (select b.item_id as query_id, e.embedding::double[] as e from benchmark b join embeddings e on e.vec_id = b.item_id),
vs as (select query_id, vec_id as chunk_id, round(list_dot_product(e, v.embedding::double[]) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(v.embedding::double[], v.embedding::double[]))), 9) as score from ve, embeddings v),
vr as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from vs),
h as (select query_id, chunk_id, rank, 'vector' as route from vr where rank <= 50 union all select query_id, chunk_id, rank, 'keyword' from r where rank <= 50),
u as (select query_id, chunk_id, round(sum(1.0::double / (60 + rank)), 12) as rrf, count(*) as routes from h join documents on doc_id = chunk_id group by all),
c as (select u.*, chunk_id % 10 as paper_id, replace(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 'ß', 'ss') as k from u join documents on doc_id = chunk_id),
w as (select *, row_number() over (partition by query_id, paper_id, k order by rrf desc, chunk_id) as copy from c),
z as (select *, row_number() over (partition by query_id order by rrf desc, chunk_id) as place from w where copy = 1)
select query_id, chunk_id, paper_id, round(rrf, 9) as rrf, routes, place as rank from z where place <= 20"""


@query(_FUSE)
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    fused = retrieval.fuse(_routes(spark, d), limit=20)
    return fused.select("query_id", "chunk_id", "paper_id", F.round("rrf", 9).alias("rrf"), F.size("traces").cast("long").alias("routes"), "rank")


_SCORES = f"""tq as (select item_id as query_id, list_distinct({_T}) as q from benchmark), td as (select doc_id as chunk_id, list_distinct({_T}) as t from documents),
pairs as (select c.*, round(case when len(q) > 0 then len(list_intersect(q, t))::double / len(q) else 0 end, 9) as score from c join tq using (query_id) join td using (chunk_id))
"""


@query(_FUSE.rsplit("\nselect", 1)[0].replace(", c as (", ", c0 as (").replace("\nc as (", "\nc0 as (").replace("from c)", "from c0)") + f""", c as (select query_id, chunk_id, paper_id, rrf from z where place <= 24), {_SCORES},
l as (select *, row_number() over (partition by query_id, paper_id order by score desc, rrf desc, chunk_id) as lead from pairs where score >= 0.1)
select * from (select query_id, chunk_id, score, round(rrf, 9) as rrf, paper_id, 1 as matched,
  row_number() over (partition by query_id order by case when lead = 1 then paper_id end nulls last, score desc, l.rrf desc, chunk_id) as rank from l) where rank <= 12""")
def rerank_comparison(spark: SparkSession, d: str) -> DataFrame:
    docs = _index(spark, d).docs.select("chunk_id", F.col("tokens").alias("text"))
    asked = _questions(spark, d).select("query_id", F.col("text").alias("query"))
    candidates = retrieval.of_chunks(retrieval.fuse(_routes(spark, d), limit=24), docs).join(asked, "query_id")
    return retrieval.rerank(candidates, by_paper=True).drop("degraded").withColumn("matched", F.size("matched")).withColumn("rrf", F.round("rrf", 9))


_SUB = "list_slice(list_concat([resolved], list_filter(list_reverse(list_reverse({parts})), lambda p: p != resolved)), 1, 4)"
_PARTS = "list_filter([trim(p, ' ，,。；;？?') for p in regexp_split_to_array({q}, '(?i)[；;？?]|并且|以及|同时|and also|and then')], lambda p: p != '')"


@query(_BM25.split("q as (")[0] + f"""z0 as (select item_id as query_id, replace(text, '. ', '? ') as resolved from benchmark),
z1 as (select *, {_PARTS.format(q='resolved')} as parts from z0),
z2 as (select query_id, resolved as text, -1 as p from z0 union all select query_id, unnest(parts), unnest(range(len(parts))) from z1),
z3 as (select query_id, text, min(p) as p from z2 group by all),
a as (select query_id, text, row_number() over (partition by query_id order by p) - 1 as qord from z3 qualify qord < 4),
qw as (select distinct query_id, qord, unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}_]+')) as word from a),
q as (select query_id, qord, translate(word, '{tx.MARKED}', '{tx.PLAIN}') as term from qw),
s as (select query_id, qord, chunk_id, round(sum(case when ln((n_docs - df + 0.5) / (df + 0.5)) > 0 then ln((n_docs - df + 0.5) / (df + 0.5)) else 1e-6 end
    * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 9) as score
  from q join g using (term) join f using (term) cross join n join documents on doc_id = chunk_id where chunk_id % 10 in (1, 4, 7, query_id % 10) and lang is distinct from 'fr' group by all),
r as (select *, row_number() over (partition by query_id, qord order by score desc, chunk_id) as rank from s),
ve as (select query_id, qord, embedding::double[] as e from a join embeddings on vec_id = query_id * 4 + qord),
vs as (select query_id, qord, vec_id as chunk_id, round(list_dot_product(e, v.embedding::double[]) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(v.embedding::double[], v.embedding::double[]))), 9) as score
  from ve, embeddings v where vec_id % 10 in (1, 4, 7, query_id % 10) and vec_id % 4 > 0),
vr as (select *, row_number() over (partition by query_id, qord order by score desc, chunk_id) as rank from vs),
h as (select query_id, qord, chunk_id, rank, 1 as place, 'vector' as route from vr where rank <= 50 union all select query_id, qord, chunk_id, rank, 2, 'keyword' from r where rank <= 50),
u as (select query_id, chunk_id, round(sum(1.0::double / (60 + rank)), 12) as rrf, count(*) as hits, first(qord || ':' || route || ':' || rank order by qord, place, rank) as first_trace from h join documents on doc_id = chunk_id group by all),
c as (select u.*, chunk_id % 10 as paper_id, replace(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 'ß', 'ss') as k from u join documents on doc_id = chunk_id),
w as (select *, row_number() over (partition by query_id, paper_id, k order by rrf desc, chunk_id) as copy from c),
zz as (select *, row_number() over (partition by query_id order by rrf desc, chunk_id) as place from w where copy = 1)
select query_id, chunk_id, paper_id, round(rrf, 9) as rrf, hits, first_trace, place as rank from zz where place <= 20""".replace("z3 as", "z3 as"))
def hybrid_subquestions(spark: SparkSession, d: str) -> DataFrame:
    """Sentences as sub-questions, all recalled by both routes within the question's papers; their vectors are those of successive numbers."""
    i = F.col("query_id")
    asked = _questions(spark, d).select("query_id", F.replace("text", F.lit(". "), F.lit("? ")).alias("question"), F.array_distinct(F.array(F.lit(1).cast("long"), F.lit(4).cast("long"), F.lit(7).cast("long"), i % 10)).alias("paper_ids"))
    plans = asked.withColumn("subqueries", planner.subquestions(F.col("question"))).withColumn("clarification", F.lit(None).cast("string")).withColumn("include_references", F.lit(False))
    vectors = _papers_of(_vectors(spark, d)).select("chunk_id", "embedding", "paper_id", "version_id", "content_type")

    def by_vector(queries: DataFrame) -> DataFrame:
        own = queries.withColumn("vec_id", F.col("own.query_id") * 4 + F.col("own.qord"))
        return retrieval.vector_search(own.join(table(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id"), vectors, 50)

    hits = retrieval.recall(retrieval.recall_queries(plans), {"vector": by_vector, "keyword": lambda q: _index(spark, d).search(q, 50)})
    known = _index(spark, d).docs.select("chunk_id", "content_key", "paper_id")
    fused = retrieval.fuse(retrieval.of_chunks(hits, known), limit=20)
    first = F.concat_ws(":", F.get("traces", F.lit(0))["qord"], F.get("traces", F.lit(0))["route"], F.get("traces", F.lit(0))["rank"])
    return fused.select("query_id", "chunk_id", "paper_id", F.round("rrf", 9).alias("rrf"), F.size("traces").cast("long").alias("hits"), first.alias("first_trace"), "rank")


@query("""with recursive v as (select vec_id as id, embedding::double[] as e, sqrt(list_dot_product(embedding::double[], embedding::double[])) as norm from embeddings),
q as (select b.item_id as query_id, v.e, v.norm from benchmark b join v on v.id = b.item_id),
s as (select query_id, id, round(list_dot_product(q.e, v.e) / (q.norm * v.norm), 9) as score from q, v),
t as (select * from (select *, row_number() over (partition by query_id order by score desc, id) as rank from s) where rank <= 12),
p as (select a.query_id, a.id as x, b.id as y, list_dot_product(va.e, vb.e) / (va.norm * vb.norm) as alike from t a join t b using (query_id) join v va on va.id = a.id join v vb on vb.id = b.id),
r as (
  select query_id, 1 as step, [arg_max(id, score * 1e9 - id * 1e-4)] as picked from (select query_id, id, score, score - max(score) over (partition by query_id) as behind from t) where behind = 0 group by query_id
  union all
  select query_id, step + 1, list_append(picked, best) from (
    select r.query_id, r.step, r.picked, t.id as best, row_number() over (partition by r.query_id order by round(0.5 * t.score_full - 0.5 * (select max(alike) from p where p.query_id = r.query_id and p.x = t.id and list_contains(r.picked, p.y)), 9) desc, t.id) as n
    from r join (select t.*, list_dot_product(q.e, v.e) / (q.norm * v.norm) as score_full from t join q using (query_id) join v on v.id = t.id) t on t.query_id = r.query_id and not list_contains(r.picked, t.id) where r.step < 4) where n = 1)
select query_id, unnest(picked) as chunk_id, unnest(range(1, 5))::int as rank from r where step = 4""")
def diverse_search(spark: SparkSession, d: str) -> DataFrame:
    hits = retrieval.vector_search(_asked(spark, d), _vectors(spark, d), limit=12)
    asked = _asked(spark, d).select("query_id", F.col("embedding").alias("q"))
    return retrieval.diverse(hits.join(asked, "query_id").join(_vectors(spark, d).select("chunk_id", F.col("embedding").alias("v")), "chunk_id").select("query_id", "chunk_id", "q", "v"))


_TEMPLATES = [
    "Compare A versus B?", "What is novel here and also why it matters", "Summarize this paper", "How does the algorithm work; and then what?", "List the related work",
    "这篇论文的方法是什么？以及结果如何", "Plain fact", "why so?",
]
_PLAN_VALUES = ", ".join(f"({i}, '{t}')" for i, t in enumerate(_TEMPLATES))
_INTENT_SQL = "case " + " ".join("when " + " or ".join(f"contains(low, '{w}')" for w in words) + f" then '{name}'" for name, words in planner.INTENTS) + " else 'factual' end"
_PREFERENCE_SQL = "case intent " + " ".join(f"when '{k}' then '{','.join(v)}'" for k, v in planner.PREFERENCES.items()) + " end"


@query(f"""with t(n, template) as (values {_PLAN_VALUES}), u as (select *, row_number() over (partition by conv_id order by turn) as k from conversations where role = 'user' and text is not null),
x as (select conv_id, turn, trim(case when turn % 3 = 2 then text else template end) as q, ['p1', 'p2'][1:(conv_id % 3)::int] as papers, case when conv_id % 2 = 0 then 'library' else 'selected' end as mode,
  lag(text) over (partition by conv_id order by turn) as previous from u join t on n = (conv_id + turn) % {len(_TEMPLATES)}),
y as (select *, regexp_matches(q, '(?i)(这|那|该)(篇|个)?(论文|文章|文献)|它(的|们)?|this paper') as pronoun, {' or '.join(f"starts_with(lower(q), '{w}')" for w in planner.FOLLOW_UPS)} as follows from x),
z as (select *, case when q = '' then 'empty_question' end as error, case when q != '' and pronoun and len(papers) != 1 then '{planner.AMBIGUOUS}' when q != '' and mode = 'selected' and len(papers) = 0 then '{planner.UNSCOPED}' end as clarification from y),
v as (select *, case when clarification is not null then q when pronoun and len(papers) = 1 then q || ' [paper_id=' || papers[1] || ']' when follows and previous is not null then previous || '；追问：' || q else q end as resolved from z),
w as (select *, replace(lower(resolved), 'ß', 'ss') as low, {_PARTS.format(q='resolved')} as parts, error is null and clarification is null as ready from v),
i as (select *, {_INTENT_SQL} as intent from w)
select conv_id, turn, error, clarification, resolved, intent, case when ready then array_to_string({_SUB.format(parts='parts')}, '|') else '' end as subqueries, case when ready then {_PREFERENCE_SQL} else '' end as preferences,
  ready and intent = 'related_work' as include_references from i""")
def question_plans(spark: SparkSession, d: str) -> DataFrame:
    """The users' turns, two of three replaced by canned questions; each follows the user's turn before."""
    n = F.create_map(*[F.lit(x) for i, t in enumerate(_TEMPLATES) for x in (i, t)])
    users = table(spark, d, "conversations").where("role = 'user' and text is not null")
    canned = F.element_at(n, ((F.col("conv_id") + F.col("turn")) % len(_TEMPLATES)).cast("int"))
    asked = users.select(
        "conv_id", "turn", F.when(F.col("turn") % 3 == 2, F.col("text")).otherwise(canned).alias("question"), F.slice(F.array(F.lit("p1"), F.lit("p2")), F.lit(1), (F.col("conv_id") % 3).cast("int")).alias("paper_ids"),
        F.when(F.col("conv_id") % 2 == 0, "library").otherwise("selected").alias("scope_mode"), F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("previous"),
    )
    return planner.plan(asked).select("conv_id", "turn", "error", "clarification", "resolved", "intent", F.array_join("subqueries", "|").alias("subqueries"), F.array_join("preferences", ",").alias("preferences"), "include_references")


_STRIP = "regexp_replace(text, '^[\\x09-\\x0D\\x1C-\\x20\\x85\\p{Z}]+|[\\x09-\\x0D\\x1C-\\x20\\x85\\p{Z}]+$', '', 'g')"
_BLOCKS = f"""b0 as (select doc_id as version_id, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents),
b1 as (select version_id, pos // 20 + 1 as page_no, pos, {_STRIP} as text, case when pos = 0 then 'heading' when pos % 10 = 5 then 'table' when pos % 10 = 6 then 'caption' else 'text' end as kind from b0),
b as (select *, last_value(case when kind = 'heading' then text end ignore nulls) over (partition by version_id order by pos) as title,
  substr(sha256('block' || chr(31) || version_id || chr(31) || page_no || chr(31) || pos || chr(31) || pos || chr(31) || kind || chr(31) || trim(regexp_replace(text, '[\\x09-\\x0D\\x1C-\\x20\\x85\\p{{Z}}]+', ' ', 'g')) || chr(31) || 'native_pdf'), 1, 32) as block_id from b1 where text != '')
"""


@query(f"""with {_BLOCKS}, i as (select version_id, page_no, pos as position, kind, coalesce(title, '') as section, block_id, text,
  substr(sha256('page' || chr(31) || version_id || chr(31) || page_no), 1, 32) as page_id from b)
select *, lag(block_id) over (partition by version_id order by position) as previous_id, lead(block_id) over (partition by version_id order by position) as next_id from i""")
def normalized_blocks(spark: SparkSession, d: str) -> DataFrame:
    return normalize.blocks(_blocks(spark, d)).select("version_id", "page_no", "position", "kind", F.array_join("section_path", " > ").alias("section"), "block_id", "text", "page_id", "previous_id", "next_id")


@query(f"""with {_BLOCKS}, bp as (select *, row_number() over (partition by version_id order by pos) as place from b), p as (select s.version_id, s.pos as a, o.pos as o, row_number() over (partition by s.version_id, s.pos order by (o.kind = 'caption') desc, abs(s.place - o.place), o.place) as n
  from bp s join bp o on s.version_id = o.version_id and s.page_no = o.page_no where s.kind in ('table', 'picture', 'formula') and o.kind in ('caption', 'text')),
e as (select version_id, a as position, o as other from p where n = 1 union select version_id, o, a from p where n = 1)
select version_id, position, string_agg(other::varchar, ',' order by other) as related from e group by all""")
def related_blocks(spark: SparkSession, d: str) -> DataFrame:
    found = normalize.related(normalize.blocks(_blocks(spark, d)))
    return found.select("version_id", "position", F.array_join(F.transform("related", lambda x: x.cast("string")), ",").alias("related"))


@query("""with p as (select doc_id as version_id, unnest(range(1, 11)) as page_no, n_chars from documents)
, x as (select version_id, page_no, (page_no * 37 + version_id) % 10 < version_id % 11 as covered, (version_id % 7) / 40.0 as garbled,
  case when page_no = 3 and version_id % 5 = 0 then 'failed' when page_no < 3 then 'success' else 'skipped' end as ocr, case when page_no < 3 then (version_id % 10) / 10.0 end as confidence from p),
a as (select version_id, count(*) as pages, count_if(covered) as with_text, round(avg(garbled), 9) as garbled, round(avg(confidence) filter (ocr = 'success'), 9) as confidence, count_if(ocr = 'failed') as failed_ocr,
  string_agg(page_no::varchar, ', ' order by page_no) filter (not covered) as missing, string_agg(page_no::varchar, ', ' order by page_no) filter (ocr = 'failed') as failed from x group by version_id),
c as (select *, round(with_text / pages, 9) as coverage from a)
select version_id, pages, with_text, coverage, failed_ocr, case when coverage < 0.5 then 'failed' when coverage < 0.9 or garbled > 0.1 or coalesce(confidence, 1) < 0.6 or failed_ocr > 0 then 'partially_ready' else 'ready' end as level,
  array_to_string(list_filter(['Missing text on PDF pages: ' || missing, 'OCR failed on PDF pages: ' || failed, case when garbled > 0.1 then 'Garbled character ratio is high: ' || printf('%.3f', garbled::double) end,
    case when confidence < 0.6 then 'OCR confidence is low: ' || printf('%.3f', confidence::double) end, case when version_id % 4 = 0 then 'No section structure was detected' end], lambda x: x is not null), ';') as warnings,
  substr(sha256('quality' || chr(31) || version_id), 1, 32) as quality_report_id from c""")
def quality_reports(spark: SparkSession, d: str) -> DataFrame:
    """Ten pages for each document; every fourth has blocks but no headings."""
    docs = table(spark, d, "documents")
    rows = docs.select(F.col("doc_id").alias("version_id"), F.explode(F.sequence(F.lit(1), F.lit(10))).alias("page_no"))
    v, p = F.col("version_id"), F.col("page_no")
    pages = rows.select(
        "version_id", "page_no", ((p * 37 + v) % 10 < v % 11).alias("covered"), ((v % 7) / 40.0).alias("garbled"),
        F.when((p == 3) & (v % 5 == 0), "failed").when(p < 3, "success").otherwise("skipped").alias("ocr_status"), F.when(p < 3, (v % 10) / 10.0).alias("confidence"),
    )
    counts = docs.select(F.col("doc_id").alias("version_id"), F.lit(5).alias("blocks"), F.when(F.col("doc_id") % 4 == 0, 0).otherwise(1).alias("headings"))
    return normalize.quality(pages, counts).select("version_id", "pages", "with_text", "coverage", "failed_ocr", "level", F.array_join("warnings", ";").alias("warnings"), "quality_report_id")


@query("""with s as (select doc_id as id, text, length(text) as n from documents), w as (select id, text, n, unnest(range(0, n, 90)) as i from s where n > 0),
k as (select id, substr(text, i + 1, 100) as piece, i from w where i = 0 or n - i > 10)
select id, (row_number() over (partition by id order by i) - 1)::int as part, piece from k""")
def forced_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.forced_split(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), 100, 0.1)


@query("""with w as (select doc_id as id, text, unnest(range(0, length(text), 320)) as i from documents where length(text) > 0)
select id, (i // 320)::int as part, substr(text, i + 1, 400) as piece from w""")
def window_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.fixed_windows(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))


_CHILDREN = f"""with recursive {_BLOCKS},
n as (select version_id, row_number() over (partition by version_id order by pos) as i, page_no, pos, kind, kind in ('table', 'formula', 'caption', 'picture', 'reference') as special, coalesce(title, '') as title, text, length(text) as n, block_id,
  case when pos % 3 > 0 then (pos % 7) / 10.0 end as quality from b),
g as (select version_id, i, 1 as grp, n as size, special, title from n where i = 1
  union all select n.version_id, n.i, g.grp + (n.special or g.special or n.title != g.title or g.size + 2 + n.n > 600)::int, case when n.special or g.special or n.title != g.title or g.size + 2 + n.n > 600 then n.n else g.size + 2 + n.n end, n.special, n.title
  from g join n on n.version_id = g.version_id and n.i = g.i + 1),
c0 as (select version_id, grp, string_agg(text, chr(10) || chr(10) order by i) as text, min(page_no) as page_start, max(page_no) as page_end, any_value(n.title) as section, case when bool_or(n.special) then any_value(kind) else 'text' end as kind,
  avg(quality) as quality, string_agg(block_id, ',' order by i) as block_ids from g join n using (version_id, i) group by all),
c1 as (select * exclude (text), text as piece, 0 as part from c0 where length(text) <= 600
  union all select * exclude (text, k), substr(text, k + 1, 600), k from (select *, unnest(range(0, length(text), 540)) as k from c0 where length(text) > 600) where k = 0 or length(text) - k > 60),
c2 as (select *, row_number() over (partition by version_id order by grp, part) - 1 as seq from c1),
c as (select *, substr(sha256('child' || chr(31) || version_id || chr(31) || 'parent-child-v1' || chr(31) || seq || chr(31) || piece), 1, 32) as chunk_id, kind in ('table', 'formula', 'caption', 'picture', 'reference') as special, length(piece) as n from c2),
h as (select version_id, seq, 0 as grp, n as size, special, section from c where seq = 0
  union all select c.version_id, c.seq, h.grp + (c.special or h.special or c.section != h.section or h.size + 2 + c.n > 1800)::int, case when c.special or h.special or c.section != h.section or h.size + 2 + c.n > 1800 then c.n else h.size + 2 + c.n end, c.special, c.section
  from h join c on c.version_id = h.version_id and c.seq = h.seq + 1),
p0 as (select version_id, h.grp as parent, string_agg(piece, chr(10) || chr(10) order by seq) as text, min(page_start) as page_start, max(page_end) as page_end, any_value(c.section) as section, case when count(distinct kind) = 1 then any_value(kind) else 'mixed' end as kind,
  avg(quality) as quality, list(block_ids order by seq) as lists from h join c using (version_id, seq) group by all),
p as (select *, substr(sha256('parent' || chr(31) || version_id || chr(31) || 'parent-child-v1' || chr(31) || parent || chr(31) || text), 1, 32) as chunk_id from p0)
"""


def _chunked(spark, d) -> DataFrame:
    pos = F.col("position")
    found = normalize.blocks(_blocks(spark, d)).withColumn("quality", F.when(pos % 3 > 0, (pos % 7) / 10.0))
    return chunking.build(found).withColumn("section", F.array_join("section_path", " > ")).withColumn("quality", F.round("quality_score", 6))


@query(_CHILDREN + """select c.version_id::varchar as version_id, seq::int as seq, c.chunk_id, p.chunk_id as parent_chunk_id, lag(c.chunk_id) over w as previous_id, lead(c.chunk_id) over w as next_id, piece as text, n::int as token_count,
  c.page_start::int as page_start, c.page_end::int as page_end, c.section, c.kind as content_type, round(c.quality, 6) as quality, block_ids
from c join h using (version_id, seq) join p on p.version_id = c.version_id and p.parent = h.grp window w as (partition by c.version_id order by seq)""")
def greedy_chunks(spark: SparkSession, d: str) -> DataFrame:
    own = chunking.children(_chunked(spark, d)).withColumn("block_ids", F.array_join("block_ids", ","))
    return own.select("version_id", "seq", "chunk_id", "parent_chunk_id", "previous_id", "next_id", "text", "token_count", "page_start", "page_end", "section", "content_type", "quality", "block_ids")


@query(_CHILDREN + """select version_id::varchar as version_id, parent::int as seq, chunk_id, text, length(text)::int as token_count, page_start::int as page_start, page_end::int as page_end, section, kind as content_type, round(quality, 6) as quality,
  len(list_distinct(flatten([string_split(x, ',') for x in lists])))::int as blocks from p""")
def parent_chunks(spark: SparkSession, d: str) -> DataFrame:
    own = chunking.parents(_chunked(spark, d)).withColumn("blocks", F.size("block_ids"))
    return own.select("version_id", "seq", "chunk_id", "text", "token_count", "page_start", "page_end", "section", "content_type", "quality", "blocks")


@query("""with l as (select vec_id, label as doc_id, row_number() over (partition by label order by vec_id) as pos, embedding::double[] as e from embeddings),
f as (select doc_id, pos, e, lag(e) over (partition by doc_id order by pos) as b from l),
g as (select doc_id, pos, round(1 - list_dot_product(e, b) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(b, b))), 9) as distance from f),
h as (select *, quantile_cont(distance, 0.92) over (partition by doc_id) as cut from g)
select doc_id, pos, (sum(case when distance > cut then 1 else 0 end) over (partition by doc_id order by pos))::bigint as "group" from h""")
def semantic_chunks(spark: SparkSession, d: str) -> DataFrame:
    line = Window.partitionBy("label").orderBy("vec_id")
    rows = table(spark, d, "embeddings").select(F.col("label").alias("doc_id"), F.row_number().over(line).alias("pos"), "embedding")
    return chunking.semantic(rows)


@query("""select doc_id, 'ev_' || substr(sha256('v1' || chr(31) || doc_id || chr(31) || (1 + doc_id % 3) || chr(31) || (1 + doc_id % 3 + doc_id % 2)), 1, 20) as evidence_id,
  'Title ' || doc_id || ' (v1), ' || case when doc_id % 2 = 0 then 'p. ' || (1 + doc_id % 3) else 'pp. ' || (1 + doc_id % 3) || '-' || (2 + doc_id % 3) end || ', ' || case when doc_id % 4 = 0 then 'Unsectioned' else 'Method > Data' end as label from documents""")
def citations(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    first, last = 1 + i % 3, 1 + i % 3 + i % 2
    section = F.when(i % 4 != 0, F.array(F.lit("Method"), F.lit("Data")))
    label = grounding.citation_label(F.concat(F.lit("Title "), i), F.lit("v1"), first, last, section)
    return table(spark, d, "documents").select("doc_id", grounding.evidence_id(F.lit("v1"), i, first, last).alias("evidence_id"), label.alias("label"))


@query("""with recursive v as (select vec_id as id, embedding::double[] as e, sqrt(list_dot_product(embedding::double[], embedding::double[])) as norm from embeddings),
s as (select b.item_id as question_id, v.id, round(list_dot_product(q.e, v.e) / (q.norm * v.norm), 9) as score from benchmark b join v q on q.id = b.item_id, v),
t as (select * from (select *, row_number() over (partition by question_id order by score desc, id) as ord from s) where ord <= 12),
x as (select question_id, ord, id, coalesce(length(text), 0) as tokens, text is not null and id % 7 > 0 as fine, (id % 10) || '|' || coalesce(replace(lower(trim(regexp_replace(text, '[\\x09-\\x0D\\x1C-\\x20\\x85\\p{Z}]+', ' ', 'g'))), 'ß', 'ss'), '') as k from t left join documents on doc_id = id),
r as (select distinct question_id, 0::bigint as ord, 0::bigint as used, []::bigint[] as kept, []::bigint[] as omitted, []::varchar[] as keys from x
  union all select r.question_id, x.ord,
    case when x.fine and not list_contains(keys, k) and used + tokens <= 8192 then used + tokens else used end,
    case when x.fine and not list_contains(keys, k) and used + tokens <= 8192 then list_append(kept, x.id) else kept end,
    case when not x.fine or (not list_contains(keys, k) and used + tokens > 8192) then list_append(omitted, x.id) else omitted end,
    case when x.fine and not list_contains(keys, k) and used + tokens <= 8192 then list_append(keys, k) else keys end
  from r join x on x.question_id = r.question_id and x.ord = r.ord + 1)
select question_id, used, array_to_string(kept, ',') as kept, array_to_string(omitted, ',') as omitted from r where ord = (select max(x.ord) from x where x.question_id = r.question_id)""")
def context_budgets(spark: SparkSession, d: str) -> DataFrame:
    """The nearest documents of each question's vector, of ten papers; vectors beyond the documents are unknown items."""
    hits = retrieval.vector_search(_asked(spark, d), _vectors(spark, d), limit=12)
    rows = hits.join(_docs(spark, d), "chunk_id", "left").select(
        F.col("query_id").alias("question_id"), F.col("rank").alias("ord"), F.col("chunk_id").alias("item_id"), F.coalesce(F.length("text"), F.lit(0)).alias("tokens"),
        F.when(F.col("chunk_id") % 7 == 0, 0.1).otherwise(0.9).alias("quality"), F.col("text").alias("content"), (F.col("chunk_id") % 10).alias("paper_id"), F.col("text").isNotNull().alias("known"),
    )
    return grounding.budgeted(rows, grounding.evidence_budget(16384, 0.5)).drop("items")


_LEVELS = "case event_type when 'click' then 'direct' when 'view' then 'inference' when 'error' then 'conflict' else 'insufficient' end"


@query(f"""with e as (select event_id // 3 as question_id, event_id % 3 as part, case when value is null or value >= 10 then {_LEVELS} end as level from events),
p as (select question_id, part, case when bool_or(level = 'conflict') then 'conflict' when bool_or(level = 'direct') then 'direct' when bool_or(level = 'inference') then 'inference' else 'insufficient' end as level from e group by all)
select question_id, coalesce(array_to_string(list(part order by part) filter (level = 'insufficient'), ','), '') as unanswered_items, case when count_if(level = 'insufficient') = count(*) then 'insufficient_evidence' when count_if(level = 'insufficient') > 0 then 'partially_answered' when count_if(level = 'conflict') > 0 then 'conflicted' else 'answered' end as status,
  count(*) as parts, count_if(level = 'insufficient') as unanswered from p group by question_id""")
def answer_sufficiency(spark: SparkSession, d: str) -> DataFrame:
    """Events as judgements; their value over 20 is the evidence's quality."""
    judged = table(spark, d, "events").select(F.floor(F.col("event_id") / 3).alias("question_id"), (F.col("event_id") % 3).alias("part"), F.expr(_LEVELS).alias("level"), (F.col("value") / 20).alias("quality"))
    return grounding.sufficiency(judged).withColumn("unanswered_items", F.array_join("unanswered_items", ","))


def _evidence(spark, d) -> DataFrame:
    """Parts of more than size 5 as the evidence that claims may cite."""
    return table(spark, d, "part").where("p_size > 5").select(F.col("p_partkey").alias("evidence_id"))


@query(f"""with c as (select user_id as answer_id, event_id as claim, {_LEVELS} as level, [1 + event_id % 211, 1 + event_id % 197] as ids from events),
x as (select answer_id, claim, level, bool_and(i in (select p_partkey from part where p_size > 5)) as known from (select *, unnest(ids) as i from c) group by all),
k as (select *, known and level != 'insufficient' as kept from x)
select answer_id, case when count_if(not kept) = count(*) then 'insufficient_evidence' when count_if(kept and level = 'conflict') > 0 then 'conflicted' when count_if(not kept) > 0 then 'partially_answered' else 'answered' end as status,
  count(*) as claims, count_if(not kept) as removed, count_if(kept and level = 'inference') as inferred from k group by answer_id""")
def claim_checks(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    claims = table(spark, d, "events").select(F.col("user_id").alias("answer_id"), i.alias("claim"), F.array(1 + i % 211, 1 + i % 197).alias("evidence_ids"), F.expr(_LEVELS).alias("level"))
    return grounding.verify_claims(claims, _evidence(spark, d))


@query(f"""with r(name) as (select unnest({grounding.METHOD_FIELDS})), g as (select c_custkey as id, {grounding.METHOD_FIELDS}[1 + c_custkey % 9] as name, c_name as value from customer)
select k.id, r.name, coalesce(g.value, '') as value, case when g.value is null then 'not_stated' else 'explicit' end as status from (select distinct id from g) k cross join r left join g on g.id = k.id and g.name = r.name""")
def method_fields(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in grounding.METHOD_FIELDS])
    given = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.element_at(names, (1 + F.col("c_custkey") % 9).cast("int")).alias("name"), F.col("c_name").alias("value"))
    required = spark.createDataFrame([(x,) for x in grounding.METHOD_FIELDS], "name string")
    out = grounding.filled(given, required, "id")
    return out.select("id", "name", F.coalesce("value", F.lit("")).alias("value"), F.when(F.col("value").isNull(), "not_stated").otherwise("explicit").alias("status"))


_STATES = "case event_type when 'click' then 'running' when 'view' then 'queued' when 'error' then 'failed' else 'succeeded' end"


@query(f"""with e as (select user_id as task_id, event_id, ts, {_STATES} as status, case when event_type = 'view' then 1 + event_id % 9 end as attempt from events), n as (select max(ts) as now from e),
l as (select *, row_number() over (partition by task_id order by ts desc, event_id desc) as k from e), a as (select task_id, coalesce(max(attempt), 0) as attempts from e group by task_id)
select task_id, case when status = 'running' and ts < now - interval 24 hours then 'failed' else status end as state, attempts, attempts + 1 as next_attempt from l join a using (task_id) cross join n where k = 1""")
def task_states(spark: SparkSession, d: str) -> DataFrame:
    attempt = F.when(F.col("event_type") == "view", 1 + F.col("event_id") % 9)
    events = table(spark, d, "events").select(F.col("user_id").alias("task_id"), "event_id", F.col("ts").alias("at"), F.expr(_STATES).alias("status"), attempt.alias("attempt"))
    return lifecycle.task_states(events)


@query("""with o as (select o_custkey as id, o_totalprice as price, o_orderdate as created_at, 0 as fresh, o_orderkey from orders where o_orderkey % 2 = 0), n as (select o_custkey, o_totalprice, o_orderdate, 1, o_orderkey from orders where o_orderkey % 2 = 1),
b as (select * from (select *, row_number() over (partition by id order by o_orderkey) as k from o) where k = 1 union all select * from (select *, row_number() over (partition by o_custkey order by o_orderkey) as k from n) where k = 1),
r as (select id, price, min(created_at) over (partition by id) as created_at, row_number() over (partition by id order by fresh desc) as w from b)
select id, price, created_at from r where w = 1""")
def upserted(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("created_at"), "o_orderkey")
    one = lambda rows: grounding.first_of_each(rows, ["id"], ["o_orderkey"]).drop("o_orderkey")
    return lifecycle.upsert(one(orders.where("o_orderkey % 2 = 0")), one(orders.where("o_orderkey % 2 = 1")), "id")


@query("select o_orderkey, o_custkey from orders where o_custkey not in (select c_custkey from customer where c_acctbal < 0)")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return lifecycle.without(table(spark, d, "orders").select("o_orderkey", "o_custkey"), gone, "o_custkey")


@query("""select doc_id, regexp_replace(regexp_replace('api_key=' || doc_id || ', authorization: bearer t' || doc_id || ' ' || text, '(api[_-]?key\\s*[=:]\\s*)[^\\s,;]+', '\\1[REDACTED]', 'gi'), '(authorization\\s*[=:]\\s*bearer\\s+)[^\\s,;]+', '\\1[REDACTED]', 'gi') as safe from documents""")
def redaction(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("api_key="), F.col("doc_id"), F.lit(", authorization: bearer t"), F.col("doc_id"), F.lit(" "), F.col("text"))
    return table(spark, d, "documents").select("doc_id", tx.redacted(raw).alias("safe"))


_KIND_SQL = "case " + " ".join(f"when contains(lower(stage), '{t}') then '{k}'" for t, k in lifecycle.FAILURES) + " else 'unknown' end"


@query(f"with s as (select event_id, ['OCR page', 'Parsing', 'embed batch', 'vector upsert', 'keyword upsert', 'rerank', 'file move', 'other'][1 + event_id % 8] as stage from events) select event_id, {_KIND_SQL} as kind from s")
def failure_kinds(spark: SparkSession, d: str) -> DataFrame:
    stages = F.array(*[F.lit(x) for x in ("OCR page", "Parsing", "embed batch", "vector upsert", "keyword upsert", "rerank", "file move", "other")])
    return table(spark, d, "events").select("event_id", lifecycle.failure_kind(F.element_at(stages, (1 + F.col("event_id") % 8).cast("int"))).alias("kind"))


@query("""select page_id, url, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<nav[^>]*>.*?</nav>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g')) as text, 'webpage' as file_type from pages""")
def web_page_texts(spark: SparkSession, d: str) -> DataFrame:
    return page_texts(table(spark, d, "pages"))


@query("""with n as (select conv_id, turn, role, text, row_number() over (partition by conv_id order by turn desc) as back, count(*) over (partition by conv_id) as total from conversations)
select conv_id, max(total) as total, count_if(back <= 3) as kept, string_agg(role, ',' order by turn) filter (back <= 3) as roles, max(case when role = 'user' then turn end) as last_question from n group by conv_id""")
def history_windows(spark: SparkSession, d: str) -> DataFrame:
    back = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = table(spark, d, "conversations").withColumn("back", F.row_number().over(back))
    roles = F.transform(F.array_sort(F.collect_list(F.when(F.col("back") <= 3, F.struct("turn", "role")))), lambda x: x["role"])
    return rows.groupBy("conv_id").agg(F.count("*").alias("total"), F.count_if(F.col("back") <= 3).alias("kept"), F.array_join(roles, ",").alias("roles"), F.max(F.when(F.col("role") == "user", F.col("turn"))).alias("last_question"))


@query("""with k as (select doc_id, replace(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 'ß', 'ss') as k from documents)
select min(doc_id) as first_id, count(*) as copies from k group by k having count(*) > 1""")
def duplicate_contents(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).groupBy(tx.content_key(F.col("text")).alias("k")).agg(F.min("chunk_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1").drop("k")


from folioscope.plans import library, papers  # noqa: E402,F401  register the queries of the library
