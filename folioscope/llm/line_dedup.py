"""Line dedup by winnowing over line hashes, in DataFrame operations only.

A window is a line and the lines after it (or before it) up to ``min_words`` words. Of each window
the line of the least hash is selected: a repeated run of at least ``min_words`` words holds a whole
window, so both of its places select the same line, and only selected lines are looked up. Selected
lines whose hash stands at one selected place only are done with. Where several meet, a match is
extended both ways by the windows around the selected line: it goes left and right with each window
that is the same at an earlier place, whichever document that is in, and so to the match's end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import free_names, materialize, meet, slots

#: White space between words, as in the SQL form.
_WORDS = r"[^ \t\r\x0B\f]+"


def line_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, th, pos, h, g, words): the lines that hold a word, with two hashes; th tells texts of one id apart."""
    lines = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    rows = lines.select("doc_id", "th", "pos", F.xxhash64("line").alias("h"), F.hash("line").alias("g"), F.regexp_count("line", F.lit(_WORDS)).alias("words"))
    dealt = rows.where("words > 0").repartition(slots(docs.sparkSession), "doc_id", "th")
    return dealt.groupBy("doc_id", "th", "pos").agg(F.first("h").alias("h"), F.first("g").alias("g"), F.first("words").alias("words"))  # repeated rows count once


def selected_lines(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, th, pos, h, windows): window minima, each with the windows that select it.

    A window (a, b, c, d) has its first and last line and two hashes of all its lines. Windows
    reach from every line forwards and from every line backwards to ``min_words`` words, the
    latter only where they aren't also one of the former. A window has ``min_words`` lines at most.
    """
    by_doc = Window.partitionBy("doc_id", "th")
    placed = line_rows(docs).withColumn("upto", F.sum("words").over(by_doc.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    placed = placed.withColumn("at", F.col("upto") - F.col("words"))

    def window(frame) -> F.Column:
        return F.struct(
            F.min(F.struct("h", "pos")).over(frame).alias("least"), F.min("pos").over(frame).alias("a"), F.max("pos").over(frame).alias("b"),
            F.xxhash64(F.collect_list("h").over(frame)).alias("c"), F.hash(F.collect_list("g").over(frame)).alias("d"), F.sum("words").over(frame).alias("n"),
        )

    ahead = placed.withColumn("ahead", window(by_doc.orderBy("at").rangeBetween(0, min_words - 1)))
    both = ahead.withColumn("back", window(by_doc.orderBy("upto").rangeBetween(1 - min_words, 0)))
    full = F.array_compact(F.array(
        F.when(F.col("ahead.n") >= min_words, F.col("ahead")),
        F.when(F.col("back.n") - F.col("words") >= min_words, F.col("back")),
    ))
    windows = both.select("doc_id", "th", F.explode(full).alias("w"))
    chosen = windows.groupBy("doc_id", "th", F.col("w.least.pos").alias("pos"), F.col("w.least.h").alias("h"))
    return chosen.agg(F.collect_list(F.struct("w.a", "w.b", "w.c", "w.d")).alias("windows"))


def repeated_runs(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """(doc_id, th, runs): the line ranges to delete, as array<struct<a, b>>, first and last line, in order.

    Selected lines meet by their hash, then their windows by hash and content; no pairs are made,
    and a line or window that holds many places is dealt out over tasks.
    """
    chosen = materialize(selected_lines(docs, min_words), "selected-lines")
    met = meet(chosen, ["h"], chosen.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), chosen.count())
    windows = materialize(met.select("doc_id", "th", "h", F.explode("windows").alias("w")).select("doc_id", "th", "h", "w.*"), "met-windows")
    key = ["h", "c", "d"]
    first = windows.groupBy(*key).agg(F.min(F.struct("doc_id", "th", "a")).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = meet(windows, key, first, windows.count()).where("not (doc_id <=> first.doc_id and th = first.th and a = first.a)")
    return _merged(later.select("doc_id", "th", "a", "b"))


def _merged(ranges: DataFrame) -> DataFrame:
    """Overlapping or touching ranges of a document become one."""
    by_doc = Window.partitionBy("doc_id", "th")
    before = by_doc.orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    upto = by_doc.orderBy("a", "b").rowsBetween(Window.unboundedPreceding, 0)
    marked = ranges.withColumn("new", F.coalesce(F.col("a") > F.max("b").over(before) + 1, F.lit(True)).cast("int"))
    runs = marked.withColumn("run", F.sum("new").over(upto)).groupBy("doc_id", "th", "run").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return runs.groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("runs"))


def dedup_lines(docs: DataFrame, min_words: int = 50, names: tuple[str, str] = ("dropped_lines", "dropped_words")) -> DataFrame:
    """``docs`` with the text that is left, and two columns more, ``names``: lines and words dropped.

    A line goes where it belongs to a run of lines, of at least ``min_words`` words together, that
    stood before: in a document of smaller doc_id (null is smallest) or earlier in the same one.
    Lines without words are never deleted and don't interrupt a run; line breaks of deleted lines
    go with them. Null and empty texts stay as they are. Rows equal in id and text count as one
    document and get the same result; of texts with the same id, the order is that of their 64-bit
    hash. Lines and windows are compared by hashes of 96 bits together. A text of any length is
    taken whole: its lines are sorted in one task, which spills. Other columns are passed through,
    whatever their names, but for columns called ``names``, which are replaced.
    """
    docs = docs.drop(*names)
    d, t, h, r, x = free_names(docs, 5)
    runs = repeated_runs(docs.select("doc_id", "text"), min_words).select(F.col("doc_id").alias(d), F.col("th").alias(t), F.col("runs").alias(r))
    joined = docs.withColumn(h, F.xxhash64("text")).join(runs, F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(h) == F.col(t)), "left")
    joined = joined.withColumn(x, F.when(F.col(r).isNotNull(), F.split("text", "\n")))
    words = lambda line: F.regexp_count(line, F.lit(_WORDS))
    own = lambda run: F.slice(x, run["a"] + 1, run["b"] - run["a"] + 1)
    start = lambda i: F.coalesce(F.get(r, i - 1)["b"] + 1, F.lit(0))  # noqa: E731  of the lines before run i
    parts = F.transform(r, lambda run, i: F.concat(F.slice(x, start(i) + 1, run["a"] - start(i)), F.filter(own(run), lambda line: words(line) == 0)))
    rest = F.slice(x, F.element_at(r, -1)["b"] + 2, F.size(x))
    kept = F.array_join(F.concat(F.flatten(parts), rest), "\n")
    lost = F.flatten(F.transform(r, lambda run: F.filter(own(run), lambda line: words(line) > 0)))
    some = F.col(r).isNotNull()
    return joined.select(
        *[(F.when(some, kept).otherwise(F.col("text")).alias("text") if c == "text" else F.col(f"`{c}`")) for c in docs.columns],
        F.when(some, F.size(lost)).otherwise(0).cast("long").alias(names[0]),
        F.when(some, F.aggregate(lost, F.lit(0).cast("long"), lambda s, line: s + words(line))).otherwise(0).cast("long").alias(names[1]),
    )


def oracle(table: str = "documents", min_words: int = 50) -> str:
    """What goes by definition, in DuckDB SQL: all windows of both directions, compared as texts."""
    return f"""
with l as (
  select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos
  from {table} where text is not null),
w as (select doc_id, pos, line, len(regexp_extract_all(line, '[^ \\t\\r\\x0B\\f]+')) as words from l),
p as (select *, (sum(words) over (partition by doc_id order by pos))::bigint as upto from w where words > 0),
s as (
  select doc_id, pos, list(line) over f as ahead, max(pos) over f as b, sum(words) over f as n,
    list(line) over k as back, min(pos) over k as a, sum(words) over k as m
  from (select *, upto - words as w0 from p) window
    f as (partition by doc_id order by w0 range between current row and {min_words - 1} following),
    k as (partition by doc_id order by upto range between {min_words - 1} preceding and current row)),
c as (
  select doc_id, pos as a, b, array_to_string(ahead, chr(10)) as content from s where n >= {min_words}
  union all select doc_id, a, pos, array_to_string(back, chr(10)) from s where m >= {min_words}),
r as (select * from (select *, rank() over (partition by content order by doc_id, a) as place from c) where place > 1),
g as (select distinct w.doc_id, w.pos from w join r on w.doc_id = r.doc_id and w.pos between r.a and r.b where w.words > 0),
t as (
  select w.doc_id, string_agg(w.line, chr(10) order by w.pos) filter (g.pos is null) as text,
    count(g.pos)::bigint as dropped_lines, coalesce(sum(w.words) filter (g.pos is not null), 0)::bigint as dropped_words
  from w left join g on w.doc_id = g.doc_id and w.pos = g.pos group by w.doc_id)
"""


DIGEST_SQL = """select d.doc_id, case when d.text is null then null else coalesce(t.text, '') end as kept_text, coalesce(t.dropped_lines, 0) as dropped_lines,
  coalesce(t.dropped_words, 0) as dropped_words
from {table} d left join t on d.doc_id = t.doc_id"""
