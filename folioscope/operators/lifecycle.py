"""Tables as logs: inserts, guarded updates, upserts, cascades, migrations; task and analysis queues, sessions, failures.

Changes take tables to new versions of them; nothing is changed in place. What the rules forbid
comes back as rows beside the new version, so that a batch of changes tells all its problems.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What in a stage's name tells the kind of a failure, in the order in which it is tried.
FAILURES = [
    ("ocr", "ocr"), ("docling", "parsing"), ("pars", "parsing"), ("embed", "embedding"), ("chroma", "vector_index"), ("vector", "vector_index"),
    ("keyword", "keyword_index"), ("rerank", "reranker"), ("glm", "glm"), ("database", "database"), ("file", "filesystem"),
]


def latest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows win over old ones of their key; created_at stays the first."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    first = F.min("created_at").over(Window.partitionBy(key))
    return latest(both.withColumn("created_at", first), [key], [F.desc("__new")]).drop("__new")


def inserted(table: DataFrame, rows: DataFrame, key: str, now) -> tuple[DataFrame, DataFrame]:
    """``table`` with ``rows`` appended, and the keys that are there already or come twice.

    Blank created_at and updated_at become ``now``. Rows of a bad key aren't inserted.
    """
    stamped = rows
    for name in ("created_at", "updated_at"):
        if name in table.columns:
            stamped = stamped.withColumn(name, F.coalesce(name, now) if name in rows.columns else now)
    twice = rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key)
    bad = twice.unionAll(rows.select(key).join(table.select(key), key, "left_semi")).distinct()
    return table.unionByName(stamped.join(bad, key, "left_anti").select(*table.columns)), bad


def updated(table: DataFrame, changes: DataFrame, key: str, now, guard=None) -> tuple[DataFrame, DataFrame]:
    """``table`` with the columns of ``changes`` put in by key and updated_at ``now``, and the keys of changes that hit no row or come twice.

    ``guard``, a condition on the table's own columns, must hold for a row to change: a change
    that it stops counts as one that hits no row.
    """
    names = [c for c in changes.columns if c != key]
    once = changes.groupBy(key).agg(*[F.first(c).alias(f"_new_{c}") for c in names], F.count("*").alias("_n"))
    test = F.lit(True) if guard is None else F.coalesce(guard, F.lit(False))
    joined = table.withColumn("_open", test).join(once, key, "left").withColumn("_hit", F.col("_open") & (F.coalesce("_n", F.lit(0)) == 1))
    value = lambda c: F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c))
    stamp = lambda c: F.when(F.col("_hit"), now).otherwise(F.col(c))
    out = [value(c).alias(c) if c in names else stamp(c).alias(c) if c == "updated_at" else F.col(c) for c in table.columns]
    missed = changes.select(key).distinct().join(joined.where("_hit").select(key), key, "left_anti")
    return joined.select(*out), missed


def replaced_children(table: DataFrame, rows: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    """The children of ``owners`` (key) replaced by ``rows``; an owner may be left without any."""
    return table.join(owners.select(key).distinct(), key, "left_anti").unionByName(rows.join(owners.select(key).distinct(), key, "left_semi"))


def paired(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Messages of questions and answers (pair_id, ...) in one table, whole pairs only, so that one write takes both."""
    one = lambda rows: rows.groupBy("pair_id").agg(F.count("*").alias("n")).where("n = 1").select("pair_id")
    whole = one(questions).join(one(answers), "pair_id", "left_semi")
    both = questions.withColumn("role", F.lit("user")).unionByName(answers.withColumn("role", F.lit("assistant")), allowMissingColumns=True)
    return both.join(whole, "pair_id", "left_semi")


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The rows that a deletion of ``gone`` leaves."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def forgotten(rows: DataFrame, gone: DataFrame, column: str, key: str) -> DataFrame:
    """``rows`` with ``column`` null where it refers to a deleted row (ON DELETE SET NULL)."""
    marked = gone.select(F.col(key).alias(column)).distinct().withColumn("_gone", F.lit(True))
    return rows.join(marked, column, "left").withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))).select(*rows.columns)


#: What refers to what: (table, column, the table and key referred to, what a deletion does).
REFERENCES = [
    ("paper_versions", "paper_id", "papers", "paper_id", "cascade"), ("pages", "version_id", "paper_versions", "version_id", "cascade"),
    ("content_blocks", "version_id", "paper_versions", "version_id", "cascade"), ("content_blocks", "previous_block_id", "content_blocks", "block_id", "set null"),
    ("content_blocks", "next_block_id", "content_blocks", "block_id", "set null"), ("chunks", "version_id", "paper_versions", "version_id", "cascade"),
    ("chunks", "parent_chunk_id", "chunks", "chunk_id", "set null"), ("chunk_blocks", "chunk_id", "chunks", "chunk_id", "cascade"),
    ("chunk_blocks", "block_id", "content_blocks", "block_id", "cascade"), ("quality_reports", "version_id", "paper_versions", "version_id", "cascade"),
    ("processing_tasks", "version_id", "paper_versions", "version_id", "cascade"), ("conversation_papers", "paper_id", "papers", "paper_id", "cascade"),
    ("conversation_papers", "conversation_id", "conversations", "conversation_id", "cascade"), ("messages", "conversation_id", "conversations", "conversation_id", "cascade"),
    ("scope_events", "conversation_id", "conversations", "conversation_id", "cascade"),
]


def cascaded(tables: dict[str, DataFrame], root: str, gone: DataFrame, key: str, references: list[tuple] = REFERENCES) -> dict[str, DataFrame]:
    """``tables`` after the rows ``gone`` (key) of ``root`` are deleted, with all that refers to them.

    References are followed level by level; those that are set null are so for every row deleted
    of the table they refer to. Tables that aren't given are passed over.
    """
    out, removed = dict(tables), {root: tables[root].join(gone.select(key).distinct(), key, "left_semi")}
    out[root] = without(tables[root], gone, key)
    for name in dict.fromkeys(r[0] for r in references):
        if name not in tables:
            continue
        own = [r for r in references if r[0] == name and r[4] == "cascade" and r[2] in removed and r[2] != name]
        for _, column, target, target_key, _ in own:
            lost = removed[target].select(F.col(target_key).alias(column)).distinct()
            hit = out[name].join(lost, column, "left_semi")
            removed[name] = removed[name].unionByName(hit) if name in removed else hit
            out[name] = out[name].join(lost, column, "left_anti")
    for name, column, target, target_key, how in references:
        if how == "set null" and name in out and target in removed:
            out[name] = forgotten(out[name], removed[target], column, target_key)
    return out


def migrated(table: DataFrame, applied: DataFrame, steps: list[tuple]) -> tuple[DataFrame, list[int]]:
    """``table`` after the steps (number, function) that ``applied`` (version) hasn't, in the order of their numbers, and those numbers.

    A step that raises leaves the table as the step before made it: nothing is written until all went well.
    """
    known = {r.version for r in applied.select("version").distinct().collect()}  # a row per migration
    done = []
    for number, step in sorted(steps, key=lambda s: s[0]):
        if number not in known:
            table = step(table)
            done.append(number)
    return table, done


def pending(steps: DataFrame, applied: DataFrame) -> DataFrame:
    """The migrations (version) still to be applied."""
    return steps.join(applied.select("version").distinct(), "version", "left_anti")


#: Kinds of failures by the name of an error's type, tried when the stage tells nothing.
ERROR_TYPES = {
    "database": ["sqlite3.error", "databaseerror", "operationalerror", "integrityerror"],
    "filesystem": ["oserror", "filenotfounderror", "permissionerror", "fileexistserror", "isadirectoryerror", "timeouterror", "connectionerror"],
    "glm": ["modelinvocationerror"], "vector_index": ["retrievalerror"], "parsing": ["documentprocessingerror"],
}


def failure_kind(stage, error_type=None) -> F.Column:
    low = F.lower(stage)
    tests = [F.when(F.contains(low, F.lit(token)), F.lit(kind)) for token, kind in FAILURES]
    if error_type is not None:
        tests += [F.when(F.lower(error_type).isin(names), F.lit(kind)) for kind, names in ERROR_TYPES.items()]
    return F.coalesce(*tests, F.lit("unknown"))


def task_states(events: DataFrame, stale_hours: int = 24) -> DataFrame:
    """Events (task_id, attempt, status, at, event_id) to each task's state; one running too long before the last event has failed.

    ``next_attempt`` is one more than the highest attempt.
    """
    state = latest(events, ["task_id"], [F.desc("at"), F.desc("event_id")])
    end = events.agg(F.max("at").alias("now"))
    old = F.col("at") < F.col("now") - F.expr(f"INTERVAL {int(stale_hours)} HOURS")
    attempts = events.groupBy("task_id").agg(F.coalesce(F.max("attempt"), F.lit(0)).alias("attempts"))
    joined = state.drop("attempt").join(F.broadcast(end), F.lit(True)).join(attempts, "task_id")  # one row of the last event's time
    return joined.select("task_id", F.when((F.col("status") == "running") & old, "failed").otherwise(F.col("status")).alias("state"), "attempts", (F.col("attempts") + 1).alias("next_attempt"))


#: From which states an action leads to which.
STEPS = {"start": (["queued"], "running"), "succeed": (["queued", "running"], "succeeded"), "fail": (["queued", "running"], "failed")}
ACTIVE = ["queued", "running"]


def created_tasks(tasks: DataFrame, wanted: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """``tasks`` (task_id, version_id, status, attempt, created_at, updated_at) with a queued task for each of ``wanted`` (task_id, version_id).

    The attempt is the version's highest plus one. Versions that have a task queued or running, or
    are wanted twice, get none: they come back as conflicts.
    """
    held = tasks.groupBy("version_id").agg(F.max("attempt").alias("last"), F.max(F.col("status").isin(ACTIVE)).alias("busy"))
    alone = F.when(F.col("version_id").isNull(), F.col("task_id"))  # tasks of no version conflict with none
    asked = wanted.groupBy("version_id", alone.alias("alone")).agg(F.count("*").alias("n"), F.min("task_id").alias("task_id")).join(held, "version_id", "left")
    refused = F.col("version_id").isNotNull() & (F.coalesce("busy", F.lit(False)) | (F.col("n") > 1))
    conflicts = asked.where(refused).select("version_id")
    fresh = asked.where(~refused)
    rows = fresh.select("task_id", "version_id", F.lit("queued").alias("status"), (F.coalesce("last", F.lit(0)) + 1).cast(dict(tasks.dtypes)["attempt"]).alias("attempt"), now.alias("created_at"), now.alias("updated_at"))
    return tasks.unionByName(rows, allowMissingColumns=True), conflicts


def stepped_tasks(tasks: DataFrame, actions: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """``tasks`` after actions (task_id, action: start, succeed or fail), and the actions that their task's state forbids."""
    test = [(F.col("action") == a) & F.col("status").isin(before) for a, (before, _) in STEPS.items()]
    to = F.coalesce(*[F.when(t, F.lit(after)) for t, (_, after) in zip(test, STEPS.values())])
    asked = tasks.join(actions, "task_id").withColumn("status", to)
    changed, _ = updated(tasks, asked.where("status is not null").select("task_id", "status"), "task_id", now)
    refused = actions.join(asked.where("status is not null").select("task_id", "action"), ["task_id", "action"], "left_anti")
    return changed, refused


def recovered_tasks(tasks: DataFrame, now, stale_hours: int = 24) -> DataFrame:
    """Tasks left running for too long have failed."""
    old = (F.col("status") == "running") & (F.col("updated_at") < now - F.expr(f"INTERVAL {int(stale_hours)} HOURS"))
    return tasks.withColumn("status", F.when(old, "failed").otherwise(F.col("status"))).withColumn("updated_at", F.when(old, now).otherwise(F.col("updated_at")))


def retried_tasks(tasks: DataFrame, versions: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """A new task (task_id) for each of ``versions`` (version_id, task_id) whose last one failed; the others come back refused."""
    last = latest(tasks, ["version_id"], [F.desc("attempt")]).where("status = 'failed'").select("version_id")
    made, _ = created_tasks(tasks, versions.join(last, "version_id", "left_semi"), now)
    return made, versions.join(last, "version_id", "left_anti").select("version_id")


# analyses


def submitted_analyses(tasks: DataFrame, wanted: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """Analysis tasks (task_id, operation, paper_ids, version_ids, level, status, cancel_requested, created_at, updated_at) with ``wanted`` queued.

    A request that equals an active task in operation, papers, versions and level isn't queued: the
    second result has its task_id and that task as ``duplicate_of``. Of equal requests, the first by task_id.
    """
    same = ["operation", "paper_ids", "version_ids", "level"]
    active = tasks.where(F.col("status").isin(ACTIVE)).select(*same, F.col("task_id").alias("held"), "created_at")
    newest = latest(active, same, [F.desc("created_at"), "held"]).select(*same, "held")
    first = F.min("task_id").over(Window.partitionBy(*same))
    asked = wanted.join(newest, same, "left").withColumn("first", first)
    fresh = asked.where(F.col("held").isNull() & (F.col("task_id") == F.col("first")))
    rows = fresh.select("task_id", *same, F.lit("queued").alias("status"), F.lit(False).alias("cancel_requested"), now.alias("created_at"), now.alias("updated_at"))
    other = asked.withColumn("duplicate_of", F.coalesce("held", "first")).where(F.col("duplicate_of") != F.col("task_id")).select("task_id", "duplicate_of")
    return tasks.unionByName(rows, allowMissingColumns=True), other


def cancelled_analyses(tasks: DataFrame, wanted: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """Active tasks of ``wanted`` (task_id) get cancel_requested; queued ones are cancelled at once. The rest comes back refused."""
    hit = wanted.select("task_id").distinct().withColumn("_asked", F.lit(True))
    joined = tasks.join(hit, "task_id", "left").withColumn("_hit", F.col("_asked").isNotNull() & F.col("status").isin(ACTIVE))
    status = F.when(F.col("_hit") & (F.col("status") == "queued"), "cancelled").otherwise(F.col("status"))
    changed = joined.withColumn("status", status).withColumn("cancel_requested", F.col("_hit") | F.col("cancel_requested"))
    changed = changed.withColumn("updated_at", F.when(F.col("_hit"), now).otherwise(F.col("updated_at")))
    return changed.select(*tasks.columns), wanted.select("task_id").distinct().join(joined.where("_hit").select("task_id"), "task_id", "left_anti")


def finished_analyses(tasks: DataFrame, results: DataFrame, now) -> DataFrame:
    """Running tasks after their results (task_id, result_json or error): succeeded, failed, or cancelled where that was asked meanwhile."""
    joined = tasks.join(results.select("task_id", F.col("result_json").alias("_result"), F.col("error").alias("_error"), F.lit(True).alias("_done")), "task_id", "left")
    hit = F.col("_done").isNotNull() & (F.col("status") == "running")
    after = F.when(F.col("cancel_requested"), "cancelled").when(F.col("_error").isNotNull(), "failed").otherwise("succeeded")
    out = joined.withColumn("_after", F.when(hit, after)).withColumn("result_json", F.when(F.col("_after") == "succeeded", F.col("_result")).otherwise(F.col("result_json")))
    out = out.withColumn("message", F.when(F.col("_after") == "failed", F.col("_error")).otherwise(F.col("message")))
    out = out.withColumn("updated_at", F.when(F.col("_after").isNotNull(), now).otherwise(F.col("updated_at")))
    return out.withColumn("status", F.coalesce("_after", "status")).select(*tasks.columns)


def interrupted_analyses(tasks: DataFrame, now) -> DataFrame:
    """What a restart makes of tasks: those queued or running have failed."""
    active = F.col("status").isin(ACTIVE)
    return tasks.withColumn("updated_at", F.when(active, now).otherwise(F.col("updated_at"))).withColumn("status", F.when(active, "failed").otherwise(F.col("status")))


def restored_analyses(tasks: DataFrame, papers: DataFrame) -> DataFrame:
    """Succeeded tasks whose papers (paper_id, active_version_id) all still have the versions they were made of, by created_at."""
    done = tasks.where((F.col("status") == "succeeded") & F.col("result_json").isNotNull())
    whole = done.where(F.size("paper_ids") == F.size("version_ids"))
    pairs = whole.select("task_id", F.explode(F.arrays_zip("paper_ids", "version_ids")).alias("p")).select("task_id", F.col("p.paper_ids").alias("paper_id"), F.col("p.version_ids").alias("version_id"))
    valid = still_valid(pairs.withColumnRenamed("task_id", "id"), papers.select("paper_id", F.col("active_version_id").alias("version_id")))
    return whole.join(valid.where("valid").select(F.col("id").alias("task_id")), "task_id", "left_semi").orderBy("created_at", "task_id")


# papers


def deletions(papers: DataFrame, wanted: DataFrame, versions: DataFrame, tasks: DataFrame, folder: str) -> DataFrame:
    """(paper_id, problem): which of ``wanted`` (paper_id) may be deleted (null), and why not.

    A paper must be there, its file (file_path) lie in ``folder`` itself, and none of its versions
    have a task queued or running.
    """
    busy = tasks.where(F.col("status").isin(ACTIVE)).join(versions.select("version_id", "paper_id"), "version_id").select("paper_id").distinct().withColumn("busy", F.lit(True))
    rows = wanted.select("paper_id").distinct().join(papers.select("paper_id", "file_path"), "paper_id", "left").join(busy, "paper_id", "left")
    parent = F.regexp_replace("file_path", "/[^/]*$", "")
    problem = F.when(F.col("file_path").isNull(), "unknown").when(parent != folder.rstrip("/"), "outside").when(F.col("busy"), "active")
    return rows.select("paper_id", problem.alias("problem"))


def deletion_steps(attempts: DataFrame) -> DataFrame:
    """Attempts (paper_id, step, error) to (paper_id, deleted, completed, errors): both indexes, then the file, then history and database.

    Both indexes are tried; after an error, nothing more is done.
    """
    order = F.array(*[F.lit(x) for x in ("vector", "keyword", "file", "history", "database")])
    rows = attempts.withColumn("at", F.array_position(order, F.col("step")))
    first_bad = F.min(F.when(F.col("error").isNotNull(), F.greatest("at", F.lit(2)))).over(Window.partitionBy("paper_id"))
    done = rows.withColumn("reached", F.coalesce(F.col("at") <= first_bad, F.lit(True)))
    good = F.when(F.col("reached") & F.col("error").isNull(), F.struct("at", F.col("step").alias("x")))
    bad = F.when(F.col("reached") & F.col("error").isNotNull(), F.struct("at", F.concat("step", F.lit(": "), "error").alias("x")))
    texts = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda r: r["x"])
    out = done.groupBy("paper_id").agg(texts(good).alias("completed"), texts(bad).alias("errors"))
    return out.select("paper_id", ((F.size("errors") == 0) & F.array_contains("completed", "database")).alias("deleted"), "completed", "errors")


def marked_history(messages: DataFrame, gone: DataFrame) -> DataFrame:
    """Messages (paper_ids, deleted_paper_ids) whose scope holds deleted papers (paper_id) name them, once each.

    Deleted papers reach each message by a join of its papers, not as one list.
    """
    hit = messages.select("message_id", F.explode("paper_ids").alias("paper_id")).join(gone.select("paper_id").distinct(), "paper_id", "left_semi")
    lost = hit.groupBy("message_id").agg(F.sort_array(F.collect_set("paper_id")).alias("_lost"))
    both = F.array_distinct(F.concat(F.coalesce("deleted_paper_ids", F.slice("paper_ids", 1, 0)), "_lost"))
    marked = messages.join(lost, "message_id", "left")
    return marked.withColumn("deleted_paper_ids", F.when(F.col("_lost").isNotNull(), both).otherwise(F.col("deleted_paper_ids"))).select(*messages.columns)


def reprocessed(papers: DataFrame, builds: DataFrame, embedding_model: str, chunk_version: str) -> tuple[DataFrame, DataFrame]:
    """``papers`` (paper_id, active_version_id, status, quality_level) after new versions were built, and each build's outcome.

    Builds: (paper_id, version_id, embedding_model_id, chunk_version, error). One of another model or
    chunk version, or with an error, leaves the paper's version as it is; of several builds of a
    paper none is taken, since only one may be under way. Outcomes: (paper_id, version_id, activated, error).
    """
    several = F.count("*").over(Window.partitionBy("paper_id")) > 1
    problem = (
        F.when(several, "Reprocessing is already active for this paper").when(F.col("error").isNotNull(), F.col("error"))
        .when(~F.col("embedding_model_id").eqNullSafe(F.lit(embedding_model)), "Embedding model version mismatch")
        .when(~F.col("chunk_version").eqNullSafe(F.lit(chunk_version)), "Chunk version mismatch")
    )
    outcome = builds.withColumn("error", problem).select("paper_id", "version_id", F.col("error").isNull().alias("activated"), "error")
    fresh = outcome.where("activated").select("paper_id", F.col("version_id").alias("_version"))
    rows = papers.join(fresh, "paper_id", "left")
    hit = F.col("_version").isNotNull()
    rows = rows.withColumn("active_version_id", F.coalesce("_version", "active_version_id"))
    for name in ("status", "quality_level"):
        rows = rows.withColumn(name, F.when(hit, "ready").otherwise(F.col(name)))
    return rows.select(*papers.columns), outcome


# views

#: How states are shown.
PAPER_LABELS = {"pending": "等待处理", "parsing": "处理中", "ready": "可用", "partially_ready": "部分可用", "failed": "处理失败"}
ANSWER_LABELS = {"answered": "充分", "partially_answered": "部分回答", "conflicted": "存在冲突", "insufficient_evidence": "证据不足", "document_quality_failure": "文档质量不足", "out_of_scope": "范围不明确"}
READABLE = ["ready", "partially_ready"]


def marked_builds(versions: DataFrame, builds: DataFrame, outcome: DataFrame) -> DataFrame:
    """Versions (version_id, parse_status, ...) after a reprocessing: those whose build (paper_id, version_id) has an error in the outcome (paper_id, error) failed.

    The paper keeps its active version; the failed one can be told from one that was never built.
    """
    bad = builds.select("paper_id", "version_id").join(outcome.where("error is not null").select("paper_id"), "paper_id").select("version_id", F.lit("failed").alias("_state")).distinct()
    return versions.join(bad, "version_id", "left").withColumn("parse_status", F.coalesce("_state", "parse_status")).drop("_state").select(*versions.columns)


def label_of(labels: dict, value, default: str = "") -> F.Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), value), F.lit(default))


def available(papers: DataFrame) -> DataFrame:
    """The papers that can be read."""
    return papers.where(F.col("status").isin(READABLE))


def library_view(papers: DataFrame, tasks: DataFrame) -> DataFrame:
    """Papers with their labels and their active version's last task, newest first."""
    last = latest(tasks, ["version_id"], [F.desc("attempt")]).select(F.col("version_id").alias("active_version_id"), F.col("status").alias("task"), "error_message")
    rows = papers.join(last, "active_version_id", "left")
    failed = F.col("status") == "failed"
    view = rows.select(
        "paper_id", "title", label_of(PAPER_LABELS, F.col("status")).alias("status_label"), F.coalesce("active_version_id", F.lit("—")).alias("version"),
        F.when(F.col("task").isin(ACTIVE), F.col("task")).otherwise("").alias("progress"),
        F.when(failed, "failed").otherwise(F.coalesce("quality_level", F.lit(""))).alias("quality"),
        F.when(F.col("task") == "failed", F.coalesce("error_message", F.lit(""))).otherwise("").alias("error"),
        F.col("status").isin(READABLE).alias("readable"), (F.coalesce("task", F.lit("")) == "failed").alias("can_retry"), "created_at",
    )
    return view.orderBy(F.desc("created_at"), "paper_id")


def conversation_view(conversations: DataFrame, papers: DataFrame, messages: DataFrame, events: DataFrame) -> DataFrame:
    """Conversations with their papers, messages and scope events as lists: papers by id, the others by time and id."""
    told = messages.withColumn("answer_label", label_of(ANSWER_LABELS, F.col("answer_status")))
    nest = lambda rows, name, *cols: rows.groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    out = conversations.join(nest(papers, "papers", "paper_id"), "conversation_id", "left")
    out = out.join(nest(told, "messages", "created_at", "message_id", "role", "content", "answer_label"), "conversation_id", "left")
    return out.join(nest(events, "scope_events", "created_at", "event_id", "scope_mode"), "conversation_id", "left")


#: The orders in which tables are listed.
ORDERS = {
    "papers": [("created_at", "desc"), ("paper_id", "asc")], "conversations": [("updated_at", "desc")], "messages": [("created_at", "asc"), ("message_id", "asc")],
    "chunks": [("page_start", "asc"), ("page_end", "asc"), ("chunk_id", "asc")], "scope_events": [("created_at", "asc"), ("event_id", "asc")], "tasks": [("created_at", "desc")],
}


def listed(rows: DataFrame, table: str) -> DataFrame:
    return rows.orderBy(*[F.col(c).desc() if how == "desc" else F.col(c).asc() for c, how in ORDERS[table]])


#: Kinds of failures that another attempt may mend.
RETRYABLE = ["glm", "vector_index", "keyword_index", "database", "filesystem"]


def next_step(kind, attempt, most: int = 3) -> F.Column:
    return F.when(kind.isin(RETRYABLE) & (attempt < most), "retry").otherwise("give_up")


def active_conflicts(tasks: DataFrame) -> DataFrame:
    """Tasks (version_id, task_id, status): versions with more than one task queued or running."""
    active = tasks.where(F.col("status").isin("queued", "running"))
    return active.groupBy("version_id").agg(F.count("*").alias("active")).where("active > 1")


def still_valid(results: DataFrame, active: DataFrame) -> DataFrame:
    """Results' inputs (id, paper_id, version_id): valid while every one of them is an active version (paper_id, version_id)."""
    known = active.select("paper_id", "version_id", F.lit(True).alias("known")).distinct()
    return results.join(known, ["paper_id", "version_id"], "left").groupBy("id").agg(F.bool_and(F.coalesce("known", F.lit(False))).alias("valid"))


def touched(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Keys of the rows (key, paper_ids) whose scope holds a deleted paper (paper_id)."""
    return rows.select(key, F.explode("paper_ids").alias("paper_id")).join(gone, "paper_id", "left_semi").select(key).distinct()


def scope_changes(rows: DataFrame) -> DataFrame:
    """Events (id, at, event_id, scope): those whose scope differs from the one before, which comes along."""
    before = F.lag("scope").over(Window.partitionBy("id").orderBy("at", "event_id"))
    return rows.withColumn("previous", before).where(~F.col("scope").eqNullSafe(F.col("previous"))).drop("at")


def worst(parts: DataFrame, key: str) -> DataFrame:
    """Parts' statuses rolled up: unavailable before warning before available."""
    has = lambda x: F.bool_or(F.col("status") == x)
    return parts.groupBy(key).agg(F.when(has("unavailable"), "unavailable").when(has("warning"), "warning").otherwise("available").alias("status"))


def question_problem(text, most: int = 8000) -> F.Column:
    """Why a question is turned away, else null."""
    bare = F.trim(F.coalesce(text, F.lit("")))
    return F.when(bare == "", "empty").when(F.length(bare) > most, "too_long")


def batch_problem(files, most: int = 20) -> F.Column:
    """Why an upload batch (an array) is turned away, else null."""
    return F.when(F.coalesce(F.size(files), F.lit(0)) <= 0, "empty").when(F.size(files) > most, "too_many")


def summarised(messages: DataFrame, most: int = 6, summary=lambda text: F.left(text, F.lit(100))) -> DataFrame:
    """Chats (conv_id, turn, role, text) of over ``most`` messages: the first, and one of the assistant's with a summary of the others."""
    own = Window.partitionBy("conv_id")
    placed = messages.select("conv_id", "turn", "role", "text", F.row_number().over(own.orderBy("turn")).alias("at"), F.count("*").over(own).alias("total"))
    stays = (F.col("total") <= most) | (F.col("at") == 1)
    old = placed.where(~stays).groupBy("conv_id").agg(F.min("turn").alias("turn"), F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("m"))
    joined = F.array_join(F.transform("m", lambda x: x["text"]), "\n")
    told = old.select("conv_id", "turn", F.lit("assistant").alias("role"), F.concat(F.lit("之前的对话摘要："), summary(joined)).alias("text"))
    return placed.where(stays).select("conv_id", "turn", "role", "text").unionByName(told)


def compressed(messages: DataFrame, most: int = 8, keep: int = 3, summary=lambda text: F.left(text, F.lit(150))) -> DataFrame:
    """Histories (conv_id, turn, role, text) of over ``most`` messages: the first, a summary, and the last ``keep``.

    ``summary`` makes the summary's column of the other messages' text, joined by line feeds; a
    model can be put there.
    """
    own = Window.partitionBy("conv_id")
    at, back = F.row_number().over(own.orderBy("turn")), F.row_number().over(own.orderBy(F.desc("turn")))
    placed = messages.select("conv_id", "turn", "role", "text", at.alias("at"), back.alias("back"), F.count("*").over(own).alias("total"))
    stays = (F.col("total") <= most) | (F.col("at") == 1) | (F.col("back") <= keep)
    old = placed.where(~stays).groupBy("conv_id").agg(F.min("turn").alias("turn"), F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("m"))
    joined = F.array_join(F.transform("m", lambda x: x["text"]), "\n")
    told = old.select("conv_id", "turn", F.lit("system").alias("role"), summary(joined).alias("text"))
    return placed.where(stays).select("conv_id", "turn", "role", "text").unionByName(told)
