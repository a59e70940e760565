"""Cases of the rules, against results that are written out by hand, so that code and SQL can't share an error."""

import pytest
from pyspark.sql import functions as F

from folioscope.operators import agents, grounding, lifecycle, planner
from tests.sql_check import same

CASES = {}


def query(sql):
    return lambda f: CASES.setdefault(f.__name__, (f, sql)) and f


def _cases(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


_GOOD = '{"answer_status": "answered", "concise_answer": "c", "claims": [{"text": "t", "evidence_ids": ["e"], "support": "direct"}], "uncertainty": [], "conflicts": [], "unanswered_items": [], "refusal_reason": null}'


@query(f"""select * from (values
  (1, 'method', 'Which approach is it?', null, null, 'Which approach is it?', false), (2, 'comparison', 'Compare X versus Y？追问：why', null, null, 'x', false), (3, 'related_work', 'List citation sources', null, null, 'x', true),
  (4, 'factual', 'Where is it used in this paper', '{planner.AMBIGUOUS}', null, '', false), (5, 'factual', 'Plain', '{planner.UNSCOPED}', null, '', false), (6, 'factual', 'Plain', null, null, 'x', false),
  (7, 'factual', '', null, 'empty_question', '', false), (8, 'factual', 'Plain', null, 'unknown_scope_mode', '', false), (9, 'method', 'Explain the method of this paper [paper_id=p7]', null, null, 'x', false),
  (10, 'factual', 'this paper', '{planner.AMBIGUOUS}', null, '', false)) as t(id, intent, resolved, clarification, error, kind, include_references) where id > 1
  union all select 1, 'factual', 'Which approach is it?', null, null, 'x', false""".replace("Compare X versus Y？追问：why", "Compare X versus Y；追问：why"))
def plan_cases(spark, d):
    """Questions of every rule of the planner, against results that are written out."""
    rows = [
        (1, "Which approach is it?", ["p1"], "selected", None), (2, "why", ["p1"], "selected", "Compare X versus Y"), (3, "List citation sources", [], "library", None), (4, "Where is it used in this paper", ["p1", "p2"], "selected", None),
        (5, "Plain", [], "selected", None), (6, "Plain", [], "library", "Before"), (7, " \t", ["p1"], "selected", None), (8, "Plain", ["p1"], "all", None), (9, "  Explain the method of this paper ", ["p7", "p7"], "selected", None), (10, "this paper", [], "selected", None),
    ]
    got = planner.plan(_cases(spark, rows, "id int, question string, paper_ids array<string>, scope_mode string, previous string"))
    return got.select("id", "intent", "resolved", "clarification", "error", F.when(F.size("subqueries") > 0, "x").otherwise("").alias("kind"), "include_references")


@query("""select * from (values (1, 9::bigint, '1,4,6', '2,3,7'), (2, 0::bigint, '', '1')) as t(question_id, used, kept, omitted)""")
def budget_cases(spark, d):
    """Unknown and poor items are omitted, repeated contents of a paper skipped, and smaller items still fit."""
    rows = [
        (1, 1, 1, 4, 0.9, "One  text", "p", True), (1, 2, 2, 1, 0.1, "poor", "p", True), (1, 3, 3, 0, None, None, "p", False), (1, 4, 1, 4, 0.9, "One  text", "p", True), (1, 5, 5, 1, None, " one TEXT", "p", True),
        (1, 6, 4, 4, None, "one text", "q", True), (1, 7, 7, 3, 0.5, "too long", "p", True), (1, 8, 6, 1, 0.5, "fits", "p", True), (2, 1, 1, 11, 0.9, "x", "p", True),
    ]
    return grounding.budgeted(_cases(spark, rows, "question_id int, ord int, item_id int, tokens int, quality double, content string, paper_id string, known boolean"), 10).drop("items")


@query("""select * from (values
  (1, 'answered', 'a', 'kept', '', '', '', ''), (2, 'partially_answered', 'b', 'good', 'bad', '', 'u1,u2', 'Unknown Evidence ID: e9'), (3, 'conflicted', 'c', 'x', 'y', 'x', '', 'Hidden conflict exposed: x;Claim has no evidence'),
  (4, 'insufficient_evidence', '现有原文证据不足，无法可靠回答。', '', 'z', '', '', 'Unsupported claim removed: z'), (5, 'conflicted', 'e', 'w', '', 'own', '', 'Claim downgraded to inference: w'), (6, 'answered', 'f', '', '', '', '', ''),
  (7, 'insufficient_evidence', '现有原文证据不足，无法可靠回答。', '', 'o', '', '', 'Evidence is outside the active paper scope: e3')) as t(answer_id, answer_status, concise_answer, claims, removed, conflicts, unanswered_items, warnings)""")
def verification_cases(spark, d):
    """Answers whose claims are unknown, out of scope, unsupported, inferred or in conflict, against results that are written out."""
    answers = [(1, "answered", "a", [], [], []), (2, "answered", "b", [], ["u1"], ["u1", "u2"]), (3, "answered", "c", [], [], []), (4, "answered", "d", [], [], []), (5, "answered", "e", ["own"], [], []), (6, "answered", "f", [], [], []), (7, "answered", "g", [], [], [])]
    claims = [
        (1, 0, "kept", ["e1"], "direct", "direct"), (2, 0, "good", ["e1"], "inference", "inference"), (2, 1, "bad", ["e1", "e9"], "direct", "direct"), (3, 0, "x", ["e2"], "direct", "conflict"), (3, 1, "y", [], "direct", "direct"),
        (4, 0, "z", ["e1"], "direct", "insufficient"), (5, 0, "w", ["e1"], "direct", "inference"), (7, 0, "o", ["e3"], "direct", "direct"),
    ]
    own = _cases(spark, [("e1", True), ("e2", True), ("e3", False)], "evidence_id string, allowed boolean")
    got = grounding.verify_answers(
        _cases(spark, answers, "answer_id int, answer_status string, concise_answer string, conflicts array<string>, unanswered_items array<string>, plan_unanswered array<string>").withColumn("refusal_reason", F.lit(None).cast("string")),
        _cases(spark, claims, "answer_id int, claim int, text string, evidence_ids array<string>, support string, level string"), own,
    )
    texts = F.array_join(F.transform(F.coalesce("claims", F.array()), lambda c: c["text"]), ",")
    return got.select("answer_id", "answer_status", "concise_answer", F.coalesce(texts, F.lit("")).alias("claims"), *[F.array_join(c, ",").alias(c) for c in ("removed", "conflicts", "unanswered_items")], F.array_join("warnings", ";").alias("warnings"))


@query("""select * from (values (1, 'answered', null), (2, null, 'Missing structured fields: claims, conflicts, refusal_reason, unanswered_items, uncertainty'), (3, null, 'Structured response must be an object'), (4, null, 'Structured response must be an object'),
  (5, null, 'Invalid answer_status'), (6, null, 'Invalid claim structure'), (7, null, 'Invalid claim support'), (8, null, 'conflicts must be a list'), (9, null, 'empty response'), (10, 'answered', null)) as t(id, status, error)""")
def answer_json_cases(spark, d):
    """Responses of a model, whole and broken, against results that are written out."""
    rows = [
        _GOOD, '{"answer_status": "answered", "concise_answer": "c"}', "[1]", "no json", _GOOD.replace('"answered"', '"maybe"'), _GOOD.replace('"evidence_ids": ["e"], ', ""), _GOOD.replace('"direct"', '"strong"'),
        _GOOD.replace('"conflicts": []', '"conflicts": "none"'), None, _GOOD.replace('[{"text": "t", "evidence_ids": ["e"], "support": "direct"}]', "[]"),
    ]
    got = grounding.parsed_answers(_cases(spark, [(i, r) for i, r in enumerate(rows, 1)], "id int, response string"))
    return got.select("id", F.col("answer.answer_status").alias("status"), "error")


@query("""select * from (values (1, 7.0::double), (2, 2.5), (3, -8.0), (4, null), (5, null), (6, null), (7, 1.0), (8, null)) as t(id, value)""")
def calculation_cases(spark, d):
    rows = ["1 + 2 * 3", "(1+4)/2", "-2 ** 3", "__import__('os')", "1 / 0", None, "7 % 3 // 1", "'a' * 3"]
    return agents.calculations(_cases(spark, [(i, r) for i, r in enumerate(rows, 1)], "id int, text string"), "text").select("id", "value")


@query("""select * from (values (1, true, 'vector,keyword,file,history,database', ''), (2, false, 'keyword', 'vector: no'), (3, false, '', 'vector: a,keyword: b'), (4, false, 'vector,keyword', 'file: locked')) as t(paper_id, deleted, completed, errors)""")
def deletion_cases(spark, d):
    steps = ["vector", "keyword", "file", "history", "database"]
    bad = {(2, "vector"): "no", (3, "vector"): "a", (3, "keyword"): "b", (4, "file"): "locked"}
    rows = [(p, s, bad.get((p, s))) for p in range(1, 5) for s in steps]
    got = lifecycle.deletion_steps(_cases(spark, rows, "paper_id int, step string, error string"))
    return got.select("paper_id", "deleted", F.array_join("completed", ",").alias("completed"), F.array_join("errors", ",").alias("errors"))


@pytest.mark.parametrize("name", sorted(CASES))
def test_results_are_those_written_out(spark, name):
    case, sql = CASES[name]
    same(case(spark, ""), sql, "/root/testdata/sf0.001")
