"""The question records for queries and SQL: typed and text dumps alike, each once, flat."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import nested
from textloom.runtime import materialize, table


def _array(x: str) -> str:
    """A JSON value as a list: an array's members, a lone object as its only one, nothing else."""
    return f"CASE json_type({x}) WHEN 'ARRAY' THEN from_json({x}, '[\"JSON\"]') WHEN 'OBJECT' THEN [{x}] ELSE [] END"


def _members(name: str, of: str, source: str, keys: str, field: str) -> str:
    return f"""{name}0 AS (SELECT {keys}, {_array(f"{of}->'{field}'")} AS l FROM {source}),
{name} AS (SELECT * FROM (SELECT {keys}, unnest(range(len(l))) AS {name}_no, unnest(l) AS {name} FROM {name}0) WHERE json_type({name}) = 'OBJECT')"""


def value_sql(x: str, field: str) -> str:
    """A member's single value as text; objects and nulls are null."""
    return f"CASE WHEN json_type({x}->'{field}') NOT IN ('OBJECT', 'NULL') THEN {x}->>'{field}' END"


#: CTEs: ar (dump_id, ar_no, ar), pa (and pa_no, pa), qu (and qu_no, qu), an and pl (and an_no, an; pl_no, pl).
QA_SQL = f"""jt AS (SELECT dump_id, t FROM (SELECT dump_id, t, row_number() OVER (PARTITION BY dump_id ORDER BY received_at DESC, t DESC) AS rn
FROM (SELECT dump_id, received_at, coalesce(CAST(to_json(data) AS VARCHAR), payload) AS t FROM qa_dump WHERE dump_id IS NOT NULL)) WHERE rn = 1),
jj AS (SELECT dump_id, CASE WHEN json_valid(t) THEN CAST(t AS JSON) END AS j FROM jt),
top AS (SELECT dump_id, CASE WHEN json_type(j) = 'OBJECT' AND list_contains(json_keys(j), 'data') THEN j WHEN json_type(j) IN ('OBJECT', 'ARRAY') THEN json_object('data', j) END AS j FROM jj),
{_members("ar", "j", "top", "dump_id", "data")},
{_members("pa", "ar", "ar", "dump_id, ar_no, ar", "paragraphs")},
{_members("qu", "pa", "pa", "dump_id, ar_no, pa_no, pa", "qas")},
{_members("an", "qu", "qu", "dump_id, ar_no, pa_no, qu_no, qu", "answers")},
{_members("pl", "qu", "qu", "dump_id, ar_no, pa_no, qu_no, qu", "plausible_answers")}"""
#: And q: id, question, context, answers (list of text, answer_start) of every question with an id.
QUESTIONS_SQL = f"""{QA_SQL},
al AS (SELECT dump_id, ar_no, pa_no, qu_no, list({{'text': {value_sql("an", "text")}, 'answer_start': TRY_CAST({value_sql("an", "answer_start")} AS BIGINT)}} ORDER BY an_no) AS answers FROM an GROUP BY ALL),
q AS (SELECT {value_sql("qu", "id")} AS id, {value_sql("qu", "question")} AS question, {value_sql("pa", "context")} AS context, answers FROM qu LEFT JOIN al USING (dump_id, ar_no, pa_no, qu_no) WHERE {value_sql("qu", "id")} IS NOT NULL)"""


def questions(spark: SparkSession, d: str) -> DataFrame:
    """id, question, context, answers (array<struct<text, answer_start>>, null without any) of every question with an id."""
    t = materialize(nested.qa_triples(table(spark, d, "qa_dump")), "triples")
    at = ["dump_id", "article_no", "paragraph_no"]
    answer = F.struct("answer_no", "text", "answer_start")
    a = nested.qa_answers(t).where("answer_kind = 'answer'").groupBy(*at, "qa_no").agg(F.array_sort(F.collect_list(answer)).alias("a"))  # one question's answers
    q = nested.qa_questions(t).where("id is not null").join(nested.qa_paragraphs(t), at, "left").join(a, [*at, "qa_no"], "left")
    return q.select("id", "question", "context", F.transform("a", lambda x: F.struct(x["text"].alias("text"), x["answer_start"].alias("answer_start"))).alias("answers"))
