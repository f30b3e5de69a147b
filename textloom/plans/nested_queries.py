"""Queries p6_*: nested question records as flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.operators import nested
from textloom.plans.qa import QA_SQL, value_sql
from textloom.runtime import materialize, table


def _over(fn):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(materialize(nested.qa_triples(table(spark, sf_dir, "qa_dump")), "triples"))

    return query


QUERIES = {
    "p6_found": _over(nested.qa_found),
    "p6_articles": _over(nested.qa_articles),
    "p6_paragraphs": _over(nested.qa_paragraphs),
    "p6_questions": _over(nested.qa_questions),
    "p6_answers": _over(nested.qa_answers),
}
_KEYS = "dump_id, ar_no AS article_no, pa_no AS paragraph_no, qu_no AS qa_no"
_FLAG = f"lower(trim({value_sql('qu', 'is_impossible')}))"


def _answer(kind: str, a: str) -> str:
    return f"SELECT {_KEYS}, '{kind}' AS answer_kind, {a}_no AS answer_no, {value_sql(a, 'text')} AS text, TRY_CAST({value_sql(a, 'answer_start')} AS BIGINT) AS answer_start FROM {a}"


_ALL = f"{_answer('answer', 'an')} UNION ALL {_answer('plausible', 'pl')}"
ORACLE: dict[str, str] = {
    "p6_articles": f"WITH {QA_SQL} SELECT dump_id, ar_no AS article_no, {value_sql('ar', 'title')} AS title FROM ar",
    "p6_paragraphs": f"WITH {QA_SQL} SELECT dump_id, ar_no AS article_no, pa_no AS paragraph_no, {value_sql('pa', 'context')} AS context FROM pa",
    "p6_questions": f"WITH {QA_SQL} SELECT {_KEYS}, {value_sql('qu', 'id')} AS id, {value_sql('qu', 'question')} AS question, CASE WHEN {_FLAG} IN ('true', '1') THEN true WHEN {_FLAG} IN ('false', '0') THEN false END AS is_impossible FROM qu",
    "p6_answers": f"WITH {QA_SQL} {_ALL}",
    "p6_found": f"WITH {QA_SQL}, every AS ({_ALL}) SELECT dump_id, article_no, paragraph_no, qa_no, answer_kind, answer_no FROM every UNION ALL SELECT {_KEYS}, 'none', 0 FROM qu WHERE (dump_id, ar_no, pa_no, qu_no) NOT IN (SELECT (dump_id, article_no, paragraph_no, qa_no) FROM every)",
}
