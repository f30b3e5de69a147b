"""Deeply nested records to related flat tables.

Each record is parsed once, as a stream of path-value-ordinal triples. A path is written with ``[]`` behind every
repeated step; the ordinals are the places in those arrays, from 0, outermost first. Paths that share their repeated
ancestors form one group, and a group pivots into one table whose keys are the record id and the ordinals.

Defined cases: a null record id is no record; a record sent again counts once (the last ``received_at``; among equal
ones the larger text); text that is no valid JSON (also NaN) gives no rows; nesting has no limit; a null
array member takes a place and gives no row; an object in the place of a declared array is its only member, place 0;
a value of any other kind there is no member; an unknown field is ignored; an empty table gives empty tables.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The repeated steps of the question records, outermost first.
QA_ARRAYS = ("data", "data[].paragraphs", "data[].paragraphs[].qas", "data[].paragraphs[].qas[].answers", "data[].paragraphs[].qas[].plausible_answers")
TRIPLES = "record_id bigint, path string, ordinals array<int>, kind string, value string"


def _refuse(token: str) -> None:
    raise ValueError(token)


def _wrap_lone(x: object, path: str, arrays: frozenset[str]) -> object:
    """Put lone objects into their declared arrays, in place."""
    todo = [(x, path)]
    while todo:
        x, path = todo.pop()
        if isinstance(x, dict):
            for k, v in x.items():
                p = f"{path}.{k}" if path else k
                if p in arrays:
                    if isinstance(v, dict):
                        v = x[k] = [v]
                    if isinstance(v, list):
                        todo.extend((m, p + "[]") for m in v)
                else:
                    todo.append((v, p))
    return x


_WHITE = re.compile(r"[ \t\n\r]*")
_PLAIN = re.compile(r"true|false|null|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?")


def read_deep(text: str) -> object:
    """One JSON text of any depth, read step by step with a stack of open arrays and objects; ValueError if it isn't valid."""
    skip = lambda i: _WHITE.match(text, i).end()
    stack: list[tuple[object, str | None]] = []
    i, key = skip(0), None
    while True:
        c = text[i : i + 1]
        if c in ("{", "["):
            stack.append(({} if c == "{" else [], key))
            i, key = skip(i + 1), None
            if text[i : i + 1] == ("}" if c == "{" else "]"):
                value, key = stack.pop()
                i += 1
            elif c == "[":
                continue
            else:
                key, i = _key(text, i, skip)
                continue
        elif c == '"':
            value, i = scanstring(text, i + 1)
        else:
            m = _PLAIN.match(text, i)
            if not m:
                raise ValueError(i)
            value, i = json.loads(m.group()), m.end()
        while True:  # a value is complete: put it where it belongs, and close what ends with it
            i = skip(i)
            if not stack:
                if i != len(text):
                    raise ValueError(i)
                return value
            into, own = stack[-1]
            if isinstance(into, dict):
                into[key] = value
            else:
                into.append(value)
            c = text[i : i + 1]
            if c == ",":
                i, key = skip(i + 1), None
                if isinstance(into, dict):
                    key, i = _key(text, i, skip)
                break
            if c != ("}" if isinstance(into, dict) else "]"):
                raise ValueError(i)
            stack.pop()
            value, key = into, own
            i += 1


def _key(text: str, i: int, skip) -> tuple[str, int]:
    if text[i : i + 1] != '"':
        raise ValueError(i)
    key, i = scanstring(text, i + 1)
    i = skip(i)
    if text[i : i + 1] != ":":
        raise ValueError(i)
    return key, skip(i + 1)


def _leaf(x: object) -> str | None:
    if isinstance(x, str):
        return x
    try:
        return json.dumps(x, ensure_ascii=False)
    except RecursionError:  # an array in the place of a single value, deeper than can be written
        return None


def triples_of(text: str, arrays: frozenset[str], root: str | None = None) -> Iterator[tuple[str, list[int], str, str | None]]:
    """(path, ordinals, kind, value) of each member and leaf of one JSON text, in document order.

    ``root``: a bare array (or a bare member of it) at the top stands for this field.
    """
    try:
        top = json.loads(text, parse_constant=_refuse)
    except RecursionError:
        try:
            top = read_deep(text)
        except ValueError:
            return
    except ValueError:
        return
    if root is not None and (isinstance(top, list) or isinstance(top, dict) and root not in top):
        top = {root: top}
    if not isinstance(top, dict):
        return
    _wrap_lone(top, "", arrays)
    todo: list[tuple[str, tuple[int, ...], object]] = [("", (), top)]
    while todo:
        path, at, x = todo.pop()
        if isinstance(x, dict):
            if path.endswith("[]"):
                yield path, list(at), "object", None
            step = path + "." if path else ""
            todo.extend((step + k, at, v) for k, v in reversed(x.items()))
        elif path in arrays:
            if isinstance(x, list):
                todo.extend((path + "[]", (*at, i), v) for i, v in reversed(list(enumerate(x))))
        elif x is None:
            yield path, list(at), "null", None
        else:
            yield path, list(at), "value", _leaf(x)


def record_triples(df: DataFrame, id_col: str, text: Column, arrays: Iterable[str] = QA_ARRAYS, root: str | None = "data") -> DataFrame:
    """Stream-parse every record's JSON text into triples (``TRIPLES``); one record's triples stay in one task."""
    known = frozenset(arrays)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_id", pa.int64()), ("path", pa.string()), ("ordinals", pa.list_(pa.int32())), ("kind", pa.string()), ("value", pa.string())])
        out: list[tuple] = []
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1)
            for i, rid in enumerate(ids):
                out.extend((rid, *t) for t in triples_of(texts[i].as_py(), known, root))
                if len(out) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return df.select(F.col(id_col).cast("bigint").alias("record_id"), text.alias("text")).where("record_id is not null and text is not null").mapInArrow(parse, TRIPLES)


def latest_records(df: DataFrame, id_col: str, text: Column, received: str) -> DataFrame:
    """One row per id: the last delivery, among equal times the larger text; rows without id are left out."""
    w = Window.partitionBy("record_id").orderBy(F.desc("received"), F.desc("text"))
    rows = df.select(F.col(id_col).cast("bigint").alias("record_id"), F.col(received).alias("received"), text.alias("text")).where("record_id is not null")
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "received")


def pivot_group(triples: DataFrame, group: str, fields: dict[str, str], keys: list[str]) -> DataFrame:
    """One flat table: a row per object at ``group``, its single-valued fields as columns, keys named outermost first.

    ``fields``: column by field name below the group. A field that is absent or null gives null.
    """
    at = [F.col("ordinals")[i].cast("bigint").alias(k) for i, k in enumerate(keys)]
    paths = [f"{group}.{f}" for f in fields]
    rows = triples.where(F.col("path").isin(group, *paths))
    out = rows.groupBy("record_id", *at).agg(
        F.max((F.col("path") == group) & (F.col("kind") == "object")).alias("there"), *[F.max(F.when(F.col("path") == f"{group}.{f}", F.col("value"))).alias(c) for f, c in fields.items()]
    )
    return out.where("there").drop("there")


def qa_triples(df: DataFrame) -> DataFrame:
    """Triples of ``qa_dump`` rows, typed or as text, each dump once."""
    text = F.coalesce(F.to_json("data", {"ignoreNullFields": "false"}), F.col("payload"))
    return record_triples(latest_records(df, "dump_id", text, "received_at"), "record_id", F.col("text"))


_ARTICLE = "data[]"
_PARAGRAPH = _ARTICLE + ".paragraphs[]"
_QUESTION = _PARAGRAPH + ".qas[]"
_KEYS = ["article_no", "paragraph_no", "qa_no", "answer_no"]


def qa_articles(triples: DataFrame) -> DataFrame:
    """dump_id, article_no, title."""
    return pivot_group(triples, _ARTICLE, {"title": "title"}, _KEYS[:1]).withColumnRenamed("record_id", "dump_id")


def qa_paragraphs(triples: DataFrame) -> DataFrame:
    """dump_id, article_no, paragraph_no, context."""
    return pivot_group(triples, _PARAGRAPH, {"context": "context"}, _KEYS[:2]).withColumnRenamed("record_id", "dump_id")


def qa_questions(triples: DataFrame) -> DataFrame:
    """dump_id, article_no, paragraph_no, qa_no, id, question, is_impossible; a truth value typed as text is read, any other value is null."""
    t = pivot_group(triples, _QUESTION, {"id": "id", "question": "question", "is_impossible": "flag"}, _KEYS[:3])
    flag = F.when(F.lower(F.trim("flag")).isin("true", "1"), True).when(F.lower(F.trim("flag")).isin("false", "0"), False)
    return t.withColumn("is_impossible", flag).drop("flag").withColumnRenamed("record_id", "dump_id")


def qa_answers(triples: DataFrame) -> DataFrame:
    """dump_id, article_no, paragraph_no, qa_no, answer_kind, answer_no, text, answer_start; a start that is no number is null."""
    parts = []
    for kind, field in (("answer", "answers"), ("plausible", "plausible_answers")):
        t = pivot_group(triples, f"{_QUESTION}.{field}[]", {"text": "text", "answer_start": "start"}, _KEYS)
        parts.append(t.withColumn("answer_kind", F.lit(kind)))
    t = parts[0].unionByName(parts[1]).withColumn("answer_start", F.expr("try_cast(start as bigint)"))
    return t.select(F.col("record_id").alias("dump_id"), *_KEYS[:3], "answer_kind", "answer_no", "text", "answer_start")


def qa_found(triples: DataFrame) -> DataFrame:
    """One row per answer, and one of kind ``none``, number 0, per question without any (TESTDATA's p6_found)."""
    keys = ["dump_id", *_KEYS[:3]]
    answers = qa_answers(triples).select(*keys, "answer_kind", "answer_no")
    none = qa_questions(triples).select(*keys).join(answers.select(*keys).distinct(), keys, "left_anti")
    return answers.unionByName(none.select(*keys, F.lit("none").alias("answer_kind"), F.lit(0).cast("bigint").alias("answer_no")))
