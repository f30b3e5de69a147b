"""Nested records: hand-made cases with every kind of dirt, and a brute-force walk over the smallest tables."""

import json

from textloom.operators import nested as N

SCHEMA = "dump_id bigint, version string, received_at timestamp, data array<struct<title:string,paragraphs:array<struct<context:string,qas:array<struct<id:string,question:string,is_impossible:boolean,answers:array<struct<text:string,answer_start:int>>,plausible_answers:array<struct<text:string,answer_start:int>>>>>>>>, payload string"


def found(spark, payloads, start=0):
    rows = [(i, None, None, None, p) for i, p in enumerate(payloads, start)]
    return sorted(tuple(r) for r in N.qa_found(N.qa_triples(spark.createDataFrame(rows, SCHEMA))).collect())


def q(**kw):
    return {"id": "q", "question": "?", **kw}


def wrap(*qas):
    return [{"title": "t", "paragraphs": [{"context": "c", "qas": list(qas)}]}]


def test_kinds_and_places(spark):
    a = {"text": "x", "answer_start": 1}
    got = found(spark, [json.dumps(wrap(q(answers=[a, None, a]), q(plausible_answers=a), q(), None, q(answers=[], plausible_answers=None)))])
    assert got == [(0, 0, 0, 0, "answer", 0), (0, 0, 0, 0, "answer", 2), (0, 0, 0, 1, "plausible", 0), (0, 0, 0, 2, "none", 0), (0, 0, 0, 4, "none", 0)]


def test_shapes(spark):
    one = {"title": "t", "paragraphs": {"context": "c", "qas": q(answers={"text": "x"})}}
    want = (0, 0, 0, "answer", 0)
    for text in (json.dumps({"version": "v", "data": [one]}), json.dumps([one]), json.dumps(one), json.dumps({"data": one})):
        assert [r[1:] for r in found(spark, [text])] == [want]


def test_broken_and_empty(spark):
    whole = json.dumps(wrap(q()))
    assert found(spark, [whole[:-3], "", "NaN", "[NaN]", "7", "[" * 5000 + "]" * 5000, None, "{}", "[]", '{"data": "x"}', '{"data": [null, 3]}']) == []
    assert N.qa_found(N.qa_triples(spark.createDataFrame([], SCHEMA))).collect() == []


def test_typed_rows_and_deliveries(spark):
    import datetime as dt

    old, new = dt.datetime(2022, 1, 1), dt.datetime(2022, 2, 1)
    data = [("t", [("c", [("q1", "?", True, [], [("p", 3)]), None]), None])]
    rows = [(1, "v", old, None, json.dumps(wrap(q(), q()))), (1, "v", new, data, None), (None, "v", new, data, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("version", "text")  # a clashing name
    t = N.qa_triples(df)
    assert sorted(tuple(r) for r in N.qa_found(t).collect()) == [(1, 0, 0, 0, "plausible", 0)]
    assert [tuple(r) for r in N.qa_questions(t).collect()] == [(1, 0, 0, 0, "q1", "?", True)]
    assert [tuple(r) for r in N.qa_answers(t).collect()] == [(1, 0, 0, 0, "plausible", 0, "p", 3)]
    assert [tuple(r) for r in N.qa_paragraphs(t).collect()] == [(1, 0, 0, "c")]
    assert [tuple(r) for r in N.qa_articles(t).collect()] == [(1, 0, "t")]


def test_values_of_another_type(spark):
    text = json.dumps(wrap(q(is_impossible="true", answers=[{"text": 5, "answer_start": "x"}]), q(is_impossible=7, answers="none")))
    t = N.qa_triples(spark.createDataFrame([(1, None, None, None, text)], SCHEMA))
    assert sorted(r["is_impossible"] is True for r in N.qa_questions(t).collect()) == [False, True]
    assert [(r["text"], r["answer_start"]) for r in N.qa_answers(t).collect()] == [("5", None)]
    assert ("none", 0) in {(r["answer_kind"], r["answer_no"]) for r in N.qa_found(t).collect()}


def test_against_brute_force(spark):
    import os

    import pytest

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables here")
    want = set()
    rows = spark.read.parquet(f"{d}/qa_dump.parquet").selectExpr("dump_id", "coalesce(to_json(data, map('ignoreNullFields', 'false')), payload) as t").distinct().collect()
    items = lambda x: list(enumerate(x)) if isinstance(x, list) else [(0, x)] if isinstance(x, dict) else []
    for r in rows:
        try:
            top = json.loads(r["t"])
        except ValueError:
            continue
        for a, art in items(top.get("data") if isinstance(top, dict) and "data" in top else top):
            for p, par in items((art or {}).get("paragraphs")):
                for k, qa in items((par or {}).get("qas")):
                    if not isinstance(qa, dict):
                        continue
                    own = [("answer", i) for i, x in items(qa.get("answers")) if isinstance(x, dict)] + [("plausible", i) for i, x in items(qa.get("plausible_answers")) if isinstance(x, dict)]
                    want |= {(r["dump_id"], a, p, k, *x) for x in own or [("none", 0)]}
    got = [tuple(r) for r in N.qa_found(N.qa_triples(spark.read.parquet(f"{d}/qa_dump.parquet"))).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_any_depth():
    import random

    rng = random.Random(2)

    def make(depth):
        k = rng.randrange(6 if depth else 4)
        if k == 4:
            return [make(depth - 1) for _ in range(rng.randrange(4))]
        if k == 5:
            return {rng.choice(["a", "b", "\u00e9\n", ""]) + str(i): make(depth - 1) for i in range(rng.randrange(4))}
        return [None, True, rng.choice([0, -1.5, 12e3]), 'x"\\'][k]

    for _ in range(200):
        x = make(4)
        for text in (json.dumps(x), json.dumps(x, indent=1)):
            assert N.read_deep(text) == x
            cut = text[: rng.randrange(len(text))]
            try:
                want = json.loads(cut)
            except ValueError:
                want = ValueError
            try:
                got = N.read_deep(cut)
            except ValueError:
                got = ValueError
            assert got == want
    deep = '{"data": [{"title": "t", "paragraphs": [{"x": ' + "[" * 200_000 + "]" * 200_000 + ', "context": "c", "qas": []}]}]}'
    got = list(N.triples_of(deep, frozenset(N.QA_ARRAYS)))
    assert ("data[].paragraphs[].context", [0, 0], "value", "c") in got
