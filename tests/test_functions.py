"""Golden values of tokenisers and markup, readers on small files, sessions, streams and stores."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions import tokenize as K
from textloom.functions import wiki as W
from textloom.operators import dialog, features, linking, metrics, sessions, stores, vectors
from textloom.sources import readers
from textloom.streaming import jobs

VOCABULARY = ["[UNK]", "[CLS]", "[SEP]", "want", "##want", "##ed", "wa", "un", "runn", "##ing", ",", "low", "lowest"]


def test_basic_and_word_pieces():
    v = frozenset(VOCABULARY)
    assert [p for w in K.basic_tokens("UNwantéd,running") for p in K.word_pieces(w, v)] == ["un", "##want", "##ed", ",", "runn", "##ing"]
    assert K.basic_tokens("ah博推zz") == ["ah", "博", "推", "zz"]
    assert K.basic_tokens(" \tHeLLo!how  \n Are yoU?  ") == ["hello", "!", "how", "are", "you", "?"]
    assert K.basic_tokens(" \tHeLLo!how  \n Are yoU?  ", lower=False) == ["HeLLo", "!", "how", "Are", "yoU", "?"]
    assert [p for w in "unwantedX running".split() for p in K.word_pieces(w, v)] == ["[UNK]", "runn", "##ing"]
    assert K.word_pieces("x" * 101, v) == ["[UNK]"] and K.basic_tokens("") == []


def test_character_classes():
    assert K.is_blank(" ") and not K.is_blank("-") and K.is_control("\u0005") and not K.is_control("\t")
    assert all(map(K.is_punctuation, "-$`.")) and not K.is_punctuation("A")


def test_merged_pairs():
    ranks = {("l", "o"): 0, ("lo", "w"): 1, ("e", "r"): 2}
    assert K.merged_pairs(list("lower"), ranks) == ["low", "er"]
    assert K.merged_pairs(list("aaaaa"), {("a", "a"): 0}) == ["aa", "aa", "a"]
    table = K.byte_symbols()
    assert len(set(table.values())) == 256 and table[33] == "!" and ord(table[0]) == 256


def test_dictionary():
    d = K.Dictionary({"北京": 2.0, "北京大学": 3.0, "大学": 1.0})
    assert d.matches("在北京大学") == [(1, 3, "北京"), (1, 5, "北京大学"), (3, 5, "大学")]
    assert d.segments("在北京大学") == ["北京大学"] and K.Dictionary({}).segments("x") == []
    assert K.vocabulary_ids("The (cat) sat.", {"cat": 1, "sat": 2}, frozenset({"the"})) == [1, 2]
    assert K.joined_phrases(["New", "York", "is"], frozenset({"new_york"})) == ["new_york", "is"]
    assert K.forced_spans(["看《", "红楼", "梦》"]) == ["看《", "红楼梦", "》"]
    assert K.aligned_answer("steve smith", "Steve  Smith's") == "Steve  Smith"
    assert K.expanded_templates("<a|b> x <c|d> <e>") == ["a x c <e>", "a x d <e>", "b x c <e>", "b x d <e>"]


def test_markup(spark):
    text = "{{box|{{in}}}}'''Bold''' [[alpha beta|Alpha]] and [[gamma]].<ref>x</ref> [[File:a.jpg|thumb|A [[cap|caption]]]] &amp; [[Category:Things|x]]\n== Head ==\n"
    article, links = W.plain_links(W.clean(text))
    assert article.startswith("Bold Alpha and Gamma.") and "&" in article and "caption" in article and "box" not in article
    assert all(article[x["begin"] : x["end"]] == x["text"] for x in links) and links[0]["title"] == "Alpha beta"
    assert W.categories(text) == ["Things"] and [s[0] for s in W.sections(text)] == ["== Head =="]
    assert W.without_balanced("a {{b", "{{", "}}") == "a {{b" and W.unescape("&#x41;&nosuch;") == "A&nosuch;"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "id int, text string")
    assert sorted(r["id"] for r in W.read_pages(df, "id", "text").collect()) == [1, 2]


def test_readers(spark, tmp_path):
    def put(name, text):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True, parents=True)
        p.write_text(text, encoding="utf-8")
        return str(p)

    n, df = readers.df_file(spark, put("df", "10\n1\tcat\t3\nbad\n2\tdog\t4\n"))
    assert n == 10 and sorted(map(tuple, df.collect())) == [(1, "cat", 3), (2, "dog", 4)]
    assert [tuple(r) for r in readers.index_file(spark, put("ix", "7\t0\t16\n8\t16\t8\n")).orderBy("word_id").collect()] == [(7, 0, 16), (8, 16, 8)]
    sts = readers.sts_pairs(spark, put("sts", "a\tb\tc\td\t2.5\tone\ttwo\nshort\n")).collect()
    assert [(r["s1"], r["s2"], r["score"]) for r in sts] == [("one", "two", 0.5)]
    nli = readers.parallel_lines(spark, put("s1", "a\nb"), put("s2", "c\nd"), put("lab", "x\ny"))
    assert sorted((r["s1"], r["s2"], r["label"]) for r in nli.collect()) == [("a", "c", "x"), ("b", "d", "y")]
    assert readers.triplets(spark, put("tr", "h\th\th\na\tp\tn\n"), header=True).select("anchor", "positive", "negative").collect()[0] == ("a", "p", "n")
    ls = readers.label_sentences(spark, put("ls", "b\tone\na\ttwo\nb\tthree\n")).orderBy("line_no").collect()
    assert [r["label_id"] for r in ls] == [0, 1, 0]
    blocks = readers.corpus_documents(spark, put("corpus", "a\nb\n\nc\n")).orderBy("block").collect()
    assert [r["lines"] for r in blocks] == [["a", "b"], ["c"]]
    wv = readers.word_vectors(spark, put("vec", "x 1 2\ny 3\nz 4 5\n")).orderBy("line_no").collect()
    assert [(r["word"], r["vector"]) for r in wv] == [("x", [1.0, 2.0]), ("z", [4.0, 5.0])]
    assert [r["id"] for r in readers.vocabulary(spark, put("vocab", "\n".join(VOCABULARY))).orderBy("id").collect()] == list(range(13))
    xml = put("w.xml", "<m><page><id>1</id><ns>0</ns><title>A</title><revision><text>{{disambig}} x</text></revision></page><page><id>2</id><ns>4</ns><title>B</title></page><page><id>3</id><ns>0</ns><title>C</title><redirect title='A'/><revision><text>y</text></revision></page></m>")
    pages = {r["id"]: r for r in readers.span_pages(spark, xml).collect()}
    assert set(pages) == {1, 3} and pages[1]["disambiguation"] and pages[3]["redirect"] == "A"
    tab = spark.createDataFrame([("r\tm1\tBonn\td1:3-6\tNIL01\tGPE\tNAM\t1.0",), ("bad",)], "value string")
    m = readers.tab_mentions(tab).collect()
    assert len(m) == 1 and m[0]["kbid"] is None and m[0]["end"] - m[0]["begin"] == len("Bonn")
    dump = spark.createDataFrame([("INSERT INTO `page` VALUES (1,0,'A_b',0),(2,4,'C',1);",)], "value string")
    assert sorted(map(tuple, readers.page_dump_tuples(dump).collect())) == [(1, 0, "A_b"), (2, 4, "C")]
    core = put("core.json", '{"docid": "d", "sentences": [{"entitymentions": [{"text": "x", "ner": "CITY", "characterOffsetBegin": 1, "characterOffsetEnd": 2}, {"text": "y", "ner": "DATE"}]}]}')
    assert [tuple(r) for r in readers.parsed_entities(spark, core, {"CITY": "GPE"}).collect()] == [("d", 1, 2, "x", "GPE")]
    graph = put("graph.json", '{"intents": [{"id": "a", "name": "1"}, {"id": "a", "name": "2"}, {"id": "b", "name": "3"}]}')
    assert sorted(map(tuple, readers.dialog_graph(spark, graph, "intents", "struct<id:string,name:string>").collect())) == [("a", "1"), ("b", "3")]
    put("c1/x.json", '{"v": 1}'), put("c1/y.json", '{"v": 2}'), put("c2/x.json", '{"w": 1}')
    assert [r["v"] for r in readers.crawled_pairs(spark, str(tmp_path / "c1"), str(tmp_path / "c2")).collect()] == [1]
    assert readers.files(spark, str(tmp_path), r".*\.json$").count() == 5
    swag = put("swag.csv", ",v,f,s1,ctx,start,x,e0,e1,e2,e3,label\n0,id1,f,s,c,t,x,a,b,c,d,2\n")
    r = readers.choice_examples(spark, swag).collect()[0]
    assert r["endings"] == ["a", "b", "c", "d"] and r["label"] == 2
    roc = put("roc.csv", "id,a,b,c,d,e1,e2,y\n1,w,x,y,z,p,q,2\n")
    assert [tuple(r) for r in readers.story_endings(spark, roc).collect()] == [("w x y z", "p", "q", 1)]


def test_stores(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), (None, 1)], "k string, v int")
    path = str(tmp_path / "store")
    assert stores.append_absent(df, path, "k", "v") == 2 and stores.append_absent(df, path, "k", "v") == 0
    up = stores.upsert(spark.read.parquet(path), spark.createDataFrame([("a", 9)], "k string, v int"), "k")
    assert sorted(map(tuple, up.collect())) == [("a", 9), ("b", 1)]


def test_features_against_loops(spark):
    cases = [(a, b, m) for a in range(6) for b in range(6) for m in range(1, 9)]
    df = spark.createDataFrame(cases, "a int, b int, m int")
    for m in range(1, 9):
        for r in df.where(f"m = {m}").select("a", "b", *[c.alias(n) for n, c in zip("xy", features.truncated_sizes(F.col("a"), F.col("b"), m))]).collect():
            a, b = r["a"], r["b"]
            while a + b > m:
                if a > b:
                    a -= 1
                else:
                    b -= 1
            assert (a, b) == (r["x"], r["y"])
    t = spark.createDataFrame([([1, 2, 3, 4, 5], [6, 7])], "a array<int>, b array<int>")
    r = t.select(*[c.alias(n) for n, c in features.pair_features(F.col("a"), F.col("b"), 12).items()]).first()
    assert r["input_ids"] == [101, 1, 2, 3, 4, 5, 102, 6, 7, 102, 0, 0] and r["segment_ids"] == [0] * 7 + [1] * 3 + [0] * 2
    assert spark.range(1).select(features.packed_chunks(F.array(*[F.lit(x).cast("bigint") for x in (3, 4, 5, 1)]), 6).alias("c")).first()["c"] == [0, 0, 1, 1]
    assert spark.range(1).select(features.char_to_word(F.lit(" ab  c")).alias("m")).first()["m"] == [-1, 0, 0, 0, 0, 1]
    for kind, want in (("linear", [0.0, 0.5, 1.0, 0.75, 0.5, 0.25]), ("warmup", [0.0, 0.5, 1.0, 1.0, 1.0, 1.0])):
        assert [r["f"] for r in spark.range(6).orderBy("id").select(features.learning_rate(F.col("id"), kind, 2, 6).alias("f")).collect()] == want


def test_masks_are_stable(spark):
    rows = [(d, i, f"w{i}") for d in ("a", "b") for i in range(40)]
    df = spark.createDataFrame(rows, "d string, i int, w string")
    a = sorted(map(tuple, features.masked(df, "d", "i", "w").collect()))
    assert a == sorted(map(tuple, features.masked(df.repartition(3), "d", "i", "w").collect()))
    assert sum(r[3] is not None for r in a) == 12


def test_vectors_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(64, 6))
    x[7] = x[8]
    label = rng.integers(0, 4, 64)
    df = spark.createDataFrame([(i, int(label[i]), x[i].tolist(), 0) for i in range(64)], "vec_id long, label int, v array<double>, batch int")
    p = vectors.batch_pairs(df, "vec_id", "batch", "v", "label")
    want = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    got = np.zeros((64, 64))
    for r in p.collect():
        got[r["a"], r["b"]] = r["distance"]
    assert np.allclose(got, want) and (got >= 0).all()
    hard = np.mean([max(0, max([want[i, j] for j in range(64) if j != i and label[j] == label[i]], default=0) - min(want[i, j] for j in range(64) if label[j] != label[i]) + 5) for i in range(64)])
    assert np.isclose(vectors.batch_hard_loss(p).first()["loss"], hard)
    cos = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
    near = {(r["query"], r["rank"]): r["cosine"] for r in vectors.nearest(df.where("vec_id % 20 = 0"), df, "vec_id", "v", 5).collect()}
    assert all(np.isclose(near[q, k + 1], np.sort(cos[q])[::-1][k]) for q in (0, 20, 40, 60) for k in range(5))
    assert vectors.nearest(df.limit(0), df, "vec_id", "v", 5).collect() == []


def test_edges(spark):
    t = spark.createDataFrame([("a", "x", 1), ("a", "y", 1), ("b", "x", 2)], "k string, l string, i int")
    assert {(r["k"], r["l"]) for r in linking.majority(t, "k", "l").collect()} == {("b", "x")}
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "subj string, obj string")
    seeds = spark.createDataFrame([("a",), ("a",)], "node string")
    assert {(r["node"], r["depth"]) for r in linking.breadth_first(seeds, edges, 5).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    tags = spark.createDataFrame([("d", i, w, g) for i, (w, g) in enumerate([("New", "B-L"), ("York", "I-L"), ("is", "O"), ("Bonn", "S-L"), ("x", None), ("y", "I-P")])], "d string, i int, w string, g string")
    assert sorted((r["begin"], r["end"], r["etype"], r["text"]) for r in linking.bio_mentions(tags, "d", "i", "w", "g").collect()) == [(0, 2, "L", "New York"), (3, 4, "L", "Bonn"), (5, 6, "P", "y")]
    s = metrics.answer_scores(spark.createDataFrame([("The Cat", "cat"), ("a b", "b c"), ("", ""), ("x", None)], "g string, p string"), "g", "p").collect()
    assert [(r["exact"], round(r["f1"], 3)) for r in s] == [(1, 1.0), (0, 0.667), (1, 1.0), (0, 0.0)]


def test_constraints_without_entities(spark):
    from textloom.operators import index

    ddl = "constraint_id long, source string, category string, entity_list array<string>, topic_category array<string>, days_ago int, entity_number int, sentence_length_max int, sentence_length_min int, sentence_position int"
    none = [None] * 9
    set_at = lambda **kw: [kw.get(c.split()[0]) for c in ddl.split(", ")[1:]]
    asked = [(1, *set_at(source="a")), (2, *set_at(category="c", sentence_position=1)), (3, *set_at(topic_category=["t", "u"])), (4, *set_at(days_ago=1)), (5, *set_at(sentence_length_min=1, sentence_length_max=5)), (6, *set_at(sentence_position=1)), (7, *none), (8, *set_at(sentence_length_max=5)), (9, *set_at(entity_list=["x"], source="a")), (10, *set_at(source="a", category="d")), (11, *set_at(entity_number=1))]
    rows = [("s1", " A", "c", ["X "], ["t", "u"], 20220712, 1, 4, 1), ("s2", "a", "d", None, ["u"], 20220101, 0, 9, 2), ("s3", None, "c", [], None, None, 0, None, None)]
    s = spark.createDataFrame(rows, "_id string, source string, category string, entity_set array<string>, topic_category array<string>, news_date int, entity_len int, sentence_length int, sentence_position int")
    got = sorted((r["constraint_id"], r["_id"]) for r in index.match_constraints(spark.createDataFrame(asked, ddl), s, 20220712).collect())
    assert got == [(1, "s1"), (1, "s2"), (2, "s1"), (3, "s1"), (3, "s2"), (4, "s1"), (5, "s1"), (6, "s1"), (9, "s1"), (10, "s2"), (11, "s1")]


def test_tightening(spark):
    rows = [("r", f"s{i}", 20220101 + i % 28, 1 + i % 5, 20220101, 5) for i in range(200)]
    got = dialog.tightened(spark.createDataFrame(rows, "r string, s string, d int, p int, since int, upto int"), "r", "d", "p").collect()
    k = next(k for k in range(100) if len([x for x in rows if x[2] >= 20220101 + k and (x[3] <= max(1, 5 - k))]) <= 50)
    assert {g["s"] for g in got} == {x[1] for x in rows if x[2] >= 20220101 + k and x[3] <= max(1, 5 - k)}


def test_tightening_by_entities(spark):
    rng = random.Random(3)
    rows = [("gap", f"s{i}", rng.choice([20220101, 20220104, 20220109]), rng.randrange(1, 4), rng.randrange(6), 20220101, 3, 0) for i in range(300)]
    rows += [("last", f"s{i}", 20220110, 1, rng.randrange(4), 20220108, 2, 1) for i in range(150)]
    rows += [("same", f"s{i}", 20220110, 1, 2, 20220110, 1, 0) for i in range(70)] + [("few", f"s{i}", 20220105, 2, 0, 20220101, 9, 0) for i in range(5)]
    rows += [("r", f"s{i}", 20220101 + rng.randrange(9), rng.randrange(1, 9), rng.randrange(3), 20220101, 8, 0) for i in range(600)]
    today, want = 20220110, set()
    for r in {x[0] for x in rows}:
        own = [x for x in rows if x[0] == r]
        since, upto, least = own[0][5:]
        before = []
        while True:
            now = [x for x in own if x[2] >= since and x[3] <= upto and x[4] >= least]
            if not now:
                now = before
                break
            if len(now) <= 50:
                break
            least += len(now) == len(before)
            before = now
            since += since < today
            upto -= upto > 1
        want |= {x[:2] for x in now}
    df = spark.createDataFrame(rows, "r string, s string, d int, p int, e int, since int, upto int, least int")
    got = [(g["r"], g["s"]) for g in dialog.tightened(df, "r", "d", "p", length="e", today=today).collect()]
    assert sorted(got) == sorted(want)


def test_sessions(spark):
    rows = [("s", 1, "x"), ("s", 2, "y"), ("s", 3, "x"), ("s", 3, "y"), ("s", 4, "x")]
    df = spark.createDataFrame(rows, "c string, t int, e string")
    assert {(r["t"], r["status"]) for r in sessions.entity_status(df, "c", "t", "e").collect()} == {(1, "AllNewEntity"), (2, "AllNewEntity"), (3, "ExistAndNewEntity"), (4, "AllExistEntity")}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.repartition(4).write.parquet(str(source))
    stream = jobs.tumbling(jobs.read_events(spark, str(source)), late="3650 days")
    q = stream.writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    want = {(r["start"], r["event_type"], r["n"]) for r in jobs.tumbling(e).collect()}
    assert {(r["start"], r["event_type"], r["n"]) for r in spark.table("tumbled").collect()} == want

    terms = jobs.read_events(spark, str(source), 1).selectExpr("cast(event_id as string) as _id", "event_type as word")
    for _ in range(2):  # the second run finds nothing new
        jobs.index_stream(terms, str(tmp_path / "index"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "index")).count() == e.select("event_id").distinct().count()

    turns = tmp_path / "turns"
    rows = [(1, 1, ["a"]), (1, 2, ["a", "b"]), (1, 4, ["c"]), (2, 1, None)]
    spark.createDataFrame(rows, "conv_id bigint, turn int, entities array<string>").coalesce(1).write.parquet(str(turns))
    s = spark.readStream.schema("conv_id bigint, turn int, entities array<string>").parquet(str(turns))
    q = jobs.dialog_state(s).writeStream.format("memory").queryName("states").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("states").collect()} == {(1, 1, "AllNewEntity", 1), (1, 2, "ExistAndNewEntity", 2), (1, 4, "out of order", 2), (2, 1, "NoEntity", 0)}


def test_dense_ids_and_scratch(spark):
    from textloom import runtime

    df = spark.createDataFrame([(x,) for x in (5, 3, 9, 1, 7)], "v int").repartition(3)
    got = sorted(map(tuple, runtime.add_dense_ids(df, ["v"], "id", 10).select("v", "id").collect()))
    assert got == [(1, 10), (3, 11), (5, 12), (7, 13), (9, 14)]
    assert runtime.add_dense_ids(df.limit(0), ["v"], "id").collect() == []
    path = runtime._MADE[-1].removeprefix("file://")
    assert os.path.isdir(path)
    runtime.clear_scratch(spark)
    assert not os.path.isdir(path)


def test_dictionary_in_shards(spark, monkeypatch):
    monkeypatch.setattr(K, "SHARD_CHARS", 8)
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(30)})
    texts = ["".join(rng.choice("abc") for _ in range(rng.randrange(0, 40))) for _ in range(25)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string").withColumn("word", F.lit("x"))
    known = spark.createDataFrame([(w, float(len(w))) for w in words] + [(None, 1.0), ("", 1.0)], "word string, weight double")
    want = sorted((k, i, i + len(w), w) for k, t in enumerate(texts) if t for w in words for i in range(len(t)) if t.startswith(w, i))
    assert sorted(tuple(r) for r in K.dictionary_matches(df, "k", "text", known).collect()) == want
    d = K.Dictionary({w: float(len(w)) for w in words})
    got = {r["k"]: r["pieces"] for r in K.weighted_segments(df, "k", "text", known).collect()}
    assert got == {k: None if t is None else d.segments(t) for k, t in enumerate(texts)}
    assert K.dictionary_matches(df, "k", "text", known.limit(0)).collect() == []


def test_running_sums_and_lines(spark, tmp_path):
    from textloom.runtime import add_running_sum

    rows = [(i % 7, i, float(i) if i % 5 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "a int, b int, x double")
    total, want = 0.0, []
    for a, b, x in sorted(rows):
        total += x or 0.0
        want.append((a, b, total))
    assert sorted(tuple(r) for r in add_running_sum(df, ["a", "b"], {"x": "upto"}).select("a", "b", "upto").collect()) == want
    assert add_running_sum(df.limit(0), ["a"], {"x": "upto"}).collect() == []
    lines = [f"line {i} " + "x" * (i % 50) for i in range(3000)]
    (tmp_path / "t.txt").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        got = readers.numbered_lines(spark, str(tmp_path / "t.txt")).orderBy("line_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r["line_no"], r["line"]) for r in got] == list(enumerate(lines))


def test_choice_and_span_features(spark):
    from textloom.operators import features as X

    df = spark.createDataFrame([(1, list("abcdefgh"), ["s"], [["e"], None, ["e", "f", "g"]]), (2, None, None, [["x"]]), (3, ["a"], ["b"], None)], "k int, c array<string>, s array<string>, e array<array<string>>")
    got = {(r["k"], r["choice"]): r for r in X.choice_features(df, "k", "c", "s", "e", 10).collect()}
    assert set(got) == {(1, 0), (1, 2), (2, 0)}
    assert got[1, 0]["tokens"] == ["[CLS]", *"abcde", "[SEP]", "s", "e", "[SEP]"] and got[1, 0]["segment_ids"] == [0] * 7 + [1] * 3
    assert got[1, 2]["tokens"] == ["[CLS]", *"abcd", "[SEP]", "s", "e", "f", "[SEP]"]
    assert got[2, 0]["tokens"] == ["[CLS]", "[SEP]", "x", "[SEP]"] and got[2, 0]["input_mask"] == [1] * 4 + [0] * 6
    df = spark.createDataFrame([(1, ["q", "r"], list("abcdefghij"), 4, 5), (2, None, list("abc"), None, None), (3, ["q"], [], 0, 0)], "k int, q array<string>, d array<string>, f int, l int")
    rows = sorted(X.span_features(df, "k", "q", "d", "f", "l", 10, 3, 8).collect(), key=lambda r: (r["k"], r["span"]))
    assert [(r["k"], r["start"], r["begin_at"], r["end_at"]) for r in rows] == [(1, 0, 0, 0), (1, 3, 5, 6), (1, 6, 0, 0), (2, 0, 0, 0)]
    assert rows[1]["tokens"] == ["[CLS]", "q", "r", "[SEP]", *"defgh", "[SEP]"] and rows[1]["p_mask"] == [0, 1, 1, 1, 0, 0, 0, 0, 0, 1]


def test_nearest_in_slices(spark, monkeypatch):
    import numpy as np

    from textloom.operators import vectors as V

    monkeypatch.setattr(V, "SLICE", 40)
    x = np.random.default_rng(3).normal(size=(200, 8))
    x[7] = x[9]
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(200)] + [(900, None)], "k long, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = set()
    for q in range(0, 200, 20):
        s = np.round(u @ u[q], 6)
        want |= {(q, int(j), r + 1) for r, j in enumerate(sorted(range(200), key=lambda j: (-s[j], j))[:5])}
    got = {(r["query"], r["k"], r["rank"]) for r in V.nearest(df.where("k % 20 = 0"), df, "k", "v").collect()}
    assert got == want
    plan = V.nearest(df, df, "k", "v")._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
