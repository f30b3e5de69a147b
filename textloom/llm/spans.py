"""Long exact spans that stand in more than one document.

1. Anchors. Of every 150 code points that follow each other, the 50-gram with the least hash is an anchor (winnowing), so
   two texts that share such a run share its anchor at the same place in it.
2. Anchors whose hash stands in two or more documents are the candidate phrases; least and greatest document per hash
   tell, combined before the shuffle.
3. The confirmed phrases, each once, form one table, cut into shards of about ``SHARD_CHARS`` characters by the least document
   that holds them, so that the phrases of one passage share a shard. Each shard is compiled into an Aho-Corasick automaton,
   and all documents with a phrase of the shard are streamed through it: every occurrence of every phrase is found, letter
   by letter, whether it is an anchor there or not. A shard of many documents is compiled in several tasks of ``SHARD_DOCS``.
4. An occurrence has a context: the up to 250 code points in which a run of 150 with this phrase as its anchor can lie.
   Documents with the same context share a run outright. Where a phrase has several contexts, those 150-grams of each
   context are compared whose anchor the phrase is; contexts are few, as equal ones count once.
5. Documents that share one run form a class; classes of equal documents are kept once. Pairs come from the classes, in
   blocks, so that a class of any size is spread over tasks.

Runs and contexts are compared by 64-bit fingerprints of their text within one phrase, itself known by 64 bits: 128 in
all. Defined cases: null, empty and shorter texts share nothing; a
run repeated only inside one document isn't shared; copies of a text share all of it; a null document id is no
document; an empty table gives no rows (a report row of 0 for a document that shares nothing).
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.groups import block_pairs
from textloom.runtime import materialize

RUN = 150
GRAM = 50
SIDE = RUN - GRAM
#: Characters of text hashed at once, characters of phrases in one automaton, documents streamed through it in one task.
CHUNK = 1_000_000
SHARD_CHARS = 1_000_000
SHARD_DOCS = 5_000

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """Rolling hashes of all k-grams of code points, modulo 2^64, mixed; a gram's hash depends on its letters alone."""
    n = len(points)
    if n < k:
        return np.zeros(0, np.uint64)
    up = np.full(n, _BASE)
    up[0] = 1
    up = np.cumprod(up)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_mix(points.astype(np.uint64) + np.uint64(0x1234567)) * up, out=sums[1:])
    down = np.full(n - k + 1, _INVERSE)
    down[0] = 1
    return _mix((sums[k:] - sums[:-k]) * np.cumprod(down))


def _window(h: np.ndarray, w: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) over each w neighbours."""
    width = 1
    while width * 2 <= w:
        h = best(h[:-width], h[width:])
        width *= 2
    rest = w - width
    return best(h[:-rest], h[rest:]) if rest else h


def anchors(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of one text's anchors: each least 50-gram of some 150 code points, all of equal ones."""
    w = RUN - GRAM + 1
    h = gram_hashes(points, GRAM)
    if len(h) < w:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = _window(h, w, np.minimum)
    pad = np.zeros(w - 1, np.uint64)
    at = np.flatnonzero(_window(np.concatenate((pad, least, pad)), w, np.maximum) == h)
    return at, h[at]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _pieces(points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Overlapping pieces of long texts, such that each 150 code points lie in one."""
    a = 0
    while True:
        yield a, points[a : a + CHUNK + RUN - 1]
        a += CHUNK
        if a + RUN > len(points):
            return


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(1)
        ids = b.column(0).to_numpy()
        hold: list[tuple[np.ndarray, ...]] = []
        size = 0
        for i in range(b.num_rows):
            text = texts[i].as_py()
            if len(text) < RUN:
                continue
            for start, piece in _pieces(code_points(text)):
                at, h = anchors(piece)
                hold.append((np.full(len(at), ids[i]), at + start, h.view(np.int64)))
                size += len(at)
            if size > 100_000:
                yield _rows(hold)
                hold, size = [], 0
        if hold:
            yield _rows(hold)


def _rows(hold: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    cols = [np.concatenate(c) for c in zip(*hold)]
    return pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1].astype(np.int32)), pa.array(cols[2])], names=["doc_id", "at", "gram"])


def _long(text: str, seed: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), seed) - (1 << 63)


def _routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows shard, doc_id, text: each phrase of its home document (without doc_id), and each document once per shard it has phrases of."""
    kinds = [pa.int32(), pa.int64(), pa.string()]
    for b in batches:
        out: list[tuple] = []
        size = 0
        for doc, text, routes, homes in zip(*(b.column(k) for k in range(4))):
            t, doc = text.as_py(), doc.as_py()
            out.extend((h["shard"], None, t[h["at"] : h["at"] + GRAM]) for h in homes.as_py() or ())
            for shard in routes.as_py():
                out.append((shard, doc, t))
                size += len(t)
                if size > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["shard", "doc_id", "text"])
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["shard", "doc_id", "text"])


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream documents through the automata of their shards; rows come by shard and part, phrases (no doc_id) first.

    Rows doc_id, at, phrase, context (hashes), lead (characters of the context before the phrase), size (of the context), text (its characters, once per automaton).
    """
    names = ["doc_id", "at", "phrase", "context", "lead", "size", "text"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()]
    out: list[tuple] = []
    told: set[tuple[int, int]] = set()
    group, auto, ready = None, ahocorasick.Automaton(), False
    for b in batches:
        for shard, part, doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
            text = text.as_py()
            if group != (shard, part):
                group, auto, ready = (shard, part), ahocorasick.Automaton(), False
                told.clear()
            if doc is None:
                auto.add_word(text, _long(text))
                continue
            if not ready:
                auto.make_automaton()
                ready = True
            for end, phrase in auto.iter(text):
                a = end + 1 - GRAM
                lo = max(0, a - SIDE)
                own = text[lo : a + RUN]
                if len(own) < RUN:
                    continue
                lead = a - lo
                context = _long(own, lead + 1)
                out.append((doc, a, phrase, context, lead, len(own), None if (phrase, context) in told else own))
                told.add((phrase, context))
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)


def _context_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The 150-grams of contexts whose anchor the phrase is: phrase, context, j (place in the context), run (hash)."""
    w = RUN - GRAM + 1
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64())
    for b in batches:
        rows: list[tuple[int, int, int, int]] = []
        for phrase, context, lead, text in zip(*(c.to_pylist() for c in b.columns)):
            h = gram_hashes(code_points(text), GRAM)
            own = np.flatnonzero(_window(h, w, np.minimum) == h[lead]).tolist()
            rows.extend((phrase, context, j, _long(text[j : j + RUN])) for j in own)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=["phrase", "context", "j", "run"])


def occurrences(docs: DataFrame) -> DataFrame:
    """Every occurrence of every recurring phrase (step 1 to 3), written once. ``docs``: doc_id, text."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(f"doc_id is not null and length(text) >= {RUN}")
    grams = materialize(docs.mapInArrow(_anchor_rows, "doc_id bigint, at int, gram bigint"), "anchors")
    least = F.min(F.struct("doc_id", "at")).alias("home")
    phrases = grams.groupBy("gram").agg(least, F.max("doc_id").alias("most")).where("home.doc_id < most").select("gram", "home.doc_id", "home.at")
    phrases = materialize(phrases, "phrases")
    shards = max(1, -(-phrases.count() * GRAM // SHARD_CHARS))
    phrases = phrases.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))
    routes = grams.select("doc_id", "gram").join(phrases.select("gram", "shard"), "gram").groupBy("doc_id").agg(F.collect_set("shard").alias("routes"))
    homes = phrases.groupBy("doc_id").agg(F.collect_list(F.struct("shard", "at")).alias("homes"))
    routes = materialize(routes.join(homes, "doc_id", "left"), "routes")
    parts = routes.select(F.explode("routes").alias("shard")).groupBy("shard").agg(F.ceil(F.count("*") / SHARD_DOCS).cast("int").alias("parts"))
    rows = docs.join(routes, "doc_id").select("doc_id", "text", "routes", "homes").mapInArrow(_routed, "shard int, doc_id bigint, text string").join(parts, "shard")
    part = F.when(F.col("doc_id").isNull(), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc_id"), "parts").cast("int")))
    rows = rows.select("shard", F.explode(part).alias("part"), "doc_id", "text")
    rows = rows.repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("doc_id").asc_nulls_first())
    found = rows.mapInArrow(_occurrences, "doc_id bigint, at int, phrase bigint, context bigint, lead int, size int, text string")
    return materialize(found, "occurrences")


def shared_runs(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes of contexts and what is shared of each context (step 4).

    First: phrase, cls, context: contexts of one (phrase, cls) hold one same run of 150. Second: phrase, context, begin,
    end (code points of the context that another document holds too).
    """
    each = found.groupBy("phrase", "context", "size").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    each = materialize(each, "contexts")
    several = each.groupBy("phrase").agg(F.count("*").alias("n")).where("n > 1").select("phrase")
    texts = found.where("text is not null").select("phrase", "context", "lead", "text")
    mixed = texts.join(several, "phrase", "left_semi").dropDuplicates(["phrase", "context"])
    grams = materialize(mixed.mapInArrow(_context_grams, "phrase bigint, context bigint, j int, run bigint"), "runs")
    ends = each.select("phrase", "context", "a", "b")
    runs = grams.join(ends, ["phrase", "context"]).groupBy("phrase", "run").agg(
        F.min("a").alias("least"), F.max("b").alias("most"), F.min("context").alias("c0"), F.max("context").alias("c1"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("context")).alias("sig")
    )
    runs = materialize(runs.where("least < most").select("phrase", "run", "n", "sig", (F.col("c0") != F.col("c1")).alias("across")), "shared")
    # neighbouring runs mostly join the same contexts: one of each set is enough for the classes
    one = runs.where("across").groupBy("phrase", "n", "sig").agg(F.min("run").alias("run"))
    classes = grams.join(one.select("phrase", "run"), ["phrase", "run"], "left_semi").select("phrase", F.col("run").alias("cls"), "context").distinct()
    same = each.where("a < b")
    classes = classes.unionByName(same.select("phrase", F.col("context").alias("cls"), "context"))
    whole = same.select("phrase", "context", F.lit(0).alias("begin"), F.col("size").alias("end"))
    parts = grams.join(runs.select("phrase", "run"), ["phrase", "run"], "left_semi").select("phrase", "context", F.col("j").alias("begin"), (F.col("j") + RUN).alias("end"))
    return classes, whole.unionByName(parts)


def shared_classes(docs: DataFrame) -> DataFrame:
    """phrase, cls, doc_id, n: the documents of every set that holds one same run, each set once; n: how many they are.

    All pairs that share a run are pairs of some set, so this says the same as ``shared_pairs`` in a row per member.
    """
    found = occurrences(docs)
    classes, _ = shared_runs(found)
    held = found.select("phrase", "context", "doc_id").distinct()
    member = materialize(classes.join(held, ["phrase", "context"]).select("phrase", "cls", "doc_id").distinct(), "members")
    size = member.groupBy("phrase", "cls").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("doc_id")).alias("x"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("y")).where("n > 1")
    once = size.groupBy("n", "x", "y").agg(F.min(F.struct("phrase", "cls")).alias("k"))  # one class of each set of documents
    return member.join(once.select("k.phrase", "k.cls", "n"), ["phrase", "cls"])


def shared_pairs(docs: DataFrame) -> DataFrame:
    """doc_id_a < doc_id_b of every two documents that hold one same run of at least 150 code points."""
    return block_pairs(materialize(shared_classes(docs).drop("n"), "classes"), ["phrase", "cls"], "doc_id").distinct()


def shared_amount(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, shared_chars, shared_part: how many of a document's code points lie in runs that another document holds."""
    found = occurrences(docs)
    _, parts = shared_runs(found)
    spans = found.select("doc_id", "at", "lead", "phrase", "context").join(parts, ["phrase", "context"])
    spans = spans.select("doc_id", (F.col("at") - F.col("lead") + F.col("begin")).alias("b"), (F.col("at") - F.col("lead") + F.col("end")).alias("e")).distinct()
    # islands: a span that begins behind all earlier ends begins a new stretch
    w = Window.partitionBy("doc_id").orderBy("b", "e").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("e").over(w), F.col("b"))
    own = spans.withColumn("new", F.greatest(F.col("e") - F.greatest(F.col("b"), reach), F.lit(0)))
    per = own.groupBy("doc_id").agg(F.sum("new").alias("shared_chars"))
    base = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"))
    out = base.join(per, "doc_id", "left").fillna(0, ["shared_chars"])
    return out.withColumn("shared_part", F.coalesce(F.try_divide("shared_chars", "n_chars"), F.lit(0.0)))
