"""Variant spellings of persons' and organisations' names, linked to one entity.

1. A name becomes a key: folded (NFKC, case, diacritics, traditional characters), titles and empty words left out, known
   short forms and nicknames spelled out, its words as an unordered set. Han names lose their separators.
2. Distinct keys become weighted character n-gram vectors over the whole name. A sparse cosine join finds all pairs above
   ``COSINE`` (prefix filter: rare n-grams first, until what is left can't reach the bound; n-grams of many keys are met in
   blocks), so it needs no top-n cap. A pair counts as a link if its words can be matched with one typing error each, so keys
   are joined within classes: words one typing error apart, found by what is left of them without one letter, get one label
   with all that hang together, and a class has the same labels. What is alone in its class is in no vector or pair.
3. Links are grouped by average linkage of all typed records (a key weighs as often as it was typed; pairs without a link
   count 0), so the spelling most people typed holds its misspellings together and two houses two letters apart stay apart.
4. Names with an initial are keys of their own kind: they are held against the initials of the groups' spellings in the same
   way, and belong to a group if it is the only one they fit. Those that fit several groups mean none for certain.

Defined cases: null keys and null and blank names link to nothing; a key's repeated rows count once; equal names under
different keys link, whatever they are, but for an initial that fits several groups; an empty table gives no rows.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.groups import block_pairs, components
from textloom.runtime import add_dense_ids, materialize

COSINE = 0.4
LINKAGE = 0.2
#: Largest component linked in one task; larger ones are linked in rounds over all tasks, with the same result.
COMPONENT = 300
#: Keys of one n-gram that meet in one task.
GRAM_BLOCK = 400
#: The nickname table is sent to all tasks; a larger one is refused.
NICKNAMES = 100_000

# Traditional characters of transliterated names, and the simplified ones in the same order.
_TRADITIONAL = "亞傑凱喬烏貝瑪納薩馬達聲學鐘錶紡織電廠樂絲維頓奧蓮內倫爾瑟蘭萊羅盧魯韋衛謝歐畢賓賽費詹諾賴鄧鮑麗龍龐錫戴莊華賈農葉楊陳張許趙盧邁邊遜關韓顏馮魏鄭齊區國語書場門東長開車製產業會團體銀無機資訊遠際興義協聯醫藥藝術歷來親單圖夢寶島師幣廣慶應憲戰於時氣漢漁潔燈獎瓊"
_SIMPLIFIED = "亚杰凯乔乌贝玛纳萨马达声学钟表纺织电厂乐丝维顿奥莲内伦尔瑟兰莱罗卢鲁韦卫谢欧毕宾赛费詹诺赖邓鲍丽龙庞锡戴庄华贾农叶杨陈张许赵卢迈边逊关韩颜冯魏郑齐区国语书场门东长开车制产业会团体银无机资讯远际兴义协联医药艺术历来亲单图梦宝岛师币广庆应宪战于时气汉渔洁灯奖琼"
_SIMPLE = str.maketrans(_TRADITIONAL, _SIMPLIFIED)
# Titles before names, descriptions behind them, and words that carry no meaning in a body's name.
_TITLES = frozenset("dr prof professor sir dame lord lady mr mrs ms miss rev hon jr sr".split())
_NOTES = regex.compile(r"\((?:actor|actress|musician|singer|athlete|organi[sz]ation|company|person|politician|writer|footballer|disambiguation)\)")
_EMPTY = frozenset("the of and & limited ltd inc".split())
# Short forms in names of bodies, and the words that tell a body.
_FORMS = {"co": "company", "corp": "company", "inst": "institute", "univ": "university", "u": "university", "fc": "club", "st": "studio", "films": "film", "studios": "studio", "football": "club"}
_BODIES = frozenset("company institute university club studio sons".split())
_HAN_FORMS = (("有限公司", "有限公司"), ("公司", "有限公司"), ("研究院", "研究所"), ("研究所", "研究所"), ("所", "研究所"), ("大学", "大学"), ("大", "大学"), ("足球俱乐部", "足球俱乐部"), ("俱乐部", "足球俱乐部"), ("电影制片厂", "电影制片厂"), ("制片厂", "电影制片厂"))

_SPACE = regex.compile(r"[\s_]+")
_HAN = regex.compile(r"\p{Han}")
_TOKEN = regex.compile(r"[\p{L}\p{M}\p{N}'’-]+|&")


def fold(name: str) -> str:
    """NFKC, lower case, no diacritics, simplified characters, single blanks."""
    t = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", name).lower())
    t = unicodedata.normalize("NFC", "".join(c for c in t if not unicodedata.combining(c))).translate(_SIMPLE)
    return _SPACE.sub(" ", t).strip()


def typing_errors(a: str, b: str, most: int) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours between two words; ``most`` + 1 if more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            v = min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d))
            if before is not None and i > 1 and j > 1 and c == b[j - 2] and a[i - 2] == d:
                v = min(v, before[j - 2] + 1)
            new.append(v)
        before, row = row, new
        if min(row) > most:
            return most + 1
    return row[-1]


def name_errors(a: str, b: str) -> int:
    """Typing errors between two keys; 9 if some word has more than one.

    Words are matched one to one, those of fewer than four letters must be equal. Keys in Han characters (four at least)
    may differ in one character.
    """
    if a == b:
        return 0
    if _HAN.search(a) or _HAN.search(b):
        wrong = sum(x != y for x, y in zip(a, b)) if len(a) == len(b) >= 4 else 9
        return wrong if wrong <= 1 else 9
    x, y = a.split(" "), b.split(" ")
    if len(x) != len(y):
        return 9
    only, left = ([*(Counter(s) - Counter(t)).elements()] for s, t in ((x, y), (y, x)))
    errors = 0
    for w in only:
        near = [v for v in left if min(len(w), len(v)) >= 4 and typing_errors(w, v, 1) <= 1]
        if not near:
            return 9
        left.remove(near[0])
        errors += 1
    return errors


def _words(t: str, nick: dict[str, str]) -> tuple[str, str]:
    t = regex.sub(r"\bf\.\s?c\.?(?!\w)", "fc", _NOTES.sub(" ", t))
    words = [w for w in _TOKEN.findall(t) if w not in _TITLES] or _TOKEN.findall(t)
    forms = [_FORMS.get(w, w) if w != "u" or "of" in words else w for w in words]  # alone it is an initial
    body = len(words) > 1 and any(w in _BODIES for w in forms) and any(len(w) > 1 for w in words if w not in _FORMS)
    if body:
        kept = {w for w in forms if w not in _EMPTY}
        return "b", " ".join(sorted(kept or set(forms)))
    full = [nick.get(w, w) for w in words if len(w) > 1]
    short = [w for w in words if len(w) == 1]
    if len(full) == 1 and short:
        return "i", f"{short[0]} {full[0]}"
    return "p", " ".join(sorted(full or short))


def _han(t: str) -> tuple[str, str]:
    t = _NOTES.sub(" ", t)
    turned = regex.fullmatch(r"\s*(\p{Han}+)\s*[,、]\s*(\p{Han}+)\s*", t)
    key = turned.group(2) + turned.group(1) if turned else "".join(c for c in t if c.isalnum())
    for form, means in _HAN_FORMS:
        if key.endswith(form) and len(key) > len(form) + 1:
            return "b", key[: -len(form)] + means
    return "p", key


def name_key(name: str, nick: dict[str, str]) -> tuple[str | None, str | None]:
    """(kind, key) of a name: 'b' body, 'i' initial and one word, 'p' any other; Nones for a blank name."""
    t = fold(name).replace("，", ",").replace("（", "(").replace("）", ")")
    if not t:
        return None, None
    kind, key = _han(t) if _HAN.search(t) else _words(t, nick)
    return (kind, key) if key else ("p", t)


def _keys(nick: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [name_key(n, nick) for n in b.column(1).to_pylist()]
            cols = [pa.array(c, pa.string()) for c in zip(*got)] if got else [pa.array([], pa.string())] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["key", "kind", "word"])

    return run


def typed_names(kg: DataFrame, pages: DataFrame) -> DataFrame:
    """key, name of crawled names and of pages of namespace 0, distinct."""
    a = kg.select(F.col("kbid").alias("key"), "name")
    title = F.translate("page_title", "_", " ")
    b = pages.where("page_namespace = 0 and page_id is not null").select(F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("key"), title.alias("name"))
    return a.unionByName(b).where("key is not null and name is not null").distinct()


def nickname_forms(nicknames: DataFrame) -> dict[str, str]:
    """Given name by folded nickname; a nickname of several given names stays as it is."""
    rows = nicknames.where("given is not null and nick is not null").select("given", "nick").distinct().limit(NICKNAMES + 1).collect()
    if len(rows) > NICKNAMES:
        raise ValueError(f"more than {NICKNAMES} nicknames")
    found: dict[str, set[str]] = {}
    for r in rows:
        found.setdefault(fold(r["nick"]), set()).add(fold(r["given"]))
    given = {g for s in found.values() for g in s}
    return {k: min(v) for k, v in found.items() if len(v) == 1 and k not in given}


def grams(word: str) -> list[str]:
    """Padded four-grams of each word of a key; of keys in Han characters single characters and padded pairs.

    Each bears the number of words (of Han characters), as keys of other numbers can't be linked.
    """
    if _HAN.search(word):
        t = f"^{word}$"
        return list(dict.fromkeys(f"{len(word)}{g}" for g in [*word, *(t[i : i + 2] for i in range(len(t) - 1))]))
    words = word.split(" ")
    return list(dict.fromkeys(f"{len(words)}{t[i : i + 4]}" for w in words for t in (f"^^{w}$$",) for i in range(len(t) - 3)))


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(i, g, len(w), 0 if _HAN.search(w) else w.count(" ") + 1) for i, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for g in grams(w)]
        cols = list(zip(*rows)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.int32()))], names=["id", "gram", "size", "slack"])


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each key's words with their number; a key in Han characters counts as one word."""
    for b in batches:
        rows = [(t, f"{n} {w}") for t in b.column(0).to_pylist() for n, words in ((0, [t]) if _HAN.search(t) else (t.count(" ") + 1, t.split(" ")),) for w in words]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)] if rows else [pa.array([], pa.string())] * 2, names=["word", "part"])


def _shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of four letters at least, and what is left of them without one letter; of Han keys with its place, as they differ by substitution alone."""
    for b in batches:
        rows = []
        for part in b.column(0).to_pylist():
            n, _, w = part.partition(" ")
            if len(w) >= 4:
                rows += [(part, f"{n} {i} {w[:i]}{w[i + 1 :]}") for i in range(len(w))] if n == "0" else [(part, x) for x in {part, *(f"{n} {w[:i]}{w[i + 1 :]}" for i in range(len(w)))}]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)] if rows else [pa.array([], pa.string())] * 2, names=["part", "rest"])


def _near_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ok = [name_errors(x.partition(" ")[2], y.partition(" ")[2]) < 9 for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        yield b.filter(pa.array(ok, pa.bool_()))


def key_classes(words: DataFrame) -> DataFrame:
    """word, class of all keys that have others in theirs; keys that ``name_errors`` can match are in one class. ``words``: word, distinct."""
    parts = materialize(words.select("word").mapInArrow(_word_rows, "word string, part string"), "parts")
    # equal hashes of different rests only give pairs more to check
    rests = parts.select("part").distinct().mapInArrow(_shortened, "part string, rest string").select("part", F.xxhash64("rest").alias("rest"))
    met = materialize(rests.withColumn("m", F.count("*").over(Window.partitionBy("rest"))).where("m > 1").select("rest", "part"), "met")
    pairs = met.withColumnRenamed("part", "a").join(met.withColumnRenamed("part", "b"), "rest").where("a < b").select("a", "b").distinct()
    label = components(pairs.mapInArrow(_near_words, "a string, b string")).withColumnRenamed("node", "part")
    # a sum of hashes of 44 bits: the same for the same labels in any order
    labels = parts.join(label, "part", "left").select("word", F.shiftright(F.xxhash64(F.coalesce("component", "part")), 20).alias("label"))
    sums = labels.groupBy("word").agg(F.sum("label").alias("class"))
    return materialize(sums.withColumn("m", F.count("*").over(Window.partitionBy("class"))).where("m > 1").select("word", "class"), "classes")


def cosine_pairs(words: DataFrame, least: float = COSINE, classes: DataFrame | None = None) -> DataFrame:
    """a < b, cosine of all pairs of words (column word, distinct) whose n-gram vectors reach ``least``.

    Pairs that share a prefix n-gram are added up over the prefixes; only those whose sum, with the norms of what is left
    of both, can reach the bound are compared in full. ``classes`` (of ``key_classes``): pairs of one class alone; n-grams
    are weighed by all words all the same.
    """
    n = words.count()
    grams_of = lambda t: t.mapInArrow(_gram_rows, "id bigint, gram string, size int, slack int")
    df = materialize(grams_of(words.select(F.lit(0).cast("bigint").alias("id"), "word")).groupBy("gram").agg(F.count("*").alias("df")), "df")
    kept = words.select("word", F.lit(0).cast("bigint").alias("class")) if classes is None else classes
    ids = materialize(add_dense_ids(kept.select("word", "class"), ["word"], "id"), "ids")
    w = grams_of(ids.select("id", "word")).join(df, "gram").withColumn("w", F.log((F.lit(float(n)) + 1) / F.col("df")) + 0.1)
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    w = w.withColumn("w", F.col("w") / norm)
    left = F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id").orderBy(F.desc("df"), "gram"))
    w = w.withColumn("prefix", left >= least * least)
    rest = F.sqrt(F.sum(F.when(~F.col("prefix"), F.col("w") * F.col("w")).otherwise(0.0)).over(Window.partitionBy("id")))
    vectors = materialize(w.select("id", "gram", "w", "df", "size", "slack", "prefix", rest.alias("rest")), "vectors")
    p = vectors.where("prefix and df > 1").join(ids.select("id", "class"), "id").withColumn("m", F.count("*").over(Window.partitionBy("class", "gram")))
    p = materialize(p.where("m > 1").withColumn("blocks", F.ceil(F.col("m") / GRAM_BLOCK).cast("bigint")), "prefixes")
    side = lambda t, s: t.select("class", "gram", "block", F.col("id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("w", "rest", "size")], *(["slack"] if s == "a" else []))
    x = side(p.withColumn("block", F.pmod(F.xxhash64("id"), "blocks")), "a")
    y = side(p.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))), "b")
    met = x.join(y, ["class", "gram", "block"]).where("a < b")
    if classes is not None:
        met = met.where(F.abs(F.col("size_a") - F.col("size_b")) <= F.col("slack"))
    part = met.groupBy("a", "b").agg(F.sum(F.col("w_a") * F.col("w_b")).alias("part"), F.max(F.col("rest_a") * F.col("rest_b")).alias("rest"))
    pairs = materialize(part.where(F.col("part") + F.col("rest") >= least - 1e-9).select("a", "b"), "pairs")
    va = vectors.select(F.col("id").alias("a"), "gram", F.col("w").alias("wa"))
    vb = vectors.select(F.col("id").alias("b"), "gram", F.col("w").alias("wb"))
    dots = pairs.join(va, "a").join(vb, ["b", "gram"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine")).where(F.col("cosine") >= least)
    name = lambda s: ids.select(F.col("id").alias(s), F.col("word").alias(f"word_{s}"))
    return dots.join(name("a"), "a").join(name("b"), "b").select(F.col("word_a").alias("a"), F.col("word_b").alias("b"), "cosine")


def average_linkage(a: np.ndarray, b: np.ndarray, sim: np.ndarray, weight: np.ndarray, least: float) -> np.ndarray:
    """Cluster numbers: the two clusters of the highest mean similarity of their records are joined while it is at least ``least``; unlinked pairs count 0."""
    n = len(weight)
    s = np.zeros((n, n))
    s[a, b] = s[b, a] = sim
    size = weight.astype(float)
    label = np.arange(n)
    np.fill_diagonal(s, -1.0)
    while n > 1:
        i, j = divmod(int(s.argmax()), n)
        if s[i, j] < least:
            break
        merged = (s[i] * size[i] + s[j] * size[j]) / (size[i] + size[j])
        s[i] = s[:, i] = merged
        s[i, i] = -1.0
        s[j] = s[:, j] = -1.0
        size[i] += size[j]
        label[label == j] = i
    return label


def _link_component(rows: list[tuple]) -> list[tuple[str, str]]:
    """word, cluster of one component's links (component, a, b, cosine, na, nb)."""
    counts = {r[1]: r[4] for r in rows} | {r[2]: r[5] for r in rows}
    words = sorted(counts)
    at = {w: i for i, w in enumerate(words)}
    label = average_linkage(np.array([at[r[1]] for r in rows]), np.array([at[r[2]] for r in rows]), np.array([r[3] for r in rows]), np.array([counts[w] for w in words]), LINKAGE)
    lead = {}
    for w, c in sorted(zip(words, label), key=lambda x: (-counts[x[0]], x[0])):
        lead.setdefault(c, w)
    return [(w, lead[c]) for w, c in zip(words, label)]


def _link_components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by component, each component whole."""
    rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns]))
    out: list[tuple[str, str]] = []
    made = lambda: pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], names=["word", "cluster"])
    for _, own in groupby(rows, key=lambda r: r[0]):
        out += _link_component(list(own))
        if len(out) > 5000:
            yield made()
            out = []
    if out:
        yield made()


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ok = [name_errors(x, y) < 9 for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        yield b.filter(pa.array(ok, pa.bool_()))


def word_clusters(words: DataFrame) -> DataFrame:
    """word, cluster (its most frequent spelling) of all keys that have near spellings; keys without any are left out. ``words``: word, n (how often), distinct."""
    links = cosine_pairs(words, classes=key_classes(words)).mapInArrow(_check, "a string, b string, cosine double")
    links = links.join(words.select(F.col("word").alias("a"), F.col("n").alias("na")), "a").join(words.select(F.col("word").alias("b"), F.col("n").alias("nb")), "b")
    links = materialize(links.select("a", "b", "cosine", "na", "nb"), "links")
    label = components(links)
    sized = label.join(label.groupBy("component").count(), "component")
    edges = materialize(links.join(sized.select(F.col("node").alias("a"), "component", "count"), "a"), "edges")
    small = edges.where(F.col("count") <= COMPONENT).select("component", "a", "b", "cosine", "na", "nb").repartition("component").sortWithinPartitions("component")
    done = small.mapInArrow(_link_components, "word string, cluster string")
    large = edges.where(F.col("count") > COMPONENT).select("a", "b", "cosine", "na", "nb")
    return materialize(done if large.isEmpty() else done.unionByName(_link_large(large)), "clusters")


def linkage_rounds(links: DataFrame, least: float) -> DataFrame:
    """word, n, label: average linkage as ``average_linkage`` does it, for components of any size. ``links``: a, b, cosine, na, nb.

    Only the sums of linked cluster pairs are kept. In each round all pairs of clusters that are each other's nearest are
    joined; as a mean with a third cluster never exceeds the higher of the two before, this gives the clusters of joining
    the nearest pair of all one after the other. Sums are whole numbers, so their order doesn't matter; ties are broken by name.
    """
    s = links.select("a", "b", (F.round(F.col("cosine") * 1e12).cast("decimal(18,0)") * F.col("na") * F.col("nb")).cast("decimal(38,0)").alias("s"))
    sums = materialize(s.select(F.col("a").alias("x"), F.col("b").alias("y"), "s").unionByName(s.select(F.col("b").alias("x"), F.col("a").alias("y"), "s")), "sums")
    nodes = links.select(F.col("a").alias("word"), F.col("na").alias("n")).unionByName(links.select(F.col("b").alias("word"), F.col("nb").alias("n"))).distinct()
    label = materialize(nodes.withColumn("label", F.col("word")), "labels")
    while True:
        size = label.groupBy("label").agg(F.sum("n").alias("n"))
        both = sums.join(size.select(F.col("label").alias("x"), F.col("n").alias("nx")), "x").join(size.select(F.col("label").alias("y"), F.col("n").alias("ny")), "y")
        mean = both.select("x", "y", (F.col("s").cast("double") / 1e12 / (F.col("nx") * F.col("ny"))).alias("m")).where(F.col("m") >= least)
        # one order of all pairs, the same from both sides: the first of all is always joined
        order = F.struct((-F.col("m")).alias("m"), F.least("x", "y").alias("p"), F.greatest("x", "y").alias("q"))
        best = mean.groupBy("x").agg(F.min(order).alias("o")).select("x", "o.p", "o.q")
        joined = materialize(best.groupBy("p", "q").count().where("count = 2").select(F.col("q").alias("old"), F.col("p").alias("new")), "joined")
        if joined.isEmpty():
            return label
        label = materialize(label.join(joined, F.col("label") == F.col("old"), "left").select("word", "n", F.coalesce("new", "label").alias("label")), "labels")
        for c in ("x", "y"):
            sums = sums.join(joined, F.col(c) == F.col("old"), "left").withColumn(c, F.coalesce("new", c)).drop("old", "new")
        sums = materialize(sums.where("x <> y").groupBy("x", "y").agg(F.sum("s").cast("decimal(38,0)").alias("s")), "sums")


def _link_large(links: DataFrame) -> DataFrame:
    """word, cluster of components too large for one task."""
    label = linkage_rounds(links, LINKAGE)
    lead = label.groupBy("label").agg(F.min(F.struct((-F.col("n")).alias("n"), "word")).alias("m")).select("label", F.col("m.word").alias("cluster"))
    return label.join(lead, "label").select("word", "cluster")


def _clustered(keys: DataFrame) -> DataFrame:
    """``keys`` (with word, n) and the cluster of each word, itself if it has no near spellings."""
    return keys.join(word_clusters(keys.select("word", "n")), "word", "left").withColumn("cluster", F.coalesce("cluster", "word"))


def name_groups(names: DataFrame, nicknames: DataFrame) -> DataFrame:
    """key, entity of every name but initials that fit several entities. ``names``: key, name; ``nicknames``: given, nick."""
    keyed = names.where("key is not null and name is not null").select("key", "name").mapInArrow(_keys(nickname_forms(nicknames)), "key string, kind string, word string").where("kind is not null")
    keyed = materialize(keyed.distinct(), "keyed")
    full, short = keyed.where("kind <> 'i'"), keyed.where("kind = 'i'")
    whole = materialize(_clustered(full.groupBy("word").agg(F.count("*").alias("n"), F.min("kind").alias("kind"))), "full")
    # two-word spellings of persons as an initial and a word, either word in full
    two = F.split("word", " ")
    forms = whole.where((F.col("kind") == "p") & (F.size(two) == 2)).select("cluster", "n", F.explode(F.array(*[F.concat(F.substring(two[i], 1, 1), F.lit(" "), two[1 - i]) for i in (0, 1)])).alias("word"))
    forms = materialize(forms.groupBy("word", "cluster").agg(F.sum("n").alias("n")), "forms")
    typed = short.groupBy("word").agg(F.count("*").alias("n"))
    near = materialize(_clustered(typed.unionByName(forms.select("word", "n")).groupBy("word").agg(F.sum("n").alias("n"))).select("word", F.col("cluster").alias("spelling")), "short")
    fits = lambda by, t: t.groupBy(by).agg(F.min("cluster").alias("only"), F.max("cluster").alias("other"))
    by_word = fits("word", forms).toDF("word", "w0", "w1")
    by_spelling = fits("spelling", forms.join(near, "word")).toDF("spelling", "s0", "s1")
    s = near.join(typed.select("word"), "word", "left_semi").join(by_word, "word", "left").join(by_spelling, "spelling", "left")
    s = s.select("word", F.coalesce("w0", "s0", F.concat(F.lit("."), F.col("spelling"))).alias("e0"), F.coalesce("w1", "s1", F.concat(F.lit("."), F.col("spelling"))).alias("e1"))
    of_full = full.join(whole.select("word", "cluster"), "word").select("key", F.col("cluster").alias("entity"))
    of_short = short.join(s.where("e0 = e1"), "word").select("key", F.col("e0").alias("entity"))
    return of_full.unionByName(of_short).distinct()


def name_pairs(names: DataFrame, nicknames: DataFrame) -> DataFrame:
    """key_a < key_b of all keys that mean the same entity."""
    groups = name_groups(names, nicknames)
    # only keys of several entities can meet twice: their pairs alone are made distinct
    groups = materialize(groups.withColumn("several", F.count("*").over(Window.partitionBy("key")) > 1), "entities")
    once = block_pairs(groups, ["entity"], "key", "several")
    return once.unionByName(block_pairs(groups.where("several"), ["entity"], "key").distinct())
