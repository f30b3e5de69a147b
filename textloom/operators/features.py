"""Model-ready arrays: pair layouts, span windows, masks, language-model windows. All are column expressions or windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def truncated_sizes(a: Column, b: Column, budget: int) -> tuple[Column, Column]:
    """Sizes of two lists cut to a budget, always the longer one, of equal ones the second (AR2)."""
    m = F.lit(budget)
    return F.least(a, F.greatest(m - b, F.ceil(m / 2))).cast("int"), F.least(b, F.greatest(m - a, F.floor(m / 2))).cast("int")


def pair_features(a: Column, b: Column | None, size: int, cls: int = 101, sep: int = 102, pad: int = 0, cls_last: bool = False, pad_left: bool = False, cls_segment: int = 0) -> dict[str, Column]:
    """input_ids, input_mask, segment_ids of one or two id lists at a fixed size (AR1, CS18)."""
    if b is None:
        x = F.slice(a, 1, size - 2)
        body, seg = F.concat(x, F.array(F.lit(sep))), F.array_repeat(F.lit(0), F.size(x) + 1)
    else:
        la, lb = truncated_sizes(F.size(a), F.size(b), size - 3)
        x, y = F.slice(a, F.lit(1), la), F.slice(b, F.lit(1), lb)
        body = F.concat(x, F.array(F.lit(sep)), y, F.array(F.lit(sep)))
        seg = F.concat(F.array_repeat(F.lit(0), la + 1), F.array_repeat(F.lit(1), lb + 1))
    one, mark = F.array(F.lit(cls)), F.array(F.lit(cls_segment))
    ids, seg = (F.concat(body, one), F.concat(seg, mark)) if cls_last else (F.concat(one, body), F.concat(mark, seg))
    fill = F.lit(size) - F.size(ids)
    mask = F.array_repeat(F.lit(1), F.size(ids))
    put = lambda x, v: F.concat(F.array_repeat(F.lit(v), fill), x) if pad_left else F.concat(x, F.array_repeat(F.lit(v), fill))
    return {"input_ids": put(ids, pad), "input_mask": put(mask, 0), "segment_ids": put(seg, 0)}


def doc_spans(n: Column, length: int, stride: int) -> Column:
    """start and size of windows over n tokens; the first that reaches the end is the last (WN5)."""
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(stride)), lambda s: (s == 0) | (s - stride + length < n))
    return F.when(n > 0, F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(F.lit(length), n - s).alias("size")))).otherwise(F.array().cast("array<struct<start:int,size:int>>"))


def max_context(spans: DataFrame, key: str) -> DataFrame:
    """key, token, span: the window in which each token has the most context on its poorer side, the first of equal ones (WN6). ``spans``: key, span, start, size."""
    t = spans.withColumn("token", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)))
    left, right = F.col("token") - F.col("start"), F.col("start") + F.col("size") - 1 - F.col("token")
    w = Window.partitionBy(key, "token").orderBy(F.desc(F.least(left, right) * 100 + F.col("size")), "span")
    return t.withColumn("rn", F.row_number().over(w)).where("rn = 1").select(key, "token", "span")


def masked(tokens: DataFrame, doc: str, at: str, token: str, seed: int = 7, share: float = 0.15, most: int = 20) -> DataFrame:
    """Adds label (the token where masked) and input: of the chosen 80 % [MASK], 10 % another word, 10 % themselves (AR6).

    Chosen are the round(share * n) (at least 1, at most ``most``) tokens of each document with the least hashes of
    document, place and seed; the other word is the document's token at a hashed place.
    """
    h = F.pmod(F.xxhash64(doc, at, F.lit(seed)), F.lit(1_000_000))
    w = Window.partitionBy(doc)
    t = tokens.withColumn("h", h).withColumn("n", F.count("*").over(w)).withColumn("rn", F.row_number().over(w.orderBy("h", at)))
    chosen = F.col("rn") <= F.least(F.lit(most), F.greatest(F.lit(1), F.round(F.col("n") * share)))
    dice = F.pmod(F.xxhash64(doc, at, F.lit(seed + 1)), F.lit(10))
    t = t.withColumn("other", F.first(token).over(w.orderBy(F.xxhash64(doc, at, F.lit(seed + 2)), at)))
    return t.withColumn("label", F.when(chosen, F.col(token))).withColumn("input", F.when(~chosen, F.col(token)).when(dice < 8, "[MASK]").when(dice == 8, F.col("other")).otherwise(F.col(token))).drop("h", "n", "rn", "other")


def next_sentence_pairs(lines: DataFrame, doc: str, at: str, line: str, seed: int = 7) -> DataFrame:
    """doc, at, a, b, is_next: each line with its next one, or by a hashed coin with a line of another document (WN9, AR7).

    The other line comes from a table of one line a document, joined by a hashed number, so nothing is crossed.
    """
    from textloom.runtime import add_dense_ids

    w = Window.partitionBy(doc).orderBy(at)
    t = lines.withColumn("next", F.lead(line).over(w)).where(F.col("next").isNotNull())
    heads = add_dense_ids(lines.groupBy(doc).agg(F.min_by(line, F.struct(F.xxhash64(doc, at, F.lit(seed)), at)).alias("other")).withColumnRenamed(doc, "other_doc"), ["other_doc"], "i")
    n = heads.agg(F.count("*").alias("docs"))
    t = t.join(F.broadcast(n)).withColumn("i", F.pmod(F.xxhash64(doc, at, F.lit(seed)), "docs")).join(heads, "i", "left")
    coin = (F.pmod(F.xxhash64(doc, at, F.lit(seed + 1)), F.lit(2)) == 0) & (F.col("other_doc") != F.col(doc))
    return t.select(doc, at, F.col(line).alias("a"), F.when(coin, F.col("other")).otherwise(F.col("next")).alias("b"), (~coin).alias("is_next"))


def language_windows(tokens: DataFrame, doc: str, at: str, token: str, size: int) -> DataFrame:
    """doc, batch, data, target: stretches of tokens and the same shifted by one (WN11)."""
    w = Window.partitionBy(doc).orderBy(at)
    t = tokens.withColumn("i", F.row_number().over(w) - 1).withColumn("next", F.lead(token).over(w)).where("next is not null")
    g = t.groupBy(doc, F.floor(F.col("i") / size).alias("batch")).agg(F.array_sort(F.collect_list(F.struct("i", F.col(token).alias("x"), F.col("next").alias("y")))).alias("r"))
    return g.select(doc, "batch", F.transform("r", lambda s: s["x"]).alias("data"), F.transform("r", lambda s: s["y"]).alias("target"))


def packed_chunks(sizes: Column, target: int) -> Column:
    """Chunk number of each piece when pieces are packed in order until a chunk reaches the target (WN10)."""
    start = F.struct(F.lit(0).alias("c"), F.lit(0).cast("bigint").alias("used"), F.array().cast("array<int>").alias("out"))

    def step(s, x):
        full = s["used"] + x >= target
        return F.struct(F.when(full, s["c"] + 1).otherwise(s["c"]).alias("c"), F.when(full, F.lit(0).cast("bigint")).otherwise(s["used"] + x).alias("used"), F.concat(s["out"], F.array(s["c"])).alias("out"))

    return F.aggregate(sizes, start, step, lambda s: s["out"])


def char_to_word(text: Column) -> Column:
    """For each character the number of the word it stands in or behind, from 0, -1 before the first (WN16)."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    start = F.struct(F.lit(-1).alias("w"), F.lit(True).alias("gap"), F.array().cast("array<int>").alias("out"))

    def step(s, c):
        blank = c.isin(" ", "\t", "\r", "\n", " ")
        w = F.when(~blank & s["gap"], s["w"] + 1).otherwise(s["w"])
        return F.struct(w.alias("w"), blank.alias("gap"), F.concat(s["out"], F.array(w)).alias("out"))

    return F.aggregate(chars, start, step, lambda s: s["out"])


def learning_rate(step: Column, kind: str, warmup: int, total: int, cycles: float = 0.5) -> Column:
    """Factor of the learning rate at a step (MA9): constant, warmup, linear, cosine or restarts."""
    rise = step / F.lit(float(max(1, warmup)))
    done = (step - warmup) / F.lit(float(max(1, total - warmup)))
    if kind == "constant":
        return F.lit(1.0)
    if kind == "warmup":
        return F.when(step < warmup, rise).otherwise(1.0)
    if kind == "linear":
        return F.when(step < warmup, rise).otherwise(F.greatest(F.lit(0.0), (total - step) / F.lit(float(max(1, total - warmup)))))
    if kind == "cosine":
        return F.when(step < warmup, rise).otherwise(F.greatest(F.lit(0.0), 0.5 * (1 + F.cos(F.lit(3.141592653589793 * cycles * 2) * done))))
    if kind == "restarts":
        return F.when(step < warmup, rise).when(done >= 1, 0.0).otherwise(F.greatest(F.lit(0.0), 0.5 * (1 + F.cos(F.lit(3.141592653589793) * ((done * cycles) % 1)))))
    raise ValueError(kind)


def log_uniform(rank: Column, size: int) -> Column:
    """Probability of the token of this rank under a log-uniform sampler (MA10)."""
    return F.ln((rank + 2) / (rank + 1)) / F.ln(F.lit(float(size + 1)))


def choice_features(df: DataFrame, key: str, context: str, start: str, endings: str, size: int) -> DataFrame:
    """key, choice, tokens (with [CLS] and [SEP]), segment_ids, input_mask (padded with 0 to ``size``): one row a choice (AR5).

    The context and the start with an ending are token arrays; the pair is cut to fit, always the longer one, of equal
    ones the second. A null ending has no row, a null context or start is empty.
    """
    empty = F.array().cast("array<string>")
    d = df.select(key, F.coalesce(context, empty).alias("c"), F.coalesce(start, empty).alias("s"), F.posexplode(endings).alias("choice", "e")).where("e is not null")
    d = d.withColumn("e", F.concat("s", "e"))
    lc, le = truncated_sizes(F.size("c"), F.size("e"), size - 3)
    d = d.withColumn("lc", lc).withColumn("le", le)
    word = lambda w: F.array(F.lit(w))
    tokens = F.concat(word("[CLS]"), F.slice("c", F.lit(1), F.col("lc")), word("[SEP]"), F.slice("e", F.lit(1), F.col("le")), word("[SEP]"))
    rest = F.lit(size) - F.col("lc") - F.col("le") - 3
    ones = lambda n: F.array_repeat(F.lit(1), n)
    zeros = lambda n: F.array_repeat(F.lit(0), n)
    return d.select(key, "choice", tokens.alias("tokens"), F.concat(zeros(F.col("lc") + 2), ones(F.col("le") + 1), zeros(rest)).alias("segment_ids"), F.concat(ones(F.col("lc") + F.col("le") + 3), zeros(rest)).alias("input_mask"))


def span_features(df: DataFrame, key: str, query: str, doc: str, first: str, last: str, size: int, stride: int, most_query: int) -> DataFrame:
    """key, span, start, tokens, p_mask (0 where an answer may stand), begin_at, end_at: a row per window of a text (AR4).

    ``query`` and ``doc`` are token arrays, ``first`` and ``last`` the answer's tokens in the text. A window reads
    [CLS] query [SEP] window [SEP]; labels are places in it, 0 (the head) where it doesn't hold the whole answer or there
    is none. A text without tokens has no window.
    """
    q = F.slice(F.coalesce(F.col(query), F.array().cast("array<string>")), 1, most_query)
    d = df.where(F.size(doc) > 0).withColumn("__q", q).withColumn("__w", F.lit(size) - F.size("__q") - 3)
    n = F.size(doc)
    starts = F.filter(F.sequence(F.lit(0), n - 1, F.lit(stride)), lambda s: (s == 0) | (s - stride + F.col("__w") < n))
    d = d.select("*", F.posexplode(starts).alias("span", "start")).withColumn("__n", F.least("__w", n - F.col("start")))
    word = lambda w: F.array(F.lit(w))
    tokens = F.concat(word("[CLS]"), "__q", word("[SEP]"), F.slice(doc, F.col("start") + 1, F.col("__n")), word("[SEP]"))
    mask = F.concat(F.array(F.lit(0)), F.array_repeat(F.lit(1), F.size("__q") + 1), F.array_repeat(F.lit(0), F.col("__n")), F.array(F.lit(1)))
    held = (F.col(first) >= F.col("start")) & (F.col(last) < F.col("start") + F.col("__n"))
    at = lambda c: F.when(held, F.col(c) - F.col("start") + F.size("__q") + 2).otherwise(0).cast("bigint")
    return d.select(key, "span", "start", tokens.alias("tokens"), mask.alias("p_mask"), at(first).alias("begin_at"), at(last).alias("end_at"))
