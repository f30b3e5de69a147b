"""Tokenisers that need sequential work, run in Arrow batches over distinct words: basic, word-piece, rank-merged pairs,
dictionary matching and weighted segmentation. Vocabularies are small tables sent with the task.

Null gives null; an empty text gives an empty list; words longer than ``LONGEST`` become the unknown token.
"""

from __future__ import annotations

import string
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONGEST = 100


def _is_cjk(c: str) -> bool:
    o = ord(c)
    return any(a <= o <= b for a, b in ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F)))


def is_control(c: str) -> bool:
    """Control characters, but for tab and line ends."""
    return c not in "\t\n\r" and unicodedata.category(c).startswith("C")


def is_blank(c: str) -> bool:
    return c in " \t\n\r" or unicodedata.category(c) == "Zs"


def is_punctuation(c: str) -> bool:
    """ASCII signs that aren't letters, digits or blanks, and Unicode's P categories."""
    return c in string.punctuation or unicodedata.category(c).startswith("P")


def basic_tokens(text: str, lower: bool = True, keep: Iterable[str] = ()) -> list[str]:
    """Words of cleaned text; Chinese characters and punctuation stand alone, accents are dropped with case (ST14)."""
    clean = "".join(" " if is_blank(c) else f" {c} " if _is_cjk(c) else c for c in text if ord(c) not in (0, 0xFFFD) and not is_control(c))
    kept = frozenset(keep)
    out: list[str] = []
    for word in clean.split():
        if word in kept:
            out.append(word)
            continue
        if lower:
            word = "".join(c for c in unicodedata.normalize("NFD", word.lower()) if unicodedata.category(c) != "Mn")
        out.extend("".join(f" {c} " if is_punctuation(c) else c for c in word).split())
    return out


def word_pieces(word: str, vocabulary: frozenset[str], unknown: str = "[UNK]") -> list[str]:
    """Longest matches from the left, later ones marked with ## (ST15)."""
    if len(word) > LONGEST:
        return [unknown]
    out, at = [], 0
    while at < len(word):
        lead = "##" if at else ""
        end = next((e for e in range(len(word), at, -1) if lead + word[at:e] in vocabulary), None)
        if end is None:
            return [unknown]
        out.append(lead + word[at:end])
        at = end
    return out


def merged_pairs(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Symbols joined pair by pair, always the pair of the least rank, all its places at once (ST16)."""
    while len(symbols) > 1:
        pair = min(zip(symbols, symbols[1:]), key=lambda p: ranks.get(p, 1 << 60))
        if pair not in ranks:
            break
        out: list[str] = []
        skip = False
        for a, b in zip(symbols, [*symbols[1:], ""]):
            if skip:
                skip = False
            elif (a, b) == pair:
                out.append(a + b)
                skip = True
            else:
                out.append(a)
        symbols = out
    return symbols


def byte_symbols() -> dict[int, str]:
    """A printable character for every byte: itself where printable, else from 256 on (ST16)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in plain}
    spare = 256
    for b in range(256):
        if b not in table:
            table[b] = chr(spare)
            spare += 1
    return table


def tokenise_distinct(df: DataFrame, key: str, word: str, fn: Callable[[str], list[str]]) -> DataFrame:
    """Adds pieces (array<string>) to each row by its word; every distinct word is worked on once and joined back."""
    kind = df.schema[word].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fn(w) for w in words], pa.list_(pa.string()))], names=[word, "pieces"])

    made = df.select(word).where(F.col(word).isNotNull()).distinct().mapInArrow(run, f"`{word}` {kind}, pieces array<string>")
    return df.join(made, word, "left")


class Dictionary:
    """Weighted words, matched anywhere in a text by one automaton (ST28, JN23)."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights = {w: x for w, x in weights.items() if w}
        self.auto = ahocorasick.Automaton()
        for w, x in self.weights.items():
            self.auto.add_word(w, (w, float(x)))
        if self.weights:
            self.auto.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, str]]:
        """(begin, end, word) of every match, in order."""
        if not self.weights:
            return []
        return sorted((e + 1 - len(w), e + 1, w) for e, (w, _) in self.auto.iter(text))

    def segments(self, text: str) -> list[str]:
        """The distinct dictionary words on the path of most weight; a word weighs its weight times its length squared, a character 1 (ST29)."""
        from_here: dict[int, list[tuple[int, float]]] = {}
        for a, b, w in self.matches(text):
            from_here.setdefault(a, []).append((b, self.weights[w] * len(w) * len(w)))
        best = [(0.0, len(text))] * (len(text) + 1)
        for i in range(len(text) - 1, -1, -1):
            words = dict(from_here.get(i, ()))
            steps = [(x + best[b][0], b) for b, x in ({i + 1: 1.0} | words).items()]
            best[i] = max(steps)
        out: list[str] = []
        i = 0
        while i < len(text):
            j = best[i][1]
            if text[i:j] in self.weights and text[i:j] not in out:
                out.append(text[i:j])
            i = j
        return out


#: Characters of words in one automaton.
SHARD_CHARS = 1_000_000


def dictionary_matches(df: DataFrame, key: str, text: str, words: DataFrame) -> DataFrame:
    """key, begin, end, word of every match of a dictionary (column word, distinct) in each text.

    Words are dealt into shards of about ``SHARD_CHARS`` characters, texts are sent to each shard, and tasks stream them
    through the automaton of theirs. Null texts, and null and empty words, match nothing; keys may repeat.
    """
    kind = df.schema[key].dataType.simpleString()
    words = words.where("word <> ''").select("word").distinct()
    shards = max(1, -(-(words.agg(F.sum(F.length("word")).alias("n")).first()["n"] or 0) // SHARD_CHARS))
    parts = 1 if shards > 1 else 16  # one automaton: texts are dealt instead, so that tasks are several
    dealt = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    w = words.select(F.pmod(F.xxhash64("word"), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(None).cast(kind).alias("key"), F.col("word").alias("text"), F.lit(False).alias("searched"))
    t = df.where(F.col(text).isNotNull()).select(dealt.alias("shard"), F.pmod(F.xxhash64(text), F.lit(parts)).cast("int").alias("part"), F.col(key).alias("key"), F.col(text).alias("text"), F.lit(True).alias("searched"))
    rows = w.unionByName(t).repartition(shards * parts, "shard", "part").sortWithinPartitions("shard", "part", "searched")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, auto = None, None
        for b in batches:
            keys: list[int] = []
            found: list[tuple[int, int, str]] = []
            for i, (shard, part, text, searched) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist())):
                if group != (shard, part):
                    group, auto = (shard, part), ahocorasick.Automaton()
                if not searched:
                    auto.add_word(text, text)
                elif len(auto):
                    if auto.kind != ahocorasick.AHOCORASICK:
                        auto.make_automaton()
                    got = [(e + 1 - len(x), e + 1, x) for e, x in auto.iter(text)]
                    keys.extend([i] * len(got))
                    found.extend(got)
            if keys:
                cols = list(zip(*found))
                yield pa.RecordBatch.from_arrays([b.column(2).take(pa.array(keys)), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=[key, "begin", "end", "word"])

    return rows.mapInArrow(run, f"`{key}` {kind}, begin bigint, end bigint, word string")


def weighted_segments(df: DataFrame, key: str, text: str, words: DataFrame) -> DataFrame:
    """``df`` with pieces (array<string>): the dictionary words (word, weight) on the best path through each text (ST29). ``key`` is unique.

    Each text is cut with the words found in it, so no task holds the dictionary.
    """
    kind = df.schema[key].dataType.simpleString()
    own = dictionary_matches(df, key, text, words).select(key, "word").distinct().join(words, "word").groupBy(key).agg(F.collect_list(F.struct("word", "weight")).alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pieces = [Dictionary({w["word"]: w["weight"] for w in ws}).segments(t) for t, ws in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pieces, pa.list_(pa.string()))], names=[key, "pieces"])

    made = df.select(key, text).join(own, key).mapInArrow(run, f"`{key}` {kind}, pieces array<string>")
    return df.join(made, key, "left").withColumn("pieces", F.coalesce("pieces", F.when(F.col(text).isNotNull(), F.array().cast("array<string>"))))


def vocabulary_ids(text: str, ids: dict[str, int], stop: frozenset[str]) -> list[int]:
    """Ids of blank-separated words: as typed, without outer punctuation, in lower case, whichever is known first; stop words are left out (ST24)."""
    out = []
    for word in text.split():
        bare = word.strip(string.punctuation)
        for form in (word, bare, bare.lower()):
            if form in stop:
                break
            if form and form in ids:
                out.append(ids[form])
                break
    return out


def joined_phrases(words: list[str], phrases: frozenset[str], joint: str = "_") -> list[str]:
    """Words with known phrases joined, longer phrases first, as typed or in lower case (ST25)."""
    for n in sorted({p.count(joint) + 1 for p in phrases}, reverse=True):
        out: list[str] = []
        i = 0
        while i < len(words):
            p = joint.join(words[i : i + n])
            hit = p if p in phrases else p.lower() if p.lower() in phrases else None
            if hit is not None and i + n <= len(words):
                out.append(hit)
                i += n
            else:
                out.append(words[i])
                i += 1
        words = out
    return words


def forced_spans(tokens: list[str], trusted: frozenset[str] = frozenset()) -> list[str]:
    """Tokens cut again so that what stands in 《》 and trusted words of four letters or more are tokens of their own (ST27)."""
    text = "".join(tokens)
    cuts = {0}
    for t in tokens:
        cuts.add(max(cuts) + len(t))
    spans: list[tuple[int, int]] = []
    at = text.find("《")
    while at >= 0:
        end = text.find("》", at)
        if end < 0:
            break
        spans.append((at + 1, end))
        at = text.find("《", end)
    i = 0
    longest = max(map(len, trusted), default=0)
    while i < len(text):
        n = next((n for n in range(min(longest, len(text) - i), 3, -1) if text[i : i + n] in trusted), 0)
        if n:
            spans.append((i, i + n))
        i += max(n, 1)
    for a, b in spans:
        cuts = {c for c in cuts if not a < c < b} | {a, b}
    marks = sorted(cuts)
    return [text[a:b] for a, b in zip(marks, marks[1:]) if b > a]


def aligned_answer(predicted: str, original: str, lower: bool = True) -> str:
    """The piece of the original that a prediction made of basic tokens stands for; the original if it can't be placed (ST40)."""
    normal = " ".join(basic_tokens(original, lower))
    at = normal.find(predicted)
    if at < 0:
        return original
    squeeze = lambda s: [(i, c) for i, c in enumerate(s) if c != " "]
    a, b = squeeze(normal), squeeze(original)
    if len(a) != len(b):
        return original
    place = {i: b[k][0] for k, (i, _) in enumerate(a)}
    end = at + len(predicted) - 1
    if at not in place or end not in place:
        return original
    return original[place[at] : place[end] + 1]


def expanded_templates(template: str) -> list[str]:
    """All texts of a template with choices ``<a|b>``; a slot without a bar stays (ST33)."""
    parts: list[list[str]] = [[""]]
    i = 0
    while i < len(template):
        a = template.find("<", i)
        b = template.find(">", a) if a >= 0 else -1
        if b < 0:
            parts.append([template[i:]])
            break
        parts.append([template[i:a]])
        inside = template[a + 1 : b]
        parts.append(inside.split("|") if "|" in inside else [template[a : b + 1]])
        i = b + 1
    out = [""]
    for p in parts:
        out = [x + y for x in out for y in p]
    return out
