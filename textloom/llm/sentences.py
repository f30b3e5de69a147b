"""Sentence units of texts in many scripts.

Line breaks, final marks that mean nothing else, pairs of quotation marks and brackets, and blanks between Thai letters
decide by themselves. Points, dots of omission and the marks ! and ? are candidates, each classified by a maximum-entropy
model over its neighbours: the word before and the one behind, case, length, digits, script, spacing, whether the word
before is on a short list of abbreviations, and how the corpus uses that word.

How the corpus uses a word is counted over all texts: how often it stands with a point and without, and how many of its
points end a line. A word that nearly always has a point, which hardly ever ends a line, is an abbreviation before a name
or number, whether listed or not. Words with at least ``WORD_SHARE`` of all points are told to all tasks, so they are
``1 / WORD_SHARE`` at most, whatever the corpus.

The model is trained on candidates whose label is sure from these counts and the signs around them, not from the list: a
point before a lower-case word, in a number or behind an initial or such an abbreviation ends nothing; one between a word
that mostly stands without a point and a capital ends a unit. At most ``TRAIN_ROWS`` texts and ``TRAIN_CANDIDATES``
candidates are used; features are categories, so a decision is looked up once per combination.

Defined cases: a null, empty or blank text has no units; white space at a unit's edges is left out, other signs are kept;
an opening sign without its closing one in the same line opens nothing; a record id delivered again counts once (the last
import); offsets count code points; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.runtime import materialize

TRAIN_ROWS = 20_000
TRAIN_CANDIDATES = 60_000
_DIMS = 4096
#: The least share of all points that a word must have to be told to all tasks, and the least number.
WORD_SHARE, WORD_COUNT = 1e-5, 4

# Abbreviations whose point doesn't end a unit.
NEVER_FINAL = frozenset(
    """mr mrs ms dr prof gen st col sgt capt lt rev hon sen rep gov pres adm maj cmdr messrs mme mlle sr jr
    vs approx al cf e.g i.e viz no nos p pp fig figs vol vols eq sec ch ed eds art dept est incl max min ca c
    nr abb bzw ca z z.b u u.a u.ä u.u d d.h s bd hrsg hr fr frl str vgl evtl ggf inkl zzgl tel usw.u bspw sog ing dipl
    т.е е г гг ул им рис тыс млн млрд др.и см ср тел пр просп пер стр табл гр проф акад ген св
    د م ص
    डॉ क्र ए बी श्री प्रो पृ सं
    ดร พ.ศ พ ศ น.ส นาย ร.ศ ผศ รศ ศ.ดร""".split()
)
# Abbreviations that may also stand at a unit's end.
MAY_END = frozenset("etc inc ltd co corp bros a.m p.m u.s u.k u.n usw uvm т.д т.п д п др etc.usf u.s.w".split())
# Month names behind a German day number.
MONTHS = frozenset("januar februar märz april mai juni juli august september oktober november dezember jänner".split())

_BREAK = regex.compile(r"\r\n|[\n\r\x0b\x0c\x85  ]")
_MARKS = ".!?。！？．｡…।॥؟۔։።፧။။᠃᠉‼⁇⁈⁉⸮︒﹖﹗"
_OPEN = {"(": ")", "（": "）", "[": "]", "【": "】", "〔": "〕", "{": "}", "《": "》", "〈": "〉", "「": "」", "『": "』", "«": "»", "“": "”", "„": "“", "‹": "›", "｢": "｣", "［": "］", "｛": "｝", "〖": "〗"}
_CLOSE = frozenset(_OPEN.values()) | {'"', "’", "'"}
_CLOSERS = "".join(regex.escape(c) for c in sorted(_CLOSE | {"“"}))
_SIGN = regex.compile("[" + "".join(regex.escape(c) for c in sorted(set(_OPEN) | set(_OPEN.values()) | {'"'})) + "]")
_RUN = regex.compile(rf"[{regex.escape(_MARKS)}][{regex.escape(_MARKS)}]*[{regex.escape(_MARKS)}{_CLOSERS}]*")
_THAI = r"[ก-ฺเ-๎]"
_THAI_BLANK = regex.compile(rf"(?<={_THAI})\s+(?={_THAI})")
_NEXT = regex.compile(r"(\s*)([\p{Ps}\p{Pi}\"'„“]*)(\S?)")
_ADDRESS = regex.compile(r"(?:://|www\.)[^\s\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]*$")
_WORD = regex.compile(r"[\p{L}\p{M}]*")
_CASED_TAIL = regex.compile(r"[\p{Lu}\p{Ll}\p{Lt}\p{M}.\d]+$")
_BEFORE = regex.compile(r"[^\s\p{Ps}\p{Pi}\p{Pe}\p{Pf}\"'„,;:，、；：。！？!?…]{1,16}$")


def _pairs(line: str) -> list[tuple[int, int]]:
    """Outermost matched pairs of one line: places of the opening and the closing sign."""
    stack: list[tuple[str, int]] = []
    waiting: dict[str, int] = {}  # how often each closing sign is awaited, so that none is looked for in vain
    found: list[tuple[int, int]] = []
    for m in _SIGN.finditer(line):
        c, at = m.group(), m.start()
        if waiting.get(c):
            sign, begin = "", at
            while sign != c:
                sign, begin = stack.pop()
                waiting[sign] -= 1
            while found and found[-1][0] > begin:
                found.pop()
            found.append((begin, at))
        elif c == '"' or c in _OPEN:
            sign = _OPEN.get(c, c)
            stack.append((sign, at))
            waiting[sign] = waiting.get(sign, 0) + 1
    return found


def _kind(c: str) -> str:
    """Coarse class of a character: case, digit, or script group of caseless letters."""
    if not c:
        return "end"
    if c.isupper() or c.istitle():
        return "up"
    if c.islower():
        return "low"
    if c.isdigit():
        return "dig"
    o = ord(c)
    if 0x0590 <= o <= 0x08FF or 0xFB1D <= o <= 0xFEFC:
        return "rtl"
    if 0x0900 <= o <= 0x0DFF:
        return "indic"
    if 0x0E00 <= o <= 0x0EFF:
        return "thai"
    if 0x3040 <= o <= 0x9FFF or 0xAC00 <= o <= 0xD7AF or 0xF900 <= o <= 0xFAFF or 0x20000 <= o <= 0x3FFFF:
        return "cjk"
    return "let" if c.isalpha() else "sign"


def word_before(line: str, begin: int) -> str:
    """The word that ends at a place of the line, with its inner points, in lower case."""
    b = _BEFORE.search(line, max(0, begin - 17), begin)
    word = b.group() if b else ""
    if word and _kind(word[-1]) in ("up", "low") and (tail := _CASED_TAIL.search(word)):
        word = tail.group().lstrip(".") or word  # Latin letters within another script
    return word


def usage(points: int, plain: int, at_end: int) -> str:
    """How a word is used: 'abbr' (a point, but not at a line's end), 'either' (a point there too), 'final' (mostly there), 'word' (mostly without), 'mixed'."""
    share = points / (points + plain)
    if share < 0.4:
        return "word"
    if share < 0.85:
        return "mixed"
    return "abbr" if at_end < 0.005 * points else "either" if at_end < 0.2 * points else "final"


def features(line: str, begin: int, end: int, used: dict[str, str]) -> tuple[str, ...]:
    """Categories of the candidate whose marks stand at [begin, end) of the line; ``used``: usage by word."""
    marks = line[begin:end]
    omission = "…" in marks or ".." in marks
    spaced, opening, after = _NEXT.match(line, end).groups()
    word = word_before(line, begin)
    low = word.lower()
    tail = low.rsplit(".", 1)[-1]
    use = ("in-" if "." in low else "") + used.get(low, "rare")  # what has inner points is a class of its own
    known = "never" if low in NEVER_FINAL or tail in NEVER_FINAL and "." not in low else "may" if low in MAY_END or tail in MAY_END and len(tail) < 3 else "no"
    known += "." if "." in low else ""
    last = _kind(word[-1:]) if word else "none"
    inner = "." in word
    size = min(len(tail), 4)
    first = _kind(word[:1]) if word else "none"
    nxt = ("sp" if spaced else "no") + _kind(after)
    at = end + len(spaced) + len(opening)
    following = _WORD.match(line, at).group()
    initial = len(following) == 1 and line[at + 1 : at + 2] == "."
    month = last == "dig" and following.lower() in MONTHS
    gap = begin > 0 and line[begin - 1].isspace()
    shape = f"{first}{last}{size}{'.' if inner else ''}"
    ident = tail if 0 < len(tail) <= 4 and not tail[-1].isdigit() else ""
    loud = not marks.strip("!?")
    if loud:  # words have no part in these
        known = use = "loud"
    address = loud and not spaced and bool(_ADDRESS.search(line, max(0, begin - 2000), begin))
    behind = following.lower() if 0 < len(following) <= 3 else ""
    return (
        "omit" if omission else "loud" if loud else "dot", known, shape, nxt, f"{known}|{nxt}", f"{omission}|{gap}|{nxt}", f"{shape}|{nxt}", f"{last}|{nxt}|{month}",
        f"init{initial}|{nxt}|{size}", f"id={ident}", f"open{bool(opening)}|{known}", f"{use}|{nxt}", f"{use}|{size}|{known}|{nxt}", f"{loud}{address}|{bool(opening)}|{nxt}", f"behind={behind}|{nxt}",
    )


def reliable(f: tuple[str, ...]) -> bool | None:
    """The label of a candidate that can be told from its signs and the word's usage; None where it can't. The list of abbreviations plays no part."""
    kind, _, shape, nxt, use = *f[:4], f[11].split("|")[0]
    spaced, after = nxt.startswith("sp"), nxt[2:]
    opening = f[10].startswith("openTrue")
    if kind == "loud":  # a name that ends in a mark, or an address
        if after == "low" and not opening or after == "dig" and not spaced:
            return False
        return True if spaced else not f[13].startswith("TrueTrue")
    if after in ("low", "cjk", "thai", "indic"):
        return False
    if kind == "omit":
        return True if spaced and after in ("up", "rtl") and f[5].split("|")[1] == "False" else False if not spaced else None
    if use in ("abbr", "in-abbr") and not shape.startswith("dig") or f[7].endswith("True"):
        return False
    if after == "dig":
        return False if not spaced else None
    if shape.startswith("upup1"):
        return False
    if after in ("up", "rtl"):
        size = int(shape.rstrip(".")[-1])
        if shape.startswith("digdig"):
            return True if spaced else None  # dates are told apart above
        if use in ("in-either", "in-final", "final") and spaced:
            return True
        if shape.endswith(".") or use in ("either", "mixed", "abbr"):
            return None
        if shape.startswith(("lowlow", "uplow", "rtlrtl", "letlet")) and (use == "word" or size >= 4):
            return True
    return None


class Model:
    """Maximum-entropy weights over hashed categories, and the usage of words."""

    def __init__(self, weights: np.ndarray, used: dict[str, str] | None = None) -> None:
        self.weights, self.used = weights, used or {}
        self.known: dict[tuple[str, ...], bool] = {}

    def ends(self, f: tuple[str, ...]) -> bool:
        got = self.known.get(f)
        if got is None:
            got = bool(self.weights[_slots(f)].sum() > 0)
            if len(self.known) < 200_000:  # a cache; what isn't kept is computed again
                self.known[f] = got
        return got


def _slots(f: tuple[str, ...]) -> np.ndarray:
    return np.array([0] + [1 + xxhash.xxh3_64_intdigest(f"{i}:{x}") % (_DIMS - 1) for i, x in enumerate(f)])


def train(samples: dict[tuple[tuple[str, ...], bool], int], used: dict[str, str] | None = None, rounds: int = 400, ridge: float = 1e-4) -> Model:
    """Weights that maximise the likelihood of labelled candidates (with their numbers); without any, a plain prior."""
    w = np.zeros(_DIMS)
    # what holds without any corpus: one candidate of each kind
    samples = {(features(f"word{m} Next", 4, 5, {}), True): 1 for m in ".!?"} | samples
    x = np.array([_slots(f) for f, _ in samples])
    y = np.array([float(label) for _, label in samples])
    c = np.log1p(np.array(list(samples.values()), dtype=float))
    c /= c.sum()
    grown = np.full(_DIMS, 1e-8)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(w[x].sum(axis=1), -30, 30)))
        g = np.bincount(x.ravel(), np.repeat(c * (p - y), x.shape[1]), _DIMS) + ridge * w
        grown += g * g
        w -= 0.5 * g / np.sqrt(grown)
    return Model(w, used)


_SOFT, _HARD = frozenset(".…．"), frozenset(_MARKS) - frozenset(".…．")


def _ends_here(line: str, begin: int, end: int, decide: Callable[[str, int, int], bool]) -> bool:
    """Whether the marks at ``begin`` (closing signs up to ``end`` behind them) end a unit, outside all pairs."""
    stop = begin
    while stop < end and line[stop] in _MARKS:
        stop += 1
    marks = set(line[begin:end])
    if not marks & _HARD:
        return decide(line, begin, stop)
    if marks <= {"!", "?"}:
        return decide(line, begin, end)
    return True


def _line_ends(line: str, decide: Callable[[str, int, int], bool]) -> list[int]:
    """Places in one line behind which a new unit begins."""
    pairs = _pairs(line) if _SIGN.search(line) else []
    ends: list[int] = []
    k = 0
    for m in _RUN.finditer(line):
        at, end = m.span()
        while k < len(pairs) and pairs[k][1] < at:
            k += 1
        if k < len(pairs) and pairs[k][0] < at:  # the marks stand inside a pair
            begin, close = pairs[k]
            if end <= close:
                continue
            if line[:begin].rstrip().endswith((":", "：")):
                ends.append(end)
                continue
            at = close + 1  # marks behind the pair count, those in it don't
            while at < end and line[at] not in _MARKS:
                at += 1
            if at == end:
                continue
        if _ends_here(line, at, end, decide):
            ends.append(end)
    if max(line) >= "ก" and _THAI_BLANK.search(line):
        k = 0
        for m in _THAI_BLANK.finditer(line):
            while k < len(pairs) and pairs[k][1] < m.start():
                k += 1
            if k == len(pairs) or pairs[k][0] > m.start():
                ends.append(m.start())
        ends.sort()
    return ends


def units(text: str, decide: Callable[[str, int, int], bool]) -> list[tuple[int, int]]:
    """(begin, end) of each unit of a text."""
    out: list[tuple[int, int]] = []
    start = 0
    for m in [*_BREAK.finditer(text), None]:
        stop = m.start() if m else len(text)
        line = text[start:stop]
        if line and not line.isspace():
            a = 0
            for b in [*_line_ends(line, decide), len(line)]:
                piece = line[a:b]
                body = piece.strip()
                if body:
                    lead = len(piece) - len(piece.lstrip())
                    out.append((start + a + lead, start + a + lead + len(body)))
                a = b
        start = m.end() if m else stop
    return out


def _by_model(model: Model) -> Callable[[str, int, int], bool]:
    return lambda line, a, b: model.ends(features(line, a, b, model.used))


def _labelled(used: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Reliable candidates of texts, with their numbers per batch."""
        for b in batches:
            counts: dict[tuple[tuple[str, ...], bool], int] = {}

            def note(line: str, a: int, e: int) -> bool:
                f = features(line, a, e, used)
                label = reliable(f)
                if label is not None:
                    counts[f, label] = counts.get((f, label), 0) + 1
                return False

            for t in b.column(0).to_pylist():
                units(t, note)
            if counts:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([list(f) for f, _ in counts]), pa.array([label for _, label in counts]), pa.array(list(counts.values()), pa.int64())], names=["f", "label", "n"]
                )

    return run


_SHORT = regex.compile(r"(?<![\p{L}\p{M}\p{N}.])(?:[\p{L}\p{M}]{1,6}\.)*[\p{L}\p{M}]{1,6}(?![\p{L}\p{M}\p{N}])")
_LINE_END = regex.compile(r"\.[\s\p{Pe}\p{Pf}\"']*(?:$|[\r\n])")


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, points, at_end, plain of short words of a batch's texts."""
    for b in batches:
        counts: dict[str, list[int]] = {}
        for t in b.column(0).to_pylist():
            t = t.lower()
            for m in _SHORT.finditer(t):
                n = counts.setdefault(m.group(), [0, 0, 0])
                end = m.end()
                if t[end : end + 1] != ".":
                    n[2] += 1
                elif t[end + 1 : end + 2] != ".":
                    n[0] += 1
                    n[1] += _LINE_END.match(t, end) is not None
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts)), *(pa.array([v[k] for v in counts.values()], pa.int64()) for k in range(3))], names=["word", "points", "at_end", "plain"])


def word_usage(records: DataFrame) -> dict[str, str]:
    """Usage of every short word with at least ``WORD_SHARE`` of all points, counted over all texts."""
    rows = records.where("text is not null").select("text").mapInArrow(_word_rows, "word string, points bigint, at_end bigint, plain bigint")
    rows = materialize(rows.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("points", "at_end", "plain")]).where("points > 0"), "words")
    total = rows.agg(F.sum("points").alias("n")).first()["n"] or 0
    kept = rows.where(F.col("points") >= max(WORD_COUNT, WORD_SHARE * total)).collect()  # 1 / WORD_SHARE rows at most
    return {r["word"]: usage(r["points"], r["plain"], r["at_end"]) for r in kept}


def train_on(records: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model of the usage of words in all texts, trained on a bounded sample: about ``rows`` texts, those with the least hashes of their ids. ``records``: record_id, text."""
    used = word_usage(records)
    share = min(1.0, rows / max(1, records.count()))
    some = records.where("text is not null").where(F.xxhash64("record_id") <= min(2**63 - 1, int((share - 0.5) * 2**64))).select("text")
    found = some.mapInArrow(_labelled(used), "f array<string>, label boolean, n bigint").groupBy("f", "label").agg(F.sum("n").alias("n"))
    found = found.orderBy(F.desc("n"), "f", "label").limit(TRAIN_CANDIDATES)
    return train({(tuple(r["f"]), r["label"]): r["n"] for r in found.collect()}, used)


def sentence_units(records: DataFrame, model: Model) -> DataFrame:
    """record_id, unit_no, begin_char, end_char of every unit; ``records``: record_id, text, one row per id."""
    weights, used = model.weights, model.used

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decide = _by_model(Model(weights, used))
        names = ["record_id", "unit_no", "begin_char", "end_char"]
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            row, no, begin, end = [], [], [], []
            for i in range(b.num_rows):
                got = units(texts[i].as_py(), decide)
                row.extend([i] * len(got))
                no.extend(range(1, len(got) + 1))
                begin.extend(a for a, _ in got)
                end.extend(e for _, e in got)
                if len(row) > 50_000:
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), *(pa.array(x, pa.int64()) for x in (no, begin, end))], names=names)
                    row, no, begin, end = [], [], [], []
            if row:
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), *(pa.array(x, pa.int64()) for x in (no, begin, end))], names=names)

    return records.where("record_id is not null and text is not null").select("record_id", "text").mapInArrow(run, "record_id string, unit_no bigint, begin_char bigint, end_char bigint")


def stored_texts(sentences: DataFrame, documents: DataFrame) -> DataFrame:
    """record_id, text of each distinct stored sentence and document."""
    last = F.max(F.struct("import_date", "raw_sentence")).alias("r")
    s = sentences.where("_id is not null").groupBy(F.col("_id").alias("record_id")).agg(last).select("record_id", F.col("r.raw_sentence").alias("text"))
    return s.unionByName(documents.select(F.col("doc_id").cast("string").alias("record_id"), "text"))
