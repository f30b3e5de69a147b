"""String functions as columns: mention and lexicon forms, answers, markup, splitting. Null gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English stop words left out of mention variants.
STOP_WORDS = (
    "a an and are as at be by for from has he i in is it its of on that the their we to was were with you your yours our ours theirs her hers his him mine or but though since"
).split()
# What mention variants drop.
MENTION_NOISE = r""" \([^)]*\)|<[^)]*>|,|"|\.|'|:|-"""
_WS = r"[\s\x{A0}\x{3000}]+"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def collapse(x: Column | str) -> Column:
    """One blank for each run of white space, none at the ends."""
    return F.trim(F.regexp_replace(_c(x), _WS, " "))


def strip_mention(x: Column | str) -> Column:
    """Lower case, no backslashes, single blanks (ST1)."""
    return collapse(F.replace(F.lower(_c(x)), F.lit("\\"), F.lit("")))


def expand_mention(x: Column | str) -> Column:
    """Distinct variants: without brackets and punctuation, and without stop words (ST2, SE4)."""
    bare = collapse(F.regexp_replace(_c(x), MENTION_NOISE, ""))
    words = F.filter(F.split(collapse(x), " "), lambda w: ~w.isin(STOP_WORDS))
    return F.array_distinct(F.array(bare, F.array_join(words, " ")))


def expand_lexicon(x: Column | str) -> Column:
    """A name, and with a middle dot also with a hyphen and without (ST3)."""
    x = _c(x)
    return F.when(x.contains("·"), F.array(x, F.replace(x, F.lit("·"), F.lit("-")), F.replace(x, F.lit("·"), F.lit("")))).when(x.isNotNull(), F.array(x))


def strip_lexicon(x: Column | str) -> Column:
    """No blanks in names with Chinese characters (ST3)."""
    return F.when(contains_chinese(x), F.replace(_c(x), F.lit(" "), F.lit(""))).otherwise(_c(x))


def contains_chinese(x: Column | str) -> Column:
    """Whether a character of U+4E00 to U+9FFF stands in the text (PF16)."""
    return _c(x).rlike(r"[\x{4E00}-\x{9FFF}]")


def is_valid_lexicon(x: Column | str, least: int = 2) -> Column:
    """Long enough, no punctuation first, not digits alone (PF6)."""
    x = _c(x)
    return ~x.rlike(r"""^[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]""") & (F.length(x) >= least) & ~x.rlike(r"^[0-9]+$")


def normalise_wikilink(x: Column | str) -> Column:
    """Underscores as blanks, none at the ends, first letter in upper case (ST8)."""
    t = F.trim(F.translate(_c(x), "_", " "))
    return F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 2**31 - 1))


def normalize_answer(x: Column | str) -> Column:
    """Lower case, without ASCII punctuation, articles and extra blanks (ST11)."""
    t = F.regexp_replace(F.lower(_c(x)), r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]""", "")
    return collapse(F.regexp_replace(t, r"\b(a|an|the)\b", " "))


# Replacements that undo tokenisation, in this order.
CLEAN_UP = ((" .", "."), (" ?", "?"), (" !", "!"), (" ,", ","), (" ' ", "'"), (" n't", "n't"), (" 'm", "'m"), (" do not", " don't"), (" 's", "'s"), (" 've", "'ve"), (" 're", "'re"))


def clean_up_tokenization(x: Column | str) -> Column:
    """Tokenised English back to plain spacing (ST12)."""
    x = _c(x)
    for a, b in CLEAN_UP:
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


# Signs whose runs stand apart in standardised text.
SIGN_RUNS = r"""(-+|~+|!+|"+|;+|\?+|\++|,+|\)+|\(+|\\+|/+|\*+|\[+|\]+|\}+|\{+|\|+|_+)"""


def text_standardize(x: Column | str) -> Column:
    """Plain dashes and quotes, runs of signs set apart, white space in order (ST13)."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(_c(x), "[—–―]", "-"), "…", "..."), "´", "'")
    t = F.regexp_replace(t, SIGN_RUNS, " $1 ")
    t = F.regexp_replace(t, r"[ \t\r\f]*\n[ \t\r\f\n]*", " \n ")
    return F.regexp_replace(F.regexp_replace(t, r"[ \t\r\f]+", " "), r"^[ \n]+|[ \n]+$", "")


def characters(x: Column | str) -> Column:
    """The characters of a segmented line without its blanks, odd quotes set right (ST18)."""
    t = F.translate(_c(x), "｀＇ ", "“”")
    return F.filter(F.split(t, ""), lambda c: c != "")


def segment_labels(x: Column | str) -> Column:
    """B, M, E, S labels of a line whose words stand between blanks (ST19)."""
    one = lambda w: F.when(F.length(w) == 1, F.array(F.lit("S"))).when(F.length(w) == 2, F.array(F.lit("B"), F.lit("E"))).when(
        F.length(w) > 2, F.concat(F.array(F.lit("B")), F.array_repeat(F.lit("M"), F.length(w) - 2), F.array(F.lit("E")))
    ).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(F.split(F.replace(_c(x), F.lit("  "), F.lit(" ")), " "), one))


def chinese_sentences(x: Column | str) -> Column:
    """Pieces that end in 。, ！ or ？, the mark kept (ST21)."""
    return F.filter(F.split(_c(x), "(?<=[。！？])"), lambda s: s != "")


def unitok(x: Column | str) -> Column:
    """Tokens with punctuation and symbols set apart, apostrophes left in words (ST23)."""
    t = F.regexp_replace(_c(x), r"([\p{P}\p{S}&&[^ʼ’‘´′'፡።]]|[፡።])", " $1 ")
    return F.filter(F.split(collapse(t), " "), lambda w: w != "")


def letters_only(x: Column | str) -> Column:
    """Lower case, nothing but Chinese characters, ASCII letters and digits (ST32)."""
    return F.regexp_replace(F.lower(_c(x)), r"[^\x{4E00}-\x{9FD5}a-zA-Z0-9]", "")


def first_clause(x: Column | str) -> Column:
    """What stands before the first stop, comma or bracket (ST35)."""
    return F.split(_c(x), "[。.，,（(]")[0]


def ngrams(words: Column | str, n: int) -> Column:
    """n neighbouring words joined by underscores (WN12); an empty list if there are fewer."""
    w = _c(words)
    count = F.size(w) - n + 1
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.array_join(F.slice(w, i + 1, n), "_"))).otherwise(F.array().cast("array<string>"))


def confirm_negation(source: Column | str, target: Column | str, keys: tuple[str, ...] = ("不", "没")) -> Column:
    """If the source holds a negation, whether the target holds the first one found (PF17)."""
    source, target = _c(source), _c(target)
    out = F.when(source.contains(keys[0]), target.contains(keys[0]))
    for k in keys[1:]:
        out = out.when(source.contains(k), target.contains(k))
    return out.otherwise(F.lit(True))


def html_with_breaks(lines: Column | str) -> Column:
    """Each non-empty line behind a <br> (ST37)."""
    return F.array_join(F.transform(F.filter(_c(lines), lambda s: s != ""), lambda s: F.concat(F.lit("<br>"), s)), "")


def wordpiece_to_text(tokens: Column | str) -> Column:
    """Word pieces joined to words (ST41)."""
    return F.trim(F.replace(F.array_join(_c(tokens), " "), F.lit(" ##"), F.lit("")))
