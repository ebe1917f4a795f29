"""Column functions: tokens, units, language, cleaning and segmentation of prose.

Patterns are written for the JVM's engine so that they match what the usual
Unicode reading of ``\\w``, ``\\s`` and ``\\b`` matches.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What counts as a CJK character, a word and a token.
CJK = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]"
WORD = r"[A-Za-z]+(?:['’\-][A-Za-z]+)*"
TOKEN = rf"{WORD}|\p{{Nd}}+(?:\.\p{{Nd}}+)?|{CJK}"

# Abbreviations after which a sentence goes on.
ABBREVIATIONS = ("e.g.", "i.e.", "et al.", "Fig.", "Figs.", "Eq.", "Eqs.", "Dr.", "Mr.", "Mrs.", "Ms.", "Prof.", "vs.", "No.", "Nos.", "cf.")

# Where a sentence ends.
SENTENCE_END = r"""(?<=[。！？!?])\s*|(?<=\.)\s+(?=["'“‘(\[]?[A-Z0-9\x{3400}-\x{9fff}])"""


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def count_all(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def sub(text: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(to))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often and wherever use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def occurrences(text: Column, part: Column) -> Column:
    """How often a string stands in a text, without overlap; 0 for the empty one."""
    gone = F.length(text) - F.length(F.replace(text, part, F.lit("")))
    return F.when(F.length(part) > 0, (gone / F.length(part)).cast("long")).otherwise(F.lit(0).cast("long"))


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFKC")


def nfkc(text: Column) -> Column:
    """Unicode compatibility composition: no built-in function does it.  ASCII texts have it already and stay in the JVM."""
    return F.coalesce(_nfkc(F.when(F.rlike(text, F.lit(r"[^\x00-\x7f]")), text)), text)


def char_grams(text: Column, n: int) -> Column:
    """All n characters in a row; from an array of them, as a substring would count from the text's start each time."""
    none = F.array().cast("array<string>")
    return let(F.split(text, ""), lambda c: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.array_join(F.slice(c, i, F.lit(n)), ""))).otherwise(none))


def tokens(text: Column) -> Column:
    return find_all(text, TOKEN)


def words(text: Column) -> Column:
    return find_all(text, WORD)


def cjk_count(text: Column) -> Column:
    return count_all(text, CJK)


def word_count(text: Column) -> Column:
    return count_all(text, WORD)


def language(text: Column) -> Column:
    """zh, en or mixed by the counts of CJK characters and Latin words."""
    counts = F.struct(cjk_count(text).alias("zh"), word_count(text).alias("en"))
    return let(
        counts,
        lambda n: F.when((n["zh"] == 0) & (n["en"] == 0), "mixed")
        .when(n["zh"] >= F.greatest(F.lit(10), F.floor(n["en"] * 1.2)), "zh")
        .when(n["en"] >= F.greatest(F.lit(10), 2 * n["zh"]), "en")
        .otherwise("mixed"),
    )


def units(text: Column, lang: Column) -> Column:
    """Effective length: CJK characters (zh), Latin words (en) or both."""
    return F.when(lang == "zh", cjk_count(text)).when(lang == "en", word_count(text)).otherwise(cjk_count(text) + word_count(text))


def solid_length(text: Column) -> Column:
    """Characters that aren't white space."""
    return F.length(sub(text, r"(?U)\s+", "")).cast("long")


def squeeze(text: Column) -> Column:
    return F.trim(sub(text, r"(?U)\s+", " "))


def clean_markdown(text: Column) -> Column:
    # What goes, and in which order.
    steps = (
        (r"(?s)```.*?```", " "), (r"(?s)~~~.*?~~~", " "), (r"`([^`]*)`", "$1"),
        (r"!\[([^\]]*)\]\([^)]*\)", "$1"), (r"\[([^\]]+)\]\([^)]*\)", "$1"), (r"<[^>]+>", " "),
        (r"(?dm)^\s{0,3}#{1,6}\s+", ""), (r"(?dm)^\s*>\s?", ""), (r"(?dm)^\s*(?:[-+*]|\d+[.)])\s+", ""), (r"(?dm)^\s*[-*_]{3,}\s*$", ""),
    )
    return reduce(lambda t, s: sub(t, *s), steps, text)


def clean_latex(text: Column) -> Column:
    """Math, citations and commands go; headings and captions stay on their own lines.

    Inline math uses possessive repeats, so a long span can't exhaust the stack.
    """
    # What goes, and in which order.
    heads = "part|chapter|section|subsection|subsubsection|paragraph|subparagraph|caption"
    steps = (
        (r"(?dm)(?<!\\)%.*$", ""),
        (r"(?s)\\begin\{(?:equation\*?|align\*?|gather\*?|multline\*?|displaymath)\}.*?\\end\{[^}]+\}", " "),
        (r"(?s)\\\[.*?\\\]", " "), (r"(?s)\$\$.*?\$\$", " "), (r"(?s)(?<!\\)\$(?:[^$\\]++|\\.)*+\$", " "),
        (rf"\\(?:{heads})\*?(?:\[[^\]]*\])?\{{([^{{}}]*)\}}", "\n$1\n"),
        (r"\\(?:cite\w*|parencite|textcite|autocite|ref|pageref|eqref|label|url|href)\*?(?:\[[^\]]*\])?\{[^{}]*\}(?:\{[^{}]*\})?", " "),
        (r"\\(?:begin|end)\{[^{}]+\}", "\n"), (r"\\[A-Za-z@]+\*?(?:\[[^\]]*\])?", " "), (r"[{}~]", " "),
    )
    return reduce(lambda t, s: sub(t, *s), steps, text)


def clean(text: Column, suffix: str = ".txt") -> Column:
    """Line ends, blanks and control characters in order, after the cleaner for the suffix."""
    text = F.replace(sub(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), F.lit("\u00a0"), F.lit(" "))
    if suffix == ".tex":
        text = clean_latex(text)
    elif suffix in (".md", ".markdown"):
        text = clean_markdown(text)
    for step in ((r"[\x00-\x08\x0B-\x1F]", " "), (r"[ \t]+", " "), (r"\n[ \t]+", "\n"), (r"\n{3,}", "\n\n"), (r"(?U)^\s+|\s+$", "")):
        text = sub(text, *step)
    return text


def _parts(text: Column, pattern: str) -> Column:
    """The parts of a cleaned text between matches.  split compiles its expression for every row, replace does once; cleaned texts have no control characters."""
    return F.split(sub(text, pattern, "\x01"), "\x01", -1)


def has_tokens(text: Column, n: int) -> Column:
    """Whether a text has n tokens; its beginning mostly tells."""
    return (F.size(tokens(F.substring(text, 1, 40 * n))) >= n) | (F.size(tokens(text)) >= n)


def paragraphs(text: Column, min_tokens: int = 1) -> Column:
    """Blocks between blank lines of a cleaned text, squeezed, of at least min_tokens tokens."""
    return F.filter(F.transform(_parts(text, r"(?U)\n\s*\n+"), squeeze), lambda p: has_tokens(p, min_tokens))


#: Abbreviations in lower case that hold no other, and characters that other case rules take for one of their letters.
_SHORTEST = tuple(x for x in (a.lower() for a in ABBREVIATIONS) if not any(b.lower() in x and b.lower() != x for b in ABBREVIATIONS))
_FOLDED = "\u0130\u0131\u017f\u212a"


def _mark(i: int) -> str:
    return chr(0xE000 + i)


def sentences(paragraph: Column) -> Column:
    """The sentences of a squeezed paragraph that have two tokens or more.

    Abbreviations are found in any case and inside words, and come back in their
    usual case; they are held as private-use characters meanwhile.  Most paragraphs
    have none, which plain searches tell.
    """
    low = F.lower(paragraph)
    some = reduce(lambda x, y: x | y, [F.contains(low, F.lit(x)) for x in _SHORTEST] + [F.contains(paragraph, F.lit(c)) for c in _FOLDED])
    held = reduce(lambda t, x: sub(t, rf"(?iu)\Q{x[1]}\E", _mark(x[0])), enumerate(ABBREVIATIONS), paragraph)
    back = lambda s: reduce(lambda t, x: F.replace(t, F.lit(_mark(x[0])), F.lit(x[1])), enumerate(ABBREVIATIONS), s)
    parts = F.when(some, F.transform(_parts(held, f"(?U){SENTENCE_END}"), lambda s: squeeze(back(s)))).otherwise(_parts(paragraph, f"(?U){SENTENCE_END}"))
    return F.filter(parts, lambda s: has_tokens(s, 2))


def all_sentences(text: Column, min_tokens: int = 1) -> Column:
    return F.flatten(F.transform(paragraphs(text, min_tokens), sentences))


def variation(cv: Column, n: Column) -> Column:
    return F.when(cv.isNull() | (n < 4), "insufficient_data").when(cv < 0.18, "very_low_variation").when(cv < 0.32, "low_variation").when(cv < 0.50, "moderate_variation").otherwise("high_variation")


def mode(values: Column, kind: str) -> Column:
    """struct(v, n): the most frequent of an array's values, of equal ones the first seen, and its count; linear once sorted."""
    placed = F.array_sort(F.transform(values, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
    start = F.expr(f"named_struct('v', cast(null as {kind}), 'i', 0, 'n', 0L, 'best', named_struct('v', cast(null as {kind}), 'n', 0L, 'i', 0))")

    def step(a: Column, x: Column) -> Column:
        same = x["v"] == a["v"]
        first, n = F.when(same, a["i"]).otherwise(x["i"]), F.when(same, a["n"] + 1).otherwise(F.lit(1).cast("long"))
        better = (n > a["best"]["n"]) | ((n == a["best"]["n"]) & (first < a["best"]["i"]))
        best = F.struct(F.when(better, x["v"]).otherwise(a["best"]["v"]).alias("v"), F.when(better, n).otherwise(a["best"]["n"]).alias("n"), F.when(better, first).otherwise(a["best"]["i"]).alias("i"))
        return F.struct(x["v"].alias("v"), first.alias("i"), n.alias("n"), best.alias("best"))

    return F.aggregate(placed, start, step, lambda a: F.struct(a["best"]["v"].alias("v"), a["best"]["n"].alias("n")))
