"""Scalar text functions as column expressions; Python only where no expression gives the result."""

from __future__ import annotations

import difflib
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

QUESTION_WORDS = ("what", "who", "where", "when", "why", "how", "which", "is", "are", "can", "does", "do", "the")
COMMON_WORDS = ("about", "and", "for", "tell", "with", "from")
STOP_WORDS = ("the", "and", "for", "with", "this", "that", "are", "was", "from", "not", "but", "have", "has", "had", "you", "your", "they", "their", "will", "would")


def any_of(column: Column, values) -> Column:
    """Whether one of the values stands in the text."""
    out = F.lit(False)
    for v in values:
        out = out | F.contains(column, F.lit(v))
    return out


def query_keywords(text: Column, most: int = 5) -> Column:
    """SC3: letters-only words of three and more, without question and common words; the first few."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), F.lit(0))
    real = F.filter(words, lambda w: ~w.isin(*QUESTION_WORDS, *COMMON_WORDS))
    return F.slice(F.when(F.size(real) > 0, real).otherwise(words), 1, most)


def plain_words(text: Column) -> Column:
    """SC2 without stemming: no links or addresses, letters only, three and more, no stop words."""
    t = F.regexp_replace(F.lower(text), r"https?://\S+|\S+@\S+", " ")
    return F.filter(F.regexp_extract_all(t, F.lit("[a-z]+"), F.lit(0)), lambda w: (F.length(w) >= 3) & ~w.isin(*STOP_WORDS))


def _steps(word: str) -> str:
    """A light suffix stemmer; stands in for Porter's, whose rules the engine doesn't carry."""
    for end in ("ational", "fulness", "ization", "iveness", "ingly", "edly", "ing", "ies", "ed", "es", "ly", "s"):
        if word.endswith(end) and len(word) - len(end) >= 3:
            return word[: -len(end)] + ("y" if end == "ies" else "")
    return word


@F.pandas_udf(StringType())
def stem(words: pd.Series) -> pd.Series:
    return words.map(lambda w: _steps(w) if w else w)


@F.pandas_udf(StringType())
def canon(values: pd.Series) -> pd.Series:
    """SC15: NFKC, case folding, punctuation to blanks, one blank between words."""
    def one(v):
        if v is None:
            return None
        v = unicodedata.normalize("NFKC", v).casefold()
        return " ".join("".join(c if c.isalnum() or c.isspace() else " " for c in v).split())

    return values.map(one)


@F.pandas_udf(DoubleType())
def fuzzy_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """SC46: 100 * 2 * matches / total letters."""
    return pd.Series([None if x is None or y is None else 100 * difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def _jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    reach = max(len(a), len(b)) // 2 - 1
    used, hits = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                hits.append(c)
                break
    if not hits:
        return 0.0
    other = [c for c, u in zip(b, used, strict=True) if u]
    m, t = len(hits), sum(x != y for x, y in zip(hits, other, strict=True)) / 2
    return (m / len(a) + m / len(b) + (m - t) / m) / 3


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """SC45: Jaro-Winkler similarity with a prefix weight of 0.1 over at most four letters."""
    def one(x, y):
        if x is None or y is None:
            return None
        j, p = _jaro(x, y), 0
        while p < min(4, len(x), len(y)) and x[p] == y[p]:
            p += 1
        return j + p * 0.1 * (1 - j)

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def jaccard(a: Column, b: Column) -> Column:
    """SC45: of two sets; two empty ones are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def match_score(name: Column, kind: Column, relations: Column, embedding: Column) -> Column:
    """SC48: weights .2, .1, .3, .4."""
    return 0.2 * name + 0.1 * kind + 0.3 * relations + 0.4 * embedding


def normalize_key(text: Column) -> Column:
    """SC16."""
    return F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]", "")


def smart_capitalize(text: Column, acronyms: tuple[str, ...] = ("usa", "un", "eu", "ngo", "ai"), small: tuple[str, ...] = ("of", "the", "and", "in", "for", "to", "a")) -> Column:
    """SC17."""
    def one(w, i):
        low = F.lower(w)
        return F.when(low.isin(*acronyms), F.upper(w)).when((i > 0) & low.isin(*small), low).otherwise(F.concat(F.upper(F.substr(w, F.lit(1), F.lit(1))), F.substr(low, F.lit(2))))

    return F.array_join(F.transform(F.split(F.trim(text), " +"), one), " ")


def canonical_score(text: Column, frequency: Column) -> Column:
    """SC18: capital first, not all capitals, single blanks, frequency."""
    return F.when(text.rlike("^[A-Z]"), 10).otherwise(0) + F.when(F.upper(text) != text, 5).otherwise(0) + F.when(~text.contains("  "), 3).otherwise(0) + frequency


def guest_name(about: Column, subtitle: Column) -> Column:
    """SC13: the words before " is " in the first sentence, else what follows the last " with " of the subtitle."""
    first = F.substring_index(about, ".", 1)
    return F.when(first.contains(" is "), F.trim(F.substring_index(first, " is ", 1))).when(subtitle.contains(" with "), F.trim(F.substring_index(subtitle, " with ", -1))).otherwise(F.lit("Guest"))


def clean_pdf_text(text: Column) -> Column:
    """SC14: lines of three and more signs that aren't numbers, blanks collapsed."""
    lines = F.transform(F.split(F.regexp_replace(text, "[ \t]+", " "), "\n"), lambda x: F.trim(x))
    return F.array_join(F.filter(lines, lambda x: (F.length(x) >= 3) & ~x.rlike(r"^\d+$")), "\n")


def rewrite_labels(labels: Column, stale: dict[str, str]) -> Column:
    """SC32: stale labels renamed; the first of equal ones stays."""
    names = F.create_map(*[F.lit(x) for kv in stale.items() for x in kv])
    return F.array_distinct(F.transform(labels, lambda x: F.coalesce(F.try_element_at(names, x), x)))


def episode_number(text: Column) -> Column:
    """SC34."""
    return F.when(F.lower(text).rlike(r"episode\s*\d+"), F.regexp_extract(F.lower(text), r"episode\s*(\d+)", 1).cast("int"))


def guest_topic(title: Column) -> Column:
    """SC33, SC54: (guest, topic) of "Episode 5 - Guest on Topic"."""
    rest = F.regexp_replace(title, r"^.*? [-–—] ", "")
    parts = F.split(rest, " on ", 2)
    return F.struct(F.trim(F.get(parts, F.lit(0))).alias("guest"), F.coalesce(F.trim(F.get(parts, F.lit(1))), F.lit("")).alias("topic"))


def shortened(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 3)), F.lit("..."))).otherwise(text)


def speech_text(text: Column) -> Column:
    """SC35: no markdown, links or citations; a final stop."""
    t = F.regexp_replace(text, r"\[([^\]]*)\]\([^)]*\)", "$1")
    t = F.regexp_replace(t, r"https?://\S+|[*_#`]|\[\d+\]", "")
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    return F.when((t != "") & ~t.rlike(r"[.!?]$"), F.concat(t, F.lit("."))).otherwise(t)


def file_name(text: Column) -> Column:
    """SC36."""
    t = F.regexp_replace(F.replace(F.replace(text, F.lit("&"), F.lit("and")), F.lit(" "), F.lit("_")), r'[<>:"/\\|?*]', "")
    return F.substring(t, 1, 200)


def wiki_links(text: Column) -> Column:
    return F.regexp_replace(text, r"\[\[([^\]]+)\]\]", '<a href="$1.html">$1</a>')


def html_escape(text: Column) -> Column:
    """SC55."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def mentions(text: Column) -> Column:
    """SC37: episode references, quoted phrases, capitalised phrases."""
    found = F.concat(F.regexp_extract_all(text, F.lit(r"[Ee]pisode \d+"), F.lit(0)), F.regexp_extract_all(text, F.lit(r'"([^"]{3,49})"'), F.lit(1)), F.regexp_extract_all(text, F.lit(r"[A-Z][a-z]+(?: [A-Z][a-z]+)+"), F.lit(0)))
    return F.array_distinct(found)


def topics(text: Column, names: list[str], most: int = 5) -> Column:
    """SC38: keywords in list order that stand in the text."""
    low = F.lower(text)
    return F.slice(F.filter(F.array(*[F.lit(n) for n in names]), lambda n: F.contains(low, n)), 1, most)


def p_true(text: Column, knowledge: Column, prior: Column, conflict: Column) -> Column:
    """SC22."""
    return 1 / (1 + F.exp(-(-1.2 + 2.1 * text + 0.9 * knowledge + 0.6 * prior - 0.8 * conflict.cast("int"))))


def properties(members: Column) -> Column:
    """SC47: flags by what any member contains, in capitals."""
    # Parts of relation names by property.
    parts = {
        "financial": ("FUND", "FINANC", "INVEST"),
        "knowledge_transfer": ("TEACH", "MENTOR", "EDUCAT"),
        "creative": ("CREATE", "PRODUCE", "BUILD"),
        "causal": ("CAUSE", "LEAD", "RESULT"),
        "attributive": ("HAS_", "CONTAIN", "POSSESS"),
    }
    def some(values):
        return F.exists(members, lambda m: any_of(m, values))

    return F.struct(*[some(v).alias(k) for k, v in parts.items()])


def window_of(text: str | None, words: list[str] | None, width: int) -> str | None:
    """The window around a place of a keyword with most keyword occurrences, the first of equal ones; the beginning if no keyword
    occurs. It ends at its last full stop if that lies in its last fifth."""
    if text is None:
        return None
    low, words = text.lower(), [w for w in words or [] if w]
    if len(low) != len(text):  # letters that small ones count differently: places are those of the text as written
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    places = sorted({m.start() for w in words for m in re.finditer(f"(?={re.escape(w)})", low)})
    if not places:
        return text[:width]
    starts = sorted({max(0, p - width // 2) for p in places})
    start = max(starts, key=lambda s: (sum(low.count(w, s, s + width) for w in words), -s))
    part = text[start : start + width]
    stop = part.rfind(".")
    return part[: stop + 1] if stop > len(part) * 0.8 else part


def best_window(text: Column, words: Column, width: int = 500) -> Column:
    """SC4: window_of() for each row."""

    @F.pandas_udf(StringType())
    def best(texts: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([window_of(t, None if w is None else list(w), width) for t, w in zip(texts, lists, strict=True)], dtype=object)

    return best(text, words)
