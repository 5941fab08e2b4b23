"""Text functions as column expressions; a few that need Unicode tables or state are Arrow-batched UDFs."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

# Digits of the Arabic script, marks that matching ignores, letters that are folded.
ARABIC_DIGITS, ASCII_DIGITS = "۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩", "01234567890123456789"
LETTERS_FROM, LETTERS_TO = "أإآٱيىئكةۀؤ", "اااایییکہہو"
NEGATIONS = ("no", "not", "never", "denied", "denies", "reject", "rejected", "without", "نہیں", "نہ", "انکار", "مسترد", "بغیر")
# Words of which one denies another of its group.
CONTRADICTIONS = (
    ("approved", "rejected", "منظور", "مسترد"),
    ("granted", "denied", "منظور", "انکار"),
    ("won", "lost", "جیت", "ہار", "فتح", "شکست"),
    ("increased", "decreased", "اضافہ", "کمی"),
    ("live", "dead", "alive", "killed", "زندہ", "ہلاک", "جاں", "بحق"),
    ("open", "closed", "کھلا", "بند"),
)
# Capitalised words that are no names, Urdu titles before names.
NO_NAMES = ("The", "A", "An", "After", "Before", "During", "Today", "Tonight", "Pakistan")
URDU_TITLES = ("وزیر اعظم", "وزیر اعلیٰ", "چیف جسٹس", "جسٹس", "سینیٹر", "ڈاکٹر", "جنرل", "چیئرمین")


def match_normalised(text: Column) -> Column:
    """Lower case, folded letters, without vowel marks and tatweel, single spaces (Latin and Arabic script)."""
    bare = F.regexp_replace(text, "[ـؐ-ًؚ-ٰٟۖ-ۭ]", "")
    return F.trim(F.regexp_replace(F.lower(F.translate(bare, LETTERS_FROM, LETTERS_TO)), r"[ \t\r\n\f]+", " "))


@F.pandas_udf(StringType())
def nfkc_match_normalised(texts: pd.Series) -> pd.Series:
    """The exact form: NFKC per character and full case folding, then as match_normalised."""
    fold, marks = str.maketrans(LETTERS_FROM, LETTERS_TO), re.compile("[ـؐ-ًؚ-ٰٟۖ-ۭ]")
    return texts.map(lambda t: None if t is None else " ".join("".join(unicodedata.normalize("NFKC", c) for c in marks.sub("", t)).translate(fold).casefold().split()))


def exact_key(text: Column) -> Column:
    """What exact repeats agree in: the normalised text with runs of punctuation, symbols and spaces made one space."""
    return F.trim(F.regexp_replace(match_normalised(text), r"[\p{P}\p{S} ]+", " "))


def exact_hash(text: Column) -> Column:
    return F.sha2(exact_key(text), 256)


def digit_folded(text: Column) -> Column:
    return F.translate(text, ARABIC_DIGITS, ASCII_DIGITS)


def tokens(text: Column) -> Column:
    """Distinct words, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(digit_folded(exact_key(text)), F.lit(r"[\p{L}\p{N}_؀-ۿ]+"), F.lit(0))))


def numbers(text: Column) -> Column:
    """Distinct numbers of the key, sorted: words of digits only. Separators are gone there, so 3.5 counts as 3 and 5."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(digit_folded(exact_key(text)), F.lit(r"(?<![\p{L}\p{N}_])[0-9]+(?![\p{L}\p{N}_])"), F.lit(0))))


def proper_names(text: Column) -> Column:
    """Runs of up to four capitalised or upper-case Latin words, and what follows an Urdu title, normalised and sorted."""
    word = r"(?:[A-Z][a-z]+|[A-Z]{2,})"
    found = F.regexp_extract_all(text, F.lit(rf"(?<![\p{{L}}\p{{N}}_]){word}(?:\s+{word}){{0,3}}(?![\p{{L}}\p{{N}}_])"), F.lit(0))
    kept = F.filter(found, lambda x: ~x.isin(*NO_NAMES))
    titled = F.regexp_extract_all(text, F.lit(rf"(?:{'|'.join(URDU_TITLES)})\s+([؀-ۿ]+(?:\s+[؀-ۿ]+){{0,2}})"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(F.concat(kept, titled), match_normalised)))


def negations(words: Column) -> Column:
    return F.array_intersect(words, F.array(*map(F.lit, NEGATIONS)))


def token_jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; two empty ones are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def names_compatible(a: Column, b: Column) -> Column:
    return a == b


def contradicts(a: Column, b: Column) -> Column:
    """Whether the token sets take different sides in one of the fixed oppositions."""
    pairs = F.array(*(F.array(*map(F.lit, p)) for p in CONTRADICTIONS))
    side = lambda words, p: F.array_sort(F.array_intersect(words, p))
    return F.exists(pairs, lambda p: (F.size(side(a, p)) > 0) & (F.size(side(b, p)) > 0) & (side(a, p) != side(b, p)))


def script_profile(text: Column) -> Column:
    arabic, latin = F.regexp_like(text, F.lit("[؀-ۿ]")), F.regexp_like(text, F.lit("[A-Za-z]"))
    return F.when(arabic & latin, "mixed").when(arabic, "ur").when(latin, "en").otherwise("unknown")


def edit_similarity(a: Column, b: Column) -> Column:
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def valid_unit(text: Column) -> Column:
    """At least eight letters or digits and three words."""
    return (F.regexp_count(text, F.lit(r"[\p{L}\p{N}]")) >= 8) & (F.size(F.regexp_extract_all(text, F.lit(r"[^ \n]+"), F.lit(0))) >= 3)


_ABBREVIATIONS = frozenset(("mr", "mrs", "ms", "dr", "prof", "gen", "col", "lt", "st", "no", "vs", "etc", "e.g", "i.e"))
_TERMINALS, _CLOSING = "۔؟!?.", "\"'”’)]}»"


def split_sentences(text: str) -> tuple[list[str], str]:
    """Finished sentences and what remains; a full stop after an abbreviation, an initial or inside a number is none."""
    out, start, at = [], 0, 0
    while at < len(text):
        c = text[at]
        if c in _TERMINALS:
            stop = True
            if c == ".":
                word = re.search(r"([^\s]*)$", text[start:at])[1]
                inside = at + 1 < len(text) and text[at + 1].isalnum()
                stop = not inside and word.lower() not in _ABBREVIATIONS and not (len(word) == 1 and word.isupper())
            if stop:
                at += 1
                while at < len(text) and text[at] in _TERMINALS + _CLOSING:
                    at += 1
                if piece := text[start:at].strip():
                    out.append(piece)
                start = at
                continue
        at += 1
    return out, text[start:].strip()


@F.pandas_udf(ArrayType(StringType()))
def sentences(texts: pd.Series) -> pd.Series:
    """Finished sentences, then the remainder if there is one."""
    return texts.map(lambda t: [] if t is None else (lambda s: s[0] + [s[1]] * bool(s[1]))(split_sentences(t)))


def merge_overlap(a: list[str], b: list[str]) -> tuple[list[str], str]:
    """Two token lists as one, and how: identical, contained, append, prepend or no_overlap (then a)."""
    if a == b:
        return a, "identical"
    joined = lambda x: "\x1f" + "\x1f".join(x) + "\x1f"
    if joined(b) in joined(a):
        return a, "contained"
    if joined(a) in joined(b):
        return b, "contained"
    for k in range(min(len(a), len(b)), 0, -1):
        if a[-k:] == b[:k]:
            return a + b[k:], "append"
        if b[-k:] == a[:k]:
            return b + a[k:], "prepend"
    return a, "no_overlap"


def overlap(a: Column, b: Column) -> Column:
    """The longest k with the last k tokens of a equal to the first k of b, as a column expression."""
    most = F.least(F.size(a), F.size(b))
    return F.coalesce(F.array_max(F.filter(F.when(most > 0, F.sequence(F.lit(1), F.greatest(most, F.lit(1)))), lambda k: F.slice(a, F.size(a) - k + 1, k) == F.slice(b, F.lit(1), k))), F.lit(0))


# Letters and joiners as recognised lines fold them.
_READING = str.maketrans({"ي": "ی", "ى": "ی", "ك": "ک", "ۀ": "ہ", "ة": "ہ", "ؤ": "و", "إ": "ا", "أ": "ا", "ٱ": "ا", "ـ": "", "‌": " ", "‍": "", "﻿": ""})
# Letters that the taxonomy's Urdu terms fold, and marks they drop.
_TERM, _TERM_MARKS = str.maketrans({"أ": "ا", "إ": "ا", "آ": "ا", "ٱ": "ا", "ي": "ی", "ى": "ی", "ئ": "ی", "ك": "ک", "ة": "ہ", "ۀ": "ہ", "ؤ": "و"}), re.compile(r"[ؐ-ًؚ-ٰٟٴۖ-ۭ]")
_PIECES = re.compile(r"[^\W_]+(?:[./:-][^\W_]+)*|[^\w\s]")
_LEFT, _RIGHT = frozenset(".,!?;:،؛۔؟)]}"), frozenset("([{")


def reading(text: str) -> str:
    """A recognised line: NFKC, folded letters, without marks, single spaces."""
    if text.isascii():
        return " ".join(text.split())
    folded = unicodedata.normalize("NFKC", text).translate(_READING)
    return " ".join("".join(c for c in folded if unicodedata.category(c) != "Mn").split())


def compared(text: str) -> str:
    """What two readings are compared by: letters and digits of the reading, in full case folding."""
    text = reading(text).casefold()
    kept = re.sub("[^a-z0-9]+", " ", text) if text.isascii() else "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in text)
    return " ".join(kept.split())


def term(text: str, language: str) -> str:
    """A taxonomy term: letters folded and marks dropped in Urdu, full case folding elsewhere."""
    text = unicodedata.normalize("NFKC", text).strip().replace("ـ", "")
    text = _TERM_MARKS.sub("", text).translate(_TERM) if language == "ur" else text.casefold()
    return re.sub(r"\s+", " ", text)


@F.pandas_udf(StringType())
def reading_text(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else reading(t))


@F.pandas_udf(StringType())
def compared_text(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else compared(t))


@F.pandas_udf(StringType())
def normalised_term(texts: pd.Series, languages: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else term(t, lang) for t, lang in zip(texts, languages)], dtype=object)


def number_runs(text: Column) -> Column:
    """Numbers of a reading in their order, with the separators inside them."""
    return F.regexp_extract_all(text, F.lit(r"\p{Nd}[\p{Nd},.:/-]*\p{Nd}|\p{Nd}"), F.lit(0))


@F.pandas_udf(StructType().add("normalised", StringType()).add("origin", ArrayType(IntegerType())))
def match_view(texts: pd.Series) -> pd.DataFrame:
    """The text as matching sees it (see nfkc_match_normalised), and for each of its characters its place in the original."""
    fold, marks = str.maketrans(LETTERS_FROM, LETTERS_TO), re.compile(r"[ـؐ-ًؚ-ٰٟۖ-ۭ]")

    def view(text: str | None) -> tuple[str | None, list[int] | None]:
        if text is None:
            return None, None
        out: list[str] = []
        origin: list[int] = []
        for at, original in enumerate(text):
            for c in marks.sub("", unicodedata.normalize("NFKC", original)).translate(fold).casefold():
                c = " " if c.isspace() else c
                if c != " " or out and out[-1] != " ":
                    out.append(c)
                    origin.append(at)
        if out and out[-1] == " ":
            out.pop(), origin.pop()
        return "".join(out), origin

    return pd.DataFrame(list(map(view, texts)), columns=["normalised", "origin"])


def original_span(origin: Column, start: Column, end: Column) -> Column:
    """The place in the original (end exclusive) of characters start to end of the normalised text; (0, 0) for none."""
    last = F.size(origin) - 1
    first = F.greatest(F.lit(0), F.least(start, last))
    until = F.greatest(first, F.least(end - 1, last))
    found = F.struct(F.get(origin, first).alias("start"), (F.get(origin, until) + 1).alias("end"))
    return F.when((last >= 0) & (start < end), found).otherwise(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end")))


def _key(piece: str) -> str:
    return piece.strip(".,!?;:،؛۔؟()[]{}\"'’”").casefold() or piece


def _written(pieces: list[str]) -> str:
    out = pieces[0] if pieces else ""
    for p in pieces[1:]:
        out += p if p in _LEFT or out[-1:] in _RIGHT else " " + p
    return out


def merge_readings(a: str, b: str) -> tuple[str, int, str]:
    """Two readings of one place as one text, the words they share, and how: by words alone, case and marks left out.

    Of equal readings the longer stays (the newer of two equally long), of contained ones the container, and where the end of one is the start of
    the other they are joined, the longer overlap first, the newer copy of the shared words kept when b continues a.
    """
    pieces = [_PIECES.findall(t) for t in (a, b)]
    places = [[k for k, p in enumerate(ps) if re.search(r"[^\W_]", p)] for ps in pieces]
    x, y = ([_key(ps[k]) for k in at] for ps, at in zip(pieces, places))
    holds = lambda big, small: bool(small) and any(big[k : k + len(small)] == small for k in range(len(big) - len(small) + 1))
    if x == y:
        return (b if len(b) >= len(a) else a), len(x), "identical"
    if holds(x, y):
        return a, len(y), "incoming_contained"
    if holds(y, x):
        return b, len(x), "existing_contained"
    lengths = range(min(len(x), len(y)), 0, -1)
    append = next((k for k in lengths if x[-k:] == y[:k]), 0)
    prepend = next((k for k in lengths if y[-k:] == x[:k]), 0)
    if prepend > append:
        return _written(pieces[1][: places[1][-prepend]] + pieces[0]), prepend, "prepend"
    if append:
        return _written(pieces[0][: places[0][-append]] + pieces[1]), append, "append"
    return a, 0, "no_overlap"
