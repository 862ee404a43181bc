"""Text expressions: redaction, two normalisers, counting and typos.

All of them are column expressions; but for typos they stay in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions.hashing import numbered_md5

# The 32 ASCII punctuation marks.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# Personal-data patterns, applied in this order.
PII_PATTERNS = {
    "email": r"\b[\w\.-]+@[\w\.-]+\.\w+\b",
    "us_phone": r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b",
    "ssn": r"\b\d{3}[-.\s]?\d{2}[-.\s]?\d{4}\b",
    "card": r"\b\d{13,19}\b",
}
REDACTED = "[REDACTED]"

# The standard English stop-word list.
STOP_WORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours
yourself yourselves he him his himself she she's her hers herself it it's its
itself they them their theirs themselves what which who whom this that that'll
these those am is are was were be been being have has had having do does did
doing a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down in
out on off over under again further then once here there when where why how all
any both each few more most other some such no nor not only own same so than too
very s t can will just don don't should should've now d ll m o re ve y ain aren
aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven
haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't
shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
""".split()

# Words the word tokeniser takes apart once punctuation is gone.
SPLIT_WORDS = {
    "cannot": "can not",
    "gimme": "gim me",
    "gonna": "gon na",
    "gotta": "got ta",
    "lemme": "lem me",
    "wanna": "wan na",
}
QUOTE_MARKS = "«“‘„»”’"

# Nouns whose singular no suffix rule gives, words that are no plurals included.
IRREGULAR_NOUNS = {
    "aches": "ache",
    "always": "always",
    "backaches": "backache",
    "brownies": "brownie",
    "caches": "cache",
    "calories": "calorie",
    "calves": "calf",
    "children": "child",
    "cookies": "cookie",
    "elves": "elf",
    "feet": "foot",
    "geese": "goose",
    "genies": "genie",
    "halves": "half",
    "headaches": "headache",
    "heroes": "hero",
    "hoodies": "hoodie",
    "hooves": "hoof",
    "knives": "knife",
    "lens": "lens",
    "lives": "life",
    "loaves": "loaf",
    "means": "means",
    "mice": "mouse",
    "movies": "movie",
    "news": "news",
    "oxen": "ox",
    "perhaps": "perhaps",
    "potatoes": "potato",
    "rookies": "rookie",
    "scarves": "scarf",
    "series": "series",
    "shelves": "shelf",
    "shoes": "shoe",
    "smoothies": "smoothie",
    "species": "species",
    "teeth": "tooth",
    "thieves": "thief",
    "ties": "tie",
    "tomatoes": "tomato",
    "toothaches": "toothache",
    "wives": "wife",
    "wolves": "wolf",
    "zombies": "zombie",
}

# Plural endings and their singulars, longest ending first.
PLURAL_RULES = [
    ("sses", "ss"),
    ("zzes", "zz"),
    ("ches", "ch"),
    ("shes", "sh"),
    ("xes", "x"),
    ("ies", "y"),
    ("men", "man"),
]
KEPT_ENDINGS = ("ss", "us", "is")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squash_spaces(text: Column | str) -> Column:
    """Every run of whitespace becomes one space; both ends trimmed."""
    return F.trim(F.regexp_replace(_col(text), r"(?U)\s+", " "))


def scrub_pii(text: Column | str) -> Column:
    out = _col(text)
    for pattern in PII_PATTERNS.values():
        out = F.regexp_replace(out, "(?U)" + pattern, REDACTED)
    return out


def drop_stop_words(tokens: Column) -> Column:
    return F.filter(tokens, lambda w: (w != "") & ~w.isin(STOP_WORDS))


#: The first part of a split word, the rest behind it.
_SPLIT_HEAD = rf"\b(?:{'|'.join(p.replace(' ', '(?=', 1) + r'\b)' for p in SPLIT_WORDS.values())})"
#: Punctuation and digits.
_DROPPED = "(?:[" + re.escape(PUNCTUATION) + r"]|\p{Nd})+"


def tokenize(text: Column) -> Column:
    """Words between white space, with the tokeniser's few splits applied first; a text that
    begins or ends with white space has an empty word there."""
    out = text
    for mark in QUOTE_MARKS:
        out = F.replace(out, F.lit(mark), F.lit(f" {mark} "))

    def apart(t: Column) -> Column:
        # A plain search costs little beside the pattern, which few texts need.
        held = F.lit(False)
        for word in SPLIT_WORDS:
            held = held | t.contains(word)
        return F.when(held, F.regexp_replace(t, _SPLIT_HEAD, "$0 ")).otherwise(t)

    # Bound by a lambda, so that the text is made once.
    return F.split(F.get(F.transform(F.array(out), apart), 0), r"(?U)\s+")


def singular(word: Column, lexicon: Mapping[str, str] | None = None) -> Column:
    """Noun lemma of a lower-case word without a dictionary: a short list first, then the
    plural rules. ``operators.lemmas`` takes a lexicon table instead of guessing."""
    rules = None
    for ending, replacement in PLURAL_RULES:
        stem = F.concat(F.substring(word, F.lit(1), F.length(word) - len(ending)), F.lit(replacement))
        fits = word.endswith(ending) & (F.length(word) > len(ending) + 1)
        rules = F.when(fits, stem) if rules is None else rules.when(fits, stem)
    kept = word.endswith(KEPT_ENDINGS[0])
    for ending in KEPT_ENDINGS[1:]:
        kept = kept | word.endswith(ending)
    rules = rules.when(
        word.endswith("s") & ~kept & (F.length(word) > 3),
        F.substring(word, F.lit(1), F.length(word) - 1),
    ).otherwise(word)
    entries = {**IRREGULAR_NOUNS, **(lexicon or {})}
    table = F.create_map(*[F.lit(part) for pair in entries.items() for part in pair])
    # Membership is a hash lookup; only listed words pay for the search of the map.
    return F.when(word.isin(list(entries)), F.element_at(table, word)).otherwise(rules)


def _lemmas(tokens: Column, lemmatise: bool, lexicon: Mapping[str, str] | None) -> Column:
    return F.transform(tokens, lambda w: singular(w, lexicon)) if lemmatise else tokens


def clean_plain(
    text: Column | str, lemmatise: bool = True, lexicon: Mapping[str, str] | None = None
) -> Column:
    """Lower-case, delete punctuation and digits, drop stop words, lemmatise.

    Punctuation is deleted without leaving a space. Null gives ''.
    """
    out = F.lower(F.coalesce(_col(text), F.lit("")))
    words = drop_stop_words(tokenize(F.regexp_replace(out, _DROPPED, "")))
    return F.array_join(_lemmas(words, lemmatise, lexicon), " ")


def clean_markup(
    text: Column | str, lemmatise: bool = True, lexicon: Mapping[str, str] | None = None
) -> Column:
    """Strip tags, keep only a-z words, drop stop words, lemmatise. Null gives ''."""
    out = F.regexp_replace(F.coalesce(_col(text), F.lit("")), r"<[^>]+>", " ")
    out = F.regexp_replace(F.lower(out), r"(?U)[^a-z\s]", " ")
    words = F.filter(tokenize(out), lambda w: w.rlike("^[a-z]+$"))
    return F.array_join(_lemmas(drop_stop_words(words), lemmatise, lexicon), " ")


def as_text(column: Column | str, data_type: T.DataType) -> Column:
    """A list, string or other value as one string; null stays null."""
    c = _col(column)
    if isinstance(data_type, T.StringType):
        return c
    if isinstance(data_type, T.ArrayType):
        return F.array_join(c.cast("array<string>"), " ")
    return c.cast("string")


def combine(columns: list[Column]) -> Column:
    """Columns joined by a space, missing ones as '', spaces squashed."""
    return squash_spaces(F.concat_ws(" ", *columns))


def words_of(text: Column | str) -> Column:
    """Whitespace-separated words; null or blank gives an empty array."""
    return F.array_remove(F.split(F.coalesce(_col(text), F.lit("")), r"(?U)\s+"), "")


def word_count(text: Column | str) -> Column:
    return F.size(words_of(text))


#: Unicode's white space, and what plain Python takes for such besides.
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE_RUN = re.compile(f"[{SPACES}]+")
_NO_SPACE = re.compile("[\x1c-\x1f]")
#: Texts whose words are held at once.
_TEXTS = 256


def _split(text: str) -> list[str]:
    """The words of ``words_of``."""
    return [w for w in _SPACE_RUN.split(text) if w] if _NO_SPACE.search(text) else text.split()


def _typos(cut: int, seed: int):
    """A function of texts and row keys; whole batches, as a word's typo takes many small steps."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, keys: pd.Series) -> pd.Series:
        out: list[str | None] = [None] * len(texts)
        places = [i for i, t in enumerate(texts) if isinstance(t, str)]
        for at in range(0, len(places), _TEXTS):
            part = places[at : at + _TEXTS]
            words = [_split(texts.iat[i]) for i in part]
            names = ["|".join([str(seed), *([keys.iat[i]] if isinstance(keys.iat[i], str) else []), ""]).encode() for i in part]
            for i, row, draws in zip(part, words, numbered_md5(names, list(map(len, words))), strict=True):
                out[i] = " ".join(changed(row, draws))
        return pd.Series(out, dtype=object)

    def changed(words: list[str], draws: np.ndarray) -> list[str]:
        hit = np.flatnonzero(draws[0] < cut)
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))[hit]
        # Two positions and the letter from seven hex digits each.
        one, two, three = (draws[1:, hit] >> np.uint32(4)).astype(np.int64)
        first = one % size
        second = (first + 1 + two % np.maximum(size - 1, 1)) % size
        low, high = np.minimum(first, second).tolist(), np.maximum(first, second).tolist()
        for i, a, b, letter in zip(hit.tolist(), low, high, (97 + three % 26).tolist(), strict=True):
            word = words[i]
            words[i] = word[:a] + word[b] + word[a + 1 : b] + word[a] + word[b + 1 :] if a < b else word + chr(letter)
        return words

    return run


def typos(text: Column | str, probability: float, seed: int, key: Column) -> Column:
    """Swap two characters in a share of the words; a 1-letter word gains one.

    The draw, the two positions and the added letter come from one md5 of
    (seed, row key, word position), so a retried task makes the same typos. Null stays null.
    Rows are drawn in Python whatever ``when`` stands around; give null for those not wanted.
    """
    cut = format(min(int(probability * 2**32), 2**32 - 1), "08x")

    return _typos(int(cut, 16), seed)(_col(text), key)
