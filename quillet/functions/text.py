"""Text expressions: normalising, folding, tokens, ids in addresses, budgets and scores."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words that stay although they are short or common (fixed values).
FUNCTION_WORDS = [
    "el", "la", "els", "les", "un", "una", "uns", "unes", "de", "del", "dels", "a", "al", "als", "en", "amb", "per",
    "que", "què", "qui", "i", "o", "no", "si", "sí", "jo", "tu", "ell", "ella", "nosaltres", "vosaltres", "ells", "elles",
    "em", "et", "es", "se", "ens", "us", "li", "meu", "teu", "seu", "meva", "teva", "seva", "és", "ha", "han", "he", "fa", "ser",
    "més", "bé", "mai", "aquí", "allà", "avui", "ara", "com", "molt", "tot", "tots", "cada", "quan", "on",
]
#: Words that a lexicon leaves out (fixed values).
BLACKLIST = ["canco", "cancons", "mes"]


def _folds() -> tuple[str, str]:
    """Letters of the Latin blocks with marks, and their bases, by decomposition."""
    pairs = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        c = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(base) == 1 and base != c:
            pairs[c] = base
    return "".join(pairs), "".join(pairs.values())


MARKED, BARE = _folds()


def fold_accents(x: Column, keep_dot: bool = False) -> Column:
    """Letters without their marks; the middle dot goes unless kept."""
    out = F.regexp_replace(F.translate(x, MARKED, BARE), r"\p{M}+", "")
    return out if keep_dot else F.replace(out, F.lit("·"), F.lit(""))


def for_match(x: Column) -> Column:
    return fold_accents(F.lower(x))


#: White space that trimming takes away: Unicode's, and the four separators (fixed values).
BLANK = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: l and l with a stop, hyphen or dot between letters (fixed pattern).
DOUBLE_L = r"(?<=[a-zà-ú])l[.\-]l(?=[a-zà-ú])"


@F.pandas_udf(StringType())
def composed(x: pd.Series) -> pd.Series:
    """Canonical composition, which Spark has no function for: an Arrow step, made once at ingestion."""
    return x.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def strip(x: Column) -> Column:
    return F.regexp_replace(x, f"^[{BLANK}]+|[{BLANK}]+$", "")


def normalize(x: Column) -> Column:
    """Lower case, trimmed, one apostrophe, l·l between letters, three or more equal characters to two.

    Texts are taken to be in composed form: ``sources.readers.ingested`` brings them there.
    """
    x = F.translate(strip(F.lower(x)), "’‘´", "'''")
    x = F.regexp_replace(x, DOUBLE_L, "l·l")
    return F.regexp_replace(x, r"([^\n])\1{2,}", "$1$1")


#: An elided article, and words with inner dots (fixed patterns).
ELIDED, TOKEN = r"(?i)([ldsmtn])'", r"(?iu)[a-zàèéíòóúïüç]+(?:·[a-zàèéíòóúïüç]+)*"


def tokens(x: Column, keep_short: bool = True) -> Column:
    """Words after splitting off elided articles; single letters only if they are function words."""
    words = F.regexp_extract_all(F.regexp_replace(x, ELIDED, "$1 "), F.lit(TOKEN), F.lit(0))
    short = F.array(*(F.lit(w) for w in FUNCTION_WORDS))
    return F.filter(words, lambda w: (F.length(w) >= 2) | F.array_contains(short, w)) if keep_short else F.filter(words, lambda w: F.length(w) >= 2)


def split_words(x: Column) -> Column:
    return F.filter(F.split(F.lower(x), r"\s+"), lambda w: w != "")


def bigrams(x: Column) -> Column:
    """All pairs of neighbouring letters, left to right."""
    return F.when(F.length(x) >= 2, F.transform(F.sequence(F.lit(1), F.length(x) - 1), lambda i: F.substr(x, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


#: The longest texts with 0, 1, 2 and 3 edits; longer ones have 4 (fixed values).
BUDGETS = [3, 5, 9, 13]


def edit_budget(length: Column, cap: int = 4) -> Column:
    return F.least(sum(((length > n).cast("int") for n in BUDGETS), F.lit(0)), F.lit(cap))


def budget_of(length: int, cap: int = 4) -> int:
    return min(sum(length > n for n in BUDGETS), cap)


def distance_to_prob(d: Column, length: Column) -> Column:
    return F.exp(-3.0 * d / F.greatest(length, F.lit(2)))


def freq_factor(freq: Column) -> Column:
    return F.least(F.lit(1.0), F.log1p(freq) / F.log1p(F.lit(500.0)))


def candidate_score(tier: Column, distance: Column, freq: Column) -> Column:
    return tier * 10000.0 - distance * 100.0 + F.log1p(freq)


def matches_any(x: Column, terms: list[str]) -> Column:
    """Whether the folded text contains any folded term: folded once, met by one call a term."""
    folded = F.transform(F.array(for_match(x)), lambda t: F.exists(F.array(*(for_match(F.lit(w)) for w in terms)), lambda w: F.contains(t, w))) if terms else F.array(F.lit(False))
    return F.coalesce(F.get(folded, F.lit(0)), F.lit(False))


#: Where an 11-letter id stands in the addresses of the video site (fixed patterns).
VIDEO_PATTERNS = [
    r"youtube\.com/watch\?[^\s]*v=([A-Za-z0-9_-]{11})",
    r"youtu\.be/([A-Za-z0-9_-]{11})",
    r"youtube\.com/embed/([A-Za-z0-9_-]{11})",
    r"youtube\.com/shorts/([A-Za-z0-9_-]{11})",
    r"youtube-nocookie\.com/embed/([A-Za-z0-9_-]{11})",
    r"v=([A-Za-z0-9_-]{11})",
]


def video_id(x: Column) -> Column:
    x = F.trim(x)
    found = [F.when(F.regexp_like(x, F.lit(r"^[A-Za-z0-9_-]{11}$")), x)]
    found += [F.nullif(F.regexp_extract(x, p, 1), F.lit("")) for p in VIDEO_PATTERNS]
    return F.coalesce(*found)


def canonical_url(x: Column) -> Column:
    i = video_id(x)
    return F.when(i.isNotNull(), F.concat(F.lit("https://www.youtube.com/watch?v="), i)).otherwise(F.trim(x))


def packed_field(x: Column, name: str) -> Column:
    """The value after ``name:`` up to the next bar or the line's end; null where there is none."""
    got = F.regexp_extract(x, rf"(?d){re.escape(name)}:\s*(.*?)\s*(?:\||$|\n)", 1)
    return F.nullif(got, F.lit(""))


def duration_text(seconds: Column) -> Column:
    s = seconds.cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("%dh %dm %ds", h, m, r)).when(m > 0, F.format_string("%dm %ds", m, r)).otherwise(F.format_string("%ds", r))


def highlight(x: Column, terms: list[str]) -> Column:
    pattern = "|".join(re.escape(t) for t in sorted(terms, key=len, reverse=True))
    return F.regexp_replace(x, f"(?iu)({pattern})", "<mark>$1</mark>") if terms else x


def snippet(x: Column, n: int = 150) -> Column:
    flat = F.replace(x, F.lit("\n"), F.lit(" "))
    return F.when(F.length(x) > n, F.concat(F.substring(flat, 1, n), F.lit("…"))).otherwise(flat)


def passage(title: Column, artist: Column, genre: Column, text: Column) -> Column:
    e = F.lit("")
    return F.trim(F.concat(F.lit("passage: "), F.coalesce(title, e), F.lit(" by "), F.coalesce(artist, e), F.lit(". Genre: "), F.coalesce(genre, e), F.lit(". "), F.coalesce(text, e)))


def column_name(label: str) -> str:
    """A label as part of a column name."""
    return label.replace(" ", "").replace(",", "").replace("&", "And").replace("/", "Or")
