"""Text functions as Catalyst expressions: normalised names and addresses, tokens, phonetic codes.

Null text is read as empty: names give '' and an empty list, addresses ''. A null country stays null."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and abbreviations that results depend on.
STOPWORDS = ("the", "and", "of", "for")
BUSINESS_SUFFIXES = (
    "inc", "incorporated", "llc", "ltd", "limited", "corp", "corporation", "co", "company", "group", "plc", "llp", "pvt", "private", "pty",
    "trust", "trustees", "sarl", "sas", "sa", "eurl", "sarll", "gmbh", "ag", "kg", "kft", "srl", "spzoo", "holding",
)
ADDRESS_EXPANSION = {
    "rd": "road", "st": "street", "ave": "avenue", "av": "avenue", "blvd": "boulevard", "hwy": "highway", "ct": "court", "dr": "drive",
    "ln": "lane", "pkwy": "parkway", "ter": "terrace", "tpke": "turnpike", "pl": "place", "cir": "circle", "sq": "square",
    "n": "north", "e": "east", "s": "south", "w": "west", "ne": "northeast", "nw": "northwest", "se": "southeast", "sw": "southwest",
    "nr": "near", "no": "number", "nos": "numbers", "po": "post office", "opp": "opposite", "r": "rue", "b": "bis",
}
US_STATES = {
    "al": "alabama", "ak": "alaska", "az": "arizona", "ar": "arkansas", "ca": "california", "co": "colorado", "ct": "connecticut",
    "de": "delaware", "fl": "florida", "ga": "georgia", "hi": "hawaii", "id": "idaho", "il": "illinois", "in": "indiana", "ia": "iowa",
    "ks": "kansas", "ky": "kentucky", "la": "louisiana", "me": "maine", "md": "maryland", "ma": "massachusetts", "mi": "michigan",
    "mn": "minnesota", "ms": "mississippi", "mo": "missouri", "mt": "montana", "ne": "nebraska", "nv": "nevada", "nh": "new hampshire",
    "nj": "new jersey", "nm": "new mexico", "ny": "new york", "nc": "north carolina", "nd": "north dakota", "oh": "ohio", "ok": "oklahoma",
    "or": "oregon", "pa": "pennsylvania", "ri": "rhode island", "sc": "south carolina", "sd": "south dakota", "tn": "tennessee",
    "tx": "texas", "ut": "utah", "vt": "vermont", "va": "virginia", "wa": "washington", "wv": "west virginia", "wi": "wisconsin",
    "wy": "wyoming", "dc": "district of columbia",
}
NAME_STOP = (
    "and", "the", "of", "at", "by", "for", "in", "co", "ltd", "llc", "inc", "pvt", "gmbh", "corp", "dr", "mr", "mrs", "ms", "smt", "shri",
    "sri", "prof", "district", "private", "limited",
)
STREET_STOP = (
    "road", "rd", "street", "st", "avenue", "ave", "lane", "ln", "nagar", "colony", "layout", "extension", "sector", "phase", "block",
    "ward", "circle", "cross", "main", "market", "area", "near", "opp", "opposite", "behind", "beside", "next",
)
LATIN_EXTENDED = ((0x00C0, 0x00FF), (0x0100, 0x017F), (0x0180, 0x024F), (0x1E00, 0x1EFF))
#: First code points of the nine scripts, in the order they are looked for. All are laid out like the first.
INDIC_BLOCKS = (0x0900, 0x0C00, 0x0C80, 0x0B80, 0x0D00, 0x0A80, 0x0980, 0x0A00, 0x0B00)
#: Romanised letters by their place in a block: vowels, vowel signs, consonants, other signs.
VOWELS = {0x05: "a", 0x06: "A", 0x07: "i", 0x08: "I", 0x09: "u", 0x0A: "U", 0x0B: "RRi", 0x0C: "LLi", 0x0E: "e", 0x0F: "e", 0x10: "ai", 0x12: "o", 0x13: "o", 0x14: "au"}
SIGNS = {0x3E: "A", 0x3F: "i", 0x40: "I", 0x41: "u", 0x42: "U", 0x43: "RRi", 0x46: "e", 0x47: "e", 0x48: "ai", 0x4A: "o", 0x4B: "o", 0x4C: "au"}
CONSONANTS = {
    0x15: "k", 0x16: "kh", 0x17: "g", 0x18: "gh", 0x19: "~N", 0x1A: "ch", 0x1B: "Ch", 0x1C: "j", 0x1D: "jh", 0x1E: "~n", 0x1F: "T", 0x20: "Th",
    0x21: "D", 0x22: "Dh", 0x23: "N", 0x24: "t", 0x25: "th", 0x26: "d", 0x27: "dh", 0x28: "n", 0x2A: "p", 0x2B: "ph", 0x2C: "b", 0x2D: "bh",
    0x2E: "m", 0x2F: "y", 0x30: "r", 0x31: "R", 0x32: "l", 0x33: "L", 0x35: "v", 0x36: "sh", 0x37: "Sh", 0x38: "s", 0x39: "h",
}
OTHERS = {0x01: ".N", 0x02: "M", 0x03: "H", 0x3D: ".a", 0x50: "OM", **{0x66 + d: str(d) for d in range(10)}}
VIRAMA = 0x4D


@lru_cache(maxsize=1)
def _folds() -> tuple[str, str]:
    """Letters whose canonical decomposition is one letter and marks, and those letters."""
    pairs = []
    for code in range(0xC0, 0x2000):
        bare = [c for c in unicodedata.normalize("NFD", chr(code)) if unicodedata.category(c) != "Mn"]
        if len(bare) == 1 and bare[0] != chr(code):
            pairs.append((chr(code), bare[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def has_latin_extended(text: Column) -> Column:
    return text.rlike("[" + "".join(f"\\u{lo:04X}-\\u{hi:04X}" for lo, hi in LATIN_EXTENDED) + "]")


def is_ascii(text: Column) -> Column:
    return ~text.rlike(r"[^\x00-\x7f]")


def fold_latin(text: Column) -> Column:
    """Accented letters as their base letters; combining marks dropped; letters without a decomposition stay."""
    return F.regexp_replace(F.translate(text, *_folds()), r"\p{Mn}", "")


def fold_text(text: Column) -> Column:
    """fold_latin, white space squeezed, trimmed, lower case."""
    return F.lower(squeeze(fold_latin(text)))


def squeeze(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def romanised(text: str | None) -> str | None:
    """One of nine Indic scripts in ASCII letters, lower case; whatever else isn't ASCII becomes a space."""
    if text is None:
        return None
    base = next((b for b in INDIC_BLOCKS if any(b <= ord(c) < b + 0x80 for c in text)), INDIC_BLOCKS[0])
    out, open_ = [], False  # open_: a consonant waits for its vowel
    for c in text:
        place = ord(c) - base
        if open_ and place not in SIGNS and place != VIRAMA:
            out.append("a")
        open_ = False
        if place in CONSONANTS:
            out.append(CONSONANTS[place])
            open_ = True
        elif place != VIRAMA:
            out.append(SIGNS.get(place) or VOWELS.get(place) or OTHERS.get(place) or (c if ord(c) < 128 else " "))
    return " ".join("".join(out + ["a"] * open_).split()).lower()


def romanise(text: Column) -> Column:
    """romanised() in Arrow batches; rows that are null cost nothing but their place."""
    import pandas as pd

    def run(series: pd.Series) -> pd.Series:
        return series.map(romanised, na_action="ignore")

    run.__annotations__ = {"series": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")(text)


def tokens(text: Column) -> Column:
    """Lower-case words: apostrophes deleted, ASCII punctuation and any white space between."""
    plain = F.lower(F.translate(text, "'’‘", ""))
    spaced = F.regexp_replace(plain, r"[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+", " ")
    return F.filter(F.split(spaced, r"(?U)\s+"), lambda t: t != "")


def transliterated(text: Column, scripts: bool = True) -> Column:
    """ASCII as it is; with Latin accents folded; else, if scripts, romanised (the one place that needs Python)."""
    latin = has_latin_extended(text)
    other = romanise(F.when(~is_ascii(text) & ~latin, text)) if scripts else F.lower(squeeze(F.regexp_replace(text, r"[^\x00-\x7f]", " ")))
    return F.when(is_ascii(text), text).when(latin, fold_text(text)).otherwise(other)


def norm_name(name: Column, scripts: bool = True, fold: bool = True) -> Column:
    """The name's words without stop words and without the legal forms at its end, joined by spaces."""
    raw = F.replace(F.coalesce(name, F.lit("")), F.lit("&"), F.lit(" and "))
    words = F.filter(tokens(transliterated(raw, scripts) if fold else raw), lambda t: ~t.isin(*STOPWORDS))
    suffixes = "|".join(BUSINESS_SUFFIXES)
    return F.regexp_replace(F.array_join(words, " "), f"(^| )(?:(?:{suffixes})(?: |$))+$", "")


def words_of(norm: Column) -> Column:
    """A normalised name's tokens; none for an empty one."""
    return F.filter(F.split(norm, " "), lambda t: t != "")


def _looked_up(table: dict[str, str], token: Column) -> Column:
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.element_at(entries, token), token)


def norm_address(address: Column) -> Column:
    """Words of the comma-separated regions. A two-letter state is spelled out where a state can stand: in the last two
    places of the last region, at the start of an only region, or alone in the first; other abbreviations anywhere."""
    raw = F.replace(F.coalesce(address, F.lit("")), F.lit("&"), F.lit(" and "))
    regions = F.transform(F.split(raw, ",", -1), tokens)
    last = F.size(regions) - 1

    def spelled(region: Column, i: Column) -> Column:
        n = F.size(region)
        start = (i == 0) & ((last == 0) | (n == 1))
        tail = (last > 0) & (i == last)
        return F.transform(region, lambda t, p: F.when((start & (p == 0)) | (tail & (p >= n - 2) & ~t.rlike(r"^\p{Nd}+$")), _looked_up(US_STATES, t)).otherwise(t))

    flat = F.flatten(F.transform(regions, spelled))
    return F.array_join(F.transform(flat, lambda t: _looked_up(ADDRESS_EXPANSION, t)), " ")


def norm_country(country: Column) -> Column:
    return F.lower(F.regexp_replace(country, r"(?U)^\s+|\s+$", ""))


def soundex4(word: Column) -> Column:
    """A phonetic code of four characters in which equal codes merge over vowels too; '' without ASCII letters."""
    letters = F.regexp_replace(F.lower(word), "[^a-z]", "")
    digits = F.translate(letters, "bfpvcgjkqsxzdtlmnraeiouyhw", "111122222222334556")
    for d in "123456":
        digits = F.regexp_replace(digits, f"{d}+", d)
    first = F.substring(letters, 1, 1)
    rest = F.when(first.isin(*"aeiouyhw"), digits).otherwise(F.substr(digits, F.lit(2)))
    return F.when(letters == "", F.lit("")).otherwise(F.concat(F.upper(first), F.rpad(F.substring(rest, 1, 3), 3, "0")))


def first_significant(tokens_: Column) -> Column:
    """The first token that is no stop word, or ''."""
    return F.coalesce(F.get(F.filter(tokens_, lambda t: ~t.isin(*NAME_STOP)), F.lit(0)), F.lit(""))


def pairs_in_row(sorted_tokens: Column, sep: str = " ") -> Column:
    """All pairs of a list, joined by sep, the earlier one first; in the row, without a join."""
    n = F.size(sorted_tokens)
    return F.flatten(F.transform(sorted_tokens, lambda x, i: F.transform(F.slice(sorted_tokens, i + 2, F.greatest(n, F.lit(1))), lambda y: F.concat(x, F.lit(sep), y))))


def house_number(address: Column) -> Column:
    return F.regexp_extract(address, r"\b(\d+)\b", 1)


def postal_code(address: Column) -> Column:
    return F.regexp_extract(address, r"\b(\d{5,6})\b", 1)


def street_words(address: Column) -> Column:
    """Distinct words of letters only that are no street words."""
    return F.array_distinct(F.filter(F.split(address, r"(?U)\s+"), lambda t: t.rlike(r"^\p{L}+$") & ~t.isin(*STREET_STOP)))


def split_bucket(entity_id: Column) -> Column:
    """0 to 9 by the id's MD5."""
    return (F.conv(F.substring(F.md5(entity_id), 1, 8), 16, 10).cast("long") % 10).cast("int")
