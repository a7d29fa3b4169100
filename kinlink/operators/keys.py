"""Blocking keys as expressions over a normalised table: the twelve passes, and the older schemes beside them.

A scheme maps a row to an array of keys; a null key (a null country, say) is dropped, repeats are kept."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinlink.functions import text

SEP = "|"
# Address words that make no key, and the passes' limits.
ADDR_STOP = (
    "near", "opposite", "opp", "beside", "behind", "next", "adjacent", "main", "road", "rd", "street", "st", "area", "locality", "gali",
    "lane", "ln", "cross", "sector", "phase", "block", "ward", "nagar", "colony", "layout", "extension", "ext", "circle", "square", "sq",
    "chowk", "market", "bazaar", "complex", "mall", "park", "building", "bldg", "tower", "floor", "camp", "post", "badi", "chauraha",
    "crossing", "the", "of", "and", "a", "an",
)
MAX_KEY_FREQ, MAX_PAIRS_PER_KEY, MAX_TOTAL_PAIRS = 4000, 900, 180_000_000
LIMITS = {
    "postal_ctry": (40_000, 30_000), "postal_nc": (40_000, 30_000), "house_ctry": (10_000, 6_000), "house_nc": (10_000, 6_000),
    "addr_bigram": (MAX_KEY_FREQ, 8_000), "ph_ctry": (MAX_KEY_FREQ, 8_000), "ph_nc": (MAX_KEY_FREQ, 8_000),
}


@dataclass(frozen=True)
class Pass:
    name: str
    keys: Callable[[], Column]
    max_freq: int = MAX_KEY_FREQ
    max_pairs: int = MAX_PAIRS_PER_KEY



def _distinct() -> Column:
    return F.array_distinct(F.array_compact(F.col("name_tokens")))


def _tagged(tag: str, scoped: bool, keys: Column) -> Column:
    head = F.concat(F.col("country_norm"), F.lit(f"{SEP}{tag}{SEP}")) if scoped else F.lit(f"{tag}{SEP}")
    return F.transform(keys, lambda k: F.concat(head, k))


def _address() -> Column:
    return F.split(F.col("addr_norm"), " ", -1)


def _first_two() -> Column:
    return _tagged("n", True, F.array(F.array_join(F.array_sort(F.slice(_distinct(), 1, 2)), SEP)))


def _phonetic(scoped: bool) -> Column:
    first = F.get(_distinct(), F.lit(0))
    return _tagged("sx", scoped, F.when(first.isNull(), F.array().cast("array<string>")).otherwise(F.array(text.soundex4(first))))


def _address_pairs() -> Column:
    words = F.array_sort(F.filter(_address(), lambda t: ~t.rlike(r"^\p{Nd}+$") & ~t.isin(*ADDR_STOP)))
    n = F.size(words)
    pairs = F.flatten(F.transform(words, lambda x, i: F.transform(F.filter(F.slice(words, i + 2, F.greatest(n, F.lit(1))), lambda y: y > x), lambda y: F.concat(x, F.lit(SEP), y))))
    return _tagged("ap", False, pairs)


def _postal(scoped: bool) -> Column:
    return _tagged("zz", scoped, F.filter(_address(), lambda t: t.rlike(r"^\p{Nd}{5,6}$")))


def _house(scoped: bool) -> Column:
    number = F.get(F.filter(_address(), lambda t: t.rlike(r"^\p{Nd}+$")), F.lit(0))
    street = F.get(F.filter(_address(), lambda t: t.rlike(r"^\P{Nd}+$") & ~t.isin(*ADDR_STOP)), F.lit(0))
    return _tagged("hn", scoped, F.array_compact(F.array(F.concat(number, F.lit(SEP), street))))


PASSES: dict[str, Callable[[], Column]] = {
    "ct2": _first_two,
    "pairs_ctry": lambda: _tagged("np", True, text.pairs_in_row(F.array_sort(_distinct()), SEP)),
    "pairs_nc": lambda: _tagged("np", False, text.pairs_in_row(F.array_sort(_distinct()), SEP)),
    "tok_ctry": lambda: _tagged("nt", True, _distinct()),
    "tok_nc": lambda: _tagged("nt", False, _distinct()),
    "ph_ctry": lambda: _phonetic(True),
    "ph_nc": lambda: _phonetic(False),
    "addr_bigram": _address_pairs,
    "postal_ctry": lambda: _postal(True),
    "postal_nc": lambda: _postal(False),
    "house_ctry": lambda: _house(True),
    "house_nc": lambda: _house(False),
}


def passes(names=None, uniform: bool = False) -> list[Pass]:
    """The passes with their own limits; uniform gives all of them the defaults."""
    return [Pass(n, PASSES[n], *(() if uniform else LIMITS.get(n, ()))) for n in (names or PASSES)]


#: Passes whose keys come from the address; those of the others come from the name.
ADDRESS = ("addr_bigram", "postal_ctry", "postal_nc", "house_ctry", "house_nc")


def refined(passes: list[Pass]) -> list[Pass]:
    """The passes, and a finer one with the same limits for each. Its keys are the pass's with the record's other field (the
    name for keys of addresses, else the address), so that rows of a key over its limits meet where that field is equal."""
    return [*passes, *(Pass(f"{p.name}+", p.keys, p.max_freq, p.max_pairs) for p in passes)]


# Older schemes: keys from the first two tokens, by different rules, and from addresses.


def _scoped(key: Column) -> Column:
    return F.concat(F.col("country_norm"), F.lit(SEP), key)


def positional() -> Column:
    """First two tokens by place, sorted."""
    return F.array(_scoped(F.array_join(F.array_sort(F.slice(F.array_compact(F.col("name_tokens")), 1, 2)), " ")))


def phonetic_at(place: int) -> Column:
    return F.array(F.concat(F.col("country_norm"), F.lit("|SX|"), text.soundex4(F.get(F.array_compact(F.col("name_tokens")), F.lit(place)))))


def significant_two() -> Column:
    """First two tokens that are no stop words, sorted; none if there are none."""
    two = F.slice(F.filter(F.col("name_tokens"), lambda t: ~t.isin(*text.NAME_STOP)), 1, 2)
    return F.when(F.size(two) > 0, F.array(_scoped(F.array_join(F.array_sort(two), SEP)))).otherwise(F.array().cast("array<string>"))


def smallest_two() -> Column:
    """The two smallest distinct tokens."""
    return F.array(_scoped(F.array_join(F.slice(F.array_sort(_distinct()), 1, 2), " ")))


def name_pairs(scoped: bool = True) -> Column:
    pairs = text.pairs_in_row(F.array_sort(_distinct()))
    return F.transform(pairs, _scoped) if scoped else pairs


def _address_words() -> Column:
    return F.filter(_address(), lambda t: t != "")


def address_ends() -> Column:
    """The first two and the last two words, from two words on."""
    w = _address_words()
    ends = F.array(F.array_join(F.slice(w, 1, 2), " "), F.array_join(F.slice(w, F.greatest(F.size(w) - 1, F.lit(1)), 2), " "))
    return F.when(F.size(w) >= 2, ends).otherwise(F.array().cast("array<string>"))


def address_threes() -> Column:
    """The three smallest distinct words, and the first three."""
    w = _address_words()
    three = F.array(F.array_join(F.slice(F.array_sort(F.array_distinct(w)), 1, 3), " "), F.array_join(F.slice(w, 1, 3), " "))
    return F.when(F.size(w) > 0, three).otherwise(F.array().cast("array<string>"))


def soundex_bucket() -> Column:
    """Country and code of the first token; none without a code."""
    code = text.soundex4(F.get(F.array_compact(F.col("name_tokens")), F.lit(0)))
    return F.when(code != "", F.array(F.concat(F.col("country_norm"), F.lit("_"), code))).otherwise(F.array().cast("array<string>"))


DIAGNOSTIC = {"ct2f": smallest_two, "pairf": name_pairs, "sdx0": lambda: phonetic_at(0), "ak": address_ends}
ESTIMATE = {"f2k": smallest_two, "np": lambda: name_pairs(False), "sdx0": lambda: phonetic_at(0), "ak": address_threes}


def long_keys(norm: DataFrame, wanted: dict[str, Callable[[], Column]] | list[Pass], finer: bool = False) -> DataFrame:
    """(entity_id, pass, key): one scan for all passes; null and empty keys are dropped, repeats kept. finer: with the keys of
    the finer passes that refined() names."""
    named = {p.name: p.keys for p in wanted} if isinstance(wanted, list) else wanted

    def tagged(name: str, keys: Column) -> Column:
        return F.transform(keys, lambda k: F.struct(F.lit(name).alias("pass"), k.alias("key")))

    arrays = F.array(*[tagged(name, make()) for name, make in named.items()])
    rows = norm.select("entity_id", *(["name_norm", "addr_norm"] if finer else []), F.explode(F.flatten(F.filter(arrays, lambda a: a.isNotNull()))).alias("k"))
    if finer:
        other = F.when(F.col("k.pass").isin(*ADDRESS), F.col("name_norm")).otherwise(F.col("addr_norm"))
        also = F.struct(F.concat("k.pass", F.lit("+")).alias("pass"), F.concat("k.key", F.lit(SEP * 2), other).alias("key"))
        rows = rows.where("length(k.key) > 0").select("entity_id", F.explode(F.array("k", also)).alias("k"))
    return rows.select("entity_id", "k.pass", "k.key").where("key is not null and length(key) > 0")


def without_tokens(norm: DataFrame, dropped: DataFrame) -> DataFrame:
    """norm with the tokens of dropped (column token) taken out of name_tokens, their order kept."""
    held = norm.select("entity_id", F.posexplode("name_tokens").alias("i", "token")).join(dropped, "token", "left_anti")
    lists = held.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("i", "token"))).alias("l")).select(F.col("entity_id").alias("__e"), F.transform("l", lambda x: x["token"]).alias("__t"))
    return norm.join(lists, F.col("entity_id") == F.col("__e"), "left").withColumn("name_tokens", F.coalesce("__t", F.array().cast("array<string>"))).drop("__e", "__t")
