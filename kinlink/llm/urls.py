"""URL filters, in DataFrame functions only: a blocked Bloom filter in front of an exact hash join.

A list holds canonical keys host + path with a verdict each. A key fits a url if the url's host is the key's or lies under
it and the url's path starts with the key's; the longest wins. So a url asks for each suffix of its host with a number of
labels that the list has and each prefix of its path of a length that the list has, whatever its own length. The filter
holds every key in one block of 256 bits (WORDS words, a bit in each), 8 keys a block. Up to INLINE blocks (1 MB) are a
literal in the scan; those of a longer list are a table that the questions are joined with, broadcast up to a checked
size. What passes goes to the exact join with the list, which takes the false positives out; the result doesn't depend
on the filter's size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinlink.llm.common import small

WORDS, INLINE = 4, 1 << 15
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Verdict, host, path.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; null or no :// gives ''."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ? # or the end; null or no :// gives ''."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _hash(key: Column) -> Column:
    return F.xxhash64(key)


def _block(h: Column, blocks: int) -> Column:
    return F.shiftrightunsigned(h, 24).bitwiseAND(F.lit(blocks - 1))


def _bit(h: Column, word: int) -> Column:
    return F.shiftrightunsigned(h, 6 * word).bitwiseAND(F.lit(63)).cast("int")


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """The filter of a table of keys (column key): a row (b, w0 .. ) for each block that isn't empty."""
    one = F.lit(1).cast("long")
    h = keys.select(_hash(F.col("key")).alias("h")).select(_block(F.col("h"), blocks).alias("b"), *[F.call_function("shiftleft", one, _bit(F.col("h"), i)).alias(f"w{i}") for i in range(WORDS)])
    return h.groupBy("b").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def _literal(filter_: DataFrame, blocks: int) -> Column:
    """The filter as an array of blocks * WORDS longs."""
    words = [0] * (blocks * WORDS)
    for row in filter_.collect():  # at most INLINE rows
        for i in range(WORDS):
            words[row.b * WORDS + i] = row[f"w{i}"]
    return F.array(*[F.lit(w) for w in words]) if len(words) <= 1024 else F.from_json(F.lit(str(words)), "array<bigint>")


def _has(h: Column, word) -> Column:
    """Whether all bits of a key's hash are set; word: number -> column."""
    ok = F.lit(True)
    for i in range(WORDS):
        ok = ok & (F.call_function("shiftrightunsigned", word(i), _bit(h, i)).bitwiseAND(F.lit(1)) == 1)
    return ok


def questions(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """All keys that would fit: suffixes of the host of the given numbers of labels (the host itself, if it has fewer) by
    prefixes of the path of the given lengths."""
    suffixes = F.array_distinct(F.array(*[F.substring_index(host, ".", -n) for n in labels]))
    cuts = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(cuts, lambda n: F.concat(s, F.substring(path, F.lit(1), n)))))


def passed(rows: DataFrame, keys: DataFrame, blocks: int, labels: list[int], lengths: list[int], inline: int = INLINE) -> DataFrame:
    """(host, path, key) of the questions that pass the filter, each once."""
    asked = questions(F.col("host"), F.col("path"), labels, lengths)
    if blocks <= inline:
        words = _literal(bloom(keys, blocks), blocks)
        met = F.filter(asked, lambda k: _has(_hash(k), lambda i: F.element_at(words, (_block(_hash(k), blocks) * WORDS + i + 1).cast("int"))))
        return rows.select("host", "path", F.explode(met).alias("key")).distinct()
    each = rows.select("host", "path", F.explode(asked).alias("key")).withColumn("h", _hash(F.col("key")))
    met = each.join(small(bloom(keys, blocks)), _block(F.col("h"), blocks) == F.col("b")).where(_has(F.col("h"), lambda i: F.col(f"w{i}")))
    return met.select("host", "path", "key").distinct()


def judged(pages: DataFrame, rules: DataFrame, otherwise: str = "allow", inline: int = INLINE) -> DataFrame:
    """One row per page: page_id, host, path, rule (the key that decides, or null), verdict (allow or block).

    rules: verdict, host, path. The longest key that fits decides (of equal lengths the greater by code point; of one key twice, block);
    where none fits the verdict is `otherwise`. A null url, or one without ://, has empty host and path and fits nothing.
    Hosts and paths of any length are judged whole. Repeated rows come back as often as they came; an empty table or list
    is allowed; other columns are not read."""
    keys = rules.select(F.concat("host", "path").alias("key"), "verdict").groupBy("key").agg(F.max("verdict").alias("verdict"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("__url"))
    rows = rows.select("page_id", host_of(F.col("__url")).alias("host"), path_of(F.col("__url")).alias("path"))
    listed = keys.count()
    if not listed:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict"))
    shapes = rules.select(F.size(F.split("host", r"\.", -1)).alias("labels"), F.length("path").alias("n")).distinct().collect()  # as many as there are shapes of keys
    labels, lengths = sorted({r.labels for r in shapes}), sorted({r.n for r in shapes})
    blocks = 1 << max(4, (listed // 8).bit_length())
    hits = passed(rows.select("host", "path"), keys, blocks, labels, lengths, inline)
    exact = hits.join(keys, "key").groupBy("host", "path").agg(F.max_by(F.struct("key", "verdict"), F.struct(F.length("key").alias("n"), F.col("key").alias("k"))).alias("best"))
    exact = exact.select(F.col("host").alias("__h"), F.col("path").alias("__p"), F.col("best.key").alias("rule"), F.col("best.verdict").alias("found"))
    met = rows.join(exact, (F.col("host") == F.col("__h")) & (F.col("path") == F.col("__p")), "left")
    return met.select("page_id", "host", "path", "rule", F.coalesce("found", F.lit(otherwise)).alias("verdict"))


def rule_table(spark, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")
