"""Token counts and ids: a map-side lookup in two tiers, without any shuffle of words.

Tier one is a compact table of frequent words, built from a bounded sample of all rows and broadcast (at most TABLE words). Tier two
is a cache in each worker, bounded too; what is in neither is encoded by the library. Both tiers hold what the library
gives for a word, so the sample decides the speed and never the result.

A text is cut at ASCII white space. That is exact for files whose pre-tokenizer drops white space and whose normalizer
works within words (NFC, lower case): no pre-token, merge or special string reaches over it. splits_at_space() checks
it from the file; for any other file whole texts are encoded.
"""

from __future__ import annotations

import array
import json
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.llm.common import kept, slices, small_batches

TABLE, SAMPLE, CACHE, WORDS = 50_000, 1000, 300_000, 150_000
LIMIT = 2048
SIGNS = b".,;:!?"


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@kept
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@kept
def library(path: str):
    """bytes -> list of ids, by the library the file is for."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda data: model.encode(data.decode("utf-8", "replace"))
    tokenizer = _tokenizer(path)
    return lambda data: tokenizer.encode(data.decode("utf-8", "replace"), add_special_tokens=False).ids


@kept
def splits_at_space(path: str) -> bool:
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    steps = [spec.get("pre_tokenizer") or {}]
    steps = steps[0].get("pretokenizers", steps)
    first = steps[0] if steps else {}
    forms = [spec.get("normalizer") or {}]
    forms = forms[0].get("normalizers", forms)
    local = all(f.get("type") in ("NFC", "Lowercase") or (f.get("type") == "Replace" and f.get("pattern") == {"Regex": r"\s+"} and f.get("content") == " ") for f in forms)
    pattern = (first.get("pattern") or {}).get("Regex", r"\s")
    drops = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True and " " not in pattern and r"\s" not in pattern.replace(r"[^\s", "")
    plain = all(not set(" \t\n\v\f\r") & set(t["content"]) and not t.get("lstrip") and not t.get("rstrip") for t in spec.get("added_tokens", []))
    model = spec.get("model") or {}
    return local and drops and plain and model.get("type") == "BPE" and not spec.get("post_processor")


@kept
def letters_only(path: str):
    """str of letters -> ids, past normalizer and pre-tokenizer; None where the file doesn't take such a word as one
    pre-token, lower-cased and byte by byte. Only letters below U+0250 go this way: their lower case is one letter, and
    neither NFC nor a table of another Unicode version changes them."""
    if not splits_at_space(path):
        return None
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    forms = [f.get("type") for f in (spec.get("normalizer") or {}).get("normalizers", [])]
    pattern = (steps[0].get("pattern") or {}).get("Regex", "") if steps else ""
    whole = pattern.endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+") and all(x.startswith("'") for x in pattern.split("|[")[0].split("|"))
    if not (whole and len(steps) == 2 and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex") and forms[-1:] == ["Lowercase"]):
        return None
    model = _tokenizer(path).model
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    table = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def ids(word: str) -> list[int]:
        return [t.id for t in model.tokenize(word if word.isascii() else "".join(map(table.__getitem__, word.encode())))]

    return ids


class Chunks(dict):
    """What `make` says of the ids of chunks without white space; of up to CACHE short ones it is kept. A word of letters
    with signs after it, by far the most frequent kind, is put together (+) from the word's and the signs' part, each kept
    too; all else goes through the whole library. Words come by falling frequency, so what comes first comes often."""

    def __init__(self, path: str, make):
        self.encode, self.direct, self.make = library(path), letters_only(path), make
        self.words, self.signs = {}, {}

    def __missing__(self, chunk: bytes):
        out = self.answer(chunk)
        if len(self) < CACHE and len(chunk) <= 64:
            self[chunk] = out
        return out

    def answer(self, chunk: bytes):
        if self.direct:
            word = chunk.rstrip(SIGNS)
            low = word.lower() if word.isalpha() else self.lowered(word)  # of bytes, isalpha() knows ASCII letters only
            if low:
                out = self.words.get(low)
                if out is None:
                    out = self.make(self.direct(low.decode()))
                    if len(self.words) < WORDS and len(low) <= 64:
                        self.words[low] = out
                if len(word) == len(chunk):
                    return out
                tail = chunk[len(word) :]
                if tail not in self.signs and len(self.signs) < 10_000:
                    self.signs[tail] = self.make(self.encode(tail))
                return out + (self.signs.get(tail) or self.make(self.encode(tail)))
        return self.make(self.encode(chunk))

    @staticmethod
    def lowered(word: bytes) -> bytes:
        """A word of letters below U+0250 in lower case, else nothing."""
        text = word.decode("utf-8", "replace")
        if text.isalpha() and max(text) < "\u0250":
            low = text.lower()
            if len(low) == len(text):
                return low.encode()
        return b""


def code_of(path: str) -> str:
    """The array type that holds an id of this file: two bytes where they suffice."""
    if path.endswith(".json"):
        return "H" if _tokenizer(path).get_vocab_size() <= 1 << 16 else "I"
    return "I"


@kept
def _lengths(path: str) -> Chunks:
    return Chunks(path, len)


@kept
def _packed(path: str, code: str) -> Chunks:
    return Chunks(path, lambda ids: array.array(code, ids).tobytes())


def count(data: bytes, path: str) -> int:
    """The number of tokens of one text."""
    if not splits_at_space(path):
        return len(library(path)(data))
    return sum(map(_lengths(path).__getitem__, data.split()))


def packed_ids(data: bytes, path: str, code: str) -> bytes:
    """The ids of one text, in the machine's order of bytes, each of the size of `code`."""
    if not splits_at_space(path):
        return array.array(code, library(path)(data)).tobytes()
    return b"".join(map(_packed(path, code).__getitem__, data.split()))


def frequent(docs: DataFrame, path: str) -> dict[bytes, int]:
    """The lengths of the most frequent words: TABLE words of at most 64 bytes, of some SAMPLE rows drawn from all of the
    table (a share of each partition, so what is counted doesn't grow with their number). Each partition's sample is
    counted where it is read; sums are added up in Spark, and only the table comes to the driver."""
    if not splits_at_space(path):
        return {}
    rows = docs.count()

    def counted(batches):
        words: Counter = Counter()
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                words.update(w for w in text.split() if len(w) <= 64)
        yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())], ["word", "times"])

    texts = docs.select(F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")).where(F.rand(7) < SAMPLE / max(1, rows))
    top = texts.mapInArrow(counted, "word binary, times long").groupBy("word").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "word").limit(TABLE)
    length = Chunks(path, len)
    return {bytes(r.word): length[bytes(r.word)] for r in top.collect()}


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens).

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows give repeated rows; columns beside doc_id and text are
    not read. An empty table gives an empty result. Texts of any length are counted whole."""
    path = path or default_path()
    spark = docs.sparkSession
    small_batches(spark)
    table = spark.sparkContext.broadcast(frequent(docs, path))

    def counted(batches):
        if splits_at_space(path):
            cache = _lengths(path)
            if len(cache) < CACHE:
                cache.update(table.value)
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            sizes = [count(t, path) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(sizes, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    out = rows.mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
