"""Secret scans: three patterns, and sliding-window entropy per character class over candidate strings.

A candidate is a run of the class's characters. A window of WINDOW characters slides over it; the counts of its
characters change by one in and one out, and so does the sum of c log2 c that the Shannon entropy is made of. Windows at
or above the class's threshold make a span, joined where they overlap, unless the allow-list knows the candidate or it
lies in a span of the patterns. An entropy span never takes a span of the patterns away."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.llm.common import release, slices, small_batches

#: The kinds of base spans in their order, with the patterns.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST = 12
CUE = re.compile(r"passw|secret|token|api")

WINDOW = 20
#: Kind, candidates, least entropy in bits of a window, what a candidate must have beside.
CLASSES = (
    ("entropy_hex", re.compile(r"(?<![A-Za-z0-9])[0-9A-Fa-f]{20,}(?![A-Za-z0-9])"), 3.0, re.compile(r"(?=.*[0-9])(?=.*[A-Fa-f])", re.S)),
    ("entropy_base64", re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 3.7, re.compile(r"(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])", re.S)),
    ("entropy_alnum", re.compile(r"(?<![A-Za-z0-9+/_=-])[a-z0-9]{20,}(?![A-Za-z0-9+/_=-])"), 3.7, re.compile(r"(?=.*[g-z])(?:.*?[0-9]){4}", re.S)),
)
#: Candidates that are never secrets: UUIDs, dates and paths, alphabets, one piece repeated, placeholders.
ALLOW = (
    re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),
    re.compile(r"\d{4}-\d{2}-\d{2}.*", re.S),
    re.compile(r"[A-Za-z/_=-]+"),
    re.compile(r"(.{1,8}?)\1{2,}.{0,8}", re.S),
)
ALLOW_PARTS = re.compile(r"(?i)example|abcdefgh|0123456789|xxxx|dummy|placeholder")
MASK = "[SECRET]"
_LOG = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]


def high_windows(text: str, least: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """The stretches of text that windows with an entropy of at least `least` bits cover."""
    counts: dict[str, int] = {}
    total, out = 0.0, []
    scale = math.log2(window)
    log = _LOG if window <= WINDOW else [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    for i, char in enumerate(text):
        have = counts.get(char, 0)
        counts[char] = have + 1
        total += log[have + 1] - log[have]
        if i >= window:
            gone = text[i - window]
            have = counts[gone]
            counts[gone] = have - 1
            total += log[have - 1] - log[have]
        if i >= window - 1 and scale - total / window >= least - 1e-9:
            lo = i - window + 1
            if out and out[-1][1] >= lo:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((lo, i + 1))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    spans = []
    if CUE.search(text.lower()):
        spans += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


class Covered:
    """Spans, to ask whether one of them holds a stretch."""

    def __init__(self, spans):
        ordered = sorted((s, e) for _, s, e in spans)
        self.starts, self.ends = [s for s, _ in ordered], list(accumulate((e for _, e in ordered), max))

    def holds(self, lo: int, hi: int) -> bool:
        at = bisect_right(self.starts, lo)
        return at > 0 and self.ends[at - 1] >= hi


def entropy_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    spans = []
    for kind, pattern, least, needs in CLASSES:
        known, found = Covered(base + spans), []
        for m in pattern.finditer(text):
            word = m[0]
            if not needs.match(word) or ALLOW_PARTS.search(word) or any(a.fullmatch(word) for a in ALLOW):
                continue
            stretches = ((lo + m.start(), hi + m.start()) for lo, hi in high_windows(word, least))
            found += [(kind, lo, hi) for lo, hi in stretches if not known.holds(lo, hi)]
        spans += found
    return spans


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan(text: str) -> tuple[list, list]:
    """(base spans, all spans) in code points, by start and then kind."""
    base = base_spans(text)
    every = base + entropy_spans(text, base)
    order = {k: i for i, k in enumerate((*KINDS, *(c[0] for c in CLASSES)))}
    return base, sorted(every, key=lambda s: (s[1], order[s[0]], s[2]))


def masked(text: str, spans) -> str:
    """text with each stretch that spans cover replaced by MASK."""
    out, at, open_to = [], 0, -1
    for _, lo, hi in sorted(spans, key=lambda s: (s[1], -s[2])):
        if lo < open_to:
            if hi > open_to:
                at = open_to = hi
            continue
        out += [text[at:lo], MASK]
        at = open_to = hi
    return "".join(out) + text[at:] if out else text


def scanned(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256 (of the joined base spans), spans (all, joined).

    Null and empty texts have no spans. Texts of any length are scanned whole. Repeated rows give repeated rows, an empty
    table gives none; rows with a null doc_id are scanned like any other; columns beside doc_id and text are not read."""

    def found(batches):
        for batch in slices(batches):
            out = []
            for text in batch.column(1).to_pylist():
                base, every = scan(text)
                kinds = [s[0] for s in base]
                out.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
            columns = list(zip(*out)) or [()] * 5
            arrays = [pa.array(list(c), t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()] * 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(found, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every span in text replaced by MASK, and n_chars, if there is one, made to fit. Null texts stay null;
    all rows and all other columns stay as they are."""

    def clean(texts):
        release()
        for array in texts:
            yield pa.array((None if t is None else masked(t, scan(t)[1]) for t in (x.as_py() for x in array)), pa.string(), size=len(array))

    clean.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    small_batches(docs.sparkSession)
    out = docs.withColumn("text", F.arrow_udf(clean, "string")("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
