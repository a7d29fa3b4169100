"""Toxicity: a convolutional text classifier in numpy, on hashed word embeddings.

Words are lower-cased, stripped of punctuation and hashed to HASHES; hashes that several labelled documents hold get
a row of the embedding, all others share a row of zeros. Filters of WIDTHS words slide over the whole text, each is
max-pooled, and a logistic layer reads the maxima. Gradients flow through the maxima alone; the first column of the
embedding starts as the word's log-odds, which is what keeps few documents enough.

All labelled documents that are not held out are counted, learned from, calibrated on and used for the thresholds. They
are dealt into FOLDS by a hash of the id; for each fold a model is made from the others alone, with words and counts of
its own, and gives the fold's rows their logits and a Platt sigmoid, moved to all labels' balance. The model that scores
learns from all folds and takes the mean of the sigmoids; for each language the threshold is that of the best F1 over the
rows of all folds, each counting for as many labelled documents as it stands for (DEFAULT where the language has under
30 labelled rows).

A score is read from the text only. For scoring, embedding and filters are multiplied out once, so that a word costs one
lookup and a few additions."""

from __future__ import annotations

import copy
import zlib
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.llm.common import Bounded, kept, slices, written
from kinlink.llm.labelled import everything, held_out, labelled

HASHES, SLOTS, SIZE, FILTERS, WIDTHS = 1 << 22, 40_000, 8, 8, (1, 2, 3)
EPOCHS, LEAST_STEPS, RATE, BATCH, FOLDS = 5, 150, 0.02, 32, 5
TINY = 1e-6  # with 1e-8 steps go on when gradients vanish, and models of the same rows differ in scale by chance
SHARD = 16 << 20
DEFAULT = 0.3
_PUNCTUATION = b"".join(bytes([c]) for c in range(33, 127) if not chr(c).isalnum())


def _word(chunk: bytes) -> int:
    return zlib.crc32(chunk.decode("utf-8", "replace").lower().encode().strip(_PUNCTUATION)) % HASHES


@kept
def _words() -> Bounded:
    return Bounded(_word, 200_000)


def hashed(data: bytes) -> np.ndarray:
    words = data.split()
    return np.fromiter(map(_words().__getitem__, words), np.int32, len(words))


class Model:
    """hashes (sorted) of the embedding's rows 1, 2, ...; row 0 is all other words."""

    def __init__(self, hashes, embedding, filters, bias, weight, offset):
        self.hashes, self.embedding, self.filters, self.bias, self.weight, self.offset = hashes, embedding, filters, bias, weight, offset
        self.scale, self.shift, self.thresholds = 1.0, 0.0, {}

    def params(self) -> list[np.ndarray]:
        return [self.embedding, *[part for f in self.filters for part in f], *self.bias, self.weight]

    def state(self) -> np.ndarray:
        return np.concatenate([*[q.ravel() for q in self.params()], [self.offset]]).astype("<f4")

    def load(self, state: np.ndarray) -> None:
        at = 0
        for q in self.params():
            q[...] = state[at : at + q.size].reshape(q.shape)
            at += q.size
        self.offset = float(state[-1])

    def tables(self):
        """For each row of the embedding its products with all parts of the filters, beside each other."""
        return np.concatenate([(self.embedding @ part).astype(np.float32) for f in self.filters for part in f], axis=1)

    def slots(self, words: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, words), max(0, len(self.hashes) - 1))
        return np.where(self.hashes[at] == words, at + 1, 0) if len(self.hashes) else np.zeros(len(words), int)

    def logit(self, pooled: np.ndarray) -> np.ndarray:
        return (np.maximum(pooled, 0) @ self.weight + self.offset) * self.scale + self.shift


PAD = np.zeros(max(WIDTHS) - 1, np.int64)


def pooled(slots: np.ndarray, tables: np.ndarray, bias, block: int = 1 << 12) -> np.ndarray:
    """The maximum of each filter over a text of any length, in overlapping blocks."""
    ids = np.concatenate([PAD, slots, PAD])
    best = [np.full(FILTERS, -np.inf, np.float32) for _ in WIDTHS]
    for at in range(0, len(ids) - len(PAD), block):
        x = tables.take(ids[at : at + block + len(PAD)], axis=0)
        first = 0
        for k, width in enumerate(WIDTHS):
            n = len(x) - width + 1
            z = x[:n, first : first + FILTERS]
            for j in range(1, width):
                z = z + x[j : j + n, first + j * FILTERS : first + (j + 1) * FILTERS]
            best[k] = np.maximum(best[k], z.max(axis=0))
            first += width * FILTERS
    return np.concatenate([b + c for b, c in zip(best, bias)])


def start(hashes: np.ndarray, df: np.ndarray, hit: np.ndarray, positive: int, negative: int, seed: int = 5) -> Model:
    """The model before any step, from the kept hashes, their documents and those of label 1, and the labels' documents."""
    rng = np.random.default_rng(seed)
    p, n = max(1, positive), max(1, negative)
    odds = np.log((hit + 0.5) / (p + 1)) - np.log((df - hit + 0.5) / (n + 1))
    odds *= 1 - 1 / np.sqrt(df)  # a word of few documents says little
    model = Model(hashes, np.zeros((len(hashes) + 1, SIZE)), [[rng.normal(0, 0.3, (SIZE, FILTERS)) for _ in range(w)] for w in WIDTHS], [np.zeros(FILTERS) for _ in WIDTHS], np.full(FILTERS * len(WIDTHS), 0.1), 0.0)
    model.embedding[1:] = rng.normal(0, 0.1, (len(hashes), SIZE))
    model.embedding[1:, 0] = odds
    for f in model.filters:
        for part in f:
            part[0] = np.abs(part[0]) + 0.2
    model.embedding, model.weight = model.embedding.astype(np.float32), model.weight.astype(np.float32)
    model.filters = [[part.astype(np.float32) for part in f] for f in model.filters]
    model.bias = [b.astype(np.float32) for b in model.bias]
    return model


def _tops(model: Model, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, block: int = 1 << 12):
    """For each width the maxima of the filters over each text, and their places in flat; in blocks, for texts of any length."""
    best = [np.full((len(starts), FILTERS), -np.inf, model.embedding.dtype) for _ in WIDTHS]
    places = [np.zeros((len(starts), FILTERS), np.int64) for _ in WIDTHS]
    every = np.concatenate([part.T for f in model.filters for part in f])
    first = np.cumsum([0, *WIDTHS])[:-1] * FILTERS
    for at in range(0, len(flat), block):
        x = every @ model.embedding[flat[at : at + block + len(PAD)]].T  # a row for each filter and place in it
        last = min(at + block, len(flat))
        mine = range(max(0, int(np.searchsorted(starts, at, "right")) - 1), int(np.searchsorted(starts, last)))
        for k, (f, width) in enumerate(zip(first, WIDTHS)):
            n = x.shape[1] - width + 1
            if n <= 0:
                continue
            z = x[f : f + FILTERS, :n]
            for j in range(1, width):
                z = z + x[f + j * FILTERS : f + (j + 1) * FILTERS, j : j + n]
            for d in mine:
                low, high = max(starts[d], at), min(starts[d] + lengths[d] - width + 1, last)
                if low < high:
                    part = z[:, low - at : high - at]
                    top = part.argmax(axis=1)
                    value = part[np.arange(FILTERS), top]
                    more = value > best[k][d]
                    best[k][d][more], places[k][d][more] = value[more], (top + low)[more]
    return [b + c for b, c in zip(best, model.bias)], places


def learn(model: Model, texts: list[np.ndarray], y: np.ndarray, passes: int, seed) -> None:
    """Adam over the texts (hashes of words) with their labels, some times, in the model itself. Rows of the embedding that
    have had no gradient yet don't move, so moments are kept for the others only (`moved`, in order of appearance)."""
    rng = np.random.default_rng(seed)
    slot = np.zeros(HASHES, np.int32)
    slot[model.hashes] = np.arange(1, len(model.hashes) + 1)
    ids = [np.concatenate([PAD, slot[t], PAD]).astype(np.int32) for t in texts]
    words, *params = model.params()
    first, second = [np.zeros_like(q) for q in params], [np.zeros_like(q) for q in params]
    moment, spread = np.zeros_like(words), np.zeros_like(words)
    moved, place, n_moved = np.zeros(len(words), np.int64), np.full(len(words), -1), 0
    m0 = v0 = 0.0
    step = 0
    for _ in range(passes):
        order = rng.permutation(len(ids))
        for at in range(0, len(order), BATCH):
            step += 1
            chosen = [ids[i] for i in order[at : at + BATCH]]
            target = y[order[at : at + BATCH]]
            flat = np.concatenate(chosen)
            lengths = np.array([len(c) for c in chosen])
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            maxima, places = _tops(model, flat, starts, lengths)
            h = np.concatenate(maxima, axis=1)
            active = np.maximum(h, 0)
            error = (1 / (1 + np.exp(-np.clip(active @ model.weight + model.offset, -30, 30))) - target) / len(target)
            error = error.astype(np.float32)
            back = error[:, None] * model.weight[None] * (h > 0)
            grads = [np.zeros_like(q) for q in params]
            grads[-1] = active.T @ error + 1e-4 * model.weight
            g, touched, pull = 0, [], []
            for k, (f, width) in enumerate(zip(model.filters, WIDTHS)):
                d, at_ = back[:, k * FILTERS : (k + 1) * FILTERS], places[k]
                for j in range(width):
                    rows = flat[at_ + j]
                    grads[g] = np.einsum("bfs,bf->sf", model.embedding[rows], d)
                    touched.append(rows.ravel())
                    pull.append((d[:, :, None] * f[j].T[None]).reshape(-1, SIZE))
                    g += 1
            for k in range(len(WIDTHS)):
                grads[g + k] = back[:, k * FILTERS : (k + 1) * FILTERS].sum(axis=0)
            rows, at_ = np.unique(np.concatenate(touched), return_inverse=True)
            gr = np.zeros((len(rows), SIZE), np.float32)
            np.add.at(gr, at_, np.concatenate(pull))
            gr[rows == 0] = 0
            new = rows[place[rows] < 0]
            place[new] = np.arange(n_moved, n_moved + len(new))
            moved[n_moved : n_moved + len(new)] = new
            n_moved += len(new)
            a, b = moment[:n_moved], spread[:n_moved]
            a *= 0.9
            b *= 0.999
            a[place[rows]] += 0.1 * gr
            b[place[rows]] += 0.001 * gr * gr
            words[moved[:n_moved]] -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + TINY)
            for q, gr, a, b in zip(params, grads, first, second):
                a += 0.1 * (gr - a)
                b += 0.001 * (gr * gr - b)
                q -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + TINY)
            gr = float(error.sum())
            m0, v0 = 0.9 * m0 + 0.1 * gr, 0.999 * v0 + 0.001 * gr * gr
            model.offset -= RATE * (m0 / (1 - 0.9**step)) / (np.sqrt(v0 / (1 - 0.999**step)) + TINY)


GRID = np.linspace(0.05, 0.95, 19).tolist()


def _sigmoid(u):
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), u))))


def calibrate(model: Model, logits: DataFrame, prior: float) -> None:
    """Platt's sigmoid on all rows (z, y, lang), moved from their balance of labels to `prior`. Newton's sums are made where
    the rows are."""
    n, p = logits.agg(F.count(F.lit(1)), F.sum("y")).head()
    n -= p
    a, b = model.scale, model.shift
    z, y = F.col("z"), F.col("y")
    goal = F.when(y == 1, (p + 1) / (p + 2)).otherwise(1 / (n + 2))
    for _ in range(50):
        rows = logits.withColumn("s", _sigmoid(z * a + b)).withColumns({"w": F.greatest(F.col("s") * (1 - F.col("s")), F.lit(1e-6)), "e": F.col("s") - goal})
        ez, e, wzz, wz, w = rows.agg(F.sum(F.col("e") * z), F.sum("e"), F.sum(F.col("w") * z * z), F.sum(F.col("w") * z), F.sum("w")).head()
        hess = np.array([[wzz + 1e-3, wz], [wz, w]]) + 1e-6 * np.eye(2)
        da, db = np.clip(np.linalg.solve(hess, np.array([ez + 1e-3 * (a - 1), e])), -1, 1)
        a, b = float(a - da), float(b - db)
        if max(abs(da), abs(db)) < 1e-10:
            break
    a, b = round(a, 9), round(b, 9)  # sums come in any order
    if p and n:
        b += float(np.log(prior / (1 - prior)) - np.log(p / n))
    model.scale, model.shift = max(a, 1e-3), b


def limit(model: Model, logits: DataFrame, prior: float) -> None:
    """A threshold for each language from all rows (z, y, lang). The counts at the thresholds are made where the rows are."""
    n, p = logits.agg(F.count(F.lit(1)), F.sum("y")).head()
    n -= p
    score = _sigmoid(F.col("z") * model.scale + model.shift)
    passed = sum((F.when(score >= t, 1).otherwise(0) for t in GRID), F.lit(0))
    at = {}
    for r in logits.where("lang is not null").groupBy("lang", "y", passed.alias("passed")).agg(F.count(F.lit(1)).alias("n")).collect():
        at.setdefault(r.lang, np.zeros((2, len(GRID) + 1)))[r.y, r.passed] += r.n
    stands = ((1 - prior) / n if n else 0.0, prior / p if p else 0.0)
    for name, have in sorted(at.items()):
        if have.sum() >= 30 and have[1].any():
            above = have[:, ::-1].cumsum(axis=1)[:, ::-1][:, 1:]  # rows of each label at each threshold or above
            f1 = 2 * stands[1] * above[1] / (stands[1] * (have[1].sum() + above[1]) + stands[0] * above[0])
            best = np.flatnonzero(f1 == f1.max())
            model.thresholds[name] = float(GRID[best[np.abs(np.array(GRID)[best] - DEFAULT).argmin()]])


def _packed(rows: DataFrame) -> tuple[DataFrame, int]:
    """One row for each shard of the documents, which are dealt by a hash of the id, and the number of shards; of rows that
    repeat an id one is kept. A shard holds some SHARD bytes of hashes."""
    shards = max(1, -(-(rows.agg(F.sum(F.octet_length("words"))).head()[0] or 0) // SHARD))

    def pack(key, d):
        d = d.sort_values(["id", "words"]).drop_duplicates("id")
        sizes = np.array([len(w) // 4 for w in d.words], "<i8").tobytes()
        fold = np.array([zlib.crc32(str(i).encode()) // 4 % FOLDS for i in d.id], np.int8)
        y = np.clip(d.label.to_numpy(), 0, 1).astype(np.int8)
        n = np.bincount(fold * 2 + y, minlength=2 * FOLDS).tolist()
        return pd.DataFrame([(key[0], n, y.tobytes(), fold.tobytes(), sizes, b"".join(d.words), [None if x is None or x != x else x for x in d.lang])], columns=["shard", "n", "y", "fold", "sizes", "words", "lang"])

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(shards)).cast("int")).repartition(shards, "shard")
    return written(dealt.groupBy("shard").applyInPandas(pack, "shard int, n array<long>, y binary, fold binary, sizes binary, words binary, lang array<string>")), shards


def _opened(batches, only: int | None = None, without: int | None = None):
    """Of each shard: its number, texts, labels, languages and folds; of one fold, of all but one, or of all."""
    for batch in batches:
        for r in batch.to_pylist():
            y, fold = np.frombuffer(r["y"], np.int8).astype(float), np.frombuffer(r["fold"], np.int8)
            words = np.split(np.frombuffer(r["words"], "<i4"), np.cumsum(np.frombuffer(r["sizes"], "<i8"))[:-1])
            use = np.flatnonzero(fold == only if only is not None else fold != (-1 if without is None else without))
            yield r["shard"], [words[i] for i in use], y[use], [r["lang"][i] for i in use], fold[use]


def _counted(packed: DataFrame) -> DataFrame:
    """(hash, df, hit, df0, hit0, ...): the documents that hold a word and those of label 1, in all and in each fold."""
    names = [f"{c}{k}" for k in range(FOLDS) for c in ("df", "hit")]

    def count(batches):
        for _, texts, y, _, fold in _opened(batches):
            each = [np.unique(t) for t in texts]
            sizes = [len(t) for t in each]
            hashes, at = np.unique(np.concatenate([*each, np.zeros(0, np.int32)]), return_inverse=True)
            at, y, fold = at.astype(np.int64), np.repeat(y, sizes) > 0, np.repeat(fold, sizes)
            columns = [np.bincount(at[(fold == k) & (y | (c == "df"))], minlength=len(hashes)) for k in range(FOLDS) for c in ("df", "hit")]
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int32()), *[pa.array(c, pa.int64()) for c in columns]], ["hash", *names])

    sums = packed.mapInArrow(count, "hash int" + "".join(f", {c} long" for c in names)).groupBy("hash").agg(*[F.sum(c).alias(c) for c in names])
    whole = [sum(F.col(f"{c}{k}") for k in range(FOLDS)).alias(c) for c in ("df", "hit")]
    return written(sums.select("hash", *whole, *names).where("df >= 3"))


def _averaged(states: DataFrame, shards: int) -> np.ndarray:
    """The mean of the shards' parameters, by their documents: sixteen at a time, so that few come to the driver."""
    def mean(key, d):
        d = d.sort_values("shard")
        total = sum(np.frombuffer(s, "<f4") * float(n) for s, n in zip(d.state, d.n)) / float(d.n.sum())
        return pd.DataFrame({"shard": [key[0]], "n": [d.n.sum()], "state": [total.astype("<f4").tobytes()]})

    while shards > 16:
        states = states.groupBy(F.floor(F.col("shard") / 16).cast("int").alias("group")).applyInPandas(mean, "shard int, n long, state binary")
        shards = -(-shards // 16)
    rows = sorted(states.collect())
    return sum(np.frombuffer(r.state, "<f4").astype(float) * r.n for r in rows) / sum(r.n for r in rows)


def _fitted(packed: DataFrame, counts: DataFrame, n: np.ndarray, shards: int, passes: int, without: int | None = None) -> Model:
    """A model from all folds, or from all but one; n has the documents of each fold and label.

    Each round takes the model through every shard on its own and averages the outcomes, weighted by documents; one shard
    alone takes all passes at once."""
    negative, positive = (n if without is None else np.delete(n, without, axis=0)).sum(axis=0).tolist()
    left = counts if without is None else counts.select("hash", (F.col("df") - F.col(f"df{without}")).alias("df"), (F.col("hit") - F.col(f"hit{without}")).alias("hit"))
    best = left.where("df >= 3").select("hash", "df", "hit").orderBy(F.desc("df"), "hash").limit(SLOTS)
    kept_words = np.array(sorted(tuple(r) for r in best.collect()), np.int64).reshape(-1, 3)
    model = start(kept_words[:, 0].astype(np.int32), kept_words[:, 1], kept_words[:, 2], positive, negative)
    rounds, passes = (EPOCHS, -(-passes // EPOCHS)) if shards > 1 else (1, passes)
    for turn in range(rounds):
        shared = packed.sparkSession.sparkContext.broadcast(model)

        def step(batches, shared=shared, turn=turn):
            for shard, texts, y, _, _ in _opened(batches, without=without):
                if texts:
                    mine = copy.deepcopy(shared.value)
                    learn(mine, texts, y, passes, (5, turn, shard))
                    yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(texts)], pa.int64()), pa.array([mine.state().tobytes()], pa.binary())], ["shard", "n", "state"])

        model.load(_averaged(packed.mapInArrow(step, "shard int, n long, state binary"), shards))
        shared.unpersist()
    return model


def _placed(packed: DataFrame, model: Model, only: int | None = None) -> DataFrame:
    """(z, y, lang): the logits, before any sigmoid, of one fold's rows, or of all."""
    shared = packed.sparkSession.sparkContext.broadcast(model)

    def place(batches):
        model = shared.value
        tables = model.tables()
        for _, texts, y, lang, _ in _opened(batches, only=only):
            z = [float(model.logit(pooled(model.slots(t), tables, model.bias))) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(z, pa.float64()), pa.array(y.astype(np.int32), pa.int32()), pa.array(lang, pa.string())], ["z", "y", "lang"])

    return written(packed.mapInArrow(place, "z double, y int, lang string"))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model | float:
    """A model from all labelled documents that are not held out. With only one label known, or none, a constant score.

    The documents are dealt into shards. Words, steps, sigmoid and thresholds rest on all of them: each fold is calibrated
    on by a model that hasn't seen it. Where some fold has all rows of a label, the model's own rows calibrate it."""
    known, numbers = labelled(labels, label)
    whole = sum(numbers.values())
    prior = sum(n for v, n in numbers.items() if v > 0) / whole if whole else 0.0
    if not 0 < prior < 1:
        return prior
    packed, shards = _packed(written(everything(docs, known, hashed)))
    n = np.array([r.n for r in packed.select("n").collect()]).reshape(-1, FOLDS, 2).sum(axis=0)
    if n.sum() < 8 or not n.sum(axis=0).all():
        return prior
    counts = _counted(packed)
    every, sigmoids = [], []
    crossed = bool((n < n.sum(axis=0)).all())
    fewest = int(n.sum() - n.sum(axis=1).max() * crossed)
    passes = max(EPOCHS, -(-LEAST_STEPS * BATCH * shards // fewest))  # a shard's share takes LEAST_STEPS too; all models the same, so that logits compare
    if crossed:
        last = 1.0, 0.0
        for k in reversed(np.flatnonzero(n.any(axis=1)).tolist()):
            part = _fitted(packed, counts, n, shards, passes, k)
            rows = _placed(packed, part, k)
            every.append(rows)
            if n[k].all():
                part.scale, part.shift = last  # Newton's steps begin at the fold's before
                calibrate(part, rows, prior)
                last = part.scale, part.shift
                sigmoids.append(last)
    model = _fitted(packed, counts, n, shards, passes)
    if sigmoids:
        model.scale, model.shift = np.mean(sigmoids, axis=0).tolist()
    else:
        every = [_placed(packed, model)]
        calibrate(model, every[0], prior)
    limit(model, reduce(DataFrame.unionByName, every), prior)
    return model


def scorer(model: Model):
    """bytes of a text -> its score."""
    slot, tables = dict(zip(model.hashes.tolist(), range(1, len(model.hashes) + 1))), model.tables()
    cache = Bounded(lambda chunk: slot.get(_word(chunk), 0), 200_000)

    def score(text: bytes) -> float:
        words = text.split()
        slots = np.fromiter(map(cache.__getitem__, words), np.int64, len(words))
        z = float(model.logit(pooled(slots, tables, model.bias)))
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))

    return score


def scored(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = DEFAULT) -> DataFrame:
    """One row per document: doc_id, held_out (never learned from), score (0 to 1), predicted (score >= threshold), and
    flagged (score at or above its language's threshold).

    Null and empty texts get the score of a text without known words. Repeated rows give repeated rows. Where labels are
    missing or all alike the score is the labels' mean (0 without any). An empty table gives no rows. Only the text
    makes the score; lang picks the threshold of flagged alone."""
    spark = docs.sparkSession
    model = train(docs, labels, label)
    thresholds = {} if isinstance(model, float) else model.thresholds
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        if isinstance(model, float):
            for batch in slices(batches):
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([model] * batch.num_rows, pa.float64())], ["doc_id", "lang", "score"])
            return
        score = scorer(model)
        for batch in slices(batches):
            out = [score(text) for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], ["doc_id", "lang", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, lang string, score double")
    line = F.lit(threshold)
    for name, value in sorted(thresholds.items()):
        line = F.when(F.col("lang") == name, value).otherwise(line)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), (F.col("score") >= line).alias("flagged"))


def clean(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """The documents that are not flagged, with the columns of docs. The score is made beside the row, so nothing is
    joined back; rows with a null id or text are judged like any other."""
    model = train(docs, labels, label)
    if isinstance(model, float):
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts):
        score = scorer(shared.value)
        for array in texts:
            yield pa.array([score(part.as_py()) for part in array], pa.float64())

    from collections.abc import Iterator

    run.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    line = F.lit(DEFAULT)
    for name, value in sorted(model.thresholds.items()):
        line = F.when(F.col("lang").cast("string") == name, value).otherwise(line)
    score = F.arrow_udf(run, "double")(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return docs.withColumns({"__score": score, "__line": line}).where("__score < __line").select(*docs.columns)
