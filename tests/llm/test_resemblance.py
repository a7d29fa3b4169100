"""Groups of near copies against all pairs of shingle sets and fingerprints."""

import random
from itertools import combinations

import numpy as np
import pytest

from kinlink.llm import resemblance, simhash

SHAPE = "doc_id long, text string, lang string, u int, v int, first int, key string, sig int, m int, id int"


def row(i, text):
    return (i, text, "en", 1, 2, 3, "k", 4, 5, 6)


def slow_groups(rows):
    """rows: (id, text) -> {id: smallest id of its group}, over all pairs."""
    rows = [(i, (t or "").encode()) for i, t in rows if i is not None]
    prints, sets = [simhash.fingerprint(t) for _, t in rows], []
    for _, t in rows:
        words = t.lower().split()
        sets.append({b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if (prints[i] ^ prints[j]).bit_count() <= 3 or (both and both >= 0.8 * len(sets[i] | sets[j])):
            a, b = find(rows[i][0]), find(rows[j][0])
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in root}


def check(frame, **kw):
    want = slow_groups([(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()])
    got = {r.u: r.v for r in resemblance.grouped(frame, **kw).collect()}
    assert got == {i: g for i, g in want.items() if g != i}
    return got


def test_tables(spark):
    assert check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"))


def edited(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("shard", [16, 2048])
def test_large_groups_and_levels(spark, shard):
    rng = random.Random(3)
    one, two = ([f"w{rng.randrange(5000)}" for _ in range(400)] for _ in range(2))
    rows = [row(1000 + i, edited(rng, one, 1)) for i in range(60)]  # a large group, each within a word or two of the others
    rows += [row(2000 + i, edited(rng, one, 6)) for i in range(10)]  # farther, but linked to the group
    rows += [row(3000 + i, edited(rng, one, 40)) for i in range(10)]  # under 0.8
    rows += [row(4000 + i, edited(rng, two, n)) for i, n in enumerate([0, 0, 2, 4, 8])]
    got = check(spark.createDataFrame(rows, SHAPE), shard=shard)
    assert all(got[2000 + i] == 1000 for i in range(10)) and not set(range(3000, 3010)) & set(got)


def test_odd_rows(spark):
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
    texts = [(1, None), (2, ""), (3, " \t"), (4, "One"), (5, "one"), (6, "a b c d e"), (7, "A b\tc d e"), (8, long), (9, long + " end"), (9, long + " end"), (10, "x" * 100_000), (None, long), (None, None)]
    frame = spark.createDataFrame([row(i, t) for i, t in texts], SHAPE)
    assert check(frame) == {2: 1, 3: 1, 5: 4, 7: 6, 9: 8}
    kept = resemblance.deduplicated(frame)
    assert kept.columns == frame.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "4", "6", "8", "10", "None", "None"])
    assert resemblance.deduplicated(frame.limit(0)).count() == 0
    once = resemblance.deduplicated(frame.where("doc_id = 9"))
    assert once.count() == 1


@pytest.mark.parametrize("n, edits", [(12, (0, 9)), (120, (0, 30)), (300, (3, 8))])
def test_pairs_are_settled_exactly(n, edits):
    """joined() against all pairs of sets; vantage points spare most measurements and lose no link."""
    rng = random.Random(n)
    words = [f"w{rng.randrange(5000)}" for _ in range(300)]
    sets = [resemblance.shingles(edited(rng, words, rng.randint(*edits)).encode()) for _ in range(n)]
    sig = np.stack([(resemblance.minima(s) & np.uint64(255)).astype(np.uint8) for s in sets])
    counted = []
    found = resemblance.joined(sig, np.arange(n), sets, counted)
    jaccard = {(i, j): 1 - resemblance.distance(sets[i], sets[j]) for i, j in combinations(range(n), 2)}
    assert all(jaccard[min(e), max(e)] >= 0.8 - 1e-9 for e in found)
    i, j = np.array([p for p, v in jaccard.items() if v >= 0.8 - 1e-12] or [(0, 0)]).T
    u, v = np.array(found or [(0, 0)]).T
    assert (simhash.roots(n, i, j) == simhash.roots(n, u, v)).all()
    assert counted[0] < n * (n - 1) / 2 or n < 20
    tied = resemblance.joined(sig, np.zeros(n, int), sets)
    assert (simhash.roots(n, *np.array(tied or [(0, 0)]).T) == simhash.roots(n, u, v)).all() or len(tied) <= len(found)


def test_an_id_with_several_texts(spark):
    """Rows that share an id are one document, so their texts' groups are one."""
    words = [f"w{i}" for i in range(60)]
    texts = [(1, " ".join(words)), (2, " ".join(words[::-1])), (3, " ".join(words)), (3, " ".join(words[::-1])), (4, "other words than those of the rest")]
    frame = spark.createDataFrame([row(i, t) for i, t in texts], SHAPE)
    assert check(frame) == {2: 1, 3: 1}


@pytest.mark.parametrize("shard", [24, 2048])
def test_groups_around_the_threshold(spark, shard):
    """Variants of a text with pairwise Jaccards of 0.75 to 0.85: heavier estimates of false pairs must not hide true ones."""
    rng = random.Random(11)
    rows = []
    for family, (n, edits) in enumerate([(40, (4, 5)), (60, (5, 5)), (100, (5, 6)), (150, (6, 6))]):
        words = [f"f{family}w{rng.randrange(5000)}" for _ in range(400)]
        rows += [row(1000 * (family + 1) + i, edited(rng, words, rng.randint(*edits))) for i in range(n)]
    check(spark.createDataFrame(rows, SHAPE), shard=shard)
