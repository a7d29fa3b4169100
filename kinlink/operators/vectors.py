"""Candidates from embeddings: texts, a pluggable encoder, exact and cell-probed neighbours, contrastive pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinlink.operators.labels import random_negatives
from kinlink.sources import io


def record_text(norm: DataFrame) -> DataFrame:
    """(entity_id, text): name and address with a space between, null parts empty."""
    return norm.select("entity_id", F.concat(F.coalesce("name_norm", F.lit("")), F.lit(" "), F.coalesce("addr_norm", F.lit(""))).alias("text"))


def hashed_ngrams(texts: DataFrame, size: int = 256, n: int = 3) -> DataFrame:
    """(entity_id, embedding): counts of character n-grams hashed by MD5 to `size` places, of length 1. The default encoder; any
    table (entity_id, embedding) of a trained one can stand in for it. A text without n-grams gives zeros."""
    padded = F.concat(F.lit(" "), F.trim("text"), F.lit(" "))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - n + 1, F.lit(1))), lambda i: (F.conv(F.substring(F.md5(F.substr(padded, i, F.lit(n))), 1, 8), 16, 10).cast("long") % size))
    each = texts.select("entity_id", F.explode(grams).alias("slot")).groupBy("entity_id", "slot").agg(F.count(F.lit(1)).cast("double").alias("n"))
    dense = each.groupBy("entity_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("slot").cast("int"), "n"))).alias("m"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("len"))
    return dense.select("entity_id", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (F.coalesce(F.element_at("m", i), F.lit(0.0)) / F.col("len"))).alias("embedding"))


def encoded(texts: DataFrame, encode, size: int) -> DataFrame:
    """(entity_id, embedding) by any encoder: a function from a list of texts to as many rows of `size` numbers, called
    on Arrow batches in the workers. Vectors are scaled to length 1; null texts are empty."""
    import numpy as np
    import pandas as pd

    def vectors(batches):
        for batch in batches:
            found = np.asarray(encode(batch.text.fillna("").tolist()), np.float64).reshape(len(batch), size)
            length = np.linalg.norm(found, axis=1, keepdims=True)
            yield pd.DataFrame({"entity_id": batch.entity_id, "embedding": (found / np.where(length > 0, length, 1)).tolist()})

    return texts.select("entity_id", "text").mapInPandas(vectors, "entity_id string, embedding array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    """v scaled to length 1; zeros stay. The length is bound as a variable: within the loop over the components it would be
    worked out for each of them."""
    scaled = lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(F.transform(v, lambda x: x.cast("double")))
    return F.get(F.transform(F.array(F.sqrt(dot(v, v))), scaled), F.lit(0))


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("entity_id_l").orderBy(F.desc(F.round("cosine", 9)), "entity_id_r")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _sides(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    pick = lambda d, s: d.select(F.col("entity_id").alias(f"entity_id_{s}"), normalised(F.col("embedding")).alias(f"v_{s}")).where(f"v_{s} is not null")
    return pick(left, "l"), pick(right, "r")


def knn_exact(left: DataFrame, right: DataFrame, k: int = 50, block: int = 2048) -> DataFrame:
    """(entity_id_l, entity_id_r, rank, cosine): the k nearest right rows of each left row, itself left out. Rows of
    equal vectors on a side are searched as one. Both sides are dealt into blocks and met tile by tile; each tile keeps its
    best before they are ranked together."""
    import numpy as np
    import pandas as pd

    members, r = _sides(left, right)
    reps = members.groupBy("v_l").agg(F.min("entity_id_l").alias("g"))
    l = reps.select(F.col("g").alias("entity_id_l"), "v_l")  # noqa: E741
    # of equal right rows only the first k by id can be among the k nearest, and one more as a row is not its own neighbour
    first = Window.partitionBy("v_r").orderBy("entity_id_r")
    r = r.withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= k + 1)
    r = r.groupBy("v_r").agg(F.array_sort(F.collect_list("entity_id_r")).alias("ids")).select(F.col("ids")[0].alias("entity_id_r"), "v_r", "ids")
    lb, rb = (max(1, -(-d.count() // block)) for d in (l, r))

    def tile(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"entity_id_l": [], "entity_id_r": [], "cosine": [], "ids": []}).astype({"entity_id_l": str, "entity_id_r": str, "ids": object})
        b = b.sort_values("entity_id_r")
        x, y = np.array(a.v_l.tolist()), np.array(b.v_r.tolist())
        c = x @ y.T
        top = np.argsort(-np.round(c, 9), axis=1, kind="stable")[:, : k + 1]
        return pd.DataFrame({"entity_id_l": np.repeat(a.entity_id_l.to_numpy(), top.shape[1]), "entity_id_r": b.entity_id_r.to_numpy()[top].ravel(), "cosine": np.take_along_axis(c, top, 1).ravel(), "ids": b.ids.to_numpy()[top].ravel()})

    here = lambda d, s, n: F.pmod(F.xxhash64(f"entity_id_{s}"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    la = l.withColumn("i", here(l, "l", lb)).withColumn("j", every(rb))
    ra = r.withColumn("j", here(r, "r", rb)).withColumn("i", every(lb))
    found = _best(la.groupBy("i", "j").cogroup(ra.groupBy("i", "j")).applyInPandas(tile, "entity_id_l string, entity_id_r string, cosine double, ids array<string>"), k + 1)
    near = _best(found.select("entity_id_l", F.explode("ids").alias("entity_id_r"), "cosine"), k + 1).select(F.col("entity_id_l").alias("g"), "entity_id_r", "cosine")
    own = members.join(reps.hint("merge"), "v_l").select("entity_id_l", "g")
    return _best(own.join(near.hint("merge"), "g").where("entity_id_l <> entity_id_r").select("entity_id_l", "entity_id_r", "cosine"), k)


def cells(vectors: DataFrame, n: int, sample: int = 100_000, seed: int = 42) -> list[list[float]]:
    """Centres of n cells, by k-means on a sample of at most `sample` rows."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.withColumn("__u", F.xxhash64("entity_id", F.lit(seed))).orderBy("__u").limit(sample)
    model = KMeans(k=n, seed=seed, maxIter=10).fit(rows.select(array_to_vector(normalised(F.col("embedding"))).alias("features")))
    return [[float(x) for x in c] for c in model.clusterCenters()]


def _around(x, centres):
    """Distances of the rows of x to each centre; rows with components that are no numbers have none."""
    import numpy as np

    return np.sqrt(np.maximum(0, (x**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1)[None] - 2 * x @ centres.T))


def _unit_rows(v):
    """Vectors as rows of length 1 in double precision; zeros stay."""
    import numpy as np

    x = np.array(v.tolist(), np.float64)
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(length == 0, 1, length)


def _tops(a, b, k: int, chunk: int = 256):
    """The k nearest rows of b (columns id, v) for each of a, ties to the smaller id, itself left out: places in a, places
    in b sorted by id, cosines. Rows of a may come with kth: what lies below is left out."""
    import numpy as np

    x, y, own, ids = _unit_rows(a.v), _unit_rows(b.v), a.id.to_numpy(), b.id.to_numpy()
    lo, hi = (np.searchsorted(ids, own, side) for side in ("left", "right"))
    least = a.kth.fillna(-2).to_numpy() if "kth" in a else np.full(len(x), -2.0)
    width, out = len(y), []
    for at in range(0, len(x), chunk):
        c = x[at : at + chunk] @ y.T
        # a whole number for each pair, larger for a larger rounded cosine, then for a smaller id
        order = np.rint(np.nan_to_num(c, nan=-2.0) * 1e9).astype(np.int64) * width + np.arange(width - 1, -1, -1)
        for i in np.flatnonzero(lo[at : at + chunk] < hi[at : at + chunk]):
            order[i, lo[at + i] : hi[at + i]] = -(1 << 62)
        top = np.argpartition(-order, k - 1, axis=1)[:, :k] if k < width else np.broadcast_to(np.arange(width), order.shape)
        cosine = np.take_along_axis(c, top, 1)
        keep = (np.take_along_axis(order, top, 1) > -(1 << 62)) & ~(cosine < least[at : at + chunk, None] - 2e-9)
        out.append((at + np.nonzero(keep)[0], top[keep], cosine[keep]))
    return [np.concatenate(part) for part in zip(*out)]


#: Components of the vectors of a tile's side.
TILE = 1 << 21


def knn_cells(left: DataFrame, right: DataFrame, centres: list[list[float]], probes: int = 8, k: int = 50) -> DataFrame:
    """Like knn_exact, and with its result: the `probes` cells nearest to a left row are searched first (every right row
    is in its one cell). Of the others those are left out that can't hold a nearer row than the kth found, by the cell's
    radius around its centre. Cells are dealt into tiles of bounded size, whose cosines are exact products of matrices;
    vectors travel as they come. What the probes found is written: it is read for the bounds and for the result."""
    import numpy as np
    import pandas as pd

    spark = right.sparkSession
    table = spark.sparkContext.broadcast(np.array(centres))
    rows = max(64, TILE // max(1, len(centres[0])))
    pick = lambda d: d.select(F.col("entity_id").cast("string").alias("id"), F.col("embedding").alias("v")).where("id is not null and v is not null")
    l, r = pick(left), pick(right)  # noqa: E741

    def place(v: pd.Series) -> pd.DataFrame:
        if not len(v):
            return pd.DataFrame({"cell": np.zeros(0, np.int32), "away": np.zeros(0)})
        apart = _around(_unit_rows(v), table.value)
        cell = np.argsort(apart, axis=1, kind="stable")[:, 0]
        return pd.DataFrame({"cell": cell.astype(np.int32), "away": apart[np.arange(len(cell)), cell]})

    place.__annotations__ = {"v": pd.Series, "return": pd.DataFrame}
    dealt = r.withColumn("p", F.pandas_udf(place, "cell int, away double")("v")).select("id", "v", "p.cell", "p.away")
    n, radius = np.zeros(len(centres), np.int64), np.full(len(centres), -np.inf)
    for x in dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).collect():
        n[x.cell], radius[x.cell] = x.n, x.radius
    known = spark.sparkContext.broadcast((n, radius))
    parts = F.array(*[F.lit(int(max(1, -(-m // rows)))) for m in n])
    blocks = max(1, -(-l.count() // rows))

    def near(v: pd.Series, kth: pd.Series) -> pd.Series:
        """The cells beyond the probes that may hold a nearer row."""
        if not len(v):
            return pd.Series([], dtype=object)
        x, (count, far) = _unit_rows(v), known.value
        apart = _around(x, table.value)
        order = np.argsort(apart, axis=1, kind="stable")
        # |x - y|^2 = |x|^2 + |y|^2 - 2 x.y with |y| of 1 or 0: a row with a cosine of kth or more, as rounded, is no farther than reach
        reach = np.sqrt(np.maximum(0, (x**2).sum(axis=1) + 1 - 2 * (kth.fillna(-np.inf).to_numpy() - 2e-9))) + 1e-6
        may = ~(apart - far[None] > reach[:, None]) & (count > 0)[None]  # a bound that is no number closes no cell
        return pd.Series([[int(i) for i in o[probes:] if m[i]] for o, m in zip(order, may)])

    def first_cells(v: pd.Series) -> pd.Series:
        return pd.Series(np.argsort(_around(_unit_rows(v), table.value), axis=1, kind="stable")[:, :probes].astype(np.int32).tolist() if len(v) else [])

    def tile(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"entity_id_l": pd.Series(dtype=str), "entity_id_r": pd.Series(dtype=str), "cosine": pd.Series(dtype=float)})
        b = b.sort_values("id")
        i, j, cosine = _tops(a, b, k)
        return pd.DataFrame({"entity_id_l": a.id.to_numpy()[i], "entity_id_r": b.id.to_numpy()[j], "cosine": cosine})

    first_cells.__annotations__ = {"v": pd.Series, "return": pd.Series}
    near.__annotations__ = {"v": pd.Series, "kth": pd.Series, "return": pd.Series}
    part_of = lambda m: F.pmod(F.xxhash64("id"), m).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), m - 1))
    base = dealt.withColumn("part", part_of(F.get(parts, F.col("cell")))).select("cell", "part", every(F.lit(blocks)).alias("block"), "id", "v")

    def searched(queries: DataFrame) -> DataFrame:
        met = queries.withColumn("part", every(F.get(parts, F.col("cell")))).withColumn("block", part_of(F.lit(blocks)))
        on = ("cell", "part", "block")
        return met.groupBy(*on).cogroup(base.groupBy(*on)).applyInPandas(tile, "entity_id_l string, entity_id_r string, cosine double")

    path = f"{io.scratch(spark)}/probed"
    first = _best(searched(l.withColumn("cell", F.explode(F.pandas_udf(first_cells, "array<int>")("v")))), k)
    first.write.parquet(path)
    first = spark.read.schema(first.schema).parquet(path)
    kth = first.where(F.col("rank") == k).select(F.col("entity_id_l").alias("id"), F.col("cosine").alias("kth"))
    more = l.join(kth, "id", "left").withColumn("cell", F.explode(F.pandas_udf(near, "array<int>")("v", "kth")))
    return _best(first.drop("rank").unionByName(searched(more)), k)


def contrastive_pairs(left: DataFrame, right: DataFrame, truth: DataFrame, per_positive: int = 3, seed: int = 42) -> DataFrame:
    """(text_l, text_r, label): the true pairs, and about per_positive drawn ones for each; pairs with an empty text are
    left out."""
    ids = ["entity_id_l", "entity_id_r"]
    both = truth.select(*ids).distinct().withColumn("label", F.lit(1)).unionByName(random_negatives(left, right, truth, per_positive, seed).withColumn("label", F.lit(0)))
    texts = lambda d, s: record_text(d).select(F.col("entity_id").alias(f"entity_id_{s}"), F.col("text").alias(f"text_{s}"))
    out = both.join(texts(left, "l"), "entity_id_l").join(texts(right, "r"), "entity_id_r")
    return out.where("trim(text_l) <> '' and trim(text_r) <> ''").select("text_l", "text_r", "label")
