"""Operators on literal tables: policies, metrics, validation, linkage, samples, files, models, streams."""

import re
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinlink.operators import blocking, diagnostics, features, keys, labels, metrics, policy, sizing, validate, vectors
from kinlink.operators import fellegi_sunter as fs
from kinlink.operators.model import plain_score
from kinlink.plans import registry, views
from kinlink.sources import io
from kinlink.streaming import scoring

SMALL = "/root/testdata/sf0.001"
NORM = "entity_id string, name_norm string, name_tokens array<string>, addr_norm string, country_norm string"


def norm(spark, rows):
    return spark.createDataFrame([(i, n, n.split(), a, c) for i, n, a, c in rows], NORM)


@pytest.fixture(scope="module")
def sides(spark):
    return tuple(s.cache() for s in views.sides(spark, SMALL))


@pytest.fixture(scope="module")
def scored(spark):
    rows = [("e1", "a", 0.7, 1), ("e1", "b", 0.65, 0), ("e1", "c", 0.3, 1), ("e2", "a", 0.5, 0), ("e2", "b", 0.5, 1), ("e3", "a", 0.15, 0), ("e4", "a", 0.05, 0), ("e5", "a", 0.6, 1)]
    return spark.createDataFrame(rows, "entity_id_l string, entity_id_r string, prob double, label int")


def kept(df):
    return sorted(r.entity_id_l + r.entity_id_r for r in df.collect())


def test_three_thresholds(scored):
    assert kept(policy.three_threshold(scored, 0.1, 0.6, 0.2)) == ["e1a", "e1b", "e2a", "e2b", "e5a"]
    assert kept(policy.three_threshold(scored, 0.1, 0.6, 0.2, ties="one")) == ["e1a", "e1b", "e2a", "e5a"]
    for cut in (0.0, 0.05, 0.19):  # below the fallback the first cut changes nothing
        assert kept(policy.three_threshold(scored, cut, 0.6, 0.2)) == kept(policy.three_threshold(scored, 0.1, 0.6, 0.2))
    assert kept(policy.flat(scored, 0.6)) == ["e1a", "e1b", "e5a"]


def test_macro_f(spark, scored):
    one = metrics.macro_f(scored, F.col("prob") >= 0.6).head()
    assert one.entities == 3 and one.macro_f == pytest.approx((0.5 + 0 + 1) / 3)
    every = metrics.macro_f(scored, F.col("prob") >= 0.6, "all").head()
    assert every.entities == 5 and every.macro_f == pytest.approx((0.5 + 0 + 1 + 1 + 1) / 5)
    more = spark.createDataFrame([("e9",), ("e1",)], "entity_id_l string")
    assert metrics.macro_f(scored, F.col("prob") >= 0.6, "all", more).head().entities == 2
    swept = {r.threshold: r.macro_f for r in metrics.sweep(scored, (0.2, 0.6)).collect()}
    assert swept[0.6] == pytest.approx(one.macro_f)
    assert metrics.best_threshold(metrics.sweep(scored)).head().threshold in metrics.GRID
    assert metrics.neighbourhood((0.1, 0.6, 0.2))[1] == (0.55, 0.6, 0.65)


def test_auc_and_groups(spark):
    s = spark.createDataFrame([("a", "x", 0.9, 1), ("b", "x", 0.9, 0), ("c", "x", 0.1, 0), ("d", "x", 1.0, 1)], "entity_id_l string, entity_id_r string, prob double, label int")
    assert metrics.auc(s).head().auc == pytest.approx((0.5 + 1 + 1 + 1) / 4)
    assert metrics.singleton_accuracy(s, 0.5).head().accuracy == pytest.approx(0.5)


def test_suppression(spark, sides):
    left, right = sides
    passes = keys.passes()
    lk, rk = keys.long_keys(left, passes), keys.long_keys(right, passes)
    whole = {tuple(r) for r in blocking.pair_up(lk, rk).collect()}
    held = {tuple(r) for r in blocking.multipass(left, right, keys.passes(uniform=True)).collect()}
    assert held <= {tuple(r) for r in blocking.multipass(left, right, passes).collect()} <= whole
    with pytest.raises(blocking.BudgetExceeded):
        blocking.multipass(left, right, passes, budget=1)
    one = {tuple(r) for r in blocking.multipass(left.repartition(7), right.repartition(3), passes).collect()}
    assert one == {tuple(r) for r in blocking.multipass(left, right, passes).collect()}
    stats = {r["pass"]: r for r in blocking.pass_stats(lk, rk, passes).collect()}
    assert set(stats) == set(keys.PASSES) and all(r.kept <= r.shared for r in stats.values())
    assert sizing.affordable(left, right, list(sizing.RULES), 10**9) == list(sizing.RULES) and sizing.affordable(left, right, ["prefix4"], 0) == []


def test_null_country_and_empty_tokens(spark):
    n = spark.createDataFrame([("S1-1", "", [], "", None), ("S1-2", "", [], "12345 elm", "us")], NORM)
    got = {(r.entity_id, r["pass"], r.key) for r in keys.long_keys(n, keys.passes()).collect()}
    assert got == {("S1-2", "ct2", "us|n|"), ("S1-2", "postal_ctry", "us|zz|12345"), ("S1-2", "postal_nc", "zz|12345"), ("S1-2", "house_ctry", "us|hn|12345|elm"), ("S1-2", "house_nc", "hn|12345|elm"), ("S1-1", "house_nc", "x")} - {("S1-1", "house_nc", "x")}
    dropped = spark.createDataFrame([("a",)], "token string")
    rows = keys.without_tokens(norm(spark, [("S1-1", "b a c", "", "us"), ("S1-2", "a", "", "us")]), dropped)
    assert {r.entity_id: r.name_tokens for r in rows.collect()} == {"S1-1": ["b", "c"], "S1-2": []}


def test_smoke_linkage(spark):
    left = norm(spark, [("s1-1", "acme steel", "1 main street", "us"), ("s1-2", "blue ocean foods", "22 lake road", "us"), ("s1-3", "sunrise textiles", "5 mg road", "india"), ("s1-4", "delta motors", "9 hill street", "us")])
    right = norm(spark, [("s2-10", "acme steels", "1 main street", "us"), ("s2-11", "blue ocean food", "22 lake road", "us"), ("s2-12", "sunrise textile", "5 mg road", "india"), ("s2-13", "other", "77 far away", "us"), ("s2-14", "delta motor", "9 hill street", "us")])
    truth = spark.createDataFrame([("s1-1", "s2-10"), ("s1-2", "s2-11"), ("s1-3", "s2-12"), ("s1-4", "s2-14")], "entity_id_l string, entity_id_r string")
    pairs = sizing.rule_pairs(left, right, "prefix4")
    assert diagnostics.pair_recall(pairs, truth).head().recall == 1.0
    out = fs.link(left, right, pairs, truth, labels.random_negatives(left, right, truth, 3))
    assert out.where("match_probability > 0.5").count() == 4
    negatives = labels.random_negatives(left, right, truth, 3).collect()
    assert len(negatives) <= 12 and not {tuple(r) for r in negatives} & {tuple(r) for r in truth.collect()}
    assert labels.random_negatives(left, right, truth, 1).count() == 4


def test_features_and_labels(spark, sides):
    left, right = sides
    truth = views.truth(spark, SMALL).distinct()
    pairs = blocking.multipass(left, right, keys.passes())
    out = features.pair_features(pairs, left, right, truth).cache()
    assert out.columns == ["entity_id_l", "entity_id_r", *features.FEATURES, "label"]
    low, high = out.agg(*[F.min(c) for c in (*features.JARO, "lev_name", "tok_jaccard")]).head(), out.agg(*[F.max(c) for c in (*features.JARO, "lev_name", "tok_jaccard")]).head()
    assert min(low) >= 0 and max(high) <= 1
    hits = truth.join(pairs, ["entity_id_l", "entity_id_r"], "left_semi").count()
    assert out.agg(F.sum("label")).head()[0] == hits > 0
    parts = [features.training_set(pairs, left, right, truth, p, one_in=1).count() for p in ("train", "validation", "all")]
    assert parts[0] + parts[1] == parts[2] == out.count()
    split = labels.entity_split(left)
    assert labels.leakage(split.where("isval = 0"), split.where("isval = 1")).isEmpty()


def test_validator(spark, tmp_path):
    def report(matches, candidates=None, **more):
        m, c = tmp_path / "m.tsv", tmp_path / "c.tsv"
        m.write_text(matches)
        c.write_text(candidates or "source1_entity_id\tcandidate_entity_ids\nS1-1\tS2-1,S3-1\nS1-2\t\n")
        return validate.validate(spark, f"file://{m}", f"file://{c}", **more)

    head = "source1_entity_id\tmatched_entity_ids\n"
    need = spark.createDataFrame([("S1-1",), ("S1-2",)], "entity_id string")
    known = spark.createDataFrame([("S2-1",), ("S3-1",)], "entity_id string")
    clean = report(head + "S1-1\tS2-1\nS1-2\t\n", required=need, known=known)
    assert clean.errors == [] == clean.warnings and clean.exit_code == 0
    for body, word in (("S1-1\tS2-1\nS1-1\t\nS1-2\t\n", "duplicate_row"), ("S1-1\tS2-1,S2-1\nS1-2\t\n", "duplicate_id"), ("S1-1\tS1-2\nS1-2\t\n", "self_match"), ("S1-1\tX-1\nS1-2\t\n", "bad_prefix"), ("S1-1\tS2-9\nS1-2\t\n", "unknown_id"), ("S1-1\t\n", "missing_entity"), ("S1-1\t\nS1-2\t\nS1-3\t\n", "unexpected_entity"), ("S1-1\nS1-2\t\n", "without a tab")):
        found = report(head + body, required=need, known=known)
        assert any(word in e for e in found.errors) and found.exit_code == 1, body
    assert "commas" in report("source1_entity_id,matched_entity_ids\n").errors[0] and "header" in report("a\tb\n").errors[0] and "empty" in report("").errors[0]
    assert "missing" in validate.validate(spark, f"file://{tmp_path}/none", f"file://{tmp_path}/c.tsv").errors[0]
    assert report(head + "S1-1\tS3-9\nS1-2\t\n").warnings


def test_files(spark, tmp_path):
    root = f"file://{tmp_path}"
    (tmp_path / "train").mkdir()
    (tmp_path / "train/train_source1.tsv").write_text("country\tentity_id\tbusiness_name\textra\tbusiness_address\n US \tS1-1\tAcme Inc\tx\t1 Elm Ct\nIndia\tS1-2\t\ty\t\n")
    (tmp_path / "train/train_ground_truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1, S3-2,S2-1\nS1-2\t\n")
    source = io.read_source(spark, root, "train", 1)
    assert [tuple(r) for r in source.orderBy("entity_id").collect()] == [("S1-1", "Acme Inc", "1 Elm Ct", " US "), ("S1-2", None, None, "India")]
    cached = io.cached_normalised(source, f"{root}/norm")
    assert [tuple(r) for r in cached.orderBy("entity_id").collect()] == [("S1-1", "acme", ["acme"], "1 elm court", "us"), ("S1-2", "", [], "", "india")]
    truth = labels.ground_truth(io.read_ground_truth(spark, root, "train"))
    assert kept(truth) == ["S1-1S2-1", "S1-1S3-2"] and kept(labels.ground_truth(io.read_ground_truth(spark, root, "train"), 3)) == ["S1-1S3-2"]
    assert io.read_ground_truth(spark, root, "test").count() == 0
    io.write_id_lists(spark.createDataFrame([("S1-1", "S2-1"), ("S1-2", None)], "source1_entity_id string, matched_entity_ids string"), f"{root}/lists")
    lines = sorted(line for f in (tmp_path / "lists").glob("part-*") for line in f.read_text().splitlines() if not line.startswith("source1"))
    assert lines == ["S1-1\tS2-1", "S1-2\t"]
    io.save_policy(spark, {"keep_threshold": 0.6}, f"{root}/policy")
    assert io.load_policy(spark, f"{root}/policy") == {"keep_threshold": 0.6} and io.load_policy(spark, f"{root}/no")["keep_threshold"] == 0.55
    io.append_log(spark.createDataFrame([("r", 0.5)], "run string, macro_f double"), f"{root}/log")
    assert len(spark.read.option("header", True).csv(f"{root}/log").columns) == 27


def test_model(spark, tmp_path):
    from kinlink.operators import model

    rows = spark.range(600).select(F.concat(F.lit("S1-"), "id").alias("entity_id_l"), F.lit("S2-1").alias("entity_id_r"), *[(F.rand(i) * 0.2 + (F.col("id") % 2) * 0.8).alias(c) for i, c in enumerate(features.FEATURES)], (F.col("id") % 2).cast("int").alias("label")).cache()
    fitted = model.fit_matcher(rows.where("entity_id_l < 'S1-4'"), rows.where("entity_id_l >= 'S1-4'"), maxIter=3, minInstancesPerNode=5, seed=1)
    scored = fitted.score(rows)
    assert metrics.auc(scored).head().auc > 0.9 and metrics.log_loss(scored).head().log_loss < 0.7
    fitted.save(f"file://{tmp_path}/model")
    again = model.Matcher.load(f"file://{tmp_path}/model").score(rows)
    assert again.agg(F.round(F.sum("prob"), 6)).head() == scored.agg(F.round(F.sum("prob"), 6)).head() and len(fitted.importances()) == len(features.FEATURES)


def test_neighbours(spark, sides):
    left, right = (vectors.hashed_ngrams(vectors.record_text(s.limit(60)), 64).cache() for s in sides)
    exact = {(r.entity_id_l, r.entity_id_r) for r in vectors.knn_exact(left, right, 5).collect()}
    tiled = {(r.entity_id_l, r.entity_id_r) for r in vectors.knn_exact(left, right, 5, block=7).collect()}
    assert len(exact) == 5 * left.count() and len(exact & tiled) >= 0.98 * len(exact)
    probed = {(r.entity_id_l, r.entity_id_r) for r in vectors.knn_cells(left, right, vectors.cells(right, 6), 4, 5).collect()}
    assert len(exact & probed) >= 0.98 * len(exact)  # all but ties: cells that can hold nearer rows are searched too
    union = blocking.union_candidates(vectors.knn_exact(left, right, 2), vectors.knn_exact(left, right, 1))
    assert union.count() == 2 * left.count()


@pytest.mark.parametrize("files", [1, 2])
def test_stream(spark, tmp_path, sides, files):
    """One batch gives what the batch side gives; more batches give at least that."""
    left, right = sides
    (tmp_path / "in").mkdir()
    rows = views.biz(spark, SMALL).where("entity_id like 'S1-%'").collect()
    for part in range(files):
        (tmp_path / f"in/{part}.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\n" + "".join("\t".join(r) + "\n" for r in rows[part::files]))
    stream = scoring.stream_source(spark, f"file://{tmp_path}/in")
    q = scoring.start(stream, right, keys.passes(), f"file://{tmp_path}/out", f"file://{tmp_path}/cp", 0.3)
    q.awaitTermination(120)
    got = {(r.entity_id_l, r.entity_id_r) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    pairs = blocking.multipass(left, right, keys.passes())
    whole = plain_score(features.native_features(pairs, left, right)).where("prob >= 0.3")
    assert got == {(r.entity_id_l, r.entity_id_r) for r in whole.collect()} and got


def test_samples(spark, sides):
    left = sides[0]
    assert kept_ids(labels.sample_rows(left, 7, "entity_id")) == kept_ids(labels.sample_rows(left.repartition(5), 7, "entity_id"))
    marked = left.withColumn("label", (F.length("name_norm") % 2).cast("int"))
    assert labels.balanced(marked, 5, "entity_id").count() == 10
    assert labels.matched_and_fill(left, left.limit(3), 10).count() == 10
    assert labels.every_nth(left, 5, "entity_id", per="country_norm").count() == sum(-(-r["count"] // 5) for r in left.groupBy("country_norm").count().collect())


def kept_ids(df):
    return sorted(r.entity_id for r in df.collect())


def test_default_caps(spark):
    held = spark.range(301).select(F.lit("p").alias("pass"), F.when(F.col("id") < 300, "a").otherwise("b").alias("key"), F.format_string("%04d", "id").alias("entity_id"))
    many = held.withColumn("key", F.lit("a"))
    assert blocking.drop_cap(held).count() == 301 and blocking.drop_cap(many).count() == 0
    assert blocking.rank_cap(many).count() == 300
    side = lambda p, n: spark.range(n).select(F.format_string(p + "%04d", "id").alias("entity_id"), F.array(F.lit("smith")).alias("name_tokens"), F.lit("us").alias("country_norm"))
    assert blocking.candidates(side("a", 60), side("b", 2), blocking.BUCKETS, mode="rank").count() == 100


def test_budgets(spark, sides):
    left, right = sides
    for make in (lambda n: blocking.candidates(left, right, blocking.SIGNIFICANT, mode="rank", budget=n), lambda n: sizing.rule_pairs(left, right, "prefix4", n), lambda n: sizing.rule_pairs(left, right, "tokens", n), lambda n: blocking.rare_overlap(left, right, 0.5, n)):
        assert make(10**9).count() > 1
        with pytest.raises(blocking.BudgetExceeded):
            make(1)


def test_encoder_and_vector_tables(spark, tmp_path):
    texts = spark.createDataFrame([("a", "xx"), ("b", "xyz"), ("c", None)], "entity_id string, text string")
    out = vectors.encoded(texts, lambda many: [[len(t), t.count("x")] for t in many], 2)
    io.write_vectors(out, f"file://{tmp_path}/v")
    got = {r.entity_id: r.embedding for r in io.read_vectors(spark, f"file://{tmp_path}/v").collect()}
    assert got["c"] == [0, 0] and got["a"] == pytest.approx([0.5**0.5, 0.5**0.5]) and got["b"] == pytest.approx([3 / 10**0.5, 1 / 10**0.5])


def test_random_pairs(spark, sides):
    left, right = sides
    pairs = labels.random_pairs(left, right, 2000).collect()
    assert len(pairs) == len(set(pairs)) and 1500 < len(pairs) < 3000
    assert set(pairs) == set(labels.random_pairs(left.repartition(7), right, 2000).collect())
    assert labels.random_pairs(left.limit(0), right, 10).count() == 0


def test_utf8_in_every_line(spark, tmp_path):
    head = b"source1_entity_id\tmatched_entity_ids\n"
    for body, bad in ((b"S1-1\tS2-1\nS1-2\tS2-\xff\n", True), ("S1-1\tS2-\ufffd\n".encode(), False)):
        (tmp_path / "m.tsv").write_bytes(head + body)
        report = validate.validate(spark, f"file://{tmp_path}/m.tsv", f"file://{tmp_path}/none.tsv")
        assert any("UTF-8" in e for e in report.errors) == bad and report.warnings


def test_commands(spark, tmp_path):
    """Files in, files out, exit codes."""
    root = Path(__file__).resolve().parent.parent
    for n in (1, 2, 3):
        rows = views.biz(spark, SMALL).where(f"entity_id like 'S{n}-%'").limit(40).collect()
        (tmp_path / "test").mkdir(exist_ok=True)
        (tmp_path / f"test/test_source{n}.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\n" + "".join("\t".join(r) + "\n" for r in rows))

    def run(*args):
        return subprocess.run([sys.executable, "-m", "kinlink", "--master", "local[2]", *args], cwd=root, capture_output=True, text=True, timeout=300)

    base, out = f"file://{tmp_path}", f"file://{tmp_path}/out"
    done = run("infer", "--root", base, "--out", out)
    assert done.returncode == 0 and "40 entities" in done.stdout, done.stderr[-2000:]
    lines = (tmp_path / "out/matching_results.tsv").read_text().splitlines()
    assert lines[0] == "source1_entity_id\tmatched_entity_ids" and len(lines) == 41
    check = run("validate", "--matching", f"{out}/matching_results.tsv", "--candidate", f"{out}/candidate_pairs.tsv", "--root", base, "--check-ids")
    assert check.returncode == 0 and "passed" in check.stdout, check.stdout + check.stderr[-2000:]
    (tmp_path / "short.tsv").write_text("\n".join(lines[:-1]) + "\n")
    check = run("validate", "--matching", f"{base}/short.tsv", "--candidate", f"{out}/candidate_pairs.tsv", "--root", base)
    assert check.returncode == 1 and "missing_entity" in check.stdout
    assert run("infer", "--root", base, "--out", out, "--budget", "1").returncode == 1


def test_pairs_by_shared_keys_are_not_cut_by_a_budget():
    """The query of all pairs that share a token makes them all, whatever their number."""
    from unittest import mock

    from kinlink.plans import registry

    with mock.patch.object(registry.V, "sides", lambda *a: (None, None)), mock.patch.object(sizing, "rule_pairs") as made:
        registry.QUERIES["rule_pairs_tokens"](None, None)
    assert made.call_args.kwargs.get("budget") is None and len(made.call_args.args) == 3


def _shuffled_pairs(df):
    """Whether ids of both sides are in one shuffle."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return bool(re.search(r"Aggregate \[entity_id_l#\d+, entity_id_r", plan))


def test_rule_pairs_shuffle_no_pair_and_keep_repeats(spark):
    left = norm(spark, [("S1-1", "acme steel", "", "us"), ("S1-2", "acme iron", "", "us"), ("S1-2", "acme iron", "", "us"), ("S1-3", "acme iron", "", None)])
    right = norm(spark, [("S2-1", "acme wood", "", "us"), ("S2-2", "acmo", "", "us"), ("S2-3", "acme", "", None)])
    out = sizing.rule_pairs(left, right, "prefix4")
    assert kept(out) == ["S1-1S2-1", "S1-2S2-1", "S1-2S2-1"]  # the SQL is a plain join: two rows, two pairs
    assert not _shuffled_pairs(out)


def test_rare_overlap_meets_each_pair_once_without_a_shuffle_of_pairs(spark):
    left = norm(spark, [(f"S1-{i}", f"a{i % 7} b{i % 5} c{i % 3}", "", "us" if i % 2 else None if i % 11 == 0 else "in") for i in range(60)])
    right = norm(spark, [(f"S2-{i}", f"a{i % 6} b{i % 5} c{i % 4} c{i % 4}", "", "us" if i % 3 else "in") for i in range(60)])
    out = blocking.rare_overlap(left, right, 0.3)
    frequent = lambda rows: {t for r in rows for t in r.name_tokens if sum(t in x.name_tokens for x in rows) > 0.3 * len(rows)}
    l, r = left.collect(), right.collect()  # noqa: E741
    gone = frequent(l) | frequent(r)
    want = sorted(a.entity_id + b.entity_id for a in l for b in r if a.country_norm == b.country_norm and set(a.name_tokens) & set(b.name_tokens) - gone)
    assert kept(out) == want and gone and not _shuffled_pairs(out)


def _broadcasts(df):
    return "BroadcastExchange" in df._jdf.queryExecution().executedPlan().toString()


def test_recall_counts_equal_records_together_and_broadcasts_no_keys(spark, sides):
    """Recall and its interval, with copies of all records, against plain sets; the plans broadcast no table of keys."""
    left, right = sides[0].limit(30).localCheckpoint(), sides[1].limit(40).localCheckpoint()
    twice = lambda d: d.unionByName(d.withColumn("entity_id", F.concat("entity_id", F.lit("x"))))
    left, right = twice(left), twice(right)
    truth = left.select(F.col("entity_id").alias("entity_id_l")).crossJoin(right.select(F.col("entity_id").alias("entity_id_r"))).where("pmod(hash(entity_id_l, entity_id_r), 3) = 0").localCheckpoint()
    have = [{}, {}]
    size = [{}, {}]
    for side, found, n in zip((left, right), have, size):
        for r in keys.long_keys(side, keys.DIAGNOSTIC).collect():
            found.setdefault(r.entity_id, set()).add((r["pass"], r.key))
            n[(r["pass"], r.key)] = n.get((r["pass"], r.key), 0) + 1
    both = [have[0].get(t.entity_id_l, set()) & have[1].get(t.entity_id_r, set()) for t in truth.collect()]
    plain = diagnostics.recall_with_interval(left, right, truth, keys.DIAGNOSTIC)
    assert {r["pass"]: r.hit for r in plain.collect()} == {p: sum(any(k[0] == p or p == "any" for k in b) for b in both) for p in (*keys.DIAGNOSTIC, "any")}
    capped = diagnostics.capped_recall(left, right, truth, keys.DIAGNOSTIC, (2, 4, 8))
    assert {(r["pass"], r.cap): r.hit for r in capped.collect()} == {(p, c): sum(any((k[0] == p or p == "any") and max(size[0][k], size[1][k]) <= c for k in b) for b in both) for p in (*keys.DIAGNOSTIC, "any") for c in (2, 4, 8)}
    file = [views.truth(spark, SMALL), *views.sides(spark, SMALL)]
    assert not _broadcasts(diagnostics._shared_keys(keys.long_keys(file[1], keys.DIAGNOSTIC), keys.long_keys(file[2], keys.DIAGNOSTIC), file[0]))


def test_large_samples_are_not_the_head_of_a_sort(spark, sides, monkeypatch):
    rows = spark.range(3000).selectExpr("concat('S1-', id) AS entity_id")
    want = sorted(r.entity_id for r in labels.sample_rows(rows, 1234, "entity_id").collect())
    monkeypatch.setattr(labels, "HEAD", 100)
    assert sorted(r.entity_id for r in labels.sample_rows(rows, 1234, "entity_id").collect()) == want
    assert labels.sample_rows(rows, 5000, "entity_id").count() == 3000
    negatives = labels.random_negatives(*sides, views.truth(spark, SMALL), 3)
    assert not _broadcasts(negatives)


def test_neighbours_of_copies(spark):
    """Copies on both sides, rows that are on both, and fewer tiles than their number would take; against all pairs."""
    import numpy as np

    rng = np.random.default_rng(3)
    plain = rng.normal(size=(9, 4))
    rows = [(f"V{i:03}", [float(x) for x in plain[i % 9]]) for i in range(90)]
    right = spark.createDataFrame(rows, "entity_id string, embedding array<double>")
    left = right.where("substring(entity_id, 2) % 4 = 0")
    unit = plain / np.linalg.norm(plain, axis=1, keepdims=True)
    cosine = np.round(unit @ unit.T, 9)
    for k in (3, 12, 200):
        got = {}
        for r in vectors.knn_exact(left, right, k, block=4).orderBy("entity_id_l", "rank").collect():
            got.setdefault(r.entity_id_l, []).append(r.entity_id_r)
        assert got == {f"V{i:03}": [f"V{j:03}" for j in sorted((j for j in range(90) if j != i), key=lambda j: (-cosine[i % 9][j % 9], j))[:k]] for i in range(0, 90, 4)}
    met = []
    plain_cogroup = type(right.groupBy("entity_id")).cogroup
    try:
        type(right.groupBy("entity_id")).cogroup = lambda a, b: met.extend((a._df.count(), b._df.count())) or plain_cogroup(a, b)
        vectors.knn_exact(left, right, 3)
    finally:
        type(right.groupBy("entity_id")).cogroup = plain_cogroup
    assert met == [9, 9]


def test_cells_by_tiles(spark, monkeypatch):
    """Equal vectors, repeated ids and tiles of a few rows: the result of the exact search, and no cosine made row by row."""
    rng = np.random.default_rng(3)
    points = rng.normal(size=(260, 8)).round(1)
    points[40:120] = points[0]  # one very common vector
    points[120] = 0
    rows = [(f"V{i}", [float(x) for x in p]) for i, p in enumerate(points)]
    right = spark.createDataFrame(rows + rows[7:9], "entity_id string, embedding array<float>")
    left = right.where("substr(entity_id, 2) % 5 = 0").distinct()
    centres = vectors.cells(right, 6)
    want = sorted((r.entity_id_l, r.entity_id_r, r["rank"], round(r.cosine, 6)) for r in vectors.knn_exact(left.distinct(), right.distinct(), 7).collect())
    monkeypatch.setattr(vectors, "TILE", 0, raising=False)
    monkeypatch.setattr(vectors, "dot", None)  # the search does not use the expression over single pairs
    got = sorted((r.entity_id_l, r.entity_id_r, r["rank"], round(r.cosine, 6)) for r in vectors.knn_cells(left, right.distinct(), centres, 2, 7).collect())
    assert got == want
    far = [(f"W{i}", [float("nan")] * 8) for i in range(9)]  # they come last, and close no cell
    more = right.distinct().unionByName(spark.createDataFrame(far, right.schema))
    found = {(r.entity_id_l, r.entity_id_r) for r in vectors.knn_cells(left, more, centres, 2, 7).collect()}
    assert found == {(l, r) for l, r, k, _ in want}


def test_classes_of_copies(spark):
    """Copies of a record don't make its keys frequent: its classes meet, and stand for all pairs of the copies."""
    rows = [(f"S{s}-{i}", "acme iron works", ["acme", "iron", "works"], "12 elm lane 70001", "us") for s in (1, 2, 3) for i in range(100)]
    rows += [("S1-x", "acme iron works", ["acme", "iron", "works"], None, "us"), ("S1-y", "acme iron works", ["acme", "iron", "works"], None, "us")]
    norm = spark.createDataFrame(rows, io.NORMALISED)
    known, first = blocking.classes(norm), F.col("entity_id").startswith("S1-")
    assert {(r.class_id, r.record_id, r["count"]) for r in known.groupBy("class_id", "record_id").count().collect()} == {("S1-0", "S1-0", 100), ("S2-0", "S2-0", 100), ("S3-0", "S2-0", 100), ("S1-x", "S1-x", 2)}
    rare = [keys.Pass("ct2", keys.PASSES["ct2"], 50, 900)]
    assert not kept(blocking.multipass(norm.where(first), norm.where(~first), rare))
    records = norm.join(known.where("entity_id = record_id").select("entity_id"), "entity_id")
    pairs = blocking.multipass(records.where(first), records.where(~first), rare)
    assert kept(pairs) == ["S1-0S2-0", "S1-xS2-0"]
    truth = spark.createDataFrame([("S1-3", "S2-5"), ("S1-3", "S2-5"), ("S1-4", "S2-5"), ("S1-y", "S2-7")], "entity_id_l string, entity_id_r string")
    got = blocking.class_labels(pairs, known.where(first), known.where(~first), truth)
    assert sorted((r.entity_id_l, r.label, r.pairs) for r in got.collect()) == [("S1-0", 0, 9998), ("S1-0", 1, 2), ("S1-x", 0, 199), ("S1-x", 1, 1)]


def test_matchers_take_copies(spark, tmp_path):
    """Where every key of the rows is over its limit there is still something to learn from."""
    part = spark.read.parquet("/root/testdata/sf0.01/part.parquet")
    copies = part.crossJoin(spark.range(6).withColumnRenamed("id", "i")).withColumn("p_partkey", F.col("p_partkey") + F.col("i") * 12_000).drop("i")
    copies.write.parquet(f"file://{tmp_path}/part.parquet")
    limits, flat = dict(keys.LIMITS), (1000, 300)
    try:
        keys.LIMITS.update({p: flat for p in keys.PASSES})
        keys.LIMITS.update({p: (1, 1) for p in keys.PASSES if not p.startswith("postal")})
        assert not registry._candidates(spark, f"file://{tmp_path}").head(1)
        assert tuple(registry.legacy_matcher(spark, f"file://{tmp_path}").head()) == (7, "tok_jaccard", 1.0, True, True)
    finally:
        keys.LIMITS.clear()
        keys.LIMITS.update(limits)


def _crossed(sources):
    """Records of all names at all addresses, of each source and country."""
    return [(f"S{s}-{i}{j}{c}", f"{a} {b}", [a, b], f"{j} elm lane {70000 + j}", c) for s in sources for i, (a, b) in enumerate((a, b) for a in ("acme", "bolt", "cold") for b in ("iron", "ring", "wood")) for j in range(11, 17) for c in ("us", "in")]


def test_keys_over_their_limits_meet_by_the_other_field(spark):
    """A key over its limits makes no pair by itself, but where names or addresses are equal too; against all pairs."""
    norm = spark.createDataFrame(_crossed((1, 2)), io.NORMALISED)
    first = F.col("entity_id").startswith("S1-")
    left, right = norm.where(first).collect(), norm.where(~first).collect()
    held = [keys.Pass("tok_ctry", keys.PASSES["tok_ctry"], 100, 9), keys.Pass("postal_nc", keys.PASSES["postal_nc"], 100, 4)]
    assert not kept(blocking.multipass(norm.where(first), norm.where(~first), held))
    want = sorted(a.entity_id + b.entity_id for a in left for b in right if (set(a.name_tokens) & set(b.name_tokens) and a.country_norm == b.country_norm or a.name_norm == b.name_norm) and a.addr_norm == b.addr_norm)
    assert kept(blocking.multipass(norm.where(first), norm.where(~first), held, finer=True)) == want
    none = [keys.Pass(p.name, p.keys, 100, 3) for p in held]  # the finer keys have the limits too
    assert not kept(blocking.multipass(norm.where(first), norm.where(~first), none, finer=True))


def test_features_by_part(spark, sides, tmp_path):
    """The features of all pairs, with names and addresses worked out once: the same as by pair."""
    left, right = (d.limit(40).unionByName(d.limit(3).withColumns({"entity_id": F.concat("entity_id", F.lit("x")), "addr_norm": F.lit(None).cast("string"), "country_norm": F.lit(None).cast("string")})).localCheckpoint() for d in sides)
    pairs = left.select(F.col("entity_id").alias("entity_id_l")).crossJoin(right.select(F.col("entity_id").alias("entity_id_r"))).localCheckpoint()
    got = features.features_by_part(pairs, left, right, f"file://{tmp_path}")
    want = features.pair_features(pairs, left, right)
    assert got.columns == want.columns and got.count() == 43 * 43
    assert not got.exceptAll(want).head(1) and not want.exceptAll(got).head(1)


@pytest.fixture(scope="module")
def crossed(spark, tmp_path_factory):
    """A part table of all names, types and sizes, where even the distinct records have every key over the limits held."""
    folder = f"file://{tmp_path_factory.mktemp('crossed')}"
    rows = [(a, b, t, s) for a in ("old", "hot", "red", "big") for b in ("bolt", "ring", "nut", "gear") for t in ("LARGE", "SMALL", "PROMO") for s in range(5, 17) for _ in range(6)]
    made = [(i, f"{a} {b}", f"Brand#{i % 2}", t, s, 1.0) for i, (a, b, t, s) in enumerate(rows)]
    spark.createDataFrame(made, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").coalesce(4).write.parquet(f"{folder}/part.parquet")
    limits = dict(keys.LIMITS)
    keys.LIMITS.update({p: (1000, 400) for p in keys.PASSES})
    records = views.norm(spark, folder).dropDuplicates(["name_norm", "addr_norm", "country_norm"])
    assert not blocking.multipass(records, records.withColumn("entity_id", F.concat("entity_id", F.lit("x"))), keys.passes()).head(1)
    yield folder
    keys.LIMITS.clear()
    keys.LIMITS.update(limits)


def test_boosted_trees_where_all_records_keys_are_frequent(spark, crossed):
    out = registry.gbdt_platt_scores(spark, crossed).localCheckpoint()
    assert out.count() > 1000 and {r.label for r in out.select("label").distinct().collect()} == {0, 1}
    assert out.where("prob is null or prob < 0 or prob > 1 or pairs < 1").count() == 0
    assert out.where("label = 1").agg(F.avg("prob")).head()[0] > out.where("label = 0").agg(F.avg("prob")).head()[0]


def test_legacy_matcher_where_all_records_keys_are_frequent(spark, crossed):
    assert tuple(registry.legacy_matcher(spark, crossed).head()) == (7, "tok_jaccard", 1.0, True, True)


def _long_lists(spark):
    rows = lambda s: [(f"S{s}-{i}", "acme iron", "", "us") for i in range(300)]
    return sizing.rule_pairs(norm(spark, rows(1)), norm(spark, rows(2)), "tokens")


def _final_plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_pairs_of_two_lists_are_not_held_at_once(spark):
    """A compiled explode in another keeps all rows of one input row; the outer one is left to make them one by one."""
    out = _long_lists(spark)
    assert len({tuple(r) for r in out.collect()}) == 300 * 300
    assert re.search(r"^[^*\n]*Generate explode\(transform\(ids_l", _final_plan(out), re.M)


def test_lists_that_meet_are_dealt_to_many_tasks(spark):
    """Few bytes of lists make many pairs: the number of tasks that make them isn't told by their size."""
    out = _long_lists(spark)
    out.collect()
    assert re.search(r"REPARTITION_BY_NUM", _final_plan(out))
