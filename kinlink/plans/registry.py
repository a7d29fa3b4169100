"""Queries over the driver's tables and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.functions import similarity, text
from kinlink.operators import assemble, blocking, diagnostics, features, keys, labels, metrics, policy, sizing, validate, vectors
from kinlink.operators import fellegi_sunter as fs
from kinlink.plans import inference
from kinlink.plans import oracles as O
from kinlink.plans import views as V
from kinlink.sources import io

QUERIES: dict = {}
SQL: dict[str, str] = {}
IDS = ("entity_id_l", "entity_id_r")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def six(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in columns})


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_match(spark, sf_dir)


# Text

@query("norm_records", f"WITH {O.NORM} SELECT entity_id, name_norm, array_to_string(name_tokens, ' ') AS tokens, addr_norm, country_norm FROM norm")
def norm_records(spark, d):
    return V.norm(spark, d).select("entity_id", "name_norm", F.array_join("name_tokens", " ").alias("tokens"), "addr_norm", "country_norm")


@query("fold_latin_docs", "SELECT doc_id, md5(lower(strip_accents(text))) AS folded FROM documents")
def fold_latin_docs(spark, d):
    return V.table(spark, d, "documents").select("doc_id", F.md5(F.lower(text.fold_latin(F.col("text"))).cast("binary")).alias("folded"))


@query("soundex4_names", f"SELECT DISTINCT w, {O.soundex('w')} AS code FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part UNION ALL SELECT c_name FROM customer)")
def soundex4_names(spark, d):
    words = V.table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("w")).union(V.table(spark, d, "customer").select("c_name"))
    return words.distinct().select("w", text.soundex4(F.col("w")).alias("code"))


@query("token_df", f"WITH {O.NORM} SELECT t AS token, CAST(count(*) AS BIGINT) AS df FROM (SELECT unnest(list_distinct(name_tokens)) AS t FROM norm) GROUP BY t")
def token_df(spark, d):
    return V.norm(spark, d).select(F.explode(F.array_distinct("name_tokens")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


@query("rare_tokens_docs", "SELECT t AS token, CAST(count(DISTINCT doc_id) AS BIGINT) AS df FROM (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS t FROM documents) WHERE t <> '' GROUP BY t HAVING count(DISTINCT doc_id) > 0.05 * (SELECT count(*) FROM documents)")
def rare_tokens_docs(spark, d):
    docs = V.table(spark, d, "documents")
    n = docs.count()
    t = docs.select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("token")).where("token <> ''")
    return t.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > 0.05 * n)


@query("token_pairs_in_row", f"WITH {O.NORM}, {O.E} SELECT entity_id, t || ' ' || u AS pair FROM e, unnest(nt) a(t), unnest(nt) b(u) WHERE t < u")
def token_pairs_in_row(spark, d):
    return V.norm(spark, d).select("entity_id", F.explode(text.pairs_in_row(F.array_sort(F.array_distinct("name_tokens")))).alias("pair"))


@query("similarity_names", """WITH w AS (SELECT DISTINCT p_name AS n FROM part), p AS (SELECT a.n AS a, b.n AS b FROM w a JOIN w b ON substr(a.n, 1, 2) = substr(b.n, 1, 2))
SELECT a, b, round(jaro_similarity(a, b), 6) AS jaro, round(jaro_winkler_similarity(a, b), 6) AS jw, round(1 - levenshtein(a, b) / CAST(greatest(length(a), length(b)) AS DOUBLE), 6) AS lev FROM p""")
def similarity_names(spark, d):
    w = V.table(spark, d, "part").select("p_name").distinct()
    p = w.select(F.col("p_name").alias("a"), F.substring("p_name", 1, 2).alias("k")).join(w.select(F.col("p_name").alias("b"), F.substring("p_name", 1, 2).alias("k")), "k")
    p = p.withColumn("jaro", similarity.jaro(F.col("a"), F.col("b")))
    p = p.select("a", "b", "jaro", similarity.jaro_winkler(F.col("a"), F.col("b"), F.col("jaro")).alias("jw"), similarity.lev_sim(F.col("a"), F.col("b")).alias("lev"))
    return six(p, "jaro", "jw", "lev")


# Blocking

def _keys_query(name):
    @query(f"keys_{name}", f"WITH {O.NORM}, {O.keys_cte({name: O.PASS_SQL[name]})} SELECT entity_id, key FROM k")
    def run(spark, d):
        return keys.long_keys(V.norm(spark, d), keys.passes([name])).select("entity_id", "key")


for _name in keys.PASSES:
    _keys_query(_name)


def _schemes_query(name, schemes, sql):
    @query(name, f"WITH {O.NORM}, {O.keys_cte(sql)} SELECT entity_id, pass, key FROM k")
    def run(spark, d):
        return keys.long_keys(V.norm(spark, d), schemes)


_schemes_query("keys_diagnostic", keys.DIAGNOSTIC, {"ct2f": O.SCHEME_SQL["small2"], "pairf": O.SCHEME_SQL["pairf"], "sdx0": O.SCHEME_SQL["sdx0"], "ak": O.SCHEME_SQL["ends"]})
_schemes_query("keys_estimate", keys.ESTIMATE, {"f2k": O.SCHEME_SQL["small2"], "np": O.SCHEME_SQL["np"], "sdx0": O.SCHEME_SQL["sdx0"], "ak": O.SCHEME_SQL["threes"]})


@query("pass_stats", f"""WITH {O.NORM}, {O.keys_cte(O.PASS_SQL)}, {O.COUNTS}, {O.limit_cte()},
b AS (SELECT pass, coalesce(n1, 0) AS n1, coalesce(n2, 0) AS n2, f, p FROM cl FULL JOIN cr USING (pass, key) JOIN lim USING (pass))
SELECT pass, {', '.join(f'CAST(coalesce(sum(CASE WHEN {c} THEN {v} END), 0) AS BIGINT) AS {n}' for n, c, v in (('keys_l', 'n1 > 0', 1), ('keys_r', 'n2 > 0', 1), ('freq_dropped_l', 'n1 > f', 1), ('freq_dropped_r', 'n2 > f', 1), ('shared', 'n1 > 0 AND n2 > 0', 1), ('product_dropped', 'n1 > 0 AND n2 > 0 AND n1 <= f AND n2 <= f AND n1 * n2 > p', 1), ('kept', 'n1 > 0 AND n2 > 0 AND n1 <= f AND n2 <= f AND n1 * n2 <= p', 1), ('pairs', 'n1 > 0 AND n2 > 0 AND n1 <= f AND n2 <= f AND n1 * n2 <= p', 'n1 * n2')))} FROM b GROUP BY pass""")
def pass_stats(spark, d):
    p, (l, r) = keys.passes(), V.sides(spark, d)
    return blocking.pass_stats(keys.long_keys(l, p), keys.long_keys(r, p), p)


def _candidates(spark, d, uniform=False):
    l, r = V.sides(spark, d)
    return blocking.multipass(l, r, keys.passes(uniform=uniform), budget=keys.MAX_TOTAL_PAIRS)


@query("candidates_multipass", f"{O.multipass()} SELECT * FROM cand")
def candidates_multipass(spark, d):
    return _candidates(spark, d)


@query("candidates_uniform", f"{O.multipass(True)} SELECT * FROM cand")
def candidates_uniform(spark, d):
    return _candidates(spark, d, True)


_VALIDATION = "CAST(('0x' || substr(md5(entity_id), 1, 8)) AS BIGINT) % 10 < 2"


@query("candidates_validation_only", f"{O.multipass()} SELECT * FROM cand WHERE {_VALIDATION.replace('entity_id', 'entity_id_l')}")
def candidates_validation_only(spark, d):
    l, r = V.sides(spark, d)
    return blocking.multipass(l, r, keys.passes(), only_left=l.where(labels.is_validation(F.col("entity_id")) == 1))


def _capped(mode, cap, sql):
    held = "SELECT * FROM {s} QUALIFY count(*) OVER (PARTITION BY pass, key) <= {c}" if mode == "drop" else "SELECT * FROM {s} QUALIFY row_number() OVER (PARTITION BY pass, key ORDER BY entity_id) <= {c}"
    return f"WITH {O.NORM}, {O.keys_cte(sql)}, hl AS ({held.format(s='kl', c=cap)}), hr AS ({held.format(s='kr', c=cap)}) SELECT DISTINCT hl.entity_id AS entity_id_l, hr.entity_id AS entity_id_r FROM hl JOIN hr USING (pass, key)"


@query("candidates_dropcap", _capped("drop", blocking.DROP_CAP, {k: O.SCHEME_SQL[k] for k in ("blk_a", "blk_b1", "blk_b2")}))
def candidates_dropcap(spark, d):
    return blocking.candidates(*V.sides(spark, d), blocking.THREE_KEYS, mode="drop", budget=blocking.PAIR_BUDGET)


@query("candidates_rankcap", _capped("rank", blocking.RANK_CAP, {"ct2f": O.SCHEME_SQL["sig"]}))
def candidates_rankcap(spark, d):
    return blocking.candidates(*V.sides(spark, d), blocking.SIGNIFICANT, mode="rank", budget=blocking.PAIR_BUDGET)


@query("candidates_headcap", _capped("rank", blocking.HEAD_CAP, {"sdx": O.SCHEME_SQL["bucket"]}))
def candidates_headcap(spark, d):
    return blocking.candidates(*V.sides(spark, d), blocking.BUCKETS, mode="rank", budget=blocking.PAIR_BUDGET)


@query("rare_overlap", f"""WITH {O.NORM}, t AS (SELECT DISTINCT entity_id, country_norm, t FROM norm, unnest(name_tokens) a(t)), l AS (SELECT * FROM t WHERE entity_id LIKE 'S1-%'), r AS (SELECT * FROM t WHERE entity_id NOT LIKE 'S1-%'),
f AS (SELECT t FROM l GROUP BY t HAVING count(*) > 0.15 * (SELECT count(*) FROM norm WHERE entity_id LIKE 'S1-%') UNION SELECT t FROM r GROUP BY t HAVING count(*) > 0.15 * (SELECT count(*) FROM norm WHERE entity_id NOT LIKE 'S1-%'))
SELECT DISTINCT l.entity_id AS entity_id_l, r.entity_id AS entity_id_r FROM l JOIN r USING (t, country_norm) WHERE t NOT IN (SELECT t FROM f)""")
def rare_overlap(spark, d):
    return blocking.rare_overlap(*V.sides(spark, d), 0.15)


_EST = {"f2k": O.SCHEME_SQL["small2"], "np": O.SCHEME_SQL["np"], "sdx0": O.SCHEME_SQL["sdx0"], "ak": O.SCHEME_SQL["threes"]}


@query("pair_estimates", f"""WITH {O.NORM}, {O.keys_cte(_EST)}, al AS (SELECT * FROM kl UNION ALL SELECT DISTINCT entity_id, 'union', pass || ':' || key FROM kl), ar AS (SELECT * FROM kr UNION ALL SELECT DISTINCT entity_id, 'union', pass || ':' || key FROM kr),
b AS (SELECT pass, n1, n2 FROM (SELECT pass, key, count(*) AS n1 FROM al GROUP BY ALL) JOIN (SELECT pass, key, count(*) AS n2 FROM ar GROUP BY ALL) USING (pass, key)), c(cap) AS (VALUES (CAST(0 AS BIGINT)), (300), (100), (50))
SELECT pass, cap, CAST(sum(least(n1, CASE WHEN cap > 0 THEN cap ELSE 1000000000 END) * least(n2, CASE WHEN cap > 0 THEN cap ELSE 1000000000 END)) AS BIGINT) AS min_cap, CAST(coalesce(sum(CASE WHEN n1 <= CASE WHEN cap > 0 THEN cap ELSE 1000000000 END AND n2 <= CASE WHEN cap > 0 THEN cap ELSE 1000000000 END THEN n1 * n2 END), 0) AS BIGINT) AS drop_cap FROM b CROSS JOIN c GROUP BY ALL""")
def pair_estimates(spark, d):
    return diagnostics.pair_estimates(*V.sides(spark, d), keys.ESTIMATE)


@query("candidate_stats", f"""{O.multipass()}, n AS (SELECT s.entity_id, count(c.entity_id_r) AS n FROM norm s LEFT JOIN cand c ON s.entity_id = c.entity_id_l WHERE s.entity_id LIKE 'S1-%' GROUP BY 1)
SELECT CAST(count(*) AS BIGINT) AS entities, CAST(sum(n) AS BIGINT) AS pairs, round(avg(n), 6) AS mean, CAST(median(n) AS DOUBLE) AS median, CAST(list_sort(list(n))[CAST(floor((count(*) - 1) * 0.9 + 0.5) AS BIGINT) + 1] AS BIGINT) AS p90, CAST(max(n) AS BIGINT) AS max, CAST(count(*) FILTER (n = 0) AS BIGINT) AS zero,
round(1 - sum(n) / (count(*) * CAST((SELECT count(*) FROM norm WHERE entity_id NOT LIKE 'S1-%') AS DOUBLE)), 6) AS reduction FROM n""")
def candidate_stats(spark, d):
    l, r = V.sides(spark, d)
    return six(diagnostics.candidate_stats(_candidates(spark, d), l, r.count()), "mean", "median", "reduction")


def _sizing(name, sql):
    @query(f"rule_sizing_{name}", f"WITH {O.NORM} SELECT '{name}' AS rule, CAST(count(*) AS BIGINT) AS pairs FROM norm l JOIN norm r ON l.entity_id LIKE 'S1-%' AND r.entity_id NOT LIKE 'S1-%' AND l.country_norm = r.country_norm AND {sql}")
    def run(spark, d):
        return sizing.rule_size(*V.sides(spark, d), name)


for _n in (4, 5, 6):
    _sizing(f"prefix{_n}", f"substr(l.name_norm, 1, {_n}) = substr(r.name_norm, 1, {_n})")
_sizing("first_token", "regexp_extract(l.name_norm, '[^ ]+', 0) = regexp_extract(r.name_norm, '[^ ]+', 0)")
_sizing("sdx1", f"{O.soundex('l.name_tokens[1]')} = {O.soundex('r.name_tokens[1]')}")
_sizing("sorted_two", "list_sort(l.name_tokens[1:2]) = list_sort(r.name_tokens[1:2])")


@query("rule_pairs_prefix4", f"WITH {O.NORM} SELECT l.entity_id AS entity_id_l, r.entity_id AS entity_id_r FROM norm l JOIN norm r ON l.entity_id LIKE 'S1-%' AND r.entity_id NOT LIKE 'S1-%' AND l.country_norm = r.country_norm AND substr(l.name_norm, 1, 4) = substr(r.name_norm, 1, 4)")
def rule_pairs_prefix4(spark, d):
    return sizing.rule_pairs(*V.sides(spark, d), "prefix4")


_TOKEN_PAIRS = "SELECT DISTINCT l.entity_id AS entity_id_l, r.entity_id AS entity_id_r FROM t l JOIN t r ON l.t = r.t AND l.entity_id LIKE 'S1-%' AND r.entity_id NOT LIKE 'S1-%'"


@query("rule_pairs_tokens", f"WITH {O.NORM}, t AS (SELECT entity_id, unnest(name_tokens) AS t FROM norm) {_TOKEN_PAIRS}")
def rule_pairs_tokens(spark, d):
    return sizing.rule_pairs(*V.sides(spark, d), "tokens")


@query("rules_measured", f"WITH {O.NORM}, l AS (SELECT *, {O.soundex('name_tokens[1]')} AS sdx1 FROM norm WHERE entity_id LIKE 'S1-%'), r AS (SELECT *, {O.soundex('name_tokens[1]')} AS sdx1 FROM norm WHERE entity_id NOT LIKE 'S1-%'), n AS (" + " UNION ALL ".join([
    *[f"SELECT '{n}' AS rule, CAST(count(*) AS BIGINT) AS pairs FROM l JOIN r ON {c}" for n, c in sizing.RULES.items() if n.startswith(("prefix", "sdx1"))],
    "SELECT 'first_token', CAST(count(*) AS BIGINT) FROM l JOIN r ON l.country_norm = r.country_norm AND regexp_extract(l.name_norm, '[^ ]+', 0) = regexp_extract(r.name_norm, '[^ ]+', 0)",
    "SELECT 'sorted_two', CAST(count(*) AS BIGINT) FROM l JOIN r ON l.country_norm = r.country_norm AND list_sort(l.name_tokens[1:2]) = list_sort(r.name_tokens[1:2])",
    "SELECT 'tokens', CAST(count(*) AS BIGINT) FROM (SELECT unnest(name_tokens) AS t FROM l) a JOIN (SELECT unnest(name_tokens) AS t FROM r) b ON a.t = b.t",
]) + ") SELECT rule, pairs, pairs <= 60000 AS kept FROM n")
def rules_measured(spark, d):
    return sizing.measured(*V.sides(spark, d), most=60_000)


@query("token_overlap_count", f"WITH {O.NORM}, t AS (SELECT entity_id, unnest(name_tokens) AS t FROM norm) SELECT CAST(count(*) AS BIGINT) AS pairs FROM t l JOIN t r ON l.t = r.t AND l.entity_id LIKE 'S1-%' AND r.entity_id NOT LIKE 'S1-%'")
def token_overlap_count(spark, d):
    return sizing.token_overlap(*V.sides(spark, d))


@query("truth_with_shared_token", f"WITH {O.NORM}, {O.TRUTH}, t AS (SELECT entity_id, unnest(name_tokens) AS t FROM norm) SELECT CAST(count(*) AS BIGINT) AS hit FROM truth g WHERE EXISTS (SELECT 1 FROM t a JOIN t b ON a.t = b.t WHERE a.entity_id = g.entity_id_l AND b.entity_id = g.entity_id_r)")
def truth_with_shared_token(spark, d):
    return sizing.truth_with_shared_token(*V.sides(spark, d), V.truth(spark, d))


# Labels and recall

@query("ground_truth_explode", f"WITH {O.TRUTH} SELECT * FROM truth WHERE entity_id_r LIKE 'S2-%'")
def ground_truth_explode(spark, d):
    lists = assemble.packed(V.truth(spark, d), "matched_entity_ids").withColumnRenamed("entity_id_l", "source1_entity_id")
    return labels.ground_truth(lists, 2)


@query("entity_split", f"WITH {O.NORM} SELECT DISTINCT entity_id, CAST({_VALIDATION} AS INTEGER) AS isval FROM norm")
def entity_split(spark, d):
    return labels.entity_split(V.norm(spark, d))


@query("split_leakage", f"WITH {O.NORM} SELECT entity_id FROM norm WHERE {_VALIDATION} INTERSECT SELECT entity_id FROM norm WHERE NOT {_VALIDATION}")
def split_leakage(spark, d):
    s = labels.entity_split(V.norm(spark, d))
    return labels.leakage(s.where("isval = 0"), s.where("isval = 1"))


_HIT = "h AS (SELECT t.*, c.entity_id_l IS NOT NULL AS hit FROM truth t LEFT JOIN cand c ON t.entity_id_l = c.entity_id_l AND t.entity_id_r = c.entity_id_r)"


@query("pair_recall", f"{O.multipass()}, {O.TRUTH}, {_HIT} SELECT CAST(count(*) FILTER (hit) AS BIGINT) AS hit, CAST(count(*) AS BIGINT) AS total, round(count(*) FILTER (hit) / CAST(count(*) AS DOUBLE), 6) AS recall FROM h")
def pair_recall(spark, d):
    return six(diagnostics.pair_recall(_candidates(spark, d), V.truth(spark, d)), "recall")


@query("recall_by_country", f"{O.multipass()}, {O.TRUTH}, {_HIT} SELECT country_norm, CAST(count(*) FILTER (hit) AS BIGINT) AS hit, CAST(count(*) AS BIGINT) AS total, round(count(*) FILTER (hit) / CAST(count(*) AS DOUBLE), 6) AS recall FROM h JOIN norm ON entity_id = entity_id_l GROUP BY 1")
def recall_by_country(spark, d):
    return six(diagnostics.recall_by_country(_candidates(spark, d), V.truth(spark, d), V.sides(spark, d)[0]), "recall")


def _pass_recall(keys_l, keys_r, names):
    values = ", ".join(f"('{n}')" for n in names)
    return f"g AS (SELECT DISTINCT l.pass, t.* FROM truth t JOIN {keys_l} l ON l.entity_id = t.entity_id_l JOIN {keys_r} r ON r.entity_id = t.entity_id_r AND l.pass = r.pass AND l.key = r.key), a AS (SELECT * FROM g UNION ALL SELECT DISTINCT 'any', entity_id_l, entity_id_r FROM g), p(pass) AS (VALUES {values}, ('any')), tot AS (SELECT count(*) AS total FROM truth)"


@query("recall_by_pass", f"{O.multipass()}, {O.TRUTH}, sl AS (SELECT * FROM kl SEMI JOIN kept USING (pass, key)), sr AS (SELECT * FROM kr SEMI JOIN kept USING (pass, key)), {_pass_recall('sl', 'sr', keys.PASSES)} SELECT p.pass, CAST(count(a.entity_id_l) AS BIGINT) AS hit, CAST(any_value(total) AS BIGINT) AS total, round(count(a.entity_id_l) / CAST(any_value(total) AS DOUBLE), 6) AS recall FROM p LEFT JOIN a USING (pass) CROSS JOIN tot GROUP BY 1")
def recall_by_pass(spark, d):
    return six(diagnostics.recall_by_pass(*V.sides(spark, d), V.truth(spark, d), keys.passes(), suppressed=True), "recall")


@query("recall_ci", f"WITH {O.NORM}, {O.keys_cte({'ct2f': O.SCHEME_SQL['small2'], 'pairf': O.SCHEME_SQL['pairf'], 'sdx0': O.SCHEME_SQL['sdx0'], 'ak': O.SCHEME_SQL['ends']})}, {O.TRUTH}, {_pass_recall('kl', 'kr', keys.DIAGNOSTIC)}, c AS (SELECT p.pass, count(a.entity_id_l) AS hit, any_value(total) AS total FROM p LEFT JOIN a USING (pass) CROSS JOIN tot GROUP BY 1) SELECT pass, CAST(hit AS BIGINT) AS hit, CAST(total AS BIGINT) AS total, round(100 * (hit / CAST(total AS DOUBLE)), 2) AS percent, round(100 * 1.96 * sqrt((hit / CAST(total AS DOUBLE)) * (1 - hit / CAST(total AS DOUBLE)) / total), 2) AS plus_minus FROM c")
def recall_ci(spark, d):
    return diagnostics.recall_with_interval(*V.sides(spark, d), V.truth(spark, d), keys.DIAGNOSTIC)


_CAPS = (50, 100, 300)


@query("capped_recall", f"""WITH {O.NORM}, {O.keys_cte({'ct2f': O.SCHEME_SQL['small2'], 'pairf': O.SCHEME_SQL['pairf'], 'sdx0': O.SCHEME_SQL['sdx0'], 'ak': O.SCHEME_SQL['ends']})}, {O.TRUTH}, {O.COUNTS},
c(cap) AS (VALUES {', '.join(f'({c}::BIGINT)' for c in _CAPS)}), s AS (SELECT pass, key, n1, n2, cap FROM cl JOIN cr USING (pass, key), c WHERE n1 <= cap AND n2 <= cap),
p AS (SELECT pass, cap, sum(n1 * n2) AS pairs FROM s GROUP BY ALL), pp AS (SELECT * FROM p UNION ALL SELECT 'any', cap, sum(pairs) FROM p GROUP BY cap),
h AS (SELECT DISTINCT s.pass, s.cap, t.entity_id_l, t.entity_id_r FROM truth t JOIN kl ON kl.entity_id = t.entity_id_l JOIN kr ON kr.entity_id = t.entity_id_r AND kr.pass = kl.pass AND kr.key = kl.key JOIN s ON s.pass = kl.pass AND s.key = kl.key),
hh AS (SELECT pass, cap, count(*) AS hit FROM h GROUP BY ALL UNION ALL SELECT 'any', cap, count(DISTINCT (entity_id_l, entity_id_r)) FROM h GROUP BY cap), every AS (SELECT pass, cap FROM (VALUES ('ct2f'), ('pairf'), ('sdx0'), ('ak'), ('any')) x(pass), c)
SELECT every.pass, every.cap, CAST(coalesce(pairs, 0) AS BIGINT) AS pairs, CAST(coalesce(hit, 0) AS BIGINT) AS hit, (SELECT count(*) FROM truth)::BIGINT AS total, round(coalesce(hit, 0) / (SELECT count(*) FROM truth)::DOUBLE, 6) AS recall FROM every LEFT JOIN pp ON pp.pass = every.pass AND pp.cap = every.cap LEFT JOIN hh ON hh.pass = every.pass AND hh.cap = every.cap""")
def capped_recall(spark, d):
    return six(diagnostics.capped_recall(*V.sides(spark, d), V.truth(spark, d), keys.DIAGNOSTIC, _CAPS), "recall")


@query("bucket_recall", f"{_capped('rank', blocking.HEAD_CAP, {'sdx': O.SCHEME_SQL['bucket']}).replace('WITH ', f'WITH {O.TRUTH}, ', 1).replace('SELECT DISTINCT hl', ', c AS (SELECT DISTINCT hl')}), h AS (SELECT t.*, c.entity_id_l IS NOT NULL AS hit FROM truth t LEFT JOIN c ON c.entity_id_l = t.entity_id_l AND c.entity_id_r = t.entity_id_r) SELECT CAST(count(*) FILTER (hit) AS BIGINT) AS hit, CAST(count(*) AS BIGINT) AS total, round(count(*) FILTER (hit) / CAST(count(*) AS DOUBLE), 6) AS recall FROM h")
def bucket_recall(spark, d):
    return six(diagnostics.bucket_recall(*V.sides(spark, d), V.truth(spark, d)), "recall")


@query("keys_without_frequent", f"WITH {O.NORM.replace('norm AS (', 'norm0 AS (')}, df AS (SELECT t FROM (SELECT DISTINCT entity_id, t FROM norm0, unnest(name_tokens) a(t)) GROUP BY t HAVING count(*) > 0.15 * (SELECT count(*) FROM norm0)), norm AS (SELECT entity_id, name_norm, list_filter(name_tokens, lambda t: NOT list_contains(gone, t)) AS name_tokens, addr_norm, country_norm FROM norm0, (SELECT coalesce(list(t), []) AS gone FROM df)), {O.keys_cte({'ct2f': O.SCHEME_SQL['small2'], 'pairf': O.SCHEME_SQL['pairf'], 'sdx0': O.SCHEME_SQL['sdx0'], 'ak': O.SCHEME_SQL['ends']})} SELECT entity_id, pass, key FROM k")
def keys_without_frequent(spark, d):
    n = V.norm(spark, d)
    frequent = token_df(spark, d).where(F.col("df") > 0.15 * n.count()).select("token")
    return keys.long_keys(keys.without_tokens(n, frequent), keys.DIAGNOSTIC)


@query("sample_negatives", f"{O.multipass()}, {O.TRUTH} SELECT c.entity_id_l, c.entity_id_r, CAST(t.entity_id_l IS NOT NULL AS INTEGER) AS label FROM cand c LEFT JOIN truth t ON t.entity_id_l = c.entity_id_l AND t.entity_id_r = c.entity_id_r WHERE t.entity_id_l IS NOT NULL OR CAST(('0x' || substr(md5(c.entity_id_l || '~' || c.entity_id_r || '~42'), 1, 8)) AS BIGINT) % 10 = 0")
def sample_negatives(spark, d):
    return labels.keep_negatives(labels.labelled(_candidates(spark, d), V.truth(spark, d)), 10).select(*IDS, "label")


_DRAW = "CAST(('0x' || substr(md5(entity_id || '~42'), 1, 8)) AS BIGINT) / CAST(4294967296 AS DOUBLE)"


@query("sample_rows", f"WITH {O.NORM} SELECT entity_id FROM norm ORDER BY {_DRAW}, entity_id LIMIT 50")
def sample_rows(spark, d):
    return labels.sample_rows(V.norm(spark, d), 50, "entity_id").select("entity_id")


@query("sample_fraction", f"WITH {O.NORM} SELECT entity_id FROM norm WHERE {_DRAW} < 0.1")
def sample_fraction(spark, d):
    return labels.sample_fraction(V.norm(spark, d), 0.1, "entity_id").select("entity_id")


@query("every_fifth", f"WITH {O.SCORED} SELECT entity_id_l, entity_id_r FROM scored QUALIFY row_number() OVER (PARTITION BY src ORDER BY entity_id_l, entity_id_r) % 5 = 1")
def every_fifth(spark, d):
    return labels.every_nth(V.scored(spark, d), 5, *IDS, per="src").select(*IDS)


@query("stratified_split", f"WITH {O.SCORED} SELECT entity_id_l, entity_id_r, label, CAST(CAST(('0x' || substr(md5(concat_ws('~', label, entity_id_l, entity_id_r, '42')), 1, 8)) AS BIGINT) / CAST(4294967296 AS DOUBLE) < 0.2 AS INTEGER) AS isval FROM scored")
def stratified_split(spark, d):
    return labels.stratified_split(V.scored(spark, d), 0.2, *IDS).select(*IDS, "label", "isval")


@query("matched_and_fill", f"WITH {O.NORM}, {O.TRUTH}, m AS (SELECT * FROM norm WHERE entity_id IN (SELECT entity_id_l FROM truth)), r AS (SELECT * FROM norm WHERE entity_id NOT IN (SELECT entity_id_l FROM truth) ORDER BY {_DRAW}, entity_id LIMIT (SELECT greatest(0, 200 - count(*)) FROM m)) SELECT entity_id FROM m UNION ALL SELECT entity_id FROM r")
def matched_and_fill(spark, d):
    t = V.truth(spark, d).select(F.col("entity_id_l").alias("entity_id"))
    return labels.matched_and_fill(V.norm(spark, d), t, 200).select("entity_id")


# Features

_STREETS = f"list_distinct(list_filter(string_split(addr_norm, ' '), lambda t: regexp_matches(t, '^[a-z]+$') AND t NOT IN ({O.quoted(text.STREET_STOP)})))"
_SIDE = f"side AS (SELECT *, coalesce(list_filter(name_tokens, lambda t: t NOT IN ({O.quoted(text.NAME_STOP)}))[1], '') AS fsig, regexp_extract(addr_norm, '\\b(\\d+)\\b', 1) AS house, regexp_extract(addr_norm, '\\b(\\d{{5,6}})\\b', 1) AS pin, {_STREETS} AS street FROM norm)"


def _jac(a: str) -> str:
    u = f"len(list_distinct(list_concat(l.{a}, r.{a})))"
    return f"round(CASE WHEN {u} = 0 THEN 0 ELSE len(list_intersect(l.{a}, r.{a})) / CAST({u} AS DOUBLE) END, 6)"


_MET = "cand c JOIN side l ON l.entity_id = c.entity_id_l JOIN side r ON r.entity_id = c.entity_id_r"


@query("pair_features_native", f"""{O.multipass()}, {O.TRUTH}, {_SIDE} SELECT c.entity_id_l, c.entity_id_r, {_jac('name_tokens')} AS tok_jaccard, CAST(l.country_norm = r.country_norm AS INTEGER) AS country_match, CAST(abs(length(l.name_norm) - length(r.name_norm)) AS BIGINT) AS name_len_diff, CAST(l.fsig = r.fsig AS INTEGER) AS fsig_match,
round(CASE WHEN greatest(length(l.name_norm), length(r.name_norm)) = 0 THEN 1 ELSE 1 - levenshtein(l.name_norm, r.name_norm) / CAST(greatest(length(l.name_norm), length(r.name_norm)) AS DOUBLE) END, 6) AS lev_name,
CAST(l.house <> '' AND l.house = r.house AS INTEGER) AS addr_house_match, CAST(l.pin <> '' AND l.pin = r.pin AS INTEGER) AS addr_pin_match, {_jac('street')} AS addr_street_jaccard, CAST(t.entity_id_l IS NOT NULL AS INTEGER) AS label
FROM {_MET} LEFT JOIN truth t ON t.entity_id_l = c.entity_id_l AND t.entity_id_r = c.entity_id_r""")
def pair_features_native(spark, d):
    out = features.native_features(_candidates(spark, d), *V.sides(spark, d)).select(*IDS, *features.NATIVE)
    return six(labels.labelled(out, V.truth(spark, d)), "tok_jaccard", "lev_name", "addr_street_jaccard")


def _sim(f: str, a: str) -> str:
    return f"round(CASE WHEN l.{a} = '' AND r.{a} = '' THEN 1 ELSE {f}(l.{a}, r.{a}) END, 6)"


@query("pair_features_jaro", f"{O.multipass()}, side AS (SELECT * FROM norm) SELECT c.entity_id_l, c.entity_id_r, {_sim('jaro_winkler_similarity', 'name_norm')} AS jw_name, {_sim('jaro_winkler_similarity', 'addr_norm')} AS jw_addr, {_sim('jaro_similarity', 'name_norm')} AS jaro_name, {_sim('jaro_similarity', 'addr_norm')} AS jaro_addr, CAST(c.entity_id_r LIKE 'S3-%' AS INTEGER) AS src FROM {_MET}")
def pair_features_jaro(spark, d):
    out = features.pair_features(_candidates(spark, d), *V.sides(spark, d)).select(*IDS, *features.JARO, "src")
    return six(out, *features.JARO)


@query("best_match", f"""{O.multipass()}, side AS (SELECT * FROM norm), s AS (SELECT c.entity_id_l, c.entity_id_r, {_jac('name_tokens')} AS prob FROM {_MET})
SELECT entity_id_l, entity_id_r, prob FROM s QUALIFY row_number() OVER (PARTITION BY entity_id_l ORDER BY prob DESC, entity_id_r) = 1""")
def best_match(spark, d):
    scored = six(features.native_features(_candidates(spark, d), *V.sides(spark, d)).withColumnRenamed("tok_jaccard", "prob"), "prob")
    return policy.top1(scored.select(*IDS, "prob"))


# Policies and metrics

@query("flat_policy", f"WITH {O.SCORED} SELECT entity_id_l, entity_id_r, src, prob FROM scored WHERE prob >= 0.55")
def flat_policy(spark, d):
    return policy.flat(V.scored(spark, d), 0.55).select(*IDS, "src", "prob")


def _three(scope, ties):
    by = "entity_id_l" + (", src" if scope == "source" else "")
    place = f"dense_rank() OVER (PARTITION BY {by} ORDER BY prob DESC)" if ties == "all" else f"row_number() OVER (PARTITION BY {by} ORDER BY prob DESC, entity_id_r, src)"
    return f"WITH {O.SCORED}, x AS (SELECT *, max(prob) OVER (PARTITION BY {by}) AS best, {place} AS place FROM scored), pred AS (SELECT * FROM x WHERE best >= 0.1 AND CASE WHEN best >= 0.6 THEN prob >= 0.6 ELSE best >= 0.2 AND place = 1 END)"


def _policy_query(name, scope, ties):
    @query(name, f"{_three(scope, ties)} SELECT entity_id_l, entity_id_r, src, prob FROM pred")
    def run(spark, d):
        return policy.three_threshold(V.scored(spark, d), 0.1, 0.6, 0.2, scope, ties).select(*IDS, "src", "prob")


_policy_query("three_threshold_joint", "joint", "all")
_policy_query("three_threshold_by_source", "source", "all")
_policy_query("three_threshold_one", "joint", "one")


@query("top1", f"WITH {O.SCORED} SELECT entity_id_l, entity_id_r, prob FROM scored QUALIFY row_number() OVER (PARTITION BY entity_id_l ORDER BY prob DESC, entity_id_r) = 1")
def top1(spark, d):
    return policy.top1(V.scored(spark, d)).select(*IDS, "prob")


_COUNTS = "SELECT {by}entity_id_l, sum(label) AS gt, sum(CAST(prob >= {t} AS INTEGER)) AS pred, sum(CAST(prob >= {t} AND label = 1 AS INTEGER)) AS tp FROM {f} GROUP BY ALL"


@query("macro_f05_gt_only", f"WITH {O.SCORED} {O.macro(_COUNTS.format(by='', t=0.5, f='scored'))}")
def macro_f05_gt_only(spark, d):
    return six(metrics.macro_f(V.scored(spark, d), F.col("prob") >= 0.5), "macro_f")


@query("macro_f05_all", f"WITH {O.SCORED}, n AS ({_COUNTS.format(by='', t=0.5, f='scored')}), o AS (SELECT CAST(o_orderkey AS VARCHAR) AS entity_id_l, coalesce(gt, 0) AS gt, coalesce(pred, 0) AS pred, coalesce(tp, 0) AS tp FROM orders LEFT JOIN n ON n.entity_id_l = CAST(o_orderkey AS VARCHAR)) {O.macro('SELECT * FROM o', 'all')}")
def macro_f05_all(spark, d):
    entities = V.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("entity_id_l"))
    return six(metrics.macro_f(V.scored(spark, d), F.col("prob") >= 0.5, "all", entities), "macro_f")


@query("macro_f05_truth", f"WITH {O.SCORED}, t AS (SELECT DISTINCT entity_id_l, entity_id_r FROM scored WHERE label = 1 AND src = 0), g AS (SELECT entity_id_l, count(*) AS gt FROM t GROUP BY 1), p AS (SELECT entity_id_l, sum(CAST(prob >= 0.5 AS INTEGER)) AS pred, sum(CAST(prob >= 0.5 AND label = 1 AS INTEGER)) AS tp FROM scored WHERE src = 0 GROUP BY 1), o AS (SELECT entity_id_l, coalesce(gt, 0) AS gt, coalesce(pred, 0) AS pred, coalesce(tp, 0) AS tp FROM g FULL JOIN p USING (entity_id_l)) {O.macro('SELECT * FROM o', 'all')}")
def macro_f05_truth(spark, d):
    """Of one source, with the number of true pairs taken from the truth and not from the candidates."""
    s = V.scored(spark, d).where("src = 0")
    truth = s.where("label = 1").select(*IDS).distinct()
    return six(metrics.macro_f(s, F.col("prob") >= 0.5, "all", truth=truth), "macro_f")


@query("threshold_sweep", f"WITH {O.SCORED}, g AS (SELECT i / CAST(100 AS DOUBLE) AS threshold FROM (SELECT unnest(range(5, 100, 5)) AS i)) SELECT threshold, macro_f FROM ({O.macro(_COUNTS.format(by='threshold, ', t='threshold', f='scored CROSS JOIN g'), by='threshold')})")
def threshold_sweep(spark, d):
    return six(metrics.sweep(V.scored(spark, d)), "threshold", "macro_f")


_S, _K, _Fb = (0.05, 0.1, 0.15, 0.2, 0.25), (0.5, 0.55, 0.6, 0.65, 0.7, 0.75), (0.2, 0.3, 0.4, 0.5)


@query("policy_grid", f"""WITH {O.SCORED}, g AS (SELECT * FROM (VALUES {', '.join(f'({s}::DOUBLE)' for s in _S)}) a(singleton), (VALUES {', '.join(f'({k}::DOUBLE)' for k in _K)}) b(keep), (VALUES {', '.join(f'({f}::DOUBLE)' for f in _Fb)}) c(fallback) WHERE singleton < fallback AND fallback < keep),
x AS (SELECT *, max(prob) OVER (PARTITION BY entity_id_l) AS best, row_number() OVER (PARTITION BY entity_id_l ORDER BY prob DESC, entity_id_r) AS place FROM scored),
y AS (SELECT singleton, keep, fallback, entity_id_l, label, best >= singleton AND CASE WHEN best >= keep THEN prob >= keep ELSE best >= fallback AND place = 1 END AS hit FROM x CROSS JOIN g)
SELECT singleton, keep, fallback, macro_f FROM ({O.macro('SELECT singleton, keep, fallback, entity_id_l, sum(label) AS gt, sum(CAST(hit AS INTEGER)) AS pred, sum(CAST(hit AND label = 1 AS INTEGER)) AS tp FROM y GROUP BY ALL', by='singleton, keep, fallback')})""")
def policy_grid(spark, d):
    return six(metrics.policy_grid(V.scored(spark, d), _S, _K, _Fb), "macro_f")


@query("pair_prf", f"WITH {O.SCORED}, c AS (SELECT CAST(sum(CAST(prob >= 0.5 AND label = 1 AS INTEGER)) AS BIGINT) AS tp, CAST(sum(CAST(prob >= 0.5 AS INTEGER)) AS BIGINT) AS pred, CAST(sum(label) AS BIGINT) AS gt FROM scored), d AS (SELECT *, tp / CAST(pred AS DOUBLE) AS p, tp / CAST(gt AS DOUBLE) AS r FROM c) SELECT tp, pred, gt, round(p, 6) AS precision, round(r, 6) AS recall, round({O.F05}, 6) AS f FROM d")
def pair_prf(spark, d):
    return six(metrics.pair_prf(V.scored(spark, d), 0.5), "precision", "recall", "f")


@query("singleton_accuracy", f'WITH {O.SCORED}, e AS (SELECT entity_id_l, sum(label) AS gt, max(prob) AS best FROM scored GROUP BY 1 HAVING sum(label) = 0) SELECT CAST(count(*) AS BIGINT) AS singletons, CAST(count(*) FILTER (best < 0.5) AS BIGINT) AS "right", round(count(*) FILTER (best < 0.5) / CAST(count(*) AS DOUBLE), 6) AS accuracy FROM e')
def singleton_accuracy(spark, d):
    return six(metrics.singleton_accuracy(V.scored(spark, d), 0.5), "accuracy")


@query("f05_by_group", f"WITH {O.SCORED}, s AS (SELECT s.*, o_orderstatus FROM scored s JOIN orders ON CAST(o_orderkey AS VARCHAR) = entity_id_l) {O.macro(_COUNTS.format(by='o_orderstatus, ', t=0.5, f='s'), by='o_orderstatus')}")
def f05_by_group(spark, d):
    o = V.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("entity_id_l"), "o_orderstatus")
    return six(metrics.by_group(V.scored(spark, d).join(o, "entity_id_l"), F.col("prob") >= 0.5, "o_orderstatus"), "macro_f")


@query("auc_rank", f"WITH {O.SCORED}, r AS (SELECT label, rank() OVER (ORDER BY prob) + (count(*) OVER (PARTITION BY prob) - 1) / 2.0 AS k FROM scored) SELECT round((sum(CASE WHEN label = 1 THEN k END) - sum(label) * (sum(label) + 1) / 2.0) / (CAST(sum(label) AS DOUBLE) * sum(1 - label)), 6) AS auc FROM r")
def auc_rank(spark, d):
    return six(metrics.auc(V.scored(spark, d)), "auc")


@query("log_loss", f"WITH {O.SCORED}, p AS (SELECT label, greatest(least(prob, 1 - 1e-15), 1e-15) AS p FROM scored) SELECT round(avg(-CASE WHEN label = 1 THEN ln(p) ELSE ln(1 - p) END), 6) AS log_loss FROM p")
def log_loss(spark, d):
    return six(metrics.log_loss(V.scored(spark, d)), "log_loss")


# Lists and their checks

_PREFIXED = f"WITH {O.SCORED}, sp AS (SELECT 'S1-' || entity_id_l AS entity_id_l, CASE WHEN src = 0 THEN 'S2-' ELSE 'S3-' END || entity_id_r AS entity_id_r, src, prob, label FROM scored), canon AS (SELECT 'S1-' || CAST(o_orderkey AS VARCHAR) AS entity_id FROM orders)"


def _prefixed(spark, d):
    s = V.scored(spark, d)
    s = s.withColumns({"entity_id_l": F.concat(F.lit("S1-"), "entity_id_l"), "entity_id_r": F.concat(F.when(F.col("src") == 0, "S2-").otherwise("S3-"), "entity_id_r")})
    return s, V.table(spark, d, "orders").select(F.concat(F.lit("S1-"), F.col("o_orderkey").cast("string")).alias("entity_id"))


_MATCHED = "SELECT entity_id AS source1_entity_id, coalesce(string_agg(DISTINCT entity_id_r, ',' ORDER BY entity_id_r), '') AS matched_entity_ids FROM canon LEFT JOIN sp ON entity_id_l = entity_id AND prob >= 0.6 GROUP BY 1"


@query("match_lists", f"{_PREFIXED} {_MATCHED}")
def match_lists(spark, d):
    s, canon = _prefixed(spark, d)
    return assemble.id_lists(s.where("prob >= 0.6"), canon)


@query("candidate_lists", f"{_PREFIXED} SELECT entity_id AS source1_entity_id, coalesce(string_agg(DISTINCT entity_id_r, ',' ORDER BY entity_id_r), '') AS candidate_entity_ids FROM canon LEFT JOIN sp ON entity_id_l = entity_id GROUP BY 1")
def candidate_lists(spark, d):
    s, canon = _prefixed(spark, d)
    return assemble.id_lists(s, canon, "candidate_entity_ids", resort=False)


@query("lists_by_source", f"{_PREFIXED}, a AS (SELECT entity_id_l, string_agg(entity_id_r, ',' ORDER BY entity_id_r) AS s2 FROM sp WHERE src = 0 AND prob >= 0.6 GROUP BY 1), b AS (SELECT entity_id_l, string_agg(entity_id_r, ',' ORDER BY entity_id_r) AS s3 FROM sp WHERE src = 1 AND prob >= 0.6 GROUP BY 1) SELECT coalesce(a.entity_id_l, b.entity_id_l) AS entity_id, s2, s3 FROM a FULL JOIN b ON a.entity_id_l = b.entity_id_l")
def lists_by_source(spark, d):
    return assemble.by_source(_prefixed(spark, d)[0].where("prob >= 0.6"))


@query("coverage", f"{_PREFIXED}, m AS ({_MATCHED}) SELECT CAST(count(*) AS BIGINT) AS entities, CAST(count(*) FILTER (matched_entity_ids <> '') AS BIGINT) AS matched, round(count(*) FILTER (matched_entity_ids <> '') / CAST(count(*) AS DOUBLE), 6) AS share FROM m")
def coverage(spark, d):
    return six(assemble.coverage(match_lists(spark, d)), "share")


_BROKEN = f"{_PREFIXED}, m AS (SELECT CASE WHEN hash_n % 50 = 0 THEN 'S1-1' ELSE source1_entity_id END AS id, CASE WHEN hash_n % 7 = 0 THEN matched_entity_ids || ',S9-1' WHEN hash_n % 11 = 0 THEN 'S1-5,S2-1,S2-1' ELSE matched_entity_ids END AS l FROM (SELECT *, CAST(substr(source1_entity_id, 4) AS BIGINT) AS hash_n FROM ({_MATCHED}))), i AS (SELECT id, list_filter(string_split(l, ','), lambda x: x <> '') AS ids FROM m)"


def _rule(name: str, offenders: str) -> str:
    return f"SELECT '{name}' AS rule, 'error' AS severity, CAST(count(*) AS BIGINT) AS count, array_to_string((list_sort(list(id)))[1:5], ',') AS examples FROM (SELECT DISTINCT id FROM ({offenders})) HAVING count(*) > 0"


@query("validate_lists", f"{_BROKEN} " + " UNION ALL ".join((
    _rule("duplicate_row", "SELECT id FROM i GROUP BY id HAVING count(*) > 1"), _rule("duplicate_id", "SELECT id FROM i WHERE len(list_distinct(ids)) < len(ids)"),
    _rule("self_match", "SELECT id FROM i WHERE len(list_filter(ids, lambda x: starts_with(x, 'S1-'))) > 0"), _rule("bad_prefix", "SELECT id FROM i WHERE len(list_filter(ids, lambda x: NOT regexp_matches(x, '^S[123]-'))) > 0"),
    _rule("unknown_id", "SELECT x AS id FROM i, unnest(ids) a(x) WHERE x NOT IN (SELECT entity_id_r FROM sp)"),
    _rule("missing_entity", "SELECT entity_id AS id FROM canon WHERE entity_id NOT IN (SELECT id FROM i)"), _rule("unexpected_entity", "SELECT id FROM i WHERE id NOT IN (SELECT entity_id FROM canon)"))))
def validate_lists(spark, d):
    s, canon = _prefixed(spark, d)
    lists = assemble.id_lists(s.where("prob >= 0.6"), canon).withColumn("n", F.expr("CAST(substring(source1_entity_id, 4) AS BIGINT)"))
    l = F.col("matched_entity_ids")
    broken = lists.select(F.when(F.col("n") % 50 == 0, "S1-1").otherwise(F.col("source1_entity_id")).alias("source1_entity_id"), F.when(F.col("n") % 7 == 0, F.concat(l, F.lit(",S9-1"))).when(F.col("n") % 11 == 0, "S1-5,S2-1,S2-1").otherwise(l).alias("matched_entity_ids"))
    found = validate.check_lists(broken, "matched_entity_ids", canon, s.select(F.col("entity_id_r").alias("entity_id")))
    return found.withColumn("examples", F.array_join("examples", ","))


@query("validate_subset", f"{_PREFIXED}, x AS (SELECT entity_id_l AS id FROM sp WHERE prob >= 0.6 GROUP BY 1 HAVING count(*) FILTER (label = 0) > 0) SELECT 'match_outside_candidates' AS rule, 'warning' AS severity, CAST(count(*) AS BIGINT) AS count, array_to_string((list_sort(list(id)))[1:5], ',') AS examples FROM x")
def validate_subset(spark, d):
    s, canon = _prefixed(spark, d)
    m, c = assemble.id_lists(s.where("prob >= 0.6"), canon), assemble.id_lists(s.where("label = 1"), canon, "candidate_entity_ids")
    return validate.check_subset(m, c).withColumn("examples", F.array_join("examples", ","))


# Probabilistic linkage

def _gamma(a: str) -> str:
    s = f"jaro_winkler_similarity(l.{a}, r.{a})"
    return f"CASE WHEN l.{a} = '' OR r.{a} = '' THEN -1 WHEN l.{a} = r.{a} THEN 4 WHEN {s} >= 0.95 THEN 3 WHEN {s} >= 0.9 THEN 2 WHEN {s} >= 0.7 THEN 1 ELSE 0 END"


_G = f"g AS (SELECT c.entity_id_l, c.entity_id_r, {_gamma('name_norm')} AS gamma_name, {_gamma('addr_norm')} AS gamma_addr, CASE WHEN l.country_norm IS NULL OR r.country_norm IS NULL THEN -1 ELSE CAST(l.country_norm = r.country_norm AS INTEGER) END AS gamma_country FROM {_MET})"


@query("fs_gamma", f"{O.multipass()}, side AS (SELECT * FROM norm), {_G} SELECT * FROM g")
def fs_gamma(spark, d):
    return fs.gammas(_candidates(spark, d), *V.sides(spark, d))


def _shares(source: str) -> str:
    parts = " UNION ALL ".join(f"SELECT '{c}' AS comparison, gamma_{c} AS level FROM {source}" for c in fs.COMPARISONS)
    return f"SELECT comparison, level, CAST(count(*) AS BIGINT) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY comparison) AS DOUBLE), 6) AS share FROM ({parts}) WHERE level >= 0 GROUP BY 1, 2"


@query("fs_m", f"WITH {O.NORM}, {O.TRUTH}, cand AS (SELECT * FROM truth), side AS (SELECT * FROM norm), {_G} {_shares('g')}")
def fs_m(spark, d):
    return six(fs.level_shares(fs.gammas(V.truth(spark, d), *V.sides(spark, d))), "share")


_DRAWS = 20_000


def _slots(side: str, test: str) -> str:
    ids = f"(SELECT DISTINCT entity_id FROM norm WHERE {test})"
    return f"SELECT entity_id, CAST(('0x' || substr(md5(entity_id || '~' || r || '~42{side}'), 1, 8)) AS BIGINT) % {_DRAWS} AS slot FROM {ids}, range(1, CAST(ceil({_DRAWS} / (SELECT count(*) FROM {ids})::DOUBLE) AS BIGINT) + 1) x(r)"


_RANDOM = f"""rl AS ({_slots('l', "entity_id LIKE 'S1-%'")}), rr AS ({_slots('r', "entity_id NOT LIKE 'S1-%'")}), drawn AS (SELECT DISTINCT rl.entity_id AS entity_id_l, rr.entity_id AS entity_id_r FROM rl JOIN rr USING (slot))"""


@query("random_pairs", f"WITH {O.NORM}, {_RANDOM} SELECT * FROM drawn")
def random_pairs(spark, d):
    return labels.random_pairs(*V.sides(spark, d), _DRAWS)


@query("fs_u", f"WITH {O.NORM}, {_RANDOM}, cand AS (SELECT * FROM drawn), side AS (SELECT * FROM norm), {_G} {_shares('g')}")
def fs_u(spark, d):
    return six(fs.level_shares(fs.gammas(random_pairs(spark, d), *V.sides(spark, d))), "share")


def _levels(name: str, pairs: str) -> str:
    """The shares of the levels over some pairs, as a table of its own."""
    g = _G.replace("g AS (", f"{name}_g AS (", 1).replace("cand c", f"{pairs} c")
    shares = _shares(f"{name}_g").replace(", 6) AS share", ", 12) AS share")
    return f"{g}, {name} AS ({shares})"


@query("fs_link", f"""{O.multipass()}, {O.TRUTH}, {_RANDOM}, side AS (SELECT * FROM norm), {_G}, {_levels('m', 'truth')}, {_levels('u', 'drawn')},
prior AS (SELECT (SELECT count(*) FROM truth) / ((SELECT count(*) FROM norm WHERE entity_id LIKE 'S1-%') * (SELECT count(*) FROM norm WHERE entity_id NOT LIKE 'S1-%'))::DOUBLE AS p),
lv AS (SELECT comparison, level, log2(greatest(coalesce(m.share, 0), 1e-6) / greatest(coalesce(u.share, 0), 1e-6)) AS w FROM m FULL JOIN u USING (comparison, level)),
w AS (SELECT entity_id_l, entity_id_r, (SELECT log2(p / (1 - p)) FROM prior) + {' + '.join(f"coalesce({c}.w, 0)" for c in fs.COMPARISONS)} AS w FROM g {' '.join(f"LEFT JOIN lv {c} ON {c}.comparison = '{c}' AND {c}.level = gamma_{c}" for c in fs.COMPARISONS)})
SELECT entity_id_l, entity_id_r, round(w, 5) AS match_weight, round(1 / (1 + pow(2.0::DOUBLE, -w)), 5) AS match_probability FROM w""")
def fs_link(spark, d):
    out = fs.link(*V.sides(spark, d), _candidates(spark, d), V.truth(spark, d), draws=_DRAWS)
    return out.select(*IDS, F.round("match_weight", 5).alias("match_weight"), F.round("match_probability", 5).alias("match_probability"))


_M = {"name": {0: 0.05, 1: 0.1, 2: 0.15, 3: 0.2, 4: 0.5}, "addr": {0: 0.3, 1: 0.2, 2: 0.2, 3: 0.1, 4: 0.2}, "country": {0: 0.1, 1: 0.9}}
_U = {"name": {0: 0.8, 1: 0.15, 2: 0.03, 3: 0.01, 4: 0.01}, "addr": {0: 0.5, 1: 0.3, 2: 0.1, 3: 0.05, 4: 0.05}, "country": {0: 0.5, 1: 0.5}}


def _weight(c: str) -> str:
    return f"CASE gamma_{c} " + " ".join(f"WHEN {k} THEN log2({_M[c][k]}::DOUBLE / {_U[c][k]}::DOUBLE)" for k in _M[c]) + " ELSE 0 END"


@query("fs_predict", f"{O.multipass()}, side AS (SELECT * FROM norm), {_G}, w AS (SELECT *, log2(0.001::DOUBLE / 0.999::DOUBLE) + {' + '.join(_weight(c) for c in fs.COMPARISONS)} AS w FROM g) SELECT entity_id_l, entity_id_r, round(w, 5) AS match_weight, round(1 / (1 + pow(2.0::DOUBLE, -w)), 5) AS match_probability FROM w")
def fs_predict(spark, d):
    out = fs.predict(fs_gamma(spark, d), _M, _U, 0.001)
    return out.select(*IDS, F.round("match_weight", 5).alias("match_weight"), F.round("match_probability", 5).alias("match_probability"))


# Vectors

def _vectors(spark, d):
    """Queries: every row whose id is divisible by 20; candidates: the whole table."""
    v = V.table(spark, d, "embeddings").select(F.concat(F.lit("V"), F.col("vec_id").cast("string")).alias("entity_id"), "vec_id", "embedding")
    return v.where("vec_id % 20 = 0").drop("vec_id"), v.drop("vec_id")


def _nearest(k: int) -> str:
    cosine = "list_cosine_similarity(list_transform(a.embedding, lambda x: x::DOUBLE), list_transform(b.embedding, lambda x: x::DOUBLE))"
    return f"""WITH s AS (SELECT 'V' || a.vec_id AS entity_id_l, 'V' || b.vec_id AS entity_id_r, {cosine} AS c FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY entity_id_l ORDER BY round(c, 9) DESC, entity_id_r) AS k FROM s) SELECT entity_id_l, entity_id_r, CAST(k AS INTEGER) AS "rank", round(c, 6) AS cosine FROM r WHERE k <= {k}"""


@query("knn_exact_top50", _nearest(50))
def knn_exact_top50(spark, d):
    return six(vectors.knn_exact(*_vectors(spark, d), k=50), "cosine").select(*IDS, F.col("rank").cast("int").alias("rank"), "cosine")


@query("knn_cells_top10", _nearest(10))
def knn_cells_top10(spark, d):
    l, r = _vectors(spark, d)
    return six(vectors.knn_cells(l, r, vectors.cells(r, 16), 8, 10), "cosine").select(*IDS, F.col("rank").cast("int").alias("rank"), "cosine")


@query("vector_table", _nearest(10))
def vector_table(spark, d):
    """The same neighbours from vectors written in two tables and read again."""
    l, r = _vectors(spark, d)
    folder = io.scratch(spark)
    part = F.pmod(F.crc32("entity_id"), F.lit(2))
    for i in range(2):
        io.write_vectors(r.where(part == i), f"{folder}/{i}")
    again = io.read_vectors(spark, f"{folder}/0", f"{folder}/1")
    return six(vectors.knn_exact(l, again, k=10), "cosine").select(*IDS, F.col("rank").cast("int").alias("rank"), "cosine")


@query("contrastive_positives", f"WITH {O.NORM}, {O.TRUTH} SELECT l.name_norm || ' ' || l.addr_norm AS text_l, r.name_norm || ' ' || r.addr_norm AS text_r, 1 AS label FROM truth JOIN norm l ON l.entity_id = entity_id_l JOIN norm r ON r.entity_id = entity_id_r")
def contrastive_positives(spark, d):
    return vectors.contrastive_pairs(*V.sides(spark, d), V.truth(spark, d)).where("label = 1")


_GRAM = "SELECT entity_id, slot, count(*)::DOUBLE AS n FROM (SELECT entity_id, CAST(('0x' || substr(md5(substr(p, i, 3)), 1, 8)) AS BIGINT) % 256 AS slot FROM (SELECT entity_id, ' ' || trim(name_norm || ' ' || addr_norm) || ' ' AS p FROM norm WHERE {}), unnest(range(1, greatest(length(p) - 2, 1) + 1)) x(i)) GROUP BY ALL"


@query("neighbour_candidates", f"""WITH {O.NORM}, a AS ({_GRAM.format("entity_id LIKE 'S1-%'")}), b AS ({_GRAM.format("entity_id NOT LIKE 'S1-%'")}), al AS (SELECT entity_id, sqrt(sum(n * n)) AS len FROM a GROUP BY 1), bl AS (SELECT entity_id, sqrt(sum(n * n)) AS len FROM b GROUP BY 1),
d AS (SELECT a.entity_id AS entity_id_l, b.entity_id AS entity_id_r, sum(a.n * b.n) AS dot FROM a JOIN b USING (slot) GROUP BY ALL), s AS (SELECT entity_id_l, entity_id_r, coalesce(dot, 0) / (al.len * bl.len) AS c FROM (SELECT al.entity_id AS entity_id_l, bl.entity_id AS entity_id_r FROM al, bl) LEFT JOIN d USING (entity_id_l, entity_id_r) JOIN al ON al.entity_id = entity_id_l JOIN bl ON bl.entity_id = entity_id_r),
r AS (SELECT *, row_number() OVER (PARTITION BY entity_id_l ORDER BY round(c, 9) DESC, entity_id_r) AS k FROM s) SELECT entity_id_l, entity_id_r, CAST(k AS INTEGER) AS "rank", round(c, 6) AS cosine FROM r WHERE k <= 50""")
def neighbour_candidates(spark, d):
    """The vectors are written once: the search reads them several times."""
    folder = io.scratch(spark)
    for name, side in zip("lr", V.sides(spark, d)):
        vectors.hashed_ngrams(vectors.record_text(side)).write.parquet(f"{folder}/{name}")
    l, r = (spark.read.schema("entity_id string, embedding array<double>").parquet(f"{folder}/{name}") for name in "lr")  # noqa: E741
    return six(vectors.knn_exact(l, r, k=50), "cosine").select(*IDS, F.col("rank").cast("int").alias("rank"), "cosine")


@query("encoder_hook", f"WITH {O.NORM}, v AS (SELECT entity_id, length(name_norm || ' ' || addr_norm)::DOUBLE AS a, (length(name_norm || ' ' || addr_norm) - length(replace(name_norm || ' ' || addr_norm, 'a', '')))::DOUBLE AS b FROM norm) SELECT entity_id, round(a / sqrt(a * a + b * b), 6) AS x, round(b / sqrt(a * a + b * b), 6) AS y FROM v")
def encoder_hook(spark, d):
    """Any function from texts to vectors as the encoder: here a text's length and its letters a."""
    out = vectors.encoded(vectors.record_text(V.norm(spark, d)), lambda texts: [[len(t), t.count("a")] for t in texts], 2)
    return six(out.select("entity_id", F.get("embedding", F.lit(0)).alias("x"), F.get("embedding", F.lit(1)).alias("y")), "x", "y")


@query("contrastive_negatives", f"WITH {O.NORM}, {O.TRUTH} SELECT CAST(3 * count(*) AS BIGINT) AS drawn, CAST(0 AS BIGINT) AS true_ones, CAST(0 AS BIGINT) AS repeated, CAST(0 AS BIGINT) AS unknown FROM truth")
def contrastive_negatives(spark, d):
    """Three random negatives a true pair: so many there are, none of them true, twice there or of an unknown id."""
    (l, r), truth = V.sides(spark, d), V.truth(spark, d).distinct()
    folder = io.scratch(spark)
    labels.random_negatives(l, r, truth, 3).write.parquet(f"{folder}/negatives")  # drawn once, looked at four times
    n = spark.read.schema("entity_id_l string, entity_id_r string").parquet(f"{folder}/negatives")
    one = n.agg(F.count(F.lit(1)).alias("drawn")).withColumn("k", F.lit(1))
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name)).withColumn("k", F.lit(1))
    ids = [s.select(F.col("entity_id").alias(i)).distinct().hint("merge") for s, i in zip((l, r), IDS)]
    strange = n.join(ids[0], IDS[0], "left_anti").unionByName(n.join(ids[0], IDS[0], "left_semi").join(ids[1], IDS[1], "left_anti"))
    out = one.join(count(n.join(truth.hint("merge"), list(IDS), "left_semi"), "true_ones"), "k").join(count(n.groupBy(*IDS).count().where("count > 1"), "repeated"), "k").join(count(strange, "unknown"), "k")
    return out.drop("k")


# Files and fixtures

def _tsv(spark, d, folder):
    """The sources as TSV below folder, as the reader expects them."""
    rows = V.biz(spark, d)
    for n in (1, 2, 3):
        io.write_single(rows.where(F.col("entity_id").startswith(f"S{n}-")), io.source_path(folder, "test", n))


@query("tsv_sources", f"WITH {O.NORM} SELECT entity_id, name_norm, array_to_string(name_tokens, ' ') AS tokens, addr_norm, country_norm FROM norm")
def tsv_sources(spark, d):
    """Sources written as TSV, read by their header and normalised into cached tables, which are read as one."""
    folder = io.scratch(spark)
    _tsv(spark, d, folder)
    paths = [f"{folder}/norm{n}" for n in (1, 2, 3)]
    for n, path in enumerate(paths, 1):
        io.cached_normalised(io.read_source(spark, folder, "test", n), path)
    out = io.read_parquets(spark, paths, ["entity_id", "name_norm", "name_tokens", "addr_norm", "country_norm"])
    return out.select("entity_id", "name_norm", F.array_join("name_tokens", " ").alias("tokens"), "addr_norm", "country_norm")


@query("id_list_file", f"{_PREFIXED} {_MATCHED}")
def id_list_file(spark, d):
    """match_lists, written as one TSV file and read again."""
    path = f"{io.scratch(spark)}/lists.tsv"
    io.write_single(match_lists(spark, d), path)
    return io.read_tsv(spark, path, io.TRUTH).na.fill("", ["matched_entity_ids"])


@query("report_file", f"{_PREFIXED}, m AS ({_MATCHED}) SELECT CAST(count(*) AS BIGINT) AS entities, CAST(count(*) FILTER (matched_entity_ids <> '') AS BIGINT) AS matched, round(count(*) FILTER (matched_entity_ids <> '') / CAST(count(*) AS DOUBLE), 6) AS share FROM m")
def report_file(spark, d):
    path = f"{io.scratch(spark)}/report"
    io.write_report(coverage(spark, d), path)
    return spark.read.option("header", True).schema("entities long, matched long, share double").csv(path)


@query("evaluation_log", "SELECT 'a' AS run, CAST(0.5 AS DOUBLE) AS macro_f, CAST(27 AS BIGINT) AS columns UNION ALL SELECT 'b', 0.25, 27")
def evaluation_log(spark, d):
    path = f"{io.scratch(spark)}/log"
    for run, f in (("a", 0.5), ("b", 0.25)):
        io.append_log(spark.createDataFrame([(run, f)], "run string, macro_f double"), path)
    got = spark.read.option("header", True).schema(io.LOG).csv(path)
    return got.select("run", "macro_f", F.lit(len(got.columns)).cast("long").alias("columns"))


@query("saved_policy", "SELECT CAST(0.6 AS DOUBLE) AS keep_threshold, CAST(0.2 AS DOUBLE) AS fallback, CAST(0.1 AS DOUBLE) AS singleton, 'saved' AS kind UNION ALL SELECT 0.55, 0.55, 0.0, 'default'")
def saved_policy(spark, d):
    path = f"{io.scratch(spark)}/policy"
    io.save_policy(spark, {"keep_threshold": 0.6, "fallback_top1_threshold": 0.2, "singleton_cutoff": 0.1}, path)
    both = [(io.load_policy(spark, p), kind) for p, kind in ((path, "saved"), (f"{path}-none", "default"))]
    return spark.createDataFrame([(float(r["keep_threshold"]), float(r["fallback_top1_threshold"]), float(r["singleton_cutoff"]), kind) for r, kind in both], "keep_threshold double, fallback double, singleton double, kind string")


@query("missing_truth", "SELECT CAST(count(*) AS BIGINT) AS rows FROM (SELECT 1 WHERE false)")
def missing_truth(spark, d):
    """A split without a ground truth gives an empty table, and that no pairs."""
    return labels.ground_truth(io.read_ground_truth(spark, io.scratch(spark), "test")).agg(F.count(F.lit(1)).alias("rows"))


@query("empty_candidates", "SELECT CAST('' AS VARCHAR) AS entity_id_l, CAST('' AS VARCHAR) AS entity_id_r WHERE false")
def empty_candidates(spark, d):
    """Empty sides run through all passes and keep the result's columns."""
    l, r = V.sides(spark, d)
    return blocking.multipass(l.where("false"), r, keys.passes(), budget=keys.MAX_TOTAL_PAIRS)


_FILES = {  # name: text of a matching file, and the findings of the validator by a word of each
    "clean": ("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1\nS1-2\t\n", ()), "empty": ("", ("empty",)), "commas": ("source1_entity_id,matched_entity_ids\nS1-1,S2-1\n", ("commas",)),
    "header": ("id\tids\nS1-1\tS2-1\n", ("header",)), "loose": ("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1\nS1-2\n", ("without a tab", "missing_entity")),
    "twice": ("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1\nS1-1\t\nS1-2\t\n", ("duplicate_row",)), "repeated": ("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S2-1\nS1-2\t\n", ("duplicate_id",)),
}
_WORDS = ("empty", "commas", "header", "without a tab", "missing_entity", "duplicate_row", "duplicate_id", "missing")


@query("validate_files", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{','.join(sorted(w))}')" for n, (_, w) in {**_FILES, "none": ("", ("missing",))}.items()) + ") v(file, found)")
def validate_files(spark, d):
    """The validator on written files: which findings each gives."""
    folder, out = io.scratch(spark), []
    need = spark.createDataFrame([("S1-1",), ("S1-2",)], "entity_id string")
    for name, (body, _) in {**_FILES, "none": (None, ())}.items():
        if body is not None:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.tsv")
            stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
            stream.write(bytearray(body.encode()))
            stream.close()
        report = validate.validate(spark, f"{folder}/{name}.tsv", f"{folder}/no-candidates.tsv", need)
        said = [next(w for w in _WORDS if w in e.partition(".tsv: ")[2]) for e in report.errors]
        out.append((name, ",".join(sorted(said))))
    return spark.createDataFrame(out, "file string, found string")


@query("list_counts", f"{_PREFIXED}, m AS ({_MATCHED}) SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (matched_entity_ids = '') AS BIGINT) AS empty, CAST(count(*) FILTER (matched_entity_ids <> '') AS BIGINT) AS filled FROM m")
def list_counts(spark, d):
    return validate.counts(match_lists(spark, d), "matched_entity_ids")


# Literal names: name, script, and the romanised name.
_NAMES = (("Acme Steel", "none", None), ("Caf\u00e9 M\u00fcller", "latin", "cafe muller"), ("\u0930\u093e\u092e", "indic", "rama"), ("\u0c30\u0c3e\u0c2e", "indic", "rama"), ("\u0ba8\u0bae", "indic", "nama"), ("\u092d\u093e\u0930\u0924", "indic", "bharata"))


@query("scripts_of_names", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{k}', " + (f"'{r}'" if r else "NULL") + ")" for n, k, r in _NAMES) + ") v(name, kind, plain)")
def scripts_of_names(spark, d):
    """Latin letters with marks are folded, Indic scripts romanised; plain ASCII stays."""
    n = F.col("name")
    kind = F.when(text.is_ascii(n), "none").when(text.has_latin_extended(n), "latin").otherwise("indic")
    rows = spark.createDataFrame([(x,) for x, _, _ in _NAMES], "name string").withColumn("kind", kind)
    return rows.withColumn("plain", F.when(F.col("kind") == "latin", text.fold_text(n)).when(F.col("kind") == "indic", text.romanise(n)))


@query("balanced_sample", f"WITH {O.SCORED}, n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY CAST(('0x' || substr(md5(entity_id_l || '~' || entity_id_r || '~' || src || '~42'), 1, 8)) AS BIGINT), entity_id_l, entity_id_r, src) AS k FROM scored) SELECT entity_id_l, entity_id_r, src, label FROM n WHERE k <= 500")
def balanced_sample(spark, d):
    return labels.balanced(V.scored(spark, d).withColumn("src", F.col("src").cast("string")), 500, *IDS, "src").select(*IDS, F.col("src").cast("int").alias("src"), "label")


@query("grid_neighbourhood", "SELECT * FROM (VALUES (0, CAST(0.05 AS DOUBLE), CAST(0.55 AS DOUBLE), CAST(0.15 AS DOUBLE)), (1, 0.1, 0.6, 0.2), (2, 0.15, 0.65, 0.25)) v(step, singleton, keep, fallback)")
def grid_neighbourhood(spark, d):
    return spark.createDataFrame([(i, *x) for i, x in enumerate(zip(*metrics.neighbourhood((0.1, 0.6, 0.2))))], "step int, singleton double, keep double, fallback double")


@query("linkage_prior", f"WITH {O.NORM}, {O.TRUTH} SELECT round((SELECT count(*) FROM truth) / ((SELECT count(*) FROM norm WHERE entity_id LIKE 'S1-%') * (SELECT count(*) FROM norm WHERE entity_id NOT LIKE 'S1-%'))::DOUBLE, 9) AS prior")
def linkage_prior(spark, d):
    l, r = V.sides(spark, d)
    return spark.createDataFrame([(round(fs.prior(V.truth(spark, d).distinct().count(), l.count(), r.count()), 9),)], "prior double")


@query("training_pairs", f"{O.multipass()}, {O.TRUTH} SELECT c.entity_id_l, c.entity_id_r, CAST(t.entity_id_l IS NOT NULL AS INTEGER) AS label FROM cand c LEFT JOIN truth t ON t.entity_id_l = c.entity_id_l AND t.entity_id_r = c.entity_id_r WHERE NOT {_VALIDATION.replace('entity_id', 'c.entity_id_l')} AND (t.entity_id_l IS NOT NULL OR CAST(('0x' || substr(md5(c.entity_id_l || '~' || c.entity_id_r || '~42'), 1, 8)) AS BIGINT) % 10 = 0)")
def training_pairs(spark, d):
    return features.training_set(_candidates(spark, d), *V.sides(spark, d), V.truth(spark, d), "train", 10).select(*IDS, "label")


@query("label_balance", f"WITH {O.SCORED} SELECT CAST(count(*) AS BIGINT) AS pairs, CAST(sum(label) AS BIGINT) AS positive, round(avg(label), 6) AS rate FROM scored")
def label_balance(spark, d):
    return six(labels.balance(V.scored(spark, d)), "rate")


@query("inference_lists", f"""{O.multipass()}, {_SIDE}, f AS (SELECT c.entity_id_l, c.entity_id_r, {_jac('name_tokens')} AS tok, CAST(l.country_norm = r.country_norm AS INTEGER) AS ctry, CAST(l.fsig = r.fsig AS INTEGER) AS fs,
CASE WHEN greatest(length(l.name_norm), length(r.name_norm)) = 0 THEN 1 ELSE 1 - levenshtein(l.name_norm, r.name_norm) / CAST(greatest(length(l.name_norm), length(r.name_norm)) AS DOUBLE) END AS lev, CAST(l.house <> '' AND l.house = r.house AS INTEGER) AS house, CAST(l.pin <> '' AND l.pin = r.pin AS INTEGER) AS pin, {_jac('street')} AS street FROM {_MET}),
z AS (SELECT *, -6.0::DOUBLE + coalesce(tok, 0) * 4 + coalesce(ctry, 0) + coalesce(fs, 0) * 1.5 + coalesce(lev, 0) * 3 + coalesce(house, 0) + coalesce(pin, 0) + coalesce(street, 0) * 0.5 AS z FROM f)
SELECT n.entity_id AS source1_entity_id, coalesce(string_agg(DISTINCT entity_id_r, ',' ORDER BY entity_id_r), '') AS matched_entity_ids FROM norm n LEFT JOIN z ON z.entity_id_l = n.entity_id AND 1 / (1 + exp(-z)) >= 0.55 WHERE n.entity_id LIKE 'S1-%' GROUP BY 1""")
def inference_lists(spark, d):
    """From TSV sources to written lists, with the plain scorer and the flat default policy."""
    folder = io.scratch(spark)
    _tsv(spark, d, folder)
    inference.infer(spark, folder, "test", f"{folder}/out")
    return io.read_tsv(spark, f"{folder}/out/{inference.MATCHING}", io.TRUTH).na.fill("", ["matched_entity_ids"])


# Models

_ALIKE = "name_norm, addr_norm, country_norm"


@query("record_classes", f"WITH {O.NORM} SELECT entity_id, min(entity_id) OVER (PARTITION BY string_split(entity_id, '-')[1], {_ALIKE}) AS class_id, min(entity_id) OVER (PARTITION BY entity_id LIKE 'S1-%', {_ALIKE}) AS record_id FROM norm")
def record_classes(spark, d):
    """Members of the classes that the matchers' pairs stand for."""
    return blocking.classes(V.norm(spark, d))


def _class_features(spark, d, folder):
    """Features of the candidates as pairs of classes, written below folder, with the classes of both sides. Keys are
    counted over distinct records, so copies of a record neither make a key frequent nor multiply its pairs; records that
    share a key over its limits meet where their names or addresses are equal too (keys.refined)."""
    V.norm(spark, d).write.parquet(f"{folder}/norm")
    norm = spark.read.schema(io.NORMALISED).parquet(f"{folder}/norm")
    blocking.classes(norm).write.parquet(f"{folder}/classes")
    known = spark.read.schema("entity_id string, class_id string, record_id string").parquet(f"{folder}/classes")
    records = norm.join(known.where("entity_id = record_id").select("entity_id").hint("merge"), "entity_id", "left_semi")
    first = F.col("entity_id").startswith("S1-")
    l, r = records.where(first), records.where(~first)
    pairs = blocking.multipass(l, r, keys.passes(), budget=keys.MAX_TOTAL_PAIRS, store=f"{folder}/keys", finer=True)
    met = features.features_by_part(pairs, l, r, folder)
    each = known.where(~first).select(F.col("record_id").alias("entity_id_r"), "class_id").distinct()
    out = met.join(each, "entity_id_r").withColumns({"entity_id_r": F.col("class_id"), "src": F.col("class_id").startswith("S3-").cast("int"), "isval": labels.is_validation(F.col("entity_id_l"))}).drop("class_id")
    out.write.parquet(f"{folder}/features")
    return spark.read.schema(out.schema).parquet(f"{folder}/features"), known.where(first), known.where(~first)


def _learned(spark, parts, folder):
    """The parts to learn from, written: they are read in each round."""
    for i, p in enumerate(parts):
        p.write.parquet(f"{folder}/learned{i}")
    return [spark.read.schema(p.schema).parquet(f"{folder}/learned{i}") for i, p in enumerate(parts)]


@query("gbdt_platt_scores")
def gbdt_platt_scores(spark, d):
    """The matcher by its preset, written and loaded again, on the validation part: pairs of class representatives, with
    label and the number of their members' pairs that have it (record_classes has the members)."""
    from kinlink.operators.model import Matcher, alike, fit_matcher

    folder = io.scratch(spark)
    out = blocking.class_labels(*_class_features(spark, d, folder), V.truth(spark, d))
    out.write.parquet(f"{folder}/labelled")  # read in each round: neither held in memory nor worked out again
    out = spark.read.schema(out.schema).parquet(f"{folder}/labelled")
    parts = labels.keep_negatives(out.where("isval = 0"), 4), out.where("isval = 1")
    fit_matcher(*_learned(spark, [alike(p, features.FEATURES, "pairs") for p in parts], folder), stands="stands").save(f"{folder}/model")
    return Matcher.load(f"{folder}/model").score(out.where("isval = 1")).select(*IDS, F.round("prob", 6).alias("prob"), "label", "pairs")


@query("legacy_matcher", "SELECT CAST(7 AS BIGINT) AS features, 'tok_jaccard' AS first, CAST(1.0 AS DOUBLE) AS importance, true AS ranked, true AS calibrated")
def legacy_matcher(spark, d):
    """The legacy preset on a label that one feature decides: that feature leads, importances add up to 1, true pairs are
    ranked first and Platt's sigmoid is near the labels."""
    from kinlink.operators.model import alike, fit_matcher

    folder = io.scratch(spark)
    out = _class_features(spark, d, folder)[0].withColumn("label", (F.col("tok_jaccard") >= 0.5).cast("int"))
    parts = [alike(out.where(f"isval = {v}"), features.LEGACY) for v in (0, 1)]
    model = fit_matcher(*_learned(spark, parts, folder), "legacy", validationTol=0.1, stands="stands")  # one feature decides: a few dozen rounds do
    scored, parts = model.score(out.where("isval = 1")), model.importances()
    auc, loss = metrics.auc(scored).head().auc, metrics.log_loss(scored).head().log_loss
    return spark.createDataFrame([(len(parts), parts[0][0], round(sum(x for _, x in parts), 6), auc > 0.99, loss < 0.2)], "features long, first string, importance double, ranked boolean, calibrated boolean")
