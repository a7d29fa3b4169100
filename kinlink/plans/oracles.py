"""Fragments of the SQL that queries are held against: the same tables and rules, written for DuckDB."""

from __future__ import annotations

from kinlink.functions import text as T
from kinlink.operators import keys as K
from kinlink.plans import views


def quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _case(table: dict[str, str]) -> str:
    return "CASE t " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in table.items()) + " ELSE t END"


def tokens(x: str) -> str:
    return f"list_filter(string_split(trim(regexp_replace(lower(replace({x}, '''', '')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda t: t <> '')"


def soundex(w: str) -> str:
    letters = f"regexp_replace(lower({w}), '[^a-z]', '', 'g')"
    digits = f"translate({letters}, 'bfpvcgjkqsxzdtlmnraeiouyhw', '111122222222334556')"
    for d in "123456":
        digits = f"regexp_replace({digits}, '{d}+', '{d}', 'g')"
    first = f"substr({letters}, 1, 1)"
    return f"CASE WHEN {letters} = '' THEN '' ELSE upper({first}) || rpad(substr(CASE WHEN {first} IN ('a','e','i','o','u','y','h','w') THEN {digits} ELSE substr({digits}, 2) END, 1, 3), 3, '0') END"


SUFFIX = f"(^| )(?:(?:{'|'.join(T.BUSINESS_SUFFIXES)})(?: |$))+$"
SLOT = "(i = 1 AND p = 1 AND (len(regions) = 1 OR len(r) = 1)) OR (len(regions) > 1 AND i = len(regions) AND p >= len(r) - 1 AND NOT regexp_matches(t, '^[0-9]+$'))"
NORM = f"""biz AS ({views.BIZ}),
n0 AS (SELECT entity_id, lower(trim(country)) AS country_norm, list_filter({tokens("replace(business_name, '&', ' and ')")}, lambda t: t NOT IN ({quoted(T.STOPWORDS)})) AS t0,
  list_transform(string_split(replace(business_address, '&', ' and '), ','), lambda x: {tokens('x')}) AS regions FROM biz),
n1 AS (SELECT entity_id, country_norm, regexp_replace(array_to_string(t0, ' '), '{SUFFIX}', '') AS name_norm,
  array_to_string(list_transform(flatten(list_transform(regions, lambda r, i: list_transform(r, lambda t, p: CASE WHEN {SLOT} THEN {_case(T.US_STATES)} ELSE t END))), lambda t: {_case(T.ADDRESS_EXPANSION)}), ' ') AS addr_norm FROM n0),
norm AS (SELECT entity_id, name_norm, list_filter(string_split(name_norm, ' '), lambda t: t <> '') AS name_tokens, addr_norm, country_norm FROM n1)"""
TRUTH = f"truth AS (SELECT DISTINCT * FROM ({views.TRUTH}))"
SCORED = f"scored AS ({views.SCORED})"
E = """e AS (SELECT *, list_filter(name_tokens, lambda t, i: list_position(name_tokens, t) = i) AS nt, string_split(addr_norm, ' ') AS aw FROM norm)"""
_STOP = quoted(K.ADDR_STOP)
_PAIR = "FROM e, unnest(nt) a(t), unnest(nt) b(u) WHERE t < u"
_WORDS = f"list_filter(aw, lambda t: NOT regexp_matches(t, '^[0-9]+$') AND t NOT IN ({_STOP}))"
_NUMBER = "list_filter(aw, lambda t: regexp_matches(t, '^[0-9]+$'))[1]"
_STREET = f"list_filter(aw, lambda t: regexp_matches(t, '^[^0-9]+$') AND t NOT IN ({_STOP}))[1]"
PASS_SQL = {
    "ct2": "SELECT entity_id, country_norm || '|n|' || array_to_string(list_sort(nt[1:2]), '|') AS key FROM e",
    "pairs_ctry": f"SELECT entity_id, country_norm || '|np|' || t || '|' || u AS key {_PAIR}",
    "pairs_nc": f"SELECT entity_id, 'np|' || t || '|' || u AS key {_PAIR}",
    "tok_ctry": "SELECT entity_id, country_norm || '|nt|' || t AS key FROM e, unnest(nt) a(t)",
    "tok_nc": "SELECT entity_id, 'nt|' || t AS key FROM e, unnest(nt) a(t)",
    "ph_ctry": f"SELECT entity_id, country_norm || '|sx|' || {soundex('nt[1]')} AS key FROM e WHERE len(nt) > 0",
    "ph_nc": f"SELECT entity_id, 'sx|' || {soundex('nt[1]')} AS key FROM e WHERE len(nt) > 0",
    "addr_bigram": f"SELECT entity_id, 'ap|' || t || '|' || u AS key FROM (SELECT entity_id, {_WORDS} AS w FROM e), unnest(w) a(t), unnest(w) b(u) WHERE t < u",
    "postal_ctry": "SELECT entity_id, country_norm || '|zz|' || t AS key FROM e, unnest(aw) a(t) WHERE regexp_matches(t, '^[0-9]{5,6}$')",
    "postal_nc": "SELECT entity_id, 'zz|' || t AS key FROM e, unnest(aw) a(t) WHERE regexp_matches(t, '^[0-9]{5,6}$')",
    "house_ctry": f"SELECT entity_id, country_norm || '|hn|' || {_NUMBER} || '|' || {_STREET} AS key FROM e WHERE {_NUMBER} IS NOT NULL AND {_STREET} IS NOT NULL",
    "house_nc": f"SELECT entity_id, 'hn|' || {_NUMBER} || '|' || {_STREET} AS key FROM e WHERE {_NUMBER} IS NOT NULL AND {_STREET} IS NOT NULL",
}
SCHEME_SQL = {
    "blk_a": "SELECT entity_id, country_norm || '|' || array_to_string(list_sort(name_tokens[1:2]), ' ') AS key FROM e",
    "blk_b1": f"SELECT entity_id, country_norm || '|SX|' || {soundex('name_tokens[1]')} AS key FROM e",
    "blk_b2": f"SELECT entity_id, country_norm || '|SX|' || {soundex('name_tokens[2]')} AS key FROM e",
    "sig": f"SELECT entity_id, country_norm || '|' || array_to_string(list_sort(list_filter(name_tokens, lambda t: t NOT IN ({quoted(T.NAME_STOP)}))[1:2]), '|') AS key FROM e WHERE len(list_filter(name_tokens, lambda t: t NOT IN ({quoted(T.NAME_STOP)}))) > 0",
    "bucket": f"SELECT entity_id, country_norm || '_' || {soundex('name_tokens[1]')} AS key FROM e WHERE len(name_tokens) > 0 AND {soundex('name_tokens[1]')} <> ''",
    "small2": "SELECT entity_id, country_norm || '|' || array_to_string(list_sort(list_distinct(name_tokens))[1:2], ' ') AS key FROM e",
    "sdx0": f"SELECT entity_id, country_norm || '|SX|' || {soundex('name_tokens[1]')} AS key FROM e",
    "pairf": f"SELECT entity_id, country_norm || '|' || t || ' ' || u AS key {_PAIR}",
    "np": f"SELECT entity_id, t || ' ' || u AS key {_PAIR}",
    "ends": "SELECT entity_id, unnest([array_to_string(w[1:2], ' '), array_to_string(w[-2:], ' ')]) AS key FROM (SELECT entity_id, list_filter(aw, lambda t: t <> '') AS w FROM e) WHERE len(w) >= 2",
    "threes": "SELECT entity_id, unnest([array_to_string(list_sort(list_distinct(w))[1:3], ' '), array_to_string(w[1:3], ' ')]) AS key FROM (SELECT entity_id, list_filter(aw, lambda t: t <> '') AS w FROM e) WHERE len(w) > 0",
}


def keys_cte(named: dict[str, str]) -> str:
    """e, and k (entity_id, pass, key) of named key selections."""
    rows = " UNION ALL ".join(f"SELECT entity_id, '{n}' AS pass, key FROM ({q})" for n, q in named.items())
    return f"{E}, k AS (SELECT * FROM ({rows}) WHERE key IS NOT NULL AND length(key) > 0), kl AS (SELECT * FROM k WHERE entity_id LIKE 'S1-%'), kr AS (SELECT * FROM k WHERE entity_id NOT LIKE 'S1-%')"


COUNTS = "cl AS (SELECT pass, key, count(*) AS n1 FROM kl GROUP BY ALL), cr AS (SELECT pass, key, count(*) AS n2 FROM kr GROUP BY ALL)"


def limit_cte(uniform: bool = False) -> str:
    rows = ", ".join(f"('{p.name}', {p.max_freq}, {p.max_pairs})" for p in K.passes(uniform=uniform))
    return f"lim(pass, f, p) AS (VALUES {rows})"


KEPT = "kept AS (SELECT pass, key, n1, n2 FROM cl JOIN cr USING (pass, key) JOIN lim USING (pass) WHERE n1 <= f AND n2 <= f AND n1 * n2 <= p)"
CAND = "cand AS (SELECT DISTINCT kl.entity_id AS entity_id_l, kr.entity_id AS entity_id_r FROM kl JOIN kept USING (pass, key) JOIN kr USING (pass, key))"


def multipass(uniform: bool = False) -> str:
    return f"WITH {NORM}, {keys_cte(PASS_SQL)}, {COUNTS}, {limit_cte(uniform)}, {KEPT}, {CAND}"


F05 = "CASE WHEN 0.25 * p + r = 0 THEN 0 ELSE 1.25 * p * r / (0.25 * p + r) END"


def macro(counts: str, mode: str = "gt_only", by: str = "") -> str:
    """counts: SQL of (entity, gt, pred, tp and the by columns)."""
    empty = "0.0" if mode == "gt_only" else "1.0"
    group = f"GROUP BY {by}" if by else ""
    head = f"{by}, " if by else ""
    where = "WHERE gt > 0" if mode == "gt_only" else ""
    return f"SELECT {head}CAST(count(*) AS BIGINT) AS entities, round(avg({F05}), 6) AS macro_f FROM (SELECT *, CASE WHEN pred = 0 THEN {empty} ELSE tp / CAST(pred AS DOUBLE) END AS p, CASE WHEN gt = 0 THEN {empty} ELSE tp / CAST(gt AS DOUBLE) END AS r FROM ({counts}) {where}) {group}"
