"""DuckDB statements that give the same rows as ``workload.QUERIES``.

``PRELUDE`` derives the tables of ``fixtures``; each statement adds its own
final SELECT. Everything is written from the table definitions, with plain
joins, windows and quantiles, and not from the Spark plans.
"""

from __future__ import annotations

from judgelens.constants import EVIDENCE_COLUMNS, FEATURES, LABELS, REVIEW_FORM_FIELDS, SEED
from judgelens.operators.bootstrap import CHUNK
from judgelens.operators.slices import SLICES

BIG = "::BIGINT"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def h32(key: str) -> str:
    return f"(('0x' || substr(sha256('{SEED}:' || ({key})), 1, 8))::UBIGINT::BIGINT)"


def norm_query(text: str) -> str:
    return f"lower(trim(regexp_replace(coalesce({text}, ''), '\\s+', ' ', 'g')))"


def norm_text(text: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({text}, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def words(text: str) -> str:
    return f"list_filter(string_split({text}, ' '), lambda t: t <> '')"


def numbers(text: str) -> str:
    return f"list_distinct(regexp_extract_all({text}, '[0-9]+'))"


def both(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))"


def div(a: str, b: str, zero: str = "NULL") -> str:
    return f"CASE WHEN ({b}) = 0 THEN {zero} ELSE ({a})::DOUBLE / ({b})::DOUBLE END"


def features_of(source: str) -> str:
    """The 17 features over a relation with the four text columns."""
    return f"""
    SELECT s.* EXCLUDE (q, t, b, c, ql, tl, qs, ts, bs, cs, qn, tn),
      len(ql)::DOUBLE AS query_token_count,
      len(tl)::DOUBLE AS title_token_count,
      {both('qs', 'ts')}::DOUBLE AS token_intersection_count,
      {div(both('qs', 'ts'), 'len(qs)', '0.0')} AS query_coverage,
      {div(both('qs', 'ts'), 'len(ts)', '0.0')} AS title_coverage,
      {div(both('qs', 'ts'), 'len(list_distinct(list_concat(qs, ts)))', '0.0')} AS token_jaccard,
      (q <> '' AND q = t)::INT::DOUBLE AS exact_title_match,
      (q <> '' AND contains(' ' || t || ' ', ' ' || q || ' '))::INT::DOUBLE AS query_in_title,
      {both('qs', 'bs')}::DOUBLE AS brand_token_overlap,
      (len(bs) > 0 AND {both('qs', 'bs')} = len(bs))::INT::DOUBLE AS brand_match,
      {both('qs', 'cs')}::DOUBLE AS color_token_overlap,
      (len(cs) > 0 AND {both('qs', 'cs')} = len(cs))::INT::DOUBLE AS color_match,
      (len(qn) > 0)::INT::DOUBLE AS query_has_number,
      (len(list_filter(qn, lambda n: NOT list_contains(tn, n))) > 0)::INT::DOUBLE AS numeric_mismatch,
      (t = '')::INT::DOUBLE AS title_missing,
      (b = '')::INT::DOUBLE AS brand_missing,
      (c = '')::INT::DOUBLE AS color_missing
    FROM (
      SELECT n.*, {words('q')} AS ql, {words('t')} AS tl, list_distinct({words('q')}) AS qs,
        list_distinct({words('t')}) AS ts, list_distinct({words('b')}) AS bs,
        list_distinct({words('c')}) AS cs, {numbers('q')} AS qn, {numbers('t')} AS tn
      FROM (SELECT x.*, {norm_text('query')} AS q, {norm_text('product_title')} AS t,
              {norm_text('product_brand')} AS b, {norm_text('product_color')} AS c FROM {source} x) n
    ) s"""


FEATURE_LIST = ", ".join(FEATURES)

PRELUDE = f"""WITH
judged AS (
  SELECT l_orderkey AS query_id, l_partkey, min(l_linenumber) AS line, min(l_returnflag) AS flag
  FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY ALL),
keyed AS (
  SELECT *, CASE WHEN query_id % 50 = 0 AND query_id > 0 THEN query_id - 1 ELSE query_id END AS base FROM judged),
pairs AS (
  SELECT k.query_id * 1000000 + k.l_partkey AS example_id,
    CASE WHEN k.query_id % 50 = 0
      THEN '  ' || upper(a.p_name) || '  ' || a.p_size || ' M' || k.base || ' '
      ELSE a.p_name || ' ' || a.p_size || ' m' || k.base END AS query,
    k.query_id, 'P' || k.l_partkey AS product_id,
    CASE WHEN k.l_partkey % 10 = 9 THEN 'es' ELSE 'us' END AS product_locale,
    CASE WHEN k.flag = 'N' THEN 'E'
      WHEN string_split(i.p_name, ' ')[2] = string_split(a.p_name, ' ')[2] THEN 'S'
      WHEN string_split(i.p_name, ' ')[1] = string_split(a.p_name, ' ')[1] THEN 'C' ELSE 'I' END AS esci_label,
    CASE WHEN k.query_id % 20 = 7 THEN 0 ELSE 1 END::BIGINT AS large_version,
    CASE WHEN k.query_id % 101 = 0 THEN CASE WHEN k.line <= 2 THEN 'test' ELSE 'train' END
      WHEN k.query_id % 5 = 0 THEN 'test' ELSE 'train' END AS split
  FROM keyed k JOIN part a ON a.p_partkey = k.base % (SELECT count(*) FROM part)
    JOIN part i ON i.p_partkey = k.l_partkey),
products AS (
  SELECT CASE WHEN p_partkey % 10 = 9 THEN 'es' ELSE 'us' END AS product_locale, 'P' || p_partkey AS product_id,
    CASE WHEN p_partkey % 31 = 0 THEN ' ' ELSE p_name || ' ' || p_type || ' ' || p_size END AS product_title,
    CASE WHEN p_partkey % 7 <> 0 THEN p_brand END AS product_brand,
    CASE WHEN p_partkey % 5 <> 0 THEN p_type END AS product_color
  FROM part WHERE p_partkey % 53 <> 0),
sp AS (SELECT * FROM pairs WHERE product_locale = 'us' AND large_version = 1),
pr AS (SELECT * FROM products WHERE product_locale = 'us'),
joined AS (
  SELECT sp.*, pr.product_title, pr.product_brand, pr.product_color, pr.product_id IS NOT NULL AS product_matched
  FROM sp LEFT JOIN pr USING (product_locale, product_id)),
spn AS (SELECT *, {norm_query('query')} AS query_norm FROM sp),
both_ids AS (SELECT DISTINCT query_id FROM spn WHERE split = 'train' AND query_id IN (SELECT query_id FROM spn WHERE split = 'test')),
both_texts AS (SELECT DISTINCT query_norm FROM spn WHERE split = 'train' AND query_norm IN (SELECT query_norm FROM spn WHERE split = 'test')),
leaky AS (
  SELECT query_id FROM both_ids UNION
  SELECT query_id FROM spn WHERE split = 'train' AND query_norm IN (SELECT query_norm FROM both_texts)),
assigned AS (
  SELECT *, CASE WHEN split = 'test' THEN 'test'
      WHEN {h32('query_norm')} % 10000 < 2000 THEN 'validation' ELSE 'train' END AS dataset_split
  FROM spn WHERE split = 'test' OR (split = 'train' AND query_id NOT IN (SELECT query_id FROM leaky))),
seen AS (SELECT DISTINCT product_locale, product_id FROM assigned WHERE dataset_split = 'train'),
assigned_joined AS (
  SELECT a.*, pr.product_title, pr.product_brand, pr.product_color, seen.product_id IS NOT NULL AS product_seen_train
  FROM assigned a LEFT JOIN pr USING (product_locale, product_id) LEFT JOIN seen USING (product_locale, product_id)),
featured AS ({features_of('assigned_joined')}),
features AS (
  SELECT example_id, query_id, query_norm, query, product_id, product_title, product_brand, esci_label AS label,
    dataset_split, product_seen_train, {FEATURE_LIST} FROM featured),
scope_seen AS (
  SELECT j.*, seen.product_id IS NOT NULL AS product_seen_train
  FROM joined j LEFT JOIN seen USING (product_locale, product_id)),
scope_featured AS ({features_of('scope_seen')}),
scope_noise AS (SELECT *, {h32('example_id')} AS h FROM scope_featured),
scope_score AS (SELECT *, round(0.05::DOUBLE + 0.5::DOUBLE * query_coverage + 0.3::DOUBLE * h / 4294967296.0::DOUBLE, 6) AS p_e FROM scope_noise),
scored_features AS MATERIALIZED (
  SELECT * EXCLUDE (h, esci_label), esci_label AS label,
    CASE WHEN p_e >= 0.30::DOUBLE THEN 'E' WHEN token_intersection_count >= 1 THEN 'S'
      WHEN h % 3 = 0 THEN 'C' ELSE 'I' END AS prediction
  FROM scope_score),
scored AS (
  SELECT example_id, query_id, label, prediction, p_e, query_token_count, query_has_number, numeric_mismatch,
    brand_missing, title_missing, product_seen_train FROM scored_features),
queue AS MATERIALIZED (
  SELECT example_id, query_id, p_e, label, row_number() OVER (ORDER BY p_e, example_id) AS queue_rank
  FROM scored WHERE prediction = 'E')
"""

LABEL_ROWS = ", ".join(f"('{label}', {place})" for place, label in enumerate(LABELS))


def per_class(relation: str, group: str = "") -> str:
    """Support, predicted, correct for all four labels of each group."""
    return f"""SELECT {group + ',' if group else ''} l.label, l.place,
      count(*) FILTER (s.label = l.label) AS support,
      count(*) FILTER (s.prediction = l.label) AS predicted,
      count(*) FILTER (s.label = l.label AND s.prediction = l.label) AS correct
    FROM (VALUES {LABEL_ROWS}) l(label, place) CROSS JOIN {relation} s GROUP BY ALL"""


F1 = div("2 * correct", "support + predicted", "0.0")


def summary(relation: str, group: str = "") -> str:
    """n_rows, accuracy, macro_f1 of each group; F1 is added in class order."""
    lead = group + "," if group else ""
    ordered = " + ".join(f"max({F1}) FILTER (label = '{label}')" for label in LABELS)
    return f"""SELECT {lead} sum(support)::BIGINT AS n_rows, {div('sum(correct)', 'sum(support)')} AS accuracy,
      ({ordered}) / 4 AS macro_f1 FROM ({per_class(relation, group)}) GROUP BY ALL"""


def review(queue: str, budgets: str, group: str = "") -> str:
    lead = group + "," if group else ""
    return f"""SELECT {lead} f AS budget_fraction, k AS n_reviewed,
      count(*) FILTER (queue_rank <= k AND label <> 'E') AS n_errors_found,
      count(*) FILTER (queue_rank <= k AND label = 'S') AS errors_s,
      count(*) FILTER (queue_rank <= k AND label = 'C') AS errors_c,
      count(*) FILTER (queue_rank <= k AND label = 'I') AS errors_i,
      count(*) AS n, count(*) FILTER (label <> 'E') AS e
    FROM (SELECT q.*, b.f, floor(count(*) OVER (PARTITION BY {lead} b.f)::DOUBLE * b.f)::BIGINT AS k
          FROM {queue} q CROSS JOIN (VALUES {budgets}) b(f)) GROUP BY ALL"""


TWO_BUDGETS = "(0.05::DOUBLE), (0.1::DOUBLE)"


def review_select(queue: str) -> str:
    return f"""SELECT budget_fraction, n_reviewed, n_errors_found, errors_s, errors_c, errors_i,
      {div('n_errors_found', 'n_reviewed')} AS audit_yield,
      CASE WHEN n_reviewed > 0 THEN {div('n_errors_found', 'e')} END AS error_recall,
      n - n_reviewed AS n_remaining, e - n_errors_found AS n_remaining_errors,
      {div('e - n_errors_found', 'n - n_reviewed')} AS remaining_error_rate
    FROM ({review(queue, TWO_BUDGETS)})"""


EXPECTED = """expected AS (
  SELECT f AS budget_fraction, n, e, floor(n::DOUBLE * f)::BIGINT AS k,
    floor(n::DOUBLE * f) * e / n AS found, floor(n::DOUBLE * f) * s / n AS fs,
    floor(n::DOUBLE * f) * c / n AS fc, floor(n::DOUBLE * f) * i / n AS fi
  FROM (SELECT count(*)::DOUBLE AS n, count(*) FILTER (label <> 'E')::DOUBLE AS e,
          count(*) FILTER (label = 'S')::DOUBLE AS s, count(*) FILTER (label = 'C')::DOUBLE AS c,
          count(*) FILTER (label = 'I')::DOUBLE AS i FROM queue)
  CROSS JOIN (VALUES (0.05::DOUBLE), (0.1::DOUBLE)) b(f))"""

RANDOM_DRAWS = f""", pool AS (
  SELECT f, count(*) AS n, count(*) FILTER (label <> 'E') AS e, floor(count(*)::DOUBLE * f)::BIGINT AS k
  FROM queue CROSS JOIN (VALUES {TWO_BUDGETS}) b(f) GROUP BY f),
support AS (
  SELECT *, unnest(range(greatest(0, k - (n - e)), least(k, e) + 1)) AS x FROM pool),
steps AS (
  SELECT *, lgamma(e + 1.0) - lgamma(x + 1.0) - lgamma(e - x + 1.0)
    + lgamma(n - e + 1.0) - lgamma(k - x + 1.0) - lgamma(n - e - k + x + 1.0)
    - (lgamma(n + 1.0) - lgamma(k + 1.0) - lgamma(n - k + 1.0)) AS log_mass FROM support),
levels AS (
  SELECT f, k, x, sum(exp(log_mass)) OVER (PARTITION BY f ORDER BY x) AS level FROM steps),
uniforms AS (
  SELECT f, r, ({h32("f || ':' || r")} + 0.5) / 4294967296.0 AS u FROM pool CROSS JOIN range(1, 101) t(r)),
draws AS (
  SELECT u.f, u.r, min(l.x) AS found, any_value(l.k) AS k
  FROM uniforms u JOIN levels l ON l.f = u.f AND l.level >= u.u GROUP BY u.f, u.r)
SELECT f AS budget_fraction, count(*) AS repeats, round(sum(found)::DOUBLE / sum(k)::DOUBLE, 9) AS yield_mean,
  round(quantile_cont(found::DOUBLE / k::DOUBLE, 0.025), 9) AS yield_p025,
  round(quantile_cont(found::DOUBLE / k::DOUBLE, 0.975), 9) AS yield_p975
FROM draws GROUP BY f"""

MASK, STEP = 4294967295, 1640531527


def mixed(value: str) -> str:
    """The integer mixer as one nested expression over a column."""
    out = f"((xor({value}, {value} >> 16) * 2146121005) & {MASK})"
    out = f"((xor({out}, {out} >> 15) * 569420461) & {MASK})"
    return f"xor({out}, {out} >> 15)"


def weights(replicates: int, seed: int = SEED) -> str:
    """wts(replicate, idx, w): multiplicity of each query, by counting every single draw."""
    return f""", q AS MATERIALIZED (
  SELECT query_id, row_number() OVER (ORDER BY query_id) - 1 AS idx FROM (SELECT DISTINCT query_id FROM scored)),
g AS (SELECT count(*) AS g FROM q),
r0 AS (SELECT r AS replicate, ({seed} + r * {STEP}) & {MASK} AS k0 FROM range({replicates}) t(r)),
r1 AS (SELECT replicate, {mixed('k0')} AS a FROM r0),
r2 AS (SELECT replicate, a, xor(a, {STEP}) AS a2 FROM r1),
r3 AS MATERIALIZED (SELECT replicate, a, {mixed('a2')} AS b FROM r2),
d0 AS (SELECT replicate, g, xor(j, a) AS x0, (j + b) & {MASK} AS y0 FROM (SELECT r3.*, g.g, unnest(range(g.g)) AS j FROM r3 CROSS JOIN g)),
d1 AS (SELECT replicate, g, {mixed('x0')} AS x, {mixed('y0')} AS y FROM d0),
d2 AS (SELECT replicate, g, floor((xor(x, y) * 2097152 + (y >> 11))::DOUBLE / 9007199254740992::DOUBLE * g::DOUBLE)::BIGINT // {CHUNK} AS chunk FROM d1),
n0 AS (SELECT replicate, chunk, any_value(g) AS g, count(*) AS n FROM d2 GROUP BY replicate, chunk),
n1 AS (SELECT n0.*, (r3.a + (chunk + 1) * {STEP}) & {MASK} AS k FROM n0 JOIN r3 USING (replicate)),
n2 AS (SELECT *, {mixed('k')} AS k1 FROM n1),
n3 AS (SELECT *, xor(k1, {STEP}) AS k2x FROM n2),
n4 AS MATERIALIZED (SELECT replicate, chunk, g, n, k1, {mixed('k2x')} AS k2 FROM n3),
p0 AS (SELECT *, xor(t, k1) AS x0, (t + k2) & {MASK} AS y0 FROM (SELECT *, unnest(range(1, n + 1)) AS t FROM n4)),
p1 AS (SELECT replicate, chunk, least({CHUNK}, g - chunk * {CHUNK}) AS size, {mixed('x0')} AS x, {mixed('y0')} AS y FROM p0),
wts AS MATERIALIZED (
  SELECT replicate, chunk * {CHUNK} + ((xor(x, y) * size) >> 32) AS idx, count(*) AS w FROM p1 GROUP BY ALL)"""


REPLICATE_F1 = f""", cells AS (
  SELECT q.idx, s.label, s.prediction, count(*) AS n FROM scored s JOIN q USING (query_id) GROUP BY ALL),
wcells AS (
  SELECT replicate, label, prediction, sum(w * n)::BIGINT AS n FROM wts JOIN cells USING (idx) GROUP BY ALL),
wclass AS (
  SELECT replicate, l.label, coalesce(sum(n) FILTER (c.label = l.label), 0) AS support,
    coalesce(sum(n) FILTER (c.prediction = l.label), 0) AS predicted,
    coalesce(sum(n) FILTER (c.label = l.label AND c.prediction = l.label), 0) AS correct
  FROM wcells c CROSS JOIN (VALUES {LABEL_ROWS}) l(label, place) GROUP BY ALL),
rep_f1 AS (
  SELECT replicate, ({' + '.join(f"max({F1}) FILTER (label = '{label}')" for label in LABELS)}) / 4 AS macro_f1
  FROM wclass GROUP BY replicate)"""

REPLICATE_YIELD = f""", wq AS (
  SELECT replicate, queue_rank, w, (label <> 'E')::INT AS err,
    sum(w) OVER (PARTITION BY replicate) AS size,
    sum(w) OVER (PARTITION BY replicate ORDER BY queue_rank) - w AS preceding
  FROM queue JOIN q USING (query_id) JOIN wts USING (idx)),
wk AS (SELECT *, floor(size::DOUBLE * 0.1::DOUBLE)::BIGINT AS k FROM wq),
rep_yield AS (
  SELECT replicate, any_value(k) AS n_reviewed,
    sum(least(w, greatest(k - preceding, 0)) * err)::DOUBLE / any_value(k)::DOUBLE AS priority_yield,
    sum(w * err)::DOUBLE / sum(w)::DOUBLE AS random_yield
  FROM wk WHERE k > 0 GROUP BY replicate)"""

INTERVALS = f"""{REPLICATE_F1}{REPLICATE_YIELD},
long AS (
  SELECT 'macro_f1' AS statistic, macro_f1 AS v FROM rep_f1
  UNION ALL SELECT 'audit_yield', priority_yield FROM rep_yield
  UNION ALL SELECT 'random_expected_yield', random_yield FROM rep_yield
  UNION ALL SELECT 'audit_yield_minus_random', priority_yield - random_yield FROM rep_yield),
head AS (SELECT n_errors_found::DOUBLE / n_reviewed AS p, e::DOUBLE / n AS r FROM ({review('queue', '(0.1::DOUBLE)')})),
points AS (
  SELECT 'macro_f1' AS statistic, macro_f1 AS point FROM ({summary('scored')})
  UNION ALL SELECT 'audit_yield', p FROM head
  UNION ALL SELECT 'random_expected_yield', r FROM head
  UNION ALL SELECT 'audit_yield_minus_random', p - r FROM head),
intervals AS (
  SELECT statistic, point, quantile_cont(v, 0.025) AS low, quantile_cont(v, 0.975) AS high, count(v) AS n_valid
  FROM points JOIN long USING (statistic) GROUP BY ALL)"""

SLICE_UNION = " UNION ALL ".join(
    f"SELECT '{name}' AS slice, * FROM scored WHERE {rule}" for name, rule in SLICES.items()
)
SLICE_QUEUE = """sliced_queue AS (
  SELECT slice, label, row_number() OVER (PARTITION BY slice ORDER BY p_e, example_id) AS queue_rank
  FROM sliced WHERE prediction = 'E')"""

CASE_SAMPLE = f"""sampled AS (
  SELECT example_id, label, prediction, p_e, row_number() OVER (PARTITION BY label, prediction
    ORDER BY sha256('{SEED}:' || example_id), example_id) AS sample_rank
  FROM scored WHERE label <> prediction QUALIFY sample_rank <= 4)"""
CASE_EVIDENCE = f"""SELECT s.*, f.query, f.product_title, f.label AS source_label,
  {', '.join('f.' + name for name in EVIDENCE_COLUMNS)}, f.example_id IS NOT NULL AS source_matched
  FROM sampled s LEFT JOIN scored_features f USING (example_id)"""
CASE_NOTES = """'judged ' || label || ', predicted ' || prediction
  || ': one of the first 4 such errors by hash' AS selection_reason, 'pending' AS human_review_status, """ + ", ".join(
    f"'' AS {name}" for name in REVIEW_FORM_FIELDS
)

MISSING = lambda column: f"count(*) FILTER ({column} IS NULL OR trim({column}) = '')"

CELLS = ", ".join(
    f"count(*) FILTER (label = '{a}' AND prediction = '{b}') AS n_{a.lower()}{b.lower()}" for a in LABELS for b in LABELS
)

TRAIN = "(SELECT * FROM features WHERE dataset_split = 'train')"
AUDIT = """SELECT
  (SELECT count(*) FROM sp) AS n_pairs, (SELECT count(*) FROM pr) AS n_products,
  (SELECT count(*) FROM (SELECT 1 FROM pr GROUP BY product_locale, product_id HAVING count(*) > 1)) AS duplicate_product_keys,
  (SELECT count(*) FROM (SELECT 1 FROM sp GROUP BY example_id HAVING count(*) > 1)) AS duplicate_example_ids,
  (SELECT count(*) FROM joined) AS joined_rows,
  (SELECT count(*) FROM joined WHERE NOT product_matched) AS unmatched_products,
  (SELECT count(*) FROM joined WHERE trim(coalesce(product_title, '')) = '') AS blank_titles,
  (SELECT count(*) FROM both_ids) AS overlap_ids, (SELECT count(*) FROM both_texts) AS overlap_texts,
  (SELECT count(*) FROM leaky) AS excluded_query_ids,
  (SELECT count(*) FROM (SELECT query_id, product_id FROM sp WHERE split = 'train'
     INTERSECT SELECT query_id, product_id FROM sp WHERE split = 'test')) AS pair_overlap,
  (SELECT count(*) FROM sp) - (SELECT count(*) FROM assigned) AS excluded_rows"""

KEY = "example_id"
PAIR_DAMAGE = f"""bad AS (
  SELECT CASE WHEN {KEY} % 101 <> 1 THEN example_id END AS example_id,
    CASE WHEN {KEY} % 103 = 2 THEN ' ' || chr(9) || ' ' WHEN {KEY} % 97 <> 3 THEN query END AS query,
    CASE WHEN {KEY} % 89 <> 4 THEN query_id END AS query_id, CASE WHEN {KEY} % 83 <> 5 THEN product_id END AS product_id,
    CASE WHEN {KEY} % 79 = 6 THEN 'X' WHEN {KEY} % 73 <> 7 THEN esci_label END AS esci_label,
    CASE WHEN {KEY} % 71 = 8 THEN 'dev' WHEN {KEY} % 67 <> 9 THEN split END AS split
  FROM pairs),
rules AS (
  SELECT query IS NULL AS r1, query IS NOT NULL AND {norm_query('query')} = '' AS r2, query_id IS NULL AS r3,
    example_id IS NULL AS r4, product_id IS NULL AS r5, esci_label IS NULL AS r6,
    esci_label IS NOT NULL AND esci_label NOT IN ('E', 'S', 'C', 'I') AS r7, split IS NULL AS r8,
    split IS NOT NULL AND split NOT IN ('train', 'test') AS r9 FROM bad)"""
SCORED_DAMAGE = f"""bad AS (
  SELECT CASE WHEN {KEY} % 61 = 1 THEN {KEY} // 1000000 WHEN {KEY} % 59 <> 2 THEN example_id END AS example_id,
    CASE WHEN {KEY} % 53 <> 3 THEN query_id END AS query_id,
    CASE WHEN {KEY} % 79 = 6 THEN 'X' ELSE label END AS label, CASE WHEN {KEY} % 73 <> 7 THEN prediction END AS prediction,
    CASE WHEN {KEY} % 47 = 4 THEN 'NaN'::DOUBLE WHEN {KEY} % 43 = 5 THEN p_e + 1 WHEN {KEY} % 41 <> 6 THEN p_e END AS p_e
  FROM scored)"""

OFFSET_PATH = "'part-' || (l_orderkey // 10)"
MANIFESTS = f"""frozen AS (
  SELECT {OFFSET_PATH} AS path, sha256(sum((l_quantity * 100)::BIGINT)::BIGINT::VARCHAR) AS h FROM lineitem
  WHERE (l_orderkey // 10) % 7 <> 0 GROUP BY 1),
current AS (
  SELECT {OFFSET_PATH} AS path, sha256(sum((CASE WHEN (l_orderkey // 10) % 5 = 0 THEN 1.0::DOUBLE ELSE l_quantity END * 100)::BIGINT)::BIGINT::VARCHAR) AS h
  FROM lineitem WHERE (l_orderkey // 10) % 11 <> 0 GROUP BY 1)"""

MATRIX = lambda relation: f"""SELECT a.label, b.label AS prediction,
  (SELECT count(*) FROM {relation} s WHERE s.label = a.label AND s.prediction = b.label) AS n
  FROM (VALUES {LABEL_ROWS}) a(label, place) CROSS JOIN (VALUES {LABEL_ROWS}) b(label, place)"""  # noqa: E731

WORDS = ", ".join(f"sum(('0x' || substr(h, {1 + 8 * i}, 8))::UBIGINT)::VARCHAR AS w{i}" for i in range(8))
DOCS = f"(SELECT doc_id, {norm_text('text')} AS norm FROM documents)"
NORM_WORDS = words("norm")
TRADEOFF = lambda name, relation: f"""SELECT '{name}' AS series, 'accuracy' AS metric, accuracy AS value FROM ({summary(relation)})
  UNION ALL SELECT '{name}', 'macro_f1', macro_f1 FROM ({summary(relation)})
  UNION ALL SELECT '{name}', 'f1_' || lower(label), {F1} FROM ({per_class(relation)})"""  # noqa: E731

FINAL = {
    "feature_profile": "SELECT dataset_split, label, count(*) AS row_count, "
    + ", ".join(f"round(avg({name}), 9) AS {name}" for name in FEATURES)
    + " FROM features GROUP BY dataset_split, label",
    "scan_pairs": "SELECT * FROM pairs",
    "scan_products": "SELECT * FROM products",
    "feature_table_roundtrip": "SELECT * FROM features",
    "split_scan": "SELECT * FROM features WHERE dataset_split = 'validation'",
    "scored_sink": "SELECT * FROM scored",
    "projected_scan": "SELECT example_id, label, prediction, p_e FROM scored",
    "scope_filter": "SELECT * FROM sp",
    "lexical_features": f"SELECT example_id, {FEATURE_LIST} FROM scope_featured",
    "prepared_features": "SELECT * FROM features",
    "label_encode": f"SELECT example_id, esci_label AS label, place::DOUBLE AS target FROM pairs JOIN (VALUES {LABEL_ROWS}) l(label, place) ON l.label = esci_label",
    "class_weights": f"SELECT label, count(*) AS class_count, (sum(count(*)) OVER ())::DOUBLE / (4 * count(*))::DOUBLE AS weight FROM {TRAIN} GROUP BY label",
    "error_rows": "SELECT example_id, label, prediction FROM scored WHERE label <> prediction",
    "predicted_exact_pool": "SELECT example_id, query_id, p_e, label FROM scored WHERE prediction = 'E'",
    "split_overlap_ids": "SELECT * FROM both_ids",
    "split_overlap_texts": "SELECT * FROM both_texts",
    "leaky_query_ids": "SELECT * FROM leaky",
    "drop_leaky_groups": "SELECT * FROM spn WHERE split = 'train' AND query_id NOT IN (SELECT query_id FROM leaky)",
    "assign_splits": "SELECT * FROM assigned",
    "pair_product_join": "SELECT * FROM joined",
    "seen_in_train": "SELECT example_id, dataset_split, product_seen_train FROM assigned_joined",
    "split_disjointness": """SELECT 'query_id' AS key_name, query_id::VARCHAR AS key_value, count(DISTINCT split) AS split_count
      FROM spn GROUP BY query_id HAVING count(DISTINCT split) > 1
      UNION ALL SELECT 'query_norm', query_norm, count(DISTINCT split) FROM spn GROUP BY query_norm HAVING count(DISTINCT split) > 1""",
    "pair_overlap": """SELECT query_id // 50 AS query_id, product_id FROM sp WHERE split = 'train'
      INTERSECT SELECT query_id // 50, product_id FROM sp WHERE split = 'test'""",
    "join_coverage": """SELECT (SELECT count(*) FROM sp) AS input_pair_count, count(*) AS joined_pair_count,
      count(*) FILTER (NOT product_matched) AS unmatched_pair_count, avg(product_matched::INT::DOUBLE) AS product_match_rate FROM joined""",
    "label_balance": """SELECT split, esci_label, count(*) AS pair_count, count(DISTINCT query_id) AS query_count,
      count(*)::DOUBLE / (sum(count(*)) OVER (PARTITION BY split))::DOUBLE AS pair_share FROM sp GROUP BY split, esci_label""",
    "duplicate_product_keys": """SELECT CASE WHEN l_partkey % 10 = 9 THEN 'es' ELSE 'us' END AS product_locale, 'P' || l_partkey AS product_id,
      count(DISTINCT l_suppkey) AS row_count FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) > 1""",
    "duplicate_example_ids": """SELECT l_orderkey * 1000000 + l_partkey AS example_id, count(*) AS row_count
      FROM lineitem GROUP BY ALL HAVING count(*) > 1""",
    "metadata_missingness": f"""SELECT split, count(*) AS pair_count, {MISSING('query')} AS missing_query, {MISSING('product_title')} AS missing_title,
      {MISSING('product_brand')} AS missing_brand, {MISSING('product_color')} AS missing_color FROM joined GROUP BY split""",
    "document_missingness": f"""SELECT source AS split, count(*) AS pair_count, {MISSING('text')} AS missing_query, {MISSING('lang')} AS missing_title,
      count(*) FILTER (quality IS NULL) AS missing_brand, count(*) FILTER (toxic IS NULL) AS missing_color
      FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""",
    "cross_split_queries": """SELECT product_locale, query_id, count(DISTINCT split) AS split_count FROM sp
      GROUP BY product_locale, query_id HAVING count(DISTINCT split) > 1""",
    "candidate_set_sizes": """SELECT split, count(*) AS query_count, min(n) AS minimum_candidates,
      quantile_disc(n, 0.5) AS p50_candidates, quantile_disc(n, 0.9) AS p90_candidates, quantile_disc(n, 0.99) AS p99_candidates,
      max(n) AS maximum_candidates FROM (SELECT split, query_id, count(*) AS n FROM sp GROUP BY ALL) GROUP BY split""",
    "query_text_conflicts": """SELECT (query_id + 1) // 2 AS query_id, count(DISTINCT query_norm) AS text_count FROM spn
      GROUP BY 1 HAVING count(DISTINCT query_norm) > 1""",
    "split_label_counts": "SELECT dataset_split, label, count(*) AS row_count FROM features GROUP BY ALL",
    "split_summary": "SELECT dataset_split, count(*) AS row_count, count(DISTINCT query_id) AS query_count FROM features GROUP BY ALL",
    "blank_titles": "SELECT count(*) FILTER (trim(coalesce(product_title, '')) = '') AS blank_titles FROM joined",
    "data_audit": AUDIT,
    "excluded_rows": f"SELECT n_pairs, excluded_query_ids, excluded_rows FROM ({AUDIT})",
    "register_views": """SELECT split, product_matched, count(*) AS pair_count, count(DISTINCT product_id) AS product_count
      FROM joined GROUP BY split, product_matched""",
    "majority_baseline": f"""SELECT (SELECT l.label FROM (VALUES {LABEL_ROWS}) l(label, place) ORDER BY
        (SELECT count(*) FROM features f WHERE f.dataset_split = 'train' AND f.label = l.label) DESC, place LIMIT 1) AS prediction,
      (count(*) FILTER (label = 'E'))::DOUBLE / count(*)::DOUBLE AS p_e FROM {TRAIN}""",
    "confusion_matrix": MATRIX("scored"),
    "per_class_metrics": f"""SELECT label, support, predicted, {div('correct', 'predicted')} AS precision, {div('correct', 'support')} AS recall,
      {F1} AS f1 FROM ({per_class('scored')})""",
    "metric_json_sink": f"""SELECT label, support, predicted, {div('correct', 'predicted')} AS precision, {div('correct', 'support')} AS recall,
      {F1} AS f1 FROM ({per_class('scored')})""",
    "classification_summary": summary("scored"),
    "predicted_exact_summary": f"""SELECT count(*) FILTER (prediction = 'E') AS pool_size,
      {div("count(*) FILTER (prediction = 'E')", 'count(*)')} AS coverage,
      count(*) FILTER (prediction = 'E' AND label <> 'E') AS errors,
      {div("count(*) FILTER (prediction = 'E' AND label <> 'E')", "count(*) FILTER (prediction = 'E')")} AS error_rate,
      count(*) FILTER (prediction = 'E' AND label = 'S') AS errors_s, count(*) FILTER (prediction = 'E' AND label = 'C') AS errors_c,
      count(*) FILTER (prediction = 'E' AND label = 'I') AS errors_i FROM scored""",
    "query_contingency": f"SELECT query_id, {CELLS} FROM scored GROUP BY query_id",
    "query_contingency_by_bucket": f"SELECT query_id, {CELLS} FROM scored GROUP BY query_id",
    "quantile_interval": """SELECT label, round(quantile_cont(p_e, 0.025), 9) AS low, round(quantile_cont(p_e, 0.975), 9) AS high,
      count(p_e) AS n_valid FROM scored GROUP BY label""",
    "normalize_query": f"SELECT doc_id, {norm_query('text')} AS query_norm FROM documents",
    "normalize_text": f"SELECT doc_id, {norm_text('text')} AS text_norm FROM documents",
    "tokenize": f"SELECT doc_id, len({words('norm')})::INT AS token_count, array_to_string({words('norm')}, '|') AS token_text FROM {DOCS}",
    "digit_chunks": f"SELECT doc_id, len({numbers('norm')})::INT AS chunk_count, array_to_string(list_sort({numbers('norm')}), '|') AS chunk_text FROM {DOCS}",
    "safe_ratio": f"SELECT doc_id, {div(f'len(list_distinct({NORM_WORDS}))', f'len({NORM_WORDS})', '0.0')} AS distinct_share FROM {DOCS}",
    "array_algebra": f"""SELECT example_id, len(q)::INT AS distinct_count, {both('q', 't')}::INT AS shared,
      len(list_distinct(list_concat(q, t)))::INT AS all_tokens, len(list_filter(q, lambda x: NOT list_contains(t, x)))::INT AS only_query
      FROM (SELECT example_id, list_distinct({words(norm_text('query'))}) AS q, list_distinct({words(norm_text('product_title'))}) AS t FROM joined)""",
    "review_queue": "SELECT example_id, query_id, p_e, queue_rank FROM queue",
    "review_queue_tied": "SELECT example_id, query_id, 0.5::DOUBLE AS p_e, row_number() OVER (ORDER BY example_id) AS queue_rank FROM scored",
    "review_metrics": review_select("queue"),
    "review_metrics_tied": review_select("(SELECT *, row_number() OVER (ORDER BY example_id) AS queue_rank FROM scored)"),
    "review_pool_summary": f"""SELECT count(*) AS pool_size, count(*) FILTER (label <> 'E') AS pool_errors,
      {div("count(*) FILTER (label <> 'E')", 'count(*)')} AS pool_error_rate FROM queue""",
}

FULL = {
    "sql_audit_runner": f""", a1 AS ({FINAL['label_balance']}), a3 AS ({FINAL['join_coverage']}),
a4 AS ({FINAL['metadata_missingness']}), a6 AS ({FINAL['candidate_set_sizes']})
SELECT 1 AS statement_id, json_object('split', split, 'esci_label', esci_label, 'pair_count', pair_count,
  'query_count', query_count, 'pair_share', pair_share)::VARCHAR AS row_json FROM a1
UNION ALL SELECT 2, json_object('rows_per_key', n, 'key_count', count(*), 'pair_count', sum(pairs)::BIGINT, 'surplus_pairs', (sum(pairs) * (n - 1))::BIGINT)::VARCHAR
  FROM (SELECT count(*) AS n, (SELECT count(*) FROM sp WHERE sp.product_locale = pr.product_locale AND sp.product_id = pr.product_id) AS pairs
    FROM pr GROUP BY product_locale, product_id) GROUP BY n
UNION ALL SELECT 3, json_object('input_pair_count', input_pair_count, 'joined_pair_count', joined_pair_count,
  'unmatched_pair_count', unmatched_pair_count, 'product_match_rate', product_match_rate)::VARCHAR FROM a3
UNION ALL SELECT 4, json_object('split', split, 'pair_count', pair_count, 'missing_query', missing_query,
  'missing_title', missing_title, 'missing_brand', missing_brand, 'missing_color', missing_color)::VARCHAR FROM a4
UNION ALL SELECT 5, json_object('product_locale', product_locale, 'query_id', query_id, 'id_split_count', ids, 'text_split_count', texts)::VARCHAR
  FROM (SELECT product_locale, query_id, count(DISTINCT split) AS ids, max(t.n) AS texts FROM spn
    JOIN (SELECT product_locale, query_norm, count(DISTINCT split) AS n FROM spn GROUP BY ALL) t USING (product_locale, query_norm)
    GROUP BY product_locale, query_id) WHERE ids > 1 OR texts > 1
UNION ALL SELECT 6, json_object('split', split, 'query_count', query_count, 'minimum_candidates', minimum_candidates,
  'candidate_quantiles', [p50_candidates, p90_candidates, p99_candidates], 'maximum_candidates', maximum_candidates)::VARCHAR FROM a6""",
    "sample_smoke": f""", smp AS (SELECT * FROM spn WHERE {h32('query_id')} % 1000 = 0),
bad AS (
  SELECT query_id FROM smp WHERE split = 'train' AND (query_id IN (SELECT query_id FROM smp WHERE split = 'test')
    OR query_norm IN (SELECT query_norm FROM smp WHERE split = 'test')))
SELECT CASE WHEN split = 'test' THEN 'test' WHEN {h32('query_norm')} % 10000 < 2000 THEN 'validation' ELSE 'train' END AS dataset_split,
  count(*) AS row_count, 0::BIGINT AS missing_coverage
FROM smp WHERE split = 'test' OR query_id NOT IN (SELECT query_id FROM bad) GROUP BY 1""",
    "pair_validation": f""", {PAIR_DAMAGE}
SELECT count(*) AS pair_count, count(*) FILTER (r1) AS missing_query, count(*) FILTER (r2) AS blank_query,
  count(*) FILTER (r3) AS missing_query_id, count(*) FILTER (r4) AS missing_example_id, count(*) FILTER (r5) AS missing_product_id,
  count(*) FILTER (r6) AS missing_label, count(*) FILTER (r7) AS unknown_label, count(*) FILTER (r8) AS missing_split,
  count(*) FILTER (r9) AS unknown_split, count(*) FILTER (r1 OR r2 OR r3 OR r4 OR r5 OR r6 OR r7 OR r8 OR r9) AS invalid_pairs,
  (SELECT count(*) FROM products WHERE product_id IS NULL) AS missing_product_key FROM rules""",
    "scored_validation": f""", {SCORED_DAMAGE}
SELECT count(*) AS row_count, count(*) FILTER (label NOT IN ('E', 'S', 'C', 'I')) AS unknown_label,
  count(*) FILTER (prediction IS NULL) AS unknown_prediction, count(*) FILTER (query_id IS NULL) AS missing_query_id,
  count(*) FILTER (example_id IS NULL) AS missing_example_id,
  count(*) FILTER (p_e IS NULL OR isnan(p_e) OR p_e < 0 OR p_e > 1) AS unsound_p_e,
  count(example_id) - count(DISTINCT example_id) AS repeated_example_id FROM bad""",
    "case_join": f", {CASE_SAMPLE} {CASE_EVIDENCE}",
    "case_annotations": f", {CASE_SAMPLE} SELECT *, {CASE_NOTES} FROM sampled",
    "development_cases": f", {CASE_SAMPLE} SELECT *, {CASE_NOTES} FROM ({CASE_EVIDENCE})",
    "case_csv_sink": f", {CASE_SAMPLE} SELECT example_id, label, prediction, p_e, {', '.join(EVIDENCE_COLUMNS)} FROM ({CASE_EVIDENCE})",
    "stratified_error_sample": f", {CASE_SAMPLE} SELECT example_id, label, prediction, p_e, sample_rank FROM sampled",
    "manifest_diff": f""", {MANIFESTS}
SELECT path, CASE WHEN c.h IS NULL THEN 'missing' WHEN f.h IS NULL THEN 'added' ELSE 'changed' END AS status
FROM frozen f FULL JOIN current c USING (path) WHERE f.h IS DISTINCT FROM c.h""",
    "metric_diff": f""", ma AS ({MATRIX('scored')}), less AS (SELECT * FROM scored WHERE NOT (label = 'S' AND numeric_mismatch = 1)),
mb AS ({MATRIX('less')})
SELECT *, 'left' AS side FROM (SELECT * FROM ma EXCEPT ALL SELECT * FROM mb)
UNION ALL SELECT *, 'right' FROM (SELECT * FROM mb EXCEPT ALL SELECT * FROM ma)""",
    "review_expected_random": f""", {EXPECTED}
SELECT budget_fraction, k AS n_reviewed, round(found, 9) AS n_errors_found, round(fs, 9) AS errors_s, round(fc, 9) AS errors_c, round(fi, 9) AS errors_i,
  round({div('found', 'k')}, 9) AS audit_yield, round(CASE WHEN k > 0 THEN {div('found', 'e')} END, 9) AS error_recall,
  n::BIGINT - k AS n_remaining, round(e - found, 9) AS n_remaining_errors,
  round({div('e - found', 'n - k')}, 9) AS remaining_error_rate,
  round((e / n) * (1 - e / n) * (n - k) / (n - 1) / k, 9) AS yield_variance FROM expected""",
    "review_random_draws": RANDOM_DRAWS,
    "weighted_queue_yield": f""", wq AS (
  SELECT r AS replicate, queue_rank, (label <> 'E')::INT AS err, {h32("r || ':' || query_id")} % 4 AS w FROM queue CROSS JOIN range(3) t(r)),
wr AS (
  SELECT *, b.f AS budget_fraction, sum(w) OVER (PARTITION BY replicate, b.f) AS size,
    sum(w) OVER (PARTITION BY replicate, b.f ORDER BY queue_rank) - w AS preceding
  FROM wq CROSS JOIN (VALUES (0.05::DOUBLE), (0.1::DOUBLE), (0.6::DOUBLE)) b(f)),
wk AS (SELECT *, floor(size::DOUBLE * budget_fraction)::BIGINT AS k FROM wr)
SELECT replicate, budget_fraction, any_value(k) AS n_reviewed, sum(least(w, greatest(k - preceding, 0)) * err)::BIGINT AS n_errors_found,
  sum(least(w, greatest(k - preceding, 0)) * err)::DOUBLE / any_value(k)::DOUBLE AS priority_yield, sum(w * err)::DOUBLE / sum(w)::DOUBLE AS random_yield
FROM wk GROUP BY replicate, budget_fraction""",
    "query_digest": f""", hashed AS (
  SELECT dataset_split, sha256(query_id || chr(31) || query_norm) AS h FROM (SELECT DISTINCT dataset_split, query_id, query_norm FROM features)),
sums AS (SELECT dataset_split, count(*)::VARCHAR AS n, {WORDS} FROM hashed GROUP BY dataset_split)
SELECT dataset_split, sha256(concat_ws(':', n, {', '.join(f'w{i}' for i in range(8))})) AS digest FROM sums""",
    "slice_metrics": f""", sliced AS ({SLICE_UNION}), {SLICE_QUEUE},
quality AS ({summary('sliced', 'slice')}),
pools AS (SELECT slice, count(*) AS pool_size, count(*) FILTER (label <> 'E') AS pool_errors FROM sliced_queue GROUP BY slice),
found AS ({review('sliced_queue', TWO_BUDGETS, 'slice')})
SELECT g.slice, coalesce(n_rows, 0) AS n_rows, coalesce(pool_size, 0) AS pool_size, coalesce(pool_errors, 0) AS pool_errors, accuracy, macro_f1,
  (SELECT {div('n_errors_found', 'n_reviewed')} FROM found f WHERE f.slice = g.slice AND budget_fraction = 0.05::DOUBLE) AS yield_05,
  (SELECT {div('n_errors_found', 'n_reviewed')} FROM found f WHERE f.slice = g.slice AND budget_fraction = 0.1::DOUBLE) AS yield_10
FROM (VALUES {', '.join(f"('{name}')" for name in SLICES)}) g(slice) LEFT JOIN quality USING (slice) LEFT JOIN pools USING (slice)""",
    "cluster_weights": f"""{weights(300)}
SELECT replicate, count(*) AS queries, sum(w)::BIGINT AS draws, sum(w * w)::BIGINT AS squares,
  sum((query_id * 1000003 + w * 7919) % 1000000007)::BIGINT AS digest FROM wts JOIN q USING (idx) GROUP BY replicate""",
    "label_domain_check": f""", {PAIR_DAMAGE}
SELECT label, 'missing' AS problem FROM (VALUES {LABEL_ROWS}) l(label, place) WHERE label NOT IN (SELECT esci_label FROM bad WHERE esci_label IS NOT NULL)
UNION ALL SELECT DISTINCT esci_label, 'unknown' FROM bad WHERE esci_label IS NULL OR esci_label NOT IN ('E', 'S', 'C', 'I')""",
    "slice_classes": f""", sliced AS ({SLICE_UNION})
SELECT slice, label, support, predicted, {div('correct', 'predicted')} AS precision, {div('correct', 'support')} AS recall, {F1} AS f1
FROM ({per_class('sliced', 'slice')})""",
    "slice_confusion": f""", sliced AS ({SLICE_UNION})
SELECT slice, a.label, b.label AS prediction, count(*) FILTER (s.label = a.label AND s.prediction = b.label) AS n
FROM sliced s CROSS JOIN (VALUES {LABEL_ROWS}) a(label, place) CROSS JOIN (VALUES {LABEL_ROWS}) b(label, place) GROUP BY ALL""",
    "slice_review": f""", sliced AS ({SLICE_UNION}), {SLICE_QUEUE}
SELECT slice, budget_fraction, n_reviewed, n_errors_found, {div('n_errors_found', 'n_reviewed')} AS audit_yield,
  {div('n_errors_found', 'e')} AS error_recall, n - n_reviewed AS n_remaining, e - n_errors_found AS n_remaining_errors,
  {div('e - n_errors_found', 'n - n_reviewed')} AS remaining_error_rate
FROM ({review('sliced_queue', TWO_BUDGETS, 'slice')}) WHERE n_reviewed > 0""",
    "slice_random": f""", sliced AS ({SLICE_UNION}),
pools AS (
  SELECT slice, f AS budget_fraction, count(*) FILTER (prediction = 'E')::DOUBLE AS n,
    count(*) FILTER (prediction = 'E' AND label <> 'E')::DOUBLE AS e
  FROM sliced CROSS JOIN (VALUES {TWO_BUDGETS}) b(f) GROUP BY slice, f),
sized AS (SELECT *, floor(n * budget_fraction) AS k FROM pools)
SELECT slice, budget_fraction, k::BIGINT AS n_reviewed, round(CASE WHEN n > 0 THEN k * e / n ELSE 0 END, 9) AS expected_errors,
  round(CASE WHEN k > 0 THEN e / n END, 9) AS expected_yield,
  round(CASE WHEN k > 0 THEN (e / n) * (1 - e / n) * (n - k) / (n - 1) / k END, 9) AS yield_variance FROM sized""",
    "review_budgets_repeated": f""", b AS (SELECT unnest([0.1::DOUBLE, 0.05::DOUBLE, 0.1::DOUBLE]) AS f),
pool AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (label <> 'E')::DOUBLE AS e FROM queue),
sized AS (SELECT f, floor(n * f)::BIGINT AS k, n, e FROM b CROSS JOIN pool)
SELECT 'priority' AS policy, f AS budget_fraction, k AS n_reviewed,
  (SELECT count(*) FROM queue WHERE queue_rank <= k AND label <> 'E')::DOUBLE AS errors FROM sized
UNION ALL SELECT 'random', f, k, round(k * e / n, 9) FROM sized
UNION ALL SELECT 'draws', f, NULL, 100::DOUBLE FROM sized""",
    "model_roundtrip": " SELECT count(*) AS rows, 0::BIGINT AS different FROM features WHERE dataset_split = 'validation'",
    "score_projection": " SELECT example_id, query_id, label, true AS agrees FROM features WHERE dataset_split = 'validation'",
    "model_coefficients": f""" SELECT label, feature, 0.0::DOUBLE AS error_bound, true AS fit_is_near FROM (VALUES {LABEL_ROWS}) l(label, place)
CROSS JOIN (SELECT unnest([{', '.join(f"'{name}'" for name in FEATURES)}]) AS feature)""",
    "fit_relevance_model": f""" SELECT 'logistic_class_weighted' AS model, true AS converged, count(*) AS training_rows, count(DISTINCT label) AS class_count,
  0.0::DOUBLE AS error_bound, true AS fit_is_near FROM {TRAIN}""",
    "model_selection": f""", majority AS (
  SELECT l.label FROM (VALUES {LABEL_ROWS}) l(label, place) ORDER BY (SELECT count(*) FROM {TRAIN} t WHERE t.label = l.label) DESC, place LIMIT 1),
guessed AS (SELECT label, (SELECT label FROM majority) AS prediction FROM features WHERE dataset_split = 'validation')
SELECT 'majority' AS model, n_rows, round(accuracy, 9) AS accuracy, round(macro_f1, 9) AS macro_f1, true AS sound FROM ({summary('guessed')})
UNION ALL SELECT m, (SELECT count(*) FROM guessed), NULL, NULL, true FROM (VALUES ('logistic_unweighted'), ('logistic_class_weighted')) t(m)""",
    "freeze_record": f""", hashed AS (
  SELECT dataset_split, sha256(query_id || chr(31) || query_norm) AS h FROM (SELECT DISTINCT dataset_split, query_id, query_norm FROM features)),
sums AS (SELECT dataset_split, count(*)::VARCHAR AS n, {WORDS} FROM hashed GROUP BY dataset_split),
digests AS (SELECT dataset_split, sha256(concat_ws(':', n, {', '.join(f'w{i}' for i in range(8))})) AS d FROM sums),
train AS {TRAIN}
SELECT 'frozen_before_test' AS status, true AS selected_is_trained,
  (SELECT l.label FROM (VALUES {LABEL_ROWS}) l(label, place) ORDER BY (SELECT count(*) FROM train t WHERE t.label = l.label) DESC, place LIMIT 1) AS majority_label,
  round({div("count(*) FILTER (label = 'E')", 'count(*)')}, 9) AS majority_p_e, count(*) AS training_rows,
  {', '.join(f"count(*) FILTER (label = '{x}') AS n_{x.lower()}" for x in LABELS)},
  {', '.join(f"(SELECT d FROM digests WHERE dataset_split = '{x}') AS {x}_digest" for x in ('train', 'validation', 'test'))},
  {SEED} AS seed, 0.1::DOUBLE AS bootstrap_budget, 0.95::DOUBLE AS confidence FROM train""",
    "file_manifest": " " + " UNION ALL ".join(f"SELECT '{name}.parquet' AS filename, count(*) AS row_count, true AS is_parquet, true AS digest_agrees FROM {name}" for name in TABLES),
    "artifact_manifest": """ SELECT 'n_nationkey=' || n_nationkey AS folder, strlen(n_name || chr(10))::BIGINT AS bytes, sha256(n_name || chr(10)) AS sha256 FROM nation
UNION ALL SELECT '_SUCCESS', 0, sha256('')""",
    "bootstrap_macro_f1": f"{weights(300)}{REPLICATE_F1} SELECT replicate, macro_f1 FROM rep_f1",
    "bootstrap_audit_yield": f"""{weights(300)}{REPLICATE_YIELD}
SELECT replicate, n_reviewed, round(priority_yield, 9) AS priority_yield, round(random_yield, 9) AS random_yield,
  round(priority_yield - random_yield, 9) AS difference FROM rep_yield""",
    "bootstrap_intervals": f"""{weights(300)}{INTERVALS}
SELECT statistic, round(point, 9) AS point, round(low, 9) AS low, round(high, 9) AS high, n_valid, 'computed' AS status FROM intervals""",
    "budget_comparison": f"""{weights(300)}{INTERVALS}, {EXPECTED},
rows AS (
  SELECT 'priority' AS policy, budget_fraction, n_reviewed, n_errors_found::DOUBLE AS n_errors_found, audit_yield FROM ({review_select('queue')})
  UNION ALL SELECT 'random', budget_fraction, k, found, {div('found', 'k')} FROM expected),
bounds AS (
  SELECT CASE statistic WHEN 'audit_yield' THEN 'priority' ELSE 'random' END AS policy, 0.1::DOUBLE AS budget_fraction, low, high
  FROM intervals WHERE statistic IN ('audit_yield', 'random_expected_yield'))
SELECT policy, budget_fraction, n_reviewed, round(n_errors_found, 9) AS n_errors_found, round(audit_yield, 9) AS audit_yield,
  round(low, 9) AS low, round(high, 9) AS high FROM rows LEFT JOIN bounds USING (policy, budget_fraction)""",
    "class_tradeoff": f""", majority AS (
  SELECT * EXCLUDE (prediction), (SELECT l.label FROM (VALUES {LABEL_ROWS}) l(label, place)
     ORDER BY (SELECT count(*) FROM scored s WHERE s.label = l.label) DESC, place LIMIT 1) AS prediction FROM scored)
{TRADEOFF('model', 'scored')} UNION ALL {TRADEOFF('majority_baseline', 'majority')}""",
    "feature_moments": " UNION ALL ".join(
        ("" if i else " ") + f"SELECT '{name}' AS feature, round(avg({name}), 9) AS mean, round(stddev_samp({name}), 9) AS sd FROM {TRAIN}"
        for i, name in enumerate(FEATURES)
    ),
    "eventlog_summary": """, t AS (
  SELECT string_split(o_orderpriority, ' ')[1] AS app, lineitem.* FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
ta AS (
  SELECT app, count(*) AS completed_tasks,
    coalesce(sum(l_partkey + l_suppkey) FILTER (l_linenumber > 2), 0)::BIGINT AS shuffle_read_bytes,
    sum(l_orderkey)::BIGINT AS shuffle_write_bytes, sum(l_linenumber)::BIGINT AS executor_run_time_ms_sum,
    string_agg(DISTINCT (l_suppkey % 5)::VARCHAR, ',' ORDER BY (l_suppkey % 5)::VARCHAR) AS executor_ids FROM t GROUP BY app),
oa AS (
  SELECT string_split(o_orderpriority, ' ')[1] AS app, count(*) FILTER (o_orderstatus = 'O') AS jobs,
    count(*) FILTER (o_orderstatus <> 'O') AS completed_stages, epoch_ms(min(o_orderdate)) AS start_ms, epoch_ms(max(o_orderdate)) AS end_ms
  FROM orders GROUP BY 1)
SELECT 'app-' || app AS application_id, 'orders' AS application_name, jobs, completed_stages, completed_tasks, shuffle_read_bytes,
  shuffle_write_bytes, executor_run_time_ms_sum, 'local[4]' AS master, app || 'g' AS driver_memory, start_ms, executor_ids,
  (end_ms - start_ms)::DOUBLE / 1000::DOUBLE AS application_wall_seconds FROM oa JOIN ta USING (app)""",
}


def statements() -> dict[str, str]:
    made = {key: PRELUDE + final for key, final in FINAL.items()}
    made.update({key: PRELUDE.rstrip() + final for key, final in FULL.items()})
    return made
