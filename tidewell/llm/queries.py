"""The registered queries of the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import decontam, license_scan, mixing, pii, quality_rank, quality_rules, repeats, secret_scan, simhash, token_counts
from tidewell.llm.common import table


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.report(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.report(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quality_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rank.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"))


def base_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op2_pii that SQL can express."""
    return op2_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def base_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op3_secrets that SQL can express."""
    return op3_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def base_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op4_licenses that SQL can express."""
    return op4_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def base_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op5_quality_rules that SQL can express."""
    return op5_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_repeats, op2_pii, op3_secrets, op4_licenses, op5_quality_rules, op6_quality_rank, op7_token_counts, op8_decontamination, op9_mixing, op10_simhash, base_pii, base_secrets, base_licenses, base_quality)}


#: Every string of 200 bytes by a 64-bit hash, the union of those that start twice, and what is left.
OP1_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS MATERIALIZED (SELECT r, i, hash(substr(x, 2 * i + 1, 400)) AS k FROM (SELECT r, x, unnest(range((len(x) // 2 - 199)::BIGINT)) AS i FROM d WHERE len(x) >= 400)),
m AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
h AS (SELECT r, i, i - 200 > coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -1000) AS new FROM w SEMI JOIN m USING (k)),
g AS (SELECT r, i, sum(new::INTEGER) OVER (PARTITION BY r ORDER BY i) AS run FROM h),
s AS (SELECT r, min(i) AS s, max(i) + 200 AS e FROM g GROUP BY r, run),
p AS (SELECT r, s AS place, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS a, s AS b FROM s UNION ALL SELECT r, 1000000000, coalesce(max(e), 0), max(len(x) // 2) FROM d LEFT JOIN s USING (r) GROUP BY r),
t AS (SELECT r, string_agg(substr(x, (2 * a + 1)::BIGINT, (2 * (b - a))::BIGINT), '' ORDER BY place) AS kept FROM p JOIN d USING (r) GROUP BY r)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(c, 0)::BIGINT AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM d JOIN t USING (r) LEFT JOIN (SELECT r, sum(e - s) AS n, count(*) AS c FROM s GROUP BY r) USING (r)
"""


def _spans_sql(patterns: dict[str, str], keep: str, order: str, extra: str = "") -> str:
    """The spans (kind, s, e) of each pattern's matches, places by the lengths of matches and of the text between them."""
    kinds = " UNION ALL ".join(f"SELECT r, doc_id, '{kind}' AS kind, {i} AS rank, regexp_extract_all(text, $re${p}$re$) AS v, regexp_split_to_array(text, $re${p}$re$) AS g FROM d" for i, (kind, p) in enumerate(patterns.items()))
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in patterns)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents), a AS ({kinds}),
u AS (SELECT r, kind, rank, unnest(v) AS v, unnest(g[1:len(v)]) AS gap, unnest(range(len(v)::BIGINT)) AS i FROM a WHERE len(v) > 0),
b AS (SELECT r, kind, rank, v, (sum(len(gap) + len(v)) OVER (PARTITION BY r, rank ORDER BY i) - len(v))::BIGINT AS s FROM u),
c AS (SELECT r, kind, rank, v, s, s + len(v) AS e{extra} FROM b), f AS (SELECT * FROM c WHERE {keep}),
o AS (SELECT r, {counts}, sha256(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY {order})) AS base_sha256 FROM f GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in patterns)}, coalesce(base_sha256, sha256('')) AS base_sha256 FROM d LEFT JOIN o USING (r)"""


LUHN = "list_sum(list_transform(range(len(digits)::BIGINT), lambda i: CASE WHEN i % 2 = 0 THEN digits[len(digits) - i]::INTEGER WHEN digits[len(digits) - i]::INTEGER > 4 THEN 2 * digits[len(digits) - i]::INTEGER - 9 ELSE 2 * digits[len(digits) - i]::INTEGER END)) % 10 = 0"
PII_SQL = _spans_sql(
    {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"},
    f"CASE kind WHEN 'ip' THEN list_bool_and(list_transform(string_split(v, '.'), lambda x: try_cast(x AS HUGEINT) <= 255)) WHEN 'card' THEN len(digits) BETWEEN 13 AND 19 AND {LUHN} WHEN 'phone' THEN len(digits) BETWEEN 9 AND 15 ELSE true END",
    "rank, s",
    ", regexp_replace(v, '[^0-9]', '', 'g') AS digits",
)
SECRETS_SQL = _spans_sql(
    {"assign": r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\x22']?\x20*[:=]\x20*[\x22']?[A-Za-z0-9+/_.=-]+", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"},
    "CASE kind WHEN 'assign' THEN len(part) >= 6 WHEN 'access' THEN len(v) >= 20 ELSE len(v) >= 24 END",
    "s, rank",
    r""", regexp_replace(v, '^[A-Za-z_]+[\x22'']?\x20*[:=]\x20*[\x22'']?', '') AS part""",
)
LICENSES_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p(phrase, label) AS (VALUES (['cc', 'by'], 'cc-by'), (['general', 'public', 'license'], 'gpl'), (['all', 'rights', 'reserved'], 'reserved')),
h AS (SELECT r, i, label FROM (SELECT r, w, unnest(range(len(w)::BIGINT)) AS i FROM d) JOIN p ON w[i + 1:i + len(phrase)] = phrase),
o AS (SELECT r, count(*) AS n, min(i) AS a, max(i) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS l FROM h GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, b AS last_word, coalesce(l, '') AS base_labels FROM d LEFT JOIN o USING (r)
"""
QUALITY_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, i, w[i + 1:i + 3] AS t FROM (SELECT r, w, unnest(range(len(w) - 2)) AS i FROM d WHERE len(w) > 2)),
c AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, t) AS n FROM g) WHERE n > 1),
o AS (SELECT r, count(DISTINCT i) AS n FROM (SELECT r, unnest(range(i, i + 3)) AS i FROM c) GROUP BY r),
l AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d)
SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: len(x))), 0)::BIGINT AS word_chars, len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
len(w) < 50 OR 100 * coalesce(n, 0) > 50 * len(w) AS base_failed FROM d JOIN l USING (r) LEFT JOIN o USING (r)
"""
#: Words, windows and joins need no hash, so this one has an SQL form.
OP8_SQL = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
    SELECT DISTINCT item_id, least(len(w), 8) AS m, array_to_string(w[i + 1:i + least(len(w), 8)], ' ') AS s
    FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 7, 1))) AS i FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT m FROM win), place AS (
    SELECT doc_id, i, m, array_to_string(w[i + 1:i + m], ' ') AS s FROM (SELECT doc_id, w, unnest(range(len(w))) AS i FROM d), lens WHERE i + m <= len(w)
), hit AS (SELECT doc_id, i, m, item_id FROM place JOIN win USING (m, s)), pos AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id
), item AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN item USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    """The other queries' hashes, tokenizer or fits have no SQL form; the tests compare them with brute force."""
    return {"op1_repeats": OP1_SQL, "op8_decontamination": OP8_SQL, "base_pii": PII_SQL, "base_secrets": SECRETS_SQL, "base_licenses": LICENSES_SQL, "base_quality": QUALITY_SQL}
