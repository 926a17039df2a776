"""The operators over the given tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowlantern.llm import (
    bpe, byte_gru, chosen_path, hash_tree, maxscore, merkle, packing, paragraphs, repeats, runs, toxicity, url_reputation,
    winnowing)
from rowlantern.llm.tables import ready

SHARDS = 8
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"),
             ("block", "net/fr/")]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_prefix_bpe(spark, sf_dir):
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op2_url_reputation(spark, sf_dir):
    """Pages by rule or host reputation; an outcome is the quality label of the same number."""
    outcomes = read(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    return url_reputation.judge(read(spark, sf_dir, "pages"), outcomes, URL_RULES).drop("bad_bound")


def op3_maxscore(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select("vec_id", maxscore.integer_vector(F.col("embedding")).alias("vector"))
    return maxscore.top_k(rows, F.col("vec_id") % 50 == 0)


def op4_chosen_path(spark, sf_dir):
    return chosen_path.near_duplicates(read(spark, sf_dir, "documents"), shingle=3, percent=85)


def op5_byte_gru(spark, sf_dir):
    return byte_gru.identify(read(spark, sf_dir, "documents"))


def op6_winnowing(spark, sf_dir):
    return winnowing.neighbours(read(spark, sf_dir, "documents"))


def op7_packing(spark, sf_dir):
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_toxicity(spark, sf_dir):
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_paragraphs(spark, sf_dir):
    return paragraphs.repeated_passages(read(spark, sf_dir, "documents"))


def op10_hash_tree(spark, sf_dir):
    return hash_tree.place(read(spark, sf_dir, "documents"), hash_tree.even_tree(SHARDS))


def op11_runs(spark, sf_dir):
    return runs.digests(runs.periodic_runs(runs.looped(read(spark, sf_dir, "documents"))))


def op12_merkle(spark, sf_dir):
    return merkle.prove(read(spark, sf_dir, "documents"))


def op13_suffix_dedup(spark, sf_dir):
    return repeats.digests(repeats.repeated_bytes(read(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_prefix_bpe, op2_url_reputation, op3_maxscore, op4_chosen_path, op5_byte_gru, op6_winnowing, op7_packing, op8_toxicity, op9_paragraphs,
                             op10_hash_tree, op11_runs, op12_merkle, op13_suffix_dedup)}

#: Standard SQL for the operators that it can express.
ORACLE: dict[str, str] = {}

ORACLE["op3_maxscore"] = """
WITH fine AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM fine q JOIN fine c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
WHERE r <= 5
"""

ORACLE["op4_chosen_path"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(
    regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[])
    ELSE list_distinct(list_transform(range(1, greatest(len(w) - 1, 2)),
                                      lambda i: array_to_string(w[i:i + 2], ' '))) END AS s
  FROM words
), classes AS (
  SELECT min(doc_id) AS c, s, len(s) AS n FROM (SELECT doc_id, list_sort(s) AS s FROM sets WHERE len(s) > 0) GROUP BY s
), items AS (
  SELECT c, n, unnest(s) AS x FROM classes
), links AS (
  SELECT a.c AS a, b.c AS b FROM items a JOIN items b ON a.x = b.x AND a.c <> b.c
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
  SELECT c AS v, c AS r FROM classes
  UNION
  SELECT l.b, reach.r FROM reach JOIN links l ON l.a = reach.v
), least AS (
  SELECT v, min(r) AS r FROM reach GROUP BY v
)
SELECT sets.doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(least.r, sets.doc_id) AS component_id,
       coalesce(least.r, sets.doc_id) = sets.doc_id AS kept
FROM sets LEFT JOIN classes ON len(sets.s) > 0 AND list_sort(sets.s) = classes.s LEFT JOIN least ON least.v = classes.c
"""


def _level(level: str, above: str, mean: str) -> str:
    """Prior strength of a level and its shrunk rates, as two tables."""
    return f"""{level}_fit AS (
  SELECT CASE WHEN g < 2 OR v = 0 OR width <= 0 OR s <= v / n * free THEN 1000.0
    ELSE least(1000.0, greatest(1.0, (v / n * width) / (s - v / n * free) - 1)) END AS k
  FROM (SELECT *, n - nn / n - free AS width FROM (
    SELECT count(*) AS g, count(*) - 1 AS free, sum(x.n) AS n, sum(x.n * x.n) AS nn,
           sum(x.n * pow(x.bad / x.n - {mean}, 2)) AS s, sum(x.n * {mean} * (1 - {mean})) AS v
    FROM {level}s x {above}))
), {level}_rate AS (
  SELECT x.{level} AS name, x.bad + k * {mean} AS alpha, x.n - x.bad + k * (1 - {mean}) AS beta
  FROM {level}s x {above}, {level}_fit
)"""


ORACLE["op2_url_reputation"] = f"""
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), rows AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                            'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), judged AS (
  SELECT host, bad FROM rows JOIN (SELECT doc_id, max(1 - quality) AS bad FROM labels GROUP BY doc_id) ON doc_id = page_id
), hosts AS (
  SELECT *, string_split(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') AS l
  FROM (SELECT host, count(*) AS n, sum(bad) AS bad FROM judged GROUP BY host)
), named AS (
  SELECT *, l[-1] AS suffix, array_to_string(l[-2:], '.') AS domain FROM hosts
), domains AS (
  SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM named GROUP BY domain, suffix
), suffixs AS (
  SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY suffix
), base AS (
  SELECT sum(bad) / sum(n) AS m FROM suffixs
), hostss AS (
  SELECT * FROM named
), {_level("suffix", "CROSS JOIN base", "m")}, {_level(
    "domain", "JOIN suffix_rate u ON u.name = x.suffix", "(u.alpha / (u.alpha + u.beta))")}, {_level(
    "host", "JOIN domain_rate u ON u.name = x.domain", "(u.alpha / (u.alpha + u.beta))").replace(
        "FROM hosts x", "FROM hostss x")}, bounds AS (
  SELECT name AS host, alpha / (alpha + beta)
    - 1.645 * sqrt(alpha * beta / ((alpha + beta) * (alpha + beta) * (alpha + beta + 1))) AS low FROM host_rate
), ruled AS (
  SELECT rows.*, low, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM rows LEFT JOIN bounds USING (host)
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN low > 0.3 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""


def _draw(name: str, weight: int) -> str:
    return f"-ln((CAST('0x' || substr(md5('{name}:' || key), 1, 13) AS BIGINT) + 1.0) / 4503599627370497.0) / {weight}.0"


def _lower(a: int, b: int, level: str, prefix: str, weight: int) -> str:
    """Which of two children draws lower."""
    return f"CASE WHEN {_draw(f'{level}/{prefix}{a}', weight)} <= {_draw(f'{level}/{prefix}{b}', weight)} THEN {a} ELSE {b} END"


ORACLE["op10_hash_tree"] = f"""
WITH RECURSIVE steps AS (
  SELECT i, 0 AS k, i AS c FROM (SELECT unnest(range(256)) AS i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8
), crc AS (
  SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8
), bytes AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS key, octet_length(encode(coalesce(text, ''))) + 1 AS size,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
                        lambda h: CAST('0x' || h AS BIGINT)) AS b
  FROM documents
), sized AS (
  SELECT doc_id, key, CAST(size AS BIGINT) AS size, CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b),
    lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) AS BIGINT) AS text_crc32
  FROM bytes, crc
), regions AS (
  SELECT *, {_lower(0, 1, "region", "r", 4)} AS region, {_draw("region/r+8", 1)} < least(
    {_draw("region/r0", 4)}, {_draw("region/r1", 4)}) AS moves FROM sized
), racks AS (
  SELECT *, CASE region WHEN 0 THEN {_lower(0, 1, "rack", "k", 2)} ELSE {_lower(2, 3, "rack", "k", 2)} END AS rack
  FROM regions
), placed AS (
  SELECT *, CASE rack WHEN 0 THEN {_lower(0, 1, "shard", "", 1)} WHEN 1 THEN {_lower(2, 3, "shard", "", 1)}
    WHEN 2 THEN {_lower(4, 5, "shard", "", 1)} ELSE {_lower(6, 7, "shard", "", 1)} END AS shard
  FROM racks
)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot,
       CAST(CASE WHEN moves THEN 8 ELSE shard END AS INTEGER) AS grown_shard
FROM placed
"""

_CRC_TABLE = """steps AS (
  SELECT i, 0 AS k, i AS c FROM (SELECT unnest(range(256)) AS i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8
), crc AS (
  SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8
)"""


def _id_crc(name: str) -> str:
    """The checksum of a decimal number, given the table ``crc``."""
    digits = f"list_transform(regexp_extract_all(CAST({name} AS VARCHAR), '.'), lambda d: CAST(ascii(d) AS BIGINT))"
    return f"""CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {digits}),
      lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) AS BIGINT)"""


ORACLE["op11_runs"] = rf"""
WITH RECURSIVE {_CRC_TABLE}, split AS (
  SELECT doc_id, {_id_crc("doc_id")} AS h,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[ 	-
]+'), lambda w: w <> '') AS w
  FROM documents, crc
), sized AS (
  SELECT *, len(w) AS n, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) ELSE 0 END AS a, 3 + (h // 10) % 8 AS part FROM split
), looped AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // part) + 1] END)
    ELSE w END AS w FROM sized
), grams AS (
  SELECT doc_id, n, i, array_to_string(w[i + 1:i + 5], ' ') AS gram
  FROM (SELECT doc_id, n, w, unnest(range(n - 4)) AS i FROM looped WHERE n >= 6)
), pairs AS (
  SELECT a.doc_id, a.i, b.i - a.i AS q FROM grams a JOIN grams b USING (doc_id, gram)
  WHERE b.i > a.i AND 4 * (b.i - a.i) <= a.n
), stretches AS (
  SELECT doc_id, q, min(i) AS start, count(*) + 4 + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs) GROUP BY doc_id, q, island
), runs AS (
  SELECT doc_id, start, length, min(q) AS period FROM stretches WHERE length >= greatest(6, 4 * q)
  GROUP BY doc_id, start, length
), dropped AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs
), per_doc AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)
    AS lines FROM runs GROUP BY doc_id
), best AS (
  SELECT doc_id, start, length, period FROM (SELECT *, row_number() OVER (
    PARTITION BY doc_id ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) AS r FROM runs) WHERE r = 1
), rest AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(n)) AS i FROM looped) LEFT JOIN (SELECT *, TRUE AS gone FROM dropped)
    USING (doc_id, i) WHERE gone IS NULL GROUP BY doc_id
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period,
       CAST(1000 * length // period AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
       sha256(coalesce(kept, '')) AS collapsed_sha256
FROM looped LEFT JOIN per_doc USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN rest USING (doc_id)
"""


def _levels(table: str, group: str, count: int) -> str:
    """Nodes of each level (group, n, rank, hash) and what stands beside them (before, after), from ``table``0."""
    out = []
    for k in range(count):
        out.append(f"""{table}{k + 1} AS (
  SELECT {group}, CAST(ceil(any_value(n) / 8) AS BIGINT) AS n, rank // 8 AS rank,
         CASE WHEN any_value(n) = 1 THEN any_value(hash) ELSE sha256(string_agg(hash, '' ORDER BY rank)) END AS hash
  FROM {table}{k} GROUP BY {group}, rank // 8
), {table}_beside{k} AS (
  SELECT a.{group}, a.rank, coalesce(string_agg(b.hash, '' ORDER BY b.rank) FILTER (b.rank < a.rank), '') AS before,
         coalesce(string_agg(b.hash, '' ORDER BY b.rank) FILTER (b.rank > a.rank), '') AS after, any_value(a.n) AS n
  FROM {table}{k} a JOIN {table}{k} b ON a.{group} IS NOT DISTINCT FROM b.{group} AND a.rank // 8 = b.rank // 8
  GROUP BY a.{group}, a.rank
)""")
    return ", ".join(out)


def _folds(table: str, group: str, count: int, rank: str, source: str, name: str) -> str:
    """Fold ``hash`` and gather ``proof`` level by level; ends with the table ``name``{count}."""
    out = []
    for k in range(count):
        out.append(f"""{name}{k + 1} AS (
  SELECT x.* EXCLUDE (hash, proof), proof || b.before || b.after AS proof,
         CASE WHEN b.n = 1 THEN hash ELSE sha256(b.before || hash || b.after) END AS hash
  FROM {source if k == 0 else f"{name}{k}"} x JOIN {table}_beside{k} b
    ON x.{group} IS NOT DISTINCT FROM b.{group} AND x.{rank} // {8 ** k} = b.rank
)""")
    return ", ".join(out)


def _sql_leaf(text: str) -> str:
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({f})) || ':' || {f}, '-')" for f in fields) + ")"


#: Levels of a tree in the SQL: enough for 8 ** 10 rows and 8 ** 4 languages.
_TREE, _TOP = 10, 4
ORACLE["op12_merkle"] = f"""
WITH RECURSIVE {_CRC_TABLE}, leaves AS (
  SELECT doc_id, lang, {_sql_leaf("text")} AS leaf,
         CASE WHEN {_id_crc("doc_id")} % 3 = 0 THEN {_sql_leaf(
             "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS read
  FROM documents, crc
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank,
         count(*) OVER (PARTITION BY lang) AS n FROM leaves
), tree0 AS (
  SELECT lang, n, rank, leaf AS hash FROM ranked
), {_levels("tree", "lang", _TREE)}, subroots AS (
  SELECT lang, hash AS subroot, 0 AS everything, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM tree{_TREE}
), top0 AS (
  SELECT everything, place AS rank, count(*) OVER () AS n, subroot AS hash FROM subroots
), {_levels("top", "everything", _TOP)}, started AS (
  SELECT doc_id, ranked.lang, rank, leaf, subroot, place, everything, coalesce(read, leaf) AS hash, '' AS proof
  FROM ranked JOIN subroots ON ranked.lang IS NOT DISTINCT FROM subroots.lang
), {_folds("tree", "lang", _TREE, "rank", "started", "low")}, {_folds("top", "everything", _TOP, "place", f"low{_TREE}", "high")}
SELECT doc_id, leaf, subroot, top{_TOP}.hash AS root, sha256(proof) AS proof_sha256, high{_TOP}.hash AS folded_root,
       high{_TOP}.hash = top{_TOP}.hash AS verified
FROM high{_TOP}, top{_TOP}
"""
