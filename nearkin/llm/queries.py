"""The queries of this subpackage and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from nearkin.llm import language_id, merkle, secrets, toxicity, vector_codes
from nearkin.llm.decontaminate import contaminated
from nearkin.llm.exact_dedup import exact_dedup
from nearkin.llm.html_extract import extract_pages
from nearkin.llm.hyperminhash import minhash_dedup
from nearkin.llm.mixing import mix_sources
from nearkin.llm.simhash import near_dedup
from nearkin.llm.token_counts import count_tokens
from nearkin.llm.warc import round_trip
from nearkin.runtime import ship, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(ship(spark).read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).documents


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(table(spark, sf_dir, "documents"))


def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_rows(table(spark, sf_dir, "embeddings"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
r AS (
  SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
         row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
  FROM d WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM r
"""


#: Shingles of five words, of all windows (one without a shingle of the item has similarity 0);
#: items of the table have at least five words.
OP4_SQL = r"""
WITH iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)),
ic AS (
  SELECT item_id, l, s, count(*) AS c FROM (
    SELECT item_id, len(w) AS l, array_to_string(w[q : q + 4], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 3)) AS q FROM iw))
  GROUP BY ALL),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
dsh AS (SELECT doc_id, len(w) AS n, p - 1 AS place, array_to_string(w[p : p + 4], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 3)) AS p FROM dw)),
win AS (
  SELECT doc_id, item_id, n, l, s, c, unnest(range(greatest(0, place - l + 5), least(place, greatest(0, n - l)) + 1)) AS start
  FROM dsh JOIN ic USING (s)),
shared AS (SELECT doc_id, item_id, n, l, start, least(count(*), c) AS x FROM win GROUP BY doc_id, item_id, n, l, start, s, c),
scored AS (
  SELECT doc_id, item_id, start, least(l, n - start) AS n_words, sum(x) / (least(n, l) + l - 8 - sum(x)) AS similarity
  FROM shared GROUP BY doc_id, item_id, n, l, start)
SELECT doc_id, item_id, similarity, start, n_words FROM scored WHERE similarity >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1
"""


def _spans_sql(kind: str) -> str:
    """The spans of a kind: matches and the gaps between them add up to their places."""
    pattern = secrets.COMPILED[kind].pattern.replace("'", "''")
    value = f"regexp_extract(m, '{pattern}', 1)" if kind == "assign" else "m"
    skip = "CASE WHEN regexp_matches(m, '^eyJ') THEN 0 ELSE 1 END" if kind == "jwt" else "0"
    hint = " OR ".join(f"contains(t, '{h}')" for h in secrets.HINT.get(kind, ("",)))
    return f"""
SELECT doc_id, '{kind}' AS kind, {secrets.KINDS.index(kind)} AS k, start + {skip} AS start, start + length(m) AS stop FROM (
  SELECT doc_id, unnest(ms) AS m, unnest(list_transform(range(1, len(ms) + 1), lambda j: list_sum(list_transform(gaps[:j], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[:j - 1], lambda x: length(x))), 0))) AS start
  FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS gaps FROM (SELECT * FROM d WHERE {hint}) WHERE regexp_matches(t, '{pattern}')))
WHERE length({value}) >= {secrets.LEAST.get(kind, 0)}"""


OP6_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(_spans_sql(k) for k in secrets.KINDS)}),
f AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(concat(kind, ':', start::BIGINT, ':', stop::BIGINT), ',' ORDER BY start, k) FILTER (k < {len(secrets.BASE)}) AS base,
         string_agg(concat(kind, ':', start::BIGINT, ':', stop::BIGINT), ',' ORDER BY start, k) AS spans
  FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN f USING (doc_id)
"""

#: Base 32 from the hexadecimal digest: five digits are four letters.
OP8_SQL = """
WITH d AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
c AS (SELECT page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> (15 - 5 * j)::INT) % 32 + 1, 1), '' ORDER BY i, j) AS digest
      FROM (SELECT page_id, i, ('0x' || substr(sha, 5 * i + 1, 5))::INT AS v FROM d, range(8) t(i)), range(4) u(j) GROUP BY page_id),
r AS (SELECT page_id, strlen(html) AS payload_bytes, digest AS payload_digest, min(page_id) OVER (PARTITION BY html) AS first FROM d JOIN c USING (page_id))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM r
"""

def _field_sql(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR) || ':' || ({value})::VARCHAR, '-')"


def _levels_sql(nodes: str, paths: str, first: int, levels: int) -> str:
    """CTEs l{i} (k, pos, h, n) and w{i} (rid, k, pos, n, cur, sib) of a tree from its leaves and the paths through it."""
    out = f"l{first} AS ({nodes}), w{first} AS ({paths})"
    for i in range(first, first + levels):
        out += f""",
l{i + 1} AS (
  SELECT k, x.pos // 8 AS pos, sha256(string_agg(x.h, '' ORDER BY x.pos)) AS h, (n + 7) // 8 AS n FROM l{i} x WHERE n > 1 GROUP BY k, x.pos // 8, n
  UNION ALL SELECT k, pos, h, n FROM l{i} WHERE n = 1),
w{i + 1} AS (
  SELECT w.rid, w.k, w.pos // 8 AS pos, (w.n + 7) // 8 AS n, sha256(string_agg(CASE WHEN l.pos = w.pos THEN w.cur ELSE l.h END, '' ORDER BY l.pos)) AS cur,
         any_value(w.sib) || coalesce(string_agg(l.h, '' ORDER BY l.pos) FILTER (l.pos <> w.pos), '') AS sib
  FROM w{i} w JOIN l{i} l ON l.k = w.k AND l.pos // 8 = w.pos // 8 WHERE w.n > 1 GROUP BY w.rid, w.k, w.pos, w.n
  UNION ALL SELECT rid, k, pos, n, cur, sib FROM w{i} WHERE n = 1)"""
    return out


#: Up to 8^7 leaves of a language and 8^3 languages.
OP11_SQL = f"""
WITH f AS (SELECT *, CASE WHEN crc % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other FROM (SELECT *, {{crc}} AS crc FROM documents)),
h AS (
  SELECT row_number() OVER () AS rid, doc_id, CASE WHEN lang IS NULL THEN '' ELSE '+' || lang END AS k,
         sha256({" || ".join(map(_field_sql, ("doc_id", "source", "lang", "n_chars", "text")))}) AS leaf, sha256({" || ".join(map(_field_sql, ("doc_id", "source", "lang", "n_chars", "other")))}) AS changed FROM f),
d AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY k) AS n FROM h),
{_levels_sql("SELECT k, pos, leaf AS h, n FROM d", "SELECT rid, k, pos, n, changed AS cur, '' AS sib FROM d", 0, 7)},
g AS (SELECT k AS lang_key, h AS subroot, row_number() OVER (ORDER BY k) - 1 AS place, count(*) OVER () AS many FROM l7),
{_levels_sql("SELECT '' AS k, place AS pos, subroot AS h, many AS n FROM g", "SELECT rid, '' AS k, place AS pos, many AS n, cur, sib FROM w7 JOIN g ON lang_key = k", 10, 3)}
SELECT doc_id, leaf, subroot, l13.h AS root, sha256(sib) AS proof_sha256, cur AS folded_root, cur = l13.h AS verified
FROM d JOIN g ON lang_key = d.k JOIN w13 USING (rid), l13
"""

#: DuckDB has no crc32: its register over the bytes, a bit at a time.
OP11_SQL = OP11_SQL.replace("{crc}", """list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda r, b: list_reduce(list_prepend(xor(r, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, _: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))""").replace("crc % 3", "xor(crc, 4294967295) % 3")


#: All pairs that share a shingle; equal sets have one class.
OP12_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 2), lambda p: array_to_string(w[p : p + 3], ' ')))) END AS s FROM w),
c AS (SELECT min(rid) AS cid, s, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
e AS (SELECT cid, n, unnest(s) AS x FROM c),
p AS (SELECT a.cid AS a, b.cid AS b FROM e a JOIN e b ON a.x = b.x AND a.cid < b.cid AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
      GROUP BY a.cid, b.cid, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT cid, cid AS r FROM c UNION SELECT r.cid, l.b FROM r JOIN l ON l.a = r.r),
m AS (SELECT r.cid, min(s.doc_id) AS component_id FROM r JOIN c ON c.cid = r.r JOIN s ON s.s = c.s GROUP BY r.cid)
SELECT doc_id, len(s.s)::BIGINT AS n_shingles, CASE WHEN len(s.s) = 0 THEN doc_id ELSE component_id END AS component_id,
       doc_id IS NOT DISTINCT FROM CASE WHEN len(s.s) = 0 THEN doc_id ELSE component_id END AS kept
FROM s LEFT JOIN c ON c.s = s.s LEFT JOIN m USING (cid)
"""


def _nearest_sql(rows: str, books: str) -> str:
    """(pos, v, n, e, c): of each part the least distance, and the first entry that has it."""
    return f"""
SELECT pos, v, n, m.e AS e, m.c AS c FROM (
  SELECT r.pos, r.v, r.n, min(struct_pack(e := (list_inner_product(r.v, r.v) - 2 * list_inner_product(r.v, b.v) + list_inner_product(b.v, b.v))::BIGINT, c := b.c)) AS m
  FROM {rows} r JOIN {books} b ON b.pos = r.pos GROUP BY r.pos, r.v, r.n)"""


def _round_sql(i: int) -> str:
    """The codebook after a round: floored means, and entries without parts as they were."""
    return f"""
a{i} AS ({_nearest_sql("u", f"b{i}")}),
m{i} AS (SELECT pos, c, j, floor(sum(n * x) / sum(n)) AS x FROM (SELECT pos, c, n, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{i}) GROUP BY pos, c, j),
b{i + 1} AS (SELECT pos, c, coalesce(g.v, b{i}.v) AS v FROM b{i} LEFT JOIN (SELECT pos, c, list(x ORDER BY j) AS v FROM m{i} GROUP BY pos, c) g USING (pos, c))"""


OP13_SQL = f"""
WITH k AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, label, i AS pos, q[i * (len(q) // 4) + 1 : (i + 1) * (len(q) // 4)] AS v FROM k, range(4) t(i)),
u AS (SELECT pos, v, count(*) AS n FROM p GROUP BY pos, v),
b0 AS (SELECT pos, row_number() OVER (PARTITION BY pos ORDER BY vec_id) - 1 AS c, v FROM p QUALIFY c < 256),
{", ".join(_round_sql(i) for i in range(4))},
z AS ({_nearest_sql("u", "b4")}),
r AS (SELECT vec_id, label, string_agg(printf('%02x', c), '' ORDER BY pos) AS code, sum(e)::BIGINT AS error FROM p JOIN z USING (pos, v) GROUP BY vec_id, label),
s AS (SELECT sha256(string_agg(array_to_string(list_transform(v, lambda x: x::BIGINT), ','), ',' ORDER BY pos, c)) AS codebooks_sha256 FROM b4)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM r, s
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_language_id": op2_language_id,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_toxicity": op5_toxicity,
    "op6_secrets": op6_secrets,
    "op7_html_extraction": op7_html_extraction,
    "op8_warc": op8_warc,
    "op9_token_counts": op9_token_counts,
    "op10_mixing": op10_mixing,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_minhash_near_dedup": op12_minhash_near_dedup,
    "op13_vector_codes": op13_vector_codes,
}

SQL: dict[str, str] = {
    "op1_exact_dedup": OP1_SQL,
    "op4_decontamination": OP4_SQL,
    "op6_secrets": OP6_SQL,
    "op8_warc": OP8_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op12_minhash_near_dedup": OP12_SQL,
    "op13_vector_codes": OP13_SQL,
}
