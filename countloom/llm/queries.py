"""The registered queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

import public_tokenizers

from countloom.llm import bpe as _bpe, conversation_trie as _trie, decontaminate as _decon, jaccard as _jaccard, prefix_bpe as _prefix, quality as _quality, secrets as _secrets, sharding as _sharding, substring_dedup as _substring, suffix_dedup as _suffix, surrogates as _surrogates, token_alignment as _align, warc as _warc
from countloom.session import scratch


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = _decon.scan(docs, _read(spark, sf_dir, "benchmark").select("item_id", "text"))
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("hit_items"), ","), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
    )


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _surrogates.replace(_read(spark, sf_dir, "documents").select("doc_id", "text"), b"public demonstration key").select("doc_id", "text", "n_entities")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _jaccard.join(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "shards")
    _sharding.write_shards(_read(spark, sf_dir, "documents").select("doc_id", "text"), path, 40, seed=42)
    return _sharding.read_shards(spark, path).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    coded = _bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), decoded=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.encode(_bpe.ids_text(), "UTF-8"), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _suffix.kept_bytes(_suffix.dedup(_read(spark, sf_dir, "documents").select("doc_id", "text")))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    rules = _quality.learn(docs, _read(spark, sf_dir, "labels").select("doc_id", "quality"))
    return _quality.judge(docs, rules).select("doc_id", *_quality.BASE, "base_failed", "kept")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    _warc.write(_read(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return _warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _substring.dedup(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _secrets.scan(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("secret_spans", lambda s: s["kind"].isin(*_secrets.BASE_KINDS))
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, _secrets.BASE_KINDS), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("secret_spans")).alias("spans"))


def op11_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = _prefix.encode(_read(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary, packed=True).select("doc_id", "ids")
    return _prefix.decode(coded, vocabulary).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, a, b = _read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    found = _align.align(docs, a, b, digest=lambda said: hashlib.sha256(said.encode()).hexdigest())
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.coalesce("groups", F.lit("")).alias("groups_sha256"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trie.trie(_trie.rebuilt(_read(spark, sf_dir, "conversations")))


QUERIES = {
    "op1_pii_surrogates": op1_pii_surrogates,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_sharding": op3_sharding,
    "op4_decontaminate": op4_decontaminate,
    "op5_bpe": op5_bpe,
    "op6_suffix_array_dedup": op6_suffix_array_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_warc": op8_warc,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_secret_scans": op10_secret_scans,
    "op11_prefix_bpe": op11_prefix_bpe,
    "op12_token_alignment": op12_token_alignment,
    "op13_conversation_trie": op13_conversation_trie,
}
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL: dict[str, str] = {
    "op2_ngram_jaccard_join": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS MATERIALIZED (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: md5(array_to_string(ws[i : i + 4], ' '))))) AS grams FROM d WHERE len(ws) > 0),
        c AS MATERIALIZED (SELECT grams, len(grams) AS n, min(doc_id) AS id FROM s GROUP BY 1),
        g AS MATERIALIZED (SELECT id, n, unnest(grams) AS gram FROM c),
        e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM g a JOIN g b ON a.gram = b.gram AND a.id < b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        e2 AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
        r(id, top) AS (SELECT id, id FROM c UNION SELECT e2.b, r.top FROM r JOIN e2 ON e2.a = r.id WHERE r.top < e2.b),
        t AS (SELECT id, min(top) AS component_id FROM r GROUP BY 1)
        SELECT doc_id, CAST(coalesce(len(s.grams), 0) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id
        FROM d LEFT JOIN s USING (doc_id) LEFT JOIN c USING (grams) LEFT JOIN t USING (id)""",
    "op4_decontaminate": f"""
        WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS ws FROM benchmark),
        g AS (SELECT DISTINCT item, least(10, len(ws)) AS n, array_to_string(ws[i : i + least(10, len(ws)) - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
        d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
        w AS (SELECT doc_id, i, n, array_to_string(ws[i : i + n - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS i FROM d JOIN (SELECT DISTINCT n FROM g) ON len(ws) >= n)),
        h AS (SELECT DISTINCT doc_id, i, n, item FROM w JOIN g USING (n, gram)),
        c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM h) GROUP BY 1),
        k AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)""",
    "op6_suffix_array_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
        w AS (SELECT doc_id, i, md5(substring(h, 2 * i + 1, 400)) AS gram FROM (SELECT *, unnest(range(0, n - 199)) AS i FROM d WHERE n >= 200)),
        r AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY gram) AS c FROM w) WHERE c > 1),
        s AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM (SELECT doc_id, i, sum(CASE WHEN gap <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM r) GROUP BY doc_id, k),
        p AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM s UNION ALL SELECT doc_id, max(b), any_value(n) FROM s JOIN d USING (doc_id) GROUP BY 1),
        k AS (SELECT doc_id, string_agg(substring(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY x, y) AS kept FROM p JOIN d USING (doc_id) GROUP BY 1),
        t AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM s GROUP BY 1)
        SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
        FROM d LEFT JOIN k USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op8_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        f AS (SELECT h, min(page_id) AS first FROM p WHERE strlen(h) >= 100 GROUP BY 1)
        SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
        FROM p LEFT JOIN f USING (h)""",
    "op9_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        w AS (SELECT doc_id, i, sha256(array_to_string(ws[i : i + 49], ' ')) AS gram FROM (SELECT *, unnest(range(1, len(ws) - 48)) AS i FROM d)),
        f AS (SELECT gram, min(doc_id) AS first FROM w GROUP BY 1),
        c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS pos FROM w JOIN f USING (gram) WHERE first < doc_id),
        e AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM d),
        k AS (SELECT e.doc_id, count(c.pos) AS n_removed, string_agg(CASE WHEN c.pos IS NULL THEN word END, ' ' ORDER BY e.pos) AS kept FROM e LEFT JOIN c ON c.doc_id = e.doc_id AND c.pos = e.pos GROUP BY 1)
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
    "op13_conversation_trie": """
        WITH t AS (SELECT conv_id, list({'r': coalesce(role, ''), 'x': coalesce(text, '')} ORDER BY turn NULLS FIRST, role, text) AS ts FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
        k AS (SELECT conv_id, ts, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [CAST(ord(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
            lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % 9 AS h FROM t),
        p AS (SELECT k.conv_id, list_concat(coalesce(b.ts, [])[1 : h], k.ts[h + 1 :]) AS ts FROM k LEFT JOIN t b ON b.conv_id = k.conv_id - k.conv_id % 5),
        n AS MATERIALIZED (SELECT conv_id, depth, md5(CAST(to_json(ts[1 : depth]) AS VARCHAR)) AS id, CASE WHEN depth > 0 THEN md5(CAST(to_json(ts[1 : depth - 1]) AS VARCHAR)) END AS up, CASE WHEN depth > 0 THEN strlen(ts[depth].x) ELSE 0 END AS bytes, depth = len(ts) AS ends
            FROM (SELECT *, unnest(range(0, len(ts) + 1)) AS depth FROM p)),
        g AS MATERIALIZED (SELECT id, any_value(up) AS up, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS own, sha256(coalesce(string_agg(CASE WHEN ends THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM n GROUP BY 1),
        c AS (SELECT up AS id, count(*) AS n_children FROM g GROUP BY 1),
        s AS (SELECT n.id, sum(g.own) AS saved_tokens, sum(CASE WHEN c.id IS NULL THEN 1 ELSE 0 END) AS n_leaves FROM g JOIN n ON n.conv_id = g.conv_id AND n.depth <= g.depth LEFT JOIN c ON c.id = g.id GROUP BY 1)
        SELECT g.conv_id, CAST(g.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, CAST(g.n_convs AS BIGINT) AS n_convs, CAST(coalesce(n_children, 0) AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, g.ends_sha256
        FROM g LEFT JOIN g u ON u.id = g.up LEFT JOIN c ON c.id = g.id JOIN s ON s.id = g.id""",
}
