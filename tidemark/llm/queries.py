"""The registered queries of the text operators: each applies its operator to its whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint_dir
from tidemark.llm.decontaminate import contamination
from tidemark.llm.filteraudit import audit
from tidemark.llm.langid import fit, identify
from tidemark.llm.mixing import mix
from tidemark.llm.quality import quality
from tidemark.llm.repeats import remove_repeats
from tidemark.llm.secrets import BASE_KINDS, find_secrets
from tidemark.llm.sharding import kd_shards
from tidemark.llm.simhash import near_duplicates
from tidemark.llm.surrogates import KINDS, replace_entities
from tidemark.llm.tokencounts import token_counts
from tidemark.llm.vectorcodes import product_codes
from tidemark.llm.warc import round_trip
from tidemark.session import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), F.col("__component").alias("component_id"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return mixed.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__taken").alias("taken"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs), keep=["doc_id"])
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op5_secrets(spark: SparkSession, sf_dir: str, ledger: str | None = None) -> DataFrame:
    """A run on a new ledger, in the shared folder, unless one is named."""
    docs = _table(spark, sf_dir, "documents")
    found = find_secrets(docs, ledger or f"{checkpoint_dir(spark)}/secrets-{uuid.uuid4().hex}", keep=["doc_id"])
    spans, base = F.col("__spans"), F.filter("__spans", lambda s: s["kind"].isin(*BASE_KINDS))
    joined = lambda of: F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    counts = [F.expr(f"cast(size(filter(__spans, s -> s.kind = '{k}')) AS long)").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"), F.lower(F.hex("__blob")).alias("blob"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id", F.col("__n_words").alias("n_words"), F.col("__n_hit").alias("n_hit"), F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__items", ","), 256).alias("items_sha256"), (F.col("__n_hit") > 0).alias("contaminated"),
    )


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = replace_entities(_table(spark, sf_dir, "documents"), key="tidemark", keep=["doc_id"])
    return found.select("doc_id", F.col("__text").alias("text"), *[F.element_at("__entities", k).alias(f"n_{k}") for k in KINDS])


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", *[F.col(f"__{n}").alias(n) for n in ("n_bytes", "n_removed", "n_spans", "kept_sha256")])


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    docs = docs.withColumn("__text_crc32", F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long"))
    out = kd_shards(docs, shards=16, keep=["doc_id", "__text_crc32"])
    return out.select(
        "doc_id", F.col("__size").alias("size"), F.col("__text_crc32").alias("text_crc32"), F.lit("bytes").alias("law"),
        F.col("__shard").alias("shard"), F.col("__slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept")
    return out.select("doc_id", *[F.col(f"__{n}").alias(n) for n in names])


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = product_codes(_table(spark, sf_dir, "embeddings"), keep=["vec_id"])
    return out.select("vec_id", *[F.col(f"__{n}").alias(n) for n in ("code", "error", "label_error")], F.col("__codebooks").alias("codebooks_sha256"))


def op12_token_counts(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Counts by word_bpe_49k.json, unless the path of another tokenizer is given."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    out = token_counts(_table(spark, sf_dir, "documents"), tokenizer, keep=["doc_id"])
    return out.select("doc_id", *[F.col(f"__{n}").alias(n) for n in ("n_bytes", "n_tokens", "over_limit")])


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_mixing": op2_mixing,
    "op3_language_id": op3_language_id,
    "op4_warc": op4_warc,
    "op5_secrets": op5_secrets,
    "op6_decontamination": op6_decontamination,
    "op7_pii_surrogates": op7_pii_surrogates,
    "op8_repeats": op8_repeats,
    "op9_sharding": op9_sharding,
    "op10_quality_rules": op10_quality_rules,
    "op11_vector_codes": op11_vector_codes,
    "op12_token_counts": op12_token_counts,
    "op13_filter_audit": op13_filter_audit,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ITEM_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"



def _op11_rounds() -> str:
    """Assignment and update of the entries (e0, e1, e2), then the final assignment a2."""
    near = "SELECT id, j, CAST(min(d * 64 + k) % 64 AS INTEGER) AS k, min(d * 64 + k) // 64 AS d FROM (SELECT x.id, x.j, e.k, sum((x.v - e.v) * (x.v - e.v)) AS d FROM x JOIN e{0} e USING (j, i) GROUP BY ALL) GROUP BY id, j"
    floor = "CAST(CASE WHEN s >= 0 THEN s // n ELSE -((n - 1 - s) // n) END AS HUGEINT)"
    moved = f"SELECT e.j, e.k, e.i, coalesce(m.v, e.v) AS v FROM e{{0}} e LEFT JOIN (SELECT j, k, i, {floor} AS v FROM (SELECT j, k, i, sum(v) AS s, count(*) AS n FROM x JOIN a{{0}} USING (id, j) GROUP BY ALL)) m USING (j, k, i)"
    return ", ".join([f"a{r} AS MATERIALIZED ({near.format(r)}), e{r + 1} AS MATERIALIZED ({moved.format(r)})" for r in (0, 1)] + [f"a2 AS MATERIALIZED ({near.format(2)})"])


#: DuckDB SQL where it can express a query. The others rest on XXH64, regular expressions with places, learned weights,
#: base32 or trees of medians; tests/llm holds them against brute force.
ORACLES: dict[str, str] = {
    "op2_mixing": r"""WITH d AS (SELECT doc_id, coalesce(source, '') AS src, source IS NULL AS nul, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5('tidemark:' || coalesce(CAST(doc_id AS VARCHAR), '\N')) AS k FROM documents),
 s AS (SELECT src, nul, CAST(sum(size) AS BIGINT) AS ss FROM d GROUP BY ALL), r AS (SELECT *, row_number() OVER (ORDER BY nul, src) - 1 AS rk FROM s), w AS (SELECT *, CASE rk % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM r),
 f0 AS (SELECT *, 3 * ss / weight AS fill FROM w),
 f AS (SELECT *, coalesce(sum(3 * ss) OVER o, 0) AS fb, coalesce(sum(weight) OVER o, 0) AS wb, (SELECT sum(ss) FROM s) AS b, (SELECT sum(weight) FROM w) AS tw FROM f0 WINDOW o AS (ORDER BY fill, nul, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 v AS (SELECT max(CAST(b - fb AS DOUBLE) / (tw - wb)) AS v_end FROM f WHERE CAST(b - fb AS DOUBLE) / (tw - wb) <= fill),
 t AS (SELECT f.*, least(CAST(3 * ss AS DOUBLE), weight * v_end) AS target FROM f, v),
 q AS (SELECT d.*, t.ss, t.target, t.weight, t.rk, t.b, sum(size) OVER (PARTITION BY d.src, d.nul ORDER BY k, size ROWS UNBOUNDED PRECEDING) AS cum, row_number() OVER () AS id FROM d JOIN t USING (src, nul)),
 i AS (SELECT id, size, b, sum(size) OVER (ORDER BY CAST(e * ss + cum AS DOUBLE) / weight, rk, cum, e ROWS UNBOUNDED PRECEDING) AS upto FROM q, (VALUES (0), (1), (2)) x(e) WHERE size > 0),
 g AS (SELECT id, count(*) AS n FROM i WHERE upto <= b GROUP BY id)
 SELECT doc_id, CAST(size AS BIGINT) AS size, ss AS source_size, target, CAST(size * coalesce(n, 0) AS BIGINT) AS taken FROM q LEFT JOIN g USING (id)""",
    "op6_decontamination": rf"""WITH i AS (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark),
 iw AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(len(w), 10) AS n, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
 d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents), ns AS (SELECT DISTINCT n FROM iw),
 dw AS (SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS p FROM d, ns)),
 h AS (SELECT doc_id, item, p, dw.n FROM dw JOIN iw ON dw.g = iw.g AND dw.n = iw.n),
 c AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS x FROM h) GROUP BY doc_id),
 m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
 SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "op11_vector_codes": f"""WITH r AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS id, vec_id, label, embedding AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
 w AS (SELECT CAST(ceil(max(len(v)) / 16.0) AS BIGINT) AS w FROM r),
 x AS MATERIALIZED (SELECT id, p // w AS j, p % w AS i, CAST(floor(256 * CAST(coalesce(v[p + 1], 0) AS DOUBLE)) AS HUGEINT) AS v FROM (SELECT id, v, w, unnest(range(16 * w)) AS p FROM r, w)),
 e0 AS MATERIALIZED (SELECT j, id - 1 AS k, i, v FROM x WHERE id <= 64), {_op11_rounds()},
 b AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY j, k, i)) AS h FROM e2),
 c AS (SELECT id, string_agg(printf('%02x', k), '' ORDER BY j) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY id)
 SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM r JOIN c USING (id), b""",
    "op13_filter_audit": r"""WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
 w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
 f AS (SELECT doc_id, part, CAST(len(w) < 50 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 65 * len(w) AS INT) + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) AS INT)
  + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(doc_id > first, false) AS INT) AS mask FROM w),
 l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
 m AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
 fs AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c), o AS (SELECT a.c || b.c || d.c || e.c || g.c AS o FROM fs a, fs b, fs d, fs e, fs g WHERE len(list_distinct([a.c, b.c, d.c, e.c, g.c])) = 5),
 s AS (SELECT o, k, 1 << (ascii(o[k]) - 65) AS bit, coalesce(list_sum(list_transform(range(1, k), lambda i: 1 << (ascii(o[i]) - 65))), 0)::INT AS pre FROM o, (SELECT unnest(range(1, 6)) AS k)),
 g AS (SELECT part, o, k, CAST(sum(n) FILTER (mask & (pre | bit) = 0) AS BIGINT) AS kept, CAST(sum(n) FILTER (mask & pre = 0 AND mask & bit <> 0) AS BIGINT) AS removed, CAST(sum(n) FILTER (mask & pre <> 0 AND mask & bit <> 0) AS BIGINT) AS redundant,
  CAST(sum(n) FILTER (mask = bit) AS BIGINT) AS unique_fails, CAST(sum(good) FILTER (mask & pre = 0 AND mask & bit <> 0) AS BIGINT) AS good_lost, CAST(sum(toxic) FILTER (mask & pre = 0 AND mask & bit <> 0) AS BIGINT) AS toxic_lost FROM m, s GROUP BY ALL)
 SELECT part, o AS filter_order, CAST(k AS INT) AS step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed, coalesce(redundant, 0) AS redundant, coalesce(unique_fails, 0) AS unique_fails, coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost,
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, o[k]), 0) AS BIGINT) AS shapley FROM g""",
}
