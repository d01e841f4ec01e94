"""The numbered queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, decontam, divergence, langid, packing, phrases, pieces, pii, quality, secrets, sharding, simhash, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _register(function):
    QUERIES[function.__name__] = function
    return function


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The public byte-level BPE vocabulary on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_model_path() -> str:
    """The public sentence piece model on this machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@_register
def op1_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


@_register
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048)


@_register
def op3_risk_controlled_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_register
def op5_subword_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_languages(_table(spark, sf_dir, "documents"))


@_register
def op6_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_register
def op7_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_slots(_table(spark, sf_dir, "documents"), 8)


@_register
def op8_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(_table(spark, sf_dir, "documents"), width=4, radius=4)
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@_register
def op9_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


@_register
def op4_skip_chain_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(_table(spark, sf_dir, "documents"))


@_register
def op10_preference_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = chat.format_preferences(_table(spark, sf_dir, "conversations"))
    return records.withColumns({c: chat.mask_text(F.col(c)) for c in ("chosen_trained", "rejected_trained")})


ORACLES["op10_preference_turns"] = chat.ORACLE


@_register
def op11_offset_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digests(_table(spark, sf_dir, "documents"), piece_model_path())


@_register
def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


ORACLES["op12_phrase_collocations"] = phrases.ORACLE


@_register
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


ORACLES["op13_source_divergence"] = divergence.ORACLE


def _secrets_sql() -> str:
    """Secrets in SQL: the stretches between matches and the matches give the positions."""

    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    hits = " UNION ALL ".join(
        f"SELECT k, {o} AS o, {quoted(r.kind)} AS kind, {r.min_length} AS least, regexp_split_to_array(t, {quoted(r.pattern)}) AS s, "
        f"regexp_extract_all(t, {quoted(r.pattern)}, 0) AS m, regexp_extract_all(t, {quoted(r.pattern)}, {r.group}) AS g FROM d"
        for o, r in enumerate(secrets.ALL_RULES)
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
hits AS ({hits}),
each AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM hits WHERE len(m) > 0),
spans AS (
  SELECT k, o, kind, CAST(list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a, length(m[i]) AS n
  FROM each WHERE length(g[i]) >= least),
agg AS (SELECT k, string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, o) AS spans, string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, o) FILTER (o < 3) AS base,
               count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex
        FROM spans GROUP BY k)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN agg USING (k)
"""


ORACLES["op1_trigram_secrets"] = _secrets_sql()


def _contamination_sql() -> str:
    """Windows of one to ten words as strings, joined to the windows of the items."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    leads = ", ".join(f"lead(w, {i}) OVER o AS w{i}" for i in range(1, 10))
    keys = " UNION ALL ".join(
        f"SELECT k, p, {n} AS n, concat_ws(' ', {', '.join(['w', *[f'w{i}' for i in range(1, n)]])}) AS key FROM pos WHERE {f'w{n - 1}' if n > 1 else 'w'} IS NOT NULL AND {n} IN (SELECT n FROM win)"
        for n in range(1, 11)
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {words} AS ws FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {words} AS ws FROM benchmark),
win AS (SELECT DISTINCT item, least(10, len(ws)) AS n, array_to_string(ws[p:p + least(10, len(ws)) - 1], ' ') AS key
        FROM (SELECT *, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS p FROM i WHERE len(ws) > 0)),
one AS (SELECT k, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM d),
pos AS (SELECT k, p, w, {leads} FROM one WINDOW o AS (PARTITION BY k ORDER BY p)),
hit AS (SELECT k, p, n, item FROM ({keys}) JOIN win USING (n, key)),
cover AS (SELECT k, count(DISTINCT q) AS n_hit FROM (SELECT k, unnest(range(p, p + n)) AS q FROM hit) GROUP BY k),
items AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT k, item FROM hit) GROUP BY k)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (k) LEFT JOIN items USING (k)
"""


ORACLES["op6_fm_decontamination"] = _contamination_sql()

#: What the archives must give back, from the pages themselves.
ORACLES["op9_warc_round_trip"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
s AS (SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, sha1(t) AS payload_digest, max(page_id) OVER (PARTITION BY t) AS last FROM p),
r AS (SELECT *, payload_bytes >= 1000 AND last IS NOT NULL AND page_id IS DISTINCT FROM last AS again FROM s)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN last END AS refers_to FROM r
"""
