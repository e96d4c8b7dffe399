"""The queries opN_<name>: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pixelweft.llm.common import table
from pixelweft.runtime import workspace

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


@query("op1_token_files")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from pixelweft.llm.token_files import read_token_files, write_token_files

    out = workspace(spark, "op1")
    manifest = write_token_files(table(spark, sf_dir, "documents"), out, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_token_files(spark, out, manifest)


@query("op3_flow_reshard")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from pixelweft.llm.reshard import written_shards

    rows = written_shards(table(spark, sf_dir, "documents"), workspace(spark, "op3"), 8)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


BASE32 = """array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(digest, (1 + 5 * (i // 4))::BIGINT, 5))::BIGINT) >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), '')"""


@query(
    "op4_warc_bundles",
    f"""WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS n FROM pages),
     o AS (SELECT digest, min(page_id) AS origin FROM p GROUP BY digest)
     SELECT page_id, n::BIGINT AS payload_bytes, {BASE32} AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM origin THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM origin THEN origin END AS refers_to
     FROM p JOIN o USING (digest)""",
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pixelweft.llm.warc_bundle import read_bundles, write_bundles

    out = workspace(spark, "op4")
    write_bundles(table(spark, sf_dir, "pages"), out)
    return read_bundles(spark, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op7_fertility_rules")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from pyspark.sql import functions as F

    from pixelweft.llm.fertility import judge

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    done = judge(docs, public_tokenizers.path("piece_bpe_32k.model"), workspace(spark, "op7"))
    base = [f"pw_stats.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return done.select("doc_id", *base, F.col("pw_base_failed").alias("base_failed"), F.col("pw_kept").alias("kept"), *[f"pw_stats.{c}" for c in ("n_tokens", "chars_per_token", "byte_share", "entropy_share")])


@query(
    "op2_site_lines",
    r"""WITH l AS (SELECT rowid AS r, doc_id, source, text, unnest(string_split(text, chr(10))) AS line,
           generate_subscripts(string_split(text, chr(10)), 1) AS pos
         FROM (SELECT row_number() OVER () AS rowid, * FROM documents) d),
       t AS (SELECT *, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS bare FROM l),
       n AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
       b AS (SELECT c.source, c.bare FROM (SELECT source, bare, count(DISTINCT r) AS k FROM t WHERE bare <> '' GROUP BY ALL) c
         JOIN n ON c.source IS NOT DISTINCT FROM n.source WHERE k >= 5 AND k / pages > 0.1),
       m AS (SELECT t.*, b.bare IS NOT NULL AS bad FROM t LEFT JOIN b ON t.source IS NOT DISTINCT FROM b.source AND t.bare = b.bare),
       g AS (SELECT r, count(*) FILTER (WHERE bare <> '') AS n_lines, count(*) FILTER (WHERE bad) AS n_dropped,
           coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT bad), '') AS left_text FROM m GROUP BY r)
       SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, md5(left_text) AS text_md5
       FROM (SELECT row_number() OVER () AS r, doc_id FROM documents) d LEFT JOIN g USING (r)""",
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from pixelweft.llm.line_dedup import drop_boilerplate

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    done = drop_boilerplate(docs, workspace(spark, "op2"), host_col="source")
    return done.select("doc_id", F.col("pw_lines").alias("n_lines"), F.col("pw_dropped").alias("n_dropped"), F.md5("text").alias("text_md5"))


@query("op8_license_rules")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from pixelweft.llm.license_scan import scan

    done = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.col("pw_by_line").alias("by_line"), F.col("pw_wrapped").alias("wrapped"), F.array_join("pw_rules", ",").alias("rules"), F.array_join("pw_licenses", ",").alias("licenses"))


def _license_sql() -> str:
    from pixelweft.llm.license_scan import oracle_sql

    return oracle_sql()


ORACLE["op8_license_rules"] = _license_sql()


@query(
    "op5_phrase_index",
    r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
       b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
       p AS (SELECT item_id, least(10, len(w)) AS n, unnest(list_transform(range(greatest(1, len(w) - 9)), lambda i: array_to_string(w[i + 1 : i + 10], ' '))) AS phrase FROM b WHERE len(w) > 0),
       n AS (SELECT DISTINCT n FROM p),
       dw AS (SELECT r, n.n, unnest(range(len(w) - n.n + 1)) AS i, w FROM d, n WHERE len(w) >= n.n),
       dp AS (SELECT r, n, i, array_to_string(w[i + 1 : i + n], ' ') AS phrase FROM dw),
       m AS (SELECT DISTINCT r, dp.n, i, item_id FROM dp JOIN p USING (n, phrase)),
       h AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS x FROM m) GROUP BY r),
       it AS (SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM (SELECT DISTINCT r, item_id FROM m) GROUP BY r)
       SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
       FROM d LEFT JOIN h USING (r) LEFT JOIN it USING (r)""",
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from pixelweft.llm.phrase_index import decontaminate

    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), workspace(spark, "op5"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op6_interpolated_lm")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pixelweft.llm.interpolated_lm import train_and_score

    return train_and_score(table(spark, sf_dir, "documents"), workspace(spark, "op6")).scores


@query("op10_gumbel_pieces")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from pixelweft.llm.gumbel_pieces import encode_samples

    return encode_samples(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), k=3, with_ids=False).drop("ids")


@query("op9_chosen_path_join")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pixelweft.llm.chosen_path import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), workspace(spark, "op9"))
