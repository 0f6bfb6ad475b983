"""The registered queries of this subpackage, opN_<name>, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, language, license_scan, maxscore, ngram_join, secret_scan, tiling, toxicity, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.jaccard_components(_table(spark, sf_dir, "documents"), n=3, percent=90)
    return found.select(F.col("doc").alias("doc_id"), F.col("size").alias("n_shingles"), F.col("component").alias("component_id"), F.col("links").alias("n_links"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train_toxicity(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, model, score="score", spans="offending")
    held = F.coalesce(toxicity.is_held_out(F.col("doc_id")), F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("offending").alias("n_offending"))


def op3_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), maxscore.quantised(F.col("embedding")).alias("vector"))
    found = maxscore.top_k(rows, rows.where("id % 100 = 0"), k=10)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


#: The rules of the query's contract.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge_urls(_table(spark, sf_dir, "pages"), url_filter.rule_table(spark, URL_RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (nothing declared, as the model learns from ``lang``; host: ``source``) and pages, whose ``doc_id`` is -1 - page_id."""
    docs, pages = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "pages")
    model = language.train_language(docs)
    said, host = language.page_evidence(F.col("html"), F.col("url"))
    one = docs.select("doc_id", F.lit(None).cast("bigint").alias("page_id"), "text", F.lit(None).cast("string").alias("said"), F.col("source").alias("at"))
    two = pages.select((-1 - F.col("page_id")).alias("doc_id"), "page_id", language.page_text(F.col("html")).alias("text"), said.alias("said"), host.alias("at"))
    found = language.identify_language(one.unionByName(two), model, declared=F.col("said"), host=F.col("at"))
    return found.select("doc_id", "page_id", "language", F.round("probability", 6).alias("probability"), "accepted", "text_language", "declared", "host")


def _spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"), spans="found").drop("text")
    base = F.filter("found", lambda s: s["kind"] != "novel")
    number = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", number("assign"), number("access"), number("hex"), F.sha2(_spans(base), 256).alias("base_sha256"), _spans(F.col("found")).alias("spans"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    ok = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", ok), (-1, 1, "assistant", ok)], "conv_id bigint, turn bigint, role string, text string")
    return formatted_digests(rows.unionByName(own))


def formatted_digests(rows: DataFrame) -> DataFrame:
    nodes = chat.conversation_nodes(rows)
    paths = chat.reply_paths(nodes.select("tree", "node", "parent", "score"))
    turns = paths.join(nodes.select("node", "role", "text"), "node").select(F.struct("tree", "path").alias("path"), "step", "role", "text")
    out = chat.format_paths(turns).select("path.tree", "formatted", "loss")
    said = chat.parsed_turns(F.col("formatted"))
    back = out.withColumn("said", said).withColumn("masked", F.concat_ws("", chat.under_loss(F.col("formatted"), F.col("loss"))))
    digest = F.sha2(F.concat_ws("", F.transform("said", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))), 256)
    size = lambda c: F.length(c).cast("bigint")
    return back.select(F.col("tree").alias("conv_id"), F.size("said").cast("bigint").alias("n_turns"), digest.alias("turns_sha256"), size("masked").alias("loss_chars"), F.sha2("masked", 256).alias("loss_sha256"), size("formatted").alias("formatted_chars"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    ids = bpe.bpe_encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), path).drop("text")
    back = bpe.bpe_decode(ids, path)
    return back.select("doc_id", F.size("token_ids").cast("bigint").alias("n_tokens"), bpe.ids_digest(F.col("token_ids")).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.find_licenses(_table(spark, sf_dir, "documents"), license_scan.known_licenses(spark))


def op10_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tiling.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "tokens_covered", "item_tokens", F.round("coverage", 6).alias("coverage"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_ngram_join, op2_toxicity, op3_maxscore, op4_url_filter, op5_language, op6_secrets, op7_chat, op8_bpe, op9_license, op10_tiling)
    return {f.__name__: f for f in own}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _url_sql() -> str:
    rules = ", ".join(f"({_quoted(h)}, {_quoted(p)}, {_quoted(a)})" for h, p, a in URL_RULES)
    lower = "translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH rules(r_host, r_path, action) AS (VALUES {rules}),
p AS (SELECT row_number() OVER () AS row, page_id, coalesce({lower}, '') AS host,
             coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
m AS (SELECT p.*, r.*, row_number() OVER (PARTITION BY p.row ORDER BY length(r_host) DESC, length(r_path) DESC) AS n
      FROM p LEFT JOIN rules r ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
SELECT page_id, host, path, r_host || r_path AS rule, coalesce(action, 'allow') AS verdict FROM m WHERE n = 1"""


_TOP_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""


def _chat_sql() -> str:
    esc = lambda c: f"regexp_replace({c}, {_quoted(chat._CONTROL)}, {_quoted(chr(92) + '1' + chr(92) * 2 + chr(92) + '2' + chr(92) + '3')}, 'g')"
    role = esc(f"replace(replace(role, {_quoted(chr(92))}, {_quoted(chr(92) + 's')}), chr(10), {_quoted(chr(92) + 'n')})")
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
f AS (SELECT *, length({role}) + length({esc('text')}) + {len(chat.OPEN) + len(chat.CLOSE) + 1} AS chars FROM c)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id"""


def _license_sql() -> str:
    def canonical(c: str) -> str:
        plain = f"trim(regexp_replace(lower({c}), {_quoted(license_scan._KEPT)}, ' ', 'g'))"
        for a, b in license_scan.SPELLINGS:
            plain = f"replace({plain}, {_quoted(a)}, {_quoted(b)})"
        return f"CASE WHEN regexp_matches(trim(regexp_replace(lower({c}), {_quoted(license_scan._KEPT)}, ' ', 'g')), {_quoted(license_scan.COPYRIGHT)}) THEN '' ELSE {plain} END"

    known = ", ".join(f"({_quoted(k)}, {_quoted(t)})" for k, texts in license_scan.KNOWN.items() for t in texts)
    lines = lambda t: f"list_transform(string_split({t}, chr(10)), lambda x: {canonical('x')})"
    return f"""
WITH k(license_id, text) AS (VALUES {known}),
known AS (SELECT sha256(array_to_string(list_filter({lines('text')}, lambda x: x <> ''), ' ')) AS digest, min(license_id) AS license_id FROM k GROUP BY 1),
d AS (SELECT doc_id, {lines('text')} AS lines FROM documents),
u AS (SELECT doc_id, lines, list_filter(lines, lambda x: x <> '') AS used FROM d),
parts AS (SELECT doc_id, 0 AS part, sha256(array_to_string(used, ' ')) AS digest FROM u WHERE len(used) > 0
          UNION ALL
          SELECT doc_id, part, sha256(line) FROM (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS part FROM u WHERE len(used) > 1) WHERE line <> '')
SELECT doc_id, CAST(part AS INTEGER) AS part, license_id, digest FROM parts JOIN known USING (digest)"""


def oracle_sql() -> dict[str, str]:
    return {"op3_maxscore": _TOP_SQL, "op4_url_filter": _url_sql(), "op7_chat": _chat_sql(), "op9_license": _license_sql()}
