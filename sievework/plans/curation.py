"""Queries on texts: counts, normal forms, duplicates, terms, chats, vectors; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.values import cosine
from ..operators import aggregates, dedup, filters, joins, sets, windows

#: Names looked for in the documents.
TERMS = ("of the", "the", "and the", "on the and", "de la", "en la", "que", "die der", "und", "license", "apache license version 2 0", "mit license")


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def curated(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    kept, _ = filters.funnel(docs, [("languages", F.col("lang").isin("en", "fr", "de", "es")), ("words", T.word_count("text") >= 4), ("chars", T.char_count("text") >= 15)])
    return dedup.exact_dedup(kept, "lang", "text", "doc_id", "doc_id").select("doc_id", "lang", T.dominant_script("text").alias("script"), T.content_hash("text").alias("text_hash"))


def norm_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", T.content_hash("text").alias("text_hash"))


def exact_dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_dedup(_t(spark, sf_dir, "documents"), "lang", "text", "doc_id", "doc_id").select("doc_id", "lang")


def exact_dup_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.duplicate_groups(_t(spark, sf_dir, "documents"), "lang", "text")


def final_dedup_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.final_check(_t(spark, sf_dir, "documents"), "lang", "text", 150)


def filter_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = [("lang in two", F.col("lang").isin("en", "fr")), ("100 words", T.word_count("text") >= 100), ("600 chars", T.char_count("text") >= 600)]
    return filters.funnel(_t(spark, sf_dir, "documents"), steps)[1]


def word_char_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", T.word_count("text").alias("words"), T.char_count("text").alias("chars")).where("words >= 4 and chars >= 15")


def lang_source_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.crosstab(_t(spark, sf_dir, "documents"), "source", "lang", ["de", "en", "es", "fr"])


def lang_counts_fixed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.counts_over(_t(spark, sf_dir, "documents"), "lang", ["en", "it", "fr", "de", "es"])


def dominant_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select("doc_id", T.dominant_script("text").alias("script"))
    own = spark.createDataFrame([(-1, "कपास cotton"), (-2, "కాటన్ ab"), (-3, "1234"), (-4, "ab కా")], "doc_id bigint, text string").select("doc_id", T.dominant_script("text").alias("script"))
    return docs.unionByName(own)


def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = dedup.shingle_pairs(_t(spark, sf_dir, "documents"), "lang", "doc_id", "text")
    return got.select("lang", "a", "b", F.round("jaccard", 6).alias("jaccard"))


def near_dup_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    return dedup.clusters(dedup.shingle_pairs(docs, "lang", "doc_id", "text"), docs.select("doc_id", "lang"), "doc_id").select("doc_id", "cluster")


def keep_longest_rep(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    rows = dedup.clusters(dedup.shingle_pairs(docs, "lang", "doc_id", "text"), docs.select("doc_id", "text", F.lit(None).cast("timestamp").alias("created")), "doc_id")
    return dedup.representatives(rows, "text", "created", "doc_id").select("cluster", "doc_id")


def guarded_cluster_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").withColumn("tag", F.when(T.has_term(T.normalized("text"), F.lit("license")), "license").when(F.col("doc_id") % 3 == 0, "third"))
    rows = dedup.clusters(dedup.shingle_pairs(docs, "lang", "doc_id", "text"), docs.select("doc_id", "tag"), "doc_id")
    return dedup.split_by_tag(rows, "tag").groupBy("cluster", F.coalesce("cluster_part", F.lit("")).alias("part")).agg(F.count("*").alias("n"))


def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = dedup.cosine_pairs(_t(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", 0.35, top=None)
    return got.select("label", "a", "b", F.round("cosine", 5).alias("cosine"))


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = _t(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    asked = vecs.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label", F.col("embedding").alias("q"))
    scored = asked.join(vecs, "label").where("vec_id <> query_id").withColumn("sim", F.round(cosine(F.col("q"), F.col("embedding")), 5))
    return windows.first_rows(scored, ["query_id"], [F.desc("sim"), "vec_id"], 3).select("query_id", "vec_id", "sim")


def leakage_free_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    test, train = docs.where("doc_id % 5 = 0"), docs.where("doc_id % 5 <> 0")
    return joins.without_leaks(test, train, T.folded("text")).select("doc_id")


def disjointness(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    return joins.leaked(docs.where("doc_id % 5 = 0"), docs.where("doc_id % 5 <> 0"), T.folded("text")).agg(F.count("*").alias("n_leaked"))


def term_match_longest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = spark.createDataFrame([(t,) for t in TERMS], "term string")
    found = joins.term_matches(_t(spark, sf_dir, "documents"), terms, "doc_id", "text", "term", longest=3)
    return joins.longest_term(found, "doc_id", "term").select("doc_id", "term")


def vocab_match_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = spark.createDataFrame([(t,) for t in TERMS], "term string")
    return joins.term_list(joins.term_matches(_t(spark, sf_dir, "documents"), terms, "doc_id", "text", "term", longest=3), "doc_id", "term")


def advice_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text")
    own = spark.createDataFrame([(-1, "spray 2 ml per litre"), (-2, "५ मिली फवारणी"), (-3, "no idea"), (-4, "treated"), (-5, "100 % cotton")], "doc_id bigint, text string")
    return docs.unionByName(own).select("doc_id", T.advice_reasons("text").alias("reasons")).where("reasons <> ''")


def mojibake_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-1, "what ???? now"), (-2, "what ??? now")], "doc_id bigint, text string")
    return _t(spark, sf_dir, "documents").select("doc_id", "text").unionByName(own).where(filters.has_mojibake("text")).select("doc_id")


def off_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").where(filters.is_off_topic(F.col("text"))).select("doc_id")


def char_bag_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = aggregates.characters(_t(spark, sf_dir, "documents"), "text"), aggregates.characters(_t(spark, sf_dir, "benchmark"), "text")
    return aggregates.bag_difference(one, two, "ch")


def prefix_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    later = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other"))
    return docs.join(later, "doc_id").select("doc_id", T.first_difference(F.col("text"), F.col("other")).alias("place"))


def word_shingle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", F.size(T.word_shingles("text", 3)).alias("n_shingles"))


def chat_last_user_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "conversations").where("role = 'user'")
    return windows.first_rows(rows, ["conv_id"], [F.desc("turn")]).select("conv_id", "turn", F.sha2("text", 256).alias("text_hash"))


def chat_role_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.crosstab(_t(spark, sf_dir, "conversations"), "conv_id", "role", ["assistant", "system", "user"])


def forward_fill_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "conversations").withColumn("marked", F.when(F.col("role") != "assistant", F.concat_ws(":", "role", "turn")))
    return windows.filled_forward(rows, ["conv_id"], ["turn"], "marked", "asked_by", reset=F.col("role") == "system").select("conv_id", "turn", "asked_by")


def turn_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.islands(_t(spark, sf_dir, "conversations"), ["conv_id"], "turn", "role")


def toxic_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "documents").select("doc_id", "lang").join(_t(spark, sf_dir, "labels"), "doc_id")
    return aggregates.rates(rows, ["lang"], {"toxic_rows": F.col("toxic") == 1, "good_rows": F.col("quality") == 1})


QUERIES = {
    f.__name__: f
    for f in (
        norm_hash, exact_dedup_keep_first, exact_dup_group_sizes, final_dedup_check, filter_funnel, word_char_filter, lang_source_crosstab, lang_counts_fixed_keys, dominant_script, near_dup_pairs, near_dup_clusters,
        keep_longest_rep, guarded_cluster_split, cosine_pairs, cosine_topk, leakage_free_split, disjointness, term_match_longest_first, vocab_match_collect, advice_flags, mojibake_filter, off_topic, char_bag_difference,
        prefix_divergence, word_shingle_counts, chat_last_user_turn, chat_role_pivot, forward_fill_roles, turn_islands, toxic_rates,
    )
}


def _norm(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def _fold(c: str) -> str:
    return f"lower(trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g')))"


_WORDS = "len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda w: w <> ''))"
_TERM_ROWS = ", ".join(f"('{t}')" for t in TERMS)
_MATCHES = f"""n AS MATERIALIZED (SELECT doc_id, ' ' || {_norm('text')} || ' ' AS t FROM documents), k(term) AS (VALUES {_TERM_ROWS}),
m AS (SELECT doc_id, term FROM n JOIN k ON contains(t, ' ' || term || ' '))"""
_SETS = f"""w AS (SELECT doc_id, lang, string_split({_norm('text')}, ' ') AS w FROM documents),
g AS (SELECT doc_id, lang, list_distinct(list_filter(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(w[i:i + 2], ' ')), lambda s: s <> '')) AS g FROM w),
s AS MATERIALIZED (SELECT doc_id, lang, list_sort(g) AS g FROM g WHERE len(g) > 0),
c AS MATERIALIZED (SELECT doc_id, lang, g, min(doc_id) OVER (PARTITION BY lang, g) AS cls FROM s),
r AS MATERIALIZED (SELECT doc_id, lang, g FROM c WHERE doc_id = cls),
x AS (SELECT lang, doc_id, len(g) AS size, unnest(g) AS tok FROM r),
o AS (SELECT a.lang, a.doc_id AS a, b.doc_id AS b, any_value(a.size) AS sa, any_value(b.size) AS sb, count(*) AS shared FROM x a JOIN x b ON a.lang = b.lang AND a.tok = b.tok AND a.doc_id < b.doc_id GROUP BY 1, 2, 3),
p AS MATERIALIZED (SELECT lang, a, b, shared / (sa + sb - shared) AS jaccard FROM o WHERE 100 * shared >= 70 * (sa + sb - shared) UNION ALL SELECT lang, cls, doc_id, 1.0 FROM c WHERE doc_id <> cls)"""
_LABELS = f"""{_SETS},
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
l(node, label) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, l.label FROM l JOIN e ON e.a = l.node WHERE l.label < e.b),
cl AS MATERIALIZED (SELECT d.doc_id, coalesce(min(label), d.doc_id) AS cluster FROM documents d LEFT JOIN l ON l.node = d.doc_id GROUP BY d.doc_id)"""
_DOSE = (
    r"(?i)\p{Nd}\s*(?:%|(?:g|gm|gms|kg|ml|mls|l|lit|ltr)(?:[^\p{L}]|$)|gram|grm|litre|liter|ग्राम|ग्रॅम|ग्रा|मिली|मिलि|मिलीलीटर|मिलिलीटर|लीटर|लिटर|किलो|ગ્રામ|મિલી|લિટર|గ్రాములు|మిల్లి|లీటర్ల|ಗ್ರಾಂ|ಮಿಲಿ|ಲೀಟರ್)"
)
_OWN = "SELECT doc_id, text FROM documents UNION ALL "

SQL = {
    "norm_hash": f"SELECT doc_id, sha256({_norm('text')}) AS text_hash FROM documents",
    "exact_dedup_keep_first": f"SELECT min(doc_id) AS doc_id, lang FROM documents GROUP BY lang, {_norm('text')}",
    "exact_dup_group_sizes": f"SELECT lang, sha256({_norm('text')}) AS text_hash, count(*) AS n FROM documents GROUP BY 1, 2 HAVING count(*) > 1",
    "final_dedup_check": f"SELECT lang, count(*) AS n_rows, count(*) - count(DISTINCT {_norm('text')}) AS n_repeated, count(*) < 150 AS too_few FROM documents GROUP BY lang",
    "filter_funnel": f"""WITH f AS (SELECT lang IN ('en', 'fr') AS a, {_WORDS} >= 100 AS b, length(text) >= 600 AS c FROM documents)
SELECT 0 AS step, 'raw' AS name, count(*) AS n_rows FROM f UNION ALL SELECT 1, 'lang in two', count(*) FILTER (WHERE a) FROM f
UNION ALL SELECT 2, '100 words', count(*) FILTER (WHERE a AND b) FROM f UNION ALL SELECT 3, '600 chars', count(*) FILTER (WHERE a AND b AND c) FROM f""",
    "word_char_filter": f"SELECT doc_id, CAST({_WORDS} AS INTEGER) AS words, CAST(length(text) AS INTEGER) AS chars FROM documents WHERE {_WORDS} >= 4 AND length(text) >= 15",
    "lang_source_crosstab": "SELECT source, " + ", ".join(f"count(*) FILTER (WHERE lang = '{k}') AS {k}" for k in ("de", "en", "es", "fr")) + " FROM documents GROUP BY source",
    "lang_counts_fixed_keys": "SELECT CAST(i AS INTEGER) AS ordinal, k AS lang, (SELECT count(*) FROM documents d WHERE d.lang = k) AS n FROM (VALUES (0, 'en'), (1, 'it'), (2, 'fr'), (3, 'de'), (4, 'es')) t(i, k)",
    "dominant_script": f"""WITH d AS ({_OWN}VALUES (-1, 'कपास cotton'), (-2, 'కాటన్ ab'), (-3, '1234'), (-4, 'ab కా')),
n AS (SELECT doc_id, {', '.join(f"length(regexp_replace(text, '{p.replace('[', '[^')}', '', 'g')) AS {k}" for k, p in T.SCRIPTS.items())} FROM d)
SELECT doc_id, CASE WHEN greatest(latin, devanagari, telugu, kannada) = 0 THEN 'other' WHEN latin >= greatest(devanagari, telugu, kannada) THEN 'latin'
WHEN devanagari >= greatest(telugu, kannada) THEN 'devanagari' WHEN telugu >= kannada THEN 'telugu' ELSE 'kannada' END AS script FROM n""",
    "near_dup_pairs": f"WITH {_SETS} SELECT lang, a, b, round(jaccard, 6) AS jaccard FROM p",
    "near_dup_clusters": f"WITH RECURSIVE {_LABELS} SELECT doc_id, cluster FROM cl",
    "keep_longest_rep": f"WITH RECURSIVE {_LABELS} SELECT cluster, arg_min(doc_id, (-length(text), doc_id)) AS doc_id FROM cl JOIN documents USING (doc_id) GROUP BY cluster",
    "guarded_cluster_split": f"""WITH RECURSIVE {_LABELS},
t AS (SELECT doc_id, cluster, CASE WHEN contains(' ' || {_norm('text')} || ' ', ' license ') THEN 'license' WHEN doc_id % 3 = 0 THEN 'third' END AS tag FROM cl JOIN documents USING (doc_id)),
u AS (SELECT *, (SELECT count(DISTINCT tag) FROM t t2 WHERE t2.cluster = t.cluster) AS tags FROM t)
SELECT cluster, CASE WHEN tags > 1 THEN coalesce(tag, '<none>') ELSE '' END AS part, count(*) AS n FROM u GROUP BY 1, 2""",
    "cosine_pairs": """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
SELECT a.label, a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.e, b.e), 5) AS cosine FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.e, b.e) > 0.35""",
    "cosine_topk": """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.e, b.e), 5) AS sim FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, vec_id, sim FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) <= 3""",
    "leakage_free_split": f"SELECT doc_id FROM documents WHERE doc_id % 5 = 0 AND {_fold('text')} NOT IN (SELECT {_fold('text')} FROM documents WHERE doc_id % 5 <> 0)",
    "disjointness": f"SELECT count(*) AS n_leaked FROM documents WHERE doc_id % 5 = 0 AND {_fold('text')} IN (SELECT {_fold('text')} FROM documents WHERE doc_id % 5 <> 0)",
    "term_match_longest_first": f"WITH {_MATCHES} SELECT doc_id, term FROM m QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(term) DESC, term) = 1",
    "vocab_match_collect": f"WITH {_MATCHES} SELECT doc_id, string_agg(term, ';' ORDER BY term) AS terms FROM m GROUP BY doc_id",
    "advice_flags": f"""WITH d AS ({_OWN}VALUES (-1, 'spray 2 ml per litre'), (-2, '५ मिली फवारणी'), (-3, 'no idea'), (-4, 'treated'), (-5, '100 % cotton')),
f AS (SELECT doc_id, concat_ws('+', CASE WHEN regexp_matches(text, '{_DOSE}') THEN 'dose' END, CASE WHEN regexp_matches(text, '{T.ADVICE_WORDING}') THEN 'verb' END) AS reasons FROM d)
SELECT doc_id, reasons FROM f WHERE reasons <> ''""",
    "mojibake_filter": f"WITH d AS ({_OWN}VALUES (-1, 'what ???? now'), (-2, 'what ??? now')) SELECT doc_id FROM d WHERE contains(text, '????')",
    "off_topic": f"SELECT doc_id FROM documents WHERE regexp_matches(text, '{filters.OFF_TOPIC}') AND NOT regexp_matches(text, '{filters.ON_TOPIC}')",
    "char_bag_difference": """WITH a AS (SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(regexp_replace(lower(text), '\\s+', '', 'g'), '')) AS ch FROM documents) GROUP BY ch),
b AS (SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(regexp_replace(lower(text), '\\s+', '', 'g'), '')) AS ch FROM benchmark) GROUP BY ch)
SELECT coalesce(a.ch, b.ch) AS ch, greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0) AS only_a, greatest(coalesce(b.n, 0) - coalesce(a.n, 0), 0) AS only_b
FROM a FULL JOIN b ON a.ch = b.ch WHERE coalesce(a.ch, b.ch) <> '' AND coalesce(a.n, 0) <> coalesce(b.n, 0)""",
    "prefix_divergence": """WITH p AS (SELECT a.doc_id, a.text AS x, b.text AS y FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)
SELECT doc_id, CAST(CASE WHEN x = y THEN NULL ELSE coalesce(list_position(list_transform(range(1, least(length(x), length(y)) + 1), lambda i: x[i] <> y[i]), true) - 1, least(length(x), length(y))) END AS INTEGER) AS place FROM p""",
    "word_shingle_counts": f"""WITH w AS (SELECT doc_id, string_split({_norm('text')}, ' ') AS w FROM documents)
SELECT doc_id, CAST(len(list_distinct(list_filter(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(w[i:i + 2], ' ')), lambda s: s <> ''))) AS INTEGER) AS n_shingles FROM w""",
    "chat_last_user_turn": "SELECT conv_id, turn, sha256(text) AS text_hash FROM conversations WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1",
    "chat_role_pivot": "SELECT conv_id, " + ", ".join(f"count(*) FILTER (WHERE role = '{k}') AS {k}" for k in ("assistant", "system", "user")) + " FROM conversations GROUP BY conv_id",
    "forward_fill_roles": """WITH s AS (SELECT *, sum(CASE WHEN role = 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS seg, CASE WHEN role <> 'assistant' THEN role || ':' || turn END AS m FROM conversations)
SELECT conv_id, turn, last_value(m IGNORE NULLS) OVER (PARTITION BY conv_id, seg ORDER BY turn ROWS UNBOUNDED PRECEDING) AS asked_by FROM s""",
    "turn_islands": """WITH n AS (SELECT conv_id, turn, role, CASE WHEN role IS NOT DISTINCT FROM lag(role) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run FROM n)
SELECT conv_id, role, min(turn) AS first, max(turn) AS last, count(*) AS n FROM r GROUP BY conv_id, run, role""",
    "toxic_rates": """SELECT lang, count(*) AS n, count(*) FILTER (WHERE toxic = 1) AS toxic_rows, round(100.0 * count(*) FILTER (WHERE toxic = 1) / count(*), 2) AS toxic_rows_pct,
count(*) FILTER (WHERE quality = 1) AS good_rows, round(100.0 * count(*) FILTER (WHERE quality = 1) / count(*), 2) AS good_rows_pct FROM documents JOIN labels USING (doc_id) GROUP BY lang""",
}
