"""The pipeline against the plain versions of its stages."""

from test_brute_force import brute_components, plain_secrets
from tokenizers import Tokenizer

import corpus_pipeline
from sievework.llm import language, queries, secret_scan, tiling
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def test_run_equals_plain_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    judged = language.identify_language(docs.select("doc_id", "text", "lang", "source"), language.train_language(docs), declared=F.col("lang"), host=F.col("source")).collect()
    kept = {r["doc_id"] for r in judged if r["accepted"]}
    assert len(kept) >= 0.95 * len(rows)
    groups = brute_components(sorted((d, rows[d]["text"]) for d in kept), 5, 80)
    kept = {d for d, _, c in groups if d == c}
    items = [tiling.tokens(r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    clean = lambda t: not any(len(w) >= 5 and tiling.tile(t, w, 5) >= 0.8 * len(w) for w in items)
    kept = {d for d in kept if clean(tiling.tokens(rows[d]["text"]))}
    library = Tokenizer.from_file(queries.tokenizer_path())
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert set(got) == kept
    novelty = secret_scan.Novelty()
    for d, r in got.items():
        text = rows[d]["text"]
        spans = plain_secrets(text)
        wanted = secret_scan.redacted(text, spans + secret_scan.novel_spans(text, spans, novelty, 0.6), "[SECRET]")
        assert r["text"] == wanted and r["n_chars"] == len(wanted)
        assert r["token_ids"] == library.encode(wanted, add_special_tokens=False).ids and r["n_tokens"] == len(r["token_ids"])


def test_stages_keep_columns_and_stand_odd_rows(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "the and of that " * 5, None, None, 80), (2, "the and of that " * 5, None, None, 80)]
    docs = spark.createDataFrame(rows, schema)
    for df in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, SMALL)
            if name != "bpe":
                assert df.columns == docs.columns
        df.collect()
