"""Empty tables, null ids, clashing names and other odd rows of the operators and the pipeline's stages."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sievework.llm import bpe, chat, license_scan, maxscore, ngram_join, queries, secret_scan, url_filter

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string"


def test_top_k_of_huge_components_and_many_blocks(spark):
    schema = "id bigint, vector array<bigint>"
    big = spark.createDataFrame([(0, [4 * 10**18, 4 * 10**18]), (1, [1, 1])], schema)
    with pytest.raises(Exception, match="64 bits"):
        maxscore.top_k(big, big).collect()
    wide = spark.createDataFrame([(i, [(i * 7919 * 2**15) % 2**30 - 2**29, (i * 104729) % 2**27, -i]) for i in range(300)], schema)
    got = maxscore.top_k(wide, wide.where("id % 100 = 0"), k=4, block=1).collect()
    rows = {r["id"]: r["vector"] for r in wide.collect()}
    for q in (0, 100, 200):
        dot = {i: sum(x * y for x, y in zip(rows[q], v, strict=True)) for i, v in rows.items() if i != q}
        best = sorted(dot, key=lambda i: (-dot[i], i))[:4]
        assert [(r["id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == [(i, dot[i]) for i in best]


def test_url_filter_without_rules_or_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x"), (None, None), (1, "http://a.com/x")], "page_id bigint, url string")
    none = url_filter.judge_urls(pages, url_filter.rule_table(spark, queries.URL_RULES).where("false"))
    assert sorted((r["page_id"] or 0, r["rule"], r["verdict"]) for r in none.collect()) == [(0, None, "allow"), (1, None, "allow"), (1, None, "allow")]
    assert url_filter.judge_urls(pages.where("false"), url_filter.rule_table(spark, queries.URL_RULES)).count() == 0


def test_secrets_edges(spark):
    schema = "doc_id bigint, text string, secret_spans int"
    rows = [(None, None, 1), (1, "", 2), (2, "token: abcdefghij", 3), (2, "token: abcdefghij", 3)]
    got = secret_scan.scan_secrets(spark.createDataFrame(rows, schema)).collect()
    assert sorted(len(r["secret_spans"]) for r in got) == [0, 0, 1, 1]
    assert secret_scan.scan_secrets(spark.createDataFrame([], schema)).count() == 0


def test_novelty_parts_random_from_ordinary():
    import numpy as np

    rng, novelty = np.random.default_rng(2), secret_scan.Novelty()
    letters = list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
    secret = ["".join(rng.choice(letters, 28)) + "7a" for _ in range(200)]
    plain = [f"{a}_{b}_{c}_{i % 10}" for i, (a, b, c) in enumerate(zip(*(rng.choice(["client", "secret", "access", "session", "private", "account", "default", "manager"], (3, 200))), strict=True))]
    found = lambda words: np.mean([bool(secret_scan.novel_spans(f"signing key {w}", [], novelty, 0.6)) for w in words])
    assert found(secret) >= 0.99 and found(plain) <= 0.01


def test_bpe_edges(spark):
    path = queries.tokenizer_path()
    df = spark.createDataFrame([(None, None, "x"), (1, "", "y"), (1, "a b", "z")], "doc_id bigint, text string, token_ids string")
    got = bpe.bpe_decode(bpe.bpe_encode(df, path), path).collect()
    assert sorted((r["text"] or "", r["decoded"]) for r in got) == [("", ""), ("", ""), ("a b", "a b")]
    assert bpe.bpe_encode(df.where("false"), path).count() == 0


def test_license_edges(spark):
    known = license_scan.known_licenses(spark)
    df = spark.createDataFrame([(None, "Licensed under the MIT License."), (None, None), (1, "")], DOCS)
    for limit in (20_000, 0):
        assert [(r["doc_id"], r["license_id"]) for r in license_scan.find_licenses(df, known, broadcast_rows=limit).collect()] == [(None, "MIT")]
    assert license_scan.find_licenses(df.where("false"), known).count() == 0


def test_chat_edges(spark):
    schema = "conv_id bigint, turn bigint, role string, text string"
    rows = [(None, 0, None, None), (1, 1, "assistant", "b"), (1, 0, "user", "a\n<s>"), (1, 1, "assistant", "b"), (2, None, "assistant", "")]
    got = {r["conv_id"]: r for r in queries.formatted_digests(spark.createDataFrame(rows, schema)).collect()}
    assert {k: (r["n_turns"], r["loss_chars"]) for k, r in got.items()} == {None: (1, 0), 1: (3, 2), 2: (1, 0)}
    assert queries.formatted_digests(spark.createDataFrame([], schema)).count() == 0


def test_best_branches_of_a_tree(spark):
    """Two branches of one tree, ranked by their mean score, through nodes, paths and formatting."""
    nodes = [(1, 10, None, 0.0, "user", "q"), (1, 11, 10, 1.0, "assistant", "good"), (1, 12, 10, 0.2, "assistant", "poor"), (1, 13, 12, 0.9, "user", "more"), (2, 20, 99, 0.5, "user", "alone")]
    df = spark.createDataFrame(nodes, "tree bigint, node bigint, parent bigint, score double, role string, text string")
    paths = chat.reply_paths(df.select("tree", "node", "parent", "score"), keep=2)
    turns = paths.join(df.select("node", "role", "text"), "node").select(F.struct("tree", "path_rank").alias("path"), "step", "role", "text")
    got = {(r["path"]["tree"], r["path"]["path_rank"]): r["formatted"] for r in chat.format_paths(turns).collect()}
    turn = lambda role, text: f"<s>{role}\n{text}</s>"
    assert got == {(1, 1): turn("user", "q") + turn("assistant", "good"), (1, 2): turn("user", "q") + turn("assistant", "poor") + turn("user", "more"), (2, 1): turn("user", "alone")}


def test_join_refuses_nothing_and_wants_a_shared_folder(spark):
    assert ngram_join.linked_classes(spark.createDataFrame([], DOCS)).count() == 0


def test_pipeline_rows_are_told_apart(spark):
    """Rejected rows go whatever their id; others with their id stay; clashing columns are kept or replaced as stated."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, host string, language string, token_ids string"
    good = "the and of that with which from this have were been their there would about "
    rows = [(i, good + f"word{i} " * 8, "en", "s", 1, "h", "l", "t") for i in range(20)]
    odd = "ꙮꙮꙮ ꙮꙮ ꙮꙮꙮꙮ ꙮꙮꙮ ꙮꙮ ꙮꙮꙮꙮ " * 20
    rows += [(None, odd, None, "s", 1, "h", "l", "t"), (3, odd, None, "s", 1, "h", "l", "t"), (None, good * 2, "en", "s", 1, "h", "l", "t")]
    docs = spark.createDataFrame(rows, schema)
    kept = corpus_pipeline.language_id(spark, docs, SMALL)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted([(False, i) for i in range(20)] + [(True, 0)]) and {r["host"] for r in got} == {"h"}
    last = corpus_pipeline.tokenised(spark, kept, SMALL)
    assert last.select("token_ids").first()[0] and last.count() == len(got)
