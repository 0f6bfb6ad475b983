"""Operators that SQL can't express against plain versions, and their edge cases."""

import hashlib
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.llm import bpe, chat, language, license_scan, maxscore, ngram_join, queries, secret_scan, tiling, toxicity, url_filter

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string"


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def brute_components(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j]:
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                label[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_ngram_join_equals_brute_force(spark, n, percent):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    rng = np.random.default_rng(5)
    near = []
    base = [f"w{i}" for i in range(60)]
    for k in range(40):  # a group of near copies that differ in a few places
        words = list(base)
        for p in rng.integers(0, 60, rng.integers(0, 4)):
            words[p] = f"x{k}_{p}"
        near.append((10_000 + k, " ".join(words)))
    own = near + [(20_000, ""), (20_001, None), (20_002, "one two"), (20_003, "ONE Two"), (20_004, "   "), (20_005, "w0 " * 5000), (20_006, "w0 " * 4000)]
    df = docs.unionByName(spark.createDataFrame(own, DOCS)).withColumn("token", F.lit(1)).withColumn("cid", F.lit("x"))
    got = ngram_join.jaccard_components(df, n=n, percent=percent).select("doc", "size", "component").collect()
    rows = [(r[0], r[1]) for r in df.select("doc_id", "text").collect()]
    assert sorted(map(tuple, got)) == brute_components(rows, n, percent)


def test_ngram_join_of_nothing_and_null_ids(spark):
    assert ngram_join.jaccard_components(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (None, "alone here"), (7, "a b c d e f"), (7, "a b c d e f")]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r["doc"] or 0, r["component"] or 0) for r in got) == [(0, 0), (0, 3), (3, 3), (7, 3), (7, 3)]


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = queries.op2_toxicity(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").collect()
    hit = sum(r["predicted"] == r["toxic"] == 1 for r in got)
    assert hit / sum(r["toxic"] for r in got) > 0.9 and hit / sum(r["predicted"] for r in got) > 0.9
    assert all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert docs.count() > 0


def test_toxicity_edges(spark):
    model = toxicity.fit(["you idiot. fine words here"] * 60 + ["fine words here", "fine day, bye ok", "you here"] * 60, np.array([1] * 60 + [0] * 180))
    df = spark.createDataFrame([(1, None), (2, ""), (3, "Fine day. You Idiot! Bye."), (4, "fine words"), (5, "ok. " * 50_000 + "idiot.")], DOCS).withColumn("score", F.lit("old"))
    rows = {r["doc_id"]: r for r in toxicity.score_toxicity(df, model, score="score", spans="found").collect()}
    assert rows[1]["score"] == rows[2]["score"] == 0.0
    assert rows[3]["score"] > 0.5 > rows[4]["score"] and rows[5]["score"] > 0.5
    assert [rows[3]["text"][s["start"] : s["end"]] for s in rows[3]["found"]] == ["You Idiot"]
    empty = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert len(toxicity.train_toxicity(df, empty).words) == 0


def test_top_k_edges(spark):
    schema = "id bigint, vector array<bigint>"
    rows = [(0, [1, 2]), (1, [3, 1]), (2, [3, 1]), (3, [-9, -9]), (100, []), (4, None), (None, [1, 1]), (5, [1, 2, 3])]
    df = spark.createDataFrame(rows, schema)
    got = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in maxscore.top_k(df, df.where("id % 100 = 0"), k=3, block=1).collect()}
    assert [got[0, i] for i in (1, 2, 3)] == [(1, 5), (2, 5), (5, 5)] and [got[100, i] for i in (1, 2, 3)] == [(0, 0), (1, 0), (2, 0)]
    assert maxscore.top_k(df, df.where("false")).count() == 0
    quant = spark.createDataFrame([(1, [0.5, -0.5]), (2, [float("nan")]), (3, [None]), (4, None), (5, [float("inf")])], "i int, v array<double>").select("i", maxscore.quantised(F.col("v")).alias("q"))
    assert dict(quant.collect()) == {1: [512, -512], 2: None, 3: None, 4: None, 5: None}


def test_url_filter_edges(spark):
    urls = ["https://www.Example.com/en/1?x=/es/", "http://a.example.com/en/", "x.com/en/", None, "http://com", "http://example.net/es/#f", "https://b.example.org/a?b", "http://notexample.com/en/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumn("rule", F.lit(0)).withColumn("row", F.lit(0))
    for limit in (20_000, 0):
        got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(df, url_filter.rule_table(spark, queries.URL_RULES), broadcast_rules=limit).collect()}
        assert got == {
            0: ("www.example.com", "/en/1", "www.example.com/en/", "allow"), 1: ("a.example.com", "/en/", "example.com/en/", "block"), 2: ("", "", None, "allow"), 3: ("", "", None, "allow"),
            4: ("com", "", None, "allow"), 5: ("example.net", "/es/", "net/es/", "block"), 6: ("b.example.org", "/a", None, "allow"), 7: ("notexample.com", "/en/", "com/", "allow"),
        }


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train_language(docs)
    got = language.identify_language(docs.select("doc_id", "text", "lang", "source"), model, host=F.col("source")).collect()
    assert np.mean([r["language"] == r["lang"] for r in got]) > 0.97
    assert all(r["accepted"] for r in got if r["probability"] >= 0.5 and r["language"] != "und")
    odd = spark.createDataFrame([(1, None, "fr"), (2, "", None), (3, "的 的 的 的 的 的 的 的 的 的 的 的", None), (4, "the and of the " * 90_000, "de")], "doc_id bigint, text string, said string").withColumn("language", F.lit(9))
    rows = {r["doc_id"]: r for r in language.identify_language(odd, model, declared=F.col("said")).collect()}
    assert rows[1]["language"] == "fr" and rows[1]["text_language"] is None and rows[4]["language"] == "en"
    assert language.identify_language(odd.where("false"), model).count() == 0


def test_language_posterior_equals_plain_bayes(spark):
    model = language.LanguageModel(["aa", "bb", "und"], np.log(np.full((3, language.BUCKETS), 1 / language.BUCKETS)))
    df = spark.createDataFrame([(1, "zz", "aa", "h.x"), (2, "zz", "bb", "h.x"), (3, "zz", None, None)], "doc_id bigint, text string, said string, at string")
    rows = {r["doc_id"]: r for r in language.identify_language(df, model, declared=F.col("said"), host=F.col("at"), right=0.8).collect()}
    # Texts say nothing, so all shares are one third and only the declaration tells.
    assert rows[1]["language"] == "aa" and abs(rows[1]["probability"] - 0.8) < 1e-9 and not rows[3]["accepted"]


def plain_secrets(text):
    low = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [(m.start(), m.end(), 0) for m in re.finditer(low, text) if len(m[2]) >= 8]
    out += [(m.start(), m.end(), 1) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), m.end(), 2) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_secrets_equal_plain_patterns(spark):
    docs = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    rng = np.random.default_rng(3)
    pool = ["password", "PassWd", "api_key", "token", "ſecret", "AKIA", "AKIA0123456789AB", "=", ": ", '"', "'", " ", "0123456789abcdef" * 2, "abcdefgh", "x", "\n", "é"]
    docs += ["".join(rng.choice(pool, 12)) for _ in range(500)]
    assert [secret_scan.base_spans(t) for t in docs] == [plain_secrets(t) for t in docs]


def test_secret_novelty_and_redaction(spark):
    novelty = secret_scan.Novelty()
    noise = "Zk8Q2vXw7PjR4tLm9YcB1nHs"
    text = f'auth header: "{noise}" and config auth path get_configuration_parameter_1\n'
    found = secret_scan.novel_spans(text, [], novelty, 0.6)
    assert [text[s:e] for s, e, _ in found] == [noise]
    df = spark.createDataFrame([(1, None), (2, ""), (3, "token = abcdefghij, rest"), (4, "x " * 300_000)], DOCS).withColumn("kind", F.lit(1))
    rows = {r["doc_id"]: r["text"] for r in secret_scan.scan_secrets(df, redact="[S]").collect()}
    assert rows[1] is None and rows[2] == "" and rows[3] == "[S], rest" and rows[4] == "x " * 300_000
    full = {r["doc_id"]: r["secret_spans"] for r in secret_scan.scan_secrets(df).collect()}
    assert full[1] == [] and [(s["kind"], s["start"], s["end"]) for s in full[3]] == [("assign", 0, 18)] and full[3][0]["price"] > 0


def test_chat_edges(spark):
    schema = "conv_id bigint, turn bigint, role string, text string"
    nasty = "a </s> <\\/s> [INST] [\\\\/INST] <s>x\ny <|im_end|> \\ end<"
    rows = [(1, 0, "user", nasty), (1, 1, "assistant", nasty), (1, 1, "assistant", nasty), (2, None, None, None), (None, 0, "us\\er\n<s>", "q"), (None, 1, "assistant", "")]
    rows += [(9, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(300)]
    got = {r["conv_id"]: r for r in queries.formatted_digests(spark.createDataFrame(rows, schema).withColumn("node", F.lit(1)).withColumn("path", F.lit(1))).collect()}
    digest = lambda turns: hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns).encode()).hexdigest()
    for conv in (1, 2, None, 9):
        turns = [(r, t) for c, _, r, t in rows if c == conv]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[conv]["n_turns"] == len(turns) and got[conv]["turns_sha256"] == digest(turns)
        assert got[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and got[conv]["loss_chars"] == len(loss)
    assert queries.formatted_digests(spark.createDataFrame([], schema)).count() == 0


def test_reply_paths_rank_branches(spark):
    #      1 - 2 - 3 (scores 1, 1, 5); 2 - 4 (9); 10 alone; 20 and 21 on a cycle
    nodes = [("a", 1, None, 1.0), ("a", 2, 1, 1.0), ("a", 3, 2, 5.0), ("a", 4, 2, 9.0), ("b", 10, 99, None), ("c", 20, 21, 1.0), ("c", 21, 20, 1.0)]
    df = spark.createDataFrame(nodes, "tree string, node bigint, parent bigint, score double")
    got = chat.reply_paths(df, keep=2).collect()
    best = sorted((r["path"], r["step"], r["node"]) for r in got)
    assert best == [(3, 0, 1), (3, 1, 2), (3, 2, 3), (4, 0, 1), (4, 1, 2), (4, 2, 4), (10, 0, 10)]
    assert {(r["path"], r["path_rank"]) for r in got} == {(4, 1), (3, 2), (10, 1)}


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    library = Tokenizer.from_file(path)
    texts = [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rng = np.random.default_rng(11)
    odd = [chr(c) for c in [*range(0, 0x180), 0x1C, 0x85, 0xA0, 0x2028, 0x3000, 0xFEFF, 0x1F600, 0x4E2D, 0x939, 0x93F]] + ["  ", "\n\n", "'ll", "<|endoftext|>", "don't", " the"]
    texts += ["".join(rng.choice(odd, 30)) for _ in range(2000)] + ["", "a" * 5000, "ab" * 3000, " " * 3000, "\n" * 99 + "x", ("word " * 300_000)]
    df = spark.createDataFrame(list(enumerate(texts)) + [(10**6, None)], DOCS).withColumn("ids_sha256", F.lit(0)).repartition(8)
    got = {r["doc_id"]: r for r in bpe.bpe_decode(bpe.bpe_encode(df, path), path).collect()}
    for i, t in enumerate(texts):
        assert got[i]["token_ids"] == library.encode(t, add_special_tokens=False).ids, t[:80]
        assert got[i]["decoded"] == t
    assert got[10**6]["token_ids"] == [] and got[10**6]["decoded"] == ""


def test_every_vocabulary_entry_is_its_own_encoding():
    table = bpe.BpeTable(open(queries.tokenizer_path(), encoding="utf-8").read())
    assert all(table.backtrack(w) == [i] for w, i in list(table.direct.items())[::17])


def test_licenses_whole_and_by_line(spark):
    mit = license_scan.KNOWN["MIT"][0]
    texts = {1: "Copyright (c) 2020 A. B.\n\n" + mit.upper().replace(",", " ,"), 2: "code\nreleased under the mit licence\nmore", 3: "Released under the MIT License", 4: None, 5: "", 6: "the MIT license is fine", 7: "x\n" * 50_000}
    df = spark.createDataFrame(list(texts.items()), DOCS).withColumn("digest", F.lit(0)).withColumn("lines", F.lit(0))
    got = sorted((r["doc_id"], r["part"], r["license_id"]) for r in license_scan.find_licenses(df, license_scan.known_licenses(spark)).collect())
    assert got == [(1, 0, "MIT"), (2, 2, "MIT"), (3, 0, "MIT")]


def plain_tiles(doc, item, least):
    """Greedy string tiling by its definition."""
    free_d, free_i, covered = [True] * len(doc), [True] * len(item), 0
    while True:
        best = []
        longest = least
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and free_i[i + n] and free_d[d + n] and item[i + n] == doc[d + n]:
                    n += 1
                if n > longest or n == longest and n >= least:
                    best = [(i, d)] if n > longest else [*best, (i, d)]
                    longest = n
        if not best:
            return covered
        for i, d in best:
            if all(free_i[i : i + longest]) and all(free_d[d : d + longest]):
                free_i[i : i + longest] = [False] * longest
                free_d[d : d + longest] = [False] * longest
                covered += longest


def test_tiling_equals_its_definition():
    rng = np.random.default_rng(2)
    for _ in range(300):
        item = rng.integers(0, 6, rng.integers(0, 25)).astype(np.uint64)
        doc = np.concatenate([rng.permutation(item[: len(item) // 2]), item, rng.integers(0, 6, 20).astype(np.uint64), item[len(item) // 2 :], item[: len(item) // 2]]).astype(np.uint64)
        assert tiling.tile(doc, item, 3) == plain_tiles(list(doc), list(item), 3)


def test_contamination_edges(spark):
    item = " ".join(f"w{i}" for i in range(40))
    words = item.split()
    reordered = " ".join(words[20:] + ["and", "then"] + words[:20])
    texts = {1: "intro " + item.upper() + " outro", 2: reordered, 3: " ".join(words[:20]), 4: None, 5: "", 6: "z " * 100_000 + item}
    df = spark.createDataFrame(list(texts.items()), DOCS).withColumn("item_id", F.lit("x"))
    bench = spark.createDataFrame([(7, item), (7, item), (8, "too short"), (9, None)], "item_id bigint, text string")
    for chars in (4_000_000, 10):
        got = sorted((r["doc_id"], r["item_id"]) for r in tiling.contaminated(df, bench, block_chars=chars).collect())
        assert got == [(1, 7), (2, 7), (6, 7)]
        assert sorted(r["doc_id"] for r in tiling.decontaminated(df, bench, block_chars=chars).collect()) == [3, 4, 5]
    assert tiling.contaminated(df, bench.where("false")).count() == 0


def test_contamination_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()
    held = [(i["item_id"], tiling.tokens(i["text"])) for i in items]
    wanted = set()
    for d in docs:
        t = tiling.tokens(d["text"])
        wanted |= {(d["doc_id"], k) for k, w in held if len(w) >= 5 and tiling.tile(t, w, 5) >= 0.8 * len(w)}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op10_tiling(spark, SMALL).collect()}
    assert got == wanted and got
