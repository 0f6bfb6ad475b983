"""The registered queries that SQL can't express, as a whole, against plain versions."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from test_brute_force import brute_components, plain_secrets, shingles
from tokenizers import Tokenizer

from sievework.llm import language, queries, tiling, toxicity

SMALL, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"
DOCS = "doc_id bigint, text string"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").collect()


def test_op1(spark, docs):
    got = queries.op1_ngram_join(spark, SMALL).collect()
    rows = [(r["doc_id"], r["text"]) for r in docs]
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows, 3, 90)
    sets = {d: shingles(t, 3) for d, t in rows}
    near = lambda x, y: 100 * len(x & y) >= 90 * len(x | y) > 0
    assert {r["doc_id"]: r["n_links"] for r in got} == {d: sum(near(sets[d], s) for e, s in sets.items() if e != d) for d in sets}


def test_op6(spark, docs):
    texts = {r["doc_id"]: r["text"] or "" for r in docs}
    kinds = ("assign", "access", "hex")
    for r in queries.op6_secrets(spark, SMALL).collect():
        base = plain_secrets(texts[r["doc_id"]])
        assert r["base_sha256"] == sha(",".join(f"{kinds[k]}:{s}:{e}" for s, e, k in base))
        assert [r[f"n_{k}"] for k in kinds] == [sum(k == i for _, _, k in base) for i in range(3)]
        spans = [x.split(":") for x in r["spans"].split(",") if x]
        assert [x for x in spans if x[0] != "novel"] == [[kinds[k], str(s), str(e)] for s, e, k in base]
        assert [int(x[1]) for x in spans] == sorted(int(x[1]) for x in spans)


def test_op8(spark, docs):
    library = Tokenizer.from_file(queries.tokenizer_path())
    library.no_truncation()
    library.no_padding()
    texts = {r["doc_id"]: r["text"] or "" for r in docs}
    got = queries.op8_bpe(spark, SMALL).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha(",".join(map(str, ids))))
        assert r["decoded_sha256"] == sha(library.decode(ids, skip_special_tokens=False))


# -- op5: the whole posterior with dictionaries ------------------------------


def plain_trigrams(text):
    kept = []
    for c in text.lower():
        o = ord(c)
        letter = 97 <= o <= 122 or o >= 192 and o not in (215, 247) and not 0x2000 <= o <= 0x2BFF
        if letter or not kept or kept[-1] != 32:
            kept.append(o if letter else 32)
    mask = (1 << 64) - 1
    return [((((((a * 0x9E3779B1 + b) & mask) * 0x85EBCA77 + c) & mask) * 0x9E3779B97F4A7C15) & mask) >> 48 for a, b, c in zip(kept, kept[1:], kept[2:])]


def plain_posterior(sample, rows, pull=20.0, weight=200, right=0.9):
    """``sample``: (lang, text); ``rows``: (text, declared, host)."""
    names = sorted({k for k, _ in sample}) + ["und"]
    size, counts = len(names), {k: Counter() for k in names[:-1]}
    for k, t in set(sample):
        counts[k].update(plain_trigrams(t))
    total = {k: sum(c.values()) + 0.1 * 65536 for k, c in counts.items()}
    log = lambda k, b: -math.log(65536) if k == "und" else math.log((counts[k][b] + 0.1) / total[k])
    logs, shares = [], []
    for t, _, _ in rows:
        got = plain_trigrams(t or "")
        often = Counter(got)
        at = [sum(n * log(k, b) for b, n in often.items()) * min(1, weight / max(1, len(got))) for k in names]
        odds = [math.exp(x - max(at)) for x in at]
        logs.append(at)
        shares.append([x / sum(odds) for x in odds])
    levels = lambda h: [h] + ([".".join(h.split(".")[-2:])] if h.count(".") > 1 else []) + ([h.split(".")[-1]] if h.count(".") else []) if h is not None else []
    names_of, out = [tuple(enumerate(levels(h))) if h is not None else () for _, _, h in rows], []
    kind = lambda h, i: ("host", "domain", "suffix")[i if h.count(".") != 1 or i == 0 else 2]
    for r, (_, said, host) in enumerate(rows):
        inside, prior_counts = set(), []
        for i, name in names_of[r]:
            own = {s for s, (_, _, h) in enumerate(rows) if h is not None and any(kind(h, j) == kind(host, i) and n == name for j, n in names_of[s])}
            prior_counts.append([sum(shares[s][x] for s in own - inside - {r}) for x in range(size)])
            inside |= own
        rest = [sum(shares[s][x] for s in range(len(rows)) if s not in inside and s != r) for x in range(size)]
        prior = [(x + 1) / (sum(rest) + size) for x in rest]
        for n in reversed(prior_counts):
            prior = [(x + pull * p) / (sum(n) + pull) for x, p in zip(n, prior, strict=True)]
        tell = [1.0] * size if said is None or said.lower() not in names[:-1] else [right if k == said.lower() else (1 - right) / (size - 1) for k in names]
        score = [x + math.log(p) + math.log(t) for x, p, t in zip(logs[r], prior, tell, strict=True)]
        best = max(range(size), key=lambda x: score[x])
        out.append((names[best], 1 / sum(math.exp(x - score[best]) for x in score)))
    return out


def test_op5(spark, docs):
    got = {r["doc_id"]: r for r in queries.op5_language(spark, SMALL).collect()}
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    said, host = language.page_evidence(F.col("html"), F.col("url"))
    read = pages.select("page_id", language.page_text(F.col("html")).alias("text"), said.alias("said"), host.alias("host")).collect()
    rows = {r["doc_id"]: (r["text"], None, r["source"]) for r in docs} | {-1 - r["page_id"]: (r["text"], r["said"], r["host"]) for r in read}
    wanted = plain_posterior([(r["lang"], r["text"]) for r in docs if r["lang"] and r["text"]], list(rows.values()))
    assert set(got) == set(rows)
    for d, (name, p) in zip(rows, wanted, strict=True):
        assert got[d]["probability"] == pytest.approx(p, abs=2e-6) and (got[d]["language"] == name or p < 0.5001), d


def test_language_outside_the_sample(spark):
    docs = spark.read.parquet(f"{LARGE}/documents.parquet")
    known = docs.withColumn("lang", F.when(F.col("doc_id") % 3 > 0, F.col("lang")))
    model = language.train_language(known.select("text", "lang"), rows=300)
    got = language.identify_language(docs.where("doc_id % 3 = 0"), model, host=F.col("source")).select("lang", "language").collect()
    assert sum(r["lang"] == r["language"] for r in got) >= 0.98 * len(got)


def test_language_borders_and_late_tags(spark, monkeypatch):
    text = "ab  c, d'é" * 50
    whole = [int(x) for part in language.trigrams(text) for x in part]
    assert whole == plain_trigrams(text)
    for size in (1, 2, 3, 7):
        monkeypatch.setattr(language, "_PIECE", size)
        assert [int(x) for part in language.trigrams(text) for x in part] == whole
    late = "<!-- <html lang='xx'> " + "x" * 9000 + " -->" + " " * 9000 + "<HTML class=a lang=fr-CA>"
    pages = spark.createDataFrame([(late, "http://u@A.b.c:8/x"), (None, None), ("", "x"), ("<html>", "http:///")], "html string, url string")
    said, host = language.page_evidence(F.col("html"), F.col("url"))
    assert [tuple(r) for r in pages.select(said, host).collect()] == [("fr", "a.b.c"), (None, None), (None, None), (None, None)]


def test_language_clashing_names_and_empty(spark):
    df = spark.createDataFrame([(1, "the of and", 7, "x", 2)], "doc_id bigint, text string, c0 int, _sw_host string, Host int")
    model = language.train_language(spark.createDataFrame([("en", "the of and to"), (None, "x"), ("fr", None)], "lang string, text string"))
    got = language.identify_language(df.unionByName(df), model)
    assert got.columns[:3] == ["doc_id", "c0", "_sw_host"] and [r["language"] for r in got.collect()] == ["en", "en"]
    empty = spark.createDataFrame([], "lang string, text string")
    assert language.train_language(empty).languages == ["und"]
    assert language.identify_language(empty, language.train_language(empty)).count() == 0


# -- op2 by length and language ----------------------------------------------


def test_toxicity_by_length_and_language(spark):
    docs = spark.read.parquet(f"{LARGE}/documents.parquet").select("doc_id", "lang", "text")
    labels = spark.read.parquet(f"{LARGE}/labels.parquet")
    got = queries.op2_toxicity(spark, LARGE).where("held_out").join(labels, "doc_id").join(docs, "doc_id").collect()
    parts = defaultdict(lambda: [0, 0, 0, 0])
    for r in got:
        size = len(r["text"] or "")
        for part in (r["lang"], "short" if size < 1000 else "middle" if size < 4000 else "long"):
            parts[part][2 * r["toxic"] + r["predicted"]] += 1
    for part, (_, false, missed, hit) in parts.items():
        if hit + missed >= 10:
            assert hit >= 0.85 * (hit + missed) and hit >= 0.75 * (hit + false), (part, parts[part])


def test_toxicity_score_of_length_and_sample(spark):
    docs = spark.createDataFrame([(i, "You idiot. Fine day." if i % 3 == 0 else "Fine day, all of you.") for i in range(200)] + [(1000, "x " * 5000), (None, "a"), (3, "You idiot. Twice.")], DOCS)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)] + [(1000, 0), (None, 1), (5, None)], "doc_id bigint, toxic int")
    for chars in (15_000_000, 6000):  # the second leaves no room for the longest text
        model = toxicity.train_toxicity(docs, labels, chars=chars)
        assert model.judge("clean words. " * 50_000, 0.3)[0] < 0.3 < model.judge("ok. " * 1000 + "You idiot.", 0.3)[0]
    scored = toxicity.score_toxicity(spark.createDataFrame([], DOCS), model)
    assert scored.count() == 0 and scored.columns == ["doc_id", "text", "toxicity"]
    held = [zlib.crc32(str(i).encode()) % 4 == 2 for i in range(200)]
    assert [r[0] for r in docs.limit(200).select(toxicity.is_held_out(F.col("doc_id"))).collect()] == held


# -- op10 ----------------------------------------------------------------------


def test_tiling_of_repeated_words_and_other_ids(spark):
    docs = spark.createDataFrame([("a", "x " * 100_000), ("b", "one two three four five six"), (None, "one two three four five six"), ("c", None)], "doc_id string, text string")
    items = spark.createDataFrame([("long", "x " * 20_000), ("six", "One two, three four five six!"), (None, "too short"), ("nil", None)], "item_id string, text string")
    got = tiling.contaminated(docs, items).collect()
    assert sorted((r["doc_id"] or "", r["item_id"], r["tokens_covered"]) for r in got) == [("", "six", 6), ("a", "long", 20_000), ("b", "six", 6)]
    assert tiling.contaminated(docs, items.where("false")).count() == 0 and tiling.contaminated(docs.where("false"), items).count() == 0
    assert [r["doc_id"] for r in tiling.decontaminated(docs, items).collect()] == ["c"]


def test_tiling_equals_plain_greedy():
    import random

    import numpy as np

    def plain(doc, item, least):
        free_d, free_i, covered = [True] * len(doc), [True] * len(item), 0
        while True:
            best, found = least, []
            for i in range(len(item)):
                for d in range(len(doc)):
                    n = 0
                    while i + n < len(item) and d + n < len(doc) and free_i[i + n] and free_d[d + n] and item[i + n] == doc[d + n]:
                        n += 1
                    if n > best:
                        best, found = n, [(i, d)]
                    elif n == best:
                        found.append((i, d))
            if not found:
                return covered
            for i, d in found:
                if all(free_i[i : i + best]) and all(free_d[d : d + best]):
                    free_i[i : i + best] = free_d[d : d + best] = [False] * best
                    covered += best

    rng = random.Random(3)
    for _ in range(150):
        words = [tiling.tokens(w)[0] for w in "abcdef"[: rng.randint(1, 6)]]
        doc, item = ([rng.choice(words) for _ in range(rng.randint(0, 40))] for _ in range(2))
        as_array = lambda x: np.array(x, dtype=np.uint64)
        assert tiling.tile(as_array(doc), as_array(item), 3) == plain(doc, item, 3)


