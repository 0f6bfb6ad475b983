"""Cases that an earlier state cut off."""

import base64
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_brute_force import shingles

from sievework.llm import language, license_scan, ngram_join, secret_scan

NOISE = "kJ8sQ2vXw7PjR4tLm9YcB1nHsZk5"
DOCS = "doc_id bigint, text string"


@pytest.mark.parametrize(
    "text",
    [
        f"SIGNING_KEY={NOISE}", f"export ENCRYPTION_KEY={NOISE}", f"https://example.com/a?x=1&sig={NOISE}", f"signing_key:\n  {NOISE}", f"webhook\n\n{NOISE}",
        f'signingKey: "{NOISE}"', f'mySECRET "{NOISE}"', f'apiKeyValue: "{NOISE}"', f'authtoken "{NOISE}"', f"x{'y' * 300}\nclient key\n{NOISE}",
    ],
)
def test_secret_in_wider_contexts(text):
    spans = secret_scan.novel_spans(text, [], secret_scan.Novelty(), 0.6)
    assert [text[s:e] for s, e, _ in spans] == [NOISE]


def test_no_secret_without_context():
    novelty = secret_scan.Novelty()
    for text in (NOISE, f"monkey {NOISE}", f"Keyboard {NOISE}", f"client key\nplain\n{NOISE}", "SIGNING_KEY=client_secret_access_key_1"):
        assert secret_scan.novel_spans(text, [], novelty, 0.6) == []


def test_secret_in_padding_and_whole_candidates():
    other = "Gd7xW3nTfa0VuE5hJq2LrKy6bMzC"
    text = f"key: {NOISE}=Zq3 and\nplain\nSIGNING_KEY={other}=="
    spans = secret_scan.novel_spans(text, [], secret_scan.Novelty(), 0.6)
    assert [text[s:e] for s, e, _ in spans] == [f"{NOISE}=Zq3", f"{other}=="]


@pytest.mark.parametrize("feed", ["\n", "\\n"])
@pytest.mark.parametrize("kind", ["PRIVATE KEY", "RSA PRIVATE KEY"])
def test_private_key_body(feed, kind):
    raw = base64.b64encode(np.random.default_rng(1).bytes(599)).decode()
    body = feed.join(raw[i : i + 64] for i in range(0, len(raw), 64))
    text = f"a\n-----BEGIN {kind}-----{feed}{body}{feed}-----END {kind}-----{feed}b"
    spans = secret_scan.novel_spans(text, [], secret_scan.Novelty(), 0.6)
    assert [text[s:e] for s, e, _ in spans] == [body]


@pytest.mark.parametrize("title", ["MIT License", "The MIT License (MIT)"])
def test_titled_license_file(spark, title):
    mit = license_scan.KNOWN["MIT"][0]
    lines = ["Copyright (c) 2020 A. B.", "Copyright Some Company, Inc.", "(c) Copyright 2019-present, C. D.", "Copyright by E. F.", "Copyright (C) Contributors to G"]
    df = spark.createDataFrame([(i, f"{title}\n\n{line}\n\n{mit}") for i, line in enumerate(lines)], DOCS)
    got = license_scan.find_licenses(df, license_scan.known_licenses(spark)).collect()
    assert sorted((r["doc_id"], r["part"], r["license_id"]) for r in got) == [(i, 0, "MIT") for i in range(len(lines))]


def test_full_texts_however_wrapped(spark):
    """Lines may begin with any word, so also with the 'copyright' of licence prose."""
    wanted, rows = {}, []
    for name, texts in license_scan.FULL.items():
        own = [x for x in texts[0].split("\n") if not x.strip().lower().startswith("copyright (c)") and not x.strip().startswith("Copyright [")]
        wrapped = re.sub(r"(?i)\s+(copyright\b)", r"\n\1", " ".join(own)) if "Copyright (C)" not in " ".join(own) else "\n".join(own)
        for t in (texts[0], "Copyright 2021 H. I.\n" + "\n".join(own), wrapped):
            wanted[len(rows)] = name
            rows.append((len(rows), t))
    got = license_scan.find_licenses(spark.createDataFrame(rows, DOCS), license_scan.known_licenses(spark)).where("part = 0").collect()
    assert {r["doc_id"]: r["license_id"] for r in got} == wanted
    assert {"Apache-2.0", "GPL-3.0", "BSD-3-Clause", "BSD-2-Clause", "MPL-2.0", "LGPL-2.1", "LGPL-3.0"} <= set(wanted.values())


@pytest.mark.parametrize("block,long", [(1 << 18, 32), (100, 2), (100, 10_000)])
def test_join_returns_all_links(spark, monkeypatch, block, long):
    """A group of near copies, a chain and exact copies against all pairs; in blocks and as pairs."""
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", block)
    monkeypatch.setattr(ngram_join, "LONG_LIST", long)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join([*base[:k], f"x{k}", *base[k + 1 :]]) for k in range(40)] + [" ".join(base[k:] + [f"y{i}" for i in range(k)]) for k in range(0, 24, 3)]
    texts += [texts[3], texts[3].upper(), "alone here", "", None]
    sets = [shingles(t, 3) for t in texts]
    near = lambda x, y: x and y and 100 * len(x & y) >= 80 * len(x | y)
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    rows = ngram_join.jaccard_components(df, n=3, percent=80).collect()
    wanted = {i: sum(bool(near(sets[i], sets[j])) for j in range(len(sets)) if i != j) for i in range(len(sets))}
    assert {r["doc"]: r["links"] for r in rows} == wanted and max(wanted.values()) > 30
    first = {}
    for r in sorted(rows):
        first.setdefault(r["cid"], r["doc"])
    first.pop(None)
    pairs = [tuple(sorted((first[r["a"]], first[r["b"]]))) for r in ngram_join.linked_classes(df, n=3, percent=80).collect()]
    kinds = sorted(first.values())
    assert sorted(pairs) == [(i, j) for i in kinds for j in kinds if i < j and near(sets[i], sets[j])]


def test_copies_take_no_place_in_training(spark):
    texts = [" ".join(w) for w in np.random.default_rng(4).choice(["le", "chat", "noir", "dort", "ici", "bien"], (20, 8))]
    plain = spark.createDataFrame([("fr", t) for t in texts], "lang string, text string")
    copied = plain.unionByName(spark.createDataFrame([("fr", t) for t in texts for _ in range(30)], plain.schema))
    one, two = (language.train_language(df, rows=5) for df in (plain, copied))
    assert one.logs.shape[0] == 2
    assert all(np.array_equal(getattr(one, f), getattr(two, f)) for f in one.__dataclass_fields__)


def test_links_at_the_threshold_and_hot_shingles(spark, monkeypatch):
    """Sets of sizes at the border, many components in one posting list, against all pairs."""
    monkeypatch.setattr(ngram_join, "LONG_LIST", 4)
    rng = np.random.default_rng(8)
    hot = [f"h{i}" for i in range(12)]
    texts = []
    for k in range(60):  # all hold the hot words, in groups of three that differ by few words
        own = [f"g{k // 3}_{i}" for i in range(int(rng.integers(8, 30)) if k % 3 == 0 else len(own))]
        texts.append(" ".join([*hot, *own[: len(own) - k % 3], *[f"x{k}_{i}" for i in range(k % 3)]]))
    texts += [" ".join(f"z{i}" for i in range(n)) for n in range(1, 45)]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    for n, percent in ((1, 80), (2, 90)):
        sets = [shingles(t, n) for t in texts]
        near = lambda x, y: 100 * len(x & y) >= percent * len(x | y)
        got = ngram_join.jaccard_components(df, n=n, percent=percent).collect()
        assert {r["doc"]: r["links"] for r in got} == {i: sum(near(x, y) for j, y in enumerate(sets) if i != j) for i, x in enumerate(sets)}
        label = list(range(len(sets)))
        for i, x in enumerate(sets):
            for j in range(i):
                if near(x, sets[j]) and label[i] != label[j]:
                    low, high = sorted((label[i], label[j]))
                    label = [low if v == high else v for v in label]
        assert {r["doc"]: r["component"] for r in got} == dict(enumerate(label))


def test_one_row_of_each_group_stays(spark):
    """Rows with null and repeated ids are told apart."""
    text, other = "a b c d e f g h", "i j k l m n o p"
    rows = [(None, text), (None, text), (5, other), (5, text), (5, other), (9, other), (None, other), (None, "alone it is here today"), (None, None), (None, None), (3, "")]
    df = spark.createDataFrame(rows, DOCS).withColumn("cid", F.lit(1)).withColumn("key", F.lit("k"))
    got = ngram_join.one_per_component(df, n=5, percent=80)
    assert got.columns == df.columns
    assert sorted(((r["doc_id"] or 0, r["text"] or "") for r in got.collect())) == sorted([(5, text), (5, other), (0, "alone it is here today"), (0, ""), (0, ""), (3, "")])
