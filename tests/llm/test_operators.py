import bisect
import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spokeworks.llm import kdtree, licenses, mixing, near_copies, packing, perplexity, quality, secret_scan, simhash, token_counts, url_rules

DOCS = "doc_id long, text string, lang string, source string, spans string, length string"
WORDS = "the of and to in is it on that with for was by are from at this be or an".split()


def prose(n, seed):
    rng = random.Random(seed)
    made = ["".join(rng.choices(["er", "th", "in", "on", "st", "ed", "ly"], k=rng.randint(1, 3))) for _ in range(60)]
    return " ".join(rng.choice(WORDS + made) for _ in range(n)).capitalize() + "."


def docs_of(spark, texts, lang="en"):
    return spark.createDataFrame([(k, t, lang, f"s{k % 3}", "clash", "clash") for k, t in enumerate(texts)], DOCS)


ODD = [None, "", " \n\t ", "a", prose(30, 1), prose(30, 1), prose(4000, 2), "é漢字😀 " * 30, None]


def test_base_spans_are_leftmost_and_failing_matches_consume():
    text = "x Token: 'abcdef' secret=token:abcdefgh AKIA" + "A" * 15 + " AKIA" + "B" * 16 + " " + "a1" * 12 + " pa\u017f\u017fword=abcdefg API_KEY = q.w=e-r"
    found = [(secret_scan.KINDS[k], text[a:b]) for a, k, b, _ in secret_scan.base_spans(text)]
    assert found == [("assign", "Token: 'abcdef"), ("access", "AKIA" + "B" * 16), ("hex", "a1" * 12), ("assign", "API_KEY = q.w=e-r")]


def test_markov_model_finds_random_strings_and_leaves_words(spark):
    rng = random.Random(4)
    alphabet = secret_scan.ALPHABET
    random_strings = ["".join(rng.choices(alphabet, k=30)) for _ in range(60)]
    samples = [(s, 1) for s in random_strings[:40]] + [(prose(200, k), 0) for k in range(20)] + [("get_user_account_name parse_request_headers " * 5, 0)]
    model = secret_scan.fit(secret_scan.count_labelled(spark.createDataFrame(samples, "text string, label int")), least_length=20, least_mean=0.5, ordinary_prior=0.05)
    texts = [f"see {s} here" for s in random_strings[40:]] + ["ingthonererstlyinthonederon and get_user_request_account_name_headers"] + ODD
    rows = {r.doc_id: r for r in secret_scan.find_secrets(docs_of(spark, texts), model).collect()}
    assert all([(s.kind, s.start, s.end) for s in rows[k].spans] == [("markov", 4, 34)] for k in range(20))
    assert all(not rows[k].spans for k in range(20, len(texts)))
    digest = secret_scan.digest(secret_scan.find_secrets(docs_of(spark, ["token=abcdef " + random_strings[41], None]), model)).orderBy("doc_id").collect()
    assert digest[0].base_sha256 == hashlib.sha256(b"assign:0:12").hexdigest() and digest[0].spans == "assign:0:12,markov:13:43"
    assert digest[1].base_sha256 == secret_scan.empty_digest() and digest[1].spans == ""
    clean = secret_scan.redact(docs_of(spark, ["a token=abcdef b", None]), model).orderBy("doc_id").collect()
    assert [r.text for r in clean] == ["a [SECRET] b", None]


HELD_WORDS = "umbrella pocket winter yellow hammer kitchen quality journey freedom obviously weather unlock vector widget throttle update upgrade user validate value verify version view wait window worker wrapper write workspace territory schnell vielleicht gegenwart heureux lumiere ventana mientras".split()


def test_secrets_on_samples_and_words_held_out(spark):
    model = secret_scan.fit(secret_scan.count_labelled(spark.createDataFrame(secret_scan.labelled_samples(), "text string, label int")))
    rng = random.Random(77)
    secrets = [secret_scan.random_string(rng) for _ in range(2000)]
    names = [secret_scan.identifier(rng, HELD_WORDS) for _ in range(2000)]
    hits, wrong = (sum(bool(model.stretches(t, [])) for t in texts) for texts in (secrets, names))
    assert hits / len(secrets) >= 0.95 and hits / (hits + wrong) >= 0.95
    ordinary = ["getUserAccountByIdentifierFromDatabaseConnection", "MAXIMUM_CONNECTION_POOL_SIZE_EXCEEDED", "src/main/java/org/example/service/UserServiceImpl", "123e4567-e89b-12d3-a456-426614174000", "-" * 30]
    assert not any(model.stretches(t, []) for t in ordinary)
    # the ratio by counting every transition, one by one
    counts = {0: {}, 1: {}}
    for text, label in secret_scan.labelled_samples():
        for pair in zip(text, text[1:]):
            counts[label][pair] = counts[label].get(pair, 0) + 1
    chance = lambda label, prior, a, b: (counts[label].get((a, b), 0) + prior) / sum(counts[label].get((a, x), 0) + prior for x in secret_scan.ALPHABET)
    for a, b in [("g", "e"), ("Z", "7"), ("_", "_"), ("q", "X")]:
        at = (secret_scan.ALPHABET.index(a) + 1) * secret_scan.SIZE + secret_scan.ALPHABET.index(b) + 1
        assert model.ratio[at] == pytest.approx(np.log(chance(1, 2.0, a, b) / chance(0, 0.5, a, b)))


def test_secret_scans_of_empty_tables_and_repeated_rows(spark):
    docs = docs_of(spark, [*ODD, "token=abcdef"])
    model = secret_scan.train(docs)
    twice = secret_scan.digest(secret_scan.find_secrets(docs.unionByName(docs), model))
    assert twice.count() == 2 * len(ODD) + 2 and twice.distinct().count() == len(ODD) + 1
    assert secret_scan.find_secrets(docs.limit(0), secret_scan.train(docs.limit(0))).count() == 0


def test_stretches_find_the_rest_of_keys_and_values_within_long_runs(spark):
    rng = random.Random(6)
    key = lambda n: "".join(rng.choices(secret_scan.ALPHABET[:62], k=n))
    plain = [prose(200, k) + " /home/user/projects/request_headers/settings_of_account_names" for k in range(20)]
    texts = plain + [f"api_key={key(40)}" for _ in range(60)] + ["password=correct_horse_battery"] * 9
    model = secret_scan.train(docs_of(spark, texts))
    for _ in range(20):
        value = key(40)
        path = "/home/user/projects/settings_of_account_names/request_headers/" * 5  # ordinary enough to hide the value in a mean
        spans = model.stretches(path + value, [])
        assert len(path) - 12 <= min(a for a, *_ in spans) <= len(path) and spans[-1][2] == len(path + value)
        for text in (f"{value}{'3f' * 12}{key(30)}", f"AKIA{'B' * 16}q{value}"):  # the rest of a key lies on either side of a span
            base = secret_scan.base_spans(text)
            covered = {i for a, _, b, _ in base + model.stretches(text, base) for i in range(a, b)}
            assert len(covered) >= len(text) - 8
    assert not any(model.stretches(t, []) for t in plain)
    caught = {r.pair for r in secret_scan.count_by_rules(docs_of(spark, texts[-9:])).collect() if r.label == 1}
    assert not caught  # words are no random strings


def test_token_counts_equal_the_librarys(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [*ODD, "x" * 5000, " " * 700, "the token " * 400, "<s>a</s>\x00▁b " * 90]
    rows = token_counts.count_tokens(docs_of(spark, texts), path, chunk=100, overlap=4).orderBy("doc_id").collect()
    assert [r.n_tokens for r in rows] == [len(library.encode(t or "")) for t in texts]
    assert [r.n_bytes for r in rows] == [len((t or "").encode()) for t in texts]


@pytest.fixture(scope="module")
def license_model(spark):
    return licenses.fit(docs_of(spark, [prose(40, k) for k in range(200)]))


GPL = """// This program is free software: you can redistribute it
// and/or modify it under the terms of the GNU General
// Public License as published by the Free Software
// Foundation, either version 3 of the License."""


@pytest.mark.parametrize(
    ("text", "families"),
    [
        ("Released under the MIT License.", ["mit"]), ("MIT License", ["mit"]), ("SPDX-License-Identifier: MIT", ["mit"]), ("Licensed under CC BY-NC 4.0.", ["cc"]), ("Released under the MPL 2.0", ["mpl"]),
        ("ISC License", ["isc"]), ("LGPL-2.1 license", ["lgpl"]), ("Licensed under the EPL-2.0.", ["epl"]), ("All rights reserved.", ["proprietary"]), (GPL, ["gpl"]),
        ("Released under the MIT License.\nLicensed under the Apache License, Version 2.0", ["mit", "apache"]), (f"{prose(40, 1)}\n\n{GPL}\n\n{prose(9, 2)} ISC License", ["gpl", "isc"]),
        ("All rights reserved seats were licensed under the bridge.", []), ("the license of version public general rights under", []), ("He was licensed under a state program for the general public.", []), ("ein Mann mit Lizenz", []), ("", []),
    ],
)
def test_licences_are_found_confirmed_or_unknown(license_model, text, families):
    found = license_model.scan(text)
    assert [n["family"] for n in found] == families and all(n["confirmed"] for n in found)
    assert all(0 <= n["start"] < n["end"] <= len(text) for n in found)


@pytest.mark.parametrize(
    ("text", "families"),
    [
        ("MPL-2.0", ["mpl"]), ("The code is BSD-3-Clause and the docs are CC BY 4.0.", ["bsd", "cc"]), ("SPDX-License-Identifier: (MIT OR Apache-2.0)", ["apache", "mit"]), ("# SPDX-License-Identifier: BSL-1.0", ["boost"]),
        ("Licensed under the MIT License and the Apache License 2.0.", ["apache", "mit"]), ("Distributed under the Boost Software License, Version 1.0.", ["boost"]), ("Released under the zlib License", ["zlib"]), ("Licensed under the Artistic License 2.0", ["artistic"]), ("This work is licensed under a WTFPL", ["wtfpl"]),
    ],
)
def test_notices_without_cue_words_and_of_several_families(license_model, text, families):
    assert sorted({n["family"] for n in license_model.scan(text)}) == families


def test_licence_probabilities_by_plain_sums_and_templates_hold_cues(license_model):
    m, words = license_model, licenses.whole("Redistribution of the MIT License is permitted")
    z = [(sum(float(m.weights[m.index[g]][c]) for g in licenses.ngrams(words) if g in m.index) + float(m.bias[c])) / m.temperature for c in range(len(m.classes))]
    total = sum(np.exp(z))
    assert m.probabilities(words) == pytest.approx([np.exp(x) / total for x in z], rel=1e-4)
    made = licenses.notices()
    assert set(made) == {*licenses.NAMES, *licenses.TEXTS} and all(any(c in t.lower() for c in licenses.CUES) for ts in made.values() for _, t in ts)


def test_licences_of_families_are_told_apart_on_notices_held_out(license_model):
    rows = licenses.samples([prose(30, k) for k in range(100)], 4, 5)
    held = {g for k, g in enumerate(sorted({g for g, _, _ in rows})) if k % 5 == 0}
    model = licenses.train([r for r in rows if r[0] not in held])
    hit = [(g, c, found[0] if (found := model.find(words)) else licenses.UNKNOWN) for g, c, words in rows if g in held]
    framed = [a == b for g, a, b in hit if g in licenses.FRAMES]  # the texts that are held out have no kin to learn from
    named = [a == b for _, a, b in hit if b != licenses.UNKNOWN]
    alarms = [b != licenses.UNKNOWN for _, a, b in hit if a == licenses.UNKNOWN]
    assert sum(framed) / len(framed) > 0.65 and sum(named) / len(named) > 0.9 and sum(alarms) / len(alarms) < 0.05


def test_only_sentences_that_may_be_notices_are_scored_alone(license_model, monkeypatch):
    rng = random.Random(8)
    pieces = [prose(12, k) + "." for k in range(40)] + ["Licensed under the MIT License.", GPL, "SPDX-License-Identifier: MIT OR ISC", "", " ", "All rights\nReserved", "-- (c)", "The end", "x.\ny"]
    texts = ["".join(x + rng.choice(["\n", "\n\n", " ", "\n \n"]) for x in rng.choices(pieces, k=rng.randint(0, 12))) for _ in range(200)]
    every = [[(k, a, b, f) for k, a, b, words in licenses.sentences(t) for f in license_model.families(words)] for t in texts]
    for t in texts:
        for _, a, b, words in licenses.sentences(t):
            assert licenses.whole(t[a:b])[:-1] == [w for w in words if w != "\n"]
    alone = []
    single = licenses.LicenseModel.probabilities
    monkeypatch.setattr(licenses.LicenseModel, "probabilities", lambda self, words: alone.append(words) or single(self, words))
    found = [license_model.scan(t) for t in texts]
    assert [{n["family"] for n in f} for f in found] == [{f[0] for *_, f in e} for e in every]
    assert all(max((n["probability"] for n in f), default=0) == max((x[3][1] for x in e), default=0) for f, e in zip(found, every, strict=True))
    assert len(alone) < 0.6 * sum(len(list(licenses.sentences(t))) for t in texts)


def test_licence_scans_of_odd_tables(spark, license_model):
    texts = [*ODD, "x " * 200_000 + "\n\nMIT License", f"{prose(20, 99)}\nReleased under the MIT License."]
    docs = docs_of(spark, texts)
    rows = licenses.scan(docs.unionByName(docs), license_model).collect()
    assert len(rows) == 2 * len(texts) and sum(len(r.notices) for r in rows) == 4
    n = next(r.notices[0] for r in rows if r.doc_id == len(texts) - 1)
    assert texts[-1][n.start : n.end] == "Released under the MIT License." and n.paragraph == 0
    assert licenses.scan(docs.limit(0), licenses.fit(docs.limit(0))).count() == 0


def brute_top_k(rows, k=5):
    """(query id, rank, id, score) for (id, vector) rows; every row is a candidate, a query's own row excepted."""
    good = [(i, [int(np.floor(256 * x)) if abs(x) < 1e15 else int(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (q, v) in enumerate(good):
        if q % 50 == 0:
            scores = [(max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(v, w, strict=True)))), i) for m, (i, w) in enumerate(good) if m != n and len(w) == len(v)]
            out += [(q, r + 1, i, s) for r, (s, i) in enumerate(sorted(scores, key=lambda x: (-x[0], x[1]))[:k])]
    return sorted(out)


@pytest.mark.parametrize("same", [False, True])
def test_kd_tree_equals_brute_force_with_ties_repeated_ids_and_bad_rows(spark, same):
    rng = np.random.default_rng(1)
    vectors = rng.normal(0, 0.2, (400, 8)).round(2)
    if same:
        vectors[50:300] = vectors[50]
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)] + [(1000, None), (1001, [1.0, None] * 4), (1002, [float("nan")] * 8), (1003, []), (None, [0.1] * 8), (2000, [1.0, 2.0])]
    rows += [(7, [3.0] * 8), (7, [3.0] * 8), (100, vectors[100].tolist()), (100, [-1.0] * 8)]  # repeated ids, one of them a query's
    table = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, score int")
    found = sorted(tuple(r) for r in kdtree.top_k(table, "vec_id % 50 = 0", k=5, shard_rows=90, block_rows=4).collect())
    assert found == brute_top_k(rows)
    assert any(r[2] == 7 for r in found)
    assert kdtree.top_k(table.limit(0), "vec_id % 50 = 0").count() == 0


@pytest.mark.parametrize("size", [1e7, 1e12, 1e18, 1e160])
def test_large_components_give_exact_or_saturated_scores(spark, size):
    rng = np.random.default_rng(4)
    rows = [(k, (rng.normal(0, 1, 3) * size * 10 ** float(rng.uniform(-9, 0))).tolist()) for k in range(120)] + [(50, [1e308, 0.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    finite = [(i, v) for i, v in rows if np.isfinite(np.array(v) * 256).all()]
    assert sorted(tuple(r) for r in kdtree.top_k(table, "vec_id % 50 = 0", shard_rows=40).collect()) == brute_top_k(finite)


def test_regions_that_cannot_reach_the_kth_score_are_left_out_before_the_search(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 4, (12, 6))
    rows = [(k, (centres[k % 12] + rng.normal(0, 0.05, 6)).round(3).tolist()) for k in range(1200)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked, visit = [], kdtree.visit
    monkeypatch.setattr(kdtree, "visit", lambda queries, trees, k, blocks: asked.append((queries.count(), trees.count())) or visit(queries, trees, k, blocks))
    assert sorted(tuple(r) for r in kdtree.top_k(table, "vec_id % 50 = 0", shard_rows=60).collect()) == brute_top_k(rows)
    (homes, trees), (rest, _) = asked
    assert homes == 24 and trees >= 16 and rest < homes * (trees - 1) / 3


def test_rule_counts_by_brute_force():
    for text in [t or "" for t in ODD] + ["a b c d e f a b c d e", "x\nx\n\n \nx", "a# b$ <c>|", "a a a a a a a"]:
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        twice = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)} if len(windows) < 500 else None
        got = perplexity.rule_counts(text)
        assert got[0] == len(words) and got[1] == sum(map(len, words)) and got[2] == sum(c in "#*$%&|<>" for c in text)
        lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        assert got[3] == len(lines) - len(set(lines))
        assert twice is None or got[4] == len(twice)


def dense_kneser_ney(texts, order):
    """log p(character | others) of any n-gram by the textbook, from dictionaries."""
    top = {}
    for t in texts:
        padded = " " * (order - 1) + t
        for k in range(len(t)):
            top[padded[k : k + order]] = top.get(padded[k : k + order], 0) + 1
    counts = {order: top}
    for k in range(order - 1, 0, -1):
        counts[k] = {}
        for g in counts[k + 1]:
            counts[k][g[1:]] = counts[k].get(g[1:], 0) + 1
    ds = {}
    for k, c in counts.items():
        n = [list(c.values()).count(i) for i in range(5)]
        d = [0.5, 1.0, 1.5]
        if min(n[1:]) > 0:
            y = n[1] / (n[1] + 2 * n[2])
            made = [i - (i + 1) * y * n[i + 1] / n[i] for i in (1, 2, 3)]
            d = made if all(0 < x < i for i, x in enumerate(made, 1)) else d
        ds[k] = d

    def p(gram):
        k = len(gram)
        lower = 1 / (len(counts[1]) + 1) if k == 1 else p(gram[1:])
        own = {g: n for g, n in counts[k].items() if g[:-1] == gram[:-1]}
        if not own:
            return lower
        cost = lambda n: ds[k][min(n, 3) - 1]
        n, total = own.get(gram, 0), sum(own.values())
        return ((n - cost(n)) if n else 0) / total + sum(map(cost, own.values())) / total * lower

    return lambda gram: np.log(p(gram))


def test_counting_ngrams_takes_bounded_memory():
    words = ["".join(random.Random(k).choices("abcdefghijklmnopqrstuvwxyz", k=6)) for k in range(3000)]
    texts = [" ".join(random.Random(k).choices(words, k=1430)) for k in range(600)]
    tracemalloc.start()
    for a, b in perplexity.blocks(texts):
        perplexity.grams_of(texts[a:b])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 160e6  # 6 million characters in all


@pytest.mark.parametrize("most", [perplexity.MOST_ENTRIES, 80])
def test_models_and_scores_equal_the_dense_form_broadcast_and_by_joins(spark, most):
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcdé \u0436\u4e2d", (9, 5, 3, 2, 1, 6, 2, 1), k=rng.randint(1, 60))) for _ in range(40)] + ["", None, "aab\x00", "aab\x00"]
    docs = docs_of(spark, texts)
    folds = {r.doc_id: r.f for r in docs.select("doc_id", perplexity.fold(F.coalesce("text", F.lit(""))).alias("f")).collect()}
    assert set(folds.values()) == {0, 1}
    dense = [dense_kneser_ney([(texts[k] or "").replace("\x00", "\ufffd") for k in [*range(len(texts)), 3] if folds[k] != f], perplexity.ORDER) for f in (0, 1)]
    rows = perplexity.score(docs.unionByName(docs.filter("doc_id = 3")), most_entries=most).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        t = " " * (perplexity.ORDER - 1) + (texts[r.doc_id] or "").replace("\x00", "\ufffd")
        want = -sum(dense[folds[r.doc_id]](t[k : k + perplexity.ORDER]) for k in range(len(t) - perplexity.ORDER + 1))
        assert r.nll == pytest.approx(want, rel=1e-5, abs=1e-5)


def test_grams_of_many_letters_and_a_distribution(spark):
    text = "".join(map(chr, range(0x4E00, 0x4E00 + 7000))) + "ab" * 50
    grams = perplexity.grams_of([text, "", "ab"])
    made = grams.texts()
    padded = " " * 4 + text
    assert [made[i] for i in grams.at[: len(text)]] == [padded[k : k + 5] for k in range(len(text))]
    assert grams.ends.tolist() == [len(text), len(text), len(text) + 2] and grams.counts().sum() == len(text) + 2
    models = perplexity.hashed(perplexity.kneser_ney(perplexity.count_ngrams(docs_of(spark, [prose(300, k) for k in range(6)]))))
    model = models[0]
    letters = np.unique(np.concatenate([perplexity.codes_of(prose(300, k)) for k in range(6)]))
    letters = letters[model.find("p", letters[:, None])[1]]
    for context in (" the", "zzzz", "e.  "):
        p = np.exp(model.log_p(np.array([[*map(ord, context), int(c)] for c in letters] + [[*map(ord, context), 0x2603]])))
        assert p.min() > 0 and p.sum() == pytest.approx(1, abs=1e-3)


def test_ngrams_are_told_apart_in_blocks_and_no_batch_is_held(spark, monkeypatch):
    monkeypatch.setattr(perplexity, "TOLD_APART", 500)
    texts = [prose(60, k) for k in range(40)] + ["", "a", "aaaaaaa"]
    batch = pa.RecordBatch.from_arrays([pa.array([k % 3 for k in range(43)], pa.int32()), pa.array(range(43), pa.int64()), pa.array(texts)], ["model", "text_hash", "text"])
    found, blocks = {}, 0
    for name, h, grams, text, gram, times in perplexity.told_apart(batch):
        blocks += 1
        assert sum(len(texts[k]) for k in h) <= 500 or len(h) == 1
        names = grams.texts()
        found |= {(name, int(h[t]), names[g]): int(n) for t, g, n in zip(text, gram, times, strict=True)}
    pad = " " * (perplexity.ORDER - 1)
    assert blocks > 20 and found == {(k % 3, k, g): n for k, t in enumerate(texts) for g, n in Counter((pad + t)[i : i + perplexity.ORDER] for i in range(len(t))).items()}
    asked = spark.createDataFrame([(0, str(k), k) for k in range(1, 200)], "model int, gram string, texts long")
    kept = [int(r.gram) for r in perplexity.hot(asked, 50).collect()]
    assert 30 < len(kept) <= 50 and min(kept) == 200 - len(kept) and perplexity.hot(asked, 1).count() == 0


def test_perplexity_bands_keep_prose_and_reject_noise(spark):
    rng = random.Random(9)
    noise = [" ".join("".join(rng.choices("qxzjvkw#", k=6)) for _ in range(60)) for _ in range(3)]
    other = ["".join(map(chr, rng.choices(range(0x430, 0x450), k=6))) for _ in range(60)]  # unlike any text of the language
    docs = docs_of(spark, [prose(80, k) for k in range(60)] + noise + [" ".join(other), " ".join(other)] + ODD)
    rows = {r.doc_id: r for r in perplexity.quality_rules(docs).collect()}
    assert all(rows[k].kept for k in range(60)) and not any(rows[k].kept for k in range(60, 65))
    assert len(rows) == 65 + len(ODD) and all(rows[65 + k].base_failed for k in (0, 1, 2, 3, 8))
    assert perplexity.quality_rules(docs.limit(0)).count() == 0


TOPICAL = ["password token of the server", "call the phone +49 151 23456789", ""]


def mixed_docs(spark, n=600):
    docs = docs_of(spark, [f"{prose(40, k) if k % 2 else prose(200, k)} {TOPICAL[k // 20 % 3]}" for k in range(n)])
    return docs.withColumn("lang", F.when(F.col("doc_id") % 5 < 2, "de").otherwise("en")).withColumn("source", F.concat(F.lit("s"), (F.col("doc_id") % 20).cast("string")))


def shares_of(rows, name):
    own = {v: sum(r.n_tokens * r.probability for r in rows if r[name] == v) for v in {r[name] for r in rows}}
    return {v: x / sum(own.values()) for v, x in own.items()}


def test_raking_meets_the_marginals_and_draws_by_probability(spark):
    targets = {"source": {"s0": 0.2}, "lang": {"en": 0.7, "de": 0.3}, "topic": {"software": 0.5, "contact": 0.3, "general": 0.2}}
    docs = mixed_docs(spark)
    rows = mixing.mix(docs, targets).collect()
    assert all(r.topic == ("software", "contact", "general")[r.doc_id // 20 % 3] for r in rows)
    for name, want in targets.items():
        own = shares_of(rows, name)
        assert all(own[v] == pytest.approx(w, abs=1e-6) for v, w in want.items())
    kept = [r for r in rows if r.kept]
    assert abs(len(kept) - sum(r.probability for r in rows)) < 4 * len(rows) ** 0.5
    assert {r.doc_id for r in kept} == {r.doc_id for r in mixing.sample(docs, targets).collect()}
    assert mixing.mix(docs_of(spark, ODD), powers={"source": 0.5, "lang": 1.0, "topic": 1.0}).count() == len(ODD) and mixing.mix(docs.limit(0), targets).count() == 0
    twice = mixing.mix(docs.unionByName(docs), targets).groupBy("doc_id").agg(F.count_distinct("kept").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    assert all((r.n, r["rows"]) == (1, 2) for r in twice)


def test_twenty_sources_get_tempered_targets_and_the_report_tells_them(spark):
    docs = mixed_docs(spark).withColumn("source", F.when(F.col("doc_id") % 3 == 0, "s0").otherwise(F.col("source")))
    mixed = mixing.mix(docs, powers={"source": 0.5, "lang": 0.8, "topic": 1.0})
    rows = mixed.collect()
    sums = {v: sum(r.n_tokens for r in rows if r.source == v) for v in {r.source for r in rows}}
    total, own = sum(sums.values()), shares_of(rows, "source")
    root = {v: (n / total) ** 0.5 for v, n in sums.items()}
    assert len(own) == 20 and all(own[v] == pytest.approx(x / sum(root.values()), abs=1e-4) for v, x in root.items())
    told = {r.category: r for r in mixing.report(mixed, "source").collect()}
    assert all(told[v].expected == pytest.approx(own[v]) and told[v].all == pytest.approx(sums[v] / total) for v in own)
    few = mixing.tempered(mixed, {"source": 1.0}, most=3)["source"]
    assert len(few) == 4 and sum(few.values()) == pytest.approx(1) and few[mixing.REST] == pytest.approx(1 - sum(sorted(n for n in sums.values())[-3:]) / total)


def test_targets_that_cannot_be_met_together_are_refused(spark):
    _, residual = mixing.rake(np.array([10.0, 10.0]), [np.array([0, 1]), np.array([0, 1])], [np.array([0.9, 0.1]), np.array([0.1, 0.9])])
    assert residual == pytest.approx(0.8)
    docs = mixed_docs(spark, 60).withColumn("source", F.concat(F.lit("s"), F.col("lang")))
    with pytest.raises(ValueError, match="can't be met"):
        mixing.mix(docs, {"source": {"sen": 0.9, "sde": 0.1}, "lang": {"en": 0.1, "de": 0.9}, "topic": {}})


def test_languages_without_a_target_keep_their_proportion_unless_it_is_zero(spark):
    docs = mixed_docs(spark, 300).withColumn("lang", F.when(F.col("doc_id") % 5 == 0, None).when(F.col("doc_id") % 5 == 1, "it").when(F.col("doc_id") % 5 == 2, "de").otherwise("en"))
    targets = {"source": {"s3": 0.05}, "lang": {"en": 0.5, "de": 0.5}, "topic": {}}
    rows = mixing.mix(docs, targets).collect()
    own = shares_of(rows, "lang")
    rest = sum(r.n_tokens for r in rows if r.lang is mixing.REST) / sum(r.n_tokens for r in rows)
    assert own[mixing.REST] == pytest.approx(rest, abs=1e-6) and own["en"] == pytest.approx(own["de"])
    none = mixing.mix(docs, {"source": {}, "topic": {}} | {"lang": {"en": 0.5, "de": 0.5, mixing.REST: 0.0}}).collect()
    assert all((r.probability == 0) == (r.lang is mixing.REST) for r in none)


def plain_raking(tokens, targets):
    """Weights by cell (a dict) whose marginals meet the targets (a dict each), by plain loops."""
    w = {c: n / sum(tokens.values()) for c, n in tokens.items()}
    for _ in range(500):
        for axis, target in enumerate(targets):
            for k, t in target.items():
                own = sum(x for c, x in w.items() if c[axis] == k)
                w = {c: x * t / own if c[axis] == k and own else x for c, x in w.items()}
    return w


def test_probabilities_equal_a_plain_raking_of_cells(spark):
    docs = mixed_docs(spark, 240)
    targets = {"source": {"s0": 0.2, "s1": 0.1}, "lang": {"en": 0.6, "de": 0.4}, "topic": {"software": 0.5, "contact": 0.3, "general": 0.2}}
    rows = mixing.mix(docs, targets).collect()
    tokens = {}
    for r in rows:
        tokens[r.source, r.lang, r.topic] = tokens.get((r.source, r.lang, r.topic), 0) + r.n_tokens
    w = plain_raking(tokens, [{"s0": 0.2, "s1": 0.1, None: 0.7}, *list(targets.values())[1:]])
    factor = {c: w[c] / n for c, n in tokens.items()}
    assert len(tokens) > 10 and all(r.probability == pytest.approx(factor[r.source, r.lang, r.topic] / max(factor.values()), abs=1e-6) for r in rows)


def test_categories_named_like_marks_are_categories_of_their_own(spark, monkeypatch):
    names = ["rest", "*", "=*", "=", "", "a\x1fb", "a", "b", '"],["', None]
    docs = spark.createDataFrame([(k, "a word or two " * (1 + k % 7), names[k % 10], names[k // 10 % 10]) for k in range(600)], "doc_id long, text string, source string, lang string")
    for most in (mixing.MOST_CELLS, 3):
        monkeypatch.setattr(mixing, "MOST_CELLS", most)
        rows = mixing.mix(docs, powers={"source": 0.5, "lang": 0.8, "topic": 1.0}).collect()
        assert len(rows) == 600 and all(r.probability > 0 for r in rows)
        assert all((r.source, r.lang) == (names[r.doc_id % 10], names[r.doc_id // 10 % 10]) for r in rows)
        own = shares_of(rows, "source")
        assert max(own.values()) < 2 * min(own.values())
        only = mixing.sample(docs, {"source": {"rest": 0.5, mixing.REST: 0.0, "*": 0.5}, "lang": {}, "topic": {}}).collect()
        assert {r.source for r in only} == {"rest", "*"}


def test_a_thousand_categories_of_two_kinds_meet_their_targets(spark):
    docs = spark.range(150_000).select(F.col("id").alias("doc_id"), F.lit("some words of text").alias("text"), F.concat(F.lit("s"), F.pmod(F.xxhash64("id"), F.lit(1000))).alias("source"), F.concat(F.lit("l"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000))).alias("lang"))
    mixed = mixing.mix(docs, powers={"source": 0.9, "lang": 0.9, "topic": 1.0})
    told = mixing.report(mixed, "lang").collect()
    assert len(told) >= 1000 and mixed.select("source", "lang").distinct().count() > mixing.MOST_CELLS
    total = sum(r.all**0.9 for r in told)
    assert all(r.expected == pytest.approx(r.all**0.9 / total, abs=2e-5) for r in told)


URLS = ["http://A.net/en/x", "https://b.Example.net/en/1?q", "https://example.net/en", "ftp://x.example.com/de/#f", "http://example.org/fr/", "nothing", None, "http://net", "http://notnet/", "http://example.com.net/", "x://y://a.org/fr/z", "http://a.net:80/"]


def test_url_trie_and_join_agree(spark):
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"), ("block", "org", "/fr/z"), ("allow", "org", "/f")]
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumn("host", F.lit("clash"))
    trie = {tuple(r) for r in url_rules.judge_urls(pages, rules).collect()}
    joined = {tuple(r) for r in url_rules.judge_urls(pages, spark.createDataFrame(rules, "verdict string, host string, path string"), most_rules=2).collect()}
    assert trie == joined
    by_id = {r[0]: r[1:] for r in trie}
    assert by_id[0] == ("a.net", "/en/x", "net/", "block") and by_id[1] == ("b.example.net", "/en/1", "example.net/en/", "allow")
    assert by_id[2][2:] == ("net/", "block") and by_id[3][2:] == ("example.com/de/", "block") and by_id[4][2:] == ("org/fr/", "allow")
    assert by_id[5] == by_id[6] == ("", "", None, "allow") and by_id[7] == ("net", "", None, "allow") and by_id[8][2] is None
    assert by_id[10][0] == "y:" and by_id[11][2] is None


def brute_components(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("largest", [32_768, 3])
def test_links_within_three_bits_join_as_brute_force_does(spark, largest):
    rng = random.Random(2)
    fps = {rng.getrandbits(64) for _ in range(30)}
    for x in list(fps)[:12]:
        for _ in range(6):
            x ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    table = spark.createDataFrame([(x,) for x in signed], "fp long")
    rows = {r.node: r.root for r in simhash.components(simhash.links(table, largest=largest)).collect()}
    got = [rows.get(x, x) for x in signed]
    roots = brute_components(fps)
    pairs = {}
    assert all(pairs.setdefault(a, b) == b for a, b in zip(roots, got, strict=True)) and len(set(roots)) == len(set(got))


def test_near_duplicates_end_to_end(spark):
    texts = [*ODD, prose(500, 2), prose(500, 2) + " more", prose(500, 3)]
    docs = docs_of(spark, texts)
    rows = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    words = texts[4].encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)]
    fp = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))
    assert rows[4].fp % (1 << 64) == fp
    assert rows[0].component_id == rows[1].component_id == rows[2].component_id == rows[8].component_id == 0
    assert rows[5].component_id == 4
    fps = [rows[k].fp % (1 << 64) for k in range(len(texts))]
    assert [rows[k].component_id for k in range(len(texts))] == brute_components(fps)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_survivors_do_not_depend_on_the_order_and_repeated_ids_lose_no_text(spark):
    docs = docs_of(spark, [*ODD, prose(300, 2), prose(300, 3)])
    other = spark.createDataFrame([(9, prose(300, 4), "en", "s", "", ""), (10, None, "en", "s", "", ""), (None, prose(300, 2), "en", "s", "", ""), (None, None, "en", "s", "", "")], DOCS)
    rows = docs.unionByName(docs).unionByName(other)
    kept = near_copies.one_of_each(rows)
    assert kept.columns == docs.columns
    found = sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in kept.collect())
    texts = [*ODD, prose(300, 2), prose(300, 3)]
    want = [(0, ""), (3, "a"), (4, ODD[4]), (6, ODD[6]), (7, ODD[7]), (9, texts[9]), (10, texts[10]), (9, prose(300, 4)), (-1, prose(300, 2)), (-1, "")]
    assert found == sorted(want)
    again = near_copies.one_of_each(rows.orderBy(F.desc("text"), "doc_id"))
    assert sorted(map(str, again.collect())) == sorted(map(str, kept.collect()))
    assert near_copies.one_of_each(docs.limit(0)).count() == 0
    assert simhash.near_duplicates(rows).filter("doc_id is null").count() == 2


@pytest.mark.parametrize("hot", [1, 4, 1000])
def test_hot_and_other_fingerprints_get_their_components(spark, hot):
    fps = [5] * 40 + [7] * 3 + list(range(100, 140))
    marked = spark.createDataFrame([(k, f) for k, f in enumerate(fps)], "doc_id long, fp long")
    by_fp = marked.groupBy("fp").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    rows = sorted(tuple(r) for r in simhash.with_components(marked, by_fp, hot).collect())
    assert rows == [(k, f, fps.index(f)) for k, f in enumerate(fps)]


def test_additive_model_learns_main_effects_and_pairs():
    rng = np.random.default_rng(3)
    x = rng.uniform(-1, 1, (3000, len(quality.FEATURES)))
    y = ((x[:, 0] * x[:, 1] > 0) & (x[:, 2] > -0.5)).astype(float)
    model = quality.fit_table(x[:2000], y[:2000])
    assert (((model.score(x[2000:]) > 0.5) == y[2000:]).mean()) > 0.93
    assert quality.fit_table(x[:5], np.ones(5)).score(x).min() > 0.5


def brute_tree(g, h, leaves, least):
    """Values by bin of the tree that ``_tree`` grows, every cut of every part tried each time."""
    worth = lambda a, b: sum(g[a:b]) ** 2 / (sum(h[a:b]) + 1)
    parts = [(0, len(g))]
    while len(parts) < leaves:
        cuts = [(worth(a, k) + worth(k, b) - worth(a, b), (a, b), k) for a, b in parts for k in range(a + 1, b) if sum(h[a:k]) >= least and sum(h[k:b]) >= least]
        if not cuts or max(c[0] for c in cuts) <= 1e-9:
            break
        _, (a, b), k = max(cuts)
        parts.remove((a, b))
        parts += [(a, k), (k, b)]
    out = [0.0] * len(g)
    for a, b in parts:
        out[a:b] = [sum(g[a:b]) / (sum(h[a:b]) + 1)] * (b - a)
    return out


def test_trees_pair_tables_and_scores_equal_plain_ones():
    rng = np.random.default_rng(6)
    for _ in range(20):
        g, h = rng.normal(0, 3, 12), rng.uniform(0.5, 3, 12)
        assert quality._tree(g, h, 4, 2.0) == pytest.approx(brute_tree(g.tolist(), h.tolist(), 4, 2.0))
        g, h = rng.normal(0, 3, (5, 4)), rng.uniform(0.5, 3, (5, 4))
        tables = []
        for k in range(1, 5):
            sides = [brute_tree(a.sum(axis=0).tolist(), b.sum(axis=0).tolist(), 2, 2.0) for a, b in ((g[:k], h[:k]), (g[k:], h[k:]))]
            table = np.array([sides[0]] * k + [sides[1]] * (5 - k))
            tables.append((float((table * g).sum()), table))
        assert quality._quadrants(g, h, 2.0) == pytest.approx(max(tables, key=lambda t: t[0])[1])
    x = rng.uniform(-1, 1, (300, len(quality.FEATURES)))
    model = quality.fit_table(x, (x[:, 0] * x[:, 3] > 0).astype(float), rounds=5, pair_rounds=5)
    for row, score in zip(x[:50], model.score(x[:50]), strict=True):
        total = model.intercept + sum(t[bisect.bisect_right(e.tolist(), v)] for v, e, t in zip(row, model.edges, model.tables, strict=True))
        total += sum(t[bisect.bisect_right(model.coarse[i].tolist(), row[i]), bisect.bisect_right(model.coarse[j].tolist(), row[j])] for i, j, t in model.pairs)
        assert score == pytest.approx(1 / (1 + np.exp(-total)))


def test_operators_on_empty_tables_and_repeated_rows(spark):
    docs = docs_of(spark, ODD)
    twice, none = docs.unionByName(docs), docs.limit(0)
    labels = spark.createDataFrame([(k, k % 2) for k in range(9)], "doc_id long, quality int")
    model = quality.fit(twice, labels)
    tokens, words = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    rules = [("block", "net", "/")]
    for work in (lambda d: quality.score(d, model), lambda d: token_counts.count_tokens(d, tokens), lambda d: packing.pack(d, words, keep_ids=True).drop("sequence_id", "offset")):
        rows = sorted(map(str, work(docs).collect()))
        assert sorted(map(str, work(twice).collect())) == sorted(rows * 2) and work(none).count() == 0
    judged = sorted(map(str, url_rules.judge_urls(pages, rules).collect()))
    assert sorted(map(str, url_rules.judge_urls(pages.unionByName(pages), rules).collect())) == sorted(judged * 2)
    assert url_rules.judge_urls(pages.limit(0), rules).count() == 0


def test_a_tokenizer_whose_words_do_not_stand_alone_is_refused():
    with pytest.raises(ValueError, match="one by one"):
        packing.WordTokenizer(public_tokenizers.path("byte_bpe_50k.json"))


def test_quality_held_out_accuracy_and_odd_rows(spark):
    good = [prose(60, k) for k in range(150)]
    bad = [" ".join(f"{w.upper()}!!" for w in prose(60, k).split()) for k in range(150)]
    docs, n = docs_of(spark, good + bad + ODD), len(good)
    labels = spark.createDataFrame([(k, int(k < n)) for k in range(300)] + [(5, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    rows = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    held = [k for k in range(300) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all((rows[k] >= 0.3) == (k < n) for k in held) and len(rows) == 300 + len(ODD)
    twice = docs.unionByName(docs.withColumn("text", F.lit("x")))  # an id with two texts gives the same model in any order
    assert (quality.fit(twice, labels).score(np.eye(16)) == quality.fit(twice.orderBy(F.desc("doc_id"), "text"), labels).score(np.eye(16))).all()
    assert {r.doc_id for r in quality.keep_good(docs, model).collect()} == {k for k, s in rows.items() if s >= 0.3}
    assert quality.fit(docs.limit(0), labels).score(np.zeros((1, len(quality.FEATURES)))).shape == (1,)


def test_packing_round_trip_and_sequence_count(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = [*ODD, *(prose(n, n) for n in range(1, 60)), prose(9000, 5), "A<|endoftext|>b <|ENDOFTEXT|>", "ÉCOLE, Straße. don't ...!! x,y İ ΣΑΣ."]
    rows = packing.pack(docs_of(spark, texts), path, capacity=256, keep_ids=True).collect()
    ids = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        assert r.start == len(ids.get(r.doc_id, [])) and r.length == len(r.ids) <= 256
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        ids.setdefault(r.doc_id, []).extend(r.ids)
    assert ids == {k: library.encode(t or "", add_special_tokens=False).ids + [1] for k, t in enumerate(texts)}
    at = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 256
    gaps, n = [], 0
    for s in sorted((r.length for r in rows), reverse=True):  # best-fit decreasing, one after another
        i = bisect.bisect_left(gaps, s)
        n += i == len(gaps)
        bisect.insort(gaps, (gaps.pop(i) if i < len(gaps) else 256) - s)
    assert len(at) <= n + 1
    assert packing.pack(docs_of(spark, []), path).count() == 0
    few = packing.pack(docs_of(spark, texts), path, capacity=256, salts=2).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in few) == sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert len({r.sequence_id for r in few}) == len(at)
