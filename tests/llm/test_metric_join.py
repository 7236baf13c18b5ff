import random
import re

import numpy as np
import pytest

from spokeworks.llm import metric_join

DOCS = "doc_id long, text string, fp string, n string, s string, key string"


def brute(rows, width=4, percent=85):
    """n_shingles and component_id of each row by a comparison of all pairs."""
    sets = []
    for _, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * same >= percent * (len(sets[i]) + len(sets[j]) - same):
                root[find(i)] = find(j)
    ids = {}
    for k, (i, _) in enumerate(rows):
        ids.setdefault(find(k), []).append(i)
    low = {r: min((i for i in x if i is not None), default=None) for r, x in ids.items()}
    return sorted(((i, len(sets[k]), low[find(k)]) for k, (i, _) in enumerate(rows)), key=str)


def check(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, "x", "x", "x", "x") for i, t in rows], DOCS)
    found = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in metric_join.jaccard_components(docs, **options).collect()), key=str)
    assert found == brute(rows, **options)
    return found


def corpus(seed, templates=6, copies=12, n=80, changes=(0, 1, 2, 3, 5)):
    """Near copies of templates, common passages in unrelated texts, and odd texts."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    make = lambda k: rng.choices(words, k=k)
    passage, out = make(60), []
    for _ in range(templates):
        base = make(rng.choice((n, n // 2, n * 3)))
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.choice(changes)):
                own[rng.randrange(len(own))] = rng.choice(words)
            out.append(own)
        for k in range(6):  # a chain: each a little longer than the one before
            out.append(base + make(3)[: k % 3] + base[: k * 2])
    out += [make(rng.randrange(5, 80)) + passage + make(rng.randrange(5, 80)) for _ in range(25)]
    out += [passage + make(k) for k in range(12)] + [make(k) for k in range(1, 14)]
    texts = [" ".join(w.upper() if rng.random() < 0.1 else w for w in x) for x in out] + [None, "", " \t\n", None, "a", "A", "a b c", "a b c d", "é 漢 a b c d e", "É 漢 a b c d e"]
    rng.shuffle(texts)
    return [(k, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1])
def test_components_equal_a_comparison_of_all_pairs(spark, seed):
    found = check(spark, corpus(seed))
    assert len({c for _, _, c in found}) < len(found) - 20


def test_small_tiles_shares_and_bitmaps_change_nothing(spark, monkeypatch):
    for name, value in (("TILE", 3), ("LARGEST", 3), ("SHARES", 3), ("HOT", 20), ("MOST_MARKED", 40), ("SLICE", 50), ("LARGE", 2), ("DEALT", 0), ("BLOCK", 40)):
        monkeypatch.setattr(metric_join, name, value)
    check(spark, corpus(4, templates=3, copies=25, changes=(3, 4, 5, 6, 7)))


@pytest.mark.parametrize(("width", "percent"), [(4, 60), (2, 100)])
def test_other_widths_and_similarities(spark, width, percent):
    check(spark, corpus(5, templates=3, copies=8, n=40), width=width, percent=percent)


def test_without_rounds_the_rest_meets_itself(spark, monkeypatch):
    links = metric_join.links
    monkeypatch.setattr(metric_join, "links", lambda sets, marked, percent: links(sets, marked, percent, rounds=0))
    check(spark, corpus(6, templates=3))


def test_large_groups_repeated_rows_null_ids_long_texts_and_empty_tables(spark):
    rng = random.Random(7)
    long = [f"w{rng.randrange(5000)}" for _ in range(60_000)]
    rows = [(k, "one and the same text in very many rows of it") for k in range(300)]
    rows += [(400, " ".join(long)), (401, " ".join(long[:-500])), (402, " ".join(long[30_000:])), (None, "one and the same text in very many rows"), (None, None), (None, "alone with no id and no copies at all here")]
    rows += [(403, "x y z"), (403, "x y z"), (403, "other words of the same id"), (9, "other words of the same id")]
    check(spark, rows)
    check(spark, [])
    check(spark, [(1, None), (2, "")])


def test_a_group_gives_a_forest_not_its_pairs(spark, monkeypatch):
    made = {}
    for name in ("possible_links", "group_links"):
        def counted(*args, name=name, real=getattr(metric_join, name)):
            out = real(*args)
            made[name] = out.count()
            return out

        monkeypatch.setattr(metric_join, name, counted)
    monkeypatch.setattr(metric_join, "TILE", 40)
    rng = random.Random(8)
    words = [f"w{k}" for k in range(3000)]
    base, texts = rng.choices(words, k=200), []
    for k in range(150):  # near and nearly near
        own = list(base)
        for at in rng.sample(range(200), 1 + k % 3):
            own[at] = rng.choice(words)
        texts.append(" ".join(own))
    rows = list(enumerate(texts)) + [(k, texts[k % 150] + " a few other words") for k in range(150, 170)]
    check(spark, rows)
    assert 0 < made["group_links"] < 1000 and made["possible_links"] < 170 * 30, "all pairs are 14,365"


@pytest.mark.parametrize("percent", [51, 70, 85, 99, 100])
def test_near_sets_share_a_first_shingle(percent):
    rng = np.random.default_rng(percent)
    for _ in range(400):
        union = rng.choice(10_000, rng.integers(1, 60), replace=False).astype(np.uint64) << np.uint64(40)
        cut_off = rng.integers(0, len(union) * (100 - percent) // 100 + 1)
        split = rng.integers(0, cut_off + 1)
        a, b = np.sort(union[split:]), np.sort(np.concatenate([union[:split], union[cut_off:]]))
        same = len(np.intersect1d(a, b))
        if not len(a) or not len(b) or 100 * same < percent * len(union) or same == len(union):
            continue
        marked = rng.integers(0, 1 << 63, 1 << 20, dtype=np.int64).view(np.uint64)
        for m in (None, marked):
            first = [set(metric_join.first_shingles(s, metric_join.prefix_length(len(s), percent), m).tolist()) for s in (a, b)]
            assert first[0] & first[1]
