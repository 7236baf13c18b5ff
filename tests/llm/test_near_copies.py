import random

import pytest

from spokeworks.llm import metric_join, near_copies

WORDS = [f"w{k}" for k in range(3000)]


def edited(words, n, rng):
    out = list(words)
    for k in rng.sample(range(len(out)), n):
        out[k] = rng.choice(WORDS)
    return out


def groups_of(texts, percent=80):
    """The group of each text, named by its first, by a comparison of all pairs of sets."""
    sets = [set(metric_join.shingles(t, 5).tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = 0
    for i in range(len(texts)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if sets[i] == sets[j] or same and 100 * same >= percent * (len(sets[i]) + len(sets[j]) - same):
                pairs += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))], pairs


def kept_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumnRenamed("doc_id", "i").selectExpr("i as doc_id", "text", "'x' as fp", "1 as n", "'x' as bits", "'x' as __id")
    return {r.doc_id for r in near_copies.one_of_each(docs).collect()}


def corpus(seed, copies=8):
    """Near copies of texts of many lengths at similarities around 0.8, and unrelated texts."""
    rng, out = random.Random(seed), []
    for n in (8, 12, 20, 40, 66, 70, 90, 300, 600):
        base = rng.choices(WORDS, k=n)
        out += [base] + [edited(base, min(n // 2, rng.choice([0, 1, 1, max(1, n // 80), n // 50, n // 30, n // 15])), rng) for _ in range(copies)]
        out += [base + rng.choices(WORDS, k=max(1, n // 9)), base[: -max(1, n // 7)]]
    out += [rng.choices(WORDS, k=rng.randrange(1, 120)) for _ in range(60)]
    rng.shuffle(out)
    return [" ".join(x) for x in out]


@pytest.mark.parametrize("small", [False, True])
def test_survivors_are_those_of_true_similarity(spark, small, monkeypatch):
    if small:  # large blocks, regions of few members and hot keys everywhere
        for module, name, value in ((near_copies, "LARGEST", 2), (metric_join, "LARGEST", 3), (metric_join, "TILE", 2), (metric_join, "LARGE", 2), (metric_join, "DEALT", 0), (metric_join, "HOT", 20)):
            monkeypatch.setattr(module, name, value)
    texts = corpus(11 if small else 12)
    group, pairs = groups_of(texts)
    first = set(group)
    kept = kept_of(spark, texts)
    gone = set(range(len(texts))) - first
    assert pairs > 150 and kept >= first, "no text goes that isn't a near copy of one that stays"
    assert len(gone - kept) >= 0.9 * len(gone)


def test_unrelated_short_texts_all_stay(spark):
    rng = random.Random(5)
    texts = list({" ".join(rng.choices(WORDS, k=rng.randrange(5, 8))) for _ in range(20_000)})
    assert len(kept_of(spark, texts)) == len(texts)


def test_a_large_group_of_filled_in_forms_leaves_one(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "LARGEST", 30)
    made = []
    rest_links = metric_join.rest_links

    def counted(sets, bins, keys, percent):
        made.append(keys.select("fp").distinct().count())
        return rest_links(sets, bins, keys, percent)

    monkeypatch.setattr(metric_join, "rest_links", counted)
    rng = random.Random(6)
    base = rng.choices(WORDS, k=400)
    texts = [" ".join(edited(base, 3, rng)) for _ in range(300)] + [" ".join(rng.choices(WORDS, k=100)) for _ in range(40)]
    assert kept_of(spark, texts) == {0, *range(300, 340)}
    assert made == [m for m in made if m < 60], "members of the region meet its pivot only"
