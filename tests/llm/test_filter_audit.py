import random
import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from spokeworks.llm import filter_audit

DOCS = "doc_id long, text string, source string, mask string, n string"


def fails(rows):
    """The letters that each row fails, by a plain check of all rows."""
    for i, text, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        bad = {"A"} if len(words) < 50 else set()
        bad |= {"B"} if 100 * len(set(words)) < 65 * len(words) else set()
        bad |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text) else set()
        bad |= {"D"} if re.search(r"[#$%&*|]", text) else set()
        bad |= {"E"} if i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows) else set()
        yield bad


def brute(rows, labels):
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    out, marks = {}, list(zip(rows, fails(rows), strict=True))
    for part in {s or "" for _, _, s in rows}:
        own = [(i, bad) for (i, _, s), bad in marks if (s or "") == part]
        sums = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for k, x in enumerate(order):
                gone, before = [d for d in left if x in d[1]], left
                left = [d for d in left if x not in d[1]]
                sums[x] += len(gone)
                redundant = sum(x in bad for _, bad in own) - sum(x in bad for _, bad in before)
                out[part, "".join(order), k + 1] = [len(left), len(gone), redundant, sum(bad == {x} for _, bad in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(sums[order[step - 1]])
    return out


def documents(seed, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé漢", k=4)) for _ in range(80)] + ["UPPER", "WORDS", "a#b", "x y", " "]
    texts = [" ".join(rng.choices(words[: rng.choice((8, 60, 85))], k=rng.choice((3, 49, 50, 90)))) for _ in range(n // 2)] + [None, "", " \t\x0b\n", "A" * 3, "|"]
    return [(rng.choice((k, k, k, 3, None)), rng.choice(texts), rng.choice(("s", "t", None, ""))) for k in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_audit_equals_a_run_of_every_order(spark, seed):
    rows = documents(seed)
    rng = random.Random(seed)
    labels = [(rng.choice((k, None, 3)), rng.choice((0, 1, None)), rng.choice((0, 1, None))) for k in range(60)]
    labels = [x for x in labels if x[0] is not None] + [(None, 1, 1)]
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in rows], DOCS)
    out = filter_audit.audit(filter_audit.cells(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    found = {(r.part, r.filter_order, r.step): list(r[3:]) for r in out.collect()}
    assert found == brute(rows, labels) and out.count() == len(found)


def test_copies_in_large_groups_and_long_texts(spark):
    long = "word Word other% " * 200_000
    rows = [(k, long if k % 50 == 7 else "the same text", "s") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    cells = {r.mask: r.n for r in filter_audit.cells(docs, none).collect()}
    assert cells == {1: 1, 17: 391, 2 + 4 + 8: 1, 2 + 4 + 8 + 16: 7}


def test_empty_tables_give_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert filter_audit.audit(filter_audit.cells(none, spark.createDataFrame([], "doc_id long, quality int, toxic int"))).count() == 0


def test_prefixes_of_fewer_letters_and_refused_ones(spark):
    masks = spark.range(8).select(F.col("id").alias("mask"))
    rows = filter_audit.steps(masks, "XYZ").collect()
    assert len(rows) == 8 * (3 + 6 + 6) and {r.prefix for r in rows if r.step == 3} == {"".join(p) for p in permutations("XYZ")}
    for letters in ("", "AA", "ABCDEFGH"):
        with pytest.raises(ValueError):
            filter_audit.steps(masks, letters)
