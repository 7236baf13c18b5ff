"""Filter interaction audit: what each filter removes at each place of every order of the filters.

Every document gets a mask of the filters that it fails; documents of one part and mask are one cell.
A recursive query extends prefixes of filters by each letter that they don't hold yet, joins them with
the mask cells, carries the bits applied so far and tells at each level what that step does to a cell.
The orders of f filters have 1 + f + f(f-1) + ... prefixes, 326 for five, so the query's size depends on
the filters alone; the rows of a part are its cells' counts, summed over what the query tells of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table, text_of

MOST_FILTERS = 7
WORDS = r"[^\x20\x09-\x0D]+"
METRICS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions by letter: A few words, B repetitive, C much in capitals, D holds marks. The empty text fails A alone."""
    words = F.regexp_extract_all(text, F.lit(f"({WORDS})"), F.lit(1))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    return {
        "A": n < 50,
        "B": 100 * distinct.cast("long") < 65 * n.cast("long"),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 5 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def copies(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, digest and others) with ``copy``: whether a row of a smaller doc_id has the same digest.

    The smallest id of each text is aggregated before the shuffle and meets the rows by text and id, so
    that a group of copies, however large, never meets in one task. Rows without doc_id are no copies.
    """
    known = rows.filter("doc_id is not null")
    first = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("copy", F.lit(False))
    found = known.join(first, ["digest", "doc_id"], "left").withColumn("copy", F.coalesce("copy", F.lit(True)))
    return found.unionByName(rows.filter("doc_id is null").withColumn("copy", F.lit(False)))


def cells(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "source") -> DataFrame:
    """part string, mask long, n, good, toxic long: documents by part and failed filters, bit k for the k-th letter of ABCDE.

    E fails for a text that any smaller doc_id of the whole table has, too. Repeated rows count each; a
    document is good or toxic if any of its labels says so. Null texts and parts count as empty, rows
    without doc_id have no labels; an empty table has no cells.
    """
    whole = text_of(text)
    bits = reduce(lambda a, b: a + b, (c.cast("long") * (1 << k) for k, c in enumerate(text_filters(whole).values())))
    base = docs.select(F.col(doc_id).alias("doc_id"), text_of(part).alias("part"), F.unhex(F.sha2(whole.cast("binary"), 256)).alias("digest"), bits.alias("mask"))
    base = base.groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))
    said = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    base = table(base)
    with_id = base.filter("doc_id is not null").join(said, "doc_id", "left").fillna(False, ["good", "toxic"])
    marked = copies(table(with_id.unionByName(base.filter("doc_id is null").withColumns({"good": F.lit(False), "toxic": F.lit(False)}))))
    count = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    mask = F.when(F.col("copy"), F.col("mask") + 16).otherwise(F.col("mask"))
    return marked.groupBy("part", mask.alias("mask")).agg(F.sum("n").alias("n"), count("good"), count("toxic"))


def steps(masks: DataFrame, letters: str) -> DataFrame:
    """prefix, step, letter, mask, kept, removed, redundant, unique_fails (0 or 1) for every prefix of an order and every mask of ``masks``.

    Bit k of a mask is the k-th letter's.
    """
    if not 0 < len(set(letters)) == len(letters) <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} different letters")
    named = ", ".join(f"('{letter}', {1 << k}L)" for k, letter in enumerate(letters))
    return masks.sparkSession.sql(
        f"""
with recursive letters(letter, bit) as (values {named}),
steps(prefix, step, letter, mask, applied, kept, removed, redundant, unique_fails) as (
  select '', 0, '', mask, 0L, 1, 0, 0, 0 from {{masks}}
  union all
  select s.prefix || l.letter, s.step + 1, l.letter, c.mask, s.applied | l.bit,
         int(c.mask & (s.applied | l.bit) = 0),
         int(c.mask & s.applied = 0 and c.mask & l.bit <> 0),
         int(c.mask & s.applied <> 0 and c.mask & l.bit <> 0),
         int(c.mask = l.bit)
  from steps s join letters l on s.applied & l.bit = 0 join {{masks}} c on c.mask = s.mask)
select prefix, step, letter, mask, kept, removed, redundant, unique_fails from steps where step > 0""",
        masks=masks,
    )


def audit(found: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """Of ``found`` (part, mask, n, good, toxic), a row for each part, order of the letters and step, zeros included.

    part, filter_order string, step int, and as long: kept after the step, removed by it, redundant
    (failing it, but removed before), unique_fails (failing no other filter), good_lost and toxic_lost
    of those removed, and shapley: what the step's filter removes, summed over all orders.
    """
    found = cut(found)
    each = F.broadcast(cut(steps(found.select("mask").distinct(), letters)))  # at most 2^f masks times the prefixes of f letters
    total = lambda name, n, on=None: F.sum(F.col(n) * F.col(on or name)).cast("long").alias(name)
    by_prefix = found.join(each, "mask").groupBy("part", "prefix", "step", "letter").agg(
        *(total(m, "n") for m in METRICS[:4]), total("good_lost", "good", "removed"), total("toxic_lost", "toxic", "removed")
    )
    orders = each.filter(F.col("step") == len(letters)).select(F.col("prefix").alias("filter_order")).distinct()
    orders = orders.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(len(letters))))).withColumn("prefix", F.expr("substring(filter_order, 1, k)")).drop("k")
    rows = by_prefix.join(F.broadcast(orders), "prefix")
    removed = F.sum("removed").over(Window.partitionBy("part", "letter"))  # one row an order
    return rows.withColumn("shapley", removed.cast("long")).select("part", "filter_order", F.col("step").cast("int").alias("step"), *METRICS, "shapley")
