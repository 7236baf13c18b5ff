"""Quality rules: heuristics on words and lines, and bands of n-gram perplexity for each language.

The language model is a modified Kneser-Ney model of character 5-grams, characters as they are. Spark
counts them over all documents and derives continuation counts, discounts, probabilities and back-off
weights by groupings and joins, so the model grows with the corpus. Texts are dealt to two folds by
their hash; a text is judged by the model of the other fold, so neither it nor its copies speak for
it. A model is stored as sorted arrays of 64-bit hashes; beyond MOST_ENTRIES only the most frequent
n-grams are broadcast and the texts' other n-grams get their probabilities by joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, from_batches, over_batches, table, text_of

ORDER = 5
LANGUAGES = ("en", "de", "fr", "es")
OTHER = "other"
FOLDS = 2
#: Entries of all models that are broadcast at most, 12 bytes each.
MOST_ENTRIES = 6_000_000
#: Characters whose n-grams are counted, or looked up, together (about 60 bytes each in a Python worker); no result depends on them.
BLOCK = 2_000_000
LOOKED_UP = 1_500_000
#: Characters whose n-grams are told apart by text together (about 100 bytes each).
TOLD_APART = 500_000
WHITE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Perplexities are gathered in steps of this many nats a word.
STEP = 0.005


def codes_of(text: str) -> np.ndarray:
    """Code points; NUL as U+FFFD, since text arrays end at it."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    return np.where(codes == 0, 0xFFFD, codes)


def hashes(codes: np.ndarray) -> np.ndarray:
    """64-bit hashes of the rows of code points; rows of different length never share one by being equal."""
    h = np.full(len(codes), codes.shape[1], np.uint64)
    for k in range(codes.shape[1]):
        h = (h ^ codes[:, k].astype(np.uint64)) * MIX
        h ^= h >> np.uint64(29)
    return h


@dataclass(frozen=True)
class Grams:
    """The n-grams that end at the characters of some texts: the distinct ones, which of them each character ends, and the texts' ends."""

    codes: np.ndarray
    at: np.ndarray
    ends: np.ndarray

    def counts(self) -> np.ndarray:
        return np.bincount(self.at, minlength=len(self.codes))

    def texts(self) -> list[str]:
        return np.ascontiguousarray(self.codes, "<u4").view(f"<U{self.codes.shape[1]}").ravel().tolist()


def grams_of(texts: list[str], order: int = ORDER) -> Grams:
    """Texts are preceded by spaces, which end no n-gram themselves."""
    pad = np.full(order - 1, 32, np.uint32)
    own = [codes_of(t) for t in texts]
    lengths = np.array([len(c) for c in own], np.int64)
    codes = np.concatenate([x for c in own for x in (pad, c)] or [pad])
    real = np.repeat(np.tile([False, True], len(own)), np.stack([np.full(len(own), order - 1), lengths], axis=1).ravel())
    letters = np.zeros(int(codes.max()) + 1, bool)
    letters[codes] = True
    digits, size = (np.cumsum(letters) - 1).astype(np.int32)[codes], int(letters.sum())
    key, range_ = digits.astype(np.int64), size
    for k in range(1, order):
        if range_ * size >= 1 << 62:
            values, key = np.unique(key, return_inverse=True)
            range_ = len(values)
        key = key[:-1] * size + digits[k:]
        range_ *= size
    ends = np.flatnonzero(real)
    key = key[ends - (order - 1)]
    distinct = np.unique(key)
    at = np.searchsorted(distinct, key)
    sample = np.zeros(len(distinct), np.int64)
    sample[at] = ends  # some place of each
    rows = codes[sample[:, None] + np.arange(1 - order, 1)] if len(distinct) else np.zeros((0, order), np.uint32)
    return Grams(rows, at, np.cumsum(lengths))


def blocks(texts: list[str], most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters, one text at least."""
    start = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, k
            start, size = k, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def language(column: str, languages: tuple[str, ...]) -> Column:
    return F.when(F.col(column).isin(*languages), F.col(column)).otherwise(F.lit(OTHER))


def fold(text: Column) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(FOLDS)).cast("int")


def model_of(lang: Column, number: Column, languages: tuple[str, ...]) -> Column:
    """The number of the model that judges the texts of a language and fold."""
    named = F.coalesce(*(F.when(lang == x, F.lit(k)) for k, x in enumerate(languages)), F.lit(len(languages)))
    return (named * FOLDS + number).cast("int")


def joined_partitions(docs: DataFrame) -> DataFrame:
    """``docs`` in fewer partitions if they are small, without a shuffle, so that a task's n-grams are worth their shuffle."""
    return docs.coalesce(max(2 * docs.sparkSession.sparkContext.defaultParallelism, docs.count() // 20_000))


def count_ngrams(docs: DataFrame, languages: tuple[str, ...] = LANGUAGES, text: str = "text", lang: str = "lang", order: int = ORDER) -> DataFrame:
    """n-gram counts over whole texts: model int (``model_of`` the texts that it judges), gram string, n long.

    Languages that aren't named, null among them, are counted together. Null and empty texts count nothing.
    """

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for name in sorted(set(names)):
            own = [t for t, x in zip(texts, names, strict=True) if x == name]
            for a, b in blocks(own):
                grams = grams_of(own[a:b], order)
                if len(grams.codes):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams.codes), name, np.int32)), pa.array(grams.texts()), pa.array(grams.counts())], ["model", "gram", "n"])

    judged = model_of(language(lang, languages), (fold(text_of(text)) + 1) % FOLDS, languages)
    parts = from_batches(joined_partitions(docs), [judged, text_of(text)], work, "model int, gram string, n long")
    return parts.groupBy("model", "gram").agg(F.sum("n").alias("n"))


def discounts(counts: DataFrame) -> DataFrame:
    """model, d1, d2, d3: the discounts of counts 1, 2 and 3 or more; fixed ones where the counts of counts give none."""
    n = [F.count_if(F.col("n") == k) for k in (1, 2, 3, 4)]
    rows = counts.groupBy("model").agg(*(x.alias(f"n{k}") for k, x in enumerate(n, 1)))
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    d = [F.lit(k) - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}") for k in (1, 2, 3)]
    whole = reduce(lambda a, b: a & b, [F.col(f"n{k}") > 0 for k in (1, 2, 3, 4)])
    fits = reduce(lambda a, b: a & b, [(x > 0) & (x < k) for k, x in enumerate(d, 1)])
    kept = F.when(whole, F.coalesce(fits, F.lit(False))).otherwise(F.lit(False))
    return rows.select("model", *(F.when(kept, F.when(whole, x)).otherwise(F.lit(0.5 * k)).alias(f"d{k}") for k, x in enumerate(d, 1)))


def kneser_ney(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """The models of ``count_ngrams`` rows: model, kind, gram, value.

    kind p: log probability of an n-gram's last character after the others (gram '' stands for any
    character not seen); kind b: log back-off weight of a context.
    """
    by_order = [table(counts)]
    for _ in range(order - 1):  # below the highest order: in how many contexts an n-gram ends
        by_order.insert(0, table(by_order[0].groupBy("model", F.expr("substring(gram, 2)").alias("gram")).agg(F.count(F.lit(1)).alias("n"))))
    letters = by_order[0].groupBy("model").agg((1 / (F.count(F.lit(1)) + 1)).alias("below"))
    out, below = None, None
    for k, c in enumerate(by_order, 1):
        cost = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        spent = c.join(F.broadcast(discounts(c)), "model").withColumn("cost", cost).withColumn("context", F.expr("substring(gram, 1, char_length(gram) - 1)")).drop("d1", "d2", "d3")
        weights = spent.groupBy("model", "context").agg(F.sum("n").alias("total"), F.sum("cost").alias("spent")).select("model", "context", "total", (F.col("spent") / F.col("total")).alias("gamma"))
        weights = table(weights)
        rows = spent.join(weights, ["model", "context"])
        if k == 1:
            rows = rows.join(letters, "model")
            unseen = weights.join(letters, "model").select("model", F.lit("").alias("gram"), (F.col("gamma") * F.col("below")).alias("p"))
        else:
            rows = rows.withColumn("suffix", F.expr("substring(gram, 2)")).join(below.select("model", F.col("gram").alias("suffix"), F.col("p").alias("below")), ["model", "suffix"])
        p = rows.select("model", "gram", ((F.col("n") - F.col("cost")) / F.col("total") + F.col("gamma") * F.col("below")).alias("p"))
        below = table(p.unionByName(unseen) if k == 1 else p)
        entries = below.select("model", F.lit("p").alias("kind"), "gram", F.log("p").alias("value"))
        if k > 1:
            entries = entries.unionByName(weights.select("model", F.lit("b").alias("kind"), F.col("context").alias("gram"), F.log("gamma").alias("value")))
        out = entries if out is None else out.unionByName(entries)
    return out


@dataclass(frozen=True)
class HashedModel:
    """By kind and order: sorted hashes and the values that belong to them."""

    tables: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]
    order: int

    def find(self, kind: str, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of n-grams, and which of them are known."""
        keys, values = self.tables.get((kind, codes.shape[1]), (np.zeros(0, np.uint64), np.zeros(0, np.float32)))
        if not len(keys):
            return np.zeros(len(codes), np.float32), np.zeros(len(codes), bool)
        h = hashes(codes)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return values[at], keys[at] == h

    def log_p(self, codes: np.ndarray) -> np.ndarray:
        """Log probability of each row's last character after the others."""
        out, spent, going, n = np.zeros(len(codes)), np.zeros(len(codes)), np.arange(len(codes)), codes.shape[1]
        for k in range(n, 0, -1):
            value, known = self.find("p", codes[going, n - k :])
            out[going[known]] = spent[going[known]] + value[known]
            going = going[~known]
            if k > 1 and len(going):
                value, known = self.find("b", codes[going, n - k : n - 1])
                spent[going[known]] += value[known]
        unseen = self.tables.get(("p", 0), (None, np.zeros(1, np.float32)))[1][0]
        out[going] = spent[going] + unseen
        return out


def hashed(entries: DataFrame, order: int = ORDER) -> dict[int, HashedModel]:
    """The models as sorted arrays, from at most MOST_ENTRIES rows of ``kneser_ney``."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(2).to_pylist()
        sizes = np.array([len(t) for t in texts], np.int32)
        h = np.zeros(len(texts), np.uint64)
        for k in np.unique(sizes):
            own = np.flatnonzero(sizes == k)
            codes = np.frombuffer("".join(texts[i] for i in own).encode("utf-32-le"), "<u4").reshape(len(own), -1)
            h[own] = hashes(codes)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes), pa.array(h.view(np.int64)), batch.column(3).cast(pa.float32())], ["model", "kind", "size", "hash", "value"])

    rows = over_batches(entries, [F.col(c) for c in ("model", "kind", "gram", "value")], work, "model int, kind string, size int, hash long, value float")
    packed = rows.groupBy("model", "kind", "size").agg(F.sort_array(F.collect_list(F.struct("hash", "value"))).alias("rows")).select("model", "kind", "size", F.col("rows.hash").alias("hash"), F.col("rows.value").alias("value"))
    models: dict[int, dict] = {}
    for batch in packed.toArrow().to_batches():  # bounded by MOST_ENTRIES
        for i in range(batch.num_rows):
            model, kind, size = (batch.column(c)[i].as_py() for c in range(3))
            h, value = (batch.column(c)[i].values.to_numpy() for c in (3, 4))
            h = h.view(np.uint64)
            at = np.argsort(h)
            models.setdefault(model, {})[kind, size] = (h[at], value[at].astype(np.float32))
    return {name: HashedModel(tables, order) for name, tables in models.items()}


def repeated_words(words: list[bytes], window: int = 5) -> int:
    """How many words lie in windows of so many words that occur twice or more."""
    n = len(words)
    if n <= window:
        return 0
    ids: dict[bytes, int] = {}
    a = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    if len(ids) == n:
        return 0
    key, size = a[: n - window + 1], len(ids)
    for k in range(1, window):
        if size * len(ids) >= 1 << 62:
            values, key = np.unique(key, return_inverse=True)
            size = len(values)
        key = key * len(ids) + a[k : n - window + 1 + k]
        size *= len(ids)
    _, at, times = np.unique(key, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(times[at] > 1)
    edge = np.zeros(n + 1, np.int64)
    edge[twice] += 1
    edge[twice + window] -= 1
    return int((np.cumsum(edge) > 0).sum())


def rule_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip(WHITE)]
    white = len(raw) - len(raw.translate(None, WHITE))
    marks = len(raw) - len(raw.translate(None, SYMBOLS))
    return len(words), len(text) - white, marks, len(lines) - len(set(lines)), repeated_words(words)


def rules_of(docs: DataFrame, languages: tuple[str, ...] = LANGUAGES, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", models: dict[int, HashedModel] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang, the rule counts, n_chars, model, text_hash, nll (nats over the whole text, 0 without ``models``)."""
    shared = docs.sparkSession.sparkContext.broadcast(models or {})

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, texts = batch.column(2).to_pylist(), batch.column(4).to_pylist()
        nll = np.zeros(len(texts))
        for name in set(names) & shared.value.keys():
            at = np.array([i for i, x in enumerate(names) if x == name])
            own = [texts[i] for i in at]
            for a, b in blocks(own, LOOKED_UP):
                grams = grams_of(own[a:b])
                sums = np.concatenate([[0.0], np.cumsum(shared.value[name].log_p(grams.codes)[grams.at])])
                nll[at[a:b]] = sums[np.concatenate([[0], grams.ends[:-1]])] - sums[grams.ends]
        rules = np.array([rule_counts(t) for t in texts], np.int64).T
        size = pa.array([len(t) for t in texts], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, rules), size, batch.column(2), batch.column(3), pa.array(nll)], NAMES)

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, lang string, " + "".join(f"{c} long, " for c in NAMES[2:8]) + "model int, text_hash long, nll double"
    own = language(lang, languages)
    return over_batches(docs, [F.col(doc_id), own, model_of(own, fold(text_of(text)), languages), F.xxhash64(text_of(text)), text_of(text)], work, schema)


NAMES = ["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "model", "text_hash", "nll"]


def log_p_by_joins(grams: DataFrame, entries: DataFrame, order: int = ORDER) -> DataFrame:
    """model, gram, log_p of distinct n-grams by joins with ``kneser_ney`` rows, however many these are."""
    values = lambda kind, name, value: entries.filter(F.col("kind") == kind).select("model", F.col("gram").alias(name), F.col("value").alias(value))
    rows = grams.select("model", "gram").withColumns({"log_p": F.lit(None).cast("double"), "spent": F.lit(0.0)})
    for k in range(order, 0, -1):
        rows = rows.withColumns({"part": F.expr(f"substring(gram, {order - k + 1})"), "context": F.expr(f"substring(gram, {order - k + 1}, {k - 1})")})
        rows = rows.join(values("p", "part", "value"), ["model", "part"], "left")
        rows = rows.withColumn("log_p", F.coalesce("log_p", F.col("spent") + F.col("value"))).drop("value")
        if k > 1:
            rows = rows.join(values("b", "context", "value"), ["model", "context"], "left")
            rows = rows.withColumn("spent", F.col("spent") + F.coalesce("value", F.lit(0.0))).drop("value")
        rows = cut(rows.select("model", "gram", "log_p", "spent"))
    rows = rows.join(F.broadcast(values("p", "part", "value").filter("part = ''")), "model", "left")
    return rows.select("model", "gram", F.coalesce("log_p", F.col("spent") + F.coalesce("value", F.lit(0.0))).alias("log_p"))


def told_apart(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, Grams, np.ndarray, np.ndarray, np.ndarray]]:
    """Of a batch (model, text_hash, text), by blocks of texts of one model: the model, the texts' hashes, their n-grams, and which text holds which n-gram how often."""
    names, texts, h = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(1).to_numpy()
    for name in sorted(set(names)):
        at = np.array([i for i, x in enumerate(names) if x == name])
        own = [texts[i] for i in at]
        for a, b in blocks(own, TOLD_APART):
            grams = grams_of(own[a:b])
            if n := len(grams.codes):
                text = np.repeat(np.arange(b - a), np.diff(grams.ends, prepend=0))
                key, times = np.unique(text * n + grams.at, return_counts=True)
                yield name, h[at[a:b]], grams, key // n, key % n, times


def hot(asked: DataFrame, most: int) -> DataFrame:
    """Of n-grams with the number of texts that hold them, those held by most, at most ``most``: model, gram.

    They are cut off between eighths of powers of two of that number, which are counted first, so nothing is sorted.
    """
    step = F.floor(8 * F.log2("texts")).cast("int")
    sizes, least, n = sorted(map(tuple, asked.groupBy(step.alias("step")).count().collect()), reverse=True), None, 0
    for k, own in sizes:
        if (n := n + own) > most:
            break
        least = k
    return asked.filter(F.lit(False) if least is None else step >= least).select("model", "gram")


def scored_by_joins(docs: DataFrame, entries: DataFrame, frequent: int, languages: tuple[str, ...] = LANGUAGES, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """As ``rules_of`` with models of any size: the texts' distinct n-grams get their probabilities by joins.

    frequent: of the n-grams, how many are broadcast at most, those that most texts hold; no key of the
    shuffled rest is hot then.
    """

    def by_text(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for name, h, grams, text, gram, times in told_apart(batch):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(text), name, np.int32)), pa.array(h[text]), pa.array(grams.texts()).take(pa.array(gram)), pa.array(times)], ["model", "text_hash", "gram", "n"])

    def in_all(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for name, _, grams, _, gram, _ in told_apart(batch):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams.codes), name, np.int32)), pa.array(grams.texts()), pa.array(np.bincount(gram, minlength=len(grams.codes)))], ["model", "gram", "texts"])

    base = rules_of(docs, languages, text, lang, doc_id)
    named = model_of(language(lang, languages), fold(text_of(text)), languages)
    inputs = [named, F.xxhash64(text_of(text)), text_of(text)]
    held = from_batches(docs, inputs, by_text, "model int, text_hash long, gram string, n long")
    asked = cut(from_batches(docs, inputs, in_all, "model int, gram string, texts long").groupBy("model", "gram").agg(F.sum("texts").alias("texts")))
    logs = cut(log_p_by_joins(asked, entries))
    common = F.broadcast(logs.join(F.broadcast(hot(asked, frequent)), ["model", "gram"], "left_semi").withColumn("often", F.lit(True)))
    near = held.join(common, ["model", "gram"], "left")
    far = near.filter("often is null").drop("log_p", "often").join(logs, ["model", "gram"])
    both = near.filter("often").select("model", "text_hash", "n", "log_p").unionByName(far.select("model", "text_hash", "n", "log_p"))
    # rows that share a text share its n-grams, so the sum over them is divided by their number
    sums = both.groupBy("model", "text_hash").agg(F.sum(F.col("n") * F.col("log_p")).alias("sum"))
    rows = base.groupBy("model", "text_hash").agg(F.count(F.lit(1)).alias("rows"))
    nll = rows.join(sums, ["model", "text_hash"]).select("model", "text_hash", (-F.col("sum") / F.col("rows")).alias("nats"))
    return base.join(nll, ["model", "text_hash"], "left").withColumn("nll", F.coalesce("nats", F.lit(0.0))).select(*NAMES)


def score(docs: DataFrame, languages: tuple[str, ...] = LANGUAGES, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", most_entries: int = MOST_ENTRIES) -> DataFrame:
    """Count, fit and score: the rows of ``rules_of``. Null texts count as empty: zeros everywhere.

    Languages that aren't named share a model and a band. most_entries: of the models, broadcast at
    most; beyond them the same scores come by joins.
    """
    entries = kneser_ney(count_ngrams(docs, languages, text, lang))
    if entries.count() <= most_entries:
        return rules_of(docs, languages, text, lang, doc_id, hashed(entries))
    return scored_by_joins(docs, entries, most_entries // 8, languages, text, lang, doc_id)


def bands(scored: DataFrame) -> dict[str, tuple[float, float]]:
    """For each language the median nats a word over all documents with words, and the median distance from it.

    Gathered as a histogram in steps of STEP nats, whose size doesn't depend on the number of documents.
    """
    step = F.round(F.col("nll") / F.col("n_words") / STEP).cast("int")
    rows = scored.filter("n_words > 0").groupBy("lang", step.alias("step")).count().collect()
    out = {}
    for name in sorted({r["lang"] for r in rows}):
        at = np.array(sorted((r["step"], r["count"]) for r in rows if r["lang"] == name), np.int64)
        middle = _median(at[:, 0], at[:, 1])
        out[name] = (middle * STEP, _median(np.abs(at[:, 0] - middle), at[:, 1]) * STEP)
    return out


def _median(values: np.ndarray, weights: np.ndarray) -> int:
    order = np.argsort(values, kind="stable")
    total = np.cumsum(weights[order])
    return int(values[order][np.searchsorted(total, (total[-1] + 1) // 2)])


def judge(scored: DataFrame, band: dict[str, tuple[float, float]], lower: float = 4.2, upper: float = 7.0, noise: float = 2.0, least: float = 0.05) -> DataFrame:
    """``score`` rows with base_failed and kept.

    A document that passes the rules is kept if its nats a word lie in its language's band, from
    ``lower`` widths below the median to ``upper`` above. A width is the language's median distance
    (``least`` at least) plus ``noise`` / sqrt(words), as short texts vary more. band: as ``bands``
    gives it.
    """
    pick = lambda i: F.coalesce(F.create_map(*(F.lit(x) for k, v in band.items() for x in (k, float(v[i]))))[F.col("lang")], F.lit(0.0)) if band else F.lit(0.0)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    widths = (F.col("nll") / words - pick(0)) / (F.greatest(pick(1), F.lit(least)) + noise / F.sqrt(words))
    return scored.withColumns({"base_failed": failed, "kept": ~failed & widths.between(-lower, upper), "widths": widths})


def quality_rules(docs: DataFrame, languages: tuple[str, ...] = LANGUAGES, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", most_entries: int = MOST_ENTRIES) -> DataFrame:
    """Count, fit, score and judge: one row per row of ``docs``.

    Repeated rows give repeated rows and weigh in the counts each time; an empty table gives no rows.
    Null texts count as empty and fail the rules. Other columns are not read.
    """
    scored = cut(score(docs, languages, text, lang, doc_id, most_entries))
    return judge(scored, bands(scored))
