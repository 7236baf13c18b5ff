"""Mixing sources to target weights by iterative proportional fitting.

Token weights by source, language and topic are raked until each marginal meets its target; every
document is then kept with the calibrated probability of its cell. Targets are given, or tempered:
each category's share of the tokens to a power.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .metric_join import dealt_join

#: Stands for all categories that have no target of their own, null among them; no value equals it.
REST = None
Targets = dict[str, dict[str | None, float]]
#: Cells whose probabilities are broadcast; more are joined.
MOST_CELLS = 100_000
#: Topics by words that speak of them, in text without regard to case; the topic with most of them wins, the first on ties.
TOPICS = {
    "software": ("licen[cs]ed?", "software", "source code", "api", "token", "password", "secret", "server", "version", "copyright"),
    "contact": (r"[\w.+-]+@[\w-]+\.\w+", r"\+?\d[\d() .-]{7,}\d", "phone", "e-?mail", "address"),
}
GENERAL = "general"


def n_words(text: Column) -> Column:
    """Tokens of a text, taken as words between ASCII white space; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def topic_of(text: Column, topics: dict[str, tuple[str, ...]] = TOPICS) -> Column:
    """The topic whose words the whole text holds most often; GENERAL without any, and for null."""
    found = [(name, F.regexp_count(F.coalesce(text, F.lit("")), F.lit(rf"(?i)(?<!\w)(?:{'|'.join(words)})(?!\w)"))) for name, words in topics.items()]
    best = F.greatest(*(n for _, n in found)) if len(found) > 1 else found[0][1]
    out = F.when(best == 0, GENERAL)
    for name, n in found:
        out = out.when(n == best, name)
    return out


def rake(tokens: np.ndarray, places: list[np.ndarray], targets: list[np.ndarray], rounds: int = 2000, close: float = 1e-12) -> tuple[np.ndarray, float]:
    """Weights of the cells with these ``tokens``, 1 in sum, whose marginals are in the proportions of ``targets``, and the largest difference left.

    places: for each marginal the number of each cell's category; only cells that exist are listed. A
    category without tokens can't meet its target; the others of its marginal share it. A marginal whose
    categories with tokens have no target keeps its own proportions.
    """
    w = tokens / max(tokens.sum(), 1)
    sums = lambda axis: np.bincount(places[axis], w, len(targets[axis])).astype(float)
    wanted = []
    for axis, target in enumerate(targets):
        own = sums(axis)
        t = np.where(own > 0, target, 0.0)
        wanted.append(t / t.sum() if t.sum() > 0 else own)
    for _ in range(rounds):
        before = w
        for axis, t in enumerate(wanted):
            own = sums(axis)
            w = w * np.divide(t, own, out=np.zeros_like(own), where=own > 0)[places[axis]]
        if np.abs(w - before).max(initial=0) < close:
            break
    return w, max(float(np.abs(sums(axis) - t).max(initial=0)) for axis, t in enumerate(wanted)) if tokens.sum() else 0.0


def tempered(base: DataFrame, powers: dict[str, float], tokens: str = "n_tokens", most: int = 1000) -> Targets:
    """Targets for the columns of ``base`` that ``powers`` names: each category's share of the tokens to the power, 1 in sum.

    most: categories of a column that get a target of their own, those with most tokens; all others
    and null are REST, with the power of their common share.
    """
    out: Targets = {}
    for name, power in powers.items():
        sums = base.groupBy(name).agg(F.sum(tokens).alias("n"))
        rows = sums.filter(F.col(name).isNotNull() & (F.col("n") > 0)).orderBy(F.desc("n"), name).limit(most).collect()  # bounded by ``most``
        total = sums.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        rest = total - sum(r["n"] for r in rows)
        own = {r[name]: (r["n"] / total) ** power for r in rows} | {REST: (rest / total) ** power if rest else 0.0}
        whole = sum(own.values()) or 1.0
        out[name] = {k: v / whole for k, v in own.items()}
    return out


def category(column: Column, target: dict[str | None, float]) -> Column:
    """The value where it has a target of its own, else null."""
    return F.when(column.isin(*(k for k in target if k is not REST)), column)


def probabilities(base: DataFrame, targets: Targets, share: float | None = None, most_residual: float = 0.02, tokens: str = "n_tokens", name: str = "probability") -> DataFrame:
    """The cells of ``base``, by the categories of the columns that ``targets`` names, and the probability with which a document of each is kept.

    There is a cell for each combination that occurs, at most the product of the numbers of targets, which
    are parameters: categories without a target form one (REST), whose target is what those of its marginal
    leave of 1. If they leave nothing, REST keeps its own proportion of the tokens, and the targets share
    the others; only REST: 0.0 among the targets drops it. share: tokens kept of all, if the rarest cell
    allows it; by default as many as possible with the whole rarest cell kept. Cells without tokens are
    kept whole. Targets that can't be met together, so that a marginal misses one by more than
    ``most_residual``, are refused.
    """
    names = [[*targets[m], *([] if REST in targets[m] else [REST])] for m in targets]
    full = [np.array([targets[m].get(k, max(0.0, 1 - sum(targets[m].values()))) for k in ks]) for m, ks in zip(targets, names, strict=True)]
    rows = base.groupBy(*(category(F.col(m), targets[m]).alias(m) for m in targets)).agg(F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens")).toArrow()
    cells = rows.column("tokens").to_numpy().astype(float)
    places = [np.array([{k: i for i, k in enumerate(ks)}[v] for v in rows.column(m).to_pylist()], np.int64) for m, ks in zip(targets, names, strict=True)]
    for axis, (m, ks) in enumerate(zip(targets, names, strict=True)):
        at = ks.index(REST)
        if REST not in targets[m] and full[axis][at] < 1e-9:
            own = cells[places[axis] == at].sum() / max(cells.sum(), 1)
            full[axis] = full[axis] * (1 - own)
            full[axis][at] = own
    weights, residual = rake(cells, places, full)
    if residual > most_residual:
        raise ValueError(f"the targets can't be met together: a share of the tokens misses its target by {residual:.3f}")
    factor = np.divide(weights, cells, out=np.zeros_like(weights), where=cells > 0)
    scale = 1 / factor.max(initial=0) if factor.max(initial=0) > 0 else 0.0
    if share is not None:
        scale = min(scale, share * cells.sum())
    kept = np.where(cells > 0, np.minimum(1.0, factor * scale), 1.0)
    spark = base.sparkSession
    if not len(kept):
        return spark.createDataFrame([], ", ".join(f"`{m}` string" for m in targets) + f", {name} double")
    return spark.createDataFrame(rows.select(list(targets)).append_column(name, pa.array(kept)))


def with_probability(docs: DataFrame, targets: Targets, p: DataFrame, columns: dict[str, Column], name: str = "probability") -> DataFrame:
    """``docs`` with the probability of each row's cell of ``p``."""
    text = lambda value: F.coalesce(F.concat(F.lit("="), value), F.lit("*"))  # noqa: E731  no value is "*"
    cell = lambda column: F.to_json(F.array(*(text(column(m)) for m in targets)))
    table = p.select(cell(F.col).alias("__cell"), name)
    rows = docs.withColumn("__cell", cell(lambda m: category(columns[m], targets[m])))
    if p.count() > MOST_CELLS:
        return dealt_join(rows, table, "__cell").drop("__cell")
    return rows.join(F.broadcast(table), "__cell").drop("__cell")


def drawn(doc_id: str, probability: str, seed: int) -> Column:
    """Whether the row is kept: its number, uniform in [0, 1) from a hash of seed and id, is below the probability."""
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(doc_id)), 11).cast("double") / F.lit(float(1 << 53))
    return unit < F.col(probability)


def marginals(source: str = "source", lang: str = "lang", text: str = "text") -> dict[str, Column]:
    return {"source": F.col(source), "lang": F.col(lang), "topic": topic_of(F.col(text))}


def weighed(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", lang: str = "lang", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, source, lang, topic of each row, without the text."""
    return cut(docs.select(F.col(doc_id).alias("doc_id"), n_words(F.col(text)).alias("n_tokens"), *(c.alias(m) for m, c in marginals(source, lang, text).items())))


def mix(docs: DataFrame, targets: Targets | None = None, powers: dict[str, float] | None = None, share: float | None = None, seed: int = 7, doc_id: str = "doc_id", source: str = "source", lang: str = "lang", text: str = "text") -> DataFrame:
    """Every row of ``docs``: doc_id, n_tokens, source, lang, topic (categories; null for REST), probability, kept.

    targets: for source, lang and topic, shares of the tokens by category, 1 in sum at most; those that
    aren't given are ``tempered`` by ``powers``. Texts that are null or without words weigh nothing and
    are drawn with their cell. Rows that repeat an id are kept or dropped together; null ids are drawn
    as one id; an empty table gives no rows; other columns are not read.
    """
    base = weighed(docs, doc_id, source, lang, text)
    goals = (targets or {}) | tempered(base, powers or {})
    named = base.withColumns({m: category(F.col(m), goals[m]) for m in goals})
    return with_probability(named, goals, probabilities(base, goals, share), {m: F.col(m) for m in goals}).withColumn("kept", drawn("doc_id", "probability", seed)).select("doc_id", "n_tokens", "source", "lang", "topic", "probability", "kept")


def sample(docs: DataFrame, targets: Targets | None = None, powers: dict[str, float] | None = None, share: float | None = None, seed: int = 7, doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that ``mix`` keeps, with all their columns."""
    base = weighed(docs, doc_id)
    goals = (targets or {}) | tempered(base, powers or {})
    rows = with_probability(docs, goals, probabilities(base, goals, share, name="__p"), marginals(), "__p")
    return rows.filter(drawn(doc_id, "__p", seed)).select(*docs.columns)


def report(mixed: DataFrame, marginal: str) -> DataFrame:
    """Shares of the tokens by category of a marginal of ``mix`` rows: before, expected by the probabilities, and drawn."""
    n = F.col("n_tokens")
    rows = mixed.groupBy(F.col(marginal).alias("category")).agg(F.sum(n).alias("all"), F.sum(n * F.col("probability")).alias("expected"), F.sum(F.when(F.col("kept"), n).otherwise(0)).alias("drawn"))
    sums = rows.agg(*(F.sum(c).alias(f"__{c}") for c in ("all", "expected", "drawn")))
    return rows.join(F.broadcast(sums)).select("category", *((F.col(c) / F.col(f"__{c}")).alias(c) for c in ("all", "expected", "drawn")))
