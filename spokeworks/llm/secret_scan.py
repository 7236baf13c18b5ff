"""Secret scans: fixed rules, and character Markov models compared by log-likelihood ratio.

Two first-order character models are trained from labelled samples: one of random strings, one of
ordinary identifiers, to which the corpus adds its own. A stretch of token characters that no rule has
caught is a secret if the random model explains it better than the other by a margin for each
transition. Stretches are whole runs or parts of them: the one with the largest sum of ratios above
the margin, widened while the ratios' sum grows and to whole words. Numbers, UUIDs and rules made
of marks are ordinary.
"""

from __future__ import annotations

import hashlib
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import over_batches, text_of

KINDS = ("assign", "access", "hex", "markov")
#: Index 0 stands for any character outside the alphabet; it breaks a run.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SIZE = len(ALPHABET) + 1
_INDEX = np.zeros(256, np.int64)
_INDEX[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(1, SIZE)


#: Least length of what goes on from a key that a rule has caught.
LEAST_REST = 4
_WORD = "(?:[A-Za-z]+[0-9]{0,4}|[0-9]+)"
#: Words and numbers, or names made of them.
UUID = re.compile(r"(?<![A-Za-z0-9])[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}(?![A-Za-z0-9])")
IDENTIFIER = re.compile(rf"(?<![A-Za-z0-9+/_=-])[+/_=-]*{_WORD}(?:[+/_=-]+{_WORD})*[+/_=-]*(?![A-Za-z0-9+/_=-])")


# Words of the ordinary samples, of programs and of four languages.
SAMPLE_WORDS = (
    "account action address after archive array async backup balance before bridge browser buffer build button byte cache call channel char check child class client close cluster code column "
    "command compile config connect context control copy count create current cursor data date debug default delete device directory document domain driver element encode engine error event "
    "example export factory field file filter first folder format function gateway graph group handle header history host image import index input install instance interface issue item java "
    "kernel language last layer length level library limit list load local lock logger main manager map memory merge message method metric model module month mount name network node number "
    "object offset option order output owner package page parent parse password path payload pool port print process profile project property provider query queue random range reader record "
    "region release remote report request reset resource response result return role root route row sample schema score script search section select sender server service session setting"
).split()
FOREIGN_WORDS = "aber auch nicht durch werden zwischen leben arbeit strasse schule pour dans avec plus cette comme toujours maison travail jour para como pero tambien entre siempre trabajo ciudad tiempo mundo the and with from this that have were their which".split()
_STYLES = ("camel", "pascal", "snake", "upper", "kebab", "path", "dated", "plain", "rule", "number")
#: Alphabets of the random samples: letters and digits, base64 in both forms, lower case, base32, hexadecimal in upper case.
RANDOM_ALPHABETS = (ALPHABET[:62], ALPHABET[:62], ALPHABET[:64], ALPHABET[:62] + "_-", ALPHABET[26:62], "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEF")


def identifier(rng: random.Random, words: list[str]) -> str:
    """An ordinary identifier made of ``words``: a name in one of the usual styles, a path, a dated name, a rule or a number."""
    style, own = rng.choice(_STYLES), rng.choices(words, k=rng.randint(2, 6))
    match style:
        case "camel":
            return own[0] + "".join(w.capitalize() for w in own[1:]) + rng.choice(("", "", "2", "Id", "URL"))
        case "pascal":
            return "".join(w.capitalize() for w in own)
        case "snake":
            return "_".join(own) + rng.choice(("", "", "_1", "_v2", "_id"))
        case "upper":
            return "_".join(own).upper()
        case "kebab":
            return "-".join(own)
        case "path":
            return rng.choice(("", "/")) + "/".join(own) + rng.choice(("", "/", f"/{own[0].capitalize()}{own[-1].capitalize()}Test", "/v1"))
        case "dated":
            return f"{own[0]}-{rng.randint(1990, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}"
        case "rule":
            return rng.choice("-=_+/") * rng.randint(8, 60)
        case "number":
            return rng.choice(("", "+")) + "".join(rng.choices("0123456789", k=rng.randint(4, 24)))
    return "".join(own)


def random_string(rng: random.Random, least: int = 16, most: int = 64) -> str:
    return "".join(rng.choices(rng.choice(RANDOM_ALPHABETS), k=rng.randint(least, most)))


def labelled_samples(each: int = 6000, seed: int = 11, words: list[str] | None = None) -> list[tuple[str, int]]:
    """Generated samples (text, label), ``each`` of random strings (1) and of ordinary identifiers (0)."""
    rng = random.Random(seed)
    words = words or SAMPLE_WORDS + FOREIGN_WORDS
    return [(random_string(rng), 1) for _ in range(each)] + [(identifier(rng, words), 0) for _ in range(each)]


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_WORDS = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = re.compile(rf"""({"|".join(map(_either_case, _WORDS))})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
_HINTS = (b"passw", b"secret", b"token", b"api")


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """Spans of the rules as (start, kind, end, start of the value), in code points, sorted."""
    found = []
    raw = text.encode()
    if b":" in raw or b"=" in raw:
        low = raw.lower()
        if any(h in low for h in _HINTS):
            found += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found)


def transitions(text: bytes) -> np.ndarray:
    """Counts of adjacent characters, flat, of SIZE * SIZE."""
    codes = _INDEX[np.frombuffer(text, np.uint8)]
    return np.bincount(codes[:-1] * SIZE + codes[1:], minlength=SIZE * SIZE)


def count_labelled(samples: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """Transition counts (label int, pair int, n long) of labelled samples: 1 random, 0 ordinary.

    Null texts and labels other than 0 and 1 count nothing.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, labels = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), dtype=object)
        return _rows([transitions("\n".join(t for t, k in zip(texts, labels, strict=True) if k == v).encode()) for v in (0, 1)])

    parts = over_batches(samples, [text_of(text), F.col(label).cast("int")], work, "label int, pair int, n long")
    return parts.groupBy("label", "pair").agg(F.sum("n").alias("n"))


def count_by_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """As ``count_labelled``, over all documents, labelled by the rules: values that they catch are random, unless they are words; other identifiers are ordinary."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        random, ordinary = [], np.zeros(SIZE * SIZE, np.int64)
        for t in batch.column(0).to_pylist():
            done, rest = 0, []
            for a, _, end, at in base_spans(t):
                if not IDENTIFIER.fullmatch(t[at:end]):
                    random.append(t[at:end])
                if a >= done:
                    rest.append(t[done:a])
                done = max(done, end)
            ordinary += transitions("\n".join(IDENTIFIER.findall("\n".join([*rest, t[done:]]))).encode())
        return _rows([ordinary, transitions("\n".join(random).encode())])

    parts = over_batches(docs, [text_of(text)], work, "label int, pair int, n long")
    return parts.groupBy("label", "pair").agg(F.sum("n").alias("n"))


def _rows(counts: list[np.ndarray]) -> pa.RecordBatch:
    label, pair = np.nonzero(np.stack(counts))
    n = np.stack(counts)[label, pair]
    return pa.RecordBatch.from_arrays([pa.array(label.astype(np.int32)), pa.array(pair.astype(np.int32)), pa.array(n.astype(np.int64))], ["label", "pair", "n"])


@dataclass(frozen=True)
class MarkovModel:
    """Log-likelihood ratio of each transition, random over ordinary."""

    ratio: np.ndarray
    least_length: int
    least_mean: float

    def stretches(self, text: str, taken: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        """Secret stretches of token characters between the spans taken, which are sorted: whole runs or parts of them."""
        found, at, busy, key = [], 0, 0, False
        for m in re.finditer(rf"[A-Za-z0-9+/_=-]{{{self.least_length},}}", text):
            start, end = m.span()
            while at < len(taken) and taken[at][0] < start:
                busy, key = max((busy, key), (taken[at][2], taken[at][1] in (1, 2)))
                at += 1
            here, key = max(start, busy), busy > start and key
            while at < len(taken) and taken[at][0] < end:
                a, kind, b, _ = taken[at]
                self._between(text, here, min(a, end), key, kind in (1, 2), found)
                if b > here:
                    here, key = b, kind in (1, 2)
                at += 1
            self._between(text, here, end, key, False, found)
            busy = max(busy, here)
        return sorted(found)

    def _between(self, text: str, start: int, end: int, left: bool, right: bool, found: list[tuple[int, int, int, int]]) -> None:
        """The secret stretches of text[start:end] around UUIDs; left, right: whether a key by the rules touches it there."""
        n = len(found)
        for m in UUID.finditer(text, start, end) if end - start >= 36 else ():
            self._best(text, start, m.start(), found)
            start, left = m.end(), False
        self._best(text, start, end, found)
        if len(found) == n and (left or right) and end - start >= LEAST_REST:
            self._touching(text, start, end, left, right, found)

    def _best(self, text: str, start: int, end: int, found: list[tuple[int, int, int, int]]) -> None:
        """Add the secret stretches of text[start:end] to ``found``."""
        parts = [(start, end)]
        while parts:
            start, end = parts.pop()
            if end - start < self.least_length:
                continue
            codes = _INDEX[np.frombuffer(text[start:end].encode(), np.uint8)]
            ratios = self.ratio[codes[:-1] * SIZE + codes[1:]]
            if ratios.mean() >= self.least_mean:
                found.append((start, 3, end, start))
                continue
            over = np.concatenate([[0.0], np.cumsum(ratios - self.least_mean)])
            least = self.least_length - 1
            gains = over[least:] - np.minimum.accumulate(over[:-least])
            b = int(gains.argmax())
            if gains[b] < 0:
                continue  # then no stretch reaches the margin
            a, b = int(over[: b + 1].argmin()), b + least
            sums = np.concatenate([[0.0], np.cumsum(ratios)])
            a, b = start + int(sums[: a + 1].argmin()), start + b + int(sums[b:].argmax()) + 1
            while a > start and text[a - 1].isalnum():  # letters and digits on from a secret are part of it
                a -= 1
            while b < end and text[b].isalnum():
                b += 1
            found.append((a, 3, b, a))
            parts += [(start, a), (b, end)]

    def _touching(self, text: str, start: int, end: int, left: bool, right: bool, found: list[tuple[int, int, int, int]]) -> None:
        """Add what goes on from a key at the left or right of text[start:end], where that is too short or too weak a secret by itself."""
        codes = _INDEX[np.frombuffer(text[start:end].encode(), np.uint8)]
        ratios = self.ratio[codes[:-1] * SIZE + codes[1:]]
        if left and (n := int(np.cumsum(ratios).argmax()) + 2) >= LEAST_REST and ratios[: n - 1].mean() >= self.least_mean:
            found.append((start, 3, start + n, start))
            return self._touching(text, start + n, end, False, right, found) if right and end - start - n >= LEAST_REST else None
        if right and (n := int(np.cumsum(ratios[::-1]).argmax()) + 2) >= LEAST_REST and ratios[::-1][: n - 1].mean() >= self.least_mean:
            found.append((end - n, 3, end, end - n))


def fit(counts: DataFrame, corpus: DataFrame | None = None, least_length: int = 16, least_mean: float = 0.75, random_prior: float = 2.0, ordinary_prior: float = 0.5) -> MarkovModel:
    """The two models from the transition counts of labelled samples (2 * SIZE**2 rows at most).

    corpus: counts of the corpus's own strings (``count_by_rules``). Those of a label weigh as much as
    the samples of it at most, so that neither prose nor one secret that is often repeated outweighs
    the samples. The random model has a strong uniform prior, since random strings may use any
    transition; the other has a weak one. Without samples of a class its model is uniform.
    """
    table, own = np.zeros((2, SIZE * SIZE)), np.zeros((2, SIZE * SIZE))
    for rows, into in ((counts, table), (corpus, own)):
        for row in rows.collect() if rows is not None else ():  # bounded by the alphabet
            into[row["label"], row["pair"]] += row["n"]
    for label in (0, 1):
        most = table[label].sum() or own[label].sum()
        table[label] += own[label] * min(1.0, most / max(own[label].sum(), 1))
    logs = []
    for flat, prior in zip(table, (ordinary_prior, random_prior), strict=True):
        m = flat.reshape(SIZE, SIZE)[1:, 1:] + prior
        logs.append(np.log(m / m.sum(axis=1, keepdims=True)))
    ratio = np.zeros((SIZE, SIZE))
    ratio[1:, 1:] = logs[1] - logs[0]
    return MarkovModel(ratio.ravel(), least_length, least_mean)


def train(docs: DataFrame, text: str = "text", samples: list[tuple[str, int]] | None = None) -> MarkovModel:
    """The model of generated or given labelled samples and of all documents' own strings."""
    spark = docs.sparkSession
    labelled = spark.createDataFrame(samples or labelled_samples(), "text string, label int")
    return fit(count_labelled(labelled), count_by_rules(docs, text))


def find_secrets(docs: DataFrame, model: MarkovModel, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, spans array<struct<kind, start, end>> in order of start and kind.

    Positions are code points, ends exclusive. Null and empty texts have no spans; repeated rows give
    repeated rows; an empty table gives none; other columns are not read.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for t in batch.column(1).to_pylist():
            base = base_spans(t)
            out.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b, _ in sorted(base + model.stretches(t, base))])
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["doc_id", "spans"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return over_batches(docs, [F.col(doc_id), text_of(text)], work, f"doc_id {kind}, spans array<struct<kind: string, start: bigint, end: bigint>>")


def redact(docs: DataFrame, model: MarkovModel, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each secret in ``text`` replaced by ``mark``; spans that overlap count as one. Null texts stay null."""
    names, fields = docs.columns, docs.schema
    at = names.index(text)

    def run(batches):
        for batch in batches:
            out = []
            for t in batch.column(at).to_pylist():
                spans = [] if t is None else (base := base_spans(t)) + model.stretches(t, base)
                done, parts = 0, []
                for a, _, b, _ in sorted(spans):
                    if a >= done:
                        parts += [t[done:a], mark]
                    done = max(done, b)
                out.append("".join(parts) + t[done:] if spans else t)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(out, pa.string()), *batch.columns[at + 1 :]], names)

    return docs.mapInArrow(run, fields)


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of ``find_secrets`` rows: doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans."""
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"] != "markov")
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    joined = lambda spans: F.array_join(F.transform(spans, line), ",")
    return found.select("doc_id", *map(n, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def empty_digest() -> str:
    """The digest of a document without base spans."""
    return hashlib.sha256(b"").hexdigest()
