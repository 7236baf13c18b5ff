"""Best-fit packing of tokenised documents into sequences, in bulk-synchronous rounds.

Lengths and gaps are whole numbers up to the capacity, so pieces of one length, and sequences that
hold the same lengths, are kept as runs: (size, first rank, how many). A round range-sorts the runs
of pieces and of gaps, and each range sweeps down its sizes: a run of pieces takes the nearest gap
that holds it, its successor. Ranks decide who gets a gap that several want: lower ranks go first,
and both runs are split where they are uneven. Shrunken gaps enter the next round; ranges double
from round to round, so what found no successor in its range meets the gaps above it. In the last
round, over one range, pieces without any gap open new sequences, the longest first. The number of
runs depends on the capacity, not on the number of documents.
"""

from __future__ import annotations

import heapq
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import cut, text_of

#: Bytes of text whose words are looked up together.
BLOCK = 4_000_000
#: Parts of words that a Python worker keeps the ids of, in each of two generations.
CACHE = 400_000
#: Rows of a length that one task ranks, about; lengths are dealt to as many shares as all rows need, LEAST_SALTS at least.
SHARE = 250_000
LEAST_SALTS = 64
_TAIL = b".,;:!?"
#: The tokenizer's own special strings are found across white space and so never go by words.
_SPECIAL = re.compile(rb"<\|")
#: Words that the normaliser and the splitting leave as they are, once in lower case.
_PLAIN = re.compile("[a-z\xdf-\xf6\xf8-\xff]+")


#: A text on which the ids by words must be the library's, so that a tokenizer of another kind is refused.
PROBE = "The Quick brown fox's ÉTÉ, Straße... 12,345 x-ray\n\n  naïve (Test)!? 漢字 a_b don't ÿ¡ End."


def _byte_letters() -> dict[int, str]:
    """The letters that the tokenizer's byte level writes for the UTF-8 bytes of each Latin-1 character."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    rest = [b for b in range(256) if b not in own]
    letter = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(256)}


class WordTokenizer:
    """Ids of texts by a tokenizer that drops white space and never merges across it, from ids of distinct words.

    A word that ends in marks after a letter or digit is cut there, as the tokenizer's pattern does;
    ASCII letters may be lower-cased first, as its normaliser does that too.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.merge, self.letters = self.library.model.tokenize, _byte_letters()
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        if next(self.ids([PROBE])) != self.encode([PROBE])[0]:
            raise ValueError(f"{path}: words of this tokenizer can't be encoded one by one")

    def encode(self, words: list[str]) -> list[bytes]:
        done = self.library.encode_batch_fast(words, add_special_tokens=False)
        return [struct.pack(f"<{len(e)}I", *e.ids) for e in done]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """As ``encode``; plain words go to the library's merges at once, past its normaliser and splitting."""
        out, other = [], []
        for w in words:
            low = w.lower()
            if _PLAIN.fullmatch(low):
                ids = [t.id for t in self.merge(low if low.isascii() else low.translate(self.letters))]
                out.append(struct.pack(f"<{len(ids)}I", *ids))
            else:
                other.append(w)
                out.append(None)
        rest = iter(self.encode(other))
        return [next(rest) if ids is None else ids for ids in out]

    @staticmethod
    def parts(word: bytes) -> list[bytes]:
        low = word.lower()
        stem = low.rstrip(_TAIL)
        latin = stem[-2:-1] == b"\xc3" and stem[-1] not in (0x97, 0xB7)  # a letter from U+00C0 to U+00FF
        if stem and len(stem) < len(low) and (latin or stem[-1:].isalnum()):
            return [stem, low[len(stem) :]]
        return [low]

    def learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """The ids of each word; those of its parts are kept for later calls."""
        if len(self.young) > CACHE:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        cuts = {w: self.parts(w) for w in words}
        missing = []
        for p in {p for c in cuts.values() for p in c} - young.keys():
            if (ids := old.get(p)) is None:
                missing.append(p)
            else:
                young[p] = ids
        young.update(zip(missing, self.encode_words([p.decode() for p in missing]), strict=True))
        return {w: young[c[0]] if len(c) == 1 else young[c[0]] + young[c[1]] for w, c in cuts.items()}

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        at = 0
        while at < len(texts):
            raw, size = [], 0
            while at < len(texts) and (not raw or size < BLOCK):
                raw.append(texts[at].encode())
                size, at = size + len(raw[-1]), at + 1
            whole = [bool(_SPECIAL.search(r)) for r in raw]
            split = [[] if w else r.split() for r, w in zip(raw, whole, strict=True)]
            get = self.learn(set().union(*split)).__getitem__
            for r, w, s in zip(raw, whole, split, strict=True):
                yield self.encode([r.decode()])[0] if w else b"".join(map(get, s))


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    """One per Python worker."""
    return WordTokenizer(path)


def pieces(docs: DataFrame, path: str, capacity: int = 4096, end: int = 1, text: str = "text", doc_id: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """doc_id, piece int, start long, length long, ids_crc32 long, and the token ids (array<int>) if asked for.

    A document is its ids and ``end``; only longer ones than ``capacity`` are cut. Null texts count as empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            tail = np.array([end], "<u4").tobytes()
            for k, ids in enumerate(tokenizer(path).ids(batch.column(1).to_pylist())):
                ids += tail
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((k, i, at // 4, len(part) // 4, zlib.crc32(part), np.frombuffer(part, "<u4").astype(np.int32) if keep_ids else None))
            if rows:
                k, i, at, n, crc, ids = zip(*rows, strict=True)
                columns = [batch.column(0).take(pa.array(k)), pa.array(i, pa.int32()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), pa.array(np.concatenate(ids))))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return docs.select(F.col(doc_id).alias("a0"), text_of(text).alias("a1")).mapInArrow(run, schema)


RUNS = "kind string, size int, first long, n long, filled int, piece_size int, piece_first long"


def sweep(runs: list[tuple[str, int, int, int]], capacity: int, opening: bool, new: int = 0) -> tuple[list[tuple], list[tuple]]:
    """Best fit over one range: runs (kind, size, first, n) of pieces and gaps -> (runs left, places).

    A place is (piece size, first piece rank, n, first sequence, tokens before). Longest pieces go
    first; each takes the smallest gap that holds it. opening: pieces without a gap open sequences,
    numbered from ``new``, where only one remains, the rest of the run is matched again.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}
    for kind, size, first, n in runs:
        if kind == "gap":
            heapq.heappush(gaps.setdefault(size, []), (first, n))
    sizes = sorted(gaps)
    left, places = [], []

    def add(size: int, first: int, n: int) -> None:
        if size:
            if size not in gaps:
                sizes.insert(bisect_left(sizes, size), size)
                gaps[size] = []
            heapq.heappush(gaps[size], (first, n))

    for size, rank, n in sorted(((s, f, n) for kind, s, f, n in runs if kind == "piece"), reverse=True):
        while n:
            at = bisect_left(sizes, size)
            if at == len(sizes):
                if not opening:
                    left.append(("piece", size, rank, n))
                    break
                opened = -(-n // (capacity // size))
                add(capacity, new, opened)
                new += opened
                continue
            gap = sizes[at]
            first, m = heapq.heappop(gaps[gap])
            taken = min(n, m)
            places.append((size, rank, taken, first, capacity - gap))
            if taken < m:
                heapq.heappush(gaps[gap], (first + taken, m - taken))
            elif not gaps[gap]:
                del gaps[gap], sizes[at]
            add(gap - size, first, taken)
            rank, n = rank + taken, n - taken
    return left + [("gap", s, f, n) for s in sizes for f, n in gaps[s]], places


def rounds(lengths: DataFrame, capacity: int, ranges: int = 8) -> DataFrame:
    """Places of all pieces from (length, n): piece_size, piece_first (rank), n, first (sequence), filled.

    Pieces of over half the capacity never share a sequence: they seed one each, before the first round.
    """
    runs = lengths.select(F.lit("piece").alias("kind"), F.col("length").cast("int").alias("size"), F.lit(0).cast("long").alias("first"), F.col("n").cast("long").alias("n"))
    seeds = runs.filter(F.col("size") * 2 > capacity)
    ahead = F.sum("n").over(Window.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1))  # one row per length
    seeds = cut(seeds.withColumn("first", F.coalesce(ahead, F.lit(0))))
    places = [seeds.select(F.col("size").alias("piece_size"), F.lit(0).cast("long").alias("piece_first"), "n", "first", F.lit(0).alias("filled"))]
    opened = seeds.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    gaps = seeds.select(F.lit("gap").alias("kind"), (F.lit(capacity) - F.col("size")).cast("int").alias("size"), "first", "n").filter("size > 0")
    runs = runs.filter(F.col("size") * 2 <= capacity).unionByName(gaps)
    while ranges:
        last = ranges == 1

        def one(batches: Iterator[pa.RecordBatch], last: bool = last) -> Iterator[pa.RecordBatch]:
            rows = [tuple(r.values()) for b in batches for r in b.to_pylist()]
            left, placed = sweep(rows, capacity, last, opened)
            out = [dict(kind=k, size=s, first=f, n=n) for k, s, f, n in left]
            out += [dict(kind="place", piece_size=s, piece_first=r, n=n, first=f, filled=b) for s, r, n, f, b in placed]
            if out:
                kinds = [("kind", pa.string()), ("size", pa.int32()), ("first", pa.int64()), ("n", pa.int64()), ("filled", pa.int32()), ("piece_size", pa.int32()), ("piece_first", pa.int64())]
                yield pa.RecordBatch.from_pylist(out, pa.schema(kinds))

        dealt = runs.repartitionByRange(ranges, "size") if not last else runs.coalesce(1)
        swept = cut(dealt.mapInArrow(one, RUNS))
        places.append(swept.filter("kind = 'place'").select("piece_size", "piece_first", "n", "first", "filled"))
        runs = swept.filter("kind <> 'place'").select("kind", "size", "first", "n")
        ranges //= 2
    out = places[0]
    for p in places[1:]:
        out = out.unionByName(p)
    return out


def ranked(cutup: DataFrame, salts: int) -> tuple[DataFrame, DataFrame]:
    """(pieces with their rank among those of their length, (length, n)).

    Ranks are counted within a salted share of a length and moved by the counts of the shares
    before, so that a length that many documents have is spread over ``salts`` tasks.
    """
    salted = cutup.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(salts)).cast("int"))
    counts = cut(salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    shares = counts.select("length", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    rows = salted.withColumn("own", own).join(shares, ["length", "salt"])
    return rows.withColumn("rank", F.col("own") + F.col("before")).drop("own", "before", "salt"), counts.groupBy("length").agg(F.sum("n").alias("n"))


def pack(docs: DataFrame, path: str, capacity: int = 4096, end: int = 1, text: str = "text", doc_id: str = "doc_id", salts: int | None = None, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids if asked for).

    path: file of a tokenizer, present on every executor. A sequence holds ``capacity`` tokens at
    most, without gaps from 0. Null and empty texts are the end token alone. Repeated rows are packed
    each time; an empty table gives no rows; other columns are not read. salts: shares of a length; by
    default they follow the number of pieces.
    """
    cutup = cut(pieces(docs, path, capacity, end, text, doc_id, keep_ids))
    rows, lengths = ranked(cutup, salts or max(LEAST_SALTS, -(-cutup.count() // SHARE)))
    table = rounds(lengths, capacity).toArrow()  # bounded by the capacity
    size, rank, first, filled = (table[c].to_numpy() for c in ("piece_size", "piece_first", "first", "filled"))
    order = np.argsort(keys := size.astype(np.int64) << 48 | rank, kind="stable")
    shared = docs.sparkSession.sparkContext.broadcast((keys[order], first[order] - rank[order], filled[order].astype(np.int64)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sequence, filled = shared.value
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.searchsorted(keys, length << 48 | rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(sequence[at] + rank), pa.array(filled[at])], [*kept, "sequence_id", "offset"])

    kept = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids + ", sequence_id long, offset long"
    return rows.select(*kept, F.col("rank").cast("long").alias("rank")).mapInArrow(place, schema)
