"""Benchmark decontamination by greedy string tiling.

A document and a benchmark text that share a run of ``least`` tokens are tiled:
the longest common runs of tokens that are still unmarked are found by running
Karp-Rabin, marked in both and the search goes on, until no run of ``least`` is
left. Tiles may come in any order, so reordered passages are found as well. The
share of the benchmark text's tokens under tiles is its coverage.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import NON_WORD, mix, power_tables, ready, word_hashes

#: Characters of benchmark texts that one pass over the documents serves.
BLOCK_CHARS = 4_000_000
_BITS = 20


def tokens(text: str) -> np.ndarray:
    """Hashes of the lower-case words."""
    return word_hashes(text.lower().encode(), NON_WORD)


class Rolling:
    """Karp-Rabin hashes of the runs of a token sequence, of any length, in the ring modulo 2^64."""

    def __init__(self, words: np.ndarray):
        power, self.inverse = power_tables(len(words) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * power[: len(words)], dtype=np.uint64)])

    def windows(self, k: int) -> np.ndarray:
        """The hash of every run of ``k`` words, in order."""
        n = max(0, len(self.sums) - k)
        return mix((self.sums[k:] - self.sums[:n]) * self.inverse[:n])


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    return Rolling(words).windows(k)


def _runs(free: np.ndarray) -> np.ndarray:
    """For each place, how many free ones there are from it on without a gap."""
    stops = np.flatnonzero(~np.append(free, False))
    places = np.arange(len(free))
    return stops[np.searchsorted(stops, places)] - places


def _under(seeds: np.ndarray, size: int, least: int) -> np.ndarray:
    """Which of ``size`` tokens are in a run of ``least`` that begins at one of the marked places."""
    edge = np.zeros(size + 1, dtype=np.int64)
    at = np.flatnonzero(seeds)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + least, -1)
    return np.cumsum(edge[:-1]) > 0


def tile(doc: np.ndarray, item: np.ndarray, least: int) -> int:
    """How many of ``item``'s tokens greedy tiles of ``least`` or more tokens cover.

    The longest length of a common free run is found by bisection, as parts of a
    common run are common too. Tiles of that length are placed in the order of the
    item, each at its first free place in the document, and the search goes on. What
    is held grows with the two lengths, not with their product, however repetitive they are.
    """
    seeds_doc, seeds_item = window_hashes(doc, least), window_hashes(item, least)
    in_doc, in_item = np.isin(seeds_doc, seeds_item), np.isin(seeds_item, seeds_doc)
    if not in_doc.any():
        return 0
    # Only what lies under common seeds can be under tiles. Of the rest of the document one token is left between its parts.
    kept = _under(in_doc, len(doc), least)
    gap = ~kept
    gap[1:] &= kept[:-1]
    doc, free_doc = doc[kept | gap], kept[kept | gap]
    free_item = _under(in_item, len(item), least)
    rolling_doc, rolling_item = Rolling(doc), Rolling(item)
    covered, most = 0, int(min(_runs(free_doc).max(), _runs(free_item).max()))
    while most >= least:
        runs_doc, runs_item = _runs(free_doc), _runs(free_item)

        def places(k):
            """(hashes, places) of the free runs of ``k`` tokens in the document and in the item."""
            d, i = np.flatnonzero(runs_doc >= k), np.flatnonzero(runs_item >= k)
            return rolling_doc.windows(k)[d], d, rolling_item.windows(k)[i], i

        def common(k):
            hd, _, hi, _ = places(k)
            return len(hd) > 0 and len(hi) > 0 and bool(np.isin(hi, hd).any())

        low, high = least - 1, most
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if common(middle) else (low, middle - 1)
        if low < least:
            break
        hd, d, hi, i = places(low)
        shared = np.isin(hd, hi)
        hd, d = hd[shared], d[shared]
        order = np.argsort(hd, kind="stable")
        hd, d = hd[order], d[order]
        spot = {}  # by hash: where the search for a free place goes on
        for h, at in zip(hi, i, strict=True):
            if not free_item[at : at + low].all():
                continue
            end = int(np.searchsorted(hd, h, "right"))
            n = spot.get(h, int(np.searchsorted(hd, h, "left")))
            while n < end and not (free_doc[d[n] : d[n] + low].all() and np.array_equal(doc[d[n] : d[n] + low], item[at : at + low])):
                n += 1
            spot[h] = n
            if n < end:
                free_doc[d[n] : d[n] + low] = False
                free_item[at : at + low] = False
                covered += low
        most = low - 1
    return covered


class Benchmark:
    """The benchmark texts of one block, with a table from seed hashes to items."""

    def __init__(self, ids: list, texts: list[str], least: int):
        self.ids, self.items, self.least = ids, [tokens(t) for t in texts], least
        seeds = [np.unique(window_hashes(t, min(least, len(t)))) if len(t) >= least else np.empty(0, np.uint64) for t in self.items]
        hashes, owner = np.concatenate([*seeds, np.empty(0, np.uint64)]), np.repeat(np.arange(len(seeds)), [len(s) for s in seeds])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owner = hashes[order], owner[order]
        self.maybe = np.zeros(1 << _BITS, dtype=bool)
        self.maybe[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def covered(self, text: str, at_least: float) -> list[tuple[int, int, int]]:
        """(item's place, tokens covered, its tokens) of the items whose coverage reaches ``at_least``."""
        if not text or not len(self.hashes):
            return []
        doc = tokens(text)
        seeds = window_hashes(doc, self.least)
        hits = np.flatnonzero(self.maybe[(seeds >> np.uint64(64 - _BITS)).astype(np.int64)])
        if not len(hits):
            return []
        asked = np.unique(seeds[hits])
        low, high = np.searchsorted(self.hashes, asked, "left"), np.searchsorted(self.hashes, asked, "right")
        owners = np.concatenate([self.owner[a:b] for a, b in zip(low, high, strict=True) if b > a] or [np.empty(0, np.int64)])
        out = []
        places, shared = np.unique(owners, return_counts=True)
        for i, n in zip(places, shared, strict=True):
            item = self.items[i]
            # n seeds reach over n * least tokens at most, if each counts once in the item.
            if len(np.unique(item)) == len(item) and n * self.least < at_least * len(item):
                continue
            got = tile(doc, item, self.least)
            if got >= at_least * len(item):
                out.append((int(i), got, len(item)))
        return out


def _blocks(benchmark: DataFrame, chars: int):
    """Lists of (id, text) by ascending id and text, each of some ``chars`` at most (or one text)."""
    rows = benchmark.select("item_id", "text").where("text is not null").distinct().orderBy("item_id", "text").toLocalIterator()
    block, size = [], 0
    for r in rows:
        if block and size + len(r["text"]) > chars:
            yield block
            block, size = [], 0
        block.append((r["item_id"], r["text"]))
        size += len(r["text"])
    if block:
        yield block


def contaminated(df: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 5, coverage: float = 0.8, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Pairs of a document and a benchmark text that its tiles cover to ``coverage`` or more.

    Returns doc_id, item_id (both of their type), tokens_covered, item_tokens, coverage. Benchmark texts
    of fewer than ``least`` tokens can't be tiled and match nothing, nor do null or
    empty texts on either side. Repeated documents are reported each, repeated
    benchmark rows once. The benchmark goes to the executors in blocks of
    ``block_chars`` characters; each block passes over all documents.
    """
    out = None
    for block in _blocks(benchmark, block_chars):
        found = _pass(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), block, least, coverage, _pairs_schema(df.schema[doc_id].dataType, benchmark))
        out = found if out is None else out.unionAll(found)
    if out is None:
        return df.sparkSession.createDataFrame([], _pairs_schema(df.schema[doc_id].dataType, benchmark))
    return out


def decontaminated(df: DataFrame, benchmark: DataFrame, text: str = "text", least: int = 5, coverage: float = 0.8, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``df`` that no benchmark text contaminates, all columns as they are."""
    for block in _blocks(benchmark, block_chars):
        df = _pass(df, block, least, coverage, None, text)
    return df


def _pairs_schema(doc_id: T.DataType, benchmark: DataFrame) -> T.StructType:
    fields = [("doc_id", doc_id), ("item_id", benchmark.schema["item_id"].dataType), ("tokens_covered", T.IntegerType()), ("item_tokens", T.IntegerType()), ("coverage", T.DoubleType())]
    return T.StructType([T.StructField(*f) for f in fields])


def _pass(df: DataFrame, block: list, least: int, coverage: float, pairs: T.StructType | None, text: str = "text") -> DataFrame:
    """The pairs that a block of the benchmark makes with the rows (doc_id, text); without ``pairs`` the rows that make none."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    spark = ready(df.sparkSession)
    sent = spark.sparkContext.broadcast(block)
    where = df.columns.index(text)
    item_type = to_arrow_type(pairs["item_id"].dataType) if pairs else None

    def run(batches):
        bench = Benchmark([b[0] for b in sent.value], [b[1] for b in sent.value], least)
        for batch in batches:
            found = [bench.covered(x or "", coverage) for x in batch.column(where).to_pylist()]
            if not pairs:
                yield batch.filter(pa.array([not f for f in found], pa.bool_()))
                continue
            take = np.repeat(np.arange(len(found)), [len(f) for f in found])
            flat = [y for f in found for y in f]
            columns = [batch.column(0).take(pa.array(take, pa.int64())), pa.array([bench.ids[i] for i, _, _ in flat], item_type), pa.array([c for _, c, _ in flat], pa.int32()), pa.array([n for _, _, n in flat], pa.int32()), pa.array([c / n for _, c, n in flat], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=pairs.names)

    return df.mapInArrow(run, pairs or df.schema)
