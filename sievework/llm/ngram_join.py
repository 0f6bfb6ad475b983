"""N-gram Jaccard join with adaptive multi-match prefixes.

Shingles are ordered from rare to frequent by a count sketch over all documents.
If two sets of a and b shingles reach the threshold, the first a - o(a) + l of the
one and b - o(b) + l of the other have l in common, where o is the least overlap.
A longer prefix costs more to look up but asks for more common shingles, so each
document picks the l with the least estimated cost, from the sketched lengths of
the posting lists: postings read, and candidates to verify. Two documents are
compared under the smaller l of the two.

Equal sets are one class. Sizes and places in two prefixes tell whether a shared
shingle lies within the prefixes that just these two need; what doesn't is no
candidate. Classes of short posting lists are paired, and pairs that share l shingles
are verified. Long lists are split by size. The classes of those that stay long are
united to groups, which are dealt into blocks of bounded size; each two blocks meet
once, and of the links found there only those leave that join what wasn't joined
yet. So a large group of near copies never makes a row a pair.

All links are inside the components then. They are found there by exact overlaps:
a component's classes are dealt into blocks of bounded size, and each two blocks
meet once. Counts of links are summed inside a block, so they make no row a pair.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import SPACES, as_bytes, components, cut, discard, ready, shingles, small, word_hashes

#: Counters of the sketch, whose size doesn't depend on the data: 16 MB on each side.
SKETCH_BITS = 22
_CHUNK = 1 << 16
MAX_MATCHES = 4
_VERIFY_COST = 16.0
#: Lists with more rows are split by size; if that doesn't make them shorter, their classes meet in blocks.
LONG_LIST = 32
#: So many classes at most meet a copy of one class's set.
_GROUP = 256
#: So many tasks' counts are added to one partial sum.
_FAN = 1024
#: About so many shingles make a block: 2 MB.
BLOCK_SHINGLES = 1 << 18


def shingle_set(data: bytes, n: int) -> np.ndarray:
    return np.unique(shingles(word_hashes(data, SPACES), n))


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def sketch(df: DataFrame, n: int) -> np.ndarray:
    """How many documents have a shingle in each slot. Tasks' counts are added in two steps, of up to ``_FAN`` tasks and of those sums."""
    import pyarrow as pa
    from pyspark import TaskContext

    ready(df.sparkSession)
    chunks = (1 << SKETCH_BITS) // _CHUNK

    def packed(part, sums):
        # Most counts of a task are 0 or 1, so they pack well.
        raw = [zlib.compress(np.minimum(s, (1 << 32) - 1).astype("<u4").tobytes(), 1) for s in sums.values()]
        columns = [pa.array([part] * len(raw), pa.int32()), pa.array(list(sums), pa.int32()), pa.array(raw, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["part", "chunk", "counts"])

    def count(batches):
        total = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
        for batch in batches:
            for data in as_bytes(batch.column(0)):
                np.add.at(total, _slots(shingle_set(data, n)), 1)
        if total.any():
            yield packed(TaskContext.get().partitionId() // _FAN, {i: total[i * _CHUNK : (i + 1) * _CHUNK] for i in range(chunks)})

    def add(batches):
        sums = {}
        for batch in batches:
            for key, c, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                own = np.frombuffer(zlib.decompress(raw), dtype="<u4").astype(np.int64)
                sums[key, c] = sums[key, c] + own if (key, c) in sums else own
        for (key, c), own in sums.items():
            yield packed(key, {c: own})

    schema = "part int, chunk int, counts binary"
    parts = df.mapInArrow(count, schema).repartition("part", "chunk").mapInArrow(add, schema)
    out = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
    for r in parts.withColumn("part", F.lit(0)).repartition(chunks, "chunk").mapInArrow(add, schema).toLocalIterator():
        out[r["chunk"] * _CHUNK : (r["chunk"] + 1) * _CHUNK] = np.frombuffer(zlib.decompress(r["counts"]), dtype="<u4")
    return out


def least_overlap(size, percent: int):
    """The least overlap of a set of so many with any that reaches the threshold: ceil(size * percent / 100)."""
    return -(-size * percent // 100)


def prefix_of(hashes: np.ndarray, counts: np.ndarray, noise: float, percent: int) -> tuple[int, np.ndarray]:
    """(l, the l-prefix): the number of matches asked for with the least estimated cost, and the shingles looked up for it.

    Levels beyond the overlap that the set needs are impossible, so small sets have
    fewer. A shingle's posting list is estimated by its slot's count above the mean.
    """
    size = len(hashes)
    need = int(least_overlap(size, percent))
    most = min(MAX_MATCHES, need)
    freq = counts[_slots(hashes)]
    longest = size - need + most
    if longest < size:
        head = np.argpartition(freq, longest - 1)
        # Ties at the border are broken by the hash, as the order must be the same in all sets.
        bar = freq[head[longest - 1]]
        pool = np.flatnonzero(freq <= bar)
    else:
        pool = np.arange(size)
    order = pool[np.lexsort((hashes[pool], freq[pool]))][:longest]
    lists = np.maximum(freq[order] - noise, 0.0)
    best, cost = 1, np.inf
    for level in range(1, most + 1):
        head = lists[: size - need + level]
        read = head.sum()
        # Who is in l lists is in one outside the l - 1 longest; and each takes l places.
        found = min(read / level, read - np.sort(head)[len(head) - level + 1 :].sum())
        if read + _VERIFY_COST * found < cost:
            best, cost = level, read + _VERIFY_COST * found
    return best, hashes[order[: size - need + best]]


def _cid(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def _read(df: DataFrame, n: int, percent: int) -> DataFrame:
    """(id, key, .., size, cid, level, tokens) of the rows (id, key, .., text).

    The class of an empty set is null. ``tokens`` is the prefix, given once a task
    for each class that is large enough to link with one of another size, else null.
    """
    import pyarrow as pa

    spark = ready(df.sparkSession)
    sent = spark.sparkContext.broadcast(sketch(df.select("text"), n))

    def run(batches):
        counts, seen = sent.value, set()
        noise = float(counts.mean())
        for batch in batches:
            sizes, cids, levels, tokens = [], [], [], []
            for data in as_bytes(batch.column(where)):
                s = shingle_set(data, n)
                cid = _cid(s) if len(s) else None
                new = cid is not None and 100 * len(s) >= percent * (len(s) + 1) and cid not in seen
                seen.add(cid)
                level, prefix = prefix_of(s, counts, noise, percent) if new else (0, None)
                sizes.append(len(s))
                cids.append(cid)
                levels.append(level)
                tokens.append(prefix)
            ends = np.cumsum([0, *(0 if t is None else len(t) for t in tokens)])
            flat = np.concatenate([np.empty(0, np.uint64), *(t for t in tokens if t is not None)]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:where], pa.array(sizes, pa.int64()), pa.array(cids, pa.int64()), pa.array(levels, pa.int32()), lists], names=[*kept, "size", "cid", "level", "tokens"])

    kept = [c for c in df.columns if c != "text"]
    where = len(kept)
    return df.select(*kept, "text").mapInArrow(run, ", ".join([*(f"{c} bigint" for c in kept), "size bigint, cid bigint, level int, tokens array<bigint>"]))


def _sets(wanted: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """(cid, shingles) of the classes ``wanted`` (cid, key), written once."""
    import pyarrow as pa

    def run(batches):
        seen = set()
        for batch in batches:
            cids, sets = [], []
            for data in as_bytes(batch.column(0)):
                s = shingle_set(data, n)
                if len(s) and (cid := _cid(s)) not in seen:
                    seen.add(cid)
                    cids.append(cid)
                    sets.append(s)
            ends = np.cumsum([0, *map(len, sets)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64), pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), lists], names=["cid", "shingles"])

    keys = small(cut(wanted.select("key").distinct()))  # so the texts aren't shuffled
    sets = cut(rows.join(keys, "key", "left_semi").select("text").mapInArrow(run, "cid bigint, shingles array<bigint>"))
    # A class comes from several tasks if rows have one id, and one that wasn't asked for if their texts differ.
    if sets.groupBy("cid").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return sets
    once = cut(sets.dropDuplicates(["cid"]))
    discard(sets, shuffled=False)
    return once


def _verified(pairs: DataFrame, rows: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame:
    """The ``pairs`` (a, b) of classes, cut off already, whose sets reach the threshold.

    The texts of their classes are read once more. Of a pair, the class that is in
    more pairs is the pivot. Its set is sent once to each group of up to about
    ``_GROUP`` others, whose sets are sent to it.
    """
    degree = cut(pairs.select(F.explode(F.array("a", "b")).alias("cid")).groupBy("cid").agg(F.count("*").alias("n")))
    sets = _sets(classes.join(degree, "cid", "left_semi"), rows, n)
    both = pairs.join(degree.toDF("a", "n_a"), "a").join(degree.toDF("b", "n_b"), "b")
    pivot = F.when(F.col("n_a") >= F.col("n_b"), F.col("a")).otherwise(F.col("b"))
    parts = F.ceil(F.greatest("n_a", "n_b") / _GROUP).cast("int")
    met = both.select(pivot.alias("pivot"), F.when(pivot == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("member"), parts.alias("parts"))
    met = cut(met.withColumn("part", F.expr("cast(pmod(xxhash64(member), parts) as int)")))
    pivots = cut(met.groupBy("pivot").agg(F.max("parts").alias("parts")))
    left = sets.toDF("pivot", "mine").join(small(pivots), "pivot").select("pivot", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), "mine")
    right = sets.toDF("member", "theirs").join(small(met.drop("parts")), "member")
    shared = F.size(F.array_intersect("mine", "theirs"))
    enough = 100 * shared >= percent * (F.size("mine") + F.size("theirs") - shared)
    out = cut(left.join(right, ["pivot", "part"]).where(enough).select(*_ordered(F.col("pivot"), F.col("member"))))
    del left, right, both
    discard(degree, sets, met, pivots)
    return out


def _ordered(a, b) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _overlap(a: str, b: str, percent: int) -> str:
    """SQL for the least overlap with which sets of a and b shingles reach the threshold, rounded up."""
    return f"(({percent} * ({a} + {b}) + {99 + percent}) div {100 + percent})"


#: A place in a prefix as one number: pos, size, level and role, from the highest bits on.
_TAG = "(cast(pos as bigint) << 36) | (cast(size as bigint) << 8) | (level << 1) | cast(role as int)"
_UNTAG = {"pos": "cast(tag >> 36 as int)", "size": "cast((tag >> 8) & 268435455 as int)", "level": "cast((tag >> 1) & 127 as int)", "role": "(tag & 1) = 1"}


def _postings(found: DataFrame, percent: int) -> DataFrame:
    """(token, cid, tag): a row for each place in a class's prefix; ``tag`` holds pos, size, level and role.

    Of two sets the larger one probes and the smaller one is the index, as the
    least overlap with a set as large or larger leaves the index a shorter prefix.
    ``role`` is 1 for places that the class has as an index too.
    """
    each = found.where("level > 0").select("cid", "size", "level", F.posexplode("tokens").alias("pos", "token"))
    each = each.withColumn("role", F.expr(f"pos < size - {_overlap('size', 'size', percent)} + level"))
    return each.selectExpr("token", "cid", f"{_TAG} as tag")


def _untagged(df: DataFrame, tag: str = "tag", prefix: str = "") -> DataFrame:
    return df.withColumns({prefix + k: F.expr(v.replace("tag", tag)) for k, v in _UNTAG.items()}).drop(tag)


def _fits(percent: int) -> str:
    """SQL: may the classes of two places of a token reach the threshold, and is the token in the prefixes that these two sizes need?"""
    need = _overlap("size", "i_size", percent)
    least = f"{need} <= least(size, i_size) - int(size = i_size)"
    return f"{least} and pos < size - {need} + least(level, i_level) and i_pos < i_size - {need} + least(level, i_level)"


def _counted(met: DataFrame) -> DataFrame:
    """The pairs (a, b) of the rows (cid, i_cid, token, level, i_level) that share as many tokens as the smaller level asks for."""
    once = met.select(*_ordered(F.col("cid"), F.col("i_cid")), "token", F.least("level", "i_level").alias("level")).distinct()
    return once.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("level").alias("level")).where("n >= level").select("a", "b")


def class_links(found: DataFrame, rows: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b) between classes that make the same components as all links do."""
    postings = _postings(found, percent)
    tokens = cut(postings.groupBy("token").agg(F.count("*").alias("n_rows")).where("n_rows > 1"))
    shared = cut(postings.join(tokens, "token"))
    discard(tokens)

    # Long lists are split by classes of size: sizes that may link are in the same or the next one, where the smaller of the two is an index.
    step = math.log(100 / percent) * (1 + 1e-9) if percent < 100 else 1.0
    long = _untagged(shared.where(F.col("n_rows") > LONG_LIST).withColumn("own", F.col("tag")), "own").withColumn("bucket", F.floor(F.log("size") / step).cast("int"))
    cells = long.select("token", F.explode(F.when(F.col("role"), F.array("bucket", F.col("bucket") + 1)).otherwise(F.array("bucket"))).alias("bucket"), "cid", "tag")
    cells = cut(cells.dropDuplicates(["token", "bucket", "cid"]))
    sizes = cut(cells.groupBy("token", "bucket").agg(F.count("*").alias("n"), F.min("cid").alias("low")).where("n > 1"))
    in_cell = cells.join(sizes, ["token", "bucket"])

    # A pair shares tokens in long cells, and meets in a group's blocks, or all that it shares is counted here.
    short = shared.where(F.col("n_rows") <= LONG_LIST).select("token", F.lit(-1).alias("bucket"), "cid", "tag")
    short = cut(short.unionByName(in_cell.where(F.col("n") <= LONG_LIST).select("token", "bucket", "cid", "tag")))
    other = short.select("token", "bucket", F.col("cid").alias("i_cid"), F.col("tag").alias("i_tag"))
    larger = "((tag >> 8) & 268435455) > ((i_tag >> 8) & 268435455) or ((tag >> 8) & 268435455) = ((i_tag >> 8) & 268435455) and cid > i_cid"
    met = _untagged(_untagged(short.join(other, ["token", "bucket"]).where(larger)), "i_tag", "i_").where(_fits(percent))
    pairs = cut(_counted(met))
    edges = cut(in_cell.where((F.col("n") > LONG_LIST) & (F.col("cid") != F.col("low"))).select(F.col("cid").alias("a"), F.col("low").alias("b")).distinct())
    del postings, long, in_cell, other, met
    discard(shared, cells, sizes, short)

    links = _verified(pairs, rows, classes, n, percent)
    discard(pairs, shuffled=False)
    if not edges.isEmpty():
        groups = cut(components(edges).toDF("cid", "label"))
        blocks = _inside(rows, classes.join(small(groups), "cid"), n)
        more = cut(links.unionByName(_met(blocks, percent, "forest")))
        del blocks
        discard(links, groups)
        links = more
    discard(edges, shuffled=False)
    return links


def _meet(mine: list[np.ndarray], others: list[np.ndarray], percent: int, same: bool):
    """(places in ``mine``, place in ``others``) of the sets that reach the threshold; for one block with itself each pair once."""
    if not mine or not others:
        return
    tokens = np.concatenate(mine)
    order = np.argsort(tokens, kind="stable")
    sizes = np.array([len(s) for s in mine])
    tokens, owner = tokens[order], np.repeat(np.arange(len(mine)), sizes)[order]
    for y, s in enumerate(others):
        low = np.searchsorted(tokens, s, "left")
        n = np.searchsorted(tokens, s, "right") - low
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        shared = np.bincount(owner[at], minlength=len(mine))
        hit = np.flatnonzero(100 * shared >= percent * (sizes + len(s) - shared))
        yield (hit[hit < y] if same else hit), y


def _inside(rows: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """(label, block, blocks, cid, docs, shingles): the classes of each label with several of ``members`` (cid, key, size, docs, label), dealt into blocks."""
    blocks = F.ceil(F.sum("size") / BLOCK_SHINGLES).cast("int")
    several = cut(members.groupBy("label").agg(F.count("*").alias("_n"), blocks.alias("blocks")).where("_n > 1").drop("_n"))
    inside = cut(members.join(small(several), "label").select("cid", "key", "docs", "label", "blocks").withColumn("block", F.expr("cast(pmod(xxhash64(cid), blocks) as int)")))
    return _sets(inside, rows, n).join(small(inside.drop("key")), "cid")


class _Forest:
    """Which of some classes are joined, and the links that joined them."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def links(self, hit: np.ndarray, y: int) -> np.ndarray:
        """Of the links between ``hit`` and ``y`` those that join what wasn't joined: one end of each."""
        labels, first = np.unique(self.label[hit], return_index=True)
        new = labels != self.label[y]
        self.label[np.isin(self.label, labels[new])] = self.label[y]
        return hit[first[new]]


def _met(inside: DataFrame, percent: int, kind: str) -> DataFrame:
    """What the classes of each label have in common, every two compared once; kind is

    * counts: (cid, n), in parts: how many documents of other classes link with those of a class,
    * links: (a, b), all of them,
    * forest: (a, b), so many that the components are the same.

    Each two blocks of a label are one group of bounded size, to which their sets are sent.
    """
    import pyarrow as pa

    schema = "cid bigint, n bigint" if kind == "counts" else "a bigint, b bigint"
    names = ["cid", "n"] if kind == "counts" else ["a", "b"]

    def meet(table):
        side = table.column("side").to_numpy()
        cids, docs = table.column("cid").to_numpy(), table.column("docs").to_numpy()
        sets = [x.values.to_numpy() for x in table.column("shingles")]
        same = table.column("i")[0] == table.column("j")[0]
        of = [np.flatnonzero(side == k) for k in (0, 0 if same else 1)]
        (a, b), (docs_a, docs_b) = [cids[k] for k in of], [docs[k] for k in of]
        left, right = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        forest = _Forest(len(a) if same else len(a) + len(b))
        one, two = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for hit, y in _meet([sets[k] for k in of[0]], [sets[k] for k in of[1]], percent, same):
            if kind == "counts":
                left[hit] += docs_b[y]
                right[y] += docs_a[hit].sum()
                continue
            if kind == "forest":
                hit = forest.links(hit, y if same else len(a) + y)
            one.append(np.minimum(a[hit], b[y]))
            two.append(np.maximum(a[hit], b[y]))
        columns = [np.concatenate([a, b]), np.concatenate([left, right])] if kind == "counts" else [np.concatenate(one), np.concatenate(two)]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    place = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    own = F.col("block")
    first = F.transform(F.sequence(own, F.col("blocks") - 1), lambda j: place(own, j, 0))
    second = F.when(own > 0, F.transform(F.sequence(F.lit(0), own - 1), lambda i: place(i, own, 1))).otherwise(F.array().cast("array<struct<i:int,j:int,side:int>>"))
    dealt = inside.select("label", "cid", "docs", "shingles", F.explode(F.concat(first, second)).alias("at")).select("label", "at.i", "at.j", "at.side", "cid", "docs", "shingles")
    return dealt.groupBy("label", "i", "j").applyInArrow(meet, schema)


def _joined(rows: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """What is found of each of the rows (id, key, text), and its classes with their component's label and least id."""
    found = cut(_read(rows, n, percent))
    classes = cut(found.where("cid is not null").groupBy("cid").agg(F.min("key").alias("key"), F.min("id").alias("least"), F.max("size").alias("size"), F.count("*").alias("docs")))
    links = class_links(found, rows, classes, n, percent)
    groups = cut(components(links).toDF("cid", "label"))
    labelled = cut(classes.join(small(groups), "cid", "left").withColumn("label", F.coalesce("label", "cid")))
    least = labelled.groupBy("label").agg(F.min("least").alias("component"))
    members = cut(labelled.join(least, "label").select("cid", "key", "size", "docs", "label", "component"))
    del links, least
    discard(classes, groups, labelled)
    return found, members


def _keyed(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, key, text): texts of one class are found again by the key of one of its rows."""
    rows = df.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"))
    return rows.select("id", F.coalesce("id", F.xxhash64("text")).alias("key"), "text")


def linked_classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """All links (a, b) between different sets, a < b, as classes; ``cid`` of ``jaccard_components`` tells the members."""
    rows = _keyed(df, doc_id, text)
    _, members = _joined(rows, n, percent)
    return _met(_inside(rows, members, n), percent, "links")


def jaccard_components(df: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """Each row's ``doc``, ``size`` (distinct n-word shingles), ``cid`` (class of equal sets), ``component`` and ``links``.

    Words are runs of other bytes than white space, A-Z lower-cased. A text of
    fewer words is one shingle; a null or empty one has none, links with nothing
    and has a null ``cid``. Rows link when 100 times the shared shingles reach
    ``percent`` times all of the two. ``component`` is the least id reachable, the
    row's own included. Repeated rows and ids count as they are; rows with a null id
    take part and have the least known id of their component, or null. Ids are
    integers. Shingles and sets are compared by 64-bit hashes. ``links`` is the
    number of other rows that the row links with, all of them verified, those with
    an equal set included; ``linked_classes`` lists them.
    """
    rows = _keyed(df, doc_id, text)
    found, members = _joined(rows, n, percent)
    others = _met(_inside(rows, members, n), percent, "counts").groupBy("cid").agg(F.sum("n").alias("others"))
    labels = cut(members.join(others, "cid", "left").select("cid", "component", (F.col("docs") - 1 + F.coalesce("others", F.lit(0))).alias("links")))
    out = found.select("id", "size", "cid").join(labels, "cid", "left")
    return out.select(F.col("id").alias("doc"), "size", "cid", F.coalesce("component", "id").alias("component"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


def one_per_component(df: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``df`` for each component, that with the least id, all columns as they are.

    Known ids go before null ones, then the text's hash decides. Rows are told apart by
    their id and their text's 64-bit hash, so a row never goes for another text's id; of
    rows that agree in both, any one stays. Rows without a shingle all stay.
    """
    digest = F.xxhash64(F.col(text))
    rows = _keyed(df, doc_id, text).withColumn("digest", F.xxhash64("text"))
    found, members = _joined(rows, n, percent)
    placed = found.select("id", "digest", "cid").join(small(cut(members.select("cid", "label"))), "cid")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "digest")
    first = placed.groupBy("label").agg(F.min(order).alias("first"))
    marked = cut(placed.withColumn("at", order).join(first, "label").select("id", "digest", (F.col("at") == F.col("first")).alias("stays")))
    # The null id is told by a flag, as keys must not be null. 0 stands in for it.
    keys = [F.col("id").isNull().alias("_sw_none"), F.coalesce("id", F.lit(0).cast("bigint")).alias("_sw_id"), F.col("digest").alias("_sw_digest")]
    own = {"_sw_none": F.col(doc_id).isNull(), "_sw_id": F.coalesce(F.col(doc_id).cast("bigint"), F.lit(0).cast("bigint")), "_sw_digest": digest}
    gone = cut(marked.where("not stays").select(*keys).distinct())
    left = df.withColumns(own).join(small(gone), list(own), "left_anti")
    again = cut(marked.where("stays").groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    if not again.isEmpty():
        twice = left.join(small(again), list(own), "left_semi").dropDuplicates(list(own))
        left = left.join(small(again), list(own), "left_anti").unionByName(twice)
    return left.drop(*own)
