"""N-gram Jaccard join by PartEnum signatures.

A document's set is its distinct 5-word shingles (64-bit hashes).  Two sets of
Jaccard 0.8 or more differ in at most (a + b) / 9 elements and in size by a
quarter, so sizes fall into bands of ratio 1.25 and a pair lies in one band or
in two next to each other.  For every such pair of bands the hash domain is cut
into n1 ranges, each into three: at most k differences leave a range with at
most one, so two of its three parts are equal.  The signatures of a set are the
contents of every two of three parts of every range: similar sets share one.

An empty signature tells nothing, and many sets would share it.  A set whose
ranges are full enough (2 * ranges with at most one empty part > k) is met by a
signature that is not empty, so only the few other sets emit empty ones.

Sets of one signature meet, and each goes to the least of them, its pivot; a
pivot whose sets all belong to a lesser one is left out.  The sets of a pivot are compared exactly within a task, by an inverted index over
their shingles and a union-find: a set asks for others only while some set of
fitting size is in another component, and only the links that join two
components leave the task.  The sets of a large pivot are cut into blocks of
bounded size, each of them with the pivot; what that leaves in several
components is compared block by block, where the blocks of a large component
hold nothing else and are not compared with each other.  No pair is emitted but
a link, and exact copies are one set throughout.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exchange, runtime
from .text import U64, Chunk, Rolling, Words, chunks, mix, ragged, utf8

SHINGLE = 5
SHARE, ROW = 1 << 19, 512
_FLUSH = 1 << 19


def shingles(part: Chunk, length: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash), distinct and ascending: every row's shingles; fewer words than that are one."""
    words = Words(part, lower=True)
    n_words = np.diff(words.first)
    rolling = Rolling(words.hash)
    n = len(words.hash) - length + 1
    if n > 0:
        whole = words.doc[:n] == words.doc[length - 1 :]
        row, h = words.doc[:n][whole], rolling.windows(length)[whole]
    else:
        row, h = np.empty(0, np.int64), np.empty(0, U64)
    few = np.flatnonzero((n_words > 0) & (n_words < length))
    row = np.concatenate([row, few])
    h = np.concatenate([h, mix(rolling.ranges(words.first[few], words.first[few + 1]))])
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]


def set_ids(row: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(size, id) of each row's set; equal sets have equal ids, the empty set 0."""
    size = np.bincount(row, minlength=n)
    total = np.append(U64(0), np.cumsum(mix(h ^ U64(0xA5A5A5A5A5A5A5A5)), dtype=U64))
    end = np.cumsum(size)
    own = mix(total[end] - total[end - size] + size.astype(U64))
    return size, np.where(size > 0, own | U64(1), U64(0)).view(np.int64)


def bands(largest: int) -> np.ndarray:
    """First sizes of the bands: 1, 2, 3, 4, 6, 8, 11, ...: five quarters and one more."""
    out = [1]
    while out[-1] <= largest:
        out.append(out[-1] * 5 // 4 + 1)
    out.append(out[-1] * 5 // 4 + 1)
    return np.array(out, dtype=np.int64)


def differences(size: np.ndarray) -> np.ndarray:
    """The most elements by which a set of that size and one up to a quarter larger differ at Jaccard 0.8."""
    return (size + size * 5 // 4) // 9


def signatures(row: np.ndarray, h: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature) of all sets, in both of each one's band pairs."""
    starts = bands(int(size.max(initial=1)))
    band = np.searchsorted(starts, np.maximum(size, 1), side="right") - 1
    rows, out = [], []
    begin = np.cumsum(size) - size
    for step in (0, 1):
        pair = band - step  # the pair's lower band; the set is in its lower or its upper one
        here = np.flatnonzero((size > 0) & (pair >= 0))
        if not len(here):
            continue
        k = differences(starts[pair[here] + 1] - 1)
        n1 = k // 2 + 1 + (k + 8) // 24
        slots = 3 * n1
        base = np.cumsum(slots) - slots
        own = ragged(begin[here], size[here])
        local = np.repeat(np.arange(len(here)), size[here])
        slot = base[local] + ((h[own] >> U64(32)) * slots.astype(U64)[local] >> U64(32)).astype(np.int64)
        count = np.bincount(slot, minlength=int(slots.sum()))
        total = np.append(U64(0), np.cumsum(mix(h[own] + U64(0x51ED2701)), dtype=U64))
        end = np.cumsum(count)
        part = (total[end] - total[end - count]).reshape(-1, 3)
        full = (count > 0).reshape(-1, 3)
        of = np.repeat(np.arange(len(here)), n1)
        good = np.bincount(of, weights=full.sum(axis=1) >= 2, minlength=len(here))
        enough = (2 * good > np.minimum(k, differences(size[here])))[of]
        number = np.arange(len(of)) - np.repeat(np.cumsum(n1) - n1, n1)
        tag = mix((pair[here][of].astype(U64) << U64(40)) + number.astype(U64))
        for c, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
            keep = full[:, a] | full[:, b] | ~enough
            out.append(mix(part[keep, a] * U64(3) + mix(part[keep, b] + U64(c)) + tag[keep]))
            rows.append(here[of[keep]])
    if not out:
        return np.empty(0, np.int64), np.empty(0, U64)
    return np.concatenate(rows), np.concatenate(out)


def sets(documents: DataFrame) -> DataFrame:
    """(doc_id, t, n, sid) of each row (doc_id, text, t)."""

    def each(batches):
        for batch in batches:
            for part in chunks(batch.column(2)):
                size, sid = set_ids(*shingles(part), len(part))
                own = [batch.column(i).slice(part.rows.start, len(part)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(size.astype(np.int64)), pa.array(sid)], names=["doc_id", "t", "n", "sid"])

    return documents.select("doc_id", "t", "text").mapInArrow(runtime.task(each), "doc_id long, t long, n long, sid long")


def pivoted(documents: DataFrame) -> DataFrame:
    """(pivot, sid), distinct: sets that share a signature with others, at the least set that has it."""
    buckets = 2 * runtime.parts(documents.sparkSession)

    def sign(batches):
        kept, size_, seen = [], 0, np.empty(0, np.int64)
        for batch in batches:
            for part in chunks(batch.column(0)):
                row, h = shingles(part)
                size, sid = set_ids(row, h, len(part))
                _, first = np.unique(sid, return_index=True)
                new = np.zeros(len(sid), dtype=bool)
                new[first] = True
                new &= ~np.isin(sid, seen) & (size > 0)  # a copy of a set in this task signs once
                seen = np.union1d(seen, sid[new])
                if len(seen) > 1 << 20:
                    seen = seen[:0]
                own = new[row]
                r, s = signatures(row[own], h[own], np.where(new, size, 0))
                order = np.argsort(r, kind="stable")
                kept.append([s[order], sid[r[order]]])
                size_ += len(s)
                if size_ > _FLUSH:
                    yield from send(kept)
                    kept, size_ = [], 0
        if kept:
            yield from send(kept)

    def send(kept):
        s, sid = [np.concatenate(c) for c in zip(*kept, strict=True)]
        if len(s):
            yield from exchange.dealt(exchange.of_hash(s, buckets), [(s & U64(0xFFFFFFFF)), (s >> U64(32)) & U64(0xFF), sid], "<u4 u1 <i8")

    def meet(batches):
        for _, payloads in exchange.by_bucket(batches):
            low, high, sid = exchange.unpack(payloads, "<u4 u1 <i8")
            s = low.astype(U64) | high.astype(U64) << U64(32)
            order = np.lexsort((sid, s))
            s, sid = s[order], sid[order]
            new = np.ones(len(s), dtype=bool)
            new[1:] = (s[1:] != s[:-1]) | (sid[1:] != sid[:-1])
            s, sid = s[new], sid[new]
            head = np.ones(len(s), dtype=bool)
            head[1:] = s[1:] != s[:-1]
            heads = np.flatnonzero(head)
            length = np.diff(np.append(heads, len(s)))
            heads, length = heads[length > 1], length[length > 1]
            if not len(heads):
                continue
            pivot, sid = np.repeat(sid[heads], length), sid[ragged(heads, length)]
            order = np.lexsort((sid, pivot))
            pivot, sid = pivot[order], sid[order]
            new = np.ones(len(sid), dtype=bool)
            new[1:] = (pivot[1:] != pivot[:-1]) | (sid[1:] != sid[:-1])
            pivot, sid = pivot[new], sid[new]
            for i in range(0, len(sid), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(pivot[i : i + 100_000]), pa.array(sid[i : i + 100_000])], names=["pivot", "sid"])

    packed = documents.select("text").mapInArrow(runtime.task(sign), exchange.PACKED)
    return exchange.gathered(packed).mapInArrow(runtime.task(meet), "pivot long, sid long").distinct()


def needed(members: DataFrame) -> DataFrame:
    """members (pivot, sid, n) without the pivots of which every set also belongs to a lesser one: all their pairs meet there.

    The lesser one is the least pivot that a pivot itself belongs to; it may be
    left out in turn, for one that holds all of its own.
    """
    above = members.where("pivot <> sid").groupBy(F.col("sid").alias("pivot")).agg(F.min("pivot").alias("above"))
    there = members.select(F.col("pivot").alias("above"), "sid", F.lit(1).alias("there"))
    asked = members.join(above, "pivot").join(there, ["above", "sid"], "left")
    gone = asked.groupBy("pivot").agg(F.count(F.lit(1)).alias("all"), F.count("there").alias("held")).where("all = held").select("pivot")
    return members.join(gone, "pivot", "left_anti")


def _contents(documents: DataFrame, own: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sid, n, shingles) of the wanted sets (sid) and of a few more, each once.

    own: (sid, t), t of one document (t, text) that has the set.  The texts stay
    where they are: a Bloom filter of the t wanted goes to them, and only sets
    are shuffled.  What it lets through besides has a sid that is not wanted.
    """
    keys = runtime.written(wanted.distinct().join(own.select("sid", "t"), "sid").select("t"), "keys")
    found = documents.sparkSession.sparkContext.broadcast(exchange.members(keys, keys.count()))
    runtime.dropped(keys)

    def each(batches):
        for batch in batches:
            batch = batch.filter(pa.array(found.value.may(batch.column(0).to_numpy())))
            for part in chunks(batch.column(1)):
                row, h = shingles(part)
                size, sid = set_ids(row, h, len(part))
                end = np.cumsum(size)
                raw = h.astype("<u8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sid), pa.array(size.astype(np.int64)), pa.array([raw[e - n : e].tobytes() for e, n in zip(end.tolist(), size.tolist(), strict=True)], pa.binary())],
                    names=["sid", "n", "shingles"],
                )

    return documents.select("t", "text").mapInArrow(runtime.task(each), "sid long, n long, shingles binary").dropDuplicates(["sid"])


def joining(h: np.ndarray, n: np.ndarray, c: np.ndarray, asking: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) that join components c: every set in `asking` meets all others.

    h: the shingles of all sets, one set after another, n of each.  After these
    links two sets are in one component if any set that asked links them.
    """
    own = np.repeat(np.arange(len(n)), n)
    order = np.argsort(h, kind="stable")
    owner = own[order]
    head = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1]))
    length = np.diff(np.append(head, len(h)))
    run = np.empty(len(h), dtype=np.int64)  # of each shingle, the run of equal ones
    run[order] = np.repeat(np.arange(len(head)), length)
    begin = np.cumsum(n) - n
    _, root = np.unique(c, return_inverse=True)
    a, b = [], []
    for i in asking[np.argsort(-n[asking], kind="stable")].tolist():
        fit = (5 * n >= 4 * n[i]) & (4 * n <= 5 * n[i]) & (root != root[i])
        if not fit.any():
            continue
        runs = run[begin[i] : begin[i] + n[i]]
        runs = runs[np.argsort(length[runs], kind="stable")]
        # a similar set has at least 4/5 of the shingles, so one of the rarest fifth and one more
        rare = runs[: n[i] - (4 * n[i] + 4) // 5 + 1]
        if not fit[owner[ragged(head[rare], length[rare])]].any():
            continue
        both = np.bincount(owner[ragged(head[runs], length[runs])], minlength=len(n))
        linked = np.flatnonzero(fit & (100 * both >= 80 * (n[i] + n - both)))
        kinds, one = np.unique(root[linked], return_index=True)
        if len(kinds):
            a += [i] * len(kinds)
            b += linked[one].tolist()
            root[np.isin(root, kinds)] = root[i]
    return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)


def _links(rows: DataFrame) -> DataFrame:
    """(a, b): the links that join components within each share of rows (share, side, c, sid, n, shingles).

    side 0 and 1: only sets of different sides meet; 2: all sets do.  A share
    is of bounded size, and a task holds one at a time.
    """

    def one(table: pa.Table):
        sid, n, c, side = [table[k].to_numpy() for k in ("sid", "n", "c", "side")]
        if len(sid) > 1 and (c != c[0]).any():
            data, offsets = utf8(table["shingles"])
            h = np.frombuffer(data[offsets[0] : offsets[-1]].tobytes(), "<u8")
            asking = np.arange(len(sid))
            if side[0] < 2:
                asking = np.flatnonzero(side == int((side == 1).sum() < (side == 0).sum()))
            i, j = joining(h, n, c, asking)
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(sid[i], sid[j])), pa.array(np.maximum(sid[i], sid[j]))], names=["a", "b"])

    def each(batches):
        kept: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            key = batch.column(0).to_numpy()
            edges = np.flatnonzero(np.append(True, key[1:] != key[:-1])).tolist() + [len(key)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b == a:
                    continue
                if key[a] != last and kept:
                    yield from one(pa.Table.from_batches(kept))
                    kept = []
                last = key[a]
                kept.append(batch.slice(a, b - a))
        if kept:
            yield from one(pa.Table.from_batches(kept))

    spread = rows.select("share", "side", "c", "sid", "n", "shingles").repartition(runtime.parts(rows.sparkSession), "share").sortWithinPartitions("share")
    return spread.mapInArrow(runtime.task(each), "a long, b long")


def first_shares(members: DataFrame, share: int = SHARE) -> DataFrame:
    """(share, side, c, sid): each pivot's sets (pivot, sid, n) in blocks of about `share`, the pivot in all of them."""
    weight = F.sum(F.col("n") + ROW)
    blocks = members.groupBy("pivot").agg(F.ceil(weight / share).alias("blocks"))
    rows = members.join(blocks, "pivot")
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    block = F.explode(F.when(F.col("pivot") == F.col("sid"), every).otherwise(F.array(F.pmod(F.xxhash64("sid", F.lit(9)), "blocks"))))
    rows = rows.select("pivot", "sid", block.alias("block"))
    return rows.select(F.xxhash64("pivot", "block").alias("share"), F.lit(2).alias("side"), F.col("sid").alias("c"), "sid")


def second_shares(members: DataFrame, labels: DataFrame, share: int = SHARE) -> DataFrame:
    """(share, side, c, sid): two blocks each, of the pivots of more than one block that are left in several components.

    A component of at least half a block has blocks of its own, which do not
    meet each other; the others are dealt together by component, and their
    blocks meet all blocks and themselves.
    """
    large = members.groupBy("pivot").agg(F.sum(F.col("n") + ROW).alias("w")).where(F.col("w") > share).select("pivot")
    rows = members.join(large, "pivot", "left_semi").join(labels.withColumnRenamed("id", "sid"), "sid", "left").select("pivot", "sid", "n", F.coalesce("component", "sid").alias("c"))
    rows = runtime.written(rows, "left")
    kinds = rows.groupBy("pivot", "c").agg(F.sum(F.col("n") + ROW).alias("w"))
    several = kinds.groupBy("pivot").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.sum(F.when(F.col("w") < share / 2, F.col("w")).otherwise(0)).alias("mixed")).where("lo <> hi")
    pure = F.col("w") >= share / 2
    kinds = kinds.join(several.select("pivot", F.greatest(F.lit(1), F.ceil(F.col("mixed") / share)).alias("bins")), "pivot")
    kinds = kinds.select("pivot", "c", pure.alias("pure"), F.when(pure, F.ceil(F.col("w") / share)).otherwise(F.col("bins")).alias("blocks"))
    # a block's name; of a pure block also its component
    bin_ = F.pmod(F.xxhash64("c", F.lit(3)), "blocks")
    numbers = F.explode(F.when(F.col("pure"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(bin_))).alias("i")
    own = F.when(F.col("pure"), F.xxhash64("c", "i")).otherwise(F.xxhash64("i"))
    named = kinds.select("pivot", "c", "pure", numbers).select("pivot", own.alias("block"), F.when(F.col("pure"), F.col("c")).alias("of")).distinct()
    # as many as a pivot has blocks: its size by that of a share
    met = named.groupBy("pivot").agg(F.collect_list(F.struct("block", "of")).alias("met"))
    i = F.when(F.col("pure"), F.pmod(F.xxhash64("sid", F.lit(5)), "blocks")).otherwise(bin_)
    rows = rows.join(kinds, ["pivot", "c"]).withColumn("i", i).withColumn("block", own).join(met, "pivot")
    rows = rows.withColumn("other", F.explode(F.filter("met", lambda m: m["of"].isNull() | ~F.col("pure") | (m["of"] != F.col("c")))))
    b, o = F.col("block"), F.col("other.block")
    side = F.when(b == o, 2).when(b < o, 0).otherwise(1)
    return rows.select(F.xxhash64("pivot", F.least(b, o), F.greatest(b, o)).alias("share"), side.alias("side"), "c", "sid")


def join(documents: DataFrame, share: int = SHARE) -> DataFrame:
    """doc_id, n_shingles, component_id for every document.

    Linked: 100 * intersection >= 80 * union of shingle sets, both not empty.
    component_id is the least doc_id reachable by links (its own without any).
    Null, empty and blank texts have the empty set and stand alone; a text of
    fewer than five words is one shingle; rows repeated with one doc_id are each
    returned.
    """
    docs = runtime.plain(documents, doc_id="long", text="string").withColumn("t", F.xxhash64("doc_id", "text"))
    each = runtime.written(sets(docs), "sets")
    own = each.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("doc"), F.min("t").alias("t"), F.min("n").alias("n"))
    met = runtime.written(pivoted(docs).join(own.select("sid", "n"), "sid"), "met")
    members = runtime.written(needed(met), "members")
    runtime.dropped(met)

    links = runtime.written(_links(first_shares(members, share).join(_contents(docs, own, members.select("sid")), "sid")), "links")
    labels = runtime.components(links, "near")
    second = runtime.written(second_shares(members, labels, share), "shares")
    if second.limit(1).count():
        more = runtime.written(_links(second.join(_contents(docs, own, second.select("sid")), "sid")), "links")
        if more.limit(1).count():
            links = links.union(more)
            labels = runtime.components(links, "near")
    runtime.dropped(members, second)

    least = own.join(labels.withColumnRenamed("id", "sid"), "sid", "left").select("sid", "doc", F.coalesce("component", "sid").alias("c"))
    first = least.groupBy("c").agg(F.min("doc").alias("component_id"))
    named = least.join(first, "c").where("not component_id <=> doc").select("sid", "component_id")
    # sets of several documents, or linked ones: all others are their own
    copies = each.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("m")).where("m > 1").select("sid", F.col("component_id").alias("copy_of"))
    return each.join(copies, "sid", "left").join(named, "sid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "copy_of", "doc_id").alias("component_id"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingles have Jaccard 0.8 or more."""
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
