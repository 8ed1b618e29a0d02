"""Suffix-array dedup: shard Burrows-Wheeler transforms merged by interleave refinement.

A byte goes when a string of 200 bytes that covers it also starts elsewhere.

Copies.  Equal texts are one from the start: rows whose text occurs again lose
all of it (from 200 bytes on), and one of them stands for all in what follows.

Candidates.  Every 200-byte string holds 161 substrings of 40 bytes; the one of
least hash (leftmost) is its anchor, so equal strings have equal anchors at the
same place.  Consecutive starts with one anchor form a block.  Blocks whose
anchor occurs once hold no repeat; of the others each distinct block goes to the
merge once, with the number of its places.

Merging.  Blocks are strings of at most 360 bytes.  A task cuts them into
shards, each with its own suffix array and transform.  The alphabet is that of
8-byte words: the suffix after p is p + 8, so a string has 8 interleaved chains
and 200 bytes are 25 symbols.  Refinement starts with the shards one after
another; each round sends every suffix to its predecessor (last-to-first) and
deals the interleave stably by the transforms' symbols, so after r rounds it is
ordered by 8 r bytes, and neighbours that differ in symbol or came from
different intervals start a new interval: their common prefix is below 8 r.
Suffixes alone in their interval leave: their predecessors are alone one round
later.  A suffix alone in its interval whose block stands in several places is a
repeat by itself, and so are all of its block.  After 25 rounds the intervals left are the
strings of 200 bytes that occur more than once, and every mark comes from one.
Suffixes are sorted within shards only.

An anchor with very many different blocks is not one task's work: its blocks are
cut again by anchors of 120 bytes, and where that leaves too many, of 200, each
time only those whose anchor occurs again going on to the same merge.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exchange, runtime
from .text import U64, Chunk, Rolling, byte_codes, chunks, mix, ragged, sliding_min, union_spans, utf8

LENGTH, ANCHORS, WORD = 200, (40, 120, 200), 8
SHARD_BYTES, MERGE_BYTES, CROWD = 1 << 18, 1 << 20, 1024
SEGMENT = 1 << 22
_PLACE = U64((1 << 28) - 1)
_OTHER = 0xD6E8FEB86659FD93
_KEY = ["h", "h2"]
_FLUSH, _PLACES, _MARK = 1 << 18, 1 << 14, "<i8 <i8 <u4 <u4"
_MARKS = "anchor long, block long, at long, n long"


def blocks(part: Chunk, length: int = LENGTH, anchor: int = ANCHORS[0], segment: int = SEGMENT) -> tuple[np.ndarray, ...]:
    """(row, first start, number of starts, anchor's hash, block's hash) of all blocks; starts within the chunk.

    A chunk of one long text is taken in segments, at whose ends blocks end too.
    """
    if len(part) == 1 and len(part.data) >= segment + length:
        out = []
        for at in range(0, len(part.data) - length + 1, segment):
            data = part.data[at : at + segment + length - 1]
            row, first, *rest = blocks(Chunk(data, np.array([0, len(data)]), part.rows), length, anchor, len(data))
            out.append((row, first + at, *rest))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))
    size = np.diff(part.offsets)
    starts = ragged(part.offsets[:-1], np.maximum(size - length + 1, 0))
    if not len(starts):
        return tuple(np.empty(0, np.int64) for _ in range(5))
    codes = byte_codes()[part.data]
    grams = Rolling(codes).windows(anchor)
    least = sliding_min((grams & ~_PLACE) | np.arange(len(grams), dtype=U64), length - anchor + 1)[starts] & _PLACE
    head = np.ones(len(starts), dtype=bool)
    head[1:] = (least[1:] != least[:-1]) | (starts[1:] != starts[:-1] + 1)
    heads = np.flatnonzero(head)
    n = np.diff(np.append(heads, len(starts)))
    first = starts[heads]
    row = np.searchsorted(part.offsets, first, side="right") - 1
    own = Rolling(codes, _OTHER).ranges(first, first + n + length - 1)
    return row, first, n, grams[least[heads].astype(np.int64)].view(np.int64), own.view(np.int64)


def anchored(texts: DataFrame) -> DataFrame:
    """(anchor, block, h, h2, start, n): all blocks of texts (h, h2, text), starts within the text."""

    def each(batches):
        for batch in batches:
            h, h2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for part in chunks(batch.column(2)):
                row, first, n, anchor, block = blocks(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor), pa.array(block), pa.array(h[part.rows][row]), pa.array(h2[part.rows][row]), pa.array(first - part.offsets[row]), pa.array(n)], names=["anchor", "block", "h", "h2", "start", "n"]
                )

    return texts.select("h", "h2", "text").mapInArrow(runtime.task(each), "anchor long, block long, h long, h2 long, start long, n long")


class Shard:
    """Suffix array, transform and last-to-first map of some strings, over 8-byte words.

    Nodes are the positions 0..size of every string; the last 8 of a string are
    its ends and have a symbol of their own each.  A chain is circular: the
    node before the first 8 is the end of the same chain.
    """

    def __init__(self, symbol: np.ndarray, size: np.ndarray):
        n = len(symbol)
        begin = np.cumsum(size + 1) - (size + 1)
        of = np.repeat(np.arange(len(size)), size + 1)
        place = np.arange(n) - begin[of]
        rank = np.unique(symbol, return_inverse=True)[1]
        step = WORD
        at = np.arange(n, dtype=np.int64)
        while True:
            after = np.where(place + step <= size[of], rank[np.minimum(at + step, n - 1)] + 1, 0)
            key = np.sort(rank << 42 | after << 21 | at)
            self.order = key & ((1 << 21) - 1)
            new = np.ones(n, dtype=bool)
            new[1:] = (key[1:] >> 21) != (key[:-1] >> 21)
            rank = np.empty(n, dtype=np.int64)
            rank[self.order] = np.cumsum(new) - 1
            if new.all():
                break
            step *= 2
        end = size[of] - (size[of] - place) % WORD
        before = np.where(place >= WORD, at - WORD, begin[of] + end)
        self.transform = symbol[before[self.order]]
        self.last_to_first = rank[before[self.order]]


def words_of(data: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A symbol for each node: dense over 8-byte words; ends have symbols that occur once."""
    nodes = size + 1
    begin, from_ = np.cumsum(nodes) - nodes, np.cumsum(size) - size
    of = np.repeat(np.arange(len(size)), nodes)
    place = np.arange(int(nodes.sum())) - begin[of]
    real = place <= size[of] - WORD
    padded = np.append(data, np.zeros(WORD, np.uint8)).astype(np.uint64)
    word = np.zeros(len(data), dtype=np.uint64)
    for i in range(WORD):
        word |= padded[i : i + len(data)] << U64(8 * (WORD - 1 - i))
    symbol = np.empty(len(place), dtype=np.int64)
    kinds, symbol[real] = np.unique(word[(from_[of] + place)[real]], return_inverse=True)
    symbol[~real] = len(kinds) + np.arange(int((~real).sum()))
    return symbol


def merged(shards: list[Shard], rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Interleave refinement of the shards' transforms for that many symbols.

    Suffixes are numbered by shard and rank within it.  Returns those that share
    their first symbols with another, in merged order, the interval of each, and
    for every suffix how many symbols it has in common with the one before it in
    merged order (at most `rounds`).
    """
    transform = np.concatenate([s.transform for s in shards])
    offset = np.cumsum([0] + [len(s.order) for s in shards])
    last_to_first = np.concatenate([s.last_to_first + o for s, o in zip(shards, offset, strict=False)])
    interleave = np.arange(len(transform))
    interval = np.zeros(len(transform), dtype=np.int64)
    common = np.zeros(len(transform), dtype=np.int64)
    for done in range(rounds):
        symbol = transform[interleave]
        deal = np.sort(symbol << 32 | np.arange(len(symbol))) & 0xFFFFFFFF
        symbol, interval = symbol[deal], interval[deal]
        interleave = last_to_first[interleave[deal]]
        new = np.ones(len(symbol) + 1, dtype=bool)
        new[1:-1] = (symbol[1:] != symbol[:-1]) | (interval[1:] != interval[:-1])
        common[interleave[~new[:-1]]] = done + 1
        keep = ~(new[:-1] & new[1:])
        interval = (np.cumsum(new[:-1]) - 1)[keep]
        interleave = interleave[keep]
        if not len(interleave):
            break
    return interleave, interval, common


def repeated(strings: list[bytes], length: int = LENGTH, shard_bytes: int = SHARD_BYTES, places: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(string, place) of every substring of that length (a multiple of 8) that occurs more than once in strings.

    places: how many times each string stands; once each if not given.
    """
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    symbol = words_of(np.frombuffer(b"".join(strings), np.uint8), size)
    nodes = np.cumsum(size + 1)
    cuts = np.flatnonzero(np.diff(nodes // shard_bytes, prepend=-1))
    cuts = np.append(cuts, len(size))
    shards, first = [], np.append(0, nodes)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        shards.append(Shard(symbol[first[a] : first[b]], size[a:b]))
    starts = np.cumsum([0] + [len(s.order) for s in shards])
    order = np.concatenate([s.order + o for s, o in zip(shards, starts, strict=False)])
    of = np.repeat(np.arange(len(size)), size + 1)
    at, _, _ = merged(shards, length // WORD)
    again = np.zeros(len(of), dtype=bool)
    again[order[at]] = True
    if places is not None:
        again |= (places > 1)[of] & (np.arange(len(of)) - first[of] <= (size - length)[of])
    node = np.flatnonzero(again)
    return of[node], node - first[of[node]]


def _merge(batches):
    """Rows (anchor, block, places, bytes) sorted by anchor: marks of the blocks, by the merge of their shards."""
    kept: list[pa.RecordBatch] = []
    size = 0

    def settle(table: pa.Table):
        if not table.num_rows:
            return
        string, place = repeated(table["bytes"].to_pylist(), places=table["places"].to_numpy())
        if not len(string):
            return
        head = np.ones(len(string), dtype=bool)
        head[1:] = (string[1:] != string[:-1]) | (place[1:] != place[:-1] + 1)
        heads = np.flatnonzero(head)
        n = np.diff(np.append(heads, len(string)))
        s = string[heads]
        yield pa.RecordBatch.from_arrays([pa.array(table["anchor"].to_numpy()[s]), pa.array(table["block"].to_numpy()[s]), pa.array(place[heads]), pa.array(n)], names=["anchor", "block", "at", "n"])

    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            piece = batch.slice(at, 2048)
            kept.append(piece)
            size += sum(map(len, piece.column("bytes").to_pylist()))
            if size > MERGE_BYTES:
                table = pa.Table.from_batches(kept).combine_chunks()
                anchor = table["anchor"].to_numpy()
                cut = int(np.flatnonzero(anchor == anchor[-1])[0])  # the last anchor may go on
                if cut:
                    yield from settle(table.slice(0, cut))
                    kept = table.slice(cut).to_batches()
                    size = sum(len(x) for b in kept for x in b.column("bytes").to_pylist())
    if kept:
        yield from settle(pa.Table.from_batches(kept).combine_chunks())


def _again(level: int):
    """Rows (anchor, block, places, bytes) cut by the anchors of a level: sub-blocks with their bytes and place in the block."""

    def each(batches):
        for batch in batches:
            for part in chunks(batch.column("bytes")):
                row, first, n, sub, subblock = blocks(part, LENGTH, ANCHORS[level])
                own = batch.slice(part.rows.start, len(part))
                raw = part.data.tobytes()
                cut = [raw[a:b] for a, b in zip(first.tolist(), (first + n + LENGTH - 1).tolist(), strict=True)]
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sub), pa.array(subblock), own.column("anchor").take(take), own.column("block").take(take), pa.array(first - part.offsets[row]), own.column("places").take(take), pa.array(cut, pa.binary())],
                    names=["sub", "subblock", "anchor", "block", "off", "places", "bytes"],
                )

    return each


def settled(kinds: DataFrame, crowd: int = CROWD, level: int = 0) -> DataFrame:
    """(anchor, block, at, n): n repeated starts from `at` on in each distinct block (anchor, block, places, bytes)."""
    kinds = kinds.select("anchor", "block", "places", "bytes")
    crowded = runtime.written(kinds.groupBy("anchor").count().where(F.col("count") > crowd).select("anchor"), "crowded")
    last = level + 1 == len(ANCHORS)
    few = kinds if last else kinds.join(crowded, "anchor", "left_anti")
    out = few.repartition(runtime.parts(kinds.sparkSession), "anchor").sortWithinPartitions("anchor").mapInArrow(runtime.task(_merge), _MARKS)
    if last or not crowded.limit(1).count():
        return out
    parts = kinds.join(crowded, "anchor", "left_semi").mapInArrow(runtime.task(_again(level + 1)), "sub long, subblock long, anchor long, block long, off long, places long, bytes binary")
    parts = runtime.written(parts, "sub-blocks")
    again = runtime.written(parts.groupBy("sub").agg(F.sum("places").alias("c")).where("c > 1").select("sub"), "again")
    parts = runtime.written(parts.join(again, "sub", "left_semi"), "sub-blocks")
    finer = parts.groupBy("sub", "subblock").agg(F.sum("places").alias("places"), F.first("bytes").alias("bytes"))
    finer = runtime.written(finer.select(F.col("sub").alias("anchor"), F.col("subblock").alias("block"), "places", "bytes"), "blocks")
    found = runtime.written(settled(finer, crowd, level + 1), "found")
    found = parts.select("sub", "subblock", "anchor", "block", "off").join(found.select(F.col("anchor").alias("sub"), F.col("block").alias("subblock"), "at", "n"), ["sub", "subblock"])
    return out.union(found.select("anchor", "block", (F.col("off") + F.col("at")).alias("at"), "n"))


def gathered(rows: DataFrame) -> DataFrame:
    """(anchor, block, n, one, last, places): blocks (anchor, block, h, h2, start, n) by kind within a task.

    places: h, h2 and start of each, packed; one and last: the least and the
    greatest of them.
    """
    place = pa.struct([("h", pa.int64()), ("h2", pa.int64()), ("start", pa.int64())])

    def each(batches):
        kept, size = [], 0
        for batch in batches:
            kept.append([batch.column(c).to_numpy() for c in ("anchor", "block", "n", "h", "h2", "start")])
            size += batch.num_rows
            if size > _FLUSH:
                yield from sent(kept)
                kept, size = [], 0
        if size:
            yield from sent(kept)

    def sent(kept):
        anchor, block, n, h, h2, start = [np.concatenate(c) for c in zip(*kept, strict=True)]
        order = np.lexsort((start, h2, h, n, block, anchor))
        anchor, block, n, h, h2, start = (c[order] for c in (anchor, block, n, h, h2, start))
        head = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (block[1:] != block[:-1]) | (n[1:] != n[:-1])))
        ends = np.append(head[1:], len(n))
        head = np.concatenate([np.arange(a, b, _PLACES) for a, b in zip(head.tolist(), ends.tolist(), strict=True)]) if (ends - head).max() > _PLACES else head
        ends = np.append(head[1:], len(n))
        raw = np.stack([h, h2, start], axis=1).astype("<i8").tobytes()
        packed = [raw[24 * a : 24 * b] for a, b in zip(head.tolist(), ends.tolist(), strict=True)]
        ends_of = lambda at: pa.StructArray.from_arrays([pa.array(c[at]) for c in (h, h2, start)], fields=list(place))
        for i in range(0, len(head), 10_000):
            s = slice(i, i + 10_000)
            at, last = head[s], ends[s] - 1
            yield pa.RecordBatch.from_arrays([pa.array(anchor[at]), pa.array(block[at]), pa.array(n[at]), ends_of(at), ends_of(last), pa.array(packed[s], pa.binary())], names=["anchor", "block", "n", "one", "last", "places"])

    return rows.select("anchor", "block", "n", "h", "h2", "start").mapInArrow(runtime.task(each), "anchor long, block long, n long, one struct<h:bigint,h2:bigint,start:bigint>, last struct<h:bigint,h2:bigint,start:bigint>, places binary")


def placed(kinds: DataFrame, found: DataFrame) -> DataFrame:
    """(h, h2, marks): for each text its marks (start, n), packed, from the marks of each kind of block at all its places."""
    buckets = exchange.n_buckets(kinds)
    # a block has at most as many marks as starts
    lists = found.groupBy("anchor", "block").agg(F.collect_list("at").alias("at"), F.collect_list("n").alias("m"))
    both = kinds.select("anchor", "block", "places").join(lists, ["anchor", "block"]).select("places", "at", "m")

    def deal(batches):
        kept, size = [], 0
        for batch in batches:
            raw, offsets = utf8(batch.column(0))
            k = np.diff(offsets) // 24
            own = np.frombuffer(raw[offsets[0] : offsets[-1]].tobytes(), "<i8").reshape(-1, 3)
            ats, ms = batch.column(1), batch.column(2)
            m = np.diff(ats.offsets.to_numpy())
            at, n = ats.flatten().to_numpy(), ms.flatten().to_numpy()
            begin, first = np.cumsum(k) - k, np.cumsum(m) - m
            # every place of a kind with every mark of it
            row = np.repeat(np.arange(len(k)), k * m)
            inner = np.arange(len(row)) - np.repeat(np.cumsum(k * m) - k * m, k * m)
            p, q = begin[row] + inner // m[row], first[row] + inner % m[row]
            kept.append([own[p, 0], own[p, 1], own[p, 2] + at[q], n[q]])
            size += len(row)
            if size > _FLUSH:
                yield from sent(kept)
                kept, size = [], 0
        if size:
            yield from sent(kept)

    def sent(kept):
        h, h2, start, n = [np.concatenate(c) for c in zip(*kept, strict=True)]
        yield from exchange.dealt(exchange.of_hash(mix(h.view(U64)), buckets), [h, h2, start, n], _MARK)

    def settle(batches):
        for _, payloads in exchange.by_bucket(batches):
            h, h2, start, n = exchange.unpack(payloads, _MARK)
            order = np.lexsort((start, h2, h))
            h, h2, start, n = (c[order] for c in (h, h2, start, n))
            head = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])))
            ends = np.append(head[1:], len(h))
            raw = np.stack([start, n], axis=1).astype("<i8").tobytes()
            for i in range(0, len(head), 10_000):
                s = slice(i, i + 10_000)
                packed = [raw[16 * a : 16 * b] for a, b in zip(head[s].tolist(), ends[s].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(h[head[s]]), pa.array(h2[head[s]]), pa.array(packed, pa.binary())], names=["h", "h2", "marks"])

    return exchange.gathered(both.mapInArrow(runtime.task(deal), exchange.PACKED)).mapInArrow(runtime.task(settle), "h long, h2 long, marks binary")


def marks(texts: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(h, h2, marks): the starts of repeated 200-byte strings of distinct texts (h, h2, text), as pairs of a start and how many follow."""
    every = runtime.written(anchored(texts), "anchors")
    place = F.struct("h", "h2", "start")
    several = every.groupBy("anchor").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo <> hi").select("anchor")
    several = runtime.written(several, "several")  # by itself, so that a skewed join can be split
    kinds = runtime.written(gathered(every.join(several, "anchor")), "kinds")
    runtime.dropped(every, several)
    whole = kinds.groupBy("anchor", "block", "n").agg(F.min("one").alias("one"), F.max("last").alias("last"))
    # two are as good as many: whether the block stands in more than one place
    places = F.when(F.col("one") == F.col("last"), 1).otherwise(2).cast("long")
    ask = whole.select("anchor", "block", "n", "one.*", places.alias("places")).groupBy(*_KEY).agg(F.collect_list(F.struct("anchor", "block", "start", "n", "places")).alias("asked"))

    # a text is asked for its own blocks only, so the list is bounded by its size

    def cut(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(4)]
            size = 0
            for raw, asked in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for a in asked:
                    row = (a["anchor"], a["block"], a["places"], raw[a["start"] : a["start"] + a["n"] + LENGTH - 1])
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
                    size += len(row[3])
                if size > 1 << 22:
                    yield sent(out)
                    out, size = [[] for _ in range(4)], 0
            yield sent(out)

    def sent(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, [pa.int64(), pa.int64(), pa.int64(), pa.binary()], strict=True)], names=["anchor", "block", "places", "bytes"])

    asked = texts.select(*_KEY, "text").join(ask, _KEY).select("text", "asked")
    # rows repeated with one text hold the same bytes: one of them is enough
    pieces = runtime.written(asked.mapInArrow(runtime.task(cut), "anchor long, block long, places long, bytes binary").dropDuplicates(["anchor", "block"]), "pieces")
    found = runtime.written(settled(pieces, crowd), "found")
    out = runtime.written(placed(kinds, found), "marks")
    runtime.dropped(kinds, pieces, found)
    return out


def dedup(documents: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc_id, kept (bytes), n_bytes, n_removed, n_spans, kept_sha256 for every document.

    Null texts are empty; a text below 200 bytes keeps all.  Repeated rows (also
    with one doc_id) are texts of their own, so their strings are repeats: a text
    that several rows have goes wholly from 200 bytes on.
    """
    docs = runtime.plain(documents, doc_id="long", text="string").withColumns({"h": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")})
    long_ = F.octet_length("text") >= LENGTH
    number = F.coalesce("doc_id", F.lit(-(2**63)))
    copies = docs.where(long_).groupBy(*_KEY).agg(F.count(F.lit(1)).alias("rows"), F.min(number).alias("first")).where("rows > 1").drop("rows")
    copies = runtime.written(copies, "copies")
    told = docs.join(copies, _KEY, "left")
    single = F.col("first").isNull()
    found = marks(told.where(long_ & (single | (number == F.col("first")))).select(*_KEY, "text"), crowd)

    def rest(batches):
        for batch in batches:
            marked = batch.column(2)
            out: list[list] = [[] for _ in range(5)]
            for i, (raw, whole) in enumerate(zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                raw = raw or b""
                own, spans = raw, 0
                if whole:
                    own, spans = b"", 1
                elif marked[i].is_valid:
                    start, n = np.frombuffer(marked[i].as_py(), "<i8").reshape(-1, 2).T
                    s, e = union_spans(start, start + n + LENGTH - 1)
                    spans, last, keep = len(s), 0, []
                    for a, b in zip(s.tolist(), e.tolist(), strict=True):
                        keep.append(raw[last:a])
                        last = b
                    own = b"".join(keep) + raw[last:]
                for column, x in zip(out, (own, len(raw), len(raw) - len(own), spans, hashlib.sha256(own).hexdigest()), strict=True):
                    column.append(x)
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(out, kinds, strict=True)]], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    own = told.where(single).select("doc_id", "text", *_KEY).join(found, _KEY, "left").select("doc_id", "text", "marks", F.lit(False).alias("whole"))
    again = told.where(~single).select("doc_id", "text", F.lit(None).cast("binary").alias("marks"), F.lit(True).alias("whole"))
    return own.union(again).mapInArrow(runtime.task(rest), "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of strings of 200 that occur more than once, removed from every document."""
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
