"""Packing: minimum bin slack over a histogram of piece lengths.

Every document is cut on a grid of the capacity, so at most one piece of it is
shorter than a window.  What has to be packed is then only the multiset of
lengths 1..capacity: a histogram of at most `capacity` counts however many
documents there are.  On the driver, minimum bin slack fills one window after
another: a bitset subset-sum dynamic programme over the remaining lengths finds
the reachable sum closest to capacity, and backtracking yields how many pieces
of each length make it up.  The pattern found is used as often as its counts
allow, so the number of patterns is bounded by the number of lengths, not by
the data.  Pieces get their place by rank among those of their length, with a
join of the (bounded) patterns; texts and ids are never shuffled.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import runtime
from .text import Chunk, chunks, lower_az, ragged

TOKENIZER = "word_bpe_49k.json"
CAPACITY, END_ID = 2048, 1
_SPLITS = 256
_WORDS_KEPT = 500_000
_CHUNK = 1 << 21
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class _Index(dict):
    def __missing__(self, key):
        return -1


class WordStore:
    """Ids of words, kept: word maps to an entry, an entry is a range of flat.  Beyond `keep` entries all is forgotten."""

    def __init__(self, keep: int):
        self.keep = keep
        self._forget()

    def _forget(self) -> None:
        self.word = _Index({"": 0})
        self.starts, self.sizes = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.flat, self.used, self.n = np.zeros(4096, np.uint32), 0, 1

    def _add(self, found: list) -> None:
        """Entries n, n + 1, ... with these ids."""
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for ids in found for i in ids), np.uint32, int(sizes.sum()))
        while self.n + len(found) > len(self.starts):
            self.starts, self.sizes = np.append(self.starts, np.zeros_like(self.starts)), np.append(self.sizes, np.zeros_like(self.sizes))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.append(self.flat, np.zeros_like(self.flat))
        self.starts[self.n : self.n + len(found)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[self.n : self.n + len(found)] = sizes
        self.flat[self.used : self.used + len(flat)] = flat
        self.n, self.used = self.n + len(found), self.used + len(flat)

    def _index(self, words: list[str]) -> np.ndarray:
        """The entries of words, unknown ones learned first."""
        if self.n > self.keep:
            self._forget()
        index = np.fromiter(map(self.word.__getitem__, words), np.int64, len(words))
        if len(miss := np.flatnonzero(index < 0)):
            self._learn(list(dict.fromkeys(map(words.__getitem__, miss.tolist()))))
            index[miss] = [self.word[words[i]] for i in miss.tolist()]
        return index

    def _ids(self, words: list[str], ends: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """All words' ids, one after another, and how many there are up to each end."""
        index = self._index(words)
        sizes = self.sizes[index]
        return self.flat[ragged(self.starts[index], sizes)], np.diff(np.append(0, np.cumsum(sizes))[np.append(0, ends)])


def _word_pattern(path: str) -> str:
    """The pre-token pattern of a tokenizer file; a file whose words can't be told apart beforehand raises."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    spaces = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
    if [s if s.get("type") == "Replace" else s.get("type") for s in steps] == ["NFC", spaces, "Lowercase"] and [p.get("type") for p in parts] == ["Split", "ByteLevel"]:
        split, level = parts
        pattern = split["pattern"].get("Regex", "")
        if split["invert"] and split["behavior"] == "Removed" and not level["add_prefix_space"] and not level["use_regex"] and "\\s" in pattern:
            return pattern
    raise ValueError(f"{path}: not a tokenizer of lower-case words between blanks, which is the only kind known here")


#: The one pre-token pattern whose pieces are told apart by bytes; words of any other go to the tokenizer whole.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_BLANK, _LETTER, _FIGURE, _MARK, _WHOLE = range(5)
_C3, _TIMES, _OVER, _LT, _BAR = 0xC3, 0x97, 0xB7, ord("<"), ord("|")


def _kinds(pattern: str) -> np.ndarray:
    """The kind of each byte: letters are A-Z, a-z and, of two bytes, U+00C0 to U+00FF."""
    kinds = np.full(256, _WHOLE, dtype=np.uint8)
    kinds[[9, 10, 11, 12, 13, 32]] = _BLANK
    if pattern == _PATTERN:
        kinds[33:127] = _MARK
        kinds[48:58] = _FIGURE
        kinds[65:91] = kinds[97:123] = kinds[0x80:0xC0] = kinds[_C3] = _LETTER
        kinds[ord("'")] = _WHOLE  # 's and the like are pieces of their own
    return kinds


class WordTokenizer(WordStore):
    """Ids of whole texts by a tokenizer whose tokens never span white space.

    Texts are cut by their bytes, many at a time, into lower-case pre-tokens: a
    run of letters, a figure, a run of marks.  A blank-separated word that holds
    anything but ASCII and the letters U+00C0 to U+00FF, or an apostrophe or
    "<|", is one unit as it stands.  Arrow finds the distinct units of a chunk;
    their ids are kept, new pre-tokens get theirs from the model and new words
    from the whole tokenizer.  Memory is bounded: beyond `keep` units what is
    kept is forgotten.
    """

    def __init__(self, path: str, keep: int = _WORDS_KEPT):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.kinds = _kinds(_word_pattern(path))
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level alphabet: these stand for themselves
        hidden = iter(range(256, 512))
        self.alphabet = {b: b if b in shown else next(hidden) for b in range(256)}
        super().__init__(keep)

    def _units(self, part: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes without blanks, start and kind of each unit in them, units before each row's end)."""
        data, n = part.data, len(part.data)
        kind = self.kinds[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[part.offsets] = True
        after = data[:-1] == _C3
        odd = kind == _WHOLE
        odd[1:] |= after & ((data[1:] == _TIMES) | (data[1:] == _OVER))
        odd[:-1] |= (data[:-1] == _LT) & (data[1:] == _BAR) & ~edge[1:n]
        low = lower_az()[data]
        low[1:] += (after & (data[1:] >= 0x80) & (data[1:] <= 0x9E)).view(np.uint8) << 5
        inside = kind != _BLANK
        if odd.any():
            begin = inside.copy()
            begin[1:] &= ~inside[:-1] | edge[1:n]
            end = inside.copy()
            end[:-1] &= ~inside[1:] | edge[1:n]
            begin, end = np.flatnonzero(begin), np.flatnonzero(end) + 1
            words = np.unique(np.searchsorted(begin, np.flatnonzero(odd), side="right") - 1)
            own = ragged(begin[words], end[words] - begin[words])
            kind[own], low[own] = _WHOLE, data[own]
        new = inside & ((kind == _FIGURE) | edge[:n])
        new[1:] |= inside[1:] & (kind[1:] != kind[:-1])
        start = np.flatnonzero(new)
        blanks = np.append(0, np.cumsum(~inside))
        return low[inside], start - blanks[start], kind[start], np.searchsorted(start, part.offsets[1:])

    def _learn(self, units: list[bytes], kinds: np.ndarray) -> None:
        whole = kinds == _WHOLE
        parts = [units[i] for i in np.flatnonzero(~whole).tolist()]
        words = [units[i] for i in np.flatnonzero(whole).tolist()]
        tokenize, alphabet, n = self.model.tokenize, self.alphabet, self.n
        found = [[t.id for t in tokenize(p.decode() if p.isascii() else p.decode("latin-1").translate(alphabet))] for p in parts]
        if words:
            found += [e.ids for e in self.tokenizer.encode_batch([w.decode() for w in words], add_special_tokens=False)]
        self._add(found)
        self.word.update(zip(parts + words, range(n, self.n), strict=True))

    def encode(self, part: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a chunk, one after another, and how many each has."""
        data, start, kind, ends = self._units(part)
        offsets = np.append(start, len(data))
        units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        code, names = units.indices.to_numpy(), units.dictionary.to_pylist()
        if self.n > self.keep:
            self._forget()
        index = np.fromiter(map(self.word.__getitem__, names), np.int64, len(names))
        if len(miss := np.flatnonzero(index < 0)):
            kinds = np.zeros(len(names), np.uint8)
            kinds[code] = kind
            self._learn([names[i] for i in miss.tolist()], kinds[miss])
            index[miss] = [self.word[names[i]] for i in miss.tolist()]
        index = index[code]
        sizes = self.sizes[index]
        return self.flat[ragged(self.starts[index], sizes)], np.diff(np.append(0, np.append(0, np.cumsum(sizes))[ends]))

    def __call__(self, text: str) -> np.ndarray:
        return self.encode(next(chunks(pa.array([text], pa.string()))))[0]


def _tokenizer(path: str) -> WordTokenizer:
    """One for each worker process: the words it has learned serve its later tasks."""
    return runtime.kept("packing", path, lambda: WordTokenizer(path))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def pieces(documents: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of every document: cut at multiples of capacity.

    A null or empty text is the end id alone, one piece.  Repeated rows are
    documents of their own.
    """

    def cut(batches):
        tokenizer_ = _tokenizer(tokenizer or default_tokenizer())
        for batch in batches:
            out: list[list[int]] = [[], [], [], [], []]
            for part in chunks(batch.column(1), _CHUNK):
                flat, sizes = tokenizer_.encode(part)
                at = 0
                for doc, size in zip(batch.column(0).slice(part.rows.start, len(part)).to_pylist(), sizes.tolist(), strict=True):
                    ids = np.append(flat[at : at + size], np.uint32(end_id)).astype("<u4")
                    at += size
                    for start in range(0, len(ids), capacity):
                        own = ids[start : start + capacity]
                        for column, x in zip(out, (doc, start, len(own), zlib.crc32(own.tobytes()), len(ids)), strict=True):
                            column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return runtime.plain(documents, doc_id="long", text="string").mapInArrow(runtime.task(cut, "packing"), _PIECES)


def padding(total: int, capacity: int = CAPACITY) -> int:
    """What a sequence of that many ids is padded by: none at a power of two."""
    return 0 if total & (total - 1) == 0 else capacity - total


def fill(counts: np.ndarray, capacity: int, lead: int) -> dict[int, int]:
    """One window by minimum bin slack: {length: how many}, `lead` (a length there) in it.

    reach[j] is a bitset (a Python integer) of the sums that the lead and lengths
    up to the j-th can make; multiplicities go in by binary splitting.  The
    reachable sum closest to capacity wins; walking reach back yields the counts.
    """
    mask = (1 << (capacity + 1)) - 1
    bits = 1 << lead
    steps: list[tuple[int, int, int]] = []
    room = capacity - lead
    for length in np.flatnonzero(counts[: room + 1])[::-1].tolist():
        have = int(counts[length]) - (length == lead)
        have, take = min(have, room // length), 1
        while have > 0:
            take = min(take, have)
            steps.append((bits, length, take))
            bits |= (bits << (length * take)) & mask
            have, take = have - take, take * 2
        if bits >> capacity:
            break
    total = bits.bit_length() - 1
    out = {lead: 1}
    for before, length, take in reversed(steps):
        if before >> total & 1:
            continue
        out[length] = out.get(length, 0) + take
        total -= length * take
    return out


def patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Minimum bin slack until nothing is left: (multiset of lengths, times used), longest lead first."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] = n
    out = []
    for lead in range(capacity, 0, -1):
        while counts[lead] > 0:
            own = fill(counts, capacity, lead)
            times = min(int(counts[length]) // n for length, n in own.items())
            for length, n in own.items():
                counts[length] -= n * times
            out.append((own, times))
    return out


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut (written pieces) with sequence_id and offset.

    Ranks among pieces of one length: within 256 splits by hash (so no length is
    one group), plus the counts of the splits before; what reaches the driver is
    at most 256 counts a length.
    """
    spark = cut.sparkSession
    cut = cut.withColumn("split", F.pmod(F.xxhash64("doc_id", "start"), F.lit(_SPLITS)).cast("int"))
    rows = cut.groupBy("length", "split").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values(["length", "split"])
    rows["before"] = rows.groupby("length")["n"].cumsum() - rows["n"]
    histogram = rows.groupby("length")["n"].sum().to_dict()

    plan, first = [], 0
    used = dict.fromkeys(histogram, 0)
    for own, times in patterns(histogram, capacity):
        at = 0
        for length, n in sorted(own.items(), reverse=True):
            plan.append((int(length), used[length], used[length] + n * times, n, first, at))
            used[length] += n * times
            at += length * n
        first += times
    starts = spark.createDataFrame([(int(a), int(b), int(c)) for a, b, c in rows[["length", "split", "before"]].itertuples(index=False)], "length long, split int, before long")
    w = Window.partitionBy("length", "split").orderBy("doc_id", "start", "ids_crc32")
    ranked = cut.withColumn("k", F.row_number().over(w) - 1).join(F.broadcast(starts), ["length", "split"]).withColumn("k", F.col("k") + F.col("before"))
    by_length: dict[int, list] = {}
    for row in plan:
        by_length.setdefault(row[0], []).append(row[1:])
    slots = spark.createDataFrame([(length, rows) for length, rows in by_length.items()], "length long, slots array<struct<lo:long,hi:long,n:long,first:long,at:long>>")
    slot = F.element_at(F.filter("slots", lambda s: (s["lo"] <= F.col("k")) & (F.col("k") < s["hi"])), 1)
    return ranked.join(F.broadcast(slots), "length").withColumn("slot", slot).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("slot.first") + F.floor((F.col("k") - F.col("slot.lo")) / F.col("slot.n"))).cast("long").alias("sequence_id"),
        (F.col("slot.at") + (F.col("k") - F.col("slot.lo")) % F.col("slot.n") * F.col("length")).cast("long").alias("offset"),
    )


def pack(documents: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pack all documents into sequences of at most `capacity` ids.

    Null or empty texts are the end id alone; no documents, no rows; repeated
    doc_ids are packed as documents of their own; other columns are not read.
    """
    cut = runtime.written(pieces(documents, tokenizer, capacity, end_id), "pieces")
    return place(cut, capacity)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 2048."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
