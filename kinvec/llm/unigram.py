"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

Pieces with log scores are a double-array trie over bytes, the white-space
marker standing as a blank.  A text gets a blank in front, as in training, and
is cut into units (blanks and the letters after them; a line break alone):
no piece crosses a unit's edge, so the best path of a text is that of its units.
Distinct units are segmented together: one Viterbi over all of them, position
by position, walks the trie for all units at once.  A byte that no piece covers
is its byte piece.  The marker itself, as a letter in a text, is no blank and
goes by bytes, so decoding gives back every text.

Scores of a model whose scores are merge ranks become -log(rank + 2).
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import runtime
from .packing import WordStore
from .text import chunks, ragged

MODEL = "piece_bpe_32k.model"
_MARK = "▁"
_KEPT = 600_000
_UNITS = re.compile(r" *[^ \n]+|\n| +")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


@dataclass
class Vocabulary:
    """pieces (bytes of each id), byte ids, scores and the double array (base, check, value by state)."""

    pieces: list[bytes]
    byte_id: np.ndarray
    score: np.ndarray
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray


def double_array(keys: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check, value: from state s by byte c to t = base[s] + c + 1 if check[t] == s; value[t] is a key's id or -1."""
    root: dict = {}
    for key, i in keys.items():
        node = root
        for c in key:
            node = node.setdefault(c, {})
        node[-1] = i
    size = 1 << 14
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    used = np.zeros(size, dtype=bool)
    used[0] = True
    start, todo = 0, [(root, 0)]
    while todo:
        node, s = todo.pop()
        value[s] = node.get(-1, -1)
        own = np.array(sorted(c for c in node if c >= 0), dtype=np.int64)
        if not len(own):
            continue
        b = -1
        while b < 0:
            if start + 4096 + 258 >= len(used):
                more = len(used)
                base, check, value, used = (np.append(x, np.full(more, fill, x.dtype)) for x, fill in ((base, 0), (check, -1), (value, -1), (used, False)))
            clear = ~used[start + own[0] + 1 : start + own[0] + 1 + 4096]
            for c in own[1:].tolist():
                clear &= ~used[start + c + 1 : start + c + 1 + 4096]
            if clear.any():
                b = start + int(clear.argmax())
            else:
                start += 4096
        if len(own) == 1 and used[start : start + 4096].mean() > 0.95:
            start += 4096
        base[s] = b
        at = b + own + 1
        used[at] = True
        check[at] = s
        todo += [(node[c], t) for c, t in zip(own.tolist(), at.tolist(), strict=True)]
    return base, check, value


def load(path: str) -> Vocabulary:
    """The pieces of a SentencePiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, keys, byte_id, score = [], {}, np.zeros(256, np.int64), np.zeros(model.get_piece_size())
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        byte = _BYTE.fullmatch(piece)
        if model.is_byte(i) and byte:
            pieces.append(bytes([int(byte[1], 16)]))
            byte_id[int(byte[1], 16)] = i
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            pieces.append(b"")
        else:
            pieces.append(piece.replace(_MARK, " ").encode())
            keys[pieces[-1]] = i
            score[i] = model.get_score(i)
    own = np.array(list(keys.values()))
    if len(own) and score[own].min() < -1000:
        score[own] = -np.log(2 - score[own])
    score[byte_id] = (score[own].min() if len(own) else 0.0) - 10
    for key, i in keys.items():
        if b" " in key.lstrip(b" ") or b"\n" in key:
            raise ValueError(f"piece {i} crosses units")
    return Vocabulary(pieces, byte_id, score, *double_array(keys))


def viterbi(units: list[bytes], v: Vocabulary) -> list[list[int]]:
    """The best path of each unit; of equal ones that with the longest last pieces."""
    out: list[list[int]] = [[] for _ in units]
    order = sorted(range(len(units)), key=lambda i: len(units[i]))
    for a in range(0, len(order), 4096):
        rows = order[a : a + 4096]
        size = np.array([len(units[i]) for i in rows])
        width = int(size.max(initial=0))
        if a + 4096 >= len(order) and width > 4 * max(1, int(np.median(size))) and len(rows) > 1:  # very long ones alone
            cut = int(np.searchsorted(size, 4 * max(1, int(np.median(size)))))
            groups = [rows[:cut], *[[r] for r in rows[cut:]]]
        else:
            groups = [rows]
        for group in groups:
            for i, ids in zip(group, _paths([units[i] for i in group], v), strict=True):
                out[i] = ids
    return out


def _paths(units: list[bytes], v: Vocabulary) -> list[list[int]]:
    size = np.array([len(u) for u in units])
    n, width = len(units), int(size.max(initial=0))
    data = np.zeros((n, width), dtype=np.int64)
    data[np.repeat(np.arange(n), size), ragged(np.zeros(n, np.int64), size)] = np.frombuffer(b"".join(units), np.uint8)
    best = np.full((n, width + 1), -np.inf)
    best[:, 0] = 0
    piece, length = np.zeros((n, width + 1), np.int32), np.zeros((n, width + 1), np.int32)
    for i in range(width):
        rows = np.flatnonzero(size > i)
        here = best[rows, i]
        byte = v.byte_id[data[rows, i]]
        total = here + v.score[byte]
        better = total > best[rows, i + 1]
        r = rows[better]
        best[r, i + 1], piece[r, i + 1], length[r, i + 1] = total[better], byte[better], 1
        state = np.zeros(len(rows), dtype=np.int64)
        for j in range(i, width):
            inside = size[rows] > j
            rows, here, state = rows[inside], here[inside], state[inside]
            if not len(rows):
                break
            to = v.base[state] + data[rows, j] + 1
            to[to >= len(v.check)] = 0
            go = v.check[to] == state
            rows, here, state = rows[go], here[go], to[go]
            if not len(rows):
                break
            found = v.value[state]
            has = found >= 0
            total = here[has] + v.score[found[has]]
            better = total > best[rows[has], j + 1]
            r = rows[has][better]
            best[r, j + 1], piece[r, j + 1], length[r, j + 1] = total[better], found[has][better], j + 1 - i
    out = []
    for u in range(n):
        ids, at = [], int(size[u])
        while at:
            ids.append(int(piece[u, at]))
            at -= int(length[u, at])
        out.append(ids[::-1])
    return out


class Encoder(WordStore):
    """Ids of whole texts; the ids of each distinct unit are kept."""

    def __init__(self, vocabulary: Vocabulary, keep: int = _KEPT):
        self.v = vocabulary
        sizes = np.array([len(p) for p in vocabulary.pieces])
        self.piece_size, self.piece_at = sizes, np.cumsum(sizes) - sizes
        self.piece_bytes = np.frombuffer(b"".join(vocabulary.pieces), np.uint8)
        super().__init__(keep)

    def _learn(self, units: list[str]) -> None:
        found = viterbi([u.encode() for u in units], self.v)
        for k, u in enumerate(units):
            self.word[u] = self.n + k
        self._add(found)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after another, and how many each has; no text, no ids."""
        units: list[str] = []
        ends = []
        for text in texts:
            if text:
                units += _UNITS.findall(" " + text)
            ends.append(len(units))
        return self._ids(units, ends)

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The texts' bytes: pieces one after another, the first blank of each text gone."""
        length = self.piece_size[ids]
        raw = self.piece_bytes[ragged(self.piece_at[ids], length)].tobytes()
        end = np.append(0, np.cumsum(length))[np.append(0, np.cumsum(sizes))].tolist()
        return [raw[a:b][1:] for a, b in zip(end[:-1], end[1:], strict=True)]


def _encoder(path: str, shared) -> Encoder:
    """One for each worker process and model: what it has learned serves its later tasks."""
    return runtime.kept("unigram", path, lambda: Encoder(shared.value))


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def encode(documents: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, ids (array<int>), n_tokens, ids_crc32, restored for every document.

    restored: decoding the ids gives the text's bytes again.  Null and empty
    texts have no ids.  Repeated rows are each encoded.
    """
    spark = documents.sparkSession
    path = model or default_model()
    shared = spark.sparkContext.broadcast(load(path))

    def each(batches):
        encoder = _encoder(path, shared)
        for batch in batches:
            for part in chunks(batch.column(1)):
                own = batch.column(1).slice(part.rows.start, len(part))
                ids, sizes = encoder.encode(own.to_pylist())
                back = encoder.decode(ids, sizes)
                ends = np.append(0, np.cumsum(sizes))
                raw = ids.astype("<u4")
                crc = [zlib.crc32(raw[a:b].tobytes()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                restored = [x == part.text(i) for i, x in enumerate(back)]
                arrays = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.rows.start, len(part)), arrays, pa.array(sizes.astype(np.int64)), pa.array(crc, pa.int64()), pa.array(restored, pa.bool_())], names=["doc_id", "ids", "n_tokens", "ids_crc32", "restored"])

    return runtime.plain(documents, doc_id="long", text="string").mapInArrow(runtime.task(each, "unigram"), "doc_id long, ids array<int>, n_tokens long, ids_crc32 long, restored boolean")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, text of rows (doc_id, ids); null ids give null, bytes that are no UTF-8 the replacement character."""
    shared = encoded.sparkSession.sparkContext.broadcast(load(model or default_model()))

    def each(batches):
        encoder = Encoder(shared.value)
        for batch in batches:
            ids = [None if x is None else np.array(x, dtype=np.int64) for x in batch.column(1).to_pylist()]
            own = [x for x in ids if x is not None]
            texts = iter(encoder.decode(np.concatenate([*own, np.empty(0, np.int64)]).astype(np.int64), np.array([len(x) for x in own], dtype=np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else next(texts).decode("utf-8", "replace") for x in ids], pa.string())], names=["doc_id", "text"])

    return runtime.plain(encoded, doc_id="long", ids="array<int>").mapInArrow(runtime.task(each), "doc_id long, text string")


def op8_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_tokens", "ids_crc32", "restored")
