"""Language ID: interpolated Kneser-Ney character models in sorted hash arrays.

Texts become letters and single blanks (everything else is a blank, letters in
lower case), and each run is scored by the models of all languages at once.
Languages stand in groups of at most GROUP.  The n-grams of one order, of the
languages of a group, are one sorted array of 64-bit hashes with a row of log
probabilities (a column a language), so a text costs one binary search per
character, order that is needed and group: an n-gram unseen in the group falls
back to the next lower order with each language's weight of its context.  What is
stored is at most GROUP numbers an n-gram of a language, however many languages
there are.  The language of least cross-entropy per character wins.

N-grams are counted over the whole texts of all labelled documents outside fold
0, and the model holds every one of them, so it grows with the distinct n-grams
of the corpus; totals, kinds and continuation counts are of all of them too.  Who
asks for a `min_share` gets a smaller model: the rarer n-grams of the highest
order then leave it, after all statistics are taken.  A rejection limit is
calibrated on all the same documents, scored on the executors, of which only
figures come back: a text is rejected when its cross-entropy lies well above what
any document of its language has, allowing for short texts.  Who asks for
`calibration_docs` has about so many a language scored instead.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime
from .text import U64, chunks, mix

ORDER = 4
_MERGE = 1 << 20
FOLDS = 5
UNKNOWN = "und"
GROUP = 8
_BLANK = U64(32)
_SHORT = 24.0


@lru_cache(maxsize=1)
def _folding() -> np.ndarray:
    """Code point to its lower-case letter (16 bits; higher ones share 0xFFFF), or a blank."""
    table = np.full(0x110000, 32, dtype=np.uint16)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = min(ord(low[0]) if low else c, 0xFFFF)
    return table


def letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, n + 1 offsets): letters and single blanks of each text, one blank first; empty without letters."""
    joined = "\x00".join([t if t else "" for t in texts.to_pylist()] + [""])
    code = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32)
    symbol = _folding()[code]
    cut = code == 0
    # a zero byte inside a text is a blank too, so count only the ones that were put in
    if int(cut.sum()) != len(texts):
        return letters(pa.array([t.replace("\x00", " ") if t else t for t in texts.to_pylist()], pa.string()))
    symbol[cut] = 0
    blank = (symbol == 32) | cut
    keep = np.ones(len(symbol), dtype=bool)
    keep[1:] = ~(blank[1:] & blank[:-1] & ~cut[1:])
    if len(keep):
        keep[0] = True
    # a text's runs end at its zero; blanks just before the zero go
    symbol, cut = symbol[keep], cut[keep]
    ends = np.flatnonzero(cut)
    has = np.diff(np.append(-1, ends)) > 1
    solid = symbol > 32
    count = np.diff(np.append(0, np.cumsum(solid)[ends])) if len(ends) else np.empty(0, np.int64)
    offsets = np.append(0, ends + 1)
    symbol[cut] = 32  # the closing blank of a text is the opening one of the next
    return symbol, np.stack([offsets[:-1], offsets[1:], np.where(has, count, 0)])


def keys(symbol: np.ndarray, order: int) -> np.ndarray:
    """The packed n-gram that ends at each symbol: 16 bits a symbol, blanks before the first."""
    out = symbol.astype(U64)
    for back in range(1, order):
        before = np.full(len(symbol), _BLANK, dtype=U64)
        before[back:] = symbol[:-back]
        out |= before << U64(16 * back)
    return out


@dataclass
class Table:
    """The models of some languages: sorted hashes by order, from 1."""

    hashes: list[np.ndarray]
    logp: list[np.ndarray]  # rows as hashes, a column a language
    backoff: list[np.ndarray]  # of the n-gram as a context
    floor: np.ndarray

    def logs(self, full: np.ndarray) -> np.ndarray:
        """The log probability of the last symbol of each packed n-gram: a column a language."""
        order = len(self.hashes)
        out = np.zeros((len(full), len(self.floor)), dtype=np.float32)
        todo = np.arange(len(full))
        for k in range(order, 0, -1):
            gram = full[todo] if k == 4 else full[todo] & U64((1 << 16 * k) - 1)
            h = mix(gram)
            table = self.hashes[k - 1]
            at = np.minimum(np.searchsorted(table, h), len(table) - 1)
            seen = table[at] == h
            out[todo[seen]] += self.logp[k - 1][at[seen]]
            todo, gram = todo[~seen], gram[~seen]
            if not len(todo):
                break
            if k == 1:
                out[todo] += self.floor
            else:
                h = mix(gram >> U64(16))
                table = self.hashes[k - 2]
                at = np.minimum(np.searchsorted(table, h), len(table) - 1)
                known = table[at] == h
                out[todo[known]] += self.backoff[k - 2][at[known]]
        return out


@dataclass
class Model:
    languages: list[str]
    tables: list[Table]
    order: int
    mean: np.ndarray
    spread: np.ndarray
    limit: float = np.inf

    def score(self, symbol: np.ndarray, spans: np.ndarray) -> np.ndarray:
        """Cross-entropy per character: a row a text, a column a language."""
        full, start, end = keys(symbol, self.order), spans[0], spans[1]
        parts = []
        for table in self.tables:
            out = table.logs(full)
            total = np.zeros((len(full) + 1, out.shape[1]))
            np.cumsum(out, axis=0, dtype=np.float64, out=total[1:])
            parts.append(total[end] - total[start])
        return -np.concatenate(parts, axis=1) / np.maximum(end - start, 1)[:, None]

    def excess(self, entropy: np.ndarray, best: np.ndarray, size: np.ndarray) -> np.ndarray:
        """How far a text's cross-entropy lies above its language's mean, in spreads that widen for short texts."""
        return (entropy - self.mean[best]) / (self.spread[best] * np.sqrt(1 + _SHORT * _SHORT / np.maximum(size, 1)))


def kneser_ney(counts: list[np.ndarray], grams: np.ndarray, order: int = ORDER, discount: float = 0.75) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """From the distinct highest-order n-grams (packed) and their counts: (n-gram, log p, log backoff) by order."""
    by_order: list = [None] * order
    own, n = grams, counts.astype(np.float64)
    for k in range(order, 0, -1):
        by_order[k - 1] = (own, n)
        if k > 1:  # continuation counts: how many distinct symbols stand before
            shorter = own & U64((1 << 16 * (k - 1)) - 1)
            own, n = np.unique(shorter, return_counts=True)
            n = n.astype(np.float64)
    out = []
    lower_g = lower_p = None
    for k in range(1, order + 1):
        g, c = by_order[k - 1]
        if k == 1:
            p = c / c.sum()
            base = 1.0 / (len(g) + 1)
            p = np.maximum(c - discount, 0) / c.sum() + discount * len(g) / c.sum() * base
        else:
            context, inverse = np.unique(g >> U64(16), return_inverse=True)
            total = np.bincount(inverse, weights=c)
            kinds = np.bincount(inverse)
            weight = discount * kinds / total
            at = np.searchsorted(lower_g, g & U64((1 << 16 * (k - 1)) - 1))
            p = np.maximum(c - discount, 0) / total[inverse] + weight[inverse] * lower_p[at]
            at = np.searchsorted(out[-1][0], context)
            hit = (at < len(out[-1][0])) & (out[-1][0][np.minimum(at, len(out[-1][0]) - 1)] == context)
            out[-1][2][at[hit]] = np.log(weight[hit])
        out.append((g, np.log(p), np.zeros(len(g))))
        lower_g, lower_p = g, p
    return out


def build(languages: list[str], tables: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER, min_share: float = 0.0, group: int = GROUP) -> Model:
    """The models of all languages; tables: a language's distinct n-grams and their counts."""
    own = [_table(languages[i : i + group], tables, order, min_share) for i in range(0, len(languages), group)]
    one = np.ones(len(languages))
    return Model(languages, own, order, one * 0, one)


def _table(languages: list[str], tables: dict[str, tuple[np.ndarray, np.ndarray]], order: int, min_share: float) -> Table:
    fitted = [kneser_ney(tables[x][1], tables[x][0], order) for x in languages]
    if min_share:
        for x, f in zip(languages, fitted, strict=True):
            often = tables[x][1] >= min_share * tables[x][1].sum()
            f[-1] = tuple(column[often] for column in f[-1])
    floor = np.array([np.log(0.75 / (len(f[0][0]) + 1) / 10) for f in fitted])
    hashes, logp, backoff = [], [], []
    below: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for k in range(order):
        grams = np.unique(np.concatenate([f[k][0] for f in fitted]))
        lp, bo = np.zeros((len(grams), len(languages))), np.zeros((len(grams), len(languages)))
        for j, f in enumerate(fitted):
            g, p, b = f[k]
            at = np.searchsorted(g, grams)
            seen = (at < len(g)) & (g[np.minimum(at, len(g) - 1)] == grams)
            lp[seen, j], bo[seen, j] = p[at[seen]], b[at[seen]]
            rest = grams[~seen]
            if k == 0:
                lp[~seen, j] = floor[j]
            elif len(rest):
                bg, bl, bb = below[0][0], below[0][1], below[0][2]
                a = np.searchsorted(bg, rest & U64((1 << 16 * k) - 1))
                c = np.searchsorted(bg, rest >> U64(16))
                known = (c < len(bg)) & (bg[np.minimum(c, len(bg) - 1)] == rest >> U64(16))
                lp[~seen, j] = bl[a, j] + np.where(known, bb[np.minimum(c, len(bg) - 1), j], 0)
        below = [(grams, lp, bo)]
        h = mix(grams)
        rank = np.argsort(h)
        hashes.append(h[rank])
        logp.append(lp[rank].astype(np.float32))
        backoff.append(bo[rank].astype(np.float32))
    return Table(hashes, logp, backoff, floor.astype(np.float32))


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def sampled(documents: DataFrame, per_language: dict[str, int], bound: int, salt: int) -> DataFrame:
    """About `bound` documents a language, the same ones whatever the partitions."""
    share = F.lit(0.0)
    for lang, n in per_language.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, bound / n))).otherwise(share)
    return documents.where(F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1_000_000)) < share * 1_000_000)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of all parts and their summed counts."""
    grams, n = np.concatenate([g for g, _ in parts]), np.concatenate([n for _, n in parts])
    own, at = np.unique(grams, return_inverse=True)
    return own, np.bincount(at, weights=n).astype(np.int64)


def counted(train: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, n): n-grams of whole texts (text, lang), merged within a task before the shuffle."""

    def count(batches):
        kept: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            for lang in dict.fromkeys(langs):
                own = batch.column(0).filter(pa.array(langs == lang))
                for part in chunks(own):
                    symbol, _ = letters(own.slice(part.rows.start, len(part)))
                    g, n = np.unique(keys(symbol, order), return_counts=True)
                    kept.setdefault(lang, []).append((g, n))
                    size += len(g)
                    if size > _MERGE:
                        kept = {x: [merged(parts)] for x, parts in kept.items()}
                        size = sum(len(parts[0][0]) for parts in kept.values())
                        if size > _MERGE // 2:
                            yield from sent(kept)
                            kept, size = {}, 0
        yield from sent(kept)

    def sent(kept):
        for lang, parts in kept.items():
            g, n = merged(parts)
            for at in range(0, len(g), 1 << 16):
                own = g[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(own.view(np.int64)), pa.array(n[at : at + (1 << 16)])], names=["lang", "gram", "n"])

    return train.select("text", "lang").mapInArrow(runtime.task(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(documents: DataFrame, order: int = ORDER, min_share: float = 0.0, calibration_docs: int | None = None) -> Model | None:
    """Models of all languages of the labelled documents (doc_id, text, lang) outside fold 0; None without any."""
    train = documents.where((fold(F.col("doc_id")) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    grams = runtime.written(counted(train, order), "grams")
    rows = grams.toArrow()
    runtime.dropped(grams)
    if not rows.num_rows:
        return None
    lang = rows["lang"].to_numpy()
    gram, n = rows["gram"].to_numpy().astype(np.int64).view(U64), rows["n"].to_numpy()
    tables = {}
    for x in sorted(set(lang)):
        own = lang == x
        rank = np.argsort(gram[own])
        tables[x] = (gram[own][rank], n[own][rank])
    model = build(sorted(tables), tables, order, min_share)

    shared = documents.sparkSession.sparkContext.broadcast(model)

    def figures(batches):
        for batch in batches:
            for part in chunks(batch.column(0)):
                symbol, span = letters(batch.column(0).slice(part.rows.start, len(part)))
                e = shared.value.score(symbol, span)
                best = e.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(best), pa.array(e[np.arange(len(e)), best]), pa.array(span[2])], names=["best", "entropy", "size"])

    held = train
    if calibration_docs is not None:
        sizes = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
        held = sampled(train, sizes, calibration_docs, 2)
    # three numbers a document; what reaches the driver is a row a language, then one number
    held = runtime.written(held.select("text").mapInArrow(runtime.task(figures), "best long, entropy double, size long").where("size > 0"), "figures")
    for r in held.groupBy("best").agg(F.count(F.lit(1)).alias("n"), F.avg("entropy").alias("mean"), F.stddev_pop("entropy").alias("spread")).where("n > 1").collect():
        model.mean[r["best"]], model.spread[r["best"]] = r["mean"], max(r["spread"], 1e-3)
    scale = Model(model.languages, [], order, model.mean, model.spread)

    def furthest(batches):
        for batch in batches:
            best, entropy, size = (c.to_numpy() for c in batch.columns)
            yield pa.RecordBatch.from_arrays([pa.array([np.max(scale.excess(entropy, best, size), initial=3.0)])], names=["excess"])

    most = held.mapInArrow(runtime.task(furthest), "excess double").agg(F.max("excess").alias("excess")).first()["excess"]
    model.limit = (3.0 if most is None else most) * 2.5
    runtime.dropped(held)
    shared.unpersist()
    return model


def identify(documents: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, entropy, rejected, for every document.

    lang_pred is the language of least cross-entropy per character (ties: the
    first by name), also for rejected texts; `und`, rejected, score 0 where the
    text is null, empty or has no letter, or nothing could be learned.  score is
    the winner's share of exp(-4 H).  Repeated rows are each predicted.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def predict(batches):
        m = shared.value
        for batch in batches:
            for part in chunks(batch.column(1)):
                n = len(part)
                pred, score, entropy, rejected = np.full(n, UNKNOWN, dtype=object), np.zeros(n), np.full(n, np.nan), np.ones(n, bool)
                if m is not None:
                    symbol, spans = letters(batch.column(1).slice(part.rows.start, n))
                    has = spans[2] > 0
                    if has.any():
                        e = m.score(symbol, spans)
                        best = e.argmin(axis=1)
                        least = e[np.arange(n), best]
                        pred = np.where(has, np.array(m.languages, dtype=object)[best], UNKNOWN)
                        score = np.where(has, 1 / np.exp(-4 * (e - least[:, None])).sum(axis=1), 0.0)
                        entropy = np.where(has, least, np.nan)
                        rejected = ~has | (m.excess(least, best, spans[2]) > m.limit)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.rows.start, n), pa.array(pred, pa.string()), pa.array(score), pa.array(entropy, from_pandas=True), pa.array(rejected)],
                    names=["doc_id", "lang_pred", "score", "entropy", "rejected"],
                )

    return runtime.plain(documents, doc_id="long", text="string").mapInArrow(runtime.task(predict), "doc_id long, lang_pred string, score double, entropy double, rejected boolean")


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned outside fold 0."""
    documents = runtime.plain(spark.read.parquet(f"{sf_dir}/documents.parquet"), doc_id="long", text="string", lang="string")
    found = identify(documents, fit(documents))
    return found.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score", "entropy", "rejected")
