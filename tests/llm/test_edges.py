"""Nulls, empty and long texts, ties, repeated rows, empty tables, extra columns; brute force on small fixtures."""

import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinvec.llm import ann, embed_dedup, exchange, langid, license_scan, ngram_join, packing, quality_fm, runtime, substring_dedup, suffix_dedup, text, unigram

RNG = random.Random(5)
WORDS = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 7))) for _ in range(300)]


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


def texts():
    base, long = prose(120), prose(6000)
    near = base.split()
    near[60] = "changed"
    passage = prose(60)
    return [
        None, "", "  \n\t ", "one two", "One  TWO", base, base, " ".join(near), prose(80) + " " + passage + " " + prose(30), passage + prose(50),
        long, "a" * 700, "xy " * 300, "é▁ü 日本語 ﬁ 👍🏽\x00\x1c ends", "All rights reserved. CC BY cc-by, general\npublic license; All Rights Reserved", long[:9000] + prose(10),
    ]


TEXTS = texts()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(5, TEXTS[5]), (None, "no id at all " * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"k": F.lit("clash"), "h": F.lit(1), "words": F.lit(2.5), "n": F.lit(3), "lang": F.when(F.col("doc_id") % 2 == 0, "aa").otherwise("bb"), "source": F.lit(None).cast("string")}).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def pairs(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def words_of(t):
    return re.findall(b"[^\x20\x09-\x0d]+", (t or "").encode())


def test_substring_dedup(docs, none):
    rows = sorted(set(pairs(docs)), key=lambda r: (r[0] is not None, r[0] or 0))
    seen, want = {}, {}
    for i, t in rows:
        w = words_of(t)
        gone = set()
        for a in range(len(w) - 19):
            if seen.setdefault(tuple(w[a : a + 20]), (i, a)) != (i, a):
                gone.update(range(a, a + 20))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        want[i] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    got = substring_dedup.dedup(docs).collect()
    assert len(got) == docs.count()
    assert all((r["n_words"], r["n_removed"], r["kept_sha256"]) == want[r["doc_id"]] for r in got)
    assert substring_dedup.dedup(none).count() == 0


def brute_repeats(rows):
    """{id: (bytes, removed, spans, sha256)} of rows (id, text)."""
    count = Counter(b[a : a + 200] for _, t in rows for b in [(t or "").encode()] for a in range(len(b) - 199))
    want = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for a in range(len(b) - 199):
            if count[b[a : a + 200]] > 1:
                gone[a : a + 200] = True
        kept = bytes(x for x, g in zip(b, gone[:-1], strict=True) if not g)
        want[i] = (len(b), len(b) - len(kept), int((gone[:-1] & ~np.append(False, gone[:-2])).sum()) if len(b) else 0, hashlib.sha256(kept).hexdigest())
    return want


@pytest.mark.parametrize("crowd", [4096, 1])
def test_suffix_dedup(docs, none, crowd):
    rows = pairs(docs)
    want = brute_repeats(rows)
    got = suffix_dedup.dedup(docs, crowd).collect()
    assert len(got) == len(rows)
    assert all((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]] for r in got)
    assert suffix_dedup.dedup(none).count() == 0


def test_a_passage_of_many_texts_and_rows_that_repeat(spark):
    passage = prose(45)
    rows = [(i, prose(12) + passage + prose(12)) for i in range(40)] + [(100, passage[:198] + "x"), (101, passage)]
    own = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_repeats(rows)
    for crowd in (3, 4096):
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.dedup(own, crowd).collect()}
        assert got == want
    # a thousand equal rows, half of them of one doc_id, cost no more than their number
    same = spark.range(1000).selectExpr("if(id < 500, 5000, id) AS doc_id", "'X' AS text").withColumn("text", F.lit(passage))
    got = suffix_dedup.dedup(own.union(same)).collect()
    assert len(got) == len(rows) + 1000 and all(r["n_removed"] == r["n_bytes"] for r in got if r["doc_id"] == 101 or r["doc_id"] >= 500)
    docs_ = suffix_dedup.runtime.plain(own.union(same), doc_id="long", text="string").selectExpr("xxhash64(text) AS h", "xxhash64(1, text) AS h2", "text")
    assert suffix_dedup.marks(docs_.dropDuplicates(["h", "h2"])).count() < 42 * 12


def test_blocks_of_a_long_text_in_segments():
    raw = np.frombuffer((prose(400) + prose(30) * 20).encode(), np.uint8)
    part = suffix_dedup.Chunk(raw, np.array([0, len(raw)]), slice(0, 1))
    for segment in (300, 1000, 1 << 22):
        row, first, n, anchor, block = suffix_dedup.blocks(part, segment=segment)
        starts = np.concatenate([np.arange(a, a + k) for a, k in zip(first, n, strict=True)])
        assert (starts == np.arange(len(raw) - 199)).all() and (row == 0).all() and n.max() <= 161


def test_common_prefixes_of_the_merge():
    rng = random.Random(3)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(8, 60))) * 2 for _ in range(9)]
    size = np.array([len(s) for s in strings])
    symbol = suffix_dedup.words_of(np.frombuffer(b"".join(strings), np.uint8), size)
    first = np.append(0, np.cumsum(size + 1))
    shards = [suffix_dedup.Shard(symbol[first[a] : first[b]], size[a:b]) for a, b in ((0, 3), (3, 4), (4, 9))]
    order = np.concatenate([s.order + first[a] for s, a in zip(shards, (0, 3, 4), strict=True)])
    suffix = []
    for s, n in enumerate(size):
        suffix += [[strings[s][i : i + 8] for i in range(p, n - 7, 8)] + [("end", s, p % 8)] for p in range(n + 1)]
    alike = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    rounds = 4
    at, interval, common = suffix_dedup.merged(shards, rounds)
    best = [max(alike(a, b) for j, b in enumerate(suffix) if j != i) for i, a in enumerate(suffix)]
    assert sorted(order[at].tolist()) == [i for i, b in enumerate(best) if b >= rounds]
    for a, b, p, q in zip(at[:-1], at[1:], interval[:-1], interval[1:], strict=True):
        assert (p == q) == (alike(suffix[order[a]], suffix[order[b]]) >= rounds) == (common[b] == rounds)
    assert all(c <= best[order[i]] for i, c in enumerate(common))


@pytest.mark.parametrize("shard_bytes", [300, 900, 1 << 18])
def test_merged_transforms(shard_bytes):
    rng = random.Random(shard_bytes)
    base = [bytes(rng.choice(b"ab") for _ in range(330)) for _ in range(4)]
    strings = [base[0][:250], base[1][20:290], base[0][10:260], base[2], base[1][30:], b"a" * 220, b"a" * 230, base[3]]
    count = Counter(s[i : i + 200] for s in strings for i in range(len(s) - 199))
    want = [(n, i) for n, s in enumerate(strings) for i in range(len(s) - 199) if count[s[i : i + 200]] > 1]
    a, b = suffix_dedup.repeated(strings, shard_bytes=shard_bytes)
    assert list(zip(a.tolist(), b.tolist(), strict=True)) == want


def similar_fixture():
    out = [t for t in TEXTS if t is not None]
    for size in (1, 2, 5, 6, 9, 14, 30, 75, 200):
        base = [RNG.choice(WORDS) for _ in range(size + 4)]
        for edits in range(0, 1 + size // 9):
            own = list(base)
            for _ in range(edits):
                own[RNG.randrange(len(own))] = "z" + RNG.choice(WORDS)
            out.append(" ".join(own))
            out.append(" ".join(base[: len(base) - edits]))
    return out


def test_ngram_join(spark, docs, none):
    own = similar_fixture()
    df = spark.createDataFrame([(100 - i, t) for i, t in enumerate(own)] + [(7777, None)], "doc_id long, text string")
    sets = {}
    for i, t in [(100 - i, t) for i, t in enumerate(own)] + [(7777, None)]:
        w = [x.lower() for x in words_of(t)]
        sets[i] = frozenset(tuple(w[a : a + 5]) for a in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b and 100 * len(a & b) >= 80 * len(a | b):
                lo, hi = sorted((find(i), find(j)))
                parent[hi] = lo
    got = {r["doc_id"]: r for r in ngram_join.join(df).collect()}
    assert len(got) == len(sets)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: (len(s), find(i)) for i, s in sets.items()}
    assert ngram_join.join(docs).count() == docs.count()
    assert ngram_join.join(none).count() == 0


def test_every_similar_pair_shares_a_signature():
    rng = np.random.default_rng(1)
    for size in [1, 2, 4, 5, 8, 12, 30, 100, 400]:
        for _ in range(40):
            a = rng.integers(1, 2**63, size).astype(np.uint64)
            drop = int(rng.integers(0, size // 9 + 1))
            b = np.concatenate([a[drop:], rng.integers(1, 2**63, int(rng.integers(0, size // 9 + 1))).astype(np.uint64)])
            a, b = np.unique(a), np.unique(b)
            both = len(np.intersect1d(a, b))
            row, s = ngram_join.signatures(np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b]), np.array([len(a), len(b)]))
            if 100 * both >= 80 * (len(a) + len(b) - both):
                assert set(s[row == 0]) & set(s[row == 1])


def brute_components(own):
    """(size, least id reachable) of rows (id, text), by all pairs."""
    sets = {}
    for i, t in own:
        w = [x.lower() for x in words_of(t)]
        sets[i] = frozenset(tuple(w[a : a + 5]) for a in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b and 100 * len(a & b) >= 80 * len(a | b):
                lo, hi = sorted((find(i), find(j)))
                parent[hi] = lo
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_clusters():
    """Two clusters of texts with one to three words changed, and texts that only share a passage."""
    out = []
    for _ in range(2):
        base = prose(70).split()
        for k in range(45):
            own = list(base)
            for at in RNG.sample(range(len(own)), 1 + k % 3):
                own[at] = f"z{RNG.randrange(10**6)}"
            out.append(" ".join(own))
    passage = prose(40)
    return out + [passage + " " + prose(30) for _ in range(20)]


def test_shares_of_any_size_lose_no_link(spark):
    own = [(500 - i, t) for i, t in enumerate(near_clusters())]
    want = brute_components(own)
    assert len({c for _, c in want.values()}) < len(own) - 20
    df = spark.createDataFrame(own, "doc_id long, text string").repartition(3)
    for share in (2_000, 8_000, ngram_join.SHARE):
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(df, share).collect()} == want


def test_texts_without_a_partner_are_not_shuffled(spark, monkeypatch):
    """Only the sets that meet others leave the tasks, though the table of them is too large to be broadcast by Spark."""
    alone = [(i, " ".join(f"{RNG.getrandbits(40):x}" for _ in range(400))) for i in range(400)]
    near = prose(400)
    df = spark.createDataFrame([*alone, (900, near), (901, near + " more"), (902, near), (902, near)], "doc_id long, text string")
    moved, write = {}, runtime.written

    def sent():
        time.sleep(0.5)
        return sum(x.totalShuffleWrite() for x in [spark._jsc.sc().statusStore().executorList(False).apply(0)])

    def counted(table, name):
        before = sent()
        out = write(table, name)
        moved[name] = moved.get(name, 0) + sent() - before
        return out

    monkeypatch.setattr(runtime, "written", counted)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r["doc_id"]: r["component_id"] for r in ngram_join.join(df).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {i: i for i, _ in alone} | {900: 900, 901: 900, 902: 900}
    assert moved.get("met", 0) + moved["members"] > 500_000  # signatures of all
    assert moved["links"] + moved.get("contents", 0) + moved.get("keys", 0) < 200_000


def test_pivots_whose_sets_all_meet_elsewhere_are_left_out(spark):
    groups = {1: [1, 2, 3, 4], 2: [2, 3], 3: [3, 4, 5], 5: [5, 6], 4: [4], 7: [7, 8, 9], 8: [8, 9]}
    rows = spark.createDataFrame([(p, s, 1) for p, own in groups.items() for s in own], "pivot long, sid long, n long")
    left = defaultdict(set)
    for r in ngram_join.needed(rows).collect():
        left[r["pivot"]].add(r["sid"])
    assert left == {p: set(groups[p]) for p in (1, 3, 5, 7)}


def test_a_filter_of_hashes_loses_none(spark):
    hashes = np.random.default_rng(3).integers(-(2**63), 2**63 - 1, 20_000)
    for most in (30, 12):  # bits enough, and far too few
        found = exchange.members(spark.createDataFrame([(int(h),) for h in hashes[:5_000]], "t long"), 5_000, most)
        assert found.may(hashes[:5_000]).all()
        assert most == 12 or found.may(hashes[5_000:]).mean() < 0.05
    nothing = exchange.members(spark.createDataFrame([], "t long"), 0)
    assert not nothing.may(hashes).any() and len(nothing.may(hashes[:0])) == 0


def test_only_joining_links_leave_a_share():
    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(1, 2**63, 400).astype(np.uint64))
    sets = [np.unique(np.append(base[rng.random(len(base)) > 0.04], rng.integers(1, 2**63, 5).astype(np.uint64))) for _ in range(60)]
    n = np.array([len(s) for s in sets])
    h = np.concatenate(sets)
    near = lambda i, j: 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))
    for c in (np.arange(60), np.arange(60) // 20):
        a, b = ngram_join.joining(h, n, c, np.arange(60))
        assert len(a) == len(np.unique(c)) - 1 and all(near(i, j) for i, j in zip(a, b, strict=True))


def test_a_null_id_is_linked(spark):
    a, b = near_clusters()[:2]
    rows = {r["doc_id"]: r["component_id"] for r in ngram_join.join(spark.createDataFrame([(None, a), (7, a), (9, a + " more")], "doc_id long, text string")).collect()}
    assert rows == {None: 7, 7: 7, 9: 7}


def test_packing(docs, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    got = packing.pack(docs).collect()
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
        assert r["length"] <= 2048
    for i, t in pairs(docs):
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4")
        own = sorted({(r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in by[i]})
        import zlib

        assert own == [(a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes()), len(ids)) for a in range(0, len(ids), 2048)]
    at = defaultdict(list)
    for r in got:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in at.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 2048
    assert packing.pack(none).count() == 0


def test_units_of_odd_words_are_those_of_the_tokenizer():
    """Texts cut by bytes give the ids of the whole tokenizer."""
    from tokenizers import Tokenizer

    r = random.Random(4)
    odd = ["a", "É", "é", "×", "÷", "ß", "À", "'", "'s", "'ll", "<|", "<", "|", "<|endoftext|>", " ", "\n", "\u00a0", "\x0b", "\x85", "1", "23", "½", "İ", "ſ", "e\u0301", "中", "…", ".", "!?", "\x00", "_", "Σ", "the", "Hello"]
    texts = [None, "", "  ", "É", *["".join(r.choices(odd, k=r.randint(1, 12))) for _ in range(3000)]]
    tokenizer, own = Tokenizer.from_file(packing.default_tokenizer()), packing.WordTokenizer(packing.default_tokenizer())
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [own(t).tolist() for t in texts] == want
    for target in (40, 1 << 20):  # rows that share a chunk never share a word
        found = [own.encode(part) for part in text.chunks(pa.array(texts), target)]
        assert np.concatenate([ids for ids, _ in found]).tolist() == [i for ids in want for i in ids]
        assert np.concatenate([n for _, n in found]).tolist() == list(map(len, want))


def test_a_word_is_learned_once():
    """Its case and the marks beside it do not make it another word."""
    own = packing.WordTokenizer(packing.default_tokenizer())
    before, words = own.n, [f"q{chr(97 + i // 26)}{chr(97 + i % 26)}zx" for i in range(600)]
    own(" ".join(mark.join((kind(w), "")) for w in words for kind in (str.lower, str.upper, str.title) for mark in (",", ".", ";", "!?", "")))
    assert own.n - before <= 604


def test_bin_slack():
    out = packing.patterns({5: 3, 7: 2, 3: 4, 10: 1}, 10)
    assert Counter({k: sum(own.get(k, 0) * n for own, n in out) for k in (3, 5, 7, 10)}) == Counter({5: 3, 7: 2, 3: 4, 10: 1})
    assert all(sum(k * m for k, m in own.items()) <= 10 for own, _ in out)
    assert sum(n for own, n in out if sum(k * m for k, m in own.items()) == 10) >= 4


def test_unigram(docs, none):
    v = unigram.load(unigram.default_model())
    ids = {p: i for i, p in enumerate(v.pieces) if len(p) and i not in set(v.byte_id.tolist())}

    def best(b):
        top = [0.0] + [-np.inf] * len(b)
        for e in range(1, len(b) + 1):
            for s in range(max(0, e - 50), e):
                if b[s:e] in ids:
                    top[e] = max(top[e], top[s] + v.score[ids[b[s:e]]])
            top[e] = max(top[e], top[e - 1] + v.score[v.byte_id[b[e - 1]]])
        return top[-1]

    units = [u.encode() for u in unigram._UNITS.findall(" Hello  world\n the thing éü ▁x 日本 " + "abc" * 30)]
    for u, path in zip(units, unigram.viterbi(units, v), strict=True):
        assert abs(v.score[path].sum() - best(u)) < 1e-9
    out = unigram.encode(docs)
    assert out.where("not restored").count() == 0 and out.count() == docs.count()
    back = {r["doc_id"]: r["text"] for r in unigram.decode(out).collect()}
    assert all(back[i] == (t or "") for i, t in pairs(docs))
    assert unigram.encode(none).count() == 0


def test_license_scan(docs, none):
    got = {r["doc_id"]: r for r in license_scan.scan(docs).collect()}
    for i, t in pairs(docs):
        low = (t or "").translate({c: c + 32 for c in range(65, 91)})
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
        at = [(k, label) for phrase, label in license_scan.BASE for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(w), len(at))
        assert (r["first_word"], r["last_word"]) == (min((k for k, _ in at), default=None), max((k for k, _ in at), default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in at})) and 0 <= r["score"] <= 1
    assert license_scan.scan(none).count() == 0


def test_license_rules(spark):
    df = spark.createDataFrame([(1, "Licensed under the Apache License, Version 2.0."), (2, "SPDX-License-Identifier: MIT OR Apache-2.0"), (3, "This program is licensed under the GNU General Public License, version 3")], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in license_scan.scan(df).collect()}
    assert got == {1: "apache-2.0", 2: "spdx", 3: "gpl,gpl-3.0"}
    for _, key, _, _, pattern in license_scan.rules():
        assert any(stem in pattern.replace("[cs]e", "ce").replace("\\(c\\)", "(c)") or stem in key for stem in license_scan.STEMS), pattern


def plain_scan(text):
    """(labels of the rules, score) by a plain loop: every rule whose keywords are there, every place, every pair of places."""
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    spans = []
    if any(stem in low for stem in license_scan.STEMS):
        for i, (label, key, also, priority, pattern) in enumerate(license_scan.rules()):
            if key in low and also in low:
                spans += [(m.start(), m.end(), priority, label, i) for m in re.finditer(pattern, low, re.ASCII)]
    beats = lambda t, s: t[0] <= s[0] and t[1] >= s[1] and (t[2] > s[2] or (t[2] == s[2] and (t[1] - t[0] > s[1] - s[0] or (t[1] - t[0] == s[1] - s[0] and t[4] < s[4]))))
    return sorted(s for s in spans if not any(beats(t, s) for t in spans))


def test_license_rules_by_a_plain_loop(spark):
    rng = random.Random(12)
    names = ["MIT License", "GNU Lesser General Public License, version 2.1", "the Apache License, Version 2.0", "CC BY-SA 4.0", "cc-by-nc 3.0", "GPLv3+", "BSD license", "(c) 2019 - 2021", "© 2020", "All rights reserved"]
    forms = ["Licensed under the {}", "This work by me is dual-licensed under the terms of the {}", "license: {}", "{}", "Released under {}", "the software is provided \"as is\", without warranty of any kind {}", "Copyright (c) 1999 {}"]
    own = [(i, " \n".join(rng.choice(forms).format(rng.choice(names)) + rng.choice(["", ". ", " é ", " x "]) for _ in range(rng.randrange(1, 40)))) for i in range(60)]
    texts = own + [(r["doc_id"] + 1000, r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    low = license_scan._lower(F.coalesce("text", F.lit("")))
    gate = F.lit(False)
    for stem in license_scan.STEMS:
        gate = gate | F.contains(low, F.lit(stem))
    got = df.select("doc_id", F.when(gate, license_scan.detections(low)).alias("d")).collect()
    want = {i: plain_scan(t) for i, t in texts}
    for r in got:
        assert sorted(tuple(x) for x in r["d"] or []) == want[r["doc_id"]], r["doc_id"]
    assert sum(map(len, want.values())) > 500


def test_a_text_of_many_places(spark):
    import time

    text = "licensed under the mit license. (c) 2020 " * 6000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    r = license_scan.scan(df).first()
    assert (r["n_detections"], r["labels"]) == (12_000, "copyright,mit") and time.time() - began < 60


def spelled(parsed):
    """Texts that match a parsed expression: every alternative, optional part, member of a set (of a range its ends) once."""
    out = [""]
    for op, av in parsed:
        kind = str(op)
        if kind == "LITERAL":
            ways = [chr(av)]
        elif kind == "IN":
            ways = [w for o, v in av for w in ([chr(v)] if str(o) == "LITERAL" else [chr(v[0]), chr(v[1])] if str(o) == "RANGE" else [" "])]
        elif kind == "SUBPATTERN":
            ways = spelled(av[3])
        elif kind == "BRANCH":
            ways = [w for branch in av[1] for w in spelled(branch)]
        elif kind == "MAX_REPEAT":
            least, most, inner = av
            ways = [""] * (least == 0) + [w * max(least, 1) for w in spelled(inner)]
        else:
            assert kind == "ASSERT_NOT", kind
            continue
        # each way with the first beginning, and each beginning with the first way: no product of all choices
        out = [out[0] + w for w in ways] + [x + ways[-1] for x in out[1:]]
    return out


def test_every_license_rule_passes_its_keywords(spark):
    bad = []
    for label, key, also, _, pattern in license_scan.rules():
        for text in spelled(re._parser.parse(pattern)):
            assert re.search(pattern, text), (pattern, text)
            if key not in text or also not in text or not any(stem in text for stem in license_scan.STEMS):
                bad.append((label, key, also, text))
    assert not bad, bad[:5]
    df = spark.createDataFrame([(1, "Distributed under the MIT license."), (2, "the GNU Library General Public License"), (3, "without warranties or conditions of any kind")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.scan(df).collect()}
    assert got[1]["labels"] == "mit" and abs(got[1]["score"] - 0.8) < 1e-9
    assert got[2]["labels"] == "gpl,lgpl" and got[2]["n_detections"] == 1
    assert got[3]["labels"] == "warranty"


def test_langid(spark, docs, none):
    sf = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(sf.select("doc_id", "text", "lang"), calibration_docs=50)
    got = langid.identify(sf, model).join(sf.select("doc_id", "lang"), "doc_id").where(langid.fold(F.col("doc_id")) == 0)
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97
    assert got.agg(F.avg(F.col("rejected").cast("double"))).first()[0] < 0.01
    odd = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert all(odd[i]["lang_pred"] == "und" and odd[i]["rejected"] and odd[i]["score"] == 0 for i in (0, 1, 2))
    assert langid.fit(none.select("doc_id", "text", "lang")) is None
    few = langid.fit(sf.select("doc_id", "text", "lang"), min_share=1e-3, calibration_docs=50)
    assert len(few.tables[0].hashes[-1]) <= 1000 * len(few.languages) < len(model.tables[0].hashes[-1])


def test_langid_keeps_rare_grams(spark):
    """One 4-gram of over two million; the statistics of lower orders are of all n-grams, also where few are kept."""
    long = "ab cd " * 450_000
    rows = [(i, long if i == 1 else "rare wxyz", "aa") for i in range(1, 9)] + [(20 + i, "zyxw only once", "bb") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    train = df.where(langid.fold(F.col("doc_id")) != 0)
    assert train.where("doc_id = 1").count() == 1 and train.where("text = 'rare wxyz'").count() > 0
    grams = {r["gram"] for r in langid.counted(train).collect()}
    model, few = langid.fit(df), langid.fit(df, min_share=1e-3)
    want = langid.mix(np.array(sorted(grams), dtype=np.int64).view(np.uint64))
    model, few = model.tables[0], few.tables[0]
    assert set(model.hashes[-1].tolist()) == set(want.tolist())
    assert len(few.hashes[-1]) < len(model.hashes[-1])
    for k in range(langid.ORDER - 1):
        assert np.array_equal(few.hashes[k], model.hashes[k]) and np.array_equal(few.logp[k], model.logp[k])


def test_counted_covers_all_texts(spark, docs, monkeypatch):
    monkeypatch.setattr(langid, "_MERGE", 64)
    want = Counter()
    for r in docs.where("text is not null").select("text", "lang").collect():
        run = " " + re.sub(" +", " ", "".join(c.lower()[0] if c.isalpha() and ord(c.lower()[0]) < 0xFFFF else " " for c in r["text"])).lstrip(" ")
        want[r["lang"]] += len(run.rstrip(" ")) if run.strip() else 0
    got = {r["lang"]: r["n"] for r in langid.counted(docs.where("text is not null")).groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    assert all(want[x] <= got[x] <= want[x] + 2 * docs.count() for x in want)
    assert langid.identify(docs, None).where("lang_pred <> 'und'").count() == 0


def test_quality(spark, docs, none):
    sf = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    own = quality_fm.with_metadata(sf)
    machine = quality_fm.fit(own, labels)
    held = quality_fm.score(own, machine).join(labels, "doc_id").where(langid.fold(F.col("doc_id")) == 0)
    assert held.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0] > 0.95
    got = quality_fm.score(quality_fm.with_metadata(docs), machine)
    assert got.count() == docs.count() and got.where("score is null or score < 0 or score > 1").count() == 0
    assert quality_fm.score(quality_fm.with_metadata(none), machine).count() == 0
    assert quality_fm.fit(own, labels.where("false")).bias == 0


def test_factorisation_machine_is_the_sum_over_pairs():
    rng = np.random.default_rng(2)
    m = quality_fm.Machine(0.3, rng.normal(size=50), rng.normal(size=(50, 4)))
    f, x = np.array([3, 9, 20, 31]), rng.normal(size=4)
    want = 0.3 + (m.weight[f] * x).sum() + sum((m.factor[f[i]] @ m.factor[f[j]]) * x[i] * x[j] for i in range(4) for j in range(i))
    assert abs(m.logits(np.array([0, 4]), f, x)[0] - want) < 1e-9


@pytest.fixture(scope="module")
def embeddings(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 16))
    base[100:140] = base[100] + 0.15 * rng.normal(size=(40, 16))
    base[150] = base[200]
    rows = [(i, v.astype(float).tolist(), int(i % 3 if not 100 <= i < 140 else 1)) for i, v in enumerate(base)]
    rows[200] = (200, rows[150][1], rows[150][2])
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] * 16, 1), (503, [None] + [1.0] * 15, 1), (504, [float("inf")] * 16, 1), (505, [1.0, 2.0], 1), (506, rows[0][1], None), (507, [], 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("v", F.lit("clash")).cache()


def test_embed_dedup(embeddings):
    rows = embeddings.collect()
    ok = [r for r in rows if r["label"] is not None and r["embedding"] and len(r["embedding"]) == 16 and all(x is not None and np.isfinite(x) for x in r["embedding"]) and any(r["embedding"])]
    x = np.array([r["embedding"] for r in ok])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    label = np.array([r["label"] for r in ok])
    link = (unit @ unit.T >= 0.93) & (label[:, None] == label[None])
    np.fill_diagonal(link, False)
    root = embed_dedup.roots(*np.nonzero(link), len(ok))
    want = {r["vec_id"]: (0, r["vec_id"]) for r in rows} | {r["vec_id"]: (int(link[i].sum()), ok[root[i]]["vec_id"]) for i, r in enumerate(ok)}
    for block in (1024, 8):
        got = embed_dedup.links(embeddings, block=block).collect()
        assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == want and len(got) == len(rows)
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert embed_dedup.links(embeddings.where("false")).count() == 0


def test_ann(spark, embeddings):
    got = ann.search(embeddings, every=10, k=5, target=1.0).collect()
    ok = [r for r in embeddings.collect() if r["vec_id"] < 300]
    ok += [r for r in embeddings.collect() if r["vec_id"] == 506]
    x, ids = np.array([r["embedding"] for r in ok], dtype=np.float64), np.array([r["vec_id"] for r in ok])
    hits = total = 0
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: r["rank"]):
        by[r["query_id"]].append(r)
    assert set(by) == {i for i in range(300) if i % 10 == 0}
    for q, own in by.items():
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        near = np.lexsort((ids, d))[:5]
        hits += len(set(ids[near]) & {r["vec_id"] for r in own})
        total += 5
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5]
        assert all(r["score"] == d[ids == r["vec_id"]][0] for r in own)
    assert hits / total >= 0.9
    assert ann.search(embeddings.where("false")).count() == 0


def plain_kneser_ney(texts, order, discount=0.75):
    """Log probability of a symbol after a context, from dictionaries; texts are lists of symbols, blanks before the first."""
    top = Counter()
    for s in texts:
        for i in range(len(s)):
            top[tuple([32] * max(0, order - 1 - i) + s[max(0, i - order + 1) : i + 1])] += 1
    counts = [None] * order
    counts[order - 1] = dict(top)
    for k in range(order - 2, -1, -1):
        own = Counter()
        for g in counts[k + 1]:
            own[g[1:]] += 1
        counts[k] = dict(own)
    kinds = len(counts[0])
    total = [Counter() for _ in range(order)]
    branches = [Counter() for _ in range(order)]
    for k in range(order):
        for g, c in counts[k].items():
            total[k][g[:-1]] += c
            branches[k][g[:-1]] += 1

    def p(g):
        k = len(g) - 1
        if k == 0:
            if g not in counts[0]:
                return discount / (kinds + 1) / 10
            return max(counts[0][g] - discount, 0) / total[0][()] + discount * kinds / total[0][()] / (kinds + 1)
        weight = discount * branches[k][g[:-1]] / total[k][g[:-1]] if g[:-1] in total[k] and g[:-1] in counts[k - 1] else None
        if g in counts[k]:
            return max(counts[k][g] - discount, 0) / total[k][g[:-1]] + discount * branches[k][g[:-1]] / total[k][g[:-1]] * p(g[1:])
        return p(g[1:]) * (1 if weight is None else weight)

    return lambda g: math.log(p(g))


def test_kneser_ney_by_dictionaries():
    rng = random.Random(21)
    languages = {f"l{j}": [[32] + [rng.choice(letters) for _ in range(60)] for _ in range(5)] for j, letters in enumerate(([97, 98, 32], [98, 99, 100, 32], [97, 100, 101], [120, 121, 32]))}
    tables = {}
    for name, texts in languages.items():
        grams = np.concatenate([langid.keys(np.array(s, np.uint16), langid.ORDER) for s in texts])
        tables[name] = np.unique(grams, return_counts=True)
    models = [langid.build(sorted(tables), tables, group=g) for g in (1, 3, 8)]
    asked = [[32] + [rng.choice([97, 98, 99, 100, 120, 32, 55]) for _ in range(40)] for _ in range(6)]
    symbol = np.array(sum(asked, []), np.uint16)
    full = langid.keys(symbol, langid.ORDER)
    for model in models:
        logs = np.concatenate([t.logs(full) for t in model.tables], axis=1)
        for j, name in enumerate(model.languages):
            plain = plain_kneser_ney(languages[name], langid.ORDER)
            for i in range(len(symbol)):
                gram = tuple([32] * max(0, langid.ORDER - 1 - i) + [int(x) for x in symbol[max(0, i - langid.ORDER + 1) : i + 1]])
                assert abs(logs[i, j] - plain(gram)) < 1e-4, (name, gram)


def test_vectors_keep_their_precision_and_labels(spark):
    base = [1.0, 2.0, 3.0, 4.0]
    rows = [(i, "x", [b + (1e-9 * i if j == 0 else 0) for j, b in enumerate(base)]) for i in range(0, 14)] + [(100, "x", [1e300, 2e300, 3e300, 4e300]), (200, "y", [-0.0, 1.0, 0.0, 0.0]), (201, "y", [0.0, 1.0, 0.0, 0.0]), (201, "y", [0.0, 2.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")
    got = {r["rank"]: (r["vec_id"], r["score"]) for r in ann.search(df.where("vec_id < 100")).where("query_id = 0").collect()}
    assert [got[k][0] for k in sorted(got)] == list(range(1, 11)) and all(abs(s / (1e-9 * i) - 1) < 1e-6 for i, s in got.values())
    many = ann.search(df).where("query_id = 100 and rank = 1").first()
    assert many["score"] > 1e299 and np.isfinite(many["score"])
    r = {(x["vec_id"], x["n_links"]): x["component_id"] for x in embed_dedup.links(df).collect()}
    assert r[100, 14] == 0 and r[13, 14] == 0 and r[200, 2] == 200 and r[201, 2] == 200
    assert ann.search(spark.createDataFrame([(0, [1.0]), (0, [2.0]), (5, [4.0])], "vec_id long, embedding array<double>").withColumn("label", F.lit(1))).collect()[0]["score"] == 3.0


def test_another_kind_of_tokenizer_is_refused(tmp_path):
    import json

    assert packing._word_pattern(packing.default_tokenizer()).startswith("'s|")
    spec = json.load(open(packing.default_tokenizer(), encoding="utf-8"))
    spec["normalizer"] = None
    (tmp_path / "other.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="only kind"):
        packing._word_pattern(str(tmp_path / "other.json"))


def test_repeated_rows_are_one_component(spark):
    a = " ".join(f"w{i}" for i in range(30))
    rows = [(3, a), (3, a), (3, a + " x"), (8, a), (9, None), (9, ""), (4, "other words")]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(3, 26, 3), (3, 26, 3), (3, 27, 3), (4, 1, 4), (8, 26, 3), (9, 0, 9), (9, 0, 9)]


def test_large_leaves_are_split(spark):
    rng = np.random.default_rng(31)
    x = rng.normal(size=(3000, 6)) + 4 * rng.integers(0, 3, (3000, 1))
    x[2900:] = x[2899]  # a hundred equal ones can't be told apart
    df = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)], "vec_id long, label int, embedding array<double>").repartition(4)
    rows = ann.vectors.read(df).select("vec_id", "v")
    tree = ann.fit(x[:40], 8)
    indexed, levels = ann.refined(ann.runtime.written(ann.index(rows, tree), "index"), most=60, sample=200, leaf_rows=20)
    sizes = {r["leaf"]: r["count"] for r in indexed.groupBy("leaf").count().collect()}
    assert levels and sum(sizes.values()) == 3000 and indexed.select("vec_id").distinct().count() == 3000
    assert sorted(n for n in sizes.values() if n > 60)[1:] == [] and max(sizes.values()) < 170
    assert all(ann.way(leaf)[0] < tree.leaves and ann.way(leaf)[-1] == leaf for leaf in sizes)
    got = defaultdict(list)
    for r in ann.search(df, every=50, k=10, sample=300, most=60).collect():
        got[r["query_id"]].append(r["vec_id"])
    found = []
    for i in range(0, 3000, 50):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        limit = np.sort(d)[9]
        assert len(got[i]) == 10
        found += [d[j] <= limit for j in got[i]]
    assert np.mean(found) >= 0.9


def test_language_ties_and_very_long_texts(spark):
    train = [(i, prose(40), lang) for i, lang in enumerate(["aa", "bb"] * 12)]
    same = [(i, train[0][1], lang) for i, lang in enumerate(["bb", "aa"] * 12)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, lang string")
    tied = langid.fit(frame(same))
    assert [r["lang_pred"] for r in langid.identify(frame([(1, train[0][1], None)]), tied).collect()] == ["aa"]  # the first by name
    other = [(100 + i, " ".join("xyzw"[(i + j) % 4] * 3 for j in range(40)), "xx") for i in range(24)]
    model = langid.fit(frame(train + other))
    long_ = " ".join([other[0][1]] * 9000)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(frame([(1, long_, None), (2, other[1][1], None), (3, "1 2 3", None)]), model).collect()}
    assert len(long_) > 1 << 20 and got == {1: "xx", 2: "xx", 3: "und"}



def test_a_written_table_leaves_no_shuffle_files(spark):
    folders = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    files = lambda: {p for d in folders for p in Path(d).rglob("shuffle_*.data")}
    before = files()
    out = runtime.written(spark.range(20_000).groupBy((F.col("id") % 5000).alias("k")).count(), "shuffled")
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before
    assert out.agg(F.sum("count")).first()[0] == 20_000


def test_what_a_worker_keeps_is_bounded():
    class Plain(packing.WordStore):
        def _learn(self, words):
            for k, w in enumerate(words):
                self.word[w] = self.n + k
            self._add([[len(w)] for w in words])

    store = Plain(packing._WORDS_KEPT)
    for i in range(0, 1_200_000, 40_000):
        ids, sizes = store._ids([f"{k:x}" for k in range(i, i + 40_000)], [40_000])
        assert sizes.tolist() == [40_000] and ids[-1] == len(f"{i + 39_999:x}")
        assert store.n <= 600_000
    text.powers(1 << 20)
    list(runtime.task(lambda batches: iter(batches))([1]))
    assert not text._POW


def test_the_rejection_limit_is_of_all_documents(spark):
    """Of 1500 documents a sample of 400 would leave most out: mean, spread and greatest excess are of all outside fold 0."""
    rows = [(i, prose(3 + i % 40), "aa") for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df)
    own = langid.identify(df.where(langid.fold(F.col("doc_id")) != 0), model).toPandas()
    assert len(own) > 1000
    assert abs(model.mean[0] - own["entropy"].mean()) < 1e-9 and abs(model.spread[0] - own["entropy"].std(ddof=0)) < 1e-9
    size = {i: sum(c.isalpha() for c in t) for i, t, _ in rows}
    excess = model.excess(own["entropy"].to_numpy(), np.zeros(len(own), int), own["doc_id"].map(size).to_numpy())
    assert abs(model.limit - 2.5 * max(3.0, excess.max())) < 1e-9
