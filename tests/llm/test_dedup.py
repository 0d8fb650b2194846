"""Shared windows of words and bytes, and the n-gram join, against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from cellweave.llm import bwt_dedup, ngram_join, repeats, substring_dedup
from cellweave.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BIG = (1 << 63) - 1


def windows(rows, split, size=50):
    first: dict = {}
    for d, t, *_ in rows:
        units = split(t or "")
        for i in range(len(units) - size + 1):
            w = tuple(units[i : i + size])
            first[w] = min(first.get(w, BIG), BIG if d is None else d)
    for d, t, *_ in rows:
        units = split(t or "")
        gone = [False] * len(units)
        for i in range(len(units) - size + 1):
            if first[tuple(units[i : i + size])] < (BIG if d is None else d):
                gone[i : i + size] = [True] * size
        yield d, units, gone


def test_words(docs, rows):
    expected = Counter((d, len(u), sum(g), hashlib.sha256(" ".join(w for w, x in zip(u, g, strict=True) if not x).encode()).hexdigest()) for d, u, g in windows(rows, WORD.findall))
    assert Counter(map(tuple, substring_dedup.shared_window_digests(docs).collect())) == expected


def test_bytes(docs, rows):
    def digest(d, u, g):
        spans = len(re.findall(r"1+", "".join("01"[x] for x in g)))
        return d, len(u), sum(g), spans, hashlib.sha256(bytes(b for b, x in zip(u, g, strict=True) if not x)).hexdigest()

    expected = Counter(digest(*x) for x in windows(rows, lambda t: list(t.encode())))
    assert Counter(map(tuple, bwt_dedup.shared_byte_digests(docs).collect())) == expected


@pytest.mark.parametrize("method", [substring_dedup.DIGEST, bwt_dedup.DIGEST])
def test_hot_minimisers_give_the_same(docs, method):
    rows = docs.select("doc_id", "text")
    one, two = (Counter(map(tuple, repeats.shared_windows(rows, method, ["doc_id"], hot).collect())) for hot in (2, repeats.HOT))
    assert one == two


def test_texts_keep_their_columns_and_layout(docs, rows, empty):
    out = substring_dedup.remove_shared_windows(docs)
    assert out.columns == [*docs.columns, "n_removed_words"] and out.count() == len(rows)
    untouched = {r.doc_id: r.text for r in out.filter("n_removed_words = 0 and doc_id < 60").collect()}
    assert untouched and all(rows[i][1] == t for i, t in untouched.items())
    assert bwt_dedup.remove_shared_bytes(docs).columns == [c for c in docs.columns if c != "kept"] + ["kept", "n_removed_bytes"]
    for f in (substring_dedup.remove_shared_windows, substring_dedup.shared_window_digests, bwt_dedup.remove_shared_bytes, bwt_dedup.shared_byte_digests):
        assert f(empty).count() == 0


def test_merged_transforms_find_all_repeats():
    rng = np.random.default_rng(0)
    shards = [np.append(rng.integers(97, 99, n).astype(np.uint8), np.uint8(255)) for n in (200, 1, 333)]
    text, k = np.concatenate(shards), 7
    found: dict = {}
    for i in range(len(text) - k + 1):
        if 255 not in text[i : i + k]:
            found.setdefault(bytes(text[i : i + k]), set()).add(i)
    places, heads, common = bwt_dedup.repeated_intervals(shards, k)
    got = [set(x.tolist()) for x in np.split(places, heads[1:])] if len(places) else []
    assert sorted(map(sorted, got)) == sorted(sorted(x) for x in found.values() if len(x) > 1)
    for n, c in enumerate(common.tolist()):  # the longest prefix that stands elsewhere, in steps of two bytes
        own = max((j for j in range(k + 1) if 255 not in text[n : n + j] and n + j <= len(text) and sum(bytes(text[n : n + j]) == bytes(text[i : i + j]) for i in range(len(text) - j + 1)) > 1), default=0)
        assert c in ({own, own - 1} if 0 < own < k else {own})


def test_the_merge_reads_the_transforms():
    """With a shard's transform out of order the intervals are wrong: they come from its symbols and counts."""
    rng = np.random.default_rng(1)
    shards = [np.append(np.frombuffer(bytes(rng.choice([97, 98], 60).tolist()) + b"x" * i, np.uint8), np.uint8(255)) for i in range(2)]
    shards[1][:51] = shards[0][:51]
    shards[1][50] = 195 - shards[0][50]
    made = [bwt_dedup.transform(s, 56) for s in shards]
    place = np.concatenate([made[0][0], made[1][0] + len(shards[0])])
    rows, heads, _ = bwt_dedup.merged([t for _, t in made], 50)
    assert sorted(place[rows].tolist()) == [0, len(shards[0])] and len(heads) == 1
    shuffled = made[1][1].copy()
    rng.shuffle(shuffled)
    rows, _, _ = bwt_dedup.merged([made[0][1], shuffled], 50)
    assert sorted(place[rows].tolist()) != [0, len(shards[0])]


def thue_morse(n: int) -> str:
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_that_cancel_in_sums_of_powers_are_told_apart(spark, n):
    """Polynomial hashes modulo 2^64 are equal for these two words, whatever the multiplier."""
    x = thue_morse(n)
    y = x.translate({97: 98, 98: 97})
    rest = [f"w{i}" for i in range(49)]
    rows = [(1, " ".join([*rest[:20], x, *rest[20:]])), (2, " ".join([*rest[:20], y, *rest[20:]])), (3, x), (4, y), (5, x)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup.shared_window_digests(docs).collect()} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 0}
    assert {r.doc_id: r.component_id for r in ngram_join.jaccard_components(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 3}


def test_window_numbers_are_exact():
    rng = np.random.default_rng(2)
    for n, window in ((300, 50), (60, 7), (40, 1), (40, 2), (40, 40)):
        code = rng.integers(0, 2, n)
        code[n // 2 :] = code[: n - n // 2]
        number = substring_dedup.window_numbers(code, window)
        runs = [tuple(code[i : i + window]) for i in range(n - window + 1)]
        assert len(number) == len(runs) and len(set(zip(number.tolist(), runs, strict=True))) == len(set(runs)) == len(set(number.tolist()))


def linked(rows, size, percent):
    sets = {}
    for d, t, *_ in rows:
        words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(t or "")]
        if d is not None:
            sets[d] = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} or ({tuple(words)} if words else set())
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(s), root(d)) for d, s in sets.items()}


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80), (1, 50)])
def test_jaccard_components(docs, rows, empty, size, percent):
    got = ngram_join.jaccard_components(docs, size, percent).collect()
    assert len(got) == len(rows)
    expected = linked(rows, size, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == expected
    assert all(r.component_id is None for r in got if r.doc_id is None)
    assert ngram_join.jaccard_components(empty, size, percent).count() == 0


def test_near_misses_in_one_large_group(spark):
    base = [f"w{i}" for i in range(120)]
    rows = []
    for d in range(60):
        words = base.copy()
        for j in range(d % 5):
            words[(d * 7 + j * 23) % 120] = f"own{d}-{j}"
        rows.append((d, " ".join(words)))
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == linked(rows, 4, 85)


def test_repeated_rows_keep_their_links(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(0, text), (0, text), (1, text + " tail"), (1, text + " tail"), (None, text)]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None) == [(0, 0), (0, 0), (1, 0), (1, 0)]


@pytest.mark.parametrize("mixed", [0, 30])
def test_very_mixed_shingles_lose_no_link(spark, monkeypatch, mixed):
    """Groups of near copies of which only some are alike enough, with the mixed way for nearly all shingles."""
    monkeypatch.setattr(ngram_join, "MIXED", mixed)
    rng, rows = np.random.default_rng(11), []
    for group in range(3):
        base = [f"g{group}w{i}" for i in range(60 + 20 * group)]
        for d in range(40):
            words = base.copy()
            for j in rng.choice(len(base), int(rng.integers(0, 5)), replace=False):
                words[j] = f"own{rng.integers(0, 60)}"
            rows.append((100 * group + d, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for size, percent in ((4, 85), (5, 80)):
        got = ngram_join.jaccard_components(docs, size, percent).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == linked(rows, size, percent)


@pytest.mark.parametrize("shingles", [150, 2000])
def test_mixed_shingles_are_met_in_bounded_groups(spark, monkeypatch, shingles):
    """However many mixed shingles classes share, a class travels once for each side that it meets, and a group holds two sides."""
    monkeypatch.setattr(ngram_join, "SIDE_SHINGLES", shingles)
    classes, tokens = [i for i in range(200) if i != 50], 40
    open_ = spark.createDataFrame([(t, i, 10, t % 7) for t in range(tokens) for i in classes] + [(99, i, 10, 0) for i in (50, 51)], "token long, id long, n long, at long")
    roots = spark.createDataFrame([(i, i // 2) for i in range(200)], "id long, root long")
    thin = spark.createDataFrame([(i, bytes(20)) for i in range(200)], "id long, thin binary")
    rows = ngram_join._sides(open_, roots, thin).collect()
    sides = -(-len(classes) * 10 // shingles)
    assert {(r.bundle, r.at, r.n) for r in rows} == {(0, 0, 10)}  # 50 and 51, alone at shingle 99, are one component
    assert len(rows) == len(classes) * sides and len({(r.id, r.low, r.high) for r in rows}) == len(rows)
    groups: dict = {}
    for r in rows:
        groups.setdefault((r.low, r.high), {})[r.id] = r.side
    assert all(10 * len(g) <= 2 * 2 * shingles for g in groups.values())
    met = [(a, b) for (low, high), g in groups.items() for a in g for b in g if a < b and (low == high or g[a] != g[b])]
    assert len(met) == len(set(met)) == len(classes) * (len(classes) - 1) // 2


def test_sides_of_mixed_shingles_lose_no_link(spark, monkeypatch):
    """Classes on different sides are compared as those on the same."""
    monkeypatch.setattr(ngram_join, "MIXED", 0)
    monkeypatch.setattr(ngram_join, "SIDE_SHINGLES", 100)
    asked, plain = [], ngram_join._likeliest
    monkeypatch.setattr(ngram_join, "_likeliest", lambda sides, percent, top: (asked.append(sides.agg({"high": "max"}).first()[0]), plain(sides, percent, top))[1])
    rng, rows = np.random.default_rng(12), []
    for group in range(2):
        base = [f"g{group}w{i}" for i in range(60 + 30 * group)]
        for d in range(50):
            words = base.copy()
            for j in rng.choice(len(base), int(rng.integers(0, 5)), replace=False):
                words[j] = f"own{rng.integers(0, 80)}"
            rows.append((100 * group + d, " ".join(words)))
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == linked(rows, 4, 85)
    assert asked[0] > 2


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (101, 100)]
    roots = {}
    for r in components(spark.createDataFrame(chain, "a long, b long")).collect():
        roots.setdefault(r.root, set()).add(r.vertex)
    assert sorted(map(sorted, roots.values())) == [list(range(41)), [100, 101]]


def likely_by_all_pairs(members, thin, top):
    """Every class outside the largest component against every other."""
    alive, minor = members.alive()
    seen, out, all_ = set(), [], True
    for u in minor.tolist():
        seen.add(u)
        own, found = set(thin[u].tolist()), []
        for v in alive.tolist():
            if v not in seen and members.possible(np.array([u]), np.array([v]))[0]:
                most = sum(x in own for x in thin[v].tolist())
                if 100 * most >= members.percent * (members.n[u] + members.n[v] - most):
                    found.append((-most, members.ids[v], v))
        all_ &= len(found) <= top
        out += [(u, v) for _, _, v in sorted(found)[:top]]
    return set(out), all_


@pytest.mark.parametrize("bits", [0xFFFF, 0x3F])
def test_likeliest_classes_at_a_mixed_shingle(bits):
    """No alike pair is lost, whatever shingles the 16 bits throw together."""
    rng = np.random.default_rng(bits)
    for _ in range(25):
        base, sets = [np.unique(rng.integers(0, 1 << 62, rng.integers(4, 60))) for _ in range(8)], []
        for _ in range(40):
            s = base[rng.integers(8)].copy()
            some = rng.integers(0, len(s), rng.integers(0, max(1, len(s) // 8) + 1))
            s[some] = rng.integers(0, 1 << 62, len(some))
            sets.append(np.unique(s))
        thin = [(s & bits).astype(np.uint16) for s in sets]
        members = ngram_join.Members(rng.permutation(40), np.array([len(s) for s in sets]), np.array([rng.integers(0, max(1, len(s) // 7)) for s in sets]), rng.integers(0, 12, 40), 85)
        every, _ = likely_by_all_pairs(members, thin, 40)
        for top in (1, 40):
            left, right, all_ = members.likeliest(thin, top)
            got = set(zip(left.tolist(), right.tolist(), strict=True))
            assert got <= every and (all_ or top == 1)
            if all_:
                overlap = {(u, v): len(np.intersect1d(sets[u], sets[v])) for u, v in every}
                assert {p for p, o in overlap.items() if 100 * o >= 85 * (len(sets[p[0]]) + len(sets[p[1]]) - o)} <= got


def test_unlike_classes_at_one_shingle_are_hardly_compared(monkeypatch):
    rng, looked = np.random.default_rng(3), []
    plain = ngram_join.Members.possible
    monkeypatch.setattr(ngram_join.Members, "possible", lambda self, u, v: (looked.append(len(v)), plain(self, u, v))[1])
    thin = [np.append(rng.integers(0, 1 << 16, 200), 7).astype(np.uint16) for _ in range(20_000)]
    members = ngram_join.Members(np.arange(20_000), np.full(20_000, 201), np.zeros(20_000, int), np.arange(20_000), 85)
    left, _, all_ = members.likeliest(thin, 1)
    assert not len(left) and all_ and sum(looked) < 20 * 20_000
