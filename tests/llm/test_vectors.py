"""Whitening and vector codes against plain numpy, with every awkward row."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from cellweave.llm import vector_codes as vc, whitening as wh

# other columns bear the names that the operators use inside
SCHEMA = "vec_id long, embedding array<float>, label int, x string, _e string, code string, i int, j int"
INFINITE = float("inf")


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "e", "c", 1, 2) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    mix = rng.normal(size=(12, 12))
    points = (rng.normal(size=(300, 12)) @ mix * 0.1 + 3).astype(np.float32).tolist()
    out = [(i, p, i % 5 if i % 7 else None) for i, p in enumerate(points)]
    out += [out[3], out[3], (None, points[8], 2), (900, points[9], None)]
    return out


BAD = [(700, None, 1), (701, [], 1), (702, [1.0, None] * 6, 1), (703, [float("nan")] * 12, 1), (704, [INFINITE] + [0.0] * 11, 2), (705, [1.0] * 11, 2)]


def kept(rows, scale, shift):
    return np.array([[math.floor(scale * float(np.float32(c))) + shift for c in r[1]] for r in rows])


def test_whitening_is_that_of_numpy(spark, rows):
    x = kept(rows, 64, 1_000_000)
    n, d = x.shape
    centred = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    want = centred @ vectors / np.sqrt(values)
    got = wh.whitened(table(spark, rows + BAD), count=8, tile=5, block_entries=240).collect()
    assert len(got) == n * 8
    sums = x.sum(axis=0)
    exact = Counter((r[0], int(sum((n * int(v) - int(s)) ** 2 for v, s in zip(p, sums, strict=True)))) for r, p in zip(rows, x, strict=True))
    assert Counter((r.vec_id, r.deviation) for r in got if r.component == 1) == exact
    signs = {}
    by_id = {r[0]: k for k, r in enumerate(rows)}
    for r in got:
        value = want[by_id[r.vec_id], r.component - 1]
        assert r.n == n and r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9) and r.identity_error < 1e-9
        assert abs(r.whitened) == pytest.approx(abs(value), abs=1e-8)
        if abs(value) > 1e-6:
            assert signs.setdefault(r.component, r.whitened * value > 0) == (r.whitened * value > 0)


def test_tiles_and_blocks_of_any_size_give_one_covariance(spark, rows):
    found = wh.whole_vectors(table(spark, rows), wh.SCALE, wh.SHIFT)
    centre, x = wh.centre_of(found), kept(rows, 64, 1_000_000)
    assert (centre.n, list(centre.sums)) == (len(x), x.sum(axis=0).tolist())
    want = np.cov(x.T, bias=True)
    for tile, entries in ((1, 1), (5, 100), (16, 1 << 18)):
        assert wh.tiled_covariance(found, centre, tile, entries) == pytest.approx(want, rel=1e-9, abs=1e-9)


def test_whitening_without_variance(spark):
    rows = [(1, [1.0, 2.0, 5.0], 1), (2, [3.0, 2.0, 5.0], 1)]
    got = {(r.vec_id, r.component): r for r in wh.whitened(table(spark, rows)).collect()}
    assert [abs(got[1, k].whitened) if got[1, k].whitened is not None else None for k in (1, 2, 3)] == [1.0, None, None]
    assert got[2, 1].explained == 1.0 and got[2, 2].explained == 0.0 and got[1, 1].identity_error < 1e-12 and got[1, 1].deviation == 128 * 128
    alone = wh.whitened(table(spark, rows[:1])).collect()
    assert [(r.whitened, r.explained, r.deviation, r.identity_error) for r in alone] == [(None, 0.0, 0, None)] * 3
    assert wh.whitened(table(spark, BAD[:5])).collect() == []
    assert wh.whitened(table(spark, rows).limit(0)).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_whitening_of_huge_entries(spark):
    rows = [(1, [1e30, 0.0], 1), (2, [-1e30, 1.0], 1), (3, [0.0, 2.0], 1)]
    got = wh.whitened(table(spark, rows)).collect()
    assert {r.deviation for r in got if r.vec_id < 3} == {None}
    assert {r.vec_id: round(abs(r.whitened), 6) for r in got if r.component == 1} == {1: 1.224745, 2: 1.224745, 3: 0.0}


def plain_codes(rows, parts, entries, rounds):
    x = {k: kept([r], 256, 0)[0].tolist() for k, r in enumerate(rows)}
    order = sorted(x, key=lambda k: (rows[k][0] is None, rows[k][0] or 0, x[k]))
    d = len(x[0])
    w = -(-d // parts)
    x = {k: v + [0] * (w * parts - d) for k, v in x.items()}
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(x[k], p) for k in order[:entries]] for p in range(parts)]
    near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            used = defaultdict(list)
            for v in x.values():
                used[near(cut(v, p), book)[1]].append(cut(v, p))
            for i, own in used.items():
                book[i] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = {k: [near(cut(v, p), books[p]) for p in range(parts)] for k, v in x.items()}
    labels = defaultdict(int)
    for k, f in found.items():
        labels[rows[k][2]] += sum(e for e, _ in f)
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return Counter((rows[k][0], rows[k][2], "".join(f"{i:02x}" for _, i in f), sum(e for e, _ in f), labels[rows[k][2]], sha) for k, f in found.items())


@pytest.mark.parametrize(("parts", "entries", "rounds"), [(4, 20, 2), (5, 64, 1), (1, 1, 2), (3, 256, 2)])
def test_codes_are_those_of_plain_code(spark, rows, parts, entries, rounds):
    got = vc.codes(table(spark, rows + BAD), parts, entries, rounds)
    assert Counter(tuple(r) for r in got.collect()) == plain_codes(rows, parts, entries, rounds)


def test_codes_of_few_huge_and_no_rows(spark):
    rows = [(1, [1e30, 0.0], None), (2, [-1e30, 1.0], None), (3, [2.0**21, 2.0], 4)]
    got = {r.vec_id: r for r in vc.codes(table(spark, rows), 2, 2, 1).collect()}
    assert got[1].code[:2] == "00" and got[2].code[:2] == "01" and got[3].label_error == got[3].error
    assert vc.codes(table(spark, rows).limit(0)).collect() == []
    with pytest.raises(ValueError):
        vc.codes(table(spark, rows), entries=257)


def test_tree_finds_the_nearest_with_ties():
    rng = random.Random(4)
    for width, spread, k in ((1, 3, 40), (2, 4, 64), (4, 30, 64), (3, 1, 9), (2, 1 << 40, 30)):
        book = np.array([[rng.randint(-spread, spread) for _ in range(width)] for _ in range(k)])
        points = np.array([[rng.randint(-2 * spread, 2 * spread) for _ in range(width)] for _ in range(400)])
        want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(p, e, strict=True)), i) for i, e in enumerate(book)) for p in points]
        for leaf in (1, 4):
            index, best = vc.Search(book, leaf).nearest(points)
            assert list(zip((int(b) for b in best), index.tolist(), strict=True)) == want


def test_tree_prunes():
    rng = np.random.default_rng(1)
    book = rng.integers(-1000, 1000, (64, 2))
    search, tried = vc.Search(book), []
    plain = search._try
    search._try = lambda entry, rows: (tried.append(len(rows)), plain(entry, rows))[1]
    search.nearest(book[rng.integers(0, 64, 2000)] + rng.integers(-20, 20, (2000, 2)))
    assert sum(tried) < 0.5 * 64 * 2000
