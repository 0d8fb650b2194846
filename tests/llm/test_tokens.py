"""Token counts, packing and sampled pieces against the libraries, exact round trips and known distributions."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cellweave.llm import packing, piece_sampling as ps, token_counts

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def ids(rows):
    library = Tokenizer.from_file(BPE)
    return [(d, library.encode(t or "", add_special_tokens=False).ids) for d, t, *_ in rows]


def test_counts(docs, rows, ids, empty):
    expected = Counter((d, len((t or "").encode()), len(x)) for (d, t, *_), (_, x) in zip(rows, ids, strict=True))
    assert Counter(map(tuple, token_counts.token_counts(docs, BPE).collect())) == expected
    assert token_counts.token_counts(empty, BPE).count() == 0


def test_packing(docs, ids, empty):
    got = packing.packed(docs, BPE).collect()
    expected = Counter()
    for d, x in ids:
        own = [*x, 0]
        head = len(own) % 2048 or 2048
        cuts = [0, *range(head, len(own) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            expected[d, k, a, b - a, zlib.crc32(np.array(own[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    total = sum(r.length for r in got)
    assert len(bins) <= -(-total // 2048) + 2
    assert packing.packed(empty, BPE).count() == 0


@pytest.mark.parametrize("rule", ["residual_norm", "dot_product"])
def test_every_capacity_holds(rule):
    rng = np.random.default_rng(0)
    capacity = packing.Capacity(tokens=100, documents=4, attention_cost=4000, rule=rule)
    histogram = {int(n): int(k) for n, k in zip(*np.unique(rng.integers(1, 60, 3000), return_counts=True), strict=True)}
    used, seen = defaultdict(lambda: [0, 0, 0]), Counter()
    for length, low, high, first, places, offset in packing.plan(histogram, capacity):
        for rank in range(low, high):
            u = used[first + (rank - low) // places]
            assert u[0] == offset + (rank - low) % places * length
            for i, v in enumerate(capacity.vector(length)):
                u[i] += v
            seen[length] += 1
    assert seen == Counter(histogram) and all(a <= c for u in used.values() for a, c in zip(u, capacity.full(), strict=True))
    with pytest.raises(ValueError, match="capacity"):
        packing.plan({101: 1}, capacity)


@pytest.mark.parametrize("seed", range(3))
def test_the_plan_is_vector_best_fit(seed):
    """Piece by piece, longest first: the open bin that is left with the least weighted norm, if every capacity holds."""
    rng = np.random.default_rng(seed)
    capacity = packing.Capacity(tokens=100, documents=5, attention_cost=4500)
    lengths = sorted(rng.integers(1, 60, 150).tolist(), reverse=True)
    scale = [w / c for w, c in zip(capacity.weights, capacity.full(), strict=True)]
    bins: list[tuple[tuple, list]] = []
    for n in lengths:
        item = capacity.vector(n)
        fits = [(sum(((r - x) * s) ** 2 for r, x, s in zip(left, item, scale, strict=True)), left, i) for i, (left, _) in enumerate(bins) if all(a >= b for a, b in zip(left, item, strict=True))]
        i = min(fits)[2] if fits else len(bins)
        if not fits:
            bins.append((capacity.full(), []))
        bins[i] = (tuple(r - x for r, x in zip(bins[i][0], item, strict=True)), [*bins[i][1], n])
    made = defaultdict(list)
    for length, low, high, first, places, _ in packing.plan(dict(Counter(lengths)), capacity):
        for rank in range(low, high):
            made[first + (rank - low) // places].append(length)
    assert Counter(tuple(x) for x in made.values()) == Counter(tuple(x) for _, x in bins)


def test_repeated_rows_and_odd_columns_are_packed(spark):
    rows = spark.createDataFrame([(1, "a b", 7, 8)] * 3 + [(None, None, 0, 0)], "doc_id long, text string, length int, sequence_id int")
    got = packing.packed(rows, BPE).collect()
    assert len(got) == 4 and len({(r.sequence_id, r.offset) for r in got}) == 4


@pytest.mark.parametrize("n", [1024, 4096])
def test_stretches_that_cancel_in_sums_of_powers_are_told_apart(spark, n):
    x = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    text = f" {x} {x.translate({97: 98, 98: 97})}"
    docs = spark.createDataFrame([(1, text)] * 2, "doc_id long, text string")
    assert all(r.lossless for r in ps.digests(docs, PIECES).collect())
    assert [r.text for r in ps.decoded(ps.encoded(docs, PIECES), PIECES).collect()] == [text] * 2


def test_pieces_come_back(docs, rows, empty):
    encoded = ps.encoded(docs, PIECES)
    assert Counter(map(tuple, ps.decoded(encoded, PIECES).collect())) == Counter((d, t or "") for d, t, *_ in rows)
    digests = ps.digests(docs.repartition(7), PIECES).collect()
    assert all(r.lossless for r in digests)
    by_id = {r.doc_id: r.ids for r in encoded.filter("doc_id is not null").collect()}
    assert all(zlib.crc32(np.array(by_id[r.doc_id], "<u4").tobytes()) == r.ids_crc32 and len(by_id[r.doc_id]) == r.n_pieces for r in digests if r.doc_id is not None)
    other = ps.digests(docs, PIECES, ps.Sampling(seed=1)).filter("doc_id = 1").first()
    assert other.ids_crc32 != next(r for r in digests if r.doc_id == 1).ids_crc32
    assert ps.encoded(empty, PIECES).count() == 0 == ps.digests(empty, PIECES).count()


def test_segmentations_are_drawn_by_their_weight():
    pieces, how, n = ps.pieces_of(PIECES), ps.Sampling(), 20_000
    names = {bytes(pieces.bytes[a : a + s]): i for i, (a, s) in enumerate(zip(pieces.starts, pieces.sizes, strict=True)) if pieces.ranks[i] > 0}

    def ways(text: bytes):
        if not text:
            yield ()
        for k in range(1, len(text) + 1):
            if text[:k] in names:
                for rest in ways(text[k:]):
                    yield (names[text[:k]], *rest)

    every = list(ways(b" there"))
    weight = np.array([np.prod([(pieces.ranks[i] + how.offset) ** -how.alpha for i in w]) for w in every])
    drawn = Counter(tuple(x.tolist()) for x in ps.sample([" there"] * n, np.arange(n), pieces, how))
    assert max(abs(drawn[w] / n - p) for w, p in zip(every, weight / weight.sum(), strict=True)) < 0.015 and set(drawn) <= set(every)


def test_a_sample_does_not_depend_on_the_texts_around_it():
    pieces, how, rng = ps.pieces_of(PIECES), ps.Sampling(), random.Random(6)
    key = 922257969  # a draw close to the border of two ways
    alone = [x.tolist() for x in (ps.sample([" there"], np.array([key]), pieces, how)[0], ps.sample(["a then there"], np.array([7]), pieces, how)[0])]
    long = " ".join(rng.choice(["the", "river", "there", "quiet"]) + str(rng.randrange(10**6)) for _ in range(170_000))
    batched = ps.sample([long, " there", "x" * 40, "a then there"], np.array([1, key, 2, 7]), pieces, how)
    assert len(long) > 1_900_000 and [batched[1].tolist(), batched[3].tolist()] == alone
    texts, keys = [" ".join(rng.choice(["there", "signals", "windows"]) for _ in range(3)) for _ in range(200)], np.arange(200)
    together = ps.sample(texts, keys, pieces, how)
    assert all((ps.sample([t], keys[k : k + 1], pieces, how)[0] == together[k]).all() for k, t in enumerate(texts))
    assert {len(x) for x in together} != {len(together[0])}


def test_the_trie_tells_every_prefix():
    pieces = ps.pieces_of(PIECES)
    for i in np.flatnonzero(pieces.ranks)[::97].tolist():
        node = 0
        for c in pieces.decode(np.array([i])).decode().replace(" ", chr(ps.BLANK)):
            place = int(pieces.find(np.array([node]), np.array([ord(c)]))[0])
            node = int(pieces.nodes[place])
        assert place >= 0 and pieces.ids[place] == i
    assert pieces.find(np.array([0, 1]), np.array([0x10FFFF, 0x10FFFF])).tolist() == [-1, -1]
