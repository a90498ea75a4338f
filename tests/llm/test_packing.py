import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from lodequarry.llm import packing, tokens

from .conftest import rows


def counts(sizes, room):
    return np.bincount(sizes, minlength=room + 1).astype(np.int64)


@pytest.mark.parametrize("seed", range(12))
def test_patterns_use_every_piece_and_fit(seed):
    r = random.Random(seed)
    room = r.choice([10, 30, 100])
    sizes = [r.randrange(1, room) for _ in range(r.randrange(0, 80))]
    c = counts(sizes, room)
    for patterns in (packing.best_fit(c, room), packing.complete(c, room).patterns):
        assert sorted(s for n, f in patterns for s in f * n) == sorted(sizes)
        assert all(sum(f) <= room for _, f in patterns)
    assert packing.lower_bound(c, room) <= packing.complete(c, room).sequences <= sum(n for n, _ in packing.best_fit(c, room))


@pytest.mark.parametrize("seed", range(8))
def test_small_cases_are_optimal(seed):
    r = random.Random(seed)
    sizes = sorted((r.randrange(2, 9) for _ in range(8)), reverse=True)
    best = [len(sizes)]

    def place(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + sizes[k] <= 12:
                place(k + 1, bins[:i] + [bins[i] + sizes[k]] + bins[i + 1 :])
        place(k + 1, [*bins, sizes[k]])

    place(0, [])
    assert packing.complete(counts(sizes, 12), 12).sequences == best[0]


def test_search_beats_best_fit():
    sizes = [4, 4, 4, 3, 3, 3, 3, 3, 3]  # ten to a sequence: 4+3+3 three times
    assert packing.complete(counts(sizes, 10), 10).sequences == 3


def optimum(sizes, room):
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def place(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(bins)
            return
        for i in {b: i for i, b in enumerate(bins)}.values():
            if bins[i] + sizes[k] <= room:
                place(k + 1, bins[:i] + [bins[i] + sizes[k]] + bins[i + 1 :])
        place(k + 1, [*bins, sizes[k]])

    place(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(120))
def test_a_search_that_ends_is_optimal_and_the_gap_is_honest(seed):
    r = random.Random(seed)
    room = r.choice([20, 50, 100, 1000])
    sizes = [r.randrange(room // 6, room // 2 + 1) for _ in range(r.randrange(4, 12))]
    found, best = packing.complete(counts(sizes, room), room), optimum(sizes, room)
    assert found.least <= best <= found.sequences and found.ended and found.sequences == best and found.gap == 0
    cut = packing.complete(counts(sizes, room), room, steps=3)
    assert cut.least <= best <= cut.sequences <= cut.least + cut.gap or cut.ended and cut.sequences == best


def test_all_undominated_fillings_are_given():
    c = counts([7, 5, 4, 4, 3, 2], 12)
    got = {f for f in packing.fillings(c, 11, lambda: 11, [10_000])}
    assert got == {(7, 4)} or all(sum(f) <= 11 for f in got) and (7, 4) in got


def test_documents_are_packed_whole(docs, nothing):
    enc = tokens.encoder(tokens.default_vocabulary())
    got = packing.pack(docs, room=512, with_ids=True).collect()
    by_sequence = defaultdict(list)
    for r in got:
        by_sequence[r["sequence_id"]].append(r)
        assert len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
    for s in by_sequence.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 512
    pieces = sorted((sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["piece"], tuple(r["ids"])) for r in got)))
    want = []
    for i, t, *_ in rows():
        ids = [*enc.encode([t])[0].tolist(), 0]
        first = len(ids) % 512 or 512
        cuts = [0, *range(first, len(ids) + 1, 512)] if len(ids) > 512 else [0, len(ids)]
        want += [(i is not None, i or 0, k, tuple(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert pieces == sorted(want)
    assert packing.pack(nothing).count() == 0
