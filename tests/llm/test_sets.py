"""Packing and mixing."""

import os
import random

import pytest

from codelode.llm import mixing, packing, tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary file")


def optimum(sizes, capacity):
    best = [len(sizes)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + sizes[i] <= capacity:
                bins[j] += sizes[i]
                place(i + 1, bins)
                bins[j] -= sizes[i]
        place(i + 1, [*bins, sizes[i]])

    sizes = sorted(sizes, reverse=True)
    place(0, [])
    return best[0]


def test_packing_reaches_the_optimum_of_small_problems():
    rng = random.Random(1)
    for _ in range(150):
        capacity = rng.choice([30, 100])
        sizes = [rng.randint(1, capacity) if rng.random() < 0.3 else rng.randint(capacity // 7, capacity // 2) for _ in range(rng.randint(1, 9))]
        bins, proved = packing.pack(sizes, capacity)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= capacity for b in bins)
        best = optimum(sizes, capacity)
        assert len(bins) == best and packing.lower_bound(sizes, capacity) <= best
        assert not proved or len(bins) == best


def test_completion_beats_best_fit():
    sizes = [5, 4, 4, 3, 2, 2]  # two full containers of 10, where best fit takes three
    assert len(packing.best_fit_decreasing(sizes, 10)) == 3 and len(packing.pack(sizes, 10)[0]) == 2
    assert packing.pack([], 10) == ([], True) and packing.pack([0, 0], 10)[0] == [[0, 1]]
    assert sorted(map(sorted, packing.pack([10, 0, 10], 10)[0])) in ([[0, 1], [2]], [[0], [1, 2]])


def test_completions_leave_out_dominated_sets():
    left = packing.Multiset([5, 4, 3, 3, 2])
    got = packing.completions(left, 8, 8)
    assert got[0][0] == 0 and all(sum(s) + w == 8 for w, s in got)
    assert all(w == 0 or not any(t <= w for t in left.order if left.count[t] > s.count(t)) for w, s in got)


def test_documents_in_containers(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_CONTAINERS", 4)
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "x1", "ñandú"]) for _ in range(rng.choice([0, 3, 20, 60, 150]))) for _ in range(120)]
    rows = [(i, t, "p", 3) for i, t in enumerate(texts)] + [(0, texts[0], "p", 3), (500, None, "p", 3), (None, "x", "p", 3), (501, "", "p", 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, container string, room int")
    limits = spark.createDataFrame([("s", 64), ("m", 200), (None, 5), ("z", 0)], "container string, capacity_tokens int")
    got = packing.pack_documents(docs, limits).collect()
    size = {i: tokens.count(t) for i, t in enumerate(texts)} | {501: 0}
    for name, capacity in (("s", 64), ("m", 200)):
        mine = [r for r in got if r.container == name]
        by_doc, by_bin = {}, {}
        for r in mine:
            by_doc.setdefault(r.doc_id, []).append(r)
            by_bin.setdefault(r.bin, []).append(r)
        assert set(by_doc) == set(size)
        for doc, parts in by_doc.items():
            parts.sort(key=lambda r: r.piece_no)
            assert sum(p.tokens for p in parts) == size[doc] and [p.piece_no for p in parts] == list(range(1, len(parts) + 1))
            assert len(parts) == max(1, -(-size[doc] // capacity)) and all(p.token_from == (p.piece_no - 1) * capacity for p in parts)
        for parts in by_bin.values():
            assert sum(p.tokens for p in parts) + parts[0].room == capacity and len({p.room for p in parts}) == 1
        assert len(by_bin) <= packing.lower_bound([r.tokens for r in mine if r.tokens], capacity) * 1.05 + 3
    summary = {r.container: r for r in packing.container_summary(packing.pack_documents(docs, limits)).collect()}
    assert summary["s"].tokens == sum(size.values()) and summary["s"].bins >= summary["s"].least_bins
    assert packing.pack_documents(docs.limit(0), limits).count() == 0


def test_flight_keeps_both_totals_and_decides_all_but_two():
    rng = random.Random(3)
    for n in (0, 1, 2, 3, 40, 400):
        sizes = [rng.randint(1, 900) for _ in range(n)]
        p = [rng.choice([0.25, 0.25, 0.8, 0.0, 1.0]) for _ in range(n)]
        q = mixing.flight(p, sizes, 4)
        assert sum(0 < x < 1 for x in q) <= 2
        assert sum(q) == pytest.approx(sum(p)) and sum(x * t for x, t in zip(q, sizes)) == pytest.approx(sum(x * t for x, t in zip(p, sizes)))
    same = mixing.flight([0.5] * 9, [7] * 9, 1)
    assert sum(same) == pytest.approx(4.5)


def test_flight_keeps_each_probability_on_average():
    runs = [mixing.flight([0.3] * 12, [5, 9, 14, 3, 8, 8, 21, 2, 7, 30, 11, 6], s) for s in range(3000)]
    for i in range(12):
        assert sum(r[i] for r in runs) / len(runs) == pytest.approx(0.3, abs=0.03)


def test_landing_comes_nearest():
    assert mixing.landing([0.5, 0.5], [10, 10]) in ([1, 0], [0, 1])
    assert mixing.landing([], []) == [] and mixing.landing([0.9], [100]) == [1]


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 50)
    rng = random.Random(4)
    rows = []
    for source, n, top in (("a", 400, 40), ("b", 60, 80), ("c", 20, 30), ("other", 50, 30), (None, 10, 30)):
        rows += [(len(rows) + i, " ".join(["word"] * rng.randint(1, top)), source, 1) for i in range(n)]
    rows += [rows[0], (9000, None, "a", 1), (9001, "", "a", 1), (None, "x", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, tokens int")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 3), ("none", 0.0, 1)], "source string, target_share double, max_repeats int")
    drawn = mixing.mix_documents(docs, targets)
    got = drawn.collect()
    assert len({r.doc_id for r in got}) == len(got)
    size = {r[0]: tokens.count(r[1]) for r in rows if r[0] is not None and r[1]}
    caps = {"a": 1, "b": 2, "c": 3}
    totals = {}
    for r in got:
        assert 1 <= r.repeats <= caps[r.source] and r.tokens == size[r.doc_id]
        totals[r.source] = totals.get(r.source, 0) + r.tokens * r.repeats
    whole = sum(totals.values())
    for source, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert totals[source] / whole == pytest.approx(share, abs=0.01)
    report = {r.source: r for r in mixing.actual_shares(drawn, targets).collect()}
    assert report["none"].actual_share == 0 and report["b"].actual_share == pytest.approx(totals["b"] / whole, abs=1e-6)
    small = mixing.mix_documents(docs, targets, total_tokens=whole // 2).collect()
    assert sum(r.tokens * r.repeats for r in small) == pytest.approx(whole // 2, rel=0.03)
    assert mixing.mix_documents(docs.limit(0), targets).count() == 0


def test_search_goes_on_after_its_first_solution():
    # best fit decreasing needs 13 containers, two more than the total demands
    sizes = [35, 26, 37, 35, 28, 30, 38, 27, 36, 29, 39, 39, 28, 40, 37, 40, 38, 27, 38, 39, 29, 32, 37, 39, 34, 37, 28, 27, 37, 26, 26, 27]
    assert len(packing.best_fit_decreasing(sizes, 100)) == 13 and packing.lower_bound(sizes, 100) == 11
    bins, proved = packing.pack(sizes, 100, 2000)
    assert proved and len(bins) == 11 and sorted(i for b in bins for i in b) == list(range(32))
    assert all(sum(sizes[i] for i in b) <= 100 for b in bins)


def test_small_sources_land_as_well_beside_a_large_one(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 100)
    rng = random.Random(8)
    sizes = {"small": 38, "middle": 90, "large": 1500}
    rows = [(k * 10_000 + i, " ".join(["word"] * rng.randint(1, 60)), s) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("small", 0.2, 8), ("middle", 0.3, 8), ("large", 0.5, 8)], "source string, target_share double, max_repeats int")
    shares = {r.source: r.actual_share for r in mixing.actual_shares(mixing.mix_documents(docs, targets, total_tokens=3_000), targets).collect()}
    assert shares["small"] == pytest.approx(0.2, abs=0.002) and shares["middle"] == pytest.approx(0.3, abs=0.002)


def test_the_largest_documents_keep_their_probability():
    sizes = [5, 6, 4, 7, 5, 6, 5, 4, 6, 5, 7, 5, 6, 4, 5, 6, 5, 300, 200, 7, 5, 6, 8, 9]
    drawn = [0, 0]
    for seed in range(1500):
        p = [0.4] * len(sizes)
        held = mixing.reserve(p, sizes)
        assert not {17, 18} & set(held)
        rest = [i for i in range(len(p)) if i not in held]
        q = dict(zip(rest, mixing.flight([p[i] for i in rest], [sizes[i] for i in rest], seed)))
        drawn[0] += q[17]
        drawn[1] += q[18]
    assert all(x / 1500 == pytest.approx(0.4, abs=0.04) for x in drawn)


def test_search_improves_on_best_fit_in_large_shards():
    rng = random.Random(5)
    sizes = [rng.randint(150, 400) for _ in range(900)]
    bins, proved = packing.pack(sizes, 1000)
    least = packing.lower_bound(sizes, 1000)
    assert len(bins) < len(packing.best_fit_decreasing(sizes, 1000)) and len(bins) <= least + 1 and proved == (len(bins) == least)
    assert sorted(i for b in bins for i in b) == list(range(900)) and all(sum(sizes[i] for i in b) <= 1000 for b in bins)


def test_completions_are_the_fullest_sets():
    rng = random.Random(6)
    for _ in range(200):
        items = [rng.randint(3, 30) for _ in range(rng.randint(1, 10))]
        room = rng.randint(3, 60)
        got = packing.completions(packing.Multiset(items), room, room)
        sums = {0}
        for s in items:
            sums |= {t + s for t in sums}
        assert got[0][0] == room - max(t for t in sums if t <= room)
