"""Similar vectors, near-duplicates and look-alike texts against brute force."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from codelode.llm import knn, lookalike, neardup, queries, shingles
from codelode.sources import tables

VEC = "id bigint, embedding array<float>, query bigint, cosine string"


def vectors(n, seed, dim=64):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 3, dim))
    return np.concatenate([base, base + rng.normal(size=base.shape) * 0.15, rng.normal(size=(n - 2 * len(base), dim))]).astype(np.float32)


def brute(ids, x, k, floor):
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = u @ u.T
    out = set()
    for i in range(len(ids)):
        near = sorted(((-round(s[i, j], 9), ids[j]) for j in range(len(ids)) if ids[j] != ids[i] and s[i, j] >= floor))[:k]
        out |= {(min(ids[i], j), max(ids[i], j)) for _, j in near}
    return out


def test_quantisation_bounds_hold():
    x = vectors(300, 1)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    code, scale, error = knn.quantise(u.astype(np.float64))
    assert np.abs(code).max() <= 127 and np.array_equal(code, np.rint(code))
    about, exact = (code @ code.T) * scale * scale[:, None], u @ u.T
    slack = error[:, None] + (1 + error[:, None]) * error + 1e-5
    assert (np.abs(about - exact) <= slack).all() and slack.max() < 0.05


def test_tiles_equal_brute_force_for_any_floor():
    x = vectors(500, 2).astype(np.float64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.arange(500) * 3
    for floor, k in ((-1.0, 10), (0.3, 4), (0.92, 10)):
        q, n, s = knn.nearest_in_block(ids, u, ids[:50], u[:50], k, floor)
        got = {}
        for a, b, c in zip(q, n, s):
            got.setdefault(a, []).append((-c, b))
        exact = u[:50] @ u.T
        for i in range(50):
            want = sorted((-exact[i, j], int(ids[j])) for j in range(500) if j != i and exact[i, j] >= floor)[:k]
            assert [b for _, b in sorted(got.get(ids[i], []))] == [b for _, b in want]


def test_pairs_with_copies_dirt_and_clashing_columns(spark):
    x = vectors(240, 3)
    rows = [(i, v.tolist(), 1, "x") for i, v in enumerate(x)]
    rows += [(1000 + i, x[0].tolist(), 1, "x") for i in range(14)]  # a class of 15 copies
    rows += [rows[5], rows[5], (2000, None, 1, "x"), (2001, [], 1, "x"), (2002, [0.0] * 64, 1, "x"), (2003, [1.0] * 32, 1, "x"), (None, x[1].tolist(), 1, "x"), (2004, [float("nan")] * 64, 1, "x"), (2005, [None] + [1.0] * 63, 1, "x")]
    frame = spark.createDataFrame(rows, VEC)
    keep = {r[0]: r[1] for r in rows if r[0] is not None and r[1] and len(r[1]) == 64 and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])}
    ids, arr = list(keep), np.array(list(keep.values()), dtype=np.float32)
    got = {tuple(r) for r in knn.similar_pairs(frame, k=10, floor=0.92).collect()}
    assert got == brute(ids, arr, 10, 0.92)
    near = knn.nearest_neighbours(frame, k=3, floor=-1.0, probes=8).collect()
    assert {(r["query"], r["rank"]) for r in near} == {(i, k) for i in ids for k in (1, 2, 3)}
    assert knn.similar_pairs(frame.limit(0)).count() == 0


def test_hot_cells_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK_ROWS", 40)
    monkeypatch.setattr(knn, "CELL_ROWS", 100)
    x = vectors(300, 4)
    frame = spark.createDataFrame([(i, v.tolist(), 0, "") for i, v in enumerate(x)], VEC)
    assert {tuple(r) for r in knn.similar_pairs(frame, probes=3).collect()} == brute(list(range(300)), x, 10, 0.92)
    exact = knn.exact_neighbours(frame, frame.where("id % 50 = 0"), k=5).collect()
    got = {(r["query"], r["id"]) for r in exact}
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    want = {(i, j) for i in range(0, 300, 50) for _, j in sorted((-(u[i] @ u[j]), j) for j in range(300) if j != i)[:5]}
    assert got == want


# ---- near-duplicates ------------------------------------------------------------------------------------
import re  # noqa: E402

WORD = re.compile("[a-z0-9_]+")


def shingle_set(text, width):
    w = WORD.findall(text.lower())
    return set(zip(*(w[i:] for i in range(width))))


def edited(rng, words, share):
    out = list(words)
    for _ in range(int(len(out) * share)):
        at = rng.randrange(len(out))
        rng.choice([lambda: out.insert(at, f"n{rng.random()}"), lambda: out.pop(at), lambda: out.__setitem__(at, "zz")])()
    return out


def test_shingles_equal_sets_of_words():
    rng = random.Random(5)
    texts = ["", "a", "A_b C1 É d İx K", "x " * 5000] + [" ".join(rng.choice(["foo", "Bar", "b2", "ñu", "-", "_"]) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    for first, run in shingles.spans(texts):
        count, c1, c2, keys = shingles.shingle_sets(run, 3)
        for i in range(len(run)):
            assert count[i] == len(WORD.findall(texts[first + i].lower()))
            assert ((keys >> np.uint64(48)) == i).sum() == len(shingle_set(texts[first + i], 3))
    left, right = [rng.choice(texts) for _ in range(60)], [rng.choice(texts) for _ in range(60)]
    got = shingles.jaccard(left, right, 3)
    for a, b, s in zip(left, right, got):
        x, y = shingle_set(a, 3), shingle_set(b, 3)
        assert s == pytest.approx(len(x & y) / max(len(x | y), 1))


def test_pairs_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SPELL_OUT", 6)
    rng = random.Random(6)
    texts = {}
    for g in range(25):
        words = [f"w{rng.randint(0, 900)}" for _ in range(rng.randint(25, 120))]
        for k in range(3):
            texts[len(texts)] = " ".join(edited(rng, words, rng.choice([0, 0.02, 0.06, 0.2])))
    for _ in range(4):
        texts[len(texts)] = texts[0].upper() + "!"  # copies by words
    hot = " ".join(f"h{i}" for i in range(50))
    hots = []
    for _ in range(9):
        hots.append(len(texts))
        texts[len(texts)] = hot
    texts[len(texts)] = hot + " more"
    rows = [(i, t, 7) for i, t in texts.items()] + [(0, texts[0], 7), (900, None, 7), (901, "", 7), (902, "too short", 7), (None, texts[0], 7)]
    frame = spark.createDataFrame(rows, "id bigint, content string, key int")
    sets = {i: shingle_set(t, 3) for i, t in texts.items() if len(WORD.findall(t.lower())) >= 30}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}
    # of the large class of copies every member is paired with the first, which has the links
    want = {(a, b) for a, b in want if not ({a, b} & set(hots[1:]) and hots[0] not in (a, b))}
    want -= {(a, b) for a, b in want if a in hots[1:]}
    got = [tuple(r) for r in neardup.near_duplicate_pairs(frame, 0.7, 3, 30).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    groups = {r["id"]: r for r in neardup.near_duplicate_groups(frame, 0.7, 3, 30).collect()}
    assert set(groups) == set(sets)
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    assert {i: r["group_id"] for i, r in groups.items()} == {i: find(i) for i in sets}
    assert neardup.near_duplicate_pairs(frame.limit(0), 0.7, 3, 30).count() == 0


def test_different_texts_of_a_large_class_keep_their_pairs(spark):
    words = [f"w{i}" for i in range(60)]
    plain = " ".join(words)
    texts = [" ".join(words[:i] + [words[i].upper()] + words[i + 1 :]) for i in range(40)]  # one class, 40 different texts
    near = [f"{plain} more", f"{plain}! more"]
    rows = [*enumerate(texts + near), *((100 + i, plain) for i in range(35))]  # and one text 35 times
    frame = spark.createDataFrame(rows, "id bigint, content string")
    got = [tuple(r) for r in neardup.near_duplicate_pairs(frame, 0.7, 3, 30).collect()]
    want = {(a, b) for a in range(42) for b in [*range(a + 1, 42), 100]} | {(100, 100 + i) for i in range(1, 35)}
    assert len(got) == len(set(got)) and set(got) == want


def test_components_of_long_chains(spark):
    rng = random.Random(7)
    order = rng.sample(range(200), 200)
    links = spark.createDataFrame([(min(a, b), max(a, b)) for a, b in zip(order, order[1:120])] + [(150, 150)], "id_a bigint, id_b bigint")
    nodes = spark.range(200)
    got = {r["id"]: r["group_id"] for r in neardup.components(nodes, links).collect()}
    chain = set(order[:120])
    assert all(got[i] == (min(chain) if i in chain else i) for i in range(200))
    assert neardup.components(nodes, links.limit(0)).where("id <> group_id").count() == 0


# ---- look-alikes ----------------------------------------------------------------------------------------
def test_union_find_carries_over():
    u = lookalike.UnionFind()
    for a, b in ((1, 2), (3, 4), (2, 3)):
        u.union(a, b)
    assert u.classes() == [[1, 2, 3, 4]]


def test_one_form(spark):
    same = [
        ("Ａｂｃ１", "Abc1"), ("caf\u0065\u0301", "café"), ("a\u200bb\u00ad", "ab"), ("x\u00a0y\u202fz", "x y z"), ("\u0430\u0301", "á"), ("\u0451", "ë"), ("Ρ\u03bf", "Po"), ("e\u200b\u0301", "é"),
        ("\uff41\u0301", "\u00e1"), ("\ufeff", ""), ("o\u0323\u0302", "o\u0302\u0323"), ("\u0439", "\u0438\u0306"), ("\u3000", " "),
    ]
    apart = [("A", "a"), ("e", "é"), ("x²", "x2"), ("①", "1"), ("“a”", '"a"'), ("ß", "ss"), ("a\u2003b", "a b"), ("👍", "👍🏽"), ("ﬁ", "fi")]
    texts = [t for pair in same + apart for t in pair]
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(900, None, "x"), (None, "q", "x")], "doc_id bigint, text string, form string")
    form = {r.doc_id: r.form for r in lookalike.consistent_forms(frame).collect()}
    assert set(form) == set(range(len(texts)))
    for i in range(len(same)):
        assert form[2 * i] == form[2 * i + 1], same[i]
    for i in range(len(same), len(same) + len(apart)):
        assert form[2 * i] != form[2 * i + 1], apart[i - len(same)]
    assert lookalike.consistent_forms(frame.limit(0)).count() == 0


def test_representative_is_the_most_frequent_member():
    table = lookalike.representatives([["a", "\u0430"], ["", "\u200b"], ["o", "\u043e"]], {"a": 1, "\u0430": 5, "\u200b": 9})
    assert table == {"a": "\u0430", "\u200b": "", "\u043e": "o"}


def test_pairs_of_documents(spark, monkeypatch):
    rows = [(1, "a b"), (2, "a\u00a0b"), (3, "a b"), (4, "a\u2007b"), (5, "A b"), (6, ""), (7, "\u200b"), (7, "\u200b"), (8, "long " * 30000 + "ａ"), (9, "long " * 30000 + "a")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = {(1, 2), (1, 4), (2, 3), (2, 4), (3, 4), (6, 7), (8, 9)}
    assert {tuple(r) for r in lookalike.same_looking_pairs(frame).collect()} == want
    monkeypatch.setattr(lookalike, "COPIES", 1)
    assert {tuple(r) for r in lookalike.same_looking_pairs(frame).collect()} == {(1, 2), (1, 4), (2, 4), (2, 3), (6, 7), (8, 9)}
    groups = {r.doc_id: tuple(r)[1:] for r in lookalike.same_looking_groups(frame).collect()}
    assert groups[3] == (1, 1, 3, 2) and groups[4] == (4, 1, 3, 3) and groups[5] == (5, 5, 1, 0) and groups[7] == (7, 6, 2, 1) and len(groups) == 9


def test_no_copy_of_many_loses_its_links(spark):
    frame = spark.createDataFrame([*((i, "a b") for i in range(1000)), (5000, "a\u00a0b"), (5001, "\u0430 b")], "doc_id bigint, text string")
    got = {tuple(r) for r in lookalike.same_looking_pairs(frame).collect()}
    assert got == {(i, 5000) for i in range(1000)} | {(0, 5001), (5000, 5001)}
    groups = {r.doc_id: (r.form_id, r.links) for r in lookalike.same_looking_groups(frame).collect()}
    assert groups[999] == (0, 2) and groups[5001] == (0, 1001)


def test_every_copy_is_paired_however_many_there_are(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(lookalike, "BLOCK_COPIES", 16)
    rows = [*((i, "a b") for i in range(150)), *((1000 + i, "a\u00a0b") for i in range(70)), (5000, "\u0430 b"), (5000, "\u0430 b"), (5001, "A b"), (None, "a b"), (5002, None)]
    rows += [(6000, "c"), (6000, "\u0441"), (6001, "c"), (6002, "\uff43"), *((7000 + i, "d") for i in range(90))]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = sorted(tuple(r) for r in queries.p10_found(spark, str(tmp_path)).collect())
    assert got == sorted(db.sql(queries.SQL["p10_found"]).fetchall()) and len(got) > 150 * 70
    assert lookalike.all_same_looking_pairs(spark.createDataFrame(rows[:150], "doc_id bigint, text string")).count() == 0


def test_same_shaped_letters_of_rare_alphabets(spark):
    frame = spark.createDataFrame([(1, "\u13aa\u13df"), (2, "AC"), (3, "\ua4ee\ua4da"), (4, "\u2c80C")], "doc_id bigint, text string")
    assert lookalike.same_looking_pairs(frame).count() == 6


def test_all_different_texts_of_a_large_form_are_paired(spark, monkeypatch):
    monkeypatch.setattr(tables, "BLOCK_ROWS", 16)
    spellings = [f"{'a' * i}\u200b{'a' * (70 - i)}" for i in range(70)]  # more than 64 texts of one form
    copies = [(1000 + i, spellings[0]) for i in range(5)]
    frame = spark.createDataFrame([*enumerate(spellings), *copies, (2000, "b")], "doc_id bigint, text string")
    got = [tuple(r) for r in lookalike.same_looking_pairs(frame).collect()]
    want = {(a, b) for a in range(70) for b in range(a + 1, 70)} | {(b, 1000 + i) for b in range(1, 70) for i in range(5)}
    assert len(got) == len(set(got)) and set(got) == want


def test_variants_of_a_template_are_grouped_without_all_pairs(spark, monkeypatch):
    seen = []
    equal = neardup._equal_bytes
    monkeypatch.setattr(neardup, "_equal_bytes", lambda pairs, least: (seen.append(pairs.count()), equal(pairs, least))[1])
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*words[: i % 200], f"v{i}", *words[i % 200 + 1 :]])) for i in range(400)] + [(1000, " ".join(f"z{i}" for i in range(200)))]
    frame = spark.createDataFrame(rows, "id bigint, content string")
    groups = {r.id: r.group_id for r in neardup.near_duplicate_groups(frame, 0.8, 5).collect()}
    assert groups == {i: 0 for i in range(400)} | {1000: 1000}
    assert sum(seen) < 8_000  # of 79,800 pairs
