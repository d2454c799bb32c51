import base64
import hashlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from newtonmill.llm import minhash_dedup as M
from newtonmill.llm import spotsigs, store, substring_dedup
from newtonmill.llm.graph import components
from newtonmill.llm.spotsigs import compare_with_edits, near_by_signatures
from newtonmill.llm.substring_dedup import levels, remove_repeats, spans

from . import cases


def groups(data):
    """Least reachable id of each id, by comparing all pairs."""
    known = [(i, cases.shingles(t)) for i, t in data if i is not None]
    root = {i: i for i, _ in known}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, a), (j, b) in combinations(known, 2):
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return {i: find(i) for i in root}


def test_near_duplicates_equal_brute_force(spark):
    data = cases.rows()
    found = M.near_duplicates(cases.frame(spark, data)).collect()
    want = groups(data)
    assert len(found) == len(data)
    assert len(set(want.values())) < len(want) - 5
    for r in found:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.kept) == (want[r.doc_id], want[r.doc_id] == r.doc_id)
    sizes = sorted((r.doc_id or -1, r.n_shingles) for r in found)
    assert sizes == sorted((i or -1, len(cases.shingles(t))) for i, t in data)


def test_a_family_around_a_missing_original(spark, monkeypatch):
    """Copies of one text, each edited apart: pairs lie on both sides of the threshold, and blocks are small."""
    monkeypatch.setattr(M, "BLOCK", 8)
    monkeypatch.setattr(M, "TEXTS", 8)
    monkeypatch.setattr(M, "COLUMNS", 16)
    rng = np.random.default_rng(4)
    base = [f"w{k}" for k in range(200)]
    data = []
    for i in range(60):
        own = list(base)
        for at in rng.choice(200, rng.integers(1, 12), replace=False):
            own[at] = f"x{i}_{at}"
        data.append((i, " ".join(own)))
    want = groups(data)
    found = {r.doc_id: r.component_id for r in M.near_duplicates(cases.frame(spark, data)).collect()}
    assert found == want


def test_large_families_of_unlinked_and_linked_near_copies(spark):
    """Thousands of copies of two texts, edited apart: of one all lie under the threshold, of the other most above it."""
    rng = np.random.default_rng(6)
    data, sets = [], {}
    for f, (edits, n) in enumerate(((14, 1500), (3, 1500))):
        base = [f"{'ab'[f]}{k}" for k in range(200)]
        for i in range(n):
            own = list(base)
            for at in rng.choice(200, edits, replace=False):
                own[at] = f"x{f}_{i}_{at}"
            sets[len(data)] = cases.shingles(" ".join(own))
            data.append((len(data), " ".join(own)))
    codes: dict = {}
    flat = [(i, codes.setdefault(g, len(codes))) for i, s in sets.items() for g in s]
    seen = np.bincount([c for _, c in flat])
    width = {c: k for k, c in enumerate(np.flatnonzero(seen > 1).tolist())}
    m = np.zeros((len(data), len(width)), np.float32)
    for i, c in flat:
        if c in width:
            m[i, width[c]] = 1
    both, sizes = m @ m.T, np.array([len(sets[i]) for i in range(len(data))])
    linked = 100 * both >= 75 * (sizes[:, None] + sizes[None, :] - both)
    label = np.arange(len(data))
    while True:
        least = np.where(linked, label[None, :], len(data)).min(axis=1)
        least = np.minimum(least, label)
        if np.array_equal(least, label):
            break
        label = least
    found = {r.doc_id: r.component_id for r in M.near_duplicates(cases.frame(spark, data, more=False)).collect()}
    assert [found[i] for i in range(len(data))] == label.tolist()
    assert len(set(label[:1500])) > 1000 > 20 > len(set(label[1500:]))


def test_empty_tables(spark):
    empty = cases.frame(spark, [])
    assert M.near_duplicates(empty).count() == 0
    assert remove_repeats(empty).count() == 0
    assert compare_with_edits(empty).count() == 0


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    for share in (0.75, 0.9):
        n = 2000
        both = int(2 * n * share / (1 + share))
        pool = rng.integers(0, 1 << 62, 2 * n - both).astype(np.uint64)
        a, b = M.samples(np.sort(pool[:n])), M.samples(np.sort(pool[n - both :]))
        assert abs(np.mean(a == b) - share) < 0.12
        assert np.bitwise_count((M.odd_sketch(a) ^ M.odd_sketch(b)).view(np.uint64)).sum() <= M.most_differing_bits(0.75)


def test_sketch_estimates_are_the_preciser_the_more_alike():
    rng = np.random.default_rng(2)
    errors = {}
    for share in (0.6, 0.75, 0.9, 0.97):
        found = []
        for _ in range(200):
            n = 400
            both = int(2 * n * share / (1 + share))
            pool = rng.integers(0, 1 << 62, 2 * n - both).astype(np.uint64)
            a, b = M.samples(np.sort(pool[:n])), M.samples(np.sort(pool[n - both :]))
            found.append(float(M.estimate(np.bitwise_count((M.odd_sketch(a) ^ M.odd_sketch(b)).view(np.uint64)).sum())) - both / (2 * n - both))
        errors[share] = float(np.sqrt(np.mean(np.square(found))))
    assert errors[0.97] < errors[0.9] < errors[0.75] < 0.05 and errors[0.6] < 0.08 and errors[0.97] < 0.015


def test_components_of_a_path_a_star_and_a_cycle(spark):
    links = [(i, i + 1) for i in range(50, 90)] + [(7, k) for k in range(8, 20)] + [(200, 201), (201, 202), (202, 200)] + [(3, 3)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{k: 50 for k in range(50, 91)}, **{k: 7 for k in range(7, 20)}, **{k: 200 for k in (200, 201, 202)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_levels_double():
    assert levels(50) == [13, 25] and levels(100) == [13, 25, 50] and levels(4) == [2] and levels(200) == [13, 25, 50, 100]


def test_no_candidate_of_a_level_is_left(spark, monkeypatch):
    """The table of candidates shrinks from level to level and ends empty where no long window is repeated."""
    sizes = []
    monkeypatch.setattr(substring_dedup, "save", lambda df: sizes.append((df.columns, (out := store.save(df)).count())) or out)
    rng = np.random.default_rng(3)
    short = [f"s{k}" for k in range(20)]
    docs = [(i, 0, " ".join([*(f"w{x}" for x in rng.integers(0, 10**6, 60)), *short, *(f"w{x}" for x in rng.integers(0, 10**6, 60))])) for i in range(20)]
    found = substring_dedup.repeated_spans(spans(spark.createDataFrame(docs, "id long, key long, text string"), 100))
    candidates = [n for c, n in sizes if "span" in c]
    assert candidates[0] > 0 and candidates[-1] == 0 == found.count() and candidates == sorted(candidates, reverse=True)


def test_identical_rows_cost_no_more_than_their_number(spark):
    text = " ".join(f"w{k}" for k in range(80))
    data = [(1, "x " + text), *[(2, text)] * 5000, (3, text + " y")]
    found = {(r.doc_id, r.n_words, r.n_removed): r["count"] for r in remove_repeats(cases.frame(spark, data)).groupBy("doc_id", "n_words", "n_removed").count().collect()}
    assert found == {(1, 81, 0): 1, (2, 80, 80): 5000, (3, 81, 80): 1}


@pytest.mark.parametrize("length", [4, 11, 50, 60])
def test_repeats_equal_brute_force(spark, length):
    data = cases.rows()
    first: dict[tuple, int] = {}
    for i, t in data:
        w = cases.words(t)
        for p in range(len(w) - length + 1):
            if i is not None:
                k = tuple(w[p : p + length])
                first[k] = min(first.get(k, i), i)
    want = []
    for i, t in data:
        w = cases.words(t)
        gone = set()
        for p in range(len(w) - length + 1):
            if i is not None and first[tuple(w[p : p + length])] < i:
                gone |= set(range(p, p + length))
        kept = [x for k, x in enumerate(w) if k not in gone]
        want.append((i or -1, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    found = [(r.doc_id or -1, r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeats(cases.frame(spark, data), length).collect()]
    assert sorted(found) == sorted(want)
    assert sum(r[2] for r in want) > 0


def members(fingerprint):
    data = base64.b64decode(fingerprint)
    return {data[k : k + 8] for k in range(0, len(data), 8)}


def test_edits_and_neighbours(spark):
    data = [(i, t) for i, t in cases.rows() if i is not None]
    data = list({i: t for i, t in data}.items())
    found = {r.doc_id: r for r in compare_with_edits(cases.frame(spark, data)).collect()}
    order = sorted(data)
    assert len(found) == len(data)
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r, nxt = found[i], found[order[(k + 1) % len(order)][0]]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        own, other, beside = map(members, (r.fingerprint, r.edited_fingerprint, nxt.fingerprint))
        assert r.near_edited == pytest.approx(len(own & other) / len(own | other) if own | other else 1.0)
        assert r.near_next == pytest.approx(len(own & beside) / len(own | beside) if own | beside else 1.0)
    assert found[8].fingerprint == found[9].fingerprint


@pytest.mark.parametrize(("own", "after"), [(7, 30), (8, 0), (7, 0), (8, 30)])
def test_edits_across_seven_and_eight_signatures(spark, own, after):
    """A list of plain words with `own` anchored pairs behind it; its edited text has `after` pairs instead, or about as many."""
    pairs = lambda n, c: "".join(f"the {c}{k} {c}{c}{k} " for k in range(n))
    text = "".join(f"item{k} " for k in range(30)) + pairs(own, "x")
    found = {r.doc_id: r for r in compare_with_edits(cases.frame(spark, [(1, text), (2, pairs(after, "y") or "".join(f"thing{k} " for k in range(40)))])).collect()}
    assert len(members(found[1].fingerprint)) == own + 30 + 2 * own
    assert found[1].near_edited > 0.2 and found[1].near_next == 0


def test_rows_that_share_an_id_or_have_none(spark):
    found = compare_with_edits(cases.frame(spark, [(None, "a b"), (1, "c d"), (1, "c d"), (400, "e f"), (10**15, "g")])).collect()
    assert sorted((r.doc_id or -1, r.n_chars) for r in found) == [(-1, 3), (1, 3), (1, 3), (400, 3), (10**15, 1)]
    assert compare_with_edits(cases.frame(spark, [(1, "lonely text of the one row")])).first().near_next == 1.0


@pytest.mark.parametrize("crowd", [2, 300])
def test_neighbours_of_crowded_ids(spark, monkeypatch, crowd):
    """Many rows share an id or have none, equal ones among them: each is followed by the next in the order of id and text hash."""
    monkeypatch.setattr(spotsigs, "NEIGHBOURS", crowd)
    monkeypatch.setattr(spotsigs, "ORDERED", 2)
    ids = [None] * 40 + [3] * 30 + [1, 2, 4, 5, 5, 5, 9, 600, 601] + [10**6] * 20
    data = [(i, f"t{k % 17} {'x' * (k % 5)}") for k, i in enumerate(ids)]
    got = spotsigs.with_next(cases.frame(spark, data)).select("id", "text", F.xxhash64("text").alias("tie"), "next_text").collect()
    assert sorted((r.id or 0, r.text) for r in got) == sorted((i or 0, t) for i, t in data)
    order = sorted((r.id if r.id is not None else -1, r.tie, r.text) for r in got)
    want = sorted((*order[k][::2], order[(k + 1) % len(order)][2]) for k in range(len(order)))
    assert sorted((r.id if r.id is not None else -1, r.text, r.next_text) for r in got) == want


def classes(data):
    """Least reachable id by the signature sets of the rows, all pairs compared."""
    sets, root = {i: s for i, s in data if s}, {i: i for i, _ in data}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(sets, 2):
        if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return {i: find(i) for i in root}


@pytest.mark.parametrize("block", [3, 64])
def test_signature_search_equals_all_pairs(spark, monkeypatch, block):
    """Copies, texts edited a little and a lot, and a family whose original is missing, so that no hub joins it."""
    monkeypatch.setattr(spotsigs, "BLOCK", block)
    base = "the cat sat on a mat and the dog ran to the house of a man with the red hat in an old town by the sea".split()
    data = [(i, " ".join(base[:-i] if i < 6 else [f"{w}{i}" for w in base])) for i in range(1, 9)] + [(20, None), (21, " ".join(base[:-1])), (22, "!!"), (23, "!!"), (24, "")]
    rng = np.random.default_rng(4)
    for i in range(100, 160):
        own = [f"w{k}" for k in range(120)]
        for at in rng.choice(120, rng.integers(1, 14), replace=False):
            own[at] = f"x{i}_{at}"
        data.append((i, " the ".join(own)))
    data += cases.rows(n=12)
    data = list({i: t for i, t in data if i is not None}.items())
    df = cases.frame(spark, [*data, (None, data[0][1])])
    sets = [(r.doc_id, frozenset(r.x)) for r in df.select("doc_id", spotsigs.signatures(F.col("text")).alias("x")).collect() if r.doc_id is not None]
    found = near_by_signatures(df).collect()
    want = classes(sets)
    assert {r.doc_id: r.class_id for r in found} == {**want, None: None} and len(found) == len(data) + 1
    assert len(set(want.values())) < len(want) - 20
    assert {r.doc_id: r.n_signatures for r in found if r.doc_id is not None} == {i: len(s) for i, s in sets}
    assert near_by_signatures(df.limit(0)).count() == 0
