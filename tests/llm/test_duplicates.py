import random

import numpy as np
import pytest

from tallyproof.llm import embeddings, neardup, repeats
from tallyproof.llm.common import components
from tests.llm import brute
from tests.llm.conftest import ODD


def family(seed, n=40, size=120, edits=(0, 1, 2, 4, 8, 12, 20)):
    random.seed(seed)
    vocabulary = [f"w{i}" for i in range(2000)]
    base = random.choices(vocabulary, k=size)
    for _ in range(n):
        copy = list(base)
        for _ in range(random.choice(edits)):
            copy[random.randrange(size)] = random.choice(vocabulary)
        yield " ".join(copy)


@pytest.fixture(scope="module")
def copies():
    texts = [t for s in range(4) for t in family(s)]
    texts += ["", "one", "one", "one two three", "One  two\tTHREE", "a b c d e", "a b c d e f"] + [f"alone {i} " * 3 for i in range(10)]
    random.seed(9)
    random.shuffle(texts)
    return list(enumerate(texts))


def test_links_equal_brute_force(table, copies):
    got = {r["doc_id"]: r for r in neardup.near_duplicates(table(copies).repartition(4)).collect()}
    sets = {d: brute.shingles(t) for d, t in copies}
    want = brute.components(sets, brute.near_links(sets))
    assert {d: (r["n_shingles"], r["component_id"], r["kept"]) for d, r in got.items()} == {
        d: (len(sets[d]), c, c == d) for d, c in want.items()}


def test_a_hub_joins_copies_that_are_not_alike(table):
    """Each copy has other words replaced, so copies are near the original only."""
    base = [f"b{i}" for i in range(100)]
    rows = [(k, " ".join(f"x{k}" if i in (7 * k % 90, 7 * k % 90 + 9) else w for i, w in enumerate(base))) for k in range(1, 60)]
    rows.append((500, " ".join(base)))
    got = neardup.near_duplicates(table(rows)).collect()
    assert {r["component_id"] for r in got} == {1} and sum(r["kept"] for r in got) == 1


def test_odd_rows(table):
    got = neardup.near_duplicates(table(ODD)).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["kept"]) for r in got) == [
        (0, 1, None, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 5, True), (5, 1, 5, True), (6, 1, 6, True),
        (7, 1, 7, True), (8, 1, 5, False), (9, 1, 9, True)]
    assert neardup.near_duplicates(table([])).count() == 0


def test_deduplicate_keeps_other_columns(table):
    rows = [(1, "a b c d e f", 10), (2, "a b c d e f", 20), (3, None, 30), (None, "a b c d e f", 40)]
    df = table(rows, "doc_id long, text string, component_id int")
    assert sorted(map(tuple, neardup.deduplicate(df).collect()), key=str) == sorted([rows[0], rows[2], rows[3]], key=str)


def test_registers_estimate_similarity():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.75, 0.9):
        n = 4000
        both = rng.integers(0, 2**63, int(n * share)).astype(np.uint64)
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 2**63, int(n * (1 - share) / 2)).astype(np.uint64)])) for _ in range(2))
        from tallyproof.llm.common import mix
        sets = [np.sort(mix(x)) for x in (a, b)]
        regs = neardup.registers(np.concatenate(sets), np.array([0, len(a), len(a) + len(b)]))
        est, full = neardup.estimate(regs[:1], regs[1:], np.array([len(a)]), np.array([len(b)]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(est[0] - true) < 5 * np.sqrt(true * (1 - true) / full[0])


def test_filled_registers_agree_for_small_sets():
    h = np.sort(np.random.default_rng(2).integers(0, 2**63, 3).astype(np.uint64))
    regs = neardup.registers(np.concatenate([h, h]), np.array([0, 3, 6]))
    full = neardup.filled(regs)
    assert (full > 0).all() and (full[0] == full[1]).all() and (neardup.band_keys(full)[0] == neardup.band_keys(full)[1]).all()


def test_short_texts_lose_no_link(table):
    """Pairs of 3 to 16 shingles at or just above the threshold, against brute force."""
    rows = []
    for k in range(600):
        size = (4, 5, 8, 12, 16)[k % 5]
        words = [f"s{k}x{i}" for i in range(size + 4)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[: len(words) - size // 4]))]
    sets = {d: brute.shingles(t) for d, t in rows}
    want = brute.components(sets, brute.near_links(sets))
    assert len(set(want.values())) == 600
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(table(rows)).collect()} == want


def test_pairs_about_the_size_at_which_keys_change():
    rng = np.random.default_rng(12)
    for large in range(neardup.SMALL - 2, neardup.SMALL * 4 // 3 + 3):
        for _ in range(5):
            a = rng.integers(0, 2**64, large, dtype=np.uint64)
            sets = [np.sort(a), np.sort(a[: -(-3 * large // 4)])]
            h, at = np.concatenate(sets), np.array([0, large, large + len(sets[1])])
            keys, keys_at = neardup.candidate_keys(h, at, neardup.registers(h, at))
            assert np.intersect1d(keys[: keys_at[1]], keys[keys_at[1]:]).size, large
    keys, keys_at = neardup.candidate_keys(a[:0], np.zeros(3, dtype=np.int64), np.zeros((2, neardup.BUCKETS), dtype=np.uint16))
    assert not len(keys) and keys_at.tolist() == [0, 0, 0]


def test_overlaps():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 300, n).astype(np.uint64)) for n in (0, 5, 200, 250)]
    assert neardup.overlaps(sets, sets).tolist() == [[len(np.intersect1d(a, b)) for b in sets] for a in sets]


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(200, 260)] + [(5, k) for k in range(6, 40)] + [(1, 1), (None, 3), (70, 69)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for p in links for x in p if x is not None}
    want = brute.components(nodes, [p for p in links if None not in p])
    assert got == {n: c for n, c in want.items() if n != c}


def test_repeated_passages_equal_brute_force(table):
    random.seed(4)
    passage = [f"p{i}" for i in range(70)]
    texts = {}
    for d in range(30):
        w = [f"d{d}x{i}" for i in range(random.randrange(80))]
        cut = random.randrange(0, 25)
        part = passage[cut: cut + random.choice([30, 44, 45, 50, 70])]
        texts[d] = " ".join(w + part + [f"e{d}x{i}" for i in range(random.randrange(40))])
    texts[40] = texts[41] = "again and again " * 60
    texts[42] = "one " * 300
    texts[43] = " ".join(passage[:60] + passage[:60])
    got = {r["doc_id"]: r for r in repeats.repeated_passages(table(list(texts.items())).repartition(5)).collect()}
    for d, (n, every, extra) in brute.repeats(texts, 50).items():
        if not every:
            assert d not in got
            continue
        r = got[d]
        assert r["n_words"] == n
        assert {i for a, b in zip(r["starts"], r["ends"]) for i in range(a, b)} == every, d
        assert {i for a, b in zip(r["extra_starts"], r["extra_ends"]) for i in range(a, b)} == extra, d


def test_remove_repeats(table):
    body = " ".join(f"p{i}" for i in range(60))
    rows = [(2, f"start {body}\nend", 1), (1, f"{body} tail", 2), (3, body, 3), (4, None, 4), (5, "short", 5), (6, "", 6)]
    got = repeats.remove_repeats(table(rows, "doc_id long, text string, blob int")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(2, "start end", 1), rows[1], rows[3], rows[4], rows[5]], key=str)
    assert repeats.remove_repeats(table([])).count() == 0


def test_repeats_of_odd_rows(table):
    assert repeats.repeats_digest(table(ODD)).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_links int")


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(40, 16))
    data = np.concatenate([base, base[:20] + 0.05 * rng.normal(size=(20, 16)), np.repeat(base[:1] + 0.1, 30, axis=0), base[5:6] * 3]).astype(np.float32)
    rows = [(k, [float(x) for x in v], 0) for k, v in enumerate(data)]
    got = {r["vec_id"]: r for r in embeddings.near_vectors(vectors(spark, rows), cell_rows=20, block_rows=8).collect()}
    x = data.astype(np.float64)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    close = x @ x.T >= 0.9
    want = brute.components(range(len(x)), zip(*np.nonzero(close)))
    missed = sum(close[k].sum() - 1 - got[k]["n_links"] for k in range(len(x)))
    assert missed == 0
    assert {k: (r["component_id"], r["kept"]) for k, r in got.items()} == {k: (c, c == k) for k, c in want.items()}


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, None, 1), (4, [0.0, 0.0], 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1), (7, [None, 1.0], 1), (8, [], 1),
            (9, [1.0, 0.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [0.0, 1.0], 1)]
    got = sorted(((r["vec_id"] or 0), r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_vectors(vectors(spark, rows)).collect())
    assert got == [(0, 0, None, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)] + [(k, 0, k, True) for k in range(3, 10)]
    assert embeddings.near_vectors(vectors(spark, [])).count() == 0
    assert sorted(r["vec_id"] or 0 for r in embeddings.representatives(vectors(spark, rows)).collect()) == [0, 1, 1, 3, 4, 5, 6, 7, 8, 9]
