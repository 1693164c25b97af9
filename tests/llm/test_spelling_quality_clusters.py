import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyproof.llm import clusters, quality, spelling
from tallyproof.llm.queries import QUERIES
from tests.llm import brute
from tests.llm.conftest import ODD

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def plain_counts(rows):
    out = Counter()
    for d, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(brute.LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(counts, times=10):
    near = {w: [] for w in counts}
    words = sorted(counts)
    for i, a in enumerate(words):
        for b in words[i + 1:]:
            if abs(len(a) - len(b)) <= 1 and one_edit(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= times * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None)
    return out


def rows_of(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_spelling_of_the_given_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    want = plain_variants(plain_counts([(r["doc_id"], r["text"]) for r in docs.collect()]))
    got = QUERIES["op11_spelling_variants"](spark, small)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert rows_of(got) == want and len(want) > 1000 and any(v[0] for v in want.values())


def test_spelling_of_few_letters_and_odd_words(spark):
    """Words over two letters have many near ones, runs of one letter and ends that can be edited in several places."""
    rng = random.Random(4)
    counts = {"".join(rng.choice("ab") for _ in range(rng.randint(7, 10))): rng.choice([2, 3, 40, 500, 9000]) for _ in range(400)}
    counts |= {"é" * k: 3 * 11 ** (k - 7) for k in range(7, 14)} | {"日本語テキスト長": 5, "日本語テキスト長い": 50, "x" * 3000: 2, "x" * 2999 + "y": 30, "abcdefg\U0001F600": 2, "abcdefg": 20}
    got = rows_of(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n int")))
    assert got == plain_variants(counts)
    assert got["é" * 7][1] == "é" * 13  # a chain of forms


def test_a_common_prefix_and_suffix(spark):
    """All words but the middle are alike: a key that holds all of them."""
    rng = random.Random(5)
    counts = {"beginning" + "".join(rng.choice("abcdefghij") for _ in range(3)) + "ending": rng.choice([2, 30, 500]) for _ in range(700)}
    assert rows_of(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"))) == plain_variants(counts)


def test_forms_need_not_be_more_frequent(spark):
    counts = {"abcdefg": 5, "abcdefh": 6, "abcdefi": 6, "zzzzzzz": 1}
    got = rows_of(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"), times=10))
    assert all(v[0] is None and v[1] == w for w, v in got.items()) and got["abcdefg"][3] == 2


def test_single_edits_of_pairs():
    words = ["", "a", "ab", "ba", "aab", "aaab", "abab", "baba", "abba", "cabba"]
    points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
    first = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    i, j = np.triu_indices(len(words), 1)
    near, place = spelling.single_edits(points, first, i, j)
    assert near.tolist() == [one_edit(words[a], words[b]) for a, b in zip(i, j, strict=True)]
    assert all(words[a][:p] == words[b][:p] for a, b, p in zip(i, j, place, strict=True))


def test_spelling_of_odd_documents(spark, table):
    rows = ODD + [(20, "VARIANT variant Variant variänt"), (21, "variänt Straße×÷Öl stra")]
    docs = table([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, word string, n int")
    assert rows_of(spelling.spelling_variants(docs)) == plain_variants(plain_counts(rows))
    assert spelling.spelling_variants(table([])).count() == 0
    assert spelling.spelling_variants(table([(None, None), (1, "")])).count() == 0


def plain_quality(text):
    w = brute.SPACED.findall(text or "")
    places = Counter(tuple(w[i: i + 8]) for i in range(len(w) - 7))
    covered = {i + j for i in range(len(w) - 7) if places[tuple(w[i: i + 8])] > 1 for j in range(8)}
    lines = [x for x in (text or "").split("\n") if brute.SPACED.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


LINES = ["one two three four five six seven eight nine", "a line\twith   odd blanks ", "a line\twith   odd blanks", "", "  ", "#*$ %& |<> é ü 日本 \U0001F600"]


def test_counts_against_a_plain_version(spark, small):
    rng = random.Random(6)
    texts = [t for _, t in ODD] + ["\n".join(rng.choice(LINES) for _ in range(rng.randint(1, 30))) for _ in range(40)]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randint(1, 60))) for _ in range(80)] + ["word " * 5000, " not space\x0bspace\x1cno"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(spark.read.parquet(f"{small}/documents.parquet").selectExpr("doc_id + 1000 as doc_id", "text"))
    for r in quality.measured(docs).select("text", "counts.*").collect():
        assert tuple(r[x] for x in quality.COUNTS) == plain_quality(r["text"]), r["text"]


def exact_below(n, k, p):
    p = Fraction(p).limit_denominator(1000)
    return sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))


def test_binomial_bounds_are_exact(spark):
    cases = [(n, k) for n in (1, 2, 5, 19, 20, 21, 60, 250, 1030) for k in {0, 1, 2, n // 60, n // 55} if k <= n]
    df = spark.createDataFrame(cases, "n long, k long").withColumn("p", quality.binomial_below(F.col("n"), F.col("k"), 0.02))
    for r in df.collect():
        want = 1.0 if r["k"] >= r["n"] * 0.02 else float(exact_below(r["n"], r["k"], 0.02))
        assert r["p"] == pytest.approx(want, rel=1e-10)
    # a large holdout: the sum is cut where nothing is left, against a normal approximation
    far = spark.createDataFrame([(10**9, 20_000_000 - 2 * 4427)], "n long, k long").select(quality.binomial_below(F.col("n"), F.col("k"), 0.02)).first()[0]
    assert far == pytest.approx(0.5 * math.erfc(2 / 2**0.5), rel=2e-3)


def documents(spark, rng, n, *, lang=("en", "de", None), bad=0.2):
    rows, labels = [], []
    for d in range(n):
        is_bad = rng.random() < bad
        words = [f"w{rng.randrange(500)}" for _ in range(rng.randint(25, 60))]
        if is_bad:
            words = [w + "###" for w in words]
        rows.append((d, " ".join(words), rng.choice(lang), "x", True))
        labels.append((d, 0 if is_bad else 1))
    return (spark.createDataFrame(rows, "doc_id long, text string, lang string, rules string, kept boolean"), spark.createDataFrame(labels, "doc_id long, quality int"),
            {d for d, q in labels if not q})


def test_bad_documents_go_and_good_ones_stay(spark):
    docs, labels, bad = documents(spark, random.Random(7), 3000)
    got = {r["doc_id"]: r for r in quality.judged(docs, labels).collect()}
    assert len(got) == 3000 and all(not got[d]["kept"] and "symbols" in got[d]["rejected_by"] for d in bad)
    wrong = [d for d, r in got.items() if d not in bad and not r["kept"]]
    assert len(wrong) <= quality.ALPHA * 3000


def test_without_evidence_nothing_is_rejected(spark):
    docs, labels, _ = documents(spark, random.Random(8), 60, lang=("en",))
    assert all(r["kept"] for r in quality.judged(docs, labels).collect())  # too few to bound anything
    assert all(r["kept"] for r in quality.judged(docs, labels.limit(0)).collect())
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    assert all(r["kept"] for r in quality.judged(docs, none).collect())


def test_thresholds_hold_their_risk(spark):
    """Where a rule tells nothing, chosen levels reject few; levels after the first that fails are not admitted."""
    rng = random.Random(9)
    rows = [(s, rng.random() < 0.5, rng.random() < 0.8, [rng.randrange(900) for _ in quality.RULES]) for s in ("a", "b") for _ in range(1500)]
    rows += [("few", True, True, [1] * len(quality.RULES)), ("only_bad", True, False, [1] * len(quality.RULES))]
    got = quality.thresholds(spark.createDataFrame(rows, "stratum string, tuning boolean, good boolean, rules array<int>")).orderBy("stratum", "level").collect()
    assert {r["stratum"] for r in got} == {"a", "b", "few"} and len(got) == 3 * len(quality.LEVELS)
    assert not any(r["admitted"] for r in got if r["stratum"] == "few")
    for s in ("a", "b"):
        flags = [r["admitted"] for r in got if r["stratum"] == s]
        assert flags == sorted(flags, reverse=True)
    for r in got:
        held = [(x[3]) for x in rows if x[0] == r["stratum"] and not x[1] and x[2]]
        assert (r["n_holdout"], r["n_false"]) == (len(held), sum(any(v > c for v, c in zip(x, r["cutoffs"], strict=True)) for x in held))


def test_quality_of_odd_documents(spark, table):
    rows = [(d, t, None) for d, t in ODD]
    got = quality.judged(table(rows, "doc_id long, text string, lang string"), table([(1, 1), (5, 0)], "doc_id long, quality int")).collect()
    assert len(got) == len(rows) and all(r["base_failed"] and not r["kept"] for r in got)
    assert sorted((r["doc_id"] or 0, r["n_words"], r["word_chars"]) for r in got) == sorted((d or 0, *plain_quality(t)[:2]) for d, t in ODD)
    assert quality.judged(table([], "doc_id long, text string, lang string"), table([], "doc_id long, quality int")).count() == 0


def plain_clusters(rows, cells=8, rounds=10, dimensions=64):
    kept = [(i, [math.floor(Fraction(x) * 1024) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centres = [v for _, v in order[:cells]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centres))

    for _ in range(rounds):
        home = [nearest(v)[1] for _, v in kept]
        for k in range(len(centres)):
            own = [v for (_, v), h in zip(kept, home, strict=True) if h == k]
            if own:
                centres[k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [(i, *nearest(v)) for i, v in kept]
    per = Counter()
    for _, d, k in found:
        per[k] += d
    return sorted((i if i is not None else -1, k, d, per[k], sum(per.values()), hashlib.sha256(",".join(map(str, centres[k])).encode()).hexdigest()) for i, d, k in found)


def cluster_rows(df):
    return sorted((r["vec_id"] if r["vec_id"] is not None else -1, r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in df.collect())


def test_clusters_of_the_given_tables(spark, small):
    vectors = spark.read.parquet(f"{small}/embeddings.parquet")
    got = QUERIES["op13_centroid_clusters"](spark, small)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert cluster_rows(got) == plain_clusters([(r["vec_id"], r["embedding"]) for r in vectors.collect()])


@pytest.mark.parametrize("cells", [1, 3, 8, 40])
def test_clusters_with_ties_and_odd_vectors(spark, cells):
    rng = random.Random(cells)
    rows = [(i, [float(rng.choice([-1, 0, 1])) for _ in range(4)], cells) for i in range(60)]  # many equal vectors and equal distances
    rows += [(100, None, 1), (101, [1.0, None, 0.0, 0.0], 1), (102, [1.0, math.nan, 0.0, 0.0], 1), (103, [math.inf, 0.0, 0.0, 0.0], 1), (104, [1.0], 1), (105, [], 1),
             (106, [0.0] * 4, 1), (None, [0.5, -0.25, 1e-9, -1e-9], 1), (7, [9.0, 9.0, 9.0, 9.0], 1), (107, [300000.0, -2.5, 0.0, 1e6], 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster int").repartition(3)
    assert cluster_rows(clusters.clustered(vectors, cells=cells, dimensions=4, n_pivots=3)) == plain_clusters([r[:2] for r in rows], cells, dimensions=4)


def test_no_and_few_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert clusters.clustered(spark.createDataFrame([], schema)).count() == 0
    assert clusters.clustered(spark.createDataFrame([(1, None), (2, [1.0])], schema)).count() == 0
    one = clusters.clustered(spark.createDataFrame([(1, [0.5] * 64)] * 2, schema)).collect()
    assert [(r["cluster"], r["distance"], r["inertia"]) for r in one] == [(0, 0, 0)] * 2


def test_bounds_are_below_distances_and_spare_work():
    rng = np.random.default_rng(3)
    rows = np.concatenate([rng.normal(size=(1, 64)) * 3 + rng.normal(size=(300, 64)) * 0.3 for _ in range(8)])
    rows = clusters.whole(rows)
    pivots = clusters.Pivots(clusters.spread(rows[rng.permutation(len(rows))[:64]], 6))
    centres = rows[::300].copy()
    cached = pivots.distances(rows)
    below = pivots.below(cached, centres)
    real = np.sqrt(np.stack([clusters.squared(rows, c[None]) for c in centres], axis=1).astype(np.float64))
    assert (below <= real * (1 + 1e-15)).all()
    home, best, checked = clusters.nearest(rows, cached, centres, pivots)
    assert (home == real.argmin(axis=1)).all() and checked < 0.5 * len(rows) * len(centres)
    # a bound that touches the distance: collinear points
    line = clusters.whole(np.outer(np.arange(50.0), np.ones(64)))
    tight = clusters.Pivots(line[[0, 49]])
    assert (tight.below(tight.distances(line), line) <= np.sqrt(np.stack([clusters.squared(line, c[None]) for c in line], axis=1).astype(float))).all()


def test_too_large_components_are_an_error():
    with pytest.raises(ValueError, match="cannot be clustered"):
        clusters.whole(np.array([[1e300]]))
