import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyproof.functions import text as X
from tallyproof.operators import docs as D
from tallyproof.operators import search as S
from tallyproof.plans.bundle import published, questions
from tallyproof.sources import bundle as B


@pytest.fixture(scope="module")
def bundle(spark, small):
    return published(spark, small)


def test_only_sound_claims_are_published(bundle):
    failed = {r["id"] for r in bundle.verdicts.where("verdict = 'FAIL'").collect()}
    docs = {r["id"] for r in bundle.docs.collect()}
    assert failed and not failed & docs
    seeded = {r["id"] for r in bundle.verdicts.where("seeded_defect").collect()}
    assert seeded == failed


def test_claims_grow_with_the_tables(spark, small, bundle):
    suppliers = spark.read.parquet(f"{small}/supplier.parquet").count()
    assert bundle.claims.where("id RLIKE '_s[0-9]+$'").count() == suppliers == bundle.trend_claims.count()
    log = {r["section"]: r for r in bundle.snapshot.table("audit").collect()}
    assert log["malformed"]["note"].endswith("lines are no claims") and log["claims"]["run_at"] > "2026"


def test_markdown_round_trip(spark, bundle, tmp_path):
    for r in D.raw_documents(bundle.docs).collect():
        (tmp_path / f"{r['id']}.md").write_text(r["raw"])
    back = {r["id"]: r for r in B.scan_markdown(spark, str(tmp_path)).collect()}
    assert set(back) == {r["id"] for r in bundle.docs.collect()}
    assert back["refunded"]["variable"] == "refund" and back["refunded"]["unit"] == "%"
    assert back["refunded"]["value"] == pytest.approx(bundle.docs.where("id = 'refunded'").first()["value"])
    assert D.conformance_issues(D.raw_documents(bundle.docs)).isEmpty()


def test_no_leak_and_links(bundle):
    assert D.quarantine_leaks(bundle.docs, bundle.verdicts).isEmpty()
    assert [r["target"] for r in D.dangling_links(bundle.docs).collect()] == ["no_such_doc"]


def test_answers_come_from_published_documents(spark, bundle):
    hits = S.search_documents(bundle.docs, questions(spark))
    answers = {r["question_id"]: r for r in S.answer_extractive(hits, questions(spark)).collect()}
    first = answers[1]["source"].split()[0]
    assert first.startswith("sent_back") and answers[5]["mode"] == "refused"
    value = bundle.docs.where(F.col("id") == first).first()["value"]
    assert f"{value:.2f}%" in answers[1]["answer"]
    texts = {r["question_id"]: r["results"] for r in S.search_results_text(hits, questions(spark)).collect()}
    assert texts[5] == S.NO_HIT and f"[{first}]" in texts[1]


CORPUS = [
    (1, "Insulin and the pump. Insulin pump use, café"), (2, "pump pump the of"), (3, "Nothing in common a b c"),
    (4, "insulin café x_y 42"), (5, "insulin café x_y 42"), (6, ""), (7, "of the and"),
]


def brute_search(query, k):
    stop = set(S.default_stop_words())

    def counts(text):
        return Counter(t for t in re.findall(r"\w{2,}", text.lower()) if t not in stop)

    docs = {i: counts(t) for i, t in CORPUS}
    df = Counter(t for c in docs.values() for t in c)
    idf = {t: math.log((1 + len(CORPUS)) / (1 + n)) + 1 for t, n in df.items()}

    def unit(c):
        raw = {t: n * idf[t] for t, n in c.items() if t in idf}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        return {t: v / norm for t, v in raw.items()} if norm else {}

    asked = unit(counts(query))
    scores = {i: sum(asked.get(t, 0) * v for t, v in unit(c).items()) for i, c in docs.items()}
    ranked = sorted((i for i in scores if scores[i] > 0), key=lambda i: (-round(scores[i], 12), i))
    return [(i, scores[i]) for i in ranked[:k]]


@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
def test_topk_equals_brute_force(spark, broadcast):
    """Also when all joins shuffle."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    docs = spark.createDataFrame(CORPUS, "doc long, text string")
    queries = ["insulin pump", "café 42 the", "zzz", "x_y insulin insulin"]
    asked = spark.createDataFrame(list(enumerate(queries)), "q long, text string")
    index = S.tfidf_index(docs, "doc", "text")
    found = S.tfidf_topk(index, asked, query_key="q", text="text", k=3).collect()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for i, query in enumerate(queries):
        got = sorted((r["rank"], r["doc"], r["score"]) for r in found if r["q"] == i)
        want = brute_search(query, 3)
        assert [g[1] for g in got] == [w[0] for w in want]
        assert [g[2] for g in got] == pytest.approx([w[1] for w in want])


def test_text_helpers(spark):
    def value(column):
        return spark.range(1).select(column.alias("v")).first()["v"]

    assert value(X.wikilink_to_markdown(F.lit("a [[B_1]] [[no link]]"))) == "a [B_1](./B_1.md) [[no link]]"
    assert value(X.first_sentence(F.lit("  One thing. Another."))) == "One thing."
    assert value(X.first_sentence(F.lit("Only this..."))) == "Only this."
    assert value(X.first_sentence(F.lit("  "))) is None
    assert value(X.one_line(F.lit('a \n "b"  c'))) == "a 'b' c"
    assert value(X.codes_text(F.array(F.lit(2), F.lit(1), F.lit(7)))) == "1, 2, 7"
    assert value(X.codes_text(F.sequence(F.lit(0), F.lit(95)))) == "0..95"
    assert value(X.codes_text(F.array().cast("array<int>"))) == "no codes"
    assert value(X.list_text(F.array(F.lit("a"), F.lit("b")))) == "[a, b]"
    years = F.create_map(F.lit(2000), F.lit(2.5), F.lit(1996), F.lit(1.25))
    assert value(X.year_map_text(years)) == "{1996: 1.25, 2000: 2.50}"
    assert value(X.identifiers(F.lit("(a == 1) | (b == 2) & a > 3"))) == ["a", "b"]
    assert value(X.utc_stamp(F.timestamp_seconds(F.lit(0)))) == "1970-01-01T00:00:00Z"
    assert value(X.thousands_text(F.lit(25248324.4))) == "25,248,324"
    assert value(X.body_text(F.lit("no header"))) == "no header"
    assert value(X.front_matter(F.lit("---\na: 1\n---\nbody"))) == "a: 1"
