import hashlib
import re
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row

from tallyproof.llm import decontamination, html, language, licenses, ngrams
from tallyproof.llm.queries import QUERIES
from tests.llm import brute
from tests.llm.conftest import ODD


# ---- decontamination

ITEMS = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "short item"), (3, ""), (4, None), (1, "one two three four five six seven eight nine ten"),
         (5, "ONE two, three four five six seven eight nine ten eleven"), (None, "no id here")]
DOCS = [(10, "x Alpha beta gamma delta-epsilon zeta eta theta iota kappa y"), (11, "alpha beta gamma delta epsilon zeta eta theta iota"), (12, "a short item and a short item"),
        (13, "one two three four five six seven eight nine ten eleven"), (14, "short"), (15, "item short"), (16, "there is no id here")]


def check_contamination(table, docs, items, **options):
    frame = table(docs)
    found = brute.windows([("" if i is None else i, t) for i, t in items])
    got = sorted(decontamination.contamination(frame, table(items, "item_id long, text string")).collect(), key=str) if not options else None
    if options:
        rows, out = decontamination.match_benchmark(frame, table(items, "item_id long, text string"), **options)
        got = [Row(doc_id=r["doc_id"], n_words=r[out]["n_words"], n_hit=sum(b - a for a, b in zip(r[out]["starts"], r[out]["ends"])), items=r[out]["items"]) for r in rows.collect()]
        want = [(d, n, len(at), items_) for d, t in docs for n, at, items_ in [brute.hits(t, found)]]
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
        return
    want = []
    for d, t in docs:
        n, at, names = brute.hits(t, found)
        want.append((d, n, len(at), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(at)))
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(want, key=str)


def test_contamination_equals_brute_force(table):
    check_contamination(table, DOCS + ODD, ITEMS)


def test_blocks_add_up(table):
    check_contamination(table, DOCS + ODD, ITEMS, block_words=12)


def test_longest_match(table):
    got = {r["doc_id"]: r for r in decontamination.contamination(table(DOCS), table(ITEMS, "item_id long, text string")).collect()}
    assert (got[10]["longest"], got[10]["longest_at"], got[10]["longest_item"]) == (10, 1, "1")
    assert (got[13]["longest"], got[13]["longest_at"], got[13]["longest_item"]) == (11, 0, "5")
    assert (got[11]["longest"], got[11]["longest_at"]) == (0, None)


def test_decontaminate_and_empty_tables(table):
    docs = table([(d, t, d) for d, t in DOCS], "doc_id long, text string, found long")
    items = table(ITEMS, "item_id long, text string")
    assert sorted(map(tuple, decontamination.decontaminate(docs, items).collect())) == [(d, dict(DOCS)[d], d) for d in (11, 14, 15)]
    none = table([], "item_id long, text string")
    assert decontamination.decontaminate(docs, none).count() == len(DOCS)
    assert decontamination.contamination(table([]), items).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), max_size=30), min_size=1, max_size=6), st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=12), min_size=1, max_size=4))
def test_suffix_arrays_find_all_windows(texts, items):
    words = np.array([x for t in texts for x in t], dtype=np.uint64)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    block = decontamination.TestBlock([(str(i), np.array(x, dtype=np.uint64)) for i, x in enumerate(items)], 4)
    place, width, source, length, best = decontamination.search(words, bounds, block)
    want, longest = set(), {}
    for item in items:
        k = min(4, len(item))
        for i in range(len(item) - k + 1):
            for t, text in enumerate(texts):
                for j in range(len(text) - k + 1):
                    if text[j: j + k] == item[i: i + k]:
                        want.add((int(bounds[t]) + j, k))
    assert set(zip(place.tolist(), width.tolist())) == want
    flat = [x for t in texts for x in [*t, None]]
    for p, n, b in zip(place.tolist(), length.tolist(), best.tolist()):
        t = int(np.searchsorted(bounds, p, side="right")) - 1
        text = texts[t][p - int(bounds[t]):]
        common = [next((k for k, (x, y) in enumerate(zip(text, item[i:])) if x != y), min(len(text), len(item) - i)) for item in items for i in range(len(item))]
        assert n == max(common) and len(flat)


# ---- languages

LINES = {
    "en": "the cat and the dog are in the house with that man which is here and there", "de": "der hund und die katze sind nicht im haus mit dem mann und der frau",
    "fr": "le chat et le chien sont dans la maison avec les enfants qui ne sont pas là", "es": "el perro y el gato están en la casa con los niños que no son de aquí",
}


def sentences(n=60):
    rng = np.random.default_rng(8)
    out = []
    for k, (lang, line) in enumerate(LINES.items()):
        w = line.split()
        out += [(1000 * k + i, " ".join(rng.choice(w, 25)), lang) for i in range(n)]
    return out


def test_held_out_accuracy(table):
    rows = sentences()
    got = {r["doc_id"]: r for r in language.predictions(table([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert {d for d, r in got.items() if r["held_out"]} == {r[0] for r in held}
    assert all(got[d]["lang_pred"] == lang and 0.5 < got[d]["score"] <= 1 for d, _, lang in held)


STRANGE = [" ".join(f"{x:x}zq" for x in range(10**6, 10**6 + 40)), "qwrtz xkcdv bnmpf ghjkl " * 8, "x" * 500,
           "nopea ruskea kettu hyppii laiskan koiran yli ja juoksee kotiin pitkin polkua jossa perhe odottaa", "Быстрая лиса прыгает через ленивую собаку и бежит домой через лес"]


@pytest.mark.parametrize("known", [("en",), ("en", "fr"), ("en", "de", "fr", "es")])
def test_what_is_like_no_learned_language(table, known):
    """However many languages are learned: junk and languages never learned are told from clean texts, and still get a learned language."""
    clean = [r for r in sentences() if r[2] in known]
    odd = [(9000 + i, t, None) for i, t in enumerate(STRANGE)]
    got = {r["doc_id"]: r for r in language.predictions(table(clean + odd, "doc_id long, text string, lang string")).collect()}
    assert all(got[d]["lang_pred"] == lang and got[d]["score"] > 0.5 and got[d]["like"] for d, _, lang in clean)
    assert all(got[d]["lang_pred"] in known and got[d]["score"] > 0 and not got[d]["like"] for d, _, _ in odd)


def test_odd_texts_and_labels(table):
    odd = [(5000 + i, t, None) for i, (_, t) in enumerate(ODD)] + [(6000, "12 34 ...", "en"), (6001, "le chat", None), (None, "der hund", "de")]
    got = {r["doc_id"]: r for r in language.predictions(table(sentences() + odd, "doc_id long, text string, lang string")).collect()}
    assert all((got[d]["lang_pred"], got[d]["score"]) == ("und", 0.0) for d in (5000, 5001, 5002, 5010, 6000))
    assert got[6001]["lang_pred"] == "fr" and got[5006]["lang_pred"] in LINES and got[None]["held_out"] is False


def test_no_labels_and_one_language(table):
    schema = "doc_id long, text string, lang string"
    assert language.predictions(table([], schema)).count() == 0
    assert [r["lang_pred"] for r in language.predictions(table([(1, "a text", None)], schema)).collect()] == ["und"]
    assert {r["lang_pred"] for r in language.predictions(table([(i, "a text", "xx") for i in range(9)], schema)).collect()} == {"xx"}


def test_families():
    assert [language.family_of(x) for x in ("de", "en-US", "fr", "pt_BR", "zz")] == ["germanic", "germanic", "romance", "romance", "zz"]


# ---- licences

def test_license_finds_equal_brute_force(table):
    rows = ODD + [(20, "CC BY, cc-by! cc bye"), (21, "GNU General Public License. All rights  reserved"), (22, "All rights reserved all RIGHTS reserved"),
                  (23, "SPDX-License-Identifier: MIT OR GPL-3.0-only\nx"), (24, "Licensed under CC BY-NC 4.0.")]
    got = {(r["doc_id"], r["n_words"]): r for r in licenses.license_digest(table(rows)).collect()}
    for d, t in rows:
        w, at, labels = brute.words(t, brute.ALNUM), [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            here = [i for i in range(len(w)) if w[i: i + len(p)] == p]
            at += here
            labels |= {label} if here else set()
        r = got[d, len(w)]
        assert (r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))
        assert labels <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    by = {d: r for (d, _), r in got.items()}
    assert (by[23]["labels"], by[23]["score"]) == ("gpl,mit", 0.2) and (by[24]["labels"], by[24]["score"]) == ("cc-by,cc-by-nc", 0.9)


@pytest.mark.parametrize("text, labels, score", [
    ("pàgina pàgina pàgina\nSPDX-License-Identifier: MIT", "mit", 0.2), ("Реферат охрана GPL-3.0-only OR MIT\nSPDX-License-Identifier: GPL-3.0-only OR MIT", "gpl,mit", 0.7),
    ("Реферат охрана\nSPDX-License-Identifier: GPL-3.0-only OR MIT", "gpl,mit", 0.2), ("хххх хаха\nlicense: MIT", "mit", 0.2), ("日本語 à\x85\xa0b license: MIT", "mit", 0.2),
    ("SPDX-License-Identifier: Artistic-2.0 OR MIT", "artistic,mit", 0.2), ("SPDX-License-Identifier: LicenseRef-x OR GPL-3.0", "gpl,licenseref-x", 0.5),
    ("SPDX-License-Identifier: BUSL-1.1", "busl", 0.9), ("SPDX-License-Identifier: NOASSERTION", "noassertion", 0.5), ("// SPDX-License-Identifier: (GPL-2.0+ WITH Classpath-exception-2.0) AND BSD-3-Clause-Clear */ x", "bsd,gpl", 0.4),
    ("SPDX-License-Identifier: MIT Copyright AGPL-3.0", "agpl,mit", 0.8), ("SPDX-License-Identifier: mit and (EUPL-1.2 or (zlib", "eupl,mit,zlib", 0.2), ("SPDX-License-Identifier:\n", "", 0.0),
    ("license: see the file", "", 0.0), ("License: Apache License 2.0 or MIT", "apache,mit", 0.2), ("license: EPL-2.0 OR Ruby", "epl,ruby", 0.3), ("SPDX-License-Identifier: CC-BY-NC-SA-4.0", "cc-by,cc-by-nc,cc-by-nc-sa", 0.9),
])
def test_tags_in_any_script_and_unknown_identifiers(text, labels, score):
    n, finds, expressions, got = licenses.scan(text.encode())
    assert n == len(brute.words(text, brute.ALNUM))
    assert ",".join(sorted({x[3] for x in finds} | {x for _, names, _ in expressions for x in names})) == labels and got == pytest.approx(score)


def test_license_columns(table):
    frame = table([(1, "license: MIT", "x"), (1, "license: MIT", "x"), (None, None, None)], "doc_id long, text string, licenses string")
    out, name = licenses.scan_licenses(frame)
    assert name == "licenses_" and out.columns == [*frame.columns, name] and out.count() == 3
    assert licenses.license_digest(table([])).count() == 0


@pytest.mark.parametrize("tokens, want", [
    ([0.2], 0.2), ([0.2, "or", 0.7], 0.2), ([0.2, "and", 0.7], 0.7), ([0.9, "or", 0.2, "and", 0.5], 0.5), (["(", 0.9, "or", 0.2, ")", "and", 0.5], 0.5),
    ([0.9, "and", "(", 0.2, "or", 0.5, ")"], 0.9), ([0.7, "with", 0.0], 0.4), ([0.2, "and", 0.7, "with", 0.0], 0.4), ([], None), (["or", "and"], None),
    (["(", "(", 0.5], 0.5), ([0.5, ")", "or"], 0.5), ([0.2, 0.9], 0.9), ([")", "("], None),
])
def test_expressions(tokens, want):
    assert licenses.rank_of(tokens) == (pytest.approx(want) if want is not None else None)


# ---- pages

@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("plain", "plain"), ("a<!-- b -->c", "ac"), ("<p>a<p>b", "a\n\nb"), ("<div>a</div><div>b</div>c", "a\nb\nc"),
    ("a<br>b<br><br>c", "a\nb\n\nc"), ("<p>one  <b>tw</b>o &amp; &lt;3</p>", "one two & <3"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"), ("<ol start=9><li>a<li>b</ol>", "9. a\n10. b"),
    ("<table><tr><th>Name<th>N<tr><td>longer<td>1</table>", "Name    N\nlonger  1"), ("<table><tr><td>a</td></tr><tr><td>b<p>c</td><td>d</td></tr></table>", "a\nb  d\n\nc"),
    ("<script>a</script><style>b</style><p hidden>c</p><p style='color:red;display : none'>d</p><i aria-hidden=true>e</i>f", "ef"),
    ("<details><summary>s</summary>closed</details><details open><summary>t</summary>open</details>", "s\nt\nopen"),
    ("<pre>a\n  b</pre>", "a\n  b"), ("<title>t</title><body>b", "b"), ("<head><meta charset=x><p>b", "b"), ("</p></div></x>a", "a"), ("<p", ""), ("a < b", "a < b"),
    ("<dl><dt>t<dd>d</dl>", "t\n    d"), ("<input value=x><input type=submit value=Go><input type=hidden value=h><input type=password value=p>", "x Go"), ("<td>a<td>b", "a b"),
])
def test_visible_text(page, text):
    assert html.visible_text(page) == text


@pytest.mark.parametrize("page, text", [
    ("<table><form><tr><td>x</td></tr></form></table>", "x"), ("<table><tr><form><td>a</td><td>b</td></form></tr></table>", "a  b"),
    ("<table><center><tr><td>a<tr><td>b</center></table>", "a\nb"), ("<table><div><form><tbody><tr><td>a</table>", "a"), ("<table><form><td>a<td>b<tr><td>c</table>", "a  b\nc"),
    ("u<table>note<tr><td>a</table>v", "u\n\nnote\n\na\n\nv"), ("<table><tr>t<td>a</td>u</tr></table>", "tu\n\na"), ("<table><tr><td>a</td></tr><div>b <i>c</i><p>d</div></table>", "b c\n\nd\n\na"),
    ("<table><div hidden>n<tr><td>a</table>", "a"), ("<table><input type=submit value=Go><tr><td>a</table>", "Go\n\na"), ("<table><template><tr><td>n</template><tr hidden><td>n<tr><td>a</table>", "a"),
    ("<table><b>x<table><tr><td>y</table></b><tr><td>a</table>", "x\n\ny\n\na"), ("<table><tr><td>a</tr><td>b<tr><td>c</table>", "a\nb\nc"),
])
def test_nothing_visible_is_lost_in_tables(page, text):
    assert html.visible_text(page) == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("<table> </table> <tr> </tr> <td> </td> <form> </form> <div> </div> <center> <tbody> <caption> <b> </b> <p> <ul> <li> w w w".split(" ")), max_size=30))
def test_all_words_of_tables_come_out(parts):
    parts = [f" w{k} " if x == "w" else x for k, x in enumerate(parts)]
    assert sorted(x for x in html.visible_text("".join(parts)).split() if x[0] == "w") == sorted(x.strip() for x in parts if x[1] == "w")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("<p> </p> <li> <ul> </ul> <table> <tr> <td> </table> <div> </div> <b a='x'> </b> <!-- --> <script> </script> <pre> <ol> x y &amp; < > ' \" \n <details> <br>".split(" ")), max_size=40))
def test_any_page_gives_text(parts):
    text = html.visible_text("".join(parts))
    assert text == text.rstrip("\n") and not re.search(r"</?(p|li|ul|table|tr|td|div|pre|ol|br)>|<!--", text)


@pytest.mark.parametrize("page, text", [
    ('<a href="x"">Hello</a>', "Hello"), ("<p title=it's>Hello</p>", "Hello"), ("<p title='a>b' class=\"c>d\">e", "e"), ("<p a = 'b' c=/d/ / e>f", "f"), ("<p =a>b", "b"),
    ("<p a=>b", "b"), ("<p 'x>b", "b"), ("a<p title='never ends>b", "a"), ("a</>b</ c>d<?e>f<!g>h", "abdfh"), ("a<!-->b<!-- -- -->c", "abc"), ("a<!-- b", "a"),
    ("E = <math><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></math>", "E = mc2"), ("<svg><title>no</title><defs>no</defs><text>one</text><text>two</text></svg>", "one two"),
    ("<p hidden style='display:block'>a</p><p style='display:none;display:block'>b</p><p style='display:none!important;display:block'>c</p>", "a\n\nb"),
    ("<div style='visibility:hidden'>a<i style='visibility:visible'>b</i>c</div>d", "b\nd"), ("<dialog>a</dialog><dialog open>b</dialog>", "b"),
    ("<script>if (a</b) '</scripts>'</script>x", "x"), ("<textarea>&lt;a></textarea><TITLE>t</TITLE >y", "<a>\ny"),
    ("<table><tr><td colspan=2>wide cell<td>x<tr><td>a<td>b<td>c</table>", "wide cell  x\na  b       c"),
    ("<table><tr><td rowspan=2>tall<td>a<tr><td>b<tr><td>c<td>d</table>", "tall  a\n      b\nc     d"),
    ("<table><tr><td>a<td rowspan=0>r<tr><td>b<tr><td>c<td>d</table>", "a  r\nb\nc     d"), ("<table><tr><td colspan=999999999>a<tr><td>b</table>", "a\nb"),
    ("<table><tr><td style='visibility:hidden'>gone<td>a<tr><td>bb<td>c</table>", "    a\nbb  c"),
])
def test_tags_visibility_and_spans(page, text):
    assert html.visible_text(page) == text


@pytest.mark.parametrize("part", ["<a 'x ", "<a ", "<a b=\"", "<!-- ", "<script>", "a <", "</", "<a b = ", "<td rowspan=3>", "<![CDATA["])
def test_long_odd_pages_take_time_in_proportion(part):
    start = time.process_time()
    html.visible_text(part * (1_000_000 // len(part)))
    assert time.process_time() - start < 10


def test_deep_pages():
    assert html.visible_text("<div>" * 20_000 + "x") == "x" and html.visible_text("<table><tr><td>" * 3000 + "y").strip() == "y"


@pytest.mark.parametrize("open_", ["<b>", "<font>", "<span>", "<div>", "<b><div>"])
def test_the_same_rules_hold_at_every_depth(open_):
    part = ("<ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td>long<td>x<tr><td>y<td>z</table><pre>p\n  q</pre><input type=submit value=Go>"
            "<details><summary>s</summary>closed</details><ol start=3><li>d</ol>")
    want = html.visible_text(part)
    assert "- a\n- b\n  - c" in want and "long  x\ny     z" in want and "closed" not in want
    for depth in (149, 151, 5000):
        assert html.visible_text(open_ * depth + part) == want


def test_deep_lists_and_tables_keep_text_and_marks():
    n = 3000
    got = html.visible_text("".join(f"<ul><li>w{k}" for k in range(n)))
    assert [x.split() for x in got.split("\n")] == [["-", f"w{k}"] for k in range(n)] and len(got) < 400 * n
    got = html.visible_text("".join(f"<table><tr><td>w{k}<td>v{k}" for k in range(n)))
    assert sorted(got.split()) == sorted(f"{x}{k}" for k in range(n) for x in "vw")
    assert html.visible_text("<dl><dd>x" * n).split() == ["x"] * n and html.visible_text("<ul><li>" * 300 + "<details><summary>s</summary>n").split() == ["-"] * 300 + ["s"]


def test_page_table(table):
    rows = [(1, "<p>a", "t"), (2, None, "t"), (2, None, "t"), (None, "", "t")]
    frame = table(rows, "page_id long, html string, visible_text string")
    assert sorted(map(str, html.page_texts(frame).collect())) == sorted(map(str, [
        Row(page_id=1, text="a", n_chars=1, n_lines=1), *[Row(page_id=i, text="", n_chars=0, n_lines=0) for i in (2, 2, None)]]))
    out, name = html.extract_text(frame)
    assert name == "visible_text_" and out.columns == [*frame.columns, name]
    assert html.page_texts(table([], "page_id long, html string")).count() == 0


# ---- n-grams

@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**50), max_size=200))
def test_elias_fano(values):
    values = np.array(sorted(values), dtype=np.uint64)
    coded = ngrams.EliasFano.encode(values)
    assert (coded[np.arange(len(values))] == values).all()
    if len(values):
        asked = np.concatenate([values, values + np.uint64(1), np.array([0], dtype=np.uint64)])
        n = np.full(len(asked), len(values))
        assert (coded.successor(asked, np.zeros(len(asked)), n) == np.searchsorted(values, asked)).all()


def test_trie_in_a_mapped_file(tmp_path):
    rng = np.random.default_rng(1)
    keys = np.unique((rng.integers(0, 50, 3000).astype(np.uint64) << np.uint64(32)) | rng.integers(0, 2**32, 3000).astype(np.uint64))
    codes = rng.integers(1, 255, len(keys)).astype(np.uint8)
    path = tmp_path / "trie"
    path.write_bytes(ngrams.Trie.build(keys, codes).to_bytes())
    trie = ngrams.Trie.open(path)
    assert (trie.find(keys) == codes).all() and not trie.find(keys + np.uint64(1))[~np.isin(keys + np.uint64(1), keys)].any()
    assert path.stat().st_size < 8 * len(keys)
    assert ngrams.Trie.build(keys[:0], codes[:0]).find(keys[:3]).tolist() == [0, 0, 0]


def plain_scores(rows):
    import math
    from collections import Counter

    tokens = [(d, [*brute.words(t), None]) for d, t in rows]
    learn = [d is not None and zlib.crc32(str(d).encode()) % 10 != 0 for d, _ in tokens]
    one, two, begin = Counter(), Counter(), sum(learn)
    for (_, w), yes in zip(tokens, learn):
        if yes:
            one.update(w)
            two.update(zip(["<", *w], w))
    n, v = sum(one.values()), len(one)
    for (d, w), _ in zip(tokens, learn):
        p = [(one[x] + 0.1) / (n + 0.1 * (v + 1)) for x in w]
        q = []
        for before, x, y in zip(["<", *w], w, p):
            c = begin if before == "<" else one[before]
            seen = math.exp(round(math.log(two[before, x]) / 0.1) * 0.1) if two[before, x] else 0
            q.append(0.6 * min(1, seen / c) + 0.4 * y if c else y)
        yield d, len(w), sum(one[x] > 0 for x in w), n, sum(map(math.log10, p)), sum(map(math.log10, q))


def test_scores_equal_brute_force(table):
    rng = np.random.default_rng(2)
    rows = ODD + [(100 + i, " ".join(f"w{k}" for k in rng.geometric(0.2, rng.integers(1, 40)))) for i in range(60)]
    got = sorted(((r["doc_id"] or 0, r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in ngrams.score_digest(table(rows).repartition(3)).collect()))
    assert got == sorted((d or 0, a, b, n, round(x, 6), round(y, 6)) for d, a, b, n, x, y in plain_scores(rows))


def test_nothing_to_learn_from(table):
    assert ngrams.score_digest(table([])).count() == 0
    got = ngrams.score_texts(table([(1, "a b"), (2, None)]), learn="false").collect()
    assert all((r["train_tokens"], r["n_known"], r["base_score"], r["score"]) == (0, 0, 0.0, 0.0) for r in got)


def test_model_shards(table):
    shards = ngrams.train(table([(1, "a b a b"), (2, "a c")])).collect()
    assert sum(r["bigrams"] for r in shards) == 6  # begin-a a-b b-a b-end a-c c-end
    for r in shards:
        ngrams.Trie.from_buffer(np.frombuffer(bytes(r["trie"]), dtype=np.uint64))


# ---- queries

def test_queries_are_complete():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_learning_makes_no_copy_of_the_rows():
    """The driver learns from the feature rows where they lie: a copy of them for each model went beyond its memory."""
    import tracemalloc

    from tallyproof.llm.language import linear_svm

    rng = np.random.default_rng(1)
    x = np.ones((2000, 2049), dtype=np.float32)
    x[:, :-1] = rng.random((2000, 2048), dtype=np.float32) / 32
    at = np.arange(0, 2000, 2)
    x[at[::2], 0] += 1
    y = np.where(np.arange(len(at)) % 2 == 0, 1, -1)
    tracemalloc.start()
    w = linear_svm(x, at, y, epochs=2)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < x.nbytes / 3
    assert ((x[at] @ w > 0) == (y > 0)).mean() > 0.9
