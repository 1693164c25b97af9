"""Licence scans: an Aho-Corasick automaton over words finds names, notice phrases and identifier tags; what follows a
tag is read as a licence expression and evaluated by a shunting-yard parser.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z, so "GPL-3.0-only" is the words gpl 3 0 only. Each licence
has a rank from 0 (no conditions) to 1 (all rights reserved). After an SPDX tag every identifier is an operand, known or not: known ones belong to a
family by their first parts (GPL-3.0-or-later to gpl), others have their own label and the rank ``UNKNOWN``. In an expression, ``or`` takes the lower rank, ``and`` the higher
one, and ``with`` an exception takes a step off the licence before it. The score of a text is the highest rank of its
expressions and of the names and phrases outside them; 0 if there is none.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyproof.llm.common import ALNUM, new_name, slices, texts_of

#: Phrases counted as base finds, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Names and notice phrases: words -> (label, rank).
NAMES = {
    "public domain": ("public-domain", 0.0), "cc0": ("cc0", 0.0), "unlicense": ("unlicense", 0.0), "0bsd": ("0bsd", 0.0),
    "mit": ("mit", 0.2), "mit license": ("mit", 0.2), "permission is hereby granted free of charge": ("mit", 0.2),
    "isc": ("isc", 0.2), "isc license": ("isc", 0.2), "zlib": ("zlib", 0.2), "boost software license": ("bsl", 0.2), "bsl 1 0": ("bsl", 0.2),
    "bsd": ("bsd", 0.2), "bsd 2 clause": ("bsd", 0.2), "bsd 3 clause": ("bsd", 0.2),
    "redistribution and use in source and binary forms": ("bsd", 0.2),
    "apache": ("apache", 0.2), "apache 2 0": ("apache", 0.2), "apache license": ("apache", 0.2),
    "cc by": ("cc-by", 0.3), "creative commons attribution": ("cc-by", 0.3),
    "cc by sa": ("cc-by-sa", 0.5), "mpl": ("mpl", 0.5), "mpl 2 0": ("mpl", 0.5), "mozilla public license": ("mpl", 0.5),
    "epl 2 0": ("epl", 0.5), "eclipse public license": ("epl", 0.5),
    "lgpl": ("lgpl", 0.6), "lesser general public license": ("lgpl", 0.6),
    "gpl": ("gpl", 0.7), "general public license": ("gpl", 0.7), "agpl": ("agpl", 0.8), "affero general public license": ("agpl", 0.8),
    "cc by nd": ("cc-by-nd", 0.8), "cc by nc": ("cc-by-nc", 0.9), "cc by nc sa": ("cc-by-nc-sa", 0.9), "cc by nc nd": ("cc-by-nc-nd", 0.9),
    "proprietary": ("proprietary", 1.0), "all rights reserved": ("reserved", 1.0),
}
#: Names that say little in running text and count in expressions only.
ONLY_TAGGED = {"mit", "isc", "zlib", "bsd", "apache", "unlicense", "proprietary", "mpl", "public domain"}
TAGS = ("spdx license identifier", "license", "licence", "licensed under", "released under", "distributed under")
EXCEPTIONS = ("classpath exception", "gcc exception", "linking exception", "llvm exception", "font exception", "bison exception")
#: Words passed over between the parts of an expression.
FILLERS = set("the terms of version v license licence under either both a an only later clause exception 0 1 2 3 4 5".split())
RELIEF = 0.3
#: Families of SPDX identifiers that are not in NAMES by the same words, with their ranks.
FAMILIES = {
    "aal": 0.2, "adsl": 0.2, "afl": 0.2, "antlr-pd": 0.0, "artistic": 0.3, "beerware": 0.2, "blueoak": 0.2, "bsd": 0.2, "bsd-4-clause": 0.3, "bsl": 0.2, "busl": 0.9,
    "bzip2": 0.2, "cc-pddc": 0.0, "cc0": 0.0, "cddl": 0.5, "cecill": 0.7, "cecill-b": 0.2, "cecill-c": 0.6, "clartistic": 0.3, "cpal": 0.8, "cpl": 0.5, "curl": 0.2, "ecl": 0.2,
    "ecos": 0.6, "efl": 0.2, "elastic": 0.9, "epl": 0.5, "eudatagrid": 0.2, "eupl": 0.7, "fsfap": 0.1, "ftl": 0.2, "gfdl": 0.7, "hpnd": 0.2, "icu": 0.2, "ijg": 0.2, "intel": 0.2,
    "ipl": 0.5, "isc": 0.2, "jason": 0.3, "json": 0.3, "lppl": 0.4, "libpng": 0.2, "libtiff": 0.2, "miros": 0.2, "mit": 0.2, "mit-0": 0.0, "mpl": 0.5, "ms-pl": 0.4, "ms-rl": 0.6, "mulanpsl": 0.2, "ncsa": 0.2,
    "nasa": 0.5, "nist-pd": 0.0, "nposl": 0.8, "odbl": 0.5, "odc-by": 0.3, "ofl": 0.3, "openldap": 0.2, "openssl": 0.3, "osl": 0.7, "pddl": 0.0, "php": 0.3, "postgresql": 0.2, "psf": 0.2, "python": 0.2,
    "qpl": 0.6, "rpl": 0.8, "rpsl": 0.7, "ruby": 0.3, "sissl": 0.5, "sleepycat": 0.7, "smlnj": 0.2, "spl": 0.5, "sspl": 0.9, "tcl": 0.2, "unicode": 0.2, "unlicense": 0.0, "upl": 0.2, "vim": 0.4, "w3c": 0.2,
    "watcom": 0.6, "wtfpl": 0.0, "x11": 0.2, "xnet": 0.2, "zend": 0.3, "zlib": 0.2, "zpl": 0.2, "0bsd": 0.0,
}
UNKNOWN = 0.5
SPDX = "spdx license identifier"
_LONGEST = max(x.count(" ") + 1 for x in NAMES)
_STRENGTH = {"or": 1, "and": 2, "with": 3}

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_SPDX_TOKEN = re.compile(rb"[()]|[0-9A-Za-z][0-9A-Za-z.+:_-]*")

_TABLE = bytes(c if ALNUM[c] else 32 for c in (x + 32 if 65 <= x <= 90 else x for x in range(256)))
_TABLE_PARENS = bytes(x if x in b"()\n" else _TABLE[x] for x in range(256))


@cache
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for words in {*BASE, *NAMES, *TAGS}:
        found.add_word(f" {words} ", words)
    found.make_automaton()
    return found


def normal(text: bytes) -> tuple[str, int]:
    """The words of a text (UTF-8), one blank before and after each, as one character per byte; and their number."""
    words = text.translate(_TABLE).split()
    return f" {b' '.join(words).decode('latin-1')} ", len(words)


def phrases(line: str) -> list[tuple[int, int, str]]:
    """All occurrences in ``normal`` text: first word, number of words, phrase; by place, the longest first."""
    found = sorted((end - len(p) - 1, -len(p), p) for end, p in _automaton().iter(line))
    out, at, word = [], 0, 0
    for start, _, p in found:
        word += line.count(" ", at, start)
        at = start
        out.append((word, p.count(" ") + 1, p))
    return out


def rank_of(tokens: list[str | float]) -> float | None:
    """Value of an expression of ranks, and / or / with, and parentheses, by the shunting-yard algorithm.

    ``with`` stands between a rank and an exception (any rank; it only lowers the first). What is malformed is read as far as it goes:
    operators without operands are passed over, a missing operator is ``and``, an unclosed parenthesis ends with the text.
    No rank: None.
    """
    values, operators, expect = [], [], True

    def apply() -> None:
        op = operators.pop()
        if len(values) >= 2:
            b, a = values.pop(), values.pop()
            values.append(min(a, b) if op == "or" else max(a, b) if op == "and" else max(0.0, a - RELIEF))

    def push(op: str) -> None:
        while operators and operators[-1] != "(" and _STRENGTH[operators[-1]] >= _STRENGTH[op]:
            apply()
        operators.append(op)

    for token in tokens:
        if isinstance(token, float):
            if not expect:
                push("and")
            values.append(token)
            expect = False
        elif token == "(":
            if not expect:
                push("and")
            operators.append("(")
            expect = True
        elif token == ")":
            while operators and operators[-1] != "(":
                apply()
            if operators:
                operators.pop()
        elif not expect:
            push(token)
            expect = True
    while operators:
        if operators[-1] == "(":
            operators.pop()
        else:
            apply()
    return values[-1] if values else None


def read_expression(text: bytes) -> tuple[list[str | float], list[str], int]:
    """Tokens and labels of the expression in running words that a text begins with; words it takes."""
    words = [w.decode("latin-1") for w in text.translate(_TABLE_PARENS).replace(b"(", b" ( ").replace(b")", b" ) ").split()]
    tokens, labels, at, end = [], [], 0, 0
    while at < len(words):
        word = words[at]
        if word in ("(", ")") or word in _STRENGTH:
            tokens.append(word)
            at += 1
            continue
        name = next((" ".join(words[at: at + n]) for n in range(_LONGEST, 0, -1) if " ".join(words[at: at + n]) in NAMES), None)
        if name:
            label, rank = NAMES[name]
            tokens.append(rank)
            labels.append(label)
            at += name.count(" ") + 1
            end = at
        elif tokens and tokens[-1] == "with" and " ".join(words[at: at + 2]) in EXCEPTIONS:
            tokens.append(0.0)
            at += 2
            end = at
        elif word in FILLERS:
            at += 1
        else:
            break
    return tokens, labels, sum(w not in ("(", ")") for w in words[:end])


def identifier(name: str) -> tuple[str, float] | None:
    """Label and rank of an SPDX identifier in lower case: by the longest run of its first parts that is a name or a family."""
    parts = name.rstrip("+").split("-")
    for n in range(len(parts), 0, -1):
        words = " ".join(parts[:n]).replace(".", " ")
        if words in NAMES:
            return NAMES[words]
        family = "-".join(parts[:n])
        if family in FAMILIES:
            return family, FAMILIES[family]
    return None


def read_spdx(text: bytes, every: bool) -> tuple[list[str | float], list[str], int]:
    """As ``read_expression`` for identifiers: with ``every``, unknown ones are operands too, else they end the expression.

    It ends where an identifier follows another without an operator, or a parenthesis closes that none opened.
    """
    tokens, labels, end, depth, expect = [], [], 0, 0, True
    for found in _SPDX_TOKEN.finditer(text):
        token = found.group().decode("ascii").lower().rstrip(".:_-")
        if token == "(" and expect:
            depth += 1
            tokens.append(token)
        elif token == ")" and depth and not expect:
            depth -= 1
            tokens.append(token)
        elif token in _STRENGTH and not expect:
            tokens.append(token)
            expect = True
        elif token in ("(", ")") or token in _STRENGTH or not expect:
            break
        else:
            if tokens and tokens[-1] == "with":
                tokens.append(0.0)
            else:
                known = identifier(token) or ((token, UNKNOWN) if every else None)
                if known is None:
                    break
                labels.append(known[0])
                tokens.append(known[1])
            expect = False
            end = len(_WORD.findall(text, 0, found.end()))
    return tokens, labels, end


def scan(text: bytes) -> tuple[int, list[tuple[int, int, str, str]], list[tuple[int, list[str], float]], float]:
    """Number of words; finds (first word, words, phrase, label); expressions (first word, labels, rank); score."""
    line, n = normal(text)
    hits = phrases(line)
    if not hits:
        return n, [], [], 0.0
    finds = [(a, k, p, NAMES[p][0]) for a, k, p in hits if p in NAMES and (p in BASE or p not in ONLY_TAGGED)]
    expressions, covered, score = [], set(), 0.0
    tags = [(a, k, p) for a, k, p in hits if p in TAGS]
    if tags:
        # an expression ends with its line
        lines = text.split(b"\n")
        starts, places = [0], {}
        for x in lines:
            starts.append(starts[-1] + len(x.translate(_TABLE).split()))
        for a, k, p in tags:
            at = a + k
            if a in covered or at >= n:
                continue
            row = bisect_right(starts, at) - 1
            if row not in places:
                places[row] = [0, *(m.end() for m in _WORD.finditer(lines[row]))]
            rest = lines[row][places[row][at - starts[row]]:]
            tokens, labels, used = read_spdx(rest, True) if p == SPDX else max(read_expression(rest), read_spdx(rest, False), key=lambda x: x[2])
            rank = rank_of(tokens)
            if rank is not None and labels:
                covered.update(range(at, at + used))
                expressions.append((at, labels, rank))
                score = max(score, rank)
    for a, _, p, _ in finds:
        if a not in covered:
            score = max(score, NAMES[p][1])
    return n, finds, expressions, score


FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("finds", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("words", T.LongType()),
                                                     T.StructField("phrase", T.StringType()), T.StructField("label", T.StringType())]))),
    T.StructField("expressions", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("labels", T.ArrayType(T.StringType())),
                                                           T.StructField("rank", T.DoubleType())]))),
    T.StructField("score", T.DoubleType()),
])


def scan_licenses(docs: DataFrame, *, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with one more column, and its name: a struct of the words, finds, expressions and score of each text.

    Null and empty texts have no words and score 0. Rows are independent of each other.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    out = new_name("licenses", docs.columns)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, FOUND)])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = to_arrow_schema(schema).field(out).type
        for batch in batches:
            for part in slices(batch, text):
                raw, at = texts_of(part.column(part.schema.get_field_index(text)))
                data, rows = raw.tobytes(), []
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    n, finds, expressions, score = scan(data[a:b])
                    rows.append({"n_words": n, "score": score, "finds": [dict(zip(("first", "words", "phrase", "label"), x, strict=True)) for x in finds],
                                 "expressions": [dict(zip(("first", "labels", "rank"), x, strict=True)) for x in expressions]})
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, kind)], names=schema.names)

    return docs.mapInArrow(each, schema), out


def license_digest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    first_word and last_word are the smallest and largest start of a base phrase (null without one).
    """
    found, out = scan_licenses(docs.select("doc_id", "text"))
    listed = ", ".join(f"'{p}'" for p in BASE)
    rows = found.select("doc_id", F.col(f"{out}.n_words").alias("n_words"), F.col(f"{out}.finds").alias("finds"), F.col(f"{out}.expressions").alias("expressions"),
                        F.col(f"{out}.score").alias("score")).withColumn("base", F.expr(f"filter(finds, x -> x.phrase in ({listed}))"))
    return rows.select(
        "doc_id", "n_words", F.expr("cast(size(base) as long)").alias("n_base"), F.expr("array_min(base.first)").alias("first_word"),
        F.expr("array_max(base.first)").alias("last_word"), F.expr("array_join(array_sort(array_distinct(base.label)), ',')").alias("base_labels"),
        F.expr("array_join(array_sort(array_distinct(concat(finds.label, flatten(expressions.labels)))), ',')").alias("labels"), "score")
