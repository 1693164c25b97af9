"""Language identification in two steps: the family first, then one-versus-one linear SVMs within the family.

Features are hashed byte n-grams of the letters of a text (2 to 4 bytes, ASCII lower-cased, all else one space), as
square roots of their counts, scaled to length 1. The models are fitted on a bounded sample of labelled rows, about
``PER_LANGUAGE`` of each language, chosen by a hash of the id; what reaches the driver is that sample's features. All
texts are then scored where they lie, and told to be like a learned language or not: by the mean logarithm of how much more
often their n-grams are in the language than by chance, against what the learned rows reach themselves. That does not change
the prediction.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyproof.llm.common import id_text, new_name, slices, texts_of

PER_LANGUAGE = 500
DIMENSIONS = 1 << 13
GRAMS = (2, 3, 4)
UNKNOWN = "und"
#: A text is like a language from this share of the median of its learned rows on, or from the likeness all but LOWEST of them reach.
LIKE = 0.4
LOWEST = 0.005
#: Shorter texts (bytes of letters) and languages of fewer learned rows are not judged.
LEAST_LETTERS = 35
LEAST_ROWS = 20

#: Branches of languages by ISO 639-1 code. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "indo-aryan": "bn gu hi mr ne pa si ur",
    "iranian": "fa ku ps tg",
    "dravidian": "kn ml ta te",
    "uralic": "et fi hu",
    "turkic": "az kk ky tk tr uz",
    "semitic": "am ar he mt",
    "austronesian": "id jv ms tl",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_LETTERS = np.full(256, 32, dtype=np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def family_of(lang: str) -> str:
    code = lang.lower().replace("_", "-").split("-")[0]
    return _FAMILY.get(code, code)


def gram_rows(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Feature rows (texts x DIMENSIONS, float32) of runs of texts, with the first text of each run."""
    raw, at = texts_of(column)
    data = _LETTERS[raw]
    keep = np.ones(len(data), dtype=bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32)
    keep[at[:-1][at[:-1] < len(data)]] = True
    at = np.concatenate([[0], np.cumsum(keep)])[at]
    data = data[keep].astype(np.uint32)
    first = 0
    while first < len(at) - 1:
        last = min(first + 256, len(at) - 1)
        part = data[at[first]: at[last]]
        text = np.repeat(np.arange(last - first), np.diff(at[first: last + 1]))
        total = np.zeros((last - first) * DIMENSIONS, dtype=np.int64)
        h = part.copy()
        for n in range(2, max(GRAMS) + 1):
            h = h[:-1] * np.uint32(0x01000193) + part[n - 1:]
            if n in GRAMS and len(h):
                cell = (((h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1)) >> np.uint32(32 - 13)).astype(np.int64)
                inside = text[: len(h)] == text[n - 1:]
                total += np.bincount((text[: len(h)] * DIMENSIONS + cell)[inside], minlength=len(total))
        rows = np.sqrt(total.reshape(-1, DIMENSIONS), dtype=np.float32)
        norm = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
        yield first, rows / np.maximum(norm, 1e-9)
        first = last


def has_letter(column: pa.Array) -> np.ndarray:
    """Which texts hold a letter of any script."""
    import regex

    raw, at = texts_of(column)
    letter = np.concatenate([[0], np.cumsum((_LETTERS[raw] != 32) & (raw < 128))])
    out = letter[at[1:]] > letter[at[:-1]]
    for i in np.flatnonzero(~out & (at[1:] > at[:-1])).tolist():
        out[i] = regex.search(r"\p{L}", column[i].as_py()) is not None
    return out


def letters(column: pa.Array) -> np.ndarray:
    """Bytes of letters of each text."""
    raw, at = texts_of(column)
    return np.diff(np.concatenate([[0], np.cumsum(_LETTERS[raw] != 32)])[at])


def gram_model(x: np.ndarray) -> np.ndarray:
    """Logarithm of how much more often than by chance each n-gram is in the rows; a tenth is left to n-grams not seen."""
    return np.log(0.9 * DIMENSIONS * (x * x).mean(axis=0) + 0.1).astype(np.float32)


def least_likeness(x: np.ndarray) -> float:
    """The likeness from which on a text counts as like the rows, each half of which is judged by the other."""
    if len(x) < LEAST_ROWS:
        return -np.inf
    own = np.concatenate([(x[k::2] * x[k::2]) @ gram_model(x[1 - k::2]) for k in (0, 1)])
    return float(min(LIKE * np.median(own), np.quantile(own, LOWEST)))


def linear_svm(x: np.ndarray, at: np.ndarray, y: np.ndarray, *, c: float = 10.0, epochs: int = 30, seed: int = 7) -> np.ndarray:
    """Weights (last: bias) of an L1-loss linear SVM by dual coordinate descent; y is +1 or -1, both present.

    Learned from are the rows ``at`` of ``x``, whose last column is 1; no copy of them is made, as this runs in the driver. The penalty of a class is scaled by its share, so that a rare language isn't ignored.
    """
    square = np.concatenate([(part * part).sum(axis=1) for part in (x[at[k: k + 256]] for k in range(0, len(at), 256))])
    limit = np.where(y > 0, c * len(y) / (2 * (y > 0).sum()), c * len(y) / (2 * (y < 0).sum()))
    alpha, w, rng = np.zeros(len(y)), np.zeros(x.shape[1], dtype=np.float32), np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)).tolist():
            slope = y[i] * float(w @ x[at[i]]) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), limit[i])
            if new != alpha[i]:
                w += np.float32((new - alpha[i]) * y[i]) * x[at[i]]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


@dataclass
class Model:
    """Weights in columns: one-versus-rest for families (none if there is one), then pairs of languages within each."""

    families: list[str] = field(default_factory=list)
    languages: dict[str, list[str]] = field(default_factory=dict)
    pairs: list[tuple[str, str]] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((DIMENSIONS + 1, 0), dtype=np.float32))
    #: For each language: its n-grams, and the likeness that its texts reach (-inf: not judged).
    grams: dict[str, np.ndarray] = field(default_factory=dict)
    least: dict[str, float] = field(default_factory=dict)

    def like(self, rows: np.ndarray, lang: list[str]) -> np.ndarray:
        """Which rows are like any language that is judged, or were given one that is not."""
        judged = [name for name in self.grams if self.least[name] > -np.inf]
        if not judged:
            return np.ones(len(rows), dtype=bool)
        value = (rows * rows) @ np.stack([self.grams[name] for name in judged], axis=1)
        return (value >= np.array([self.least[name] for name in judged])).any(axis=1) | ~np.isin(np.array(lang, dtype=str), judged)

    def predict(self, rows: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score of each feature row. Ties of votes go to the larger sum of margins, then to the first name."""
        if not self.families:
            return [UNKNOWN] * len(rows), np.zeros(len(rows))
        margin = (rows @ self.weights[:-1] + self.weights[-1]).astype(np.float64)
        count = len(self.families) if len(self.families) > 1 else 0
        lang, score = np.full(len(rows), "", dtype=object), np.ones(len(rows))
        which = np.zeros(len(rows), dtype=np.int64)
        if count:
            chance = np.exp(2 * (margin[:, :count] - margin[:, :count].max(axis=1, keepdims=True)))
            which = chance.argmax(axis=1)
            score = chance.max(axis=1) / chance.sum(axis=1)
        for k, family in enumerate(self.families):
            at = np.flatnonzero(which == k)
            names = self.languages[family]
            votes, total, least = (np.zeros((len(at), len(names))) for _ in range(3))
            least[:] = 1
            for j, (a, b) in enumerate(self.pairs):
                if a in names and b in names:
                    m = margin[at, count + j]
                    chance = 1 / (1 + np.exp(-2 * np.clip(m, -20, 20)))
                    for name, sign, p in ((names.index(a), 1, chance), (names.index(b), -1, 1 - chance)):
                        votes[:, name] += sign * m > 0
                        total[:, name] += sign * m
                        least[:, name] = np.minimum(least[:, name], p)
            best = np.lexsort((-np.arange(len(names))[None, :].repeat(len(at), 0), total, votes), axis=1)[:, -1] if len(at) else at
            lang[at] = np.array(names, dtype=object)[best]
            score[at] *= least[np.arange(len(at)), best]
        return lang.tolist(), score


def fit(labelled: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = PER_LANGUAGE) -> Model:
    """Fit on about ``per_language`` rows of each language (twice that at most, taken over all), chosen by a hash of ``key``.

    Rows without text, language or key are not used. No rows: a model that knows no language.
    """
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.xxhash64(F.col(key).cast("string")).alias("h"), F.col(key).alias("k"))
    rows = rows.where("text is not null and lang is not null and k is not null").drop("k")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model()
    share = F.create_map(*[F.lit(x) for name, n in sorted(counts.items()) for x in (name, min(1.0, 1.1 * per_language / n))])
    sample = rows.where(F.expr("pmod(h, 1000000) / 1000000.0D") < share[F.col("lang")]).orderBy("h").limit(2 * per_language * len(counts))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                size = letters(part.column(0))
                for first, x in gram_rows(part.column(0)):
                    out = [(np.flatnonzero(r).astype(np.uint16), r[r > 0]) for r in x]
                    yield pa.RecordBatch.from_arrays([part.column(1).slice(first, len(x)), part.column(2).slice(first, len(x)), pa.array(size[first: first + len(x)]),
                                                      pa.array([i.tobytes() for i, _ in out]), pa.array([v.tobytes() for _, v in out])], names=["lang", "h", "n", "i", "v"])

    found = sorted(sample.mapInArrow(features, "lang string, h long, n long, i binary, v binary").collect(), key=lambda r: (r["lang"], r["h"], bytes(r["i"])))
    if not len(found):
        return Model()
    with_one = np.zeros((len(found), DIMENSIONS + 1), dtype=np.float32)
    with_one[:, -1] = 1
    x = with_one[:, :-1]
    for r, row in zip(x, found, strict=True):
        r[np.frombuffer(row["i"], dtype=np.uint16)] = np.frombuffer(row["v"], dtype=np.float32)
    y = np.array([r["lang"] for r in found])
    long = np.array([r["n"] for r in found]) >= LEAST_LETTERS
    del found
    languages: dict[str, list[str]] = defaultdict(list)
    for name in sorted(set(y.tolist())):
        languages[family_of(name)].append(name)
    families = sorted(languages)
    own = np.array([family_of(name) for name in y.tolist()])
    columns = [linear_svm(with_one, np.arange(len(y)), np.where(own == f, 1, -1)) for f in families] if len(families) > 1 else []
    pairs = [p for f in families for p in combinations(languages[f], 2)]
    for a, b in pairs:
        at = np.flatnonzero((y == a) | (y == b))
        columns.append(linear_svm(with_one, at, np.where(y[at] == a, 1, -1)))
    weights = np.stack(columns, axis=1) if columns else np.zeros((DIMENSIONS + 1, 0), dtype=np.float32)
    names = sorted(set(y.tolist()))
    return Model(families, dict(languages), pairs, weights, {n: gram_model(x[y == n]) for n in names}, {n: least_likeness(x[(y == n) & long]) for n in names})


def identify(docs: DataFrame, model: Model, *, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with one more column, and its name: a struct of lang, score (0 to 1) and like (is it like any learned language).

    A text that is null or has no letter is ``und`` with score 0 and like nothing, as is every text if the model knows no
    language. Only the text is read. The score is the family's share times the least sure of its language's duels. Texts of less
    than ``LEAST_LETTERS`` bytes of letters cannot be told to be unlike and count as like.
    """
    out = new_name("language", docs.columns)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("like", T.BooleanType())]))])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                column = part.column(part.schema.get_field_index(text))
                names, scores, like = [], [], []
                for _, x in gram_rows(column):
                    lang, score = sent.value.predict(x)
                    names += lang
                    scores.append(score)
                    like.append(sent.value.like(x, lang))
                known = has_letter(column) & bool(sent.value.families)
                alike = known & (np.concatenate(like) | (letters(column) < LEAST_LETTERS))
                names = [n if k else UNKNOWN for n, k in zip(names, known.tolist(), strict=True)]
                value = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.where(known, np.concatenate(scores), 0.0)), pa.array(alike)], names=["lang", "score", "like"])
                yield pa.RecordBatch.from_arrays([*part.columns, value], names=schema.names)

    return docs.mapInArrow(predict, schema), out


def predictions(docs: DataFrame, *, per_language: int = PER_LANGUAGE) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, like. Rows with crc32(doc_id) mod 5 = 0 are never learned from."""
    held = f"coalesce({id_text()} % 5 = 0, false)"
    model = fit(docs.where(f"{id_text()} % 5 != 0").select("doc_id", "text", "lang"), per_language=per_language)
    found, out = identify(docs.select("doc_id", F.expr(held).alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", F.col(f"{out}.lang").alias("lang_pred"), F.col(f"{out}.score").alias("score"), F.col(f"{out}.like").alias("like"))
