"""Quality rules with risk-controlled thresholds. Built of DataFrame functions only.

A rule is a whole number per text, the larger the worse: shares of symbols, of repeated lines, words and passages, of capitals and so on in
thousandths. For a level l, each rule's cutoff in a stratum is the smallest value that at most l thousandths of the good tuning documents of
the stratum exceed, if at least ``USEFUL`` of 1000 bad tuning documents exceed it too; a rule that tells less takes no part. A document is
rejected if any rule exceeds its cutoff. Good documents of a holdout, which
set no cutoff, then tell how many a level rejects wrongly: k of n. A level passes if so few would have been seen with probability of at
most ``delta`` / strata, were the true share of false rejections ``alpha`` or more: P(Bin(n, alpha) <= k) <= delta / strata, an exact
binomial bound. Many tests are corrected for in both directions: over strata by the divisor (Bonferroni), over levels by their fixed order, from
the mildest on, where the first that does not pass ends the row. So with probability 1 - delta no stratum's chosen level, the strictest
admitted one, rejects more than ``alpha`` of its good documents. A stratum without an admitted level rejects nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyproof.llm.common import stored

SPACES = " \t\n\x0b\x0c\r"
SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30  # of 100 words

ALPHA = 0.02
DELTA = 0.05
#: Thousandths of the bad tuning documents that a rule must find to take part.
USEFUL = 50
#: Thousandths of the good tuning documents that may exceed a cutoff.
LEVELS = (0, 1, 2, 3, 5, 7, 10, 15, 20)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Rules over the counts of ``measured``: whole numbers from 0 to 1000.
RULES = {
    "symbols": "1000 * n_symbols div greatest(word_chars, 1)",
    "repeated_lines": "1000 * n_dup_lines div greatest(n_lines, 1)",
    "repeated_passages": "1000 * n_repeat_words div greatest(n_words, 1)",
    "same_words": "1000 * (n_words - n_distinct) div greatest(n_words, 1)",
    "capitals": "1000 * n_capitals div greatest(n_letters, 1)",
    "other_characters": "1000 * (word_chars - n_letters) div greatest(word_chars, 1)",
    "long_words": "least(1000, 10 * word_chars div greatest(n_words, 1))",
    "short_words": "1000 - least(1000, 10 * word_chars div greatest(n_words, 1))",
    "few_words": "1000 - least(1000, n_words)",
}


def let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once: inside a function of an array it would be worked out for each element."""
    return F.transform(F.array(value), use)[0]


def alike(rows: Column) -> Column:
    """Of sorted (k, i) structs those whose k occurs twice or more."""
    return let(rows, lambda s: F.filter(s, lambda x, at: (x["k"] == F.get(s, at - 1)["k"]) | (x["k"] == F.get(s, at + 1)["k"])))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside any run of ``window`` words that the array holds twice or more. Runs are found by hash and confirmed by their words."""
    def text_of(w: Column, at: Column) -> Column:
        return F.array_join(F.slice(w, at + 1, window), " ")

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last"))
        return F.aggregate(places, start, lambda a, x: F.struct((a["n"] + F.least(F.lit(window), x - a["last"])).alias("n"), x.alias("last")))["n"]

    def confirm(w: Column, hashes: Column) -> Column:
        by_hash = alike(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("k"), i.alias("i")))))
        by_text = alike(F.sort_array(F.transform(by_hash, lambda x: F.struct(text_of(w, x["i"]).alias("k"), x["i"].alias("i")))))
        return covered(F.sort_array(F.transform(by_text, lambda x: x["i"])))

    def of(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - window + 1), lambda i: F.xxhash64(F.slice(w, i, window)))
        return F.when(F.size(w) <= window, F.lit(0)).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(confirm(w, h))))

    return let(words, of)


def measured(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` with one struct column ``counts``: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_distinct, n_letters, n_capitals.

    Words are [^\\x20\\x09-\\x0D]+ as they stand; characters are code points. n_lines: lines with a word; n_distinct: different words.
    A null text has no words: all 0.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(body, SPACE), "")
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def kept(pattern: str) -> Column:
        return F.length(F.regexp_replace(body, pattern, "")).cast("long")

    def about(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                        F.size(F.array_distinct(w)).cast("long").alias("n_distinct"), repeated_words(w).cast("long").alias("n_repeat_words"))

    name = "counts"
    word = let(words, about)
    line = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    both = F.struct(word.alias("w"), line.alias("l"), kept(r"[^#*$%&|<>]+").alias("n_symbols"), kept(r"[^\p{L}]+").alias("n_letters"), kept(r"[^\p{Lu}]+").alias("n_capitals"))
    return docs.withColumn(name, let(both, lambda x: F.struct(
        x["w"]["n_words"].alias("n_words"), x["w"]["word_chars"].alias("word_chars"), x["n_symbols"].alias("n_symbols"), x["l"]["n_dup_lines"].alias("n_dup_lines"),
        x["w"]["n_repeat_words"].alias("n_repeat_words"), x["l"]["n_lines"].alias("n_lines"), x["w"]["n_distinct"].alias("n_distinct"),
        x["n_letters"].alias("n_letters"), x["n_capitals"].alias("n_capitals"))))


def log_factorial_rest(x: Column) -> Column:
    """ln(x!) less x ln x - x + ln(2 pi x) / 2, for x >= 1: from the factorial up to 20, by Stirling's series above."""
    y = x.cast("double")
    exact = F.log(F.factorial(F.least(x, F.lit(20)).cast("int")).cast("double")) - (y * F.log(y) - y + 0.5 * F.log(2 * F.pi() * y))
    return F.when(x <= 20, exact).otherwise(1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5))))


def binomial_point(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) = k) for 0 <= k < n, without the cancellation of large logarithms (saddle-point form)."""
    def apart(x: Column, mean: Column) -> Column:
        return x * F.log(x / mean) + mean - x

    x, m = k.cast("double"), n.cast("double")
    inner = F.exp(log_factorial_rest(n) - log_factorial_rest(k) - log_factorial_rest(n - k) - apart(x, m * p) - apart(m - x, m * (1 - p))) * F.sqrt(m / (2 * F.pi() * x * (m - x)))
    return F.when(k == 0, F.exp(m * F.log1p(F.lit(-p)))).otherwise(inner)


def binomial_below(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k); 1 where k >= n p, as such counts speak for nothing.

    The sum goes down from k, where each term is less than the one before; terms 40 standard deviations below the first are less than
    1e-300 of it and are left out, so the work grows with the root of n.
    """
    steps = F.least(k, F.ceil(40 * F.sqrt(n * p) + 200)).cast("long")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def add(a: Column, i: Column) -> Column:
        j = k - i + 1
        term = a["term"] * j * (1 - p) / ((n - j + 1) * p)
        return F.struct(term.alias("term"), (a["total"] + term).alias("total"))

    total = F.when(k == 0, F.lit(1.0)).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(steps, F.lit(1))), start, add)["total"])
    return F.when((n == 0) | (k >= n * p), F.lit(1.0)).otherwise(F.least(F.lit(1.0), binomial_point(n, k, p) * total))


def tuning(doc_id: str = "doc_id") -> Column:
    """Half of the labelled documents set cutoffs, by the first digit of the md5 of their id; the other half test them."""
    return F.substring(F.md5(F.col(doc_id).cast("string").cast("binary")), 1, 1) < "8"


def thresholds(labelled: DataFrame, *, alpha: float = ALPHA, delta: float = DELTA, levels: tuple[int, ...] = LEVELS, useful: int = USEFUL) -> DataFrame:
    """One row per stratum and level: stratum, level, cutoffs (array, in the order of the rules), n_holdout, n_false, bound, admitted.

    labelled: documents as (stratum string, tuning boolean, good boolean, rules array<int> of values from 0 to 1000). A rule that takes no part has the
    cutoff 1000, which nothing exceeds. Strata without good tuning documents have no rows. bound is P(Bin(n_holdout, alpha) <= n_false).
    Values are counted, never gathered: 1001 counts of good and bad ones for each stratum and rule at most.
    """
    labelled = stored(labelled.select("stratum", "tuning", "good", "rules"), "labelled")
    counts = (labelled.where("tuning").select("stratum", "good", F.posexplode("rules").alias("rule", "value"))
              .groupBy("stratum", "rule", "value").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")))
    upto = "over (partition by stratum, rule order by value)"
    below = counts.select("stratum", "rule", "value", F.expr(f"sum(good) {upto} good"), F.expr(f"sum(bad) {upto} bad"),
                          F.expr("sum(good) over (partition by stratum, rule) n_good"), F.expr("sum(bad) over (partition by stratum, rule) n_bad"))
    found = (below.where("n_good > 0").select("*", F.explode(F.array(*[F.lit(x) for x in levels])).alias("level")).where("good >= n_good - n_good * level div 1000")
             .groupBy("stratum", "level", "rule").agg(F.expr("min(struct(value, n_bad - bad as found, n_bad))").alias("cut"))
             .select("stratum", "level", "rule", F.expr(f"if(cut.found > 0 and 1000 * cut.found >= {useful} * cut.n_bad, cut.value, 1000)").alias("cutoff")))
    cutoffs = stored(found.groupBy("stratum", "level").agg(F.expr("transform(sort_array(collect_list(struct(rule, cutoff))), x -> x.cutoff)").alias("cutoffs")), "cutoffs")
    per_stratum = cutoffs.groupBy("stratum").agg(F.collect_list(F.struct("level", "cutoffs")).alias("all"))
    tried = labelled.where("good and not tuning").join(per_stratum, "stratum").select("stratum", "rules", F.explode("all").alias("a"))
    false = tried.groupBy("stratum", F.col("a.level").alias("level")).agg(F.count("*").alias("n_holdout"), F.count_if(exceeded(F.col("rules"), F.col("a.cutoffs"))).alias("n_false"))
    out = cutoffs.join(false, ["stratum", "level"], "left").select("stratum", "level", "cutoffs", F.coalesce("n_holdout", F.lit(0)).cast("long").alias("n_holdout"), F.coalesce("n_false", F.lit(0)).cast("long").alias("n_false"))
    strata = cutoffs.agg(F.count_distinct("stratum").alias("strata"))
    # the bound's rounding errors are far below a part in 10**9
    passes = F.expr(f"bool_and(bound * {1 + 1e-9}D <= {delta}D / strata) over (partition by stratum order by level)")
    return out.withColumn("bound", binomial_below(F.col("n_holdout"), F.col("n_false"), alpha)).crossJoin(strata).withColumn("admitted", passes).drop("strata")


def exceeded(rules: Column, cutoffs: Column) -> Column:
    return F.exists(F.arrays_zip(rules.alias("v"), cutoffs.alias("c")), lambda x: x["v"] > x["c"])


def judged(docs: DataFrame, labels: DataFrame, *, strata: tuple[str, ...] = ("lang",), alpha: float = ALPHA, delta: float = DELTA, levels: tuple[int, ...] = LEVELS, useful: int = USEFUL) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, kept, and the names of the rules that reject it, comma-joined.

    docs: doc_id, text and the columns of ``strata``; labels: doc_id, quality (a document is good if all its labels are 1; null labels are
    none). base_failed: fewer than 20 words, or over 30 of 100 in repeated 8-word windows. Cutoffs are set and tested on good documents that do
    not fail it. A null stratum value is a stratum. Rows that share an id are judged each by its text. Empty labels: nothing is rejected
    beyond base_failed. Text is read once.
    """
    stratum = F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), F.col(f"`{x}`").cast("string")), F.lit("")) for x in strata])
    base = measured(docs.select("doc_id", stratum.alias("stratum"), "text")).select("doc_id", "stratum", "counts.*")
    failed = F.expr(f"n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words")
    rules = F.array(*[F.expr(f"cast({x} as int)") for x in RULES.values()])
    rows = stored(base.select("doc_id", "stratum", *COUNTS, failed.alias("base_failed"), rules.alias("rules")), "measured")
    known = labels.where("quality is not null").groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))
    labelled = rows.where("not base_failed").join(known, "doc_id").select("stratum", tuning().alias("tuning"), "good", "rules")
    found = thresholds(labelled, alpha=alpha, delta=delta, levels=levels, useful=useful).where("admitted")
    chosen = stored(found.groupBy("stratum").agg(F.max_by("cutoffs", "level").alias("cutoffs")), "chosen")
    names = F.array(*[F.lit(x) for x in RULES])
    over = F.filter(F.arrays_zip(F.col("rules").alias("v"), F.col("cutoffs").alias("c"), names.alias("name")), lambda x: x["v"] > x["c"])
    return (rows.join(chosen, "stratum", "left")
            .select("doc_id", *COUNTS, "base_failed", F.when(F.col("cutoffs").isNull(), F.lit("")).otherwise(F.array_join(F.transform(over, lambda x: x["name"]), ",")).alias("rejected_by"))
            .withColumn("kept", F.expr("not base_failed and rejected_by = ''")))
