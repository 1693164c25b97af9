"""Any number of estimates from one scan.

A domain is one statistic of a variable over one universe, perhaps by a grouping column. Universes are taken apart into
comparisons, and a data row gets one bit for each distinct comparison. Rows are summed up by variable, grouping column, bits and
PSU; a domain is then a set of alternatives over the bits, kept as rows and joined to the bits that occur. So a data row is
copied once for each variable and grouping column in use, never once for each domain.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import Catalog, Design
from ..functions.predicates import codes_sql, finite_sql, integer_sql, universe_terms
from ..session import written
from .estimates import Z95, stratified_ratio
from .quantiles import interpolate, running_weight, woodruff
from .tables import group_sql

WORD = 62  # comparisons in one whole number


@dataclass(frozen=True)
class Domain:
    """``kind`` is prevalence, mean or quantile; ``q`` is set for quantiles only. ``groupby`` names a grouping column."""

    variable: str
    universe: str | None
    kind: str
    q: float | None = None
    groupby: str | None = None

    @property
    def key(self) -> str:
        """A short name for reading; domains are told apart by their fields."""
        q = "" if self.q is None else f"{self.q:.6f}"
        by = "" if self.groupby is None else f"|{self.groupby}"
        return f"{self.kind}|{self.variable}|{self.universe or ''}|{q}{by}"


def join_estimates(
    rows: DataFrame, estimates: DataFrame, *, kind: str, variable: str, universe: str, q: str, groupby: str | None = None, how: str = "left"
) -> DataFrame:
    """``rows`` with the estimates of the domain that their columns name; missing values are equal to each other."""
    names = {"kind": kind, "variable": variable, "universe": universe, "q": q}
    if groupby is not None:
        names["groupby"] = groupby
    found = estimates.select(*[F.col(c).alias(f"estimate_{c}") if c in names else F.col(c) for c in estimates.columns])
    same = [F.col(f"estimate_{c}").eqNullSafe(F.col(own)) for c, own in names.items()]
    return rows.join(found, reduce(and_, same), how).drop(*[f"estimate_{c}" for c in names])


@dataclass(frozen=True)
class _Item:
    """What a data row is counted under: a variable as a share, as a value, or its reserved codes; by a grouping column or not."""

    variable: str
    role: str
    groupby: str | None


def _item(domain: Domain) -> _Item:
    return _Item(domain.variable, "share" if domain.kind == "prevalence" else "value", domain.groupby)


def _member(df: DataFrame, item: _Item, by_value: bool, catalog: Catalog, design: Design) -> dict[str, str]:
    """What a row contributes to an item, as SQL texts by name; ``inside`` tells whether it belongs.

    Values outside the code list belong to means and quantiles too, marked as not valid: the same pass then tells what the
    estimate would be if they were kept.
    """
    meta, name = catalog[item.variable], item.variable
    valid = f"coalesce({codes_sql(df, name, meta.valid)}, false)"
    value, whole = finite_sql(df, name), integer_sql(df, name)
    weight, run, group = finite_sql(df, meta.design(design).weight), value if by_value else "NULL", "0L"
    if item.role == "share":
        inside, y, valid = valid, f"CASE WHEN {codes_sql(df, name, meta.affirmative)} THEN 1D ELSE 0D END", "true"
    elif item.role == "value":
        inside, y = whole, value
    else:
        inside, y, valid, weight = f"{whole} AND NOT {valid}", value, "false", "NULL"
    if item.groupby is not None:
        inside = f"({inside}) AND ({group_sql(df, item.groupby, catalog)})"
        group = f"CAST(`{item.groupby}` AS BIGINT)"
    return {"inside": f"coalesce({inside}, false)", "grp": group, "y": y, "valid": valid, "run": f"CAST({run} AS DOUBLE)", "w": f"CAST({weight} AS DOUBLE)"}


def _chosen(texts: Sequence[str]) -> str:
    """The text of a row's item, as SQL; items are numbered as the texts are, and equal texts share a branch."""
    places: dict[str, list[int]] = {}
    for i, text in enumerate(texts):
        places.setdefault(text, []).append(i)
    if len(places) == 1:
        return texts[0]
    cases = " ".join(f"WHEN __item IN ({', '.join(map(str, which))}) THEN {text}" for text, which in places.items())
    return f"CASE {cases} END"


def _words(bits: set[int]) -> dict[int, int]:
    """Bits by number as words of ``WORD`` bits."""
    words: dict[int, int] = {}
    for bit in bits:
        words[bit // WORD] = words.get(bit // WORD, 0) | 1 << bit % WORD
    return words


def _estimates(df: DataFrame, domains: Sequence[Domain], catalog: Catalog, design: Design, z: float) -> DataFrame:
    spark = df.sparkSession
    universes = {u: universe_terms(df, u) for u in {d.universe for d in domains}}
    bit = {text: i for i, text in enumerate(sorted({c for terms in universes.values() for term in terms for c in term}))}
    continuous = sorted({d.variable for d in domains if d.kind != "prevalence"})
    items = sorted({_item(d) for d in domains}, key=lambda i: (i.variable, i.role, i.groupby or ""))
    items += [_Item(v, "codes", None) for v in continuous]
    place = {item: i for i, item in enumerate(items)}
    by_value = {_item(d) for d in domains if d.kind == "quantile"} | {i for i in items if i.role == "codes"}
    # An item is keyed only by the comparisons that its own domains make.
    used: dict[_Item, set[int]] = {item: set() for item in items}
    for d in domains:
        used[_item(d)].update(bit[c] for term in universes[d.universe] for c in term)
    used_words = {item: sorted(_words(bits).items()) for item, bits in used.items()}

    flags = [f"CASE WHEN {text} THEN {1 << i % WORD}L ELSE 0L END" for text, i in bit.items()]
    words = [" + ".join(flags[i:i + WORD]) for i in range(0, len(flags), WORD)]
    members = [_member(df, item, item in by_value, catalog, design) for item in items]
    # Words of an item's mask as columns of their own, as many as the item with the most has: plain numbers group faster than arrays.
    masks = [f"mask_{i}" for i in range(max(map(len, used_words.values())))]
    for item, member in zip(items, members, strict=True):
        own = [f"word_{word} & {part}L" for word, part in used_words[item]]
        member.update(zip(masks, own + ["0L"] * (len(masks) - len(own)), strict=True))
    flagged = df.selectExpr("*", *[f"{word} AS word_{i}" for i, word in enumerate(words)])
    copies = flagged.selectExpr("*", f"explode(array({', '.join(map(str, range(len(items))))})) AS __item")
    counted = copies.where(_chosen([m["inside"] for m in members])).selectExpr(
        f"`{design.stratum}` AS h", f"`{design.psu}` AS a", "__item AS item", *[f"{_chosen([m[c] for m in members])} AS {c}" for c in ("grp", *masks, "y", "valid", "run", "w")])
    # One row per item, group, outcome of the comparisons, PSU, valid or not, and (for quantiles) value: every estimate below comes from it.
    cells = written(
        counted.groupBy("item", "grp", *masks, "h", "a", "run", "valid").agg(*map(F.expr, [
            "sum(w * y) AS kept_wy",
            "sum(w) AS kept_w",
            "sum(y) AS y",  # the unweighted variants need no weight
            "count(*) AS rows",
            "count(w) AS with_weight",
            "min(CASE WHEN w > 0 THEN w END) AS low",
            "max(CASE WHEN w > 0 THEN w END) AS high",
        ])).selectExpr(
            "item", "grp", *masks, "h", "a", "run", "valid", "kept_wy", "kept_w", "low", "high",
            "IF(valid, coalesce(kept_wy, 0D), 0D) AS s_wy",
            "IF(valid, coalesce(kept_w, 0D), 0D) AS s_w",
            "IF(valid, coalesce(y, 0D), 0D) AS s_y",
            "IF(valid, CAST(rows AS DOUBLE), 0D) AS n_all",
            "IF(valid, with_weight, 0L) AS n",
            "IF(valid, rows - with_weight, 0L) AS n_dropped_weight",
        ),
        "domain_cells",
    )

    def needed(item: _Item, term: frozenset[str]) -> list[int]:
        have = _words({bit[c] for c in term})
        parts = [have.get(word, 0) for word, _ in used_words[item]]
        return parts + [0] * (len(masks) - len(parts))

    terms = spark.createDataFrame(
        [(i, place[_item(d)], d.kind, d.q, *needed(_item(d), term)) for i, d in enumerate(domains) for term in universes[d.universe]],
        ", ".join(["domain int, item int, kind string, q double", *[f"need_{m} bigint" for m in masks]]),
    )
    labels = spark.createDataFrame(
        [(i, d.key, d.variable, d.universe, d.kind, d.q, d.groupby) for i, d in enumerate(domains)],
        "domain int, domain_key string, variable string, universe string, kind string, q double, groupby string",
    )
    # Outcomes meet domains before cells do: both tables are small, and a cell then joins by equal keys only.
    holds = (
        cells.select("item", *masks).distinct().join(terms, "item")
        .where(" AND ".join(["true", *[f"{m} & need_{m} = need_{m}" for m in masks]]))
        .select("domain", "kind", "q", "item", *masks).distinct()
    )
    inside = cells.join(holds, ["item", *masks])
    sums = [f"sum({c}) AS {c}" for c in ("s_wy", "s_w", "s_y", "n_all", "n", "n_dropped_weight", "kept_wy", "kept_w")]
    half = f"{z!r}D * sqrt(variance)"
    parts = []
    if any(d.kind != "quantile" for d in domains):
        per_psu = inside.where("kind != 'quantile'").groupBy("domain", "grp", "h", "a").agg(*map(F.expr, sums))
        ratios = stratified_ratio(per_psu, ["domain", "grp"], carry=["s_y", "n_all", "kept_wy", "kept_w"])
        parts.append(ratios.selectExpr(
            "domain", "grp", "ratio AS estimate", "sqrt(variance) AS se", f"ratio - {half} AS lci", f"ratio + {half} AS uci",
            "CASE WHEN ratio * (1 - ratio) > 0 THEN variance * n / (ratio * (1 - ratio)) END AS deff",
            "try_divide(s_y, n_all) AS unweighted", "try_divide(kept_wy, kept_w) AS reserved_kept",
            "n", "denominator_weighted", "n_psu", "n_strata",
        ))
    if any(d.kind == "quantile" for d in domains):
        codes = max((catalog[d.variable].valid for d in domains if d.kind == "quantile"), key=len)
        by_run = inside.where("kind = 'quantile'").groupBy("domain", "grp", "q", "h", "a", "run").agg(*map(F.expr, [
            *sums, "min(low) AS low", "max(high) AS high", "bool_or(valid) AS valid"]))
        parts.append(_quantiles(by_run.withColumnRenamed("run", "y"), codes, z))
    estimates = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    code_items = spark.createDataFrame([(place[i], i.variable) for i in items if i.role == "codes"], "item int, variable string")
    retained = (
        cells.join(code_items, "item").groupBy("variable")
        .agg(F.array_sort(F.collect_set(F.col("run").cast("bigint"))).alias("retained_codes"))
    )
    scale = "CASE WHEN kind = 'prevalence' THEN 100D ELSE 1D END"
    scaled = ("estimate", "se", "lci", "uci", "unweighted", "reserved_kept")
    return (
        labels.join(estimates, "domain")
        .join(retained, "variable", "left")
        .selectExpr(
            "domain_key", "variable", "universe", "kind", "q", *[f"{scale} * {c} AS {c}" for c in scaled],
            "CASE WHEN kind = 'prevalence' THEN deff END AS deff",
            "n", "denominator_weighted", "n_psu", "n_strata",
            "CASE WHEN kind = 'prevalence' OR retained_codes IS NULL THEN CAST(array() AS array<bigint>) ELSE retained_codes END AS retained_codes",
            "groupby", "CASE WHEN groupby IS NOT NULL THEN grp END AS group_value",
        )
        .where(F.col("n") > 0)
    )


def _quantiles(cells: DataFrame, codes: Sequence[int], z: float) -> DataFrame:
    """Quantile domains: the weighted point with its interval, and the two flawed points."""
    keys = ["domain", "grp", "q"]
    mass = cells.where("valid").select(*keys, "h", "a", "y", F.col("s_w").alias("s"), "n", "n_dropped_weight")
    runs = cells.groupBy(*keys, "y").agg(*map(F.expr, [
        "sum(s_w) AS s", "sum(n_all) AS count", "sum(kept_w) AS kept", "min(low) AS low",
        "max(high) AS high",
    ]))
    summed = running_weight(runs, keys, codes, ("s", "count", "kept"))

    def marks(name: str, mass: str, low: str, high: str) -> tuple[str, str]:
        """First and last midpoint on the scale of one kind of mass; none where that mass is missing."""
        return (
            f"CASE WHEN {mass} > 0 THEN (c_{mass} - {mass} + 0.5D * {low}) / total_{mass} END AS {name}_first",
            f"CASE WHEN {mass} > 0 THEN (c_{mass} - 0.5D * {high}) / total_{mass} END AS {name}_last",
        )

    knots = summed.selectExpr(
        *keys, "y", *marks("k", "s", "low", "high"), *marks("u", "count", "1D", "1D"),
        *marks("a", "kept", "low", "high"),
    )
    flawed = [
        interpolate("q", "y", "u_first", "u_last").alias("unweighted"),
        interpolate("q", "y", "a_first", "a_last").alias("reserved_kept"),
    ]
    points = woodruff(mass, knots, "q", keys, flawed, z)
    return points.select(
        "domain", "grp", "estimate", "se", "lci", "uci", F.lit(None).cast("double").alias("deff"), "unweighted",
        "reserved_kept", "n", "denominator_weighted", "n_psu", "n_strata",
    )


ESTIMATE_SCHEMA = T.StructType(
    [
        T.StructField("domain_key", T.StringType()),
        T.StructField("variable", T.StringType()),
        T.StructField("universe", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("q", T.DoubleType()),
        *[T.StructField(c, T.DoubleType())
          for c in ("estimate", "se", "lci", "uci", "unweighted", "reserved_kept", "deff")],
        T.StructField("n", T.LongType()),
        T.StructField("denominator_weighted", T.DoubleType()),
        T.StructField("n_psu", T.LongType()),
        T.StructField("n_strata", T.LongType()),
        T.StructField("retained_codes", T.ArrayType(T.LongType())),
    ]
)
GROUPED_SCHEMA = T.StructType(
    [*ESTIMATE_SCHEMA, T.StructField("groupby", T.StringType()), T.StructField("group_value", T.LongType())])


def grouped_estimates(
    df: DataFrame, domains: Iterable[Domain], catalog: Catalog, design: Design, z: float = Z95
) -> DataFrame:
    """One row per domain and group value that has substantive rows, ``group_value`` NULL for domains without grouping.

    Shares are in percent, others in the variable's unit. One scan of the data runs when this is called, whatever the number of
    domains and of grouping columns; the flawed variants ``unweighted`` and ``reserved_kept`` come from the same scan. Domains
    themselves are descriptions and stay on the driver.
    """
    todo = sorted(set(domains), key=lambda d: (d.key, d.q or 0.0))
    if not todo:
        return df.sparkSession.createDataFrame([], GROUPED_SCHEMA)
    return _estimates(df, todo, catalog, design, z)


def batch_estimates(
    df: DataFrame, domains: Iterable[Domain], catalog: Catalog, design: Design, z: float = Z95
) -> DataFrame:
    """``grouped_estimates`` of domains without grouping, one row for each that has substantive rows."""
    todo = set(domains)
    if any(d.groupby is not None for d in todo):
        raise ValueError("a domain has a grouping column, use grouped_estimates")
    return grouped_estimates(df, todo, catalog, design, z).drop("groupby", "group_value")
