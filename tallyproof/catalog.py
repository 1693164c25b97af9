"""Variable metadata: what each coded column means, who was asked, which codes count.

The catalog is the independent source of truth of every estimate and every check. It is small, written by
hand, and lives on the driver; ``as_frame`` turns it into a table for joins.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CodeList = tuple[int, ...] | range

# Codes reserved for refusals, unknowns and missing answers, dropped from grouping columns
# that are not in the catalog.
RESERVED_GROUP_CODES = (7, 8, 9, 77, 88, 96, 97, 98, 99, 996, 997, 998, 999)


@dataclass(frozen=True)
class Design:
    """Columns of the sampling design."""

    weight: str
    stratum: str
    psu: str


@dataclass(frozen=True)
class Variable:
    """One coded column. ``universe`` None means that every respondent was asked."""

    name: str
    label: str
    universe: str | None
    universe_text: str
    valid: CodeList
    affirmative: CodeList = ()
    weight: str = ""
    notes: str = ""
    related: tuple[str, ...] = field(default_factory=tuple)

    def design(self, design: Design) -> Design:
        """The survey's design with this variable's own weight, if it has one."""
        return replace(design, weight=self.weight) if self.weight else design


VARIABLE_SCHEMA = T.StructType(
    [
        T.StructField("variable", T.StringType(), False),
        T.StructField("variable_label", T.StringType(), False),
        T.StructField("universe", T.StringType()),
        T.StructField("universe_text", T.StringType(), False),
        T.StructField("valid_codes", T.ArrayType(T.IntegerType()), False),
        T.StructField("affirmative_codes", T.ArrayType(T.IntegerType()), False),
        T.StructField("weight", T.StringType(), False),
        T.StructField("notes", T.StringType(), False),
        T.StructField("related", T.ArrayType(T.StringType()), False),
    ]
)


class Catalog:
    """The variables of one survey."""

    def __init__(self, variables: Iterable[Variable]):
        self._by_name = {v.name: v for v in variables}

    def __contains__(self, name: str) -> bool:
        return name in self._by_name

    def __iter__(self) -> Iterator[Variable]:
        return iter(self._by_name.values())

    def __getitem__(self, name: str) -> Variable:
        try:
            return self._by_name[name]
        except KeyError:
            raise KeyError(f"{name!r} is not in the catalog; known: {sorted(self._by_name)}") from None

    def as_frame(self, spark: SparkSession) -> DataFrame:
        rows = [
            (v.name, v.label, v.universe, v.universe_text, list(v.valid), list(v.affirmative),
             v.weight, v.notes, list(v.related))
            for v in self
        ]
        return spark.createDataFrame(rows, VARIABLE_SCHEMA)

    @classmethod
    def from_frame(cls, frame: DataFrame) -> Catalog:
        """Read a hand-written metadata table (one row per variable) back into a catalog."""
        return cls(
            Variable(
                name=r["variable"], label=r["variable_label"], universe=r["universe"],
                universe_text=r["universe_text"], valid=compact_codes(r["valid_codes"]),
                affirmative=tuple(r["affirmative_codes"]), weight=r["weight"], notes=r["notes"],
                related=tuple(r["related"]),
            )
            for r in frame.select(*VARIABLE_SCHEMA.fieldNames()).collect()
        )


@dataclass(frozen=True)
class WaveVariable:
    """Where a cross-wave measure lives in one wave, and how it is coded there."""

    canonical: str
    wave: int
    variable: str
    weight: str
    valid: CodeList
    affirmative: CodeList
    encoding: str


WAVE_SCHEMA = T.StructType(
    [
        T.StructField("canonical", T.StringType(), False),
        T.StructField("wave", T.IntegerType(), False),
        T.StructField("variable", T.StringType(), False),
        T.StructField("weight", T.StringType(), False),
        T.StructField("valid_codes", T.ArrayType(T.IntegerType()), False),
        T.StructField("affirmative_codes", T.ArrayType(T.IntegerType()), False),
        T.StructField("encoding", T.StringType(), False),
    ]
)


class WaveCatalog:
    """The (canonical name, wave) resolution table."""

    def __init__(self, entries: Iterable[WaveVariable]):
        self.entries = tuple(entries)

    def __iter__(self) -> Iterator[WaveVariable]:
        return iter(self.entries)

    def resolve(self, canonical: str, wave: int) -> WaveVariable:
        for entry in self.entries:
            if entry.canonical == canonical and entry.wave == wave:
                return entry
        raise KeyError(f"{canonical!r} has no variable in wave {wave}")

    def as_frame(self, spark: SparkSession) -> DataFrame:
        rows = [
            (e.canonical, e.wave, e.variable, e.weight, list(e.valid), list(e.affirmative), e.encoding)
            for e in self.entries
        ]
        return spark.createDataFrame(rows, WAVE_SCHEMA)


def compact_codes(codes: Iterable[int]) -> CodeList:
    """A contiguous run of codes as a range, which filters as an interval instead of a long IN list."""
    codes = tuple(codes)
    if len(codes) > 2 and codes == tuple(range(codes[0], codes[0] + len(codes))):
        return range(codes[0], codes[0] + len(codes))
    return codes


def unknown_variables(requested: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of ``requested`` whose ``variable`` the metadata table does not know."""
    return requested.join(known.select("variable").distinct(), "variable", "left_anti").select(
        F.col("variable")
    )
