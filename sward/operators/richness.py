"""Richness and cover by class: one pass per unit for any number of conditions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sward.functions.semantics import is_true, non_rare

# Category codes of the cover tables.
NATIVE, INTRODUCED = "NAT", "INT"
LIFESPANS = {
    "annual": "ANNUAL",
    "peren": "PERENNIAL",
    "biennial": "BIENNIAL",
    "indeter": "INDETERMINATE",
    "null_lspan": "NULL",
}


def class_predicates(class_col: str, provenance: str = "local_provenance") -> dict[str, Column]:
    """Conditions of one class system, alone and crossed with provenance. Rare here means "not non-rare", so it takes in
    species that have no class; the class named Rare alone is ``rarespp``."""
    c, p = F.col(class_col), F.col(provenance)
    nr = non_rare(class_col)
    return {
        "domspp": c == "Dominant",
        "rarespp": c == "Rare",
        "subordspp": c == "Subordinate",
        "non_rare": nr,
        "rare": ~nr,
        "rare_int": ~nr & (p == INTRODUCED),
        "rare_nat": ~nr & (p == NATIVE),
        "non_rare_int": nr & (p == INTRODUCED),
        "non_rare_nat": nr & (p == NATIVE),
        "dom_nat": (c == "Dominant") & (p == NATIVE),
        "dom_int": (c == "Dominant") & (p == INTRODUCED),
        "sub_nat": (c == "Subordinate") & (p == NATIVE),
        "sub_int": (c == "Subordinate") & (p == INTRODUCED),
    }


def lifespan_predicates(col: str = "local_lifespan") -> dict[str, Column]:
    return {k: F.col(col) == v for k, v in LIFESPANS.items()}


def provenance_predicates(col: str = "local_provenance") -> dict[str, Column]:
    return {"nat": F.col(col) == NATIVE, "int": F.col(col) == INTRODUCED}


def richness_by(
    df: DataFrame,
    unit: Sequence[str],
    species: str,
    preds: Mapping[str, Column],
    na_as_level: bool = False,
    prefix: str = "sr_",
) -> DataFrame:
    """Distinct species per unit that meet each condition.

    Rows are first reduced to one per (unit, species) and the counts are then plain sums, so no row is copied per
    condition. The conditions of a row travel as bits of a few integers, which keeps the first grouping narrow however
    many conditions there are. With ``na_as_level`` a unit where a condition cannot be decided for some row counts one
    more (the undecided rows taken together as one level).
    """
    met = _pack([is_true(p) for p in preds.values()], "_met")
    open_ = _pack([p.isNull() for p in preds.values()], "_open") if na_as_level else {}
    per_species = df.groupBy(*unit, species).agg(*[F.bit_or(c).alias(n) for n, c in {**met, **open_}.items()])
    out = []
    for i, name in enumerate(preds):
        n = F.sum(_bit("_met", i))
        out.append((n + F.max(_bit("_open", i)) if na_as_level else n).cast("long").alias(prefix + name))
    return per_species.groupBy(*unit).agg(*out)


def profile_by(
    df: DataFrame,
    unit: Sequence[str],
    species: str,
    value: str,
    richness: Mapping[str, Column],
    cover: Mapping[str, Column],
) -> DataFrame:
    """Richness under one set of conditions and cover under another, per unit, in one pass (``sr_*``, ``cover_*``)."""
    met = _pack([is_true(p) for p in richness.values()], "_met")
    sums = {f"_sum{i}": F.sum(F.when(p, F.col(value))) for i, p in enumerate(cover.values())}
    per_species = df.groupBy(*unit, species).agg(
        *[F.bit_or(c).alias(n) for n, c in met.items()], *[c.alias(n) for n, c in sums.items()]
    )
    return per_species.groupBy(*unit).agg(
        *[F.sum(_bit("_met", i)).cast("long").alias(f"sr_{name}") for i, name in enumerate(richness)],
        *[F.coalesce(F.sum(f"_sum{i}"), F.lit(0.0)).alias(f"cover_{name}") for i, name in enumerate(cover)],
    )


_BITS = 60


def _pack(flags: Sequence[Column], name: str) -> dict[str, Column]:
    """Flags as bits of as many long columns as needed."""
    out = {}
    for start in range(0, len(flags), _BITS):
        word = F.lit(0).cast("long")
        for i, f in enumerate(flags[start : start + _BITS]):
            word = word + F.when(f, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
        out[f"{name}{start // _BITS}"] = word
    return out


def _bit(name: str, i: int) -> Column:
    return F.getbit(F.col(f"{name}{i // _BITS}"), F.lit(i % _BITS))


def cover_by(
    df: DataFrame,
    unit: Sequence[str],
    value: str,
    preds: Mapping[str, Column],
    na_rm: bool = True,
    prefix: str = "cover_",
) -> DataFrame:
    """Sum of a value per unit over the rows that meet each condition; 0 when none does.

    With ``na_rm=False`` a unit is NULL where the condition or a selected value is unknown for some row.
    """
    out = []
    for name, p in preds.items():
        total = F.coalesce(F.sum(F.when(p, F.col(value))), F.lit(0.0))
        if not na_rm:
            unknown = F.max((p.isNull() | (is_true(p) & F.col(value).isNull())).cast("int"))
            total = F.when(unknown == 0, total)
        out.append(total.alias(prefix + name))
    return df.groupBy(*unit).agg(*out)
