"""Column-level semantics shared by every operator.

Each helper states which reading of missing values, zero denominators and interval edges it takes, because
these decide results: a share of nothing is NULL, a class of an unseen species is "not rare" unless asked
otherwise, a strict sum is NULL as soon as one input is.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class cut points and labels used by the dominance and rarity systems.
CUTS_STANDARD = (0.0, 0.2, 0.8, 1.0)
CUTS_WIDE_RARE = (0.0, 0.4, 0.8, 1.0)
CUTS_WIDE_DOMINANT = (0.0, 0.2, 0.7, 1.0)
CLASS_LABELS = ("Rare", "Subordinate", "Dominant")
CLASS_ORDER = {"Rare": 1, "Subordinate": 2, "Dominant": 3}
# Fixed value: makes the median absolute deviation consistent with a normal standard deviation.
MAD_SCALE = 1.4826


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(num: str | Column, den: str | Column) -> Column:
    """num / den as double; NULL when the denominator is zero or either side is NULL."""
    return F.try_divide(as_col(num).cast("double"), as_col(den).cast("double"))


def corrected_div(num: str | Column, den: str | Column) -> Column:
    """num / den with 0/0 read as 0 and x/0 read as 1 (both stay NULL when an input is NULL)."""
    n, d = as_col(num).cast("double"), as_col(den).cast("double")
    return F.when(d == 0, F.when(n == 0, F.lit(0.0)).when(n.isNotNull(), F.lit(1.0))).otherwise(F.try_divide(n, d))


def pct_diff(treated: str | Column, control: str | Column, scale: float = 100.0) -> Column:
    """Per cent difference of a treatment from its control; NULL when the control is zero or missing."""
    t, c = as_col(treated), as_col(control)
    return safe_div(t - c, c) * F.lit(scale)


def positive_ln(c: str | Column) -> Column:
    """Natural log of positive values; zero and negative values give NULL (log of absence is not a number)."""
    return F.when(as_col(c) > 0, F.ln(as_col(c)))


def strict_agg(agg, c: str | Column) -> Column:
    """An aggregate that is NULL as soon as one of its inputs is NULL, e.g. ``strict_agg(F.sum, "x")``."""
    col = as_col(c)
    return F.when(F.count(F.lit(1)) == F.count(col), agg(col))


def na_agg(agg, c: str | Column, na_rm: bool = True) -> Column:
    return agg(as_col(c)) if na_rm else strict_agg(agg, c)


def member(c: str | Column, values: Sequence) -> Column:
    """Set membership that is never NULL: a missing value is simply not a member."""
    return F.coalesce(as_col(c).isin(*values), F.lit(False))


def is_true(c: str | Column) -> Column:
    return F.coalesce(as_col(c), F.lit(False))


def cut_class(
    c: str | Column,
    breaks: Sequence[float] = CUTS_STANDARD,
    labels: Sequence[str] = CLASS_LABELS,
    include_lowest: bool = False,
) -> Column:
    """Right-closed interval class ``(b0, b1], (b1, b2], ...``; values outside every interval give NULL."""
    if len(breaks) != len(labels) + 1:
        raise ValueError("need one more break than labels")
    col = as_col(c)
    out = None
    for i, label in enumerate(labels):
        low = col >= breaks[i] if include_lowest and i == 0 else col > breaks[i]
        cond = low & (col <= breaks[i + 1])
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out


def class_order(c: str | Column, order: Mapping[str, int] = CLASS_ORDER) -> Column:
    """Integer order code of an ordered label, for sorting where the label text would sort wrongly."""
    return recode(c, {k: str(v) for k, v in order.items()}, keep_other=False).cast("int")


def non_rare(c: str | Column) -> Column:
    """Subordinate or dominant; a species without a class is *not* non-rare, hence counts as rare."""
    return member(c, CLASS_LABELS[1:])


def recode(c: str | Column, mapping: Mapping[str, str], keep_other: bool = True) -> Column:
    """Replace category values; values not named are kept, or become NULL when ``keep_other`` is false."""
    col = as_col(c)
    out = None
    for old, new in mapping.items():
        out = F.when(col == old, F.lit(new)) if out is None else out.when(col == old, F.lit(new))
    return out.otherwise(col) if keep_other else out


def rescale(c: str | Column, low: str | Column, high: str | Column) -> Column:
    """Map [low, high] to [0, 1]; a zero range maps to 0.5."""
    col, lo, hi = as_col(c), as_col(low), as_col(high)
    return F.when(col.isNotNull(), F.when(hi == lo, F.lit(0.5)).otherwise(safe_div(col - lo, hi - lo)))


def inverse_logit(c: str | Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-as_col(c)))


def key_label(*cols: str | Column, sep: str = "_") -> Column:
    """Composite key or label; missing parts are written as "NA" so that two keys never collapse."""
    return F.concat_ws(sep, *[F.coalesce(as_col(c).cast("string"), F.lit("NA")) for c in cols])


def years_label(c: str | Column) -> Column:
    return F.concat(as_col(c).cast("string"), F.lit(" years"))


def to_number(c: str | Column) -> Column:
    """Tolerant numeric cast: text that is not a number gives NULL."""
    return as_col(c).try_cast("double")


def presence(c: str | Column) -> Column:
    return (as_col(c) > 0).cast("int")
