"""Column-level functions (all JVM-side expressions, no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Letter grade -> quality points.  These must equal the
# grading policy the analyses were defined with.
# Standard policy (letters missing here but listed in NON_GPA_LETTERS map to
# NULL): A+ 4.0, A 4.0, A- 3.67, B+ 3.33, B 3.00, B- 2.67, C+ 2.33, C 2.00,
# C- 1.67, D 1.00, F 0.00, IN 0.00.
# Letters without grade points: S, NC, W, NR, AU, REG, IX, IP, nan.
# Alternative "report" policy: W 1.0, S 3.0, NC 1.0; other letters without
# grade points are dropped.
# ---------------------------------------------------------------------------
GRADE_POINTS = {
    "A+": 4.0, "A": 4.0, "A-": 3.67, "B+": 3.33, "B": 3.00, "B-": 2.67,
    "C+": 2.33, "C": 2.00, "C-": 1.67, "D": 1.00, "F": 0.00, "IN": 0.00,
}
NON_GPA_LETTERS = ("S", "NC", "W", "NR", "AU", "REG", "IX", "IP", "nan")
REPORT_POLICY_EXTRA = {"W": 1.0, "S": 3.0, "NC": 1.0}

# Term season suffixes of the YYYYSS term code.
SPRING, SUMMER, FALL = 10, 40, 70
SEASON_NAMES = {SPRING: "Spring", SUMMER: "Summer", FALL: "Fall"}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def grade_points(grade, policy: str = "standard", strict: bool = False) -> Column:
    """Letter grade -> quality points (DOUBLE, NULL when the letter carries none).

    ``strict=True`` fails the query on a letter that is in neither table, as the
    original lookup did; otherwise unknown letters give NULL.
    """
    g = _col(grade)
    table = dict(GRADE_POINTS)
    if policy == "report":
        table.update(REPORT_POLICY_EXTRA)
    elif policy != "standard":
        raise ValueError(f"unknown grade policy {policy!r}")
    # one literal map lookup: the letter expression is evaluated once per row
    # (a CASE chain would be inlined into every branch of an upstream CASE)
    lookup = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(float(v)))])
    pts = F.try_element_at(lookup, g)
    if not strict:
        return pts
    return F.when(pts.isNotNull() | g.isNull() | g.isin(*NON_GPA_LETTERS), pts).otherwise(
        F.raise_error(F.concat(F.lit("unknown grade letter: "), g)).cast("double"))


def course_level(cnum) -> Column:
    """First digit of the trimmed course number as INT, NULL if there is none."""
    digit = F.regexp_extract(F.trim(_col(cnum).cast("string")), r"[0-9]", 0)
    return F.nullif(digit, F.lit("")).cast("int")


def season(term) -> Column:
    return _col(term) % 100


def is_summer(term) -> Column:
    return season(term) == SUMMER


def next_term(term) -> Column:
    """Next YYYYSS code: 10 -> 40 -> 70 -> next year's 10."""
    t = _col(term)
    year = F.floor(t / 100).cast("long")
    s = t % 100
    return (F.when(s == FALL, (year + 1) * 100 + SPRING)
             .when(s == SUMMER, year * 100 + FALL)
             .otherwise(year * 100 + SUMMER)).cast("long")


def prev_term(term) -> Column:
    """Previous YYYYSS code: 10 -> previous year's 70, 40 -> 10, 70 -> 40."""
    t = _col(term)
    year = F.floor(t / 100).cast("long")
    s = t % 100
    return (F.when(s == SPRING, (year - 1) * 100 + FALL)
             .when(s == SUMMER, year * 100 + SPRING)
             .otherwise(year * 100 + SUMMER)).cast("long")


def clip(col, lo: float, hi: float) -> Column:
    """Bound to [lo, hi]; NULL stays NULL (``least``/``greatest`` skip NULLs)."""
    c = _col(col)
    return F.when(c.isNull(), F.lit(None).cast("double")).otherwise(
        F.least(F.greatest(c, F.lit(float(lo))), F.lit(float(hi))))


def term_display_name(term) -> Column:
    """'Spring 2010' style name of a YYYYSS code."""
    t = _col(term)
    s = t % 100
    name = (F.when(s == SPRING, F.lit(SEASON_NAMES[SPRING]))
             .when(s == SUMMER, F.lit(SEASON_NAMES[SUMMER]))
             .otherwise(F.lit(SEASON_NAMES[FALL])))
    return F.concat(name, F.lit(" "), F.floor(t / 100).cast("long").cast("string"))


def term_short_name(term) -> Column:
    """'Sp10' style short name of a YYYYSS code."""
    t = _col(term)
    s = t % 100
    name = F.when(s == SPRING, F.lit("Sp")).when(s == SUMMER, F.lit("Su")).otherwise(F.lit("Fa"))
    return F.concat(name, F.lpad((F.floor(t / 100).cast("long") % 100).cast("string"), 2, "0"))


def safe_div(a, b) -> Column:
    """Division giving NULL on a zero or NULL divisor (ANSI-safe)."""
    return F.try_divide(_col(a), _col(b))
