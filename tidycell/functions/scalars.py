"""Scalar expressions on wire text (PR-01 .. PR-07, PR-12, PR-13, PR-16, PR-20 .. PR-23)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text patterns of the wire format. Digits may be full-width.
DIGIT = "[0-9０-９]"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
YEAR = f"({DIGIT}{{4}})"
QUARTER = "(?i)Q([1-4１-４])"
# yyyy-mm anywhere, else yyyymmdd anywhere, else yyyymm anywhere.
MONTH = (
    f"(?s)^(?:.*?{DIGIT}{{4}}-(?={DIGIT}{{2}})|.*?{DIGIT}{{4}}(?={DIGIT}{{4}})|.*?{DIGIT}{{4}}(?={DIGIT}{{2}}))({DIGIT}{{2}})"
)
INT_TEXT = "^-?[0-9]+$"
DOUBLE_TEXT = r"^-?[0-9]+\.[0-9]+$"
DATE_TEXT = "^[0-9]{4}-[0-9]{2}-[0-9]{2}"
DEFAULT_YEAR = 2020
WHITESPACE = " \t\n\r\f\v　"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Every function below refers to its input once.  Catalyst copies an expression to each
# place that refers to it when it pushes a filter through a projection, so an input
# referred to five times would be computed five times, and nested ones many more.

def ascii_digits(c, drop: str = "") -> Column:
    """Full-width digits become ASCII ones; the characters of ``drop`` disappear in the same pass."""
    return F.translate(_col(c), "０１２３４５６７８９" + drop, "0123456789")


def _number_in(c, pattern: str) -> Column:
    """First capture group as INT, NULL when the pattern does not occur."""
    return ascii_digits(F.regexp_extract(_col(c), pattern, 1)).try_cast("int")


def dataset_id_from_path(path) -> Column:
    """PR-01: the file name up to its first underscore."""
    return F.substring_index(F.substring_index(_col(path), "/", -1), "_", 1)


def to_number(c, drop: str = "") -> Column:
    """Double for plain decimal or scientific notation, NULL for anything else; ``drop`` is removed first."""
    text = F.btrim(ascii_digits(c, drop), F.lit(WHITESPACE))
    return F.regexp_extract(text, NUMBER, 0).try_cast("double")


def measure(c, on_bad: str = "zero", separators: bool = False) -> Column:
    """PR-02 / PR-03: a measure as DOUBLE.

    ``zero``: thousands separators are removed; blank or unreadable text is 0.
    ``null``: separators are not removed unless ``separators`` says so; blank, ``-`` or unreadable text is
    NULL, while a measure that is absent altogether is 0.
    """
    c = _col(c)
    if on_bad == "zero":
        return F.coalesce(to_number(c, ","), F.lit(0.0))
    if on_bad == "null":
        return F.when(c.isNull(), F.lit(0.0)).otherwise(to_number(c, "," if separators else ""))
    raise ValueError(f"on_bad must be 'zero' or 'null', not {on_bad!r}")


def year(time, default: int | None = DEFAULT_YEAR) -> Column:
    """PR-04: the first run of four digits; ``default`` (may be None) when there is none."""
    found = _number_in(time, YEAR)
    return found if default is None else F.coalesce(found, F.lit(default))


def quarter(time) -> Column:
    """PR-05: 1..4 from a ``Qn`` marker in any case, else 0."""
    return F.coalesce(_number_in(time, QUARTER), F.lit(0))


def month(time) -> Column:
    """PR-06: month digits of ``yyyy-mm``, ``yyyymmdd`` or ``yyyymm``, in that order, else 0. Not range checked."""
    return F.coalesce(_number_in(time, MONTH), F.lit(0))


def legacy_year(time) -> Column:
    """PR-07: the whole time code as a number, 2020 when absent, NULL when not numeric."""
    text = F.btrim(ascii_digits(F.coalesce(_col(time), F.lit(str(DEFAULT_YEAR)))), F.lit(WHITESPACE))
    return F.regexp_extract(text, "^[+-]?[0-9]+$", 0).try_cast("bigint")


def period_bounds(time) -> tuple[Column, Column]:
    """Opt-in: first and last month of a ten-digit time code ``yyyy??mmMM``; NULL for other lengths."""
    t = ascii_digits(time)
    ten = t.rlike("^[0-9]{10}$")
    return (F.when(ten, F.substring(t, 7, 2).cast("int")), F.when(ten, F.substring(t, 9, 2).cast("int")))


def normalised_name(c) -> Column:
    """PR-12: ASCII snake case of a column name held as data; ``column`` when nothing is left."""
    text = F.regexp_replace(_col(c), r"[^\x00-\x7F]+", "")
    text = F.lower(F.regexp_replace(text, "[^a-zA-Z0-9_]", "_"))
    text = F.btrim(F.regexp_replace(text, "_+", "_"), F.lit("_"))
    return F.when(text == "", F.lit("column")).otherwise(text)


def normalised_names(names: list[str]) -> list[str]:
    """PR-12 for the columns of a schema; names that collide get ``_2``, ``_3`` ..."""
    taken: set[str] = set()
    result = []
    for name in names:
        plain = re.sub("[^a-z0-9_]", "_", re.sub(r"[^\x00-\x7F]", "", name).lower())
        plain = re.sub("_+", "_", plain).strip("_") or "column"
        unique, n = plain, 1
        while unique in taken:
            n += 1
            unique = f"{plain}_{n}"
        taken.add(unique)
        result.append(unique)
    return result


def text_type(c) -> Column:
    """PR-13: INT, DOUBLE, TIMESTAMP or STRING by the look of one text value."""
    c = _col(c)
    return (
        F.when(c.rlike(INT_TEXT), "INT")
        .when(c.rlike(DOUBLE_TEXT), "DOUBLE")
        .when(c.rlike(DATE_TEXT), "TIMESTAMP")
        .otherwise("STRING")
    )


def json_text(raw) -> Column:
    """JSON text without leading blanks, line ends or byte order mark, so its first character tells its kind."""
    return F.ltrim(_col(raw), F.lit(" \t\r\n\ufeff"))


def string_or_object(raw, default: str | None = None) -> Column:
    """PR-16: the text itself, or the ``$`` member when the field holds an object."""
    raw = _col(raw)
    text = F.when(json_text(raw).startswith("{"), F.get_json_object(raw, "$['$']")).otherwise(raw)
    return text if default is None else F.coalesce(text, F.lit(default))


def grouped_digits(c) -> Column:
    """PR-20: a count with thousands separators."""
    return F.format_number(_col(c), 0)


def table_link(dataset_id, base: str) -> Column:
    """PR-21: ``base`` plus the digits of the id; NULL when the id has no digits."""
    return F.concat(F.lit(base), F.nullif(F.regexp_replace(_col(dataset_id), "[^0-9]", ""), F.lit("")))


def digits_only(code) -> Column:
    """PR-22: a code made of digits only as INT, NULL otherwise."""
    code = _col(code)
    return F.when(code.rlike("^[0-9]+$"), code.try_cast("int"))


def percent_of(value, total) -> Column:
    """PR-23: share of a total in percent; NULL for a zero total."""
    return 100 * F.try_divide(_col(value), _col(total))


def first_match(subject: Column, rules, otherwise) -> Column:
    """Ordered rules ``(label, terms)``: the label of the first rule with a term contained in ``subject``.

    The rules are part of the expression, so no join and no broadcast is needed.
    """
    hit = F.lit(None).cast("string")
    for label, terms in reversed(list(rules)):
        pattern = "|".join(re.escape(t) for t in terms)
        hit = F.when(subject.rlike(pattern), F.lit(label)).otherwise(hit)
    return F.coalesce(hit, F.lit(otherwise))
