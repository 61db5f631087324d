"""Column functions for numbers, dates, codes and small display values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Col = Column | str


def _c(x: Col) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_divide(num: Col, den: Col) -> Column:
    """num / den; missing when either is missing or the denominator is 0."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def growth(value: Col, prior: Col) -> Column:
    """(value - prior) / |prior|; missing on a missing or zero prior."""
    return safe_divide(_c(value) - _c(prior), F.abs(_c(prior)))


def deviation(actual: Col, budget: Col) -> Column:
    return safe_divide(_c(actual) - _c(budget), budget)


def share(part: Col, whole: Col) -> Column:
    return safe_divide(part, whole)


def cash_flow_flag(surplus: Col, cash_change: Col) -> Column:
    """A surplus on paper while cash falls; missing values compare as false."""
    return F.coalesce((_c(surplus) > 0) & (_c(cash_change) < 0), F.lit(False))


def clamp(value: Col, low: float = 0.0, high: float = 100.0, places: int = 2) -> Column:
    v = F.round(_c(value).cast("double"), places)
    return F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(low)), F.lit(high)))  # least and greatest skip missing values


def money(text: Col) -> Column:
    """A money cell as double: brackets are negative; blank, dashes and what doesn't parse are missing."""
    raw = F.trim(_c(text))
    bare = F.regexp_replace(raw, r"[,$＄\s]", "")
    negative = bare.rlike(r"^[(（].*[)）]$")
    digits = F.regexp_replace(bare, r"^[(（]|[)）]$", "")
    value = F.when(digits.isin("", "-", "—", "－", "–"), None).otherwise(F.try_to_number(digits, F.lit("S9999999999999999D999999")))
    value = F.coalesce(digits.try_cast("double"), value.cast("double"))
    return F.when(digits.isin("", "-", "—", "－", "–") | digits.rlike("(?i)nan|inf"), None).otherwise(F.when(negative, -value).otherwise(value))


def money_whole(text: Col) -> Column:
    """As ``money`` but whole, cut towards zero, and 0 where there is no number."""
    return F.coalesce(money(text).cast("bigint"), F.lit(0).cast("bigint"))


def number(text: Col, units: Sequence[str] = ("名", "人", "元", ",")) -> Column:
    """A number with unit marks; N/A, NAN and blanks are missing."""
    raw = F.upper(F.trim(_c(text)))
    for unit in units:
        raw = F.replace(raw, F.lit(unit), F.lit(""))
    return F.when(raw.isin("", "N/A", "NA", "NAN", "-"), None).otherwise(raw.try_cast("double"))


def capacity(text: Col) -> Column:
    """The first whole number of a text."""
    return F.nullif(F.regexp_extract(_c(text), r"(\d+)", 1), F.lit("")).try_cast("int")


def fine(text: Col, lead: str = "罰鍰") -> Column:
    """The amount after the word for a fine, thousands separators allowed."""
    digits = F.regexp_extract(_c(text), lead + r"[^0-9]{0,6}([0-9][0-9,]*)", 1)
    return F.nullif(F.replace(digits, F.lit(","), F.lit("")), F.lit("")).try_cast("bigint")


def date_in(text: Col) -> Column:
    """The first y-m-d or y/m/d of a text; an impossible date is missing."""
    found = F.regexp_extract(_c(text), r"(\d{4})[-/](\d{1,2})[-/](\d{1,2})", 0)
    return F.to_date(F.try_to_timestamp(F.replace(found, F.lit("/"), F.lit("-")), F.lit("y-M-d")))


def feed_date(text: Col) -> Column:
    """As ``date_in``, else the date of an RFC 822 stamp (its weekday is not read)."""
    bare = F.regexp_replace(_c(text), r"^\s*[A-Za-z]{3},\s*", "")
    bare = F.regexp_replace(bare, r"\b(GMT|UTC|Z)\s*$", "+0000")
    return F.coalesce(date_in(text), F.to_date(F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z"))))


def iso(stamp: Col) -> Column:
    return F.date_format(_c(stamp), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def epoch_iso(seconds: Col) -> Column:
    return iso(F.timestamp_seconds(_c(seconds)))


def case_number(case_id: Col, created: Col) -> Column:
    """R + yymm + '-' + the id in six digits."""
    return F.concat(F.lit("R"), F.date_format(_c(created), "yyMM"), F.lit("-"), F.lpad(_c(case_id).cast("string"), 6, "0"))


def mask_email(email: Col) -> Column:
    """First character, up to five stars, and the domain; what has no @ is hidden whole."""
    e = _c(email)
    local = F.split_part(e, F.lit("@"), F.lit(1))
    stars = F.repeat(F.lit("*"), F.least(F.greatest(F.length(local) - 1, F.lit(1)), F.lit(5)))
    return F.when(e.contains("@"), F.concat(F.left(local, F.lit(1)), stars, F.lit("@"), F.split_part(e, F.lit("@"), F.lit(2))))


def excerpt(text: Col, width: int = 60) -> Column:
    t = _c(text)
    return F.when(F.length(t) > width, F.concat(F.left(t, F.lit(width)), F.lit("…"))).otherwise(t)


#: The public life-cycle of a report, and its closed-by-refusal end.
STEPS = ("submitted", "investigating", "closed")
REFUSED = "rejected"


def steps(status: Col, order: Sequence[str] = STEPS) -> Column:
    """The life-cycle as array<struct<key, state>>: done before the present step, current at it, todo after it."""
    keys = F.array(*[F.lit(s) for s in order])
    here = F.when(_c(status) == REFUSED, len(order)).otherwise(F.array_position(keys, _c(status)))
    return F.transform(
        keys,
        lambda k, i: F.struct(
            k.alias("key"),
            F.when(i + 1 < here, "done").when(i + 1 == here, F.when(here == len(order), "done").otherwise("current")).otherwise("todo").alias("state"),
        ),
    )


#: Direction codes and their labels.
DIRECTIONS = {"HIGH": "high", "LOW": "low", "SHIFT": "shift"}


def directions(codes: Col) -> Column:
    """Known codes of a '+'-joined list, in order, as an array."""
    parts = F.transform(F.split(F.upper(F.coalesce(_c(codes), F.lit(""))), r"\+"), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p.isin(*DIRECTIONS))


def direction_labels(codes: Col) -> Column:
    table = F.create_map(*[F.lit(x) for kv in DIRECTIONS.items() for x in kv])
    return F.array_join(F.transform(directions(codes), lambda p: table[p]), " + ")


def label(value: Col, table: dict[str, str], default: str | None = None) -> Column:
    """Display label of a code; an unknown code gives ``default``, or itself where there is none."""
    mapped = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[_c(value)]
    return F.coalesce(mapped, _c(value) if default is None else F.lit(default))


def distance_km(lat1: Col, lng1: Col, lat2: Col, lng2: Col) -> Column:
    """Great-circle distance in kilometres on a sphere of radius 6371."""
    a = F.pow(F.sin(F.radians(_c(lat2) - _c(lat1)) / 2), 2)
    b = F.cos(F.radians(_c(lat1))) * F.cos(F.radians(_c(lat2))) * F.pow(F.sin(F.radians(_c(lng2) - _c(lng1)) / 2), 2)
    return F.when((a + b).isNotNull(), 2 * 6371.0 * F.asin(F.sqrt(F.least(a + b, F.lit(1.0)))))


def geo_score(lat1: Col, lng1: Col, lat2: Col, lng2: Col) -> Column:
    """1 within 0.5 km, 0.8 within 1, 0.5 within 2, 0.2 within 5, else 0; 0.5 where a coordinate is missing."""
    km = distance_km(lat1, lng1, lat2, lng2)
    return F.when(km.isNull(), 0.5).when(km <= 0.5, 1.0).when(km <= 1, 0.8).when(km <= 2, 0.5).when(km <= 5, 0.2).otherwise(0.0)


def coordinates_valid(lat: Col, lng: Col, box: tuple[float, float, float, float] = (21.0, 26.0, 119.0, 123.0)) -> Column:
    inside = _c(lat).between(box[0], box[1]) & _c(lng).between(box[2], box[3])
    return F.coalesce(inside, F.lit(False))


def rating_valid(rating: Col) -> Column:
    """A whole number from 1 to 5 (for number columns); missing is not valid."""
    r = _c(rating)
    return F.coalesce(r.between(1, 5) & (r == F.floor(r)), F.lit(False))


def rating_from_text(text: Col) -> Column:
    """The lenient form: text that is 1 to 5 as int, else missing."""
    return F.when(F.trim(_c(text)).rlike("^[1-5]$"), F.trim(_c(text)).try_cast("int"))
