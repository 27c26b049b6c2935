"""Column functions: one per scalar rule. Each takes and returns columns; none looks at data."""

from __future__ import annotations

import unicodedata

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Legacy phase words sort before every ISO date, in this order.
PHASE_WORDS = {"start": "0000-00-00", "mid": "0000-00-01", "end": "0000-00-02"}
#: Where a phase word lies in its season: years to add, month, day.
PHASE_DAYS = {"start": (-1, 7, 1), "mid": (0, 1, 1), "end": (0, 6, 30)}
#: The familiarity tiers (from, multiplier), highest first; below all of them 0.5.
TIERS = ((18, 1.0), (15, 0.95), (10, 0.85), (5, 0.7))
#: The marks of the fee field.
FEES = {0xFFFF: "stay", 0xFFFE: "loan", 0xFFFD: "free", 0: "free"}
FOREVER = 255


def lookup(col: Column, values: Mapping, default: Column | None = None) -> Column:
    """A small code map as one CASE expression; no join for a handful of constants."""
    out = None
    for k, v in values.items():
        out = F.when(col == k, F.lit(v)) if out is None else out.when(col == k, F.lit(v))
    return out if default is None else out.otherwise(default)


def phase_key(phase: Column) -> Column:
    return lookup(phase, PHASE_WORDS, phase)


def ordinal(season: Column, phase: Column) -> Column:
    """Sorts snapshots as text: four digits of the season, then the phase key."""
    return F.concat(F.lpad(season.cast("string"), 4, "0"), phase_key(phase))


def phase_date(season: Column, phase: Column) -> Column:
    """A phase as a date; words lie in the season's window, what can't be read is null."""
    out = None
    for word, (years, month, day) in PHASE_DAYS.items():
        made = F.make_date((season + years).cast("int"), F.lit(month), F.lit(day))
        out = F.when(phase == word, made) if out is None else out.when(phase == word, made)
    return out.otherwise(F.try_to_timestamp(phase, F.lit("yyyy-MM-dd")).cast("date"))


def age_at(born: Column, at: Column) -> Column:
    """Whole years: the difference of years, less one before the birthday."""
    before = (F.month(at) * 100 + F.dayofmonth(at)) < (F.month(born) * 100 + F.dayofmonth(born))
    return (F.year(at) - F.year(born) - before.cast("int")).cast("long")


def season_age(season: Column, born: Column) -> Column:
    return (season - F.year(born)).cast("long")


def age_band(age: Column) -> Column:
    return F.when(age.isNull(), "?").when(age < 21, "U21").when(age <= 24, "21-24").when(age <= 28, "25-28").otherwise("29+")


def label(name: Column, key: Column) -> Column:
    """The name, or #key where there is none."""
    return F.coalesce(F.nullif(name, F.lit("")), F.concat(F.lit("#"), key.cast("string")))


def surname_key(name: Column) -> Column:
    """Last word, then the words before it, folded; unnamed rows last."""
    words = F.split(F.lower(F.trim(name)), "\\s+")
    rest = F.array_join(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), " ")
    return F.when(F.coalesce(F.trim(name), F.lit("")) == "", F.lit("\U0010ffff")).otherwise(F.concat_ws("|", F.element_at(words, -1), rest))


def status(out_on_loan: Column, second_team: Column) -> Column:
    return F.when(out_on_loan, "loan").when(second_team, "reserve").otherwise("first")


def familiarity_multiplier(value: Column, curve: str = "linear_floor", floor: float = 0.5) -> Column:
    """0 to 1 from a familiarity clamped to 1..20."""
    v = F.greatest(F.lit(1), F.least(F.lit(20), value)).cast("double")
    v = F.when(value.isNotNull(), v)
    if curve == "proportional":
        return v / 20
    if curve == "tiers":
        out = None
        for least, m in TIERS:
            out = F.when(v >= least, m) if out is None else out.when(v >= least, m)
        return F.when(v.isNotNull(), out.otherwise(0.5))
    return F.lit(floor) + F.lit(1 - floor) * (v / 20)


def person_id(key: Column, born: Column) -> Column:
    return F.concat_ws("-", key.cast("string"), F.coalesce(born.cast("string"), F.lit("?")))


def started(order: Column) -> Column:
    return order <= 11


def appeared(order: Column, on: Column) -> Column:
    return (order <= 11) | (on != FOREVER)


def minutes(order: Column, on: Column, off: Column, length: int = 90) -> Column:
    """From coming on (0 for a starter) to going off (the end if never); 0 if unused."""
    end = F.when(off == FOREVER, length).otherwise(off)
    begin = F.when(on == FOREVER, 0).otherwise(on)
    return F.when(appeared(order, on), end - begin).otherwise(0).cast("long")


def fee(code: Column, amount: Column | None = None) -> Column:
    """A fee's text. With ``amount`` only ``code`` is read as a code, so an amount that equals one stays an amount; a row without a code has its amount."""
    return lookup(code, FEES, (code if amount is None else amount).cast("string"))


def round_scaled(value: Column, digits: int) -> Column:
    """As SQL engines round: the scaled number to a whole one, halves away from zero. ``F.round`` goes by the shortest decimal instead: 1.005 gives 1.01 there and 1.0 here."""
    scale = F.lit(10.0**digits)
    return F.round(value * scale) / scale


def season_from_code(code: Column, base: int = 1971) -> Column:
    return code + base


def result(ours: Column, theirs: Column) -> Column:
    return F.when(ours > theirs, "W").when(ours < theirs, "L").when(ours == theirs, "D")


def points(ours: Column, theirs: Column) -> Column:
    return F.when(ours > theirs, 3).when(ours == theirs, 1).when(ours < theirs, 0).cast("long")


def _plain_letters() -> tuple[str, str]:
    """Letters of the Latin blocks that decompose into one letter and marks, and that letter: found by rule."""
    pairs = {}
    for point in (*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)):
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(point)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain != chr(point):
            pairs[chr(point)] = plain
    return "".join(pairs), "".join(pairs.values())


MARKED, PLAIN = _plain_letters()


def fold(text: Column) -> Column:
    """Lower case without marks, so that a plain query matches; the dotted and the dotless i are one letter, and a sharp s is two."""
    one_i = F.translate(text, "\u0131\u0130I", "iii")
    lower = F.replace(F.lower(one_i), F.lit("\u00df"), F.lit("ss"))
    return F.translate(F.regexp_replace(lower, "\\p{M}", ""), MARKED, PLAIN)


def contains_folded(text: Column, query: str) -> Column:
    return F.contains(fold(text), fold(F.lit(query)))


def is_friendly(competition: Column) -> Column:
    """Unknown competitions are not friendlies."""
    return F.coalesce(F.lower(competition).contains("friend"), F.lit(False))


def storage_key(key: Column, name: Column) -> Column:
    """Key and name, with what a path may not hold replaced."""
    return F.concat_ws("-", key.cast("string"), F.regexp_replace(name, "[^A-Za-z0-9_.-]", "_"))


#: Both feet are as good from 16 each and within 3; the weaker one does not count up to 7.
FOOT_GOOD, FOOT_NEAR, FOOT_NONE = 16, 3, 7


def foot(left: Column, right: Column) -> Column:
    """The better foot, "only" if the other does not count, or either; the right one where they tie below that."""
    weaker, side = F.when(left < right, left).otherwise(right), F.when(left > right, "Left").otherwise("Right")
    either = (weaker >= FOOT_GOOD) & (F.abs(left - right) <= FOOT_NEAR)
    return F.when(either, "Either").when((left != right) & (weaker <= FOOT_NONE), F.concat(side, F.lit(" only"))).otherwise(side)


def parse_ratings(text: Column) -> Column:
    """``"DL 18, DC 12"`` as a map; parts of another form are left out."""
    parts = F.filter(F.split(text, "\\s*,\\s*"), lambda x: x.rlike("^[A-Za-z]+ [0-9]+$"))
    return F.map_from_entries(F.transform(parts, lambda x: F.struct(F.split_part(x, F.lit(" "), F.lit(1)), F.split_part(x, F.lit(" "), F.lit(2)).cast("long"))))


def day_of_year(year: Column, day: Column) -> Column:
    """Day 0 is the first of January."""
    return F.date_add(F.make_date(year.cast("int"), F.lit(1), F.lit(1)), day.cast("int"))


def inclusive_days(begin: Column, end: Column) -> Column:
    return (F.datediff(end, begin) + 1).cast("long")


def months_long(days: Column) -> Column:
    return F.greatest(F.lit(1), F.round(days / F.lit(30.0)).cast("long"))


def lines_of(formation: Column) -> Column:
    """``"4-4-2"`` as numbers; null if a part is none."""
    parts = F.split(formation, "-")
    return F.when(F.forall(parts, lambda x: x.rlike("^[0-9]+$")), F.transform(parts, lambda x: x.cast("long")))


def line_of_slot(formation: Column, slot: Column) -> Column:
    """-1 for slot 1; slots from 2 fill the lines in order; null beyond them."""
    sizes = lines_of(formation)
    ends = F.transform(F.sequence(F.lit(1), F.size(sizes)), lambda i: F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(1).cast("long"), lambda a, x: a + x))
    before = F.size(F.filter(ends, lambda e: e < slot)).cast("long")
    return F.when(slot == 1, F.lit(-1).cast("long")).when(before < F.size(sizes), before)


def clean_number(value: Column) -> Column:
    """NaN and infinities are null."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def safe_long(text: Column) -> Column:
    """Digits with an optional sign, otherwise null."""
    return F.when(text.rlike("^[+-]?[0-9]{1,18}$"), text).try_cast("long")


def safe_date(text: Column) -> Column:
    return F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"))
