"""Column functions shared by the operators: text keys, guarded ratios, seasons, roles, money."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Role spellings and their canonical role.
ROLE_NAMES = {
    "batsman": "Batter", "batter": "Batter", "bat": "Batter",
    "bowler": "Bowler", "bowl": "Bowler",
    "all rounder": "All-Rounder", "all-rounder": "All-Rounder", "allrounder": "All-Rounder", "ar": "All-Rounder",
    "wicket keeper": "Wicket-Keeper", "wicket-keeper": "Wicket-Keeper", "wicketkeeper": "Wicket-Keeper", "wk": "Wicket-Keeper",
}
# Kinds of dismissal that are not credited to the bowler.
UNCREDITED_KINDS = ("run out", "retired hurt", "retired out", "retired not out", "obstructing the field")
# Kinds after which the batter is not out.
CENSORED_KINDS = ("retired hurt", "retired not out")


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def blank_to_null(c: Column) -> Column:
    """Trimmed text; NULL when nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def single_spaced(c: Column) -> Column:
    """Trimmed, with every run of blanks reduced to one."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def name_key(c: Column) -> Column:
    """Lower case, without punctuation, single blanks (Unicode word characters are kept)."""
    return single_spaced(F.regexp_replace(F.lower(F.trim(c)), r"(?U)[^\w\s]", ""))


def compact_key(c: Column) -> Column:
    """Lower case ASCII letters and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def name_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))


def initials_key(c: Column) -> Column:
    """First letters of all tokens but the last, then the last token; NULL without two tokens."""
    t = name_tokens(c)
    heads = F.array_join(F.transform(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))), lambda x: F.substring(x, 1, 1)), "")
    return F.when(F.size(t) >= 2, F.concat_ws(":", heads, F.element_at(t, -1)))


def surname_initial(c: Column) -> Column:
    """``surname:first letter``; NULL without two tokens."""
    t = name_tokens(c)
    return F.when(F.size(t) >= 2, F.concat_ws(":", F.element_at(t, -1), F.substring(F.element_at(t, 1), 1, 1)))


def venue_key(c: Column) -> Column:
    """Lower case; & becomes and, a hyphen, dot or comma a blank; single blanks."""
    return single_spaced(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(c), "&", " and "), "-", " "), "[.,]", " "))


def strip_suffix_key(key: Column, city_key: Column) -> Column:
    """``key`` without ``city_key`` at its end, where something remains before it."""
    rest = F.trim(F.substring(key, F.lit(1), F.greatest(F.length(key) - F.length(city_key), F.lit(0))))
    return F.when((F.length(city_key) > 0) & F.endswith(key, F.concat(F.lit(" "), city_key)) & (F.length(rest) > 0), rest).otherwise(key)


def role_name(c: Column, unknown: Column | None = None) -> Column:
    """Canonical role of a typed one; others become ``unknown`` (default: the text 'Unknown')."""
    found = F.try_element_at(literal_map(ROLE_NAMES), F.lower(F.trim(c)))
    return F.coalesce(found, F.lit("Unknown") if unknown is None else unknown)


def safe_div(num: Column, den: Column, default: float | None = 0.0) -> Column:
    """num / den where den > 0, else ``default`` (None gives NULL)."""
    return F.when(den > 0, num / den).otherwise(F.lit(default).cast("double"))


def money(c: Column) -> Column:
    """The digits and dots of a text as a number; NULL when there are none."""
    return F.nullif(F.regexp_replace(c, "[^0-9.]", ""), F.lit("")).try_cast("double")


def season_years(c: Column) -> tuple[Column, Column]:
    """(start, end) year of a season text: 2023/24, 2023-24, 2023/2024 or a text with a single year."""
    short, full = r"^(\d{4})[/-](\d{2})$", r"^(\d{4})[/-](\d{4})$"
    t = F.trim(c)
    one = F.regexp_extract(t, r"((?:19|20)\d{2})", 1)
    start = F.when(t.rlike(short), F.regexp_extract(t, short, 1)).when(t.rlike(full), F.regexp_extract(t, full, 1)).otherwise(one)
    end = (
        F.when(t.rlike(short), F.concat(F.substring(t, 1, 2), F.regexp_extract(t, short, 2)))
        .when(t.rlike(full), F.regexp_extract(t, full, 2))
        .otherwise(one)
    )
    return F.nullif(start, F.lit("")).try_cast("int"), F.nullif(end, F.lit("")).try_cast("int")


def credited(kinds: Column) -> Column:
    """Whether any kind in a |-separated list is credited to the bowler; NULL and blank are not."""
    parts = F.filter(F.transform(F.split(kinds, r"\|"), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    return F.coalesce(F.exists(parts, lambda x: ~x.isin(*UNCREDITED_KINDS)), F.lit(False))
