"""Freely typed values mapped to the entries of a reference list; values that fit none are reported.

Every canonical name and alias is a pattern of a multi-pattern automaton. Of the mentions embedded in a typed
value the longest that do not overlap are kept, and the longest of these names the entry, unless what remains beside it contradicts (a number or letter that tells two entries apart).
Values without such a mention go to token-set similarity: an entry is a candidate when one of its distinctive words
is within two edits of a typed one (symmetric-delete join), and all its distinctive words must be found again.
Each distinct value is read once, however many rows hold it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crease.llm.names import ACCENTED, PLAIN, edit, near_tokens, words
from crease.sources.tables import bounded_rows, durable, table

# Abbreviations of kinds of grounds, the words for kinds themselves, and what tells similar grounds apart.
ABBREVIATIONS = {
    "std": "stadium", "stdm": "stadium", "stad": "stadium", "stdium": "stadium", "grd": "ground", "gnd": "ground", "grnd": "ground", "rec": "recreation", "recn": "recreation", "gym": "gymkhana",
    "spts": "sports", "sp": "sports", "intl": "international", "int": "international", "assn": "association", "assoc": "association", "acad": "academy", "crkt": "cricket", "ckt": "cricket", "cric": "cricket",
    "cplx": "complex", "pk": "park", "pavn": "pavilion", "centre": "center",
}
KIND_WORDS = ("stadium", "ground", "cricket", "association", "international", "academy", "sports", "complex", "park", "oval", "gymkhana", "recreation", "club", "arena", "maidan", "center", "field")
TELLING = ("i", "ii", "iii", "iv", "v", "vi", "a", "b", "c", "d", "e", "1", "2", "3", "4", "5", "6")
ROMAN = {"1": "i", "2": "ii", "3": "iii", "4": "iv", "5": "v", "6": "vi"}
FILL_WORDS = ("the", "and", "at", "of", "no")
UNKNOWN = "VEN_UNKNOWN"

#: Patterns held by one automaton; a longer list is searched in blocks of this size.
BLOCK = 50_000
MAX_COST, MARGIN = 1.3, 0.15


def place_key(c: Column) -> Column:
    """Lower-case words with abbreviations written out, single blanks, without a leading article."""
    x = F.translate(F.lower(c), ACCENTED, PLAIN)
    x = F.regexp_replace(F.regexp_replace(x, r"['’`]", ""), "&", " and ")
    x = F.regexp_replace(x, r"(?U)[^\w]+|_", " ")
    table_of = F.create_map(*[F.lit(y) for kv in ABBREVIATIONS.items() for y in kv])
    tokens = F.transform(words(x), lambda t: F.coalesce(F.try_element_at(table_of, t), t))
    return F.regexp_replace(F.array_join(tokens, " "), "^the ", "")


def pattern_blocks(entries: DataFrame, block: int) -> Iterator[list]:
    """The distinct entries in lists of at most ``block``; a block that turns out larger is split again, so none is lost."""
    n = entries.count()
    parts = -(-n // block) or 1
    todo = [(parts, i) for i in range(parts)]
    while todo:
        parts, i = todo.pop()
        part = entries if parts == 1 else entries.where(F.pmod(F.xxhash64("name", "entry_id"), F.lit(parts)) == i)
        rows = bounded_rows(part, block)
        if rows is None:
            todo += [(2 * parts, i), (2 * parts, i + parts)]
        else:
            yield rows


def mentions(values: DataFrame, entries: DataFrame, block: int = BLOCK) -> DataFrame:
    """(value, start, n, entry_id): every mention of an entry's name in ``values.value``, at word boundaries.

    entries: distinct (name, entry_id). Up to ``block`` entries are one automaton shipped with the tasks; beyond that
    the list is searched block by block and the mentions are united, so no task ever holds more than a block.
    """
    out = None
    for rows in pattern_blocks(entries, block):
        patterns: dict[str, set[str]] = {}
        for r in rows:
            if r["name"]:
                patterns.setdefault(f" {r['name']} ", set()).add(r["entry_id"])

        def find(batches: Iterator[pd.DataFrame], patterns: dict = patterns) -> Iterator[pd.DataFrame]:
            import ahocorasick

            machine = ahocorasick.Automaton()
            for p, ids in patterns.items():
                machine.add_word(p, (len(p) - 2, sorted(ids)))
            if patterns:
                machine.make_automaton()
            for b in batches:
                got = []
                for v in b["value"]:
                    if patterns:
                        for end, (size, ids) in machine.iter(f" {v} "):
                            got += [(v, end - size - 1, size, x) for x in ids]
                yield pd.DataFrame(got, columns=["value", "start", "n", "entry_id"])

        found = values.select("value").mapInPandas(find, "value string, start int, n int, entry_id string")
        out = found if out is None else out.unionByName(found)
    return out


def chosen_mentions(found: DataFrame) -> DataFrame:
    """(value, c): the mentions of each value that are kept, longest first, none overlapping a longer one.

    Mentions of the same place and length (one name of several entries) are kept together. Ties go to the earlier.
    """
    at = F.struct((-F.col("n")).alias("n"), F.col("start").alias("start"), F.col("entry_id").alias("entry_id"))
    every = found.groupBy("value").agg(F.array_sort(F.collect_set(at)).alias("c"))

    def keep(kept: Column, x: Column) -> Column:
        same = lambda k: (k["start"] == x["start"]) & (k["n"] == x["n"])
        apart = lambda k: (k["start"] >= x["start"] - x["n"]) | (x["start"] >= k["start"] - k["n"])
        return F.when(F.forall(kept, lambda k: same(k) | apart(k)), F.concat(kept, F.array(x))).otherwise(kept)

    none = F.array().cast("array<struct<n:int,start:int,entry_id:string>>")
    return every.select("value", F.aggregate("c", none, keep).alias("c"))


def telling(tokens: list[str]) -> set[str]:
    return {ROMAN.get(t, t) for t in tokens if t in TELLING}


def entry_cost(value: str, name: str, city: str | None) -> float:
    """Token-set cost of a typed value as an entry: 0 when all its words are found, more for edits, lacks and extras.

    Distinctive words must all be found (within two edits); a differing number or letter excludes the entry.
    """
    typed = [t for t in value.split() if t not in FILL_WORDS]
    own = [t for t in name.split() if t not in FILL_WORDS]
    town = (city or "").split()
    kinds = [t for t in own if t in KIND_WORDS]
    marks = telling(own[1:])
    core = [t for i, t in enumerate(own) if t not in KIND_WORDS and not (i and t in TELLING) and t != "dr"]
    if not core or (telling(typed[1:]) != marks and telling(typed) != marks):
        return 99.0
    rest = [t for i, t in enumerate(typed) if not (t in TELLING and (i or t in marks)) and t != "dr"]
    # Words beyond those an entry can explain cost 0.45 each, which many of them cannot make up for.
    spare = sum(1 for t in typed if t not in TELLING and t != "dr") - len(core) - len(town) - len(kinds)
    if spare * 0.45 - 0.05 * len(town) > MAX_COST + MARGIN:
        return 99.0
    cost = 0.0
    for c in core:
        best = min(((edit(t, c), k) for k, t in enumerate(rest)), default=(9, -1))
        if best[0] > (2 if len(c) >= 6 else 1 if len(c) >= 4 else 0):
            return 99.0
        cost += 0.4 * best[0]
        rest.pop(best[1])
    for c in town:
        hit = [k for k, t in enumerate(rest) if edit(t, c) <= (1 if len(c) >= 4 else 0)]
        if hit:
            rest.pop(hit[0])
            cost -= 0.05
    lacking = list(kinds)
    extra = 0.0
    for t in rest:
        near = [k for k, g in enumerate(lacking) if edit(t, g) <= 2 or (len(t) >= 3 and g.startswith(t))]
        if near:
            lacking.pop(near[0])
        elif t in KIND_WORDS:
            extra += 0.7
        else:
            extra += 0.45
    return cost + extra + (0.4 * len(lacking) / len(kinds) if kinds else 0.0)


def map_values(values: DataFrame, entries: DataFrame) -> DataFrame:
    """(value, entry_id, basis) for each distinct key in ``values.value``; entry_id is NULL where nothing fits.

    entries: (entry_id, name, city), canonical names and aliases alike. basis: 'mention', 'similar' or 'none'.
    An empty list leaves every value unmatched; a tie between entries is unmatched. Values of any length are compared.
    """
    values = durable(values.select("value").where("value <> ''").distinct())
    entries = durable(entries.where("name <> '' and entry_id is not null").distinct())
    found = mentions(values, entries.select("name", "entry_id"))
    kept = chosen_mentions(found)
    first = F.get("c", F.lit(0))
    same = F.filter("c", lambda x: x["n"] == first["n"])
    one = F.size(F.array_distinct(F.transform(same, lambda x: x["entry_id"]))) == 1
    # What stands beside the longest mention must not tell another entry from it.
    after = first["start"] - first["n"]
    left = F.concat(F.substring("value", F.lit(1), first["start"]), F.lit(" "), F.substring(F.col("value"), after + 1, F.length("value")))
    marks = F.filter(words(left), lambda t: t.isin(*TELLING) | t.rlike(r"^\d+$"))
    sure = kept.where(one & (F.size(marks) == 0)).select("value", first["entry_id"].alias("entry_id"))
    open_ = values.join(sure, "value", "left_anti")

    skip = (*KIND_WORDS, *FILL_WORDS, *TELLING)
    typed = open_.select("value", F.explode(F.array_distinct(words(F.col("value")))).alias("l")).where(F.length("l") >= 4).where(~F.col("l").isin(*skip))
    cores = entries.select("entry_id", "name", "city", F.explode(F.array_distinct(words(F.col("name")))).alias("r")).where(F.length("r") >= 4).where(~F.col("r").isin(*skip))
    pairs = typed.join(near_tokens(typed, cores), "l").join(cores, "r").select("value", "entry_id", "name", "city").distinct()

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["value", "entry_id"]].assign(cost=[entry_cost(v, n, c) for v, n, c in zip(b["value"], b["name"], b["city"])])

    scored = pairs.mapInPandas(score, "value string, entry_id string, cost double").where(F.col("cost") <= MAX_COST + MARGIN)
    best = scored.groupBy("value", "entry_id").agg(F.min("cost").alias("cost")).groupBy("value").agg(F.array_sort(F.collect_list(F.struct("cost", "entry_id"))).alias("c"))
    one, two = F.get("c", F.lit(0)), F.get("c", F.lit(1))
    similar = best.where((one["cost"] <= MAX_COST) & (two.isNull() | (two["cost"] - one["cost"] >= MARGIN))).select("value", one["entry_id"].alias("entry_id"))
    both = sure.withColumn("basis", F.lit("mention")).unionByName(similar.withColumn("basis", F.lit("similar")))
    return values.join(both, "value", "left").select("value", "entry_id", F.coalesce("basis", F.lit("none")).alias("basis"))


def ground_entries(spark: SparkSession, base: str) -> DataFrame:
    grounds = table(spark, base, "dim_venues").distinct()
    names = grounds.select(F.col("venue_id").alias("entry_id"), place_key(F.col("canonical_venue")).alias("name"), place_key(F.col("city")).alias("city"))
    spellings = table(spark, base, "venue_mapping").distinct().join(grounds.select("venue_id", "city"), "venue_id")
    return names.unionByName(spellings.select(F.col("venue_id").alias("entry_id"), place_key(F.col("raw_venue")).alias("name"), place_key(F.col("city")).alias("city")))


def ground_of_match(spark: SparkSession, base: str) -> DataFrame:
    """match_id, venue, venue_id (VEN_UNKNOWN when none of the list fits) and basis of each match with a venue."""
    rows = table(spark, base, "matches").select("match_id", "venue").where("match_id is not null").distinct()
    rows = rows.where(F.length(F.trim(F.regexp_replace("venue", r"(?U)\s+", " "))) > 0).withColumn("value", place_key(F.col("venue")))
    mapped = map_values(rows, ground_entries(spark, base))
    return rows.join(mapped, "value", "left").select("match_id", "venue", F.coalesce("entry_id", F.lit(UNKNOWN)).alias("venue_id"), F.coalesce("basis", F.lit("none")).alias("basis"))


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    return ground_of_match(spark, base).select("match_id", "venue_id").distinct()


def p4_unlisted(spark: SparkSession, base: str) -> DataFrame:
    unlisted = ground_of_match(spark, base).where(F.col("venue_id") == UNKNOWN)
    return unlisted.groupBy("venue").agg(F.count_distinct("match_id").alias("n_matches"))


QUERIES = {"p4_found": p4_found, "p4_unlisted": p4_unlisted}
