"""Several values packed in one field: one value per row, with its position.

A multi-pattern automaton finds the known whole values in the text (the kinds of dismissal; the names of the match
in any order of their parts). Dynamic programming then picks, over every delimiter the field may use, the cover of
the text by values with the best score: known values count by their length, values of a plausible shape a little,
others against it. A delimiter inside a known or quoted value is therefore no cut.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crease.sources.tables import table

# Kinds of dismissal, with the spellings that contain a delimiter.
KINDS = (
    "bowled", "caught", "caught and bowled", "caught & bowled", "lbw", "stumped", "run out", "run out (sub)", "hit wicket", "retired hurt",
    "retired out", "retired not out", "obstructing the field", "hit the ball twice", "handled the ball", "timed out",
)
# Delimiters people use, each with the blanks around it.
DELIMITERS = {
    "||": r"\s*\|\|\s*", "|": r"\s*\|\s*", "¦": r"\s*¦\s*", ";": r"\s*;\s*", ",": r"\s*,\s*", "/": r"\s*/\s*", "+": r"\s*\+\s*",
    "&": r"\s*&\s*", "and": r"\s+and\s+", "tab": r"[ ]*\t[ ]*", "line": r"[ ]*\r?\n[ ]*",
}
CUTS = {k: re.compile(v, re.I) for k, v in DELIMITERS.items()}
QUOTED = re.compile(r""""(?:[^"\\]|\\.|"")*"|'(?:[^'\\]|\\.|'')*'""", re.S)
MAYBE_PACKED = r"""[|¦;,/+&\t\n\[]| (?i:and) """
NAME_SHAPE = re.compile(r"""^[\w.'’-]+(?: "[^"]+")?(?: [\w.'’-]+)+$|^(?:[a-z]+ )?[\w'’-]{2,}, ?[A-Z][A-Z. ]{0,4}$""")


def unquoted(value: str) -> str:
    """Trimmed, without enclosing quotes, their escapes undone."""
    value = value.strip()
    if len(value) >= 2 and value[0] == value[-1] and value[0] in "\"'" and QUOTED.fullmatch(value):
        q = value[0]
        return re.sub(r"\\(.)", r"\1", value[1:-1].replace(q + q, q)).strip()
    return value


def name_forms(name: str) -> list[str]:
    """A name as typed and with its last part first, with all or the first of its initials."""
    words = name.split()
    if len(words) < 2:
        return [name]
    out = [name]
    for cut in range(1, len(words)):
        last, first = " ".join(words[cut:]), " ".join(words[:cut])
        out += [f"{last}, {first}", f"{last} {first}", f"{last}, {first[0]}", f"{last} {first[0]}"]
    return out


class Known:
    """The automaton over known whole values, in lower case."""

    def __init__(self, values: Iterable[str]):
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for v in {x.lower() for x in values if x and x.strip()}:
            self.machine.add_word(v, len(v))
        self.any = len(self.machine) > 0
        if self.any:
            self.machine.make_automaton()

    def spans(self, text: str) -> dict[int, list[int]]:
        """Start of each known value in the text -> its ends."""
        out: dict[int, list[int]] = {}
        low = text.lower()
        if self.any and len(low) == len(text):
            for end, n in self.machine.iter(low):
                out.setdefault(end - n + 1, []).append(end + 1)
        return out


def cover(text: str, spans: dict[int, list[int]], cut: re.Pattern | None, names: bool) -> tuple[float, list[str]]:
    """Best cover of the text by values between cuts of one delimiter: (score, values as typed)."""
    n = len(text)
    cuts = {m.start(): m.end() for m in cut.finditer(text) if m.end() > m.start()} if cut else {}
    ends = {n, *cuts}
    best: dict[int, tuple[float, list[str]]] = {0: (0.0, [])}
    last = -1.0, [text]
    starts = sorted({0, *cuts.values()})
    stops = sorted(ends)
    for i in starts:
        if i not in best:
            continue
        score, values = best[i]
        lead = i + (len(text[i:]) - len(text[i:].lstrip()))
        known_ends = set(spans.get(lead, ()))
        quoted = QUOTED.match(text, lead)
        reach: list[tuple[int, float]] = []
        for j in stops:
            if j < i:
                continue
            body = text[lead:j].rstrip() if j >= lead else ""
            stop = lead + len(body)
            if not body:
                gain = -1.0
            elif quoted and quoted.end() == stop:
                gain = 2.0 * (stop - lead)
            elif stop in known_ends:
                gain = 2.0 * (stop - lead)
            elif names and NAME_SHAPE.match(body) and not re.search(r"[|¦;/+&\t\n]| and ", body):
                gain = 1.0 * (stop - lead)
            else:
                gain = -0.5 * (stop - lead) - 2
            reach.append((j, gain))
            if gain < 0 and j > i and body and not any(e > stop for e in known_ends) and not (quoted and quoted.end() > stop) and not (names and "," in text[lead : lead + 40]):
                break
        for j, gain in reach:
            got = score + gain, [*values, text[i:j]]
            if j == n:
                if got[0] > last[0] or last[1] == [text] and last[0] == -1.0:
                    last = got
            else:
                k = cuts[j]
                if k not in best or got[0] > best[k][0]:
                    best[k] = got
    return last


def segments(text: str | None, known: Known, names: bool) -> list[str]:
    """The values of a field in order; an empty one keeps its place as ''. NULL and blank text: none."""
    if text is None or not text.strip():
        return []
    whole = text.strip(" ")
    if whole.startswith("[") and whole.endswith("]"):
        try:
            parts = json.loads(whole)
            return ["" if x is None else str(x).strip() for x in parts]
        except ValueError:
            whole = whole[1:-1]
    spans = known.spans(whole)
    tried = [cover(whole, spans, None, names)]
    tried += [cover(whole, spans, c, names) for c in CUTS.values() if c.search(whole)]
    values = max(tried, key=lambda x: (x[0], -len(x[1])))[1]
    return [unquoted(x) for x in values]


def split_fields(rows: DataFrame, key: str, kinds: str, players: str, names: list[str]) -> DataFrame:
    """(key, field_name, pos, val) of the fields ``kinds`` and ``players`` that hold more than one position.

    ``names``: columns of the row that hold known names, as text or as arrays of text. Rows whose fields hold no
    delimiter are left out before Python sees them. Repeated rows give repeated values; the caller makes them
    distinct.
    """
    arrays = [F.coalesce(F.col(c), F.array().cast("array<string>")) if t.startswith("array") else F.array(c) for c, t in rows.select(*names).dtypes]
    maybe = F.coalesce(F.col(kinds).rlike(MAYBE_PACKED), F.lit(False)) | F.coalesce(F.col(players).rlike(MAYBE_PACKED), F.lit(False))
    rows = rows.where(maybe).select(key, kinds, players, F.array_compact(F.array_distinct(F.concat(*arrays))).alias("names"))
    fields = (kinds, players)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kind_values = Known(KINDS)
        of_names: dict[tuple, Known] = {}
        for b in batches:
            out = []
            for k, kind, player, known in zip(b[key], b[fields[0]], b[fields[1]], b["names"]):
                at = tuple(sorted(known))
                if at not in of_names:
                    if len(of_names) > 2000:
                        of_names.clear()
                    of_names[at] = Known(f for x in at for f in name_forms(" ".join(x.split())))
                for field, value, dictionary, is_name in ((fields[0], kind, kind_values, False), (fields[1], player, of_names[at], True)):
                    parts = segments(value, dictionary, is_name)
                    if len(parts) > 1:
                        out += [(k, field, i, x) for i, x in enumerate(parts, 1) if x]
            yield pd.DataFrame(out, columns=[key, "field_name", "pos", "val"])

    kind_of_key = dict(rows.dtypes)[key]
    return rows.mapInPandas(run, f"{key} {kind_of_key}, field_name string, pos bigint, val string")


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    """Known names are those of the ball and of the match's squads (of copies that differ the greatest, so a run repeats)."""
    d = table(spark, base, "deliveries").select("delivery_key", "match_id", "batter", "non_striker", "dismissal_type", "dismissal_player_out")
    packed = d.where(F.col("dismissal_type").rlike(MAYBE_PACKED) | F.col("dismissal_player_out").rlike(MAYBE_PACKED)).distinct()
    squads = table(spark, base, "matches").select("match_id", F.flatten(F.map_values(F.from_json("players_json", "map<string,array<string>>"))).alias("squad"))
    squads = squads.where("squad is not null").groupBy("match_id").agg(F.max("squad").alias("squad"))
    rows = packed.join(squads, "match_id", "left")
    return split_fields(rows, "delivery_key", "dismissal_type", "dismissal_player_out", ["batter", "non_striker", "squad"]).distinct()


QUERIES = {"p5_found": p5_found}
