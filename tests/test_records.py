"""Drifting schemas, nested records and packed fields against brute force on small fixtures and the test tables."""

import json
from collections import defaultdict

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from crease.operators.drift import HEADER_ATTRIBUTE, changes, p3_found, path_values, typed_table
from crease.operators.nested import match_children, p6_found
from crease.operators.packed import KINDS, Known, name_forms, p5_found, segments

from .conftest import DATA


def kind(v):
    return "boolean" if isinstance(v, bool) else "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object" if isinstance(v, dict) else "number"


def test_changes_by_brute_force(spark):
    files = defaultdict(lambda: defaultdict(set))
    for r in pq.read_table(DATA / "auction_file_rows.parquet").to_pylist():
        for k, v in json.loads(r["record_json"]).items():
            files[r["feed_id"], r["season"]][k.strip()] |= set() if v is None else {kind(v)}
    attribute = lambda n: HEADER_ATTRIBUTE.get(" ".join("".join(c if c.isalnum() else " " for c in n.lower()).split()), n)
    want = set()
    for feed in {f for f, _ in files}:
        seasons = sorted(s for f, s in files if f == feed)
        for a, b in zip(seasons, seasons[1:]):
            old, new = files[feed, a], files[feed, b]
            gone, come = sorted(set(old) - set(new)), sorted(set(new) - set(old))
            pairs = [(n, n) for n in old if n in new]
            for g in list(gone):
                for c in list(come):
                    if attribute(g) == attribute(c):
                        gone.remove(g), come.remove(c), pairs.append((g, c))
                        want.add((feed, b, "renamed", g, c))
                        break
            want |= {(feed, b, "removed", g, "") for g in gone} | {(feed, b, "added", "", c) for c in come}
            want |= {(feed, b, "retyped", x, y) for x, y in pairs if old[x] != new[y]}
    assert {tuple(r) for r in p3_found(spark, str(DATA)).collect()} == want


def test_unknown_headers_are_paired_by_their_values(spark):
    rows = [("f", 1, json.dumps({"Role": r})) for r in ("Bowler", "Batter", "Keeper")] + [("f", 2, json.dumps({"Craft": r, "Other": None})) for r in ("Bowler", "Keeper")] + [("f", 2, "not json"), ("f", 2, None), ("f", 2, "[1]")]
    members = path_values(spark.createDataFrame(rows, "feed_id string, season bigint, j string"), ["feed_id", "season"], "j")
    assert {tuple(r) for r in changes(members).collect()} == {("f", 2, "renamed", "Role", "Craft"), ("f", 2, "added", "", "Other")}


def test_renames_need_no_known_names(spark):
    """Names that no list holds, in a foreign tongue: only the values tell which field goes on under which name."""
    old = {"Joueur": "Anil Kale", "Montant": "2,50,00,000", "Poste": "Bowler", "Numero": 17}
    new = {"Spieler": "Kale Ravi", "Betrag": 24000000, "Aufgabe": ["Bowler", "Captain"], "Vermerk": "late entry"}
    rows = [("f", 1, json.dumps(old))] * 2 + [("f", 2, json.dumps(new))] * 2
    members = path_values(spark.createDataFrame(rows, "feed_id string, season bigint, j string"), ["feed_id", "season"], "j")
    assert {tuple(r)[2:] for r in changes(members).collect()} == {
        ("renamed", "Joueur", "Spieler"), ("renamed", "Montant", "Betrag"), ("retyped", "Montant", "Betrag"), ("renamed", "Poste", "Aufgabe"),
        ("retyped", "Poste", "Aufgabe"), ("removed", "Numero", ""), ("added", "", "Vermerk"),
    }


def test_typed_table_reports_failed_casts(spark):
    rows = [("f", 1, 1, json.dumps({"Name": {"first": "A", "last": "B"}, "Final Bid": "2,00,00,000", "Age": "23y", "Is Capped": "maybe"}))]
    out, failed = typed_table(path_values(spark.createDataFrame(rows, "feed_id string, season bigint, row_no bigint, j string"), ["feed_id", "season", "row_no"], "j"), ["feed_id", "season", "row_no"])
    r = out.first()
    assert (r.player, r.price, r.age, r.capped) == ("A B", 2e7, 23, None)
    assert [(x.path, x.value) for x in failed.collect()] == [("Is Capped", "maybe")]


def test_typed_table_keeps_all_content(spark):
    record = {"Name": {"first": "A", "last": "B", "middle": "M"}, "Role": ["Batter", "Captain"], "Price": {"amount": 8500000, "currency": "INR"}, "Team": {"name": "Mitali Royals", "short": "MIT"}, "Age": ["23", "24"], "Lot No": ["7"], "Strike": 131.5, "Buyer": "Mitali Royals", "Gone": None}
    rows = [("f", 1, 1, json.dumps(record)), ("f", 1, 2, json.dumps({"Strike": 99}))]
    keys = ["feed_id", "season", "row_no"]
    out, failed = typed_table(path_values(spark.createDataFrame(rows, "feed_id string, season bigint, row_no bigint, j string"), keys, "j"), keys)
    r, only = out.orderBy("row_no").collect()
    assert (r.player, r.role, r.price, r.price_currency, r.team, r.team_short, r.age, r.lot) == ("A B", "Batter, Captain", 8.5e6, "INR", "Mitali Royals", "MIT", None, 7)
    assert r.parts == {"player.first": "A", "player.last": "B", "player.middle": "M", "price.amount": "8500000", "price.currency": "INR", "team.name": "Mitali Royals", "team.short": "MIT"}
    assert r.others == {"Strike": ["131.5"], "Buyer": ["Mitali Royals"]}
    assert only.others == {"Strike": ["99"]} and only.player is None
    assert [(x.path, x.value) for x in failed.collect()] == [("Age", '["23","24"]')]


def as_list(v):
    return v if isinstance(v, list) else [] if v is None else [v]


def loads(text):
    try:
        v = json.loads(text)
        return json.loads(v) if isinstance(v, str) else v
    except (TypeError, ValueError):
        return None


def test_children_by_brute_force(spark):
    want = set()
    for r in pq.read_table(DATA / "deliveries.parquet").to_pylist():
        k = r["delivery_key"]
        for i, w in enumerate(as_list(loads(r["wickets_json"])), 1):
            want.add(("wicket", k, i, 0, w.get("player_out", ""), w.get("kind", "")))
            for j, f in enumerate(as_list(w.get("fielders")), 1):
                f = {"name": f} if isinstance(f, str) else f
                want.add(("fielder", k, i, j, f.get("name", ""), "substitute" if f.get("substitute") else ""))
        for place in ("match", "role"):
            for i, x in enumerate(as_list((loads(r["replacements_json"]) or {}).get(place)), 1):
                want.add((f"replacement_{place}", k, i, 0, x.get("in", ""), x.get("out", "")))
    for r in pq.read_table(DATA / "matches.parquet").to_pylist():
        k, p = r["match_id"], loads(r["registry_people_json"]) or {}
        people = [(x["name"], x["id"]) for x in p] if isinstance(p, list) else list(p.get("people", p).items())
        want |= {("person", k, 0, 0, n, i) for n, i in people}
        inn = loads(r["innings_metadata_json"]) or []
        for i, x in enumerate(inn.get("innings", []) if isinstance(inn, dict) else inn, 1):
            want.add(("innings", k, i, 0, x.get("team", ""), "super_over" if x.get("super_over") else ""))
            want |= {("powerplay", k, i, j, q["type"], f"{q['from']}-{q['to']}") for j, q in enumerate(x.get("powerplays", []), 1)}
            want |= {("miscounted_over", k, i, int(o), q.get("umpire", ""), str(q.get("balls", ""))) for o, q in x.get("miscounted_overs", {}).items()}
            want |= {("absent_hurt", k, i, j, a, "") for j, a in enumerate(x.get("absent_hurt", []), 1)}
    assert {tuple(r) for r in p6_found(spark, str(DATA)).collect()} == want


def test_damaged_and_absent_texts_give_no_child(spark):
    rows = [("a", '[{"team":"X"},{"te', None), ("b", "", ""), ("c", '"[{\\"team\\":\\"X\\"}]"', "null"), ("d", "[null]", "[1, 2]")]
    df = spark.createDataFrame(rows, "match_id string, innings_metadata_json string, registry_people_json string")
    assert [tuple(r) for r in match_children(df).where("child_kind = 'innings' and label <> ''").collect()] == [("innings", "c", 1, 0, "X", "")]


NAMES = Known(f for n in ("PV Sheshiwing", "MP Khether", "J Jatrathert", "B O'Proyash") for f in name_forms(n))


@pytest.mark.parametrize(
    ("text", "names", "want"),
    [
        ("caught and bowled", False, ["caught and bowled"]), ("caught & bowled", False, ["caught & bowled"]), ("caught and bowled & retired out", False, ["caught and bowled", "retired out"]),
        ("caught and retired hurt", False, ["caught", "retired hurt"]), ('["Stumped", "run out"]', False, ["Stumped", "run out"]), ("'lbw', 'retired hurt'", False, ["lbw", "retired hurt"]), ("run out || retired out", False, ["run out", "retired out"]),
        ("lbw\nrun out", False, ["lbw", "run out"]), ("bowled/run out/retired hurt", False, ["bowled", "run out", "retired hurt"]), ("", False, []), (None, False, []), ("bowled", False, ["bowled"]),
        ("PV Sheshiwing|MP Khether", True, ["PV Sheshiwing", "MP Khether"]), ("Jatrathert, J", True, ["Jatrathert, J"]), ("Jatrathert, J; MP Khether", True, ["Jatrathert, J", "MP Khether"]), (" / MP Khether", True, ["", "MP Khether"]),
        ('"B O\'Proyash", "Nodrod, K"', True, ["B O'Proyash", "Nodrod, K"]), ('"P ""Pree"" Lun", "MP Khether"', True, ['P "Pree" Lun', "MP Khether"]), ('J "Jist" Bolksost and K Bhaavidru', True, ['J "Jist" Bolksost', "K Bhaavidru"]),
        ("RP Jaisheert, DJ Brovjeend", True, ["RP Jaisheert", "DJ Brovjeend"]),
    ],
)
def test_segments(text, names, want):
    assert segments(text, NAMES if names else Known(KINDS), names) == want


def test_long_text_is_cut_in_time():
    assert segments("|".join(["bowled"] * 3000), Known(KINDS), False) == ["bowled"] * 3000


def test_positions_agree_between_the_two_fields(spark):
    g = p5_found(spark, str(DATA)).groupBy("delivery_key").pivot("field_name", ["dismissal_type", "dismissal_player_out"]).agg(F.max("pos"))
    assert g.count() > 0 and g.where("dismissal_type <> dismissal_player_out").count() == 0
