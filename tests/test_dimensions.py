"""Candidate searches of the dimensions against brute force."""

import re
from difflib import SequenceMatcher

from crease.operators import dimensions

from .conftest import DATA


def test_similar_grounds_by_brute_force(spark):
    keys = [r.key for r in dimensions.venues(spark, str(DATA)).collect()]
    keys += ["bhingwalk recreation ground", "jobadigalk recreation ground", "", "a" * 30, "a" * 45, "émile park", "emile park", "park emile"]
    keys = sorted(set(keys))
    want = {(a, b, round(s, 3)) for i, a in enumerate(keys) for b in keys[i + 1 :] if 0.8 <= (s := SequenceMatcher(None, a, b).ratio()) < 1}
    got = [tuple(r) for r in dimensions.similar_keys(spark.createDataFrame([(k, k) for k in keys], "venue_id string, key string"), 0.8).select("key_1", "key_2", "similarity").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {("bhingwalk recreation ground", "jobadigalk recreation ground"), ("a" * 30, "a" * 45)} <= {g[:2] for g in got}


def test_fuzzy_candidates_by_brute_force(spark, monkeypatch):
    names = ["Yavgiktai KM", "Khupad Dherbreelk (wk)", "SL Hanggriv", "Émil Bose", "X", "A B", "", "KM Yavgikta"]
    register = [("1", "KM Yavgiktai"), ("2", "Khupad Dherbreelk"), ("3", "SL Haanggriv"), ("4", "E Bose"), ("5", "X"), ("6", "A B"), ("7", "Yavgiktai K")]
    left = spark.createDataFrame([(n,) for n in names], "name string")
    right = spark.createDataFrame(register, "player_id string, player_name string")
    tokens = lambda t: re.findall("[a-z]+", t.lower())
    want = set()
    for n in names:
        heads = {t[0] for t in tokens(n)}
        for i, p in register:
            s = SequenceMatcher(None, n.lower(), p.lower()).ratio()
            if heads & {t[0] for t in tokens(p) if len(t) > 1} and s >= 0.7:
                want.add((n, i, p, round(s, 3)))
    got = [tuple(r) for r in dimensions.near_names(left, right, 0.7).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    monkeypatch.setattr(dimensions, "identity_audit", lambda *_: left.selectExpr("name", "'unmatched' as bucket"))
    monkeypatch.setattr(dimensions, "table", lambda *_: right)
    best = {(r.name, r.player_id) for r in dimensions.fuzzy_candidates(spark, "").collect()}
    assert {("Khupad Dherbreelk (wk)", "2"), ("SL Hanggriv", "3")} <= best == {w[:2] for w in want}
