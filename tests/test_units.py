import numpy as np
import pytest
from pyspark.sql import functions as F

from crease.operators.units import Settings, convert, noted_scale, parse_amount, predicted, shifted_by_table, shifted_priors

AMOUNTS = [
    ("2,50,00,000", 25_000_000, None, None), ("Rs 30,00,000/-", 3_000_000, None, "INR"), ("₹0.85 Cr", 0.85, 1e7, "INR"), ("2.05cr", 2.05, 1e7, None), ("90 lks", 90, 1e5, None),
    ("2 cr 5 lakh", 20_500_000, 1.0, None), ("1 crore and 10 lakh", 11_000_000, 1.0, None), ("one crore fifty-five lakh only", 15_500_000, 1.0, None), ("Twenty-five lakh only", 25, 1e5, None),
    ("US$ 0.045 mn", 0.045, 1e6, "USD"), ("AUD 585k", 585, 1e3, "AUD"), ("£240,000", 240_000, None, "GBP"), ("3E6", 3e6, None, None), ("40,00,000 (RTM)", 4_000_000, None, None), ("२०,००,०००", 2_000_000, None, None),
    ("Unsold", None, None, None), ("see sheet 2", None, None, None), ("", None, None, None), ("-", None, None, None), (None, None, None, None), ("9" * 300, None, None, None),
]


def test_amounts(spark):
    df = spark.createDataFrame([(i, a[0]) for i, a in enumerate(AMOUNTS)], "i int, t string").select("i", parse_amount(F.col("t")).alias("p")).orderBy("i")
    for r, (text, value, scale, currency) in zip(df.collect(), AMOUNTS):
        if value is None:
            assert r.p is None, text
        else:
            assert (r.p.value, r.p.scale, r.p.currency) == (pytest.approx(value), scale, currency), text


@pytest.mark.parametrize(
    ("note", "rupees", "dollars"),
    [
        ("Money columns carry lakh values unless a unit is written next to them; 2013 dollars in thousands.", 1e5, 1e3), ("Purse totals elsewhere are in crore, these are not.", None, None),
        ("Full rupees throughout; slabs start at 20 lakh.", 1.0, None), ("from lakh slab, shown in Cr", 1e7, None), ("Entered from the paper register (rupee prices ÷ 1,00,000).", 1e5, None),
        ("Sheet keeper writes ten-million-rupee units.", 1e7, None), ("INR mn", 1e6, None), ("captain", None, None), ("Rs", 1.0, None), ("Amounts in INR Cr; 2013 in thousand USD", 1e7, 1e3), (None, None, None),
    ],
)
def test_notes(spark, note, rupees, dollars):
    r = spark.createDataFrame([(note,)], "t string").select(noted_scale(F.col("t")).alias("a"), noted_scale(F.col("t"), dollars=True).alias("b")).first()
    assert (r.a, r.b) == (rupees, dollars)


def test_forest_finds_scales_that_were_hidden(spark):
    """Held-out accuracy: half of the cells lose their note; the forest must find the scale again."""
    cells, truth = [], {}
    for i in range(600):
        amount = 2_000_000 + 500_000 * (i * 37 % 180)
        scale, note = ((1e5, "in lacs"), (1e7, "crore"), (1.0, "in rupees"))[i % 3]
        hidden = i % 2 == 0
        value = amount / scale
        if hidden and scale == 1e5 and value <= 30:
            continue
        truth[i] = amount
        cells.append(("squad_state.price_inr_cr", i, 2020, str(value), None if hidden else note, None, "o"))
    schema = "source_field string, record_id bigint, year bigint, cell string, note string, all_cells array<string>, origin string"
    fx = spark.createDataFrame([], "season bigint, currency string, inr_per_unit double")
    got = {r.record_id: r for r in convert(spark.createDataFrame(cells, schema), fx, Settings(trees=8, depth=5)).collect()}
    assert set(got) == set(truth)
    hits = [abs(got[i].amount_inr - a) < 1 for i, a in truth.items() if not got[i].review]
    assert len(hits) >= 0.9 * len(truth) and sum(hits) >= 0.97 * len(hits)


def test_without_known_scales_all_go_to_review(spark):
    cells = spark.createDataFrame([("auction_lots.price_in_rs", 1, 2020, "7", None, None, "o")], "source_field string, record_id bigint, year bigint, cell string, note string, all_cells array<string>, origin string")
    fx = spark.createDataFrame([], "season bigint, currency string, inr_per_unit double")
    assert [r.review for r in convert(cells, fx).collect()] == [True]


SCHEMA = "source_field string, record_id bigint, year bigint, cell string, note string, all_cells array<string>, origin string"


def test_cells_that_could_be_either_go_to_review(spark):
    """Stated cells say that 10 to 30 is lakh as often as crore; an unstated 20 must then be reviewed, an unstated 250 not."""
    cells = [("f.price", i, 2020, str(10 + i % 20), ("in lakh", "in crore")[i // 20 % 2], None, "o") for i in range(800)]
    cells += [("f.price", 1000 + i, 2020, str(150 + i % 300), "in lakh", None, "o") for i in range(400)]
    cells += [("f.price", 5000 + i, 2020, "20", None, None, "p") for i in range(20)] + [("squad_state.price_inr_cr", 6000 + i, 2020, "250", None, None, "p") for i in range(20)]
    fx = spark.createDataFrame([], "season bigint, currency string, inr_per_unit double")
    got = convert(spark.createDataFrame(cells, SCHEMA), fx, Settings(trees=8, depth=5)).where("basis = 'predicted'").collect()
    assert {r.review for r in got if r.cell == "20"} == {True}
    assert {(r.review, r.amount_inr) for r in got if r.cell == "250"} == {(False, 2.5e7)}


def test_held_out_cells_are_as_often_right_as_is_said(spark):
    cells = [("f.price", i, 2020, str(10 + i % 20), ("in lakh", "in crore")[i // 20 % 4 == 0], None, "o") for i in range(2000)]
    fx = spark.createDataFrame([], "season bigint, currency string, inr_per_unit double")
    _, tested = predicted(spark.createDataFrame(cells, SCHEMA), fx, Settings(trees=8, depth=5))
    c, h, n = tested.agg(F.sum(F.expr("confidence * weight")) / F.sum("weight"), F.sum(F.expr("hit * weight")) / F.sum("weight"), F.count("*")).first()
    assert n > 300 and abs(c - h) < 0.02


def test_shares_of_unstated_cells_are_found_again():
    rng = np.random.default_rng(1)
    truth = rng.choice(2, 4000, p=[0.9, 0.1])
    p = np.where(truth[:, None] == np.arange(2), 0.7, 0.3)  # by a model for which both are as likely
    flip = rng.random(4000) < 0.3
    p[flip] = p[flip][:, ::-1]
    ratio = shifted_priors([(0, x) for x in p], np.array([[0.5, 0.5]]))
    assert abs(0.5 * ratio[0, 0] - 0.9) < 0.08


def test_all_cells_count_none_is_drawn(spark):
    """More stated cells than once were drawn: the held-out quarter is complete."""
    cells = [("f.price", i, 2020, str(10 + i % 20), "in lakh" if i % 3 else "in crore", None, "o") for i in range(22_000)]
    fx = spark.createDataFrame([], "season bigint, currency string, inr_per_unit double")
    rows = spark.createDataFrame(cells, SCHEMA)
    _, tested = predicted(rows, fx, Settings(trees=2, depth=3))
    assert tested.count() == rows.where(F.pmod(F.xxhash64("record_id", F.lit(Settings().seed + 1)), F.lit(4)) == 0).count()


def test_shares_are_the_same_by_rows_and_by_table(spark):
    rng = np.random.default_rng(2)
    seen = [(int(f), [float(x) for x in p], int(n)) for f, p, n in zip(rng.integers(0, 3, 60), rng.random((60, 2)), rng.integers(1, 9, 60))] + [(1, [0.0, 0.0], 4)]
    shares = np.array([[0.5, 0.5], [0.2, 0.8], [0.9, 0.1], [0.6, 0.4]])
    want = shifted_priors([(f, p) for f, p, n in seen for _ in range(n)], shares, rounds=4)
    assert np.allclose(shifted_priors(seen, shares, rounds=4), want) and np.allclose(want[3], 1)
    assert np.allclose(shifted_by_table(spark.createDataFrame(seen, "f int, p array<double>, n bigint"), shares, rounds=4), want)
