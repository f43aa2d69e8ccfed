"""Amounts recorded in different units: parse what is stated, predict what is missing, convert all to rupees.

A cell's text is tokenised and folded into (number, own scale, own currency). A scale that the cell does not
state is taken from its row's or feed's note. Where neither states one, a calibrated random forest predicts it
from magnitude, notation, source, the column, the note's category and neighbouring fields; it is trained on the cells
whose scale is stated, with the statement hidden, and its probabilities are shifted to the shares of scales that the
unstated cells have. Confident predictions are converted, the others are listed for review.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crease.functions.scalars import literal_map
from crease.sources.tables import bounded_rows, durable, table

SCALES = (1.0, 1e3, 1e5, 1e6, 1e7)
#: Unstated cells that the stated shares weigh as much as.
SHARE_CELLS = 50.0
#: Kinds of unstated cells whose shares are summed on the driver; more are summed by tasks, alike.
KINDS = 50_000
#: A longer number is no amount of money.
DIGITS = 30

# Words for scales, currencies and numbers, and words that may stand beside an amount.
SCALE_WORDS = {
    "k": 1e3, "thousand": 1e3,
    "l": 1e5, "lac": 1e5, "lacs": 1e5, "lakh": 1e5, "lakhs": 1e5, "lk": 1e5, "lks": 1e5,
    "m": 1e6, "mn": 1e6, "mln": 1e6, "mio": 1e6, "million": 1e6, "millions": 1e6,
    "c": 1e7, "cr": 1e7, "crs": 1e7, "crore": 1e7, "crores": 1e7, "हजार": 1e3, "लाख": 1e5, "करोड़": 1e7, "करोड़": 1e7,
}
CURRENCY_WORDS = {
    "rs": "INR", "inr": "INR", "₹": "INR", "rupee": "INR", "rupees": "INR", "re": "INR",
    "us": "USD", "usd": "USD", "$": "USD", "dollar": "USD", "dollars": "USD",
    "aud": "AUD", "a": "AUD", "gbp": "GBP", "£": "GBP", "pound": "GBP", "pounds": "GBP", "eur": "EUR", "€": "EUR",
    "रुपये": "INR", "रु": "INR",
}
NUMBER_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16,
    "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50,
    "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
}
BESIDE_WORDS = ("and", "only", "rtm", "i", "approx", "about", "each", "ret", "retained", "rtmd", "net")


@dataclass(frozen=True)
class Settings:
    """low, high: the range of true amounts."""

    low: float = 1e6
    high: float = 3e8
    trees: int = 24
    depth: int = 8
    confident: float = 0.6
    seed: int = 7


def parse_amount(text: Column) -> Column:
    """struct(value, scale, currency) of a typed amount, or NULL if the text states none.

    value is the number before scaling when one scale is named, and the whole sum under scale 1 when several are
    ("2 cr 5 lakh"). scale and currency are NULL where the text names none. A text with any other word
    ("see sheet 2") states no amount, nor does a number of over DIGITS characters.
    """
    digits = F.translate(F.lower(text), "०१२३४५६७८९０１２３４５６７８９", "01234567890123456789")
    plain = F.regexp_replace(digits, r"(?<=\d),(?=\d)", "")
    tokens = F.regexp_extract_all(plain, F.lit(r"\d+(?:\.\d+)?(?:e\+?\d+(?![a-z0-9]))?|[a-z\u0900-\u0965\u0970-\u097f]+|[$₹£€]"), F.lit(0))
    scales, money, words = literal_map(SCALE_WORDS), literal_map(CURRENCY_WORDS), literal_map({k: float(v) for k, v in NUMBER_WORDS.items()})
    none = F.lit(None).cast("double")
    start = F.struct(
        F.lit(0.0).alias("total"), none.alias("now"), none.alias("scale"), F.lit(0).alias("units"),
        F.lit(None).cast("string").alias("currency"), F.lit(False).alias("bad"), none.alias("first"),
    )

    def step(a: Column, t: Column) -> Column:
        number, scale, cur, word = t.rlike(r"^\d"), F.try_element_at(scales, t), F.try_element_at(money, t), F.try_element_at(words, t)
        value = F.when(number, t.try_cast("double")).otherwise(word)
        closes = scale.isNotNull() & a["now"].isNotNull()
        return F.struct(
            F.when(closes, a["total"] + a["now"] * scale).otherwise(a["total"]).alias("total"),
            F.when(value.isNotNull(), F.coalesce(a["now"], F.lit(0.0)) + value).when(t == "hundred", a["now"] * 100).when(closes, none).otherwise(a["now"]).alias("now"),
            F.when(closes, scale).otherwise(a["scale"]).alias("scale"),
            F.when(closes, a["units"] + 1).otherwise(a["units"]).alias("units"),
            F.coalesce(a["currency"], cur).alias("currency"),
            (a["bad"] | (value.isNull() & scale.isNull() & cur.isNull() & ~t.isin(*BESIDE_WORDS, "hundred")) | (number & (a["now"].isNotNull() | (F.length(t) > DIGITS)))).alias("bad"),
            F.when(closes & (a["units"] == 0), a["now"]).otherwise(a["first"]).alias("first"),
        )

    def finish(a: Column) -> Column:
        loose = F.coalesce(a["now"], F.lit(0.0))
        one = (a["units"] == 1) & (loose == 0)
        value = F.when(one, a["first"]).when(a["units"] >= 1, a["total"] + loose).otherwise(a["now"])
        scale = F.when(one, a["scale"]).when(a["units"] >= 1, F.lit(1.0))
        return F.when(~a["bad"] & (value > 0), F.struct(value.alias("value"), scale.alias("scale"), a["currency"].alias("currency")))

    return F.aggregate(tokens, start, step, finish)


def noted_scale(note: Column, dollars: bool = False) -> Column:
    """The scale a free remark gives for rupee amounts (or for dollar amounts), NULL if it gives none.

    Read clause by clause; a clause on bid slabs, on other sheets or with a denial says nothing of the cells.
    """
    clauses = F.split(F.lower(note), r"[;.](?!\d)|, ")

    def read(c: Column) -> Column:
        foreign = c.rlike(r"dollar|usd|\$")
        lakh = c.rlike(r"\bla(kh|c)s?\b|\(l\)|1,00,000|100,000")
        crore = c.rlike(r"\bcr(s|ores?)?\b|ten[- ]million|1,00,00,000")
        million = c.rlike(r"\bm(n|ln|illions?)\b")
        whole = c.rlike(r"\b(full|complete|absolute|whole|actual)\b|\bin rupees\b|^\s*(rs\.?|inr)\s*$")
        thousand = c.rlike(r"\bthousands?\b|\bk\b")
        scale = F.when(crore, 1e7).when(lakh, 1e5).when(million, 1e6).when(thousand, 1e3).when(whole, 1.0)
        of = foreign if dollars else ~foreign
        return F.when(of & ~c.rlike(r"\bslabs?\b|elsewhere|\bnot\b"), scale)

    return F.get(F.filter(F.transform(clauses, read), lambda x: x.isNotNull()), F.lit(0))


def typed_prices(spark: SparkSession, base: str) -> DataFrame:
    """One row for each distinct non-null price cell of the lots and the squads, with its context."""
    lots = table(spark, base, "auction_lots").drop("loaded_at").distinct()
    feeds = table(spark, base, "auction_feeds").select("feed_id", "notes").distinct()
    fields = ["price_in_usd", "price_in_rs", "base_prices_in_rs", "winning_bid_in_rs"]
    pairs = ", ".join(f"'auction_lots.{c}', {c}" for c in fields)
    lots = (
        lots.withColumn("all_cells", F.array(*fields))
        .selectExpr("lot_id as record_id", "feed_id", "auction_year as year", "all_cells", f"stack(4, {pairs}) as (source_field, cell)")
        .where("cell is not null")
        .join(feeds, "feed_id", "left")
        .select("source_field", "record_id", "year", "cell", F.col("notes").alias("note"), "all_cells", F.coalesce("feed_id", F.lit("")).alias("origin"))
    )
    squads = (
        table(spark, base, "squad_state").drop("loaded_at").distinct().where("price_inr_cr is not null")
        .select(
            F.lit("squad_state.price_inr_cr").alias("source_field"), F.col("squad_id").alias("record_id"), F.col("season").alias("year"),
            F.col("price_inr_cr").cast("string").alias("cell"), F.col("price_note").alias("note"), F.lit(None).cast("array<string>").alias("all_cells"),
            F.concat(F.lit("squads "), F.coalesce(F.col("season").cast("string"), F.lit(""))).alias("origin"),
        )
    )
    return lots.unionByName(squads).where("record_id is not null")


FIELD_SCALE = {"squad_state.price_inr_cr": 1e7}
FIELD_CURRENCY = {"auction_lots.price_in_usd": "USD"}
FIELDS = ("auction_lots.price_in_usd", "auction_lots.price_in_rs", "auction_lots.base_prices_in_rs", "auction_lots.winning_bid_in_rs", "squad_state.price_inr_cr")


def in_range(amount: Column, s: Settings) -> Column:
    return F.coalesce(amount.between(s.low * 0.999, s.high * 1.001), F.lit(False))


def with_scales(cells: DataFrame, fx: DataFrame, s: Settings) -> DataFrame:
    """Parsed cells with their rate and the scales that text (``own``), note and column state; ``known`` by text or note."""
    parsed = cells.withColumn("p", parse_amount(F.col("cell"))).where("p is not null")
    field_currency = F.coalesce(F.try_element_at(literal_map(FIELD_CURRENCY), F.col("source_field")), F.lit("INR"))
    parsed = parsed.select(
        "source_field", "record_id", "year", "cell", "origin", F.col("p.value").alias("value"), F.col("p.scale").alias("own"),
        F.coalesce("p.currency", field_currency).alias("currency"), "note", "all_cells",
    )
    rates = fx.select(F.col("season").alias("year"), "currency", "inr_per_unit").distinct()
    parsed = parsed.join(rates, ["year", "currency"], "left").withColumn("rate", F.when(F.col("currency") == "INR", 1.0).otherwise(F.col("inr_per_unit")))
    foreign = F.col("currency") != "INR"
    noted = F.when(foreign, noted_scale(F.col("note"), dollars=True)).otherwise(noted_scale(F.col("note")))
    default = F.coalesce(F.try_element_at(literal_map(FIELD_SCALE), F.col("source_field")), F.lit(1.0))
    amount = lambda scale: F.col("value") * scale * F.col("rate")
    return parsed.withColumns({"noted": noted, "default": default}).withColumn(
        "known", F.when(F.col("own").isNotNull(), F.col("own")).when(in_range(amount(F.col("noted")), s), F.col("noted"))
    )


def stated_amounts(cells: DataFrame, fx: DataFrame, s: Settings) -> DataFrame:
    """Parsed cells with the scale that text or note states (``known``, NULL if none) and the features."""
    parsed = with_scales(cells, fx, s)
    amount = lambda scale: F.col("value") * scale * F.col("rate")
    fits = F.array(*[in_range(amount(F.lit(x)), s) for x in SCALES])
    near = F.aggregate(
        F.filter(F.transform(F.col("all_cells"), lambda x: F.regexp_replace(x, "[^0-9.]", "").try_cast("double")), lambda x: x > 0),
        F.lit(0.0), lambda a, x: F.greatest(a, F.log10(x)),
    )
    parsed = parsed.withColumns({"fits": fits, "magnitude": F.log10("value"), "near": F.coalesce(near, F.lit(0.0))})
    origin = parsed.where("known is null").groupBy("origin", "source_field").agg(F.avg("magnitude").alias("origin_magnitude"))
    return parsed.join(origin, ["origin", "source_field"], "left").drop("all_cells", "inr_per_unit")


def with_features(rows: DataFrame) -> DataFrame:
    """The feature vector: magnitude, notation, source, the column's own unit, category of the note, neighbours."""
    fits = F.col("fits")
    note = F.coalesce(F.col("noted"), F.lit(0.0))
    own_position = F.array_position(F.array(*map(F.lit, SCALES)), F.col("default")).cast("int")
    columns = {
        "f_mag": F.col("magnitude"),
        "f_decimals": F.length(F.regexp_extract("cell", r"\.(\d*)", 1)).cast("double"),
        "f_groups": F.size(F.split("cell", ",")).cast("double") - 1,
        "f_foreign": (F.col("currency") != "INR").cast("double"),
        "f_near": F.col("near") - F.col("magnitude"),
        "f_origin": F.coalesce(F.col("origin_magnitude"), F.lit(-1.0)),
        "f_column": own_position.cast("double"),
        "f_column_fits": F.col("column_fits").cast("double"),
        "f_n_fits": F.size(F.filter(fits, lambda x: x)).cast("double"),
    }
    rows = rows.withColumn("column_fits", F.coalesce(F.element_at(fits, own_position), F.lit(False)))
    columns |= {f"f_field{i}": (F.col("source_field") == x).cast("double") for i, x in enumerate(FIELDS)}
    columns |= {f"f_note{i}": (note == x).cast("double") for i, x in enumerate((0.0, *SCALES))}
    return VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="keep").transform(rows.withColumns(columns)).drop(*columns)


def shifted(shares: np.ndarray, spread: Callable[[np.ndarray], np.ndarray], rounds: int = 30) -> np.ndarray:
    """For each group of cells, the ratio by which the shares of scales among unstated cells differ from the stated ones.

    A group is a source field and whether the column's own unit fits the amount: whoever follows the column leaves the
    unit out, so that there the unstated cells are others than the stated ones.

    shares: scales among the labelled cells, by group. Expectation and maximisation: ``spread`` of the ratio is, by group
    and scale, the sum over all unstated cells of the forest's probabilities times the ratio, made to add up to 1 for each
    cell, and the ratio follows from the sums; the stated shares count as SHARE_CELLS cells, so that few cells in doubt do
    not talk each other into one scale. People state a unit where it is unusual, so the unstated cells have other shares
    than the stated ones.
    """
    ratio = np.ones_like(shares)
    for _ in range(rounds):
        post = spread(ratio)
        ratio = (post + SHARE_CELLS * shares) / (post.sum(1, keepdims=True) + SHARE_CELLS) / shares
    return ratio


def shifted_priors(seen: list, shares: np.ndarray, rounds: int = 30) -> np.ndarray:
    """``shifted`` by rows (group number, probability of each scale by the forest[, number of such cells])."""
    f = np.array([r[0] for r in seen], dtype=int)
    p = np.array([r[1] for r in seen], dtype=float).reshape(-1, shares.shape[1])
    n = np.array([r[2] if len(r) > 2 else 1.0 for r in seen], dtype=float)[:, None]

    def spread(ratio: np.ndarray) -> np.ndarray:
        post, out = p * ratio[f], np.zeros_like(shares)
        total = post.sum(1, keepdims=True)
        np.add.at(out, f, n * np.divide(post, total, out=np.zeros_like(post), where=total > 0))
        return out

    return shifted(shares, spread, rounds)


def shifted_by_table(seen: DataFrame, shares: np.ndarray, rounds: int = 30) -> np.ndarray:
    """``shifted_priors`` by a table (f, p, n): the same sums, each round one aggregate."""

    def spread(ratio: np.ndarray) -> np.ndarray:
        post = F.zip_with("p", by_group(ratio, F.col("f")), lambda x, y: x * y)
        rows = seen.select("f", "n", post.alias("post")).withColumn("total", F.aggregate("post", F.lit(0.0), lambda a, x: a + x)).where("total > 0")
        sums = [F.sum(F.col("n") * F.get("post", F.lit(i)) / F.col("total")) for i in range(shares.shape[1])]
        out = np.zeros_like(shares)
        for r in rows.groupBy("f").agg(*sums).collect():  # a row for each group
            out[r[0]] = r[1:]
        return out

    return shifted(shares, spread, rounds)


def by_group(values: np.ndarray, group: Column) -> Column:
    return F.get(F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in values]), group)


def predicted(cells: DataFrame, fx: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """(every parsed cell with ``class`` and ``confidence`` of its scale; the held-out cells with ``confidence``, ``hit``
    and ``weight``).

    The labels are the scales that cells state themselves or by a note, and what states them is hidden from the
    features. Nothing is labelled by the column's own unit; it is a feature like others.
    """
    stated_rows = durable(stated_amounts(cells, fx, s))
    position = F.array_position(F.array(*map(F.lit, SCALES)), F.col("known")).cast("int")
    hidden = with_features(stated_rows.where(position.isNotNull()).withColumn("noted", F.lit(None).cast("double")))
    labelled = hidden.withColumn("label", (position - 1).cast("double")).select("source_field", "record_id", "features", "label", "fits", "column_fits")
    rows = with_features(stated_rows)
    n = stated_rows.where(position.isNotNull()).count()
    none = rows.withColumns({"class": F.lit(-1), "confidence": F.lit(0.0)})
    if n == 0:
        return none, none.select("confidence", F.lit(0.0).alias("hit"), F.lit(1.0).alias("weight")).where("false")
    held = F.pmod(F.xxhash64("record_id", F.lit(s.seed + 1)), F.lit(4)) == 0
    labelled = durable(labelled.withColumn("held", held))
    forest = RandomForestClassifier(numTrees=s.trees, maxDepth=s.depth, featureSubsetStrategy="0.6", seed=s.seed)
    model = forest.fit(labelled.where("not held") if n >= 40 else labelled)
    k = len(SCALES)
    number = {x: 2 * i for i, x in enumerate(FIELDS)}
    field = F.coalesce(F.try_element_at(literal_map(number), F.col("source_field")), F.lit(2 * len(FIELDS))) + F.col("column_fits").cast("int")
    shares = np.full((2 * len(FIELDS) + 2, k), 1.0)
    for r in labelled.groupBy(field.alias("f"), "label").count().collect():  # fields times scales
        shares[r["f"], int(r["label"])] += r["count"]
    shares /= shares.sum(1, keepdims=True)

    def scored(df: DataFrame, ratio: np.ndarray | None) -> DataFrame:
        raw = vector_to_array(F.col("probability"))
        df = model.transform(df).drop("prediction", "rawPrediction")
        fit = lambda i: F.when(F.get("fits", F.lit(i)), F.get(raw, F.lit(i))).otherwise(F.lit(0.0)) if i < model.numClasses else F.lit(0.0)
        df = df.withColumn("p", F.array(*[fit(i) for i in range(k)])).drop("probability")
        if ratio is not None:
            df = df.withColumn("p", F.zip_with("p", by_group(ratio, field), lambda x, y: x * y))
        total, top = F.aggregate("p", F.lit(0.0), lambda a, x: a + x), F.array_max("p")
        return df.withColumn("top", F.when(total > 0, top / total).otherwise(F.lit(0.0))).withColumn("class", F.array_position("p", top).cast("int") - 1)

    open_rows = rows.where("known is null")
    # All unstated cells, as counts of the cells alike; many kinds of cells stay a table.
    seen = durable(scored(open_rows, None).groupBy(field.alias("f"), "p").agg(F.count("*").alias("n")))
    few = bounded_rows(seen, KINDS)
    ratio = shifted_by_table(seen, shares) if few is None else shifted_priors([tuple(r) for r in few], shares)
    # The held-out cells stand for the unstated ones: each weighs as much more as its scale is more common there.
    by_label = F.get(by_group(ratio, field), F.col("label").cast("int"))
    tested = scored(labelled.where("held") if n >= 40 else labelled, ratio)
    tested = durable(tested.select("top", (F.col("class") == F.col("label")).cast("double").alias("hit"), by_label.alias("weight")))
    out = scored(rows, ratio)
    if tested.limit(1).count() == 0:
        return out.withColumn("confidence", F.col("top")), tested.select(F.col("top").alias("confidence"), "hit", "weight")
    fitted = IsotonicRegression(isotonic=True, labelCol="hit", featuresCol="top", predictionCol="confidence", weightCol="weight").fit(tested)
    return fitted.transform(out), fitted.transform(tested).select("confidence", "hit", "weight")


def convert(cells: DataFrame, fx: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Every cell that states an amount, with ``amount_inr``, ``basis``, ``confidence`` and ``review``.

    Nulls, blanks and texts without an amount give no row; repeated rows are the caller's (they keep their
    multiplicity). Without any row whose scale is known nothing can be learned: the column's own unit is then
    proposed with confidence 0, for review. Amounts outside [low, high] under every scale go to review, and so do
    predictions below ``confident``.
    """
    out, _ = predicted(cells, fx, s)
    guess = F.coalesce(F.get(F.array(*map(F.lit, SCALES)), F.when(F.col("class") >= 0, F.col("class"))), F.col("default"))
    stated = F.col("known").isNotNull()
    amount = F.col("value") * F.coalesce(F.col("known"), guess) * F.col("rate")
    doubtful = ~stated & ((F.col("class") < 0) | (F.col("confidence") < s.confident))
    return out.select(
        "source_field", "record_id", "cell", amount.alias("amount_inr"),
        F.when(F.col("own").isNotNull(), "cell").when(stated, "note").otherwise("predicted").alias("basis"),
        F.when(stated, F.lit(1.0)).otherwise(F.col("confidence")).alias("confidence"),
        F.coalesce(~in_range(amount, s) | doubtful, F.lit(True)).alias("review"),
    )


def calibration(spark: SparkSession, base: str) -> DataFrame:
    """Held-out cells by tenth of confidence: their number, and weighted as the unstated cells are, the mean confidence, the
    share of right scales and the gap between the two."""
    _, tested = predicted(typed_prices(spark, base), table(spark, base, "fx_rates"), Settings())
    tenth = F.least(F.floor(F.col("confidence") * 10), F.lit(9)).cast("int")
    g = tested.groupBy(tenth.alias("tenth")).agg(
        F.count("*").alias("n_cells"), (F.sum(F.col("confidence") * F.col("weight")) / F.sum("weight")).alias("c"), (F.sum(F.col("hit") * F.col("weight")) / F.sum("weight")).alias("h")
    )
    return g.select("tenth", "n_cells", F.round("c", 4).alias("confidence"), F.round("h", 4).alias("accuracy"), F.round(F.abs(F.col("c") - F.col("h")), 4).alias("gap"))


def read_amounts(cells: DataFrame, fx: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(source_field, record_id, amount_inr) of the cells whose stated unit, or else the column's own, fits the range.

    No model is asked: this is for callers that compare amounts and can do without the cells in doubt.
    """
    rows = with_scales(cells, fx, s)
    amount = F.col("value") * F.coalesce("known", "default") * F.col("rate")
    return rows.where(in_range(amount, s)).select("source_field", "record_id", amount.alias("amount_inr"))


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    out = convert(typed_prices(spark, base), table(spark, base, "fx_rates"))
    return out.where("not review").select("source_field", "record_id", F.round("amount_inr").cast("bigint").alias("amount_inr")).distinct()


def p1_review(spark: SparkSession, base: str) -> DataFrame:
    out = convert(typed_prices(spark, base), table(spark, base, "fx_rates"))
    return out.where("review").select("source_field", "record_id", "cell", F.round("amount_inr").cast("bigint").alias("proposed_inr"), F.round("confidence", 6).alias("confidence")).distinct()


QUERIES = {"p1_found": p1_found, "p1_review": p1_review, "p1_calibration": calibration}
