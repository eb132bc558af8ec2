"""Categories: rules as rows, the cascade of layers, learned frequencies, taxes, embeddings (rows C01 to C12, J15, J16, J19, D08, F32 to F37, A18, A19)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlake.functions.money import total
from ledgerlake.operators.steps import best_rules

#: Curated rules as data: (keyword, category, priority, source level). Levels: 1 user, 2 curated, 3 fallback.
RULES = [
    ("streamly", "streaming", 10, 2),
    ("streamly 1", "education", 5, 2),
    ("payroll", "salary", 10, 2),
    ("merchant 1", "groceries", 5, 2),
    ("merchant 2", "shopping", 5, 2),
    ("merchant 21", "travel", 9, 2),
    ("merchant", "other", 1, 3),
    ("pos", "shopping", 1, 3),
]

#: Merchant-code directory: (code, category).
MERCHANT_CODES = [(4899, "streaming"), (5411, "groceries"), (5812, "dining"), (5814, "dining"), (4900, "utilities"), (4111, "travel"), (8211, "education"), (6300, "insurance")]

#: Labels of issuers -> ours.
ISSUER_LABELS = {"interest charged": "interest", "insurance": "insurance", "dining": "dining"}


def rules_frame(spark: SparkSession, rules: list = RULES) -> DataFrame:
    rows = [(i, k, c, p, s) for i, (k, c, p, s) in enumerate(rules)]
    return spark.createDataFrame(rows, "rule_id int, keyword string, rule_category string, priority int, source_level int")


def match_rules(tx: DataFrame, rules: DataFrame) -> DataFrame:
    """transaction_id -> category of the best rule: lowest source level, then longest keyword, then priority, then rule.

    Texts repeat much more than rules do, so distinct texts are matched, each in one pass over all keywords.
    """
    text = F.lower(F.concat_ws(" ", "merchant_name", "description"))
    found = best_rules(tx.select(text.alias("text")).distinct(), rules)
    return tx.select("transaction_id", text.alias("text")).join(found, "text").select("transaction_id", "rule_category")


def cascade(tx: DataFrame, corrections: DataFrame, rules: DataFrame, codes: DataFrame | None = None, merchants: DataFrame | None = None, taxonomy: dict | None = None, nearest: DataFrame | None = None, learned: DataFrame | None = None, fuzzy: DataFrame | None = None) -> DataFrame:
    """The category of the first layer that knows, with the layer and its confidence.

    In order: the user's correction of the merchant (1.0), merchant codes, the issuer's label (.92), the merchant directory, the feed's
    taxonomy (.90), curated rules (.80), the nearest labelled embedding, the nearest known name (.75), the learned model (.75), the importer's
    category (.60), other (.10). codes, merchants, nearest and fuzzy are (transaction_id, category, confidence), learned (transaction_id, predicted), each with
    one row a transaction at most; taxonomy maps the importer's own primary categories. Layers that are not given are passed over.
    """
    own = corrections.select(F.col("user_id"), F.lower("merchant_name").alias("m"), F.col("category").alias("own"))
    labels = F.create_map(*[F.lit(x) for kv in ISSUER_LABELS.items() for x in kv])
    j = tx.withColumn("m", F.lower("merchant_name")).join(own, ["user_id", "m"], "left").join(match_rules(tx, rules), "transaction_id", "left")
    layer = lambda c, name, sure: F.when(c.isNotNull(), F.struct(c.alias("category"), F.lit(name).alias("layer"), sure.cast("double").alias("confidence")))

    def found(frame: DataFrame | None, name: str) -> Column:
        nonlocal j
        if frame is None:
            return F.lit(None).cast("struct<category:string,layer:string,confidence:double>")
        j = j.join(frame.select("transaction_id", F.struct("category", F.lit(name).alias("layer"), F.col("confidence").cast("double").alias("confidence")).alias(name)), "transaction_id", "left")
        return F.col(name)

    by_code, by_merchant, by_vector, by_name = found(codes, "MCC"), found(merchants, "MERCHANT_DB"), found(nearest, "EMBEDDING"), found(fuzzy, "ML_FUZZY")
    by_model = found(None if learned is None else learned.select("transaction_id", F.col("predicted").alias("category"), F.lit(0.75).alias("confidence")), "ML")
    by_feed = F.create_map(*[F.lit(x) for kv in (taxonomy or {"": ""}).items() for x in kv])[F.coalesce("importer_category_primary", F.lit("\0"))] if "importer_category_primary" in tx.columns else F.lit(None).cast("string")
    issuer = labels[F.coalesce(F.lower("category_detailed"), F.lit(""))]
    first = F.coalesce(
        layer(F.col("own"), "USER", F.lit(1.0)),
        by_code,
        layer(issuer, "ISSUER", F.lit(0.92)),
        by_merchant,
        layer(by_feed, "TAXONOMY", F.lit(0.90)),
        layer(F.col("rule_category"), "RULE", F.lit(0.80)),
        by_vector,
        by_name,
        by_model,
        layer(F.col("category_primary"), "IMPORT", F.lit(0.60)),
        layer(F.lit("other"), "DEFAULT", F.lit(0.10)),
    )
    return j.select("transaction_id", "user_id", first.alias("c")).select("transaction_id", "user_id", "c.*")


def review_queue(decided: DataFrame, least: float = 0.5) -> DataFrame:
    """Rows that no layer knew well enough."""
    return decided.where(F.col("confidence") < least).select("transaction_id", "user_id")


def account_aliases(tx: DataFrame, aliases: list[tuple[str, str]]) -> DataFrame:
    """Merchants under their canonical key: the first alias of which the name begins with it."""
    table = tx.sparkSession.createDataFrame([(i, a, k) for i, (a, k) in enumerate(aliases)], "place int, alias string, canonical string")
    names = tx.where("merchant_name IS NOT NULL").select(F.lower("merchant_name").alias("name")).distinct()
    found = names.join(F.broadcast(table), F.expr("startswith(name, alias)")).groupBy("name").agg(F.min_by("canonical", "place").alias("canonical"))
    return names.join(found, "name", "left").select("name", F.coalesce("canonical", "name").alias("canonical"))


def learn_frequencies(tx: DataFrame) -> DataFrame:
    """P(category given feature) for merchants, words, amount ranges and import sources."""
    counts = _features(tx.where("category_primary IS NOT NULL"), "category_primary").groupBy("feature", "category_primary").agg(F.count("*").alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("feature"))).select("feature", "category_primary", "p")


#: Words of a description that are no features.
STOP_WORDS = ("the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by")


def _features(tx: DataFrame, column: str) -> DataFrame:
    """column, feature: a row each. m: the merchant, a: the amount's range, s: the import source, k: each description word of three letters or more."""
    amount = F.abs("amount")
    size = F.when(amount < 10, "tiny").when(amount < 50, "small").when(amount < 200, "medium").when(amount < 1000, "large").otherwise("huge")
    plain = F.array(F.concat(F.lit("m:"), F.lower("merchant_name")), F.concat(F.lit("a:"), size), F.concat(F.lit("s:"), F.coalesce("import_source", F.lit("none"))))
    words = F.split(F.lower(F.coalesce("description", F.lit(""))), r"\s+")
    # Told apart by place and filtered as rows: functions on array elements are not compiled, nor is what they are given.
    each = tx.select(column, F.posexplode(F.concat(plain, words)).alias("place", "value"))
    word = F.when((F.length("value") >= 3) & ~F.col("value").isin(*STOP_WORDS), F.concat(F.lit("k:"), "value"))
    return each.select(column, F.when(F.col("place") < 3, F.col("value")).otherwise(word).alias("feature")).where("feature IS NOT NULL")


#: What each kind of feature weighs.
FEATURE_WEIGHTS = {"m:": 0.4, "k:": 0.3, "a:": 0.15, "s:": 0.15}
#: A model of so many rows and categories at most goes to every task with a column a category.
MODEL_ROWS, MODEL_CATEGORIES = 100_000, 50


def score_frequencies(tx: DataFrame, model: DataFrame) -> DataFrame:
    """The category with the largest weighted sum of probabilities; ties by name.

    A model within the limits is fetched and broadcast, a row a feature, so a transaction meets one row a feature and is summed in place; a larger one is joined
    by feature, a row a feature and category.
    """
    rows = model.select("feature", "category_primary", "p").limit(MODEL_ROWS + 1).collect()
    categories = sorted({r.category_primary for r in rows})
    if len(rows) <= MODEL_ROWS and 0 < len(categories) <= MODEL_CATEGORIES:
        return _score_by_columns(tx, rows, categories)
    each = _features(tx, "transaction_id").join(model, "feature").groupBy("transaction_id", "category_primary").agg(F.round(F.sum(_weight() * F.col("p")), 9).alias("score"))
    best = F.min_by("category_primary", F.struct(-F.col("score"), "category_primary"))
    return each.groupBy("transaction_id").agg(best.alias("predicted"), F.max("score").alias("score"))


def _weight() -> Column:
    w = F.lit(0.0)
    for prefix, x in FEATURE_WEIGHTS.items():
        w = F.when(F.col("feature").startswith(prefix), x).otherwise(w)
    return w


def _score_by_columns(tx: DataFrame, rows: list, categories: list[str]) -> DataFrame:
    """score_frequencies by a fetched model: p0, p1, ... are the probabilities of the categories in order of their names, null where a feature lacks one."""
    place = {c: i for i, c in enumerate(categories)}
    wide: dict[str, list] = {}
    for r in rows:
        wide.setdefault(r.feature, [None] * len(categories))[place[r.category_primary]] = r.p
    schema = ", ".join(["feature string", *(f"p{i} double" for i in place.values())])
    table = tx.sparkSession.createDataFrame([(f, *p) for f, p in wide.items()], schema)
    table = table.select("feature", *[(_weight() * F.col(f"p{i}")).alias(f"p{i}") for i in place.values()])
    sums = _features(tx, "transaction_id").join(F.broadcast(table), "feature").groupBy("transaction_id").agg(*[F.sum(f"p{i}").alias(f"p{i}") for i in place.values()])
    none = F.lit(None).cast("struct<score:double,place:int,predicted:string>")
    scored = [F.when(F.col(f"p{i}").isNotNull(), F.struct(F.round(f"p{i}", 9).alias("score"), F.lit(-i).alias("place"), F.lit(c).alias("predicted"))) for c, i in place.items()]
    return sums.select("transaction_id", F.array_max(F.array(none, *scored)).alias("best")).select("transaction_id", "best.predicted", "best.score")


#: Tax classes in order, the columns that are searched (lower case), and the parts of which one must occur.
TAX_PHRASES = [
    ("SALARY", ("description",), ("payroll", "salary", "paycheck", "wages")),
    ("RSU", ("category_primary", "description", "merchant_name"), ("rsu", "restricted stock", "stock vest", "equity vest")),
    ("ACH", ("description",), ("ach", "direct deposit", "electronic transfer")),
    ("INTEREST", ("description",), ("interest",)),
    ("DIVIDEND", ("description",), ("dividend",)),
    ("CHARITY", ("description", "category_primary"), ("donation", "charity", "charitable", "gofundme", "red cross", "tithe")),
    ("DMV", ("description", "merchant_name"), ("dmv", "vehicle registration", "license renewal", "driver license")),
    ("CPA", ("description", "merchant_name"), ("cpa", "tax preparer", "tax preparation", "h&r block", "turbotax")),
    ("TUITION", ("description", "merchant_name", "category_primary"), ("tuition", "university", "school fee", "education")),
    ("PROPERTY_TAX", ("description", "merchant_name"), ("property tax", "real estate tax", "tax assessor")),
    ("STATE_TAX", ("description", "merchant_name"), ("state tax", "state income tax", "franchise tax board", "ftb")),
    ("LOCAL_TAX", ("description", "merchant_name"), ("city tax", "county tax", "local tax", "municipal tax")),
    ("MEDICAL", ("description",), ("medical",)),
    ("CAPITAL", ("description",), ("stock sale", "capital gain")),
]
#: Classes that one value of category_primary decides too.
TAX_CATEGORIES = {"INTEREST": "interest", "DIVIDEND": "dividend", "MEDICAL": "healthcare", "CAPITAL": "investment"}
#: Classes whose totals are positive expenses, and those with totals as they are; other classes are only counted.
DEDUCTIONS = ("CHARITY", "DMV", "CPA", "TUITION", "PROPERTY_TAX", "STATE_TAX", "LOCAL_TAX", "MORTGAGE_INTEREST", "MEDICAL")
INCOMES = ("SALARY", "INTEREST", "DIVIDEND", "RSU", "CAPITAL_GAIN", "CAPITAL_LOSS")


def tax_class() -> Column:
    """The first class that a row meets: salary and stock grants only for incomes, mortgage interest before interest; else OTHER."""
    low = {c: F.lower(F.coalesce(c, F.lit(""))) for c in ("description", "merchant_name", "category_primary", "payment_channel")}
    income = F.coalesce(F.col("amount") > 0, F.lit(False))
    out = F.when(F.lit(False), "OTHER")
    for name, columns, parts in TAX_PHRASES:
        # Parts hold no regular expression characters but the & of a name.
        found = F.concat_ws(" ", *[low[c] for c in columns]).rlike("|".join(parts))
        if name in TAX_CATEGORIES:
            found = found | (low["category_primary"] == TAX_CATEGORIES[name])
        if name in ("SALARY", "RSU"):
            found = found & income
        if name == "ACH":
            out = out.when(found | low["payment_channel"].contains("ach"), F.when(income, "ACH_INCOME").otherwise("ACH_EXPENSE"))
        elif name == "CAPITAL":
            out = out.when(found, F.when(income, "CAPITAL_GAIN").otherwise("CAPITAL_LOSS"))
        else:
            if name == "INTEREST":
                out = out.when(low["description"].contains("mortgage") & low["description"].contains("interest"), "MORTGAGE_INTEREST")
            out = out.when(found, name)
    return out.otherwise("OTHER")


def tax_summary(tx: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """Sums by user, year and class, and of all these years together (year null). Classes without a place in the summary have no total."""
    rows = tx.withColumn("year", F.year("transaction_date")).where(F.col("year").between(first_year, last_year)).withColumn("tax_class", tax_class())
    value = F.when(F.col("tax_class").isin(*DEDUCTIONS), F.abs("amount")).when(F.col("tax_class").isin(*INCOMES), F.col("amount"))
    by_year = rows.groupBy("user_id", "year", "tax_class").agg(F.sum(value).cast("decimal(19,2)").alias("total"), F.count("*").alias("n"))
    all_years = by_year.groupBy("user_id", "tax_class").agg(F.sum("total").cast("decimal(19,2)").alias("total"), F.sum("n").alias("n")).withColumn("year", F.lit(None).cast("int"))
    return by_year.unionByName(all_years)


#: Parts of merchants' names, and how far a subscription to them is deductible; the first list that holds counts.
DEDUCTIBLE_HINTS = {
    "FULL": ("adobe", "microsoft 365", "office 365", "notion", "figma", "jetbrains", "github", "linkedin", "linkedin premium", "quickbooks", "freshbooks", "wave", "calendly", "zoom", "slack", "dropbox business", "google workspace", "1password", "lastpass", "expensify", "shopify", "stripe", "mailchimp", "intercom"),
    "NONE": ("netflix", "hulu", "disney", "hbo", "max", "paramount", "peacock", "apple tv", "spotify", "apple music", "tidal", "youtube music", "amazon music", "audible", "peloton", "apple fitness", "strava", "playstation plus", "xbox game pass", "nintendo switch online"),
    "PARTIAL": ("phone", "internet", "verizon", "att", "comcast", "xfinity", "icloud", "google drive", "google one", "onedrive", "dropbox"),
}


def deductibility(merchant: Column) -> Column:
    """FULL, NONE or PARTIAL by parts of the merchant's name, in that order; else UNKNOWN."""
    out = F.when(merchant.isNull(), "UNKNOWN")
    for name, parts in DEDUCTIBLE_HINTS.items():
        out = out.when(F.lower(merchant).rlike("|".join(parts)), name)
    return out.otherwise("UNKNOWN")


#: Vectors of a tile's sides: a task multiplies at most so many with so many.
TILE_QUERIES, TILE_VECTORS = 1024, 4096


def _unit(rows: pd.DataFrame) -> np.ndarray:
    x = np.array(rows.embedding.tolist(), np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _tile_best(group: pd.DataFrame) -> pd.DataFrame:
    """For each query of a tile the most similar other vector of the tile (of equal ones the least id)."""
    ask, have = group[group.is_query], group[~group.is_query].sort_values("vec_id")
    if not len(ask) or not len(have):
        return pd.DataFrame({"vec_id": [], "nearest": [], "similarity": []})
    s = _unit(ask) @ _unit(have).T
    s[ask.vec_id.to_numpy()[:, None] == have.vec_id.to_numpy()[None, :]] = -2  # not itself
    k = s.argmax(axis=1)
    best = s[np.arange(len(ask)), k]
    return pd.DataFrame({"vec_id": ask.vec_id.to_numpy(), "nearest": have.vec_id.to_numpy()[k], "similarity": best})[best > -2]


def _nearest(queries: DataFrame, vectors: DataFrame, group: Column, counts: DataFrame) -> DataFrame:
    """vec_id, nearest, similarity of each query among the vectors of its group. counts: of, n_queries, n_vectors of each group.

    Both sides fall into blocks of bounded size, by their counts, and each pair of blocks is a task's matrix product.
    """
    blocks = counts.select("of", F.ceil(F.col("n_queries") / TILE_QUERIES).cast("int").alias("q"), F.ceil(F.col("n_vectors") / TILE_VECTORS).cast("int").alias("v"))
    ask = queries.select(group.alias("of"), "vec_id", "embedding").join(blocks, "of").select("of", F.pmod(F.xxhash64("vec_id"), "q").cast("int").alias("a"), F.explode(F.sequence(F.lit(0), F.col("v") - 1)).alias("b"), F.lit(True).alias("is_query"), "vec_id", "embedding")
    have = vectors.select(group.alias("of"), "vec_id", "embedding").join(blocks, "of").select("of", F.explode(F.sequence(F.lit(0), F.col("q") - 1)).alias("a"), F.pmod(F.xxhash64("vec_id"), "v").cast("int").alias("b"), F.lit(False).alias("is_query"), "vec_id", "embedding")
    found = ask.unionByName(have).groupBy("of", "a", "b").applyInPandas(_tile_best, "vec_id bigint, nearest bigint, similarity double")
    best = F.min_by(F.struct("nearest", "similarity"), F.struct(-F.col("similarity"), "nearest"))
    return found.groupBy("vec_id").agg(best.alias("best")).select("vec_id", "best.nearest", "best.similarity")


def nearest_reference(vectors: DataFrame, references: DataFrame, least: float = 0.82) -> DataFrame:
    """vec_id -> the most similar reference by cosine (not itself), if it is similar enough. Vectors without an embedding match nothing."""
    vectors, references = (d.where("embedding IS NOT NULL") for d in (vectors, references))
    counts = vectors.agg(F.count("*").alias("n_queries")).crossJoin(references.agg(F.count("*").alias("n_vectors"))).withColumn("of", F.lit(0)).where("n_vectors > 0")
    return _nearest(vectors, references, F.lit(0), counts).where(F.col("similarity") >= least).withColumn("similarity", F.round("similarity", 6))


def unusualness(vectors: DataFrame) -> DataFrame:
    """1 - the largest cosine to another vector of the same label."""
    rows = vectors.where("embedding IS NOT NULL AND label IS NOT NULL")
    counts = rows.groupBy(F.col("label").alias("of")).agg(F.count("*").alias("n_queries"), F.count("*").alias("n_vectors"))
    return _nearest(rows, rows, F.col("label"), counts).select("vec_id", F.round(1 - F.col("similarity"), 6).alias("unusual"))
