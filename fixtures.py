"""Pair, product and scored tables derived from the given star-schema tables.

The same derivations are written as SQL in ``oracle.py``.
"""

from __future__ import annotations

from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from judgelens.constants import SCORED_COLUMNS
from judgelens.functions.hashing import sha_key
from judgelens.operators.features import lexical_features
from judgelens.operators.joins import attach_products_and_seen, scope_pairs, scope_products
from judgelens.operators.splits import assign_splits
from judgelens.plans.prepare import prepare_features
from judgelens.sources import eventlog
from judgelens.sources.staging import stage

LOCALE = "us"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def locale_of(part_key: str) -> Column:
    return F.when(F.col(part_key) % 10 == 9, "es").otherwise("us")


def product_id_of(part_key: str) -> Column:
    return F.concat(F.lit("P"), F.col(part_key).cast("string"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").filter("p_partkey % 53 != 0")
    title = F.concat_ws(" ", "p_name", "p_type", F.col("p_size").cast("string"))
    return part.select(
        locale_of("p_partkey").alias("product_locale"),
        product_id_of("p_partkey").alias("product_id"),
        F.when(F.col("p_partkey") % 31 == 0, " ").otherwise(title).alias("product_title"),
        F.when(F.col("p_partkey") % 7 != 0, F.col("p_brand")).alias("product_brand"),
        F.when(F.col("p_partkey") % 5 != 0, F.col("p_type")).alias("product_color"),
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    part_count = part.agg(F.count("*").alias("n")).scalar()
    query_id = F.col("query_id")
    word = lambda place: F.get(F.split("p_name", " "), F.lit(place))
    anchor = part.select(
        F.col("p_partkey").alias("anchor_key"),
        F.col("p_name").alias("anchor_name"),
        F.col("p_size").cast("string").alias("anchor_size"),
        word(0).alias("anchor_word_0"),
        word(1).alias("anchor_word_1"),
    )
    item = part.select(
        F.col("p_partkey").alias("l_partkey"),
        word(0).alias("item_word_0"),
        word(1).alias("item_word_1"),
        F.monotonically_increasing_id().alias("item_row"),
    )
    repeats_text = (query_id % 50 == 0) & (query_id > 0)
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id")).distinct()
    based = orders.withColumn("base", F.when(repeats_text, query_id - 1).otherwise(query_id))
    plain = F.concat(
        "anchor_name", F.lit(" "), "anchor_size", F.lit(" m"), F.col("base").cast("string")
    )
    spaced = F.concat(
        F.lit("  "), F.upper("anchor_name"), F.lit("  "), "anchor_size",
        F.lit(" M"), F.col("base").cast("string"), F.lit(" "),
    )
    # The text of a query is made once for each order. Line items meet their parts first, so that one shuffle by order serves
    # the grouping and the join of the texts, and the pairs of a query are stored together. A part listed twice counts twice.
    queries = based.withColumn("anchor_key", F.col("base") % part_count).join(anchor, "anchor_key").select(
        "query_id", F.when(query_id % 50 == 0, spaced).otherwise(plain).alias("query"), "anchor_word_0", "anchor_word_1"
    )
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("query_id"), "l_partkey", "l_linenumber", F.ascii("l_returnflag").alias("code")
    )
    judged = (
        lines.filter("query_id IS NOT NULL")
        .join(item, "l_partkey")
        .repartition("query_id")
        .groupBy("query_id", "l_partkey", "item_row", "item_word_0", "item_word_1")
        .agg(F.min("l_linenumber").alias("line"), F.min("code").alias("flag"))
    )
    named = judged.join(queries, "query_id")
    label = (
        F.when(F.col("flag") == ord("N"), "E")
        .when(F.col("item_word_1") == F.col("anchor_word_1"), "S")
        .when(F.col("item_word_0") == F.col("anchor_word_0"), "C")
        .otherwise("I")
    )
    official = F.when(query_id % 101 == 0, F.when(F.col("line") <= 2, "test").otherwise("train")).otherwise(
        F.when(query_id % 5 == 0, "test").otherwise("train")
    )
    return named.select(
        (query_id * 1000000 + F.col("l_partkey")).alias("example_id"),
        "query",
        "query_id",
        product_id_of("l_partkey").alias("product_id"),
        locale_of("l_partkey").alias("product_locale"),
        label.alias("esci_label"),
        F.when(query_id % 20 == 7, 0).otherwise(1).cast("bigint").alias("large_version"),
        official.alias("split"),
    )


def scoped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return scope_pairs(pairs(spark, sf_dir), LOCALE), scope_products(products(spark, sf_dir), LOCALE)


def scoped_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The in-scope tables as stored Parquet, for operators with several passes."""
    in_scope, items = scoped(spark, sf_dir)
    return stage(in_scope, "pairs"), stage(items, "products")


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_splits(scoped_tables(spark, sf_dir)[0], key_hash=sha_key)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature table of the prepare plan, with the portable hash."""
    return prepare_features(*scoped_tables(spark, sf_dir), key_hash=sha_key)


def rule_scored(rows: DataFrame) -> DataFrame:
    """Add a rule score in place of a fitted model, so that SQL can check the metrics."""
    p_e = F.round(0.05 + 0.5 * F.col("query_coverage") + 0.3 * F.col("_h") / 4294967296.0, 6)
    prediction = (
        F.when(F.col("p_e") >= 0.30, "E")
        .when(F.col("token_intersection_count") >= 1, "S")
        .when(F.col("_h") % 3 == 0, "C")
        .otherwise("I")
    )
    return (
        rows.withColumn("_h", sha_key(F.col("example_id")))
        .withColumn("p_e", p_e)
        .withColumn("prediction", prediction)
        .withColumnRenamed("esci_label", "label")
        .drop("_h")
    )


def scored_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every in-scope pair with features and score; products judged in train are seen."""
    in_scope, items = scoped_tables(spark, sf_dir)
    train = assign_splits(in_scope, key_hash=sha_key)
    joined = attach_products_and_seen(in_scope, items, train)
    return rule_scored(lexical_features(joined))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_features(spark, sf_dir).select(*SCORED_COLUMNS)


def tied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored table with one constant score, so that only ids break ties."""
    return scored(spark, sf_dir).withColumn("p_e", F.lit(0.5)).withColumn("prediction", F.lit("E"))


def damaged_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs, with values broken by rule so that every validation rule fires."""
    key = F.col("l_key")
    keep = lambda name, bad: F.when(~bad, F.col(name))
    rows = pairs(spark, sf_dir).withColumn("l_key", F.col("example_id"))
    return rows.select(
        keep("example_id", key % 101 == 1).alias("example_id"),
        F.when(key % 103 == 2, " \t ").otherwise(keep("query", key % 97 == 3)).alias("query"),
        keep("query_id", key % 89 == 4).alias("query_id"),
        keep("product_id", key % 83 == 5).alias("product_id"),
        "product_locale",
        F.when(key % 79 == 6, "X").otherwise(keep("esci_label", key % 73 == 7)).alias("esci_label"),
        F.when(key % 71 == 8, "dev").otherwise(keep("split", key % 67 == 9)).alias("split"),
    )


def damaged_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scored pairs, with values broken by rule so that every rule fires."""
    key = F.col("l_key")
    keep = lambda name, bad: F.when(~bad, F.col(name))
    rows = scored(spark, sf_dir).withColumn("l_key", F.col("example_id"))
    return rows.select(
        F.when(key % 61 == 1, F.expr("l_key div 1000000")).otherwise(keep("example_id", key % 59 == 2)).alias("example_id"),
        keep("query_id", key % 53 == 3).alias("query_id"),
        F.when(key % 79 == 6, "X").otherwise(F.col("label")).alias("label"),
        keep("prediction", key % 73 == 7).alias("prediction"),
        F.when(key % 47 == 4, F.lit("NaN").cast("double"))
        .when(key % 43 == 5, F.col("p_e") + 1)
        .otherwise(keep("p_e", key % 41 == 6))
        .alias("p_e"),
    )


def raw_judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item, before line items of the same order and part are merged."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.select((F.col("l_orderkey") * 1000000 + F.col("l_partkey")).alias("example_id"))


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per part and supplier, so product keys repeat."""
    sold = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    return sold.select(
        locale_of("l_partkey").alias("product_locale"), product_id_of("l_partkey").alias("product_id")
    )


def audit_text() -> str:
    return resources.files("judgelens").joinpath("sql/audits.sql").read_text()


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event-log lines derived from orders (jobs, stages) and line items (tasks).

    Each order priority is one application; its first and last order date are
    its start and end.
    """
    orders = table(spark, sf_dir, "orders").withColumn(
        "app", F.regexp_extract("o_orderpriority", r"^\S+", 0)
    )
    millis = F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01', CAST(o_orderdate AS TIMESTAMP_NTZ))")

    def line(**fields):
        return F.to_json(F.struct(*[value.alias(name) for name, value in fields.items()])).alias("value")

    spans = orders.groupBy("app").agg(F.min(millis).alias("first"), F.max(millis).alias("last"))
    starts = spans.select(
        "app",
        line(
            Event=F.lit(eventlog.APPLICATION_START),
            **{"App ID": F.concat(F.lit("app-"), "app"), "App Name": F.lit("orders"), "Timestamp": F.col("first")},
        ),
    )
    ends = spans.select("app", line(Event=F.lit(eventlog.APPLICATION_END), Timestamp=F.col("last")))
    settings = F.struct(F.lit("local[4]").alias("spark.master"), F.concat("app", F.lit("g")).alias("spark.driver.memory"))
    setup = spans.select(
        "app", line(Event=F.lit(eventlog.ENVIRONMENT_UPDATE), **{"Spark Properties": settings})
    )
    kind = F.when(F.col("o_orderstatus") == "O", eventlog.JOB_START).otherwise(eventlog.STAGE_COMPLETED)
    work = orders.select("app", line(Event=kind, Timestamp=millis))
    read = F.struct(
        F.col("l_partkey").alias("Remote Bytes Read"), F.col("l_suppkey").alias("Local Bytes Read")
    )
    metrics = F.struct(
        F.col("l_linenumber").cast("bigint").alias("Executor Run Time"),
        F.when(F.col("l_linenumber") > 2, read).alias("Shuffle Read Metrics"),
        F.struct(F.col("l_orderkey").alias("Shuffle Bytes Written")).alias("Shuffle Write Metrics"),
    )
    info = F.struct((F.col("l_suppkey") % 5).cast("string").alias("Executor ID"))
    tasks = (
        table(spark, sf_dir, "lineitem")
        .join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "app"), "l_orderkey")
        .select("app", line(Event=F.lit(eventlog.TASK_END), **{"Task Info": info, "Task Metrics": metrics}))
    )
    lines = starts.unionByName(ends).unionByName(setup).unionByName(work).unionByName(tasks)
    return lines
