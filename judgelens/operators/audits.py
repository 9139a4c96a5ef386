"""Key, join, metadata and domain audits."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from judgelens.constants import LABELS, OFFICIAL_SPLITS, PRODUCT_KEYS
from judgelens.functions.text import is_blank, normalize_query
from judgelens.operators import splits
from judgelens.plans.parallel import run_all

QUANTILES = {"p50_candidates": 0.5, "p90_candidates": 0.9, "p99_candidates": 0.99}


def label_balance(pairs: DataFrame) -> DataFrame:
    """Pairs, distinct queries and share of the split for each split and label."""
    whole_split = Window.partitionBy("split")
    counts = pairs.groupBy("split", "esci_label").agg(
        F.count("*").alias("pair_count"), F.countDistinct("query_id").alias("query_count")
    )
    share = F.col("pair_count") / F.sum("pair_count").over(whole_split)
    return counts.withColumn("pair_share", share).orderBy("split", "esci_label")


def duplicate_keys(df: DataFrame, keys) -> DataFrame:
    """Key values held by more than one row."""
    return df.groupBy(*keys).agg(F.count("*").alias("row_count")).filter("row_count > 1")


def duplicate_product_keys(products: DataFrame) -> DataFrame:
    found = duplicate_keys(products, PRODUCT_KEYS)
    return found.orderBy(F.desc("row_count"), "product_locale", "product_id")


def join_coverage(pairs: DataFrame, joined: DataFrame) -> DataFrame:
    """Rows before and after the product join, unmatched rows and match rate."""
    before = pairs.agg(F.count("*").alias("n")).scalar()
    return joined.agg(
        F.count("*").alias("joined_pair_count"),
        F.count_if(~F.col("product_matched")).alias("unmatched_pair_count"),
        F.avg(F.col("product_matched").cast("double")).alias("product_match_rate"),
    ).select(before.alias("input_pair_count"), "*")


def metadata_missingness(joined: DataFrame) -> DataFrame:
    """Null-or-blank counts of the four text columns for each official split."""
    names = {
        "missing_query": "query",
        "missing_title": "product_title",
        "missing_brand": "product_brand",
        "missing_color": "product_color",
    }
    counts = [F.count_if(is_blank(column)).alias(name) for name, column in names.items()]
    return joined.groupBy("split").agg(F.count("*").alias("pair_count"), *counts).orderBy("split")


def cross_split_queries(pairs: DataFrame) -> DataFrame:
    """Query ids of a locale that occur in more than one official split."""
    return (
        pairs.groupBy("product_locale", "query_id")
        .agg(F.countDistinct("split").alias("split_count"))
        .filter("split_count > 1")
        .orderBy("product_locale", "query_id")
    )


def candidate_set_sizes(pairs: DataFrame) -> DataFrame:
    """Distribution of the number of judged products per query, by split."""
    sizes = pairs.groupBy("split", "query_id").agg(F.count("*").alias("candidates"))
    quantile = F.percentile_approx("candidates", list(QUANTILES.values()))
    return (
        sizes.groupBy("split")
        .agg(
            F.count("*").alias("query_count"),
            F.min("candidates").alias("minimum_candidates"),
            F.max("candidates").alias("maximum_candidates"),
            quantile.alias("quantiles"),
        )
        .select(
            "split",
            "query_count",
            "minimum_candidates",
            *[F.col("quantiles")[i].alias(name) for i, name in enumerate(QUANTILES)],
            "maximum_candidates",
        )
        .orderBy("split")
    )


def outside(value: str, domain) -> Column:
    """True where a value is null or not in its domain."""
    return ~F.coalesce(F.col(value).isin(*domain), F.lit(False))


def pair_rules() -> dict[str, Column]:
    return {
        "missing_query": F.col("query").isNull(),
        "blank_query": F.col("query").isNotNull() & (normalize_query("query") == ""),
        "missing_query_id": F.col("query_id").isNull(),
        "missing_example_id": F.col("example_id").isNull(),
        "missing_product_id": F.col("product_id").isNull(),
        "missing_label": F.col("esci_label").isNull(),
        "unknown_label": F.col("esci_label").isNotNull() & outside("esci_label", LABELS),
        "missing_split": F.col("split").isNull(),
        "unknown_split": F.col("split").isNotNull() & outside("split", OFFICIAL_SPLITS),
    }


def validate_pairs(pairs: DataFrame) -> DataFrame:
    """Violations of each pair rule, and of any rule, from one scan."""
    rules = pair_rules()
    broken = F.lit(False)
    for rule in rules.values():
        broken = broken | rule
    counts = [F.count_if(rule).alias(name) for name, rule in rules.items()]
    return pairs.agg(F.count("*").alias("pair_count"), *counts, F.count_if(broken).alias("invalid_pairs"))


def validate_products(products: DataFrame) -> DataFrame:
    return products.agg(
        F.count("*").alias("product_count"),
        F.count_if(F.col("product_id").isNull()).alias("missing_product_key"),
    )


def assert_valid(pairs: DataFrame, products: DataFrame, profile: DataFrame | None = None) -> dict[str, int]:
    """Stop on broken rows, duplicate keys or query ids with several texts; returns how many pairs and products there are."""
    profile = splits.query_profile(pairs) if profile is None else profile
    found = run_all(
        pairs.sparkSession,
        {
            "pairs": lambda: validate_pairs(pairs).first().asDict(),
            "listed": lambda: validate_products(products).first().asDict(),
            "products": lambda: duplicate_keys(products, PRODUCT_KEYS).isEmpty(),
            "examples": lambda: duplicate_keys(pairs, ["example_id"]).isEmpty(),
            "texts": lambda: splits.text_conflicts_of(profile).isEmpty(),
        },
    )
    if found["pairs"]["invalid_pairs"]:
        raise ValueError(f"invalid pairs: {found['pairs']}")
    if found["listed"]["missing_product_key"]:
        raise ValueError("a product has no join key")
    if not found["products"]:
        raise ValueError("duplicate product keys: the join would multiply pairs")
    if not found["examples"]:
        raise ValueError("duplicate example ids")
    if not found["texts"]:
        raise ValueError("a query id has several normalised texts")
    return {"n_pairs": found["pairs"]["pair_count"], "n_products": found["listed"]["product_count"]}


def label_domain_check(df: DataFrame, column: str) -> DataFrame:
    """Labels missing from the data or unknown to the study; empty when equal."""
    # One grouping of the data; the expected labels are four rows.
    expected = df.sparkSession.createDataFrame([(label, True) for label in LABELS], "expected string, listed boolean")
    found = df.groupBy(F.col(column).alias("label")).agg(F.count("*").alias("n"))
    both = found.join(F.broadcast(expected), F.col("label").eqNullSafe(F.col("expected")), "full")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("listed").isNull(), "unknown")
    return both.select(F.coalesce("label", "expected").alias("label"), problem.alias("problem")).where("problem IS NOT NULL")


def blank_titles(joined: DataFrame) -> DataFrame:
    return joined.agg(F.count_if(is_blank("product_title")).alias("blank_titles"))


def data_audit(pairs: DataFrame, products: DataFrame, joined: DataFrame, profile: DataFrame) -> DataFrame:
    """One row with every count of the preparation audit.

    A pair is kept unless its query is a leaky train query, so excluded rows
    are counted per query and the split assignment itself is not run.

    Each count is a scalar subquery over its own small aggregate, so nothing
    but single numbers meets in the final row.
    """
    joined_counts = joined.agg(
        F.count("*").alias("joined_rows"),
        F.count_if(~F.col("product_matched")).alias("unmatched_products"),
        F.count_if(is_blank("product_title")).alias("blank_titles"),
    )
    count = lambda df: df.agg(F.count("*").alias("n")).scalar()
    excluded = pairs.filter(F.col("split") == "train").join(
        splits.leaky_ids_of(profile), "query_id", "left_semi"
    )
    return joined_counts.select(
        count(pairs).alias("n_pairs"),
        count(products).alias("n_products"),
        count(duplicate_keys(products, PRODUCT_KEYS)).alias("duplicate_product_keys"),
        count(duplicate_keys(pairs, ["example_id"])).alias("duplicate_example_ids"),
        "joined_rows",
        "unmatched_products",
        "blank_titles",
        count(splits.overlap_ids_of(profile)).alias("overlap_ids"),
        count(splits.overlap_texts_of(profile)).alias("overlap_texts"),
        count(splits.leaky_ids_of(profile)).alias("excluded_query_ids"),
        count(splits.pair_overlap(pairs, profile)).alias("pair_overlap"),
        count(excluded).alias("excluded_rows"),
    )


def observe_join(joined: DataFrame, observation: Observation) -> DataFrame:
    """Count, while they are written, all joined pairs and those left out; ``joined`` marks the latter by a null split."""
    left_out = F.col("dataset_split").isNull()
    return joined.observe(
        observation,
        F.count("*").alias("joined_rows"),
        F.count_if(~F.col("product_matched")).alias("unmatched_products"),
        F.count_if(is_blank("product_title")).alias("blank_titles"),
        F.count_if(left_out).alias("excluded_rows"),
    )


def observed_audit(checked: dict[str, int], observed: dict[str, int], pairs: DataFrame, profile: DataFrame) -> DataFrame:
    """The row of ``data_audit`` after a preparation, without reading its tables again.

    ``checked`` are the counts of ``assert_valid``, which has refused duplicate
    keys; ``observed`` those of the write. The rest comes from the query profile,
    and from the pairs of queries that are in both official splits.
    """
    count = lambda df: df.agg(F.count("*").alias("n")).scalar()
    known = lambda value, name: F.lit(value).cast("bigint").alias(name)
    return pairs.sparkSession.range(0, 1, 1, 1).select(
        known(checked["n_pairs"], "n_pairs"),
        known(checked["n_products"], "n_products"),
        known(0, "duplicate_product_keys"),
        known(0, "duplicate_example_ids"),
        *[known(observed[name], name) for name in ("joined_rows", "unmatched_products", "blank_titles")],
        count(splits.overlap_ids_of(profile)).alias("overlap_ids"),
        count(splits.overlap_texts_of(profile)).alias("overlap_texts"),
        count(splits.leaky_ids_of(profile)).alias("excluded_query_ids"),
        count(splits.pair_overlap(pairs, profile)).alias("pair_overlap"),
        known(observed["excluded_rows"], "excluded_rows"),
    )


# Quoted text, comments, and the semicolon outside of both.
SQL_PART = re.compile(r"""('(?:[^']|'')*'|"(?:[^"]|"")*"|`[^`]*`)|(--[^\n]*|/\*.*?\*/)|(;)""", re.S)


def split_statements(text: str) -> list[str]:
    """Statements of a file: cut at semicolons, comments left out, quoted text left alone."""
    statements, current, at = [], [], 0
    for part in SQL_PART.finditer(text):
        current.append(text[at : part.start()])
        at = part.end()
        quoted, comment, end = part.groups()
        if quoted:
            current.append(quoted)
        elif comment:
            current.append(" ")
        else:
            statements.append("".join(current).strip())
            current = []
    statements.append("".join([*current, text[at:]]).strip())
    return [x for x in statements if x]


def sql_audit_tables(spark: SparkSession, text: str) -> list[DataFrame]:
    """The result of each statement of an audit file, in the order the statement asks for."""
    statements = split_statements(text)
    if not statements:
        raise ValueError("no SQL statement found")
    return [spark.sql(statement) for statement in statements]


def run_sql_audits(spark: SparkSession, text: str) -> DataFrame:
    """All rows of an audit file as one table: JSON with the number of the statement, in no order."""
    results = []
    for number, rows in enumerate(sql_audit_tables(spark, text), start=1):
        as_json = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
        results.append(rows.select(F.lit(number).alias("statement_id"), as_json.alias("row_json")))
    return reduce(DataFrame.unionByName, results)
