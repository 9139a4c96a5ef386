"""The 17 lexical match features of a (query, product) pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from judgelens.constants import FEATURES
from judgelens.functions import text as T

INPUT_COLUMNS = ("query", "product_title", "product_brand", "product_color")
# What the features need of a product, besides its texts.
PRODUCT_FORMS = ("_t", "_n_title", "_t_set", "_b_set", "_c_set", "_t_num", "_no_brand", "_no_color")


def require_columns(df: DataFrame, names, what: str) -> None:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"{what}: missing columns {', '.join(sorted(missing))}")


def refuse_columns(df: DataFrame, names, what: str) -> None:
    taken = [name for name in names if name in df.columns]
    if taken:
        raise ValueError(f"{what}: columns already present {', '.join(sorted(taken))}")


def product_forms(df: DataFrame) -> DataFrame:
    """Append the matching forms of the product texts.

    On a product table ahead of its join, each text is normalised once per
    product and not once per pair.
    """
    require_columns(df, INPUT_COLUMNS[1:], "product_forms")
    normal = df.select(
        "*",
        T.normalize_text("product_title").alias("_t"),
        T.normalize_text("product_brand").alias("_b"),
        T.normalize_text("product_color").alias("_c"),
    )
    listed = normal.select("*", T.tokens("_t").alias("_t_list"))
    return listed.select(
        *df.columns,
        "_t",
        F.size("_t_list").alias("_n_title"),
        F.array_distinct("_t_list").alias("_t_set"),
        F.array_distinct(T.tokens("_b")).alias("_b_set"),
        F.array_distinct(T.tokens("_c")).alias("_c_set"),
        T.digit_chunks("_t").alias("_t_num"),
        (F.length("_b") == 0).alias("_no_brand"),
        (F.length("_c") == 0).alias("_no_color"),
    )


def _filled_forms(df: DataFrame) -> DataFrame:
    """Pairs without a product get the forms of missing texts."""
    blank = {"_t": F.lit(""), "_n_title": F.lit(0), "_no_brand": F.lit(True), "_no_color": F.lit(True)}
    empty = F.array().cast("array<string>")
    return df.select(
        *[name for name in df.columns if name not in PRODUCT_FORMS],
        *[F.coalesce(name, blank.get(name, empty)).alias(name) for name in PRODUCT_FORMS],
    )


def lexical_features(df: DataFrame) -> DataFrame:
    """Append the features, as doubles, after all source columns.

    Work is layered (normal form, token arrays, set sizes, features), so that
    each regular expression and each set operation runs once per row. Products
    that were joined with their ``product_forms`` bring their part of it; the
    forms are taken out again.
    """
    require_columns(df, INPUT_COLUMNS, "lexical_features")
    refuse_columns(df, FEATURES, "lexical_features")
    formed = set(PRODUCT_FORMS) <= set(df.columns)
    kept = [name for name in df.columns if not formed or name not in PRODUCT_FORMS]

    normal = (_filled_forms(df) if formed else product_forms(df)).select("*", T.normalize_text("query").alias("_q"))
    listed = normal.select("*", T.tokens("_q").alias("_q_list"), T.digit_chunks("_q").alias("_q_num"))
    sets = listed.select("*", F.array_distinct("_q_list").alias("_q_set"))
    sized = sets.select(
        *kept,
        "_q",
        "_t",
        F.size("_q_list").alias("_n_query"),
        "_n_title",
        F.size("_q_set").alias("_d_query"),
        F.size("_t_set").alias("_d_title"),
        F.size("_b_set").alias("_d_brand"),
        F.size("_c_set").alias("_d_color"),
        F.size("_q_num").alias("_d_num"),
        T.shared_count("_q_set", "_t_set").alias("_qt"),
        T.shared_count("_q_set", "_b_set").alias("_qb"),
        T.shared_count("_q_set", "_c_set").alias("_qc"),
        T.shared_count("_q_num", "_t_num").alias("_num"),
        (F.length("_t") == 0).alias("_no_title"),
        "_no_brand",
        "_no_color",
    )
    c = F.col
    asked = F.length("_q") > 0
    spaced = lambda name: F.concat(F.lit(" "), c(name), F.lit(" "))
    # |A or B| = |A| + |B| - |A and B|, so the union array is never built; a
    # digit chunk is missing from the title when fewer are shared than asked.
    values = {
        "query_token_count": c("_n_query"),
        "title_token_count": c("_n_title"),
        "token_intersection_count": c("_qt"),
        "query_coverage": T.safe_ratio(c("_qt"), c("_d_query")),
        "title_coverage": T.safe_ratio(c("_qt"), c("_d_title")),
        "token_jaccard": T.safe_ratio(c("_qt"), c("_d_query") + c("_d_title") - c("_qt")),
        "exact_title_match": asked & (c("_q") == c("_t")),
        "query_in_title": asked & spaced("_t").contains(spaced("_q")),
        "brand_token_overlap": c("_qb"),
        "brand_match": (c("_d_brand") > 0) & (c("_qb") == c("_d_brand")),
        "color_token_overlap": c("_qc"),
        "color_match": (c("_d_color") > 0) & (c("_qc") == c("_d_color")),
        "query_has_number": c("_d_num") > 0,
        "numeric_mismatch": c("_num") < c("_d_num"),
        "title_missing": c("_no_title"),
        "brand_missing": c("_no_brand"),
        "color_missing": c("_no_color"),
    }
    return sized.select(*kept, *[values[name].cast("double").alias(name) for name in FEATURES])
