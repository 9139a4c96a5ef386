"""Product and train-membership joins of judged pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from judgelens.constants import PRODUCT_KEYS
from judgelens.operators.features import refuse_columns


def scope_pairs(pairs: DataFrame, locale: str) -> DataFrame:
    return pairs.filter((F.col("product_locale") == locale) & (F.col("large_version") == 1))


def scope_products(products: DataFrame, locale: str) -> DataFrame:
    return products.filter(F.col("product_locale") == locale)


def attach_products(pairs: DataFrame, products: DataFrame) -> DataFrame:
    """Row-preserving left join; ``product_matched`` tells a failed join from a null title."""
    marked = products.withColumn("product_matched", F.lit(True))
    return pairs.join(marked, list(PRODUCT_KEYS), "left").fillna({"product_matched": False})


def train_product_keys(assigned: DataFrame) -> DataFrame:
    train = assigned.filter(F.col("dataset_split") == "train")
    return train.select(*PRODUCT_KEYS).dropna().distinct()


def with_seen_flag(assigned: DataFrame) -> DataFrame:
    """Add ``product_seen_train``: the product is judged in the train split."""
    refuse_columns(assigned, ["product_seen_train"], "with_seen_flag")
    seen = train_product_keys(assigned).withColumn("product_seen_train", F.lit(True))
    return assigned.join(seen, list(PRODUCT_KEYS), "left").fillna({"product_seen_train": False})


def attach_products_and_seen(
    pairs: DataFrame, products: DataFrame, assigned: DataFrame | None = None
) -> DataFrame:
    """Both joins above in one pass over the pairs (train members from ``assigned``).

    The two unique-key sides are merged first (full outer, so an unlisted
    train product still counts as seen). The pairs are then shuffled once, in
    a single left join that adaptive execution can split on a hot product.
    """
    listed = products.withColumn("product_matched", F.lit(True))
    members = train_product_keys(pairs if assigned is None else assigned)
    seen = members.withColumn("product_seen_train", F.lit(True))
    side = listed.join(seen, list(PRODUCT_KEYS), "full")
    flags = {"product_matched": False, "product_seen_train": False}
    return pairs.join(side, list(PRODUCT_KEYS), "left").fillna(flags)
