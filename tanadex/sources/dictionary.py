"""Alias dictionary of brands and models as joinable tables."""

from __future__ import annotations

import yaml
from pyspark.sql import DataFrame, SparkSession, functions as F

from tanadex.functions.text import lower_key, match_key
from tanadex.model import DEFAULT_CATEGORY, DICTIONARY_SCHEMA
from tanadex.operators.scale import saved


def dictionary_rows(config, category: str = DEFAULT_CATEGORY):
    """Flat rows of a nested ``brand -> aliases, model_name -> aliases`` mapping.

    The name itself is its own alias 0. Model columns are null on brand rows.
    """
    for brand_ord, (brand, data) in enumerate((config or {}).items()):
        if not isinstance(data, dict):
            continue
        for alias_ord, alias in enumerate([brand, *(data.get("aliases") or [])]):
            yield (category, brand_ord, brand, None, None, alias_ord, alias)
        models = data.get("model_name")
        for model_ord, (model, info) in enumerate((models if isinstance(models, dict) else {}).items()):
            if not isinstance(info, dict):
                continue
            for alias_ord, alias in enumerate([model, *(info.get("aliases") or [])]):
                yield (category, brand_ord, brand, model_ord, model, alias_ord, alias)


class AliasDictionary:
    """Lookup tables over flat dictionary rows (columns as in ``DICTIONARY_SCHEMA``)."""

    def __init__(self, rows: DataFrame):
        self.rows = rows.select(*DICTIONARY_SCHEMA.fieldNames())
        self._cache: dict[str, DataFrame] = {}

    @classmethod
    def from_config(cls, spark: SparkSession, config, category: str = DEFAULT_CATEGORY):
        return cls(spark.createDataFrame(list(dictionary_rows(config, category)), DICTIONARY_SCHEMA))

    @classmethod
    def from_yaml(cls, spark: SparkSession, path: str, category: str = DEFAULT_CATEGORY):
        """A dictionary file; a missing or broken file is an empty dictionary."""
        try:
            with open(path, encoding="utf-8") as f:
                config = yaml.safe_load(f)
        except (OSError, yaml.YAMLError):
            config = {}
        return cls.from_config(spark, config, category)

    def small(self, name: str, build) -> DataFrame:
        """A lookup table, built once and stored, so that its size in bytes is known when a join with it is planned: a
        small one is broadcast, and the rows of a frequent brand are not gathered by name."""
        if name not in self._cache:
            self._cache[name] = saved(build())
        return self._cache[name]

    @property
    def brand_rows(self) -> DataFrame:
        return self.rows.where(F.col("model").isNull())

    @property
    def model_rows(self) -> DataFrame:
        return self.rows.where(F.col("model").isNotNull())

    def brand_lookup(self, tier: str) -> DataFrame:
        """(category, key) -> brand; the earliest brand of the dictionary wins a key."""
        return self.small(f"brand_{tier}", lambda: (
            self.brand_rows
            .select("category", _tier_key(tier).alias(f"key_{tier}"), "brand_ord", "brand")
            .groupBy("category", f"key_{tier}")
            .agg(F.min_by("brand", "brand_ord").alias(f"brand_{tier}"))))

    def model_lookup(self, tier: str) -> DataFrame:
        """(category, brand, key) -> model; the earliest model of the brand wins a key."""
        return self.small(f"model_{tier}", lambda: (
            self.model_rows
            .select("category", "brand", _tier_key(tier).alias(f"key_{tier}"), "model_ord", "model")
            .groupBy("category", "brand", f"key_{tier}")
            .agg(F.min_by("model", "model_ord").alias(f"model_{tier}"))
            .withColumnRenamed("brand", "lookup_brand")))


TIERS = ("exact", "lower", "folded")


def _tier_key(tier: str):
    return {"exact": lambda: F.col("alias"),
            "lower": lambda: lower_key("alias"),
            "folded": lambda: match_key("alias")}[tier]()
