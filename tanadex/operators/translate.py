"""Translation tables and translated names."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tanadex.functions.text import has_han, has_kana, match_key, needs_translation, product_language
from tanadex.model import TRANSLATION_TYPE
from tanadex.operators.names import canonical_brand, canonical_model
from tanadex.sources.dictionary import AliasDictionary


def _build(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    alias, order = F.col("alias"), F.col("alias_ord")
    listed = order > 0
    kana, han = has_kana(alias), has_han(alias)
    variant = listed & ~kana & ~han & (F.lower(alias) != F.lower(F.col(name)))
    found = rows.groupBy(*keys).agg(
        F.min_by(alias, F.when(listed & han & ~kana, order)).alias("zh"),
        F.min_by(alias, F.when(listed & kana, order)).alias("ja"),
        F.array_sort(F.collect_list(F.when(variant, F.struct(order.alias("o"), alias.alias("a")))))
        .alias("variants"))
    variants = F.transform("variants", lambda v: v["a"])
    return found.select(*keys, F.struct(
        F.col(name).alias("en"), "zh", "ja",
        F.when(F.size(variants) > 0, variants).alias("en_variants"))
        .cast(TRANSLATION_TYPE).alias("translations"))


def brand_translations(dictionary: AliasDictionary) -> DataFrame:
    """Per brand: the name, its first Chinese and Japanese alias, other spellings."""
    rows = dictionary.brand_rows.withColumnRenamed("brand", "brand_name")
    return _build(rows, ["brand_name"], "brand_name")


def model_translations(dictionary: AliasDictionary) -> DataFrame:
    rows = dictionary.model_rows.withColumnsRenamed({"brand": "brand_name", "model": "model_name"})
    return _build(rows, ["brand_name", "model_name"], "model_name")


def upsert(old: DataFrame, new: DataFrame, keys) -> DataFrame:
    """New rows replace old ones with the same key."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return new.unionByName(old.join(new.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def _japanese_aliases(rows: DataFrame, scope: list[str], name: str, order: str):
    """First kana alias by exact name, and by folded name or alias."""
    kana = (rows.where((F.col("alias_ord") > 0) & has_kana("alias"))
            .groupBy(*scope, name, order).agg(F.min_by("alias", "alias_ord").alias("kana")))
    exact = kana.select(*scope, F.col(name).alias("by_name"), F.col("kana").alias("kana_exact"))
    folded = (rows.select(*scope, order, match_key("alias").alias("by_key")).distinct()
              .join(kana.select(*scope, order, "kana"), [*scope, order])
              .groupBy(*scope, "by_key").agg(F.min_by("kana", order).alias("kana_folded")))
    return exact, folded


def translate_names(items: DataFrame, dictionary: AliasDictionary, brands: DataFrame,
                    models: DataFrame, lang: str, brand: str = "brand_std",
                    model: str = "model_std") -> DataFrame:
    """Add ``brand_translated`` and ``model_translated`` for the wanted language.

    A name already in that language stays. Otherwise the translation table decides,
    then (for Japanese) the dictionary's first kana alias, else the name itself.
    """
    b, m = F.coalesce(F.col(brand), F.lit("")), F.coalesce(F.col(model), F.lit(""))
    by_brand = (
        brands.select(F.col("brand_name").alias("t_brand"), F.col(f"translations.{lang}").alias("t_brand_text")))
    by_model = (
        models.select(F.col("brand_name").alias("t_brand"), F.col("model_name").alias("t_model"),
                      F.col(f"translations.{lang}").alias("t_model_text")))
    out = (items.withColumn("t_brand", b).withColumn("t_model", m)
           .join(by_brand, "t_brand", "left").join(by_model, ["t_brand", "t_model"], "left"))
    brand_found = [F.nullif("t_brand_text", F.lit(""))]
    model_found = [F.nullif("t_model_text", F.lit(""))]
    if lang == "ja":
        brand_exact, brand_folded = _japanese_aliases(
            dictionary.brand_rows, [], "brand", "brand_ord")
        model_exact, model_folded = _japanese_aliases(
            dictionary.model_rows.withColumnRenamed("brand", "t_brand"), ["t_brand"], "model", "model_ord")
        out = (out
               .withColumn("t_brand_key", F.when(needs_translation("t_brand", lang), match_key("t_brand")))
               .withColumn("t_model_key", F.when(needs_translation("t_model", lang), match_key("t_model")))
               .join(dictionary.small("ja_brand_exact", lambda: brand_exact.withColumnsRenamed(
                   {"by_name": "t_brand", "kana_exact": "b_exact"})), "t_brand", "left")
               .join(dictionary.small("ja_brand_folded", lambda: brand_folded.withColumnsRenamed(
                   {"by_key": "t_brand_key", "kana_folded": "b_folded"})), "t_brand_key", "left")
               .join(dictionary.small("ja_model_exact", lambda: model_exact.withColumnsRenamed(
                   {"by_name": "t_model", "kana_exact": "m_exact"})), ["t_brand", "t_model"], "left")
               .join(dictionary.small("ja_model_folded", lambda: model_folded.withColumnsRenamed(
                   {"by_key": "t_model_key", "kana_folded": "m_folded"})), ["t_brand", "t_model_key"], "left"))
        brand_found += [F.col("b_exact"), F.col("b_folded")]
        model_found += [F.col("m_exact"), F.col("m_folded")]

    def chosen(name, found):
        return F.when(needs_translation(name, lang), F.coalesce(*found, F.col(name))).otherwise(F.col(name))

    return out.select(*[F.col(c) for c in items.columns],
                      chosen("t_brand", brand_found).alias("brand_translated"),
                      chosen("t_model", model_found).alias("model_translated"))


def translate_listing(items: DataFrame, dictionary: AliasDictionary, brands: DataFrame,
                      models: DataFrame, lang: str, only_if_different: bool = True) -> DataFrame:
    """Add ``brand_name_translated`` and ``model_name_translated`` for display.

    Only items with both names, in another language than the wanted one. Listing
    pages show a translation only where it differs from the name; search pages show
    it always and skip English (``only_if_different=False``).
    """
    if not only_if_different and lang == "en":
        return items.withColumns({c: F.lit(None).cast("string") for c in
                                  ("brand_name_translated", "model_name_translated")})
    named = canonical_model(canonical_brand(items, dictionary), dictionary)
    done = translate_names(named, dictionary, brands, models, lang)
    both = (F.coalesce("brand_name", F.lit("")) != "") & (F.coalesce("model_name", F.lit("")) != "")
    wanted = both & (product_language("brand_name", "model_name") != lang)

    def shown(translated, original):
        value = F.nullif(translated, F.lit(""))
        if only_if_different:
            value = F.nullif(value, F.col(original))
        return F.when(wanted, value)

    return done.select(*[F.col(c) for c in items.columns],
                       shown("brand_translated", "brand_name").alias("brand_name_translated"),
                       shown("model_translated", "model_name").alias("model_name_translated"))
