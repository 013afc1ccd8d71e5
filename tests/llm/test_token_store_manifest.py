"""Recipes that are lost or changed do not pass the manifest."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from clonal_spark.llm import token_store
from clonal_spark.session import Scratch


@pytest.mark.parametrize("damage", ["lost", "doc_id", "start"])
def test_damaged_recipes_raise(spark, damage):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(30)], "doc_id long, text string")
    scratch, other = Scratch(spark, "test"), Scratch(spark, "test")
    token_store.write_store(docs, scratch, public_tokenizers.path("byte_bpe_50k.json"))
    for name in ("chunks", "manifest"):
        spark.read.parquet(scratch.path(name)).write.parquet(other.path(name))
    recipes, one = spark.read.parquet(scratch.path("recipes")), F.col("doc_id") == 7
    changed = recipes.where(~one) if damage == "lost" else recipes.withColumn(damage, F.when(one, 1000).otherwise(F.col(damage)))
    changed.write.parquet(other.path("recipes"))
    assert token_store.read_digests(spark, scratch).count() == token_store.documents_of(spark, scratch).count() == 30
    for read in (token_store.read_digests, token_store.documents_of):
        with pytest.raises(ValueError, match="manifest"):
            read(spark, other).collect()
