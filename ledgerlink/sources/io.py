"""Readers, writers and fixture generators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str, schema: str | None = None, kind: str = "parquet") -> DataFrame:
    """parquet, json (one object a line), orc or csv with a header. A schema keeps csv and json from being read twice."""
    reader = spark.read.format(kind)
    if schema:
        reader = reader.schema(schema)
    return (reader.option("header", True) if kind == "csv" else reader).load(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """category, template of a JSON file {category: [templates] or {language: [templates]}}; a small fixture file."""
    whole = spark.read.option("multiLine", True).json(path)
    parts = []
    for f in whole.schema:
        if f.dataType.typeName() == "array":
            parts.append(whole.select(F.lit(f.name).alias("category"), F.lit(None).cast("string").alias("language"), F.explode(f"`{f.name}`").alias("template")))
        elif f.dataType.typeName() == "struct":
            parts += [whole.select(F.lit(f.name).alias("category"), F.lit(g.name).alias("language"), F.explode(f"`{f.name}`.`{g.name}`").alias("template")) for g in f.dataType if g.dataType.typeName() == "array"]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """Placeholders {name} replaced, those without a value dropped, spaces collapsed."""
    for k, v in values.items():
        template = F.replace(template, F.lit("{" + k + "}"), F.coalesce(v.cast("string"), F.lit("")))
    return F.trim(F.regexp_replace(F.regexp_replace(template, r"\{[a-z_]+\}", ""), r"\s+", " "))


def typo(ref: Column, seed: Column) -> Column:
    """One of several deterministic misspellings; references below five characters are left alone."""
    n = F.length(ref)
    at = (F.pmod(F.xxhash64(seed), n - 1) + 1).cast("int")
    cut = lambda a, b: F.substring(ref, a, b)
    ways = [
        F.concat(cut(F.lit(1), at - 1), cut(at + 1, F.lit(1)), cut(at, F.lit(1)), cut(at + 2, n)), F.concat(cut(F.lit(1), at - 1), cut(at + 1, n)), F.translate(ref, "0O", "O0"), F.translate(ref, "1l", "l1"),
        F.concat(cut(F.lit(1), at), cut(at, n)), F.concat(cut(F.lit(1), at), F.lit(" "), cut(at + 1, n)), F.replace(ref, F.lit("-"), F.lit("/")), cut(F.lit(1), n - 1), F.lower(ref),
    ]
    pick = F.pmod(F.xxhash64(seed, F.lit(1)), F.lit(len(ways)))
    out = F.when(n < 5, ref)
    for i, w in enumerate(ways):
        out = out.when(pick == i, w)
    return out


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)
