"""Trial logs and configurations as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions import yaml_text

STATS_RECORD = "array<struct<epoch:int,step:int,loss:double,val_loss:double,test_loss:double,time:bigint>>"


def merged(baseline: Column, override: Column) -> Column:
    """Two maps with dotted keys as one, below the top level too; the override wins.

    A block keeps the keys that the override lacks; where one side has a block or a list and the
    other a value, and where both have a list, the override's stands alone. Works whatever the session's rule for
    equal keys.
    """
    below = lambda k, o: F.startswith(k, F.concat(o, F.lit(".")))
    items = lambda k: F.regexp_extract(k, r"^(.*?)\.[0-9]+(?:\.|$)", 1)
    replaced = lambda k, o: (k == o) | below(k, o) | below(o, k) | ((items(k) != "") & ((items(k) == items(o)) | below(items(k), o)))
    kept = F.map_filter(baseline, lambda k, _: ~F.exists(F.map_keys(override), lambda o: replaced(k, o)))
    return F.map_concat(kept, override)


def known_keys(config: Column, keys: list[str]) -> list[Column]:
    """The named entries of a map as columns; null where missing."""
    return [F.try_element_at(config, F.lit(k)).alias(k) for k in keys]


def rewritten(config: Column, updates: Column) -> Column:
    """A map with the values of those keys that updates has too; no key is new."""
    return F.transform_values(config, lambda k, v: F.coalesce(F.try_element_at(updates, k), v))


def moved(config: Column, old: str, new: str) -> Column:
    """A map with old replaced by new in every value, as when a project moves to another folder."""
    return F.transform_values(config, lambda _, v: F.replace(v, F.lit(old), F.lit(new)))


def changes(before: DataFrame, config: str, after: Column, key: str) -> DataFrame:
    """key, name, was, becomes: the entries of a map column that a rewrite would change, as a dry run lists them."""
    named = before.select(F.col(key), F.explode(F.col(config)).alias("name", "was"), after.alias("_after"))
    rows = named.select(key, "name", "was", F.try_element_at("_after", F.col("name")).alias("becomes"))
    return rows.where(~F.col("was").eqNullSafe(F.col("becomes")))


def _documents(spark: SparkSession, path: str) -> DataFrame:
    """path and configs of each YAML file under a folder: a map for each document, in order."""
    texts = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")

    def parsed(batches):
        import pyarrow as pa

        for batch in batches:
            held = [[list(yaml_text.flat(one).items()) for one in yaml_text.documents(text)] for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.list_(pa.map_(pa.string(), pa.string())))], names=["path", "configs"])

    return texts.mapInArrow(parsed, "path string, configs array<map<string,string>>")


def read_yaml(spark: SparkSession, path: str) -> DataFrame:
    """path and config of each document of the YAML files under a folder: every scalar by its dotted key, see yaml_text.

    An empty file has no row. The folder is listed once, however many folders are in it.
    """
    return _documents(spark, path).select("path", F.explode("configs").alias("config"))


def yaml_texts(configs: DataFrame, key: str, config: str = "configs") -> DataFrame:
    """key and value, the YAML text of each list of maps with dotted keys: a document for each map."""
    kind = configs.schema[key].dataType.simpleString()

    def written(batches):
        import pyarrow as pa

        for batch in batches:
            texts = ["---\n".join(yaml_text.nested_text(dict(c or [])) for c in held or []) for held in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "value"])

    return configs.select(key, config).mapInArrow(written, f"{key} {kind}, value string")


def rewrite_yaml(spark: SparkSession, source: str, target: str, override: Column, dry_run: bool = True) -> DataFrame:
    """Every YAML file under source with an override merged into each document, written to target in folders file=<its path
    under source>, unless dry_run. What changes is returned: file, name, was, becomes."""
    root = spark._jvm.org.apache.hadoop.fs.Path(source).toUri().getPath().rstrip("/")
    held = _documents(spark, source).select(F.element_at(F.split("path", root.replace(".", r"\.") + "/"), -1).alias("file"), "configs")
    after = held.withColumn("after", F.transform("configs", lambda c: merged(c, override)))
    if not dry_run:
        yaml_texts(after, "file", "after").write.partitionBy("file").mode("overwrite").text(target)
    each = after.select("file", F.explode(F.arrays_zip(F.col("configs").alias("config"), F.col("after").alias("after"))).alias("d"))
    names = F.array_union(F.map_keys("d.config"), F.map_keys("d.after"))
    rows = each.select("file", "d", F.explode(names).alias("name"))
    was, becomes = (F.try_element_at(F.col(f"d.{c}"), F.col("name")).alias(n) for c, n in (("config", "was"), ("after", "becomes")))
    kept = F.array_contains(F.map_keys("d.config"), F.col("name")) & F.array_contains(F.map_keys("d.after"), F.col("name"))
    return rows.select("file", "name", was, becomes, kept.alias("kept")).where(~F.col("kept") | ~F.col("was").eqNullSafe(F.col("becomes"))).drop("kept")


def write_stats(stats: DataFrame, path: str) -> None:
    """stats (trial, pos and the fields of a record) as one JSON text per trial, in order of pos, as training writes it."""
    fields = [c for c in stats.columns if c not in ("trial", "pos")]
    record = F.struct("pos", F.struct(*fields).alias("r"))
    texts = stats.groupBy("trial").agg(F.to_json(F.transform(F.sort_array(F.collect_list(record)), lambda p: p["r"])).alias("stats"))
    texts.write.mode("overwrite").json(path)


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """trial, pos and the fields of each record; a text that is no JSON list has no records."""
    raw = spark.read.schema("trial int, stats string").json(path)
    return raw.select("trial", F.posexplode(F.from_json("stats", STATS_RECORD)).alias("pos", "r")).select("trial", "pos", "r.*")


def trial_number(path: Column, anchored: bool = False) -> Column:
    """The number in trial_<n>, anywhere in the path or, if anchored, at the start of its last part; else null."""
    text = F.element_at(F.split(path, "/"), -1) if anchored else path
    found = F.regexp_extract(text, r"^trial_(\d+)" if anchored else r"trial_(\d+)", 1)
    return F.when(found != "", found).try_cast("int")
