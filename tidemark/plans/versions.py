"""Policies and models over time: a registry that keeps every version, requests scored by what was frozen at their time, and differences between versions as rows."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import many
from tidemark.operators.ridge import Ridge
from tidemark.operators.splits import ntz
from tidemark.plans.policy import EVIDENCE, TOLERANCE, is_intact, sign
from tidemark.sources.shared import stored

#: Versions that a plan takes up as expressions; more must be pruned to those of the requests' period first.
MAX_VERSIONS = 500
#: Objects and lists inside each other, at most.
MAX_DEPTH = 8


class VersionedRegistry:
    """A table (version, frozen_at, model, policy) in a folder: each version is a file of its own that is written once, so readers never see half of one."""

    SCHEMA = "version long, frozen_at string, model string, policy string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def versions(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def freeze(self, version: int, frozen_at: str, model: Ridge, policy: dict) -> None:
        """Adds a version; one that exists is not written again."""
        row = (version, frozen_at, json.dumps(model.to_dict(), sort_keys=True), json.dumps(sign(policy, frozen_at), sort_keys=True))
        self.spark.createDataFrame([row], self.SCHEMA).coalesce(1).write.mode("ignore").parquet(f"{self.path}/v={version}")

    def score(self, requests: DataFrame, time_col: str) -> DataFrame:
        """requests with version, raw, prediction and clipped: by the model and policy frozen last at or before each request's time. Earlier requests, and those without a time, have none.

        A policy that was changed after it was signed is refused.
        """
        found = self.versions().select("version", "frozen_at", "model", "policy").orderBy("frozen_at", "version").limit(MAX_VERSIONS + 1).collect()
        if len(found) > MAX_VERSIONS:
            raise ValueError(f"more than {MAX_VERSIONS} versions")
        policies = {r.version: json.loads(r.policy) for r in found}
        if broken := [v for v, p in policies.items() if not is_intact(p)]:
            raise RuntimeError(f"policies that do not bear their own signature: versions {broken}")
        version, clips = F.lit(None).cast("long"), [v for v, p in policies.items() if p["policy_id"] == "non_negative_projection"]
        for r in found:  # later ones are asked first
            version = F.when(F.col(time_col) >= ntz(r.frozen_at), F.lit(r.version)).otherwise(version)
        out = many.predicted(requests.withColumn("version", version), "version", {r.version: Ridge.from_dict(json.loads(r.model)) for r in found}, "raw")
        clipped = F.col("version").isin(clips) & (F.col("raw") < 0)
        return out.withColumn("prediction", F.when(clipped, F.lit(0.0)).otherwise(F.col("raw"))).withColumn("clipped", clipped)


def flattened(docs: DataFrame, keys: list[str], json_col: str) -> DataFrame:
    """(keys, path, kind, value): a row for each leaf of a JSON document, kind being int, float, bool, text, null, or empty for an object or list without entries.
    1.0 is the int 1: the JSON reader keeps numbers, not how they are written."""
    level = docs.select(*keys, F.lit("").alias("path"), F.parse_json(json_col).alias("v"))
    leaves = None
    for _ in range(MAX_DEPTH + 1):
        level = stored(level, "level")
        name = F.schema_of_variant("v")
        opened = name.startswith("OBJECT<") | name.startswith("ARRAY<")
        empty = name.isin("OBJECT<>", "ARRAY<VOID>") & F.to_json("v").isin("{}", "[]")
        kind = F.when(empty, "empty").when(name.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL\\(\\d+,0\\))$"), "int").when(name.rlike("^(DOUBLE|FLOAT|DECIMAL)"), "float").when(name == "BOOLEAN", "bool").when(name == "STRING", "text").otherwise("null")
        some = level.where(~opened | empty).select(*keys, "path", kind.alias("kind"), F.to_json("v").alias("value"))
        leaves = some if leaves is None else leaves.unionByName(some)
        level = level.where(opened & ~empty)
        if level.isEmpty():
            return leaves
        entry = level.sparkSession.tvf.variant_explode(F.col("v").outer()).select(F.col("pos"), F.col("key"), F.col("value"))
        inside = level.lateralJoin(entry)
        step = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.when(F.col("path") == "", F.col("key")).otherwise(F.concat(F.lit("."), F.col("key"))))
        level = inside.select(*keys, F.concat("path", step).alias("path"), F.col("value").alias("v"))
    raise ValueError(f"documents of more than {MAX_DEPTH} levels")


def _loose(path: Column) -> Column:
    return path.rlike(rf"(^|\.){EVIDENCE}([.\[]|$)")


def differences(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, difference, first, second) of flattened documents with equal keys: paths that only one has, values or kinds that differ. Numbers under the evidence may
    differ by TOLERANCE if one of them is no integer; a bool is no number. A document that only one side has differs in all its paths."""
    a = first.select(*keys, "path", F.col("kind").alias("kind_a"), F.col("value").alias("first"))
    b = second.select(*keys, "path", F.col("kind").alias("kind_b"), F.col("value").alias("second"))
    both = a.join(b, [*keys, "path"], "full")
    numbers = F.col("kind_a").isin("int", "float") & F.col("kind_b").isin("int", "float") & ((F.col("kind_a") == "float") | (F.col("kind_b") == "float"))
    near = F.abs(F.col("first").try_cast("double") - F.col("second").try_cast("double")) <= TOLERANCE
    exact = (F.col("kind_a") == F.col("kind_b")) & F.when((F.col("kind_a") == "float"), F.col("first").try_cast("double") == F.col("second").try_cast("double")).otherwise(F.col("first") == F.col("second"))
    same = F.when(_loose(F.col("path")) & numbers, near).otherwise(exact)
    what = F.when(F.col("kind_a").isNull(), "only second").when(F.col("kind_b").isNull(), "only first").when(~same, "differs")
    return both.withColumn("difference", what).where("difference is not null").select(*keys, "path", "difference", "first", "second")


def refusals(docs: DataFrame, content: str, signature: str) -> DataFrame:
    """docs with refused: why an audit must not run under the document, or null: nothing frozen, changed since it was signed, or chosen with the final test."""
    used = F.try_variant_get(F.try_parse_json(F.col(content)), "$.final_test_used", "boolean")
    why = F.when(F.col(content).isNull(), "nothing is frozen").when(~F.col(signature).eqNullSafe(F.sha2(F.col(content), 256)), "changed since").when(used, "final test used")
    return docs.withColumn("refused", why)
