"""Reading and writing the engine's file formats through Spark."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, is_dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import ESSAY, GOLD, QA, QUERY, TRIPLET


def read_jsonl(spark: SparkSession, path: str, schema: str, limit: int | None = None) -> DataFrame:
    """One record a line; blank lines are skipped and a malformed one fails the read."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return df if limit is None else df.limit(limit)


def read_triplets(spark: SparkSession, path: str, provenance: str = "") -> DataFrame:
    """Triplets with any provenance columns named in ``provenance`` ("sample_id string, …")."""
    return read_jsonl(spark, path, TRIPLET + (", " + provenance if provenance else ""))


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, GOLD)


def read_essays(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ESSAY).option("multiLine", True).json(path)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """One row for each query."""
    return spark.read.schema(QUERY).option("multiLine", True).json(path).select("id", "topic", F.posexplode("queries").alias("pos", "query"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, QA)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def not_done(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items whose key is not in what was written before; rows without a key (corrupt ones) count for nothing."""
    return items.join(done.select(key).filter(F.col(key).isNotNull()), key, "left_anti")


def append_new(items: DataFrame, path: str, key: str, process) -> int:
    """Process what ``path`` lacks and append it; returns how many rows there were."""
    spark = items.sparkSession
    try:
        done = spark.read.schema(f"{key} {dict(items.dtypes)[key]}").json(path)
        done.schema  # noqa: B018
        todo = not_done(items, done, key)
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(error):
            raise
        todo = items
    before = todo.count()
    process(todo).write.mode("append").json(path)
    return before


def rename_fields(df: DataFrame) -> DataFrame:
    """Clinical chunk ids to provenance names, where present."""
    return df.withColumnsRenamed({"cr_id": "sample_id", "section_id": "source_text_id"})


def unwrap_passage(text):
    """The passage of a few-shot prompt column; without the pattern the whole text."""
    pattern = r'(?s)text = "(.*?)"\n\n#'
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1)).otherwise(text)


def parse_turtle(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes (iri, label, parent_iri) and relations (label, domain, range) of an OWL subset.

    ``blocks`` has one ontology text a row (ontology_id, text). Statements are
    parted by blank lines; those without subject or label are skipped; domain
    and range become class labels, null where unknown.
    """
    block = blocks.select("ontology_id", F.explode(F.split("text", r"\n\s*\n")).alias("b"))
    iri = r"(<[^>]*>|[\w.\-]*:[\w.\-]+)"

    def get(pattern: str):
        found = F.regexp_extract("b", pattern, 1)
        return F.when(found != "", found)

    rows = block.select(
        "ontology_id", get(rf"^\s*{iri}\s").alias("iri"), get(r'rdfs:label\s+"([^"]*)"').alias("label"), get(rf"rdfs:subClassOf\s+{iri}").alias("parent_iri"),
        get(rf"rdfs:domain\s+{iri}").alias("d"), get(rf"rdfs:range\s+{iri}").alias("r"),
        F.col("b").rlike(r"\ba\s+owl:Class\b|rdf:type\s+owl:Class\b").alias("is_class"), F.col("b").rlike(r"\ba\s+owl:ObjectProperty\b|rdf:type\s+owl:ObjectProperty\b").alias("is_property"),
    ).filter("iri is not null and label is not null")
    classes = rows.filter("is_class").select("ontology_id", "iri", "label", "parent_iri")
    named = classes.groupBy("ontology_id", "iri").agg(F.min("label").alias("name"))
    relations = rows.filter("is_property").select("ontology_id", "label", "d", "r")
    for side, out in (("d", "domain"), ("r", "range")):
        relations = relations.join(named.withColumnsRenamed({"iri": side, "name": out}), ["ontology_id", side], "left")
    return classes, relations.select("ontology_id", "label", "domain", "range")


def parent_labels(classes: DataFrame) -> DataFrame:
    """(label, parent_label): one step up, by the first IRI of a label."""
    first = classes.groupBy("ontology_id", "label").agg(F.min_by("parent_iri", "iri").alias("parent_iri"))
    up = classes.groupBy("ontology_id", F.col("iri").alias("parent_iri")).agg(F.min("label").alias("parent_label"))
    return first.join(up, ["ontology_id", "parent_iri"], "left").select("ontology_id", "label", "parent_label")


def load_seed_roots(path: str) -> list:
    """Seeds of a YAML file: a list, or a mapping with ``seed_roots``; a missing key gives none."""
    import yaml

    with open(path, encoding="utf-8") as file:
        return seed_roots(yaml.safe_load(file))


def seed_roots(data) -> list:
    if isinstance(data, list):
        return data
    if isinstance(data, dict):
        return list(data.get("seed_roots") or [])
    raise ValueError("seed roots must be a list or a mapping with the key seed_roots")


def flatten_seeds(seeds: list, parent: str | None = None, depth: int = 0) -> list[tuple[str, str | None, str | None, int]]:
    """(label, description, parent_label, depth) of nested seeds, labels normalised."""
    rows = []
    for item in seeds:
        item = {"label": item} if isinstance(item, str) else item
        label = " ".join(str(item.get("label") or "").lower().split())
        if label:
            rows.append((label, item.get("description"), parent, depth))
            rows += flatten_seeds(item.get("children") or [], label, depth + 1)
    return rows


def seed_frame(spark: SparkSession, seeds: list) -> DataFrame:
    return spark.createDataFrame(flatten_seeds(seeds), "label string, description string, parent_label string, depth int")


def seed_labels_of_run(spark: SparkSession, run_dir: str) -> set[str]:
    """Seed labels frozen in a finished run's metadata; none on any failure."""
    try:
        text = spark.read.text(f"{run_dir}/run_metadata.json", wholetext=True).first()[0]
        return {r[0] for r in flatten_seeds(json.loads(text)["config"]["hierarchy"]["seed_roots"])}
    except Exception:  # noqa: BLE001
        return set()


@dataclass
class HierarchyConfig:
    weighting: str = "ppmi"
    vote_threshold: float = 0.75
    band_tolerance: float = 10
    batch: int = 30
    regroup_input: int = 90
    regroup_rounds: int = 3
    collision: float = 0.90
    child_share: float = 0.6
    min_type_support: int = 1
    max_depth: int | None = 15
    seed_roots: list = field(default_factory=list)


@dataclass
class PipelineConfig:
    relation_threshold: float = 0.75
    type_threshold: float = 0.75
    entity_threshold: float = 0.85
    max_rounds: int = 5
    max_cluster_size: int = 40
    skip_hierarchy: bool = False
    hierarchy: HierarchyConfig = field(default_factory=HierarchyConfig)


def config_from(data: dict, kind=PipelineConfig) -> tuple[object, list[str]]:
    """(config, unknown keys): what is unknown is left out, what is absent keeps its default."""
    known = {f.name: f for f in fields(kind)}
    values, unknown = {}, [k for k in data if k not in known]
    for name, f in known.items():
        if name in data:
            value = data[name]
            default = getattr(kind(), name)
            if is_dataclass(default) and isinstance(value, dict):
                value, more = config_from(value, type(default))
                unknown += [f"{name}.{m}" for m in more]
            values[name] = value
    return kind(**values), unknown


def write_graph(parts: tuple[DataFrame, DataFrame, DataFrame], path: str, stats: DataFrame, mode: str = "errorifexists") -> None:
    """Entities, edge labels and relations of a graph as sorted JSON lines below ``path``, its one row of stats beside it.

    Files are dealt by range, so that they are sorted as a whole and no task holds more than its range.
    """
    for name, part in zip(("entities", "edges", "relations"), parts):
        part.orderBy(*part.columns).write.mode(mode).json(f"{path}/{name}")
    stats.coalesce(1).write.mode(mode).json(f"{path}_stats")
