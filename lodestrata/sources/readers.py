"""Sources: JSON arrays and lines with declared schemas, manifests, settings, evaluation suites."""

from __future__ import annotations

import json
import posixpath
import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestrata.operators.normalize import DOCFINQA_RAW, FINQA_RAW
from lodestrata.sources.sinks import exists, read_small

_CHUNK = "struct<chunk_id:string, document_id:string, text:string, page_start:int, page_end:int, source_element_ids:array<string>>"
SUITE = (
    "schema_version int, name string, document_sha256 string, cases array<struct<case_id:string, category:string, context_mode:string, production_gold_rank:int, question:string, "
    "expectation:struct<answerable:boolean, expected_values:array<string>, expected_units:array<string>, expected_phrases:array<string>, required_source_numbers:array<int>>, "
    f"retrieved:array<struct<rank:int, score:double, chunk:{_CHUNK}>>>>"
)


def contained(root: str, relative: str) -> str:
    """The path below root; one that leads out of it or to no file raises.

    A root with a scheme is looked up on the file system it names, where no links lead elsewhere.
    """
    if "://" in root:
        scheme, _, place = root.rstrip("/").partition("://")
        path = posixpath.normpath(posixpath.join("/" + place, relative))
        if not path.startswith(posixpath.normpath("/" + place) + "/"):
            raise ValueError(f"{relative!r} leads out of {root!r}")
        found = f"{scheme}://{path[1:]}"
        if not exists(found):
            raise FileNotFoundError(found)
        return found
    base = Path(root).resolve()
    path = (base / relative).resolve()
    if not path.is_relative_to(base):
        raise ValueError(f"{relative!r} leads out of {root!r}")
    if not path.exists():
        raise FileNotFoundError(path)
    return str(path)


def _not_empty(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a file that is one JSON array; what doesn't fit the schema raises."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON-lines file or folder, not empty."""
    return _not_empty(spark.read.schema(schema).option("mode", "FAILFAST").json(path), path)


def json_objects(spark: SparkSession, path: str) -> DataFrame:
    """(line) of a JSON-lines file as variants; lines that are no object raise."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = F.parse_json("value")
    return lines.select(F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed).otherwise(F.raise_error(F.lit("a line holds no object")).cast("variant")).alias("line"))


def finqa_split(spark: SparkSession, root: str, file: str) -> DataFrame:
    return json_array(spark, contained(root, file), FINQA_RAW)


def docfinqa_split(spark: SparkSession, root: str, file: str) -> DataFrame:
    """Long-document records; blank context, question or answer, unknown keys and an empty file raise.

    A file of JSON lines (.jsonl, .ndjson) is read in splits and once: keys are checked in the rows
    as they pass. One JSON array can't be split and is read by one task, once more for its keys.
    """
    path = contained(root, file)
    known = [c.split()[0] for c in DOCFINQA_RAW.split(", ")]
    if path.endswith((".jsonl", ".ndjson")):
        rows = spark.read.option("mode", "FAILFAST").option("singleVariantColumn", "v").json(path)
        extra = F.array_except(F.map_keys(F.variant_get("v", "$", "map<string,variant>")), F.array(*map(F.lit, known)))
        fine = F.when(F.size(extra) > 0, F.raise_error(F.concat(F.lit("unknown keys "), F.array_join(extra, ", "))).cast("variant")).otherwise(F.col("v"))
        df = rows.select(fine.alias("v")).select(*[F.try_variant_get("v", f"$.{c}", "string").alias(c) for c in known])
    else:
        seen = spark.read.option("multiLine", True).option("mode", "FAILFAST").json(path)
        if extra := set(seen.columns) - set(known):
            raise ValueError(f"unknown keys {sorted(extra)}")
        df = json_array(spark, path, DOCFINQA_RAW)
    whole = _not_empty(df, file)
    for c in ("Context", "Question", "Answer"):
        whole = whole.withColumn(c, F.when(F.coalesce(F.trim(c), F.lit("")) != "", F.col(c)).otherwise(F.raise_error(F.lit(f"{c} is blank")).cast("string")))
    return whole


def manifest(path: str, dataset: str | None = None) -> dict:
    """A manifest of a data set; it must name the set that is asked for."""
    found = json.loads(read_small(path))
    if not isinstance(found, dict) or (dataset and found.get("dataset") != dataset):
        raise ValueError(f"{path} is no manifest of {dataset or 'a data set'}")
    return found


def settings(path: str) -> dict:
    """A data set's settings from TOML: name, a 40-digit revision and files per split.

    files names a relative path for each of at least one split; what doesn't fit raises.
    """
    found = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    revision = str(found.get("revision", ""))
    if len(revision) != 40 or any(c not in "0123456789abcdef" for c in revision):
        raise ValueError("revision must be 40 hex digits")
    if "name" in found and not str(found["name"]).strip():
        raise ValueError("name is blank")
    files = found.get("files", {})
    if not files or set(files) - {"train", "validation", "test"}:
        raise ValueError("files must name train, validation or test")
    for split, file in files.items():
        if not isinstance(file, str) or not file.strip() or Path(file).is_absolute() or ".." in Path(file).parts:
            raise ValueError(f"the file of {split} must be a path below the source folder")
    return found


def evaluation_suite(spark: SparkSession, path: str) -> DataFrame:
    """One row per case of a frozen suite; only schema version 1 is known."""
    suite = spark.read.schema(SUITE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    version = F.when(F.col("schema_version") == 1, F.col("name")).otherwise(F.raise_error(F.lit("unknown suite version")).cast("string"))
    return suite.select(version.alias("suite"), F.posexplode("cases").alias("position", "case")).select("suite", "position", "case.*")


def pages_text(pages: DataFrame) -> DataFrame:
    """(document_id, markdown): pages in order, each under a comment with its number; blank ones left out."""
    shown = pages.where(F.trim("markdown") != "").groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "markdown"))).alias("p"))
    return shown.select("document_id", F.array_join(F.transform("p", lambda p: F.concat(F.lit("<!-- page: "), p["page_number"].cast("string"), F.lit(" -->\n\n"), p["markdown"])), "\n\n").alias("markdown"))


def document_files(spark: SparkSession, path: str) -> DataFrame:
    """(document_id, path, length) of binary files, named by their content."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("document_id"), "path", "length")


def cached_embeddings(spark: SparkSession, path: str, model: str, revision: str, dimension: int) -> DataFrame:
    """Unit vectors of one model and revision; a vector of other length or norm raises."""
    rows = spark.read.parquet(path).where((F.col("model") == model) & (F.col("revision") == revision))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    sound = (F.size("embedding") == dimension) & (F.abs(norm - 1) < 1e-3)
    return rows.withColumn("embedding", F.when(sound, F.col("embedding")).otherwise(F.raise_error(F.lit("a cached vector isn't sound")).cast("array<float>")))
