"""python -m lodestrata: queries, and the jobs on question-answering data sets."""

from __future__ import annotations

import argparse
import importlib
import json
import sys

from pyspark.sql import SparkSession, functions as F

from lodestrata.operators import ranking
from lodestrata.plans import catalogue, pipelines
from lodestrata.plans.settings import Settings
from lodestrata.session import local_session, ship
from lodestrata.sources import readers


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="lodestrata", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    listing = commands.add_parser("queries", help="names of all queries")
    run = commands.add_parser("run", help="run a query on a folder of Parquet tables")
    run.add_argument("name")
    run.add_argument("folder")
    run.add_argument("--out", help="folder for the result; without it some rows are shown")

    for command in (listing, run):
        command.add_argument("--module", help="module with further QUERIES")

    prepare = commands.add_parser("prepare", help="prepare a question-answering data set")
    prepare.add_argument("settings", help="TOML file with revision and [files]")
    prepare.add_argument("source")
    prepare.add_argument("target")
    prepare.add_argument("--dataset", choices=("finqa", "docfinqa"), default="finqa")
    prepare.add_argument("--known", help="source folder of the known questions that long documents are linked to")
    prepare.add_argument("--known-settings", help="TOML file of the known questions")
    prepare.add_argument("--size", type=int, default=pipelines.SIZE, help="characters of a window of a long document")
    prepare.add_argument("--overlap", type=int, default=pipelines.OVERLAP)
    prepare.add_argument("--minimum", type=float, default=0.6, help="least share of a passage's words that its window holds")

    validate = commands.add_parser("validate", help="name what is wrong with a prepared data set")
    validate.add_argument("target")

    chat = commands.add_parser("export-chat", help="plain chat records with gold context")
    export = commands.add_parser("export-training", help="records for training: supported ones and refusals")
    export.add_argument("--split", action="append", choices=pipelines.SPLITS)
    export.add_argument("--refusal-ratio", type=float, default=pipelines.sampling.REFUSAL_RATIO)
    export.add_argument("--no-augment", action="store_true", help="leave out records whose gold wasn't retrieved")
    export.add_argument("--no-resplit", action="store_true", help="keep the splits of the data sets")
    export.add_argument("--most-tokens", type=int, default=pipelines.export.MOST_TOKENS)
    chat.add_argument("--split", action="append", choices=pipelines.SPLITS)

    benchmark = commands.add_parser("benchmark", help="measure retrieval on a prepared split")
    benchmark.add_argument("retriever", choices=("bm25", "dense", "hybrid"))
    benchmark.add_argument("--split", default="test", choices=pipelines.SPLITS)
    benchmark.add_argument("-k", type=int, action="append", help="rank to measure at; 1, 3 and 5 if not given")
    benchmark.add_argument("--baseline", help="folder of another benchmark to compare with")
    benchmark.add_argument("--rrf-k", type=int)
    benchmark.add_argument("--candidates", type=int)

    evaluate = commands.add_parser("evaluate", help="assess answers of two models that stand in a table, to a frozen suite")
    evaluate.add_argument("suite")
    evaluate.add_argument("answers", help="JSON lines of model, question, answer")
    evaluate.add_argument("--target", required=True)
    for command in (chat, export, benchmark):
        command.add_argument("prepared", nargs="+", help="folders of prepared data sets")
        command.add_argument("--target", required=True)
    return parser


def _queries(module: str | None) -> dict:
    """Queries of the library, and those that a module names in QUERIES."""
    return catalogue.queries() | (importlib.import_module(module).QUERIES if module else {})


def _prepare(spark: SparkSession, o: argparse.Namespace) -> dict:
    told = readers.settings(o.settings)
    if o.dataset == "finqa":
        return pipelines.prepare_finqa(spark, o.source, told["files"], o.target, told["revision"])
    if not (o.known and o.known_settings):
        raise SystemExit("long documents need --known and --known-settings")
    known = None
    for file in readers.settings(o.known_settings)["files"].values():
        rows = readers.finqa_split(spark, o.known, file)
        known = rows if known is None else known.unionByName(rows)
    return pipelines.prepare_docfinqa(spark, o.source, told["files"], known, o.target, told["revision"], o.size, o.overlap, o.minimum)


def _benchmark(spark: SparkSession, o: argparse.Namespace, settings: Settings) -> dict:
    units, queries, gold = pipelines.prepared_world(spark, o.prepared, o.split)
    vectors = None
    if o.retriever != "bm25":
        vectors = ranking.hashed_vectors(units, "chunk_id", "text"), ranking.hashed_vectors(queries, "query_id", "query_text")
    return pipelines.run_benchmark(
        units, queries, gold, o.target, o.retriever, vectors, o.baseline, o.k or pipelines.evaluation.K_VALUES, o.candidates or settings.candidate_k, o.rrf_k or settings.rrf_k
    )


def _export(spark: SparkSession, o: argparse.Namespace, settings: Settings) -> dict:
    whole = None
    for split in o.split or pipelines.SPLITS:
        world = pipelines.training_world(spark, o.prepared, split)
        whole = world if whole is None else tuple(a.unionByName(b) for a, b in zip(whole, world))
    units, examples, gold = whole
    return pipelines.export_training(units.dropDuplicates(["chunk_id"]), examples, gold, o.target, settings.top_k, settings.candidate_k, o.most_tokens, o.refusal_ratio, not o.no_augment, not o.no_resplit)


def _evaluate(spark: SparkSession, o: argparse.Namespace) -> dict:
    said = {(r.model, r.question): r.answer for r in readers.json_lines(spark, o.answers, "model string, question string, answer string").collect()}
    suite = readers.evaluation_suite(spark, o.suite)

    def generator(model: str, system: str, user: str) -> str:
        return said[model, user.rsplit("Question:\n", 1)[-1]]

    pipelines.evaluate_suite(suite, generator, o.target)
    return json.loads(pipelines.sinks.read_small(f"{o.target}/metrics.json"))


def main(argv: list[str] | None = None) -> int:
    parser = _parser()
    o = parser.parse_args(argv)
    if o.command == "queries":
        print("\n".join(sorted(_queries(o.module))))
        return 0
    if o.command == "run" and o.name not in _queries(o.module):
        parser.error(f"no query {o.name!r}")
    spark = local_session()
    ship(spark)
    settings = Settings.from_environment()
    if o.command == "run":
        result = _queries(o.module)[o.name](spark, o.folder)
        if o.out:
            result.write.mode("overwrite").parquet(o.out)
        else:
            result.show(20, truncate=80)
        return 0
    if o.command == "validate":
        long = readers.manifest(f"{o.target}/manifest.json").get("dataset") == "docfinqa"
        wrong = (pipelines.validate_docfinqa if long else pipelines.validate_finqa)(spark, o.target)
        rows = wrong.groupBy("check_name", "split").agg(F.count(F.lit(1)).alias("n")).collect()
        print(json.dumps([r.asDict() for r in rows], indent=2))
        return 1 if rows else 0
    jobs = {
        "prepare": lambda: _prepare(spark, o), "export-chat": lambda: pipelines.export_chat(spark, o.prepared, o.target, o.split or pipelines.SPLITS), "export-training": lambda: _export(spark, o, settings),
        "benchmark": lambda: _benchmark(spark, o, settings), "evaluate": lambda: _evaluate(spark, o),
    }
    print(json.dumps(jobs[o.command](), indent=2, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
