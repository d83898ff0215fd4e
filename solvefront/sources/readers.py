"""Readers and writers.  Schemas are explicit supersets: missing fields are null, nothing is inferred."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SAMPLES = "i bigint, t double, passed boolean, reason string, calls bigint, prompt_tokens bigint, completion_tokens bigint, usd double, species_key string, canon_method string, raw string, condition_key string, task_id string"
RECORDS = "task_id string, model_id string, split string, family string, n_samples bigint, n_correct bigint, p_hat double, p_ci_low double, p_ci_high double, beyond_frontier boolean, n_distinct_solutions bigint, species_counts map<string,bigint>, good_turing_unseen_mass double, sample_coverage double, pass_at_k map<string,double>, rarefaction map<string,double>, usage struct<calls:bigint,prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint,usd:double>, n_verifier_errors bigint, n_budget_exhausted bigint, metadata map<string,string>"
ARCHIVE = "entry struct<variant_id:string,generation:bigint,parent_id:string,description:string,source_excerpt:string>, train_solve_rate double, held_out_solve_rate double, transfer_solve_rate double, metadata map<string,string>"
ARMS = "instance_id string, model string, agent_src string, language string, eval_result string, passed boolean, error string, usage struct<calls:bigint,prompt_tokens:bigint,completion_tokens:bigint>, trace_op_counts struct<single_call:bigint,tool_call:bigint,self_consistency:bigint>, solution_len bigint, elapsed_s double, n_candidates_cfg bigint, pass_at_n boolean, n_passing_candidates bigint, per_candidate_eval array<string>"
SUITES = {
    "humaneval": "task_id string, prompt string, canonical_solution string, test string, entry_point string",
    "mbpp": "task_id string, prompt string, code string, test_list array<string>, test_imports array<string>, source_file string, test string",
    "polyglot": "instance_id string, language string, problem_statement string",
    "swebench": "instance_id string, repo string, base_commit string, problem_statement string, FAIL_TO_PASS string, PASS_TO_PASS string, patch string, test_patch string",
}


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of the lines that are not blank.

    ``line`` orders a file's lines: where the split it was read from starts,
    and its place in the split.  A file is cut into splits like any other
    table's, so no task holds a whole log.
    """
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), place.alias("line"), "value").where(F.trim("value") != "")


def read_samples(spark: SparkSession, path: str, *, by: Sequence[str] = ("task_id",)) -> DataFrame:
    """Attempt log: per file, rows before the first that does not parse; of a repeated index the first line stays.

    A torn line is where a run died, so nothing after it is trusted; the next
    run draws those indices again.  ``line`` orders the lines of a file.

    Rows are dealt by what tells attempts apart, never by file alone, and to
    two tasks or more for each split, so none holds more than splits do.
    """
    lines = _numbered_lines(spark, path)
    parsed = lines.withColumn("r", F.from_json("value", SAMPLES, {"mode": "PERMISSIVE"}))
    stops = parsed.where(F.col("r.i").isNull()).groupBy(F.col("file").alias("_file")).agg(F.min("line").alias("_stop"))
    # The broadcast table has a row for each torn file.
    good = parsed.join(F.broadcast(stops), F.col("file") == F.col("_file"), "left").where(F.col("_stop").isNull() | (F.col("line") < F.col("_stop"))).select("file", "line", "r.*")
    attempt = ["file", "condition_key", *by, "i"]
    tasks = 2 * lines.rdd.getNumPartitions()
    if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")):
        good = good.repartition(tasks, *attempt)
    once = F.row_number().over(W.partitionBy(*attempt).orderBy("line"))
    return good.withColumn("_n", once).where("_n = 1").drop("_n")


def write_samples(df: DataFrame, path: str) -> None:
    """Append through Spark's commit protocol: a failed write leaves no torn line."""
    df.write.mode("append").json(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Frontier records, the last of each task: later files, then later lines, win."""
    rows = _numbered_lines(spark, path).select("file", "line", F.from_json("value", RECORDS).alias("r"))
    return rows.groupBy("r.task_id").agg(F.max_by("r", F.struct("file", "line")).alias("r")).select("r.*")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ARCHIVE).json(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def read_arm(spark: SparkSession, path: str) -> DataFrame:
    """Result files, each a JSON array of one condition; a file that mixes models or agents is an error."""
    rows = spark.read.schema(ARMS).option("multiLine", True).json(path).withColumn("file", F.input_file_name())
    model, agent = F.coalesce("model", F.lit("UNRECORDED")), F.coalesce("agent_src", F.lit("UNRECORDED"))
    w = W.partitionBy("file")
    mixed = (F.min(model).over(w) != F.max(model).over(w)) | (F.min(agent).over(w) != F.max(agent).over(w))
    checked = F.when(mixed, F.raise_error(F.concat(F.lit("mixed arms in "), F.col("file")))).otherwise(F.lit(True))
    return rows.withColumn("_one", checked).where("_one").drop("_one").select(
        "*", F.coalesce("trace_op_counts.tool_call", F.lit(0)).alias("tool_calls"), F.coalesce("trace_op_counts.single_call", F.lit(0)).alias("generations"))


def read_suite(spark: SparkSession, path: str, family: str, ids: DataFrame | None = None, *, multiline: bool | None = None) -> DataFrame:
    """Rows of a suite's file (JSON lines, or an array for mbpp and polyglot), limited to ``ids`` by a semi-join."""
    array = family in ("mbpp", "polyglot") if multiline is None else multiline
    rows = spark.read.schema(SUITES[family]).option("multiLine", array).json(path)
    if family == "swebench":
        rows = rows.withColumns({c: F.from_json(c, "array<string>") for c in ("FAIL_TO_PASS", "PASS_TO_PASS")})
    key = "task_id" if "task_id" in rows.columns else "instance_id"
    return rows.join(ids.select(key), key, "left_semi") if ids is not None else rows


def to_tasks(rows: DataFrame, family: str) -> DataFrame:
    """Rows of a suite as tasks: prompt, tests, entry point, weaker public tests."""
    from solvefront.functions.code import entry_point_udf, public_asserts_udf, public_table_udf

    if family in ("humaneval", "humanevalplus"):
        tests = F.concat("test", F.lit("\n\ncheck("), "entry_point", F.lit(")\n"))
        public = public_table_udf("test", "entry_point") if family == "humanevalplus" else public_asserts_udf("test")
        return rows.select(F.concat(F.lit(family + "/"), F.col("task_id")).alias("task_id"), F.lit(family).alias("family"), "prompt", tests.alias("tests"), "entry_point", public.alias("public_tests"), F.concat("prompt", "canonical_solution").alias("reference_solution"))
    listed = F.array_join("test_list", "\n")
    half = F.array_join(F.slice("test_list", F.lit(1), F.greatest(F.lit(1), ((F.size("test_list") + 1) / F.lit(2)).cast("int"))), "\n")
    return rows.select(F.concat(F.lit(family + "/"), F.col("task_id")).alias("task_id"), F.lit(family).alias("family"), "prompt", F.coalesce("test", listed).alias("tests"), entry_point_udf(F.get("test_list", F.lit(0))).alias("entry_point"), half.alias("public_tests"), F.col("code").alias("reference_solution"), F.array_join("test_imports", "\n").alias("setup"))


def without_broken(tasks: DataFrame, broken: Sequence[str], timeouts: dict[str, float], default: float = 20.0) -> DataFrame:
    """Without known-broken tasks, with each task's own time limit."""
    out = tasks.where(~F.col("task_id").isin(*broken)) if broken else tasks
    pairs = [x for k, v in timeouts.items() for x in (F.lit(k), F.lit(float(v)))]
    own = F.try_element_at(F.create_map(*pairs), F.col("task_id")) if pairs else F.lit(None)
    return out.withColumn("timeout_s", F.coalesce(own, F.lit(default)))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(arm, file, text) of all Markdown files below the path; the arm is the folder."""
    rows = spark.read.option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).text(path, wholetext=True)
    parts = F.split(F.input_file_name(), "/")
    return rows.select(F.element_at(parts, -2).alias("arm"), F.element_at(parts, -1).alias("file"), F.col("value").alias("text"))


class Config:
    """Nested settings with dotted paths, ``extends`` and overrides; driver-side, not data."""

    def __init__(self, values: dict):
        self.values = values

    def get(self, path: str, *default: Any) -> Any:
        at: Any = self.values
        for part in path.split("."):
            if not isinstance(at, dict) or part not in at:
                if default:
                    return default[0]
                raise KeyError(path)
            at = at[part]
        return at

    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps(self.values, sort_keys=True, default=str).encode()).hexdigest()[:16]


def merge(base: dict, over: dict) -> dict:
    return base | {k: merge(base[k], v) if isinstance(base.get(k), dict) and isinstance(v, dict) else v for k, v in over.items()}


def coerce(text: str) -> Any:
    """true, false, null, whole and decimal numbers from their text; else the text."""
    words = {"true": True, "false": False, "null": None, "none": None, "~": None}
    text = text.strip()
    if text.lower() in words:
        return words[text.lower()]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text


def load_config(path: str, overrides: Sequence[str] = ()) -> Config:
    """JSON or YAML (where a parser is installed); ``extends`` names a file beside it; overrides are a.b=value."""
    from pathlib import Path

    raw = Path(path).read_text()
    if path.endswith((".yaml", ".yml")):
        import yaml

        values = yaml.safe_load(raw) or {}
    else:
        values = json.loads(raw)
    if parent := values.pop("extends", None):
        values = merge(load_config(str(Path(path).parent / parent)).values, values)
    for pair in overrides:
        key, _, value = pair.partition("=")
        nested: Any = coerce(value)
        for part in reversed(key.split(".")):
            nested = {part: nested}
        values = merge(values, nested)
    return Config(values)
