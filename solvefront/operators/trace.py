"""Traces: operation classes, reconstruction from message histories, usage, prose calls."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from solvefront.functions.statistics import require
from solvefront.functions.text import tool_call_candidates, unescape
from solvefront.operators.scans import known_length, running_number
from solvefront.operators.windows import windows_like

# Operations by class; contested ones.
PRESERVING = ("single_call", "format_extract", "best_of_n", "majority_vote", "self_consistency", "rerank", "test_guided_selection", "temperature_schedule", "prompt_template")
EXPANDING = ("execution_feedback", "tool_call", "retrieval", "decomposition", "external_solver", "adaptive_prompt_rewrite")
CONTESTED = ("temperature_schedule", "prompt_template")
REQUIRED_ARGUMENTS = {"editor": ("command", "path", "file_text"), "bash": ("command",)}


def registry(spark: SparkSession, extra: Sequence[tuple[str, str, str, bool]] = ()) -> DataFrame:
    """(op, class, rationale, contested), by name.  Additions need a rationale and may not reclassify."""
    rows = {op: ("preserving", "built in", op in CONTESTED) for op in PRESERVING} | {op: ("expanding", "built in", op in CONTESTED) for op in EXPANDING}
    for op, kind, why, contested in extra:
        if not why.strip():
            raise ValueError(f"{op}: a rationale is required")
        if op in rows and rows[op][0] != kind:
            raise ValueError(f"{op} is {rows[op][0]}")
        rows.setdefault(op, (kind, why, contested))
    return spark.createDataFrame([(op, *rows[op]) for op in sorted(rows)], "op string, class string, rationale string, contested boolean")


def classify(trace: DataFrame, ops: DataFrame, op: str = "op") -> DataFrame:
    """Add class and contested; an operation that is not registered is an error."""
    joined = trace.join(F.broadcast(ops.select(op, "class", "contested")), op, "left")  # a fixed table of operations
    return require(joined, F.col("class").isNotNull(), F.concat(F.lit("unregistered operation "), F.coalesce(F.col(op), F.lit("null"))))


def attribution(classified: DataFrame, by: Sequence[str], op: str = "op") -> DataFrame:
    expanding = F.col("class") == "expanding"
    return classified.groupBy(*by).agg(
        F.array_sort(F.collect_set("class")).alias("classes"), F.coalesce(F.bool_or(expanding), F.lit(False)).alias("used_expanding"),
        F.array_sort(F.collect_set(F.when(expanding, F.col(op)))).alias("expanding_ops"), F.array_sort(F.collect_set(F.when(F.col("contested"), F.col(op)))).alias("contested_ops"))


def seen_before(events: DataFrame, by: Sequence[str], order: Sequence[str], length: str = "n_messages", ok: str = "ok", **options) -> DataFrame:
    """Add ``seen``: how many messages of the conversation were known before each call.

    A call of history length L makes max(seen, L) known, and its own reply one
    more if it succeeded.  A conversation of any size is scanned by ranges.
    """
    return known_length(events, by, order, F.col(length), F.col(ok), "seen", **options)


def tool_messages(events: DataFrame, messages: str = "messages", seen: str = "seen", role: str = "tool") -> DataFrame:
    """Add n_tool: tool messages not seen before this call."""
    fresh = F.slice(F.col(messages), F.col(seen).cast("int") + 1, F.greatest(F.lit(0), F.size(messages)))
    return events.withColumn("n_tool", F.size(F.filter(fresh, lambda m: m["role"] == role)).cast("long"))


def conversation_id(messages: str = "messages"):
    """Hash of the leading system and first user messages."""
    first = F.filter(F.col(messages), lambda m: m["role"].isin("system", "user"))
    return F.sha2(F.to_json(F.slice(first, 1, 2)), 256)


def usage_from_events(events: DataFrame, by: Sequence[str], status: str = "status", choices: str = "n_choices") -> DataFrame:
    """Calls and tokens of successful events (2xx with a choice); missing token fields are 0, the call counts."""
    rows = events.where(F.col(status).between(200, 299) & (F.col(choices) > 0))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("calls"), *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("prompt_tokens", "completion_tokens")])


def run_summary(events: DataFrame, ok: str = "status = 200") -> DataFrame:
    good = F.expr(ok)
    return events.agg(F.count(F.lit(1)).alias("total"), F.count_if(good).alias("ok"), F.count_if(~good).alias("failed"), F.count_if(good & F.col("had_tool_calls")).alias("with_tools"), F.sum(F.when(good, F.col("tokens"))).alias("tokens"))


def conditioned(verifier: DataFrame, model: DataFrame, session: str = "session_id", seq: str = "seq", error: str = "error", prompt: str = "prompt", head: int = 24) -> DataFrame:
    """Add ``feedback``: a later model call of the session quotes the first ``head`` characters of the error.

    Prompts' windows that may be some error's head, each with the last call of
    its session that has it, meet the errors on session and head: one
    equi-join.  Shorter errors are heads of their own length; blank ones condition nothing.
    """
    needle = F.substring(F.trim(F.coalesce(F.col(error), F.lit(""))), 1, head)
    v = verifier.withColumn("_needle", needle)
    heads = v.where("_needle != ''").select("_needle")
    calls = model.select(F.col(session).alias("_session"), F.col(seq).alias("_seq"), F.col(prompt).alias("_prompt"))
    last = windows_like(calls, "_prompt", ["_session", "_seq"], heads, "_needle").groupBy("_session", "window").agg(F.max("_seq").alias("_last"))
    joined = v.join(last, (F.col(session) == F.col("_session")) & (F.col("_needle") == F.col("window")), "left")
    return joined.withColumn("feedback", F.coalesce(F.col("_last") > F.col(seq), F.lit(False))).drop("_needle", "_session", "window", "_last")


def event_trace(verifier: DataFrame, model: DataFrame, session: str = "session_id", seq: str = "seq") -> DataFrame:
    """(session, seq, op): model events are single calls; verifier events feedback where they condition a later call, else selection."""
    v = conditioned(verifier, model, session, seq).select(session, seq, F.when(F.col("feedback"), "execution_feedback").otherwise("test_guided_selection").alias("op"))
    return v.unionByName(model.select(session, seq, F.lit("single_call").alias("op")))


def merge_traces(parts: DataFrame, by: Sequence[str], order: Sequence[str] = ("sub", "seq"), **options) -> DataFrame:
    """Renumber concatenated traces from 0."""
    return running_number(parts.withColumnsRenamed({"seq": "_seq"}), by, ["_seq" if c == "seq" else c for c in order], "seq", **options).drop("_seq")


def prose_call_details(transcripts: DataFrame, arm: str = "arm", file: str = "file", text: str = "text", examples: int = 3) -> DataFrame:
    """Per arm: runnable calls by tool, the editor's by command, and the first ``examples`` files (by name) with a runnable call."""
    found = transcripts.select(arm, file, F.explode(tool_call_candidates(unescape(F.col(text)))).alias("_c")).where(F.try_parse_json("_c").isNotNull())
    name, args = F.get_json_object("_c", "$.name"), F.get_json_object("_c", "$.arguments")
    complete = [(name == tool) & (F.size(F.array_intersect(F.json_object_keys(args), F.array(*[F.lit(k) for k in need]))) == len(need)) for tool, need in REQUIRED_ARGUMENTS.items()]
    runs = found.where(F.coalesce(reduce(lambda a, b: a | b, complete), F.lit(False))).select(arm, file, name.alias("tool"), F.when(name == "editor", F.coalesce(F.get_json_object("_c", "$.arguments.command"), F.lit("null"))).alias("command"))
    counted = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(c), F.col("n")))))
    tools = runs.groupBy(arm, "tool").agg(F.count(F.lit(1)).alias("n")).groupBy(arm).agg(counted("tool").alias("tools_used"))
    commands = runs.where("command is not null").groupBy(arm, "command").agg(F.count(F.lit(1)).alias("n")).groupBy(arm).agg(counted("command").alias("commands_used"))
    ranked = runs.select(arm, file).distinct().withColumn("_n", F.row_number().over(W.partitionBy(arm).orderBy(file))).where(F.col("_n") <= examples)
    first = ranked.groupBy(arm).agg(F.array_sort(F.collect_list(file)).alias("runnable_examples"))
    return transcripts.select(arm).distinct().join(tools, arm, "left").join(commands, arm, "left").join(first, arm, "left")


def prose_calls(transcripts: DataFrame, arm: str = "arm", file: str = "file", text: str = "text") -> DataFrame:
    """Per arm: files, and those that emit, parse and could run a tool call written as prose."""
    found = transcripts.select(arm, file, F.explode_outer(tool_call_candidates(unescape(F.col(text)))).alias("_c"))
    name, args = F.get_json_object("_c", "$.name"), F.get_json_object("_c", "$.arguments")
    parses = F.coalesce(F.try_parse_json("_c").isNotNull(), F.lit(False))
    keys = F.json_object_keys(args)
    runs = F.lit(False)
    for tool, need in REQUIRED_ARGUMENTS.items():
        has = F.coalesce(F.size(F.array_intersect(keys, F.array(*[F.lit(k) for k in need]))) == len(need), F.lit(False))
        runs = runs | ((name == tool) & has)
    flagged = found.select(arm, file, F.col("_c").isNotNull().alias("e"), parses.alias("p"), F.coalesce(parses & runs, F.lit(False)).alias("r"))
    per_file = flagged.groupBy(arm, file).agg(*[F.bool_or(c).alias(c) for c in "epr"])
    return per_file.groupBy(arm).agg(F.count(F.lit(1)).alias("files"), F.count_if("e").alias("emitted"), F.count_if("p").alias("parses"), F.count_if("r").alias("runnable"))
