"""Conversations and tool traces as training records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as T


def chat_role(kind: Column) -> Column:
    """Role of a message type in chat format."""
    return F.when(kind.isin("human", "user"), "user").when(kind.isin("ai", "assistant"), "assistant").when(kind == "system", "system").when(kind == "tool", "tool").otherwise("user")


def conversations(messages: DataFrame) -> DataFrame:
    """(conv_id, trace_length, assistant_turns, has_cot, finished, needs_repair) of messages (conv_id, turn, role, content).

    Finished: the last message is an assistant's with a json fence outside its
    thoughts. A thought tag in any assistant message makes has_cot.
    """
    by = F.col("role") == "assistant"
    last = F.max_by(F.struct("role", "content"), F.col("turn"))
    flat = messages.groupBy("conv_id").agg(
        F.count("*").alias("trace_length"), F.count_if(by).alias("assistant_turns"), F.coalesce(F.bool_or(by & F.col("content").contains("<thought>")), F.lit(False)).alias("has_cot"), last.alias("l"),
    )
    done = F.coalesce((F.col("l.role") == "assistant") & T.has_json_fence(F.col("l.content")), F.lit(False))
    return flat.select("conv_id", "trace_length", "assistant_turns", "has_cot", done.alias("finished"), (~done).alias("needs_repair"))


def training_records(messages: DataFrame, truth: DataFrame) -> DataFrame:
    """One record for each conversation: prompt (turns before the first answer), messages in order, truth, metadata."""
    rows = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))).alias("all"))
    plain = lambda a: F.transform(a, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    first = F.array_position(F.transform("all", lambda m: m["role"]), "assistant").cast("int")
    prompt = F.when(first > 1, F.slice("all", F.lit(1), first - 1)).when(first == 1, F.slice("all", 1, 0)).otherwise(F.col("all"))
    cot = F.exists("all", lambda m: (m["role"] == "assistant") & F.contains(m["content"], F.lit("<thought>")))
    return rows.join(truth, "conv_id", "left").select(
        "conv_id", plain(prompt).alias("prompt"), plain(F.col("all")).alias("messages"),
        F.struct("target_selector", "file_context").alias("ground_truth"),
        F.struct(F.size("all").alias("trace_length"), cot.alias("has_cot")).alias("metadata"),
    )


def attach_outputs(events: DataFrame) -> DataFrame:
    """Tool calls with the output that follows: events (trace_id, seq, kind, name, content), kind call or output.

    An output belongs to the latest call before it; of several the first. Steps count from 1.
    """
    w = Window.partitionBy("trace_id").orderBy("seq")
    marked = events.withColumn("call", F.last(F.when(F.col("kind") == "call", F.col("seq")), ignorenulls=True).over(w))
    outputs = marked.filter("kind = 'output' and call is not null").groupBy("trace_id", F.col("call").alias("seq")).agg(F.min_by("content", "seq").alias("output"))
    calls = events.filter("kind = 'call'").join(outputs, ["trace_id", "seq"], "left")
    return calls.select("trace_id", F.row_number().over(w).alias("step_idx"), F.col("name").alias("tool_name"), F.col("content").alias("tool_args"), F.coalesce("output", F.lit("")).alias("tool_output"))


def link_by_order(calls: DataFrame, responses: DataFrame, key: str = "trace_id") -> DataFrame:
    """The n-th response of a trace with the n-th call's id; calls without a response stay, with null."""
    n = lambda df: df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("seq")))
    return n(calls).select(key, "_n", "call_id").join(n(responses).select(key, "_n", "content"), [key, "_n"], "left").select(key, F.col("_n").alias("position"), "call_id", "content")


def repair_flags(records: DataFrame, status: DataFrame) -> DataFrame:
    """Records with (repaired, repair_turns): those that were finished pass as they are."""
    return records.join(status.select("conv_id", "finished", "assistant_turns"), "conv_id", "left").withColumns(
        {"repaired": ~F.coalesce("finished", F.lit(False)), "repair_turns": F.when(F.col("finished"), 0).otherwise(F.col("assistant_turns"))}
    )
