"""Audit log, timings and costs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import standardize as S


def audit_rows(entries: DataFrame, core: Sequence[str] = ("event", "event_time", "filename")) -> DataFrame:
    """Core columns, and all others redacted as one JSON text."""
    rest = [c for c in entries.columns if c not in core]
    pairs = F.map_from_arrays(F.array(*(F.lit(c) for c in rest)), F.array(*(F.col(c).cast("string") for c in rest)))
    filled = F.map_filter(S.redacted_map(pairs), lambda k, v: v.isNotNull())
    return entries.select(*core, F.to_json(filled).alias("details"))


def expand_audit(log: DataFrame, fields: Sequence[tuple[str, str]]) -> DataFrame:
    """The log with (name, type) fields of its details as columns; what can't be read is null."""
    return log.select("*", *(F.get_json_object("details", f"$.{n}").try_cast(t).alias(n) for n, t in fields)).drop("details")


def orchestration_ms(duration: Column, parser: Column, api: Column) -> Column:
    return F.greatest(F.lit(0.0), duration - parser - api)


def cost_breakdown(entries: DataFrame, filename: str | None = None, event: str | None = None) -> DataFrame:
    """Calls and milliseconds by kind, overall (event null) and for each event; entries without a breakdown don't count.

    Of one file or event if given. The overall row is there, of zeros, without any entry.
    """
    known = entries.filter("duration_ms IS NOT NULL AND parser_ms IS NOT NULL")
    for column, wanted in (("filename", filename), ("event", event)):
        known = known if wanted is None else known.filter(F.col(column) == wanted)
    parts = ("parser_ms", "api_ms", "orchestration_ms")
    own = [F.count(F.lit(1)).alias("calls"), F.sum("duration_ms").alias("total"), *(F.sum(F.coalesce(F.col(p), F.lit(0.0))).alias(p) for p in parts)]
    by_event = known.groupBy("event").agg(*own).withColumn("overall", F.lit(0))
    whole = by_event.agg(F.coalesce(F.sum("calls"), F.lit(0)).alias("calls"), F.sum("total").alias("total"), *(F.sum(p).alias(p) for p in parts))
    sums = by_event.unionByName(whole.withColumns({"event": F.lit(None).cast(entries.schema["event"].dataType), "overall": F.lit(1)}))
    whole = F.when(F.col("total") == 0, 1.0).otherwise(F.col("total"))
    share = lambda p: F.coalesce(F.round(F.col(p) / whole * 100, 1), F.lit(0.0)).alias(p.replace("_ms", "_pct"))
    return sums.select("event", (F.col("overall") == 1).alias("overall"), "calls", F.round(F.coalesce("total", F.lit(0.0)), 1).alias("total_ms"), *(F.round(F.coalesce(F.col(p), F.lit(0.0)), 1).alias(p) for p in parts), *(share(p) for p in parts))


def token_cost(log: DataFrame, prices: Sequence[tuple[str, float, float]]) -> DataFrame:
    """The log with each call's cost by the first price whose pattern the model's name holds; the last is the default."""
    def price(k: int) -> Column:
        out = F
        for p in prices[:-1]:
            out = out.when(F.contains(F.lower("model"), F.lit(p[0])), p[k])
        return out.otherwise(prices[-1][k])

    return log.withColumn("cost", F.round(F.col("prompt_tokens") / 1000 * price(1) + F.col("completion_tokens") / 1000 * price(2), 9))


def cost_by_task(costed: DataFrame) -> DataFrame:
    """Calls, tokens, cost and share of all cost of each task, overall and for each document."""
    agg = (F.count(F.lit(1)).alias("calls"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).cast("long").alias("tokens"), F.sum("cost").alias("cost"), F.min("model").alias("model"), F.count_distinct("model").alias("models"))
    by_doc = costed.groupBy("doc_name", "task").agg(*agg)
    overall = costed.groupBy("task").agg(*agg).withColumn("doc_name", F.lit(None).cast("string"))
    both = by_doc.unionByName(overall)
    total = F.sum("cost").over(Window.partitionBy("doc_name"))
    share = F.when(total > 0, F.col("cost") / total * 100).otherwise(0.0)
    return both.select("doc_name", "task", "calls", "tokens", F.round("cost", 6).alias("cost"), "model", "models", F.round(share, 4).alias("percent"))


def cost_by_document(costed: DataFrame) -> DataFrame:
    return costed.groupBy("doc_name").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("prompt_tokens").cast("long").alias("prompt_tokens"), F.sum("completion_tokens").cast("long").alias("completion_tokens"),
        F.round(F.sum("cost"), 6).alias("total_cost"), F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models_used"),
    )


def task_listing(costed: DataFrame, named: int = 2) -> DataFrame:
    """Tasks of each document and overall (doc_name null) by falling cost, with the first ``named`` of their models by name and their share of all cost."""
    own = (F.count(F.lit(1)).alias("calls"), F.sum("prompt_tokens").cast("long").alias("prompt_tokens"), F.sum("completion_tokens").cast("long").alias("completion_tokens"), F.sum("cost").alias("cost"), F.array_sort(F.collect_set("model")).alias("m"))
    by_doc = costed.groupBy("doc_name", "task").agg(*own)
    both = by_doc.unionByName(costed.groupBy("task").agg(*own).withColumn("doc_name", F.lit(None).cast("string")))
    total, place = F.sum("cost").over(Window.partitionBy("doc_name")), F.row_number().over(Window.partitionBy("doc_name").orderBy(F.desc("cost"), "task"))
    share = F.round(F.when(total > 0, F.col("cost") / total * 100).otherwise(0.0), 4)
    return both.select("doc_name", place.alias("place"), "task", F.array_join(F.slice("m", 1, named), ", ").alias("models"), "calls", "prompt_tokens", "completion_tokens", F.round("cost", 6).alias("cost"), share.alias("percent"))


def usage_totals(costed: DataFrame) -> DataFrame:
    """Calls, tokens and cost of a session; one row, of zeros without a call."""
    return costed.agg(F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).cast("long"), F.lit(0)).alias("tokens"), F.coalesce(F.round(F.sum("cost"), 6), F.lit(0.0)).alias("cost"))


def listing(rows: DataFrame, amount: str, key: str, limit: int) -> DataFrame:
    """The rows with the largest amounts, ties by key."""
    return rows.orderBy(F.desc(amount), key).limit(limit)


def page_cost(calls: DataFrame) -> DataFrame:
    """Calls, pages and cost of each document, and overall (doc_name null)."""
    return calls.rollup("doc_name").agg(F.count(F.lit(1)).alias("calls"), F.sum("pages").cast("long").alias("pages"), F.round(F.sum("cost"), 4).alias("cost"), (F.grouping("doc_name") == 1).alias("overall"))


def event_counts(log: DataFrame, since: Column | None = None) -> DataFrame:
    some = log if since is None else log.filter(F.col("event_time") >= since)
    return some.groupBy("event").agg(F.count(F.lit(1)).alias("n"))


def lifecycle(log: DataFrame) -> DataFrame:
    """A version number for each status of a document, and when it was created and last changed."""
    own = Window.partitionBy("document_id")
    return log.select("document_id", "status", "at", "event_id", F.row_number().over(own.orderBy("at", "event_id")).alias("version"), F.min("at").over(own).alias("created_at"), F.max("at").over(own).alias("updated_at"))


def lifecycle_states(log: DataFrame) -> DataFrame:
    """(document_id, history, tags): each document's events in order and the tags of all of them, sorted.

    ``log``: document_id, event_id, at, status, filename, parser_used, confidence_score, user, tags. States of parts of a log
    merge to that of the whole (``merged_states``), whatever the order in which the parts come and though events come twice.
    A document's history is one array, as the record asks for.
    """
    event = F.struct("at", "event_id", "status", "parser_used", "filename", "confidence_score", "user")
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    return merged_states(log.select("document_id", F.array(event).alias("history"), tags.alias("tags")))


def merged_states(states: DataFrame) -> DataFrame:
    every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    return states.groupBy("document_id").agg(every("history").alias("history"), every("tags").alias("tags"))


def lifecycle_records(states: DataFrame) -> DataFrame:
    """A record for each document: what its last event says, a version for each event, the history and all tags."""
    last, first = F.element_at("history", -1), F.get("history", F.lit(0))
    return states.select(
        "document_id", last["filename"].alias("filename"), last["parser_used"].alias("parser_used"), last["status"].alias("status"), last["confidence_score"].alias("confidence_score"), "tags", F.coalesce(last["user"], F.lit("unknown")).alias("user"),
        F.size("history").alias("version"), F.transform("history", lambda e: F.struct(e["status"].alias("status"), e["at"].alias("timestamp"), e["parser_used"].alias("parser_used"))).alias("status_history"), first["at"].alias("created_at"), last["at"].alias("updated_at"),
    )


def edit_history(edits: DataFrame) -> DataFrame:
    """Edits in order with the value before; an edit that repeats the value before it doesn't count."""
    w = Window.partitionBy("sheet", "claim_id", "field").orderBy("edited_at", "edit_id")
    return edits.withColumn("old_value", F.lag("new_value").over(w)).filter("old_value IS NULL OR old_value <> new_value")


def change_summary(edits: DataFrame) -> DataFrame:
    """For each edited field the first old value and the last new one."""
    order = F.struct("edited_at", "edit_id")
    return edits.groupBy("claim_id", "field").agg(F.min_by("old_value", order).alias("first_value"), F.max_by("new_value", order).alias("last_value"), F.count(F.lit(1)).alias("edits"))


def timeline(log: DataFrame, once: Sequence[str], session_start: Column) -> DataFrame:
    """Events of each claim in order; of the types in ``once`` only the first; marked as of this session or history."""
    w = Window.partitionBy("claim_id", "event").orderBy("event_time", "event_id")
    kept = log.withColumn("n", F.row_number().over(w)).filter(~F.col("event").isin(*once) | (F.col("n") == 1)).drop("n")
    return kept.withColumn("part", F.when(F.col("event_time") >= session_start, "session").otherwise("history"))
