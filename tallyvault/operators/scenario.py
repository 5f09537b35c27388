"""Retention plans: which recorded copies to keep, which could go, and why.

Plans are made from records alone; nothing is read or removed.
"""

from __future__ import annotations

import hashlib
import json
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyvault import spec
from tallyvault.errors import InvalidScenario, Refused
from tallyvault.functions import paths
from tallyvault.functions.text import digest
from tallyvault.inventory import Inventory
from tallyvault.operators import duplicates, hot
from tallyvault.operators import predicates as P
from tallyvault.storage import settle

MOST_RULES, MOST_PROTECTIONS, MOST_OBSERVATIONS, MOST_SECONDS, MOST_OVERRIDES = 32, 100, 1_000_000, 600, 100
RULES = ("PREFER_SCAN", "PREFER_PATH", "NEWEST", "OLDEST", "SHALLOWEST")
DECISIONS = ("KEEP", "REMOVE", "UNDECIDED", "UNRESOLVED")


def normal(config: dict) -> dict:
    rules, protections = config.get("rules") or [], config.get("protections") or []
    if len(rules) > MOST_RULES or len(protections) > MOST_PROTECTIONS or any(r.get("kind") not in RULES for r in rules):
        raise InvalidScenario("the rules or protections cannot be used")
    for r in rules:
        if (r["kind"] == "PREFER_SCAN" and r.get("scan_id") is None) or (r["kind"] == "PREFER_PATH" and not r.get("path")):
            raise InvalidScenario("a preference names what it prefers")
    most, seconds = config.get("max_occurrences", MOST_OBSERVATIONS), config.get("max_seconds", MOST_SECONDS)
    if not 1 <= most <= MOST_OBSERVATIONS or not 1 <= seconds <= MOST_SECONDS:
        raise InvalidScenario("the plan's bounds are out of range")
    return {"request": config.get("request") or {}, "rules": rules, "protections": protections, "manual": bool(config.get("manual")), "max_occurrences": most, "max_seconds": seconds}


def _at(path: str, scan_id: int | None) -> Column:
    """Rows on or under a path, compared as their root compares paths; perhaps of one scan only."""
    if not path:
        test = F.lit(True)
    else:
        fold = F.when(paths.windows(F.col("scan_root")), F.lower(F.lit(path))).otherwise(F.lit(path))
        test = paths.under(paths.key(F.col("scan_root"), F.col("relative_path")), fold)
    return test if scan_id is None else test & (F.col("scan_id") == scan_id)


def _order(config: dict) -> list[Column]:
    """Sound copies first, of those the ones that stay anyway, then by the rules, at last by name; the least is kept.

    A time that is missing comes before others where the oldest are preferred, and after them where the newest are.
    """
    out = [F.when(F.col("conflicting") | F.col("path_error"), 1).otherwise(0), F.when(F.col("is_protected") | ~F.col("target"), 0).otherwise(1)]
    for r in config["rules"]:
        if r["kind"] == "PREFER_SCAN":
            out.append(F.when(F.col("scan_id") == r["scan_id"], 0).otherwise(1))
        elif r["kind"] == "PREFER_PATH":
            out.append(F.when(_at(r["path"], r.get("scan_id")), 0).otherwise(1))
        elif r["kind"] == "SHALLOWEST":
            out.append(paths.depth(F.col("relative_path")))
        elif r["kind"] == "OLDEST":
            out += [F.col("modified_sec"), F.col("modified_nano")]
        else:
            out += [o for c in ("modified_sec", "modified_nano") for o in (F.when(F.col(c).isNull(), 1).otherwise(0), F.bitwise_not(F.col(c)))]
    return [*out, F.col("path_key"), F.col("scan_id"), F.col("entry_id")]


def _located(rows: DataFrame, inv: Inventory) -> DataFrame:
    named = rows.join(F.broadcast(inv.scans.select("scan_id", F.col("name").alias("scan_name"), F.col("root").alias("scan_root"))), "scan_id")
    path = paths.recorded(F.col("scan_root"), F.col("relative_path"))
    return named.withColumn("path", path).withColumn("path_key", paths.key(F.col("scan_root"), path))


def history(inv: Inventory, scan_ids: list[int]) -> DataFrame:
    """For each recorded path whether its observations contradict each other, or one has no digest."""
    seen = _located(P.observations(inv, scan_ids, errors=False).filter("kind = 'FILE'"), inv)
    content = F.concat_ws(":", F.col("size").cast("string"), F.coalesce("sha256", F.lit("UNHASHED")))
    return seen.groupBy("path_key").agg((F.bool_or(F.col("sha256").isNull()) | (F.count_distinct(content) > 1)).alias("conflicting"))


def decisions(inv: Inventory, config: dict, overrides: DataFrame | None = None) -> DataFrame:
    """Every copy in the groups that the plan's request finds, with the decision for its path and the reason.

    `overrides` (path_key, group_id, decision) are manual decisions.  Keeping is always
    possible; another choice only where the rules could have made it.
    """
    plan = normal(config)
    wanted = spec.group_search(plan["request"])
    found = duplicates.flagged(inv, plan["request"])
    matches = duplicates.groups(inv, plan["request"]).select("size", "sha256", F.col("occurrences").alias("_n"))
    rows = _located(hot.joined(found, matches, ["size", "sha256"], "_n", ["scan_id", "entry_id"]).drop("_n"), inv)
    protected = F.lit(False)
    for p in plan["protections"]:
        protected = protected | _at(p.get("path") or "", p.get("scan_id"))
    rows = rows.withColumn("group_id", F.concat_ws(":", F.col("size").cast("string"), "sha256")).withColumn("row_protected", protected)
    # facts of a path in its group: unordered windows over a path's observations, one for each scan
    same = Window.partitionBy("group_id", "path_key")
    flags = settle(rows.withColumns({
        "target": F.bool_and("filter_match").over(same), "is_protected": F.bool_or("row_protected").over(same), "path_error": F.bool_or("has_error").over(same)
    }).join(history(inv, wanted["scan_ids"]), "path_key"))
    # facts of a group: an aggregate joined back, as a group may hold most of the files
    order = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(_order(plan))])
    keepers = flags.groupBy("group_id").agg(F.min_by("path_key", order).alias("keep_key"), F.bool_or(~F.col("conflicting") & ~F.col("path_error")).alias("has_keeper"), F.count("*").alias("_n"))
    chosen = hot.joined(flags, keepers, ["group_id"], "_n", ["scan_id", "entry_id"])
    steps = [
        (F.col("is_protected"), "KEEP", "PROTECTED"), (~F.col("target"), "KEEP", "OUTSIDE_SCOPE"), (F.col("conflicting"), "UNRESOLVED", "CONFLICTING_HISTORY"),
        (F.col("path_error"), "UNRESOLVED", "RECORDED_ERROR"), (~F.col("has_keeper"), "UNRESOLVED", "NO_CONFIRMED_KEEPER"),
        *[(F.lit(True), "UNDECIDED", "MANUAL_REQUIRED")] * plan["manual"], (F.col("path_key") == F.col("keep_key"), "KEEP", "RULE_KEEPER"),
    ]
    decision, reason = F.lit("REMOVE"), F.lit("RULE_REDUNDANT")
    for test, what, why in reversed(steps):
        decision, reason = F.when(test, what).otherwise(decision), F.when(test, why).otherwise(reason)
    auto = chosen.withColumn("auto_decision", decision).withColumn("auto_reason", reason)
    if overrides is None:
        auto = auto.withColumn("decision", F.col("auto_decision")).withColumn("reason", F.col("auto_reason"))
    else:
        manual = overrides.select("path_key", "group_id", F.col("decision").alias("_manual"))
        auto = auto.join(manual, ["path_key", "group_id"], "left")
        free = ~F.col("is_protected") & ~F.col("path_error") & ~F.col("conflicting") & F.col("target")
        taken = F.col("_manual").isNotNull() & (F.col("_manual") != "AUTO") & ((F.col("_manual") == "KEEP") | free)
        auto = auto.withColumn("decision", F.when(taken, F.col("_manual")).otherwise(F.col("auto_decision"))).withColumn("reason", F.when(taken, "MANUAL").otherwise(F.col("auto_reason")))
    return auto.select(
        "group_id", "scan_id", "entry_id", "parent_id", "scan_name", "scan_root", "relative_path", "filename", "path", "path_key", "size", "modified_sec", "modified_nano", "sha256",
        F.col("target").alias("matches_filters"), F.col("path_error").alias("has_error"), F.col("is_protected").alias("protected"), "conflicting", "auto_decision", "auto_reason", "decision", "reason",
    )


def groups(made: DataFrame) -> DataFrame:
    """A row a group: how many of its paths each decision has, and the bytes that removals would free."""

    def paths_with(test: Column) -> Column:
        return F.count_distinct(F.when(test, F.col("path_key")))

    d = F.col("decision")
    counts = made.groupBy("group_id", "size", "sha256").agg(
        F.min("relative_path").alias("sample_path"), F.count("*").alias("occurrences"), F.count_distinct("path_key").alias("recorded_paths"), paths_with(d == "KEEP").alias("keep_count"),
        paths_with((d == "KEEP") & ~F.col("has_error") & ~F.col("conflicting")).alias("keeper_count"), paths_with(d == "REMOVE").alias("remove_count"),
        paths_with(d == "UNDECIDED").alias("undecided_count"), paths_with(d == "UNRESOLVED").alias("unresolved_count"),
    )
    return counts.withColumn("candidate_bytes", (F.col("size").cast("decimal(19,0)") * F.col("remove_count").cast("decimal(18,0)")).cast(P.HUGE))


def summary(made: DataFrame) -> DataFrame:
    """One row for the whole plan; a path in several groups counts once, while bytes add up over groups."""
    each = groups(made).agg(
        F.count("*").alias("groups"), P.total(F.col("occurrences")).alias("observations"), P.total(F.col("size").cast("decimal(19,0)") * F.col("occurrences").cast("decimal(18,0)")).alias("observed_bytes"),
        P.total(F.col("candidate_bytes")).alias("candidate_bytes"),
    )
    d, key = F.col("decision"), F.col("path_key")
    unique = made.agg(
        F.count_distinct(key).alias("recorded_paths"), *[F.count_distinct(F.when(d == x, key)).alias(x.lower()) for x in DECISIONS]
    )
    return each.crossJoin(unique)  # one row each


def problems(made: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """code and count of each rule that a plan breaks; only UNRESOLVED_PATHS is a warning."""
    unsound = F.col("protected") | F.col("has_error") | F.col("conflicting") | ~F.col("matches_filters") | (F.col("size") < 0) | ~digest(F.col("sha256"))
    key = F.col("path_key")
    facts = made.agg(
        F.count_if((F.col("decision") == "REMOVE") & unsound).alias("UNSAFE_REMOVAL"), F.count_distinct(F.when(F.col("decision") == "UNDECIDED", key)).alias("UNDECIDED_DECISIONS"),
        F.count_distinct(F.when(F.col("conflicting") | F.col("has_error"), key)).alias("UNRESOLVED_PATHS"),
    )
    bare = groups(made).agg(F.count_if((F.col("remove_count") > 0) & (F.col("keeper_count") == 0)).alias("NO_RETAINED_CANDIDATE"))
    stale = made.limit(0).agg(F.count("*").alias("STALE_OVERRIDES")) if overrides is None else overrides.join(made, ["path_key", "group_id"], "left_anti").agg(F.count("*").alias("STALE_OVERRIDES"))
    codes = ["UNSAFE_REMOVAL", "NO_RETAINED_CANDIDATE", "UNDECIDED_DECISIONS", "STALE_OVERRIDES", "UNRESOLVED_PATHS"]
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("code"), F.col(c).alias("count")) for c in codes]))
    return facts.crossJoin(bare).crossJoin(stale).select(rows.alias("r")).select("r.code", "r.count").filter("count > 0")


def validation(made: DataFrame, overrides: DataFrame | None = None) -> dict:
    found = {r["code"]: r["count"] for r in problems(made, overrides).collect()}
    warnings = {k: v for k, v in found.items() if k == "UNRESOLVED_PATHS"}
    return {"valid": not (found.keys() - warnings.keys()), "errors": {k: v for k, v in found.items() if k not in warnings}, "warnings": warnings}


def fingerprint(inv: Inventory, config: dict, made: DataFrame | None = None) -> str:
    """Of everything a plan is made from; it changes whenever the plan's source does.  `made` are its decisions, if they are at hand."""
    plan = normal(config)
    made = decisions(inv, config) if made is None else made
    row = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(made.columns) if not c.endswith(("decision", "reason"))])), 256)
    # the rows' digests add up to one that does not depend on their order
    halves = [F.sum(F.conv(F.substring(row, at, 12), 16, 10).cast(P.HUGE)).cast("string") for at in (1, 13, 25, 37)]
    got = made.agg(F.count("*").cast("string"), *halves).first()
    return hashlib.sha256(json.dumps([plan, list(got)], sort_keys=True).encode()).hexdigest()


@contextmanager
def deadline(spark: SparkSession, seconds: float) -> Iterator[None]:
    """Jobs that this thread starts within are cancelled after so many seconds, and the work is refused."""
    context, tag, late = spark.sparkContext, f"deadline-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        while not over.wait(0.2):  # jobs that are started meanwhile, too
            context.cancelJobsWithTag(tag)

    over = threading.Event()
    timer = threading.Timer(seconds, stop)
    timer.daemon = True
    context.addJobTag(tag)
    timer.start()
    try:
        yield
    except Exception:
        if not late.is_set():
            raise
    finally:
        over.set()
        timer.cancel()
        context.removeJobTag(tag)
    if late.is_set():
        raise Refused("the plan took too long", "SCENARIO_TIMEOUT")


def generate(inv: Inventory, config: dict, overrides: DataFrame | None = None) -> dict:
    """The whole plan: decisions, groups, summary and validation; refused for unfinished scans and over its bounds.

    The decisions are made once and kept; all else is read from them.  After the plan's
    max_seconds its jobs are cancelled and it is refused.
    """
    plan = normal(config)
    ids = spec.group_search(plan["request"])["scan_ids"]
    with deadline(inv.spark, plan["max_seconds"]):
        chosen = inv.scans.filter(F.col("scan_id").isin(ids)).collect()
        if len(chosen) < len(ids):
            raise Refused("a scan is not there", "SCAN_NOT_FOUND")
        if any(r["phase"] not in duplicates.DONE for r in chosen):
            raise Refused("a scan is not finished", "SCENARIO_INCOMPLETE_SCANS")
        made = settle(decisions(inv, config, overrides))
        if made.count() > plan["max_occurrences"]:
            raise Refused("the plan has too many observations", "SCENARIO_LIMIT_EXCEEDED")
        return {"decisions": made, "groups": groups(made), "summary": summary(made).first().asDict(), "validation": validation(made, overrides), "source_fingerprint": fingerprint(inv, config, made)}
