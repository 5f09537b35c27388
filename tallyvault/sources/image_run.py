"""The disk images of a scan, analysed: found by name, their headers read and components resolved, and what a provider says of them published.

What is inside an image comes from a provider (see `image_headers.Provider`), which needs
tools that are not here.  Components, fingerprints, the reuse of earlier results and the
publishing do not hang on it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvault.errors import InvalidInventory, Refused
from tallyvault.functions import paths
from tallyvault.inventory import Inventory, Store, scan
from tallyvault.operators import images
from tallyvault.schemas import SCHEMAS
from tallyvault.sources import hashing
from tallyvault.sources.image_headers import Provider, described, read_ends
from tallyvault.storage import settle

MOST_DEPTH = 32
DETAIL = ("image_partitions", "image_filesystems", "image_entries", "image_errors")
_HEADS = "source_id long, found string, virtual_size long, encrypted boolean, needs array<string>, roles array<string>, problem string"
_PARTS = "root long, ordinal long, parent_ordinal long, role string, source_id long, problem string"


def heads(jobs: DataFrame, root: str) -> DataFrame:
    """What each image's header says: its format, size, and the files that it is built on, as paths of the scan."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for id_, path, size in zip(batch["source_id"], batch["relative_path"], batch["size"], strict=True):
                folder = path.rpartition("/")[0]
                try:
                    h = described(*read_ends(f"{root.rstrip('/')}/{path}", int(size)))
                except OSError as e:
                    out.append((id_, None, None, False, [], [], f"{type(e).__name__}: {e.strerror}"))
                    continue
                named = [(h["backing"], "BACKING")] * bool(h["backing"]) + [(x, "EXTENT") for x in h["extents"]]
                within = [(x[len(root.rstrip("/")) + 1 :] if x.startswith(root.rstrip("/") + "/") else x if x.startswith("/") else f"{folder}/{x}".lstrip("/"), role) for x, role in named]
                out.append((id_, h["format"], h["virtual_size"], h["encrypted"], [x for x, _ in within], [r for _, r in within], h["error"] or ("ENCRYPTED" if h["encrypted"] else None)))
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in _HEADS.split(", ")])
            yield frame.astype({"virtual_size": "Int64"})

    return jobs.select("source_id", "relative_path", "size").mapInPandas(run, _HEADS)


def components(files: DataFrame, read: DataFrame) -> DataFrame:
    """For each image (root) the images that it is made of, first needed first: ordinal, parent, role and file; or the problem.

    `files` has source_id and relative_path.  The needs of each root are followed level by
    level over all images at once; then each root's own few are put in order.
    """
    needs = settle(read.select("source_id", F.explode(F.arrays_zip("needs", "roles")).alias("n")).select("source_id", F.col("n.needs").alias("relative_path"), F.col("n.roles").alias("role")).join(files.select("relative_path", F.col("source_id").alias("other")), "relative_path", "left"))
    edges = read.select(F.col("source_id").alias("root"), F.col("source_id").alias("at"))
    reached = edges
    for _ in range(MOST_DEPTH + 1):
        edges = edges.join(needs.filter("other is not null").select(F.col("source_id").alias("at"), "other"), "at").select("root", F.col("other").alias("at")).distinct()
        edges = settle(edges.join(reached, ["root", "at"], "left_anti"))
        if edges.isEmpty():
            break
        reached = settle(reached.unionByName(edges))
    own = reached.join(needs.select(F.col("source_id").alias("at"), "other", "relative_path", "role"), "at", "left")

    def ordered(group: pd.DataFrame) -> pd.DataFrame:
        root = int(group["root"].iloc[0])
        lists: dict[str, list[str]] = {}
        roles, missing = {}, None
        for at, other, path, role in zip(group["at"], group["other"], group["relative_path"], group["role"], strict=True):
            if role is None or pd.isna(role):
                continue
            if pd.isna(other):
                missing = f"MISSING_COMPONENT: {path}"
                continue
            lists.setdefault(str(int(at)), []).append(str(int(other)))
            roles[str(int(at)), str(int(other))] = role
        try:
            found = images.resolved(str(root), {k: sorted(set(v), key=int) for k, v in lists.items()}, deepest=MOST_DEPTH)
        except InvalidInventory as e:
            found, missing = [(0, -1, str(root))], str(e)
        out = [(root, o, p, "PRIMARY" if p < 0 else roles[found[p][2], name], int(name), missing) for o, p, name in found]
        return pd.DataFrame(out, columns=["root", "ordinal", "parent_ordinal", "role", "source_id", "problem"])

    return own.groupBy("root").applyInPandas(ordered, _PARTS)


def _fitted(rows: DataFrame, table: str, **columns) -> DataFrame:
    return rows.select(*[(columns[f.name] if f.name in columns else F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMAS[table].fields])


def analysed(inv: Inventory, name: str, provider: Provider, provider_name: str, policy: str = "default", when: str = "candidate") -> dict[str, DataFrame]:
    """The image tables of a scan: its run, all its jobs, and what is new of results and below.

    An image that another is built on is a component, not a job of its own.  Images of one
    fingerprint are asked for once, and not at all if an earlier complete result has it.
    """
    own = scan(inv, name)
    id_ = own["scan_id"]
    if not inv.scans.filter((F.col("scan_id") == id_) & (paths.style(F.col("root")) != paths.POSIX)).isEmpty():
        raise Refused("the scan's root is of another system", "FOREIGN_ROOT")
    mine = F.col("scan_id") == id_
    found = settle(images.identified(inv, id_).unionByName(inv.image_jobs.filter(mine & (F.col("state") == "PENDING")).select("scan_id", "source_id", "relative_path", "format", "size", "modified_sec", "modified_nano", "state")))
    files = found.unionByName(inv.image_jobs.filter(mine & (F.col("state") != "PENDING")).select(*found.columns))
    read = settle(heads(found, own["root"]))
    parts = settle(components(files, read))
    used = parts.filter("ordinal > 0").groupBy(F.col("source_id")).agg(F.min("root").alias("component_of"))
    gate = images.to_hash(files, when).filter("hash").select("source_id")
    stored = inv.hashes.filter(mine)
    wanted = parts.join(gate.withColumnRenamed("source_id", "root"), "root", "left_semi").select("source_id").distinct()
    bare = files.join(wanted, "source_id", "left_semi").withColumnRenamed("source_id", "entry_id").join(stored, ["scan_id", "entry_id"], "left_anti")
    digests = settle(stored.select("entry_id", "sha256").unionByName(hashing.hashed(bare.select("scan_id", "entry_id", "relative_path", "size", "modified_sec", F.col("modified_nano").cast("int").alias("modified_nano")), inv.scans.filter(mine))[0].select("entry_id", "sha256")))
    facts = files.select("source_id", "relative_path", "size", "modified_sec", "modified_nano", "format").join(read.select("source_id", "found"), "source_id", "left").withColumn("format", F.coalesce("found", "format")).drop("found")
    full = settle(parts.join(facts, "source_id").join(digests.withColumnRenamed("entry_id", "source_id"), "source_id", "left").join(gate.select(F.col("source_id").alias("root"), F.lit(True).alias("hash")), "root", "left"))

    def printed(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values("ordinal").to_dict("records")
        contents = bool(rows[0]["hash"] is True) and all(isinstance(r["sha256"], str) for r in rows)
        return pd.DataFrame({"root": [rows[0]["root"]], "fingerprint": [images.set_fingerprint(rows, contents)], "contents": [contents]})

    prints = full.groupBy("root").applyInPandas(printed, "root long, fingerprint string, contents boolean")
    problems = parts.groupBy("root").agg(F.max("problem").alias("part_problem"))
    fate = found.join(used, "source_id", "left").join(read.select("source_id", "virtual_size", "problem"), "source_id", "left").join(problems.withColumnRenamed("root", "source_id"), "source_id", "left").join(prints.withColumnRenamed("root", "source_id"), "source_id", "left")
    fate = settle(fate.withColumn("diagnostic", F.coalesce("problem", "part_problem")).withColumn("policy", F.lit(policy)).withColumn("provider", F.lit(provider_name)))
    # without contents two images of one shape are not known to be equal
    usable = fate.filter("component_of is null and diagnostic is null").withColumn("key", F.when(F.col("contents"), F.col("fingerprint")).otherwise(F.concat_ws("/", "fingerprint", F.col("source_id").cast("string"))))
    cached = images.cached(usable.filter("contents").select("fingerprint", "provider", "policy").distinct(), inv.image_results).select("fingerprint", F.col("result_id").alias("cached_id"))
    run = uuid.uuid4().hex
    firsts = usable.groupBy("key").agg(F.min("source_id").alias("first_id"))
    h = F.md5(F.concat_ws("/", F.lit(run), "key"))
    made = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    asked = settle(usable.join(firsts, "key").join(cached, "fingerprint", "left").withColumn("made_id", made))
    fresh = settle(asked.filter("cached_id is null and source_id = first_id"))
    rows = {t: settle(_provided(fresh, provider, t)) for t in DETAIL}
    wrong = rows["image_errors"].groupBy("result_id").count().select(F.col("result_id").alias("made_id"), F.lit("PARTIAL").alias("ended"))
    now = F.current_timestamp()
    state = F.coalesce(F.col("ended"), F.lit("COMPLETE"))
    results = fresh.join(wrong, "made_id", "left").withColumn("state", state)
    ended = asked.join(wrong, "made_id", "left").withColumn("result_id", F.coalesce("cached_id", "made_id")).withColumn("state", F.when(F.col("cached_id").isNotNull(), "COMPLETE").otherwise(state))
    finished = ended.select("scan_id", "source_id", "state", "result_id", (F.col("cached_id").isNotNull() | (F.col("source_id") != F.col("first_id"))).alias("duplicate"), (F.col("state") == "PARTIAL").alias("retryable"))
    bare_jobs = _fitted(fate, "image_jobs", state=F.when(F.col("component_of").isNotNull(), "COMPONENT").when(F.col("diagnostic").isNotNull(), "PARTIAL").otherwise("PENDING"), duplicate=F.lit(False), retryable=F.lit(False))
    jobs = settle(images.published(bare_jobs, finished).unionByName(inv.image_jobs.filter(mine & (F.col("state") != "PENDING")).select(*SCHEMAS["image_jobs"].names)))
    some = not jobs.filter("state = 'PARTIAL' or diagnostic is not null").isEmpty()
    return {
        "image_runs": inv.spark.createDataFrame([(id_, "COMPLETE_WITH_ERRORS" if some else "COMPLETE")], SCHEMAS["image_runs"]), "image_jobs": jobs,
        "image_results": _fitted(results, "image_results", result_id=F.col("made_id"), signature=F.when(F.col("contents"), F.col("fingerprint")), reusable=(F.col("state") == "COMPLETE") & F.col("contents"), retryable=F.col("state") == "PARTIAL", started_at=now, completed_at=now),
        "image_components": _fitted(full.join(fresh.select(F.col("source_id").alias("root"), "made_id"), "root"), "image_components", result_id=F.col("made_id")),
        **{t: _fitted(rows[t], t) for t in DETAIL},
    }


def _provided(fresh: DataFrame, provider: Provider, table: str) -> DataFrame:
    """What the provider says of each new result, one image at a time in its own task."""
    schema = SCHEMAS[table]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for result, path in zip(batch["made_id"], batch["relative_path"], strict=True):
                told = [r | {"result_id": result} for r in provider.rows(table, path)]
                out = pd.DataFrame(told, columns=schema.names, dtype=object)
                yield out.astype({f.name: "Int64" for f in schema.fields if f.dataType.simpleString() in ("bigint", "int")})

    return fresh.select("made_id", "relative_path").mapInPandas(run, schema)


def publish(store: Store, name: str, provider: Provider, provider_name: str, policy: str = "default", when: str = "candidate") -> str:
    """Analyse a scan's images and save what was found, at once; the phase of the run."""
    inv = store.load()
    made = {t: settle(df) for t, df in analysed(inv, name, provider, provider_name, policy, when).items()}
    added = tuple(t for t in made if t not in ("image_runs", "image_jobs"))
    store.save(None, scan(inv, name)["scan_id"], added, base=inv.revision, **made)
    return made["image_runs"].first()["phase"]
