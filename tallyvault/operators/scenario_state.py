"""Plans as saved state: each change names the revision it was made from and publishes the next one at once."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvault import cursor, spec
from tallyvault.errors import InvalidScenario, Refused
from tallyvault.inventory import Inventory, Store
from tallyvault.operators import scenario
from tallyvault.schemas import SCHEMAS


class Scenarios:
    """Saved plans in a store of their own, over an inventory that is only read."""

    def __init__(self, store: Store, source: Inventory):
        self.store, self.source = store, source

    def _table(self, name: str) -> DataFrame:
        return getattr(self.store.load(), name)

    def get(self, id_: str, revision: int | None = None) -> dict:
        found = self._table("scenarios").filter(F.col("id") == id_).collect()
        if not found:
            raise Refused("no such plan", "NOT_FOUND")
        row = found[0].asDict()
        if revision is not None and row["revision"] != revision:
            raise Refused("the plan has changed meanwhile", "SCENARIO_REVISION_CONFLICT")
        return row

    def _put(self, row: dict, read: Inventory | None = None, **tables: DataFrame) -> dict:
        """Replace a plan's row, and with it whole tables that were made from what was read; nothing is seen before both are written."""
        read = self.store.load() if read is None else read
        new = self.store.spark.createDataFrame([tuple(row[c] for c in SCHEMAS["scenarios"].names)], SCHEMAS["scenarios"])
        rest = read.scenarios.filter(F.col("id") != row["id"])
        self.store.save(revision=read.revision, scenarios=rest.unionByName(new), **tables)
        return row

    def create(self, name: str, config: dict) -> dict:
        now = datetime.now(timezone.utc)
        if not name.strip() or len(name) > 200:
            raise InvalidScenario("a plan needs a name of 1 to 200 characters")
        body = json.dumps(scenario.normal(config), sort_keys=True)
        return self._put({"id": str(uuid.uuid4()), "name": name, "config_json": body, "status": "DRAFT", "revision": 1, "generation_id": None, "snapshot_json": None, "created_at": now, "updated_at": now})

    def update(self, id_: str, revision: int, name: str | None = None, config: dict | None = None) -> dict:
        """A change makes the plan a draft again; its last generation stays until the next."""
        row = self.get(id_, revision)
        body = row["config_json"] if config is None else json.dumps(scenario.normal(config), sort_keys=True)
        return self._put(row | {"name": name or row["name"], "config_json": body, "status": "DRAFT", "revision": revision + 1, "updated_at": datetime.now(timezone.utc)})

    def delete(self, id_: str, revision: int) -> None:
        self.get(id_, revision)
        inv = self.store.load()
        tables = {t: getattr(inv, t).filter(F.col("scenario_id") != id_) for t in ("scenario_decisions", "scenario_groups", "scenario_overrides")}
        self.store.save(revision=inv.revision, scenarios=inv.scenarios.filter(F.col("id") != id_), **tables)

    def overrides(self, id_: str) -> DataFrame:
        return self._table("scenario_overrides").filter(F.col("scenario_id") == id_)

    def generate(self, id_: str, revision: int) -> dict:
        """Plan anew; the plan is ready if nothing is wrong with it.  A failure leaves the last generation as it was."""
        row = self.get(id_, revision)
        made = scenario.generate(self.source, json.loads(row["config_json"]), self.overrides(id_))
        generation = str(uuid.uuid4())
        inv = self.store.load()
        tables = {}
        for t, df in (("scenario_decisions", made["decisions"]), ("scenario_groups", made["groups"])):
            own = df.withColumn("scenario_id", F.lit(id_)).withColumn("generation_id", F.lit(generation)).select(*SCHEMAS[t].names)
            tables[t] = getattr(inv, t).filter(F.col("scenario_id") != id_).unionByName(own)
        snapshot = {"summary": made["summary"], "validation": made["validation"], "source_fingerprint": made["source_fingerprint"]}
        status = "READY" if made["validation"]["valid"] else "DRAFT"
        return self._put(row | {"generation_id": generation, "snapshot_json": json.dumps(snapshot), "status": status, "revision": revision + 1, "updated_at": datetime.now(timezone.utc)}, inv, **tables)

    def validate(self, id_: str) -> dict:
        """The saved generation's validation, and whether its source has changed since."""
        row = self.get(id_)
        if row["generation_id"] is None:
            raise Refused("the plan was never generated", "SCENARIO_NOT_GENERATED")
        found = scenario.validation(self.decisions(id_), self.overrides(id_))
        changed = scenario.fingerprint(self.source, json.loads(row["config_json"])) != json.loads(row["snapshot_json"])["source_fingerprint"]
        return found | {"valid": found["valid"] and not changed, "source_changed": changed}

    def override(self, id_: str, revision: int, choices: list[dict]) -> dict:
        """Manual decisions (path_key, group_id, decision) of the saved generation; AUTO takes one back."""
        if not 1 <= len(choices) <= scenario.MOST_OVERRIDES or any(c["decision"] not in (*scenario.DECISIONS, "AUTO") for c in choices):
            raise InvalidScenario("1 to 100 decisions are needed")
        row = self.get(id_, revision)
        now = datetime.now(timezone.utc)
        new = self.store.spark.createDataFrame([(id_, c["path_key"], c["group_id"], c["decision"], now) for c in choices], SCHEMAS["scenario_overrides"])
        if not new.join(self.decisions(id_), ["path_key", "group_id"], "left_anti").isEmpty():
            raise Refused("a path is not in the plan", "STALE_SCENARIO")
        kept = self._table("scenario_overrides").join(F.broadcast(new.select("scenario_id", "path_key", "group_id")), ["scenario_id", "path_key", "group_id"], "left_anti")
        return self._put(row | {"status": "DRAFT", "revision": revision + 1, "updated_at": now}, scenario_overrides=kept.unionByName(new.filter("decision <> 'AUTO'")))

    def reset(self, id_: str, revision: int) -> dict:
        row = self.get(id_, revision)
        rest = self._table("scenario_overrides").filter(F.col("scenario_id") != id_)
        return self._put(row | {"status": "DRAFT", "revision": revision + 1, "updated_at": datetime.now(timezone.utc)}, scenario_overrides=rest)

    def listed(self, limit: int | None = None) -> DataFrame:
        rows = self._table("scenarios").withColumn("sort_key", F.lower("name"))
        return cursor.page(rows, [(F.col(c), False) for c in ("sort_key", "name", "id")], spec.page_size(limit))

    def _generation(self, table: str, id_: str) -> DataFrame:
        live = self.get(id_)["generation_id"]
        return self._table(table).filter((F.col("scenario_id") == id_) & F.col("generation_id").eqNullSafe(F.lit(live)))

    def decisions(self, id_: str) -> DataFrame:
        return self._generation("scenario_decisions", id_)

    def group_page(self, id_: str, limit: int | None = None, position: list | None = None) -> DataFrame:
        return cursor.page(self._generation("scenario_groups", id_), [(F.col("size"), True), (F.col("sha256"), False)], spec.page_size(limit), position)

    def decision_page(self, id_: str, group_id: str, limit: int | None = None, position: list | None = None) -> DataFrame:
        """A page of a group's decisions, each with the manual decision that waits for the next generation."""
        waiting = self.overrides(id_).select("path_key", "group_id", F.col("decision").alias("pending"))
        rows = self.decisions(id_).filter(F.col("group_id") == group_id).join(waiting, ["path_key", "group_id"], "left")
        return cursor.page(rows, [(F.col(c), False) for c in ("path_key", "scan_id", "entry_id")], spec.page_size(limit), position)
