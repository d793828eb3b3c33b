"""Control tables: tenants, schema versions, purges, status."""

from __future__ import annotations

import json
import os
import shutil
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import checked_part

#: Tenant states and the schema version of this package.
ACTIVE, DISABLED, TERMINATING, TERMINATED = range(4)
SCHEMA = 1


class Refused(ValueError):
    pass


class Registry:
    """Tenants and journals in one JSON file of the data root; a write replaces the file whole."""

    def __init__(self, data_root: str):
        self.root, self.path = data_root, os.path.join(data_root, "control.json")
        self.state = {"schema": SCHEMA, "tenants": {}, "journal": []}
        if os.path.exists(self.path):
            with open(self.path) as f:
                self.state = json.load(f)
        if self.state["schema"] > SCHEMA:
            raise Refused(f"schema {self.state['schema']} is newer than {SCHEMA}")

    def save(self) -> None:
        os.makedirs(self.root, exist_ok=True)
        with open(f"{self.path}.new", "w") as f:
            json.dump(self.state, f)
        os.replace(f"{self.path}.new", self.path)

    def see(self, tenant: str, now: int) -> dict:
        t = self.state["tenants"].setdefault(checked_part(tenant), {"status": ACTIVE, "schema": SCHEMA, "first_seen": now})
        t["last_seen"] = now
        self.save()
        return t

    def active(self) -> list[str]:
        return sorted(n for n, t in self.state["tenants"].items() if t["status"] == ACTIVE)

    def set_status(self, tenant: str, status: int) -> None:
        self.state["tenants"][tenant]["status"] = status
        self.save()

    def purge(self, tenant: str, folders: list[str], force: bool = False, now: int | None = None) -> int:
        """Removes the tenant's partitions (`<folder>/tenant_id=<t>` and `<folder>/tenant=<t>`) if it is terminating or forced."""
        t = self.state["tenants"].get(checked_part(tenant))
        if t is None or (t["status"] != TERMINATING and not force):
            raise Refused(f"tenant {tenant} is not terminating")
        gone = 0
        for folder in folders:
            for name in (f"tenant_id={tenant}", f"tenant={tenant}"):
                path = os.path.join(folder, name)
                if os.path.isdir(path) and not os.path.islink(path):
                    shutil.rmtree(path)
                    gone += 1
        t["status"] = TERMINATED
        self.state["journal"].append({"what": "purge", "tenant": tenant, "at": int(now if now is not None else time.time()), "folders": gone})
        self.save()
        return gone

    def migrate(self, tenant: str | None = None) -> list[str]:
        """Brings one tenant or all to SCHEMA; a newer one is refused."""
        names = [tenant] if tenant else sorted(self.state["tenants"])
        for n in names:
            if self.state["tenants"][n]["schema"] > SCHEMA:
                raise Refused(f"tenant {n} has a newer schema")
        moved = [n for n in names if self.state["tenants"][n]["schema"] < SCHEMA]
        for n in moved:
            self.state["tenants"][n]["schema"] = SCHEMA
            self.state["journal"].append({"what": "migrate", "tenant": n})
        self.save()
        return moved


def status(alerts: DataFrame) -> DataFrame:
    """Alerts by tenant and label with first and last window; the row with null tenant is over all."""
    got = alerts.rollup("tenant_id").agg(F.count("*").alias("alerts"), *[F.count_if(F.col("label") == c).alias(c) for c in ("outlier", "noise_suspect", "info")], F.min("window_start_ts").alias("first_ws"), F.max("window_end_ts").alias("last_we"))
    return got.orderBy(F.asc_nulls_first("tenant_id"))


def rates(before: dict[str, float], after: dict[str, float], seconds: float) -> dict[str, float]:
    """Growth of counters a second; one that shrank counts as 0."""
    return {k: max(0.0, after[k] - before.get(k, 0)) / seconds for k in after} if seconds > 0 else {}
