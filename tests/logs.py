"""Small logs written as Parquet and opened on both sides."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from cohortry.functions.vocabulary import MILESTONES, VOCABULARY, case_variants
from cohortry.sources.tables import read_accounts, read_activity

ACTIVITY = pa.schema([
    ("event_id", pa.int64()), ("store_client_id", pa.int64()), ("store_name", pa.string()),
    ("action", pa.string()), ("page", pa.string()), ("created_at", pa.timestamp("us")),
])
ACCOUNT = pa.schema([
    ("store_client_id", pa.int64()), ("store_name", pa.string()), ("shop_plan", pa.string()),
    ("plan_display_name", pa.string()), ("created_on", pa.timestamp("us")),
    ("charge_approve", pa.string()), ("status", pa.string()), ("email", pa.string()),
])
OLD = datetime(2025, 6, 1)
NEW = datetime(2026, 2, 3)


def account(store: int, created_on: datetime = NEW, **columns) -> dict:
    row = {
        "store_client_id": store, "store_name": f"shop-{store}", "shop_plan": "Basic",
        "plan_display_name": "Basic", "created_on": created_on, "charge_approve": "1",
        "status": "1", "email": f"u{store}@shop.example",
    }
    return row | columns


def event(store: int, action: str, at: datetime, page: str | None = "home") -> dict:
    return {"store_client_id": store, "store_name": f"shop-{store}", "action": action,
            "page": page, "created_at": at}


class Log:
    """One log and its accounts, as Spark frames and as DuckDB views."""

    def __init__(self, spark, folder, events: list[dict], accounts: list[dict]):
        folder.mkdir(parents=True, exist_ok=True)
        events = [e | {"event_id": i} for i, e in enumerate(events)]
        self.paths = {"activity": str(folder / "activity.parquet"),
                      "account": str(folder / "account.parquet")}
        pq.write_table(pa.Table.from_pylist(events, ACTIVITY), self.paths["activity"])
        pq.write_table(pa.Table.from_pylist(accounts, ACCOUNT), self.paths["account"])
        self.activity = read_activity(spark, self.paths["activity"])
        self.accounts = read_accounts(spark, self.paths["account"], check=False)
        self.duck = duckdb.connect()
        for name, path in self.paths.items():
            self.duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")


def random_log(seed: int, stores: int = 700) -> tuple[list[dict], list[dict]]:
    """Stores with short random histories: ties, mixed case, page-only churn, NULLs, month edges."""
    rng = random.Random(seed)
    spellings = [
        s for cls in [*VOCABULARY.values(), *MILESTONES.values()] for s in case_variants(cls.actions)
    ] + ["something else"]
    spellings += ["".join(rng.choice((c.lower(), c.upper())) for c in s) for s in spellings]
    frequent = ["fresh_install", "Re-installs", "uninstall", "Store closed", "reopen",
                "Paid uninstalled", "Free Plan", "Charge Approved", "Free User", "Plan Upgraded",
                "During trial", "Onboarding completed"]
    pages = [None, "home", "uninstall", "UNINSTALL_APP", "Fresh Installs page", "re-installs"]
    edges = [datetime(2026, 1, 31, 18, 30), datetime(2026, 2, 28, 18, 30), datetime(2026, 3, 1, 8)]
    events, accounts = [], []
    for store in range(stores):
        plan = rng.choice(["Basic", "Pro", "Staff", "frozen", "My Development", None, "Trial"])
        accounts.append(account(
            store,
            created_on=rng.choice([OLD, NEW, datetime(2026, 1, 31, 18, 30), datetime(2026, 3, 9),
                                   datetime(2026, 2, 28, 18, 29, 59, 999999)]),
            shop_plan=plan if rng.random() < 0.3 else "Basic",
            plan_display_name=rng.choice(["Basic", "Pro", None, "staff", "Development shop"])
            if rng.random() < 0.4 else "Basic",
            charge_approve=rng.choice(["0", "1", "2", None]),
            status=rng.choice(["0", "1"]),
            email=rng.choice([None, "a@shop.example", "b@internal.example"]),
        ))
        for _ in range(rng.randint(1, 14)):
            at = datetime(2026, 1, 10) + timedelta(days=rng.randint(0, 70), hours=6 * rng.randint(0, 3))
            if rng.random() < 0.15:
                at = rng.choice(edges) + timedelta(microseconds=rng.choice([-1, 0, 1]))
            if events and events[-1]["store_name"] == f"shop-{store}" and rng.random() < 0.2:
                at = events[-1]["created_at"]
            action = rng.choice(frequent) if rng.random() < 0.75 else rng.choice(spellings)
            page = rng.choice(pages) if rng.random() < 0.3 else "home"
            if action.lower() in ("fresh_install", "re-installs") and rng.random() < 0.6:
                page = {"f": "Fresh Installs page", "r": "re-installs"}[action[0].lower()]
            events.append(event(store, action, at, page))
            if len(events) % 17 == 0:  # an id the store had before
                events[-1]["store_client_id"] = 10**7 + store
    events.append(event(10**6, "fresh_install", NEW))  # a store without an account
    return events, accounts
