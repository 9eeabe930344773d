"""The API as a façade: open tables, steps in the background, queries, exports; plain data in and out."""

from __future__ import annotations

import json
import os
import re
import shutil
import tempfile
import threading
import time
import uuid

from pyspark import InheritableThread
from pyspark.sql import SparkSession

from gridlens.operators import crosstab, rows
from gridlens.plans.pivot import AGGREGATIONS
from gridlens.session import activate, prepared
from gridlens.sinks.jobs import KEPT_SECONDS, Exports
from gridlens.sources import parquet

MOST_RECENT, MOST_LISTED, MOST_PAGE, MOST_VALUES, VALUES = 12, 500, 1000, 2000, 300


class Conflict(Exception):
    """Asked for too early."""


def status_of(error: Exception) -> int:
    if isinstance(error, (KeyError, FileNotFoundError)):
        return 404
    return 409 if isinstance(error, Conflict) else 400 if isinstance(error, ValueError) else 500


class Steps:
    """A piece of background work that tells its steps and how long each took."""

    def __init__(self, spark: SparkSession, work):
        self.spark = spark
        self.id, self.status, self.result, self.error = uuid.uuid4().hex[:12], "running", None, None
        self.steps: list[dict] = []
        self.at = time.time()
        self.thread = InheritableThread(target=self._run, args=(work,), daemon=True)
        self.thread.start()

    def tell(self, text: str) -> None:
        self._end()
        self.steps.append({"message": text, "seconds": None})

    def _end(self) -> None:
        now = time.time()
        if self.steps:
            self.steps[-1]["seconds"] = round(now - self.at, 2)
        self.at = now

    def _run(self, work) -> None:
        activate(self.spark)
        try:
            self.result, self.status = work(self.tell), "done"
        except Exception as error:  # noqa: BLE001 - told to the user
            self.error, self.status = str(error), "error"
        self._end()

    def told(self) -> dict:
        return {"id": self.id, "status": self.status, "steps": self.steps, "result": self.result, "error": self.error}


class Service:
    """One session's tables, jobs and recents."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = prepared(spark), folder or tempfile.mkdtemp(prefix="gridlens-")
        os.makedirs(self.folder, exist_ok=True)
        self.tables: dict[str, parquet.Dataset] = {}
        self.steps: dict[str, Steps] = {}
        self.exports = Exports(spark, os.path.join(self.folder, "exports"))
        self.lock = threading.Lock()

    # Tables

    def get(self, table_id: str) -> parquet.Dataset:
        if table_id not in self.tables:
            raise KeyError("That dataset is no longer open")
        return self.tables[table_id]

    def _kept(self, data: parquet.Dataset) -> dict:
        self.tables[data.id] = data
        if not data.is_temp and isinstance(data.path, str):
            self._remember(data.path)
        return data.told()

    def open(self, path: str, progress=None) -> dict:
        return self._kept(parquet.open_path(self.spark, path, progress=progress))

    def union(self, paths: list[str], source_column: bool = True, progress=None) -> dict:
        return self._kept(parquet.open_union(self.spark, paths, source_column, progress))

    def open_start(self, path: str | None = None, paths: list[str] | None = None, source_column: bool = True) -> dict:
        return self._started(lambda tell: self.union(paths, source_column, tell) if paths else self.open(path or "", tell))

    def _started(self, work) -> dict:
        for old in [k for k, j in self.steps.items() if j.status != "running" and time.time() - j.at > KEPT_SECONDS]:
            del self.steps[old]
        job = Steps(self.spark, work)
        self.steps[job.id] = job
        return job.told()

    def step(self, job_id: str) -> dict:
        if job_id not in self.steps:
            raise KeyError("Unknown job")
        return self.steps[job_id].told()

    def upload(self, name: str, data) -> dict:
        if not name.lower().endswith(".parquet"):
            raise ValueError("Only .parquet files can be uploaded")
        path = os.path.join(tempfile.mkdtemp(dir=self.folder), os.path.basename(name))
        with open(path, "wb") as out:
            shutil.copyfileobj(data, out) if hasattr(data, "read") else out.write(data)
        try:
            return self._kept(parquet.open_path(self.spark, path, True, os.path.basename(name)))
        except Exception:
            os.remove(path)
            raise

    def close(self, table_id: str) -> dict:
        data = self.tables.pop(table_id, None)
        if data and data.is_temp and os.path.exists(data.path):
            os.remove(data.path)
        return {"closed": True}

    # Places

    @property
    def _recents(self) -> str:
        return os.path.join(self.folder, "recents.json")

    def recents(self) -> list[str]:
        try:
            with open(self._recents) as f:
                paths = json.load(f)
        except (OSError, ValueError):
            return []
        return [p for p in paths if os.path.exists(p)]

    def _remember(self, path: str) -> None:
        with self.lock:
            paths = list(dict.fromkeys([path, *self.recents()]))[:MOST_RECENT]
            with open(self._recents, "w") as f:
                json.dump(paths, f)

    def browse(self, path: str = "~") -> dict:
        path = os.path.abspath(os.path.expanduser(path.strip() or "~"))
        if not os.path.isdir(path):
            raise FileNotFoundError(f"No such folder: {path}")
        items = []
        with os.scandir(path) as entries:
            for e in sorted(entries, key=lambda e: (not e.is_dir(), e.name.lower())):
                if not e.name.startswith(".") and (e.is_dir() or e.name.lower().endswith(".parquet")):
                    items.append({"name": e.name, "path": e.path, "is_dir": e.is_dir(), "size": 0 if e.is_dir() else e.stat().st_size})
        return {"path": path, "parent": os.path.dirname(path), "entries": items[:MOST_LISTED], "truncated": len(items) > MOST_LISTED}

    # Queries

    def preview(self, dataset_id: str, filters=(), columns=None, limit=10, offset=0, order_by=None, descending=False, transforms=None) -> dict:
        return rows.preview(self.get(dataset_id), filters, columns, max(1, min(int(limit), MOST_PAGE)), max(0, int(offset)), order_by, descending, transforms)

    def count(self, dataset_id: str, filters=()) -> dict:
        return {"count": rows.count(self.get(dataset_id), filters)}

    def values(self, dataset_id: str, column: str, filters=(), search="", limit=VALUES, exact=None, transform=None, date_format=None) -> dict:
        return rows.distinct_values(self.get(dataset_id), column, filters, search, max(1, min(int(limit), MOST_VALUES)), exact, transform, date_format)

    def stats(self, dataset_id: str, column: str, filters=(), transform=None, date_format=None) -> dict:
        return rows.column_stats(self.get(dataset_id), column, filters, transform, date_format)

    def aggregations(self) -> list[dict]:
        return [{"agg": k, "label": verb, "categories": allowed, "is_count": whole} for k, (verb, allowed, whole) in AGGREGATIONS.items()]

    def pivot(self, dataset_id: str, progress=None, **spec) -> dict:
        spec.pop("repeat_labels", None)
        return crosstab.compute(self.get(dataset_id), progress=progress, **spec)

    def pivot_start(self, dataset_id: str, **spec) -> dict:
        self.get(dataset_id)
        return self._started(lambda tell: self.pivot(dataset_id, tell, **spec))

    def export(self, dataset_id: str, format: str = "xlsx", **spec) -> dict:
        return self.exports.start(self.get(dataset_id), format, **spec).told()

    def pivot_export(self, dataset_id: str, sheet_name="Pivot", include_manifest=True, **spec) -> dict:
        return self.exports.start_pivot(self.get(dataset_id), spec, sheet_name, include_manifest).told()

    def download(self, job_id: str) -> tuple[str, str]:
        """(path, file name) of a finished export."""
        job = self.exports.get(job_id)
        if job.status != "done":
            raise Conflict("The export isn't ready")
        return job.path, job.filename

    # Requests

    ROUTES = [
        ("GET", "/api/recents", lambda s, m, b: s.recents()),
        ("GET", "/api/browse", lambda s, m, b: s.browse(**b)),
        ("POST", "/api/open", lambda s, m, b: s.open(**b)),
        ("POST", "/api/union", lambda s, m, b: s.union(**b)),
        ("POST", "/api/open/start", lambda s, m, b: s.open_start(**b)),
        ("GET", "/api/open/([^/]+)", lambda s, m, b: s.step(m[1])),
        ("POST", "/api/upload", lambda s, m, b: s.upload(**b)),
        ("GET", "/api/dataset/([^/]+)", lambda s, m, b: s.get(m[1]).told()),
        ("DELETE", "/api/dataset/([^/]+)", lambda s, m, b: s.close(m[1])),
        ("POST", "/api/preview", lambda s, m, b: s.preview(**b)),
        ("POST", "/api/count", lambda s, m, b: s.count(**b)),
        ("POST", "/api/values", lambda s, m, b: s.values(**b)),
        ("POST", "/api/stats", lambda s, m, b: s.stats(**b)),
        ("GET", "/api/pivot/aggregations", lambda s, m, b: s.aggregations()),
        ("POST", "/api/pivot", lambda s, m, b: s.pivot(**b)),
        ("POST", "/api/pivot/start", lambda s, m, b: s.pivot_start(**b)),
        ("GET", "/api/pivot/job/([^/]+)", lambda s, m, b: s.step(m[1])),
        ("POST", "/api/pivot/export", lambda s, m, b: s.pivot_export(**b)),
        ("POST", "/api/export", lambda s, m, b: s.export(**b)),
        ("GET", "/api/export/([^/]+)", lambda s, m, b: s.exports.get(m[1]).told()),
        ("POST", "/api/export/([^/]+)/cancel", lambda s, m, b: s.exports.cancel(m[1]).told()),
        ("GET", "/api/export/([^/]+)/download", lambda s, m, b: s.download(m[1])),
    ]

    def handle(self, method: str, path: str, body: dict | None = None) -> tuple[int, object]:
        """(status, answer) of a request; errors answer with {detail}."""
        for verb, pattern, call in self.ROUTES:
            m = re.fullmatch(pattern, path)
            if verb == method and m:
                try:
                    return 200, call(self, m, body or {})
                except TypeError as error:
                    return (400 if "argument" in str(error) else 500), {"detail": str(error)}
                except Exception as error:  # noqa: BLE001 - mapped to a status
                    return status_of(error), {"detail": str(error.args[0]) if isinstance(error, KeyError) and error.args else str(error)}
        return 404, {"detail": "Not found"}
