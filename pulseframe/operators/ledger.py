"""Label edits as an append-only table with undo, redo and provenance.

An edit row is ``version, point_id, field, before, after``; only changed values
are recorded.  Flags are stored as 0 / 1.  The current state is the base table
plus the newest value per point and field over the versions that are active.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulseframe.functions.scalar import canonical_name, finite_or_null
from pulseframe.schema import PROTECTED_EXACT

FIELDS = ("is_ground", "working_class", "trusted_class", "archaeology_class")


class StaleResult(ValueError):
    """A derived result was made from an older ground revision."""


def init_labels(df: DataFrame) -> DataFrame:
    """Original class := class or 0, working := original, nothing trusted, no ground yet."""
    original = F.coalesce(finite_or_null("classification").cast("int"), F.lit(0))
    return df.withColumns({"original_class": original, "working_class": original,
                           "trusted_class": F.lit(None).cast("int"), "is_ground": F.lit(False),
                           "archaeology_class": F.lit(0)})


def _edits(state: DataFrame, version: int, after: dict[str, Column]) -> DataFrame:
    """Edit rows for the fields whose new value differs from the current one (NULL-safe)."""
    changes = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("int").alias("before"), a.cast("int").alias("after"))
                        for f, a in after.items()])
    return (state.select("point_id", F.explode(changes).alias("c")).select(F.lit(version).alias("version"), "point_id", "c.*")
            .where(~F.col("before").eqNullSafe(F.col("after"))))


def _in(ids: DataFrame | None, state: DataFrame) -> DataFrame:
    return state if ids is None else state.join(ids.select("point_id"), "point_id", "left_semi")


def _code(code: int) -> int:
    if not (isinstance(code, int) and 0 <= code <= 255):
        raise ValueError("a class code is an integer 0..255")
    return code


def ground_edits(state: DataFrame, preview: str, version: int, *, selection: DataFrame | None = None) -> DataFrame:
    """Apply a ground preview (>= 0.5): mask and working class move together."""
    state = _in(selection, state)
    ground = F.coalesce(F.col(preview).cast("double") >= 0.5, F.lit(False))
    working = F.when(ground, 2).when(F.col("working_class") == 2, 1).otherwise(F.col("working_class"))
    return _edits(state, version, {"is_ground": ground, "working_class": working})


def manual_edits(state: DataFrame, ids: DataFrame, code: int, version: int) -> DataFrame:
    """Manual label: working and trusted class, ground mask in step with class 2."""
    code = _code(code)
    return _edits(_in(ids, state), version, {
        "working_class": F.lit(code), "trusted_class": F.lit(code), "is_ground": F.lit(code == 2)})


def archaeology_edits(state: DataFrame, ids: DataFrame, value: int, version: int) -> DataFrame:
    """Set (or with 0 clear) the archaeology class 0..12 of the chosen points."""
    if not 0 <= value <= 12:
        raise ValueError("archaeology classes are 0..12")
    return _edits(_in(ids, state), version, {"archaeology_class": F.lit(value)})


def trust_edits(state: DataFrame, source: str, version: int, *, selection: DataFrame | None = None) -> DataFrame:
    """Integer values 0..255 of a column become working and trusted class."""
    v = finite_or_null(source)
    rows = _in(selection, state).where((v >= 0) & (v <= 255) & (v == F.floor(v)))
    return _edits(rows, version, {"working_class": v, "trusted_class": v})


def prediction_edits(state: DataFrame, version: int, min_confidence: float = 0.0, *, selection: DataFrame | None = None,
                     ground_locked: bool = True, ground_revision: int | None = None, current_revision: int | None = None) -> DataFrame:
    """Confident predictions become the working class; a locked run leaves ground and class 2 alone."""
    check_revision(ground_revision, current_revision)
    p, c = finite_or_null("pred_class"), finite_or_null("confidence")
    rows = _in(selection, state).where((p >= 0) & (p <= 255) & (c >= min_confidence))
    if ground_locked:
        rows = rows.where(~F.coalesce(F.col("is_ground"), F.lit(False)) & (p != 2))
    return _edits(rows, version, {"working_class": F.floor(p + 0.5)})


def auto_edits(state: DataFrame, proposals: DataFrame, version: int, *, selection: DataFrame | None = None) -> DataFrame:
    """Automatic proposals ``point_id, proposal``: never class 2, never on ground, never trusted."""
    refused = F.raise_error(F.lit("automatic edits cannot assign this class"))
    p = F.col("proposal").cast("int")
    safe = F.when((p < 0) | (p > 255) | (p == 2), refused.cast("int")).otherwise(p)
    rows = (_in(selection, state).join(proposals.where(F.col("proposal").isNotNull()).select("point_id", safe.alias("_p")), "point_id")
            .where(~F.coalesce(F.col("is_ground"), F.lit(False))))
    return _edits(rows, version, {"working_class": F.col("_p")})


def restore_edits(state: DataFrame, ids: DataFrame | None, version: int) -> DataFrame:
    """Working class back to the original one."""
    return _edits(_in(ids, state), version, {"working_class": F.col("original_class")})


def check_revision(made_with: int | None, current: int | None) -> None:
    """Refuse a derived result whose ground revision is not the current one."""
    if made_with is not None and made_with != current:
        raise StaleResult(f"made with ground revision {made_with}, current is {current}")


def stale(made_with: str, current: str) -> Column:
    """The rule of :func:`check_revision` over columns: a known revision that is not the current one."""
    return F.col(made_with).isNotNull() & ~F.col(made_with).eqNullSafe(F.col(current))


def revision(log: list[dict], field: str = "is_ground") -> int:
    """How often the values of a field have changed: every edit of it, and every undo or redo of such an edit.

    Read from the log, so it is the same after the ledger is opened again.
    """
    touches, done, undone, count = {}, [], [], 0
    for event in log:
        if event["action"] == "edit":
            record = json.loads(event["record"]) if event.get("record") else {}
            touches[event["version"]] = field in record.get("output_fields", ())
            done.append(event["version"])
            undone.clear()
        elif event["action"] == "undo" and done:
            undone.append(done.pop())
        elif event["action"] == "redo" and undone:
            done.append(undone.pop())
        else:
            continue
        moved = undone[-1] if event["action"] == "undo" else done[-1]
        count += touches.get(moved, False)
    return count


def active_versions(log: list[dict]) -> tuple[list[int], list[int]]:
    """Replay ``edit / undo / redo`` events: active versions and the redo stack."""
    done: list[int] = []
    undone: list[int] = []
    for event in log:
        if event["action"] == "edit":
            done.append(event["version"])
            undone.clear()
        elif event["action"] == "undo" and done:
            undone.append(done.pop())
        elif event["action"] == "redo" and undone:
            done.append(undone.pop())
    return done, undone


def current_state(base: DataFrame, edits: DataFrame, active: list[int]) -> DataFrame:
    """Base labels overlaid by the newest active edit per point and field."""
    if not active:
        return base
    live = edits.where(F.col("version").isin(*active))
    latest = live.groupBy("point_id").agg(*[
        F.max_by(F.when(F.col("field") == f, F.struct("after")), F.when(F.col("field") == f, F.col("version"))).alias(f"_{f}") for f in FIELDS])
    out = base.join(latest, "point_id", "left")
    types = dict(base.dtypes)
    for f in FIELDS:
        if f in types:
            new = F.col(f"_{f}.after")
            out = out.withColumn(f, F.when(F.col(f"_{f}").isNotNull(), new.cast(types[f])).otherwise(F.col(f)))
    return out.drop(*[f"_{f}" for f in FIELDS])


def history(records: DataFrame, column: str = "record") -> DataFrame:
    """JSON processing records as a table."""
    schema = ("operation STRING, timestamp_utc TIMESTAMP, source_entity BIGINT, affected_points BIGINT,"
              " output_fields ARRAY<STRING>, elapsed_ms BIGINT, parameters MAP<STRING, STRING>")
    return records.select(F.from_json(column, schema).alias("r")).select("r.*")


def drop_fields(df: DataFrame, names: list[str]) -> DataFrame:
    """Drop columns; protected, repeated or unknown names are refused."""
    if not names or len(set(names)) != len(names):
        raise ValueError("name each column to drop once")
    for name in names:
        key = name.lower().replace(" ", "").replace("_", "")
        if key in PROTECTED_EXACT:
            raise ValueError(f"{name} is protected")
        if name not in df.columns:
            raise ValueError(f"no column {name}")
    return df.drop(*names)


def protected_names(fields: DataFrame, column: str = "field") -> DataFrame:
    """Add ``is_protected`` to a table of column names."""
    key = canonical_name(column)
    return fields.withColumn("is_protected", key.isin(*PROTECTED_EXACT))


@dataclass
class Ledger:
    """Durable ledger: one Parquet folder of edits per version and a small event log.

    Edits of a version are written before its event, so a lost writer leaves at
    most an unreferenced folder.
    """

    base: DataFrame
    path: str

    @property
    def ground_revision(self) -> int:
        """Revision of the ground mask; results made with another one are stale."""
        return revision(self.log())

    @property
    def spark(self) -> SparkSession:
        return self.base.sparkSession

    def _log_path(self) -> str:
        return f"{self.path}/log"

    def log(self) -> list[dict]:
        """Events in order; one short row per transaction."""
        try:
            rows = self.spark.read.json(self._log_path(), schema="seq INT, action STRING, version INT, record STRING").orderBy("seq").collect()
        except Exception as error:  # nothing written yet
            if "PATH_NOT_FOUND" in str(error):
                return []
            raise
        return [r.asDict() for r in rows]

    def _event(self, action: str, version: int | None = None, record: dict | None = None) -> None:
        seq = 1 + max((e["seq"] for e in self.log()), default=-1)
        row = [(seq, action, version, json.dumps(record) if record else None)]
        (self.spark.createDataFrame(row, "seq INT, action STRING, version INT, record STRING").coalesce(1)
         .write.mode("append").json(self._log_path()))

    def edits(self) -> DataFrame:
        return self.spark.read.schema("point_id BIGINT, field STRING, before INT, after INT, version INT").parquet(f"{self.path}/edits")

    def state(self) -> DataFrame:
        active, _ = active_versions(self.log())
        return current_state(self.base, self.edits(), active) if active else self.base

    def next_version(self) -> int:
        return 1 + max((e["version"] for e in self.log() if e["action"] == "edit"), default=0)

    def append(self, edits: DataFrame, operation: str, **parameters) -> int:
        """Write one transaction; returns the number of changed values (0 records nothing)."""
        version = self.next_version()
        target = f"{self.path}/edits/version={version}"
        started = datetime.now(timezone.utc)
        edits.drop("version").write.mode("overwrite").parquet(target)
        written = self.spark.read.parquet(target)
        row = written.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("point_id").alias("points"), F.collect_set("field").alias("fields")).first()
        if row.n == 0:
            return 0
        elapsed = int((datetime.now(timezone.utc) - started).total_seconds() * 1000)
        self._event("edit", version, {
            "operation": operation, "timestamp_utc": started.strftime("%Y-%m-%dT%H:%M:%SZ"), "affected_points": row.points,
            "output_fields": sorted(row.fields), "elapsed_ms": elapsed, "parameters": {k: str(v) for k, v in parameters.items()}})
        return row.n

    def undo(self) -> bool:
        return self._step("undo", active_versions(self.log())[0])

    def redo(self) -> bool:
        return self._step("redo", active_versions(self.log())[1])

    def _step(self, action: str, stack: list[int]) -> bool:
        """Record an undo or redo, in the history too, with the points and fields it moves."""
        if not stack:
            return False
        row = self.edits().where(F.col("version") == stack[-1]).agg(
            F.countDistinct("point_id").alias("points"), F.collect_set("field").alias("fields")).first()
        now = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        self._event(action, stack[-1], {"operation": action, "timestamp_utc": now, "affected_points": row.points, "output_fields": sorted(row.fields),
                                        "elapsed_ms": 0, "parameters": {"version": str(stack[-1])}})
        return True

    def history(self) -> DataFrame:
        rows = [(e["record"],) for e in self.log() if e["record"]]
        return history(self.spark.createDataFrame(rows, "record STRING"))
