"""Smoke check and the whole exercise end to end."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from replicakit.constants import (
    LOAD_MOVR_OK,
    LOAD_MOVR_VB_OK,
    MAIN_NAMESPACE,
    READONLY_SUFFIX,
    SIDE_A,
    SIDE_B,
)
from replicakit.operators.counts import counts_at_once
from replicakit.operators.diff import diff_summary, resync_diff
from replicakit.plans.replication import Replication, load, start_replication
from replicakit.plans.status import health_report
from replicakit.sources.registry import Registry, resolve_default

SMOKE_SCHEMA = "side string, ok boolean"
STEP_SCHEMA = "step_no int, step string, ok boolean, n_a bigint, n_b bigint, detail string"

# Step names of the exercise, in order.
STEPS = ("load A", "start A->B", "cutover to B", "load B", "start B->A", "cutover to A",
         "load A again", "status", "restart A->B", "status")


def smoke(spark: SparkSession, reg: Registry) -> DataFrame:
    """One row per side: can the default-routed namespace be read?

    The namespace must exist and every table of it resolve, and one ``limit(1)`` job runs
    on the first; any failure makes that side's ``ok`` false.
    """
    rows = []
    for side in (SIDE_A, SIDE_B):
        try:
            ns = resolve_default(reg, side)
            frames = [reg.read(side, ns, t) for t in reg.tables(side, ns)]
            if ns not in reg.namespaces(side):
                raise LookupError(f"{side} has no namespace {ns}")
            if frames:
                frames[0].limit(1).count()
            rows.append((side, True))
        except Exception:  # noqa: BLE001 - any failure is a failed smoke
            rows.append((side, False))
    return spark.createDataFrame(rows, SMOKE_SCHEMA)


def smoke_passed(spark: SparkSession, reg: Registry) -> bool:
    """The smoke check's overall verdict: every side passed."""
    return all(r["ok"] for r in smoke(spark, reg).collect())


def create_sides(reg: Registry) -> None:
    """Namespaces and pointers as the two sides are created: A serves ``va``,
    B points at its read-only mirror."""
    reg.append_control([
        ("mode/CA/va", "set", "shared"), ("data_state/CA/va", "set", "ready"),
        ("default/CA", "set", MAIN_NAMESPACE[SIDE_A]),
        ("mode/CB/vb", "set", "none"), ("data_state/CB/vb", "set", "add"),
        ("default/CB", "set", MAIN_NAMESPACE[SIDE_B] + READONLY_SUFFIX),
    ])


def run_scenario(
    spark: SparkSession,
    reg: Registry,
    table: str,
    keys: Sequence[str],
    loads: Sequence[DataFrame],
    dry_run: bool = False,
) -> DataFrame:
    """Load A, replicate to B, cut over, load B, replicate back, cut over,
    load A again, report, restart A->B, report (O36).

    ``loads`` are the three load slices. Output ``(step_no, step, ok, n_a,
    n_b, detail)``, counts at each side's default namespace after the step.
    Stops at the first failing step and names it. ``dry_run`` writes nothing:
    every step is listed as planned and the restart step carries the insert,
    update and delete counts the current state would need.
    """
    atob = Replication(reg, SIDE_A, SIDE_B, table, keys)
    holder: dict[str, Replication] = {}

    def status_step() -> str:
        r = health_report(spark, reg, [table]).first()
        return f"{r['verdict']} ({r['direction']})"

    def start_btoa() -> None:
        holder["btoa"] = start_replication(reg, SIDE_B, SIDE_A, table, keys)

    def load_step(side: str, rows: DataFrame) -> None:
        load(reg, side, table, rows, keys)
        # A load records its flag only when it succeeded.
        reg.set_state(LOAD_MOVR_OK if side == SIDE_A else LOAD_MOVR_VB_OK, "1")

    actions: list[Callable[[], object]] = [
        lambda: load_step(SIDE_A, loads[0]),
        lambda: atob.start(),
        lambda: atob.cutover(),
        lambda: load_step(SIDE_B, loads[1]),
        start_btoa,
        lambda: holder["btoa"].cutover(),
        lambda: load_step(SIDE_A, loads[2]),
        status_step,
        lambda: atob.restart(),
        status_step,
    ]
    rows = []
    if dry_run:
        for i, name in enumerate(STEPS, start=1):
            detail = "planned"
            if name.startswith("restart") and reg.exists(SIDE_A, "va", table) and reg.exists(
                    SIDE_B, "vb", table):
                diff = resync_diff(reg.read(SIDE_A, "va", table), reg.read(SIDE_B, "vb", table),
                                   keys)
                counts = {r["action"]: r["n_rows"] for r in diff_summary(diff).collect()}
                detail = ", ".join(f"{a}={counts.get(a, 0)}"
                                   for a in ("insert", "update", "delete"))
            rows.append((i, name, None, None, None, detail))
        return spark.createDataFrame(rows, STEP_SCHEMA)

    create_sides(reg)
    for i, (name, action) in enumerate(zip(STEPS, actions, strict=True), start=1):
        try:
            result = action()
            ok, detail = True, result if isinstance(result, str) else "ok"
        except Exception as err:  # noqa: BLE001 - report the failing step, then stop
            ok, detail = False, f"failed at step: {name}: {type(err).__name__}: {err}"
        found = counts_at_once(reg, {side: (None, table) for side in (SIDE_A, SIDE_B)})
        n_a, n_b = found.get(SIDE_A), found.get(SIDE_B)
        rows.append((i, name, ok, n_a, n_b, detail))
        if not ok:
            break
    return spark.createDataFrame(rows, STEP_SCHEMA)
