"""The period close: collect trial balances, translate them, assemble support text."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from closebook.functions.text import quoted_list
from closebook.operators import columns, fx, normalize, quality, support
from closebook.schemas import TB
from closebook.session import staged, with_settings
from closebook.sources import sinks
from closebook.sources.files import ORDER, RawTables, file_hashes, read_rates, read_table, read_tb_files
from closebook.workers import LONG_ROWS

SHOWN = 20  # names listed in messages; the report that the last message names holds all of them


@dataclass
class StepResult:
    """Outcome of a step; ``tables`` holds what it made, including its check reports.

    ``inputs`` and ``outputs`` have a hash of each file or a digest of each table, by path.
    """

    ok: bool
    messages: list[str] = field(default_factory=list)
    metrics: dict[str, object] = field(default_factory=dict)
    tables: dict[str, DataFrame] = field(default_factory=dict)
    inputs: dict[str, str] = field(default_factory=dict)
    outputs: dict[str, str] = field(default_factory=dict)


def _failures(report: DataFrame, text: Column, order: str, path: str) -> list[str]:
    """Messages on the rows of a report, which is written to ``path``; none if it is empty."""
    shown = report.select(text, order).orderBy(order).take(SHOWN + 1)
    if not shown:
        return []
    sinks.write_table(report, path)
    total = report.count() if len(shown) > SHOWN else len(shown)
    more = [f"{total - SHOWN} more"] if total > SHOWN else []
    return [*(row[0] for row in shown[:SHOWN]), *more, f"All {total} in {path}"]


def collect_tb(
    spark: SparkSession,
    folder: str,
    period: str,
    required: Sequence[str],
    out_path: str,
    enforce_balanced: bool = True,
    fill: str = "file",
    fuzzy: bool = True,
) -> StepResult:
    """All trial-balance files of a period as one master ledger at ``out_path``.

    Files are decoded once into the work folder; checks and the master read that copy. If a
    file lacks a required column, has an amount too large for the ledger or does not balance,
    no master is written; all such files are told by ``file_report`` and by the table at
    ``{out_path}_Failed``. The master keeps the order of the files' names and of their rows.
    """
    raw = read_tb_files(spark, folder, period)
    if raw is None:
        empty = spark.createDataFrame([], TB)
        written = sinks.write_table(columns.add_missing(empty, {c: F.lit(None).cast("string") for c in required}), out_path, required)
        return StepResult(True, ["Master TB rows=0 files=0"], {"files": 0, "rows": 0}, outputs={out_path: written.digest})

    with with_settings(spark, LONG_ROWS):
        headers = staged(normalize.file_headers(raw.headers, required, fuzzy), "headers")
    counts = headers.agg(
        F.count("*").alias("files"),
        F.coalesce(F.sum("aliased"), F.lit(0)).alias("aliased_columns"),
    ).first()
    metrics: dict[str, object] = {"files": 0, "rows": 0, **{k: v for k, v in counts.asDict().items() if k != "files"}}
    lacking = headers.filter(F.size("missing") > 0)
    text = F.concat("file_name", F.lit(": unresolved columns "), quoted_list(F.col("missing")))
    found = _failures(lacking.select("file_name", "file_path", "missing"), text, "file_name", f"{out_path}_Failed")
    if found:
        return StepResult(False, found, metrics, {"file_report": lacking})

    rows = normalize.ledger_of_cells(RawTables(headers, raw.rows), required)
    decoded = sinks.Digest(rows)
    with with_settings(spark, LONG_ROWS):
        ledger = staged(decoded.seen, "ledger")
    inputs = {f"{folder.rstrip('/')}/TB_*_{period}": decoded.written().digest}
    metrics.update(quality.collect_metrics(ledger, "file_name").drop("files", "rows").first().asDict())
    filled = normalize.fill_from_name(ledger, "file_name", fill)
    report = staged(quality.file_report(filled), "file_report")
    failed = "too_large > 0" + (" OR NOT balanced" if enforce_balanced else "")
    text = F.when(
        F.col("too_large") > 0, F.concat("file_name", F.lit(": amounts too large: "), F.col("too_large").cast("string"))
    ).otherwise(F.concat("file_name", F.lit(": debits != credits")))
    found = _failures(report.filter(failed), text, "file_name", f"{out_path}_Failed")
    if found:
        return StepResult(False, found, metrics, {"file_report": report}, inputs)

    written = sinks.write_table(filled.orderBy("file_name", *ORDER), out_path, required)
    metrics.update({"files": counts["files"], "rows": written.rows})
    message = f"Master TB rows={written.rows} files={counts['files']}"
    tables = {"file_report": report, "master": spark.read.parquet(out_path)}
    return StepResult(True, [message], metrics, tables, inputs, {out_path: written.digest})


def translate_fx(
    tb: DataFrame,
    rates: DataFrame | str,
    period: str,
    adjusted_path: str,
    adjustments_path: str,
    rates_order: Sequence[str] = tuple(ORDER),
    rate_period: str | None = None,
    tolerance: float = 5,
) -> StepResult:
    """Adjusted ledger and adjustment table, or the list of currencies without a rate.

    ``rates`` is a rates table as read, or the path of one, or of a ``.json`` payload; it is cleaned here. A payload
    that does not parse, or a rate in it that is no usable number, fails the step and goes to the table
    ``{adjusted_path}_Rejected_Rates`` with its reason. So does a rate too large for the ledger, from any source.
    ``tolerance`` is only reported.
    """
    if "CurrencyCode" not in tb.columns:
        return StepResult(False, ["Missing CurrencyCode in TB"])
    if isinstance(rates, str):
        rates, rejected = read_rates(tb.sparkSession, rates)
    else:
        rejected = fx.too_large_rates(rates, rates_order)
    text = F.concat_ws(": ", "origin", "reason")
    found = _failures(rejected, text, "origin", f"{adjusted_path}_Rejected_Rates")
    if found:
        return StepResult(False, found, {}, {"rejected": rejected})
    clean = staged(fx.clean_rates(rates, rates_order, rate_period), "rates")
    missing = fx.missing_codes(tb, clean)
    codes = [code for (code,) in missing.take(SHOWN + 1)]
    if codes:
        more = []
        if len(codes) > SHOWN:
            sinks.write_table(missing, f"{adjusted_path}_Missing_Rates")
            more = [f"{missing.count() - SHOWN} more, all in {adjusted_path}_Missing_Rates"]
        return StepResult(False, [f"Missing FX rates for: {codes[:SHOWN]}", *more], {}, {"missing": missing})
    adjusted = fx.translate(tb, clean)
    if adjusted_path.endswith(".csv"):
        adjusted = staged(adjusted, "adjusted")
    done = sinks.write_table(adjusted, adjusted_path)
    written = adjusted if adjusted_path.endswith(".csv") else tb.sparkSession.read.parquet(adjusted_path)
    adjustments = sinks.write_table(fx.adjustments(written, period), adjustments_path)
    outputs = {adjusted_path: done.digest, adjustments_path: adjustments.digest}
    return StepResult(True, [f"Applied FX to {done.rows} rows"], {"rows": done.rows, "tolerance": tolerance}, outputs=outputs)


def assemble_support(spark: SparkSession, paths: Sequence[str], out_path: str) -> StepResult:
    """All rows of each table, in file order, as lines of one text."""
    sections = []
    for path in paths:
        table = read_table(spark, path)
        sections.append(support.Section(table, ORDER, [c for c in table.columns if c not in ORDER]))
    outputs = {}
    if sections:
        outputs[out_path] = sinks.write_support(sections, out_path).digest
    return StepResult(
        True, [f"Merged {len(sections)} tables → {out_path}"], {"source_tables": len(sections)}, outputs=outputs
    )


def log_step(spark: SparkSession, path: str, step: str, period: str, result: StepResult, inputs: Sequence[str] = ()) -> None:
    """Run-log row of a step, with its digests and a hash of each single input file."""
    hashes = dict(result.inputs)
    for name in inputs:
        for row in file_hashes(spark, name).collect():
            hashes[row["file_path"]] = row["sha256"]
    status = "ok" if result.ok else "error"
    sinks.append_run_log(spark, path, step, period, status, result.messages, result.metrics, hashes, result.outputs)


def close_period(
    spark: SparkSession,
    period: str,
    tb_folder: str,
    rates_path: str,
    out_folder: str,
    required: Sequence[str] = tuple(TB.names),
    enforce_balanced: bool = True,
    tolerance: float = 5,
) -> dict[str, StepResult]:
    """Collect, translate and assemble, with a run-log row for each step.

    A step after a failed one is logged as skipped. Tables go to ``out_folder``.
    """
    out = out_folder.rstrip("/")
    log = f"{out}/run_log"
    master = f"{out}/Master_TB_{period}"
    adjusted, adjustments = f"{master}_Adjusted", f"{out}/FX_Adjustments_{period}"
    steps = {
        "collect_tb": lambda: collect_tb(spark, tb_folder, period, required, master, enforce_balanced),
        "translate_fx": lambda: translate_fx(
            spark.read.parquet(master),
            rates_path,
            period,
            adjusted,
            adjustments,
            tolerance=tolerance,
        ),
        "assemble_support": lambda: assemble_support(spark, [master, adjustments], f"{out}/Support_{period}"),
    }
    results: dict[str, StepResult] = {}
    for name, run in steps.items():
        if not all(r.ok for r in results.values()):
            sinks.append_run_log(spark, log, name, period, "skipped")
            continue
        results[name] = run()
        inputs = [rates_path] if name == "translate_fx" else []
        log_step(spark, log, name, period, results[name], inputs)
    return results
