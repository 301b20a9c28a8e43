"""Letter drafting and catalogue registration, from files to files."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from closebook.operators import catalog, letters
from closebook.plans.close import StepResult, log_step
from closebook.session import staged
from closebook.sources import files, sinks


# The messages of the letter step, which readers of the log look for.
MESSAGES = {
    "no_clients": "Client metadata file not found: {}",
    "bad_clients": "Failed to load client metadata: {}",
    "no_services": "Service line reference file not found: {}",
    "bad_services": "Failed to load service line reference data: {}",
    "no_template": "Template file not found: {}",
    "no_records": "Client metadata file contained no records → escalate to Manager for delayed export.",
    "made": "Generated {} engagement letter drafts.",
    "flagged": "Flagged {} records for Administrator review.",
}


def _cause(error: Exception) -> str:
    """The error without its stack trace."""
    return " ".join(line.strip() for line in str(error).split("\n\tat ")[0].splitlines())


def draft_letters(
    spark: SparkSession,
    period: str,
    client_metadata: str | None = None,
    service_lines: str | None = None,
    template_path: str | None = None,
    output_folder: str | None = None,
    prior_letters_folder: str | None = None,
    manifest_path: str | None = None,
    notification_log: str | None = None,
    notification_recipients: object = None,
    generated_on: str | None = None,
    as_files: bool = True,
    run_log: str | None = None,
) -> StepResult:
    """Draft a letter for each client whose record and service codes are complete.

    Letters are written even if some clients fail; those go to the exceptions, and the result
    is then not ok. The run log, by default ``{output_folder}/run_log``, gets a row either way.
    """
    given = {
        "client_metadata": client_metadata,
        "service_lines": service_lines,
        "template_path": template_path,
        "output_folder": output_folder,
    }
    absent = [name for name, value in given.items() if not value]
    if absent:
        raise ValueError(f"Missing required params: {absent}")
    result = _draft(
        spark, period, client_metadata, service_lines, template_path, output_folder, prior_letters_folder,
        manifest_path, notification_log, notification_recipients, generated_on, as_files,
    )
    log_step(spark, run_log or f"{output_folder.rstrip('/')}/run_log", "draft_letters", period, result)
    return result


def _draft(
    spark: SparkSession,
    period: str,
    client_metadata: str,
    service_lines: str,
    template_path: str,
    output_folder: str,
    prior_letters_folder: str | None,
    manifest_path: str | None,
    notification_log: str | None,
    notification_recipients: object,
    generated_on: str | None,
    as_files: bool,
) -> StepResult:
    inputs: dict[str, str] = {}

    def taken(path: str, table: DataFrame, name: str) -> DataFrame:
        digest = sinks.Digest(table)
        copy = staged(digest.seen, name)
        inputs[path] = digest.written().digest
        return copy

    try:
        clients = taken(client_metadata, files.read_records(spark, client_metadata, "clients", single=True), "clients")
    except (AnalysisException, FileNotFoundError):
        return StepResult(False, [MESSAGES["no_clients"].format(client_metadata)])
    except Exception as error:
        return StepResult(False, [MESSAGES["bad_clients"].format(_cause(error))])
    try:
        services = files.read_records(spark, service_lines, "service_lines")
        index = taken(service_lines, letters.service_index(services, files.ORDER), "services")
    except (AnalysisException, FileNotFoundError):
        return StepResult(False, [MESSAGES["no_services"].format(service_lines)])
    except Exception as error:
        return StepResult(False, [MESSAGES["bad_services"].format(_cause(error))])
    try:
        template = files.read_template(spark, template_path)
    except AnalysisException:
        return StepResult(False, [MESSAGES["no_template"].format(template_path)])

    prior = None
    if prior_letters_folder:
        prior = files.read_prior_letters(spark, prior_letters_folder)
        if prior is None:
            prior = spark.createDataFrame([], "slug string, fiscal_year string, text string")
    now = datetime.now(timezone.utc)
    stamp = generated_on or now.strftime("%Y-%m-%d %H:%M UTC")
    folder = output_folder.rstrip("/")
    assessed = staged(letters.assess_clients(clients, index, prior, period), "assessed")
    drafts = letters.render_letters(assessed, template, folder, stamp)
    manifest, exceptions = letters.manifest(drafts), letters.exceptions(assessed)
    notes = letters.notifications(manifest, notification_recipients, now.strftime("%Y-%m-%dT%H:%M:%SZ"))

    written = {f"{folder}/letters_{period}": sinks.write_letters(drafts, as_files=as_files, table=f"{folder}/letters_{period}")}
    written |= sinks.write_manifest(manifest, exceptions, manifest_path or f"{folder}/draft_manifest_{period}")
    log_path = notification_log or f"{folder}/notifications_{period}"
    written[log_path] = sinks.write_lines(notes, log_path, ["position", "client_id"])
    measured = letters.letter_metrics(assessed, index, notification_recipients).collect()
    metrics = {row["metric"]: row["value"] for row in measured}
    ok = bool(metrics.pop("ok"))
    messages = []
    if not metrics["clients_processed"]:
        messages.append(MESSAGES["no_records"])
    messages.append(MESSAGES["made"].format(metrics["letters_generated"]))
    if metrics["exceptions"]:
        messages.append(MESSAGES["flagged"].format(metrics["exceptions"]))
    prior_notes = assessed.filter("outcome = 'letter' AND prior_note IS NOT NULL").select(
        "client_id", F.col("prior_note").alias("note")
    )
    tables = {"letters": drafts, "manifest": manifest, "exceptions": exceptions, "prior_notes": prior_notes}
    return StepResult(ok, messages, metrics, tables, inputs, {path: w.digest for path, w in written.items()})


def register_tutorials(
    spark: SparkSession,
    catalog_path: str,
    updates: DataFrame,
    order_by: Sequence[str],
    out_path: str | None = None,
    make_id: catalog.IdMaker = catalog.random_id,
    period: str = "",
    run_log: str | None = None,
) -> StepResult:
    """Register ``updates`` in the catalogue at ``catalog_path`` and write it to ``out_path``.

    Without ``out_path`` the catalogue is replaced in place, by a new version (see ``write_catalog``); if another
    job has replaced it meanwhile, this fails and leaves that one. The run log, by default ``{out_path}.run_log``, gets a row.
    """
    out = out_path or catalog_path
    version = files.current_version(spark, catalog_path) or ""
    steps, toolsets = files.read_catalog(spark, catalog_path)
    merged = catalog.upsert_catalog(steps, toolsets, updates, order_by, make_id)
    new_steps, new_toolsets = staged(merged[0], "steps"), staged(merged[1], "toolsets")
    written = sinks.write_catalog(new_steps, new_toolsets, out, version if out == catalog_path else None)
    result = StepResult(True, [], {"steps": written[f"{out}/steps"].rows, "toolsets": written[f"{out}/toolsets"].rows}, {"steps": new_steps, "toolsets": new_toolsets}, outputs={path: w.digest for path, w in written.items()})
    log_step(spark, run_log or f"{out.rstrip('/')}.run_log", "register_tutorials", period, result)
    return result
