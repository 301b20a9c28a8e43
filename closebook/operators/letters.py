"""Client rosters, service catalogue and prior letters to letter drafts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from closebook import schemas as S
from closebook.functions import text as X
from closebook.functions.records import first_field, with_service_codes, with_texts
from closebook.operators.lookup import keep_last, lookup_join, salted_join
from closebook.session import staged


def client_fields(clients: DataFrame, period: str, record: str = "record") -> DataFrame:
    """Typed fields of each client record, and the names of required fields it lacks."""
    fields = with_texts(clients, record).withColumns(
        {
            "client_id": first_field(S.CLIENT_ID_KEYS),
            "client_name": first_field(S.CLIENT_NAME_KEYS),
            "fiscal_year": first_field(S.FISCAL_YEAR_KEYS, default=period[:4] or None),
        }
    )
    coded = with_service_codes(fields, record).drop("texts")
    return coded.withColumn("missing", F.expr(_MISSING))


def staged_fields(clients: DataFrame, period: str) -> DataFrame:
    """``client_fields`` taken from the records once, into the work folder.

    Code lists, letter keys and results are all read from there. Of the record itself, only
    the text of an incomplete one is kept (``record_text``), for its exception.
    """
    text = F.when(F.size("missing") > 0, F.to_json("record")).alias("record_text")
    fields = client_fields(clients, period).select("*", text).drop("record")
    return staged(fields, "client_fields")


_MISSING = """filter(array(
    CASE WHEN client_name IS NULL THEN 'client_name' END,
    CASE WHEN client_id IS NULL THEN 'client_id' END,
    CASE WHEN fiscal_year IS NULL THEN 'fiscal_year' END,
    CASE WHEN size(codes) = 0 THEN 'service_lines' END), f -> f IS NOT NULL)"""


def service_index(
    services: DataFrame, order_by: Sequence[str], record: str = "record"
) -> DataFrame:
    """One row (code, description, rate) per service code; the last record by ``order_by`` wins."""
    rows = with_texts(services, record).select(
        F.upper(X.strip(first_field(S.SERVICE_CODE_KEYS))).alias("code"),
        first_field(S.SERVICE_TEXT_KEYS, default="").alias("description"),
        first_field(S.SERVICE_RATE_KEYS).alias("rate"),
        F.struct(*order_by).alias("_order"),
    )
    # A mark beside the code, as a filter on the key itself would move down to the scan and
    # take the records apart a second time there.
    marked = rows.withColumn("_coded", F.col("code").isNotNull())
    last = keep_last(marked, ["code"], ["_order"])
    return last.filter("_coded").select("code", "description", "rate")


def service_details(
    clients: DataFrame, index: DataFrame, small_index: bool | None = None
) -> DataFrame:
    """Per distinct code list: its unusable codes, its summary, in list order.

    Works on distinct lists, so a list that a third of all clients share is looked up once.
    A code is unusable when the index lacks it or has no rate for it.
    """
    lists = clients.select("codes").distinct()
    # The outer form keeps Spark from testing the array, and so computing it again, at the scan.
    items = lists.select("codes", F.posexplode_outer("codes").alias("pos", "code")).dropna()
    found = lookup_join(items, index, ["code"], small=small_index)
    per_list = (
        found.withColumn("rate", X.rate_display(F.col("rate")))
        .groupBy("codes")
        .agg(F.expr("array_sort(collect_list(struct(pos, code, description, rate)))").alias("items"))
    )
    return per_list.selectExpr(
        "codes",
        "transform(filter(items, i -> i.rate IS NULL), i -> i.code) AS invalid",
        """array_join(transform(filter(items, i -> i.rate IS NOT NULL),
             i -> concat('- ', i.code, ' (', i.description, ') @ ', i.rate)), '\\n') AS service_summary""",
    )


def validate_services(
    clients: DataFrame,
    index: DataFrame,
    small_index: bool | None = None,
    small_details: bool | None = None,
) -> DataFrame:
    """Clients with ``invalid`` codes and ``service_summary``; clients without codes get NULLs."""
    details = staged(service_details(clients, index, small_index), "service_details")
    return lookup_join(clients, details, ["codes"], small=small_details)


def valid_clients(clients: DataFrame, valid_ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Clients whose id is (``left_semi``) or is not (``left_anti``) on the list of valid ids."""
    return lookup_join(clients, staged(valid_ids.select("client_id").distinct(), "valid_ids"), ["client_id"], how)


def with_prior_letter(
    clients: DataFrame, prior: DataFrame, counted: DataFrame | None = None
) -> DataFrame:
    """Add ``prior_text`` of the year before, found by name slug; NULL when there is none.

    ``prior`` holds (slug, fiscal_year, text) once per slug and year. Letters are long, so
    they are never broadcast; ``prior_filled`` says whether there is any text, so that who
    needs only that does not move the letters. ``counted`` as in ``salted_join``.
    """
    texts = prior.select(
        F.col("slug").alias("_slug"),
        F.col("fiscal_year").alias("_year"),
        F.col("text").alias("prior_text"),
        (F.coalesce("text", F.lit("")) != "").alias("prior_filled"),
    )
    on = ["_slug", "_year"]
    counted = None if counted is None else _with_letter_key(counted)
    return salted_join(_with_letter_key(clients), texts, on, counted=counted).drop(*on)


def _with_letter_key(clients: DataFrame) -> DataFrame:
    year = (F.col("fiscal_year").try_cast("int") - 1).cast("string")
    return clients.withColumns({"_slug": X.slugify(F.col("client_name")), "_year": year})


def assess_clients(
    clients: DataFrame,
    index: DataFrame,
    prior: DataFrame | None,
    period: str,
    small_index: bool | None = None,
) -> DataFrame:
    """One row per client record with its outcome: letter, missing_fields or bad_services."""
    fields = staged_fields(clients, period)
    checked = validate_services(fields, index, small_index)
    if prior is None:
        none = F.lit(None).cast("string")
        found = checked.withColumns(
            {"prior_text": none, "prior_filled": F.lit(False), "prior_note": none}
        )
    else:
        found = with_prior_letter(checked, prior, fields).withColumn("prior_note", _prior_note())
    return found.withColumns(
        {
            "outcome": F.when(F.size("missing") > 0, "missing_fields")
            .when(F.size("invalid") > 0, "bad_services")
            .otherwise("letter"),
            "source": F.when(F.col("prior_filled"), "rolled_forward").otherwise("template"),
        }
    )


# The parts of the note that readers of the log look for.
_NOTE = ("Prior year letter not found for ", " FY", " → defaulted to template.")


def _prior_note() -> Column:
    before, between, after = map(F.lit, _NOTE)
    return F.when(F.col("prior_filled").isNull(), F.concat(before, "client_name", between, "fiscal_year", after))


def render_letters(
    assessed: DataFrame, template: Column | str, letters_dir: str, generated_on: str
) -> DataFrame:
    """The letters: manifest columns plus ``letter_text``."""
    template = F.lit(template) if isinstance(template, str) else template
    base = F.when(F.col("source") == "rolled_forward", F.col("prior_text")).otherwise(template)
    values = {
        "ClientName": F.col("client_name"),
        "ClientID": F.col("client_id"),
        "FiscalYear": F.col("fiscal_year"),
        "ServiceSummary": F.col("service_summary"),
        "GeneratedOn": F.lit(generated_on),
    }
    path = F.concat(
        F.lit(letters_dir.rstrip("/") + "/"),
        X.letter_file(F.col("client_name"), F.col("fiscal_year")),
    )
    return assessed.filter(F.col("outcome") == "letter").select(
        "client_id",
        "client_name",
        "fiscal_year",
        F.col("codes").alias("service_lines"),
        path.alias("output_path"),
        "source",
        F.lit(generated_on).alias("generated_on"),
        X.complete_letter(base, values).alias("letter_text"),
    )


def manifest(letters: DataFrame) -> DataFrame:
    return letters.drop("letter_text")


def exceptions(assessed: DataFrame) -> DataFrame:
    """(client_id, reason) of each client that gets no letter."""
    lacking = F.concat(
        F.lit("Record missing required fields "),
        X.quoted_list(F.col("missing")),
        F.lit(": "),
        F.col("record_text"),
    )
    invalid = F.concat(
        F.lit("Service line validation failed for client "),
        F.col("client_name"),
        F.lit(" ("),
        F.col("client_id"),
        F.lit("): invalid or missing rate for "),
        X.quoted_list(F.col("invalid")),
    )
    return assessed.filter(F.col("outcome") != "letter").select(
        F.coalesce("client_id", F.lit("")).alias("client_id"),
        F.when(F.col("outcome") == "missing_fields", lacking).otherwise(invalid).alias("reason"),
    )


def recipient_list(recipients: object) -> list[str]:
    """Recipients given as a list, one value or nothing; blanks dropped."""
    if isinstance(recipients, (list, tuple, set)):
        return [str(r) for r in recipients if str(r).strip()]
    return [str(recipients)] if recipients else []


def notifications(letters: DataFrame, recipients: object, stamp: str) -> DataFrame:
    """Notification lines: a header (``position`` 0) and one line per letter.

    Without recipients, a single line says so.
    """
    names = recipient_list(recipients)
    if not names:
        nobody = F.lit("No notification recipients configured.")
        one = letters.sparkSession.range(1)
        return one.select(F.lit(0).alias("position"), F.lit("").alias("client_id"), nobody.alias("line"))
    header = letters.agg(F.count("*").alias("n")).select(
        F.lit(0).alias("position"),
        F.lit("").alias("client_id"),
        F.concat(
            F.lit(f"{stamp} | Draft engagement letters ready: "),
            F.col("n").cast("string"),
            F.lit(" clients"),
        ).alias("line"),
    )
    lines = letters.select(
        F.lit(1).alias("position"),
        "client_id",
        F.concat(
            F.lit("Notify " + ", ".join(names) + " → "),
            F.col("client_name"),
            F.lit(" letter saved to "),
            F.col("output_path"),
        ).alias("line"),
    )
    return header.unionByName(lines)


def letter_metrics(assessed: DataFrame, index: DataFrame, recipients: object) -> DataFrame:
    """Run metrics as rows (metric, value); ``ok`` is 1 or 0."""
    letter = F.col("outcome") == "letter"
    counts = assessed.agg(
        F.count("*").alias("clients_processed"),
        F.count_if(letter).alias("letters_generated"),
        F.count_if(~letter).alias("exceptions"),
        F.count_if(letter & (F.col("source") == "rolled_forward")).alias("rolled_forward_letters"),
    ).withColumns(
        {
            "notifications_prepared": F.col("letters_generated")
            * F.lit(len(recipient_list(recipients))).cast("long"),
            "ok": ((F.col("exceptions") == 0) & (F.col("letters_generated") > 0)).cast("long"),
        }
    )
    long_form = counts.unpivot([], counts.columns, "metric", "value")
    available = index.agg(F.count("*").alias("value")).select(
        F.lit("service_lines_available").alias("metric"), "value"
    )
    return long_form.unionByName(available)


def clashing_paths(letters: DataFrame) -> DataFrame:
    """Output paths that more than one letter would be written to."""
    return letters.groupBy("output_path").count().filter("count > 1")
