"""The registered queries: each runs one operator or job over the test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from closebook.functions import ledger as L
from closebook.functions import text as X
from closebook.functions.records import with_service_codes, with_texts
from closebook.operators import catalog, columns, fx, letters, normalize, quality, support
from closebook.operators.lookup import lookup_join
from closebook.plans import close
from closebook.plans import views as V
from closebook.plans.engagement import draft_letters, register_tutorials
from closebook.schemas import FX_ADJ, TB
from closebook.session import staged, work_folder
from closebook.sources import sinks
from closebook.sources.files import prior_letter_keys, read_catalog
from closebook.sources.letter_files import read_files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    """Register under the function's name, less a trailing underscore."""
    QUERIES[fn.__name__.rstrip("_")] = fn
    return fn


def _double(*names: str) -> dict[str, Column]:
    return {name: F.col(name).cast("double") for name in names}


def _joined(name: str) -> Column:
    return F.array_join(name, "|").alias(name)


# Currency translation


@query
def fx_translate(spark, sf):
    done = fx.translate(V.ledger(spark, sf), V.rates(spark, sf))
    return done.select(
        "DocumentNo",
        "EntityCode",
        "AccountCode",
        "Period",
        "CurrencyCode",
        "LocalAmount",
        "FXRate",
        "ReportingCurrencyAmount",
    ).withColumns(_double("LocalAmount", "FXRate", "ReportingCurrencyAmount"))


@query
def fx_adjustments(spark, sf):
    done = fx.translate(V.ledger(spark, sf), V.rates(spark, sf))
    return fx.adjustments(done, "202112").withColumns(
        _double("LocalAmount", "FXRate", "ReportingCurrencyAmount")
    )


@query
def missing_fx(spark, sf):
    unmarked = (F.col("region") == "MIDDLE EAST") & (F.col("status") == "P")
    tb = V.ledger(spark, sf).withColumn("CurrencyCode", F.when(~unmarked, F.col("CurrencyCode")))
    return fx.missing_codes(tb, fx.clean_rates(V.gappy_rates(spark, sf), ["line_no"]))


@query
def fx_rates_clean(spark, sf):
    return fx.clean_rates(V.rate_feed(spark, sf), ["event_id"]).withColumns(_double("FXRate"))


@query
def fx_rates_from_json(spark, sf):
    events = V.table(spark, sf, "events").select("event_id", "props")
    return fx.rates_from_json(events, "props", wrapper=None).drop("props").withColumns(_double("FXRate"))


# Ledger quality


@query
def balance_check(spark, sf):
    tb = V.ledger(spark, sf, slip=True)
    return quality.balance_check(tb, ["EntityCode", "Period"]).withColumns(_double("debit", "credit"))


@query
def tb_file_qa(spark, sf):
    tb = V.ledger(spark, sf, slip=True)
    return quality.file_report(tb).withColumns(_double("debit", "credit"))


@query
def tb_file_metrics(spark, sf):
    raw = V.raw_ledger(spark, sf)
    per_file = columns.aliased_columns(raw, TB.names)
    metrics = quality.collect_metrics(normalize.normalize_ledger(raw))
    return metrics.withColumn("aliased_columns", F.col("files") * F.lit(per_file).cast("long"))


@query
def missing_columns(spark, sf):
    names = F.array(*[F.lit(c) for c in TB.names])
    lacking = (
        F.when(F.col("region") == "AMERICA", F.array(F.lit("AccountName")))
        .when(F.col("region") == "ASIA", F.array(F.lit("Credit"), F.lit("Debit")))
        .otherwise(F.array().cast("array<string>"))
    )
    tb = V.ledger(spark, sf)
    headers = tb.select("file_name", F.array_except(names, lacking).alias("header")).distinct()
    found = columns.missing_in_headers(headers, [*TB.names, "CostCenter"])
    return found.select("file_name", F.array_join("missing", "|").alias("missing"))


# Normalisation


@query
def coerce_numeric(spark, sf):
    text = F.col("Amount")
    return V.text_amounts(spark, sf).select(
        "c_custkey",
        L.amount(text).cast("double").alias("amount"),
        L.parse_amount(text).cast("double").alias("parsed"),
    )


@query
def amount_split(spark, sf):
    tb = normalize.split_amount(V.text_amounts(spark, sf))
    return tb.select("c_custkey", "Debit", "Credit").withColumns(_double("Debit", "Credit"))


@query
def period_normalize(spark, sf):
    day, priority = F.col("o_orderdate"), F.substring("o_orderpriority", 1, 1)
    cell = (
        F.when(priority == "1", F.date_format(day, "yyyy-MM"))
        .when(priority == "2", F.concat(F.date_format(day, "yyyyMM"), F.lit(".0")))
        .when(priority == "3", F.date_format(day, "yyyy-MM-dd"))
        .when(priority == "4", F.date_format(day, "MM/yyyy"))
        .otherwise(F.when(F.col("o_orderstatus") == "P", " ").otherwise(F.date_format(day, "yyyyMM")))
    )
    orders = V.table(spark, sf, "orders").select("o_orderkey", L.period_key(cell).alias("period"))
    return orders.withColumn("real_month", L.is_period(F.col("period")))


@query
def infer_filename(spark, sf):
    entity = F.concat(F.lit("N"), F.col("nation"))
    name = (
        F.when(F.col("priority") == "1-URGENT", F.concat(F.lit("TB_"), entity, F.lit("_"), F.col("period"), F.lit(".xlsx")))
        .when(F.col("priority") == "2-HIGH", F.concat(F.lit("tb_"), entity, F.lit(".csv")))
        .when(F.col("priority") == "3-MEDIUM", F.concat(F.lit("TB_"), entity, F.lit("_Q1_2025.xlsx")))
        .when(F.col("priority") == "5-LOW", F.concat(F.lit("export_TB_"), entity, F.lit("."), F.col("period"), F.lit("01.csv")))
        .otherwise(F.concat(F.lit("Ledger-"), F.col("period"), F.lit(".csv")))
    )
    return V.postings(spark, sf).select(
        "DocumentNo",
        L.entity_in_name(name).alias("entity"),
        L.period_in_name(name).alias("period"),
    )


@query
def infer_fill(spark, sf):
    tb = normalize.fill_from_name(V.file_ledger(spark, sf))
    return tb.select("DocumentNo", "AccountCode", "file_name", "EntityCode", "Period")


@query
def resolve_alias(spark, sf):
    return columns.resolve_columns(V.raw_ledger(spark, sf), TB.names).drop("file_name")


@query
def resolve_fuzzy(spark, sf):
    """Each part's export header, resolved on the executors."""
    kind = F.col("p_type")
    header = F.array(
        F.lit("Account  Name"),
        F.lit("Entity Code"),
        F.concat(F.lit("Debit "), kind),
        F.when(kind == "PROMO", "credit").otherwise("Credit Limit"),
        F.concat(F.lit("Posting "), F.col("p_name")),
        F.when(kind == "SMALL", "Curency Code").otherwise("CurrencyCodes"),
    )
    headers = V.table(spark, sf, "part").select("p_partkey", header.alias("header"))
    found = columns.resolve_headers(headers, TB.names)
    return found.select("p_partkey", F.explode("resolved").alias("wanted", "source"))


@query
def tb_normalize(spark, sf):
    tb = normalize.normalize_ledger(V.raw_ledger(spark, sf))
    return tb.select(F.col("Memo").alias("DocumentNo"), *V.CANONICAL).withColumns(
        _double("Debit", "Credit")
    )


def _collected(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.fill_from_name(normalize.normalize_ledger(V.raw_ledger(spark, sf)))


@query
def tb_collect(spark, sf):
    master = normalize.project(_collected(spark, sf), TB.names)
    return master.withColumns(_double("Debit", "Credit"))


# Letters


def _index(spark: SparkSession, sf: str) -> DataFrame:
    return letters.service_index(V.services(spark, sf), ["p_partkey"])


def _prior(spark: SparkSession, sf: str) -> DataFrame:
    return prior_letter_keys(V.prior_files(spark, sf))


def _assessed(spark: SparkSession, sf: str) -> DataFrame:
    index = staged(_index(spark, sf), "services")
    return letters.assess_clients(
        V.clients(spark, sf), index, _prior(spark, sf), V.LETTER_PERIOD
    )


def _letters(spark: SparkSession, sf: str) -> DataFrame:
    return letters.render_letters(_assessed(spark, sf), V.TEMPLATE, V.LETTERS_DIR, V.STAMP)


def _fields(spark: SparkSession, sf: str) -> DataFrame:
    return letters.client_fields(V.clients(spark, sf), V.LETTER_PERIOD)


@query
def client_fields(spark, sf):
    return _fields(spark, sf).select(
        "c_custkey", "client_id", "client_name", "fiscal_year", _joined("missing")
    )


@query
def service_codes(spark, sf):
    coded = with_service_codes(with_texts(V.clients(spark, sf)))
    return coded.select("c_custkey", _joined("codes"))


@query
def service_codes_nested(spark, sf):
    coded = with_service_codes(with_texts(V.nested_clients(spark, sf)))
    return coded.select("c_custkey", _joined("codes"))


@query
def service_index(spark, sf):
    return _index(spark, sf).withColumns(_double("rate"))


@query
def service_validation(spark, sf):
    fields = letters.staged_fields(V.clients(spark, sf), V.LETTER_PERIOD)
    checked = letters.validate_services(fields, _index(spark, sf))
    return checked.select("c_custkey", F.array_join("invalid", "|").alias("invalid"))


@query
def service_summary(spark, sf):
    fields = letters.staged_fields(V.clients(spark, sf), V.LETTER_PERIOD)
    checked = letters.validate_services(fields, _index(spark, sf))
    return checked.filter(F.size("invalid") == 0).select("c_custkey", "service_summary")


@query
def rate_display(spark, sf):
    kind, price = F.col("p_type"), F.col("p_retailprice").cast("string")
    cell = (
        F.when(kind == "ECONOMY", F.concat(F.lit("$1,0"), price))
        .when(kind == "MEDIUM", F.concat(F.lit(" "), price, F.lit("e2 ")))
        .when(kind == "LARGE", F.concat(price, F.lit("d")))
        .when(kind == "SMALL", F.concat(F.lit("-"), price))
        .when(kind == "PROMO", "TBD, $")
        .otherwise(price)
    )
    return V.table(spark, sf, "part").select("p_partkey", X.rate_display(cell).alias("shown"))


@query
def slugify(spark, sf):
    bal = F.col("c_acctbal")
    name = (
        F.when(bal < 0, "__&__")
        .when(bal > 5000, F.concat(F.lit("Ünï "), F.col("c_mktsegment"), F.lit(" & Co.")))
        .otherwise(F.col("c_name"))
    )
    return V.table(spark, sf, "customer").select(
        "c_custkey",
        X.slugify(name).alias("slug"),
        X.letter_file(name, F.lit("2025")).alias("file_name"),
    )


@query
def valid_clients(spark, sf):
    filled = V.table(spark, sf, "orders").filter("o_orderstatus = 'F'")
    ids = filled.select(F.concat(F.lit("C-"), F.col("o_custkey")).alias("client_id"))
    return letters.valid_clients(_fields(spark, sf), ids).select("c_custkey", "client_id")


@query
def prior_letter_join(spark, sf):
    fields = letters.staged_fields(V.clients(spark, sf), V.LETTER_PERIOD)
    named = fields.filter("client_name IS NOT NULL")
    found = letters.with_prior_letter(named, _prior(spark, sf))
    return found.select("c_custkey", "prior_text")


@query
def template_merge(spark, sf):
    values = {
        "ClientName": F.col("file_name"),
        "ClientID": F.lit("C-1"),
        "FiscalYear": F.lit("2025"),
        "ServiceSummary": F.lit("- TAX (Tax, {{GeneratedOn}}) @ $180.00"),
        "GeneratedOn": F.lit(V.STAMP),
    }
    letter = X.complete_letter(F.col("text"), values)
    return V.prior_files(spark, sf).select("file_name", letter.alias("letter_text"))


@query
def letters_(spark, sf):
    return _letters(spark, sf).withColumn("service_lines", F.array_join("service_lines", "|"))


@query
def letter_manifest(spark, sf):
    made = letters.manifest(_letters(spark, sf))
    return made.withColumn("service_lines", F.array_join("service_lines", "|"))


@query
def client_exceptions(spark, sf):
    # Who gets a letter does not depend on the letter of the year before.
    index = _index(spark, sf)
    return letters.exceptions(
        letters.assess_clients(V.clients(spark, sf), index, None, V.LETTER_PERIOD)
    )


@query
def notifications(spark, sf):
    made = staged(letters.manifest(_letters(spark, sf)), "manifest")
    return letters.notifications(made, V.RECIPIENTS, V.STAMP).select("position", "line")


@query
def letter_metrics(spark, sf):
    index = staged(_index(spark, sf), "services")
    clients, prior = V.clients(spark, sf), _prior(spark, sf)
    assessed = letters.assess_clients(clients, index, prior, V.LETTER_PERIOD)
    return letters.letter_metrics(assessed, index, V.RECIPIENTS)


# Support text, hashes, catalogue


def _support(adjusted: DataFrame, period: str) -> DataFrame:
    order = ["Period", "EntityCode", "DocumentNo", "AccountCode"]
    adjustment = adjusted.withColumn("Period", F.lit(period))
    return support.support_lines(
        [
            support.Section(adjusted, order, [*V.CANONICAL, "ReportingCurrencyAmount"]),
            support.Section(adjustment, order[2:], FX_ADJ.names),
        ]
    )


@query
def support_lines(spark, sf):
    return _support(fx.translate(V.ledger(spark, sf), V.rates(spark, sf)), "202112")


@query
def content_hash(spark, sf):
    content = F.col("text").cast("binary")
    return V.table(spark, sf, "documents").select(
        "doc_id", F.md5(content).alias("md5"), F.sha2(content, 256).alias("sha256")
    )


@query
def path_expand(spark, sf):
    values = {"tb": "/data/tb", "fx": "/data/fx", "period": F.col("period")}
    path = X.fill_path(F.col("template"), values)
    return V.path_templates(spark, sf).select("o_orderkey", path.alias("path"))


@query
def tool_simplify(spark, sf):
    tools = F.array(
        F.concat("p_name", F.lit(" Mock API integration")),
        F.concat(F.lit("  "), "p_name", F.lit("\t Sandbox ")),
        F.concat("p_brand", F.lit(" API Integrations via workflow")),
        F.lit("mock"),
        F.lit("  "),
        F.col("p_brand"),
    )
    return V.table(spark, sf, "part").select(
        "p_partkey", F.array_join(X.tool_names(tools), "|").alias("tools")
    )


@query
def catalog_ref(spark, sf):
    kind = F.col("p_type")
    path = (
        F.when(kind == "ECONOMY", F.concat(F.lit("notebooks/"), "p_name", F.lit(".ipynb")))
        .when(kind == "LARGE", F.concat(F.lit("./notebooks//"), "p_name", F.lit("/")))
        .when(kind == "MEDIUM", F.lit("notebooks/"))
        .when(kind == "PROMO", F.concat(F.lit("/notebooks/./"), "p_name"))
        .when(kind == "SMALL", F.concat(F.lit("docs/notebooks/"), "p_brand"))
        .otherwise(F.concat(F.lit("notebooks_old/"), "p_brand"))
    )
    return V.table(spark, sf, "part").select("p_partkey", X.tutorial_ref(path).alias("ref"))


@query
def catalog_uuid(spark, sf):
    digits, lang = F.md5(F.col("text").cast("binary")), F.col("lang")
    value = (
        F.when(lang == "en", F.upper(digits))
        .when(lang == "fr", F.concat(F.lit("{"), F.regexp_replace(digits, "^(.{8})(.{4})", "$1-$2-"), F.lit("}")))
        .when(lang == "de", F.concat(F.lit("urn:uuid:"), digits))
        .otherwise(F.concat(F.lit("doc-"), digits))
    )
    return V.table(spark, sf, "documents").select("doc_id", X.canonical_uuid(value).alias("id"))


@query
def catalog_upsert(spark, sf):
    steps, toolsets = catalog.upsert_catalog(
        V.catalog_steps(spark, sf),
        V.catalog_toolsets(spark, sf),
        V.catalog_updates(spark, sf),
        ["day", "seq"],
        catalog.keyed_id,
    )
    # A step may own a large share of the toolsets, so its row is looked up, not merged.
    steps = staged(steps.withColumnRenamed("id", "step_id"), "steps")
    toolsets = staged(toolsets, "toolsets")
    return lookup_join(toolsets, steps, ["name"], "inner").select(
        "step_id", "name", "description", F.col("id").alias("toolset_id"), "tutorial", _joined("tools")
    )


# The whole close


@query
def close_pipeline(spark, sf):
    """Collect, translate and assemble; one log row per step, each with its own counts."""
    tb = staged(_collected(spark, sf).withColumnRenamed("Memo", "DocumentNo"), "ledger")
    adjusted = staged(fx.translate(tb, V.rates(spark, sf)), "adjusted")
    collected = tb.agg(
        F.count("*").alias("rows"),
        F.sum(F.col("Debit") - F.col("Credit")).cast("double").alias("amount"),
    ).withColumn("step", F.lit("collect"))
    translated = adjusted.agg(
        F.count("FXRate").alias("rows"),
        F.sum(F.abs("ReportingCurrencyAmount")).cast("double").alias("amount"),
    ).withColumn("step", F.lit("translate"))
    adjustment = fx.adjustments(adjusted, "202112")
    lines = adjusted.select(
        support.row_lines(adjusted, [*V.CANONICAL, "ReportingCurrencyAmount"])
    ).unionByName(adjustment.select(support.row_lines(adjustment)))
    assembled = (
        lines.agg(F.count("*").alias("rows"), F.sum(F.length("line")).cast("double").alias("amount"))
        .withColumn("step", F.lit("support"))
    )
    return collected.unionByName(translated).unionByName(assembled).select("step", "rows", "amount")


# The jobs, from files to files


def _new_folder(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark)}/closebook/{name}-{uuid.uuid4().hex}"


def _write_files(spark: SparkSession, path: str, text: DataFrame) -> None:
    """One file with the text of the table's only row."""
    row = text.toDF("letter_text").withColumns({"output_path": F.lit(path), "client_id": F.lit("")})
    sinks.write_letters(row, as_files=True)


@query
def tb_files(spark, sf):
    """The master ledger that ``collect_tb`` makes of trial-balance files."""
    folder = _new_folder(spark, "tb")
    sinks.write_letters(V.tb_files(spark, sf, folder), as_files=True)
    done = close.collect_tb(spark, folder, V.FILE_PERIOD, TB.names, f"{folder}/out/master")
    if not done.ok:
        raise ValueError(done.messages)
    return done.tables["master"].withColumns(_double("Debit", "Credit"))


@query
def close_files(spark, sf):
    """The run log of a whole close from files: rows of each step, and how many inputs and outputs it hashed."""
    folder = _new_folder(spark, "close")
    sinks.write_letters(V.tb_files(spark, sf, folder), as_files=True)
    _write_files(spark, f"{folder}/rates.json", V.rates_payload(spark, sf))
    close.close_period(spark, V.FILE_PERIOD, folder, f"{folder}/rates.json", f"{folder}/out")
    hashes = F.col("output_hashes")
    digests = F.transform(F.map_values(hashes), lambda h: F.split_part(h, F.lit(":"), F.lit(1)).cast("long"))
    return spark.read.parquet(f"{folder}/out/run_log").select(
        "step", "status", F.col("metrics.rows").cast("long").alias("rows"), F.col("metrics.files").cast("long").alias("files"),
        F.size("input_hashes").alias("inputs"), F.size(hashes).alias("outputs"), F.aggregate(digests, F.lit(0).cast("long"), lambda a, n: a + n).alias("rows_hashed"),
    )


@query
def close_files_adjustments(spark, sf):
    """The adjustment table of a whole close from files."""
    folder = _new_folder(spark, "close")
    sinks.write_letters(V.tb_files(spark, sf, folder), as_files=True)
    _write_files(spark, f"{folder}/rates.json", V.rates_payload(spark, sf))
    close.close_period(spark, V.FILE_PERIOD, folder, f"{folder}/rates.json", f"{folder}/out")
    return spark.read.parquet(f"{folder}/out/FX_Adjustments_{V.FILE_PERIOD}").withColumns(_double("LocalAmount", "FXRate", "ReportingCurrencyAmount"))


@query
def letter_files(spark, sf):
    """The letters that ``draft_letters`` makes of a roster, a service list, a template and a folder of prior letters."""
    folder = _new_folder(spark, "letters")
    V.clients(spark, sf).select(F.to_json("record")).write.text(f"{folder}/clients.jsonl")
    V.services(spark, sf).orderBy("p_partkey").select(F.to_json("record")).write.text(f"{folder}/services.jsonl")
    _write_files(spark, f"{folder}/template.dotx", spark.range(1).select(F.lit(V.TEMPLATE)))
    prior = V.prior_files(spark, sf)
    sinks.write_letters(prior.select(F.concat(F.lit(f"{folder}/prior/"), "file_name").alias("output_path"), F.col("text").alias("letter_text"), F.col("file_name").alias("client_id")), as_files=True)
    done = draft_letters(
        spark, V.LETTER_PERIOD, f"{folder}/clients.jsonl", f"{folder}/services.jsonl", f"{folder}/template.dotx",
        f"{folder}/out", f"{folder}/prior", generated_on=V.STAMP,
    )
    written = F.replace("output_path", F.lit(f"{folder}/out"), F.lit(V.LETTERS_DIR))
    made = done.tables["letters"].drop("letter_text").withColumn("service_lines", F.array_join("service_lines", "|"))
    # What the files hold is what the table holds.
    return read_files(made).withColumns({"output_path": written, "letter_text": F.col("content").cast("string")}).drop("content")


@query
def catalog_files(spark, sf):
    """The catalogue registered to twice in place, read back from its current version."""
    path = _new_folder(spark, "catalog")
    sinks.write_catalog(V.catalog_steps(spark, sf), V.catalog_toolsets(spark, sf), path)
    news = V.catalog_updates(spark, sf)
    for part in ("day < '19950101'", "day >= '19950101'"):
        register_tutorials(spark, path, news.filter(part), ["day", "seq"], make_id=catalog.keyed_id)
    steps, toolsets = read_catalog(spark, path)
    return lookup_join(toolsets, steps.withColumnRenamed("id", "step_id"), ["name"], "inner").select(
        "step_id", "name", "description", F.col("id").alias("toolset_id"), "tutorial", _joined("tools")
    )
