"""Column names, types and header synonyms shared by all jobs."""

from __future__ import annotations

from pyspark.sql import types as T

# Money is decimal, never double: sums stay exact in any order, and HALF_UP
# rounding is well defined. AMOUNT * RATE needs 38 digits, so Spark keeps its scale.
AMOUNT = T.DecimalType(20, 4)
RATE = T.DecimalType(17, 10)
REPORTED = T.DecimalType(24, 2)

# The names and order of the columns of the ledger, the rates and the adjustments.
TB = T.StructType(
    [
        T.StructField("EntityCode", T.StringType()),
        T.StructField("AccountCode", T.StringType()),
        T.StructField("AccountName", T.StringType()),
        T.StructField("Debit", AMOUNT),
        T.StructField("Credit", AMOUNT),
        T.StructField("Period", T.StringType()),
        T.StructField("CurrencyCode", T.StringType()),
    ]
)

FX_RATES = T.StructType(
    [
        T.StructField("CurrencyCode", T.StringType()),
        T.StructField("FXRate", RATE),
        T.StructField("Period", T.StringType()),
        T.StructField("Source", T.StringType()),
    ]
)

FX_ADJ = T.StructType(
    [
        T.StructField("EntityCode", T.StringType()),
        T.StructField("AccountCode", T.StringType()),
        T.StructField("LocalAmount", AMOUNT),
        T.StructField("FXRate", RATE),
        T.StructField("ReportingCurrencyAmount", REPORTED),
        T.StructField("Period", T.StringType()),
    ]
)

# The header synonyms accepted for each canonical column, in order of preference.
ALIASES = {
    "EntityCode": ["Entity", "Company", "CompanyCode", "CoCode", "LegalEntity", "LE"],
    "AccountCode": ["GL", "GLCode", "Account", "Acct", "GL Account", "Account Number"],
    "AccountName": ["AccountDesc", "Account Description", "GL Name"],
    "Debit": ["Dr", "Debits", "Debit Amount"],
    "Credit": ["Cr", "Credits", "Credit Amount"],
    "Period": ["FiscalPeriod", "PeriodId", "YYYYMM", "PostingPeriod"],
    "CurrencyCode": ["Currency", "Curr", "ISO Currency", "LCY"],
    "FXRate": ["Rate", "FX", "ExchangeRate"],
    "ReportingCurrencyAmount": [
        "RptAmt",
        "Reporting Amount",
        "TranslatedAmount",
        "USD Amount",
        "Group Currency Amount",
    ],
    "LocalAmount": ["LC Amount", "Local Amt", "Functional Amount", "Amt LCY", "Amount"],
}

# The keys under which client and service records may hold a field, in order.
CLIENT_NAME_KEYS = ["ClientName", "client_name", "Name"]
CLIENT_ID_KEYS = ["ClientID", "client_id", "Id", "ID"]
FISCAL_YEAR_KEYS = ["FiscalYear", "fiscal_year", "FY"]
SERVICE_LIST_KEYS = [
    "service_line_codes",
    "ServiceLineCodes",
    "ServiceLines",
    "services",
    "ServiceAssignments",
]
NESTED_LIST_KEYS = ["codes", "items", "service_lines"]
ITEM_CODE_KEYS = ["code", "Code", "ServiceLineCode"]
SERVICE_CODE_KEYS = ["ServiceLineCode", "Code", "ServiceLine", "ServiceCode"]
SERVICE_TEXT_KEYS = ["Description", "ServiceLineDescription", "Name", "Service"]
SERVICE_RATE_KEYS = ["Rate", "BillingRate", "StandardRate", "HourlyRate"]

# One row per finished step; appended to, never rewritten.
RUN_LOG = T.StructType(
    [
        T.StructField("step", T.StringType()),
        T.StructField("period", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("messages", T.ArrayType(T.StringType())),
        T.StructField("metrics", T.MapType(T.StringType(), T.StringType())),
        T.StructField("input_hashes", T.MapType(T.StringType(), T.StringType())),
        T.StructField("output_hashes", T.MapType(T.StringType(), T.StringType())),
        T.StructField("logged_at", T.TimestampType()),
    ]
)
