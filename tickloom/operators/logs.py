"""Log records and the callsites that say how to render them."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.formatting import Locale, format_brace, format_printf, format_value


def at_least(logs: DataFrame, callsites: DataFrame, severity: int) -> DataFrame:
    """Logs of callsites with at least a severity (codes above fatal count as more severe).
    Callsites are filtered before the join, which reaches the logs as a filter on datatype_id."""
    return logs.join(callsites.filter(F.col("severity") >= severity), "datatype_id")


def render_plain(logs: DataFrame, callsites: DataFrame, args: list[str]) -> DataFrame:
    """Adds `message` for formats whose places are all `{}`, by concatenation in the JVM. Places
    without an argument give `{?}`; formats with other braces give NULL (see `render`)."""
    joined = logs.join(callsites.select("datatype_id", "format"), "datatype_id")
    pieces = F.split("format", r"\{\}")
    values = F.array(*(F.coalesce(F.col(a).cast("string"), F.lit("{?}")) for a in args))
    filled = F.transform(pieces, lambda p, i: F.concat(p, F.when(i < F.size(pieces) - 1, F.coalesce(F.get(values, i), F.lit("{?}"))).otherwise("")))
    plain = ~F.replace("format", F.lit("{}"), F.lit("")).rlike(r"[{}]")
    return joined.withColumn("message", F.when(plain, F.array_join(filled, "")))


def render(logs: DataFrame, callsites: DataFrame, args: list[str], style: str = "brace", locale: Locale | None = None) -> DataFrame:
    """Adds `message` for any format of a style (brace or printf), in Arrow batches; formats are
    parsed once a process. NULL formats give NULL, NULL arguments `{?}`; an unknown style is an
    error rather than rendered with the wrong dialect. `locale` is the punctuation of brace formats
    with L."""
    if style not in ("brace", "printf"):
        raise ValueError(f"unknown format style {style!r}")
    one = (lambda f, row: format_brace(f, row, locale)) if style == "brace" else format_printf

    @F.arrow_udf("string")
    def message(fmt: pa.Array, values: pa.Array) -> pa.Array:
        rows = ([] if v is None else list(v.values()) for v in values.to_pylist())
        return pa.array([one(f, row) for f, row in zip(fmt.to_pylist(), rows, strict=True)], pa.string())

    joined = logs.join(callsites.select("datatype_id", "format"), "datatype_id")
    return joined.withColumn("message", message("format", F.struct(*(F.col(a).alias(f"a{i}") for i, a in enumerate(args)))))


def value_text(json_text: Column | str) -> Column:
    """Payloads or attributes, as JSON, in their debug form: quoted text, [lists] and {key: value} maps. NULL
    stays NULL; what is no JSON is NULL too."""

    @F.arrow_udf("string")
    def shown(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else _shown(v) for v in values.to_pylist()], pa.string())

    return shown(json_text)


def _shown(text: str) -> str | None:
    try:
        return format_value(json.loads(text))
    except ValueError:
        return None


def callsites_of(datatypes: DataFrame) -> DataFrame:
    """(datatype_id, format, style, severity, file, line, func) of datatypes whose attributes
    (array of (key, value)) say that they are callsites; the first of repeated keys counts."""
    def attr(key):
        return F.get(F.filter("attributes", lambda a: a["key"] == key), F.lit(0))["value"]

    return datatypes.filter(attr("log.format").isNotNull()).select(
        "datatype_id", attr("log.format").alias("format"), F.coalesce(attr("log.format_style"), F.lit("brace")).alias("style"),
        attr("log.severity").cast("bigint").alias("severity"), attr("log.file").alias("file"), attr("log.line").cast("bigint").alias("line"), attr("log.func").alias("func"),
    )


#: Reasons of a run's end, by their codes from 1 (fixed values).
ENDINGS = ["stopped", "exited", "crashed", "recovered", "poisoned"]
# Names of the signals that stop or crash a run, by number.
SIGNALS = dict(enumerate((
    "SIGHUP SIGINT SIGQUIT SIGILL SIGTRAP SIGABRT SIGBUS SIGFPE SIGKILL SIGUSR1 SIGSEGV SIGUSR2 SIGPIPE SIGALRM SIGTERM SIGSTKFLT SIGCHLD SIGCONT SIGSTOP SIGTSTP SIGTTIN "
    "SIGTTOU SIGURG SIGXCPU SIGXFSZ SIGVTALRM SIGPROF SIGWINCH SIGIO SIGPWR SIGSYS"
).split(), 1))
#: The fields that each reason uses; all others are zero (or false).
USED = {1: {"signal"}, 2: {"status"}, 3: {"signal", "code", "address", "thread", "sealed"}, 4: {"dropped"}, 5: set()}
ENDING_FIELDS = ("signal", "code", "address", "thread", "sealed", "status", "dropped")


def ending_text() -> Column:
    """The one sentence of a run's end, from its columns reason and ENDING_FIELDS; NULL for an
    unknown reason."""
    names = F.create_map(*(F.lit(x) for pair in SIGNALS.items() for x in pair))
    number = F.col("signal").cast("int")
    signal = F.coalesce(F.try_element_at(names, number), F.concat(F.lit("signal "), number.cast("string")))
    where = F.concat(F.lit(" (address 0x"), F.lower(F.hex("address")), F.lit(", thread "), F.col("thread").cast("string"), F.when(F.col("sealed"), ", sealed mid-call").otherwise(""), F.lit(")"))
    return (
        F.when(F.col("reason") == 1, F.concat(F.lit("stopped by "), signal))
        .when(F.col("reason") == 2, F.concat(F.lit("exited with status "), F.col("status").cast("string")))
        .when(F.col("reason") == 3, F.concat(F.lit("crashed by "), signal, where))
        .when(F.col("reason") == 4, F.concat(F.lit("recovered by scanning ("), F.col("dropped").cast("string"), F.lit(" bytes dropped)")))
        .when(F.col("reason") == 5, F.lit("sealed after a panic in the writer"))
    )


def ending_faults(endings: DataFrame) -> DataFrame:
    """Of run-ending records (id, message, reason and ENDING_FIELDS): those beyond the first, of an
    unknown reason, with fields that their reason doesn't use, or another text than its own."""
    first = endings.agg(F.min("id").alias("i")).scalar()
    stray = F.lit(False)
    for reason, used in USED.items():
        for f in ENDING_FIELDS:
            if f not in used:
                stray = stray | (F.col("reason") == reason) & (F.coalesce(F.col(f).cast("bigint"), F.lit(0)) != 0)
    return endings.filter((F.col("id") > first) | ~F.col("reason").between(1, len(ENDINGS)) | stray | ~F.col("message").eqNullSafe(ending_text()))
