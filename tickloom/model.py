"""The canonical tables and the code lists of traces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the codes, in the order of the codes from 0.
STATUS = ["unset", "ok", "error", "aborted", "open"]
SPAN_KIND = ["unspecified", "internal", "server", "client", "producer", "consumer"]
RECORD_KIND = ["transaction", "clock", "event", "stage", "log", "embedded_event", "embedded_stage"]
SEVERITY = ["trace", "debug", "info", "warn", "error", "fatal"]
DIRECTION = ["implicit", "input", "output", "inout", "buffer", "linkage"]
FILE_TYPE = ["verilog", "vhdl", "mixed", "systemc", "architectural", "software"]
SCOPE_TYPE = [
    "module", "task", "function", "begin", "fork", "generate", "struct", "union", "class", "interface", "package", "program",
    "vhdl_architecture", "vhdl_procedure", "vhdl_function", "vhdl_record", "vhdl_process", "vhdl_block", "vhdl_for_generate",
    "vhdl_if_generate", "vhdl_generate", "vhdl_package", "sv_array",
]
SCOPE_TYPE_MORE = {64: "generic", 65: "sc_module", 66: "resource", 67: "instrumentation_scope", 68: "core"}
VAR_TYPE = [
    "event", "integer", "parameter", "real", "real_parameter", "reg", "supply0", "supply1", "time", "tri", "triand", "trior", "trireg",
    "tri0", "tri1", "wand", "wire", "wor", "port", "sparray", "realtime", "string", "bit", "logic", "int", "shortint", "longint", "byte",
    "enum", "shortreal",
]
VAR_TYPE_MORE = {64: "bits", 65: "bytes"}
#: Characters of the signal states, by their codes from 0.
STATES = "01xzuwlh-"
#: Reserved generator kinds; every other kind is an ordinary transaction source.
RESERVED_KINDS = ("CLOCK", "EVENT", "STAGE", "LOG")
# Kinds of the sections of a recording.
SECTION_KIND = {
    1: "META", 2: "STRINGS", 3: "HIERARCHY", 4: "SIGNAL_BLOCK", 5: "TX_BLOCK", 6: "BLACKOUT", 7: "DIRECTORY", 9: "RECORD_BLOCK", 10: "DATATYPES", 11: "VALUES",
}


def code_name(code: Column | str, names: list[str], more: dict[int, str] | None = None, other: str | None = "other") -> Column:
    """The name of a code; codes without a name (and NULL) give `other` (NULL stays NULL)."""
    c = F.col(code) if isinstance(code, str) else code
    pairs = [(i, n) for i, n in enumerate(names)] + sorted((more or {}).items())
    out = F.create_map(*(F.lit(x) for pair in pairs for x in pair))
    return F.when(c.isNotNull(), F.coalesce(F.try_element_at(out, c.cast("int")), F.lit(other)))


#: DDL of the canonical tables; `sources` fill them and operators read them.
TABLES = {
    "changes": "signal_id bigint, time bigint, seq bigint, text string, real double",
    "transactions": "id bigint, parent bigint, generator bigint, begin bigint, end bigint, status int, span_kind int, attrs array<bigint>, block bigint",
    "embedded": "id bigint, owner bigint, name string, lane string, begin bigint, end bigint",
    "located": "id bigint, kind string, generator bigint, begin bigint, end bigint, parent bigint",
    "relations": "seq bigint, kind string, source bigint, destination bigint, block bigint",
    "nodes": "node_id bigint, parent_id bigint, node_kind string, name string",
    "clocks": "clock bigint, id bigint, begin bigint, end bigint, period bigint",
    "callsites": "datatype_id int, format string, severity int",
    "logs": "id bigint, generator bigint, datatype_id int, begin bigint, parent bigint, arg bigint",
}
