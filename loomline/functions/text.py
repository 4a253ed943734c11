"""What is read from an event's text, and hashes of events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of ids that may be read from a message. Fixed values.
ID_NAMES = ("request", "trace", "session", "correlation", "span")


def extract_join_keys(message: Column, names: tuple[str, ...] = ID_NAMES) -> Column:
    """Map of <name>_id to the first value that follows such a name in the message, in any case; names not found are left out."""
    found = [(f"{n}_id", F.regexp_extract(F.coalesce(message, F.lit("")), rf"(?i){n}[_-]?id[=:\s]+[\"']?([a-zA-Z0-9-]+)", 1)) for n in names]
    pairs = F.create_map(*(x for n, v in found for x in (F.lit(n), v)))
    return F.map_filter(pairs, lambda _, v: v != "")


def extract_labels(line: Column) -> Column:
    """Map of key=value pairs in a line; values may be quoted, the last of equal keys wins, quoted empty values are left out."""
    pattern, text = r"(\w+)=(\"[^\"]*\"|'[^']*'|\S+)", F.coalesce(line, F.lit(""))
    of = lambda group: F.reverse(F.regexp_extract_all(text, F.lit(pattern), group))

    def pairs(x: Column) -> Column:
        """From names and values, last first: a name's first place is that of the value that counts."""
        kept = F.filter(F.sequence(F.lit(1), F.size(x["k"])), lambda i: (F.array_position(x["k"], x["k"][i - 1]) == i) & ~x["v"][i - 1].isin('""', "''"))
        return F.map_from_entries(F.transform(kept, lambda i: F.struct(x["k"][i - 1].alias("k"), F.regexp_replace(x["v"][i - 1], r"^(?:\"(.*)\"|'(.*)')\z", "$1$2").alias("v"))))

    # A lambda's variable holds the two lists, so each is found once a line.
    return F.transform(F.array(F.struct(of(1).alias("k"), of(2).alias("v"))), lambda x: F.when(F.size(x["k"]) > 0, pairs(x)).otherwise(F.create_map().cast("map<string,string>")))[0]


def content_hash(*fields: Column) -> Column:
    """SHA-256 of the given fields as JSON."""
    return F.sha2(F.to_json(F.struct(*(f.alias(f"f{k}") for k, f in enumerate(fields)))), 256)


def correlation_id() -> Column:
    """A random id; results don't use it, see operators.correlate."""
    return F.concat(F.lit("corr_"), F.unix_millis(F.current_timestamp()).cast("string"), F.lit("_"), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 9))


#: Classes of error messages by the texts that they contain, the first that fits. Fixed values.
ERROR_CLASSES = (
    ("timeouts", ("timeout",)),
    ("connection_errors", ("connection", "refused")),
    ("auth_errors", ("401", "403", "auth")),
    ("server_errors", ("500", "internal")),
)


def error_class(message: Column) -> Column:
    low, out = F.lower(F.coalesce(message, F.lit(""))), F.lit("other")
    for name, parts in reversed(ERROR_CLASSES):
        hit = F.lit(False)
        for p in parts:
            hit = hit | low.contains(p)
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out
