"""Shard labels and numbers, mount labels and labels of moved shards."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label format.
DEFAULT_PREFIX = "sh"
LABEL_WIDTH = 4

# Endings of shards left behind by moves.
RETIRED_SUFFIXES = r"(old_\d+|old\d*|new)"

# Characters a source name may keep in its label.
SOURCE_LABEL_GAPS = "[^a-zA-Z0-9]+"


def shard_name(number: Column, prefix: str = DEFAULT_PREFIX, width: int = LABEL_WIDTH) -> Column:
    """Label of a shard number: prefix + zero-padded number."""
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), width, "0"))


def shard_no(label: Column) -> Column:
    """First run of digits in a label as INT, null when there is none."""
    digits = F.regexp_extract(label, r"(\d+)", 1)
    return F.nullif(digits, F.lit("")).try_cast("int")


def source_label(host: Column, prefix: str) -> Column:
    """Label of a mounted source."""
    return F.concat(F.lit(prefix + "_"), F.regexp_replace(host, SOURCE_LABEL_GAPS, "_"))


def mount_label(shard: Column, prefix: str) -> Column:
    """Label under which a source's shard is mounted."""
    return F.concat(F.lit(prefix + "_"), shard)


def strip_prefix(label: Column, prefix: str | None) -> Column:
    """Mount label without prefix and separator; other labels stay as they are."""
    if prefix is None:
        return label
    rest = F.substring(label, F.lit(len(prefix) + 2), F.length(label))
    return F.when(label.startswith(prefix), rest).otherwise(label)


def old_label(label: Column, at: Column) -> Column:
    """Label of the copy a move leaves behind; `at` is a TIMESTAMP in session time (use UTC)."""
    return F.concat(label, F.lit("old"), F.date_format(at, "yyyyMMddHHmmss"))


def new_label(label: Column) -> Column:
    """Label of a copy made by a dry-run move."""
    return F.concat(label, F.lit("new"))


def retired_pattern(base_re: str = DEFAULT_PREFIX + r"\d+") -> str:
    """Pattern of labels that moves leave behind, for shards labelled like base_re."""
    return f"^({base_re}){RETIRED_SUFFIXES}$"
