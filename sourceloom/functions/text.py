"""Column functions over paths and text; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sourceloom import rules

SPACES = f"[{rules.SPACE}]"
# A line with its terminator, as a universal-newline split keeps it.
_BREAK = r"\n\x0b\x0c\r\x1c\x1d\x1e\x{85}\x{2028}\x{2029}"
# Cuts after each terminator; a carriage return and its newline stay together.
LINE_END = rf"(?<=[{_BREAK}])(?<!\r(?=\n))"
LINE_PATTERN = rf"[^{_BREAK}]*(?:\r\n|[{_BREAK}])|[^{_BREAK}]+"


def java(pattern: str, multiline: bool = True) -> str:
    """Only ``\\n`` ends a line; ``^`` matches after it when ``multiline``."""
    return ("(?dm)" if multiline else "(?d)") + pattern


def find_all(text: Column, pattern: str, group: int = 0, multiline: bool = True) -> Column:
    return F.regexp_extract_all(text, F.lit(java(pattern, multiline)), F.lit(group))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-cased last suffix with its dot; '' for dotfiles and names without one."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def extension_label(path: Column) -> Column:
    """Text after the last dot of the whole path, or 'unknown'."""
    return F.when(F.contains(path, F.lit(".")), F.substring_index(path, ".", -1)).otherwise("unknown")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(rules.SPACE_CHARS))


def words(text: Column) -> Column:
    """Maximal runs of word characters."""
    return F.regexp_extract_all(text, F.lit(f"[{rules.WORD}]+"), F.lit(0))


def tokens(text: Column) -> Column:
    """Maximal runs of non-space characters."""
    return F.regexp_extract_all(text, F.lit(f"[^{rules.SPACE}]+"), F.lit(0))


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def kept_lines(text: Column) -> Column:
    return F.filter(F.split(text, LINE_END), lambda x: x != "")


def literal_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def lookup(key: Column, table: dict[str, str]) -> Column:
    """Value of a constant map, NULL when absent."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def any_of(conditions: list[Column]) -> Column:
    result = conditions[0]
    for c in conditions[1:]:
        result = result | c
    return result


def preview(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def complexity_tokens(text: Column) -> Column:
    """Occurrences of branch keywords, try included."""
    return F.size(F.filter(words(text), lambda w: w.isin(rules.BRANCH_KEYWORDS_WITH_TRY))).cast("bigint")


def complexity_distinct(text: Column) -> Column:
    """How many different branch keywords occur."""
    return F.size(F.array_intersect(words(text), literal_array(rules.BRANCH_KEYWORDS))).cast("bigint")


def near_empty(text: Column) -> Column:
    return F.length(strip(text)) < rules.MIN_TRANSLATED_CHARS


def untranslated(original: Column, migrated: Column) -> Column:
    return strip(migrated) == strip(original)


def module_of(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.split_part(path, F.lit("/"), F.lit(1))).otherwise("root")


def target_path(path: Column, new_extension: Column) -> Column:
    """Replace everything after the last dot of the whole path; append where there is none."""
    cut = F.substring_index(path, ".", -1)
    return F.when(
        F.contains(path, F.lit(".")),
        F.concat(F.substring(path, F.lit(1), F.length(path) - F.length(cut) - 1), new_extension),
    ).otherwise(F.concat(path, new_extension))


def prompt_key(model: Column, system: Column, user: Column) -> Column:
    """Prompts share a key only if model, system and user text agree as a whole."""
    raw = F.concat_ws(
        ":",
        F.coalesce(model, F.lit("")),
        F.coalesce(system, F.lit("")),
        F.coalesce(user, F.lit("")),
    )
    return F.sha2(raw, 256)


def metric_key(name: Column, labels: Column) -> Column:
    """``name{k="v",...}`` with labels in key order; the bare name without labels."""
    rendered = F.array_join(
        F.transform(
            F.array_sort(F.map_entries(labels)),
            lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"')),
        ),
        ",",
    )
    bare = labels.isNull() | (F.size(labels) == 0)
    return F.when(bare, name).otherwise(F.concat(name, F.lit("{"), rendered, F.lit("}")))


def micros_between(started: Column, ended: Column) -> Column:
    return F.unix_micros(ended.cast("timestamp")) - F.unix_micros(started.cast("timestamp"))


def duration_ms(started: Column, ended: Column) -> Column:
    return micros_between(started, ended) / 1000.0
