"""Column functions on paths, names, texts and JSON. All stay inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions import values


def glob_regex(glob: str) -> str:
    """A glob as a regular expression for the whole string; * crosses path separators."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in glob[i + 1 :]:
            end = glob.index("]", i + 1)
            inner = glob[i + 1 : end]
            out += "[" + ("^" + inner[1:] if inner.startswith("!") else inner) + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^(?:{out})$"


def any_glob(text: Column, globs: list[str]) -> Column:
    return text.rlike("|".join(glob_regex(g) for g in globs))


def filename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(name: Column) -> Column:
    """From the last dot on; none for names that only begin with a dot or end with one."""
    return F.lower(F.regexp_extract(name, r"[^/](\.[^./]+)$", 1))


def stem(name: Column) -> Column:
    ending = F.regexp_extract(name, r"[^/](\.[^./]+)$", 1)
    return F.substring(name, F.lit(1), F.length(name) - F.length(ending))


def excluded(path: Column, globs: list[str] | None = None) -> Column:
    """Whether any part of the path fits a glob."""
    rx = "|".join(glob_regex(g) for g in (globs or values.EXCLUDE))
    return F.exists(F.split(path, "/"), lambda part: part.rlike(rx))


def language(path: Column) -> Column:
    """By extension, else by the file name; null if unknown."""
    by_extension = F.create_map(*[F.lit(x) for kv in sorted(values.EXTENSIONS.items()) for x in kv])
    found = by_extension[suffix(filename(path))]
    for glob, lang in values.NAME_GLOBS:
        found = F.coalesce(found, F.when(filename(path).rlike(glob_regex(glob)), lang))
    return found


def is_test(path: Column) -> Column:
    name = filename(path)
    return any_glob(path, values.TEST_GLOBS) | any_glob(name, values.TEST_GLOBS) | F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, values.TEST_PARTS)))


def is_config(path: Column) -> Column:
    return any_glob(filename(path), values.CONFIG_GLOBS)


def is_entrypoint(path: Column) -> Column:
    return filename(path).isin(values.ENTRYPOINT_NAMES) | F.lower(stem(filename(path))).isin(values.ENTRYPOINT_STEMS)


def included(path: Column) -> Column:
    """Known extension, or a configuration file."""
    return suffix(filename(path)).isin(sorted(values.EXTENSIONS)) | is_config(path)


def looks_like_equation(source: Column, words: list[str] | None = None) -> Column:
    return F.lower(source).rlike("|".join(map(re.escape, words or values.EQUATION_WORDS)))


def unquoted(text: Column) -> Column:
    return F.regexp_replace(text, "^[\"']+|[\"']+$", "")


def comment_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "^[# /]+", ""))


def qualified(parent_qualified: Column, parent: Column, name: Column) -> Column:
    return F.concat_ws(".", F.coalesce(parent_qualified, parent), name)


def task_key(task_id: Column) -> Column:
    """The number behind the last underscore."""
    return F.substring_index(task_id, "_", -1).try_cast("bigint")


def context_hash(*columns: str) -> Column:
    """First 16 hex digits of the digest of the columns as JSON, keys sorted."""
    return F.substring(F.sha2(F.to_json(F.struct(*sorted(columns))), 256), 1, 16)


def model_prices(model: Column) -> tuple[Column, Column]:
    """US dollars for a million tokens in and out; the default where the model is null or not listed."""
    known = [F.create_map(*[F.lit(x) for name, both in sorted(values.MODEL_PRICES.items()) for x in (name, both[i])]) for i in (0, 1)]
    return tuple(F.coalesce(m[model], F.lit(d)) for m, d in zip(known, values.DEFAULT_PRICES, strict=True))


def estimated_cost(system: Column, user: Column, model: Column | None = None) -> Column:
    """US dollars: four characters a token, 500 tokens out, at the model's price."""
    price_in, price_out = model_prices(F.lit(None).cast("string") if model is None else model)
    tokens = (F.length(system) + F.length(user)) / F.lit(4.0)
    return tokens / 1_000_000 * price_in + F.lit(float(values.OUTPUT_TOKENS)) / 1_000_000 * price_out


def class_kind(query_type: Column) -> Column:
    """Kind of a class-like definition by the name of the query that found it; other names lose a plural s."""
    pairs = [F.lit(x) for line in values.CLASS_KINDS.split("\n") if line for x in line.split()]
    return F.coalesce(F.create_map(*pairs)[query_type], F.regexp_replace(query_type, "s+$", ""))


def safe_json(text: Column, schema: str) -> Column:
    """The text as JSON of the schema; null if it is not JSON as a whole."""
    return F.when(F.try_parse_json(text).isNotNull(), F.from_json(text, schema))


def filled(template: str, **cells: Column) -> Column:
    """A template with {name} slots, filled with columns; a null fills as empty."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(F.lit(p) if i % 2 == 0 else F.coalesce(cells[p].cast("string"), F.lit("")) for i, p in enumerate(parts)))


def edited(text: Column, kind: Column, start: Column, end: Column, new: Column) -> Column:
    """One line edit, 1-based and inclusive: replace or delete lines start..end (end null: one line), insert before start."""
    lines, last = F.split(text, "\n", -1), F.coalesce(end, start)
    cut = F.when(kind == "insert", start - 1).otherwise(last)
    head = F.slice(lines, F.lit(1), F.greatest(start - 1, F.lit(0)))
    tail = F.slice(lines, F.least(cut, F.size(lines)) + 1, F.size(lines))
    middle = F.when(kind == "delete", F.array().cast("array<string>")).otherwise(F.split(new, "\n", -1))
    return F.array_join(F.concat(head, middle, tail), "\n")
