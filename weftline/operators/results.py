"""Analysis results: strict validation against the fields of their kind, and their way into tables and records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import scalars as fn
from weftline.functions import values
from weftline.operators.joins import first_of

#: Spark types of the fields' kinds; kinds with a list of allowed words are texts.
TYPES = {"text": "string", "maybe": "string", "flag": "boolean", "share": "double", "texts": "array<string>", "pairs": "map<string,string>", "edges": "array<map<string,string>>"}
#: Columns that a submitted result changes, by kind of target.
CHANGES = {
    "file": ["purpose", "llm_summary", "llm_confidence", "is_core", "key_concepts", "risk_notes", "analysis_status"],
    "symbol": ["llm_summary", "responsibility", "side_effects", "confidence"],
    "equation": ["name", "equation_type", "mathematical_meaning", "physical_meaning", "algorithmic_role", "inputs_json", "outputs_json",
                 "intermediate_variables_json", "constants_json", "units_json", "assumptions", "confidence"],
}


def fields(kind: str) -> list[tuple[str, str, str | None]]:
    """(name, kind, default) of each field of a result."""
    lines = [line.split() for line in values.RESULT_FIELDS[kind].strip().split("\n")]
    return [(x[0], x[1], x[2] if len(x) > 2 else None) for x in lines]


def schema_of(kind: str) -> str:
    return ", ".join(f"{name} {TYPES.get(what, 'string')}" for name, what, _ in fields(kind))


def _problem(name: str, what: str, default: str | None, parsed: Column) -> Column:
    """Null, or what is wrong with one field of a parsed result."""
    there = F.try_variant_get(parsed, f"$.{name}", "variant")
    found, text = F.schema_of_variant(there), F.try_variant_get(parsed, f"$.{name}", "string")
    said = lambda problem: F.lit(f"{name}: {problem}")
    required = default is None and what in ("text", "flag", "share")
    missing = F.when(there.isNull(), said("missing") if required else F.lit(None).cast("string"))
    if what in values.ALLOWED:
        return missing.when(found != "STRING", said("no text")).when(~text.isin(values.ALLOWED[what]), said("not allowed"))
    if what == "share":
        number = F.try_variant_get(parsed, f"$.{name}", "double")
        wrong = number.isNull() | ~(found.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)") | (found == "STRING"))
        return missing.when(wrong, said("no number")).when(~number.between(0, 1), said("out of range"))
    if what == "flag":
        return missing.when(found != "BOOLEAN", said("no flag"))
    if what == "texts":
        items = F.try_variant_get(parsed, f"$.{name}", "array<string>")
        return missing.when(~found.isin("ARRAY<STRING>", "ARRAY<VOID>") | F.exists(items, lambda x: x.isNull()), said("no list of texts"))
    if what == "pairs":
        items = F.try_variant_get(parsed, f"$.{name}", "map<string,variant>")
        return missing.when(~found.startswith("OBJECT<") | F.exists(F.map_values(items), lambda x: F.schema_of_variant(x) != "STRING"), said("no texts by name"))
    if what == "edges":
        items = F.try_variant_get(parsed, f"$.{name}", "array<variant>")
        return missing.when(~found.startswith("ARRAY<") | F.exists(items, lambda x: ~F.schema_of_variant(x).startswith("OBJECT<")), said("no list of edges"))
    allowed = found.isin("STRING", "VOID") if what == "maybe" else found == "STRING"
    return missing.when(~allowed, said("no text"))


def validated(results: DataFrame, kind: str, column: str = "output_json") -> DataFrame:
    """results with is_valid, error (the first field that is wrong), new_status, and `result`: the fields as a struct,
    defaults filled in, null where invalid. Unknown fields are not read; a number may stand in a text."""
    parsed = F.try_parse_json(column)
    no_object = F.when(parsed.isNull(), "invalid JSON").when(~F.schema_of_variant(parsed).startswith("OBJECT<"), "no object")
    error = F.coalesce(no_object, *(_problem(*f, parsed) for f in fields(kind)))
    read = F.from_json(column, schema_of(kind))
    cells = []
    for name, what, default in fields(kind):
        cell = F.try_variant_get(parsed, f"$.{name}", "double") if what == "share" else read[name]
        if what in ("texts", "edges"):
            cell = F.coalesce(cell, F.array().cast(TYPES[what]))
        elif what == "pairs":
            cell = F.coalesce(cell, F.expr("cast(map() as map<string,string>)"))
        elif default is not None:
            cell = F.coalesce(cell, F.lit(default == "true" if what == "flag" else default))
        cells.append(cell.alias(name))
    out = results.withColumn("error", error).withColumn("is_valid", F.col("error").isNull())
    return out.withColumns({"new_status": F.when(F.col("is_valid"), "completed").otherwise("failed"), "result": F.when(F.col("is_valid"), F.struct(*cells))})


def judged(submissions: DataFrame, targets: DataFrame, kind: str) -> DataFrame:
    """submissions (id, task_id, output_json) with target_id (the number behind the task id's last underscore),
    accepted, error and result: valid ones whose target (id) exists are accepted."""
    known = targets.select(F.col("id").alias("target_id"), F.lit(True).alias("_known")).distinct()
    found = validated(submissions.withColumn("target_id", fn.task_key(F.col("task_id"))), kind).join(known, "target_id", "left")
    lost = F.when(F.col("_known").isNull(), F.concat(F.lit(f"{kind} record not found for task_id "), "task_id"))
    return found.withColumn("error", F.coalesce("error", lost)).withColumn("accepted", F.col("error").isNull()).drop("_known")


def latest(accepted: DataFrame) -> DataFrame:
    """The last accepted submission (by id) of each target."""
    return first_of(accepted.where("accepted"), ["target_id"], [F.desc("id")])


def submitted(targets: DataFrame, done: DataFrame, kind: str) -> DataFrame:
    """targets (id, ...) with the columns of CHANGES[kind] taken from their latest() result, lists as JSON text; other
    rows and columns stay. Columns that targets lack are added, null where there is no result."""
    r = lambda name: F.col("result")[name]
    json = lambda name: F.to_json(r(name))
    new = {
        "file": [r("purpose"), r("summary"), r("confidence"), r("is_core"), json("key_concepts"), json("risk_notes"), F.lit("completed")],
        "symbol": [r("responsibility"), r("responsibility"), json("side_effects"), r("confidence")],
        "equation": [r("name"), r("equation_type"), r("mathematical_meaning"), r("physical_meaning"), r("algorithmic_role"), json("inputs"), json("outputs"),
                     json("intermediate_variables"), json("constants"), json("units"), json("assumptions"), r("confidence")],
    }[kind]
    cells = [c.alias(f"_{name}") for name, c in zip(CHANGES[kind], new, strict=True)]
    joined = targets.join(done.select(F.col("target_id").alias("id"), F.lit(True).alias("_done"), *cells), "id", "left")
    changed = {name: F.when(F.col("_done"), F.col(f"_{name}")).otherwise(F.col(name)) if name in targets.columns else F.col(f"_{name}") for name in CHANGES[kind]}
    return joined.withColumns(changed).drop("_done", *(f"_{name}" for name in CHANGES[kind]))


def with_results(records: DataFrame, done: DataFrame, kind: str) -> DataFrame:
    """records (target_type, target_id, output_json, confidence, status) after results came in: one record for each
    target with a result, completed, whether it was there before or not; all others stay."""
    keys = done.select(F.lit(kind).alias("target_type"), "target_id")
    new = done.select(
        F.lit(kind).alias("target_type"), "target_id", F.to_json("result").alias("output_json"), F.col("result.confidence").alias("confidence"), F.lit("completed").alias("status")
    )
    return records.join(keys, ["target_type", "target_id"], "left_anti").select(*new.columns).unionByName(new)


def prompt(template: str, context: dict[str, Column], kind: str) -> Column:
    """A template's slots filled from the context, and the fields that the answer must have."""
    asked = ", ".join(f"{name} ({' | '.join(values.ALLOWED[what]) if what in values.ALLOWED else TYPES[what]})" for name, what, _ in fields(kind))
    return F.concat(fn.filled(template, **context), F.lit(f"\nAnswer with one JSON object of these fields: {asked}"))


def all_results(kinds: dict[str, DataFrame]) -> DataFrame:
    """id, kind, accepted, error of several kinds' judged() submissions."""
    return reduce(DataFrame.unionByName, [df.select("id", F.lit(kind).alias("kind"), "accepted", "error") for kind, df in kinds.items()])
