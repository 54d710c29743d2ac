"""Joins of the graph's tables. First-match rules are ranked windows with stated orders, never cross joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def targets_of(records: DataFrame, kind: str) -> DataFrame:
    return records.where(F.col("target_type") == kind).select(F.col("id").alias("record_id"), "target_id", "status", "confidence")


def with_records(df: DataFrame, records: DataFrame, kind: str, how: str = "left") -> DataFrame:
    """Rows with the records that target them."""
    found = targets_of(records, kind)
    return df.join(found, df["id"] == found["target_id"], how)


def to_nodes(edges: DataFrame, nodes: DataFrame, end: str) -> DataFrame:
    """Edges with the node at `end` (source or target) resolved; dangling edges go."""
    return edges.join(
        nodes.select(F.col("node_type").alias(f"{end}_type"), F.col("node_id").alias(f"{end}_id"), F.col("name").alias(f"{end}_name")),
        [f"{end}_type", f"{end}_id"],
    )


#: Rows of each side of a cell, and pairs that a task makes, about, where a key has many rows on both sides of a join.
CELL, TASK_PAIRS = 2048, 1 << 22


def many_pairs(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left inner join right on key, for keys that have many rows on both sides: the pairs of such a key are cells of
    about CELL by CELL rows, dealt over as many tasks as there are pairs for, so that a task's work does not grow with
    the tables. Rows of a side that are equal in all columns share a cell. Only the number of pairs comes to the driver,
    and keys with more than CELL rows on a side are broadcast."""
    left, right = left.where(F.col(key).isNotNull()), right.where(F.col(key).isNotNull())
    counted = lambda df, n: df.groupBy(key).agg(F.count(F.lit(1)).alias(n))
    both = counted(left, "_l").join(counted(right, "_r"), key)
    pairs = both.agg(F.sum(F.col("_l").cast("double") * F.col("_r"))).first()[0] or 0
    if pairs <= TASK_PAIRS:
        return left.join(right, key)
    cells = lambda n: F.ceil(F.col(n) / CELL).cast("int")
    heavy = F.broadcast(both.where((F.col("_l") > CELL) | (F.col("_r") > CELL)).select(key, cells("_l").alias("_l"), cells("_r").alias("_r")))

    def placed(df: DataFrame, own: str, other: str) -> DataFrame:
        at = F.pmod(F.xxhash64(*df.columns), F.coalesce(own, F.lit(1))).cast("int")
        copies = F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))
        out = df.join(heavy, key, "left").select(*df.columns, at.alias(f"{own}_at"), copies.alias(f"{other}_at"))
        return out.repartition(tasks, key, "_l_at", "_r_at")

    # not fewer than Spark's own number, or it would deal them anew
    tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(pairs) // TASK_PAIRS))
    return placed(left, "_l", "_r").join(placed(right, "_r", "_l").hint("merge"), [key, "_l_at", "_r_at"]).drop("_l_at", "_r_at")


def variables_of_equations(equations: DataFrame, variables: DataFrame) -> DataFrame:
    """Variables of each equation's symbol; equations without symbol have none."""
    wanted = variables.select(F.col("id").alias("variable_id"), "symbol_id", F.col("name").alias("variable_name"))
    return many_pairs(equations.select(F.col("id").alias("equation_id"), "symbol_id"), wanted, "symbol_id")


#: Lines of a file whose rows meet in one group when lines are held against intervals of lines.
LINES = 128


def by_lines(intervals: DataFrame) -> DataFrame:
    """intervals (start_line, end_line, ...), one row for each stretch of LINES lines that they touch, numbered _lines."""
    stretch = lambda line: F.floor(F.col(line) / LINES)
    return intervals.where("start_line <= end_line").withColumn("_lines", F.explode(F.sequence(stretch("start_line"), stretch("end_line"))))


def enclosing_symbols(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Each call with the first function (by place in the file) whose lines hold it, else the first class.

    Calls meet only the symbols that touch their LINES lines, not all of the file."""
    placed = by_lines(symbols.select("file_id", F.col("id").alias("symbol_id"), "symbol_type", "start_line", "end_line"))
    lines = calls.select(F.col("id").alias("call_id"), "file_id", "line", F.col("name").alias("called"), F.floor(F.col("line") / LINES).alias("_lines"))
    inside = lines.join(placed, ["file_id", "_lines"]).where("line between start_line and end_line").drop("_lines")
    kind = F.when(F.col("symbol_type") == "function", 0).otherwise(1)
    return first_of(inside, ["call_id"], [kind, F.col("start_line"), F.col("symbol_id")])


def parents(entities: DataFrame) -> DataFrame:
    """Each entity with the last other one, by (start, id), whose lines contain its own; keyed by file.

    An entity meets only those that touch the LINES lines around its start."""
    own = entities.select("file_id", "id", "start_line", "end_line", F.floor(F.col("start_line") / LINES).alias("_lines")).alias("a")
    around = by_lines(entities.select("file_id", "id", "start_line", "end_line")).alias("b")
    pairs = own.join(around, ["file_id", "_lines"]).where("a.id <> b.id and b.start_line <= a.start_line and b.end_line >= a.end_line")
    last = F.max(F.struct(F.col("b.start_line").alias("at"), F.col("b.id").alias("parent_id"))).alias("p")
    return pairs.groupBy(F.col("a.id").alias("id")).agg(last).select("id", "p.parent_id")


def module_of(path: Column) -> Column:
    return F.replace(F.replace(path, F.lit("/"), F.lit(".")), F.lit(".py"), F.lit(""))


def last_part(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def imports_by_name(names: DataFrame, files: DataFrame) -> DataFrame:
    """name -> id of the first file (by id) whose module is the name, or whose stem is the name's last part."""
    by_module = files.select(module_of(F.col("path")).alias("key"), "id")
    by_stem = files.select(F.replace("filename", F.lit(".py"), F.lit("")).alias("key"), "id")
    names = names.select("name").distinct()
    found = names.join(by_module, names["name"] == by_module["key"]).select("name", "id").unionByName(
        names.join(by_stem, last_part(names["name"]) == by_stem["key"]).select("name", "id")
    )
    return found.groupBy("name").agg(F.min("id").alias("file_id"))


def imports_by_suffix(names: DataFrame, files: DataFrame) -> DataFrame:
    """name -> id of the first file (by id) whose module is the name or ends with a dot and the name."""
    parts = F.split(module_of(F.col("path")), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    keyed = files.select("id", F.explode(suffixes).alias("name"))
    return keyed.join(names.select("name").distinct(), "name").groupBy("name").agg(F.min("id").alias("file_id"))


def symbols_by_name(names: DataFrame, symbols: DataFrame) -> DataFrame:
    """name -> id of the last symbol (by id) with that qualified name, or name where it has none."""
    keyed = symbols.select(F.coalesce("qualified_name", "name").alias("name"), "id")
    return names.select("name").distinct().join(keyed, "name").groupBy("name").agg(F.max("id").alias("symbol_id"))


def defining_files(names: DataFrame, symbols: DataFrame) -> DataFrame:
    """name -> the first file that defines a function or class of that name."""
    return names.select("name").distinct().join(symbols.select("name", "file_id"), "name").groupBy("name").agg(F.min("file_id").alias("file_id"))


def equations_by_name(wanted: DataFrame, equations: DataFrame) -> DataFrame:
    """(file_id, name) -> equation, of the same file if there is one, else of any; ties to the smaller id."""
    own = wanted.select("file_id", "name").distinct()
    local = equations.groupBy("file_id", "name").agg(F.min("id").alias("local_id"))
    any_ = equations.groupBy("name").agg(F.min("id").alias("any_id"))
    return own.join(local, ["file_id", "name"], "left").join(any_, "name", "left").select(
        "file_id", "name", F.coalesce("local_id", "any_id").alias("equation_id")
    ).where("equation_id is not null")


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change: added, deleted, changed or same, between two (path, hash) tables."""
    both = old.select("path", F.col("hash").alias("old_hash")).join(new.select("path", F.col("hash").alias("new_hash")), "path", "full_outer")
    change = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "deleted").when(F.col("old_hash") != F.col("new_hash"), "changed").otherwise("same")
    return both.select("path", change.alias("change"))


def without(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right.select(*keys).distinct(), keys, "left_anti")
