"""ARFF and delimited text as DataFrames; only headers and distinct labels come to the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

ATTRIBUTE = re.compile(r"""@attribute\s+(?:'([^']*)'|"([^"]*)"|(\S+))\s+(.+?)\s*$""", re.I)


@dataclass
class Attribute:
    name: str
    kind: str  # NUMERIC, NOMINAL, STRING or DATE
    values: list[str] = field(default_factory=list)


def _unquoted(value: str) -> str:
    value = value.strip()
    return value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"" else value


def _attribute(line: str) -> Attribute:
    found = ATTRIBUTE.match(line)
    if not found:
        raise ValueError(f"Invalid attribute: {line}")
    name, kind = next(x for x in found.groups()[:3] if x is not None), found.group(4)
    if kind.startswith("{"):
        return Attribute(name, "NOMINAL", [_unquoted(v) for v in kind.strip("{} \t").split(",")])
    word = kind.split()[0].upper()
    return Attribute(name, "NUMERIC" if word in ("NUMERIC", "REAL", "INTEGER") else word)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("value")).where("value != '' AND NOT value LIKE '\\%%'")


def arff_header(spark: SparkSession, path: str) -> tuple[str, list[Attribute]]:
    lines = [r.value for r in _lines(spark, path).where("value LIKE '@%'").collect()]
    if not any(x.lower().startswith("@data") for x in lines):
        raise ValueError("No @DATA section: data rows come before it")
    relation = next((_unquoted(x.split(None, 1)[1]) for x in lines if x.lower().startswith("@relation")), "")
    return relation, [_attribute(x) for x in lines if x.lower().startswith("@attribute")]


def read_arff(spark: SparkSession, path: str) -> DataFrame:
    """One column an attribute: DOUBLE for numbers (? is NaN), STRING otherwise; metadata has the relation, kind and values."""
    relation, attributes = arff_header(spark, path)
    rows = _lines(spark, path).where("NOT value LIKE '@%'")
    cells = rows.select(F.from_csv("value", F.lit(", ".join(f"c{i} STRING" for i in range(len(attributes)))), {"quote": "'", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}).alias("r"))
    columns = []
    for i, a in enumerate(attributes):
        cell = F.col(f"r.c{i}")
        value = F.when(cell == "?", F.lit(float("nan"))).otherwise(cell.cast("double")) if a.kind == "NUMERIC" else F.when(cell != "?", cell)
        columns.append(value.alias(a.name, metadata={"relation": relation, "kind": a.kind, "values": a.values}))
    return cells.select(*columns)


def nominal_codes(frame: DataFrame, column: str) -> DataFrame:
    """The column as its place in the order of declaration (from 0)."""
    values = frame.schema[column].metadata["values"]
    return frame.withColumn(column, F.array_position(F.array(*map(F.lit, values)), F.col(column)).cast("int") - 1)


def numeric_target(column: str) -> Column:
    """A label as double; anything that is no number raises."""
    return F.col(column).cast("double")


def read_delimited(spark: SparkSession, path: str, response: int = -1, delimiter: str = "\\s+") -> DataFrame:
    """(row_id, features ARRAY<DOUBLE>, label STRING); the response column counts from 0, -1 is the last."""
    cells = _lines(spark, path).select(F.monotonically_increasing_id().alias("row_id"), F.split("value", delimiter).alias("c"))
    label = F.element_at("c", response + 1 if response >= 0 else response)
    place = F.lit(response) if response >= 0 else F.size("c") + response
    features = F.transform(F.filter("c", lambda x, i: i != place), lambda x: x.cast("double"))
    return cells.select("row_id", features.alias("features"), label.alias("label"))


def first_seen_codes(frame: DataFrame, label: str = "label", row_id: str = "row_id", known: dict[str, int] | None = None) -> tuple[DataFrame, dict[str, int]]:
    """Labels as numbers in order of first appearance; codes of another file (`known`) are kept and extended."""
    known = dict(known or {})
    first = frame.groupBy(label).agg(F.min(row_id).alias("_first")).orderBy("_first").collect()  # one row a label
    for r in first:
        known.setdefault(r[0], len(known))
    table = frame.sparkSession.createDataFrame(list(known.items()), T.StructType([T.StructField(label, T.StringType()), T.StructField("label_code", T.IntegerType())]))
    return frame.join(table, label), known


def rule_text(antecedent="antecedent", consequent="consequent", support="support", confidence="confidence"):
    """A rule in words, as percentages."""
    join = lambda c: F.concat_ws(", ", F.col(c))
    return F.format_string("(%s) => (%s) support = %.2f%% confidence = %.2f%%", join(antecedent), join(consequent), F.col(support) * 100, F.col(confidence) * 100)
