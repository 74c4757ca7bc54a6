"""Results as files: lines of JSON and CSV from tables of any size, and one JSON or Markdown document from small ones."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from hebbspark.sources.snapshot import write_text

#: A document is made on the driver, so it has a limit; larger results are written as lines.
MOST_ROWS = 10_000


def write_lines(df: DataFrame, folder: str) -> None:
    """One JSON object a line, null fields kept; a folder of part files."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(folder)


def write_csv(df: DataFrame, folder: str, columns: Sequence[str] | None = None) -> None:
    """CSV with a header in every part file and the columns in the given order; quotes are doubled, null is an empty field."""
    out = df.select(*columns) if columns else df
    out.write.mode("overwrite").option("header", "true").option("escape", '"').option("emptyValue", '""').csv(folder)


def _rows(df: DataFrame) -> list[dict]:
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a document holds at most {MOST_ROWS} rows; write lines instead")
    return [r.asDict(recursive=True) for r in rows]


def write_document(df: DataFrame, path: str, **head) -> None:
    """One JSON document ``{**head, "rows": [...]}``, replaced in one step."""
    text = json.dumps({**head, "rows": _rows(df)}, ensure_ascii=False, indent=2, default=str)
    write_text(df.sparkSession, path, text + "\n")


def markdown(df: DataFrame) -> str:
    """A Markdown table of the rows in their order; bars and line ends in values are escaped."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [df.columns, ["-"] * len(df.columns), *([cell(r[c]) for c in df.columns] for r in _rows(df))]
    return "".join(f"| {' | '.join(line)} |\n" for line in lines)


def write_markdown(spark: SparkSession, df: DataFrame, path: str, title: str = "") -> None:
    write_text(spark, path, (f"# {title}\n\n" if title else "") + markdown(df))
