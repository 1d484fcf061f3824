"""Small reports as Markdown beside JSON, from which the same Markdown is made again byte for byte."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame


def rows_of(df: DataFrame, order: list[str], most: int = 10_000) -> list[dict]:
    """The rows of a report in order; a table of more than `most` rows is no report and is not collected."""
    found = df.orderBy(*order).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a report has at most {most} rows")
    return [r.asDict() for r in found]


def markdown(title: str, columns: list[str], rows: list[dict]) -> str:
    """A heading and a table; numbers with four places, a missing value as a dash."""

    def cell(x) -> str:
        return "-" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x).replace("|", "\\|").replace("\n", " ")

    lines = [f"# {title}", "", f"| {' | '.join(columns)} |", f"|{'---|' * len(columns)}"]
    return "\n".join([*lines, *(f"| {' | '.join(cell(r[c]) for c in columns)} |" for r in rows)]) + "\n"


def write(df: DataFrame, title: str, order: list[str]) -> tuple[str, str]:
    """(Markdown, JSON) of a small result."""
    data = {"title": title, "columns": df.columns, "rows": rows_of(df, order)}
    text = json.dumps(data, sort_keys=True, default=str)
    return render(text), text


def render(text: str) -> str:
    """The Markdown of a report's JSON."""
    data = json.loads(text)
    return markdown(data["title"], data["columns"], data["rows"])
