"""Reports for people: bar charts in SVG and tables in HTML, of small results.

Both take a result that is a report already (some rows for each size or group);
the caller's ``limit`` bounds what comes to the driver, and more is an error.
"""

from __future__ import annotations

import html

from pyspark.sql import DataFrame, SparkSession

from .files import bars

LIMIT = 10_000
WIDTH, BAR, STEP, LEFT, TOP = 640, 18, 26, 180, 44


def bar_chart(rows: DataFrame, label: str, value: str, title: str, unit: str = "", limit: int = LIMIT) -> str:
    """Horizontal bars, the largest value across the whole width; null and
    negative values have no bar. Rows in the order of their labels."""
    found = _few(bars(rows, label, value).orderBy("label"), limit)
    lines = [f'<text x="8" y="24" font-size="16">{html.escape(title)}</text>']
    for i, row in enumerate(found):
        y = TOP + i * STEP
        length = round((WIDTH - LEFT - 100) * max(row["share"] or 0.0, 0.0), 2)
        shown = "-" if row["value"] is None else f"{row['value']:.6g} {unit}".strip()
        lines.append(f'<text x="8" y="{y + 14}">{html.escape(str(row["label"]))}</text>')
        lines.append(f'<rect x="{LEFT}" y="{y}" width="{length}" height="{BAR}" fill="#345"/>')
        lines.append(f'<text x="{LEFT + length + 6:g}" y="{y + 14}">{html.escape(shown)}</text>')
    height = TOP + STEP * len(found) + 8
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH}" height="{height}" font-family="sans-serif" font-size="13">' + "".join(lines) + "</svg>"


def html_table(rows: DataFrame, caption: str = "", limit: int = LIMIT) -> str:
    """All columns and rows, every value escaped, null as an empty cell."""
    head = "".join(f"<th>{html.escape(c)}</th>" for c in rows.columns)
    body = "".join("<tr>" + "".join(f"<td>{'' if v is None else html.escape(str(v))}</td>" for v in row) + "</tr>" for row in _few(rows, limit))
    return f"<table><caption>{html.escape(caption)}</caption><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"


def html_page(title: str, *parts: str) -> str:
    """A page of parts that are HTML already."""
    return f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>{"".join(parts)}</body></html>'


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One file of any file system that Spark knows."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
    stream.write(text.encode())
    stream.close()


def _few(rows: DataFrame, limit: int) -> list:
    found = rows.limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"A report has at most {limit} rows.")
    return found
