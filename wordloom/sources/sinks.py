"""Results as XML, text files and stored documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def xml_escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def result_item(entry: Column, kind: Column, context: Column, label: Column, clid: Column) -> Column:
    """One result; a context of "0" is left out."""
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value.cast("string"), F.lit(f"</{name}>"))
    middle = F.when(context.cast("string") != "0", tag("contextId", context)).otherwise(F.lit(""))
    return F.concat(F.lit("<resultItem>"), tag("entryId", entry), tag("type", kind), F.coalesce(middle, F.lit("")), tag("label", xml_escaped(label)), tag("clid", clid), F.lit("</resultItem>"))


def results_page(results: DataFrame, total: DataFrame, begin: int, size: int) -> DataFrame:
    """One row ``xml``: a page of results (``pos``, ``entryid``, ``type``,
    ``contextid``, ``label``, ``clid``) with the ``n`` of ``total``.  A page
    holds ``size`` rows at most."""
    item = result_item(*(F.col(c) for c in ("entryid", "type", "contextid", "label", "clid")))
    rows = results.where(F.col("pos").between(begin, begin + size - 1)).select("pos", item.alias("item"))
    body = rows.groupBy().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda r: r["item"]), "").alias("body"))
    end = F.least(F.col("n"), F.lit(begin + size))
    head = F.format_string("<results total='%s' begin='%s' end='%s'>", F.col("n"), F.lit(begin), end)
    return body.crossJoin(F.broadcast(total)).select(F.concat(head, "body", F.lit("</results>")).alias("xml"))


def write_text(df: DataFrame, column: str, path: str, mode: str = "overwrite") -> None:
    """One line for each row; ``append`` adds files."""
    df.select(F.col(column).cast("string").alias("value")).write.mode(mode).text(path)


def save_content(df: DataFrame, path: str, xml: str = "xml", html: str = "html") -> None:
    """Saves contents as ``content.xml`` and ``content.html`` under ``path``:
    a line for each row, line breaks as spaces, null as an empty line."""
    for name, column in (("content.xml", xml), ("content.html", html)):
        text = F.regexp_replace(F.coalesce(F.col(column).cast("string"), F.lit("")), r"[\r\n]+", " ")
        write_text(df.select(text.alias("value")), "value", f"{path}/{name}")


def write_blobs(df: DataFrame, name: str, data: str, path: str) -> None:
    """Keeps byte strings by name: a Parquet table, overwritten, whose folder
    is made where it is missing (a file for each blob would be too many)."""
    df.select(F.col(name).alias("name"), F.col(data).cast("binary").alias("data")).write.mode("overwrite").parquet(path)
