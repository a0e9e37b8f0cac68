"""Highlighting: numbered marks in a text become tags or vanish."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wordloom.operators.filters import let

START, STOP = "<?SK W?>", "<?SK /W?>"


def highlight(text: Column, ordinals: Column, start_tag: str = "<b>", stop_tag: str = "</b>", ordinal_at: int | None = None) -> Column:
    """(``text``, ``complete``): the n-th marked stretch (from 0) gets the tags
    if ``ordinals`` holds n and loses its marks otherwise.  ``ordinal_at``: the
    place in the start tag where the ordinal goes.  ``complete``: whether every
    wanted ordinal exists."""
    parts = F.split(text, "\\Q" + START + "\\E", -1)

    def tag(i: Column) -> Column:
        if ordinal_at is None:
            return F.lit(start_tag)
        return F.concat(F.lit(start_tag[:ordinal_at]), i.cast("string"), F.lit(start_tag[ordinal_at:]))

    def tagged(v: Column) -> Column:
        # Parts and wanted ordinals on one line: a part is wanted if its ordinal stands right before it.
        stretches = F.transform(v["parts"], lambda s, i: F.struct((i - 1).cast("long").alias("at"), F.lit(1).alias("own"), s.alias("part")))
        wanted = F.coalesce(F.array_compact(F.array_distinct(v["ordinals"])), F.array().cast("array<long>"))
        wanted = F.transform(wanted, lambda o: F.struct(o.cast("long").alias("at"), F.lit(0).alias("own"), F.lit(None).cast("string").alias("part")))
        return let(F.sort_array(F.concat(stretches, wanted)), joined)

    def joined(line: Column) -> Column:
        def one(x: Column, j: Column) -> Column:
            before = F.get(line, j - 1)
            hit = (before["own"] == 0) & (before["at"] == x["at"])
            shown = F.when(x["at"] < 0, x["part"]).when(hit, F.concat(tag(x["at"]), F.replace(x["part"], F.lit(STOP), F.lit(stop_tag))))
            return F.when(x["own"] == 1, shown.otherwise(F.replace(x["part"], F.lit(STOP), F.lit(""))))

        return F.array_join(F.transform(line, one), "")  # nulls, which stand for the ordinals, are left out

    def both(v: Column) -> Column:
        complete = ~F.exists(v["ordinals"], lambda o: (o < 0) | (o >= v["n"] - 1))
        return F.struct(tagged(v).alias("text"), complete.alias("complete"))

    return let(F.struct(parts.alias("parts"), F.size(parts).alias("n"), ordinals.alias("ordinals")), both)


def highlight_anchored(text: Column, ordinals: Column, tag: str = "b") -> Column:
    """The preset with a named anchor that carries the ordinal."""
    head = '<a name="skhlt_'
    return highlight(text, ordinals, f'{head}"></a><{tag}>', f"</{tag}>", ordinal_at=len(head))


def mark_words(words: Column) -> Column:
    """A text of words with a mark around each."""
    return F.array_join(F.transform(words, lambda w: F.concat(F.lit(START), w, F.lit(STOP))), " ")
