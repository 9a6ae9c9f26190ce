"""Operator 12: fill-in-middle transformation. DataFrame functions only.

A text is an array of units (code points) made by regexp_extract_all. Two cuts come from a hash of the document's id and
divide the units into prefix, middle and suffix, which slice and array_join put together anew: prefix, suffix, middle
(psm) or suffix, prefix, middle (spm), each after its sentinel. `restored` parses an output by its sentinels. A text that
holds a sentinel stays as it is, so the three sentinels of an output are its only ones: no sentinel can begin in a
piece and end in the sentinel behind it, since `<` is the first character of each and occurs nowhere else in it.

All is one projection over the scan: no shuffle, no Python, a row's units are its only memory.

Cases: a null text is empty; empty texts are plain; a null doc_id is hashed as an empty one; texts shorter than a cut can't
be, as cuts are taken modulo their length plus one; equal cuts leave an empty middle; rows that share a doc_id and
repeated rows are cut by the same hashes; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of texts that are divided, and of these, percent in the order suffix, prefix, middle.
DIVIDED = 90
SUFFIX_FIRST = 20
UNIT = "(?s)."


def draws(key: Column, seed: int = 1) -> list[Column]:
    """Four unsigned 32-bit numbers of a key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def divided(docs: DataFrame, seed: int = 1, percent: int = DIVIDED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """Per document: doc_id, text (null: empty), n, form, prefix_chars, middle_chars, output."""
    text = F.coalesce("text", F.lit(""))
    h = F.array(*draws(F.col("doc_id"), seed))
    rows = docs.select("doc_id", text.alias("text"), F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)).alias("units"), h.alias("h"))
    n = F.size("units")
    rows = rows.select("doc_id", "text", "units", "h", n.cast("long").alias("n"), *[(F.col("h")[k] % (n + 1)).cast("int").alias(f"c{k}") for k in (0, 1)])
    taken = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        taken = taken | F.contains("text", F.lit(mark))
    plain = (F.col("n") == 0) | taken | (F.col("h")[2] % 100 >= percent)
    form = F.when(plain, "plain").when(F.col("h")[3] % 100 < suffix_first, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", "units", "n", F.least("c0", "c1").alias("a"), F.greatest("c0", "c1").alias("b"), form.alias("form"))

    def part(start: Column, length: Column) -> Column:
        return F.array_join(F.slice("units", start + 1, length), "")

    a, b = F.col("a"), F.col("b")
    head, middle, tail = part(F.lit(0), a), part(a, b - a), part(b, F.col("n").cast("int") - b)
    output = (
        F.when(F.col("form") == "plain", F.col("text"))
        .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), head, F.lit(SUFFIX), tail, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(SUFFIX), tail, F.lit(PREFIX), head, F.lit(MIDDLE), middle))
    )
    cut = F.col("form") != "plain"
    return rows.select("doc_id", "text", "n", "form", F.when(cut, a.cast("long")).alias("prefix_chars"), F.when(cut, (b - a).cast("long")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text from an output and its form."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    first, second, middle = (F.get(parts, F.lit(k)) for k in (1, 2, 3))
    return F.when(form == "psm", F.concat(first, middle, second)).when(form == "spm", F.concat(second, middle, first)).otherwise(output)
