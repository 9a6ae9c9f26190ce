"""Operator 5: quality rules with cross-document line frequency.

A first pass over the texts measures each document and hashes its normalised lines (words joined by one space,
A-Z lower-cased). Per host (`source`) each line's distinct documents are counted; documents with the same lines count
once, so a group of exact copies does not turn its own text into boilerplate. Lines in more than MIN_DOCS documents and
more than MAX_SHARE of the host's documents are removed, and a document of which less than MIN_LEFT of the words are
left is rejected.

Counting is a partial aggregation by (host, line, document) and then by (host, line), so neither a hot host nor a
hot line gathers in one task; the way back is an equi-join that Spark may split.

Cases: a null text has no words and fails the base rules; null sources are one host; rows with a null doc_id are
judged like others; repeated rows count once and each gets the result; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import WORD, Words, materialize, mix64, window_hash

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MIN_DOCS = 20
MAX_SHARE = 0.01
MIN_LEFT = 0.3

SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
MEASURES = "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content long, lines array<struct<line:long,words:long>>"


def measure(text: bytes) -> tuple:
    """Base measures, a hash of the content, and the distinct lines with the words that they have here."""
    words = Words(text)
    n = len(words)
    if not n:
        return 0, 0, 0, 0, 0, 0, []
    raw = np.frombuffer(text, np.uint8)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    word_chars = int((((raw & 0xC0) != 0x80) & ~blank).sum())
    repeated = 0
    five = window_hash(words.hash, 5)
    if len(five) > 1:
        _, which, times = np.unique(five, return_inverse=True, return_counts=True)
        again = np.concatenate(([0], np.cumsum(times[which] > 1)))
        at = np.arange(n)
        repeated = int((again[np.minimum(at, len(five) - 1) + 1] > again[np.maximum(at - 4, 0)]).sum())
    seen, dup, lines = set(), 0, {}
    place = 0
    for line in text.split(b"\n"):
        here = len(WORD.findall(line))
        if not here:
            continue
        if line in seen:
            dup += 1
        seen.add(line)
        key = b" ".join(WORD.findall(line)).lower()
        lines[key] = lines.get(key, 0) + here
        place += here
    hashed = line_hashes(list(lines))
    content = int(mix64(np.array([(hash_bytes(b"\n".join(WORD.findall(text))))], np.uint64)).view(np.int64)[0])
    return n, word_chars, int(SYMBOLS[raw].sum()), dup, repeated, content, list(zip(hashed, lines.values(), strict=True))


def hash_bytes(data: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(data)


def line_hashes(lines: list[bytes]) -> list[int]:
    return np.array([hash_bytes(x) for x in lines], np.uint64).view(np.int64).tolist()


def measures(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [measure((t or "").encode("utf-8", "replace")) for t in batch.column(2).to_pylist()]
            cols = list(zip(*got, strict=True)) or [[]] * 7
            lines = [[{"line": h, "words": w} for h, w in x] for x in cols[6]]
            kinds = pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(c, pa.int64()) for c in cols[:6]], pa.array(lines, kinds)],
                names=["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content", "lines"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"), "text").mapInArrow(run, MEASURES)


def frequent_lines(measured: DataFrame) -> DataFrame:
    """(host, line) of the lines above both limits."""
    lines = measured.select("host", "content", F.explode("lines.line").alias("line")).distinct().groupBy("host", "line").agg(F.count("*").alias("n_docs"))
    totals = measured.filter("n_words > 0").select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("n_host"))
    often = lines.filter(F.col("n_docs") > MIN_DOCS)
    return often.join(totals, "host").filter(F.col("n_docs") > MAX_SHARE * F.col("n_host")).select("host", "line", "n_docs", "n_host")


def judge(docs: DataFrame) -> DataFrame:
    """Per document the base measures, base_failed, kept and n_left (words left when frequent lines are gone)."""
    measured = materialize(measures(docs), "measures")
    own = measured.select("host", "content", F.explode("lines").alias("x")).select("host", "content", "x.line", "x.words").distinct()
    lost = own.join(frequent_lines(measured), ["host", "line"]).groupBy("host", "content").agg(F.sum("words").alias("lost"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("lost", F.lit(0))
    return measured.join(lost, ["host", "content"], "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (left >= MIN_LEFT * F.col("n_words"))).alias("kept"), left.alias("n_left"),
    )
