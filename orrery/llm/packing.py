"""Operator 10: best-fit packing by hierarchical residual packing.

Every document is tokenised on the executors and cut only where it is longer than a sequence. Each task then packs
its pieces best-fit decreasing and emits the bins that are nearly full; the roomiest of the rest travel up a tree,
where eight tasks at a time meet and whole bins are the items of another best-fit round. What a node hands on is
bounded (CARRY bins, so a node gets as many units as a first task has pieces) and no task ever holds an unbounded part
of the corpus; every other bin is emitted as it is. That many roomy bins are left only where hardly any text is short.
What these limits may cost is bounded: of two bins that are at most half full best fit makes one, and the roomiest bin of
a node goes on, so all sequences but one are more than half full whatever the limits, and there are at most twice as many as the tokens need.

Cases: a null text counts as empty (one end token); a null doc_id is kept as null; repeated rows are packed once
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import materialize, tasks_for

SEQUENCE = 4096
END_ID = 1
NEARLY_FULL = 8
CARRY = 2_500
FAN_IN = 8
PIECES_PER_TASK = 20_000
CHUNK = 200_000
CACHE = 400_000

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
BIN = f"done boolean, sequence_id long, items array<struct<{PIECE.replace(' long', ':long').replace(' int', ':int')}>>"
ITEM = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
BLANKS = re.compile("[ \t\n\r]+")
NO_BLANKS = "\x1c\x1d\x1e\x1f"  # str.split() splits at these, the tokenizer does not
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Coder:
    """Ids of a text as little-endian bytes. The tokenizer splits at white space, so each word is coded once and kept.

    A word of letters between ASCII marks is put together from its marks and its lower-cased letters. Letters that are
    not known yet are coded in one call, in which every run of letters ends with a token for a word's end. Whatever
    might be split or lower-cased in another way (digits, apostrophes, special tokens, other marks) is coded alone.
    With a tokenizer that doesn't code a probe by words in this way, every text is coded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.cache: dict[str, bytes] = {"": b""}
        self.letters: dict[str, bytes] = {"": b""}
        self.marks: dict[str, bytes] = {"": b""}
        probe = "Ab c\tSome WORDS, (more) words; don't \u00c9t\u00e9 x1 2024-05 \u65e5\u672c <|end|> some\n\n Words"
        self.by_word = True
        self.by_word = self.encode(probe) == self.alone(probe) and self.encode(" " + probe.lower()) == self.alone(" " + probe.lower())

    @staticmethod
    def kept(path: str) -> Coder:
        """The coder of this Python worker: what it has learned stays for later tasks."""
        held = sys.modules.setdefault("orrery_coders", types.ModuleType("orrery_coders")).__dict__
        return held.get(path) or held.setdefault(path, Coder(path))

    def alone(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        plain, cores, letters = [], {}, self.letters
        for word in words:
            core = word.strip(MARKS)
            low = core.lower()
            if low.isalpha() and len(low) == len(core) and "\u03a3" not in core and "'" not in word and "<|" not in word:
                plain.append((word, core, low))
                if low not in letters:
                    cores[low] = None
            else:
                self.cache[word] = self.alone(word)
        missing = list(cores)
        for at in range(0, len(missing), 20_000):
            part = missing[at : at + 20_000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(stops) == len(part):
                raw, start = ids.tobytes(), 0
                for low, stop in zip(part, stops, strict=True):
                    self.letters[low] = raw[start:stop]
                    start = stop
            else:
                self.letters |= {low: self.alone(low) for low in part}
        for word, core, low in plain:
            code = self.letters[low]
            if len(core) < len(word):
                before, _, after = word.partition(core)
                for mark in (before, after):
                    if mark not in self.marks:
                        self.marks[mark] = self.alone(mark)
                code = self.marks[before] + code + self.marks[after]
            self.cache[word] = code

    def words(self, texts: list[str]) -> list[list[str]]:
        """The words of each text, all of them in the cache."""
        split = [BLANKS.split(t) if any(c in t for c in NO_BLANKS) else t.split() for t in texts]
        for held in (self.cache, self.letters, self.marks):
            if len(held) > CACHE:
                held.clear()
                held[""] = b""
        distinct = set().union(*split)
        self.learn([w for w in distinct if w not in self.cache])
        return split

    def encode_all(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return [self.alone(t) for t in texts]
        return [b"".join(map(self.cache.__getitem__, words)) for words in self.words(texts)]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


def tokenise(docs: DataFrame, vocabulary: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """One row per piece. vocabulary: a path that every executor can read."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end, size = Coder.kept(path), end_id.to_bytes(4, "little"), 4 * sequence
        for batch in batches:
            rows = []
            texts = [x or "" for x in batch.column(1).to_pylist()]
            ids = batch.column(0).to_pylist()
            for at in range(0, len(texts), 256):
                for doc, code in zip(ids[at : at + 256], coder.encode_all(texts[at : at + 256]), strict=True):
                    code += end
                    for k in range(0, len(code), size):
                        part = code[k : k + size]
                        rows.append((doc, k // size, k // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, ITEM, strict=True)], names=[f.name for f in ITEM])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECE)


def best_fit(sizes: list[int], room: int) -> list[list[int]]:
    """Best-fit decreasing: places of sizes by bin. Open bins are found by their room in a bit set."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(room + 1)]
    open_rooms = 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        fits = open_rooms >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            at = by_room[left].pop()
            if not by_room[left]:
                open_rooms ^= 1 << left
            bins[at].append(i)
        else:
            left, at = room, len(bins)
            bins.append([i])
        if left := left - size:
            by_room[left].append(at)
            open_rooms |= 1 << left
    return bins


def _packed(level: int, sequence: int, last: bool):
    def bins_of(units: list[list[dict]], part: int, count: list[int]) -> pa.RecordBatch:
        sizes = [sum(x["length"] for x in u) for u in units]
        packed = best_fit(sizes, sequence)
        used = [sum(sizes[i] for i in b) for b in packed]
        roomy = sorted((k for k, n in enumerate(used) if sequence - n > NEARLY_FULL), key=lambda k: used[k])
        carried = set() if last else set(roomy[:CARRY])
        done, ids, items = [], [], []
        for k, b in enumerate(packed):
            done.append(k not in carried)
            ids.append((level << 56) + (part << 32) + count[0])
            count[0] += 1
            items.append([x for i in b for x in units[i]])
        return pa.RecordBatch.from_arrays([pa.array(done, pa.bool_()), pa.array(ids, pa.int64()), pa.array(items, pa.list_(ITEM))], names=["done", "sequence_id", "items"])

    def order(unit: list[dict]):
        x = unit[0]
        return (x["doc_id"] is None, x["doc_id"] or 0, x["piece"], x["ids_crc32"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, units = TaskContext.get().partitionId(), [0], []
        for batch in batches:
            units += [[x] for x in batch.to_pylist()] if level == 0 else batch.column(0).to_pylist()
            if len(units) >= CHUNK:
                yield bins_of(sorted(units, key=order), part, count)
                units = []
        if units:
            yield bins_of(sorted(units, key=order), part, count)

    return run


def pack(docs: DataFrame, vocabulary: str | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """One row per piece with its sequence and its place there."""
    spark = docs.sparkSession
    tasks = tasks_for(docs.count(), PIECES_PER_TASK)
    pieces = tokenise(docs, vocabulary, sequence)
    level, rows = 0, pieces.repartition(tasks, F.xxhash64("doc_id", "piece", "ids_crc32"))
    done = []
    while True:
        last = tasks == 1
        out = materialize(rows.mapInArrow(_packed(level, sequence, last), BIN), f"bins{level}")
        done.append(out.filter("done"))
        if last:
            break
        tasks = tasks_for(tasks, FAN_IN)
        level += 1
        rows = out.filter("NOT done").repartition(tasks, "sequence_id").select("items")
    bins = done[0]
    for more in done[1:]:
        bins = bins.unionByName(more)
    placed = F.transform(
        F.sequence(F.lit(1), F.size("items")),
        lambda i: F.struct(F.element_at("items", i).alias("item"), F.aggregate(F.slice("items", 1, i - 1), F.lit(0).cast("long"), lambda n, x: n + x["length"]).alias("offset")),
    )
    return bins.select("sequence_id", F.explode(placed).alias("p")).select("p.item.*", "sequence_id", "p.offset")
