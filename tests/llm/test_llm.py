"""Training-data operators against brute force on small fixtures, and their odd cases."""

import hashlib
import random
import re
import struct
import time
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.llm import common, decontaminate, language, lines, near, packing, quality, repeats, sharding, substrings, urls
from orrery.operators import graph

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("line", T.LongType()), T.StructField("key", T.StringType()), T.StructField("label", T.StringType()), T.StructField("rejected", T.BooleanType())])


def sentence(r, n, vocabulary=60):
    return " ".join(f"w{r.randrange(vocabulary)}" + ("." if r.random() < 0.1 else "") for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, shared passages, repeats, odd and empty texts, nulls, and a very long document."""
    r = random.Random(11)
    texts = [sentence(r, r.randrange(1, 200), 400) for _ in range(60)]
    passage, base = sentence(r, 90, 400), sentence(r, 150, 400)
    texts += [sentence(r, 30, 400) + " " + passage + "\n" + sentence(r, 20, 400) for _ in range(6)]
    texts += [base] * 5
    for k in range(8):
        w = base.split()
        w[7 * k + 3] = f"edit{k}"
        texts.append(" ".join(w))
    texts += ["", "   \n\t ", "a", "same " * 400, "ÀÉ ß 日本語 " * 60, "x" * 3000, sentence(r, 9000, 3000), "a\x00b c" * 40]
    texts += [None, None]
    rows = [(k, t, r.choice(["en", "fr", None]), r.choice(["s0", "s0", "s1", None]), len(t or ""), k, "k", "l", None) for k, t in enumerate(texts)]
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def ordered(corpus):
    return sorted((r[0], (r[1] or "").encode()) for r in corpus)


# --- 2 ---


def removed_words(corpus, window):
    first, out = {}, {}
    for doc, text in ordered(corpus):
        w = WORD.findall(text)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first.setdefault(b" ".join(w[k : k + window]), doc) < doc:
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[doc] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("window", [50, 12])
def test_substrings(docs, corpus, window):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove(docs, window).collect()}
    assert got == removed_words(corpus, window)
    assert sum(x[1] for x in got.values()) > 0


def test_windows_of_equal_hash_are_told_apart():
    """All hashes equal: only the words decide."""
    text = b"a b a c a b"
    a, b = np.array([0, 4, 8]), np.array([3, 7, 11])
    first = np.full(3, 5)
    substrings.confirm(text, np.arange(3), np.array([0]), np.array([3]), a, b, np.array([7, 5, 9]), first)
    assert first.tolist() == [7, 5, 7]


# --- 8 ---


def removed_bytes(corpus, length):
    seen, out = set(), {}
    for doc, text in ordered(corpus):
        marks = np.zeros(len(text) + 1, int)
        for k in range(len(text) - length + 1):
            s = text[k : k + length]
            if s in seen:
                marks[k] += 1
                marks[k + length] -= 1
            seen.add(s)
        gone = np.cumsum(marks[:-1]) > 0
        spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(text) else 0
        kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
        out[doc] = (len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("length, gram", [(100, 28), (40, 12)])
def test_repeats(docs, corpus, length, gram):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove(docs, length, gram).collect()}
    assert got == removed_bytes(corpus, length)


def test_settled_phases_leave_no_shuffle_files(spark, tmp_path):
    """Those of the last job too, which otherwise lie beside the files of the phase that follows."""
    dirs = [Path(x.getPath()) for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]

    def shuffles():
        return {f.name.split("_")[1] for x in dirs for f in x.rglob("shuffle_*")}

    before = shuffles()
    pairs = spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).agg(F.collect_list("id").alias("ids"))
    pairs.join(spark.range(100).withColumnRenamed("id", "k").hint("shuffle_merge"), "k").write.parquet(str(tmp_path / "pairs"))
    made = shuffles() - before
    assert made
    common.settle(spark)
    end = time.time() + 10
    while time.time() < end and made & shuffles():
        time.sleep(0.2)
    assert not made & shuffles()


def test_suffix_order_and_matching_statistics():
    r = random.Random(2)
    for _ in range(100):
        t = bytes(r.choice(b"\0ab") for _ in range(r.randrange(1, 90)))
        index = repeats.RunIndex(np.frombuffer(t, np.uint8))
        order = repeats.suffix_order(np.frombuffer(t, np.uint8)).tolist()
        assert order == sorted(range(len(t)), key=lambda i: t[i:])
        m, above = index.matching(), index.neighbour(np.arange(len(t)))
        assert above[order[0]] == -1
        for j in range(1, len(t)):
            a, b = t[order[j] :], t[order[j - 1] :]
            assert above[order[j]] == order[j - 1]
            assert m[order[j]] == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert np.repeat(index.symbols, index.lengths).tolist() == [t[k - 1] if k else -1 for k in order]


def test_a_repetitive_text_has_few_runs():
    r = random.Random(9)
    base = bytes(r.choice(b"acgt") for _ in range(500))
    t = b"".join(base[:k] + b"x" + base[k + 1 :] for k in range(0, 500, 25))
    index = repeats.RunIndex(np.frombuffer(t, np.uint8))
    assert len(t) == 10_000 and len(index.symbols) == len(index.sampled) < 1_500


@pytest.mark.parametrize("letters", [b"ab\0", b"abc", b"\0"])
def test_first_places_by_brute_force(letters):
    """Few letters, NUL among them, so that strings lie at the ends of cuts and next to each other in any order."""
    r = random.Random(7)
    for _ in range(300):
        strings = list({bytes(r.choice(letters) for _ in range(r.randrange(4, 14))) for _ in range(r.randrange(1, 6))})
        docs, starts = np.array([r.randrange(4) for _ in strings]), np.array([r.randrange(50) for _ in strings])
        first = {}
        for text, doc, start in zip(strings, docs.tolist(), starts.tolist()):
            for k in range(len(text) - 3):
                first[text[k : k + 4]] = min(first.get(text[k : k + 4], (doc, start + k)), (doc, start + k))
        got = list(zip(*(x.tolist() for x in repeats.first_places(strings, docs, starts, 4)), strict=True))
        assert [x[:2] for x in got] == [(own, k) for own, text in enumerate(strings) for k in range(len(text) - 3)]
        assert all((doc, at) == first[strings[own][k : k + 4]] for own, k, doc, at in got)


@pytest.mark.parametrize("letters", ["ab\0", "a\0é"])
def test_repeats_of_texts_with_nul(spark, letters):
    r = random.Random(15)
    rows = [(k, "".join(r.choice(letters) for _ in range(r.randrange(60)))) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in repeats.remove(df, 10, 4).collect()}
    assert got == removed_bytes(rows, 10)


def test_matches_run_over_the_byte_between_cuts():
    r = random.Random(4)
    make = lambda n: bytes(r.choice(b"abcdefgh") for _ in range(n))
    suffix, prefix = make(150), make(150)
    strings = [make(20) + suffix, prefix + make(20), make(20) + suffix, prefix + make(20)]
    docs, starts = np.array([1, 1, 2, 2]), np.array([0, 300, 0, 300])
    first = {}
    for text, doc, start in zip(strings, docs.tolist(), starts.tolist()):
        for k in range(len(text) - 99):
            s = text[k : k + 100]
            first[s] = min(first.get(s, (doc, start + k)), (doc, start + k))
    got = list(zip(*(x.tolist() for x in repeats.first_places(strings, docs, starts, 100)), strict=True))
    assert len(got) == sum(len(t) - 99 for t in strings)
    assert all((doc, at) == first[strings[own][k : k + 100]] for own, k, doc, at in got)


# --- 9 ---


def components_of(corpus, percent):
    sets = {}
    for doc, text in ordered(corpus):
        w = WORD.findall(text.lower())
        sets[doc] = frozenset(b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for d, s in sets.items():
        common = defaultdict(int)
        for x in s:
            for o in where[x]:
                common[o] += 1
            where[x].append(d)
        for o, k in common.items():
            if 100 * k >= percent * (len(s) + len(sets[o]) - k) and find(o) != find(d):
                parent[max(find(o), find(d))] = min(find(o), find(d))
    return {d: (len(sets[d]), find(d), find(d) == d) for d in sets}


def test_near_duplicates(docs, corpus):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near.near_duplicates(docs).collect()}
    assert got == components_of(corpus, 85)
    kept = near.keep_first(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, x in got.items() if x[2]}


def test_near_dedup_stage_links_from_four_fifths(spark):
    import corpus_pipeline

    assert near.band_count(85) == near.BANDS and (1 - 0.8**near.ROWS) ** near.band_count(80) < 1e-6
    r = random.Random(8)
    a, b = (sentence(r, 200, 100_000).split() for _ in range(2))
    rows = [(1, " ".join(a)), (2, " ".join(x if k not in (50, 100, 150, 180) else "edit" for k, x in enumerate(a)))]  # 176 of 216 shingles
    rows += [(3, " ".join(b)), (4, " ".join(x if k % 30 else "edit" for k, x in enumerate(b)))]  # under 0.8
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(x.doc_id for x in corpus_pipeline.near_dedup(spark, df, "").collect()) == [1, 3, 4]
    assert near.keep_first(df).count() == 4


def test_register_estimates():
    r = np.random.default_rng(1)
    times = near.multipliers(near.REGISTERS)
    for share in (0.2, 0.6, 0.9):
        n = 3000
        a = r.integers(0, 1 << 63, n, dtype=np.uint64)
        b = np.concatenate((a[: int(n * share)], r.integers(0, 1 << 63, n - int(n * share), dtype=np.uint64)))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(near.estimate(near.registers(a, times), near.registers(b, times), n, n) - true) < 0.16


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(70), r.randrange(70)) for _ in range(60)] + [(k, k + 1) for k in range(100, 130)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {x.node: x.component for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(parent)}


def test_languages_that_share_letters_are_rejected(spark):
    """Words of three languages in one alphabet, with shared endings; a twentieth is one word repeated. Trained without one, its texts go; learned ones stay."""
    r = random.Random(51)
    stems = {"xa": ["ver", "ung", "sch", "keit", "ein", "der", "und"], "xb": ["tion", "ment", "eau", "que", "les", "des", "oir"], "xc": ["ing", "the", "ness", "ough", "and", "wha", "ly"]}
    common = ["er", "en", "an", "on"]

    def text(lang, n):
        return " ".join("".join(r.choice(stems[lang] + common) for _ in range(r.randrange(1, 4))) for _ in range(n))

    rows = [(k, (text(lang, 1) + " ") * 40 if r.random() < 0.05 else text(lang, r.randrange(15, 80)), lang) for k, lang in enumerate(r.choice(sorted(stems)) for _ in range(1500))]
    rows += rows[:1] * 3000  # one row again and again does not crowd others out of the sample
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    junk = {k for k, t, _ in rows if len(set(t.split())) == 1}
    for out in sorted(stems):
        model = language.fit(df.filter(F.col("lang") != out))
        got = {x.doc_id: x for x in language.identify(df.dropDuplicates(["doc_id"]).filter(F.size(F.split("text", " ")) > 14), model, ["doc_id", "lang"]).collect()}
        kept = [not x.rejected for k, x in got.items() if x.lang != out and k not in junk]
        gone = [x.rejected for k, x in got.items() if x.lang == out and k not in junk]
        print(out, np.mean(kept), np.mean(gone), model.margin)
        assert np.mean(kept) > 0.995 and np.mean(gone) > 0.9
        assert all(x.lang_pred == x.lang for k, x in got.items() if x.lang != out and k not in junk)


# --- 10 ---


def test_packing(docs, corpus):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    rows = packing.pack(docs, sequence=256).collect()
    want = {}
    for doc, text in ordered(corpus):
        ids = [*tokenizer.encode(text.decode(), add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 256):
            part = ids[k : k + 256]
            import zlib

            want[doc, k // 256] = (k, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(by) <= 1.02 * -(-sum(r.length for r in rows) // 256) + 1


@pytest.mark.parametrize("long", [True, False])
def test_packing_beyond_its_limits(spark, monkeypatch, long):
    """Tasks of few pieces, chunks and hand-over of a few bins, over many levels, with texts that leave roomy bins and with any: nothing is lost, and all sequences but one are more than half full."""
    for name, n in (("CARRY", 3), ("CHUNK", 40), ("PIECES_PER_TASK", 50), ("FAN_IN", 2)):
        monkeypatch.setattr(packing, name, n)
    r = random.Random(19)
    texts = [sentence(r, r.randrange(38, 70) if long else r.randrange(1, 120), 400) for _ in range(700)]
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), sequence=256).collect()
    assert {r.doc_id for r in rows} == set(range(700)) and len({(r.doc_id, r.piece) for r in rows}) == len(rows)
    by = defaultdict(list)
    for x in rows:
        by[x.sequence_id].append((x.offset, x.length))
    assert all(sum(n for _, n in p) <= 256 and [o for o, _ in sorted(p)] == [0, *np.cumsum([n for _, n in sorted(p)])[:-1]] for p in by.values())
    full = sorted(sum(n for _, n in p) for p in by.values())
    need = -(-sum(full) // 256)
    print(len(full), need)
    assert full[1] > 128 and len(full) <= 2 * need


def test_words_are_coded_as_whole_texts_are():
    from tokenizers import Tokenizer

    coder, tokenizer = packing.Coder(packing.default_vocabulary()), Tokenizer.from_file(packing.default_vocabulary())
    r = random.Random(1)
    letters = "ab'sté́ΣσςΑİßǅ \t\n\r\x0b\x0c\x1c\x85 １2²Ⅷ가<|endoftext|>.,$_#"
    for text in ["<|endoftext|> a<|startoftext|>b", "don't WE'RE #a# ..a..", *("".join(r.choice(letters) for _ in range(50)) for _ in range(800))]:
        code = coder.encode(text)
        assert list(struct.unpack(f"<{len(code) // 4}I", code)) == tokenizer.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_code_whole_texts(tmp_path):
    import json

    from tokenizers import Tokenizer

    with open(packing.default_vocabulary()) as f:
        kept = json.load(f)
    kept["normalizer"] = None  # case is kept now
    path = str(tmp_path / "cased.json")
    with open(path, "w") as f:
        json.dump(kept, f)
    coder, tokenizer = packing.Coder(path), Tokenizer.from_file(path)
    text = "Some Words AND others"
    assert not coder.by_word and packing.Coder(packing.default_vocabulary()).by_word
    assert np.frombuffer(coder.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_best_fit_fills_bins():
    r = random.Random(4)
    sizes = [r.randrange(1, 100) for _ in range(2000)]
    bins = packing.best_fit(sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(2000))
    assert all(sum(sizes[i] for i in b) <= 100 for b in bins) and len(bins) <= 1.02 * sum(sizes) / 100 + 1


# --- 5 and 7 ---


def test_quality(docs, corpus):
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert len(got) == len(corpus)
    for doc, text in ordered(corpus):
        w = WORD.findall(text)
        five = [b" ".join(w[k : k + 5]) for k in range(len(w) - 4)]
        covered = {k + j for k, x in enumerate(five) if five.count(x) > 1 for j in range(5)} if len(five) < 500 else None
        seen, dup = set(), 0
        for line in text.split(b"\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        r = got[doc]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (len(w), sum(len(x.decode()) for x in w), sum(text.decode().count(x) for x in "#*$%&|<>"), dup)
        if covered is not None:
            assert r.n_repeat_words == len(covered)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def boiled(spark):
    rows = [(k, f"Own line {k} {'abc' * k}\n  Read   more here \nx{k}", "h" if k < 80 else "other", None) for k in range(100)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, line string")


def test_frequent_lines(spark):
    found = quality.frequent_lines(quality.measures(boiled(spark))).collect()
    assert [(r.host, r.n_docs) for r in found] == [("h", 80)]


@pytest.mark.parametrize("few", [200_000, 0])
def test_line_dedup_both_ways(spark, monkeypatch, few):
    monkeypatch.setattr(lines, "BROADCAST_LINES", few)
    df = boiled(spark)
    out = lines.drop_lines(df, F.col("source"), "text", 0.1, 30)
    rows = {r.doc_id: r for r in out.collect()}
    assert out.columns[:-1] == df.columns and len(rows) == 100
    assert all(r.orrery_dropped == (1 if k < 80 else 0) and ("more" in r.text) == (k >= 80) for k, r in rows.items())


def test_line_dedup_stage_keeps_a_text_with_many_copies(spark):
    import corpus_pipeline

    rows = [(k, f"Own line {k}\nRead more", "h") for k in range(60)] + [(100 + k, "Copied text\nof two lines\nRead more", "h") for k in range(40)]
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), "").collect()}
    assert got == {k: f"Own line {k}" for k in range(60)} | {100 + k: "Copied text\nof two lines" for k in range(40)}


# --- 3 ---


def test_language_stage_learns_from_all_labelled_rows(spark):
    """All labelled rows of one language are of the quarter that the operator holds out."""
    import corpus_pipeline

    r = random.Random(17)
    words = {"en": "the and of thing with that there".split(), "de": "und der die straße über nicht".split()}
    out, learned = ([k for k in range(4000) if (zlib.crc32(str(k).encode()) % 4 == 2) == x] for x in (True, False))
    rows = [(k, " ".join(r.choice(words[lang]) for _ in range(40)), lang) for lang, ids in (("en", learned[:200]), ("de", out[:200])) for k in ids]
    rows += [(5000 + k, " ".join(r.choice(words["de"]) for _ in range(40)), None) for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {x.doc_id for x in corpus_pipeline.language_id(spark, df, "").collect()} == {x[0] for x in rows}
    assert "de" not in {x.lang_pred for x in language.predict(df).collect()}


def test_language(spark):
    r = random.Random(7)
    words = {"en": "the and of thing with that there".split(), "fr": "le la être où une elle déjà".split(), "de": "und der die straße über nicht".split()}
    rows = [(k, " ".join(r.choice(words[lang]) for _ in range(r.randrange(3, 60))), lang) for k, lang in enumerate(r.choice(sorted(words)) for _ in range(400))]
    rows += [(1000, None, "en"), (1001, "", None), (1002, "12 34 !!", "fr"), (None, "und der die", None)]
    got = language.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    by = {r.doc_id: r for r in got}
    held = [k for k, _, lang in rows[:400] if by[k].held_out]
    assert len(held) > 50 and sum(by[k].lang_pred == rows[k][2] for k in held) >= 0.98 * len(held)
    assert [by[k].lang_pred for k in (1000, 1001, 1002)] == ["und"] * 3 and by[None].lang_pred == "de"
    assert all(0 <= x.score <= 1 for x in got)


def test_texts_of_an_unlearned_language_are_rejected(spark):
    """Languages as random syllables: hardly any text of a learned one is rejected, and nearly all of another one."""
    r = random.Random(31)
    letters = {"aa": "abcdefg", "bb": "hijklmn", "cc": "opqrstu", "zz": "cjqvwxy"}
    words = {k: ["".join(r.choice(v) for _ in range(r.randrange(2, 7))) for _ in range(80)] for k, v in letters.items()}
    text = lambda lang: " ".join(r.choice(words[lang]) for _ in range(r.randrange(20, 120)))
    rows = [(k, text(lang), lang) for k, lang in enumerate(r.choice(["aa", "bb", "cc"]) for _ in range(600))]
    rows += [(1000 + k, text("zz"), None) for k in range(100)]
    got = {x.doc_id: x.rejected for x in language.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert sum(got[k] for k in range(600)) <= 6 and sum(got[1000 + k] for k in range(100)) >= 95


def test_prediction_uses_nothing_but_the_text(docs):
    other = docs.withColumns({"source": F.lit("x"), "n_chars": F.lit(0)})
    key = lambda df: sorted((r.doc_id, r.lang_pred, r.score) for r in language.predict(df).collect())
    assert key(docs) == key(other)
    assert language.keep_identified(docs).columns == docs.columns


# --- 1 ---


def test_urls(spark):
    rows = [(0, "HTTPS://Blog.Example.COM/en/71?x"), (1, "http://a.net/de/8"), (2, "http://example.net/de/81#t"), (3, "http://x.org/es/"), (4, None), (5, "no scheme/en/"), (6, "http://acom/en/1"), (7, "http://com/en/")]
    rows += [(100 + k, f"http://shop.fr/ads/{k}") for k in range(60)] + [(200 + k, f"http://shop.fr/news/{k}") for k in range(60)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, host string")
    labels = spark.createDataFrame([(100 + k, True) for k in range(60)] + [(200 + k, k % 10 == 0) for k in range(60)], "page_id long, bad boolean")
    got = {r.page_id: r for r in urls.filter_urls(pages, labels).collect()}
    assert (got[0].host, got[0].path, got[0].rule, got[0].verdict) == ("blog.example.com", "/en/71", "example.com/en/7", "allow")
    assert [(got[k].rule, got[k].verdict) for k in (1, 2, 3, 7)] == [("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"), ("com/en/", "block")]
    assert [(got[k].host, got[k].path, got[k].rule) for k in (4, 5, 6)] == [("", "", None), ("", "", None), ("acom", "/en/1", None)]
    assert {got[k].verdict for k in range(100, 160)} == {"block"} and {got[k].verdict for k in range(200, 260)} == {"allow"}
    assert got[100].template == "/ads/#"


def test_slugs_that_begin_with_a_number_are_merged(spark):
    slug = lambda k: f"{k}-{chr(97 + k % 26)}{chr(97 + k // 26)}-title"
    rows = [(100 + k, f"http://shop.fr/ads/{slug(k)}") for k in range(60)] + [(200 + k, f"http://shop.fr/news/{slug(k)}") for k in range(60)] + [(300 + k, f"http://shop.fr/old/{k}.html") for k in range(30)]
    labels = spark.createDataFrame([(100 + k, True) for k in range(60)] + [(200 + k, k % 10 == 0) for k in range(60)], "page_id long, bad boolean")
    got = {r.page_id: r for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), labels).collect()}
    assert {got[k].verdict for k in range(100, 160)} == {"block"} and {got[k].verdict for k in range(200, 260)} == {"allow"}
    assert (got[100].template, got[200].template, got[300].template.split("/")[-1]) == ("/ads/*", "/news/*", "#.html")


def template_tree(pages, labels):
    """Templates of shapes, node by node."""
    shapes = defaultdict(lambda: [0, 0, 0])
    for page, shape in pages:
        held = shapes[shape]
        held[0] += 1
        if page in labels:
            held[1] += 1
            held[2] += labels[page]

    def grow(held, prefix, depth, found):
        ended = [x for x in held if len(x[0]) == depth]
        for x in ended:
            found[x[0]] = prefix
        held = [x for x in held if len(x[0]) > depth]
        total, by = sum(x[1][0] for x in held), defaultdict(list)
        for x in held:
            by[x[0][depth]].append(x)
        parts, branches = {}, defaultdict(lambda: [0, 0, []])
        for seg, xs in by.items():
            c, cl, cb = (sum(x[1][i] for x in xs) for i in range(3))
            if re.fullmatch("[#@]([.][a-z]+)?", seg) or c == total >= urls.MIN_SUPPORT:
                parts[seg] = seg
            else:
                b = branches[seg if c >= max(urls.MIN_SUPPORT, urls.MIN_SHARE * total) and cl else "*"]
                b[0], b[1] = b[0] + cl, b[1] + cb
                b[2].append(seg)
        groups = []
        known = [(b[1] / b[0], n, b) for n, b in branches.items() if b[0]]
        for _, name, (cl, cb, segs) in sorted(known):
            if groups:
                g = groups[-1]
                p = (g[1] + cb) / (g[0] + cl)
                spread = (p * (1 - p) * (1 / g[0] + 1 / cl)) ** 0.5
                if spread == 0 or abs(g[1] / g[0] - cb / cl) < urls.Z * spread:
                    groups[-1] = (g[0] + cl, g[1] + cb, g[2] + [name], g[3] + segs)
                    continue
            groups.append((cl, cb, [name], segs))
        groups += [(0, 0, [name], segs) for name, (cl, _, segs) in branches.items() if not cl]
        for _, _, names, segs in groups:
            part = "*" if "*" in names else names[0] if len(names) == 1 else "{" + "|".join(sorted(names)) + "}"
            parts |= dict.fromkeys(segs, part)
        below = defaultdict(list)
        for seg, xs in by.items():
            below[parts[seg]] += xs
        for part, xs in below.items():
            grow(xs, f"{prefix}/{part}", depth + 1, found)

    found = {}
    grow([(tuple(s for s in k.split("/") if s), v) for k, v in shapes.items()], "", 0, found)
    return found


def test_templates_against_a_tree_built_node_by_node(spark):
    r = random.Random(17)
    rows, labels = [], {}
    for page in range(3000):
        top = r.choice(["ads", "promo", "news", "blog", "wiki", f"u{chr(97 + page % 26)}{chr(97 + page // 26 % 26)}"])
        path = "/" + "/".join([top, *[r.choice(["a", "b", f"slug-{chr(97 + r.randrange(26))}", str(page), "x.html"]) for _ in range(r.randrange(8))], *["deep"] * (page % 40 == 0) * r.randrange(30)])
        rows.append((page, f"http://h.fr{path}"))
        if r.random() < 0.5 and not top.startswith("u"):
            labels[page] = r.random() < {"ads": 0.9, "promo": 0.88, "news": 0.1, "wiki": 0.5}.get(top, 0.12)
    made = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(list(labels.items()), "page_id long, bad boolean")).collect()
    shape = {x.page_id: re.sub("[0-9]+", "#", x.path) for x in made}
    want = template_tree(sorted(shape.items()), labels)
    assert all(x.template == want[tuple(s for s in shape[x.page_id].split("/") if s)] for x in made)
    assert any("{ads|promo}" in x.template for x in made) and any(x.template.startswith("/*") for x in made)
    verdict = defaultdict(list)
    for x in made:
        verdict[x.path.split("/")[1]].append(x.verdict)
    assert np.mean([v == "block" for k in ("ads", "promo") for v in verdict[k]]) > 0.6 and "block" not in verdict["news"] + verdict["blog"]


def test_branches_without_labels_part_no_others(spark):
    """Clean branches 1a, aa and bb, and variable segments without a label that sort between them."""
    rows = [(k, f"http://h.fr/{('1a', 'aa', 'bb')[k % 3]}/x") for k in range(150)] + [(1000 + k, f"http://h.fr/v{chr(97 + k % 26)}{chr(97 + k // 26)}/x") for k in range(60)]
    made = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame([(k, False) for k in range(150)], "page_id long, bad boolean")).collect()
    assert {x.template for x in made if x.page_id < 1000} == {"/{#a|aa|bb}/x"}
    assert {x.template for x in made if x.page_id >= 1000} == {"/*/x"}


def test_long_numbers_name_no_document(spark):
    pages = spark.createDataFrame([(1, "http://h/123456789012345678901/7"), (2, "http://h/a/0012"), (3, "http://h/x12/12"), (4, "http://h/9223372036854775807")], "page_id long, url string")
    labels = spark.createDataFrame([(123456789012345678, 0, 1), (7, 0, 1), (12, 0, 0), (9223372036854775807, 1, 0)], "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, urls.document_labels(pages, labels).collect())) == [(2, True), (3, True), (4, False)]


# --- 6 ---


def test_sharding(spark):
    r = random.Random(1)
    rows = [(k, "x" * r.randrange(0, 400)) for k in range(500)] + [(7, "y" * 300)] * 40 + [(9001, "z" * 5000), (None, "n"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shards(df, 4000).collect()
    assert len(got) == len(rows)
    sums, counts = defaultdict(int), defaultdict(int)
    for x in got:
        sums[x.shard] += x.n_bytes
        counts[x.shard] += 1
    assert all(x.shard_bytes == sums[x.shard] and x.oversized == (sums[x.shard] > 4000) for x in got)
    assert all(counts[s] == 1 for s, n in sums.items() if n > 4000)
    depths = {(x.depth, x.bits) for x in got}
    assert not any(p != q and p[0] <= q[0] and q[1] >> (q[0] - p[0]) == p[1] for p in depths for q in depths)


def split_buckets(rows, limit):
    """Bucket by bucket: those over the limit split on their next bit until they fit or hold one key."""
    done, open_buckets = {}, {(0, 0): rows}
    while open_buckets:
        bucket, held = open_buckets.popitem()
        if sum(n for _, n in held) <= limit or len({k for k, _ in held}) == 1:
            done[bucket] = held
            continue
        depth, bits = bucket
        for bit in (0, 1):
            if some := [x for x in held if x[0] >> (63 - depth) & 1 == bit]:
                open_buckets[depth + 1, bits * 2 + bit] = some
    return {k: (b, sum(n for _, n in held)) for b, held in done.items() for k, _ in held}


def test_shards_are_buckets_split_one_by_one(spark):
    r = random.Random(2)
    rows = [(k, "x" * r.randrange(0, 300)) for k in range(700)] + [(5, "y" * 200)] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string")
    keys = {x.doc_id: x.key & (1 << 64) - 1 for x in df.select("doc_id", F.xxhash64("doc_id").alias("key")).collect()}
    want = split_buckets([(keys[d], len(t)) for d, t in rows], 3000)
    got = sharding.shards(df, 3000).collect()
    assert all(((x.depth, x.bits), x.shard_bytes) == want[keys[x.doc_id]] for x in got if x.part == 0)
    assert {x.doc_id for x in got if x.part} == {5} and all((x.depth, x.bits) == want[keys[5]][0] for x in got if x.doc_id == 5)


def test_written_shards_keep_the_limit(spark, tmp_path):
    rows = [(1, "y" * 300)] * 40 + [(None, "n" * 100)] * 60 + [(k, "x" * 50) for k in range(200)]
    df = spark.createDataFrame([(*x, "s", "t") for x in rows], "doc_id long, text string, shard string, key string")
    sharding.write_shards(df, str(tmp_path / "out"), 4000)
    back = spark.read.parquet(str(tmp_path / "out"))
    sizes = back.groupBy("orrery_shard").agg(F.sum(F.octet_length("text")).alias("n")).collect()
    assert max(x.n for x in sizes) <= 4000 and back.count() == len(rows) and set(df.columns) < set(back.columns)
    assert sorted(map(str, back.select("doc_id", "text").collect())) == sorted(map(str, df.select("doc_id", "text").collect()))


# --- 4 ---


def test_decontamination(spark):
    r = random.Random(9)
    items = [sentence(r, n, 5000) for n in (16, 25, 40, 60, 3)]
    edited = items[3].split()
    edited[30] = "other"
    rows = [(k, sentence(r, 120, 5000)) for k in range(40)]
    rows += [(100 + k, sentence(r, 20, 5000) + "\n" + x.upper().lower() + " " + sentence(r, 33, 5000)) for k, x in enumerate(items)]
    rows += [(200, sentence(r, 5, 5000) + " " + " ".join(edited)), (201, items[0]), (202, items[2] + " " + items[1]), (300, None), (301, ""), (None, items[0])]
    rows += [(100, rows[40][1])]
    df = spark.createDataFrame([(*x, "q") for x in rows], "doc_id long, text string, h string")
    bench = spark.createDataFrame([*enumerate(items), (77, None), (78, " "), (0, items[0])], "item_id long, text string")
    got = sorted((x.doc_id, x.item_id) for x in decontaminate.leaks(df, bench).collect())
    assert got == [(100, 0), (101, 1), (102, 2), (103, 3), (104, 4), (200, 3), (201, 0), (202, 1), (202, 2)]
    kept = decontaminate.keep_clean(df, bench)
    assert kept.columns == df.columns and kept.count() == 40 + 3


def test_decontamination_finds_passages_with_far_fingerprints(spark):
    """Passages of 53 of 59 words: 49 of 61 shingles are shared, but some fingerprints differ in more than RADIUS bits."""
    r = random.Random(51)
    items = [sentence(r, 59, 100_000) for _ in range(400)]
    rows = [(k, sentence(r, 9, 100_000) + " " + " ".join(x.split()[:53]) + " " + sentence(r, 20, 100_000)) for k, x in enumerate(items)]
    rows += [(1000 + k, sentence(r, 9, 100_000) + " " + " ".join(x.split()[:52]) + " " + sentence(r, 20, 100_000)) for k, x in enumerate(items[:50])]  # under 0.8
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontaminate.leaks(df, spark.createDataFrame([*enumerate(items)], "item_id long, text string")).collect()
    assert sorted((x.doc_id, x.item_id) for x in got) == [(k, k) for k in range(400)]
    assert 0 < sum(x.distance > decontaminate.RADIUS for x in got) < 40
    assert all(x.word_at <= 9 and abs(x.similarity - 49 / 61) < 1e-9 for x in got)


def test_decontamination_of_items_cut_off_by_the_text(spark):
    r = random.Random(12)
    items = [sentence(r, 50, 5000) for _ in range(2)]
    own = sentence(r, 60, 5000)
    rows = [(0, own + " " + " ".join(items[0].split()[:48])), (1, " ".join(items[1].split()[2:]) + " " + own), (2, " ".join(items[0].split()[:48])), (3, own)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    got = {(x.doc_id, x.item_id): (x.word_at, x.n_words) for x in decontaminate.leaks(df, bench).collect()}
    assert got == {(0, 0): (58, 50), (1, 1): (0, 50)}  # text 2 has under 50 words, so it holds no window of an item's size
    assert sorted(x.doc_id for x in decontaminate.keep_clean(df, bench).collect()) == [2, 3]


def test_near_fingerprints_share_a_block(spark):
    r = random.Random(3)
    rows = []
    for _ in range(200):
        a = r.getrandbits(63)
        b = a
        for bit in r.sample(range(63), decontaminate.RADIUS):
            b ^= 1 << bit
        rows.append((a, b))
    df = spark.createDataFrame(rows, "a long, b long").select(F.arrays_overlap(decontaminate.blocks("a"), decontaminate.around("b")).alias("meet"))
    assert all(x.meet for x in df.collect())


def test_fingerprints_are_majorities(spark):
    r = random.Random(4)
    rows = [([r.getrandbits(63) - r.getrandbits(63) for _ in range(n)],) for n in (1, 2, 7, 300)]
    got = [x.f & (1 << 64) - 1 for x in spark.createDataFrame(rows, "h array<long>").select(decontaminate.fingerprint("h").alias("f")).collect()]
    assert got == [sum(1 << b for b in range(64) if 2 * sum((x & (1 << 64) - 1) >> b & 1 for x in h) > len(h)) for (h,) in rows]


def alike_anywhere(rows, items, similarity):
    """Pairs of which some window is alike, by trying all windows of all sizes."""
    def runs(w, k):
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    split = [t.lower().split() for t in items]
    size = [min(5, len(w)) for w in split]
    sets = [runs(w, k) for w, k in zip(split, size)]
    df = defaultdict(int)
    for s in sets:
        for x in s:
            df[x] += 1
    weight = lambda x: np.log1p(len(items) / df[x]) if x in df else np.log1p(len(items))
    found = set()
    for doc, text in rows:
        w = text.lower().split()
        for item, (own, k, words) in enumerate(zip(sets, size, split)):
            for at in range(len(w) - len(words) + 1):
                here = runs(w[at : at + len(words)], k)
                if here & own and sum(map(weight, here & own)) >= similarity * sum(map(weight, here | own)):
                    found.add((doc, item))
                    break
    return found


def test_decontamination_against_all_windows(spark):
    """Substitutions, insertions and deletions, at a text's ends too: no pair that any window has is lost."""
    r = random.Random(21)
    items = [sentence(r, r.choice([12, 30, 30, 55, 90]), 400) for _ in range(25)]
    rows = []
    for doc in range(220):
        words = r.choice(items).split()
        for _ in range(r.randrange(4)):
            at, kind = r.randrange(len(words)), r.randrange(4)
            words[at : at + (kind != 1) * r.choice([1, 1, 3])] = [f"x{r.randrange(99)}" for _ in range((kind != 2) * r.choice([1, 1, 2, 4]))]
        if r.random() < 0.3:
            words = words[r.randrange(3) : len(words) - r.randrange(3)]
        rows.append((doc, " ".join([sentence(r, r.randrange(40), 400), *words, sentence(r, r.randrange(40), 400)])))
    want = alike_anywhere(rows, items, decontaminate.SIMILARITY)
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.leaks(df, bench).collect()}
    print(len(want), "pairs, recall", len(got & want) / len(want))
    assert len(want) > 50 and got == want


def test_decontamination_weighs_what_items_share(spark):
    """Items hold common passages, so a window's other shingles often belong to other items and weigh little."""
    r = random.Random(33)
    common = [sentence(r, n, 400).split() for n in (6, 8, 12, 20)]
    items = []
    for _ in range(30):
        words = [w for _ in range(r.randrange(1, 4)) for w in (r.choice(common) if r.random() < 0.7 else []) + sentence(r, r.randrange(4, 20), 400).split()]
        items.append(" ".join(words))
    rows = []
    for doc in range(200):
        words = r.choice(items).split()
        for _ in range(r.randrange(3)):
            at = r.randrange(len(words))
            put = r.choice(common)[: r.randrange(1, 9)] if r.random() < 0.6 else [f"x{r.randrange(99)}"]
            words[at : at + len(put)] = put
        rows.append((doc, " ".join([sentence(r, r.randrange(30), 400), *words, sentence(r, r.randrange(30), 400)])))
    want = alike_anywhere(rows, items, decontaminate.SIMILARITY)
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.leaks(df, bench).collect()}
    print(len(want), "pairs, recall", len(got & want) / len(want))
    assert len(want) > 50 and got == want


def test_decontamination_similarity_by_hand(spark):
    """Of ten shingles of a window nine are the item's; the tenth belongs to another item, so it weighs ln(1 + 2 / 1) and not ln(1 + 2)."""
    a, b = [f"a{k}" for k in range(14)], [f"b{k}" for k in range(6)]
    bench = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(a[:5] + b))], "item_id long, text string")
    doc = spark.createDataFrame([(7, " ".join(["x"] + a[:13] + ["y"])), (7, " ".join(["x"] + a[:13] + ["y"]))], "doc_id long, text string")
    got = {x.item_id: x.similarity for x in decontaminate.leaks(doc, bench, 0.5).collect()}
    shared, rare = np.log1p(1), np.log1p(2)
    assert set(got) == {1} and abs(got[1] - (shared + 8 * rare) / (shared + 10 * rare)) < 1e-9


# --- odd tables ---


def test_empty_tables(spark, empty):
    pages, labels = spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "page_id long, bad boolean")
    bench = spark.createDataFrame([], "item_id long, text string")
    frames = (urls.filter_urls(pages, labels), substrings.remove(empty), language.predict(empty), decontaminate.leaks(empty, bench), quality.judge(empty), sharding.shards(empty), lines.drop_lines(empty, F.col("source"), "text"), repeats.remove(empty), near.near_duplicates(empty), packing.pack(empty))
    assert [f.count() for f in frames] == [0] * 10


def test_repeated_and_null_rows(spark, corpus):
    some = [x for x in corpus if x[1] is None or len(x[1]) < 3000]
    twice = some + some[:30] + [(None, "null id " * 30, None, None, None, None, None, None, None)] * 2
    df = spark.createDataFrame(twice, DOCS)
    n = len(twice)
    assert [f.count() for f in (substrings.remove(df), language.predict(df), quality.judge(df), sharding.shards(df), lines.drop_lines(df, F.col("source"), "text"), repeats.remove(df), near.near_duplicates(df), packing.pack(df))] == [n] * 8
    want = removed_words(some, 50)
    assert all((r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id] for r in substrings.remove(df).collect() if r.doc_id is not None)


def test_one_id_with_several_texts(spark):
    """Each text is judged on its own; in op9 the links of all of them count."""
    r = random.Random(23)
    a, b, c = (sentence(r, 120, 5000) for _ in range(3))
    rows = [(1, a), (5, c + " " + a), (5, b), (7, "x " + a), (8, "y " + b), (9, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    n = len(a.split())
    words = sorted((x.doc_id, x.n_words, x.n_removed) for x in substrings.remove(df).collect())
    assert words == sorted([(1, n, 0), (5, 2 * n, n), (5, n, 0), (7, n + 1, n), (8, n + 1, n), (9, n, n)])
    spans = sorted((x.doc_id, x.n_bytes, x.n_bytes - x.n_removed) for x in repeats.remove(df).collect())
    assert [x[:2] for x in spans] == sorted((d, len(t)) for d, t in rows)
    kept = {(x[0], x[1]): x[2] for x in spans}
    assert kept[5, len(b)] == len(b) and kept[5, len(c + a) + 1] <= len(c) + 2 and kept[9, len(b)] == 0 and kept[7, len(a) + 2] == 1  # the blank before a stands in 5 too
    near_a, near_b = (" ".join(x.split()[:-1]) for x in (a, b))
    df = spark.createDataFrame([(5, a), (5, b), (7, near_a), (8, near_b), (9, c)], "doc_id long, text string")
    assert {(x.doc_id, x.component_id) for x in near.near_duplicates(df).collect()} == {(5, 5), (7, 5), (8, 5), (9, 9)}


def test_near_duplicates_lose_no_link_of_a_large_group(spark):
    """10,000 texts, groups of near copies around the threshold among them: the same components as by comparing all pairs."""
    r = random.Random(29)
    texts = [sentence(r, r.randrange(20, 60), 20_000) for _ in range(9_000)]
    for _ in range(5):
        base = sentence(r, 100, 20_000).split()
        for _ in range(200):
            w = list(base)
            for _ in range(r.randrange(4)):
                w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
            texts.append(" ".join(w))
    sets, holders = [], defaultdict(list)
    for k, t in enumerate(texts):
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
        for x in sets[-1]:
            holders[x].append(k)
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    n_links = 0
    for k, s in enumerate(sets):
        common = defaultdict(int)
        for x in s:
            for o in holders[x]:
                if o < k:
                    common[o] += 1
        for o, n in common.items():
            if 100 * n >= 85 * (len(s) + len(sets[o]) - n):
                n_links += 1
                parent[max(find(k), find(o))] = min(find(k), find(o))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {x.doc_id: x.component_id for x in near.near_duplicates(df).collect()}
    assert n_links > 5_000 and got == {k: find(k) for k in range(len(texts))}


def templated(r, n):
    """Pages of 60 words that differ in two words of their own at five places each: far from any link, but in common bands."""
    base = sentence(r, 60, 20_000).split()
    out = []
    for k in range(n):
        w = list(base)
        for j, at in enumerate((6, 17, 28, 39, 50)):
            w[at : at + 2] = [f"p{k}q{j}", f"r{k}s{j}"]
        out.append(" ".join(w))
    return out


def test_pages_of_one_template_meet_nowhere(spark, monkeypatch):
    """Rows that move for 500, 1,000 and 2,000 pages grow no faster than the pages; a few near copies among them are still linked."""
    made = []
    plain = near.outliers

    def counted(here):
        members, visitors, out = plain(here)
        made.append((here.count(), visitors.count()))
        return members, visitors, out

    monkeypatch.setattr(near, "outliers", counted)
    for n in (500, 1000, 2000):
        texts = templated(random.Random(n), n)
        texts += [t + " more" for t in texts[:5]]
        got = {x.doc_id: x.component_id for x in near.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
        assert got == {k: k - n if k >= n else k for k in range(n + 5)}
    print(made)
    assert made[2][1] <= max(50, 2.5 * made[1][1]) and made[2][0] <= max(500, 2.5 * made[1][0])


@pytest.mark.parametrize("percent", [85, 80])
def test_small_blocks_with_many_visitors(spark, monkeypatch, percent):
    """Groups around the threshold whose pages share their rarest shingles, with blocks and salts of a few classes."""
    monkeypatch.setattr(near, "BLOCK", 8)
    monkeypatch.setattr(near, "VISITORS", 10)
    r = random.Random(41)
    texts = []
    for _ in range(4):
        base = sentence(r, 70, 20_000).split()
        for _ in range(80):
            w = list(base)
            for at in r.sample(range(70), r.randrange(1, 4)):
                w[at] = f"v{at}x{r.randrange(3)}"  # one of three other words
            texts.append(" ".join(w))
    rows = list(enumerate(texts))
    r.shuffle(rows)
    blocks = []
    plain = near.outliers

    def counted(here):
        members, visitors, out = plain(here)
        blocks.append((members.count(), members.select("block").distinct().count(), visitors.groupBy("block").count().agg(F.max("count")).first()[0]))
        return members, visitors, out

    monkeypatch.setattr(near, "outliers", counted)
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect()}
    assert got == components_of(rows, percent)
    assert blocks[0][0] > near.BLOCK and blocks[0][2] > near.VISITORS, blocks


def test_pipeline_keeps_columns(spark, tmp_path, docs):
    import corpus_pipeline

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, "nothing like it here at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
    assert corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().count() == now.count() > 0


def test_pipeline_on_odd_tables(spark, tmp_path, empty):
    """An empty table; nulls, repeated rows, ties and columns with names that the operators use."""
    import corpus_pipeline

    bench = spark.createDataFrame([(0, "nothing like it here at all")], "item_id long, text string")
    empty.write.parquet(str(tmp_path / "none" / "documents.parquet"))
    bench.write.parquet(str(tmp_path / "none" / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    r = random.Random(37)
    plain = [(k, sentence(r, 60, 3000), "en", None, None, None) for k in range(40)]
    rows = plain + plain[:5] + [(90, plain[3][1], "en", "s", 1, "x"), (None, plain[7][1], None, None, None, None), (None, None, None, None, None, None), (91, None, "en", None, 0, None), (92, "", None, None, 0, None), (93, "12 34", None, None, 5, None)]
    rows += [(94, sentence(r, 30_000, 3000), "en", "s", 1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node string").withColumns({c: F.lit(1) for c in ("label", "block", "n", "member", "begins", "line", "spans", "host")})
    df.write.parquet(str(tmp_path / "some" / "documents.parquet"))
    bench.write.parquet(str(tmp_path / "some" / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "some")).collect()
    ids = {x.doc_id for x in got}
    assert ids == {*range(40), 94, None} and sum(x.doc_id is None for x in got) == 1
    assert max(x.length for x in got) <= packing.SEQUENCE and sum(x.doc_id == 94 for x in got) > 5
