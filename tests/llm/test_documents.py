"""Operators on documents against plain versions."""

import textwrap

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortry.llm import decontaminate, graph, language, licenses, minhash, shard_tree, substring_dedup
from cohortry.llm import tokens as tk

EDGE_ROWS = [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, "x" * 50_000), (906, "a b " * 4000)]


def test_words_and_fingerprints(texts):
    column = pa.array([*texts, None, "", "a b\x1cc\x0bd"])
    words, marks = [], {}
    for chunk in tk.chunks(column, 500):
        found = tk.find_words(chunk, tk.NOT_SPACE)
        numbers = tk.fingerprints(chunk.data, found)
        for r in range(chunk.rows):
            a, b = found.first[r], found.first[r + 1]
            words.append([chunk.data[s:e].tobytes().decode() for s, e in zip(found.start[a:b], found.end[a:b], strict=True)])
            for w, n in zip(words[-1], numbers[a:b].tolist(), strict=True):
                assert marks.setdefault(w, n) == n
    assert words == [brute.SPACED.findall(t or "") for t in column.to_pylist()]
    assert len(set(marks.values())) == len(marks)


@pytest.mark.parametrize("width, anchor, dense, shard", [(6, 3, 400, 50), (6, 3, 2, 50), (9, 9, 400, 10_000), (12, 2, 5, 1)])
def test_substrings(spark, documents, texts, width, anchor, dense, shard):
    rows = [(i, t) for i, t in enumerate(texts)] + EDGE_ROWS + [(906, "a b " * 4000), (3, "another text of document three " * 3), (None, texts[5])]
    got = substring_dedup.without_repeats(documents(rows, extra=True), width, anchor, dense, shard).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute.substrings(rows, width)
    assert substring_dedup.without_repeats(documents([]), width, anchor).count() == 0


@pytest.mark.parametrize("width", [1, 2, 5])
def test_near_duplicates(spark, documents, texts, width):
    rows = [(i, t) for i, t in enumerate(texts)] + EDGE_ROWS
    got = sorted(tuple(r) for r in minhash.near_duplicates(documents(rows, extra=True), width).collect())
    assert got == brute.near_duplicates(rows, width)


def test_near_duplicates_of_a_chain_and_repeated_rows(spark, documents):
    # every text is linked to the next one only; the last row repeats a document
    words = [f"w{i}" for i in range(160)]
    rows = [(100 - k, " ".join(words[k * 6:k * 6 + 60])) for k in range(16)]
    want = brute.near_duplicates(rows, 2)
    assert len({r[2] for r in want}) == 1
    got = minhash.near_duplicates(documents([*rows, rows[3], (None, rows[0][1]), (None, None)]), 2).collect()
    assert sorted(tuple(r) for r in got if r["doc_id"] is not None) == want
    assert all(r["kept"] for r in got if r["doc_id"] is None)
    assert minhash.near_duplicates(documents([]), 2).count() == 0
    frame = documents(rows, extra=True)
    kept = minhash.deduplicated(frame, 2)
    assert kept.columns == frame.columns and [r["doc_id"] for r in kept.collect()] == [85]


def test_signature_estimates_similarity():
    draw = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.95):
        both = draw.integers(0, 1 << 63, int(2000 * share)).astype(np.uint64) << np.uint64(1)
        own = [draw.integers(0, 1 << 63, int(1000 * (1 - share))).astype(np.uint64) << np.uint64(1) for _ in range(2)]
        one, two = (minhash.signature(np.unique(np.r_[both, x]), 512) for x in own)
        true = len(both) / (len(both) + sum(map(len, own)))
        assert abs((one == two).mean() - true) < 0.08


def test_components(spark):
    draw = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in draw.integers(0, 300, (220, 2))] + [(500 + i, 501 + i) for i in range(40)]
    label = brute.components(range(600), edges)
    got = {r["id"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: label[i] for a, b in edges if a != b for i in (a, b)}
    assert graph.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


ITEMS = [
    (1, "one two three four five six seven eight nine ten eleven"), (2, "Short, item!"), (3, None), (4, "..."),
    (5, "two three four five six seven eight nine ten eleven twelve"), (6, "a a a a a a a a a a a a"), (7, "short item"),
]
POLLUTED = [
    (1, "say: One two-three FOUR five, six seven eight nine ten eleven twelve end"), (2, "a " * 30), (3, "a short item here"),
    (4, "two three four five six seven eight nine ten"), (5, None), (6, ""), (7, "clean text"), (7, "clean text"), (8, "short\nitem " * 700),
    (9, "one two three four five six seven eight nine ten " + "word " * 30),
]


@pytest.mark.parametrize("shard_bytes, items", [(1 << 20, ITEMS), (60, ITEMS), (1 << 20, ITEMS[:1]), (1 << 20, [(1, "a")]), (1 << 20, [])])
def test_contamination(spark, documents, shard_bytes, items):
    table = spark.createDataFrame(items, "item_id bigint, text string")
    known = brute.windows(items, 10)
    rows = list(dict(POLLUTED).items()) if shard_bytes == 60 else POLLUTED
    got = decontaminate.contamination(documents(rows, extra=True), table, shard_bytes=shard_bytes).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute.contamination_row(d, t, known) for d, t in rows)
    frame = documents(POLLUTED, extra=True)
    clean = decontaminate.cleaned(frame, table, shard_bytes=1 << 20)
    assert clean.columns == frame.columns
    want = [(d, brute.decontaminated(t, known)) for d, t in POLLUTED]
    assert sorted(((r["doc_id"], r["text"]) for r in clean.collect()), key=str) == sorted(
        ((d, n) for (d, n), (_, t) in zip(want, POLLUTED, strict=True) if n is not None or t is None), key=str)
    assert decontaminate.contamination(documents([]), table).count() == 0


def test_groups_of_items_change_nothing(spark, documents):
    words = [f"w{i}" for i in range(60)]
    # overlapping items; parts of one text that only together are most of it; missing and repeated numbers
    items = [(i, " ".join(words[s:s + 12])) for i, s in enumerate((0, 6, 20, 26, 40))] + [(9, "short item")]
    both = " ".join(words[:12]) + " and so on for a while " + " ".join(words[20:32])
    rows = [
        (1, "say " + " ".join(words[:18]) + " end " + "more " * 40), (1, "say " + " ".join(words[20:38]) + " end " + "more " * 40),
        (None, both), (None, "clean"), (None, both), (2, None), (3, ""), (3, "a short item " + "here " * 9), (4, " ".join(words[40:52]) + " x" * 20),
    ]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    known = brute.windows(items, 10)
    frame = documents(rows, extra=True)
    assert decontaminate.shards(table, 60)[0] > 3
    got = decontaminate.contamination(frame, table, shard_bytes=60).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(brute.contamination_row(d, t, known)) for d, t in rows)
    clean = decontaminate.cleaned(frame, table, shard_bytes=60)
    assert clean.columns == frame.columns
    want = [(d, brute.decontaminated(t, known)) for d, t in rows]
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in clean.collect()))) == sorted(
        str((d, n)) for (d, n), (_, t) in zip(want, rows, strict=True) if n is not None or t is None)


def test_shards(spark, documents):
    import zlib

    rows = [(i, "é" * (i % 7)) for i in range(4000)] + [(None, None), (None, None), (1, "x")]
    tree = shard_tree.uniform(5, 4, 2)
    got = shard_tree.shard_rows(documents(rows, extra=True), tree).collect()
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in got) == sorted(
        (d or -1, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 40)
    assert sorted(slots) == list(range(40))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({(r["doc_id"], r["shard"]) for r in got}) == 4001
    moved = sum(r["grown_shard"] == 40 for r in got)
    assert 50 < moved < 160
    assert shard_tree.shard_rows(documents([]), tree).count() == 0


def test_weights_confine_movement(spark):
    from pyspark.sql import functions as F

    before = [[[1.0, 1.0], [1.0, 0.0]], [[2.0], [1.0, 1.0]]]
    after = [[[1.0, 1.0], [1.0, 0.0]], [[2.0], [1.0, 3.0]]]  # rack 1 of region 1 grows
    rows = spark.range(5000).withColumn("key", F.col("id").cast("string"))
    both = shard_tree.place(shard_tree.place(rows, F.col("key"), before, "old"), F.col("key"), after, "new").collect()
    assert 3 not in {r["old"] for r in both} and 3 not in {r["new"] for r in both}
    moves = {(r["old"], r["new"]) for r in both if r["old"] != r["new"]}
    # rows enter region 1 (shards 4 to 6), within it rack 1 (shards 5 and 6), within that shard 6
    assert all(new >= 4 and (old < 4 or new > 4) and (old, new) != (6, 5) for old, new in moves) and (5, 6) in moves
    share = sum(r["new"] >= 4 for r in both) / len(both)
    assert abs(share - 6 / 9) < 0.03
    with pytest.raises(ValueError):
        shard_tree.place(rows, F.col("key"), [[[0.0]]], "none")


def test_language(spark, documents, data):
    docs = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/documents.parquet")
    from cohortry.llm.queries import held_out

    parser = language.train(language.training_sample(docs, ~held_out(4)))
    found = language.identify(docs.filter(held_out(4)), parser).join(docs, "doc_id").select("lang_pred", "lang", "score").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in found) >= 0.98 * len(found)
    assert all(0 <= r["score"] <= 1 for r in found)
    rows = [(1, None), (2, ""), (3, "123 %%%"), (4, "Ж"), (5, "the house of that"), (5, "the house of that"), (6, "der und " * 3000), (7, "—")]
    frame = documents(rows, extra=True)
    labels = sorted((r["doc_id"], r["lang_pred"]) for r in language.identify(frame, parser).collect())
    assert [x for x in labels if x[0] in (1, 2, 3, 7)] == [(i, "und") for i in (1, 2, 3, 7)]
    assert labels.count((5, "en")) == 2 and (6, "de") in labels and dict(labels)[4] in parser.names
    kept = language.accepted(frame, parser)
    assert kept.columns == frame.columns and sorted(r["doc_id"] for r in kept.collect()) == [4, 5, 5, 6]
    nothing = language.train(language.training_sample(documents([(1, "text")]), held_out(4)))
    assert [tuple(r)[1:3] for r in language.identify(documents([(1, "text")]), nothing).collect()] == [("und", 0.0)]
    assert language.identify(documents([]), parser).count() == 0


def test_sample_is_bounded_for_repeated_and_missing_numbers(spark, documents):
    rows = [(None, f"text {i}", "en") for i in range(60)] + [(7, f"wort {i}", "de") for i in range(60)] + [(8, "mot", "fr")] * 60
    found = language.training_sample(documents(rows), F.lit(True), rows=15)
    assert [sum(name == own for own, _ in found) for name in ("en", "de", "fr")] == [5, 5, 1]
    assert len(set(found)) == 11


def test_phrases_are_longest_matches():
    words = [b"banana", b"bandana", b"cab"]
    parser = language.train([("x", "banana bandana cab"), ("y", "ab")])
    text = " ".join(f" {w.decode()} " for w in words)

    def parse(word):
        count, rest = 0, f" {word} "
        while rest:
            size = max((k for k in range(1, len(rest) + 1) if any(rest[:k] in f" {w.decode()} " for w in words)), default=1)
            count, rest = count + 1, rest[size:]
        return count

    assert text
    tests = ["banana", "nab", "xyz", "bandcab", "c", "anana", "éb"]
    chunk = next(tk.chunks(pa.array([" ".join(tests)])))
    found = tk.find_words(chunk, language.LETTERS)
    got = language.phrases(parser, chunk.data, found.start, found.end)[:, 0].tolist()
    assert got == [parse(t) if t.isascii() else parse("??b") for t in tests]


def test_licenses(spark, documents):
    prose = "Thnd ouble was there. " * 60
    rows = [
        (1, "intro\nReleased under the MIT License.\nend"), (2, "Licensed under the Apache license, version 2.0"), (3, None), (4, ""),
        (5, "He has a license to drive."), (6, prose + "Licensed under CC BY-NC 4.0. " + prose), (6, "x"),
        (7, "This work is licensed under the GNU General Public License, version 2."),
        (8, "This work, as given, is licensed under the GNU General Public License, version 3."),
    ]
    got = {(r["doc_id"], r["license"], r["n_missing"], r["n_added"], r["exact"]) for r in licenses.find_licenses(documents(rows, extra=True)).collect()}
    assert got == {
        (1, "MIT", 0, 0, True), (2, "Apache-2.0", 0, 0, True), (6, "CC-BY-NC-4.0", 0, 0, True), (7, "GPL-2.0", 0, 0, True),
        (8, "GPL-3.0", 0, 2, False),
    }
    spans = {r["doc_id"]: r for r in licenses.find_licenses(documents(rows)).collect()}
    assert rows[0][1][spans[1]["start"]:spans[1]["end"]] == "Released under the MIT License."
    assert licenses.find_licenses(documents([])).count() == 0


def test_licenses_in_prose_over_lines_and_side_by_side(spark, documents):
    prose = "we came to the old mill by the river and sat down for a while, "
    mit, terms, header = (licenses.TEMPLATES[n] for n in ("MIT", "MIT terms", "Apache-2.0 header"))
    wrapped = "\n".join(f" * {line}" for line in textwrap.wrap(header, 50))
    rows = [
        (1, prose + mit + " " + prose), (2, prose * 2 + mit.lower() + " " + prose * 2), (3, f"/*\n{wrapped}\n */\nint x;"),
        (4, f"{mit} Some files: licensed under CC BY 4.0. {prose}{mit} {mit}"), (5, "\n".join(f"# {w}" for w in terms.split())),
        (6, f"{mit}\n{header}\nAll rights reserved."), (7, prose + "a license to fish, released under the old bridge. " + prose),
    ]
    found = licenses.find_licenses(documents(rows)).collect()
    assert all(r["exact"] for r in found)
    got = sorted((r["doc_id"], r["start"], r["license"]) for r in found)
    assert [(i, name) for i, _, name in got] == [
        (1, "MIT"), (2, "MIT"), (3, "Apache-2.0 header"), (4, "MIT"), (4, "CC-BY-4.0"), (4, "MIT"), (4, "MIT"), (5, "MIT terms"),
        (6, "MIT"), (6, "Apache-2.0 header"), (6, "reserved"),
    ]
    text = dict(rows)
    assert all(text[r["doc_id"]][r["start"]:r["end"]].lower() == mit.lower() for r in found if r["license"] == "MIT")
