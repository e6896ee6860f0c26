"""The n-gram model, vectors, and the pipeline against plain versions."""

import math
import zlib
from collections import Counter

import brute
import numpy as np
import pyarrow.parquet as pq
import pytest
from compare import spark_result, sql_result, tables
from pyspark.sql import functions as F

from cohortry.llm import elias_fano, language, ngram_model, queries, stages, vector_dedup
from cohortry.llm import tokens as tk


@pytest.mark.parametrize("seed", range(4))
def test_elias_fano(seed):
    draw = np.random.default_rng(seed)
    for _ in range(60):
        n, top = int(draw.integers(0, 300)), 10 ** int(draw.integers(1, 15))
        values = np.sort(draw.integers(0, top, n))
        own = elias_fano.EliasFano.of(values)
        assert own[np.arange(n)].tolist() == values.tolist()
        wanted = draw.integers(0, top, 40)
        first = np.zeros(40, np.int64)
        assert own.search(first, first + n, wanted).tolist() == np.searchsorted(values, wanted).tolist()


class PlainModel:
    """The model in dictionaries: tokens are lower-cased words, `$` ends (and begins) a text."""

    def __init__(self, texts, frequent):
        tokens = [[*brute.SPACED.findall(brute.low(t)), "$"] for t in texts]
        self.one = Counter(w for own in tokens for w in own)
        self.n, self.v = sum(self.one.values()), len(self.one)
        self.many = {w for w, c in self.one.items() if c >= max(1, frequent * self.n)}
        self.two, self.three, self.two_total, self.three_total = Counter(), Counter(), Counter(), Counter()
        for own in tokens:
            for before, word, after in self.contexts(own):
                if word in self.many:
                    self.two[word, after] += 1
                    self.two_total[word] += 1
                    if before in self.many:
                        self.three[before, word, after] += 1
                        self.three_total[before, word] += 1

    def contexts(self, own):
        path = [None, "$", *own]
        return zip(path, path[1:], path[2:], strict=False)

    def alone(self, word):
        return (self.one[word] + 1) / (self.n + self.v + 1)

    def order(self, counts, total, context, after, lower, least, discount):
        kept = {k[-1]: c for k, c in counts.items() if k[:-1] == context and c >= least and k[-1] in self.many}
        if not kept or not total:
            return lower
        rest = 1 - sum(c - discount for c in kept.values()) / total
        return (kept[after] - discount) / total * (after in kept) + rest * lower if after in kept else rest * lower

    def probability(self, before, word, after, least=ngram_model.LEAST, discount=ngram_model.DISCOUNT):
        p = self.alone(after)
        if word in self.many:
            p = self.order(self.two, self.two_total[word], (word,), after, p, least, discount)
            if before in self.many:
                p = self.order(self.three, self.three_total[before, word], (before, word), after, p, least, discount)
        return p

    def score(self, text):
        own = [*brute.SPACED.findall(brute.low(text)), "$"]
        return sum(math.log10(self.probability(*c)) for c in self.contexts(own))


@pytest.mark.parametrize("frequent, block", [(1e-4, 300), (0.02, 1_000_000)])
def test_scores(spark, documents, texts, frequent, block):
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, "unseen words only"), (903, "x " * 3000), (0, texts[0])]
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2
    out = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 == 2}
    model = PlainModel([t for i, t in rows if i not in out], frequent)
    got = ngram_model.scores(documents(rows, extra=True), held, frequent, block_tokens=block).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        own = [*brute.SPACED.findall(brute.low(text[r["doc_id"]])), "$"]
        assert r["held_out"] == (r["doc_id"] in out) and r["train_tokens"] == model.n
        assert (r["n_tokens"], r["n_known"]) == (len(own), sum(model.one[w] > 0 for w in own))
        assert math.isclose(r["base_score"], sum(math.log10(model.alone(w)) for w in own), rel_tol=1e-12)
        assert math.isclose(r["score"], model.score(text[r["doc_id"]]), rel_tol=1e-3, abs_tol=2e-4 * len(own))


def test_every_ngram_from_two_occurrences_on_counts(spark, documents):
    # two words of 150,000 tokens: a share far below 2e-5
    rows = [(1, "the end of it " * 37_500), (2, "lapis lazuli rara avis"), (3, "rara avis lapis lazuli lapis"), (4, "the rara avis lazuli")]
    model = PlainModel([t for _, t in rows], 0)
    got = {r["doc_id"]: r["score"] for r in ngram_model.scores(documents(rows), F.lit(False)).collect()}
    for i, text in rows[1:]:
        assert math.isclose(got[i], model.score(text), abs_tol=2e-3)
    assert model.two["rara", "avis"] == 3 and model.three["$", "lapis", "lazuli"] == 1


def test_probabilities_sum_to_one(texts):
    model = PlainModel(texts, 1e-3)
    for before, word in [("$", "alpha"), ("alpha", "beta"), ("x", "42"), ("nothing", "theta")]:
        total = sum(model.probability(before, word, w) for w in [*model.one, "unseen"])
        assert math.isclose(total, 1, rel_tol=1e-9)


def test_scores_without_training_or_rows(spark, documents):
    everything = ngram_model.scores(documents([(1, "a b"), (2, None)]), F.lit(True)).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["score"]) for r in everything) == [(1, 3, 0, 0, 0.0), (2, 1, 0, 0, 0.0)]
    assert ngram_model.scores(documents([]), F.lit(False)).count() == 0


def test_model_table(spark, documents, texts):
    frame = documents([(i, t) for i, t in enumerate(texts)])
    own = ngram_model.blocks(frame, F.lit(False))
    words = np.unique(np.concatenate([np.frombuffer(r["words"], np.uint64) for r in own.select("words").collect()]))
    found = ngram_model.tries(ngram_model.ngram_requests(own, ngram_model.Numbering(words))).collect()
    size = sum(elias_fano.Trie.mapped(r["trie"]).sequences["follow"].size for r in found)
    model = PlainModel(texts, 0)
    assert size == sum(c >= 2 for c in model.two.values())


def vectors_like(draw, n):
    """Clusters of vectors around a few centres, some copies."""
    centres = draw.normal(size=(12, 16))
    rows = centres[draw.integers(0, 12, n)] + draw.normal(size=(n, 16)) * draw.choice([0.1, 0.3, 0.6], (n, 1))
    rows[5] = rows[6] = rows[7]
    return rows


@pytest.mark.parametrize("block", [17, 2000])
def test_vectors(spark, block):
    draw = np.random.default_rng(8)
    good = [(i, [float(x) for x in row]) for i, row in enumerate(vectors_like(draw, 300))]
    bad = [(400, None), (401, [0.0] * 16), (402, [None] + [1.0] * 15), (403, [float("nan")] * 16), (404, [float("inf")] + [0.0] * 15), (405, [1.0, 2.0])]
    frame = spark.createDataFrame([*good, *bad, good[3], (None, good[3][1])], "vec_id bigint, embedding array<double>").selectExpr("*", "1 AS cell", "'x' AS unit")
    unit = np.array([v for _, v in good])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    label = brute.components(range(300), [(int(a), int(b)) for a, b in zip(*np.nonzero(near), strict=True)])
    got = vector_dedup.near_vectors(frame, recall=1.0, block=block).collect()
    found = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got if r["vec_id"] is not None)
    want = [(i, int(near[i].sum()), label[i], label[i] == i) for i in range(300)] + [(i, 0, i, True) for i, _ in bad]
    # the probes are all vectors here, so nothing may be missed
    assert found == want
    assert [(r["n_links"], r["kept"]) for r in got if r["vec_id"] is None] == [(0, True)]
    assert vector_dedup.near_vectors(frame.limit(0)).count() == 0
    alone = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id bigint, embedding array<float>")
    assert [tuple(r) for r in vector_dedup.near_vectors(alone).collect()] == [(1, 0, 1, True)]


@pytest.mark.parametrize("passes", [1, 8])
def test_rare_neighbours_are_found(spark, monkeypatch, passes):
    # 20 pairs near the threshold among 3,000 vectors: few of 256 probes have a neighbour
    monkeypatch.setattr(vector_dedup, "MOST_PASSES", passes)
    draw = np.random.default_rng(3)
    unit = draw.normal(size=(3000, 64))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    for i in range(20):
        aside = draw.normal(size=64)
        aside -= aside @ unit[i] * unit[i]
        unit[i + 20] = 0.91 * unit[i] + math.sqrt(1 - 0.91**2) * aside / np.linalg.norm(aside)
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(unit)], "vec_id bigint, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vector_dedup.near_vectors(frame).collect()}
    assert got == {i: (int(i < 40), i - 20 if 20 <= i < 40 else i) for i in range(3000)}


def test_multi_sequence_visits_cells_in_order():
    draw = np.random.default_rng(4)
    grid = vector_dedup.Grid(draw.normal(size=(6, 3)), draw.normal(size=(6, 3)))
    d1, d2 = grid.distances(draw.normal(size=(20, 6)))
    for x, y in zip(d1, d2, strict=True):
        whole = (x[:, None] + y).ravel()
        visits = grid.visits(x, y, 1.5)
        assert whole[visits].tolist() == sorted(whole[visits]) and set(visits) == set(np.flatnonzero(whole <= whole.min() + 1.5))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, data, name):
    assert spark_result(queries.QUERIES[name](spark, data)) == sql_result(tables(data), queries.SQL[name])


def test_every_operator_has_one_query():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, 14))


def plain_pipeline(rows, items, languages):
    """(doc_id, text, tokens) that remain of (doc_id, text) rows."""
    import tiktoken

    from cohortry.llm import byte_bpe, secrets

    def known_language(text):
        name, _, _, length, size = languages.of(text)
        return name != "und" and (length >= 1.5 or size < 32)

    kept = [(d, t) for d, t in rows if t is not None and known_language(t)]
    single = {d for d, _, _, first in brute.near_duplicates(kept, 5) if first}
    known = brute.windows(items, 10)
    cut = [(d, brute.decontaminated(t, known)) for d, t in kept if d in single]
    ranks = byte_bpe.read_ranks(queries.BYTE_BPE)
    scanner = secrets.Scanner(ranks, queries.PATTERN)
    library = tiktoken.Encoding("own", pat_str=queries.PATTERN, mergeable_ranks=ranks, special_tokens={})
    clean = [(d, secrets.redacted(t, scanner.spans(t))) for d, t in cut if t is not None]
    return [(d, t, library.encode_ordinary(t)) for d, t in clean]


def languages_of(table, learn):
    sample = language.training_sample(table, learn)
    return brute.Languages(brute.learned_words(sample, language.SAMPLE_BYTES, language.FOREIGN))


def test_language_query_against_plain_parses(spark, data):
    """The registered query, on all texts."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    plain = languages_of(docs, ~queries.held_out(4))
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    for r in queries.QUERIES["op10_language"](spark, data).collect():
        name, margin, bits, *_ = plain.of(texts[r["doc_id"]])
        assert (r["lang_pred"], round(r["score"], 9), round(r["bits"], 9)) == (name, round(margin, 9), round(bits, 9))


def test_language_stage_rejects_texts_in_no_learned_language(spark, documents):
    rows = [(i, "the house of the old river and the small tree " * 3, "en") for i in range(20)]
    rows += [(i, "la maison est dans le petit jardin avec des fleurs " * 3, "fr") for i in range(20, 40)]
    odd = [
        (100, "Это длинный русский текст, которого никто не учил, и он совсем другой.", None), (101, "漢字かな交じり文はどの言語にも属さない長い文です", None),
        (102, "да", None), (103, "12 34 5", None), (104, "a river house", None), (105, "qzx", None), (106, None, None),
    ]
    docs = documents(rows + odd)
    kept = {r["doc_id"] for r in stages.language_stage(spark, docs, "").collect()}
    plain = languages_of(docs, F.lit(True))
    judged = {d: plain.of(t) for d, t, _ in rows + odd if t is not None}
    assert kept == {d for d, (name, _, _, length, size) in judged.items() if name != "und" and (length >= 1.5 or size < 32)}
    assert set(range(40)) <= kept and kept & set(range(100, 107)) == {102, 104, 105}


def test_pipeline(spark, data):
    docs = pq.read_table(f"{data}/documents.parquet").to_pylist()
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{data}/benchmark.parquet").to_pylist()]
    table = spark.read.parquet(f"{data}/documents.parquet")
    want = plain_pipeline([(r["doc_id"], r["text"]) for r in docs], items, languages_of(table, F.lit(True)))
    got = stages.run(spark, data).collect()
    assert sorted((r["doc_id"], r["text"], r["token_ids"]) for r in got) == sorted(want)
    assert all(r["restored"] and r["n_chars"] == len(r["text"]) and r["n_tokens"] == len(r["token_ids"]) for r in got)
    source = {r["doc_id"]: (r["lang"], r["source"]) for r in docs}
    assert all(source[r["doc_id"]] == (r["lang"], r["source"]) for r in got)


def test_stages_on_odd_rows(spark, documents, data):
    rows = [(1, None), (2, ""), (3, "1 2 3"), (4, "the house"), (5, "the house"), (6, "word " * 20_000), (None, "the other house")]
    for extra in (False, True):
        docs = documents(rows, extra)
        columns = docs.columns
        for _, stage in stages.STAGES[:-1]:
            docs = stage(spark, docs, data)
            assert docs.columns == columns
        assert sorted((r["doc_id"] for r in docs.collect()), key=str) == [4, 6, None]
        assert stages.STAGES[-1][1](spark, docs, data).filter("restored").count() == 3
    empty = documents([])
    for _, stage in stages.STAGES:
        assert stage(spark, empty, data).count() == 0
