"""Near-duplicate texts by circulant MinHash, banding and exact verification.

A text is the set of its word shingles. Two permutations of one universe give the whole
signature: the first scatters the shingles, the second is shifted by one place per coordinate,
and a coordinate is the smallest shifted value over the set. Coordinates are joined in bands;
texts that share a band are candidates, and a candidate pair links if the full sets are similar
enough (integer arithmetic on the whole texts).

Work is bounded without losing a link between different texts:

* Equal sets form a class; only its smallest document goes on.
* A band's bucket is first tested as a star around the member that has most company in all its
  buckets, which lies in the middle of a group of edited copies. What is linked then is one
  component, and pairs inside a component need no test.
* Buckets that still hold several components are cut into blocks. A task gets two blocks and tests
  members of different components: only in the first bucket that they share, only if enough
  coordinates of their signatures agree, and then by their full sets. Only links leave the task.
* Texts travel compressed, and only those in a bucket with company.

With 32 bands of 5 a pair at similarity 0.8 escapes with probability 3e-6, at 0.9 with 1e-12. The
test of coordinates stops five standard deviations below the similarity (3e-7).

Defined cases: a text without words has an empty set and is linked with nothing; fewer words
than a shingle has make one shingle. Rows that repeat a document are one document; if its rows
differ in text, all of them speak for it. Rows without doc_id are compared with nothing and kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.sources.shared import written

from . import tokens as tk
from .graph import connected_components

BANDS, ROWS = 32, 5
PLACES_BITS = 20
# Shingles whose coordinates are computed at a time.
BLOCK = 2048
# Members of a bucket in one block, and members compared with a block at a time.
MEMBERS, STRIPE = 4096, 64


@lru_cache(1)
def _permutations(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    """The first permutation, and a view whose row p is the second one's values at p, p + 1, ..."""
    places = 1 << PLACES_BITS
    first = np.argsort(tk.pseudo_random(places, 11)).astype(np.int32)
    second = np.argsort(tk.pseudo_random(places, 12)).astype(np.int32)
    around = np.concatenate([second, second[:coordinates - 1]])
    return first, np.lib.stride_tricks.sliding_window_view(around, coordinates)


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """The coordinates of a set of 64-bit shingles."""
    first, shifted = _permutations(coordinates)
    at = first[(shingles >> np.uint64(64 - PLACES_BITS)).astype(np.int64)]
    out = shifted[at[:BLOCK]].min(axis=0)
    for i in range(BLOCK, len(at), BLOCK):
        np.minimum(out, shifted[at[i:i + BLOCK]].min(axis=0), out=out)
    return out


def shingle_sets(chunk: tk.Chunk, width: int) -> Iterator[np.ndarray]:
    """The distinct shingles of each row of a chunk of lower-cased texts."""
    words = tk.find_words(chunk, tk.NOT_SPACE)
    marks = tk.fingerprints(chunk.data, words)
    runs = tk.sequence_fingerprints(marks, width)
    first = words.first.tolist()
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            yield np.unique(runs[a:b - width + 1])
        elif b > a:
            # a shorter sequence must not look like a full shingle
            yield tk.mixed(tk.sequence_fingerprints(marks[a:b], b - a) + np.uint64(b - a))
        else:
            yield np.empty(0, np.uint64)


def _band_keys(signatures: np.ndarray, bands: int) -> np.ndarray:
    """One number per row and band."""
    n, coordinates = signatures.shape
    parts = signatures.reshape(n, bands, coordinates // bands).astype(np.uint64)
    weights = tk.pseudo_random(coordinates // bands, 13) | np.uint64(1)
    return tk.mixed((parts * weights).sum(axis=2, dtype=np.uint64) + tk.pseudo_random(bands, 14)).view(np.int64)


def signed(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, a digest of the set in two numbers, the band keys (none for an empty set) and
    the last byte of every coordinate."""
    names = ["doc_id", "n_shingles", "set_a", "set_b", "bands", "coordinates"]
    scatter = np.uint64(0xD6E8FEB86659FD93)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in tk.chunks(batch.column("text")):
                sizes, one, two, found, low = [], [], [], [], []
                for own in shingle_sets(tk.lowered(chunk), width):
                    sizes.append(len(own))
                    one.append(tk.mixed(own).sum(dtype=np.uint64))
                    two.append(tk.mixed(own ^ scatter).sum(dtype=np.uint64))
                    if len(own):
                        found.append(signature(own, bands * rows))
                    low.append((found[-1] & 255).astype(np.uint8).tobytes() if len(own) else None)
                keys = _band_keys(np.stack(found), bands).ravel() if found else np.empty(0, np.int64)
                bounds = np.r_[0, np.cumsum(np.array(sizes) > 0) * bands]
                yield pa.record_batch(
                    [
                        batch.column("doc_id").slice(chunk.row, chunk.rows), pa.array(sizes, pa.int64()),
                        pa.array(np.array(one, np.uint64).view(np.int64)), pa.array(np.array(two, np.uint64).view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(keys)), pa.array(low, pa.binary()),
                    ],
                    names=names,
                )

    source = docs.select("doc_id", "text")
    schema = tk.with_fields(source.select("doc_id"), "n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>, coordinates binary")
    return source.mapInArrow(sign, schema)


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id and the compressed lower-cased text."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(3).compress
        for batch in batches:
            for chunk in tk.chunks(batch.column("text")):
                low = tk.lowered(chunk)
                data = pa.array([press(low.text(r)) for r in range(chunk.rows)], pa.binary())
                yield pa.record_batch([batch.column("doc_id").slice(chunk.row, chunk.rows), data], names=["doc_id", "packed"])

    source = docs.select("doc_id", "text")
    return source.mapInArrow(pack, tk.with_fields(source.select("doc_id"), "packed binary"))


def _verified(pairs: DataFrame, packed: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets satisfy 100 * intersection >= percent * union."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        last: dict[bytes, np.ndarray] = {}

        def shingles(data: bytes) -> np.ndarray:
            if data not in last:
                if len(last) > 64:
                    last.clear()
                raw = np.frombuffer(unpack(data), np.uint8)
                last[data] = next(shingle_sets(tk.Chunk(0, raw, np.array([0, len(raw)])), width))
            return last[data]

        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                left, right = shingles(x.as_py()), shingles(y.as_py())
                both = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(100 * both >= percent * (len(left) + len(right) - both) > 0)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = packed.select(F.col("doc_id").alias("a"), F.col("packed").alias("x"))
    right = packed.select(F.col("doc_id").alias("b"), F.col("packed").alias("y"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return both.mapInArrow(compare, pairs.select("a", "b").schema)


def _similar_size(n: str, m: str, percent: int) -> Column:
    return F.lit(100) * F.least(n, m) >= F.lit(percent) * F.greatest(n, m)


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest linked document) and kept, one row per document."""
    signs = written(signed(docs, width, bands, rows), "minhash-signatures")
    known = signs.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = known.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("doc"))
    heads = known.join(classes, ["set_a", "set_b"]).filter("doc_id = doc").select("doc", "n_shingles", "bands", "coordinates").distinct()
    members = heads.select("doc", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    crowded = members.groupBy("key").agg(F.count(F.lit(1)).alias("company")).filter("company > 1")
    buckets = written(members.join(crowded, "key"), "minhash-buckets")
    company = buckets.groupBy("doc").agg(F.sum("company").alias("company"))
    packed = written(_packed(docs.select("doc_id", "text").join(company.select(F.col("doc").alias("doc_id")), "doc_id", "left_semi")).distinct(), "minhash-texts")

    pairs = _stars(buckets.drop("company").join(company, "doc"), percent)
    links = written(_verified(pairs, packed, width, percent).distinct(), "minhash-links")
    labels = connected_components(links)
    members = buckets.join(labels.withColumnRenamed("id", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    mixed = members.groupBy("key").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("members")
    ).filter("low < high").drop("low", "high")
    rest = _links_in_buckets(members.select("key", "doc", "n", "component").join(mixed, "key"), heads, packed, width, percent, bands * rows)
    more = written(rest.distinct(), "minhash-links")
    if not more.isEmpty():
        labels = connected_components(links.union(more))

    component = known.select("doc_id", "set_a", "set_b", "n_shingles").join(classes, ["set_a", "set_b"])
    component = component.join(labels.withColumnRenamed("id", "doc"), "doc", "left")
    # a document with several texts is one vertex through each of them
    one = component.select("doc_id", "n_shingles", F.coalesce("component", "doc").alias("component_id"))
    alone = signs.filter("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    whole = one.union(alone)
    whole = whole.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max("n_shingles").alias("n_shingles"), F.min("component_id").alias("component_id")
    ).union(whole.filter("doc_id IS NULL").select("doc_id", "n_shingles", "component_id"))
    return whole.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _stars(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of each member of a bucket and the member with most company."""
    centre = members.groupBy("key").agg(F.max(F.struct("company", "doc", "n")).alias("centre"))
    both = members.join(centre, "key").filter((F.col("doc") != F.col("centre.doc")) & _similar_size("n", "centre.n", percent))
    other = F.col("centre.doc")
    return both.select(F.least("doc", other).alias("a"), F.greatest("doc", other).alias("b")).distinct()


def _links_in_buckets(
    members: DataFrame, heads: DataFrame, packed: DataFrame, width: int, percent: int, coordinates: int
) -> DataFrame:
    """Links (a, b) between members (key, doc, n, component, members) of one bucket with different components."""
    share = percent / 100
    least = int(coordinates * share - 5 * (coordinates * share * (1 - share)) ** 0.5)
    blocks = F.ceil(F.col("members") / F.lit(MEMBERS)).cast("int")
    own = F.pmod(F.xxhash64("doc"), blocks).cast("int")
    # a block meets every block from its own number on
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    spread = members.withColumn("own", own).withColumn("other", other).select(
        "key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "doc", "n", "component"
    )
    detail = heads.select("doc", "bands", "coordinates").join(packed.withColumnRenamed("doc_id", "doc"), "doc")
    kind = heads.schema["doc"].dataType.simpleString()

    def compare(table: pa.Table) -> pa.Table:
        doc, component = table.column("doc").to_numpy(), table.column("component").to_numpy()
        empty = table.select(["doc", "doc"]).rename_columns(["a", "b"]).slice(0, 0)
        names, label = np.unique(component, return_inverse=True)
        if len(names) < 2:
            return empty
        key, n = table.column("key")[0].as_py(), table.column("n").to_numpy()
        block = table.column("own").to_numpy()
        diagonal = table.column("p")[0].as_py() == table.column("q")[0].as_py()
        keys = np.array(table.column("bands").to_pylist(), np.int64)
        marks = np.frombuffer(b"".join(table.column("coordinates").to_pylist()), np.uint8).reshape(len(doc), -1)
        texts, sets = table.column("packed"), {}
        unpack = zstandard.ZstdDecompressor().decompress

        def shingles(i: int) -> np.ndarray:
            if i not in sets:
                raw = np.frombuffer(unpack(texts[i].as_py()), np.uint8)
                sets[i] = next(shingle_sets(tk.Chunk(0, raw, np.array([0, len(raw)])), width))
            return sets[i]

        found = []
        # members outside the largest component, against all others
        strays = np.flatnonzero(label != np.bincount(label).argmax())
        for at in range(0, len(strays), STRIPE):
            rows = strays[at:at + STRIPE]
            able = label[rows][:, None] != label
            able &= np.minimum(n[rows][:, None], n) * 100 >= percent * np.maximum(n[rows][:, None], n)
            if not diagonal:
                able &= block[rows][:, None] != block
            x, y = np.nonzero(able)
            x = rows[x]
            agree = np.zeros(len(x), np.int32)
            for part in range(0, len(x), 1 << 14):
                i, j = x[part:part + (1 << 14)], y[part:part + (1 << 14)]
                enough = (marks[i] == marks[j]).sum(axis=1) >= least
                same = keys[i] == keys[j]
                first = keys[i, same.argmax(axis=1)] == key
                agree[part:part + (1 << 14)] = enough & first
            for i, j in zip(x[agree > 0].tolist(), y[agree > 0].tolist(), strict=True):
                both = len(np.intersect1d(shingles(i), shingles(j), assume_unique=True))
                if 100 * both >= percent * (len(shingles(i)) + len(shingles(j)) - both):
                    found.append((i, j))
        if not found:
            return empty
        i, j = np.array(found).T
        a, b = np.minimum(doc[i], doc[j]), np.maximum(doc[i], doc[j])
        return pa.table({"a": pa.array(a, empty.schema.field("a").type), "b": pa.array(b, empty.schema.field("b").type)})

    return spread.join(detail, "doc").groupBy("key", "p", "q").applyInArrow(compare, f"a {kind}, b {kind}")


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with one document of each component; all columns stay."""
    gone = near_duplicates(docs, width, percent).filter(~F.col("kept")).select("doc_id")
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])
