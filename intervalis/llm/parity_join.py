"""N-gram Jaccard join by parity sketches.

A document's set holds its distinct 5-word shingles. Every shingle toggles one
bit of a long virtual bit string, so the Hamming distance of two such strings
never exceeds the symmetric difference of the sets. Two sets that are linked
(Jaccard >= 0.8) and have a and b members differ in at most (a + b) / 9 of
them, which bounds the distance; the strings are cut into parts, and by the
pigeonhole principle linked sets agree in some part that is not empty. A part
is represented by the XOR of its odd bits' hashes.

Shingles that very many texts share (a fixed number of them at most) are left
out of the strings, which can only lower the distance; a set with too few other
parts for the pigeonhole argument also emits parts over all its shingles.

Steps: (1) one thin row per document: set size, fingerprint, a dense 1024-bit
parity sketch; (2) parts as join keys, once per distinct set and task, in each
size band where a partner can be; (3) within a key, neighbours and the
smallest member become candidate pairs, which size and sketch distance thin
out; (4) the closest pair of each set is verified with the exact sets, and
links make components; (5) then the other candidates, and neighbours in another
order, whose components differ; (6) what a key still holds in different
components is paired in full and verified, so no link that could join two
components is lost.

Sets of at most seven shingles are linked to equal sets and to those of one
more shingle: their names meet the names of larger sets without one member.

Exact copies share a fingerprint and are one node throughout. Documents
without words have size 0 and are linked with nothing; null text counts as
empty; repeated rows keep their rows; a null doc_id is ignored by the minimum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from intervalis.llm._batches import all_of, bound_batches, chunks, free_names, mix, row_key, stream, text_bytes, tidy, word_hashes
from intervalis.operators.graph import connected_components
from intervalis.plans.scratch import materialize

WORDS = 5
SKETCH_LONGS = 16
#: Members of a part, at the top of a size band; bands double.
PART_LOAD = 2.8
BLOOM_WORDS = 1 << 17
#: At most so many shingles are left out of the strings; each is in this many sets of one task at least.
MOST_COMMON, COMMON_IN_TASK = 1 << 17, 6
#: Sets of at most so many members have links that are exact names, not candidates.
SMALL = 7
PART, WHOLE, LACKING = 0, 1, 2
_COEFFICIENTS = stream(2, 16) | np.uint64(1)


def shingle_sets(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for a, b in chunks(texts):
        words, first = word_hashes([t or b"" for t in texts[a:b]])
        full = mix(sum((words[k : len(words) - WORDS + 1 + k] * _COEFFICIENTS[k] for k in range(WORDS)), np.uint64(WORDS))) if len(words) >= WORDS else words[:0]
        for s, e in zip(first[:-1], first[1:], strict=True):
            n = e - s
            if n >= WORDS:
                yield np.unique(full[s : e - WORDS + 1])
            elif n:
                with np.errstate(over="ignore"):
                    yield mix(np.sum(words[s:e] * _COEFFICIENTS[:n], dtype=np.uint64, keepdims=True) + np.uint64(n))
            else:
                yield words[:0]


def fingerprint(members: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return int(mix(np.add.reduce(mix(members ^ np.uint64(0xA5A5A5A5))) + np.uint64(len(members))).astype(np.int64))


def dense_sketch(members: np.ndarray) -> np.ndarray:
    """1024 parity bits as 16 signed longs."""
    bits = np.bincount((members & np.uint64(64 * SKETCH_LONGS - 1)).astype(np.int64), minlength=64 * SKETCH_LONGS) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def size_band(n: int) -> int:
    return n.bit_length()


def _held_in(members: np.ndarray, few: np.ndarray) -> np.ndarray:
    if not len(few):
        return np.zeros(len(members), dtype=bool)
    at = np.searchsorted(few, members)
    return few[np.minimum(at, len(few) - 1)] == members


def _parts(members: np.ndarray, parts: int, seed: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """The non-empty parts of a bit string, in order, and the key of each."""
    part = ((members >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    at = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.zeros(0, dtype=np.int64)
    content = np.bitwise_xor.reduceat(mix(members + np.uint64(7)), at) if len(part) else members
    return part[at], mix(content + mix(seed ^ part[at]))


def part_keys(members: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Join keys of a set: its leading non-empty parts in its own size band, and in the band below if a smaller partner can be there.

    A linked partner differs in at most n / 4 parts, so n // 4 + 1 non-empty
    ones suffice; they are taken over the shingles that aren't ``common``
    (sorted). A set with fewer emits all of them, and those over all its
    shingles; if these are too few as well, its empty parts too. Two sets of
    the latter kinds then share a part of that kind, and a set of the usual
    kind always agrees with its partner in a part that is not empty.
    """
    n = len(members)
    if n <= SMALL:  # see small_keys
        return members[:0]
    need, out, rare = n // 4 + 1, [], members[~_held_in(members, common)]
    for band in (size_band(n), size_band(n) - 1):
        top = (1 << band) - 1
        if band != size_band(n) and (n * 4 > top * 5 or top <= SMALL):
            continue  # its smallest partner is still in its own band, or those below have no parts
        parts = max(4, int((top + 1) / PART_LOAD) + 2)
        seed = mix(np.array([band, band + 1000, band + 2000], dtype=np.uint64))
        _, keys = _parts(rare, parts, seed[0])
        out.append(keys[:need])
        if len(keys) < need:
            full, keys = _parts(members, parts, seed[1])
            out.append(keys[:need])
            if len(keys) < need:
                empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), full)
                out.append(mix(seed[2] ^ empty))
    return np.concatenate(out)


def small_keys(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The name of a small set, and those of the sets that lack one of its members.

    Linked sets of which one has at most SMALL members are equal or differ in
    one member (and with fewer than 4 are equal), so the smaller one's name is
    one of the larger one's second names.
    """
    n, none = len(members), members[:0]
    if not 4 <= n <= SMALL + 1:
        return none, none
    terms = mix(members ^ np.uint64(0x5BD1E995))
    total = np.add.reduce(terms)
    with np.errstate(over="ignore"):
        whole = mix(np.array([total + np.uint64(n)], dtype=np.uint64))
        lacking = mix(total - terms + np.uint64(n - 1))
    return whole if n <= SMALL else none, lacking if n > 4 else none


def _rows(table: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(table, schema=schema)


def _thin(id_type: pa.DataType):
    """Thin rows; after a task's last, its common shingles: their hashes as fp, and how many sets hold them."""
    schema = pa.schema([("id", id_type), ("n", pa.int64()), ("fp", pa.int64()), ("sketch", pa.list_(pa.int64())), ("common", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        pool: list[np.ndarray] = []
        tally, counts, pooled = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0

        def fold(final: bool) -> None:
            """Add the pool to the tally; a shingle met once in a full pool is forgotten."""
            nonlocal tally, counts, pooled
            new, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *pool]), return_counts=True)
            tally, index = np.unique(np.concatenate([tally, new]), return_inverse=True)
            counts = np.bincount(index, weights=np.concatenate([counts, times]), minlength=len(tally)).astype(np.int64)
            keep = counts >= (COMMON_IN_TASK if final else 2)
            tally, counts, pooled = tally[keep], counts[keep], 0
            pool.clear()

        for batch in batches:
            sets = list(shingle_sets(text_bytes(batch.column("text"))))
            names = [fingerprint(s) if len(s) else None for s in sets]
            for name, members in zip(names, sets, strict=True):
                if name is not None and name not in seen:
                    seen.add(name)
                    pool.append(members)
                    pooled += len(members)
                    if pooled > 1 << 20:
                        fold(False)
            yield _rows({"id": batch.column("id"), "n": [len(s) for s in sets], "fp": names, "sketch": [dense_sketch(s) if len(s) else None for s in sets], "common": [False] * len(sets)}, schema)
        fold(True)
        yield _rows({"id": pa.nulls(len(tally), id_type), "n": counts, "fp": tally.view(np.int64), "sketch": pa.nulls(len(tally), pa.list_(pa.int64())), "common": [True] * len(tally)}, schema)

    return run


def _keyed(common: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys, names, kinds = [], [], []
            for members in shingle_sets(text_bytes(batch.column("text"))):
                if len(members) < 4 or (name := fingerprint(members)) in seen:
                    continue
                seen.add(name)
                for kind, some in zip((PART, WHOLE, LACKING), (part_keys(members, common), *small_keys(members)), strict=True):
                    keys.append(some)
                    names.append(np.full(len(some), name, dtype=np.int64))
                    kinds.append(np.full(len(some), kind, dtype=np.int8))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(names)), pa.array(np.concatenate(kinds))], names=["part", "fp", "kind"])

    return run


def _wanted_sets(bitmap: np.ndarray):
    """Sets whose fingerprint may be wanted, once each and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            names, members = [], []
            for found in shingle_sets(text_bytes(batch.column("text"))):
                if not len(found) or (name := fingerprint(found)) in seen:
                    continue
                slot = name & (64 * BLOOM_WORDS - 1)
                if bitmap[slot >> 6] >> (slot & 63) & 1:
                    seen.add(name)
                    names.append(name)
                    members.append(found.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(members, pa.binary())], names=["fp", "members"])

    return run


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("ma").to_pylist(), batch.column("mb").to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= 80 * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _apart(x: str, y: str) -> F.Column:
    """Hamming distance of two sketches: at most the symmetric difference of the sets."""
    return sum((F.bit_count(F.col(f"{x}.sketch")[k].bitwiseXOR(F.col(f"{y}.sketch")[k])) for k in range(SKETCH_LONGS)), F.lit(0))


def _near(x: str, y: str) -> F.Column:
    """Sizes and sketch distance allow a link of x and y."""
    sizes = F.least(f"{x}.n", f"{y}.n") * 5 >= F.greatest(f"{x}.n", f"{y}.n") * 4
    return sizes & (_apart(x, y) * 9 <= F.col(f"{x}.n") + F.col(f"{y}.n"))


def _sets_of(names: DataFrame, texts: DataFrame) -> DataFrame:
    """(fp, members) of the named sets, from a reading of the texts that a bitmap of fixed size thins out."""
    spark = names.sparkSession
    slot = F.col("fp").bitwiseAND(F.lit(64 * BLOOM_WORDS - 1))
    words = (
        names.select(F.shiftright(slot, 6).alias("word"), F.expr("shiftleft(1L, cast(fp & 63 as int))").alias("bit"))
        .groupBy("word").agg(F.bit_or("bit").alias("bits")).collect()
    )  # at most BLOOM_WORDS rows
    bitmap = np.zeros(BLOOM_WORDS, dtype=np.int64)
    for word, bits in words:
        bitmap[word] = bits
    shared = spark.sparkContext.broadcast(bitmap)

    def run(batches):
        return _wanted_sets(shared.value)(batches)

    return texts.select("text").mapInArrow(tidy(run), "fp long, members binary").join(names, "fp", "left_semi").dropDuplicates(["fp"])


def _verify(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """The pairs (a, b) of fingerprints whose sets are linked."""
    left = pairs.join(held.select(F.col("fp").alias("a"), F.col("members").alias("ma")), "a")
    both = left.join(held.select(F.col("fp").alias("b"), F.col("members").alias("mb")), "b").select("a", "b", "ma", "mb")
    return both.mapInArrow(tidy(_judged), "a long, b long")


def _thinned(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The distinct pairs that sizes and sketches allow, and how far apart their sketches are for their sizes."""
    x, y = sets.alias("x"), sets.alias("y")
    both = pairs.distinct().join(x, F.col("a") == F.col("x.fp")).join(y, F.col("b") == F.col("y.fp")).filter(_near("x", "y"))
    return both.select("a", "b", (_apart("x", "y") / (F.col("x.n") + F.col("y.n"))).alias("gap"))


def _across(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """The pairs (a, b) whose components differ."""
    of_a, of_b = label.select(F.col("node").alias("a"), F.col("component").alias("ca")), label.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    return pairs.join(of_a, "a", "left").join(of_b, "b", "left").filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _in_components(shared: DataFrame, label: DataFrame) -> DataFrame:
    """(part, fp, comp) of the parts whose sets are in different components."""
    named = shared.join(label, F.col("fp") == F.col("node"), "left").select("part", "fp", F.coalesce("component", "fp").alias("comp"))
    mixed = named.groupBy("part").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("part")
    return named.join(mixed, "part")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that with the least id, then the least hash of its text, then of all its columns. Rows without words stay, but for repeated ones."""
    key = row_key(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))
    named = docs.select(F.struct(F.col(id_col).alias("i"), key.alias("k")).alias("row"), F.col(text_col).alias("text"))
    found = jaccard_components(named, "row", "text")
    [stay] = free_names(docs, "stay_key")
    stays = found.filter((F.col("n_shingles") == 0) | (F.col("row") == F.col("component_id"))).select(F.col("row.k").alias(stay)).distinct()
    mine, number = free_names(docs, "row_key", "row_number")
    rows = docs.withColumn(mine, key).join(stays, F.col(mine) == F.col(stay), "left_semi")
    first = Window.partitionBy(mine).orderBy(all_of(docs))
    return rows.withColumn(number, F.row_number().over(first)).filter(F.col(number) == 1).select(*docs.columns)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, n_shingles, fp (the set's name, null if empty) and component_id.

    component_id is the least id reachable by links, the row's own included.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    bound_batches(spark)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind, id_type = dict(texts.dtypes)["id"], to_arrow_type(texts.schema["id"].dataType)
    every = materialize(texts.mapInArrow(tidy(_thin(id_type)), f"id {kind}, n long, fp long, sketch array<long>, common boolean"), "parity-thin")
    thin = every.filter("not common")
    sets = thin.filter("n > 0").groupBy("fp").agg(F.min("id").alias("id"), F.min("n").alias("n"), F.min("sketch").alias("sketch"))
    common = every.filter("common").groupBy("fp").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "fp").limit(MOST_COMMON).collect()
    few = spark.sparkContext.broadcast(np.sort(np.array([r.fp for r in common], dtype=np.int64).view(np.uint64)))

    def keyed(batches):
        return _keyed(few.value)(batches)

    in_part = Window.partitionBy("part").orderBy("fp")
    rows = texts.select("text").mapInArrow(tidy(keyed), "part long, fp long, kind byte")
    rows = rows.select("part", "fp", "kind", F.first("fp").over(in_part.rowsBetween(Window.unboundedPreceding, 0)).alias("head"), F.lag("fp").over(in_part).alias("before"), F.lead("fp").over(in_part).alias("after"))
    found = materialize(rows.filter("(after is null and head <> fp) or after <> fp"), "parity-parts")  # the last of each set, where a part has two
    small = found.filter(F.col("kind") == WHOLE).select("part", F.col("fp").alias("a")).join(found.filter(F.col("kind") == LACKING).select("part", F.col("fp").alias("b")), "part").select("a", "b")
    found = found.filter(F.col("kind") == PART)
    shared = found.select("part", "fp")
    pairs = found.select("fp", F.explode(F.array_distinct(F.array("head", "before"))).alias("a")).filter("a < fp").select("a", F.col("fp").alias("b"))
    near = materialize(_thinned(pairs, sets), "parity-pairs")
    names = near.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    held = materialize(_sets_of(names, texts), "parity-sets")

    tried = near.groupBy("b").agg(F.min(F.struct("gap", "a"))["a"].alias("a")).select("a", "b")
    tried = materialize(tried, "parity-tried")
    links = materialize(_verify(tried, held).unionByName(small), "parity-links")
    label = connected_components(links, "a", "b")

    mixed = _in_components(shared, label).join(names, "fp", "left_semi")
    order = Window.partitionBy("part").orderBy(F.xxhash64("fp", F.lit(1)), "fp")
    bridges = mixed.select("comp", "fp", F.lag("comp").over(order).alias("other"), F.lag("fp").over(order).alias("before")).filter("comp <> other")
    bridges = _thinned(bridges.select(F.least("before", "fp").alias("a"), F.greatest("before", "fp").alias("b")), sets).select("a", "b")
    new = _across(near.select("a", "b"), label).unionByName(bridges).distinct().join(tried, ["a", "b"], "left_anti")
    new = materialize(new, "parity-tried")
    more = materialize(_verify(new, held), "parity-links")
    links, tried = links.unionByName(more), tried.unionByName(new)
    if not more.isEmpty():
        label = connected_components(links, "a", "b")

    rest = materialize(_in_components(shared, label).join(sets.select("fp", "n", "sketch"), "fp"), "parity-mixed")
    meet = (F.col("x.part") == F.col("y.part")) & (F.col("x.fp") < F.col("y.fp")) & (F.col("x.comp") != F.col("y.comp"))
    new = rest.alias("x").join(rest.alias("y"), meet & _near("x", "y")).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).distinct()
    new = materialize(new.join(tried, ["a", "b"], "left_anti"), "parity-tried")
    missing = new.select(F.explode(F.array("a", "b")).alias("fp")).distinct().join(names, "fp", "left_anti")
    if not missing.isEmpty():
        held = held.unionByName(materialize(_sets_of(missing, texts), "parity-sets"))
    more = materialize(_verify(new, held), "parity-links")
    if not more.isEmpty():
        label = connected_components(links.unionByName(more), "a", "b")

    classes = sets.select("fp", "id").join(label, F.col("fp") == F.col("node"), "left").select("fp", "id", F.coalesce("component", "fp").alias("comp"))
    least = classes.groupBy("comp").agg(F.min("id").alias("component_id"))
    of_set = classes.join(least, "comp").select(F.col("fp").alias("set_fp"), "component_id")
    return thin.join(of_set, F.col("fp") == F.col("set_fp"), "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "fp", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
