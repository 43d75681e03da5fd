"""MinHash near-duplicates by a multi-index Hamming join.

1. Sketch: a document's set of 5-word shingles (64-bit hashes), a fingerprint of the set, and a signature of
   ``SYMBOLS`` b-bit minhashes (b = 32). Equal sets collapse to their least doc_id.
2. Pigeonhole: the threshold sets a signature distance, and that the number of chunks the signature is cut into
   (17 and 9 at 85). Two signatures within the distance agree on some chunk but for at most 1 symbol. The allowed errors are enumerated by
   masking each symbol of a chunk in turn, so such a pair shares one of 40 keys for certain.
3. A key's rows are tied to the key's least id, never to one another; the ties' components are families. Every
   pair within the signature distance lies inside one family.
4. A family of more than ``BLOCK`` documents is cut into the components of its signature-distance graph, by
   pairs of blocks of signatures. Then it is dealt to blocks of ``BLOCK`` documents. A task builds a block's full
   sets, intersects all of them and those of a few pivots, and returns a spanning forest of the confirmed links.
   Documents outside the family's largest class so far are compared with all others, by pairs of blocks.
5. The links' components give each document its class.

At Jaccard J a symbol differs with probability 1 - J. The distance is the least at which a pair at the threshold is
beyond it with a chance of ``MISS`` at most, whatever the threshold; larger groups are tied by many pairs. So step 2 loses no link in practice,
and step 4 admits none that the full sets don't confirm.

Defined cases: a null or empty text has no shingles, is linked with nothing and is kept; rows with fewer than five
words have one shingle; rows with one doc_id are one document of the graph; a null doc_id is its own class (null)
and kept; an empty table gives an empty result; other columns are dropped. ``deduplicate`` goes by rows of equal
doc_id and text instead, so rows that share a doc_id but no text lose none but near copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textward.llm.common import bound_batches, fresh, join_keys, materialise, texts, trim, trimmed
from textward.llm.graph import components
from textward.llm.hashing import WordHash, mix, shingles

SYMBOLS = 40
#: The chance at most that a pair exactly at the threshold has signatures farther apart than the distance.
MISS = 1e-5
#: Documents of a block; a task holds two blocks.
BLOCK = 256
#: Signatures of a block (160 bytes each), by which large families are cut first.
SIGN_BLOCK = 4096
#: Members of a large family that every block of it is compared with.
PIVOTS = 8
#: Rows that may be broadcast (40 bytes each at most), of family members to pick their texts, of copies to drop them; beyond, a shuffled join does.
BROADCAST_IDS = 500_000
#: Shingles that are intersected at once.
COLUMNS = 1 << 14


def miss(percent: int, distance: int) -> float:
    """The chance that more than ``distance`` symbols differ at a similarity of ``percent``."""
    p = 1 - percent / 100
    return sum(comb(SYMBOLS, k) * p**k * (1 - p) ** (SYMBOLS - k) for k in range(distance + 1, SYMBOLS + 1))


def distance_of(percent: int) -> int:
    """The least signature distance that misses a pair at ``percent`` with a chance of ``MISS`` at most."""
    return next(d for d in range(SYMBOLS + 1) if miss(percent, d) <= MISS)


def chunks_of(distance: int) -> int:
    """So many chunks that one of them has one differing symbol at most."""
    return distance // 2 + 1


DISTANCE = distance_of(85)
CHUNKS = chunks_of(DISTANCE)

_SEEDS = mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
SKETCH = "doc_id long, n_shingles long, fingerprint binary, signature binary"


def signature(s: np.ndarray) -> np.ndarray:
    """The ``SYMBOLS`` minhashes of a set, 32 bits each."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(s), 4096):
        least = np.minimum(least, (s[k : k + 4096, None] * _SEEDS).min(0))
    return (mix(least) >> np.uint64(32)).astype(np.uint32)


def chunks(n: int = CHUNKS) -> list[np.ndarray]:
    return np.array_split(np.arange(SYMBOLS), n)


def keys(signatures: np.ndarray, n: int = CHUNKS) -> np.ndarray:
    """A column for each chunk and masked symbol: 64-bit keys of the other symbols."""
    out = []
    wide = signatures.astype(np.uint64)
    for c in chunks(n):
        for masked in c:
            key = np.full(len(wide), int(masked) + 1, np.uint64)
            for k in c:
                if k != masked:
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + wide[:, k])
            out.append(key)
    return np.stack(out, 1) if len(wide) else np.zeros((0, SYMBOLS), np.uint64)


def sketch(docs: DataFrame, k: int = 5) -> DataFrame:
    """doc_id, n_shingles, fingerprint and signature (null without shingles) of every whole text."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHash()
        for batch in trimmed(batches):
            sets = [shingles(t, memo, k) for t in batch.column("text").to_pylist()]
            marks = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            signs = [signature(s).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(marks, pa.binary()), pa.array(signs, pa.binary())],
                names=["doc_id", "n_shingles", "fingerprint", "signature"],
            )

    return texts(docs).mapInArrow(run, SKETCH)


def _exploded(reps: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signs = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(-1, SYMBOLS)
            flat = keys(signs, n).view(np.int64)
            ids = np.repeat(batch.column("id").to_numpy(zero_copy_only=False), SYMBOLS)
            yield pa.RecordBatch.from_arrays([pa.array(flat.ravel(), pa.int64()), pa.array(ids, pa.int64())], names=["key", "id"])

    return reps.select("id", "signature").mapInArrow(run, "key long, id long")


def ties(reps: DataFrame, n: int = CHUNKS) -> DataFrame:
    """(a, b): each id and the least id that shares a key with it."""
    exploded = materialise(_exploded(reps, n), "keys")
    hubs = materialise(exploded.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("n")).where("n > 1"), "hubs")
    return join_keys(exploded, hubs, ["key"]).where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()


def confirmed(sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links with 100 * intersection >= percent * union; between the sides if there are two."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(n), size)
    values, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    common = np.zeros((n, n), np.int64)
    shared = np.flatnonzero(count > 1)
    place = np.full(len(values), -1, np.int64)
    place[shared] = np.arange(len(shared))
    where = place[column]
    for k in range(0, len(shared), COLUMNS):
        part = (where >= k) & (where < k + COLUMNS)
        x = np.zeros((n, min(COLUMNS, len(shared) - k)), np.float32)
        x[owner[part], where[part] - k] = 1
        common += (x @ x.T).astype(np.int64)
    linked = (100 * common >= percent * (size[:, None] + size[None, :] - common)) & (size[:, None] > 0)
    if side.any() and not side.all():
        linked &= side[:, None] != side[None, :]
    root = np.arange(n)
    out = []
    for i, j in zip(*np.nonzero(np.triu(linked, 1)), strict=True):
        if root[i] != root[j]:
            root[root == root[j]] = root[i]
            out.append((int(i), int(j)))
    return out


def _forest(signs: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """A spanning forest of the pairs within the signature distance: a search from row to row over those not reached yet."""
    left, out = np.arange(len(signs)), []
    while len(left):
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            i = reached.pop()
            close = (signs[left] != signs[i]).sum(1) <= distance
            out += [(int(i), int(j)) for j in left[close]]
            reached += left[close].tolist()
            left = left[~close]
    return out


def _blocks(family: DataFrame, size: int) -> DataFrame:
    """Families of more than ``size`` members: root, blocks."""
    return family.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > size).select("root", F.ceil(F.col("n") / size).cast("int").alias("blocks"))


def _pairs(rows: DataFrame, *columns: str) -> DataFrame:
    """A row for each pair of blocks that a member takes part in: its ``own`` with those from ``low`` to ``high``."""
    paired = rows.select(*columns, "root", "own", F.explode(F.sequence("low", "high")).alias("other"))
    return paired.select(*columns, "root", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).alias("side"))


def refined(reps: DataFrame, family: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """id, root: families of more than ``BLOCK`` members are cut into the components of their signature-distance graph.

    Their signatures are dealt to blocks of ``SIGN_BLOCK`` and each pair of blocks is a task of its own. Members with
    no other within the distance have no links and go; smaller families stay as they are."""
    large = materialise(_blocks(family, BLOCK).select("root"), "large")
    if large.isEmpty():
        return family
    members = family.join(large, "root", "left_semi")
    blocks = F.ceil(F.col("n") / SIGN_BLOCK).cast("int")
    size = members.groupBy("root").agg(F.count("*").alias("n")).select("root", blocks.alias("blocks"))
    dealt = members.join(size, "root").join(reps.select("id", "signature"), "id").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    tasks = _pairs(dealt.withColumns({"low": F.lit(0), "high": F.col("blocks") - 1}), "id", "signature")

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_pylist()
        signs = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint32).reshape(-1, SYMBOLS)
        found = _forest(signs, distance)
        return pa.table({"a": pa.array([ids[i] for i, _ in found], pa.int64()), "b": pa.array([ids[j] for _, j in found], pa.int64())})

    cut = components(tasks.groupBy("root", "lo", "hi").applyInArrow(run, "a long, b long"))
    return materialise(family.join(large, "root", "left_anti").select("id", "root").unionByName(cut.select("id", "root")), "refined")


def _compared(docs: DataFrame, reps: DataFrame, dealt: DataFrame, count: int, percent: int, k: int) -> DataFrame:
    """(a, b): a spanning forest of the confirmed links of each pair of blocks. ``dealt``: id, root, own, low, high (five numbers a row, whatever the family)."""
    dealt = dealt.join(reps.select("id", "doc_id", "fingerprint"), "id")
    few = count <= BROADCAST_IDS
    placed = texts(docs).join(F.broadcast(materialise(dealt, "dealt")) if few else dealt, "doc_id")

    def run(table: pa.Table) -> pa.Table:
        memo = WordHash()
        sets = [shingles(t, memo, k) for t in table.column("text").to_pylist()]
        # the doc_id may have other rows as well, and equal ones
        seen: dict[int, int] = {}
        for n, (i, mark, s) in enumerate(zip(table.column("id").to_pylist(), table.column("fingerprint").to_pylist(), sets, strict=True)):
            if len(s) and xxhash.xxh3_128_digest(s.tobytes()) == mark:
                seen.setdefault(i, n)
        ids, at = list(seen), list(seen.values())
        side = np.array(table.column("side").to_pylist(), bool)[at]
        found = [(ids[i], ids[j]) for i, j in confirmed([sets[n] for n in at], side, percent)]
        del sets, memo
        trim()
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return _pairs(placed, "id", "text", "fingerprint").groupBy("root", "lo", "hi").applyInArrow(run, "a long, b long")


def links(docs: DataFrame, reps: DataFrame, family: DataFrame, percent: int, k: int = 5) -> DataFrame:
    """(a, b): confirmed links that span each family's classes. ``family``: id, root.

    First each block is compared within itself and with the family's ``PIVOTS``. In families of several blocks that
    don't come together by that, the members outside the largest class so far are then compared with all others;
    members of the largest class are linked already and need no pairs among themselves."""
    large = materialise(_blocks(family, BLOCK), "large")
    dealt = family.join(large, "root", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    pivots = family.join(large, "root").groupBy("root", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(PIVOTS))).agg(F.min("id").alias("id")).select("id", F.lit(True).alias("pivot"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    # a block's task is keyed by (own, own): a pivot takes the number of the block that it visits
    first = dealt.join(pivots, "id", "left").withColumn("own", F.explode(F.when(F.col("pivot"), every).otherwise(F.array("own")))).withColumns({"low": F.col("own"), "high": F.col("own")})
    count = family.count()
    begun = materialise(_compared(docs, reps, first.select("id", "root", "own", "low", "high"), count, percent, k), "links")
    if large.isEmpty():
        return begun
    so_far = components(begun).withColumnRenamed("root", "class")
    held = family.join(large.select("root"), "root", "left_semi").join(so_far, "id", "left").select("id", "root", F.coalesce("class", "id").alias("class"))
    held = materialise(held, "held")
    sizes = held.groupBy("root", "class").agg(F.count("*").alias("n"))
    top = sizes.groupBy("root").agg(F.max(F.struct("n", "class")).alias("top"), F.sum("n").alias("n")).where("n > top.n")
    of = lambda n: F.ceil(n / BLOCK).cast("int")
    apart = materialise(top.select("root", F.col("top.class").alias("main"), of(F.col("top.n")).alias("inner"), of(F.col("n") - F.col("top.n")).alias("outer")), "apart")
    if apart.isEmpty():
        return begun
    rest = held.join(apart, "root").withColumn("in", F.col("class") == F.col("main"))
    own = F.when(F.col("in"), F.pmod(F.xxhash64("id"), F.col("inner"))).otherwise(F.col("inner") + F.pmod(F.xxhash64("id"), F.col("outer"))).cast("int")
    second = rest.select("id", "root", own.alias("own"), F.when(F.col("in"), F.col("inner")).otherwise(F.lit(0)).alias("low"), (F.col("inner") + F.col("outer") - 1).alias("high"))
    return begun.unionByName(_compared(docs, reps, second, count, percent, k))


def _grouped(docs: DataFrame, percent: int, k: int) -> tuple[DataFrame, DataFrame, bool]:
    """The sketch of ``docs``; for each fingerprint its class's least doc_id (and the set of that, where sets share a
    doc_id) and its n rows; and whether sets share a doc_id.

    A set's node is its least doc_id; of several sets with that doc_id the least, and a hash of themselves for the others."""
    bound_batches(docs.sparkSession)
    drawn = materialise(sketch(docs, k), "sketch")
    equal = drawn.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("fingerprint")
    reps = materialise(equal.agg(F.min("doc_id").alias("doc_id"), F.first("signature").alias("signature"), F.count("*").alias("n")), "reps")
    shared = materialise(reps.groupBy("doc_id").agg(F.min("fingerprint").alias("least"), F.count("*").alias("sets")).where("sets > 1").drop("sets"), "shared")
    twins = not shared.isEmpty()
    if not twins:
        reps = reps.withColumn("id", F.col("doc_id"))
    else:
        own = F.col("least").isNull() | (F.col("least") == F.col("fingerprint"))
        reps = materialise(reps.join(shared, "doc_id", "left").withColumn("id", F.when(own, F.col("doc_id")).otherwise(F.xxhash64("fingerprint"))).drop("least"), "reps")
    distance = distance_of(percent)
    family = refined(reps, materialise(components(ties(reps, chunks_of(distance))), "families"), distance)
    root = components(links(docs, reps, family, percent, k))
    of = reps.select("fingerprint", "doc_id", "n", "id").join(root, "id", "left").withColumn("root", F.coalesce("root", "id"))
    if not twins:  # a node is a doc_id
        return drawn, materialise(of.select("fingerprint", F.col("root").alias("top"), F.lit(None).cast("binary").alias("top_set"), "n"), "classes"), False
    of = materialise(of, "classes")
    tops = of.groupBy("root").agg(F.min(F.struct("doc_id", "fingerprint")).alias("t"), F.count("*").alias("n"))
    named = join_keys(of.select("root", "fingerprint", F.col("n").alias("rows")), materialise(tops, "tops"), ["root"])
    return drawn, materialise(named.select("fingerprint", F.col("t.doc_id").alias("top"), F.col("t.fingerprint").alias("top_set"), F.col("rows").alias("n")), "named"), True


def classes(docs: DataFrame, percent: int = 85, k: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable by links), kept (it is its own class's)."""
    drawn, of, _ = _grouped(docs, percent, k)
    linked = F.expr("n_shingles > 0 AND doc_id IS NOT NULL")
    some = join_keys(drawn.where(linked).select("fingerprint", "doc_id", "n_shingles"), of.drop("top_set"), ["fingerprint"]).select("doc_id", "n_shingles", F.col("top").alias("component_id"))
    out = some.unionByName(drawn.where(~linked).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _dropped(docs: DataFrame, ids: DataFrame, few: bool, how: str = "left_anti") -> DataFrame:
    """``docs`` without the rows of these doc_ids (or with ``left_semi`` only those); the column's own name and kind stay."""
    name = fresh("id", docs.columns)
    ids = ids.select(F.col("doc_id").alias(name))
    return docs.join(F.broadcast(ids) if few else ids, F.col("doc_id").cast("long") == F.col(name), how)


def deduplicate(docs: DataFrame, percent: int = 80, k: int = 5) -> DataFrame:
    """``docs`` with one row of each class; all columns stay.

    The row of a class with the least doc_id stays, of several sets with that doc_id the least by fingerprint, of rows
    with equal doc_id and set any one. Rows without words or doc_id stay.
    """
    drawn, of, twins = _grouped(docs, percent, k)
    rows = drawn.where("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "fingerprint")
    first = (F.col("doc_id") == F.col("top")) & (F.col("fingerprint") == F.col("top_set") if twins else F.lit(True))
    judged = join_keys(rows, of, ["fingerprint"]).select("doc_id", first.alias("stays"))
    ids = materialise(judged.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("stays").alias("stays")), "judged")
    gone, again = ids.where("NOT stays").select("doc_id"), ids.where("stays AND n > 1").select("doc_id")
    # the texts stay where they are while the list of ids is small enough to be broadcast; beyond, both sides are shuffled
    n, more = ids.agg(F.count_if(~F.col("stays")), F.count_if(F.expr("stays AND n > 1"))).first()
    left = _dropped(docs, gone, n <= BROADCAST_IDS)
    if not more:
        return left
    # a doc_id with several rows, one of which stays: they are told apart by their sets
    mark, columns = fresh("mark", docs.columns), docs.columns
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHash()
        for batch in trimmed(batches):
            sets = [shingles(t, memo, k) for t in batch.column(len(columns)).to_pylist()]
            marks = pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(columns))), marks], names=[*columns, mark])

    several = _dropped(docs, again, more <= BROADCAST_IDS, "left_semi").withColumn(mark, body).mapInArrow(run, type(docs.schema)([*docs.schema.fields]).add(mark, "binary"))
    a, b = fresh("id", [*columns, mark]), fresh("set", [*columns, mark])
    tops = of.select(F.col("top").alias(a), F.col("top_set").alias(b)).distinct().join(again.withColumnRenamed("doc_id", a), a, "left_semi")
    same = (F.col("doc_id").cast("long") == F.col(a)) & (F.col(mark) == F.col(b) if twins else F.lit(True))
    one = several.where(F.col(mark).isNotNull()).join(tops, same, "left_semi").dropDuplicates(["doc_id", mark])
    alone = _dropped(left, again, more <= BROADCAST_IDS)
    return alone.unionByName(one.select(columns)).unionByName(several.where(F.col(mark).isNull()).select(columns))
