"""SimHash near-dedup with pigeonring filtering.

Fingerprints are made in scan tasks. Rows with the same fingerprint become one node at once, by a
grouped minimum. Nodes at a small Hamming distance are found by the pigeonring principle: cut the
64 bits into m segments on a ring; if two fingerprints differ in at most t bits, some start exists
from which every chain of l consecutive segments differs in at most l*t/m bits. The leading
segments of a chain, whose budget is below one bit, must then be equal and make a join key; the
next ones, whose budget is below two bits, are halved, and one half must be equal too, which makes
the key longer. The other chain budgets prune the pairs of a key before the full distance decides.

Defined results: words are parted by ASCII white space and A-Z are lower-cased; a text of fewer
words than a shingle is one shingle; a null, empty or blank text has fingerprint zero and links
like any other; null ids come last among the ids of a group; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievegrid.llm.common import all_of, fresh, materialise, named, row_marks, slices, word_parts
from sievegrid.llm.components import connected_components

SHINGLE = 3
DISTANCE = 2
SEED = 42
BITS = 64
#: Shingles whose bits are counted together.
BLOCK = 1 << 16
#: Wide fingerprints, to propose pairs far beyond DISTANCE: lanes of 64 bits, keys, the bits that each samples and the least hashes that stand beside those.
LANES, KEYS, KEY_BITS, KEY_LEAST = 4, 48, 10, 2


def _shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    grams = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    n = len(words) - size + 1
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, n)


def _mixed(hashes: np.ndarray, lane: int) -> np.ndarray:
    """Other 64 bits of each hash (SplitMix64), the hash itself as lane 0."""
    if not lane:
        return hashes
    z = hashes + np.uint64(lane * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return z ^ z >> np.uint64(31)


def fingerprints_of(texts: list[bytes], size: int = SHINGLE, lanes: int = 1) -> np.ndarray:
    """Fingerprints: a bit is set if it is set in over half of a text's shingle hashes. 64 bits, or as many for each lane in a row."""
    votes = np.zeros((len(texts), BITS * lanes), np.int64)
    totals = np.zeros(len(texts), np.int64)
    hashes: list[np.ndarray] = []
    owners: list[int] = []
    held = 0

    def count() -> None:
        if hashes:
            every = np.concatenate(hashes)
            wide = np.stack([_mixed(every, k) for k in range(lanes)], axis=1)
            bits = np.unpackbits(wide.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, BITS * lanes)
            sizes = [len(h) for h in hashes]
            sums = np.add.reduceat(bits, np.cumsum([0, *sizes[:-1]]), axis=0, dtype=np.int64)
            np.add.at(votes, owners, sums)
            np.add.at(totals, owners, sizes)
        hashes.clear(), owners.clear()

    for i, text in enumerate(texts):
        for first, words in word_parts(text.lower(), size - 1):
            if len(words) < size:
                if first or not words:
                    continue
                words = [b" ".join(words)] if size > 1 else words
                own = _shingle_hashes(words, 1)
            else:
                own = _shingle_hashes(words, size)
            hashes.append(own)
            owners.append(i)
            held += len(own)
            if held >= BLOCK:
                count()
                held = 0
    count()
    return np.packbits(votes * 2 > totals[:, None], axis=1, bitorder="little").view("<u8").reshape((-1, lanes) if lanes > 1 else -1)


def wide_prints(texts: list[bytes]) -> np.ndarray:
    """A row of lanes for each text, over its distinct words: what common words weigh would bring unlike texts together."""
    return fingerprints_of([b" ".join(dict.fromkeys(t.lower().split())) for t in texts], 1, LANES)


#: Odd multipliers, each an order of all hashes of its own.
_ORDERS = _mixed(np.arange(KEYS * KEY_LEAST, dtype=np.uint64) + np.uint64(SEED), 1) | np.uint64(1)


def _least(hashes: np.ndarray) -> np.ndarray:
    """The least hash of a set in each of the orders."""
    block = 1 << 12
    return np.min([(_ORDERS[:, None] * hashes[None, at : at + block]).min(axis=1) for at in range(0, len(hashes), block)], axis=0)


def sampled_keys(prints: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Of wide fingerprints (rows of lanes) with their sets of hashes KEYS keys each, as 64-bit hashes: the key's number, the bits that it samples, places fixed once for all, and the set's least hashes in the key's own orders. They propose pairs and may miss one: who needs all adds keys that miss none (``shingle_dedup.part_keys``)."""
    places = np.stack([np.random.RandomState(SEED + k).permutation(prints.shape[1] * BITS)[:KEY_BITS] for k in range(KEYS)])
    bits = np.unpackbits(np.ascontiguousarray(prints).astype("<u8").view(np.uint8).reshape(len(prints), -1), axis=1, bitorder="little")
    read = bits[:, places.ravel()].reshape(len(prints), KEYS, KEY_BITS) @ (1 << np.arange(KEY_BITS, dtype=np.uint64))
    keys = _mixed(read | np.arange(KEYS, dtype=np.uint64) << np.uint64(KEY_BITS), 1)
    least = np.stack([_least(s) for s in sets]).reshape(len(sets), KEYS, KEY_LEAST)
    for k in range(KEY_LEAST):
        keys = _mixed(keys ^ least[:, :, k], 1)
    return keys


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """(id, fp, m1, m2) for every row; fp is the fingerprint as a signed long."""
    kind = df.schema[id_col].dataType.simpleString()
    m1, m2 = row_marks(id_col, text_col)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = fingerprints_of([t or b"" for t in part.column("text").to_pylist()], size)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.view(np.int64)), part.column(1), part.column(2)], names=["id", "fp", "m1", "m2"])

    rows = df.select(named(id_col).alias("id"), m1.alias("m1"), m2.alias("m2"), named(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(read, f"id {kind}, fp long, m1 long, m2 long")


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> BITS - 1 else mask


def ring(distance: int) -> list[dict]:
    """For each start on the ring and each half: the mask of the key, and (mask, budget) of the longer chains."""
    m = 3 * distance + 1
    cuts = [BITS * i // m for i in range(m + 1)]
    segment = [(1 << cuts[i + 1]) - (1 << cuts[i]) for i in range(m)]
    budget = lambda n: n * distance // m
    lead = max(n for n in range(1, m + 1) if budget(n) == 0)
    near = max(n for n in range(1, m + 1) if budget(n) <= 1)
    out = []
    for start in range(m):
        at = [segment[(start + i) % m] for i in range(m)]
        bits = [1 << b for b in range(BITS) if sum(at[lead:near]) >> b & 1]
        chains = [(sum(at[:n]), budget(n)) for n in range(lead + 1, m) if n == m - 1 or budget(n) < budget(n + 1)]
        for half in (sum(bits[: len(bits) // 2]), sum(bits[len(bits) // 2 :])):
            out.append({"key": sum(at[:lead]) | half, "chains": chains})
    return out


def near_links(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints (column fp, each once) at that distance or less; a pair may repeat."""
    if not distance:
        return nodes.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("false")
    plan = ring(distance)
    keys = F.array(*[F.struct(F.lit(i).alias("way"), F.col("fp").bitwiseAND(F.lit(_signed(p["key"]))).alias("bits")) for i, p in enumerate(plan)])
    keyed = nodes.select("fp", F.explode(keys).alias("k")).select("fp", "k.way", "k.bits")
    a, b = keyed.alias("a"), keyed.alias("b")
    differ = F.col("a.fp").bitwiseXOR(F.col("b.fp"))

    def within(step: int) -> Column:
        masks = F.array(*[F.lit(_signed(p["chains"][step][0])) for p in plan])
        return F.bit_count(differ.bitwiseAND(F.element_at(masks, F.col("a.way") + 1))) <= plan[0]["chains"][step][1]

    viable = (F.col("a.fp") < F.col("b.fp")) & (F.col("a.way") == F.col("b.way")) & (F.col("a.bits") == F.col("b.bits"))
    for step in range(len(plan[0]["chains"])):
        viable = viable & within(step)
    viable = viable & (F.bit_count(differ) <= distance)
    return a.join(b, viable).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def near_classes(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """prints (id, fp, ...) with component: the smallest id that links reach."""
    nodes = materialise(prints.groupBy("fp").agg(F.min("id").alias("least")), "fingerprints")
    roots = connected_components(near_links(nodes.select("fp"), distance))
    placed = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("least").alias("component"))
    return prints.join(placed.select("fp", "root").join(named, "root"), "fp")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row per row of df: id, fingerprint (16 hex digits), component_id, and the marks of the row."""
    prints = materialise(fingerprints(df, id_col, text_col, size), "prints")
    classes = near_classes(prints, distance)
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return classes.select(F.col("id").alias(id_col), shown.alias("fingerprint"), F.col("component").alias("component_id"), "root", "m1", "m2")


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """The rows of df with the smallest id of their component (one row of each), with all columns of df."""
    a, b = fresh(df, "m1"), fresh(df, "m2")
    classes = near_duplicates(df, id_col, text_col, size, distance)
    order = F.struct(named(id_col).isNull().alias("n"), named(id_col).alias("i"), F.col("m1").alias("x"), F.col("m2").alias("y"))
    kept = classes.groupBy("root").agg(F.min(order).alias("k")).select(F.col("k.x").alias(a), F.col("k.y").alias(b))
    m1, m2 = row_marks(id_col, text_col)
    stays = df.withColumns({a: m1, b: m2}).join(kept, [a, b], "left_semi")
    # Rows that repeat whole match alike: one of them stays.
    return stays.dropDuplicates([a, b]).select(*all_of(df))
