"""A customer's own lists against public records: capabilities by keyword, institutions by name, private points.

Lists are matched by what texts contain. A keyword and the texts that may contain it meet on one of the
keyword's runs of bytes, so no pair of every text and every keyword is formed at any size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievegrid.functions.text import any_term
from sievegrid.operators.scoring import private_points, relationship_points

# Words too general to be a capability, short words that are one, and words that mean the same.
GENERIC_KEYWORDS = ["医疗", "设备", "医疗设备", "耗材", "服务", "医院", "采购", "项目", "系统", "软件", "产品", "仪器"]
SHORT_KEYWORDS = ["dr", "ct", "mr", "cr", "dsa", "ivd", "pcr", "lis", "his", "mri", "ecg", "icu", "gpu"]
ALIASES = [
    ["dsa", "数字减影血管造影", "数字减影血管造影机", "血管造影机"],
    ["dr", "数字x光机", "数字x线摄影", "数字化x线摄影", "数字化x射线摄影"],
    ["ct", "ct机", "ct影像", "计算机断层扫描", "电子计算机断层扫描"],
    ["mr", "mri", "磁共振", "磁共振成像"],
    ["cr", "计算机x线摄影"],
    ["ivd", "体外诊断", "体外诊断试剂", "检测试剂", "质控品", "校准品"],
    ["pcr", "聚合酶链式反应", "核酸扩增"],
    ["lis", "检验信息系统", "实验室信息系统"],
    ["his", "医院信息系统"],
    ["ecg", "心电图", "心电图机"],
]
_DROPPED = r"[\s\-_—–·,，。；;：:（）()【】\[\]]+"


def normalized(x: Column) -> Column:
    """Lower case without space and the punctuation of names; NULL counts as empty."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(x, F.lit("")))), _DROPPED, "")


def specific_keyword(x: Column) -> Column:
    """The keyword says something of its own: not general, and not too short unless it is a known short one."""
    n = normalized(x)
    long_enough = F.when(n.rlike("^[a-z0-9]+$"), F.length(n) >= 4).otherwise(F.length(n) >= 2)
    return F.when((n == "") | n.isin(GENERIC_KEYWORDS), False).when(n.isin(SHORT_KEYWORDS), True).otherwise(long_enough)


def keyword_terms(x: Column) -> Column:
    """The terms that stand for a keyword: its whole group of the first alias group that has it, or itself; none if it is not specific."""
    n = normalized(x)
    groups = [[F.lit(t) for t in group] for group in ALIASES]
    own = reduce(lambda rest, g: F.when(n.isin([t for t in g[1]]), F.array(*g[0])).otherwise(rest), reversed(list(zip(groups, ALIASES, strict=True))), F.array(n))
    return F.when(specific_keyword(x), own).otherwise(F.array().cast("array<string>"))


#: Bytes of a gram at most, and bits of the table that tells which grams are some word's.
GRAM, TABLE_BITS = 8, 20
#: Bytes of texts looked at in one step, and bytes of texts in one batch that goes on.
STEP_BYTES, OUT_BYTES = 1 << 18, 1 << 22


def _with_grams(df: DataFrame, text: str, sizes: list[int] | None = None, tables: dict[int, bytes] | None = None) -> DataFrame:
    """df once for each distinct run of n bytes of its UTF-8 text, with _n, the run as a number, and its place in the table of n.

    sizes: each n, with those runs only whose bit tables[n] has; by default GRAM, or a shorter text's whole length, and all runs.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("_n", T.IntegerType()), T.StructField("_gram", T.LongType()), T.StructField("_bit", T.LongType())])
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = {n: np.unpackbits(np.frombuffer(t, np.uint8), bitorder="little").view(bool) for n, t in (tables or {}).items()}
        for batch in batches:
            said = pc.fill_null(batch.column(at).cast(pa.large_binary()), b"")
            ends = np.frombuffer(said.buffers()[1], np.int64)[said.offset : said.offset + len(said) + 1]
            start, stop = int(ends[0]), int(ends[-1])
            data = np.frombuffer(said.buffers()[2] or b"", np.uint8)
            size, ends = np.diff(ends), ends - start
            found: list[np.ndarray] = []
            for first in range(0, stop - start, STEP_BYTES):
                there = min(STEP_BYTES, stop - start - first)
                held = np.zeros(there + GRAM, np.uint8)
                some = data[start + first : min(start + first + there + GRAM, stop)]
                held[: len(some)] = some
                eight = np.ndarray((there,), "<u8", held, strides=(1,)).copy()
                rows = None if sizes else np.searchsorted(ends, np.arange(first, first + there), "right") - 1
                for n in sizes or range(1, GRAM + 1):
                    value = eight & np.uint64((1 << 8 * n) - 1)
                    bit = (value * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)
                    place = np.flatnonzero(bits[n][bit]) if sizes else np.flatnonzero(np.minimum(size[rows], GRAM) == n)
                    row = np.searchsorted(ends, place + first, "right") - 1
                    inside = place + first + n <= ends[row + 1]
                    row, place = row[inside], place[inside]
                    found.append(np.stack([row, np.full(len(row), n), value[place].view(np.int64), bit[place].view(np.int64)]))
                # Rows that end here are told; the last one may go on in the next step.
                last = len(size) if first + there == stop - start else np.searchsorted(ends, first + there, "right") - 1
                once = np.concatenate(found, axis=1)
                once = once[:, np.lexsort(once[2::-1])]
                once = once[:, np.append(True, np.any(np.diff(once[:3], axis=1) != 0, axis=0))[: once.shape[1]]]
                cut = np.searchsorted(once[0], last)
                found = [once[:, cut:]]
                yield from taken(batch, once[:, :cut], size)

    def taken(batch: pa.RecordBatch, once: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        part = np.cumsum(size[once[0]]) // OUT_BYTES
        for row, n, gram, bit in np.split(once, np.flatnonzero(np.diff(part)) + 1, axis=1):
            if len(row):
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(row)).columns, pa.array(n, pa.int32()), pa.array(gram), pa.array(bit)], names=schema.names)

    return df.mapInArrow(run, schema)


def containing(texts: DataFrame, text: str, words: DataFrame, word: str) -> DataFrame:
    """texts joined with each row of words whose word the text contains; NULL and empty words match nothing.

    A word is represented by the run of GRAM bytes of it that fewest words share (its whole self if it
    is shorter), which is the join key; the containment itself decides. A text leaves its scan only
    with the runs that some word may have: tables of 2^TABLE_BITS bits, the same at any number of
    words, tell them. Texts are scanned as bytes in Arrow batches, in time linear in them.
    """
    listed = words.where(F.length(word) > 0)
    spread = _with_grams(listed.select(F.col(word).alias("_w")).distinct(), "_w")
    shared = spread.groupBy("_n", "_gram").agg(F.count("*").alias("_many"))
    chosen = spread.join(shared, ["_n", "_gram"]).groupBy("_w").agg(F.min(F.struct("_many", "_n", "_gram", "_bit")).alias("_c")).select("_w", "_c._n", "_c._gram", "_c._bit")
    bits = chosen.select("_n", (F.col("_bit") + 1).alias("b"))
    known = bits.groupBy("_n", F.bitmap_bucket_number("b").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits")).collect()  # GRAM tables at most
    keyed = listed.join(chosen.drop("_bit"), F.col(word) == F.col("_w")).drop("_w")
    if not known:
        return texts.join(keyed.drop("_n", "_gram"), F.lit(False))
    tables = {r._n: bytearray((1 << TABLE_BITS) // 8) for r in known}
    for r in known:
        tables[r._n][(r.part - 1) * len(r.bits) : r.part * len(r.bits)] = r.bits
    own = _with_grams(texts, text, sorted(tables), {n: bytes(t) for n, t in tables.items()})
    met = own.drop("_bit").join(keyed, ["_n", "_gram"]).drop("_n", "_gram")
    return met.where(F.contains(F.col(text), F.col(word)))


def term_found(raw: Column, normal: Column, term: Column) -> Column:
    """The term is in a text: 2 or 3 ASCII letters or digits only where none touch them, anything else anywhere in the normalized text."""
    alone = F.concat(F.lit("(^|[^a-z0-9])\\Q"), term, F.lit("\\E($|[^a-z0-9])"))
    return F.when(term.rlike("^[a-z0-9]{2,3}$"), F.regexp_like(raw, alone)).otherwise(F.contains(normal, term))


def capability_matches(cards: DataFrame, key: str, text: Column, capabilities: DataFrame, owner: list[str], keyword: str, kind: str, updated: str, most: int = 12) -> DataFrame:
    """(key, *owner, keyword, kind, place): capabilities of each owner whose terms a card's text has, newest first, so many at most.

    One row per capability, whichever of its terms matched.
    """
    raw = F.lower(text)
    texts = cards.select(key, raw.alias("_raw"), normalized(raw).alias("_text"))
    own = capabilities.select(*owner, keyword, kind, updated, keyword_terms(F.col(keyword)).alias("_terms")).where(F.size("_terms") > 0).distinct()
    # A card meets groups of terms first, each once, whoever has them; owners come after.
    groups = own.select("_terms").distinct().select("_terms", F.explode("_terms").alias("_term"))
    met = containing(texts, "_text", groups, "_term").where(term_found(F.col("_raw"), F.col("_text"), F.col("_term"))).select(key, "_terms").distinct()
    once = met.join(own, "_terms").drop("_terms")
    from sievegrid.operators.ranking import ranked_within

    return ranked_within(once, [key, *owner], [F.col(updated).desc(), F.col(keyword)], most, "place").drop(updated)


def institution_matches(cards: DataFrame, key: str, name: Column, department: Column, items: DataFrame, owner: list[str], item_name: str, item_department: str, values: list[str]) -> DataFrame:
    """(key, *owner, *values) of items of which name and card's name contain one another, and department likewise if the item has one."""
    a = cards.select(key, normalized(name).alias("_name"), normalized(department).alias("_part")).where("_name != ''")
    b = items.select(*owner, *values, normalized(F.col(item_name)).alias("_item"), normalized(F.col(item_department)).alias("_own")).where("_item != ''")
    columns = [key, *owner, *values, "_name", "_item", "_part", "_own"]
    met = containing(a, "_name", b, "_item").select(*columns).unionByName(containing(b, "_item", a, "_name").where("_name != _item").select(*columns))
    same = (F.col("_own") == "") | ((F.col("_part") != "") & (F.contains("_own", "_part") | F.contains("_part", "_own")))
    return met.where(same).select(key, *owner, *values)


def best_relationships(matches: DataFrame, keys: list[str], strength: str, updated: str) -> DataFrame:
    """The strongest relationship of each key; of equals the newest."""
    best = matches.groupBy(*keys).agg(F.max(F.struct(relationship_points(F.col(strength)).alias("p"), F.col(updated).alias("u"), F.col(strength).alias("s"))).alias("_b"))
    return best.select(*keys, F.col("_b.s").alias(strength))


def private_context(cards: DataFrame, key: str, lease: Column, matches: DataFrame, relations: DataFrame, preferences: DataFrame, owner: list[str], kind: str, strength: str) -> DataFrame:
    """(key, *owner, capability, relationship, flexibility) for every card and owner with a match, a relation or preferences that count."""
    kinds = matches.groupBy(key, *owner).agg(F.array_sort(F.collect_set(kind)).alias("_kinds"))
    both = kinds.join(relations.select(key, *owner, strength), [key, *owner], "full_outer").join(preferences, owner, "left")
    joined = both.join(cards.select(key, lease.alias("_lease")), key)
    points = private_points(F.coalesce("_kinds", F.array().cast("array<string>")), F.col(strength), F.col("_lease"), F.col("can_find_manufacturer"), F.col("can_partner_channel"), F.col("can_handle_lease"))
    return joined.select(key, *owner, points.alias("_p")).select(key, *owner, "_p.*")


def searchable(*parts: Column) -> Column:
    """Texts joined by bars; NULL and empty ones are left out."""
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), " | ")


def broad_terms(x: Column, terms: list[str]) -> Column:
    return F.coalesce(x.rlike(any_term(terms)), F.lit(False))
