"""Sharding by fixed virtual slots.

Records and their copies hash into a fixed number of virtual slots.  Bytes and rows are summed
per slot, and a versioned table maps slots to shards.  Rebalancing edits that
table: it moves whole slots, records never hash anew.

The law kept is ``bytes``: shard sizes near equal.  With thousands of slots
for a few shards, giving the largest slots first to the lightest shard leaves
differences of about one slot.

Defined results: a null text has no bytes (size 1, checksum 0); a slot follows
from id, size, checksum and, among rows equal in these, a copy number, so
that neither rows of one id nor copies of one text gather in a slot; an empty
table gives no rows and a map with every slot on a shard;
other columns are not looked at.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import shared_folder

SLOTS = 1 << 14
#: Copies of one row that are made in one piece.
COPIES = 4096

MAP_SCHEMA = T.StructType(
    [
        T.StructField("version", T.IntegerType(), False),
        T.StructField("virtual_slot", T.IntegerType(), False),
        T.StructField("shard", T.IntegerType(), False),
        T.StructField("bytes", T.LongType(), False),
        T.StructField("rows", T.LongType(), False),
        T.StructField("first_slot", T.LongType(), False),
    ]
)


def with_slots(docs: DataFrame, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32 and virtual slot of every row; the text itself is dropped.

    Rows equal in id, size and checksum are the same row here.  They are counted
    and made again with numbers, which the hash takes in: copies spread over all
    slots, and a second evaluation gives the same rows.  Counts above ``COPIES``
    are first dealt out in pieces of that many.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    size, crc = (F.octet_length(text) + 1).cast("long"), F.crc32(text.cast("binary")).cast("long")
    key = [id_col, "size", "text_crc32"]
    counted = docs.select(F.col(id_col), size.alias("size"), crc.alias("text_crc32")).groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    few = counted.where(F.col("_n") <= COPIES).select(*key, F.lit(0).cast("long").alias("_from"), F.col("_n").alias("_to"))
    pieces = counted.where(F.col("_n") > COPIES).select(*key, "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(COPIES).cast("long"))).alias("_from"))
    # a given number, as small rows that become many must not be put together
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = pieces.repartition(parts, *key, "_from").select(*key, "_from", F.least("_n", F.col("_from") + COPIES).alias("_to"))
    rows = few.unionByName(many).select(*key, F.explode(F.sequence("_from", F.col("_to") - 1)).alias("_copy"))
    return rows.select(*key, F.pmod(F.xxhash64(*key, "_copy"), F.lit(slots)).cast("int").alias("virtual_slot"))


def slot_totals(slotted: DataFrame) -> DataFrame:
    """Bytes and rows by virtual slot; at most one row per slot, whatever the input."""
    return slotted.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def assign(totals: dict[int, tuple[int, int]], shards: int, slots: int = SLOTS) -> list[int]:
    """A first map: slots by falling bytes, each to the shard with the fewest bytes (ties: lower shard)."""
    heap = [(0, 0, s) for s in range(shards)]
    out = [0] * slots
    for slot in sorted(range(slots), key=lambda k: (-totals.get(k, (0, 0))[0], k)):
        held, n, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (held + totals.get(slot, (0, 0))[0], n + 1, shard))
    return out


def rebalance(mapping: list[int], totals: dict[int, tuple[int, int]], shards: int, tolerance: float = 0.01) -> list[int]:
    """An edited map: moves slots off shards over the mean, or off retired shards, and leaves the others.

    New shards (numbers not in the map before) fill up the same way.  Stops when
    the heaviest shard is within ``tolerance`` of the mean or no move helps.
    """
    out, held = list(mapping), [0] * shards
    members: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    homeless = []
    for slot, shard in enumerate(out):
        size = totals.get(slot, (0, 0))[0]
        if shard >= shards:
            homeless.append((size, slot))
        else:
            held[shard] += size
            members[shard].append((size, slot))
    mean = (sum(held) + sum(s for s, _ in homeless)) / shards
    for size, slot in sorted(homeless, reverse=True):
        to = min(range(shards), key=lambda s: (held[s], s))
        out[slot], held[to] = to, held[to] + size
        members[to].append((size, slot))
    for m in members:
        m.sort()
    for _ in range(len(out)):
        high = max(range(shards), key=lambda s: (held[s], -s))
        low = min(range(shards), key=lambda s: (held[s], s))
        room = min(held[high] - mean, mean - held[low])
        if held[high] <= mean * (1 + tolerance) or room <= 0:
            break
        fits = [x for x in members[high] if 0 < x[0] <= max(room, 1)]
        if not fits:
            smallest = next((x for x in members[high] if x[0] > 0), None)
            if smallest is None or held[low] + smallest[0] >= held[high]:
                break
            fits = [smallest]
        size, slot = fits[-1]
        members[high].remove((size, slot))
        members[low].append((size, slot))
        members[low].sort()
        out[slot], held[high], held[low] = low, held[high] - size, held[low] + size
    return out


def save_map(spark: SparkSession, path: str, version: int, mapping: list[int], totals: dict[int, tuple[int, int]]) -> DataFrame:
    """Writes one version of the map to the table at ``path`` and returns it; a version that exists is an error.

    ``first_slot`` is where a virtual slot's rows begin among its shard's rows.
    The table has one row per slot and version, so its size is fixed by ``SLOTS``.
    """
    begins: dict[int, int] = {}
    rows = []
    for slot, shard in enumerate(mapping):
        size, n = totals.get(slot, (0, 0))
        rows.append((version, slot, shard, int(size), int(n), begins.get(shard, 0)))
        begins[shard] = begins.get(shard, 0) + n
    # its own folder, so that of two writers of a version one fails and rows never double
    spark.createDataFrame(rows, MAP_SCHEMA).drop("version").coalesce(1).write.mode("error").parquet(f"{path}/version={version}")
    return load_map(spark, path, version)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of the map, the newest unless told otherwise."""
    table = spark.read.schema(MAP_SCHEMA).parquet(path)
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    return table.where(F.col("version") == version)


def newest_version(spark: SparkSession, path: str) -> int:
    """The newest version of the map at ``path``; 0 where there is none."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = top.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(top)] if files.exists(top) else []
    return max([0, *(int(n.removeprefix("version=")) for n in names if n.startswith("version="))])


def collected_totals(slotted: DataFrame) -> dict[int, tuple[int, int]]:
    """Totals on the driver: at most one small row for each virtual slot."""
    return {r.virtual_slot: (r.bytes, r.rows) for r in slot_totals(slotted).collect()}


def place(slotted: DataFrame, slot_map: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Adds shard and slot (the row's gapless position in its shard) to slotted rows.

    The map has one row per virtual slot, a bound that data cannot change, and
    is broadcast.  Positions come from a window over each virtual slot, shifted
    by where that slot begins in its shard, so no task sees a whole shard.
    """
    order = Window.partitionBy("virtual_slot").orderBy(F.col(id_col), "text_crc32", "size")
    found = slotted.join(F.broadcast(slot_map.select("virtual_slot", "shard", "first_slot", "version")), "virtual_slot")
    return found.withColumn("slot", (F.col("first_slot") + F.row_number().over(order) - 1).cast("long"))


def shard_documents(docs: DataFrame, shards: int = 16, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """Puts every row into a shard, writing a first map, as the next version, under ``path``."""
    spark = docs.sparkSession
    path = path or shared_folder(spark) + "/slot_map"
    slotted = with_slots(docs, slots)
    totals = collected_totals(slotted)
    return place(slotted, save_map(spark, path, newest_version(spark, path) + 1, assign(totals, shards, slots), totals))


def rebalance_documents(docs: DataFrame, path: str, shards: int, slots: int = SLOTS, tolerance: float = 0.01) -> DataFrame:
    """Puts every row into a shard by the newest map under ``path``, edited for new sizes or another number of shards.

    Only slots that must move do; the edited map is the next version.
    """
    spark = docs.sparkSession
    version = newest_version(spark, path)
    if not version:
        raise ValueError(f"no slot map at {path}")
    # one row per virtual slot
    mapping = [r.shard for r in load_map(spark, path, version).orderBy("virtual_slot").collect()]
    slotted = with_slots(docs, slots)
    totals = collected_totals(slotted)
    return place(slotted, save_map(spark, path, version + 1, rebalance(mapping, totals, shards, tolerance), totals))


def op3_shard_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15 under the law ``bytes``."""
    placed = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        F.col("version").alias("map_version"),
    )
