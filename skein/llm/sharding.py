"""Balanced label propagation over documents, in DataFrame functions only.

Documents of equal text are linked; a group is one hyperedge, so a round costs one row per
document and never a pair. A group above 1/32 of all rows is dealt into parts
first, which are seated side by side in as few shards as hold them; so no key has
more than 1/32 of the rows. Every other linked document starts in a shard by hash, in proportion to the
room that is left. In each round a group's most common shard among those with room is found by a partial
aggregate, members elsewhere ask to move there, and the 64 sums of demand between shards set the
quotas: no shard's linked documents may exceed its share. Whole groups move or stay. Rounds end when
no document asks or none may move. Unlinked documents fill the shards up, and exact places follow
from counts per shard and bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import materialize

#: Most rounds; they end before where no document moves any more.
ROUNDS = 12
MOST_BUCKETS = 4096


def _nodes(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select(
        F.monotonically_increasing_id().alias("uid"),
        F.col("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        F.unhex(F.md5(text)).alias("link"),
    )


def _parts(nodes: DataFrame, total: int, shards: int) -> DataFrame:
    """(link, parts, first_seat) of groups of two or more; large ones get parts, seated by running sums."""
    most = max(1, total // (4 * shards))
    sizes = nodes.groupBy("link").count().where("count > 1")
    hot = sizes.where(F.col("count") > most)  # 4 * shards groups at most
    w = Window.orderBy(F.desc("count"), "link").rowsBetween(Window.unboundedPreceding, -1)
    seated = hot.select("link", F.ceil(F.col("count") / most).cast("int").alias("parts"), F.coalesce(F.sum("count").over(w), F.lit(0)).alias("before"), F.col("count").alias("members"))
    return sizes.where(F.col("count") <= most).select("link"), seated


def balanced_label_propagation(docs: DataFrame, shards: int = 8, rounds: int = ROUNDS) -> DataFrame:
    """Put every row into one of ``shards``; counts differ by one at most, linked rows are kept together.

    docs: doc_id, text; other columns are ignored. One row per input row: doc_id, size (UTF-8 bytes of
    the text, null as none, plus 1), text_crc32, shard, slot (gapless from 0 in each shard). Null
    and empty texts are equal texts. Ids may be null or repeat: rows, not ids, are placed.
    An empty table gives no row.
    """
    nodes = materialize(_nodes(docs), "nodes")
    total = nodes.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    cold, hot = _parts(nodes, total, shards)
    share = max(1, total // shards)
    # parts of a large group: a member's part by hash, the part's seat by the group's place in the running sum
    of_hot = nodes.join(F.broadcast(hot), "link").withColumn("part", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int"))
    seat = F.least(F.lit(shards - 1), ((F.col("before") + (F.col("part") + 0.5) * F.col("members") / F.col("parts")) / share).cast("int"))
    fixed = of_hot.select("uid", "doc_id", "size", "text_crc32", "link", "part", seat.alias("shard"))
    fixed = materialize(fixed, "fixed")
    start = _by_room([max(0, q - x) for q, x in zip(quota, _loads(fixed, shards), strict=True)], 1)
    rest = nodes.join(F.broadcast(hot.select("link")), "link", "left_anti")  # so that no key of the next join is large
    moving = rest.join(cold, "link").select("uid", "doc_id", "size", "text_crc32", "link", F.lit(0).alias("part"), start.alias("shard"))
    linked = materialize(fixed.unionByName(moving), "linked-0")
    for k in range(rounds):
        moved = _round(linked, shards, quota, k)
        if moved is None:
            break
        linked = materialize(moved, f"linked-{k + 1}")
    single = nodes.join(linked.select("uid"), "uid", "left_anti")
    load = _loads(linked, shards)
    shard = _by_room([max(0, q - x) for q, x in zip(quota, load, strict=True)], 2)  # unlinked rows go where there is room
    every = linked.select("uid", "doc_id", "size", "text_crc32", "link", "shard", F.lit(0).alias("loose")).unionByName(single.select("uid", "doc_id", "size", "text_crc32", "link", shard.alias("shard"), F.lit(1).alias("loose")))
    return _places(materialize(every, "placed"), total, shards, quota)


def _loads(rows: DataFrame, shards: int) -> list[int]:
    got = {r["shard"]: r["count"] for r in rows.groupBy("shard").count().collect()}  # one row a shard
    return [got.get(s, 0) for s in range(shards)]


def _by_room(free: list[int], seed: int) -> Column:
    """A shard by the row's hash, in proportion to the room of each."""
    room, shard = max(1, sum(free)), F.lit(max(range(len(free)), key=lambda s: free[s]))
    u = F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    for s in reversed(range(len(free))):
        if free[s]:
            shard = F.when(u < sum(free[: s + 1]) / room, F.lit(s)).otherwise(shard)
    return shard


def _round(linked: DataFrame, shards: int, quota: list[int], k: int) -> DataFrame | None:
    """One round of moves within quotas; None: nobody asks to move, or nobody may."""
    load = _loads(linked, shards)
    free = [quota[s] - load[s] for s in range(shards)]
    votes = linked.groupBy("link", "part", "shard").count()
    open_ = F.col("shard").isin([s for s in range(shards) if free[s] > 0])
    favour = F.struct(open_.cast("int").alias("open"), F.col("count"), F.xxhash64("link", "shard"), F.col("shard"))
    goal = votes.groupBy("link", "part").agg(F.max(favour).alias("g"), F.count("*").alias("places"))
    # a group in one place stays, one without a member in a shard with room is given a shard
    given = _by_link([max(0, x) for x in free], k)
    goal = goal.select("link", "part", F.when((F.col("places") == 1) | (F.col("g.open") == 1), F.col("g.shard")).otherwise(given).alias("goal"))
    bin_ = F.pmod(F.xxhash64("link", "part", F.lit(k)), F.lit(1024)).cast("int").alias("bin")
    asked = materialize(linked.join(goal, ["link", "part"]).withColumn("bin", bin_), f"asked-{k}")
    want = [[0] * shards for _ in range(shards)]
    for r in asked.where("shard <> goal").groupBy("shard", "goal").count().collect():  # a row for each two shards
        want[r["shard"]][r["goal"]] = r["count"]
    part = [1.0] * shards  # of the demand for a shard that is granted
    for _ in range(50):
        after = [load[j] + part[j] * sum(want[i][j] for i in range(shards)) - sum(part[i] * want[j][i] for i in range(shards)) for j in range(shards)]
        over = [j for j in range(shards) if after[j] > quota[j] + 1e-9 and part[j] > 0]
        if not over:
            break
        for j in over:
            coming = sum(want[i][j] for i in range(shards))
            part[j] = max(0.0, part[j] - (after[j] - quota[j]) / max(1, coming))
    if not any(want[i][j] and int(part[j] * 1024) for i in range(shards) for j in range(shards)):
        return None
    grant = F.lit(False)
    for j in range(shards):
        grant = grant | ((F.col("goal") == j) & (F.col("bin") < int(part[j] * 1024)))
    return asked.withColumn("shard", F.when(grant, F.col("goal")).otherwise(F.col("shard"))).drop("goal", "bin")


def _by_link(free: list[int], k: int) -> Column:
    """A shard with room by the group's hash."""
    rooms = [s for s, x in enumerate(free) if x] or [0]
    return F.element_at(F.array(*map(F.lit, rooms)), (F.pmod(F.xxhash64("link", "part", F.lit(-1 - k)), F.lit(len(rooms))) + 1).cast("int"))


def _places(rows: DataFrame, total: int, shards: int, quota: list[int]) -> DataFrame:
    """Exact counts and slots. Rows beyond a shard's quota (unlinked ones first) take the free slots of others in order."""
    buckets = max(1, min(MOST_BUCKETS, total // (shards * 50_000) + 1))
    rows = rows.withColumn("bucket", F.col("loose") * buckets + F.pmod(F.xxhash64("uid", F.lit(3)), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("shard", "bucket").count()  # 2 * 4096 rows a shard at most
    w = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("count").over(w), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("uid"))
    placed = rows.withColumn("rank", rank).join(F.broadcast(offsets), ["shard", "bucket"]).withColumn("at", F.col("base") + F.col("rank") - 1)
    load = _loads(rows, shards)
    spill, before = F.lit(None).cast("long"), 0
    limit = F.coalesce(*[F.when(F.col("shard") == s, F.lit(quota[s])) for s in range(shards)])
    for s in range(shards):  # number of the row among all that spill
        spill = F.when((F.col("shard") == s) & (F.col("at") >= quota[s]), F.col("at") - quota[s] + before).otherwise(spill)
        before += max(0, load[s] - quota[s])
    shard, slot, edge = F.col("shard"), F.col("at"), 0
    for s in range(shards):
        hole = max(0, quota[s] - load[s])
        mine = (F.col("spill") >= edge) & (F.col("spill") < edge + hole)
        shard, slot = F.when(mine, F.lit(s)).otherwise(shard), F.when(mine, F.col("spill") - edge + load[s]).otherwise(slot)
        edge += hole
    return placed.withColumn("spill", F.when(F.col("at") >= limit, spill)).select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))
