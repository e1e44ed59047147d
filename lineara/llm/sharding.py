"""Sharding by sampled splitters, in DataFrame functions only.

Method. Every record gets a sort key (hash of its text, then hash of its id); hashes and sizes are computed once and kept as a
slim table in the shared folder. A size-weighted sample of keys gives splitters at equal quantiles of the bytes; they cut the key
space into many fine ranges, and the records are exchanged by range. Running sums inside a range, on top of the exact byte totals of
the ranges before it, give every record its byte offset in the whole corpus, and the shard is that offset scaled to the number of
shards. Sampling noise therefore only changes how even the tasks are, never the shards. A text whose copies hold more than
1 / ``UNITS`` of a shard is heavy (there are at most ``UNITS`` * shards of them, whatever the size of the data); its overfull range is
subdivided by the hash of the id. All other texts are cut on the text's hash only, so that their copies stay together.

Law held: ``bytes``. Equal texts are neighbours in key order; a light group is placed as one unit, so it stays in one shard; a heavy
one is laid out record by record and may continue in the next shard.

Defined results: null text has size 1, the checksum of no bytes, and the key of an empty text; null ids have the key of an empty id
and repeated rows are kept (rows of one key are interchangeable); an empty table gives no rows; extra columns are carried along,
and a column named like a result column is replaced by it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from ..session import shared_dir

#: Mean sampled keys for one range.
OVERSAMPLE = 16
#: A group of equal texts is one unit up to 1 / UNITS of a shard.
UNITS = 64


def _hash(x: Column) -> Column:
    """60 bits of a text's MD5, which SQL can state as well."""
    return F.conv(F.substring(F.md5(x.cast("binary")), 1, 15), 16, 10).cast("long")


def _array(values: list) -> Column:
    """A literal array of numbers, folded once."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")


def _bisect(bounds: list[tuple[int, int]], major: Column, minor: Column) -> Column:
    """Number of bounds at or below (major, minor), by binary search inside one expression."""
    if not bounds:
        return F.lit(0)
    a, b = _array([x[0] for x in bounds]), _array([x[1] for x in bounds])

    def step(at: Column, _: Column) -> Column:
        mid = F.floor((at["lo"] + at["hi"]) / 2).cast("int")
        open_ = at["lo"] < at["hi"]
        below = open_ & ((F.get(a, mid) < major) | ((F.get(a, mid) == major) & (F.get(b, mid) <= minor)))
        return F.struct(F.when(below, mid + 1).otherwise(at["lo"]).alias("lo"), F.when(open_ & ~below, mid).otherwise(at["hi"]).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(len(bounds).bit_length())), start, step, lambda at: at["lo"])


def _laid_out(rows: DataFrame, total: int, n_shards: int, offsets: list[int]) -> DataFrame:
    """Rows (_major, _minor, _heavy, _range, size, ...) with their shard and their rank inside (range, shard)."""
    order = W.partitionBy("_range").orderBy("_major", "_minor", "size")
    run = F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    # Light groups take the offset of their first record.
    at = F.when(F.col("_heavy"), F.col("_run")).otherwise(F.min("_run").over(W.partitionBy("_range", "_major")))
    placed = rows.withColumn("_run", run).withColumn("_at", at + F.get(_array(offsets), F.col("_range")))
    placed = placed.withColumn("shard", F.least(F.lit(n_shards - 1), F.expr(f"_at * {n_shards} div {total}").cast("int")))
    return placed.withColumn("_rank", F.row_number().over(W.partitionBy("_range", "shard").orderBy("_major", "_minor", "size")).cast("long") - 1)


def assign_shards(df: DataFrame, n_shards: int = 16, *, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None, seed: int = 7) -> DataFrame:
    """``df`` with ``size``, ``shard`` and ``slot``; see the module for the method and the law.

    ``ranges`` is the number of fine ranges, by default the session's shuffle partitions. The driver sees OVERSAMPLE * ranges
    sampled keys, the ranges' totals and the heavy texts' hashes, and nothing that grows with the rows.
    """
    spark = df.sparkSession
    ranges = ranges or max(n_shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    text, ident = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    size = F.octet_length(text).cast("long") + 1
    rows = df.drop("size", "shard", "slot").select("*", size.alias("size"), _hash(text).alias("_major"), _hash(ident).alias("_minor"))
    path = f"{shared_dir(spark)}/shard-keys-{uuid.uuid4().hex}"
    rows.select("_major", "_minor", "size").write.parquet(path)
    keys = spark.read.schema("_major long, _minor long, size long").parquet(path)
    total = keys.agg(F.sum("size")).first()[0]
    if not total:
        return rows.withColumn("shard", F.lit(0)).withColumn("slot", F.lit(0).cast("long")).drop("_major", "_minor")

    unit_most = total // (n_shards * UNITS)
    groups = keys.groupBy("_major").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"))
    heavy = sorted(r[0] for r in groups.where((F.col("b") > unit_most) & (F.col("n") > 1)).select("_major").collect())

    def keyed(d: DataFrame) -> DataFrame:
        """With _heavy, and the part of the key by which ranges are cut."""
        d = d.withColumn("_heavy", F.array_contains(_array(heavy), F.col("_major")) if heavy else F.lit(False))
        return d.withColumn("_cut", F.when(F.col("_heavy"), F.col("_minor")).otherwise(F.lit(-1)))

    # Poisson sample with chance proportional to size: a uniform number from the key, so that reruns draw the same rows.
    uniform = F.pmod(F.xxhash64("_minor", "_major", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    drawn = keyed(keys.where(uniform < F.col("size") * (OVERSAMPLE * ranges / total))).select("_major", "_cut").collect()
    drawn = sorted((r[0], r[1]) for r in drawn)
    bounds = sorted({drawn[i * len(drawn) // ranges] for i in range(1, ranges)}) if drawn else []

    def ranged(d: DataFrame) -> DataFrame:
        return keyed(d).withColumn("_range", _bisect(bounds, F.col("_major"), F.col("_cut")))

    # Exact totals of the ranges; there are `ranges` of them, so the driver may hold them.
    slim = ranged(keys)
    bytes_of = dict(slim.groupBy("_range").agg(F.sum("size")).collect())
    offsets = [0]
    for r in range(len(bounds)):
        offsets.append(offsets[-1] + bytes_of.get(r, 0))
    # Shards ascend with the ranges, so only a range's first shard goes on from earlier ranges, after the rows that these gave it.
    first, carry, held, last = [0] * len(offsets), [0] * len(offsets), {}, -1
    for r, shard, n in sorted(_laid_out(slim, total, n_shards, offsets).groupBy("_range", "shard").agg(F.count(F.lit(1))).collect()):
        if r != last:
            first[r], carry[r], last = shard, held.get(shard, 0), r
        held[shard] = held.get(shard, 0) + n
    placed = _laid_out(ranged(rows), total, n_shards, offsets)
    goes_on = F.when(F.get(_array(first), F.col("_range")) == F.col("shard"), F.get(_array(carry), F.col("_range"))).otherwise(F.lit(0))
    return placed.withColumn("slot", F.col("_rank") + goes_on).drop("_major", "_minor", "_cut", "_range", "_heavy", "_run", "_at", "_rank")


def shard_digest(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """The rows that op7 returns: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    slim = docs.select("doc_id", "text", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    return assign_shards(slim, n_shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
