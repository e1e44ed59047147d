"""Landed data in the ledger's schemas; schemas are stated, never inferred, and null and '' stay distinct (Parquet and JSON keep both)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

INPUT = "struct<prev_txid:string,prev_index:int,signature_script:binary,compute_budget:int>"
OUTPUT = "struct<value:bigint,spk_version:int,spk_script:binary,covenant:struct<covenant_id:string,authorizing_input:int>>"
TRANSACTION = f"struct<txid:string,version:int,inputs:array<{INPUT}>,outputs:array<{OUTPUT}>,payload:binary>"
BLOCK = f"hash string, daa_score bigint, blue_score bigint, timestamp_ms bigint, parents array<string>, mergeset array<string>, transactions array<{TRANSACTION}>"
STEP = "step bigint, removed array<string>, added array<struct<accepting_block:string,accepted_tx_ids:array<string>>>"
HEADERS = "map<string,array<string>>"
ACCESS_LOG = f"ts double, status int, size bigint, duration double, request struct<method:string,uri:string,headers:{HEADERS},remote_ip:string,client_ip:string>"
ZERO_TXID = "0" * 64


def blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCK).parquet(path)


def from_node(rows: DataFrame) -> DataFrame:
    """Blocks as a node gives them, with the blues before the reds as the merge set."""
    return rows.withColumn("mergeset", F.concat(F.coalesce("mergeset_blues", F.array()), F.coalesce("mergeset_reds", F.array()))).drop("mergeset_blues", "mergeset_reds")


def mempool(rows: DataFrame) -> DataFrame:
    """Pending transactions; those without an id are left out."""
    return rows.where((F.col("txid") != ZERO_TXID) & F.col("txid").isNotNull())


def accepted(steps: DataFrame) -> DataFrame:
    """One row for each accepted transaction of the added blocks: step, order, accepting_block, tx_index, txid."""
    added = steps.select("step", F.posexplode("added").alias("order", "b"))
    return added.select("step", "order", F.col("b.accepting_block"), F.posexplode("b.accepted_tx_ids").alias("tx_index", "txid"))


def transactions(block: DataFrame) -> DataFrame:
    return block.select(F.col("hash").alias("block"), F.explode("transactions").alias("tx"))


def resolved(accepted_rows: DataFrame, block: DataFrame) -> DataFrame:
    """Accepted ids with their bodies, from the accepting block or its merge set; ``tx`` is null where the body isn't there."""
    own = block.select(F.col("hash").alias("accepting_block"), F.explode(F.array_union(F.array("hash"), F.coalesce("mergeset", F.array()))).alias("block"))
    bodies = own.join(transactions(block), "block").select("accepting_block", F.col("tx.txid").alias("txid"), "tx").dropDuplicates(["accepting_block", "txid"])
    return accepted_rows.join(bodies, ["accepting_block", "txid"], "left")


def sightings(block: DataFrame) -> DataFrame:
    """Outputs of a block that are bound to a covenant, with the outpoint that authorizes them."""
    out = transactions(block).select("block", "tx", F.posexplode("tx.outputs").alias("output_index", "o")).where("o.covenant is not null")
    spent = F.get(F.col("tx.inputs"), F.col("o.covenant.authorizing_input"))
    return out.select("block", F.col("tx.txid").alias("txid"), "output_index", F.col("o.covenant.covenant_id").alias("covenant_id"), F.col("o.value").alias("value"), spent["prev_txid"].alias("auth_txid"), spent["prev_index"].alias("auth_index"))


def access_log(spark: SparkSession, paths: str | list[str], cutoff: float | None = None, modified_after: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of newline-delimited JSON logs, plain or gzip, and one row of hygiene counts: good, malformed and older than the cutoff.

    ``modified_after`` prunes whole files by their time, as 2024-01-31T00:00:00.
    """
    reader = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad")
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    raw = reader.schema(f"{ACCESS_LOG}, _bad string").json(paths)
    rows = raw.withColumn("_old", F.coalesce(F.col("ts") < F.lit(cutoff), F.lit(False)) if cutoff is not None else F.lit(False))
    good = F.col("_bad").isNull() & ~F.col("_old")
    counts = rows.select("_bad", "_old").agg(F.count_if(good).alias("total"), F.count_if(F.col("_bad").isNotNull()).alias("malformed"), F.count_if(F.col("_bad").isNull() & F.col("_old")).alias("old"))
    return rows.where(good).drop("_bad", "_old"), counts


LISTED = "array<struct<covenantId:string,name:string,symbol:string,logoURI:string,decimals:int,extensions:struct<genesisTxid:string,curveCovenantId:string,creatorPubkey:string>>>"


def token_list(documents: DataFrame, network: str) -> DataFrame:
    """Tokens of lists (column ``body``: JSON) for one network; fields are cleaned one by one and rows without a valid id left out."""
    doc = F.from_json("body", f"network string, name string, tokens {LISTED}")
    rows = documents.select(doc.alias("d")).where(F.col("d.network") == network).select(F.explode("d.tokens").alias("t"))

    def text(c: str, most: int):
        x = F.trim(F.col(c))
        return F.when((F.length(x).between(1, most)) & ~x.rlike("\\p{Cntrl}"), x)

    ident = F.lower(F.trim("t.covenantId"))
    image = text("t.logoURI", 256)
    return rows.select(
        ident.alias("covenant_id"), text("t.name", 48).alias("name"), text("t.symbol", 12).alias("symbol"), F.when(image.rlike("^(https|ipfs)://"), image).alias("image"),
        F.when(F.col("t.decimals").between(0, 255), F.col("t.decimals")).alias("decimals"), F.lower("t.extensions.genesisTxid").alias("genesis_txid"),
    ).where(ident.rlike("^[0-9a-f]{64}$"))
