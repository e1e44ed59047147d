"""A made-up consensus rule for the id of a genesis, for tests only."""

from pyspark.sql import functions as F


def covenant_id(prev_txid, prev_index, bound):
    text = F.array_join(F.transform(bound, lambda o: F.concat_ws(":", o["i"].cast("string"), o["value"].cast("string"), o["spk_version"].cast("string"), F.hex(o["spk_script"]))), ";")
    return F.sha2(F.concat_ws("|", prev_txid, prev_index.cast("string"), text), 256)
