"""Market programs: matching revealed programs against audited builds, and the trial of constants for builds that nobody audited.

Builds are rows (``pins``): skeleton, rank, program (an example), ``open`` (places of pushes that may differ), and the roles of places.
A program is a build if the bytes around its pushes and all pushes but the open ones are the example's. Candidates meet pins by an
equi-join on the number of pushes and the digest of the bytes around them, so no program is tried against every build.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import exact as E, owners as O, scripts as S

CURVE_PINS = (
    "skeleton string, rank int, program binary, open array<int>, v array<int>, creator array<int>, seed array<int>, self_length array<int>, copies array<int>, "
    "token int, reserve int, graduation int, positive boolean"
)
POOL_PINS = "skeleton string, rank int, program binary, open array<int>"
ORDER_PINS = "skeleton string, rank int, program binary, open array<int>, price array<int>, expiry array<int>, maker array<int>, token array<int>, size int"
#: What a build means for its market: phase, and the fees of the bracket and of the growth in basis points.
MODELS = "skeleton string, phase string, bracket_fee int, growth_fee int"
POOL_STATE = 94
#: Fee models that a trial tries, in order: bracket and growth in basis points, and a name.
FEES = ((0, 0, "no fee"), (0, 125, "curve 125bps growth"), (20, 20, "pool 20bps"))
#: Largest value that an open place may have to be tried as the virtual reserve.
LARGEST_V = 1_000_000_000_000


def recovered_programs(cells: DataFrame, newest: int = 8, digest: Callable[[Column], Column] = S.h32) -> DataFrame:
    """(covenant_id, program): the newest program that a covenant's last ``newest`` spent cells reveal against their commitment.

    ``cells``: covenant_id, txid, output_index, created_daa, spk_script, spent_sig. The newest cells of a covenant are kept by an
    aggregate, so one with many cells isn't sorted in one task.
    """
    order = F.struct(F.col("created_daa").alias("d"), F.col("txid").alias("t"), F.col("output_index").alias("i"))
    rows = cells.where("spent_sig is not null").select("covenant_id", order.alias("o"), F.col("spk_script").alias("script"), F.col("spent_sig").alias("sig"))
    part = rows.withColumn("part", F.pmod(F.xxhash64("o"), F.lit(32)))
    for keys in (["covenant_id", "part"], ["covenant_id"]):
        part = part.withColumn("n", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("o")))).where(F.col("n") <= newest)
    shown = part.withColumn("program", S.pushed("sig")["last"]).where(F.col("program").isNotNull())
    shown = shown.where(O.script_hash(F.col("script")) == digest(F.col("program")))
    return shown.groupBy("covenant_id").agg(F.max_by("program", "o").alias("program"))


def _lockstep(rows: DataFrame, pins: DataFrame) -> DataFrame:
    """Rows (id, body) that are a pin's build, with the pin's columns, the values of their pushes and the raw pushes."""
    mine = rows.withColumn("l", S.laid_out("body"))
    pin = pins.withColumn("f", S.laid_out("program")).drop("program")
    both = mine.join(F.broadcast(pin), (F.col("l.n") == F.col("f.n")) & (F.col("l.gap_digest") == F.col("f.gap_digest")))
    same = F.forall(F.sequence(F.lit(0), F.col("f.n") - 1), lambda i: F.array_contains("open", i) | (F.get(F.col("l.raws"), i) == F.get(F.col("f.raws"), i)))
    both = both.where((F.col("l.gaps") == F.col("f.gaps")) & ((F.col("f.n") == 0) | same))
    return both.select("*", F.col("l.values").alias("values"), F.col("l.raws").alias("raws")).drop("l", "f")


def _only(values: Column) -> Column:
    """The value that all places of a role have; null if there are none or they differ."""
    seen = F.array_distinct(values)
    return F.when(F.size(seen) == 1, F.get(seen, F.lit(0)))


def _bytes(places: str) -> Column:
    return _only(F.transform(F.col(places), lambda i: F.get(F.col("values"), i)))


def _number(places: str) -> Column:
    return _only(F.transform(F.col(places), lambda i: E.little_endian(F.get(F.col("values"), i))))


def _at(place: str) -> Column:
    return F.get(F.col("values"), F.col(place))


def _first(rows: DataFrame, names: list[str]) -> DataFrame:
    """One build for each id, the first by rank."""
    return rows.groupBy("id").agg(F.min_by(F.struct(*names), F.struct("rank", "skeleton")).alias("r")).select("id", "r.*")


def curves(programs: DataFrame, pins: DataFrame) -> DataFrame:
    """Constants of programs (id, program) that are an audited curve build.

    Beside the lockstep: a value that stands in several places must be one value, the places of the program's own length must tell the
    truth, copies of a template must be equal, and constants must be in range.
    """
    rows = _lockstep(programs.select("id", F.col("program").alias("body")), pins)
    rows = rows.select("*", _number("v").alias("v_units"), _bytes("creator").alias("creator_key"), _at("token").alias("token_id"), E.little_endian(_at("reserve")).alias("token_reserve"), E.little_endian(_at("graduation")).alias("graduation_units"))
    none = lambda c: F.size(c) == 0
    fine = (
        F.col("v_units").isNotNull() & (F.length("creator_key") == 32) & (F.length("token_id") == 32) & F.col("token_reserve").isNotNull() & F.col("graduation_units").isNotNull()
        & (none("seed") | _number("seed").isNotNull()) & (none("self_length") | (_number("self_length") == F.length("body"))) & (none("copies") | _bytes("copies").isNotNull())
        & (~F.col("positive") | ((F.col("v_units") > 0) & (F.col("token_reserve") >= 0) & (F.col("graduation_units") > 0)))
    )
    return _first(rows.where(fine), ["skeleton", "v_units", "creator_key", "token_id", "token_reserve", "graduation_units"])


def pools(programs: DataFrame, pins: DataFrame) -> DataFrame:
    """What programs (id, program) that are an audited pool build state: the state block in front has fixed places, the rest is matched
    in lockstep; ``open`` are the creator's places, which must agree."""
    p, h = F.col("program"), F.hex("program")
    at = lambda i: F.substring(h, 2 * i + 1, 2)
    cut = lambda a, n: F.substring(p, a + 1, n)
    marks = {0: "6B", 1: "08", 10: "08", 19: "20", 52: "08", 61: "20"}  # fixed values of the block
    shaped = (F.length(p) > POOL_STATE) & (F.concat(*[at(i) for i in marks]) == "".join(marks.values()))
    state = F.struct(
        E.little_endian(cut(2, 8)).alias("kas_reserve_units"), E.little_endian(cut(11, 8)).alias("token_reserve"), cut(20, 32).alias("token_id"), E.little_endian(cut(53, 8)).alias("shares"), cut(62, 32).alias("lp_token_id")
    )
    rows = programs.where(shaped).select("id", state.alias("s"), F.substring(p, F.lit(POOL_STATE + 1), F.length(p)).alias("body"))
    rows = _lockstep(rows, pins).withColumn("creator_key", _bytes("open"))
    fine = (F.length("creator_key") == 32) & F.col("s.kas_reserve_units").isNotNull() & F.col("s.token_reserve").isNotNull() & F.col("s.shares").isNotNull()
    return _first(rows.where(fine).select("*", "s.*"), ["skeleton", "creator_key", "token_id", "kas_reserve_units", "token_reserve", "shares", "lp_token_id"])


def orders(programs: DataFrame, pins: DataFrame) -> DataFrame:
    """Offers of programs (id, program) that are an audited resting order."""
    rows = _lockstep(programs.select("id", F.col("program").alias("body")), pins)
    rows = rows.select(
        "id", "skeleton", "rank", _number("price").alias("price_units"), _number("expiry").alias("expiry_daa"), _bytes("maker").alias("maker_key"), _bytes("token").alias("token_id"), E.little_endian(_at("size")).alias("size_units")
    )
    fine = (F.col("price_units") > 0) & (F.col("size_units") > 0) & (F.col("expiry_daa") > 0) & (F.length("maker_key") == 32) & (F.length("token_id") == 32)
    return _first(rows.where(fine), ["skeleton", "price_units", "expiry_daa", "maker_key", "token_id", "size_units"])


def verified(programs: DataFrame, found: list[DataFrame], exact: DataFrame, models: DataFrame, version: str, digest: Callable[[Column], Column] = S.h32) -> DataFrame:
    """(id, skeleton, phase, bracket_fee, growth_fee, program_hash) of all programs.

    ``found``: results of the matchers, the first counts; ``exact``: (program_hash, skeleton) of deployments that are known as a whole;
    a program that nothing matches is ``unmatched:version``, so that a newer matcher knows what to try again.
    """
    rows = programs.select("id", digest(F.col("program")).alias("program_hash"))
    for k, df in enumerate(found):
        rows = rows.join(df.select("id", F.col("skeleton").alias(f"_s{k}")).hint("merge"), "id", "left")
    rows = rows.join(exact.select("program_hash", F.col("skeleton").alias("_exact")), "program_hash", "left")
    name = F.coalesce(*[f"_s{k}" for k in range(len(found))], "_exact", F.lit(f"unmatched:{version}"))
    return rows.select("id", name.alias("skeleton"), "program_hash").join(F.broadcast(models), "skeleton", "left").select("id", "skeleton", F.coalesce("phase", F.lit("unknown")).alias("phase"), "bracket_fee", "growth_fee", "program_hash")


def v_candidates(programs: DataFrame) -> DataFrame:
    """(market_covenant_id, family, place, v): what may be the virtual reserve of unaudited builds, in the smallest unit.

    Programs (id, program) of one family have as many pushes and the same bytes around them. A place is tried if its value differs inside
    the family and is small in every member; place -1 stands for none.
    """
    rows = programs.select("id", S.laid_out("program").alias("l")).where("l.n is not null")
    rows = rows.select("id", F.concat_ws(":", F.col("l.n").cast("string"), F.hex("l.gap_digest")).alias("family"), F.col("l.values").alias("values"))
    each = rows.select("id", "family", F.posexplode("values").alias("place", "value")).withColumn("v", E.little_endian(F.col("value")))
    good = each.groupBy("family", "place").agg((F.min("value") < F.max("value")).alias("differs"), F.bool_and(F.coalesce(F.col("v").between(1, LARGEST_V), F.lit(False))).alias("small")).where("differs and small")
    some = each.hint("merge").join(good.select("family", "place"), ["family", "place"]).select(F.col("id").alias("market_covenant_id"), "family", F.col("place").cast("int").alias("place"), (F.col("v") * E.QUANTUM).alias("v"))
    return some.unionByName(rows.select(F.col("id").alias("market_covenant_id"), "family", F.lit(-1).alias("place"), F.lit(0).cast("long").alias("v")))


def trials(trades: DataFrame, candidates: DataFrame, fees: tuple = FEES) -> DataFrame:
    """(family, place, fee, clean, off, bad): how the trades of a family's markets fit each virtual reserve and fee model.

    One pass: a trade meets its own market's candidates only, and the few fee models are a constant list. Trades of a market with the
    same figures are counted first and judged once. Trades that other covenants took part in aren't judged.
    """
    k0, k1, b0, b1 = (F.col(c) for c in ("kas_before_sompi", "kas_after_sompi", "base_before", "base_after"))
    quote, base, v = F.col("quote_sompi"), F.col("base_amount"), F.col("v")
    grid = F.array(*[F.struct(F.lit(i).alias("fee"), F.lit(b).alias("bracket"), F.lit(g).alias("growth")) for i, (b, g, _) in enumerate(fees)])
    figures = ["market_covenant_id", "side", "kas_before_sompi", "kas_after_sompi", "base_before", "base_after", "quote_sompi", "base_amount"]
    judged = trades.where("co_covenants = 0").groupBy(*figures).agg(F.count(F.lit(1)).alias("n"))
    candidates = candidates.hint("merge").join(trades.where("co_covenants = 0").select("market_covenant_id").distinct(), "market_covenant_id")
    rows = judged.join(candidates, "market_covenant_id").select("*", F.inline(grid))
    rows = rows.select("family", "place", "fee", "n", E.bracket_holds(v, k0, k1, b0, b1, quote, base, F.col("side") == "buy", F.col("bracket")).alias("on"), E.invariant_holds(v, k0, k1, b0, b1, quote, F.col("growth")).alias("inv"))
    many = lambda ok: F.sum(F.when(ok, F.col("n")).otherwise(0))
    return rows.groupBy("family", "place", "fee").agg(many(F.col("on") & F.col("inv")).alias("clean"), many(~F.col("on")).alias("off"), many(F.col("on") & ~F.col("inv")).alias("bad"))


def best_trials(counts: DataFrame, fees: tuple = FEES) -> DataFrame:
    """For each family the trial that breaks no invariant and has the most clean trades; ties go to the earlier one."""
    best = counts.where("bad = 0").groupBy("family").agg(F.min_by(F.struct("place", "fee", "clean", "off"), F.struct(-F.col("clean"), F.col("place"), F.col("fee"))).alias("b"))
    name = F.get(F.array(*[F.lit(n) for *_, n in fees]), F.col("b.fee"))
    return best.select("family", F.when(F.col("b.place") >= 0, F.col("b.place")).alias("v_place"), name.alias("fee_model"), F.col("b.clean").alias("trades_clean"), F.col("b.off").alias("trades_off_curve"))


def posted_orders(cells: DataFrame, pins: DataFrame, oldest: int = 8, digest: Callable[[Column], Column] = S.h32) -> DataFrame:
    """What each covenant offered when it was posted: among its ``oldest`` spent cells the first whose revealed program is an audited
    resting order, with that cell's score. The number is part of the rule, as a resting order lives in one or two cells."""
    order = F.struct(F.col("created_daa").alias("d"), F.col("txid").alias("t"), F.col("output_index").alias("i"))
    part = cells.where("spent_sig is not null").select("covenant_id", order.alias("o"), F.col("spk_script").alias("script"), F.col("spent_sig").alias("sig")).withColumn("part", F.pmod(F.xxhash64("o"), F.lit(32)))
    for keys in (["covenant_id", "part"], ["covenant_id"]):
        part = part.withColumn("n", F.row_number().over(W.partitionBy(*keys).orderBy("o"))).where(F.col("n") <= oldest)
    shown = part.withColumn("program", S.pushed("sig")["last"]).where(F.col("program").isNotNull())
    shown = shown.where(O.script_hash(F.col("script")) == digest(F.col("program"))).select(F.struct("covenant_id", "o").alias("id"), "program")
    found = orders(shown, pins)
    first = F.min_by(F.struct(*[c for c in found.columns if c != "id"], F.col("id.o.d").alias("posted_daa")), "id.o")
    return found.groupBy(F.col("id.covenant_id").alias("covenant_id")).agg(first.alias("r")).select("covenant_id", "r.*")
