"""Findings on transactions before they are sent: rules over tables of transactions, inputs and outputs.

Inputs of the rules: transactions (txid, version, unknown_fields), inputs (txid, idx, budget, sig_ops, script, amount, witness, units,
passed) and outputs (txid, idx, value, script); ``units`` and ``passed`` are what a run of the input's scripts gave, null if nobody ran
them. Masses (txid, compute, transient, storage) are what the node's calculator gave; a null storage mass of a transaction whose amounts are
all known is one that overflowed.

Each rule is a condition and a finding, so that one scan of a table gives all findings of its rows; the tables meet in one join of
counts by transaction. Nothing is collected, and a transaction with very many inputs is many rows of many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

# Fixed values of the network's rules.
FREE_UNITS = 9_999
UNITS_PER_BUDGET = 10_000
LARGEST_BUDGET = 65_535
LARGEST_SIG_OPS = 255
MOST_PUTS = 1_000
PLAIN_WITNESS = 150
COVENANT_BUDGET, FEE_BUDGET = 20, 10

FINDING = StructType(
    [StructField("severity", StringType()), StructField("code", StringType()), StructField("input_index", LongType()), StructField("output_index", LongType()), StructField("budget", LongType()), StructField("detail", StringType())]
)
COLUMNS = ["txid", *FINDING.names]


def covering_budget(units: Column) -> Column:
    """The smallest budget whose allowance, the free units included, covers what was used; null if no budget does."""
    need = F.call_function("div", F.greatest(units - FREE_UNITS, F.lit(0)) + (UNITS_PER_BUDGET - 1), F.lit(UNITS_PER_BUDGET))
    return F.when(need <= LARGEST_BUDGET, need)


def covenant_looking(script: Column, witness: Column) -> Column:
    """Whether an input spends a covenant and not a plain coin: its lock is a script's digest, or its witness is larger than a key and a signature."""
    h = F.hex(script)
    digest = (F.length(script) == 35) & h.startswith("AA20") & h.endswith("87")
    return F.coalesce(digest, F.lit(False)) | F.coalesce(F.length(witness) > PLAIN_WITNESS, F.lit(False))


def _finding(severity: str, code: str, input_index=None, output_index=None, budget=None, detail=None) -> Column:
    parts = {"severity": F.lit(severity), "code": F.lit(code), "input_index": input_index, "output_index": output_index, "budget": budget, "detail": detail}
    return F.struct(*[(F.lit(None) if c is None else c).cast(FINDING[n].dataType).alias(n) for n, c in parts.items()])


def _found(rows: DataFrame, *rules: tuple[Column, Column]) -> DataFrame:
    """One row for each rule whose condition is true; an unknown condition finds nothing."""
    hits = F.array_compact(F.array(*[F.when(cond, finding) for cond, finding in rules]))
    return rows.select("txid", F.inline(hits)).select(*COLUMNS)


def input_findings(transactions: DataFrame, inputs: DataFrame) -> DataFrame:
    """Traps of single inputs. A missing version counts as 1. The rules for budgets end at the first that says what must be mended."""
    t = transactions.select("txid", F.coalesce("version", F.lit(1)).alias("version"))
    rows = inputs.join(t, "txid")
    v1, v0 = F.col("version") == 1, F.col("version") == 0
    budget, ops, units, at = F.col("budget"), F.coalesce("sig_ops", F.lit(0)), F.col("units"), F.col("idx")
    passed, none = F.coalesce("passed", F.lit(False)), budget.isNull()
    over, left_over = v1 & (budget > LARGEST_BUDGET), v1 & none & (ops > 0)
    free = passed & (units <= FREE_UNITS)
    bare = v1 & F.coalesce(budget == 0, F.lit(True)) & ~left_over & ~F.coalesce(free, F.lit(False))
    measured = F.when(passed, F.greatest(covering_budget(units), F.lit(1)))
    covenant = covenant_looking(F.col("script"), F.col("witness"))
    return _found(
        rows,
        (over, _finding("error", "budget_overflow", at)),
        (v1 & (budget <= LARGEST_BUDGET) & (ops > 0), _finding("info", "sigop_count_ignored", at)),
        (left_over, _finding("error", "sigop_count_on_v1", at, budget=F.lit(FEE_BUDGET))),
        (bare & covenant, _finding("error", "budget_missing", at, budget=F.when(passed, measured).otherwise(COVENANT_BUDGET))),
        (bare & ~covenant, _finding("error", "fee_input_budget_missing", at, budget=F.when(passed, measured).otherwise(FEE_BUDGET))),
        (v0 & budget.isNotNull(), _finding("warn", "budget_on_v0", at)),
        (v0 & (ops > LARGEST_SIG_OPS), _finding("error", "sigop_overflow", at)),
        (~F.col("passed"), _finding("error", "input_script_failed", at, budget=F.when(units > FREE_UNITS + budget * UNITS_PER_BUDGET, covering_budget(units)))),
    )


def output_findings(outputs: DataFrame) -> DataFrame:
    at = F.col("idx")
    worthless, open_ = F.coalesce(F.col("value") == 0, F.lit(True)), F.coalesce(F.length("script") == 0, F.lit(True))
    return _found(outputs, (worthless, _finding("error", "output_value_zero", output_index=at)), (open_, _finding("error", "output_spk_missing", output_index=at)))


def _facts(transactions: DataFrame, inputs: DataFrame, outputs: DataFrame, masses: DataFrame) -> DataFrame:
    """A transaction with its counts and, if it can be built, its masses."""
    bad_budget = F.col("budget").isNull() | (F.col("budget") > LARGEST_BUDGET)
    ins = inputs.groupBy("txid").agg(F.count(F.lit(1)).alias("n_in"), F.count_if(bad_budget).alias("n_unbudgeted"), F.count_if(F.coalesce(F.col("amount") <= 0, F.lit(True))).alias("n_unvalued"))
    broken = F.coalesce(F.col("value") == 0, F.lit(True)) | F.coalesce(F.length("script") == 0, F.lit(True))
    outs = outputs.groupBy("txid").agg(F.count(F.lit(1)).alias("n_out"), F.count_if(broken).alias("n_broken"))
    rows = transactions.select("txid", "version", "unknown_fields").join(ins, "txid", "left").join(outs, "txid", "left")
    rows = rows.fillna(0, ["n_in", "n_unbudgeted", "n_unvalued", "n_out", "n_broken"])
    version = F.coalesce("version", F.lit(1))
    whole = version.isin(0, 1) & (F.col("n_in") > 0) & (F.col("n_out") > 0)
    rows = rows.withColumns({"whole": whole, "buildable": whole & ((version == 0) | (F.col("n_unbudgeted") == 0))})
    return rows.join(masses.select("txid", "compute", "transient", "storage"), "txid", "left")


def transaction_findings(facts: DataFrame, limits: tuple[int, int, int]) -> DataFrame:
    """Findings on a transaction as a whole; ``limits`` are the ceilings of compute, transient and storage mass."""
    c = F.col
    names = ("compute", "transient", "storage")
    storage_known = (c("n_unvalued") == 0) & (c("n_broken") == 0)
    stated = {n: c(n) if n != "storage" else F.when(storage_known, c(n)) for n in names}
    over = F.concat_ws(", ", *[F.when(stated[n] > top, F.concat(F.lit(f"{n} "), c(n).cast("string"), F.lit(f" > {top}"))) for n, top in zip(names, limits, strict=True)])
    measured = c("buildable") & c("compute").isNotNull()
    return _found(
        facts,
        (F.size("unknown_fields") > 0, _finding("info", "unknown_fields", detail=F.array_join("unknown_fields", ", "))),
        (c("version").isNull(), _finding("warn", "version_missing")),
        (~c("version").isin(0, 1), _finding("warn", "version_unknown", detail=c("version").cast("string"))),
        (c("n_in") == 0, _finding("error", "no_inputs")),
        (c("n_out") == 0, _finding("error", "no_outputs")),
        (F.greatest("n_in", "n_out") > MOST_PUTS, _finding("error", "too_many_io", detail=F.concat_ws("/", c("n_in").cast("string"), c("n_out").cast("string")))),
        (c("whole") & ~c("buildable"), _finding("info", "mass_skipped")),
        (c("buildable") & (c("n_broken") == 0) & (c("n_unvalued") > 0), _finding("info", "storage_mass_skipped")),
        (measured & storage_known & c("storage").isNull(), _finding("error", "storage_mass_incomputable")),
        (measured & (over != ""), _finding("error", "mass_exceeds_limit", detail=over)),
    )


def findings(transactions: DataFrame, inputs: DataFrame, outputs: DataFrame, masses: DataFrame, limits: tuple[int, int, int]) -> DataFrame:
    """(txid, severity, code, input_index, output_index, budget, detail): everything that the rules find; ``budget`` is a suggested one.

    Inputs and outputs count only with their transaction; a null txid meets nothing. Repeated rows are judged each.
    """
    facts = _facts(transactions, inputs, outputs, masses)
    mine = outputs.join(transactions.select("txid").distinct(), "txid", "left_semi")
    return transaction_findings(facts, limits).unionByName(input_findings(transactions, inputs)).unionByName(output_findings(mine))


def verdicts(transactions: DataFrame, inputs: DataFrame, outputs: DataFrame, masses: DataFrame, limits: tuple[int, int, int]) -> DataFrame:
    """(txid, verdict, errors, warnings, fee_estimate): ``will_fail`` with an error; ``ready`` if the masses are known and under their
    ceilings; else ``incomplete``. The estimate is a hundred smallest units for each gram of compute mass and a fixed headroom."""
    facts = _facts(transactions, inputs, outputs, masses)
    found = findings(transactions, inputs, outputs, masses, limits).groupBy("txid").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warn").alias("warnings"))
    found = found.withColumnRenamed("txid", "_txid")
    rows = facts.join(found, F.col("txid").eqNullSafe(F.col("_txid")), "left").fillna(0, ["errors", "warnings"])
    measured = F.col("buildable") & F.col("compute").isNotNull()
    verdict = F.when(F.col("errors") > 0, "will_fail").when(measured, "ready").otherwise("incomplete")
    return rows.select("txid", verdict.alias("verdict"), "errors", "warnings", F.when(measured, 100 * F.col("compute") + 200_000).alias("fee_estimate"))
