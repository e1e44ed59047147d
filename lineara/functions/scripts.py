"""Scripts of state cells: disassembly, reveals, state blocks and number codecs.

Shapes at fixed offsets are native expressions; what walks a script byte by byte or hashes with BLAKE2b is an Arrow UDF over whole
batches. Null scripts give null.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, StringType, StructField, StructType

from . import owners

# Names of the operations from 0x4f on, one after another; "-" has no name.
NAMES = """Op1Negate OpReserved OpTrue Op2 Op3 Op4 Op5 Op6 Op7 Op8 Op9 Op10 Op11 Op12 Op13 Op14 Op15 Op16 OpNop OpVer OpIf OpNotIf OpVerIf
OpVerNotIf OpElse OpEndIf OpVerify OpReturn OpToAltStack OpFromAltStack Op2Drop Op2Dup Op3Dup Op2Over Op2Rot Op2Swap OpIfDup OpDepth OpDrop
OpDup OpNip OpOver OpPick OpRoll OpRot OpSwap OpTuck OpCat OpSubstr OpLeft OpRight OpSize OpInvert OpAnd OpOr OpXor OpEqual OpEqualVerify
OpReserved1 OpReserved2 Op1Add Op1Sub Op2Mul Op2Div OpNegate OpAbs OpNot Op0NotEqual OpAdd OpSub OpMul OpDiv OpMod OpLShift OpRShift
OpBoolAnd OpBoolOr OpNumEqual OpNumEqualVerify OpNumNotEqual OpLessThan OpGreaterThan OpLessThanOrEqual OpGreaterThanOrEqual OpMin OpMax
OpWithin OpZkPrecompile OpBlake2bWithKey OpSHA256 OpCheckMultiSigECDSA OpBlake2b OpCheckSigECDSA OpCheckSig OpCheckSigVerify OpCheckMultiSig
OpCheckMultiSigVerify OpCheckLockTimeVerify OpCheckSequenceVerify OpTxVersion OpTxInputCount OpTxOutputCount OpTxLockTime OpTxSubnetId
OpTxGas OpTxPayloadSubstr OpTxInputIndex OpOutpointTxId OpOutpointIndex OpTxInputScriptSigSubstr OpTxInputSeq OpTxInputAmount OpTxInputSpk
OpTxInputDaaScore OpTxInputIsCoinbase OpTxOutputAmount OpTxOutputSpk OpTxPayloadLen OpTxInputSpkLen OpTxInputSpkSubstr OpTxOutputSpkLen
OpTxOutputSpkSubstr OpTxInputScriptSigLen - OpAuthOutputCount OpAuthOutputIdx OpNum2Bin OpBin2Num OpInputCovenantId OpCovInputCount
OpCovInputIdx OpCovOutputCount OpCovOutputIdx OpChainblockSeqCommit OpOutputCovenantId OpOutputAuthorizingInput OpCheckSigFromStack
OpCheckSigFromStackECDSA OpBlake3 OpBlake3WithKey""".split()
LATE = {0xFA: "OpSmallInteger", 0xFB: "OpPubKeys", 0xFD: "OpPubKeyHash", 0xFE: "OpPubKey", 0xFF: "OpInvalidOpCode"}
COVENANT = set(range(0xCB, 0xCD)) | set(range(0xCF, 0xD7))
INTROSPECTION = (set(range(0xB2, 0xCA)) | {0xCD, 0xCE}) - COVENANT


def opcode(op: int) -> tuple[str, str]:
    """Name and group of an operation."""
    if op <= 0x4E:
        return ("OpFalse" if op == 0 else "OpData" if op < 0x4C else f"OpPushData{1 << (op - 0x4C)}"), "push"
    name = NAMES[op - 0x4F] if op - 0x4F < len(NAMES) else LATE.get(op, "-")
    if name == "-":
        return "OpUnknown", "unknown"
    if op == 0x4F or 0x51 <= op <= 0x60:
        return name, "push"
    group = "zk" if op == 0xA6 else "covenant" if op in COVENANT else "introspection" if op in INTROSPECTION else "standard"
    return name, group


def opcodes(spark: SparkSession) -> DataFrame:
    """The dictionary of operations, one row for each byte."""
    return spark.createDataFrame([(i, *opcode(i)) for i in range(256)], "opcode int, name string, grp string")


def walk(script: bytes) -> tuple[list[tuple[int, int, bytes | None]], bool]:
    """(offset, operation, data) of a script, and whether it ends inside a push. A push whose length is cut off has no data."""
    out, at = [], 0
    while at < len(script):
        start, op = at, script[at]
        at += 1
        size = None
        if 1 <= op <= 0x4B:
            size = op
        elif 0x4C <= op <= 0x4E:
            width = 1 << (op - 0x4C)
            if at + width <= len(script):
                size = int.from_bytes(script[at : at + width], "little")
                at += width
        if size is None:
            out.append((start, op, None))
        elif at + size > len(script):
            out.append((start, op, None))
            return out, True
        else:
            out.append((start, op, script[at : at + size]))
            at += size
    return out, False


def _struct(**fields) -> StructType:
    return StructType([StructField(n, t) for n, t in fields.items()])


_OP = _struct(offset=IntegerType(), opcode=IntegerType(), name=StringType(), grp=StringType(), data=BinaryType())
INSTRUCTIONS = _struct(ops=ArrayType(_OP), truncated=BooleanType())


@pandas_udf(INSTRUCTIONS)
def disassemble(scripts: pd.Series) -> pd.DataFrame:
    """Instructions of a script, and whether it is cut off inside a push."""
    ops, cut = [], []
    for s in scripts:
        found, bad = walk(s) if s is not None else ([], False)
        ops.append([{"offset": at, "opcode": op, "name": opcode(op)[0], "grp": opcode(op)[1], "data": data} for at, op, data in found])
        cut.append(bad)
    return pd.DataFrame({"ops": ops, "truncated": cut})


def blake2b(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=32).digest()


@pandas_udf(BinaryType())
def h32(data: pd.Series) -> pd.Series:
    """BLAKE2b-256."""
    return data.map(lambda b: None if b is None else blake2b(b))


@pandas_udf(BinaryType())
def revealed(scripts: pd.Series, witnesses: pd.Series) -> pd.Series:
    """The program of a spent pay-to-script-hash cell: the last push of the witness, if its hash is the one committed to."""

    def one(script: bytes | None, witness: bytes | None) -> bytes | None:
        if script is None or witness is None or len(script) != 35 or script[:2] != b"\xaa\x20" or script[-1] != 0x87:
            return None
        ops, cut = walk(witness)
        program = ops[-1][2] if ops and not cut else None
        return program if program is not None and blake2b(program) == script[2:34] else None

    return pd.Series([one(a, b) for a, b in zip(scripts, witnesses, strict=True)], dtype=object)


def push_units(program: bytes) -> list[tuple[int, int, bytes]]:
    """(start, end, value) of all pushes, small numbers included; a push that is cut off ends the list."""
    out = []
    ops, cut = walk(program)
    ends = [at for at, *_ in ops[1:]] + [len(program)]
    for (start, op, data), end in zip(ops[: len(ops) - cut], ends, strict=False):
        if data is not None or op == 0:
            out.append((start, end, data or b""))
        elif 0x51 <= op <= 0x60:
            out.append((start, end, bytes([op - 0x50])))
    return out


_PUSHED = _struct(values=ArrayType(BinaryType()), last=BinaryType())


@pandas_udf(_PUSHED)
def pushed(witnesses: pd.Series) -> pd.DataFrame:
    """Values that a witness pushes, small numbers included, and the data of its last operation (none if it is cut off or no push)."""
    rows = []
    for w in witnesses:
        ops, cut = walk(w) if w is not None else ([], False)
        rows.append((None if w is None else [v for *_, v in push_units(w)], ops[-1][2] if ops and not cut else None))
    return pd.DataFrame(rows, columns=["values", "last"])


_LAID = _struct(n=IntegerType(), gap_digest=BinaryType(), gaps=ArrayType(BinaryType()), raws=ArrayType(BinaryType()), values=ArrayType(BinaryType()))


@pandas_udf(_LAID)
def laid_out(programs: pd.Series) -> pd.DataFrame:
    """A program as its pushes (whole and their values) and the bytes before, between and behind them, with a digest of the latter."""
    rows = []
    for p in programs:
        if p is None:
            rows.append((None,) * 5)
            continue
        found, at, gaps = push_units(p), 0, []
        for a, b, _ in found:
            gaps.append(p[at:a])
            at = b
        gaps.append(p[at:])
        rows.append((len(found), blake2b(b"".join(gaps)), gaps, [p[a:b] for a, b, _ in found], [v for *_, v in found]))
    return pd.DataFrame(rows, columns=["n", "gap_digest", "gaps", "raws", "values"])


SHAPE = _struct(pushes=IntegerType(), length=IntegerType(), gap_digest=BinaryType())


@pandas_udf(SHAPE)
def shape(programs: pd.Series) -> pd.DataFrame:
    """What programs of one build have in common: pushes, length, and a digest of all bytes outside the pushes."""
    rows = []
    for p in programs:
        if p is None:
            rows.append((None, None, None))
            continue
        units, at, gaps = push_units(p), 0, []
        for a, b, _ in units:
            gaps.append(p[at:a])
            at = b
        gaps.append(p[at:])
        rows.append((len(units), len(p), blake2b(b"".join(gaps))))
    return pd.DataFrame(rows, columns=["pushes", "length", "gap_digest"])


@pandas_udf(ArrayType(BinaryType()))
def units(programs: pd.Series) -> pd.Series:
    """Values of all pushes of a program."""
    return programs.map(lambda p: None if p is None else [v for *_, v in push_units(p)])


def build_slots(programs: DataFrame) -> DataFrame:
    """(gap_digest, pushes, place, n_values) of the places in which programs of one build differ; ``programs`` has (id, program)."""
    rows = programs.select(shape("program").alias("s"), units("program").alias("u")).select("s", F.posexplode("u").alias("place", "value"))
    return rows.groupBy("s.gap_digest", "s.pushes", "place").agg(F.countDistinct("value").alias("n_values")).where("n_values > 1")


def zk_system(pushes: Column) -> Column:
    """Which proof system a script's pushes hint at, by their sizes."""
    some = lambda lo, hi: F.exists(pushes, lambda x: F.length(x).between(lo, hi))
    return F.when(some(1024, 1 << 30), "risc0").when(some(128, 256), "groth16").when(some(300, 1023), "plonk")


def state_block(program: Column) -> Column:
    """Where the token state of a program begins (0 or, behind a guard, 1), by the bytes at fixed places; null if there is none."""
    h, n = F.hex(program), F.length(program)
    at = lambda i: F.substring(h, 2 * i + 1, 2)
    is_ = lambda want: F.concat(*[at(i) for i in want]) == F.lit("".join(want.values()))
    guarded = (n >= 48) & is_({0: "6B", 1: "20", 34: "01", 36: "08", 45: "01", 47: "6C"})
    plain = (n >= 46) & is_({0: "20", 33: "01", 35: "08", 44: "01"})
    return F.when(guarded, 1).when(plain, 0)


def token_state(program: Column) -> Column:
    """owner (hex of type and key), kind, amount bytes and minter byte of a program's token state; null if there is none."""
    start = state_block(program)
    cut = lambda a, n: F.substring(program, start + a + 1, F.lit(n))
    number = lambda b: F.conv(F.hex(b), 16, 10).cast("int")
    return F.when(start.isNotNull(), F.struct(owners.owner_key(cut(34, 1), cut(1, 32)).alias("owner"), number(cut(34, 1)).alias("kind"), cut(36, 8).alias("amount"), number(cut(45, 1)).alias("minter")))


def spliced(program: bytes, owner: bytes, kind: int, amount: int, minter: bool) -> bytes:
    """A program with another token state in its block."""
    start = 1 if program[:2] == b"\x6b\x20" else 0
    block = b"\x20" + owner + b"\x01" + bytes([kind]) + b"\x08" + state_int(amount) + b"\x01" + bytes([minter])
    return program[:start] + block + program[start + len(block) :]


def state_int(value: int) -> bytes:
    """Eight bytes, little-endian, with the sign in the highest bit."""
    if abs(value) >= 1 << 63:
        raise ValueError("out of range")
    return (abs(value) | (1 << 63 if value < 0 else 0)).to_bytes(8, "little")


def read_state_int(data: bytes) -> int | None:
    """The number of ``state_int``; a negative zero is none."""
    raw = int.from_bytes(data, "little")
    size, negative = raw & ((1 << 63) - 1), raw >> 63
    return None if negative and not size else -size if negative else size


def script_number(value: int) -> bytes:
    """The shortest little-endian bytes with the sign in the highest bit."""
    if abs(value) >= 1 << 63:
        raise ValueError("out of range")
    size = (abs(value).bit_length() + 8) // 8 if value else 0
    return (abs(value) | (1 << (8 * size - 1) if value < 0 else 0)).to_bytes(size, "little")


def read_script_number(data: bytes) -> int | None:
    """The number of ``script_number``; anything but the shortest form is none."""
    if not data:
        return 0
    sign = 1 << (8 * len(data) - 1)
    raw = int.from_bytes(data, "little")
    value = -(raw - sign) if raw & sign else raw
    if abs(value) >= 1 << 63 or script_number(value) != data:
        return None
    return value


def template_hash(prefix: bytes, suffix: bytes) -> bytes:
    """Digest of a program's fixed parts, each behind its length."""
    return blake2b(b"".join(len(x).to_bytes(8, "little") + x for x in (prefix, suffix)))


def dispatch_tag(signature: Column) -> Column:
    """First four bytes of the digest of an entry point's signature."""
    return F.substring(h32(F.encode(signature, "UTF-8")), 1, 4)


def proves(program: bytes, script: bytes, owner: bytes, kind: int, amount: int, minter: bool) -> bool:
    """Whether an output's script commits to the program with this state."""
    return len(script) == 35 and script[:2] == b"\xaa\x20" and script[34] == 0x87 and blake2b(spliced(program, owner, kind, amount, minter)) == script[2:34]


def skeleton(programs: list[bytes]) -> list[tuple[int, bytes | None]] | None:
    """What several programs of one build share: (operation, data) with no data where they differ; null if their operations differ.

    Runs on the driver over a few examples; the result is small and matched in tasks by ``fits``.
    """
    walks = [walk(p) for p in programs]
    if len(programs) < 2 or any(cut for _, cut in walks) or len({len(w) for w, _ in walks}) != 1:
        return None
    out = []
    for parts in zip(*(w for w, _ in walks), strict=True):
        data = {d for _, _, d in parts}
        ops = {op for _, op, _ in parts}
        if len(ops) > 1 and any(d is None for d in data):
            return None
        out.append((min(ops), data.pop() if len(data) == 1 else None) if len(data) == 1 else (-1, None))
    return out


def fits(program: bytes, bones: list[tuple[int, bytes | None]]) -> list[bytes] | None:
    """Values at the open places of a skeleton, if a program has its operations and fixed values."""
    ops, cut = walk(program)
    if cut or len(ops) != len(bones):
        return None
    out = []
    for (_, op, data), (want, fixed) in zip(ops, bones, strict=True):
        if want == -1:
            if data is None:
                return None
            out.append(data)
        elif op != want or data != fixed:
            return None
    return out


def matcher(named: dict[str, list[tuple[int, bytes | None]]]):
    """An Arrow UDF that gives the first skeleton that a program fits and the values of its open places."""

    @pandas_udf(_struct(template=StringType(), slots=ArrayType(BinaryType())))
    def match(programs: pd.Series) -> pd.DataFrame:
        rows = []
        for p in programs:
            hit = next(((n, v) for n, b in named.items() if p is not None and (v := fits(p, b)) is not None), (None, None))
            rows.append(hit)
        return pd.DataFrame(rows, columns=["template", "slots"])

    return match


#: An operation of a skeleton: its code (-1: any push), fixed data, and the label of an open place.
Item = tuple[int, bytes | None, str | None]


def _takes(item: Item, op: int, data: bytes | None, seen: dict[str, bytes]) -> bool:
    """Whether an operation is the item's; an open place keeps its value, and a label that is met again must have the same one."""
    code, fixed, label = item
    if label is None:
        return op == code and data == fixed
    if code == -1:
        value = data if data is not None else b"" if op == 0 else bytes([op - 0x50]) if 0x51 <= op <= 0x60 else None
    else:
        value = data if op == code else None
    return value is not None and seen.setdefault(label, value) == value


def fits_repeated(program: bytes, prefix: list[Item], group: list[Item], suffix: list[Item], least: int = 0) -> list[tuple[str, int, bytes]] | None:
    """(label, repeat, value) of a program that is a prefix, a group any number of times, and a suffix; repeat is -1 outside the group.

    A label must have one value inside one repeat and one value outside; other repeats may differ.
    """
    ops, cut = walk(program)
    extra = len(ops) - len(prefix) - len(suffix)
    if cut or extra < 0 or (extra % len(group) if group else extra):
        return None
    times = extra // len(group) if group else 0
    if times < least:
        return None
    outside: dict[str, bytes] = {}
    tail = len(ops) - len(suffix)
    out: list[tuple[str, int, bytes]] = []
    if not all(_takes(i, op, d, outside) for i, (_, op, d) in zip(prefix, ops, strict=False)) or not all(_takes(i, op, d, outside) for i, (_, op, d) in zip(suffix, ops[tail:], strict=True)):
        return None
    for k in range(times):
        seen: dict[str, bytes] = {}
        at = len(prefix) + k * len(group)
        if not all(_takes(i, op, d, seen) for i, (_, op, d) in zip(group, ops[at : at + len(group)], strict=True)):
            return None
        out += [(label, k, v) for label, v in seen.items()]
    return [(label, -1, v) for label, v in outside.items()] + out


_FIELD = _struct(label=StringType(), repeat=IntegerType(), value=BinaryType())


def repeated_matcher(named: dict[str, tuple[list[Item], list[Item], list[Item], int]]):
    """An Arrow UDF that gives the first skeleton of variable length that a program fits, and its open values by repeat."""

    @pandas_udf(_struct(template=StringType(), fields=ArrayType(_FIELD)))
    def match(programs: pd.Series) -> pd.DataFrame:
        rows = []
        for p in programs:
            name, found = next(((n, f) for n, x in named.items() if p is not None and (f := fits_repeated(p, *x)) is not None), (None, None))
            rows.append((name, None if found is None else [{"label": a, "repeat": r, "value": v} for a, r, v in found]))
        return pd.DataFrame(rows, columns=["template", "fields"])

    return match


def template_digest(program: Column, digest=h32) -> Column:
    """Digest of a proven token program without its state: the bytes before and behind the state block, each behind its length."""
    start = state_block(program)
    head, tail = F.substring(program, F.lit(1), start), F.substring(program, start + 47, F.length(program))
    return F.when(start.isNotNull(), digest(F.concat(le8(F.length(head).cast("long")), head, le8(F.length(tail).cast("long")), tail)))


def le8(number: Column) -> Column:
    """A whole number that isn't negative as eight little-endian bytes."""
    digits = F.lpad(F.hex(number), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, 15 - 2 * i, 2) for i in range(8)]))


def opens(commitment: Column, payload: Column, digest=h32) -> Column:
    """Whether a payload is what a 32-byte commitment stands for."""
    return F.coalesce(commitment == digest(payload), F.lit(False))
