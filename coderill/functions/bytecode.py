"""Bytecode as built-in expressions over its lower-case hexadecimal text.

One alternation, matched from left to right, is the linear-sweep disassembler: a push takes the bytes that
its opcode names, or what is left of them at the end, and any other byte is an instruction of its own.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the platform.
IMPLEMENTATION_SLOT = "360894a13ba1a3210667c828492db98dca3e2076cc3735a920a3ca505d382bbc"
BEACON_SLOT = "a3f0ad74e5423aebfd80d3ef4346578335a9a72aeaee59ff6cb3582b35133d50"
CLONE_HEAD, CLONE_TAIL = "363d3d373d3d3d363d73", "5af43d82803e903d91602b57fd5bf3"
DELEGATION_HEAD = "ef0100"

TOKENS = "|".join(f"{0x5F + n:02x}(?:..){{0,{n}}}" for n in range(1, 33)) + "|.."
CLONE = f"^{CLONE_HEAD}([0-9a-f]{{40}}){CLONE_TAIL}$"
DELEGATION = f"^{DELEGATION_HEAD}([0-9a-f]{{40}})$"


def hex_of(code: Column) -> Column:
    return F.lower(F.hex(code))


def tokens(hx: Column) -> Column:
    """Instructions in order: opcode and argument of each as one text."""
    return F.regexp_extract_all(hx, F.lit(TOKENS), F.lit(0))


def body_chars(hx: Column) -> Column:
    """Hexadecimal characters before the metadata trailer, or of all where there is none.

    The last two bytes are the length of a map whose header is a1 to a5; no length of zero or beyond the code.
    """
    size = F.length(hx)
    n = F.coalesce(F.conv(F.right(hx, F.lit(4)), 16, 10).cast("int"), F.lit(0))
    at = size - 4 - 2 * n
    header = F.substr(hx, at + 1, F.lit(2))
    return F.when((size >= 4) & (n > 0) & (at >= 0) & header.between("a1", "a5"), at).otherwise(size)


def body(hx: Column) -> Column:
    return F.substr(hx, F.lit(1), body_chars(hx))


def trailer(hx: Column) -> Column:
    return F.substr(hx, body_chars(hx) + 1)


def opcodes(tok: Column) -> Column:
    return F.transform(tok, lambda t: F.left(t, F.lit(2)))


def selectors(tok: Column) -> Column:
    """Sorted distinct four-byte pushes that one of the next two instructions compares."""
    compares = lambda t: F.coalesce(F.left(t, F.lit(2)) == "14", F.lit(False))
    wanted = lambda t, i: (F.left(t, F.lit(2)) == "63") & (F.length(t) == 10) & (compares(F.get(tok, i + 1)) | compares(F.get(tok, i + 2)))
    return F.array_sort(F.array_distinct(F.transform(F.filter(tok, wanted), lambda t: F.concat(F.lit("0x"), F.substr(t, F.lit(3))))))


def proxy_kind(hx: Column) -> Column:
    return F.when(hx.rlike(CLONE), "eip1167").when(hx.rlike(DELEGATION), "eip7702")


def proxy_target(hx: Column) -> Column:
    found = F.coalesce(F.nullif(F.regexp_extract(hx, CLONE, 1), F.lit("")), F.nullif(F.regexp_extract(hx, DELEGATION, 1), F.lit("")))
    return F.concat(F.lit("0x"), found)


def is_standard_proxy(tok: Column) -> Column:
    return F.arrays_overlap(tok, F.array(F.lit(f"7f{IMPLEMENTATION_SLOT}"), F.lit(f"7f{BEACON_SLOT}")))


def skeleton(tok: Column) -> Column:
    """The instructions again, with the arguments of 20- and 32-byte pushes as zeros."""
    masked = lambda t: F.when(F.left(t, F.lit(2)).isin("73", "7f"), F.rpad(F.left(t, F.lit(2)), F.length(t), F.lit("0"))).otherwise(t)
    return F.array_join(F.transform(tok, masked), "")


def selfdestructs(ops: Column) -> Column:
    return F.array_contains(ops, "ff")


def mutable_delegatecall(ops: Column, kind: Column, standard: Column) -> Column:
    return F.array_contains(ops, "f4") & F.array_contains(ops, "54") & ~F.coalesce(kind == "eip1167", F.lit(False)) & ~standard


def flags(destructs: Column, mutable: Column) -> Column:
    return F.coalesce(F.nullif(F.concat_ws(",", F.when(destructs, "selfdestruct"), F.when(mutable, "mutable_delegatecall")), F.lit("")), F.lit("-"))


def numbered(ops: Column) -> Column:
    """Opcodes as numbers."""
    return F.transform(ops, lambda o: F.conv(o, 16, 10).cast("bigint"))


def shingles(ops: Column, n: int = 5) -> Column:
    """Distinct runs of ``n`` numbered opcodes (7 at most), each as one number; none where there are fewer."""

    def run(i: Column) -> Column:
        out = F.get(ops, i)
        for k in range(1, n):
            out = out * 256 + F.get(ops, i + k)
        return out

    runs = F.transform(F.sequence(F.lit(0), F.size(ops) - n), run)
    return F.when(F.size(ops) >= n, F.array_distinct(runs)).otherwise(F.array().cast("array<bigint>"))


def is_hex_code(text: Column) -> Column:
    return text.rlike("^0x([0-9a-fA-F]{2})*$")


def is_address(text: Column) -> Column:
    return text.rlike("^0x[0-9a-fA-F]{40}$")


def slot_address(word: Column) -> Column:
    """The address in a storage word of 32 bytes, or null: zeros before it, and not zero itself."""
    found = F.nullif(F.regexp_extract(word, "^0[xX]0{24}([0-9a-fA-F]{40})$", 1), F.lit(""))
    return F.when(found != "0" * 40, F.concat(F.lit("0x"), F.lower(found)))


def fingerprint(hx: Column) -> list[Column]:
    """Columns of a code's row, from ``hx`` and ``tok`` (the instructions of its body) beside it."""
    tok, kind = F.col("tok"), proxy_kind(hx)
    return [
        F.sha2(F.unhex(hx), 256).alias("code_id"),
        (F.length(hx) / 2).cast("long").alias("size"),
        F.sha2(F.unhex(skeleton(tok)), 256).alias("skeleton_hash"),
        selectors(tok).alias("selectors"),
        kind.alias("proxy_kind"),
        proxy_target(hx).alias("proxy_target"),
        is_standard_proxy(tok).alias("std_proxy"),
        opcodes(tok).alias("ops"),
    ]
