"""The kernel and the scores as SQL functions, for queries written as text.

``register`` creates them as temporary functions of a session. Each is an SQL expression, so plans show what it is made of and nothing
runs in Python. ``hx`` is a code as lower-case hexadecimal text without a prefix, ``tok`` its instructions.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from coderill.functions.bytecode import BEACON_SLOT, CLONE, DELEGATION, IMPLEMENTATION_SLOT, TOKENS

FINGERPRINT = "STRUCT<code_id STRING, size BIGINT, skeleton_hash STRING, selectors ARRAY<STRING>, proxy_kind STRING, proxy_target STRING, std_proxy BOOLEAN>"
_TRAILER_AT = "length(hx) - 4 - 2 * coalesce(cast(conv(right(hx, 4), 16, 10) AS INT), 0)"

_SELECTORS = """
        array_sort(array_distinct(transform(
          filter(tok, (t, i) -> t RLIKE '^63.{8}$' AND (coalesce(left(get(tok, i + 1), 2) = '14', FALSE) OR coalesce(left(get(tok, i + 2), 2) = '14', FALSE))),
          t -> concat('0x', substr(t, 3)))))"""
_STD_PROXY = f"arrays_overlap(tok, array('7f{IMPLEMENTATION_SLOT}', '7f{BEACON_SLOT}'))"
_SKELETON = "array_join(transform(tok, t -> CASE WHEN left(t, 2) IN ('73', '7f') THEN rpad(left(t, 2), length(t), '0') ELSE t END), '')"

#: Signature and body; later ones call earlier ones.
FUNCTIONS: dict[str, str] = {
    "evm_is_code(answer STRING) RETURNS BOOLEAN": "answer RLIKE '^0x([0-9a-fA-F]{2})*$'",
    "evm_is_address(a STRING) RETURNS BOOLEAN": "a RLIKE '^0x[0-9a-fA-F]{40}$'",
    "evm_slot_address(word STRING) RETURNS STRING": "CASE WHEN word RLIKE '^0[xX]0{24}[0-9a-fA-F]{40}$' AND right(word, 40) <> repeat('0', 40) THEN concat('0x', lower(right(word, 40))) END",
    "evm_body(hx STRING) RETURNS STRING": f"CASE WHEN length(hx) >= 4 AND {_TRAILER_AT} BETWEEN 0 AND length(hx) - 6 AND substr(hx, {_TRAILER_AT} + 1, 2) BETWEEN 'a1' AND 'a5' THEN left(hx, {_TRAILER_AT}) ELSE hx END",
    "evm_trailer(hx STRING) RETURNS STRING": "substr(hx, length(evm_body(hx)) + 1)",
    "evm_tokens(hx STRING) RETURNS ARRAY<STRING>": f"regexp_extract_all(hx, '{TOKENS}', 0)",
    "evm_opcodes(tok ARRAY<STRING>) RETURNS ARRAY<STRING>": "transform(tok, t -> left(t, 2))",
    "evm_selectors(tok ARRAY<STRING>) RETURNS ARRAY<STRING>": _SELECTORS,
    "evm_proxy_kind(hx STRING) RETURNS STRING": f"CASE WHEN hx RLIKE '{CLONE}' THEN 'eip1167' WHEN hx RLIKE '{DELEGATION}' THEN 'eip7702' END",
    "evm_proxy_target(hx STRING) RETURNS STRING": f"concat('0x', CASE WHEN hx RLIKE '{CLONE}' THEN regexp_extract(hx, '{CLONE}', 1) WHEN hx RLIKE '{DELEGATION}' THEN regexp_extract(hx, '{DELEGATION}', 1) END)",
    "evm_std_proxy(tok ARRAY<STRING>) RETURNS BOOLEAN": _STD_PROXY,
    "evm_skeleton(tok ARRAY<STRING>) RETURNS STRING": _SKELETON,
    "evm_selfdestruct(tok ARRAY<STRING>) RETURNS BOOLEAN": "array_contains(evm_opcodes(tok), 'ff')",
    "evm_mutable_delegatecall(hx STRING, tok ARRAY<STRING>) RETURNS BOOLEAN": """
        array_contains(evm_opcodes(tok), 'f4') AND array_contains(evm_opcodes(tok), '54') AND coalesce(evm_proxy_kind(hx) <> 'eip1167', TRUE) AND NOT evm_std_proxy(tok)""",
    "evm_flags(selfdestruct BOOLEAN, mutable_delegatecall BOOLEAN) RETURNS STRING": """
        CASE WHEN selfdestruct AND mutable_delegatecall THEN 'selfdestruct,mutable_delegatecall' WHEN selfdestruct THEN 'selfdestruct' WHEN mutable_delegatecall THEN 'mutable_delegatecall' ELSE '-' END""",
    "evm_shingles(tok ARRAY<STRING>, n INT) RETURNS ARRAY<STRING>": """
        CASE WHEN size(tok) >= n THEN array_distinct(transform(sequence(1, size(tok) - n + 1), i -> array_join(slice(transform(tok, t -> left(t, 2)), i, n), '')))
        ELSE cast(array() AS ARRAY<STRING>) END""",
    # the instructions are the element of an array of one, so that they are made once; functions can't be called there
    f"evm_fingerprint(hx STRING) RETURNS {FINGERPRINT}": f"""
        transform(array(named_struct('tok', evm_tokens(evm_body(hx)), 'kind', evm_proxy_kind(hx), 'target', evm_proxy_target(hx))), x -> named_struct(
          'code_id', sha2(unhex(hx), 256), 'size', cast(length(hx) / 2 AS BIGINT), 'skeleton_hash', sha2(unhex({_SKELETON.replace('tok', 'x.tok')}), 256),
          'selectors', {_SELECTORS.replace('tok', 'x.tok')}, 'proxy_kind', x.kind, 'proxy_target', x.target, 'std_proxy', {_STD_PROXY.replace('tok', 'x.tok')}))[0]""",
    "evm_jaccard(x ARRAY<STRING>, y ARRAY<STRING>) RETURNS DOUBLE": "coalesce(try_divide(cast(size(array_intersect(x, y)) AS DOUBLE), size(array_union(x, y))), 0D)",
    f"evm_score(x {FINGERPRINT}, y {FINGERPRINT}) RETURNS DOUBLE": """
        CASE WHEN x.proxy_kind IS NOT NULL OR y.proxy_kind IS NOT NULL THEN CASE WHEN x.proxy_kind = y.proxy_kind AND x.proxy_target = y.proxy_target THEN 1D ELSE 0D END
          WHEN x.std_proxy OR y.std_proxy THEN 0D ELSE evm_jaccard(x.selectors, y.selectors) END""",
    "evm_similarity(x STRING, y STRING) RETURNS DOUBLE": "evm_score(evm_fingerprint(x), evm_fingerprint(y))",
    "evm_code_similarity(x ARRAY<STRING>, y ARRAY<STRING>) RETURNS DOUBLE": "CASE WHEN size(x) = 0 OR size(y) = 0 THEN 0D ELSE evm_jaccard(x, y) END",
}


def register(spark: SparkSession) -> None:
    """Create the functions in a session, over those of the same names."""
    for signature, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
