"""DuckDB SQL for the registered queries: an independent statement of what they return."""

from __future__ import annotations

from coderill.functions.bytecode import BEACON_SLOT, CLONE, DELEGATION, IMPLEMENTATION_SLOT, TOKENS
from coderill.operators.statistics import CLUSTER_EDGES, FEATURES, SELECTOR_EDGES, SIZE_EDGES
from coderill.plans.corpus import ANSWERS, BUILT, CONTRACTS, RECEIPTS, SEEDS

_LEN = "CAST(length(hx) AS BIGINT)"
_N = "CAST(coalesce(try_cast('0x' || right(hx, 4) AS BIGINT), 0) AS BIGINT)"

KERNEL = f"""
sized AS (SELECT hx, {_LEN} AS size2, CASE WHEN length(hx) >= 4 THEN {_N} ELSE 0 END AS n FROM raw),
cut AS (
  SELECT hx, size2, CASE WHEN size2 >= 4 AND n > 0 AND size2 - 4 - 2 * n >= 0
    AND substr(hx, size2 - 4 - 2 * n + 1, 2) BETWEEN 'a1' AND 'a5' THEN size2 - 4 - 2 * n ELSE size2 END AS cut_at FROM sized),
toks AS (SELECT hx, size2, cut_at, regexp_extract_all(substr(hx, 1, cut_at), '{TOKENS}') AS tok FROM cut),
codes AS (
  SELECT hx, tok, cut_at, sha256(unhex(hx)) AS code_id, CAST(size2 // 2 AS BIGINT) AS size,
    sha256(unhex(array_to_string(list_transform(tok, lambda t: CASE WHEN left(t, 2) IN ('73', '7f') THEN rpad(left(t, 2), CAST(length(t) AS INTEGER), '0') ELSE t END), ''))) AS skeleton_hash,
    list_sort(list_distinct(list_transform(list_filter(generate_series(1, len(tok)), lambda i:
      left(tok[i], 2) = '63' AND length(tok[i]) = 10 AND (coalesce(left(tok[i + 1], 2) = '14', FALSE) OR coalesce(left(tok[i + 2], 2) = '14', FALSE))),
      lambda i: '0x' || substr(tok[i], 3)))) AS selectors,
    CASE WHEN regexp_matches(hx, '{CLONE}') THEN 'eip1167' WHEN regexp_matches(hx, '{DELEGATION}') THEN 'eip7702' END AS proxy_kind,
    CASE WHEN regexp_matches(hx, '{CLONE}') THEN '0x' || regexp_extract(hx, '{CLONE}', 1)
      WHEN regexp_matches(hx, '{DELEGATION}') THEN '0x' || regexp_extract(hx, '{DELEGATION}', 1) END AS proxy_target,
    list_contains(tok, '7f{IMPLEMENTATION_SLOT}') OR list_contains(tok, '7f{BEACON_SLOT}') AS std_proxy,
    list_transform(tok, lambda t: left(t, 2)) AS ops
  FROM toks),
flagged AS (
  SELECT *, list_contains(ops, 'ff') AS selfdestruct,
    list_contains(ops, 'f4') AND list_contains(ops, '54') AND coalesce(proxy_kind <> 'eip1167', TRUE) AND NOT std_proxy AS mutable_delegatecall FROM codes)"""

STORE = f"""
{CONTRACTS},
raw AS (SELECT DISTINCT hx FROM contracts WHERE hx <> ''),
{KERNEL},
stored AS (
  SELECT lower(address) AS address, CASE WHEN hx <> '' THEN sha256(unhex(hx)) END AS code_id, block, origin, lower(implementation) AS implementation FROM contracts)"""

IMPLEMENTATIONS = """
implementations AS (
  SELECT a.address, a.implementation, i.code_id AS impl_code_id
  FROM stored a JOIN codes c ON c.code_id = a.code_id AND c.std_proxy LEFT JOIN stored i ON i.address = a.implementation),
effective AS (
  SELECT s.address, coalesce(i.impl_code_id, s.code_id) AS code_id
  FROM stored s LEFT JOIN implementations i ON i.address = s.address WHERE s.code_id IS NOT NULL),
seeds AS (
  SELECT lower(r.address) AS address, e.code_id, r.label, coalesce(r.strict, FALSE) AS strict FROM seed_rows r JOIN effective e ON e.address = lower(r.address))"""

_JACCARD = "coalesce(CAST(len(list_intersect({a}, {b})) AS DOUBLE) / nullif(len(list_distinct(list_concat({a}, {b}))), 0), 0.0)"
_SCORE = (
    "CASE WHEN {x}.proxy_kind IS NOT NULL OR {y}.proxy_kind IS NOT NULL THEN CASE WHEN coalesce({x}.proxy_kind = {y}.proxy_kind AND {x}.proxy_target = {y}.proxy_target, FALSE) THEN 1.0 ELSE 0.0 END "
    "WHEN {x}.std_proxy OR {y}.std_proxy THEN 0.0 ELSE " + _JACCARD.replace("{a}", "{x}.selectors").replace("{b}", "{y}.selectors") + " END"
)


def _score(x: str, y: str) -> str:
    return "CAST(" + _SCORE.replace("{x}", x).replace("{y}", y) + " AS DOUBLE)"


_RUNS = "CASE WHEN len({o}) >= 5 THEN list_distinct(list_transform(generate_series(1, len({o}) - 4), lambda i: {o}[i] || {o}[i + 1] || {o}[i + 2] || {o}[i + 3] || {o}[i + 4])) ELSE [] END"
_CODE_SCORE = _JACCARD.replace("{a}", "x.runs").replace("{b}", "y.runs")


def pairs(left: str, t: float) -> str:
    """CTE of scored pairs (a, b, score) of the codes in ``left`` and all codes."""
    return f"""
pairs AS (
  SELECT x.code_id AS a, y.code_id AS b, {_score('x', 'y')} AS score
  FROM codes x JOIN (SELECT DISTINCT code_id FROM {left}) l ON l.code_id = x.code_id, codes y WHERE {_score('x', 'y')} >= {t})"""


_CODE_PAIRS = f"""
runs AS (SELECT code_id, {_RUNS.replace('{o}', 'ops')} AS runs FROM codes),
scored AS (SELECT p.*, {_CODE_SCORE} AS code_score FROM pairs p JOIN runs x ON x.code_id = p.a JOIN runs y ON y.code_id = p.b)"""

CLUSTERS = """
held AS (SELECT s.address, s.implementation, c.* FROM stored s JOIN codes c ON c.code_id = s.code_id),
grouped AS (
  SELECT 'L0' AS level, code_id AS key, address FROM held WHERE proxy_kind IS NULL
  UNION ALL SELECT 'L1', skeleton_hash, address FROM held WHERE proxy_kind IS NULL AND skeleton_hash IN (
    SELECT skeleton_hash FROM held WHERE proxy_kind IS NULL GROUP BY 1 HAVING count(DISTINCT code_id) >= 2)
  UNION ALL SELECT 'proxy', proxy_kind || ':' || proxy_target, address FROM held WHERE proxy_kind = 'eip1167'
  UNION ALL SELECT 'eip7702', proxy_kind || ':' || proxy_target, address FROM held WHERE proxy_kind = 'eip7702'
  UNION ALL SELECT 'impl', implementation, address FROM held WHERE std_proxy AND implementation IS NOT NULL),
clusters AS (
  SELECT level, key, array_to_string(list_sort(list(DISTINCT address)), ',') AS members, CAST(count(DISTINCT address) AS BIGINT) AS n_members
  FROM grouped GROUP BY level, key HAVING count(DISTINCT address) >= 2)"""

_RANK = "CASE level WHEN 'L0' THEN 1 WHEN 'L1' THEN 2 WHEN 'proxy' THEN 3 WHEN 'eip7702' THEN 4 ELSE 5 END"


def with_store(*ctes: str, select: str) -> str:
    return "WITH " + ",".join((STORE, *ctes)) + "\n" + select


def with_raw(select: str) -> str:
    raw = "raw AS (SELECT DISTINCT hx FROM (SELECT hx FROM contracts UNION ALL SELECT lower(hex(text)) FROM documents) WHERE hx <> '')"
    return f"WITH {CONTRACTS}, {raw}, {KERNEL}\n{select}"


def _histogram(values: str, column: str, edges: tuple[int, ...]) -> str:
    rows = ", ".join(f"({e})" for e in edges)
    return f"""
SELECT CAST(e.edge AS BIGINT) AS edge, count(v.bucket) AS n FROM (VALUES {rows}) e(edge)
LEFT JOIN (SELECT coalesce((SELECT max(g.edge) FROM (VALUES {rows}) g(edge) WHERE g.edge <= s.{column}), {edges[0]}) AS bucket FROM {values} s) v ON v.bucket = e.edge GROUP BY e.edge"""


def _spearman() -> str:
    ranked = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in FEATURES)
    cells = "\nUNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(regr_sxy({y}, {x}) / nullif(sqrt(regr_sxx({y}, {x}) * regr_syy({y}, {x})), 0), 9) AS rho FROM ranked"
        for i, a in enumerate(FEATURES) for j, b in enumerate(FEATURES) for x, y in [(a, b) if i <= j else (b, a)]
    )
    return with_store(
        f"""features AS (
  SELECT c.size, len(regexp_extract_all(c.hx, '{TOKENS}')) AS opcode_count, len(c.selectors) AS selector_count,
    (SELECT count(*) FROM stored s WHERE s.code_id = c.code_id) AS address_count,
    count(*) OVER (PARTITION BY skeleton_hash) AS l1_family_size, CASE WHEN proxy_kind IS NULL THEN 0 ELSE 1 END AS is_proxy FROM codes c),
ranked AS (SELECT {ranked} FROM features)""",
        select=cells,
    )


_FLAGS = "coalesce(nullif(concat_ws(',', CASE WHEN selfdestruct THEN 'selfdestruct' END, CASE WHEN mutable_delegatecall THEN 'mutable_delegatecall' END), ''), '-')"
_SEEDED = (SEEDS, IMPLEMENTATIONS)
_MATCHED = """
matched AS (
  SELECT p.b AS code_id, s.address AS seed_address, s.label, p.score FROM scored p JOIN seeds s ON s.code_id = p.a
  WHERE NOT s.strict OR p.code_score >= 0.6),
alerts AS (
  SELECT e.address, m.seed_address, m.label, m.score, coalesce(o.origin, 'unknown') AS origin
  FROM matched m JOIN effective e ON e.code_id = m.code_id JOIN stored o ON o.address = e.address WHERE e.address <> m.seed_address)"""
_ALERTS = (*_SEEDED, pairs("seeds", 0.75), _CODE_PAIRS, _MATCHED)

LABELS = """
pairs_of AS (
  SELECT a.p_partkey // 50 AS k, CASE WHEN a.p_partkey % 4 = 1 THEN 'negatives' ELSE 'positives' END AS kind, a.address AS a, b.address AS b
  FROM built a JOIN built b ON b.p_partkey = a.p_partkey + CASE WHEN a.p_partkey % 4 = 1 THEN 13 ELSE 20 END WHERE a.p_partkey % 50 IN (9, 3, 11))"""
_STRICT = "strict_of AS (SELECT DISTINCT a AS address FROM pairs_of WHERE k % 3 = 0)"

_CALIBRATE = f"""
labelled AS (SELECT a AS address FROM pairs_of UNION SELECT b FROM pairs_of),
lheld AS (SELECT l.address, s.code_id, l.address IN (SELECT address FROM strict_of) AS strict FROM labelled l JOIN stored s ON s.address = l.address WHERE s.code_id IS NOT NULL),
{pairs('lheld', 0.5).strip()},
{_CODE_PAIRS.strip()},
grid AS (SELECT * FROM (VALUES (0, 0.5), (1, 0.6), (2, 0.7), (3, 0.75), (4, 0.8), (5, 0.9), (6, 1.0)) g(position, threshold)),
directed AS (SELECT kind, a AS seed, b AS other FROM pairs_of UNION ALL SELECT kind, b, a FROM pairs_of),
checks AS (
  SELECT d.kind, x.strict, coalesce(p.score, 0.0) AS score, coalesce(p.code_score, 0.0) AS code_score
  FROM directed d JOIN lheld x ON x.address = d.seed JOIN lheld y ON y.address = d.other LEFT JOIN scored p ON p.a = x.code_id AND p.b = y.code_id),
benign AS (SELECT DISTINCT code_id FROM stored WHERE code_id IS NOT NULL AND code_id NOT IN (SELECT code_id FROM lheld)),
hits AS (SELECT DISTINCT p.a, p.b, p.score, p.code_score, s.strict FROM scored p JOIN lheld s ON s.code_id = p.a WHERE p.b IN (SELECT code_id FROM benign)),
c AS (
  SELECT position, sum(CASE WHEN kind = 'positives' AND score >= threshold AND (NOT strict OR code_score >= 0.6) THEN 1 ELSE 0 END) AS ok,
    sum(CASE WHEN kind = 'positives' THEN 1 ELSE 0 END) AS pos,
    sum(CASE WHEN kind = 'negatives' AND score >= threshold AND (NOT strict OR code_score >= 0.6) THEN 1 ELSE 0 END) AS negatives
  FROM grid, checks GROUP BY position),
h AS (
  SELECT position, count(DISTINCT b) AS benign, count(DISTINCT CASE WHEN NOT strict AND code_score < 0.6 THEN b END) AS interface_only
  FROM grid, hits WHERE score >= threshold AND (NOT strict OR code_score >= 0.6) GROUP BY position)"""

CANDIDATES = "found AS (SELECT block, lower(address) AS address, CASE WHEN bool_or(created) THEN 'created' ELSE 'seen' END AS origin FROM touched GROUP BY 1, 2)"
_NEW = "fresh AS (SELECT f.* FROM found f WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.address = f.address AND s.block <= 100))"


def _ingest(*ctes: str, select: str) -> str:
    return "WITH " + ",".join((STORE, RECEIPTS, CANDIDATES, _NEW, *ctes)) + "\n" + select


#: Each code beside that of the part two hundred on, or twenty.
NEIGHBOURS = """
neighbours AS (
  SELECT a.p_partkey, a.hx, b.hx AS other FROM built a JOIN built b ON b.p_partkey = a.p_partkey + CASE WHEN a.p_partkey % 2 = 0 THEN 20 ELSE 200 END WHERE a.hx <> '' AND b.hx <> '')"""

#: Words that a node gives for the two slots of proxies at three blocks: addresses, zeros, malformed ones and failed reads.
SLOTS = """
slot_words AS (
  SELECT address, CAST(1000 + b AS BIGINT) AS block, slot,
    CASE (p_partkey + b + CASE WHEN slot = 'beacon' THEN 3 ELSE 0 END) % 7
      WHEN 0 THEN NULL WHEN 1 THEN '0x' || repeat('0', 64) WHEN 2 THEN '0x12' WHEN 3 THEN '0x' || repeat('0', 23) || '1' || substr(target, 3)
      ELSE '0x' || repeat('0', 24) || upper(substr(target, 3)) END AS word
  FROM (SELECT x.address, x.p_partkey, y.address AS target FROM built x JOIN built y ON y.p_partkey = x.p_partkey + 7 + x.p_partkey % 3 WHERE x.kind IN (2, 12)) p
    CROSS JOIN (SELECT 0 AS b UNION ALL SELECT 1 UNION ALL SELECT 2) blocks CROSS JOIN (SELECT 'implementation' AS slot UNION ALL SELECT 'beacon') slots)"""
_ADDRESS = "CASE WHEN regexp_matches({w}, '^0[xX]0{{24}}[0-9a-fA-F]{{40}}$') AND right({w}, 40) <> repeat('0', 40) THEN '0x' || lower(right({w}, 40)) END"
_RESOLVED = f"""
both_slots AS (
  SELECT i.address, i.block, i.word AS iw, {_ADDRESS.format(w='i.word')} AS own, {_ADDRESS.format(w='b.word')} AS other
  FROM slot_words i JOIN slot_words b ON b.address = i.address AND b.block = i.block AND b.slot = 'beacon' WHERE i.slot = 'implementation'),
resolved AS (SELECT address, block, coalesce(own, CASE WHEN iw IS NOT NULL THEN other END) AS implementation, own IS NOT NULL AS direct FROM both_slots)"""

_LATER = "later AS (SELECT address, CASE WHEN right(address, 1) < '8' THEN '0x' || repeat('ab', 20) WHEN right(address, 1) < 'c' THEN implementation END AS implementation FROM implementations)"
_NUMBERED = """
numbered AS (
  SELECT row_number() OVER (ORDER BY block, kind, address, score DESC, seed_address, new_impl) AS id, * FROM (
    SELECT 'ALERT' AS kind, s.block, a.address, a.seed_address, a.label, a.score, a.origin, CAST(NULL AS STRING) AS old_impl, CAST(NULL AS STRING) AS new_impl
    FROM alerts a JOIN stored s ON s.address = a.address
    UNION ALL SELECT 'UPGRADE', s.block, b.address, NULL, NULL, NULL, NULL, b.implementation, n.implementation
    FROM implementations b JOIN later n ON n.address = b.address JOIN stored s ON s.address = b.address
    WHERE b.implementation IS NOT NULL AND n.implementation IS NOT NULL AND n.implementation <> b.implementation) q)"""
_LINE = "CASE WHEN kind = 'ALERT' THEN concat_ws(chr(9), kind, address, seed_address, label, printf('%.4f', score), origin) ELSE concat_ws(chr(9), kind, address, old_impl, new_impl, CAST(block AS STRING)) END"


def _events(select: str) -> str:
    return with_store(*_ALERTS, _LATER, _NUMBERED, select=select)


_RECENT = "(SELECT max(block) FROM stored) - 299"

SQL: dict[str, str] = {
    "k1_disassemble": with_raw("""
SELECT code_id, CAST(i - 1 AS INTEGER) AS idx, CAST(coalesce(sum(length(tok[i])) OVER (PARTITION BY code_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 2 AS BIGINT) AS pc, left(tok[i], 2) AS op, substr(tok[i], 3) AS arg
FROM (SELECT c.* FROM codes c WHERE EXISTS (SELECT 1 FROM contracts k WHERE k.hx = c.hx)) q, unnest(generate_series(1, len(tok))) x(i)"""),
    "k2_strip_metadata": with_raw("SELECT code_id, cut_at // 2 AS body_bytes, size - cut_at // 2 AS trailer_bytes, sha256(unhex(substr(hx, 1, cut_at))) AS body_hash FROM codes"),
    "k3_selectors": with_raw("SELECT code_id, array_to_string(selectors, ',') AS selectors, CAST(len(selectors) AS BIGINT) AS n FROM codes"),
    "k4_proxy": with_raw("SELECT code_id, proxy_kind, proxy_target FROM codes WHERE proxy_kind IS NOT NULL"),
    "k5_standard_proxy": with_raw("SELECT code_id, std_proxy FROM codes"),
    "k6_skeleton": with_raw("SELECT code_id, skeleton_hash FROM codes"),
    "k7_risk_flags": with_raw("SELECT code_id, selfdestruct, mutable_delegatecall FROM flagged"),
    "k8_fingerprint": with_store(select="SELECT code_id, size, skeleton_hash, array_to_string(selectors, ',') AS selectors, proxy_kind, proxy_target, std_proxy FROM codes"),
    "k9_opcode_shingles": with_raw(f"SELECT code_id, CAST(len({_RUNS.replace('{o}', 'ops')}) AS BIGINT) AS n_shingles, CAST(len(ops) AS BIGINT) AS n_ops FROM codes"),
    "k10_opcode_trigrams": with_store(select="SELECT code_id, CAST(CASE WHEN len(ops) >= 3 THEN len(list_distinct(list_transform(generate_series(1, len(ops) - 2), lambda i: ops[i] || ops[i + 1] || ops[i + 2]))) ELSE 0 END AS BIGINT) AS n_trigrams FROM codes"),
    "k11_hex_code": "SELECT doc_id, CAST(length(code) AS BIGINT) AS chars, regexp_matches(code, '^0x([0-9a-fA-F]{2})*$') AS is_code FROM (SELECT doc_id, text AS code FROM documents UNION ALL SELECT doc_id, '0x' || hex(encode(text)) FROM documents)",
    "k12_slot_address": f"WITH {CONTRACTS}, words AS (SELECT address, CASE WHEN p_partkey % 3 = 0 THEN '0X' ELSE '0x' END || repeat('0', 24 - p_partkey % 2) || upper(substr(address, 3 - CASE WHEN p_partkey % 2 = 1 THEN 1 ELSE 0 END)) AS word FROM built) SELECT address, CASE WHEN regexp_matches(word, '^0[xX]0{{24}}[0-9a-fA-F]{{40}}$') AND right(word, 40) <> repeat('0', 40) THEN '0x' || lower(right(word, 40)) END AS slot_address FROM words",
    "k14_flags": with_store(select=f"SELECT code_id, {_FLAGS} AS flags FROM flagged"),
    "s1_score_pairs": with_store(pairs("codes", 0.75), select="SELECT a, b, score FROM pairs"),
    "s2_code_similarity": with_store(*_SEEDED, pairs("seeds", 0.5), _CODE_PAIRS, select="SELECT a, b, score, code_score FROM scored"),
    "s5_effective_code": with_store(*_SEEDED, select="SELECT address, code_id FROM effective"),
    "j2_implementations": with_store(*_SEEDED, select="SELECT address, implementation, impl_code_id FROM implementations"),
    "j3_find_similar": with_store(*_SEEDED, "query AS (SELECT e.* FROM effective e WHERE e.address = (SELECT min(address) FROM seeds WHERE strict))", pairs("query", 0.8), select="SELECT e.address, p.score FROM pairs p JOIN effective e ON e.code_id = p.b WHERE e.address <> (SELECT address FROM query)"),
    "j4_match_watchlist": with_store(*_ALERTS, select="SELECT code_id, seed_address, label, score FROM matched"),
    "j5_recheck": with_store(*_ALERTS, select="SELECT * FROM alerts"),
    "f5_recheck_created": with_store(*_ALERTS, select="SELECT * FROM alerts WHERE origin = 'created'"),
    "j7_interface_hits": with_store(*_SEEDED, pairs("seeds", 0.75), _CODE_PAIRS, select="SELECT s.address AS seed_address, (SELECT count(*) FROM scored p WHERE p.a = s.code_id AND p.a <> p.b AND p.code_score < 0.6) AS hits FROM seeds s"),
    "a1_clusters": with_store(CLUSTERS, select="SELECT * FROM clusters"),
    "o5_clusters_top": with_store(CLUSTERS, select=f"SELECT level, key, n_members FROM clusters ORDER BY n_members DESC, {_RANK}, key LIMIT 20"),
    "f8_clusters_of_level": with_store(CLUSTERS, select="SELECT level, key, n_members FROM clusters WHERE level = 'impl' ORDER BY n_members DESC, key LIMIT 20"),
    "j11_cluster_of_address": with_store(*_SEEDED, CLUSTERS, select="SELECT level, key, n_members FROM clusters WHERE list_contains(string_split(members, ','), (SELECT min(address) FROM seeds))"),
    "f4_risk_addresses": with_store(select=f"SELECT s.address, {_FLAGS} AS flags FROM stored s JOIN flagged f ON f.code_id = s.code_id WHERE {_FLAGS} <> '-'"),
    "a6_origin_counts": with_store(select="SELECT coalesce(origin, 'unknown') AS origin, count(*) AS n FROM stored GROUP BY 1"),
    "f6_origins_since_block": with_store(select=f"SELECT coalesce(origin, 'unknown') AS origin, count(*) AS n FROM stored WHERE block >= {_RECENT} GROUP BY 1"),
    "a8_counts": with_store(select="SELECT count(*) AS addresses, count(code_id) AS with_code, count(*) - count(code_id) AS without_code, count(DISTINCT block) AS blocks, (SELECT count(*) FROM codes) AS codes FROM stored"),
    "r6_code_of": with_store(RECEIPTS, CANDIDATES, select="SELECT DISTINCT s.address, c.code_id, c.size FROM found f JOIN stored s ON s.address = f.address JOIN codes c ON c.code_id = s.code_id"),
    "r7_addresses_of": with_store(*_SEEDED, select="SELECT code_id, address FROM stored WHERE code_id IN (SELECT code_id FROM seeds)"),
    "r8_has_address": with_store(RECEIPTS, CANDIDATES, select="SELECT DISTINCT f.address, f.address IN (SELECT address FROM stored) AS stored FROM found f"),
    "a2_member_pages": with_store(CLUSTERS, select="""
SELECT level, key, k // 100 AS page, string_agg(address, ',' ORDER BY address) AS members
FROM (SELECT level, key, address, row_number() OVER (PARTITION BY level, key ORDER BY address) - 1 AS k FROM (SELECT level, key, unnest(string_split(members, ',')) AS address FROM clusters)) GROUP BY 1, 2, 3"""),
    "a9_ledger_days": "SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(sum(1000 + 80 * (o_orderkey % 9)) AS BIGINT) AS credits FROM orders GROUP BY 1",
    "a10_levels": with_store(CLUSTERS, select="""
SELECT l.level, (SELECT count(*) FROM clusters c WHERE c.level = l.level) AS clusters,
  (SELECT count(DISTINCT m) FROM clusters c, unnest(string_split(c.members, ',')) u(m) WHERE c.level = l.level) AS addresses,
  CAST((SELECT count(DISTINCT m) FROM clusters c, unnest(string_split(c.members, ',')) u(m) WHERE c.level = l.level) AS DOUBLE) / (SELECT count(code_id) FROM stored) AS share
FROM (VALUES ('L0'), ('L1'), ('proxy'), ('eip7702')) l(level)"""),
    "a11_skeletons": with_store("""f AS (SELECT c.skeleton_hash, count(*) AS codes, sum((SELECT count(*) FROM stored s WHERE s.code_id = c.code_id)) AS addresses FROM codes c WHERE proxy_kind IS NULL GROUP BY 1),
t AS (SELECT CAST(sum(codes) AS BIGINT) AS codes, CAST(sum(CASE WHEN codes = 1 THEN 1 ELSE 0 END) AS BIGINT) AS unique_codes, CAST(sum(addresses) AS BIGINT) AS addresses, CAST(sum(CASE WHEN codes = 1 THEN addresses ELSE 0 END) AS BIGINT) AS unique_addresses FROM f)""", select="SELECT *, unique_codes / CAST(codes AS DOUBLE) AS code_share, unique_addresses / CAST(addresses AS DOUBLE) AS address_share FROM t"),
    "a12_size_distribution": with_store(select="SELECT min(size) AS min, median(size) AS median, max(size) AS max FROM codes"),
    "a12_selector_distribution": with_store(select="SELECT CAST(min(len(selectors)) AS BIGINT) AS min, median(len(selectors)) AS median, CAST(max(len(selectors)) AS BIGINT) AS max FROM codes"),
    "a13_size_histogram": with_store(select=_histogram("codes", "size", SIZE_EDGES)),
    "a13_selector_histogram": with_store("v AS (SELECT len(selectors) AS n_selectors FROM codes)", select=_histogram("v", "n_selectors", SELECTOR_EDGES)),
    "a13_cluster_histogram": with_store(CLUSTERS, select=_histogram("clusters", "n_members", CLUSTER_EDGES)),
    "a14_alerts_by_seed": with_store(*_ALERTS, select="SELECT seed_address, label, count(*) AS n FROM alerts GROUP BY 1, 2"),
    "a15_risk": with_store(select="""
SELECT flag, codes, addresses, codes / CAST((SELECT count(*) FROM codes) AS DOUBLE) AS code_share, addresses / CAST((SELECT count(code_id) FROM stored) AS DOUBLE) AS address_share FROM (
  SELECT 'selfdestruct' AS flag, (SELECT count(*) FROM flagged WHERE selfdestruct) AS codes, (SELECT count(*) FROM stored s JOIN flagged f ON f.code_id = s.code_id WHERE selfdestruct) AS addresses
  UNION ALL SELECT 'mutable_delegatecall', (SELECT count(*) FROM flagged WHERE mutable_delegatecall), (SELECT count(*) FROM stored s JOIN flagged f ON f.code_id = s.code_id WHERE mutable_delegatecall))"""),
    "a16_spearman": _spearman(),
    "a18_calibrate": with_store(LABELS, _STRICT, _CALIBRATE, select="""
SELECT g.position, CAST(g.threshold AS DOUBLE) AS threshold, coalesce(CAST(c.ok AS DOUBLE) / nullif(c.pos, 0), 0.0) AS recall, CAST(coalesce(c.negatives, 0) AS BIGINT) AS negatives,
  coalesce(h.benign, 0) AS benign, coalesce(h.interface_only, 0) AS interface_only, (SELECT count(*) FROM benign) AS benign_total
FROM grid g LEFT JOIN c ON c.position = g.position LEFT JOIN h ON h.position = g.position"""),
    "f1_candidates": f"WITH {RECEIPTS}, {CANDIDATES} SELECT * FROM found",
    "f3_unknown_candidates": _ingest(select="SELECT * FROM fresh"),
    "n3_first_seen": _ingest(select="SELECT address, min(block) AS block, arg_min(origin, block) AS origin FROM fresh GROUP BY address"),
    "n2_capped": _ingest(select="SELECT *, row_number() OVER (PARTITION BY block ORDER BY address) <= 50 AS fetched FROM fresh"),
    "a19_block_stats": _ingest("""decided AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY address) <= 50 AS fetched FROM fresh),
answers AS (SELECT d.block, d.address, CASE WHEN s.code_id IS NOT NULL THEN 'contract' WHEN d.address LIKE '%f' THEN 'failed' ELSE 'eoa' END AS kind FROM decided d LEFT JOIN stored s ON s.address = d.address WHERE d.fetched),
b AS (SELECT block, count(*) AS candidates FROM found GROUP BY 1)""", select="""
SELECT b.block, b.candidates, b.candidates - (SELECT count(*) FROM decided d WHERE d.block = b.block) AS known,
  (SELECT count(*) FROM decided d WHERE d.block = b.block AND fetched) AS fetched, (SELECT count(*) FROM decided d WHERE d.block = b.block AND NOT fetched) AS deferred,
  (SELECT count(*) FROM answers a WHERE a.block = b.block AND kind = 'contract') AS contracts, (SELECT count(*) FROM answers a WHERE a.block = b.block AND kind = 'eoa') AS eoas,
  (SELECT count(*) FROM answers a WHERE a.block = b.block AND kind = 'failed') AS failed, NOT EXISTS (SELECT 1 FROM decided d WHERE d.block = b.block AND NOT fetched) AS complete
FROM b"""),
    "j10_upgrades": with_store(*_SEEDED, "later AS (SELECT address, CASE WHEN right(address, 1) < '8' THEN '0x' || repeat('ab', 20) WHEN right(address, 1) < 'c' THEN implementation END AS implementation FROM implementations)", select="SELECT b.address, b.implementation AS old_impl, n.implementation AS new_impl FROM implementations b JOIN later n ON n.address = b.address WHERE b.implementation IS NOT NULL AND n.implementation IS NOT NULL AND n.implementation <> b.implementation"),
    "f7_events_after": "SELECT event_id AS id, event_type AS kind, user_id FROM events WHERE event_id > 100 ORDER BY event_id DESC LIMIT 100",
    "w8_events": _events("SELECT * FROM numbered"),
    "w9_event_lines": _events(f"SELECT id, {_LINE} AS line FROM numbered"),
    "w10_lines_of_created": _events(f"SELECT id, {_LINE} AS line FROM numbered WHERE kind = 'UPGRADE' OR origin = 'created'"),
    "a7_event_counts": _events("SELECT k.kind, count(n.id) AS n FROM (VALUES ('ALERT'), ('UPGRADE')) k(kind) LEFT JOIN numbered n ON n.kind = k.kind GROUP BY 1"),
    "a7_seed_counts": _events("SELECT seed_address, label, count(*) AS n FROM numbered WHERE kind = 'ALERT' GROUP BY 1, 2"),
    "f9_upgrades_only": _events("SELECT * FROM numbered WHERE kind = 'UPGRADE'"),
    "o8_feed": """
WITH e AS (SELECT event_id AS id, event_type AS kind, user_id FROM events),
both_of AS (SELECT id, kind, -user_id AS user_id FROM e WHERE id % 3 <> 0 UNION ALL SELECT * FROM e WHERE id % 2 = 0 AND id % 3 = 0)
SELECT * FROM both_of ORDER BY id DESC LIMIT 500""",
    "a21_origin_shares": with_store("c AS (SELECT o.origin, count(s.address) AS n FROM (VALUES ('created'), ('seen'), ('impl'), ('fetched'), ('unknown')) o(origin) LEFT JOIN stored s ON coalesce(s.origin, 'unknown') = o.origin GROUP BY 1)", select='SELECT origin, n AS "count", coalesce(floor(n * 1000.0 / nullif((SELECT sum(n) FROM c), 0) + 0.5) / 10, 0.0) AS percent FROM c'),
    "c15_formatted": f"""WITH {CONTRACTS}, ages AS (SELECT address, p_partkey, CASE WHEN p_partkey % 10 <> 0 THEN p_partkey * 7 % 9000 END AS s FROM built)
SELECT address, left(address, 6) || chr(8230) || right(address, 4) AS short,
  CASE WHEN s IS NULL THEN 'n/a' WHEN s < 60 THEN s || ' s' WHEN s < 3600 THEN s // 60 || ' min' ELSE s // 3600 || ' h' END AS age,
  CASE WHEN s IS NULL THEN 'unknown' WHEN s < 60 THEN 'live' WHEN s < 300 THEN 'behind' ELSE 'stalled' END AS status,
  printf('%02d:%02d:00', p_partkey % 24, p_partkey % 60) AS time, 'https://etherscan.io/address/' || address AS url FROM ages""",
    "k13_addresses": f"""WITH {CONTRACTS}, g AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN upper(address) WHEN 1 THEN left(address, 41) WHEN 2 THEN address || 'f' WHEN 3 THEN '0x' || upper(substr(address, 3)) ELSE address END AS given FROM built)
SELECT p_partkey, given, length(given) = 42 AND given[1:2] = '0x' AND translate(lower(given[3:]), '0123456789abcdef', '') = '' AS valid FROM g""",
    "s3_similarity_of_codes": with_store(NEIGHBOURS, select=f"SELECT n.p_partkey, {_score('x', 'y')} AS score FROM neighbours n JOIN codes x ON x.hx = n.hx JOIN codes y ON y.hx = n.other"),
    "j9_resolved_proxies": with_store(SLOTS, _RESOLVED, select="SELECT * FROM resolved"),
    "st6_upgrades": with_store(SLOTS, _RESOLVED, """
chained AS (
  SELECT r.block, r.address, coalesce(lag(r.implementation) OVER (PARTITION BY r.address ORDER BY r.block), s.implementation) AS old_impl, r.implementation AS new_impl
  FROM resolved r LEFT JOIN stored s ON s.address = r.address WHERE r.implementation IS NOT NULL)""", select="SELECT * FROM chained WHERE old_impl IS NOT NULL AND old_impl <> new_impl"),
    "st8_implementation_alerts": with_store(SLOTS, _RESOLVED, *_ALERTS, select="""
SELECT r.block, r.address, m.seed_address, m.label, m.score, coalesce(p.origin, 'unknown') AS origin
FROM resolved r JOIN stored p ON p.address = r.address JOIN stored i ON i.address = r.implementation JOIN matched m ON m.code_id = i.code_id"""),
    "st9_capped_by_budget": _ingest("firsts AS (SELECT address, min(block) AS block, arg_min(origin, block) AS origin FROM fresh GROUP BY address)",
      "ranked AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY address) AS k FROM firsts)",
      select="SELECT address, block, origin, k <= 50 AND CASE WHEN k <= 50 THEN sum(CASE WHEN k <= 50 THEN 1 ELSE 0 END) OVER (ORDER BY block, address ROWS UNBOUNDED PRECEDING) ELSE 401 END <= 400 AS fetched FROM ranked"),
    "st10_reserved": with_store(SLOTS, select="""
SELECT address, block FROM (SELECT *, sum(80 + 80) OVER (ORDER BY block, address ROWS UNBOUNDED PRECEDING) AS reserved FROM (SELECT DISTINCT address, block FROM slot_words)) WHERE reserved <= 20000"""),
    "c10_formatted_alerts": with_store(*_ALERTS, select="SELECT concat_ws(chr(9), 'ALERT', address, seed_address, label, printf('%.4f', score), origin) AS line FROM alerts"),
}

# the same numbers, kept by differences
for _name in ("a6_origin_counts", "a8_counts", "a10_levels", "o5_clusters_top"):
    SQL[f"{_name}_kept"] = SQL[_name]

SQL["st6_upgrades_keyed"] = SQL["st6_upgrades"]

# the same rows by SQL functions of the session
for _name in ("k8_fingerprint", "s1_score_pairs"):
    SQL[f"{_name}_sql"] = SQL[_name]

_NUMBERS, _TEXT = "'UBIGINT', 'BIGINT', 'HUGEINT', 'DOUBLE'", "'VARCHAR'"


def _kinds(base: str, number: str = "", text: str = "", number_or_null: str = "", text_or_null: str = "") -> list[str]:
    """Checks of members below a path that is an SQL expression."""
    groups = ((number, _NUMBERS), (text, _TEXT), (number_or_null, f"{_NUMBERS}, 'NULL'"), (text_or_null, f"{_TEXT}, 'NULL'"))
    return [f"CASE WHEN coalesce(json_type(j, {base} || '.{m}'), '') NOT IN ({kinds}) THEN {base} || '.{m}' END" for members, kinds in groups for m in members.split()]


def _is(path: str, kind: str) -> str:
    return f"CASE WHEN coalesce(json_type(j, {path}), '') <> '{kind}' THEN {path} END"


def _items(path: str, var: str, checks: list[str]) -> str:
    return f"(list_filter(list_transform(range(CAST(CASE WHEN json_type(j, {path}) = 'ARRAY' THEN json_array_length(j, {path}) ELSE 0 END AS BIGINT)), lambda {var}: coalesce({', '.join(checks)})), lambda f: f IS NOT NULL))[1]"


_EVENT_AT, _SEED_AT, _CLUSTER_AT = "('$.events[' || i || ']')", "('$.alerts_by_seed[' || i || ']')", "('$.clusters[' || i || ']')"
_COUNTED = "created seen impl fetched unknown"
_FAULTS = {
    "health": _kinds("'$'", number_or_null="progress") + _kinds("'$'", text_or_null="progress_at") + _kinds("'$'", number_or_null="seconds_since_progress") + _kinds("'$'", text="now"),
    "events": [*_kinds("'$'", number="last_id"), _is("'$.events'", "ARRAY"), _items("'$.events'", "i", [
        _is(_EVENT_AT, "OBJECT"), *_kinds(_EVENT_AT, number="id"),
        f"CASE WHEN coalesce(json_extract_string(j, {_EVENT_AT} || '.kind'), '') NOT IN ('ALERT', 'UPGRADE') THEN {_EVENT_AT} || '.kind' END",
        *_kinds(_EVENT_AT, number="block"), *_kinds(_EVENT_AT, text="at address"), *_kinds(_EVENT_AT, text_or_null="seed_address label origin old_impl new_impl"), *_kinds(_EVENT_AT, number_or_null="score")])],
    "summary": [*_kinds("'$'", number="addresses codes seeds implementations_resolved"), _is("'$.origins'", "OBJECT"), *_kinds("'$.origins'", number=_COUNTED), _is("'$.alerts_by_seed'", "ARRAY"),
        _items("'$.alerts_by_seed'", "i", [_is(_SEED_AT, "OBJECT"), *_kinds(_SEED_AT, text="label seed_address"), *_kinds(_SEED_AT, number="count")]),
        _is("'$.recent'", "OBJECT"), *_kinds("'$.recent'", number="blocks"), _is("'$.recent.by_origin'", "OBJECT"), *_kinds("'$.recent.by_origin'", number=_COUNTED)],
    "clusters": [*_kinds("'$'", text="level"), *_kinds("'$'", number="n"), _is("'$.clusters'", "ARRAY"), _items("'$.clusters'", "i", [
        _is(_CLUSTER_AT, "OBJECT"), *_kinds(_CLUSTER_AT, text="level key"), _is(f"({_CLUSTER_AT} || '.members')", "ARRAY"),
        _items(f"({_CLUSTER_AT} || '.members')", "m", [_is(f"({_CLUSTER_AT} || '.members[' || m || ']')", "VARCHAR")])])],
}
_FIGURES = {"health": "progress", "events": "last_id", "summary": "addresses", "clusters": "n"}
SQL["c16_valid_answers"] = f"""
WITH {BUILT},{ANSWERS},
parsed AS (SELECT p_partkey, what, CASE WHEN json_valid(answer) THEN CAST(answer AS JSON) END AS j FROM answers),
judged AS (SELECT *, CASE WHEN j IS NULL OR json_type(j) <> 'OBJECT' THEN '$' {' '.join(f"WHEN what = '{w}' THEN coalesce({', '.join(c)})" for w, c in _FAULTS.items())} END AS fault FROM parsed)
SELECT p_partkey, what, fault, CASE WHEN fault IS NULL THEN CASE what {' '.join(f"WHEN '{w}' THEN CAST(json_extract_string(j, '$.{m}') AS DOUBLE)" for w, m in _FIGURES.items())} END END AS figure FROM judged"""
