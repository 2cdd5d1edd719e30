"""DuckDB SQL for every registered query: the independent oracle of the correctness gate.

DuckDB here has no spatial extension, so the SQL rebuilds the derived layers
with integer arithmetic and decides every contact by interval comparison,
closes groups with recursive CTEs and ranks new ids with a window.  Column
names equal those of :mod:`sheetseam.catalog`.
"""

from __future__ import annotations

import re

from sheetseam.functions.grid import NONSTANDARD_SET
from sheetseam.catalog import DETECT_TABLES

NONSTD_LIST = ", ".join(str(v) for v in NONSTANDARD_SET)


def ns(v: str) -> str:
    return f"(({v} - 6000) % 36000 = 0 AND ({v} - 6000) // 36000 > 131 AND ({v} - 6000) // 36000 < 172)"


def ew(v: str) -> str:
    return f"(({v} - 4000) % 24000 = 0 AND ({v} - 4000) // 24000 > 45 AND ({v} - 4000) // 24000 < 87)"


def nonstd(v: str) -> str:
    return f"(CAST(round({v}) AS BIGINT) IN ({NONSTD_LIST}))"


def ns_filter(t: str) -> str:
    return f"((({t}.nv % 1000 = 0) AND {ns(t + '.nv')}) OR (({t}.sv % 1000 = 0) AND {ns(t + '.sv')}) OR {nonstd(t + '.nv')} OR {nonstd(t + '.sv')})"


def ew_filter(t: str) -> str:
    return f"((({t}.ev % 1000 = 0) AND {ew(t + '.ev')}) OR (({t}.wv % 1000 = 0) AND {ew(t + '.wv')}) OR {nonstd(t + '.ev')} OR {nonstd(t + '.wv')})"


POLY = """poly AS (
  SELECT o_orderkey AS ufid, o_orderkey AS ogc_fid, o_orderkey // 1599 AS slot, o_orderpriority AS cls,
         1108000 + 24000 * ((o_orderkey // 39) % 41) AS wv,
         1108000 + 24000 * ((o_orderkey // 39) % 41) + 24000 AS ev,
         4758000 + 36000 * (o_orderkey % 39) AS sv,
         4758000 + 36000 * (o_orderkey % 39) + 36000 AS nv
  FROM orders)"""

LINE = """line0 AS (
  SELECT 2 * event_id AS ufid, 2 * event_id AS ogc_fid, event_id // 1599 AS slot, event_type AS cls,
         1120000 + 24000 * ((event_id // 39) % 41) AS x1, 4758000 + 36000 * (event_id % 39) AS y1,
         1120000 + 24000 * ((event_id // 39) % 41) AS x2, 4758000 + 36000 * (event_id % 39) + 36000 AS y2
  FROM events
  UNION ALL
  SELECT 2 * event_id + 1, 2 * event_id + 1, event_id // 1599, event_type,
         1120000 + 24000 * ((event_id // 39) % 41) + 1000, 4758000 + 36000 * (event_id % 39),
         1120000 + 24000 * ((event_id // 39) % 41), 4758000 + 36000 * (event_id % 39) + 36000
  FROM events WHERE event_id % 7 = 0),
line AS (SELECT *, least(x1, x2) AS wv, greatest(x1, x2) AS ev, least(y1, y2) AS sv, greatest(y1, y2) AS nv,
                2 AS npts, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS len FROM line0)"""

REGIONS = """regions(region, rx0, ry0, rx1, ry1) AS (
  VALUES ('north', 1100000, 5460000, 2100000, 6200000), ('south', 1100000, 4700000, 2100000, 5460000))"""


def member_regions(src: str, name: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT p.ufid, r.region FROM {src} p JOIN regions r
  ON p.wv <= r.rx1 AND p.ev >= r.rx0 AND p.sv <= r.ry1 AND p.nv >= r.ry0)"""


def common_region(reg: str, a: str, b: str) -> str:
    return f"EXISTS (SELECT 1 FROM {reg} x JOIN {reg} y ON x.region = y.region WHERE x.ufid = {a}.ufid AND y.ufid = {b}.ufid)"


def components(pairs: str, name: str) -> str:
    return f"""{name}_e AS (SELECT merge_id AS a, drop_id AS b FROM {pairs} UNION ALL SELECT drop_id, merge_id FROM {pairs}),
{name}_r(id, comp) AS (SELECT a, a FROM {name}_e UNION SELECT e.b, r.comp FROM {name}_r r JOIN {name}_e e ON e.a = r.id),
{name} AS MATERIALIZED (SELECT id, min(comp) AS comp FROM {name}_r GROUP BY id)"""


ATTRS = "a.slot IS NOT DISTINCT FROM b.slot AND a.cls IS NOT DISTINCT FROM b.cls"

# ---------------------------------------------------------------- polygon layer, both passes
POLY_PASSES = f"""{POLY},
{REGIONS},
{member_regions('poly', 'preg')},
polyr AS MATERIALIZED (SELECT * FROM poly SEMI JOIN preg ON preg.ufid = poly.ufid),
pns AS MATERIALIZED (SELECT DISTINCT greatest(a.ufid, b.ufid) AS merge_id, least(a.ufid, b.ufid) AS drop_id
  FROM polyr a JOIN polyr b ON a.nv = b.sv AND {ATTRS} AND least(a.ev, b.ev) > greatest(a.wv, b.wv) AND a.ufid <> b.ufid
  WHERE a.nv % 1000 = 0 AND b.sv % 1000 = 0 AND {ns_filter('a')} AND {ns_filter('b')} AND {common_region('preg', 'a', 'b')}),
{components('pns', 'pm1')},
p1 AS MATERIALIZED (
  SELECT ufid, ogc_fid, slot, cls, wv, ev, sv, nv, [ufid] AS comps FROM polyr ANTI JOIN pm1 ON pm1.id = polyr.ufid
  UNION ALL
  SELECT m.comp, max(p.ogc_fid), any_value(p.slot), any_value(p.cls), min(p.wv), max(p.ev), min(p.sv), max(p.nv), list_sort(list(p.ufid))
  FROM pm1 m JOIN polyr p ON p.ufid = m.id GROUP BY m.comp),
p1reg AS MATERIALIZED (SELECT DISTINCT coalesce(m.comp, r.ufid) AS ufid, r.region FROM preg r LEFT JOIN pm1 m ON m.id = r.ufid),
pew AS MATERIALIZED (SELECT DISTINCT greatest(a.ufid, b.ufid) AS merge_id, least(a.ufid, b.ufid) AS drop_id
  FROM p1 a JOIN p1 b ON a.ev = b.wv AND {ATTRS} AND least(a.nv, b.nv) > greatest(a.sv, b.sv) AND a.ufid <> b.ufid
  WHERE a.ev % 1000 = 0 AND b.wv % 1000 = 0 AND {ew_filter('a')} AND {ew_filter('b')} AND {common_region('p1reg', 'a', 'b')}),
{components('pew', 'pm2')},
pfin AS MATERIALIZED (
  SELECT ufid, ogc_fid, slot, cls, wv, ev, sv, nv, comps FROM p1 ANTI JOIN pm2 ON pm2.id = p1.ufid
  UNION ALL
  SELECT m.comp, max(p.ogc_fid), any_value(p.slot), any_value(p.cls), min(p.wv), max(p.ev), min(p.sv), max(p.nv), list_sort(flatten(list(p.comps)))
  FROM pm2 m JOIN p1 p ON p.ufid = m.id GROUP BY m.comp),
pids AS (SELECT comps[1] AS first, 100000000 + row_number() OVER (ORDER BY comps[1]) - 1 AS nid FROM pfin WHERE len(comps) > 1),
pfinal AS (SELECT coalesce(i.nid, f.ufid) AS fid, f.* FROM pfin f LEFT JOIN pids i ON len(f.comps) > 1 AND i.first = f.comps[1])"""

# ---------------------------------------------------------------- line layer, both passes
def _top_x(t: str) -> str:
    return f"(CASE WHEN {t}.y1 >= {t}.y2 THEN {t}.x1 ELSE {t}.x2 END)"


def _bottom_x(t: str) -> str:
    return f"(CASE WHEN {t}.y1 <= {t}.y2 THEN {t}.x1 ELSE {t}.x2 END)"


def _y_at(t: str, x: str) -> str:
    return f"(CASE WHEN {t}.x1 = {x} THEN {t}.y1 ELSE {t}.y2 END)"


def _ew_touch(a: str, b: str) -> str:
    """a lies west of x = v = a.ev = b.wv, b east; segments; FF1F00102 on the line x = v."""
    av = f"({a}.wv = {a}.ev)"
    bv = f"({b}.wv = {b}.ev)"
    ay = _y_at(a, f"{a}.ev")
    by = _y_at(b, f"{b}.wv")
    return f"""(CASE
      WHEN {av} AND {bv} THEN ({a}.nv = {b}.sv OR {b}.nv = {a}.sv)
      WHEN {av} THEN ({by} = {a}.sv OR {by} = {a}.nv)
      WHEN {bv} THEN ({ay} = {b}.sv OR {ay} = {b}.nv)
      ELSE {ay} = {by} END)"""


def _ends(src: str, memb: str) -> str:
    return f"""SELECT m.comp, l.x1 AS x, l.y1 AS y FROM {memb} m JOIN {src} l ON l.ufid = m.id
  UNION ALL SELECT m.comp, l.x2, l.y2 FROM {memb} m JOIN {src} l ON l.ufid = m.id"""


LINE_PASSES = f"""{LINE},
{REGIONS},
{member_regions('line', 'lreg')},
lr AS MATERIALIZED (SELECT * FROM line SEMI JOIN lreg ON lreg.ufid = line.ufid),
lns AS MATERIALIZED (SELECT DISTINCT greatest(a.ufid, b.ufid) AS merge_id, least(a.ufid, b.ufid) AS drop_id
  FROM lr a JOIN lr b ON a.nv = b.sv AND {ATTRS} AND a.ufid <> b.ufid AND {_top_x('a')} = {_bottom_x('b')}
  WHERE a.nv % 1000 = 0 AND b.sv % 1000 = 0 AND {ns_filter('a')} AND {ns_filter('b')} AND {common_region('lreg', 'a', 'b')}),
{components('lns', 'lm1')},
ldeg1 AS (SELECT comp, max(c) AS maxdeg FROM (SELECT comp, x, y, count(*) AS c FROM ({_ends('lr', 'lm1')}) GROUP BY comp, x, y) GROUP BY comp),
l1 AS MATERIALIZED (
  SELECT ufid, ogc_fid, slot, cls, x1, y1, x2, y2, wv, ev, sv, nv, npts, len, [ufid] AS comps FROM lr
  WHERE ufid NOT IN (SELECT m.id FROM lm1 m JOIN ldeg1 d ON d.comp = m.comp WHERE d.maxdeg <= 2)
  UNION ALL
  SELECT m.comp, max(l.ogc_fid), any_value(l.slot), any_value(l.cls), min(l.wv), min(l.sv), max(l.ev), max(l.nv),
         min(l.wv), max(l.ev), min(l.sv), max(l.nv), sum(l.npts) - count(*) + 1, sum(l.len), list_sort(list(l.ufid))
  FROM lm1 m JOIN lr l ON l.ufid = m.id JOIN ldeg1 d ON d.comp = m.comp WHERE d.maxdeg <= 2 GROUP BY m.comp),
l1reg AS MATERIALIZED (SELECT DISTINCT coalesce(m.comp, r.ufid) AS ufid, r.region FROM lreg r
  LEFT JOIN (SELECT m.* FROM lm1 m JOIN ldeg1 d ON d.comp = m.comp WHERE d.maxdeg <= 2) m ON m.id = r.ufid),
lew AS MATERIALIZED (SELECT DISTINCT greatest(a.ufid, b.ufid) AS merge_id, least(a.ufid, b.ufid) AS drop_id
  FROM l1 a JOIN l1 b ON a.ev = b.wv AND {ATTRS} AND a.ufid <> b.ufid AND {_ew_touch('a', 'b')}
  WHERE a.ev % 1000 = 0 AND b.wv % 1000 = 0 AND {ew_filter('a')} AND {ew_filter('b')} AND {common_region('l1reg', 'a', 'b')}),
{components('lew', 'lm2')},
ldeg2 AS (SELECT comp, max(c) AS maxdeg FROM (SELECT comp, x, y, count(*) AS c FROM ({_ends('l1', 'lm2')}) GROUP BY comp, x, y) GROUP BY comp),
lfin AS MATERIALIZED (
  SELECT ufid, ogc_fid, slot, cls, npts, len, comps FROM l1
  WHERE ufid NOT IN (SELECT m.id FROM lm2 m JOIN ldeg2 d ON d.comp = m.comp WHERE d.maxdeg <= 2)
  UNION ALL
  SELECT m.comp, max(l.ogc_fid), any_value(l.slot), any_value(l.cls), sum(l.npts) - count(*) + 1, sum(l.len), list_sort(flatten(list(l.comps)))
  FROM lm2 m JOIN l1 l ON l.ufid = m.id JOIN ldeg2 d ON d.comp = m.comp WHERE d.maxdeg <= 2 GROUP BY m.comp),
lids AS (SELECT comps[1] AS first, 100000000 + row_number() OVER (ORDER BY comps[1]) - 1 AS nid FROM lfin WHERE len(comps) > 1),
lfinal AS (SELECT coalesce(i.nid, f.ufid) AS fid, f.* FROM lfin f LEFT JOIN lids i ON len(f.comps) > 1 AND i.first = f.comps[1]),
lreport AS (
  SELECT m.id AS ref, 'Mapsheet boundary-join error for table northsouth_line' AS msg FROM lm1 m JOIN ldeg1 d ON d.comp = m.comp WHERE d.maxdeg > 2
  UNION ALL
  SELECT f.fid, 'Mapsheet boundary-join error for table eastwest_line' FROM lm2 m JOIN ldeg2 d ON d.comp = m.comp JOIN lfinal f ON f.ufid = m.id WHERE d.maxdeg > 2)"""


def northern_poly() -> str:
    """The polygon passes over the northern sheet rows only, under names that begin with q."""
    text = POLY_PASSES.replace(REGIONS + ",\n", "").replace("FROM orders)", "FROM orders WHERE o_orderkey % 39 >= 20)")
    names = "poly preg polyr pns pm1 pm1_e pm1_r p1 p1reg pew pm2 pm2_e pm2_r pfin pids pfinal".split()
    return re.sub(rf"\b({'|'.join(names)})\b", r"q\1", text)


LINES_ONLY = LINE_PASSES.replace(REGIONS + ",", "", 1)


def with_poly(body: str) -> str:
    return f"WITH RECURSIVE {POLY_PASSES}\n{body}"


def with_line(body: str) -> str:
    return f"WITH RECURSIVE {LINE_PASSES}\n{body}"


BOTH = f"""{POLY},
{LINE},
feat AS (
  SELECT 'poly' AS layer, ufid, 'POLYGON' AS gtype, 5 AS n_points, wv, sv, ev, nv, (ev - wv) * (nv - sv) AS area, 2 * ((ev - wv) + (nv - sv)) AS length FROM poly
  UNION ALL
  SELECT 'line', ufid, 'LINESTRING', 2, wv, sv, ev, nv, 0, len FROM line)"""


def with_both(body: str) -> str:
    return f"WITH {BOTH}\n{body}"


def detect_key_sql(columns: dict[str, list[str]]) -> str:
    parts = []
    for t in DETECT_TABLES:
        cols = [c for c in columns[t] if c not in ("ogc_fid", "geom")]
        cases = " ".join(
            f"WHEN (SELECT max(c) FROM (SELECT count(*) AS c FROM {t} GROUP BY {c})) = 1 THEN '{c}'" for c in cols
        )
        parts.append(f"SELECT '{t}' AS table_name, CASE {cases} ELSE 'ufid' END AS key_column")
    return "\nUNION ALL\n".join(parts)


# table columns in schema order (the driver's tables; fixed by TESTDATA)
TABLE_COLUMNS = {
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "region": ["r_regionkey", "r_name"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
}


# ids in the log of earlier runs: the latest of a group, and its largest
LOG_LATEST = "CASE WHEN comps[1] % 5 = 0 THEN 400000000 + comps[1] WHEN comps[1] % 3 <> 0 THEN 300000000 + comps[1] ELSE 200000000 + comps[1] END"
LOG_MAX = LOG_LATEST


def _comps_txt(c: str = "comps") -> str:
    return f"array_to_string({c}, ',')"


# loops go, what they hung at is sewn: the piece of two units; the loop that is all there is; the piece of one unit; the fork
LOOP_SQL = """SELECT o_orderkey AS ufid, CASE WHEN o_orderkey % 6 = 5 THEN 'MULTILINESTRING' ELSE 'LINESTRING' END AS gtype,
  CASE WHEN o_orderkey % 6 = 5 THEN 3 ELSE 1 END AS n_parts, CASE o_orderkey % 6 WHEN 3 THEN 4 WHEN 4 THEN 2 WHEN 5 THEN 6 ELSE 3 END AS n_vertices,
  CAST(round(10 * (o_orderkey % 7 + 1) * CASE o_orderkey % 6 WHEN 3 THEN 3 + 3 + sqrt(18) WHEN 4 THEN 1 WHEN 5 THEN 5 ELSE 2 END) AS BIGINT) AS length FROM orders"""
# without the first vertex: a path past the point and one through it; the path vanishes; nothing to do; four are not three
TRIPLE_SQL = """SELECT o_orderkey AS ufid, CASE WHEN o_orderkey % 4 IN (0, 3) THEN 'MULTILINESTRING' ELSE 'LINESTRING' END AS gtype,
  CASE o_orderkey % 4 WHEN 0 THEN 2 WHEN 3 THEN 4 ELSE 1 END AS n_parts, CASE o_orderkey % 4 WHEN 0 THEN 5 WHEN 3 THEN 8 ELSE 3 END AS n_vertices,
  CAST(round(10 * (o_orderkey % 7 + 1) * CASE o_orderkey % 4 WHEN 0 THEN 2 * sqrt(32) WHEN 3 THEN 4 * sqrt(8) ELSE 2 * sqrt(8) END) AS BIGINT) AS length FROM orders"""


SQL: dict[str, str] = {
    "scan_layer_dir": "SELECT 'lineitem' AS layer, count(*) AS features FROM lineitem UNION ALL SELECT 'orders', count(*) FROM orders",
    "layer_inventory": with_both(
        """SELECT layer, gtype, count(*) AS features, min(wv) AS xmin, min(sv) AS ymin, max(ev) AS xmax, max(nv) AS ymax
           FROM (SELECT * FROM feat UNION ALL SELECT 'mixed', * EXCLUDE (layer) FROM feat) GROUP BY layer, gtype"""
    ),
    "verify_copy": f"""WITH {POLY}, {LINE}, n AS (SELECT (SELECT count(*) FROM poly) AS p, (SELECT count(*) FROM line) AS l)
        SELECT true AS name_ok, true AS type_ok, true AS count_ok, p AS source_features, p AS copy_features FROM n
        UNION ALL SELECT false, false, p = l, p, l FROM n""",
    "region_join_shapes": f"""WITH {POLY},
        shapes AS (
          SELECT ufid, 'triangle' AS region FROM poly WHERE wv <= 1708000 AND sv <= 5358000 AND ev >= 1108000 AND nv >= 4758000
            AND greatest(wv, 1108000) - 1108000 + greatest(sv, 4758000) - 4758000 <= 600000
          UNION ALL SELECT ufid, 'holed' FROM poly WHERE wv <= 2008000 AND ev >= 1108000 AND sv <= 5658000 AND nv >= 4758000
            AND NOT (wv > 1208000 AND ev < 1808000 AND sv > 4858000 AND nv < 5458000)
          UNION ALL SELECT ufid, 'parts' FROM poly WHERE (wv <= 1198000 AND ev >= 1108000 AND sv <= 4848000 AND nv >= 4758000)
            OR (wv <= 2018000 AND ev >= 1608000 AND sv <= 5368000 AND nv >= 5258000)
          UNION ALL SELECT p.ufid, 'strip' || (3 * n.n_nationkey + j.j) FROM poly p, nation n, (VALUES (0), (1), (2)) j(j)
            WHERE p.wv <= 1113000 + 13000 * (3 * n.n_nationkey + j.j) AND p.ev >= 1108000 + 13000 * (3 * n.n_nationkey + j.j) AND p.sv <= 6758000 AND p.nv >= 4757000)
        SELECT ufid, region FROM shapes""",
    "dissolve_overlaps": """WITH m AS (SELECT o_custkey AS comp, (o_orderkey % 7) * 1000 AS w, (o_orderkey // 7 % 5) * 1000 AS s,
            (o_orderkey % 7) * 1000 + (o_orderkey % 3 + 1) * 2000 AS e, (o_orderkey // 7 % 5) * 1000 + (o_orderkey // 3 % 4 + 1) * 1500 AS n FROM orders),
        cells AS (SELECT DISTINCT comp, x, y FROM (SELECT comp, s, n, unnest(range(w, e, 500)) AS x FROM m) t, LATERAL (SELECT unnest(range(t.s, t.n, 500)) AS y) u),
        a AS (SELECT comp, count(*) * 250000 AS area FROM cells GROUP BY comp)
        SELECT a.comp, a.area, min(m.w) AS xmin, min(m.s) AS ymin, max(m.e) AS xmax, max(m.n) AS ymax FROM a JOIN m ON m.comp = a.comp GROUP BY a.comp, a.area""",
    "write_layer": "SELECT o_orderpriority AS cls, count(*) AS features FROM orders GROUP BY o_orderpriority",
    "scan_stored_layers": f"WITH {LINE} SELECT 'new_line' AS layer, count(*) AS features FROM line UNION ALL SELECT 'new_poly', count(*) FROM orders",
    "export_layer": f"WITH {POLY} SELECT ufid, cls, (ev - wv) * (nv - sv) AS area, wv AS xmin, nv AS ymax FROM poly",
    "link_views": f"""WITH {LINE} SELECT 'line' AS layer, count(*) AS features FROM line UNION ALL SELECT 'poly', count(*) FROM orders
        UNION ALL SELECT 'polygon', count(*) FROM line""",
    "release_snapshot": f"""WITH {LINE} SELECT 'line' AS layer, count(*) AS features FROM line UNION ALL SELECT 'poly', count(*) FROM orders
        UNION ALL SELECT 'polygon', count(*) FROM line""",
    "revisioned_write": """WITH r AS (SELECT unnest([1, 2, 3, 4, 5]) AS as_of), s AS (
          SELECT as_of, CASE WHEN as_of >= 5 AND o_orderkey % 8 = 0 THEN 'put back' WHEN as_of >= 3 AND o_orderkey % 4 = 0 THEN NULL
            WHEN as_of >= 2 AND o_orderkey % 6 = 0 THEN 'edited twice' WHEN as_of >= 2 AND o_orderkey % 3 = 0 THEN 'edited' ELSE o_orderpriority END AS cls FROM orders, r)
        SELECT as_of, cls, count(*) AS features FROM s WHERE cls IS NOT NULL GROUP BY as_of, cls""",
    "wkt_rejects": """SELECT reason, count(*) AS listed, min(o_orderkey) AS first, max(c) AS counted FROM (
          SELECT *, count(*) OVER (PARTITION BY CASE WHEN reason LIKE 'type %' THEN 'type' ELSE reason END) AS c FROM (
            SELECT o_orderkey, ['read', 'broken', 'empty', 'type MULTIPOINT', 'type GEOMETRYCOLLECTION', 'no text', 'broken'][o_orderkey % 7 + 1] AS reason FROM orders)) GROUP BY reason""",
    "wkt_ingest": with_both(
        "SELECT layer, ufid, gtype, n_points, wv AS xmin, sv AS ymin, ev AS xmax, nv AS ymax, CAST(area AS BIGINT) AS area, CAST(round(length) AS BIGINT) AS length FROM feat"
    ),
    "assign_srid": f"WITH {LINE} SELECT 'poly' AS layer, 2193 AS srid, count(*) AS features FROM orders UNION ALL SELECT 'line', 27200, count(*) FROM line",
    "text_fidelity_check": """SELECT copy, count(*) AS n_flagged, CAST(sum(CASE WHEN copy = 'damaged' AND doc_id % 97 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_mismatch
        FROM documents, (VALUES ('whole'), ('damaged')) c(copy) WHERE regexp_matches(text, '[^\\x00-\\x7F]') GROUP BY copy""",
    "select_except": f"WITH {POLY} SELECT ufid, slot, cls FROM poly",
    "excise_column": "SELECT 'lineitem' AS layer, 11 AS n_columns, count(*) AS features FROM lineitem UNION ALL SELECT 'orders', 5, count(*) FROM orders",
    "on_northsouth": with_both(f"SELECT v, {ns('v')} AS on_ns FROM (SELECT nv AS v FROM feat UNION SELECT sv FROM feat)"),
    "on_eastwest": with_both(f"SELECT v, {ew('v')} AS on_ew FROM (SELECT ev AS v FROM feat UNION SELECT wv FROM feat)"),
    "on_nonstandard": with_both(
        f"SELECT v, {nonstd('v')} AS on_irregular FROM (SELECT nv AS v FROM feat UNION SELECT sv FROM feat UNION SELECT ev FROM feat UNION SELECT wv FROM feat)"
    ),
    "bbox_values": with_both("SELECT layer, ufid, nv, sv, ev, wv FROM feat"),
    "boundary_flags": with_both("SELECT layer, ufid, nv % 1000 = 0 AS n, sv % 1000 = 0 AS s, ev % 1000 = 0 AS e, wv % 1000 = 0 AS w FROM feat"),
    "boundary_filter": with_both(f"SELECT layer, ufid, {ns_filter("feat")} AS pass_ns, {ew_filter("feat")} AS pass_ew FROM feat"),
    "snap_to_grid": f"""WITH {POLY} SELECT ufid,
        round(CAST(wv AS DOUBLE) / 1e-11) * 1e-11 AS sxmin, round(CAST(sv AS DOUBLE) / 1e-11) * 1e-11 AS symin,
        round(CAST(ev AS DOUBLE) / 1e-11) * 1e-11 AS sxmax, round(CAST(nv AS DOUBLE) / 1e-11) * 1e-11 AS symax FROM poly""",
    "detect_key": detect_key_sql(TABLE_COLUMNS),
    "geometry_type_dispatch": f"""WITH {POLY}, {LINE}
        SELECT 'line' AS layer, 'LINESTRING' AS gtype, 'line' AS handling
        UNION ALL SELECT 'poly', 'POLYGON', 'polygon'
        UNION ALL SELECT 'mixed', CASE WHEN (SELECT count(*) FROM poly) >= (SELECT count(*) FROM line) THEN 'POLYGON' ELSE 'LINESTRING' END,
                         CASE WHEN (SELECT count(*) FROM poly) >= (SELECT count(*) FROM line) THEN 'polygon' ELSE 'line' END""",
    "purge_minority_geometry": f"""WITH {POLY}, {LINE}, c AS (SELECT 'POLYGON' AS gtype, count(*) AS n FROM poly UNION ALL SELECT 'LINESTRING', count(*) FROM line)
        SELECT gtype, n FROM c WHERE n > (SELECT min(n) FROM c) OR (n = (SELECT min(n) FROM c) AND gtype > (SELECT min(gtype) FROM c WHERE n = (SELECT min(n) FROM c)))""",
    "region_join": f"""WITH {REGIONS}, {BOTH}
        SELECT b.layer, b.ufid, r.region FROM feat b JOIN regions r ON b.wv <= r.rx1 AND b.ev >= r.rx0 AND b.sv <= r.ry1 AND b.nv >= r.ry0""",
}


def _poly_face(src: str, more: str = "") -> str:
    return f"""SELECT DISTINCT greatest(a.ufid, b.ufid) AS merge_id, least(a.ufid, b.ufid) AS drop_id{more}
  FROM {src} a JOIN {src} b ON a.nv = b.sv AND {ATTRS} AND least(a.ev, b.ev) >= greatest(a.wv, b.wv) AND a.ufid <> b.ufid
  WHERE a.nv % 1000 = 0 AND b.sv % 1000 = 0 AND {ns_filter('a')} AND {ns_filter('b')} AND {common_region('preg', 'a', 'b')}"""


JOINTS = """joints AS (SELECT s_suppkey AS k, row_number() OVER (ORDER BY s_suppkey) + 99999999 AS fid FROM supplier)"""


SQL.update(
    {
        "face_join": with_poly(_poly_face("polyr")),
        "attr_null_safe": with_poly(_poly_face("(SELECT * REPLACE (CASE WHEN ufid % 5 <> 0 THEN cls END AS cls) FROM polyr)", ", a.cls AS cls")),
        "relate_polygons": with_poly("SELECT merge_id, drop_id FROM pns"),
        "relate_lines": with_line("SELECT merge_id, drop_id FROM lns"),
        "relate_near_polygons": "SELECT 2 * c_custkey + 1 AS merge_id, 2 * c_custkey AS drop_id FROM customer WHERE c_custkey % 6 IN (0, 3)",
        "relate_near_lines": "SELECT 2 * c_custkey + 1 AS merge_id, 2 * c_custkey AS drop_id FROM customer WHERE c_custkey % 6 IN (0, 5)",
        "order_join_list": with_poly("SELECT merge_id, drop_id FROM pns ORDER BY merge_id, drop_id"),
        "unmerged_anti_join": with_poly("SELECT ufid FROM poly WHERE ufid NOT IN (SELECT merge_id FROM pns UNION SELECT drop_id FROM pns)"),
        "member_join": with_poly("SELECT p.ufid, m.comp, p.slot, p.cls, p.wv AS xmin, p.sv AS ymin FROM pm1 m JOIN poly p ON p.ufid = m.id"),
        "fallback_join": with_line(
            """SELECT l.ufid, m.comp, l.slot, l.cls, CAST(round(l.len) AS BIGINT) AS length
               FROM lm1 m JOIN ldeg1 d ON d.comp = m.comp JOIN lr l ON l.ufid = m.id WHERE d.maxdeg > 2"""
        ),
        "array_union_agg": "SELECT l_orderkey, array_to_string(list_sort(list_distinct(flatten(list([l_partkey, l_suppkey])))), ',') AS ids FROM lineitem GROUP BY l_orderkey",
        "connected_components": with_poly("SELECT comp, array_to_string(list_sort(list(id)), ',') AS flist, count(*) AS n FROM pm1 GROUP BY comp"),
        "maximal_sets": with_poly("SELECT array_to_string(list_sort(list(id)), ',') AS flist FROM pm1 GROUP BY comp"),
        "merge_attributes": with_poly("SELECT m.comp, max(p.ogc_fid) AS ogc_fid, any_value(p.slot) AS slot, any_value(p.cls) AS cls FROM pm1 m JOIN poly p ON p.ufid = m.id GROUP BY m.comp"),
        "collect_geometry": with_poly("SELECT comp, 'MULTIPOLYGON' AS gtype, count(*) AS n_parts FROM pm1 GROUP BY comp"),
        "dissolve_polygons": with_poly(
            """SELECT m.comp, 'POLYGON' AS gtype, sum((p.ev - p.wv) * (p.nv - p.sv)) AS area, 2 * count(*) + 2 AS n_vertices,
               min(p.wv) AS xmin, min(p.sv) AS ymin, max(p.ev) AS xmax, max(p.nv) AS ymax FROM pm1 m JOIN poly p ON p.ufid = m.id GROUP BY m.comp"""
        ),
        "merge_lines": with_line(
            f"""SELECT m.comp, d.maxdeg <= 2 AS accepted, CASE WHEN d.maxdeg <= 2 THEN 'LINESTRING' ELSE 'MULTILINESTRING' END AS gtype,
               count(*) - coalesce(max(s.sewn), 0) AS n_parts, sum(l.npts) - coalesce(max(s.sewn), 0) AS n_vertices, CAST(round(sum(l.len)) AS BIGINT) AS length
               FROM lm1 m JOIN lr l ON l.ufid = m.id JOIN ldeg1 d ON d.comp = m.comp
               LEFT JOIN (SELECT comp, count(*) AS sewn FROM (SELECT comp, x, y FROM ({_ends('lr', 'lm1')}) GROUP BY comp, x, y HAVING count(*) = 2) GROUP BY comp) s ON s.comp = m.comp
               GROUP BY m.comp, d.maxdeg"""
        ),
        "layer_extent": with_both("SELECT layer, min(wv) AS xmin, min(sv) AS ymin, max(ev) AS xmax, max(nv) AS ymax FROM feat GROUP BY layer"),
        "assemble_components": with_poly(f"SELECT comps[1] AS comp, {_comps_txt()} AS components FROM pfin WHERE len(comps) > 1"),
        "duplicate_keys": "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1",
        "distinct_rows": with_poly("SELECT ufid, slot, cls FROM polyr"),
        "normalise_ids": "SELECT l_orderkey, l_linenumber, array_to_string(list_sort(list_distinct([l_suppkey, l_partkey, l_suppkey, l_orderkey])), ',') AS ids FROM lineitem",
        "union_ids": with_poly("SELECT merge_id AS id FROM pns UNION SELECT drop_id FROM pns"),
        "union_merged_fallback": with_line(
            """SELECT ufid, CASE WHEN len(comps) > 1 THEN 'merged' WHEN ufid IN (SELECT m.id FROM lm1 m JOIN ldeg1 d ON d.comp = m.comp WHERE d.maxdeg > 2)
               THEN 'fallback' ELSE 'unmerged' END AS kind FROM l1"""
        ),
        "union_regions": with_poly("SELECT p.ufid, string_agg(r.region, ',' ORDER BY r.region) AS regions FROM p1 p JOIN p1reg r ON r.ufid = p.ufid GROUP BY p.ufid"),
        "stable_ids": with_poly(
            f"""SELECT coalesce(logged, (SELECT max({LOG_MAX}) FROM pfin WHERE len(comps) > 1) + row_number() OVER (PARTITION BY logged IS NULL ORDER BY first)) AS ufid,
                {_comps_txt()} AS components
                FROM (SELECT comps, comps[1] AS first, CASE WHEN comps[1] % 7 <> 0 THEN {LOG_LATEST} END AS logged FROM pfin WHERE len(comps) > 1)"""
        ),
        "import_process_export": with_poly(
            """SELECT cls, count(*) AS features, sum(CASE WHEN len(comps) > 1 THEN 1 ELSE 0 END) AS composites,
               sum(CASE WHEN len(comps) > 1 THEN 1 ELSE 0 END) AS logged, sum(len(comps)) * 864000000 AS area FROM pfinal GROUP BY cls"""
        ),
        "component_by_id": with_poly(f"SELECT 'new_poly' AS layer, fid AS ufid, {_comps_txt()} AS components FROM pfinal WHERE len(comps) > 1 AND fid = 100000000"),
        "allocate_ids": with_line(f"SELECT fid AS ufid, {_comps_txt()} AS components FROM lfinal WHERE len(comps) > 1"),
        "assign_final_ids": with_poly("SELECT fid AS ufid, len(comps) > 1 AS is_composite FROM pfinal"),
        "finalise_layer": with_poly(
            """SELECT fid AS ufid, ogc_fid, slot, cls, 'POLYGON' AS gtype, CAST(len(comps) AS BIGINT) * 864000000 AS area,
               wv AS xmin, sv AS ymin, ev AS xmax, nv AS ymax, CAST(len(comps) AS BIGINT) AS n_components FROM pfinal"""
        ),
        "stitch_layer": with_line(
            """SELECT fid AS ufid, ogc_fid, slot, cls, 'LINESTRING' AS gtype, CAST(round(len) AS BIGINT) AS length,
               CAST(npts AS BIGINT) AS n_points, CAST(len(comps) AS BIGINT) AS n_components FROM lfinal"""
        ),
        "append_associations": with_poly(f"SELECT 'new_poly' AS layer, fid AS ufid, {_comps_txt()} AS components FROM pfinal WHERE len(comps) > 1"),
        "append_report": with_line("SELECT ref, msg FROM lreport"),
        "component_lookup": with_poly("SELECT unnest(comps) AS component, fid AS ufid FROM pfinal WHERE len(comps) > 1"),
        "duplicate_check": with_poly("SELECT fid AS ufid, count(*) AS n FROM pfinal GROUP BY fid HAVING count(*) > 1"),
        "single_part_filter": with_line("SELECT comp, maxdeg <= 2 AS accepted FROM ldeg1"),
        "drop_components": with_poly("SELECT fid AS ufid, ogc_fid, slot, cls FROM pfinal"),
        "assoc_lookup": with_poly(
            f"""SELECT array_to_string(CASE WHEN comps[1] % 7 = 0 THEN comps[1:len(comps) - 1] ELSE comps END, ',') AS components, {LOG_LATEST} AS ufid
                FROM pfin WHERE len(comps) > 1"""
        ),
        "contains_join": with_poly(
            "SELECT f.fid AS ufid, m.member, p.slot FROM (SELECT fid, unnest(comps) AS member FROM pfinal WHERE len(comps) > 1) m "
            "JOIN pfinal f ON f.fid = m.fid JOIN poly p ON p.ufid = m.member"
        ),
        "report_assoc_join": f"""WITH {JOINTS} SELECT fid AS ref, 'Mapsheet boundary-join error for table eastwest_joints' AS msg, fid AS ufid, (4 * k) || ',' || (4 * k + 1) AS components FROM joints""",
        "fallback_join_ew": f"""WITH {JOINTS} SELECT fid AS ufid, (4 * k) || ',' || (4 * k + 1) AS components, 3 AS n_points FROM joints
            UNION ALL SELECT 4 * k + j, CAST(4 * k + j AS VARCHAR), 2 FROM joints, (VALUES (2), (3)) t(j)""",
        "identify_pass": f"""WITH RECURSIVE {POLY_PASSES},\n{LINE_PASSES.replace(REGIONS + ',', '', 1)}
            SELECT 'poly' AS layer, merge_id, drop_id FROM pns UNION ALL SELECT 'line', merge_id, drop_id FROM lns""",
        "merge_pass": with_poly(
            """SELECT ufid, ogc_fid, CAST(len(comps) AS BIGINT) AS n_components, 'POLYGON' AS gtype,
               CAST(len(comps) AS BIGINT) * 864000000 AS area, sv AS ymin, nv AS ymax FROM p1"""
        ),
        "stitch_all": f"""WITH RECURSIVE {POLY_PASSES},\n{LINES_ONLY},\n{northern_poly()},
            fin AS (SELECT 'coast' AS layer, ufid, comps FROM qpfin UNION ALL SELECT 'line', ufid, comps FROM lfin UNION ALL SELECT 'poly', ufid, comps FROM pfin),
            once AS (SELECT comps, min(layer) AS first_layer FROM fin WHERE len(comps) > 1 GROUP BY comps),
            ids AS (SELECT comps, 100000500 + row_number() OVER (ORDER BY first_layer, comps[1]) AS id FROM once)
            SELECT f.layer, count(*) AS features, count(i.id) AS composites, min(i.id) AS first_id, max(i.id) AS last_id, CAST(sum(i.id) AS BIGINT) AS id_sum, 4 AS n_columns
            FROM fin f LEFT JOIN ids i ON len(f.comps) > 1 AND i.comps = f.comps GROUP BY f.layer""",
        "publish_layers": f"""WITH RECURSIVE {LINE_PASSES},\n{northern_poly()},
            c AS (SELECT count(*) AS n, count(DISTINCT comps) AS ids FROM qpfin WHERE len(comps) > 1),
            l AS (SELECT count(*) AS n FROM lfin WHERE len(comps) > 1),
            b AS (SELECT count(DISTINCT comps) AS ids FROM (SELECT comps FROM qpfin WHERE len(comps) > 1 UNION ALL SELECT comps FROM lfin WHERE len(comps) > 1))
            SELECT 'stopped after ' || s AS step, 0 AS version, 0 AS layers, 0 AS logged, 0 AS ids, 0 AS clashes, NULL AS last_id FROM (VALUES ('layers'), ('stitch_associations'), ('stitch_report')) t(s)
            UNION ALL SELECT s, 1, 1, c.n, c.ids, 0, 100000500 + c.ids FROM c, (VALUES ('first'), ('repeated')) t(s)
            UNION ALL SELECT 'overtaken', 3, 2, 2 * c.n + l.n, b.ids, 0, 100000500 + b.ids FROM c, l, b""",
        "derive_irregular_edges": f"""WITH {POLY}, s AS (SELECT DISTINCT wv, sv, ev, nv FROM poly),
            e AS (SELECT 'NS' AS direction, nv AS v FROM s UNION SELECT 'NS', sv FROM s UNION SELECT 'EW', ev FROM s UNION SELECT 'EW', wv FROM s)
            SELECT direction, v FROM e WHERE (direction = 'NS' AND NOT {ns('v')}) OR (direction = 'EW' AND NOT {ew('v')})""",
        "extent_hits_irregular": with_both(
            f"""SELECT layer, ({nonstd('max(nv)')} OR {nonstd('min(sv)')} OR {nonstd('max(ev)')} OR {nonstd('min(wv)')}) AS hits FROM feat GROUP BY layer"""
        ),
        "geometry_changed": with_poly(
            """SELECT status, count(*) AS n FROM (
                 SELECT CASE WHEN ufid IN (SELECT comp FROM pm1) THEN 'changed' WHEN ufid IN (SELECT id FROM pm1) THEN 'removed' ELSE 'unchanged' END AS status
                 FROM poly) GROUP BY status"""
        ),
        "loop_removal": LOOP_SQL,
        "triple_point_bypass": TRIPLE_SQL,
    }
)
