"""DuckDB SQL for the registered queries, written against the plain tables."""

from __future__ import annotations

from callweave.plans.queries import FILE, SOURCE, TARGET
from callweave.sources.tables import CLASS_IDS, KINDS, LANGS, TIERS

_LANGS = "[" + ", ".join(f"'{x}'" for x in LANGS) + "]"
_case = lambda c, table: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"

FACTS = f"""
np AS (SELECT count(*) AS n FROM part),
parts AS (SELECT *, {_LANGS}[(p_size % 5) + 1] AS lang FROM part),
symbols AS (
  SELECT p_partkey AS id, p_type AS file, p_name AS name, CASE WHEN p_partkey % 4 = 0 THEN 'function' ELSE 'method' END AS kind,
    CASE WHEN p_partkey % 4 <> 0 THEN p_brand END AS container, lang, (p_partkey % 1000 + 1)::INT AS start_line FROM parts
  UNION ALL
  SELECT DISTINCT {CLASS_IDS} + regexp_extract(p_brand, '([0-9]+)', 1)::BIGINT * 10 + p_size % 5, p_brand, p_brand, 'class', NULL, lang, 1 FROM parts),
defs AS (SELECT *, CASE WHEN lang = 'javascript' THEN 'js' ELSE lang END AS fam, kind = 'function' OR (kind = 'method' AND container IS NULL) AS free,
  kind = 'method' AND container IS NOT NULL AS method, kind = 'class' AS class FROM symbols),
refs AS (
  SELECT ref_id, c.p_type AS file, y.lang, callee, receiver, line, c.p_partkey AS src_symbol FROM (
    -- the numbering keeps the two joins apart
    SELECT *, row_number() OVER () AS rn FROM (
      SELECT ((x.l_orderkey * 8 + x.l_linenumber) * 1000000 + x.l_partkey) * 10000 + x.l_suppkey AS ref_id, p.lang, p.p_name AS callee,
        CASE flag WHEN 'A' THEN '' WHEN 'N' THEN 'self' ELSE p.p_brand END AS receiver, x.l_linenumber::INT AS line, l_orderkey % np.n AS at
      FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, min(l_returnflag) AS flag FROM lineitem GROUP BY ALL) x
      CROSS JOIN np JOIN parts p ON p.p_partkey = x.l_partkey)) y JOIN parts c ON c.p_partkey = y.at),
assigns AS (
  SELECT s.p_type AS file, s.lang, CASE WHEN o.o_orderstatus <> 'P' OR k = 'mixin' THEN s.p_partkey END AS scope_symbol, v.p_brand AS var,
    CASE WHEN k = 'shadow' THEN '' ELSE c.p_brand END AS cls, k AS kind
  FROM (SELECT *, {_case('o_orderpriority', KINDS)} AS k FROM orders) o CROSS JOIN np
  JOIN parts s ON s.p_partkey = o.o_orderkey % np.n JOIN parts v ON v.p_partkey = (o.o_orderkey * 7 + o.o_custkey) % np.n
  JOIN parts c ON c.p_partkey = (o.o_custkey * 3) % np.n),
bind AS (SELECT *, CASE WHEN lang = 'javascript' THEN 'js' ELSE lang END AS fam,
  kind = 'construct' AND NOT (lang = 'python' AND EXISTS (SELECT 1 FROM defs d WHERE d.free AND d.fam = 'python' AND d.name = cls)) AS built
  FROM assigns WHERE kind <> 'mixin'),
env AS (
  SELECT scope_symbol, CASE WHEN scope_symbol IS NULL THEN file END AS file, var, max(fam) AS fam,
    CASE WHEN count(DISTINCT cls) FILTER (kind <> 'shadow') = 1 THEN max(cls) FILTER (kind <> 'shadow') END AS cls,
    CASE WHEN count(DISTINCT cls) FILTER (kind <> 'shadow') = 1 THEN CASE WHEN max(built::INT) = 1 THEN 'construct' ELSE 'hint' END END AS tkind
  FROM bind GROUP BY 1, 2, 3),
known AS (SELECT env.*, EXISTS (SELECT 1 FROM defs d WHERE d.class AND d.fam = env.fam AND d.name = env.cls) AS known FROM env),
mixed AS (SELECT DISTINCT CASE WHEN a.lang = 'javascript' THEN 'js' ELSE a.lang END AS fam, s.name AS owner, a.cls AS module FROM assigns a JOIN symbols s ON s.id = a.scope_symbol WHERE a.kind = 'mixin')"""

SHAPES = f"""{FACTS},
r0 AS (
  SELECT refs.*, CASE WHEN refs.lang = 'javascript' THEN 'js' ELSE refs.lang END AS fam, s.container AS owner, CASE WHEN receiver = '' THEN callee ELSE receiver END AS key
  FROM refs JOIN symbols s ON s.id = src_symbol),
r1 AS (
  SELECT r0.*, coalesce(nm.f, false) AS any_free, EXISTS (SELECT 1 FROM defs d WHERE d.class AND d.fam = r0.fam AND d.name = r0.receiver) AS is_class,
    se.var IS NOT NULL AS s_bound, se.cls AS s_cls, se.tkind AS s_kind, coalesce(se.known, false) AS s_known,
    fe.var IS NOT NULL AS f_bound, fe.cls AS f_cls, fe.tkind AS f_kind, coalesce(fe.known, false) AS f_known,
    EXISTS (SELECT 1 FROM defs d WHERE (d.free OR d.class) AND d.fam = r0.fam AND d.name = r0.callee AND d.file = r0.file) AS own_file
  FROM r0 LEFT JOIN (SELECT fam, name, bool_or(free) AS f FROM defs GROUP BY 1, 2) nm ON nm.fam = r0.fam AND nm.name = r0.callee
  LEFT JOIN known se ON se.scope_symbol = r0.src_symbol AND se.var = r0.key
  LEFT JOIN known fe ON fe.scope_symbol IS NULL AND fe.file = r0.file AND fe.var = r0.key),
r AS (
  SELECT *, receiver = '' AND fam IN ('python', 'js', 'go', 'ruby') AND (s_bound OR f_bound) AND NOT (fam = 'js' AND own_file) AS masked,
    CASE WHEN receiver = '' THEN 'FREE' WHEN receiver = 'self' THEN 'SELF'
      WHEN s_cls IS NOT NULL THEN CASE WHEN s_known AND s_kind = 'hint' THEN 'INSTANCE_HINT' ELSE 'INSTANCE' END
      WHEN s_bound THEN 'INSTANCE' WHEN is_class THEN 'STATIC'
      WHEN f_cls IS NOT NULL THEN CASE WHEN f_known AND f_kind = 'hint' THEN 'INSTANCE_HINT' ELSE 'INSTANCE' END
      ELSE 'INSTANCE' END AS shape,
    CASE WHEN receiver IN ('', 'self') THEN NULL WHEN s_bound THEN CASE WHEN s_known THEN s_cls END WHEN is_class THEN receiver
      WHEN f_known THEN f_cls END AS tclass
  FROM r1)"""

RESOLVED = f"""{SHAPES},
cand AS (
  SELECT r.ref_id, d.id AS dst, d.file AS dst_file,
    CASE shape
      WHEN 'FREE' THEN CASE
        WHEN r.fam = 'ruby' AND r.owner IS NOT NULL AND d.method AND d.container = r.owner THEN 1
        WHEN r.fam = 'ruby' AND r.owner IS NOT NULL AND d.method AND EXISTS (SELECT 1 FROM mixed m WHERE m.fam = r.fam AND m.owner = r.owner AND m.module = d.container) THEN 2
        WHEN (d.free OR (d.class AND (r.fam IN ('python', 'js', 'go') OR NOT any_free))) THEN CASE WHEN d.file = r.file THEN 3 ELSE 4 END END
      WHEN 'SELF' THEN CASE WHEN d.method AND d.container = r.owner THEN 1 WHEN d.method THEN 2 END
      ELSE CASE WHEN d.method AND d.container = r.tclass THEN 1 WHEN d.method THEN 2 END END AS rank, shape
  FROM r JOIN defs d ON d.fam = r.fam AND d.name = r.callee WHERE NOT masked),
best AS (SELECT *, min(rank) OVER (PARTITION BY ref_id) AS top FROM cand WHERE rank IS NOT NULL),
kept AS (SELECT *, count(*) OVER (PARTITION BY ref_id) AS n FROM best WHERE rank = top),
edges AS (
  SELECT r.src_symbol AS src, k.dst, 'calls' AS kind,
    CASE WHEN n > 1 THEN 'ambiguous' WHEN k.shape = 'INSTANCE_HINT' THEN 'inferred' WHEN k.shape = 'FREE' THEN CASE WHEN rank = 2 THEN 'inferred' ELSE 'exact' END
      WHEN rank = 1 THEN 'exact' ELSE 'inferred' END AS resolution, r.file, r.line, r.ref_id
  FROM kept k JOIN r USING (ref_id)),
lost AS (SELECT file, lang, callee, receiver, line, src_symbol, ref_id FROM r WHERE ref_id NOT IN (SELECT ref_id FROM kept))"""

MODULES = f"""
np AS (SELECT count(*) AS n FROM part),
place AS (SELECT p_partkey AS k, p_name AS name, p_brand AS brand, 'pkg' || regexp_extract(p_brand, '([0-9]+)', 1) AS pkg, 'mod' || (p_size % 7) AS mod, {_LANGS}[(p_size % 5) + 1] AS lang,
  ['.py', '.js', '.php', '.rb', '.go'][(p_size % 5) + 1] AS ext FROM part),
def AS (SELECT k AS id, name, CASE WHEN k % 2 <> 0 THEN brand END AS container, lang, pkg, mod FROM place),
imp AS (SELECT DISTINCT 'src/' || a.pkg || '/' || a.mod || a.ext AS file, b.lang AS lang_b, b.pkg AS pkg_b, b.mod AS mod_b
  FROM orders CROSS JOIN np JOIN place a ON a.k = o_orderkey % np.n JOIN place b ON b.k = (o_custkey * 3) % np.n),
bound AS (SELECT DISTINCT file, CASE WHEN lang_b = 'python' THEN pkg_b || '.' || mod_b WHEN lang_b = 'go' THEN pkg_b ELSE mod_b END AS module FROM imp),
x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, min(l_returnflag) AS flag FROM lineitem GROUP BY ALL),
y AS (SELECT *, row_number() OVER () AS rn FROM (SELECT ((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey AS ref_id, l_linenumber::INT AS line, l_orderkey, flag, p.lang, p.name AS callee, p.pkg, p.mod,
  CASE WHEN p.lang = 'python' THEN p.pkg || '.' || p.mod WHEN p.lang = 'go' THEN p.pkg ELSE p.mod END AS module, l_orderkey % np.n AS at FROM x CROSS JOIN np JOIN place p ON p.k = x.l_partkey)),
z AS (SELECT *, row_number() OVER () AS rn2 FROM (SELECT y.*, c.k, 'src/' || c.pkg || '/' || c.mod || c.ext AS file, CASE WHEN l_orderkey % 9 <> 0 AND c.k % 2 <> 0 THEN c.brand END AS owner FROM y JOIN place c ON c.k = y.at)),
ref AS (SELECT z.ref_id, z.file, z.lang, callee, CASE WHEN flag = 'A' THEN 'super()' ELSE z.module END AS receiver, z.line, CASE WHEN l_orderkey % 9 <> 0 THEN k END AS src_symbol, owner, pkg, mod,
  CASE WHEN flag = 'A' THEN 'super' WHEN b.module IS NOT NULL THEN 'module' ELSE 'instance' END AS shape
  FROM z LEFT JOIN bound b ON b.file = z.file AND b.module = z.module),
hits AS (
  SELECT ref.*, def.id AS dst FROM ref JOIN def ON def.lang = ref.lang AND def.name = ref.callee WHERE CASE shape
    WHEN 'super' THEN def.container IS NOT NULL AND def.container IS DISTINCT FROM owner
    WHEN 'instance' THEN def.container IS NOT NULL
    ELSE def.container IS NULL AND CASE ref.lang WHEN 'python' THEN def.pkg = ref.pkg AND def.mod = ref.mod WHEN 'go' THEN def.pkg = ref.pkg ELSE def.mod = ref.mod END END),
counted AS (SELECT *, count(*) OVER (PARTITION BY ref_id) AS n FROM hits)"""

GRAPH = f"""
nc AS (SELECT count(*) AS n FROM customer),
gsym AS (SELECT c_custkey AS id, n_name AS file, c_name AS name, c_mktsegment AS container, c_mktsegment || '.' || c_name AS symbol, (c_custkey % 1000)::INT AS line FROM customer JOIN nation ON n_nationkey = c_nationkey),
gedge AS (
  SELECT c_custkey AS src, (c_custkey * 7919 + c_nationkey * 13) % nc.n AS dst, {_case('c_mktsegment', TIERS)} AS resolution, c_nationkey AS k, CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_custkey END AS ref_id FROM customer, nc
  UNION ALL SELECT (s_suppkey * 13) % nc.n, (s_suppkey * 101 + s_nationkey) % nc.n, 'exact', s_nationkey, s_suppkey + 1000000000 FROM supplier, nc),
pairs AS (SELECT DISTINCT src, dst FROM gedge)"""


def _reach(a: str, b: str, seeds: str, depth: int) -> str:
    return f"""reach AS (
  SELECT seed, id, min(depth)::INT AS depth FROM (
    WITH RECURSIVE w(seed, id, depth) AS (
      SELECT id, id, 0 FROM ({seeds}) UNION SELECT w.seed, p.{b}, w.depth + 1 FROM w JOIN pairs p ON p.{a} = w.id WHERE w.depth < {depth})
    SELECT * FROM w) GROUP BY 1, 2 HAVING seed <> id)"""


_ALL = "SELECT id FROM gsym"
_CLOSURE = """closure AS (SELECT DISTINCT a, b FROM (
    WITH RECURSIVE w(a, b) AS (SELECT src, dst FROM {pairs} UNION SELECT w.a, p.dst FROM w JOIN {pairs} p ON p.src = w.b) SELECT * FROM w)),
comp AS (SELECT n.id, least(n.id, coalesce(min(x.b), n.id)) AS component FROM (SELECT src AS id FROM {pairs} UNION SELECT dst FROM {pairs}) n
  LEFT JOIN closure x ON x.a = n.id AND EXISTS (SELECT 1 FROM closure y WHERE y.a = x.b AND y.b = n.id) GROUP BY n.id)"""
_SCC = f"WITH {GRAPH}, {_CLOSURE.format(pairs='pairs')} SELECT id, component FROM comp"
_FAN = """fan AS (
  SELECT coalesce(i.id, o.id) AS id, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out, coalesce(dependents, 0) AS dependents
  FROM (SELECT dst AS id, count(DISTINCT ref_id) + count(*) FILTER (ref_id IS NULL) AS fan_in, count(DISTINCT src) AS dependents FROM gedge GROUP BY 1) i
  FULL JOIN (SELECT src AS id, count(DISTINCT ref_id) + count(*) FILTER (ref_id IS NULL) AS fan_out FROM gedge GROUP BY 1) o ON i.id = o.id)"""

_HOOKS = f"""{FACTS},
hooks AS (
  SELECT event_id AS id, h.p_type AS file, event_id % 50 = 0 AS listen,
    CASE user_id % 7 WHEN 0 THEN 'wp_ajax_nopriv_' WHEN 1 THEN 'admin_post_' ELSE '' END || event_type || '_' || (user_id % 97) AS hook,
    h.p_partkey AS enclosing, event_id % 100 = 0 AS free, c.p_name AS cb_name, c.p_brand AS brand
  FROM events CROSS JOIN np JOIN part h ON h.p_partkey = event_id % np.n JOIN part c ON c.p_partkey = (event_id * 31 + user_id) % np.n)"""
_CALLBACKS = f"""{_HOOKS},
cc AS (
  SELECT h.id, d.id AS dst, CASE WHEN h.free THEN CASE WHEN d.free THEN CASE WHEN d.file = h.file THEN 1 ELSE 2 END END
    WHEN d.method AND d.container = h.brand THEN CASE WHEN d.file = h.file THEN 1 ELSE 2 END END AS rank
  FROM hooks h JOIN defs d ON d.fam = 'php' AND d.name = h.cb_name WHERE h.listen),
cb AS (SELECT id, max(dst) AS callback_symbol FROM (SELECT *, min(rank) OVER (PARTITION BY id) AS top FROM cc WHERE rank IS NOT NULL) WHERE rank = top GROUP BY id HAVING count(*) = 1)"""
_CLASSIFIED = f"""{_HOOKS},
cl AS (SELECT *, CASE WHEN listen AND hook LIKE 'wp\\_ajax\\_nopriv\\_%' ESCAPE '\\' THEN 'ajax_nopriv' WHEN listen AND hook LIKE 'admin\\_post\\_%' ESCAPE '\\' THEN 'admin_post' END AS entry FROM hooks)"""

_PROGRAM_LANGS = "['python', 'javascript', 'typescript', 'tsx', 'php', 'ruby', 'go']"


def _programs(table: str, columns: str, rows: list[str]) -> str:
    """Facts of the generated programs as literal rows (lang first), with the marks of a part filled in."""
    names = columns.split(", ")
    texts = [c for c in names if not c.endswith("line")]
    fill = lambda c: f"replace(replace(replace(replace({c}, '%C', replace(p_brand, '#', '')), '%f', replace(p_name, ' ', '_')), '%g', 'go' || p_partkey % 97), '%m', 'mod' || p_size)"
    out = ", ".join(f"{fill(c)} AS {c}" if c in texts else c for c in names)
    return f"SELECT 'p' || p_partkey AS file, {out} FROM part JOIN (VALUES {', '.join(rows)}) AS {table}(l, {columns}) ON l = {_PROGRAM_LANGS}[(p_size % 7) + 1]"


_SYMBOL_ROWS = [
    "('python', '%C', 'class', NULL, 2, 7, 'class %C:')", "('python', '%f', 'method', '%C', 3, 7, 'def %f(self, x: %C):')",
    "('javascript', '%C', 'class', NULL, 2, 9, 'class %C {')", "('javascript', '%f', 'method', '%C', 3, 8, '%f(a) {')",
    "('typescript', '%C', 'class', NULL, 2, 9, 'class %C {')", "('typescript', '%f', 'method', '%C', 3, 8, '%f(a: %C): number {')",
    "('tsx', '%f', 'function', NULL, 2, 6, 'function %f(a: %C) {')",
    "('php', '%C', 'class', NULL, 2, 10, 'class %C {')", "('php', '%f', 'method', '%C', 3, 9, 'function %f($a) {')",
    "('ruby', '%C', 'class', NULL, 2, 10, 'class %C')", "('ruby', '%f', 'method', '%C', 4, 9, 'def %f(a)')",
    "('go', '%C', 'class', NULL, 5, 5, '%C struct{}')", "('go', '%f', 'method', '%C', 7, 12, 'func (r *%C) %f(a int) int {')",
]
_CALL_ROWS = [
    "('python', '%C', NULL, 4, '%f')", "('python', '%g', 'self', 5, '%f')", "('python', '%g', 'y', 6, '%f')", "('python', '%g', NULL, 7, '%f')",
    "('javascript', '%g', 'this', 5, '%f')", "('javascript', '%g', 'y', 6, '%f')", "('javascript', '%g', NULL, 7, '%f')",
    "('typescript', '%g', 'this', 5, '%f')", "('typescript', '%g', 'y', 6, '%f')", "('typescript', '%g', NULL, 7, '%f')",
    "('tsx', '%g', 'y', 4, '%f')", "('tsx', '%g', NULL, 5, '%f')",
    "('php', '%g', '$this', 5, '%f')", "('php', '%g', '$y', 6, '%f')", "('php', '%g', '%C', 7, '%f')", "('php', '%g', NULL, 8, '%f')", "('php', 'add_action', NULL, 11, NULL)", "('php', 'do_action', NULL, 12, NULL)",
    "('ruby', 'require', NULL, 1, NULL)", "('ruby', 'include', NULL, 3, '%C')", "('ruby', 'new', '%C', 5, '%f')", "('ruby', '%g', 'self', 6, '%f')", "('ruby', '%g', 'y', 7, '%f')", "('ruby', '%g', NULL, 8, '%f')",
    "('go', '%g', 'r', 9, '%f')", "('go', '%g', 'y', 10, '%f')", "('go', '%g', NULL, 11, '%f')",
]
_BINDING_ROWS = [
    "('python', 'x', '%C', 'hint', '%f')", "('python', 'y', '%C', 'construct', '%f')", "('javascript', 'y', '%C', 'construct', '%f')", "('typescript', 'a', '%C', 'hint', '%f')", "('typescript', 'y', '%C', 'construct', '%f')",
    "('tsx', 'a', '%C', 'hint', '%f')", "('tsx', 'y', '%C', 'construct', '%f')", "('php', 'y', '%C', 'construct', '%f')", "('ruby', '<mixin>', 'Help', 'mixin', '%C')", "('ruby', 'y', '%C', 'construct', '%f')",
    "('go', 'r', '%C', 'construct', '%f')", "('go', 'y', '%C', 'construct', '%f')",
]
_IMPORT_ROWS = ["('python', '%m.util')", "('javascript', './%m/util')", "('typescript', './%m/util')", "('tsx', './%m/util')", "('go', '%m/util')"]
_HOOK_ROWS = ["('php', 'listen', '%m', 'action', 'free', '%g', 11)", "('php', 'fire', '%m', 'fire', NULL, NULL, 12)"]

_PYTHON = f"""{FACTS},
ph AS (
  SELECT event_id AS id, h.p_type AS file, event_id % 20 = 0 AS listen, CASE WHEN user_id % 6 = 0 THEN 'post_save' ELSE 'sig' || (user_id + event_id) % 40 END AS hook,
    h.p_partkey AS enclosing, c.p_name AS cb_name, ['@receiver', '@task', 'connect', 'route'][(user_id % 4) + 1] AS how, CASE WHEN user_id % 2 = 0 THEN 'signal' ELSE 'task' END AS tag
  FROM events CROSS JOIN np JOIN part h ON h.p_partkey = event_id % np.n JOIN part c ON c.p_partkey = (event_id * 7 + user_id) % np.n),
ev AS (SELECT 'post_save' AS hook UNION SELECT 'sig' || s_suppkey FROM supplier WHERE s_suppkey < 10 UNION SELECT hook FROM ph WHERE listen AND how IN ('@receiver', '@task')),
sure AS (SELECT * FROM ph WHERE (listen AND how IN ('@receiver', '@task', 'route')) OR hook IN (SELECT hook FROM ev))"""
_CONST = """tok AS (
  SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'NAME_' || s_suppkey % 70 ELSE 'Brand' || s_suppkey % 25 || '::KEY' END AS token,
    'v' || CASE WHEN s_suppkey % 7 = 0 THEN s_suppkey WHEN s_suppkey % 2 = 0 THEN s_suppkey % 70 ELSE s_suppkey % 25 END AS v FROM supplier),
one AS (SELECT token, max(v) AS v FROM tok GROUP BY token HAVING count(DISTINCT v) = 1),
hk AS (SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'NAME_' || user_id % 70 WHEN 1 THEN 'Brand' || user_id % 25 || '::KEY' ELSE 'self::KEY' END AS raw,
  CASE event_id % 3 WHEN 0 THEN 'NAME_' || user_id % 70 WHEN 1 THEN 'Brand' || user_id % 25 || '::KEY' ELSE replace(p_brand, '#', '') || '::KEY' END AS token
  FROM events, (SELECT count(*) AS n FROM part) JOIN part ON p_partkey = event_id % n)"""

ORACLE = {
    "extracted_symbols": _programs("s", "name, kind, container, start_line, end_line, signature", _SYMBOL_ROWS),
    "extracted_calls": _programs("c", "callee, receiver, line, inside", _CALL_ROWS),
    "extracted_bindings": _programs("b", "var, cls, kind, inside", _BINDING_ROWS),
    "extracted_imports": _programs("i", "module", _IMPORT_ROWS),
    "extracted_hooks": _programs("h", "kind, hook, hook_class, cb_kind, cb_name, line", _HOOK_ROWS),
    "program_edges": f"""WITH d AS (SELECT {_PROGRAM_LANGS}[(p_size % 7) + 1] AS lang, replace(p_brand, '#', '') AS c FROM part),
      n AS (SELECT lang, c, count(*) AS k FROM d GROUP BY ALL)
      SELECT lang, c AS callee, 'exact' AS resolution, k AS n FROM n WHERE lang = 'python'""",
    "hook_constants": f"WITH {_CONST} SELECT id, 'on.' || coalesce(v, raw) || '.end' AS hook, 'on.' || raw || '.end' AS hook_raw FROM hk LEFT JOIN one USING (token)",
    "python_trusted": f"WITH {_PYTHON} SELECT id, CASE WHEN listen THEN 'listen' ELSE 'fire' END AS kind, hook FROM sure",
    "python_dispatch": f"""WITH {_PYTHON},
      pc AS (SELECT s.id, d.id AS dst, CASE WHEN d.file = s.file THEN 1 ELSE 2 END AS rank FROM sure s JOIN defs d ON d.fam = 'python' AND d.name = s.cb_name AND d.free WHERE s.listen),
      pb AS (SELECT id, max(dst) AS dst FROM (SELECT *, min(rank) OVER (PARTITION BY id) AS top FROM pc) WHERE rank = top GROUP BY id HAVING count(*) = 1)
      SELECT f.enclosing AS src, pb.dst, f.file, count(*) AS n FROM sure f JOIN sure l ON l.hook = f.hook AND l.listen AND NOT f.listen AND l.how <> 'route' AND f.tag = CASE l.how WHEN '@task' THEN 'task' ELSE 'signal' END
      JOIN pb ON pb.id = l.id GROUP BY ALL""",
    "hook_listeners": f"""WITH {_HOOKS} SELECT h.id, hook, h.file, coalesce(CASE WHEN s.container IS NULL THEN s.name ELSE s.container || '.' || s.name END, h.cb_name) AS callback, s.file AS cb_file, s.start_line AS cb_line
      FROM hooks h LEFT JOIN symbols s ON s.id = h.enclosing AND s.id % 2 = 0 WHERE listen AND hook = 'click_5'""",
    "hook_fires": f"WITH {_HOOKS} SELECT id, file, (id % 100 + 1)::INT AS line FROM hooks WHERE NOT listen AND hook = 'click_5'",
    "hooks_by_callback": f"WITH {_HOOKS} SELECT id, CASE WHEN listen THEN 'listen' ELSE 'fire' END AS kind, hook FROM hooks WHERE enclosing = 7",
    "symbols_by_id": f"WITH {FACTS} SELECT id, name, file FROM symbols WHERE id IN (SELECT s_suppkey * 3 FROM supplier)",
    "file_states": "SELECT url AS path, sha1(html) AS hash, page_id::DOUBLE AS mtime, octet_length(encode(html)) AS size FROM pages WHERE url IN (SELECT url FROM pages WHERE page_id % 3 = 0)",
    "is_called": f"WITH {GRAPH} SELECT id, EXISTS (SELECT 1 FROM gedge WHERE gedge.dst = v.id) AS called FROM (VALUES (3::BIGINT), (1000000000::BIGINT)) v(id)",
    "receivers": """SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN p_brand || '.' || p_name ELSE p_name END AS label, p_name AS receiver, list_last(string_split(p_name, ' ')) AS tail, NULL::VARCHAR AS no_tail,
      least(greatest(p_size, 1), 25)::INT AS depth, list_last(string_split(p_name, ' ')) = 'widget' AS hit FROM part""",
    "resolve_edges": f"WITH {RESOLVED} SELECT * FROM edges",
    "resolve_unresolved": f"WITH {RESOLVED} SELECT * FROM lost",
    "site_counts": f"""WITH {RESOLVED} SELECT count(DISTINCT ref_id) FILTER (resolution = 'exact') AS edges_exact, count(DISTINCT ref_id) FILTER (resolution = 'inferred') AS edges_inferred,
      count(DISTINCT ref_id) FILTER (resolution = 'ambiguous') AS edges_ambiguous, 0::BIGINT AS edges_hook, count(*) AS edge_rows, (SELECT count(*) FROM lost) AS unresolved FROM edges""",
    "call_shapes": f"WITH {SHAPES} SELECT fam, shape, masked, count(*) AS n, count(tclass) AS typed FROM r GROUP BY ALL",
    "module_edges": f"""WITH {MODULES} SELECT src_symbol AS src, dst, 'calls' AS kind, CASE WHEN n > 1 THEN 'ambiguous' WHEN shape = 'module' AND lang = 'python' THEN 'exact' ELSE 'inferred' END AS resolution, file, line, ref_id FROM counted""",
    "module_unresolved": f"WITH {MODULES} SELECT file, lang, callee, receiver, line, src_symbol, ref_id FROM ref WHERE ref_id NOT IN (SELECT ref_id FROM hits)",
    "type_env": f"WITH {FACTS} SELECT scope_symbol AS scope, var, cls, tkind, known FROM known WHERE scope_symbol IS NOT NULL",
    "mixins": f"WITH {FACTS} SELECT fam, owner, module FROM mixed",
    "imports_expanded": """WITH i AS (SELECT 'page' || page_id AS file, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS module FROM pages)
      SELECT file, module FROM i UNION SELECT file, tail FROM (SELECT file, split_part(list_last(string_split(module, '/')), '.', 1) AS tail FROM i WHERE module LIKE '%/%' OR module LIKE '.%') WHERE tail <> ''""",
    "hook_callbacks": f"WITH {_CALLBACKS} SELECT h.id, hook, coalesce(callback_symbol, -1) AS callback_symbol FROM hooks h LEFT JOIN cb USING (id) WHERE listen",
    "hook_edges": f"""WITH {_CALLBACKS} SELECT f.enclosing AS src, cb.callback_symbol AS dst, f.file, count(*) AS n
      FROM hooks f JOIN hooks l ON l.hook = f.hook AND l.listen AND NOT f.listen JOIN cb ON cb.id = l.id GROUP BY ALL""",
    "entry_points": f"WITH {_CLASSIFIED} SELECT coalesce(entry, 'action') AS hook_class, entry IS NOT NULL AS entry_point, coalesce(entry LIKE '%nopriv', false) AS unauth, count(*) AS n FROM cl WHERE listen GROUP BY ALL",
    "find": f"WITH {FACTS} SELECT id, file, name, container, lang, start_line FROM symbols WHERE name = 'red widget' AND kind = 'method'",
    "find_qualified": f"WITH {FACTS} SELECT id, file, lang FROM symbols WHERE name = 'red widget' AND container = 'Brand#17'",
    "neighbors": f"""WITH {GRAPH} SELECT e.src AS seed, 'out' AS direction, s.id, s.symbol, e.resolution FROM gedge e JOIN gsym s ON s.id = e.dst
      UNION ALL SELECT e.dst, 'in', s.id, s.symbol, e.resolution FROM gedge e JOIN gsym s ON s.id = e.src""",
    "edge_labels": f"WITH {GRAPH} SELECT n_name AS file, a.symbol AS src_label, b.symbol AS dst_label, resolution FROM gedge JOIN nation ON n_nationkey = k JOIN gsym a ON a.id = src JOIN gsym b ON b.id = dst",
    "callers": f"WITH {GRAPH}, {_reach('dst', 'src', _ALL, 3)} SELECT seed, id, symbol, depth FROM reach JOIN gsym USING (id)",
    "callees": f"WITH {GRAPH}, {_reach('src', 'dst', _ALL, 3)} SELECT seed, id, symbol, depth FROM reach JOIN gsym USING (id)",
    "callees_by_frontier": f"WITH {GRAPH}, {_reach('src', 'dst', _ALL, 3)} SELECT seed, id, depth FROM reach",
    "blast_radius_by_file": f"""WITH {GRAPH}, {_reach('dst', 'src', f"SELECT id FROM gsym WHERE file = '{FILE}' OR file LIKE '%/{FILE}'", 6)},
      least_ AS (SELECT id, min(depth) AS depth FROM reach GROUP BY 1) SELECT file, count(*)::INT AS impacted, sum(depth)::INT AS depths FROM least_ JOIN gsym USING (id) GROUP BY file""",
    "shortest_path_hops": f"""WITH {GRAPH}, hop AS (WITH RECURSIVE w(id, depth) AS (SELECT id, 0 FROM gsym WHERE name = '{SOURCE}' UNION SELECT p.dst, w.depth + 1 FROM w JOIN pairs p ON p.src = w.id WHERE w.depth < 400) SELECT * FROM w)
      SELECT coalesce(min(depth), -1)::INT AS hops FROM hop WHERE id IN (SELECT id FROM gsym WHERE name = '{TARGET}')""",
    "scc": _SCC,
    "cycles": f"""WITH {GRAPH}, ce AS (SELECT DISTINCT src, dst FROM gedge WHERE resolution NOT IN ('inferred', 'hook')), {_CLOSURE.format(pairs='ce')}
      SELECT count(*)::INT AS size, component AS first FROM comp GROUP BY component HAVING count(*) >= 2 UNION ALL SELECT 1, src FROM ce WHERE src = dst""",
    "betweenness": f"""WITH {GRAPH}, walk AS (
        WITH RECURSIVE w(s, t, d) AS (SELECT DISTINCT src, src, 0 FROM pairs UNION SELECT w.s, p.dst, w.d + 1 FROM w JOIN pairs p ON p.src = w.t WHERE w.d < 400) SELECT * FROM w),
      dist AS (SELECT s, t, min(d) AS d FROM walk GROUP BY s, t),
      paths AS (WITH RECURSIVE w(s, t, d, sigma) AS (
        SELECT s, t, d, 1::DOUBLE FROM dist WHERE d = 0
        UNION ALL SELECT w.s, p.dst, w.d + 1, sum(w.sigma) FROM w JOIN pairs p ON p.src = w.t JOIN dist ON dist.s = w.s AND dist.t = p.dst AND dist.d = w.d + 1 GROUP BY w.s, p.dst, w.d)
        SELECT * FROM w),
      part_ AS (SELECT a.t AS id, sum(a.sigma * b.sigma / c.sigma) AS score FROM paths a JOIN paths b ON b.s = a.t AND b.d > 0 JOIN paths c ON c.s = a.s AND c.t = b.t AND c.d = a.d + b.d WHERE a.d > 0 AND b.t <> a.s GROUP BY a.t)
      SELECT n.id, round(coalesce(score, 0), 3) AS score FROM (SELECT src AS id FROM pairs UNION SELECT dst FROM pairs) n LEFT JOIN part_ USING (id)""",
    "fan_counts": f"WITH {GRAPH}, {_FAN} SELECT * FROM fan",
    "hotspots_fan_in": f"""WITH {GRAPH}, {_FAN} SELECT id, symbol, file, line, fan_in, fan_out, dependents, fan_in::DOUBLE AS score, fan_in >= greatest(100, 0.03 * (SELECT sum(fan_in) FROM fan)) AS suspected_shadow
      FROM fan JOIN gsym USING (id) WHERE fan_in > 0 ORDER BY fan_in DESC, id LIMIT 20""",
    "stats_by_lang_and_kind": f"WITH {FACTS} SELECT lang, kind, count(*) AS n FROM symbols GROUP BY GROUPING SETS ((lang), (kind))",
    "hook_counts": f"WITH {_CLASSIFIED} SELECT count(*) FILTER (listen) AS hook_registrations, count(entry) AS entry_points, count(*) FILTER (entry LIKE '%nopriv') AS unauth_entry_points FROM cl",
    "edge_diff": """WITH e AS (SELECT DISTINCT l_linestatus, p_type AS file, 's' || l_suppkey || ' -> ' || p_name || ' [' || lower(l_returnflag) || ']' AS t FROM lineitem JOIN part ON p_partkey = l_partkey),
      f AS (SELECT file, t FROM e WHERE l_linestatus = 'F'), o AS (SELECT file, t FROM e WHERE l_linestatus = 'O'), x AS (SELECT *, true AS a FROM (FROM o EXCEPT FROM f) UNION ALL SELECT *, false FROM (FROM f EXCEPT FROM o))
      SELECT file, count(*) FILTER (a) AS added, count(*) FILTER (NOT a) AS removed, min(t) FILTER (a) AS first_added FROM x GROUP BY file""",
    "change_detect": """WITH o AS (SELECT 'f' || o_orderkey AS path, o_orderkey AS k FROM orders)
      SELECT path, CASE WHEN k % 3 = 2 THEN 'new' WHEN k % 5 = 4 THEN 'deleted' ELSE 'modified' END AS state FROM o
      WHERE (k % 5 <> 4 OR k % 3 <> 2) AND (k % 3 = 2 OR k % 5 = 4 OR k % 7 = 0)""",
    "sha1_pages": "SELECT page_id, sha1(html) AS hash FROM pages",
    "glob_scope": "SELECT page_id, url LIKE '%/en/%' OR regexp_full_match(url, '(?s).*[0-9].html') OR (url LIKE 'http://%.org/%') AS included FROM pages",
    "languages_of_paths": "SELECT p_partkey, ['python', 'javascript', 'tsx', 'ruby', 'go', NULL, 'typescript', NULL, 'php'][(p_size % 9) + 1] AS lang FROM part",
    "minified_pages": "SELECT page_id, octet_length(encode(html)) >= 200000 AND octet_length(encode(html)) > 5000 * (1 + length(html) - length(replace(html, chr(10), ''))) AS minified FROM pages",
    "js_calls": r"""WITH s AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<script>(.*?)</script>', 1)) AS code FROM pages),
      x AS (SELECT page_id, 'call' AS kind, unnest(regexp_extract_all(code, '(\w+)\(', 1)) AS name FROM s UNION ALL SELECT page_id, 'bound', unnest(regexp_extract_all(code, 'var (\w+)', 1)) FROM s)
      SELECT page_id, kind, name, count(*) AS n FROM x GROUP BY ALL""",
}
