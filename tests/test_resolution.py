"""Golden edge maps: what a call reaches, and how surely."""

from tests.trees import graph

EXACT, INFERRED, AMBIGUOUS, HOOK = {"exact"}, {"inferred"}, {"ambiguous"}, {"hook"}


def test_python(spark):
    edges, lost, *_ = graph(spark, {
        "stock.py": "def load(key):\n    return parse(key)\n\n\ndef parse(key):\n    return key\n\n\nclass Shelf:\n    def put(self, x):\n        self.check(x)\n        load(x)\n\n    def check(self, x):\n        return self.put(x)\n",
        "shop.py": "from stock import Shelf\n\n\ndef sell():\n    s = Shelf()\n    s.put(1)\n\n    def inner():\n        return sell()\n\n    return inner()\n\n\ndef count(n):\n    return count(n - 1) + missing(n)\n",
    })
    assert edges == {
        ("load", "parse"): EXACT, ("Shelf.put", "Shelf.check"): EXACT, ("Shelf.put", "load"): EXACT, ("Shelf.check", "Shelf.put"): EXACT,
        ("sell", "Shelf"): EXACT, ("sell", "Shelf.put"): EXACT, ("inner", "sell"): EXACT, ("sell", "inner"): EXACT, ("count", "count"): EXACT,
    }
    assert lost == {("count", "missing")}


def test_javascript(spark):
    edges, lost, *_ = graph(spark, {
        "a.js": "import { keep } from './b.js';\nconst go = (x) => keep(x);\nconst box = {\n  open() { return go(1); },\n};\n",
        "b.js": "class Box { fill(x) { return this.empty(x); } empty() { keep(1); } }\nexport function keep(x) { return write(x); }\nfunction write(x) { return `${ping(x)} and '${x}'`; }\nfunction* ping(n) { yield pong(n); }\nconst pong = function (n) { return ping(n); };\n",
    })
    assert edges == {
        ("go", "keep"): EXACT, ("open", "go"): EXACT, ("Box.fill", "Box.empty"): EXACT, ("Box.empty", "keep"): EXACT, ("keep", "write"): EXACT,
        ("write", "ping"): EXACT, ("ping", "pong"): EXACT, ("pong", "ping"): EXACT,
    }
    assert not lost


def test_typescript(spark):
    edges, lost, *_ = graph(spark, {"m.ts": "interface Shape { area(): number; }\nclass Base {\n  name(): string { return this.trim('x'); }\n  protected trim(s: string): string { return s; }\n}\nclass Leaf extends Base {\n  name(): string { return super.name(); }\n}\nexport function top<T>(x: T): T { return low(x) as T; }\nfunction low(x: unknown): unknown { return x; }\n"})
    assert edges == {("Base.name", "Base.trim"): EXACT, ("Leaf.name", "Base.name"): INFERRED, ("top", "low"): EXACT}
    assert not lost


def test_php(spark):
    edges, lost, *_ = graph(spark, {
        "a.php": "<p>it's html</p>\n<?php\nclass Cart {\n  public function add($x) { $this->sum(); return total($x); }\n  private static function sum() { return self::tax(); }\n  static function tax() { return \"{$this->sum()} a\"; }\n}\nfunction total($x) { return round_up($x); }\nfunction round_up($x) { return $x; }\n",
        "b.php": "<?php\nfunction run() { $c = new Cart(); $c->add(1); Cart::tax(); total(2); unknown_fn(); }\n",
    })
    assert edges == {
        ("Cart.add", "Cart.sum"): EXACT, ("Cart.add", "total"): EXACT, ("Cart.sum", "Cart.tax"): EXACT, ("Cart.tax", "Cart.sum"): EXACT,
        ("total", "round_up"): EXACT, ("run", "Cart.add"): EXACT, ("run", "Cart.tax"): EXACT, ("run", "total"): EXACT,
    }
    assert lost == {("run", "unknown_fn")}


def test_ruby(spark):
    edges, lost, *_ = graph(spark, {"s.rb": "def pack(x)\n  wrap(x) if x\nend\n\ndef wrap(x) = x\n\nclass Store\n  def take\n    sort\n    pack(1)\n  end\n\n  def sort\n    [1].each do |i|\n      shuffle\n    end\n  end\n\n  def self.shuffle\n    self.take\n  end\nend\n"})
    assert edges == {("pack", "wrap"): EXACT, ("Store.take", "Store.sort"): EXACT, ("Store.take", "pack"): EXACT, ("Store.sort", "Store.shuffle"): EXACT, ("Store.shuffle", "Store.take"): EXACT}
    assert lost == {("Store.sort", "each")}


def test_go(spark):
    edges, lost, *_ = graph(spark, {"main.go": 'package main\n\nimport "fmt"\n\ntype Tank struct {\n\tlevel int\n}\n\ntype Rival struct{}\n\nfunc (r *Rival) Fill() {}\n\nfunc (t *Tank) Fill() { t.check(); fmt.Println("x") }\nfunc (t *Tank) check() { helper() }\nfunc helper() {}\nfunc build() {\n\ta := Tank{}\n\ta.Fill()\n\tb := &Tank{level: 1}\n\tb.Fill()\n\tvar c Tank\n\tc.Fill()\n}\n'})
    assert edges == {("Tank.Fill", "Tank.check"): EXACT, ("Tank.check", "helper"): EXACT, ("build", "Tank.Fill"): EXACT}
    assert lost == {("Tank.Fill", "Println")}


def test_declared_types_are_inferred_and_decoys_stay_out(spark):
    edges, *_ = graph(spark, {
        "a.py": "class Req:\n    def body(self): pass\nclass Decoy:\n    def body(self): pass\ndef view(r: Req):\n    r.body()\ndef made():\n    r = Req()\n    r.body()\n",
        "b.ts": "class Mail { send() {} }\nclass Fake { send() {} }\nfunction post(m: Mail) { m.send(); }\nfunction many(m: Mail[]) { m.send(); }\n",
        "c.php": "<?php class Log { function put() {} } class Not { function put() {} }\nclass Use { function __construct(private ?Log $l) { $l->put(); } }\nfunction f(\\App\\Log $l) { $l->put(); }\n",
    })
    assert edges[("view", "Req.body")] == INFERRED and ("view", "Decoy.body") not in edges
    assert edges[("made", "Req.body")] == EXACT
    assert edges[("post", "Mail.send")] == INFERRED and ("post", "Fake.send") not in edges
    assert edges[("many", "Mail.send")] == edges[("many", "Fake.send")] == AMBIGUOUS
    assert edges[("Use.__construct", "Log.put")] == edges[("f", "Log.put")] == INFERRED


def test_conflicting_types_are_ambiguous(spark):
    edges, *_ = graph(spark, {"a.php": "<?php class A { function go() {} } class B { function go() {} }\nfunction f() { $x = new A(); $x = new B(); $x->go(); }\n"})
    assert edges[("f", "A.go")] == edges[("f", "B.go")] == AMBIGUOUS


def test_local_names_mask(spark):
    edges, lost, *_ = graph(spark, {
        "a.py": "def handler(): pass\nclass Db:\n    def ask(self): pass\nclass Other:\n    def ask(self): pass\ndb = Db()\ndef by_module():\n    db.ask()\ndef by_param(db):\n    db.ask()\n",
        "b.py": "def run(handler):\n    handler()\ndef clean():\n    handler()\n",
        "c.js": "function outer() { const help = () => 1; return help(); }\n",
        "d.php": "<?php function cb() {} function call($cb) { cb(); }\n",
        "e.rb": "def report\nend\ndef reads\n  report = 5\n  report\nend\ndef calls\n  report\nend\n",
    })
    assert edges[("by_param", "Db.ask")] == AMBIGUOUS
    assert edges[("clean", "handler")] == EXACT and ("run", "handler") in lost
    assert edges[("outer", "help")] == EXACT
    assert edges[("call", "cb")] == EXACT
    assert edges[("calls", "report")] == EXACT and ("reads", "report") in lost
    # a module-level binding is seen from other definitions of the file
    assert edges[("by_module", "Db.ask")] == EXACT


def test_class_and_function_of_one_name(spark):
    edges, *_ = graph(spark, {"a.py": "class Make:\n    def go(self): pass\ndef Make(): pass\ndef use():\n    Make()\n    x = Make()\n    x.go()\n", "b.php": "<?php class Form {} function Form() {} function use2() { Form(); }\n"})
    assert edges[("use", "Make")] == AMBIGUOUS
    assert edges[("use", "Make.go")] == INFERRED
    assert edges[("use2", "Form")] == EXACT


def test_call_receivers_do_not_prove_a_class_outside_python(spark):
    edges, *_ = graph(spark, {"a.php": "<?php class Make { function go() {} } class More { function go() {} } function Make() {} function f() { Make()->go(); }\n", "b.rb": "class User\n  def save\n  end\nend\nclass Other\n  def save\n  end\nend\ndef a\n  x = User.where(1)\n  x.save\nend\ndef b\n  x = User.new\n  x.save\nend\n"})
    assert edges[("f", "Make.go")] == edges[("f", "More.go")] == AMBIGUOUS
    assert edges[("a", "User.save")] == AMBIGUOUS
    assert edges[("b", "User.save")] == EXACT


def test_dollar_names_of_javascript_are_their_own(spark):
    edges, *_ = graph(spark, {"a.js": "class Node1 { tick() {} }\nclass Node2 { tick() {} }\nfunction f() {\n  const $n = new Node1();\n  const n = new Node2();\n  $n.tick();\n  n.tick();\n}\n"})
    assert edges[("f", "Node1.tick")] == edges[("f", "Node2.tick")] == EXACT


def test_mixins_come_before_top_level(spark):
    edges, *_ = graph(spark, {"a.rb": "def aid\nend\nmodule Kit\n  def aid\n  end\nend\nclass Uses\n  include Kit\n  def go\n    aid()\n  end\nend\nclass Plain\n  def go2\n    aid()\n  end\nend\n"})
    assert edges[("Uses.go", "Kit.aid")] == INFERRED and ("Uses.go", "aid") not in edges
    assert edges[("Plain.go2", "aid")] == EXACT


def test_module_receivers(spark):
    edges, lost, *_ = graph(spark, {
        "app.py": "import util\nimport pkg.text\nimport os\ndef main():\n    util.aid()\n    pkg.text.draw()\n    os.getcwd()\n",
        "util.py": "def aid(): pass\n", "pkg/text.py": "def draw(): pass\n", "text.py": "def draw(): pass\ndef getcwd(): pass\n",
        "cmd/main.go": 'package main\nimport "app/store"\nfunc run() { store.Save() }\n', "app/store/s.go": "package store\nfunc Save() {}\n", "app/other/s.go": "package other\nfunc Save() {}\n",
    })
    assert edges[("main", "aid")] == edges[("main", "draw")] == EXACT
    assert ("main", "getcwd") in lost
    assert edges[("run", "Save")] == INFERRED


def test_same_file_comes_first(spark):
    edges, _, f, _ = graph(spark, {"a.py": "def aid(): pass\ndef use():\n    aid()\n", "b.py": "def aid(): pass\n", "c.py": "def far():\n    aid()\n"})
    assert edges[("use", "aid")] == EXACT
    assert edges[("far", "aid")] == AMBIGUOUS


def test_react(spark):
    edges, *_ = graph(spark, {
        "App.tsx": "export function App() {\n  return <div>don't<Screen x={1} /></div>;\n}\n",
        "Screen.tsx": "export const Screen = (p: Props) => {\n  const url = api('/x');\n  return <View a={url}>{p.items.map((i) => <Row key={i} />)}</View>;\n};\nexport const View = React.memo((p) => {\n  return <b>{p.a}</b>;\n});\nexport const Row = memo(function (p) { return <i />; });\nconst rows = items.map((x) => x);\n",
        "api.ts": "export function api(p: string) { return p; }\n",
    })
    assert edges == {("App", "Screen"): EXACT, ("Screen", "api"): EXACT, ("Screen", "View"): EXACT, ("Screen", "Row"): EXACT}


def test_wordpress_hooks(spark):
    php = """<?php
namespace Shop;
const BASE = 'shop/v1';
class Plug {
  const NS = 'plug/v1';
  function boot() {
    add_action('init', [$this, 'start']);
    \\add_filter("the_title", 'Shop\\\\trim_title');
    add_action('wp_ajax_nopriv_buy', [self::class, 'buy']);
    add_action('admin_post_save', array('Plug', 'buy'));
    add_action('shop_done', [Mailer::class, 'send']);
    add_action('x', function () { return 1; });
    add_action($name, [$this, 'start']);
    register_rest_route(self::NS, '/a', ['methods' => 'GET', 'callback' => [$this, 'buy']]);
    register_rest_route(BASE . '/b', '/c', ['callback' => [$this, 'buy'], 'permission_callback' => '__return_true']);
    register_rest_route('own', '/d', ['callback' => [$this, 'buy'], 'permission_callback' => [$this, 'may']]);
  }
  function start() {} function buy() {} function may() {}
  function end() { do_action('shop_done'); }
}
class Mailer { function send() {} }
class Rival { function send() {} }
function trim_title($t) { return $t; }
"""
    edges, _, f, hooks = graph(spark, {"plug.php": php})
    assert edges[("Plug.end", "Mailer.send")] == HOOK and ("Plug.end", "Rival.send") not in edges
    names = {s["id"]: s["name"] for s in f.symbols.collect()}
    rows = {h["hook"]: h for h in hooks.collect() if h["kind"] == "listen"}
    assert names[rows["init"]["callback_symbol"]] == "start" and not rows["init"]["entry_point"]
    assert names[rows["the_title"]["callback_symbol"]] == "trim_title" and rows["the_title"]["hook_class"] == "filter"
    assert rows["wp_ajax_nopriv_buy"]["hook_class"] == "ajax_nopriv" and rows["wp_ajax_nopriv_buy"]["unauth"]
    assert rows["admin_post_save"]["hook_class"] == "admin_post" and not rows["admin_post_save"]["unauth"]
    assert rows["x"]["cb_kind"] == "closure" and rows["x"]["callback_symbol"] is None
    assert rows["plug/v1/a"]["unauth"] and rows["plug/v1/a"]["note"] == "no permission_callback" and rows["plug/v1/a"]["hook_raw"] == "self::NS/a"
    assert rows["shop/v1/b/c"]["unauth"] and not rows["own/d"]["unauth"]
    assert names[rows["own/d"]["callback_symbol"]] == "buy"


def test_callbacks_are_never_guessed(spark):
    _, _, f, hooks = graph(spark, {"a.php": "<?php add_action('one', 'dup'); add_action('two', ['Ns\\\\Box', 'go']); add_action('three', ['Gone', 'solo']);\nclass Has { function solo() {} }", "b.php": "<?php function dup() {} class Box { function go() {} }", "c.php": "<?php function dup() {} class Box { function go() {} }"})
    assert all(h["callback_symbol"] is None for h in hooks.collect())


def test_signals_tasks_and_routes(spark):
    edges, _, f, hooks = graph(spark, {
        "sig.py": "from django.dispatch import receiver\npaid = Signal()\n@receiver([post_save, paid])\ndef on_paid(sender): pass\n@receiver(signal=post_save)\ndef none(): pass\ndef by_connect(): pass\npaid.connect(by_connect)\npaid.connect(receiver=by_connect)\nsock.connect(by_connect)\ndef pay():\n    paid.send()\n    sock.send()\n    job.send()\n",
        "tasks.py": "@shared_task\ndef job(): pass\n@app.task(bind=True)\ndef later(): pass\ndef go():\n    job.delay()\n    later.apply_async()\n    thing.delay()\n",
        "urls.py": "urlpatterns = [path('x/', views.show), re_path('y', other)]\n@app.route('/z')\ndef z(): pass\n@api.get\ndef plain(): pass\n", "views.py": "def show(): pass\n",
    })
    assert edges[("pay", "on_paid")] == HOOK and edges[("pay", "by_connect")] == HOOK
    assert ("pay", "job") not in edges
    assert edges[("go", "job")] == edges[("go", "later")] == HOOK
    names = {s["id"]: s["name"] for s in f.symbols.collect()}
    routes = {h["hook"]: names.get(h["callback_symbol"]) for h in hooks.collect() if h["hook_class"] == "route" and h["entry_point"]}
    assert routes == {"x/": "show", "y": None, "/z": "z", "plain": "plain"} or routes == {"x/": "show", "/z": "z", "plain": "plain", "other": None, "y": None}


def test_broken_code_keeps_what_can_be_read(spark):
    _, _, f, _ = graph(spark, {
        "a.php": "<?php class Torn {\n  function one() { $this->two(; }\n  function two() { if ( { }\n  }\n}\nfunction free() {}\n",
        "b.py": "def good():\n    return 1\ndef bad(:\n    pass\ndef also_good():\n    return good()\n",
        "c.js": "class Half { m() { return this.n(; } n() {} }\nfunction after() {}\n",
    })
    got = {(s["file"], s["name"]): s for s in f.symbols.collect()}
    assert got[("a.php", "one")]["container"] == "Torn" and got[("a.php", "free")]["container"] is None
    assert ("b.py", "good") in got and ("b.py", "also_good") in got
    assert got[("c.js", "after")]["kind"] == "function"


def test_positions_survive_wide_characters(spark):
    src = "# é 🙂\ndef un():\n    return deux()\n\n\ndef deux():\n    return 'ü'\n"
    js = "// é 🙂\nfunction un() { return deux('é'); }\nfunction deux() {}\n"
    _, _, f, _ = graph(spark, {"a.py": src, "b.js": js})
    for s in f.symbols.collect():
        raw = (src if s["file"] == "a.py" else js).encode()[s["start_byte"] : s["end_byte"]].decode()
        assert raw.startswith(("def " if s["file"] == "a.py" else "function ") + s["name"])
        assert s["signature"] == raw.splitlines()[0].strip()[:200]


def test_site_counts_make_no_edges(spark, monkeypatch):
    from callweave.operators import aggregates
    from callweave.plans import queries, resolve
    from callweave.sources import tables

    sf = "/root/testdata/sf0.001"
    r = resolve.resolve_refs(tables.facts(spark, sf, "symbols", "refs", "assigns"))
    want = aggregates.site_counts(resolve.call_edges(r), resolve.unresolved_calls(r)).first().asDict()
    monkeypatch.setattr(resolve, "candidates", None)
    assert queries.site_counts(spark, sf).first().asDict() == want and want["edge_rows"] > want["edges_ambiguous"] > 0


def test_candidates_come_in_pieces(spark, monkeypatch):
    from callweave.plans import queries, resolve

    members = spark.range(3000).selectExpr("id % 2 as k", "id as dst")
    got = resolve.pieces(members, ["k"]).collect()
    assert sorted(x for r in got for x in r["dsts"]) == list(range(3000)) and 2 <= len(got) <= 6
    assert all(x % 2 == r["k"] for r in got for x in r["dsts"])
    # calls meet pieces and no single candidates, and the size of pieces changes no edge
    sf, made = "/root/testdata/sf0.001", []
    rows = lambda q: sorted(tuple(map(str, r)) for r in q(spark, sf).collect())
    want = {q: rows(q) for q in (queries.resolve_edges, queries.module_edges)}
    whole = resolve.sent
    monkeypatch.setattr(resolve, "sent", lambda d, name: made.append(whole(d, name)) or made[-1])
    monkeypatch.setattr(resolve, "PIECE", 2)
    monkeypatch.setattr(resolve, "SENT", 0)
    for q in want:
        assert rows(q) == want[q]
    assert made and all(max((len(r["dsts"]) for r in d.collect()), default=0) < 20 for d in made)


def test_rows_are_made_by_one_step_after_the_branches(spark):
    """Branches hand on pieces, so that a reader of the rows is compiled with the step that makes them."""
    from callweave.plans import queries

    for q in (queries.module_edges, queries.resolve_edges):
        plan = q(spark, "/root/testdata/sf0.001").groupBy().count()._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Generate explode(dsts") == 1 and plan.index("Generate explode(dsts") < plan.index("Union"), plan


def test_rows_of_calls_that_ask_the_same_stand_together(spark, monkeypatch):
    """Files of edges hold runs of one call and repeats of one piece, so they stay small; bundles and tasks change no edge."""
    from callweave.plans import queries, resolve
    from callweave.sources import tables

    sf = "/root/testdata/sf0.001"
    for facts in (tables.module_facts(spark, sf), tables.facts(spark, sf, "symbols", "refs", "assigns")):
        rows = resolve.resolve_refs(facts).where("resolution <> 'unresolved'").collect()
        turns = sum(a["callee"] != b["callee"] for a, b in zip(rows, rows[1:]))
        assert len({r["ref_id"] for r in rows}) > 3000 > 4 * turns > 0, turns
    want = {q: sorted(tuple(map(str, r)) for r in q(spark, sf).collect()) for q in (queries.resolve_edges, queries.module_edges)}
    for k, v in {"BUNDLE": 2, "CALLS": 1500, "PIECE": 3}.items():
        monkeypatch.setattr(resolve, k, v)
    for q in want:
        assert sorted(tuple(map(str, r)) for r in q(spark, sf).collect()) == want[q]


def test_other_classes_of_a_bunch(spark, monkeypatch):
    """A call of a parent leaves out its own class wherever its methods lie in a bunch."""
    from callweave.model import Facts
    from callweave.plans import resolve

    monkeypatch.setattr(resolve, "PIECE", 4)
    symbols = [(10 * c + i, f"f{c}.py", "go", "method", f"C{c}", "python") for c in range(3) for i in range(c + 2)]
    symbols += [(100 + c, f"f{c}.py", f"call{c}", "method", f"C{c}", "python") for c in range(4)] + [(200, "g.py", "top", "function", None, "python")]
    refs = [(c, f"f{c}.py", "python", "go", "super()", 1, 100 + c) for c in range(4)] + [(9, "g.py", "python", "go", "super()", 1, 200)]
    f = Facts(
        spark, symbols=spark.createDataFrame(symbols, "id long, file string, name string, kind string, container string, lang string"),
        refs=spark.createDataFrame(refs, "id long, file string, lang string, callee string, receiver string, line int, src_symbol long"),
    )
    got = {(r["ref_id"], r["dst"]) for r in resolve.resolve_refs(f).collect()}
    goes = [(x[0], x[4]) for x in symbols if x[2] == "go"]
    assert got == {(r[0], d) for r in refs for d, c in goes if c != f"C{r[0]}"}


def test_the_jvm_compiles_every_method_of_the_pools(spark, monkeypatch):
    """HotSpot interprets methods of more than 8,000 bytes of code for ever."""
    import re

    from callweave.plans import resolve
    from callweave.sources import tables

    sizes, store = [], resolve.stored
    module = spark._jvm.org.apache.spark.sql.execution.debug
    code = getattr(getattr(module, "package$"), "MODULE$").codegenString

    def seen(df, name):
        if name == "refs":
            sizes.append([int(n) for n in re.findall(r"maxMethodCodeSize:(-?\d+)", code(df._jdf.queryExecution().executedPlan()))])
        return store(df, name)

    conf = {"spark.sql.codegen.wholeStage": "true", "spark.sql.codegen.factoryMode": "FALLBACK", "spark.sql.autoBroadcastJoinThreshold": "10MB"}
    old = {k: spark.conf.get(k) for k in conf}
    monkeypatch.setattr(resolve, "stored", seen)
    sf = "/root/testdata/sf0.001"
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        for facts in (tables.facts(spark, sf, "symbols", "refs", "assigns"), tables.module_facts(spark, sf)):
            resolve.call_sites(facts)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(sizes) == 2 and all(len(s) > 5 and min(s) > 0 and max(s) < 8000 for s in sizes), sizes
