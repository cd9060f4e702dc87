"""The TypeScript scanner: forms of the rules, types and scopes, and linear cost."""
import time

import pytest

from deadwire.functions.ts_scan import scan_file


def names(text, ext):
    return [(name, line) for e, _, _, name, line in scan_file(text, lambda n: len(n) > 1) if e == ext]


@pytest.mark.parametrize("text,want", [
    ("function f(){const p={aa:1};fetch(u,{method:'post',body:JSON.stringify(p)})}\n"
     "function g(){const p={bb:1};fetch(u,{method:'PUT',body:JSON.stringify(p)})}", [("aa", 1), ("bb", 2)]),
    ("axios.post<User>(`/a/${enc(String(id))}`, {username, pass: 1})", [("username", 1), ("pass", 1)]),
    ("fetch(u,{method:'post',body:JSON.stringify({top:{a:{b:{c:{d:{e:{f:1}}}}}}})})", [("top", 1)]),
    ("fetch(u,{method:'post',body:JSON.stringify({pretty:1}, null, 2)},)", [("pretty", 1)]),
    ("const v={aa:1};fetch(u,{method:'post',body:JSON.stringify(v, null, 2)})", [("aa", 1)]),
    ("this.axios.post(u, {no: 1}); axios.get(u, {no: 1})", []),
    ("c ? body : JSON.stringify({tern: 1}); x = {body: JSON.stringify({nested: 1})}", [("tern", 1)]),
    ("const v = {aa: 1} as const; fetch(u,{method:'post',body:JSON.stringify(v)})", []),
    ("function f(v){fetch(u,{method:'post',body:JSON.stringify(v)})}\nconst v={aa:1}", []),
    ("axios.post(u, {...rest, get x(){return 1}, m(){}, [k]: 1, 'quoted': 2})", [("quoted", 1)]),
])
def test_request(text, want):
    assert names(text, "ts_request_defs") == want


@pytest.mark.parametrize("text,want", [
    ("res.status(codeOf(err)).json({okay: 1})", [("okay", 1)]),
    ("const out={alpha:1}\nres.json(out)\nres.json({alpha:2, beta:3})", [("alpha", 1), ("beta", 3)]),
    ("app.res.json({no: 1}); other.json({no: 1}); res.json([{no: 1}])", []),
    ("reply\n  .send({\n    aa: 1,\n    bb,\n  })", [("aa", 3), ("bb", 4)]),
])
def test_response(text, want):
    assert names(text, "ts_response_defs") == want


@pytest.mark.parametrize("text,want", [
    ("const { aa = pick(xx, yy), bb: { cc, ...dd } } = o", ["aa", "bb", "cc", "dd"]),
    ("let v: ns.TypeName = data.hello; x as ns.Foo; foo<ns.Bar>(z.val)", ["hello", "val"]),
    ("class A extends ns.Base implements ns.I { f: ns.T = this.qq ? a.bb : c.dd }", ["Base", "qq", "bb", "dd"]),
    ("type Z = ns.A | ns.B<ns.C>\ninterface Q { a: ns.T }\nobj.real", ["real"]),
    ("const re = /['\"]/; data.afterRegex; const q = a / b; c.div", ["afterRegex", "div"]),
    ("`x ${a.inTpl + `${b.nested}`} y ${c.more}`", ["inTpl", "nested", "more"]),
    ("return <p onClick={() => user.hit}>Don't {user.name} and/or won't {user.mail}</p>", ["hit", "name", "mail"]),
    ("function q(a: ns.T, { pp, qq }: { pp: ns.U }): ns.V { return a.bcd }", ["bcd", "pp", "qq"]),
    ("xs.each(({ id1, nm }) => id1); for (const { k1 } of ys) {}", ["each", "id1", "nm", "k1"]),
    ("// a.no\n/* b.no */ 'c.no'; d?.yes", ["yes"]),
])
def test_reads(text, want):
    assert [n for n, _ in names(text, "ts_reads")] == want


def test_chain_is_reported_where_it_starts():
    assert names("\nfoo\n  .aa()\n  .bb", "ts_reads") == [("aa", 2), ("bb", 2)]


def seconds(text):
    begin = time.process_time()
    scan_file(text, lambda n: True)
    return time.process_time() - begin


@pytest.mark.parametrize("make", [
    lambda n: "const a=[" + ",".join("{x1:1,y1:[1,2]}" for _ in range(n)) + "]",
    lambda n: "draw({ x1: 1 }, [" + ",".join(map(str, range(4 * n))) + "])",
    lambda n: "if(a){" * n + "res.json({q1:1})" + "}" * n,
    *[lambda n, s=s: s * n for s in ("(", "{", "[", "a.b(", "`${", "a<b<", "const ", "class ", "x=>", "a as ", "f(a):",
                                     "a.b().c()", "res.json({", "let a:", "?a:", "'", "/", "a<b>(")],
])
def test_cost_is_linear(make):
    seconds(make(500))
    small, large = min(seconds(make(5000)) for _ in range(2)), seconds(make(20000))
    assert large < 12 * small + 0.2


def test_twenty_deep_body():
    deep = "{a1:" * 20 + "1" + "}" * 20
    assert names(f"fetch(u,{{method:'post',body:JSON.stringify({deep})}})", "ts_request_defs") == [("a1", 1)]
