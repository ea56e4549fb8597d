import ast
import itertools
import json
import random

import numpy as np
import pytest

from skein.llm import documented as D
from skein.llm import handwritten as H
from skein.llm import syntax as S
from skein.llm.chart import compile_rules
from skein.llm.frames import frames
from skein.llm.triviality import informative

GOOD_PY = [
    "", "\n# only a comment\n", "x = 1\n", "if a: b\nelif c: d\nelse: e\n", "try:\n    pass\nexcept (A, B) as e:\n    raise\nelse:\n    x\nfinally:\n    y\n", "def f(a, /, b: int = 1, *c, d=2, **e) -> int: ...\n",
    "@a.b(c)\nasync def f():\n    async with x as y, z:\n        await g()\n    return [i async for i in y if i]\n", "match x:\n    case {'a': [1, *_], **r} if r:\n        pass\n    case A(b=1) | None as c:\n        pass\n    case _:\n        pass\n",
    "match = case = 1\nmatch[case](type)\n", "x: dict[str, int] = {**a, 'b': 2}\n", "print(f'{a!r:>{w}} {\"x\"}', *b, sep='')\n", "lambda *a, b=1, **c: (yield)\n", "a, *b = c = d, e\n", "with (open(a) as b, c):\n    pass\n", "for x, in y: continue\nelse: pass\n",
    "class A[T: int](B, metaclass=C):\n\tx = 1\n\n\tdef f(self): return self\n", "s = '''a\n  b'''; t = r\"\\\\\"\n", "x = (1,\n  # c\n  2)[::2, ...]\n", "type X[T] = list[T]\n", "global a, b\ndel a[0], b.c\nassert x, 'm'\nraise A from b\n", "if (n := f(x)) > 3 and not y or z is not None: pass\n", "from . import (a, b as c,)\nfrom ..d.e import *\n", "x = {k: v for k, v in y if k}\nx @= y ** -z\n", "x = y if a else lambda: z\r\nprint(x)\r\n",
]
BAD_PY = ["def f(:\n    pass\n", "x = = 1\n", "print 'a'\n", "if x\n    y\n", "if x:\npass\n", "  x = 1\n", "x = [1, 2\n", "x = 'a\n", "'''open\n", "<<<<<<< HEAD\nx = 1\n=======\nx = 2\n>>>>>>> b\n", "try:\n    x\ny\n", "else:\n    x\n", "def f():\n    x\n  y\n", "x = 5a\n", "<html>\n<p>Hi</p>\n</html>\n", "f(x for)\n", "return return\n", "a ? b : c\n", "except A, e:\n    pass\n", "class A:\n"]
GOOD_RS = [
    "", "// } { only\n", "use a::{b, c as d, e::*};\npub(crate) mod x;\n", "pub struct A<'a, T: B + 'a = u8> where T: C { pub x: &'a [T; 3], y: Option<Vec<u8>> }\nstruct U;\nstruct P(pub u8, T);\n", "enum E { A, B(u8, i32), C { x: u8 } = 3 }\n", "#[derive(Debug)]\npub fn f<T>(mut a: &mut T, _: u8) -> Result<(), Box<dyn E + Send>> { a.b()?; Ok(()) }\n",
    "impl<T> A for B<T> { const X: u8 = 1; type Y = u8; fn g(&self) -> u8 { self.x } }\n", "fn f() { let x = match y { Some(A { a, .. }) if a > 1 => { 1 } None | Some(_) => |a, b| a + b, 1..=5 => return, _ => {} }; }\n", "fn f() { for (i, x) in y.iter().enumerate() { if i > 2 { continue; } else if let Some(z) = x { break; } } while a < b && c { } loop {} }\n", "fn f() { let got = '{'; let s = \"} {\"; let r = r#\"{ \"a\" \"#; /* } /* nested { */ */ let l: &'static str = s; }\n",
    "fn f() { vec![1; 3]; println!(\"{}\", x); let v: Vec<_> = a.iter().map(|x| x.y::<u8>() as u32 * 2).collect(); S { a, b: 1, ..d }; if x == y {} x = y; }\n", "pub static X: [u8; 2] = [0x1f, 2];\nconst Y: &[(&str, u8)] = &[(\"a\", 1),];\n", "trait T<'a>: Sized { fn f(&'a self) -> u32; fn g() {} }\n", "macro_rules! m { ($a:expr) => { $a }; }\nm!(x);\n", "fn f() -> impl Fn(u8) -> u8 { move |x: u8| -> u8 { x >> 1 } }\n", "fn f() { unsafe { *p = 1 }; let Some(x) = y else { return; }; 'a: loop { break 'a 1; } }\n", "unsafe extern \"C\" { fn a(x: *const u8); }\nasync fn b() { c().await; }\n",
]
BAD_RS = ["fn f() {\n", "fn f( {}\n", "let x = 1;\n", "fn f() { let x 1; }\n", "struct A { x u8 }\n", "fn f() { match x { 1 => } }\n", "def f(x):\n    return x\n", "fn f() -> { }\n", "fn f() { \"open }\n", "<<<<<<< a\nfn f() {}\n=======\nfn g() {}\n>>>>>>> b\n", "enum { A }\n", "impl A { let x = 1; }\n", "fn f() { a b c; }\n", "/* open\nfn f() {}\n", "fn f() { x } }\n", "pub A { x: u8 }\n", "# Title\n\nSome words here.\n"]


def broken(path, text):
    return not all(S.parses(f) for f, _ in frames(path, text))


def test_python_frames_agree_with_the_parser():
    for text in GOOD_PY:
        ast.parse(text)
        assert not broken("a.py", text), text
    for text in BAD_PY:
        with pytest.raises(SyntaxError):
            ast.parse(text)
        assert broken("a.pyi", text), text
    own = open(S.__file__).read()
    assert not broken("a.py", own)


# texts whose tokens are fine one by one: order of members, targets, kinds of strings, escapes, f-string fields, tabs
DISORDERED = [
    "f(a=1, b)", "f(x for x in y, 1)", "f(x for x in y,)", "f(**k, *a)", "class A(x for x in y): pass", "def f(a=1, b): pass", "def f(*): pass", "def f(*, **k): pass", "def f(**k, a): pass", "def f(/): pass", "lambda *: 0", "lambda a=1, b: 0", "x := 5", "(a + b) = 1",
    "[1, 2] = x", "a, (b, c()) = d", "for (a + b) in c: pass", "[x for (a()) in y]", "[x for x in y if lambda: z]", "del (a + b)", "with a as (b + c): pass", "with (a as b), c: pass", "with (a as b + c): pass", "(a as b)", "(a, b) += 1", "(a, b): int", "x = (*a)", "(*a) = 1",
    "if a: (b + c) = 1", "match x:\n case A(b=1, c): pass", "match x:\n case {**r, 'a': 1}: pass", "match *a:\n case 1: pass", "b'a' 'b'", "f'a' b'b'", "('a'\n b'c')", "b'\u00e9'", "'\\x'", "b'\\x1'", "'\\u12'", "'\\N{foo}'", "'\\U00110000'", "f'{a:\\x}'",
    "f'{}'", "f'{ }'", "f'{a b}'", "f'}'", "f'{a!x}'", "f'{a! r}'", "f'{lambda x: 1}'", "f'{a=b}'", "f'{a:{}}'", "f'{a;b}'", "f'{b'a' 'c'}'", "f'{a#}'", "if a:\n\tx\n        y\n", "if a:\n        x\n\ty\n", "if a:\n    if b:\n\tx\n",
]
ORDERED = [
    "f(a=1, *b)", "f(*a, b, c=1, **k, d=2)", "f(x for x in y)", "def f(a, /, b=1, *, c, d=2, **k,): pass", "def f(a: int = 1, *b: *c, d): pass", "lambda a, /, *, b: 0", "(a, [b, *c]) = d", "(f(x)).y = [a][0] = () = 1", "((a)) = b = (c, d)", "x = lambda a=1: (a)", "if a: (b) = 1", "for (a, [b]) in c, (d + 1): pass", "del (a, [b]), c", "with (a as (b, c), d as [e],): pass",
    "with (a, b) as (c, d): pass", "with (yield): pass", "(a) += 1", "x: (a, b) = (c + 1)", "match x:\n case A(b, c=1): pass", "match x:\n case {'a': 1, **r}: pass", "b'a' b'b'", "f'a' 'b' r'\\x'", "rb'\\x'", "'\\N{EM DASH}'", "f'\\N{EM DASH}{a:\\N{EM DASH}>3}'", "rf'\\N{a}'", "f'\\{a}'", "f'{{}}'",
    "f'{a = !r}'", "f'{a!=b!r:>{w}}'", "f'{(a:=5)}'", "f'{a:=5}'", "f'{*a, b}'", "f'{f'{'a'}'}'", "f'''{'''a'''}'''", "f'{ {1: 2}[1] }'", "f'{x:%H:%M}'", "if a:\n\tif b:\n\t    x\n\ty\n",
]


def test_order_targets_and_strings_agree_with_the_parser():
    for text in ORDERED:
        ast.parse(text)
        assert not broken("a.py", text), text
    for text in DISORDERED:
        with pytest.raises((SyntaxError, ValueError)):
            ast.parse(text)
        assert broken("a.py", text), text


def test_cuts_of_python_agree_with_the_parser():
    """Truncation at any place of a text that holds most statements."""
    text = "".join(GOOD_PY)
    for at in range(0, len(text), 7):
        try:
            ast.parse(text[:at])
            ok = True
        except SyntaxError:
            ok = False
        if ok:
            assert not broken("a.py", text[:at]), text[:at][-60:]
        elif not broken("a.py", text[:at]):
            pytest.fail(text[:at][-60:])


def test_rust_frames():
    for text in GOOD_RS:
        assert not broken("a.rs", text), (text, [f for f, _ in frames("a.rs", text) if not S.parses(f)])
    assert not broken("a.rs", "".join(GOOD_RS))
    for text in BAD_RS:
        assert broken("a.rs", text), text


def test_least_edits_against_brute_force():
    g = compile_rules("\nS : a S b S\nS : c ?\n".strip() + "\n")
    alphabet = "abc"
    words = [list(w) for n in range(6) for w in itertools.product(alphabet, repeat=n) if g.parse("S", list(w)) < 0]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(before + (x != y), row[j] + 1, row[j - 1] + 1)
        return row[-1]

    rng = random.Random(2)
    for _ in range(60):
        text = [rng.choice(alphabet + "x") for _ in range(rng.randint(0, 4))]
        cost, exact, edits = g.repair("S", text)
        assert exact and cost == len(edits) == min(distance(text, w) for w in words), text
        assert g.least("S", text)[0] <= cost
        mended, gone = [], {at: token for op, at, token in edits if op != "insert"}
        for at in range(len(text) + 1):
            mended += [token for op, i, token in edits if op == "insert" and i == at]
            op = next((o for o, i, _ in edits if i == at and o != "insert"), "")
            mended += [] if op == "delete" or at == len(text) else [gone[at]] if op == "replace" else [text[at]]
        assert len(gone) + sum(o == "insert" for o, _, _ in edits) == cost and g.parse("S", mended) < 0, (text, edits)
    cost, exact, edits = g.repair("S", list("bbbbbbbb"), effort=10)
    assert not exact and 1 <= cost <= g.repair("S", list("bbbbbbbb"))[0] and edits


def test_least_edits_of_random_grammars():
    """Against the costs of all spans, worked out until nothing changes."""
    rng = random.Random(4)

    def least(g, start, text):
        n, big = len(text), 99
        cost = {(x, i, j): big for x in g.rules for i in range(n + 1) for j in range(i, n + 1)}

        def part(x, i, j):
            if x in g.rules:
                return cost[x, i, j]
            return 1 if i == j else j - i - (x in text[i:j])

        def whole(alt, i, j):
            if not alt:
                return j - i
            return min(part(alt[0], i, k) + whole(alt[1:], k, j) for k in range(i, j + 1))

        changed = True
        while changed:
            changed = False
            for x, i, j in cost:
                now = min(whole(alt, i, j) for alt in g.rules[x])
                changed |= now < cost[x, i, j]
                cost[x, i, j] = min(now, cost[x, i, j])
        return cost[start, 0, n]

    for _ in range(80):
        rules = {x: [[rng.choice("STUabcd") for _ in range(rng.randint(1, 4))] for _ in range(2)] + [[rng.choice("abcd") for _ in range(rng.randint(1, 2))]] for x in "STU"}
        g = compile_rules("\n".join(f"{x} : " + " | ".join(map(" ".join, alts)) for x, alts in rules.items()) + "\n")
        text = [rng.choice("abcdx") for _ in range(rng.randint(1, 6))]
        cost, exact, edits = g.repair("S", text)
        assert exact and cost == len(edits) == least(g, "S", text), (rules, text)


def test_searches_are_never_given_up(spark):
    """A template in a Rust file: this search ended at a lower bound before."""
    text = "< ! N N > < N > < N N = s > < N > N N < / N > < N > N N < / N > < N > N N < / N > < / N > < / N >"
    cost, exact, edits = S.frame_repair("rs:CtxItem " + text)
    assert (cost, exact, len(edits)) == (15, True, 15)
    df = spark.createDataFrame([("a.py", "x = (1\n"), ("b.py", "x = 1\n"), ("c.rs", "fn f( {}\n"), ("c.rs", "fn f( {}\n"), ("d.py", None)], "rel_path string, content string")
    assert sorted(r[0] for r in S.rejected(df).collect()) == sorted(r["rel_path"] for r in S.repaired(df).collect()) == ["a.py", "c.rs"]


def test_repaired_files(spark):
    rows = [(f"r/g{i}.py", t) for i, t in enumerate(GOOD_PY)] + [(f"r/g{i}.rs", t) for i, t in enumerate(GOOD_RS)] + [(f"r/b{i}.py", t) for i, t in enumerate(BAD_PY)] + [(f"q/b{i}.rs", t) for i, t in enumerate(BAD_RS)]
    rows += [("r/null.py", None), ("r/x.txt", "}{"), ("r/b0.py", BAD_PY[0])]
    df = spark.createDataFrame(rows, "rel_path string, content string")
    got = {r["rel_path"]: r for r in S.repaired(df).collect()}
    assert set(got) == {p for p, _ in rows if "/b" in p}
    assert got["r/b9.py"]["reason"] == "conflict" and got["r/b6.py"]["reason"] == "truncated" and got["q/b9.rs"]["reason"] == "conflict"
    assert (got["r/b9.py"]["cost"], got["r/b9.py"]["first_line"], got["r/b9.py"]["last_line"], got["r/b9.py"]["exact"]) == (3, 1, 5, True)
    assert all(r["cost"] >= 1 for r in got.values())
    rates = {(r["repo"], r["language"]): (r["files"], r["failed"]) for r in S.failure_rates(S.repaired(df), df).collect()}
    assert rates == {("r", "python"): (len(GOOD_PY) + len(BAD_PY), len(BAD_PY)), ("r", "rust"): (len(GOOD_RS), 0), ("q", "rust"): (len(BAD_RS), len(BAD_RS))}
    assert S.repaired(df.limit(0)).count() == 0


BODY_PY = "".join(f"def f{i}(a, b=1):\n    \"\"\"Adds.\"\"\"\n    x = [a, b, {i}]\n    return sum(x)\n\n\n" for i in range(6))
BODY_RS = "".join(f"/// Adds.\nfn f{i}(a: u8) -> u8 {{\n    let x = a + {i};\n    x\n}}\n\n" for i in range(6))
PROSE = "This is a plain text about the harbour.\nIt holds no code at all, only words.\nNobody can parse these lines here.\nThe end comes soon now, I think.\n"


def test_reasons_come_from_edits(spark):
    mark = "<<<<<<< ours\nx = 1\n=======\nx = 2\n>>>>>>> theirs/feature: y\n"
    rows = {
        "truncated": [("a.py", BODY_PY + "def g(a, b"), ("b.py", BODY_PY + "def g(a):\n"), ("c.py", BODY_PY + "x = foo +"), ("d.py", BODY_PY + "def g():\n    \"\"\"Open and\n    long"), ("e.rs", BODY_RS + "fn g(a: u8) {\n    let x = 1;\n"), ("f.rs", BODY_RS + "/* open"), ("g.rs", BODY_RS + "fn g(")],
        "conflict": [("h.py", BODY_PY + mark + BODY_PY), ("i.py", "def f():\n    a()\n" + mark.replace("x =", "    x =") + "    b()\n"), ("j.rs", BODY_RS + mark.replace("x = 1", "fn a() {}").replace("x = 2", "fn a() { b(); }") + BODY_RS)],
        "other_language": [("k.py", PROSE), ("l.rs", PROSE), ("m.rs", BODY_PY), ("n.py", BODY_RS)],
        "broken": [("o.py", BODY_PY + "x = = 1\n" + BODY_PY), ("p.rs", BODY_RS + "fn g() { let x 1; }\n" + BODY_RS), ("q.py", "if x:\n    S = '<<<<<<< '\n  y = 1\n" + BODY_PY)],
    }
    df = spark.createDataFrame([(p, t) for files in rows.values() for p, t in files], "rel_path string, content string")
    got = {r["rel_path"]: r for r in S.repaired(df).collect()}
    assert {p: r["reason"] for p, r in got.items()} == {p: reason for reason, files in rows.items() for p, _ in files}
    assert all(got[p]["cost"] == 1 for p in ("b.py", "c.py", "o.py", "p.rs"))
    assert got["h.py"]["cost"] == got["i.py"]["cost"] == got["j.rs"]["cost"] == 3  # the three marks come out
    assert got["o.py"]["first_line"] == BODY_PY.count("\n") + 1


def test_edits_of_long_lists_are_all_counted(spark):
    df = spark.createDataFrame([("a.py", "x = [" + "a b, " * 300 + "]\n"), ("b.py", "x = [" + "a, " * 500 + "b c]\n")], "rel_path string, content string")
    got = {r["rel_path"]: (r["cost"], r["exact"]) for r in S.repaired(df).collect()}
    assert got["b.py"] == (1, True) and got["a.py"][0] <= 300 and (got["a.py"][0] == 300 or not got["a.py"][1])


def test_informative():
    for text in [None, "", "  ", "---", "TODO", "See parent.", "Returns:", ":param x:", "The read file function.", "read_file()", "Reads the file.", "Documentation will be added in a later release.", "@inheritDoc", "N/A"]:
        assert not informative(text, "read_file"), text
    for text in ["Write the text to the file", "Returns the first line of the text", "Fill missing values", "Busy wins.", "Liest alle Zeilen.", "TODO: drop it; closes the handle in the meantime.", "see disk.block: copies, never moves", "Bytes per line"]:
        assert informative(text, "read_file"), text


def test_assignment_of_least_cost_against_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        n, m = rng.randint(1, 4), rng.randint(1, 4)
        links = {(i, j): rng.random() * 8 for i in range(n) for j in range(m) if rng.random() < 0.7}
        chosen = D.assign(links, 5.0)
        assert len(set(chosen.values())) == len(chosen) and all((f, c) in links for f, c in chosen.items())
        cost = lambda pick: sum(links[p] for p in pick) + 5.0 * (len({i for i, _ in links}) - len(pick))
        best = min(cost(p) for k in range(len(links) + 1) for p in itertools.combinations(links, k) if len({a for a, _ in p}) == len({b for _, b in p}) == k) if len(links) <= 12 else None
        if best is not None:
            assert cost(list(chosen.items())) == pytest.approx(best)


CODE = "# Opens a socket to the mirror.\n# :param host: where it listens\n@cached\ndef connect(host):\n    return host\n\n\ndef close(handle):\n    '''Flushes pending bytes before the handle goes.'''\n    return handle\n\n\ndef noop():\n    # TODO\n    pass\n"


def test_pairs(spark):
    schema = "id string, kind string, name string, file_path string, line_start int, line_end int, metadata_json string, semantic_json string"
    meta = json.dumps({"parameters": [{"name": "host"}]})
    rows = [
        ("1", "function", "connect", "a.py", 4, 5, meta, None), ("2", "method", "close", "a.py", 8, 10, None, '{"purpose": " ", "summary": "Close."}'), ("3", "function", "noop", "a.py", 13, 15, None, '{"purpose": "Keeps the loop alive"}'),
        ("3", "function", "noop", "a.py", 13, 15, None, '{"purpose": "Keeps the loop alive"}'), ("4", "function", "lost", "gone.py", 1, 2, None, '{"summary": "Counts retries"}'), ("5", "function", "cut", "a.py", None, None, None, '{"purpose": "bad'), ("6", "class", "K", "a.py", 1, 2, None, '{"purpose": "A class"}'), ("7", "function", "bare", None, None, None, "{", "null"),
    ]
    files = spark.createDataFrame([("a.py", CODE), ("a.py", CODE), ("b.py", None)], "rel_path string, content string")
    got = {r["id"]: r for r in D.documented(spark.createDataFrame(rows, schema), files).collect()}
    assert {k: (r["documentation"], r["source"]) for k, r in got.items()} == {
        "1": ("Opens a socket to the mirror.\n:param host: where it listens", "comment"), "2": ("Flushes pending bytes before the handle goes.", "comment"), "3": ("Keeps the loop alive", "record"), "4": ("Counts retries", "record"),
    }
    assert got["1"]["code"].startswith("def connect") and got["4"]["code"] is None
    assert D.documented(spark.createDataFrame([], schema), files).count() == 0
    assert {(r["id"], r["source"]) for r in D.documented(spark.createDataFrame(rows, schema), files, code=False).collect()} == {(k, r["source"]) for k, r in got.items()}


def test_pairs_far_from_their_comments(spark):
    """Long heads, many decorators and functions far down in a long file; a comment belongs to one function."""
    schema = "id string, kind string, name string, file_path string, line_start int, line_end int, metadata_json string, semantic_json string"
    head = "def wide(\n" + "".join(f"    a{i}: int,\n" for i in range(60)) + "):\n    \"\"\"Spans sixty parameters.\"\"\"\n"
    marks = "# Runs after every hook.\n" + "@hook\n" * 60 + "def late():\n    pass\n"
    text = "x = 1\n" * 9000 + head + "x = 1\n" * 20 + marks + "def other():\n    pass\n"
    line = lambda part: text[: text.index(part)].count("\n") + 1
    rows = [("w", "function", "wide", "a.py", line("def wide"), line("def wide") + 62, None, None), ("l", "function", "late", "a.py", line("def late"), line("def late") + 1, None, None), ("o", "function", "other", "a.py", line("def other"), line("def other") + 1, None, None)]
    rows += [(f"n{i}", "function", f"f{i}", None, i, i, None, '{"purpose": "Counts retries"}') for i in range(50)] + [("past", "function", "past", "a.py", 10**6, 10**6, None, '{"summary": "Lies past the end"}')]
    got = {r["id"]: (r["documentation"], r["source"]) for r in D.documented(spark.createDataFrame(rows, schema), spark.createDataFrame([("a.py", text)], "rel_path string, content string")).collect()}
    assert got["w"] == ("Spans sixty parameters.", "comment") and got["l"] == ("Runs after every hook.", "comment") and "o" not in got
    assert got["past"][1] == "record" and sum(k.startswith("n") for k in got) == 50


def test_records_and_comments_compete_in_the_assignment():
    f = {"id": "1", "name": "connect", "metadata_json": json.dumps({"parameters": [{"name": "host"}]}), "line_start": 2, "line_end": 3}
    text = "# Connects to a host. :param host: a name\ndef connect(host):\n    pass\n"
    assert D.match_file("a.py", [f | {"stated": "Opens a socket"}], text, False) == [("1", "connect", "Opens a socket", "record", None)]
    assert D.match_file("a.py", [f | {"stated": None}], text, False)[0][3] == "comment"
    g = f | {"id": "2", "name": "other", "line_start": 5, "line_end": 6}
    assert [r[0] for r in D.match_file("a.py", [f | {"stated": "Opens a socket"}, g | {"stated": None}], "# About other things\ndef connect(host):\n    pass\n\ndef other():\n    pass\n", False)] == ["1"]  # the comment stays with its function


def known(*texts):
    bitmap = np.zeros(1 << H.KNOWN_BITS - 3, np.uint8)
    for t in texts:
        at = H.shingles(t) >> np.uint64(64 - H.KNOWN_BITS)
        np.bitwise_or.at(bitmap, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
    return H.Known(bitmap)


def test_rules_that_label_the_sample():
    none = known()
    see = lambda p, t: {e for e, x in zip(H.RULES, H.Looked(p, t, none).rules()) if x}
    assert see("r/a.py", "# Code generated by toolx. DO NOT EDIT.\nx = f(1)\n") == {"marked"}
    assert see("r/a.py", "# License.\n#\n# @generated from a.proto\nx = f(1)\n") == {"marked"}
    assert see("r/a.py", "x = f(1)\n\n# AUTO-GENERATED FILE - changes will be lost.\n") == {"marked"}
    assert H.Looked("r/a.py", "# a\n\nx\n# b\ny\n# c\n", none).body == "\nx\n# b\ny"
    assert see("r/a.py", "X = '# Code generated by toolx. DO NOT EDIT.'\nf(X)\n") == set()
    assert see("r/a.py", "# Replaces the auto-generated client; written by hand since 2.0.\nf(1)\n") == set()
    assert see("r/generators/a.py", "f(1)\n") == set() and see("r/src/_vendor/p/a.py", "f(1)\n") == {"folder"} and see("r/a_pb2.py", "f(1)\n") == {"named"}
    assert "squeezed" in see("r/a.py", "a=b;" * 200) and see("r/a.py", "P = r'" + "word[a-z]|" * 60 + "'\n" + "def f(value):\n    return value\n" * 3) == set()
    assert see("r/a.rs", "pub static X: [u8; 9] = [\n" + "    0x1f, 2, 3,\n" * 30 + "];\n") == {"literal"}
    text = " ".join(f"word{i}" for i in range(100))
    assert H.Looked("r/a.py", text.replace("word50", "changed"), known(text, "other")).rules()[3] and not H.Looked("r/a.py", "nothing of it here at all now", known(text)).rules()[3]


def test_giveaways_are_no_features():
    """Phrases that labels come from, the repository's name and digits don't reach the classifier."""
    same = ["# Code generated by toolx 1.2. DO NOT EDIT.\nx = f(1)\n", "# toolx 9.7.\nx = f(1)\n"]
    a, b = (H.Looked("myrepo/a.py", t, known()) for t in same)
    assert a.rules()[0] and not b.rules()[0]
    assert "".join(a.masked_comments().split()).rstrip(".") == "".join(b.masked_comments().split()).rstrip(".") == "toolx0.0"
    assert H.Looked("myrepo/a.py", "# Copyright the myrepo authors.\nx = 1\n", known()).masked_comments().split() == ["copyright", "the", "authors."]
    for text in ("", "x", "# only a comment\n", "\ud800 é" * 3):
        places, values = H.Looked("a.py", text, known()).features()
        assert len(places) == len(values) and (np.diff(places) > 0).all()


def test_shingle_bitmap_by_spark(spark):
    texts = ["one two three four five six", "a b c d e f g h i j", None, "", "one two three four five six"]
    df = spark.createDataFrame([(t,) for t in texts], "content string")
    assert (H.known_bitmap(df) == known(*[t for t in texts if t]).bitmap).all()
    assert not H.known_bitmap(df.limit(0)).any()


def test_literals_at_every_line_length():
    for n in (10, 1000, 3990, 4000, 4010, 300_000):
        blob = "Zm9vYmFy+/"[:10] * (n // 10)
        assert H.literal_share(f'"{blob}"\n') == 1 and H.literal_share(f'["{blob}", 0x1fu8, -1]\n') == 1, n
        assert H.literal_share(f"DATA = b'{blob}'\n") == H.literal_share(f'DATA = "{blob}"\n') == H.literal_share("X = [" + "1, " * n + "]\n") == 1, n
        assert H.literal_share("pub static X: [u8; 9] = [" + "0x1f, " * n + "];\n") == 1, n
        assert H.literal_share("f(" + "1, " * n + ")\n") == H.literal_share("X = [" + "1, " * n + "y]\n") == H.literal_share("P = r'" + "a[a-z]|" * n + "'\n") == 0, n


def test_classifier_and_dirt(spark, monkeypatch):
    hand = [(f"r{i % 9}/src/m{i}.py", f"import os\n\n\ndef run_{i}(value):\n    return os.path.join(value, '{i}')\n") for i in range(90)]
    made = [(f"r{i % 9}/src/t{i}.py", f"# AUTO-GENERATED FILE - changes will be lost.\nclass T{i}:\n    pass\n") for i in range(45)]
    dirt = [("r1/n.py", None), ("r1/e.py", ""), (None, "x"), hand[0]]
    files = spark.createDataFrame([*hand, *made, *dirt], "rel_path string, content string")
    packages = spark.createDataFrame([("p", "some third party text of five words and more")], "package string, content string")
    found = H.judged(files, packages).filter("found")
    assert {r["rel_path"] for r in found.collect()} == {p for p, _ in made}
    seen = {(r["held_out"], r["view"]): r for r in H.validation(files, packages).collect()}
    assert sum(seen[h, "marked"]["both"] for h in (True, False) if (h, "marked") in seen) == len(made) and (True, "without comment") in seen
    assert H.judged(files.filter("rel_path LIKE '%/m%'"), packages.limit(0)).filter("found").count() == 0
    assert H.judged(files.limit(0), packages.limit(0)).count() == 0


def test_all_rows_are_labelled_for_fitting(spark, monkeypatch):
    """More rows than were sampled before (30,000), none left out."""
    files = spark.range(31_000).selectExpr("concat('r', id % 9, '/m', id, '.py') AS rel_path", "concat('x = ', id) AS content")
    packages = spark.createDataFrame([("p", "some third party text")], "package string, content string")
    seen = []
    monkeypatch.setattr(H, "fit", lambda rows, *rest: seen.append(rows.count()))
    assert H.judged(files, packages).filter("score IS NULL AND NOT found").count() == 31_000 and seen == [31_001]


def test_rules_take_no_part_in_judging(spark, monkeypatch):
    """With a given classifier, results are the same whatever the rules would say."""
    rows = [("r/vendor/a.py", "# Code generated by x. DO NOT EDIT.\nclass A:\n    pass\n"), ("r/src/b.py", "import os\n")]
    files = spark.createDataFrame(rows, "rel_path string, content string")
    bitmap = spark.sparkContext.broadcast(known().bitmap)
    weights = (np.sin(np.arange(H.PLACES + 1)), 0.0)
    plain = sorted((r["rel_path"], r["score"]) for r in H.scored(files, bitmap, weights).collect())
    monkeypatch.setattr(H.Looked, "rules", lambda self: [True] * len(H.RULES))
    assert sorted((r["rel_path"], r["score"]) for r in H.scored(files, bitmap, weights).collect()) == plain and len(plain) == 2


def test_features_are_judged_outside_python(spark):
    """Scores are sums of weights times features; written features aren't sent to Python in batches again (they took an executor over its memory)."""
    rows = [("r/vendor/a.py", "# Code by x\nclass A:\n    pass\n"), ("r/src/b.py", "import os, sys, re, ast, io\n"), ("r/c.py", "x")]
    files = spark.createDataFrame(rows, "rel_path string, content string")
    bitmap = spark.sparkContext.broadcast(known("import os, sys, re, ast, io").bitmap)
    w = np.sin(np.arange(H.PLACES + 1))
    judged = H.scored(files, bitmap, (w, 0.0))
    got = {r["rel_path"]: r for r in judged.collect()}
    for path, text in rows:
        places, values = H.Looked(path, text, H.Known(bitmap.value)).features()
        parts = {g: (w[places] * values)[(places >= H.STARTS[g]) & (places < H.STARTS[g] + n)].sum() for g, n in H.GROUPS.items()}
        assert {g: got[path][g] for g in parts} == pytest.approx(parts) and got[path]["score"] == pytest.approx(sum(parts.values()) + w[-1])
    assert got["r/src/b.py"]["known"] != 0
    packages = spark.createDataFrame([("p", "import os, sys, re, ast, io")], "package string, content string")
    for plan in (judged, H.judged(files, packages)):
        assert "InPandas" not in plan._jdf.queryExecution().executedPlan().toString()
