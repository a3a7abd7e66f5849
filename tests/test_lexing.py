"""Source text that line patterns get wrong, and long texts that must not end an executor."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import extraction, lexing, parsing

SCHEMA = "repo string, filePath string, text string"


def files(spark, *texts):
    return spark.createDataFrame([("r", f"f{i}.js", t) for i, t in enumerate(texts)], SCHEMA)


def code(spark, text):
    return files(spark, text).select(lexing.blanked(F.col("text"))).first()[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("const u = 'http://a.b/c'; f();", "const u = '" + " " * 12 + "'; f();"),
        ('a("x \\" // y") // z', 'a("' + " " * 9 + '")     '),
        ("x = `hello\n${name} world ${f(`in ${g}`)}`;", "x = `     \n  name          f(`       `) `;"),
        ("x = `${ {a: {b: 1}} } \\` $5`;", None),
        ("r = /['\"`/]/g.test(s) / 2; t = a / b / c;", None),
        ("/* it's\n 'open */ go(); // don't\nrun();", "       \n          go();         \nrun();"),
        ("it's open\nrun('a')", "it'      \nrun(' ')"),
        ("/* never closed '", " " * 17),
        ("", ""),
    ],
)
def test_code_without_text(spark, text, want):
    got = code(spark, text)
    assert len(got) == len(text) and [len(x) for x in got.split("\n")] == [len(x) for x in text.split("\n")]
    if want is not None:
        assert got == want


def test_regular_expressions_and_divisions(spark):
    assert "'" not in code(spark, "r = /it's/; s = 1;") and "a / b / c" in code(spark, "t = a / b / c;")


def test_names_in_templates_but_not_in_text(spark):
    got = {(r["name"], r["line"], r["isCall"]) for r in parsing.references(files(spark, "go(`hello\nworld ${user} and ${load(id)}`);\nend(url);")).collect()}
    assert got == {("go", 1, True), ("user", 2, False), ("load", 2, True), ("id", 2, False), ("end", 3, True), ("url", 3, False)}


def test_comments_are_not_sought_in_strings(spark):
    got = parsing.comment_places(files(spark, "const u = 'http://a.b/c';\nv = `/* no */`; // yes\n/** doc\n */\nf();")).collect()
    assert [(r["kind"], r["text"], r["lineStart"], r["lineEnd"]) for r in sorted(got, key=lambda r: r["lineStart"])] == [("line", "// yes", 2, 2), ("jsdoc", "/** doc\n */", 3, 4)]


def test_parents_at_any_depth(spark):
    text = "function f() {\n x = " + "{ a: " * 12 + "function () {\n if (y) {\n }\n }" + "}" * 12 + ";\n}\nfunction g() {\n}\n"
    got = {r["scopeId"]: (r["kind"], r["parentId"], r["lineStart"], r["lineEnd"]) for r in parsing.scopes(files(spark, text)).collect()}
    assert got == {"s0": ("module", None, 1, 9), "s1": ("function", "s0", 1, 6), "s2": ("function", "s1", 2, 5), "s3": ("block", "s2", 3, 4), "s4": ("function", "s0", 7, 8)}


def caught(spark, text):
    return [tuple(x) for x in files(spark, text).select(parsing.caught(F.col("text"))).first()[0]]


def test_catches_with_nested_blocks(spark):
    assert caught(spark, "try { a(); } catch (e) { if (x) { if (y) { z(); } } }") == [("Error", "if (x) { if (y) { z(); } }")]
    nested = "try { a(); } catch (e) { try { b(); } catch (f) { if (f instanceof api.Gone) { g(); } } h('}'); }"
    assert caught(spark, nested) == [("Error", "try { b(); } catch (f) { if (f instanceof api.Gone) { g(); } } h('}');"), ("Gone", "if (f instanceof api.Gone) { g(); }")]
    assert caught(spark, "try {} catch (e: TypeError) { a(); } finally {}\ntry {} catch { b(); }\nx.catch(() => { c(); });") == [("TypeError", "a();"), ("Error", "b();")]
    assert caught(spark, "// catch (e) { no }\ns = 'catch (e) { no }';") == [] and caught(spark, "") == []
    assert caught(spark, "} } catch (e) { open();") == [("Error", "open();")]


BIG = 300_000
LONG = {
    "string": "s = '" + "a\\'" * (BIG // 3) + "'; f();",
    "template": "s = `" + "a${x}\\`\n" * (BIG // 8) + "`; f();",
    "open_string": "s = '" + "a\\'" * (BIG // 3),
    "open_template": "s = `" + "${" * (BIG // 2),
    "comment": "/*" + " * " * (BIG // 3) + "*/ f();",
    "regex": "r = /" + "[a\\/]" * (BIG // 5) + "/; f();",
    "catch": "try { a(); } catch (e) { " + "b({}); " * (BIG // 7) + "}",
    "line": "f(a.b, 'c');" * (BIG // 24),
    "chain": "f" + ".a" * (BIG // 2) + "();",
    "slashes": "x = a " + "/ b " * (BIG // 4),
}


@pytest.mark.parametrize("name", sorted(LONG))
def test_long_texts_end_no_executor(spark, name):
    df = files(spark, LONG[name])
    assert len(df.select(lexing.blanked(F.col("text"))).first()[0]) == len(LONG[name])
    assert parsing.comment_places(df).count() == (1 if name == "comment" else 0)
    assert df.select(F.size(parsing.caught(F.col("text")))).first()[0] == (1 if name == "catch" else 0)
    assert extraction.call_sites(df).agg(F.count("*")).first()[0] >= 0
    assert parsing.references(df).agg(F.count("*")).first()[0] >= (name not in ("comment",))


def test_deep_nesting(spark):
    n = 400
    got = parsing.scopes(files(spark, "function f() {\n" * n + "}\n" * n))
    assert got.count() == n + 1 and got.where(f"parentId = 's{n - 1}' AND scopeId = 's{n}' AND lineEnd = {n + 1}").count() == 1
