"""Scripts of several statements as columns."""

import base64
import hashlib

import pytest
from leafmill.functions import blocks
from leafmill.functions.expressions import UnsupportedScript
from pyspark.sql import functions as F

MD5 = lambda s: hashlib.md5(s.encode()).hexdigest()
RUN = {
    "var a = 2; var b = a * 3; a + b": "8",
    "let s = 'x;y' ; const t = s + \"!=&&\"; t": "x;y!=&&",
    "var a = 1, b = 'q'; b + a": "q1",
    "var x = name; x = x + '-' + size; x += '!'; x": "Ann-7!",
    "function f(a, b) { var c = a + b; return c * 2; } f(3, size)": "20",
    "var f = function(a) { return a + name }; f('x') + f(1)": "xAnn1Ann",
    "var f = (a, b) => a * b; f(size, 2) + 1": "15",
    "size > 5 ? (name == 'Bo' ? 'b' : 'a?:') : 'c'": "a?:",
    "var e = base64Encode(name); base64Decode(e) === name ? \"OK\" : \"FAIL\"": "OK",
    "var items = ['apple', 'banana']; var r = items.map(function(item) { return item + ':' + md5Encode(item).substring(0, 8); }); r.join('; ')": f"apple:{MD5('apple')[:8]}; banana:{MD5('banana')[:8]}",
    "['a', 'bb', size].map((x, i) => i + x).filter(x => x.length > 2).join()": "1bb",
    "var p = 'a.b.c'.split('.'); p[1] + p.length + p.includes('c')": "b3true",
    "name.replace('n', 'N').indexOf('N') + 10": "11",
    "// remark; here\nvar a = 1; /* ; */ a + 1": "2",
    "var t = name; var enc = base64Encode(t); 'T: ' + t + ' | ' + enc": f"T: Ann | {base64.b64encode(b'Ann').decode()}",
    "!(size > 9) && name != 'x'": "true",
    "'Hi! a && b ? c : d' + name.substring(2, 0) + name.substring(1)": "Hi! a && b ? c : dAnnn",
}
EMBEDDED = {"plain": "plain", "before <js>2 + 3</js> after": "5", "<js>var x = 10; x * 2</js> r": "20", "<js>1</js> + <js>2</js> + <JS>3</JS>": "6", "<js>function add(a,b){return a+b} add(5,7)</js>": "12", '<js>"hello " + "world"</js>': "hello world", "<js>var a = name</js><js>a + 1</js>": "Ann1", "<js>y + 1</js><js>var y = 4; 'z'</js>": "5z"}


def names():
    return {"name": F.col("name"), "size": F.col("size")}


def test_blocks(spark):
    df = spark.createDataFrame([("Ann", 7)], "name string, size int")
    got = df.select(*[blocks.as_text(blocks.run(s, names())).alias(str(k)) for k, s in enumerate(RUN)])
    assert dict(zip(RUN, got.first(), strict=True)) == RUN
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_embedded_blocks(spark):
    df = spark.createDataFrame([("Ann", 7)], "name string, size int")
    for said, want in EMBEDDED.items():
        assert df.select(blocks.as_text(blocks.embedded(said, names()))).first()[0] == want


@pytest.mark.parametrize("script", ["for (var i = 0; i < 3; i++) {} i", "if (size > 1) { name }", "var o = {a: 1}; o.a", "while (true) {}", "unknown + 1", "java.ajax('u')", "var x; x", "new Date()", "function f() { var a = 1 } f()", "'open"])
def test_what_blocks_cannot_say_raises(script):
    with pytest.raises(UnsupportedScript):
        blocks.run(script, {})


def test_a_script_sets_names_for_itself_alone():
    held = {}
    with pytest.raises(UnsupportedScript):
        blocks.run("a", held)
    assert held == {}
