"""Truth tables of TypeScript and C# definitions; deep nesting takes linear time."""

import time

import pytest

from quern.functions import braces

TS = """import { A } from './a';
import * as fs from "fs";

@Component({ selector: 'x', fn: () => 1 })
export default class Shop<T extends Base> extends Store<T, string> implements Sells, Buys {
  private total = 0
  static readonly re = /[{}"]\\/(/g
  constructor(private a: A, b = { c: 1 }) { super(a); this.init(); }
  public async sum<K extends keyof T>(x: number, y?: K): Promise<number> {
    const s = `class ${this.name(`in ${deep(x)} }`)} { not a brace`
    if (x > 1) { return other(x); }
    return [1, 2].map(v => v * twice(v)).reduce((p, q) => { return p + q; }, 0);
  }
  get size(): number { return this.total }
  handler = async (e: Event): Promise<void> => { await this.sum(1); }
}
interface Sells { price(a: number): number; }
export function free({ a, b }: Opts = {}): void { /* } */ "}" + '{'; go(); }
export const area = (r: number): number => Math.PI * square(r)
const later = function named(x) { return x / 2 / 3; }
const o = { method() { return 1; }, arrow: (z) => z, v: free({}) }
function* gen() { yield make(); }
abstract class Empty {}
"""

TS_WANT = [
    ("function", "fn", None, [], []),  # the arrow of the decorator
    ("class", "Shop", None, ["Store<T, string>", "Sells", "Buys"], None),
    ("function", "constructor", "Shop", [], ["this.init"]),
    ("function", "sum", "Shop", [], None),
    ("function", "anonymous", "Shop", [], ["twice"]),
    ("function", "anonymous", "Shop", [], []),
    ("function", "size", "Shop", [], []),
    ("function", "handler", "Shop", [], ["this.sum"]),
    ("interface", "Sells", None, [], None),
    ("function", "free", None, [], ["go"]),
    ("function", "area", None, [], ["square"]),
    ("function", "later", None, [], []),
    ("function", "method", None, [], []),
    ("function", "arrow", None, [], []),
    ("function", "gen", None, [], ["make"]),
    ("class", "Empty", None, [], []),
]

CS = '''using System;
namespace Shop.Core {
  #region stuff {
  [Serializable]
  public sealed class Cart<T> : Base<T, int>, IBuys where T : class, new() {
    private readonly string path = @"C:\\dir\\"; // ends in a backslash {
    const string Raw = """a { "b" } """;
    public Cart(int n) : base(n) { Load($"{n} {{x}} {Name("}")}"); }
    public int Total { get; set; } = Compute();
    [Obsolete("x")] public async Task<List<T>> FindAsync<K>(Dictionary<string, K> by, char c = '}') where K : class {
      foreach (var x in by) { if (Match(x)) { await Store.Save(x); } }
      Func<int, int> f = y => y + Add(y);
      return items.Where(i => i.Ok).ToList();
    }
    public int Twice(int a) => Mul(a, 2);
    int Lambda => 3;
    ~Cart() { Free(); }
    class Inner { void Do() {} }
  }
  public interface IBuys { void Buy(); }
  public record struct Point(int X) { public int Len() { return X; } }
}
'''

CS_WANT = [
    ("class", "Cart", None, ["Base<T, int>", "IBuys"], None),
    ("function", "Cart", "Cart", [], ["Load"]),
    ("function", "FindAsync", "Cart", [], ["Add", "Match", "Store.Save", "ToList", "items.Where"]),
    ("function", "Twice", "Cart", [], ["Mul"]),
    ("function", "Cart", "Cart", [], ["Free"]),
    ("class", "Inner", "Cart", [], []),
    ("function", "Do", "Inner", [], []),
    ("interface", "IBuys", None, [], None),
    ("function", "Len", None, [], []),
]


@pytest.mark.parametrize("source,language,want", [(TS, "typescript", TS_WANT), (CS, "csharp", CS_WANT)])
def test_truth_table(source, language, want):
    got = braces.definitions(source, language)
    assert [(c["kind"], c["name"]) for c in got] == [w[:2] for w in want]
    for c, w in zip(got, want):
        assert (c["owner"], c["bases"]) == (w[2], w[3]), c
        assert w[4] is None or c["calls"] == w[4], c


def test_texts_end_where_they_should():
    code = lambda c: TS[c["start"] : c["end"]]
    got = {c["name"]: code(c) for c in braces.definitions(TS, "typescript") if c["name"] != "anonymous"}
    assert got["Shop"].startswith("class Shop<T") and got["Shop"].endswith("}\n}") and got["size"] == "get size(): number { return this.total }"
    assert got["area"] == "(r: number): number => Math.PI * square(r)" and got["arrow"] == "(z) => z"
    assert got["free"].startswith("function free") and got["free"].endswith("go(); }") and got["gen"].endswith("make(); }")
    cs = {c["name"]: CS[c["start"] : c["end"]] for c in braces.definitions(CS, "csharp")}
    assert cs["Twice"] == "public int Twice(int a) => Mul(a, 2);" and cs["Do"] == "void Do() {}"


@pytest.mark.parametrize("source", ["", "}", "{{{", "class", "class {", "=> {", "`${", "`", "'", "f(", "a = /[/", "interface I", ")]}", "x => ", '"""', "@\"", "\ud800 {"])
@pytest.mark.parametrize("language", ["typescript", "csharp"])
def test_broken_sources(source, language):
    braces.definitions(source, language)


def test_deep_nesting_is_linear():
    def took(depth):
        source = "class A { f() {\n" + "if (x) { go(`${a}`);\n" * depth + "}" * depth + "\n} }"
        began = time.process_time()
        got = braces.definitions(source, "typescript")
        assert [c["name"] for c in got] == ["A", "f"] and got[0]["end"] == len(source) and got[0]["calls"] == ["go"]
        return time.process_time() - began

    took(1000)
    assert took(16_000) < 20 * max(took(2000), 0.005)
