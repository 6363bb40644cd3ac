import pytest

from marlstone.operators import chunking, indexing
from marlstone.operators.syntax import chunks_of

LEDGER = '''import { Clock } from "./clock";

export abstract class Ledger<Row extends Record<string, { amount: number }>> {
  static #open = 0;
  readonly rows: Row[] = [{ note: "}" } as any];
  get total() { return this.rows.reduce((s, r) => s + r.amount, 0); }

  post = (row: Row): number => {
    if (/[}"]/.test(row.note)) return 0;
    return this.rows.push(row);
  };
  protected *history({ from = 0, to = Infinity } = {}): Iterable<Row> {
    for (const r of this.rows) {
      if (r.at > from) yield `${r.at}: ${[`{`, r.note].join("}")}`;
    }
  }
  close?(): void;
  size = 3
}
'''

MIXED = '''
export function parse(raw: Buffer): Row;
export function parse(raw: string | Buffer): Row {
  return typeof raw === "string" ? { text: raw } : { text: "it's" };
}
declare function log(x: unknown): void;
export const toRow = async <T,>(x: T) => ({ x }), VERSION = "1";
let later: () => void;
const View = (p: { rows: Row[] }) =>
  <ul title="}">{p.rows.map((r) => <li key={r.id}>it's {r.text}</li>)}</ul>;
interface Row extends Base { text: string; nested: { a: 1 } }
export type Kind = "a" | { b: 1 };
export default function* () { yield 1 }
'''


def test_members_of_a_class():
    """Accessors, arrow properties and generators are chunks; fields, and methods without a body, are not."""
    got = [(c["kind"], c["name"], c["start_line"], c["end_line"]) for c in chunks_of("l.ts", LEDGER)]
    assert got == [("class", "Ledger", 3, 19), ("method", "Ledger.total", 6, 6), ("method", "Ledger.post", 8, 11), ("method", "Ledger.history", 12, 16)]
    assert chunks_of("l.ts", LEDGER)[2]["content"].startswith("  post = (row: Row)")


def test_declarations_of_a_module():
    """Each signature of an overload is a chunk of its own; variables are if they hold a function; types are not."""
    got = [(c["kind"], c["id"], c["start_line"], c["end_line"]) for c in chunks_of("m.tsx", MIXED)]
    assert got == [
        ("function", "m.tsx::parse", 2, 2), ("function", "m.tsx::parse__2", 3, 5), ("function", "m.tsx::log", 6, 6), ("function", "m.tsx::toRow", 7, 7),
        ("function", "m.tsx::View", 9, 10), ("interface", "m.tsx::Row", 11, 11), ("function", "m.tsx::anonymous", 13, 13),
    ]
    assert [c["name"] for c in chunks_of("v.ts", "const a = 1, f = function () {}, g = async x => x * 2\nexport const q = (() => 1)();\nexport default () => 3\n")] == ["f", "g"]


@pytest.mark.parametrize("text,kinds", [("let x = )( ;", ["module"]), ("const a = 1;\n", ["module"]), ("", ["module"]), ("function f( {\nclass K {", ["function", "class"])])
def test_fallbacks(text, kinds):
    assert [c["kind"] for c in chunks_of("x.js", text)] == kinds


def test_chunk_files(spark):
    files = {
        "jobs.py": "from os import path\n\nasync def pull(url):\n    def inner(): ...\n    return url\ndef push(): pass\nclass Queue(list):\n    def put(self, x): self.append(x)",
        "guide.md": "before\n### Deep  one\n#### deeper is text\n# Top\n",
        "note.md": "no heading at all",
        "conf.yaml": "a: 1\nb: 2\n",
        "q.ts": "// a queue\nfunction take(n: number) {\n  return n - 1;\n}\nconst rest = () => [];\n",
    }
    got = [r.asDict() for r in chunking.chunk_files(spark.createDataFrame(list(files.items()), "path string, content string")).collect()]
    by = {r["id"]: (r["kind"], r["name"], r["start_line"], r["end_line"]) for r in got}
    assert by == {
        "jobs.py::pull": ("function", "pull", 3, 5), "jobs.py::push": ("function", "push", 6, 6), "jobs.py::Queue": ("class", "Queue", 7, 8),
        "guide.md::Deep_one": ("section", "Deep  one", 2, 3), "guide.md::Top": ("section", "Top", 4, 5),
        "note.md::module": ("module", None, 1, 1), "conf.yaml::module": ("module", None, 1, 3),
        "q.ts::take": ("function", "take", 2, 4), "q.ts::rest": ("function", "rest", 5, 5),
    }
    assert next(r["content"] for r in got if r["id"] == "q.ts::rest") == "const rest = () => [];"


def test_indexing_steps(spark):
    files = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "path string, mtime long")
    meta = spark.createDataFrame([("a", 1), ("b", 1), ("gone", 1)], "path string, mtime long")
    assert {r["path"] for r in indexing.changed_files(files, meta).collect()} == {"b", "c"}
    rows = spark.createDataFrame([("x", "a", 1), ("x", "b", 2), ("y", "c", 3)], "id string, v string, seq long")
    assert {tuple(r)[:2] for r in indexing.last_by_key(rows, "id").collect()} == {("x", "b"), ("y", "c")}
    ids = spark.createDataFrame([("f", "f::a", 1), ("f", "f::a", 2), ("f", "f::a", 3), ("g", "f::a", 1)], "file_path string, id string, ordinal int")
    assert sorted(r["id"] for r in indexing.with_unique_ids(ids).collect()) == ["f::a", "f::a", "f::a__2", "f::a__3"]


def test_strings_and_comments_in_templates():
    source = "function tpl() {\n  return `a${f('`') + \"}\" /* ` */ + `in${1}` // `}\n  }`;\n}\nfunction tpl() {}\n"
    assert [(c["id"], c["start_line"], c["end_line"]) for c in chunks_of("x.ts", source)] == [("x.ts::tpl", 1, 4), ("x.ts::tpl__2", 5, 5)]
