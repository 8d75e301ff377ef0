"""Chunks and symbols in columns against plain Python, one document at a time."""

import random
from dataclasses import asdict

import chunk_oracle
import pytest

from quarry.operators import chunking, codechunks, symbols

COLUMNS = ["position", "chunk_type", "context_path", "title", "preview", "language", "symbol_name", "symbol_type", "symbol_id", "symbol_part_index", "symbol_part_count", "line_start", "line_end", "token_count", "content"]
FILES = "document_id bigint, path string, title string, prefix array<string>, content string"

SOURCES = {
    "a.ts": """export class User {
  // a } in a comment {
  private name = "{ not }";
  constructor(name: string) {
    this.name = name;
  }
  greet(other: User): string {
    if (other) { return `hi ${other}`; }
    return '}';
  }
}
export default async function main(args) {
  for (const a of args) { console.log(a); }
}
interface Shape { area(): number }
enum Color { Red, Green }
""",
    "a.go": "package main\nfunc (s *Server) Run(port int) error {\n\treturn nil\n}\nfunc main() {\n}\n",
    "a.rs": "pub struct P { x: i32 }\nimpl P {\n    pub fn new() -> Self { P { x: 1 } }\n}\ntrait T { fn f(&self); }\n}}\nfn late() { }\nfn open() { {",
    "a.java": 'public class A {\n    public static void main(String[] a) { new A().run(); }\n    @Override\n    public String toString() { return "{\\"{"; }\n}\n',
    "a.py": """import os
class A(object):
    \"\"\"doc
string def x(): pass
    \"\"\"
    def f(self,
a=1):
        return {
  1: 2
}

    # comment
    async def g(self): pass


def top():
    def inner():
        return 1
    return inner
x = 1
def last(): return "def no(): pass"
""",
    "a.rb": "module M\n  class A\n    def f?(x)\n      if x\n        1\n      end\n    end\n    def g; 1 end\n  end\nend\n",
    "a.lua": "local function f(a)\n  if a then\n    return 1\n  end\nend\n",
    "a.css": "a { b: c } @media x { d { e: f } }",
    "a.json": '{"a": 1}\n' * 500,
    "a.sh": "run() {\n  echo 1\n}\n",
    "blank.zig": "\n\n \n",
    "empty.py": "",
    "long.ts": "x" * 9000,
    "parts.ts": "function big() {\n" + "y" * 9000 + "\n" + "z" * 4100 + "\n}\n",
    "fence.go": "func a() {\n```\n}\n",
    "Dockerfile": "FROM x\nRUN y\n",
    "dir.d/noext": "abc",
}


def body(lines):
    words = ["let", "x", "=", "foo(bar)", "12", "é😀", "'s'", "\t"]
    return "\n".join("    " + " ".join(random.choice(words) for _ in range(random.randint(0, 14))) for _ in range(lines))


def sources():
    random.seed(9)
    out = list(SOURCES.items())
    for k in range(10):
        out.append((f"g{k}.ts", "".join(f"function f{random.randint(0, 3)}(a) {{\n{body(random.choice([1, 3, 40, 200]))}\n}}\n\n" for _ in range(random.randint(1, 6)))))
    out.append(("nested.ts", "class A {\n" + "".join(f"  m{k}() {{\n{body(random.choice([1, 1, 30]))}\n  }}\n" for k in range(30)) + "}\n"))
    out.append(("nested.py", "class A:\n" + "".join(f"    def m{k}(self):\n        x = [{'1, ' * random.choice([1, 300])}]\n        return 1\n" for k in range(8))))
    return out


def texts():
    random.seed(11)
    words = ["word", "é😀", "code", "`x`", "  ", "a-b", "longer-words-here", "1234"]
    line = lambda: " ".join(random.choice(words) for _ in range(random.randint(0, 25)))

    def one():
        if (r := random.random()) < 0.06:
            return "#" * random.randint(1, 6) + random.choice([" ", "  ", ""]) + random.choice(["Title", "API ref", "", " x "])
        return "```" if r < 0.08 else "    indented" if r < 0.1 else line() + random.choice(["", "  ", "\r"])

    out = ["\n".join(one() for _ in range(random.randint(0, 160))) for _ in range(120)]
    return [*out, "", "  \n ", "x" * 9000, ("x" * 2500 + "\n") * 5, "short ```code```", "## A\n### B\ntext\n## C\n#### D\n### E\n", ("y" * 100 + "\n") * 400, "\u00a0## A\u2028\n##\u00a0B"]


def expected(path, title, prefix, content):
    ext = path.rsplit("/", 1)[-1].lower().rpartition(".")[2]
    made = chunk_oracle.markdown_chunks(content, title, prefix) if ext == "md" else chunk_oracle.code_chunks(content, path, chunk_oracle.LANGUAGES.get(ext, ext), prefix)
    rows = [asdict(c) | {"position": k, "token_count": c.token_count} for k, c in enumerate(made)]
    return [tuple(r[c] for c in COLUMNS) for r in rows]


@pytest.mark.parametrize("kind", ["code", "text"])
def test_chunks_against_plain_python(spark, kind):
    random.seed(3)
    if kind == "code":
        rows = [(k, f"src/{p}", None, ["o/r"], c) for k, (p, c) in enumerate(sources())]
    else:
        rows = [(k, "d.md", random.choice([None, "", " T ", "Guide"]), random.choice([[], ["o/r"], ["o/r", "o/r"], ["T"]]), c) for k, c in enumerate(texts())]
    got = {}
    for r in chunking.chunk_documents(spark.createDataFrame(rows, FILES)).orderBy("document_id", "position").collect():
        got.setdefault(r.document_id, []).append(tuple(r[c] for c in COLUMNS))
    for k, path, title, prefix, content in rows:
        assert got.get(k, []) == expected(path, title, prefix, content), path


def test_null_rows_and_no_rows(spark):
    frame = spark.createDataFrame([(1, "a.md", None, None, None), (2, "a.ts", None, None, None)], FILES)
    assert [(r.document_id, r.content) for r in chunking.chunk_documents(frame).collect()] == [(2, "a.ts\n\n```typescript\n\n```")]
    assert chunking.chunk_documents(frame.filter("document_id > 9")).count() == 0


def test_no_python_in_the_plan(spark):
    frame = spark.createDataFrame([(1, "a.md", "t", [], "x"), (2, "a.ts", "t", [], "x")], FILES)
    plan = chunking.chunk_documents(frame)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "NestedLoop", "CartesianProduct"))


def stack_pairs(code):
    open_, out = [], set()
    for k, c in enumerate(code):
        if c == "{":
            open_.append(k)
        elif c == "}" and open_:
            out.add((open_.pop(), k))
    return out


def test_brackets_against_a_stack(spark):
    random.seed(8)
    rows = [(k, "".join(random.choices("{{}};x\n", k=random.randint(0, 80)))) for k in range(60)] + [(99, "{" * 3000 + "}" * 3000), (100, "}}}{")]
    got = {}
    for r in symbols.brackets(spark.createDataFrame(rows, "document_id bigint, content string")).collect():
        got.setdefault(r.document_id, set()).add((r.opened, r.closed))
    assert {k: v for k, v in ((k, stack_pairs(c)) for k, c in rows) if v} == got


def test_quotes_and_comments_of_any_length(spark):
    code = "a = \"" + "\\\"{" * 200_000 + "\"; /*" + "{*" * 200_000 + "*/ function f() { // {\n}\n'" + "\\'" * 50_000 + "'"
    rows = symbols.symbols(spark.createDataFrame([(1, "typescript", code.replace("; /*", ";\n/*").replace("*/ function", "*/\nfunction"))], "document_id bigint, language string, content string")).collect()
    assert [(r.symbol_name, r.line_start, r.line_end) for r in rows] == [("f", 2, 3)]


def test_windows_of_lines(spark):
    random.seed(2)
    lines = [["z" * random.choice([0, 5, 300, 1300]) for _ in range(random.randint(1, 60))] for _ in range(60)]
    frame = spark.createDataFrame([(k, [len(x) for x in own]) for k, own in enumerate(lines)], "k int, n array<int>")
    got = {r.k: [(w.a, w.z) for w in r.w] for r in frame.select("k", codechunks.line_windows(frame.n).alias("w")).collect()}
    assert got == {k: list(chunk_oracle.windows(own)) for k, own in enumerate(lines)}
