import pytest
from pyspark.sql import functions as F

from tesselon.functions import dialogue, say
from tesselon.functions import text as tx
from tesselon.operators import code


def ask(spark, rows, expr):
    """expr over the columns of rows (strings), in order."""
    n = len(rows[0])
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"c{k} string" for k in range(n)))
    return [r[0] for r in df.select(expr(*[F.col(f"c{k}") for k in range(n)]).alias("x"), "i").orderBy("i").collect()]


def table(spark, cases, expr):
    assert ask(spark, [(q,) for q, _ in cases], expr) == [w for _, w in cases]


def test_shapes(spark):
    table(spark, [
        ("Who wrote the exporter?", "who"), ("who is Macbeth", "what"), ("We're not testing this at all, right?", "absence"), ("do we have retries", "absence"),
        ("What happens if the upload fails?", "failure"), ("why is it slow", "why"), ("where is the token stored", "where"), ("how does it work", "how"), ("describe it", "what"),
    ], tx.question_shape)


def test_classes(spark):
    table(spark, [
        ("what is the weather", "current_external_fact"), ("what does a seat cost", "pricing_packaging"), ("is there an uptime guarantee", "contractual_sla"), ("do you support oauth", "security_compliance"),
        ("give me the system design", "architecture"), ("what can it do", "product_capability"), ("where is the parser", "implementation"), ("why was that chosen", "general_technical_reasoning"), ("hello there", "other"),
    ], tx.question_class)


def test_chatter_and_filler(spark):
    table(spark, [("can you hear me?", True), ("Thanks!", True), ("how are you handling retries on the worker?", False), ("next slide please", True)], dialogue.is_chatter)
    table(spark, [("thanks for that, why is it slow?", "why is it slow?"), ("good morning everyone", ""), ("where is it", "where is it")], dialogue.strip_filler)


def test_caption(spark):
    table(spark, [("[MUSIC PLAYING] >> They: so where is it", "so where is it"), ("Thank you.", ""), ("(wind blowing)", ""), ("- , hello world", "hello world"), ("[BLANK_AUDIO] a real line", "a real line")], dialogue.clean)


def test_gate(spark):
    f = lambda c, m, t, p, n: dialogue.gate_verdict(dialogue.clean(c), m == "y", t == "y", p == "y", n == "y")
    rows = [("", "n", "n", "n", "n"), ("can you hear me", "n", "y", "y", "n"), ("Why?", "n", "n", "n", "n"), ("Why?", "n", "y", "y", "n"), ("we shipped it yesterday", "y", "n", "n", "n"),
            ("where is the exporter started?", "y", "n", "n", "n"), ("what does this service do after that?", "n", "n", "n", "y"), ("what happened to the birthday cake?", "n", "n", "n", "n")]
    assert ask(spark, rows, f) == ["empty", "chatter", "orphan-follow-up", "follow-up", "not-a-question", "question", "unresolved-reference", "not-a-question"]
    table(spark, [("We met. Where is the token stored? It is late.", "Where is the token stored?"), ("nothing asked", "nothing asked")], dialogue.extract_question)


def test_predicates_and_fits(spark):
    table(spark, [
        ("who owns the exporter", "ownership"), ("what is the phone number", "contact"), ("how much does it cost", "cost"), ("how many retries", "quantity"), ("where are files stored", "location"),
        ("why three retries", "rationale"), ("what happens if it fails", "failure"), ("which vendor should we pick", "recommendation"), ("does it require sso", "requirement"),
        ("what does RAG stand for", "naming"), ("what are the two modes", "enumeration"), ("how does it start", "procedure"), ("what is it", "definition"),
    ], dialogue.predicate_of)
    rows = [("It costs 40 dollars", "cost"), ("It is cheap", "cost"), ("Owned by the platform team", "ownership"), ("a, b, and c", "enumeration"), ("The modes are:", "enumeration"), ("anything", "definition"), ("chosen because it is fast", "rationale")]
    assert ask(spark, rows, dialogue.predicate_fits) == [True, False, True, True, False, True, True]
    table(spark, [("GraphQL", True), ("BigQuery", True), ("GPT4", True), ("plain", False)], dialogue.is_named_entity)


def test_say(spark):
    table(spark, [("According to the docs, it retries three times.", "It retries three times."), ("The code suggests that it seems retries are capped here", "Retries are capped here"), ("too short", None), (None, None)], say.sayable)
    table(spark, [("Use `a_b` and **bold** [link](http://x) _two words_ and __init__", "Use a_b and bold link two words and __init__")], say.plain)
    table(spark, [("# Title", True), ("FastAPI Main Application", True), ("It converts uploads into pages for the index.", False), ("-----", True)], say.is_heading)
    table(spark, [("Phone: 123", True), ("a@b.com", True), ("This is a whole sentence that goes on.", False), ("x = 1", False)], say.is_field_line)
    table(spark, [("def run(x):", "run"), ("export const go = 1", "go"), ("if (x) {", None), ("  handler = make()", "handler")], say.declared_name)
    table(spark, [("a@b.co", True), ("a b@c.d", False), ("nope", False)], say.valid_email)
    df = spark.sql("select array('a','b','c') w, array('a') o, array() e")
    assert df.select(say.list_phrase(df.w), say.list_phrase(df.o), say.list_phrase(df.e)).first()[:] == ("a, b and c", "a", "")
    df = spark.sql("""select * from values ('file', 'a.py', 3, 9, null, null, null, null), ('file', 'a.py', 3, 3, null, null, null, null), ('document', 'd.pdf', null, null, 4, 'Costs', null, null),
        ('commit', null, null, null, null, null, 'abcdef123456', '842') as t(kind, path, line, e, page, heading, sha, pr)""")
    assert [r[0] for r in df.select(say.citation_text(*[df[c] for c in df.columns])).collect()] == ["a.py:3-9", "a.py:3", 'd.pdf · Page 4 · "Costs"', "Commit abcdef1 · PR #842"]


PY = '''import x


@decorated
def one(a):
    """Doc."""
    if a:
        return "def no(): {"

    return 2


class Two:
    def inner(self):
        pass

x = 1
'''
TS = '''import a from "b";
export function first(x: number) { // } not here
  const s = "}{";
  if (x) { return `${x}`; }
}
export const second = async (y) => {
  return y;
};
interface Third { a: string }
function broken( { return [ } )
'''


def test_symbols(spark):
    got = [(n, k, PY[a:z]) for n, k, a, z in code.symbols("py", PY)]
    assert [(n, k) for n, k, _ in got] == [("one", "function"), ("Two", "class")]
    assert got[0][2].endswith("return 2") and got[1][2].endswith("pass")
    got = [(n, k, TS[a:z]) for n, k, a, z in code.symbols("ts", TS)]
    assert [n for n, _, _ in got] == ["first", "second", "Third"] and got[0][2].endswith("}\n}") and got[1][2].endswith("}")
    df = spark.createDataFrame([("a.py", "py", PY), ("b.ts", "ts", TS), ("c.txt", "txt", "x"), ("d.go", "go", "package m\n\nfunc (s *S) Run() {\n\tgo()\n}\n\ntype S struct {\n\ta int\n}\n")], "path string, language string, content string")
    rows = {(r["path"], r["symbol"]): r for r in code.symbol_chunks(df).collect()}
    assert set(rows) == {("a.py", "one"), ("a.py", "Two"), ("b.ts", "first"), ("b.ts", "second"), ("b.ts", "Third"), ("d.go", "Run"), ("d.go", "S")}
    one = rows[("a.py", "one")]
    assert PY[one["start_offset"] :].startswith("def one") and PY.split("\n")[one["start_line"] - 1].startswith("def one") and PY.split("\n")[one["end_line"] - 1].strip() == "return 2"


@pytest.mark.parametrize("text", ["", "a", "the cats and the cat's toys, 12 items"])
def test_bag_embedding_equals_slow_form(spark, text):
    from tesselon.operators.retrieval import bag_embeddings

    def fnv(t):
        h = 2166136261
        for ch in t.encode():
            h = ((h ^ ch) * 16777619) & 0xFFFFFFFF
        return h

    import re

    want = [0.0] * 384
    for w in [x for x in re.split("[^a-z0-9]+", text.lower()) if x]:
        want[fnv(w) % 384] += 1
        for i in range(len(w) - 2):
            want[fnv(w[i : i + 3]) % 384] += 0.35
    norm = sum(x * x for x in want) ** 0.5 or 1
    got = bag_embeddings(spark.createDataFrame([(1, text)], "chunk_id int, text string")).first()["vector"]
    assert got == pytest.approx([x / norm for x in want])
