import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesselon.llm import fim
from tesselon.llm.queries import op13_fim

SCHEMA = "doc_id long, text string, h string, marked string"


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def slow(doc_id, text, fim_percent=100, spm_percent=50):
    t = text or ""
    u = re.findall(r"[^\n]*\n|[^\n]+", t)
    x = sha(f"7:{'' if doc_id is None else doc_id}")
    h = [int(x[i : i + 8], 16) for i in range(0, 32, 8)]
    lo, hi = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim_percent:
        return len(u), "plain", None, None, t
    p, m, s = "".join(u[:lo]), "".join(u[lo:hi]), "".join(u[hi:])
    spm = h[3] % 100 < spm_percent
    return len(u), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def met(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)
    out = fim.fill_in_middle(df, **kw).withColumn("back", fim.restore(F.col("output"), F.col("form")))
    return sorted((r["doc_id"] or -1, r["n"], r["form"], r["prefix_chars"] or 0, r["middle_chars"] or 0, r["output"], r["back"]) for r in out.collect())


def want(rows, **kw):
    return sorted((i or -1, n, f, p or 0, m or 0, o, t or "") for i, t in rows for n, f, p, m, o in [slow(i, t, **kw)])


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="a\n\x01\x02ec<PSM>é😀\r", max_size=30), min_size=1, max_size=30))
def test_any_text_and_the_way_back(spark, texts):
    rows = list(enumerate(texts))
    assert met(spark, rows) == want(rows)


def test_edges(spark):
    long = "line é\n" * 200_000 + "no break " * 100_000
    rows = [(None, None), (1, None), (2, ""), (3, "\n"), (4, "a<S>b\n"), (5, "one"), (5, "one"), (5, "a\nb\nc"), (6, "<P\n>"), (7, long), (-8, "x\n\ny\n"), (None, "p\nq\n")]
    assert met(spark, rows) == want(rows)
    assert met(spark, rows, fim_percent=30, spm_percent=0) == want(rows, fim_percent=30, spm_percent=0)
    assert met(spark, []) == []
    both = {f for i in range(60) for f in [slow(i, "a\nb")[1]]}
    assert both == {"psm", "spm"}


def test_registered_query_and_plan(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    df = op13_fim(spark, sf_dir)
    got = {r["doc_id"]: tuple(r)[1:] for r in df.collect()}
    assert got == {d: (n, f, p, m, sha(o), sha(t or "")) for d, t in docs.items() for n, f, p, m, o in [slow(d, t)]}
    plan = df._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
