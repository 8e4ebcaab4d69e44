from tesselon.operators import overview


def test_cards(spark):
    told = "# Name\n\nThis service handles retries of the queue for every worker that stops before it is done with its page.\n"
    thin = "This tool provides search.\n\n- parse files\n- build indexes\n"
    rows = [
        ("p", "README.md", told), ("p", "container-lambdas/ingest/a.py", "from fastapi import FastAPI"), ("p", "container-lambdas/parse/b.py", "x"), ("p", "container-lambdas/tests/c.py", "x"),
        ("p", "src/x/y.ts", "x"), ("p", "src/z/y.ts", "x"), ("p", ".github/workflows/ci.yml", "x"), ("q", "docs/readme.md", thin), ("q", "main.go", "x"), ("r", "main.py", "x = 1"), ("s", "a/b/c/d.ts", None),
        *[("t", f"a{i}.ts", "import express from 'express'" if i == 3 else "x") for i in range(9)], ("t", "zz/readme.md", told), ("t", "main.ts", "// This module provides the entry of all requests that arrive.\nx"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "pack_id string, path string, content string, n int").drop("n")
    got = {r["pack_id"]: r for r in overview.architecture_cards(df).collect()}
    assert set(got) == {"p", "q", "t"}
    assert got["p"]["say"] == "p is a FastAPI service — This service handles retries of the queue for every worker that stops before it is done with its page. Work is split across two container lambdas."
    assert got["q"]["say"] == "q is a service — This tool provides search: parse files and build indexes."
    assert (got["t"]["framework"], got["t"]["path"]) == ("Express", "main.ts")
    files = {}
    for r in overview.entry_files(df).collect():
        files.setdefault(r["pack_id"], []).append((r["place"], r["path"]))
    assert [p for _, p in sorted(files["t"])] == ["main.ts", "zz/readme.md", "a0.ts", "a1.ts", "a2.ts", "a3.ts"] and len(files["p"]) == 6
    assert overview.architecture_cards(df.limit(0)).collect() == []
