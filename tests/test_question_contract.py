from tesselon.operators import question_contract as qc


def test_fields_and_words(spark):
    texts = {
        1: "what is the phone number of the company", 2: "which of the three modes does the exporter use", 3: "which exporter handles the sessions", 4: "what is a checkpoint",
        5: "when is the channel secure", 6: "please tell what the paper says about attention", 7: None, 8: "what does the worker run on", 9: "use store",
    }
    q = spark.createDataFrame(list(texts.items()), "query_id int, text string")
    got = {r["query_id"]: r for r in qc.full_contracts(q).collect()}
    assert got[1]["is_field"] and not got[1]["needs_copula"] and got[1]["required"] == [] and {"phone", "number", "company"} <= set(got[1]["optional"])
    assert got[2]["enumerates"] and got[2]["members"] == 3 and "three" not in got[2]["required"] and got[2]["entity"] is None
    assert got[3]["entity"] == "exporter" and got[3]["expectation"] == "naming" and "exporter" in got[3]["optional"] and "sessions" in got[3]["required"]
    assert got[4]["needs_copula"] and got[4]["required"] == ["checkpoint"]
    assert got[5]["when_is"] == "secure"
    assert "attention" in got[6]["required"] and not {"paper", "please", "tell"} & set(got[6]["required"])
    assert got[7]["required"] == [] and got[7]["predicate"] == "definition"
    assert (got[8]["verb"], got[8]["preposition"]) == ("run", "on") and "run" not in got[8]["required"]
    assert got[9]["required"] == ["use", "store"] or set(got[9]["required"]) <= {"use", "store"}
    chosen = qc.full_contracts(spark.createDataFrame([(1, "in pricing, are seats reserved early", "pricing-2024.pdf")], "query_id int, text string, selected string")).first()
    assert "pricing" in chosen["optional"] and "seats" in chosen["required"]


def test_a_corpus_adds_rules_as_rows(spark):
    q = spark.createDataFrame([(1, "how strong is the alloy"), (2, "how strong is the tea")], "query_id int, text string")
    more = spark.createDataFrame([("predicate", -1, None, [r"\bhow strong\b", r"\balloy\b"], "quantity")], "field string, priority int, shape string, patterns array<string>, value string")
    got = {r["query_id"]: r["predicate"] for r in qc.full_contracts(q, more).collect()}
    assert got[1] == "quantity" and got[2] != "quantity"


def test_claims(spark):
    q = spark.createDataFrame([(1, "what is a checkpoint"), (2, "when is the channel secure"), (3, "which of the three modes exist")], "query_id int, text string")
    lines = [(1, "A checkpoint is a saved state."), (1, "Checkpoints help."), (1, "Nch the checkpoint is here."), (2, "The channel is secure after login."), (2, "The channel opens."),
             (3, "The modes that exist: fast, slow, and idle"), (3, "The modes exist"), (1, None), (1, "The tion of a checkpoint is lost.")]
    out = qc.fits_contract(spark.createDataFrame(lines, "query_id int, say string"), qc.full_contracts(q)).collect()
    assert sorted((r["query_id"], r["say"]) for r in out) == [(1, "A checkpoint is a saved state."), (2, "The channel is secure after login."), (3, "The modes that exist: fast, slow, and idle")]
