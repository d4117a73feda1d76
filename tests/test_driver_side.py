import pytest

from corpusmill import interact
from corpusmill.config import Config
from corpusmill.operators.bounded import take_bounded
from corpusmill.prices import ModelName, price_table, prices_of
from corpusmill.sinks import reports


def test_config(spark):
    config = Config(spark)
    assert config.eval_votes == 3 and config.private is False
    config.eval_votes = 5
    assert config.eval_votes == 5
    spark.conf.set("corpusmill.eval_votes", "many")
    with pytest.raises(TypeError):
        _ = config.eval_votes
    spark.conf.unset("corpusmill.eval_votes")
    with pytest.raises(AttributeError):
        _ = config.unheard_of
    with pytest.raises(TypeError):
        config.top_k = 3
    config.private = True
    with pytest.raises(PermissionError):
        config.private = False
    spark.conf.unset("corpusmill.private")


def test_prices(spark):
    table = price_table(spark, {"a/b": {"prompt": 1, "completion": 2}})
    assert {r["kind"]: r["price"] for r in prices_of(table, "a/b").collect()} == {"prompt": 1.0, "completion": 2.0, "internal_reasoning": 2.0}
    assert sum(r["price"] for r in prices_of(table, "testing/testing").collect()) == 0
    with pytest.raises(ValueError):
        prices_of(table, "x/y")
    name = ModelName("open/some/model:1")
    assert (name.backend, name.model, name.sanitised, name.is_testing()) == ("open", "some/model:1", "open_some_model_1", False)


def test_history_and_completion(tmp_path):
    file = str(tmp_path / "h.json")
    interact.remember(file, "a", 1)
    interact.remember(file, "b", 2)
    assert [e["prompt"] for e in interact.remember(file, "a", 3)] == ["b", "a"]
    assert interact.complete("what al", ["alpha", "also", "all", "alter", "x"], ["what all is this", "no"], []) == ["alpha", "also", "all", "what all is this"]
    assert interact.complete("/to", [], [], ["top_k", "task"]) == ["/top_k"]


@pytest.mark.parametrize("command, want", [
    ("/top_k 5", ("top_k", 5)), ("/top_k=auto_2_9", ("top_k", "auto_2_9")), ("/retriever knn_svm", ("retriever", "knn_svm")), ("/relevancy 0.2", ("relevancy", 0.2)),
])
def test_settings(command, want):
    assert interact.setting(command) == want


@pytest.mark.parametrize("command", ["/nothing 1", "/top_k 0", "/retriever odd", "/relevancy x", "/relevancy 7", "/multiline 3"])
def test_bad_settings(command):
    with pytest.raises(ValueError):
        interact.setting(command)


def test_summary_files(tmp_path):
    target = str(tmp_path / "s.md")
    files = reports.write_summary(target, "- head", {0: "- a\n  - b", 1: "- c"})
    assert [f.name for f in files] == ["s.1.md", "s.md"]
    assert (tmp_path / "s.md").read_text() == "- head\n    Recursive summary pass: 2/2\n    - c"
    reports.write_summary(target, "- again", {0: "- d"})
    assert (tmp_path / "s.md").read_text().endswith("\n\n\n- again\n    - d")


def test_answer_report(spark):
    rows = spark.createDataFrame([(1, " t1 ", {"k": "v"}, "<doc id=[[DOC_1]]>\none\n</doc>"), (2, "t2", {}, "two")],
                                 "source_no int, page_content string, metadata map<string,string>, wrapped string")
    text = reports.answer_report(rows, "final", [1, 2])
    assert text.index("## Document #2") < text.index("## Document #1") and "* **k**: `v`" in text and text.endswith("> # Answer:\n> final")
    assert "[1](#document-1)" in text
    with pytest.raises(ValueError):
        take_bounded(rows, 1, "rows")


def test_notices():
    assert reports.notify(lambda t: t, "x") == "x"
    with pytest.raises(ValueError):
        reports.notify(lambda t: None, "x")
    assert reports.notice_parts("short") == ("short", None) and reports.notice_parts("x" * 5000)[1] == b"x" * 5000


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["query_id", "chunk_id", "rank", "score", "mean_vote", "n_chars"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name, column", [("knn_cosine", "embedding"), ("content_hash", "text"), ("cache_hit", "doc_id")])
def test_scans_read_only_what_they_need(spark, name, column, capsys):
    import __spark_entry__ as entry

    entry.queries()[name](spark, "/root/testdata/sf0.001").explain("formatted")
    schemas = [line for line in capsys.readouterr().out.splitlines() if "ReadSchema" in line]
    assert schemas and all("lang" not in s and "props" not in s for s in schemas) and any(column in s for s in schemas)


def test_no_query_multiplies_its_rows(spark, capsys):
    """No plan holds a Cartesian product or an unbounded nested-loop join."""
    import __spark_entry__ as entry

    queries = entry.queries()
    for name in ("search_docs", "containment_join", "redundant_filter", "unique_suffix", "subtag", "dedup_merge", "library_fanout", "knn_cosine"):
        queries[name](spark, "/root/testdata/sf0.001").explain()
        plan = capsys.readouterr().out
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
