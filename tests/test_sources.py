import json
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import documents, models
from corpusmill.plans import query as Q
from corpusmill.plans import summarize as Z
from corpusmill.sinks import formats, outline
from corpusmill.sources import bookmarks, cards, connectors, files, library, loading, manifest, media


def test_text_and_html_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "b.html").write_text("<p>x &amp; y</p><script>z()</script>")
    txt = files.load(spark, "txt", str(tmp_path / "a.txt")).first()
    assert txt["page_content"] == "one\ntwo" and txt["path"].endswith("a.txt")
    assert files.load(spark, "local_html", str(tmp_path / "b.html")).first()["page_content"] == "x & y"
    upper = files.load(spark, "local_html", str(tmp_path / "b.html"), functions=[F.upper]).first()
    assert upper["page_content"].startswith("X")
    with pytest.raises(ValueError):
        files.load(spark, "nothing", "x")


def test_inline_text(spark):
    got = files.load(spark, "text", "the text", metadata='{"a": 1}').first()
    assert got["page_content"] == "the text" and got["metadata"] == {"a": "1"}
    assert files.load(spark, "string", "pasted").first()["path"] == "user_string"


def test_json_dict(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"a": "x", "b": "y", "c": "z"}))
    rows = files.load(spark, "json_dict", str(tmp_path / "d.json"), template="{key}={value}", exclude=["c"]).collect()
    assert sorted(r["page_content"] for r in rows) == ["a=x", "b=y"]
    with pytest.raises(ValueError):
        files.load(spark, "json_dict", str(tmp_path / "d.json"), template="{key}")


def test_office_files(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", "<w:document><w:p><w:r><w:t>Hello</w:t></w:r><w:r><w:t xml:space=\"preserve\"> big</w:t></w:r></w:p><w:p><w:t>R&amp;D</w:t></w:p></w:document>")
    assert files.load(spark, "word", str(tmp_path / "a.docx")).first()["page_content"] == "Hello big\nR&D"
    with zipfile.ZipFile(tmp_path / "a.pptx", "w") as z:
        z.writestr("ppt/slides/slide10.xml", "<a:p><a:t>ten</a:t></a:p>")
        z.writestr("ppt/slides/slide2.xml", "<a:p><a:t>two</a:t></a:p>")
    assert files.load(spark, "powerpoint", str(tmp_path / "a.pptx")).first()["page_content"] == "two\nten"
    with zipfile.ZipFile(tmp_path / "a.epub", "w") as z:
        z.writestr("OEBPS/c1.xhtml", "<html><body><p>First</p></body></html>")
        z.writestr("OEBPS/c2.xhtml", "<html><body><p>Second</p></body></html>")
    assert files.load(spark, "epub", str(tmp_path / "a.epub")).first()["page_content"].split() == ["First", "Second"]


def test_pdf_parsers_compete(spark, tmp_path, monkeypatch):
    (tmp_path / "a.pdf").write_bytes(b"%PDF the words of the story and the end of it")
    prose = "the words of the story and the end of it for that is on the page"
    monkeypatch.setattr(files, "PDF_PARSERS", {"noise": lambda b: "zz qq xx", "good": lambda b: prose, "broken": lambda b: 1 / 0})
    got = files.load(spark, "pdf", str(tmp_path / "a.pdf")).first()
    assert got["page_content"] == prose and got["metadata"] == {"pdf_loader_name": "good"} and got["load_error"] is None
    monkeypatch.setattr(files, "PDF_PARSERS", {"noise": lambda b: "zz"})
    assert files.load(spark, "pdf", str(tmp_path / "a.pdf")).first()["load_error"] == "no parser succeeded"


def test_outline_properties(spark):
    page = "topic:: maps\n- first block\n  kind:: a\n- second block\n  kind:: b\n  extra:: e\n- third block"
    df = spark.createDataFrame([(1, page)], "doc_id int, text string")
    rows = files.outline_chunks(df, 8, 0).orderBy("chunk_no").collect()
    assert [r["page_content"] for r in rows] == ["- first block - second block", "- third block"]
    assert rows[0]["metadata"] == {"topic": "maps", "kind": "a,b", "extra": "e"} and rows[1]["metadata"] == {"topic": "maps"}
    assert all(r["unmatched"] == 0 for r in rows)


def test_finish_and_gate(spark):
    docs = spark.createDataFrame([(1, "<p>word " + "word " * 200 + "</p>", {"Author": "A", "authors": "B"}), (2, "  ", {})],
                                 "id int, page_content string, metadata map<string,string>")
    out = documents.finish(docs, F.lit("h")).collect()
    assert len(out) == 1 and out[0]["metadata"] == {"author": "B"} and "<p>" not in out[0]["page_content"]
    assert out[0]["source"] == "undocumented" and out[0]["title"] == "Untitled"
    gated = documents.gate(documents.finish(docs, F.lit("h")), ["id"]).first()
    assert gated["load_error"] is None
    small = spark.createDataFrame([(1, 5, 0.01)], "id int, tkn_length int, doc_reading_time double")
    assert documents.gate(small, ["id"]).first()["load_error"] == "too few tokens"
    with pytest.raises(ValueError):
        documents.refuse_all_failed(documents.gate(small, ["id"]))


@pytest.mark.parametrize("old, given, fetched, path, want", [
    (None, None, None, "a", "Untitled"), (None, "T", None, "a", "T"), ("Own", "T", None, "a", "Own - T"), ("Own T", "T", None, "a", "Own T"),
    (None, None, "Page", "http://x", "Page"), ("Untitled", "T", None, "a", "T"),
])
def test_titles(one, old, given, fetched, path, want):
    s = lambda v: F.lit(v).cast("string")
    assert one(documents.merged_title(s(old), s(given), s(fetched), s(path))) == want


def test_source_tags(one):
    s = lambda v: F.lit(v).cast("string")
    assert one(documents.merged_tag(s(None), s("a"))) == "a" and one(documents.merged_tag(s("x unset"), s("a"))) == "x a"
    assert one(documents.merged_tag(s("x"), s(None))) == "unset"


def test_loading_failures(spark):
    docs = loading.with_load_errors(spark.createDataFrame([("word " * 100,), (" ",)], "page_content string"))
    assert loading.loaded(docs).count() == 1
    with pytest.raises(ValueError):
        loading.loaded(docs, "crash")
    with pytest.raises(ValueError):
        loading.loaded(docs.filter("load_error is not null"))


# manifests

def test_manifest_entries():
    assert manifest.check_entry({"path": "a", "odd": 1}, "strip") == ({"path": "a"}, ["unknown argument 'odd'"])
    assert manifest.check_entry({"path": 3}, "warn")[0] == {"path": 3}
    for bad in ({"odd": 1}, {"path": 3}):
        with pytest.raises(ValueError):
            manifest.check_entry(bad, "strict")
    with pytest.raises(ValueError):
        manifest.check_entry({})
    assert manifest.toml_entries('[[a]]\npath = "x"\n[[b]]\npath = "y"\nfiletype = "txt"') == [
        {"filetype": "auto", "path": "x"}, {"filetype": "txt", "path": "y"}]
    with pytest.raises(ValueError):
        manifest.toml_entries('[[a]]\nx=1\n[[a]]\nx=2')


def test_json_lines(spark):
    lines = spark.createDataFrame([('- {"path": "a"}',), ("# no",), ("",), ('{"path": "b", "filetype": "pdf"}',)], "line string")
    got = [r["args"] for r in manifest.json_lines(lines, "line", {"source_tag": "t", "filetype": "json_entries"}).collect()]
    assert got == [{"source_tag": "t", "filetype": "auto", "path": "a"}, {"source_tag": "t", "path": "b", "filetype": "pdf"}]


def test_links(spark):
    lines = spark.createDataFrame([("- [x](http://a.b/c) more",), ("see https://d.e",), ("none",)], "line string")
    assert [r["path"] for r in manifest.link_lines(lines, "line").collect()] == ["http://a.b/c", "https://d.e"]


def test_recursive_paths(spark, tmp_path):
    for name in ("a/x.txt", "a/b/y.txt", "a/z.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("t")
    got = manifest.recursive_paths(spark, str(tmp_path), "*.txt", include=["txt"], exclude=["/b/"])
    assert [r["path"].rsplit("/", 1)[1] for r in got.collect()] == ["x.txt"]
    sub = manifest.recursive_paths(spark, str(tmp_path), "a/b/*.txt").collect()
    assert sub and all("/b/" in r["path"] for r in sub)
    assert {r["path"] for r in manifest.recursive_paths(spark, str(tmp_path), "**/*.txt").collect()} == {
        r["path"] for r in manifest.recursive_paths(spark, str(tmp_path), "*.txt").collect()}
    with pytest.raises(ValueError):
        manifest.recursive_paths(spark, str(tmp_path), "*.txt", include=["."], on_useless="crash")
    with pytest.raises(ValueError):
        manifest.recursive_paths(spark, str(tmp_path), recursed_filetype="anki")
    typed = manifest.with_filetype(got).first()
    assert typed["filetype"] == "txt"


def test_expand_stops_on_a_loop(spark):
    start = spark.createDataFrame([("m", "json_entries")], "path string, filetype string")
    with pytest.raises(ValueError):
        manifest.expand(start, lambda pending: pending)
    # one manifest reached twice, by ways of different length, is no loop
    below = {"m": ["n", "o"], "n": ["o"], "o": ["f"]}
    kids = spark.createDataFrame([(a, b) for a, bs in below.items() for b in bs], "above string, path string")

    def children(pending):
        return pending.select(F.col("path").alias("above")).join(kids, "above").select(
            "path", F.when(F.col("path") == "f", "txt").otherwise("json_entries").alias("filetype"))

    assert [r["path"] for r in manifest.expand(start, children).collect()] == ["f", "f"]
    done = manifest.expand(start, lambda pending: pending.select("path", F.lit("txt").alias("filetype")))
    assert [tuple(r) for r in done.collect()] == [("m", "txt", 1)]


def test_piped(tmp_path):
    folder = str(tmp_path)
    assert manifest.piped_entry(b"https://x.org\n", folder)["path"] == "https://x.org"
    assert manifest.piped_entry(str(tmp_path).encode(), folder)["path"] == str(tmp_path)
    assert manifest.piped_entry(b'{"path": "a"}\n', folder)["filetype"] == "json_entries"
    assert manifest.piped_entry(b'[[a]]\npath = "x"\n', folder)["filetype"] == "toml_entries"
    assert manifest.piped_entry(b"some words\nmore", folder)["filetype"] == "txt"
    assert manifest.piped_entry(b"\xff\xfe\x00", folder)["filetype"] == "auto"


# libraries, bookmarks, cards

def test_library(spark):
    items = spark.createDataFrame([("K", "Paper", "Title: Paper", "abs"), ("L", "Other", "", "")], "key string, title string, header string, abstract string")
    kids = spark.createDataFrame([("K", "c1", "attachment", "file", "full text", "pdf", "p.pdf", None), ("K", "c2", "attachment", "", None, "pdf", "q.pdf", None),
                                  ("K", "c3", "note", "", None, None, None, "n")],
                                 "parent_key string, child_key string, item_type string, title string, fulltext string, filetype string, path string, note string")

    def branches(*args, **kw):
        return sorted((r["key"], r["branch"], r["filetype"]) for r in library.fan_out(items, kids, *args, **kw).collect())

    assert branches() == [("K", "file", "pdf"), ("K", "file", "pdf"), ("K", "metadata", "txt")]
    assert branches("fulltext", include_metadata=False) == [("K", "fulltext", "txt")]
    assert branches("hybrid", include_notes=True) == [("K", "file", "pdf"), ("K", "fulltext", "txt"), ("K", "metadata", "txt"), ("K", "note", "txt")]
    with pytest.raises(ValueError):
        branches("other")


def test_library_selectors(spark):
    items = spark.createDataFrame([("A", "Deep nets", "journalArticle", [("ml",)]), ("B", "Soil", "book", []), ("N", "note", "note", [])],
                                  "key string, title string, itemType string, tags array<struct<tag:string>>")
    cols = spark.createDataFrame([("1", "Top", None), ("2", "Sub", "1")], "key string, name string, parent string")
    inside = spark.createDataFrame([("A", "2"), ("A", "1"), ("B", "9")], "item_key string, collection_key string")

    def keys(kind, *values, searches=None):
        return sorted(r["key"] for r in library.resolve(items, cols, inside, kind, list(values), searches).collect())

    assert keys("library") == ["A", "B"] and keys("items", "B") == ["B"] and keys("tag", "ml") == ["A"]
    assert keys("collection", "Top") == ["A"] and keys("collection", "Top%%Sub") == ["A"]
    assert keys("search", "S", searches={"S": [("title", "deep"), ("odd", "x")]}) == ["A"]
    with pytest.raises(ValueError):
        keys("search", "S")


@pytest.mark.parametrize("kind, text, html, asset, wanted, want", [
    ("text", "t", None, None, "auto", "txt"), ("text", " ", None, None, "auto", None), ("asset", "t", None, "a", "auto", "txt"),
    ("asset", "t", None, "a", "parse", "pdf"), ("asset", "t", None, None, "parse", "txt"), ("asset", None, None, "a", "native", None),
    ("link", None, "h", "a", "auto", "local_html"), ("link", None, None, "a", "auto", "pdf"), ("link", None, "h", "a", "parse", "pdf"),
    ("link", None, "h", None, "parse", "local_html"), ("link", None, None, "a", "native", None),
])
def test_bookmark_artifacts(one, kind, text, html, asset, wanted, want):
    s = lambda v: F.lit(v).cast("string")
    got = one(bookmarks.artifact(s(kind), s(text), s(html), s(asset), F.lit("H"), wanted))
    assert (got and got["filetype"]) == want


def test_bookmark_url_and_names(one, spark):
    s = lambda v: F.lit(v).cast("string")
    assert one(bookmarks.web_url(s("7"), "http://h/api/v1/", s("u"), s(None))) == "http://h/dashboard/preview/7"
    assert one(bookmarks.web_url(s("7"), None, s(""), s("su"))) == "su"
    known = spark.createDataFrame([("a", 1)], "name string, id int")
    with pytest.raises(ValueError, match="known"):
        bookmarks.ids_of_names(spark.createDataFrame([("b",)], "name string"), known)


def test_cards(spark):
    schema = ("cid long, nid long, codeck string, cdeck string, nmodel string, ntags array<string>, nflds array<string>, "
              "fields_name array<string>, cqueue string, cmod long")
    fields = ["Front", "Back"]
    rows = [(1, 10, "", "Lang\x1fFr", "Basic", ["t1"], ['{{c1::un}} <img src="a.png" alt="one">', "<b>one</b>"], fields, "new", 5),
            (2, 10, "", "Lang\x1fFr", "Basic", ["t1"], ["other card", "x"], fields, "new", 5),
            (3, 11, "Lang::De", "", "Basic", [], ["zwei", " "], fields, "suspended", 6),
            (4, 12, "Lang::De", "", "Cloze", ["t2"], ["drei", ""], fields, "new", 7)]
    df = spark.createDataFrame(rows, schema)
    got = {r["nid"]: r for r in cards.load_cards(df).collect()}
    assert set(got) == {10, 12} and got[10]["anki_deck"] == "Lang::Fr"
    assert "[IMAGE_1]" in got[10]["page_content"] and "Alt: 'one'" in got[10]["page_content"] and "back: 'one'" in got[10]["page_content"]
    assert got[12]["page_content"] == "front: 'drei'" and json.loads(got[10]["anki_media"])["[IMAGE_1]"].startswith("<img")
    assert [r["nid"] for r in cards.load_cards(df, notetype="clo").collect()] == [12]
    assert [r["nid"] for r in cards.load_cards(df, tag_filter="t1").collect()] == [10]
    assert [r["page_content"] for r in cards.load_cards(df, "{Front}|{tags}", deck="Lang::De").collect()] == ["drei|\nt2"]
    with pytest.raises(ValueError):
        cards.check_template(df, "{absent}")
    cards.check_template(df, "{front} {allfields}")


# media, connectors

def test_subtitles(spark):
    tracks = spark.createDataFrame([("v", "auto", "en", 1), ("v", "manual", "en-US", 2), ("w", "auto", "fr-orig", 1), ("w", "manual", "en", 2), ("x", "auto", "de", 1)],
                                   "id string, kind string, lang string, pos int")
    got = {r["id"]: (r["kind"], r["lang"]) for r in media.pick_subtitle(tracks, ["id"]).collect()}
    assert got == {"v": ("manual", "en-US"), "w": ("auto", "fr-orig")}
    assert media.pick_subtitle(tracks, ["id"], ["de"]).first()["id"] == "x"


def test_transcribe(spark):
    audio = spark.createDataFrame([("a", bytearray(b"x"))], "path string, content binary")
    got = media.transcribe(audio, lambda batch: [[{"start": 20.0, "end": 22.0, "text": "hi"}, {"start": 22.0, "end": 24.0, "text": "there"}] for _ in batch])
    assert got.first()["page_content"] == "00:00:20 hi there"


def test_fetch_and_reader(spark, one):
    urls = spark.createDataFrame([("http://a",)], "path string")
    assert media.fetch(urls, lambda batch: [f"<p>{u}</p>" for u in batch]).first()["html"] == "<p>http://a</p>"
    assert one(media.reader_text(F.lit("Title: T\nMarkdown Content:\n[a](http://b) ![img](c)"))) == "\na img"


class Pages:
    def page(self, selector, cursor):
        n = cursor or 0
        return [{"id": f"{selector}{n}", "x": None}], (n + 1 if n < 2 else 1)


def test_paging(spark):
    assert [r["id"] for r in connectors.all_pages(Pages(), "s")] == ["s0", "s1", "s2"]
    from pyspark import cloudpickle
    import sys

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    df = connectors.read_paged(spark, "pages_for_test", Pages(), ["id", "x"], ["a", "b"])
    assert sorted(r["id"] for r in df.collect()) == ["a0", "a1", "a2", "b0", "b1", "b2"]


def test_private_mode(spark):
    connectors.PrivateMode(spark, True).check("http://localhost:1/x")
    connectors.PrivateMode(spark, False).check("http://example.org")
    with pytest.raises(PermissionError):
        connectors.PrivateMode(spark, True).check("http://example.org")


# tasks

def test_formats(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, " a ", {"k": "v"}), (2, 2, "b", {})], "pos int, n_chunks int, page_content string, metadata map<string,string>")
    one_row = rows.limit(1).withColumn("n_chunks", F.lit(1))
    render = lambda df, fmt: formats.render(formats.pieces(df, fmt), [])
    assert render(rows, "text") == "a\nb"
    assert render(rows, "split_text") == "Parsed documents:\nDoc #1/2\n a \n\n\nDoc #2/2\nb"
    assert render(one_row, "split_text") == "Parsed document:\na"
    assert render(rows, "xml") == "<documents>\n<doc id=0>\n a \n</doc>\n<doc id=1>\nb\n</doc>\n</documents>"
    assert json.loads(render(one_row, "dict")) == {"page_content": " a ", "metadata": {"k": "v"}}
    with pytest.raises(ValueError):
        render(rows, "other")
    folder = str(tmp_path / "out")
    formats.write_pieces(formats.pieces(rows, "text"), folder, [])
    assert sorted(r["value"] for r in spark.read.text(folder).collect()) == ["a", "b"]
    formats.append_text(str(tmp_path / "o.txt"), "x")
    formats.append_text(str(tmp_path / "o.txt"), "y")
    assert (tmp_path / "o.txt").read_text() == "x\ny\n"
    (tmp_path / "b.bin").write_bytes(b"\0\1")
    with pytest.raises(ValueError):
        formats.append_text(str(tmp_path / "b.bin"), "x")


def test_outline_page(one, tmp_path):
    got = one(outline.link_tags(F.lit("The red fox\nred\nplain"), F.array(F.lit("red fox")), F.array(F.lit("red"))))
    assert got == "The [[red fox]] [[red]]\nred [[red]]\nplain"
    outline.append_page(str(tmp_path), "p", "a")
    assert outline.append_page(str(tmp_path), "p", "b").read_text() == "a\nb\n"


def test_top_k_steps():
    assert Q.top_k_steps("auto_200_500") == [200, 300, 450, 500] and Q.top_k_steps(50) == [50]
    assert Q.top_k_steps("auto_2_500")[-1] == 500 and Q.top_k_steps("auto_1_5") == [1, 2, 3, 4, 5]
    for bad in ("auto_5_2", 0):
        with pytest.raises(ValueError):
            Q.top_k_steps(bad)


def test_adaptive_cut(spark):
    rows = [(q, r, q == 0 or r % 2 == 0) for q in (0, 1) for r in range(1, 31)]
    df = spark.createDataFrame(rows, "query_id int, rank int, keep boolean")
    got = {r["query_id"]: (r["top_k"], r["n_kept"]) for r in Q.adaptive_cut(df, "auto_10_30").collect()}
    assert got == {0: (30, 30), 1: (10, 5)}


def test_answers(spark):
    from corpusmill.operators.models import hash_embedding

    rows = [(0, r, f"answer number {r}") for r in range(1, 8)] + [(1, 1, "only one")] + [(2, 1, "IRRELEVANT")]
    kept = spark.createDataFrame(rows, "query_id int, rank int, text string")
    got = {r["query_id"]: r for r in Q.answer_questions(kept, F.col("text"), hash_embedding, prefix="DOC_").collect()}
    assert got[0]["sources"] == list(range(1, 8)) and got[0]["missing_sources"] == [] and got[0]["rounds"] >= 1
    assert all(f"(#document-{n})" in got[0]["answer"] and f"answer number {n}" in got[0]["answer"] for n in range(1, 8))
    assert got[1]["answer"].startswith("Source identifier: [[[1](#document-1)]]") and "only one" in got[1]["answer"] and got[1]["rounds"] == 0
    assert got[2]["error"] == "no relevant intermediate answer"


def test_summary_fold(spark):
    model = lambda chunk, previous: F.concat(F.lit("seen "), F.size(previous).cast("string"), F.lit(" "), chunk)
    chunks = F.array(F.lit("a"), F.lit("b"))
    row = spark.range(1).select(Z.fold_chunks(chunks, model).alias("s")).first()["s"]
    assert row == ["- seen 0 a", "- seen 1 b"]
    text = spark.range(1).select(Z.assemble(Z.fold_chunks(chunks, model)).alias("s")).first()["s"]
    assert text == "- Chunk 1/2\n- seen 0 a\n- ---\n- Chunk 2/2\n- seen 1 b"
    cited = spark.range(1).select(Z.fold_chunks(chunks, model, F.lit(3), F.lit("f.pdf")).alias("s")).first()["s"]
    assert cited[0] == "- seen 0 a [p.3, f.pdf]"


def test_recursive_summaries(spark):
    halve = lambda chunk, previous: F.substring(chunk, 1, F.floor(F.length(chunk) / 2).cast("int"))
    docs = spark.createDataFrame([(1, "word " * 400), (2, "tiny text")], "doc_id int, text string")
    got = {r["doc_id"]: r for r in Z.summarize(docs, halve, n_recursion=2).collect()}
    assert list(got[1]["recursive_summaries"]) == [0, 1, 2] and len(got[1]["summary"]) < 300
    assert list(got[2]["recursive_summaries"]) == [0]


def test_summary_with_a_python_model(spark):
    calls = spark.sparkContext.accumulator(0)

    def reply(chunks, previous):
        calls.add(1)
        return [f"{c.split()[0]} after {len(p)}" for c, p in zip(chunks, previous, strict=True)]

    model = models.python_model(reply, "string")
    docs = spark.createDataFrame([(1, "\n".join(f"w{i} " + "word " * 300 for i in range(40))), (2, "tiny text"), (3, ""), (4, None)],
                                 "doc_id int, text string").coalesce(1)
    got = {r["doc_id"]: r for r in Z.summarize(docs, model, n_recursion=1).collect()}
    n = got[1]["n_chunk"]
    assert n > 2 and f"- Chunk {n}/{n}" in got[1]["recursive_summaries"][0]
    assert got[2]["summary"] == "- tiny after 0" and got[1]["recursive_summaries"][0].count("after 1") == n - 1
    assert calls.value <= 2 * n  # one call a round and batch, none repeated


def test_incremental_ingest(spark, tmp_path):
    from corpusmill.streaming.ingest import ingest_folder

    inbox, stored = tmp_path / "in", str(tmp_path / "store")
    inbox.mkdir()
    (inbox / "a.txt").write_text("some words here")
    (inbox / "b.txt").write_text("some words here")
    run = lambda: ingest_folder(spark, str(inbox), stored, str(tmp_path / "mark"))
    run()
    assert spark.read.parquet(stored).count() == 1
    (inbox / "c.txt").write_text("other words")
    (inbox / "d.txt").write_text("some words here")
    run()
    assert spark.read.parquet(stored).count() == 2


def test_command_line():
    from corpusmill.cli import normalise

    assert normalise(["query", "--top-k=5", "--path", "x"]) == {"task": "query", "top_k": 5, "path": "x"}
    assert normalise(["summary", "file.txt", "--private"]) == {"task": "summarize", "path": "file.txt", "private": True}
    assert normalise(["--task=parse", "--filetype=txt", "a b"]) == {"task": "parse", "filetype": "txt", "path": "a b"}
    with pytest.raises(SystemExit):
        normalise(["nothing", "--x=1"])


def zipped(path, members):
    with zipfile.ZipFile(path, "w") as archive:
        for name, text in members.items():
            archive.writestr(name, text)
    return str(path)


def test_open_document_text(spark, tmp_path):
    body = ('<office:document-content><office:styles><text:p>no</text:p></office:styles><office:body><office:text><text:h>Title &amp; more</text:h>'
            '<text:p>one<text:s text:c="2"/>two <text:span>bold</text:span><text:tab/>x<text:line-break/>y</text:p><text:p/></office:text></office:body></x>')
    row = files.load(spark, "word", zipped(tmp_path / "a.odt", {"content.xml": body})).first()
    assert row["page_content"] == "Title & more\none  two bold\tx\ny" and row["load_error"] is None
    assert files.load(spark, "powerpoint", zipped(tmp_path / "a.odp", {"content.xml": body})).first()["page_content"].startswith("Title & more")


def test_old_word_files_are_rows(spark, tmp_path):
    (tmp_path / "a.doc").write_bytes(b"\xd0\xcf\x11\xe0 binary")
    zipped(tmp_path / "b.docx", {"other": "x"})
    zipped(tmp_path / "c.docx", {"word/document.xml": "<w:p><w:t>fine</w:t></w:p>"})
    rows = {r["path"].rsplit("/", 1)[1]: r for r in files.load(spark, "word", str(tmp_path)).collect()}
    assert rows["c.docx"]["page_content"] == "fine" and rows["c.docx"]["load_error"] is None
    for name in ("a.doc", "b.docx"):
        assert rows[name]["page_content"] is None and rows[name]["load_error"].startswith("not a word file")


def test_books_in_reading_order(spark, tmp_path):
    package = ('<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="i1" href="a%20b.xhtml"/><item id="i2" href="z.xhtml"/>'
               '</manifest><spine><itemref idref="i2"/><itemref idref="i1"/></spine></package>')
    pages = {"O/z.xhtml": "<p>first</p>", "O/a b.xhtml": "<p>second</p>", "O/cover.html": "<p>cover</p>", "O/p.opf": package}
    container = {"META-INF/container.xml": '<c xmlns="urn:u"><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></c>'}
    text = files.load(spark, "epub", zipped(tmp_path / "b.epub", pages | container)).first()["page_content"]
    assert text.split() == ["first", "second"]
    text = files.load(spark, "epub", zipped(tmp_path / "a.epub", pages)).first()["page_content"]  # without a package: by name
    assert text.split() == ["second", "cover", "first"]


def test_pdf_parsers_stop_early(spark, tmp_path, monkeypatch):
    prose = "This is a plain sentence about the house and the dog, and it is in English as all of them are. " * 3
    monkeypatch.setitem(files.PDF_PARSERS, "good", lambda data: f"{prose}\f \f{data.decode()}")
    monkeypatch.setitem(files.PDF_PARSERS, "fails", lambda data: 1 / 0)
    monkeypatch.setitem(files.PDF_PARSERS, "never", lambda data: 1 / 0)
    (tmp_path / "a.pdf").write_bytes(b"tail")
    row = files.load(spark, "pdf", str(tmp_path / "a.pdf"), parsers=["fails", "good", "never"]).first()
    assert row["metadata"] == {"pdf_loader_name": "good"} and row["page_content"].split("\n")[-1] == "tail" and row["load_error"] is None
    row = files.load(spark, "pdf", str(tmp_path / "a.pdf"), parsers=["fails"]).first()
    assert row["page_content"] is None and row["load_error"] == "no parser succeeded"


def test_staged_fetch(spark):
    from corpusmill.sources import media

    urls = spark.createDataFrame([("u1",), ("u2",), ("u2",), ("u3",), (None,)], "path string")
    long = "enough words to pass the gate of twenty tokens, surely so, as this sentence has more of them than that."
    ways = [("reader", lambda us: [long if u == "u1" else "short" for u in us]), ("plain", lambda us: [long + u if u == "u2" else None for u in us])]
    got = {r["path"]: (r["stage"], r["calls"], r["content"]) for r in media.staged_fetch(urls, ways).collect()}
    assert got == {"u1": ("reader", 1, long), "u2": ("plain", 2, long + "u2"), "u3": (None, 2, None)}


def test_bookmark_selectors(spark):
    from corpusmill.sources.bookmarks import resolve_bookmarks, search_terms

    text = '-"a phrase" #Tag list:"My List" is:fav word -is:link - "" -#x'
    got = spark.range(1).select(search_terms(F.lit(text)).alias("t")).first()["t"]
    assert [tuple(t) for t in got] == [(True, "word", "a phrase"), (False, "tag", "tag"), (False, "list", "my list"), (False, "is", "fav"),
                                       (False, "word", "word"), (True, "is", "link"), (False, "word", "-"), (True, "tag", "x")]
    rows = [("1", "Hello", "a Phrase here", ["x", "y"], ["l"], "text", True, False), ("2", None, None, None, None, "link", False, None)]
    marks = spark.createDataFrame(rows, "id string, title string, text string, tags array<string>, lists array<string>, kind string, "
                                        "favourited boolean, archived boolean").withColumn("url", F.lit("http://u"))

    def ids(selector):
        return sorted(r["id"] for r in resolve_bookmarks(marks, spark.createDataFrame([(selector,)], "selector string")).collect())

    assert ids("library") == ["1", "2"] and ids("favourites") == ["1"] and ids("archived") == []
    assert ids("tag:x") == ["1"] and ids("ids:1,2") == ["1", "2"] and ids("list:l") == ["1"] and ids("l") == ["1"]
    assert ids('search:"a phrase" -#z') == ["1"] and ids("search:is:link") == ["2"] and ids("search:http") == ["1", "2"]
    assert ids("search:is:nothing") == []
    for wrong in ("tag:none", "ids:7", "list:none"):
        with pytest.raises(ValueError, match="none|7"):
            ids(wrong)
    with pytest.raises(ValueError):
        ids("ids:")


def test_page_that_changed_meanwhile(tmp_path):
    known = outline.page_text(str(tmp_path), "p")
    outline.append_page(str(tmp_path), "p", "by hand")
    assert outline.append_page(str(tmp_path), "p", "made", known).name == "p.conflict.md"
    outline.append_page(str(tmp_path), "p", "more", known)
    assert (tmp_path / "p.conflict.md").read_text() == "made\nmore\n" and outline.page_text(str(tmp_path), "p") == "by hand\n"
    assert outline.append_page(str(tmp_path), "p", "made", outline.page_text(str(tmp_path), "p")).read_text() == "by hand\nmade\n"


def test_readers_that_raise_and_strange_arguments(spark):
    from corpusmill.sources.pipeline import load_corpus, reader

    def read(path):
        if path == "bad":
            raise OSError("no such thing")
        return f"This is the text of {path}, which is long enough to be kept by the gate, as it has many words in it. " * 6

    entries = spark.createDataFrame([("good", {"title": "T"}), ("bad", {}), ("odd", {"colour": "red", "title": "U"})],
                                    "path string, args map<string,string>").withColumn("filetype", F.lit("thing"))
    for mode, failed in (("warn", {"bad": "OSError: no such thing"}), ("strip", {"bad": "OSError: no such thing"}),
                         ("strict", {"bad": "OSError: no such thing", "odd": "unknown arguments: colour"})):
        docs, failures = load_corpus(entries, {}, {"thing": reader(read)}, arguments=mode)
        assert [(r["path"], r["load_error"]) for r in failures.collect()] == sorted(failed.items())
        assert {r["path"] for r in docs.collect()} == {"good", "bad", "odd"} - set(failed)
    with pytest.raises(ValueError):
        load_corpus(entries, {}, {}, arguments="maybe")


def test_wavefront_summaries(spark, monkeypatch):
    """Each chunk is asked once, with the last lines of the summary before it, page and label cited."""
    seen = spark.sparkContext.accumulator(0)

    def call(chunks, before):
        seen.add(len(chunks))
        return [f"- {c} after {len(b)} of {b[-1] if len(b) else 'none'}" for c, b in zip(chunks, before, strict=True)]

    model = models.python_model(call, "string")
    df = spark.createDataFrame([(1, ["a", "b", "c"], 7, None), (2, ["x"], None, None), (3, [], 1, None), (4, None, 1, None), (5, ["p", "q"], 9, "L")],
                               "k int, chunks array<string>, page int, label string")
    got = {r["k"]: r["s"] for r in Z.folded(df, "chunks", model, "s", page="page", label="label").collect()}
    assert got[1] == ["- a after 0 of none [p.7]", "- b after 1 of - a after 0 of none [p.7]",
                      "- c after 1 of - b after 1 of - a after 0 of none [p.7]"]
    assert got[2] == ["- x after 0 of none"] and got[3] == [] and got[4] == [] and got[5][0] == "- p after 0 of none [p.9, L]"
    assert seen.value == 6


def test_tasks_from_the_command_line(spark, tmp_path):
    from corpusmill import cli

    (tmp_path / "a.txt").write_text("The fox is red and lives in the wood. The cat is grey.\nThe dog is brown.")
    (tmp_path / "long.txt").write_text("\n".join(f"line {i} of a long text with many words in it" for i in range(2000)))
    ask = {"path": str(tmp_path / "a.txt"), "query": "which fox is red", "cache": str(tmp_path / "cache")}
    first, again = list(cli.query(spark, dict(ask))), list(cli.query(spark, dict(ask)))
    assert "fox is red" in "\n".join(first) and first[-1] == "votes asked: 1, answers asked: 1"
    assert again[:-1] == first[:-1] and again[-1] == "votes asked: 0, answers asked: 0"
    assert any(line.startswith("found in") for line in cli.search(spark, dict(ask)))
    whole = list(cli.parse(spark, {"path": str(tmp_path / "a.txt"), "format": "text"}))
    assert whole == ["The fox is red and lives in the wood. The cat is grey.\nThe dog is brown."]
    parts = list(cli.parse(spark, {"path": str(tmp_path / "long.txt"), "format": "split_text"}))
    assert len(parts) > 3 and parts[0].startswith(f"Parsed documents:\nDoc #1/{len(parts)}\n")
    said = list(cli.parse(spark, {"path": str(tmp_path / "long.txt"), "format": "xml", "out_file": str(tmp_path / "out.xml")}))
    assert said == [f"{len(parts)} pieces written to {tmp_path / 'out.xml'}"]
    (tmp_path / "nameless").write_bytes(b"%PDF-1.4 x")
    with pytest.raises(ValueError, match="pdf"):
        list(cli.parse(spark, {"path": str(tmp_path / "nameless")}))


GATE_TABLES = """CREATE TABLE documents AS SELECT i AS doc_id, 'large' AS source, 'en' AS lang, repeat('the of and ' || repeat('w', 50000) || ' ', 210) AS text FROM range(4) t(i)
  UNION ALL SELECT 6, 'tiny', 'en', 'qq zz'"""


def gate_against_sql(spark, tmp_path, name):
    """A source of more tokens than a file may have, and one of a few words."""
    import duckdb
    from compare import rows_of
    from corpusmill.plans.catalog import load

    con = duckdb.connect()
    con.execute(GATE_TABLES)
    con.execute(f"COPY documents TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    queries, oracles = load()
    got, want = queries[name](spark, str(tmp_path)), con.sql(oracles[name])
    assert rows_of(got.columns, got.collect()) == rows_of(want.columns, want.fetchall())


def test_language_gate_does_not_ask_for_size(spark, tmp_path):
    gate_against_sql(spark, tmp_path, "lang_gate")


def test_reading_gate_has_no_most_tokens(spark, tmp_path):
    gate_against_sql(spark, tmp_path, "reading_gate")
